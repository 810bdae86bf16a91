from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from tokenizers import Regex, Tokenizer, pre_tokenizers

from cordon.llm import bpe, pieces, token_counts, token_files

RANKS, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_split_is_the_pattern():
    rng = random.Random(2)
    signs = list("ab'stredlvm12 \n\t é!''²中\x1c\x85\xa0")
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(25))) for _ in range(5000)] + ["'", "''s", "it's 'll  x", "a\n\n b", "  "]
    cps, _ = pieces.code_points(texts)
    got = [cps[a:b].tobytes().decode("utf-32-le") for a, b in zip(*pieces.split(cps), strict=True)]
    assert got == [w for t in texts for w in regex.findall(P.PATTERN, t)]


def test_every_code_point_in_context(reference):
    """Between letters, digits, signs and white space, as both libraries split it: their tables of letters and numbers are older than ``regex``'s."""
    lib = Tokenizer.from_file(JSON)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    kind = pieces._classes()
    newer = {c for p, k in ((r"\p{L}", pieces.LETTER), (r"\p{N}", pieces.NUMBER)) for c in points if (regex.match(p, c) is not None) != (kind[ord(c)] == k)}
    for pattern, kinds in ((r"\p{L}", [pieces.LETTER]), (r"\p{N}", [pieces.NUMBER]), (r"\s", [pieces.SPACE, pieces.BLANK])):
        only = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        got = {c for k in range(0, len(points), 1 << 15) for w, _ in only.pre_tokenize_str("".join(points[k : k + (1 << 15)])) for c in w}
        assert got == {c for c in points if kind[ord(c)] in kinds}, pattern
    some = sorted(newer)[::9] + points[::499]
    for k in range(0, len(some), 500):
        text = "".join(f"a{c}b 1{c}2 {c}'s '{c}\n{c} {c}" for c in some[k : k + 500])
        cps, _ = pieces.code_points([text])
        start, end = pieces.split(cps)
        assert [b for _, (_, b) in lib.pre_tokenizer.pre_tokenize_str(text)] == end.tolist(), k
        assert [i for a, b in zip(start.tolist(), end.tolist(), strict=True) for i in reference.encode_ordinary(text[a:b])] == reference.encode_ordinary(text), k


def test_table_starts_anew_and_survives_equal_hashes(monkeypatch):
    def encode(xs):
        return np.array([ord(c) for x in xs for c in x], np.uint32), np.array([len(x) for x in xs])

    table = pieces.PieceTable(encode, limit=4)
    texts = [f"w{i} v{i % 3}" for i in range(50)]
    assert ["".join(map(chr, g)) for t in texts for g, _ in table.encode_texts([t])] == texts
    monkeypatch.setattr(pieces.PieceTable, "_hash", lambda self, cps, s, e: np.full(len(s), 7, np.uint64))
    clash = pieces.PieceTable(encode)
    assert ["".join(map(chr, g)) for t in texts for g, _ in clash.encode_texts([t])] == texts


def test_bpe_round_trip(odd_docs, odd_texts, reference):
    rows = bpe.round_trip(odd_docs, RANKS).collect()
    assert len(rows) == len(odd_texts) + 2
    for r in rows:
        text = "no id at all" if r.doc_id is None else odd_texts[r.doc_id] or ""
        ids = reference.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_encode_then_decode(odd_docs, odd_texts):
    encoded = bpe.encode(odd_docs.where("doc_id IS NOT NULL"), RANKS)
    for r in bpe.decode(encoded, RANKS).collect():
        assert bytes(r.decoded).decode() == (odd_texts[r.doc_id] or "") and len(r.ids) == 4 * r.n_tokens


def test_long_pieces_equal_the_library(reference):
    rng = random.Random(8)
    texts = ["a" * 900, "ab" * 300, "".join(rng.choice("etaoin") for _ in range(700)), "\u00e9\u4e2d" * 200, "the" * 500 + "hen" * 300, "x" * 300_000, "".join(rng.choice("ab") for _ in range(100_000))]
    texts += ["".join(rng.choice("etaoinshrdlucmfwypvbgkqjxz") for _ in range(n)) for n in (257, 400, 5000)]
    with bpe.worker(RANKS) as (duck, _):
        ids, n = duck.encode(texts)
    for got, t in zip(np.split(ids, np.cumsum(n)[:-1]), texts, strict=True):
        # the library's own time is quadratic in one letter's run
        assert got.tolist() == reference._encode_single_piece(t) if len(t) < 200_000 else reference.decode(got.tolist()) == t


def test_one_very_long_document(spark, reference):
    """Encoded and decoded in parts, with the result of the whole: 7 MB, over 3 million tokens."""
    rng = random.Random(9)
    some = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(1, 8))) for _ in range(2000)]
    text = "".join(rng.choice((" ", "  ", "\n", " '")) + rng.choice(some) for _ in range(1_200_000))
    ids = reference.encode_ordinary(text)
    got = bpe.round_trip(spark.createDataFrame([(1, "a b"), (2, text), (3, "")], "doc_id long, text string").coalesce(1), RANKS).where("doc_id = 2").first()
    assert len(ids) > 2_500_000 and got.n_tokens == len(ids)
    assert got.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and got.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(no_docs):
    assert bpe.round_trip(no_docs, RANKS).count() == 0
    assert token_files.round_trip(no_docs, JSON).count() == 0
    blocks = token_counts.write_flat(no_docs, JSON, 50256)
    assert token_counts.label(token_counts.scan(blocks, 50256), blocks).count() == 0


def test_variable_length_coding():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (rng.integers(0, 2**32, n, np.uint64) >> rng.integers(0, 33, n).astype(np.uint64)).astype(np.uint32)
        control, data = token_files.pack(v)
        assert len(control) == -(-n // 4)
        assert np.array_equal(token_files.unpack(control, data, n), v)


def test_token_files(odd_docs, odd_texts):
    lib = Tokenizer.from_file(JSON)
    rows = token_files.round_trip(odd_docs, JSON).collect()
    assert len(rows) == len(odd_texts) + 2
    order = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in order] == [None, *sorted([*range(len(odd_texts)), 9])]
    at = 0
    for r in order:
        text = "no id at all" if r.doc_id is None else odd_texts[r.doc_id] or ""
        ids = [*lib.encode(text, add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += r.n_tokens


def test_special_strings_as_the_library(spark):
    text = "a<|endoftext|>b <|endoftext"
    got = token_files.round_trip(spark.createDataFrame([(1, text)], "doc_id long, text string"), JSON).first()
    ids = [*Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids, 0]
    assert got.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("block", [1, 3, 64, 1 << 18])
def test_separator_scan(odd_docs, odd_texts, block):
    lib = Tokenizer.from_file(JSON)
    lib.encode_special_tokens = True
    texts = [(i, t) for i, t in enumerate(odd_texts) if len(t or "") < 4000]
    docs = odd_docs.where("length(coalesce(text, '')) < 4000")
    blocks = token_counts.write_flat(docs, JSON, 50256, block)
    got = sorted((r.doc_id is None, r.doc_id, r.n_tokens) for r in token_counts.label(token_counts.scan(blocks, 50256), blocks).collect())
    want = [(False, i, len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in [*texts, (9, "a b c d e f")]]
    want.append((True, None, len(lib.encode("no id at all", add_special_tokens=False).ids)))
    assert got == sorted(want, key=lambda x: (x[0], x[1] or 0, x[2]))


def test_scan_of_foreign_files(spark):
    """Files without a last separator, empty blocks, 16-bit ids."""
    pack = lambda *x: bytearray(np.array(x, "<u2").tobytes())
    rows = [(0, 0, pack(1, 2, 9)), (0, 1, pack()), (0, 2, pack(9, 3)), (0, 3, pack(4)), (1, 0, pack(9)), (2, 0, None)]
    df = spark.createDataFrame(rows, "file int, block long, data binary")
    got = sorted((r.file, r.ordinal, r.n_tokens) for r in token_counts.scan(df, 9, width=2).collect())
    assert got == [(0, 0, 2), (0, 1, 0), (0, 2, 2), (1, 0, 0)]


def test_rows_of_flat_files_are_small(spark, odd_docs, odd_texts):
    """Spark's reader holds a batch of rows of each task at once: with rows of a MB, four tasks held more than 6 GB."""
    blocks = token_counts.write_flat(odd_docs, JSON, 50256)
    rows = int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize"))
    assert rows * max(len(r.data) for r in blocks.select("data").collect()) <= 64 << 20
    # a file's blocks but the last are full, and numbered without a gap
    per_file = {}
    for r in sorted(blocks.select("file", "block", "data").collect(), key=lambda r: (r.file, r.block)):
        per_file.setdefault(r.file, []).append((r.block, len(r.data)))
    for sizes in per_file.values():
        assert [b for b, _ in sizes] == list(range(len(sizes)))
        assert all(n == 4 * token_counts.BLOCK_IDS for _, n in sizes[:-1])
    assert max(map(len, per_file.values())) > 10
    got = token_counts.label(token_counts.scan(blocks, 50256), blocks).where("doc_id = 7").first()
    lib = Tokenizer.from_file(JSON)
    assert got.n_tokens == len(lib.encode(odd_texts[7], add_special_tokens=False).ids)
