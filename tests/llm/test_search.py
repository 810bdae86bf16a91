from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cordon.llm import ann, common, decontaminate, license_scan, near_dedup, queries, shingles, url_filter
from cordon.llm.components import components

from .conftest import SF, words

URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.com/en/1", "https://www.example.com/en/1?x#y", "ftp://a.b.net/fr/", "http://a.net/es", "http://a.net/es/?q",
    "http://com/", "http://com", "http://xcom/", "http://example.com?/en/", "http://a..com/x", "http://ÄÖ.Example.Com/EN/", "x://y://z.com/", "http://net/fr/a://b", "http://a.net:80/fr/",
]


def judge(url: str | None) -> tuple:
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        k = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:k])
        path = rest[k:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(h + p, a) for h, p, a in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, *best


@pytest.mark.parametrize("limit", [100_000, 0])
def test_url_filter(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", limit)
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS + URLS[:6])], "page_id long, url string, host string, rule string")
    got = url_filter.filter_urls(pages, url_filter.rules_frame(spark, queries.URL_RULES)).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == sorted((i, *judge(u)) for i, u in enumerate(URLS + URLS[:6])) or {
        (r.page_id, r.host, r.path, r.rule, r.verdict) for r in got
    } == {(i, *judge(u)) for i, u in enumerate(URLS + URLS[:6])}
    assert url_filter.filter_urls(pages, url_filter.rules_frame(spark, []), default="block").where("verdict <> 'block'").count() == 0
    assert url_filter.filter_urls(pages.limit(0), url_filter.rules_frame(spark, queries.URL_RULES)).count() == 0


def test_url_sql(spark, have_tables):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = sorted(con.sql(queries.ORACLE["op3_url_filter"]).fetchall(), key=str)
    got = queries.op3_url_filter(spark, SF).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=str) == want


def test_license_scan(spark, odd_docs, no_docs):
    rng = random.Random(3)
    parts = []
    for k, (name, texts) in enumerate(license_scan.TEMPLATES.items()):
        for m, t in enumerate(texts):
            parts.append((100 * k + m, name, f"{words(rng, 37)} {t} {words(rng, 20)}"))
    long = license_scan.TEMPLATES["GPL-3.0"][1].split()
    near = " ".join([*long[:20], "changed", *long[21:]])
    half = " ".join(long[: len(long) // 2])
    docs = spark.createDataFrame([*[(i, t) for i, _, t in parts], (9001, f"{words(rng, 5)} {near} end"), (9002, f"{half} {words(rng, 40)}"), (9003, words(rng, 500))], "doc_id long, text string")
    got = {(r.doc_id, r.license) for r in license_scan.licenses(license_scan.scan(docs)).collect()}
    assert got >= {(i, n) for i, n, _ in parts}
    assert {i for i, _ in got if i > 9000} == {9001}
    assert license_scan.scan(odd_docs).count() == 0 and license_scan.scan(no_docs).count() == 0 and license_scan.scan(docs, {}).count() == 0


def test_license_notices_with_other_punctuation(spark):
    rng = random.Random(8)
    notices = [
        ("CC-BY-4.0", "Licensed under CC BY 4.0"), ("CC-BY-NC-4.0", "(licensed under CC BY-NC 4.0)"), ("MIT", "(Released under the MIT License)"),
        ("Apache-2.0", "Licensed under the Apache License, Version 2.0, see NOTICE"),
    ]
    docs = spark.createDataFrame([(i, f"{words(rng, 30)} {t} {words(rng, 30)}") for i, (_, t) in enumerate(notices)], "doc_id long, text string")
    assert {(r.doc_id, r.license) for r in license_scan.scan(docs).collect()} == {(i, n) for i, (n, _) in enumerate(notices)}


def test_license_scan_against_brute_force(spark):
    """Every window of every template's length, without sketches; edits of one word in seven lie near the bound."""
    rng = random.Random(18)
    texts = []
    for _ in range(120):
        t = rng.choice([x for xs in license_scan.TEMPLATES.values() for x in xs]).split()
        for _ in range(rng.randint(0, max(1, len(t) // 20))):
            t[rng.randrange(len(t))] = words(rng, 1)
        texts.append(f"{words(rng, rng.randint(0, 40))} {' '.join(t)} {words(rng, rng.randint(0, 40))}")
    t = license_scan.Templates(license_scan.TEMPLATES, 5, 80)
    want = set()
    for i, s in enumerate(shingles.in_order([license_scan._plain(x) for x in texts], 5)):
        for k, (own, n) in enumerate(zip(t.sets, t.words, strict=True)):
            step = max(1, n - 4)
            windows = (set(s[a : a + 2 * step].tolist()) for a in range(0, len(s), step))
            if any(100 * len(set(own.tolist()) & w) >= 80 * len(own) for w in windows):
                want.add((i, k))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.template) for r in license_scan.scan(docs).collect()}
    # a window of another template's length may find a template as well
    assert want <= got and len(want) > 80 and {i for i, _ in got} == {i for i, _ in want}


def contained(text: str, item: str, n: int = 5) -> float:
    import re

    cut = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    w, x = cut(text), cut(item)
    sh = lambda s: [" ".join(s[i : i + n]) for i in range(len(s) - n + 1)] if len(s) >= n else [" ".join(s)]
    b, best = sh(x), 0.0
    for s in range(max(0, len(w) - len(x) + 1)):
        a = sh(w[s : s + len(x)])
        best = max(best, sum(min(a.count(g), b.count(g)) for g in set(b)) / len(b))
    return best


def test_decontamination(spark, odd_docs, no_docs):
    rng = random.Random(6)
    items = [(k, words(rng, n)) for k, n in enumerate((3, 5, 12, 20, 40, 40, 59))] + [(7, ""), (8, None), (None, "no id here now at all"), (2, "x y")]
    texts = []
    for k, t in items[:7]:
        w = t.split()
        texts += [t, f"{words(rng, 30)} {t.upper()}, {words(rng, 30)}", f"{words(rng, 9)} {' '.join([*w[:-1], 'z'])} {words(rng, 9)}"]
        if len(w) > 30:
            texts += [f"{words(rng, 9)} {' '.join([*w[:15], 'other', *w[16:]])} {words(rng, 9)}", f"{' '.join(w[: len(w) // 2])} {words(rng, 60)}"]
    texts += [words(rng, 200) for _ in range(5)]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, items[4][1], "c")], "doc_id long, text string, at string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find(docs, bench).collect()}
    want = {(i, k): c for i, t in enumerate(texts) for k, x in items if k is not None and x for c in [contained(t, x)] if c >= 0.8}
    assert got == pytest.approx(want)
    assert decontaminate.remove(docs, decontaminate.find(docs, bench)).count() == docs.count() - len({i for i, _ in want})
    assert decontaminate.find(odd_docs, bench).count() == 0 and decontaminate.find(no_docs, bench).count() == 0 and decontaminate.find(docs, bench.limit(0)).count() == 0


def test_decontamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    docs = spark.createDataFrame([(1, "q w e r t y u i o p"), (2, "x w e r t y")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.find(docs, spark.createDataFrame([(5, "w e r t y u")], "item_id long, text string")).collect()] == [(1, 5)]


def test_decontamination_of_items_cut_to_the_threshold(spark):
    """The last fifth of the item's shingles is other text: words of their own, or one word again and again."""
    rng = random.Random(16)
    items = [(k, words(rng, 15 + k)) for k in range(45)]
    texts = []
    for k, x in items:
        w = x.split()
        keep = len(w) - (len(w) - 4) // 5
        texts += [(10 * k + j, f"{words(rng, 9)} {' '.join([*w[:keep], *tail[: len(w) - keep]])} {words(rng, 9)}") for j, tail in enumerate((words(rng, 60).split(), ["zz"] * 60))]
        texts += [(10 * k + 2 + j, f"{words(rng, 9)} {' '.join([*tail[: len(w) - keep], *w[len(w) - keep :]])} {words(rng, 9)}") for j, tail in enumerate((words(rng, 60).split(), ["zz"] * 60))]
        texts.append((10 * k + 4, f"{words(rng, 9)} {' '.join(w[: keep - 1])} {words(rng, 60)}"))
    found = decontaminate.find(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r.similarity for r in found}
    want = {(d, d // 10): c for d, t in texts for c in [contained(t, items[d // 10][1])] if c >= 0.8}
    assert len(want) == 4 * len(items) and got == pytest.approx(want)


def test_decontamination_of_texts_shorter_than_the_item(spark):
    rng = random.Random(26)
    items = [(k, words(rng, n)) for k, n in enumerate((2, 5, 6, 12, 40, 59))]
    cuts = [(k, t) for k, x in items for w in [x.split()] for t in (" ".join(w[1:]), " ".join(w[:-1]), " ".join(w[2:-2]), " ".join(w[: len(w) // 2]))]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cuts)], "doc_id long, text string")
    # the whole text as the window: padded to the item's length with words of no item
    want = {(i, k): c for i, (_, t) in enumerate(cuts) for k, x in items for c in [contained(" ".join([*t.split(), *["-zz"] * len(x.split())]), x)] if c >= 0.8}
    found = decontaminate.find(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.similarity for r in found} == pytest.approx(want)
    assert {(r.doc_id, r.word_at, r.n_words) for r in found} == {(i, 0, len(cuts[i][1].split())) for i, _ in want}
    assert {items[k][0] for _, k in want} == {3, 4, 5}


def test_decontamination_counts_every_window(spark):
    """Few different words, so shingles repeat in texts and items, and windows that no shared shingle aligns are the best ones."""
    rng = random.Random(36)
    some = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    items = [(k, some(rng.randint(3, 12))) for k in range(12)] + [(12, "a " * 30), (13, "a b " * 12)]
    texts = [(i, some(rng.randint(1, 90))) for i in range(20)] + [(20, "a " * 90), (21, "a " * 20 + "b " + "a " * 20)]
    for k, x in items[:6]:
        w = x.split()
        texts.append((30 + k, " ".join([*w[: len(w) // 2], "zz", *w[len(w) // 2 :]])))
    padded = lambda t, x: " ".join([*t.split(), *["-zz"] * (len(x.split()) - len(t.split()))])
    want = {(i, k): c for i, t in texts for k, x in items for c in [contained(padded(t, x), x)] if c >= 0.8}
    found = decontaminate.find(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.similarity for r in found} == pytest.approx(want) and len(want) > 60
    by = dict(texts)
    assert all(contained(padded(" ".join(by[r.doc_id].split()[r.word_at : r.word_at + r.n_words]), items[r.item_id][1]), items[r.item_id][1]) == pytest.approx(r.similarity) for r in found)


def test_decontamination_of_long_items_and_shared_passages(spark):
    rng = random.Random(46)
    long, passage = words(rng, 20_000), words(rng, 60)
    items = [(0, long)] + [(k, f"{words(rng, 6)} {passage} {words(rng, 6)}") for k in range(1, 120)]
    texts = [(0, f"x y {long} z"), (1, " ".join(long.split()[:15_000])), (2, f"{passage} " * 50), (3, items[7][1]), (3, items[8][1]), (3, items[7][1])]
    found = decontaminate.find(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): (r.similarity, r.word_at) for r in found}
    assert got[0, 0] == (1.0, 2) and got[3, 7] == (1.0, 0) and got[3, 8] == (1.0, 0)
    # the passage alone is 56 of 68 shingles
    assert set(got) == {(0, 0)} | {(d, k) for d in (2, 3) for k in range(1, 120)} and got[2, 1][0] == pytest.approx(56 / 68)


def test_multi_index_is_exact():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 256, (400, 32), np.uint8)
    codes[200:] = codes[:200] ^ np.packbits(rng.random((200, 256)) < 0.1, axis=1)
    index = ann.MultiIndex(codes)
    for radius in (0, 5, 31, 40, 90, 256):
        for q in range(0, 400, 37):
            d = ann.hamming(codes, np.repeat(codes[q : q + 1], 400, axis=0))
            assert index.within(codes[q], radius).tolist() == np.flatnonzero(d <= radius).tolist()


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 24)).astype(np.float32)
    x[50:90] = x[40]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, []), (2020, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [None] * 24), (2004, [1.0]), (None, [1.0] * 24), (3, x[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS rank")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == set(range(0, 900, 20))
    hits = 0
    for q, found in by.items():
        s = (x.astype(np.float64) * x[q].astype(np.float64)).sum(axis=1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(900), -s))[:20]
        hits += len(set(want.tolist()) & {v for _, v, _ in found})
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21))
        assert all(sc == s[v] for _, v, sc in found)
    assert hits >= 0.9 * 20 * len(by)
    assert [v for _, v, _ in sorted(by[40])] == list(range(50, 70))
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 1.0]), (20, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert ann.nearest(few, F.col("vec_id") % 20 == 0).count() == 4
    assert ann.nearest(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_recall_on_the_supplied_vectors(spark, have_tables):
    rows = common.table(spark, SF, "embeddings")
    got: dict[int, set[int]] = {}
    for r in ann.nearest(rows, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    data = [(r.vec_id, np.array(r.embedding, float)) for r in rows.collect() if r.embedding is not None]
    data = [(i, v) for i, v in data if len(v) == len(data[0][1]) and np.isfinite(v).all() and v.any()]
    ids, x = np.array([i for i, _ in data]), np.array([v for _, v in data])
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0).tolist():
        s = x @ x[q]
        s[q] = -np.inf
        best = set(ids[np.argsort(-s)[:20]].tolist())
        hits += len(best & got[int(ids[q])])
        total += len(best)
    assert hits / total >= 0.9


def test_components(spark):
    rng = random.Random(5)
    for n, m in ((200, 120), (300, 500)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(1000, 1040)]
        root = {v: v for e in edges for v in e}

        def find(v, root=root):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in edges:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        want = {v: find(v) for a, b in edges if a != b for v in (a, b)}
        got = components(spark.createDataFrame([*edges, (None, 3), (1, None)], "x long, y long"))
        assert {r.node: r.component for r in got.collect()} == want
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def brute_components(texts: list[tuple[int, str]], n: int, percent: int) -> dict[int, int]:
    import re

    def shingle(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])

    sets = [(i, shingle(t)) for i, t in texts]
    root = {i: i for i, _ in sets}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i, _ in sets}


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_dedup(spark, n, percent):
    """Chains, a large group of near copies that don't all link, exact copies, short texts."""
    rng = random.Random(n)
    base = words(rng, 60).split()
    texts = [" ".join(base)] * 30
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = words(rng, 1)
        texts.append(" ".join(w))
    w = list(base)
    for k in range(0, 60, 4):  # a chain away from the base
        w[k] = f"step{k}"
        texts.append(" ".join(w))
    texts += [words(rng, 50) for _ in range(60)] + ["", "  ", "One two", "one  TWO\n", "a", "x\xa0y", None]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS node", "1 AS component", "'k' AS kept")
    got = near_dedup.near_duplicates(docs, n, percent).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows, n, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for (i, _), s in zip(rows, shingles.shingle_sets(texts, n), strict=True)}


def test_repeated_ids_with_other_texts(spark):
    """An id links all its texts, whichever of them is near to what; an empty one goes with the others."""
    rng = random.Random(12)
    a, b = words(rng, 60), words(rng, 60)
    near = lambda t: " ".join(["changed", *t.split()[1:]])
    rows = [(5, a), (5, b), (9, near(b)), (11, near(a)), (11, ""), (3, words(rng, 60)), (20, words(rng, 50)), (20, words(rng, 50)), (20, None), (21, ""), (21, "")]
    for k in range(3):
        rng.shuffle(rows)
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(k + 1), 3, 85).collect()
        assert len(got) == len(rows)
        assert {(r.doc_id, r.component_id) for r in got} == {(5, 5), (9, 5), (11, 5), (3, 3), (20, 20), (21, 21)}


@pytest.mark.parametrize("block", [8, 40])
def test_large_buckets_of_unlike_texts(spark, monkeypatch, block):
    """Texts that share two thirds of their words and so many buckets, few of them linked: searched by rare shingles and in blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(block)
    base = words(rng, 100)
    texts = [f"{base} {words(rng, 25)}" for _ in range(100)]
    texts += [" ".join([*t.split()[:-2], "other", "end"]) for t in texts[::3]]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, ("text",)).collect()
    want = brute_components(rows, 3, 85)
    assert {r.doc_id: r.component_id for r in got} == want and len(set(want.values())) == 100
    assert {r.doc_id: r.text for r in got} == dict(rows)


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = spark.createDataFrame([(k % 3 if k < 90 else k, k) for k in range(100)], "key long, v long")
    side = rows.groupBy("key").count().where("key <> 1").withColumn("w", F.col("key") * 2)
    got = common.join_sized(rows, side, "key", "count", 100)
    assert sorted((r.key, r.v, r.w) for r in got.collect()) == sorted((r.key, r.v, 2 * r.key) for r in rows.collect() if r.key != 1)


def test_near_dedup_odd(odd_docs, no_docs):
    got = near_dedup.near_duplicates(odd_docs, 3, 85).collect()
    assert len(got) == 14
    by = {(r.doc_id, r.component_id) for r in got}
    assert {(7, 7), (8, 7), (9, 9), (10, 9), (0, 0), (1, 1), (None, None)} <= by
    assert [r.kept for r in got if r.doc_id is None] == [True]
    assert near_dedup.near_duplicates(no_docs).count() == 0
