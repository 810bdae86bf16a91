"""Vectorised pre-tokenisation and a table of pieces already encoded.

A batch of texts is one array of code points. The splitting pattern that the byte-level
vocabularies share (``public_tokenizers.PATTERN``) is evaluated on character classes with numpy;
each piece's 64-bit hash is looked up in an open-addressed table, and a hit counts only if all its
characters are equal, so a clash of hashes costs time but never a wrong id. Pieces not seen before go
to an encoder given by the caller.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import regex
import tiktoken

OTHER, LETTER, NUMBER, BLANK, SPACE, END = range(6)
SEP = 0x110000
#: Texts are split and looked up in groups of about so many characters, and longer texts are cut to this length.
GROUP_CHARS = 1 << 18
#: New pieces are gathered over about so many characters, then encoded together.
LEARN_CHARS = 1 << 21
#: Distinct pieces that are held at once; beyond it the table starts anew.
MAX_PIECES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _classes() -> np.ndarray:
    """Kinds of all code points as the tokenizer library's own tables have them: other libraries' Unicode versions differ."""
    table = np.zeros(SEP + 1, np.uint8)
    points = "".join(map(chr, (c for c in range(SEP) if not 0xD800 <= c < 0xE000)))
    single = {bytes([i]): i for i in range(256)}
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        # what the pattern doesn't match is left out
        match = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary
        for k in range(0, len(points), LEARN_CHARS >> 5):
            table[np.frombuffer(bytes(match(points[k : k + (LEARN_CHARS >> 5)])).decode().encode("utf-32-le"), np.uint32)] = kind
    table[ord(" ")] = BLANK
    table[SEP] = END
    return table


_TABLE: np.ndarray | None = None


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points with a separator after each, and the position of each separator."""
    sep = SEP.to_bytes(4, "little")
    raw = sep.join([t.encode("utf-32-le", "surrogatepass") for t in texts]) + sep
    cps = np.frombuffer(raw, np.uint32)
    return cps, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1


def split(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces that the pattern matches; every character but separators is in one."""
    global _TABLE
    if _TABLE is None:
        _TABLE = _classes()
    c = _TABLE[cps]
    white = (c == BLANK) | (c == SPACE)
    g = np.where(white, np.uint8(SPACE), c)
    run = np.ones(len(c), bool)
    run[1:] = g[1:] != g[:-1]
    first = run.copy()
    # a blank before a letter, number or other sign belongs to it
    first[1:] &= ~((c[:-1] == BLANK) & ~white[1:] & (c[1:] != END))
    # the last of several white space characters before such a sign stands apart
    last = np.flatnonzero(white[:-1] & ~white[1:] & (c[1:] != END))
    first[last] = True
    # contractions, where a piece starts with the apostrophe
    for p in np.flatnonzero((cps == 39) & first & ~np.append(False, c[:-1] == BLANK)).tolist():
        a, b = int(cps[p + 1]), int(cps[p + 2]) if p + 2 < len(cps) else SEP
        n = 2 if a in (115, 116, 109, 100) else 3 if (a, b) in ((114, 101), (118, 101), (108, 108)) else 0
        if n:
            first[p + 1] = False
            if n == 3:
                first[p + 2] = False
            first[p + n] = True
    first[c == END] = True
    start = np.flatnonzero(first)
    end = np.append(start[1:], len(cps))
    real = c[start] != END
    return start[real], end[real]


class PieceTable:
    """Ids of pieces. ``encode`` turns a list of new pieces into (ids of all, number for each)."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = MAX_PIECES):
        self.encode, self.limit = encode, limit
        self._power = np.ones(1, np.uint64)
        self._inverse = np.ones(1, np.uint64)
        self._clear()

    def _clear(self) -> None:
        self.size = 2 * self.limit
        self.key = np.zeros(self.size, np.uint64)
        self.code = np.full(self.size, -1, np.int32)
        self.n = 0
        self.chars = np.zeros(0, np.uint32)
        self.at = np.zeros(0, np.int64)
        self.len = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)
        self.id_at = np.zeros(0, np.int64)
        self.id_n = np.zeros(0, np.int32)

    def _powers(self, n: int) -> None:
        if len(self._power) < n:
            k = max(n, GROUP_CHARS + GROUP_CHARS // 4)
            with np.errstate(over="ignore"):
                self._power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(k, _BASE, np.uint64)]))
                self._inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(k, _BASE_INV, np.uint64)]))

    def _hash(self, cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self._powers(len(cps) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(cps) + 1, np.uint64)
            np.cumsum((cps.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)) * self._power[: len(cps)], out=total[1:])
            h = (total[end] - total[start]) * self._inverse[start]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        return h | np.uint64(1)

    def _find(self, h: np.ndarray) -> np.ndarray:
        mask = np.uint64(self.size - 1)
        slot = ((h >> np.uint64(1)) & mask).astype(np.int64)
        out = self.code[slot]
        left = np.flatnonzero((out >= 0) & (self.key[slot] != h))
        while len(left):
            slot[left] = (slot[left] + 1) & int(mask)
            out[left] = self.code[slot[left]]
            left = left[(out[left] >= 0) & (self.key[slot[left]] != h[left])]
        return out

    def _add(self, h: np.ndarray, code: np.ndarray) -> None:
        mask = self.size - 1
        slot = ((h >> np.uint64(1)) & np.uint64(mask)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self.code[slot[left]] < 0]
            self.code[slot[free]] = code[free]  # of several for one slot the last one stands
            won = free[self.code[slot[free]] == code[free]]
            self.key[slot[won]] = h[won]
            lost = np.ones(len(h), bool)
            lost[won] = False
            left = left[lost[left]]
            slot[left] = (slot[left] + 1) & mask

    def _learn(self, cps: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> None:
        new = [cps[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        ids, n = self.encode(new)
        self.at = np.append(self.at, len(self.chars) + np.cumsum(end - start) - (end - start))
        self.len = np.append(self.len, (end - start).astype(np.int32))
        self.chars = np.append(self.chars, _spans(cps, start, end - start))
        self.id_at = np.append(self.id_at, len(self.ids) + np.cumsum(n) - n)
        self.id_n = np.append(self.id_n, n.astype(np.int32))
        self.ids = np.append(self.ids, ids.astype(np.uint32))
        self._add(h, np.arange(self.n, self.n + len(h), dtype=np.int32))
        self.n += len(h)

    def _group(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cps, ends = code_points(texts)
        start, end = split(cps)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        h = self._hash(cps, start, end)
        code = self._find(h)
        miss = np.flatnonzero(code < 0)
        if len(miss):
            _, at = np.unique(h[miss], return_index=True)
            if self.n + len(at) > self.limit:
                if len(np.unique(h)) > self.limit:  # one group with more distinct pieces than the table holds
                    self.limit = 1 << int(len(h)).bit_length()
                self._clear()
                miss = np.arange(len(h))
                _, at = np.unique(h, return_index=True)
            at = miss[at]
            self._learn(cps, start[at], end[at], h[at])
            code[miss] = self._find(h[miss])
        length = end - start
        n = self.id_n[code].astype(np.int64)
        same = self.len[code] == length
        if not same.all() or not np.array_equal(_spans(self.chars, self.at[code], length), _spans(cps, start, length)):
            return self._slow(cps, start, end, ends)
        ids = _spans(self.ids, self.id_at[code], n)
        return ids, np.diff(np.append(0, np.append(0, np.cumsum(n))[np.searchsorted(start, ends)]))

    def _slow(self, cps: np.ndarray, start: np.ndarray, end: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two pieces of the group or the table share a hash: encode every piece of the group by itself."""
        new = [cps[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        ids, n = self.encode(new)
        return ids.astype(np.uint32), np.diff(np.append(0, np.append(0, np.cumsum(n))[np.searchsorted(start, ends)]))

    def encode_texts(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For consecutive groups of texts: all their ids, and the number of ids of each text.

        A long text is cut before white space that follows another character, where a piece always starts.
        """
        for run in _groups(texts, LEARN_CHARS):
            parts = [(k, p) for k, t in enumerate(run) for p in _cut_text(t)]
            groups = list(_groups(parts, GROUP_CHARS, lambda x: len(x[1])))
            if len(groups) > 1:
                self._learn_all([[p for _, p in g] for g in groups])
            ids, counts = [], np.zeros(len(run), np.int64)
            for g in groups:
                found, n = self._group([p for _, p in g])
                ids.append(found)
                np.add.at(counts, [k for k, _ in g], n)
            yield np.concatenate(ids), counts

    def _learn_all(self, groups: list[list[str]]) -> None:
        """Encode what the table misses of all groups in one call; what doesn't fit is left to each group."""
        spans, hashes = [], []
        for g in groups:
            cps, _ = code_points(g)
            start, end = split(cps)
            if len(start):
                h = self._hash(cps, start, end)
                miss = np.flatnonzero(self._find(h) < 0)
                _, at = np.unique(h[miss], return_index=True)
                at = miss[at]
                length = end[at] - start[at]
                spans.append((_spans(cps, start[at], length), length))
                hashes.append(h[at])
        if not hashes:
            return
        cps, length = np.concatenate([x for x, _ in spans]), np.concatenate([x for _, x in spans])
        h, at = np.unique(np.concatenate(hashes), return_index=True)
        start = (np.cumsum(length) - length)[at]
        if len(h) > self.limit:
            return
        if self.n + len(h) > self.limit:
            self._clear()
        if len(h):
            self._learn(cps, start, start + length[at], h)


_CUT = regex.compile(r"(?<=\S)\s")


def _cut_text(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > GROUP_CHARS and (m := _CUT.search(text, at + GROUP_CHARS)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def _groups(xs: list, chars: int, size: Callable = len) -> Iterator[list]:
    group: list = []
    total = 0
    for x in xs:
        if group and total + size(x) > chars:
            yield group
            group, total = [], 0
        group.append(x)
        total += size(x)
    if group:
        yield group


def _spans(values: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """values[a : a + k] for each a, k, one after another."""
    total = np.cumsum(n)
    return values[np.repeat(at - (total - n), n) + np.arange(total[-1] if len(total) else 0)]
