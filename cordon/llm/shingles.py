"""Distinct word shingles of whole texts as sets of 64-bit hashes, computed with numpy for batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are hashed in groups of about so many bytes; a longer text is a group of its own.
GROUP_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_ODD = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        k = max(n, GROUP_BYTES + GROUP_BYTES // 4)
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(k, x, np.uint64)])) for x in (_BASE, inverse))  # type: ignore[assignment]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(_ODD[0])
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(_ODD[1])
    return h ^ (h >> np.uint64(31))


def ordered(raw: list[bytes], n: int) -> list[np.ndarray]:
    """Each lower-cased text's shingle hashes, one for each position."""
    b = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.diff(np.append(True, space).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    ends = np.cumsum([len(x) + 1 for x in raw])
    first = np.searchsorted(start, np.append(0, ends[:-1]))
    last = np.append(first[1:], len(start))
    with np.errstate(over="ignore"):
        power, inverse = _power(len(b) + 1)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)) * power[: len(b)], out=total[1:])
        words = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
        if len(words) >= n:
            k = len(words) - n + 1
            shingle = np.zeros(k, np.uint64)
            for i in range(n):
                shingle = (shingle + words[i : i + k]) * np.uint64(_ODD[i % len(_ODD)] + 2 * (i // len(_ODD)))
            shingle = mix(shingle)
        out = []
        for x, y in zip(first.tolist(), last.tolist(), strict=True):
            if y - x >= n:
                out.append(shingle[x : y - n + 1])
            elif y > x:
                h = np.zeros(1, np.uint64)
                for w in words[x:y]:
                    h = (h + w) * np.uint64(_ODD[2])
                out.append(mix(h + np.uint64(y - x)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def in_order(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """Each text's shingle hashes by position; see ``shingle_sets``."""
    group: list[bytes] = []
    size = 0
    for t in texts:
        b = (t or "").encode("utf-8", "surrogatepass").lower()
        if group and size + len(b) > GROUP_BYTES:
            yield from ordered(group, n)
            group, size = [], 0
        group.append(b)
        size += len(b) + 1
    if group:
        yield from ordered(group, n)


def shingle_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes.

    A-Z are lower-cased; words are runs of other characters than U+0020 and U+0009 to U+000D. A text of
    fewer than ``n`` words has its whole sequence as one shingle; one without words, or null, has none.
    """
    return map(np.unique, in_order(texts, n))
