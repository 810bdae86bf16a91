"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

A template of n shingles is looked for in windows of 2n consecutive shingles that overlap by half, so each
stretch as long as the template lies whole in one of them. A window that holds the share ``percent`` of
the template has at least a Jaccard similarity of percent / (300 - percent) with it, and the banding is chosen
for that similarity. The exact containment of the template's shingles in the window decides. Windows
without any template's shingle can't hold a template and are not sketched.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .near_dedup import MISS, _family, band_keys, signature
from .shingles import in_order, ordered

#: Notices that name a license, and the texts of short ones, by identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal "
        "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF "
        "ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
        "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
        "notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
        "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
        "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "LGPL-3.0": ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",),
    "AGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}


_BETWEEN = re.compile(r"[\W_]+")


def _plain(text: str | None) -> str:
    """Runs of letters and digits with one space between them."""
    return _BETWEEN.sub(" ", text or "")


class Templates:
    """Templates' shingle sets and the bands that retrieve them; their number is a parameter, not data."""

    def __init__(self, templates: dict[str, tuple[str, ...]], n_words: int, percent: int):
        self.n_words, self.percent = n_words, percent
        self.names = [name for name, texts in templates.items() for _ in texts]
        raw = [_plain(t).encode().lower() for texts in templates.values() for t in texts]
        self.sets = [np.unique(s) for s in ordered(raw, n_words)] if raw else []
        self.words = [len(b.split()) for b in raw]
        # two rows to a band, and so many bands that a window right at the bound is missed with probability ``MISS`` at most
        self.rows = 2
        self.bands = math.ceil(math.log(MISS) / math.log(1 - (percent / (300 - percent)) ** self.rows))
        self.a, self.b = _family(self.bands * self.rows)
        self.known = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)
        self.by_band: dict[int, list[int]] = {}
        for k, s in enumerate(self.sets):
            for key in band_keys(signature(s, self.a, self.b), self.bands, self.rows).tolist():
                self.by_band.setdefault(key, []).append(k)
        #: Window lengths in shingles: twice each template's.
        self.lengths = sorted({2 * max(1, w - n_words + 1) for w in self.words})

    def matches(self, shingles: np.ndarray) -> list[tuple[int, float, int]]:
        """(template, containment, first word of the window) for a document's shingles in order; the best window of each."""
        hits = np.flatnonzero(np.isin(shingles, self.known))
        best: dict[int, tuple[float, int]] = {}
        for length in self.lengths:
            step = length // 2
            # windows that hold a known shingle; a hit lies in two of them
            first = hits // step
            for w in np.unique(np.concatenate([first, np.maximum(first - 1, 0)])).tolist():
                s = np.unique(shingles[w * step : w * step + length])
                sig = signature(s, self.a, self.b)
                found = {k for key in band_keys(sig, self.bands, self.rows).tolist() for k in self.by_band.get(key, ())}
                for k in found:
                    t = self.sets[k]
                    common = int(np.isin(t, s).sum())
                    if 100 * common >= self.percent * len(t) and common / len(t) > best.get(k, (0.0, 0))[0]:
                        best[k] = common / len(t), w * step
        return [(k, c, p) for k, (c, p) in sorted(best.items())]


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, n_words: int = 5, percent: int = 80) -> DataFrame:
    """A row for each document and template found: doc_id, license, template (its number), containment, word_at (of the window).

    Words are runs of letters and digits, so punctuation plays no part; shingles are as in near-dedup. Null and empty texts match nothing; a template of fewer words than
    ``n_words`` is one shingle, found only as a whole text. Repeated rows are scanned each; only doc_id and text are read.
    """
    t = Templates(TEMPLATES if templates is None else templates, n_words, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, rows = b.column("doc_id").to_pylist(), []
            for d, s in zip(ids, in_order([_plain(x) for x in b.column("text").to_pylist()], n_words), strict=True):
                rows += [(d, t.names[k], k, c, p) for k, c, p in t.matches(s)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "license", "template", "containment", "word_at"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, template int, containment double, word_at long")


def licenses(found: DataFrame) -> DataFrame:
    """One row for each document and license: its best containment."""
    return found.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"))
