"""Quality classifier: Bradley-Terry ranking of documents by features of their text.

Pairs (better, worse) of labelled documents are drawn; the probability that one beats the other is
the logistic function of the difference of their scores, and a score is linear in the features, so
learning is logistic regression on feature differences. A quantile of the training scores becomes
the threshold.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Labelled documents that the fit sees at most, and pairs drawn from them.
MAX_LABELLED = 6_000
N_PAIRS = 60_000
RIDGE = 1e-3
#: The score at which a document is accepted.
CUT = 0.3

FEATURES = (
    "log_bytes", "log_words", "word_len", "upper", "digit", "symbol", "exclaim", "comma_stop", "non_ascii", "newline",
    "distinct_words", "top_word", "repeat_lines", "distinct_pairs", "symbol_words", "upper_words", "end_stop", "entropy",
    "longest_word", "line_words",
)

_KIND = np.zeros(256, np.int64)
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
for _c in b"#$%&*+/<=>@\\^_`{|}~[]":
    _KIND[_c] = 3
_KIND[ord("!")] = 4
for _c in b",.;:?":
    _KIND[_c] = 5
_KIND[128:] = 6
_KIND[ord("\n")] = 7
_SYMBOLS = frozenset("#$%&*+/<=>@\\^_`{|}~[]!")


def features(text: str | None) -> list[float]:
    """Statistics of the whole text; a null or empty text has its own constant ones."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(raw))
    hist = np.bincount(raw, minlength=256)
    kinds = np.bincount(_KIND, weights=hist, minlength=8) / n
    words = text.split()
    w = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    p = hist[hist > 0] / n
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), len(text) / w, kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7],
        len(counts) / w, max(counts.values(), default=0) / w, 1 - len(set(lines)) / max(1, len(lines)), pairs,
        sum(c for x, c in counts.items() if x[-1] in _SYMBOLS) / w, sum(c for x, c in counts.items() if x.isupper() and len(x) > 1) / w,
        float(text.rstrip()[-1:] in (".", "?", "!", '"')), float(-(p * np.log2(p)).sum()) if len(raw) else 0.0,
        np.log1p(max(map(len, counts), default=0)), np.log1p(len(words) / max(1, len(lines))),
    ]


def _expand(x: np.ndarray) -> np.ndarray:
    """The features and, for bounded ones, steep versions near zero, as small shares of junk matter most."""
    return np.hstack([x, np.tanh(20 * x[:, 3:17]), x[:, :2] ** 2])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (np.clip((_expand(x) - self.mean) / self.scale, -8, 8) * self.weight).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, with ``CUT`` at the threshold."""
        z = np.clip(self.raw(x) - self.threshold, -30, 30) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-z))


def fit_pairs(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """Bradley-Terry weights by Newton steps on pairs, and the threshold by score quantile.

    The threshold is the quantile of the training scores that the share of label 0 gives. With only
    one class there are no pairs: every score is then above (only label 1) or below the threshold.
    """
    e = _expand(x) if len(x) else np.zeros((0, len(FEATURES) + 16))
    if not len(e) or y.min() == y.max():
        only = bool(len(y)) and y.max() == 0
        k = e.shape[1]
        return Model(np.zeros(k), np.ones(k), np.zeros(k), 1.0 if only else -1.0)
    mean, scale = e.mean(axis=0), e.std(axis=0) + 1e-6
    z = np.clip((e - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(np.flatnonzero(y == 1), N_PAIRS)] - z[rng.choice(np.flatnonzero(y == 0), N_PAIRS)]
    w = np.zeros(z.shape[1])
    eye = np.eye(len(w))
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + (RIDGE + 1e-9) * eye, d.T @ p / len(d) - RIDGE * w)
        w += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    s = np.sort((z * w).sum(axis=1))
    k = int((y == 0).sum())
    return Model(mean, scale, w, float((s[k - 1] + s[k]) / 2))


def held_out(doc_id):
    """crc32 of the id as text, modulo 5, is 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        x = [list(map(float, features(t))) for t in b.column("text").to_pylist()]
        yield pa.record_batch([b.column("doc_id"), b.column("quality"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from labelled rows that are not held out.

    The sample is the ``max_labelled`` label rows with the smallest hash of their id (all, if fewer):
    a bound on what the driver gathers, documented and alike at every size. Labels other than 0 and 1
    and null ids are left out; of rows with one id the smallest text stands.
    """
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .select("doc_id", F.col("quality").cast("int").alias("quality"))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    got = rows.mapInArrow(_featured, "doc_id long, quality int, x array<double>").toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))[order]
    return fit_pairs(x, got.column("quality").to_numpy()[order])


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` with columns score (0 to 1) and predicted (1 from ``CUT`` on); every row gets both.

    ``keep`` names the columns to return beside them (default: all). A column of the input called
    score or predicted is replaced. Only ``text`` is an input of the score.
    """
    keep = tuple(c for c in (keep or docs.columns) if c not in ("score", "predicted"))
    held = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = np.array([features(t) for t in b.column(b.num_columns - 1).to_pylist()], float).reshape(-1, len(FEATURES))
            s = held.score(x) if len(x) else np.zeros(0)
            yield pa.record_batch([*b.columns[:-1], pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=[*b.schema.names[:-1], "score", "predicted"])

    source = docs.select(*keep, F.col("text").alias("__scored_text"))
    schema = source.drop("__scored_text").schema.add("score", "double").add("predicted", "integer")
    return source.mapInArrow(run, schema)
