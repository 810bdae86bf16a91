"""Clusters, shards and the audit against brute force, on odd and empty tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cordon.llm import ball_kmeans, filter_audit, kd_shards


def k_means(rows, k, rounds, seed, dims):
    b = ball_kmeans.COMPONENT
    kept = [(i, [max(-b, min(b, math.floor(Fraction(x) * 1024))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest()))
    c = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        mine = [near(v)[1] for _, v in kept]
        groups = [[v for (_, v), g in zip(kept, mine, strict=True) if g == j] for j in range(len(c))]
        c = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else m for g, m in zip(groups, c, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    cap = lambda n: min(n, (1 << 63) - 1)
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, j, cap(d), cap(sum(cap(x) for _, x, y in found if y == j)), cap(sum(cap(x) for _, x, _ in found)), sha[j]) for i, d, j in found), key=str)


@pytest.mark.parametrize("factor", [1, 1e7, 1e300])
def test_clusters_are_those_of_comparing_all(spark, factor):
    rng = random.Random(5)
    spots = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(9)]
    rows = [(i, [factor * (x + rng.gauss(0, 0.3)) for x in spots[i % 9]]) for i in range(300)]
    rows += [(300 + i, [0.0, 0.5, 0.0, 0.0, float(i % 2)]) for i in range(60)]  # ties and copies
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (400, None), (401, []), (402, [1.0]), (403, [None] * 5), (404, [float("nan")] + [0.0] * 4), (405, [float("inf")] + [0.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cluster", "'d' AS distance", "2 AS ids", "3 AS x").repartition(5)
    got = ball_kmeans.cluster(df, k=6, rounds=4, dims=5)
    # equal ids with different vectors: none of them is among the first centroids here
    assert sorted(map(tuple, got.collect()), key=str) == k_means(rows, 6, 4, 3, 5)


def test_pruned_assignment_with_ties():
    rng = np.random.default_rng(3)
    for wide in (4, 1 << 40):
        x, c = rng.integers(-wide, wide, (500, 3)), rng.integers(-wide, wide, (12, 3))
        c[5] = c[2]
        d = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(axis=2)
        want = [min((v, j) for j, v in enumerate(row)) for row in d.tolist()]
        best, dist = ball_kmeans.assign(x, rng.integers(0, 12, 500).astype(np.int32), c)
        assert [(int(v), j) for v, j in zip(dist.tolist(), best.tolist(), strict=True)] == want


def test_few_vectors_and_none(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "vec_id long, embedding array<float>")
    assert {(r.vec_id, r.distance) for r in ball_kmeans.cluster(df, dims=2).collect()} == {(1, 0), (2, 0)}
    assert ball_kmeans.cluster(df.limit(0), dims=2).count() == 0
    assert ball_kmeans.cluster(df, dims=64).count() == 0


def by_tree(rows, shards):
    """Row by row: (id, size, coordinates, digest, place); lists of places for each shard."""
    wide = [max(1, max(r[2][j] for r in rows) - min(r[2][j] for r in rows)) for j in range(3)]

    def split(part, m):
        if m == 1 or not part:
            return [part] + [[]] * (m - 1)
        share = [(max(r[2][j] for r in part) - min(r[2][j] for r in part)) / wide[j] for j in range(3)]
        d = share.index(max(share))
        part = sorted(part, key=lambda r: (r[2][d], r[3], r[0], r[4]))
        target = sum(r[1] for r in part) * (m // 2) // m
        upto = list(itertools.accumulate(r[1] for r in part))
        n = sum(2 * u - r[1] <= 2 * target for u, r in zip(upto, part, strict=True))
        return split(part[:n], m // 2) + split(part[n:], m - m // 2)

    return split(rows, shards)


@pytest.mark.parametrize("shards,ordered", [(16, 20_000), (7, 3), (1, 5), (40, 1)])
def test_shards_are_those_of_sorting(spark, monkeypatch, shards, ordered):
    """Also where no bin is ever small, so that ties go down to the row's place."""
    monkeypatch.setattr(kd_shards, "ORDERED", ordered)
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc é") for _ in range(rng.randrange(60))) for _ in range(25)] + [None, "", "x" * 4000]
    docs = [(i if i % 11 else None, t, rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "b", "a" * 20]), rng.choice([None, len(t or "")])) for i in range(260) for t in [rng.choice(texts)]]
    docs += [(5, "same", "en", "hot", 4)] * 120
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS size", "'s' AS shard", "2 AS slot", "3 AS row").repartition(3).cache()
    got = kd_shards.assign(df, shards=shards, keep={"doc_id": F.col("doc_id"), "crc": F.crc32(F.coalesce("text", F.lit("")))}).collect()
    low = -(1 << 61)
    code = lambda s: -1 if s is None else int(s.encode()[:7].hex().ljust(14, "0"), 16)
    place = df.select("*", F.monotonically_increasing_id().alias("place")).collect()
    rows = [
        (low if r.doc_id is None else r.doc_id, len((r.text or "").encode()) + 1, (low if r.n_chars is None else r.n_chars, code(r.lang), code(r.source)),
         int(hashlib.md5((r.text or "").encode()).hexdigest()[:15], 16), r.place, (r.doc_id, zlib.crc32((r.text or "").encode())))
        for r in place
    ]
    want = Counter()
    for s, part in enumerate(by_tree(rows, shards)):
        for k, r in enumerate(sorted(part, key=lambda r: (r[0], r[4]))):
            want[*r[5], r[1], s, k] += 1
    assert Counter(map(tuple, got)) == want


def test_shards_hold_near_equal_bytes_and_files_hold_all(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, "x" * int(rng.lognormvariate(5, 1)), "en", "hot" if i % 3 else f"s{i % 50}", i % 9) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sizes = [r.n for r in kd_shards.assign(df, shards=16).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 8 * max(len(t) + 1 for _, t, *_ in rows)
    total = sum(sizes)
    path = kd_shards.write_shards(df, str(tmp_path / "out"), target_bytes=total // 5)
    back = spark.read.parquet(path)
    assert back.select("shard").distinct().count() == 6 and sorted(map(tuple, back.select(*df.columns).collect())) == sorted(rows)


def test_no_shards_without_rows(no_docs):
    assert kd_shards.assign(no_docs, shards=16).count() == 0
    with pytest.raises(ValueError):
        kd_shards.assign(no_docs)


def test_bill_of_the_tree_reads_no_text(spark):
    """Tree passes read the narrow columns of the written table only."""
    df = spark.createDataFrame([(1, "a", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = kd_shards.keyed(df, ("n_chars",), keep={"doc_id": F.col("doc_id")})
    assert "text" not in rows.columns


def test_audit_against_brute_force(spark, odd_docs, odd_texts):
    rng = random.Random(8)
    some = [" ".join(rng.choice(["a", "B", "c$", "DD", "e\x85f", "g\x1ch"]) for _ in range(rng.choice([3, 99, 100, 140]))) for _ in range(20)] + ["w%d" % i for i in range(3)]
    some += [" ".join(f"u{i}" for i in range(n)) for n in (99, 100, 101)] + ["A" * 10 + "b" * 90, "A" * 11 + "b" * 89, "\U0001d400" * 99]
    rows = [(i, rng.choice(some), rng.choice([None, "", "en"])) for i in range(80)] + [(3, some[0], "en"), (3, some[0], "en"), (None, some[0], "de"), (None, None, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").unionByName(odd_docs.withColumn("doc_id", F.col("doc_id") + 1000), allowMissingColumns=True).withColumn("row", F.lit(1)).withColumn("word", F.lit("w"))
    rows += [(None if r.doc_id is None else r.doc_id + 1000, r.text, r.lang) for r in odd_docs.collect()]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 60)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (9999, 1, 1), (61, None, None)]
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    least: dict = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    failed = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        marks = [(q, x) for j, q, x in labels if j == i and i is not None]
        failed.append((lang or "", {k for k, v in f.items() if v}, any(q == 1 for q, _ in marks), any(x == 1 for _, x in marks)))
    want = []
    for part in {p for p, *_ in failed}:
        mine = [x for x in failed if x[0] == part]
        each = []
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, own in enumerate(order):
                gone = set(order[:k])
                first = [x for x in mine if own in x[1] and not x[1] & gone]
                each.append((part, order, k + 1, sum(not x[1] & (gone | {own}) for x in mine), len(first), sum(own in x[1] and bool(x[1] & gone) for x in mine), sum(x[1] == {own} for x in mine), sum(x[2] for x in first), sum(x[3] for x in first)))
        shapley = Counter()
        for e in each:
            shapley[e[1][e[2] - 1]] += e[4]
        want += [(*e, shapley[e[1][e[2] - 1]]) for e in each]
    assert sorted(map(tuple, got)) == sorted(want)


def test_audit_of_nothing(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(no_docs, labels).count() == 0
    assert filter_audit.audit(spark.createDataFrame([(1, None)], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")), labels).count() == 600
