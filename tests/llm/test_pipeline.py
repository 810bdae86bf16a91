from __future__ import annotations

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import tiktoken

from cordon.llm import bpe, quality
from cordon.llm.common import table

from .conftest import SF
from .test_search import brute_components, contained


def test_pipeline_against_brute_force(spark, have_tables):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    labels = table(spark, SF, "labels")
    model = quality.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    x = np.array([quality.features(t) for t in texts.values()])
    kept = [i for i, ok in zip(texts, model.score(x) >= quality.CUT, strict=True) if ok]
    root = brute_components([(i, texts[i]) for i in kept], 5, 80)
    kept = [i for i in kept if root[i] == i]
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    kept = [i for i in kept if not any(t[:40] in texts[i] or contained(texts[i], t) >= 0.8 for t in items if any(w in texts[i] for w in t.split()[:3]))]
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(kept)
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert all(r.round_trip and np.frombuffer(r.ids, "<u4").tolist() == encoding.encode_ordinary(texts[r.doc_id]) for r in rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == columns


def test_stages_on_odd_rows(spark, odd_docs, no_docs, have_tables):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert name == "byte_bpe" or out.columns == docs.columns
            assert out.count() <= docs.count()


def test_stages_keep_a_column_of_the_row_numbers_name(spark, have_tables):
    docs = spark.createDataFrame([(1, "a b c d e f g", 7), (2, "a b c d e f g", 8), (None, "other words than those of before", 9)], "doc_id long, text string, __row long")
    for stage, want in ((corpus_pipeline.near_dedup_stage, [7, 9]), (corpus_pipeline.decontaminate_stage, [7, 8, 9])):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and sorted(r["__row"] for r in out.collect()) == want
