from __future__ import annotations

import html
import zlib

import numpy as np

from cordon.llm import html_extract, quality
from cordon.llm.common import table

from .conftest import SF


def test_quality_held_out(spark, have_tables):
    sf = SF.replace("0.001", "0.01")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.fit(docs, labels)
    rows = quality.score(docs.join(labels, "doc_id"), model, ("doc_id", "quality")).toPandas()
    out = rows[[zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]]
    assert len(out) > 30 and ((out.score >= 0.3) == (out.predicted == 1)).all() and out.score.between(0, 1).all()
    assert (out.predicted == out.quality).mean() >= 0.95
    again = quality.fit(docs.repartition(3), labels.repartition(2))
    assert np.allclose(again.weight, model.weight) and again.threshold == model.threshold


def test_quality_odd(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 1), (5, None, 0), (6, 7, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    for fitted in (labels, labels.where("quality = 0"), labels.limit(0)):
        model = quality.fit(odd_docs, fitted, max_labelled=10)
        rows = quality.score(odd_docs, model).collect()
        assert len(rows) == 14 and all(0 <= r.score <= 1 for r in rows)
        assert quality.score(no_docs, model).count() == 0


def test_bradley_terry_orders_by_the_useful_feature():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, len(quality.FEATURES)))
    y = (x[:, 4] + 0.1 * rng.normal(size=600) > -1).astype(int)
    m = quality.fit_pairs(x, y)
    assert ((m.score(x) >= quality.CUT) == (y == 1)).mean() > 0.97


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header class="site-header"><h2>Site</h2></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies.</p></div><div class="ad">Buy now</div>
<article><h1>Title&nbsp;one &amp; two</h1><p>First   <b>bold</b>
line.<br>Second line<p>An unclosed paragraph of some length, as it is.<aside class="sidebar"><p>Related things</p></aside><ul><li>item one here</li></ul></article>
<section class="comments"><h3>Comments</h3><p>Nice one!</p></section><form><label>Mail</label><button>Subscribe</button></form>
<footer>&copy; someone</footer></body></html>"""


def test_extraction(spark):
    model = html_extract.fit()
    assert html_extract.main_text(PAGE, model) == "Title one & two First bold line. Second line An unclosed paragraph of some length, as it is. item one here"
    wrong = total = 0
    for page, y in html_extract.labelled_pages(100, seed=77):
        got = model.viterbi([html_extract.features(b) for b in html_extract.blocks(page)])
        total += len(y)
        wrong += sum(a != b for a, b in zip(got, y, strict=True))
    assert wrong / total < 0.03
    odd = [None, "", "plain", "<", "<p", "&#x110000; &am &#0;", "<div>" * 300 + "deep", PAGE, PAGE, "<article><p>" + "long text. " * 20000]
    df = spark.createDataFrame([(i, "u", h, "t") for i, h in enumerate(odd)], "page_id long, url string, html string, text string")
    rows = {r.page_id: r for r in html_extract.extract(df, model).collect()}
    assert len(rows) == len(odd) and rows[0].text == rows[1].text == "" and rows[7].text == rows[8].text
    assert rows[9].text == ("long text. " * 20000).strip() and all(r.n_chars == len(r.text) for r in rows.values())
    assert html_extract.extract(df.limit(0), model).count() == 0


def test_viterbi_is_the_best_path():
    model = html_extract.fit(html_extract.labelled_pages(30))
    rng = np.random.default_rng(3)
    names = list(model.index)
    for n in range(1, 7):
        page = [[names[int(rng.integers(len(names)))] for _ in range(3)] for _ in range(n)]
        u = model.potentials(page)
        value = lambda y: sum(u[i, s] for i, s in enumerate(y)) + sum(model.moves[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731, B905
        best = max(value([k >> i & 1 for i in range(n)]) for k in range(2**n))
        assert abs(value(model.viterbi(page)) - best) < 1e-9


def test_pages_of_the_tables(spark, have_tables):
    import re

    model = html_extract.fit()
    for r in html_extract.extract(table(spark, SF, "pages"), model, ("page_id", "html")).collect():
        inner = re.sub(r"</?b>", "", r.html[r.html.index("<article>") : r.html.index("</article>")])
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())


def test_hidden_elements_plain_pages_and_reader_comments():
    """Pages unlike the tables' template: divisions only, what browsers don't show, comments under another name."""
    prose = "The committee met on Tuesday to talk about the budget of the coming year, and it was agreed that the roads should be mended before winter, as had been promised."
    model = html_extract.fit()
    assert html_extract.main_text(f"<html><body><div><div>{prose}</div><div>{prose}</div></div></body></html>", model) == f"{prose} {prose}"
    junk = "<p hidden>secret</p><p style='display: none'>gone</p><p aria-hidden='true'>x</p><div class='feedback'><p>I like it, thanks for writing.</p></div>"
    assert html_extract.main_text(f"<article><p>{prose}</p>{junk}</article>", model) == prose


def test_deep_nesting_is_linear():
    """100,000 open elements, of one name, of many class words, of elements that ends are looked for through: seconds and under 100 MB."""
    import time
    import tracemalloc

    model = html_extract.fit(html_extract.labelled_pages(30))
    n = 100_000
    pages = ["<div>" * n + "deep", "".join(f"<div>w{i}" for i in range(n)), "".join(f"<div class='c{'abcdefghij'[i % 10] * (i % 40)}'>w" for i in range(n)), "<p><select>" + "<i><h1>x" * (n // 2), "<div>" * n + "</b>x" * n]
    for page in pages:
        began = time.monotonic()
        assert len(html_extract.main_text(page, model)) >= 0
        assert time.monotonic() - began < 30
    tracemalloc.start()
    html_extract.main_text(pages[1], model)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_shared_ancestors_add_up_as_all_features():
    model = html_extract.fit(html_extract.labelled_pages(30))
    for page, _ in html_extract.labelled_pages(40, seed=5):
        found = html_extract.blocks(page)
        assert model.label(found) == model.viterbi([html_extract.features(b) for b in found])
