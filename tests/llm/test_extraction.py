"""Main text: hand-written pages, held-out accuracy, and the chain model against enumeration."""

import html
import itertools
import random

import numpy as np
import pytest

from quoinlake.llm.crf import ChainCRF, likelihood
from quoinlake.llm.dom import blocks
from quoinlake.llm.extraction import (
    extract, extraction_query, label_by_markup, laid_out, path_features, sample_pages, text_features, train,
)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return train(sample_pages(spark.read.parquet(f"{SF}/pages.parquet"), "page_id", "html"))


def test_blocks_of_broken_markup():
    page = (
        '<!doctype html><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script><!-- <p>no</p> -->'
        '<div class="a>b"><p>One <b>t</b>wo&amp;\n three<p>Four<br>five &lt;&nbsp;6</div>7 < 8 <ul><li>x<li>y</ul><!-- open <p>no'
    )
    assert [b.text for b in blocks(page)] == ["One two& three", "Four", "five < 6", "7 < 8", "x", "y"]
    assert blocks("") == [] and blocks("<p><!--") == [] and [b.text for b in blocks("a<b")] == ["a<b"]
    assert len(blocks("<p>" * 20000 + "x" + "<" * 20000)) >= 1


def test_viterbi_is_the_best_of_all_paths():
    r = np.random.default_rng(2)
    for n in range(1, 7):
        crf = ChainCRF()
        crf.start, crf.between = r.normal(size=2), r.normal(size=(2, 2))
        emit = r.normal(size=(n, 2)).tolist()
        best = max(itertools.product(range(2), repeat=n), key=lambda p: likelihood(crf, emit, p))
        assert tuple(crf.decode(emit)) == best


def test_training_raises_the_likelihood_of_the_truth():
    pages = [[["a"], ["b"], ["a"]], [["b"], ["b"]], [["a"]]]
    truth = [[1, 0, 1], [0, 0], [1]]
    crf = ChainCRF().fit(pages, truth, rounds=100)
    assert [crf.decode([crf.score(f) for f in p]) for p in pages] == truth


def decoded(model, page):
    found = blocks(page)
    emit = [[a + b for a, b in zip(model.score(path_features(b.path)), model.score(text_features(b)))] for b in found]
    return found, model.decode(emit)


def test_layouts_that_training_has_not_seen(model, spark):
    pages = [r[0] for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    r, wrong, total = random.Random(5), 0, 0
    for page in pages[:60]:
        found = blocks(page)
        side = [html.escape(b.text) for b in found if not label_by_markup(b)]
        main = [html.escape(b.text) for b in found if label_by_markup(b)]
        text, expected = laid_out(main, side, r)
        got = decoded(model, text)[1]
        wrong += sum(a != b for a, b in zip(got, expected))
        total += len(expected)
    assert wrong / total < 0.03


def test_a_page_of_another_kind(model):
    page = (
        '<body><header><h1>Site</h1></header><div id="cookie-bar" class="notice">We use cookies.</div><nav><a href=1>Home</a></nav>'
        '<main><article><h1>Head &amp; line</h1><p>One <b>two</b> three.</p><aside>Related: more</aside><p>Four.</p>'
        '<form><label>Mail</label></form><section class="comments"><h2>Comments</h2><p>I like it.</p></section></article></main>'
        '<div class="sidebar">Popular</div><div class="ad">Buy.</div><footer>© 2025</footer>'
    )
    found, labels = decoded(model, page)
    assert " ".join(b.text for b, y in zip(found, labels) if y) == "Head & line One two three. Four."


def test_query_gives_whole_articles(spark):
    rows = {r["page_id"]: r for r in extraction_query(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        want = " ".join(b.text for b in blocks(p["html"]) if label_by_markup(b))
        assert (rows[p["page_id"]]["text"], rows[p["page_id"]]["n_chars"]) == (want, len(want))


def test_nulls_repeats_clashes_and_no_rows(spark, model):
    df = spark.createDataFrame(
        [(1, None, "u", 1), (1, "", None, 2), (None, "<article><p>x y.</p></article>", "u", 3)],
        "page_id long, html string, url string, text int",
    )
    got = extract(df, "page_id", "html", model, ("url",)).collect()
    assert sorted((r["text"], r["n_chars"]) for r in got) == [("", 0), ("", 0), ("x y.", 4)]
    assert extract(df.limit(0), "page_id", "html", model).count() == 0
    assert train([]).decode([]) == []
