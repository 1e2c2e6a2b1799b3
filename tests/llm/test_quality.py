"""Weak labels: EM on known labellers, held-out accuracy, and edge cases."""

import numpy as np
import pytest

from quoinlake.llm import quality
from quoinlake.llm.quality import fit_label_model, fit_scorer, hashed_features, quality_query, quality_stage, scored, shapes, train, votes

SF = "/root/testdata/sf0.01"


def test_em_finds_the_rates_of_known_labellers():
    r = np.random.default_rng(1)
    bad = r.random(40_000) < 0.2
    fires = [np.where(r.random(len(bad)) < np.where(bad, a, b), 0, 2) for a, b in ((0.6, 0.01), (0.4, 0.02), (0.5, 0.005))]
    given = np.where(r.random(len(bad)) < 0.3, np.where(bad, 0, 1), 2)
    rows, counts = np.unique(np.stack([*fires, given], 1), axis=0, return_counts=True)
    model = fit_label_model(rows, counts)
    assert (model.accuracy[:3, 0, 0] > 10 * model.accuracy[:3, 1, 0]).all()
    found = model.posterior(np.stack([*fires, given], 1)) > 0.5
    assert (found[given < 2] == bad[given < 2]).mean() > 0.97 and found[~bad].mean() < 0.05


def test_votes_on_kinds_of_text():
    texts = ["plain words make a sentence that says some thing new here", "again " * 40, "WORD AFTER WORD IN CAPITALS NOW!! " * 3,
             "a*** b&&& c$$$ d### e%%% f*** g&&& h$$$ i###", "", None, "you idiot and moron of a text that goes on some more"]
    q, t = votes(shapes(texts))
    assert (q[0] == 0).sum() == 0 and q[0, -1] == 1
    assert all((q[i] == 0).any() for i in (1, 2, 3, 4, 5))
    assert (t[6] == 0).all() and (t[:6] == 2).all()


def test_scorer_finds_the_feature_that_decides():
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    r = np.random.default_rng(0)
    texts = [" ".join(r.choice(words, 50)) + (" badword" if i % 5 == 0 else "") for i in range(500)]
    bad = np.array([float(i % 5 == 0) for i in range(500)])
    scorer = fit_scorer(hashed_features(texts[:400]), bad[:400])
    assert ((scorer.probability(hashed_features(texts[400:])) > 0.5) == bad[400:]).all()
    assert len(scorer.keys) < 100


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    half = labels.where("doc_id % 2 = 0")
    rows = scored(docs, train(docs, half)).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    clean = [r["keep"] for r in rows if r["quality"] == 1 and not r[5]]
    poor = [r["keep"] for r in rows if r["quality"] == 0]
    assert np.mean(clean) > 0.97 and np.mean(poor) < 0.25


def test_query_scores_every_row(spark, tables):
    got = quality_query(spark, SF).collect()
    assert len(got) == tables[0].count() and all(0 <= r["low_quality"] <= 1 for r in got)


def test_stage_keeps_columns_and_defined_cases(spark, tables, monkeypatch):
    docs, _ = tables
    extra = spark.createDataFrame(
        [(None, None, "en", "x", None), (-1, "", "en", None, 0), (-2, "again " * 60, "en", "x", 360), (0, "same id of its own text", "en", "x", 1)],
        docs.schema,
    )
    got = quality_stage(spark, docs.limit(200).unionByName(extra), SF)
    assert got.columns == docs.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert -1 not in ids and -2 not in ids and None not in ids and len(ids) > 100


def test_empty_tables(spark, tables):
    docs, labels = tables
    assert scored(docs.limit(0), train(docs.limit(0), labels.limit(0))).count() == 0
    assert scored(docs.limit(20), train(docs.limit(20), labels.limit(0))).count() == 20
    assert quality.SAMPLE_DOCS == 6000


def test_variety_reads_the_whole_text():
    head = " ".join(f"{a}{b}" for a in "abcdefghijklmnopqrstuvwxyzäöüßéè" for b in "abcdefghijklmnopqrstuvwxyzäöüßéè")
    junk = "the same few lines stand here once more. " * 3000
    texts = [head, f"{head} {junk}", f"{junk} {head}", f"{head} {junk} {head}", " ".join([head] * 20)]
    x = shapes(texts)["variety"]
    assert x[0] == 1 and x[4] == 1 and (x[1:4] < 0.25).all()
    q, _ = votes(shapes(texts))
    j = quality.QUALITY_LABELLERS.index("variety")
    assert (q[1:4, j] == 0).all() and (q[1:4, j + 3] != 1).all() and q[0, j] == q[4, j] == 2
