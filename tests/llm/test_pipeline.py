"""The pipeline against its operators run one by one in plain form."""

import hashlib

import corpus_pipeline
from quoinlake.llm.decontaminate import matches
from quoinlake.llm.pieces import decode, vocabulary
from quoinlake.llm.quality import scored, train
from quoinlake.llm.pii import redact, with_spans
from tests.llm.test_decontaminate import plain
from tests.llm.test_jaccard import brute

SF = "/root/testdata/sf0.001"


def test_stages_in_order_and_result(spark):
    assert [f.__module__.rsplit(".", 1)[1] for _, f in corpus_pipeline.STAGES] == ["quality", "jaccard", "decontaminate", "pii", "pieces"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    keep = {r["doc_id"] for r in scored(docs, model).where("keep").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in keep]
    rows = [x for x in rows if x[0] in {d for d, _, c in brute(rows) if d == c}]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {d for d, _ in plain(rows, items)}
    rest = spark.createDataFrame([x for x in rows if x[0] not in held], "doc_id long, text string")
    want = {r["doc_id"]: r["text"] for r in redact(with_spans(rest, "text"), "text").collect()}
    got = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"]: r["text"] for r in decode(got, vocabulary()).collect()} == want
    assert matches and hashlib


def test_all_but_the_last_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= 30, name
        assert dict(out.dtypes) == dict(docs.dtypes), name
