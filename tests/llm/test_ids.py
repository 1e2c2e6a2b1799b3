"""Ids beyond 2^53 next to a NULL id come out of every operator as they went in."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quoinlake.llm import decontaminate, extraction, pieces, quality, sampling, token_file
from quoinlake.llm.jaccard import jaccard_stage, similar_components
from quoinlake.llm.pii import pii_stage
from quoinlake.workspace import new_folder

IDS = [None, 2**53 + 1, 2**60 + 3, -(2**62) - 1, 5]
ITEM = "Which plain river flows past the old stone mill behind the quiet hill near town today"


@pytest.fixture(scope="module")
def docs(spark):
    """In one batch; two of the texts are long enough to be cut into chunks."""
    rows = [(i, f"{ITEM} and this is text number {n} of the table " * (1 + 400 * (n % 2)), "en", "s", i) for n, i in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


def ids(df, column="doc_id"):
    return sorted([r[0] for r in df.select(column).collect()], key=str)


WANT = sorted(IDS, key=str)


def test_pieces(docs):
    encoded = pieces.encode(docs, "doc_id", "text", pieces.vocabulary())
    assert ids(encoded) == WANT and ids(pieces.decode(encoded, pieces.vocabulary())) == WANT


def test_quality(spark, docs):
    labels = spark.createDataFrame([(2**53 + 1, 1, 0), (2**60 + 3, 0, 1)], "doc_id long, quality int, toxic int")
    assert ids(quality.scored(docs, quality.train(docs, labels))) == WANT
    assert ids(quality.pattern_votes(docs, labels)) == WANT


def test_fingerprints_components_and_private_data(spark, docs):
    assert ids(sampling.fingerprinted(docs, "doc_id", "text")) == WANT
    assert ids(similar_components(docs, "doc_id", "text")) == WANT
    assert set(ids(jaccard_stage(spark, docs, ""))) <= set(WANT)
    staged = pii_stage(spark, docs, "")
    assert ids(staged) == WANT and ids(staged, "n_chars")


def test_token_file(spark, docs):
    folder = new_folder(spark, "t")
    token_file.write_token_file(docs, "doc_id", "text", folder, public_tokenizers.path("byte_bpe_50k.json"))
    rows = sorted(token_file.read_token_file(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, -(2**62) - 1, 5, 2**53 + 1, 2**60 + 3]


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(2**53 + 1, ITEM), (2**53 + 3, ITEM + " again")], "item_id long, text string")
    found = decontaminate.matches(docs, "doc_id", "text", bench, "item_id", "text")
    assert sorted(set(ids(found)), key=str) == WANT and 2**53 + 1 in ids(found, "item_id")


def test_extraction(spark):
    pages = spark.createDataFrame([(i, f"u{i}", i, "<article><p>Some plain text stands here.</p></article>") for i in IDS],
                                  "page_id long, url string, size long, html string").coalesce(1)
    out = extraction.extract(pages, "page_id", "html", extraction.train([]), keep=("url", "size"))
    assert ids(out, "page_id") == WANT and ids(out, "size") == WANT
    assert out.schema["size"].dataType.simpleString() == "bigint" and out.where(F.col("n_chars") > 0).count() == len(IDS)
