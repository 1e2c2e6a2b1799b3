"""The corpus pipeline: stages that each take documents, written and read again between them.

Every stage but the last returns the columns of `documents`. A stage judges all that its
predecessor kept. SQL cannot express the stages, so their tests hold each against a plain
version.
"""

from pyspark.sql import DataFrame, SparkSession

from quoinlake.llm.decontaminate import decontamination_stage
from quoinlake.llm.jaccard import jaccard_stage
from quoinlake.llm.pieces import pieces_stage
from quoinlake.llm.pii import pii_stage
from quoinlake.llm.quality import quality_stage
from quoinlake.workspace import stored

STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("SentencePiece encoding and decoding", pieces_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
