"""Audits in passing against the operators that count in a job of their own."""

import uuid

import pytest
from pyspark.sql import functions as F

from quoinlake.operators.audit import TRACKED_KEYS, accepted, audited_require, audited_tiers, refusals, unmapped_seen
from quoinlake.operators.clean import unmapped
from quoinlake.operators.normalize import require


def ads(spark, n=300):
    return spark.range(n).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("ad_id"), F.when(F.col("id") % 5 > 0, F.lit("t")).alias("title"),
        F.when(F.col("id") % 7 > 0, F.lit(1.0)).alias("price"), "id")


def test_refusals_of_the_pass_that_writes(spark, tmp_path):
    required = ["ad_id", "title", "price"]
    usable, refused = require(ads(spark), required)
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "write and audit")
    audit = audited_require(ads(spark), required)
    audit.rows.write.parquet(str(tmp_path / "ads"))
    got = dict(refusals(audit))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1  # one scan of the ads
    assert got == {r["missing"]: r["n_rows"] for r in refused.collect()}
    assert accepted(audit) == usable.count() == spark.read.parquet(str(tmp_path / "ads")).count()
    assert audit.rows.columns == usable.columns
    with pytest.raises(ValueError):
        audited_require(ads(spark), [f"c{i}" for i in range(9)])


def test_an_empty_table_has_no_refusals(spark, tmp_path):
    audit = audited_require(ads(spark, 0), ["ad_id"])
    audit.rows.write.parquet(str(tmp_path / "ads"))
    assert refusals(audit) == [] and accepted(audit) == 0


@pytest.mark.parametrize("n_keys", [3, TRACKED_KEYS + 500])
def test_unmapped_keys_of_the_pass_that_writes(spark, tmp_path, n_keys):
    """Few keys are exact in passing; where there are more than are tracked, they are counted again."""
    key = F.when(F.col("id") % 4 > 0, F.concat(F.lit("d"), F.col("id") % n_keys))
    df = spark.range(2 * n_keys).select(key.alias("district"), "id")
    tiers = {"d0": 1, "d2": 2}
    audit = audited_tiers(df, tiers)
    audit.rows.write.parquet(str(tmp_path / "t"))
    want = {r["district"]: r["n_rows"] for r in unmapped(df, tiers).collect()}
    assert dict(unmapped_seen(audit, df, tiers)) == want and None in want
    assert spark.read.parquet(str(tmp_path / "t")).where("rank_quan is not null").count() == df.where("district in ('d0', 'd2')").count()
