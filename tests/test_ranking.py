"""Positions found by ranges against positions found by sorting."""

from pyspark.sql import functions as F

from quoinlake.operators.features import label_index, one_hot_slots
from quoinlake.operators.ranking import numbered


def test_positions_of_groups_with_nulls_ties_and_a_hot_one(spark):
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else f"g{i % 5}", (i * 37) % 211, i) for i in range(900)]
    rows += [("lone", None, -1), (None, None, -2)]
    df = spark.createDataFrame(rows, "g string, v int, position int")
    got = numbered(df, [F.col("v").asc_nulls_first(), F.col("position").asc()], ["g"], "at", "n").collect()
    groups = {}
    for g, v, i in rows:
        groups.setdefault(g, []).append(((v is not None, v), i))
    want = {(g, i): (at, len(x)) for g, x in groups.items() for at, (_, i) in enumerate(sorted(x))}
    assert {(r["g"], r["position"]): (r["at"], r["n"]) for r in got} == want and len(got) == len(rows)


def test_equal_rows_get_numbers_of_their_own(spark):
    df = spark.createDataFrame([("a", 1)] * 50 + [("b", 1)] * 3, "g string, v int")
    got = numbered(df, [F.col("v").asc()], ["g"]).collect()
    assert sorted(r["position"] for r in got if r["g"] == "a") == list(range(50))


def test_no_group_and_descending_order(spark):
    got = numbered(spark.range(100), [F.col("id").desc()], out="at").collect()
    assert all(r["at"] == 99 - r["id"] for r in got) and len(got) == 100


def test_empty_table(spark):
    assert numbered(spark.range(0), [F.col("id").asc()], total="n").columns == ["id", "position", "n"]
    assert numbered(spark.range(0), [F.col("id").asc()]).count() == 0


def test_labels_beyond_a_vector_are_indexed_and_get_slots(spark):
    many = spark.range(5000).select(F.concat(F.lit("w"), (F.col("id") % 2500).cast("string")).alias("c")).union(
        spark.createDataFrame([("w7",), (None,)], "c string"))
    index = label_index(many, "c")
    best = {r["label"]: r["label_idx"] for r in index.collect()}
    assert len(best) == 2500 and best["w7"] == 0.0 and best["w0"] == 1.0 and best["w1"] == 2.0 and best["w10"] == 3.0
    new = spark.createDataFrame([("w7", 1), ("none of them", 2), (None, 3)], "c string, k int")
    got = {r["k"]: (r["pt_slot"], r["pt_size"]) for r in one_hot_slots(new, "c", index, "pt").collect()}
    assert got == {1: (0, 2501), 2: (2500, 2501), 3: (2500, 2501)}


def test_no_window_over_rows(spark):
    plan = label_index(spark.range(10).select(F.col("id").cast("string").alias("c")), "c")
    assert "Window" not in plan._jdf.queryExecution().executedPlan().toString()
