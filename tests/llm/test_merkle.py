"""The manifest against a tree that is built in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quoinlake.llm.catalog import SQL
from quoinlake.llm.merkle import COLUMNS, fold, leaf_hash, manifest, merkle_query, siblings
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(digests, fanout=8):
    """Top digest and for each leaf its [(before, after)] from the leaf up."""
    paths, at, nodes = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for k, place in enumerate(at):
            run, j = runs[place // fanout], place % fanout
            paths[k].append(("".join(run[:j]), "".join(run[j + 1 :])))
            at[k] = place // fanout
        nodes = [H(*r) for r in runs]
    return nodes[0], paths


def plain(rows, fanout=8):
    """(leaf, subroot, root, siblings' hash, folded root) of every row (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row, leaf_of(row)))
    tops = {}
    for lang, members in groups.items():
        members.sort(key=lambda m: (m[0][0] is not None, m[0][0] or 0, m[1]))
        tops[lang] = tree([m[1] for m in members], fanout)
    langs = sorted(tops, key=lambda x: (x is not None, (x or "").encode()))
    root, upper = tree([tops[x][0] for x in langs], fanout)
    out = []
    for x, above in zip(langs, upper):
        subroot, paths = tops[x]
        for (row, leaf), path in zip(groups[x], paths):
            h = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                h = leaf_of([*row[:4], row[4].translate(FOLD) if row[4] is not None else None])
            for before, after in path + above:
                h = H(before, h, after)
            out.append((row[0], leaf, subroot, root, H(*[b + a for b, a in path + above]), h, h == root))
    return out


def result(spark, df, tmp_path):
    folder = str(tmp_path / "sf")
    df.write.parquet(f"{folder}/documents.parquet")
    return sorted(map(repr, map(tuple, merkle_query(spark, folder).collect())))


def test_query_equals_its_sql(spark):
    assert compare(spark, duck(SF), merkle_query, SQL["op12_merkle"], SF) == ""


def test_query_equals_a_plain_tree(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(COLUMNS).collect()]
    got = [tuple(r) for r in merkle_query(spark, SF).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain(rows)))


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 73])
def test_sizes_around_full_runs(spark, tmp_path, n):
    rows = [(i, "s", "en", 3, f"Text {i}") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert result(spark, df, tmp_path) == sorted(map(repr, plain(rows)))


def test_nulls_repeats_many_groups_and_clashing_columns(spark, tmp_path):
    rows = [(i % 40 if i % 9 else None, None if i % 5 == 0 else "s\u00e9", None if i % 6 == 0 else f"l{i % 11}", None if i % 7 == 0 else i,
             None if i % 8 == 0 else "" if i % 8 == 1 else "A\U0001F600" * i) for i in range(150)]
    rows += [rows[3]] * 3 + [(2**60 + 3, "s", "lone", 1, "X")] + [(5, "s", "long", 1, "Wort " * 200_000)]
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    df = spark.createDataFrame(rows, schema).withColumns({"position": F.lit(1), "n": F.lit("x"), "digest": F.lit("y"), "path": F.lit(0)})
    assert result(spark, df, tmp_path) == sorted(map(repr, plain(rows)))


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert result(spark, df, tmp_path) == []


def test_other_fanout_and_a_changed_leaf(spark):
    rows = [(i, "en" if i % 4 else "de") for i in range(60)]
    df = spark.createDataFrame(rows, "k int, g string").withColumn("digest", leaf_hash(F.col("k")))
    proofs, groups = manifest(df, ["k"], "g", fanout=3)
    checked = proofs.select("k", "root", fold(F.col("digest"), F.col("path")).alias("same"), fold(leaf_hash(F.lit("x")), F.col("path")).alias("other"),
                            siblings(F.col("path")).alias("s")).collect()
    assert len(checked) == 60 and all(r["same"] == r["root"] != r["other"] for r in checked)
    want = {g: tree([leaf_of([k]) for k, x in rows if x == g], 3)[0] for g in ("en", "de")}
    assert {r["g"]: r["digest"] for r in groups.collect()} == want
