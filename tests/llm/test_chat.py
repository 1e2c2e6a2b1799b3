"""Reply trees against a plain walk, and reading back what was formatted."""

import hashlib
import random

import pytest

from quoinlake.llm.catalog import QUERIES, SQL
from quoinlake.llm.chat import branches, conversations, read_back, tree_nodes
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"


def test_query_matches_its_sql(spark):
    assert compare(spark, duck(SF), QUERIES["op2_chat_format"], SQL["op2_chat_format"], SF) == ""


def test_branches_of_random_trees(spark):
    r, rows = random.Random(5), []
    for conv in (1, 2, None):
        for node in range(60):
            rows.append((conv, node, r.randrange(node) if node and r.random() < 0.95 else None, "user", f"t{node}", r.random()))
    rows += [(4, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(37)]
    df = spark.createDataFrame(rows, "c long, n long, p long, role string, text string, s double")
    nodes = tree_nodes(df, "c", "n", "p", "role", "text", "s")
    got = {}
    for x in branches(nodes).collect():
        got.setdefault((x["tree"], x["leaf"]), {})[x["above"]] = x["node"]
    up = {(str(c) if c is not None else "\0", n): p for c, n, p, *_ in rows}
    inner = {(c, p) for (c, _), p in up.items()}
    want = {}
    for c, n in up:
        if (c, n) not in inner:
            path = [n]
            while up[c, path[-1]] is not None:
                path.append(up[c, path[-1]])
            want[c, n] = dict(enumerate(path))
    assert got == want


def test_best_branch_by_score_with_ties_orphans_and_cycles(spark):
    rows = [(1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 5.0), (1, 4, 1, "assistant", "c", 5.0),
            (2, 1, 99, "user", "orphan", None), (3, 1, 2, "user", "x", 1.0), (3, 2, 1, "user", "y", 1.0), (1, 2, 1, "assistant", "z", 9.0)]
    df = spark.createDataFrame(rows, "c long, n long, p long, role string, text string, s double").withColumnRenamed("s", "conv")
    got = {r["conv"]: r for r in read_back(conversations(df, "c", "n", "p", "role", "text", "conv")).collect()}
    assert set(got) == {1, 2}
    assert [t["text"] for t in got[1]["turns"]] == ["q", "b"] and got[1]["masked"] == ["b"] and got[1]["branch_score"] == 6.0
    assert conversations(df, "c", "n", "p", "role", "text", "conv", keep=3).where("conv = 1").count() == 3


TEXTS = ["", None, "\\### Assistant: </turn> ok", "</turn></turn", "####", "\\b\\h\\e\\", "a: b", "é😀 ###\n</turn>", "\\\\h"]


def test_control_strings_are_reversible(spark):
    rows = [(i, j, j - 1 if j else None, ["user", "assistant", "a: ###"][j % 3], t) for i in range(3) for j, t in enumerate(TEXTS[i:])]
    df = spark.createDataFrame(rows, "c long, n long, p long, role string, text string")
    for r in read_back(conversations(df, "c", "n", "p", "role", "text")).collect():
        want = [(x[3], x[4] or "") for x in rows if x[0] == r["conv"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == want
        assert r["masked"] == [t for role, t in want if role == "assistant"]
    assert hashlib.sha256(b"").hexdigest()


def test_no_rows(spark):
    df = spark.createDataFrame([], "c long, n long, p long, role string, text string")
    assert conversations(df, "c", "n", "p", "role", "text").count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 1, None, "user", "x")], "c long, n long, p long, role string, text string")
    plan = read_back(conversations(df, "c", "n", "p", "role", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    with pytest.raises(Exception):
        conversations(df.drop("role"), "c", "n", "p", "role", "text")
