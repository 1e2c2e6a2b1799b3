"""Spelling forms against every pair of words, counted from the texts one by one."""

import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quoinlake.llm.catalog import SQL
from quoinlake.llm.spelling import _matrices, blocks, near_pairs, spelling_forms, spelling_query, word_counts
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(docs, least=3):
    n = {}
    for doc_id, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 5:
                n[run] = n.get(run, 0) + 1
    return {w: c for w, c in n.items() if c >= least}


def plain_forms(n, near=None):
    near = near or {w: [v for v in n if v != w and one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def rows(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_query_equals_its_sql(spark):
    assert compare(spark, duck(SF), spelling_query, SQL["op11_spelling"], SF) == ""


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    n = plain_counts(docs)
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    near = {w: [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if v != w and one_edit(w, v)] for w in n}
    assert rows(spelling_query(spark, SF)) == plain_forms(n, near)


@pytest.mark.parametrize("most", [2, 5, 256])
def test_divided_blocks_find_the_same(spark, most):
    """A dense vocabulary: every block is divided down to single places where `most` is small."""
    rng = random.Random(3)
    words = {"".join(rng.choice("ab\u00ff") for _ in range(rng.choice([5, 6, 6, 7]))) for _ in range(400)} | {"x" * 300, "x" * 299, "x" * 150 + "y" + "x" * 149}
    n = {w: rng.choice([3, 4, 8, 20, 20]) for w in words}
    df = spark.createDataFrame(sorted(n.items()), "word string, n long")
    assert rows(spelling_forms(df, most=most)) == plain_forms(n)
    sizes = blocks(df, most).groupBy("block", "lo", "hi").count().collect()
    assert all(r["count"] <= most or r["hi"] - r["lo"] == 1 for r in sizes)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab\u00e9", min_size=5, max_size=8), min_size=2, max_size=12, unique=True))
def test_prefix_and_suffix_identify_single_edits(words):
    raw = [w.encode("latin-1") for w in words]
    length = np.array([len(w) for w in raw])
    at = np.concatenate([[0], np.cumsum(length)[:-1]])
    flat = np.frombuffer(b"".join(raw), np.uint8)
    for size in (6, 7, 8):
        use = np.flatnonzero((length == size) | (length == size - 1))
        if len(use) < 2:
            continue
        side = _matrices(flat, at[use], length[use], size)
        got = near_pairs(side, side, size, 0, size)
        for i, a in enumerate(use):
            for j, b in enumerate(use):
                if i != j and max(length[a], length[b]) == size:
                    assert got[i, j] == one_edit(words[a], words[b])


def test_nulls_empty_repeats_and_clashing_columns(spark):
    docs = [(1, "Hello hello HELLO hellos hellos hellos", 5), (None, "hello " * 6, 1), (2, None, 2), (2, "", 3), (1, "Hello hello HELLO", 9),
            (3, "\u00c0bcde \u00e0bcde \u00c0bcde \u00c0bcde abcd' 1abcd \u00d7\u00d7\u00d7\u00d7\u00d7 x", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, word int")
    n = plain_counts([d[:2] for d in docs])
    assert {tuple(r) for r in word_counts(df).collect()} == set(n.items())
    assert rows(spelling_forms(word_counts(df))) == plain_forms(n)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert rows(spelling_forms(word_counts(empty))) == set()


def test_a_long_chain_ends_at_its_root(spark):
    n = {"a" * (5 + i): 3 * 2**i for i in range(12)}
    got = rows(spelling_forms(spark.createDataFrame(sorted(n.items()), "word string, n long")))
    assert got == plain_forms(n) and {r[2] for r in got} == {"a" * 16}


def test_a_very_long_text_and_a_very_long_run(spark):
    text = ("variant " * 50_000) + ("variants " * 10) + "z" * 200_000
    got = rows(spelling_forms(word_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"), every=None)))
    assert got == {("variant", None, "variant", 50_000, 1, None), ("variants", "variant", "variant", 10, 1, 50_000)}
