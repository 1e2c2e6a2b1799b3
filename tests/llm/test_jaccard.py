"""Jaccard join against all pairs."""

import random
import re

import pytest

from quoinlake.llm import jaccard
from quoinlake.llm.graph import components
from quoinlake.llm.jaccard import described, index_rows, jaccard_query, jaccard_stage, similar_components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        first[find(i)] = min(first.get(find(i), d), d)
    return sorted((d, len(sets[i]), first[find(i)]) for i, (d, _) in enumerate(rows))


def joined(spark, rows, **k):
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n int")
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in similar_components(df, "doc_id", "text", **k).collect())


def edited(words, r, share):
    return [r.choice("xyzuvw") + str(r.random()) if r.random() < share else w for w in words]


def test_random_groups_around_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 3)
    r, rows = random.Random(8), []
    common = [f"c{i}" for i in range(60)]
    for g in range(25):
        base = [f"g{g}w{i}" for i in range(r.choice([6, 12, 40, 150]))] + (common if g % 3 == 0 else [])
        rows += [" ".join(edited(base, r, r.choice([0, 0.01, 0.02, 0.04, 0.05]))) for _ in range(r.choice([2, 3, 12]))]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    assert joined(spark, rows) == brute(rows)


def test_defined_cases(spark):
    rows = [(5, None), (4, ""), (3, " \t\n"), (2, "One  two"), (1, "one two"), (9, "É a b c d"), (8, "é a b c d"), (7, "a\x1cb c d e f"), (6, "a\x1cb c d e f"), (6, "x y z u v w")]
    assert joined(spark, rows) == brute(rows)
    assert joined(spark, [(1, "a b c d e f g")]) == [(1, 3, 1)]
    df = spark.createDataFrame([], "doc_id long, text string")
    assert similar_components(df, "doc_id", "text").count() == 0


def test_long_texts_and_a_large_group_of_copies(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(i, long + f" end{i % 3}") for i in range(6)] + [(100 + i, "the same few words stand here again") for i in range(300)]
    assert joined(spark, rows) == brute(rows)


def test_query_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_query(spark, sf).collect())
    assert got == brute(rows)


def test_stage_keeps_one_of_each_group(spark):
    rows = [(3, "a b c d e f", "en"), (1, "A b c d e f", "en"), (2, "q r s t u v", None), (2, "q r s t u v", None), (None, "a b c d e f", "x"), (7, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = jaccard_stage(spark, df, "")
    assert got.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in got.collect()) == ["1", "2", "7", "None"]


@pytest.mark.parametrize("n", [1, 2, 50])
def test_components_of_a_chain_and_a_star(spark, n):
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, 40)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got == {i: 0 for i in range(n + 1)} | {1000 + i: 1000 for i in range(40)}


def links(rows):
    sets = {frozenset(shingles(t)) for _, t in rows}
    near = lambda a, b: a != b and a & b and 100 * len(a & b) >= 80 * len(a | b)
    return sorted((d, sum(1 for y in sets if near(frozenset(shingles(t)), y))) for d, t in rows)


@pytest.mark.parametrize("block", [1 << 16, 200])
def test_every_link_is_counted(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "COLUMNS", 64)
    r, rows = random.Random(3), []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(r.choice([30, 90]))]
        rows += [" ".join(edited(base, r, r.choice([0, 0.01, 0.02, 0.03]))) for _ in range(12)]
    rows = list(enumerate([*rows, None, "", "alone here"]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_links"]) for r in similar_components(df, "doc_id", "text", count_links=True).collect())
    assert got == links(rows) and max(n for _, n in got) > 4


def test_stage_judges_rows_that_repeat_an_id_by_their_own_texts(spark):
    rows = [(1, "a b c d e f"), (1, "q r s t u v"), (2, "Q r s t u v"), (2, "k l m n o p"), (3, None), (3, "k l m n o p"), (3, "")]
    df = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    got = [(r["doc_id"], r["text"]) for r in jaccard_stage(spark, df, "").collect()]
    assert sorted(got, key=str) == sorted([(1, "a b c d e f"), (1, "q r s t u v"), (2, "k l m n o p"), (3, None), (3, "")], key=str)


def test_copies_in_many_tasks_enter_the_index_once(spark):
    """A set that every task holds is one row for each of its tokens, so it meets itself nowhere and others once."""
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    df = spark.createDataFrame([(i, text) for i in range(64)], "doc_id long, text string").repartition(16)
    _, hot = described(df, "doc_id", "text")
    rows = index_rows(df, "doc_id", "text", hot)
    assert rows.count() == rows.select("token", "name").distinct().count() > 0
    assert {r["component_id"] for r in similar_components(df, "doc_id", "text").collect()} == {0}


def test_long_paths_and_stars_come_to_one_root(spark):
    edges = [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(1, 40)] + [(7, 8), (8, 7), (9, 9), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components(df, "a", "b").collect()}
    want = {i: 1000 for i in range(1000, 1061)} | {5000 + i: 5000 for i in range(40)} | {7: 7, 8: 7}
    assert {k: v for k, v in got.items() if k != 9} == want and got.get(9, 9) == 9


def test_near_copies_are_linked_by_the_pivot_that_most_resemble(spark, monkeypatch):
    """Copies with edits of their own and the text itself: few pairs are left once all met the pivots of their lists."""
    r, base, left = random.Random(5), [f"w{i}" for i in range(150)], []
    edit = lambda k: {r.randrange(5, 145): f"e{r.random()}" for _ in range(k)}
    texts = [" ".join(e.get(i, w) for i, w in enumerate(base)) for e in [{}, *(edit(r.choice([1, 2, 3])) for _ in range(80))]]
    whole = jaccard.stray_pairs

    def counted(*given):
        pairs = whole(*given)
        left.append(pairs.count())
        return pairs

    monkeypatch.setattr(jaccard, "stray_pairs", counted)
    rows = list(enumerate(texts))
    assert joined(spark, rows) == brute(rows)
    assert left[0] <= 8
