"""Templates against a plain search over every document and item, and hand-made questions."""

import collections

import pytest

from quoinlake.llm.decontaminate import contaminated, decontamination_query, decontamination_stage, template_windows

SF = "/root/testdata/sf0.01"


def plain(docs, items):
    """(doc_id, item_id) by the same rule, without tables of bits or joins."""
    index, sizes = collections.defaultdict(list), {}
    for item, text in items:
        found = list(template_windows([text]))
        sizes[item] = len(found)
        for _, h, pos, slots in found:
            index[h].append((item, pos, slots))
    out = set()
    for doc, text in docs:
        runs = collections.defaultdict(list)
        for _, h, at, got in template_windows([text]):
            for item, pos, slots in index.get(h, ()):
                if len(slots) == len(got):
                    runs[item, at - pos].append((pos, slots, got))
        held = collections.defaultdict(set)
        for (item, _), rows in runs.items():
            pairs = {p for _, a, b in rows for p in zip(a, b)}
            if len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
                held[item] |= {pos for pos, _, _ in rows}
        for item, at in held.items():
            if len(at) >= 0.5 * sizes[item] and len(at) >= min(4, sizes[item]):
                out.add((doc, item))
    return out


ITEM = "Tom has 12 apples and gives 3 kg to Anna , then Tom walks 5 km home to eat 12 of them ."
CASES = {
    1: "Once more : Bob has 40 apples and gives 7 lbs to Clara , then Bob walks 9 miles home to eat 40 of them .",
    2: "Once more : Bob has 40 apples and gives 7 lbs to Clara , then Bob walks 9 miles home to eat 41 of them .",
    3: "Nothing of the kind stands in this text at all , it is only made of other words .",
    4: ITEM,
    5: None,
    6: "",
}


def test_new_values_are_found_if_they_are_consistent(spark):
    docs = spark.createDataFrame([(k, "x y z . " + v if v else v, 1) for k, v in CASES.items()], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, "Here " + ITEM), (8, "too short"), (9, None), (None, ITEM)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_items"], r["item_id"], r["changed"]) for r in contaminated(docs, "doc_id", "text", bench, "item_id", "text").collect()}
    assert got[1] == (1, 7, True) and got[4] == (1, 7, False)
    assert got[2][0] == 0 or got[2][2]  # an inconsistent run does not count
    assert all(got[k] == (0, None, False) for k in (3, 5, 6))


def test_documents_against_a_plain_search(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = plain(docs, items)
    assert want and {(r["doc_id"], r["item_id"]) for r in decontamination_query(spark, SF).collect()} == want
    held = {r["doc_id"]: r["n_items"] for r in contaminated(
        *(x for t, k in (("documents", "doc_id"), ("benchmark", "item_id")) for x in (spark.read.parquet(f"{SF}/{t}.parquet"), k, "text"))
    ).collect()}
    assert held == {d: len({i for e, i in want if e == d}) for d, _ in docs}


def test_stage_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()
    planted = spark.createDataFrame([(10**6, f"start of it.\n{item['text']}\nand an end", "en", "s", 1), (None, item["text"], "en", "s", 1)], docs.schema)
    got = decontamination_stage(spark, docs.unionByName(planted), SF)
    ids = [r["doc_id"] for r in got.collect()]
    assert got.columns == docs.columns and 10**6 not in ids and None not in ids and len(ids) > 40
    assert contaminated(docs, "doc_id", "text", spark.createDataFrame([], "item_id long, text string"), "item_id", "text").count() == 50
    assert contaminated(docs.limit(0), "doc_id", "text", spark.read.parquet(f"{SF}/benchmark.parquet"), "item_id", "text").count() == 0


@pytest.mark.parametrize("text", ["1 2 3 4 5 6 7 8", "Aa Bb Cc Dd Ee Ff", "", None])
def test_windows_of_placeholders_only_are_none(text):
    assert list(template_windows([text])) == []


def test_long_text(spark):
    long = "word after word " * 30_000 + ITEM + " more words " * 10_000
    docs = spark.createDataFrame([(1, long)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert contaminated(docs, "doc_id", "text", bench, "item_id", "text").first()["n_items"] == 1


def found(spark, docs, items):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return [(r["doc_id"], r["n_items"]) for r in contaminated(df, "doc_id", "text", bench, "item_id", "text").orderBy("doc_id", "n_items").collect()]


def test_one_inconsistent_slot_does_not_clear_a_copy(spark):
    sums = "A farmer sells 3 baskets of ripe plums and then another 5 baskets of sweet pears at the old market before noon ."
    docs = [
        (1, "Once more : " + CASES[4].replace("eat 12", "eat 13")),  # verbatim but for one occurrence of a number
        (2, sums.replace("3", "4").replace("5", "4")),  # two numbers become equal
        (3, CASES[2]), (4, CASES[3]),
    ]
    assert found(spark, docs, [(7, ITEM), (8, sums)]) == [(1, 1), (2, 1), (3, 1), (4, 0)]


def test_copies_of_short_and_slot_dense_items_are_found(spark):
    items = [(1, "Compute 12 + 7 - 3 ."), (2, "Did Anna Berg pay Carl Dorn 12 , 40 or 77 dollars in Ulm 1999 or Bonn 2004 ?"), (3, "Why ?"), (4, "Tom eats 3 red apples daily .")]
    docs = [(1, "So he said : compute 12 + 7 - 3 ."), (2, f"He asked : {items[1][1]} Nobody knew ."), (3, "I wonder why it rains ."),
            (4, "It is said that Tom eats 3 red apples daily ."), (5, "Compute 12 + 8 - 3 and see what Anna Berg pays in Ulm 1999 .")]
    assert found(spark, docs, items) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 0)]


def test_rows_are_judged_by_their_own_text(spark):
    half = len(ITEM) // 2
    docs = [(None, ITEM), (None, "clean text of its own"), (5, ITEM), (5, "another clean text"), (None, ITEM[:half]), (None, "x " + ITEM[half:])]
    assert sorted(n for i, n in found(spark, docs, [(7, ITEM)]) if i == 5) == [0, 1]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [(i, item if t == ITEM else t, "en", "s", 1) for i, t in docs]
    got = decontamination_stage(spark, spark.createDataFrame(rows, schema), SF).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted((str(i), t) for i, t in docs if t != ITEM)


def test_stage_moves_no_documents_where_few_are_held(spark, tmp_path):
    item = "the quick brown fox jumps over the lazy dog near the old river bank today"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, item), (2, "nothing of it"), (None, None)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables whose size is not known to be small
    try:
        kept = decontamination_stage(spark, docs, str(tmp_path))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "None"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
