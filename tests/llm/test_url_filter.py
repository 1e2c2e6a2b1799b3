"""URL verdicts against plain parsing, rule by rule matching and a miner that tries every token set."""

import itertools
import random
import re

from pyspark.sql import functions as F

from quoinlake.llm.url_filter import (
    RULES, filtered, host_of, mine, page_labels, path_of, stated_rule, tokens_of, url_query,
)

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/ES/1", "https://example.org/es/?a=/de/#/x", "x://example.org", "x://example.org?/es/",
       "http://a.b://c/d", "http://com/fr/", "http://notcom/fr/", "http://a.com/de/x#y?z", "http://m.example.org/en/12", "http://example.org/en/2",
       "http://myexample.org/es/", "http://user@host:80/p/..?q", "://x.com/fr/1", "http://\u00c9.com/de/\n1", "http://a..com/de/", "http://-x-.com/a.b/c.HTML"]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return host.translate(FOLD), re.split("[?#]", rest[len(host):], maxsplit=1)[0]


def plain_rule(host, path, rules=RULES):
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def plain_mined(rows, share, least_rows, confidence=0.8, gain=0.1, bound=0.6, z=3.0):
    """Every token set of every labelled row, counted."""
    n = len(rows)
    least = max(share, least_rows / n) * n
    counts, labelled = {}, {}
    single = {t: sum(t in x for x, _ in rows) for t in set().union(*[x for x, _ in rows])}
    common = {t for t, c in single.items() if c > 0.95 * n}
    for tokens, verdict in rows:
        tokens = sorted(set(tokens) - common)
        for k in range(len(tokens) + 1):
            for x in itertools.combinations(tokens, k):
                counts[x] = counts.get(x, 0) + 1
                labelled[x, verdict] = labelled.get((x, verdict), 0) + 1
    out = {}
    for (x, v), c in labelled.items():
        conf, of = c / counts[x], counts[x]
        low = (conf + z * z / (2 * of) - z * ((conf * (1 - conf) + z * z / (4 * of)) / of) ** 0.5) / (1 + z * z / of)
        if x and c >= least - 1e-9 and conf >= confidence and low >= bound:
            shorter = [labelled.get((tuple(t for t in x if t != u), v), 0) / counts[tuple(t for t in x if t != u)] for u in x]
            if conf >= max(shorter) + gain:
                out[x, v] = (conf, c)
    return out


def plain_verdict(tokens, mined, otherwise):
    fit = [(conf, c, -len(x), "\n".join(x), v) for (x, v), (conf, c) in mined.items() if set(x) <= set(tokens)]
    return max(fit)[-1] if fit else otherwise


def test_parts_and_stated_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(ODD)], "i int, url string").withColumns(
        {"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumn("r", stated_rule(F.col("host"), F.col("path")))
    for r in df.collect():
        host, path = plain_parts(ODD[r["i"]])
        assert (r["host"], r["path"]) == (host, path)
        assert (tuple(r["r"]) if r["r"] else (None, None)) == plain_rule(host, path)


def test_longest_rule_wins_over_hosts_and_paths(spark):
    rules = [("a", "/", "allow"), ("b.a", "/x", "block"), ("b.a", "/xy/", "allow"), ("c.b.a", "", "block")]
    urls = [f"h://{h}{p}" for h in ("a", "b.a", "c.b.a", "d.c.b.a", "ba") for p in ("", "/", "/x", "/xy/", "/xy/z")]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    for r in df.select("url", stated_rule(host_of(F.col("url")), path_of(F.col("url")), rules).alias("r")).collect():
        host, path = plain_parts(r["url"])
        fit = [(len(h + p), v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["r"]["verdict"] if r["r"] else None) == (max(fit)[1] if fit else None)


def test_query_equals_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(set(r["tokens"]), r["verdict"]) for r in page_labels(pages, spark.read.parquet(f"{SF}/labels.parquet")).collect()]
    mined = plain_mined(rows, 0.002, 8)
    n_block = sum(v == "block" for _, v in rows)
    otherwise = "block" if n_block > len(rows) - n_block else "allow"
    tokens = {r["page_id"]: (r["url"], r["t"]) for r in pages.select("page_id", "url", tokens_of(F.col("url")).alias("t")).collect()}
    got = url_query(spark, SF).collect()
    assert len(got) == len(tokens)
    for r in got:
        url, have = tokens[r["page_id"]]
        host, path = plain_parts(url)
        rule, verdict = plain_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or plain_verdict(have, mined, otherwise))


def planted(seed, n):
    """URLs to be blocked by combinations of tokens, none of which tells alone."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        host, part, key, kind = rng.choice(["news", "shop", "blog"]), rng.choice(["win", "read", "buy"]), rng.choice(["a", "b"]), rng.choice(["html", "php"])
        bad = (host, part) == ("shop", "win") or (part, key, kind) == ("buy", "b", "php")
        out.append((i, f"https://{host}.site{i % 97}.net/{part}/{i}.{kind}?{key}=1", "block" if bad else "allow"))
    return out


def test_mined_rules_equal_every_token_set(spark):
    rows = planted(1, 400)
    df = spark.createDataFrame(rows, "i int, url string, verdict string").withColumn("tokens", tokens_of(F.col("url")))
    got = {(tuple(r["antecedent"]), r["verdict"]): (round(r["confidence"], 12), r["n_rows"]) for r in mine(df).rules.collect()}
    want = plain_mined([(set(r["tokens"]), r["verdict"]) for r in df.collect()], 0.002, 8)
    assert got == {k: (round(c, 12), n) for k, (c, n) in want.items()} and any(v == "block" for _, v in got)


def test_held_out_accuracy_and_both_ways_of_matching(spark):
    train = spark.createDataFrame(planted(2, 1500), "i int, url string, verdict string").withColumn("tokens", tokens_of(F.col("url")))
    test = spark.createDataFrame(planted(3, 600), "i int, url string, truth string")
    mined = mine(train)
    rows = filtered(test, mined, rules=[]).collect()
    assert sum(r["verdict"] == r["truth"] for r in rows) / len(rows) > 0.98
    joined = filtered(test, mined, rules=[], index_rules=0)
    assert sorted(map(tuple, joined.select(*test.columns, "verdict", "tokens", "confidence").collect())) == sorted(
        (r["i"], r["url"], r["truth"], r["verdict"], r["tokens"], r["confidence"]) for r in rows)


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    mined = mine(spark.createDataFrame([], "tokens array<string>, verdict string"))
    pages = spark.createDataFrame([(i % 5 if i else None, u, "mine") for i, u in enumerate(ODD)], "page_id long, url string, rule string")
    for way in (0, 10):
        got = filtered(pages, mined, index_rules=way)
        assert got.count() == len(ODD) and got.where("url is null").first()["verdict"] == "allow"
    assert filtered(pages.limit(0), mined).count() == 0
    labels = spark.createDataFrame([(1, None, None), (1, 1, 1), (None, 0, 0), (2, 0, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, "h://a/b"), (2, None), (3, "h://a.c/b"), (None, "h://a/b"), (4, "h://x-casino.c/"), (3, "h://best-pills.c/")], "page_id long, url string")
    assert sorted(r["verdict"] for r in page_labels(some, labels).collect()) == ["allow", "block", "block", "block", "block"]
    long = spark.createDataFrame([(1, "http://h.com/" + "a/" * 50_000 + "?" + "k=1&" * 1000)], "page_id long, url string")
    assert filtered(long, mined).first()["verdict"] == "allow"
