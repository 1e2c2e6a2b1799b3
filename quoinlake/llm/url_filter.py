"""URL filter: stated rules first, then association rules mined from labelled URLs.

A URL becomes a set of tokens: scheme, labels and hyphenated words of its host, the last
label, segments of its path without numbers, names of query fields and the file type.
FP-growth mines the token sets that occur often among labelled URLs, with the label as one
more item. A set with the label, over the set without it, is a rule with its confidence.
Rules below the least confidence go, and so do those that are hardly surer than the rule
they become by leaving one token out. What is left is kept in an inverted index: each rule
stands under its rarest token, so a URL meets only rules it has that token of, and the
other tokens are then looked up in the URL. The surest rule that fits decides; where none
fits, the majority of the labels does.

Defined results: a NULL URL or one without `://` has an empty host and path, no tokens, no
stated rule and the majority's verdict, `allow` where there are no labels. Verdicts follow
the URL alone, so rows that repeat an id are each judged by their own. An id with several
labels is to be blocked if one of them says so. Columns besides those named are not read.
"""

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoinlake.operators.sizing import small_or_shuffled
from quoinlake.workspace import stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The rules of the task: (host, start of the path, verdict).
RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]
#: Host words whose pages count as labelled `block`, besides the pages of the labels table.
SEED_WORDS = ["casino", "pills", "bets", "spam", "adult", "track"]
#: Least share and number of labelled rows behind a rule, least confidence, and least gain
#: of confidence over a rule of one token less.
LEAST_SHARE, LEAST_ROWS, LEAST_CONFIDENCE, LEAST_GAIN = 0.002, 8, 0.8, 0.1
#: A rule of few rows may be sure by chance: its confidence less this many standard errors
#: (Wilson's lower bound) must reach LEAST_BOUND.
ERRORS, LEAST_BOUND = 3.0, 0.6
#: Tokens in more of the labelled rows than this say nothing and only double the sets.
COMMON_SHARE = 0.95
#: Up to this many rules the index lies in each task; beyond, tokens are joined with it.
INDEX_RULES = 2000
VERDICTS = ("allow", "block")


# --- parts of a URL ---------------------------------------------------------------

def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, "^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL, none of NULL or of a text without `://`."""
    host, path = host_of(url), path_of(url)

    def tagged(tag: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(f"{tag}:"), x))

    labels = F.split(host, "\\.")
    names = F.filter(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: ~x.contains("-"))
    words = F.flatten(F.transform(F.filter(labels, lambda x: x.contains("-")), lambda x: F.split(x, "-")))
    segments = F.filter(F.split(F.translate(path, UPPER, UPPER.lower()), "/"), lambda x: x.rlike("[^0-9]") & ~x.contains("."))
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    keys = F.regexp_extract_all(query, F.lit("(?:^|&)([^=&]+)"), F.lit(1))
    known = F.array_distinct(F.concat(
        F.array(F.concat(F.lit("scheme:"), F.regexp_extract(url, "^((?s:.*?))://", 1))),
        F.array(F.concat(F.lit("last:"), F.element_at(labels, -1))),
        tagged("label", names), tagged("word", words), tagged("segment", segments), tagged("field", keys),
        tagged("type", F.array(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1)))))
    return F.when(url.contains("://"), known).otherwise(F.array().cast("array<string>"))


# --- stated rules -----------------------------------------------------------------

def _followed_by(head: Column):
    return lambda name: F.concat(name, head)


def stated_rule(host: Column, path: Column, rules: "list[tuple[str, str, str]]" = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else NULL.

    The rules are looked up, not gone through: the host with each of its suffixes, joined
    with the first code points of the path in each length that some rule has.
    """
    if not rules:
        return F.lit(None).cast("struct<rule: string, verdict: string>")
    names = F.create_map(*[F.lit(x) for h, p, verdict in rules for x in (h + p, verdict)])
    labels = F.split(host, "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    heads = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted({len(p) for _, p, _ in rules})]
    tried = F.flatten(F.array(*[F.transform(suffixes, _followed_by(head)) for head in heads]))
    hits = F.filter(tried, lambda x: F.coalesce(F.map_contains_key(names, x), F.lit(False)))
    longest = F.array_max(F.transform(hits, lambda x: F.struct(F.length(x).alias("n"), x.alias("rule"))))["rule"]
    return F.when(longest.isNotNull(), F.struct(longest.alias("rule"), F.element_at(names, longest).alias("verdict")))


# --- mining -----------------------------------------------------------------------

@dataclass(frozen=True)
class UrlRules:
    """Mined rules (antecedent, probe, verdict, confidence, n_rows) and the majority's verdict."""

    rules: DataFrame
    otherwise: str


def lower_bound(hits: Column, of: Column, errors: float = ERRORS) -> Column:
    """Wilson's lower bound of a share."""
    z = F.lit(errors * errors)
    share = hits / of
    return (share + z / (2 * of) - F.lit(errors) * F.sqrt((share * (1 - share) + z / (4 * of)) / of)) / (1 + z / of)


def mine(
    labelled: DataFrame, tokens: str = "tokens", verdict: str = "verdict", least_share: float = LEAST_SHARE,
    least_rows: int = LEAST_ROWS, least_confidence: float = LEAST_CONFIDENCE, least_gain: float = LEAST_GAIN,
    least_bound: float = LEAST_BOUND,
) -> UrlRules:
    """Rules from all labelled rows; those without a verdict are not labelled."""
    rows = stored(labelled.where(F.col(verdict).isin(*VERDICTS)).select(
        F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens"), F.col(verdict).alias("verdict")), "labelled")
    by = {r["verdict"]: r["n"] for r in rows.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(by.values())
    otherwise = max(VERDICTS, key=lambda v: (by.get(v, 0), v == "allow"))
    shape = "antecedent array<string>, probe string, verdict string, confidence double, n_rows long"
    if not total:
        return UrlRules(rows.sparkSession.createDataFrame([], shape), otherwise)
    # at most tokens-a-row / COMMON_SHARE of them exist
    common = [r["t"] for r in rows.select(F.explode("tokens").alias("t")).groupBy("t").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") > COMMON_SHARE * total).collect()]
    items = rows.select(F.concat(
        F.array_except(F.array_distinct("tokens"), F.array(*map(F.lit, common)).cast("array<string>")),
        F.array(F.concat(F.lit("verdict="), "verdict"))).alias("items"))
    share = min(1.0, max(least_share, least_rows / total))
    sets = stored(FPGrowth(itemsCol="items", minSupport=share).fit(items).freqItemsets.select(
        F.array_sort("items").alias("items"), "freq"), "itemsets")

    label = F.filter("items", lambda x: x.startswith("verdict="))
    rest = F.array_except("items", label)
    ruled = sets.where(F.size(label) == 1).select(rest.alias("antecedent"), F.substring(label[0], 9, 9).alias("verdict"), F.col("freq").alias("n_rows"))
    plain = sets.where(F.size(label) == 0).select(F.col("items").alias("antecedent"), F.col("freq").alias("n_all")).union(
        rows.sparkSession.createDataFrame([([], total)], "antecedent array<string>, n_all long"))
    judged = stored(ruled.join(plain, "antecedent").withColumn("confidence", F.col("n_rows") / F.col("n_all")), "judged")
    # the rules that leave one token out
    sure = judged.where(
        (F.col("confidence") >= least_confidence) & (F.size("antecedent") > 0)
        & (lower_bound(F.col("n_rows"), F.col("n_all")) >= least_bound))
    shorter = sure.select("antecedent", "verdict", F.explode(
        F.transform("antecedent", lambda t: F.array_remove("antecedent", t))).alias("without"))
    base = judged.select(F.col("antecedent").alias("without"), "verdict", F.col("confidence").alias("c"))
    best = shorter.join(base, ["without", "verdict"], "left").groupBy("antecedent", "verdict").agg(
        F.coalesce(F.max("c"), F.lit(0.0)).alias("known"))
    kept = sure.join(best, ["antecedent", "verdict"]).where(F.col("confidence") >= F.col("known") + least_gain)
    # the rarest token of each rule
    single = plain.where(F.size("antecedent") == 1).select(F.col("antecedent")[0].alias("t"), "n_all")
    probes = kept.select("antecedent", "verdict", F.explode("antecedent").alias("t")).join(single, "t").groupBy(
        "antecedent", "verdict").agg(F.min(F.struct("n_all", "t"))["t"].alias("probe"))
    out = kept.join(probes, ["antecedent", "verdict"]).select("antecedent", "probe", "verdict", "confidence", "n_rows")
    return UrlRules(stored(out, "rules"), otherwise)


# --- matching ---------------------------------------------------------------------

def _rank(rule: Column) -> Column:
    """The order of rules that fit: surer, of more rows, shorter, then by their tokens."""
    return F.struct(
        rule["confidence"].alias("confidence"), rule["n_rows"].alias("n_rows"), (-F.size(rule["antecedent"])).alias("size"),
        F.array_join(rule["antecedent"], "\n").alias("tokens"), rule["verdict"].alias("verdict"))


def with_verdict(pages: DataFrame, mined: UrlRules, url: str = "url", index_rules: int = INDEX_RULES) -> DataFrame:
    """Pages with the struct `mined`: the rule that decides and its verdict.

    Rules are counted first. A short list is put, as an index from probe to rules, into
    every task as one value, and no row moves. A longer one is joined with the tokens of
    the distinct URLs. Both give the same result.
    """
    fields = F.struct("antecedent", "verdict", "confidence", "n_rows")
    kind = "struct<confidence: double, n_rows: long, size: int, tokens: string, verdict: string>"
    if mined.rules.limit(index_rules + 1).count() <= index_rules:
        index = mined.rules.groupBy("probe").agg(F.collect_list(fields).alias("rules")).agg(
            F.map_from_entries(F.collect_list(F.struct("probe", "rules"))).alias("index"))
        held = pages.withColumns({"_index": index.scalar(), "_tokens": tokens_of(F.col(url))})
        met = F.flatten(F.transform("_tokens", lambda t: F.coalesce(F.try_element_at("_index", t), F.array().cast(
            "array<struct<antecedent: array<string>, verdict: string, confidence: double, n_rows: long>>"))))
        fit = F.filter(met, lambda r: F.size(F.array_except(r["antecedent"], "_tokens")) == 0)
        return held.withColumn("mined", F.array_max(F.transform(fit, _rank)).cast(kind)).drop("_index", "_tokens")
    urls = pages.select(F.col(url).alias("_url")).where("_url is not null").distinct()
    each = urls.withColumn("_tokens", tokens_of(F.col("_url"))).withColumn("probe", F.explode("_tokens"))
    index = mined.rules.select("probe", fields.alias("_rule"))
    met = each.join(small_or_shuffled(index), "probe").where(F.size(F.array_except("_rule.antecedent", "_tokens")) == 0)
    best = met.groupBy("_url").agg(F.max(_rank(F.col("_rule"))).cast(kind).alias("mined"))
    return pages.join(best, F.col(url) == F.col("_url"), "left").drop("_url")


def filtered(
    pages: DataFrame, mined: UrlRules, url: str = "url",
    rules: "list[tuple[str, str, str]]" = RULES, index_rules: int = INDEX_RULES,
) -> DataFrame:
    """Pages with host, path, rule, verdict and the mined rule's tokens and confidence.

    Columns of these names are replaced.
    """
    plain = pages.drop("host", "path", "rule", "verdict", "mined", "stated", "tokens", "confidence")
    judged = with_verdict(plain, mined, url, index_rules)
    parts = judged.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    stated = parts.withColumn("stated", stated_rule(F.col("host"), F.col("path"), rules))
    return stated.withColumns({
        "rule": F.col("stated.rule"),
        "verdict": F.coalesce("stated.verdict", "mined.verdict", F.lit(mined.otherwise)),
        "tokens": F.when(F.col("stated").isNull(), F.col("mined.tokens")),
        "confidence": F.when(F.col("stated").isNull(), F.col("mined.confidence")),
    }).drop("stated", "mined")


def page_labels(pages: DataFrame, labels: DataFrame, seeds: "list[str]" = SEED_WORDS) -> DataFrame:
    """(tokens, verdict) of the pages that are labelled.

    A page takes the label of the row of `labels` with its id, `block` for low quality or
    toxicity; a page whose host has a seed word is to be blocked in any case.
    """
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    good = (F.col("toxic") == 0) | (F.col("quality") == 1)
    by_id = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(
        F.when(bad, "block").when(good, "allow")).alias("verdict"))
    joined = pages.select("page_id", "url").join(by_id, "page_id", "left").withColumn("tokens", tokens_of(F.col("url")))
    seeded = F.arrays_overlap("tokens", F.array(*[F.lit(f"word:{w}") for w in seeds]).cast("array<string>"))
    return joined.select("tokens", F.when(seeded, "block").otherwise(F.col("verdict")).alias("verdict")).where("verdict is not null")


def url_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    mined = mine(page_labels(pages, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return filtered(pages, mined).select("page_id", "host", "path", "rule", "verdict")
