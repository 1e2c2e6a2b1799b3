"""Benchmark decontamination by templates.

Numbers, names (capitals within a sentence) and units (after a number) become typed
placeholders, so that a question asked again with other values keeps its template. Windows
of five template words are joined by hash with those of the benchmark. Matches of a
document and an item at one distance form a run. Of a run, the windows count that have
equal values or none, and those whose slots are consistent: each value of the item stands
for the value of the document that it meets most often in the run, and no two names or
units for the same one (two numbers may become equal). A document is contaminated by an
item if such windows make at least half of the item's windows, and at least four of them
or all.

Items of at most four such windows are also looked for by their literal words, five at a
time, or all of them if they are fewer, so that a copy of any item with a word is found.

Documents are read once. Of their windows only those leave a task whose bit is set in a
table of fixed size made of the benchmark's hashes, so what is joined by shuffle is about
as much as what matches, however large the benchmark grows.

Defined results: NULL and empty texts match nothing; an item of fewer than five words is
one literal window; each row is judged by its own text, whatever
rows share its id or have none; repeated items are one; extra columns are ignored by the report
and kept by the filter; either table may be empty.
"""

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoinlake.llm.carried import carried
from quoinlake.llm.jaccard import BIT_WORDS, bit_table
from quoinlake.llm.shingles import LANES, U64, WORDS, mix
from quoinlake.llm.wordscan import in_batches, scan
from quoinlake.operators.sizing import small_or_shuffled
from quoinlake.workspace import stored

SHARE, LEAST, PLAIN_WORDS = 0.5, 4, 3
NUMBER, NAME, UNIT, LITERAL = (U64(x) for x in (0xA4093822299F31D0, 0x082EFA98EC4E6C89, 0x452821E638D01377, 0xBE5466CF34E90C6C))
UNIT_WORDS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "kilometre kilometres centimeter centimeters mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton "
    "tons ml l liter liters litre litres gallon gallons s sec min h hr hour hours minute minutes second seconds day days week "
    "weeks month months year years dollar dollars euro euros cent cents percent degree degrees mph kmh kb mb gb tb watt watts kw "
    "volt volts hz"
).split()
_UNITS = np.sort(scan(UNIT_WORDS).hashes)
WINDOW = "h long, pos int, slots array<string>"


def _bit(wanted: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    low = (hashes & U64(64 * BIT_WORDS - 1)).astype(np.int64)
    return (wanted[low >> 6] >> (low & 63)) & 1 == 1


def literal_windows(texts: list, lengths: list[int], wanted: "np.ndarray | None" = None) -> Iterator[tuple[int, int, int, list[str]]]:
    """(text, window hash, position, no slots) of all windows of so many words as they stand, case folded."""
    for first, part in in_batches(texts):
        s = scan(part)
        of = np.searchsorted(s.bounds, np.arange(len(s.starts)), side="right") - 1
        for length in lengths:
            n = len(s.starts) - length + 1
            if n < 1:
                continue
            rolled = np.full(n, LITERAL + U64(length), U64)
            for j in range(length):
                rolled += s.hashes[j : j + n] * LANES[j]
            rolled = mix(rolled)
            ok = of[:n] == of[length - 1 :]
            if wanted is not None:
                ok &= _bit(wanted, rolled)
            for i in np.flatnonzero(ok):
                yield first + int(of[i]), int(rolled[i : i + 1].view(np.int64)[0]), int(i - s.bounds[of[i]]), []


def item_windows(texts: list) -> Iterator[tuple[int, int, int, list[str], int]]:
    """Template windows of each text, and literal ones where the former are few; the last column is the literal length or 0."""
    for i, text in enumerate(texts):
        own = [w[1:] for w in template_windows([text])]
        yield from ((i, *w, 0) for w in own)
        if len(own) <= LEAST:
            length = min(WORDS, len(scan([text]).starts))
            yield from ((i, *w[1:], length) for w in literal_windows([text], [length] if length else []))


def template_windows(texts: list, wanted: "np.ndarray | None" = None) -> Iterator[tuple[int, int, int, list[str]]]:
    """(text, window hash, position, values of its slots) of windows with enough plain words.

    With `wanted`, a bit table of hashes, only windows whose bit is set.
    """
    for first, part in in_batches(texts):
        s = scan(part)
        if len(s.starts) < WORDS:
            continue
        unit = np.zeros(len(s.starts), bool)
        after = np.flatnonzero(s.number[:-1]) + 1
        unit[after] = np.isin(s.hashes[after], _UNITS) & ~s.opens[after]
        name = s.capital & ~s.opens & ~s.number & ~unit & (s.ends - s.starts > 1)
        words = np.where(s.number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, s.hashes)))
        slot = s.number | unit | name
        n = len(words) - WORDS + 1
        rolled = np.zeros(n, U64)
        for j in range(WORDS):
            rolled += words[j : j + n] * LANES[j]
        rolled = mix(rolled)
        of = np.searchsorted(s.bounds, np.arange(len(words)), side="right") - 1
        plain = np.concatenate([[0], np.cumsum(~slot)])
        ok = (of[:n] == of[WORDS - 1 :]) & (plain[WORDS:] - plain[:n] >= PLAIN_WORDS)
        if wanted is not None:
            ok &= _bit(wanted, rolled)
        for i in np.flatnonzero(ok):
            values = [
                bytes(s.raw[s.starts[k] : s.ends[k]]).decode(errors="replace").lower() for k in range(i, i + WORDS) if slot[k]
            ]
            yield first + int(of[i]), int(rolled[i : i + 1].view(np.int64)[0]), int(i - s.bounds[of[i]]), values


def _row(key: Column, text: Column) -> Column:
    """Name of a row: rows of equal id and text have the same."""
    return F.concat_ws(":", F.coalesce(key.cast("bigint").cast("string"), F.lit("-")), F.xxhash64(text).cast("string"))


def _windows(df: DataFrame, key: str, text: str, wanted=None, lengths: "list[int] | None" = None) -> DataFrame:
    """Windows of documents by a bit table, with literal ones of the given lengths; without a table those of items."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = wanted.value if wanted is not None else None
        for pdf in batches:
            ids, names, texts = pdf["id"].tolist(), pdf["row"].tolist(), list(pdf["text"])
            if bits is None:
                found = item_windows(texts)
            else:
                found = ((*w, 0) for w in chain(template_windows(texts, bits), literal_windows(texts, lengths, bits)))
            rows = [(ids[i], names[i], *w) for i, *w in found]
            yield pd.DataFrame(rows, columns=["id", "row", "h", "pos", "slots", "literal"])

    rows = df.select(F.col(key).cast("bigint").alias("id"), _row(F.col(key), F.col(text)).alias("row"), F.col(text).alias("text"))
    rows, fields, back = carried(rows, ["id", "row"])
    return back(rows.mapInPandas(run, f"{fields}, {WINDOW}, literal int"))


def _keys(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"k_{c}") for c in columns]).distinct()


def _equal(prefix: str, columns: list[str]) -> Column:
    """Equality with a table of keys in which NULL is a value."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).eqNullSafe(F.col(f"{prefix}_{c}"))
    return out


def matches(docs: DataFrame, key: str, text: str, bench: DataFrame, item: str, item_text: str) -> DataFrame:
    """(doc_id, row, item_id, windows, item_windows, changed) of each document and item that it holds."""
    items = stored(_windows(bench.where(F.col(item).isNotNull()), item, item_text), "items").dropDuplicates(["id", "h", "pos"])
    spark = docs.sparkSession
    hashes = items.select(F.col("h").bitwiseAND(F.lit(64 * BIT_WORDS - 1)).alias("h")).distinct()
    lengths = [r[0] for r in items.where("literal > 0").select("literal").distinct().collect()]  # five at most
    found = _windows(docs, key, text, spark.sparkContext.broadcast(bit_table(hashes)), lengths)
    met = found.select(F.col("id").alias("doc_id"), "row", "h", F.col("pos").alias("at"), F.col("slots").alias("got")).join(
        items.select(F.col("id").alias("item_id"), "h", "pos", "slots", (F.col("literal") > 0).alias("literal")), "h"
    )
    met = stored(met.where(F.size("got") == F.size("slots")).withColumn("run", F.col("at") - F.col("pos")), "matches")
    run = ["row", "item_id", "literal", "run"]
    changed = met.where(F.col("slots") != F.col("got"))
    slots = lambda df, *cols: df.select(
        *cols, F.inline(F.arrays_zip(F.col("slots").alias("a"), F.col("got").alias("b")))
    ).toDF(*cols, "a", "b")
    times = slots(met.join(_keys(changed, run), _equal("k", run), "left_semi"), *run).groupBy(*run, "a", "b").agg(
        F.struct(F.count(F.lit(1)), (F.col("a") == F.col("b")).alias("same")).alias("times")
    )
    images = times.groupBy(*run, "a").agg(F.max_by("b", F.struct("times", "b")).alias("b"))
    sources = times.groupBy(*run, "b").agg(F.max_by("a", F.struct("times", "a")).alias("a"))
    fits = images.select(*run, "a", "b").where("a rlike '^[0-9]'").unionByName(
        images.select(*run, "a", "b").where("not a rlike '^[0-9]'").intersect(sources.select(*run, "a", "b"))
    )
    place = [*run, "pos", "at"]
    wrong = _keys(slots(changed, *place).join(fits.select(*[F.col(c).alias(f"k_{c}") for c in [*run, "a", "b"]]), _equal("k", [*run, "a", "b"]), "left_anti"), place)
    good = met.join(wrong, _equal("k", place) & (F.col("slots") != F.col("got")), "left_anti")
    held = good.groupBy("doc_id", "row", "item_id", "literal").agg(
        F.count_distinct("pos").alias("windows"), F.max((F.col("slots") != F.col("got")).cast("int")).alias("changed")
    )
    sizes = items.groupBy(F.col("id").alias("item_id"), (F.col("literal") > 0).alias("literal")).agg(F.count_distinct("pos").alias("item_windows"))
    held = held.join(sizes, ["item_id", "literal"])
    enough = (F.col("windows") >= SHARE * F.col("item_windows")) & (F.col("windows") >= F.least(F.lit(LEAST), F.col("item_windows")))
    told = F.min(F.struct("literal", "windows", "item_windows", (F.col("changed") == 1).alias("changed"))).alias("told")
    held = held.where(enough).groupBy("doc_id", "row", "item_id").agg(told)
    return held.select("doc_id", "row", "item_id", "told.windows", "told.item_windows", "told.changed")


def contaminated(docs: DataFrame, key: str, text: str, bench: DataFrame, item: str, item_text: str) -> DataFrame:
    """One row per row of `docs`: doc_id, n_items held, the smallest of them, and if values were changed."""
    held = matches(docs, key, text, bench, item, item_text).groupBy("row").agg(
        F.count(F.lit(1)).alias("n_items"), F.min("item_id").alias("item_id"), F.max("changed").alias("changed")
    )
    ids = docs.select(F.col(key).cast("bigint").alias("id"), _row(F.col(key), F.col(text)).alias("row"))
    return ids.join(held, "row", "left").select(
        F.col("id").alias("doc_id"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id",
        F.coalesce("changed", F.lit(False)).alias("changed"),
    )


def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents, a row for each item that one holds; `other_values` is 1 where slots differ."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = matches(docs, "doc_id", "text", bench, "item_id", "text")
    return found.select("doc_id", "item_id", "windows", "item_windows", F.col("changed").cast("int").alias("other_values"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents that hold a benchmark item go."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    held = matches(docs, "doc_id", "text", bench, "item_id", "text").select(F.col("row").alias("_held")).distinct()
    held = small_or_shuffled(stored(held, "held"))  # counted, so that the documents move only where names are many
    return docs.join(held, _row(docs["doc_id"], docs["text"]) == F.col("_held"), "left_anti")
