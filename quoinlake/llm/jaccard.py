"""Exact similarity join of shingle sets, with set relations to skip work.

Documents with equal sets are one set. Sets share index lists of the rarest shingles of
each (the prefix that a partner must meet). Two relations save comparisons:

* *Index level.* A list is cut into blocks by set size; blocks whose sizes rule the overlap
  out are never joined, and sets whose sizes or positions of the shingle do make no pair.
* *Answer level.* Each list has a pivot, the one of its sets that is in the most lists for its size:
  among near copies that is one close to their centre, which links most of them at once. Sets are
  compared with their pivots first, and the overlaps found are kept. For two sets x, y with the same pivot p they bound the
  overlap of x and y: at most |p∩y| + |x\\p|, at least |p∩x| + |p∩y| - |p|. Pairs that
  the bounds decide are not compared again, and pairs already in one component are not
  even listed. A group of near copies around one pivot costs a comparison a member.

The links of each set are counted only where they are asked for, as that takes every pair of
a component: the sets of each are dealt to blocks, and a task multiplies the incidence
matrices of two blocks, so that every pair is counted and none is stored.

Any order of shingles gives the same result. Frequent shingles come last: every task counts
the shingles of its sets, those met more than once are summed over all tasks, and up to
`MOST_HOT` of the most frequent are ranked; this bounds what is broadcast, at 16 MB, and
missing ones only cost time. Sets to compare are picked by a bit table of fixed size.

Defined results: NULL and blank texts have an empty set and link with nothing; equal sets
always link; a NULL id is carried along and never names a component that has another id;
rows that repeat an id are judged by their own texts; an empty table gives no rows.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoinlake.llm.graph import components
from quoinlake.llm.shingles import U64, mix, shingle_sets
from quoinlake.workspace import stored

PERCENT = 80
HOT, MOST_HOT = 32, 1 << 20
PIVOTS = 2
EXTRA = 0.02
BIT_WORDS = 1 << 20  # 64-bit words of the bit table
#: Members in a block of a component when links are counted, blocks before they grow, and the most that one holds.
BLOCK, BLOCKS, LARGEST_BLOCK = 1 << 16, 16, 1 << 19
COLUMNS = 2048


def signature(s: np.ndarray) -> int:
    """64-bit name of a set: a sum of mixed members, so equal sets have equal names."""
    x = np.array([mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64) + U64(len(s))], U64)
    return int(mix(x).view(np.int64)[0])


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """So many of the first members hold one that any partner has too."""
    return n - (n * percent + 99) // 100 + 1


def enough(overlap: Column, n: Column, m: Column, percent: int = PERCENT) -> Column:
    """100 * intersection >= percent * union."""
    return overlap * (100 + percent) >= (n + m) * percent


def _few(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that the texts and sets of only a few become objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _batch(**columns) -> pa.RecordBatch:
    """Columns of (values, Arrow type)."""
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: each document with its set's size and name; kind 1: shingles met more than once."""
    seen, held, count = set(), [], 0

    def rows(kind: int, ids, sizes, names, hashes) -> pa.RecordBatch:
        return _batch(
            kind=(np.full(len(sizes), kind, np.int32), pa.int32()), doc_id=(ids, pa.int64()), n=(sizes, pa.int64()),
            name=(names, pa.int64()), text_hash=(hashes, pa.int64()),
        )

    def repeated() -> pa.RecordBatch:
        token, times = np.unique(np.concatenate(held), return_counts=True)
        token, times = token[times > 1], times[times > 1]
        return rows(1, [None] * len(token), times, token.view(np.int64), [None] * len(token))

    for part in _few(batches):
        sets = shingle_sets(part.column("text").to_pylist())
        names = [signature(s) if len(s) else None for s in sets]
        yield rows(0, part.column("doc_id").to_pylist(), [len(s) for s in sets], names, part.column("text_hash").to_pylist())
        for name, s in zip(names, sets):
            if len(s) and name not in seen:
                seen.add(name)
                held.append(s)
                count += len(s)
        if count > 2_000_000:
            yield repeated()
            held, count = [], 0
    if held:
        yield repeated()


def described(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, name, text_hash) of all documents, and the hot shingles (token, times)."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    found = stored(rows.mapInArrow(_describe, "kind int, doc_id long, n long, name long, text_hash long"), "sets")
    hot = found.where("kind = 1").groupBy(F.col("name").alias("token")).agg(F.sum("n").alias("times"))
    hot = hot.where(F.col("times") >= HOT).orderBy(F.desc("times"), "token").limit(MOST_HOT)
    return found.where("kind = 0").drop("kind"), hot


def index_rows(docs: DataFrame, key: str, text: str, hot: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(token, name, n, pos): the prefix of each set, once, dealt out by token. Tasks leave repeats out, and so does what they sum up to."""
    ranked = hot.toArrow().to_pandas()
    order = np.argsort(ranked["token"].to_numpy().view(U64), kind="stable")
    shared = docs.sparkSession.sparkContext.broadcast((
        ranked["token"].to_numpy().view(U64)[order], ranked["times"].to_numpy(np.int64)[order]
    ))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, times = shared.value
        seen = set()
        for part in _few(batches):
            parts = []
            for s in shingle_sets(part.column("text").to_pylist()):
                name = signature(s) if len(s) else None
                if name is None or name in seen:
                    continue
                seen.add(name)
                k = prefix_length(len(s), percent)
                if len(token):
                    at = np.minimum(np.searchsorted(token, s), len(token) - 1)
                    is_hot = token[at] == s
                    if is_hot[: 2 * k].any():
                        s = s[np.argsort(np.where(is_hot, times[at], 0), kind="stable")]
                parts.append((s[:k], name, len(s)))
            if parts:
                sizes = [len(p[0]) for p in parts]
                yield _batch(
                    token=(np.concatenate([p[0] for p in parts]).view(np.int64), pa.int64()),
                    name=(np.repeat([p[1] for p in parts], sizes), pa.int64()),
                    n=(np.repeat(np.array([p[2] for p in parts], np.int32), sizes), pa.int32()),
                    pos=(np.concatenate([np.arange(x, dtype=np.int32) for x in sizes]), pa.int32()),
                )

    found = docs.select(F.col(text).alias("text")).mapInArrow(prefixes, "token long, name long, n int, pos int")
    return found.repartition("token").dropDuplicates(["token", "name"])


def pivot_lists(rows: DataFrame) -> DataFrame:
    """The rows of shingles met in several sets, with the `pivot` of each; stored.

    Most shingles of a prefix are in one set only. Their rows move once, with all others, and end here.
    """
    several = rows.withColumn("sets", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("sets > 1").drop("sets")
    several = stored(several, "shared")
    share = several.groupBy("name").agg((F.count(F.lit(1)) / F.max("n")).alias("share"))
    pivots = several.join(share, "name").groupBy("token").agg(F.min(F.struct(-F.col("share"), "name")).alias("first"))
    return stored(several.join(pivots.select("token", F.col("first.name").alias("pivot")), "token"), "lists")


def bit_table(hashed: DataFrame) -> np.ndarray:
    """Bits of the numbers `h` below 64 * BIT_WORDS: at most BIT_WORDS rows come to the driver, however many they are."""
    words = hashed.groupBy(F.expr("shiftright(h, 6)").cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")
    ).toArrow()
    table = np.zeros(BIT_WORDS, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return table


def members(docs: DataFrame, key: str, text: str, sets: DataFrame, names: DataFrame) -> DataFrame:
    """(name, members) of the named sets, stored: one document of each is read again, its hashes cut to 48 bits."""
    firsts = sets.groupBy("name").agg(F.min("doc_id").alias("id"))
    wanted = stored(names.join(firsts, "name"), "wanted")
    spark = docs.sparkSession
    hashed = wanted.select(F.pmod(F.xxhash64("id"), F.lit(64 * BIT_WORDS)).alias("h"))
    bits = spark.sparkContext.broadcast(bit_table(hashed))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for part in _few(batches):
            h = part.column("h").to_numpy()
            part = part.filter(pa.array((bits.value[h >> 6] >> (h & 63)) & 1 == 1))
            out = []
            for s in shingle_sets(part.column("text").to_pylist()):
                name = signature(s) if len(s) else None
                if name is not None and name not in seen:
                    seen.add(name)
                    cut = np.unique(s >> U64(16)).view(np.uint8).reshape(-1, 8)[:, :6]
                    out.append((name, cut.tobytes()))
            yield _batch(name=([x[0] for x in out], pa.int64()), members=([x[1] for x in out], pa.binary()))

    rows = docs.select(
        F.col(text).alias("text"),
        F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(64 * BIT_WORDS)).alias("h"),
    )
    found = rows.mapInArrow(read, "name long, members binary")
    return stored(found.join(wanted.select("name"), "name", "left_semi").dropDuplicates(["name"]), "members")


def unpack(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view(U64).ravel()


def overlaps(docs: DataFrame, key: str, text: str, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add the exact `overlap` to pairs (x, y) of set names; stored. The join splits the rows of a hot pivot."""
    wanted = pairs.select(F.col("x").alias("name")).union(pairs.select("y")).distinct()
    found = members(docs, key, text, sets, wanted)

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _few(batches, 50):
            sides = zip(part.column("of_x").to_pylist(), part.column("of_y").to_pylist())
            n = [len(np.intersect1d(unpack(a), unpack(b), True)) for a, b in sides]
            yield pa.RecordBatch.from_arrays([part.column("x"), part.column("y"), pa.array(n, pa.int64())], ["x", "y", "overlap"])

    joined = pairs.select("x", "y").join(found.toDF("x", "of_x"), "x").join(found.toDF("y", "of_y"), "y")
    counted = joined.mapInArrow(common, "x long, y long, overlap long")
    return stored(pairs.join(counted, ["x", "y"]), "overlaps")


def linked_counts(of: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, split: int, percent: int) -> np.ndarray:
    """Links of each set to others; with `split`, only those between sets before and from that number.

    `of` is the number of the set that each hash is of, in ascending order.
    """
    _, column, times = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    of, column = of[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    k = len(sizes)
    left, right = (slice(0, split), slice(split, k)) if split else (slice(0, k), slice(0, k))
    both = np.zeros((left.stop - left.start, right.stop - right.start), np.float64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        grid = np.zeros((k, COLUMNS), np.float32)
        grid[of[a:b], column[a:b] - first] = 1
        both += grid[left] @ grid[right].T
    n = sizes.astype(np.float64)
    linked = (both > 0) & (both * (100 + percent) >= (n[left, None] + n[None, right]) * percent)
    if split:
        return np.concatenate([linked.sum(axis=1), linked.sum(axis=0)])
    np.fill_diagonal(linked, False)
    return linked.sum(axis=1)


def link_counts(docs: DataFrame, key: str, text: str, named: DataFrame, sizes: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(name, n_links): how many other sets each set of a component is similar to, by all its pairs."""
    own = roots.toDF("name", "root").distinct().join(sizes, "name")
    extent = own.groupBy("root").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    blocks = F.greatest(F.least(F.ceil(F.col("total") / BLOCK), F.lit(BLOCKS)), F.ceil(F.col("total") / LARGEST_BLOCK))
    own = own.join(extent.select("root", F.least(blocks, "k").alias("blocks")), "root")
    own = own.withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")))
    rows = own.join(members(docs, key, text, named, own.select("name")), "name").withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    rows = rows.select(
        "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "name", "n", "members"
    )

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", kind="stable")
        split = int((pdf["block"] == pdf["i"]).sum()) if pdf["i"].iloc[0] != pdf["j"].iloc[0] else 0
        if pdf["i"].iloc[0] != pdf["j"].iloc[0] and split in (0, len(pdf)):
            return pd.DataFrame({"name": pdf["name"], "links": 0})
        sets = [unpack(m) for m in pdf["members"]]
        of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        links = linked_counts(of, np.concatenate(sets), pdf["n"].to_numpy(), split, percent)
        return pd.DataFrame({"name": pdf["name"], "links": links})

    counted = rows.groupBy("root", "i", "j").applyInPandas(count, "name long, links long")
    return counted.groupBy("name").agg(F.sum("links").alias("n_links"))


def pivot_pairs(lists: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Each set with the pivots of most of its lists (x below y)."""
    met = lists.where("name <> pivot").groupBy("name", "pivot", "n").agg(F.count(F.lit(1)).alias("met"))
    order = Window.partitionBy("name").orderBy(F.desc("met"), "pivot")
    met = met.where(F.col("met") * 1000 >= F.col("n") * (100 - percent)).withColumn("r", F.row_number().over(order))
    met = met.where(F.col("r") <= PIVOTS).select(F.col("pivot").alias("x"), F.col("name").alias("y"), F.col("n").alias("m"))
    met = met.join(sizes.toDF("x", "n"), "x")
    return met.where(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent).select("x", "y", "n", "m")


def _tight(n: str, m: str, percent: int) -> Column:
    """So many first members of a set of size n hold one that a partner of size m has in as many of its own."""
    needed = F.ceil((F.col(n) + F.col(m)) * percent / (100 + percent))
    return F.col(n) - needed + 1


def _reach(n: str, m: str, percent: int) -> Column:
    """The tight prefix and 2 % more: every member beyond it is one more that the two must share."""
    longest = F.col(n) - F.ceil(F.col(n) * percent / 100) + 1
    return F.least(longest, _tight(n, m, percent) + F.ceil(F.least(n, m) * EXTRA))


def stray_pairs(lists: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that meet in a list, with all that the lists tell.

    One of the two is not in the component of the list's pivot: only such strays probe.
    """
    own = lists.join(roots.toDF("name", "root"), "name", "left")
    own = own.join(roots.toDF("pivot", "pivot_root"), "pivot", "left")
    own = own.withColumn("root", F.coalesce("root", "name")).withColumn(
        "stray", F.col("root") != F.coalesce("pivot_root", "pivot")
    )
    base = 104 / percent  # sizes of partners are in the same or the next block
    block = lambda n: F.floor(F.log(n) / F.log(F.lit(base)))
    own = own.select("token", "name", "n", "pos", "root", "stray").withColumn("by_n", block(F.col("n")))
    right = own.select(
        "token", "by_n", F.col("name").alias("y"), F.col("n").alias("m"), F.col("pos").alias("q"), F.col("root").alias("y_root"),
        F.col("stray").alias("y_stray"),
    )
    left = own.where("stray").select(
        "token", F.col("name").alias("x"), "n", F.col("pos").alias("p"), F.col("root").alias("x_root"),
        F.explode(F.array(*[F.col("by_n") + i for i in (-1, 0, 1)])).alias("by_n"),
    )
    both = F.least("p", "q") + 1 + F.least(F.col("n") - F.col("p"), F.col("m") - F.col("q")) - 1
    reach_x, reach_y = _reach("n", "m", percent), _reach("m", "n", percent)
    rule = (
        (F.col("x_root") != F.col("y_root")) & (~F.col("y_stray") | (F.col("x") < F.col("y")))
        & (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent)
        & (F.col("p") < reach_x) & (F.col("q") < reach_y) & enough(both, F.col("n"), F.col("m"), percent)
    )
    met = left.join(right, (left["token"] == right["token"]) & (left["by_n"] == right["by_n"]) & rule).groupBy(
        F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"),
        F.when(F.col("x") < F.col("y"), F.col("n")).otherwise(F.col("m")).alias("n"),
        F.when(F.col("x") < F.col("y"), F.col("m")).otherwise(F.col("n")).alias("m"),
    ).agg(F.count(F.lit(1)).alias("met"))
    tight_x, tight_y = _tight("n", "m", percent), _tight("m", "n", percent)
    return met.where(F.col("met") > F.least(reach_x - tight_x, reach_y - tight_y))


def decide(pairs: DataFrame, answers: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Bounds of the overlap of x and y from their overlaps with one pivot: `low` and `high`."""
    # A set has the answers of its few pivots and of itself, at most PIVOTS + 1; a pivot's list of members is not looked up.
    flat = answers.select("y", "x", "overlap").union(sizes.select("name", "name", "n")).toDF("of", "pivot", "overlap")
    known = flat.join(sizes.toDF("pivot", "size"), "pivot").groupBy("of").agg(
        F.collect_list(F.struct("pivot", "overlap", "size")).alias("known"))
    both = pairs.join(known.toDF("x", "of_x"), "x").join(known.toDF("y", "of_y"), "y")

    def common(bound) -> Column:
        return F.flatten(F.transform("of_x", lambda a: F.transform(
            F.filter("of_y", lambda b: b["pivot"] == a["pivot"]), lambda b: bound(a["overlap"], b["overlap"], a["size"]))))

    return both.select(
        *pairs.columns,
        F.array_max(common(lambda a, b, size: a + b - size)).alias("low"),
        F.array_min(common(lambda a, b, size: F.least(b + F.col("n") - a, a + F.col("m") - b))).alias("high"),
    )


def linked_sets(docs: DataFrame, key: str, text: str, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows' sets (doc_id, n, name, text_hash), their sizes (name, n), and (node, root) of the sets that have links."""
    sets, hot = described(docs, key, text)
    named = sets.where("name is not null")
    sizes = stored(named.groupBy("name").agg(F.min("n").alias("n")), "sizes")
    lists = pivot_lists(index_rows(docs, key, text, hot, percent))

    n, m = F.col("n"), F.col("m")
    answers = overlaps(docs, key, text, named, pivot_pairs(lists, sizes, percent))
    links = answers.where(enough(F.col("overlap"), n, m, percent)).select("x", "y")
    roots = components(links, "x", "y")
    pairs = stored(decide(stray_pairs(lists, roots, percent), answers, sizes, percent), "pairs")
    derived = pairs.where(enough(F.col("low"), n, m, percent)).select("x", "y")
    doubt = pairs.where(
        (F.col("low").isNull() | ~enough(F.col("low"), n, m, percent))
        & (F.col("high").isNull() | enough(F.col("high"), n, m, percent))
    ).select("x", "y", "n", "m")
    checked = overlaps(docs, key, text, named, doubt).where(enough(F.col("overlap"), n, m, percent)).select("x", "y")
    links = stored(links.union(derived).union(checked), "edges")
    return sets, sizes, components(links, "x", "y")


def similar_components(docs: DataFrame, key: str, text: str, percent: int = PERCENT, count_links: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id[, n_links]) for every row of `docs`.

    `n_links` is the number of other sets that the row's set is similar to. It takes the work
    of all pairs of each component, many times that of finding the components.
    """
    sets, sizes, roots = linked_sets(docs, key, text, percent)
    named = sets.where("name is not null")
    firsts = named.groupBy("name").agg(F.min("doc_id").alias("first"))
    firsts = firsts.join(roots.toDF("name", "root"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    least = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = firsts.join(least, "root").select("name", "component_id")
    if count_links:
        degree = link_counts(docs, key, text, named, sizes, roots, percent)
        labels = labels.join(degree, "name", "left")
    return sets.join(labels, "name", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
        *([F.coalesce("n_links", F.lit(0)).alias("n_links")] if count_links else []))


def jaccard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: of each component the first row by id and text stays.

    Each row is judged by its own text, whatever rows share its id; rows without words have
    no component and stay, as do rows without an id, which are not judged.
    """
    sets, _, roots = linked_sets(docs.where("doc_id is not null"), "doc_id", "text")
    own = sets.join(roots.toDF("name", "root"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    first = own.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"))
    row = [F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64("text").alias("_hash")]
    rows = docs.where("doc_id is not null").select("*", *row)
    kept = rows.join(first.select(F.col("row.doc_id").alias("_id"), F.col("row.text_hash").alias("_hash")), ["_id", "_hash"], "left_semi")
    order = Window.partitionBy("_id", "_hash").orderBy("text")
    one = kept.withColumn("_row", F.row_number().over(order)).where("_row = 1").select(*docs.columns)
    blank = sets.where("name is null").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    wordless = rows.join(blank, ["_id", "_hash"], "left_semi").select(*docs.columns)
    return one.unionByName(wordless).unionByName(docs.where("doc_id is null"))
