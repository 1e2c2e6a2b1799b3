"""Spelling variants: words that differ by one edit, grouped under their most frequent form.

Words are counted over all texts. Two of them are compared only where they can be near:
the first place at which two words differ lies in some interval of places, and what stands
before and behind that interval is equal in both. So every word joins one block for each
half of its places, named by the rest of it. A block of more than `BLOCK` words is divided:
each half of its interval makes smaller blocks, until one place is left, where at most one
word for each letter can meet. A pair meets in exactly one block, so counts just add up.

Within a block, padded matrices of code points are compared with each other at once: the
length of the common prefix plus that of the common suffix reaches the longer word's length
less one exactly if one code point is inserted, deleted or replaced.

Defined results: NULL text has no words, a NULL id is written as nothing before the colon;
rows that repeat an id are counted as often as they stand there; columns besides id and
text are not read; an empty table gives no rows. Words may be of any length.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoinlake.workspace import stored

LEAST_LETTERS, LEAST_COUNT, TYPO_EVERY, FORM_TIMES = 5, 3, 97, 2
#: Words of a block that are compared with each other; larger blocks are divided.
BLOCK = 256
#: Code points of one comparison, about the bytes it needs.
TILE = 1 << 21
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = "a-zÀ-ÿ"


def runs(text: Column, least: int = 1) -> Column:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF of at least `least` letters, A-Z folded."""
    return F.regexp_extract_all(F.translate(text, UPPER, UPPER.lower()), F.lit(f"([{LETTERS}]{{{least},}})"), F.lit(1))


def mistyped(doc_id: Column, run: Column, every: int = TYPO_EVERY) -> Column:
    """The run without one code point where its checksum with the document's id says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    less = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % every == 0, less).otherwise(run)


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, every: "int | None" = TYPO_EVERY,
) -> DataFrame:
    """(word, n) over all texts. `every` leaves words as they are if None."""
    run = docs.select(F.col(id_col).alias("id"), F.explode(runs(F.col(text_col), least_letters)).alias("run"))
    word = F.col("run") if every is None else mistyped(F.col("id"), F.col("run"), every)
    counted = run.select(word.alias("word")).where(F.length("word") >= least_letters).groupBy("word").agg(
        F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


# --- blocks ---------------------------------------------------------------------

def _named(df: DataFrame, intervals: Column) -> DataFrame:
    """One row for each interval [lo, hi) of places, with the hash of the rest of the word."""
    each = df.withColumn("i", F.explode(intervals)).select("word", "n", "size", "i.lo", "i.hi")
    head = F.substring("word", F.lit(1), F.col("lo"))
    tail = F.substring("word", F.length("word") - (F.col("size") - F.col("hi")) + 1, F.col("size"))
    return each.withColumn("block", F.xxhash64("size", "lo", "hi", head, F.lit("|"), tail))


def _interval(lo, hi) -> Column:
    return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def blocks(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """(word, n, size, lo, hi, block): every pair of near words shares exactly one block.

    `size` is the length of the longer word of a pair, so a word stands for its own length
    and for the next one. No block has more than `most` words, or it has one place left.
    """
    zero = F.lit(0)
    size = F.explode(F.array(F.length("word"), F.length("word") + 1))
    half = F.floor(F.col("size") / 2)
    start = words.select("word", "n", size.alias("size"))
    rows = stored(_named(start, F.array(_interval(zero, half), _interval(half, F.col("size")))), "blocks")
    done: list[DataFrame] = []
    while True:
        large = stored(rows.where("hi - lo > 1").groupBy("block").agg(F.count(F.lit(1)).alias("c")).where(
            F.col("c") > most).select("block"), "large")
        if large.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(large, "block", "left_anti"))
        mid = F.floor((F.col("lo") + F.col("hi")) / 2)
        split = rows.join(large, "block", "left_semi")
        rows = stored(_named(split, F.array(_interval(F.col("lo"), mid), _interval(mid, F.col("hi")))), "blocks")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


# --- tiles ----------------------------------------------------------------------

def _matrices(flat: np.ndarray, at: np.ndarray, length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points from the left and from the right, padded with 0."""
    places = np.arange(width)
    there = places < length[..., None]
    last = len(flat) - 1
    left = np.where(there, flat[np.minimum(at[..., None] + places, last)], 0)
    right = np.where(there, flat[np.clip(at[..., None] + length[..., None] - 1 - places, 0, last)], 0)
    return left.astype(np.uint8), right.astype(np.uint8)


def near_pairs(left: tuple, right: tuple, size, lo, hi) -> np.ndarray:
    """Which words of one block of matrices differ by one edit from which of the other.

    Each side is (from the left, from the right): words by places, more axes in front.
    True where the first difference lies in [lo, hi) and prefix plus suffix reach size - 1.
    """
    prefix = (left[0][..., :, None, :] != right[0][..., None, :, :]).argmax(-1)
    suffix = (left[1][..., :, None, :] != right[1][..., None, :, :]).argmax(-1)
    return (prefix >= lo) & (prefix < hi) & (prefix + suffix >= size - 1)


class _Rows:
    """Sorted rows of whole blocks and the search for near words in them."""

    def __init__(self, table: pa.Table):
        self.words = [w.encode("latin-1") for w in table["word"].to_pylist()]
        self.n = table["n"].to_numpy()
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.length)[:-1]]).astype(np.int64)
        self.flat = np.frombuffer(b"".join(self.words), np.uint8)
        order = sorted(range(len(self.words)), key=lambda i: (-self.n[i], self.words[i]))
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.order = np.array(order)
        self.size, self.lo, self.hi = (table[c].to_numpy().astype(np.int64) for c in ("size", "lo", "hi"))
        block = table["block"].to_numpy()
        self.starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        self.counts = np.diff(np.concatenate([self.starts, [len(block)]]))

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """For each row the number of near words in its block, and the best one's row or -1."""
        count, best = np.zeros(len(self.words), np.int64), np.full(len(self.words), len(self.words))
        shape = 2
        while shape // 2 < self.counts.max(initial=0):
            chosen = np.flatnonzero((self.counts > shape // 2) & (self.counts <= shape))
            chosen = chosen[np.argsort(self.size[self.starts[chosen]], kind="stable")]
            while len(chosen):
                width = int(self.size[self.starts[chosen[0]]])
                most = max(1, TILE // (shape * shape * width))
                # blocks of about the same length of words are padded to the longest of them
                take = int(np.searchsorted(self.size[self.starts[chosen[:most]]], 2 * width, "right"))
                self._compare(chosen[: max(1, take)], shape, count, best)
                chosen = chosen[max(1, take):]
            shape *= 2
        return count, np.where(count > 0, self.order[np.minimum(best, len(self.words) - 1)], -1)

    def _compare(self, chosen: np.ndarray, shape: int, count: np.ndarray, best: np.ndarray) -> None:
        first, many = self.starts[chosen], self.counts[chosen]
        shape = int(many.max())
        rows = first[:, None] + np.arange(shape)
        real = np.arange(shape) < many[:, None]
        rows = np.where(real, rows, first[:, None])
        width = int(self.size[first].max())
        edge = shape if len(first) * shape * shape * width <= 4 * TILE else max(1, int((TILE / width) ** 0.5))
        size, lo, hi = (x[first][:, None, None] for x in (self.size, self.lo, self.hi))
        for a in range(0, shape, edge):
            ra, ka = rows[:, a : a + edge], real[:, a : a + edge]
            left = _matrices(self.flat, self.at[ra], self.length[ra], width)
            for b in range(0, shape, edge):
                rb, kb = rows[:, b : b + edge], real[:, b : b + edge]
                right = left if a == b else _matrices(self.flat, self.at[rb], self.length[rb], width)
                hit = near_pairs(left, right, size, lo, hi) & ka[:, :, None] & kb[:, None, :] & (ra[:, :, None] != rb[:, None, :])
                np.add.at(count, ra[ka], hit.sum(-1)[ka])
                rank = np.where(hit, self.rank[rb][:, None, :], len(self.words)).min(-1)
                np.minimum.at(best, ra[ka], rank[ka])


def _near_of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of rows that come sorted by block; the last block waits for its end."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch["block"].to_numpy()
        if kept and kept[-1]["block"][0].as_py() != block[0]:
            yield from _answers(kept)
            kept = []
        start = int(np.searchsorted(block, block[-1]))
        if start:
            yield from _answers([*kept, batch.slice(0, start)])
            kept = []
        kept.append(batch.slice(start))
    if kept:
        yield from _answers(kept)


def _answers(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = _Rows(pa.Table.from_batches(parts))
    count, best = rows.near()
    hits = np.flatnonzero(count)
    if len(hits):
        text = [rows.words[i].decode("latin-1") for i in hits]
        yield pa.RecordBatch.from_arrays(
            [pa.array(text), pa.array(count[hits]), pa.array(rows.n[best[hits]]),
             pa.array([rows.words[i].decode("latin-1") for i in best[hits]])],
            ["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best) of every word that has a near one.

    `best` is the near word of largest n, the first in code-point order among equals.
    """
    found = blocks(words, most).repartition("block").sortWithinPartitions("block").mapInArrow(
        _near_of_partition, "word string, n_near long, best_n long, best string")
    least = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), least.alias("b")).select(
        "word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


# --- forms ----------------------------------------------------------------------

def roots(links: DataFrame) -> DataFrame:
    """(word, root) for (word, form) links, followed to their ends by doubling.

    A form has at least twice the count of its word, so there is no circle and the number
    of rounds is at most the logarithm of that of the largest count.
    """
    now = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(now.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def spelling_forms(words: DataFrame, times: int = FORM_TIMES, most: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for words with their counts."""
    near = near_words(words, most)
    found = F.when(F.col("best_n") >= times * F.col("n"), F.col("best"))
    judged = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), found.alias("form"),
        F.when(found.isNotNull(), F.col("best_n")).alias("form_n")), "judged")
    root = roots(judged.where("form is not null"))
    return judged.join(root, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = stored(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")), "words")
    return spelling_forms(words)


#: CRC-32 of a text in SQL: the fixed table of its polynomial, and the bytes folded one by one.
CRC_TABLE_SQL = """crc as (
  select list(v order by i) as tab from (
    select i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
      lambda v, s: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end) as v
    from (select unnest(range(256)) as i)))"""


def crc_sql(text: str, table: str = "crc.tab") -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of an SQL text, with CRC_TABLE_SQL joined in."""
    hexed = f"hex(encode({text}))"
    octets = f"list_transform(range(length({hexed}) // 2), lambda k: ('0x' || substr({hexed}, (2 * k + 1)::bigint, 2))::bigint)"
    return (f"xor(list_reduce(list_prepend(4294967295::bigint, {octets}), "
            f"lambda c, b: xor(c >> 8, {table}[xor(c & 255, b) + 1])), 4294967295)")


SPELLING_SQL = f"""with recursive {CRC_TABLE_SQL},
run as (
  select doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[{LETTERS}]+')) as run from documents),
long as (select *, coalesce(doc_id::varchar, '') || ':' || run as named from run where length(run) >= {LEAST_LETTERS}),
summed as (select run, {crc_sql('named')} as h from long, crc),
typed as (
  select case when h % {TYPO_EVERY} = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2)
    else run end as word from summed),
w as (
  select word, count(*)::bigint as n from typed where length(word) >= {LEAST_LETTERS}
  group by 1 having count(*) >= {LEAST_COUNT}),
cut as (select word, n, unnest(range(1, length(word) + 1)) as p from w),
gone as (select word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) as rest from cut),
pair as (
  select a.word, b.word as other, b.n as other_n from gone a join gone b on a.rest = b.rest and a.p = b.p and a.word <> b.word
  union
  select g.word, w.word, w.n from gone g join w on g.rest = w.word
  union
  select w.word, g.word, g.n from gone g join w on g.rest = w.word),
best as (
  select word, count(*)::bigint as n_near, arg_min(other, (-other_n, encode(other))) as best, max(other_n) as best_n from pair group by 1),
judged as (
  select w.word, n, coalesce(n_near, 0) as n_near, case when best_n >= {FORM_TIMES} * n then best end as form,
    case when best_n >= {FORM_TIMES} * n then best_n end as form_n from w left join best using (word)),
walk as (
  select word, word as here, form as next from judged
  union all
  select walk.word, j.word, j.form from walk join judged j on j.word = walk.next)
select word, form, (select here from walk where walk.word = judged.word and next is null) as root, n, n_near, form_n from judged"""
