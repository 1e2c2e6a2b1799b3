"""Fingerprints by consistent weighted sampling.

A text's terms are pairs of adjacent words (its first and last word also pair with the
text's ends), weighted by how often they occur and hashed to 63 bits. For term f, weight w
and sample k, with r and c drawn from Gamma(2, 1) and b from [0, 1) by the hash of (f, k):

    t = floor(ln w / r + b),  ln y = r (t - b),  ln a = ln c - ln y - r

Sample k is the (f, t) of the smallest a. Two texts agree in a sample with a chance equal
to the generalised Jaccard similarity of their weights, sum of minima over sum of maxima,
however long they are: draws belong to the whole hash, no table holds them.

The draws come from three of Exp(1), e1 to e3: a of weight 1 is e1, c = e1 + e2,
r = ln(c / e1) + e3 and b = 1 - ln(c / e1) / r have the same joint law as above. So ln a is
ln e1 - r t, which is at most ln e1 and at least ln e1 - ln w - e3: the least e1 of all
terms, a product and a minimum, rules nearly all draws of repeated terms out.

A fingerprint is 128 samples, each as four hex digits.

Neighbours by ascending id: rows are dealt to ranges of ids whose bounds are quantiles;
the first row of each range also goes to the range before it, and each range is read in
order with one row held back. So no window spans the table and no text goes through the driver.

Defined results: NULL text is empty; texts without words have an empty fingerprint, which
is like another empty one (1) and unlike all others (0); rows without an id come first;
rows that repeat an id follow each other by a hash of their text; an empty table gives no rows.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoinlake.llm.shingles import LANES, U64, mix, word_hashes

SAMPLES, FEATURES = 128, 1 << 63
FIRST_MARK, LAST_MARK = U64(0x243F6A8885A308D3), U64(0x13198A2E03707344)
#: A hash times a sample's odd factor is the sample's draw; the inverse gives the hash back.
_FACTORS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) + U64(1 << 40)) | U64(1)
_INVERSES = np.array([pow(int(m), -1, 2**64) for m in _FACTORS], U64)
_SECOND, _THIRD = U64(0xA4093822299F31D0), U64(0x082EFA98EC4E6C89)
ROWS = 512


def _unit(bits: np.ndarray) -> np.ndarray:
    """Numbers within (0, 1)."""
    return ((bits >> U64(12)).astype(np.float64) + 0.5) / (1 << 52)


def weighted_features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Feature numbers and weights of each text."""
    parts = [t.encode() for t in texts]
    words, starts = word_hashes(b" ".join(parts))
    ends = np.searchsorted(starts, np.cumsum([len(p) + 1 for p in parts]))
    out, a = [], 0
    for b in ends:
        if b > a:
            row = np.concatenate([[FIRST_MARK], words[a:b], [LAST_MARK]])
            pairs = mix(row[:-1] * LANES[0] + row[1:] * LANES[1]) >> U64(1)
            out.append(np.unique(pairs.astype(np.int64), return_counts=True))
        else:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
        a = b
    return out


def samples(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """16 bits of each sample; empty without features."""
    if not len(features):
        return np.zeros(0, np.uint16)
    terms = mix(features.astype(np.uint64) + U64(1))
    least = np.full(SAMPLES, 2**64 - 1, U64)
    for at in range(0, len(terms), ROWS):
        np.minimum(least, (terms[at : at + ROWS, None] * _FACTORS).min(axis=0), out=least)
    key = least * _INVERSES
    least_e1 = -np.log1p(-_unit(least))
    best = np.log(least_e1)
    repeated = weights > 1
    terms, weights = terms[repeated], weights[repeated].astype(np.float64)
    for at in range(0, len(terms), ROWS):
        w = weights[at : at + ROWS, None]
        bits = terms[at : at + ROWS, None] * _FACTORS
        u1, u3 = _unit(bits), _unit(mix(bits ^ _THIRD))
        i, k = np.nonzero(u1 * u3 <= w * least_e1 * 1.000001)  # e1 is at least u1
        e1 = -np.log1p(-u1[i, k])
        e2 = -np.log(_unit(mix(bits[i, k] ^ _SECOND)))
        above = np.log1p(e2 / e1)
        r = above - np.log(u3[i, k])
        t = np.floor(np.log(w[i, 0]) / r + (1 - above / r))
        a = np.log(e1) - r * t
        order = np.lexsort((a, k))
        first = order[np.flatnonzero(np.diff(k[order], prepend=-1))]
        first = first[a[first] <= best[k[first]]]
        best[k[first]] = a[first]
        key[k[first]] = terms[at + i[first]] + t[first].astype(np.uint64) * LANES[2]
    return (mix(key + U64(1)) >> U64(48)).astype(np.uint16)


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    out, batch, size = [], [], 0
    for t in texts:
        batch.append(t)
        size += len(t)
        if size > 200_000:
            out += [samples(*x) for x in weighted_features(batch)]
            batch, size = [], 0
    return out + [samples(*x) for x in weighted_features(batch)] if batch else out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float((a == b).mean())


def as_text(samples: np.ndarray) -> str:
    return samples.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


#: Bytes of text of a range of ids, and the least error of the quantiles that bound ranges:
#: beyond 1 / LEAST_ERROR ranges they become less even, not wrong.
RANGE_BYTES, LEAST_ERROR = 64 << 20, 1e-5


def with_next(docs: DataFrame, key: str, text: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows dealt to ranges of ids, each range in order and followed by the next range's first row (`after`).

    The bounds of the ranges and their first rows, three numbers a range, go to every task;
    a row looks its range up by bisection.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("h", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = size // range_bytes + 1
    at = [i / parts for i in range(1, parts)]
    found = rows.approxQuantile("doc_id", at, max(0.2 / parts, LEAST_ERROR)) if at else []
    cuts = np.array(sorted({int(c) for c in found}), np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(cuts)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first row of each range that a task has met."""
        best: dict[int, tuple[int, int]] = {}
        for batch in batches:
            k, h = batch["k"].to_numpy(), batch["h"].to_numpy()
            part = np.searchsorted(shared.value, k, side="right")
            order = np.lexsort((h, k, part))
            for i in order[np.flatnonzero(np.diff(part[order], prepend=-1))]:
                best[int(part[i])] = min(best.get(int(part[i]), (2**63, 0)), (int(k[i]), int(h[i])))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(best), pa.int64()), pa.array([x[0] for x in best.values()], pa.int64()),
             pa.array([x[1] for x in best.values()], pa.int64())], ["part", "k", "h"])

    firsts = rows.select("k", "h").mapInArrow(least, "part long, k long, h long").groupBy("part").agg(
        F.min(F.struct("k", "h")).alias("f")).select("part", "f.k", "f.h").toArrow()
    order = np.argsort(firsts["part"].to_numpy())
    begins = docs.sparkSession.sparkContext.broadcast(tuple(firsts[c].to_numpy()[order] for c in ("part", "k", "h")))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, first_k, first_h = begins.value
        for batch in batches:
            k, h = batch["k"].to_numpy(), batch["h"].to_numpy()
            place = np.searchsorted(there, np.searchsorted(shared.value, k, side="right"))
            opens = np.flatnonzero((first_k[place] == k) & (first_h[place] == h))
            for which, to, after in (
                (None, place, 0), (opens, np.where(place[opens] > 0, place[opens] - 1, len(there) - 1), 1),
            ):
                part = batch if which is None else batch.take(pa.array(which))
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(to, pa.int32()), pa.array(np.full(part.num_rows, after), pa.int32())],
                        [*part.schema.names, "to", "after"])

    dealt = rows.mapInArrow(deal, "doc_id long, text string, k long, h long, `to` int, after int")
    return dealt.repartitionById(max(1, len(order)), F.col("to")).sortWithinPartitions("to", "after", "k", "h")


def fingerprinted(docs: DataFrame, key: str, text: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprint of every text and of its edited text, with their likeness and that to the next text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part["text"].to_pylist()
                rows = list(zip(*(part[c].to_pylist() for c in ("doc_id", "to", "after")), texts, fingerprints(texts)))
                rows = rows if held is None else [held, *rows]
                held = rows[-1]
                pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[1] == b[1] and not a[2]]
                changed = [edited(a[3], b[3]) for a, b in pairs]
                marks = fingerprints(changed)
                yield pa.RecordBatch.from_arrays([
                    pa.array([a[0] for a, _ in pairs], pa.int64()),
                    pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                    pa.array([as_text(a[4]) for a, _ in pairs], pa.string()),
                    pa.array([as_text(e) for e in marks], pa.string()),
                    pa.array([likeness(a[4], e) for (a, _), e in zip(pairs, marks)], pa.float64()),
                    pa.array([likeness(a[4], b[4]) for a, b in pairs], pa.float64()),
                ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return with_next(docs, key, text, range_bytes).mapInArrow(run, schema)


def fingerprint_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
