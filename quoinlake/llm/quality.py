"""Quality and toxicity by weak labels.

Overlapping heuristic labellers, and the rows of `labels` as one more, each vote bad, good
or nothing on a document. Expectation-maximisation over the counts of vote patterns
estimates how each labeller votes on good and on bad documents and so the posterior of a
pattern; the counts cover all documents, and there are at most 3^labellers patterns. The
posteriors of a bounded sample, `SAMPLE_DOCS` documents, labelled rows first, train one
linear scorer for quality and one for toxicity over hashed features: words, their first
bytes, and shape classes of the text. An L1 penalty leaves few weights, which score every
document in one pass. Documents that either scorer finds bad are rejected.

Defined results: NULL and blank texts get the votes of an empty text and are rejected as
having no content; a document without a row in `labels` has no such vote; of several rows
the lowest quality and the highest toxicity hold; rows that repeat an id are scored by
their own texts; empty tables give no rows; columns with clashing names are ignored by the
report and kept by the filter.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoinlake.llm.shingles import U64, mix
from quoinlake.llm.wordscan import Scan, in_batches, scan
from quoinlake.workspace import stored

SAMPLE_DOCS = 6000
VARIETY_WORDS = 1000
SCREENED = 30_000  # features with the strongest association that enter a fit
INSULTS = "worthless loser pathetic disgusting idiot trash moron scum stupid clown".split()
STRONG = "idiot moron scum worthless disgusting dumb bastard fool".split()
QUALITY_LABELLERS = ("repeats", "symbols", "capitals", "variety", "tokens", "marks", "sound", "given")
TOXIC_LABELLERS = ("insults", "strong", "many", "given")
PREFIXES = (4, 5)

_INSULTS, _STRONG = np.sort(scan(INSULTS).hashes), np.sort(scan(STRONG).hashes)


def _class_counts() -> dict[str, np.ndarray]:
    blank, alnum, mark = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
    blank[[32, 9, 10, 11, 12, 13]] = True
    alnum[48:58] = alnum[65:91] = alnum[97:123] = alnum[128:] = True
    mark[[33, 63]] = True
    upper = np.zeros(256, bool)
    upper[65:91] = True
    lower = np.zeros(256, bool)
    lower[97:123] = True
    return {"symbols": ~blank & ~alnum, "solid": ~blank, "marks": mark, "upper": upper, "lower": lower}


_CLASSES = _class_counts()


def variety(words: np.ndarray) -> float:
    """Least share of distinct words in a stretch of VARIETY_WORDS words; the last stretch ends with the text."""
    n = len(words)
    if n <= VARIETY_WORDS:
        return len(np.unique(words)) / max(1, n)
    whole = n // VARIETY_WORDS * VARIETY_WORDS
    rows = np.sort(words[:whole].reshape(-1, VARIETY_WORDS), axis=1)
    distinct = (rows[:, 1:] != rows[:, :-1]).sum(axis=1).min() + 1
    return min(int(distinct), len(np.unique(words[-VARIETY_WORDS:]))) / VARIETY_WORDS


def shapes(texts: list) -> pd.DataFrame:
    """Numbers on which the heuristics rest, one row a text."""
    out = []
    for _, part in in_batches(texts):
        s = scan(part)
        ends = np.cumsum([len((t or "").encode()) + 1 for t in part])
        starts = np.concatenate([[0], ends[:-1]])
        sums = {k: np.concatenate([[0], np.cumsum(m[s.raw])]) for k, m in _CLASSES.items()}
        sums = {k: v[ends] - v[starts] for k, v in sums.items()}
        same = np.concatenate([[0], np.cumsum(s.hashes[1:] == s.hashes[:-1])]) if len(s.hashes) else np.zeros(1)
        # blank-separated tokens that hold neither letter nor digit
        solid = np.concatenate([[False], _CLASSES["solid"][s.raw], [False]])
        edge = np.flatnonzero(solid[1:] != solid[:-1])
        word_in = np.concatenate([[0], np.cumsum(~_CLASSES["symbols"][s.raw] & _CLASSES["solid"][s.raw])])
        bare = word_in[edge[1::2]] == word_in[edge[::2]]
        token_end = np.searchsorted(edge[::2], ends)
        bare_sum = np.concatenate([[0], np.cumsum(bare)])
        for i in range(len(part)):
            a, b = s.bounds[i], s.bounds[i + 1]
            n, t0 = int(b - a), token_end[i - 1] if i else 0
            insult = np.unique(s.hashes[a:b][np.isin(s.hashes[a:b], _INSULTS)]) if n else s.hashes[:0]
            out.append((
                n, int(same[b - 1] - same[a]) / n if n > 1 else 0.0,
                sums["symbols"][i] / max(1, sums["solid"][i]),
                sums["upper"][i] / max(1, sums["upper"][i] + sums["lower"][i]),
                variety(s.hashes[a:b]),
                (bare_sum[token_end[i]] - bare_sum[t0]) / max(1, token_end[i] - t0),
                sums["marks"][i] / max(1, sums["solid"][i]),
                len(insult), int(np.isin(s.hashes[a:b], _STRONG).any()) if n else 0,
                int(np.isin(s.hashes[a:b], _INSULTS).sum()) if n else 0,
            ))
    return pd.DataFrame(out, columns=[
        "words", "repeats", "symbols", "capitals", "variety", "tokens", "marks", "insults", "strong", "insult_words",
    ])


def _found(bad: pd.Series) -> np.ndarray:
    """0 where a labeller finds its kind of bad text, 2 (no vote) elsewhere."""
    return np.where(bad, 0, 2)


def votes(x: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Votes of the heuristics on quality and on toxicity, a row a text: 0 bad, 1 good, 2 none."""
    n = x["words"]
    some = n >= 8
    sound = (x["repeats"] < 0.08) & (x["symbols"] < 0.15) & (x["capitals"] < 0.3) & (x["variety"] > 0.35)
    sound = sound & (x["tokens"] < 0.1) & (x["marks"] < 0.05) & (n >= 3)
    quality = [
        _found(x["repeats"] * n >= np.maximum(4, 0.15 * n)), _found((x["symbols"] > 0.25) & some),
        _found((x["capitals"] > 0.5) & some), _found((x["variety"] < 0.25) & some), _found((x["tokens"] > 0.2) & some),
        _found((x["marks"] > 0.08) & some), np.where(sound, 1, 2),
    ]
    quality = [np.where(n == 0, 0, q) for q in quality]
    toxic = [_found(x["insults"] > 0), _found(x["strong"] > 0), _found(x["insult_words"] > 1)]
    return np.stack(quality, 1), np.stack(toxic, 1)


@dataclass
class LabelModel:
    """P(vote | class) of every labeller and the class prior; class 0 is bad."""

    prior: np.ndarray
    accuracy: np.ndarray  # labeller, class, vote

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of bad for each row of votes.

        A labeller that does not vote tells nothing: most look for one kind of bad text
        each, so that their silences depend on each other.
        """
        log = np.log(self.prior)[None, :] + sum(
            np.where(patterns[:, j] < 2, np.log(self.accuracy[j][:, np.minimum(patterns[:, j], 1)]), 0.0).T
            for j in range(patterns.shape[1])
        )
        return 1 / (1 + np.exp(np.clip(log[:, 1] - log[:, 0], -500, 500)))


GIVEN_ACCURACY = 0.97


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> LabelModel:
    """Expectation-maximisation; the start believes a given label, else any bad vote.

    The accuracy of the given labels is fixed. It ties the classes to their meaning: kinds
    of bad text that no two heuristics see together would else drift apart.
    """
    given = patterns[:, -1]
    any_bad = (patterns[:, :-1] == 0).any(axis=1)
    bad = np.where(given == 0, 0.95, np.where(given == 1, 0.05, np.where(any_bad, 0.8, 0.05)))
    for _ in range(rounds):
        weight = np.stack([bad, 1 - bad]) * counts
        total = weight.sum(1)
        prior = (total + 1) / (total.sum() + 2)
        table = np.stack([
            np.stack([weight[:, patterns[:, j] == v].sum(1) for v in range(3)], 1) for j in range(patterns.shape[1])
        ])
        accuracy = (table + 0.1) / (table + 0.1).sum(2, keepdims=True)
        accuracy[-1] = [[GIVEN_ACCURACY, 1 - GIVEN_ACCURACY, 1], [1 - GIVEN_ACCURACY, GIVEN_ACCURACY, 1]]
        model = LabelModel(prior, accuracy)
        bad = model.posterior(patterns)
    return model


_SHAPES = ("repeats", "symbols", "capitals", "variety", "tokens", "marks")
_SHAPE_KEYS = {
    (k, i): int(mix(np.array([(j << 32) + i + 1], U64))[0]) for j, k in enumerate(_SHAPES) for i in range(21)
}


def hashed_features(texts: list) -> list[np.ndarray]:
    """Sorted distinct hashes of the features of each text."""
    x, out = shapes(texts), []
    levels = {k: np.minimum(20, (x[k].to_numpy() * 20).astype(int)) for k in _SHAPES}
    for first, part in in_batches(texts):
        s: Scan = scan(part)
        lanes = [s.hashes, *[s.prefix(p) for p in PREFIXES]]
        for i in range(len(part)):
            a, b = s.bounds[i], s.bounds[i + 1]
            own = [int(_SHAPE_KEYS[k, levels[k][first + i]]) for k in _SHAPES]
            found = np.unique(np.concatenate([*[lane[a:b] for lane in lanes], np.array(own, U64)]))
            out.append(found[found != 0])
    return out


@dataclass
class Scorer:
    """log-odds of bad: bias and the weights of a few hashed features."""

    bias: float = 0.0
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def probability(self, features: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(features), self.bias)
        if len(self.keys):
            for i, f in enumerate(features):
                at = np.minimum(np.searchsorted(self.keys, f), len(self.keys) - 1)
                out[i] += self.weights[at[self.keys[at] == f]].sum()
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def fit_scorer(features: list[np.ndarray], bad: np.ndarray, l1: float = 1e-3, rounds: int = 300) -> Scorer:
    """Logistic regression on posterior labels with an L1 penalty, by accelerated proximal steps."""
    if not len(features) or not any(map(len, features)):
        return Scorer(-5.0)
    rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
    keys, cols, docs = np.unique(np.concatenate(features), return_inverse=True, return_counts=True)
    n = len(features)
    hits = np.bincount(cols, bad[rows])
    expect = docs * bad.mean()
    strength = np.abs(hits - expect) / np.sqrt(expect * (1 - docs / (n + 1)) + 0.5)
    chosen = np.argsort(-np.where(docs >= 3, strength, -1), kind="stable")[:SCREENED]
    place = np.full(len(keys), -1)
    place[chosen] = np.arange(len(chosen))
    use = place[cols] >= 0
    rows, cols = rows[use], place[cols[use]]
    # Columns are scaled by the root of their share of documents, so that rare words move as far as common ones.
    m = len(chosen)
    scale = 1 / (np.sqrt(np.bincount(cols, minlength=m) / n) + 0.02)
    value = scale[cols]
    probe = np.ones(m) / max(1, m) ** 0.5
    for _ in range(20):
        probe = np.bincount(cols, value * np.bincount(rows, value * probe[cols], n)[rows], m) / n
        norm = np.linalg.norm(probe) or 1.0
        probe /= norm
    step = 3.5 / (norm + 1)
    w, v, bias, bias_v, speed = np.zeros(m), np.zeros(m), 0.0, 0.0, 1.0
    for _ in range(rounds):
        margin = np.bincount(rows, value * v[cols], n) + bias_v
        error = 1 / (1 + np.exp(-np.clip(margin, -500, 500))) - bad
        moved = v - step * np.bincount(cols, value * error[rows], m) / n
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
        new_bias = bias_v - step * error.mean()
        if (v - new) @ (new - w) > 0:  # start anew when the momentum points uphill
            speed = 1.0
        faster = (1 + (1 + 4 * speed * speed) ** 0.5) / 2
        v, bias_v = new + (speed - 1) / faster * (new - w), new_bias + (speed - 1) / faster * (new_bias - bias)
        w, bias, speed = new, new_bias, faster
    w = w * scale
    kept = np.flatnonzero(w)
    order = kept[np.argsort(keys[chosen[kept]])]
    return Scorer(float(bias), keys[chosen[order]], w[order])


#: Rows whose texts are Python objects at a time; a batch of Arrow may hold many more.
SLICE = 500


def pattern_votes(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, q, t): votes of all labellers as base-3 numbers, the given label as the last digit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                quality, toxic = votes(shapes(part["text"].to_pylist()))
                q, t = (x @ 3 ** np.arange(x.shape[1])[::-1] for x in (quality, toxic))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(q, pa.int32()), pa.array(t, pa.int32())], ["doc_id", "q", "t"])

    found = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, q int, t int"
    )
    given = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    digit = lambda c, bad: F.when(c == bad, 0).when(c == 1 - bad, 1).otherwise(2)
    return found.join(given, "doc_id", "left").select(
        "doc_id", (F.col("q") * 3 + digit(F.col("quality"), 0)).alias("q"), (F.col("t") * 3 + digit(F.col("toxic"), 1)).alias("t")
    )


def _digits(numbers: np.ndarray, n: int) -> np.ndarray:
    return np.stack([numbers // 3**k % 3 for k in range(n - 1, -1, -1)], 1).astype(int)


@dataclass
class Classifier:
    quality: Scorer
    toxic: Scorer
    quality_labels: LabelModel
    toxic_labels: LabelModel


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> Classifier:
    """Label models from the votes on all documents, scorers from the sample."""
    spark = docs.sparkSession
    found = stored(pattern_votes(docs, labels), "votes")
    models = []
    for column, names in (("q", QUALITY_LABELLERS), ("t", TOXIC_LABELLERS)):
        counts = found.groupBy(column).count().toPandas()  # at most 3^labellers rows
        models.append(fit_label_model(_digits(counts[column].to_numpy(), len(names)), counts["count"].to_numpy()))
    labelled = ((F.col("q") % 3 < 2) | (F.col("t") % 3 < 2)).cast("int")
    order = [F.desc(labelled), F.xxhash64("doc_id"), F.col("doc_id"), F.col("q"), F.col("t")]
    chosen = found.where("doc_id is not null").dropDuplicates(["doc_id"]).orderBy(*order).limit(sample).toPandas()
    if not len(chosen):
        return Classifier(Scorer(-5.0), Scorer(-5.0), *models)
    wanted = spark.createDataFrame([(int(i),) for i in chosen["doc_id"]], "doc_id long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                found = [f.view(np.int64) for f in hashed_features(list(part["text"]))]
                yield pd.DataFrame({"doc_id": part["doc_id"], "features": found})

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(wanted), "doc_id")
    # one row an id, however many rows share it
    texts = texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = texts.mapInPandas(run, "doc_id long, features array<long>").toArrow().to_pandas()
    texts = {int(i): np.asarray(f, np.int64).view(U64) for i, f in zip(rows["doc_id"], rows["features"])}
    chosen = chosen[chosen["doc_id"].isin(list(texts))].sort_values("doc_id")
    features = [texts[int(i)] for i in chosen["doc_id"]]
    scorers = [
        fit_scorer(features, model.posterior(_digits(chosen[c].to_numpy(), len(names))))
        for c, names, model in (("q", QUALITY_LABELLERS, models[0]), ("t", TOXIC_LABELLERS, models[1]))
    ]
    return Classifier(*scorers, *models)


def _probabilities(texts: list, quality: Scorer, toxic: Scorer) -> tuple[np.ndarray, np.ndarray]:
    """Low quality, 1 for blank texts, and toxicity."""
    features = hashed_features(texts)
    low, bad = quality.probability(features), toxic.probability(features)
    return np.where(np.array([not (t or "").strip() for t in texts], bool), 1.0, low), bad


def scored(docs: DataFrame, model: Classifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, low_quality, toxic, keep) of every row, from its whole text. Ids are passed on as they are."""
    shared = docs.sparkSession.sparkContext.broadcast((model.quality, model.toxic))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                low, bad = _probabilities(part["text"].to_pylist(), *shared.value)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(low, pa.float64()), pa.array(bad, pa.float64()), pa.array((low < 0.5) & (bad < 0.5))],
                    ["doc_id", "low_quality", "toxic", "keep"])

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, low_quality double, toxic double, keep boolean")


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scored(docs, train(docs, labels))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: rejected documents go. Rows are scored where they lie and do not move."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    shared = spark.sparkContext.broadcast((model.quality, model.toxic))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                low, bad = _probabilities(part["text"].to_pylist(), *shared.value)
                yield part.filter(pa.array((low < 0.5) & (bad < 0.5)))

    return docs.mapInArrow(run, docs.schema)
