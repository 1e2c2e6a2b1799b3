"""A fitted model as one column expression.

The feature stages become fills by the training mean, label lookups and divisions; a linear
model becomes a sum, trees become nested cases. Scoring is then a single projection inside
the code that Spark generates for the scan: no vectors are built and no stage is run.
"""

import re

from pyspark.ml import PipelineModel
from pyspark.ml.feature import ImputerModel, OneHotEncoderModel, StandardScalerModel, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoinlake.operators.features import ListingFeatures

#: Nodes of all trees of a model; the expression of a larger one costs more to compile than
#: it saves, and such models keep their own stage.
MOST_NODES = 1024
#: Labels of all categories of a model.
MOST_LABELS = 512


class _Slots:
    """What stands in each place of the feature vector: a number, or one label of a category.

    Once the values of the places are `made`, as columns of their own, they are looked up.
    """

    def __init__(self, entries: list, scale: list[float], made: bool = False):
        self.entries, self.scale, self.made = entries, scale, made

    def columns(self) -> dict[str, Column]:
        return {f"_place_{i}": self.value(i) for i in range(len(self.entries))}

    def value(self, i: int) -> Column:
        """The place's value before scaling."""
        if self.made:
            return F.col(f"_place_{i}")
        kind, column, labels, j = self.entries[i]
        if kind == "number":
            return column
        known = column.isin(*labels) if labels else F.lit(False)
        hit = column == labels[j] if j < len(labels) else ~F.coalesce(known, F.lit(False))
        return F.coalesce(hit.cast("double"), F.lit(0.0))

    def scaled(self, i: int) -> Column:
        return self.value(i) * F.lit(self.scale[i])

    def weighted(self, weights: list[float]) -> Column:
        """The sum of all places times their weights; each category is looked up once."""
        total, i = F.lit(0.0), 0
        while i < len(self.entries):
            kind, column, labels, _ = self.entries[i]
            if kind == "number":
                total = total + self.value(i) * F.lit(self.scale[i] * weights[i])
                i += 1
                continue
            of = [self.scale[i + j] * weights[i + j] for j in range(len(labels) + 1)]
            found = F.lit(of[-1])
            for label, w in reversed(list(zip(labels, of))):
                found = F.when(column == label, F.lit(w)).otherwise(found)
            total = total + found
            i += len(labels) + 1
        return total


def _slots(stages: list, kinds: dict[str, str]) -> "_Slots | None":
    """Places of the vector that the known feature stages make; None if there is another stage.

    `kinds` are the types of the columns: the mean of whole numbers is cut to a whole number.
    """
    filled: dict[str, Column] = {}
    indexed: dict[str, tuple[Column, list[str]]] = {}
    hot: dict[str, tuple[Column, list[str]]] = {}
    entries, scale = [], None
    for stage in stages:
        if isinstance(stage, ListingFeatures):
            continue
        if isinstance(stage, ImputerModel):
            means = stage.surrogateDF.first().asDict()
            for name, out in zip(stage.getInputCols(), stage.getOutputCols()):
                plain = F.col(name)
                filled[out] = F.coalesce(F.when(~F.isnan(plain.cast("double")), plain), F.lit(means[name]).cast(kinds[name])).cast("double")
        elif isinstance(stage, StringIndexerModel) and stage.getHandleInvalid() == "keep":
            for name, out, labels in zip(stage.getInputCols(), stage.getOutputCols(), stage.labelsArray):
                indexed[out] = (F.col(name), list(labels))
        elif isinstance(stage, OneHotEncoderModel) and stage.getHandleInvalid() == "keep" and stage.getDropLast():
            for name, out in zip(stage.getInputCols(), stage.getOutputCols()):
                hot[out] = indexed[name]
        elif isinstance(stage, VectorAssembler):
            for name in stage.getInputCols():
                if name in hot:
                    column, labels = hot[name]
                    entries += [("label", column, labels, j) for j in range(len(labels) + 1)]
                else:
                    entries.append(("number", filled.get(name, F.col(name).cast("double")), None, 0))
        elif isinstance(stage, StandardScalerModel) and not stage.getWithMean():
            scale = [1.0 / s if s else 0.0 for s in stage.std.toArray()]
        else:
            return None
    if sum(len(labels) for _, labels in hot.values()) > MOST_LABELS:
        return None
    return _Slots(entries, scale or [1.0] * len(entries))


def _tree_lines(text: str) -> list[list[str]]:
    """Lines of each tree of a model's description."""
    trees: list[list[str]] = [[]]
    for line in text.splitlines():
        plain = line.strip()
        if plain.startswith("Tree "):
            trees.append([])
        elif plain.startswith(("If ", "Else ", "Predict: ")):
            trees[-1].append(plain)
    return [t for t in trees if t]


def _tree(lines: list[str], slots: _Slots) -> Column:
    """A tree of `If (feature i <= x)`, its branch, `Else`, its branch, and predictions."""
    at = 0

    def node() -> Column:
        nonlocal at
        line = lines[at]
        at += 1
        if line.startswith("Predict: "):
            return F.lit(float(line.removeprefix("Predict: ")))
        i, x = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        yes = node()
        at += 1  # Else
        return F.when(slots.scaled(int(i)) <= F.lit(float(x)), yes).otherwise(node())

    return node()


def _with_features(df: DataFrame, model: PipelineModel) -> DataFrame:
    for stage in model.stages:
        if isinstance(stage, ListingFeatures):
            df = stage.transform(df)
    return df


def places(model: PipelineModel, df: DataFrame) -> dict[str, Column]:
    """The values that a model's expression is made of; none if its stages are not known.

    Made first, they leave one comparison for a node of a tree. Otherwise each node has its
    fill and lookup in it, and the code of a forest is one method, too long for the JVM to compile.
    """
    slots = _slots(model.stages[:-1], dict(_with_features(df, model).dtypes))
    return slots.columns() if slots else {}


def compiled_prediction(model: PipelineModel, df: DataFrame, made: bool = False) -> "Column | None":
    """The prediction over the columns that `ListingFeatures` adds to `df`; None if the model cannot be written so.

    With `made` it is one over `places`.
    """
    *stages, last = model.stages
    slots = _slots(stages, dict(_with_features(df, model).dtypes))
    if slots is None:
        return None
    slots.made = made
    if isinstance(last, LinearRegressionModel):
        return slots.weighted([float(w) for w in last.coefficients]) + F.lit(float(last.intercept))
    if isinstance(last, (RandomForestRegressionModel, GBTRegressionModel)) and last.totalNumNodes <= MOST_NODES:
        trees = _tree_lines(last.toDebugString)
        weights = last.treeWeights if isinstance(last, GBTRegressionModel) else [1.0] * len(trees)
        total = sum((F.lit(float(w)) * _tree(t, slots) for w, t in zip(weights, trees)), F.lit(0.0))
        return total if isinstance(last, GBTRegressionModel) else total / F.lit(float(len(trees)))
    return None


def predicted(df: DataFrame, model: PipelineModel, out: str = "prediction") -> DataFrame:
    """`df` with the model's estimate of every row: one projection where the model can be compiled.

    The feature columns that the expression needs are not kept.
    """
    expression = compiled_prediction(model, df, made=True)
    if expression is None:
        columns = [F.col(c) for c in df.columns]
        return model.transform(df).select(*columns, F.col("prediction").alias(out))
    made = _with_features(df, model).withColumns(places(model, df))
    return made.select(*df.columns, expression.alias(out))


def agreement(models: dict[str, PipelineModel], vectors: DataFrame, df: DataFrame, within: float = 1e-9) -> DataFrame:
    """(model, n_rows, n_equal): on how many rows a model's expression gives the estimate of its own stages.

    The models share their feature stages. `vectors` has what these make of `df` in "features",
    beside the columns that the expressions read, so all models are compared in one pass.
    """
    scored, counts = vectors.withColumns(places(next(iter(models.values())), df)), []
    for i, (name, model) in enumerate(models.items()):
        last, compiled = model.stages[-1], compiled_prediction(model, df, made=True)
        by_stages = F.col("_by_stages")
        both = last.copy({last.predictionCol: "_by_stages"}).transform(scored).withColumn("_compiled", compiled)
        near = F.abs(by_stages - F.col("_compiled")) <= within * F.abs(by_stages)
        scored = both.withColumn(f"_near_{i}", near).drop("_by_stages", "_compiled")
        counts.append(F.struct(
            F.lit(name).alias("model"), F.count(F.lit(1)).alias("n_rows"), F.count_if(f"_near_{i}").alias("n_equal")))
    return scored.agg(F.array(*counts).alias("counts")).select(F.inline("counts"))
