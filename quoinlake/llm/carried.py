"""Whole numbers that pass through pandas unchanged.

A pandas column of numbers with a NULL in it becomes floats, which changes numbers beyond
2^53. Columns that a function only passes on go through it as text.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WHOLE = ("tinyint", "smallint", "int", "bigint")


def carried(df: DataFrame, columns: list[str]) -> tuple[DataFrame, str, Callable[[DataFrame], DataFrame]]:
    """`df` with the whole numbers among `columns` as text, the fields of `columns` for a schema, and the way back."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in columns}
    text = {c: F.col(f"`{c}`").cast("string") for c, k in kinds.items() if k in _WHOLE}
    fields = ", ".join(f"`{c}` {'string' if c in text else k}" for c, k in kinds.items())

    def back(out: DataFrame) -> DataFrame:
        return out.withColumns({c: F.col(f"`{c}`").cast(kinds[c]) for c in text})

    return df.withColumns(text), fields, back
