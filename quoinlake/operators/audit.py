"""Counts that come from the pass that writes the rows: refusals, unmapped keys, row numbers.

`DataFrame.observe` adds aggregates to a plan; their values are there once an action has run
over it. So an audit costs no scan, parse or shuffle of its own. What is observed has a fixed
number of values, however many rows pass.
"""

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quoinlake.operators.clean import tier_of, unmapped
from quoinlake.operators.normalize import complete

#: Required fields up to which every pattern of missing ones is counted (2^n values).
MOST_FIELDS = 8
#: Distinct unmapped keys that are counted in passing; they are exact while all of them fit.
TRACKED_KEYS = 1000


@dataclass(frozen=True)
class Audit:
    """A frame to write and what is known after it has been written."""

    rows: DataFrame
    seen: Observation

    def counts(self) -> dict:
        """Waits for the action over `rows`."""
        return self.seen.get


def audited_require(df: DataFrame, required: list[str]) -> Audit:
    """Rows with every required field; `refusals` tells afterwards what was refused, and why."""
    if len(required) > MOST_FIELDS:
        raise ValueError(f"patterns of more than {MOST_FIELDS} fields are counted by require()")
    missing = {c: F.col(c).isNull() for c in required}
    patterns = {}
    for k in range(1, len(required) + 1):
        for names in combinations(required, k):
            exact = F.lit(True)
            for c in required:
                exact &= missing[c] if c in names else ~missing[c]
            patterns[",".join(names)] = F.count_if(exact)
    seen = Observation()
    marked = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[n.alias(f"missing:{p}") for p, n in patterns.items()])
    return Audit(marked.where(complete(required)), seen)


def refusals(audit: Audit) -> list[tuple[str, int]]:
    """(missing fields, rows) of every pattern that occurred, as `require` counts them."""
    return [(k.removeprefix("missing:"), n) for k, n in audit.counts().items() if k.startswith("missing:") and n]


def accepted(audit: Audit) -> int:
    return audit.counts()["rows"] - sum(n for _, n in refusals(audit))


def audited_tiers(df: DataFrame, tiers: dict[str, int], key: str = "district", out: str = "rank_quan") -> Audit:
    """Rows with their tier; `unmapped_seen` tells afterwards which keys have none."""
    tiered = df.withColumn(out, tier_of(key, tiers))
    named = F.when(F.col(out).isNull(), F.col(key))
    seen = Observation()
    observed = tiered.withColumn("_untiered", named).observe(
        seen, F.count_if(F.col(out).isNull() & F.col(key).isNull()).alias("nameless"), F.count("_untiered").alias("unmapped"),
        F.expr(f"approx_top_k(_untiered, {TRACKED_KEYS}, {2 * TRACKED_KEYS})").alias("keys"))
    return Audit(observed.drop("_untiered"), seen)


def unmapped_seen(audit: Audit, df: DataFrame, tiers: dict[str, int], key: str = "district") -> list[tuple["str | None", int]]:
    """Keys without a tier and their rows, as `unmapped` counts them.

    The keys tracked in passing add up to the rows without a tier unless some had to be let
    go; only then is `df` counted again.
    """
    got = audit.counts()
    found = [(k["item"], k["count"]) for k in got["keys"]]
    if sum(n for _, n in found) != got["unmapped"] or len(found) >= TRACKED_KEYS:
        return [tuple(r) for r in unmapped(df, tiers, key).select(key, "n_rows").collect()]
    return found + ([(None, got["nameless"])] if got["nameless"] else [])
