"""Merkle manifest of a table: a hash tree over each group's rows, one over the groups, and proofs.

A slot pivot builds it. Conditional aggregates spread the children of a parent into `fanout`
columns; all columns joined in their order give the parent's hash, and all but a child's own
column are its siblings. Each level is a table of an eighth of the rows of the one below;
rows are numbered by `operators.ranking`, so no group, however large, meets in one task.
On the way back down every node hands the siblings seen so far to its children, and the
leaves get theirs from their parent's row: rows of the table are never joined to the tree.

Hashes are lower-case hexadecimal SHA-256 of the joined inputs; digests enter as that text.
A field is its number of UTF-8 bytes, a colon and the value, or `-` for NULL.

Defined results: rows with a NULL id come first in their group, rows that repeat an id follow
their leaf's hash, and equal rows are leaves of their own with proofs of their own. A NULL
group is a group. Columns besides the named ones are neither hashed nor kept. An empty
table has no rows and no root. Texts may be of any length; only digests are moved.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoinlake.llm.spelling import CRC_TABLE_SQL, UPPER, crc_sql
from quoinlake.operators.ranking import numbered, same_keys
from quoinlake.workspace import stored

FANOUT = 8
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
TAMPER_EVERY = 3
_PATH = "array<struct<before: string, after: string>>"


def hashed(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return hashed(*[field(v) for v in values])


# --- up -------------------------------------------------------------------------

def _parents(nodes: DataFrame, by: list[str], fanout: int) -> DataFrame:
    """One row for each run of `fanout` nodes of a group, with its children in columns."""
    slots = [f"slot{j}" for j in range(fanout)]
    place = F.col("position") % fanout
    spread = nodes.where("n > 1").groupBy(
        *by, F.floor(F.col("position") / fanout).alias("position"), F.ceil(F.col("n") / fanout).alias("n")
    ).agg(*[F.max(F.when(place == j, F.col("child"))).alias(s) for j, s in enumerate(slots)])
    return spread.withColumn("digest", F.sha2(F.concat_ws("", *[F.col(s)["digest"] for s in slots]), 256))


def levels(leaves: DataFrame, by: list[str], fanout: int = FANOUT) -> list[DataFrame]:
    """The tree above `leaves` (by, position, n, child), lowest level first, each one stored.

    `child` is a struct with the field `digest`; what else it holds stays in the lowest level.
    The number of rounds is the logarithm of the largest group.
    """
    out: list[DataFrame] = []
    nodes = leaves
    while not nodes.where("n > 1").isEmpty():
        out.append(stored(_parents(nodes, by, fanout), "level"))
        nodes = out[-1].withColumn("child", F.struct("digest"))
    return out


def tops(leaves: DataFrame, above: list[DataFrame], by: list[str]) -> DataFrame:
    """(by, depth, digest) of what remains of every group."""
    rows = [leaves.select(*by, "n", F.col("child.digest").alias("digest")), *[x.select(*by, "n", "digest") for x in above]]
    return reduce(DataFrame.unionByName, [
        x.where("n = 1").select(*by, F.lit(k).alias("depth"), "digest") for k, x in enumerate(rows)])


# --- down -----------------------------------------------------------------------

def unfold(leaves: DataFrame, above: list[DataFrame], by: list[str], entry: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(by, child, path, kept columns of `entry`) for every leaf.

    `path` holds what stands before and after a node among its siblings, from the leaf up;
    `entry` is (by, depth, path, ...) with the path that continues above each group's top.
    """
    kept = [c for c in entry.columns if c not in (*by, "depth")]
    names = {c: f"_{c}" for c in [*by, "position", *kept]}

    def entering(depth: int) -> DataFrame:
        return entry.where(F.col("depth") == depth).select(*by, F.lit(0).cast("long").alias("position"), *kept)

    known = entering(len(above))
    for depth in range(len(above), 0, -1):
        pivot = above[depth - 1]
        right = known.select(*[F.col(c).alias(a) for c, a in names.items()])
        met = pivot.join(right, same_keys(pivot, right, {c: f"_{c}" for c in [*by, "position"]}))
        slots = [F.col(f"slot{j}") for j in range(fanout)]
        children = []
        for j, own in enumerate(slots):
            sides = F.struct(*[
                F.concat_ws("", *[s["digest"] for s in part]).alias(side) if part else F.lit("").alias(side)
                for side, part in (("before", slots[:j]), ("after", slots[j + 1 :]))])
            children.append(F.when(own.isNotNull(), F.struct(
                F.lit(j).alias("j"), own.alias("child"), sides.alias("sides"))))
        each = met.select(
            *by, "position", *[F.col(f"_{c}").alias(c) for c in kept],
            F.explode(F.array_compact(F.array(*children))).alias("e"))
        below = each.select(
            *by, (F.col("position") * fanout + F.col("e.j")).alias("position"), F.col("e.child").alias("child"),
            *[(F.concat(F.array("e.sides"), F.col(c)) if c == "path" else F.col(c)).alias(c) for c in kept])
        if depth == 1:
            lone = leaves.where("n = 1").select(*by, "child")
            enter = entering(0).select(*[F.col(c).alias(names[c]) for c in [*by, *kept]])
            alone = lone.join(enter, same_keys(lone, enter, {c: f"_{c}" for c in by})).select(
                *by, "child", *[F.col(f"_{c}").alias(c) for c in kept])
            return below.select(*by, "child", *kept).unionByName(alone)
        known = below.select(*by, "position", *kept).unionByName(entering(depth - 1))
    lone = leaves.select(*by, "child")
    enter = entering(0).select(*[F.col(c).alias(names[c]) for c in [*by, *kept]])
    return lone.join(enter, same_keys(lone, enter, {c: f"_{c}" for c in by})).select(
        *by, "child", *[F.col(f"_{c}").alias(c) for c in kept])


def siblings(path: Column) -> Column:
    """All siblings' digests in one text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, p: hashed(p["before"], h, p["after"]))


# --- manifest -------------------------------------------------------------------

def manifest(leaves: DataFrame, order: list[str], by: str, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """Proofs of all rows and the groups' digests.

    `leaves` has the group `by`, the columns of `order`, `digest` and any others. The proofs
    are its columns, `subroot`, `root` and `path`; the groups are (by, depth, digest, root).
    """
    held = [c for c in leaves.columns if c not in (by, "digest")]
    placed = numbered(leaves, [F.col(c).asc_nulls_first() for c in [*order, "digest"]], [by], "position", "n")
    low = stored(placed.select(by, "position", "n", F.struct("digest", *held).alias("child")), "leaves")
    above = levels(low, [by], fanout)
    subroots = stored(tops(low, above, [by]), "subroots")

    ordered = numbered(subroots, [F.col(by).asc_nulls_first()], [], "position", "n")
    groups = stored(ordered.select("position", "n", F.struct("digest", by, "depth").alias("child")), "groups")
    upper = levels(groups, [], fanout)
    root = tops(groups, upper, [])
    entry = root.select("depth", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    under_root = stored(unfold(groups, upper, [], entry, fanout).select(
        F.col(f"child.{by}").alias(by), F.col("child.depth").alias("depth"), "path",
        F.col("child.digest").alias("subroot"), "root"), "groups")

    proofs = unfold(low, above, [by], under_root, fanout)
    rows = proofs.select(by, "child.digest", *[f"child.{c}" for c in held], "subroot", "root", "path")
    return rows, under_root.select(by, "depth", F.col("subroot").alias("digest"), "root")


def merkle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, and whether it holds after the tampering of the task."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    changed = [F.translate("text", UPPER, UPPER.lower()) if c == "text" else F.col(c) for c in COLUMNS]
    hit = F.crc32(F.col("doc_id").cast("string")) % TAMPER_EVERY == 0
    leaves = docs.select(
        "doc_id", "lang", leaf_hash(*[F.col(c) for c in COLUMNS]).alias("digest"),
        F.when(hit, leaf_hash(*changed)).alias("tampered"))
    rows, _ = manifest(leaves, ["doc_id"], "lang")
    folded = rows.withColumn("folded_root", fold(F.coalesce("tampered", "digest"), F.col("path")))
    return folded.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


# --- check ----------------------------------------------------------------------

def _field_sql(c: str) -> str:
    return f"coalesce(octet_length(encode(({c})::varchar))::varchar || ':' || ({c})::varchar, '-')"


def _sides(by: str) -> str:
    run = f"over (partition by {by}position // {FANOUT} order by position rows between"
    return (f"case when n > 1 then coalesce(string_agg(h, '') {run} unbounded preceding and 1 preceding), '') else '' end as a, "
            f"case when n > 1 then coalesce(string_agg(h, '') {run} 1 following and unbounded following), '') else '' end as z")


def _tree_sql(name: str, by: str, depth: int) -> str:
    """CTEs name0..name{depth} of one tree; the lowest, name0, has (by, position, n, h)."""
    steps = []
    for k in range(1, depth + 1):
        steps.append(f"""{name}{k} as (
  select {by}position // {FANOUT} as position, (n + {FANOUT - 1}) // {FANOUT} as n, sha256(string_agg(h, '' order by position)) as h
  from {name}{k - 1} where n > 1 group by all)""")
    steps += [f"{name}s{k} as (select *, {_sides(by)} from {name}{k})" for k in range(depth + 1)]
    return ",\n".join(steps)


def _sql(depth: int = 8, group_depth: int = 3) -> str:
    """For tables of up to 8^depth rows a language and 8^group_depth languages."""
    plain = " || ".join(_field_sql(c) for c in COLUMNS)
    other = " || ".join(_field_sql(f"translate(text, '{UPPER}', '{UPPER.lower()}')" if c == "text" else c) for c in COLUMNS)
    steps = [CRC_TABLE_SQL, f"""leaf as (
  select doc_id, lang, sha256({plain}) as h,
    case when {crc_sql('doc_id::varchar')} % {TAMPER_EVERY} = 0 then sha256({other}) end as t from documents, crc)""", """
low0 as (
  select *, row_number() over (partition by lang order by doc_id nulls first, h) - 1 as position,
    count(*) over (partition by lang) as n from leaf)""", _tree_sql("low", "lang, ", depth)]
    subs = "\n  union all ".join(f"select lang, h from low{k} where n = 1" for k in range(depth + 1))
    steps += [f"subs as ({subs})", """up0 as (
  select *, row_number() over (order by lang nulls first) - 1 as position, count(*) over () as n from subs)""",
              _tree_sql("up", "", group_depth)]
    tops_ = " union all ".join(f"select h from up{k} where n = 1" for k in range(group_depth + 1))
    steps.append(f"top as ({tops_})")
    # one step for each level: the text of the siblings so far and the digest folded so far
    steps.append("""at0 as (select doc_id, lang, position, h as leaf, coalesce(t, h) as f, '' as s from low0)""")
    for k in range(depth + 1):
        steps.append(f"""at{k + 1} as (
  select p.* replace (case when x.n > 1 then sha256(x.a || p.f || x.z) else p.f end as f, p.s || coalesce(x.a || x.z, '') as s)
  from at{k} p left join lows{k} x on x.lang is not distinct from p.lang and x.position = p.position // {FANOUT ** k})""")
    steps.append(f"""in0 as (
  select p.doc_id, p.leaf, p.f, p.s, up0.position, up0.h as subroot from at{depth + 1} p join up0 on up0.lang is not distinct from p.lang)""")
    for k in range(group_depth + 1):
        steps.append(f"""in{k + 1} as (
  select p.* replace (case when x.n > 1 then sha256(x.a || p.f || x.z) else p.f end as f, p.s || coalesce(x.a || x.z, '') as s)
  from in{k} p left join ups{k} x on x.position = p.position // {FANOUT ** k})""")
    return "with " + ",\n".join(steps) + f"""
select doc_id, leaf, subroot, top.h as root, sha256(s) as proof_sha256, f as folded_root, f = top.h as verified
from in{group_depth + 1}, top"""


MERKLE_SQL = _sql()
