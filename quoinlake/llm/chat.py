"""Reply trees to training conversations.

A tree is a table of nodes (conversation, node, parent, role, text, score). Every leaf
names one branch, the path from its root. Branches are enumerated by self-joins that
double the distance covered each time, so a branch of depth d costs 2·log2(d) joins of
narrow id tables, ranked by score, and the best are formatted.

Defined results: a NULL or unknown parent makes a root; a NULL conversation is one
conversation of its own; NULL role or text counts as empty, a NULL score as 0; of several
rows with one node id the first by role and text stays; nodes on a cycle reach no root
and give no branch; an empty table gives an empty result. Columns other than those named
are ignored, so extra columns cannot clash.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoinlake.workspace import stored

OPEN, SPLIT, CLOSE = "### ", ": ", "</turn>"
# Escapes start with a backslash, which is escaped first and restored last.
TEXT_ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"))
ROLE_ESCAPES = (*TEXT_ESCAPES, (":", "\\c"))


def escape(c: Column, pairs=TEXT_ESCAPES) -> Column:
    for plain, coded in pairs:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column, pairs=TEXT_ESCAPES) -> Column:
    for plain, coded in reversed(pairs):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def tree_nodes(
    df: DataFrame, conv: str, node: str, parent: str, role: str, text: str, score: "str | None" = None
) -> DataFrame:
    """Canonical columns; one row per (conversation, node); a parent that is absent is NULL."""
    rows = df.select(
        F.col(conv).alias("conv"),
        F.coalesce(F.col(conv).cast("string"), F.lit("\0")).alias("tree"),
        F.col(node).cast("bigint").alias("node"),
        F.col(parent).cast("bigint").alias("up"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.coalesce(F.col(score).cast("double") if score else F.lit(0.0), F.lit(0.0)).alias("score"),
    ).where("node is not null")
    first = Window.partitionBy("tree", "node").orderBy("role", "text", "up")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def branches(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, above): `node` lies `above` steps over `leaf`; whole paths only."""
    ids = nodes.select("tree", "node", "up")
    keys = ids.select("tree", F.col("node").alias("up"))
    jumps = [stored(ids.join(keys, ["tree", "up"]).select("tree", "node", "up"), "jumps")]
    most = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while 2 ** len(jumps) < most and not jumps[-1].isEmpty():
        last = jumps[-1]
        onward = last.select("tree", F.col("node").alias("up"), F.col("up").alias("further"))
        jumps.append(stored(
            last.join(onward, ["tree", "up"]).select("tree", "node", F.col("further").alias("up")), "jumps"
        ))
    inner = jumps[0].select("tree", F.col("up").alias("node")).distinct()
    paths = ids.join(inner, ["tree", "node"], "left_anti").select(
        "tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("above")
    )
    for k in range(len(jumps) - 1, -1, -1):
        both = F.when(F.col("up").isNull(), F.array(F.struct("node", "above"))).otherwise(F.array(
            F.struct("node", "above"),
            F.struct(F.col("up").alias("node"), (F.col("above") + 2**k).alias("above")),
        ))
        paths = paths.join(jumps[k], ["tree", "node"], "left").select("tree", "leaf", F.inline(both))
    return paths


def best_branches(nodes: DataFrame, paths: DataFrame, keep: int = 1) -> DataFrame:
    """Paths of the `keep` branches of each tree with the highest score sums (ties: lower leaf)."""
    scored = paths.join(nodes.select("tree", "node", "score"), ["tree", "node"])
    total = scored.groupBy("tree", "leaf").agg(F.sum("score").alias("branch_score"))
    order = Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")
    chosen = total.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= keep)
    return paths.join(chosen, ["tree", "leaf"])


def formatted(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """One row per branch: the text and, as loss mask, the spans of assistant texts in it.

    Spans are (start from 0, length) in code points of `text` and cover escaped texts.
    """
    head = F.concat(F.lit(OPEN), escape(F.col("role"), ROLE_ESCAPES), F.lit(SPLIT))
    body = escape(F.col("text"))
    turns = paths.join(nodes.drop("score", "up"), ["tree", "node"]).select(
        "tree", "leaf", "conv", "branch", "branch_score", (-F.col("above")).alias("pos"), "role",
        F.concat(head, body, F.lit(CLOSE)).alias("piece"),
        F.char_length(head).alias("ahead"), F.char_length(body).alias("chars"),
    )
    so_far = Window.partitionBy("tree", "leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("piece")).over(so_far), F.lit(0)) + F.col("ahead")
    turns = turns.withColumn("start", start)
    ordered = F.sort_array(F.collect_list(F.struct("pos", "piece", "role", "start", "chars")))
    grouped = turns.groupBy("tree", "leaf").agg(
        F.first("conv").alias("conv"), F.first("branch").alias("branch"),
        F.first("branch_score").alias("branch_score"), ordered.alias("t"),
    )
    spans = F.transform(
        F.filter("t", lambda x: x["role"] == "assistant"),
        lambda x: F.struct(x["start"].alias("start"), x["chars"].alias("chars")),
    )
    return grouped.select(
        "conv", "leaf", "branch", "branch_score",
        F.array_join(F.col("t.piece"), "").alias("text"), spans.alias("loss"),
    )


def read_back(df: DataFrame) -> DataFrame:
    """Turns and masked texts, recovered from `text` and `loss` alone."""
    pieces = F.filter(F.split("text", F.lit(CLOSE)), lambda p: p != "")

    def turn(p: Column) -> Column:
        cut = F.locate(SPLIT, p)
        return F.struct(
            unescape(F.substring(p, len(OPEN) + 1, cut - len(OPEN) - 1), ROLE_ESCAPES).alias("role"),
            unescape(F.substring(p, cut + len(SPLIT), F.char_length(p))).alias("text"),
        )

    masked = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["chars"])))
    return df.withColumns({"turns": F.transform(pieces, turn), "masked": masked})


def conversations(
    df: DataFrame, conv: str, node: str, parent: str, role: str, text: str, score: "str | None" = None, keep: int = 1
) -> DataFrame:
    """Reply trees in `df` to formatted conversations (conv, leaf, branch, branch_score, text, loss)."""
    nodes = stored(tree_nodes(df, conv, node, parent, role, text, score), "nodes")
    return formatted(nodes, best_branches(nodes, branches(nodes), keep))


def digests(df: DataFrame) -> DataFrame:
    """Contract columns of formatted conversations."""
    back = read_back(df)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join("masked", "")
    return back.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length(masked).cast("bigint").alias("loss_chars"),
        F.sha2(masked, 256).alias("loss_sha256"),
        F.char_length("text").cast("bigint").alias("formatted_chars"),
    )


ADVERSARIAL = "\\### Assistant: </turn> ok"


def chat_query(spark, sf_dir: str) -> DataFrame:
    """All conversations, whose rows form chains by turn, and one made of control strings."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(-7, 0, "user", ADVERSARIAL), (-7, 1, "assistant", ADVERSARIAL)], table.schema
    )
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    chained = table.unionByName(extra).withColumn("node", F.row_number().over(by_turn))
    chained = chained.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(1.0))
    return digests(conversations(chained, "conv_id", "node", "parent", "role", "text", "score"))


_ESCAPED = r"replace(replace(replace({}, '\', '\b'), '###', '\h'), '</turn>', '\e')"

CHAT_SQL = rf"""
with t as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '\### Assistant: </turn> ok'
    union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) as loss_sha256,
    sum(length('### ' || replace({_ESCAPED.format('role')}, ':', '\c') || ': '
        || {_ESCAPED.format('text')} || '</turn>'))::bigint as formatted_chars
from t group by conv_id
"""
