"""Connected components of a graph given as a table of edges."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoinlake.workspace import stored


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of `edges`; root is the smallest node reachable.

    Rounds of large-star and small-star: every node is linked to the smallest neighbour it
    knows, which halves the height of the trees. No group is gathered: minima combine
    before the shuffle, and a hub's edges meet their minimum in a join that splits skew.
    An edge with a NULL end links nothing.
    """
    links = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        F.greatest(a, b).alias("v"), F.least(a, b).alias("u")
    ).distinct()
    links = stored(links, "links")
    while True:
        both = links.union(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m"))
        # large star: neighbours above a node move to the smallest of its neighbourhood
        large = both.where("u > v").join(least, "v").select(
            F.col("u").alias("v"), F.least("m", "v").alias("u")
        ).distinct()
        # small star: a node and its neighbours below it move to the smallest of them
        below = large.where("v <> u")
        down = below.groupBy("v").agg(F.min("u").alias("m"))
        moved = below.join(down, "v")
        small = moved.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).union(
            down.select("v", F.col("m").alias("u"))
        ).distinct()
        links = stored(small, "links")
        # stars: every node has one link, and no centre is linked to another node
        inner = links.select(F.col("u").alias("v")).join(links.select("v"), "v", "left_semi")
        several = links.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if inner.isEmpty() and several.isEmpty():
            break
    return links.select(F.col("v").alias("node"), F.col("u").alias("root")).union(
        links.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    )
