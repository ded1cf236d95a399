"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from costproof.llm.tables import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link to another one.

    Each round every node takes the first of its neighbours and itself, and links are rewritten between those. The first
    round orders nodes by falling degree, so that stars end at once; later rounds order them by a new hash, so that
    chains shrink by a constant share: the number of rounds follows the logarithm of the largest component. Minima are
    combined map-side, and joins run between written tables, where adaptive execution splits a hot node.
    """
    u, v = F.col(a).alias("u"), F.col(b).alias("v")
    links = links.select(u, v).where("u <> v")
    edges = written(links.union(links.select(F.col("v"), F.col("u"))).distinct())
    levels: list[DataFrame] = []
    while not levels or not edges.isEmpty():
        if levels:
            order = lambda c, seed=len(levels): F.struct(F.xxhash64(c, F.lit(seed)).alias("h"), F.col(c).alias("t"))
            lowest, own = edges.groupBy("u").agg(F.min(order("v")).alias("m")), order("u")
        else:
            degrees = written(edges.groupBy("u").agg((-F.count(F.lit(1))).alias("h")))
            near = edges.join(degrees.select(F.col("u").alias("v"), F.col("h").alias("hv")), "v").groupBy("u")
            lowest = near.agg(F.min(F.struct(F.col("hv").alias("h"), F.col("v").alias("t"))).alias("m"), F.count(F.lit(1)).alias("n"))
            own = F.struct((-F.col("n")).alias("h"), F.col("u").alias("t"))
        levels.append(written(lowest.select("u", F.least("m", own)["t"].alias("t"))))
        up, down = levels[-1].select("u", F.col("t").alias("tu")), levels[-1].select(F.col("u").alias("v"), F.col("t").alias("tv"))
        moved = edges.join(up, "u").join(down, "v").where("tu <> tv")
        edges = written(moved.select(F.col("tu").alias("u"), F.col("tv").alias("v")).distinct())
    roots = levels[-1].select(F.col("u").alias("node"), F.col("t").alias("root"))
    for level in reversed(levels[:-1]):
        above = roots.select(F.col("node").alias("t"), F.col("root").alias("above"))
        roots = level.join(above, "t", "left").select(F.col("u").alias("node"), F.coalesce("above", "t").alias("root"))
    return roots
