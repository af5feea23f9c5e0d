"""Connected components of large edge tables, and roots of large forests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdweave.llm.common import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of any ordered type to (u, v): every vertex that has an edge and is not the least of its component,
    with the least vertex. Alternating star contraction; each round is one written table, and rounds grow with the
    logarithm of the longest chain."""
    stars = cut(edges.select("u", "v").where("u <> v").distinct())
    state = _state(stars)
    while state[0]:
        stars = cut(_small_star(_large_star(stars)))
        new = _state(stars)
        if new == state:
            break
        state = new
    return stars


def roots(parents: DataFrame) -> DataFrame:
    """A forest (vertex, parent), one row per vertex that has a parent, to (vertex, root).

    Pointer jumping: each round doubles the steps that a row has gone and is one join and one written table.
    """
    level = cut(parents.select("vertex", F.col("parent").alias("root"), F.lit(True).alias("moved")))
    while level.where("moved").head(1):
        up = level.select(F.col("vertex").alias("root"), F.col("root").alias("further"))
        jumped = level.select("vertex", "root").join(up, "root", "left")
        level = cut(jumped.select("vertex", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
    return level.select("vertex", "root")
