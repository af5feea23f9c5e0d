"""Which rows to work on next: top-k per group, fair and balanced picks, representatives, rotating batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crowdweave.sources.shared import written


def top_per_group(rows: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """The first k rows of each group; Spark filters ranks before and after the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def balanced(rows: DataFrame, group: str, order: list, per_group: int, total: int, seed: int = 42) -> DataFrame:
    """At most ``per_group`` rows of each group, in an order drawn by a seeded hash, up to ``total``."""
    drawn = top_per_group(rows, group, order, per_group).withColumn("draw", F.md5(F.concat(F.lit(str(seed)), F.col(group).cast("string"))))
    return drawn.orderBy("draw", group, "rank").limit(total).drop("draw")


def fair(jobs: DataFrame, attempts: DataFrame, k: int) -> DataFrame:
    """Jobs of the channels that were attempted least; ``attempts`` has a row per attempt."""
    counts = attempts.groupBy("channel_id").agg(F.count(F.lit(1)).alias("attempts"))
    known = jobs.join(counts, "channel_id", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)).cast("long"))
    return known.orderBy("attempts", "job_id").limit(k)


def per_year(rows: DataFrame, done: DataFrame) -> DataFrame:
    """One representative per (channel, year), years that are not done first, the one with most comments."""
    marked = rows.join(done.select("channel_id", "year", F.lit(True).alias("had")).distinct(), ["channel_id", "year"], "left")
    order = Window.partitionBy("channel_id", "year").orderBy(F.desc("comments"), "video_id")
    best = marked.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
    return best.select("channel_id", "year", "video_id", "comments", F.coalesce("had", F.lit(False)).alias("had"))


def rotating(rows: DataFrame, key: str, cursor: int, size: int) -> DataFrame:
    """The ``size`` rows after a cursor in key order, wrapping around: a page of a round robin.

    Keys are numbered range by range (a sort, then each partition's offset), and the page is a filter on the numbers, so
    no task holds more than its range; the page comes in order. Rows with one key are on a page together.
    """
    ranged = rows.select(F.col(key).alias("_key")).sort("_key").select("_key", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    ranged = written(ranged)  # the numbering must not be drawn twice
    sizes = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per partition
    count = sum(sizes.values())
    if not count:
        return rows.limit(0)
    before, offsets = 0, []
    for part in sorted(sizes):
        offsets += [F.lit(part), F.lit(before - (part << 33))]
        before += sizes[part]
    place = F.pmod(F.col("_at") + F.create_map(*offsets)[F.col("_part")] - cursor % count, F.lit(count))
    page = ranged.withColumn("_place", place).where(F.col("_place") < size).groupBy("_key").agg(F.min("_place").alias("_place"))
    return rows.join(page, rows[key].eqNullSafe(F.col("_key"))).orderBy("_place", key).drop("_key", "_place")


def jobs(candidates: DataFrame, sources: list[str], priorities: DataFrame) -> DataFrame:
    """A job for every candidate and source, with its priority (1 where none is known)."""
    each = candidates.select("channel_id", F.explode(F.array(*[F.lit(s) for s in sources])).alias("source"))
    known = each.join(priorities, "channel_id", "left")
    return known.select(F.concat_ws(":", "channel_id", "source").alias("job_id"), "channel_id", "source", F.coalesce("priority", F.lit(1.0)).alias("priority"))


def greedy(rated: DataFrame, workers: int) -> DataFrame:
    """The ``workers`` rows of highest priority, assigned; ties go to the lower id."""
    return rated.orderBy(F.desc("priority"), "id").limit(workers).withColumn("status", F.lit("ASSIGNED"))


def claimable(rows: DataFrame, k: int) -> DataFrame:
    """The next jobs by priority, age and id."""
    return rows.where("status = 'pending'").orderBy(F.desc("priority"), "created_at", "job_id").limit(k)
