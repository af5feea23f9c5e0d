"""Daily metrics: latest row per channel, as-of deltas with a bounded age of the baseline, merge of growth tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPANS = (7, 30, 90)


def slack(days: int) -> int:
    """How much older than ``days`` a baseline may be."""
    return max(2, days // 4)


def latest(metrics: DataFrame) -> DataFrame:
    """The last day's row of each channel; one aggregation, no sort of the series."""
    last = metrics.groupBy("channel_id").agg(F.max_by(F.struct("day", "subscribers", "views"), "day").alias("m"))
    return last.select("channel_id", "m.day", "m.subscribers", "m.views")


def _baseline(column: str, days: int) -> Column:
    """The last non-null point that is ``days`` to ``days`` + slack days old."""
    window = Window.partitionBy("channel_id").orderBy("day_number").rangeBetween(-(days + slack(days)), -days)
    point = F.when(F.col(column).isNotNull(), F.struct(F.col("day").alias("day"), F.col(column).alias("value")))
    return F.last(point, ignorenulls=True).over(window)


def growth(metrics: DataFrame, min_points: int = 2) -> DataFrame:
    """Deltas of subscribers over 7, 30 and 90 days and of views over 30 days, at the last day of each channel.

    All spans share one sort per channel: range frames over the day number, no self-join.
    """
    whole = Window.partitionBy("channel_id")
    rows = metrics.withColumn("day_number", F.datediff(F.to_date("day"), F.lit("1970-01-01")))
    for n in SPANS:
        rows = rows.withColumn(f"b{n}", _baseline("subscribers", n))
    rows = rows.withColumns({
        "v30": _baseline("views", 30), "history_points": F.count(F.lit(1)).over(whole), "first_date": F.min("day").over(whole), "last_date": F.max("day").over(whole),
    })
    ends = rows.where((F.col("day") == F.col("last_date")) & (F.col("history_points") >= min_points))

    def day_of(point: str, value: str) -> Column:
        return F.when(F.col(value).isNotNull(), F.col(f"{point}.day"))

    return ends.select(
        "channel_id", "first_date", "last_date", "history_points",
        *[c for n in SPANS for c in ((F.col("subscribers") - F.col(f"b{n}.value")).alias(f"subscribers_delta_{n}d"), day_of(f"b{n}", "subscribers").alias(f"baseline_{n}d"))],
        (F.col("views") - F.col("v30.value")).alias("views_delta_30d"), day_of("v30", "views").alias("views_baseline_30d"),
    )


def merge_growth(old: DataFrame, new: DataFrame, min_days: int = 7) -> DataFrame:
    """Growth rows to publish: a new row replaces an old one once its history spans ``min_days``."""
    fields = [c for c in new.columns if c != "channel_id"]
    o = old.select(F.col("channel_id").alias("_o"), F.struct(*fields).alias("_old"))
    n = new.select(F.col("channel_id").alias("_n"), F.struct(*fields).alias("_new"))
    joined = o.join(n, F.col("_o") == F.col("_n"), "full_outer")
    long = F.datediff(F.to_date("_new.last_date"), F.to_date("_new.first_date")) >= min_days
    row = F.when(F.col("_o").isNull() | (F.col("_n").isNotNull() & long), F.col("_new")).otherwise(F.col("_old"))
    return joined.select(F.coalesce("_o", "_n").alias("channel_id"), row.alias("r")).select("channel_id", "r.*")


def due_channels(channels: DataFrame, metrics: DataFrame, missing: DataFrame, day: str, batch: int = 50) -> DataFrame:
    """The next channels to fetch on a day: not gone, without a row and not marked missing that day."""
    done = metrics.where(F.col("day") == day).select("channel_id").unionByName(missing.where(F.col("day") == day).select("channel_id")).distinct()
    live = channels.where("scan_status <> 'gone'")
    return live.join(done, "channel_id", "left_anti").orderBy("channel_id").limit(batch).select("channel_id")
