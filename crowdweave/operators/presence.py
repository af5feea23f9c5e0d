"""Presence facts: validation, roll-up of raw events, reconciliation with snapshots, order-insensitive merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["channel_id", "video_id", "source_type", "viewer_id"]
SOURCES = ("live_chat", "comment")
_ID = r"^[A-Za-z0-9_-]+$"


def valid_event() -> Column:
    """Identity, source, viewer, count and interval of a presence row are well formed."""
    first, last = F.coalesce("first_seen", "timestamp"), F.coalesce("last_seen", "timestamp")
    return F.coalesce(
        F.col("channel_id").rlike(_ID) & F.col("video_id").rlike(_ID) & F.col("source_type").isin(*SOURCES)
        & (F.coalesce("viewer_id", F.lit("")) != "") & (F.coalesce("appearances", F.lit(1)) >= 1) & (first <= last),
        F.lit(False),
    )


def split_valid(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) rows."""
    return events.where(valid_event()), events.where(~valid_event())


def rollup(events: DataFrame) -> DataFrame:
    """Raw sightings (key, timestamp) to first_seen, last_seen and appearances."""
    return events.groupBy(*KEY).agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count(F.lit(1)).alias("appearances"))


def reconcile(batch: DataFrame) -> DataFrame:
    """One batch of raw sightings and snapshots: raw counts are summed, snapshots take their greatest, then the greater wins."""
    raw = F.col("timestamp").isNotNull() & F.col("first_seen").isNull()
    count = F.coalesce("appearances", F.lit(1)).cast("long")
    return batch.groupBy(*KEY).agg(
        F.min(F.coalesce("first_seen", "timestamp")).alias("first_seen"), F.max(F.coalesce("last_seen", "timestamp")).alias("last_seen"),
        F.greatest(F.coalesce(F.sum(F.when(raw, count)), F.lit(0)), F.coalesce(F.max(F.when(~raw, count)), F.lit(0))).alias("appearances"),
    )


def merge(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Snapshots of any number of batches; least, greatest and greatest, so order and repeats do not matter."""
    both = current.select(*KEY, "first_seen", "last_seen", "appearances").unionByName(incoming.select(*KEY, "first_seen", "last_seen", "appearances"))
    return both.groupBy(*KEY).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("appearances").alias("appearances"))


def viewer_per_video(observations: DataFrame) -> DataFrame:
    """Observations of a (video, viewer): earliest and latest interaction, count, the first quality that is not missing."""
    known = F.when(F.col("quality") != "missing", F.struct("interaction_at", "quality"))
    return observations.groupBy("video_id", "viewer_id").agg(
        F.min("interaction_at").alias("first_at"), F.max("interaction_at").alias("last_at"), F.count(F.lit(1)).alias("appearances"),
        F.coalesce(F.min(known)["quality"], F.lit("missing")).alias("quality"),
    )


def quality(events: DataFrame) -> DataFrame:
    """One row: rows, distinct keys, distinct viewers, rows of each source."""
    return events.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(F.struct(*KEY)).alias("unique_keys"), F.countDistinct("viewer_id").alias("unique_viewers"),
        F.count_if(F.col("source_type") == "live_chat").alias("live_rows"), F.count_if(F.col("source_type") == "comment").alias("comment_rows"),
    )
