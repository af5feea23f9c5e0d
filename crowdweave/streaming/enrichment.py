"""Uploads with the details that arrive after them: one join for batches and for two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def enriched(uploads: DataFrame, details: DataFrame, patience: str = "1 day", late: str = "1 hour") -> DataFrame:
    """uploads (video_id, listed_at, ...) with each of their details (video_id, fetched_at, ...) that came within
    ``patience`` after them; an upload without any stays, with nulls.

    As streams, both sides are kept until the watermarks (``late`` behind the newest row of each side) say that no
    match can come; then an upload without details is given out. Rows that come behind their watermark meet nothing:
    ``dropped`` counts them.
    """
    left = uploads.withWatermark("listed_at", late).alias("u")
    right = details.withColumnRenamed("video_id", "detail_of").withWatermark("fetched_at", late).alias("d")
    within = (F.col("video_id") == F.col("detail_of")) & F.col("fetched_at").between(F.col("listed_at"), F.col("listed_at") + F.expr(f"INTERVAL {patience}"))
    return left.join(right, within, "leftOuter").drop("detail_of")


def dropped(query: StreamingQuery) -> int:
    """Rows that a query's stateful steps left out because they came behind the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for progress in query.recentProgress for op in progress["stateOperators"])
