"""Counts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _with_total(rows: DataFrame, total) -> DataFrame:
    """Rows with ``_total``, an aggregate over all of them: one row is broadcast, so no task sees all."""
    one = rows.agg(total.alias("_total")).withColumn("_one", F.lit(0))
    return rows.withColumn("_one", F.lit(0)).join(F.broadcast(one), "_one").drop("_one")


def breakdown(rows: DataFrame, column: str) -> DataFrame:
    """Count and percentage of each value."""
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    joined = _with_total(counts, F.sum("n"))
    return joined.select(column, "n", F.round(F.col("n") * 100.0 / F.col("_total"), 2).cast("double").alias("percent"))


def status_counts(rows: DataFrame, column: str, states: list[str]) -> DataFrame:
    """One row with a counter per state."""
    return rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(column) == s).alias(f"n_{s.lower()}") for s in states])


def top_values(rows: DataFrame, group: str, member: str, k: int) -> DataFrame:
    """Groups with the most distinct members."""
    return rows.groupBy(group).agg(F.countDistinct(member).alias("members")).orderBy(F.desc("members"), group).limit(k)


def per_day(ledger: DataFrame) -> DataFrame:
    """Units spent per quota day (Pacific time) and stage."""
    day = F.date_format(F.from_utc_timestamp("at", "America/Los_Angeles"), "yyyy-MM-dd")
    return ledger.groupBy(day.alias("day"), "stage").agg(F.sum("units").cast("long").alias("units"))


def campaign(rows: DataFrame) -> DataFrame:
    """Totals of a campaign: records, kinds, distinct people."""
    return rows.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("kind") == "comment").alias("comments"), F.count_if(F.col("kind") == "reply").alias("replies"),
        F.countDistinct("person").alias("people"),
    )


def coverage(videos: DataFrame) -> DataFrame:
    """Per channel: videos, first and last date, share whose date is known."""
    return videos.groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("videos"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"),
        F.round(F.count("published_at") * 100.0 / F.count(F.lit(1)), 2).cast("double").alias("dated_percent"),
    )


def backlog(jobs: DataFrame, budget: int) -> DataFrame:
    """Per status: jobs and requests; what remains of a request budget overall."""
    each = jobs.groupBy("status").agg(F.count(F.lit(1)).alias("jobs"), F.sum("requests").cast("long").alias("requests"))
    return _with_total(each, F.sum("requests")).select("status", "jobs", "requests", (F.lit(budget).cast("long") - F.col("_total")).alias("remaining"))
