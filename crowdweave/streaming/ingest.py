"""Streaming ingestion: exactly-once inserts, order-insensitive presence merges, per-viewer state, daily budgets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdweave.operators import merge, presence
from crowdweave.sources.sinks import Table, merge_presence

INTERACTION_KEY = ["creator_id", "video_id", "viewer_id", "source_type"]
INTERACTIONS = "creator_id string, video_id string, viewer_id string, source_type string, observed_at timestamp"
SNAPSHOTS = "channel_id string, video_id string, source_type string, viewer_id string, first_seen timestamp, last_seen timestamp, appearances long"


def inserted(spark: SparkSession, path: str) -> DataFrame:
    """What ``insert_interactions`` has stored."""
    return spark.read.schema(f"{INTERACTIONS}, batch long").parquet(path)


def insert_interactions(spark: SparkSession, path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: new keys are added once, for good. Nothing that is stored is rewritten: a batch has a
    folder of its own, which a replay of the batch overwrites, and reads only the key columns of the other batches. Rows
    whose source is unknown or null are not stored; they go to the folder ``path`` + ".rejected", batch by batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        known = F.coalesce(F.col("source_type").isin(*presence.SOURCES), F.lit(False))
        batch.where(~known).write.mode("overwrite").parquet(f"{path}.rejected/batch={batch_id}")
        rows = batch.where(known)
        try:
            old = inserted(spark, path).where(F.col("batch") != batch_id)
        except AnalysisException:  # nothing is stored yet
            old = spark.createDataFrame([], f"{INTERACTIONS}, batch long")
        new = merge.absent(rows, old.select(*INTERACTION_KEY), INTERACTION_KEY, ["observed_at"])
        new.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def merge_snapshots(spark: SparkSession, path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for presence: late and repeated events need no watermark, as the merge takes least and
    greatest; a batch that is sent again does not count twice. Only the channels of the batch are rewritten."""

    def write(batch: DataFrame, batch_id: int) -> None:
        accepted, _ = presence.split_valid(batch)
        merge_presence(spark, path, presence.reconcile(accepted))

    return write


def viewer_state(observations: DataFrame) -> DataFrame:
    """A stream of (video_id, viewer_id, interaction_at) to running (first_at, last_at, appearances) per pair, kept
    across pages in Spark's state store; for update mode."""
    return observations.groupBy("video_id", "viewer_id").agg(
        F.min("interaction_at").alias("first_at"), F.max("interaction_at").alias("last_at"), F.count(F.lit(1)).alias("appearances")
    )


def spent_per_day(ledger: DataFrame, late: str = "2 days") -> DataFrame:
    """A stream of (at, units) to units per quota day, which is a Pacific one; final once the watermark has passed it."""
    local = ledger.select(F.convert_timezone(None, F.lit("America/Los_Angeles"), "at").cast("timestamp").alias("local"), "units")
    return local.withWatermark("local", late).groupBy(F.window("local", "1 day").alias("w")).agg(F.sum("units").alias("units")).select(F.col("w.start").alias("day"), "units")


def change_files(table: Table, ledger: Table, key: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for reviewed changes: upserts supplied columns and records what each row did. A batch
    whose number is in the ledger is skipped. What a batch does is written beside the ledger before the table changes, so
    a replay after a failure between the two writes records the same."""

    def write(batch: DataFrame, batch_id: int) -> None:
        schema = "batch_id long, id string, action string"
        done = ledger.read(schema)
        if done.where(F.col("batch_id") == batch_id).limit(1).count():
            return
        staged = Table(table.spark, f"{ledger.folder}/staged/batch={batch_id}")
        old = table.read()
        if not staged.version():
            staged.write(merge.diff(old, batch, key).select(F.lit(batch_id).cast("long").alias("batch_id"), F.col(key).alias("id"), "action"))
        table.write(merge.upsert(old, batch, key))
        ledger.write(done.unionByName(staged.read()))

    return write
