"""Writers: versioned tables with a pointer, verified snapshots, partitioned presence, delivery files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdweave.operators import presence
from crowdweave.sources import commits
from crowdweave.sources.shared import written


class Table:
    """A table as a folder of versions; readers follow the newest version that was written whole.

    A version counts from its commit file on, which is written last, so that a failed write is never read. There is one
    writer at a time. Everything goes through Spark's file readers and writers, so any store they know will do.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _files(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return jvm, path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest committed version, or 0."""
        jvm, path, fs = self._files()
        if not fs.exists(path):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return max((int(n[2:]) for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))), default=0)

    def read(self, schema: str | None = None) -> DataFrame:
        now = self.version()
        if not now:
            if schema is None:
                raise FileNotFoundError(self.folder)
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.folder}/v={now}")

    def write(self, rows: DataFrame) -> int:
        new = self.version() + 1
        rows.write.mode("overwrite").parquet(f"{self.folder}/v={new}")
        return new


def verified_write(rows: DataFrame, path: str) -> DataFrame:
    """Write in one pass over the input, which also counts and hashes, and read back; returns the read table. Rows that
    are there already are not written again; other content under the path is not overwritten but raises."""
    from pyspark.errors import AnalysisException

    try:
        back = rows.sparkSession.read.parquet(path).select(*rows.columns)
    except AnalysisException:  # nothing is there yet
        wrote = commits.observed_write(rows, path)
        back = rows.sparkSession.read.parquet(path).select(*rows.columns)
    else:
        wrote = commits.content(rows)
    found = commits.content(back)
    if (found["rows"], found["hash"]) != (wrote["rows"], wrote["hash"]):
        raise ValueError(f"{path} differs from what was written: {wrote} and {found}")
    return back


#: Folders of a table that is laid out by channel. Fixed, as the folders of a written table are.
BUCKETS = 64


def _bucketed(rows: DataFrame) -> DataFrame:
    """Rows with the bucket of their channel; folders per channel would be one or more small files for each of them."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64("channel_id"), F.lit(BUCKETS)).cast("int"))


def _stored(came: DataFrame, path: str) -> DataFrame:
    """What the buckets of the rows that came hold; raises AnalysisException if nothing was written yet."""
    rows = came.drop("bucket")
    # the schema is given: ids of digits would be read as numbers
    stored = came.sparkSession.read.schema(rows.schema).parquet(path).select(*rows.columns, "bucket")
    return stored.join(F.broadcast(came.select("bucket").distinct()), "bucket", "left_semi").drop("bucket")


def _replace_buckets(rows: DataFrame, path: str) -> None:
    """Overwrite the buckets of the rows. A bucket is a file, sorted by channel; one that is large is several."""
    dealt = _bucketed(rows).hint("rebalance", "bucket").sortWithinPartitions("bucket", "channel_id", "video_id")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def merge_presence(spark: SparkSession, path: str, incoming: DataFrame) -> None:
    """Merge presence snapshots into a table laid out in buckets of channels; only the buckets that came are rewritten."""
    from pyspark.errors import AnalysisException

    came = written(_bucketed(incoming))  # computed once, read three times
    try:
        old = _stored(came, path)
    except AnalysisException:  # nothing was written yet
        old = came.drop("bucket").limit(0)
    # a bucket can't be read while it is overwritten
    _replace_buckets(written(presence.merge(old, came)), path)


def deliver_csv(rows: DataFrame, path: str, columns: list[str]) -> int:
    """One ordered CSV file with a byte order mark, streamed partition by partition; for delivery-sized tables."""
    import csv

    count = 0
    with open(path, "w", encoding="utf-8-sig", newline="") as out:
        writer = csv.writer(out)
        writer.writerow(columns)
        for row in rows.select(*columns).toLocalIterator(prefetchPartitions=True):
            writer.writerow(["" if x is None else x for x in row])
            count += 1
    return count


def bootstrap_json(tables: dict[str, DataFrame], path: str, version: int = 2) -> None:
    """Tables as one JSON document, {"schema_version": ..., "tables": {name: [rows]}}: a dump of registry-sized tables,
    whose rows meet in one row by its nature."""
    from functools import reduce

    whole = [t.agg(F.collect_list(F.struct(*t.columns)).alias(name)).withColumn("k", F.lit(0)) for name, t in tables.items()]
    row = reduce(lambda a, b: a.join(b, "k"), whole)
    row.select(F.to_json(F.struct(F.lit(version).alias("schema_version"), F.struct(*tables).alias("tables")), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def json_lines(rows: DataFrame, path: str, order: list[str]) -> None:
    """Ordered JSON lines."""
    rows.orderBy(*order).select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def write_observations(rows: DataFrame, path: str) -> None:
    """Observations in a table laid out in buckets of channels. A video's rows replace those it had; all others stay, and
    only the buckets of channels that came are rewritten."""
    from pyspark.errors import AnalysisException

    came = _bucketed(rows)
    try:
        both = rows.unionByName(_stored(came, path).join(rows.select("channel_id", "video_id").distinct(), ["channel_id", "video_id"], "left_anti"))
    except AnalysisException:  # nothing was written yet
        both = rows
    # a bucket can't be read while it is overwritten
    _replace_buckets(written(both), path)


def write_intake(rows: DataFrame, path: str, confirmed: Column, columns: list[str]) -> None:
    """Candidates to two places: confirmed ones as JSON lines for review, all others as a CSV in quarantine."""
    sure = F.coalesce(confirmed, F.lit(False))
    rows.where(sure).write.mode("overwrite").json(f"{path}/intake")
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]
    rows.where(~sure).select(*text).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(f"{path}/quarantine")


def write_catalog(rows: DataFrame, path: str) -> DataFrame:
    """A catalogue as Parquet and, from what was written there, as CSV; returns the Parquet table."""
    rows.write.mode("overwrite").parquet(f"{path}/parquet")
    written = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/parquet")
    written.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    return written
