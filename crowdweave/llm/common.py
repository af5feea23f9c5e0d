"""Shared pieces of the training-data operators: table access, shared-folder tables, size-based block counts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one block (one task of a blocked operator) should hold.
BLOCK_BYTES = 24 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a session in local mode, whose driver and
    executor are one process, may go without the setting; it gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="crowdweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def block_count(docs: DataFrame, column: str = "text", block_bytes: int = BLOCK_BYTES, least: int | None = None) -> int:
    """Blocks that keep each one near ``block_bytes`` of text, at least ``least`` (the session's shuffle partitions)."""
    total = docs.agg(F.sum(F.octet_length(column)).alias("b")).first()["b"] or 0
    return max(partitions(docs.sparkSession) if least is None else least, -(-int(total) // block_bytes))


def whole_text(column: str = "text"):
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ranked(rows: DataFrame, group: list[str], order: list[str], buckets: int, name: str = "rank") -> DataFrame:
    """Add a gapless 0-based rank inside each group without bringing a group into one task.

    A group is dealt into hash buckets; rows are numbered inside (group, bucket), and each bucket's offset is the sum
    of the earlier buckets' counts. Group keys are compared as text beside a null mark, plain columns that are never
    null, so that the rows keep the window's partitioning in the join and move once. Ties in ``order`` get distinct
    ranks; columns ``_bucket``, ``_before``, ``_r`` and ``_g0``, ``_z0`` and so on are reserved.
    """
    from pyspark.sql import Window

    keys = [f"_{k}{i}" for i in range(len(group)) for k in "gz"]
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    for i, g in enumerate(group):
        dealt = dealt.withColumns({f"_g{i}": F.coalesce(F.col(g).cast("string"), F.lit("")), f"_z{i}": F.col(g).isNull()})
    counts = dealt.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket")) - F.col("_n")).drop("_n")
    inner = dealt.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)))
    return inner.join(before, [*keys, "_bucket"]).withColumn(name, F.col("_before") + F.col("_r") - 1).drop("_bucket", "_before", "_r", *keys)
