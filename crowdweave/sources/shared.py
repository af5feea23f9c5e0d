"""The folder that driver and executors share, for tables that live between two steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def fresh_folder(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``; a session in local mode may go without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="crowdweave-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage, survives lost executors."""
    path = fresh_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def written_with(rows: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
    """``written``, with aggregates that are gathered while the rows are written."""
    seen = Observation(uuid.uuid4().hex)
    table = written(rows.observe(seen, *[column.alias(name) for name, column in figures.items()]))
    return table, dict(seen.get)
