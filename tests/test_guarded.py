"""Ragged CSV files behind a header guard, and tables laid out by time."""

import datetime

import pytest
from pyspark.sql import functions as F

from crowdweave.sources import readers

HEADER = ["channel_id", "name", "note"]


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "good.csv").write_text('﻿channel_id,name,note\nUC1,one,x\nUC2,two\n\n,,\nUC3\n"UC4","a, ""b""\nline",y\nUC5,five,z,more\nUC6,six,"open\n', encoding="utf-8")
    (root / "sub" / "other.csv").write_text("name,channel_id,note\nseven,UC7,x\neight,UC8,y,w\n")
    (root / "sub" / "empty.csv").write_text("channel_id,name,note\n")
    return str(root)


def test_every_row_ends_where_it_should(spark, folder):
    good, bad = readers.guarded(spark, folder, HEADER)
    rows = sorted((r.channel_id, r.name, r.note) for r in good.collect())
    assert rows == [("UC1", "one", "x"), ("UC2", "two", ""), ("UC3", "", ""), ("UC4", 'a, "b"\nline', "y")]
    held = sorted((r.file.rpartition("/")[2], r.problem, r.raw.strip()) for r in bad.collect())
    assert [(f, p) for f, p, _ in held] == [("good.csv", "broken"), ("good.csv", "long"), ("other.csv", "header"), ("other.csv", "header"), ("other.csv", "header")]
    assert held[1][2] == "UC5,five,z,more" and held[0][2].startswith("UC6") and {x[2] for x in held[2:]} >= {"name,channel_id,note", "seven,UC7,x"}


def files_read(frame):
    """The scans' own metric, after the frame was collected."""
    plan = frame._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def test_older_years_are_not_opened(spark, tmp_path):
    start = datetime.datetime(2019, 1, 1)
    rows = spark.createDataFrame([(k, start + datetime.timedelta(days=5 * k)) for k in range(500)], "k int, at timestamp")
    readers.by_time(rows, str(tmp_path / "t"), "at")
    whole = spark.read.parquet(str(tmp_path / "t"))
    whole.collect()
    recent = readers.since(spark, str(tmp_path / "t"), "at", "2024-06-01")
    assert sorted(r.k for r in recent.collect()) == sorted(r.k for r in rows.where(F.col("at") >= "2024-06-01").collect())
    assert 0 < files_read(recent) <= files_read(whole) / 3
    assert "PushedFilters: [IsNotNull(at), GreaterThanOrEqual(at," in recent._jdf.queryExecution().toString()
