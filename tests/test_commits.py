"""Commits that race, fail half way, come again; archives that find changed cells."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from crowdweave.sources import commits, sinks

EVENTS = "record_id string, viewer_id string"


def events(spark, *ids):
    return spark.createDataFrame([(i, f"u{i}") for i in ids], EVENTS)


def test_log_entries_are_created_once(spark, tmp_path):
    log = commits.Log(spark, str(tmp_path / "log"))
    assert log.newest() == (0, None) and log.add(1, {"a": 1}) and not log.add(1, {"a": 2}) and log.add(2, {"a": "é"})
    assert log.entry(1) == {"a": 1} and log.newest() == (2, {"a": "é"}) and log.numbers() == [1, 2] and log.entry(3) is None


def test_batches_follow_one_another(spark, tmp_path):
    batches = commits.Batches(spark, str(tmp_path / "b"))
    assert batches.state() is None and batches.events() is None and batches.seen() is None
    first = batches.commit(events(spark, "a", "b"), {"sequence": 1, "token": "t1"}, 0)
    assert first["rows"] == 2 and not first["reconciled"]
    with pytest.raises(ValueError):
        batches.commit(events(spark, "c"), {"sequence": 3}, 1)
    with pytest.raises(commits.Stale):
        batches.commit(events(spark, "c"), {"sequence": 3}, 2)
    batches.commit(events(spark, "b", "c"), {"sequence": 2, "token": None}, 1)
    with pytest.raises(commits.Stale):
        batches.commit(events(spark, "a", "b"), {"sequence": 1, "token": "t1"}, 0)
    assert batches.state() == {"sequence": 2, "token": None}
    assert sorted(map(tuple, batches.events().select("sequence", "record_id").collect())) == [(1, "a"), (1, "b"), (2, "b"), (2, "c")]
    assert sorted(r.record_id for r in batches.seen().collect()) == ["a", "b", "c"] and batches.damaged() == []


def test_a_replay_reconciles_and_other_content_does_not(spark, tmp_path):
    batches = commits.Batches(spark, str(tmp_path / "b"))
    batches.commit(events(spark, "a", "b"), {"sequence": 1}, 0)
    again = batches.commit(events(spark, "b", "a").repartition(3), {"sequence": 1}, 0)
    assert again["reconciled"] and again["rows"] == 2
    for other, state in ((events(spark, "a", "x"), {"sequence": 1}), (events(spark, "a", "b"), {"sequence": 1, "more": 1}), (events(spark, "a", "b", "b"), {"sequence": 1})):
        with pytest.raises(commits.Conflict):
            batches.commit(other, state, 0)
    assert batches.events().count() == 2


def raced(batches, *frames):
    """All writers find nothing there and write; then they commit at once."""
    start, results = threading.Barrier(len(frames)), {}
    add = batches.log.add

    def waiting(number, entry):
        start.wait(60)
        return add(number, entry)

    batches.log.add = waiting

    def one(i, frame):
        try:
            results[i] = batches.commit(frame, {"sequence": 1}, 0)["reconciled"]
        except commits.Conflict:
            results[i] = "conflict"

    threads = [threading.Thread(target=one, args=x) for x in enumerate(frames)]
    [t.start() for t in threads]
    [t.join(120) for t in threads]
    return list(results.values())


def test_two_writers_race(spark, tmp_path):
    batches = commits.Batches(spark, str(tmp_path / "other"))
    assert sorted(map(str, raced(batches, events(spark, "a"), events(spark, "b")))) == ["False", "conflict"]
    assert batches.events().count() == 1
    same = commits.Batches(spark, str(tmp_path / "same"))
    assert sorted(raced(same, events(spark, "a"), events(spark, "a"), events(spark, "a"))) == [False, True, True]
    assert same.events().count() == 1 and same.damaged() == []


def test_damage_is_found(spark, tmp_path):
    batches = commits.Batches(spark, str(tmp_path / "b"))
    batches.commit(events(spark, "a"), {"sequence": 1}, 0)
    batches.commit(events(spark, "b"), {"sequence": 2}, 1)
    entry = batches.log.entry(2)
    events(spark, "z").write.mode("append").parquet(f"{batches.folder}/data/sequence=2/attempt={entry['attempt']}")
    assert batches.damaged() == [2]


def five(spark, mark):
    return {name: spark.createDataFrame([(mark, k) for k in range(n)], "mark string, k int") for n, name in enumerate(["VTUBERS", "NETWORK", "TIKTOK", "TWITCH", "METRICS"], 1)}


def files(folder):
    return sorted(os.path.join(at, f) for at, _, names in os.walk(folder) for f in names)


def test_a_generation_that_fails_half_way_is_not_seen(spark, tmp_path):
    kept = commits.Generations(spark, str(tmp_path / "g"))
    with pytest.raises(FileNotFoundError):
        kept.read("VTUBERS")
    kept.write(five(spark, "old"))
    broken = five(spark, "new")
    broken["TIKTOK"] = broken["TIKTOK"].withColumn("k", F.raise_error(F.lit("killed")).cast("int"))
    with pytest.raises(Exception, match="killed"):
        kept.write(broken)
    assert {name: [r.mark for r in kept.read(name).collect()] for name in five(spark, "")} == {name: ["old"] * n for n, name in enumerate(five(spark, ""), 1)}
    assert len(kept.recover()) == 1 and kept.recover() == []
    kept.write(five(spark, "new"))
    assert kept.read("METRICS").first().mark == "new" and kept.read("METRICS", 1).first().mark == "old"


def test_exports_are_gated(spark, tmp_path):
    kept = commits.Generations(spark, str(tmp_path / "g"))
    first = kept.write_if_changed(five(spark, "a"), spark.createDataFrame([("f1",)], "f string"))
    assert first == {"skipped": False, "tables": {"VTUBERS": 1, "NETWORK": 2, "TIKTOK": 3, "TWITCH": 4, "METRICS": 5}, "total_rows": 15}
    before = files(tmp_path)
    assert kept.write_if_changed(five(spark, "b"), spark.createDataFrame([("f1",)], "f string")) == {"skipped": True, "reason": "no_changes"}
    assert files(tmp_path) == before
    assert not kept.write_if_changed(five(spark, "b"), spark.createDataFrame([("f2",)], "f string"))["skipped"] and kept.read("TWITCH").first().mark == "b"


def test_archive_names():
    assert commits.archive_names(["Channel ID", "", None, " a-b ", "A B", "X1", "%%"]) == ["channel_id", "col_2", "col_3", "a_b", "a_b_", "x1", "col_7"]


def test_archive_reads_its_input_once_and_finds_a_changed_cell(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    table = spark.createDataFrame([(k, f"n{k}", None if k % 3 else k / 2) for k in range(50)], "`Channel ID` int, Name string, score double")
    archive = commits.Archive(spark, str(tmp_path / "a"))
    record = archive.snapshot({"CHANNELS": table.mapInArrow(counting, table.schema), "EMPTY": table.limit(0)})
    assert read.value == 50
    assert record["CHANNELS"]["rows"] == 50 and record["EMPTY"]["rows"] == 0
    assert archive.read("CHANNELS").dtypes == [("channel_id", "string"), ("name", "string"), ("score", "string")]
    assert all(x["ok"] for x in archive.verify({"CHANNELS": table.repartition(7), "EMPTY": table.limit(0)}).values())
    changed = table.withColumn("Name", F.when(F.col("`Channel ID`") == 7, "other").otherwise(F.col("Name")))
    assert archive.verify({"CHANNELS": changed, "OTHER": table}) == {
        "CHANNELS": {"ok": False, "rows": 50, "archived_rows": 50, "differ": ["name"]}, "OTHER": {"ok": False, "rows": 50, "archived_rows": None, "differ": ["channel_id", "name", "score"]}
    }
    swapped = table.withColumn("Name", F.when(F.col("`Channel ID`") == 1, "n2").when(F.col("`Channel ID`") == 2, "n1").otherwise(F.col("Name")))
    assert archive.verify({"CHANNELS": swapped})["CHANNELS"]["ok"] is False
    assert archive.verify({"CHANNELS": table.limit(49)})["CHANNELS"]["rows"] == 49


def test_verified_write_reads_its_input_once_and_keeps_what_is_there(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.range(20).mapInArrow(counting, "id long")
    assert sinks.verified_write(rows, str(tmp_path / "t")).count() == 20 and read.value == 20
    assert sinks.verified_write(spark.range(20), str(tmp_path / "t")).count() == 20
    with pytest.raises(ValueError):
        sinks.verified_write(spark.range(21), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 20


def test_entries_are_plain_json(spark, tmp_path):
    batches = commits.Batches(spark, str(tmp_path / "b"))
    batches.commit(events(spark, "a"), {"sequence": 1}, 0)
    entry = json.loads((tmp_path / "b" / "log" / f"{1:020d}.json").read_text())
    assert set(entry) == {"attempt", "state", "rows", "hash"} and entry["state"] == {"sequence": 1}
