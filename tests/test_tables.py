import datetime
import json
import zoneinfo

import pytest
from pyspark.sql import functions as F

from crowdweave.operators import checks, growth, matching, merge, registry, selection
from crowdweave.sources import readers, sinks
from crowdweave.streaming import ingest

T = datetime.datetime(2024, 1, 1)


def test_growth_uses_the_last_point_within_the_span_and_its_slack(spark):
    days = [("2026-06-25", 1000, 10), ("2026-08-20", 1300, 40), ("2026-09-19", 1400, 70), ("2026-09-26", 1500, 100)]
    rows = [("c", *d) for d in days] + [("far", "2026-09-01", 1, 1), ("far", "2026-09-15", 2, 2), ("single", "2026-09-01", 1, 1), ("hidden", "2026-09-01", 5, 5), ("hidden", "2026-09-08", None, 9)]
    found = {r.channel_id: r for r in growth.growth(spark.createDataFrame(rows, "channel_id string, day string, subscribers long, views long")).collect()}
    c = found["c"]
    assert (c.subscribers_delta_7d, c.subscribers_delta_30d, c.subscribers_delta_90d, c.views_delta_30d, c.history_points) == (100, 200, 500, 60, 4)
    assert (c.baseline_7d, c.baseline_30d, c.baseline_90d) == ("2026-09-19", "2026-08-20", "2026-06-25")
    assert found["far"].subscribers_delta_7d is None and "single" not in found
    assert found["hidden"].subscribers_delta_7d is None and found["hidden"].baseline_7d is None


def test_growth_tables_merge_once_history_is_long(spark):
    schema = "channel_id string, first_date string, last_date string, history_points long"
    old = spark.createDataFrame([("a", "x", "x", 1), ("b", "x", "x", 1)], schema)
    new = spark.createDataFrame([("a", "2024-01-01", "2024-01-08", 2), ("b", "2024-01-01", "2024-01-03", 2), ("c", "2024-01-01", "2024-01-02", 2)], schema)
    assert {r.channel_id: r.history_points for r in growth.merge_growth(old, new).collect()} == {"a": 2, "b": 1, "c": 2}


def test_insert_if_absent(spark):
    schema = "k string, n int"
    old = spark.createDataFrame([("h0", 0)], schema)
    first = merge.absent(spark.createDataFrame([("h1", 2), ("h2", 1), ("h1", 1), ("h0", 5)], schema), old, ["k"], ["n"])
    assert sorted(map(tuple, first.collect())) == [("h1", 1), ("h2", 1)]
    again = merge.absent(spark.createDataFrame([("h2", 9), ("h3", 9)], schema), old.unionByName(first), ["k"], ["n"])
    assert [r.k for r in again.collect()] == ["h3"]


def test_upsert_and_diff_look_at_supplied_columns_only(spark):
    old = spark.createDataFrame([("a", "1", None), ("b", "2", "x")], "id string, p string, q string")
    change = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4"), ("b2", None)], "id string, p string")
    assert {r.id: r.action for r in merge.diff(old, change, "id").collect()} == {"a": "unchanged", "b": "updated", "c": "added", "b2": "added"}
    assert {r.id: (r.p, r.q) for r in merge.upsert(old, change, "id").collect()} == {"a": ("1", None), "b": ("3", "x"), "c": ("4", None), "b2": (None, None)}
    again = merge.diff(merge.upsert(old, change, "id"), change, "id")
    assert {r.action for r in again.collect()} == {"unchanged"}


def test_derived_rows_replace_seed_rows(spark):
    schema = "a string, b string, n int"
    both = merge.replace_derived(spark.createDataFrame([("x", "y", 1), ("x", "z", 1)], schema), spark.createDataFrame([("x", "y", 5)], schema), ["a", "b"])
    assert sorted(r.n for r in both.collect()) == [1, 5]


def test_registry_defaults_and_eligibility(spark):
    accounts = spark.createDataFrame(
        [("1", "youtube", "UC1", None, "Acc", "u", "d0"), ("2", "youtube", "UC2", "", "", "u", "d0"), ("3", "youtube", "UC3", "h", "N", "u", "d0"), ("4", "tiktok", "t", "h4", "N4", "u4", "d0")],
        "id string, platform string, platform_id string, handle string, name string, url string, first_discovered_at string",
    )
    personas = spark.createDataFrame([("p", "Canon", "verified"), ("q", "No", "pending")], "id string, canonical_name string, review_status string")
    links = spark.createDataFrame([("l1", "1", "p", "verified", "d1"), ("l2", "3", "q", "verified", "d1"), ("l4", "4", "p", "verified", None)], "id string, account_id string, persona_id string, review_status string, reviewed_at string")
    legacy = spark.createDataFrame([("g", "2", "", "d2")], "id string, account_id string, source_agency string, source_checked_at string")
    affiliations = spark.createDataFrame([], "id string, persona_id string, organization string, review_status string")
    found = {r.channel_id: r for r in registry.creators_table(accounts, links, personas, affiliations, legacy).collect()}
    assert set(found) == {"UC1", "UC2"}
    assert (found["UC1"].name, found["UC1"].agency, found["UC1"].last_collected, found["UC1"].handle) == ("Canon", "Independent", "d1", "")
    assert (found["UC2"].name, found["UC2"].agency, found["UC2"].persona_id) == ("UC2", "Independent", "")
    (row,) = registry.platform_table(accounts, links, personas, "tiktok").collect()
    assert (row.persona_name, row.observed_at) == ("Canon", "")


def test_matching_counts_accounts_not_keys(spark):
    accounts = spark.createDataFrame([("a", "twitch", "7", "@Me", "https://x.org/me"), ("b", "twitch", "", "other", "https://x.org/b"), ("c", "youtube", "UC", "me", "")], "id string, platform string, platform_id string, handle string, url string")
    found = spark.createDataFrame([(1, "twitch", "7", "me", "http://www.x.org/me/"), (2, "twitch", "", "me", "x.org/b"), (3, "youtube", "", "me", ""), (4, "x", None, None, None)], "row_id int, platform string, channel_id string, handle string, url string")
    assert {r.row_id: r.matches for r in matching.match(found, accounts).collect()} == {1: 1, 2: 2, 3: 0, 4: 0}


def test_selection(spark):
    rows = spark.createDataFrame([(f"g{i % 3}", i) for i in range(10)], "g string, n int")
    assert sorted(r.n for r in selection.top_per_group(rows, "g", [F.desc("n")], 1).collect()) == [7, 8, 9]
    assert [r.n for r in selection.rotating(rows.select("n"), "n", 8, 4).collect()] == [8, 9, 0, 1]
    assert selection.rotating(rows.where("false"), "n", 3, 4).count() == 0
    assert selection.balanced(rows, "g", ["n"], 2, 5).count() == 5
    jobs = selection.jobs(spark.createDataFrame([("c",)], "channel_id string"), ["s1", "s2"], spark.createDataFrame([], "channel_id string, priority double"))
    assert sorted((r.job_id, r.priority) for r in jobs.collect()) == [("c:s1", 1.0), ("c:s2", 1.0)]


def test_batches(spark):
    import hashlib

    def batch(path, payloads, **change):
        digest = hashlib.sha256("\n".join(payloads).encode()).hexdigest()
        manifest = {"sha256": digest, "rows": len(payloads)} | change
        kinds = ["event"] * (len(payloads) - 1) + ["state"]
        return [(path, i + 1, k, p) for i, (k, p) in enumerate(zip(kinds, payloads, strict=True))] + [(path, len(payloads) + 1, "batch_manifest", json.dumps(manifest))]

    rows = batch("good", ["a", "b", "s"]) + batch("digest", ["a", "s"], sha256="0") + batch("count", ["a", "s"], rows=9) + batch("gap", ["a", "s"])[1:] + batch("open", ["a", "s"])[:-1]
    found = {r.path: (r.events, r.problem) for r in checks.batches(spark.createDataFrame(rows, "path string, row_number int, kind string, payload string")).collect()}
    assert found["good"] == (2, None) and found["digest"][1] == "digest differs" and found["count"][1] == "row count differs"
    assert found["gap"][1] == "rows are not contiguous" and found["open"][1] == "no manifest at the end"


def test_policy(spark):
    assert checks.public_columns(spark.createDataFrame([], "a int, Viewer_ID string, message string")) == ["Viewer_ID", "message"]
    rows = spark.createDataFrame([("x AIza" + "a" * 35,), ("plain",), (None,)], "t string")
    assert [r.s for r in rows.select(checks.holds_secret(F.col("t")).alias("s")).collect()] == [True, False, False]


def test_presence_files_of_two_layouts(spark, tmp_path):
    spark.createDataFrame([("c", "v", "w", "comment", T, T, 3)], readers.PRESENCE).write.parquet(f"{tmp_path}/in/new")
    old = spark.createDataFrame([("c", "v2", "h", "live_chat", T)], "creator_id string, video_id string, viewer_hash string, source_type string, timestamp timestamp")
    old.write.parquet(f"{tmp_path}/in/old/deep")
    found = {r.video_id: r for r in readers.presence_files(spark, f"{tmp_path}/in").collect()}
    assert (found["v2"].channel_id, found["v2"].viewer_id, found["v2"].appearances, found["v2"].first_seen) == ("c", "h", 1, T)
    assert found["v"].appearances == 3 and readers.presence_files(spark, None).count() == 0
    with pytest.raises(Exception, match="invalid presence row"):
        readers.require_valid(spark.createDataFrame([("c", " ", "w", "comment", T, T, 1)], readers.PRESENCE)).collect()
    readers.require_one_layout(spark, f"{tmp_path}/in")


def test_json_sources(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"schema_version": 1, "tables": {"personas": [{"id": "p", "name": "n"}]}}))
    assert [tuple(r) for r in readers.registry_tables(spark, f"{tmp_path}/r.json", "personas", "id: string, name: string").collect()] == [("p", "n")]
    (tmp_path / "c.json").write_text(json.dumps({"creators": [{"creator_id": "c", "evidence_ids": ["e"], "metadata": {"a": "b"}}], "accounts": [], "evidence": [{"evidence_id": "e"}, {"evidence_id": "f"}]}))
    doc = readers.creator_registry(spark, f"{tmp_path}/c.json")
    assert [r.evidence_id for r in checks.orphan_evidence(doc["evidence"], doc["creators"]).collect()] == ["f"]
    body = json.dumps({"items": [{"snippet": {"videoId": "v", "totalReplyCount": 2, "topLevelComment": {"id": "t", "snippet": {"authorChannelId": {"value": "UCa"}, "publishedAt": "2024"}}}, "replies": {"comments": [{"id": "t.1", "snippet": {"authorChannelId": {"value": "UCb"}}}]}}]})
    comments, more = readers.comment_threads(spark.createDataFrame([(body,)], "body string"))
    assert [(r.comment_id, r.parent_id, r.viewer_id) for r in comments.collect()] == [("t", None, "UCa"), ("t.1", "t", "UCb")] and more.count() == 1
    pages = spark.createDataFrame([('<a href="https://youtube.com/channel/UC' + "a" * 22 + '">x</a> youtube.com/channel/UCshort <script>data = [{"n": 1}];</script>',)], "html string")
    assert readers.directory_channels(pages).count() == 1
    assert [r.n for r in readers.embedded_json(pages, "data", "n: int").collect()] == [1]
    records = spark.createDataFrame([("deep/x", "t", 1, json.dumps({"channel_id": "c", "viewer_hash": "w", "timestamp": "2024-01-01T00:00:00Z"})), ("other", "t", 1, "no json")], "source_path string, source_table string, row_number int, record_json string")
    events = readers.archive_events(records)
    assert [(r.viewer_id, r.tier) for r in events.where("viewer_id is not null").collect()] == [("w", 1)]
    assert readers.unified(events, events.withColumn("tier", F.lit(0))).select(F.max("tier")).first()[0] == 0
    assert readers.sample_presence(spark, 200).where("source_type = 'live_chat'").count() > 100


def test_tables_and_delivery(spark, tmp_path):
    table = sinks.Table(spark, f"{tmp_path}/t")
    assert table.version() == 0 and table.read("a int").count() == 0
    table.write(spark.range(3))
    table.write(table.read().where("id > 0"))
    assert table.version() == 2 and table.read().count() == 2
    assert sinks.verified_write(spark.range(5), f"{tmp_path}/w").count() == 5
    assert sinks.deliver_csv(spark.range(2), f"{tmp_path}/o.csv", ["id"]) == 2
    assert (tmp_path / "o.csv").read_bytes() == b"\xef\xbb\xbfid\r\n0\r\n1\r\n"
    sinks.json_lines(spark.range(2), f"{tmp_path}/j", ["id"])
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    rows = spark.createDataFrame([("c", "v", "comment", "w", T, T, 2), ("d", "v", "comment", "w", T, T, 1)], ingest.SNAPSHOTS)
    sinks.merge_presence(spark, f"{tmp_path}/p", rows)
    sinks.merge_presence(spark, f"{tmp_path}/p", rows.where("channel_id = 'c'").withColumn("appearances", F.lit(5).cast("long")))
    assert {r.channel_id: r.appearances for r in spark.read.parquet(f"{tmp_path}/p").collect()} == {"c": 5, "d": 1}


def run(stream, path, write=None, mode="update", name=None):
    writer = stream.writeStream.option("checkpointLocation", path).outputMode(mode).trigger(availableNow=True)
    writer = writer.foreachBatch(write) if write else writer.format("memory").queryName(name)
    writer.start().awaitTermination(120)


def test_streams_are_idempotent(spark, tmp_path):
    source = f"{tmp_path}/source"
    rows = spark.createDataFrame([("A", "v", "x", "comment", T), ("A", "v", "x", "comment", T), ("A", "v", "x", "live_chat", T), ("A", "v", "x", "other", T)], ingest.INTERACTIONS)
    rows.write.parquet(source)
    stream = spark.readStream.schema(ingest.INTERACTIONS).parquet(source)
    path = f"{tmp_path}/interactions"
    run(stream, f"{tmp_path}/c1", ingest.insert_interactions(spark, path))
    rows.write.mode("append").parquet(source)
    run(stream, f"{tmp_path}/c1", ingest.insert_interactions(spark, path))
    assert ingest.inserted(spark, path).count() == 2
    run(stream, f"{tmp_path}/c2", ingest.insert_interactions(spark, path))  # all of it again, from the first batch on
    assert ingest.inserted(spark, path).count() == 2
    assert {r.source_type for r in spark.read.parquet(f"{path}.rejected").collect()} == {"other"}

    events = rows.select(F.col("creator_id").alias("channel_id"), "video_id", "viewer_id", "source_type", F.col("observed_at").alias("timestamp"), *[F.lit(None).cast("timestamp").alias(c) for c in ("first_seen", "last_seen")], F.lit(1).cast("long").alias("appearances"))
    for _ in range(2):
        ingest.merge_snapshots(spark, f"{tmp_path}/snapshots")(events, 0)
    assert sorted(r.appearances for r in spark.read.parquet(f"{tmp_path}/snapshots").collect()) == [1, 2]


def test_state_windows_and_changes(spark, tmp_path):
    spark.createDataFrame([("v", "w", T), ("v", "w", T + datetime.timedelta(hours=1))], "video_id string, viewer_id string, interaction_at timestamp").write.parquet(f"{tmp_path}/o")
    stream = spark.readStream.schema("video_id string, viewer_id string, interaction_at timestamp").parquet(f"{tmp_path}/o")
    run(ingest.viewer_state(stream), f"{tmp_path}/c3", name="viewers")
    assert [(r.appearances, r.last_at) for r in spark.table("viewers").collect()] == [(2, T + datetime.timedelta(hours=1))]
    spark.createDataFrame([(T, 3), (T, 4)], "at timestamp, units long").write.parquet(f"{tmp_path}/l")
    ledger = spark.readStream.schema("at timestamp, units long").parquet(f"{tmp_path}/l")
    run(ingest.spent_per_day(ledger), f"{tmp_path}/c4", name="spent")
    # the quota day is a Pacific one
    day = T.replace(tzinfo=datetime.timezone.utc).astimezone(zoneinfo.ZoneInfo("America/Los_Angeles")).replace(hour=0, minute=0, second=0, tzinfo=None)
    assert [(r.day, r.units) for r in spark.table("spent").collect()] == [(day, 7)]
    table, done = sinks.Table(spark, f"{tmp_path}/t"), sinks.Table(spark, f"{tmp_path}/d")
    table.write(spark.createDataFrame([("a", "1")], "id string, p string"))
    write = ingest.change_files(table, done, "id")
    for _ in range(2):
        write(spark.createDataFrame([("a", "2"), ("b", "3")], "id string, p string"), 0)
    assert table.version() == 2 and {r.id: r.action for r in done.read().collect()} == {"a": "updated", "b": "added"}
    # a failure between the table and the ledger: the replay records what the batch did
    changes = spark.createDataFrame([("b", "4"), ("c", "5")], "id string, p string")
    broken = sinks.Table(spark, f"{tmp_path}/d")
    broken.write = lambda rows: (_ for _ in ()).throw(OSError("stopped"))
    with pytest.raises(OSError):
        ingest.change_files(table, broken, "id")(changes, 1)
    write(changes, 1)
    assert {(r.id, r.action) for r in done.read().where("batch_id = 1").collect()} == {("b", "updated"), ("c", "added")}


def test_changes_are_applied_in_order(spark):
    from crowdweave.operators import workflow

    tables = {"p": spark.createDataFrame([("1", "a")], "id string, n string"), "q": spark.createDataFrame([], "id string, p string")}
    changes = {"q": spark.createDataFrame([("9", "1")], "id string, p string"), "p": spark.createDataFrame([("1", "b")], "id string, n string")}
    same, counts = workflow.apply_changes(tables, changes, ["p", "q"], dry_run=True)
    assert same == tables and [tuple(r) for r in counts.collect()] == [("p", "updated", 1), ("q", "added", 1)]
    new, _ = workflow.apply_changes(tables, changes, ["p", "q"])
    assert [tuple(r) for r in new["p"].collect()] == [("1", "b")] and [tuple(r) for r in new["q"].collect()] == [("9", "1")]
    again = workflow.apply_changes(new, changes, ["p", "q"])[1]
    assert {r.action for r in again.collect()} == {"unchanged"}


def test_observations_intake_and_catalog(spark, tmp_path):
    schema = "channel_id string, video_id string, viewer_id string, n int"
    sinks.write_observations(spark.createDataFrame([("a", "v1", "x", 1), ("b", "v2", "y", 2)], schema), f"{tmp_path}/o")
    sinks.write_observations(spark.createDataFrame([("a", "v3", "z", 3), ("a", "v1", "w", 4)], schema), f"{tmp_path}/o")
    sinks.write_observations(spark.createDataFrame([("a", "v3", "z", 5)], schema), f"{tmp_path}/o")
    found = spark.read.parquet(f"{tmp_path}/o").select("channel_id", "video_id", "n").collect()
    assert sorted(map(tuple, found)) == [("a", "v1", 4), ("a", "v3", 5), ("b", "v2", 2)]
    rows = spark.createDataFrame([("c1", "CONFIRMED", 5), ("c2", "UNCONFIRMED", None), ("c3", None, 1)], "channel_id string, status string, subs int")
    sinks.write_intake(rows, f"{tmp_path}/i", F.col("status") == "CONFIRMED", ["channel_id", "subs"])
    assert [r.channel_id for r in spark.read.json(f"{tmp_path}/i/intake").collect()] == ["c1"]
    kept = spark.read.option("header", True).csv(f"{tmp_path}/i/quarantine").collect()
    assert sorted((r.channel_id, r.subs) for r in kept) == [("c2", None), ("c3", "1")]
    table = sinks.write_catalog(rows, f"{tmp_path}/c")
    again = spark.read.option("header", True).schema(rows.schema).csv(f"{tmp_path}/c/csv")
    assert table.schema == rows.schema and sorted(map(repr, table.collect())) == sorted(map(repr, again.collect())) == sorted(map(repr, rows.collect()))
