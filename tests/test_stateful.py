"""Stateful streams against their batch forms."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from crowdweave.streaming import catalog, enrichment, interactions

pytest.importorskip("google.protobuf")  # the state API needs it
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def dropped_in(spark, folder, number, rows, schema):
    """One file for the stream to find; files are read in the order of their times."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part={number:04d}")
    time.sleep(0.02)


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def run(stream, out, state):
    query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).trigger(availableNow=True).start()
    assert query.awaitTermination(150)
    return query


def pages_of(video, sizes, parent=None, replies=None):
    rows = []
    for ordinal, size in enumerate(sizes):
        for at in range(size):
            record = f"{parent or video}.{ordinal}.{at}"
            rows.append((video, parent, ordinal, at, size, ordinal == len(sizes) - 1, record, f"u{at}", "2024-01-01", (replies or {}).get(record, 0)))
    return rows


def threads():
    rows = pages_of("whole", [3, 2], replies={"whole.0.1": 2, "whole.1.0": 1}) + pages_of("whole", [1, 1], "whole.0.1") + pages_of("whole", [1], "whole.1.0")
    rows += pages_of("no_reply", [2], replies={"no_reply.0.0": 1})
    rows += [r for r in pages_of("hole", [3, 3, 1]) if r[6] != "hole.1.2"]
    rows += [r for r in pages_of("no_last", [2, 2]) if r[2] == 0]
    rows += [(*r[:7], None if r[6] == "nameless.0.1" else r[7], *r[8:]) for r in pages_of("nameless", [3])]
    return [*rows, ("empty", None, 0, None, 0, True, None, None, None, None)]


def test_thread_states(spark):
    items = spark.createDataFrame(threads(), interactions.ITEMS)
    assert {tuple(r) for r in interactions.states(items).collect()} == {
        ("whole", 8, 0, "EXHAUSTED"), ("no_reply", 2, 0, "REPLIES_PENDING"), ("hole", 6, 0, "COMMENTS_PENDING"), ("no_last", 2, 0, "COMMENTS_PENDING"),
        ("nameless", 2, 1, "IDENTITY_UNAVAILABLE"), ("empty", 0, 0, "EXHAUSTED"),
    }
    assert interactions.interactions(items).count() == 20


@pytest.mark.parametrize("seed", [1, 2])
def test_threads_in_any_order_cut_anywhere(spark, tmp_path, seed):
    rows = threads()
    drawn = random.Random(seed)
    sent = rows + drawn.sample(rows, 8)  # some items come again
    drawn.shuffle(sent)
    cuts = sorted(drawn.sample(range(1, len(sent)), 3))
    for number, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(sent)], strict=True)):
        dropped_in(spark, tmp_path / "in", number, sent[a:b], interactions.ITEMS)
        if number in (1, 3):  # the stream stops and goes on
            run(interactions.threads_stream(source(spark, tmp_path / "in", interactions.ITEMS)), tmp_path / "out", tmp_path / "state")
    out = spark.read.parquet(str(tmp_path / "out"))
    items = spark.createDataFrame(rows, interactions.ITEMS)
    columns = ["video_id", "record_id", "parent_id", "viewer_id", "published_at"]
    found = sorted(map(tuple, out.where("kind = 'interaction'").select(columns).collect()), key=str)
    assert found == sorted(map(tuple, interactions.interactions(items).select(columns).collect()), key=str)
    # states only grow towards the end: more records, fewer nameless ones
    last = {}
    order = ["COMMENTS_PENDING", "REPLIES_PENDING", "EXHAUSTED"]
    for r in out.where("kind = 'state'").collect():
        rank = (r.records, r.anonymous, order.index(r.status) if r.status in order else 0)
        last[r.video_id] = max(last.get(r.video_id, (rank, r.status)), (rank, r.status))
    assert {v: s for v, (_, s) in last.items()} == {r.video_id: r.status for r in interactions.states(items).collect()}


def test_a_video_that_waits_too_long_is_stalled(spark, tmp_path):
    dropped_in(spark, tmp_path / "in", 0, [threads()[0], *pages_of("other", [1])], interactions.ITEMS)
    stream = interactions.threads_stream(source(spark, tmp_path / "in", interactions.ITEMS), patience=100)
    states = set()

    def write(batch, number):
        states.update((r.video_id, r.status) for r in batch.where(F.col("kind") == "state").collect())

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").start()
    until = time.time() + 60
    while ("whole", "STALLED") not in states and time.time() < until:
        time.sleep(0.2)
    query.stop()
    assert states == {("whole", "COMMENTS_PENDING"), ("whole", "STALLED"), ("other", "EXHAUSTED")}


def uploads(channel, pages, last=True):
    """pages: lists of (video, title, date)."""
    return [
        (channel, ordinal, at, len(page), last and ordinal == len(pages) - 1, video, title, date, datetime(2024, 1, 1, 0, ordinal))
        for ordinal, page in enumerate(pages) for at, (video, title, date) in enumerate(page)
    ]


def many(n, start=0):
    return [(f"v{k}", f"title {k}", f"2024-{12 - k // 28:02d}-{28 - k % 28:02d}") for k in range(start, start + n)]


CHANNELS = [
    *uploads("ends", [many(4), many(3, 4)]),
    *uploads("open", [many(4), many(3, 4)], last=False),
    *uploads("over", [many(5), many(5, 5)]),
    *uploads("exact", [many(4), many(4, 4)]),
    *uploads("exact_open", [many(4), many(4, 4)], last=False),
    *uploads("mixed", [[("a", "A", "2024-02-02"), (None, "B", None), ("c", "Private video", None), ("d", "", "2024-01-01")], [("a", "A", "2024-02-02"), ("e", "E", None), ("f", "F", "2024-03-03")]]),
    *uploads("hidden", [[("x", "Deleted video", None)]]),
    *uploads("behind_cap", [many(8), [("y", "Private video", None), ("v0", "title 0", None)]]),
]


def test_catalog_states(spark):
    items = spark.createDataFrame(CHANNELS, catalog.ITEMS)
    found = {r.channel_id: tuple(r)[1:] for r in catalog.channel_states(items, 8).collect()}
    assert found == {
        "ends": (7, 0, 0, "NOT_VALIDATED", "2024-12-22", "PLAYLIST_EXHAUSTED"), "open": (7, 0, 0, "NOT_VALIDATED", "2024-12-22", "PENDING"),
        "over": (8, 0, 0, "NOT_VALIDATED", "2024-12-21", "CAP_REACHED"), "exact": (8, 0, 0, "NOT_VALIDATED", "2024-12-21", "PLAYLIST_EXHAUSTED"),
        "exact_open": (8, 0, 0, "NOT_VALIDATED", "2024-12-21", "CAP_REACHED"), "mixed": (3, 3, 1, "NON_MONOTONIC", "2024-02-02", "PLAYLIST_EXHAUSTED"),
        "hidden": (0, 1, 0, "NOT_VALIDATED", None, "PLAYLIST_EXHAUSTED"), "behind_cap": (8, 0, 0, "NOT_VALIDATED", "2024-12-21", "CAP_REACHED"),
    }


def test_catalog_stream_equals_batch_and_forgets(spark, tmp_path):
    rows = list(CHANNELS)
    drawn = random.Random(4)
    drawn.shuffle(rows)
    rows += drawn.sample(rows, 10)  # come again
    for number in range(4):
        dropped_in(spark, tmp_path / "in", number, rows[number::4], catalog.ITEMS)
    query = run(catalog.catalog_stream(source(spark, tmp_path / "in", catalog.ITEMS), 8), tmp_path / "out", tmp_path / "state")
    out = spark.read.parquet(str(tmp_path / "out"))
    items = spark.createDataFrame(CHANNELS, catalog.ITEMS)
    columns = ["channel_id", "video_id", "title", "published_at"]
    assert sorted(map(tuple, out.where("kind = 'video'").select(columns).collect()), key=str) == sorted(map(tuple, catalog.catalog(items, 8).select(columns).collect()), key=str)
    columns = ["channel_id", "accessible", "inaccessible", "duplicates", "ordering", "oldest", "status"]
    last = {}
    for r in out.where("kind = 'state'").select(columns).collect():
        rank = (r.status != "PENDING", sum(tuple(r)[1:4]))
        last[r.channel_id] = max(last.get(r.channel_id, (rank, tuple(r))), (rank, tuple(r)), key=lambda x: x[0])
    assert {r for _, r in last.values()} == {tuple(r) for r in catalog.channel_states(items, 8).select(columns).collect()}
    # one channel is open: its 7 videos stay; all others have one row
    held = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert held <= 8 + 7


def test_items_that_come_again_and_state_that_expires(spark, tmp_path):
    schema = catalog.ITEMS
    first = [("c", 0, at, 5, False, f"v{at}", "t", None, datetime(2024, 1, 1, 0, 0)) for at in range(5)]
    again = [(*r[:8], datetime(2024, 1, 1, 0, 30)) for r in first]
    much_later = [("d", 0, 0, 1, True, "w", "t", None, datetime(2024, 1, 3))]
    for number, rows in enumerate([first, again, much_later, [(*much_later[0][:8], datetime(2024, 1, 3, 0, 1))]]):
        dropped_in(spark, tmp_path / "in", number, rows, schema)
    query = run(catalog.once(source(spark, tmp_path / "in", schema)), tmp_path / "out", tmp_path / "state")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # the channel of two days before is forgotten


def test_videos_of_unfinished_channels_expire(spark, tmp_path):
    dropped_in(spark, tmp_path / "in", 0, uploads("open", [many(6)], last=False), catalog.ITEMS)
    stream = catalog.catalog_stream(source(spark, tmp_path / "in", catalog.ITEMS), 50, timedelta(milliseconds=400))
    query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").start()

    def held():
        return [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]

    until = time.time() + 60
    while not (held() and max(held()) > held()[-1]) and time.time() < until:
        time.sleep(0.2)
    query.stop()
    assert max(held()) > held()[-1]


def test_enriched_streams_equal_the_batch_join(spark, tmp_path):
    def day(n, hour=0):
        return datetime(2024, 1, 1) + timedelta(days=n, hours=hour)

    listed, fetched = "video_id string, listed_at timestamp", "video_id string, fetched_at timestamp, seconds int"
    left = [[("a", day(0)), ("b", day(0, 1)), ("c", day(0, 2))], [("d", day(3))], [("e", day(6))], [("end", day(30))]]
    right = [[("a", day(0, 5), 1), ("a", day(0, 6), 2), ("x", day(0, 5), 9)], [("b", day(3), 3), ("d", day(3, 1), 4)], [("e", day(6, 20), 5)], [("end", day(30, 1), 6)]]
    for number, (u, d) in enumerate(zip(left, right, strict=True)):
        dropped_in(spark, tmp_path / "u", number, u, listed)
        dropped_in(spark, tmp_path / "d", number, d, fetched)
    u, d = source(spark, tmp_path / "u", listed), source(spark, tmp_path / "d", fetched)
    query = run(enrichment.enriched(u, d), tmp_path / "out", tmp_path / "state")
    found = sorted(map(str, spark.read.parquet(str(tmp_path / "out")).where("video_id <> 'end'").collect()))
    batch = enrichment.enriched(spark.createDataFrame(sum(left, []), listed), spark.createDataFrame(sum(right, []), fetched))
    assert found == sorted(map(str, batch.where("video_id <> 'end'").collect())) and len(found) == 6
    assert enrichment.dropped(query) == 0
    dropped_in(spark, tmp_path / "d", 9, [("e", day(6, 21), 7)], fetched)  # three weeks late
    late = run(enrichment.enriched(u, d), tmp_path / "out", tmp_path / "state")
    assert enrichment.dropped(late) == 1
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).where("video_id <> 'end'").collect())) == found
