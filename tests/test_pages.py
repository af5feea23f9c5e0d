"""The page source: chains, pushed filters, early end, streams that stop and go on."""

import json
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException

from crowdweave.sources import pages

DAY = "2024-01-{:02d}T00:00:00Z"


def put(folder, resource, key, ordinal, items, following=None, token=None):
    """One page by hand; items: (video, day or None)."""
    place = Path(folder) / resource / key
    place.mkdir(parents=True, exist_ok=True)
    body = {"items": [{"contentDetails": {"videoId": v} | ({"videoPublishedAt": DAY.format(d)} if d else {})} for v, d in items]}
    if following:
        body["nextPageToken"] = following
    (place / f"{ordinal:08d}~{token or ''}.json").write_text(json.dumps(body))


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "pages"
    put(root, "playlistItems", "UUa", 0, [("a9", 29), ("a8", 28)], "t1")
    put(root, "playlistItems", "UUa", 1, [("a7", 17), ("private", None), ("a6", 16)], "t2", "t1")
    put(root, "playlistItems", "UUa", 2, [("a5", 5)], None, "t2")
    put(root, "playlistItems", "UUb", 0, [("b1", 20), ("a9", None)])
    put(root, "videos", "UUa", 0, [("x", 1)])
    return str(root)


def test_chains_and_tokens(spark, folder):
    rows = pages.recorded(spark, folder).where("resource = 'playlistItems'").orderBy("key", "ordinal").collect()
    assert [(r.key, r.ordinal, r.token, r.next_token) for r in rows] == [("UUa", 0, None, "t1"), ("UUa", 1, "t1", "t2"), ("UUa", 2, "t2", None), ("UUb", 0, None, None)]
    assert [r.newest.strftime("%d") for r in rows] == ["29", "17", "05", "20"]
    assert pages.recorded(spark, folder, resource="videos").count() == 1 and pages.recorded(spark, folder + "/none").count() == 0


def test_uploads_of_a_period(spark, folder):
    found = pages.uploads(pages.recorded(spark, folder), DAY.format(6), DAY.format(29))
    assert sorted((r.channel_id, r.video_id) for r in found.collect()) == [("UCa", "a6"), ("UCa", "a7"), ("UCa", "a8"), ("UCb", "b1")]


def test_pages_after_the_bound_are_not_opened(spark, folder):
    """A page that cannot be read stands behind the first page that is too old."""
    broken = Path(folder) / "playlistItems" / "UUa" / "00000003~t3.json"
    broken.write_text("not json")
    old = Path(folder) / "playlistItems" / "UUb" / "00000001~t1.json"
    old.write_text("not json either")
    put(folder, "playlistItems", "UUb", 0, [("b1", 2)])  # this chain ends at its first page
    recent = pages.newest_first(pages.recorded(spark, folder, resource="playlistItems"), DAY.format(10))
    assert sorted(r.video_id for r in pages.uploads(recent, DAY.format(10), DAY.format(31)).collect()) == ["a6", "a7", "a8", "a9"]
    with pytest.raises(Exception, match="JSON|Expecting value"):
        pages.recorded(spark, folder, resource="playlistItems").collect()


def test_pushed_filters(folder):
    reader = pages.PagesReader(folder, {})
    left = list(reader.pushFilters([pages.EqualTo(("resource",), "playlistItems"), pages.EqualTo(("key",), "UUb"), pages.EqualTo(("ordinal",), 0)]))
    assert [f.attribute for f in left] == [("ordinal",)]
    assert [p.names for p in reader.partitions()] == [[("playlistItems/UUb", "00000000~.json")]]


def test_details_chat_and_streams(spark, tmp_path):
    def page(resource, body):
        place = tmp_path / "p" / resource.replace("/", "%2F") / "k"
        place.mkdir(parents=True)
        (place / "00000000~.json").write_text(json.dumps(body))

    page("videos", {"items": [{"id": "v1", "liveStreamingDetails": {"activeLiveChatId": "c1"}, "statistics": {"commentCount": "12"}}, {"id": "v2", "statistics": {}},
                              {"id": "v3", "liveStreamingDetails": {}, "statistics": {"commentCount": "many"}}, {"statistics": {"commentCount": "1"}}]})
    page("liveChat/messages", {"items": [{"authorDetails": {"channelId": "UCx"}, "snippet": {"publishedAt": "2024-01-01T00:00:00Z"}}, {"authorDetails": {"channelId": "other"}}, {}]})
    page("streams", {"data": [{"user_id": "1", "user_login": "one", "user_name": "One"}, {"user_id": "1", "user_login": "one", "user_name": "One"}, {"user_id": "2", "user_login": "two", "user_name": "Two"}]})
    found = pages.recorded(spark, str(tmp_path / "p"))
    assert sorted(map(tuple, pages.video_details(found).collect())) == [("v1", "c1", 12), ("v2", None, None), ("v3", None, None)]
    assert [tuple(r) for r in pages.live_chat(found).collect()] == [("k", "UCx", "2024-01-01T00:00:00Z")]
    accounts = spark.createDataFrame([("twitch", "2"), ("youtube", "1")], "platform string, platform_id string")
    assert [tuple(r) for r in pages.stream_candidates(found, accounts).collect()] == [("1", "One", "https://www.twitch.tv/one", 2)]


def test_record_and_read(spark, tmp_path):
    rows = [("videos", f"k {k}/é", n, f"t/{n}" if n else None, json.dumps({"items": [], "nextPageToken": str(n)})) for k in range(3) for n in range(70)]
    for _ in range(2):  # a second run writes the same pages
        pages.record(spark.createDataFrame(rows, "resource string, key string, ordinal int, token string, body string").repartition(4), str(tmp_path / "out"))
    back = pages.recorded(spark, str(tmp_path / "out")).select("resource", "key", "ordinal", "token", "body").collect()
    assert sorted(map(tuple, back), key=str) == sorted(rows, key=str)


def test_a_stream_that_stops_goes_on_without_loss_or_repeats(spark, folder, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    fail_at: list[int] = []

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number in fail_at:  # after the rows are out, before the batch is committed
            raise RuntimeError("stopped")

    def run():
        stream = pages.recorded_stream(spark, folder, resource="playlistItems").writeStream.foreachBatch(write).option("checkpointLocation", state)
        stream.trigger(availableNow=True).start().awaitTermination(60)

    def held():
        return sorted((r.key, r.ordinal) for r in spark.read.parquet(out).collect())

    first = [("UUa", 0), ("UUa", 1), ("UUa", 2), ("UUb", 0)]
    run()
    assert held() == first
    run()  # nothing new
    assert held() == first
    put(folder, "playlistItems", "UUb", 1, [("b2", 3)], "t2", "t1")
    put(folder, "playlistItems", "UUc", 0, [("c1", 3)])
    fail_at.append(1)
    with pytest.raises(StreamingQueryException):
        run()
    put(folder, "playlistItems", "UUb", 2, [("b3", 3)], None, "t2")  # comes while the stream is down
    fail_at.clear()
    run()  # the batch that failed, with the pages that it had
    assert held() == sorted([*first, ("UUb", 1), ("UUc", 0)])
    run()
    assert held() == sorted([*first, ("UUb", 1), ("UUb", 2), ("UUc", 0)])
