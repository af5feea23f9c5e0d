"""Queries over recorded API pages: the tables' rows are recorded as pages, read by the page source, and flattened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdweave.plans.queries import query
from crowdweave.plans.roles import Roles
from crowdweave.sources import pages
from crowdweave.sources.shared import fresh_folder


def paged(rows: DataFrame, resource: str, key: Column, order: list, item: Column, size: int, twitch: bool = False) -> DataFrame:
    """Rows as the pages of a service: chains per key, ``size`` items each, linked by tokens."""
    chain = Window.partitionBy("key")
    placed = rows.select(key.alias("key"), F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("at"), item.alias("item"))
    placed = placed.withColumns({"ordinal": F.floor((F.col("at") - 1) / size).cast("int"), "last": F.floor((F.count(F.lit(1)).over(chain) - 1) / size).cast("int")})
    each = placed.groupBy("key", "ordinal").agg(F.first("last").alias("last"), F.array_sort(F.collect_list(F.struct("at", "item")))["item"].alias("items"))
    following = F.when(F.col("ordinal") < F.col("last"), F.concat(F.lit("t"), F.col("ordinal") + 1))
    body = F.struct(F.col("items").alias("data"), F.struct(following.alias("cursor")).alias("pagination")) if twitch else F.struct("items", following.alias("nextPageToken"))
    token = F.when(F.col("ordinal") > 0, F.concat(F.lit("t"), "ordinal"))
    return each.select(F.lit(resource).alias("resource"), "key", "ordinal", token.alias("token"), F.to_json(body).alias("body"))


def _recorded(r: Roles, made: DataFrame) -> DataFrame:
    path = fresh_folder(r.spark)
    pages.record(made, path)
    return pages.recorded(r.spark, path)


@query("videos", """
    SELECT 'UC' || channel_id AS channel_id, video_id, published_at FROM videos
    WHERE published_at >= '1995-01-01T00:00:00Z' AND published_at < '1998-01-01T00:00:00Z'""")
def uploads_pages(r: Roles) -> DataFrame:
    videos = r.videos.withColumn("number", F.substring("video_id", 2, 20).cast("long")).join(
        r.table("orders").select(F.col("o_orderkey").alias("number"), "o_orderdate"), "number"
    )
    item = F.struct(F.struct(F.col("video_id").alias("videoId"), F.col("published_at").alias("videoPublishedAt")).alias("contentDetails"))
    made = paged(videos, "playlistItems", F.concat(F.lit("UU"), "channel_id"), [F.desc("o_orderdate"), "number"], item, 50)
    start = "1995-01-01T00:00:00Z"
    return pages.uploads(pages.newest_first(_recorded(r, made), start), start, "1998-01-01T00:00:00Z")


@query("videos", """
    SELECT video_id, CASE WHEN status = 'P' THEN 'chat-' || video_id END AS live_chat_id,
        CASE WHEN seconds >= 40 AND seconds % 9 <> 0 THEN comments END AS comment_count FROM videos""")
def video_details_pages(r: Roles) -> DataFrame:
    count = F.when(F.col("seconds") % 9 == 0, "hidden").otherwise(F.col("comments").cast("string"))
    item = F.struct(
        F.col("video_id").alias("id"), F.when(F.col("status") == "P", F.struct(F.concat(F.lit("chat-"), "video_id").alias("activeLiveChatId"))).alias("liveStreamingDetails"),
        F.when(F.col("seconds") >= 40, F.struct(count.alias("commentCount"))).alias("statistics"),
    )
    return pages.video_details(_recorded(r, paged(r.videos, "videos", F.col("channel_id"), ["video_id"], item, 50)))


@query("sightings", """
    SELECT 'chat-' || creator_id AS live_chat_id, 'UC' || viewer_id AS viewer_id, strftime(observed_at, '%Y-%m-%dT%H:%M:%SZ') AS observed_at
    FROM sightings WHERE source_type = 'live_chat' AND trim(viewer_id) <> ''""")
def live_chat_pages(r: Roles) -> DataFrame:
    rows = r.sightings.where("source_type = 'live_chat'")
    author = F.when(F.trim("viewer_id") != "", F.concat(F.lit("UC"), "viewer_id")).otherwise("system")
    at = F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    item = F.struct(F.struct(author.alias("channelId")).alias("authorDetails"), F.struct(at.alias("publishedAt")).alias("snippet"))
    made = paged(rows, "liveChat/messages", F.concat(F.lit("chat-"), "creator_id"), ["observed_at", "viewer_id", "video_id"], item, 2000)
    return pages.live_chat(_recorded(r, made))


@query("accounts", """
    WITH s AS (SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') AS user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1)
    SELECT user_id AS platform_id, 'Name ' || user_id AS name, 'https://www.twitch.tv/live' || user_id AS url, n AS evidence_count
    FROM s WHERE user_id NOT IN (SELECT platform_id FROM accounts WHERE platform = 'twitch' AND platform_id IS NOT NULL)""")
def stream_candidates_pages(r: Roles) -> DataFrame:
    user = F.lpad(F.col("user_id").cast("string"), 6, "0")
    item = F.struct(user.alias("user_id"), F.concat(F.lit("live"), user).alias("user_login"), F.concat(F.lit("Name "), user).alias("user_name"))
    clicks = r.table("events").where("event_type = 'click'")
    made = paged(clicks, "streams", F.concat(F.lit("th-"), F.date_format("ts", "yyyy-MM-dd")), ["ts", "event_id"], item, 100, twitch=True)
    return pages.stream_candidates(_recorded(r, made), r.accounts)
