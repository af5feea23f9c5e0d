"""Recorded API pages as a Spark data source: ``spark.read.format("recorded_pages")`` and ``spark.readStream``.

A folder holds one JSON file per page, ``<resource>/<key>/<ordinal>~<token>.json``: a chain of pages per resource and
key (a playlist, a video, a chat), each under the token that asked for it. Pages of a chain come newest first, as the
services send them.

Batch: a task reads up to ``PAGES_PER_TASK`` pages. Filters on resource and key are pushed into the listing. A lower
bound on ``newest`` ends a chain at the first page below it, so later pages are never opened; then a chain is one task.
Stream: the offset holds, per chain, the last page (ordinal and token) that was taken, so a stream that stops goes on
after that page, and a batch that is run again reads the same pages. With ``availableNow`` Spark runs one batch of such a
source: one that failed is run again first, and the next run takes what came since. Listing is the driver's only work.

``write.format("recorded_pages")`` records pages; a task that is run again writes the same files.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceWriter,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    WriterCommitMessage,
)

PAGES_PER_TASK = 64
SCHEMA = "resource string, key string, ordinal int, token string, next_token string, newest timestamp, body string"
#: Fields whose largest value is a page's ``newest`` time.
_TIMES = re.compile(r'"(?:videoPublishedAt|publishedAt)"\s*:\s*"([^"]+)"')


@dataclass
class Pages(InputPartition):
    """Pages of one task, in order: (chain, file name)."""

    names: list[tuple[str, str]]
    since: datetime | None = None


def _place(path: str) -> tuple[pa.fs.FileSystem, str]:
    fs, root = pa.fs.FileSystem.from_uri(path)
    return fs, root.rstrip("/")


def listed(path: str, wanted: dict[str, str]) -> dict[str, list[str]]:
    """File names of each chain, by ordinal."""
    fs, root = _place(path)
    found: dict[str, list[str]] = {}
    start = "/".join([root, *([quote(wanted["resource"], safe="")] if "resource" in wanted else [])])
    for info in fs.get_file_info(pa.fs.FileSelector(start, allow_not_found=True, recursive=True)):
        parts = info.path[len(root) + 1 :].split("/")
        if info.type == pa.fs.FileType.File and len(parts) == 3 and parts[2].endswith(".json") and wanted.get("key", unquote(parts[1])) == unquote(parts[1]):
            found.setdefault(f"{parts[0]}/{parts[1]}", []).append(parts[2])
    return {chain: sorted(names) for chain, names in sorted(found.items())}


def _instant(text: str) -> datetime | None:
    try:
        at = datetime.fromisoformat(text)
    except ValueError:
        return None
    return at if at.tzinfo else None


def read_pages(path: str, part: Pages) -> Iterator[tuple]:
    """Rows of SCHEMA; a chain ends at its first page whose newest time lies before ``since``."""
    fs, root = _place(path)
    ended = set()
    for chain, name in part.names:
        if chain in ended:
            continue
        with fs.open_input_stream(f"{root}/{chain}/{name}") as file:
            body = file.read().decode()
        newest = max(filter(None, map(_instant, _TIMES.findall(body))), default=None)
        if part.since is not None and newest is not None and newest < part.since:
            ended.add(chain)
            continue
        page = json.loads(body)
        following = page.get("nextPageToken") or (page.get("pagination") or {}).get("cursor") or None
        resource, key = map(unquote, chain.split("/"))
        ordinal, _, token = name.removesuffix(".json").partition("~")
        yield resource, key, int(ordinal), unquote(token) or None, following, newest, body


def _dealt(chains: dict[str, list[str]], since: datetime | None) -> list[Pages]:
    whole = [[(chain, name) for name in names] for chain, names in chains.items()]
    if since is None:
        flat = [page for pages in whole for page in pages]
        whole = [flat[i : i + PAGES_PER_TASK] for i in range(0, len(flat), PAGES_PER_TASK)]
    return [Pages(pages, since) for pages in whole]


class PagesReader(DataSourceReader):
    def __init__(self, path: str, wanted: dict[str, str]):
        self.path, self.wanted, self.since = path, wanted, None

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0]
            if isinstance(f, EqualTo) and name in ("resource", "key") and name not in self.wanted:
                self.wanted[name] = f.value
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and name == "newest":
                at = f.value if f.value.tzinfo else f.value.astimezone()
                self.since = at if self.since is None else max(self.since, at)
                yield f  # pages without a time, and the bound itself, are left to Spark
            else:
                yield f

    def partitions(self):
        return _dealt(listed(self.path, self.wanted), self.since)

    def read(self, partition):
        return read_pages(self.path, partition) if partition else iter(())  # without pages, Spark plans one empty task


class PagesStream(DataSourceStreamReader):
    def __init__(self, path: str, wanted: dict[str, str]):
        self.path, self.wanted = path, wanted

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {chain: names[-1] for chain, names in listed(self.path, self.wanted).items()}

    def partitions(self, start: dict, end: dict):
        chains = listed(self.path, self.wanted)
        new = {c: [n for n in names if start.get(c, "") < n <= end.get(c, "")] for c, names in chains.items()}
        return _dealt({c: names for c, names in new.items() if names}, None)

    def read(self, partition):
        return read_pages(self.path, partition)


@dataclass
class Recorded(WriterCommitMessage):
    pages: int


class PagesWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        fs, root = _place(self.path)
        count = 0
        for row in iterator:
            folder = f"{root}/{quote(row.resource, safe='')}/{quote(row.key, safe='')}"
            fs.create_dir(folder, recursive=True)
            # a name of its own until the page is whole: readers only take .json
            name = f"{row.ordinal:08d}~{quote(row.token or '', safe='')}"
            with fs.open_output_stream(f"{folder}/{name}.part") as file:
                file.write(row.body.encode())
            fs.move(f"{folder}/{name}.part", f"{folder}/{name}.json")
            count += 1
        return Recorded(count)


class RecordedPages(DataSource):
    """Options: path (or load(path)), and resource and key to take one resource or one chain only."""

    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def schema(self) -> str:
        return SCHEMA

    def _wanted(self) -> dict[str, str]:
        return {k: self.options[k] for k in ("resource", "key") if k in self.options}

    def reader(self, schema) -> PagesReader:
        return PagesReader(self.options["path"], self._wanted())

    def streamReader(self, schema) -> PagesStream:
        return PagesStream(self.options["path"], self._wanted())

    def writer(self, schema, overwrite: bool) -> PagesWriter:
        return PagesWriter(self.options["path"])


def _format(spark: SparkSession) -> str:
    """The format's name, once the session knows it and hands it filters (a session setting)."""
    spark.dataSource.register(RecordedPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return RecordedPages.name()


def recorded(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return spark.read.format(_format(spark)).options(**options).load(path)


def recorded_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return spark.readStream.format(_format(spark)).options(**options).load(path)


def record(pages: DataFrame, path: str) -> None:
    """Write rows (resource, key, ordinal, token, body) as pages."""
    pages.select("resource", "key", "ordinal", "token", "body").write.format(_format(pages.sparkSession)).mode("append").save(path)


def newest_first(pages: DataFrame, since: str) -> DataFrame:
    """Pages of uploads that can hold something from ``since`` (an instant) on; the rest of each chain is not opened."""
    return pages.where(F.col("newest") >= F.to_timestamp(F.lit(since)))


def _items(pages: DataFrame, resource: str, schema: str, field: str = "items") -> DataFrame:
    parsed = F.from_json("body", f"{field} array<struct<{schema}>>")[field]
    return pages.where(F.col("resource") == resource).select("key", F.explode(parsed).alias("i"))


def uploads(pages: DataFrame, start: str, end: str) -> DataFrame:
    """Uploads of playlists from ``start`` to before ``end``, once each: channel_id, video_id, published_at. Uploads
    without a time are private or deleted and left out."""
    details = _items(pages, "playlistItems", "contentDetails: struct<videoId: string, videoPublishedAt: string>").select("key", "i.contentDetails.*")
    rows = details.select(F.concat(F.lit("UC"), F.substring("key", 3, 1 << 20)).alias("channel_id"), F.col("videoId").alias("video_id"), F.col("videoPublishedAt").alias("published_at"))
    return rows.where((F.col("published_at") >= start) & (F.col("published_at") < end) & F.col("video_id").isNotNull()).dropDuplicates(["channel_id", "video_id"])


def video_details(pages: DataFrame) -> DataFrame:
    """video_id, live_chat_id (of a running broadcast), comment_count (null if hidden or no number)."""
    schema = "id: string, liveStreamingDetails: struct<activeLiveChatId: string>, statistics: struct<commentCount: string>"
    found = _items(pages, "videos", schema).where("i.id IS NOT NULL")
    chat = F.nullif(F.col("i.liveStreamingDetails.activeLiveChatId"), F.lit(""))
    return found.select(F.col("i.id").alias("video_id"), chat.alias("live_chat_id"), F.expr("try_cast(trim(i.statistics.commentCount) AS BIGINT)").alias("comment_count"))


def live_chat(pages: DataFrame) -> DataFrame:
    """live_chat_id, viewer_id, observed_at of all messages whose author is a channel."""
    schema = "authorDetails: struct<channelId: string>, snippet: struct<publishedAt: string>"
    found = _items(pages, "liveChat/messages", schema).select(F.col("key").alias("live_chat_id"), F.col("i.authorDetails.channelId").alias("viewer_id"), F.col("i.snippet.publishedAt").alias("observed_at"))
    return found.where(F.col("viewer_id").startswith("UC"))


def stream_candidates(pages: DataFrame, accounts: DataFrame, id_of: Column | None = None) -> DataFrame:
    """Broadcasters of live-stream pages that no account has: platform_id, name, url, evidence_count (pages with them)."""
    found = _items(pages, "streams", "user_id: string, user_login: string, user_name: string", "data").select("i.*").where("user_id IS NOT NULL")
    each = found.groupBy("user_id").agg(F.min(F.struct("user_login", "user_name")).alias("first"), F.count(F.lit(1)).alias("evidence_count"))
    known = accounts.where("platform = 'twitch'").select((F.col("platform_id") if id_of is None else id_of).alias("user_id"))
    new = each.join(known, "user_id", "left_anti")
    return new.select(F.col("user_id").alias("platform_id"), F.col("first.user_name").alias("name"), F.concat(F.lit("https://www.twitch.tv/"), "first.user_login").alias("url"), "evidence_count")
