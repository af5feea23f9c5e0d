"""Channel catalogues from upload pages: dedup, a cap on first-pass videos, detection of pages out of order.

Rows are page items: channel_id, ordinal, at, size, last, video_id, title, published_at (ISO text or null), fetched_at.
A channel is worked through in page order until ``cap`` distinct accessible videos are known; an item counts as
inaccessible (no id, no title, private, deleted), a duplicate, or a new video. A dated new video that is later than the
dated one before it makes the channel's order NON_MONOTONIC. A channel ends as PLAYLIST_EXHAUSTED when its last page is
done, or as CAP_REACHED when items were left because of the cap, or pages when it was just filled; else it is PENDING.

``channel_states`` and ``catalog`` are the batch forms, with windows per channel; ``catalog_stream`` keeps the same
figures in Spark's state store. There, pages that come early wait for those before them, and a channel that has ended
drops its videos and waiting items, so its state is one row; ``ttl`` lets videos of unfinished channels expire, too.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CAP = 1000
ITEMS = "channel_id string, ordinal int, at int, size int, last boolean, video_id string, title string, published_at string, fetched_at timestamp"
#: Titles that stand for videos nobody can see (fixed values).
HIDDEN = ("Private video", "Deleted video")
_COUNTERS = ["accessible", "inaccessible", "duplicates"]
_OUT = (
    "channel_id string, kind string, video_id string, title string, published_at string, "
    "accessible int, inaccessible int, duplicates int, ordering string, oldest string, status string"
)


def _placed(items: DataFrame, cap: int) -> DataFrame:
    """Items with accessible, new (first of its video), done (before the cap) and later (than the dated one before)."""
    in_order = Window.partitionBy("channel_id").orderBy("ordinal", "at")
    accessible = F.coalesce(F.col("video_id").isNotNull() & (F.col("title") != "") & ~F.col("title").isin(*HIDDEN), F.lit(False))
    first = F.row_number().over(Window.partitionBy("channel_id", "video_id", "accessible").orderBy("ordinal", "at")) == 1
    known = F.coalesce(F.sum(F.col("new").cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dated = F.when(F.col("new") & F.col("done"), F.col("published_at"))
    before = F.last(F.col("dated"), ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    marked = items.where("at IS NOT NULL").withColumn("accessible", accessible).withColumn("new", F.col("accessible") & first)
    return marked.withColumn("done", known < cap).withColumn("dated", dated).withColumn("later", F.coalesce(F.col("dated") > before, F.lit(False)))


def catalog(items: DataFrame, cap: int = CAP) -> DataFrame:
    """channel_id, video_id, title, published_at of the videos within the cap."""
    return _placed(items, cap).where("new AND done").select("channel_id", "video_id", "title", "published_at")


def channel_states(items: DataFrame, cap: int = CAP) -> DataFrame:
    """channel_id, accessible, inaccessible, duplicates, ordering, oldest, status."""

    def count(condition: Column) -> Column:
        return F.count_if(condition & F.col("done")).cast("int")

    new, accessible = F.col("new"), F.col("accessible")
    found = _placed(items, cap).groupBy("channel_id").agg(
        count(new).alias("accessible"), count(~accessible).alias("inaccessible"), count(accessible & ~new).alias("duplicates"),
        F.when(F.bool_or("later"), "NON_MONOTONIC").otherwise("NOT_VALIDATED").alias("ordering"), F.min("dated").alias("oldest"), F.bool_or(~F.col("done")).alias("left"),
    )
    ended = items.groupBy("channel_id").agg(F.bool_or("last").alias("ended"))
    status = F.when(F.col("left"), "CAP_REACHED").when(F.col("ended"), "PLAYLIST_EXHAUSTED").when(F.col("accessible") >= cap, "CAP_REACHED").otherwise("PENDING")
    both = ended.join(found, "channel_id", "left").fillna(0, _COUNTERS).fillna("NOT_VALIDATED", ["ordering"])
    return both.select("channel_id", *_COUNTERS, "ordering", "oldest", status.alias("status"))


class Channels(StatefulProcessor):
    """Works through a channel's pages in order; emits each new video once, and the channel's state when it changed."""

    def __init__(self, cap: int, ttl: timedelta | None):
        self.cap, self.ttl = cap, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = None if self.ttl is None else int(self.ttl.total_seconds() * 1000)
        self.videos = handle.getMapState("videos", "video_id string", "there boolean", ttl)
        self.waiting = handle.getMapState("waiting", "ordinal int, at int", "size int, last boolean, video_id string, title string, published_at string")
        self.state = handle.getValueState("state", "page int, accessible int, inaccessible int, duplicates int, ordering string, latest string, oldest string, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (channel,) = key
        before = self.state.get() if self.state.exists() else (0, 0, 0, 0, "NOT_VALIDATED", None, None, "PENDING")
        page, *counts, ordering, latest, oldest, status = before
        if status != "PENDING":
            return
        held: dict[int, dict] = {}
        for (ordinal, at), value in self.waiting.iterator():
            held.setdefault(ordinal, {})[at] = value
        came = set()
        for row in rows:
            if row.ordinal >= page and (row.at or 0) not in held.setdefault(row.ordinal, {}):
                held[row.ordinal][row.at or 0] = (row.size, row.last, row.video_id, row.title, row.published_at)
                came.add((row.ordinal, row.at or 0))
        while status == "PENDING" and page in held and len(held[page]) >= next(iter(held[page].values()))[0]:
            for at, (size, last, video, title, published) in sorted(held.pop(page).items()):
                if (page, at) not in came:
                    self.waiting.removeKey((page, at))
                came.discard((page, at))
                if size and counts[0] >= self.cap:
                    status = "CAP_REACHED"
                elif size and not (video is not None and title and title not in HIDDEN):
                    counts[1] += 1
                elif size and self.videos.containsKey((video,)):
                    counts[2] += 1
                elif size:
                    counts[0] += 1
                    self.videos.updateValue((video,), (True,))
                    if published and latest and published > latest:
                        ordering = "NON_MONOTONIC"
                    latest = published or latest
                    oldest = min(oldest or published, published) if published else oldest
                    yield self._row(channel, "video", video, title, published)
            if status == "PENDING" and last:
                status = "PLAYLIST_EXHAUSTED"
            page += 1
        if status == "PENDING" and counts[0] >= self.cap:
            status = "CAP_REACHED"
        if status == "PENDING":
            for place in came:
                self.waiting.updateValue(place, held[place[0]][place[1]])
        else:
            self.videos.clear()
            self.waiting.clear()
        now = (page, *counts, ordering, latest, oldest, status)
        if now != before or not self.state.exists():
            self.state.update(now)
            yield self._row(channel, "state", None, None, None, *counts, ordering, oldest, status)

    @staticmethod
    def _row(channel: str, kind: str, video, title, published, accessible=None, inaccessible=None, duplicates=None, ordering=None, oldest=None, status=None) -> Row:
        return Row(
            channel_id=channel, kind=kind, video_id=video, title=title, published_at=published, accessible=accessible, inaccessible=inaccessible,
            duplicates=duplicates, ordering=ordering, oldest=oldest, status=status,
        )


def once(items: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of items without those that come again within ``late`` of their first time; older keys are forgotten."""
    return items.withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["channel_id", "ordinal", "at"])


def catalog_stream(items: DataFrame, cap: int = CAP, ttl: timedelta | None = None) -> DataFrame:
    """A stream of items to a stream of videos and channel states (columns as in ``_OUT``)."""
    return items.groupBy("channel_id").transformWithState(Channels(cap, ttl), _OUT, "Append", "None" if ttl is None else "ProcessingTime")
