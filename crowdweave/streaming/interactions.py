"""Comment and reply pages as a state machine per video: as a stream with Spark's state store, and as a batch fold.

Rows are the items of pages: video_id, parent_id (null: a top comment's page), ordinal (of the page), at (place in the
page), size (items of the page), last (no page follows), record_id, viewer_id, published_at, replies (a top comment's).
Pages may come in any order, cut anywhere and more than once; a page that came in part goes on at the items it lacks.
An empty page is one row without record_id.

A thread is complete when its pages run from 0 to the last one and hold all their items. A video is EXHAUSTED when its
comments and the replies of every top comment that has some are complete, COMMENTS_PENDING or REPLIES_PENDING before,
and IDENTITY_UNAVAILABLE while it holds a record without a viewer, which is neither counted nor lost.

Both forms give the interactions (each record once) and the state of each video. The stream needs the RocksDB state
store; its state holds a row per record, page item and page, and items go when their page is whole.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ITEMS = "video_id string, parent_id string, ordinal int, at int, size int, last boolean, record_id string, viewer_id string, published_at string, replies int"
_OUT = "video_id string, kind string, record_id string, parent_id string, viewer_id string, published_at string, records long, anonymous long, status string"


class Threads(StatefulProcessor):
    """Emits each interaction once, and the video's state when it changed. ``patience`` milliseconds without a row for an
    unfinished video give a state STALLED."""

    def __init__(self, patience: int | None = None):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.records = handle.getMapState("records", "record_id string", "anonymous boolean")
        self.items = handle.getMapState("items", "parent_id string, ordinal int, at int", "there boolean")
        self.pages = handle.getMapState("pages", "parent_id string, ordinal int", "size int, seen int, last boolean")
        self.parents = handle.getMapState("parents", "parent_id string", "replies int")
        self.counts = handle.getValueState("counts", "records long, anonymous long, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (video,) = key
        records, anonymous, before = self.counts.get() if self.counts.exists() else (0, 0, None)
        for row in rows:
            thread = row.parent_id or ""
            page, item = (thread, row.ordinal), (thread, row.ordinal, row.at or 0)
            size, seen, _ = self.pages.getValue(page) if self.pages.containsKey(page) else (row.size, 0, row.last)
            if seen < size and row.record_id is not None and not self.items.containsKey(item):
                seen += 1
                self.items.updateValue(item, (True,))
                if seen == size:  # whole: the page's own row is enough
                    for at in range(size):
                        self.items.removeKey((thread, row.ordinal, at))
            self.pages.updateValue(page, (size, seen, row.last))
            if row.record_id is None:
                continue
            known = self.records.getValue((row.record_id,)) if self.records.containsKey((row.record_id,)) else None
            if known is None or (known[0] and row.viewer_id is not None):
                if known is not None:
                    anonymous -= 1
                self.records.updateValue((row.record_id,), (row.viewer_id is None,))
                if row.viewer_id is None:
                    anonymous += 1
                else:
                    records += 1
                    yield self._row(video, "interaction", row)
            if not thread and (row.replies or 0) > 0:
                self.parents.updateValue((row.record_id,), (row.replies,))
        status = self._status(anonymous)
        self.counts.update((records, anonymous, status))
        if status != before:
            yield self._state(video, records, anonymous, status)
        if self.patience is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if status != "EXHAUSTED":
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        records, anonymous, _ = self.counts.get()
        self.counts.update((records, anonymous, "STALLED"))
        yield self._state(key[0], records, anonymous, "STALLED")

    def _status(self, anonymous: int) -> str:
        if anonymous:
            return "IDENTITY_UNAVAILABLE"
        threads: dict[str, list] = {}
        for (thread, ordinal), (size, seen, last) in self.pages.iterator():
            threads.setdefault(thread, []).append((ordinal, seen >= size, last))
        whole = {t for t, pages in threads.items() if any(last and len(pages) == n + 1 for n, _, last in pages) and all(there for _, there, _ in pages)}
        if "" not in whole:
            return "COMMENTS_PENDING"
        return "EXHAUSTED" if all(parent in whole for (parent,) in self.parents.keys()) else "REPLIES_PENDING"

    @staticmethod
    def _row(video: str, kind: str, row: Row) -> Row:
        return Row(video_id=video, kind=kind, record_id=row.record_id, parent_id=row.parent_id, viewer_id=row.viewer_id, published_at=row.published_at, records=None, anonymous=None, status=None)

    @staticmethod
    def _state(video: str, records: int, anonymous: int, status: str) -> Row:
        return Row(video_id=video, kind="state", record_id=None, parent_id=None, viewer_id=None, published_at=None, records=records, anonymous=anonymous, status=status)


def threads_stream(items: DataFrame, patience: int | None = None) -> DataFrame:
    """A stream of items to a stream of interactions and states (columns as in ``_OUT``)."""
    mode = "None" if patience is None else "ProcessingTime"
    return items.groupBy("video_id").transformWithState(Threads(patience), _OUT, "Append", mode)


def interactions(items: DataFrame) -> DataFrame:
    """video_id, record_id, parent_id, viewer_id, published_at: each record that has a viewer, once."""
    named = items.where("record_id IS NOT NULL AND viewer_id IS NOT NULL")
    return named.groupBy("video_id", "record_id").agg(F.min(F.struct("parent_id", "viewer_id", "published_at")).alias("r")).select("video_id", "record_id", "r.*")


def states(items: DataFrame) -> DataFrame:
    """video_id, records, anonymous, status: the batch form of the state."""
    thread = F.coalesce("parent_id", F.lit("")).alias("thread")
    there = F.when(F.col("record_id").isNotNull(), F.coalesce("at", F.lit(0)))
    pages = items.groupBy("video_id", thread, "ordinal").agg(F.max("size").alias("size"), F.count_distinct(there).alias("seen"), F.bool_or("last").alias("last"))
    threads = pages.groupBy("video_id", "thread").agg(
        (F.bool_and(F.col("seen") >= F.col("size")) & F.coalesce(F.max(F.when(F.col("last"), F.col("ordinal"))) + 1 == F.count(F.lit(1)), F.lit(False))).alias("whole")
    )
    found = items.where("record_id IS NOT NULL").groupBy("video_id", "record_id").agg(
        F.bool_or(F.col("viewer_id").isNotNull()).alias("named"), F.max(F.when(F.col("parent_id").isNull(), F.col("replies"))).alias("replies")
    )
    counts = found.groupBy("video_id").agg(F.count_if("named").alias("records"), F.count_if(~F.col("named")).alias("anonymous"))
    open_replies = found.where("replies > 0").join(threads.where("whole").select("video_id", F.col("thread").alias("record_id")), ["video_id", "record_id"], "left_anti")
    comments = threads.groupBy("video_id").agg(F.coalesce(F.bool_or(F.when(F.col("thread") == "", F.col("whole"))), F.lit(False)).alias("whole"))
    waiting = open_replies.groupBy("video_id").agg(F.lit(True).alias("waiting"))
    all_of = comments.join(counts, "video_id", "left").join(waiting, "video_id", "left").fillna(0, ["records", "anonymous"])
    status = (
        F.when(F.col("anonymous") > 0, "IDENTITY_UNAVAILABLE").when(~F.col("whole"), "COMMENTS_PENDING").when(F.col("waiting"), "REPLIES_PENDING").otherwise("EXHAUSTED")
    )
    return all_of.select("video_id", "records", "anonymous", status.alias("status"))
