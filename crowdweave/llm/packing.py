"""Best-fit packing by bulk-synchronous successor sweeps (operator 9).

Texts become token ids; a document is its ids and one end id. Longer documents are cut into full pieces, the first one
shorter. Pieces go into sequences of ``capacity`` tokens.

Supersteps: pieces are dealt into parts of about ``PART_ROWS`` pieces. In each part, in parallel, pieces and gaps are
sorted by size, and a sweep matches the pieces, longest first, to the smallest gaps that can hold them (their
successors); conflicts are resolved by rank (piece rank r takes the r-th place of a run of equal gaps), the gaps that
were used move to their new size, and pieces left over open new sequences. Then all sequences that are not full are
opened again: their pieces go to the next superstep, in fewer parts, until one part is left. So a sequence is closed
early only when nothing could be added to it.

Lengths are whole numbers up to the capacity, so the sorted pieces and the sorted gaps of a part are runs of equal
values: at most ``capacity`` classes, however many rows there are, and the last part is as small as any other. A task
sees the class counts of a part; the rows themselves are ranked inside their class in hash buckets and take their place
by a join with the matched runs. The driver sees the number of pieces.

``pack_scheduled`` keeps the order of a mixed table, as it stands in the files: each range of ``RANGE_BLOCKS`` consecutive
blocks is packed on its own, and sequences are numbered range by range, so that a prefix of them is a prefix of the table,
up to a range. Rows that are not mixed are mixed first.
Its sweeps run side by side, one per range; the driver sees the number of sequences of each range.

Defined results: null texts are empty (one end id); repeated rows are packed once each; ties are placed by rank; a very
long text is encoded whole and cut into as many pieces as it needs; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crowdweave.llm import mixing
from crowdweave.llm.common import cut, partitions, ranked, whole_text

CAPACITY = 2048
#: Pieces of a part that is swept on its own, and by how much a superstep has fewer parts than the one before.
PART_ROWS = 1 << 17
FEWER = 16
#: Blocks of the mixing schedule that are packed among themselves.
RANGE_BLOCKS = 64
#: Ranges whose sequences are numbered together; what one task sees is a row for each so many ranges.
RANGE_GROUP = 4096
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
_SEPARATOR = "\x00"
#: White space other than single spaces and line feeds between words; texts with any are only cut between two words.
_ODD = ("\x00", "  ", " \n", "\n ", "\n\n", *(chr(i) for i in range(0x3001) if chr(i).isspace() and chr(i) not in " \n"))
_SPACE = re.compile(r"(?<=\S) (?=\S)")
_MOST_CACHED = 500_000
#: Below this code point, all libraries agree on what is a letter, a digit and white space.
_PLAIN_BELOW = "\u0250"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Numbered(dict):
    """Parts and their numbers; a new part gets the next one and is put on ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        self[part] = number = len(self)
        self.new.append(part)
        return number


class Encoder:
    """Token ids of texts, by a tokenizer file; parts between words' borders are encoded once and remembered.

    The tokenizer splits text before every single space and around every single line feed between words, so the ids of
    these parts, side by side, are the ids of the text. Where the folder holds the same vocabulary as a rank file, Latin
    parts are encoded with that one, which gives the same ids in less time; parts that may hold a special token or other
    scripts always go through the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ranks = self._ranks(path.removesuffix(".json") + ".tiktoken")
        self.clear()

    @staticmethod
    def _ranks(path: str):
        import base64
        import os

        if not os.path.exists(path):
            return None
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def clear(self) -> None:
        self.known = _Numbered()
        self.length = np.zeros(1 << 16, np.int64)
        self.start = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = 0

    @staticmethod
    def parts(text: str) -> list[str]:
        if not text:
            return []
        if not (text[0].isspace() or text[-1].isspace() or any(x in text for x in _ODD)):
            return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split(_SEPARATOR)
        first, *rest = _SPACE.split(text)
        return [first, *(" " + x for x in rest)]

    def learn(self, new: list[str]) -> None:
        if self.ranks:
            ids = [self.ranks(x) if max(x) < _PLAIN_BELOW and "<|" not in x else None for x in new]
        else:
            ids = [None] * len(new)
        rest = [k for k, x in enumerate(ids) if x is None]
        for k, x in zip(rest, self.tokenizer.encode_batch_fast([new[k] for k in rest], add_special_tokens=False), strict=True):
            ids[k] = x.ids
        n = len(new)
        k = len(self.known) - n
        lengths = np.fromiter(map(len, ids), np.int64, n)
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        for name, least in (("length", k + n), ("start", k + n), ("ids", self.used + len(flat))):
            old = getattr(self, name)
            if len(old) < least:
                setattr(self, name, np.concatenate([old, np.zeros(max(least, 2 * len(old)) - len(old), old.dtype)]))
        self.length[k : k + n] = lengths
        self.start[k : k + n] = self.used + np.cumsum(lengths) - lengths
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the n+1 offsets of the texts."""
        if len(self.known) > _MOST_CACHED:
            self.clear()
        split = list(map(self.parts, texts))
        bounds = np.cumsum([0, *map(len, split)])
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(bounds[-1]))
        if self.known.new:
            new, self.known.new = self.known.new, []
            self.learn(new)
        lengths = self.length[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.start[at] - (ends - lengths), lengths) + np.arange(total)]
        return ids, np.concatenate([[0], ends])[bounds]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """The encoder of a Python worker; what it learned serves the worker's later tasks too."""
    return Encoder(path)


def tokenized(path: str, capacity: int, end_id: int):
    """A mapInArrow function: (id, text) to one row per piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import zlib

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = encoder_of(path)
        for batch in batches:
            texts, size, first = batch.column(1), 0, 0
            sizes = texts.cast(pa.large_binary())
            for i in range(len(texts)):
                size += len(sizes[i].as_buffer())
                if size < 2 << 20 and i + 1 < len(texts):
                    continue
                ids, off = encoder.encode(texts.slice(first, i + 1 - first).to_pylist())
                out: tuple[list, ...] = ([], [], [], [], [])
                for k in range(len(off) - 1):
                    own = np.append(ids[off[k] : off[k + 1]], np.uint32(end_id)).astype("<u4")
                    pieces = -(-len(own) // capacity)
                    head = len(own) - capacity * (pieces - 1)
                    for p in range(pieces):
                        a = 0 if p == 0 else head + (p - 1) * capacity
                        b = head + p * capacity
                        for column, value in zip(out, (first + k, p, a, b - a, zlib.crc32(own[a:b].tobytes())), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])],
                    names=[batch.schema.names[0], "piece", "start", "length", "ids_crc32"],
                )
                size, first = 0, i + 1

    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. No shuffle."""
    rows = docs.select(F.col(id_column), whole_text(text_column).alias("_text"))
    kind = rows.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(tokenized(path, capacity, end_id), f"{id_column} {kind}, piece int, start long, length long, ids_crc32 long")


def sweep(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Match length classes to gaps: runs (length, first rank, rows, first sequence, offset), and the sequences used.

    Each superstep serves one length class, longest first; it walks the gaps from the smallest that fits and opens new
    sequences for what is left. A gap class is a list of runs of sequences (first, count).
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []  # the gap sizes in use, ascending
    runs: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            i = bisect_left(order, length)
            if i < len(order):
                gap = order[i]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[i]
                take = min(n, left)
                if take < n:
                    put(gap, first + take, n - take)
            else:
                gap, first = capacity, opened
                take = -(-left // (capacity // length))
                opened += take
            runs.append((length, rank, take, first, capacity - gap))
            put(gap - length, first, take)
            rank, left = rank + take, left - take
    return runs, opened


def unfilled(runs: list[tuple[int, int, int, int, int]], capacity: int) -> list[tuple[int, int, int, int, int, bool]]:
    """The runs, cut where their sequences differ in being full, with whether they are not."""
    if not runs:
        return []
    length, _, take, first, _ = (np.array(c) for c in zip(*runs, strict=True))
    edges = np.unique(np.concatenate([first, first + take]))
    fill = np.zeros(len(edges) + 1, np.int64)
    np.add.at(fill, np.searchsorted(edges, first), length)
    np.add.at(fill, np.searchsorted(edges, first + take), -length)
    free = np.cumsum(fill[:-1]) < capacity
    turn = np.flatnonzero(np.concatenate([[True], free[1:] != free[:-1]]))
    edges, free = edges[turn], free[turn]
    out = []
    for size, rank, n, sequence, offset in runs:
        at, k = sequence, int(np.searchsorted(edges, sequence, "right")) - 1
        while at < sequence + n:
            end = min(sequence + n, int(edges[k + 1]) if k + 1 < len(edges) else sequence + n)
            out.append((size, rank + at - sequence, end - at, at, offset, bool(free[k])))
            at, k = end, k + 1
    return out


_RUNS = ["r_part", "r_length", "r_from", "r_n", "r_sequence", "r_offset", "r_free"]


def _swept_parts(capacity: int):
    """An applyInArrow function: a part's counts by length to its runs, with whether their sequences are not full."""

    def run(key: tuple[pa.Scalar, ...], counts: pa.Table) -> pa.Table:
        runs, _ = sweep(dict(zip(counts["length"].to_pylist(), counts["n"].to_pylist(), strict=True)), capacity)
        *columns, free = zip(*unfilled(runs, capacity), strict=True)
        return pa.table([*(pa.array(c, pa.int64()) for c in ([key[0].as_py()] * len(free), *columns)), pa.array(free)], names=_RUNS)

    return run


def pack(found: DataFrame, capacity: int = CAPACITY, id_column: str = "doc_id", part_rows: int | None = None) -> DataFrame:
    """Give each piece its sequence and offset. ``found`` is read several times; pass a written table."""
    spark = found.sparkSession
    order = [id_column, "piece", "ids_crc32"]
    columns = [id_column, "piece", "start", "length", "ids_crc32"]
    parts = max(1, -(-found.count() // (part_rows or PART_ROWS)))
    left = found.select(*columns, F.pmod(F.xxhash64(*order), F.lit(parts)).alias("part"))
    schema = ", ".join(f"{c} {'boolean' if c == 'r_free' else 'long'}" for c in _RUNS)
    closed: list[DataFrame] = []
    used = 0  # parts of earlier supersteps, for the numbers of sequences
    while True:
        counts = left.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
        runs = cut(counts.groupBy("part").applyInArrow(_swept_parts(capacity), schema))
        rows = ranked(left, ["part", "length"], order, partitions(spark))
        on = (F.col("part") == F.col("r_part")) & (F.col("length") == F.col("r_length"))
        on &= (F.col("rank") >= F.col("r_from")) & (F.col("rank") < F.col("r_from") + F.col("r_n"))
        number = (F.col("part") + used) * (1 << 32) + F.col("r_sequence") + F.col("rank") - F.col("r_from")
        placed = rows.join(runs, on).select(*columns, "part", number.alias("sequence_id"), F.col("r_offset").alias("offset"), "r_free")
        if parts == 1:
            closed.append(placed.drop("part", "r_free"))
            return reduce(DataFrame.unionByName, closed)
        placed = cut(placed)
        closed.append(placed.where("not r_free").drop("part", "r_free"))
        used, parts = used + parts, -(-parts // FEWER)
        left = placed.where("r_free").select(*columns, F.expr(f"part div {FEWER}").alias("part"))


def pack_documents(
    docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, part_rows: int | None = None
) -> DataFrame:
    """Tokenize and pack whole documents; one row per piece."""
    return pack(cut(pieces(docs, path or vocabulary_path(), capacity, end_id)), capacity, part_rows=part_rows)


def _swept(capacity: int):
    """An applyInArrow function: a range's counts by length to its runs."""

    def run(key: tuple[pa.Scalar, ...], counts: pa.Table) -> pa.Table:
        runs, _ = sweep(dict(zip(counts["length"].to_pylist(), counts["n"].to_pylist(), strict=True)), capacity)
        columns = [[key[0].as_py()] * len(runs), *map(list, zip(*runs, strict=True))]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["r_range", "r_length", "r_from", "r_n", "r_sequence", "r_offset"])

    return run


def pack_scheduled(
    docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, range_blocks: int = RANGE_BLOCKS,
    id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
) -> DataFrame:
    """Tokenize whole documents and pack them in the order of their mixed table; one row per piece."""
    spark = docs.sparkSession
    columns = {"id": F.col(id_column), "source": F.col(source_column), "text": F.col(text_column)}
    rows, block_docs = mixing.located(docs.select(*(c.alias(name) for name, c in columns.items())), "id", "source")
    rows = rows.select(F.struct("id", "source", "stretch", "row").alias("doc"), "text")
    found = cut(pieces(rows, path or vocabulary_path(), capacity, end_id, "doc", "text"))
    found = mixing.turns(found.select("doc.*", "piece", "start", "length", "ids_crc32"), block_docs)
    # the number tells rows with equal ids apart; it is fixed when the pieces are written
    number, place = F.monotonically_increasing_id().alias("row"), F.expr(f"turn div {int(range_blocks)}").alias("range")
    found = cut(found.select(F.col("id").alias(id_column), number, "piece", "start", "length", "ids_crc32", place))
    counts = found.groupBy("range", "length").agg(F.count(F.lit(1)).alias("n"))
    schema = "r_range long, r_length long, r_from long, r_n long, r_sequence long, r_offset long"
    runs = cut(counts.groupBy("range").applyInArrow(_swept(capacity), schema))
    # sequences of earlier ranges: summed within groups of ranges, and over the groups
    used = runs.groupBy("r_range").agg(F.max(F.col("r_sequence") + F.col("r_n")).alias("n")).withColumn("group", F.expr(f"r_range div {RANGE_GROUP}"))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    groups = used.groupBy("group").agg(F.sum("n").alias("in_group"))
    groups = groups.select("group", F.coalesce(F.sum("in_group").over(earlier.orderBy("group")), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("n").over(earlier.partitionBy("group").orderBy("r_range")), F.lit(0))
    first = used.withColumn("within", within).join(groups, "group").select("r_range", (F.col("before") + F.col("within")).alias("r_first"))
    runs = runs.join(first, "r_range")
    rows = ranked(found, ["range", "length"], [id_column, "piece", "ids_crc32", "row"], partitions(spark))
    on = (F.col("range") == F.col("r_range")) & (F.col("length") == F.col("r_length"))
    on &= (F.col("rank") >= F.col("r_from")) & (F.col("rank") < F.col("r_from") + F.col("r_n"))
    return rows.join(runs, on).select(
        id_column, "piece", "start", "length", "ids_crc32",
        (F.col("r_first") + F.col("r_sequence") + F.col("rank") - F.col("r_from")).alias("sequence_id"), F.col("r_offset").alias("offset"),
    )
