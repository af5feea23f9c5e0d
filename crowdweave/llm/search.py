"""Exact top-k search by block-at-a-time pruning (operator 11).

The index orders vectors by their nearest pivots and cuts that order into blocks of 64 rows (fewer above 64
dimensions). A block holds its forward index (the whole-number vectors, packed) and per dimension its highest and lowest
entry: for a query entry the one or the other is the term maximum, by sign, and their sum bounds every score in the
block. Blocks of one range of the order form a part, whose own bounds are kept beside them.

A query starts with the k-th best score of the blocks around its own row, goes to the parts whose bound can reach it, and
there takes blocks by falling bound, in waves of doubling size, until the next bound lies below its k-th score (or
equals it and the block has no smaller id). The bounds are exact, so nothing is lost; where data let nothing be pruned,
the search compares everything, as (part, tile of queries) pairs of at most ``PART_ROWS`` x ``TILE`` rows, so traffic is
n * q * (1 / PART_ROWS + 1 / TILE) rows at worst. Pivots are the ``PIVOTS`` vectors of least hash; they only order the
rows, every row is indexed and results do not depend on them.

Scores are sums of products of whole numbers: doubles where they are exact (below 2**53), else Python's numbers, put
into the range of a long. Defined results: null vectors and those with null or non-finite entries (or ones that scaling
makes so) take no part; entries that a shorter vector lacks count as zero, so an empty vector scores zero; a query's own
rows are all rows of its vec_id, and repeated query rows have their results each; a null vec_id is no query, and is last
among ties; repeated rows of another id are candidates each; very long vectors are used whole; extra columns are
ignored; an empty table, or one row, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crowdweave.llm.common import cut, partitions

SCALE = 256
QUERY_STEP = 50
TOP = 5
#: Rows of a block, and the numbers that it should hold at most.
BLOCK = 64
BLOCK_NUMBERS = 1 << 12
#: Rows that one part (one task of the search) should hold, at most and at least.
PART_ROWS = 1 << 16
LEAST_PART_ROWS = 1 << 12
#: Queries that one task of the search may hold.
TILE = 1 << 16
#: Numbers in the bounds of all parts, which the driver sends to the tasks (16 MB).
BOUNDS = 1 << 21
#: Vectors that order the rows: the bounded sample that the index is fitted on.
PIVOTS = 256
#: Blocks and queries that are held against each other at a time.
WINDOW = 512
CHUNK = 1024
_NONE = np.iinfo(np.int64).max  # stands for a null id: last among ties
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_INDEX = "part int, block int, size int, ids binary, vectors binary, high binary, low binary, least long"
_QUERY = "query long, vector binary, score double, least long"


def packed(rows: np.ndarray) -> bytes:
    """A matrix of whole numbers as its width mark and 2, 4 or 8 bytes a number (8: doubles)."""
    most = np.abs(rows).max(initial=0)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return kind[1:].encode() + rows.astype(kind).tobytes()


def unpacked(data, size: int) -> np.ndarray:
    kind, numbers = data[:2].decode(), data[2:]
    return np.frombuffer(numbers, "<" + kind).astype(float).reshape(size, -1) if numbers else np.zeros((size, 0))


def together(rows: list[np.ndarray]) -> np.ndarray:
    """Matrices of any width as one, missing entries zero."""
    width = max((r.shape[1] for r in rows), default=0)
    if all(r.shape[1] == width for r in rows):
        return np.concatenate(rows) if rows else np.zeros((0, 0))
    return np.concatenate([np.pad(r, ((0, 0), (0, width - r.shape[1]))) for r in rows])


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows; exact. Object entries (Python's numbers) where doubles would round."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if width * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2.0**53:
        return a @ b.T
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(len(m), width) for m in (a, b)]
    return np.clip(whole[0] @ whole[1].T, _LOW, _HIGH)


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Summed term maxima of all queries and blocks, never below a score of the block."""
    width = min(queries.shape[1], high.shape[1])
    q, high, low = queries[:, :width], high[:, :width], low[:, :width]
    most = width * np.abs(q).max(initial=0) * max(np.abs(high).max(initial=0), np.abs(low).max(initial=0))
    found = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    return found if most < 2.0**53 else found + most * (width + 2) * 2.0**-52


class Blocks:
    """Blocks in memory: forward indexes, bounds, smallest ids."""

    def __init__(self, rows: list[tuple]):
        self.ids = [np.frombuffer(r[1], np.int64) for r in rows]
        self.vectors = [unpacked(r[2], r[0]) for r in rows]
        self.high, self.low = (together([unpacked(r[k], 1) for r in rows]) for k in (3, 4))
        self.least = np.array([r[5] for r in rows], np.int64)


class Best:
    """The k best (score, id) of each query, falling; entries that are not there have no score."""

    def __init__(self, own: np.ndarray, vectors: np.ndarray, top: int, score: np.ndarray | None = None, least: np.ndarray | None = None):
        n = len(own)
        self.own, self.vectors, self.top = own, vectors, top
        self.scores, self.ids = np.full((n, top), None, object), np.full((n, top), _NONE, np.int64)
        # what a candidate must reach: the k-th (score, id) known from anywhere
        self.floor = np.full(n, -np.inf) if score is None else score.copy()
        self.floor_id = np.full(n, _NONE, np.int64) if least is None else least.copy()

    def search(self, blocks: Blocks) -> None:
        """Meet every query with the blocks that can change its best."""
        for i in range(0, len(self.own), CHUNK):
            self._search(np.arange(i, min(i + CHUNK, len(self.own))), blocks)

    def _search(self, some: np.ndarray, blocks: Blocks) -> None:
        bound = bounds(self.vectors[some], blocks.high, blocks.low)
        order = np.argsort(-bound, axis=1, kind="stable")
        ranked = np.take_along_axis(bound, order, axis=1)
        start, wave = 0, 1
        while start < bound.shape[1]:
            stop = min(start + wave, bound.shape[1])
            reach = ranked[:, start:stop]
            chosen = order[:, start:stop]
            floor, floor_id = self.floor[some][:, None], self.floor_id[some][:, None]
            useful = (reach > floor) | ((reach == floor) & (blocks.least[chosen] <= floor_id))
            if not (ranked[:, start] >= self.floor[some]).any():
                return
            q, at = np.nonzero(useful)
            self._score(some, q, chosen[q, at], blocks)
            start, wave = stop, wave * 2

    def _score(self, some: np.ndarray, q: np.ndarray, block: np.ndarray, blocks: Blocks) -> None:
        """Score the chosen (query, block) pairs, block by block, and take in what reaches the floor."""
        order = np.argsort(block, kind="stable")
        q, block = q[order], block[order]
        cuts = np.flatnonzero(np.diff(block)) + 1
        rows, scores, ids = [], [], []
        for of_block, b in zip(np.split(q, cuts), block[np.r_[0, cuts]] if len(block) else [], strict=False):
            asked = some[of_block]
            got = inner(self.vectors[asked], blocks.vectors[b])
            named = blocks.ids[b][None, :]
            floor, floor_id = self.floor[asked][:, None], self.floor_id[asked][:, None]
            fits = ((got > floor) | ((got == floor) & (named <= floor_id))) & (named != self.own[asked][:, None])
            i, j = np.nonzero(fits)
            rows.append(asked[i])
            scores.append(got[i, j].astype(object))
            ids.append(np.broadcast_to(named, got.shape)[i, j])
        if rows and sum(map(len, rows)):
            self._take(np.concatenate(rows), np.concatenate(scores), np.concatenate(ids))

    def _take(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        found: dict[int, list] = {}
        order = np.argsort(rows, kind="stable")
        for r, s, i in zip(rows[order].tolist(), scores[order].tolist(), ids[order].tolist(), strict=True):
            found.setdefault(r, []).append((-int(s), i))
        for r, new in found.items():
            new += [(-s, i) for s, i in zip(self.scores[r], self.ids[r].tolist(), strict=True) if s is not None]
            best = sorted(new)[: self.top]
            self.scores[r, : len(best)] = [-s for s, _ in best]
            self.ids[r, : len(best)] = [i for _, i in best]
            if len(best) == self.top:
                score, least = float(-best[-1][0]), best[-1][1]
                if abs(score) >= 2.0**53:  # rounded: stay below the score
                    score, least = float(np.nextafter(score, -np.inf)), _NONE
                if (score, -least) > (self.floor[r], -int(self.floor_id[r])):
                    self.floor[r], self.floor_id[r] = score, least


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vector) of the rows that take part; vectors as whole numbers in doubles, ids never null."""
    rows = vectors.select(F.coalesce(F.col(id_column).cast("long"), F.lit(_NONE)).alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) * SCALE < float("inf"), F.lit(False)))
    return rows.where(F.col("vector").isNotNull() & finite)


def _matrices(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column as 1 x d matrices of whole numbers."""
    flat = np.floor(column.flatten().to_numpy() * SCALE)
    ends = np.cumsum(pc.list_value_length(column).to_numpy())
    return [m[None, :] for m in np.split(flat, ends[:-1])] if len(column) else []


def _ordered(pivots: np.ndarray):
    """Add the order of the index: the three nearest pivots (8 bits each at 256 pivots), then the vector's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = together(_matrices(batch.column(1)))
            width = min(rows.shape[1], pivots.shape[1])
            norms = np.linalg.norm(pivots, axis=1)
            near = rows[:, :width] @ pivots[:, :width].T / np.where(norms > 0, norms, 1)
            key = np.zeros(len(rows), np.int64)
            for _ in range(3):
                place = near.argmax(axis=1)
                near[np.arange(len(rows)), place] = -np.inf
                key = key * len(pivots) + place
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], names=["id", "vector", "hash", "key"])

    return run


def _block(part: int, number: int, ids: list[int], rows: np.ndarray) -> tuple:
    high, low = rows.max(axis=0)[None, :], rows.min(axis=0)[None, :]
    return part, number, len(ids), np.array(ids, np.int64).tobytes(), packed(rows), packed(high), packed(low), min(ids)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.int64()]
    names = ["part", "block", "size", "ids", "vectors", "high", "low", "least"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _indexed(rows_of_block: int):
    """Sorted rows to blocks, and one row (block -1) with the bounds of the whole part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        high, low = [], []
        ids: list[int] = []
        waiting: list[np.ndarray] = []

        def made(last: bool) -> list[tuple]:
            nonlocal ids, waiting, number, high, low
            found, at = [], 0
            while at < len(ids) and (last or at + rows_of_block <= len(ids)):
                found.append(_block(part, number, ids[at : at + rows_of_block], together(waiting[at : at + rows_of_block])))
                at, number = at + rows_of_block, number + 1
                # an entry that a vector lacks is a zero, also where only other blocks have the dimension
                high = [together([*high, unpacked(found[-1][5], 1)]).max(axis=0)[None, :]]
                low = [together([*low, unpacked(found[-1][6], 1)]).min(axis=0)[None, :]]
            ids, waiting = ids[at:], waiting[at:]
            return found

        for batch in batches:
            ids += batch.column(0).to_pylist()
            waiting += _matrices(batch.column(1))
            found = made(False)
            if found:
                yield _batch(found)
        found = made(True)
        if number:
            yield _batch([*found, (part, -1, 0, b"", b"", packed(high[0]), packed(low[0]), _NONE)])

    return run


def index(rows: DataFrame, count: int, dims: int) -> DataFrame:
    """The blocks of all rows, a written table: part, block, size, ids, vectors, high, low, least."""
    spark = rows.sparkSession
    hashed = rows.withColumn("hash", F.xxhash64("vector"))
    least = F.broadcast(hashed.select("hash").distinct().orderBy("hash").limit(PIVOTS))
    sample = hashed.join(least, "hash", "left_semi").groupBy("hash").agg(F.first("vector").alias("vector")).orderBy("hash").collect()  # PIVOTS rows
    pivots = together([np.floor(np.array(r.vector, float) * SCALE)[None, :] for r in sample])
    most = max(1, BOUNDS // (2 * max(dims, 1)))
    wanted = max(-(-count // PART_ROWS), min(partitions(spark), -(-count // LEAST_PART_ROWS)))
    keyed = hashed.select("id", "vector", "hash").mapInArrow(_ordered(pivots), "id long, vector array<double>, hash long, key long")
    dealt = keyed.repartitionByRange(max(1, min(wanted, most)), "key", "hash", "id").sortWithinPartitions("key", "hash", "id")
    return cut(dealt.select("id", "vector").mapInArrow(_indexed(max(4, min(BLOCK, BLOCK_NUMBERS // max(dims, 1)))), _INDEX))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (part, size, ids, vectors, high, low, least) of the blocks of at most WINDOW blocks of a part at a time."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("part", "size", "ids", "vectors", "high", "low", "least")), strict=True):
            if held and (len(held) == WINDOW or row[0] != held[0][0]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _asked(step: int, top: int):
    """The queries among the indexed rows, with the k-th (score, id) of the blocks around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _windows(batches):
            blocks = Blocks([row[1:] for row in held])
            ids = np.concatenate(blocks.ids)
            asking = np.flatnonzero((ids % step == 0) & (ids != _NONE))
            if not len(asking):
                continue
            vectors = together(blocks.vectors)[asking]
            best = Best(ids[asking], vectors, top)
            best.search(blocks)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[asking]), pa.array([packed(v[None, :]) for v in vectors], pa.binary()), pa.array(best.floor), pa.array(best.floor_id)],
                names=["query", "vector", "score", "least"],
            )

    return run


def _routed(parts: list[tuple[int, bytes, bytes]]):
    """Each query with the parts whose bound reaches its floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.array([p for p, _, _ in parts], np.int32)
        high, low = (together([unpacked(row[k], 1) for row in parts]) for k in (1, 2))
        for batch in batches:
            vectors = together([unpacked(v, 1) for v in batch.column(2).to_pylist()])
            for i in range(0, batch.num_rows, CHUNK):
                reach = bounds(vectors[i : i + CHUNK], high, low) >= batch.column(3).to_numpy()[i : i + CHUNK, None]
                q, p = np.nonzero(reach)
                some = batch.slice(i, CHUNK).take(pa.array(q))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(numbers[p])], names=["number", "query", "vector", "score", "least", "part"])

    return run


def _searched(top: int):
    """Runs of (part, tile): first its queries, then its blocks, in windows."""

    def emit(numbers, best: Best) -> Iterator[pa.RecordBatch]:
        r, k = np.nonzero(best.scores != None)  # noqa: E711 (entry by entry)
        if len(r):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(numbers)[r]), pa.array(best.own[r]), pa.array(best.ids[r, k]), pa.array(best.scores[r, k].tolist(), pa.int64())],
                names=["number", "query", "id", "score"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked, best, held = None, [], None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part, tile, kind, number, query, vector, score, least, size, ids, high, low = row
                if (part, tile) != key:
                    if best is not None:
                        best.search(Blocks(held)) if held else None
                        yield from emit([a[0] for a in asked], best)
                    key, asked, best, held = (part, tile), [], None, []
                if kind == 0:
                    asked.append((number, query, vector, score, least))
                    continue
                if not asked:
                    continue
                if best is None:
                    best = Best(
                        np.array([a[1] for a in asked], np.int64), together([unpacked(a[2], 1) for a in asked]), top,
                        np.array([a[3] for a in asked], float), np.array([a[4] for a in asked], np.int64),
                    )
                held.append((size, ids, vector, high, low, least))
                if len(held) == WINDOW:
                    best.search(Blocks(held))
                    held = []
        if best is not None:
            best.search(Blocks(held)) if held else None
            yield from emit([a[0] for a in asked], best)

    return run


def top_k(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", top: int = TOP, step: int = QUERY_STEP) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``top`` best candidates of every row whose id is divisible by ``step``."""
    rows = usable(vectors, id_column, vector_column)
    known = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dims")).first()
    table = index(rows, known["n"], known["dims"] or 0)
    blocks = table.where("block >= 0")
    parts = [tuple(r) for r in table.where("block < 0").select("part", "high", "low").collect()]  # at most BOUNDS numbers
    queries = cut(blocks.mapInArrow(_asked(step, top), _QUERY).select(F.monotonically_increasing_id().alias("number"), "*"))
    routed = queries.mapInArrow(_routed(parts), f"number long, {_QUERY}, part int")
    tiles = routed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    tiles = F.broadcast(cut(tiles))  # a row per part
    none = {c: F.lit(None).cast(k) for c, k in (("number", "long"), ("query", "long"), ("score", "double"), ("size", "int"), ("ids", "binary"), ("high", "binary"), ("low", "binary"))}
    names = ["part", "tile", "kind", "number", "query", "vector", "score", "least", "size", "ids", "high", "low"]
    asked = routed.join(tiles, "part").withColumns({"tile": F.pmod(F.xxhash64("number"), F.col("tiles")).cast("int"), "kind": F.lit(0)})
    asked = asked.withColumns({c: none[c] for c in ("size", "ids", "high", "low")}).select(*names)
    searched = blocks.join(tiles, "part").withColumns({"tile": F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)), "kind": F.lit(1), "vector": F.col("vectors")})
    searched = searched.withColumns({c: none[c] for c in ("number", "query", "score")}).select(*names)
    tasks = max(partitions(vectors.sparkSession), len(parts))
    met = asked.unionByName(searched).repartition(tasks, "part", "tile").sortWithinPartitions("part", "tile", "kind")
    found = met.mapInArrow(_searched(top), "number long, query long, id long, score long")
    place = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "id"))
    best = found.withColumn("rank", place).where(F.col("rank") <= top)
    return best.select(F.col("query").alias("query_id"), "rank", F.nullif(F.col("id"), F.lit(_NONE)).alias("vec_id"), "score")
