"""Mixing sources to target weights by Pfair scheduling (operator 3). DataFrame and SQL functions only.

Documents of a source form blocks of ``block_docs``. A source with the share w of all weights has block k (from 0)
released at floor(k / w) and due at ceil((k + 1) / w), in whole numbers from the weights as they are written, without
rounding. In every slot, the released block with the earliest deadline goes (ties: the source that sorts first), which
meets all deadlines, so that at any slot a source is less than one block away from its weight, however many slots there
are. The driver counts the documents of each source and places the blocks, one step each, so ``block_docs`` should grow with the table; the slots
go out as arrays of ``resolution`` blocks, and the rows find theirs by block. Slots of a source that has run out stay free or let another
source's released block go earlier; the others keep their proportions. All documents are placed.

A mixed table says so in the metadata of its columns. Its order is that of its files and of the rows in them: ``located``
and ``turns`` take it over from there. What deals its rows anew has to come before mixing.

Defined results: a null source is a source of its own; repeated rows are placed once each; ties in doc_id get distinct
places; a source without a target weight gets the lowest one given; a weight of 0 puts a source behind all others; all columns are kept; an empty table stays empty.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction
from heapq import heappop, heappush

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from crowdweave.llm.common import cut, partitions, ranked

BLOCK_DOCS = 16
#: Blocks in one row of the plan.
RESOLUTION = 1024
#: Blocks whose plan (32 bytes each) may be broadcast; beyond, rows and plan meet in a plain join.
MOST_BROADCAST = 2_000_000
#: Metadata of the columns of a mixed table: the documents of a block.
MIXED = "crowdweave.block_docs"
#: Rows of a file that are numbered together.
STRETCH = 1 << 16
#: Without given weights, a source's weight is its number of documents to this power.
FLATTEN = 0.5


def blocks_in_order(counts: list[int], weights: list[float]) -> list[list[list[int]]]:
    """Release, deadline, slot and turn (its number among all blocks placed) of every block of each source, by EDF."""
    exact = [Fraction(repr(float(w))) for w in weights]
    scale = math.lcm(*(w.denominator for w in exact))
    shares = [int(w * scale) for w in exact]
    total = sum(x for x in shares if x > 0)
    out: list[list[list[int]]] = [[[], [], [], []] for _ in counts]
    later = [(0, i) for i, n in enumerate(counts) if n and shares[i] > 0]
    ready: list[tuple[int, int, int]] = []
    slot = turn = 0
    while later or ready:
        if not ready:
            slot = max(slot, later[0][0])
        while later and later[0][0] <= slot:
            release, i = heappop(later)
            heappush(ready, (-(-(len(out[i][0]) + 1) * total // shares[i]), i, release))
        due, i, release = heappop(ready)
        for column, value in zip(out[i], (release, due, slot, turn), strict=True):
            column.append(value)
        if (k := len(out[i][0])) < counts[i]:
            heappush(later, (k * total // shares[i], i))
        slot, turn = slot + 1, turn + 1
    for i, n in enumerate(counts):
        for _ in range(n if shares[i] <= 0 else 0):
            for column, value in zip(out[i], (slot, slot + 1, slot, turn), strict=True):
                column.append(value)
            slot, turn = slot + 1, turn + 1
    return out


@dataclass
class Plan:
    """(_source, _chunk, _release, _deadline, _slot, _turn): arrays of ``resolution`` blocks; and the blocks in all."""

    table: DataFrame
    blocks: int


def plan(counts: DataFrame, weights: dict[str | None, float] | None, block_docs: int, resolution: int, flatten: float) -> Plan:
    """The plan of sources (source, docs), one step a block."""
    found = sorted(((r["source"], r["docs"]) for r in counts.collect()), key=lambda x: (x[0] is not None, x[0]))
    if weights:
        target = [weights.get(name, min(weights.values())) for name, _ in found]
    else:
        target = [float(n) ** flatten for _, n in found]
    placed = blocks_in_order([-(-n // block_docs) for _, n in found], target)
    rows = [
        (name, at // resolution, *(column[at : at + resolution] for column in columns))
        for (name, _), columns in zip(found, placed, strict=True)
        for at in range(0, len(columns[0]), resolution)
    ]
    kind = StructType([StructField("_source", counts.schema["source"].dataType)])
    for name in ("_chunk", "_release", "_deadline", "_slot", "_turn"):
        kind = kind.add(name, LongType() if name == "_chunk" else ArrayType(LongType()))
    return Plan(counts.sparkSession.createDataFrame(rows, kind), sum(len(columns[0]) for columns in placed))


def placed(
    rows: DataFrame, weights: dict[str | None, float] | None = None, block_docs: int = BLOCK_DOCS,
    resolution: int = RESOLUTION, flatten: float = FLATTEN,
) -> DataFrame:
    """Rows with columns ``id`` and ``source``, and their block, release, deadline, slot, turn and place."""
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("docs"))
    slots = plan(counts, weights, int(block_docs), int(resolution), flatten)
    found = ranked(rows, ["source"], ["id"], partitions(rows.sparkSession))
    found = found.withColumn("block", F.expr(f"rank div {int(block_docs)}")).withColumn("place", F.expr(f"cast(rank % {int(block_docs)} as int)"))
    if slots.blocks <= MOST_BROADCAST:
        slots.table = F.broadcast(slots.table)
    on = F.col("source").eqNullSafe(F.col("_source")) & (F.expr(f"block div {int(resolution)}") == F.col("_chunk"))
    joined = found.join(slots.table, on)
    return joined.withColumns({x: F.expr(f"_{x}[cast(block % {int(resolution)} as int)]") for x in ("release", "deadline", "slot", "turn")})


def schedule(
    docs: DataFrame, weights: dict[str | None, float] | None = None, block_docs: int = BLOCK_DOCS,
    resolution: int = RESOLUTION, flatten: float = FLATTEN, id_column: str = "doc_id", source_column: str = "source",
) -> DataFrame:
    """One row per document: its id, source, block, the block's release, deadline and slot, and the place in the block."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"))
    return placed(rows, weights, block_docs, resolution, flatten).select(
        F.col("id").alias(id_column), F.col("source").alias(source_column), "block", "release", "deadline", "slot", "place"
    )


def mixed(
    docs: DataFrame, weights: dict[str | None, float] | None = None, block_docs: int = BLOCK_DOCS,
    resolution: int = RESOLUTION, flatten: float = FLATTEN, id_column: str = "doc_id", source_column: str = "source",
) -> DataFrame:
    """The documents in mixed order: part files follow the schedule, each sorted by slot. All columns are kept, and marked."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), row.alias("row"))
    found = placed(rows, weights, block_docs, resolution, flatten).select("slot", "place", "row")
    dealt = found.repartitionByRange(partitions(docs.sparkSession), "slot", "place")
    marked = [F.col("row")[f.name].alias(f.name, metadata={**f.metadata, MIXED: int(block_docs)}) for f in docs.schema]
    # a union has no file positions, so those of the files read here are never taken for those of the mixed rows
    return dealt.sortWithinPartitions("slot", "place").select(*marked).union(docs.limit(0))


def located(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source") -> tuple[DataFrame, int]:
    """The rows of a mixed table with their ``stretch`` (up to STRETCH rows of a file) and their ``row`` in the file, and the
    documents of a block. Rows that are not mixed are mixed first, and a table that is not written yet is written."""
    block_docs = next((f.metadata[MIXED] for f in docs.schema if MIXED in f.metadata), None)
    if block_docs is None:
        docs, block_docs = mixed(docs, id_column=id_column, source_column=source_column), BLOCK_DOCS
    try:
        file, row = (docs.metadataColumn("_metadata")[c] for c in ("file_name", "row_index"))
        part = F.regexp_extract(file, r"^part-(\d+)", 1).try_cast("long")  # five digits or more
        stretch = F.struct(part.alias("part"), file.alias("file"), F.floor(row / STRETCH).alias("run"))
        return docs.withColumns({"stretch": stretch, "row": row}), block_docs
    except AnalysisException:
        return located(cut(docs), id_column, source_column)


def turns(rows: DataFrame, block_docs: int) -> DataFrame:
    """Rows (source, stretch, row, piece) of a mixed table with the ``turn`` of their block, its number in the table's order.

    A source's documents form blocks in that order. What is counted for a stretch and a source goes through windows over
    the stretches; the rows meet those of their own stretch only.
    """
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)

    def sum_before(column: str, window):
        return F.coalesce(F.sum(column).over(window.orderBy("stretch")), F.lit(0))

    counts = rows.where("piece = 0").groupBy("stretch", "source").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("own", sum_before("n", earlier.partitionBy("source")))
    opened = counts.withColumn("opened", F.expr(f"(own + n + {block_docs - 1}) div {block_docs} - (own + {block_docs - 1}) div {block_docs}"))
    opened = opened.groupBy("stretch").agg(F.sum("opened").alias("n"))
    opened = opened.select("stretch", sum_before("n", earlier).alias("before"))
    counts = counts.join(opened, "stretch").select(F.col("stretch").alias("_stretch"), F.col("source").alias("_source"), "own", "before")
    found = rows.join(counts, (F.col("stretch") == F.col("_stretch")) & F.col("source").eqNullSafe(F.col("_source"))).drop("_stretch", "_source")
    so_far = Window.rowsBetween(Window.unboundedPreceding, Window.currentRow).orderBy("row", "piece")
    rank = F.col("own") + F.count_if(F.col("piece") == 0).over(so_far.partitionBy("stretch", "source")) - 1
    opens = (F.col("piece") == 0) & (F.col("_rank") % block_docs == 0)
    found = found.repartition(partitions(rows.sparkSession), "stretch").withColumn("_rank", rank).withColumn("_opens", opens)
    turn = F.col("before") + F.count_if("_opens").over(so_far.partitionBy("stretch")) - 1
    return found.withColumn("turn", turn).drop("own", "before", "_rank", "_opens")
