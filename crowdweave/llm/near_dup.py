"""Near-duplicate classes by Order MinHash, verified by banded alignment (operator 6).

Words are lower-cased (A-Z); the k-mers of a text are its five-word shingles, each labelled with its occurrence number
in the text. A sketch takes, for each of ``SKETCHES`` hash orders, the ``KEPT`` least labelled k-mers and hashes them in
their text order, so that texts share a value if they share k-mers and their order. Texts that share a value are
candidates. A pair is verified by aligning the labelled k-mers in order, within the band of offsets that the threshold
allows: aligned / (all - aligned) must reach ``threshold``, an ordered Jaccard coefficient.

Texts with equal words are one vertex, told by a 160-bit cryptographic digest of the words (no two texts with one are
known). Round one compares each vertex with the bucket leader it shares most values
with; the links form a forest, whose roots name the components. Round two takes every candidate pair whose vertices lie
in different components (a pair inside one component cannot change a class), so no link between classes is lost and a
bucket of near copies costs a comparison for each member, not for each pair. A bucket whose components leave many pairs
is split into a grid of slots of about ``PAIRS`` each: the members outside the largest component lie along one side, all
members along the other, so that N members without a common component make some N**2 / 512 copies, not N**3.

Defined results: null and empty texts have no words and form one class; texts under five words are alike only if their
words are equal; a text of any length is sketched whole; repeated rows share a class; a class is named by its lowest
doc_id (null only if all are null), and ``one_of_each`` keeps one row of it, also where rows with one doc_id differ in
text; extra columns are ignored by ``classes`` and kept by ``one_of_each``; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdweave.llm import bytewise as B
from crowdweave.llm.common import cut, whole_text
from crowdweave.llm.graph import components, roots

SHINGLE = 5
THRESHOLD = 0.8
#: At a similarity of 0.8 a value of three k-mers agrees with probability 0.51; all 16 differ in 1 of 100,000 pairs.
SKETCHES = 16
KEPT = 3
#: Bytes of text that are sketched at a time; the arrays made from them take some fifty times as much.
SLICE = 1 << 20
#: Slots of the masks that bound the similarity of two vertices.
MASK_BITS = 4096
#: Pairs of a bucket that one slot of the round-two join may hold.
PAIRS = 1 << 20
_ORDERS = np.random.default_rng(11).integers(1, 2**63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def labelled(keys: np.ndarray) -> np.ndarray:
    """Hashes of (key, how many equal keys come before it)."""
    if len(keys) < 2:
        return B.mix(keys)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.empty(len(keys), bool)
    new[0], new[1:] = True, ordered[1:] != ordered[:-1]
    at = np.arange(len(keys))
    before = np.empty(len(keys), np.uint64)
    before[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return B.mix(keys + before * np.uint64(0xD6E8FEB86659FD93))


def sketch(keys: np.ndarray) -> np.ndarray:
    """Order MinHash values of labelled k-mers in text order."""
    if not len(keys):
        return np.zeros(0, np.int64)
    ranks = keys[None, :] * _ORDERS[:, None]
    rows = np.arange(SKETCHES)
    least = []
    for _ in range(min(KEPT, len(keys))):
        at = ranks.argmin(axis=1)
        least.append(at)
        ranks[rows, at] = np.uint64(0xFFFFFFFFFFFFFFFF)
    value = _ORDERS.copy()
    for at in np.sort(np.array(least), axis=0):
        value = B.mix(value * np.uint64(31) + keys[at])
    return value.view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> int:
    """Most labelled k-mers of a and b that match in order, at offsets within the band; 0 if the threshold is out of reach."""
    need = threshold / (1 + threshold) * (len(a) + len(b))
    if min(len(a), len(b)) < need - 1e-9:
        return 0
    order = np.argsort(b, kind="stable")
    at = np.minimum(np.searchsorted(b[order], a), len(b) - 1)
    j = order[at]
    i = np.flatnonzero(b[j] == a)
    j = j[i]
    # before a match, each unmatched k-mer shifts the offset by one at most
    near = np.abs(i - j) <= len(a) + len(b) - 2 * need + 1
    i, j = i[near], j[near]
    if len(j) < need - 1e-9:
        return 0
    if (np.diff(j) > 0).all():
        return len(j)
    tails: list[int] = []  # longest increasing run of places in b
    for x in j.tolist():
        k = bisect_left(tails, x)
        tails[k : k + 1] = [x]
    return len(tails)


def packed(keys: np.ndarray) -> bytes:
    """48 bits of each hash: all lower halves, then all upper parts."""
    return (keys & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (keys >> np.uint64(32)).astype("<u2").tobytes()


def unpacked(data) -> np.ndarray:
    n = len(data) // 6
    low, high = np.frombuffer(data, "<u4", n), np.frombuffer(data, "<u2", n, 4 * n)
    return low.astype(np.int64) | (high.astype(np.int64) << 32)


def similar(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> bool:
    m = aligned(a, b, threshold)
    return bool(m) and m >= threshold * (len(a) + len(b) - m) - 1e-9


def identity(text: bytes) -> bytes:
    """What texts with equal words share: a digest of the (lower-cased) words with one space between them."""
    return blake2b(b" ".join(text.split()), digest_size=20).digest()


def _shingled(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Slices of the texts: first row, row after the last, their bytes (lower-cased) and offsets, labelled k-mers of each row."""
    for i, j, data, off in B.slices(column, SLICE):
        data = _LOWER[data]
        starts, ends, row = B.words(data, off)
        h = B.span_hash(B.prefix_hash(data), starts, ends)
        first = np.searchsorted(row, np.arange(j - i + 1))
        shingles = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE):
            shingles = B.mix(shingles + h[k : k + len(shingles)])
        yield i, j, data, off, [labelled(shingles[a : max(a, b - SHINGLE + 1)]) for a, b in zip(first[:-1], first[1:], strict=True)]


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, off, keys in _shingled(batch.column(1)):
            nodes = [identity(data[a:b].tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)]
            values = list(map(sketch, keys))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate(values) if values else [], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(nodes, pa.binary()), pa.array(list(map(len, keys)), pa.int32()), lists],
                names=["id", "digest", "node", "n", "values"],
            )


def _sequenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, _, _, keys in _shingled(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(map(packed, keys), pa.binary())], names=["vertex", "sequence"])


def sketched(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, digest (of the text), node (identity of the words), n (shingles), values (the sketch)."""
    rows = docs.select(F.col(id_column).alias("id"), whole_text(text_column).alias("text"), F.xxhash64(text_column).alias("digest"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_sketched, f"id {kind}, digest long, node binary, n int, values array<bigint>")


def _keyed(docs: DataFrame, id_column: str, text_column: str, *columns) -> DataFrame:
    """Rows with plain keys that are never null: the id's text, whether it is null, the text's digest."""
    name = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return docs.select(*columns, name.alias("_name"), F.col(id_column).isNull().alias("_none"), F.xxhash64(text_column).alias("_text"))


_KEYS = ["_name", "_none", "_text"]


def _first_keys() -> list:
    name = F.coalesce(F.col("first.id").cast("string"), F.lit(""))
    return [name.alias("_name"), F.col("first.none").alias("_none"), F.col("first.digest").alias("_text")]


def sequences_of(docs: DataFrame, wanted: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(vertex, sequence of 48-bit labelled shingles) of the documents that ``wanted`` (vertex, first) names."""
    texts = _keyed(docs, id_column, text_column, whole_text(text_column).alias("text"))
    # the same plan at every size: the texts of a large table have to be dealt out, those of a small one are too
    found = texts.join(wanted.select("vertex", *_first_keys()).hint("merge"), _KEYS).dropDuplicates(_KEYS)
    return cut(found.select("vertex", "text").mapInArrow(_sequenced, "vertex long, sequence binary"))


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            good = [
                k for k in range(batch.num_rows)
                if similar(unpacked(a[k].as_buffer()), unpacked(b[k].as_buffer()), threshold)
            ]
            yield batch.select([0, 1]).take(pa.array(good, pa.int64()))

    return run


def verified(pairs: DataFrame, sequences: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of vertices whose alignment reaches the threshold."""
    left = sequences.select(F.col("vertex").alias("a"), F.col("sequence").alias("sa"))
    right = sequences.select(F.col("vertex").alias("b"), F.col("sequence").alias("sb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(_verify(threshold), "a long, b long")


def _mixed(part: DataFrame) -> DataFrame:
    """Members (bucket, vertex, component, ...) of the buckets that hold several components; main: in the largest one;
    tall, wide: the grid whose slots hold about PAIRS pairs each of a bucket's members outside the largest one (dealt over
    the ``tall`` rows) with all its members (dealt over the ``wide`` columns)."""
    sizes = part.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("size"))
    several = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.sum("size").alias("all"), F.max(F.struct("size", "component")).alias("top"))
    rest = F.col("all") - F.col("top.size")
    slots = F.ceil(rest * F.col("all") / PAIRS)
    grid = several.where("k > 1").withColumn("tall", F.ceil(F.sqrt(slots * rest / F.col("all"))).cast("int")).withColumn("wide", F.ceil(slots / F.col("tall")).cast("int"))
    found = part.join(grid.select("bucket", F.col("top.component").alias("top"), "tall", "wide"), "bucket")
    return cut(found.withColumn("main", F.col("component") == F.col("top")).drop("top"))


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = B.raw(batch.column(1))
        for i in range(0, len(off) - 1, 256):
            j = min(i + 256, len(off) - 1)
            kmers = np.concatenate([unpacked(data[a:b]) for a, b in zip(off[i:j], off[i + 1 : j + 1], strict=True)])
            owner = np.repeat(batch.column(0).slice(i, j - i).to_numpy(), np.diff(off[i : j + 1]) // 6)
            yield pa.RecordBatch.from_arrays([pa.array(kmers), pa.array(owner)], names=["k", "v"])


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, sequence, own) to v, c (k-mers that are not own) and mask: a bit for each of MASK_BITS slots they fall in."""
    for batch in batches:
        masks, left = [], []
        for sequence, own in zip(batch.column(1), batch.column(2), strict=True):
            kmers = unpacked(sequence.as_buffer())
            if own.is_valid:
                kmers = kmers[~np.isin(kmers, own.values.to_numpy())]
            slots = (kmers.astype(np.uint64) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) % np.uint64(MASK_BITS)
            bits = np.zeros(MASK_BITS, np.uint8)
            bits[slots.astype(np.int64)] = 1
            masks.append(np.packbits(bits, bitorder="little").view("<i8"))
            left.append(len(kmers))
        words = pa.array(np.concatenate(masks) if masks else np.zeros(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(masks) + 1) * (MASK_BITS // 64), pa.int32()), words)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.int32()), lists], names=["v", "c", "mask"])


def _shared_kmers(part: DataFrame, sequences: DataFrame) -> DataFrame:
    """Per vertex of ``part`` (v): how many of its k-mers other vertices have too, and the slots of those."""
    wanted = part.select(F.col("vertex").alias("v")).distinct()
    rows = cut(sequences.select(F.col("vertex").alias("v"), "sequence").join(wanted, "v", "left_semi"))
    kmers = rows.mapInArrow(_spread, "k long, v long").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
    own = kmers.where("n = 1").groupBy("v").agg(F.collect_list("k").alias("own"))
    return rows.join(own, "v", "left").select("v", "sequence", "own").mapInArrow(_masked, "v long, c int, mask array<bigint>")


def _fit(x: str, y: str, threshold: float):
    return F.least(x, y) >= threshold * F.greatest(x, y)


def _shared(nodes: DataFrame) -> DataFrame:
    """Vertices that share a bucket: n, buckets (an array of the shared ones) and met (the members of these, summed)."""
    rows = nodes.select("vertex", "n", F.posexplode("values").alias("order", "value"))
    rows = rows.select("vertex", "n", F.xxhash64("order", "value").alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    found = rows.join(counts, "bucket").groupBy("vertex").agg(
        F.first("n").alias("n"), F.sum("members").alias("met"), F.collect_list("bucket").alias("buckets")
    )
    return cut(found)


def _leaders(shared: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b): each vertex and the leader it shares most buckets with. The original of a group of copies meets the
    most others, so it leads its buckets; a leader's (met, vertex) is higher than its followers', so no circle arises."""
    members = shared.select("vertex", "n", "met", F.explode("buckets").alias("bucket"))
    chiefs = members.groupBy("bucket").agg(F.max(F.struct("met", "vertex", "n")).alias("top"))
    led = members.join(chiefs.select("bucket", F.col("top.vertex").alias("chief"), F.col("top.n").alias("chief_n")), "bucket")
    close = led.where(F.col("vertex") != F.col("chief")).where(_fit("n", "chief_n", threshold))
    met = close.groupBy("vertex").agg(F.collect_list("chief").alias("chiefs"))  # one for each bucket at most
    most = F.array_max(F.transform(F.array_distinct("chiefs"), lambda x: F.struct(F.size(F.filter("chiefs", lambda y: y == x)).alias("c"), x.alias("b"))))
    return met.select(F.col("vertex").alias("a"), most["b"].alias("b"))


def _across(mixed: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs of different components that the bounds leave possible."""
    fields = {"vertex": "{}", "n": "n{}", "c": "k{}", "component": "c{}", "mask": "m{}", "over": "o{}"}

    def side(rows: DataFrame, mark: str, slot) -> DataFrame:
        return rows.select("bucket", slot.alias("slot"), *[F.col(x).alias(y.format(mark)) for x, y in fields.items()], *(["main"] if mark == "b" else []))

    # a slot is a row and a column of the grid; two members meet in one slot only
    row, column = F.pmod(F.xxhash64("vertex"), F.col("tall")).cast("int"), F.pmod(F.xxhash64(F.lit(1), "vertex"), F.col("wide")).cast("int")
    minor = side(mixed.where(~F.col("main")), "a", F.explode(F.transform(F.sequence(F.lit(0), F.col("wide") - 1), lambda c: row * F.col("wide") + c)))
    every = side(mixed, "b", F.explode(F.transform(F.sequence(F.lit(0), F.col("tall") - 1), lambda r: r * F.col("wide") + column)))
    apart = (F.col("ca") != F.col("cb")) & (F.col("main") | (F.col("a") < F.col("b")))
    most = F.least("ka", "kb")
    within = _fit("na", "nb", threshold) & (most >= threshold * (F.col("na") + F.col("nb") - most))
    both = sum((F.bit_count(F.col("ma")[i].bitwiseAND(F.col("mb")[i])) for i in range(MASK_BITS // 64)), F.lit(0)) + F.least("oa", "ob")
    found = minor.join(every, ["bucket", "slot"]).where(apart & within & (both >= threshold * (F.col("na") + F.col("nb") - both)))
    return found.select("a", "b").distinct()


def _classified(docs: DataFrame, threshold: float, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """The sketched rows, and per node: first (its class's lowest id and that row's digest) and equal (rows of the node)."""
    rows = cut(sketched(docs, id_column, text_column))
    first = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    nodes = rows.groupBy("node").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("equal"), F.first("n").alias("n"), F.first("values").alias("values"))
    nodes = cut(nodes.withColumn("vertex", F.monotonically_increasing_id()))
    shared = _shared(nodes)
    wanted = cut(nodes.select("vertex", "first").join(shared.select("vertex"), "vertex", "left_semi"))
    sequences = sequences_of(docs, wanted, id_column, text_column)
    linked = verified(_leaders(shared, threshold), sequences, threshold)
    label = roots(linked.select(F.col("a").alias("vertex"), F.col("b").alias("parent")))

    # round two: candidate pairs across components; the largest component of a bucket is only compared with the others
    part = shared.select("vertex", "n", "buckets").join(label, "vertex", "left")
    part = _mixed(part.select("vertex", "n", F.coalesce("root", "vertex").alias("component"), F.explode("buckets").alias("bucket"))).drop("main", "tall", "wide")
    # k-mers that no other vertex has cannot be aligned. Of the others, two vertices share at most as many as slots that
    # both fill, and those that fall into a slot already filled. Both bound the similarity from above, exactly.
    part = part.join(_shared_kmers(part, sequences).withColumnRenamed("v", "vertex"), "vertex").where(F.col("c") >= threshold * F.col("n"))
    part = part.withColumn("over", F.col("c") - sum((F.bit_count(F.col("mask")[i]) for i in range(MASK_BITS // 64)), F.lit(0)))
    more = verified(_across(_mixed(cut(part)), threshold), sequences, threshold)

    # links between components, by the components' roots
    one, two = (label.select(F.col("vertex").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    named = more.join(one, "a", "left").join(two, "b", "left")
    joined = components(named.select(F.coalesce("ra", "a").alias("u"), F.coalesce("rb", "b").alias("v")))
    tops = joined.select(F.col("u").alias("root"), F.col("v").alias("top"))
    known = wanted.join(label, "vertex", "left").withColumn("root", F.coalesce("root", "vertex")).join(tops, "root", "left")
    known = cut(known.select("vertex", "first", F.coalesce("top", "root").alias("class")))
    lowest = known.groupBy("class").agg(F.min("first").alias("lowest"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    found = nodes.select("node", "vertex", "first", "equal").join(known.select("vertex", "class").join(lowest, "class").drop("class"), "vertex", "left")
    return rows, cut(found.select("node", F.coalesce("lowest", "first").alias("first"), "equal"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its id, class_id (the lowest id of its class), n_shingles, and equal (documents with its words)."""
    rows, found = _classified(docs, threshold, id_column, text_column)
    named = rows.select("id", "node", "n").join(found, "node")
    return named.select(F.col("id").alias(id_column), F.col("first.id").alias("class_id"), F.col("n").alias("n_shingles"), "equal")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents that name their class, with all columns; of rows with equal id and text one stays."""
    _, found = _classified(docs, threshold, id_column, text_column)
    # the dealing of the join serves the removal of repeated rows too, so texts move once
    rows = _keyed(docs, id_column, text_column, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(found.select(*_first_keys()).distinct(), _KEYS, "left_semi").dropDuplicates(_KEYS).select("row.*")
