"""Exact removal of long repeated byte strings by prefix-free parsing (operator 5).

Every byte that a string of ``LENGTH`` bytes covers goes, if that string also starts anywhere else in the corpus.

Parsing: the rolling-hash trigger of a start position is the least hash of the ``GRAM``-byte windows inside its string.
It depends on the string's bytes alone, so equal strings have the trigger at the same offset. Runs of starts that share
a trigger are the phrases of the parse. A phrase's dictionary word is all the bytes that its strings span: the phrase
and the LENGTH - 1 bytes after it. The parse of highly repetitive text has few distinct words.

Order: the dictionary's suffixes are sorted by their bytes, by prefix doubling (8, 16, 32, 64, 128, LENGTH bytes). The
suffix array of the parse would order suffixes whose words are equal so far by what follows; as a word holds what follows
up to LENGTH bytes, and only neighbours that agree on LENGTH bytes matter, equal names of words take its place. Equal
words repeat as a whole, whatever their number. Words that share a trigger gram and are not equal can share some of their
strings: their suffixes are sorted together, and runs that agree on LENGTH bytes are the neighbours in corpus order that
repeat. A word that occurs once needs the answer, a word that occurs twice is a witness and is sent once.

Words are named by two 64-bit hashes (the gram's and the word's); suffixes are compared by their bytes. One row for each
phrase travels, so rows grow with the bytes, and Spark counts them by name. Where more than ``HOT``
distinct words share a gram (a passage that many documents embed), each of their strings goes by its own 128-bit hash
instead, so that no gram meets in one task. Texts travel compressed. A Python worker holds a block of about ``BLOCK``
bytes, and arrays for ``PIECE`` bytes of it at a time.

Defined results: null texts are empty; repeated rows are copies of each other, so strings that both hold go from both;
texts under LENGTH bytes lose nothing; a very long text is parsed piece by piece and judged whole; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdweave.llm import bytewise as B
from crowdweave.llm.common import cut, partitions, whole_text

LENGTH = 200
GRAM = 64
BLOCK = 4 << 20
_U = np.uint64
_PLACE = _U((1 << 28) - 1)
#: Bytes that are parsed or hashed at a time: some hundred bytes of arrays for each. Places in a piece must stay under _PLACE.
PIECE = 256 << 10
#: Distinct words of one gram that are sorted together; beyond, their strings are told apart by hash.
HOT = 4096
#: Bytes of words that one task sorts together, about.
SORTED = 1 << 20


def window_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbouring entries."""
    n = len(x)
    m = -(-n // w)
    padded = np.full(m * w, ~_U(0))
    padded[:n] = x
    padded = padded.reshape(m, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def phrases(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of the rows: first and last start position, hash of the trigger gram, hash of the word."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none.astype(_U), none.astype(_U)
    prefix = B.prefix_hash(data)
    at = np.arange(n - GRAM + 1)
    gram = B.span_hash(prefix, at, at + GRAM)
    trigger = (window_least((gram & ~_PLACE) | at.astype(_U), LENGTH - GRAM + 1) & _PLACE).astype(np.int64)
    inside = np.zeros(n + 1, np.int8)  # starts whose string ends inside its row
    long = np.diff(off) >= LENGTH
    np.add.at(inside, off[:-1][long], 1)
    np.add.at(inside, off[1:][long] - LENGTH + 1, -1)
    p = np.flatnonzero(np.cumsum(inside[:-1])[: len(trigger)])
    if not len(p):
        return none, none, none.astype(_U), none.astype(_U)
    t = trigger[p]
    first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (p[1:] != p[:-1] + 1)]))
    lo, hi, t = p[first], p[np.concatenate([first[1:], [len(p)]]) - 1], t[first]
    shape = B.mix((t - lo).astype(_U) * _U(1 << 20) + (hi - lo).astype(_U))
    return lo, hi, gram[t], B.mix(B.span_hash(prefix, lo, hi + LENGTH) ^ shape)


def parse(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``phrases`` of whole documents side by side, a little at a time."""
    found, i, n = [], 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + PIECE, "right")) - 1))
        one = j == i + 1
        for at in range(off[i], off[j], PIECE) if one else [off[i]]:  # strings do not care where a long row's pieces end
            end = min(off[j], at + PIECE + LENGTH - 1) if one else off[j]
            lo, hi, gram, word = phrases(data[at:end], np.array([0, end - at]) if one else off[i : j + 1] - off[i])
            found.append((lo + at, hi + at, gram, word))
        i = j
    parts = zip(*found, strict=True) if found else ([np.zeros(0, np.int64)],) * 4
    return tuple(np.concatenate(x) for x in parts)


_PARSED = [("block", pa.int64()), ("ids", None), ("lengths", pa.binary()), ("texts", pa.binary()), *((c, pa.int64()) for c in ("gram", "word", "first", "last"))]


def _parse(kind: pa.DataType):
    """mapInArrow: blocks of documents, a row with the packed texts of each, and a row for each phrase."""
    schema = pa.schema([(c, t or pa.list_(kind)) for c, t in _PARSED])

    def rows(ids: list[pa.Array], parts: list[np.ndarray], lengths: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        import zstandard

        name = uuid.uuid4().int >> 65
        data, sizes = np.concatenate(parts), np.concatenate(lengths)
        packed = (name, pa.concat_arrays(ids).to_pylist(), sizes.astype("<i8").tobytes(), zstandard.compress(data.tobytes(), 3), *[None] * 4)
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(packed, schema.types, strict=True)], schema=schema)
        lo, hi, gram, word = parse(data, np.concatenate([[0], np.cumsum(sizes)]))
        columns = [np.full(len(lo), name), *(pa.nulls(len(lo), t) for t in schema.types[1:4]), gram.view(np.int64), word.view(np.int64), lo, hi]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, lengths, size = [], [], [], 0
        for batch in batches:
            for i, j, data, off in B.slices(batch.column(1), PIECE):
                ids.append(batch.column(0).slice(i, j - i))
                parts.append(data.copy())
                lengths.append(np.diff(off))
                size += len(data)
                if size >= BLOCK:
                    yield from rows(ids, parts, lengths)
                    ids, parts, lengths, size = [], [], [], 0
        if ids:
            yield from rows(ids, parts, lengths)

    return run


def judged(phrases: DataFrame) -> DataFrame:
    """Rows (block, gram, word, first, last) to those that matter: whole (the word repeats), send (its strings are to be
    compared, and this block sends them), hot (by hash)."""
    distinct = phrases.groupBy("gram", "word").agg(F.count(F.lit(1)).alias("c"), F.min("block").alias("sender"))
    grams = distinct.groupBy("gram").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("c") == 1).alias("open")).where("k > 1 and open > 0")
    # a written table: the join that follows can then split the rows of a common word over many tasks
    status = cut(distinct.join(grams.select("gram", (F.col("k") > HOT).alias("hot")), "gram", "left").where("c > 1 or hot is not null"))
    found = phrases.join(status, ["gram", "word"])
    send = F.col("hot").isNotNull() & (F.col("block") == F.col("sender"))
    found = found.select("block", "gram", "word", "first", "last", (F.col("c") > 1).alias("whole"), send.alias("send"), F.coalesce("hot", F.lit(False)).alias("hot"))
    return cut(found.where("whole or send"))


def _unpacked(row: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    data = np.frombuffer(zstandard.decompress(row.column("texts")[0].as_py()), np.uint8)
    sizes = np.frombuffer(row.column("lengths")[0].as_py(), "<i8")
    return data, np.concatenate([[0], np.cumsum(sizes)])


#: weight: 2 for a word that repeats as a whole, a witness for others.
_SENT = pa.schema([*((c, pa.int64()) for c in ("block", "gram", "first", "last")), ("weight", pa.int8()), ("hot", pa.bool_()), ("bytes", pa.binary())])


def _send(docs: pa.Table, asked: pa.Table) -> pa.Table:
    """cogroup of a block with its words to be compared: their bytes."""
    if not len(docs) or not len(asked):
        return _SENT.empty_table()
    data, _ = _unpacked(docs)
    name = docs.column("block")[0].as_py()
    sample = np.unique(asked.column("word").to_numpy(), return_index=True)[1]
    gram, lo, hi, whole, hot = (asked.column(c).to_numpy()[sample] for c in ("gram", "first", "last", "whole", "hot"))
    texts = [data[a : b + LENGTH].tobytes() for a, b in zip(lo, hi, strict=True)]
    columns = [np.full(len(lo), name), gram, lo, hi, 1 + whole, hot, texts]
    return pa.table([pa.array(c, t) for c, t in zip(columns, _SENT.types, strict=True)], schema=_SENT)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: words (block, first, weight, bytes) to their single strings, a little at a time."""
    for batch in batches:
        block, first, weight = (batch.column(c).to_numpy() for c in ("block", "first", "weight"))
        for i, j, data, off in B.slices(batch.column("bytes"), PIECE):
            n = np.diff(off) - LENGTH + 1
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(off[:-1], n) + step
            prefix = B.prefix_hash(data)
            h1 = B.span_hash(prefix, at, at + LENGTH)
            halves = [B.span_hash(prefix, at + a, at + b) for a, b in ((0, LENGTH // 2), (LENGTH // 2, LENGTH))]
            h2 = B.mix(B.mix(halves[0]) * _U(3) + halves[1])
            columns = (np.repeat(block[i:j], n), np.repeat(first[i:j], n) + step, np.repeat(weight[i:j], n), h1.view(np.int64), h2.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "first", "weight", "h1", "h2"])


_RUNS = pa.schema([(c, pa.int64()) for c in ("block", "first", "last")])


def ranks(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The rank, by their bytes, of the LENGTH-byte strings that start at the places ``at``; equal strings share one."""

    def named(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        keys = keys[order]
        new = np.zeros(len(keys), np.uint32)
        new[1:] = keys[1:] != keys[:-1]
        rank = np.empty(len(keys), np.uint32)
        rank[order] = np.cumsum(new, dtype=np.uint32)
        return rank

    def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(_U) << _U(32)) | b

    size, wide = 8, np.concatenate([data, np.zeros(LENGTH, np.uint8)])
    keys = np.zeros(len(wide) - 7, _U)
    for k in range(8):
        keys |= wide[k : k + len(keys)].astype(_U) << _U(8 * (7 - k))
    rank = named(keys)
    while 2 * size <= LENGTH:
        rank = named(pairs(rank[: len(rank) - size], rank[size:]))
        size *= 2
    return named(pairs(rank[at], rank[at + LENGTH - size]))


def _compare(group: pa.Table) -> pa.Table:
    """On words of some grams: their suffixes in the order of their first LENGTH bytes; those in runs of equal ones repeat."""
    lo, hi, block = (group.column(c).to_numpy() for c in ("first", "last", "block"))
    data, _ = B.raw(group.column("bytes").combine_chunks())
    size, n = hi + LENGTH - lo, hi - lo + 1
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    weight = np.repeat(group.column("weight").to_numpy(), n)
    rank = ranks(data, np.repeat(np.cumsum(size) - size, n) + step).astype(np.int64)
    again = (np.bincount(rank, weight)[rank] >= 2) & (weight == 1)
    starts, owner = (np.repeat(lo, n) + step)[again], np.repeat(np.arange(len(lo)), n)[again]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)]) if len(starts) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(starts)]])[: len(first)] - 1
    return pa.table([pa.array(x, pa.int64()) for x in (block[owner[first]], starts[first], starts[last])], schema=_RUNS)


def by_hash(strings: DataFrame) -> DataFrame:
    """Single strings (block, first, weight, h1, h2) that occur elsewhere too."""
    twice = cut(strings.groupBy("h1", "h2").agg(F.sum("weight").alias("c")).where("c > 1").select("h1", "h2"))
    return strings.where("weight = 1").join(twice, ["h1", "h2"]).select("block", "first", F.col("first").alias("last"))


def _remove(id_column: str, kind: pa.DataType, with_text: bool):
    """cogroup of a block with its runs of repeated starts: one row per document."""
    fields = [(id_column, kind), *((c, pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")), ("kept_sha256", pa.string()), *([("kept", pa.binary())] * with_text)]
    schema = pa.schema(fields)

    def run(docs: pa.Table, runs: pa.Table) -> pa.Table:
        if not len(docs):
            return schema.empty_table()
        data, off = _unpacked(docs)
        cover = np.zeros(len(data) + 1, np.int32)
        np.add.at(cover, runs.column("first").to_numpy(), 1)
        np.add.at(cover, runs.column("last").to_numpy() + LENGTH, -1)
        gone = np.cumsum(cover[:-1], dtype=np.int32) > 0
        n_removed = B.counted(gone, off)
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        inner = off[:-1][off[:-1] < len(data)]
        opens[inner] = gone[inner]
        n_spans = B.counted(opens, off)
        kept = data[~gone]
        edge = np.concatenate([[0], np.cumsum(np.diff(off) - n_removed)])
        texts = [kept[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
        columns = [docs.column("ids")[0].as_py(), np.diff(off), n_removed, n_spans, [hashlib.sha256(x).hexdigest() for x in texts], *([texts] * with_text)]
        return pa.table([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return run


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if asked for."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(id_column).alias("id"), whole_text(text_column).alias("text"))
    kind = rows.schema["id"].dataType
    arrow, simple = to_arrow_type(kind), kind.simpleString()
    fields = f"block long, ids array<{simple}>, lengths binary, texts binary, gram long, word long, first long, last long"
    parsed = cut(rows.mapInArrow(_parse(arrow), fields))
    texts = parsed.where("texts is not null").select("block", "ids", "lengths", "texts")
    words = judged(parsed.where("word is not null").select("block", "gram", "word", "first", "last"))
    sent = texts.select("block", "lengths", "texts").groupBy("block").cogroup(words.where("send").groupBy("block"))
    sent = cut(sent.applyInArrow(_send, "block long, gram long, first long, last long, weight tinyint, hot boolean, bytes binary"))
    size = sent.where("not hot").agg(F.sum(F.octet_length("bytes")).alias("b")).first()["b"] or 0
    groups = max(partitions(docs.sparkSession), -(-size // SORTED))
    found = sent.where("not hot").withColumn("g", F.pmod(F.xxhash64("gram"), F.lit(groups)))
    found = found.groupBy("g").applyInArrow(_compare, "block long, first long, last long")
    runs = words.where("whole").select("block", "first", "last").unionByName(found)
    hashed = sent.where("hot").select("block", "first", "weight", "bytes").mapInArrow(_hash, "block long, first long, weight tinyint, h1 long, h2 long")
    runs = runs.unionByName(by_hash(hashed))
    fields = f"{id_column} {simple}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return texts.groupBy("block").cogroup(runs.groupBy("block")).applyInArrow(_remove(id_column, arrow, with_text), fields)
