"""Language-model scores by context-tree weighting over bytes (operator 1).

A text is its words (lower-cased A-Z), one space between them, and an end mark. The model predicts each byte from the
``DEPTH`` bytes before it, as eight binary decisions. Every decision has a node in the tree of each context of length 0
to DEPTH; a node's Krichevsky-Trofimov estimate and the weighted product of its longer contexts are mixed half and
half, so the probability of a byte mixes the estimates of all depths. A context that training never saw has no node:
the longest one that it did see predicts alone.

Nothing of the model goes through one task. Documents are dealt into blocks of bounded size. A block sends each distinct
(context, byte) gram of its texts once, as a row with its training count, so rows grow with the bytes; Spark sums them by
gram. The sums are dealt by the last two context bytes, so that a shard holds whole subtrees. Contexts of length 0 and 1
are summed over the shards (at most 65,280 nodes, whatever the input) and sent to all. Each shard codes its grams, the
values join the rows that asked for them, and texts are scored where they lie. Word counts for the base score travel in
the same way, and what is gathered grows with the input.

``score`` and ``bits_per_byte`` are about the coded bytes: white space between two words counts as one space, as the
base score has words only; ``n_bytes`` counts the coded bytes, the end mark included.

Defined results: null texts are empty (their end mark is scored); a null doc_id counts as the text ''; repeated rows
are learned and scored once each; without training documents all counts are 0; a very long text is learned and scored
whole, in one block; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdweave.llm import bytewise as B
from crowdweave.llm.common import BLOCK_BYTES, block_count, cut, partitions, whole_text

DEPTH = 5
FOLDS = 7
HELD_FOLD = 2
#: Bytes of text that are scored at a time; the arrays made from them take some fifty times as much.
SLICE = 1 << 19
#: Keys that a block's counter gathers before it sums them.
GATHERED = 1_250_000
#: Distinct grams of the corpus that one shard should hold.
SHARD_GRAMS = 500_000
#: Rows of grams and words that one task of the answers' join should sort.
PART_ROWS = 250_000
END = 0xFF  # never a byte of UTF-8
_END_WORD = np.uint64(0x656E64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64
_LN2 = np.log(2.0)
_SMALL = 1 << 16


def _stirling(z: np.ndarray) -> np.ndarray:
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3)


_HALF = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_SMALL) + 0.5))])
_FULL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_SMALL) + 1.0))])


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""

    def part(n, small, shift):
        n = np.asarray(n, np.float64)
        at = np.minimum(n, _SMALL).astype(np.int64)
        big = np.maximum(n, 1) + shift
        return np.where(n <= _SMALL, small[at], _stirling(big) - (0.5 * np.log(np.pi) if shift == 0.5 else 0.0))

    return part(zeros, _HALF, 0.5) + part(ones, _HALF, 0.5) - part(zeros + ones, _FULL, 1.0)


def stream(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows' bytes as they are coded: DEPTH end marks, then words with a space after each, the last one's an end
    mark. Also where each row starts, and the words' hashes, rows and number per row."""
    n = len(off) - 1
    data = _LOWER[data]
    starts, ends, row = B.words(data, off)
    hashes = B.span_hash(B.prefix_hash(data), starts, ends)
    per = B.per_row(row, n)
    lengths = np.bincount(row, weights=ends - starts, minlength=n).astype(np.int64) + np.maximum(per, 1) + DEPTH
    first = np.concatenate([[0], np.cumsum(lengths)])
    out = np.full(int(first[-1]), END, np.uint8)
    if len(starts):
        size = ends - starts
        before = np.cumsum(size + 1) - (size + 1)  # bytes and separators of earlier words
        lead = before - before[np.searchsorted(row, row)]  # within the row
        to = first[row] + DEPTH + lead
        step = np.repeat(to - starts, size)
        source = np.flatnonzero(~B.SPACE[data])
        out[source + step] = data[source]
        inner = np.flatnonzero(row[1:] == row[:-1])
        out[to[inner] + size[inner]] = 32
    return out, first, hashes, row, per


def grams(out: np.ndarray) -> np.ndarray:
    """For each byte from the sixth: the last context byte first, then the older ones, then the byte itself."""
    key = out[DEPTH:].astype(_U)
    for back in range(1, DEPTH + 1):
        key |= out[DEPTH - back : len(out) - back].astype(_U) << _U(8 * (DEPTH + 1 - back))
    return key


def scored_places(out: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which entries of ``grams`` are scored: all but those of the leading end marks."""
    use = np.ones(len(out), bool)
    for k in range(DEPTH):
        use[first[:-1] + k] = False
    return use[DEPTH:]


class Counter:
    """Distinct keys and their training counts, gathered slice by slice."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts.astype(np.int64))
        self.size += len(keys)
        if len(self.keys) > 8 and self.size > GATHERED:
            self.fold()

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate(self.keys) if self.keys else np.zeros(0, _U)
        counts = np.concatenate(self.counts) if self.counts else np.zeros(0, np.int64)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.counts = [keys[new]], [np.add.reduceat(counts, new) if len(new) else counts]
        self.size = len(new)
        return self.keys[0], self.counts[0]


_ASKED = pa.schema([("block", pa.int32()), ("word", pa.bool_()), ("key", pa.int64()), ("n", pa.int64())])


def _ask(block: pa.Table) -> pa.Table:
    """applyInArrow on a block: one row for each distinct gram and each distinct word, with its training count."""
    kept = (Counter(), Counter())
    for batch in block.to_batches():
        held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        for i, j, data, off in B.slices(batch.column("text"), SLICE):
            out, first, hashes, row, _ = stream(data, off)
            keys, use = grams(out), scored_places(out, first)
            train = ~held[i:j]
            of = np.repeat(train, np.diff(first))[DEPTH:]
            ends = np.array([_END_WORD])
            for counter, k, t in ((kept[0], keys[use], of[use]), (kept[1], hashes, train[row])):
                counter.add(k[t])
                other = np.unique(k[~t])
                counter.add(other, np.zeros(len(other), np.int64))
            kept[1].add(ends, np.array([train.sum()]))
    (keys, counts), (words, word_counts) = (x.fold() for x in kept)
    of_word = np.repeat([False, True], [len(keys), len(words)])
    number = np.full(len(of_word), block.column("block")[0].as_py(), np.int32)
    columns = (number, of_word, np.concatenate([keys, words]).view(np.int64), np.concatenate([counts, word_counts]))
    return pa.table([pa.array(c) for c in columns], schema=_ASKED)


_PACKED = pa.schema([("keys", pa.binary()), ("counts", pa.binary())])


def _pack(shard: pa.Table) -> pa.Table:
    """A shard's grams with their counts over all blocks, in order, as packed arrays."""
    keys, counts = (shard.column(c).to_numpy() for c in ("key", "n"))
    order = np.argsort(keys)
    return pa.table({"keys": [keys[order].astype("<u8").tobytes()], "counts": [counts[order].astype("<u8").tobytes()]}, _PACKED)


class Tree:
    """The context tree of a shard, from sorted grams and counts: depths 2 to DEPTH, each with eight bit levels."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys = keys
        self.levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for d in range(DEPTH, 1, -1):
            own = ((keys >> _U(8 * (DEPTH + 1 - d))) << _U(8)) | (keys & _U(0xFF))
            grams_d, at = np.unique(own, return_inverse=True)
            self.levels[d] = (grams_d, at, np.bincount(at, counts, len(grams_d)))

    def nodes(self, bit: int) -> dict[int, dict[str, np.ndarray]]:
        """For each depth: the nodes' ids, zeros and ones, KT and weighted probabilities, and each gram's node."""
        found: dict[int, dict[str, np.ndarray]] = {}
        below = None
        for d, (grams_d, _, n) in self.levels.items():
            ids = grams_d >> _U(8 - bit)
            new = np.concatenate([[True], ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, bool)
            at = np.cumsum(new) - 1
            ids = ids[new]
            total = np.bincount(at, n, len(ids))
            ones = np.bincount(at, n * ((grams_d >> _U(7 - bit)) & _U(1)), len(ids))
            kt = log_kt(total - ones, ones)
            if below is None:
                inner, weighted = None, kt
            else:
                parent = ((below["ids"] >> _U(bit + 8)) << _U(bit)) | (below["ids"] & _U((1 << bit) - 1))
                inner = np.bincount(np.searchsorted(ids, parent), below["weighted"], len(ids))
                weighted = np.logaddexp(kt, inner) - _LN2
            below = found[d] = {"ids": ids, "at": at, "total": total, "ones": ones, "kt": kt, "inner": inner, "weighted": weighted}
        return found

    def summary(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Summed over contexts of length 2, per last byte and bit node: weighted logarithms, totals, ones."""
        out = np.zeros((3, 256, 256))
        for bit in range(8):
            two = self.nodes(bit)[2]
            last = (two["ids"] >> _U(bit + 8)).astype(np.int64)
            node = (1 << bit) | (two["ids"] & _U((1 << bit) - 1)).astype(np.int64)
            for k, name in enumerate(("weighted", "total", "ones")):
                np.add.at(out[k], (last, node), two[name])
        return out

    def code(self, top: dict[str, np.ndarray]) -> np.ndarray:
        """The base-10 logarithm of each gram's byte, given its context."""
        result = np.zeros(len(self.keys))
        byte = (self.keys & _U(0xFF)).astype(np.int64)
        last = (self.keys >> _U(8 * DEPTH)).astype(np.int64)
        for bit in range(8):
            one = (byte >> (7 - bit)) & 1
            q, seen = np.full(len(byte), 0.5), np.zeros(len(byte), bool)
            for d, nodes in self.nodes(bit).items():
                at = nodes["at"][self.levels[d][1]]
                q, seen = _mix(q, seen, one, nodes["total"][at], nodes["ones"][at], None if nodes["inner"] is None else nodes["kt"][at] - nodes["inner"][at])
            node = (1 << bit) | (byte >> (8 - bit))
            q, seen = _mix(q, seen, one, top["total1"][last, node], top["ones1"][last, node], top["odds1"][last, node])
            q, seen = _mix(q, seen, one, top["total0"][node], top["ones0"][node], top["odds0"][node])
            result += np.log10(q)
        return result


def _mix(q, seen, one, total, ones, odds):
    """Mix a node's own estimate with what the longer contexts say (q, where seen), by the weights' log odds."""
    own = (np.where(one, ones, total - ones) + 0.5) / (total + 1)
    if odds is None:
        mixed = own
    else:
        weight = 1 / (1 + np.exp(np.clip(-odds, -700, 700)))
        mixed = np.where(seen, weight * own + (1 - weight) * q, own)
    known = total > 0
    return np.where(known, mixed, 0.5), known


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for keys, counts in zip(batch.column("keys"), batch.column("counts"), strict=True):
            yield np.frombuffer(keys.as_buffer(), "<u8"), np.frombuffer(counts.as_buffer(), "<u8").astype(np.int64)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, counts in _shards(batches):
        out = Tree(keys, counts).summary()
        last, node = np.nonzero(out[1])
        values = [last.astype(np.int32), node.astype(np.int32), *(x[last, node] for x in out)]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["last", "node", "weighted", "total", "ones"])


def top_of(packed: DataFrame) -> dict[str, np.ndarray]:
    """Nodes of the contexts of length 0 and 1: at most 65,280 rows."""
    rows = packed.mapInArrow(_summaries, "last int, node int, weighted double, total double, ones double")
    rows = rows.groupBy("last", "node").agg(*[F.sum(c).alias(c) for c in ("weighted", "total", "ones")]).collect()
    inner, total, ones = np.zeros((3, 256, 256))
    for r in rows:
        inner[r["last"], r["node"]], total[r["last"], r["node"]], ones[r["last"], r["node"]] = r["weighted"], r["total"], r["ones"]
    kt = log_kt(total - ones, ones)
    weighted = np.where(total > 0, np.logaddexp(kt, inner) - _LN2, 0.0)
    total0, ones0 = total.sum(axis=0), ones.sum(axis=0)
    return {
        "total1": total, "ones1": ones, "odds1": kt - inner, "total0": total0, "ones0": ones0,
        "odds0": log_kt(total0 - ones0, ones0) - weighted.sum(axis=0),
    }


def _coded(top: dict[str, np.ndarray]):
    """mapInArrow on the packed shards: each gram's logarithm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _shards(batches):
            values = Tree(keys, counts).code(top)
            for i in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)].view(np.int64)), pa.array(values[i : i + (1 << 16)])], names=["key", "value"])

    return run


_SCORED = [("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64()), ("bits_per_byte", pa.float64())]


def _score(tokens: int, distinct: int, id_column: str):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        words, keys, values = (answers.column(c).to_numpy() for c in ("word", "key", "value"))
        known = []
        for word in (False, True):
            own = np.flatnonzero(words == word)
            own = own[np.argsort(keys[own])]
            known.append((keys[own], values[own]))
        out: list[list] = [[] for _ in range(len(_SCORED) + 1)]

        def find(asked: np.ndarray, word: int) -> np.ndarray:
            distinct, at = np.unique(asked.view(np.int64), return_inverse=True)
            return known[word][1][np.searchsorted(known[word][0], distinct)][at]

        for batch in block.to_batches():
            held = batch.column("held_out")
            for i, j, data, off in B.slices(batch.column("text"), SLICE):
                stream_bytes, first, hashes, row, per = stream(data, off)
                use = scored_places(stream_bytes, first)
                value = np.zeros(len(stream_bytes) + 1)
                at = np.flatnonzero(use) + DEPTH
                value[at + 1] = find(grams(stream_bytes)[use], 0)
                np.cumsum(value, out=value)
                score = value[first[1:]] - value[first[:-1]]
                count, end = find(hashes, 1), find(np.array([_END_WORD]), 1)[0]
                floor = np.log10(tokens + distinct + 1)
                base = np.bincount(row, np.log10(count + 1), j - i) + np.log10(end + 1) - (per + 1) * floor
                n_known = np.bincount(row, count > 0, j - i) + (end > 0)
                n_bytes = np.diff(first) - DEPTH
                bits = -score / np.log10(2) / n_bytes
                columns = (batch.column(id_column).slice(i, j - i), held.slice(i, j - i), per + 1, n_known.astype(np.int64), np.full(j - i, tokens), base, score, n_bytes, bits)
                for column, x in zip(out, columns, strict=True):
                    column.append(x if isinstance(x, pa.Array) else pa.array(x))
        pa.default_memory_pool().release_unused()
        kinds = [block.schema.field(id_column).type, *(t for _, t in _SCORED)]
        return pa.table([pa.chunked_array(x, t) if x else pa.chunked_array([pa.array([], t)]) for x, t in zip(out, kinds, strict=True)], names=[id_column, *(n for n, _ in _SCORED)])

    return run


def scores(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    The model learns from all documents whose crc32 of the id's text, modulo 7, is not 2.
    """
    # by bytes alone: a block sends a gram once, so small blocks would send more rows for the same text
    blocks = block_count(docs, text_column, block_bytes, 1)
    remainder = F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % FOLDS
    rows = docs.select(F.col(id_column), (remainder == HELD_FOLD).alias("held_out"), whole_text(text_column).alias("text"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(id_column, "text"), F.lit(blocks)).cast("int"))
    kind = rows.schema[id_column].dataType.simpleString()
    asked = cut(rows.select("block", "held_out", "text").groupBy("block").applyInArrow(_ask, "block int, word boolean, key long, n long"))
    model = cut(asked.groupBy("word", "key").agg(F.sum("n").alias("n")))
    sums = model.agg(
        F.count_if(~F.col("word")).alias("grams"), F.sum(F.when(F.col("word"), F.col("n"))).alias("tokens"),
        F.count_if(F.col("word") & (F.col("n") > 0)).alias("distinct"),
    ).first()
    shards = max(partitions(docs.sparkSession), -(-sums["grams"] // SHARD_GRAMS))
    two = F.shiftrightunsigned("key", 8 * (DEPTH - 1))
    dealt = model.where("not word").select("key", "n", F.pmod(F.xxhash64(two), F.lit(shards)).alias("shard"))
    packed = cut(dealt.groupBy("shard").applyInArrow(_pack, "keys binary, counts binary"))
    coded = packed.mapInArrow(_coded(top_of(packed)), "key long, value double").select(F.lit(False).alias("word"), "key", "value")
    values = coded.unionByName(model.where("word").select("word", "key", F.col("n").cast("double").alias("value")))
    # both sides in parts of a bounded size, so that no task sorts more than that
    parts = max(partitions(docs.sparkSession), -(-asked.count() // PART_ROWS))
    questions = asked.select("block", "word", "key").repartition(parts, "word", "key")
    answers = questions.join(values.repartition(parts, "word", "key"), ["word", "key"]).select("block", "word", "key", "value")
    fields = f"{id_column} {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    scored = _score(int(sums["tokens"] or 0), sums["distinct"], id_column)
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, fields)
