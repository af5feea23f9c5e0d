"""Quality rules by compression bands (operator 10).

A text is compressed with zstandard as a whole and in fixed chunks. Ratios (compressed bytes over bytes) must lie in
a band that depends on the length, since short texts compress less: below it the text repeats itself, above it it is
incompressible. A text also goes when more than ``CHUNK_SHARE`` of its chunks leave the chunk band.

Defined results: null and empty texts have no words and fail the base rule; repeated rows are judged alike, row by row;
a very long text is judged whole and in all its chunks; extra columns are kept by ``filter_kept`` and ignored by ``quality``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdweave.llm import bytewise as B
from crowdweave.llm.common import whole_text

LEVEL = 3
#: Bytes of text that are counted at a time; the arrays made from them take some fifty times as much.
SLICE = 1 << 20
#: Pairs of spans that are turned into Python numbers at a time.
COMPARED = 1 << 12
CHUNK = 4096
#: Shorter last chunks say little; they are judged only as part of the whole text.
LEAST_CHUNK = 1024
CHUNK_BAND = (0.34, 0.72)
CHUNK_SHARE = 0.2
#: (bytes from, lowest ratio, highest ratio) of whole texts; measured on labelled prose with a margin of about a tenth.
BANDS = [
    (0, 0.0, 9.0), (100, 0.40, 1.30), (200, 0.44, 0.95), (400, 0.45, 0.85), (800, 0.43, 0.76), (1600, 0.41, 0.68),
    (3200, 0.39, 0.62), (6400, 0.37, 0.60), (12800, 0.355, 0.58), (25600, 0.345, 0.56),
]
#: Labelled texts that bands are fitted on, at most.
FIT_ROWS = 100_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"[#*$%&|<>]"[1:-1]
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, ratio double, chunks long, chunks_out long"
)


def _plain_repeats(text: bytes) -> tuple[int, int]:
    """Repeated lines with a word, and words in windows of three that are found twice, of one text."""
    lines = [x for x in text.split(b"\n") if x.split()]
    w = text.split()
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + d for k, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[x] > 1 for d in range(3)}
    return len(lines) - len(set(lines)), len(covered)


def _unlike(whole: bytes, row: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray, exact: bool = False) -> set[int]:
    """Rows of the pairs of spans (a[i], b[i]) whose hashes agree but whose rows or words (if exact: bytes) do not."""
    odd: set[int] = set()
    for k in range(0, len(a), COMPARED):
        x, y = a[k : k + COMPARED], b[k : k + COMPARED]
        for i, j, s, e, u, v in zip(*(c.tolist() for c in (row[x], row[y], starts[x], ends[x], starts[y], ends[y])), strict=True):
            if i != j or (whole[s:e] != whole[u:v] and (exact or whole[s:e].split() != whole[u:v].split())):
                odd |= {i, j}
    return odd


def base_counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The five base counts of each row. Lines and windows are found by hash; those that agree are compared by their
    bytes, and a row with any that differ is counted word by word."""
    n = len(off) - 1
    whole, odd = data.tobytes(), set()
    starts, ends, row = B.words(data, off)
    out = {"n_words": B.per_row(row, n)}
    out["word_chars"] = B.counted(~B.SPACE[data] & ((data & 0xC0) != 0x80), off)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out["n_symbols"] = B.counted(symbol[data], off)
    prefix = B.prefix_hash(data)
    # lines: they end at line feeds and at row ends
    cuts = np.flatnonzero(data == 10)
    l_start = np.sort(np.concatenate([off[:-1], cuts + 1]))
    l_end = np.sort(np.concatenate([off[1:], cuts]))
    lf_in = B.counted(data == 10, off)
    l_row = np.repeat(np.arange(n), lf_in + 1)
    with_word = np.searchsorted(starts, l_end) > np.searchsorted(starts, l_start)
    l_start, l_end, l_row = l_start[with_word], l_end[with_word], l_row[with_word]
    salt = B.mix(np.arange(1, n + 1).astype(np.uint64))
    _, first, group = np.unique(B.span_hash(prefix, l_start, l_end) ^ salt[l_row], return_index=True, return_inverse=True)
    again = np.setdiff1d(np.arange(len(l_row)), first, assume_unique=True)
    odd |= _unlike(whole, l_row, l_start, l_end, again, first[group[again]], exact=True)
    out["n_dup_lines"] = B.per_row(l_row, n) - B.per_row(l_row[first], n)
    # words in windows of three that are found twice or more in the row
    covered = np.zeros(len(starts) + 2, bool)
    if len(starts) >= 3:
        h = B.span_hash(prefix, starts, ends)
        at = np.flatnonzero(row[:-2] == row[2:])
        key = B.mix(h[at] * np.uint64(3) + B.mix(h[at + 1]) * np.uint64(5) + B.mix(B.mix(h[at + 2]))) ^ salt[row[at]]
        order = np.argsort(key)
        ordered = key[order]
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = ordered[1:] == ordered[:-1]
        later = np.flatnonzero(same[1:-1]) + 1
        odd |= _unlike(whole, row, starts, np.concatenate([ends[2:], ends[-1:], ends[-1:]]), at[order[later]], at[order[later - 1]])
        twice = at[order[same[1:] | same[:-1]]]
        for k in range(3):
            covered[twice + k] = True
    out["n_repeat_words"] = B.per_row(row[covered[: len(row)]], n)
    for i in odd:
        out["n_dup_lines"][i], out["n_repeat_words"][i] = _plain_repeats(whole[off[i] : off[i + 1]])
    return out


def band(n_bytes: int) -> tuple[float, float]:
    return next((low, high) for start, low, high in reversed(BANDS) if n_bytes >= start)


def verdict(text: bytes, compress) -> tuple[bool, float, int, int]:
    """Whether the ratios lie in the bands; the whole text's ratio, the chunks judged and those outside their band."""
    if not text:
        return True, 0.0, 0, 0
    ratio = len(compress(text)) / len(text)
    low, high = band(len(text))
    chunks = out = 0
    if len(text) > CHUNK:
        for i in range(0, len(text), CHUNK):
            part = text[i : i + CHUNK]
            if len(part) >= LEAST_CHUNK:
                chunks += 1
                out += not CHUNK_BAND[0] <= len(compress(part)) / len(part) <= CHUNK_BAND[1]
    return low <= ratio <= high and out <= CHUNK_SHARE * chunks, ratio, chunks, out


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    for batch in batches:
        kept_columns = batch.columns[:-1]
        for i, j, data, off in B.slices(batch.column(batch.num_columns - 1), SLICE):
            out = base_counts(data, off)
            words, repeats = out["n_words"], out["n_repeat_words"]
            failed = (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)
            whole = data.tobytes()
            found = [verdict(whole[a:b], compress) for a, b in zip(off[:-1], off[1:], strict=True)]
            ok, ratio, chunks, bad = (np.array(x) for x in zip(*found, strict=True))
            columns = [pa.array(x) for x in (*out.values(), failed, ok & ~failed, ratio, chunks, bad)]
            yield pa.RecordBatch.from_arrays(
                [*(c.slice(i, j - i) for c in kept_columns), *columns],
                names=[*batch.schema.names[:-1], *(f.split()[0] for f in SCHEMA.split(", "))],
            )


def quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its id, the base counts, whether the base rule failed, and whether it is kept.

    No shuffle: every text is judged where it is read.
    """
    rows = docs.select(F.col(id_column), whole_text(text_column).alias("_text"))
    kind = rows.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(_judge, f"{id_column} {kind}, {SCHEMA}")


def fitted_bands(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, margin: float = 0.1) -> list[tuple[int, float, float, int]]:
    """(bytes from, lowest, highest, texts) measured on labelled texts of good quality that the base rule passes: the
    ratios' 1st and 99th hundredth by length class, a tenth wider. At most ``rows`` texts, those of least hash, are used.
    BANDS hold what this gives on the test tables; classes of few texts say little."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id").distinct()
    some = docs.select("doc_id", "text").join(good, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    ratios = quality(some).where("NOT base_failed").select("doc_id", "ratio").join(some.select("doc_id", F.octet_length("text").alias("bytes")), "doc_id")
    starts = F.array(*[F.lit(start) for start, _, _ in BANDS])
    kind = F.array_max(F.filter(starts, lambda x: x <= F.col("bytes")))
    ends = F.percentile("ratio", F.array(F.lit(0.01), F.lit(0.99)))
    found = ratios.groupBy(kind.alias("start")).agg(ends.alias("e"), F.count(F.lit(1)).alias("n")).orderBy("start").collect()  # a row per band
    return [(r["start"], r["e"][0] * (1 - margin), r["e"][1] * (1 + margin), r["n"]) for r in found]


def filter_kept(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    names = docs.columns
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], whole_text(text_column).alias("_text"))
    fields = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    judged = renamed.mapInArrow(_judge, f"{fields}, {SCHEMA}").where("kept")
    return judged.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
