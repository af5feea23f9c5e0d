"""Cross-site line dedup by distinct-site spread (operator 2). DataFrame and SQL functions only.

Each map task keeps one HyperLogLog sketch of the sites per line hash; the shuffle merges sketches, so a line of any
frequency sends one row per task. Lines whose estimate lies clearly above ``min_sites`` are boilerplate, those clearly
below are not, and those within the sketch's error of it get exact distinct counts. A boilerplate line stays where it
occurs first (lowest doc_id, then position) and goes from everywhere else, so no text is lost altogether.

Lines are compared without outer spaces; every line that is not empty is judged, whatever its length. Lines and
documents are told by two 64-bit hashes each. Defined results: null texts stay null and have no lines; a null site counts
as the site ''; a null doc_id comes first; rows with equal doc_id and text are treated alike; a very long text is worked
on whole; all columns of ``docs`` are kept whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdweave.llm.common import cut

MIN_SITES = 10
#: 2**LG_K registers: a relative standard error of 1.04 / 2**(LG_K / 2), 1.6 per cent.
LG_K = 12


def _lines(docs: DataFrame, id_column: str, text_column: str, site_column: str) -> DataFrame:
    exploded = docs.select(
        F.col(id_column).alias("id"), F.xxhash64(id_column, text_column).alias("key"), F.xxhash64(F.lit(1), id_column, text_column).alias("also"),
        F.coalesce(F.col(site_column).cast("string"), F.lit("")).alias("site"),
        F.posexplode(F.transform(F.split(text_column, "\n"), F.trim)).alias("pos", "line"),
    )
    return exploded.where(F.col("line") != "").select("id", "key", "also", "site", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """Line hashes (h, g) found on at least ``min_sites`` sites, with the place where each occurs first."""
    error = max(1.0, 3 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    spread = lines.groupBy("h", "g").agg(
        F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min(F.struct("id", "key", "also", "pos")).alias("first")
    )
    spread = spread.withColumn("sites", F.hll_sketch_estimate("sketch")).where(F.col("sites") >= min_sites - error).drop("sketch")
    near = F.col("sites") <= min_sites + error
    # the exact count runs over distinct (line, site) pairs of the few lines near the threshold
    pairs = lines.select("h", "g", "site").join(spread.where(near).select("h", "g"), ["h", "g"], "left_semi")
    exact = pairs.distinct().groupBy("h", "g").agg(F.count(F.lit(1)).alias("exact")).where(F.col("exact") >= min_sites)
    sure = spread.where(~near).select("h", "g", "first")
    return sure.unionByName(spread.where(near).join(exact, ["h", "g"], "left_semi").select("h", "g", "first"))


def line_dedup(
    docs: DataFrame, min_sites: int = MIN_SITES, id_column: str = "doc_id", text_column: str = "text", site_column: str = "source"
) -> DataFrame:
    """All documents with their columns: ``row`` (a struct of them, its text without boilerplate), n_lines, n_removed."""
    lines = _lines(docs, id_column, text_column, site_column)
    # a written table: the join that follows can then split the rows of a very common line over many tasks
    hits = lines.join(cut(boilerplate(lines, min_sites)), ["h", "g"])
    again = ~(hits["first.id"].eqNullSafe(hits["id"]) & (hits["first.key"] == hits["key"]) & (hits["first.also"] == hits["also"]) & (hits["first.pos"] == hits["pos"]))
    # rows with equal doc_id and text share their keys; their positions are the same
    removed = hits.where(again).groupBy(F.col("key").alias("_key"), F.col("also").alias("_also")).agg(F.sort_array(F.collect_set("pos")).alias("_gone"))
    names = docs.columns
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.xxhash64(id_column, text_column).alias("_key"), F.xxhash64(F.lit(1), id_column, text_column).alias("_also"))
    found = base.join(removed, ["_key", "_also"], "left")
    text = F.col("row").getField(text_column)
    split = F.split(text, "\n")
    bounds = F.concat(F.array(F.lit(-1)), F.col("_gone"), F.array(F.size(split)))
    kept = F.flatten(F.transform(
        F.sequence(F.lit(0), F.size("_gone")), lambda j: F.slice(split, bounds[j] + 2, bounds[j + 1] - bounds[j] - 1)
    ))
    new_text = F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(kept, "\n"))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(split))
    return found.select(
        F.col("row").withField(text_column, new_text).alias("row"), n_lines.alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).alias("n_removed"),
    )


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The documents with the columns they came with, boilerplate lines taken out of the text."""
    return line_dedup(docs, **options).select("row.*")
