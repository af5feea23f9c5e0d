"""Canonical exact digests of documents (operator 4). DataFrame and SQL functions only.

A text is brought to Unicode form NFKC with full case folding, and runs of white space become one space. Its digest is
128 bits of xxhash. Equal digests are not taken on trust: grouping compares the canonical texts themselves, and where
one digest holds several texts, the fingerprint of each gets a part of its SHA-256 as well. An edited text that meets
the digest of another text is told apart in the same way.

Defined results: null texts are empty and equal each other; documents are ordered by doc_id (of any kind that sorts,
nulls first), repeated ids by a hash of the text; the document after the last is the first, so the only document of a
table follows itself; a very long text is folded and hashed whole; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdweave.llm.common import cut, partitions, whole_text

#: Ranges of ids per shuffle partition, for the neighbours' step.
RANGES = 2


def canonical(text: Column) -> Column:
    """NFKC, case folding, NFKC again (folding can leave composed forms), single spaces, none at the ends."""
    compose, fold = F.lit("com.ibm.icu.text.Normalizer"), F.lit("com.ibm.icu.lang.UCharacter")
    yes = F.lit(True)
    folded = F.reflect(fold, F.lit("foldCase"), F.reflect(compose, F.lit("compose"), text, yes), yes)
    normal = F.reflect(compose, F.lit("compose"), folded, yes)
    return F.trim(F.regexp_replace(normal, r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]+", " "))


def digest(canon: Column) -> Column:
    """128 bits of xxhash in hexadecimal."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(4), canon, F.lit(7))), 16, "0")))


def exact_classes(digested: DataFrame) -> DataFrame:
    """(id, digest, canon) to (digest, sha, class_id, copies, canon_sha): one row per canonical text; sha is null where
    the digest holds one text only. Rows with equal digests meet in a bucket, and the bucket is grouped by the texts'
    bytes; copies are counted before the shuffle, so a text of any number of copies sends one row per task."""
    texts = digested.groupBy("digest", "canon").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    texts = cut(texts.select("digest", F.sha2("canon", 256).alias("canon_sha"), "class_id", "copies"))
    several = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("t")).where("t > 1").select("digest", F.lit(True).alias("several"))
    marked = texts.join(several, "digest", "left")
    return cut(marked.select("digest", F.when(F.col("several"), F.col("canon_sha")).alias("sha"), "class_id", "copies", "canon_sha"))


def _range_of(key: Column, edges: list[Column]) -> Column:
    """How many of the sorted edges are at or before the key; whole groups of edges are passed at a time."""
    if not edges:
        return F.lit(0)
    step = math.isqrt(len(edges)) + 1
    groups = edges[step - 1 :: step]
    passed = F.size(F.filter(F.array(*groups), lambda b: b <= key)) if groups else F.lit(0)
    return passed * step + F.size(F.filter(F.slice(F.array(*edges), passed * step + 1, step), lambda b: b <= key))


def neighbours(rows: DataFrame) -> DataFrame:
    """Rows (id, text, digest, and more) with the text and digest of the next row by id; after the last comes the first.

    Rows are cut into ranges by id and hash of the text, so that an id of any kind and with any number of rows is dealt
    out; the first rows of a range are dealt to the range before it as well, so that each range finds its rows'
    successors by itself. Only the ranges' first keys (``RANGES`` per shuffle partition) reach the driver.
    """
    spark = rows.sparkSession
    key = F.struct(F.col("id"), F.xxhash64("text").alias("h"))
    dealt = rows.select(key.alias("key")).repartitionByRange(RANGES * partitions(spark), "key")
    firsts = dealt.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.min("key").alias("first")).orderBy("p").collect()
    kind = rows.schema["id"].dataType
    starts = [F.struct(F.lit(r["first"]["id"]).cast(kind).alias("id"), F.lit(r["first"]["h"]).cast("long").alias("h")) for r in firsts]
    own = _range_of(key, starts[1:])
    # the first key of range i goes to the range before it too
    at_start = F.array_position(F.array(*starts), key) if starts else F.lit(0)
    before = F.pmod(at_start - 2, F.lit(max(len(starts), 1))).cast("int")
    copies = F.filter(F.array(
        F.struct(own.alias("range"), F.lit(False).alias("halo")), F.when(at_start > 0, F.struct(before.alias("range"), F.lit(True).alias("halo")))
    ), lambda x: x.isNotNull())
    dealt = rows.withColumn("at", F.explode(copies)).select(*rows.columns, "at.range", "at.halo")
    order = Window.partitionBy("range").orderBy("halo", F.col("id").asc_nulls_first(), F.xxhash64("text"))
    ahead = dealt.withColumns({"next_text": F.lead("text").over(order), "next_digest": F.lead("digest").over(order)})
    return ahead.where(~F.col("halo")).drop("range", "halo")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    class_id (the lowest doc_id with the same canonical text) and copies.

    The edited text has its last half replaced by the start of the next document. The likeness of two exact digests
    is 1 if the canonical texts are equal, else 0.
    """
    rows = docs.select(F.col(id_column).alias("id"), whole_text(text_column).alias("text"))
    canon = rows.withColumn("canon", canonical(F.col("text"))).withColumn("digest", digest(F.col("canon")))
    known = exact_classes(canon.select("id", "digest", "canon"))
    found = neighbours(canon.select("id", "text", "digest", F.sha2("canon", 256).alias("canon_sha")))
    half = F.expr("length(text) div 2").cast("int")
    edited = F.concat(F.left(F.col("text"), F.length("text") - half), F.left(F.col("next_text"), half))
    found = found.withColumn("edited", edited).withColumn("edited_canon", canonical(F.col("edited")))
    same_next = F.when(F.col("digest") == F.col("next_digest"), canonical(F.col("text")) == canonical(F.col("next_text"))).otherwise(False)
    found = found.withColumn("edited_digest", digest(F.col("edited_canon")))
    same_edited = F.when(F.col("digest") == F.col("edited_digest"), canonical(F.col("text")) == F.col("edited_canon")).otherwise(False)
    light = found.select(
        "id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "digest", "canon_sha",
        "edited_digest", F.sha2("edited_canon", 256).alias("edited_canon_sha"),
        same_edited.cast("double").alias("near_edited"), same_next.cast("double").alias("near_next"),
    )
    return named(light, known).withColumnRenamed("id", id_column)


def named(light: DataFrame, known: DataFrame) -> DataFrame:
    """Digests to fingerprints: a digest that holds several texts, those of ``known`` or an edited one that meets
    another text's digest, is told apart by a part of the text's SHA-256."""
    own = known.select(F.col("digest").alias("_d"), F.col("canon_sha").alias("_c"), "sha", "class_id", "copies")
    joined = light.join(own, (F.col("digest") == F.col("_d")) & (F.col("canon_sha") == F.col("_c")))
    held = known.groupBy(F.col("digest").alias("_e")).agg(F.min("canon_sha").alias("_one"), (F.count(F.lit(1)) > 1).alias("_several"))
    joined = joined.join(held, F.col("edited_digest") == F.col("_e"), "left")

    def name(digest_name: str, sha: Column, marked: Column) -> Column:
        return F.when(marked, F.concat(F.col(digest_name), F.lit("-"), F.left(sha, F.lit(16)))).otherwise(F.col(digest_name))

    return joined.select(
        "id", "n_chars", "edited_sha256",
        name("digest", F.col("canon_sha"), F.col("sha").isNotNull()).alias("fingerprint"),
        name("edited_digest", F.col("edited_canon_sha"), F.col("_several") | (F.col("_one") != F.col("edited_canon_sha"))).alias("edited_fingerprint"),
        "near_edited", "near_next", "class_id", "copies",
    )
