"""Filter interaction audit by mask histograms (operator 13). DataFrame functions only.

Five filters judge whole texts; a document's failures are a five-bit mask. A to D are expressions over the text. E
(the text stands under a smaller doc_id) comes from grouping by text: one row per doc_id holds its text's SHA-256 and
length instead of the text, so texts never move; no two texts with equal SHA-256 are known. Groups are counted
by part before they meet, so a text that fills a third of the table sends one row per task and part.

All figures follow from the counts of 32 masks per part: for an order and a step with filter bit f and earlier filters
``before``, a cell is removed here if it holds f and none of ``before``. A filter is the first of a cell's b failures
in 120 / b of the orders, which sums its removals over all orders exactly.

Defined results: a null text is empty (it fails A only, or also E); a text without words passes B, one without
characters passes C; a null lang is the part ''; a null doc_id neither fails E nor makes others fail it; rows that
share the smallest doc_id all pass E; a document is good or toxic if any label row of its doc_id says so, labels
without a document count nowhere; very long texts are judged whole; extra columns are ignored; no documents, no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdweave.llm.common import whole_text

FILTERS = "ABCDE"
LEAST_WORDS = 100
DISTINCT_PERCENT = 80
CAPITALS_PERCENT = 10
_ORDERS = ["".join(p) for p in permutations(FILTERS)]


def own_failures(text: Column) -> Column:
    """Bits 0 to 3: the failures that the text alone decides."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    # the map hands the list over, so that it is made once
    word_bits = F.transform(F.array(words), lambda w: (
        F.when(F.size(w) < LEAST_WORDS, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)) < DISTINCT_PERCENT * F.size(w), 2).otherwise(0)
    ))[0]
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    return (
        word_bits + F.when(100 * capitals.cast("long") > CAPITALS_PERCENT * F.char_length(text).cast("long"), 4).otherwise(0)
        + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)
    )


def masks(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang") -> DataFrame:
    """part, mask, good, toxic, n: documents of each kind, one text's at a time (several rows may share a kind)."""
    text = whole_text(text_column)
    rows = docs.select(
        F.col(id_column).alias("id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"),
        own_failures(text).cast("int").alias("own"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.octet_length(text).alias("bytes"),
    )
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    # equal rows are counted before they meet the labels
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    by_id = rows.join(marks, "id", "left").fillna(0, ["good", "toxic"])
    by_text = by_id.groupBy("digest", "bytes", "part", "own", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
        F.min("id").alias("least"), F.min_by("n", "id").alias("n_least"),
    )
    first = F.min("least").over(Window.partitionBy("digest", "bytes"))
    passing = F.col("unnamed") + F.when(F.col("least") == first, F.col("n_least")).otherwise(0)
    split = by_text.withColumn("passing", passing).select(
        "part", "good", "toxic",
        F.explode(F.array(
            F.struct(F.col("own").alias("mask"), F.col("passing").alias("n")),
            F.struct((F.col("own") + 16).alias("mask"), (F.col("n") - F.col("passing")).alias("n")),
        )).alias("cell"),
    )
    return split.select("part", "cell.mask", "good", "toxic", "cell.n").where("n > 0")


def cells(kinds: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: the 32 cells of each part that are not empty."""
    return kinds.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def _total(field: str, chosen) -> Column:
    return F.aggregate(F.filter("cells", chosen), F.lit(0).cast("long"), lambda total, cell: total + cell[field])


def orders(counted: DataFrame) -> DataFrame:
    """The audit of all 120 orders, step by step, from each part's cells."""
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    steps = F.array(*[
        F.struct(
            F.lit(order).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(1 << FILTERS.index(letter)).alias("own"),
            F.lit(sum(1 << FILTERS.index(x) for x in order[:i])).alias("before"),
        )
        for order in _ORDERS for i, letter in enumerate(order)
    ])
    rows = parts.withColumn("at", F.explode(steps)).select("part", "cells", "at.*")
    own, before = F.col("own"), F.col("before")

    def fails(cell, bits):
        return cell["mask"].bitwiseAND(bits) != 0

    def here(cell):
        return fails(cell, own) & ~fails(cell, before)

    shares = F.filter("cells", lambda cell: fails(cell, own))
    shapley = F.aggregate(shares, F.lit(0).cast("long"), lambda total, cell: total + cell["n"] * F.floor(F.lit(120) / F.bit_count(cell["mask"])))
    return rows.select(
        "part", "filter_order", "step",
        _total("n", lambda cell: ~fails(cell, own.bitwiseOR(before))).alias("kept"),
        _total("n", here).alias("removed"),
        _total("n", lambda cell: fails(cell, own) & fails(cell, before)).alias("redundant"),
        _total("n", lambda cell: cell["mask"] == own).alias("unique_fails"),
        _total("good", here).alias("good_lost"),
        _total("toxic", here).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang") -> DataFrame:
    """One row per part, filter order and step."""
    return orders(cells(masks(docs, labels, id_column, text_column, part_column)))
