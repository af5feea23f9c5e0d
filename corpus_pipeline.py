"""From raw documents to packed training sequences, as a chain of operators.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; ``run`` writes
each stage's result as a table in the shared folder and reads it back for the next one.

Defined for every stage: null texts count as empty (quality rules drop them, as texts under 50 words); null ids and
sources are values of their own; repeated rows are copies of each other and one stays; very long texts are worked on
whole; all columns are kept, whatever their names, until packing gives one row per piece; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crowdweave.llm import line_dedup, mixing, near_dup, packing, quality
from crowdweave.llm.common import cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the rules reject go."""
    return quality.filter_kept(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: lines spread over many sites go everywhere but from their first place."""
    return line_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of each class stays."""
    return near_dup.one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the documents in the order of the Pfair schedule."""
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9 along the Pfair schedule: one row per piece, with its sequence and offset; sequences follow the schedule."""
    return packing.pack_scheduled(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Token ids, compression and sketches have no SQL form; a test holds run() against all stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
