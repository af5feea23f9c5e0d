"""Table changes as joins: insert-if-absent, upsert of supplied columns, diffs, replacement of derived rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_rows(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return numbered.where("_n = 1").drop("_n")


def absent(incoming: DataFrame, existing: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of ``incoming`` to insert: the first of each key, if ``existing`` does not hold the key."""
    return first_rows(incoming, key, order).join(existing.select(*key).distinct(), key, "left_anti")


def upsert(existing: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``existing`` with the columns that ``changes`` supplies set (null: not supplied), and new keys added."""
    old = existing.withColumn("_old", F.lit(True))
    new = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}_new") for c in changes.columns if c != key])
    joined = old.join(new, F.col(key) == F.col("_key"), "full_outer")
    given = set(changes.columns) - {key}
    return joined.select(
        F.coalesce(F.col(key), F.col("_key")).alias(key),
        *[(F.coalesce(F.col(f"_{c}_new"), F.col(c)) if c in given else F.col(c)).alias(c) for c in existing.columns if c != key],
    )


def diff(existing: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """(key, action) for each changed row: added, updated or unchanged; only supplied (non-null) columns are compared."""
    fields = [c for c in changes.columns if c != key]
    old = existing.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}_old") for c in fields])
    joined = changes.join(old, F.col(key) == F.col("_key"), "left")
    same = F.lit(True)
    for c in fields:
        same = same & (F.col(c).isNull() | F.col(c).eqNullSafe(F.col(f"_{c}_old")))
    return joined.select(key, F.when(F.col("_key").isNull(), "added").when(same, "unchanged").otherwise("updated").alias("action"))


def replace_derived(seed: DataFrame, live: DataFrame, key: list[str]) -> DataFrame:
    """Freshly derived rows, and the seed rows whose key they do not have."""
    return seed.join(live.select(*key), key, "left_anti").unionByName(live, allowMissingColumns=True)


def patch_if_empty(existing: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Set columns that are null or '' from the patches."""
    new = patches.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = existing.join(new, F.col(key) == F.col("_key"), "left")
    return joined.select(*[F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in existing.columns])


def absent_by_either(incoming: DataFrame, existing: DataFrame, one: str, other: str) -> DataFrame:
    """Rows whose keys ``one`` and ``other`` are both unknown."""
    known_one = existing.select(one).where(F.col(one).isNotNull()).distinct()
    known_other = existing.select(other).where(F.col(other).isNotNull()).distinct()
    return incoming.join(known_one, one, "left_anti").join(known_other, other, "left_anti")


def retire(rows: DataFrame, backing: DataFrame, key: str) -> DataFrame:
    """Rows without a backing key."""
    return rows.join(backing.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def repoint(links: DataFrame, merges: DataFrame) -> DataFrame:
    """Links (link_id, account_id, persona_id) after merges (loser, keeper): repointed, and rejected where the keeper has
    the account already."""
    moved = links.join(merges, links["persona_id"] == merges["loser"], "left")
    moved = moved.withColumn("target", F.coalesce("keeper", "persona_id"))
    rank = F.row_number().over(Window.partitionBy("account_id", "target").orderBy(F.col("keeper").isNotNull(), "link_id"))
    return moved.withColumn("_n", rank).select("link_id", "account_id", F.col("target").alias("persona_id"), F.when(F.col("_n") > 1, "rejected").when(F.col("keeper").isNotNull(), "repointed").otherwise("kept").alias("state"))
