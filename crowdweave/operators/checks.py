"""Integrity, parity and batch checks. Every check is a query whose rows are the findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def unknown_references(rows: DataFrame, column: str, target: DataFrame, target_key: str) -> DataFrame:
    """Values of a foreign key that its table does not hold."""
    keys = target.select(F.col(target_key).alias("_key")).distinct()
    return rows.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_key"), "left_anti").groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def orphan_evidence(evidence: DataFrame, subjects: DataFrame) -> DataFrame:
    """Evidence that no subject cites; ``subjects`` has an array column evidence_ids."""
    cited = subjects.select(F.explode("evidence_ids").alias("evidence_id")).distinct()
    return evidence.select("evidence_id").join(cited, "evidence_id", "left_anti")


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, actual) for each table."""
    return reduce(DataFrame.unionByName, [t.agg(F.count(F.lit(1)).alias("actual")).select(F.lit(n).alias("name"), "actual") for n, t in tables.items()])


def parity(tables: dict[str, DataFrame], expected: dict[str, int], exact: bool = False) -> DataFrame:
    """Row counts against a sealed baseline: at least as many, or exactly as many."""
    wanted = F.create_map(*[F.lit(x) for pair in expected.items() for x in pair])
    found = counts(tables).withColumn("expected", wanted[F.col("name")].cast("long"))
    ok = F.col("actual") == F.col("expected") if exact else F.col("actual") >= F.col("expected")
    return found.withColumn("ok", ok)


def fingerprint(parts: list[DataFrame]) -> DataFrame:
    """A short hash over one-row frames (name, value): a coarse gate for re-export."""
    rows = reduce(DataFrame.unionByName, [p.select("name", F.col("value").cast("string")) for p in parts])
    listed = F.array_sort(F.collect_list(F.concat_ws("=", "name", F.coalesce("value", F.lit("")))))
    return rows.agg(F.substring(F.sha2(F.array_join(listed, ";"), 256), 1, 16).alias("fingerprint"))


def content_hash(rows: DataFrame) -> DataFrame:
    """One row: count and an order-insensitive hash of whole rows, for equality of two tables in one pass each."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("hash"))


def batches(rows: DataFrame) -> DataFrame:
    """Validation of batch files (path, row_number, kind, payload): event rows, one state row, one manifest row at the
    end whose payload names the digest and number of the rows before it. One row per path: events, and problem or null.
    """
    listed = F.array_sort(F.collect_list(F.struct("row_number", "kind", "payload")))
    grouped = rows.groupBy("path").agg(listed.alias("r"))
    last = F.element_at("r", -1)
    body = F.expr("slice(r, 1, size(r) - 1)")
    digest = F.sha2(F.array_join(F.transform(body, lambda x: x["payload"]), "\n"), 256)
    manifest = F.from_json(last["payload"], "sha256 string, rows int")
    problem = (
        F.when(F.expr("not forall(transform(r, (x, i) -> x.row_number = i + 1), ok -> ok)"), "rows are not contiguous")
        .when(last["kind"] != "batch_manifest", "no manifest at the end")
        .when(F.size(F.filter("r", lambda x: x["kind"] == "state")) != 1, "not one state row")
        .when(~manifest["rows"].eqNullSafe(F.size("r") - 1), "row count differs")
        .when(~manifest["sha256"].eqNullSafe(digest), "digest differs")
    )
    return grouped.select("path", F.size(F.filter("r", lambda x: x["kind"] == "event")).alias("events"), problem.alias("problem"))


def conflicting(rows: DataFrame, key: list[str], payload: str) -> DataFrame:
    """Keys whose payloads differ between rows."""
    return rows.groupBy(*key).agg(F.countDistinct(payload).alias("versions")).where("versions > 1")


#: Column names that private data may carry and public data may not (fixed values).
PRIVATE_FIELDS = ["viewer_id", "viewer_hash", "author_channel_id", "author_display_name", "viewer_name"]
TEXT_FIELDS = ["comment_text", "message", "message_text", "text_display", "text_original"]
#: Shapes of credentials (fixed values).
SECRETS = [r"AIza[0-9A-Za-z_-]{35}", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"gh[pousr]_[0-9A-Za-z]{36}", r"ya29\.[0-9A-Za-z_-]+"]


def public_columns(df: DataFrame) -> list[str]:
    """Columns of a frame that must not be in a public file."""
    banned = {*PRIVATE_FIELDS, *TEXT_FIELDS}
    return [c for c in df.columns if c.lower() in banned]


def holds_secret(text: Column) -> Column:
    return F.coalesce(text.rlike("|".join(SECRETS)), F.lit(False))
