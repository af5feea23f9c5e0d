"""Policy walk: private identities and credentials anywhere in nested records, and in files of several formats.

Records are JSON texts, parsed to VARIANT and walked level by level: an object hands on its values, a list its entries,
a text that is JSON itself is parsed again. A level of ``DEPTH`` nestings is one job; records without anything deeper
drop out, so work follows the nodes there are. Findings name keys and rules, never values.

Rules: a private key whose value is neither null nor '' (``private``); an object with channel_url and display_name but
without vtuber_channel_id (``person``); a secret key with a value, or a text with the shape of a credential (``secret``).
A summary that maps known fields to complete counters is exempt from the first two, its parts are not.

Defined: a record that is no JSON has no findings but those of its own text; a key that is there twice makes a record
unreadable, which ``unreadable`` tells; null records have none.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdweave.sources.shared import written

#: Nestings that one job works through.
DEPTH = 4
#: Fields that identify a viewer, fields of credentials, and shapes of credentials (fixed values).
PRIVATE_FIELDS = (
    "viewer_hash", "raw_channel_id", "raw_author_id", "author_id", "authorDisplayName", "authorChannelUrl", "authorChannelId",
    "authorExternalChannelId", "viewer_id", "commenter_name", "user_key",
)
SECRET_FIELDS = ("private_key", "client_secret", "access_token", "refresh_token", "password", "api_key", "youtube_api_key", "secret_key", "secret_salt")
SECRET_SHAPES = (
    "-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", "AIza[0-9A-Za-z_-]{35}", r"ya29\.[A-Za-z0-9._-]{20,}", "github_pat_[A-Za-z0-9_]{30,}", "gh[pousr]_[A-Za-z0-9]{30,}",
)
#: Fields and counters of a completeness summary (fixed values).
SUMMARY_FIELDS = (
    "viewer_hash", "raw_channel_id", "display_name", "channel_url", "first_seen", "last_seen", "total_interactions", "channels_observed_count",
    "recovery_source", "recovery_status",
)
SUMMARY_COUNTERS = ("TOTAL_ROWS", "NON_EMPTY", "MISSING", "INVALID")
_MAP, _LIST = "map<string,variant>", "array<variant>"


def _as(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _among(key: Column, names) -> Column:
    return key.isin(*names)


def _there(value: Column) -> Column:
    return ~F.to_json(value).isin("null", '""')


def _truthy(of: Column, key: str) -> Column:
    return F.coalesce(~F.to_json(F.try_element_at(of, F.lit(key))).isin("null", '""', "0", "0.0", "false", "[]", "{}"), F.lit(False))


def _counters(value: Column) -> Column:
    """Whether a value is an object of exactly the four counters, whole numbers from 0 on."""
    of = _as(value, _MAP)
    exact = F.size(of) == len(SUMMARY_COUNTERS)
    for key in SUMMARY_COUNTERS:
        counter = F.try_element_at(of, F.lit(key))
        exact = exact & (F.schema_of_variant(counter) == "BIGINT") & ~F.to_json(counter).startswith("-")
    return F.coalesce(exact, F.lit(False))


def has_secret_shape(text: Column) -> Column:
    return F.coalesce(text.rlike("|".join(SECRET_SHAPES)), F.lit(False))


_HITS, _HELD = "array<struct<rule: string, key: string, value: variant>>", "array<variant>"


def _hits() -> Column:
    """What a node (of, text) of one nesting is found to hold, as an array of (rule, key, no value)."""
    of = F.col("of")
    entries = F.map_entries(of)
    summary = (F.size(of) > 0) & F.forall(entries, lambda e: _among(e["key"], SUMMARY_FIELDS) & _counters(e["value"]))
    private = F.filter(entries, lambda e: _among(e["key"], PRIVATE_FIELDS) & _there(e["value"]))
    secret = F.filter(entries, lambda e: _among(F.lower(e["key"]), SECRET_FIELDS) & _there(e["value"]))
    person = _truthy(of, "channel_url") & _truthy(of, "display_name") & ~_truthy(of, "vtuber_channel_id")

    def hit(rule: str, key: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule"), key.alias("key"), F.lit(None).cast("variant").alias("value"))

    def named(rule: str, which: Column) -> Column:
        return F.transform(which, lambda e: hit(rule, e["key"]))

    def one(rule: str, key: str) -> Column:
        return F.array(hit(rule, F.lit(key)))

    none = F.array().cast(_HITS)
    objects = F.concat(
        F.when(summary, none).otherwise(named("private", private)), F.when(~summary & person, one("person", "channel_url")).otherwise(none), named("secret", secret)
    )
    texts = F.when(has_secret_shape(F.col("text")), one("secret", "")).otherwise(none)
    return F.when(of.isNotNull(), objects).otherwise(texts)


def _below(level: DataFrame) -> DataFrame:
    """(id, rule, key, value), one nesting down: values give way to what they are found to hold and to the values in them,
    both from one pass; a text that is JSON holds what it says. What was found before stays."""
    value = F.col("value")
    kinds = level.select("id", "rule", "key", _as(value, _MAP).alias("of"), _as(value, _LIST).alias("entries"), "value")
    text = F.when(F.col("of").isNull() & F.col("entries").isNull() & F.to_json(value).startswith('"'), _as(value, "string"))
    nodes = kinds.select("id", "rule", "key", "of", "entries", text.alias("text"))
    inner = F.when(F.ltrim("text").rlike(r"^[{\[]"), F.array(F.try_parse_json("text")))
    held = F.filter(F.coalesce(F.map_values("of"), F.col("entries"), inner, F.array().cast(_HELD)), lambda v: v.isNotNull())
    values = F.transform(held, lambda v: F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("key"), v.alias("value")))
    same = F.array(F.struct("rule", "key", F.lit(None).cast("variant").alias("value")))
    return nodes.select("id", F.inline(F.when(F.col("rule").isNotNull(), same).otherwise(F.concat(_hits(), values))))


def findings(records: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, rule, key): what the records hold, each once."""
    none = F.lit(None).cast("string")
    top = F.to_variant_object(F.array(F.col(text_column))).alias("value")
    level, found = records.where(F.col(text_column).isNotNull()).select(F.col(id_column).alias("id"), none.alias("rule"), none.alias("key"), top), []
    while True:
        for _ in range(DEPTH):
            level = _below(level)
        table = written(level)
        found.append(table.where("rule IS NOT NULL").select("id", "rule", "key"))
        level = table.where("rule IS NULL")
        if level.isEmpty():
            break
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionAll(part)
    return whole.distinct()


def unreadable(records: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Ids of texts that look like JSON and are none."""
    text = F.col(text_column)
    return records.where(F.ltrim(text).rlike(r"^[{\[]") & F.try_parse_json(text).isNull()).select(F.col(id_column).alias("id"))


def private_keys(records: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Every record with the sorted private keys it holds."""
    held = findings(records, id_column, text_column).where("rule = 'private'").groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    rows = records.select(F.col(id_column).alias("id"))
    return rows.join(held, "id", "left").select(F.col("id").alias(id_column), F.coalesce("keys", F.array().cast("array<string>")).alias("keys"))


def _rows_as_json(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, kind, content) of CSV and Parquet files to (path, record): a JSON text per row, null if it can't be read."""
    import pyarrow.parquet as pq

    for batch in batches:
        for path, kind, content in batch.itertuples(index=False):
            rows: list = []
            try:
                if kind == "csv":
                    rows = list(csv.DictReader(io.StringIO(content.decode("utf-8-sig", "replace"))))
                else:
                    for part in pq.ParquetFile(io.BytesIO(content)).iter_batches(4096):
                        rows += part.to_pylist()
                records = [json.dumps(row, default=str) for row in rows]
            except Exception:  # whatever is wrong with a file of strangers, it is reported as unreadable
                records = [None]
            yield pd.DataFrame({"path": path, "record": pd.Series(records, dtype=object)})


def inspect_files(spark: SparkSession, path: str) -> DataFrame:
    """path, format, class (SECRET_CREDENTIAL, PRIVATE_DATA, PUBLIC_RESEARCH_DATA), readable: every file under a folder.

    The format is told by the first bytes (Parquet, SQLite), then by the name. A file is read by one task as a whole, as
    Spark's ``binaryFile`` does. Databases are not opened: they are not readable, for manual review.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    head = F.substring("content", 1, 15)
    kind = (
        F.when(F.substring(head, 1, 4) == F.lit(b"PAR1"), "parquet").when(head == F.lit(b"SQLite format 3"), "database").when(suffix.isin("duckdb", "sqlite", "sqlite3", "db"), "database")
        .when(suffix.isin("json", "jsonl", "csv"), suffix).when(suffix == "parquet", "parquet").otherwise("text")
    )
    told = files.select("path", kind.alias("kind"), "content")
    text = F.make_valid_utf8(F.col("content").cast("string"))
    plain = told.where("kind IN ('json', 'jsonl', 'text')").select("path", "kind", text.alias("text"))
    lines = F.when(F.col("kind") == "jsonl", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).when(F.col("kind") == "json", F.array("text"))
    single = plain.where("kind <> 'text'").select("path", F.explode(lines).alias("record"))
    tables = told.where("kind IN ('csv', 'parquet')").mapInPandas(_rows_as_json, "path string, record string")
    records = written(single.unionAll(tables))
    held = findings(records, "path", "record").select(F.col("id").alias("path"), F.when(F.col("rule") == "secret", "secret").otherwise("private").alias("what"))
    shaped = told.where("kind <> 'parquet'").where(has_secret_shape(text)).select("path", F.lit("secret").alias("what"))
    embedded = plain.where("kind = 'text'").where(F.col("text").rlike(r"""["']viewer_hash["']\s*:\s*["'][a-f0-9]{64}["']""")).select("path", F.lit("private").alias("what"))
    bad = records.where(F.col("record").isNull() | F.try_parse_json("record").isNull()).select("path", F.lit("unreadable").alias("what"))
    closed = told.where("kind = 'database'").select("path", F.lit("unreadable").alias("what"))
    marks = held.unionAll(shaped).unionAll(embedded).unionAll(bad).unionAll(closed)
    flags = marks.groupBy("path").agg(*[F.bool_or(F.col("what") == w).alias(w) for w in ("secret", "private", "unreadable")])
    named = F.when(F.col("secret"), "SECRET_CREDENTIAL").when(F.col("private") & ~F.col("unreadable"), "PRIVATE_DATA").otherwise("PUBLIC_RESEARCH_DATA")
    return told.select("path", "kind").join(flags, "path", "left").select("path", F.col("kind").alias("format"), named.alias("class"), (~F.coalesce("unreadable", F.lit(False))).alias("readable"))
