"""Queries over what is written and committed: batches, gated exports, archives, guarded files, layouts by time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdweave.plans import queries as own
from crowdweave.plans.queries import query
from crowdweave.plans.roles import Roles
from crowdweave.sources import commits, readers
from crowdweave.sources.shared import fresh_folder

_KINDS = ["click", "error", "purchase", "signup", "view"]


@query("", """
    SELECT CAST(dense_rank() OVER (ORDER BY event_type) AS INTEGER) AS sequence, event_id, user_id, event_type FROM events""")
def committed_batches(r: Roles) -> DataFrame:
    """A batch for each type of events, each sent twice: the second time is reconciled."""
    batches = commits.Batches(r.spark, fresh_folder(r.spark))
    rows = r.table("events").select("event_id", "user_id", "event_type")
    for n, kind in enumerate(_KINDS):
        batch = rows.where(F.col("event_type") == kind)
        batches.commit(batch, {"sequence": n + 1, "kind": kind}, n)
        batches.commit(batch.repartition(3), {"sequence": n + 1, "kind": kind}, n)
    return batches.events().select("sequence", "event_id", "user_id", "event_type")


_EXPORTS = {
    "VTUBERS": "vtubers_export", "NETWORK_RESULT": "network_export", "TIKTOK_VERIFIED": "tiktok_export", "TWITCH_VERIFIED": "twitch_export", "ANALYTICS_METRICS": "metrics_export",
}


@query("", " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS \"rows\", true AS skipped_again FROM ({own.ORACLE_SQL[q]})" for name, q in _EXPORTS.items()))
def gated_exports(r: Roles) -> DataFrame:
    """The five deliverables as one generation; with an unchanged fingerprint, nothing is written again."""
    kept = commits.Generations(r.spark, fresh_folder(r.spark))
    tables = {name: own.QUERIES[q](r.spark, r.folder) for name, q in _EXPORTS.items()}
    fingerprint = own.QUERIES["fingerprint_inputs"](r.spark, r.folder)
    kept.write_if_changed(tables, fingerprint)
    again = kept.write_if_changed(tables, fingerprint)["skipped"]
    return reduce(DataFrame.unionByName, [kept.read(n).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows", F.lit(again).alias("skipped_again")) for n in tables])


@query("", """
    SELECT 'customer' AS name, count(*) AS "rows", count(*) AS archived_rows, count(*) FILTER (c_acctbal < 0) = 0 AS ok, CASE WHEN count(*) FILTER (c_acctbal < 0) > 0 THEN 'c_acctbal' ELSE '' END AS differ FROM customer
    UNION ALL SELECT 'nation', count(*), count(*), true, '' FROM nation
    UNION ALL SELECT 'supplier', count(*) FILTER (s_acctbal > 0), count(*), count(*) FILTER (s_acctbal <= 0) = 0,
        CASE WHEN count(*) FILTER (s_acctbal <= 0) > 0 THEN (SELECT string_agg(column_name, ',' ORDER BY column_name) FROM (DESCRIBE supplier)) ELSE '' END FROM supplier""")
def archived_tables(r: Roles) -> DataFrame:
    """Snapshots checked against tables that changed since: debts forgiven, suppliers gone."""
    archive = commits.Archive(r.spark, fresh_folder(r.spark))
    archive.snapshot({name: r.table(name) for name in ("customer", "nation", "supplier")})
    live = {
        "customer": r.table("customer").withColumn("c_acctbal", F.when(F.col("c_acctbal") < 0, 0.0).otherwise(F.col("c_acctbal"))),
        "nation": r.table("nation"), "supplier": r.table("supplier").where("s_acctbal > 0"),
    }
    found = [(n, x["rows"], x["archived_rows"], x["ok"], ",".join(sorted(x["differ"]))) for n, x in archive.verify(live).items()]
    return r.spark.createDataFrame(found, "name string, rows long, archived_rows long, ok boolean, differ string")


@query("", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate >= DATE '1997-06-01'")
def recent_rows(r: Roles) -> DataFrame:
    """Lines laid out by year and time; older years are not opened."""
    path = fresh_folder(r.spark)
    readers.by_time(r.table("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), path, "l_shipdate")
    return readers.since(r.spark, path, "l_shipdate", "1997-06-01").select("l_orderkey", "l_linenumber", "l_shipdate")


#: Rows of a ragged file.
ROWS_A_FILE = 100_000


@query("", """
    WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS p, o_comment AS t FROM (SELECT *, 'a "note", ' || o_orderkey AS o_comment FROM orders))
    SELECT 'row' AS kind, CAST(k AS VARCHAR) AS k, p, CASE WHEN c % 5 = 0 THEN '' ELSE t END AS t FROM o WHERE c % 3 <> 0 AND c % 7 <> 0
    UNION ALL SELECT CASE WHEN c % 3 = 0 THEN 'header' ELSE 'long' END, CAST(k AS VARCHAR), '', '' FROM o WHERE c % 3 = 0 OR c % 7 = 0""")
def guarded_rows(r: Roles) -> DataFrame:
    """Orders as ragged CSV files, a third of them under another header. A file is read by one task, so there are several."""
    path = fresh_folder(r.spark)
    files = 1 + r.table("orders").count() // ROWS_A_FILE
    cell = F.concat(F.lit('"'), F.replace(F.concat(F.lit('a "note", '), "o_orderkey"), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderpriority", F.when(F.col("o_custkey") % 5 != 0, cell))
    line = F.when(F.col("o_custkey") % 7 == 0, F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderpriority", cell, F.lit("more"))).otherwise(line)
    other = F.col("o_custkey") % 3 == 0
    rows = r.table("orders").select(F.when(other, "other").otherwise("good").alias("part"), F.pmod(F.xxhash64("o_orderkey"), F.lit(files)).alias("file"), line.alias("value"))
    heads = r.spark.range(2 * files).select(
        F.when(F.col("id") % 2 == 0, "good").otherwise("other").alias("part"), F.expr("id div 2").alias("file"),
        F.when(F.col("id") % 2 == 0, "key,priority,note").otherwise("priority,key,note").alias("value"),
    )
    # a file of a part is in one partition, its header first
    both = heads.withColumn("n", F.lit(0)).unionByName(rows.withColumn("n", F.lit(1))).repartition("part", "file").sortWithinPartitions("part", "file", "n")
    both.select("part", "file", "value").write.partitionBy("part", "file").text(path)
    good, bad = readers.guarded(r.spark, path, ["key", "priority", "note"])
    key = F.split("raw", ",")[0]
    held = bad.where("raw <> 'priority,key,note'").select(F.col("problem").alias("kind"), key.alias("k"), F.lit("").alias("p"), F.lit("").alias("t"))
    return good.select(F.lit("row").alias("kind"), F.col("key").alias("k"), F.col("priority").alias("p"), F.col("note").alias("t")).unionByName(held)
