"""Queries of the intake of candidates, beside their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdweave.operators import intake
from crowdweave.plans.queries import query
from crowdweave.plans.roles import Roles
from crowdweave.plans.text_queries import batch_rows

_TITLES = ["ARP star", "Polygon one", "  pixela  ", "Myriad x", "Virtual Union z", "no agency", "horganice", "LUMINA"]
_TITLE_SQL = "['" + "', '".join(_TITLES) + "']"


@query("", f"""
    WITH d AS (SELECT c_custkey AS k, trim(({_TITLE_SQL})[c_custkey % 8 + 1]) || ' ' || c_custkey AS name FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 11 <> 0)
    SELECT 'UC' || lpad(CAST(k AS VARCHAR), 22, '0') AS channel_id, '@' || regexp_replace(name, '[^a-zA-Z0-9_]', '', 'g') AS handle, name,
        CASE WHEN k % 3 = 0 THEN 0 ELSE k END AS subscriber_count, k * 7 AS view_count, 'directory' AS source, '' AS channel_created_at,
        CASE WHEN k % 2 = 0 THEN '' ELSE '2024-05-01T00:00:00Z' END AS last_published_video_at,
        CASE k % 8 WHEN 0 THEN 'Algorhythm Project' WHEN 1 THEN 'Polygon Official' WHEN 2 THEN 'Pixela Project' WHEN 3 THEN 'Myriad Colors' WHEN 4 THEN 'Virtual Union'
            WHEN 6 THEN 'Horganice' WHEN 7 THEN 'Lumina Live' ELSE 'Independent' END AS agency, k % 5 = 0 AS is_rebranded FROM d""")
def directory_channels_json(r: Roles) -> DataFrame:
    """JSON pages of some hundred channels each; every tenth id is too short and every eleventh missing."""
    k = F.col("c_custkey")
    title = F.concat_ws(" ", F.array(*[F.lit(t) for t in _TITLES])[(k % 8).cast("int")], k)
    title = F.when(k % 8 == 2, F.concat(F.lit(" "), F.regexp_replace(F.trim(title), " +", " "), F.lit("  "))).otherwise(title)
    item = F.struct(
        F.when(k % 11 != 0, F.concat(F.lit("UC"), F.lpad(k.cast("string"), 22, "0").substr(F.lit(1), F.when(k % 10 == 0, 9).otherwise(22)))).alias("channel_id"), title.alias("title"),
        F.when(k % 3 != 0, k).alias("subscribers"), (k * 7).alias("views"), F.when(k % 2 != 0, "2024-05-01T00:00:00Z").alias("last_published_video_at"),
        F.when(k % 5 == 0, True).alias("is_rebranded"),
    )
    pages = r.table("customer").groupBy(F.expr("c_custkey div 100").alias("page")).agg(F.to_json(F.struct(F.collect_list(item).alias("result"))).alias("body"))
    return intake.directory_rows(pages, "directory")


@query("", """
    SELECT 'UC' || c_custkey AS channel_id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '@' || c_custkey END AS handle, c_name AS name,
        CASE c_custkey % 4 WHEN 0 THEN c_custkey WHEN 1 THEN c_custkey + 5 ELSE 0 END AS subscriber_count, CASE WHEN c_custkey % 2 = 0 THEN 'Directory' ELSE 'wiki' END AS source,
        1 AS source_count, '' AS description, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE 'Independent' END AS agency FROM customer""")
def normal_candidates(r: Roles) -> DataFrame:
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    cid = F.concat(F.lit(" UC"), k)
    raw = r.table("customer").select(
        F.when(k % 2 == 0, cid).otherwise("").alias("channel_id"), F.when(k % 2 != 0, cid).alias("id"), F.when(k % 3 != 0, F.concat(F.lit("@"), k, F.lit(" "))).alias("handle"),
        F.when(k % 3 == 0, F.col("c_name")).alias("name"), F.col("c_name").alias("title"), F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 2, "many").alias("subscriber_count"),
        F.when(k % 4 == 1, (k + 5).cast("string")).alias("subscribers"), F.when(k % 2 != 0, "wiki").alias("source"), none.alias("description"),
        F.when(k % 5 == 0, F.col("c_mktsegment")).when(k % 5 == 1, "").alias("agency"),
    )
    return intake.normalized(raw, "Directory")


@query("", """
    WITH k AS (SELECT c_custkey AS k, c_mktsegment <> 'BUILDING' AS d, c_acctbal > 3000 AS w, c_nationkey < 12 AS s FROM customer)
    SELECT 'UC' || lpad(CAST(k AS VARCHAR), 22, '0') AS channel_id, CASE WHEN d THEN 'd' WHEN w THEN 'w' ELSE 's' END || k AS name, '@' || CASE WHEN d THEN 'd' WHEN w THEN 'w' ELSE 's' END AS handle,
        CASE WHEN d AND k % 7 = 0 THEN 'Agency d' WHEN w AND k % 4 = 0 THEN 'Agency w' WHEN s THEN 'Agency s' ELSE 'Independent' END AS agency,
        concat_ws('|', CASE WHEN d THEN 'directory' END, CASE WHEN w THEN 'wiki' END, CASE WHEN s THEN 'Seed List' END) AS sources, w AND k % 9 = 0 AS graduated FROM k WHERE d OR w OR s""")
def registry_merge(r: Roles) -> DataFrame:
    """Three sources that share channels; a row of each has an id that is none."""
    k = F.col("c_custkey")

    def source(letter: str, listed: str, agency) -> DataFrame:
        rows = r.table("customer").where(listed).select(
            F.concat(F.lit("UC"), F.lpad(k.cast("string"), 22, "0")).alias("channel_id"), F.concat(F.lit(letter), k).alias("name"), F.lit("@" + letter).alias("handle"),
            agency.alias("agency"), F.when(F.lit(letter == "w"), k % 9 == 0).alias("graduated"),
        )
        return rows.unionByName(r.spark.range(1).select(F.lit("UCshort").alias("channel_id"), F.lit("n").alias("name"), F.lit("").alias("handle"), F.lit("").alias("agency"), F.lit(True).alias("graduated")))

    directory = source("d", "c_mktsegment <> 'BUILDING'", F.when(k % 7 == 0, "Agency d").otherwise("Independent"))
    wiki = source("w", "c_acctbal > 3000", F.when(k % 4 == 0, "Agency w").otherwise("Independent"))
    merged = intake.merged_registry([("directory", directory), ("wiki", wiki), ("Seed List", source("s", "c_nationkey < 12", F.lit("Agency s")))])
    return merged.withColumn("sources", F.array_join("sources", "|"))


@query("", """
    SELECT 'c' || s_suppkey AS channel_id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN '@old' ELSE '@new' END AS handle, n_name AS agency,
        CASE WHEN s_suppkey % 3 = 0 THEN 'hiatus' ELSE 'active' END AS activity_status, CASE s_suppkey % 4 WHEN 0 THEN NULL ELSE 'CONFIRMED' END AS vtuber_status, 'per' || n_nationkey AS person_id,
        n_name AS canonical_name, CASE WHEN s_suppkey % 2 = 0 THEN 'sub' ELSE 'main' END AS channel_type, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS VARCHAR) END AS subscriber_count,
        CAST(NULL AS VARCHAR) AS country, 'true' AS enabled FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def catalog_flat_rows(r: Roles) -> DataFrame:
    k = F.col("s_suppkey")
    even = F.create_map(F.lit("legacy_handle"), F.lit("@old"), F.lit("channel_type"), F.lit("sub"), F.lit("subscriber_count"), k.cast("string"))
    empty = F.create_map().cast("map<string,string>")
    metadata = F.map_concat(
        F.when(k % 2 == 0, even).otherwise(empty), F.when(k % 3 == 0, F.create_map(F.lit("activity_status"), F.lit("hiatus"))).otherwise(empty),
        F.when(k % 4 == 0, F.create_map(F.lit("vtuber_status"), F.lit(None).cast("string"))).otherwise(empty),
    )
    accounts = r.table("supplier").select(
        F.concat(F.lit("per"), "s_nationkey").alias("persona_id"), F.concat(F.lit("c"), k).alias("platform_id"), F.col("s_name").alias("display_name"), F.lit("@new").alias("handle"), metadata.alias("metadata")
    )
    creators = r.table("nation").select(F.concat(F.lit("per"), "n_nationkey").alias("persona_id"), F.col("n_name").alias("agency"), F.lit("active").alias("lifecycle_status"), F.col("n_name").alias("canonical_name"))
    return intake.catalog_rows(accounts, creators)


@query("", """
    SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN 'name: blank' WHEN 1 THEN 'status: blank' WHEN 2 THEN 'aliases: missing' WHEN 3 THEN 'aliases: blank text' WHEN 4 THEN 'evidence: empty' END AS problem
    FROM customer WHERE c_custkey % 7 < 5""")
def record_contract(r: Roles) -> DataFrame:
    n = F.col("c_custkey") % 7
    rows = r.table("customer").select(
        F.col("c_custkey").alias("id"), F.when(n == 0, " ").otherwise(F.col("c_name")).alias("name"), F.when(n != 1, "open").alias("status"),
        F.when(n == 2, None).when(n == 3, F.array(F.lit("a"), F.lit(" "))).when(n == 5, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"))).alias("aliases"),
        F.when(n == 4, F.array().cast("array<string>")).otherwise(F.array(F.lit("e1"))).alias("evidence"),
    )
    return intake.record_problems(rows, "id", ["name", "status"], ["aliases", "evidence"], ["evidence"])


@query("", """
    SELECT c_custkey AS id, c_custkey % 3 = 0 AS rejected, c_custkey % 4 = 1 AS first_pass FROM customer""")
def notes_and_policies(r: Roles) -> DataFrame:
    k = F.col("c_custkey")
    note = F.when(k % 3 == 0, F.concat("c_name", F.lit(" " + intake.REJECTING_NOTE + "."))).when(k % 3 == 1, F.col("c_name"))
    version = F.when(k % 4 == 1, intake.FIRST_PASS_POLICY).when(k % 4 == 2, "deep-v1")
    job = F.to_json(F.struct(k.alias("id"), version.alias("policy_version")))
    return r.table("customer").select(k.alias("id"), intake.note_rejects(note).alias("rejected"), intake.follows_policy(job).alias("first_pass"))


@query("", """
    SELECT doc_id AS path, CAST(CASE WHEN doc_id % 15 = 0 THEN 2 ELSE 1 END AS BIGINT) AS pseudonyms FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0""")
def pseudonym_leaks(r: Roles) -> DataFrame:
    """Public texts, of which some quote hashes of viewers (once or twice), others a hash of nobody or a longer one."""
    d, at = F.col("doc_id"), F.col("doc_id") % 100
    viewer = F.sha2(F.concat(F.lit("u"), at), 256)
    other = F.sha2(F.concat(F.lit("u"), at + 100), 256)
    nobody = F.sha2(F.concat(F.lit("n"), d), 256)
    text = F.concat_ws(
        " ", F.col("text"), F.when(d % 3 == 0, F.concat(viewer, F.lit(" said "), viewer)), F.when(d % 5 == 0, other), nobody, F.concat(viewer, F.lit("0"))
    )
    private = r.spark.range(200).select(F.sha2(F.concat(F.lit("u"), "id"), 256).alias("viewer_id"))
    return intake.leaked_pseudonyms(r.table("documents").select(d.alias("path"), text.alias("text")), private)


@query("", """
    WITH rows_ AS (
        SELECT conv_id, 'j' || (conv_id // 4 % 40 * 4 + CASE WHEN conv_id % 8 IN (1, 2) THEN 1 ELSE 0 END) AS job, coalesce(text, '') AS payload, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations
    ), jobs AS (
        SELECT job, count(DISTINCT conv_id) AS batches, count(DISTINCT conv_id) FILTER (conv_id % 4 IN (1, 2)) AS faulty,
            arg_max(payload, conv_id) FILTER (n = c) AS state, count(DISTINCT payload) FILTER (n < c) AS seen FROM rows_ GROUP BY 1
    ) SELECT job, batches, faulty, CASE WHEN faulty = 0 THEN state END AS state, CASE WHEN faulty = 0 THEN seen END AS seen FROM jobs""")
def replayed_jobs(r: Roles) -> DataFrame:
    """Conversations as batches of jobs; some jobs have batches whose manifest is wrong."""
    k = F.col("conv_id")
    job = F.concat(F.lit("j"), F.expr("conv_id div 4 % 40 * 4") + F.when((k % 8).isin(1, 2), 1).otherwise(0))
    return intake.replayed(batch_rows(r).select(job.alias("job"), k.alias("sequence"), "row_number", "kind", "payload"))
