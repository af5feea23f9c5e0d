"""Queries of delivered tables, write plans and audits, beside their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdweave.operators import delivery, intake, workflow
from crowdweave.plans.queries import query
from crowdweave.plans.roles import Roles
from crowdweave.sources import readers
from crowdweave.sources.shared import fresh_folder


@query("links personas", """
    WITH a AS (SELECT 'acc' || c_custkey AS id, c_custkey, CASE WHEN c_custkey % 13 <> 0 THEN CAST(c_custkey - c_custkey % 2 AS VARCHAR) ELSE 'x' || c_custkey END AS platform_id, c_name FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING')),
    o AS (SELECT account_id, persona_id, canonical_name FROM links JOIN personas ON personas.id = persona_id WHERE links.review_status = 'verified' AND personas.review_status = 'verified'
        QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY links.id) = 1)
    SELECT platform_id, '@H' || c_custkey AS handle, coalesce(canonical_name, c_name) AS name, persona_id, id AS account_id FROM a JOIN o ON account_id = id
    WHERE platform_id NOT LIKE 'x%' AND platform_id NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier) QUALIFY row_number() OVER (PARTITION BY platform_id ORDER BY id) = 1""")
def delivery_appends(r: Roles) -> DataFrame:
    """Accounts of owned channels, two with one id here and there, against a table that has some of them."""
    key = F.col("c_custkey")
    own = F.when(key % 13 != 0, (key - key % 2).cast("string")).otherwise(F.concat(F.lit("x"), key))
    accounts = r.table("customer").select(
        F.concat(F.lit("acc"), key).alias("id"), F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING"), "twitch").otherwise("x").alias("platform"), own.alias("platform_id"),
        F.concat(F.lit("@H"), key).alias("handle"), F.col("c_name").alias("name"),
    )
    return delivery.new_rows(accounts, r.links, r.personas, r.table("supplier").select(F.col("s_suppkey").cast("string").alias("platform_id")), "twitch")


@query("personas", """
    SELECT CAST(c_custkey AS VARCHAR) AS platform_id, 'Old' || (c_custkey % 97) AS old_name, canonical_name AS new_name FROM customer JOIN personas ON id = 'per' || (c_custkey % 97)
    WHERE c_acctbal > 0 AND canonical_name IS NOT NULL AND review_status <> 'pending'""")
def delivery_names(r: Roles) -> DataFrame:
    """Rows that show earlier names of their personas, and rows that do not."""
    number = F.substring("id", 4, 20)
    note = F.when(F.col("review_status") == "verified", F.concat(F.lit("renamed_from_slug=Old"), number, F.lit("; x"))).when(F.col("review_status") == "rejected", F.concat(F.lit("renamed_from=Old"), number, F.lit(" (2020)")))
    delivered = r.table("customer").select(
        F.col("c_custkey").cast("string").alias("platform_id"), F.concat(F.lit("per"), F.col("c_custkey") % 97).alias("persona_id"),
        F.when(F.col("c_acctbal") > 0, F.concat(F.lit("Old"), F.col("c_custkey") % 97)).otherwise(F.col("c_name")).alias("name"),
    )
    return delivery.name_updates(delivered, r.personas.withColumn("notes", note))


@query("", """
    WITH f AS (
        SELECT 'd' || o_orderkey AS d, o_orderkey AS k, o_custkey AS c, o_orderpriority AS p, o_orderstatus AS s, o_orderkey % 5 = 0 AS ch FROM orders
    ), rows AS (
        SELECT d, k, c, p, s, CASE WHEN ch THEN 'youtube' ELSE 'twitch' END AS platform, CASE WHEN ch THEN 'UC' || c WHEN k % 3 = 0 THEN CAST(c AS VARCHAR) ELSE '' END AS pid, 'h' || c AS handle,
            CASE WHEN ch THEN 'https://www.youtube.com/channel/UC' || c WHEN k % 2 = 0 THEN 'https://www.twitch.tv/H' || c ELSE '' END AS url FROM f
    ), conf AS (
        SELECT *, 'persona_' || substr(sha256('found:' || d), 1, 20) AS persona, 'acct_' || substr(sha256('found-account:' || platform || ':' || coalesce(nullif(pid, ''), lower(url))), 1, 20) AS account FROM rows WHERE p = '1-URGENT'
    ), taken AS (SELECT 'persona_' || substr(sha256('found:d' || o_orderkey), 1, 20) AS id FROM orders WHERE o_totalprice > 250000)
    SELECT 'personas' AS target, persona AS id, CASE WHEN s = 'F' THEN 'N' || c ELSE handle END AS detail FROM conf WHERE persona NOT IN (SELECT id FROM taken)
    UNION ALL SELECT DISTINCT 'accounts', account, platform || ':' || coalesce(nullif(pid, ''), lower(url)) FROM conf WHERE persona NOT IN (SELECT id FROM taken)
    UNION ALL SELECT DISTINCT 'links', 'link_' || substr(sha256(account || ':' || persona), 1, 20), account || '>' || persona FROM conf WHERE persona NOT IN (SELECT id FROM taken)
    UNION ALL SELECT 'reviews', 'rq_' || substr(sha256(d || ':id_collision'), 1, 20), 'id_collision' FROM conf WHERE persona IN (SELECT id FROM taken)
    UNION ALL SELECT 'reviews', 'rq_' || substr(sha256(d || ':human_negative'), 1, 20), 'human_negative' FROM rows WHERE p = '2-HIGH'
    UNION ALL SELECT 'reviews', 'rq_' || substr(sha256(d || ':several_accounts'), 1, 20), 'several_accounts' FROM rows WHERE p = '3-MEDIUM'
    UNION ALL SELECT 'inbox', d, CASE WHEN pid <> '' OR url <> '' THEN 'pending_review' ELSE 'unresolved_platform_id' END FROM rows WHERE p = '5-LOW' AND k % 11 <> 0
        AND platform || ':' || coalesce(nullif(pid, ''), handle) NOT IN (SELECT 'twitch:h' || c_custkey FROM customer WHERE c_acctbal < 0)""")
def reconciled_writes(r: Roles) -> DataFrame:
    """Orders as classified finds; some ids, some inbox entries and some handles are known already."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    bucket = F.create_map(*[F.lit(x) for pair in {
        "1-URGENT": "NEW_CONFIRMED_PERSONA", "2-HIGH": "HUMAN_NEGATIVE", "3-MEDIUM": "CONFLICT", "4-NOT SPECIFIED": "EXISTS_ALREADY", "5-LOW": "UNRESOLVED_CANDIDATE",
    }.items() for x in pair])
    find = F.concat(F.lit("d"), key)
    rows = r.table("orders").select(
        find.alias("discovery_id"), bucket[F.col("o_orderpriority")].alias("bucket"), F.when(F.col("o_orderpriority") == "3-MEDIUM", "several_accounts").alias("reason"), F.lit("twitch").alias("platform"),
        F.when(key % 3 == 0, customer.cast("string")).alias("platform_id"), F.concat(F.lit("h"), customer).alias("handle"), F.when(key % 2 == 0, F.concat(F.lit("https://www.twitch.tv/H"), customer)).alias("url"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("N"), customer)).alias("name"), F.when(key % 5 == 0, F.concat(F.lit("UC"), customer)).alias("channel_id"),
    )
    taken = r.table("orders").where("o_totalprice > 250000").select(delivery._id("persona", "found", find).alias("id"))
    none = r.spark.createDataFrame([], "id string")
    old = r.table("orders").where("o_orderkey % 11 = 0").select(find.alias("id"), F.lit("x").alias("platform"), find.alias("platform_id"), F.lit("").alias("handle"))
    debts = r.table("customer").where("c_acctbal < 0").select(F.concat(F.lit("i"), "c_custkey").alias("id"), F.lit("twitch").alias("platform"), F.lit("").alias("platform_id"), F.concat(F.lit("@H"), "c_custkey").alias("handle"))
    return delivery.write_plan(rows, {"personas": taken, "accounts": none, "links": none, "reviews": none, "inbox": old.unionByName(debts)})


@query("", """
    WITH shaped AS (SELECT doc_id, regexp_matches(text, '-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----|AIza[0-9A-Za-z_-]{35}|ya29\\.[A-Za-z0-9._-]{20,}|github_pat_[A-Za-z0-9_]{30,}|gh[pousr]_[A-Za-z0-9]{30,}') AS s FROM documents), f AS (
        SELECT 'CUSTOMERS' AS place, 'INFO' AS status, 'rows' AS reason, count(*) AS count FROM customer UNION ALL SELECT 'DOCUMENTS', 'INFO', 'rows', count(*) FROM documents
        UNION ALL SELECT 'DOCUMENTS', 'FAIL', 'message_column', 1 UNION ALL SELECT 'DOCUMENTS', 'WARNING', 'unregistered_table', 1 UNION ALL SELECT 'DOCUMENTS', 'FAIL', 'secret_value', count(*) FILTER (s) FROM shaped
        UNION ALL SELECT 'NATIONS', 'FAIL', 'secret_column', 1 UNION ALL SELECT 'NATIONS', 'INFO', 'rows', count(*) FROM nation
        UNION ALL SELECT 'page' || s_suppkey, 'FAIL', 'pseudonym_in_public', 1 FROM supplier JOIN customer ON c_custkey = s_suppkey WHERE c_acctbal > 0
    ) SELECT * FROM f WHERE reason = 'rows' OR count > 0""")
def private_plane(r: Roles) -> DataFrame:
    """Private tables with message texts, credentials and pseudonyms, and public pages that hold some of those."""
    def hashed(key: str):
        return F.sha2(F.col(key).cast("string"), 256)

    tables = {
        "CUSTOMERS": r.table("customer").select(hashed("c_custkey").alias("viewer_id"), "c_name").where("c_acctbal > 0").unionByName(
            r.table("customer").where("c_acctbal <= 0").select(F.lit("").alias("viewer_id"), "c_name")),
        "DOCUMENTS": r.table("documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text"),
        "NATIONS": r.table("nation").select(F.col("n_name").alias("Password"), F.lit("").alias("n")),
    }
    public = r.table("supplier").select(F.concat(F.lit("page"), "s_suppkey").alias("path"), F.concat(F.lit("<p>"), hashed("s_suppkey"), F.lit("</p>")).alias("text"))
    return delivery.private_audit(tables, {"CUSTOMERS", "NATIONS"}, public)


#: An array is read by one task, so that seeds come in several files.
SEEDS_A_FILE = 4096


@query("", """
    SELECT 'UC' || s_suppkey AS channel_id, '@h' || s_suppkey AS handle, s_name AS name, CASE WHEN s_acctbal > 0 THEN CAST(round(s_acctbal) AS BIGINT) ELSE 0 END AS subscriber_count,
        CASE WHEN s_nationkey % 2 = 0 THEN 'Seed List' ELSE 'own' END AS source, 1 AS source_count, '' AS description, 'Independent' AS agency FROM supplier WHERE s_nationkey <> 7""")
def seed_candidates(r: Roles) -> DataFrame:
    """Files of seeds, each a JSON array of some thousands, read and brought into the form of candidates."""
    path = fresh_folder(r.spark)
    files = 1 + r.table("supplier").count() // SEEDS_A_FILE
    rows = r.table("supplier").where("s_nationkey <> 7").select(
        F.pmod(F.xxhash64("s_suppkey"), F.lit(files)).alias("file"),
        F.concat(F.lit(" UC"), "s_suppkey").alias("channel_id"), F.concat(F.lit("@h"), "s_suppkey").alias("handle"), F.col("s_name").alias("name"),
        F.when(F.col("s_acctbal") > 0, F.round("s_acctbal").cast("long")).alias("subscriber_count"), F.when(F.col("s_nationkey") % 2 == 1, "own").alias("source"),
    )
    arrays = rows.groupBy("file").agg(F.to_json(F.collect_list(F.struct(*[c for c in rows.columns if c != "file"]))).alias("value"))
    arrays.write.partitionBy("file").text(path)
    return intake.normalized(readers.seeds(r.spark, path), "Seed List")


@query("", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'")
def fetched_rows(r: Roles) -> DataFrame:
    """Rows by equal values of several columns."""
    return readers.fetch(r.table("orders"), o_orderstatus="F", o_orderpriority="2-HIGH").select("o_orderkey", "o_custkey")


@query("", """
    SELECT d.doc_id, CASE WHEN trim(coalesce(source, '')) = '' THEN 'source: blank' WHEN quality IS NULL THEN 'tags: missing' WHEN quality <> 1 AND toxic <> 1 THEN 'tags: empty'
        WHEN quality = 1 AND n_chars < 1000 THEN 'tags: blank text' END AS problem FROM documents AS d LEFT JOIN labels USING (doc_id)
    WHERE trim(coalesce(source, '')) = '' OR quality IS NULL OR (quality <> 1 AND toxic <> 1) OR (quality = 1 AND n_chars < 1000)""")
def document_contract(r: Roles) -> DataFrame:
    """Documents as records: a source, and tags from their labels, which are missing, empty or blank for some."""
    docs = r.table("documents").join(r.table("labels"), "doc_id", "left")
    good = F.when(F.col("quality") == 1, F.when(F.col("n_chars") < 1000, " ").otherwise("good"))
    tags = F.when(F.col("quality").isNotNull(), F.array_compact(F.array(good, F.when(F.col("toxic") == 1, "toxic"))))
    return intake.record_problems(docs.select("doc_id", "source", tags.alias("tags")), "doc_id", ["source"], ["tags"], ["tags"])


@query("", """
    WITH o AS (SELECT o_custkey AS id, min(o_orderdate) AS a, max(o_orderdate) AS b, bool_or(o_orderstatus = 'P') AS p FROM orders GROUP BY 1),
    old AS (SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 THEN strftime(a, '%Y-%m-%d') END AS started_at, c_mktsegment AS state FROM customer JOIN o ON id = c_custkey WHERE p),
    new AS (SELECT id, strftime(b, '%Y-%m-%d') AS started_at, CASE WHEN c_nationkey < 12 THEN c_name END AS state FROM o JOIN customer ON c_custkey = id WHERE a > DATE '1992-03-01')
    SELECT coalesce(old.id, new.id) AS id, coalesce(old.started_at, new.started_at) AS started_at, coalesce(new.state, old.state) AS state FROM old FULL JOIN new ON old.id = new.id""")
def kept_starts(r: Roles) -> DataFrame:
    """Customers' first orders stay as their start, where there is one; their state follows the newest."""
    def day(c: str):
        return F.date_format(c, "yyyy-MM-dd")

    spans = r.table("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"), F.bool_or(F.col("o_orderstatus") == "P").alias("p"))
    joined = spans.join(r.table("customer"), F.col("id") == F.col("c_custkey"))
    old = joined.where("p").select("id", F.when(F.col("c_acctbal") > 0, day("a")).alias("started_at"), F.col("c_mktsegment").alias("state"))
    new = joined.where("a > DATE '1992-03-01'").select("id", day("b").alias("started_at"), F.when(F.col("c_nationkey") < 12, F.col("c_name")).alias("state"))
    return workflow.keep_first(old, new, "id", ["started_at"])


@query("", """
    SELECT lower(c_mktsegment) AS table_name, CASE WHEN c_acctbal >= 0 THEN c_name ELSE '' END AS id, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'unknown_table' ELSE 'no_id' END AS problem
    FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') OR c_acctbal < 0""")
def change_rows(r: Roles) -> DataFrame:
    """Customers as change rows; their segment names the table, those in debt have no id."""
    rows = r.table("customer").select(F.lower("c_mktsegment").alias("table_name"), F.when(F.col("c_acctbal") >= 0, F.col("c_name")).otherwise("").alias("id"))
    return workflow.change_problems(rows, ["building", "machinery"])


@query("", """
    SELECT d.doc_id, coalesce(quality = 0, false) AS rejected, n_chars % 2 = 0 AS follows FROM documents AS d LEFT JOIN labels USING (doc_id)""")
def label_notes(r: Roles) -> DataFrame:
    """Notes written for labels, and jobs under the current policy and an older one."""
    docs = r.table("documents").join(r.table("labels"), "doc_id", "left")
    note = F.concat("lang", F.when(F.col("quality") == 0, F.concat(F.lit(" "), F.lit(intake.REJECTING_NOTE), F.lit("."))).otherwise(" seen"))
    job = F.to_json(F.struct(F.col("doc_id"), F.when(F.col("n_chars") % 2 == 0, intake.FIRST_PASS_POLICY).otherwise("older").alias("policy_version")))
    return docs.select("doc_id", intake.note_rejects(note).alias("rejected"), intake.follows_policy(job).alias("follows"))
