"""Queries of the canonical mapping, beside their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdweave.operators import mapping
from crowdweave.plans.queries import query
from crowdweave.plans.roles import Roles

_OLD = """
    old AS (
        SELECT 'acc' || c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'youtube' WHEN 1 THEN 'x' WHEN 2 THEN 'twitch' ELSE 'mixer' END AS platform,
            CAST(CASE WHEN c_custkey % 5 = 0 THEN c_custkey - c_custkey % 8 ELSE c_custkey END AS VARCHAR) AS platform_id,
            CASE WHEN c_custkey % 7 <> 0 THEN '@H' || c_custkey END AS handle, CASE WHEN c_custkey % 6 = 0 THEN 'handle' ELSE 'id' END AS id_namespace,
            CASE WHEN c_custkey % 9 <> 0 THEN 'https://example.org/' || c_custkey END AS url FROM customer
    ), told AS (
        SELECT account_id, count(*) FILTER (review_status = 'verified') AS yes, count(*) FILTER (review_status = 'rejected') AS no, count(*) AS n,
            count(DISTINCT persona_id) FILTER (review_status <> 'rejected' AND reviewed_at IS NOT NULL) AS personas FROM links GROUP BY 1
    ), canon AS (
        SELECT id, CASE WHEN platform = 'mixer' THEN 'other' ELSE platform END AS platform, CASE WHEN id_namespace = 'handle' THEN '' ELSE platform_id END AS platform_id,
            coalesce(handle, '') AS handle, CASE WHEN personas > 0 THEN 'persona' ELSE 'unknown' END AS account_type,
            CASE WHEN yes > 0 THEN 'verified' WHEN no = n THEN 'rejected' ELSE 'pending' END AS review_status FROM old LEFT JOIN told ON account_id = id
    )"""


def _old_accounts(r: Roles) -> DataFrame:
    n = F.col("c_custkey")
    return r.table("customer").select(
        F.concat(F.lit("acc"), n).alias("id"), F.element_at(F.array(*map(F.lit, ["youtube", "x", "twitch", "mixer"])), (n % 4 + 1).cast("int")).alias("platform"),
        F.when(n % 5 == 0, n - n % 8).otherwise(n).cast("string").alias("platform_id"), F.when(n % 7 != 0, F.concat(F.lit("@H"), n)).alias("handle"),
        F.when(n % 6 == 0, "handle").otherwise("id").alias("id_namespace"), F.when(n % 9 != 0, F.concat(F.lit("https://example.org/"), n)).alias("url"),
    )


def _old_links(r: Roles) -> DataFrame:
    """Links that nobody dated are over."""
    return r.links.withColumn("valid_to", F.when(F.col("reviewed_at").isNull(), "2024-01-01"))


@query("links", f"WITH {_OLD} SELECT * FROM canon")
def mapped_accounts(r: Roles) -> DataFrame:
    return mapping.canonical_accounts(_old_accounts(r), _old_links(r))


@query("affiliations", """
    SELECT 'org_' || substr(sha256(lower(organization)), 1, 20) AS id,
        min_by(CASE WHEN substr(persona_id, 4)::BIGINT % 2 = 0 THEN lower(organization) ELSE organization END, id) AS name
    FROM affiliations WHERE substr(persona_id, 4)::BIGINT % 11 <> 0 GROUP BY 1""")
def mapped_organizations(r: Roles) -> DataFrame:
    """Names in two spellings, and blank ones."""
    n = F.substring("persona_id", 4, 20).cast("long")
    spelled = F.when(n % 11 == 0, " ").when(n % 2 == 0, F.concat(F.lit(" "), F.lower("organization"))).otherwise(F.col("organization"))
    return mapping.canonical_organizations(r.affiliations.withColumn("organization", spelled))


@query("personas", """
    WITH e AS (
        SELECT o_orderkey AS k, 'per' || (o_orderkey % 97) AS id, CASE o_orderkey % 3 WHEN 0 THEN 'debut' WHEN 1 THEN 'graduation' ELSE 'rebrand' END AS t,
            strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 9 <> 0 AND o_custkey % 20 = 0
    ), f AS (SELECT id, max_by(d, k) FILTER (t = 'debut') AS debut, max_by(d, k) FILTER (t = 'graduation') AS graduation FROM e GROUP BY 1)
    SELECT id, CASE substr(id, 4)::BIGINT % 3 WHEN 0 THEN 'pngtuber' WHEN 1 THEN 'mixed' END AS persona_type, coalesce(debut, '') AS debut_date,
        coalesce(graduation, '') AS graduation_date, CASE WHEN graduation IS NULL THEN '' ELSE 'graduated' END AS status FROM personas LEFT JOIN f USING (id)""")
def mapped_personas(r: Roles) -> DataFrame:
    k = F.col("o_orderkey")
    events = r.table("orders").where("o_custkey % 20 = 0").select(
        k.alias("event_id"), F.concat(F.lit("per"), k % 97).alias("persona_id"), F.when(k % 3 == 0, "debut").when(k % 3 == 1, "graduation").otherwise("rebrand").alias("event_type"),
        F.when(k % 9 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("event_date"), F.when(F.col("o_orderstatus") == "F", "verified").otherwise("pending").alias("review_status"),
    )
    form = F.element_at(F.array(*map(F.lit, ["png", "mixed", "3D"])), (F.substring("id", 4, 20).cast("long") % 3 + 1).cast("int"))
    return mapping.canonical_personas(r.personas.withColumn("format", form), events)


@query("links legacy", f"""
    WITH {_OLD}, found AS (
        SELECT id, account_id AS entity_id, CASE WHEN source_agency = '' THEN 'legacy_review' ELSE source_agency END AS reason, 'P2' AS priority,
            CASE WHEN source_checked_at < '1995' THEN 'closed' ELSE 'open' END AS status FROM legacy
        UNION ALL SELECT 'rq_can' || s_suppkey, CASE WHEN s_suppkey % 3 = 1 THEN 'can' || s_suppkey ELSE 'lost' || s_suppkey END, 'no_account', 'P2', 'open'
            FROM supplier WHERE (s_suppkey % 3 <> 0 OR 'acc' || s_suppkey NOT IN (SELECT id FROM old))
            AND (s_suppkey % 2 = 0 OR 'https://example.org/' || s_suppkey NOT IN (SELECT url FROM old WHERE url IS NOT NULL))
        UNION ALL SELECT 'rq_platform_' || id, id, 'unknown_platform', 'P3', 'open' FROM old WHERE platform = 'mixer'
        UNION ALL SELECT 'rq_personas_' || account_id, account_id, 'several_personas', 'P1', 'open' FROM told WHERE personas > 1
        UNION ALL SELECT 'rq_twice_' || substr(sha256(platform || ':' || platform_id), 1, 16), min(id), 'platform_id_twice', 'P1', 'open'
            FROM canon WHERE platform_id <> '' GROUP BY platform, platform_id HAVING count(*) > 1
    ) SELECT * FROM found""")
def mapped_queue(r: Roles) -> DataFrame:
    """Every older review comes twice."""
    n = F.col("s_suppkey")
    candidates = r.table("supplier").select(
        F.concat(F.lit("can"), n).alias("id"), F.when(n % 3 == 0, F.concat(F.lit("acc"), n)).when(n % 3 == 2, F.concat(F.lit("lost"), n)).alias("account_id"),
        F.when(n % 2 == 1, F.concat(F.lit("https://example.org/"), n)).otherwise("").alias("url"),
    )
    state = F.when(F.col("source_checked_at") < "1995", "resolved").otherwise("open")
    reviews = r.legacy.select("id", "account_id", F.col("source_agency").alias("reason"), state.alias("status"))
    return mapping.canonical_queue(_old_accounts(r), _old_links(r), reviews.unionByName(reviews), candidates)


@query("personas", """
    SELECT agency, CAST(sum(n) AS BIGINT) AS channels, count(*) FILTER (n > 1 AND person IS NOT NULL) AS several FROM (
        SELECT coalesce(CASE WHEN c_nationkey % 5 <> 0 THEN 'agency' || c_nationkey END, 'Independent') AS agency,
            CASE WHEN c_custkey % 10 <> 0 THEN c_custkey % 300 END AS person, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1""")
def agencies_by_channels(r: Roles) -> DataFrame:
    n, agency = F.col("c_custkey"), F.when(F.col("c_nationkey") % 5 != 0, F.concat(F.lit("agency"), "c_nationkey"))
    return mapping.agencies(r.table("customer").select(agency.alias("agency"), F.when(n % 10 != 0, n % 300).alias("person_id")))


@query("accounts", """
    SELECT 'acc' || c_custkey AS id, 'persona_' || substr(sha256(lower(c_name) || ' x'), 1, 20) AS persona_id,
        'account_' || substr(sha256(CASE WHEN c_custkey % 2 = 0 THEN 'x:' ELSE 'youtube:' END || CASE WHEN c_custkey % 3 = 0 THEN 'https://example.org/' || c_custkey ELSE 'id' || c_custkey END), 1, 20) AS account_id
    FROM customer""")
def stable_ids(r: Roles) -> DataFrame:
    n = F.col("c_custkey")
    platform, own = F.when(n % 2 == 0, " Twitter").otherwise("YouTube"), F.when(n % 3 == 0, "  ").otherwise(F.concat(F.lit(" id"), n))
    return r.table("customer").select(
        F.concat(F.lit("acc"), n).alias("id"), mapping.stable_id("persona", F.concat(F.lit("  "), F.upper("c_name"), F.lit(" \t\n X "))).alias("persona_id"),
        mapping.account_id(platform, own, F.concat(F.lit("https://example.org/"), n)).alias("account_id"),
    )


def _dated_links(r: Roles) -> DataFrame:
    """Links with reviewers, spans and evidence, from their orders; some states are none that the mapping knows."""
    key = F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "F", "verified").when(F.col("o_orderpriority") == "5-LOW", "odd").otherwise("rejected")
    return r.table("orders").select(
        F.concat(F.lit("lnk"), key).alias("id"), F.concat(F.lit("acc"), F.col("o_custkey")).alias("account_id"), F.concat(F.lit("per"), key % 97).alias("persona_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("valid_from"), F.when(F.col("o_totalprice") < 60000, "2024-01-01").alias("valid_to"),
        F.concat(F.lit("ev"), F.col("o_custkey")).alias("evidence_id"), state.alias("review_status"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("reviewer"), F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("reviewed_at"),
    )


def _evidence(r: Roles) -> DataFrame:
    """Evidence for customers that are not in debt."""
    return r.table("customer").where("c_acctbal >= 0").select(F.concat(F.lit("ev"), "c_custkey").alias("id"), F.concat(F.lit("https://example.org/e/"), "c_custkey").alias("url"))


@query("", """
    SELECT 'lnk' || o_orderkey AS id, 'per' || (o_orderkey % 97) AS persona_id, 'acc' || o_custkey AS account_id, CASE WHEN o_totalprice < 60000 THEN 'former' ELSE 'official' END AS link_type,
        strftime(o_orderdate, '%Y-%m-%d') AS valid_from, CASE WHEN o_totalprice < 60000 THEN '2024-01-01' ELSE '' END AS valid_to,
        coalesce('https://example.org/e/' || c_custkey, '') AS source_url, CASE WHEN o_orderstatus = 'F' THEN 'verified' WHEN o_orderpriority = '5-LOW' THEN 'pending' ELSE 'rejected' END AS review_status,
        CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '' END AS reviewer, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS reviewed_at
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal >= 0""")
def mapped_links(r: Roles) -> DataFrame:
    return mapping.canonical_links(_dated_links(r), _evidence(r))


@query("", """
    SELECT 'aff' || c_custkey AS id, 'per' || (c_custkey % 97) AS persona_id, CASE WHEN trim(c_mktsegment) = 'MACHINERY' THEN '' ELSE 'org_' || substr(sha256(lower(c_mktsegment)), 1, 20) END AS organization_id,
        'talent' AS role, '' AS valid_from, '' AS valid_to, CASE WHEN c_acctbal >= 0 THEN 'https://example.org/e/' || c_custkey ELSE '' END AS source_url,
        CASE WHEN c_acctbal > 5000 THEN 'verified' ELSE 'pending' END AS review_status, '' AS reviewer, '' AS reviewed_at FROM customer""")
def mapped_affiliations(r: Roles) -> DataFrame:
    """Segments as organizations, in two spellings, one of them blank."""
    name = F.when(F.col("c_mktsegment") == "MACHINERY", "  ").when(F.col("c_acctbal") > 0, F.concat(F.lit(" "), F.lower("c_mktsegment"))).otherwise(F.col("c_mktsegment"))
    none = F.lit(None).cast("string")
    rows = r.table("customer").select(
        F.concat(F.lit("aff"), "c_custkey").alias("id"), F.concat(F.lit("per"), F.col("c_custkey") % 97).alias("persona_id"), name.alias("organization"),
        none.alias("valid_from"), none.alias("valid_to"), F.concat(F.lit("ev"), "c_custkey").alias("evidence_id"),
        F.when(F.col("c_acctbal") > 5000, "verified").otherwise("unknown").alias("review_status"), none.alias("reviewer"), none.alias("reviewed_at"),
    )
    return mapping.canonical_affiliations(rows, _evidence(r))


@query("", """
    SELECT 'e' || event_id AS id, 'per' || user_id AS persona_id, CASE event_type WHEN 'signup' THEN 'debut' WHEN 'error' THEN 'graduation' WHEN 'purchase' THEN 'rebrand' ELSE 'other' END AS event_type,
        strftime(ts, '%Y-%m-%d') AS event_date, coalesce('https://example.org/e/' || c_custkey, '') AS source_url, CASE WHEN value > 50 THEN 'verified' ELSE 'pending' END AS review_status
    FROM events LEFT JOIN customer ON c_custkey = user_id AND c_acctbal >= 0""")
def mapped_events(r: Roles) -> DataFrame:
    kinds = F.when(F.col("event_type") == "signup", "debut").when(F.col("event_type") == "error", "graduation").when(F.col("event_type") == "purchase", "rebrand").when(F.col("event_type") == "view", "seen")
    rows = r.table("events").select(
        F.concat(F.lit("e"), "event_id").alias("event_id"), F.concat(F.lit("per"), "user_id").alias("persona_id"), kinds.alias("event_type"),
        F.date_format("ts", "yyyy-MM-dd").alias("event_date"), F.concat(F.lit("ev"), "user_id").alias("evidence_id"), F.when(F.col("value") > 50, "verified").alias("review_status"),
    )
    return mapping.canonical_events(rows, _evidence(r))


@query("links", f"""
    WITH {_OLD}, l AS (
        SELECT 'lnk' || o_orderkey AS id, 'acc' || o_custkey AS account_id, 'per' || (o_orderkey % 97) AS persona_id, o_totalprice < 60000 AS over,
            CASE WHEN o_orderstatus = 'F' THEN 'verified' WHEN o_orderpriority = '5-LOW' THEN 'odd' ELSE 'rejected' END AS st FROM orders
    )
    SELECT 'account' AS entity, id, 'platform_mapped_to_other' AS issue FROM old WHERE platform = 'mixer'
    UNION ALL SELECT 'account', id, 'handle_namespace_distinct_platform_id' FROM old WHERE id_namespace = 'handle' AND platform_id <> coalesce(handle, '')
    UNION ALL SELECT 'account', id, 'missing_canonical_url' FROM old WHERE url IS NULL
    UNION ALL SELECT 'account', id, 'platform_id_is_handle' FROM old WHERE id_namespace = 'handle'
    UNION ALL SELECT 'link', id, 'unmapped_review' FROM l WHERE st = 'odd'
    UNION ALL SELECT 'account', account_id, 'open_links_multiple_personas' FROM l WHERE NOT over AND st <> 'rejected' GROUP BY account_id HAVING count(DISTINCT persona_id) > 1
    UNION ALL SELECT 'affiliation', 'aff' || c_custkey, 'blank_organization' FROM customer WHERE c_mktsegment = 'MACHINERY'""")
def mapping_decisions(r: Roles) -> DataFrame:
    segment = F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment"))
    affiliations = r.table("customer").select(F.concat(F.lit("aff"), "c_custkey").alias("id"), segment.alias("organization"))
    return mapping.mapping_issues(_old_accounts(r), _dated_links(r), affiliations)
