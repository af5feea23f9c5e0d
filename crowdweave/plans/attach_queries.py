"""Queries of attaching accounts to personas and of accepting outcomes, beside their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdweave.functions import scores
from crowdweave.operators import attach, selection
from crowdweave.plans.queries import _NOW, query
from crowdweave.plans.roles import Roles
from crowdweave.sources import sinks
from crowdweave.sources.shared import fresh_folder

_TALENTS = """
    known AS (
        SELECT id, platform, coalesce(platform_id, '') AS pid, coalesce(nullif(lower(ltrim(handle, '@')), ''), '') AS h FROM accounts
    ), talents AS (
        SELECT s_suppkey AS id, s_name AS name, s_acctbal, s_nationkey, CASE WHEN s_suppkey % 4 <> 0 THEN 'UC' || (s_suppkey % 90) END AS yt,
            CASE WHEN s_suppkey % 3 = 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 6, '0') WHEN s_suppkey % 3 = 1 THEN 'none' END AS tw, 'H' || (s_suppkey * 2) AS login FROM supplier
    ), own AS (
        SELECT id AS talent_id, 'youtube' AS platform, yt AS pid, '' AS h FROM talents WHERE yt IS NOT NULL
        UNION ALL SELECT id, 'twitch', tw, lower(login) FROM talents WHERE tw <> 'none'
    ), found AS (
        SELECT own.*, coalesce((SELECT min(id) FROM known k WHERE k.platform = own.platform AND k.pid = own.pid AND k.pid <> ''),
            (SELECT min(id) FROM known k WHERE k.platform = own.platform AND k.h = own.h AND own.h <> '')) AS account_id,
            count(*) OVER (PARTITION BY platform, pid) > 1 AS shared FROM own
    ), held AS (
        SELECT talent_id, bool_or(shared) AS shared, count(DISTINCT persona_id) AS owners, min(persona_id) AS owner
        FROM found LEFT JOIN (SELECT account_id, persona_id FROM links WHERE review_status <> 'rejected') USING (account_id) GROUP BY 1
    ), told AS (
        SELECT id AS talent_id, CASE WHEN shared IS NULL THEN 'no_stable_account' WHEN shared THEN 'shared_channel' WHEN owners > 1 THEN 'conflict_multi_persona'
            WHEN owners = 1 THEN 'matched_existing' ELSE 'new_persona' END AS outcome, owner, s_acctbal, s_nationkey FROM talents LEFT JOIN held ON talent_id = id
    ), outcomes AS (
        SELECT talent_id, outcome, CASE outcome WHEN 'matched_existing' THEN owner WHEN 'new_persona' THEN 'persona_' || substr(sha256('talent:' || talent_id), 1, 20) END AS persona_id,
            CASE WHEN outcome = 'new_persona' THEN CASE WHEN s_acctbal > 5000 THEN 'pngtuber' WHEN s_acctbal > 0 THEN 'mixed' WHEN s_nationkey % 2 = 0 THEN 'vtuber' ELSE 'unknown' END END AS persona_type,
            CASE WHEN outcome = 'new_persona' THEN CASE WHEN s_acctbal < 2000 THEN 'graduated' ELSE 'unknown' END END AS status FROM told
    )"""


def _talents(r: Roles) -> DataFrame:
    """Suppliers as talents, some of whom share a channel or have accounts that the registry knows."""
    key = F.col("s_suppkey")
    types = F.when(F.col("s_acctbal") > 5000, F.array(F.lit("PNG"), F.lit("PNG"))).when(F.col("s_acctbal") > 0, F.array(F.lit("3D"), F.lit("PNG"))).when(F.col("s_nationkey") % 2 == 0, F.array(F.lit("Live2D")))
    stream = F.when(key % 3 == 0, F.lpad(key.cast("string"), 6, "0")).when(key % 3 == 1, "none")
    return r.table("supplier").select(
        key.alias("id"), F.col("s_name").alias("name"), types.alias("types"), F.when(F.col("s_acctbal") < 2000, "RETIRED").otherwise("ACTIVE").alias("status_type"),
        F.struct(F.when(key % 4 != 0, F.concat(F.lit("UC"), key % 90)).alias("channel_id"), F.lit("").alias("name")).alias("youtube"),
        F.struct(stream.alias("channel_id"), F.concat(F.lit("H"), key * 2).alias("username"), F.lit(None).cast("string").alias("name")).alias("twitch"),
    )


@query("accounts links", f"WITH {_TALENTS} SELECT * FROM outcomes")
def talent_outcomes(r: Roles) -> DataFrame:
    return attach.talent_plan(_talents(r), r.accounts, r.links)["outcomes"]


@query("accounts links", f"""
    WITH {_TALENTS}, placed AS (
        SELECT persona_id, coalesce(account_id, 'acct_' || substr(sha256('talent-account:' || platform || ':' || pid), 1, 20)) AS account_id FROM found JOIN outcomes USING (talent_id) WHERE persona_id IS NOT NULL
    )
    SELECT DISTINCT 'link_' || substr(sha256(account_id || ':' || persona_id), 1, 20) AS id, persona_id, account_id FROM placed
    WHERE (persona_id, account_id) NOT IN (SELECT (persona_id, account_id) FROM links)""")
def talent_links(r: Roles) -> DataFrame:
    return attach.talent_plan(_talents(r), r.accounts, r.links)["links"]


def _owned_accounts(r: Roles) -> DataFrame:
    """Channels of suppliers, and donation pages of customers, as accounts."""
    pages = r.table("customer").select(F.concat(F.lit("acc"), "c_custkey").alias("id"), F.lit("tipjai").alias("platform"), F.lit("").alias("platform_id"), F.concat(F.lit("@Page"), "c_custkey").alias("handle"))
    own = r.table("customer").select(F.concat(F.lit("ch"), "c_custkey").alias("id"), F.lit("youtube").alias("platform"), F.concat(F.lit("UC"), "c_custkey").alias("platform_id"), F.lit("").alias("handle"))
    return pages.unionByName(own)


def _owned_links(r: Roles) -> DataFrame:
    """Personas of pages by orders, of channels by their first order."""
    orders = r.table("orders")
    status = F.when(F.col("o_orderstatus") == "F", "verified").when(F.col("o_orderstatus") == "O", "pending").otherwise("rejected").alias("review_status")
    persona = F.concat(F.lit("per"), F.col("o_orderkey") % 97).alias("persona_id")
    pages = orders.where("o_totalprice > 150000").select(F.concat(F.lit("acc"), "o_custkey").alias("account_id"), persona, status)
    first = orders.groupBy("o_custkey").agg(F.min(F.struct("o_orderkey", "o_orderstatus")).alias("o")).select("o_custkey", "o.*")
    return pages.unionByName(first.select(F.concat(F.lit("ch"), "o_custkey").alias("account_id"), persona, status))


@query("personas", """
    WITH l AS (
        SELECT 'acc' || o_custkey AS account_id, 'per' || (o_orderkey % 97) AS persona_id, o_orderstatus AS st FROM orders WHERE o_totalprice > 150000
        UNION ALL SELECT 'ch' || o_custkey, 'per' || (o_orderkey % 97), o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1
    ), v AS (
        SELECT account_id, list(DISTINCT persona_id) AS owners FROM l WHERE st IN ('F', 'O') AND persona_id IN (SELECT id FROM personas WHERE review_status = 'verified') GROUP BY 1
    ), links_found AS (
        SELECT c_custkey AS k, 'UC' || c_custkey AS channel_id, 'page' || (c_custkey + c_nationkey % 3) AS slug FROM customer WHERE c_mktsegment <> 'MACHINERY'
    ), j AS (
        SELECT f.*, CASE WHEN len(p.owners) = 1 THEN p.owners[1] END AS persona_id, c.c_custkey AS page, o.owners FROM links_found f
        LEFT JOIN v p ON p.account_id = 'ch' || k LEFT JOIN customer c ON 'page' || c.c_custkey = slug LEFT JOIN v o ON o.account_id = 'acc' || c.c_custkey
    )
    SELECT channel_id, 'https://tipjai.com/' || slug AS url, 'tipjai' AS platform, slug, CASE WHEN persona_id IS NULL THEN 'no_verified_persona'
        WHEN list_contains(owners, persona_id) THEN 'already_linked' WHEN owners IS NOT NULL THEN 'conflict_other_persona' WHEN page IS NOT NULL THEN 'new_link' ELSE 'new_account_and_link' END AS outcome,
        persona_id, CASE WHEN page IS NOT NULL THEN 'acc' || page WHEN persona_id IS NOT NULL THEN 'acct_' || substr(sha256('about-account:tipjai:' || slug), 1, 20) END AS account_id
    FROM j""")
def donation_outcomes(r: Roles) -> DataFrame:
    """Links on customers' channels, to their own donation page or a neighbour's."""
    host = F.when(F.col("c_mktsegment") == "MACHINERY", "https://example.org/").otherwise("https://www.tipjai.com/")
    found = r.table("customer").select(F.concat(F.lit("UC"), "c_custkey").alias("channel_id"), F.concat(host, F.lit("Page"), F.col("c_custkey") + F.col("c_nationkey") % 3, F.lit("?a=1")).alias("url"))
    return attach.donation_plan(found, _owned_accounts(r), _owned_links(r), r.personas)


@query("accounts links", """
    WITH p AS (
        SELECT o_custkey AS k, 'slug' || o_custkey AS slug, count(*) AS n, max(o_orderpriority) AS pr, bool_or(o_orderstatus = 'P') AS virtual FROM orders GROUP BY 1
    ), o AS (
        SELECT k, list_sort(list(DISTINCT persona_id)) AS owners FROM p JOIN links ON account_id = 'acc' || k
        JOIN accounts ON accounts.id = account_id AND platform_id IS NOT NULL AND (platform <> 'tiktok') WHERE review_status <> 'rejected' AND n < 9 GROUP BY 1
    ), j AS (
        SELECT p.*, coalesce(owners, []) AS owners, EXISTS (SELECT 1 FROM accounts WHERE id = 'acc' || k AND platform_id IS NOT NULL AND platform <> 'tiktok') AND n < 9 AS stable FROM p LEFT JOIN o USING (k)
    ), told AS (
        SELECT *, CASE WHEN pr = '4-NOT SPECIFIED' THEN 'need_review' WHEN NOT stable THEN 'no_stable_account' WHEN pr = '3-MEDIUM' AND NOT virtual THEN 'no_evidence'
            WHEN len(owners) > 1 THEN 'several_personas' WHEN len(owners) = 1 AND k % 5 = 0 AND owners[1] <> 'per1' THEN 'other_persona' WHEN len(owners) = 1 THEN 'attached' ELSE 'new_persona' END AS outcome FROM j
    )
    SELECT slug, outcome, CASE outcome WHEN 'attached' THEN owners[1] WHEN 'new_persona' THEN 'persona_' || substr(sha256('page:' || slug), 1, 20) END AS persona_id,
        array_to_string(owners, ',') AS owners FROM told""")
def page_owners(r: Roles) -> DataFrame:
    """Customers' pages that name their account, unless they are too busy or on a platform without stable ids."""
    per = r.table("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderpriority").alias("pr"), F.bool_or(F.col("o_orderstatus") == "P").alias("virtual"))
    own = r.accounts.select(F.substring("id", 4, 20).cast("long").alias("o_custkey"), "platform", "platform_id")
    stable = (F.col("n") < 9) & (F.col("platform") != "tiktok")
    pages = per.join(own, "o_custkey", "left").select(
        F.concat(F.lit("slug"), "o_custkey").alias("slug"), F.when(F.col("pr") == "4-NOT SPECIFIED", "NEED_REVIEW").when(F.col("pr") == "3-MEDIUM", "NO_EVIDENCE").otherwise("MATCH").alias("match"),
        F.array(F.struct(F.col("platform"), F.when(stable, F.col("platform_id")).alias("platform_id"))).alias("official"),
        F.when(F.col("o_custkey") % 5 == 0, "per1").alias("persona_id"), F.col("virtual").alias("virtual_signal"), F.lit(True).alias("thai_signal"),
    )
    return attach.owner_plan(pages, r.accounts, r.links)


@query("", """
    WITH j AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS p FROM orders), e AS (
        SELECT l_orderkey AS k, count(*) AS n, bool_or(l_returnflag = 'R' AND l_quantity > 45) AS f FROM lineitem WHERE l_discount > 0.03 GROUP BY 1
    ), t AS (
        SELECT k, coalesce(n, 0) AS n, coalesce(f, false) AS f, CASE p WHEN '1-URGENT' THEN 'SUCCESS' WHEN '2-HIGH' THEN 'EMPTY_RESULT' WHEN '3-MEDIUM' THEN 'RATE_LIMITED'
            WHEN '4-NOT SPECIFIED' THEN 'COMMENTS_DISABLED' ELSE 'EXTRACTION_FAILURE' END AS st FROM j LEFT JOIN e USING (k)
    ), b AS (SELECT *, st IN ('SUCCESS', 'EMPTY_RESULT') AS pub, st IN ('SUCCESS', 'EMPTY_RESULT') AND (f OR (st = 'EMPTY_RESULT' AND n > 0)) AS broken FROM t)
    SELECT 'v' || k AS job_id, CASE WHEN broken THEN 'STORAGE_FAILURE' ELSE st END AS status, CAST(CASE WHEN pub AND NOT broken THEN n ELSE 0 END AS BIGINT) AS records,
        broken OR (NOT pub AND st <> 'COMMENTS_DISABLED') AS retry, CASE WHEN broken OR NOT pub THEN CASE WHEN st = 'RATE_LIMITED' AND NOT broken THEN 60 ELSE 30 END END AS wait FROM b""")
def accepted_outcomes(r: Roles) -> DataFrame:
    """Orders as jobs, their lines as events; some lines belong to another video, some outcomes have unknown names."""
    status = F.create_map(*[F.lit(x) for pair in {"1-URGENT": "SUCCESS", "2-HIGH": "EMPTY_RESULT", "3-MEDIUM": "RATE_LIMITED", "4-NOT SPECIFIED": "COMMENTS_DISABLED", "5-LOW": "odd"}.items() for x in pair])
    video = F.concat(F.lit("v"), "o_orderkey")
    jobs = r.table("orders").select(
        video.alias("job_id"), F.concat(F.lit("c"), "o_custkey").alias("channel_id"), video.alias("video_id"), F.lit("comment").alias("source_type"), status[F.col("o_orderpriority")].alias("status")
    )
    lines = r.table("lineitem").where("l_discount > 0.03").join(r.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    own = F.concat(F.lit("v"), "l_orderkey")
    foreign = (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)
    events = lines.select(own.alias("job_id"), F.concat(F.lit("c"), "o_custkey").alias("channel_id"), F.when(foreign, "other").otherwise(own).alias("video_id"), F.lit("comment").alias("source_type"))
    return attach.accepted(jobs, events)


@query("personas accounts", """
    SELECT (SELECT count(*) FROM orders) AS candidates, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS needs_evidence, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS verified,
        (SELECT count(*) FROM events WHERE event_type = 'error') AS open_reviews, (SELECT count(*) FROM personas WHERE review_status = 'verified') AS verified_personas, (SELECT count(*) FROM accounts) AS total_accounts""")
def queue_counts(r: Roles) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "O", "needs_evidence").when(F.col("o_orderstatus") == "F", "verified").otherwise("rejected")
    queue = r.table("events").select(F.when(F.col("event_type") == "error", "open").otherwise("closed").alias("status"))
    return attach.queue_status(r.table("orders").select(state.alias("review_status")), queue, r.personas, r.accounts)


@query("", """
    SELECT c_custkey AS id, CASE WHEN c_nationkey % 3 = 0 THEN CAST(round(c_acctbal) AS BIGINT) ELSE 0 END AS subscriber_count, CASE WHEN c_nationkey % 2 = 0 THEN c_acctbal ELSE 0.0 END AS thai_confidence,
        CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey ELSE 1 END AS source_count, CAST(0 AS BIGINT) AS streams_collected, c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_nationkey = 3 AS enabled FROM customer""")
def coerced_fields(r: Roles) -> DataFrame:
    whole = F.round("c_acctbal").cast("long").cast("string")
    rows = r.table("customer").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit(" "), whole)).when(F.col("c_nationkey") % 3 == 1, F.concat(whole, F.lit(".5"))).alias("subscriber_count"),
        F.when(F.col("c_nationkey") % 2 == 0, F.col("c_acctbal").cast("string")).otherwise("high").alias("thai_confidence"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_custkey").cast("string")).otherwise("").alias("source_count"), F.lit(None).cast("string").alias("streams_collected"),
        F.when(F.col("c_nationkey") == 3, None).when(F.col("c_mktsegment") == "BUILDING", " Yes ").when(F.col("c_mktsegment") == "MACHINERY", "1").otherwise("no").alias("enabled"),
    )
    return attach.coerced(rows)


@query("", """
    SELECT doc_id, sha256('{"a":[{"y":' || to_json(source) || ',"z":' || n_chars || '},null],"lang":' || to_json(lang) || ',"ชื่อ":{"b":true,"c":"é"}}') AS hash FROM documents""")
def record_hashes(r: Roles) -> DataFrame:
    """Nested records whose keys come in any order, with spaces."""
    parts = [F.lit('{ "ชื่อ" : {"c": "é", "b" : true}, "lang": '), F.to_json(F.array("lang")), F.lit(', "a":[ {"z": '), F.col("n_chars").cast("string"), F.lit(', "y": '), F.to_json(F.array("source")), F.lit("}, null ] }")]
    text = F.concat(*[F.regexp_replace(p, r"\A\[|\]\z", "") if i in (1, 5) else p for i, p in enumerate(parts)])
    return r.table("documents").select("doc_id", attach.record_hash(text).alias("hash"))


@query("", f"""
    WITH p AS (SELECT c_custkey AS id, CAST(round(c_acctbal * 20) AS BIGINT) AS subs, c_custkey % 15 AS streams FROM customer), s AS (
        SELECT id, round(0.6 * CASE WHEN subs <= 0 THEN 0.0 ELSE greatest(0.0, least(1.0, (log10(CAST(greatest(10, subs) AS DOUBLE)) - 2.0) / 3.7)) END
            + 0.2 + 0.1 + 0.1 * CASE WHEN streams <= 0 THEN 1.0 ELSE greatest(0.0, 1.0 - least(1.0, streams / 10.0)) END, 4) AS priority FROM p
    ) SELECT id, priority, 'ASSIGNED' AS status FROM s ORDER BY priority DESC, id LIMIT 3""")
def greedy_schedule(r: Roles) -> DataFrame:
    """The streams of highest priority for three workers; none was collected yet, all are live."""
    subs = F.round(F.col("c_acctbal") * 20).cast("long")
    rated = r.table("customer").select(F.col("c_custkey").alias("id"), scores.priority(subs, F.lit(None).cast("string"), F.lit(True), F.col("c_custkey") % 15, F.lit(_NOW).cast("timestamp")).alias("priority"))
    return selection.greedy(rated, 3)


@query("", """
    WITH s AS (SELECT l_suppkey AS k, list_sort(list(DISTINCT l_returnflag || l_linestatus)) AS a, list_sort(list(DISTINCT l_returnflag || l_linestatus) FILTER (l_quantity > 25)) AS b FROM lineitem GROUP BY 1)
    SELECT k, len(a) AS either, CAST(coalesce(len(b), 0) AS BIGINT) AS both, coalesce(len(b), 0) = len(a) AS within FROM s""")
def set_relations(r: Roles) -> DataFrame:
    """Per supplier: union and intersection of two sets of marks, and whether the first lies within the second."""
    mark = F.concat("l_returnflag", "l_linestatus")
    sets = r.table("lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.collect_set(mark).alias("a"), F.collect_set(F.when(F.col("l_quantity") > 25, mark)).alias("b"))
    return sets.select("k", F.size(F.array_union("a", "b")).cast("long").alias("either"), F.size(F.array_intersect("a", "b")).cast("long").alias("both"), (F.size(F.array_except("a", "b")) == 0).alias("within"))


@query("", "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation")
def bootstrap_tables(r: Roles) -> DataFrame:
    """Small tables dumped as one JSON document with a schema version, and read back."""
    from crowdweave.sources import readers

    path = fresh_folder(r.spark)
    nations = r.table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    sinks.bootstrap_json({"nations": nations, "regions": r.table("region").select("r_name")}, path)
    return readers.registry_tables(r.spark, path, "nations", "id: bigint, name: string, region: bigint")


@query("", "SELECT CAST(row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS INTEGER) AS n, c_custkey AS id, c_mktsegment AS domain FROM customer")
def link_snapshot(r: Roles) -> DataFrame:
    """Ordered JSON lines: the files, one after the other, hold the rows in order."""
    path = fresh_folder(r.spark)
    rows = r.table("customer").select(F.col("c_mktsegment").alias("domain"), F.col("c_custkey").alias("id"))
    sinks.json_lines(rows, path, ["domain", "id"])
    from pyspark.sql import Window

    lines = r.spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    place = F.row_number().over(Window.orderBy("file", "block", "at"))
    return lines.select(place.alias("n"), F.from_json("value", "id long, domain string").alias("v")).select("n", "v.id", "v.domain")
