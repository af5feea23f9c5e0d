"""Queries of the steps around the tables, beside their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdweave.operators import overlap, policy, presence, selection, workflow
from crowdweave.plans.queries import _PRESENCE, query
from crowdweave.plans.roles import Roles


@query("interactions", """
    WITH now AS (
        SELECT creator_id, count(*) AS count, max(observed_at) AS newest FROM interactions GROUP BY 1
    ), old AS (
        SELECT creator_id, count(*) AS count, max(observed_at) AS newest FROM interactions WHERE creator_id < '000005' OR observed_at < DATE '1998-01-01' GROUP BY 1
    )
    SELECT creator_id, now.count, now.newest, CASE WHEN now.count = old.count AND now.newest = old.newest THEN 'skip_unchanged' ELSE 'run' END AS action
    FROM now LEFT JOIN old USING (creator_id)""")
def recompute_gate(r: Roles) -> DataFrame:
    old = r.interactions.where("creator_id < '000005' or observed_at < date '1998-01-01'")
    stored = old.groupBy("creator_id").agg(F.count(F.lit(1)).alias("count"), F.max("observed_at").alias("newest"))
    return workflow.gate(r.interactions, "creator_id", "observed_at", stored)


@query("interactions", _PRESENCE + " SELECT creator_a, creator_b, shared_any FROM rated ORDER BY shared_any DESC, creator_a, creator_b LIMIT 50")
def edges_in_order(r: Roles) -> DataFrame:
    return overlap.overlap_edges(r.dealt).select("creator_a", "creator_b", "shared_any").orderBy(*workflow.edge_order()).limit(50)


@query("personas", "SELECT id, canonical_name FROM personas ORDER BY lower(canonical_name) ASC NULLS LAST, id LIMIT (SELECT count(*) * 9 // 10 FROM personas)")
def names_in_order(r: Roles) -> DataFrame:
    """Nine tenths of the personas by name: those left out have none."""
    return r.personas.select("id", "canonical_name").orderBy(*workflow.name_order("canonical_name", "id")).limit(r.personas.count() * 9 // 10)


@query("accounts", "SELECT id, platform_id FROM accounts WHERE platform = 'youtube' ORDER BY platform_id NULLS FIRST, id LIMIT 60")
def channels_in_order(r: Roles) -> DataFrame:
    return r.accounts.where("platform = 'youtube'").select("id", "platform_id").orderBy("platform_id", "id").limit(60)


@query("videos", """
    SELECT video_id, year, published_at FROM videos WHERE status IN ('O', 'P') AND seconds > 60
    ORDER BY year DESC, published_at DESC NULLS LAST, video_id LIMIT 40""")
def comment_work(r: Roles) -> DataFrame:
    open_ = r.videos.where("status in ('O', 'P') and seconds > 60").select("video_id", "year", "published_at")
    return open_.orderBy(*workflow.newest_first()).limit(40)


@query("videos", """
    SELECT 'c' || l_orderkey || '.' || l_linenumber AS parent_id, video_id, year, CASE l_linestatus WHEN 'O' THEN 'pending' ELSE 'done' END AS status
    FROM lineitem JOIN videos ON video_id = 'v' || l_orderkey WHERE l_linestatus = 'O' ORDER BY year DESC, parent_id LIMIT 40""")
def reply_work(r: Roles) -> DataFrame:
    replies = r.table("lineitem").select(
        F.concat(F.lit("c"), "l_orderkey", F.lit("."), "l_linenumber").alias("parent_id"), F.concat(F.lit("v"), "l_orderkey").alias("video_id"),
        F.when(F.col("l_linestatus") == "O", "pending").otherwise("done").alias("status"),
    )
    return workflow.reply_queue(replies, r.videos, 40)


@query("videos", "SELECT year, channel_id, video_id AS sample_id FROM videos ORDER BY year, channel_id, sample_id LIMIT 75")
def backfill_work(r: Roles) -> DataFrame:
    return workflow.backfill_queue(r.videos.select("year", "channel_id", F.col("video_id").alias("sample_id")), 75)


@query("", """
    SELECT c_custkey AS id, CASE lower(trim(p)) WHEN 'twitter' THEN 'x' WHEN 'carrd' THEN 'website' WHEN 'linktree' THEN 'website' WHEN '' THEN NULL ELSE lower(trim(p)) END AS platform,
        CASE s WHEN 'verified' THEN 'verified' WHEN 'rejected' THEN 'rejected' ELSE 'pending' END AS review,
        CASE q WHEN 'in_review' THEN 'in_review' WHEN 'closed' THEN 'closed' WHEN 'resolved' THEN 'closed' WHEN 'rejected' THEN 'rejected' ELSE 'open' END AS queue
    FROM (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN ' Twitter ' WHEN 1 THEN 'CARRD' WHEN 2 THEN 'linktree' WHEN 3 THEN 'YouTube' WHEN 4 THEN '  ' END AS p,
        CASE c_custkey % 5 WHEN 0 THEN 'verified' WHEN 1 THEN 'rejected' WHEN 2 THEN 'needs_evidence' WHEN 3 THEN 'other' END AS s,
        CASE c_custkey % 7 WHEN 0 THEN 'open' WHEN 1 THEN 'in_review' WHEN 2 THEN 'resolved' WHEN 3 THEN 'closed' WHEN 4 THEN 'rejected' WHEN 5 THEN 'lost' END AS q FROM customer)""")
def mapped_names(r: Roles) -> DataFrame:
    key = F.col("c_custkey")

    def pick(values: list[str | None]):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))

    return r.table("customer").select(
        key.alias("id"), workflow.platform_name(pick([" Twitter ", "CARRD", "linktree", "YouTube", "  ", None])).alias("platform"),
        workflow.review_state(pick(["verified", "rejected", "needs_evidence", "other", None])).alias("review"),
        workflow.queue_state(pick(["open", "in_review", "resolved", "closed", "rejected", "lost", None])).alias("queue"),
    )


@query("", """
    SELECT n_nationkey AS id, coalesce(n_name, '') || '|' || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_regionkey::VARCHAR END || '|' AS cells FROM nation""")
def padded_rows(r: Roles) -> DataFrame:
    cells = F.array(F.col("n_name"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_regionkey").cast("string")))
    return r.table("nation").select(F.col("n_nationkey").alias("id"), F.array_join(workflow.padded(cells, 3), "|").alias("cells"))


@query("", """
    WITH a AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'facebook' WHEN 2 THEN 'youtube' ELSE 'instagram' END AS p,
        CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE 'Name' || c_custkey END AS v FROM customer),
    h AS (SELECT *, p IN ('x', 'instagram') OR (p = 'facebook' AND NOT regexp_full_match(v, '[0-9]+')) AS by_handle FROM a)
    SELECT id, CASE WHEN by_handle THEN '' ELSE v END AS platform_id, CASE WHEN by_handle THEN lower(v) ELSE '' END AS handle FROM h""")
def account_keys_by_platform(r: Roles) -> DataFrame:
    key = F.col("c_custkey")
    platform = F.element_at(F.array(*map(F.lit, ["x", "facebook", "youtube", "instagram"])), (key % 4 + 1).cast("int"))
    value = F.when(key % 5 == 0, key.cast("string")).otherwise(F.concat(F.lit("Name"), key))
    return r.table("customer").select(key.alias("id"), workflow.account_key(platform, value).alias("k")).select("id", "k.platform_id", "k.handle")


@query("videos", """
    SELECT video_id, sha256('{"channel_id":"' || channel_id || '","policy":"p1","video_id":"' || video_id || '","year":' || year || '}') AS digest FROM videos""")
def job_identities(r: Roles) -> DataFrame:
    job = F.struct("video_id", "channel_id", "year", F.lit("p1").alias("policy"))
    return r.videos.select("video_id", workflow.job_identity(job, ["video_id", "channel_id", "year", "policy"]).alias("digest"))


@query("", """
    SELECT event_id, CASE WHEN user_id % 11 = 0 THEN 'PAGE_SAMPLE_COMPLETE' WHEN event_id % 40 >= 15 AND event_id % 3 = 0 THEN 'CAP_REACHED'
        WHEN event_type = 'click' THEN 'EXHAUSTED' WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'PARTIAL_UNAVAILABLE' WHEN event_type = 'error' THEN 'UNAVAILABLE' ELSE 'RUNNING' END AS state FROM events""")
def job_end_states(r: Roles) -> DataFrame:
    kind, n = F.col("event_type"), F.col("event_id")
    return r.table("events").select("event_id", workflow.end_state(
        F.when(F.col("user_id") % 11 == 0, "PAGE_SAMPLE_COMPLETE"), F.when(n % 3 == 0, n % 40).otherwise(0),
        F.when(kind == "click", "EXHAUSTED").when(kind == "error", "COMMENTS_DISABLED"), F.when(kind == "click", "EXHAUSTED").when((kind == "view") & (n % 2 == 0), "PARTIAL_UNAVAILABLE"),
    ).alias("state"))


@query("", """
    SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'viewer_id' WHEN 1 THEN 'author_id,user_key' WHEN 4 THEN 'viewer_hash' ELSE '' END AS found FROM documents""")
def private_key_walk(r: Roles) -> DataFrame:
    """Keys in nested objects, in lists, empty ones, and in JSON that is quoted inside JSON."""
    shapes = [
        '{"a": {"b": [{"viewer_id": "u1"}]}}', '[{"author_id": 5, "x": {"user_key": ["k"]}}]', '{"viewer_id": null, "author_id": ""}',
        '{"text": "viewer_id", "n": 1}', '{"payload": "{\\"viewer_hash\\": \\"ab\\"}"}',
    ]
    record = F.element_at(F.array(*map(F.lit, shapes)), (F.col("doc_id") % 5 + 1).cast("int"))
    held = policy.private_keys(r.table("documents").select("doc_id", record.alias("record")), "doc_id", "record")
    return held.select("doc_id", F.array_join("keys", ",").alias("found"))


_WRAPPED = """
    wrapped AS (
        SELECT d.doc_id, lang <> 'en' AS author, source IS NOT NULL AND source <> '' AS viewer, quality IS NULL AND n_chars > 500 AS person,
            regexp_matches(text, '-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----|AIza[0-9A-Za-z_-]{35}|ya29\\.[A-Za-z0-9._-]{20,}|github_pat_[A-Za-z0-9_]{30,}|gh[pousr]_[A-Za-z0-9]{30,}') AS shape,
            coalesce(toxic, 0) > 0 AS token
        FROM documents AS d LEFT JOIN labels USING (doc_id)
    )"""


@query("", f"""
    WITH {_WRAPPED}
    SELECT doc_id, 'private' AS rule, 'author_id' AS key FROM wrapped WHERE author UNION ALL SELECT doc_id, 'private', 'viewer_id' FROM wrapped WHERE viewer
    UNION ALL SELECT doc_id, 'person', 'channel_url' FROM wrapped WHERE person UNION ALL SELECT doc_id, 'secret', '' FROM wrapped WHERE shape
    UNION ALL SELECT doc_id, 'secret', 'access_token' FROM wrapped WHERE token""")
def policy_findings(r: Roles) -> DataFrame:
    """Texts and labels wrapped as JSON: in fields, in lists, in a text inside a text, beside an exempt summary."""
    docs = r.table("documents").join(r.table("labels"), "doc_id", "left")
    counters = F.struct(*[F.lit(k).alias(n) for n, k in zip(policy.SUMMARY_COUNTERS, (3, 2, 1, 0), strict=True)])
    inner = F.to_json(F.struct(F.col("source").alias("viewer_id"), F.lit("viewer_id").alias("note")))
    record = F.to_json(F.struct(
        F.struct(F.col("text"), F.array(F.struct(F.when(F.col("lang") != "en", F.col("lang")).otherwise("").alias("author_id"))).alias("by")).alias("doc"),
        F.array(F.lit("plain"), inner).alias("sent"), F.struct(counters.alias("viewer_hash"), counters.alias("first_seen")).alias("fields"),
        F.struct(F.lit("https://example.org").alias("channel_url"), F.when(F.col("quality").isNull() & (F.col("n_chars") > 500), "name").alias("display_name")).alias("who"),
        F.struct(F.when(F.col("toxic") > 0, "x").alias("access_token")).alias("auth"),
    ))
    return policy.findings(docs.select("doc_id", record.alias("record")), "doc_id", "record").select(F.col("id").alias("doc_id"), "rule", "key")


@query("videos", "SELECT video_id, CAST(substr(published_at, 1, 4) AS INTEGER) AS year FROM (SELECT video_id, replace(published_at, '199', '202') AS published_at FROM videos) WHERE published_at >= '2021-01-01T00:00:00Z' AND published_at < '2027-01-01T00:00:00Z'")
def catalog_years(r: Roles) -> DataFrame:
    moved = r.videos.select("video_id", F.replace("published_at", F.lit("199"), F.lit("202")).alias("published_at"))
    return moved.where(workflow.in_catalog(F.col("published_at"))).select("video_id", F.substring("published_at", 1, 4).cast("int").alias("year"))


@query("personas", "SELECT id FROM personas WHERE review_status = 'verified' AND CAST(substr(id, 4) AS INTEGER) % 3 < 2")
def catalog_eligible(r: Roles) -> DataFrame:
    n = F.substring("id", 4, 20).cast("int") % 3
    status = F.when(F.col("review_status") == "verified", "CONFIRMED").otherwise("UNCONFIRMED")
    registry = r.personas.select("id", status.alias("vtuber_status"), F.when(n == 0, "active").when(n == 1, "hiatus").otherwise("graduated").alias("activity_status"))
    return workflow.catalog_channels(registry).select("id")


@query("videos", "SELECT video_id FROM videos WHERE status = 'F' AND seconds % 4 < 2")
def public_replays(r: Roles) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ["replay_vod", "normal_video", "short", "premiere"])), (F.col("seconds") % 4 + 1).cast("int"))
    marked = r.videos.select("video_id", F.when(F.col("status") == "F", "public").otherwise("members").alias("access_status"), kind.alias("video_type"))
    return workflow.public_videos(marked).select("video_id")


@query("", """
    WITH c AS (SELECT o_orderkey AS k, o_orderkey % 10 AS n FROM orders)
    SELECT 'cand' || k AS candidate_id, CASE WHEN n = 8 THEN 'approved' WHEN n = 7 THEN 'rejected' ELSE 'needs-evidence' END AS review_status,
        CASE WHEN n = 8 THEN 'UC' || lpad(CAST(k AS VARCHAR), 22, '0') END AS channel_id, CASE WHEN n IN (7, 8) THEN 'performer,singer' END AS roles,
        CASE n WHEN 0 THEN 'incomplete' WHEN 1 THEN 'before_discovery' WHEN 2 THEN 'unknown_evidence' WHEN 3 THEN 'unknown_role' WHEN 4 THEN 'unknown_format' WHEN 5 THEN 'bad_channel_id'
            WHEN 6 THEN 'approval_without_roles' END AS problem FROM c""")
def review_transitions(r: Roles) -> DataFrame:
    """A review of every kind: stopped by each guard, rejected, approved, and none at all."""
    k = F.col("o_orderkey")
    n = k % 10
    rows = r.table("orders").select(k.alias("k"), F.concat(F.lit("cand"), k).alias("candidate_id"), n.alias("n"), F.col("o_orderdate").cast("timestamp").alias("discovered_at"))
    candidates = rows.select("candidate_id", "discovered_at", F.array(F.lit("https://example.org/a")).alias("source_refs"), F.lit("needs-evidence").alias("review_status"))
    n, k = F.col("n"), F.col("k")
    reviews = rows.where("n < 9").select(
        "candidate_id", F.when(n == 7, "rejected").otherwise("approved").alias("decision"), F.when(n == 0, "").otherwise("someone").alias("reviewer"), F.lit("seen").alias("reason"),
        F.when(n == 1, F.col("discovered_at") - F.expr("interval 1 day")).otherwise(F.col("discovered_at")).alias("reviewed_at"),
        F.array(F.when(n == 2, "https://example.org/b").otherwise("https://example.org/a")).alias("source_refs"),
        F.when(n == 3, F.array(F.lit("owner"))).when(n == 6, F.array().cast("array<string>")).otherwise(F.array(F.lit("singer"), F.lit("performer"), F.lit("singer"))).alias("roles"),
        F.when(n == 4, "2D").otherwise("mixed").alias("presentation_format"), F.lit(True).alias("is_virtual_creator"),
        F.when(n == 5, "UC1").otherwise(F.concat(F.lit("UC"), F.lpad(k.cast("string"), 22, "0"))).alias("verified_channel_id"),
    )
    return workflow.reviewed(candidates, reviews).drop("history")


@query("", """
    SELECT t AS table_name, id, CASE WHEN t IS NULL OR t NOT IN ('personas', 'accounts') THEN 'unknown_table' ELSE 'no_id' END AS problem
    FROM (SELECT CASE n_nationkey % 4 WHEN 0 THEN 'personas' WHEN 1 THEN 'accounts' WHEN 2 THEN 'others' END AS t, CASE WHEN n_nationkey % 5 = 0 THEN ' ' ELSE n_name END AS id FROM nation)
    WHERE t IS NULL OR t NOT IN ('personas', 'accounts') OR trim(id) = ''""")
def change_file_problems(r: Roles) -> DataFrame:
    key = F.col("n_nationkey")
    table = F.element_at(F.array(F.lit("personas"), F.lit("accounts"), F.lit("others"), F.lit(None)), (key % 4 + 1).cast("int"))
    return workflow.change_problems(r.table("nation").select(table.alias("table_name"), F.when(key % 5 == 0, " ").otherwise(F.col("n_name")).alias("id")), ["personas", "accounts"])


@query("personas accounts", """
    WITH p AS (SELECT id, canonical_name AS old, CASE WHEN review_status = 'rejected' THEN 'gone' END AS new FROM personas)
    SELECT 'personas' AS table_name, CASE WHEN new IS NULL OR new = old THEN 'unchanged' ELSE 'updated' END AS action, count(*) AS "rows" FROM p GROUP BY 2
    UNION ALL SELECT 'accounts', 'added', count(*) FROM accounts WHERE platform = 'x'""")
def changes_in_order(r: Roles) -> DataFrame:
    changes = {
        "accounts": r.accounts.where("platform = 'x'").select(F.concat(F.lit("new"), "id").alias("id"), "name"),
        "personas": r.personas.select("id", F.when(F.col("review_status") == "rejected", "gone").alias("canonical_name")),
    }
    return workflow.apply_changes({"accounts": r.accounts, "personas": r.personas}, changes, ["personas", "accounts"], dry_run=True)[1]


@query("accounts", """
    WITH c AS (SELECT id, name, CAST(substr(id, 4) AS INTEGER) % 3 AS n FROM accounts)
    SELECT id, CASE n WHEN 0 THEN 'fresh' ELSE name END AS name, CASE n WHEN 0 THEN 'set' WHEN 1 THEN 'conflict' ELSE 'already' END AS action FROM c
    UNION ALL SELECT 'nobody', NULL, 'missing'""")
def guarded_renames(r: Roles) -> DataFrame:
    n = F.substring("id", 4, 20).cast("int") % 3
    changes = r.accounts.select("id", F.when(n == 0, F.col("name")).otherwise("other").alias("expected"), F.when(n == 2, F.col("name")).otherwise("fresh").alias("new"))
    changes = changes.unionByName(r.spark.range(1).select(F.lit("nobody").alias("id"), F.lit("a").alias("expected"), F.lit("b").alias("new")))
    return workflow.compare_and_set(r.accounts, changes, "id", "name")


@query("", """
    WITH moves AS (
        SELECT DISTINCT 'per' || s_suppkey AS persona_id, CASE WHEN s_suppkey % 4 = 0 THEN 'Group ' || (s_suppkey % 8) ELSE lower(n_name) END AS name, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
    ), orgs AS (SELECT lower(n_name) AS key, 'org' || n_nationkey AS id FROM nation)
    SELECT persona_id, coalesce(id, 'org_' || substr(sha256(lower(name)), 1, 20)) AS organization_id, id IS NULL AS is_new
    FROM moves LEFT JOIN orgs ON key = lower(name) WHERE NOT (s_suppkey % 3 = 0 AND id IS NOT NULL)""")
def transfer_affiliations(r: Roles) -> DataFrame:
    joined = r.table("supplier").join(F.broadcast(r.table("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey")
    persona = F.concat(F.lit("per"), key).alias("persona_id")
    moves = joined.select(persona, F.when(key % 4 == 0, F.concat(F.lit("Group "), key % 8)).otherwise(F.lower("n_name")).alias("name"))
    organizations = r.table("nation").select(F.concat(F.lit("org"), "n_nationkey").alias("id"), F.col("n_name").alias("name"))
    existing = joined.where(key % 3 == 0).select(persona, F.concat(F.lit("org"), "n_nationkey").alias("organization_id"))
    return workflow.transfers(moves, organizations, existing)


@query("channel_metrics", """
    WITH a AS (SELECT 'c' || user_id AS channel_id, strftime(ts, '%Y-%m-%d') AS day, max(event_id % 5000) AS n FROM events WHERE event_type <> 'error' GROUP BY 1, 2)
    SELECT channel_id || 'x' AS channel_id, day, CAST(n AS BIGINT) AS subscribers, 'legacy:tab' AS source FROM a""")
def legacy_metric_seed(r: Roles) -> DataFrame:
    """Points of channels that have none are taken; of two points a day, and of points that exist, nothing more."""
    events = r.table("events").where("event_type <> 'error'")
    days = events.groupBy(F.concat(F.lit("c"), "user_id").alias("c"), F.date_format("ts", "yyyy-MM-dd").alias("d")).agg(F.max(F.col("event_id") % 5000).alias("n"))
    new = days.select(F.concat("c", F.lit("x")).alias("platform_id"), F.concat("d", F.lit("T00:00:00Z")).alias("metric_time"), F.format_number("n", 0).alias("followers"), F.lit("tab").alias("source"))
    known = r.channel_metrics.select(F.col("channel_id").alias("platform_id"), F.col("day").alias("metric_time"), F.lit("1").alias("followers"), F.lit("tab").alias("source"))
    return workflow.legacy_points(new.unionByName(new).unionByName(known), r.channel_metrics)


@query("", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'first' ELSE 'new' END AS started_at, CASE WHEN n_nationkey % 3 = 0 THEN 'old' ELSE 'new' END AS state FROM nation")
def first_start_is_kept(r: Roles) -> DataFrame:
    key = F.col("n_nationkey")
    old = r.table("nation").select(key.alias("id"), F.when(key % 2 == 0, "first").alias("started_at"), F.lit("old").alias("state"))
    new = r.table("nation").select(key.alias("id"), F.lit("new").alias("started_at"), F.when(key % 3 != 0, "new").alias("state"))
    return workflow.keep_first(old, new, "id", ["started_at"])


@query("", """
    SELECT 'c' || c_custkey AS channel_id, CASE c_custkey % 7 WHEN 0 THEN 'unknown_channel' WHEN 1 THEN 'other_subject' WHEN 2 THEN 'source_names_other' WHEN 3 THEN 'manifest_names_other'
        WHEN 4 THEN 'claimed_twice' ELSE 'agency_on_independent' END AS problem FROM customer WHERE c_custkey % 7 < 6""")
def identity_checks(r: Roles) -> DataFrame:
    key = F.col("c_custkey")
    n = key % 7
    channel, name = F.concat(F.lit("c"), key).alias("channel_id"), F.col("c_name")
    subject = F.when(n == 3, F.concat(name, F.lit("z"))).when(n == 4, "customer").otherwise(name)
    events = r.table("customer").select(
        channel, F.when(n == 1, "c").otherwise(F.concat(F.lit("c"), key)).alias("subject_channel_id"), subject.alias("subject_name"),
        F.when(n == 2, "someone").otherwise(F.upper(subject)).alias("source_subject"), F.when(n == 5, "Group").otherwise("Independent talent").alias("source_agency"),
    )
    return workflow.identity_problems(events, r.table("customer").where(n != 0).select(channel, name.alias("name"), F.lit("Independent").alias("agency")))


@query("snapshots", """
    WITH seen AS (SELECT channel_id, video_id, viewer_id, source_type, first_seen, last_seen, appearances FROM snapshots WHERE viewer_id <> '')
    SELECT * FROM seen""")
def legacy_presence_migration(r: Roles) -> DataFrame:
    """Old partitions merged into the new layout: rows that both hold keep the widest times and the higher count."""
    rows = r.snapshots.where("viewer_id <> ''")
    n = F.pmod(F.xxhash64("channel_id", "video_id", "viewer_id", "source_type"), F.lit(3))
    old, new = rows.where(n < 2), rows.where(n > 0)
    return presence.merge(old, new).select("channel_id", "video_id", "viewer_id", "source_type", "first_seen", "last_seen", "appearances")


@query("videos", """
    WITH top AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY comments DESC, video_id) AS rank FROM videos)
    SELECT channel_id, video_id, comments, CAST(rank AS INTEGER) AS rank FROM top WHERE rank <= 2 ORDER BY md5('42' || channel_id), channel_id, rank LIMIT 40""")
def balanced_queue(r: Roles) -> DataFrame:
    return selection.balanced(r.videos.select("channel_id", "video_id", "comments"), "channel_id", [F.desc("comments"), "video_id"], 2, 40)


def _review_rows(r: Roles) -> tuple[DataFrame, DataFrame]:
    """Orders as finds, their earliest line as the review of it; times, formats and reviewers are missing here and there."""
    fields = ["l_shipdate", "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax", "l_partkey", "l_suppkey"]
    lines = r.table("lineitem").groupBy("l_orderkey").agg(F.min(F.struct(*fields)).alias("l")).select("l_orderkey", "l.*")
    rows = r.table("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    source = F.concat(F.lit("https://example.org/"), "o_orderkey")
    raw = rows.select(
        F.concat(F.lit("cand"), "o_orderkey").alias("candidate_id"), source.alias("source_url"), F.lit(None).cast("string").alias("channel_id"), F.lit("").alias("name"),
        F.col("o_orderpriority").alias("title"), F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("@h"), "o_custkey")).alias("handle"), F.lit(None).cast("string").alias("description"),
        F.col("o_orderdate").cast("timestamp").alias("at"),
    )
    found = workflow.candidate(raw, F.col("at"))
    kind = F.col("l_returnflag")
    reviews = rows.where("l_orderkey IS NOT NULL").select(
        F.concat(F.lit("cand"), "o_orderkey").alias("candidate_id"), F.when(kind == "R", "rejected").otherwise("approved").alias("decision"),
        F.when(F.col("l_linestatus") == "F", "first").when(F.col("l_quantity") > 3, "second").alias("reviewer"), F.col("o_orderpriority").alias("reason"),
        F.when(F.col("l_discount") > 0.005, F.col("l_shipdate").cast("timestamp")).alias("reviewed_at"), F.array(source).alias("source_refs"),
        F.array(F.when(F.col("l_tax") > 0.07, "owner").otherwise("singer")).alias("roles"), F.when(F.col("l_quantity") < 45, "Live2D").alias("presentation_format"),
        (F.col("l_partkey") % 2 == 0).alias("is_virtual_creator"), F.concat(F.lit("UC"), F.lpad((F.col("l_suppkey") % 40).cast("string"), 22, "0")).alias("verified_channel_id"),
    )
    return found, reviews


_REVIEWED = """
    l AS (
        SELECT * FROM lineitem QUALIFY row_number() OVER (
            PARTITION BY l_orderkey ORDER BY l_shipdate, l_returnflag, l_linestatus, l_quantity, l_discount, l_tax, l_partkey, l_suppkey) = 1
    ),
    judged AS (
        SELECT o.*, l.*, CASE WHEN l_orderkey IS NULL THEN NULL
            WHEN NOT (l_linestatus = 'F' OR l_quantity > 3) THEN 'incomplete'
            WHEN l_discount <= 0.005 OR l_shipdate < o_orderdate THEN 'before_discovery'
            WHEN l_tax > 0.07 THEN 'unknown_role' WHEN l_quantity >= 45 THEN 'unknown_format' END AS problem FROM orders AS o LEFT JOIN l ON o_orderkey = l_orderkey
    ), decided AS (
        SELECT *, CASE WHEN l_orderkey IS NULL OR problem IS NOT NULL THEN 'needs-evidence' WHEN l_returnflag = 'R' THEN 'rejected' ELSE 'approved' END AS status,
            'UC' || lpad(CAST(l_suppkey % 40 AS VARCHAR), 22, '0') AS channel FROM judged
    )"""


@query("", f"""
    WITH {_REVIEWED}
    SELECT 'cand' || o_orderkey AS candidate_id, status AS review_status, CASE WHEN status = 'approved' THEN channel END AS channel_id,
        CASE WHEN status <> 'needs-evidence' THEN 'singer' END AS roles, problem,
        CASE WHEN status <> 'needs-evidence' THEN status || ' by ' || CASE WHEN l_linestatus = 'F' THEN 'first' ELSE 'second' END || ' for ' || o_orderpriority || ' from https://example.org/' || o_orderkey ELSE '' END AS history
    FROM decided""")
def review_decisions(r: Roles) -> DataFrame:
    """Reviews with nulls in every guarded field, and what they leave in the history."""
    found = workflow.reviewed(*_review_rows(r))
    told = F.transform("history", lambda h: F.concat(h["decision"], F.lit(" by "), h["reviewer"], F.lit(" for "), h["reason"], F.lit(" from "), F.array_join(h["source_refs"], ",")))
    return found.withColumn("history", F.array_join(told, ";"))


@query("", f"""
    WITH {_REVIEWED}
    SELECT channel AS channel_id, count(*) AS candidates, count(DISTINCT CASE WHEN o_custkey % 2 = 0 THEN o_custkey END) AS aliases, count(DISTINCT o_orderkey) AS refs,
        CAST(min(o_orderdate) AS TIMESTAMP) AS discovered_at, CASE WHEN count(DISTINCT l_partkey % 2) = 1 THEN bool_or(l_partkey % 2 = 0) END AS is_virtual_creator,
        count(DISTINCT l_partkey % 2) > 1 AS conflict
    FROM decided WHERE status = 'approved' GROUP BY 1""")
def manifest_channels(r: Roles) -> DataFrame:
    """Approved finds merged by their channel; those whose decisions differ wait."""
    candidates, reviews = _review_rows(r)
    done = workflow.reviewed(candidates, reviews).select("candidate_id", "review_status", "channel_id")
    items = done.join(candidates.drop("review_status"), "candidate_id").join(reviews.select("candidate_id", "roles", "presentation_format", "is_virtual_creator"), "candidate_id", "left")
    found = workflow.approved_manifest(items)
    return found.select("channel_id", "candidates", F.size("aliases").cast("long").alias("aliases"), F.size("source_refs").cast("long").alias("refs"), "discovered_at", "is_virtual_creator", "conflict")


@query("", """
    WITH e AS (
        SELECT c_custkey AS k, 'c' || c_custkey AS channel_id, c_nationkey % 2 = 0 AS independent, c_acctbal < 0 AS in_debt, c_mktsegment AS seg, s_name IS NOT NULL AS registered
        FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % 120
    )
    SELECT channel_id, CASE WHEN NOT registered THEN 'unknown_channel' WHEN seg = 'BUILDING' AND in_debt THEN 'registry_names_other'
        WHEN seg = 'MACHINERY' THEN 'page_names_other' WHEN independent AND in_debt THEN 'agency_on_independent' WHEN independent AND seg = 'FURNITURE' THEN 'group_page_on_independent' END AS problem
    FROM e WHERE NOT registered OR (seg = 'BUILDING' AND in_debt) OR seg = 'MACHINERY' OR (independent AND (in_debt OR seg = 'FURNITURE'))""")
def identity_rules(r: Roles) -> DataFrame:
    """Pages, registry names and group pages of customers' accounts."""
    known = r.table("supplier").select(F.col("s_suppkey").alias("n"), "s_name")
    rows = r.table("customer").join(known, F.col("c_custkey") % 120 == F.col("n"), "left").withColumn("channel_id", F.concat(F.lit("c"), "c_custkey"))
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    short = F.regexp_replace(name, "[^0-9]", "")
    page = F.when(segment == "MACHINERY", "Somebody_Else").when(segment == "HOUSEHOLD", F.concat(F.lit("Customer%23"), short)).otherwise(F.replace(name, F.lit("#"), F.lit("_")))
    reference = F.when(segment == "FURNITURE", "https://example.org/wiki/Virtual_Zeven").when(segment == "AUTOMOBILE", "https://example.org/about").otherwise(F.concat(F.lit("https://example.org/wiki/"), page))
    events = rows.select(
        "channel_id", F.col("channel_id").alias("subject_channel_id"), name.alias("subject_name"), F.upper(name).alias("source_subject"),
        F.when(F.col("c_acctbal") < 0, "Group").otherwise("Independent talent").alias("source_agency"), reference.alias("source_reference"),
    )
    manifest = rows.select("channel_id", F.concat(name, F.lit(" ch.")).alias("name"), F.when(F.col("c_nationkey") % 2 == 0, "Independent").otherwise("Group").alias("agency"))
    registered = F.when((segment == "BUILDING") & (F.col("c_acctbal") < 0), "other name").otherwise(name)
    return workflow.identity_problems(events, manifest, rows.where("s_name IS NOT NULL").select("channel_id", registered.alias("name")))
