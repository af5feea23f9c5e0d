"""The library's queries over the synthetic tables, each beside its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdweave.functions import scores, times, urls
from crowdweave.operators import checks, growth, matching, merge, overlap, presence, registry, selection, summary
from crowdweave.plans.roles import Roles, with_roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(roles: str, sql: str | None):
    """Register a function of Roles as a query, with its oracle over the named roles."""

    def add(build: Callable[[Roles], DataFrame]):
        QUERIES[build.__name__] = lambda spark, folder: build(Roles(spark, folder))
        if sql:
            ORACLE_SQL[build.__name__] = with_roles(roles, sql) if roles else sql
        return build

    return add


_PRESENCE = """
    WITH seen AS (
        SELECT creator_id, viewer_id, count(DISTINCT video_id) AS videos,
            count(DISTINCT video_id) FILTER (source_type = 'live_chat') AS lives, count(DISTINCT video_id) FILTER (source_type = 'comment') AS notes,
            bool_or(source_type = 'live_chat') AS live, bool_or(source_type = 'comment') AS note
        FROM interactions WHERE trim(viewer_id) <> '' GROUP BY 1, 2
    ), sizes AS (
        SELECT creator_id, count(*) AS size FROM seen GROUP BY 1
    ), edges AS (
        SELECT l.creator_id AS creator_a, r.creator_id AS creator_b, CAST(count(*) AS INTEGER) AS shared_any,
            CAST(count(*) FILTER (l.live AND r.live) AS INTEGER) AS shared_live_chat, CAST(count(*) FILTER (l.note AND r.note) AS INTEGER) AS shared_comments,
            CAST(count(*) FILTER (l.videos > 1 AND r.videos > 1) AS INTEGER) AS strong_shared_any,
            CAST(count(*) FILTER (l.lives > 1 AND r.lives > 1) AS INTEGER) AS strong_shared_live_chat,
            CAST(count(*) FILTER (l.notes > 1 AND r.notes > 1) AS INTEGER) AS strong_shared_comments
        FROM seen l JOIN seen r ON l.viewer_id = r.viewer_id AND l.creator_id < r.creator_id GROUP BY 1, 2
    ), rated AS (
        SELECT edges.*, CAST(shared_any AS DOUBLE) / (x.size + y.size - shared_any) AS jaccard, CAST(shared_any AS DOUBLE) / least(x.size, y.size) AS simpson
        FROM edges JOIN sizes x ON x.creator_id = creator_a JOIN sizes y ON y.creator_id = creator_b
    )"""


@query("interactions", _PRESENCE + " SELECT * FROM rated")
def overlap_edges(r: Roles) -> DataFrame:
    return overlap.overlap_edges(r.dealt)


@query("snapshots", """
    WITH s AS (
        SELECT channel_id, viewer_id, count(DISTINCT video_id) AS vids, count(DISTINCT video_id) FILTER (source_type = 'live_chat') AS lives,
            count(DISTINCT video_id) FILTER (source_type = 'comment') AS notes, sum(appearances) AS apps,
            bool_or(source_type = 'live_chat') AS live, bool_or(source_type = 'comment') AS note
        FROM snapshots WHERE viewer_id <> '' GROUP BY 1, 2
    ), t AS (
        SELECT channel_id, count(*) AS size, count(*) FILTER (live) AS live, count(*) FILTER (note) AS note FROM s GROUP BY 1
    ), p AS (
        SELECT l.channel_id AS channel_a, m.channel_id AS channel_b, count(*) AS shared_any, count(*) FILTER (l.live AND m.live) AS shared_live_chat,
            count(*) FILTER (l.note AND m.note) AS shared_comments, count(*) FILTER (l.vids > 1 AND m.vids > 1) AS strong_shared_any,
            count(*) FILTER (l.lives > 1 AND m.lives > 1) AS strong_shared_live_chat, count(*) FILTER (l.notes > 1 AND m.notes > 1) AS strong_shared_comments,
            round(avg(l.vids), 2) AS avg_videos_a, round(avg(m.vids), 2) AS avg_videos_b, round(avg(l.lives), 2) AS avg_live_streams_a,
            round(avg(m.lives), 2) AS avg_live_streams_b, round(avg(l.apps), 2) AS avg_appearances_a, round(avg(m.apps), 2) AS avg_appearances_b
        FROM s l JOIN s m ON l.viewer_id = m.viewer_id AND l.channel_id < m.channel_id GROUP BY 1, 2
    ), q AS (
        SELECT p.*, strong_shared_any AS shared_strong, x.size AS size_a, y.size AS size_b, shared_any AS shared_viewers,
            round(CAST(shared_any AS DOUBLE) / (x.size + y.size - shared_any), 4) AS jaccard, round(CAST(shared_any AS DOUBLE) / least(x.size, y.size), 4) AS overlap_coefficient,
            round(coalesce(CAST(shared_live_chat AS DOUBLE) / nullif(x.live + y.live - shared_live_chat, 0), 0), 4) AS jaccard_live_chat,
            round(coalesce(CAST(shared_comments AS DOUBLE) / nullif(x.note + y.note - shared_comments, 0), 0), 4) AS jaccard_comments
        FROM p JOIN t x ON x.channel_id = channel_a JOIN t y ON y.channel_id = channel_b
    ) SELECT *, jaccard AS jaccard_any, overlap_coefficient AS overlap_coeff_any FROM q""")  # fmt: skip
def overlap_matrix(r: Roles) -> DataFrame:
    return overlap.overlap_matrix(r.snapshots)


@query("interactions", "SELECT creator_id, count(DISTINCT viewer_id) AS unique_viewers FROM interactions WHERE trim(viewer_id) <> '' GROUP BY 1")
def audience_sizes(r: Roles) -> DataFrame:
    return overlap.audience_sizes(r.interactions)


@query("snapshots", """
    SELECT viewer_id, channel_id, count(DISTINCT video_id) AS videos_seen, count(DISTINCT video_id) FILTER (source_type = 'live_chat') AS live_streams_seen,
        count(DISTINCT video_id) FILTER (source_type = 'comment') AS comment_videos_seen, CAST(sum(appearances) AS BIGINT) AS appearances,
        bool_or(source_type = 'live_chat') AS in_live_chat, bool_or(source_type = 'comment') AS in_comment, min(first_seen) AS first_seen, max(last_seen) AS last_seen
    FROM snapshots WHERE viewer_id <> '' GROUP BY 1, 2""")
def presence_summary(r: Roles) -> DataFrame:
    return overlap.viewer_presence(r.snapshots)


@query("interactions", "SELECT viewer_id FROM interactions WHERE trim(viewer_id) <> '' GROUP BY 1 HAVING count(DISTINCT creator_id) > 1")
def multi_creator_viewers(r: Roles) -> DataFrame:
    return overlap.multi_creator_viewers(r.interactions)


@query("interactions", """
    SELECT creator_id, count(DISTINCT viewer_id) FILTER (source_type = 'live_chat') AS live_chat, count(DISTINCT viewer_id) FILTER (source_type = 'comment') AS comment
    FROM interactions WHERE trim(viewer_id) <> '' GROUP BY 1""")
def overlap_pivot_by_source(r: Roles) -> DataFrame:
    return overlap.pivot_by_source(r.interactions)


@query("interactions", _PRESENCE + """
    SELECT (SELECT count(*) FROM rated) AS edges, (SELECT count(DISTINCT c) FROM (SELECT creator_a AS c FROM rated UNION ALL SELECT creator_b FROM rated)) AS creators,
        (SELECT max(shared_any) FROM rated) AS max_shared, CAST((SELECT sum(shared_any) FROM rated) AS BIGINT) AS sum_shared""")
def network_summary(r: Roles) -> DataFrame:
    return overlap.network_summary(overlap.overlap_edges(r.dealt))


_VERIFIED = """
    WITH v AS (
        SELECT links.*, canonical_name FROM links JOIN personas ON personas.id = persona_id
        WHERE links.review_status = 'verified' AND personas.review_status = 'verified'
    )"""


@query("accounts links personas affiliations legacy", _VERIFIED + """, top AS (
        SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY reviewed_at DESC NULLS LAST, id) = 1
    ), org AS (
        SELECT persona_id, arg_min(organization, id) AS organization FROM affiliations WHERE review_status = 'verified' GROUP BY 1
    ), claim AS (
        SELECT * FROM legacy QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY source_checked_at DESC NULLS LAST, id) = 1
    )
    SELECT platform_id AS channel_id, coalesce(handle, '') AS handle, coalesce(nullif(coalesce(canonical_name, name), ''), platform_id) AS name, 0 AS subscriber_count,
        coalesce(nullif(coalesce(organization, source_agency, 'Independent'), ''), 'Independent') AS agency, 'ACCEPT' AS status, '' AS last_activity,
        coalesce(reviewed_at, source_checked_at, first_discovered_at, '') AS last_collected, coalesce(top.persona_id, '') AS persona_id
    FROM accounts a LEFT JOIN top ON top.account_id = a.id LEFT JOIN org ON org.persona_id = top.persona_id LEFT JOIN claim ON claim.account_id = a.id
    WHERE platform = 'youtube' AND platform_id IS NOT NULL AND (top.account_id IS NOT NULL OR claim.account_id IS NOT NULL)""")
def vtubers_export(r: Roles) -> DataFrame:
    return registry.creators_table(r.accounts, r.links, r.personas, r.affiliations, r.legacy)


@query("interactions accounts", _PRESENCE + """, y AS (SELECT platform_id, name FROM accounts WHERE platform = 'youtube' AND platform_id IS NOT NULL)
    SELECT creator_a AS channel_a_id, coalesce(x.name, creator_a) AS channel_a, 'Independent' AS agency_a, creator_b AS channel_b_id, coalesce(z.name, creator_b) AS channel_b,
        'Independent' AS agency_b, shared_any AS shared_viewers, shared_live_chat, shared_comments, strong_shared_any AS strong_shared, strong_shared_live_chat,
        strong_shared_comments, jaccard, simpson
    FROM rated LEFT JOIN y x ON x.platform_id = creator_a LEFT JOIN y z ON z.platform_id = creator_b""")
def network_export(r: Roles) -> DataFrame:
    return registry.network_table(overlap.overlap_edges(r.dealt), r.accounts)


def _platform_sql(platform: str) -> str:
    return _VERIFIED + f"""
        SELECT coalesce(handle, '') AS handle, coalesce(nullif(canonical_name, ''), handle) AS name, platform_id, url, coalesce(canonical_name, '') AS persona_name,
            persona_id, coalesce(reviewed_at, '') AS observed_at
        FROM accounts JOIN v ON v.account_id = accounts.id WHERE platform = '{platform}'"""


@query("accounts links personas", _platform_sql("tiktok"))
def tiktok_export(r: Roles) -> DataFrame:
    return registry.platform_table(r.accounts, r.links, r.personas, "tiktok")


@query("accounts links personas", _platform_sql("twitch"))
def twitch_export(r: Roles) -> DataFrame:
    return registry.platform_table(r.accounts, r.links, r.personas, "twitch")


@query("accounts links", """
    SELECT platform, platform_id, name, 'reviewed_persona_link' AS scope, 0 AS followers_or_subscribers, 0 AS views, '' AS likes_received, '' AS metric_time,
        'unknown' AS time_basis, coalesce(reviewed_at, '') AS observed_at, 'registry' AS source, url AS source_url, url AS account_url
    FROM accounts JOIN links ON account_id = accounts.id WHERE platform = 'youtube' AND review_status = 'verified'""")
def metrics_export(r: Roles) -> DataFrame:
    return registry.metrics_table(r.accounts, r.links)


@query("accounts links personas legacy", _VERIFIED + """
    SELECT accounts.* FROM accounts WHERE platform = 'youtube'
        AND (id IN (SELECT account_id FROM v) OR id IN (SELECT account_id FROM legacy))""")
def eligible_accounts_exists_or(r: Roles) -> DataFrame:
    return registry.eligible_accounts(r.accounts, r.links, r.personas, r.legacy)


@query("accounts links", """
    SELECT id, platform, handle FROM accounts WHERE id NOT IN (SELECT account_id FROM links WHERE review_status = 'rejected')
        AND NOT EXISTS (SELECT 1 FROM accounts c WHERE c.platform = 'x' AND c.handle = accounts.handle)""")
def unlinked_accounts_anti(r: Roles) -> DataFrame:
    return registry.unlinked_accounts(r.accounts, r.links.where("review_status = 'rejected'"), r.accounts.where("platform = 'x'"))


@query("accounts links personas", """
    SELECT id, platform_id FROM accounts WHERE platform = 'youtube' AND id IN (
        SELECT account_id FROM links WHERE review_status <> 'rejected' AND persona_id IN (SELECT id FROM personas WHERE review_status = 'verified'))""")
def channel_refresh_semi(r: Roles) -> DataFrame:
    return registry.linked_accounts(r.accounts, r.links, r.personas, "youtube")


@query("links personas", _VERIFIED + """
    SELECT * EXCLUDE (persona_id), persona_id FROM v QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY reviewed_at DESC NULLS LAST, id) = 1""")
def top1_link_per_account(r: Roles) -> DataFrame:
    return registry.top_link(r.links, r.personas)


@query("links", """
    SELECT account_id, CASE WHEN bool_or(review_status = 'verified') THEN 'verified' WHEN bool_and(review_status = 'rejected') THEN 'rejected' ELSE 'pending' END AS review_status,
        count(*) AS links FROM links GROUP BY 1""")
def review_status_rollup(r: Roles) -> DataFrame:
    return registry.status_of_accounts(r.links)


@query("links", """
    SELECT account_id, count(DISTINCT persona_id) AS personas, min(persona_id) AS first_persona FROM links WHERE review_status = 'verified'
    GROUP BY 1 HAVING count(DISTINCT persona_id) > 1""")
def multi_persona_detect(r: Roles) -> DataFrame:
    return registry.shared_accounts(r.links)


@query("channel_metrics", "SELECT channel_id, day, subscribers, views FROM channel_metrics QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY day DESC) = 1")
def latest_metric_per_channel(r: Roles) -> DataFrame:
    return growth.latest(r.channel_metrics)


def _asof(column: str, days: int) -> str:
    oldest = days + growth.slack(days)
    return f"""(SELECT max_by(struct_pack(d := p.day, v := p.{column}), p.day) FROM channel_metrics p WHERE p.channel_id = e.channel_id AND p.{column} IS NOT NULL
        AND CAST(p.day AS DATE) BETWEEN CAST(e.last_date AS DATE) - {oldest} AND CAST(e.last_date AS DATE) - {days})"""


@query("channel_metrics", f"""
    WITH ends AS (
        SELECT channel_id, min(day) AS first_date, max(day) AS last_date, count(*) AS history_points, arg_max(struct_pack(s := subscribers, v := views), day) AS m
        FROM channel_metrics GROUP BY 1 HAVING count(*) > 1
    ), based AS (
        SELECT e.*, {_asof("subscribers", 7)} AS b7, {_asof("subscribers", 30)} AS b30, {_asof("subscribers", 90)} AS b90, {_asof("views", 30)} AS v30 FROM ends e
    )
    SELECT channel_id, first_date, last_date, history_points,
        m.s - b7.v AS subscribers_delta_7d, CASE WHEN m.s IS NOT NULL THEN b7.d END AS baseline_7d, m.s - b30.v AS subscribers_delta_30d,
        CASE WHEN m.s IS NOT NULL THEN b30.d END AS baseline_30d, m.s - b90.v AS subscribers_delta_90d, CASE WHEN m.s IS NOT NULL THEN b90.d END AS baseline_90d,
        m.v - v30.v AS views_delta_30d, CASE WHEN m.v IS NOT NULL THEN v30.d END AS views_baseline_30d
    FROM based""")  # fmt: skip
def growth_asof(r: Roles) -> DataFrame:
    return growth.growth(r.channel_metrics)


@query("channel_metrics", """
    WITH days AS (SELECT max(day) AS last FROM channel_metrics), done AS (SELECT channel_id FROM channel_metrics, days WHERE day = '2024-01-05')
    SELECT DISTINCT channel_id FROM channel_metrics WHERE channel_id NOT IN (SELECT channel_id FROM done) ORDER BY 1 LIMIT 50""")
def due_channels_batch(r: Roles) -> DataFrame:
    channels = r.channel_metrics.select("channel_id", F.lit("live").alias("scan_status")).distinct()
    return growth.due_channels(channels, r.channel_metrics, r.channel_metrics.where("false"), "2024-01-05")


@query("videos", "SELECT title, count(*) AS n, CAST(round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS DOUBLE) AS percent FROM videos GROUP BY 1")
def catalog_type_breakdown(r: Roles) -> DataFrame:
    return summary.breakdown(r.videos, "title")


@query("videos", "SELECT count(*) AS total, count(*) FILTER (status = 'F') AS n_f, count(*) FILTER (status = 'O') AS n_o, count(*) FILTER (status = 'P') AS n_p FROM videos")
def status_filter_counts(r: Roles) -> DataFrame:
    return summary.status_counts(r.videos, "status", ["F", "O", "P"])


_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '')"


@query("", f"SELECT {_HOST} AS host, count(DISTINCT page_id) AS members FROM pages GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def domain_topk(r: Roles) -> DataFrame:
    pages = r.table("pages").select("page_id", urls.host(F.col("url")).alias("host"))
    return summary.top_values(pages, "host", "page_id", 20)


@query("videos", """
    WITH tries AS (SELECT channel_id, count(*) AS attempts FROM videos WHERE status = 'F' GROUP BY 1)
    SELECT video_id AS job_id, channel_id, coalesce(attempts, 0) AS attempts FROM videos LEFT JOIN tries USING (channel_id) ORDER BY attempts, job_id LIMIT 100""")
def fair_queue_topk(r: Roles) -> DataFrame:
    return selection.fair(r.videos.select(F.col("video_id").alias("job_id"), "channel_id"), r.videos.where("status = 'F'"), 100).select("job_id", "channel_id", "attempts")


@query("videos", """
    SELECT channel_id, video_id, comments, CAST(row_number() OVER (PARTITION BY channel_id ORDER BY comments DESC, video_id) AS INTEGER) AS rank FROM videos
    QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY comments DESC, video_id) <= 3""")
def topk_videos_per_channel(r: Roles) -> DataFrame:
    return selection.top_per_group(r.videos.select("channel_id", "video_id", "comments"), "channel_id", [F.desc("comments"), "video_id"], 3)


@query("videos", """
    WITH done AS (SELECT DISTINCT channel_id, year, true AS had FROM videos WHERE status = 'P')
    SELECT channel_id, year, video_id, comments, coalesce(had, false) AS had FROM videos LEFT JOIN done USING (channel_id, year)
    QUALIFY row_number() OVER (PARTITION BY channel_id, year ORDER BY comments DESC, video_id) = 1""")
def per_year_representative(r: Roles) -> DataFrame:
    return selection.per_year(r.videos, r.videos.where("status = 'P'"))


@query("personas", """
    WITH n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS c FROM personas)
    SELECT id FROM n WHERE (i - (7777 % c) + c) % c < 30""")
def rotating_cursor_batch(r: Roles) -> DataFrame:
    return selection.rotating(r.personas.select("id"), "id", 7777, 30)


@query("sightings", """
    WITH one AS (
        SELECT creator_id AS channel_id, video_id, source_type, viewer_id, min(observed_at) AS first_seen, max(observed_at) AS last_seen, count(*) AS appearances
        FROM sightings WHERE trim(viewer_id) <> '' AND month(observed_at) <= 6 GROUP BY 1, 2, 3, 4
    ), two AS (
        SELECT creator_id AS channel_id, video_id, source_type, viewer_id, min(observed_at) AS first_seen, max(observed_at) AS last_seen, count(*) AS appearances
        FROM sightings WHERE trim(viewer_id) <> '' AND month(observed_at) >= 4 GROUP BY 1, 2, 3, 4
    )
    SELECT channel_id, video_id, source_type, viewer_id, min(first_seen) AS first_seen, max(last_seen) AS last_seen, max(appearances) AS appearances
    FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY 1, 2, 3, 4""")
def snapshot_merge(r: Roles) -> DataFrame:
    rows = overlap.known_viewers(r.sightings).select(F.col("creator_id").alias("channel_id"), "video_id", "viewer_id", "source_type", F.col("observed_at").alias("timestamp"))
    month = F.month("timestamp")
    return presence.merge(presence.rollup(rows.where(month <= 6)), presence.rollup(rows.where(month >= 4)))


@query("sightings", """
    WITH old AS (SELECT DISTINCT creator_id, viewer_id FROM sightings WHERE month(observed_at) <= 6)
    SELECT creator_id, viewer_id, arg_min(video_id, struct_pack(a := observed_at, b := video_id)) AS video_id, min(observed_at) AS observed_at FROM sightings
    WHERE month(observed_at) > 6 AND NOT EXISTS (SELECT 1 FROM old WHERE old.creator_id = sightings.creator_id AND old.viewer_id = sightings.viewer_id) GROUP BY 1, 2""")
def insert_if_absent(r: Roles) -> DataFrame:
    rows = r.sightings.select("creator_id", "viewer_id", "video_id", "observed_at")
    return merge.absent(rows.where(F.month("observed_at") > 6), rows.where(F.month("observed_at") <= 6), ["creator_id", "viewer_id"], ["observed_at", "video_id"])


_CHANGES = """
    WITH changes AS (
        SELECT id, CASE WHEN CAST(substr(id, 4) AS INTEGER) % 2 = 0 THEN 'verified' END AS review_status FROM personas WHERE CAST(substr(id, 4) AS INTEGER) % 3 = 0
        UNION ALL SELECT 'new' || n_nationkey, 'pending' FROM nation
    )"""


def _changes(r: Roles) -> DataFrame:
    number = F.substring("id", 4, 10).cast("int")
    known = r.personas.where(number % 3 == 0).select("id", F.when(number % 2 == 0, "verified").alias("review_status"))
    return known.unionByName(r.table("nation").select(F.concat(F.lit("new"), F.col("n_nationkey")).alias("id"), F.lit("pending").alias("review_status")))


@query("personas", _CHANGES + """
    SELECT c.id, CASE WHEN p.id IS NULL THEN 'added' WHEN c.review_status IS NULL OR c.review_status IS NOT DISTINCT FROM p.review_status THEN 'unchanged' ELSE 'updated' END AS action
    FROM changes c LEFT JOIN personas p ON p.id = c.id""")
def upsert_diff(r: Roles) -> DataFrame:
    return merge.diff(r.personas, _changes(r), "id")


@query("personas", _CHANGES + """
    SELECT coalesce(p.id, c.id) AS id, canonical_name, coalesce(c.review_status, p.review_status) AS review_status FROM personas p FULL JOIN changes c ON p.id = c.id""")
def upsert_result(r: Roles) -> DataFrame:
    return merge.upsert(r.personas, _changes(r), "id")


@query("personas affiliations", """
    SELECT p.id, coalesce(nullif(canonical_name, ''), organization) AS canonical_name, p.review_status FROM personas p LEFT JOIN affiliations ON persona_id = p.id""")
def patch_if_empty(r: Roles) -> DataFrame:
    patches = r.affiliations.select(F.col("persona_id").alias("id"), F.col("organization").alias("canonical_name"))
    return merge.patch_if_empty(r.personas, patches, "id", ["canonical_name"])


@query("accounts links", """
    SELECT id, handle FROM accounts a WHERE platform = 'twitch' AND NOT EXISTS (SELECT 1 FROM links WHERE account_id = a.id AND review_status = 'rejected')
        AND (handle IS NULL OR handle NOT IN (SELECT handle FROM accounts WHERE platform = 'x' AND handle IS NOT NULL))""")
def append_only_inbox(r: Roles) -> DataFrame:
    known = r.links.where("review_status = 'rejected'").select(F.col("account_id").alias("id"), F.lit(None).cast("string").alias("handle"))
    known = known.unionByName(r.accounts.where("platform = 'x'").select(F.lit(None).cast("string").alias("id"), "handle"))
    return merge.absent_by_either(r.accounts.where("platform = 'twitch'").select("id", "handle"), known, "id", "handle")


@query("links personas", """
    WITH m AS (SELECT 'per' || k AS loser, 'per' || (k - 1) AS keeper FROM range(1, 97, 2) t(k)), moved AS (
        SELECT id AS link_id, account_id, coalesce(keeper, persona_id) AS persona_id, keeper FROM links LEFT JOIN m ON persona_id = loser
    ), n AS (
        SELECT *, row_number() OVER (PARTITION BY account_id, persona_id ORDER BY keeper IS NOT NULL, link_id) AS n FROM moved
    ) SELECT link_id, account_id, persona_id, CASE WHEN n > 1 THEN 'rejected' WHEN keeper IS NOT NULL THEN 'repointed' ELSE 'kept' END AS state FROM n""")
def merge_repoint(r: Roles) -> DataFrame:
    odd = r.spark.range(1, 97, 2)
    merges = odd.select(F.concat(F.lit("per"), F.col("id")).alias("loser"), F.concat(F.lit("per"), F.col("id") - 1).alias("keeper"))
    return merge.repoint(r.links.select(F.col("id").alias("link_id"), "account_id", "persona_id"), merges)


@query("links accounts", "SELECT id, platform FROM accounts WHERE id NOT IN (SELECT account_id FROM links WHERE review_status = 'verified')")
def retire_unbacked(r: Roles) -> DataFrame:
    backing = r.links.where("review_status = 'verified'").select(F.col("account_id").alias("id"))
    return merge.retire(r.accounts.select("id", "platform"), backing, "id")


@query("personas accounts interactions", """
    WITH f AS (
        SELECT 'accounts' AS name, CAST(count(*) AS VARCHAR) AS value FROM accounts
        UNION ALL SELECT 'interactions', CAST(count(*) AS VARCHAR) FROM interactions
        UNION ALL SELECT 'verified', CAST(count(*) AS VARCHAR) FROM personas WHERE review_status = 'verified'
    ) SELECT substr(sha256(string_agg(name || '=' || coalesce(value, ''), ';' ORDER BY name)), 1, 16) AS fingerprint FROM f""")
def fingerprint_inputs(r: Roles) -> DataFrame:
    def count(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("name"), "value")

    return checks.fingerprint([count("accounts", r.accounts), count("interactions", r.facts), count("verified", r.personas.where("review_status = 'verified'"))])


_SEALED = {"accounts": 100, "personas": 10, "nation": 26}


@query("personas accounts", """
    SELECT 'accounts' AS name, count(*) AS actual, CAST(100 AS BIGINT) AS expected, count(*) >= 100 AS ok FROM accounts
    UNION ALL SELECT 'nation', count(*), 26, count(*) >= 26 FROM nation UNION ALL SELECT 'personas', count(*), 10, count(*) >= 10 FROM personas""")
def parity_check(r: Roles) -> DataFrame:
    return checks.parity({"accounts": r.accounts, "personas": r.personas, "nation": r.table("nation")}, _SEALED)


@query("", """
    WITH cited AS (SELECT DISTINCT doc_id AS evidence_id FROM labels)
    SELECT 'e' || doc_id AS evidence_id FROM documents WHERE doc_id NOT IN (SELECT evidence_id FROM cited)""")
def orphan_evidence_anti(r: Roles) -> DataFrame:
    evidence = r.table("documents").select(F.concat(F.lit("e"), F.col("doc_id")).alias("evidence_id"))
    subjects = r.table("labels").select(F.array(F.concat(F.lit("e"), F.col("doc_id"))).alias("evidence_ids"))
    return checks.orphan_evidence(evidence, subjects)


@query("links personas", 'SELECT persona_id, count(*) AS "rows" FROM links WHERE persona_id NOT IN (SELECT id FROM personas WHERE review_status <> \'rejected\') GROUP BY 1')
def unknown_references(r: Roles) -> DataFrame:
    return checks.unknown_references(r.links, "persona_id", r.personas.where("review_status <> 'rejected'"), "id")


@query("sightings", """
    SELECT creator_id, video_id, viewer_id, source_type, count(*) AS copies FROM sightings GROUP BY 1, 2, 3, 4 HAVING count(*) > 1""")
def duplicate_keys(r: Roles) -> DataFrame:
    keys = ["creator_id", "video_id", "viewer_id", "source_type"]
    return checks.duplicates(r.sightings.select(*keys), keys)


@query("sightings", """
    SELECT count(*) AS "rows", count(DISTINCT (creator_id, video_id, source_type, viewer_id)) AS unique_keys, count(DISTINCT viewer_id) AS unique_viewers,
        count(*) FILTER (source_type = 'live_chat') AS live_rows, count(*) FILTER (source_type = 'comment') AS comment_rows FROM sightings""")
def presence_quality(r: Roles) -> DataFrame:
    return presence.quality(r.sightings.withColumnRenamed("creator_id", "channel_id"))


@query("sightings", """
    SELECT video_id, viewer_id, min(observed_at) AS first_at, max(observed_at) AS last_at, count(*) AS appearances,
        coalesce(arg_min(q, struct_pack(a := observed_at, b := q)) FILTER (q <> 'missing'), 'missing') AS quality
    FROM (SELECT *, CASE WHEN source_type = 'comment' THEN 'exact' ELSE 'missing' END AS q FROM sightings) GROUP BY 1, 2""")
def viewer_per_video(r: Roles) -> DataFrame:
    rows = r.sightings.select("video_id", "viewer_id", F.col("observed_at").alias("interaction_at"), F.when(F.col("source_type") == "comment", "exact").otherwise("missing").alias("quality"))
    return presence.viewer_per_video(rows)


_NOW = "2026-01-01 00:00:00"


@query("", f"""
    WITH c AS (
        SELECT doc_id, lower(concat_ws(' ', source, text, '@' || lang)) AS t, lower('@' || lang) AS h, n_chars, doc_id % 4 AS sources,
            CASE WHEN doc_id % 5 = 0 THEN 'polygon x' ELSE 'none' END AS agency, TIMESTAMP '2025-06-01' + INTERVAL (doc_id % 300) DAY AS seen FROM documents
    ), s AS (
        SELECT *, {" + ".join(f"CASE WHEN contains(t, '{k}') THEN 1 ELSE 0 END" for k in scores.THAI_KEYWORDS)} AS hits,
            length(regexp_replace(t, '[^\\x{{0e00}}-\\x{{0e7f}}]', '', 'g')) AS letters,
            {" OR ".join(f"contains(t, '{k}')" for k in scores.AGENCIES)} AS known, contains(agency, 'polygon') AS member,
            {" OR ".join(f"contains(lower(concat_ws(' ', source_, text_)), '{k}')" for k in scores.SIGNAL_TERMS)} AS term
        FROM (SELECT c.*, d.source AS source_, d.text AS text_ FROM c JOIN documents d USING (doc_id))
    ), f AS (
        SELECT *, least(1.0, round(CASE WHEN letters >= 5 THEN 0.4 WHEN letters >= 1 THEN 0.2 ELSE 0.0 END + least(0.35, hits * CAST(0.15 AS DOUBLE))
            + CASE WHEN known THEN 0.3 ELSE 0.0 END + CASE WHEN regexp_matches(replace(h, '@', ''), '(th|thai)$') THEN 0.15 ELSE 0.0 END, 2)) AS conf,
            (epoch(TIMESTAMP '{_NOW}') - epoch(seen)) // 86400 AS days FROM s
    )
    SELECT doc_id, CAST(conf AS DOUBLE) AS confidence,
        CASE WHEN days > 90 THEN 'DORMANT' WHEN conf < 0.2 AND NOT (term OR member) THEN 'REJECT' WHEN n_chars < 100 AND sources < 2 THEN 'REVIEW'
            WHEN member THEN 'ACCEPT' WHEN conf >= 0.5 AND (term OR member) THEN 'ACCEPT' WHEN conf >= 0.35 OR term OR member THEN 'REVIEW' ELSE 'REJECT' END AS status
    FROM f""")  # fmt: skip
def candidate_filter_decision(r: Roles) -> DataFrame:
    d = r.table("documents")
    seen = F.date_format(F.expr("timestamp'2025-06-01 00:00:00' + make_dt_interval(cast(doc_id % 300 as int))"), "yyyy-MM-dd'T'HH:mm:ss")
    name, text, handle = F.col("source"), F.col("text"), F.concat(F.lit("@"), F.col("lang"))
    made = scores.candidate_decision(
        F.lit(None).cast("boolean"), name, text, handle, F.col("n_chars"), F.col("doc_id") % 4,
        F.when(F.col("doc_id") % 5 == 0, "polygon x").otherwise("none"), seen, F.lit(_NOW).cast("timestamp"),
    )
    return d.select("doc_id", scores.thai_confidence(name, text, handle).alias("confidence"), made["status"].alias("status"))


@query("", f"""
    WITH p AS (SELECT c_custkey AS id, CAST(round(c_acctbal * 20) AS BIGINT) AS subs, c_custkey % 15 AS streams, c_custkey % 3 = 0 AS live,
        CASE WHEN c_custkey % 6 <> 0 THEN epoch(TIMESTAMP '{_NOW}' - INTERVAL (c_custkey % 100) HOUR) END AS last FROM customer)
    SELECT id, round(0.6 * CASE WHEN subs <= 0 THEN 0.0 ELSE greatest(0.0, least(1.0, (log10(CAST(greatest(10, subs) AS DOUBLE)) - 2.0) / 3.7)) END
        + 0.2 * CASE WHEN last IS NULL THEN 1.0 ELSE greatest(0.0, least(1.0, (epoch(TIMESTAMP '{_NOW}') - last) / 3600.0 / 72.0)) END
        + 0.1 * CASE WHEN live THEN 1.0 ELSE 0.0 END + 0.1 * CASE WHEN streams <= 0 THEN 1.0 ELSE greatest(0.0, 1.0 - least(1.0, streams / 10.0)) END, 4) AS priority,
        CASE WHEN subs >= 100000 THEN 'S' WHEN subs >= 50000 THEN 'A' WHEN subs >= 10000 THEN 'B' WHEN subs >= 1000 THEN 'C' ELSE 'D' END AS tier
    FROM p""")
def priority_score(r: Roles) -> DataFrame:
    key, subs, now = F.col("c_custkey"), F.round(F.col("c_acctbal") * 20).cast("long"), F.lit(_NOW).cast("timestamp")
    last = F.when(key % 6 != 0, F.date_format(F.expr(f"timestamp'{_NOW}' - make_dt_interval(0, cast(c_custkey % 100 as int))"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return r.table("customer").select(key.alias("id"), scores.priority(subs, last, key % 3 == 0, key % 15, now).alias("priority"), scores.tier(subs).alias("tier"))


@query("", f"SELECT page_id, {_HOST} || lower(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '')) AS normalized FROM pages")
def url_normalize(r: Roles) -> DataFrame:
    return r.table("pages").select("page_id", urls.normalized_url(F.col("url")).alias("normalized"))


@query("", """
    WITH u AS (
        SELECT c_custkey AS id, c_custkey % 6 AS k, CASE WHEN c_custkey % 5 = 0 THEN 'About' ELSE 'Slug_' || c_custkey END AS s FROM customer
    )
    SELECT id, CASE WHEN s = 'About' OR k IN (4, 5) THEN NULL ELSE ['easydonate', 'easydonate', 'tipjai', 'streamlabs'][k + 1] END AS platform,
        CASE WHEN s = 'About' OR k IN (4, 5) THEN NULL
            ELSE ['https://easydonate.app/', 'https://easydonate.app/', 'https://tipjai.com/', 'https://streamlabs.com/'][k + 1] || lower(s) || CASE WHEN k = 3 THEN '/tip' ELSE '' END END AS url
    FROM u""")
def donation_link_parse(r: Roles) -> DataFrame:
    key = F.col("c_custkey")
    slug = F.when(key % 5 == 0, "About").otherwise(F.concat(F.lit("Slug_"), key))
    shapes = ["https://ezdn.app/{}", "https://www.easydonate.app/@{}", "https://www.tipjai.com/{}?x=1", "https://streamlabs.com/{}/tip", "https://streamlabs.com/{}", "https://example.org/{}"]
    link = F.element_at(F.array(*[F.concat(F.lit(a), slug, F.lit(b)) for a, b in (s.split("{}") for s in shapes)]), (key % 6 + 1).cast("int"))
    return r.table("customer").select(key.alias("id"), urls.donation_account(link).alias("d")).select("id", "d.platform", "d.url")


@query("", """
    WITH t AS (SELECT page_id, 'see ' || url || ', and (https://m.Example.org/a). ' || url AS t FROM pages), l AS (
        SELECT page_id, unnest(list_distinct(list_transform(regexp_extract_all(t, 'https?://[^\\s<>()\\[\\]"'',]+'), lambda x: regexp_replace(x, '[.,;:!?)]+$', '')))) AS url FROM t
    ) SELECT page_id, url, regexp_replace(regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '^www\\.', ''), '^m\\.', '') AS host FROM l""")
def link_extract(r: Roles) -> DataFrame:
    text = F.concat(F.lit("see "), F.col("url"), F.lit(", and (https://m.Example.org/a). "), F.col("url"))
    return r.table("pages").select("page_id", F.inline(urls.links(text)))


@query("videos", """
    SELECT video_id, CASE WHEN seconds % 50 = 0 THEN -1 ELSE 86400 * (seconds % 2) + 3600 * (seconds % 3) + seconds END AS a,
        CASE WHEN seconds % 50 = 0 OR seconds % 2 = 1 THEN 0 ELSE 3600 * (seconds % 3) + seconds END AS b FROM videos""")
def duration_seconds(r: Roles) -> DataFrame:
    s = F.col("seconds")
    text = F.when(s % 50 == 0, "none").otherwise(F.concat(F.lit("P"), F.when(s % 2 == 1, "1D").otherwise(""), F.lit("T"), F.when(s % 3 > 0, F.concat(s % 3, F.lit("H"))).otherwise(""), s, F.lit("S")))
    return r.videos.select("video_id", times.duration_seconds(text).cast("int").alias("a"), times.clock_seconds(text).cast("int").alias("b"))


@query("accounts", "SELECT id, 'account_' || substr(sha256(platform || ':' || coalesce(platform_id, url)), 1, 20) AS uid FROM accounts")
def uid_hash(r: Roles) -> DataFrame:
    return r.accounts.select("id", urls.uid("account", F.concat_ws(":", "platform", F.coalesce("platform_id", "url"))).alias("uid"))


@query("videos", """
    SELECT video_id, CASE WHEN published_at IS NULL THEN NULL ELSE strftime(strptime(published_at, '%Y-%m-%dT%H:%M:%SZ') - INTERVAL 7 HOUR, '%Y-%m-%dT%H:%M:%S+00:00') END AS utc,
        published_at IS NOT NULL AS zoned FROM videos""")
def iso_parse(r: Roles) -> DataFrame:
    text = F.regexp_replace("published_at", "Z$", "+07:00")
    return r.videos.select("video_id", times.utc_text(text).alias("utc"), times.zoned(text).alias("zoned"))


@query("", """
    WITH top AS (SELECT conv_id, arg_min(text, turn) AS text, count(*) - 1 AS replies FROM conversations GROUP BY 1)
    SELECT 't' || conv_id AS thread_id, c.turn, c.role AS author, CAST(length(c.text) AS INTEGER) AS chars, t.replies, t.replies > 3 AS more
    FROM conversations c JOIN top t USING (conv_id)""")
def api_page_flatten(r: Roles) -> DataFrame:
    """Comment threads as the API nests them: parsed from JSON text and flattened again, with a job for long threads."""
    turns = r.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    page = F.to_json(F.struct(F.struct(F.element_at("t", 1).alias("topLevelComment"), (F.size("t") - 1).alias("totalReplyCount"), F.expr("slice(t, 2, size(t))").alias("replies")).alias("snippet")))
    item = "turn long, role string, text string"
    threads = turns.select("conv_id", F.from_json(page, f"snippet struct<topLevelComment: struct<{item.replace(' ', ': ').replace(',:', ',')}>, totalReplyCount: long, replies: array<struct<{item.replace(' ', ': ').replace(',:', ',')}>>>").alias("p"))
    s = F.col("p.snippet")
    each = F.concat(F.array(s["topLevelComment"]), s["replies"])
    flat = threads.select(F.concat(F.lit("t"), F.col("conv_id")).alias("thread_id"), s["totalReplyCount"].alias("replies"), F.explode(each).alias("c"))
    return flat.select("thread_id", "c.turn", F.col("c.role").alias("author"), F.length("c.text").alias("chars"), "replies", (F.col("replies") > 3).alias("more"))


@query("", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events")
def json_path_extract(r: Roles) -> DataFrame:
    return r.table("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type")


@query("videos", """
    SELECT video_id, CASE WHEN status = 'F' AND seconds % 2 = 0 THEN 'replay_vod' WHEN status = 'F' THEN 'livestream' WHEN seconds BETWEEN 1 AND 60 THEN 'shorts'
        WHEN title LIKE '%LOW%' THEN 'replay_vod' ELSE 'normal_video' END AS video_type,
        CASE WHEN seconds > 180 THEN false WHEN seconds <= 60 THEN true WHEN seconds % 3 = 0 THEN NULL ELSE seconds % 3 = 1 END AS is_short FROM videos""")
def video_type_case(r: Roles) -> DataFrame:
    s = F.col("seconds")
    title = F.regexp_replace("title", "LOW", "live")
    probe = F.when(s <= 60, None).when(s % 3 == 0, None).otherwise(s % 3 == 1)
    return r.videos.select("video_id", scores.video_type(F.col("status") == "F", s % 2 == 0, s, title).alias("video_type"), scores.short_video(s, probe).alias("is_short"))


@query("", """
    WITH m AS (
        SELECT 'c' || (c_custkey % 300) AS channel_id, 's' || (c_custkey % 4) AS source, c_custkey AS o, CAST(round(c_acctbal) AS BIGINT) AS subs,
            CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS description, CASE WHEN c_custkey % 2 = 0 THEN 'Independent' ELSE c_mktsegment END AS agency FROM customer
    ) SELECT channel_id, count(DISTINCT source) AS source_count, max(subs) AS subscribers, coalesce(arg_min(description, o) FILTER (description <> ''), '') AS description,
        coalesce(arg_min(agency, o) FILTER (agency NOT IN ('', 'Independent')), 'Independent') AS agency FROM m GROUP BY 1""")
def multi_source_merge(r: Roles) -> DataFrame:
    key = F.col("c_custkey")
    rows = r.table("customer").select(
        F.concat(F.lit("c"), key % 300).alias("channel_id"), F.concat(F.lit("s"), key % 4).alias("source"), key.alias("source_order"), F.round("c_acctbal").cast("long").alias("subscribers"),
        F.when(key % 3 == 0, "").otherwise(F.col("c_name")).alias("description"), F.when(key % 2 == 0, "Independent").otherwise(F.col("c_mktsegment")).alias("agency"),
    )
    return matching.merged_candidates(rows)


_FOUND = """
    WITH found AS (
        SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 2 = 0 THEN 'twitch' ELSE 'youtube' END AS platform,
            CASE WHEN o_orderkey % 3 = 0 THEN lpad(CAST(o_custkey AS VARCHAR), 6, '0') ELSE '' END AS channel_id, CASE WHEN o_orderkey % 5 = 0 THEN 'h' || o_custkey END AS handle,
            CASE WHEN o_orderkey % 4 = 0 THEN 'http://www.example.org/' || o_custkey || '/?a=b' ELSE '' END AS url FROM orders
    ), hits AS (
        SELECT f.row_id, a.id FROM found f JOIN accounts a ON a.platform = f.platform AND a.platform_id = f.channel_id AND f.channel_id <> ''
        UNION SELECT f.row_id, a.id FROM found f JOIN accounts a ON f.url <> '' AND 'example.org/' || split_part(split_part(f.url, '/', 4), '?', 1) = substr(a.url, 9)
        UNION SELECT f.row_id, a.id FROM found f JOIN accounts a ON a.platform = f.platform AND f.platform <> 'youtube' AND a.handle <> '' AND lower(ltrim(a.handle, '@')) = f.handle
    ), counted AS (SELECT row_id, count(*) AS matches, min(id) AS account_id FROM hits GROUP BY 1)"""


def _found(r: Roles) -> DataFrame:
    key, person = F.col("o_orderkey"), F.col("o_custkey")
    return r.table("orders").select(
        key.alias("row_id"), F.when(key % 2 == 0, "twitch").otherwise("youtube").alias("platform"), F.when(key % 3 == 0, F.lpad(person.cast("string"), 6, "0")).otherwise("").alias("channel_id"),
        F.when(key % 5 == 0, F.concat(F.lit("h"), person)).alias("handle"), F.when(key % 4 == 0, F.concat(F.lit("http://www.example.org/"), person, F.lit("/?a=b"))).otherwise("").alias("url"),
    )


@query("accounts", _FOUND + " SELECT row_id, coalesce(matches, 0) AS matches, account_id FROM found LEFT JOIN counted USING (row_id)")
def account_match_multikey(r: Roles) -> DataFrame:
    return matching.match(_found(r), r.accounts)


@query("accounts", _FOUND + """, c AS (
        SELECT row_id, coalesce(matches, 0) AS m, CASE row_id % 7 WHEN 0 THEN 'vtuber' WHEN 1 THEN 'unrelated' END AS human,
            ['TRUSTED_BASELINE', 'NON_VTUBER', 'VTUBER', 'UNRESOLVED'][row_id % 4 + 1] AS decision, row_id % 11 = 0 AS note FROM found LEFT JOIN counted USING (row_id)
    )
    SELECT row_id, CASE WHEN human = 'vtuber' THEN CASE WHEN note OR m > 1 THEN 'CONFLICT' WHEN m = 1 THEN 'EXISTS_ALREADY' ELSE 'NEW_CONFIRMED_PERSONA' END
        WHEN human = 'unrelated' THEN 'HUMAN_NEGATIVE' WHEN m > 1 THEN 'CONFLICT' WHEN m = 1 THEN 'EXISTS_ALREADY' WHEN decision = 'NON_VTUBER' THEN 'SCREENED_NON_CANONICAL'
        WHEN decision = 'TRUSTED_BASELINE' THEN 'CONFLICT' ELSE 'UNRESOLVED_CANDIDATE' END AS bucket FROM c""")
def reconcile_classification(r: Roles) -> DataFrame:
    key = F.col("row_id")
    human = F.when(key % 7 == 0, "vtuber").when(key % 7 == 1, "unrelated")
    decision = F.element_at(F.array(*[F.lit(x) for x in ("TRUSTED_BASELINE", "NON_VTUBER", "VTUBER", "UNRESOLVED")]), (key % 4 + 1).cast("int"))
    found = matching.match(_found(r), r.accounts)
    return found.select(key, matching.classified(human, key % 11 == 0, F.lit(True), decision, F.col("matches"))["bucket"].alias("bucket"))


@query("links", """
    WITH o AS (SELECT account_id, count(DISTINCT persona_id) AS owners, min(persona_id) AS p FROM links WHERE review_status = 'verified' GROUP BY 1)
    SELECT account_id, owners, CASE WHEN owners = 1 THEN p END AS persona_id FROM o""")
def unique_owner(r: Roles) -> DataFrame:
    kept = r.links.where("review_status = 'verified'").select("account_id", "persona_id")
    return matching.unique_owner(kept, kept, "account_id")


@query("", """
    SELECT count(*) AS records, count(*) FILTER (role = 'user') AS comments, count(*) FILTER (role = 'assistant') AS replies, count(DISTINCT conv_id) AS people FROM conversations""")
def campaign_totals(r: Roles) -> DataFrame:
    kind = F.when(F.col("role") == "user", "comment").when(F.col("role") == "assistant", "reply").otherwise("other")
    return summary.campaign(r.table("conversations").select(kind.alias("kind"), F.col("conv_id").alias("person")))


@query("videos", """
    SELECT channel_id, count(*) AS videos, min(published_at) AS first_at, max(published_at) AS last_at,
        CAST(round(count(published_at) * 100.0 / count(*), 2) AS DOUBLE) AS dated_percent FROM videos GROUP BY 1""")
def coverage_report(r: Roles) -> DataFrame:
    return summary.coverage(r.videos)


@query("", """
    WITH days AS (
        SELECT *, make_date(CAST(year(ts) AS INTEGER), 3, 8) AS spring, make_date(CAST(year(ts) AS INTEGER), 11, 1) AS autumn FROM events
    ), zoned AS (
        SELECT *, CASE WHEN ts >= spring + to_days(CAST((7 - dayofweek(spring)) % 7 AS INTEGER)) + INTERVAL 10 HOUR
            AND ts < autumn + to_days(CAST((7 - dayofweek(autumn)) % 7 AS INTEGER)) + INTERVAL 9 HOUR THEN 7 ELSE 8 END AS behind FROM days
    )
    SELECT strftime(ts - to_hours(behind), '%Y-%m-%d') AS day, event_type AS stage, CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) AS units
    FROM zoned GROUP BY 1, 2""")
def quota_per_day(r: Roles) -> DataFrame:
    rows = r.table("events").select(F.col("ts").alias("at"), F.col("event_type").alias("stage"), F.round("value").cast("long").alias("units"))
    return summary.per_day(rows)


@query("videos", """
    SELECT status, count(*) AS jobs, CAST(sum(seconds) AS BIGINT) AS requests, CAST(1000000000 - sum(sum(seconds)) OVER () AS BIGINT) AS remaining FROM videos GROUP BY 1""")
def backfill_backlog(r: Roles) -> DataFrame:
    return summary.backlog(r.videos.withColumn("requests", F.col("seconds")), 1_000_000_000)


@query("channel_metrics", """
    WITH c AS (SELECT DISTINCT channel_id FROM channel_metrics), j AS (SELECT channel_id, unnest(['live_chat', 'comment']) AS source FROM c)
    SELECT channel_id || ':' || source AS job_id, channel_id, source, 1.0::DOUBLE AS priority FROM j""")
def job_plan(r: Roles) -> DataFrame:
    channels = r.channel_metrics.select("channel_id").distinct()
    none = channels.where("false").withColumn("priority", F.lit(1.0))
    return selection.jobs(channels, ["live_chat", "comment"], none)


@query("", """
    WITH j AS (
        SELECT o_orderkey AS job_id, CAST(round(o_totalprice) AS BIGINT) AS priority, strftime(o_orderdate, '%Y-%m-%d') AS created_at FROM orders WHERE o_orderstatus = 'O'
    ) SELECT * FROM j ORDER BY priority DESC, created_at, job_id LIMIT 25""")
def claimable_jobs(r: Roles) -> DataFrame:
    rows = r.table("orders").select(
        F.col("o_orderkey").alias("job_id"), F.round("o_totalprice").cast("long").alias("priority"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"),
        F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"),
    )
    return selection.claimable(rows, 25).drop("status")
