"""More queries of the library: text rules, checks and identities over the synthetic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crowdweave.functions import records, scores, times, urls
from crowdweave.operators import checks, matching, merge
from crowdweave.plans.queries import _CHANGES, _changes, query
from crowdweave.plans.roles import Roles


def _key():
    return F.col("c_custkey")


@query("", """
    WITH u AS (SELECT c_custkey AS id, c_custkey % 5 AS k, 'Name' || c_custkey AS n FROM customer)
    SELECT id, CASE k WHEN 0 THEN 'youtube' WHEN 1 THEN 'twitch' WHEN 2 THEN 'tiktok' WHEN 3 THEN 'x' END AS platform,
        CASE WHEN k < 4 THEN n END AS handle FROM u""")
def account_parse(r: Roles) -> DataFrame:
    shapes = ["https://www.youtube.com/@{}", "twitch.tv/{}", "https://tiktok.com/@{}", "https://twitter.com/{}", "https://youtube.com/watch/{}"]
    link = F.element_at(F.array(*[F.concat(F.lit(s[:-2]), F.lit("Name"), _key()) for s in shapes]), (_key() % 5 + 1).cast("int"))
    return r.table("customer").select(_key().alias("id"), urls.account_of(link).alias("a")).select("id", "a.platform", "a.handle")


@query("", """
    SELECT page_id, regexp_replace(split_part(url, '://', 1), '.*', lower(split_part(url, '://', 1))) || '://' || lower(regexp_extract(url, '://([^/?#]+)', 1))
        || CASE WHEN regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') END
        || CASE WHEN contains(url, '?') THEN '?' || regexp_extract(url, '\\?([^#]*)', 1) ELSE '' END AS canonical FROM pages""")
def canonical_urls(r: Roles) -> DataFrame:
    return r.table("pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query("accounts", "SELECT id, nullif(lower(ltrim(trim(handle), '@')), '') AS handle, platform || ':' || coalesce(nullif(platform_id, ''), lower(ltrim(handle, '@')), '') AS inbox FROM accounts")
def handles_and_inbox_keys(r: Roles) -> DataFrame:
    key = F.coalesce(records.inbox_key(F.col("platform"), F.col("platform_id"), F.col("handle")), F.lit(""))
    key = F.when(F.col("platform_id").isNull() & F.col("handle").isNull(), F.concat("platform", F.lit(":"))).otherwise(key)
    return r.accounts.select("id", urls.normalized_handle(F.col("handle")).alias("handle"), key.alias("inbox"))


@query("", """
    SELECT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS identity_key FROM documents""")
def identity_keys(r: Roles) -> DataFrame:
    return r.table("documents").select("doc_id", records.identity_key(F.col("text")).alias("identity_key"))


@query("", """
    SELECT doc_id, regexp_matches(text, 'AIza[0-9A-Za-z_-]{35}|-----BEGIN [A-Z ]*PRIVATE KEY-----|gh[pousr]_[0-9A-Za-z]{36}|ya29\\.[0-9A-Za-z_-]+') AS secret FROM documents""")
def secret_scan(r: Roles) -> DataFrame:
    return r.table("documents").select("doc_id", checks.holds_secret(F.col("text")).alias("secret"))


@query("", """
    SELECT event_id, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'RATE_LIMITED' WHEN event_type = 'error' THEN 'COMMENTS_DISABLED' ELSE 'EXTRACTION_FAILURE' END AS kind,
        least(3600, CAST(60 * pow(2, event_id % 9) AS BIGINT)) AS wait FROM events""")
def error_outcomes(r: Roles) -> DataFrame:
    message = F.when((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0), "HTTP 429").when(F.col("event_type") == "error", "commentsDisabled").otherwise("other")
    return r.table("events").select("event_id", scores.error_kind(message).alias("kind"), times.backoff(F.col("event_id") % 9 + 1).alias("wait"))


@query("", """
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS partial,
        floor((epoch(TIMESTAMP '2026-01-01 06:00:00') - epoch(o_orderdate)) / 86400) AS days FROM orders""")
def partial_dates(r: Roles) -> DataFrame:
    at, key = F.col("o_orderdate"), F.col("o_orderkey")
    month, day = F.when(key % 3 > 0, F.month(at)), F.when(key % 3 == 2, F.dayofmonth(at))
    now = F.lit("2026-01-01 06:00:00").cast("timestamp")
    return r.table("orders").select(key.alias("id"), times.partial_date(F.year(at), month, day).alias("partial"), times.elapsed_days(at.cast("timestamp"), now).cast("double").alias("days"))


@query("videos", """
    SELECT video_id, CASE WHEN published_at IS NULL THEN 'missing' WHEN published_at < '1996-01-01' THEN 'before' ELSE 'exact' END AS quality,
        published_at >= '1995-01-01' AND published_at < '1997-01-01' AS in_range FROM videos""")
def date_quality(r: Roles) -> DataFrame:
    at = F.col("published_at")
    return r.videos.select("video_id", records.date_quality(at, F.lit("1996-01-01")).alias("quality"), ((at >= "1995-01-01") & (at < "1997-01-01")).alias("in_range"))


@query("", """
    SELECT page_id, regexp_matches(url, '^https://[^/?#@\\s]+(?:[/?#]|$)') AS public, CASE WHEN page_id % 4 = 0 THEN true ELSE page_id % 4 = 1 END AS enabled FROM pages""")
def public_and_enabled(r: Roles) -> DataFrame:
    flag = F.element_at(F.array(F.lit(None).cast("string"), F.lit(" Yes "), F.lit("no"), F.lit("0")), (F.col("page_id") % 4 + 1).cast("int"))
    return r.table("pages").select("page_id", records.public_https(F.col("url")).alias("public"), records.truthy(flag).alias("enabled"))


@query("", """
    SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'person_h' || c_custkey ELSE 'person_' || regexp_replace(lower(c_name), '[^a-z0-9_]', '', 'g') END AS person,
        CASE WHEN c_custkey % 7 = 0 THEN 'sub' ELSE 'main' END AS kind, 'UU' || c_custkey AS uploads FROM customer""")
def person_identities(r: Roles) -> DataFrame:
    handle = F.when(_key() % 2 == 0, F.concat(F.lit("@H"), _key())).otherwise("")
    name = F.when(_key() % 7 == 0, F.concat(F.col("c_name"), F.lit(" Music"))).otherwise(F.col("c_name"))
    channel = F.concat(F.lit("UC"), _key())
    return r.table("customer").select(
        _key().alias("id"), records.person_id(channel, F.col("c_name"), handle).alias("person"), records.channel_kind(name).alias("kind"), records.uploads_playlist(channel).alias("uploads")
    )


@query("", """
    SELECT 'i' || (c_custkey % 200) AS identity_id, array_to_string(list_sort(list_distinct(flatten(list(['a' || (c_custkey % 7), 'b' || (c_custkey % 3)])))), '|') AS aliases,
        min('2024-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0')) AS discovered_at, count(DISTINCT c_custkey % 200 + CASE WHEN c_custkey % 1000 = 0 THEN 1 ELSE 0 END) > 1 AS conflict
    FROM customer GROUP BY 1""")
def identity_merge(r: Roles) -> DataFrame:
    rows = r.table("customer").select(
        F.concat(F.lit("i"), _key() % 200).alias("identity_id"), F.array(F.concat(F.lit("a"), _key() % 7), F.concat(F.lit("b"), _key() % 3)).alias("aliases"),
        F.concat(F.lit("2024-01-"), F.lpad((_key() % 28 + 1).cast("string"), 2, "0")).alias("discovered_at"), (_key() % 200 + F.when(_key() % 1000 == 0, 1).otherwise(0)).alias("name"),
    )
    return matching.merged_identities(rows)


@query("links", "SELECT account_id, count(DISTINCT persona_id) AS versions FROM links WHERE review_status = 'pending' GROUP BY 1 HAVING count(DISTINCT persona_id) > 1")
def correction_conflicts(r: Roles) -> DataFrame:
    return checks.conflicting(r.links.where("review_status = 'pending'"), ["account_id"], "persona_id")


def batch_rows(r: Roles) -> DataFrame:
    """Conversations as batch files: their turns, the last one as state, and a manifest that every fourth gets wrong."""
    own = Window.partitionBy("conv_id")
    turns = r.table("conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("payload"))
    numbered = turns.withColumns({"row_number": F.row_number().over(own.orderBy("turn")), "c": F.count(F.lit(1)).over(own)})
    rows = numbered.select("conv_id", "row_number", F.when(F.col("row_number") == F.col("c"), "state").otherwise("event").alias("kind"), "payload")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_number", "payload"))), lambda x: x["payload"]), "\n")
    wrong = F.col("conv_id") % 4
    manifest = rows.groupBy("conv_id").agg((F.count(F.lit(1)) + 1).cast("int").alias("row_number"), F.sha2(listed, 256).alias("sha256"), F.count(F.lit(1)).cast("int").alias("n")).select(
        "conv_id", "row_number", F.lit("batch_manifest").alias("kind"),
        F.to_json(F.struct(F.when(wrong == 2, "0").otherwise(F.col("sha256")).alias("sha256"), (F.col("n") + F.when(wrong == 1, 1).otherwise(0)).alias("rows"))).alias("payload"),
    )
    return rows.unionByName(manifest)


@query("", """
    WITH rows_ AS (
        SELECT 'p' || conv_id AS path, turn, coalesce(text, '') AS payload, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS c, conv_id FROM conversations
    ) SELECT path, CAST(max(c) - 1 AS INTEGER) AS events, CASE WHEN conv_id % 4 = 1 THEN 'row count differs' WHEN conv_id % 4 = 2 THEN 'digest differs' END AS problem FROM rows_ GROUP BY path, conv_id""")
def batch_validation(r: Roles) -> DataFrame:
    return checks.batches(batch_rows(r).withColumn("path", F.concat(F.lit("p"), F.col("conv_id"))).drop("conv_id"))


@query("personas", _CHANGES + """
    , acts AS (SELECT CASE WHEN p.id IS NULL THEN 'added' WHEN c.review_status IS NULL OR c.review_status IS NOT DISTINCT FROM p.review_status THEN 'unchanged' ELSE 'updated' END AS action
        FROM changes c LEFT JOIN personas p ON p.id = c.id)
    SELECT action, count(*) AS "rows" FROM acts GROUP BY 1""")
def change_counts(r: Roles) -> DataFrame:
    return merge.diff(r.personas, _changes(r), "id").groupBy("action").agg(F.count(F.lit(1)).alias("rows"))


@query("", """
    SELECT min(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS lo, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS hi, count(*) AS jobs,
        count(*) FILTER (event_type = 'error') AS failed FROM events""")
def json_job_report(r: Roles) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return r.table("events").agg(F.min(k).alias("lo"), F.max(k).alias("hi"), F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("event_type") == "error").alias("failed"))


@query("links", "SELECT id, count(*) OVER (PARTITION BY persona_id, review_status) > 50 AS shared FROM links")
def shared_channel_flags(r: Roles) -> DataFrame:
    return r.links.select("id", (F.count(F.lit(1)).over(Window.partitionBy("persona_id", "review_status")) > 50).alias("shared"))


@query("videos", """
    SELECT channel_id, count(*) FILTER (published_at > before) AS newer_after_older FROM (
        SELECT channel_id, published_at, lag(published_at) OVER (PARTITION BY channel_id ORDER BY comments, video_id) AS before FROM videos) GROUP BY 1""")
def monotonic_pages(r: Roles) -> DataFrame:
    """How often a page's next video is newer than the one before: a source that should run from new to old."""
    before = F.lag("published_at").over(Window.partitionBy("channel_id").orderBy("comments", "video_id"))
    return r.videos.withColumn("before", before).groupBy("channel_id").agg(F.count_if(F.col("published_at") > F.col("before")).alias("newer_after_older"))


@query("accounts", """
    SELECT platform, count(*) AS channels, count(*) * 21 AS catalog_units, CAST(ceil(round(count(*) * 21 * 1.2, 6)) AS BIGINT) AS catalog_ceiling FROM accounts GROUP BY 1""")
def request_estimates(r: Roles) -> DataFrame:
    counts = r.accounts.groupBy("platform").agg(F.count(F.lit(1)).alias("channels"))
    return counts.withColumn("e", records.requests_needed(F.col("channels"))).select("platform", "channels", "e.catalog_units", "e.catalog_ceiling")


@query("", f"""
    WITH c AS (
        SELECT doc_id, lower(concat_ws(' ', source, text)) AS t, '@' || lang AS h, CASE WHEN lang = 'es' THEN 'TH' ELSE '' END AS country, doc_id % 3 AS k FROM documents
    ), s AS (
        SELECT *, CASE WHEN country = 'TH' THEN 0.35 ELSE 0.0 END + CASE WHEN regexp_matches(t || ' ' || lower(h), '(\\bth\\b|thai|thailand|officialth)') THEN 0.2 ELSE 0.0 END AS conf,
            {" OR ".join(f"contains(t, '{w}')" for w in scores.PERSONA_WORDS)} OR {" OR ".join(f"contains(t, '{a.lower()}')" for a in scores.CONFIRMED_AGENCIES)} AS declared,
            {" OR ".join("contains(t, '" + w + "')" for ws, _ in scores.AGENCY_WORDS for w in ws)} AS known FROM c
    )
    SELECT doc_id, CASE WHEN known OR (declared AND (conf >= 0.25 OR k > 0)) OR (k > 0 AND (conf >= 0.3 OR country = 'TH')) OR k = 2 THEN 'CONFIRMED' ELSE 'UNCONFIRMED' END AS status FROM s""")  # fmt: skip
def registry_evaluation(r: Roles) -> DataFrame:
    k = F.col("doc_id") % 3
    sources = F.when(k == 0, F.array(F.lit("other"))).when(k == 1, F.array(F.lit("Seed List"))).otherwise(F.array(F.lit("Seed List"), F.lit("other")))
    country = F.when(F.col("lang") == "es", "TH").otherwise("")
    return r.table("documents").select("doc_id", scores.registry_status(F.col("source"), F.col("text"), F.concat(F.lit("@"), F.col("lang")), country, sources).alias("status"))


@query("videos", """
    SELECT channel_id, min(video_id) AS video_id FROM videos WHERE channel_id NOT IN (SELECT channel_id FROM videos WHERE seconds = 7) GROUP BY 1""")
def cohort_growth(r: Roles) -> DataFrame:
    """Channels that a manifest does not have yet, each with its first video."""
    manifest = r.videos.where("seconds = 7").select("channel_id")
    new = r.videos.join(manifest.distinct(), "channel_id", "left_anti")
    return merge.first_rows(new.select("channel_id", "video_id"), ["channel_id"], ["video_id"])
