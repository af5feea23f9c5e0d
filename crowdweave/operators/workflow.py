"""Steps around the tables: change gates, delivery orders, review decisions, change checks, work lists, identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdweave.operators import merge

#: Other names of platforms (fixed values).
PLATFORM_ALIASES = {"twitter": "x", "carrd": "website", "linktree": "website"}
#: Review states of links and of the queue, by the names they have in older tables (fixed values).
REVIEW_STATES = {"verified": "verified", "rejected": "rejected", "needs_evidence": "pending", "pending": "pending"}
QUEUE_STATES = {"open": "open", "in_review": "in_review", "closed": "closed", "rejected": "rejected", "resolved": "closed"}
#: Platforms whose accounts are known by handle only (fixed values).
HANDLE_ONLY = ["x", "easydonate", "tipjai", "instagram"]
#: Decisions, roles and forms of a review (fixed values).
DECISIONS = ["approved", "rejected", "needs-evidence"]
ROLES = ["performer", "singer", "artist", "rigger"]
FORMATS = ["PNG", "Live2D", "3D", "mixed", "unknown"]
#: A first pass over a video stops at so many records (fixed value).
FIRST_PASS_CAP = 15
#: The catalogue's years (fixed values).
CATALOG_START, CATALOG_END = "2021-01-01T00:00:00Z", "2027-01-01T00:00:00Z"


def _looked_up(value: Column, names: dict[str, str], other: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, value), other)


def platform_name(platform: Column) -> Column:
    plain = F.lower(F.trim(platform))
    return _looked_up(F.coalesce(plain, F.lit("")), PLATFORM_ALIASES, F.nullif(plain, F.lit("")))


def review_state(status: Column) -> Column:
    return _looked_up(F.coalesce(status, F.lit("")), REVIEW_STATES, F.lit("pending"))


def queue_state(status: Column) -> Column:
    return _looked_up(F.coalesce(status, F.lit("")), QUEUE_STATES, F.lit("open"))


def padded(cells: Column, width: int) -> Column:
    """A row of exactly ``width`` cells; what is missing or null is ''."""
    full = F.concat(F.transform(cells, lambda x: F.coalesce(x, F.lit(""))), F.array_repeat(F.lit(""), width))
    return F.slice(full, 1, width)


def account_key(platform: Column, value: Column) -> Column:
    """A struct (platform_id, handle): some platforms know accounts by handle alone, one of them unless it is a number."""
    by_handle = platform.isin(HANDLE_ONLY) | ((platform == "facebook") & ~value.rlike("^[0-9]+$"))
    return F.struct(F.when(by_handle, "").otherwise(value).alias("platform_id"), F.when(by_handle, F.lower(value)).otherwise("").alias("handle"))


def job_identity(job: Column, fields: list[str]) -> Column:
    """SHA-256 of a job's canonical JSON: sorted keys, no spaces."""
    return F.sha2(F.to_json(F.struct(*[job[f].alias(f) for f in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def end_state(first_pass: Column, records: Column, comments: Column, replies: Column) -> Column:
    """What a job's state amounts to; the first rule that holds counts."""
    return (
        F.when(first_pass == "PAGE_SAMPLE_COMPLETE", "PAGE_SAMPLE_COMPLETE").when(records >= FIRST_PASS_CAP, "CAP_REACHED")
        .when((comments == "EXHAUSTED") & (replies == "EXHAUSTED"), "EXHAUSTED").when(replies == "PARTIAL_UNAVAILABLE", "PARTIAL_UNAVAILABLE")
        .when(comments.isin("COMMENTS_DISABLED", "VIDEO_UNAVAILABLE", "VIDEO_NOT_FOUND"), "UNAVAILABLE").otherwise("RUNNING")
    )


def gate(rows: DataFrame, key: str, newest: str, stored: DataFrame) -> DataFrame:
    """Per ``key``: count and newest time of the rows, and whether a derived table must be computed again. ``stored`` has
    the (key, count, newest) of the last run; rows that changed in place without a new time are not seen, by design."""
    now = rows.groupBy(key).agg(F.count(F.lit(1)).alias("count"), F.max(newest).alias("newest"))
    then = stored.select(key, F.col("count").alias("_count"), F.col("newest").alias("_newest"))
    joined = now.join(then, key, "full_outer")
    same = F.col("count").eqNullSafe(F.col("_count")) & F.col("newest").eqNullSafe(F.col("_newest"))
    action = F.when(F.col("count").isNull(), "skip_empty").when(same, "skip_unchanged").otherwise("run")
    return joined.select(key, "count", "newest", action.alias("action"))


def edge_order() -> list[Column]:
    return [F.desc("shared_any"), F.asc("creator_a"), F.asc("creator_b")]


def name_order(name: str, tie: str) -> list[Column]:
    """By name without case, rows without a name last."""
    return [F.lower(F.col(name)).asc_nulls_last(), F.col(tie).asc()]


def newest_first() -> list[Column]:
    """Newest year first, newest video first."""
    return [F.desc("year"), F.desc_nulls_last("published_at"), F.asc("video_id")]


def reply_queue(replies: DataFrame, videos: DataFrame, k: int) -> DataFrame:
    """Open reply jobs with their video's year, newest years first."""
    joined = replies.where(F.col("status").isin("pending", "partial")).join(videos.select("video_id", "year"), "video_id")
    return joined.orderBy(F.desc("year"), "parent_id").limit(k).select("parent_id", "video_id", "year", "status")


def backfill_queue(samples: DataFrame, k: int) -> DataFrame:
    return samples.orderBy("year", "channel_id", "sample_id").limit(k)


def in_catalog(published: Column) -> Column:
    return (published >= CATALOG_START) & (published < CATALOG_END)


def catalog_channels(registry: DataFrame) -> DataFrame:
    """Confirmed creators that are active or on hiatus."""
    return registry.where((F.col("vtuber_status") == "CONFIRMED") & F.col("activity_status").isin("active", "hiatus"))


def public_videos(videos: DataFrame) -> DataFrame:
    return videos.where((F.col("access_status") == "public") & F.col("video_type").isin("replay_vod", "normal_video"))


def reviewed(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """Candidates after a review: (candidate_id, review_status, channel_id, roles, problem, history).

    ``candidates``: candidate_id, discovered_at, source_refs, review_status. ``reviews``: candidate_id, decision, reviewer,
    reason, reviewed_at, source_refs, roles, presentation_format, is_virtual_creator, verified_channel_id. A review that a
    guard stops changes nothing and names the guard; a time or a format that is missing is no valid one. ``history`` is the
    candidates' (an array, if they have that column) and the entry of a review that no guard stopped.
    """
    entry = "struct<decision: string, reviewer: string, reviewed_at: timestamp, reason: string, source_refs: array<string>>"
    past = F.col("history") if "history" in candidates.columns else F.array()
    old = candidates.select(
        "candidate_id", "discovered_at", F.col("source_refs").alias("known_refs"), F.col("review_status").alias("old_status"), past.cast(f"array<{entry}>").alias("past")
    )
    joined = old.join(reviews, "candidate_id", "left")
    refs, roles = F.coalesce("source_refs", F.array().cast("array<string>")), F.coalesce("roles", F.array().cast("array<string>"))

    def blank(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) == ""

    approved = F.col("decision") == "approved"
    problem = (
        F.when(F.col("decision").isNull(), F.lit(None).cast("string")).when(~F.col("decision").isin(DECISIONS) | blank("reviewer") | blank("reason"), "incomplete")
        .when(F.coalesce(F.col("reviewed_at") < F.col("discovered_at"), F.lit(True)), "before_discovery")
        .when((F.size(refs) == 0) | (F.size(F.array_except(refs, "known_refs")) > 0), "unknown_evidence")
        .when(F.size(F.array_except(roles, F.array(*map(F.lit, ROLES)))) > 0, "unknown_role").when(F.coalesce(~F.col("presentation_format").isin(FORMATS), F.lit(True)), "unknown_format")
        .when(F.col("verified_channel_id").isNotNull() & ~F.col("verified_channel_id").rlike("^UC[A-Za-z0-9_-]{22}$"), "bad_channel_id")
        .when(approved & ((F.size(roles) == 0) | F.col("is_virtual_creator").isNull()), "approval_without_roles")
    )
    held = problem.isNotNull() | F.col("decision").isNull()
    return joined.select(
        "candidate_id", F.when(held, F.col("old_status")).otherwise(F.col("decision")).alias("review_status"),
        F.when(~held & approved, F.col("verified_channel_id")).alias("channel_id"),
        F.when(~held, F.array_join(F.array_sort(F.array_distinct(roles)), ",")).alias("roles"), problem.alias("problem"),
        F.concat("past", F.when(held, F.array().cast(f"array<{entry}>")).otherwise(F.array(F.struct("decision", "reviewer", "reviewed_at", "reason", "source_refs").cast(entry)))).alias("history"),
    )


def candidate(raw: DataFrame, discovered_at: Column) -> DataFrame:
    """Raw finds (candidate_id, source_url, channel_id, name, title, handle, description) as candidates without a decision,
    and a problem where one has no id or no source."""

    def filled(c: str) -> Column:
        return F.nullif(F.col(c), F.lit(""))

    problem = F.when(filled("candidate_id").isNull() | filled("source_url").isNull(), "no_id_or_source")
    return raw.select(
        "candidate_id", filled("channel_id").alias("proposed_channel_id"), F.coalesce(filled("name"), filled("title"), "candidate_id").alias("label"),
        F.array_compact(F.array(filled("handle"))).alias("aliases"), discovered_at.alias("discovered_at"), F.coalesce("description", F.lit("")).alias("self_description"),
        F.array_compact(F.array(filled("source_url"))).alias("source_refs"), F.lit("needs-evidence").alias("review_status"), problem.alias("problem"),
    )


def approved_manifest(items: DataFrame) -> DataFrame:
    """Approved channels, one row each: channel_id, candidates, aliases and source_refs (united, sorted), discovered_at (the
    first), roles, presentation_format, is_virtual_creator, conflict. Only equal channel ids merge. Items of one channel
    that differ in a decision are in conflict: their row has no decision and waits for a reviewer."""
    approved = items.where("review_status = 'approved' AND channel_id IS NOT NULL")
    decision = ["roles", "presentation_format", "is_virtual_creator"]
    grouped = approved.groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_refs")))).alias("source_refs"), F.min("discovered_at").alias("discovered_at"),
        F.collect_set(F.to_json(F.struct(*decision), {"ignoreNullFields": "false"})).alias("decisions"), F.min(F.struct(*decision)).alias("d"),
    )
    conflict = F.size("decisions") > 1
    return grouped.select(
        "channel_id", "candidates", "aliases", "source_refs", "discovered_at", *[F.when(~conflict, F.col(f"d.{c}")).alias(c) for c in decision], conflict.alias("conflict")
    )


def change_problems(changes: DataFrame, tables: list[str]) -> DataFrame:
    """Rows (table_name, id) of a change file with what is wrong with them; an empty result means it can be applied."""
    problem = F.when(~F.col("table_name").isin(tables) | F.col("table_name").isNull(), "unknown_table").when(F.coalesce(F.trim("id"), F.lit("")) == "", "no_id")
    return changes.select("table_name", "id", problem.alias("problem")).where("problem is not null")


def apply_changes(tables: dict[str, DataFrame], changes: dict[str, DataFrame], order: list[str], dry_run: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """Upsert change rows table by table, referenced tables first; returns the tables and the counts by table and action.
    A dry run returns the tables as they are."""
    counts, out = [], dict(tables)
    for name in order:
        if name in changes:
            done = merge.diff(tables[name], changes[name], "id").groupBy("action").agg(F.count(F.lit(1)).alias("rows"))
            counts.append(done.select(F.lit(name).alias("table_name"), "action", "rows"))
            if not dry_run:
                out[name] = merge.upsert(tables[name], changes[name], "id")
    total = counts[0]
    for more in counts[1:]:
        total = total.unionByName(more)
    return out, total


def compare_and_set(rows: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """(key, column, action): ``changes`` has key, expected and new; a value is set only where the expected one is there."""
    joined = changes.join(rows.select(key, column), key, "left")
    met = F.col(column).eqNullSafe(F.col("expected"))
    action = F.when(F.col(column).isNull() & F.col("expected").isNotNull(), "missing").when(met, "set").when(F.col(column).eqNullSafe(F.col("new")), "already").otherwise("conflict")
    return joined.select(key, F.when(met, F.col("new")).otherwise(F.col(column)).alias(column), action.alias("action"))


def transfers(moves: DataFrame, organizations: DataFrame, existing: DataFrame) -> DataFrame:
    """New affiliations (persona_id, organization_id, is_new): moves (persona_id, name) find their organization by name
    without case; unknown names make one of their own; pairs that exist are left out."""
    known = merge.first_rows(organizations.select(F.lower("name").alias("key"), "id"), ["key"], ["id"])
    joined = moves.where("name is not null").withColumn("key", F.lower("name")).join(known, "key", "left")
    made = F.concat(F.lit("org_"), F.substring(F.sha2("key", 256), 1, 20))
    pairs = joined.select("persona_id", F.coalesce("id", made).alias("organization_id"), F.col("id").isNull().alias("is_new")).distinct()
    return pairs.join(existing.select("persona_id", "organization_id"), ["persona_id", "organization_id"], "left_anti")


def legacy_points(archive: DataFrame, metrics: DataFrame) -> DataFrame:
    """Metric points of an archived tab as rows of ``metrics`` (channel_id, day): once, without touching what is there."""
    points = archive.where((F.coalesce("platform_id", F.lit("")) != "") & (F.coalesce("metric_time", F.lit("")) != ""))
    points = points.select(
        F.col("platform_id").alias("channel_id"), F.substring("metric_time", 1, 10).alias("day"),
        F.regexp_replace("followers", ",", "").try_cast("bigint").alias("subscribers"), F.concat(F.lit("legacy:"), "source").alias("source"),
    )
    return merge.absent(points, metrics, ["channel_id", "day"], ["source", "subscribers"])


def keep_first(existing: DataFrame, changes: DataFrame, key: str, frozen: list[str]) -> DataFrame:
    """An upsert that never replaces a frozen column once it has a value."""
    old = existing.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in existing.columns if c != key])
    joined = old.join(changes, F.col(key) == F.col("_key"), "full_outer")
    value = {c: F.coalesce(f"_{c}", c) if c in frozen else F.coalesce(c, f"_{c}") for c in existing.columns if c != key}
    return joined.select(F.coalesce(key, "_key").alias(key), *[v.alias(c) for c, v in value.items()])


#: Pages of groups rather than of persons, and marks of a group's page in a reference (fixed values).
GROUP_PAGES = ("AStars", "Algorhythm_Project", "Virtual_Zeven")
GROUP_MARKS = ("arp_vtuber", "pixelaproject", "astarsofficial", "polygonofficial", "algorhythm_project", "/wiki/astars", "/wiki/virtual_zeven")


def identity_problems(events: DataFrame, manifest: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """(channel_id, problem) of curated events (channel_id, subject_channel_id, subject_name, source_subject, source_agency
    and, if there, source_reference) against the manifest (channel_id, name, agency) and, if given, the registry
    (channel_id, name): the first rule that an event breaks. A reference to a wiki page must name the subject or a part of
    it; a reference to a group's page does not prove a person who is independent."""

    def plain(c: str | Column) -> Column:
        text = F.col(c) if isinstance(c, str) else c
        return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\W_]", ""))

    told = events if "source_reference" in events.columns else events.withColumn("source_reference", F.lit(None).cast("string"))
    joined = told.join(manifest.select("channel_id", "name", "agency"), "channel_id", "left")
    known = (manifest if registry is None else registry).select("channel_id", F.col("name").alias("registry_name"))
    joined = joined.join(known, "channel_id", "left")
    claims = joined.groupBy(plain("subject_name").alias("claim")).agg(F.countDistinct("channel_id").alias("claimed_by"))
    joined = joined.withColumn("claim", plain("subject_name")).join(claims, "claim")
    reference = F.coalesce("source_reference", F.lit(""))
    path = F.regexp_extract(reference, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    last = F.coalesce(F.try_url_decode(F.regexp_extract(path, "([^/]*)$", 1)), F.lit(""))
    slug = plain(last)
    wiki = F.contains(reference, F.lit("/wiki/")) & ~last.isin(*GROUP_PAGES)
    independent = F.col("agency") == "Independent"
    problem = (
        F.when(F.col("name").isNull() | F.col("registry_name").isNull(), "unknown_channel").when(~F.col("subject_channel_id").eqNullSafe(F.col("channel_id")), "other_subject")
        .when((F.col("claim") == "") | (plain("source_subject") != F.col("claim")), "source_names_other").when(~plain("name").contains(F.col("claim")), "manifest_names_other")
        .when(~plain("registry_name").contains(F.col("claim")), "registry_names_other").when(F.col("claimed_by") > 1, "claimed_twice")
        .when(wiki & ~F.contains(F.col("claim"), slug) & ~F.contains(slug, F.col("claim")), "page_names_other")
        .when(independent & ~F.coalesce("source_agency", F.lit("")).startswith("Independent"), "agency_on_independent")
        .when(independent & F.lower(reference).rlike("|".join(GROUP_MARKS)), "group_page_on_independent")
    )
    return joined.select("channel_id", problem.alias("problem")).where("problem is not null")
