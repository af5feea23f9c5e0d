"""Attaching found accounts to personas, by what the registry already knows: talents, donation links, source pages; and
what is accepted of a job's outcome.

Every rule set gives each input row one outcome, the first that applies, so counts of outcomes add up to the input.
Registry tables: accounts (id, platform, platform_id, handle), links (account_id, persona_id, review_status), personas
(id, review_status). A link counts unless it was rejected; ``verified`` owners need a verified persona, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdweave.functions.records import persona_type
from crowdweave.functions.urls import donation_account

#: Outcomes of a collection that end a job, publish events, or may not be tried again (fixed values).
OUTCOMES = [
    "SUCCESS", "EMPTY_RESULT", "PARTIAL_CAPTURE", "COMMENTS_DISABLED", "LIVE_CHAT_UNAVAILABLE", "RATE_LIMITED", "EXTRACTION_FAILURE", "STORAGE_FAILURE",
]
PUBLISHED = ["SUCCESS", "EMPTY_RESULT", "PARTIAL_CAPTURE"]
FINAL = ["COMMENTS_DISABLED", "LIVE_CHAT_UNAVAILABLE"]


def _id(kind: str, *parts: Column | str) -> Column:
    """A stable id from what a row is about."""
    seed = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.concat(F.lit(f"{kind}_"), F.substring(F.sha2(seed, 256), 1, 20))


def _known(accounts: DataFrame) -> DataFrame:
    """(platform, kind, key, account_id): accounts by their own id and by handle; of several, the least id."""
    handle = F.lower(F.ltrim(F.coalesce("handle", F.lit("")), F.lit("@")))
    entries = F.array(F.struct(F.lit("id").alias("kind"), F.coalesce("platform_id", F.lit("")).alias("key")), F.struct(F.lit("handle").alias("kind"), handle.alias("key")))
    rows = accounts.select("id", "platform", F.inline(entries)).where("key <> ''")
    return rows.groupBy("platform", "kind", "key").agg(F.min("id").alias("account_id"))


def resolved(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """Rows (platform, platform_id, handle, ...) with account_id: by platform id, else by handle, else null."""
    known = _known(accounts)
    by_id = known.where("kind = 'id'").select("platform", F.col("key").alias("platform_id"), F.col("account_id").alias("_by_id"))
    by_handle = known.where("kind = 'handle'").select("platform", F.col("key").alias("_handle"), F.col("account_id").alias("_by_handle"))
    keyed = rows.withColumn("_handle", F.lower(F.ltrim(F.coalesce("handle", F.lit("")), F.lit("@"))))
    found = keyed.join(by_id, ["platform", "platform_id"], "left").join(by_handle, ["platform", "_handle"], "left")
    return found.withColumn("account_id", F.coalesce("_by_id", "_by_handle")).drop("_handle", "_by_id", "_by_handle")


def _owners(links: DataFrame) -> DataFrame:
    """(account_id, owners): the personas of links that were not rejected."""
    return links.where(F.coalesce("review_status", F.lit("")) != "rejected").groupBy("account_id").agg(F.collect_set("persona_id").alias("owners"))


def talent_accounts(talents: DataFrame) -> DataFrame:
    """(talent_id, platform, platform_id, handle, name, url) of nested talent records (id, name, youtube and twitch structs):
    only accounts with a stable id."""
    video, stream = F.col("youtube.channel_id"), F.col("twitch.channel_id")
    login = F.lower(F.coalesce("twitch.username", F.lit("")))
    entries = F.array(
        F.struct(F.lit("youtube").alias("platform"), video.alias("platform_id"), F.lit("").alias("handle"), F.coalesce(F.nullif("youtube.name", F.lit("")), "name").alias("name"),
                 F.concat(F.lit("https://www.youtube.com/channel/"), video).alias("url"), video.startswith("UC").alias("ok")),
        F.struct(F.lit("twitch").alias("platform"), stream.alias("platform_id"), login.alias("handle"), F.coalesce(F.nullif("twitch.name", F.lit("")), "name").alias("name"),
                 F.concat(F.lit("https://www.twitch.tv/"), login).alias("url"), stream.rlike(r"\A[0-9]+\z").alias("ok")),
    )
    return talents.select(F.col("id").alias("talent_id"), F.inline(entries)).where("ok").drop("ok")


def talent_plan(talents: DataFrame, accounts: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """What a talent directory adds: outcomes (talent_id, outcome, persona_id, persona_type, status), accounts and links.

    A talent without a stable account is left out; one whose account another talent lists as well, or whose accounts belong
    to several personas, goes to a reviewer; else it is the persona that has its accounts, or a new one.
    """
    own = resolved(talent_accounts(talents), accounts)
    listed = own.groupBy("platform", "platform_id").agg((F.count(F.lit(1)) > 1).alias("shared"))
    held = own.join(listed, ["platform", "platform_id"]).join(_owners(links), "account_id", "left")
    per = held.groupBy("talent_id").agg(F.bool_or("shared").alias("shared"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("owners", F.array().cast("array<string>"))))).alias("owners"))
    joined = talents.select(F.col("id").alias("talent_id"), "types", "status_type").join(per, "talent_id", "left")
    outcome = (
        F.when(F.col("shared").isNull(), "no_stable_account").when(F.col("shared"), "shared_channel").when(F.size("owners") > 1, "conflict_multi_persona")
        .when(F.size("owners") == 1, "matched_existing").otherwise("new_persona")
    )
    told = joined.withColumn("outcome", outcome)
    persona = F.when(F.col("outcome") == "matched_existing", F.col("owners")[0]).when(F.col("outcome") == "new_persona", _id("persona", "talent", F.col("talent_id").cast("string")))
    new = F.col("outcome") == "new_persona"
    outcomes = told.select(
        "talent_id", "outcome", persona.alias("persona_id"), F.when(new, persona_type(F.coalesce("types", F.array().cast("array<string>")))).alias("persona_type"),
        F.when(new, F.when(F.col("status_type") == "RETIRED", "graduated").otherwise("unknown")).alias("status"),
    )
    placed = own.join(outcomes.where("persona_id IS NOT NULL").select("talent_id", "persona_id"), "talent_id")
    named = placed.withColumn("known", F.col("account_id").isNotNull()).withColumn("account_id", F.coalesce("account_id", _id("acct", "talent-account", F.col("platform"), F.col("platform_id"))))
    there = links.select("persona_id", "account_id")
    fresh = named.join(there, ["persona_id", "account_id"], "left_anti").select(_id("link", F.col("account_id"), F.col("persona_id")).alias("id"), "persona_id", "account_id").distinct()
    return {"outcomes": outcomes, "accounts": named.where("NOT known").select("account_id", "platform", "platform_id", "handle", "name", "url").distinct(), "links": fresh}


def donation_plan(found: DataFrame, accounts: DataFrame, links: DataFrame, personas: DataFrame) -> DataFrame:
    """Donation links on channels (channel_id, url) with their outcome: (channel_id, url, platform, slug, outcome, persona_id,
    account_id). A channel stands for the one verified persona that has it; other links, not of a donation host, go."""
    sure = personas.where("review_status = 'verified'").select(F.col("id").alias("persona_id"))
    verified = _owners(links.join(sure, "persona_id", "left_semi"))
    channels = accounts.where("platform = 'youtube' AND coalesce(platform_id, '') <> ''").select(F.col("id").alias("account_id"), F.col("platform_id").alias("channel_id"))
    persona = channels.join(verified, "account_id").where(F.size("owners") == 1).groupBy("channel_id").agg(F.max(F.col("owners")[0]).alias("persona_id"))
    parsed = found.select("channel_id", donation_account(F.col("url")).alias("d")).where("d IS NOT NULL").select("channel_id", "d.platform", "d.slug", "d.url").distinct()
    keyed = parsed.select("*", F.lit("").alias("platform_id"), F.col("slug").alias("handle")).join(persona, "channel_id", "left")
    held = resolved(keyed, accounts).join(verified, "account_id", "left")
    owned = F.size(F.coalesce("owners", F.array().cast("array<string>"))) > 0
    outcome = (
        F.when(F.col("persona_id").isNull(), "no_verified_persona").when(owned & F.array_contains("owners", F.col("persona_id")), "already_linked")
        .when(owned, "conflict_other_persona").when(F.col("account_id").isNotNull(), "new_link").otherwise("new_account_and_link")
    )
    account = F.coalesce("account_id", F.when(outcome == "new_account_and_link", _id("acct", "about-account", F.col("platform"), F.col("slug"))))
    return held.select("channel_id", "url", "platform", "slug", outcome.alias("outcome"), "persona_id", account.alias("account_id"))


def owner_plan(pages: DataFrame, accounts: DataFrame, links: DataFrame, include_review: bool = False) -> DataFrame:
    """Source pages (slug, match, official array<struct<platform, platform_id>>, persona_id, virtual_signal, thai_signal) with
    (slug, outcome, persona_id, owners): the owners of all their accounts, united."""
    stable = F.filter("official", lambda a: F.coalesce(a["platform_id"], F.lit("")) != "")
    rows = pages.withColumn("stable", stable)
    each = rows.select("slug", F.inline("stable")).withColumn("handle", F.lit(""))
    owners = resolved(each, accounts).join(_owners(links), "account_id").groupBy("slug").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("owners")))).alias("owners"))
    joined = rows.withColumnRenamed("persona_id", "said").join(owners, "slug", "left").withColumn("owners", F.coalesce("owners", F.array().cast("array<string>")))
    said = F.nullif("said", F.lit(""))
    outcome = (
        F.when((F.col("match") == "NEED_REVIEW") & F.lit(not include_review), "need_review").when(F.size("stable") == 0, "no_stable_account")
        .when((F.col("match") == "NO_EVIDENCE") & ~(F.coalesce("virtual_signal", F.lit(False)) & F.coalesce("thai_signal", F.lit(False))), "no_evidence")
        .when(F.size("owners") > 1, "several_personas").when((F.size("owners") == 1) & said.isNotNull() & (said != F.try_element_at("owners", F.lit(1))), "other_persona")
        .when(F.size("owners") == 1, "attached").otherwise("new_persona")
    )
    told = joined.withColumn("outcome", outcome)
    persona = F.when(F.col("outcome") == "attached", F.try_element_at("owners", F.lit(1))).when(F.col("outcome") == "new_persona", _id("persona", "page", F.col("slug")))
    return told.select("slug", "outcome", persona.alias("persona_id"), F.array_join("owners", ",").alias("owners"))


def accepted(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Outcomes of jobs (job_id, channel_id, video_id, source_type, status) with their events (job_id, channel_id, video_id,
    source_type) as (job_id, status, records, retry, wait): an unknown status is an extraction failure; events of another
    identity, or under an empty result, are a storage failure, and none is published."""
    own = jobs.select("job_id", F.col("channel_id").alias("c"), F.col("video_id").alias("v"), F.col("source_type").alias("s"))
    other = ~(F.col("channel_id").eqNullSafe(F.col("c")) & F.col("video_id").eqNullSafe(F.col("v")) & F.col("source_type").eqNullSafe(F.col("s")))
    counts = events.join(own, "job_id").groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(other).alias("foreign"))
    joined = jobs.join(counts, "job_id", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    status = F.when(F.coalesce(F.col("status").isin(OUTCOMES), F.lit(False)), F.col("status")).otherwise("EXTRACTION_FAILURE")
    published = status.isin(PUBLISHED)
    broken = published & (F.coalesce("foreign", F.lit(False)) | ((status == "EMPTY_RESULT") & (F.col("n") > 0)))
    final = F.when(broken, "STORAGE_FAILURE").otherwise(status)
    failed = broken | ~published
    return joined.select(
        "job_id", final.alias("status"), F.when(failed, 0).otherwise(F.col("n")).cast("long").alias("records"), (failed & ~final.isin(FINAL)).alias("retry"),
        F.when(failed, F.when(final == "RATE_LIMITED", 60).otherwise(30)).alias("wait"),
    )


def publishable(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """The events of jobs whose outcome is accepted."""
    return events.join(accepted(jobs, events).where("NOT retry AND records > 0").select("job_id"), "job_id", "left_semi")


def queue_status(candidates: DataFrame, queue: DataFrame, personas: DataFrame, accounts: DataFrame) -> DataFrame:
    """One row: verified_personas, total_accounts, candidates, needs_evidence, verified, open_reviews."""
    one = candidates.agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("review_status") == "needs_evidence").alias("needs_evidence"), F.count_if(F.col("review_status") == "verified").alias("verified")
    )
    two = queue.agg(F.count_if(F.col("status") == "open").alias("open_reviews"))
    three = personas.agg(F.count_if(F.col("review_status") == "verified").alias("verified_personas"))
    four = accounts.agg(F.count(F.lit(1)).alias("total_accounts"))
    key = F.lit(0).alias("k")  # four frames of one row each
    joined = one.select("*", key).join(two.select("*", key), "k").join(three.select("*", key), "k").join(four.select("*", key), "k")
    return joined.drop("k")


def coerced(rows: DataFrame) -> DataFrame:
    """Sheet texts subscriber_count, thai_confidence, source_count, streams_collected and enabled as numbers and a flag;
    what is no number becomes the field's default, and a missing flag is set."""

    def number(c: str, kind: str, default: float) -> Column:
        return F.coalesce(F.trim(F.col(c)).try_cast(kind), F.lit(default).cast(kind)).alias(c)

    def whole(c: str, default: int) -> Column:
        text = F.trim(F.col(c))
        return F.coalesce(F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("bigint")), F.lit(default).cast("bigint")).alias(c)

    flag = F.lower(F.trim(F.coalesce("enabled", F.lit("true")))).isin("true", "1", "yes").alias("enabled")
    made = [whole("subscriber_count", 0), number("thai_confidence", "double", 0.0), whole("source_count", 1), whole("streams_collected", 0), flag]
    kept = [c for c in rows.columns if c not in {"subscriber_count", "thai_confidence", "source_count", "streams_collected", "enabled"}]
    return rows.select(*kept, *made)


def canonical_json(text: Column) -> Column:
    """A JSON text with sorted keys and no spaces at any depth, non-ASCII letters kept; null if it is none. Equal numbers
    have one form."""
    return F.to_json(F.try_parse_json(text))


def record_hash(text: Column) -> Column:
    """SHA-256 of a record's canonical JSON."""
    return F.sha2(canonical_json(text), 256)
