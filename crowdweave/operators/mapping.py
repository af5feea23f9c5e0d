"""The canonical form of older tables: stable ids, accounts, organizations, life dates and the queue of what needs review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdweave.operators import merge
from crowdweave.operators.workflow import REVIEW_STATES, platform_name, queue_state, review_state

#: Platforms that an account may have; any other one becomes the last (fixed values).
PLATFORMS = ["youtube", "x", "twitch", "tiktok", "facebook", "instagram", "bluesky", "website", "ganknow", "other"]
#: Types of life events; any other one becomes the last (fixed values).
LIFE_EVENTS = ["debut", "graduation", "hiatus_start", "hiatus_end", "rebrand", "redebut", "account_move", "other"]
#: Persona types by the form of older tables (fixed values).
PERSONA_TYPES = {"png": "pngtuber", "mixed": "mixed"}


def stable_id(kind: str, seed: Column) -> Column:
    """An id from a name: case and white space do not matter, and no position in a file does."""
    plain = F.lower(F.trim(F.regexp_replace(seed, r"(?U)\s+", " ")))
    return F.concat(F.lit(f"{kind}_"), F.substring(F.sha2(plain, 256), 1, 20))


def account_id(platform: Column, platform_id: Column, url: Column) -> Column:
    """An id from the platform and its own id, or the (normal) URL where that is blank."""
    own = F.coalesce(F.nullif(F.trim(platform_id), F.lit("")), url)
    return F.concat(F.lit("account_"), F.substring(F.sha2(F.concat(platform_name(platform), F.lit(":"), own), 256), 1, 20))


def _link_facts(links: DataFrame) -> DataFrame:
    state = review_state(F.col("review_status"))
    current = (F.coalesce("valid_to", F.lit("")) == "") & (state != "rejected")
    return links.groupBy(F.col("account_id").alias("id")).agg(
        F.bool_or(state == "verified").alias("_any"), F.bool_and(state == "rejected").alias("_none"),
        F.countDistinct(F.when(current, F.col("persona_id"))).alias("_personas"),
    )


def canonical_accounts(accounts: DataFrame, links: DataFrame) -> DataFrame:
    """(id, platform, platform_id, handle, account_type, review_status): a platform id that is only a handle is blank; an
    account is a persona's if a link that is open and not rejected says so; one verified link verifies it."""
    joined = accounts.join(_link_facts(links), "id", "left")
    by_handle = F.coalesce("id_namespace", F.lit("")) == "handle"
    return joined.select(
        "id", F.when(F.col("platform").isin(PLATFORMS), F.col("platform")).otherwise("other").alias("platform"),
        F.when(by_handle, "").otherwise(F.coalesce("platform_id", F.lit(""))).alias("platform_id"), F.coalesce("handle", F.lit("")).alias("handle"),
        F.when(F.col("_personas") > 0, "persona").otherwise("unknown").alias("account_type"),
        F.when(F.col("_any"), "verified").when(F.col("_none"), "rejected").otherwise("pending").alias("review_status"),
    )


def canonical_organizations(affiliations: DataFrame) -> DataFrame:
    """(id, name): the first spelling of each organization, by the affiliation's id."""
    named = affiliations.where(F.coalesce(F.trim("organization"), F.lit("")) != "").select("id", F.trim("organization").alias("name"))
    found = named.groupBy(stable_id("org", F.col("name")).alias("org")).agg(F.min_by("name", F.struct("id", "name")).alias("name"))
    return found.select(F.col("org").alias("id"), "name")


def canonical_personas(personas: DataFrame, events: DataFrame) -> DataFrame:
    """(id, persona_type, debut_date, graduation_date, status): dates of verified events, of the last one where there are several."""
    dated = events.where((review_state(F.col("review_status")) == "verified") & (F.coalesce("event_date", F.lit("")) != ""))

    def last(kind: str) -> Column:
        return F.max_by(F.when(F.col("event_type") == kind, F.col("event_date")), F.when(F.col("event_type") == kind, F.struct("event_id", "event_date"))).alias(kind)

    facts = dated.groupBy(F.col("persona_id").alias("id")).agg(last("debut"), last("graduation"))
    kinds = F.create_map(*[F.lit(x) for pair in PERSONA_TYPES.items() for x in pair])
    return personas.join(facts, "id", "left").select(
        "id", F.try_element_at(kinds, F.coalesce("format", F.lit(""))).alias("persona_type"), F.coalesce("debut", F.lit("")).alias("debut_date"),
        F.coalesce("graduation", F.lit("")).alias("graduation_date"), F.when(F.col("graduation").isNotNull(), "graduated").otherwise("").alias("status"),
    )


def canonical_queue(accounts: DataFrame, links: DataFrame, reviews: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, entity_id, reason, priority, status) of all that needs a decision: older reviews, candidates that no account
    stands for (by id or URL), unknown platforms, accounts of several personas, platform ids of several accounts. An id
    that occurs twice keeps the entry of the earlier kind."""

    def entries(rows: DataFrame, kind: int, key: Column, entity: Column, reason: Column, priority: str, status: Column) -> DataFrame:
        fields = (key.alias("id"), entity.alias("entity_id"), reason.alias("reason"), F.lit(priority).alias("priority"), status.alias("status"))
        return rows.select(F.lit(kind).alias("kind"), *fields)

    opened = F.lit("open")
    urls = accounts.where(F.coalesce("url", F.lit("")) != "").select("url").distinct()
    fresh = candidates.join(accounts.select(F.col("id").alias("account_id")).distinct(), "account_id", "left_anti").join(urls, "url", "left_anti")
    odd = accounts.where(~F.coalesce(F.col("platform").isin(PLATFORMS), F.lit(False)))
    shared = _link_facts(links).where("_personas > 1")
    known = canonical_accounts(accounts, links).where("platform_id <> ''")
    twice = known.groupBy("platform", "platform_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n > 1")
    pair = F.concat_ws(":", "platform", "platform_id")
    every = [
        entries(reviews, 0, F.col("id"), F.coalesce("account_id", F.lit("")), F.coalesce(F.nullif(F.col("reason"), F.lit("")), F.lit("legacy_review")), "P2", queue_state(F.col("status"))),
        entries(fresh, 1, F.concat(F.lit("rq_"), "id"), F.coalesce(F.nullif(F.col("account_id"), F.lit("")), "id"), F.lit("no_account"), "P2", opened),
        entries(odd, 2, F.concat(F.lit("rq_platform_"), "id"), F.col("id"), F.lit("unknown_platform"), "P3", opened),
        entries(shared, 3, F.concat(F.lit("rq_personas_"), "id"), F.col("id"), F.lit("several_personas"), "P1", opened),
        entries(twice, 4, F.concat(F.lit("rq_twice_"), F.substring(F.sha2(pair, 256), 1, 16)), F.col("id"), F.lit("platform_id_twice"), "P1", opened),
    ]
    return merge.first_rows(reduce(DataFrame.unionByName, every), ["id"], ["kind", "entity_id", "reason"]).drop("kind")


def _source(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """Rows with source_url, the URL of their evidence ('' if there is none)."""
    urls = evidence.groupBy(F.col("id").alias("evidence_id")).agg(F.min("url").alias("source_url"))
    return rows.join(urls, "evidence_id", "left").withColumn("source_url", F.coalesce("source_url", F.lit("")))


def _text(*names: str) -> list[Column]:
    return [F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in names]


def canonical_links(links: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, persona_id, account_id, link_type, valid_from, valid_to, source_url, review_status, reviewer, reviewed_at): a link
    that ended is a former one; evidence is named by its URL."""
    kind = F.when(F.coalesce("valid_to", F.lit("")) != "", "former").otherwise("official")
    return _source(links, evidence).select(
        "id", "persona_id", "account_id", kind.alias("link_type"), *_text("valid_from", "valid_to"), "source_url",
        review_state(F.col("review_status")).alias("review_status"), *_text("reviewer", "reviewed_at"),
    )


def canonical_affiliations(affiliations: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, persona_id, organization_id, role, valid_from, valid_to, source_url, review_status, reviewer, reviewed_at): an
    organization is named by the id that all its spellings share, a blank one by ''."""
    name = F.trim(F.coalesce("organization", F.lit("")))
    organization = F.when(name == "", "").otherwise(stable_id("org", name))
    return _source(affiliations, evidence).select(
        "id", "persona_id", organization.alias("organization_id"), F.lit("talent").alias("role"), *_text("valid_from", "valid_to"), "source_url",
        review_state(F.col("review_status")).alias("review_status"), *_text("reviewer", "reviewed_at"),
    )


def canonical_events(events: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, persona_id, event_type, event_date, source_url, review_status): unknown types become other."""
    kind = F.when(F.coalesce(F.col("event_type").isin(LIFE_EVENTS), F.lit(False)), F.col("event_type")).otherwise("other")
    return _source(events, evidence).select(
        F.col("event_id").alias("id"), "persona_id", kind.alias("event_type"), *_text("event_date"), "source_url", review_state(F.col("review_status")).alias("review_status")
    )


def mapping_issues(accounts: DataFrame, links: DataFrame, affiliations: DataFrame) -> DataFrame:
    """(entity, id, issue) of what the mapping had to decide: a row for each issue of each entity."""

    def told(rows: DataFrame, entity: str, *issues: tuple[str, Column]) -> DataFrame:
        found = F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), name) for name, when in issues]))
        return rows.select(F.lit(entity).alias("entity"), "id", F.explode(found).alias("issue"))

    by_handle, own = F.col("id_namespace") == "handle", F.coalesce("platform_id", F.lit(""))
    known_state = F.coalesce(F.col("review_status").isin(*REVIEW_STATES), F.lit(False))
    shared = _link_facts(links).where("_personas > 1").select("id")
    return reduce(DataFrame.unionByName, [
        told(accounts, "account", ("platform_mapped_to_other", ~F.coalesce(F.col("platform").isin(PLATFORMS), F.lit(False))),
             ("handle_namespace_distinct_platform_id", by_handle & (own != "") & (own != F.coalesce("handle", F.lit("")))),
             ("missing_canonical_url", F.coalesce("url", F.lit("")) == ""), ("platform_id_is_handle", by_handle)),
        told(links, "link", ("unmapped_review", ~known_state)),
        told(shared, "account", ("open_links_multiple_personas", F.lit(True))),
        told(affiliations, "affiliation", ("blank_organization", F.trim(F.coalesce("organization", F.lit(""))) == "")),
    ])


def agencies(confirmed: DataFrame) -> DataFrame:
    """Channels of each agency, the largest first, and the persons among them that have several channels."""
    agency = F.coalesce("agency", F.lit("Independent"))
    persons = confirmed.groupBy(agency.alias("agency"), "person_id").agg(F.count(F.lit(1)).alias("n"))
    counts = persons.groupBy("agency").agg(F.sum("n").alias("channels"), F.count_if((F.col("n") > 1) & F.col("person_id").isNotNull()).alias("several"))
    return counts.orderBy(F.desc("channels"), "agency")
