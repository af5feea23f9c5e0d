"""The reviewed registry: eligibility, one row per group, deliverable tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdweave.sources.shared import written

DEFAULT_AGENCY = "Independent"


def given(column: Column | str, default: Column | str = "") -> Column:
    """The value, or the default where it is null or ''."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.nullif(column, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def verified_links(links: DataFrame, personas: DataFrame) -> DataFrame:
    """Verified links to verified personas, with the persona's name."""
    people = personas.where("review_status = 'verified'").select(F.col("id").alias("persona_id"), "canonical_name")
    return links.where("review_status = 'verified'").join(people, "persona_id")


def eligible_accounts(accounts: DataFrame, links: DataFrame, personas: DataFrame, legacy: DataFrame, platform: str = "youtube") -> DataFrame:
    """Accounts of a platform with a verified link to a verified persona, or with a legacy claim."""
    backed = verified_links(links, personas).select("account_id").unionByName(legacy.select("account_id")).distinct()
    return accounts.where(F.col("platform") == platform).join(backed, accounts["id"] == backed["account_id"], "left_semi")


def top_link(links: DataFrame, personas: DataFrame) -> DataFrame:
    """The link reviewed last of each account; unreviewed ones come last, ties go to the lower id."""
    order = Window.partitionBy("account_id").orderBy(F.col("reviewed_at").desc_nulls_last(), "id")
    return verified_links(links, personas).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def creators_table(accounts: DataFrame, links: DataFrame, personas: DataFrame, affiliations: DataFrame, legacy: DataFrame) -> DataFrame:
    """The trusted creators: channel, handle, name, agency, status, dates and persona."""
    link = top_link(links, personas).select("account_id", "persona_id", "canonical_name", "reviewed_at")
    org = affiliations.where("review_status = 'verified'").groupBy("persona_id").agg(F.min_by("organization", "id").alias("organization"))
    claim_order = Window.partitionBy("account_id").orderBy(F.col("source_checked_at").desc_nulls_last(), "id")
    claim = legacy.withColumn("n", F.row_number().over(claim_order)).where("n = 1").select("account_id", "source_agency", "source_checked_at")
    base = eligible_accounts(accounts, links, personas, legacy).where(F.col("platform_id").isNotNull()).withColumnRenamed("id", "account_id")
    found = base.join(link, "account_id", "left").join(org, "persona_id", "left").join(claim, "account_id", "left")
    agency = F.coalesce("organization", "source_agency", F.lit(DEFAULT_AGENCY))
    return found.select(
        F.col("platform_id").alias("channel_id"), given("handle").alias("handle"),
        given(F.coalesce("canonical_name", "name"), F.col("platform_id")).alias("name"), F.lit(0).alias("subscriber_count"),
        given(agency, DEFAULT_AGENCY).alias("agency"), F.lit("ACCEPT").alias("status"), F.lit("").alias("last_activity"),
        given(F.coalesce("reviewed_at", "source_checked_at", "first_discovered_at")).alias("last_collected"), given("persona_id").alias("persona_id"),
    ).orderBy(F.lower("name").asc_nulls_last(), "channel_id")


def network_table(edges: DataFrame, accounts: DataFrame) -> DataFrame:
    """Edges with the names of both sides, strongest first. Edges are written before they are dealt into ranges of the order,
    and named where they lie then: ranges are drawn from what is written, and no name travels."""
    out = written(edges.where("shared_any > 0"))
    ends = out.select(F.explode(F.array_distinct(F.array("creator_a", "creator_b"))).alias("platform_id")).distinct()
    names = accounts.where("platform = 'youtube' and platform_id is not null").select("platform_id", "name")
    names = written(names.join(ends, "platform_id", "left_semi"))
    order = [F.desc("shared_any"), F.asc("creator_a"), F.asc("creator_b")]
    out = out.repartitionByRange(*order)
    for s in "ab":
        own = names.select(F.col("platform_id").alias(f"own_{s}"), F.col("name").alias(f"name_{s}"))
        out = out.join(own, F.col(f"creator_{s}") == F.col(f"own_{s}"), "left").drop(f"own_{s}")
    return out.orderBy(*order).select(
        F.col("creator_a").alias("channel_a_id"), given("name_a", F.col("creator_a")).alias("channel_a"), F.lit(DEFAULT_AGENCY).alias("agency_a"),
        F.col("creator_b").alias("channel_b_id"), given("name_b", F.col("creator_b")).alias("channel_b"), F.lit(DEFAULT_AGENCY).alias("agency_b"),
        F.col("shared_any").alias("shared_viewers"), F.col("shared_live_chat"), F.col("shared_comments"), F.col("strong_shared_any").alias("strong_shared"),
        "strong_shared_live_chat", "strong_shared_comments", "jaccard", "simpson",
    )


def platform_table(accounts: DataFrame, links: DataFrame, personas: DataFrame, platform: str) -> DataFrame:
    """Verified accounts of one platform with their personas."""
    found = accounts.where(F.col("platform") == platform).withColumnRenamed("id", "account_id").drop("name")
    found = found.join(verified_links(links, personas).select("account_id", "persona_id", "canonical_name", "reviewed_at"), "account_id")
    return found.select(
        given("handle").alias("handle"), given("canonical_name", F.col("handle")).alias("name"), "platform_id", "url",
        given("canonical_name").alias("persona_name"), "persona_id", given("reviewed_at").alias("observed_at"),
    ).orderBy(F.lower("handle").asc_nulls_last(), "persona_id", "platform_id")


def metrics_table(accounts: DataFrame, links: DataFrame) -> DataFrame:
    """Account-level rows of reviewed links; the counts are placeholders until metrics are collected."""
    reviewed = links.where("review_status = 'verified'").select("account_id", "reviewed_at")
    found = accounts.where("platform = 'youtube'").withColumnRenamed("id", "account_id").join(reviewed, "account_id")
    return found.select(
        "platform", "platform_id", "name", F.lit("reviewed_persona_link").alias("scope"), F.lit(0).alias("followers_or_subscribers"), F.lit(0).alias("views"),
        F.lit("").alias("likes_received"), F.lit("").alias("metric_time"), F.lit("unknown").alias("time_basis"), given("reviewed_at").alias("observed_at"),
        F.lit("registry").alias("source"), F.col("url").alias("source_url"), F.col("url").alias("account_url"),
    ).orderBy(F.lower("name").asc_nulls_last(), "platform_id")


def unlinked_accounts(accounts: DataFrame, links: DataFrame, candidates: DataFrame) -> DataFrame:
    """Accounts without any link and without a candidate of their handle."""
    free = accounts.join(links.select("account_id"), accounts["id"] == F.col("account_id"), "left_anti")
    return free.join(candidates.where(F.col("handle").isNotNull()).select("handle").distinct(), "handle", "left_anti").select("id", "platform", "handle")


def linked_accounts(accounts: DataFrame, links: DataFrame, personas: DataFrame, platform: str) -> DataFrame:
    """Accounts of a platform that a verified persona owns, by a chain of semi-joins."""
    people = personas.where("review_status = 'verified'").select(F.col("id").alias("persona_id"))
    live = links.where("review_status <> 'rejected'").join(people, "persona_id", "left_semi").select("account_id")
    return accounts.where(F.col("platform") == platform).join(live, accounts["id"] == live["account_id"], "left_semi").select("id", "platform_id")


def status_of_accounts(links: DataFrame) -> DataFrame:
    """Review status per account: verified if any link is, rejected if all are, else pending."""
    state = F.col("review_status")
    return links.groupBy("account_id").agg(
        F.when(F.bool_or(state == "verified"), "verified").when(F.bool_and(state == "rejected"), "rejected").otherwise("pending").alias("review_status"),
        F.count(F.lit(1)).alias("links"),
    )


def shared_accounts(links: DataFrame) -> DataFrame:
    """Accounts that verified links give to several personas."""
    kept = links.where("review_status = 'verified'").groupBy("account_id").agg(F.countDistinct("persona_id").alias("personas"), F.min("persona_id").alias("first_persona"))
    return kept.where("personas > 1")
