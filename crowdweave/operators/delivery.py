"""What goes to delivered tables and to the registry after a reconciliation, and the audit of private tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdweave.functions.records import earlier_names, inbox_key
from crowdweave.operators import intake, policy

#: Column names of message texts (fixed values).
TEXT_FIELDS = ("text", "comment_text", "chat_text", "message_body", "displayMessage", "comment_body")
#: Ids that delivered tables take, by platform (fixed values).
DELIVERED_IDS = {"youtube": "^UC", "twitch": r"\A[0-9]+\z", "tiktok": r"\A[0-9]+\z"}


def _none() -> Column:
    return F.lit(None).cast("string")


def verified_owner(links: DataFrame, personas: DataFrame) -> DataFrame:
    """(account_id, persona_id, persona_name): the first verified link, by its id, to a verified persona."""
    sure = personas.where("review_status = 'verified'").select(F.col("id").alias("persona_id"), F.col("canonical_name").alias("persona_name"))
    owned = links.where("review_status = 'verified'").join(sure, "persona_id")
    return owned.groupBy("account_id").agg(F.min(F.struct("id", "persona_id", "persona_name")).alias("o")).select("account_id", "o.persona_id", "o.persona_name")


def new_rows(accounts: DataFrame, links: DataFrame, personas: DataFrame, delivered: DataFrame, platform: str) -> DataFrame:
    """Rows to append to a platform's table: (platform_id, handle, name, persona_id, account_id) of owned accounts with a stable
    id that the table does not have; nothing that is there is touched. Of accounts with one id the first goes."""
    own = accounts.where((F.col("platform") == platform) & F.coalesce(F.col("platform_id").rlike(DELIVERED_IDS[platform]), F.lit(False)))
    owned = own.join(verified_owner(links, personas), F.col("id") == F.col("account_id")).join(delivered.select("platform_id").distinct(), "platform_id", "left_anti")
    name = F.coalesce(F.nullif("persona_name", F.lit("")), "name")
    first = owned.groupBy("platform_id").agg(F.min(F.struct("account_id", F.coalesce("handle", F.lit("")).alias("handle"), name.alias("name"), "persona_id")).alias("r"))
    return first.select("platform_id", "r.handle", "r.name", "r.persona_id", "r.account_id")


def name_updates(delivered: DataFrame, personas: DataFrame) -> DataFrame:
    """(platform_id, old_name, new_name) where a delivered row has a name that its persona's notes call an earlier one."""
    past = personas.select(F.col("id").alias("persona_id"), F.col("canonical_name").alias("new_name"), earlier_names(F.col("notes")).alias("past"))
    joined = delivered.join(past.where("size(past) > 0 AND new_name IS NOT NULL"), "persona_id")
    return joined.where(F.array_contains("past", F.col("name")) & (F.col("name") != F.col("new_name"))).select("platform_id", F.col("name").alias("old_name"), "new_name")


def _id(kind: str, *parts: Column | str) -> Column:
    seed = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.concat(F.lit(f"{kind}_"), F.substring(F.sha2(seed, 256), 1, 20))


def write_plan(found: DataFrame, known: dict[str, DataFrame]) -> DataFrame:
    """(target, id, detail): what classified rows add to personas, accounts, links, inbox and reviews.

    ``found``: discovery_id, bucket, reason, platform, platform_id, handle, url, name, channel_id. A channel id replaces what
    was parsed. A confirmed row whose new ids are taken goes to review; every other target drops what it has already, the
    inbox by its id or by the account's identity. ``known``: personas, accounts, links, reviews (id) and inbox (id, platform,
    platform_id, handle).
    """
    channel = F.coalesce("channel_id", F.lit("")).startswith("UC")
    rows = found.withColumns({
        "platform_id": F.when(channel, F.col("channel_id")).otherwise(F.coalesce("platform_id", F.lit(""))), "handle": F.coalesce("handle", F.lit("")),
        "url": F.when(channel, F.concat(F.lit("https://www.youtube.com/channel/"), "channel_id")).otherwise(F.coalesce("url", F.lit(""))),
        "platform": F.when(channel, "youtube").otherwise(F.coalesce("platform", F.lit("other"))),
    })
    stable = F.coalesce(F.nullif("platform_id", F.lit("")), F.lower("url"))
    confirmed = rows.where("bucket = 'NEW_CONFIRMED_PERSONA'").select("*", _id("persona", "found", F.col("discovery_id")).alias("persona"), _id("acct", "found-account", F.col("platform"), stable).alias("account"))
    taken_persona, taken_account = (known[t].select(F.col("id").alias(c), F.lit(True).alias(f"{c}_taken")).distinct() for t, c in (("personas", "persona"), ("accounts", "account")))
    confirmed = confirmed.join(taken_persona, "persona", "left").join(taken_account, "account", "left")
    free = confirmed.where("persona_taken IS NULL AND account_taken IS NULL")

    def entries(rows: DataFrame, target: str, key: Column, detail: Column) -> DataFrame:
        return rows.select(F.lit(target).alias("target"), key.alias("id"), detail.alias("detail"))

    def review(rows: DataFrame, reason: Column) -> DataFrame:
        return entries(rows, "reviews", _id("rq", F.col("discovery_id"), reason), reason)

    waiting = rows.where("bucket = 'UNRESOLVED_CANDIDATE'").withColumn("identity", inbox_key(F.col("platform"), F.col("platform_id"), F.col("handle")))
    there = known["inbox"].select(inbox_key(F.col("platform"), F.coalesce("platform_id", F.lit("")), F.coalesce("handle", F.lit(""))).alias("identity"))
    waiting = waiting.join(there, "identity", "left_anti").join(known["inbox"].select(F.col("id").alias("discovery_id")), "discovery_id", "left_anti")
    links = entries(free, "links", _id("link", F.col("account"), F.col("persona")), F.concat_ws(">", "account", "persona")).distinct()
    reviews = [
        review(confirmed.where("persona_taken OR account_taken"), F.lit("id_collision")), review(rows.where("bucket = 'HUMAN_NEGATIVE'"), F.lit("human_negative")),
        review(rows.where("bucket = 'SCREENED_NON_CANONICAL'"), F.concat(F.lit("screened_"), F.lower(F.coalesce("reason", F.lit(""))))), review(rows.where("bucket = 'CONFLICT'"), F.coalesce("reason", F.lit(""))),
    ]
    state = F.when((F.col("platform_id") != "") | (F.col("url") != ""), "pending_review").otherwise("unresolved_platform_id")
    return reduce(DataFrame.unionByName, [
        entries(free, "personas", F.col("persona"), F.coalesce(F.nullif("name", F.lit("")), "handle")),
        entries(free, "accounts", F.col("account"), F.concat_ws(":", "platform", stable)).distinct(),
        links.join(known["links"].select("id"), "id", "left_anti").select("target", "id", "detail"),
        entries(waiting, "inbox", F.col("discovery_id"), state),
        reduce(DataFrame.unionByName, reviews).join(known["reviews"].select("id"), "id", "left_anti").select("target", "id", "detail"),
    ])


def private_audit(tables: dict[str, DataFrame], registered: set[str], public: DataFrame, pseudonym: str = "viewer_id") -> DataFrame:
    """(place, status, reason, count) over private tables of text cells and public files (path, text).

    Per table: its rows that are not empty (``rows``), and what it must not hold: secret or message columns, cells with the
    shape of a credential. Per public file: how many pseudonyms of the tables it holds. Values are never shown.
    """
    found, pseudonyms = [], []
    for name, rows in tables.items():
        filled = reduce(Column.__or__, [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) != "" for c in rows.columns])
        secret = reduce(Column.__or__, [policy.has_secret_shape(F.col(f"`{c}`").cast("string")) for c in rows.columns])
        counts = rows.agg(F.count_if(filled).alias("rows"), F.count_if(secret).alias("secret"))
        columns = [c for c in rows.columns if c.lower() in policy.SECRET_FIELDS], [c for c in rows.columns if c in TEXT_FIELDS]
        told = [
            ("INFO", "rows", F.col("rows")), ("FAIL", "secret_value", F.col("secret")), ("FAIL", "secret_column", F.lit(len(columns[0])).cast("long")),
            ("FAIL", "message_column", F.lit(len(columns[1])).cast("long")), ("WARNING", "unregistered_table", F.lit(int(name not in registered)).cast("long")),
        ]
        entries = F.array(*[F.struct(F.lit(name).alias("place"), F.lit(s).alias("status"), F.lit(r).alias("reason"), n.alias("count")) for s, r, n in told])
        found.append(counts.select(F.inline(entries)).where("reason = 'rows' OR count > 0"))
        if pseudonym in rows.columns:
            pseudonyms.append(rows.select(F.col(pseudonym).cast("string").alias(pseudonym)))
    if pseudonyms:
        leaks = intake.leaked_pseudonyms(public, reduce(DataFrame.unionByName, pseudonyms).distinct(), pseudonym=pseudonym)
        found.append(leaks.select(F.col("path").cast("string").alias("place"), F.lit("FAIL").alias("status"), F.lit("pseudonym_in_public").alias("reason"), F.col("pseudonyms").alias("count")))
    return reduce(DataFrame.unionByName, found)
