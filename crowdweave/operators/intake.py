"""Taking in candidates: directory pages, normal forms, the merge of registries, record checks, audits and replay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdweave.functions.scores import AGENCY_WORDS
from crowdweave.operators import checks

#: Words in a channel's title and the agency they stand for: those of the registry, but one that titles shorten (fixed value).
TITLE_WORDS = [(["myriad"] if agency == "Myriad Colors" else words, agency) for words, agency in AGENCY_WORDS]
#: Agency of those without one (fixed value).
NO_AGENCY = "Independent"
#: A channel id: 24 characters, the first two as given (fixed value).
CHANNEL_ID = r"\AUC(?s:.{22})\z"
#: A reviewer's word for "not relevant" (fixed value).
REJECTING_NOTE = "ไม่เกี่ยวข้อง"
#: The policy that a first pass over videos follows (fixed value).
FIRST_PASS_POLICY = "bulk-fair-channel-year-page15-v3"
#: A pseudonym: 64 hexadecimal digits.
PSEUDONYM = r"\b[a-f0-9]{64}\b"
_DIRECTORY = "result array<struct<channel_id: string, title: string, subscribers: string, views: string, published_at: string, last_published_video_at: string, is_rebranded: boolean>>"


def _given(*columns: str) -> Column:
    """The first of the columns that is neither null nor '', else ''."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns], F.lit(""))


def _whole(*columns: str) -> Column:
    """The first column with a value, as a whole number; 0 where it is none."""
    return F.coalesce(_given(*columns).try_cast("bigint"), F.lit(0))


def title_agency(title: Column) -> Column:
    text = F.lower(title)
    found = [F.when(reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words]), agency) for words, agency in TITLE_WORDS]
    return F.coalesce(*found, F.lit(NO_AGENCY))


def directory_rows(pages: DataFrame, source: str, body: str = "body") -> DataFrame:
    """Channels of a ranking directory's JSON pages; entries without a channel id go."""
    items = pages.select(F.inline(F.from_json(body, _DIRECTORY)["result"]))
    rows = items.withColumns({"channel_id": F.trim("channel_id"), "name": F.trim(F.coalesce("title", F.lit("")))}).where(F.col("channel_id").rlike(CHANNEL_ID))
    return rows.select(
        "channel_id", F.concat(F.lit("@"), F.regexp_replace("name", "[^a-zA-Z0-9_]", "")).alias("handle"), "name",
        _whole("subscribers").alias("subscriber_count"), _whole("views").alias("view_count"), F.lit(source).alias("source"),
        _given("published_at").alias("channel_created_at"), _given("last_published_video_at").alias("last_published_video_at"),
        title_agency(F.col("name")).alias("agency"), F.coalesce("is_rebranded", F.lit(False)).alias("is_rebranded"),
    )


def normalized(raw: DataFrame, default_source: str) -> DataFrame:
    """Candidates of any source, which may name columns in two ways, in one form."""
    return raw.select(
        F.trim(_given("channel_id", "id")).alias("channel_id"), F.trim(_given("handle")).alias("handle"), F.trim(_given("name", "title")).alias("name"),
        _whole("subscriber_count", "subscribers").alias("subscriber_count"), F.coalesce(F.nullif("source", F.lit("")), F.lit(default_source)).alias("source"),
        F.lit(1).alias("source_count"), _given("description").alias("description"), F.coalesce(F.nullif("agency", F.lit("")), F.lit(NO_AGENCY)).alias("agency"),
    )


def merged_registry(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """One row per channel id over the sources, the first of which comes first: (channel_id, name, handle, agency,
    graduated) of each. Names are those of the first source that has the channel; an agency replaces none; a hint that
    a channel ended holds whoever gives it; ``sources`` lists where it was found, in their order."""
    columns = ["channel_id", "name", "handle", "agency", "graduated"]
    rows = reduce(DataFrame.unionByName, [
        rows.select(*columns, F.lit(i).alias("rank"), F.lit(name).alias("source")) for i, (name, rows) in enumerate(sources)
    ])
    agency = F.when(F.coalesce("agency", F.lit("")).isin("", NO_AGENCY), None).otherwise(F.col("agency"))
    order = F.struct("rank", "name", "handle")
    grouped = rows.where(F.col("channel_id").rlike(CHANNEL_ID)).groupBy("channel_id").agg(
        F.min_by(F.struct("name", "handle"), order).alias("first"), F.min_by(agency, F.when(agency.isNotNull(), F.struct("rank", agency.alias("a")))).alias("agency"),
        F.array_sort(F.collect_set(F.struct("rank", "source"))).alias("found"), F.bool_or(F.coalesce("graduated", F.lit(False))).alias("graduated"),
    )
    return grouped.select("channel_id", "first.name", "first.handle", F.coalesce("agency", F.lit(NO_AGENCY)).alias("agency"), F.col("found.source").alias("sources"), "graduated")


def catalog_rows(accounts: DataFrame, creators: DataFrame) -> DataFrame:
    """Flat catalogue rows: accounts (persona_id, platform_id, display_name, handle, metadata map) with their creator; what
    the metadata names, even as null, replaces the default."""

    def said(key: str, default: Column) -> Column:
        return F.when(F.map_contains_key("metadata", key), F.col("metadata")[key]).otherwise(default).alias(key)

    none = F.lit(None).cast("string")
    joined = accounts.join(creators, "persona_id")
    return joined.select(
        F.col("platform_id").alias("channel_id"), F.col("display_name").alias("name"), said("legacy_handle", F.col("handle")).alias("handle"), "agency",
        said("activity_status", F.col("lifecycle_status")), said("vtuber_status", F.lit("CONFIRMED")), F.col("persona_id").alias("person_id"), "canonical_name",
        said("channel_type", F.lit("main")), said("subscriber_count", none), said("country", none), said("enabled", F.lit("true")),
    )


def record_problems(rows: DataFrame, key: str, texts: list[str], lists: list[str], filled: list[str]) -> DataFrame:
    """(key, problem): the first field that breaks the contract: texts must not be blank, lists must be there and hold
    no blank text, and those in ``filled`` must hold something."""
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    found = [F.when(blank(F.col(c)), f"{c}: blank") for c in texts]
    for c in lists:
        found.append(F.when(F.col(c).isNull(), f"{c}: missing"))
        if c in filled:
            found.append(F.when(F.size(c) == 0, f"{c}: empty"))
        found.append(F.when(F.exists(c, blank), f"{c}: blank text"))
    return rows.select(key, F.coalesce(*found).alias("problem")).where("problem is not null")


def note_rejects(note: Column) -> Column:
    return F.contains(F.coalesce(note, F.lit("")), F.lit(REJECTING_NOTE))


def follows_policy(job: Column, version: str = FIRST_PASS_POLICY) -> Column:
    return F.get_json_object(job, "$.policy_version").eqNullSafe(F.lit(version))


def leaked_pseudonyms(public: DataFrame, private: DataFrame, path: str = "path", text: str = "text", pseudonym: str = "viewer_id") -> DataFrame:
    """Public files that hold a pseudonym of the private side, and how many different ones."""
    seen = public.select(path, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(PSEUDONYM), 0))).alias("_p"))
    known = private.where(F.coalesce(pseudonym, F.lit("")) != "").select(F.col(pseudonym).alias("_p"))
    return seen.join(known, "_p", "left_semi").groupBy(path).agg(F.countDistinct("_p").alias("pseudonyms"))


def replayed(records: DataFrame) -> DataFrame:
    """State of jobs from their batches (job, sequence, row_number, kind, payload), each checked against its manifest:
    job, batches, the number of batches at fault, the latest state and how many different events were seen. A job with
    a faulty batch has neither state nor events; it must be reconciled first."""
    checked = checks.batches(records.select(F.struct("job", "sequence").alias("path"), "row_number", "kind", "payload"))
    per_job = checked.groupBy("path.job").agg(F.count(F.lit(1)).alias("batches"), F.count("problem").alias("faulty"))
    sums = records.groupBy("job").agg(
        F.max_by("payload", F.when(F.col("kind") == "state", F.struct("sequence", "row_number"))).alias("state"),
        F.countDistinct(F.when(F.col("kind") == "event", F.col("payload"))).alias("seen"),
    )
    sound = F.col("faulty") == 0
    return per_job.join(sums, "job").select("job", "batches", "faulty", F.when(sound, F.col("state")).alias("state"), F.when(sound, F.col("seen")).alias("seen"))
