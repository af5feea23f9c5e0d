"""Small rules on names, notes, wiki pages and record fields as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Groups that wiki pages name (fixed values).
WIKI_AGENCIES = ["Algorhythm Project", "Polygon", "Pixela", "Lumina", "Euphora"]
#: Words of a channel's name that speak for a second channel (fixed values).
SUB_WORDS = ["ch.2", "sub", "music", "shorts", "clips", "archive"]


def wiki_entry(text: Column) -> Column:
    """A struct (channel_id, handle, agency, graduated) of a wiki page's source text."""
    text = F.coalesce(text, F.lit(""))
    ids = F.regexp_extract(text, "(UC[a-zA-Z0-9_-]{22})", 1)
    names = F.regexp_extract_all(text, F.lit(r"youtube\.com/(?:channel/|c/|user/|@)?([a-zA-Z0-9_\-.]+)"), 1)
    handles = F.filter(names, lambda h: ~(h.startswith("UC") & (F.length(h) == 24)))
    status = F.lower(F.regexp_extract(text, r"(?i)\|status\s*=\s*([^\n|}]+)", 1))
    group = F.lower(F.regexp_extract(text, r"(?i)\|affiliation\s*=\s*([^\n|}]+)", 1))
    agency = F
    for name in WIKI_AGENCIES:
        agency = agency.when(group.contains(name.lower()), name)
    return F.struct(
        ids.alias("channel_id"), F.when(F.size(handles) > 0, F.concat(F.lit("@"), F.try_element_at(handles, F.lit(1)))).otherwise("").alias("handle"),
        agency.otherwise("Independent").alias("agency"), status.rlike("retired|graduated|inactive|terminated").alias("graduated"),
    )


def persona_type(types: Column) -> Column:
    kinds = F.array_distinct(types)
    return (
        F.when(F.size(kinds) == 0, "unknown").when((F.size(kinds) == 1) & (F.element_at(kinds, 1) == "PNG"), "pngtuber")
        .when(F.array_contains(kinds, "PNG"), "mixed").otherwise("vtuber")
    )


def identity_key(value: Column) -> Column:
    """Lower case without anything but letters and numbers; combining marks go too, as they are no word characters."""
    return F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]", "")


def earlier_names(notes: Column) -> Column:
    """Names that notes say were used before."""
    slugs = F.regexp_extract_all(F.coalesce(notes, F.lit("")), F.lit(r"renamed_from_slug=([^;\s]+)"), 1)
    names = F.regexp_extract_all(F.coalesce(notes, F.lit("")), F.lit(r"renamed_from=(.*?) \("), 1)
    return F.array_sort(F.array_distinct(F.concat(slugs, names)))


def inbox_key(platform: Column, platform_id: Column, handle: Column) -> Column:
    """The platform's stable id, else the handle."""
    return F.concat_ws(":", platform, F.coalesce(F.nullif(platform_id, F.lit("")), F.lower(F.ltrim(handle, F.lit("@")))))


def uploads_playlist(channel_id: Column) -> Column:
    return F.when(channel_id.startswith("UC"), F.concat(F.lit("UU"), F.substring(channel_id, 3, 1 << 20)))


def public_https(url: Column) -> Column:
    """An HTTPS address with a host and without credentials."""
    return F.coalesce(url.rlike(r"^https://[^/?#@\s]+(?:[/?#]|$)"), F.lit(False))


def truthy(value: Column) -> Column:
    """Enabled flags as text; missing ones count as set."""
    return F.when(value.isNull(), True).otherwise(F.lower(F.trim(value)).isin("true", "1", "yes"))


def person_id(channel_id: Column, name: Column, handle: Column) -> Column:
    """An id for the person behind a channel: from the handle, else the name's letters, else the channel."""
    own = F.nullif(F.trim(F.regexp_replace(F.coalesce(handle, F.lit("")), "@", "")), F.lit(""))
    plain = F.nullif(F.regexp_replace(F.lower(name), "[^a-zA-Z0-9_]", ""), F.lit(""))
    return F.concat(F.lit("person_"), F.lower(F.coalesce(own, plain, F.right(channel_id, F.lit(8)))))


def channel_kind(name: Column) -> Column:
    text = F.lower(name)
    hit = F.lit(False)
    for word in SUB_WORDS:
        hit = hit | text.contains(word)
    return F.when(hit, "sub").otherwise("main")


def date_quality(published: Column, cutoff: Column) -> Column:
    """missing, before or exact, of a publication time against a cutoff."""
    return F.when(published.isNull(), "missing").when(published < cutoff, "before").otherwise("exact")


def requests_needed(channels: Column, videos: int = 1000, sampled: int = 48, records: int = 500, replies: int = 200) -> Column:
    """A struct of request estimates: catalog pages and comment pages, with ceilings."""
    catalog = channels * (F.ceil(F.lit(videos) / 50) + 1)
    comments = F.lit(sampled) * F.ceil(F.lit(records) / 100) + replies
    return F.struct(
        catalog.cast("long").alias("catalog_units"), F.ceil(F.round(catalog * 1.2, 6)).cast("long").alias("catalog_ceiling"),
        comments.cast("long").alias("interaction_units"), F.ceil(comments * 1.25).cast("long").alias("interaction_ceiling"),
    )
