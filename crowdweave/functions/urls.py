"""URLs, handles, links and deterministic ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Lower-case host without credentials, port and a leading www."""
    found = F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(found), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def with_scheme(url: Column) -> Column:
    trimmed = F.trim(F.coalesce(url, F.lit("")))
    return F.when(trimmed == "", "").when(trimmed.contains("://"), trimmed).otherwise(F.concat(F.lit("https://"), trimmed))


def normalized_url(url: Column) -> Column:
    """Host and lower-cased path without the scheme, www., a trailing slash or a query; '' for none."""
    full = with_scheme(url)
    own = host(full)
    own = F.when(own.isin("m.youtube.com", "youtu.be"), "youtube.com").when(own == "twitter.com", "x.com").otherwise(own)
    return F.when(full == "", "").otherwise(F.concat(own, F.lower(F.regexp_replace(path(full), "/+$", ""))))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no trailing slash, query kept, fragment dropped; null if not HTTP."""
    trimmed = F.trim(url)
    scheme = F.lower(F.regexp_extract(trimmed, r"(?i)^(https?)://", 1))
    own = F.lower(F.regexp_extract(trimmed, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    port = F.regexp_extract(trimmed, r"(?i)^https?://[^/?#]*:(\d+)(?:[/?#]|$)", 1)
    default = ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80")) | (port == "")
    bare = F.regexp_replace(path(trimmed), "/+$", "")
    query = F.regexp_extract(trimmed, r"^[^?#]*\?([^#]*)", 1)
    return F.when((scheme != "") & (own != ""), F.concat(
        scheme, F.lit("://"), own, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), F.when(bare == "", "/").otherwise(bare),
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    ))


def normalized_handle(handle: Column) -> Column:
    """Without outer spaces and leading @, lower case; null for none."""
    return F.nullif(F.lower(F.ltrim(F.trim(handle), F.lit("@"))), F.lit(""))


def uid(prefix: str, value: Column) -> Column:
    """A deterministic id: the prefix and 20 hexadecimal digits of SHA-256."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(value, 256), 1, 20))


#: Link hosts that take donations: platform, canonical URL (fixed values).
DONATION_HOSTS = {
    "easydonate.app": ("easydonate", "https://easydonate.app/"),
    "ezdn.app": ("easydonate", "https://easydonate.app/"),
    "tipjai.com": ("tipjai", "https://tipjai.com/"),
    "tipnoi.app": ("tipnoi", "https://tipnoi.app/"),
    "ko-fi.com": ("kofi", "https://ko-fi.com/"),
    "buymeacoffee.com": ("buymeacoffee", "https://buymeacoffee.com/"),
    "streamlabs.com": ("streamlabs", "https://streamlabs.com/"),
}
#: First path parts that are pages of the host, not people (fixed values).
RESERVED_SLUGS = [
    "discover", "explore", "login", "signup", "register", "dashboard", "api", "settings", "about", "terms", "privacy",
    "pricing", "help", "docs", "blog", "for", "link", "overlay", "auth",
]


def donation_account(url: Column) -> Column:
    """A struct (platform, slug, url) of a donation link, or null."""
    own = host(url)
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    slug = F.ltrim(F.try_element_at(parts, F.lit(1)), F.lit("@"))
    second = F.lower(F.try_element_at(parts, F.lit(2)))
    platform = F.create_map(*[F.lit(x) for h, (p, _) in DONATION_HOSTS.items() for x in (h, p)])[own]
    base = F.create_map(*[F.lit(x) for h, (_, u) in DONATION_HOSTS.items() for x in (h, u)])[own]
    ok = platform.isNotNull() & slug.rlike(r"^[A-Za-z0-9_.-]{2,40}$") & ~F.lower(slug).isin(RESERVED_SLUGS)
    ok = ok & ((platform != "streamlabs") | second.eqNullSafe(F.lit("tip")))
    tail = F.when(platform == "streamlabs", "/tip").otherwise("")
    return F.when(ok, F.struct(platform.alias("platform"), F.lower(slug).alias("slug"), F.concat(base, F.lower(slug), tail).alias("url")))


def links(text: Column) -> Column:
    """Distinct (url, host) of the links in a text, without trailing punctuation."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"((?i)https?://[^\s<>()\[\]\"'，、。]+)"), 1)
    cleaned = F.transform(found, lambda x: F.regexp_replace(x, r"[.,;:!?)」』】。]+$", ""))
    both = F.transform(F.array_distinct(cleaned), lambda x: F.struct(x.alias("url"), F.regexp_replace(host(x), r"^m\.", "").alias("host")))
    return F.filter(both, lambda x: x["host"] != "")


#: Path parts that do not name an account (fixed values).
VIDEO_PARTS = ["watch", "shorts", "live", "embed", "clip", "videos", "video", "v"]
#: Hosts, the platform and address they stand for, and path parts that are no accounts (fixed values).
_OTHER = {
    "twitch.tv": ("twitch", "https://www.twitch.tv/", VIDEO_PARTS, False),
    "x.com": ("x", "https://x.com/", ["i", "intent", "share", "search"], True),
    "twitter.com": ("x", "https://x.com/", ["i", "intent", "share", "search"], True),
    "instagram.com": ("instagram", "https://www.instagram.com/", ["p", "reel", "reels", "stories"], True),
    "facebook.com": ("facebook", "https://www.facebook.com/", ["watch", "share", "reel", "posts"], True),
}


def account_of(url: Column) -> Column:
    """A struct (platform, platform_id, handle, url) of an account URL, or null."""
    full = with_scheme(url)
    own = host(full)
    parts = F.filter(F.split(path(full), "/"), lambda x: x != "")
    one, two, n = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2)), F.size(parts)

    def account(platform: str, platform_id: Column, handle: Column, address: Column) -> Column:
        return F.struct(F.lit(platform).alias("platform"), platform_id.alias("platform_id"), handle.alias("handle"), address.alias("url"))

    none, at = F.lit(""), F.substring(one, 2, 1 << 20)
    video = own.isin("youtube.com", "m.youtube.com")
    out = F.when(own.endswith("carrd.co"), account("website", none, own, F.concat(F.lit("https://"), own, F.lit("/"))))
    out = out.when(n == 0, None)
    out = out.when(video & one.startswith("@") & (n == 1), account("youtube", none, at, F.concat(F.lit("https://www.youtube.com/@"), at)))
    out = out.when(video & (one == "channel") & two.startswith("UC"), account("youtube", two, none, F.concat(F.lit("https://www.youtube.com/channel/"), two)))
    out = out.when((own == "tiktok.com") & one.startswith("@") & (n == 1), account("tiktok", none, at, F.concat(F.lit("https://www.tiktok.com/@"), at)))
    out = out.when((own == "bsky.app") & (one == "profile") & (n >= 2), account("bluesky", none, two, F.concat(F.lit("https://bsky.app/profile/"), two)))
    for name, (platform, base, banned, alone) in _OTHER.items():
        fits = (own == name) & ~F.lower(one).isin(banned) & ((n == 1) if alone else F.lit(True))
        out = out.when(fits, account(platform, none, one, F.concat(F.lit(base), one)))
    return out
