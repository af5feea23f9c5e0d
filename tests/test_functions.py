import datetime

import pytest
from pyspark.sql import functions as F

from crowdweave.functions import scores, times, urls


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "url, expected",
    [
        ("https://ezdn.app/Foo_VT", ("easydonate", "foo_vt", "https://easydonate.app/foo_vt")),
        ("https://www.tipjai.com/slug?x=1", ("tipjai", "slug", "https://tipjai.com/slug")),
        ("https://tipnoi.app/slug", ("tipnoi", "slug", "https://tipnoi.app/slug")),
        ("https://streamlabs.com/user/tip", ("streamlabs", "user", "https://streamlabs.com/user/tip")),
        ("https://streamlabs.com/user", None),
        ("https://tipjai.com/discover/x", None),
        ("https://unknown.example/slug", None),
        ("https://tipjai.com/", None),
        (None, None),
    ],
)
def test_donation_links(spark, url, expected):
    found = one(spark, urls.donation_account, url)
    assert (tuple(found) if found else None) == expected


@pytest.mark.parametrize(
    "url, expected",
    [
        ("http://www.Example.org/A/b/?q=1", "example.org/a/b"), ("m.youtube.com/@Name/", "youtube.com/@name"), ("https://twitter.com/X", "x.com/x"), ("", ""), (None, ""),
    ],
)
def test_normalized_url(spark, url, expected):
    assert one(spark, urls.normalized_url, url) == expected


@pytest.mark.parametrize(
    "url, expected",
    [
        ("HTTPS://Example.org:443/a/?b=c#d", "https://example.org/a?b=c"), ("http://e.org:8080", "http://e.org:8080/"), ("ftp://e.org/", None), ("nothing", None), (None, None),
    ],
)
def test_canonical_url(spark, url, expected):
    assert one(spark, urls.canonical_url, url) == expected


@pytest.mark.parametrize(
    "url, expected",
    [
        ("https://www.youtube.com/@name", ("youtube", "", "name")), ("https://youtube.com/channel/UCabc", ("youtube", "UCabc", "")), ("https://youtube.com/watch?v=1", None),
        ("twitch.tv/login", ("twitch", "", "login")), ("https://tiktok.com/@t", ("tiktok", "", "t")), ("https://twitter.com/h", ("x", "", "h")), ("https://x.com/i/1", None),
        ("https://bsky.app/profile/h.org", ("bluesky", "", "h.org")), ("https://me.carrd.co", ("website", "", "me.carrd.co")), ("https://example.org/a", None), (None, None),
    ],
)
def test_account_of(spark, url, expected):
    found = one(spark, urls.account_of, url)
    assert (tuple(found)[:3] if found else None) == expected


def test_links_lose_trailing_punctuation_and_repeats(spark):
    found = one(spark, urls.links, "see https://a.org/x。 and (https://m.b.org/y), https://a.org/x")
    assert [tuple(x) for x in found] == [("https://a.org/x", "a.org"), ("https://m.b.org/y", "b.org")]
    assert one(spark, urls.links, None) == []


@pytest.mark.parametrize("text, seconds, clock", [("PT1H2M3S", 3723, 3723), ("P1DT1S", 86401, 0), ("PT45S", 45, 45), ("", -1, 0), (None, -1, 0), ("x", -1, 0), ("PT", 0, 0)])
def test_durations(spark, text, seconds, clock):
    assert one(spark, times.duration_seconds, text) == seconds
    assert one(spark, times.clock_seconds, text) == clock


def test_times(spark):
    assert one(spark, times.utc_text, "2024-01-01T07:00:00+07:00") == "2024-01-01T00:00:00+00:00"
    assert one(spark, times.utc_text, "nonsense") is None
    assert one(spark, times.zoned, "2024-01-01T07:00:00Z") and not one(spark, times.zoned, "2024-01-01T07:00:00")
    at = datetime.datetime(2024, 1, 2, 12)
    assert one(spark, lambda x: times.elapsed_days(x, F.lit("2024-01-04 11:00:00").cast("timestamp")), at, "timestamp") == 1
    assert one(spark, times.quota_day, datetime.datetime(2024, 1, 2, 7), "timestamp") == "2024-01-01"
    assert [one(spark, times.backoff, n, "int") for n in (1, 2, 7, 40)] == [60, 120, 3600, 3600]
    assert one(spark, lambda x: times.partial_date(x, F.lit(3), F.lit(None).cast("int")), 2024, "int") == "2024-03"


def test_scores(spark):
    assert [one(spark, scores.tier, n, "long") for n in (100_000, 50_000, 10_000, 1_000, 999)] == list("SABCD")
    assert one(spark, scores.subscriber_score, 100, "long") == 0.0 and one(spark, scores.subscriber_score, 10**7, "long") == 1.0
    now = F.lit("2024-01-04 00:00:00").cast("timestamp")
    assert one(spark, lambda x: scores.gap_score(x, now), "2024-01-02T12:00:00Z") == 0.5
    assert one(spark, lambda x: scores.gap_score(x, now), None) == 1.0 and one(spark, lambda x: scores.gap_score(x, now), "never") == 0.5
    assert one(spark, scores.lenient_int, "1,234 ") == 1234 and one(spark, scores.lenient_int, "x") is None
    assert one(spark, lambda x: scores.thai_confidence(x, F.lit("สวัสดีครับ vtuber"), F.lit("@NameTH")), "Name") == 0.85
    assert one(spark, lambda x: scores.agency_of(x, F.lit("of Polygon"), F.lit("")), "Name") == "Polygon Official"
    assert [one(spark, scores.error_kind, m) for m in ("commentsDisabled", "HTTP 429", None)] == ["COMMENTS_DISABLED", "RATE_LIMITED", "EXTRACTION_FAILURE"]
    assert one(spark, lambda x: scores.short_video(F.lit(30), x), None, "boolean") is True
    assert one(spark, lambda x: scores.activity(x, F.lit("public"), F.lit(False), now), "2023-12-31") == "active"


def test_decisions(spark):
    now = F.lit("2024-01-04 00:00:00").cast("timestamp")

    def decide(**given):
        v = {"manual": None, "name": "Name", "description": "", "handle": "", "subscribers": 500, "sources": 2, "agency": "", "last": "2024-01-01T00:00:00Z"} | given
        c = [F.lit(v["manual"]).cast("boolean"), *(F.lit(v[k]) for k in ("name", "description", "handle", "subscribers", "sources", "agency", "last"))]
        return spark.range(1).select(scores.candidate_decision(*c, now).alias("d")).first().d

    assert decide(manual=True).status == "ACCEPT" and decide(manual=False).status == "REJECT"
    assert decide(last="2023-01-01T00:00:00Z").reason == "idle_days:368"
    assert decide(agency="Polygon").status == "ACCEPT" and decide(agency="Polygon").confidence == 0.9
    assert decide().status == "REJECT"
    assert decide(description="vtuber", subscribers=5, sources=1).status == "REVIEW"
    assert decide(description="vtuber สวัสดีครับ", handle="@xth").status == "ACCEPT"


def test_registry_status(spark):
    def status(name="N", description="", handle="", country="", sources=()):
        c = [F.lit(x) for x in (name, description, handle, country)]
        return spark.range(1).select(scores.registry_status(*c, F.array(*[F.lit(s) for s in sources]).cast("array<string>")).alias("s")).first().s

    assert status() == "UNCONFIRMED" and status(description="of Polygon") == "CONFIRMED"
    assert status(description="vtuber from thailand", handle="@xth") == "CONFIRMED" and status(description="virtual idol") == "UNCONFIRMED"
    assert status(sources=["Seed List"]) == "UNCONFIRMED" and status(sources=["Seed List", "other"]) == "CONFIRMED" and status(country="TH", sources=["Seed List"]) == "CONFIRMED"


def test_records(spark):
    from crowdweave.functions import records

    wiki = "{{Infobox|status = Retired 2020\n|affiliation= polygon (x)}} https://youtube.com/@name UC" + "a" * 22
    found = one(spark, records.wiki_entry, wiki)
    assert (found.channel_id, found.handle, found.agency, found.graduated) == ("UC" + "a" * 22, "@name", "Polygon", True)
    assert one(spark, records.wiki_entry, None).agency == "Independent"
    assert [one(spark, records.persona_type, t, "array<string>") for t in (["PNG"], ["PNG", "3D"], ["3D"], [])] == ["pngtuber", "mixed", "vtuber", "unknown"]
    assert one(spark, records.identity_key, "Ab_c-ก่d!") == "abcกd"
    assert one(spark, records.earlier_names, "renamed_from_slug=a; renamed_from=B c (x)") == ["B c", "a"]
    assert one(spark, lambda x: records.inbox_key(F.lit("x"), F.lit(""), x), "@Me") == "x:me"
    assert one(spark, records.uploads_playlist, "UCabc") == "UUabc" and one(spark, records.uploads_playlist, "abc") is None
    assert one(spark, records.public_https, "https://a.org/x") and not one(spark, records.public_https, "https://u:p@a.org") and not one(spark, records.public_https, None)
    assert [one(spark, records.truthy, x) for x in (" YES", "0", None)] == [True, False, True]
    assert one(spark, lambda x: records.person_id(F.lit("UCx12345678"), F.lit("ชื่อ"), x), "@Foo") == "person_foo"
    assert one(spark, lambda x: records.channel_kind(x), "Foo Music") == "sub"
