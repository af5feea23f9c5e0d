"""Instants, durations and partial dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(text: Column) -> Column:
    """ISO text to a timestamp (UTC where no offset is given), or null."""
    return F.try_to_timestamp(F.trim(text))


def utc_text(text: Column) -> Column:
    """ISO text to ISO text in UTC with seconds, or null."""
    return F.date_format(instant(text), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def zoned(text: Column) -> Column:
    """Whether the text is an instant with an explicit offset."""
    return F.coalesce(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & instant(text).isNotNull(), F.lit(False))


def elapsed_days(since: Column, now: Column) -> Column:
    """Whole periods of 24 hours, not calendar days."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(since)) / 86400)


def quota_day(at: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(at, "America/Los_Angeles"), "yyyy-MM-dd")


def _part(text: Column, unit: str, head: str) -> Column:
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, head + rf"(\d+){unit}", 1), F.lit("")), F.lit("999999999")).cast("long"), F.lit(0))


def duration_seconds(text: Column) -> Column:
    """P1DT2H3M4S in seconds; -1 if it is no such duration."""
    ok = F.coalesce(text, F.lit("")).rlike(r"^P(\d+D)?T?(\d+H)?(\d+M)?(\d+S)?$")
    day, hour, minute, second = (_part(text, u, "") for u in "DHMS")
    return F.when(ok, ((day * 24 + hour) * 60 + minute) * 60 + second).otherwise(-1)


def clock_seconds(text: Column) -> Column:
    """PT2H3M4S in seconds, days and other text ignored; 0 if it does not start so."""
    lead = F.regexp_extract(F.coalesce(text, F.lit("")), r"^(PT(?:\d+H)?(?:\d+M)?(?:\d+S)?)", 1)
    return F.when(lead != "", (_part(lead, "H", "") * 60 + _part(lead, "M", "")) * 60 + _part(lead, "S", "")).otherwise(0)


def partial_date(year: Column, month: Column, day: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD, as far as the parts are known."""
    y, m, d = F.format_string("%04d", year.cast("int")), F.format_string("-%02d", month.cast("int")), F.format_string("-%02d", day.cast("int"))
    return F.when(year.isNull(), None).when(month.isNull(), y).when(day.isNull(), F.concat(y, m)).otherwise(F.concat(y, m, d))


def backoff(attempt: Column, base: int = 60, cap: int = 3600) -> Column:
    """Seconds to wait after so many failures: doubling, up to the cap."""
    return F.least(F.lit(cap), base * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(30)))).cast("long")
