"""Retention dates: what counts as known, criteria, cut-offs, ages. Sessions run in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dates before this instant are unknown, not old; upper bounds of age classes in days.
FIRST_KNOWN = "1980-01-02 00:00:00"
AGES = ((365, "ate-1-ano"), (730, "1-2-anos"), (1826, "2-5-anos"), (3652, "5-10-anos"))
OLDEST = "mais-10-anos"


def known(at: Column) -> Column:
    return F.when(at >= F.lit(FIRST_KNOWN).cast("timestamp"), at)


def latest(*at: Column) -> Column:
    """The latest known date; null if none is known."""
    return F.greatest(*map(known, at)) if len(at) > 1 else known(at[0])


def file_date(modified: Column, accessed: Column, created: Column, criterion: str) -> Column:
    """used: any of the three; opened: modified or accessed; modified and created: that one."""
    chosen = {"used": (modified, accessed, created), "opened": (modified, accessed), "modified": (modified,), "created": (created,), "accessed": (accessed,)}
    return latest(*chosen[criterion])


def changed_at(modified: Column, created: Column) -> Column:
    """A copied file is as new as its copy."""
    return F.greatest(modified, created)


def changed_within(at: Column, *, since: Column | None = None, before: Column | None = None) -> Column:
    """since inclusive, before exclusive; without a date an item is later than everything."""
    out = F.lit(True)
    if since is not None:
        out = out & (at.isNull() | (at >= since))
    if before is not None:
        out = out & (at.isNotNull() & (at < before))
    return out


def cutoff(now: Column, amount: int, unit: str) -> Column:
    """now less an age; months and years by the calendar, the day clamped to the month's end."""
    if unit == "days":
        return F.timestamp_seconds(F.unix_timestamp(now) - amount * 86_400)
    months = amount * (12 if unit == "years" else 1)
    return (F.add_months(now, -months).cast("timestamp").cast("long") + (now.cast("long") - F.to_date(now).cast("timestamp").cast("long"))).cast("timestamp")


def period_end(now: Column, last_day: Column) -> Column:
    """End of a period given by its last day: the next midnight, but not later than now."""
    return F.least(F.date_add(last_day, 1).cast("timestamp"), now)


def in_window(at: Column, cutoff_at: Column, floor: Column | None = None) -> Column:
    """Unknown dates never expire."""
    out = at.isNotNull() & (at < cutoff_at)
    return out if floor is None else out & (at >= floor)


def age_days(at: Column, now: Column) -> Column:
    days = F.floor((F.unix_millis(now) - F.unix_millis(at)) / 86_400_000)
    return F.when(at.isNotNull(), F.greatest(F.lit(0), days).cast("long"))


def age_bucket(days: Column) -> Column:
    out = F.lit(OLDEST)
    for limit, key in reversed(AGES):
        out = F.when(days < limit, F.lit(key)).otherwise(out)
    return F.when(days.isNotNull(), out)


def local_day(at: Column, zone: str = "UTC") -> Column:
    return F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd")


def within_days(at: Column, first: str | None, last: str | None, zone: str = "UTC") -> Column:
    """Both days inclusive, in a zone; rows without a time only pass if neither is given."""
    out = F.lit(True)
    if first:
        out = out & (at >= F.to_utc_timestamp(F.lit(first).cast("timestamp"), zone))
    if last:
        out = out & (at < F.to_utc_timestamp(F.date_add(F.lit(last).cast("date"), 1).cast("timestamp"), zone))
    return F.coalesce(out, F.lit(False))
