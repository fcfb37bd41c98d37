"""Fiscal and reporting periods, local days and schedules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fiscal_year(date: Column) -> Column:
    """The year in which the fiscal year (from 1 April) of a date began."""
    return F.year(date) - (F.month(date) < 4).cast("int")


def fiscal_start(year: Column) -> Column:
    return F.make_date(year, F.lit(4), F.lit(1))


def fiscal_label(year: Column, given: Column | None = None) -> Column:
    """``2024-2025``, unless a label like ``2024-25`` is given."""
    plain = F.concat_ws("-", year.cast("string"), (year + 1).cast("string"))
    return plain if given is None else F.when(given.rlike(r"^\d{4}-\d{2}$"), given).otherwise(plain)


def compact_date(c: Column) -> Column:
    """The date of YYYYMM or YYYYMMDD; null for anything else."""
    text = F.when(c.rlike(r"^\d{6}$"), F.concat(c, F.lit("01"))).when(c.rlike(r"^\d{8}$"), c)
    return F.to_date(F.try_to_timestamp(text, F.lit("yyyyMMdd")))


def any_date(c: Column, *formats: str) -> Column:
    """The date by the first format that fits."""
    return F.coalesce(*(F.to_date(F.try_to_timestamp(c, F.lit(f))) for f in formats))


def period(frequency: Column, year: Column, stamp: Column) -> Column:
    """measurement_year, period_basis, period_start, period_end and period_type of a monthly, quarterly or
    yearly value; null if it has no date of its kind. Years come as text or number, dates as text."""
    day = F.to_date(F.try_to_timestamp(stamp.cast("string")))
    whole = F.nullif(year.cast("string").try_cast("int"), F.lit(0))

    def of(basis: str, kind: str, start: Column, end: Column) -> Column:
        found = F.struct(F.year(start).alias("measurement_year"), F.lit(basis).alias("period_basis"), start.alias("period_start"), end.alias("period_end"), F.lit(kind).alias("period_type"))
        return F.when(start.isNotNull(), found)

    month, quarter = F.trunc(day, "month"), F.trunc(day, "quarter")
    return (
        F.when(frequency == "monthly", of("month", "month", month, F.last_day(month)))
        .when(frequency == "quarterly", of("quarter", "quarter", quarter, F.last_day(F.add_months(quarter, 2))))
        .otherwise(of("full_year", "calendar_year", F.make_date(whole, F.lit(1), F.lit(1)), F.make_date(whole, F.lit(12), F.lit(31))))
    )


def valid_on(start: Column, end: Column, date: Column) -> Column:
    """Closed range of dates with open ends."""
    return F.coalesce(start <= date, F.lit(True)) & F.coalesce(end >= date, F.lit(True))


def published_by(published_at: Column, now: Column) -> Column:
    return F.coalesce(published_at <= now, F.lit(False))


def local_day(date: Column, zone: Column | str) -> Column:
    """The instants at which a local calendar day starts and ends, as ``period_start`` and ``period_end``."""
    return F.struct(F.to_utc_timestamp(date.cast("timestamp"), zone).alias("period_start"), F.to_utc_timestamp(F.date_add(date, 1).cast("timestamp"), zone).alias("period_end"))


def checkpoints(published_at: Column, daily: int = 30, weekly: int = 16, monthly: int = 8) -> Column:
    """Instants at which to look again: daily from publication, then weekly, then monthly."""
    after = lambda base, n, unit, first: F.transform(F.sequence(F.lit(first), F.lit(first + n - 1)), lambda i: base + F.make_interval(**{unit: i}))
    week_base = published_at + F.make_interval(days=F.lit(daily))
    month_base = week_base + F.make_interval(weeks=F.lit(weekly))
    return F.concat(after(published_at, daily, "days", 0), after(week_base, weekly, "weeks", 1), after(month_base, monthly, "months", 1))


def next_checkpoint(published_at: Column, after: Column, **counts: int) -> Column:
    return F.get(F.filter(checkpoints(published_at, **counts), lambda t: t > after), F.lit(0))


def next_after(start: Column, every_seconds: Column | int, now: Column) -> Column:
    """The first of start, start + interval, .. that is strictly after now."""
    every = (F.lit(every_seconds) if isinstance(every_seconds, int) else every_seconds).cast("bigint")
    gone = (F.unix_micros(now) - F.unix_micros(start)) / (every * 1_000_000)
    steps = F.when(start > now, 0).otherwise(F.floor(gone) + 1)
    return F.timestamp_micros(F.unix_micros(start) + steps.cast("bigint") * every * 1_000_000)


def next_detail_checkpoint(published_at: Column, after: Column, daily: int = 7) -> Column:
    """Daily for the first days, then weekly for ever; a week on if nothing was published."""
    day, week = 86_400, 7 * 86_400
    weekly = next_after(published_at + F.make_interval(days=F.lit(daily)), week, after)
    in_daily = next_after(published_at, day, after)
    last_daily = published_at + F.make_interval(days=F.lit(daily - 1))
    return F.when(published_at.isNull(), after + F.make_interval(weeks=F.lit(1))).when(in_daily <= last_daily, in_daily).otherwise(weekly)


def due(last_fetch: Column, every_hours: Column | int, now: Column, grace_hours: int = 12) -> Column:
    """Never fetched, or the interval less the grace has passed."""
    hours = F.lit(every_hours) if isinstance(every_hours, int) else every_hours
    return last_fetch.isNull() | (last_fetch <= now - F.make_interval(hours=hours - grace_hours))
