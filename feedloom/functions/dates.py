"""Dates, windows and ages as column expressions. `now` is always an argument; instants are timestamps without zone, in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRICT = r"^\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2}(?:\.\d{1,3})?Z)?$"


def seconds_between(later: Column, earlier: Column) -> Column:
    """Seconds, with fractions, between two timestamps of one kind."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1_000_000


def strict_date(text: Column) -> Column:
    """YYYY-MM-DD, or that with a UTC time; null for any other notation and for impossible dates."""
    t = F.trim(text)
    return F.when(t.rlike(STRICT), F.regexp_replace(F.regexp_replace(t, "T", " "), "Z$", "").try_cast("timestamp_ntz"))


#: Hours of the zones that feeds name.
ZONES = {"GMT": 0, "UTC": 0, "UT": 0, "Z": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Patterns of feed dates, rewritten to day|month|year|time|zone.
_FEED = (
    (r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})\s+(\d{2}:\d{2}(?::\d{2})?)\s*([A-Z]{1,3}|[+-]\d{2}:?\d{2})?$", "$1|$2|$3|$4|$5"),
    (r"^[A-Za-z]{3}\s+([A-Za-z]{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+([+-]\d{4})\s+(\d{4})$", "$2|$1|$5|$3|$4"),
    (r"^(\d{4})-(\d{2})-(\d{2})[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)\s*(Z|[+-]\d{2}:?\d{2})$", "$3|$2|$1|$4|$5"),
)


def feed_date(text: Column) -> Column:
    """The instant of an RFC-822, ISO or platform notation, in UTC; null if it is none, or no real date."""
    t = F.trim(text)
    parts = F.lit(None).cast("string")
    for pattern, order in reversed(_FEED):
        parts = F.when(t.rlike(pattern), F.regexp_replace(t, pattern, order)).otherwise(parts)
    zones = F.create_map(*[x for k, v in ZONES.items() for x in (F.lit(k), F.lit(v * 60))])

    def instant(p: Column) -> Column:
        day, month, year, time, zone = (F.get(p, i) for i in range(5))
        named = F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(month)).cast("int")
        m = F.when(named > 0, named.cast("string")).otherwise(month)
        local = F.concat_ws("-", year, F.lpad(m, 2, "0"), F.lpad(day, 2, "0"))
        digits = F.regexp_replace(zone, r"[^0-9]", "")
        minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")
        offset = F.when(zone.rlike(r"^[+-]"), F.when(zone.startswith("-"), -minutes).otherwise(minutes)).otherwise(F.coalesce(F.try_element_at(zones, zone), F.lit(0)))
        return F.concat(local, F.lit(" "), time).try_cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), offset)

    return F.coalesce(strict_date(text), F.get(F.transform(F.array(F.split(parts, r"\|")), lambda p: instant(p)), 0))


def relative_instant(phrase: Column, now: Column) -> Column:
    """"3 weeks ago" as an instant; a month has 30 days, a year 365."""
    p = F.lower(F.trim(phrase))
    n = F.regexp_extract(p, r"^(?:streamed |premiered )?(\d+)\s+(second|minute|hour|day|week|month|year)s? ago$", 1).try_cast("bigint")
    unit = F.regexp_extract(p, r"(second|minute|hour|day|week|month|year)s? ago$", 1)
    size = F.create_map(*[F.lit(x) for kv in {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000, "year": 31536000}.items() for x in kv])
    return now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (n * F.try_element_at(size, unit)).cast("decimal(18,6)"))


def rolling_cutoff(now: Column, years: int = 2) -> Column:
    """The same calendar day some years back, the end of a shorter month instead of a missing day."""
    return F.add_months(now.cast("date"), -12 * years)


def in_rolling_window(text: Column, now: Column, years: int = 2) -> Column:
    d = strict_date(text)
    return F.coalesce((d >= rolling_cutoff(now, years).cast("timestamp_ntz")) & (d <= now), F.lit(False))


def in_year_window(year: Column, now: Column, years: int = 2) -> Column:
    return F.coalesce(year.between(F.year(rolling_cutoff(now, years)), F.year(now) + 1), F.lit(False))


def age_days(then: Column, now: Column) -> Column:
    """Days, with fractions, and never below zero."""
    return F.greatest(F.lit(0.0), seconds_between(now, then) / 86400)


def scoring_date(published: Column, year: Column) -> Column:
    """The exact instant, else the middle of the year, else null."""
    return F.coalesce(published, F.make_timestamp_ntz(year, F.lit(6), F.lit(30), F.lit(0), F.lit(0), F.lit(0)))


def cohort(then: Column, now: Column, hours: tuple[int, ...] = (6, 24, 72, 168)) -> Column:
    """0 for the freshest; unknown and older instants share the last number."""
    age = F.greatest(F.lit(0.0), seconds_between(now, then) / 3600)
    c = F.lit(len(hours))
    for i, h in reversed(list(enumerate(hours))):
        c = F.when(age < h, i).otherwise(c)
    return c


def without_future(then: Column, now: Column, hours: int = 2) -> Column:
    """Unknown if it is further ahead than clocks differ."""
    return F.when(seconds_between(then, now) <= hours * 3600, then)
