"""Column functions over times. The session time zone is UTC; now is always a parameter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed offsets in hours of the zone names that air-quality feeds give.
ZONE_HOURS = {"EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AKST": -9, "AKDT": -8, "HST": -10, "HADT": -9, "HAST": -10}

_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,6})?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
LOCAL = "America/New_York"


def parse_iso(text: Column, naive_zone: str = "UTC") -> Column:
    """An ISO-8601 text as a UTC time; without an offset it is read in naive_zone; null where it is none."""
    good = F.when(text.rlike(_ISO), F.replace(text, F.lit(","), F.lit(".")))
    at = F.try_to_timestamp(F.replace(good, F.lit(" "), F.lit("T")))
    return F.when(text.rlike(r"[T ].*(Z|[+-]\d{2}:?\d{2})$"), at).otherwise(F.to_utc_timestamp(at, naive_zone))


def to_float(c: Column) -> Column:
    """A number, null where it cannot be read or is NaN."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is worked out once however often use names it: a plain column is worked out at each place."""
    return F.transform(F.array(value), use)[0]


def resolve_year(month: Column, day: Column, today: Column) -> Column:
    """The date with this month and day nearest to today among last, this and next year; the earliest on ties; null where no such date exists."""
    years = F.array(*[F.year(today) + add for add in (-1, 0, 1)])
    made = F.transform(years, lambda y: F.try_make_timestamp(y, month, day, F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)")).cast("date"))
    return F.array_min(F.transform(F.array_compact(made), lambda d: F.struct(F.abs(F.datediff(d, today)).alias("off"), d.alias("date"))))["date"]


def _clock(text: Column) -> Column:
    """Minutes of the day of `9:00 AM`, `9 am`, `9 a.m.`; null where none."""
    def minutes(bare: Column) -> Column:
        part = lambda k: F.regexp_extract(bare, r"^(\d{1,2})(?::(\d{2}))?[AP]M$", k)
        return let(F.struct(part(1).try_cast("int").alias("hour"), F.coalesce(F.nullif(part(2), F.lit("")), F.lit("0")).try_cast("int").alias("minute")),
                   lambda t: F.when(t["hour"].between(1, 12) & (t["minute"] < 60), (t["hour"] % 12 + F.when(bare.endswith("PM"), 12).otherwise(0)) * 60 + t["minute"]))

    return let(F.upper(F.regexp_replace(text, r"[.\s]", "")), minutes)


def occurrence(text: Column, now: Column, zone: str = LOCAL) -> Column:
    """struct(start, end) in UTC of `March 22 | 9:00 AM - 5:00 PM` local time, past midnight where the end is not later; null where unreadable or over before now."""
    pattern = r"^\s*([A-Za-z]+)\s+(\d{1,2})\s*\|\s*(\d{1,2}(?::\d{2})?\s*[AaPp]\.?[Mm]\.?)\s*(?:-|–|—|to)\s*(\d{1,2}(?::\d{2})?\s*[AaPp]\.?[Mm]\.?)\s*$"
    part = lambda k: F.regexp_extract(text, pattern, k)
    names = F.array(*map(F.lit, ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]))
    month = F.nullif(F.array_position(names, F.lower(F.left(part(1), F.lit(3)))), F.lit(0)).cast("int")
    at = lambda date, minutes, days: F.to_utc_timestamp((F.unix_seconds(F.date_add(date, days).cast("timestamp")) + minutes * 60).cast("timestamp"), zone)

    def span(p: Column) -> Column:
        return F.struct(at(p["date"], p["begin"], F.lit(0)).alias("start"), at(p["date"], p["finish"], F.when(p["finish"] <= p["begin"], 1).otherwise(0)).alias("end"))

    def dated(p: Column) -> Column:
        return F.struct(resolve_year(p["month"], p["day"], F.from_utc_timestamp(now, zone).cast("date")).alias("date"), p["begin"].alias("begin"), p["finish"].alias("finish"))

    read = F.struct(month.alias("month"), part(2).try_cast("int").alias("day"), _clock(part(3)).alias("begin"), _clock(part(4)).alias("finish"))
    kept = lambda s: F.when(s["start"].isNotNull() & s["end"].isNotNull() & (s["end"] >= now), s)
    return let(read, lambda p: let(dated(p), lambda d: let(span(d), kept)))


def observed_at(date: Column, hour: Column, zone: Column) -> Column:
    """ISO text of a local date and hour with the zone's fixed offset; without offset where the zone is unknown; null where date or hour is unreadable."""
    day = F.try_to_timestamp(F.trim(date), F.lit("yyyy-MM-dd"))
    h = F.split(F.trim(hour.cast("string")), ":")[0].try_cast("int")
    name = F.upper(F.trim(F.coalesce(zone, F.lit(""))))
    offset = F.coalesce(*[F.when(name == k, F.lit(f"-{-v:02d}:00")) for k, v in ZONE_HOURS.items()], F.lit(""))
    return F.when(day.isNotNull() & h.between(0, 23), F.concat(F.date_format(day, "yyyy-MM-dd"), F.format_string("T%02d:00:00", h), offset))
