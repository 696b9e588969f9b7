"""Dates, clocks and time zones.  Nothing reads the wall clock: callers pass `as_of`."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, fold

FORMATS = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy")
MONTHS = {
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "setiembre": 9,
    "octubre": 10, "noviembre": 11, "diciembre": 12, "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7,
    "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
}


def parsed(c: Column | str, formats: Sequence[str] = FORMATS, months: Mapping[str, int] = MONTHS) -> Column:
    """A timestamp from a text in any of several formats, or from a date in words in it; null if there is none."""
    plain = F.regexp_replace(F.trim(col(c)), "^[A-Za-z]{3}, ", "")  # the parser takes no names of weekdays
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in formats], worded(c, months))


def worded(c: Column | str, months: Mapping[str, int] = MONTHS) -> Column:
    """Midnight of the first date like "2 de diciembre de 2024" or "2 december 2024" in a text."""
    pattern = rf"\b(\d{{1,2}}) (?:de )?({'|'.join(months)}) (?:del? )?(\d{{4}})\b"
    part = lambda k: F.regexp_extract(fold(c), pattern, k)
    number = F.create_map(*[F.lit(x) for kv in months.items() for x in kv])
    day = F.concat_ws("-", part(3), F.lpad(number[part(2)].cast("string"), 2, "0"), F.lpad(part(1), 2, "0"))
    return F.when(part(2) != "", F.try_to_timestamp(day, F.lit("yyyy-MM-dd")))


def page_date(html: Column | str) -> Column:
    """The date of a page: its <time>, else its meta tag, else its JSON-LD, else the first date in words."""
    places = (r'<time[^>]*datetime="([^"]+)"', r'<meta[^>]*published_time"[^>]*content="([^"]+)"', r'"datePublished"\s*:\s*"([^"]+)"')
    found = [F.regexp_extract(col(html), f"(?is){p}", 1) for p in places]
    return F.coalesce(*[parsed(F.substring(f, 1, 40)) for f in found], worded(html))


def clock_minutes(c: Column | str) -> Column:
    """Minutes since midnight of `9:00AM` or `14:30`; -1 for anything else."""
    text = F.upper(F.regexp_replace(col(c), r"\s|\.", ""))
    hour = F.try_to_number(F.regexp_extract(text, r"^(\d{1,2}):(\d{2})(AM|PM)?$", 1), F.lit("99")).cast("int")
    minute = F.try_to_number(F.regexp_extract(text, r"^(\d{1,2}):(\d{2})(AM|PM)?$", 2), F.lit("99")).cast("int")
    half = F.regexp_extract(text, r"(AM|PM)$", 1)
    hours = F.when(half == "AM", hour % 12).when(half == "PM", hour % 12 + 12).otherwise(hour)
    ok = (minute < 60) & (hours < 24) & ((half == "") | hour.between(1, 12))
    return F.coalesce(F.when(ok, hours * 60 + minute), F.lit(-1))


def hms(seconds: Column | str) -> Column:
    """Seconds as h:mm:ss."""
    s = col(seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def seconds(c: Column | str) -> Column:
    """h:mm:ss or mm:ss as seconds."""
    return F.aggregate(F.split(col(c), ":"), F.lit(0).cast("long"), lambda a, p: a * 60 + p.cast("long"))


def local(ts: Column | str, zone: str = "America/Lima") -> Column:
    """Wall-clock time of a UTC instant in a zone."""
    return F.from_utc_timestamp(col(ts), zone)


def month(ts: Column | str) -> Column:
    return F.date_format(F.date_trunc("month", col(ts)), "yyyy-MM")


def within_days(ts: Column | str, as_of: Column, days: int) -> Column:
    """From `days` days before `as_of` up to it."""
    return (col(ts) >= as_of - F.make_interval(days=F.lit(days))) & (col(ts) <= as_of)


def fresh(ts: Column | str, as_of: Column, days: int) -> Column:
    """Within so many days, or of unknown time."""
    return F.coalesce(col(ts) >= as_of - F.make_interval(days=F.lit(days)), F.lit(True))
