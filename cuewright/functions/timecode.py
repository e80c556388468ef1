"""Timecodes: milliseconds to HH:MM:SS,mmm and back, strict and lenient checks, ASS times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed formats.
STRICT = r"^\d{2}:\d{2}:\d{2}[,.]\d{3}[ \t]*-->[ \t]*\d{2}:\d{2}:\d{2}[,.]\d{3}$"
LENIENT = r"^\d{1,2}:\d{1,2}:\d{1,2}[,.]\d{1,3}[ \t]*-->[ \t]*\d{1,2}:\d{1,2}:\d{1,2}[,.]\d{1,3}$"
FIELDS = r"^[ \t]*(\d{2}):(\d{2}):(\d{2})[,.](\d{3})[ \t]*-->[ \t]*(\d{2}):(\d{2}):(\d{2})[,.](\d{3})[ \t]*$"


def stamp(ms: Column) -> Column:
    """HH:MM:SS,mmm; negative times are 0; hours may have more than two digits."""
    ms = F.greatest(ms.cast("bigint"), F.lit(0).cast("bigint"))
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def stamp_seconds(seconds: Column) -> Column:
    """As stamp(), of seconds rounded to the nearest millisecond, halves to even."""
    return stamp(F.rint(seconds * 1000))


def span(start_ms: Column, end_ms: Column) -> Column:
    return F.concat(stamp(start_ms), F.lit(" --> "), stamp(end_ms))


def is_timecode(text: Column, lenient: bool = False) -> Column:
    return text.rlike(LENIENT if lenient else STRICT)


def _field(text: Column, k: int) -> Column:
    return F.regexp_extract(text, FIELDS, k).try_cast("bigint")


def start_ms(text: Column) -> Column:
    """Start of a timecode line in ms; null if it is none."""
    return ((_field(text, 1) * 60 + _field(text, 2)) * 60 + _field(text, 3)) * 1000 + _field(text, 4)


def end_ms(text: Column) -> Column:
    return ((_field(text, 5) * 60 + _field(text, 6)) * 60 + _field(text, 7)) * 1000 + _field(text, 8)


def ass_time(ms: Column) -> Column:
    """H:MM:SS.cc: the hour without padding, hundredths cut off."""
    return F.format_string("%d:%02d:%02d.%02d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, F.floor(ms % 1000 / 10))
