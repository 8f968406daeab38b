"""Times as text and as seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def elapsed_seconds(text: Column) -> Column:
    """[[days-]hours:]minutes:seconds, as ps prints it, in seconds; null if it reads otherwise."""
    pattern = r"^(?:(?:(\d+)-)?(\d+):)?(\d+):(\d+)(?:\.\d+)?$"
    number = lambda k: F.coalesce(F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).cast("long"), F.lit(0))
    return F.when(text.rlike(pattern), ((number(1) * 24 + number(2)) * 60 + number(3)) * 60 + number(4))


def cpu_seconds(text: Column) -> Column:
    """The same with hundredths, rounded half up."""
    return elapsed_seconds(text) + F.when(F.regexp_extract(text, r"\.(\d)", 1) >= "5", 1).otherwise(0)


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6
