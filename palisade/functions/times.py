"""Time columns: lenient parsing, synthetic event time, ISO text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade import constants as C


def parsed_ts(raw: Column, fallback: Column) -> Column:
    """ISO text (every ``Z`` removed) as timestamp, anything else as ``fallback``.

    The pattern guards the cast, which alone would also take ``2026`` or leading blanks.
    """
    text = F.replace(raw, F.lit("Z"), F.lit(""))
    iso = F.when(text.rlike(C.ISO_TIMESTAMP), text.try_cast("timestamp_ntz"))
    return F.coalesce(iso, fallback)


def iso_text(ts: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss``, with six fraction digits only when there is a fraction."""
    text = F.replace(ts.cast("string"), F.lit(" "), F.lit("T"))
    return F.when(text.contains("."), F.rpad(text, 26, "0")).otherwise(text)


def synthetic_ts(seq: Column, base: Column) -> Column:
    """Text of ``base`` plus ``seq`` seconds."""
    moment = base + seq * F.expr("interval '1' second")
    return F.concat(F.substring(iso_text(moment), 1, 19), F.lit("Z"))


def _part(name: str) -> Column:
    """A CSV cell as its number-reading loader would print it."""
    raw = F.col(name)
    number = F.when(raw.rlike(r"^[0-9]+$"), raw.try_cast("bigint").cast("string"))
    return F.coalesce(number, raw, F.lit("nan"))


def log_ts_text(columns: list[str]) -> Column:
    """Time text of a structured log; which parts exist is known when the plan is built."""
    have = set(columns)
    if {"Month", "Date", "Time"} <= have:
        return F.trim(F.concat_ws(" ", _part("Month"), _part("Date"), _part("Time")))
    if {"Date", "Day", "Time"} <= have:
        return F.trim(F.concat_ws(" ", _part("Date"), _part("Day"), _part("Time")))
    if {"Date", "Time"} <= have:
        return F.concat(_part("Date"), F.lit("T"), _part("Time"), F.lit("Z"))
    if "Time" in have:
        return _part("Time")
    return F.lit(C.EPOCH_TEXT)
