"""Timestamps and durations. Timestamps are naive; durations are whole microseconds (bigint).

Spark takes differences of naive timestamps in the session's time zone, so ``session.configure`` sets UTC:
no hour is skipped or repeated.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_US = 3.6e9
SECOND_US = 1e6
ISO_PATTERN = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def parse_iso(text: Column | str) -> Column:
    """ISO text, with or without a fraction of a second, to a naive timestamp; NULL if malformed."""
    return _column(text).try_cast("timestamp_ntz")


def format_iso(ts: Column | str) -> Column:
    """Naive timestamp to ISO text with all six digits."""
    return F.date_format(_column(ts), ISO_PATTERN)


def micros_between(start: Column | str, end: Column | str) -> Column:
    """``end - start`` in microseconds."""
    return F.timestamp_diff("MICROSECOND", _column(start), _column(end))


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a naive timestamp."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), _column(ts))


def hours(micros: Column | str) -> Column:
    return _column(micros) / F.lit(HOUR_US)


def seconds(micros: Column | str) -> Column:
    return _column(micros) / F.lit(SECOND_US)


def event_time(ts: Column | str) -> Column:
    """Naive timestamp as the zoned type that watermarks accept."""
    return _column(ts).cast("timestamp")


def micros(duration: str) -> int:
    """A duration as ``"6 hours"`` in microseconds."""
    return int(pd.Timedelta(duration).value // 1000)
