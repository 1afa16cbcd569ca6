"""Commit instants: timeline strings and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_instant(text: Column) -> Column:
    """A timeline instant (yyyyMMddHHmmss[SSS...]) as a timestamp; seconds alone mean their last millisecond."""
    cut = F.substr(text, F.lit(1), F.lit(17))
    full = F.when(F.length(cut) == 14, F.concat(cut, F.lit("999"))).otherwise(F.rpad(cut, 17, "0"))
    spaced = F.regexp_replace(full, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)(\d{3})$", "$1-$2-$3 $4:$5:$6.$7")
    return F.when(spaced != full, spaced.try_cast("timestamp"))


def format_instant(time: Column) -> Column:
    return F.date_format(time, "yyyyMMddHHmmssSSS")


def millis(time: Column) -> Column:
    return F.unix_millis(time.cast("timestamp"))
