"""Partition transforms: period starts, ordinals, generated columns and their strings (all in UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIME = ("YEAR", "MONTH", "DAY", "HOUR")
TRANSFORMS = (*TIME, "VALUE", "BUCKET")
#: The patterns that partition strings are written with.
PATTERNS = {"YEAR": "yyyy", "MONTH": "yyyy-MM", "DAY": "yyyy-MM-dd", "HOUR": "yyyy-MM-dd-HH"}
#: The prefix of generated partition columns.
GENERATED = "lw_partition_col"


def period_start(time: Column, transform: str) -> Column:
    """Epoch milliseconds at which the period of ``time`` begins."""
    return F.unix_millis(F.date_trunc(transform, time.cast("timestamp")))


def ordinal(time: Column, transform: str) -> Column:
    """Periods since 1970-01-01: what time-partitioned manifests store."""
    time = time.cast("timestamp")
    if transform == "YEAR":
        return F.year(time) - 1970
    if transform == "MONTH":
        return 12 * (F.year(time) - 1970) + F.month(time) - 1
    if transform == "DAY":
        return F.datediff(time, F.lit("1970-01-01").cast("date"))
    if transform == "HOUR":
        return F.floor(F.unix_millis(time) / 3_600_000).cast("int")
    raise ValueError(f"{transform} has no ordinal")


def millis_to_ordinal(millis: Column, transform: str) -> Column:
    return ordinal(F.timestamp_millis(millis), transform)


def ordinal_to_millis(number: Column, transform: str) -> Column:
    """The start of a period by its ordinal; null stays null."""
    epoch = F.lit("1970-01-01").cast("date")
    if transform in ("YEAR", "MONTH"):
        start = F.add_months(epoch, number * (12 if transform == "YEAR" else 1))
    elif transform == "DAY":
        start = F.date_add(epoch, number)
    elif transform == "HOUR":
        return number.cast("long") * 3_600_000
    else:
        raise ValueError(f"{transform} has no ordinal")
    return F.unix_millis(start.cast("timestamp"))


def bucket(value: Column, buckets: int) -> Column:
    """The bucket that a generated bucket column computes."""
    return F.pmod(F.hash(value).bitwiseAND(F.lit(2147483647)), F.lit(buckets))


def generated_name(transform: str, path: str) -> str:
    return path if transform == "VALUE" else f"{GENERATED}_{transform}_{path.replace('.', '_')}"


def generated_expression(transform: str, path: str, buckets: int | None = None) -> str | None:
    """The generation expression of a partition column; None for plain values."""
    return {
        "VALUE": None,
        "YEAR": f"YEAR({path})",
        "MONTH": f"DATE_FORMAT({path}, 'yyyy-MM')",
        "DAY": f"CAST({path} AS DATE)",
        "HOUR": f"DATE_FORMAT({path}, 'yyyy-MM-dd-HH')",
        "BUCKET": f"MOD((HASH({path}) & 2147483647), {buckets})",
    }[transform]


def generated_type(transform: str) -> str | None:
    return {"VALUE": None, "YEAR": "int", "MONTH": "string", "DAY": "date", "HOUR": "string", "BUCKET": "int"}[transform]


def partition_string(time: Column, transform: str) -> Column:
    """A period as Delta-style logs write it."""
    return F.date_format(time.cast("timestamp"), PATTERNS[transform])


def millis_string(millis: Column, transform: str) -> Column:
    return partition_string(F.timestamp_millis(millis), transform)


def parse_partition_string(text: Column, transform: str) -> Column:
    """Epoch milliseconds of a written period."""
    return F.unix_millis(F.try_to_timestamp(text, F.lit(PATTERNS[transform])))


def composite(parts: list[Column]) -> Column:
    """Year, month, ... columns folded into one string; null if any of them is."""
    padded = [parts[0].cast("string"), *(F.lpad(p.cast("string"), 2, "0") for p in parts[1:])]
    missing = parts[0].isNull()
    for p in parts[1:]:
        missing = missing | p.isNull()
    return F.when(~missing, F.concat_ws("-", *padded))
