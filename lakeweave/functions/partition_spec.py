"""Partition specs and the values in paths."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import HIVE_NULL, escaped, hive_value
from .transforms import PATTERNS, TIME, TRANSFORMS


@dataclass(frozen=True)
class PartitionField:
    """A table is partitioned by ``transform`` of the field at dotted ``path``."""

    path: str
    transform: str = "VALUE"
    format: str | None = None
    buckets: int | None = None
    names: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if self.transform not in TRANSFORMS:
            raise ValueError(f"partition transform {self.transform} is not known")


def parse_spec(spec: str | None) -> list[PartitionField]:
    """``path:TYPE[:format]``, comma-separated; empty for an unpartitioned table."""
    fields = []
    for part in filter(None, map(str.strip, (spec or "").split(","))):
        path, kind, *pattern = part.split(":", 2)
        fields.append(PartitionField(path, kind.upper(), pattern[0] if pattern else None))
    return fields


def typed(text: Column, kind: str) -> Column:
    """A path value in its field's type; what can't be read is null."""
    kind = kind.lower()
    return text if kind in ("string", "enum") else F.try_to_timestamp(text) if kind.startswith("timestamp") else text.try_cast("int" if kind == "int" else kind)


def path_values(path: Column, fields: list[PartitionField]) -> list[Column]:
    """A string column for each field, from a partition path.

    A single plain field takes the whole path (slashes too); a time field takes as
    many characters as its format has, so a format may span folders.
    """
    if len(fields) == 1 and fields[0].transform not in TIME:
        return [hive_value(path)]
    out, rest = [], path
    for f in fields:
        rest = F.regexp_replace(rest, "^/", "")
        bare = F.regexp_replace(rest, "^[^=/]+=", "")
        if f.transform in TIME:
            width = len((f.format or PATTERNS[f.transform]).replace("'", ""))
            default = F.startswith(bare, F.lit(HIVE_NULL))
            out.append(F.when(~default, F.substr(bare, F.lit(1), F.lit(width))))
            rest = F.substr(bare, F.when(default, len(HIVE_NULL)).otherwise(width) + 1)
        else:
            folder = F.regexp_extract(bare, "^[^/]*", 0)
            out.append(hive_value(folder))
            rest = F.substr(bare, F.length(folder) + 1)
    return out


def path_millis(text: Column, f: PartitionField) -> Column:
    """Epoch milliseconds of a time field's path value."""
    return F.unix_millis(F.try_to_timestamp(text, F.lit(f.format or PATTERNS[f.transform])))


def multi_folder_time(path: Column, names: list[str], transform: str) -> Column:
    """Epoch milliseconds of ``year=YYYY/month=MM/...`` folders, put together with ``-``."""
    parts = [F.regexp_extract(path, f"(?:^|/){re.escape(n)}=([^/]*)", 1) for n in names]
    first, *rest = parts
    text = F.concat_ws("-", first, *(F.lpad(p, 2, "0") for p in rest))
    return F.unix_millis(F.try_to_timestamp(text, F.lit(PATTERNS[transform])))


def hive_path(values: dict[str, Column]) -> Column:
    """``name=value/...`` with the default partition for null."""
    return F.concat_ws("/", *(F.concat(F.lit(f"{n}="), F.coalesce(escaped(v.cast("string")), F.lit(HIVE_NULL))) for n, v in values.items()))


_TOKEN = re.compile(r"\s*(?:(?P<name>[A-Za-z_][\w.]*|`[^`]*`)|(?P<text>'[^']*')|(?P<mark>[(),&])|(?P<number>\d+))")


def tokens(expression: str) -> list[str]:
    out, at = [], 0
    while at < len(expression.rstrip()):
        m = _TOKEN.match(expression, at)
        if not m:
            raise ValueError(f"{expression!r} can't be read at {at}")
        out.append(m.group().strip())
        at = m.end()
    return out


def parse_generated(expression: str) -> tuple[str, str, int | None]:
    """(transform, source path, buckets) of a generation expression, read by tokens and in any case."""
    t = tokens(expression)
    head = t[0].upper()
    if head in TIME and t[1:2] == ["("] and t[-1] == ")" and len(t) == 4:
        return head, t[2].strip("`"), None
    if head == "CAST" and len(t) == 6 and t[3].upper() == "AS" and t[4].upper() == "DATE":
        return "DAY", t[2].strip("`"), None
    if head == "DATE_FORMAT" and len(t) == 6 and t[3] == ",":
        for kind in ("HOUR", "DAY", "MONTH"):
            if t[4].strip("'") == PATTERNS[kind]:
                return kind, t[2].strip("`"), None
    if head == "MOD" and [x.upper() for x in t[1:4]] == ["(", "(", "HASH"] and t[-1] == ")":
        return "BUCKET", t[5].strip("`"), int(t[-2])
    raise ValueError(f"generation expression {expression!r} is not supported")


def fold_generated(columns: list[tuple[str, str | None]]) -> list[PartitionField]:
    """Partition fields of (column, generation expression) pairs.

    Consecutive YEAR, MONTH, DAY, HOUR columns of one source fold into the finest.
    """
    out: list[PartitionField] = []
    run: list[tuple[str, str, str]] = []

    def close():
        if run:
            kinds = tuple(k for _, k, _ in run)
            if kinds != TIME[: len(kinds)] and len(kinds) > 1 or len({p for *_, p in run}) > 1:
                raise ValueError(f"partition columns {[n for n, *_ in run]} don't fold")
            out.append(PartitionField(run[0][2], kinds[-1], names=tuple(n for n, *_ in run)))
            run.clear()

    for name, expression in columns:
        kind, path, buckets = ("VALUE", name, None) if expression is None else parse_generated(expression)
        if kind in TIME and expression and tokens(expression)[0].upper() in TIME:
            if run and (run[-1][2] != path or kind == "YEAR"):
                close()
            run.append((name, kind, path))
            continue
        close()
        out.append(PartitionField(path, kind, buckets=buckets, names=(name,)))
    close()
    return out
