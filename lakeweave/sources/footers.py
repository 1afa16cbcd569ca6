"""Parquet footers as a table, and their fold into one row of statistics per column or file."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, date, datetime
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import open_uri

CHUNKS = "path string, row_group int, column string, num_values long, nulls long, bytes long, rows long, low string, high string"


def plain(value):
    """A footer value as statistics JSON writes it."""
    if isinstance(value, datetime):
        utc = value.astimezone(UTC) if value.tzinfo else value
        return utc.strftime("%Y-%m-%dT%H:%M:%S.") + f"{utc.microsecond:06d}"
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, Decimal):
        return str(value)
    if isinstance(value, float):
        return value if value == value and abs(value) != float("inf") else None
    return None if isinstance(value, bytes) else value


def column_name(path: str) -> str:
    """Footer paths of list and map children, as the schema names them."""
    for raw, name in ((".list.element", "._element"), (".list.item", "._element"), (".bag.array_element", "._element"), (".array", "._element"), (".key_value.key", "._key"), (".key_value.value", "._value")):
        path = path.replace(raw, name)
    return path


def chunks(paths: DataFrame) -> DataFrame:
    """A row for each column chunk of the files in ``paths`` (column path); only footers are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = open_uri(path)
                meta = pq.read_metadata(store.open_input_file(name))
                rows = []
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for c in range(group.num_columns):
                        chunk = group.column(c)
                        stats = chunk.statistics
                        low, high = (plain(stats.min), plain(stats.max)) if stats is not None and stats.has_min_max else (None, None)
                        nulls = stats.null_count if stats is not None and stats.has_null_count else None
                        rows.append((path, g, column_name(chunk.path_in_schema), chunk.num_values, nulls, chunk.total_compressed_size, group.num_rows, None if low is None else json.dumps(low), None if high is None else json.dumps(high)))
                if rows:
                    types = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["path", "row_group", "column", "num_values", "nulls", "bytes", "rows", "low", "high"])

    return paths.select("path").mapInArrow(run, CHUNKS)


def merge_row_groups(chunk_rows: DataFrame, kind: str = "double") -> DataFrame:
    """Row groups folded per file and column: sums, and least and greatest; none where a chunk with values has no bounds.

    ``kind`` is the type in which bounds compare (``double``, ``string``, ...).
    """
    low, high = (F.from_json(F.concat(F.lit('{"v":'), F.col(c), F.lit("}")), f"v {kind}")["v"] for c in ("low", "high"))
    unknown = F.max((F.col("low").isNull() & (F.coalesce("nulls", F.lit(-1)) < F.col("rows"))).cast("int")) == 1
    sums = [F.sum("num_values").alias("num_values"), F.sum("nulls").alias("nulls"), F.sum("bytes").alias("bytes")]
    return chunk_rows.groupBy("path", "column").agg(*sums, F.when(~unknown, F.min(low)).alias("low"), F.when(~unknown, F.max(high)).alias("high"))


def record_count(chunk_rows: DataFrame) -> DataFrame:
    """Rows of each file: the most values in a top-level column, which is its row count."""
    top = F.when(~F.col("column").contains("."), F.col("num_values"))
    return chunk_rows.groupBy("path", "column").agg(F.sum(top).alias("n")).groupBy("path").agg(F.max("n").alias("rows"))


def file_stats(paths: DataFrame) -> DataFrame:
    """path, rows, stats: the statistics JSON of each file, its row groups merged where the footer is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            names, rows, texts = [], [], []
            for path in batch.column(0).to_pylist():
                store, name = open_uri(path)
                meta = pq.read_metadata(store.open_input_file(name))
                low, high, nulls = {}, {}, {}
                unknown, uncounted = set(), set()  # columns with a row group that doesn't say
                for g in range(meta.num_row_groups):
                    for c in range(meta.num_columns):
                        chunk = meta.row_group(g).column(c)
                        stats, key = chunk.statistics, column_name(chunk.path_in_schema)
                        if stats is None or not stats.has_null_count:
                            uncounted.add(key)
                        else:
                            nulls[key] = nulls.get(key, 0) + stats.null_count
                        if stats is not None and stats.has_min_max and not isinstance(stats.min, bytes) and plain(stats.min) is not None and plain(stats.max) is not None:
                            low[key] = stats.min if key not in low else min(low[key], stats.min)
                            high[key] = stats.max if key not in high else max(high[key], stats.max)
                        elif stats is None or not stats.has_null_count or stats.null_count < meta.row_group(g).num_rows:
                            unknown.add(key)  # it has values, but no bounds for them
                low, high = ({k: v for k, v in side.items() if k not in unknown} for side in (low, high))
                nulls = {k: v for k, v in nulls.items() if k not in uncounted}
                names.append(path)
                rows.append(meta.num_rows)
                texts.append(stats_json(meta.num_rows, low, high, nulls))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(rows, pa.int64()), pa.array(texts, pa.string())], names=["path", "rows", "stats"])

    return paths.select("path").mapInArrow(run, "path string, rows long, stats string")


def nest(flat: dict) -> dict:
    out: dict = {}
    for path, value in flat.items():
        *above, leaf = path.split(".")
        at = out
        for name in above:
            at = at.setdefault(name, {})
        at[leaf] = value
    return out


def unnest(tree: dict, path: str = "") -> dict:
    out = {}
    for name, value in tree.items():
        out |= unnest(value, f"{path}{name}.") if isinstance(value, dict) else {f"{path}{name}": value}
    return out


def stats_json(rows: int, low: dict, high: dict, nulls: dict) -> str:
    """Statistics as JSON; lists and maps have none, and a bound that JSON can't hold is left out."""
    inner = ("_element", "_key", "_value")
    keep = lambda d: nest({k: plain(v) for k, v in d.items() if plain(v) is not None and not any(x in k.split(".") for x in inner)})
    return json.dumps({"numRecords": rows, "minValues": keep(low), "maxValues": keep(high), "nullCount": keep(nulls)}, separators=(",", ":"))
