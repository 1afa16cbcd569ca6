"""Reads a table of any format as a DataFrame, now or as of a version or time."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.functions import paths as P
from lakeweave.functions.transforms import TIME
from lakeweave.sources import registry
from lakeweave.sources.model import ReadError

#: Folders (or files) whose partition values are broadcast to one scan; more make more scans, never a shuffle of rows.
SCAN_KEYS = 100_000
#: Folder trees that are scans of their own.
ROOTS = 32


def _physical(schema: T.StructType) -> T.StructType:
    """The schema with the names that files use."""
    def field(f: T.StructField) -> T.StructField:
        return T.StructField((f.metadata or {}).get("storage_name", f.name), kind(f.dataType), True)

    def kind(t: T.DataType) -> T.DataType:
        if isinstance(t, T.StructType):
            return T.StructType([field(f) for f in t.fields])
        if isinstance(t, T.ArrayType):
            return T.ArrayType(kind(t.elementType))
        return T.MapType(kind(t.keyType), kind(t.valueType)) if isinstance(t, T.MapType) else t

    return T.StructType([field(f) for f in schema.fields])


def prune(files: DataFrame, where: dict[str, Column | str] | None) -> DataFrame:
    """Files whose partition values pass: a predicate on ``value`` for each partition field."""
    for path, test in (where or {}).items():
        cell = F.col("part")[path]
        files = files.withColumn("value", cell).filter(test).drop("value")
    return files


def skip(files: DataFrame, bounds: dict[str, tuple] | None, schema: T.StructType) -> DataFrame:
    """Files whose statistics don't exclude a column's [low, high]; files without statistics stay."""
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    for name, (low, high) in (bounds or {}).items():
        least, most = (F.get_json_object("stats", f"$.{side}.{name}").cast(kinds[name]) for side in ("minValues", "maxValues"))
        if low is not None:
            files = files.filter(most.isNull() | (most >= F.lit(low)))
        if high is not None:
            files = files.filter(least.isNull() | (least <= F.lit(high)))
    return files


def read(spark: SparkSession, fmt: str, base: str, version: str | None = None, as_of: int | None = None, partitions: dict | None = None, bounds: dict | None = None, **options) -> DataFrame:
    """The rows of a table.

    ``version``: a commit of the format; ``as_of``: epoch milliseconds. ``partitions``
    and ``bounds`` prune the file list before the scan is built.
    """
    source = registry.source(fmt, spark, base, **options)
    if as_of is not None:
        version = source.version_at(as_of)
        if version is None:
            raise ReadError(f"{base} has no commit at or before {as_of}")
    if hasattr(source, "check_rows"):
        source.check_rows(version)
    snapshot = source.snapshot(version) if version is not None else source.snapshot()
    table = snapshot.table
    files = skip(prune(snapshot.files, partitions), bounds, table.schema)
    return read_files(spark, table, files)


def plain_path(path: str) -> str:
    """A path that Spark takes as it is: marks of patterns are escaped."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


def file_path(spelled: Column) -> Column:
    """The canonical path of a file as ``_metadata.file_path`` spells it; dear, so better once a file than once a row."""
    return P.canonical(P.percent_decoded(spelled))


def layout(files: DataFrame, base: str, names: list[str], values: list[Column]) -> DataFrame:
    """path, format, root, cells: ``root`` is where ``name=value`` folders begin that say just the partition values, else null."""
    folder = P.partition_path(F.col("path"), P.canonical(F.lit(base)))
    tree = "/".join(f"{re.escape(n)}=[^/]*" for n in names)
    said = F.split(F.regexp_extract(folder, f"^(?:.*/)?({tree})$", 1), "/")
    inside = F.startswith(F.col("path"), F.concat(P.canonical(F.lit(base)), F.lit("/")))
    agree = inside & folder.rlike(f"^(.*/)?{tree}$")
    for k, v in enumerate(values):
        agree &= P.hive_value(F.get(said, F.lit(k))).eqNullSafe(v)
    root = F.when(agree, F.regexp_replace(folder, f"(^|/){tree}$", ""))
    return files.select("path", "format", root.alias("root"), F.array(*[v.cast("string") for v in values]).alias("cells"))


def read_files(spark: SparkSession, table, files: DataFrame, with_path: bool = False) -> DataFrame:
    """The rows of a table's files; with ``with_path`` also ``_lw_from``, the path of a row's file as Spark spells it (see ``file_path``).

    Where folders say the partition values, they are Spark's own partition columns, so that
    ordinary filters prune files. Else they come from a broadcast table of folders, SCAN_KEYS
    to a scan: rows are never shuffled to get them.
    """
    physical = _physical(table.schema)
    plain = [(p.name, f) for f in table.partitions if f.transform not in TIME and f.transform != "BUCKET" for p, x in zip(physical.fields, table.schema.fields) if x.name == f.path]
    rows = layout(files, table.base, [n for n, _ in plain], [F.col("part")[f.path] for _, f in plain]) if plain else files.select("path", "format", F.lit(None).cast("string").alias("root"), F.array().cast("array<string>").alias("cells"))
    listed = [(r["path"], r["format"], r["root"], tuple(r["cells"])) for r in rows.collect()]  # the scan's own file list, in one job
    roots = {(k, root) for _, k, root, _ in listed if root is not None}
    native = roots if len(roots) <= ROOTS else set()
    kinds = {"PARQUET": "parquet", "ORC": "orc"}
    here = file_path(F.col("_metadata.file_path"))
    scans = []

    def scan(fmt: str, paths: list[str], root: str | None = None) -> DataFrame:
        if fmt not in kinds:
            raise ReadError(f"{fmt} files can't be read")
        reader = spark.read.schema(physical).format(kinds[fmt])
        if root is not None:
            reader = reader.option("basePath", plain_path(f"{table.base}/{root}".rstrip("/")))
        found = reader.load([plain_path(p) for p in paths])
        found = found.withColumn("_lw_file", here) if plain and root is None else found
        return found.withColumn("_lw_from", F.col("_metadata.file_path")) if with_path else found

    for fmt, root in sorted(native):
        scans.append(scan(fmt, [p for p, k, at, _ in listed if (k, at) == (fmt, root)], root))
    rest: dict[str, dict[str, list]] = {}
    for path, fmt, root, cells in listed:
        if (fmt, root) not in native:
            folder = path.rsplit("/", 1)[0] if plain else ""
            rest.setdefault(fmt, {}).setdefault(folder, []).append((path, cells))
    for fmt, folders in sorted(rest.items()):
        # (key, cells, paths): folders whose files agree, and single files of the others
        agreed = [(folder, own[0][1], [p for p, _ in own]) for folder, own in folders.items() if len({c for _, c in own}) == 1]
        single = [(p, c, [p]) for own in folders.values() if len({c for _, c in own}) > 1 for p, c in own]
        for keys, lo in [(keys, lo) for keys in (agreed, single) for lo in range(0, len(keys), SCAN_KEYS)]:
            part = keys[lo : lo + SCAN_KEYS]
            found = scan(fmt, [p for _, _, paths in part for p in paths])
            if plain:
                columns = ", ".join(f"_lw_{k} string" for k in range(len(plain)))
                known = spark.createDataFrame([(key, *cells) for key, cells, _ in part], f"_lw_key string, {columns}")
                own = F.col("_lw_file") if keys is single else F.regexp_replace("_lw_file", "/[^/]*$", "")
                found = found.join(F.broadcast(known), F.col("_lw_key") == own, "left")
                for k, (name, f) in enumerate(plain):
                    found = found.withColumn(name, F.coalesce(F.col(name), F.col(f"_lw_{k}").cast(table.schema[f.path].dataType)))
            scans.append(found)
    more = ["_lw_from"] if with_path else []
    if not scans:
        empty = spark.createDataFrame([], table.schema)
        return empty.withColumn("_lw_from", F.lit(None).cast("string")) if with_path else empty
    columns = [F.col(p.name).cast(f.dataType).alias(f.name) for p, f in zip(physical.fields, table.schema.fields)]
    out = scans[0].select(*columns, *more)
    for found in scans[1:]:
        out = out.unionByName(found.select(*columns, *more))
    return out
