"""Commits on our Delta tables: append, upsert, delete, update, drop a partition, change columns, optimize, vacuum. Copy-on-write.

A change that rewrites files is committed only on the version that it was made from;
if another writer was faster it is made anew from the version that is there then, a few
times, before the Conflict is raised. Appends hold on any version.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.functions.partition_spec import PartitionField
from lakeweave.operators import files as ops
from lakeweave.reader import file_path, read_files, skip
from lakeweave.sources.delta import DeltaSource, DeltaTarget
from lakeweave.sources.model import FILES, Conflict, SchemaError, SyncState, Table
from lakeweave.sources.parquet_dir import ParquetSource, listing
from lakeweave.sources.storage import open_uri


class LakeTable:
    """A Delta table that this engine writes rows to."""

    def __init__(self, spark: SparkSession, base: str, name: str = "table", partition_by: tuple[str, ...] = (), retries: int = 3):
        self.spark, self.base, self.name, self.by, self.retries = spark, base.rstrip("/"), name, tuple(partition_by), retries
        self.target, self.source = DeltaTarget(spark, base, name), DeltaSource(spark, base, name)
        self.source.log = self.target.log  # both know a version's metadata once one has read it

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], FILES)

    def _write(self, rows: DataFrame) -> DataFrame:
        """Writes rows as new files below the table; the files."""
        folder = f"{self.base}/data/{uuid.uuid4().hex}"
        writer = rows.write
        (writer.partitionBy(*self.by) if self.by else writer).parquet(folder)
        if not listing(self.spark, folder).limit(1).count():
            return self._none()
        return ParquetSource(self.spark, folder, partition_spec=",".join(f"{c}:VALUE" for c in self.by)).snapshot().files.filter("rows > 0")

    def _table(self, schema: T.StructType) -> Table:
        return Table(self.name, "DELTA", self.base, schema, tuple(PartitionField(c) for c in self.by))

    def _commit(self, schema: T.StructType, added: DataFrame, removed: DataFrame, what: str, read_version: int | None = None) -> int:
        return self.target.commit(self._table(schema), SyncState(0, (), "DELTA", what), added, removed, what, read_version)

    def _latest(self) -> int:
        return self.target.log.versions()[-1]

    def _again(self, change) -> int:
        """``change(version)`` on the latest version, anew while other writers are faster."""
        for attempt in range(self.retries + 1):
            try:
                return change(self._latest())
            except Conflict:
                if attempt == self.retries:
                    raise

    def schema(self) -> T.StructType:
        return self.source.table_at().schema

    def read(self, version=None) -> DataFrame:
        s = self.source.snapshot(version)
        return read_files(self.spark, s.table, s.files)

    def append(self, rows: DataFrame) -> int:
        exists = self.target.exists()
        written = self._write(rows)
        if not exists:
            try:
                return self._commit(rows.schema, written, self._none(), "APPEND", -1)
            except Conflict:
                pass  # another writer made the table meanwhile
        return self._again(lambda v: self._commit(self.source.table_at(v).schema, written, self._none(), "APPEND", v))

    def _rewrite(self, version: int, touched: DataFrame, keep, what: str, more: DataFrame | None = None) -> int:
        """Replaces the touched files by what ``keep`` leaves of their rows, and ``more``."""
        table = self.source.table_at(version)
        touched = ops.kept(touched)
        rest = keep(read_files(self.spark, table, touched))
        rest = rest if more is None else rest.unionByName(more.select(*table.schema.names))
        try:
            return self._commit(table.schema, self._write(rest), touched.select("path"), what, version)
        finally:
            touched.unpersist()

    def _hit(self, version: int, condition, files: DataFrame | None = None) -> DataFrame:
        """Files with a row that ``condition`` picks: one scan, a row a file.

        Rows carry a hash of their file's path, and paths are looked up by it: two files
        of one hash would both be written anew, with the same rows.
        """
        table = self.source.table_at(version)
        files = self.source.snapshot(version).files if files is None else files
        rows = read_files(self.spark, table, files, with_path=True)
        hit = condition(rows.withColumn("_lw_from", F.xxhash64("_lw_from"))).select(F.col("_lw_from").alias("_lw_hash")).distinct()
        named = rows.select("_lw_from").distinct().join(hit, F.xxhash64("_lw_from") == F.col("_lw_hash"), "left_semi")
        return files.join(named.select(file_path(F.col("_lw_from")).alias("path")), "path", "left_semi")

    def delete(self, condition: Column) -> int:
        return self._again(lambda v: self._rewrite(v, self._hit(v, lambda rows: rows.filter(condition)), lambda rows: rows.filter(~F.coalesce(condition, F.lit(False))), "DELETE"))

    def update(self, condition: Column, **values: Column) -> int:
        """Sets columns of the rows that ``condition`` picks."""
        hit = F.coalesce(condition, F.lit(False))
        change = lambda rows: rows.select(*[F.when(hit, values[c]).otherwise(F.col(c)).cast(rows.schema[c].dataType).alias(c) if c in values else F.col(c) for c in rows.columns])
        return self._again(lambda v: self._rewrite(v, self._hit(v, lambda rows: rows.filter(condition)), change, "UPDATE"))

    def upsert(self, rows: DataFrame, keys: list[str]) -> int:
        """Replaces rows with equal keys and adds the others; only files whose key bounds can hold a key are read."""
        known = rows.select(*keys).distinct()
        spans = known.agg(*[f(k).alias(f"{n}{j}") for j, k in enumerate(keys) for n, f in (("lo", F.min), ("hi", F.max))]).first()

        def change(v: int) -> int:
            near = skip(self.source.snapshot(v).files, {k: (spans[f"lo{j}"], spans[f"hi{j}"]) for j, k in enumerate(keys) if "." not in k and k not in self.by}, self.source.table_at(v).schema)
            return self._rewrite(v, self._hit(v, lambda old: old.join(known, keys, "left_semi"), near), lambda old: old.join(known, keys, "left_anti"), "MERGE", rows)

        return self._again(change)

    def drop_partition(self, **values: str) -> int:
        def change(v: int) -> int:
            files = self.source.snapshot(v).files
            for c, x in values.items():
                files = files.filter(F.col("part")[c] == x)
            return self._commit(self.source.table_at(v).schema, self._none(), files.select("path"), "DROP PARTITION", v)

        return self._again(change)

    def _reshape(self, fields, what: str) -> int:
        return self._again(lambda v: self._commit(T.StructType(fields(self.source.table_at(v).schema.fields)), self._none(), self._none().select("path"), what, v))

    def add_columns(self, *fields: T.StructField) -> int:
        return self._reshape(lambda old: [*old, *fields], "ADD COLUMNS")

    def drop_columns(self, *names: str) -> int:
        """Columns that readers see no more; files keep them, so their names can't be used anew."""
        if set(names) & set(self.by):
            raise SchemaError("partition columns can't be dropped")
        return self._reshape(lambda old: [f for f in old if f.name not in names], "DROP COLUMNS")

    def rename_column(self, old: str, new: str) -> int:
        """A new name for a column; rows are written anew, since files know columns by name here."""
        if old in self.by:
            raise SchemaError("partition columns can't be renamed")

        def change(v: int) -> int:
            table = self.source.table_at(v)
            files = self.source.snapshot(v).files
            rows = read_files(self.spark, table, files).withColumnRenamed(old, new)
            return self._commit(rows.schema, self._write(rows), files.select("path"), "RENAME COLUMN", v)

        return self._again(change)

    def optimize(self, order_by: list[str] | None = None, files: int = 1) -> int:
        """Fewer, sorted files with the same rows."""
        def pack(rows: DataFrame) -> DataFrame:
            return rows.repartitionByRange(files, *order_by).sortWithinPartitions(*order_by) if order_by else rows.coalesce(files)

        return self._again(lambda v: self._rewrite(v, self.source.snapshot(v).files, pack, "OPTIMIZE"))

    def z_order(self, columns: list[str], files: int = 1, bits: int = 6) -> int:
        """The rows in order of the interleaved bits of their columns' ranks, so that files are narrow in each column."""
        def pack(rows: DataFrame) -> DataFrame:
            # ranks by quantiles, 2 ** bits of them; texts by their hash
            numeric = [c for c in columns if not isinstance(rows.schema[c].dataType, T.StringType)]
            shares = [k / (1 << bits) for k in range(1, 1 << bits)]
            cuts = rows.select(*[F.percentile_approx(F.col(c).cast("double"), shares).alias(c) for c in numeric]).first() if numeric else {}

            def rank(c: str) -> Column:
                if c not in numeric:
                    return F.pmod(F.hash(c), F.lit(1 << bits))
                steps = F.array(*[F.lit(q) for q in sorted(set(cuts[c] or []))]).cast("array<double>")
                return F.size(F.filter(steps, lambda q: q <= F.col(c).cast("double")))

            ranks = [rank(c) for c in columns]
            z = F.lit(0).cast("long")
            for b in range(bits):
                for j, r in enumerate(ranks):
                    z = z.bitwiseOR(F.shiftleft(F.shiftright(r.cast("long"), b).bitwiseAND(F.lit(1).cast("long")), b * len(columns) + j))
            return rows.withColumn("_lw_z", z).repartitionByRange(files, "_lw_z").sortWithinPartitions("_lw_z").drop("_lw_z")

        return self._again(lambda v: self._rewrite(v, self.source.snapshot(v).files, pack, "ZORDER"))

    def vacuum(self, retain_hours: float = 168, dry_run: bool = False) -> int:
        """Deletes data files that no version since ``retain_hours`` ago has; how many."""
        edge = int(time.time() * 1000 - retain_hours * 3_600_000)
        log = self.target.log
        first = log.commits().filter(F.col("ts") <= edge).agg(F.max("version")).first()[0]
        kept = self.source.snapshot(first).files.select("path") if first is not None else self._none().select("path")
        start = -1 if first is None else first
        later = log.changes(log.actions()).filter((F.col("version") > start) & (F.col("op") == "add")).select("path")
        gone = listing(self.spark, f"{self.base}/data").filter(F.col("mtime") <= edge).join(kept.unionByName(later), "path", "left_anti")
        if dry_run:
            return gone.count()

        def drop(batches):
            import pyarrow as pa

            for batch in batches:
                paths = batch.column(0).to_pylist()
                for path in paths:
                    store, name = open_uri(path)
                    store.delete_file(name)
                yield pa.RecordBatch.from_pydict({"path": paths})

        return gone.select("path").mapInArrow(drop, "path string").count()
