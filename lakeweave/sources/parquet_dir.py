"""Folders of Parquet files as a table (a source only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.functions import paths as P
from lakeweave.functions.partition_spec import parse_spec, path_millis, path_values
from lakeweave.functions.schema import from_arrow
from lakeweave.functions.transforms import TIME

from lakeweave.operators import timeline

from .footers import file_stats
from .model import Change, ReadError, Snapshot, Table
from .storage import open_uri


def listing(spark: SparkSession, base: str) -> DataFrame:
    """path, size, mtime of the Parquet files below ``base``; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(base)
    return found.select(P.canonical(F.col("path")).alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"))


class ParquetSource:
    format = "PARQUET"

    def __init__(self, spark: SparkSession, base: str, name: str = "table", partition_spec: str | None = None):
        self.spark, self.base, self.name, self.spec = spark, base.rstrip("/"), name, parse_spec(partition_spec)

    def _table(self, listed: DataFrame) -> Table:
        import pyarrow.parquet as pq

        newest = listed.agg(F.max_by("path", "mtime").alias("path"), F.max("mtime").alias("mtime")).first()
        if newest["path"] is None:
            raise ReadError(f"{self.base} has no Parquet file")
        store, path = open_uri(newest["path"])
        schema = from_arrow(pq.read_schema(store.open_input_file(path)))
        named = {f.name for f in schema.fields}
        from pyspark.sql import types as T

        for f in self.spec:  # plain partition columns live in paths only
            if f.transform == "VALUE" and f.path not in named:
                schema = T.StructType([*schema.fields, T.StructField(f.path, T.StringType())])
        return Table(self.name, self.format, self.base, schema, tuple(self.spec), newest["mtime"], str(newest["mtime"]))

    def _files(self, listed: DataFrame) -> DataFrame:
        folder = P.partition_path(F.col("path"), P.canonical(F.lit(self.base)))
        values = [path_millis(v, f).cast("string") if f.transform in TIME else v for f, v in zip(self.spec, path_values(folder, self.spec))] if self.spec else []
        part = F.create_map(*[x for f, v in zip(self.spec, values) for x in (F.lit(f.path), v)]) if values else F.create_map().cast("map<string,string>")
        n = max(1, min(self.spark.sparkContext.defaultParallelism * 4, 10_000))
        counted = file_stats(listed.select("path").repartition(n))
        return listed.join(counted, "path").select("path", F.lit("PARQUET").alias("format"), "size", "rows", "mtime", part.alias("part"), "stats")

    def current_table(self) -> Table:
        return self._table(listing(self.spark, self.base))

    def snapshot(self) -> Snapshot:
        listed = listing(self.spark, self.base)
        table = self._table(listed)
        return Snapshot(table, self._files(listed), (), table.version)

    def backlog(self, since: int, pending=()) -> tuple[list[str], tuple[int, ...]]:
        """One pseudo-commit with all that is newer than ``since``."""
        return ([str(since)] if self.current_table().instant > since else []), ()

    def change(self, since: str) -> Change:
        listed = listing(self.spark, self.base)
        files = self._files(listed.filter(F.col("mtime") > int(since)))
        return Change(self._table(listed), files, files.limit(0), since)

    def safe_from(self, instant: int) -> bool:
        return timeline.safe_from_earliest(listing(self.spark, self.base), F.lit(instant)).first()["safe"]

    def identifier(self, version: str) -> str:
        return version
