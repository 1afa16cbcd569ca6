"""Set operators on data files: diffs, groups, folds, partition events. DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kept(files: DataFrame, key: str = "path") -> DataFrame:
    """A file list to read several times: persisted in as many parts as there are cores, however many its query's shuffles have."""
    return files.repartition(files.sparkSession.sparkContext.defaultParallelism, key).persist()


def unique(files: DataFrame, key: str = "path") -> DataFrame:
    """Raises (when it runs) if a path occurs twice."""
    counted = files.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("path occurs twice: "), F.col(key)))).otherwise(F.col(key)).alias(key))


def added(latest: DataFrame, previous: DataFrame, key: str = "path") -> DataFrame:
    """Files of ``latest`` that ``previous`` lacks. Only paths count; changed statistics are no change."""
    return latest.join(previous.select(key), key, "left_anti")


def removed(latest: DataFrame, previous: DataFrame, key: str = "path") -> DataFrame:
    return added(previous, latest, key)


def diff(latest: DataFrame, previous: DataFrame, key: str = "path") -> DataFrame:
    """Both in one shuffle: path and op (add, remove)."""
    a, b = latest.select(F.col(key).alias("_new")), previous.select(F.col(key).alias("_old"))
    both = a.join(b, F.col("_new") == F.col("_old"), "full_outer").filter("_new IS NULL OR _old IS NULL")
    return both.select(F.coalesce("_new", "_old").alias(key), F.when(F.col("_old").isNull(), "add").otherwise("remove").alias("op"))


def group_diff(latest: DataFrame, previous: DataFrame, files: str = "files", key: str = "path") -> DataFrame:
    """The diff of two tables of partition groups, each with an array of files (structs with ``key``)."""
    each = lambda g: g.select(F.explode(files).alias("_f")).select(F.col("_f")[key].alias(key))
    return diff(each(latest), each(previous), key)


def groups(files: DataFrame, by: list[str | Column], *aggregates: Column) -> DataFrame:
    """Files grouped by their whole partition value."""
    return files.groupBy(*by).agg(*aggregates)


def data_files(files: DataFrame) -> DataFrame:
    return files.filter("kind = 'data'")


def replaced_by_partition(live: DataFrame, latest: DataFrame) -> DataFrame:
    """Live files to replace: those that vanished, and all of partitions that the snapshot lacks."""
    gone = live.join(latest.select("partition").distinct(), "partition", "left_anti")
    vanished = live.join(latest.select("partition").distinct(), "partition", "left_semi").join(latest.select("partition", "path"), ["partition", "path"], "left_anti")
    return gone.unionByName(vanished)


def partition_events(storage: DataFrame, catalog: DataFrame) -> DataFrame:
    """ADD, UPDATE or DROP of each partition (key, path on both sides); equal ones are left out."""
    s, c = storage.select("key", F.col("path").alias("storage_path")), catalog.select("key", F.col("path").alias("catalog_path"))
    both = s.join(c, "key", "full_outer")
    event = F.when(F.col("catalog_path").isNull(), "ADD").when(F.col("storage_path").isNull(), "DROP").when(F.col("storage_path") != F.col("catalog_path"), "UPDATE")
    return both.withColumn("event", event).filter("event IS NOT NULL")


def incremental_partition_events(written: DataFrame, dropped: DataFrame, catalog: DataFrame) -> DataFrame:
    """Events of the partitions that commits wrote or dropped; dropping wins, and nothing written means no event."""
    touched = written.join(dropped.select("key"), "key", "left_anti")
    events = partition_events(touched, catalog.join(touched.select("key"), "key", "left_semi"))
    any_written = written.limit(1).select(F.lit(1).alias("_any")).withColumn("_j", F.lit(1))
    gone = dropped.join(catalog, "key", "left_semi").select("key").withColumn("_j", F.lit(1)).join(F.broadcast(any_written), "_j", "left_semi")
    return events.unionByName(gone.select("key", F.lit(None).cast("string").alias("storage_path"), F.lit(None).cast("string").alias("catalog_path"), F.lit("DROP").alias("event")))
