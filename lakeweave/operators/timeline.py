"""Operators on commit timelines: backlogs, safety, as-of, log replay. DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replay(actions: DataFrame, key: str = "path", order: tuple[str, ...] = ("version", "position"), as_of: Column | None = None) -> DataFrame:
    """The last action of each path, if it is an add: the live files, in one aggregation."""
    if as_of is not None:
        actions = actions.filter(as_of)
    rest = [c for c in actions.columns if c != key]
    last = actions.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return last.filter("_last.op = 'add'").select(key, *[F.col(f"_last.{c}").alias(c) for c in rest])


def cancel_vectors(changes: DataFrame) -> DataFrame:
    """Drops a path from a commit's adds and removes if it is added with a deletion vector and removed in it."""
    both = changes.groupBy("version", "path").agg(F.max(((F.col("op") == "add") & F.col("has_vector")).cast("int")).alias("_dv"), F.max((F.col("op") == "remove").cast("int")).alias("_rm"))
    return changes.join(both.filter("_dv = 1 AND _rm = 1").select("version", "path"), ["version", "path"], "left_anti")


def after(commits: DataFrame, instant: Column) -> DataFrame:
    return commits.filter(F.col("ts") > instant)


def merge_commits(*lists: DataFrame) -> DataFrame:
    """A sorted list of the commits in any of the lists."""
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more)
    return out.distinct().orderBy("instant")


def backlog(timeline: DataFrame, since: Column, pending: DataFrame | None = None) -> DataFrame:
    """instant and role (process, carry) after a sync at ``since``.

    ``timeline``: instant, state (completed, inflight, requested), action. Completed
    instants after ``since`` are processed; unfinished ones up to the last completed
    are carried. Instants that were pending are looked up (misses and savepoints are
    dropped) and processed if completed by now, else carried again.
    """
    later = timeline.filter(F.col("instant") > since)
    done = later.filter("state = 'completed'").select("instant")
    last = done.agg(F.max("instant").alias("_last"))
    unfinished = later.filter("state <> 'completed'").select("instant").join(F.broadcast(last), F.col("instant") <= F.col("_last")).select("instant")
    process, carry = done, unfinished
    if pending is not None:
        known = timeline.filter("action <> 'savepoint'").join(pending.select("instant").distinct(), "instant")
        process = process.unionByName(known.filter("state = 'completed'").select("instant"))
        carry = carry.unionByName(known.filter("state <> 'completed'").select("instant"))
    return process.distinct().withColumn("role", F.lit("process")).unionByName(carry.distinct().withColumn("role", F.lit("carry")))


def safe_from_versions(commits: DataFrame, instant: Column) -> DataFrame:
    """One row, safe: whether a commit at or before ``instant`` is still there."""
    return commits.agg(F.coalesce(F.min("ts") <= instant, F.lit(False)).alias("safe"))


def safe_from_cleaned(timeline: DataFrame, instant: Column) -> DataFrame:
    """One row, safe: a completed commit at or before ``instant``, and no clean after it went past it.

    ``timeline`` has ``retain``: a clean's earliest commit to retain, if it names one.
    """
    reached = F.max(F.when((F.col("state") == "completed") & (F.col("action") != "clean"), F.col("instant") <= instant))
    hurt = F.max(F.when((F.col("action") == "clean") & (F.col("state") == "completed") & (F.col("instant") > instant), F.col("retain").isNull() | (F.col("retain") > instant)))
    return timeline.agg((F.coalesce(reached, F.lit(False)) & ~F.coalesce(hurt, F.lit(False))).alias("safe"))


def safe_from_earliest(files: DataFrame, instant: Column) -> DataFrame:
    """One row, safe: the earliest file is from ``instant`` or before."""
    return files.agg(F.coalesce(F.min("mtime") <= instant, F.lit(False)).alias("safe"))


def same_instant(targets: DataFrame) -> DataFrame:
    """One row, last: the instant that all targets were synced at; raises if they differ."""
    found = targets.agg(F.countDistinct("last").alias("n"), F.max("last").alias("last"))
    return found.select(F.when(F.col("n") > 1, F.raise_error(F.lit("targets were synced at different instants")).cast("timestamp")).otherwise(F.col("last")).alias("last"))


def most_out_of_sync(targets: DataFrame) -> DataFrame:
    """The target with the earliest instant; ties by format."""
    return targets.orderBy("last", "format").limit(1)


def distinct_pending(targets: DataFrame) -> DataFrame:
    return targets.select(F.explode("pending").alias("instant")).distinct().orderBy("instant")


def earliest(last: Column, pending: Column) -> Column:
    """The instant that an incremental sync must be safe from; null if there is none."""
    return F.least(last, F.array_min(pending))


def applicable(commit_ts: Column, last: Column, pending: Column) -> Column:
    return (commit_ts > last) | F.coalesce(F.array_contains(pending, commit_ts), F.lit(False))


def last_result(results: DataFrame) -> DataFrame:
    """The last result of each format (columns format, seq, ...)."""
    rest = [c for c in results.columns if c != "format"]
    return results.groupBy("format").agg(F.max_by(F.struct(*rest), "seq").alias("_r")).select("format", "_r.*")


def parents(snapshots: DataFrame, head: Column) -> DataFrame:
    """The chain of snapshots from ``head`` back to the root: id, parent, ts, depth (recursive SQL)."""
    spark = snapshots.sparkSession
    snapshots.createOrReplaceTempView("_lw_snapshots")
    start = snapshots.filter(F.col("id") == head)
    start.createOrReplaceTempView("_lw_head")
    return spark.sql(
        "WITH RECURSIVE chain(id, parent, ts, depth) AS (SELECT id, parent, ts, 0 FROM _lw_head UNION ALL "
        "SELECT s.id, s.parent, s.ts, c.depth + 1 FROM _lw_snapshots s JOIN chain c ON s.id = c.parent) SELECT * FROM chain"
    )
