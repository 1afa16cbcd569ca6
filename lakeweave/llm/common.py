"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, for intermediate tables.

    ``spark.checkpoint.dir`` where the session has it. Where it is unset, a temporary
    folder is made only if driver and executors are one machine; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_lw_shared_dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lakeweave-")
        spark._lw_shared_dir = base
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lakeweave/{uuid.uuid4().hex}/{name}"


#: Rows of a narrow table that a task writes.
NARROW_ROWS = 20_000


def materialize(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    This cuts the lineage at a table that any executor can reread, so a lost
    executor costs a reread and never a recomputation of the whole loop.
    ``most`` bounds the rows of a narrow table: a task writes some NARROW_ROWS of them, so that
    a small one isn't as many files as a shuffle has partitions.
    """
    path = scratch_path(df.sparkSession, name)
    if most is not None:
        df = df.coalesce(max(8, -(-most // NARROW_ROWS)))
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._lw_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``materialize`` that nothing reads any more; they stay where pyarrow has no such file system."""
    from pyarrow import fs

    for table in tables:
        try:
            store, path = fs.FileSystem.from_uri(table._lw_path if ":" in table._lw_path else f"file://{table._lw_path}")
            store.delete_dir(path)
        except (OSError, ValueError):
            pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def power_of(base: int, least: int) -> tuple[int, int]:
    """The smallest ``base ** k >= least`` and its ``k`` (1 at least)."""
    k, n = 1, base
    while n < least:
        k, n = k + 1, n * base
    return n, k


def join_salted(left: DataFrame, right: DataFrame, on: Column, salt: Column, salts: int = 64, how: str = "inner") -> DataFrame:
    """Joins with a light side whose keys may be hot on the left: each row of ``right`` goes to all ``salts`` shares, each row of ``left`` to one."""
    dealt = left.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    each = right.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(each.hint("merge"), on & (F.col("_salt") == F.col("_share")), how).drop("_salt", "_share")


#: Rows of the light side that a task may hash.
HASHED_ROWS = 2_000_000


def join_dealt(docs: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Joins whole documents with a light side, a written table, by one shuffle.

    The light side is hashed within each partition, so texts are dealt but not sorted;
    only where a partition would hash more than HASHED_ROWS rows both sides are sorted,
    which can spill.
    """
    rows = right.count() / shuffle_partitions(docs.sparkSession)
    return docs.join(right.hint("shuffle_hash" if rows <= HASHED_ROWS else "merge"), on, how)


def unit_hash(*cols: Column | str) -> Column:
    """A reproducible uniform number in [0, 1) from the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def release() -> None:
    """Gives memory that a task has freed back to the system: Python workers live on and serve other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc
