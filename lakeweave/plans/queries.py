"""The engine's registered queries and the same in SQL.

Operators on metadata run on the driver's tables in the role of commits, files and
partitions; the ``e2e`` queries write a table, sync it and read the other format.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave import reader
from lakeweave.functions import instants as I
from lakeweave.functions import paths as P
from lakeweave.functions import schema as S
from lakeweave.functions import stats as ST
from lakeweave.functions import transforms as X
from lakeweave.functions.partition_spec import PartitionField, multi_folder_time, parse_spec, path_millis, path_values
from lakeweave.operators import files as ops
from lakeweave.operators import timeline as line
from lakeweave.plans.controller import SyncConfig, sync
from lakeweave.plans.dml import LakeTable
from lakeweave.sources import footers, registry
from lakeweave.sources.workdir import work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_done: dict[tuple, str] = {}


def once(spark: SparkSession, key: tuple, make: Callable[[str], None]) -> str:
    """A table that queries share, made at its first use in a session."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _done:
        base = work_path(spark, str(key[1]))
        make(base)
        _done[key] = base
    return _done[key]


def orders_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.withColumn("o_year", F.year("o_orderdate").cast("string"))


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_price_cents", "o_order_ms", "o_orderpriority", "o_year"]


def plain(o: DataFrame) -> DataFrame:
    """Orders with integers only, so that every engine hashes them alike."""
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("o_price_cents"), I.millis(F.col("o_orderdate")).alias("o_order_ms"), "o_orderpriority", "o_year")


PLAIN_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS o_price_cents, epoch_ms(o_orderdate) AS o_order_ms, o_orderpriority, CAST(year(o_orderdate) AS VARCHAR) AS o_year FROM orders"


def synced_orders(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    """Orders as Parquet folders by year, synced to a format and read from it."""
    def make(base: str) -> None:
        orders_of(spark, sf_dir).repartition("o_year").write.partitionBy("o_year").parquet(base)

    base = once(spark, ("orders", sf_dir), make)

    def convert(_: str) -> None:
        for r in sync(spark, SyncConfig("PARQUET", base, [fmt], "orders", partition_spec="o_year:VALUE")).values():
            if r.status != "SUCCESS":
                raise RuntimeError(r.error)

    once(spark, ("orders", sf_dir, fmt), convert)
    return plain(reader.read(spark, fmt, base))


def synced_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(base: str) -> None:
        table(spark, sf_dir, "customer").write.parquet(base)
        sync(spark, SyncConfig("PARQUET", base, ["ICEBERG"], "customer"))

    return reader.read(spark, "ICEBERG", once(spark, ("customer", sf_dir), make))


# end to end


@query(PLAIN_SQL)
def e2e_delta_roundtrip(spark, sf_dir):
    return synced_orders(spark, sf_dir, "DELTA")


@query(PLAIN_SQL)
def e2e_iceberg_roundtrip(spark, sf_dir):
    return synced_orders(spark, sf_dir, "ICEBERG")


@query(PLAIN_SQL)
def e2e_hudi_roundtrip(spark, sf_dir):
    return synced_orders(spark, sf_dir, "HUDI")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def e2e_count(spark, sf_dir):
    return synced_orders(spark, sf_dir, "DELTA").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT o_orderkey, o_order_ms FROM ({PLAIN_SQL}) WHERE o_orderstatus = 'F' AND o_price_cents > 10000000")
def e2e_filter_project(spark, sf_dir):
    return synced_orders(spark, sf_dir, "ICEBERG").filter("o_orderstatus = 'F' AND o_price_cents > 10000000").select("o_orderkey", "o_order_ms")


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def e2e_join(spark, sf_dir):
    return synced_orders(spark, sf_dir, "DELTA").join(synced_customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "c_mktsegment")


@query(f"SELECT * FROM ({PLAIN_SQL}) WHERE o_year = '1996'")
def e2e_partition_filter(spark, sf_dir):
    synced_orders(spark, sf_dir, "ICEBERG")
    base = _done[(spark.sparkContext.applicationId, "orders", sf_dir)]
    return plain(reader.read(spark, "ICEBERG", base, partitions={"o_year": "value = '1996'"}))


@query(f"SELECT * FROM ({PLAIN_SQL}) WHERE o_orderkey BETWEEN 100 AND 300")
def e2e_data_skipping(spark, sf_dir):
    synced_orders(spark, sf_dir, "DELTA")
    base = _done[(spark.sparkContext.applicationId, "orders", sf_dir)]
    return plain(reader.read(spark, "DELTA", base, bounds={"o_orderkey": (100, 300)})).filter("o_orderkey BETWEEN 100 AND 300")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0")
def e2e_mod_filter(spark, sf_dir):
    return synced_orders(spark, sf_dir, "HUDI").filter("o_orderkey % 2 = 0").select("o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 20")
def e2e_limit_ordered(spark, sf_dir):
    return synced_orders(spark, sf_dir, "DELTA").orderBy("o_orderkey").limit(20).select("o_orderkey", "o_custkey")


def scripted(spark: SparkSession, sf_dir: str) -> LakeTable:
    """A Delta table after a script of commits: three appends, upsert, delete, dropped partition, added column."""
    def make(base: str) -> None:
        t, o = LakeTable(spark, base, "orders", ("o_orderstatus",)), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
        for k in range(3):
            t.append(o.filter(F.col("o_orderkey") % 3 == k))
        t.upsert(o.filter("o_orderkey % 10 = 0").withColumn("o_custkey", F.col("o_custkey") + 1_000_000), ["o_orderkey"])
        t.delete(F.col("o_orderkey") % 7 == 0)
        t.drop_partition(o_orderstatus="P")
        t.add_columns(T.StructField("note", T.StringType()))
        t.append(o.filter("o_orderstatus = 'P' AND o_orderkey % 5 = 0").withColumn("note", F.lit("again")))

    return LakeTable(spark, once(spark, ("script", sf_dir), make), "orders", ("o_orderstatus",))


_THREE = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders"
_UPSERT = "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey, o_orderstatus FROM orders"


@query(f"{_THREE} WHERE o_orderkey % 3 < 2")
def e2e_time_travel(spark, sf_dir):
    return scripted(spark, sf_dir).read(1)


@query(_UPSERT)
def e2e_upsert(spark, sf_dir):
    return scripted(spark, sf_dir).read(3)


@query(f"SELECT * FROM ({_UPSERT}) WHERE o_orderkey % 7 <> 0")
def e2e_delete(spark, sf_dir):
    return scripted(spark, sf_dir).read(4)


@query(f"SELECT * FROM ({_UPSERT}) WHERE o_orderkey % 7 <> 0 AND o_orderstatus <> 'P'")
def e2e_drop_partition(spark, sf_dir):
    return scripted(spark, sf_dir).read(5)


@query(f"SELECT *, CAST(NULL AS VARCHAR) AS note FROM ({_UPSERT}) WHERE o_orderkey % 7 <> 0 AND o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, 'again' FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 5 = 0")
def e2e_add_column(spark, sf_dir):
    return scripted(spark, sf_dir).read()


@query(f"SELECT *, CAST(NULL AS VARCHAR) AS note FROM ({_UPSERT}) WHERE o_orderkey % 7 <> 0 AND o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, 'again' FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 5 = 0")
def e2e_delta_to_iceberg(spark, sf_dir):
    """A table with eight commits, converted as a whole, read in the other format."""
    base = scripted(spark, sf_dir).base
    once(spark, ("script", sf_dir, "ICEBERG"), lambda _: sync(spark, SyncConfig("DELTA", base, ["ICEBERG"], "orders")))
    return reader.read(spark, "ICEBERG", base)


# several writers, many commits, other layouts


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN -2 WHEN o_orderkey % 6 = 0 THEN -1 ELSE o_custkey END AS o_custkey FROM orders")
def e2e_interleaved_upserts(spark, sf_dir):
    """One upsert commits while another has read the table and not written yet: both hold, the later one last."""
    def make(base: str) -> None:
        o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        first, second = LakeTable(spark, base, "orders"), LakeTable(spark, base, "orders")
        first.append(o)
        write, done = second._write, []

        def slow(rows):
            if not done:
                done.append(first.upsert(o.filter("o_orderkey % 6 = 0").withColumn("o_custkey", F.lit(-1).cast("long")), ["o_orderkey"]))
            return write(rows)

        second._write = slow
        second.upsert(o.filter("o_orderkey % 4 = 0").withColumn("o_custkey", F.lit(-2).cast("long")), ["o_orderkey"])

    return LakeTable(spark, once(spark, ("interleaved", sf_dir), make), "orders").read()


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_custkey END AS customer FROM orders WHERE o_orderkey % 3 <> 0")
def e2e_update_rename(spark, sf_dir):
    """Update, dropped and renamed column, z-order and vacuum."""
    def make(base: str) -> None:
        t = LakeTable(spark, base, "orders")
        t.append(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"))
        t.delete(F.col("o_orderkey") % 3 == 0)
        t.update(F.col("o_orderkey") % 5 == 0, o_custkey=F.lit(0))
        t.drop_columns("o_orderpriority")
        t.rename_column("o_custkey", "customer")
        t.z_order(["o_orderkey", "customer"], 4)
        t.vacuum(0)

    return LakeTable(spark, once(spark, ("update", sf_dir), make), "orders").read()


_MARKS = {"F": "a b", "O": "c/d=e%20f", "P": "\u00e9{x}[y]*"}


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'a b' WHEN 'O' THEN 'c/d=e%20f' ELSE '\u00e9{x}[y]*' END AS mark FROM orders")
def e2e_odd_partition_values(spark, sf_dir):
    """Partition values with what paths escape, through Delta and then Hudi."""
    def make(base: str) -> None:
        mark = F.element_at(F.create_map(*[F.lit(x) for kv in _MARKS.items() for x in kv]), F.col("o_orderstatus"))
        table(spark, sf_dir, "orders").select("o_orderkey", mark.alias("mark")).write.partitionBy("mark").parquet(base)
        for config in (SyncConfig("PARQUET", base, ["DELTA"], partition_spec="mark:VALUE"), SyncConfig("DELTA", base, ["HUDI"])):
            for r in sync(spark, config).values():
                if r.status != "SUCCESS":
                    raise RuntimeError(r.error)

    return reader.read(spark, "HUDI", once(spark, ("odd", sf_dir), make)).select("o_orderkey", "mark")


@query(f"SELECT * FROM ({PLAIN_SQL}) WHERE o_year = '1995' OR o_year = '1997' AND o_orderstatus = 'O'")
def e2e_ordinary_partition_filter(spark, sf_dir):
    """A filter like any other prunes files: the plan has it as PartitionFilters."""
    return synced_orders(spark, sf_dir, "ICEBERG").filter("o_year = '1995' OR o_year = '1997' AND o_orderstatus = 'O'")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority > '3'")
def e2e_bucket_void_filter(spark, sf_dir):
    """A table whose spec has a bucket and a voided field: filters on their columns see the rows' own values."""
    def make(base: str) -> None:
        table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").write.parquet(base)
        sync(spark, SyncConfig("PARQUET", base, ["ICEBERG"], "orders"))
        ice = registry.source("ICEBERG", spark, base).ice
        meta = ice.metadata()
        ids = dict(S.iceberg_ids(meta["schemas"][-1]))
        fields = [{"name": "o_orderpriority_bucket", "transform": "bucket[4]", "source-id": ids["o_orderpriority"], "field-id": 1000}, {"name": "o_orderstatus", "transform": "void", "source-id": ids["o_orderstatus"], "field-id": 1001}]
        meta["partition-specs"] = [{"spec-id": 0, "fields": fields}]
        ice.write_metadata(meta, ice.version() + 1)

    base = once(spark, ("bucket", sf_dir), make)
    assert [f.transform for f in registry.source("ICEBERG", spark, base).table_at().partitions] == ["BUCKET"]
    return reader.read(spark, "ICEBERG", base).filter("o_orderstatus = 'F' AND o_orderpriority > '3'").select("o_orderkey")


def grown(spark: SparkSession, sf_dir: str) -> str:
    """Orders by status in two writes, each followed by an incremental sync to all formats."""
    def make(base: str) -> None:
        o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
        for k in (0, 1):
            o.filter(F.col("o_orderkey") % 2 == k).write.mode("append").partitionBy("o_orderstatus").parquet(base)
            for r in sync(spark, SyncConfig("PARQUET", base, ["DELTA", "ICEBERG", "HUDI"], "orders", partition_spec="o_orderstatus:VALUE")).values():
                if r.status != "SUCCESS" or r.mode != ("INCREMENTAL" if k else "FULL"):
                    raise RuntimeError(f"{r.format} {r.mode}: {r.error}")

    return once(spark, ("grown", sf_dir), make)


_GROWN = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders"


def versions_of(fmt: str, source) -> list[str]:
    return {"DELTA": lambda: list(map(str, source.log.versions())), "ICEBERG": lambda: [str(x["snapshot-id"]) for x in reversed(source.chain())], "HUDI": lambda: [i for i, _ in source.line.completed()]}[fmt]()


def _grown_rows(fmt: str) -> None:
    def whole(spark, sf_dir):
        return reader.read(spark, fmt, grown(spark, sf_dir))

    def before(spark, sf_dir):
        base = grown(spark, sf_dir)
        return reader.read(spark, fmt, base, version=versions_of(fmt, registry.source(fmt, spark, base))[0])

    def as_of(spark, sf_dir):
        base = grown(spark, sf_dir)
        source = registry.source(fmt, spark, base)
        return reader.read(spark, fmt, base, as_of=source.table_at(versions_of(fmt, source)[1]).instant - 1)

    def commit(spark, sf_dir):
        source = registry.source(fmt, spark, grown(spark, sf_dir))
        change = source.change(versions_of(fmt, source)[1])
        return change.added.groupBy(F.col("part")["o_orderstatus"].alias("o_orderstatus")).agg(F.sum("rows").alias("rows"), F.lit(change.removed.count()).alias("removed"))

    def states(spark, sf_dir):
        base = grown(spark, sf_dir)
        source = registry.source(fmt, spark, base)
        first = source.table_at(versions_of(fmt, source)[0]).instant
        return spark.createDataFrame([(len(source.backlog(0)[0]), len(source.backlog(first)[0]), source.safe_from(first), source.safe_from(0))], "all_commits long, later long, safe boolean, never boolean")

    low = fmt.lower()
    for f, name, sql in (
        (whole, f"e2e_incremental_{low}", _GROWN),
        (before, f"e2e_version_{low}", f"{_GROWN} WHERE o_orderkey % 2 = 0"),
        (as_of, f"e2e_as_of_{low}", f"{_GROWN} WHERE o_orderkey % 2 = 0"),
        (commit, f"commit_scan_{low}", "SELECT o_orderstatus, count(*) AS rows, 0 AS removed FROM orders WHERE o_orderkey % 2 = 1 GROUP BY o_orderstatus"),
        (states, f"commit_backlog_{low}", "SELECT CAST(2 AS BIGINT) AS all_commits, CAST(1 AS BIGINT) AS later, true AS safe, false AS never FROM (SELECT count(*) FROM orders)"),
    ):
        f.__name__ = name
        query(sql)(f)


for _fmt in ("DELTA", "ICEBERG", "HUDI"):
    _grown_rows(_fmt)


_STEPS = "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderstatus <> 'P'"


def followed(spark: SparkSession, sf_dir: str) -> str:
    """A Delta table with a sync to Iceberg and Hudi after each commit: appends, upsert, delete, dropped partition; Hudi archives."""
    def make(base: str) -> None:
        t, o = LakeTable(spark, base, "orders", ("o_orderstatus",)), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
        steps = [
            lambda: t.append(o.filter("o_orderkey % 2 = 0")),
            lambda: t.append(o.filter("o_orderkey % 2 = 1")),
            lambda: t.upsert(o.filter("o_orderkey % 10 = 0").withColumn("o_custkey", F.col("o_custkey") + 1_000_000), ["o_orderkey"]),
            lambda: t.delete(F.col("o_orderkey") % 7 == 0),
            lambda: t.drop_partition(o_orderstatus="P"),
        ]
        for k, step in enumerate(steps):
            step()
            for r in sync(spark, SyncConfig("DELTA", base, ["ICEBERG", "HUDI"], "orders", options={"keep": 2, "more": 1})).values():
                if r.status != "SUCCESS" or r.mode != ("INCREMENTAL" if k else "FULL"):
                    raise RuntimeError(f"{r.format} {r.mode}: {r.error}")

    return once(spark, ("followed", sf_dir), make)


@query(_STEPS)
def e2e_removals_iceberg(spark, sf_dir):
    return reader.read(spark, "ICEBERG", followed(spark, sf_dir))


@query(_STEPS)
def e2e_removals_hudi_archived(spark, sf_dir):
    return reader.read(spark, "HUDI", followed(spark, sf_dir))


@query("SELECT 'P' AS o_orderstatus, true AS removed, count(*) AS rows FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 7 <> 0 HAVING count(*) > 0")
def commit_scan_dropped_partition(spark, sf_dir):
    """What the last Delta commit removed, by the statistics of the files it removed."""
    base = followed(spark, sf_dir)
    source = registry.source("DELTA", spark, base)
    version = source.log.versions()[-1]
    gone = source.change(version).removed.select("path")
    files = source.snapshot(version - 1).files.join(gone, "path", "left_semi")
    return files.groupBy(F.col("part")["o_orderstatus"].alias("o_orderstatus"), F.lit(True).alias("removed")).agg(F.sum("rows").alias("rows"))


@query("SELECT DISTINCT o_orderstatus AS key, 'ADD' AS event FROM orders")
def catalog_partition_sync(spark, sf_dir):
    """Partitions of the synced Hudi table as a catalog has them after an incremental sync on top of a full one."""
    from lakeweave.plans import catalog as C

    base = grown(spark, sf_dir)
    source, client, name = registry.source("HUDI", spark, base), C.MemoryCatalog(), C.TableName("db", "orders")
    first = source.line.completed()[0][0]
    C.sync_table(client, name, source.table_at(first), "HUDI")
    client.partitions[str(name)] = {"X": f"{base}/o_orderstatus=X"}
    C.sync_new_partitions(spark, client, name, source, first)
    rows = [(k, "ADD") for k in client.partitions[str(name)] if k != "X"]
    return spark.createDataFrame(rows, "key string, event string")


# set operations on files


def _files(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), F.col("o_orderkey")).alias("path"), "o_orderkey", "o_orderpriority", "o_orderstatus", "o_custkey")


@query("SELECT 'f' || o_orderkey AS path FROM orders WHERE o_orderkey % 2 = 0 EXCEPT SELECT 'f' || o_orderkey FROM orders WHERE o_orderkey % 3 = 0")
def diff_added(spark, sf_dir):
    f = _files(spark, sf_dir)
    return ops.added(f.filter("o_orderkey % 2 = 0"), f.filter("o_orderkey % 3 = 0")).select("path")


@query("SELECT 'f' || o_orderkey AS path FROM orders WHERE o_orderkey % 3 = 0 EXCEPT SELECT 'f' || o_orderkey FROM orders WHERE o_orderkey % 2 = 0")
def diff_removed(spark, sf_dir):
    f = _files(spark, sf_dir)
    return ops.removed(f.filter("o_orderkey % 2 = 0"), f.filter("o_orderkey % 3 = 0")).select("path")


@query("SELECT 'f' || o_orderkey AS path, CASE WHEN o_orderkey % 2 = 0 THEN 'add' ELSE 'remove' END AS op FROM orders WHERE (o_orderkey % 2 = 0) <> (o_orderkey % 3 = 0)")
def diff_both(spark, sf_dir):
    f = _files(spark, sf_dir)
    return ops.diff(ops.unique(f.filter("o_orderkey % 2 = 0")), ops.unique(f.filter("o_orderkey % 3 = 0")))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n_files, CAST(sum(o_custkey) AS BIGINT) AS size, min('f' || o_orderkey) AS first_path FROM orders GROUP BY ALL")
def file_groups(spark, sf_dir):
    return ops.groups(_files(spark, sf_dir), ["o_orderpriority", "o_orderstatus"], F.count(F.lit(1)).alias("n_files"), F.sum("o_custkey").alias("size"), F.min("path").alias("first_path"))


@query("SELECT 'f' || o_orderkey AS path, o_orderpriority AS partition FROM orders WHERE o_orderkey % 4 <> 0 AND (o_orderpriority = '5-LOW' OR o_orderkey % 4 <> 1)")
def replaced_files(spark, sf_dir):
    f = _files(spark, sf_dir).select("path", F.col("o_orderpriority").alias("partition"), "o_orderkey")
    return ops.replaced_by_partition(f.filter("o_orderkey % 4 <> 0").drop("o_orderkey"), f.filter("o_orderkey % 4 = 1 AND partition <> '5-LOW'").drop("o_orderkey"))


@query("""
SELECT coalesce(s.k, c.k) AS key, s.p AS storage_path, c.p AS catalog_path,
       CASE WHEN c.k IS NULL THEN 'ADD' WHEN s.k IS NULL THEN 'DROP' ELSE 'UPDATE' END AS event
FROM (SELECT 'd' || c_custkey AS k, '/t/' || c_nationkey AS p FROM customer WHERE c_custkey % 3 <> 0) s
FULL JOIN (SELECT 'd' || c_custkey AS k, '/t/' || (c_nationkey - c_nationkey % 2) AS p FROM customer WHERE c_custkey % 4 <> 0) c ON s.k = c.k
WHERE s.k IS NULL OR c.k IS NULL OR s.p <> c.p""")
def partition_events(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("key", F.concat(F.lit("d"), F.col("c_custkey")))
    storage = c.filter("c_custkey % 3 <> 0").select("key", F.concat(F.lit("/t/"), F.col("c_nationkey")).alias("path"))
    known = c.filter("c_custkey % 4 <> 0").select("key", F.concat(F.lit("/t/"), F.col("c_nationkey") - F.col("c_nationkey") % 2).alias("path"))
    return ops.partition_events(storage, known)


@query("""
WITH w AS (SELECT 'd' || c_custkey AS k, '/t/' || c_nationkey AS p FROM customer WHERE c_custkey % 2 = 0),
     d AS (SELECT 'd' || c_custkey AS k FROM customer WHERE c_custkey % 10 = 0),
     c AS (SELECT 'd' || c_custkey AS k, '/t/' || (c_nationkey - c_nationkey % 2) AS p FROM customer WHERE c_custkey % 4 = 0)
SELECT w.k AS key, w.p AS storage_path, c.p AS catalog_path, CASE WHEN c.k IS NULL THEN 'ADD' ELSE 'UPDATE' END AS event
FROM w LEFT JOIN c ON w.k = c.k WHERE w.k NOT IN (SELECT k FROM d) AND (c.k IS NULL OR c.p <> w.p)
UNION ALL SELECT k, NULL, NULL, 'DROP' FROM d WHERE k IN (SELECT k FROM c)""")
def partition_events_incremental(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("key", F.concat(F.lit("d"), F.col("c_custkey")))
    written = c.filter("c_custkey % 2 = 0").select("key", F.concat(F.lit("/t/"), F.col("c_nationkey")).alias("path"))
    known = c.filter("c_custkey % 4 = 0").select("key", F.concat(F.lit("/t/"), F.col("c_nationkey") - F.col("c_nationkey") % 2).alias("path"))
    return ops.incremental_partition_events(written, c.filter("c_custkey % 10 = 0").select("key"), known)


@query("SELECT DISTINCT epoch_ms(o_orderdate) AS instant FROM orders WHERE o_orderstatus = 'F' UNION SELECT epoch_ms(o_orderdate) FROM orders WHERE o_orderstatus = 'P'")
def merge_dedup_commits(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", I.millis(F.col("o_orderdate")).alias("instant"))
    return line.merge_commits(o.filter("o_orderstatus = 'F'").select("instant"), o.filter("o_orderstatus = 'P'").select("instant"))


# timelines


def _log(spark, sf_dir):
    """Events as an action log: a path per user and kind, the event's number as version."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat_ws("/", "user_id", F.substr("event_type", F.lit(1), F.lit(1))).alias("path"), F.col("event_id").alias("version"), F.lit(0).alias("position"), F.when(F.col("value") < 10, "remove").otherwise("add").alias("op"))


_LOG_SQL = "SELECT user_id || '/' || substr(event_type, 1, 1) AS path, event_id AS version, CASE WHEN value < 10 THEN 'remove' ELSE 'add' END AS op FROM events"


@query(f"SELECT path, max(version) AS version FROM ({_LOG_SQL}) GROUP BY path HAVING arg_max(op, version) = 'add'")
def log_replay_live(spark, sf_dir):
    return line.replay(_log(spark, sf_dir)).select("path", "version")


@query(f"SELECT path, max(version) AS version FROM ({_LOG_SQL}) WHERE version <= 400 GROUP BY path HAVING arg_max(op, version) = 'add'")
def as_of_version(spark, sf_dir):
    return line.replay(_log(spark, sf_dir), as_of=F.col("version") <= 400).select("path", "version")


@query("""
WITH c AS (SELECT user_id AS version, event_type AS path, CASE WHEN event_id % 2 = 0 THEN 'add' ELSE 'remove' END AS op, event_id % 4 = 0 AS dv, event_id FROM events),
     x AS (SELECT version, path FROM c GROUP BY ALL HAVING bool_or(op = 'add' AND dv) AND bool_or(op = 'remove'))
SELECT version, path, op, event_id FROM c WHERE (version, path) NOT IN (SELECT (version, path) FROM x)""")
def vector_cancel(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    c = e.select(F.col("user_id").alias("version"), F.col("event_type").alias("path"), F.when(F.col("event_id") % 2 == 0, "add").otherwise("remove").alias("op"), (F.col("event_id") % 4 == 0).alias("has_vector"), "event_id")
    return line.cancel_vectors(c).drop("has_vector")


@query("SELECT event_id AS version, (epoch_us(ts) // 1000) AS ts FROM events WHERE (epoch_us(ts) // 1000) > 1705276800000")
def commit_backlog(spark, sf_dir):
    commits = table(spark, sf_dir, "events").select(F.col("event_id").alias("version"), I.millis(F.col("ts")).alias("ts"))
    return line.after(commits, F.lit(1705276800000))


@query("""
WITH t AS (SELECT event_id AS instant, CASE WHEN value < 12 THEN 'inflight' ELSE 'completed' END AS state, CASE event_type WHEN 'signup' THEN 'savepoint' ELSE 'commit' END AS action FROM events),
     p AS (SELECT instant FROM t WHERE instant % 9 = 0 AND instant <= 200 UNION SELECT 10000000000),
     done AS (SELECT instant FROM t WHERE instant > 200 AND state = 'completed'),
     k AS (SELECT t.* FROM t JOIN p USING (instant) WHERE action <> 'savepoint')
SELECT instant, 'process' AS role FROM done UNION SELECT instant, 'process' FROM k WHERE state = 'completed'
UNION SELECT instant, 'carry' FROM t WHERE instant > 200 AND state <> 'completed' AND instant <= (SELECT max(instant) FROM done)
UNION SELECT instant, 'carry' FROM k WHERE state <> 'completed'""")
def pending_carry_forward(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t = e.select(F.col("event_id").alias("instant"), F.when(F.col("value") < 12, "inflight").otherwise("completed").alias("state"), F.when(F.col("event_type") == "signup", "savepoint").otherwise("commit").alias("action"))
    pending = t.filter("instant % 9 = 0 AND instant <= 200").select("instant").unionByName(spark.createDataFrame([(10_000_000_000,)], "instant long"))
    return line.backlog(t, F.lit(200), pending)


def _targets(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("format")).agg(F.max(F.when(F.col("user_id") % 7 != 0, I.millis(F.col("ts")))).alias("last"), F.collect_set(F.when(F.col("user_id") % 40 == 0, F.col("user_id"))).alias("pending"))


@query("SELECT event_type AS format, max(CASE WHEN user_id % 7 <> 0 THEN (epoch_us(ts) // 1000) END) AS last FROM events GROUP BY event_type ORDER BY last, format LIMIT 1")
def most_out_of_sync(spark, sf_dir):
    return line.most_out_of_sync(_targets(spark, sf_dir)).select("format", "last")


@query("SELECT DISTINCT user_id AS instant FROM events WHERE user_id % 40 = 0")
def distinct_pending(spark, sf_dir):
    return line.distinct_pending(_targets(spark, sf_dir))


@query("SELECT event_type AS format, least(max(CASE WHEN user_id % 7 <> 0 THEN (epoch_us(ts) // 1000) END), min(CASE WHEN user_id % 40 = 0 THEN user_id END)) AS earliest FROM events GROUP BY event_type")
def earliest_instant(spark, sf_dir):
    return _targets(spark, sf_dir).select("format", line.earliest(F.col("last"), F.col("pending")).alias("earliest"))


@query("SELECT event_id, (epoch_us(ts) // 1000) AS ts FROM events WHERE (epoch_us(ts) // 1000) > 1706000000000 OR (epoch_us(ts) // 1000) IN (SELECT epoch_us(ts) // 1000 FROM events WHERE event_id IN (3, 5, 8))")
def change_applicable(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", I.millis(F.col("ts")).alias("ts"))
    pending = e.filter(F.col("event_id").isin(3, 5, 8)).agg(F.collect_list("ts").alias("pending"))
    return e.crossJoin(F.broadcast(pending)).filter(line.applicable(F.col("ts"), F.lit(1706000000000), F.col("pending"))).drop("pending")  # one row


@query("SELECT epoch_us(max(ts)) // 1000 AS last FROM events")
def same_instant(spark, sf_dir):
    e = table(spark, sf_dir, "events").agg(F.max("ts").alias("last"))
    return line.same_instant(e.unionByName(e).select(F.col("last").cast("timestamp").alias("last"))).select(F.unix_millis("last").alias("last"))


@query("SELECT 'f' || o_orderkey AS path FROM orders WHERE o_orderpriority = '5-LOW'")
def data_files_only(spark, sf_dir):
    f = _files(spark, sf_dir).withColumn("kind", F.when(F.col("o_orderpriority") == "5-LOW", "data").otherwise("deletes"))
    return ops.data_files(f).select("path")


@query("SELECT 'g' || c_custkey AS file_id, '2024010100000000' || (CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END) AS instant FROM customer")
def hudi_latest_base_files(spark, sf_dir):
    from lakeweave.sources.hudi import latest_base_files

    c = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("k"))
    path = F.concat(F.lit("/t/p=1/g"), F.col("c_custkey"), F.lit("_0-1-2_2024010100000000"), F.col("k"), F.lit(".parquet"))
    return latest_base_files(c.select(F.lit("p=1").alias("partition"), path.alias("path"))).select("file_id", "instant")


@query("SELECT min(epoch_ms(o_orderdate)) <= 800000000000 AS safe FROM orders")
def safe_from_instant(spark, sf_dir):
    return line.safe_from_earliest(table(spark, sf_dir, "orders").select(I.millis(F.col("o_orderdate")).alias("mtime")), F.lit(800000000000))


@query("SELECT min(epoch_ms(o_orderdate)) <= 1000000000000 AS safe FROM orders")
def safe_from_version(spark, sf_dir):
    return line.safe_from_versions(table(spark, sf_dir, "orders").select(I.millis(F.col("o_orderdate")).alias("ts")), F.lit(1000000000000))


@query("SELECT bool_or(event_id <= 500) AND NOT bool_or(event_type = 'error' AND event_id > 900) AS safe FROM events")
def safe_from_cleaned(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t = e.select(F.col("event_id").alias("instant"), F.lit("completed").alias("state"), F.when(F.col("event_type") == "error", "clean").otherwise("commit").alias("action"), F.when(F.col("event_id") <= 900, F.lit(1)).cast("long").alias("retain"))
    return line.safe_from_cleaned(t, F.lit(500))


@query("SELECT event_type AS format, max(event_id) AS seq, arg_max(user_id, event_id) AS user_id FROM events GROUP BY event_type")
def last_result_per_format(spark, sf_dir):
    return line.last_result(table(spark, sf_dir, "events").select(F.col("event_type").alias("format"), F.col("event_id").alias("seq"), "user_id"))


@query("""
WITH RECURSIVE s AS (SELECT event_id AS id, CASE WHEN event_id > 0 THEN event_id // 2 END AS parent, (epoch_us(ts) // 1000) AS ts FROM events),
chain AS (SELECT id, parent, ts, 0 AS depth FROM s WHERE id = 777 UNION ALL SELECT s.id, s.parent, s.ts, depth + 1 FROM s JOIN chain ON s.id = chain.parent)
SELECT id, coalesce(parent, -1) AS parent, ts, depth FROM chain""")
def snapshot_chain(spark, sf_dir):
    s = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.expr("CASE WHEN event_id > 0 THEN event_id div 2 END").alias("parent"), I.millis(F.col("ts")).alias("ts"))
    return line.parents(s, F.lit(777)).withColumn("parent", F.coalesce("parent", F.lit(-1).cast("long")))


@query("SELECT event_id, (epoch_us(ts) // 1000) AS instant_ms, epoch_ms(date_trunc('second', ts)) + 999 AS second_ms FROM events")
def instant_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyyMMddHHmmssSSS").alias("a"), F.date_format("ts", "yyyyMMddHHmmss").alias("b"))
    return e.select("event_id", F.unix_millis(I.parse_instant(F.col("a"))).alias("instant_ms"), F.unix_millis(I.parse_instant(F.col("b"))).alias("second_ms"))


# partition transforms

_ORDINALS = {"year": "datediff('year', DATE '1970-01-01', ts)", "month": "datediff('month', DATE '1970-01-01', ts)", "day": "datediff('day', DATE '1970-01-01', ts)", "hour": "datediff('hour', TIMESTAMP '1970-01-01', ts)"}


def _transform(unit: str):
    def run(spark, sf_dir):
        e, t = table(spark, sf_dir, "events"), unit.upper()
        n = X.ordinal(F.col("ts"), t)
        return e.select("event_id", n.cast("long").alias("ordinal"), X.period_start(F.col("ts"), t).alias("start_ms"), X.ordinal_to_millis(n.cast("int"), t).alias("back_ms"), X.millis_to_ordinal(X.period_start(F.col("ts"), t), t).cast("long").alias("again"))

    run.__name__ = f"xform_{unit}"
    start = f"epoch_ms(CAST(date_trunc('{unit}', ts) AS TIMESTAMP))"
    query(f"SELECT event_id, CAST({_ORDINALS[unit]} AS BIGINT) AS ordinal, {start} AS start_ms, {start} AS back_ms, CAST({_ORDINALS[unit]} AS BIGINT) AS again FROM events")(run)


for _unit in _ORDINALS:
    _transform(_unit)


@query("SELECT event_id, CAST(year(ts) AS BIGINT) AS y, strftime(ts, '%Y-%m') AS m, CAST(CAST(ts AS DATE) AS VARCHAR) AS d, strftime(ts, '%Y-%m-%d-%H') AS h FROM events")
def delta_gen_columns(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    y, m, d, h = (F.expr(X.generated_expression(t, "ts")) for t in X.TIME)
    return e.select("event_id", y.cast("long").alias("y"), m.alias("m"), d.cast("string").alias("d"), h.alias("h"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d-%H') AS hour_text, epoch_ms(date_trunc('hour', ts)) AS hour_ms, CASE WHEN event_id % 5 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS folded FROM events")
def delta_partition_strings(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = X.partition_string(F.col("ts"), "HOUR")
    folded = X.composite([F.year("ts"), F.when(F.col("event_id") % 5 != 0, F.month("ts")), F.day("ts")])
    return e.select("event_id", text.alias("hour_text"), X.parse_partition_string(text, "HOUR").alias("hour_ms"), folded.alias("folded"))


@query("SELECT o_orderkey, o_orderstatus AS status, epoch_ms(date_trunc('day', o_orderdate)) AS day_ms FROM orders")
def hive_path_parse(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("path", F.concat(F.lit("day="), F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit("/o_orderstatus="), F.col("o_orderstatus")))
    spec = parse_spec("o_orderdate:DAY:yyyy/MM/dd,o_orderstatus:VALUE")
    day, status = path_values(F.col("path"), spec)
    return o.select("o_orderkey", status.alias("status"), path_millis(day, spec[0]).alias("day_ms"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderpriority END AS priority FROM orders")
def hive_default_null(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    path = F.concat(F.lit("p="), F.when(F.col("o_orderkey") % 6 == 0, P.HIVE_NULL).otherwise(F.col("o_orderpriority")))
    return o.select("o_orderkey", path_values(path, [PartitionField("p")])[0].alias("priority"))


@query("SELECT o_orderkey, epoch_ms(date_trunc('month', o_orderdate)) AS month_ms FROM orders")
def multi_folder_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    path = F.concat(F.lit("year="), F.year("o_orderdate"), F.lit("/month="), F.month("o_orderdate"))
    return o.select("o_orderkey", multi_folder_time(path, ["year", "month"], "MONTH").alias("month_ms"))


@query("SELECT p_partkey, p_brand || '/' || p_partkey || '.parquet' AS inside, p_brand AS folder, 'file:/x/' || p_partkey AS named FROM part")
def path_relative(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    path = F.concat(F.when(F.col("p_partkey") % 2 == 0, "s3a://b/t/").otherwise("s3://b/t/"), F.col("p_brand"), F.lit("/"), F.col("p_partkey"), F.lit(".parquet"))
    bare = F.concat(F.when(F.col("p_partkey") % 3 == 0, "file:///x/").when(F.col("p_partkey") % 3 == 1, "file:/x/").otherwise("/x/"), F.col("p_partkey"))
    return p.select("p_partkey", P.relative(path, "s3://b/t").alias("inside"), P.partition_path(path, "s3://b/t").alias("folder"), P.canonical(bare).alias("named"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'g' || c_custkey ELSE 'part-' || c_custkey || '.parquet' END AS file_id FROM customer")
def hudi_file_ids(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    path = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("/t/p=1/g"), F.col("c_custkey"), F.lit("_0-1-2_20240101000000000.parquet"))).otherwise(F.concat(F.lit("/t/part-"), F.col("c_custkey"), F.lit(".parquet")))
    return c.select("c_custkey", P.hudi_file_id(path).alias("file_id"))


@query(None)
def delta_bucket_column(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", X.bucket(F.col("o_orderpriority"), 10).alias("bucket"), F.expr(X.generated_expression("BUCKET", "o_orderpriority", 10)).alias("generated"))


# statistics


def _parquet_files(spark, sf_dir):
    names = ["orders", "lineitem", "customer", "events"]
    return spark.createDataFrame([(f"{sf_dir}/{n}.parquet",) for n in names], "path string")




def footer_rows(spark, sf_dir):
    name = F.regexp_extract("path", r"([^/]+)\.parquet$", 1)
    return footers.chunks(_parquet_files(spark, sf_dir)).withColumn("table_name", name)


@query("""
SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS rows UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem)
UNION ALL SELECT 'customer', (SELECT count(*) FROM customer) UNION ALL SELECT 'events', (SELECT count(*) FROM events)""")
def record_counts(spark, sf_dir):
    found = footers.record_count(footers.chunks(_parquet_files(spark, sf_dir)))
    return found.select(F.regexp_extract("path", r"([^/]+)\.parquet$", 1).alias("table_name"), "rows")


@query("""
SELECT 'o_orderkey' AS column_name, count(o_orderkey) AS num_values, count(*) - count(o_orderkey) AS nulls FROM orders
UNION ALL SELECT 'o_custkey', count(*), count(*) - count(o_custkey) FROM orders UNION ALL SELECT 'o_orderstatus', count(*), count(*) - count(o_orderstatus) FROM orders
UNION ALL SELECT 'o_totalprice', count(*), count(*) - count(o_totalprice) FROM orders UNION ALL SELECT 'o_orderdate', count(*), count(*) - count(o_orderdate) FROM orders
UNION ALL SELECT 'o_orderpriority', count(*), count(*) - count(o_orderpriority) FROM orders""")
def rowgroup_stats_sums(spark, sf_dir):
    rows = footer_rows(spark, sf_dir).filter("table_name = 'orders'")
    return footers.merge_row_groups(rows).select(F.col("column").alias("column_name"), "num_values", "nulls")


@query("""
SELECT 'o_orderkey' AS column_name, CAST(min(o_orderkey) AS DOUBLE) AS low, CAST(max(o_orderkey) AS DOUBLE) AS high FROM orders
UNION ALL SELECT 'o_custkey', min(o_custkey), max(o_custkey) FROM orders
UNION ALL SELECT 'l_linenumber', min(l_linenumber), max(l_linenumber) FROM lineitem UNION ALL SELECT 'l_quantity', min(l_quantity), max(l_quantity) FROM lineitem""")
def column_min_max(spark, sf_dir):
    rows = footer_rows(spark, sf_dir).filter(F.col("column").isin("o_orderkey", "o_custkey", "l_linenumber", "l_quantity"))
    return footers.merge_row_groups(rows).select(F.col("column").alias("column_name"), "low", "high")


@query("SELECT 'o_orderstatus' AS column_name, min(o_orderstatus) AS low, max(o_orderstatus) AS high FROM orders UNION ALL SELECT 'o_orderpriority', min(o_orderpriority), max(o_orderpriority) FROM orders")
def column_min_max_text(spark, sf_dir):
    rows = footer_rows(spark, sf_dir).filter(F.col("column").isin("o_orderstatus", "o_orderpriority"))
    return footers.merge_row_groups(rows, "string").select(F.col("column").alias("column_name"), "low", "high")


@query("SELECT count(*) AS num_records, min(o_orderkey) AS low_key, max(o_orderkey) AS high_key, min(o_orderstatus) AS low_status, max(o_orderpriority) AS high_priority, count(*) - count(o_custkey) AS null_customers, epoch_ms(min(o_orderdate)) AS low_date FROM orders")
def delta_stats_json(spark, sf_dir):
    s = footers.file_stats(_parquet_files(spark, sf_dir).filter(F.col("path").endswith("/orders.parquet")))
    get = lambda path: F.get_json_object("stats", path)
    return s.select(
        get("$.numRecords").cast("long").alias("num_records"), get("$.minValues.o_orderkey").cast("long").alias("low_key"), get("$.maxValues.o_orderkey").cast("long").alias("high_key"),
        get("$.minValues.o_orderstatus").alias("low_status"), get("$.maxValues.o_orderpriority").alias("high_priority"), get("$.nullCount.o_custkey").cast("long").alias("null_customers"),
        F.unix_millis(get("$.minValues.o_orderdate").cast("timestamp")).alias("low_date"),
    )


@query("""
SELECT c AS column_name, low, high, CAST(0 AS BIGINT) AS nulls, n AS rows FROM (SELECT count(*) AS n FROM orders),
(SELECT 'o_orderkey' AS c, CAST(min(o_orderkey) AS VARCHAR) AS low, CAST(max(o_orderkey) AS VARCHAR) AS high FROM orders
 UNION ALL SELECT 'o_custkey', CAST(min(o_custkey) AS VARCHAR), CAST(max(o_custkey) AS VARCHAR) FROM orders
 UNION ALL SELECT 'o_orderstatus', min(o_orderstatus), max(o_orderstatus) FROM orders)""")
def file_column_ranges(spark, sf_dir):
    files = footers.file_stats(_parquet_files(spark, sf_dir).filter(F.col("path").endswith("/orders.parquet")))
    found = ST.ranges(files, table(spark, sf_dir, "orders").schema)
    return found.filter(F.col("column").isin("o_orderkey", "o_custkey", "o_orderstatus")).select(F.col("column").alias("column_name"), "low", "high", "nulls", "rows")


@query("SELECT o_custkey, min(o_orderkey) AS low, max(o_orderkey) AS high, min(o_orderkey) = max(o_orderkey) AS scalar FROM orders GROUP BY o_custkey")
def range_collapse(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"))
    return o.select("o_custkey", ST.collapsed(F.col("a"), F.col("b")).alias("r")).select("o_custkey", "r.low", "r.high", "r.scalar")


@query("""SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS second, epoch_ms(date_trunc('second', ts)) AS back_ms,
CASE event_id % 4 WHEN 0 THEN 'NaN' WHEN 1 THEN 'Infinity' WHEN 2 THEN '-Infinity' ELSE CAST(event_id AS VARCHAR) END AS number, CAST(event_id AS DECIMAL(20, 2)) / 100 = event_id / 100 AS kept FROM events""")
def log_scalars(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.date_trunc("second", "ts").cast("timestamp").alias("t"))
    second, number = ST.to_log(F.col("t"), T.TimestampType()), F.when(F.col("event_id") % 4 == 0, "NaN").when(F.col("event_id") % 4 == 1, "Infinity").when(F.col("event_id") % 4 == 2, "-Infinity").otherwise(F.col("event_id").cast("string"))
    value = ST.from_log(number, T.DoubleType())
    again = F.when(F.isnan(value), "NaN").when(value == float("inf"), "Infinity").when(value == float("-inf"), "-Infinity").otherwise(value.cast("long").cast("string"))
    cents = ST.from_log(F.concat(F.floor(F.col("event_id") / 100).cast("string"), F.lit("."), F.lpad((F.col("event_id") % 100).cast("string"), 2, "0")), T.DecimalType(20, 2))
    return e.select("event_id", ST.to_log(F.to_date("t"), T.DateType()).alias("day"), second.alias("second"), F.unix_millis(ST.from_log(second, T.TimestampType())).alias("back_ms"), again.alias("number"), (cents * 100 == F.col("event_id")).alias("kept"))


@query("""SELECT event_id, 'LongWrapper' AS long_wrapper, CAST(epoch_us(ts) AS VARCHAR) AS micros, CAST(datediff('day', DATE '1970-01-01', ts) AS VARCHAR) AS days,
CAST(event_id AS VARCHAR) || '.250000000000000' AS decimal_text, CAST(event_id * 4 + 1 AS BIGINT) AS quarters, true AS back FROM events""")
def index_scalars(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("t"))
    price = (F.col("event_id") + F.lit("0.25").cast("decimal(12,2)")).cast("decimal(20,2)")
    kept = ST.to_index(price, T.DecimalType(20, 2))
    time = ST.to_index(F.col("t"), T.TimestampType())
    back = (ST.from_index(time, T.TimestampType()) == F.col("t")) & (ST.from_index(ST.to_index(F.to_date("t"), T.DateType()), T.DateType()) == F.to_date("t"))
    return e.select("event_id", ST.to_index(F.col("event_id").cast("long"), T.LongType())["wrapper"].alias("long_wrapper"), time["value"].alias("micros"), ST.to_index(F.to_date("t"), T.DateType())["value"].alias("days"), kept["value"].alias("decimal_text"), (ST.from_index(kept, T.DecimalType(20, 2)) * 4).cast("long").alias("quarters"), back.alias("back"))


@query("SELECT 'f' || o_orderkey AS path, CASE WHEN o_orderkey % 2 = 0 THEN 'add' ELSE 'remove' END AS op FROM orders WHERE (o_orderkey % 2 = 0) <> (o_orderkey % 3 = 0)")
def diff_of_groups(spark, sf_dir):
    f = _files(spark, sf_dir)
    grouped = lambda rows: ops.groups(rows, ["o_orderpriority"], F.collect_list(F.struct("path")).alias("files"))
    return ops.group_diff(grouped(f.filter("o_orderkey % 2 = 0")), grouped(f.filter("o_orderkey % 3 = 0")))


# schemas

_NESTED = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("place", T.StructType([T.StructField("city", T.StringType()), T.StructField("at", T.StructType([T.StructField("lat", T.DoubleType())]))])),
    T.StructField("props", T.MapType(T.StringType(), T.IntegerType())),
])


_KIND = "CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'DATE' THEN 'date' ELSE lower(column_type) END"
_LINEITEM = f"SELECT column_name AS path, {_KIND} AS kind, row_number() OVER () AS n FROM (DESCRIBE lineitem)"


@query(f"SELECT CAST(n - 1 AS INTEGER) AS ordinal, path, n AS field_id FROM ({_LINEITEM}) WHERE kind IN ('bigint', 'int', 'string', 'double')")
def table_schema_ids(spark, sf_dir):
    """Ordinals and Iceberg ids of a table's columns, through the format's schema and back."""
    schema = table(spark, sf_dir, "lineitem").schema
    iceberg = S.to_iceberg(schema)
    ids = spark.createDataFrame(list(S.iceberg_ids(iceberg)), "path string, field_id long")
    rows = spark.createDataFrame([r[:3] for r in S.schema_rows(S.from_iceberg(iceberg))], "ordinal int, path string, type string")
    return rows.filter(F.col("type").isin("bigint", "int", "string", "double")).join(ids, "path").select("ordinal", "path", "field_id")


@query(f"SELECT path, CASE WHEN n % 3 = 0 THEN 'drop' ELSE 'optional' END AS change FROM ({_LINEITEM}) WHERE n % 3 <> 1 UNION ALL SELECT path || '_new', 'add' FROM ({_LINEITEM}) WHERE n % 3 = 0")
def table_schema_changes(spark, sf_dir):
    from lakeweave.sources.iceberg import schema_changes

    old = table(spark, sf_dir, "lineitem").schema
    new = []
    for n, f in enumerate(old.fields, 1):
        new.append(T.StructField(f"{f.name}_new", f.dataType) if n % 3 == 0 else T.StructField(f.name, f.dataType, not f.nullable) if n % 3 == 2 else f)
    return spark.createDataFrame(schema_changes(S.to_iceberg(old), S.to_iceberg(T.StructType(new))), "path string, change string")


@query("""SELECT * FROM (VALUES (0, 'id', 'bigint', false), (1, 'tags', 'array', true), (2, 'place', 'struct', true), (3, 'props', 'map', true), (4, 'tags._element', 'string', true),
(5, 'place.city', 'string', true), (6, 'place.at', 'struct', true), (7, 'props._key', 'string', false), (8, 'props._value', 'int', true), (9, 'place.at.lat', 'double', true)) t(ordinal, path, type, nullable)""")
def schema_flatten(spark, sf_dir):
    return spark.createDataFrame([r[:4] for r in S.schema_rows(_NESTED)], "ordinal int, path string, type string, nullable boolean")


@query("SELECT * FROM (VALUES ('gone', 'drop'), ('id', 'optional'), ('id', 'type'), ('fresh', 'add'), ('place.city', 'doc'), ('place.zip', 'add')) t(path, change)")
def schema_diff(spark, sf_dir):
    from lakeweave.sources.iceberg import schema_changes

    old = T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("gone", T.StringType()), T.StructField("place", T.StructType([T.StructField("city", T.StringType())]))])
    new = T.StructType([T.StructField("id", T.LongType()), T.StructField("place", T.StructType([T.StructField("city", T.StringType(), True, {"comment": "name"}), T.StructField("zip", T.StringType())])), T.StructField("fresh", T.DateType())])
    return spark.createDataFrame(schema_changes(S.to_iceberg(old), S.to_iceberg(new)), "path string, change string")


@query("SELECT * FROM (VALUES ('id', 1), ('tags', 2), ('place', 3), ('props', 4), ('tags._element', 5), ('place.city', 6), ('place.at', 7), ('place.at.lat', 8), ('props._key', 9), ('props._value', 10)) t(path, field_id)")
def iceberg_field_ids(spark, sf_dir):
    return spark.createDataFrame([(p, i) for p, i in S.iceberg_ids(S.to_iceberg(_NESTED))], "path string, field_id int")


def entry(spark: SparkSession) -> DataFrame:
    """Orders written by year, synced from Parquet to Delta, counted through the Delta reader."""
    return e2e_count(spark, "/root/testdata/sf0.001")
