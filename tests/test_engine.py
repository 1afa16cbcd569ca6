"""Commits of several writers, odd paths, pruning, archives, checkpoints and catalogs."""

import gzip
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave import reader
from lakeweave.plans import catalog as C
from lakeweave.plans.controller import SyncConfig, sync
from lakeweave.plans.dml import LakeTable
from lakeweave.sources import registry
from lakeweave.sources.delta import DeltaLog, DeltaTarget
from lakeweave.sources.hudi import HudiSource, Timeline
from lakeweave.sources.iceberg import IcebergTable
from lakeweave.sources.model import CatalogError, Conflict, ReadError, Table
from lakeweave.sources.storage import Storage


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def ok(results, mode=None):
    assert all(r.status == "SUCCESS" and mode in (None, r.mode) for r in results.values()), results


def test_commits_conflict(spark, tmp_path):
    t = LakeTable(spark, f"file:{tmp_path}/t", retries=0)
    t.append(spark.createDataFrame([(1, 1), (2, 1)], "k long, v long"))
    other, write = LakeTable(spark, t.base, retries=0), t._write
    t._write = lambda rows: (other.upsert(spark.createDataFrame([(2, 99)], "k long, v long"), ["k"]), write(rows))[1]
    with pytest.raises(Conflict):
        t.upsert(spark.createDataFrame([(1, 50)], "k long, v long"), ["k"])
    assert rows_of(t.read()) == [(1, 1), (2, 99)]
    with pytest.raises(Conflict):
        t.target.commit(t._table(t.schema()), t.target.state(), t._none(), t._none(), "X", 0)
    s = Storage(spark, t.base)
    s.write("once", "a")
    with pytest.raises(FileExistsError):
        s.write("once", "b")
    assert s.text("once") == "a" and not [n for n in s.names("") if n.endswith(".tmp")]


VALUES = ["a b", "c/d", "e%20f", "a=b", "x+y", "[z]*{q}", "\u00e9", "#?", None]


@pytest.mark.parametrize("fmt", ["DELTA", "ICEBERG", "HUDI"])
def test_odd_partition_values(spark, tmp_path, fmt):
    base = f"file:{tmp_path}/t"
    df = spark.createDataFrame([(k, v) for k, v in enumerate(VALUES * 2)], "id long, p string")
    df.write.partitionBy("p").parquet(base)
    ok(sync(spark, SyncConfig("PARQUET", base, [fmt], partition_spec="p:VALUE")))
    got = reader.read(spark, fmt, base)
    assert rows_of(got) == rows_of(df)
    plan = got.filter("p = 'c/d'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan and "Exchange" not in plan and "Join" not in plan
    assert rows_of(got.filter("p = 'c/d'")) == [(1, "c/d"), (10, "c/d")]
    t = LakeTable(spark, f"file:{tmp_path}/own", partition_by=("p",))
    t.append(df)
    t.delete(F.col("id") == 1)
    t.drop_partition(p="e%20f")
    assert rows_of(t.read()) == rows_of(df.filter("id <> 1 AND (p IS NULL OR p <> 'e%20f')"))


def test_partition_values_without_a_shuffle(spark, tmp_path, monkeypatch):
    """Folders that don't say the values: a broadcast for each SCAN_KEYS folders or files."""
    base = f"file:{tmp_path}/t"
    t = LakeTable(spark, base, partition_by=("p",))
    for k in range(3):
        t.append(spark.createDataFrame([(10 * k + j, f"p{j % 2}") for j in range(4)], "id long, p string"))
    want = rows_of(t.read())
    assert len(want) == 12
    monkeypatch.setattr(reader, "ROOTS", 0)
    monkeypatch.setattr(reader, "SCAN_KEYS", 2)
    got = t.read()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and plan.count("BroadcastHashJoin") == 3
    assert rows_of(got) == want
    files = t.source.snapshot().files
    one = files.select("path").orderBy("path").first()[0]
    mixed = files.withColumn("path", F.col("path")).withColumn("part", F.when(F.col("path") == one, F.create_map(F.lit("p"), F.lit("other"))).otherwise(F.col("part")))
    assert reader.read_files(spark, t.source.table_at(), mixed).filter("p = 'other'").count() > 0


def test_changes_of_rows_and_columns(spark, tmp_path):
    t = LakeTable(spark, f"file:{tmp_path}/t", partition_by=("p",))
    t.append(spark.createDataFrame([(k, k % 3, f"p{k % 2}") for k in range(20)], "id long, v long, p string"))
    t.update(F.col("id") > 15, v=F.lit(7))
    t.rename_column("v", "w")
    assert t.read().columns == ["id", "w", "p"] and t.read().filter("w = 7").count() == 4
    t.z_order(["id", "w"], 2)
    t.drop_columns("w")
    assert rows_of(t.read()) == [(k, f"p{k % 2}") for k in sorted(range(20), key=lambda k: str((k, f"p{k % 2}")))]
    with pytest.raises(Exception, match="partition columns"):
        t.drop_columns("p")
    before = t.vacuum(0, dry_run=True)
    assert t.vacuum(0) == before > 0 and t.vacuum(0) == 0 and t.read().count() == 20
    with pytest.raises(Exception):
        t.read(0).count()


def test_delta_checkpoints_and_gaps(spark, tmp_path):
    base = f"file:{tmp_path}/t"
    t = LakeTable(spark, base)
    t.target = DeltaTarget(spark, base, checkpoint_every=2, checkpoint_rows=1)
    for k in range(5):
        t.append(spark.createDataFrame([(k,)], "id long"))
    log = DeltaLog(spark, base)
    version, parts = log.checkpoint()
    assert version == 4 and len(parts) > 1
    log.store.write("_delta_log/00000000000000000004.checkpoint.80a083e8-7026-4e79-81be-64bd76c43a11.parquet", "V2")
    for v in range(4):
        log.store.delete(f"_delta_log/{v:020d}.json")
    assert rows_of(t.read()) == [(k,) for k in range(5)]
    t.append(spark.createDataFrame([(5,)], "id long"))
    t.append(spark.createDataFrame([(6,)], "id long"))
    log.store.delete("_delta_log/00000000000000000005.json")
    for name in log.store.names("_delta_log"):
        if name.startswith("00000000000000000006.checkpoint"):
            log.store.delete(f"_delta_log/{name}")
    with pytest.raises(ReadError, match="missing"):
        t.read()


def test_delta_vectors_and_mapped_columns(spark, tmp_path):
    base = f"file:{tmp_path}/t"
    spark.createDataFrame([(1, "x")], "id long, `col-1` string").write.partitionBy("col-1").parquet(base)
    name = next(n for n in Storage(spark, base).names("col-1=x") if n.endswith(".parquet"))
    schema = {"type": "struct", "fields": [{"name": "id", "type": "long", "nullable": True, "metadata": {}}, {"name": "p", "type": "string", "nullable": True, "metadata": {"delta.columnMapping.physicalName": "col-1", "delta.columnMapping.id": 2}}]}
    lines = [{"protocol": {"minReaderVersion": 3, "minWriterVersion": 7}}, {"metaData": {"id": "a", "schemaString": json.dumps(schema), "partitionColumns": ["p"], "configuration": {}}}]
    add = {"path": f"col-1=x/{name}", "partitionValues": {"col-1": "x"}, "size": 1, "modificationTime": 1, "dataChange": True}
    Storage(spark, base).write("_delta_log/00000000000000000000.json", "\n".join(json.dumps(x) for x in [*lines, {"add": add}]))
    assert registry.source("DELTA", spark, base).snapshot().files.first()["part"] == {"p": "x"}
    Storage(spark, base).write("_delta_log/00000000000000000001.json", json.dumps({"add": add | {"deletionVector": {"storageType": "u"}}}))
    with pytest.raises(ReadError, match="deletion vectors"):
        reader.read(spark, "DELTA", base)


def test_hudi_archives(spark, tmp_path):
    base = f"file:{tmp_path}/t"
    t = LakeTable(spark, base)
    for k in range(5):
        t.append(spark.createDataFrame([(k,)], "id long"))
        if k == 3:
            t.delete(F.col("id") == 1)
        ok(sync(spark, SyncConfig("DELTA", base, ["HUDI"], options={"keep": 2, "more": 1})), None if k == 0 else "INCREMENTAL")
    line = Timeline(spark, base)
    assert 2 <= len(line.completed()) <= 3 and line.archived_state() is not None and not line.foreign_archive()
    assert rows_of(reader.read(spark, "HUDI", base)) == [(0,), (2,), (3,), (4,)]


def test_hudi_archived_by_another_writer(spark, tmp_path):
    base = f"file:{tmp_path}/t"
    for k in range(2):
        spark.range(10 * k, 10 * k + 10).write.mode("append").parquet(base)
        ok(sync(spark, SyncConfig("PARQUET", base, ["HUDI"])))
    line = Timeline(spark, base)
    first = line.completed()[0][0]
    for n in line.store.names(".hoodie"):
        if n.startswith(first):
            line.store.delete(f".hoodie/{n}")
    assert line.foreign_archive()
    assert reader.read(spark, "HUDI", base).count() == 20
    assert HudiSource(spark, base).safe_from(0) is False


def test_iceberg_rewrites_only_what_is_touched(spark, tmp_path):
    base = f"file:{tmp_path}/t"
    t = LakeTable(spark, base)
    for k in range(3):
        t.append(spark.createDataFrame([(k, j) for j in range(3)], "id long, v long"))
        ok(sync(spark, SyncConfig("DELTA", base, ["ICEBERG"])))
    ice = IcebergTable(spark, base)
    before = {m["manifest_path"]: m for m in ice.manifests(ice.metadata()["snapshots"][-1])}
    t.delete((F.col("id") == 1) & (F.col("v") == 1))
    ok(sync(spark, SyncConfig("DELTA", base, ["ICEBERG"])), "INCREMENTAL")
    meta = ice.metadata()
    after = ice.manifests(meta["snapshots"][-1])
    assert len([m for m in after if m["manifest_path"] in before]) == 2
    live = ice.entries(meta, meta["snapshots"][-1]).filter("status <> 2").select("sequence", "snapshot").collect()
    assert len({r["sequence"] for r in live}) == 3 and len({r["snapshot"] for r in live}) == 3
    assert rows_of(reader.read(spark, "ICEBERG", base)) == rows_of(t.read())
    # metadata as catalogs name it, gzipped
    v = ice.version()
    ice.store.write(f"metadata/{v + 1:05d}-0a1b.gz.metadata.json", gzip.compress(json.dumps(meta).encode()))
    assert ice.version() == v + 1 and reader.read(spark, "ICEBERG", base).count() == 8
    deletes = [*after, dict(after[0], content=1, added_files_count=1)]
    ice.manifests = lambda snapshot: deletes
    with pytest.raises(ReadError, match="delete files"):
        ice.entries(meta, meta["snapshots"][-1])


def table(base, *names):
    return Table("t", "DELTA", base, T.StructType([T.StructField(n, T.LongType()) for n in names]), version="3", instant=5)


def test_session_catalog(spark, tmp_path):
    catalog, base = C.SparkCatalog(spark), f"file:{tmp_path}/it's"
    t = LakeTable(spark, base)
    t.append(spark.range(4))
    t.delete(F.col("id") == 0)
    name = C.TableName("lw_db", "t_1")
    for fmt in ("DELTA", "ICEBERG", "HUDI"):
        assert C.sync_table(catalog, name, table(base, "id"), fmt) in ("created", "refreshed")
    catalog.drop(name)
    assert C.sync_table(catalog, name, table(base, "id"), "DELTA") == "created"
    assert C.table_format(catalog.get(name)["properties"]) == "DELTA" and catalog.get(name)["location"] == base
    assert rows_of(C.read_entry(spark, catalog, name)) == [(1,), (2,), (3,)]
    assert C.sync_table(catalog, name, table(base, "id", "more"), "DELTA") == "refreshed"
    assert [c["name"] for c in catalog.get(name)["columns"]] == ["id", "more"]
    assert C.sync_table(catalog, name, table(f"file:{tmp_path}/moved", "id"), "DELTA") == "recreated"
    assert catalog.get(name)["location"] == f"file:{tmp_path}/moved"
    spark.sql("DROP DATABASE lw_db CASCADE")


class NoSuchObjectException(Exception):
    pass


class EntityNotFoundException(Exception):
    pass


class FakeGlue:
    def __init__(self):
        self.databases, self.tables, self.parts, self.sizes = set(), {}, {}, []

    def get_database(self, Name):
        if Name not in self.databases:
            raise EntityNotFoundException
        return {}

    def create_database(self, DatabaseInput):
        self.databases.add(DatabaseInput["Name"])

    def get_table(self, DatabaseName, Name):
        if Name not in self.tables:
            raise EntityNotFoundException
        return {"Table": self.tables[Name]}

    def create_table(self, DatabaseName, TableInput):
        self.tables[TableInput["Name"]] = TableInput

    def update_table(self, DatabaseName, TableInput, SkipArchive):
        self.tables[TableInput["Name"]] = TableInput

    def delete_table(self, DatabaseName, Name):
        del self.tables[Name]

    def get_partitions(self, DatabaseName, TableName, NextToken="0"):
        keys, at = sorted(self.parts), int(NextToken)
        page = [{"Values": list(k), "StorageDescriptor": {"Location": self.parts[k]}} for k in keys[at : at + 700]]
        return {"Partitions": page, **({"NextToken": str(at + 700)} if at + 700 < len(keys) else {})}

    def batch_create_partition(self, DatabaseName, TableName, PartitionInputList):
        self.sizes.append(len(PartitionInputList))
        self.parts |= {tuple(p["Values"]): p["StorageDescriptor"]["Location"] for p in PartitionInputList}
        return {}

    def batch_update_partition(self, DatabaseName, TableName, Entries):
        self.parts |= {tuple(e["PartitionValueList"]): e["PartitionInput"]["StorageDescriptor"]["Location"] for e in Entries}
        return {}

    def batch_delete_partition(self, DatabaseName, TableName, PartitionsToDelete):
        if any(p["Values"] == ["bad"] for p in PartitionsToDelete):
            return {"Errors": ["bad"]}
        for p in PartitionsToDelete:
            self.parts.pop(tuple(p["Values"]))
        return {}


class FakeMetastore:
    def __init__(self):
        self.databases, self.tables, self.parts, self.sizes = set(), {}, {}, []

    def get_database(self, name):
        if name not in self.databases:
            raise NoSuchObjectException
        return name

    def create_database(self, db):
        self.databases.add(db["name"])

    def get_table(self, db, name):
        if name not in self.tables:
            raise NoSuchObjectException
        return self.tables[name]

    def create_table(self, t):
        self.tables[t["tableName"]] = t

    def alter_table(self, db, name, t):
        self.tables[name] = t

    def drop_table(self, db, name, delete):
        assert not delete
        del self.tables[name]

    def get_partition_names(self, db, name, limit):
        return sorted("/".join(k) for k in self.parts)

    def get_partitions_by_names(self, db, name, names):
        assert len(names) <= C.BATCH
        return [{"values": n.split("/"), "sd": {"location": self.parts[tuple(n.split("/"))]}} for n in names]

    def add_partitions(self, parts):
        self.sizes.append(len(parts))
        self.parts |= {tuple(p["values"]): p["sd"]["location"] for p in parts}

    def alter_partitions(self, db, name, parts):
        self.parts |= {tuple(p["values"]): p["sd"]["location"] for p in parts}

    def drop_partition(self, db, name, values, delete):
        assert not delete
        if tuple(values) not in self.parts:
            raise RuntimeError("down")
        del self.parts[tuple(values)]


@pytest.mark.parametrize("make", [lambda: (C.GlueCatalog(g := FakeGlue()), g), lambda: (C.MetastoreCatalog(m := FakeMetastore()), m)])
def test_remote_catalogs(spark, make):
    catalog, fake = make()
    name = C.TableName.parse("db.t")
    assert [C.sync_table(catalog, name, table("s3://b/t", *cols), "DELTA") for cols in (("a",), ("b",))] == ["created", "refreshed"]
    assert [c["name"] for c in catalog.get(name)["columns"]] == ["b", "a"] and fake.databases == {"db"}
    assert C.sync_table(catalog, name, table("s3://b/u", "a"), "DELTA") == "recreated" and set(fake.tables) == {"t"}
    storage = spark.range(2500).select(F.col("id").cast("string").alias("key"), F.concat(F.lit("s3://b/u/"), F.col("id")).alias("path"))
    assert C.sync_partitions(spark, catalog, name, storage) == {"ADD": 2500} and fake.sizes == [1000, 1000, 500]
    assert C.sync_partitions(spark, catalog, name, storage) == {}
    assert C.sync_partitions(spark, catalog, name, storage.filter("key <> '7'").withColumn("path", F.when(F.col("key") == "8", "x").otherwise(F.col("path")))) == {"DROP": 1, "UPDATE": 1}
    assert fake.parts[("8",)] == "x" and ("7",) not in fake.parts
    with pytest.raises(CatalogError):
        catalog.change_partitions(name, "DROP", [("bad", None)])


def test_commit_stream_keeps_its_offset(spark, tmp_path):
    from lakeweave.streaming.continuous import CommitStream

    t, mark = LakeTable(spark, f"file:{tmp_path}/t"), f"file:{tmp_path}/mark"
    stream = lambda: CommitStream(spark, "DELTA", t.base, checkpoint=mark)
    t.append(spark.range(2))
    first = stream()
    assert [c.source_id for c in first.poll()] == ["0"]
    assert [c.source_id for c in stream().poll()] == ["0"]  # not followed by another call: handed out again
    t.append(spark.range(2))
    assert [c.source_id for c in first.poll()] == ["1"]
    assert [c.source_id for c in stream().poll()] == ["1"]
    assert first.poll() == [] and stream().poll() == []
