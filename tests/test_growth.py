"""What commits and reads cost doesn't follow the number of partitions that file lists come in."""

from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave import reader
from lakeweave.plans.controller import SyncConfig, sync
from lakeweave.plans.dml import LakeTable
from lakeweave.reader import read_files
from lakeweave.sources.delta import DeltaTarget
from lakeweave.sources.iceberg import IcebergTable
from lakeweave.sources.model import FILES, SyncState, Table


def test_a_commit_works_out_its_files_in_their_own_tasks(spark, tmp_path):
    base = f"file:{tmp_path}/t"

    def where(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"path": [f"{base}/{TaskContext.get().partitionId()}-{n}.parquet" for n in batch.column(0).to_pylist()]})

    found = spark.range(0, 6, 1, 6).mapInArrow(where, "path string")
    files = found.select("path", F.lit("PARQUET").alias("format"), F.lit(1).cast("long").alias("size"), F.lit(1).cast("long").alias("rows"), F.lit(1).cast("long").alias("mtime"), F.create_map().cast("map<string,string>").alias("part"), F.lit("{}").alias("stats"))
    target, table = DeltaTarget(spark, base), Table("t", "DELTA", base, T.StructType([T.StructField("v", T.LongType())]))
    target.commit(table, SyncState(0), files, spark.createDataFrame([], FILES), "APPEND", -1)
    names = [r["path"].rsplit("/", 1)[1].split("-") for r in target.live().collect()]
    assert sorted(n for _, n in names) == [f"{n}.parquet" for n in range(6)] and len({task for task, _ in names}) == 6
    kinds = [line[2 : line.index('"', 2)] for line in (tmp_path / "t/_delta_log/00000000000000000000.json").read_text().splitlines()]
    assert sorted(kinds[:3]) == ["commitInfo", "metaData", "protocol"] and kinds[3:] == ["add"] * 6


def jobs(spark, group, act):
    """How many jobs ``act`` starts."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        act()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_scan_lists_its_files_in_one_job(spark, tmp_path):
    t = LakeTable(spark, f"file:{tmp_path}/t")
    t.append(spark.range(40))
    files = t.source.snapshot().files.repartition(40).persist()
    assert jobs(spark, "listing", lambda: read_files(spark, t.source.table_at(), files)) < 10
    files.unpersist()


def test_manifests_hold_what_many_tasks_added(spark, tmp_path):
    base = f"file:{tmp_path}/t"
    spark.range(0, 12, 1, 12).write.parquet(base)
    assert all(r.status == "SUCCESS" for r in sync(spark, SyncConfig("PARQUET", base, ["ICEBERG"])).values())
    ice = IcebergTable(spark, base)
    assert [m["added_files_count"] for m in ice.manifests(ice.metadata()["snapshots"][-1])] == [12]
    assert sorted(r["id"] for r in reader.read(spark, "ICEBERG", base).collect()) == list(range(12))


def test_rows_that_look_for_their_files_carry_no_path(spark, tmp_path):
    t = LakeTable(spark, f"file:{tmp_path}/a b%20c", partition_by=("p",))
    t.append(spark.range(40).selectExpr("id", "concat('x y', id % 2) AS p"))
    kinds = []
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        hit = t._hit(0, lambda rows: (kinds.append(rows.schema["_lw_from"].dataType), rows.filter("id % 4 = 1"))[1])
        assert kinds == [T.LongType()] and {r["part"]["p"] for r in hit.collect()} == {"x y1"}
        assert jobs(spark, "delete", lambda: t.delete(F.col("id") % 4 == 1)) < 40
        t.upsert(spark.createDataFrame([(2, "x y0"), (50, "x y1")], "id long, p string"), ["id"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(r["id"] for r in t.read().collect()) == sorted([n for n in range(40) if n % 4 != 1] + [50])
