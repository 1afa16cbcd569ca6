"""Formats against each other: what is written, synced and read again is the source's rows."""

import json
import struct
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave import reader
from lakeweave.functions import bounds, partition_spec
from lakeweave.functions import instants as I
from lakeweave.functions import paths as P
from lakeweave.functions import schema as S
from lakeweave.functions import transforms as X
from lakeweave.plans import catalog as C
from lakeweave.plans.controller import SyncConfig, choose_modes, sync, sync_changes, sync_snapshot
from lakeweave.plans.dml import LakeTable
from lakeweave.sources import avro_codec, registry
from lakeweave.sources.hudi import from_instant, key_generator, live_files, slice_changes, to_instant
from lakeweave.sources.iceberg import from_ordinal, schema_changes, spec_in, spec_out, to_ordinal
from lakeweave.sources.model import Change, PartitionError, Snapshot, StateError, SyncState, Table
from lakeweave.sources.paimon import PaimonSource


def sample(spark, lo, hi):
    return spark.range(lo, hi).select(F.col("id"), F.concat(F.lit("n"), F.col("id")).alias("name"), (F.col("id") % 3).cast("string").alias("level"), F.when(F.col("id") % 5 != 0, F.col("id") * 1.5).alias("x"))


def same(a, b):
    a = a.select(*b.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("by", [(), ("level",)])
def test_sync_all_formats_incrementally(spark, tmp_path, by):
    base = f"file:{tmp_path}/t"
    (sample(spark, 0, 50).write.partitionBy(*by) if by else sample(spark, 0, 50).write).parquet(base)
    config = SyncConfig("PARQUET", base, ["DELTA", "ICEBERG", "HUDI", "PARQUET"], partition_spec="level:VALUE" if by else None)
    first = sync(spark, config)
    assert {k: (r.mode, r.status) for k, r in first.items()} == {f: ("FULL", "SUCCESS") for f in ("DELTA", "ICEBERG", "HUDI")}, first
    versions = {f: registry.source(f, spark, base).current_table().version for f in first}
    time.sleep(1.1)
    (sample(spark, 50, 100).write.mode("append").partitionBy(*by) if by else sample(spark, 50, 100).write.mode("append")).parquet(base)
    second = sync(spark, config)
    assert {r.mode for r in second.values()} == {"INCREMENTAL"} and {r.status for r in second.values()} == {"SUCCESS"}, second
    for f in first:
        assert same(reader.read(spark, f, base), sample(spark, 0, 100)), f
        assert same(reader.read(spark, f, base, version=versions[f]), sample(spark, 0, 50)), f
        before = registry.source(f, spark, base).current_table().version
        sync(spark, config)
        assert registry.source(f, spark, base).current_table().version == before  # nothing to do, nothing committed


def test_delta_dml_to_other_formats(spark, tmp_path):
    base = f"file:{tmp_path}/t"
    t = LakeTable(spark, base, "t", ("level",))
    t.append(sample(spark, 0, 30))
    config = SyncConfig("DELTA", base, ["ICEBERG", "HUDI"])
    sync(spark, config)
    t.upsert(sample(spark, 20, 40).withColumn("name", F.lit("new")), ["id"])
    t.delete(F.col("id") < 5)
    t.drop_partition(level="1")
    t.add_columns(T.StructField("more", T.LongType()))
    t.optimize(["id"])
    assert {r.status for r in sync(spark, config).values()} == {"SUCCESS"}
    want = sample(spark, 0, 20).unionByName(sample(spark, 20, 40).withColumn("name", F.lit("new"))).filter("id >= 5 AND level <> '1'").withColumn("more", F.lit(None).cast("long"))
    for f in ("DELTA", "ICEBERG", "HUDI"):
        assert same(reader.read(spark, f, base), want), f
    source = registry.source("DELTA", spark, base)
    for v in source.backlog(0)[0][1:]:  # each commit's diff is the difference of the snapshots around it
        a, b = (source.snapshot(str(k)).files.select("path") for k in (int(v) - 1, int(v)))
        change = source.change(v)
        assert same(change.added.select("path"), b.subtract(a)) and same(change.removed.select("path"), a.subtract(b))
    assert registry.target("ICEBERG", spark, base).target_version_of(source.current_table().version) is not None


def test_delta_checkpoint_is_read(spark, tmp_path):
    base = f"file:{tmp_path}/t"
    t = LakeTable(spark, base)
    t.target.checkpoint_every = 2
    for k in range(4):
        t.append(sample(spark, 10 * k, 10 * k + 10))
    assert t.source.log.checkpoint()[0] == 2
    t.source.log.store.delete("_delta_log/00000000000000000000.json")
    assert same(t.read(), sample(spark, 0, 40))


def test_iceberg_rolls_back_when_manifest_lists_are_lost(spark, tmp_path):
    base = f"file:{tmp_path}/t"
    t = LakeTable(spark, base)
    config = SyncConfig("DELTA", base, ["ICEBERG"])
    for k in range(2):
        t.append(sample(spark, 10 * k, 10 * k + 10))
        sync(spark, config)
    target = registry.target("ICEBERG", spark, base)
    lost = target.ice.metadata()["snapshots"][-1]["manifest-list"].rsplit("/", 1)[1]
    target.ice.store.delete(f"metadata/{lost}")
    result = sync(spark, config)["ICEBERG"]
    assert (result.mode, result.status) == ("FULL", "SUCCESS")
    assert same(reader.read(spark, "ICEBERG", base), sample(spark, 0, 20))


def test_iceberg_expires_snapshots_but_no_data(spark, tmp_path):
    base = f"file:{tmp_path}/t"
    t = LakeTable(spark, base)
    for k in range(2):
        t.append(sample(spark, 10 * k, 10 * k + 10))
        sync(spark, SyncConfig("DELTA", base, ["ICEBERG"], options={"retention_hours": 0}))
    assert len(registry.target("ICEBERG", spark, base).ice.metadata()["snapshots"]) == 1
    assert same(reader.read(spark, "ICEBERG", base), sample(spark, 0, 20))


class FakeTarget:
    def __init__(self, fail=False):
        self.fail, self.got = fail, []

    def sync_snapshot(self, table, state, files):
        if self.fail:
            raise RuntimeError("broken")
        self.got.append(("all", table.instant))

    def sync_change(self, table, state, added, removed):
        if self.fail:
            raise RuntimeError("broken")
        self.got.append((table.instant, state.pending))


def a_table(instant):
    return Table("t", "X", "/t", T.StructType(), instant=instant)


def test_failing_target_does_not_stop_others():
    good, bad = FakeTarget(), FakeTarget(True)
    out = sync_snapshot({"A": good, "B": bad}, Snapshot(a_table(5), None))
    assert out["A"].status == "SUCCESS" and out["B"].status == "ERROR" and good.got == [("all", 5)]
    states = {"A": SyncState(2, (1,)), "B": SyncState(0)}
    out = sync_changes({"A": good, "B": bad}, states, [Change(a_table(k), None, None) for k in (1, 2, 3)], (9,))
    assert good.got[1:] == [(1, (9,)), (3, (9,))]  # 1 was pending, 2 is known
    assert len(out["B"]) == 1


def test_mode_falls_back_to_full():
    source = type("S", (), {"safe_from": lambda self, t: t >= 10})()
    states = {"A": SyncState(20), "B": SyncState(20, (5,)), "C": None}
    assert choose_modes(source, states, "INCREMENTAL") == {"A": "INCREMENTAL", "B": "FULL", "C": "FULL"}
    assert choose_modes(source, states, "FULL")["A"] == "FULL"


def test_sync_state_json():
    golden = '{"lastInstantSynced":"2020-07-04T10:15:30Z","instantsToConsiderForNextSync":[],"version":0,"sourceTableFormat":"TEST","sourceIdentifier":"0"}'
    state = SyncState.from_json(golden)
    assert state.to_json() == golden
    assert SyncState.from_json('{"lastInstantSynced":"2020-07-04T10:15:30Z","version":0}').source_id is None
    assert SyncState.from_json("") is None
    for bad in ('{"version":1,"lastInstantSynced":"2020-07-04T10:15:30Z"}', '{"version":0}'):
        with pytest.raises(StateError):
            SyncState.from_json(bad)


def test_hudi_instants():
    assert from_instant("20230120044331843") == 1674189811843
    assert from_instant("20230120044331") == 1674189811999
    assert from_instant("19700101000000") == 999
    assert from_instant("2023012004433184399") == 1674189811843
    assert to_instant(1674189811843) == "20230120044331843"


def test_hudi_slices_replaces_and_rollbacks(spark):
    events = spark.createDataFrame(
        [("1", "add", "p", "a", "f:/a1", 1, 1), ("1", "add", "p", "b", "f:/b1", 1, 1), ("2", "add", "p", "a", "f:/a2", 1, 1), ("3", "replace", "p", "b", None, None, None), ("3", "add", "p", "c", "f:/c3", 1, 1), ("4", "delete", "p", None, "f:/c3", None, None)],
        "instant string, op string, partition string, file_id string, path string, rows long, size long",
    ).withColumn("stats", F.lit(None).cast("string"))
    assert {r["path"] for r in live_files(events).collect()} == {"f:/a2"}
    got = {k: {(r["op"], r["path"]) for r in slice_changes(events, k).collect()} for k in "1234"}
    assert got == {"1": {("add", "f:/a1"), ("add", "f:/b1")}, "2": {("add", "f:/a2"), ("remove", "f:/a1")}, "3": {("add", "f:/c3"), ("remove", "f:/b1")}, "4": {("remove", "f:/c3")}}


def test_hudi_key_generators():
    F_ = partition_spec.PartitionField
    assert key_generator([], []) == "NON_PARTITION"
    assert key_generator([F_("d", "DAY")], ["k"]) == "TIMESTAMP"
    assert key_generator([F_("d", "DAY"), F_("x")], ["k"]) == "CUSTOM"
    with pytest.raises(PartitionError):
        key_generator([F_("d", "BUCKET")], [])


def test_relative_paths(spark):
    cases = [("file:///absolute/path/to/file.parquet", "file:/absolute/path", "to/file.parquet"), ("s3a://absolute/path/to/f", "s3://absolute/path", "to/f"), ("/relative/path", "s3://b/x", "relative/path")]
    got = spark.createDataFrame(cases, "path string, base string, want string").select(P.relative(F.col("path"), F.col("base")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_instant_column(spark):
    rows = spark.createDataFrame([("20230120044331843",), ("20230120044331",), ("x",)], "t string").select(F.unix_millis(I.parse_instant(F.col("t")))).collect()
    assert [r[0] for r in rows] == [1674189811843, 1674189811999, None]


def test_path_values(spark):
    def parse(path, spec):
        return tuple(spark.createDataFrame([(path,)], "p string").select(*partition_spec.path_values(F.col("p"), partition_spec.parse_spec(spec))).first())

    assert parse("level=INFO", "level:VALUE") == parse("INFO", "level:VALUE") == ("INFO",)
    assert parse("foo/bar", "level:VALUE") == ("foo/bar",)
    assert parse("2020/10/02/INFO", "t:DAY:yyyy/MM/dd,level:VALUE") == ("2020/10/02", "INFO")
    assert parse("t=__HIVE_DEFAULT_PARTITION__/level=A", "t:DAY:yyyy-MM-dd,level:VALUE") == (None, "A")


def test_generated_columns():
    fold = partition_spec.fold_generated
    assert [(f.path, f.transform, f.names) for f in fold([("y", "YEAR(birth)"), ("m", "MONTH(birth)"), ("level", None)])] == [("birth", "MONTH", ("y", "m")), ("level", "VALUE", ("level",))]
    for t in ("YEAR", "MONTH", "DAY", "HOUR", "BUCKET"):
        field = fold([("c", X.generated_expression(t, "BIRTHYEAR", 7))])[0]
        assert (field.path, field.transform) == ("BIRTHYEAR", t)
    for bad in ([("m", "MONTH(b)"), ("h", "HOUR(b)")], [("d", "DATE_FORMAT(b, 'MM')")]):
        with pytest.raises(ValueError):
            fold(bad)


def test_bucket_vector(spark):
    assert spark.range(1).select(X.bucket(F.lit("abc"), 10)).first()[0] == 6


@given(st.integers(-60_000_000_000_000, 60_000_000_000_000))
@settings(max_examples=200, deadline=None)
def test_ordinals_round_trip(ms):
    for t in ("year", "month", "day", "hour"):
        start = from_ordinal(t, to_ordinal(t, str(ms)))
        assert int(start) <= ms and to_ordinal(t, start) == to_ordinal(t, str(ms))
    assert to_ordinal("day", None) is None and from_ordinal("year", None) is None


@given(st.integers(-(10**17), 10**17), st.integers(0, 9), st.text(max_size=20), st.floats(allow_nan=False, allow_infinity=False))
@settings(max_examples=200, deadline=None)
def test_bounds_round_trip(n, scale, text, x):
    from decimal import Decimal

    kind = f"decimal(38, {scale})"
    assert Decimal(bounds.decode(kind, bounds.encode(kind, str(Decimal(n).scaleb(-scale))))) == Decimal(n).scaleb(-scale)
    assert bounds.decode("long", bounds.encode("long", n)) == n and bounds.decode("string", bounds.encode("string", text)) == text and bounds.decode("double", bounds.encode("double", x)) == x
    assert bounds.decode("timestamp", bounds.encode("timestamp", "2020-01-02T03:04:05.000006")) == "2020-01-02T03:04:05.000006"


AVRO = {"type": "record", "name": "r", "fields": [{"name": "a", "type": ["null", "long"]}, {"name": "b", "type": {"type": "array", "items": "string"}}, {"name": "c", "type": {"type": "map", "values": "double"}}, {"name": "d", "type": {"type": "fixed", "name": "f", "size": 2}}, {"name": "e", "type": "f"}]}


@given(st.lists(st.fixed_dictionaries({"a": st.none() | st.integers(-(2**63), 2**63 - 1), "b": st.lists(st.text(max_size=5), max_size=3), "c": st.dictionaries(st.text(max_size=3), st.floats(allow_nan=False), max_size=2), "d": st.binary(min_size=2, max_size=2), "e": st.binary(min_size=2, max_size=2)}), max_size=5))
@settings(max_examples=100, deadline=None)
def test_avro_round_trip(records):
    meta, back = avro_codec.read_file(avro_codec.write_file(AVRO, records, {"k": "v"}, block=2))
    assert back == records and meta["k"] == "v"


NESTED = T.StructType([T.StructField("id", T.LongType(), False, {"field_id": 7}), T.StructField("d", T.DecimalType(20, 2)), T.StructField("u", T.BinaryType(), True, {"kind": "uuid", "size": 16}), T.StructField("l", T.ArrayType(T.StructType([T.StructField("a", T.IntegerType())]))), T.StructField("m", T.MapType(T.StringType(), T.DateType())), T.StructField("t", T.TimestampType()), T.StructField("n", T.TimestampNTZType())])


def test_schema_round_trips():
    bare = lambda s: [(p, f.dataType.typeName(), f.nullable) for p, f in S.flatten(s)]
    for forth, back in ((S.to_iceberg, S.from_iceberg), (S.to_avro, S.from_avro), (S.to_arrow, S.from_arrow), (S.to_delta, S.from_delta)):
        assert bare(back(forth(NESTED))) == bare(NESTED), forth
    ids = dict(S.iceberg_ids(S.to_iceberg(NESTED)))
    assert ids["id"] == 7 and ids["d"] == 8 and len(set(ids.values())) == len(ids)
    grown = T.StructType([*NESTED.fields[1:], T.StructField("x", T.LongType())])
    again = dict(S.iceberg_ids(S.to_iceberg(grown, known=ids)))
    assert all(again[p] == ids[p] for p in again if p in ids)
    assert S.hive_type(NESTED["m"].dataType) == "map<string,date>"
    with pytest.raises(S.UnsupportedType):
        S.hive_type(T.BinaryType(), {"kind": "uuid"})
    first, last = S.track_ids(NESTED)
    second, _ = S.track_ids(grown, first, last)
    assert second["d"] == first["d"] and second["x"] == last + 1
    assert S.to_iceberg(NESTED, identifiers=["id"])["identifier-field-ids"] == [7]
    assert "identifier-field-ids" not in S.to_iceberg(NESTED, identifiers=["d"])


def test_schema_changes_keep_all_updates():
    old = S.to_iceberg(T.StructType([T.StructField("a", T.IntegerType(), False), T.StructField("b", T.StringType()), T.StructField("c", T.StringType())]))
    new = S.to_iceberg(T.StructType([T.StructField("a", T.LongType(), True, {"comment": "x"})]))
    assert schema_changes(old, new) == [("a", "doc"), ("a", "optional"), ("a", "type"), ("b", "drop"), ("c", "drop")]


def test_iceberg_specs():
    schema = S.to_iceberg(T.StructType([T.StructField("t", T.TimestampType()), T.StructField("s", T.StringType())]))
    fields = [partition_spec.PartitionField("t", "DAY"), partition_spec.PartitionField("s")]
    assert [(f.path, f.transform) for f in spec_in(spec_out(fields, schema), schema)] == [("t", "DAY"), ("s", "VALUE")]
    with pytest.raises(PartitionError):
        spec_out([partition_spec.PartitionField("s", "BUCKET", buckets=4)], schema)
    assert spec_in({"fields": [{"name": "v", "transform": "void", "source-id": 1}, {"name": "b", "transform": "bucket[10]", "source-id": 2}]}, schema)[0].buckets == 10


def binary_row(*values):
    """A serialized binary row of ints and short strings."""
    head = (len(values) + 63 + 8) // 64 * 8
    bits, cells = bytearray(head), b""
    for k, v in enumerate(values):
        if v is None:
            bits[(k + 8) // 8] |= 1 << ((k + 8) % 8)
            cells += bytes(8)
        elif isinstance(v, str):
            cells += v.encode().ljust(7, b"\0") + bytes([0x80 | len(v)])
        else:
            cells += struct.pack("<i", v) + bytes(4)
    return struct.pack(">i", len(values)) + bytes(bits) + cells


def test_paimon_source(spark, tmp_path):
    base = tmp_path / "t"
    for d in ("schema", "snapshot", "manifest", "level=A/bucket-0"):
        (base / d).mkdir(parents=True)
    fields = [{"id": 0, "name": "id", "type": "INT NOT NULL"}, {"id": 1, "name": "name", "type": "VARCHAR(10)"}, {"id": 2, "name": "level", "type": "STRING"}]
    (base / "schema/schema-0").write_text(json.dumps({"id": 0, "fields": fields, "partitionKeys": ["level"], "primaryKeys": [], "options": {}}))
    spark.createDataFrame([(1, "x", "A"), (2, "y", "A")], "id int, name string, level string").coalesce(1).write.parquet(f"file:{tmp_path}/out")
    part = next((tmp_path / "out").glob("part-*.parquet"))
    part.rename(base / "level=A/bucket-0/data-0.parquet")
    stats = {"type": "record", "name": "s", "fields": [{"name": "_MIN_VALUES", "type": "bytes"}, {"name": "_MAX_VALUES", "type": "bytes"}, {"name": "_NULL_COUNTS", "type": {"type": "array", "items": ["null", "long"]}}]}
    file = {"type": "record", "name": "f", "fields": [{"name": "_FILE_NAME", "type": "string"}, {"name": "_FILE_SIZE", "type": "long"}, {"name": "_ROW_COUNT", "type": "long"}, {"name": "_LEVEL", "type": "int"}, {"name": "_VALUE_STATS", "type": stats}]}
    entry = {"type": "record", "name": "e", "fields": [{"name": "_KIND", "type": "int"}, {"name": "_PARTITION", "type": "bytes"}, {"name": "_BUCKET", "type": "int"}, {"name": "_FILE", "type": file}]}
    data = {"_FILE_NAME": "data-0.parquet", "_FILE_SIZE": 9, "_ROW_COUNT": 2, "_LEVEL": 0, "_VALUE_STATS": {"_MIN_VALUES": binary_row(1, "x", "A"), "_MAX_VALUES": binary_row(2, "y", "A"), "_NULL_COUNTS": [0, 0, 0]}}
    gone = data | {"_FILE_NAME": "data-9.parquet"}
    rows = [{"_KIND": k, "_PARTITION": binary_row("A"), "_BUCKET": 0, "_FILE": f} for k, f in ((0, data), (0, gone), (1, gone))]
    (base / "manifest/m0").write_bytes(avro_codec.write_file(entry, rows))
    (base / "manifest/l0").write_bytes(avro_codec.write_file({"type": "record", "name": "l", "fields": [{"name": "_FILE_NAME", "type": "string"}]}, [{"_FILE_NAME": "m0"}]))
    (base / "snapshot/snapshot-1").write_text(json.dumps({"id": 1, "schemaId": 0, "timeMillis": 1700000000000, "baseManifestList": None, "deltaManifestList": "l0"}))
    uri = f"file:{base}"
    files = PaimonSource(spark, uri).snapshot().files.collect()
    assert [f["path"].rsplit("/", 1)[1] for f in files] == ["data-0.parquet"]
    assert json.loads(files[0]["stats"])["maxValues"] == {"id": 2, "name": "y", "level": "A"} and files[0]["part"] == {"level": "A"}
    out = sync(spark, SyncConfig("PAIMON", uri, ["DELTA", "ICEBERG", "HUDI"]))
    assert {r.status for r in out.values()} == {"SUCCESS"}, out
    for f in out:
        assert {tuple(r) for r in reader.read(spark, f, uri).select("id", "name", "level").collect()} == {(1, "x", "A"), (2, "y", "A")}
    source = PaimonSource(spark, uri)
    assert source.safe_from(1700000000000) and not source.safe_from(1600000000000) and not source.safe_from(99999999999999)


def test_catalogs(spark):
    name, catalog = C.TableName.parse("cat.db.t"), C.MemoryCatalog()
    t = Table("t", "HUDI", "s3://b/t", T.StructType([T.StructField("a", T.LongType()), T.StructField("p", T.StringType())]), (partition_spec.PartitionField("p"),), version="1")
    assert C.sync_table(catalog, name, t, "HUDI") == "created" and C.sync_table(catalog, name, t, "HUDI") == "refreshed"
    moved = Table("t", "HUDI", "s3a://b/t/", t.schema, t.partitions)
    assert C.sync_table(catalog, name, moved, "HUDI") == "refreshed"
    assert C.sync_table(catalog, name, Table("t", "HUDI", "s3://c/t", t.schema, t.partitions), "HUDI") == "recreated"
    storage = spark.range(2500).select(F.col("id").cast("string").alias("key"), F.concat(F.lit("/t/"), F.col("id")).alias("path"))
    assert C.sync_partitions(spark, catalog, name, storage) == {"ADD": 2500}
    assert [n for _, n in catalog.requests] == [1000, 1000, 500]
    assert C.sync_partitions(spark, catalog, name, storage.filter("key <> '7'").withColumn("path", F.when(F.col("key") == "8", "/x").otherwise(F.col("path")))) == {"DROP": 1, "UPDATE": 1}
    assert C.sync_catalogs({"good": catalog, "bad": None}, name, t, "HUDI")["bad"].startswith("ERROR")
    assert C.data_path("ICEBERG", "/t", {}) == "/t/data" and C.table_format({"spark.sql.sources.provider": "delta"}) == "DELTA"


def test_hooks(spark, tmp_path):
    from lakeweave.plans import hooks

    options = {"hoodie.datasource.write.partitionpath.field": "a:SIMPLE,t:TIMESTAMP", "hoodie.keygen.timebased.output.dateformat": "yyyy/MM"}
    assert hooks.spec_from_write_config(options) == "a:VALUE,t:MONTH:yyyy/MM" and hooks.spec_from_write_config({}) == ""
    base = f"file:{tmp_path}/t"
    LakeTable(spark, base).append(sample(spark, 0, 10))
    catalog = C.MemoryCatalog()
    out = hooks.sync_across_catalogs(spark, SyncConfig("DELTA", base, ["HUDI"]), {"HUDI": {"mem": catalog}, "DELTA": {"mem": catalog}}, "db.t")
    assert out["HUDI"].catalogs == {"mem": "created"} and out["DELTA"].catalogs == {"mem": "refreshed"}
    assert hooks.validate(spark, "DELTA", base, ["HUDI"]) == {"HUDI": {"missing": 0, "extra": 0, "rows_agree": True}}
    again = hooks.after_commit(spark, base, ["ICEBERG"], {})
    assert again["ICEBERG"].status == "SUCCESS" and same(reader.read(spark, "ICEBERG", base), sample(spark, 0, 10))


def test_cli_and_service(spark, tmp_path):
    from lakeweave.plans import cli, service
    from lakeweave.sources.model import ConfigError
    from lakeweave.streaming import continuous

    base = f"file:{tmp_path}/t"
    LakeTable(spark, base).append(sample(spark, 0, 10))
    config = tmp_path / "c.yaml"
    config.write_text(f"sourceFormat: DELTA\ntargetFormats: [ICEBERG]\ndatasets:\n  - tableBasePath: {base}\n    tableName: t\n  - tableBasePath: file:{tmp_path}/none\n    tableName: n\n")
    seen = []
    continuous.run(spark, lambda: cli.load(str(config)), 0.1, 2, lambda b, r: seen.append((b, [x.status for x in r.values()])))
    assert [s for b, s in seen if b == base] == [["SUCCESS"]] * 2 and ["ERROR"] in [s for b, s in seen if b != base]
    (tmp_path / "bad.yaml").write_text("sourceFormat: DELTA\n")
    with pytest.raises(ConfigError):
        cli.load(str(tmp_path / "bad.yaml"))
    answer = service.convert(spark, {"sourceFormat": "DELTA", "sourceTablePath": base, "targetFormats": ["ICEBERG"]})
    assert [f["name"] for f in json.loads(answer["convertedTables"][0]["targetSchema"])["fields"]] == ["id", "name", "level", "x"]
    stream = continuous.CommitStream(spark, "DELTA", base)
    assert len(stream.poll()) == 1 and stream.poll() == []
