"""Iceberg tables (format 2; tables with row deletes are refused): metadata JSON, manifest lists and manifests.

Table metadata is one small file on the driver. Manifests are read by one task each
and written by the tasks that hold the files, so file lists stay distributed.
"""

from __future__ import annotations

import gzip
import json
import re
import time
import uuid
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.functions import bounds as B
from lakeweave.functions import paths as P
from lakeweave.functions import schema as S
from lakeweave.functions.partition_spec import PartitionField
from lakeweave.operators import files as ops

from . import avro_codec
from .footers import nest, unnest
from .model import FILES, STATE_KEY, Change, Conflict, ReadError, Snapshot, SyncState, Table, PartitionError
from .storage import Storage, open_uri

META = "metadata"
#: Added files that one manifest holds; a task writes it, and a task reads it.
MANIFEST_FILES = 5_000
_UNIT = {"year": "YEAR", "month": "MONTH", "day": "DAY", "hour": "HOUR", "identity": "VALUE"}
_KV = lambda v, a, b: {"type": "array", "items": {"type": "record", "name": f"k{a}_v{b}", "fields": [{"name": "key", "type": "int", "field-id": a}, {"name": "value", "type": v, "field-id": b}]}, "logicalType": "map"}

MANIFEST_LIST = {
    "type": "record",
    "name": "manifest_file",
    "fields": [
        {"name": n, "type": t, "field-id": i}
        for n, t, i in (
            ("manifest_path", "string", 500), ("manifest_length", "long", 501), ("partition_spec_id", "int", 502), ("content", "int", 517), ("sequence_number", "long", 515), ("min_sequence_number", "long", 516), ("added_snapshot_id", "long", 503),
            ("added_files_count", "int", 504), ("existing_files_count", "int", 505), ("deleted_files_count", "int", 506), ("added_rows_count", "long", 512), ("existing_rows_count", "long", 513), ("deleted_rows_count", "long", 514),
        )
    ],
}


def manifest_schema(spec: dict, schema: dict) -> dict:
    kinds = {i: t for _, i, t in primitive_fields(schema)}
    part = []
    for f in spec["fields"]:
        kind = kinds.get(f["source-id"], "string")
        avro = {"int": "int", "long": "long", "boolean": "boolean", "float": "float", "double": "double", "date": {"type": "int", "logicalType": "date"}}.get(kind, "string") if f["transform"] == "identity" else "int"
        part.append({"name": f["name"], "type": ["null", avro], "default": None, "field-id": f["field-id"]})
    opt = lambda name, t, i: {"name": name, "type": ["null", t], "default": None, "field-id": i}
    data = [
        {"name": "content", "type": "int", "field-id": 134}, {"name": "file_path", "type": "string", "field-id": 100}, {"name": "file_format", "type": "string", "field-id": 101},
        {"name": "partition", "type": {"type": "record", "name": "r102", "fields": part}, "field-id": 102}, {"name": "record_count", "type": "long", "field-id": 103}, {"name": "file_size_in_bytes", "type": "long", "field-id": 104},
        opt("value_counts", _KV("long", 119, 120), 109), opt("null_value_counts", _KV("long", 121, 122), 110), opt("lower_bounds", _KV("bytes", 126, 127), 125), opt("upper_bounds", _KV("bytes", 129, 130), 128),
    ]
    return {"type": "record", "name": "manifest_entry", "fields": [{"name": "status", "type": "int", "field-id": 0}, opt("snapshot_id", "long", 1), opt("sequence_number", "long", 3), opt("file_sequence_number", "long", 4), {"name": "data_file", "type": {"type": "record", "name": "r2", "fields": data}, "field-id": 2}]}


def primitive_fields(schema: dict, path: str = "") -> Iterator[tuple[str, int, str]]:
    """(path, id, type) of the leaves outside lists and maps."""
    for f in schema["fields"]:
        if isinstance(f["type"], dict):
            if f["type"]["type"] == "struct":
                yield from primitive_fields(f["type"], f"{path}{f['name']}.")
        else:
            yield f"{path}{f['name']}", f["id"], f["type"]


def spec_out(fields, schema: dict, spec_id: int = 0) -> dict:
    """A partition spec; buckets can't be written, since other formats' bucket numbers differ."""
    ids = dict(S.iceberg_ids(schema))
    out = []
    for k, f in enumerate(fields):
        if f.transform == "BUCKET":
            raise PartitionError("bucket partitions can't be written to Iceberg")
        unit = {v: k for k, v in _UNIT.items()}[f.transform]
        name = f.path.replace(".", "_") if unit == "identity" else f"{f.path.replace('.', '_')}_{unit}"
        out.append({"name": name, "transform": unit, "source-id": ids[f.path], "field-id": 1000 + k})
    return {"spec-id": spec_id, "fields": out}


def spec_in(spec: dict, schema: dict) -> list[PartitionField]:
    paths = {i: p for p, i in S.iceberg_ids(schema)}
    out = []
    for f in spec["fields"]:
        t = f["transform"]
        if t == "void":
            continue
        if t.startswith("bucket["):
            out.append(PartitionField(paths[f["source-id"]], "BUCKET", buckets=int(t[7:-1]), names=(f["name"],)))
        elif t in _UNIT:
            out.append(PartitionField(paths[f["source-id"]], _UNIT[t], names=(f["name"],)))
        else:
            raise PartitionError(f"partition transform {t} is not supported")
    return out


def evolve(old: dict | None, schema: T.StructType, record_keys) -> dict:
    """The next schema: known paths keep their ids, dropped ones go, all changes in one step."""
    known = dict(S.iceberg_ids(old)) if old else None
    return S.to_iceberg(schema, old["schema-id"] + 1 if old else 0, list(record_keys), known)


def schema_changes(old: dict, new: dict) -> list[tuple[str, str]]:
    """(path, change) between two schemas: add, drop, type, optional, doc; several may hit one field."""
    def leaves(s: dict, path: str = ""):
        for f in s["fields"]:
            t = f["type"]
            yield f"{path}{f['name']}", f, t["type"] if isinstance(t, dict) else t
            if isinstance(t, dict) and t["type"] == "struct":
                yield from leaves(t, f"{path}{f['name']}.")

    a, b = {p: (f, t) for p, f, t in leaves(old)}, {p: (f, t) for p, f, t in leaves(new)}
    out = [(p, "drop") for p in a if p not in b] + [(p, "add") for p in b if p not in a]
    for p in a.keys() & b.keys():
        (f, t), (g, u) = a[p], b[p]
        out += [(p, c) for c, d in (("type", t != u), ("optional", f["required"] != g["required"]), ("doc", f.get("doc") != g.get("doc"))) if d]
    return sorted(out)


def to_ordinal(transform: str, millis: str | None):
    if millis is None:
        return None
    ms = int(millis)
    days = ms // 86_400_000
    if transform == "day":
        return days
    if transform == "hour":
        return ms // 3_600_000
    d = datetime.fromordinal(719163 + days)
    return d.year - 1970 if transform == "year" else 12 * (d.year - 1970) + d.month - 1


def from_ordinal(transform: str, n: int | None) -> str | None:
    if n is None:
        return None
    if transform in ("day", "hour"):
        return str(n * (86_400_000 if transform == "day" else 3_600_000))
    year, month = (1970 + n, 1) if transform == "year" else (1970 + n // 12, n % 12 + 1)
    return str((datetime(year, month, 1).toordinal() - 719163) * 86_400_000)


class IcebergTable:
    """A table's metadata and the files of its snapshots."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base, self.store = spark, base.rstrip("/"), Storage(spark, base)

    def versions(self) -> dict[int, str]:
        """Metadata files by version: ``vN`` of file systems, ``NNNNN-<uuid>`` of catalogs, plain or gzipped."""
        found: dict[int, str] = {}
        for n in self.store.names(META):
            if m := re.fullmatch(r"(?:v(\d+)|(\d+)-[^/]*?)(?:\.gz\.metadata\.json|\.metadata\.json(?:\.gz)?)", n):
                found[int(m[1] or m[2])] = n
        return found

    def version(self) -> int:
        return max(self.versions(), default=0)

    def exists(self) -> bool:
        return bool(self.versions())

    def metadata(self) -> dict:
        found = self.versions()
        if not found:
            raise ReadError(f"{self.base} has no Iceberg metadata")
        data = self.store.read(f"{META}/{found[max(found)]}")
        return json.loads(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)

    def write_metadata(self, meta: dict, version: int) -> None:
        meta["last-updated-ms"] = int(time.time() * 1000)
        try:
            self.store.write(f"{META}/v{version}.metadata.json", json.dumps(meta))
        except FileExistsError as e:
            raise Conflict(f"metadata version {version} was written by another writer") from e
        self.store.write(f"{META}/version-hint.text", str(version), overwrite=True)

    def manifests(self, snapshot: dict) -> list[dict]:
        store, path = open_uri(snapshot["manifest-list"])
        with store.open_input_file(path) as f:
            return avro_codec.read_file(f.read())[1]

    def entries(self, meta: dict, snapshot: dict, added_by: int | None = None) -> DataFrame:
        """The files of a snapshot's manifests with status, snapshot, sequence, manifest and spec; one task reads one manifest."""
        schema = next(s for s in meta["schemas"] if s["schema-id"] == meta["current-schema-id"])
        specs = {s["spec-id"]: s["fields"] for s in meta["partition-specs"]}
        paths = {i: p for p, i in S.iceberg_ids(schema)}
        kinds = {i: (p, t) for p, i, t in primitive_fields(schema)}
        listed = self.manifests(snapshot)
        if any(m["content"] == 1 and m["added_files_count"] + m["existing_files_count"] > 0 for m in listed):
            raise ReadError(f"{self.base} has deleted rows in delete files, which aren't applied here")
        rows = [(m["manifest_path"], m["partition_spec_id"], m["sequence_number"], m["added_snapshot_id"]) for m in listed if m["content"] == 0 and (added_by is None or m["added_snapshot_id"] == added_by)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path, spec_id, sequence, added in zip(*(c.to_pylist() for c in batch.columns)):
                    store, name = open_uri(path)
                    with store.open_input_file(name) as f:
                        entries = avro_codec.read_file(f.read())[1]
                    out = []
                    for e in entries:
                        d = e["data_file"]
                        part = {}
                        for f in specs[spec_id]:
                            value = d["partition"].get(f["name"])
                            if f["transform"] == "void":
                                continue
                            timed = f["transform"] in ("year", "month", "day", "hour")
                            part[paths.get(f["source-id"], f["name"])] = from_ordinal(f["transform"], value) if timed else None if value is None else plain_value(value, kinds.get(f["source-id"], (None, None))[1])
                        pick = lambda key: {x["key"]: x["value"] for x in d.get(key) or []}
                        low, high, nulls = pick("lower_bounds"), pick("upper_bounds"), pick("null_value_counts")
                        stats = {"numRecords": d["record_count"]}
                        for side, source in (("minValues", low), ("maxValues", high)):
                            stats[side] = nest({kinds[i][0]: B.decode(kinds[i][1], v) for i, v in source.items() if i in kinds})
                        stats["nullCount"] = nest({kinds[i][0]: v for i, v in nulls.items() if i in kinds})
                        of = lambda key, given: given if e.get(key) is None else e[key]  # noqa: B023, E731  # what an entry leaves out is its manifest's
                        out.append((e["status"], of("snapshot_id", added), of("sequence_number", sequence), path, spec_id, d["file_path"], d["file_format"].upper(), d["file_size_in_bytes"], d["record_count"], list(part.items()), json.dumps(stats)))
                    if out:
                        types = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=["status", "snapshot", "sequence", "manifest", "spec", "path", "format", "size", "rows", "part", "stats"])

        columns = "status int, snapshot long, sequence long, manifest string, spec int, path string, format string, size long, rows long, part map<string,string>, stats string"
        if not rows:
            return self.spark.createDataFrame([], columns)
        return self.spark.createDataFrame(rows, "path string, spec int, sequence long, added long").repartition(min(len(rows), 10_000)).mapInArrow(run, columns)


def plain_value(value, kind: str | None) -> str:
    if kind == "date":
        return datetime.fromordinal(719163 + value).date().isoformat()
    return str(value).lower() if isinstance(value, bool) else str(value)


def as_files(entries: DataFrame, mtime: int) -> DataFrame:
    return entries.select(P.canonical(F.col("path")).alias("path"), "format", "size", "rows", F.lit(mtime).cast("long").alias("mtime"), "part", "stats")


class IcebergSource:
    format = "ICEBERG"

    def __init__(self, spark: SparkSession, base: str, name: str = "table", **_):
        self.spark, self.base, self.name, self.ice = spark, base.rstrip("/"), name, IcebergTable(spark, base)

    def _snapshot(self, meta: dict, version=None) -> dict | None:
        i = meta.get("current-snapshot-id", -1) if version is None else int(version)
        return next((s for s in meta.get("snapshots", []) if s["snapshot-id"] == i), None)

    def table_at(self, version=None) -> Table:
        meta = self.ice.metadata()
        s = self._snapshot(meta, version)
        wanted = meta["current-schema-id"] if s is None or version is None else s.get("schema-id", meta["current-schema-id"])
        schema = next(x for x in meta["schemas"] if x["schema-id"] == wanted)
        spec = next(x for x in meta["partition-specs"] if x["spec-id"] == meta["default-spec-id"])
        keys = {i: p for p, i in S.iceberg_ids(schema)}
        return Table(self.name, self.format, self.base, S.from_iceberg(schema), tuple(spec_in(spec, schema)), s["timestamp-ms"] if s else meta["last-updated-ms"], str(s["snapshot-id"]) if s else "0", tuple(keys[i] for i in schema.get("identifier-field-ids", [])), dict(meta.get("properties", {})))

    current_table = table_at

    def snapshot(self, version=None) -> Snapshot:
        meta, table = self.ice.metadata(), self.table_at(version)
        s = self._snapshot(meta, version)
        files = self.spark.createDataFrame([], FILES) if s is None else as_files(self.ice.entries(meta, s).filter("status <> 2"), s["timestamp-ms"])
        return Snapshot(table, files, (), table.version)

    def change(self, version) -> Change:
        meta = self.ice.metadata()
        s = self._snapshot(meta, version)
        mine = self.ice.entries(meta, s, s["snapshot-id"]).filter(F.col("snapshot") == s["snapshot-id"])
        return Change(self.table_at(version), as_files(mine.filter("status = 1"), s["timestamp-ms"]), as_files(mine.filter("status = 2"), s["timestamp-ms"]), str(version))

    def chain(self) -> list[dict]:
        """Snapshots from the current one back as far as they are kept."""
        meta = self.ice.metadata()
        known = {s["snapshot-id"]: s for s in meta.get("snapshots", [])}
        out, s = [], self._snapshot(meta)
        while s is not None:
            out.append(s)
            s = known.get(s.get("parent-snapshot-id"))
        return out

    def backlog(self, since: int, pending=()) -> tuple[list[str], tuple[int, ...]]:
        return [str(s["snapshot-id"]) for s in reversed(self.chain()) if s["timestamp-ms"] > since], ()

    def version_at(self, instant: int) -> str | None:
        return next((str(s["snapshot-id"]) for s in self.chain() if s["timestamp-ms"] <= instant), None)

    def safe_from(self, instant: int) -> bool:
        """The chain of parents reaches a snapshot at or before ``instant`` without a gap."""
        return any(s["timestamp-ms"] <= instant for s in self.chain())

    def identifier(self, version: str) -> str:
        return str(version)


class IcebergTarget:
    format = "ICEBERG"

    def __init__(self, spark: SparkSession, base: str, name: str = "table", retention_hours: int = 168, **_):
        self.spark, self.base, self.name, self.retention_hours = spark, base.rstrip("/"), name, retention_hours
        self.ice = IcebergTable(spark, base)

    def state(self) -> SyncState | None:
        self.roll_back()
        return SyncState.from_json(self.ice.metadata().get("properties", {}).get(STATE_KEY)) if self.ice.exists() else None

    def roll_back(self) -> None:
        """While the current manifest list is missing: back to the parent, without a sync state (the next sync is full)."""
        if not self.ice.exists():
            return
        meta, changed = self.ice.metadata(), False
        known = {s["snapshot-id"]: s for s in meta.get("snapshots", [])}
        while (s := known.get(meta.get("current-snapshot-id"))) is not None:
            store, path = open_uri(s["manifest-list"])
            if store.get_file_info(path).is_file:
                break
            changed = True
            meta["snapshots"] = [x for x in meta["snapshots"] if x["snapshot-id"] != s["snapshot-id"]]
            meta["current-snapshot-id"] = s.get("parent-snapshot-id") if s.get("parent-snapshot-id") in known else -1
        if changed:
            meta["properties"].pop(STATE_KEY, None)
            self.ice.write_metadata(meta, self.ice.version() + 1)

    def _write_manifest(self, files: DataFrame, status: int, meta: dict, schema: dict, spec: dict, snapshot_id: int, sequence: int) -> list[dict]:
        """Writes files as manifests, one for each task; their manifest-list rows.

        Existing files keep the snapshot and the sequence that they came with.
        """
        folder, avro = f"{self.base}/{META}", manifest_schema(spec, schema)
        fields = [(f["name"], f["transform"], next(p for p, i in S.iceberg_ids(schema) if i == f["source-id"]), next((t for _, i, t in primitive_fields(schema) if i == f["source-id"]), "string")) for f in spec["fields"]]
        kinds = {p: (i, t) for p, i, t in primitive_fields(schema)}
        info = {"schema": json.dumps(schema), "partition-spec": json.dumps(spec["fields"]), "partition-spec-id": str(spec["spec-id"]), "format-version": "2", "content": "data"}

        def cast(value, kind):
            if value is None:
                return None
            if kind in ("int", "long"):
                return int(value)
            if kind == "date":
                return datetime.fromisoformat(value).toordinal() - 719163
            return value == "true" if kind == "boolean" else float(value) if kind in ("float", "double") else value

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            entries, rows, least = [], 0, sequence
            for batch in batches:
                for r in batch.to_pylist():
                    part = {x["key"]: x["value"] for x in r["part"] or []}
                    stats = json.loads(r["stats"]) if r["stats"] else {}
                    nulls = unnest(stats.get("nullCount", {}))
                    bounds = {}
                    for side, name in (("lower_bounds", "minValues"), ("upper_bounds", "maxValues")):
                        coded = [(kinds[p][0], B.encode(kinds[p][1], x)) for p, x in unnest(stats.get(name, {})).items() if p in kinds]
                        bounds[side] = [{"key": k, "value": v} for k, v in coded if v is not None]
                    n = r["rows"] if r["rows"] is not None else stats.get("numRecords", 0)
                    counts = [{"key": kinds[p][0], "value": n} for p in nulls if p in kinds]
                    data = {"content": 0, "file_path": r["path"], "file_format": r["format"], "record_count": n, "file_size_in_bytes": r["size"] or 0}
                    data["partition"] = {name: to_ordinal(t, part.get(p)) if t in ("year", "month", "day", "hour") else cast(part.get(p), kind) for name, t, p, kind in fields}
                    data["value_counts"] = counts or None
                    data["null_value_counts"] = [{"key": kinds[p][0], "value": v} for p, v in nulls.items() if p in kinds] or None
                    data |= {side: found or None for side, found in bounds.items()}
                    since = sequence if status == 1 else r["sequence"]
                    entries.append({"status": status, "snapshot_id": r["snapshot"] if status == 0 else snapshot_id, "sequence_number": since, "file_sequence_number": since, "data_file": data})
                    least = min(least, since)
                    rows += n
            if entries:
                data = avro_codec.write_file(avro, entries, info)
                path = f"{folder}/{uuid.uuid4().hex}-m0.avro"
                store, name = open_uri(path)
                store.create_dir(name.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(name) as f:
                    f.write(data)
                yield pa.RecordBatch.from_pydict({"path": [path], "length": [len(data)], "files": [len(entries)], "rows": [rows], "least": [least]})

        parts = files.select("path", "format", "size", "rows", F.map_entries("part").alias("part"), "stats", *([] if status == 1 else ["snapshot", "sequence"]))
        out = []
        for r in parts.mapInArrow(run, "path string, length long, files long, rows long, least long").collect():  # a row for each manifest
            kind = {1: "added", 2: "deleted", 0: "existing"}[status]
            row = {"manifest_path": r["path"], "manifest_length": r["length"], "partition_spec_id": spec["spec-id"], "content": 0, "sequence_number": sequence, "min_sequence_number": r["least"], "added_snapshot_id": snapshot_id}
            row |= {f"{k}_{n}_count": 0 for k in ("added", "existing", "deleted") for n in ("files", "rows")} | {f"{kind}_files_count": r["files"], f"{kind}_rows_count": r["rows"]}
            out.append(row)
        return out

    def commit(self, table: Table, state: SyncState, added: DataFrame, removed: DataFrame | None, mode: str) -> str:
        version, now = self.ice.version(), int(time.time() * 1000)
        meta = self.ice.metadata() if version else {
            "format-version": 2, "table-uuid": str(uuid.uuid4()), "location": self.base, "last-sequence-number": 0, "last-column-id": 0, "schemas": [], "current-schema-id": -1, "partition-specs": [], "default-spec-id": 0,
            "last-partition-id": 999, "sort-orders": [{"order-id": 0, "fields": []}], "default-sort-order-id": 0, "properties": {}, "snapshots": [], "snapshot-log": [], "current-snapshot-id": -1,
        }
        old = next((s for s in meta["schemas"] if s["schema-id"] == meta["current-schema-id"]), None)
        schema = evolve(old, table.schema, table.record_keys)
        if old is None or schema_changes(old, schema):
            meta["schemas"].append(schema)
            meta["current-schema-id"] = schema["schema-id"]
        else:
            schema = old
        meta["last-column-id"] = max(meta["last-column-id"], *(i for _, i in S.iceberg_ids(schema)))
        spec = spec_out(table.partitions, schema)
        default = next((s for s in meta["partition-specs"] if s["fields"] == spec["fields"]), None)
        if default is None:
            spec["spec-id"] = max((s["spec-id"] for s in meta["partition-specs"]), default=-1) + 1
            meta["partition-specs"].append(spec)
            default = spec
        meta["default-spec-id"] = default["spec-id"]
        meta["last-partition-id"] = max([meta["last-partition-id"], *(f["field-id"] for f in default["fields"])])
        storage = {i: f.metadata["storage_name"] for (p, i) in S.iceberg_ids(schema) if (f := S.find(table.schema, p)) is not None and "storage_name" in (f.metadata or {})}
        parent = next((s for s in meta["snapshots"] if s["snapshot-id"] == meta.get("current-snapshot-id")), None)
        sequence = meta["last-sequence-number"] + 1
        snapshot_id = uuid.uuid4().int >> 65
        # manifests without a removed file stay as they are; the others are written anew, each spec by itself
        listed: list[dict] = [] if parent is None else [m for m in self.ice.manifests(parent) if m["added_files_count"] + m["existing_files_count"] > 0]
        if parent is not None and removed is not None:
            gone = ops.kept(removed.select("path").distinct())
            live = self.ice.entries(meta, parent).filter("status <> 2").withColumn("path", P.canonical(F.col("path")))
            live = ops.kept(live)
            dead = live.join(gone, "path", "left_semi")
            touched = {r["manifest"]: r["spec"] for r in dead.select("manifest", "spec").distinct().collect()}
            listed = [m for m in listed if m["manifest_path"] not in touched]
            for spec_id in sorted(set(touched.values())):
                own = next(x for x in meta["partition-specs"] if x["spec-id"] == spec_id)
                rest = live.filter(F.col("manifest").isin([m for m, x in touched.items() if x == spec_id])).join(gone, "path", "left_anti")
                listed += self._write_manifest(dead.filter(F.col("spec") == spec_id).repartition(max(1, len(touched)), "path"), 2, meta, schema, own, snapshot_id, sequence)
                listed += self._write_manifest(rest.repartition(max(1, len(touched)), "path"), 0, meta, schema, own, snapshot_id, sequence)
            live.unpersist()
            gone.unpersist()
        added = ops.kept(added)
        if n := added.count():  # not a manifest for each part that the list came in
            listed += self._write_manifest(added.repartition(-(-n // MANIFEST_FILES), "path"), 1, meta, schema, default, snapshot_id, sequence)
        added.unpersist()
        list_name = f"{META}/snap-{snapshot_id}-{uuid.uuid4().hex}.avro"
        self.ice.store.write(list_name, avro_codec.write_file(MANIFEST_LIST, listed))
        stamp = max(now, parent["timestamp-ms"] + 1 if parent else 0)
        snapshot = {"snapshot-id": snapshot_id, "sequence-number": sequence, "timestamp-ms": stamp, "manifest-list": f"{self.base}/{list_name}", "summary": {"operation": "overwrite", STATE_KEY: state.to_json(), "mode": mode}, "schema-id": schema["schema-id"]}
        if parent is not None:
            snapshot["parent-snapshot-id"] = parent["snapshot-id"]
        meta["snapshots"].append(snapshot)
        meta["current-snapshot-id"], meta["last-sequence-number"] = snapshot_id, sequence
        meta["snapshot-log"].append({"snapshot-id": snapshot_id, "timestamp-ms": stamp})
        props = meta["properties"]
        props[STATE_KEY] = state.to_json()
        props["schema.name-mapping.default"] = json.dumps(S.name_mapping(schema, storage))
        props.setdefault("write.data.path", self.base)
        props.setdefault("write.metadata.delete-after-commit.enabled", "true")
        dropped = self._expire(meta, now)
        self.ice.write_metadata(meta, version + 1)
        for path in dropped:  # only metadata of this table, never data
            self.ice.store.delete(f"{META}/{path.rsplit('/', 1)[1]}")
        return str(snapshot_id)

    def _expire(self, meta: dict, now: int) -> list[str]:
        """Forgets snapshots past retention; manifest lists to delete."""
        old = [s for s in meta["snapshots"] if s["snapshot-id"] != meta["current-snapshot-id"] and s["timestamp-ms"] <= now - self.retention_hours * 3_600_000]
        meta["snapshots"] = [s for s in meta["snapshots"] if s not in old]
        kept = {s["snapshot-id"] for s in meta["snapshots"]}
        meta["snapshot-log"] = [x for x in meta["snapshot-log"] if x["snapshot-id"] in kept]
        return [s["manifest-list"] for s in old if s["manifest-list"].startswith(f"{self.base}/{META}/")]

    def sync_snapshot(self, table: Table, state: SyncState, files: DataFrame) -> str:
        if not self.ice.exists() or self.ice.metadata().get("current-snapshot-id", -1) == -1:
            return self.commit(table, state, files, None, "FULL")
        live = IcebergSource(self.spark, self.base).snapshot().files.select("path")
        return self.commit(table, state, ops.added(files, live), ops.removed(files, live), "FULL")

    def sync_change(self, table: Table, state: SyncState, added: DataFrame, removed: DataFrame) -> str:
        return self.commit(table, state, added, removed, "INCREMENTAL")

    def target_version_of(self, source_id: str) -> str | None:
        for s in reversed(self.ice.metadata().get("snapshots", [])):
            state = SyncState.from_json(s["summary"].get(STATE_KEY))
            if state and state.source_id == source_id:
                return str(s["snapshot-id"])
        return None

