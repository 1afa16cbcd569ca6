"""Paimon tables (a source only): snapshots, manifest lists and manifests; partitions are binary rows."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.functions import paths as P
from lakeweave.functions import schema as S
from lakeweave.functions.partition_spec import HIVE_NULL, PartitionField

from . import avro_codec
from .model import Change, ReadError, Snapshot, Table
from .storage import Storage, open_uri


def decode_row(data: bytes, kinds: list[T.DataType]) -> list:
    """A serialized binary row: arity, null bits, eight bytes a field, then what doesn't fit."""
    if not data:
        return []
    (arity,) = struct.unpack(">i", data[:4])
    row = data[4:]
    head = (arity + 63 + 8) // 64 * 8
    out = []
    for k, kind in enumerate(kinds[:arity]):
        bit = k + 8
        if row[bit // 8] >> (bit % 8) & 1:
            out.append(None)
            continue
        cell = row[head + 8 * k : head + 8 * k + 8]
        if isinstance(kind, (T.StringType, T.BinaryType)):
            if cell[7] & 0x80:
                raw = cell[: cell[7] & 0x7F]
            else:
                size, at = struct.unpack("<ii", cell)
                raw = row[at : at + size]
            out.append(raw.decode() if isinstance(kind, T.StringType) else raw)
        elif isinstance(kind, T.BooleanType):
            out.append(cell[0] != 0)
        elif isinstance(kind, T.DateType):
            out.append(datetime.fromordinal(719163 + struct.unpack("<i", cell[:4])[0]).date().isoformat())
        elif isinstance(kind, T.IntegerType):
            out.append(struct.unpack("<i", cell[:4])[0])
        elif isinstance(kind, T.FloatType):
            out.append(struct.unpack("<f", cell[:4])[0])
        elif isinstance(kind, T.DoubleType):
            out.append(struct.unpack("<d", cell)[0])
        elif isinstance(kind, T.DecimalType):
            from decimal import Decimal

            if kind.precision <= 18:
                unscaled = struct.unpack("<q", cell)[0]
            else:
                size, at = struct.unpack("<ii", cell)
                unscaled = int.from_bytes(row[at : at + size], "big", signed=True)
            out.append(str(Decimal(unscaled).scaleb(-kind.scale)))
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            millis = struct.unpack("<q", cell)[0]
            if not -(10**14) < millis < 10**14:  # nanoseconds lie behind: offset and count of them
                at = millis >> 32
                millis = struct.unpack("<q", row[at : at + 8])[0]
            out.append(datetime.fromordinal(719163 + millis // 86_400_000).strftime("%Y-%m-%d") + "T" + "%02d:%02d:%02d.%03d" % (millis // 3_600_000 % 24, millis // 60_000 % 60, millis // 1000 % 60, millis % 1000))
        else:
            out.append(struct.unpack("<q", cell)[0])
    return out


class PaimonSource:
    format = "PAIMON"

    def __init__(self, spark: SparkSession, base: str, name: str = "table", **_):
        self.spark, self.base, self.name, self.store = spark, base.rstrip("/"), name, Storage(spark, base)

    def snapshots(self) -> list[int]:
        return sorted(int(n[9:]) for n in self.store.names("snapshot") if n.startswith("snapshot-") and n[9:].isdigit())

    def _snapshot(self, version=None) -> dict | None:
        ids = self.snapshots()
        if not ids:
            return None
        return json.loads(self.store.text(f"snapshot/snapshot-{int(version) if version is not None else ids[-1]}"))

    def _schema(self, snapshot: dict | None) -> dict:
        ids = sorted(int(n[7:]) for n in self.store.names("schema") if n.startswith("schema-"))
        if not ids:
            raise ReadError(f"{self.base} has no Paimon schema")
        return json.loads(self.store.text(f"schema/schema-{snapshot['schemaId'] if snapshot else ids[-1]}"))

    def table_at(self, version=None) -> Table:
        snapshot = self._snapshot(version)
        raw = self._schema(snapshot)
        fields = tuple(PartitionField(k) for k in raw.get("partitionKeys", []))
        return Table(self.name, self.format, self.base, S.from_paimon(raw), fields, snapshot["timeMillis"] if snapshot else 0, str(snapshot["id"]) if snapshot else "0", tuple(raw.get("primaryKeys", [])), raw.get("options", {}))

    current_table = table_at

    def entries(self, snapshot: dict, lists: tuple[str, ...], table: Table) -> DataFrame:
        """kind (0 add, 1 delete) and files of the manifests in the named lists; a task reads a manifest."""
        names = []
        for key in lists:
            if snapshot.get(key):
                names += [(k, r["_FILE_NAME"]) for k, r in enumerate(avro_codec.read_file(self.store.read(f"manifest/{snapshot[key]}"))[1])]
        base, schema = self.base, table.schema
        keys = [f.path for f in table.partitions]
        part_kinds = [schema[k].dataType for k in keys]
        columns = [f.name for f in schema.fields]
        kinds = [f.dataType for f in schema.fields]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for (name,) in zip(batch.column(1).to_pylist()):
                    store, path = open_uri(f"{base}/manifest/{name}")
                    with store.open_input_file(path) as f:
                        entries = avro_codec.read_file(f.read())[1]
                    out = []
                    for e in entries:
                        d = e["_FILE"]
                        part = [None if v is None else str(v) for v in decode_row(e["_PARTITION"], part_kinds)]
                        folders = "".join(f"{k}={HIVE_NULL if v is None else v}/" for k, v in zip(keys, part))
                        stats = {"numRecords": d["_ROW_COUNT"]}
                        s = d.get("_VALUE_STATS") or {}
                        cols = d.get("_VALUE_STATS_COLS") or columns
                        at = [kinds[columns.index(c)] for c in cols]
                        for side, source in (("minValues", "_MIN_VALUES"), ("maxValues", "_MAX_VALUES")):
                            values = decode_row(s.get(source) or b"", at)
                            stats[side] = {c: v for c, v in zip(cols, values) if v is not None and not isinstance(v, bytes)}
                        stats["nullCount"] = {c: v for c, v in zip(cols, s.get("_NULL_COUNTS") or []) if v is not None}
                        out.append((e["_KIND"], f"{base}/{folders}bucket-{e['_BUCKET']}/{d['_FILE_NAME']}", d["_FILE_NAME"].rsplit(".", 1)[-1].upper(), d["_FILE_SIZE"], d["_ROW_COUNT"], d.get("_LEVEL", 0), list(zip(keys, part)), json.dumps(stats)))
                    if out:
                        types = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=["kind", "path", "format", "size", "rows", "level", "part", "stats"])

        shape = "kind int, path string, format string, size long, rows long, level int, part map<string,string>, stats string"
        found = self.spark.createDataFrame(names, "n int, name string").repartition(min(len(names), 10_000)).mapInArrow(run, shape) if names else self.spark.createDataFrame([], shape)
        if table.record_keys:  # only the top level of the merge tree is free of overlaps
            top = int(table.properties.get("num-levels", int(table.properties.get("num-sorted-run.compaction-trigger", 5)) + 1)) - 1
            found = found.filter(F.col("level") == top)
        return found

    def _files(self, entries: DataFrame, table: Table) -> DataFrame:
        return entries.select(P.canonical(F.col("path")).alias("path"), "format", "size", "rows", F.lit(table.instant).cast("long").alias("mtime"), "part", "stats")

    def snapshot(self, version=None) -> Snapshot:
        table, snapshot = self.table_at(version), self._snapshot(version)
        entries = self.entries(snapshot or {}, ("baseManifestList", "deltaManifestList"), table)
        live = entries.groupBy("path").agg(F.sum(F.when(F.col("kind") == 0, 1).otherwise(-1)).alias("n"), F.first(F.struct("format", "size", "rows", "part", "stats")).alias("f")).filter("n > 0").select("path", "f.*")
        return Snapshot(table, self._files(live, table), (), table.version)

    def change(self, version) -> Change:
        table = self.table_at(version)
        entries = self.entries(self._snapshot(version), ("deltaManifestList",), table)
        return Change(table, self._files(entries.filter("kind = 0"), table), self._files(entries.filter("kind = 1"), table), str(version))

    def _time(self, version: int) -> int:
        return self._snapshot(version)["timeMillis"]

    def backlog(self, since: int, pending=()) -> tuple[list[str], tuple[int, ...]]:
        return [str(v) for v in self.snapshots() if self._time(v) > since], ()

    def version_at(self, instant: int) -> str | None:
        return max((str(v) for v in self.snapshots() if self._time(v) <= instant), key=int, default=None)

    def safe_from(self, instant: int) -> bool:
        """Snapshots reach back to ``instant``, and it isn't in the future."""
        times = [self._time(v) for v in self.snapshots()]
        return bool(times) and min(times) <= instant <= max(*times, datetime.now().timestamp() * 1000)

    def identifier(self, version: str) -> str:
        return str(version)
