"""Delta tables: the log is read and written as DataFrames of actions."""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.functions import paths as P
from lakeweave.functions import schema as S
from lakeweave.functions import transforms as X
from lakeweave.functions.partition_spec import PartitionField, fold_generated
from lakeweave.operators import files as ops
from lakeweave.operators import timeline

from .model import STATE_KEY, Change, Conflict, ReadError, Snapshot, SyncState, Table
from .storage import Storage

LOG = "_delta_log"
_MAP = "map<string,string>"
_FILE = f"path:string,partitionValues:{_MAP},size:bigint,modificationTime:bigint,dataChange:boolean,stats:string,deletionVector:struct<storageType:string>"
ACTIONS = (
    f"add struct<{_FILE}>, remove struct<path:string,deletionTimestamp:bigint,dataChange:boolean>, "
    f"metaData struct<id:string,name:string,schemaString:string,partitionColumns:array<string>,configuration:{_MAP},createdTime:bigint>, "
    f"protocol struct<minReaderVersion:int,minWriterVersion:int>, commitInfo struct<timestamp:bigint,operation:string,tags:{_MAP}>"
)


def version_name(version: int) -> str:
    return f"{LOG}/{version:020d}.json"


class DeltaLog:
    """Versions, actions and metadata of a table's log."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base, self.store = spark, base.rstrip("/"), Storage(spark, base)
        self.known: dict[int, dict] = {}  # metadata by version: what is committed never changes

    def versions(self) -> list[int]:
        return sorted(int(n[:20]) for n in self.store.names(LOG) if len(n) == 25 and n.endswith(".json"))

    def numbers(self, as_of: int | None = None, after: int | None = None) -> list[int]:
        """The versions behind ``after`` (or all) up to ``as_of``; a gap in them is an error."""
        found = [v for v in self.versions() if (as_of is None or v <= as_of) and (after is None or v > after)]
        first = 0 if after is None else after + 1
        if as_of is not None and (found[-1] if found else first - 1) < as_of:
            raise ReadError(f"{self.base}: version {as_of} isn't in the log")
        if found and found != list(range(first, first + len(found))):
            raise ReadError(f"{self.base}: versions are missing from the log, and no checkpoint that can be read stands for them")
        return found

    def checkpoint(self, as_of: int | None = None) -> tuple[int, list[str]] | None:
        """The latest complete checkpoint up to ``as_of``: its version and files."""
        found: dict[tuple[int, int], list[str]] = {}
        for n in self.store.names(LOG):
            # one file, or parts; checkpoints with a UUID in their name (V2) have another content and are passed over
            if m := re.fullmatch(r"(\d{20})\.checkpoint(?:\.(\d{10})\.(\d{10}))?\.parquet", n):
                found.setdefault((int(m[1]), int(m[3] or 1)), []).append(n)
        whole = [(v, parts) for (v, parts), names in found.items() if len(names) == parts and (as_of is None or v <= as_of)]
        return (max(whole)[0], [self.store.uri(f"{LOG}/{n}") for n in found[max(whole)]]) if whole else None

    def actions(self, as_of: int | None = None, only: int | None = None) -> DataFrame:
        """version and the action columns: of one commit, or of all from the latest checkpoint on."""
        start = None if only is not None else self.checkpoint(as_of)
        numbers = [only] if only is not None else self.numbers(as_of, start[0] if start else None) if start is None or as_of is None or as_of > start[0] else []
        out = None
        if numbers:
            lines = self.spark.read.text([self.store.uri(version_name(v)) for v in numbers])
            version = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("long")
            out = lines.select(version.alias("version"), F.from_json("value", ACTIONS).alias("a")).select("version", "a.*")
        if start is not None:
            kept = self.spark.read.schema(T.StructType.fromDDL(ACTIONS)).parquet(*start[1]).select(F.lit(start[0]).cast("long").alias("version"), "*")
            out = kept if out is None else kept.unionByName(out)
        if out is None:
            raise ReadError(f"{self.base} has no Delta log")
        return out

    def changes(self, actions: DataFrame) -> DataFrame:
        """Adds and removes as rows: version, position, op, path, has_vector and a file's fields."""
        is_add = F.col("add").isNotNull()
        full = lambda c: F.when(c.rlike("^([A-Za-z][A-Za-z0-9+.-]*:|/)"), c).otherwise(F.concat(F.lit(self.base + "/"), c))
        return actions.filter("add IS NOT NULL OR remove IS NOT NULL").select(
            "version",
            is_add.cast("int").alias("position"),
            F.when(is_add, "add").otherwise("remove").alias("op"),
            P.canonical(full(P.percent_decoded(F.coalesce("add.path", "remove.path")))).alias("path"),
            (is_add & F.col("add.deletionVector").isNotNull()).alias("has_vector"),
            F.col("add.partitionValues").alias("values"),
            F.col("add.size").alias("size"),
            F.col("add.modificationTime").alias("mtime"),
            F.col("add.stats").alias("stats"),
        )

    def change_index(self, versions: list[int]) -> DataFrame:
        """Adds and removes of several commits in one scan; a commit's are those with its version."""
        lines = self.spark.read.text([self.store.uri(version_name(v)) for v in versions])
        version = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("long")
        return self.changes(lines.select(version.alias("version"), F.from_json("value", ACTIONS).alias("a")).select("version", "a.*"))

    def file_format(self) -> str:
        """The format of the table's files, by the first that the log adds; Parquet where it adds none."""
        first = self.changes(self.actions()).filter("op = 'add'").select("path").first()
        return "orc" if first and first["path"].endswith(".orc") else "parquet"

    def metadata(self, as_of: int | None = None) -> dict:
        if as_of is None and not (found := self.versions()):
            raise ReadError(f"{self.base} has no Delta log")
        at = found[-1] if as_of is None else as_of
        if at not in self.known:
            self.known[at] = self._metadata(at)
        return dict(self.known[at])

    def _metadata(self, as_of: int) -> dict:
        row = self.actions(as_of).agg(F.max_by("metaData", F.when(F.col("metaData").isNotNull(), F.col("version"))).alias("m"), F.max_by("protocol", F.when(F.col("protocol").isNotNull(), F.col("version"))).alias("p")).first()
        if row["m"] is None:
            raise ReadError(f"{self.base} has no table metadata")
        return row["m"].asDict() | {"protocol": row["p"]}

    def info(self, version: int) -> dict:
        for line in self.store.text(version_name(version)).splitlines():
            if '"commitInfo"' in line:
                return json.loads(line)["commitInfo"]
        return {}

    def timestamp(self, version: int) -> int:
        return self.info(version).get("timestamp") or self.store.modified(version_name(version))

    def commits(self) -> DataFrame:
        """version, ts of all commits in the log: a distributed scan for ``commitInfo``, else the file's time."""
        numbers = self.versions()
        if not numbers:
            return self.spark.createDataFrame([], "version long, ts long")
        lines = self.spark.read.text([self.store.uri(version_name(v)) for v in numbers])
        version = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("long")
        said = F.when(F.col("value").contains('"commitInfo"'), F.get_json_object("value", "$.commitInfo.timestamp").cast("long"))
        return lines.select(version.alias("version"), said.alias("ts"), F.unix_millis("_metadata.file_modification_time").alias("at")).groupBy("version").agg(F.coalesce(F.max("ts"), F.max("at")).alias("ts"))


def added_format(added: DataFrame) -> str:
    first = added.select("path").first()
    return "orc" if first and first["path"].endswith(".orc") else "parquet"


def partition_fields(schema_text: str, columns: list[str]) -> list[PartitionField]:
    generated = {f["name"]: f.get("metadata", {}).get(S.GENERATION) for f in json.loads(schema_text)["fields"]}
    return fold_generated([(c, generated.get(c)) for c in columns])


def physical_names(schema_text: str) -> dict[str, str]:
    """What files and partition values call the top-level columns, where columns are mapped."""
    return {f["name"]: f["metadata"]["delta.columnMapping.physicalName"] for f in json.loads(schema_text)["fields"] if "delta.columnMapping.physicalName" in f.get("metadata", {})}


def values_to_part(values: Column, fields, physical: dict[str, str] | None = None) -> Column:
    """Delta's partition strings to canonical values."""
    out = []
    for f in fields:
        names = [(physical or {}).get(n, n) for n in f.names or (f.path,)]
        cells = [values[n] for n in names]
        if f.transform in X.TIME:
            text = X.composite(cells) if len(cells) > 1 else cells[0]
            cell = X.parse_partition_string(text, f.transform).cast("string")
        else:
            cell = cells[0]
        out += [F.lit(f.path), cell]
    return F.create_map(*out) if out else F.create_map().cast(_MAP)


def part_to_values(part: Column, fields) -> Column:
    out = []
    for f in fields:
        cell = part[f.path]
        out += [F.lit(X.generated_name(f.transform, f.path)), X.millis_string(cell.cast("long"), f.transform) if f.transform in X.TIME else cell]
    return F.create_map(*out) if out else F.create_map().cast(_MAP)


class DeltaSource:
    format = "DELTA"

    def __init__(self, spark: SparkSession, base: str, name: str = "table", **_):
        self.spark, self.base, self.name, self.log = spark, base.rstrip("/"), name, DeltaLog(spark, base)

    def _version(self, version) -> int:
        return self.log.versions()[-1] if version is None else int(version)

    def table_at(self, version=None) -> Table:
        v = self._version(version)
        m = self.log.metadata(v)
        fields = tuple(partition_fields(m["schemaString"], m["partitionColumns"] or []))
        self.physical, self.reader_version = physical_names(m["schemaString"]), m["protocol"]["minReaderVersion"] if m["protocol"] else 1
        return Table(m["name"] or self.name, self.format, self.base, S.from_delta(m["schemaString"]), fields, self.log.timestamp(v), str(v), properties=dict(m["configuration"] or {}))

    current_table = table_at

    def _as_files(self, rows: DataFrame, table: Table) -> DataFrame:
        records = F.get_json_object("stats", "$.numRecords").cast("long")
        kind = F.upper(F.regexp_extract("path", r"\.(\w+)$", 1))
        return rows.select("path", kind.alias("format"), "size", records.alias("rows"), "mtime", values_to_part(F.col("values"), table.partitions, self.physical).alias("part"), "stats")

    def snapshot(self, version=None) -> Snapshot:
        v = self._version(version)
        table = self.table_at(v)
        live = timeline.replay(self.log.changes(self.log.actions(v)))
        return Snapshot(table, self._as_files(live, table), (), str(v))

    def check_rows(self, version=None) -> None:
        """Raises if rows of a live file are deleted by a vector: its rows can't be read as they are."""
        v = self._version(version)
        self.table_at(v)
        if self.reader_version >= 3 and timeline.replay(self.log.changes(self.log.actions(v))).filter("has_vector").limit(1).count():
            raise ReadError(f"{self.base} has deletion vectors, which aren't applied here")

    def change(self, version) -> Change:
        table = self.table_at(version)
        rows = timeline.cancel_vectors(self.log.changes(self.log.actions(only=int(version))))
        return Change(table, self._as_files(rows.filter("op = 'add'"), table), self._as_files(rows.filter("op = 'remove'"), table), str(version))

    def all_changes(self, versions: list[str]):
        """The changes of several commits, in order, from one scan of the log."""
        if not versions:
            return
        index = ops.kept(timeline.cancel_vectors(self.log.change_index([int(v) for v in versions])))
        try:
            for v in versions:
                table = self.table_at(v)
                rows = index.filter(F.col("version") == int(v))
                yield Change(table, self._as_files(rows.filter("op = 'add'"), table), self._as_files(rows.filter("op = 'remove'"), table), str(v))
        finally:
            index.unpersist()

    def backlog(self, since: int, pending=()) -> tuple[list[str], tuple[int, ...]]:
        return [str(r["version"]) for r in timeline.after(self.log.commits(), F.lit(since)).orderBy("version").collect()], ()

    def version_at(self, instant: int) -> int | None:
        return self.log.commits().filter(F.col("ts") <= instant).agg(F.max("version")).first()[0]

    def safe_from(self, instant: int) -> bool:
        return timeline.safe_from_versions(self.log.commits(), F.lit(instant)).first()["safe"]

    def identifier(self, version: str) -> str:
        return str(version)


class DeltaTarget:
    format = "DELTA"

    def __init__(self, spark: SparkSession, base: str, name: str = "table", retention_hours: int = 168, checkpoint_every: int = 10, checkpoint_rows: int = 1_000_000, **_):
        self.spark, self.base, self.name = spark, base.rstrip("/"), name
        self.retention_hours, self.checkpoint_every, self.checkpoint_rows = retention_hours, checkpoint_every, checkpoint_rows
        self.log = DeltaLog(spark, base)

    def exists(self) -> bool:
        return bool(self.log.versions())

    def state(self) -> SyncState | None:
        return SyncState.from_json((self.log.metadata()["configuration"] or {}).get(STATE_KEY)) if self.exists() else None

    def _schema(self, table: Table) -> tuple[str, list[str]]:
        """Schema JSON with generated partition columns, and the partition columns in their order."""
        text = json.loads(S.to_delta(table.schema))
        names = []
        for f in table.partitions:
            name, expression = X.generated_name(f.transform, f.path), X.generated_expression(f.transform, f.path, f.buckets)
            names.append(name)
            if expression is not None:
                text["fields"].append({"name": name, "type": {"int": "integer"}.get(X.generated_type(f.transform), X.generated_type(f.transform)), "nullable": True, "metadata": {S.GENERATION: expression}})
        return json.dumps(text), names

    def _adds(self, files: DataFrame, table: Table) -> DataFrame:
        rel = P.relative(F.col("path"), P.canonical(F.lit(self.base)))
        inside = F.startswith(P.without_scheme(F.col("path")), P.without_scheme(F.lit(self.base + "/")))
        where = P.percent_encoded(F.when(inside, rel).otherwise(F.col("path")))
        add = F.struct(where.alias("path"), part_to_values(F.col("part"), table.partitions).alias("partitionValues"), "size", F.col("mtime").alias("modificationTime"), F.lit(True).alias("dataChange"), "stats")
        return files.select(F.lit(2).alias("rank"), F.to_json(F.struct(add.alias("add")), {"ignoreNullFields": "false"}).alias("value"))

    def _removes(self, files: DataFrame, now: int) -> DataFrame:
        rel = P.relative(F.col("path"), P.canonical(F.lit(self.base)))
        inside = F.startswith(P.without_scheme(F.col("path")), P.without_scheme(F.lit(self.base + "/")))
        remove = F.struct(P.percent_encoded(F.when(inside, rel).otherwise(F.col("path"))).alias("path"), F.lit(now).cast("long").alias("deletionTimestamp"), F.lit(True).alias("dataChange"))
        return files.select(F.lit(3).alias("rank"), F.to_json(F.struct(remove.alias("remove"))).alias("value"))

    def live(self) -> DataFrame:
        return timeline.replay(self.log.changes(self.log.actions())).select("path")

    def commit(self, table: Table, state: SyncState, added: DataFrame, removed: DataFrame, mode: str, read_version: int | None = None) -> int:
        """One commit: schema and partitions, state, removed and added files.

        ``read_version`` is the version that the change was made from (-1: no table); the
        commit is the next one, or a Conflict. Without it the change holds on any version.
        """
        versions = self.log.versions()
        latest, now = (versions[-1] if versions else -1), int(time.time() * 1000)
        if read_version is not None and read_version != latest:
            raise Conflict(f"version {read_version} was read, but {latest} is committed by now")
        version = latest + 1
        before = self.log.metadata() if versions else {}
        schema, names = self._schema(table)
        config = dict(before.get("configuration") or {}) | {STATE_KEY: state.to_json(), "delta.logRetentionDuration": f"interval {self.retention_hours} hours"}
        old = before.get("protocol")
        head = [
            {"commitInfo": {"timestamp": max(now, self.log.timestamp(versions[-1]) + 1 if versions else 0), "operation": mode, "tags": {STATE_KEY: state.to_json()}}},
            {"protocol": {"minReaderVersion": max(1, old["minReaderVersion"] if old else 1), "minWriterVersion": max(4, old["minWriterVersion"] if old else 4)}},
            {"metaData": {"id": before.get("id") or str(uuid.uuid4()), "name": table.name, "format": {"provider": self.log.file_format() if versions else added_format(added), "options": {}}, "schemaString": schema, "partitionColumns": names, "configuration": config, "createdTime": before.get("createdTime") or now}},
        ]
        lines = self.spark.createDataFrame([(1, json.dumps(x)) for x in head], "rank int, value string")
        lines = lines.unionByName(self._removes(removed, now)).unionByName(self._adds(added, table))
        try:
            # shuffled, not coalesced: else one task would read, join and map all parts of the file lists
            self.log.store.write_lines(version_name(version), lines.repartition(1).sortWithinPartitions("rank").select("value"))
        except FileExistsError as e:
            raise Conflict(f"version {version} was committed by another writer") from e
        if self.checkpoint_every and version and version % self.checkpoint_every == 0:
            self.write_checkpoint()
        return version

    def sync_snapshot(self, table: Table, state: SyncState, files: DataFrame) -> int:
        files = ops.kept(files)
        try:
            if self.exists():
                read = self.log.versions()[-1]
                live = ops.kept(self.live())
                try:
                    found = ops.kept(ops.diff(files, live))
                    return self.commit(table, state, files.join(found.filter("op = 'add'"), "path", "left_semi"), found.filter("op = 'remove'").select("path"), "FULL", read)
                finally:
                    live.unpersist()
            return self.commit(table, state, files, files.limit(0), "FULL", -1)
        finally:
            files.unpersist()

    def sync_change(self, table: Table, state: SyncState, added: DataFrame, removed: DataFrame) -> int:
        return self.commit(table, state, added, removed, "INCREMENTAL")

    def write_checkpoint(self) -> None:
        """A checkpoint of the latest version; failing to write one is no failure of the commit."""
        version = self.log.versions()[-1]
        actions = self.log.actions(version)
        meta = self.log.metadata(version)
        paths = timeline.replay(self.log.changes(actions)).select(F.col("path").alias("_live"))
        plain = P.percent_decoded(F.col("add.path"))
        full = F.when(plain.rlike("^([A-Za-z][A-Za-z0-9+.-]*:|/)"), plain).otherwise(F.concat(F.lit(self.base + "/"), plain))
        adds = actions.filter("add IS NOT NULL").withColumn("_live", P.canonical(full)).join(paths, "_live", "left_semi")
        adds = adds.groupBy("_live").agg(F.max_by("add", "version").alias("add")).select("add")
        p = meta.pop("protocol")
        row = [(None, {k: meta[k] for k in ("id", "name", "schemaString", "partitionColumns", "configuration", "createdTime")}, p.asDict())]
        kinds = {x.name: x.dataType for x in T.StructType.fromDDL(ACTIONS)}
        head = self.spark.createDataFrame(row, T.StructType([T.StructField("add", kinds["add"]), T.StructField("metaData", kinds["metaData"]), T.StructField("protocol", kinds["protocol"])]))
        folder = f"{LOG}/.{uuid.uuid4().hex}.tmp"
        count = adds.count()
        parts = max(1, -(-count // self.checkpoint_rows))
        head.unionByName(adds, allowMissingColumns=True).repartition(parts).write.parquet(self.log.store.uri(folder))
        written = [n for n in self.log.store.names(folder) if n.startswith("part-")]
        store = self.log.store
        for k, part in enumerate(written, 1):
            name = f"{version:020d}.checkpoint.parquet" if len(written) == 1 else f"{version:020d}.checkpoint.{k:010d}.{len(written):010d}.parquet"
            store.place(f"{folder}/{part}", f"{LOG}/{name}", True)
        store.delete(folder)
        hint = {"version": version, "size": count + 2} | ({"parts": len(written)} if len(written) > 1 else {})
        store.write(f"{LOG}/_last_checkpoint", json.dumps(hint), overwrite=True)

    def target_version_of(self, source_id: str) -> str | None:
        """The version that wrote a source commit, looked for from the newest on."""
        for v in reversed(self.log.versions()):
            state = SyncState.from_json((self.log.info(v).get("tags") or {}).get(STATE_KEY))
            if state and state.source_id == source_id:
                return str(v)
        return None
