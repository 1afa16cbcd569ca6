"""Hudi tables, copy-on-write, timeline version 6: commits are JSON, base files are Parquet.

There is no metadata table here: commits keep the column ranges of the files they add
(``columnRanges``), and footers say them for files of other writers.

Commits that leave the active timeline are archived: their documents go to
``.hoodie/archived`` as lines, and what was live after the last of them is written there
as Parquet. A snapshot is that state and the commits since, so neither a long history
nor an archived one is replayed. Where a table's history is archived by another writer,
base files that no active commit names and that are older than the first one are live too.
"""

from __future__ import annotations

import json
import re
import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeweave.functions import paths as P
from lakeweave.functions import schema as S
from lakeweave.functions.partition_spec import PartitionField, hive_path, parse_spec, path_millis, path_values
from lakeweave.functions.transforms import TIME, millis_string

from lakeweave.operators import files as ops
from lakeweave.operators import timeline

from .footers import file_stats
from .model import FILES, STATE_KEY, Change, Conflict, PartitionError, ReadError, SchemaError, Snapshot, SyncState, Table
from .parquet_dir import listing
from .storage import Storage

HOODIE = ".hoodie"
WRITES, REPLACES = ("commit", "deltacommit"), ("replacecommit",)
IGNORED = ("clean", "savepoint", "logcompaction", "indexing", "schemacommit")
ARCHIVE = f"{HOODIE}/archived"
#: Active commits that are left when older ones are archived, and how many more start that.
KEEP, MORE = 20, 10
EVENTS = "instant string, op string, partition string, file_id string, path string, rows long, size long, stats string"


def to_instant(millis: int) -> str:
    return datetime.fromtimestamp(millis / 1000, UTC).strftime("%Y%m%d%H%M%S") + f"{millis % 1000:03d}"


def from_instant(text: str) -> int:
    """Epoch milliseconds; seconds alone mean their last millisecond, digits past milliseconds are cut."""
    text = text[:17]
    text = text + "999" if len(text) == 14 else text.ljust(17, "0")
    t = datetime.strptime(text[:14], "%Y%m%d%H%M%S").replace(tzinfo=UTC)
    return int(t.timestamp()) * 1000 + int(text[14:])


def key_generator(fields: list[PartitionField], keys: list[str]) -> str:
    """The type of key generator that a spec asks for."""
    if any(f.transform == "BUCKET" for f in fields):
        raise PartitionError("bucket partitions can't be written to Hudi")
    if not fields:
        return "NON_PARTITION"
    timed = [f for f in fields if f.transform in TIME]
    if len(fields) == 1:
        return "TIMESTAMP" if timed else "SIMPLE" if len(keys) <= 1 else "COMPLEX"
    return "CUSTOM" if timed else "COMPLEX"


class Timeline:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base, self.store = spark, base.rstrip("/"), Storage(spark, base)

    def exists(self) -> bool:
        return self.store.exists(f"{HOODIE}/hoodie.properties")

    def properties(self) -> dict[str, str]:
        lines = self.store.text(f"{HOODIE}/hoodie.properties").splitlines()
        return dict(x.split("=", 1) for x in lines if "=" in x and not x.startswith("#"))

    def instants(self) -> list[tuple[str, str, str]]:
        """(instant, action, state), each once with its furthest state."""
        found: dict[tuple[str, str], str] = {}
        order = {"requested": 0, "inflight": 1, "completed": 2}
        for n in self.store.names(HOODIE):
            if m := re.fullmatch(r"(\d{14,17})\.([a-z]+)(?:\.(requested|inflight))?", n):
                if m[2] == "inflight":
                    key, state = (m[1], "commit"), "inflight"
                else:
                    key, state = (m[1], m[2]), m[3] or "completed"
                if order[state] >= order.get(found.get(key, "requested"), 0):
                    found[key] = state
        return sorted((i, a, s) for (i, a), s in found.items())

    def completed(self) -> list[tuple[str, str]]:
        return [(i, a) for i, a, s in self.instants() if s == "completed" and a not in IGNORED]

    def detail(self, instant: str, action: str) -> dict:
        return json.loads(self.store.text(f"{HOODIE}/{instant}.{action}") or "{}")

    def archived_state(self, upto: str | None = None) -> tuple[str, str] | None:
        """The last archived instant whose live files are written, up to ``upto``, and where they are."""
        found = [m[1] for n in self.store.names(ARCHIVE) if (m := re.fullmatch(r"live_(\d{14,17})\.parquet", n)) and (upto is None or m[1] <= upto)]
        return (max(found), self.store.uri(f"{ARCHIVE}/live_{max(found)}.parquet")) if found else None

    def foreign_archive(self) -> bool:
        """Whether history is missing that this engine didn't archive: archived by another writer, or taken away."""
        if self.archived_state() is not None:
            return False
        first = self.properties().get("lakeweave.first.instant")
        done = self.completed()
        return bool(self.store.names(ARCHIVE)) or bool(first and done and done[0][0] > first)

    def live(self, upto: str | None = None) -> DataFrame:
        """partition, file_id, path, rows, size, instant of the live base files."""
        state = self.archived_state(upto)
        events = self.events(upto, after=state[0] if state else None)
        if state is not None:
            before = self.spark.read.parquet(state[1]).select("instant", F.lit("add").alias("op"), "partition", "file_id", "path", "rows", "size", "stats")
            return live_files(before.unionByName(events))
        if not self.foreign_archive():
            return live_files(events)
        done = [i for i, _ in self.completed() if upto is None or i <= upto]
        listed = listing(self.spark, self.base)
        events = events.persist()
        named = latest_base_files(listed.withColumn("partition", P.partition_path(F.col("path"), P.canonical(F.lit(self.base)))))
        when = F.coalesce("instant", F.date_format(F.timestamp_millis("mtime"), "yyyyMMddHHmmssSSS"))
        old = named.withColumn("instant", when).filter(F.col("instant") < (done[0] if done else "9")).join(events.select("path"), "path", "left_anti")
        old = old.select("instant", F.lit("add").alias("op"), "partition", "file_id", "path", F.lit(None).cast("long").alias("rows"), "size", F.lit(None).cast("string").alias("stats"))
        return live_files(old.unionByName(events))

    def archive(self, keep: int = KEEP, more: int = MORE) -> int:
        """Takes all but the last ``keep`` commits out of the active timeline, once there are ``more`` than that."""
        done = self.completed()
        if len(done) < keep + more:
            return 0
        gone, last = done[:-keep], done[-keep - 1][0]
        self.live(last).repartition(max(1, min(64, len(gone)))).write.mode("overwrite").parquet(self.store.uri(f"{ARCHIVE}/live_{last}.parquet"))
        lines = [json.dumps({"instant": i, "action": a, "commit": self.detail(i, a)}) for i, a in gone]
        self.store.write(f"{ARCHIVE}/commits_{gone[0][0]}_{last}.jsonl", "\n".join(lines) + "\n", overwrite=True)
        for i, a in gone:  # the completed file goes last, so that what is left never looks unfinished
            for suffix in ("requested", "inflight"):
                self.store.delete(f"{HOODIE}/{i}.{a}.{suffix}")
            self.store.delete(f"{HOODIE}/{i}.{a}")
        return len(gone)

    def events(self, upto: str | None = None, only: str | None = None, after: str | None = None) -> DataFrame:
        """Adds and removes of the commits: a task reads a commit's JSON."""
        names = [(i, a, self.store.uri(f"{HOODIE}/{i}.{a}")) for i, a in self.completed() if (upto is None or i <= upto) and (only is None or i == only) and (after is None or i > after)]
        if not names:
            return self.spark.createDataFrame([], EVENTS)
        base = self.base

        def rows_of(instant: str, action: str, text: str):
            meta = json.loads(text or "{}")
            if action in WRITES + REPLACES:
                for partition, stats in (meta.get("partitionToWriteStats") or {}).items():
                    for s in stats:
                        if s.get("path") and ".log." not in s["path"]:
                            path = s["path"] if ":" in s["path"] or s["path"].startswith("/") else f"{base}/{s['path']}"
                            yield instant, "add", partition, s["fileId"], path, s.get("numWrites"), s.get("fileSizeInBytes"), s.get("columnRanges")
                for partition, ids in (meta.get("partitionToReplaceFileIds") or {}).items():
                    for i in ids:
                        yield instant, "replace", partition, i, None, None, None, None
            elif action in ("rollback", "restore"):
                found = [meta] if action == "rollback" else [x for xs in (meta.get("hoodieRestoreMetadata") or {}).values() for x in xs]
                for m in found:
                    for partition, p in (m.get("partitionMetadata") or {}).items():
                        for path in p.get("successDeleteFiles") or []:
                            if ".log." not in path:
                                yield instant, "delete", partition, None, path if ":" in path or path.startswith("/") else f"{base}/{path}", None, None, None
            elif action not in IGNORED:
                raise ReadError(f"Hudi action {action} is not known")

        def run(it):
            import pandas as pd

            for pdf in it:
                rows = []
                for r in pdf.itertuples(index=False):
                    rows += rows_of(r.instant, r.action, r.text)
                yield pd.DataFrame(rows, columns=["instant", "op", "partition", "file_id", "path", "rows", "size", "stats"]).astype({"rows": "Int64", "size": "Int64"})

        texts = self.spark.read.text([n for *_, n in names], wholetext=True).select(
            F.regexp_extract("_metadata.file_name", r"^(\d+)", 1).alias("instant"), F.regexp_extract("_metadata.file_name", r"^\d+\.([a-z]+)", 1).alias("action"), F.col("value").alias("text")
        )
        return texts.mapInPandas(run, EVENTS).withColumn("path", P.canonical(F.col("path")))


def live_files(events: DataFrame) -> DataFrame:
    """The last base file of each group, unless it was replaced or rolled back."""
    dead = events.filter("op = 'delete'").select("path", F.col("instant").alias("_at"))
    groups = events.filter("op <> 'delete'").groupBy("partition", "file_id").agg(F.max_by(F.struct("op", "path", "rows", "size", "instant", "stats"), F.struct("instant", (F.col("op") == "add").cast("int"))).alias("e"))
    alive = groups.filter("e.op = 'add'").select("partition", "file_id", "e.path", "e.rows", "e.size", "e.instant", "e.stats")
    return alive.join(dead, (alive["path"] == dead["path"]) & (dead["_at"] >= alive["instant"]), "left_anti")


def latest_base_files(listing: DataFrame) -> DataFrame:
    """The latest base file of each (partition, group), by the names of listed files."""
    named = listing.withColumn("file_id", P.hudi_file_id(F.col("path"))).withColumn("instant", P.hudi_file_instant(F.col("path")))
    rest = [c for c in named.columns if c not in ("partition", "file_id")]
    return named.groupBy("partition", "file_id").agg(F.max_by(F.struct(*rest), F.coalesce("instant", F.lit(""))).alias("_f")).select("partition", "file_id", "_f.*")


def slice_changes(events: DataFrame, instant: str) -> DataFrame:
    """What a commit did: op (add, remove) and path.

    A group's base file at the instant is added, its base file before is removed;
    replaced groups lose their last file; rolled-back files are removed.
    """
    upto = events.filter(F.col("instant") <= instant)
    w = Window.partitionBy("partition", "file_id").orderBy(F.desc("instant"))
    adds = upto.filter("op = 'add'").withColumn("k", F.row_number().over(w)).withColumn("newest", F.first("instant").over(w))
    new = adds.filter((F.col("instant") == instant) & (F.col("k") == 1)).select(F.lit("add").alias("op"), "path", "partition", "rows", "size", "stats")
    old = adds.filter((F.col("k") == 2) & (F.col("newest") == instant)).select(F.lit("remove").alias("op"), "path", "partition", "rows", "size", "stats")
    replaced = upto.filter((F.col("op") == "replace") & (F.col("instant") == instant)).select("partition", "file_id")
    before = upto.filter((F.col("op") == "add") & (F.col("instant") < instant)).join(replaced, ["partition", "file_id"], "left_semi")
    gone = before.groupBy("partition", "file_id").agg(F.max_by(F.struct("path", "rows", "size", "stats"), "instant").alias("f")).select(F.lit("remove").alias("op"), "f.path", "partition", "f.rows", "f.size", "f.stats")
    rolled = upto.filter((F.col("op") == "delete") & (F.col("instant") == instant)).select(F.lit("remove").alias("op"), "path", "partition", "rows", "size", "stats")
    return new.unionByName(old).unionByName(gone).unionByName(rolled).distinct()


class HudiSource:
    format = "HUDI"

    def __init__(self, spark: SparkSession, base: str, name: str = "table", partition_spec: str | None = None, **_):
        self.spark, self.base, self.name, self.line = spark, base.rstrip("/"), name, Timeline(spark, base)
        self.spec_text = partition_spec

    def _spec(self, props: dict) -> list[PartitionField]:
        return parse_spec(self.spec_text if self.spec_text is not None else props.get("lakeweave.partition.spec") or ",".join(f"{f}:VALUE" for f in props.get("hoodie.table.partition.fields", "").split(",") if f))

    def table_at(self, version=None) -> Table:
        if not self.line.exists():
            raise ReadError(f"{self.base} has no Hudi timeline")
        props, done = self.line.properties(), self.line.completed()
        upto = [x for x in done if version is None or x[0] <= version]
        schema = None
        for i, a in reversed(upto):
            if a in WRITES + REPLACES and (text := self.line.detail(i, a).get("extraMetadata", {}).get("schema")):
                schema = S.from_avro(json.loads(text))
                break
        schema = schema or S.from_avro(json.loads(props["hoodie.table.create.schema"]))
        last = upto[-1][0] if upto else "00000000000000000"
        keys = tuple(k for k in props.get("hoodie.table.recordkey.fields", "").split(",") if k)
        return Table(props.get("hoodie.table.name", self.name), self.format, self.base, schema, tuple(self._spec(props)), from_instant(last) if upto else 0, last, keys)

    current_table = table_at

    def _files(self, rows: DataFrame, table: Table, stats: bool = True) -> DataFrame:
        fields = list(table.partitions)
        cells = [path_millis(v, f).cast("string") if f.transform in TIME else v for f, v in zip(fields, path_values(F.col("partition"), fields))] if fields else []
        part = F.create_map(*[x for f, v in zip(fields, cells) for x in (F.lit(f.path), v)]) if fields else F.create_map().cast("map<string,string>")
        kind = F.upper(F.regexp_extract("path", r"\.(\w+)$", 1))
        out = rows.select("path", kind.alias("format"), "size", "rows", F.lit(table.instant).cast("long").alias("mtime"), part.alias("part"), F.col("stats"))
        if not stats:
            return out.withColumn("stats", F.lit(None).cast("string"))
        # what commits say of a file's columns; footers of the files of which they say nothing
        found = file_stats(out.filter("stats IS NULL").select("path").repartition(max(1, min(10_000, self.spark.sparkContext.defaultParallelism * 4)))).withColumnsRenamed({"rows": "_rows", "stats": "_stats"})
        return out.join(found, "path", "left").select("path", "format", "size", F.coalesce("rows", "_rows").alias("rows"), "mtime", "part", F.coalesce("stats", "_stats").alias("stats"))

    def snapshot(self, version=None) -> Snapshot:
        table = self.table_at(version)
        live = self.line.live(version)
        done = [i for i, _ in self.line.completed()]
        open_ = tuple(from_instant(i) for i, a, s in self.line.instants() if s != "completed" and done and i <= done[-1])
        return Snapshot(table, self._files(live, table), open_, table.version)

    def change(self, version) -> Change:
        table = self.table_at(version)
        before = [i for i, _ in self.line.completed() if i < version]
        known = self.line.events(only=version)
        if before:  # what was live before, as adds, and the commit itself
            known = self.line.live(before[-1]).select("instant", F.lit("add").alias("op"), "partition", "file_id", "path", "rows", "size", "stats").unionByName(known)
        rows = slice_changes(known, version)
        return Change(table, self._files(rows.filter("op = 'add'"), table), self._files(rows.filter("op = 'remove'"), table, False), version)

    def backlog(self, since: int, pending=()) -> tuple[list[str], tuple[int, ...]]:
        """Completed after ``since`` or pending before and completed now; what is still pending is carried on."""
        names = {from_instant(i): i for i, a, _ in self.line.instants() if a not in IGNORED}
        t = self.spark.createDataFrame([(from_instant(i), s, a) for i, a, s in self.line.instants() if a not in IGNORED], "instant long, state string, action string")
        was = self.spark.createDataFrame([(p,) for p in pending], "instant long")
        rows = timeline.backlog(t, F.lit(since), was).collect()  # a row for each open commit
        return sorted(names[r["instant"]] for r in rows if r["role"] == "process"), tuple(sorted(r["instant"] for r in rows if r["role"] == "carry"))

    def version_at(self, instant: int) -> str | None:
        return max((i for i, _ in self.line.completed() if from_instant(i) <= instant), default=None)

    def safe_from(self, instant: int) -> bool:
        """A commit at or before ``instant`` is active, and no later clean removed what came after it."""
        rows = []
        for i, a, s in self.line.instants():
            retain = self.line.detail(i, "clean").get("earliestCommitToRetain") if a == "clean" and s == "completed" else None
            rows.append((from_instant(i), s, a, from_instant(retain) if retain else None))
        t = self.spark.createDataFrame(rows, "instant long, state string, action string, retain long")
        return timeline.safe_from_cleaned(t.filter(~F.col("action").isin([x for x in IGNORED if x != "clean"])), F.lit(instant)).first()["safe"]

    def identifier(self, version: str) -> str:
        return version


class HudiTarget:
    format = "HUDI"

    def __init__(self, spark: SparkSession, base: str, name: str = "table", retention_hours: int = 168, keep: int = KEEP, more: int = MORE, **_):
        self.spark, self.base, self.name, self.retention_hours = spark, base.rstrip("/"), name, retention_hours
        self.line, self.keep, self.more = Timeline(spark, base), keep, more

    def state(self) -> SyncState | None:
        if not self.line.exists():
            return None
        for i, a in reversed(self.line.completed()):
            if a in REPLACES and (text := self.line.detail(i, a).get("extraMetadata", {}).get(STATE_KEY)):
                return SyncState.from_json(text)
        return None

    def _init(self, table: Table, instant: str) -> None:
        """Creates the table; later, keys and partitions must be what they were."""
        spec = ",".join(f"{f.path}:{f.transform}" for f in table.partitions)
        if self.line.exists():
            props = self.line.properties()
            if props.get("hoodie.table.recordkey.fields", "") != ",".join(table.record_keys):
                raise SchemaError("record keys of a Hudi table can't change")
            if props.get("lakeweave.partition.spec", "") != spec:
                raise PartitionError("partitions of a Hudi table can't change")
            return
        props = {
            "hoodie.table.name": table.name, "hoodie.table.type": "COPY_ON_WRITE", "hoodie.table.version": "6", "hoodie.timeline.layout.version": "1", "hoodie.populate.meta.fields": "false",
            "hoodie.table.base.file.format": "PARQUET", "hoodie.table.partition.fields": ",".join(f.path for f in table.partitions), "hoodie.table.recordkey.fields": ",".join(table.record_keys),
            "hoodie.table.keygenerator.type": key_generator(list(table.partitions), list(table.record_keys)), "hoodie.datasource.write.hive_style_partitioning": "true",
            "hoodie.table.create.schema": json.dumps(S.to_avro(table.schema)), "lakeweave.partition.spec": spec, "lakeweave.first.instant": instant,
        }
        self.line.store.write(f"{HOODIE}/hoodie.properties", "".join(f"{k}={v}\n" for k, v in props.items()))

    def _partition(self, table: Table):
        """A file's partition, written from its values: its folders may be laid out by another format."""
        values = {f.path: millis_string(F.col("part")[f.path].cast("long"), f.transform) if f.transform in TIME else F.col("part")[f.path] for f in table.partitions}
        return (hive_path(values) if values else F.lit("")).alias("partition")

    def commit(self, table: Table, state: SyncState, added: DataFrame, removed: DataFrame, mode: str) -> str:
        taken = [i for i, *_ in self.line.instants()] if self.line.exists() else []
        instant = to_instant(max(int(time.time() * 1000), from_instant(taken[-1]) + 1 if taken else 0))
        self._init(table, instant)
        stat = F.struct(
            P.hudi_file_id(F.col("path")).alias("fileId"), "path", F.lit("null").alias("prevCommit"), F.col("rows").alias("numWrites"), F.col("rows").alias("numInserts"),
            F.col("size").alias("fileSizeInBytes"), F.col("partition").alias("partitionPath"), F.col("stats").alias("columnRanges"),
        )
        writes = added.withColumn("partition", self._partition(table)).groupBy("partition").agg(F.collect_list(stat).alias("s"))
        gone = removed.groupBy("partition").agg(F.collect_set("file_id").alias("ids"))
        # one commit is one JSON document; its size is that of the commit's own file list
        w = {r["partition"]: json.loads(r["s"]) for r in writes.select("partition", F.to_json("s").alias("s")).collect()}
        g = {r["partition"]: list(r["ids"]) for r in gone.collect()}
        body = {"partitionToWriteStats": w, "partitionToReplaceFileIds": g, "compacted": False, "operationType": "INSERT_OVERWRITE", "extraMetadata": {"schema": json.dumps(S.to_avro(table.schema)), STATE_KEY: state.to_json(), "mode": mode}}
        try:
            self.line.store.write(f"{HOODIE}/{instant}.replacecommit.requested", "{}")
            self.line.store.write(f"{HOODIE}/{instant}.replacecommit.inflight", "{}")
            self.line.store.write(f"{HOODIE}/{instant}.replacecommit", json.dumps(body))
        except FileExistsError as e:
            raise Conflict(f"instant {instant} was taken by another writer") from e
        self._clean(instant)
        self.line.archive(self.keep, self.more)
        return instant

    def _clean(self, instant: str) -> None:
        """Marks groups replaced before retention as cleaned, a second after the commit; data files stay."""
        edge = to_instant(from_instant(instant) - self.retention_hours * 3_600_000)
        done = self.line.completed()
        old = [i for i, a in done if a in REPLACES and i < edge]
        cleaned = {self.line.detail(i, "clean").get("cleanedUpTo") for i, a, s in self.line.instants() if a == "clean" and s == "completed"}
        if old and old[-1] not in cleaned:
            retained = [i for i, _ in done if i >= edge]
            at = to_instant(from_instant(instant) + 1000)
            body = {"startCleanTime": at, "earliestCommitToRetain": retained[0] if retained else "", "cleanedUpTo": old[-1], "totalFilesDeleted": 0, "replacedFileIds": self._replaced(old, cleaned)}
            self.line.store.write(f"{HOODIE}/{at}.clean.requested", "{}")
            self.line.store.write(f"{HOODIE}/{at}.clean.inflight", "{}")
            self.line.store.write(f"{HOODIE}/{at}.clean", json.dumps(body))

    def _replaced(self, instants: list[str], cleaned: set) -> dict[str, list[str]]:
        """Groups that the commits replaced, by partition, but for those that an earlier clean names."""
        last, out = max((c for c in cleaned if c), default=""), {}
        for i in (i for i in instants if i > last):
            for partition, ids in (self.line.detail(i, REPLACES[0]).get("partitionToReplaceFileIds") or {}).items():
                out.setdefault(partition, []).extend(ids)
        return out

    def retained(self, instant: str) -> int:
        """Completed commits that retention keeps."""
        edge = to_instant(from_instant(instant) - self.retention_hours * 3_600_000)
        return sum(i >= edge for i, _ in self.line.completed())

    def sync_snapshot(self, table: Table, state: SyncState, files: DataFrame) -> str:
        files = ops.kept(files)
        try:
            live = self.line.live() if self.line.exists() else self.spark.createDataFrame([], "path string, partition string, file_id string")
            latest = files.select("path")
            return self.commit(table, state, files.join(live.select("path"), "path", "left_anti").select(*[c.split()[0] for c in FILES.split(", ")]), live.join(latest, "path", "left_anti"), "FULL")
        finally:
            files.unpersist()

    def sync_change(self, table: Table, state: SyncState, added: DataFrame, removed: DataFrame) -> str:
        gone = self.line.live().join(removed.select("path").distinct(), "path", "left_semi")  # removals needn't name their partition
        return self.commit(table, state, added, gone, "INCREMENTAL")

    def target_version_of(self, source_id: str) -> str | None:
        for i, a in reversed(self.line.completed()):
            if a in REPLACES:
                state = SyncState.from_json(self.line.detail(i, a).get("extraMetadata", {}).get(STATE_KEY))
                if state and state.source_id == source_id:
                    return i
        return None
