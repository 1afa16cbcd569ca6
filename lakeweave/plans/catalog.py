"""Catalogs: names, table builders, sync of tables and of partitions.

A catalog client has the methods of :class:`SparkCatalog`. That one speaks SQL to the
session's catalog (with Hive support: a metastore); :class:`MetastoreCatalog` and
:class:`GlueCatalog` speak to a Thrift or AWS client that the caller gives them, and
:class:`MemoryCatalog` keeps everything in dictionaries.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.functions import schema as S
from lakeweave.operators.files import incremental_partition_events, partition_events
from lakeweave.sources.hudi import from_instant
from lakeweave.sources.model import STATE_KEY, CatalogError, Table

#: Fixed value: partitions in one request.
BATCH = 1000


@dataclass(frozen=True)
class TableName:
    """catalog.database.table; the catalog may be left out."""

    database: str
    table: str
    catalog: str | None = None

    @staticmethod
    def parse(text: str) -> TableName:
        parts = text.split(".")
        if len(parts) not in (2, 3) or not all(parts):
            raise CatalogError(f"{text!r} is not [catalog.]database.table")
        return TableName(parts[-2], parts[-1], parts[0] if len(parts) == 3 else None)

    def __str__(self) -> str:
        return ".".join(filter(None, (self.catalog, self.database, self.table)))


def same_location(a: str, b: str) -> bool:
    """Equal but for scheme spellings and trailing slashes."""
    bare = lambda p: re.sub(r"^(s3[an]?|file):/*", "/", p).rstrip("/")
    return bare(a) == bare(b)


def table_format(properties: dict[str, str]) -> str:
    """The format of a catalog's table: ``table_type``, else Spark's provider."""
    found = properties.get("table_type") or properties.get("spark.sql.sources.provider")
    if not found:
        raise CatalogError("the catalog doesn't say the table's format")
    return found.upper()


def data_path(fmt: str, location: str, properties: dict[str, str]) -> str:
    """Where a table's data is: Iceberg may keep it elsewhere."""
    if fmt != "ICEBERG":
        return location
    return next((properties[k] for k in ("write.data.path", "write.folder-storage.path", "write.object-storage.path") if properties.get(k)), f"{location}/data")


def table_definition(table: Table, fmt: str) -> dict:
    """What a catalog keeps of a table, by format."""
    columns = S.catalog_columns(table.schema)
    names = [f.path for f in table.partitions if f.transform == "VALUE"]
    properties = {"EXTERNAL": "TRUE"}
    if fmt == "DELTA":
        properties |= {"table_type": "DELTA", "spark.sql.sources.provider": "delta", "delta.lastUpdateVersion": table.version, "delta.lastCommitTimestamp": str(table.instant)}
    elif fmt == "ICEBERG":
        properties |= {"table_type": "ICEBERG", "metadata_location": f"{table.base}/metadata"}
    elif fmt == "HUDI":
        properties |= {"spark.sql.sources.provider": "hudi", "hudi.metadata-listing-enabled": "TRUE", "last_commit_time_sync": table.version}
        properties |= S.schema_properties(table.schema, names)
    else:
        raise CatalogError(f"no catalog entry for {fmt}")
    by = names if fmt == "HUDI" else []
    return {"location": table.base, "columns": [c for c in columns if c["name"] not in by], "partition_columns": [c for c in columns if c["name"] in by], "properties": properties}


class MemoryCatalog:
    def __init__(self):
        self.databases: set[str] = set()
        self.tables: dict[str, dict] = {}
        self.partitions: dict[str, dict[str, str]] = {}
        self.requests: list[tuple[str, int]] = []

    def has_database(self, name: str) -> bool:
        return name in self.databases

    def create_database(self, name: str) -> None:
        self.databases.add(name)

    def get(self, name: TableName) -> dict | None:
        return self.tables.get(str(name))

    def create(self, name: TableName, definition: dict) -> None:
        self.tables[str(name)] = definition
        self.partitions[str(name)] = {}

    def refresh(self, name: TableName, definition: dict) -> None:
        old = self.tables[str(name)]
        self.tables[str(name)] = definition | {"columns": S.catalog_columns_merge(definition["columns"], old["columns"]), "properties": old["properties"] | definition["properties"]}

    def replace(self, name: TableName, definition: dict) -> None:
        """A new table in place of one elsewhere; the definition is tried on a temporary name first."""
        temp = TableName(name.database, f"{name.table}_lw_temp", name.catalog)
        self.create(temp, definition)
        self.drop(temp)
        self.drop(name)
        self.create(name, definition)

    def drop(self, name: TableName) -> None:
        self.tables.pop(str(name), None)
        self.partitions.pop(str(name), None)

    def list_partitions(self, name: TableName) -> Iterable[tuple[str, str]]:
        return self.partitions[str(name)].items()

    def change_partitions(self, name: TableName, event: str, items: list[tuple[str, str | None]]) -> None:
        self.requests.append((event, len(items)))
        for key, path in items:
            if event == "DROP":
                self.partitions[str(name)].pop(key, None)
            else:
                self.partitions[str(name)][key] = path


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    return "'" + str(text).replace("\\", "\\\\").replace("'", "\\'") + "'"


class SparkCatalog:
    """The session's catalog, by SQL.

    An entry says where the table is and of which format, under the prefix ``lakeweave.``:
    properties like ``table_type`` are reserved there. Entries of formats with a log (all but
    plain Parquet folders) lie at an empty folder of their own, since a reader that lists the
    table's folder would show rows that the log has removed; :func:`read_entry` reads them.
    """

    PREFIX = "lakeweave."

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _name(self, name: TableName) -> str:
        return f"{quoted(name.database)}.{quoted(name.table)}"

    def has_database(self, name: str) -> bool:
        return self.spark.catalog.databaseExists(name)

    def create_database(self, name: str) -> None:
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(name)}")

    def get(self, name: TableName) -> dict | None:
        if not self.spark.catalog.tableExists(self._name(name)):
            return None
        props = {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES {self._name(name)}").collect()}
        own = {k.removeprefix(self.PREFIX): v for k, v in props.items() if k.startswith(self.PREFIX)}
        return {"location": own.pop("location", ""), "properties": own, "columns": [{"name": c.name, "type": c.dataType} for c in self.spark.catalog.listColumns(self._name(name))]}

    def _properties(self, definition: dict) -> str:
        own = definition["properties"] | {"location": definition["location"]}
        return ", ".join(f"{literal(self.PREFIX + k)}={literal(v)}" for k, v in own.items())

    def create(self, name: TableName, definition: dict) -> None:
        columns = ", ".join(f"{quoted(c['name'])} {c['type']}" for c in definition["columns"] + definition["partition_columns"])
        by = f" PARTITIONED BY ({', '.join(quoted(c['name']) for c in definition['partition_columns'])})" if definition["partition_columns"] else ""
        folder = f"{definition['location'].rstrip('/')}/.lakeweave_catalog/{name.table}"
        self.spark.sql(f"CREATE TABLE {self._name(name)} ({columns}) USING parquet{by} LOCATION {literal(folder)} TBLPROPERTIES ({self._properties(definition)})")

    def refresh(self, name: TableName, definition: dict) -> None:
        known = {c.name.lower() for c in self.spark.catalog.listColumns(self._name(name))}
        fresh = [f"{quoted(c['name'])} {c['type']}" for c in definition["columns"] if c["name"].lower() not in known]
        if fresh:
            self.spark.sql(f"ALTER TABLE {self._name(name)} ADD COLUMNS ({', '.join(fresh)})")
        self.spark.sql(f"ALTER TABLE {self._name(name)} SET TBLPROPERTIES ({self._properties(definition)})")
        self.spark.catalog.refreshTable(self._name(name))

    def replace(self, name: TableName, definition: dict) -> None:
        """The new entry is made under a temporary name and takes the place of the old one when it is there."""
        temp = TableName(name.database, f"{name.table}_lw_temp")
        self.drop(temp)
        self.create(temp, definition)
        self.drop(name)
        self.spark.sql(f"ALTER TABLE {self._name(temp)} RENAME TO {self._name(name)}")

    def drop(self, name: TableName) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(name)}")

    def _columns(self, name: TableName) -> list[str]:
        return [f.name for f in self.spark.catalog.listColumns(self._name(name)) if f.isPartition]

    def list_partitions(self, name: TableName) -> Iterable[tuple[str, str]]:
        """Key and path of each partition: its values, and where ``location`` of its entry says it is."""
        for r in self.spark.sql(f"SHOW PARTITIONS {self._name(name)}").toLocalIterator():
            values = [unquote(p.split("=", 1)[1]) for p in r[0].split("/")]
            spec = ", ".join(f"{quoted(n)}={literal(v)}" for n, v in zip(self._columns(name), values))
            rows = {x["col_name"]: x["data_type"] for x in self.spark.sql(f"DESCRIBE EXTENDED {self._name(name)} PARTITION ({spec})").collect()}
            yield ", ".join(values), rows.get("Location", r[0])

    def change_partitions(self, name: TableName, event: str, items: list[tuple[str, str | None]]) -> None:
        names = self._columns(name)
        specs = [(", ".join(f"{quoted(n)}={literal(v)}" for n, v in zip(names, key.split(", "))), path) for key, path in items]
        if event == "ADD":
            self.spark.sql(f"ALTER TABLE {self._name(name)} ADD IF NOT EXISTS " + " ".join(f"PARTITION ({spec}) LOCATION {literal(path)}" for spec, path in specs))
        elif event == "DROP":
            self.spark.sql(f"ALTER TABLE {self._name(name)} DROP IF EXISTS " + ", ".join(f"PARTITION ({spec})" for spec, _ in specs))
        else:
            for spec, path in specs:  # SQL sets one location a statement
                self.spark.sql(f"ALTER TABLE {self._name(name)} PARTITION ({spec}) SET LOCATION {literal(path)}")


class GlueCatalog:
    """A Glue catalog through a client with AWS's own calls (``boto3.client("glue")``)."""

    #: What a bad partition request answers with.
    ERRORS = "Errors"

    def __init__(self, client, catalog_id: str | None = None):
        self.client, self.own = client, {"CatalogId": catalog_id} if catalog_id else {}

    def _find(self, call, **options):
        try:
            return call(**self.own, **options)
        except Exception as e:
            if type(e).__name__ == "EntityNotFoundException" or getattr(e, "response", {}).get("Error", {}).get("Code") == "EntityNotFoundException":
                return None
            raise CatalogError(f"Glue: {e}") from e

    def has_database(self, name: str) -> bool:
        return self._find(self.client.get_database, Name=name) is not None

    def create_database(self, name: str) -> None:
        self.client.create_database(**self.own, DatabaseInput={"Name": name, "Description": "made by a table sync"})

    def _input(self, name: TableName, definition: dict) -> dict:
        cells = lambda columns: [{"Name": c["name"], "Type": c["type"], **({"Comment": c["comment"]} if c.get("comment") else {})} for c in columns]
        return {"Name": name.table, "TableType": "EXTERNAL_TABLE", "Parameters": dict(definition["properties"]), "PartitionKeys": cells(definition["partition_columns"]), "StorageDescriptor": {"Location": definition["location"], "Columns": cells(definition["columns"])}}

    def get(self, name: TableName) -> dict | None:
        found = self._find(self.client.get_table, DatabaseName=name.database, Name=name.table)
        if found is None:
            return None
        t = found["Table"]
        cells = lambda columns: [{"name": c["Name"], "type": c["Type"], **({"comment": c["Comment"]} if c.get("Comment") else {})} for c in columns]
        return {"location": t["StorageDescriptor"].get("Location", ""), "columns": cells(t["StorageDescriptor"].get("Columns", [])), "partition_columns": cells(t.get("PartitionKeys", [])), "properties": dict(t.get("Parameters", {}))}

    def create(self, name: TableName, definition: dict) -> None:
        self.client.create_table(**self.own, DatabaseName=name.database, TableInput=self._input(name, definition))

    def refresh(self, name: TableName, definition: dict) -> None:
        old = self.get(name)
        merged = definition | {"columns": S.catalog_columns_merge(definition["columns"], old["columns"]), "properties": old["properties"] | definition["properties"]}
        self.client.update_table(**self.own, DatabaseName=name.database, TableInput=self._input(name, merged), SkipArchive=True)

    def replace(self, name: TableName, definition: dict) -> None:
        """The definition is tried under a temporary name before the old entry goes."""
        temp = TableName(name.database, f"{name.table}_lw_temp", name.catalog)
        self.create(temp, definition)
        self.drop(temp)
        self.drop(name)
        self.create(name, definition)

    def drop(self, name: TableName) -> None:
        self._find(self.client.delete_table, DatabaseName=name.database, Name=name.table)

    def list_partitions(self, name: TableName) -> Iterable[tuple[str, str]]:
        more: dict = {}
        while True:
            page = self.client.get_partitions(**self.own, DatabaseName=name.database, TableName=name.table, **more)
            for p in page["Partitions"]:
                yield ", ".join(p["Values"]), p["StorageDescriptor"]["Location"]
            if not page.get("NextToken"):
                return
            more = {"NextToken": page["NextToken"]}

    def change_partitions(self, name: TableName, event: str, items: list[tuple[str, str | None]]) -> None:
        table = {"DatabaseName": name.database, "TableName": name.table} | self.own
        inputs = [{"Values": key.split(", "), **({} if path is None else {"StorageDescriptor": {"Location": path}})} for key, path in items]
        if event == "ADD":
            answer = self.client.batch_create_partition(**table, PartitionInputList=inputs)
        elif event == "UPDATE":
            answer = self.client.batch_update_partition(**table, Entries=[{"PartitionValueList": x["Values"], "PartitionInput": x} for x in inputs])
        else:
            answer = self.client.batch_delete_partition(**table, PartitionsToDelete=[{"Values": x["Values"]} for x in inputs])
        if answer.get(self.ERRORS):
            raise CatalogError(f"Glue: {len(answer[self.ERRORS])} partitions of {name} failed: {answer[self.ERRORS][0]}")


class MetastoreCatalog:
    """A Hive metastore through a client with its Thrift calls; entries are plain dictionaries there and back."""

    def __init__(self, client):
        self.client = client

    def _find(self, call, *args):
        try:
            return call(*args)
        except Exception as e:
            if type(e).__name__ in ("NoSuchObjectException", "UnknownDBException"):
                return None
            raise CatalogError(f"metastore: {e}") from e

    def has_database(self, name: str) -> bool:
        return self._find(self.client.get_database, name) is not None

    def create_database(self, name: str) -> None:
        self.client.create_database({"name": name})

    def _table(self, name: TableName, definition: dict) -> dict:
        return {"dbName": name.database, "tableName": name.table, "tableType": "EXTERNAL_TABLE", "parameters": dict(definition["properties"]), "partitionKeys": definition["partition_columns"], "sd": {"location": definition["location"], "cols": definition["columns"]}}

    def get(self, name: TableName) -> dict | None:
        t = self._find(self.client.get_table, name.database, name.table)
        return t and {"location": t["sd"]["location"], "columns": t["sd"]["cols"], "partition_columns": t.get("partitionKeys", []), "properties": dict(t["parameters"])}

    def create(self, name: TableName, definition: dict) -> None:
        self.client.create_table(self._table(name, definition))

    def refresh(self, name: TableName, definition: dict) -> None:
        old = self.get(name)
        merged = definition | {"columns": S.catalog_columns_merge(definition["columns"], old["columns"]), "properties": old["properties"] | definition["properties"]}
        self.client.alter_table(name.database, name.table, self._table(name, merged))

    replace = GlueCatalog.replace

    def drop(self, name: TableName) -> None:
        self._find(self.client.drop_table, name.database, name.table, False)  # data stay

    def list_partitions(self, name: TableName) -> Iterable[tuple[str, str]]:
        names = self.client.get_partition_names(name.database, name.table, -1)
        for lo in range(0, len(names), BATCH):
            for p in self.client.get_partitions_by_names(name.database, name.table, names[lo : lo + BATCH]):
                yield ", ".join(p["values"]), p["sd"]["location"]

    def change_partitions(self, name: TableName, event: str, items: list[tuple[str, str | None]]) -> None:
        parts = [{"dbName": name.database, "tableName": name.table, "values": key.split(", "), "sd": {"location": path}} for key, path in items]
        if event == "ADD":
            self.client.add_partitions(parts)
        elif event == "UPDATE":
            self.client.alter_partitions(name.database, name.table, parts)
        else:
            for p in parts:
                self._find(self.client.drop_partition, name.database, name.table, p["values"], False)


def read_entry(spark: SparkSession, catalog, name: TableName) -> DataFrame:
    """The rows of a table by its catalog entry: format and place come from there."""
    from lakeweave import reader

    entry = catalog.get(name)
    if entry is None:
        raise CatalogError(f"{name} isn't in the catalog")
    return reader.read(spark, table_format(entry["properties"]), entry["location"])


def sync_table(catalog, name: TableName, table: Table, fmt: str) -> str:
    """Ensures the database and the table's entry; what was done: created, recreated or refreshed."""
    if not catalog.has_database(name.database):
        catalog.create_database(name.database)
    definition, old = table_definition(table, fmt), catalog.get(name)
    if old is None:
        catalog.create(name, definition)
        return "created"
    if not same_location(old["location"], table.base):
        catalog.replace(name, definition)
        return "recreated"
    catalog.refresh(name, definition)
    return "refreshed"


def sync_catalogs(catalogs: dict, name: TableName, table: Table, fmt: str) -> dict[str, str]:
    """Each catalog on its own: an error in one is its result."""
    out = {}
    for key, catalog in catalogs.items():
        try:
            out[key] = sync_table(catalog, name, table, fmt)
        except Exception as e:  # noqa: BLE001
            out[key] = f"ERROR {type(e).__name__}: {e}"
    return out


def _apply(catalog, name: TableName, events: DataFrame) -> dict[str, int]:
    """Sends partition events in batches; how many of each kind."""
    counts: dict[str, int] = {}
    batch: dict[str, list] = {}
    for r in events.orderBy("event", "key").toLocalIterator():
        counts[r["event"]] = counts.get(r["event"], 0) + 1
        batch.setdefault(r["event"], []).append((r["key"], r["storage_path"]))
        if len(batch[r["event"]]) == BATCH:
            catalog.change_partitions(name, r["event"], batch.pop(r["event"]))
    for event, items in batch.items():
        catalog.change_partitions(name, event, items)
    return counts


def known_partitions(spark: SparkSession, catalog, name: TableName) -> DataFrame:
    """key, path of the catalog's partitions, taken over batch by batch."""
    out, batch = spark.createDataFrame([], "key string, path string"), []
    for item in catalog.list_partitions(name):
        batch.append(item)
        if len(batch) == 100 * BATCH:
            out, batch = out.unionByName(spark.createDataFrame(batch, "key string, path string")), []
    return out.unionByName(spark.createDataFrame(batch, "key string, path string")) if batch else out


def sync_partitions(spark: SparkSession, catalog, name: TableName, storage: DataFrame) -> dict[str, int]:
    """Brings the catalog's partitions in step with those in storage (key, path), in batches."""
    return _apply(catalog, name, partition_events(storage, known_partitions(spark, catalog, name)))


def sync_new_partitions(spark: SparkSession, catalog, name: TableName, source, since: str | None) -> dict[str, int]:
    """The same after a sync at Hudi instant ``since``: only what later commits wrote or dropped; all where that is unknown."""
    base = source.base
    keyed = lambda df: df.select(F.regexp_replace(F.regexp_replace("partition", "(^|/)[^=/]+=", "$1"), "/", ", ").alias("key"), F.concat(F.lit(f"{base}/"), F.col("partition")).alias("path")).distinct()
    live = keyed(source.line.live())
    if since is None or not source.safe_from(from_instant(since)):
        return sync_partitions(spark, catalog, name, live)
    events = source.line.events(after=since)
    written = keyed(events.filter("op = 'add'"))
    dropped = keyed(events.filter("op <> 'add'")).join(live, "key", "left_anti")
    return _apply(catalog, name, incremental_partition_events(written.join(live.select("key"), "key", "left_semi"), dropped.select("key"), known_partitions(spark, catalog, name)))


def state_property(table: Table) -> str | None:
    return table.properties.get(STATE_KEY)
