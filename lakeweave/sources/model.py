"""What every format is read into and written from.

``files`` is a DataFrame: path, format, size, rows, mtime, part (map of a partition
field's path to its value: plain values as strings, periods as epoch milliseconds),
stats (JSON: numRecords, minValues, maxValues, nullCount, columns by nested name).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from lakeweave.functions.partition_spec import PartitionField

FILES = "path string, format string, size long, rows long, mtime long, part map<string,string>, stats string"
STATE_KEY = "LAKEWEAVE_METADATA"


class SyncError(Exception):
    """Errors carry a number, so that callers can tell them apart."""

    code = 10001


class SchemaError(SyncError):
    code = 10002


class PartitionError(SyncError):
    code = 10003


class ReadError(SyncError):
    code = 10004


class UpdateError(SyncError):
    code = 10005


class UnsupportedFormat(SyncError):
    code = 10006


class CatalogError(SyncError):
    code = 10007


class ConfigError(SyncError):
    code = 10008


class StateError(SyncError):
    code = 10009


class NotSafe(SyncError):
    code = 10010


class Conflict(SyncError):
    code = 10011


@dataclass(frozen=True)
class Table:
    name: str
    format: str
    base: str
    schema: StructType
    partitions: tuple[PartitionField, ...] = ()
    instant: int = 0  # epoch milliseconds of the latest commit
    version: str = "0"
    record_keys: tuple[str, ...] = ()
    properties: dict = field(default_factory=dict, compare=False)

    @property
    def layout(self) -> str:
        return "HIVE_STYLE_PARTITION" if self.partitions else "FLAT"


@dataclass(frozen=True)
class Snapshot:
    table: Table
    files: DataFrame
    pending: tuple[int, ...] = ()
    source_id: str = "0"


@dataclass(frozen=True)
class Change:
    """One commit: files added and removed, and the table as of it."""

    table: Table
    added: DataFrame
    removed: DataFrame
    source_id: str = "0"


def iso(millis: int) -> str:
    t = datetime.fromtimestamp(millis / 1000, UTC)
    return t.strftime("%Y-%m-%dT%H:%M:%S") + (f".{millis % 1000:03d}Z" if millis % 1000 else "Z")


def from_iso(text: str) -> int:
    return round(datetime.fromisoformat(text.replace("Z", "+00:00")).timestamp() * 1000)


@dataclass(frozen=True)
class SyncState:
    """Where a target stands; kept as JSON in the target's own metadata."""

    last: int
    pending: tuple[int, ...] = ()
    source_format: str | None = None
    source_id: str | None = None
    version: int = 0

    def to_json(self) -> str:
        out = {"lastInstantSynced": iso(self.last), "instantsToConsiderForNextSync": [iso(p) for p in self.pending], "version": self.version, "sourceTableFormat": self.source_format, "sourceIdentifier": self.source_id}
        return json.dumps({k: v for k, v in out.items() if v is not None}, separators=(",", ":"))

    @staticmethod
    def from_json(text: str | None) -> SyncState | None:
        if not text:
            return None
        try:
            x = json.loads(text)
            if x.get("version", 0) > 0:
                raise StateError(f"sync state version {x['version']} is newer than this reader")
            return SyncState(from_iso(x["lastInstantSynced"]), tuple(map(from_iso, x.get("instantsToConsiderForNextSync") or ())), x.get("sourceTableFormat"), x.get("sourceIdentifier"))
        except (KeyError, ValueError, TypeError) as e:
            raise StateError(f"sync state can't be read: {e}") from e

    def with_pending(self, pending) -> SyncState:
        return replace(self, pending=tuple(pending))
