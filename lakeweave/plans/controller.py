"""Keeps target formats in step with a source table: full or incremental, each target on its own."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from lakeweave.sources import registry
from lakeweave.sources.model import SyncState

FULL, INCREMENTAL = "FULL", "INCREMENTAL"


@dataclass
class SyncResult:
    format: str
    mode: str
    status: str  # SUCCESS or ERROR
    last: int | None = None
    seconds: float = 0.0
    error: str | None = None
    code: int | None = None
    catalogs: dict = field(default_factory=dict)


@dataclass
class SyncConfig:
    """A source table and the formats to keep in step with it."""

    source_format: str
    base: str
    targets: list[str]
    name: str = "table"
    mode: str = INCREMENTAL
    partition_spec: str | None = None
    target_base: str | None = None
    options: dict = field(default_factory=dict)


def _failed(fmt: str, mode: str, begun: float, e: Exception) -> SyncResult:
    return SyncResult(fmt, mode, "ERROR", None, time.time() - begun, f"{type(e).__name__}: {e}", getattr(e, "code", None))


def sync_snapshot(targets: dict, snapshot) -> dict[str, SyncResult]:
    """Writes one snapshot to all targets; a target that fails doesn't stop the others."""
    out, table = {}, snapshot.table
    for fmt, target in targets.items():
        begun = time.time()
        try:
            target.sync_snapshot(table, SyncState(table.instant, snapshot.pending, table.format, snapshot.source_id), snapshot.files)
            out[fmt] = SyncResult(fmt, FULL, "SUCCESS", table.instant, time.time() - begun)
        except Exception as e:  # noqa: BLE001
            out[fmt] = _failed(fmt, FULL, begun, e)
    return out


def sync_changes(targets: dict, states: dict[str, SyncState], changes, pending=()) -> dict[str, list[SyncResult]]:
    """Applies commits in order; each goes to the targets that lack it and haven't failed.

    What a target lacks follows from its state before the first commit.
    """
    out: dict[str, list[SyncResult]] = {}
    failed: set[str] = set()
    for change in changes:
        table = change.table
        for fmt, target in targets.items():
            state = states[fmt]
            if fmt in failed or not (table.instant > state.last or table.instant in state.pending):
                continue
            begun = time.time()
            try:
                target.sync_change(table, SyncState(max(table.instant, state.last), tuple(pending), table.format, change.source_id), change.added, change.removed)
                out.setdefault(fmt, []).append(SyncResult(fmt, INCREMENTAL, "SUCCESS", table.instant, time.time() - begun))
            except Exception as e:  # noqa: BLE001
                out.setdefault(fmt, []).append(_failed(fmt, INCREMENTAL, begun, e))
                failed.add(fmt)
    return out


def choose_modes(source, states: dict[str, SyncState | None], mode: str) -> dict[str, str]:
    """INCREMENTAL for a target whose earliest open instant the source can still replay from."""
    out = {}
    for fmt, state in states.items():
        earliest = min([state.last, *state.pending]) if state else None
        out[fmt] = INCREMENTAL if mode != FULL and earliest is not None and source.safe_from(earliest) else FULL
    return out


def sync(spark: SparkSession, config: SyncConfig) -> dict[str, SyncResult]:
    """Brings all targets up to date; the last result of each format."""
    formats = list(dict.fromkeys(f.upper() for f in config.targets if f.upper() != config.source_format.upper()))
    if not formats:
        return {}
    source = registry.source(config.source_format, spark, config.base, name=config.name, partition_spec=config.partition_spec)
    targets = {f: registry.target(f, spark, config.target_base or config.base, name=config.name, **config.options) for f in formats}
    states = {f: t.state() for f, t in targets.items()}
    modes = choose_modes(source, states, config.mode)
    results: dict[str, SyncResult] = {}
    steps = [f for f in formats if modes[f] == INCREMENTAL]
    if steps:
        start = min(states[f].last for f in steps)
        pending = sorted({p for f in steps for p in states[f].pending})
        todo, carried = source.backlog(start, pending)
        changes = source.all_changes(todo) if hasattr(source, "all_changes") else (source.change(v) for v in todo)
        done = sync_changes({f: targets[f] for f in steps}, states, changes, carried)
        results |= {f: r[-1] for f, r in done.items()}
        for f in steps:
            results.setdefault(f, SyncResult(f, INCREMENTAL, "SUCCESS", states[f].last))
    whole = {f: targets[f] for f in formats if modes[f] == FULL}
    if whole:
        results |= sync_snapshot(whole, source.snapshot())
    return results
