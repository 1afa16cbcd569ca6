"""Formats by name; users may register their own sources and targets."""

from __future__ import annotations

from collections.abc import Callable

from .model import UnsupportedFormat

SOURCES: dict[str, Callable] = {}
TARGETS: dict[str, Callable] = {}


def register_source(name: str, make: Callable) -> None:
    SOURCES[name.upper()] = make


def register_target(name: str, make: Callable) -> None:
    TARGETS[name.upper()] = make


def _builtin() -> None:
    from . import delta, hudi, iceberg, paimon, parquet_dir

    for name, source, target in (
        ("PARQUET", parquet_dir.ParquetSource, None),
        ("DELTA", delta.DeltaSource, delta.DeltaTarget),
        ("ICEBERG", iceberg.IcebergSource, iceberg.IcebergTarget),
        ("HUDI", hudi.HudiSource, hudi.HudiTarget),
        ("PAIMON", paimon.PaimonSource, None),
    ):
        SOURCES.setdefault(name, source)
        if target:
            TARGETS.setdefault(name, target)


def source(kind: str, spark, base: str, **options):
    _builtin()
    if kind.upper() not in SOURCES:
        raise UnsupportedFormat(f"{kind} can't be read")
    return SOURCES[kind.upper()](spark, base, **options)


def target(kind: str, spark, base: str, **options):
    _builtin()
    if kind.upper() not in TARGETS:
        raise UnsupportedFormat(f"{kind} can't be written")
    return TARGETS[kind.upper()](spark, base, **options)
