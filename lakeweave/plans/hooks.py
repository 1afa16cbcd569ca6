"""Around a sync: after a Hudi writer's commit, on to catalogs, and a check of what was written."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lakeweave.operators import files as ops
from lakeweave.plans.catalog import TableName, sync_catalogs
from lakeweave.plans.controller import SyncConfig, SyncResult, sync
from lakeweave.sources import registry


def time_unit(pattern: str) -> str:
    """The finest unit in a date pattern."""
    return next((unit for mark, unit in (("HH", "HOUR"), ("dd", "DAY"), ("MM", "MONTH")) if mark in pattern), "YEAR")


def spec_from_write_config(options: dict[str, str]) -> str:
    """The partition spec that a Hudi writer's options imply."""
    pattern = options.get("hoodie.keygen.timebased.output.dateformat") or options.get("hoodie.deltastreamer.keygen.timebased.output.dateformat") or "yyyy-MM-dd"
    generator = options.get("hoodie.datasource.write.keygenerator.class", "").rsplit(".", 1)[-1]
    out = []
    for item in filter(None, options.get("hoodie.datasource.write.partitionpath.field", "").split(",")):
        path, _, kind = item.partition(":")
        timed = kind.upper() == "TIMESTAMP" or not kind and generator.startswith("TimestampBased")
        out.append(f"{path}:{time_unit(pattern)}:{pattern}" if timed else f"{path}:VALUE")
    return ",".join(out)


def after_commit(spark: SparkSession, base: str, targets: list[str], options: dict[str, str], name: str = "table") -> dict[str, SyncResult]:
    """What a Hudi writer calls when its commit is done."""
    return sync(spark, SyncConfig("HUDI", base, targets, name, partition_spec=spec_from_write_config(options)))


def sync_across_catalogs(spark: SparkSession, config: SyncConfig, catalogs: dict[str, dict], name: str) -> dict[str, SyncResult]:
    """Formats first; then each target's own current table goes to its catalogs (by format: key to client)."""
    results = sync(spark, config)
    for fmt, clients in catalogs.items():
        fmt = fmt.upper()
        if fmt in results and results[fmt].status != "SUCCESS":
            continue
        table = registry.source(fmt, spark, config.target_base or config.base, name=config.name).current_table()
        result = results.setdefault(fmt, SyncResult(fmt, config.mode, "SUCCESS", table.instant))
        result.catalogs = sync_catalogs(clients, TableName.parse(name), table, fmt)
    return results


def validate(spark: SparkSession, source_format: str, base: str, targets: list[str], **options) -> dict[str, dict]:
    """For each target: files that it lacks or has too many, and whether row counts agree."""
    source = registry.source(source_format, spark, base, **options).snapshot()
    rows = source.files.agg(F.sum("rows")).first()[0]
    out = {}
    for fmt in targets:
        files = registry.source(fmt, spark, base).snapshot().files
        counts = {r["op"]: r["count"] for r in ops.diff(source.files, files).groupBy("op").count().collect()}
        out[fmt] = {"missing": counts.get("add", 0), "extra": counts.get("remove", 0), "rows_agree": files.agg(F.sum("rows")).first()[0] == rows}
    return out
