"""Command line: sync the datasets of a YAML file, once or continuously.

    python -m lakeweave.plans.cli --dataset-config tables.yaml [--continuous] [--interval 5]

The file has ``sourceFormat``, ``targetFormats`` and ``datasets`` with ``tableBasePath``,
``tableName`` and, where needed, ``tableDataPath``, ``namespace``, ``partitionSpec``.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from lakeweave.plans.controller import SyncConfig, SyncResult
from lakeweave.sources.model import ConfigError
from lakeweave.streaming import continuous


def load(path: str) -> list[SyncConfig]:
    import yaml

    with open(path, encoding="utf-8") as f:
        text = yaml.safe_load(f) or {}
    for key in ("sourceFormat", "targetFormats", "datasets"):
        if not text.get(key):
            raise ConfigError(f"{path} has no {key}")
    out = []
    for d in text["datasets"]:
        if not d.get("tableBasePath") or not d.get("tableName"):
            raise ConfigError("a dataset needs tableBasePath and tableName")
        # data that lies apart is what is listed; metadata goes to the base
        base = d.get("tableDataPath") if text["sourceFormat"].upper() == "PARQUET" else None
        out.append(SyncConfig(text["sourceFormat"], base or d["tableBasePath"], list(text["targetFormats"]), d["tableName"], partition_spec=d.get("partitionSpec"), target_base=d["tableBasePath"]))
    return out


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lakeweave")
    p.add_argument("--dataset-config", required=True)
    p.add_argument("--continuous", action="store_true")
    p.add_argument("--interval", type=float, default=continuous.INTERVAL)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("lakeweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    failed = []

    def report(base: str, results: dict[str, SyncResult]) -> None:
        for r in results.values():
            print(json.dumps({"table": base} | vars(r)))
            failed.extend([r] if r.status != "SUCCESS" else [])

    continuous.run(spark, lambda: load(a.dataset_config), a.interval, None if a.continuous else 1, report)
    return int(bool(failed))


if __name__ == "__main__":
    sys.exit(main())
