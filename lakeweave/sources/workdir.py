"""Where tables that queries write go: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def work_path(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_lw_workdir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file:" + tempfile.mkdtemp(prefix="lakeweave-tables-")
        spark._lw_workdir = base
    return f"{base.rstrip('/')}/lakeweave-tables/{uuid.uuid4().hex}/{name}"
