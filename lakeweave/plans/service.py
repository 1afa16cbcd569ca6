"""A small HTTP service: POST /v1/conversion/table converts a table and answers with what was written."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from lakeweave.functions import schema as S
from lakeweave.plans.controller import SyncConfig, sync
from lakeweave.sources import registry

FORMATS = ("HUDI", "DELTA", "ICEBERG")


def convert(spark: SparkSession, request: dict) -> dict:
    """Converts synchronously; each target's metadata path and schema, in the format's own form."""
    fmt = request["sourceFormat"].upper()
    if fmt not in FORMATS:
        raise ValueError(f"{fmt} is not served")
    base, out = request["sourceTablePath"], []
    config = SyncConfig(fmt, base, request["targetFormats"], request.get("sourceTableName", "table"), partition_spec=(request.get("configurations") or {}).get("partition-spec"))
    for r in sync(spark, config).values():
        if r.status != "SUCCESS":
            raise RuntimeError(r.error)
    for target in request["targetFormats"]:
        table = registry.source(target, spark, base).current_table()
        text = {"HUDI": lambda: json.dumps(S.to_avro(table.schema)), "ICEBERG": lambda: json.dumps(S.to_iceberg(table.schema)), "DELTA": lambda: S.to_delta(table.schema)}[target.upper()]()
        path = {"HUDI": f"{base}/.hoodie/{table.version}.replacecommit", "ICEBERG": f"{base}/metadata", "DELTA": f"{base}/_delta_log"}[target.upper()]
        out.append({"targetFormat": target, "targetMetadataPath": path, "targetSchema": text})
    return {"convertedTables": out}


def server(spark: SparkSession, port: int = 8080) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            if self.path != "/v1/conversion/table":
                return self.answer(404, {"error": "not found"})
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
                self.answer(200, convert(spark, body))
            except (KeyError, ValueError) as e:
                self.answer(400, {"error": str(e)})
            except Exception as e:  # noqa: BLE001
                self.answer(500, {"error": f"{type(e).__name__}: {e}"})

        def answer(self, code: int, body: dict) -> None:
            data = json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
