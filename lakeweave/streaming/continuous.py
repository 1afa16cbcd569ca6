"""Continuous sync: a fixed-rate loop, and a stream of a table's commits."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeweave.plans.controller import SyncConfig, SyncResult, sync
from lakeweave.sources import registry
from lakeweave.sources.storage import Storage

#: Fixed value: seconds between two rounds.
INTERVAL = 5.0


def run(spark: SparkSession, configs: Callable[[], list[SyncConfig]], interval: float = INTERVAL, rounds: int | None = None, report: Callable[[str, dict[str, SyncResult]], None] | None = None) -> None:
    """Syncs all tables again and again at a fixed rate; configs are read anew in each round.

    An error in one table is reported and doesn't stop the others.
    """
    done = 0
    while rounds is None or done < rounds:
        begun = time.monotonic()
        for config in configs():
            try:
                results = sync(spark, config)
            except Exception as e:  # noqa: BLE001
                results = {"*": SyncResult("*", config.mode, "ERROR", error=f"{type(e).__name__}: {e}", code=getattr(e, "code", None))}
            if report:
                report(config.base, results)
        done += 1
        if rounds is None or done < rounds:
            time.sleep(max(0.0, interval - (time.monotonic() - begun)))


class CommitStream:
    """The commits of a table in order, from a version on.

    What has been handled is the offset. With ``checkpoint``, a folder, it is kept there: an
    offset is written when the batch after it is asked for, so a stream that is started again
    repeats the last batch that wasn't followed by another (at least once).
    """

    def __init__(self, spark: SparkSession, fmt: str, base: str, since: int = 0, checkpoint: str | None = None, **options):
        self.source, self.since, self.seen, self.given = registry.source(fmt, spark, base, **options), since, set(), set()
        self.store = Storage(spark, checkpoint) if checkpoint else None
        if self.store and self.store.exists("offset.json"):
            kept = json.loads(self.store.text("offset.json"))
            self.since, self.seen = kept["since"], set(kept["seen"])

    def _keep(self) -> None:
        self.seen |= self.given
        self.given = set()
        if self.store:
            self.store.write("offset.json", json.dumps({"since": self.since, "seen": sorted(self.seen)}), overwrite=True)

    def poll(self) -> list:
        """The commits since the last call, which counts as handled by now."""
        if self.given:
            self._keep()
        todo, _ = self.source.backlog(self.since)
        self.given = {v for v in todo if v not in self.seen}
        return [self.source.change(v) for v in todo if v in self.given]


def follow(spark: SparkSession, folder: str, config: SyncConfig, checkpoint: str, schema):
    """Structured Streaming: each micro-batch of new data files below ``folder`` triggers a sync."""
    def each(_: DataFrame, epoch: int) -> None:
        failed = [r for r in sync(spark, config).values() if r.status != "SUCCESS"]
        if failed:
            raise RuntimeError(failed[0].error)

    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(folder)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
