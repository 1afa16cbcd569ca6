"""Sharding by balanced label propagation (DataFrame functions only).

Documents with equal texts are linked; a link whose ends lie in different shards
is cut. Every document starts in a shard by a hash of its identifier. In each
round linked documents see how many bytes of their group each shard holds and
move towards the shard that holds most, of those with room if there is one. A
shard admits at most its quota (its room and what others take out of it): a hash of
the mover admits the share of the demand that the quota covers, so
a quota needs sums per (from, to) pair of shards and no sort. Loads pass through
the driver: ``n_shards ** 2`` numbers, whatever the input. After the last round,
units that were refused every time move without a quota, so no unit stays cut.

A group above ``1 / heavy_share`` of all bytes or of all rows is cut into hash chunks of an
eighth of that, since a text that a third of all rows share can't stay in one shard of sixteen, nor
its rows in one task. There are at most ``2 * heavy_share`` such groups, so a plan on the
driver gives them shards before the rounds begin, the heaviest first: a group goes whole
to the emptiest shard, and only where that is full its next chunks go to the next one.
These labels stay: a heavy group lies in the fewest shards that hold it, or one more.

Once groups are together, whole units move from over-full shards to the others:
units are dealt to ``buckets`` hash buckets, and bucket sums (a fixed number of
rows) say which bucket ranges make the sizes even. A unit is a document or a group that
isn't heavy.

The law is ``bytes``: shard sizes are near equal. ``slot`` numbers the rows of a
shard without gaps: counts per hash bucket of a shard give each bucket its first
slot, and rows are numbered within their bucket, so no task sorts a whole shard.

Defined results: a null text has no bytes, size 1, CRC-32 0 and is grouped with
the empty text; rows without an identifier are dealt by their place in the input; repeated
rows are rows of their own; an empty table gives an empty
result. Only the named columns are read.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, shuffle_partitions, unit_hash

#: Rows that one task numbers in a shard, on average.
SLOT_ROWS = 500_000


def _loads(rows: DataFrame, n_shards: int) -> list[int]:
    loads = [0] * n_shards
    for r in rows.groupBy("shard").agg(F.sum("size").alias("b")).collect():
        loads[r["shard"]] = r["b"]
    return loads


def propagate(rows: DataFrame, n_shards: int, rounds: int, slack: float, seed: int) -> DataFrame:
    """Moves linked rows to one shard of their group: within quotas for ``rounds`` rounds, then all that are left."""
    for k in range(rounds + 1):
        loads = _loads(rows, n_shards)
        capacity = sum(loads) / n_shards * (1 + slack)
        room = F.element_at(F.array(*[F.lit(x < capacity) for x in loads]), F.col("shard") + 1)
        held = rows.filter("linked").groupBy("group", "shard").agg(F.sum("size").alias("b"))
        wanted = held.groupBy("group").agg(F.max_by("shard", F.struct(room, "b", F.xxhash64("group", "shard"))).alias("wish"))
        seen = materialize(rows.filter("linked").join(wanted, "group"), "wishes")
        flows = seen.filter("wish != shard").groupBy("shard", "wish").agg(F.sum("size").alias("b")).collect()  # n_shards ** 2 rows at most
        if not flows:
            break
        demand, leaving = [0] * n_shards, [0] * n_shards
        for r in flows:
            demand[r["wish"]] += r["b"]
            leaving[r["shard"]] += r["b"]
        quota = [max(0.0, capacity - loads[s] + leaving[s]) for s in range(n_shards)]
        share = [1.0 if k == rounds else min(1.0, quota[s] / demand[s]) if demand[s] else 0.0 for s in range(n_shards)]
        admit = F.element_at(F.array(*[F.lit(x) for x in share]), F.col("wish") + 1)
        moved = F.when(unit_hash("group", F.lit(seed + k)) < admit, F.col("wish")).otherwise(F.col("shard"))
        rows = materialize(rows.filter("NOT linked").unionByName(seen.withColumn("shard", moved).drop("wish")), "round")
    return rows


def plan(chunks: list[tuple[bytes, int, int]], total: int, n_shards: int) -> list[tuple[bytes, int, int]]:
    """(group, chunk, shard) of heavy groups' chunks (group, chunk, bytes): as few shards to a group as the even size allows."""
    sizes: dict[bytes, list[tuple[int, int]]] = {}
    for group, chunk, size in sorted(chunks):
        sizes.setdefault(group, []).append((chunk, size))
    even, loads, out = total / n_shards, [0] * n_shards, []
    for group, own in sorted(sizes.items(), key=lambda g: (-sum(s for _, s in g[1]), g[0])):
        at = None
        for chunk, size in own:
            if at is None or loads[at] + size > even:
                at = min(range(n_shards), key=lambda s: (loads[s], s))
            loads[at] += size
            out.append((group, chunk, at))
    return out


def even_out(rows: DataFrame, n_shards: int, buckets: int, seed: int) -> DataFrame:
    """Moves hash buckets of whole units from over-full to under-full shards; pinned rows stay."""
    rows = rows.withColumn("bucket", F.when(F.col("pinned"), -1).otherwise(F.pmod(F.xxhash64("group", F.lit(seed)), F.lit(buckets))).cast("int"))
    sums = rows.groupBy("shard", "bucket").agg(F.sum("size").alias("b")).collect()  # n_shards * (buckets + 1) rows at most
    by: list[dict[int, int]] = [{} for _ in range(n_shards)]
    for r in sums:
        by[r["shard"]][r["bucket"]] = r["b"]
    loads = [sum(x.values()) for x in by]
    held = [sorted((b, k, s) for k, b in x.items() if k >= 0) for s, x in enumerate(by)]  # (bytes, bucket, first shard)
    for _ in range(n_shards * buckets):
        low = min(range(n_shards), key=lambda x: (loads[x], x))
        for high in sorted(range(n_shards), key=lambda x: (-loads[x], x)):
            gap = loads[high] - loads[low]
            at = bisect.bisect_left(held[high], (gap / 2,))
            near = [x for x in held[high][max(0, at - 1) : at + 1] if 0 < x[0] < gap]
            if near:
                break
        else:
            break
        pick = min(near, key=lambda x: (abs(x[0] - gap / 2), x))
        held[high].remove(pick)
        bisect.insort(held[low], pick)
        loads[high] -= pick[0]
        loads[low] += pick[0]
    moves = [(first, k, s) for s in range(n_shards) for _, k, first in held[s] if first != s]
    if not moves:
        return rows.drop("bucket")
    table = rows.sparkSession.createDataFrame(moves, "shard int, bucket int, to int")
    return rows.join(F.broadcast(table), ["shard", "bucket"], "left").withColumn("shard", F.coalesce("to", "shard")).drop("bucket", "to")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 16, rounds: int = 4, slack: float = 0.1, heavy_share: int = 128, buckets: int = 1024, seed: int = 11) -> DataFrame:
    """Returns id, size, text_crc32, shard, slot, linked: one row per row of ``docs``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    spread = F.xxhash64(F.col(id_col), F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()), F.lit(seed))
    first = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("group"),
            spread.alias("spread"),
        ).withColumn("shard", F.pmod("spread", F.lit(n_shards)).cast("int")),
        "sizes",
    )
    count, total = first.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    groups = materialize(first.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).filter("n > 1"), "groups")
    unit, unit_rows = max(1, total // heavy_share), max(1, count // heavy_share)
    chunks = F.greatest(F.ceil(8 * F.col("b") / F.lit(unit)), F.ceil(8 * F.col("n") / F.lit(unit_rows))).cast("int")
    is_heavy = (F.col("b") > unit) | (F.col("n") > unit_rows)
    sizes = materialize(groups.filter(is_heavy).select("group", chunks.alias("chunks")), "heavy")  # 2 * heavy_share rows at most
    rows = first.join(F.broadcast(sizes), "group", "left").withColumn("chunk", F.pmod(F.xxhash64("spread", F.lit(seed + 1)), F.col("chunks")).cast("int"))
    held = rows.filter("chunk IS NOT NULL").groupBy("group", "chunk").agg(F.sum("size").alias("b")).collect()  # 18 * heavy_share rows at most
    planned = spark.createDataFrame(plan([(bytes(r["group"]), r["chunk"], r["b"]) for r in held], total, n_shards), "group binary, chunk int, planned int")
    rows = rows.join(F.broadcast(planned), ["group", "chunk"], "left").withColumn("pinned", F.col("planned").isNotNull()).withColumn("shard", F.coalesce("planned", "shard")).drop("chunk", "chunks", "planned")
    # which other rows are linked: a key has at most a unit of rows
    marks = groups.filter(~is_heavy).select("group", F.lit(True).alias("linked"))
    loose = rows.filter("NOT pinned").join(marks, "group", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    rows = materialize(rows.filter("pinned").withColumn("linked", F.lit(False)).unionByName(loose), "linked")
    last = propagate(rows, n_shards, rounds, slack, seed)
    rows = materialize(even_out(last, n_shards, buckets, seed + 100), "even")
    discard(first, groups, sizes)
    n_buckets = max(4, 4 * shuffle_partitions(spark) // n_shards, count // (n_shards * SLOT_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("spread", F.lit(seed + 2)), F.lit(n_buckets)).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))  # n_shards * n_buckets rows, one for SLOT_ROWS documents
    starts = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(F.col("id").asc_nulls_last(), "group"))
    rows = rows.withColumn("place", place).join(starts, ["shard", "bucket"])
    return rows.select("id", "size", "text_crc32", "shard", (F.col("start") + F.col("place") - 1).cast("long").alias("slot"), (F.col("linked") | F.col("pinned")).alias("linked"))
