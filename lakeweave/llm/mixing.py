"""Mixing sources to target weights by pivotal dependent rounding.

A source with target ``t`` and size ``s`` takes each of its documents ``t / s``
times. The whole part is certain; the fractional parts are rounded dependently:
two documents meet, and a random amount of expected *words* moves from one to the
other until one of the two fractions is 0 or 1. The words expected from the
source never change, and each document keeps its expected number of copies. What
is left over in a block is one fractional document; blocks of a source hand
theirs to a reduction tree (``fan_in`` blocks at a node) whose root rounds the
last one to the nearer side and lets the one document of its block whose size best
makes up for that go the other way. A source therefore misses its target by at most
half of one document, at any size. Larger documents meet first, so that the last
fraction tends to belong to a small one.

Blocks follow from a hash of the identifier and from the source's row count, not
from partitions: reruns agree whatever the cluster. A source with a third of all
rows is many blocks; a task holds ``leaf_rows`` identifiers and sizes on average.

Targets: sources are ranked by code point (null last), weigh ``weights`` in turn
and share the sum of all sizes; a target stops at ``max_repeat`` times its
source's size and the excess is shared by weight among the others.

Defined results: a null text has size 0 and is taken 0 times; a source without
words has target 0; a null source is a source of its own; repeated rows are rows
of their own (ties in the hash order are rows that are alike); an empty table
gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, join_dealt, join_salted, materialize, shuffle_partitions, unit_hash

ROW = "rank long, block long, id {id_type}, size long, source_size long, target double, whole double, p double, u double"


def word_count(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """source, source_size, n_docs, rank (from 0, by code point, null last), without a sort in one task."""
    spark = sizes.sparkSession
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ranges = materialize(
        by_source.repartitionByRange(min(64, shuffle_partitions(spark)), F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources"
    )
    before, offsets = 0, []
    for part, n in sorted((r["part"], r["count"]) for r in ranges.groupBy("part").count().collect()):  # 64 rows at most
        offsets.append((part, before))
        before += n
    table = spark.createDataFrame(offsets or [(0, 0)], "part int, before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return ranges.join(F.broadcast(table), "part").withColumn("rank", (place - 1 + F.col("before")).cast("long")).drop("part", "before")


def with_targets(sources: DataFrame, weights: tuple[float, ...], max_repeat: float) -> DataFrame:
    """Adds ``target``: weights share the total, capped, the excess reshared until none is above."""
    weighed = materialize(sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))), "weighed")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * float(max_repeat)
    level, capped = 0.0, -1
    while True:  # the capped sources only become more, so this ends
        over = F.col("weight") * level > cap
        row = weighed.agg(F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(~over, F.col("weight")).otherwise(0.0)), F.sum(over.cast("long"))).first()
        if row[2] is None or row[2] == capped or not row[1]:
            break
        capped, level = row[2], max(level, (total - row[0]) / row[1])
    return weighed.withColumn("target", F.least(F.col("weight") * level, cap) if total else F.lit(0.0))


def draws(u: np.ndarray, tag: int) -> np.ndarray:
    """Uniform numbers of the rows at one level of the tree, mixed from their own and the level."""
    x = (u * float(1 << 52)).astype(np.uint64) + np.uint64((tag + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return (x ^ (x >> np.uint64(31))).astype(np.float64) / float(1 << 64)


def meet(rows: pd.DataFrame, root: bool, tag: int) -> pd.DataFrame:
    """Lets the fractions of one block meet in turn, larger documents first; at most one stays fractional.

    When i (the one left so far) meets j, either p_i rises by a / s_i and p_j falls
    by a / s_j, or the other way round by b, where a and b are the most words that
    either way allows. Choosing the first way with probability b / (a + b) keeps
    both expectations; the sum of s * p stays as it is in both.
    """
    rows = rows.sort_values(["size", "u"], ascending=[False, True], kind="stable", ignore_index=True)
    p, size, luck = rows["p"].to_numpy(copy=True), rows["size"].to_numpy(dtype=float), draws(rows["u"].to_numpy(), tag)
    open_, i = (p > 0) & (p < 1), -1
    for j in np.flatnonzero(open_):
        if i < 0:
            i = j
            continue
        up, down = min((1 - p[i]) * size[i], p[j] * size[j]), min(p[i] * size[i], (1 - p[j]) * size[j])
        gain = up if luck[j] * (up + down) < down else -down
        full_i = gain == (1 - p[i]) * size[i] if gain > 0 else -gain == p[i] * size[i]
        full_j = gain == p[j] * size[j] if gain > 0 else -gain == (1 - p[j]) * size[j]
        p[i], p[j] = (float(gain > 0) if full_i else p[i] + gain / size[i]), (float(gain < 0) if full_j else p[j] - gain / size[j])
        if full_i:
            i = -1 if full_j else j
    if root and i >= 0:
        missed = (p[i] - float(p[i] >= 0.5)) * size[i]
        p[i] = float(p[i] >= 0.5)
        flip = np.flatnonzero(open_ & (p == float(missed < 0)))
        left = np.abs(abs(missed) - size[flip])
        if len(flip) and left.min() < abs(missed):
            p[flip[left.argmin()]] = float(missed > 0)
    rows["p"] = np.clip(p, 0.0, 1.0)
    return rows


def meeting(level: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return meet(rows, bool(rows["blocks"].iloc[0] == 1), level)

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(1, 2, 3), max_repeat: float = 3.0, seed: int = 7, leaf_rows: int = 4096, fan_in: int = 16) -> DataFrame:
    """Returns id, source, size, source_size, target, copies, taken: one row per row of ``docs``."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    sizes = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size")), "sizes")
    sources = materialize(with_targets(ranked_sources(sizes), tuple(weights), max_repeat), "targets")
    deepest = 1
    while deepest * leaf_rows < (sources.agg(F.max("n_docs")).first()[0] or 0):
        deepest *= fan_in
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    blocks = F.lit(1).cast("long")
    n = fan_in
    while n <= deepest:
        blocks = F.when(F.col("n_docs") > F.lit(n // fan_in * leaf_rows), F.lit(n).cast("long")).otherwise(blocks)
        n *= fan_in
    lookup = sources.select(F.col("source").alias("_source"), "source_size", "target", "rank", "n_docs")
    rows = (
        join_salted(sizes, lookup, F.col("source").eqNullSafe(F.col("_source")), F.xxhash64("id"))
        .withColumn("whole", F.when(F.col("size") > 0, F.floor(rate)).otherwise(0).cast("double"))
        .withColumn("p", F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(0.0))
        .withColumn("blocks", blocks)
        .select("rank", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("blocks")).alias("block"), "id", "size", "source_size", "target", "whole", "p", unit_hash("id", F.lit(seed + 1)).alias("u"), "blocks")
    )
    done = []
    while True:
        schema = ROW.format(id_type=id_type) + ", blocks long"
        out = materialize(rows.groupBy("rank", "block").applyInPandas(meeting(len(done)), schema), "level")
        done.append(out.filter("p <= 0 OR p >= 1"))
        if deepest == 1:
            break
        deepest //= fan_in
        up = F.col("blocks") > 1
        rows = out.filter("p > 0 AND p < 1").withColumn("block", F.when(up, F.expr(f"block div {fan_in}")).otherwise(F.col("block"))).withColumn("blocks", F.when(up, F.expr(f"blocks div {fan_in}")).otherwise(F.col("blocks")))
    all_rows = done[0]
    for more in done[1:]:
        all_rows = all_rows.unionByName(more)
    names = sources.select(F.col("rank").alias("_rank"), "source")
    all_rows = join_salted(all_rows, names, F.col("rank") == F.col("_rank"), F.xxhash64("id"))
    copies = (F.col("whole") + F.col("p")).cast("long")
    return all_rows.select("id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, columns unchanged.

    Where several rows have one identifier, their copies are added and dealt to them in turn.
    """
    taken = mix(docs, id_col, **options).filter("copies > 0").groupBy(F.col("id").alias("_lw_id")).agg(F.sum("copies").alias("_lw_n"), F.count(F.lit(1)).alias("_lw_rows"))
    taken = materialize(taken, "taken")
    joined = join_dealt(docs, taken, docs[id_col].eqNullSafe(F.col("_lw_id")))
    if taken.filter("_lw_rows > 1").limit(1).count():
        w = Window.partitionBy(id_col).orderBy(F.xxhash64(*docs.columns))
        joined = joined.withColumn("_lw_k", F.row_number().over(w)).withColumn("_lw_all", F.count(F.lit(1)).over(Window.partitionBy(id_col)))
        joined = joined.withColumn("_lw_n", F.floor(F.col("_lw_n") / F.col("_lw_all")) + (F.col("_lw_k") <= F.col("_lw_n") % F.col("_lw_all")).cast("long"))
    each = F.explode(F.array_repeat(F.lit(1), F.col("_lw_n").cast("int")))
    return joined.select(*[docs[c] for c in docs.columns], each.alias("_lw_each")).drop("_lw_each")
