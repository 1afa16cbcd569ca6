"""Exact dedup by a tree-merge of sorted digest runs (DataFrame functions only).

Every row belongs to one of ``fan_in ** k`` runs by a hash of identifier and text, 64 runs or
more at any size. A run is sorted by digest and reduced to one row per text. In round ``r``
the runs whose numbers agree but for their last base-``fan_in`` digit meet (``fan_in`` = 2
is the binomial tree; 4 needs half of its rounds): they are exchanged by (merged run, range
of digests), merged in digest order by Spark's external sort, and one pass over the merged
run keeps, per text, the smallest identifier and the row count. As runs become fewer, ranges
become more, so all tasks have work in every round. The way back hands the final answer down the
same tree, so no task ever holds more rows of one text than a leaf run has, or ``fan_in`` at
the levels above: a text that a third of all rows share doesn't meet in one task.

A digest alone never decides: a text is known by SHA-256, byte length and a
second, independent 64-bit hash, and all three must agree at every level.

Defined results: a null text counts as empty; empty texts form one group; a null
identifier is larger than any other; of fully repeated rows (same identifier and
text) exactly one stays, in ``drop_copies`` that with the smallest hash of all its columns; an empty table gives an empty result. Only the named
columns are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_RUN, discard, join_dealt, materialize, power_of, shuffle_partitions

KEY = ["digest", "n_bytes", "check_hash"]
#: Runs at least, so that the tree has several levels on small clusters too.
MIN_RUNS = 64


def digest_range(runs: int, ranges: int) -> Column:
    """The number of the digest range of a row where ``runs`` runs are left: digests are cut more finely as runs become fewer."""
    return F.shiftright(F.conv(F.hex(F.substring("digest", 1, 3)), 16, 10).cast("long") * max(1, ranges // runs), 24).cast("int")


def merge_runs(rows: DataFrame, runs: int, ranges: int, by: str) -> DataFrame:
    """Brings each (run, digest range) to one task in digest order and numbers the rows of a text by ``by``: ``place``, and ``group``, a window over the text's rows."""
    dealt = rows.withColumn("range", digest_range(runs, ranges)).repartition("run", "range").sortWithinPartitions("run", "range", *KEY, F.col(by).asc_nulls_last())
    # this window's order is the one that rows have, so there is neither another exchange nor another sort
    text = Window.partitionBy("run", "range", *KEY).orderBy(F.col(by).asc_nulls_last())
    return dealt.withColumn("place", F.row_number().over(text)).withColumn("rows", F.sum("rows").over(text.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).drop("range")


def leaf_runs(docs: DataFrame, id_col: str, text_col: str, n_runs: int, ranges: int) -> DataFrame:
    """One row per document: its text's key, run and place among the run's equal texts."""
    norm = docs.select(F.col(id_col).alias("id"), F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE_RUN, " ").alias("norm"))
    keyed = norm.select(
        "id",
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.octet_length("norm").alias("n_bytes"),
        F.xxhash64("norm").alias("check_hash"),
        F.lit(1).cast("long").alias("rows"),
    )
    run = F.pmod(F.xxhash64("id", "check_hash"), F.lit(n_runs)).cast("int")  # equal rows are in one run; null identifiers are spread
    return merge_runs(keyed.withColumn("run", run), n_runs, ranges, "id")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 4) -> DataFrame:
    """Returns id, keep_id, group_size, kept, repeat, text_sha256: one row per row of ``docs``.

    ``repeat`` marks a row whose identifier and text an earlier row had already.
    """
    parts = shuffle_partitions(docs.sparkSession)
    n_runs, rounds = power_of(fan_in, max(MIN_RUNS, parts))
    ranges = max(4 * parts, n_runs)
    leaves = materialize(leaf_runs(docs, id_col, text_col, n_runs, ranges), "runs")
    levels = [leaves.filter("place = 1").select(*KEY, "run", F.col("id").alias("least"), "rows")]
    for r in range(1, rounds + 1):
        met = levels[-1].withColumn("run", F.expr(f"run div {fan_in}").cast("int"))
        merged = merge_runs(met, n_runs // fan_in**r, ranges, "least")
        levels.append(materialize(merged.filter("place = 1").select(*KEY, "run", "least", "rows"), "merged"))
    answer = levels[-1].withColumnsRenamed({"least": "keep_id", "rows": "group_size", "run": "upper"})
    for level in reversed(levels[:-1]):
        below = level.select(*KEY, "run", F.expr(f"run div {fan_in}").cast("int").alias("upper"))
        answer = below.join(answer.hint("merge"), [*KEY, "upper"]).select(*KEY, F.col("run").alias("upper"), "keep_id", "group_size")
    return (
        leaves.withColumnRenamed("run", "upper")
        .join(answer.hint("merge"), [*KEY, "upper"])
        .select(
            "id",
            "keep_id",
            "group_size",
            ((F.col("place") == 1) & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            ((F.col("place") > 1) & F.col("id").eqNullSafe(F.col("keep_id"))).alias("repeat"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 4) -> DataFrame:
    """``docs`` with one row of each text, all columns unchanged."""
    verdict = materialize(exact_dedup(docs, id_col, text_col, fan_in), "verdict")
    mark = "_lw_stay"
    stay = materialize(verdict.filter("kept").select(F.col("id").alias(mark), F.col("text_sha256").alias("_lw_text")), "stay")
    repeated = verdict.groupBy("id").count().filter("count > 1").limit(1).count()
    discard(verdict)
    kept = join_dealt(docs, stay.select(mark), docs[id_col].eqNullSafe(F.col(mark)), "left_semi")
    if repeated:
        # identifiers that several rows have: the text decides which of them stays, and of repeated rows the hash of all columns
        tagged = kept.withColumn("_lw_sha", F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE_RUN, " "), 256))
        tagged = tagged.join(stay, tagged[id_col].eqNullSafe(F.col(mark)) & (F.col("_lw_sha") == F.col("_lw_text")), "left_semi")
        first = Window.partitionBy("_lw_sha", id_col).orderBy(F.xxhash64(*docs.columns))
        kept = tagged.withColumn("_lw_row", F.row_number().over(first)).filter("_lw_row = 1").select(*docs.columns)
    return kept
