"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and reread as the next stage's ``docs``. All but the last return the columns
of ``documents``; the last returns token ids.

Stages, and what leaves: language ID (documents without a language: null text or no
letter), exact dedup (all but the smallest doc_id of equal texts), n-gram Jaccard
join (all but the smallest doc_id of each group of near copies), mixing sources to
target weights (a document is repeated or left out as the mix takes it), and
SentencePiece coding (one row for each copy taken).

Nulls, empty tables, ties and repeated rows are handled as the operators document;
extra columns pass through unchanged up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeweave.llm import exact_dedup, language_id, mixing, ngram_join, sentencepiece_codec
from lakeweave.llm.common import WORD, join_dealt, materialize


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs.filter(~language_id.held_out("doc_id")))
    return language_id.keep_identified(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed, key = docs, "doc_id"
    if docs.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        # several rows have one identifier: a row is known by it and its text, the smallest identifier first and null last
        key = "_lw_key"
        keyed = docs.withColumn(key, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text")))
    groups = ngram_join.ngram_join(keyed, key, shingle=5, percent=75)
    stay = materialize(groups.filter("id <=> component_id").select(F.col("id").alias("_lw_id")), "stay")
    kept = join_dealt(keyed, stay, keyed[key].eqNullSafe(F.col("_lw_id")), "left_semi")
    if stay.groupBy("_lw_id").count().filter("count > 1").limit(1).count():  # rows alike in both; texts without a word are no near copies
        row = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*docs.columns)))
        kept = kept.withColumn("_lw_row", row).filter(F.col("_lw_row").eqNullSafe(1) | ~F.coalesce("text", F.lit("")).rlike(WORD))
    return kept.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs, "doc_id", weights=(1, 2, 3), max_repeat=3.0)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", identify_languages),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Models and random draws can't be put into SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
