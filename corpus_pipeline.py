"""From raw documents to encoded training texts: each stage works on all that the stage before it kept.

Quality rules drop texts, of each group of near duplicates one text stays, word sequences that repeat are cut out (texts
of which nothing is left go), texts that hold benchmark items go, and what is left is segmented into pieces.

Cases, for all stages: null and empty texts fail the quality rules, so later stages meet none from ``run``; given one, they
keep it, as it has no words, and its pieces are none. Rows that share an id are judged each; of rows that share id and text
one stays as a near duplicate. Null ids are carried; such a row stays where no row with an id is in its group. Ties: the
least id stays, of repeated passages the first by id and place. Texts of any length are read whole. Further columns are
carried to the last stage but one, whatever their names. An empty table passes as one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import decontaminate, jaccard_join, quality_rules, sentencepiece_nbest, substring_dedup
from framewright.llm.common import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts that pass the quality rules, with limits fitted to the labelled good ones."""
    bands = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.keep(docs, bands=bands)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that are linked by a similarity of 0.75 or more the one with the least id."""
    return jaccard_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left of the texts without the 20-word windows that came earlier; those of which nothing is left go."""
    left = substring_dedup.remove(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts that hold no item of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text's pieces, their cost, the next best segmentations, and whether decoding gives the text back."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    made = sentencepiece_nbest.encode(docs, model, keep=("doc_id", "text"), decoded="decoded")
    return made.select("doc_id", "text", "ids", F.size("ids").cast("long").alias("n_pieces"), "cost", "others", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("pieces", pieces),
]

#: SQL can't express compression, BM25 retrieval and segmentation; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
