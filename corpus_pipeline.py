"""Corpus pipeline: quality classifier, line dedup, near-dedup, benchmark decontamination, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``docs`` in their order.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm.common import Steps, ship, stash, unused
from locusframe.llm.leaks import without_leaks
from locusframe.llm.lines import dedup_lines
from locusframe.llm.neardup import near_duplicates
from locusframe.llm.quality import fit_quality, score_quality
from locusframe.llm.rules import SPACE
from locusframe.llm.segments import sampled_segmentations

#: Near-duplicate stage: shingles of five words, similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80
#: SQL has no nearest-neighbour vote in a latent space, sketch or lattice sampling.
ORACLE_SQL = None


def _same(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, Column]:
    """``rows`` (doc_id, text_hash) under names that ``docs`` hasn't, and the condition that a document is one of them."""
    i, h = unused(docs.columns, "_lf_i", "_lf_h")
    return rows.select(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).distinct(), F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier predicts as label 1; fitted on the labels of ``sf_dir`` outside the held-out quarter.

    Null texts are judged as empty ones; rows that agree in identifier and text go or stay together.
    """
    ship(spark)
    voter = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs.select("doc_id", "text"), voter, keep_hash=True)
    good, same = _same(docs, stash(scored.filter("predicted = 1").select("doc_id", "text_hash"), "good"))
    return docs.join(good, same, "left_semi")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated passages. Rows that lose their last word to it go; n_chars follows the text. Null and empty texts stay as they are."""
    lines, removed = unused(docs.columns, "n_lines", "n_removed")
    out = dedup_lines(docs, names=(lines, removed))
    emptied = (F.col(removed) > 0) & (F.trim("text", F.lit(SPACE)) == "")
    out = out.filter(~emptied)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each group of near-duplicates; documents without links, null and empty texts stay.

    Rows that agree in identifier and text are dropped or stay together.
    """
    ship(spark)
    gone, same = _same(docs, near_duplicates(docs.select("doc_id", "text"), k=SHINGLE, percent=PERCENT).filter(~F.col("kept")).select("doc_id", "text_hash"))
    return docs.join(gone, same, "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark of ``sf_dir``; null and empty texts stay."""
    ship(spark)
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document, with their inclusion scores; null and empty texts have one empty segmentation."""
    ship(spark)
    return sampled_segmentations(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("encoding", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ``sf_dir`` through all stages; each stage's rows are written and read again, those before them deleted."""
    steps, docs, last = Steps(spark), spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = steps.stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            steps.drop(last)
        last = docs
    return docs
