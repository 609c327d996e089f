"""Corpus pipeline: documents to a mixed training set, in five stages of lattica.llm's operators.

Each stage works on all rows that its predecessor kept and is written and read again by its caller;
all but the last return the columns of documents. ``run`` applies them in order. Other columns of ``docs``, whatever
their names, go. An empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontaminate, lines, mixing, near, quality
from lattica.llm.common import cut, drop, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Differing bits up to which fingerprints link.
FINGERPRINT_BITS = 4


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects.

    Null and empty texts have weight 0, as texts that the models don't tell apart; rows of one id have equal keys, so
    repeated rows go or stay together, and ties at the cut stay. Without labelled good rows all stay.
    """
    found = quality.importance(docs, table(spark, sf_dir, "labels"), columns=COLUMNS)
    return found.where("selected").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier one, exactly or within two edits; texts left without any line go.

    Null and empty texts stay as they are. Repeated whole rows keep the same lines. Rows of a null id come before all
    others, rows of one id are ordered by a hash of the text. n_chars is counted anew, null for a null text.
    """
    found = lines.dedup(docs.select(*COLUMNS))
    emptied = (F.col("_lines") > 0) & (F.col("_exact") + F.col("_near") >= F.col("_lines"))
    return found.where(~emptied).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies.

    Near copies are texts whose SimHash fingerprints differ in at most FINGERPRINT_BITS bits (operator 8), and those of
    like shingle sets, which fingerprints alone would miss; groups close over both.
    Null and empty texts are one text, of which one row stays. Repeated rows of the smallest id become one. A group
    without ids keeps one of its rows.
    """
    return near.keep_one(docs.select(*COLUMNS), radius=FINGERPRINT_BITS).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item.

    Null and empty texts hold none. Repeated rows go or stay together. Null items, and items without a word, match nothing.
    """
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the words that the mix takes of each, repeats counted.

    Null and empty texts have no words and none is taken; a null source is a source of its own, the last; a null id
    counts as an empty one; repeated rows are rows of their own, of which each gives the same.
    """
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS, "size", "source_size", "target", "taken")


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixture", mixture),
]

#: Importance resampling, the edit join and fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
