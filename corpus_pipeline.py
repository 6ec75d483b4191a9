"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, mixing. Counted as part of vecforge.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecforge.llm import decontaminate, langid, linededup, minhash, mixing
from vecforge.llm.common import release, save, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those the language model is unsure of."""
    return langid.keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later matches of lines; a document that loses its last line goes."""
    return linededup.remove_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays: the smallest doc_id."""
    return minhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the rate at which to draw each."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


STAGES = [("language", language), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontaminate", benchmark), ("mixing", mixture)]

#: Trained networks, similarity joins with a learned order and least squares are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all STAGES, each written and read again; a stage's input is deleted once its output is written.

    Null and empty texts and texts without letters go in the first stage; very long texts are handled whole; of rows that repeat a doc_id
    one stays; rows with a null doc_id are nobody's duplicate; columns beside doc_id and text are carried along, also those whose
    names clash with columns that a stage makes for itself (those of the last stage's results are replaced); empty tables give an empty table.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = save(stage(spark, docs, sf_dir), name)
        release(docs)
        docs = out
    return docs
