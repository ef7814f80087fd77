"""A corpus pipeline: quality rules, near-dedup, decontamination, personal data, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import decontaminate, fertility, near_dup, pareto_mix, pii_crf
from lexmill.llm._frame import fresh_path, scratch
from lexmill.sources.shared import remove


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose tokeniser fertility is out of the bands."""
    return fertility.drop_unusual(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the least doc_id."""
    return near_dup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without benchmark passages, and without documents that are mostly benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With personal data and secrets replaced by their labels."""
    return pii_crf.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with as many rows as come in, every source alike; copy numbers the copies of a document. Where the documents
    have a column of that name, in whatever case, the new one's has underscores behind it."""
    name, taken = "copy", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return pareto_mix.pareto_mix(docs).toDF(*docs.columns, name)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("mixing", mixing)]

#: The tokenisers, minima and marginals of the first stages are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's rows are written to the shared folder and read again by the next; what a stage
    stored on its way is deleted when its rows are written, and its rows when the next stage's are.

    Nulls, empty and long texts, ties and repeated rows are as the stages' operators say; an empty table goes through all
    of them and stays empty; extra columns stay.
    """
    path, docs = None, spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, path = path, fresh_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
    return docs
