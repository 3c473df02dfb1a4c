"""From documents to packed training sequences: quality rules, line dedup, near-duplicates, decontamination, packing.

Each stage is a function of (session, documents, folder of the tables); its rows are written before the next stage reads them. Stages
take documents with any further columns, whatever their names, and all but the last return the same columns. Null texts count as
empty. Texts of any length are read whole. Repeated rows and ids are judged each; empty tables give empty results.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

from keepset.llm import lines, packing, quality, simhash, templates
from keepset.llm.tokens import vocabulary
from keepset.runtime import Scratch

_LAST = threading.local()  # the scratch tables that this thread's last stage still reads


def _scratch(spark: SparkSession, name: str) -> Scratch:
    """A stage's own scratch tables; those of the stage before it, whose rows are written by now, go."""
    if getattr(_LAST, "scratch", None) is not None:
        _LAST.scratch.release()
    _LAST.scratch = Scratch(spark, name)
    return _LAST.scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the model fitted on this folder's labels.

    Null and empty texts fail the base rules. Without labels of both classes the base rules decide alone.
    """
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has, equal or with two edits at most.

    All rows stay, with a null text as it is; of rows with equal ids none loses lines over another.
    """
    return lines.dedup_lines(docs, _scratch(spark, "lines"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Texts without words are one group. Rows with a null id stay; rows that repeat the kept id stay with it.
    """
    return simhash.keep_one(docs, _scratch(spark, "simhash"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a template window of a benchmark item. An item without tokens matches nothing."""
    return templates.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), _scratch(spark, "templates"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences. An empty text is its end id alone."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), end=2)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]
#: Models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    between, docs, before = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = between.table(stage(spark, docs, sf_dir), name)
        if before:
            between.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
