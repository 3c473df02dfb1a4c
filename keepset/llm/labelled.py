"""Bounded samples of labelled documents, for models that are fitted on the driver.

A sample's size is a parameter: the ids come from the labels alone, in the order of a hash, and only that many rows reach the
driver; documents are then read with a filter of that many ids, without a shuffle of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chosen(labels: DataFrame, label: str, rows: int, where: Column | None = None, by_class: bool = False) -> list[tuple[int, int]]:
    """(doc_id, label 0 or 1) of at most `rows` labelled ids, or so many of each class.

    Rows whose id or label is null are left out. An id that is labelled twice has its smallest label.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    if where is not None:
        usable = usable.where(where)
    usable = usable.groupBy("doc_id").agg(F.min("label").alias("label"))
    parts = [usable.where(F.col("label") == x) for x in (0, 1)] if by_class else [usable]
    return [tuple(r) for x in parts for r in x.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()]


def read(docs: DataFrame, *ids: list[tuple[int, int]]) -> DataFrame:
    """doc_id, text, label and part (which list it is of) of the chosen ids, in one pass over the documents.

    An id that documents hold twice comes twice.
    """
    rows = [(doc, label, part) for part, own in enumerate(ids) for doc, label in own]
    known = docs.sparkSession.createDataFrame(rows, "doc_id long, label int, part int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(known), "doc_id")  # as many ids as the samples' bounds allow


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, where: Column | None = None, by_class: bool = False) -> DataFrame:
    """doc_id, text and label of at most `rows` labelled documents, or so many of each class; see chosen()."""
    return read(docs, chosen(labels, label, rows, where, by_class)).drop("part")
