"""Content-keyed, versioned memory of what was computed: a Parquet table, looked up by join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(cache: DataFrame, key: list[str], version: int) -> DataFrame:
    """The newest row of each key at that version. cache: key columns, version, stored_at and values."""
    newest = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("stored_at").desc()))
    return cache.where(F.col("version") == version).withColumn("place", newest).where("place = 1").drop("place")


def split(records: DataFrame, cache: DataFrame, key: list[str], version: int) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached values, misses)."""
    known = latest(cache, key, version)
    return records.join(known, key), records.join(known.select(*key), key, "left_anti")


def filled(records: DataFrame, cache: DataFrame, key: list[str], version: int, compute: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """records with their values; misses are computed once a key and appended to the table at path.

    Rows that computation marks with an error are neither stored nor returned as values.
    """
    hits, misses = split(records, cache, key, version)
    new = compute(misses.dropDuplicates(key)).withColumn("version", F.lit(version)).withColumn("stored_at", F.current_timestamp())
    good = new.where("error is null").drop("error") if "error" in new.columns else new
    good.select(*cache.columns).write.mode("append").parquet(path)
    stored = records.sparkSession.read.schema(cache.schema).parquet(path)
    return hits.unionByName(misses.join(latest(stored, key, version), key))
