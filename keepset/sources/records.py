"""The persisted records as CSV files: fixed columns, tolerant reading, append-only writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of each record, in their order.
SCHEMAS = {
    "plan": "file string, verdict string, group int, group_size int, why string, dimensions string, compression_tier int, sharpness double, MB double, taken double, margin double, block_pct double, ratio double, shift double, zoom double, why_inferior string",
    "log": "moved_at string, from string, to string, why string, kept_instead string, MB double",
    "review": "judged_at string, setting string, action string, group string, file string, planned string, you_said string, why string, difference double, reason string",
    "labels": "date string, job string, round string, group string, file string, planned string, you_said string, why string, difference string, reason string, outcome string",
    "verdicts": "file_a string, file_b string, scene string, block double, ratio double, shift double, zoom double, rot double, b_in_a double, a_in_b double, lum_off double, contrast double",
    "audit": "file_a string, file_b string",
    "fates": "file_a string, file_b string, stage string, detail string",
}


def names(kind: str) -> list[str]:
    return [x.split()[0] for x in SCHEMAS[kind].split(", ")]


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of a record; empty strings and numbers that do not parse are null."""
    ddl = ", ".join(f"`{x.split()[0]}` {x.split()[1]}" for x in SCHEMAS[kind].split(", "))
    return spark.read.schema(ddl).option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", True).csv(path)


def has_columns(spark: SparkSession, path: str, kind: str) -> bool:
    """Whether a file's header is that of the record; one with another header is set aside, never mixed in."""
    first = spark.read.text(path).limit(1).collect()
    return bool(first) and first[0][0].strip().lstrip("﻿").split(",") == names(kind)


def write(df: DataFrame, path: str, kind: str, append: bool = False) -> None:
    """The record's columns in their order; columns that df lacks are empty."""
    columns = [F.col(f"`{n}`") if n in df.columns else F.lit(None).cast("string").alias(n) for n in names(kind)]
    df.select(*columns).write.mode("append" if append else "overwrite").option("header", True).csv(path)


def fold_ledger(review: DataFrame, job: str, date: str, outcome: str) -> DataFrame:
    """Ledger rows of a job's review: only each round's last pass when it was applied, every pass when it was undone."""
    from keepset.operators.journal import last_pass

    rows = last_pass(review, "setting") if outcome == "applied" else review
    return rows.select(F.lit(date).alias("date"), F.lit(job).alias("job"), F.col("setting").alias("round"), "group", "file", "planned", "you_said", "why", F.col("difference").cast("string").alias("difference"), "reason", F.lit(outcome).alias("outcome"))


def retract(ledger: DataFrame, job: str) -> DataFrame:
    """The ledger without the rows that a job's apply had added."""
    return ledger.where(~((F.col("job") == job) & (F.col("outcome") == "applied")))
