"""Exact histogram of encoded lengths, and what suffix sums over it answer (operator 8).

A length counts a document's ids without an end id; texts of any length are encoded whole. Null texts have length 0, as empty ones; repeated rows count each; an empty
table gives an empty histogram, whose totals are 0 and whose quantiles are null. Other columns than text are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keepset.llm.tokens import encoder, slices, vocabulary
from keepset.runtime import Scratch, ship, tidy

#: Lengths of one range are summed in one task; the ranges' own sums are few.
RANGE = 64


def length_histogram(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """n_tokens and n_docs, one row per length; counted within each task before the shuffle."""
    ship(docs.sparkSession)

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        library, counts = encoder(vocabulary_path), Counter()
        for batch in batches:
            for part in slices(batch):
                counts.update(len(x) // 4 for x in library.encode(part.column("text").to_pylist(), None))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["n_tokens", "n_docs"])

    return docs.select("text").mapInArrow(tidy(counted), "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit: documents and tokens of at least that length, documents cut by the
    limit, tokens that are left under it, and the share of documents that stay whole.

    The histogram is read several times, so it should be a written table.
    Between two lengths the tokens left grow by docs_at_least of the next length for each step of the limit.
    """
    n, tokens = F.col("n_docs"), F.col("n_docs") * F.col("n_tokens")
    ranged = histogram.withColumn("range", F.floor(F.col("n_tokens") / RANGE)).withColumn("tokens", tokens)
    later = W.orderBy(F.col("range").desc()).rowsBetween(W.unboundedPreceding, -1)
    ranges = ranged.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    whole = W.partitionBy()  # a row a range
    ranges = ranges.select(
        "range",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_after"),
        F.sum("d").over(whole).alias("all_docs"),
        F.sum("t").over(whole).alias("all_tokens"),
    )
    within = W.partitionBy("range").orderBy(F.col("n_tokens").desc())
    out = ranged.join(ranges, "range").select(
        "n_tokens",
        "n_docs",
        (F.col("docs_after") + F.sum(n).over(within)).alias("docs_at_least"),
        (F.col("tokens_after") + F.sum("tokens").over(within)).alias("tokens_at_least"),
        "all_docs",
        "all_tokens",
    )
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("docs_at_least") - n).alias("docs_truncated"),
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("tokens_kept"),
        ((F.col("all_docs") - F.col("docs_at_least") + n) / F.col("all_docs")).alias("share_docs_whole"),
    )


def _list_of(sums: DataFrame, given: list, of: str, columns: dict) -> DataFrame:
    """One row per given value; columns: name -> aggregate for a value. One aggregation for all values."""
    rows = sums.agg(*(make(x).alias(f"{name}{i}") for i, x in enumerate(given) for name, make in columns.items()))
    each = (F.struct(F.lit(x).alias(of), *(F.col(f"{name}{i}").alias(name) for name in columns)) for i, x in enumerate(given))
    return rows.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_truncated and tokens_kept for each limit, from the first length above it."""
    above = lambda c: lambda x: F.coalesce(F.min_by(c, F.when(F.col("n_tokens") > x, F.col("n_tokens"))), F.lit(0).cast("long"))
    found = _list_of(sums, [int(x) for x in limits], "limit", {"docs_truncated": above("docs_at_least"), "above": above("tokens_at_least"), "total": lambda _: F.coalesce(F.max("tokens_at_least"), F.lit(0).cast("long"))})
    return found.select("limit", "docs_truncated", (F.col("total") - F.col("above") + F.col("limit") * F.col("docs_truncated")).alias("tokens_kept"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """For each share the smallest length that at least that share of the documents does not exceed."""
    return _list_of(sums, [float(x) for x in shares], "share", {"n_tokens": lambda q: F.min(F.when(F.col("share_docs_whole") >= q, F.col("n_tokens")))})


def op8_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    histogram = length_histogram(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_50k.json"))
    return suffix_sums(Scratch(spark, "op8").table(histogram, "histogram"))
