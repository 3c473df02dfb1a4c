"""Connected components of a table of links, without collecting them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepset.runtime import Scratch

#: Alternating star rounds at most; they take about the logarithm of the longest shortest path.
ROUNDS = 60


def components(links: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """links: (a, b) of one comparable type. Returns (a, b): every node that is not its component's smallest, and the smallest.

    Rounds of large-star and small-star, each written to the shared folder and read back, until all components are stars. Links
    to itself, repeated and null ones do not count.
    """
    a, b = F.col("a"), F.col("b")
    links = links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    stars = scratch.table(links, f"{name}-0")
    for k in range(1, ROUNDS + 1):
        uses = stars.select(a.alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(stars.select(b, F.lit(0), F.lit(1)))
        unfinished = uses.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or (below = 1 and above = 1)")
        if unfinished.isEmpty():
            return stars
        both = stars.union(stars.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.table(large, f"{name}-{k}-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b")).union(least).distinct()
        stars = scratch.table(small, f"{name}-{k}")
        scratch.drop(f"{name}-{k}-large")
        scratch.drop(f"{name}-{k - 1}")
    raise RuntimeError(f"components: not done after {ROUNDS} rounds")
