"""Pairs worth comparing: alike by signature, or close in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepset.functions import scalars as S
from keepset.operators.ordering import islands, numbered
from keepset.runtime import Scratch, ship

#: Agreement 0.30 of 63 signs is at most 22 differing bits; neighbours a record keeps; records of a burst; rows looked ahead.
APART, CAP, LARGEST_BURST, AHEAD = 22, 60, 500, 100
#: Signatures of one block; a task compares two blocks at a time.
BLOCK = 4096


def lookalikes(records: DataFrame, limit: int = APART, block: int = BLOCK) -> DataFrame:
    """(a, b, distance) of all pairs a < b whose signatures differ in at most `limit` bits. records: id long, bits long.

    The limit is too loose for any key to find such pairs, so all blocks meet: each record goes to one cell for each other block,
    and a cell's signatures are compared in array operations; only pairs that pass become rows.
    """
    ship(records.sparkSession)
    blocks = max(1, -(-records.count() // block))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks))
    dealt = records.select("id", "bits", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("with"))
    cells = dealt.select("id", "bits", "own", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"))

    def compared(key, table):
        import numpy as np
        import pyarrow as pa

        low, high = (x.as_py() for x in key)
        ids, bits, own = (table.column(c).to_numpy() for c in ("id", "bits", "own"))
        order = np.argsort(ids, kind="stable")
        ids, bits, own = ids[order], bits[order].view(np.uint64), own[order]
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        out: list[list] = [[], [], []]
        for i in left.tolist():
            others = right if low != high else right[right > i]
            distance = np.bitwise_count(bits[others] ^ bits[i])
            near = distance <= limit
            out[0].append(np.minimum(ids[others[near]], ids[i]))
            out[1].append(np.maximum(ids[others[near]], ids[i]))
            out[2].append(distance[near].astype(np.int32))
        a, b, d = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "distance": pa.array(d, pa.int32())})

    return cells.groupBy("low", "high").applyInArrow(compared, "a long, b long, distance int")


def both_ways(pairs: DataFrame) -> DataFrame:
    """(src, dst, distance) in both directions."""
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "distance").union(pairs.select("b", "a", "distance"))


def closest(pairs: DataFrame, cap: int = CAP) -> DataFrame:
    """Each record's list of at most `cap` closest others, ties by id; lists are directed once they are capped."""
    order = Window.partitionBy("src").orderBy("distance", "dst")
    return both_ways(pairs).withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap)


def bursts(records: DataFrame, scratch: Scratch, gap: float = S.BURST_GAP) -> DataFrame:
    """records (id, t) with `island`, a burst of records each at most `gap` seconds after the one before."""
    rows = numbered(records, scratch, "burst_rows", "t", "id")
    return islands(rows, scratch, "burst_islands", F.col("t") - F.col("previous.t") > gap)


def burst_pairs(records: DataFrame, scratch: Scratch, gap: float = S.BURST_GAP, largest: int = LARGEST_BURST) -> DataFrame:
    """(a, b): all pairs within bursts of 2 to `largest` records."""
    rows = bursts(records, scratch, gap)
    sizes = rows.groupBy("island").count().where((F.col("count") >= 2) & (F.col("count") <= largest)).select("island")
    rows = rows.join(sizes, "island").select("island", "id")
    return rows.alias("x").join(rows.alias("y"), (F.col("x.island") == F.col("y.island")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def window_pairs(records: DataFrame, scratch: Scratch, window: float = S.WINDOW, ahead: int = AHEAD) -> DataFrame:
    """(a, b): a record and each of the next `ahead` in time order that is at most `window` seconds later.

    An equi-join on bins of the row's position: partners are at most `ahead` places on, so in the same bin or the next.
    """
    rows = numbered(records, scratch, "window_rows", "t", "id").select("id", "t", "position")
    place = F.floor(F.col("position") / ahead)
    left = rows.select(F.col("id").alias("a"), F.col("t").alias("t_a"), F.col("position").alias("p_a"), F.explode(F.array(place, place + 1)).alias("bin"))
    right = rows.select(F.col("id").alias("b"), F.col("t").alias("t_b"), F.col("position").alias("p_b"), place.alias("bin"))
    near = (left["bin"] == right["bin"]) & (F.col("p_b") > F.col("p_a")) & (F.col("p_b") - F.col("p_a") <= ahead) & (F.col("t_b") - F.col("t_a") <= window)
    return left.join(right, near).select("a", "b")


def unordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def tally(look: DataFrame, time: DataFrame) -> DataFrame:
    """via (look, time or both) and pairs."""
    every = look.select("a", "b", F.lit(1).alias("look"), F.lit(0).alias("time")).union(time.select("a", "b", F.lit(0), F.lit(1)))
    found = every.groupBy("a", "b").agg(F.max("look").alias("look"), F.max("time").alias("time"))
    via = F.when(F.col("look") + F.col("time") == 2, "both").when(F.col("look") == 1, "look").otherwise("time")
    return found.groupBy(via.alias("via")).agg(F.count(F.lit(1)).alias("pairs"))
