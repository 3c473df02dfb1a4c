"""Keeper ranking: rungs declared once, from which both the order and the loser's phrase come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepset.operators.ordering import placed
from keepset.runtime import Scratch

#: The rungs, best first (a larger value wins), and what is said of the record that loses on one.
LADDER = (
    ("motion", "no Live Photo video"),
    ("raw", "not the raw"),
    ("real", "the blurred background is the camera's invention"),
    ("pixels", "fewer pixels"),
    ("unedited", "something wrote it after the camera did"),
    ("camera", "the camera's own marks are gone"),
    ("merged", "the camera merged a better exposure than this one"),
    ("once", "it has been saved a second time"),
    ("upright", "something turned it and reset the flag"),
    ("finer", "more compressed"),
    ("metadata", "less metadata"),
    ("tier", "much more compressed"),
    ("sharp", "less sharp"),
    ("bytes", "smaller file"),
    ("path", None),
)
RUNGS = tuple(name for name, _ in LADDER)
UPPER, LOWER = RUNGS[: RUNGS.index("once")], RUNGS[RUNGS.index("once") + 1 :]
#: What is said when only the path differs.
TIE = "the same by every measure"


def best_first(rungs: tuple[str, ...] = RUNGS) -> list[Column]:
    return [F.col(r).desc() for r in rungs]


def ranked(records: DataFrame, group: str, scratch: Scratch, rungs: tuple[str, ...] = RUNGS) -> DataFrame:
    """rank, 1 for the record of its group that is kept, and group_size. A large group is sorted by many tasks."""
    return placed(records, scratch, "ladder", group, *best_first(rungs))


def keepers(records: DataFrame, group: str, rungs: tuple[str, ...] = RUNGS) -> DataFrame:
    """group and keeper (a struct of the rungs): one row a group, found by partial maxima, so a large group is not sorted."""
    return records.groupBy(group).agg(F.max(F.struct(*rungs)).alias("keeper"), F.count(F.lit(1)).alias("group_size"))


def why_inferior(keeper: Column, other: Column, rungs: tuple[str, ...] = RUNGS) -> Column:
    """The phrase of the first rung on which the two differ."""
    out = None
    for name, phrase in LADDER:
        if name in rungs and phrase:
            differs = ~keeper[name].eqNullSafe(other[name])
            out = F.when(differs, phrase) if out is None else out.when(differs, phrase)
    return out.otherwise(TIE)


def lazily_ranked(records: DataFrame, group: str, scratch: Scratch, probe) -> DataFrame:
    """ranked() with the rung `once` read only where it can decide: among records that tie for best on the rungs above it.

    probe(records) returns them with `again`, true if a record has been saved a second time. All others count as saved once.
    """
    upper = F.struct(*UPPER)
    best = records.groupBy(F.col(group).alias("best_of")).agg(F.max(upper).alias("best"))
    tops = records.select(group, upper.alias("own")).join(best, F.col(group).eqNullSafe(F.col("best_of")) & (F.col("own") == F.col("best")))
    tied = scratch.table(tops.groupBy("best_of", "best").count().where("count > 1").drop("count"), "ladder_tied")
    marked = records.join(tied, F.col(group).eqNullSafe(F.col("best_of")), "left")
    marked = marked.withColumn("probed", F.coalesce(upper == F.col("best"), F.lit(False))).drop("best_of", "best")
    read = probe(marked.where("probed"))
    once = F.when(F.col("again"), 0).otherwise(1).alias("once")
    every = read.select(*marked.columns, once).unionByName(marked.where(~F.col("probed")).withColumn("once", F.lit(1)))
    return ranked(scratch.table(every, "ladder_read"), group, scratch, tuple(r for r in RUNGS if r in every.columns))
