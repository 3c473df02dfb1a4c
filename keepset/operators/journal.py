"""Plan, journal, review and ledger: every decision is a row, and what was done can be undone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepset.operators import ladder
from keepset.operators.rules import SETTLED

KEEP, REDUNDANT = "KEEP", "REDUNDANT"


def manifest(ranked: DataFrame) -> DataFrame:
    """Ranked records (rank, group_size) with verdict; groups of one are left out."""
    verdict = F.when(F.col("rank") == 1, KEEP).otherwise(REDUNDANT)
    return ranked.where("group_size >= 2").withColumn("verdict", verdict)


def marked(records: DataFrame, group: str, rungs: tuple[str, ...]) -> DataFrame:
    """As manifest(), without ranks below the first: keepers come from partial maxima, so a group of any size is neither sorted nor
    brought to one task. The rungs must tell a group's records apart."""
    best = ladder.keepers(records, group, rungs).where("group_size >= 2")
    verdict = F.when(F.struct(*rungs) == F.col("keeper"), KEEP).otherwise(REDUNDANT)
    return records.join(best, group).withColumn("verdict", verdict).drop("keeper")


def apply_plan(plan: DataFrame, settled_only: bool = True, reasons: tuple[str, ...] = SETTLED) -> DataFrame:
    """Redundant rows with kept_instead, their group's keeper. plan: file, verdict, group, why.

    settled_only: leave rows alone whose reason is no proof; otherwise all redundant rows go.
    """
    keepers = plan.where(F.col("verdict") == KEEP).select("group", F.col("file").alias("kept_instead"))
    leaving = plan.where(F.col("verdict") == REDUNDANT)
    if settled_only:
        leaving = leaving.where(F.col("why").isin(*reasons))
    return leaving.join(keepers, "group", "left")


def free_name(path: Column, taken: Column) -> Column:
    """path with " (k)" before its extension where k - 1 rows before it want the same name; taken: 1 for the first."""
    suffix = F.concat(F.lit(" ("), taken.cast("string"), F.lit(")"))
    return F.when(taken <= 1, path).otherwise(F.concat(F.regexp_replace(path, r"(\.[^./]+)$", ""), suffix, F.regexp_extract(path, r"(\.[^./]+)$", 1)))


def undo_status(log: DataFrame, present: DataFrame) -> DataFrame:
    """What undoing each log row would do. log: from, to; present: path."""
    there = present.select("path").distinct()
    source = there.select(F.col("path").alias("to"), F.lit(True).alias("moved_there"))
    target = there.select(F.col("path").alias("from"), F.lit(True).alias("taken"))
    joined = log.join(source, "to", "left").join(target, "from", "left")
    status = F.when(F.col("moved_there").isNull(), "missing").when(F.col("taken"), "occupied").otherwise("restored")
    return joined.withColumn("status", status).drop("moved_there", "taken")


def last_pass(review: DataFrame, key: str) -> DataFrame:
    """The rows of each key's last pass. review: key, judged_at."""
    last = F.max("judged_at").over(Window.partitionBy(key))
    return review.withColumn("last", last).where(F.col("judged_at") == F.col("last")).drop("last")


def revise(plan: DataFrame, answers: DataFrame) -> DataFrame:
    """plan (file, group, verdict, why) after answers (file, keep): unanswered rows keep the plan, flips to redundant get a reason."""
    joined = plan.join(answers.select("file", "keep"), "file", "left")
    verdict = F.when(F.col("keep").isNull(), F.col("verdict")).when(F.col("keep"), KEEP).otherwise(REDUNDANT)
    why = F.when((verdict == REDUNDANT) & (F.col("verdict") == KEEP), "near-duplicate").when(verdict == KEEP, F.lit("")).otherwise(F.col("why"))
    return joined.select("file", "group", verdict.alias("verdict"), why.alias("why"))


def unkept(scenes: DataFrame, reviewed: DataFrame, kept: DataFrame) -> DataFrame:
    """Members of reviewed scenes that nobody kept. Scenes without review lose nothing."""
    return scenes.join(reviewed.select("scene").distinct(), "scene", "left_semi").join(kept.select("scene", "file"), ["scene", "file"], "left_anti").withColumn("why", F.lit("one of many"))


def kept_by_review(members: DataFrame, shown: DataFrame, kept: DataFrame) -> DataFrame:
    """What stays: whatever was kept, and whatever was never shown."""
    unseen = members.join(shown, "file", "left_anti").select("file")
    return unseen.union(kept.select("file")).distinct()


def audit(pairs: DataFrame, stages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Watched pairs (a, b) with the last stage that saw them, else "never proposed", and `settled` if either side was culled."""
    unordered = lambda df, *more: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *more)
    seen = unordered(stages, "stage", "step").groupBy("a", "b").agg(F.max_by("stage", "step").alias("stage"))
    culled = outcomes.where("culled").select("file").distinct()
    out = unordered(pairs).distinct().join(seen, ["a", "b"], "left").withColumn("stage", F.coalesce("stage", F.lit("never proposed")))
    for side in ("a", "b"):
        out = out.join(culled.select(F.col("file").alias(side), F.lit(True).alias(f"{side}_culled")), side, "left")
    return out.select("a", "b", "stage", F.coalesce(F.col("a_culled"), F.col("b_culled"), F.lit(False)).alias("settled"))
