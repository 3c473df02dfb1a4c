import pytest
from pyspark.sql import functions as F

from keepset.operators import ladder

SCHEMA = "g int, " + ", ".join(f"{r} int" if r != "path" else "path string" for r in ladder.RUNGS)


def record(**changes):
    base = {r: 1 for r in ladder.RUNGS} | {"path": "a"} | changes
    return (1, *(base[r] for r in ladder.RUNGS))


@pytest.mark.parametrize("rung,phrase", ladder.LADDER[:-1])
def test_each_rung_decides_over_all_below(spark, scratch, rung, phrase):
    below = ladder.RUNGS[ladder.RUNGS.index(rung) + 1 :]
    worse = record(**{rung: 0}, **{r: 9 if r != "path" else "z" for r in below})
    rows = spark.createDataFrame([worse, record()], SCHEMA)
    best = ladder.ranked(rows, "g", scratch).where("rank = 1").first()
    assert best[rung] == 1
    joined = rows.where(F.col(rung) == 0).join(ladder.keepers(rows, "g"), "g")
    assert joined.select(ladder.why_inferior(F.col("keeper"), F.struct(*ladder.RUNGS))).first()[0] == phrase


def test_path_decides_a_full_tie(spark, scratch):
    rows = spark.createDataFrame([record(path="a"), record(path="b")], SCHEMA)
    assert ladder.ranked(rows, "g", scratch).where("rank = 1").first()["path"] == "b"
    joined = rows.where("path = 'a'").join(ladder.keepers(rows, "g"), "g")
    assert joined.select(ladder.why_inferior(F.col("keeper"), F.struct(*ladder.RUNGS))).first()[0] == ladder.TIE


def _lazy(spark, scratch, again):
    rows = spark.createDataFrame([record(path="a", upright=1), record(path="b", upright=0), record(path="c", pixels=0)], SCHEMA).drop("once")
    seen = spark.sparkContext.accumulator(0)
    out = ladder.lazily_ranked(rows, "g", scratch, lambda t: t.withColumn("again", F.col("path").isin(*again)))
    return [r["path"] for r in out.orderBy("rank").collect()], out.where("probed").count(), seen


def test_lazy_rung_demotes_a_proven_resave(spark, scratch):
    order, probed, _ = _lazy(spark, scratch, ["a"])
    assert order == ["b", "a", "c"] and probed == 2


def test_lazy_rung_changes_nothing_if_all_are_proven(spark, scratch):
    assert _lazy(spark, scratch, ["a", "b"])[0] == ["a", "b", "c"]


def test_ranks_within_keys_of_all_sizes(spark, scratch):
    """One key holds most rows, one is null; ranks are those of a sorted list."""
    from keepset.operators import ordering

    rows = [("hot" if i % 5 else None if i % 2 else f"k{i % 3}", (i * 7919) % 1009, i) for i in range(900)]
    placed = ordering.placed(spark.createDataFrame(rows, "k string, v int, id int"), scratch, "placed", "k", F.col("v").desc(), "id")
    got = {r["id"]: (r["rank"], r["group_size"]) for r in placed.collect()}
    want = {}
    for key in {k for k, _, _ in rows}:
        own = sorted((-v, i) for k, v, i in rows if k == key)
        want |= {i: (n, len(own)) for n, (_, i) in enumerate(own, 1)}
    assert got == want
