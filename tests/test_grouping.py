"""Grouping, candidates, scenes, cascade and signals against plain sequential versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepset.operators import candidates, cascade, grouping, ordering, scenes, signal


def _sweep(order, lists):
    leader = {}
    for r in order:
        if r in leader:
            continue
        leader[r] = r
        for x in lists.get(r, ()):
            leader.setdefault(x, r)
    return leader


@pytest.mark.parametrize("seed", range(4))
def test_star_groups_equal_the_sweep(spark, scratch, seed):
    rng = random.Random(seed)
    n = 60
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(120)}
    edges = {(a, b) for a, b in edges if a != b}
    rank = list(range(1, n + 1))
    rng.shuffle(rank)
    records = spark.createDataFrame(list(enumerate(rank)), "id long, rank long")
    got = dict(map(tuple, grouping.star_groups(records, spark.createDataFrame(sorted(edges), "src long, dst long"), scratch).collect()))
    lists = {}
    for a, b in edges:
        lists.setdefault(a, set()).add(b)
    assert got == _sweep(sorted(range(n), key=lambda i: rank[i]), lists)


@pytest.mark.parametrize(("n", "few"), [(5000, grouping.FEW), (12, 0)])
def test_star_groups_of_a_chain(spark, scratch, n, few):
    """Each record sees the next: every other one leads, however long the chain."""
    records = spark.range(n).select("id", (F.col("id") + 1).alias("rank"))
    edges = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = dict(map(tuple, grouping.star_groups(records, edges, scratch, few=few).collect()))
    assert got == {i: i - i % 2 for i in range(n)}


def test_star_not_chain(spark, scratch):
    records = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id long, rank long")
    both = [(1, 2), (2, 1), (2, 3), (3, 2)]
    got = dict(map(tuple, grouping.star_groups(records, spark.createDataFrame(both, "src long, dst long"), scratch).collect()))
    assert got == {1: 1, 2: 1, 3: 3}


def test_only_the_better_ones_list_counts(spark, scratch):
    records = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank long")
    got = dict(map(tuple, grouping.star_groups(records, spark.createDataFrame([(2, 1)], "src long, dst long"), scratch).collect()))
    assert got == {1: 1, 2: 2}


def test_twins_follow_their_best(spark, scratch):
    records = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "id long, rank long")
    twins = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id long, key string")
    got = dict(map(tuple, grouping.star_groups(records, spark.createDataFrame([(1, 3)], "src long, dst long"), scratch, twins).collect()))
    assert got == {1: 2, 2: 2, 3: 2}


def test_lookalikes_over_several_blocks(spark):
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 1 << 63, 90, dtype=np.int64)
    bits[40:60] = bits[:20] ^ 5
    rows = spark.createDataFrame([(i, int(b)) for i, b in enumerate(bits)], "id long, bits long")
    want = {(i, j, int(bits[i] ^ bits[j]).bit_count()) for i in range(90) for j in range(i + 1, 90) if int(bits[i] ^ bits[j]).bit_count() <= 22}
    assert {tuple(r) for r in candidates.lookalikes(rows, 22, block=20).collect()} == want


def test_burst_bounds(spark, scratch):
    times = [0.0, 3.0, 6.001, 6.001, 20.0] + [100.0 + k for k in range(5)]
    rows = spark.createDataFrame(list(enumerate(times)), "id long, t double")
    got = {tuple(r) for r in candidates.burst_pairs(rows, scratch, largest=4).collect()}
    assert got == {(0, 1), (2, 3)}


def test_window_bounds(spark, scratch):
    rows = spark.createDataFrame([(0, 0.0), (1, 60.0), (2, 60.001)] + [(10 + k, 1000.0) for k in range(8)], "id long, t double")
    got = {tuple(r) for r in candidates.window_pairs(rows, scratch, ahead=5).collect()}
    want = {(0, 1), (1, 2)} | {(10 + i, 10 + j) for i in range(8) for j in range(i + 1, 8) if j - i <= 5}
    assert got == want


def test_numbers_follow_the_order(spark, scratch):
    values = list(range(500))
    random.Random(1).shuffle(values)
    rows = spark.createDataFrame([(v,) for v in values], "v long").repartition(6)
    assert all(r["v"] == r["position"] for r in ordering.numbered(rows, scratch, "n", "v").collect())


def test_shoot_bounds(spark):
    rows = spark.createDataFrame([(1, 0.0, 1), (1, 5400.0, 2), (1, 10800.001, 3)], "u int, t double, id long")
    assert [r["shoot"] for r in scenes.shoots(rows, "u").orderBy("id").collect()] == [1, 1, 2]


def _grown(looks, alike):
    """The same rules as a plain loop."""
    found, waiting = [], list(range(len(looks)))
    middle = lambda own: (lambda c: c / np.linalg.norm(c) if np.linalg.norm(c) else c)(looks[own].mean(axis=0))
    while len(waiting) >= 2:
        own, centre = [waiting.pop(0)], None
        centre = looks[own[0]]
        while True:
            best, score = None, alike
            for c in waiting:
                if looks[c] @ centre >= score:
                    best, score = c, looks[c] @ centre
            if best is None:
                break
            waiting.remove(best)
            own.append(best)
            centre = middle(own)
        if len(own) >= 2:
            found.append(sorted(own))
    return found


def test_scenes_equal_the_loop(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(4, 12))
    vectors = np.concatenate([b + 0.5 * rng.normal(size=(8, 12)) for b in base])
    rng.shuffle(vectors)
    looks = scenes._look(vectors)
    assert scenes.grown(looks, 0.6, join=False) == _grown(looks, 0.6)
    rows = spark.createDataFrame([(1, i, float(i), v.tolist()) for i, v in enumerate(vectors)], "s int, id long, t double, vector array<double>")
    got = {}
    for _, k, i in scenes.scenes(rows, "s", 0.6, join=False).collect():
        got.setdefault(k, []).append(i)
    assert sorted(map(sorted, got.values())) == sorted(_grown(looks, 0.6))


def _circle(*degrees):
    return np.array([[math.cos(math.radians(d)), math.sin(math.radians(d))] for d in degrees])


def test_a_scene_does_not_walk():
    assert scenes.grown(_circle(0, 25, 50, 75, 100), 0.85) == [[0, 1], [2, 3]]


def test_equal_agreement_takes_the_later_one():
    assert scenes.grown(_circle(0, 30, -30), 0.86, join=False) == [[0, 2]]


def test_a_seed_without_company_is_used_up():
    assert scenes.grown(_circle(0, 90, 91), 0.9) == [[1, 2]]


def test_cascade_stages_agree_with_the_whole(spark):
    rng = random.Random(2)
    pick = lambda *x: rng.choice(x)
    rows = [(i, i + 1, pick(True, False, None), pick(0.1, 0.45, 0.46), pick(1.0, 40.0, 41.0), pick(0.0, 2.0, 2.1, None), pick("same", "different", "unknown", None), pick("same", "different", "unknown", None), pick(0.3, 0.31, None), pick(20.5, 20.6), pick("same", "different", None)) for i in range(400)]
    facts = spark.createDataFrame(rows, "a long, b long, camera boolean, sketch_block double, sketch_ratio double, apart double, screen string, scene string, block double, ratio double, closer string")
    pairs = facts.select("a", "b", "camera", "sketch_block", "sketch_ratio", "apart")
    give = lambda *c: lambda p: p.join(facts.select("a", "b", *c), ["a", "b"])
    staged = cascade.staged(pairs, give("screen"), give("scene", "block", "ratio"), give("closer"))
    whole = {(r["a"], r["b"]): r["outcome"] for r in facts.withColumn("outcome", cascade.outcome()).collect()}
    got = {(r["a"], r["b"]): r["outcome"] for r in staged.collect()}
    assert got == whole and len(got) == 400
    assert cascade.balance(staged).first()["balanced"]


def test_comb(spark):
    smooth = [(1, v) for v in range(-12, 13) for _ in range(60 - 2 * abs(v))]
    every_second = [(2, v) for v in range(-12, 13, 2) for _ in range(80)]
    narrow = [(3, v) for v in range(8) for _ in range(100)]
    few = [(4, v) for v in range(10)]
    got = dict(map(tuple, signal.comb_scores(spark.createDataFrame(smooth + every_second + narrow + few, "band int, value int"), "band").collect()))
    assert got[1] < 0.20 and got[2] >= 0.40 and got[3] is None and 4 not in got


def test_comb_needs_three_bands(spark):
    rows = spark.createDataFrame([("x", 0.5), ("x", 0.1), ("x", 0.4), ("y", 0.9), ("y", 0.9)], "record string, score double")
    assert [(r["record"], r["proven"]) for r in signal.comb_proven(rows, F.col("record")).collect()] == [("x", True)]
