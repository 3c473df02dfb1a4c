import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepset.functions import scalars as S
from keepset.operators import cache, journal
from keepset.sources import files


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("name,t", [("IMG_2021-03-04_05.06.07.jpg", 1614834367.0), ("2021.03.04 05-06-07-250.png", 1614834367.25), ("2021-13-04_05.06.07.jpg", None), ("IMG_1.jpg", None)])
def test_name_time(spark, name, t):
    assert one(spark, S.name_time(F.lit(name))) == t


@pytest.mark.parametrize("q,lossless,tier", [(1.0, False, 0), (0.2, False, 0), (1.4, False, 1), (2.0, False, 2), (None, False, 0), (9.0, True, -1)])
def test_tier(spark, q, lossless, tier):
    assert one(spark, S.compression_tier(F.lit(q).cast("double"), F.lit(lossless))) == tier


@pytest.mark.parametrize("w,h,f", [(3999, 10, 1), (4000, 10, 2), (10, 8000, 4), (1, 1, 1)])
def test_halvings(spark, w, h, f):
    assert one(spark, S.halvings(F.lit(w), F.lit(h))) == f


def test_margin_at_zero_limits(spark):
    m = lambda b, r, lb, lr: one(spark, S.margin(F.lit(float(b)), F.lit(float(r)), F.lit(float(lb)), F.lit(float(lr))))
    assert m(0.15, 1, 0.3, 20) == 0.5 and m(0, 0, 0, 0) == 0 and m(0.1, 0, 0, 1) == math.inf


@pytest.mark.parametrize("a,b,t,held", [(3, 4, 0.49, True), (4, 3, 0.49, True), (3, 4, 0.5, False), (3, 8, 0.1, False), (9, 8, 0.0, True), (None, 4, 0.0, False)])
def test_camera_pair(spark, a, b, t, held):
    assert one(spark, S.camera_pair(F.lit(a).cast("int"), F.lit(b).cast("int"), F.lit(t))) is held


def test_vectors(spark):
    v = [1.0, 2.0, 4.0, 9.0]
    u = np.array(v) - np.mean(v)
    assert np.allclose(one(spark, S.centred_unit(F.array(*map(F.lit, v)))), u / np.linalg.norm(u))
    assert one(spark, S.centred_unit(F.array(F.lit(2.0), F.lit(2.0)))) == [0.0, 0.0]
    assert one(spark, S.above_median(F.array(*map(F.lit, v)))) == [0, 0, 1, 1]
    assert one(spark, S.packed(F.array(*map(F.lit, [1, 0, 1])))) == 5
    assert one(spark, S.structure_agrees(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) is False


def test_texts(spark):
    assert one(spark, S.size_text(F.lit(1.5e9))) == "1.50 GB" and one(spark, S.size_text(F.lit(2e6))) == "2.0 MB"
    assert [one(spark, S.duration_text(F.lit(s))) for s in (5, 65, 3660)] == ["5s", "1m 5s", "1h 1m"]
    assert one(spark, S.dimensions_text(F.lit(4), F.lit(3), F.lit(False))) == "4x3"
    assert one(spark, S.dimensions_text(F.lit(0), F.lit(0), F.lit(True))) == "raw sensor"


def test_scan(spark, tmp_path):
    for name in ("a.JPG", "b.txt", ".c.jpg", "sub/d.png", "Old.photoslibrary/e.jpg", "skip/f.jpg", "a.mov"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    found = files.scan(spark, str(tmp_path), exclude=("skip",))
    names = sorted(r["path"].split("/")[-1] for r in found.collect())
    assert names == ["a.JPG", "d.png"]
    assert files.folder_size(found).first()["bytes"] == 10
    every = files.scan(spark, str(tmp_path), extensions=(".jpg", ".mov", ".png"))
    motion = {r["path"].split("/")[-1]: r["motion"] for r in files.with_companion(every).collect()}
    assert motion["a.JPG"] and not motion["d.png"]


def test_settings():
    assert files.settings(["a = 1 # x", "# b = 2", "c=3"], {"KEEPSET_C": "9"}) == {"a": "1", "c": "9"}


def test_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    schema = "key string, version int, stored_at timestamp, value long"
    empty = spark.createDataFrame([], schema)
    rows = spark.createDataFrame([("p1", "x"), ("p2", "x"), ("p3", "bad")], "path string, key string")
    compute = lambda m: m.select("key", F.length("key").cast("long").alias("value"), F.when(F.col("key") == "bad", "broken").alias("error"))
    first = cache.filled(rows, empty, ["key"], 1, compute, path)
    assert sorted((r["path"], r["value"]) for r in first.collect()) == [("p1", 1), ("p2", 1)]
    stored = spark.read.schema(schema).parquet(path)
    assert stored.count() == 1
    hits, misses = cache.split(rows, stored, ["key"], 1)
    assert hits.count() == 2 and misses.count() == 1
    assert cache.split(rows, stored, ["key"], 2)[0].count() == 0


def test_undo(spark):
    log = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], ["from", "to"])
    present = spark.createDataFrame([("x",), ("y",), ("b",)], ["path"])
    assert {r["from"]: r["status"] for r in journal.undo_status(log, present).collect()} == {"a": "restored", "b": "occupied", "c": "missing"}


def test_unreviewed_scenes_lose_nothing(spark):
    members = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "d")], ["scene", "file"])
    reviewed, kept = spark.createDataFrame([(1,)], ["scene"]), spark.createDataFrame([], "scene long, file string")
    assert sorted(r["file"] for r in journal.unkept(members, reviewed, kept).collect()) == ["a", "b"]


def test_unseen_records_stay(spark):
    f = lambda *x: spark.createDataFrame([(y,) for y in x], "file string")
    assert sorted(r[0] for r in journal.kept_by_review(f("a", "b", "c"), f("a", "b"), f("a")).collect()) == ["a", "c"]


def test_only_proof_leaves_in_round_one(spark):
    plan = spark.createDataFrame([("k", "KEEP", 1, ""), ("o", "REDUNDANT", 1, "duplicate"), ("n", "REDUNDANT", 1, "near-duplicate")], ["file", "verdict", "group", "why"])
    assert [(r["file"], r["kept_instead"]) for r in journal.apply_plan(plan).collect()] == [("o", "k")]
    assert journal.apply_plan(plan, settled_only=False).count() == 2


def test_free_names(spark):
    names = [one(spark, journal.free_name(F.lit("x/a.b.jpg"), F.lit(k))) for k in (1, 2, 3)]
    assert names == ["x/a.b.jpg", "x/a.b (2).jpg", "x/a.b (3).jpg"]


def test_last_pass(spark):
    rows = spark.createDataFrame([("j", 1, "old"), ("j", 2, "new"), ("j", 2, "also"), ("i", 1, "only")], "job string, judged_at long, x string")
    assert sorted(r["x"] for r in journal.last_pass(rows, "job").collect()) == ["also", "new", "only"]
