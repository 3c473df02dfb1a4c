"""Decoded pictures: sketches, focus, keys and scenes of a folder."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepset.operators import sketches
from keepset.plans import library
from keepset.sources import pixels
from tests.test_sources import picture


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("pixels")
    for k, name in enumerate(("2024-01-01_10.00.00.jpg", "2024-01-01_10.00.20.jpg")):
        picture(spark, where / name, 0.9 - 0.1 * k, seed=1)
    picture(spark, where / "2024-01-01_10.01.00.jpg", 0.9, seed=9)
    shutil.copy(where / "2024-01-01_10.00.00.jpg", where / "2024-03-01_10.00.00.jpg")
    (where / "broken.jpg").write_bytes(b"no picture")
    return where


def test_looks(spark, folder):
    rows = {r["path"].rpartition("/")[2]: r for r in pixels.looks(pixels.pictures(spark, str(folder))).collect()}
    assert len(rows) == 4 and all(len(r["sketch"]) == sketches.HEIGHT * sketches.WIDTH and r["sharp"] > 0 for r in rows.values())
    a, b, other, copy = (np.frombuffer(rows[n]["sketch"], np.uint8).reshape(sketches.HEIGHT, sketches.WIDTH) for n in ("2024-01-01_10.00.00.jpg", "2024-01-01_10.00.20.jpg", "2024-01-01_10.01.00.jpg", "2024-03-01_10.00.00.jpg"))
    keys = {n: r["pixels_key"] for n, r in rows.items()}
    assert keys["2024-01-01_10.00.00.jpg"] == keys["2024-03-01_10.00.00.jpg"] != keys["2024-01-01_10.00.20.jpg"]
    assert sketches.residual(a, b)[0] < sketches.residual(a, other)[0] and (a == copy).all()


@pytest.mark.parametrize("flag", [None, 1, 2, 3, 4, 5, 6, 7, 8])
def test_turned(flag):
    p = np.arange(6).reshape(2, 3)
    want = {2: [[2, 1, 0], [5, 4, 3]], 3: [[5, 4, 3], [2, 1, 0]], 4: [[3, 4, 5], [0, 1, 2]], 5: [[0, 3], [1, 4], [2, 5]], 6: [[3, 0], [4, 1], [5, 2]], 7: [[5, 2], [4, 1], [3, 0]], 8: [[2, 5], [1, 4], [0, 3]]}
    assert pixels.turned(p, flag).tolist() == want.get(flag, p.tolist())


@pytest.mark.parametrize("shape", [(144, 256), (300, 500), (20, 30), (1, 1)])
def test_sketches_have_one_size(shape):
    assert pixels.sketched(np.full(shape, 7.0)).tolist() == np.full((sketches.HEIGHT, sketches.WIDTH), 7).tolist()


def test_scenes_of_a_folder(spark, folder):
    found = library.scenes_of(spark, str(folder), alike=0.85)
    rows = {r["path"].rpartition("/")[2]: (r["shoot"], r["scene"]) for r in found.collect()}
    assert rows.keys() == {"2024-01-01_10.00.00.jpg", "2024-01-01_10.00.20.jpg"} and len(set(rows.values())) == 1
    assert found.select(F.max("scene")).first()[0] == 1
