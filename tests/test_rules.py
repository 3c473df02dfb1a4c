"""One case inside and one outside every bound of every rule, and their order."""

import pytest
from pyspark.sql import functions as F

from keepset.operators import rules

SIDE = "md5 string, raw boolean, w int, h int, pixels long, pixels_key string, rendered int, tier int, thumb array<double>"
VERDICT = "scene string, block double, ratio double, shift double, zoom double, rot double, b_in_a double, a_in_b double, lum_off double, contrast double"
SCHEMA = f"keeper struct<{SIDE.replace(' ', ':').replace(',:', ',')}>, other struct<{SIDE.replace(' ', ':').replace(',:', ',')}>, verdict struct<{VERDICT.replace(' ', ':').replace(',:', ',')}>, apart double"
ALIKE, UNLIKE = [1.0, 2.0, 4.0], [4.0, 2.0, 1.0]


def side(md5, raw=False, w=100, h=80, pixels=8000, pixels_key=None, rendered=None, tier=3, thumb=ALIKE):
    return (md5, raw, w, h, pixels, pixels_key or md5, rendered, tier, thumb)


def verdict(scene="same", block=0.05, ratio=9.0, shift=0.0, zoom=1.0, rot=0.0, b_in_a=0.0, a_in_b=0.0, lum_off=0.0, contrast=1.0):
    return (scene, block, ratio, shift, zoom, rot, b_in_a, a_in_b, lum_off, contrast)


K = side("k")
NEAR = "near-duplicate"
CASES = [
    ("duplicate", K, side("k"), None, 9.0),
    ("non-hdr", side("k", rendered=3), side("o", rendered=4), None, 0.49),
    (NEAR, side("k", rendered=3), side("o", rendered=4), None, 0.5),
    (NEAR, side("k", rendered=4), side("o", rendered=3), None, 0.1),
    ("fake-blur", side("k", rendered=9), side("o", rendered=8), None, 0.49),
    (NEAR, side("k", rendered=9), side("o", rendered=8), None, 0.5),
    ("identical", side("k", pixels_key="p"), side("o", pixels_key="p"), None, 9.0),
    (NEAR, side("k", pixels_key="p"), side("o", pixels_key="p", w=99), None, 9.0),
    (NEAR, side("k", pixels_key="p", raw=True), side("o", pixels_key="p", raw=True), None, 9.0),
    ("export", side("k", raw=True), side("o"), None, 9.0),
    (NEAR, side("k", raw=True), side("o", thumb=UNLIKE), None, 9.0),
    ("crop", K, side("o"), verdict(b_in_a=1.0, zoom=0.91), 1.9),
    (NEAR, K, side("o"), verdict(b_in_a=1.0, zoom=0.92), 1.9),
    (NEAR, K, side("o"), verdict(b_in_a=1.0, zoom=0.91), 2.0),
    (NEAR, K, side("o"), verdict(b_in_a=1.0, zoom=0.91, block=0.11), 1.9),
    ("crop", K, side("o"), verdict(b_in_a=1.0, zoom=0.91, block=0.11, ratio=5.0), 1.9),
    ("crop", K, side("o"), verdict(a_in_b=1.0, zoom=1.10), 1.9),
    (NEAR, K, side("o"), verdict(a_in_b=1.0, zoom=1.09), 1.9),
    (NEAR, K, side("o"), verdict(b_in_a=1.0, zoom=None), 1.9),
    (NEAR, K, side("o"), verdict(scene="unknown", b_in_a=1.0, zoom=0.5), 1.9),
    ("rotated", K, side("o"), verdict(rot=87.5), 1.9),
    (NEAR, K, side("o"), verdict(rot=87.0), 1.9),
    ("rotated", K, side("o"), verdict(rot=-92.9), 1.9),
    (NEAR, K, side("o"), verdict(rot=93.0), 1.9),
    ("rotated", K, side("o", w=80, h=100), None, 0.49),
    (NEAR, K, side("o", w=80, h=100), None, 0.5),
    (NEAR, side("k", w=90, h=90), side("o", w=90, h=90), None, 0.1),
    ("edited", K, side("o"), verdict(lum_off=6.1), 0.01),
    (NEAR, K, side("o"), verdict(lum_off=6.1), 0.011),
    (NEAR, K, side("o"), verdict(lum_off=6.0), 0.01),
    ("edited", K, side("o"), verdict(contrast=1.09), 0.0),
    (NEAR, K, side("o"), verdict(lum_off=9.0, shift=None), 0.0),
    (NEAR, K, side("o"), verdict(lum_off=9.0, shift=0.02), 0.0),
    (NEAR, K, side("o"), verdict(lum_off=9.0, rot=1.0), 0.0),
    (NEAR, K, side("o"), verdict(lum_off=9.0, zoom=1.03), 0.0),
    ("smaller", K, side("o", pixels=7199), None, 9.0),
    (NEAR, K, side("o", pixels=7200), None, 9.0),
    (NEAR, K, side("o", pixels=7000, thumb=UNLIKE), None, 9.0),
    (NEAR, K, side("o", pixels=0), None, 9.0),
    ("resave", K, side("o", tier=5), None, 9.0),
    (NEAR, K, side("o", tier=4), None, 9.0),
    ("crop", K, side("o", pixels=100), verdict(b_in_a=1.0, zoom=0.5), 1.0),
    ("duplicate", side("k", rendered=3), side("k", rendered=4), None, 0.1),
    (NEAR, K, side("o", thumb=None, pixels=10), None, None),
]


@pytest.fixture(scope="module")
def named(spark):
    rows = spark.createDataFrame([(k, o, v, t) for _, k, o, v, t in CASES], SCHEMA).coalesce(1)
    return [tuple(r) for r in rows.select(rules.reason(), rules.proves_membership()).collect()]


@pytest.mark.parametrize("n", range(len(CASES)))
def test_named(named, n):
    assert named[n][0] == CASES[n][0]


def test_membership_is_proven_by_alignment_only(named):
    for (name, k, o, v, _), (_, proves) in zip(CASES, named):
        assert proves == (v is not None and name in ("crop", "rotated", "edited"))


def test_every_rule_is_settled_and_named():
    assert rules.SETTLED == ("duplicate", "non-hdr", "fake-blur", "identical", "export", "crop", "rotated", "edited", "smaller", "resave")
    assert all(r.says for r in rules.RULES) and rules.OTHERWISE not in rules.SETTLED


def test_nulls_satisfy_nothing(spark):
    null = spark.createDataFrame([(None, None, None, None)], SCHEMA)
    assert null.select(rules.reason()).first()[0] == NEAR
    assert null.select(F.coalesce(rules.proves_membership(), F.lit(True))).first()[0] is False
