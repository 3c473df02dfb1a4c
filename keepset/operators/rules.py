"""How a redundant record derives from its keeper: rules in order, the first that holds names it.

A pair is a row with structs `keeper`, `other` and `verdict` (null where no alignment was made) and `apart`, seconds between the
captures. A null anywhere never satisfies a rule.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepset.functions import scalars as S


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


@dataclass(frozen=True)
class Rule:
    name: str
    says: str
    holds: Callable[[], Column]
    proves_membership: Callable[[], Column] | None = None
    settled: bool = True


def _aligned(limit: float = S.SAME_MOMENT) -> Column:
    return _sure((F.col("apart") < limit) & (F.col("verdict.scene") == "same")) & S.pictures_agree(F.col("verdict"))


def _or_one(c: str) -> Column:
    """Null and zero count as one."""
    value = F.col(f"verdict.{c}")
    return F.when(value.isNull() | (value == 0), F.lit(1.0)).otherwise(value)


def _marks(keeper: int, other: int) -> Column:
    return _sure((F.col("apart") < S.ONE_CAPTURE) & (F.col("keeper.rendered") == keeper) & (F.col("other.rendered") == other))


def _structure() -> Column:
    return S.structure_agrees(F.col("keeper.thumb"), F.col("other.thumb"))


def _identical() -> Column:
    k, o = "keeper.", "other."
    same = (F.col(k + "w") == F.col(o + "w")) & (F.col(k + "h") == F.col(o + "h")) & (F.col(k + "thumb") == F.col(o + "thumb")) & (F.col(k + "pixels_key") == F.col(o + "pixels_key"))
    return _sure(~F.col(k + "raw") & ~F.col(o + "raw") & same)


def _crop() -> Column:
    zoom = _or_one("zoom")
    inside = _sure((F.col("verdict.b_in_a") == 1.0) & (zoom <= 0.91)) | _sure((F.col("verdict.a_in_b") == 1.0) & (zoom >= 1.10))
    return _aligned() & inside


def _turned() -> Column:
    return _aligned() & _sure(F.abs(F.abs(F.col("verdict.rot")) - 90) < 3)


def _stored_turned() -> Column:
    k, o = "keeper.", "other."
    swapped = (F.col(k + "w") > 0) & (F.col(k + "h") > 0) & (F.col(k + "w") == F.col(o + "h")) & (F.col(k + "h") == F.col(o + "w")) & (F.col(k + "w") != F.col(k + "h"))
    return _sure(swapped) & (_sure(F.col("apart") < S.ONE_CAPTURE) | S.pictures_agree(F.col("verdict")))


def _edited() -> Column:
    unmoved = (F.coalesce("verdict.shift", F.lit(1.0)) < 0.02) & (F.abs(_or_one("zoom") - 1) < 0.03) & (F.abs(F.coalesce("verdict.rot", F.lit(0.0))) < 1)
    relit = (F.abs(F.coalesce("verdict.lum_off", F.lit(0.0))) > 6) | (F.abs(_or_one("contrast") - 1) > 0.08)
    return _aligned() & _sure(F.col("apart") <= S.EXACT_MOMENT) & unmoved & relit


def _smaller() -> Column:
    k, o = F.col("keeper.pixels"), F.col("other.pixels")
    return _sure((k > 0) & (o > 0) & (o < 0.9 * k)) & _structure()


RULES = (
    Rule("duplicate", "byte for byte the same file", lambda: _sure(F.col("other.md5") == F.col("keeper.md5"))),
    Rule("non-hdr", "the spare frame of a merged capture", lambda: _marks(S.MERGED, S.SPARE)),
    Rule("fake-blur", "the frame whose blur was computed", lambda: _marks(S.SOURCE, S.BLURRED)),
    Rule("identical", "the same pixels in another file", _identical),
    Rule("export", "made from the raw that is kept", lambda: _sure(F.col("keeper.raw") & ~F.col("other.raw")) & _structure()),
    Rule("crop", "cut out of the frame that is kept", _crop, _crop),
    Rule("rotated", "a quarter turn of it", lambda: _turned() | _stored_turned(), _turned),
    Rule("edited", "the same view in another light", _edited, _edited),
    Rule("smaller", "the same picture with fewer pixels", _smaller),
    Rule("resave", "saved again with more loss", lambda: _sure(F.col("other.tier") > F.col("keeper.tier") + 1) & _structure()),
)
OTHERWISE = "near-duplicate"
#: Reasons that the first round may act on.
SETTLED = tuple(r.name for r in RULES if r.settled)


def reason(rules: tuple[Rule, ...] = RULES) -> Column:
    out = None
    for rule in rules:
        out = F.when(rule.holds(), rule.name) if out is None else out.when(rule.holds(), rule.name)
    return out.otherwise(OTHERWISE)


def proves_membership(rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether some rule proves that the pair belongs together although its residual is over the limits."""
    out = F.lit(False)
    for rule in rules:
        if rule.proves_membership:
            out = out | rule.proves_membership()
    return out
