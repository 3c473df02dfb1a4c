"""Signatures, look-alikes, verdict cascade, groups, scenes and signals over embeddings and numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepset.functions import scalars as S
from keepset.operators import candidates, cascade, grouping, scenes, signal
from keepset.plans.registry import query
from keepset.runtime import Scratch
from keepset.sources.tables import table

LONG = "long"
#: 64 signs above the median as text, and the pairs that agree.
_BITS = """select vec_id, label, array_to_string(list_transform(embedding, lambda x: case when x::double > (list_sort(embedding)[32]::double + list_sort(embedding)[33]::double) / 2 then '1' else '0' end), '') as bits from embeddings"""
_PACKED = f"""select vec_id, label, bits::bit as bits from ({_BITS})"""
_LOOK = f"with p as materialized ({_PACKED}), l as materialized (select a.vec_id as a, b.vec_id as b, bit_count(xor(a.bits, b.bits)) as distance from p a join p b on a.vec_id < b.vec_id where bit_count(xor(a.bits, b.bits)) <= 22)"


def signatures(spark, d) -> DataFrame:
    bits = S.above_median(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", "label", "embedding", S.packed(bits).alias("bits"))


def look(spark, d) -> DataFrame:
    return candidates.lookalikes(signatures(spark, d).select(F.col("vec_id").alias("id"), "bits"))


@query("signature_bits", f"select vec_id, bits from ({_BITS})")
def signature_bits(spark, d):
    bits = S.above_median(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.array_join(F.transform(bits, lambda b: b.cast("string")), "").alias("bits"))


@query("lookalike_pairs", f"{_LOOK} select a, b, distance::bigint as distance from l")
def lookalike_pairs(spark, d):
    return look(spark, d).select("a", "b", F.col("distance").cast(LONG).alias("distance"))


_TOPK = f"""{_LOOK}, e as (select a as src, b as dst, distance from l union all select b, a, distance from l),
k as (select *, row_number() over (partition by src order by distance, dst) as place from e)"""


@query("lookalike_topk", f"{_TOPK} select src, dst, place from k where place <= 60")
def lookalike_topk(spark, d):
    return candidates.closest(look(spark, d)).select("src", "dst", F.col("place").cast(LONG).alias("place"))


_UNIT = """select vec_id, label, case when n > 1e-12 then list_transform(c, lambda x: x / n) else list_transform(c, lambda x: 0.0::double) end as u from (
select *, sqrt(list_sum(list_transform(c, lambda x: x * x))) as n from (
select vec_id, label, list_transform(embedding, lambda x: x::double - list_avg(embedding::double[])) as c from embeddings))"""


@query("centred_unit", f"select vec_id, list_transform(u, lambda x: round(x, 4))[1] as first, list_transform(u, lambda x: round(x, 4))[64] as last, round(list_sum(list_transform(u, lambda x: x * x)), 4) as length from ({_UNIT})")
def centred_unit(spark, d):
    unit = table(spark, d, "embeddings").select("vec_id", S.centred_unit(F.col("embedding")).alias("u"))
    return unit.select("vec_id", F.round(F.get("u", F.lit(0)), 4).alias("first"), F.round(F.get("u", F.lit(63)), 4).alias("last"), F.round(S.dot(F.col("u"), F.col("u")), 4).alias("length"))


def agreements(spark, d) -> DataFrame:
    """Look-alike pairs with the agreement of their centred unit vectors."""
    unit = table(spark, d, "embeddings").select("vec_id", S.centred_unit(F.col("embedding")).alias("u"))
    pairs = look(spark, d)
    joined = pairs.join(unit.toDF("a", "ua"), "a").join(unit.toDF("b", "ub"), "b")
    return joined.select("a", "b", S.dot(F.col("ua"), F.col("ub")).alias("agreement"))


_AGREE = f"{_LOOK}, u as materialized ({_UNIT}), g as (select l.a, l.b, l.distance, list_dot_product(x.u, y.u) as agreement from l join u x on x.vec_id = l.a join u y on y.vec_id = l.b)"


@query("agreement_pairs", f"{_AGREE} select a, b, round(agreement, 4) as agreement from g")
def agreement_pairs(spark, d):
    return agreements(spark, d).select("a", "b", F.round("agreement", 4).alias("agreement"))


@query("structure_agrees", f"{_AGREE} select a, b, agreement >= 0.97 as agrees from g")
def structure_agrees(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    joined = look(spark, d).join(vectors.toDF("a", "va"), "a").join(vectors.toDF("b", "vb"), "b")
    return joined.select("a", "b", S.structure_agrees(F.col("va"), F.col("vb")).alias("agrees"))


#: Residuals of look-alike pairs: eight blocks of eight entries, scaled to 0..255 so that the ratio's constant means the same.
_RES = f"""{_LOOK}, v as materialized (select vec_id, list_transform(embedding, lambda x: (x::double + 1) * 127.5) as v from embeddings),
s as (select l.a, l.b, l.distance, unnest(range(8)) as k, x.v as xa, y.v as yb from l join v x on x.vec_id = l.a join v y on y.vec_id = l.b),
w as (select a, b, distance, xa[k*8+1:k*8+8] as x, yb[k*8+1:k*8+8] as y from s),
z as (select a, b, distance, list_avg(list_transform(list_zip(x, y), lambda p: abs(p[1] - p[2]))) as m, list_stddev_pop(x) as sx, list_stddev_pop(y) as sy from w),
r as materialized (select a, b, distance, max(m) / 255 as block, max(greatest(m / (sx + 2), m / (sy + 2))) as ratio from z group by 1, 2, 3)"""


def residuals(spark, d) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x.cast("double") + 1) * 127.5).alias("v"))
    joined = look(spark, d).join(vectors.toDF("a", "va"), "a").join(vectors.toDF("b", "vb"), "b")
    block, ratio = signal.block_residual(F.col("va"), F.col("vb"), 64)
    return joined.select("a", "b", "distance", (block / 255).alias("block"), ratio.alias("ratio"))


@query("block_residual", f"{_RES} select a, b, round(block, 4) as block, round(ratio, 3) as ratio from r")
def block_residual(spark, d):
    return residuals(spark, d).select("a", "b", F.round("block", 4).alias("block"), F.round("ratio", 3).alias("ratio"))


#: Limits that part these pairs, and what the steps read.
BLOCK, RATIO = 0.12, 3.0
_JUDGED = f"""{_RES}, j as (select *, case when a % 50 = 0 then 'camera pair' when block > 0.16 and not (abs(a - b) % 7 <= 2 and a % 3 = 0) then 'rejected on the sketch'
when distance >= 22 and not (block > 0.16 and a % 3 = 0) then 'screened out on keypoints' when (a + b) % 11 = 0 then 'different' when (a + b) % 13 = 0 then 'unverifiable, kept apart'
when block <= {BLOCK} and ratio <= {RATIO} then case when (a * b) % 5 = 0 then 'refused by the closer look' else 'within limits' end else 'over the limits' end as outcome from r)"""


def judged(spark, d) -> DataFrame:
    pairs = residuals(spark, d).select(
        "a", "b", "distance", F.col("block").alias("sketch_block"), F.lit(0.0).alias("sketch_ratio"), "ratio", (F.col("a") % 50 == 0).alias("camera"), (F.abs(F.col("a") - F.col("b")) % 7).cast("double").alias("apart")
    )
    pairs = pairs.withColumnRenamed("ratio", "own_ratio")
    screen = lambda p: p.withColumn("screen", F.when(F.col("distance") >= 22, F.when((F.col("sketch_block") > 0.16) & (F.col("a") % 3 == 0), "same").otherwise("different")).when(F.col("a") % 3 == 0, "same").otherwise("unknown"))
    total = F.col("a") + F.col("b")
    verdict = lambda p: p.withColumns({"scene": F.when(total % 11 == 0, "different").when(total % 13 == 0, "unknown").otherwise("same"), "block": F.col("sketch_block"), "ratio": F.col("own_ratio")})
    closer = lambda p: p.withColumn("closer", F.when(F.col("a") * F.col("b") % 5 == 0, "different").otherwise("same"))
    return cascade.staged(pairs, screen, verdict, closer, cascade.Limits(BLOCK, RATIO, sketch_block=0.16), hold=Scratch(spark, "cascade").table)


@query("cascade_outcomes", f"{_JUDGED} select outcome, count(*) as pairs, sum(count(*)) over ()::bigint as attempted from j group by 1")
def cascade_outcomes(spark, d):
    from pyspark.sql import Window

    counts = judged(spark, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("pairs"))
    return counts.withColumn("attempted", F.sum("pairs").over(Window.partitionBy()))  # a row an outcome


@query("cascade_balance", f"""{_JUDGED} select count(*) as attempted, count(*) filter (where outcome in ('camera pair', 'within limits', 'proven by a rule')) as accepted,
count(*) filter (where outcome not in ('camera pair', 'within limits', 'proven by a rule')) as refused, true as balanced from j""")
def cascade_balance(spark, d):
    return cascade.balance(judged(spark, d))


@query("margin", f"{_RES} select a, b, round(greatest(block / {BLOCK}, ratio / {RATIO}), 3) as margin from r")
def margin(spark, d):
    return residuals(spark, d).select("a", "b", F.round(S.margin(F.col("block"), F.col("ratio"), F.lit(BLOCK), F.lit(RATIO)), 3).alias("margin"))


LIMITS = [(0.06, 1.5), (0.08, 2.0), (0.10, 2.5), (0.12, 3.0), (0.16, 4.0)]


@query("limit_sweep", f"""{_RES} select block_limit, ratio_limit, count(*) filter (where block <= block_limit and ratio <= ratio_limit) as accepted, count(*) as attempted
from r cross join (values {", ".join(f"({b}::double, {r}::double)" for b, r in LIMITS)}) t(block_limit, ratio_limit) group by 1, 2""")
def limit_sweep(spark, d):
    return cascade.limit_sweep(residuals(spark, d), LIMITS)


#: The sweep record by record: who has a leader before it on whose list it is belongs to the first such; others lead.
_STAR = f"""{_TOPK.replace("with p as", "with recursive p as", 1)},
l0 as materialized (select dst, list(src) as earlier from k where place <= 60 and src < dst group by 1),
n as materialized (select vec_id, row_number() over (order by vec_id) as step, coalesce(earlier, []::bigint[]) as earlier from embeddings left join l0 on dst = vec_id),
w(step, vec_id, leader, leaders) as (select 0::bigint, null::bigint, null::bigint, []::bigint[] union all
select n.step, n.vec_id, coalesce(list_min(list_intersect(n.earlier, w.leaders)), n.vec_id), case when list_has_any(n.earlier, w.leaders) then w.leaders else list_append(w.leaders, n.vec_id) end
from w join n on n.step = w.step + 1)"""


@query("star_groups", f"{_STAR} select vec_id, leader from w where vec_id is not null")
def star_groups(spark, d):
    """Groups of look-alikes, each record's list capped at its 60 closest."""
    scratch = Scratch(spark, "star")
    edges = scratch.table(candidates.closest(look(spark, d)).select("src", "dst"), "edges")
    ranks = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("rank"))
    found = grouping.star_groups(ranks, edges, scratch)
    return found.select(F.col("id").alias("vec_id"), "leader")


@query("centroid", f"""with u as ({_UNIT}), e as (select label, unnest(u) as x, unnest(range(64)) as k from u), m as (select label, k, avg(x) as m from e group by 1, 2),
n as (select label, sqrt(sum(m * m)) as n from m group by 1) select m.label, k::bigint as k, round(m / n, 4) as x from m join n on m.label = n.label""")
def centroid(spark, d):
    found = scenes.centroids(table(spark, d, "embeddings").select("label", F.col("embedding").alias("vector")), "label")
    return found.select("label", F.posexplode("centroid").alias("k", "x")).select("label", F.col("k").cast(LONG).alias("k"), F.round("x", 4).alias("x"))


@query("scene_cohesion", f"""with u as materialized ({_UNIT}), e as (select label, unnest(u) as x, unnest(range(64)) as k from u), m as (select label, k, avg(x) as m from e group by 1, 2),
c as (select label, list(m order by k) as c, sqrt(sum(m * m)) as n from m group by 1)
select u.label, count(*) as members, round(min(list_dot_product(u.u, c.c) / c.n), 4) as least_agreement from u join c on u.label = c.label group by 1""")
def scene_cohesion(spark, d):
    found = scenes.cohesion(table(spark, d, "embeddings").select("label", F.col("embedding").alias("vector")), "label")
    return found.select("label", "members", F.round("least_agreement", 4).alias("least_agreement"))


#: The limit of the scenes here; vectors of this table agree less than pictures of one scene do.
ALIKE = 0.3
#: Growth (g), a member or a new seed a step; then joins of scenes (j), one a step. A state holds the vectors of one label.
_SCENES = f"""with recursive u0 as materialized ({_UNIT}), s0 as (select label, list({{'id': vec_id, 'u': u}} order by vec_id) as waiting from u0 group by 1),
g as (select label, 0 as step, waiting, s0.waiting[1:0] as members, null::double[] as total, s0.waiting[1:0] as found from s0
union all select label, step + 1,
  case when len(members) = 0 then waiting[2:] when takes then list_concat(waiting[:spot - 1], waiting[spot + 1:]) else waiting end,
  case when len(members) = 0 then waiting[1:1] when takes then list_append(members, waiting[spot]) else waiting[1:0] end,
  case when len(members) = 0 then waiting[1].u when takes then list_transform(list_zip(total, waiting[spot].u), lambda z: z[1] + z[2]) else null end,
  case when len(members) >= 2 and not takes then members else waiting[1:0] end
from (select *, len(members) > 0 and coalesce(list_max(agrees) >= {ALIKE}, false) as takes, len(waiting) + 1 - list_position(list_reverse(agrees), list_max(agrees)) as spot
from (select *, list_transform(waiting, lambda x: list_dot_product(x.u, total) / case when list_dot_product(total, total) > 0 then sqrt(list_dot_product(total, total)) else 1 end) as agrees
from g where len(members) > 0 or len(waiting) >= 2))),
f as (select label, list({{'members': found, 'total': total_of}} order by step) as scenes from (
select label, step, found, list_transform(range(1, 65), lambda k: list_sum(list_transform(found, lambda m: m.u[k]))) as total_of from g where len(found) >= 2) group by 1),
j as (select label, 0 as step, scenes, null::struct(a bigint, b bigint) as joined, true as open from f
union all select label, step + 1, case when pair is null then scenes else list_concat(list_append(scenes[:pair.a - 1], {{'members': list_concat(scenes[pair.a].members, scenes[pair.b].members),
  'total': list_transform(list_zip(scenes[pair.a].total, scenes[pair.b].total), lambda z: z[1] + z[2])}}), list_concat(scenes[pair.a + 1:pair.b - 1], scenes[pair.b + 1:])) end, pair, pair is not null
from (select *, list_filter(flatten(list_transform(range(1, len(scenes) + 1), lambda a: list_transform(range(a + 1, len(scenes) + 1), lambda b: {{'a': a, 'b': b}}))),
  lambda p: list_min(list_transform(list_concat(scenes[p.a].members, scenes[p.b].members), lambda m: list_dot_product(m.u, list_transform(list_zip(scenes[p.a].total, scenes[p.b].total), lambda z: z[1] + z[2])))) >=
  {ALIKE} * sqrt(list_sum(list_transform(list_zip(scenes[p.a].total, scenes[p.b].total), lambda z: (z[1] + z[2]) * (z[1] + z[2])))))[1] as pair from j where open)),
e as (select label, unnest(scenes) as one, unnest(range(1, len(scenes) + 1)) as scene from j where not open)"""


def _scenes(spark, d) -> DataFrame:
    records = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("vec_id").cast("double").alias("t"), F.col("embedding").alias("vector"))
    return scenes.scenes(records, "label", alike=ALIKE)


@query("scenes", f"{_SCENES} select label, scene::bigint as scene, unnest(one.members).id as vec_id from e")
def scenes_of(spark, d):
    return _scenes(spark, d).select("label", F.col("scene").cast(LONG).alias("scene"), F.col("id").alias("vec_id"))


@query("scene_summary", f"{_SCENES} select count(*) as scenes, coalesce(sum(len(one.members)), 0)::bigint as records, coalesce(max(len(one.members)), 0)::bigint as largest from e")
def scene_summary(spark, d):
    return scenes.summary(_scenes(spark, d), "label")


_WEIGHT = "exp(-(pow((tile % 8 - 3.5) / 3.5, 2) + pow((tile // 8 - 3.5) / 3.5, 2)) / (2 * 0.42 * 0.42))"


@query("tile_focus_score", f"""with t as (select l_suppkey as supplier, l_partkey % 64 as tile, var_pop(l_quantity) as v from lineitem group by 1, 2),
w as (select supplier, tile, v * {_WEIGHT} as w from t), r as (select *, row_number() over (partition by supplier order by w desc, tile) as place from w)
select supplier, round(avg(w), 4) as sharp from r where place <= 5 group by 1""")
def tile_focus_score(spark, d):
    values = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("supplier"), (F.col("l_partkey") % 64).alias("tile"), F.col("l_quantity").alias("value"))
    return signal.tile_focus(values, "supplier").select("supplier", F.round("sharp", 4).alias("sharp"))


#: Bands: supplier and flag. One flag's values are even only, as a second, finer save leaves them.
_COMB = """with x as (select l_suppkey % 20 as record, l_returnflag as flag, case when l_suppkey % 20 < 7 then (l_quantity::bigint // 2) * 2 else l_quantity::bigint end - 25 as value from lineitem),
b as (select record, flag, value, count(*) as n from x where abs(value) <= 24 group by 1, 2, 3),
e as (select record, flag, min(value) as low, max(value) - min(value) + 1 as bins, sum(n) as total from b group by 1, 2 having sum(n) >= 500),
s as (select p.range as period, q.range as phase from range(2, 6) p, range(0, 5) q where q.range < p.range),
h as (select b.record, b.flag, period, phase, bins, total, sum(case when (value - low) % period = phase then n else 0 end) as on_, sum(case when (value - low) % period = phase then 0 else n end) as off_
from b join e on b.record = e.record and b.flag = e.flag cross join s group by 1, 2, 3, 4, 5, 6),
u as (select record, flag, bins, case when ceil((bins - phase) / period) >= 3 and bins - ceil((bins - phase) / period) >= 3 and on_ > 0 then (on_ - off_)::double / total end as score from h),
c as (select record, flag, case when bins >= 9 then greatest(coalesce(max(score), 0), 0) end as score from u group by 1, 2, bins)"""


def _combs(spark, d) -> DataFrame:
    quantity = F.col("l_quantity").cast(LONG)
    value = F.when(F.col("l_suppkey") % 20 < 7, F.floor(quantity / 2) * 2).otherwise(quantity) - 25
    rows = table(spark, d, "lineitem").select(F.struct((F.col("l_suppkey") % 20).alias("record"), F.col("l_returnflag").alias("flag")).alias("band"), value.alias("value"))
    return signal.comb_scores(rows, "band")


@query("comb_score", f"{_COMB} select record, flag, round(score, 4) as score from c")
def comb_score(spark, d):
    return _combs(spark, d).select("band.record", "band.flag", F.round("score", 4).alias("score"))


@query("comb_proven", f"{_COMB} select record, count(*) as bands, round(median(score), 4) as median, median(score) >= 0.4 as proven from c where score is not null group by 1 having count(*) >= 3")
def comb_proven(spark, d):
    return signal.comb_proven(_combs(spark, d), F.col("band.record")).select("record", "bands", F.round("median", 4).alias("median"), "proven")


@query("compression_tier", """select p_partkey, case when p_type like '%BRASS' then -1 else round_even(ln(greatest(p_size, 1)) / ln(1.4), 0) end::bigint as tier, round(p_size::double, 2) as mean from part""")
def compression_tier(spark, d):
    part = table(spark, d, "part")
    return part.select("p_partkey", S.compression_tier(F.col("p_size").cast("double"), F.endswith("p_type", F.lit("BRASS"))).cast(LONG).alias("tier"), F.round(F.col("p_size").cast("double"), 2).alias("mean"))
