"""Redundant documents: fingerprints, duplicates, ranking, manifest, lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepset.functions import scalars as S
from keepset.operators import cache, journal, ladder, rules
from keepset.plans.registry import query
from keepset.runtime import Scratch, ship
from keepset.sources.tables import table

LONG = "long"


def _long(c, name: str):
    return (F.col(c) if isinstance(c, str) else c).cast(LONG).alias(name)


#: The library's inventory: a path stands for source, language and id.
_PATHS = "select doc_id, text, n_chars, source || '/' || case when doc_id % 97 = 0 then 'old.photoslibrary/' else '' end || doc_id || '.' || lang as path from documents"


def paths(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    inner = F.when(F.col("doc_id") % 97 == 0, "old.photoslibrary/").otherwise("")
    return docs.withColumn("path", F.concat(F.col("source"), F.lit("/"), inner, F.col("doc_id"), F.lit("."), F.col("lang")))


@query("scan_inventory", f"""
with p as ({_PATHS})
select '.' || split_part(path, '.', -1) as extension, count(*) as files, sum(strlen(text))::bigint as bytes
from p where not regexp_matches(lower(path), '\\.(photoslibrary|photolibrary|aplibrary|migratedphotolibrary|lrlibrary|lrcat)(/|$)') group by 1
""")
def scan_inventory(spark, d):
    from keepset.sources.files import in_library

    kept = paths(spark, d).where(~in_library(F.col("path")))
    return kept.groupBy(S.extension(F.col("path")).alias("extension")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("text").cast(LONG)).alias("bytes"))


@query("scan_selection", """
select case when l.doc_id is null then 'listed, not found' else 'selected' end as state, count(*) as files
from (select doc_id from labels union select -1) s left join documents l on l.doc_id = s.doc_id group by 1
""")
def scan_selection(spark, d):
    listed = table(spark, d, "labels").select("doc_id").union(spark.sql("select -1L as doc_id")).distinct()
    docs = table(spark, d, "documents").select("doc_id")
    found = listed.join(docs, "doc_id", "left_semi").select(F.lit("selected").alias("state"))
    lost = listed.join(docs, "doc_id", "left_anti").select(F.lit("listed, not found").alias("state"))
    return found.union(lost).groupBy("state").agg(F.count(F.lit(1)).alias("files"))


@query("selection_digest", """
select source, left(md5(string_agg(doc_id::varchar, chr(10) order by doc_id::varchar)), 8) as digest, count(*) as files
from documents where doc_id in (select doc_id from labels) group by source
""")
def selection_digest(spark, d):
    chosen = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return digests(chosen.select("source", F.col("doc_id").cast("string").alias("name")))


def digests(chosen: DataFrame) -> DataFrame:
    """source, digest and files: the first 8 digits of the MD5 of a source's names (source, name), in order, a line each.

    The digest is sequential, so one task reads a source's names, sorted outside of its memory; it holds one batch of them.
    """
    ship(chosen.sparkSession)

    def digested(batches):
        import hashlib

        import pyarrow as pa

        def row(source, digest, files):
            return pa.RecordBatch.from_arrays([pa.array([source], pa.string()), pa.array([digest.hexdigest()[:8]]), pa.array([files], pa.int64())], ["source", "digest", "files"])

        source, digest, files = None, None, 0
        for batch in batches:
            for of, name in zip(batch.column("source").to_pylist(), batch.column("name").to_pylist()):
                if digest is None or of != source:
                    if digest is not None:
                        yield row(source, digest, files)
                    source, digest, files = of, hashlib.md5(), 0
                digest.update(("\n" if files else "").encode() + name.encode())
                files += 1
        if digest is not None:
            yield row(source, digest, files)

    ordered = chosen.where("name is not null").repartition("source").sortWithinPartitions("source", "name")
    return ordered.mapInArrow(digested, "source string, digest string, files long")


@query("fingerprint", """
select doc_id, md5(length(text)::varchar || left(text, 1000) || case when length(text) > 2000 then right(text, 1000) else '' end) as quick, sha256(text) as content
from documents
""")
def fingerprint(spark, d):
    return table(spark, d, "documents").select("doc_id", S.quick_key(F.col("text"), 1000).alias("quick"), S.content_key(F.col("text")).alias("content"))


@query("exact_duplicates", """
select md5(text) as md5, count(*) as group_size, min(doc_id) as first_doc, (sum(strlen(text)) - min(strlen(text)))::bigint as freed_bytes
from documents group by 1 having count(*) >= 2
""")
def exact_duplicates(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("md5"), F.octet_length("text").cast(LONG).alias("bytes"))
    groups = docs.groupBy("md5").agg(F.count(F.lit(1)).alias("group_size"), F.min("doc_id").alias("first_doc"), (F.sum("bytes") - F.min("bytes")).alias("freed_bytes"))
    return groups.where("group_size >= 2")


_NORMALISED = "trim(lower(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')))"


@query("identical_normalised", f"""
select md5({_NORMALISED}) as key, count(*) as group_size, min(doc_id) as first_doc, count(distinct text) as variants
from documents group by 1 having count(*) >= 2
""")
def identical_normalised(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5(S.normalised(F.col("text"))).alias("key"), F.md5("text").alias("own"))
    return docs.groupBy("key").agg(F.count(F.lit(1)).alias("group_size"), F.min("doc_id").alias("first_doc"), F.count_distinct("own").alias("variants")).where("group_size >= 2")


#: Records for ranking: each rung from a fact about the document or its labels. A family has one language and about one length.
_RECORDS = """
select d.doc_id, md5(lang || ':' || (n_chars // 20)::varchar) as family, md5(text) as md5, n_chars,
  (l.doc_id is not null)::bigint as motion, (source = 'src0')::bigint as raw, 1 - coalesce(toxic, 0)::bigint as "real", n_chars as pixels,
  (position('!!' in text) = 0)::bigint as unedited, (lang = 'en')::bigint as camera, coalesce(quality, 1)::bigint as merged,
  (text like '%.')::bigint as upright, length(replace(text, '#', '')) - length(text) as finer,
  least(2, length(text) - length(replace(text, chr(10), ''))) as metadata,
  -round_even(ln(greatest(length(text) - length(replace(text, '*', '')), 1)) / ln(1.4), 0)::bigint as tier,
  length(text) - length(replace(text, ' ', '')) as sharp, strlen(text) as bytes, lpad(d.doc_id::varchar, 12, '0') as path
from documents d left join (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by 1) l on l.doc_id = d.doc_id
"""
_RUNGS = [r for r in ladder.RUNGS if r != "once"]
_ORDER = ", ".join(f'"{r}" desc' for r in _RUNGS)
_RANKED = f"select *, row_number() over (partition by family order by {_ORDER}) as rank, count(*) over (partition by family) as group_size from ({_RECORDS})"


def records(spark, d) -> DataFrame:
    text = F.col("text")
    lacks = lambda c: (F.length(text) - F.length(F.replace(text, F.lit(c)))).cast(LONG)
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"), F.lit(1).alias("labelled"))
    facts = table(spark, d, "documents").select(
        "doc_id", "n_chars", F.md5(F.concat("lang", F.lit(":"), F.floor(F.col("n_chars") / 20).cast("string"))).alias("family"), F.md5(text).alias("md5"),
        _long(F.col("source") == "src0", "raw"), _long("n_chars", "pixels"), _long(~F.contains(text, F.lit("!!")), "unedited"), _long(F.col("lang") == "en", "camera"),
        _long(F.endswith(text, F.lit(".")), "upright"), (-lacks("#")).alias("finer"), F.least(F.lit(2).cast(LONG), lacks("\n")).alias("metadata"),
        _long(-S.compression_tier(lacks("*").cast("double"), F.lit(False)), "tier"), lacks(" ").alias("sharp"), _long(F.octet_length(text), "bytes"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"),
    )
    joined = facts.join(labels, "doc_id", "left")
    return joined.select(
        *facts.columns, _long(F.col("labelled").isNotNull(), "motion"), (1 - F.coalesce("toxic", F.lit(0))).cast(LONG).alias("real"), F.coalesce("quality", F.lit(1)).cast(LONG).alias("merged")
    )


@query("keeper_ladder", f"select doc_id, family, rank from ({_RANKED}) where group_size >= 2")
def keeper_ladder(spark, d):
    scratch = Scratch(spark, "ladder")
    placed = journal.manifest(ladder.ranked(scratch.table(records(spark, d), "records"), "family", scratch, tuple(_RUNGS)))
    return placed.select("doc_id", "family", F.col("rank").cast(LONG).alias("rank"))


def _phrase_sql(keeper: str, other: str) -> str:
    cases = " ".join(f"""when {keeper}."{r}" <> {other}."{r}" then '{p.replace("'", "''")}'""" for r, p in ladder.LADDER if r in _RUNGS and p)
    return f"case {cases} else '{ladder.TIE}' end"


@query("why_inferior", f"""
with r as ({_RANKED}) select o.doc_id, k.doc_id as kept, {_phrase_sql("k", "o")} as why
from r o join r k on o.family = k.family and k.rank = 1 where o.rank > 1
""")
def why_inferior(spark, d):
    every = records(spark, d)
    best = ladder.keepers(every.withColumn("id", F.col("doc_id")), "family", (*_RUNGS, "id")).where("group_size >= 2")
    joined = every.join(best, "family").where(F.col("doc_id") != F.col("keeper.id"))
    return joined.select("doc_id", F.col("keeper.id").alias("kept"), ladder.why_inferior(F.col("keeper"), F.struct(*_RUNGS), tuple(_RUNGS)).alias("why"))


_UPPER, _LOWER = (", ".join(f'"{r}" desc' for r in rungs) for rungs in (ladder.UPPER, ladder.LOWER))


@query("keeper_lazy_rung", f"""
with u as (select *, rank() over (partition by family order by {_UPPER}) as upper from ({_RECORDS})),
t as (select *, upper = 1 and count(*) over (partition by family, upper) > 1 as probed from u),
o as (select *, case when probed and n_chars % 3 = 0 then 0 else 1 end as once from t),
r as (select *, row_number() over (partition by family order by upper, once desc, {_LOWER}) as rank, count(*) over (partition by family) as group_size from o)
select doc_id, family, probed, rank from r where group_size >= 2
""")
def keeper_lazy_rung(spark, d):
    probe = lambda tied: tied.withColumn("again", F.col("n_chars") % 3 == 0)
    scratch = Scratch(spark, "ladder")
    placed = journal.manifest(ladder.lazily_ranked(scratch.table(records(spark, d), "records"), "family", scratch, probe))
    return placed.select("doc_id", "family", "probed", F.col("rank").cast(LONG).alias("rank"))


_MANIFEST = f"""
with m as (select doc_id, md5(text) as grp, strlen(text) as bytes, n_chars, source from documents),
r as (select *, row_number() over (partition by grp order by (source = 'src0') desc, doc_id) as rank, count(*) over (partition by grp) as group_size from m)
select doc_id, grp as "group", group_size, case when rank = 1 then 'KEEP' else 'REDUNDANT' end as verdict, case when rank = 1 then '' else 'duplicate' end as why, bytes from r where group_size >= 2
"""


def plan(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("group"), _long(F.octet_length("text"), "bytes"), (F.col("source") == "src0").alias("raw"), (-F.col("doc_id")).alias("first"))
    found = journal.marked(docs, "group", ("raw", "first"))
    return found.select("doc_id", "group", "group_size", "verdict", F.when(F.col("verdict") == journal.KEEP, "").otherwise("duplicate").alias("why"), "bytes")


@query("manifest", _MANIFEST)
def manifest(spark, d):
    return plan(spark, d)


@query("manifest_kept_instead", f"""with m as ({_MANIFEST}) select r.doc_id, r."group", k.doc_id as kept_instead
from m r join m k on r."group" = k."group" and k.verdict = 'KEEP' where r.verdict = 'REDUNDANT'""")
def manifest_kept_instead(spark, d):
    return journal.apply_plan(plan(spark, d).withColumnRenamed("doc_id", "file")).select(F.col("file").alias("doc_id"), "group", "kept_instead")


@query("plan_summary", f"""with m as ({_MANIFEST}) select count(distinct "group") as groups, count(*) filter (where verdict = 'REDUNDANT') as redundant,
coalesce(sum(bytes) filter (where verdict = 'REDUNDANT'), 0)::bigint as freed_bytes from m""")
def plan_summary(spark, d):
    redundant = F.col("verdict") == "REDUNDANT"
    return plan(spark, d).agg(F.count(F.when(~redundant, 1)).alias("groups"), F.count(F.when(redundant, 1)).alias("redundant"), F.coalesce(F.sum(F.when(redundant, F.col("bytes"))), F.lit(0).cast(LONG)).alias("freed_bytes"))


#: Pairs of a keeper and each other record of its family, with a verdict made from what texts tell.
_PAIRS = f"""
with r as ({_RANKED}), p as (
select o.doc_id, k.doc_id as kept, k.md5 as k_md5, o.md5 as o_md5, k.raw as k_raw, o.raw as o_raw, k.pixels as k_px, o.pixels as o_px, -k.tier as k_tier, -o.tier as o_tier,
  abs(k.doc_id - o.doc_id) % 40 / 10.0 as apart, least(k.sharp, o.sharp)::double / greatest(k.sharp, o.sharp, 1) as alike, o.pixels::double / greatest(k.pixels, 1) as zoom
from r o join r k on o.family = k.family and k.rank = 1 where o.rank > 1)
"""
_REASON = """case when o_md5 = k_md5 then 'duplicate'
when apart < 2 and (1 - alike) * 100 <= 10 and zoom <= 0.91 then 'crop'
when apart <= 0.01 and (1 - alike) * 100 <= 10 and abs(zoom - 1) < 0.03 and abs(k_px - o_px) > 6 then 'edited'
when k_px > 0 and o_px > 0 and o_px < 0.9 * k_px and alike >= 0.97 then 'smaller'
when o_tier > k_tier + 1 and alike >= 0.97 then 'resave' else 'near-duplicate' end"""


def lineage_pairs(spark, d) -> DataFrame:
    every = records(spark, d).withColumn("id", F.col("doc_id"))
    best = ladder.keepers(every, "family", (*_RUNGS, "id", "md5")).where("group_size >= 2")
    joined = every.join(best, "family").where(F.col("doc_id") != F.col("keeper.id"))
    alike = F.least("keeper.sharp", "sharp").cast("double") / F.greatest("keeper.sharp", "sharp", F.lit(1).cast(LONG))
    zoom = F.col("pixels").cast("double") / F.greatest("keeper.pixels", F.lit(1).cast(LONG))
    sketch = lambda agrees: F.when(agrees, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))  # noqa: E731  two entries, so they agree wholly or not at all
    side = lambda md5, pixels, tier, thumb: F.struct(md5.alias("md5"), F.lit(False).alias("raw"), pixels.alias("pixels"), tier.alias("tier"), thumb.alias("thumb"), F.lit(None).cast("int").alias("rendered"), F.lit(0).alias("w"), F.lit(0).alias("h"), md5.alias("pixels_key"))
    null = lambda n: F.lit(None).cast("double").alias(n)
    verdict = F.struct(
        F.lit("same").alias("scene"), (1 - alike).alias("block"), null("ratio"), F.lit(0.0).alias("shift"), zoom.alias("zoom"), F.lit(0.0).alias("rot"),
        F.when(zoom <= 0.91, 1.0).otherwise(0.0).alias("b_in_a"), F.lit(0.0).alias("a_in_b"), (F.col("keeper.pixels") - F.col("pixels")).cast("double").alias("lum_off"), F.lit(1.0).alias("contrast"),
    )
    keeper = side(F.col("keeper.md5"), F.col("keeper.pixels"), -F.col("keeper.tier"), sketch(F.lit(True)))
    other = side(F.col("md5"), F.col("pixels"), -F.col("tier"), sketch(alike >= 0.97))
    return joined.select("doc_id", F.col("keeper.id").alias("kept"), keeper.alias("keeper"), other.alias("other"), (F.abs(F.col("keeper.id") - F.col("doc_id")) % 40 / 10.0).alias("apart"), verdict.alias("verdict"))


@query("rule_cascade", f"{_PAIRS} select doc_id, kept, {_REASON} as why from p")
def rule_cascade(spark, d):
    return lineage_pairs(spark, d).select("doc_id", "kept", rules.reason().alias("why"))


@query("reason_counts", f"{_PAIRS} select {_REASON} as why, count(*) as n from p group by 1")
def reason_counts(spark, d):
    return lineage_pairs(spark, d).groupBy(rules.reason().alias("why")).agg(F.count(F.lit(1)).alias("n"))


@query("containment_crop", """
select d.doc_id, b.item_id, position(b.text in d.text) as at, round(length(b.text)::double / length(d.text), 6) as share
from documents d join benchmark b on position(b.text in d.text) > 0 and b.text <> ''
""")
def containment_crop(spark, d):
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"))
    return contained(table(spark, d, "documents").select("doc_id", "text"), items)


#: What an item is known by, the first that it has: so many pieces between blanks that it holds whole, else so many bytes.
PIECES, BYTES = (4, 1), (16, 4, 1)


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, at and share of each item (item_id, passage) that a document (doc_id, text) holds, wherever it starts.

    Documents look up the keys at all their places, ids alone; only pairs that meet get their texts, and the passage is searched whole.
    An item's first and last piece may be parts of a document's, so only those between them are keys. Repeated rows come out each.
    Null and empty items are left out.
    """
    items = items.where("passage <> ''").withColumn("item_row", F.xxhash64("item_id", "passage"))
    rows = docs.where("text is not null").withColumn("doc_row", F.xxhash64("doc_id", "text"))
    known = items.selectExpr("item_row", "passage", "size(split(passage, ' ')) - 2 as inner", "octet_length(passage) as bytes")
    cases = [(f"inner >= {n}", f"p{n}", f"xxhash64('p{n}', slice(split(passage, ' '), cast(2 + (inner - {n}) div 2 as int), {n}))") for n in PIECES]
    cases += [(f"bytes >= {n}", f"b{n}", f"xxhash64('b{n}', substring(cast(passage as binary), cast(1 + (bytes - {n}) div 2 as int), {n}))") for n in BYTES]
    choose = lambda k: "case " + " ".join(f"when {c[0]} then {c[k] if k == 2 else repr(c[k])}" for c in cases) + " end"
    keys = known.selectExpr("item_row", f"{choose(1)} as kind", f"{choose(2)} as key").distinct()
    places = {f"p{n}": f"transform(sequence(1, greatest(size(split(text, ' ')) - {n - 1}, 1)), k -> xxhash64('p{n}', slice(pieces, k, {n})))" for n in PIECES}
    places |= {f"b{n}": f"transform(sequence(1, greatest(octet_length(text) - {n - 1}, 1)), k -> xxhash64('b{n}', substring(bytes, k, {n})))" for n in BYTES}
    read = rows.selectExpr("doc_row", "text", "split(text, ' ') as pieces", "cast(text as binary) as bytes")
    met = None
    for kind in sorted(r[0] for r in keys.select("kind").distinct().collect()):  # five at most
        own = read.select("doc_row", F.explode(F.array_distinct(F.expr(places[kind]))).alias("key")).join(keys.where(F.col("kind") == kind), "key").select("doc_row", "item_row")
        met = own if met is None else met.union(own)
    at = F.position(F.col("passage"), F.col("text"))
    both = rows.join(items, F.lit(False)) if met is None else met.distinct().join(rows, "doc_row").join(items, "item_row").where(at > 0)
    return both.select("doc_id", "item_id", at.cast(LONG).alias("at"), F.round(F.length("passage") / F.length("text"), 6).alias("share"))


@query("marker_flags", """
select doc_id, regexp_matches(lower(text), 'photoshop|lightroom|gimp|photo gallery|picasa|snapseed|pixelmator|affinity|luminar|capture one|acdsee|corel|on1|photos |photoscape|paint\\.net') as edited,
lang in ('en', 'de') as maker, n_chars % 7 = 0 as moved, coalesce(nullif(n_chars % 9, 0) not in (1), false) as upright,
((length(text) - length(replace(text, chr(10), '')) >= 5)::bigint + (position('licens' in lower(text)) > 0)::bigint) as meta from documents
""")
def marker_flags(spark, d):
    text = F.col("text")
    flag, lines = F.nullif(F.col("n_chars") % 9, F.lit(0).cast(LONG)), F.length(text) - F.length(F.replace(text, F.lit("\n")))
    return table(spark, d, "documents").select(
        "doc_id", S.signed_by_editor(text).alias("edited"), F.col("lang").isin("en", "de").alias("maker"), (F.col("n_chars") % 7 == 0).alias("moved"),
        F.coalesce(~flag.isin(1), F.lit(False)).alias("upright"), _long((lines >= 5).cast(LONG) + F.contains(F.lower(text), F.lit("licens")).cast(LONG), "meta"),
    )


@query("halving_factor", f"""
select doc_id, case {" ".join(f"when n_chars // {1 << k} >= 2000 then {1 << k}" for k in range(15, 0, -1))} else 1 end::bigint as factor from documents
""")
def halving_factor(spark, d):
    return table(spark, d, "documents").select("doc_id", _long(S.halvings(F.col("n_chars"), F.lit(1).cast(LONG)), "factor"))


@query("companion_flag", """
with f as (select 'shot-' || conv_id || case when turn % 2 = 0 then '.jpg' else '.mov' end as path from conversations)
select path, regexp_replace(path, '\\.[^.]+$', '') in (select regexp_replace(path, '\\.[^.]+$', '') from f where path like '%.mov') as motion,
'.' || split_part(path, '.', -1) as extension from (select distinct path from f) where path like '%.jpg'
""")
def companion_flag(spark, d):
    from keepset.sources.files import with_companion

    path = F.concat(F.lit("shot-"), F.col("conv_id"), F.when(F.col("turn") % 2 == 0, ".jpg").otherwise(".mov"))
    files = table(spark, d, "conversations").select(path.alias("path")).distinct()
    return with_companion(files).where(F.endswith("path", F.lit(".jpg"))).select("path", F.col("motion"), S.extension(F.col("path")).alias("extension"))


@query("cache_hits_misses", """
with c as (select md5(text) as key, min(doc_id) as value, 9 as version from documents where doc_id % 2 = 0 group by 1),
r as (select doc_id, md5(text) as key from documents)
select case when c.key is null then 'miss' else 'hit' end as state, count(*) as records, count(distinct r.key) as keys from r left join c on r.key = c.key and c.version = 9 group by 1
""")
def cache_hits_misses(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("key"))
    old = docs.where(F.col("doc_id") % 2 == 0).groupBy("key").agg(F.min("doc_id").alias("value"))
    held = old.select("key", "value", F.lit(9).alias("version"), F.lit(1).alias("stored_at")).union(old.select("key", "value", F.lit(8), F.lit(2)))
    hits, misses = cache.split(docs, held, ["key"], 9)
    both = hits.select(F.lit("hit").alias("state"), "key").union(misses.select(F.lit("miss"), "key"))
    return both.groupBy("state").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("key").alias("keys"))
