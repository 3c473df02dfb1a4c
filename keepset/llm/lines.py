"""Line dedup by a segment-partition edit join, in DataFrame operations only (operator 7).

Lines are what line feeds part; lines without a word are left alone. Two different lines are linked if both have at least LEAST
characters and at most EDITS edits (insert, delete, replace a character) turn one into the other. A line goes if an equal or linked
line stands in a document with a smaller id, or an equal one earlier in the same document.

1. Equal lines meet first, counted within each task before the shuffle; from then on each different line is one row.
2. A line of length l is cut into EDITS + 1 segments. Some segment of it is found unchanged in any linked line, at a place that
   the two lengths bound: each line puts its own segments into the index, and probes it with those substrings that may match
   the segments of lines of its own and the EDITS next smaller lengths.
3. The join of probes and index also compares, inside its condition, the lengths and how often either line has each of
   sixteen frequent letters; an edit adds one letter at most and takes one at most. So lines that only share a segment leave few pairs.
4. The pairs that are left are verified once each by Spark's levenshtein with a threshold, which computes the band of the matrix
   only and stops early. (It takes the place of a bit-parallel one: words of bits in higher-order functions are interpreted.)
5. A segment that more than BUSY lines have (a numbered footer's words) would leave all pairs of them. Its lines meet in cells that
   verify a pair inside the join and add it up on the spot, so that neither pairs nor a whole group reach a task or a table.

Null texts have no lines. Rows with a null id lose only lines that repeat within them. Rows with equal ids do not count against one
another; repeated rows are judged alike. A text or line of any length is compared whole. An empty table gives an empty result. Extra
columns, whatever their names, are passed through by dedup_lines() and are not read elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepset.runtime import Scratch, quoted, unused

#: Edits that link lines, and the characters that a line needs to be linked to another.
EDITS, LEAST = 2, 24
#: Letters that sketches count, and those that stand beside them in crowds.
LETTERS, MORE_LETTERS = "etanorihsdlcumgp", "0123456789bfvwyz"
#: Lines beyond which a segment's key is busy, and lines on either side of a cell of such a key.
BUSY, CELL = 1000, 4096
#: Pairs whose numbers may be broadcast: 16 bytes each.
FEW = 1_000_000
_WHITE = " \t\n\x0b\x0c\r"


def _marked(text: Column) -> Column:
    """The lines in order, each different one once. Lines without a word are told apart by a line feed and their number."""
    lines = F.split(text, "\n")
    return F.array_distinct(F.transform(lines, lambda x, i: F.when(F.ltrim(x, F.lit(_WHITE)) != "", x).otherwise(F.concat(x, F.lit("\n"), i.cast("string")))))


def _has_word(line: Column) -> Column:
    return ~F.contains(line, F.lit("\n"))


def _hashes(line: Column) -> list[Column]:
    """96 bits that stand for a line where its text is not needed."""
    return [F.xxhash64(line).alias("h1"), F.hash(line).alias("h2")]


def different_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """One row per different line: line, first (the smallest doc_id that has it), number (unique), length, sketch and own, the keys of
    its segments."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(_marked(F.col("text"))).alias("line")).where(_has_word(F.col("line")))
    lines = own.groupBy("line").agg(F.min("doc_id").alias("first")).withColumn("number", F.monotonically_increasing_id())
    lines = lines.withColumns({"length": F.char_length("line"), "sketch": _sketch(F.col("line"))})
    return lines.withColumn("own", F.when(F.col("length") >= least, F.array_distinct(F.array(*_own(edits)))))


def _sketch(line: Column, letters: str = LETTERS) -> Column:
    """Counts of 16 letters modulo 4, two bits each, in the Gray code, so that one letter more or less changes one bit."""
    out = F.lit(0)
    for k, letter in enumerate(letters):
        count = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter)))
        gray = count.bitwiseXOR(F.shiftright(count, 1)).bitwiseAND(F.lit(3))
        out = out.bitwiseOR(F.shiftleft(gray, 2 * k))
    return out


def _segment(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """Start (from 0) and size of segment i of a line of that length; the last ones are longer by one where it does not divide."""
    n = edits + 1
    size = F.floor(length / n).cast("int")
    longer = length - size * n
    before = F.greatest(F.lit(0), longer - (n - i))
    return F.lit(i) * size + before, size + F.when(F.lit(i) >= F.lit(n) - longer, 1).otherwise(0)


def _shifts(i: int, more: int, edits: int) -> range:
    """By how much a matching substring may start after segment i, in a line that is longer by `more`."""
    return range(max(-i, more - (edits - i)), min(i, more + (edits - i)) + 1)


def _key(i: int, at: Column, size: Column) -> Column:
    return F.xxhash64(F.lit(i), F.substring(F.col("line"), at + 1, size))


def _own(edits: int) -> list[Column]:
    """The keys of a line's segments: their number and characters."""
    return [_key(i, *_segment(F.col("length"), i, edits)) for i in range(edits + 1)]


def _index(lines: DataFrame) -> DataFrame:
    """(key, a, length_a, sketch_a) of the lines' own segments."""
    return lines.select(F.col("number").alias("a"), F.col("length").alias("length_a"), F.col("sketch").alias("sketch_a"), F.explode("own").alias("key"))


def _probe(lines: DataFrame, edits: int, least: int) -> DataFrame:
    """(key, b, length_b, sketch_b) of what lines look for. The lengths are compared in the join's condition, so probes that several
    lengths share are sent once."""
    lines, length, keys = lines.where(F.col("length") >= least), F.col("length"), []
    for i in range(edits + 1):
        for more in range(edits + 1):
            at, size = _segment(length - more, i, edits)
            keys += [F.when(length - more >= least, _key(i, at + shift, size)) for shift in _shifts(i, more, edits)]
    return lines.select(F.col("number").alias("b"), length.alias("length_b"), F.col("sketch").alias("sketch_b"), F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("key"))


def _apart(x: str, y: str, edits: int) -> Column:
    """Whether two sketches let a pair pass: an edit takes one letter and adds one at most, a length's difference adds only."""
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= 2 * edits - (F.col("length_b") - F.col("length_a"))


def _fits(edits: int) -> Column:
    """Whether lengths and sketches let a pair pass; of two lines of one length the one with the smaller number is a."""
    more = F.col("length_b") - F.col("length_a")
    return more.between(0, edits) & ((more > 0) | (F.col("a") < F.col("b"))) & _apart("sketch_a", "sketch_b", edits)


def links(lines: DataFrame, edits: int = EDITS, least: int = LEAST, busy: DataFrame | None = None) -> DataFrame:
    """(a, b) numbers of different lines that may have at most `edits` edits between them, each pair once, b the longer one.

    lines: different_lines(), or number, line, length and sketch. busy: keys under which lines are not to meet.
    """
    if "own" not in lines.columns:
        lines = lines.withColumn("own", F.when(F.col("length") >= least, F.array_distinct(F.array(*_own(edits)))))
    index, probe = _index(lines), _probe(lines, edits, least)
    if busy is not None:
        index = index.join(busy, "key", "left_anti")
    probe = probe.withColumnRenamed("key", "key_b")
    return index.join(probe, (F.col("key") == F.col("key_b")) & _fits(edits)).select("a", "b").distinct()


def _crowded(lines: DataFrame, busy: DataFrame, pairs: DataFrame, scratch: Scratch, edits: int, least: int, cell: int) -> tuple[DataFrame, DataFrame]:
    """(number, n, near) over the links of lines that meet under busy keys, and the pairs that share no such key.

    A key's lines are dealt to cells of at most about `cell` on either side. A pair is verified inside the join's condition, under
    the smallest busy key it shares, and is added up where it is found: no pair is written or shuffled.
    """
    index, probe = _index(lines), _probe(lines, edits, least)
    own = scratch.table(index.join(busy.select("key"), "key").select("key", "a"), "own")
    asked = scratch.table(probe.join(busy.select("key"), "key").select("key", "b"), "asked")
    held = scratch.table(own.groupBy("a").agg(F.collect_set("key").alias("own_keys")), "held")  # a line's segments
    wanted = scratch.table(asked.groupBy("b").agg(F.collect_set("key").alias("asked_keys")), "wanted")  # a line's probes
    chunks = lambda of, name: of.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(cell)).alias(name))
    dealt = scratch.table(chunks(own, "rows").join(chunks(asked, "columns"), "key"), "dealt")
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one_of = lambda who, n: F.pmod(F.xxhash64(who), F.col(n))

    def side(of: DataFrame, keys: DataFrame, who: str, row: Column, column: Column) -> DataFrame:
        text = lines.select(F.col("number").alias(who), *(F.col(c).alias(f"{c}_{who}") for c in ("length", "sketch", "first", "line")), _sketch(F.col("line"), MORE_LETTERS).alias(f"more_{who}"))
        rows = of.join(dealt, "key").join(keys, who).withColumn("row", row).withColumn("column", column).drop("rows", "columns")
        return rows.join(text, who)

    left = side(own, held, "a", one_of("a", "rows"), all_of("columns"))
    right = side(asked, wanted, "b", all_of("rows"), one_of("b", "columns")).withColumnsRenamed({"key": "key_b", "row": "row_b", "column": "column_b"})
    met = (F.col("key") == F.col("key_b")) & (F.col("row") == F.col("row_b")) & (F.col("column") == F.col("column_b")) & _fits(edits)
    met = met & _apart("more_a", "more_b", edits)
    met = met & (F.array_min(F.array_intersect("own_keys", "asked_keys")) == F.col("key")) & (F.levenshtein("line_a", "line_b", edits) >= 0)
    ends = F.array(F.struct(F.col("a").alias("number"), F.col("first_b").alias("near")), F.struct(F.col("b").alias("number"), F.col("first_a").alias("near")))
    found = left.join(right, met).select(F.explode(ends).alias("end")).groupBy("end.number").agg(F.count(F.lit(1)).alias("n"), F.min("end.near").alias("near"))
    apart = pairs.join(held, "a", "left").join(wanted, "b", "left").where(~F.coalesce(F.arrays_overlap("own_keys", "asked_keys"), F.lit(False)))
    return scratch.table(found, "crowded"), scratch.table(apart.select("a", "b"), "apart")


def verified(pairs: DataFrame, lines: DataFrame, edits: int = EDITS, few: int = FEW) -> DataFrame:
    """The pairs whose lines are within `edits`. Texts of lines that no pair has are left out first: by a broadcast of the pairs'
    numbers if they are few, else by a shuffle."""
    wanted = pairs.select(F.col("a").alias("number")).union(pairs.select("b")).distinct()
    if pairs.count() <= few:
        wanted = F.broadcast(wanted)
    texts = lines.select("number", "line").join(wanted, "number", "left_semi")
    held = pairs.join(texts.select(F.col("number").alias("a"), F.col("line").alias("x")), "a")
    other = texts.select(F.col("number").alias("other"), F.col("line").alias("y"))
    return held.join(other, (F.col("b") == F.col("other")) & (F.levenshtein("x", "y", edits) >= 0)).select("a", "b")


def line_classes(docs: DataFrame, scratch: Scratch, edits: int = EDITS, least: int = LEAST, busy: int = BUSY, cell: int = CELL) -> DataFrame:
    """h1, h2, first, n_links and near_first of each different line: the smallest doc_id that has it, its linked lines, and the
    smallest doc_id that has one of them."""
    lines = scratch.table(different_lines(docs, edits, least), "lines")
    crowds = scratch.table(_index(lines).groupBy("key").count().where(F.col("count") > busy), "busy")
    crowded = not crowds.isEmpty()
    pairs = scratch.table(links(lines, edits, least, crowds if crowded else None), "pairs")
    if crowded:
        found, pairs = _crowded(lines, crowds, pairs, scratch, edits, least, cell)
    linked = scratch.table(verified(pairs, lines, edits), "links")
    both = linked.union(linked.select("b", "a")).toDF("number", "other")
    first = lines.select(F.col("number").alias("other"), F.col("first").alias("other_first"))
    near = both.join(first, "other").groupBy("number").agg(F.count(F.lit(1)).alias("n"), F.min("other_first").alias("near"))
    if crowded:
        near = near.union(found).groupBy("number").agg(F.sum("n").alias("n"), F.min("near").alias("near"))
    out = lines.select("number", "first", *_hashes(F.col("line"))).join(near, "number", "left")
    out = scratch.table(out.select("h1", "h2", "first", F.coalesce("n", F.lit(0).cast("long")).alias("n_links"), F.col("near").alias("near_first")), "classes")
    for name in ("lines", "busy", "pairs", "links", "own", "asked", "held", "wanted", "dealt", "crowded", "apart"):
        scratch.drop(name)
    return out


def _judged(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """One row per document and different line: doc_id, tie (tells apart rows with equal ids), place, worded, `gone` and the columns
    of its class, null for lines without a word."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.posexplode(_marked(F.col("text"))).alias("place", "line"))
    own = own.select("doc_id", "tie", "place", _has_word(F.col("line")).alias("worded"), *_hashes(F.col("line")))
    return own.join(classes, ["h1", "h2"], "left").withColumn("gone", F.coalesce(F.least("first", "near_first") < F.col("doc_id"), F.lit(False)))


def document_lines(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Per doc_id: its different lines with a word, how many go, the links of its lines, and class_id, the smallest doc_id with which
    it shares an equal or linked line (its own included). Documents without lines have zeros and their own id."""
    zero = F.lit(0).cast("long")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), zero.alias("n"), zero.alias("n_gone"), zero.alias("n_links"), F.col("doc_id").cast("long").alias("class_id"))
    judged = _judged(docs, classes).where("worded").select("doc_id", F.lit(1).cast("long").alias("n"), F.col("gone").cast("long").alias("n_gone"), "n_links", F.least("first", "near_first", "doc_id").alias("class_id"))
    return every.unionByName(judged).groupBy("doc_id").agg(F.sum("n").alias("n_lines"), F.sum("n_gone").alias("n_removed"), F.sum("n_links").alias("n_links"), F.min("class_id").alias("class_id"))


def dedup_lines(docs: DataFrame, scratch: Scratch, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """The documents with their own columns, texts without the lines that go; n_chars, if there, is set anew."""
    judged = _judged(docs, line_classes(docs, scratch, edits, least))
    found = judged.groupBy("doc_id", "tie").agg(F.max("gone").alias("some"), F.array_sort(F.collect_set(F.struct("place", "gone"))).alias("places")).where("some")
    own_id, own_tie, places, kept = unused(docs, "own_id", "own_tie", "places", "kept")  # docs may have any other column
    found = found.select(F.col("doc_id").alias(own_id), F.col("tie").alias(own_tie), F.col("places.gone").alias(places))
    joined = docs.join(found, (docs["doc_id"].cast("long") == found[own_id]) & (F.xxhash64(docs["text"]) == found[own_tie]), "left")
    marked = _marked(docs["text"])
    stays = F.when(found[places].isNull(), marked).otherwise(F.filter(marked, lambda x, i: ~F.get(found[places], i)))
    text = F.when(docs["text"].isNotNull(), F.array_join(F.transform(stays, lambda x: F.substring_index(x, "\n", 1)), "\n"))
    out = joined.withColumn(kept, text).select(F.col(kept), *(docs[quoted(c)] for c in docs.columns))
    columns = {"text": F.col(kept), "n_chars": F.char_length(kept).cast("long")}
    return out.select(*(columns[c].alias(c) if c in columns else F.col(quoted(c)) for c in docs.columns))


def op7_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return document_lines(docs, line_classes(docs, Scratch(spark, "op7")))


_COUNTS = ", ".join(f"length(line) - length(replace(line, '{c}', '')) as n_{c}" for c in LETTERS[:8])
_APART = " + ".join(f"abs(a.n_{c} - b.n_{c})" for c in LETTERS[:8])
#: The same rows from DuckDB: lines of like length and letters, each pair measured.
ORACLE = f"""
with l as (select distinct doc_id, line from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
u as materialized (select line, min(doc_id) as first, length(line) as n, {_COUNTS} from l group by line),
p as materialized (select a.line as x, b.line as y, a.first as x_first, b.first as y_first from u a cross join (select unnest(range({EDITS + 1})) as more) join u b on b.n = a.n + more
  where a.n >= {LEAST} and (more > 0 or a.line < b.line) and {_APART} <= {2 * EDITS} and levenshtein(a.line, b.line) <= {EDITS}),
e as (select line, count(*) as n_links, min(other) as near from (select x as line, y_first as other from p union all select y, x_first from p) group by 1),
j as (select l.doc_id, coalesce(n_links, 0) as n_links, least(u.first, coalesce(near, u.first)) as first from l join u on u.line = l.line left join e on e.line = l.line),
g as (select doc_id, count(*) as n_lines, count(*) filter (where first < doc_id) as n_removed, sum(n_links)::bigint as n_links, min(least(first, doc_id)) as class_id from j group by 1)
select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_links, 0)::bigint as n_links, coalesce(class_id, d.doc_id) as class_id
from (select distinct doc_id from documents) d left join g on g.doc_id = d.doc_id
"""
