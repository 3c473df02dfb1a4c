"""Benchmark decontamination by template canonicalisation (operator 3).

Words are lower-cased and stripped of marks around them; what is left of a text are its tokens. Numbers, units after a number and
names become typed placeholders; their values are the slots. A window of WINDOW tokens is known by hashes of three forms:

- STRICT: names are words with a capital inside a sentence; the first token stands literally, as what is before it may differ.
- VERBATIM: the tokens themselves, values included, whatever their case and marks. Items of any length and windows of few literal
  tokens are found by it.
- LOOSE: names are words with a capital anywhere, and the first token is a placeholder too if it is a name or a number.

Items of fewer tokens are one window. Templates need LITERALS literal tokens, and SHORTEST tokens in all.

1. The items' windows are a small table. A bitmap of fixed size (BITMAP_BITS) of their hashes goes to every worker.
2. Documents are read once; only windows whose bit is set go on, with their slots. These are hash-joined with the items' windows.
3. Slot consistency: within a window equal slots must stand for equal ones, both ways; then, over a run of windows of one alignment of
   a document with an item, each value of the item must stand for one value of the document and the other way round. The longest
   such run counts, and verbatim windows count in any case. matches() takes whole alignments only, and templates only, unless told.

A re-parameterised question so matches its template. Null texts and items count as empty; texts and items of any length are read
whole. Rows with a null id are compared; repeated
rows and equal ids are one document in the result. Empty tables give an empty result. Only doc_id, text, item_id and text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepset.llm.tokens import slices
from keepset.runtime import Scratch, ship, tidy

WINDOW, SHORTEST, LITERALS, BITMAP_BITS = 13, 6, 6, 24
#: Words that are units when they follow a number.
UNITS = frozenset(
    "% ° mm cm m km in ft mi mile miles mg g kg t lb lbs oz ml l liter liters litre litres s sec second seconds min minute minutes h hour hours "
    "day days week weeks month months year years am pm usd eur gbp dollar dollars euro euros cent cents pound pounds percent degrees "
    "meter meters metre metres inch inches foot feet gram grams".split()
)
LITERAL, NUMBER, UNIT, CAPITAL = range(4)
STRICT, VERBATIM, LOOSE = range(3)
_EDGES = r"^[^\pL\pM\pN]+|[^\pL\pM\pN%°]+$"
_NUMBER = r"^[0-9][0-9.,:/]*[a-z%°]{0,3}$"
_CAPITAL = r"^\p{Lu}.*\p{Ll}"
_ENDS = r"""[.!?:]["')\]»”]*$"""
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_HOLES = np.array([0, 0x6A09E667F3BCC909, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B], dtype=np.uint64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64; kept, and as many as the largest slice needed."""
    for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
        while len(_POWERS[k]) < n:
            _POWERS[k] = np.concatenate([_POWERS[k], _POWERS[k] * np.uint64(pow(base, len(_POWERS[k]), 1 << 64))])
    return _POWERS[0][:n], _POWERS[1][:n]


class Templates:
    """Tokens of some texts with their hashes, as literals and as they stand inside a sentence."""

    def __init__(self, texts):
        import pyarrow as pa
        import pyarrow.compute as pc
        from xxhash import xxh3_64_intdigest

        lists = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = lists.values.dictionary_encode()
        words, code = coded.dictionary, coded.indices.to_numpy()
        bare = pc.replace_substring_regex(words, _EDGES, "")
        token = pc.utf8_lower(bare)
        kinds = ((_flags(pc.match_substring_regex(token, _NUMBER)), NUMBER), (_flags(pc.is_in(token, pa.array(sorted(UNITS), pa.large_string()))), UNIT), (_flags(pc.match_substring_regex(bare, _CAPITAL)), CAPITAL))
        kind_of = np.select([x for x, _ in kinds], [k for _, k in kinds], LITERAL)
        self.names = token.to_pylist()
        hash_of = np.fromiter(map(xxh3_64_intdigest, self.names), np.uint64, len(words))
        doc = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
        real = _flags(pc.greater(pc.binary_length(token), 0))[code]
        self.code, self.doc = code[real], doc[real]
        n = len(self.code)
        self.literal, kind, ends = hash_of[self.code], kind_of[self.code], _flags(pc.match_substring_regex(words, _ENDS))[self.code]
        first, after_number = np.ones(n, bool), np.zeros(n, bool)
        same = self.doc[1:] == self.doc[:-1]
        first[1:] = ends[:-1] | ~same
        after_number[1:] = (kind[:-1] == NUMBER) & same
        self.hole = np.where((kind == CAPITAL) & first | (kind == UNIT) & ~after_number, LITERAL, kind)
        loose = np.where((kind == UNIT) & ~after_number, LITERAL, kind)
        self.holes = {STRICT: self.hole, VERBATIM: np.zeros_like(kind), LOOSE: loose}
        up, self.down = _powers(n + 1)
        self.sums, self.literals = {}, {}
        for form, hole in self.holes.items():
            self.sums[form] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(hole > 0, _HOLES[hole], self.literal) * up[:n])])
            self.literals[form] = np.concatenate([[0], np.cumsum(hole == 0)])
        self.firsts = {STRICT: self.literal, VERBATIM: self.literal, LOOSE: np.where((loose == NUMBER) | (loose == CAPITAL), _HOLES[loose], self.literal)}
        self.sizes = np.bincount(self.doc, minlength=len(texts))
        self.start = np.cumsum(self.sizes) - self.sizes

    def windows(self, size: int, only: np.ndarray | None = None, form: int = STRICT) -> tuple[np.ndarray, np.ndarray]:
        """Places (over all texts) and hashes of the windows, of templates those that have enough literal tokens; only: of these texts."""
        n = len(self.code) - size + 1
        if n <= 0 or size < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        fits, literals = self.doc[size - 1 :] == self.doc[:n], self.literals[form]
        if form != VERBATIM:
            fits &= literals[size:] - literals[1 : n + 1] + 1 >= min(LITERALS, size - 1)
        at = np.flatnonzero(fits if only is None else fits & only[self.doc[:n]])
        x = (self.sums[form][at + size] - self.sums[form][at + 1]) * self.down[at] + self.firsts[form][at] * np.uint64(size)
        x = (x ^ (x >> np.uint64(32))) * _MIX
        return at, x ^ (x >> np.uint64(29))

    def slots(self, at: int, size: int, form: int = STRICT) -> list[str]:
        """Kind and value of the placeholders of a window."""
        hole = self.holes[form]
        first = at if form == LOOSE and hole[at] in (NUMBER, CAPITAL) else at + 1
        return [f"{hole[k]}:{self.names[self.code[k]]}" for k in range(first, at + size) if hole[k]]


def _flags(x) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False).astype(bool)


def _found(rows: DataFrame, key: str, of) -> DataFrame:
    """hash, size, form, key, tie, place and slots of windows; of()(templates) gives (size, form, places, hashes)."""
    ship(rows.sparkSession)

    def found(batches: Iterator) -> Iterator:
        import pyarrow as pa

        choose = of()
        for batch in batches:
            for part in slices(batch):
                templates, out = Templates(part.column("text")), []
                for size, form, places, hashes in choose(templates):
                    docs = templates.doc[places]
                    out += zip(hashes.view(np.int64).tolist(), [size] * len(places), [form] * len(places), docs.tolist(), (places - templates.start[docs]).tolist(), [templates.slots(x, size, form) for x in places.tolist()])
                if out:
                    hashes, sizes, forms, at, places, slots = zip(*out)
                    at = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(forms, pa.int32()), part.column(key).take(at), part.column("tie").take(at), pa.array(places, pa.int32()), pa.array(slots, pa.list_(pa.string()))], ["hash", "size", "form", key, "tie", "place", "slots"])

    chosen = rows.select(F.col(key).cast("long").alias(key), F.xxhash64("text").alias("tie"), "text")
    return chosen.mapInArrow(tidy(found), f"hash long, size int, form int, {key} long, tie long, place int, slots array<string>")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    def of():
        def choose(templates):
            sizes = np.minimum(templates.sizes, window)
            return [(int(x), form, *templates.windows(int(x), sizes == x, form)) for x in np.unique(sizes) for form in (STRICT, VERBATIM, LOOSE) if x >= (1 if form == VERBATIM else SHORTEST)]

        return choose

    return _found(benchmark, "item_id", of).drop("tie")


def bitmap(items: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """Which upper bits of hashes occur: 2**bits bits, however many items there are."""
    slot = F.shiftrightunsigned("hash", 64 - bits) + 1  # Spark counts bits from 1
    rows = items.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for bucket, own in rows:
        start = (bucket - 1) * 4096
        out[start : start + len(own)] |= np.frombuffer(bytes(own), np.uint8)[: len(out) - start]
    return out


def _same_pattern(x, y):
    """Equal slots stand for equal slots, both ways, and kinds agree."""
    first = lambda of: F.transform(of, lambda s: F.array_position(of, s))
    kinds = lambda of: F.transform(of, lambda s: F.substring(s, 1, 2))
    return (first(x) == first(y)) & (kinds(x) == kinds(y))


def _counted(windows, whole: bool) -> tuple[int, int]:
    """Windows of one alignment that count, and changed slot values among them; windows: (form, place, item_slots, slots)."""
    places, changed = {x.place for x in windows if x.form == VERBATIM and not whole}, set()
    for form in (STRICT, LOOSE):
        own = sorted((x for x in windows if x.form == form), key=lambda x: x.place)
        best, start, links = range(0), 0, _Links()
        values = [set(zip(x.item_slots, x.slots)) for x in own]
        for stop in range(1, len(own) + 1):
            links.add(values[stop - 1], 1)
            while links.clashes:
                links.add(values[start], -1)
                start += 1
            best = range(start, stop) if stop - start > len(best) else best
        if not whole or len(best) == len(own):
            places |= {own[k].place for k in best}
            changed |= {x for k in best for x in values[k] if x[0] != x[1]}
    return len(places), len({(a[2:], b[2:]) for a, b in changed})


class _Links:
    """Pairs of values in a run of windows, and how many values have more than one partner."""

    def __init__(self):
        self.held, self.partners, self.clashes = Counter(), Counter(), 0

    def add(self, pairs: set, sign: int) -> None:
        for pair in pairs:
            before = self.held[pair] > 0
            self.held[pair] += sign
            if before != (self.held[pair] > 0):
                for end in enumerate(pair):
                    was = self.partners[end] > 1
                    self.partners[end] += sign
                    self.clashes += (self.partners[end] > 1) - was


def matches(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, window: int = WINDOW, bits: int = BITMAP_BITS, whole: bool = True) -> DataFrame:
    """doc_id, tie, item_id, n_windows, n_changed: windows of the item that the document has at one alignment, the most over all
    alignments, and how many of the slot values differ there. whole: templates that are consistent over their whole alignment only;
    else the longest consistent run of each form and all verbatim windows."""
    spark = docs.sparkSession
    items = scratch.table(item_windows(benchmark, window), "items")
    if whole:
        items = items.where(F.col("form") != VERBATIM)
    sizes = sorted(tuple(r) for r in items.select("size", "form").distinct().collect())  # window and shorter: a few
    shared = spark.sparkContext.broadcast((bitmap(items, bits), sizes))  # 2**bits bits

    def of():
        held, sizes = shared.value
        shift = np.uint64(64 - bits)

        def choose(templates):
            for size, form in sizes:
                starts, hashes = templates.windows(size, form=form)
                slot = (hashes >> shift).astype(np.int64)
                known = (held[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
                if known.any():
                    yield size, form, starts[known], hashes[known]

        return choose

    found = _found(docs, "doc_id", of)
    items = items.select("hash", "size", "form", "item_id", F.col("place").alias("item_place"), F.col("slots").alias("item_slots"))
    met = found.join(items, ["hash", "size", "form"]).where(_same_pattern(F.col("slots"), F.col("item_slots")))
    windows = F.collect_set(F.struct("form", F.col("item_place").alias("place"), "item_slots", "slots")).alias("windows")
    aligned = met.groupBy("doc_id", "tie", "item_id", (F.col("place") - F.col("item_place")).alias("shift")).agg(windows)
    counted = F.udf(lambda x: _counted(x, whole), "n_windows long, n_changed long")
    aligned = aligned.withColumn("counted", counted("windows")).select("doc_id", "tie", "item_id", "counted.*").where("n_windows > 0")
    return aligned.groupBy("doc_id", "tie", "item_id").agg(F.max("n_windows").alias("n_windows"), F.min_by("n_changed", F.struct(-F.col("n_windows"), "n_changed")).alias("n_changed"))


def op3_template_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return matches(docs, benchmark, Scratch(spark, "op3"), whole=False).groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.min_by("n_changed", F.struct(-F.col("n_windows"), "n_changed")).alias("n_changed"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents that match no item, with their own columns."""
    found = scratch.table(matches(docs, benchmark, scratch, whole=False).select(F.col("doc_id").alias("found_id"), F.col("tie").alias("found_tie")).distinct(), "found")
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["found_id"]) & (F.xxhash64(docs["text"]) == found["found_tie"]), "left_anti")
