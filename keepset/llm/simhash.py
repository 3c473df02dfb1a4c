"""SimHash near-duplicates with pivot distance tables (operator 4).

1. A document's fingerprint comes from its word shingles, in Arrow batches; equal fingerprints are one node from then on.
2. Pairs meet in groups that share two of five blocks of bits: with at most 3 bits apart, two of the five are equal.
3. Within a group, pivots discard pairs. The table holds each fingerprint's Hamming distances to PIVOTS reference fingerprints; by
   the triangle inequality, distances that differ by more than the limit for any pivot rule a pair out. The group is sorted by the
   first pivot's distances, so only a sliding range of it is compared at all; the other pivots discard, and the Hamming distance
   of the fingerprints verifies what survives.
4. Groups of more than GROUP fingerprints are dealt to cells, one for each pair of their chunks, so that no task holds one whole.
5. A cell sends on a spanning star of each of its connected parts, never all its links; stars are joined to components.

The pipeline's stage (keep_one) takes the same steps with fingerprints of five-word shingles, CLOSE bits apart at most; its cells
send on pairs, which neardup checks by their shingles and to which it adds the similar pairs that are further apart.

Texts of any length are read whole. Null texts have no words, hence fingerprint zero like any text without words; these link like any others. Null ids never become
a component's id unless it has no other. Repeated rows come out each. An empty table gives an empty result. Only doc_id and text
are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepset.llm.graphs import components
from keepset.llm.tokens import slices
from keepset.llm.words import texts_of
from keepset.runtime import Scratch, ship, tidy

BITS_APART, SHINGLE, SEED = 3, 3, 42
#: Bits apart in the pipeline. Of 48 similar pairs of different shingles in sf0.1, 3 are so close; 23 are 7 bits apart at most, which takes
#: 120 keys instead of 10.
CLOSE = 3
#: Blocks of bits that stay equal under up to BITS_APART changes, and one more beyond it; there are so many more blocks than changes.
EQUAL = 2
PIVOTS, GROUP = 16, 4096
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def pivots(n: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(20).integers(0, 1 << 64, n, dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit k is 1 if it is set in over half of the shingles' hashes."""
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return majority(np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are 1 where over half of the hashes have a 1."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint, as a signed long."""
    ship(docs.sparkSession)

    def computed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                found = np.array([fingerprint(x) for x in texts_of(part)], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found)], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(computed), "doc_id long, fingerprint long")


def _masks(limit: int) -> list[int]:
    """Each choice of blocks as the bits it takes, signed; numbers at most `limit` bits apart are equal under one of them."""
    equal = EQUAL + (limit > BITS_APART)
    count = max(limit, BITS_APART) + equal
    blocks, at = [], 0
    for width in (64 // count + (k < 64 % count) for k in range(count)):
        blocks.append(((1 << width) - 1) << at)
        at += width
    return np.array([sum(chosen) for chosen in combinations(blocks, equal)], np.uint64).view(np.int64).tolist()


def _keyed(nodes: DataFrame, limit: int) -> DataFrame:
    """The nodes under each of their keys, a hash of a mask and the fingerprint's bits under it."""
    masked = nodes.select("*", F.explode(F.array(*map(F.lit, _masks(limit)))).alias("mask"))
    return masked.withColumn("key", F.xxhash64("mask", F.col("fingerprint").bitwiseAND(F.col("mask")))).drop("mask")


class _Sweep:
    """Compares the fingerprints of whole groups, given in the order of group and first pivot distance."""

    def __init__(self, limit: int):
        self.limit, self.pivots = limit, pivots()

    def linked(self, group: np.ndarray, prints: np.ndarray, wanted) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the pairs of a group that are at most `limit` bits apart, of those that wanted(a, b) leaves to compare."""
        same = group[1:] == group[:-1]
        at = np.flatnonzero(np.append(same, False) | np.append(False, same))
        group, prints = group[at], prints[at]
        table = np.bitwise_count(prints[:, None] ^ self.pivots[None, :]).astype(np.int8)
        lag, rows = 1, np.arange(len(at) - 1)
        while len(rows):
            other = rows + lag
            near = (group[rows] == group[other]) & (table[other, 0] - table[rows, 0] <= self.limit)
            rows = rows[near]  # a row's later partners are further still
            a, b = rows, rows + lag
            left = wanted(at[a], at[b])
            a, b = a[left], b[left]
            kept = np.abs(table[a] - table[b]).max(axis=1, initial=0) <= self.limit
            a, b = a[kept], b[kept]
            linked = np.bitwise_count(prints[a] ^ prints[b]) <= self.limit
            if linked.any():
                yield at[a[linked]], at[b[linked]]
            lag += 1
            rows = rows[rows + lag < len(at)]

    def pairs(self, group: np.ndarray, prints: np.ndarray, label: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of linked pairs: all of different labels, without labels enough to have each place that any pair has."""
        seen = np.zeros(len(prints), bool)
        for a, b in self.linked(group, prints, lambda a, b: ~(seen[a] & seen[b]) if label is None else label[a] != label[b]):
            seen[a] = True
            seen[b] = True
            yield a, b

    def stars(self, group: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and the smallest-placed node that each is linked to, directly or over others of its group."""
        n = len(prints)
        label, left, right, held = np.arange(n), [], [], 0

        def merge():
            nonlocal label, held
            if held:
                a, b = np.concatenate(left), np.concatenate(right)
                while True:
                    low = np.minimum(label[a], label[b])
                    new = label.copy()
                    np.minimum.at(new, label[a], low)
                    np.minimum.at(new, label[b], low)
                    new = new[new]
                    if (new == label).all():
                        break
                    label = new
                left.clear()
                right.clear()
                held = 0

        for a, b in self.linked(group, prints, lambda a, b: label[a] != label[b]):
            left.append(a)
            right.append(b)
            held += len(a)
            if held > 200_000:
                merge()
        merge()
        at = np.flatnonzero(label != np.arange(n))
        return at, label[at]


def _swept(nodes: DataFrame, limit: int, group: int, found) -> DataFrame:
    """(a, b) that found gives for whole cells. nodes: an id, a fingerprint (may be the same column) and others.

    found takes a sweep, the number of each row's cell and the columns of nodes, in the order of cells and first pivot distance.
    """
    ship(nodes.sparkSession)
    columns = nodes.columns
    keyed = _keyed(nodes, limit)
    large = keyed.groupBy("key").count().where(F.col("count") > group).select("key", F.ceil(F.col("count") / F.lit(group // 2)).alias("chunks"))
    dealt = keyed.join(large, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long")))
    own = F.pmod(F.xxhash64(columns[0]), F.col("chunks"))
    dealt = dealt.withColumn("own", own).select("key", *columns, "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("with"))
    first = int(pivots()[0].astype(np.int64))
    dealt = dealt.select("key", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"), F.bit_count(F.col("fingerprint").bitwiseXOR(F.lit(first))).alias("distance"), *columns)
    cells = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "distance", "fingerprint")

    def swept(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sweep, rest = _Sweep(limit), None

        def compared(cell: np.ndarray, *held: np.ndarray):
            for a, b in found(sweep, np.concatenate([[0], np.cumsum((cell[1:] != cell[:-1]).any(axis=1))]), *held):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            read = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
            rows = [np.stack([read(c) for c in ("key", "low", "high")], axis=1), *map(read, columns)]
            if rest is not None:
                rows = [np.concatenate(x) for x in zip(rest, rows)]
            whole = int(np.argmax((rows[0] == rows[0][-1]).all(axis=1)))
            if whole:
                yield from compared(*(x[:whole] for x in rows))
            rest = [x[whole:] for x in rows]
        if rest is not None:
            yield from compared(*rest)

    return cells.select("key", "low", "high", *columns).mapInArrow(tidy(swept), "a long, b long")


def links(nodes: DataFrame, limit: int = BITS_APART, group: int = GROUP) -> DataFrame:
    """(a, b): enough links between the given distinct fingerprints to connect all that are at most `limit` bits apart."""

    def found(sweep: _Sweep, cell: np.ndarray, prints: np.ndarray):
        at, to = sweep.stars(cell, prints.view(np.uint64))
        yield prints[at], prints[to]

    return _swept(nodes, limit, group, found)


def pairs(nodes: DataFrame, limit: int = CLOSE, group: int = GROUP) -> DataFrame:
    """(a, b), a < b: nodes at most `limit` bits apart. nodes: node, fingerprint and perhaps label, all long.

    With labels all pairs of different ones; without, enough pairs that each node which has a partner is in one.
    """

    def found(sweep: _Sweep, cell: np.ndarray, node: np.ndarray, prints: np.ndarray, label: np.ndarray | None = None):
        for a, b in sweep.pairs(cell, prints.view(np.uint64), label):
            both = np.unique(np.sort(np.stack([node[a], node[b]], axis=1), axis=1), axis=0)
            yield both[:, 0], both[:, 1]

    columns = [c for c in ("node", "fingerprint", "label") if c in nodes.columns]
    return _swept(nodes.select(*columns), limit, group, found).distinct()


def near_duplicates(docs: DataFrame, scratch: Scratch, limit: int = BITS_APART) -> DataFrame:
    """doc_id, fingerprint and component_id, the smallest doc_id of all that its fingerprint reaches."""
    marked = scratch.table(fingerprints(docs), "fingerprints")
    nodes = scratch.table(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "nodes")
    stars = components(links(nodes.select("fingerprint"), limit), scratch)
    member = nodes.join(stars.select(F.col("a").alias("fingerprint"), F.col("b").alias("root")), "fingerprint", "left")
    member = member.select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    roots = member.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(member.join(roots, "root").select("fingerprint", "component_id"), "fingerprint")


def op4_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op4"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents without those that have a near-duplicate before them: of each component the one with the smallest doc_id stays.

    Near-duplicates have five-word shingles of similarity 4/5 or more. Those whose fingerprints are at most CLOSE bits apart meet over
    the pivot tables, the others over neardup's keys; either way the shingles are compared.
    """
    from keepset.llm import neardup  # which uses this module

    found = neardup.near_duplicates(docs, scratch).select(F.col("doc_id").alias("own_id"), "component_id").where(F.col("own_id") != F.col("component_id")).distinct()
    return docs.join(found, docs["doc_id"] == found["own_id"], "left_anti")
