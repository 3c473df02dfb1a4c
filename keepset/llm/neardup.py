"""Near-duplicates by the Jaccard similarity of their five-word shingles, 4/5 or more; no such pair is lost.

1. A document's set holds a 64-bit hash of each run of SHINGLE lower-cased words; one of fewer words has the run of all its words.
   Equal sets are one node from then on. Texts without words are equal, and null ones are such texts.
2. Nodes whose SimHash fingerprints are few bits apart meet over simhash's pivot tables. What follows in 3 and 4 finds the other
   similar nodes: no number of bits holds for every such pair.
3. In an order common to all sets, two sets of similarity 4/5 share one of the first n - ceil(4n/5) + 1 hashes of each (prefix
   filter), so these are the keys under which nodes meet. Hashes come in the order of their values, those that are often keys after
   all others: passages that many texts share bring no pairs together then unless the texts have little else. A bitmap of
   fixed size tells which are often keys; whatever it says, the order is common to all sets, so it decides work, not results.
4. Nodes under one key are compared in cells of at most GROUP, but for those that 2 finds. Sizes, and the bits in which two parity bitmaps differ (never more than
   the sets' symmetric difference), discard pairs without loss, first small bitmaps within a cell, then bitmaps of two bits a hash.
5. Only the sets of nodes that some pair still has are made, in another pass over the texts in which a bitmap of fixed size
   (WANTED_BITS) tells which rows to look at; these pairs are compared hash by hash.
6. A first round compares each node with one that passes at most, of 2 or of 4, which joins most of a large group; the second compares all pairs
   that pass and are not joined yet.

Texts of any length are read whole. Rows with a null id take part; such an id is the smallest only where there is no other. Repeated
rows and ids come out each. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepset.llm import simhash
from keepset.llm.graphs import components
from keepset.llm.templates import bitmap
from keepset.llm.tokens import slices
from keepset.runtime import Scratch, ship, tidy

SHINGLE, GROUP, BITMAP = 5, 4096, 512
#: Keys of more nodes than this go to the end of the order; where an eighth of the bitmap would not hold them, the number is doubled.
OFTEN = 32
#: Bits of a hash that the bitmaps of late keys and of wanted rows take.
WANTED_BITS = 24
_MIX = np.uint64(0xD6E8FEB86659FD93)
_PLAIN = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(1, SHINGLE + 1)]
_NODE = "doc_id long, node long, fingerprint long, size int, bits binary, sketch binary, keys array<long>"


def shingles(texts) -> list[np.ndarray]:
    """The sorted hashes of each text's shingles."""
    import pyarrow as pa
    import pyarrow.compute as pc
    from xxhash import xxh3_64_intdigest

    plain = [x.translate(_PLAIN) for x in pc.fill_null(texts.cast(pa.large_binary()), b"").to_pylist()]
    lists = pc.split_pattern(pa.array(plain, pa.large_binary()), b" ")  # by bytes, as letters hold the bytes of other blanks
    coded = lists.values.dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy()
    doc = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)[code]
    code, doc = code[real], doc[real]
    hashes = np.fromiter(map(xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words))[code]
    ends = np.cumsum(np.bincount(doc, minlength=len(texts)))
    n, run = max(len(hashes) - SHINGLE + 1, 0), np.zeros(max(len(hashes) - SHINGLE + 1, 0), np.uint64)
    for k, power in enumerate(_POWERS):
        run += hashes[k : k + n] * power
    run = _mixed(run)
    out, start = [], 0
    for end in ends.tolist():
        if end - start >= SHINGLE:
            out.append(np.unique(run[start : end - SHINGLE + 1]))
        else:
            out.append(_mixed(np.array([sum(int(h) * int(p) for h, p in zip(hashes[start:end], _POWERS)) + end - start & (1 << 64) - 1], np.uint64)))
        start = end
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return (x ^ (x >> np.uint64(29))) * _MIX


def _held(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which hashes the bitmap has."""
    place = (hashes >> np.uint64(64 - WANTED_BITS)).astype(np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def _keys(own: np.ndarray, late: np.ndarray | None) -> np.ndarray:
    n = len(own)
    if late is not None:
        last = _held(own, late)
        own = np.concatenate([own[~last], own[last]])
    return own[: n - (4 * n + 4) // 5 + 1]


def _bits(own: np.ndarray, width: int = BITMAP) -> bytes:
    return np.packbits(np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).tobytes()


def _apart(a: bytes, b: bytes) -> int:
    """In how many bits two bitmaps differ, the wider one folded to the other's width."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def _node(own: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(own.tobytes())


def _lists(arrays: list[np.ndarray]):
    import pyarrow as pa

    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(np.int64)))


def marked(docs: DataFrame, late: np.ndarray | None = None) -> DataFrame:
    """doc_id and what is known of its set: node, fingerprint, size, small and larger bitmap, and keys, those of the bitmap late last."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(late)

    def computed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        late = shared.value
        for batch in batches:
            for part in slices(batch):
                own = shingles(part.column("text"))
                nodes = np.array([_node(x) for x in own], np.uint64).view(np.int64)
                prints = np.array([simhash.majority(x) for x in own], np.uint64).view(np.int64)
                columns = [part.column("doc_id"), pa.array(nodes), pa.array(prints), pa.array([len(x) for x in own], pa.int32()), pa.array([_bits(x) for x in own], pa.binary()), pa.array([_bits(x, max(BITMAP, 1 << (2 * len(x) - 1).bit_length())) for x in own], pa.binary()), _lists([_keys(x, late) for x in own])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "fingerprint", "size", "bits", "sketch", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(computed), _NODE)


def _late(docs: DataFrame, scratch: Scratch, often: int) -> np.ndarray | None:
    """A bitmap of the keys that more than often nodes have, or more where these are too many for it; None without any."""
    ship(docs.sparkSession)

    def computed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                own = shingles(part.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array(np.array([_node(x) for x in own], np.uint64).view(np.int64)), _lists([_keys(x, None) for x in own])], ["node", "keys"])

    nodes = docs.select("text").mapInArrow(tidy(computed), "node long, keys array<long>").groupBy("node").agg(F.first("keys").alias("keys"))
    counted = nodes.select(F.explode("keys").alias("hash")).groupBy("hash").count().where(F.col("count") > often)
    counted = scratch.table(counted.select("hash", F.ceil(F.log2(F.col("count") / often)).alias("doublings")), "often")
    found, least = sorted(counted.groupBy("doublings").count().collect(), reverse=True), None
    for k, (doublings, n) in enumerate(found):  # at most one row for each power of two
        if k and sum(r[1] for r in found[: k + 1]) > 1 << WANTED_BITS - 3:
            break
        least = doublings
    late = None if least is None else bitmap(counted.where(F.col("doublings") >= least).select("hash"), WANTED_BITS)
    scratch.drop("often")
    return late


def _sets(docs: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and hashes of the nodes that the pairs have, from the rows whose id is a node's first."""
    wanted = nodes.select("node", "first").join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node", "left_semi")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("first").alias("hash")), WANTED_BITS))

    def computed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = shared.value
        for batch in batches:
            known = _held(batch.column("place").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), held)
            for part in slices(batch.filter(pa.array(known))):
                own = shingles(part.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array(np.array([_node(x) for x in own], np.uint64).view(np.int64)), _lists(own)], ["node", "hashes"])

    rows = docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("place"), "text").mapInArrow(tidy(computed), "node long, hashes array<long>")
    return rows.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("hashes").alias("hashes"))


def _met(nodes: DataFrame, scratch: Scratch, group: int) -> DataFrame:
    """The nodes in the cells of each key that two or more have."""
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    counted = scratch.table(keyed.groupBy("key").count().where("count > 1"), "counted")
    cells = F.when(F.col("count") > group, F.ceil(F.col("count") / F.lit(group // 2))).otherwise(F.lit(1).cast("long"))
    many = keyed.join(counted.select("key", cells.alias("chunks")), "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")))
    many = many.select("key", "node", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("with"))
    dealt = many.select("key", "node", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"))
    met = scratch.table(dealt.join(nodes.select("node", "fingerprint", "size", "bits"), "node").select("key", "low", "high", "node", "fingerprint", "size", "bits"), "met")
    scratch.drop("counted")
    return met


def _compared(group: np.ndarray, size: np.ndarray, bits: np.ndarray, prints: np.ndarray, limit: int, label: np.ndarray | None) -> Iterator:
    """Places of pairs that sizes and bitmaps let pass and fingerprints over limit bits apart, in rows sorted by group and size.

    label: all of different ones; none: one each.
    """
    lag, rows, done = 1, np.arange(len(group) - 1), np.zeros(len(group), bool)
    while len(rows):
        other = rows + lag
        rows = rows[(group[rows] == group[other]) & (4 * size[other] <= 5 * size[rows])]  # a row's later partners are larger still
        other = rows + lag
        open_ = ~done[other] if label is None else label[rows] != label[other]
        a, b = rows[open_], other[open_]
        kept = 9 * np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64) <= size[a] + size[b]
        kept &= np.bitwise_count(prints[a] ^ prints[b]) > limit
        if kept.any():
            done[b[kept]] = True
            yield a[kept], b[kept]
        lag += 1
        rows = rows[rows + lag < len(group)]


def _candidates(met: DataFrame, limit: int, labelled: bool) -> DataFrame:
    """(a, b) to compare, over limit bits apart; with a column of labels, all that are left."""
    columns = ["key", "low", "high"]
    cells = met.repartition(*columns).sortWithinPartitions(*columns, "size", "node")

    def swept(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def read(batch):
            whole = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(-1, BITMAP // 64)
            return [np.stack([whole(c) for c in columns], axis=1), whole("node"), whole("size"), bits, whole("fingerprint").view(np.uint64), whole("label") if labelled else whole("node")]

        def found(cell, node, size, bits, prints, label):
            group = np.concatenate([[0], np.cumsum((cell[1:] != cell[:-1]).any(axis=1))])
            for a, b in _compared(group, size, bits, prints, limit, label if labelled else None):
                pairs = np.unique(np.sort(np.stack([node[a], node[b]], axis=1), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = read(batch) if rest is None else [np.concatenate(x) for x in zip(rest, read(batch))]
            whole = int(np.argmax((rows[0] == rows[0][-1]).all(axis=1)))
            if whole:
                yield from found(*(x[:whole] for x in rows))
            rest = [x[whole:] for x in rows]
        if rest is not None:
            yield from found(*rest)

    return cells.mapInArrow(tidy(swept), "a long, b long").distinct()


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that bitmaps of two bits a hash let pass."""

    def passed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a, b, m, n, x, y = (batch.column(c).to_pylist() for c in range(6))
            kept = [k for k in range(len(a)) if 9 * _apart(x[k], y[k]) <= m[k] + n[k]]
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("sketch").alias(f"{c}_sketch"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_size", "b_size", "a_sketch", "b_sketch")
    return both.mapInArrow(tidy(passed), "a long, b long")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    side = lambda c: sets.select(F.col("node").alias(c), F.col("hashes").alias(f"{c}_hashes"))
    shared = F.size(F.array_intersect("a_hashes", "b_hashes"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(9 * shared >= 4 * (F.size("a_hashes") + F.size("b_hashes"))).select("a", "b")


def near_duplicates(docs: DataFrame, scratch: Scratch, group: int = GROUP, often: int = OFTEN, limit: int = simhash.CLOSE) -> DataFrame:
    """doc_id and component_id, the smallest doc_id of all that its set reaches over similar sets.

    limit: how many bits apart fingerprints meet over the pivot tables; it decides which way a pair is found, not whether.
    """
    known = scratch.table(marked(docs, _late(docs, scratch, often)), "marked")
    nodes = scratch.table(known.groupBy("node").agg(F.min("doc_id").alias("first"), *(F.first(c).alias(c) for c in ("fingerprint", "size", "bits", "sketch", "keys"))), "nodes")
    member = scratch.table(known.select("doc_id", "node"), "member")
    scratch.drop("marked")
    prints = nodes.select("node", "fingerprint")
    close = scratch.table(simhash.pairs(prints, limit, group), "close")
    met = _met(nodes, scratch, group)

    def similar(likely: DataFrame, name: str) -> DataFrame:
        sets = scratch.table(_sets(docs, likely, nodes), f"sets_{name}")
        out = scratch.table(_similar(likely, sets), f"similar_{name}")
        scratch.drop(f"sets_{name}")
        return out

    one = scratch.table(_likely(_candidates(met, limit, False).union(close), nodes).groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "one")
    stars = components(similar(one, "one"), scratch)
    labels = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labelled = lambda df: df.join(labels, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    partnered = prints.join(close.select(F.col("a").alias("node")).union(close.select("b")).distinct(), "node", "left_semi")
    left = _candidates(labelled(met), limit, True).union(simhash.pairs(labelled(partnered), limit, group))
    rest = scratch.table(_likely(left.join(one, ["a", "b"], "left_anti"), nodes), "rest")
    scratch.drop("met")
    scratch.drop("close")
    stars = components(stars.union(similar(rest, "rest")), scratch, "all")
    parts = nodes.join(stars.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    parts = scratch.table(parts, "parts")
    scratch.drop("nodes")
    roots = parts.groupBy("root").agg(F.min("first").alias("component_id"))
    return member.join(parts.join(roots, "root").select("node", "component_id"), "node").select("doc_id", "component_id")
