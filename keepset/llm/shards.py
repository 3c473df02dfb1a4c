"""Token ids as patched frame-of-reference blocks (operator 1).

A segment holds the ids of consecutive documents. All numbers are little-endian:

    magic "KPF1" | ids u32 | block length u16 | blocks u32 | block starts u32 x (blocks + 1) | blocks

A block keeps its minimum (u32), the width (u8) and the number of exceptions (u16); then each id less the minimum, cut to its
lowest `width` bits, packed from the lowest bit up; then the exceptions: positions (u16) and whole differences (u32). The width
is that of the difference at a given percentile of the block, so only the few larger ones are exceptions. Block starts count
bytes from the first block, so ids can be read from any place without decoding what stands before.

Segments are rows of a Parquet table in a shared folder, so that Spark's commit protocol keeps a lost executor or a repeated
task from leaving half a file. Null texts count as empty; texts of any length are encoded whole, and one of more ids than a segment
is a segment of its own. Rows come in ascending doc_id order, null ids first; rows with equal
ids come in the order of their texts' hash. An empty table gives an empty table of segments. Extra columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepset.llm.tokens import encoder, slices, vocabulary
from keepset.runtime import Scratch, ship, tidy

BLOCK, PERCENTILE, SEGMENT = 1024, 90, 1 << 18
MAGIC, HEAD, BLOCK_HEAD = b"KPF1", struct.Struct("<4sIHI"), struct.Struct("<IBH")
SEGMENTS = "shard int, segment int, shard_start long, n_ids long, doc_ids array<long>, lengths array<int>, payload binary"


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of unsigned 32-bit values, each cut to its lowest width bits."""
    bits = np.unpackbits(np.ascontiguousarray(values, dtype="<u4").view(np.uint8).reshape(*values.shape, 4), axis=-1, bitorder="little")
    return np.packbits(bits[..., :width].reshape(len(values), -1), axis=1, bitorder="little")


def _unpacked(rows: np.ndarray, n: int, width: int) -> np.ndarray:
    bits = np.zeros((len(rows), n, 32), dtype=np.uint8)
    bits[..., :width] = np.unpackbits(rows, axis=1, count=n * width, bitorder="little").reshape(len(rows), n, width)
    return np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little").view("<u4")


def pack(ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> bytes:
    """One segment's bytes."""
    n = len(ids)
    rows = -(-n // block)
    grid = np.empty(rows * block, dtype=np.uint32)
    grid[:n] = ids
    grid[n:] = ids[-1] if n else 0  # the last block is filled up with its last id
    grid = grid.reshape(rows, block)
    low = grid.min(axis=1, initial=0xFFFFFFFF) if rows else np.zeros(0, np.uint32)
    more = grid - low[:, None]
    at = np.sort(more, axis=1)[:, min(block - 1, block * percentile // 100)] if rows else low
    widths = np.ceil(np.log2(at.astype(np.float64) + 1)).astype(np.int64)
    bodies: list[bytes] = [b""] * rows
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        packed = _packed(more[own], int(width)) if width else np.zeros((len(own), 0), np.uint8)
        over = more[own] >> np.uint32(width) if width < 32 else np.zeros_like(more[own])
        for k, row in enumerate(own):
            where = np.flatnonzero(over[k])
            bodies[row] = BLOCK_HEAD.pack(int(low[row]), int(width), len(where)) + packed[k].tobytes() + where.astype("<u2").tobytes() + more[row, where].astype("<u4").tobytes()
    starts = np.zeros(rows + 1, dtype="<u4")
    np.cumsum([len(x) for x in bodies], out=starts[1:])
    return HEAD.pack(MAGIC, n, block, rows) + starts.tobytes() + b"".join(bodies)


def unpack(payload: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids from start to stop; only the blocks that hold them are read."""
    magic, n, block, rows = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("these bytes are no segment")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, dtype=np.uint32)
    starts = np.frombuffer(payload, "<u4", rows + 1, HEAD.size)
    base = HEAD.size + 4 * (rows + 1)
    first, last = start // block, -(-stop // block)
    heads = [BLOCK_HEAD.unpack_from(payload, base + int(starts[k])) for k in range(first, last)]
    out = np.empty((last - first, block), dtype=np.uint32)
    widths = np.array([x[1] for x in heads])
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        size = -(-block * int(width) // 8)
        at = [base + int(starts[first + k]) + BLOCK_HEAD.size for k in own]
        packed = np.frombuffer(b"".join(payload[x : x + size] for x in at), np.uint8).reshape(len(own), size)
        values = _unpacked(packed, block, int(width)) if width else np.zeros((len(own), block), np.uint32)
        for k, row in enumerate(own):
            low, _, patched = heads[row]
            if patched:
                where = np.frombuffer(payload, "<u2", patched, at[k] + size)
                values[k, where] = np.frombuffer(payload, "<u4", patched, at[k] + size + 2 * patched)
            out[row] = values[k] + np.uint32(low)
    return out.reshape(-1)[start - first * block : stop - first * block]


def write_segments(docs: DataFrame, path: str, vocabulary_path: str, end: int, block: int = BLOCK, percentile: int = PERCENTILE, segment: int = SEGMENT) -> None:
    """Encode whole texts and write their ids to a table of segments at path, shards in ascending doc_id order.

    A segment is closed once it has `segment` ids; a document is never split. The rows are range-partitioned by doc_id, and by
    the text's hash where ids repeat; a shard is one partition.
    """
    ship(docs.sparkSession)

    def encoded(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        shard, number, start = TaskContext.get().partitionId(), 0, 0
        ids, parts, held = [], [], 0
        library = encoder(vocabulary_path)

        def closed():
            lengths = [len(x) // 4 for x in parts]
            payload = pack(np.frombuffer(b"".join(parts), "<u4"), block, percentile)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
            names = ("shard", "segment", "shard_start", "n_ids", "doc_ids", "lengths", "payload")
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip((shard, number, start, held, ids, lengths, payload), kinds)], names)

        for batch in batches:
            for part in slices(batch, 2048, 4_000_000):
                for doc, text_ids in zip(part.column("doc_id").to_pylist(), library.encode(part.column("text").to_pylist(), end)):
                    ids.append(doc)
                    parts.append(text_ids)
                    held += len(text_ids) // 4
                    if held >= segment:
                        yield closed()
                        number, start = number + 1, start + held
                        ids, parts, held = [], [], 0
        if ids:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text").mapInArrow(tidy(encoded), SEGMENTS).write.mode("overwrite").option("compression", "uncompressed").parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with `start`: how many ids all earlier segments have. Totals come to the driver, one row a shard."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    base, before = [], 0
    for shard, n in sorted(map(tuple, segments.groupBy("shard").agg(F.sum("n_ids")).collect())):
        base.append((shard, before))
        before += n
    offsets = F.broadcast(spark.createDataFrame(base, "shard int, before long"))  # a row a shard
    return segments.join(offsets, "shard").withColumn("start", F.col("before") + F.col("shard_start")).drop("before")


def document_digests(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the decoded segments."""
    ship(segments.sparkSession)

    def digests(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for doc_ids, lengths, start, payload in zip(*(batch.column(c) for c in ("doc_ids", "lengths", "start", "payload"))):
                sizes = np.array(lengths.as_py(), dtype=np.int64)
                ends = np.cumsum(sizes)
                raw = memoryview(unpack(payload.as_py()).astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for n, b in zip(sizes.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids.as_py(), pa.int64()), pa.array(ends - sizes + start.as_py()), pa.array(sizes), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.select("doc_ids", "lengths", "start", "payload").mapInArrow(tidy(digests), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op1")
    with scratch.cleaning():
        write_segments(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch.path("segments"), vocabulary("byte_bpe_50k.json"), end=0)
    return document_digests(read_segments(spark, scratch.path("segments")))
