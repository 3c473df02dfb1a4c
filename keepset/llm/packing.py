"""Vector bin packing of token ids into training sequences (operator 5).

A document is a list of parts (text, loss): its ids are those of the parts, one after another, and an end id. Three limits hold
for a sequence at once: tokens, segments (pieces of documents) and loss-bearing tokens. A document's first id and the ids of
parts without loss bear no loss. Each partition is packed on its own while it is read:

1. What a document has beyond the limits is cut off in full sequences.
2. The rests wait in a pool of bounded size. For the open sequence, the pool's piece with the largest dot product of its size
   and the room left (both as shares of the limits) is placed, as long as one fits whole.
3. Then the piece that leaves most behind is cut to fill the room. A sequence that the segment or loss limit closed early, and
   a partition's last one, is cut down to a power of two; the rest goes back to the pool. So no sequence needs padding.

Null texts and null parts count as empty: such a document has its end id alone. Texts of any length are encoded whole. Rows with equal ids are packed as documents of
their own. An empty table gives no pieces. Columns other than the key and the texts are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepset.llm.tokens import encoder, slices, vocabulary
from keepset.runtime import ship, tidy

#: Tokens, segments and loss-bearing tokens of a sequence; pieces that wait in a partition's pool.
LIMITS, POOL = (4096, 128, 4096), 512
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, offset long, sequence_tokens long"


class Pool:
    """Pieces that wait, as rows (document, start, stop) with their sizes; documents are kept while a piece of them waits."""

    def __init__(self, limits):
        self.limits = np.array(limits, dtype=np.float64)
        self.size = np.zeros((0, 3))
        self.rows: list[tuple] = []

    def add(self, piece) -> None:
        self.rows.append(piece)
        doc, start, stop = piece
        need = (stop - start, 1, doc.loss(start, stop))
        at = len(self.rows) - 1
        if at >= len(self.size):
            self.size = np.vstack([self.size, np.full((max(64, at), 3), np.inf)])
        self.size[at] = need

    def take(self, at: int):
        last = len(self.rows) - 1
        piece = self.rows[at]
        self.rows[at] = self.rows[last]
        self.size[at] = self.size[last]
        self.size[last] = np.inf
        self.rows.pop()
        return piece

    def best(self, room: np.ndarray) -> int | None:
        """The piece that fits the room and has the largest dot product with it."""
        sizes = self.size[: len(self.rows)]
        fits = (sizes <= room).all(axis=1)
        if not fits.any():
            return None
        return int(np.argmax(np.where(fits, (sizes / self.limits) @ (room / self.limits), -1.0)))


class Document:
    def __init__(self, key, parts: list[tuple[bytes, bool]], end: int):
        self.key = key
        self.ids = b"".join(x for x, _ in parts) + int(end).to_bytes(4, "little")
        self.n = len(self.ids) // 4
        self.whole = all(loss for _, loss in parts)
        if not self.whole:
            bears = np.concatenate([np.full(len(x) // 4, loss) for x, loss in parts] + [[parts[-1][1]]])
            bears[0] = False
            self.before = np.concatenate([[0], np.cumsum(bears)])

    def loss(self, start: int, stop: int) -> int:
        return stop - start - (start == 0) if self.whole else int(self.before[stop] - self.before[start])

    def reach(self, start: int, stop: int, tokens: float, loss: float) -> int:
        """The furthest end of a piece from start within both limits."""
        stop = min(stop, start + int(tokens))
        if self.whole:
            return min(stop, start + int(loss) + (start == 0))
        return min(stop, int(np.searchsorted(self.before, self.before[start] + loss, side="right")) - 1)


class Packer:
    """Makes sequences: lists of pieces (document, start, stop)."""

    def __init__(self, limits=LIMITS, pool: int = POOL):
        self.limits, self.keep, self.pool = tuple(limits), pool, Pool(limits)

    def put(self, doc: Document) -> Iterator[list[tuple]]:
        start = 0
        while True:
            stop = doc.reach(start, doc.n, self.limits[0], self.limits[2])
            if stop < doc.n and stop - start == self.limits[0]:
                yield [(doc, start, stop)]
            elif stop < doc.n:  # the loss limit comes first: the piece fills no sequence
                self.pool.add((doc, start, stop))
            else:
                self.pool.add((doc, start, stop))
                break
            start = stop
        while len(self.pool.rows) >= self.keep:
            yield self.sequence()

    def rest(self) -> Iterator[list[tuple]]:
        while self.pool.rows:
            yield self.sequence()

    def sequence(self) -> list[tuple]:
        out, room = [], np.array(self.limits, dtype=np.float64)
        while room[0] >= 1 and room[1] >= 1 and self.pool.rows:
            at = self.pool.best(room)
            if at is not None:
                doc, start, stop = self.pool.take(at)
            else:  # nothing fits whole: cut what is longest
                at = int(np.argmax(self.pool.size[: len(self.pool.rows), 0]))
                doc, start, end = self.pool.rows[at]
                stop = doc.reach(start, end, room[0], room[2])
                if stop <= start:
                    break
                self.pool.take(at)
                self.pool.add((doc, stop, end))
            out.append((doc, start, stop))
            room -= (stop - start, 1, doc.loss(start, stop))
        total = self.limits[0] - int(room[0])
        over = total - (1 << (total.bit_length() - 1)) if total < self.limits[0] else 0
        while over:
            doc, start, stop = out.pop()
            cut = max(start, stop - over)
            over -= stop - cut
            self.pool.add((doc, cut, stop))
            if cut > start:
                out.append((doc, start, cut))
        return out


def pack(docs: DataFrame, vocabulary_path: str, end: int, parts: Column | None = None, limits=LIMITS, pool: int = POOL, ids: bool = False) -> DataFrame:
    """One row per piece: PIECES, and with ids=True the piece's ids as little-endian unsigned 32-bit integers.

    docs: doc_id and text; or doc_id and parts, an array of (text string, loss boolean). No shuffle: sequence_id holds the
    partition in its upper bits, and each partition closes its last sequences at powers of two.
    """
    ship(docs.sparkSession)
    schema = PIECES + (", ids binary" if ids else "")
    names, plain = [x.strip().split()[0] for x in schema.split(",")], parts is None

    def packed(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        library, packer = encoder(vocabulary_path), Packer(limits, pool)
        number = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def add(sequences) -> None:
            nonlocal number
            for pieces in sequences:
                offset, total = 0, sum(stop - start for _, start, stop in pieces)
                for doc, start, stop in pieces:
                    raw = doc.ids[4 * start : 4 * stop]
                    rows.append((doc.key, start, stop - start, zlib.crc32(raw), doc.n, doc.loss(start, stop), number, offset, total) + ((raw,) if ids else ()))
                    offset += stop - start
                number += 1

        def batch_of_rows():
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if n == "ids" else pa.int64()) for x, n in zip(columns, names)], names)

        for batch in batches:
            for part in slices(batch, 2048, 8_000_000) if plain else [batch]:
                keys = part.column("doc_id").to_pylist()
                if plain:
                    docs_ids = [[(x, True)] for x in library.encode(part.column("text"), None)]
                else:
                    docs_ids = [[(library.encode([p and p["text"]], None)[0], bool(p and p["loss"])) for p in row or []] or [(b"", True)] for row in part.column("parts").to_pylist()]
                for key, own in zip(keys, docs_ids):
                    add(packer.put(Document(key, own, end)))
                yield batch_of_rows()
        add(packer.rest())
        yield batch_of_rows()

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text") if parts is None else parts.alias("parts"))
    return chosen.mapInArrow(tidy(packed), schema)


def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("word_bpe_49k.json"), end=2)
