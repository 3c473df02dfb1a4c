"""Repeated long spans over a compacted de Bruijn graph of words (operator 10).

Nodes are runs of K words, edges the words that lead from one to the next. Of the nodes in each window of WINDOW words only the one
with the smallest hash is kept, so equal windows keep equal nodes wherever they stand (minimizer-space de Bruijn graph). All windows
of a document that follow one another and keep the same node make a path: the path's words are one edge of the compacted graph,
known by a 128-bit hash, with the document and position as its source coordinates.

1. Paths whose node only one document has are dropped.
2. A path that a document with a smaller id has too is repeated as a whole: all its windows are. One join settles these.
3. A node with more than one path branches there. Only such paths, and of each path only the first document's, are taken apart
   again: their windows' words are read at the source coordinates, hashed with 128 bits and joined with each other.

Words of repeated windows are then removed. Windows are judged on the input; a window that only documents with the same or a larger
id have stays. Null texts have no words; a row whose id is null loses nothing and no other row loses anything over it. Rows with
equal ids do not count against one another. Texts of fewer words than a window stay whole, and texts of any length are read whole. An
empty table gives an empty result. Only doc_id and text are read, whatever else there is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepset.llm.tokens import slices
from keepset.llm.words import texts_of
from keepset.runtime import Scratch, ship, tidy

WINDOW, K = 50, 20
_ONE, _TWO, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
PATHS = "doc_id long, tie long, node long, path1 long, path2 long, start int, n int"


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2**64; as many as were needed so far."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> None:
        while len(self.up) < n:
            size = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(int(self.base), size, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(int(self.inverse), size, 1 << 64))])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


class Hashed:
    """Hashes of any run of a text's words, from two running sums."""

    _powers = (_Powers(_ONE), _Powers(_TWO))

    def __init__(self, words: list[bytes]):
        from xxhash import xxh3_64_intdigest

        own = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
        self.sums = []
        for powers, values in zip(self._powers, (own, _mixed(own))):
            powers.to(len(words) + 1)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers.up[: len(words)])]))

    def of(self, starts: np.ndarray, lengths, which: int) -> np.ndarray:
        sums = self.sums[which]
        return _mixed((sums[starts + lengths] - sums[starts]) * self._powers[which].down[starts] + np.uint64(which))


def sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    """The least of every `size` values that follow one another."""
    n = len(x)
    padded = np.full(-(-n // size) * size, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, size)
    before = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(after[: n - size + 1], before[size - 1 : n])


def paths_of(words: list[bytes], window: int = WINDOW, k: int = K) -> tuple[np.ndarray, ...] | None:
    """Node, two path hashes, first window and number of windows of each path."""
    if len(words) < window:
        return None
    hashed = Hashed(words)
    kept = sliding_least(hashed.of(np.arange(len(words) - k + 1), k, 0), window - k + 1)
    start = np.concatenate([[0], np.flatnonzero(kept[1:] != kept[:-1]) + 1])
    n = np.diff(np.concatenate([start, [len(kept)]]))
    return kept[start], hashed.of(start, n + window - 1, 0), hashed.of(start, n + window - 1, 1), start, n


def _documents(docs: DataFrame) -> DataFrame:
    """tie tells apart rows with equal ids and other texts."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")


def _paths(texts: DataFrame, window: int, k: int) -> DataFrame:
    def found(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                rows, parts = [], []
                for row, text in enumerate(texts_of(part)):
                    if (own := paths_of(text.split(), window, k)) is not None:
                        rows.append(np.full(len(own[0]), row))
                        parts.append(own)
                if not parts:
                    continue
                at = pa.array(np.concatenate(rows))
                node, one, two, start, n = (np.concatenate(x) for x in zip(*parts))
                hashes = [pa.array(x.view(np.int64)) for x in (node, one, two)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("tie").take(at), *hashes, pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], [x.split()[0] for x in PATHS.split(", ")])

    return texts.where("doc_id is not null").mapInArrow(tidy(found), PATHS)


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """Hashes of the windows at the given places: texts has doc_id, tie, text and places, an array of (start, n)."""

    def found(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                rows, starts, one, two = [], [], [], []
                for row, (text, places) in enumerate(zip(texts_of(part), part.column("places").to_pylist())):
                    hashed = Hashed(text.split())
                    at = np.concatenate([np.arange(x["start"], x["start"] + x["n"]) for x in places])
                    rows.append(np.full(len(at), row))
                    starts.append(at)
                    one.append(hashed.of(at, window, 0))
                    two.append(hashed.of(at, window, 1))
                at = pa.array(np.concatenate(rows))
                hashes = [pa.array(np.concatenate(x).view(np.int64)) for x in (one, two)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("tie").take(at), *hashes, pa.array(np.concatenate(starts).astype(np.int32))], ["doc_id", "tie", "one", "two", "start"])

    return texts.mapInArrow(tidy(found), "doc_id long, tie long, one long, two long, start int")


def repeated_windows(docs: DataFrame, scratch: Scratch, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, tie and places, an array of (start, n): the windows that a document with a smaller id has too."""
    ship(docs.sparkSession)
    texts = _documents(docs)
    paths = scratch.table(_paths(texts, window, k), "paths")
    shared = paths.groupBy("node").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("node")
    paths = scratch.table(paths.join(shared, "node"), "shared")
    scratch.drop("paths")
    path = ["node", "path1", "path2", "n"]
    first = paths.groupBy(*path).agg(F.min("doc_id").alias("first"))
    branching = first.groupBy("node").agg(F.count(F.lit(1)).alias("paths")).where("paths > 1").select("node", F.lit(True).alias("branches"))
    marked = scratch.table(paths.join(first.join(branching, "node", "left"), path).select("doc_id", "tie", "start", "n", (F.col("first") < F.col("doc_id")).alias("settled"), F.coalesce("branches", F.lit(False)).alias("branches")).where("settled or branches"), "marked")
    scratch.drop("shared")
    place = F.collect_list(F.struct("start", "n")).alias("places")  # no more than the document's words
    apart = marked.where("not settled").groupBy("doc_id", "tie").agg(place)
    windows = scratch.table(_windows(texts.join(apart, ["doc_id", "tie"]).select("doc_id", "tie", "text", "places"), window), "windows")
    # Written, so that the join below shares no exchange with the sums and a hot window's rows can be split over tasks.
    earliest = scratch.table(windows.groupBy("one", "two").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("one", "two", "low"), "earliest")
    again = windows.join(earliest, ["one", "two"]).where("low < doc_id").select("doc_id", "tie", "start", F.lit(1).alias("n"))
    every = marked.where("settled").select("doc_id", "tie", "start", "n").unionByName(again)
    out = scratch.table(every.groupBy("doc_id", "tie").agg(place), "repeated")
    scratch.drop("marked")
    scratch.drop("windows")
    scratch.drop("earliest")
    return out


def covered(n_words: int, places: list[dict] | None, window: int = WINDOW) -> np.ndarray:
    """Which words some window at the given places covers."""
    edges = np.zeros(n_words + 1, dtype=np.int64)
    if places:
        start, n = np.array([x["start"] for x in places]), np.array([x["n"] for x in places])
        np.add.at(edges, start, 1)
        np.add.at(edges, start + n + window - 1, -1)
    return np.cumsum(edges[:-1]) > 0


def without_repeats(docs: DataFrame, places: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept, the words left over joined by blanks."""
    ship(docs.sparkSession)

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                rows = []
                for text, found in zip(texts_of(part), part.column("places").to_pylist()):
                    words = text.split()
                    gone = covered(len(words), found, window)
                    n = int(gone.sum())
                    kept = b" ".join([w for w, x in zip(words, gone.tolist()) if not x] if n else words)
                    rows.append((len(words), n, kept))
                n_words, n_gone, kept = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    joined = _documents(docs).join(places, ["doc_id", "tie"], "left").select("doc_id", "text", "places")
    return joined.mapInArrow(tidy(cut), "doc_id long, n_words long, n_removed long, kept string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = without_repeats(docs, repeated_windows(docs, Scratch(spark, "op10")))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same rows from DuckDB, window by window.
ORACLE = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
v as (select doc_id, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')))) as h, unnest(range(1, len(w) - {WINDOW - 2})) as i from d where len(w) >= {WINDOW}),
f as (select h, min(doc_id) as first from v group by 1),
hit as (select v.doc_id, v.i from v join f on f.h = v.h where first < v.doc_id),
x as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d),
m as (select x.doc_id, x.i, word, max((hit.i is not null)::int) over (partition by x.doc_id order by x.i rows between {WINDOW - 1} preceding and current row) as gone from x left join hit on hit.doc_id = x.doc_id and hit.i = x.i),
k as (select doc_id, count(*) filter (where gone = 1) as n_removed, string_agg(word, ' ' order by i) filter (where gone = 0) as kept from m group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k on k.doc_id = d.doc_id
"""
