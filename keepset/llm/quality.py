"""Quality rules (operator 2): base counts, and a logistic regression over hashed word and character n-grams.

Features are four blocks of buckets: pairs of characters (code points), runs of four, words and word pairs, each block the shares of
its n-grams by bucket, so a document's score is a sum of four mean weights. The regression is fitted on a bounded, class-balanced sample of
labelled documents; its scores become probabilities by Platt's method on a second bounded sample in the labels' own shares.
Documents are scored in Arrow batches while they are read, against a fixed threshold; nothing is shuffled.

Null texts count as empty; these have no words and fail the base rules. Texts of any length are read whole. Repeated rows and ids
are judged each. If the labels lack a
class, there is no model and the base rules decide alone. An empty table gives an empty result. Columns other than doc_id and
text are not read; they and their names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepset.llm import words as W
from keepset.llm.labelled import chosen, read
from keepset.llm.tokens import slices
from keepset.runtime import released, ship, tidy

#: Buckets of a block (a power of two), labelled documents of each class that are fitted, those that calibrate, and the threshold.
BITS, FIT_ROWS, CALIBRATION_ROWS, THRESHOLD = 11, 1000, 2000, 0.3
BLOCKS = 4
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The base rules: fewer words, or a larger percentage of words in repeated windows, fail.
LEAST_WORDS, MOST_REPEATED = 50, 50
_HASHES = W.Hashes()


@dataclass
class Model:
    weights: np.ndarray  # BLOCKS x buckets
    slope: float
    shift: float
    bits: int = BITS

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -50, 50)))

    def raw(self, blocks: list[np.ndarray]) -> float:
        return float(sum(w[x].mean() for w, x in zip(self.weights, blocks) if len(x)))


def buckets(text: bytes, words: list[bytes], bits: int = BITS) -> list[np.ndarray]:
    """The bucket of every n-gram, block by block."""
    a = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
    two = a[:-1] * np.uint32(0xC2B2AE35) + a[1:] if len(a) > 1 else a[:0]
    four = two[:-2] * np.uint32(0x27D4EB2F) + two[2:] if len(two) > 2 else a[:0]
    one = _HASHES.array(words)
    pair = one[:-1] * np.uint32(0x85EBCA6B) + one[1:] if len(one) > 1 else one[:0]
    return [((x * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)) for x in (two, four, one, pair)]


def _shares(text: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index and value of the features that are not zero; at most BLOCKS << bits."""
    size = 1 << bits
    out = np.zeros((BLOCKS, size), dtype=np.float32)
    for k, x in enumerate(buckets(text, text.split(), bits)):
        if len(x):
            out[k] = np.bincount(x, minlength=size) / len(x)
    where = np.flatnonzero(out)
    return where, out.reshape(-1)[where]


def _collected(rows: DataFrame, bits: int, parts: int):
    """Places, values (arrays of arrays) and labels of each part of bounded samples, in the order of ids; made on the executors."""
    import pyarrow.compute as pc

    ship(rows.sparkSession)

    def features(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 64):
                found = [_shares(x, bits) for x in W.texts_of(part)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "label", "part")), pa.array([x.astype(np.int16) for x, _ in found], pa.list_(pa.int16())), pa.array([y for _, y in found], pa.list_(pa.float32()))], ["doc_id", "label", "part", "at", "value"])

    table = rows.mapInArrow(tidy(features), "doc_id long, label int, part int, at array<short>, value array<float>").toArrow()
    for k in range(parts):
        own = table.filter(pc.equal(table.column("part"), k)).sort_by([("doc_id", "ascending"), ("label", "ascending")])
        yield own.column("at").combine_chunks(), own.column("value").combine_chunks(), own.column("label").to_numpy().astype(np.float64)


def _raw(at, value, weights: np.ndarray) -> np.ndarray:
    return np.array([float(weights[at[k].values.to_numpy()] @ value[k].values.to_numpy()) for k in range(len(at))])


def _logistic(at, value, y: np.ndarray, size: int, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights by Adam over the whole sample, features scaled by their root mean square; always the same for the same rows."""
    x = np.zeros((len(y), size), dtype=np.float32)
    for k in range(len(y)):
        x[k, at[k].values.to_numpy()] = value[k].values.to_numpy()
    scale = (1 / np.sqrt(np.einsum("ij,ij->j", x, x) / len(x) + 1e-8)).astype(np.float32)
    x *= scale
    x /= np.sqrt(np.einsum("ij,ij->i", x, x)).mean() + np.float32(1e-8)
    w, m, v = np.zeros(size, np.float32), 0.0, 0.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        g = x.T @ (p - y).astype(np.float32) / np.float32(len(y)) + np.float32(decay) * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - np.float32(rate) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return (w * scale).astype(np.float64)


def _platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift with Platt's smoothed targets, by Newton's method."""
    mean, spread = raw.mean(), raw.std() + 1e-9
    z = (raw - mean) / spread
    plus, minus = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (plus + 1) / (plus + 2), 1 / (minus + 2))
    a, b = 1.0, np.log((plus + 1) / (minus + 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        haa, hab, hbb = (h * z * z).sum() + 1e-6, (h * z).sum(), h.sum() + 1e-6
        ga, gb = (d * z).sum(), d.sum()
        det = haa * hbb - hab * hab
        a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
    return float(a / spread), float(b - a * mean / spread)


def _fitted(docs: DataFrame, labels: DataFrame, fit_rows: int, calibration_rows: int, bits: int) -> Model | None:
    apart = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("calibration")), F.lit(5)) == 0
    ids = chosen(labels, "quality", fit_rows, ~apart, by_class=True), chosen(labels, "quality", calibration_rows, apart)
    (at, value, y), (held, shares, truth) = _collected(read(docs, *ids), bits, 2)
    if len(set(y.tolist())) < 2:
        return None
    weights = _logistic(at, value, y, BLOCKS << bits)
    raw = _raw(held, shares, weights)
    if len(set(truth.tolist())) < 2:
        raw, truth = _raw(at, value, weights), y
    slope, shift = _platt(raw, truth)
    size = 1 << bits
    return Model(weights.reshape(BLOCKS, size), slope, shift, bits)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, calibration_rows: int = CALIBRATION_ROWS, bits: int = BITS) -> Model | None:
    """The model, or None if the labels lack a class. One fifth of the labels, by a hash of the id, only calibrates."""
    try:
        return _fitted(docs, labels, fit_rows, calibration_rows, bits)
    finally:
        released()  # the samples' memory on the driver


def _judged(texts: list[bytes], model: Model | None, threshold: float) -> list[tuple]:
    """COUNTS, base_failed, probability and kept of each text."""
    rows = []
    for text in texts:
        words = text.split()
        n, again = len(words), W.n_repeat_words(W.word_numbers(words))
        failed = n < LEAST_WORDS or 100 * again > MOST_REPEATED * n
        p = None if model is None else float(model.probability(np.float64(model.raw(buckets(text, words, model.bits)))))
        rows.append((n, W.word_chars(text), W.n_symbols(text), W.n_dup_lines(text), again, failed, p, not failed and (p is None or p >= threshold)))
    return rows


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, COUNTS, base_failed, probability (null without a model) and kept."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def scored(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64()] * len(COUNTS) + [pa.bool_(), pa.float64(), pa.bool_()]
        for batch in batches:
            for part in slices(batch):
                found = zip(*_judged(W.texts_of(part), shared.value, threshold))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, t) for x, t in zip(found, kinds))], ["doc_id", *COUNTS, "base_failed", "probability", "kept"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(tidy(scored), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, probability double, kept boolean")


def keep_good(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose texts pass, with all their columns."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def passed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array([x[-1] for x in _judged(W.texts_of(part), shared.value, threshold)], pa.bool_()))

    return docs.mapInArrow(tidy(passed), docs.schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))

