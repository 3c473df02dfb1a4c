"""Quality scores from a sparse ensemble of rules (operator 6).

1. Statistics of whole texts are computed in Arrow batches.
2. On a bounded sample of labelled documents, small boosted trees are grown on the statistics; every path from a root to a node is a
   conjunctive rule.
3. A logistic regression over the rules is fitted with a lasso penalty; most rules get weight zero and go.
4. The rules that stay are compiled into one Spark column expression over the statistics' columns.

Labels, languages, sources and ids are no inputs of a score. Texts of any length are read whole. Null texts count as empty; empty texts have zero for all statistics
and are scored like others. Rows with a null id are scored, are not held out and are never learned from. If the labels that may be
learned from lack a class, every score is the share of label 1, or 0.5 without labels. Repeated rows are scored each; an empty table
gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepset.llm import words as W
from keepset.llm.labelled import sample
from keepset.llm.tokens import slices
from keepset.runtime import ship, tidy

STATS = (
    "n_words", "word_length", "longest_word", "upper", "digits", "symbols", "exclamations", "bars", "marks", "distinct", "most_common",
    "doubled", "repeated", "n_lines", "repeated_lines", "not_ascii",
)
#: Labelled rows learned from at most, trees, their depth, cut points a statistic, and the weight of the lasso penalty.
ROWS, TREES, DEPTH, CUTS, LASSO = 4000, 30, 3, 24, 0.002
_UPPER, _DIGITS, _MARKS, _HIGH = bytes(range(65, 91)), b"0123456789", b".,;:?!", bytes(range(0x80, 0x100))


def stats_of(text: bytes) -> tuple[float, ...]:
    """STATS of a text, shares but for n_words, lengths and n_lines."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATS)
    size, chars = len(text), W.word_chars(text)
    numbers = W.word_numbers(words)
    counts = np.bincount(numbers)
    lines = text.count(b"\n") + 1
    return (
        float(n), chars / n, float(max(map(len, words))), W.count_of(text, _UPPER) / size, W.count_of(text, _DIGITS) / size, W.n_symbols(text) / size,
        text.count(b"!") / size, text.count(b"|") / size, W.count_of(text, _MARKS) / size, len(counts) / n, float(counts.max()) / n,
        float((numbers[1:] == numbers[:-1]).sum()) / n, W.n_repeat_words(numbers) / n, float(lines), W.n_dup_lines(text) / lines, W.count_of(text, _HIGH) / size,
    )


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep (long or int) and STATS of each row."""
    ship(docs.sparkSession)

    def computed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                rows = np.array([stats_of(x) for x in W.texts_of(part)], dtype=np.float64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(x) for x in rows.T)], [*keep, *STATS])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, "text").mapInArrow(tidy(computed), ", ".join([f"{c} {kinds[c]}" for c in keep] + [f"{s} double" for s in STATS]))


@dataclass(frozen=True)
class Condition:
    stat: int
    above: bool  # more than the cut, or not
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.stat] > self.cut if self.above else x[:, self.stat] <= self.cut

    def column(self) -> Column:
        c = F.col(STATS[self.stat])
        return c > F.lit(self.cut) if self.above else c <= F.lit(self.cut)


Rule = frozenset  # of conditions


def _tree(x: np.ndarray, codes: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rng, rate: float, rules: Counter) -> np.ndarray:
    """Grows one tree on gradients and curvatures, notes its rules and returns its output for each row."""
    out = np.zeros(len(x))

    def grow(rows: np.ndarray, path: tuple[Condition, ...]):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-3, None, None)
        if len(path) < DEPTH and len(rows) >= 20:
            for stat in sorted(rng.choice(len(cuts), size=max(1, 2 * len(cuts) // 3), replace=False).tolist()):
                if not len(cuts[stat]):
                    continue
                bins = len(cuts[stat]) + 1
                gl = np.cumsum(np.bincount(codes[rows, stat], g[rows], bins))[:-1]
                hl = np.cumsum(np.bincount(codes[rows, stat], h[rows], bins))[:-1]
                nl = np.cumsum(np.bincount(codes[rows, stat], minlength=bins))[:-1]
                gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
                gain = np.where((nl >= 5) & (len(rows) - nl >= 5), gain, 0)
                if (k := int(np.argmax(gain))) is not None and gain[k] > best[0]:
                    best = (float(gain[k]), stat, k)
        if best[1] is None:
            out[rows] = -rate * total_g / (total_h + 1)
            return
        _, stat, k = best
        for above in (False, True):
            side = rows[(codes[rows, stat] > k) == above]
            step = (*path, Condition(stat, above, float(cuts[stat][k])))
            rules[_simple(step)] += 1
            grow(side, step)

    grow(np.arange(len(x)), ())
    return out


def _simple(path: tuple[Condition, ...]) -> Rule:
    """Of conditions on the same side of one statistic only the strictest."""
    held: dict[tuple[int, bool], float] = {}
    for c in path:
        key = (c.stat, c.above)
        held[key] = c.cut if key not in held else (max if c.above else min)(held[key], c.cut)
    return Rule(Condition(stat, above, cut) for (stat, above), cut in held.items())


def _lasso(x: np.ndarray, y: np.ndarray, weight: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights with an l1 penalty and a free intercept, by accelerated proximal gradient steps."""
    full = np.hstack([x, np.ones((len(x), 1))])
    step = 4 * len(full) / (np.linalg.norm(full, 2) ** 2)
    penalty = np.full(full.shape[1], weight)
    penalty[-1] = 0
    w = z = np.zeros(full.shape[1])
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ z, -50, 50)))
        moved = z - step * (full.T @ (p - y) / len(y))
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        faster = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, z, t = new, new + (t - 1) / faster * (new - w), faster
    return w[:-1], float(w[-1])


@dataclass
class Ensemble:
    rules: list[tuple[Rule, float]]
    intercept: float

    def score(self) -> Column:
        """A score from 0 to 1 over the columns STATS."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = None
            for c in sorted(rule, key=lambda c: (c.stat, c.above)):
                holds = c.column() if holds is None else holds & c.column()
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    share = float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.5
    start = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return Ensemble([], start)
    rng = np.random.default_rng(6)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, CUTS + 2)[1:-1])) for k in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    raw, rules = np.full(len(x), start), Counter()
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        raw = raw + _tree(x, codes, cuts, p - y, np.maximum(p * (1 - p), 1e-6), rng, 0.3, rules)
    found = sorted(rules, key=lambda r: sorted((c.stat, c.above, c.cut) for c in r))
    if not found:
        return Ensemble([], start)
    holds = np.stack([np.logical_and.reduce([c.holds(x) for c in r]) for r in found], axis=1).astype(np.float64)
    weights, intercept = _lasso(holds, y, LASSO)
    return Ensemble([(r, float(w)) for r, w in zip(found, weights) if abs(w) > 1e-6], intercept)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Ensemble:
    """Fitted on at most `rows` labelled documents that are not held out; their statistics, not their texts, reach the driver."""
    table = statistics(sample(docs, labels, "quality", rows, ~held_out()), ("doc_id", "label")).toPandas().sort_values(["doc_id", *STATS])
    return fit(table[list(STATS)].to_numpy(np.float64), table["label"].to_numpy(np.float64))


def op6_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ensemble = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", held_out().alias("held_out"), ensemble.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
