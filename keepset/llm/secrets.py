"""Secret scans (operator 9): known forms of secrets, and runs of high entropy that no known form covers.

Known forms, each leftmost and non-overlapping: assigned values (assign), access key ids (access) and runs of hexadecimal digits
(hex). For the method, candidate strings are runs of the characters secrets are written in. A window slides over each
candidate; the Shannon entropy of its characters is kept up by adding the count of the character that comes in and taking back that
of the one that goes, and so is how many of them each class of characters holds. A candidate is a secret if some window reaches the
bound of the first class that holds all of it, and no entry of the allow-list explains the candidate. The entropy spans that touch no
known one are added. A candidate of any length is looked at whole; shorter ones than a window are none.

Null texts count as empty and, as texts without a secret, give zero counts, the digest of the empty string and no spans. Texts of any
length are scanned whole, each row on its own; repeated rows and ids are scanned each; an empty table gives an empty result. Only
doc_id and text are read, whatever else there is.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepset.llm.tokens import slices
from keepset.runtime import ship, tidy

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # whole runs, as all shorter ones fail
_NAMES = ("passw", "secret", "token", "api")

#: Characters of a window; candidates are as long at least.
WINDOW = 16
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Classes of characters and the bits a character that a window must reach; a window is of the first class that holds all of it.
#: Each bound is about what 19 of 20 random windows of the class reach; a window of 16 reaches 4 bits at most.
CLASSES = (
    ("digits", _DIGITS, 2.48),
    ("hex", _DIGITS + "abcdefABCDEF", 2.75),
    ("lower", _LOWER, 3.15),
    ("upper", _UPPER, 3.15),
    ("base32", _LOWER + _DIGITS, 3.32),
    ("base36", _UPPER + _DIGITS, 3.32),
    ("base64", _LOWER + _UPPER + _DIGITS + "+/_=-", 3.5),
)
#: Candidates that are no secrets: marks, UUIDs, and words and numbers that follow one another with few marks between them.
ALLOWED = tuple(
    re.compile(x)
    for x in (
        r"[-_=+/]*",
        r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
        r"(?:(?:[A-Z]?[a-z]+|[A-Z]{2,}|[0-9]+|(?<![A-Za-z0-9])[A-Z](?![A-Za-z0-9]))[-_/+=]{0,2})+",
    )
)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_JOINT = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
_SILENT = re.compile(r"(?i)[bcdfghjklmnpqrstvwxz]{9}")
#: Changes between letters and digits, and words of one or two letters, that a candidate may have: one in so many characters, or so few.
EACH, FEW = 8, 3


_NARROW = np.array([sum((chr(c) in chars) << k for k, (_, chars, _) in enumerate(CLASSES)) for c in range(128)], dtype=np.int64)
_NLOGN = [0.0] + [n * float(np.log2(n)) for n in range(1, WINDOW + 1)]


def entropic(candidate: str, window: int = WINDOW) -> bool:
    """Whether some window reaches the bound of the first class that holds all its characters."""
    codes = candidate.encode("ascii")
    kinds = _NARROW[np.frombuffer(codes, np.uint8)].tolist()  # bit k: the class holds the character
    counts, held = [0] * 128, [0] * len(CLASSES)
    total, whole = 0.0, _NLOGN[window]  # total: the sum of n log n over the counts
    for i, c in enumerate(codes):
        total += _NLOGN[counts[c] + 1] - _NLOGN[counts[c]]
        counts[c] += 1
        for k in range(len(CLASSES)):
            held[k] += kinds[i] >> k & 1
        if i >= window:
            gone = codes[i - window]
            total += _NLOGN[counts[gone] - 1] - _NLOGN[counts[gone]]
            counts[gone] -= 1
            for k in range(len(CLASSES)):
                held[k] -= kinds[i - window] >> k & 1
        if i >= window - 1 and (whole - total) / window >= CLASSES[held.index(window)][2] - 1e-9:
            return True
    return False


def _spoken(word: str) -> bool:
    """Whether long words have the vowels that languages need."""
    return len(word) < 10 or 5 * sum(c in "aeiouy" for c in word.lower()) >= len(word) and not _SILENT.search(word)


def allowed(candidate: str) -> bool:
    """Whether an entry of the allow-list explains the candidate: of words and numbers, most have to be whole ones."""
    if not any(x.fullmatch(candidate) for x in ALLOWED):
        return False
    words = _WORD.findall(candidate)
    odd = len(_JOINT.findall(candidate)) + sum(len(x) < 3 for x in words)
    return ALLOWED[1].fullmatch(candidate) is not None or odd <= max(FEW, len(candidate) // EACH) and all(map(_spoken, words))


def known_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the known forms, by start, then kind."""
    out = []
    lower = text.lower()
    if any(x in lower for x in _NAMES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def entropy_spans(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    starts = [a for a, _, _ in known]
    ends = list(accumulate((b for _, _, b in known), max))
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        before = bisect_left(starts, b)  # the known spans that start before this one's end
        if before and ends[before - 1] > a or allowed(m[0]) or not entropic(m[0]):
            continue
        out.append((a, 3, b))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and its spans (kind, start, end in code points), known ones and entropic ones, by start, then kind."""
    ship(docs.sparkSession)

    def scanned(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            for part in slices(batch):
                found = []
                for text in part.column("text").to_pylist():
                    known = known_spans(text or "")
                    found.append([{"kind": KINDS[k], "start": a, "stop": b} for a, k, b in sorted(known + entropy_spans(text or "", known))])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(tidy(scanned), "doc_id long, spans array<struct<kind:string,start:long,stop:long>>")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def text_of(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.stop)), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x.kind != "entropy")
    return found.select("doc_id", *(number(k) for k in KINDS), F.sha2(text_of(base), 256).alias("base_sha256"), text_of(F.col("spans")).alias("spans"))
