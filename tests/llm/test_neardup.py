"""Near-duplicates of the pipeline against the Jaccard similarity of all pairs."""

import random

import pyarrow as pa
import pytest

from keepset.llm import neardup, simhash


def _shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def _components(texts):
    sets, of = [_shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                low, high = sorted((of[i], of[j]))
                of = [low if x == high else x for x in of]
    return dict(enumerate(of))


def _texts():
    rng = random.Random(7)
    out = [None, "", " \n", "one two", "One  two", "one two three", "voilà\u2028 Å … " + "中文字符" * 40, "voil Å … à"]
    shared = " ".join(f"s{k}" for k in range(20))
    for base in range(12):
        words = [f"b{base}x{rng.randrange(300)}" for _ in range(rng.choice((7, 30, 120, 400)))]
        for _ in range(12):
            own = list(words)
            for _ in range(rng.randrange(1 + len(words) // 25)):
                own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
            out.append(" ".join(own[: len(own) - rng.randrange(1 + len(own) // 12)]) + (f" {shared}" if base % 2 else ""))
    return out


@pytest.mark.parametrize(("group", "often"), [(4096, 32), (8, 8), (8, 1), (4096, 10**6)])
def test_no_pair_is_lost(spark, scratch, group, often):
    """Also with groups dealt to cells, and whatever keys come last."""
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, scratch, group, often).collect()}
    assert got == _components(texts)


def test_stage_takes_similarity_not_bits(spark, scratch):
    """Two words in sixty changed: Jaccard over 0.8, fingerprints more than 3 bits apart."""
    text = " ".join(f"w{k}" for k in range(60))
    other = text.replace("w0 ", "new ").replace(" w59", " last")
    assert (simhash.fingerprint(text.encode()) ^ simhash.fingerprint(other.encode())).bit_count() > 3
    docs = spark.createDataFrame([(1, text), (2, other)], "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.keep_one(docs, scratch).collect()] == [1]


def test_stage_links_close_pairs_over_the_pivots(spark, scratch, monkeypatch):
    """One word in four thousand changed: fingerprints of five words are close, and the pivots alone bring them together."""
    text = " ".join(f"w{k}" for k in range(4000))
    texts = [text, text.replace("w200 ", "new "), " ".join(f"v{k}" for k in range(4000))]
    prints = [simhash.majority(x) for x in neardup.shingles(pa.array(texts))]
    assert (prints[0] ^ prints[1]).bit_count() <= simhash.CLOSE < (prints[0] ^ prints[2]).bit_count()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nothing = spark.createDataFrame([], "a long, b long")
    with monkeypatch.context() as patch:
        patch.setattr(neardup, "_candidates", lambda *_: nothing)
        assert sorted(r["doc_id"] for r in simhash.keep_one(docs, scratch).collect()) == [0, 2]
    with monkeypatch.context() as patch:  # the keys leave these pairs to the pivots
        patch.setattr(simhash, "pairs", lambda *_: nothing)
        assert sorted(r["doc_id"] for r in simhash.keep_one(docs, scratch).collect()) == [0, 1, 2]


@pytest.mark.parametrize("limit", [0, 7])
def test_no_pair_is_lost_whatever_the_limit(spark, scratch, limit):
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, scratch, 16, 8, limit).collect()}
    assert got == _components(texts)


@pytest.mark.parametrize(("limit", "group"), [(3, 4096), (7, 4096), (7, 16)])
def test_pairs_over_the_pivots(spark, limit, group):
    """Against all pairs, with equal fingerprints, in one group and dealt to cells."""
    rng = random.Random(3)
    prints = []
    for _ in range(12):
        base = rng.getrandbits(64)
        prints += [base ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(9))) for _ in range(10)] + [base] * 2
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    want = {(i, j) for j in range(len(prints)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= limit}
    nodes = spark.createDataFrame([(i, x, i % 4) for i, x in enumerate(signed)], "node long, fingerprint long, label long")
    got = [tuple(r) for r in simhash.pairs(nodes, limit, group).collect()]
    assert sorted(got) == sorted((a, b) for a, b in want if a % 4 != b % 4)
    got = {tuple(r) for r in simhash.pairs(nodes.drop("label"), limit, group).collect()}
    assert got <= want and {x for p in got for x in p} == {x for p in want for x in p}
