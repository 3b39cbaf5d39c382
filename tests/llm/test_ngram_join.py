"""The n-gram join against all pairs compared by brute force, and what it sends where documents share passages."""

import numpy as np
import pyarrow as pa
import pytest

from cohortloom.llm import ngram_join

from .test_jaccard import made_texts, ordered


def grams(text, width):
    w = (text or "").encode().lower().split()
    k = min(width, len(w))
    return {b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(texts, width, similarity):
    sets = [grams(t, width) for _, t in texts]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and similarity[1] * len(a & b) >= similarity[0] * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(texts):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(texts)]


def mixed_from_passages(count, words=30, passages=30, each=10):
    """Documents of ten passages out of thirty, in any order: all shingles are hot, and hardly two documents are similar."""
    rng = np.random.default_rng(count)
    said = [" ".join(f"p{i}x{k}" for k in range(words)) for i in range(passages)]
    return [(i, " ".join(said[k] for k in rng.permutation(passages)[:each])) for i in range(count)]


@pytest.mark.parametrize(("width", "similarity"), [(4, (85, 100)), (3, (6, 10))])
def test_groups_against_brute_force(spark, width, similarity):
    texts = made_texts() + [(5000 + i, t) for i, t in mixed_from_passages(120, 8, 8, 5)]
    docs = spark.createDataFrame([(*x, 0, 0) for x in texts], "doc_id long, text string, node int, grams int").repartition(3)
    assert ordered(ngram_join.near_groups(docs, width, similarity).collect()) == ordered(brute(texts, width, similarity))


def test_edges(spark):
    long = "one two three four " * 40_000
    texts = [(1, None), (2, ""), (3, " \t"), (4, "a"), (5, "A"), (6, "a b c"), (7, "a b c"), (7, "a b c"), (8, "É é É é"), (9, long), (10, long + "x"), (None, "a b c d"), (None, "q r s t u"), (12, "a b c d")]
    got = ngram_join.near_groups(spark.createDataFrame(texts, "doc_id long, text string"))
    assert ordered(got.collect()) == ordered(brute(texts, 4, (85, 100)))
    assert ngram_join.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shingles_are_told_apart_by_their_words():
    texts = pa.array(["a b c d e", "ab c d e", "a bc d e", "", "a b", "a  B", "b a", "a b a b a b", "x" * 100_000])
    runs, counts = ngram_join.shingle_runs(texts, 4)
    assert counts.tolist() == [2, 1, 1, 0, 1, 1, 1, 3, 1]
    assert len(set(runs.tolist())) == 9  # the fifth and sixth are equal, and so are two of the eighth's three
    assert runs[4] == runs[5] and runs[7] == runs[9]


def test_packed_hashes_come_back():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << ngram_join.BITS, 1000).astype(np.uint64))
    assert (ngram_join.unpacked(ngram_join.packed(values)) == values).all()


def test_sketches_and_sizes_drop_no_similar_pair():
    rng = np.random.default_rng(6)
    sets = []
    for size in (3, 30, 150, 600):
        base = rng.integers(0, 1 << ngram_join.BITS, size).astype(np.uint64)
        for share in (0, 0.05, 0.1, 0.12, 0.2, 0.4):
            own = base.copy()
            own[: int(share * size)] = rng.integers(0, 1 << ngram_join.BITS, int(share * size)).astype(np.uint64)
            sets.append(np.unique(own[: size - int(rng.integers(0, 2 + size // 10))]))
    n = len(sets)
    every = np.ones(n, bool)
    found = ngram_join.product_links([ngram_join.packed(x) for x in sets], np.arange(n), -1, every, every, (4, 5))
    roots = {frozenset(c) for c in closure(n, found)}
    want = [(i, j) for i in range(n) for j in range(i) if 5 * np.intersect1d(sets[i], sets[j]).size >= 4 * np.union1d(sets[i], sets[j]).size]
    assert want and roots == {frozenset(c) for c in closure(n, want)}


def closure(n, pairs):
    root = list(range(n))
    for i, j in pairs:
        old, new = root[i], root[j]
        root = [new if r == old else r for r in root]
    return [[i for i in range(n) if root[i] == r] for r in set(root)]


def test_shared_passages_send_rows_in_proportion(spark):
    """Twice the documents, all of them made of the same passages, make at most about twice the entries of lists, and no pairs."""
    sent = []
    for count in (500, 1000, 2000):
        docs = spark.createDataFrame(mixed_from_passages(count), "doc_id long, text string")
        found = ngram_join.candidates(docs, 5, (4, 5), "text", True, False)
        sent.append(ngram_join.entry_lists(found)[0].count())
    assert sent[1] <= 2.2 * sent[0] and sent[2] <= 2.2 * sent[1]
