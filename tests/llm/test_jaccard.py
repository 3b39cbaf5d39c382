"""The pipeline's near-duplicates against all pairs compared by brute force."""

import numpy as np
import pytest

import corpus_pipeline
from cohortloom.llm import jaccard, ngram_join
from cohortloom.llm.common import read


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_components(texts):
    sets = [shingles(t) for _, t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(texts):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, least.get(root(i))) for i, (d, _) in enumerate(texts)]


def made_texts():
    rng = np.random.default_rng(5)
    word = lambda k: [f"w{x}" for x in rng.integers(0, 400, k)]
    line = word(30)
    texts = [None, "", " \n", "one two", "One  two", "one two three"]
    for base in (word(200), word(60), line + word(25)):
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 4, 6, 8) * 3:  # similarities on both sides of 0.8
            w = list(base)
            for i in rng.integers(0, len(w), edits):
                w[i] = f"x{rng.integers(1 << 30)}"
            texts.append(" ".join(w))
        texts.append(" ".join(base[: int(len(base) * 0.85)]))
    texts += [" ".join(line + word(int(k))) for k in rng.integers(0, 40, 60)]  # one line in very many
    return [(None if i == 9 else 1000 - i, t) for i, t in enumerate(texts)]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda x: tuple((v is None, v) for v in x))


@pytest.mark.parametrize("settings", [{}, {"FEW": 1, "STARS": 1}, {"FEW": 1, "STARS": 1, "BLOCK_DOCS": 7}, {"PART": 500, "BLOCK_BYTES": 4000}])
def test_groups_against_brute_force(spark, monkeypatch, settings):
    """With one star and small blocks most links come from the blocked product."""
    for name, value in settings.items():
        monkeypatch.setattr(ngram_join, name, value)
    texts = made_texts()
    got = jaccard.near_groups(spark.createDataFrame(texts, "doc_id long, text string").repartition(3))
    want = brute_components(texts)
    assert len({c for _, c in want}) < len(texts) - 20
    assert ordered(got.collect()) == ordered(want)


def test_stage_removes_similar_documents(spark):
    """Pairs of similarity 0.8 or more whose fingerprints differ in more than 4 bits."""
    docs = read(spark, "/root/testdata/sf0.01", "documents").where("doc_id IN (1, 255, 582, 875, 643, 770, 709, 944)")
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "/root/testdata/sf0.01")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 582, 643, 709]


def test_one_id_with_two_texts_of_one_set(spark):
    """Of texts that differ in white space alone, under one id, one stays; a row that repeats it stays with it."""
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a  b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (3, None), (4, ""), (5, "other words")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0) for r in jaccard.dedup(docs).collect()) == [0, 1, 3, 5]


def test_no_documents(spark):
    assert jaccard.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
