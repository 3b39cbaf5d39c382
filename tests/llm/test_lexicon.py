"""Words of the corpus in the guess cost."""

import re
from collections import Counter

from cohortloom.llm import secrets

TEXTS = ["Zephyr zephyr quarrel, zephyr! ab a1b2", "quarrel quarrel the\nÉcole école", None, "", "zephyr_quarrel x" * 2000, "averylongwordthatisnotcounted " * 9]


def test_frequent_words_against_a_counter(spark):
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(TEXTS)], "doc_id long, text string, word string").repartition(3)
    counts = Counter(w for t in TEXTS for w in re.findall(r"[^\W\d_]+", (t or "").lower()) if 3 <= len(w) <= 16)
    want = sorted(counts, key=lambda w: (-counts[w], w))
    assert secrets.frequent_words(docs) == want
    assert secrets.frequent_words(docs, 2) == want[:2]
    assert secrets.frequent_words(docs.limit(0)) == []


def test_words_of_the_corpus_cost_less(spark):
    known = secrets.Lexicon([*secrets.WORDS, "zephyr", "quarrel"])
    assert secrets.guess_bits("zephyrquarrel", known) < 30 < 50 < secrets.guess_bits("zephyrquarrel")
    texts = ["zephyr quarrel " * 50, "my password: zephyrquarrel", "my password: xK9vQ2mZ7pLw4R"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_assign"], r["n_guess"]) for r in secrets.scan_secrets(docs).collect()}
    assert got == {0: (0, 0), 1: (1, 0), 2: (1, 1)}
    assert {r["doc_id"]: r["n_guess"] for r in secrets.scan_secrets(docs, learned=0).collect()} == {0: 0, 1: 1, 2: 1}
