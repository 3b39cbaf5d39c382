"""Spelling variants against all pairs of words compared by brute force."""

import random
import re
import zlib
from collections import Counter

from cohortloom.llm import spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    s, t = sorted((a, b), key=len)
    return len(t) == len(s) + 1 and any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def brute(counts, least_n=5, times=5):
    kept, form, rows = {w: n for w, n in counts.items() if n >= least_n}, {}, []
    for w, n in kept.items():
        around = [v for v in kept if near(v, w)]
        best = min(around, key=lambda v: (-kept[v], v), default=None)
        form[w] = best if best is not None and kept[best] >= times * n else None
        rows.append([w, form[w], w, n, len(around), kept.get(form[w])])
    for r in rows:
        while form[r[2]]:
            r[2] = form[r[2]]
    return sorted(map(tuple, rows), key=str)


def test_groups_against_brute_force(spark):
    """Few letters, so that runs of equal letters, ties and words that are near in two ways are many; words on both sides of LONG."""
    rng, counts = random.Random(3), {}
    for _ in range(600):
        counts["".join(rng.choice("abÀ") for _ in range(rng.randint(1, 6)))] = rng.choice([1, 4, 5, 6, 30, 200, 2000, 10**5])
    for k in range(spelling.LONG - 1, spelling.LONG + 3):
        base = "a" * 30 + "b" * (k - 30)
        counts |= {base: 5, base[:-1] + "c": 50, "c" + base: 500, base[:10] + base[11:]: 5000}
    got = spelling.variant_groups(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5))
    assert sorted(map(tuple, got.collect()), key=str) == brute(counts)


def test_words_of_documents(spark):
    texts = [(i, " ".join(["Straße", "straßes", "Ärger-chen", "wordings"] * 3), 0) for i in range(1500)]
    texts += [(None, "Abcdefg ABCDEFG\tabcdefg", 0), (7, None, 0), (8, "", 0), (9, "x" * 70_000, 0), (9, "x" * 70_000, 0), (9, "short 12345 ÷××÷××", 0)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, word int")
    low = str.maketrans(spelling.UPPER, spelling.LOWER)
    want = Counter()
    for i, t, _ in texts:
        for run in re.findall("[a-zÀ-ÿ]+", (t or "").translate(low)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run
            if len(word) >= 6:
                want[word] += 1
    assert len(want) > 6  # some words lost a letter
    assert {r["word"]: r["n"] for r in spelling.damaged_words(docs).collect()} == want


def test_very_long_words(spark):
    base = "ab" * 3000
    counts = {base: 5, base[:-1] + "c": 60, base[:1500] + base[1501:]: 7}
    got = spelling.variant_groups(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(counts)


def test_no_words(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variant_groups(spelling.damaged_words(docs)).count() == 0
