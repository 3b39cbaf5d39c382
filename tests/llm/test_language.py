"""What the language network learns from, and what it rejects."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import lang_id

WORDS = {"aa": ["the", "with", "this", "and", "other"], "bb": ["der", "nicht", "über", "und", "eine"]}


def sentences(k, n, seed=2):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS[k], 30)) for _ in range(n)]


def test_one_text_fills_a_label(spark):
    same = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("same text again and again in this label").alias("text"), F.lit("aa").alias("lang"))
    other = spark.createDataFrame([(i, t, "bb") for i, t in enumerate(sentences("bb", 500))], same.schema)
    model = lang_id.fit(same.unionByName(other))
    assert model.labels == ["aa", "bb"]
    labels, _, _ = lang_id.predict_texts(model, ["same text again and again in this label", *sentences("bb", 3, 5)])
    assert labels == ["aa", "bb", "bb", "bb"]
    assert lang_id.fit(same).labels == ["aa"]


def test_labels_of_few_and_empty_texts(spark):
    df = spark.createDataFrame([(1, "only one text", "aa"), (2, "", "bb"), (3, None, "cc"), (None, "der und", "dd"), (4, "no label", None)], "doc_id long, text string, lang string")
    assert lang_id.fit(df).labels == ["aa", "dd"]


def test_the_network_rejects_other_texts(spark):
    rows = [(i, t, k) for k in WORDS for i, t in enumerate(sentences(k, 200))]
    model = lang_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    clean = [t for k in WORDS for t in sentences(k, 20, 9)]
    strange = ["Съешь ещё этих мягких французских булок да выпей чаю", "快速的棕色狐狸跳过懒狗。今天天气很好", "zxqj wvkq pzxx qqjz kvwx jjxq vvkz"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(clean + strange)] + [(98, "12 34"), (99, None)], "doc_id long, text string")
    with_letter = docs.where("text RLIKE '\\\\p{L}'")
    kept = {r["doc_id"] for r in lang_id.keep_identified(docs, model).collect()}
    assert kept == set(range(len(clean)))
    assert with_letter.count() == len(clean) + len(strange)


def test_equal_texts_are_read_once():
    model = lang_id.new_model(["a", "b"], seed=3)
    texts = ["first text", "", "second, longer text " * 9, "first text", "x"]
    alone = np.concatenate([lang_id.probabilities(model, [t.encode()]) for t in texts])
    assert lang_id.probabilities(model, [t.encode() for t in texts]) == pytest.approx(alone, rel=1e-4)


def test_squash_is_smooth():
    x = np.linspace(-5, 5, 2001)
    y = lang_id.squash(x.copy())
    assert np.abs(y - np.tanh(x)).max() < 0.03 and (np.diff(y) >= -1e-12).all()
    assert np.gradient(y, x) == pytest.approx(lang_id.slope(x), abs=1e-3)
