"""The pipeline on the smallest tables against brute force, stage by stage."""

import hashlib

import corpus_pipeline
from cohortloom.llm import decontam, lang_id
from cohortloom.llm.common import read

from .test_jaccard import brute_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, SF, "documents")
    columns, rows = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]
    stage = dict(corpus_pipeline.STAGES)

    kept = stage["language_id"](spark, docs, SF)
    assert kept.columns == columns
    want = {i: t for i, t in rows.items() if t and any(map(str.isalpha, t))}
    assert {r["doc_id"] for r in kept.collect()} == set(want)

    kept = stage["exact_dedup"](spark, kept, SF)
    assert kept.columns == columns
    by = {}
    for i, t in want.items():
        by.setdefault(hashlib.sha256(t.encode().lower()).digest(), []).append(i)
    want = {max(ids): want[max(ids)] for ids in by.values()}
    assert {r["doc_id"] for r in kept.collect()} == set(want)

    kept = stage["near_dedup"](spark, kept, SF)
    assert kept.columns == columns
    # five-word shingles and a similarity of 0.8 or more, all pairs by brute force
    want = {i: want[i] for i in {c for _, c in brute_components(list(want.items()))}}
    assert {r["doc_id"] for r in kept.collect()} == set(want)

    kept = stage["decontamination"](spark, kept, SF)
    assert kept.columns == columns
    items = [decontam.normal(r["text"]) for r in read(spark, SF, "benchmark").collect()]
    want = {i: t for i, t in want.items() if not any(x in decontam.normal(t) for x in items)}
    assert {r["doc_id"] for r in kept.collect()} == set(want)

    packed = stage["packing"](spark, kept, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(want)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and set(out.columns) >= {"doc_id", "sequence_id", "offset", "length"}


def test_language_on_held_out_documents(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    model = lang_id.fit(docs.where(~lang_id.held_out()))
    out = lang_id.predict(docs, model).join(docs.where(lang_id.held_out()).select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL")
    assert out.where("lang = lang_pred").count() / out.count() > 0.97
