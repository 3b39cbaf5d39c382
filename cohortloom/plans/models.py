"""Queries of model training, scoring and metrics, and of sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortloom.functions import expr as X
from cohortloom.functions.store import shared_folder
from cohortloom.operators import ml
from cohortloom.sources import tables

from .registry import query, table

c = F.col
N = lambda: F.count(F.lit(1))


def _round(df, *names, to=6):
    return df.withColumns({n: F.round(n, to) for n in names})


def _examples(spark, d):
    """Documents with their labels; features from the text, group = source."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").where("quality IS NOT NULL")
    words = F.size(F.split(F.coalesce("text", F.lit("")), " "))
    return docs.select("doc_id", "source", "quality", "toxic", F.when(c("n_chars") > 50, c("n_chars")).cast("double").alias("chars"), words.cast("double").alias("words"), X.count_letter("text", "!").cast("double").alias("marks"), X.ratio(X.count_letter("text", "$") * 1.0, words).alias("signs"))


FEATURES = ["chars", "words", "marks", "signs"]


@query()
def ml1_ml2_grouped_cross_validation(spark, d):
    return ml.cross_validate(_examples(spark, d), FEATURES, "quality", "source").select("doc_id", "fold", "score")


@query()
def ml5_score_and_rollup(spark, d):
    rows = ml.group_folds(_examples(spark, d), "source", 5)
    model = ml.fit(rows.where("fold != 0"), FEATURES, "quality")
    return ml.rollup(ml.score(rows.where("fold = 0"), model, FEATURES), ["source"], "score", 0.5)  # sources that the model has not seen


_S = "s AS (SELECT l_returnflag, l_linestatus, floor(l_extendedprice / 100) / 1100 AS score, l_quantity > 25 AS t FROM lineitem)"


def _scores(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", (F.floor(c("l_extendedprice") / 100) / 1100).alias("score"), (c("l_quantity") > 25).alias("t"))


@query(f"""WITH {_S}, k AS (SELECT l_returnflag, score, count(*) FILTER (t) AS pos, count(*) FILTER (NOT t) AS neg FROM s GROUP BY 1, 2), w AS (SELECT *, sum(pos) OVER (PARTITION BY l_returnflag ORDER BY score DESC) AS tp, sum(neg) OVER (PARTITION BY l_returnflag ORDER BY score DESC) AS fp FROM k)
    SELECT l_returnflag, CAST(sum(pos + neg) AS BIGINT) AS n, round(sum(neg * (tp - pos + pos / 2)) / (sum(pos) * sum(neg)), 6) AS auroc, round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS average_precision FROM w GROUP BY 1""")
def ml3_ranking_metrics(spark, d):
    return _round(ml.ranking_metrics(_scores(spark, d), "score", c("t"), ["l_returnflag"]), "auroc", "average_precision")


@query(f"""WITH {_S}, m AS (SELECT l_returnflag, l_linestatus, CAST(count(*) FILTER (t AND score >= 0.5) AS DOUBLE) AS a, CAST(count(*) FILTER (NOT t AND score >= 0.5) AS DOUBLE) AS b, CAST(count(*) FILTER (t AND score < 0.5) AS DOUBLE) AS c, CAST(count(*) FILTER (NOT t AND score < 0.5) AS DOUBLE) AS d FROM s GROUP BY 1, 2)
    SELECT l_returnflag, l_linestatus, CAST(a AS BIGINT) AS tp, CAST(b AS BIGINT) AS fp, CAST(c AS BIGINT) AS fn, CAST(d AS BIGINT) AS tn, round(a / (a + b), 6) AS precision, round(a / (a + c), 6) AS recall, round(2 * a / (2 * a + b + c), 6) AS f1, round((a * d - b * c) / sqrt((a + b) * (a + c) * (d + b) * (d + c)), 6) AS mcc FROM m""")
def ml3_ml6_confusion_by_group(spark, d):
    out = ml.confusion(_scores(spark, d), c("t"), c("score") >= 0.5, ["l_returnflag", "l_linestatus"])
    return _round(out, "precision", "recall", "f1", "mcc")


@query(f"""WITH {_S}, k AS (SELECT score, count(*) FILTER (t) AS pos, count(*) FILTER (NOT t) AS neg FROM s GROUP BY 1), w AS (SELECT score, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp, (SELECT sum(pos) FROM k) AS p FROM k WINDOW o AS (ORDER BY score DESC))
    SELECT round(score, 6) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM w WHERE tp / (tp + fp) >= 0.52 ORDER BY tp / p DESC, score DESC LIMIT 1""")
def ml4_threshold_for_precision(spark, d):
    return _round(ml.threshold_for(_scores(spark, d), "score", c("t"), 0.52), "threshold", "precision", "recall")


@query("""WITH f AS (SELECT l_suppkey, max(CAST(l_linestatus = 'O' AND p_name LIKE '%ring%' AS INT)) AS o1, max(CAST(l_linestatus = 'F' AND p_name LIKE '%ring%' AS INT)) AS f1, max(CAST(l_linestatus = 'O' AND p_type LIKE '%PROMO%' AS INT)) AS o2, max(CAST(l_linestatus = 'F' AND p_type LIKE '%PROMO%' AS INT)) AS f2 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
    SELECT l_suppkey, greatest(o1, f1) AS any_ring, greatest(o2, f2) AS any_promo, least(o1, f1) AS both_ring, least(o2, f2) AS both_promo FROM f""")
def ml7_annotation_features(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), c("l_partkey") == c("p_partkey")).withColumn("product", F.concat_ws(" ", "p_name", "p_type"))
    return ml.annotation_features(rows, "l_suppkey", "product", {"ring": "ring", "promo": "PROMO"}, ["O", "F"], "l_linestatus")


@query("""SELECT 'NATION_' || n_nationkey AS sample, 's3://bucket/' || lower(n_name) || '_1.fastq.gz' AS fastq_1, 's3://bucket/' || lower(n_name) || '_2.fastq.gz' AS fastq_2, 'meta' AS kind FROM nation""")
def io28_samplesheet(spark, d):
    rows = table(spark, d, "nation").withColumn("sample", F.concat(F.lit("NATION_"), c("n_nationkey").cast("string")))
    uri = "s3://bucket/{}_{}.fastq.gz"
    return tables.samplesheet(rows, "sample", F.lower("n_name"), {"fastq_1": uri.format("%s", 1), "fastq_2": uri.format("%s", 2)}, {"kind": "meta"})


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50""")
def io24_mined_fields(spark, d):
    return tables.mined(table(spark, d, "events"), "props", {"k": r'"k":\s*(\d+)'}).select("event_id", c("k").cast("long").alias("k"), "event_type").where("k > 50")


@query("""SELECT count(*) AS rows, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total, count(*) FILTER (o_orderstatus IS NULL) AS null_o_orderstatus FROM orders""")
def io27_run_summary(spark, d):
    return tables.run_summary(table(spark, d, "orders"), {"customers": F.countDistinct("o_custkey"), "total": F.round(F.sum("o_totalprice"), 2)}, ["o_orderstatus"])


@query("""SELECT s_suppkey AS supplier, CASE WHEN s_suppkey % 3 <> 0 THEN s_name END AS name, s_acctbal AS balance FROM supplier""")
def io24_log_records(spark, d):
    path = f"{shared_folder(spark).rstrip('/')}/logs-{uuid.uuid4().hex}"
    # a record of some lines for each supplier, as a tool would log it; one field is missing in a third of them
    line = F.concat_ws("\n", F.format_string("run %d starts", "s_suppkey"), F.lit("loading"), F.when(c("s_suppkey") % 3 != 0, F.concat(F.lit("label: "), c("s_name"))), F.concat(F.lit("balance="), c("s_acctbal").cast("string")), F.lit("done"))
    table(spark, d, "supplier").select(line.alias("value")).write.text(path)
    rows = tables.mined_logs(spark, path, "^run ", {"supplier": r"^run (\d+) starts", "name": "^label: (.*)", "balance": "^balance=(.*)"})
    return rows.select(c("supplier").cast("int").alias("supplier"), "name", c("balance").cast("double").alias("balance"))
