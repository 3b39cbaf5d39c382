"""The registered queries of the training-data operators, and SQL that gives the same rows where there is such SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_tree, decontam, exact_dedup, filter_audit, lang_id, ngram_join, packing, secrets, sharding, simhash, spelling, template_extract, token_counts
from .common import read

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.tiktoken"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    nodes, steps = chat_tree.build_trees(rows.unionByName(probe), tokenizer_path(BYTE_BPE))
    return chat_tree.read_back(nodes, steps).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # documents of even ids are the earlier batch, whose digests are indexed; the others are looked up in it
    found = exact_dedup.repeats_of_batches(read(spark, sf_dir, "documents"), F.coalesce(F.pmod("doc_id", F.lit(2)) == 0, F.lit(False)))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def op4_template_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_extract.extract(read(spark, sf_dir, "pages"))


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def op7_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = lang_id.fit(docs.where(~lang_id.held_out()))
    return lang_id.predict(docs, model).withColumn("held_out", lang_id.held_out()).select("doc_id", "held_out", "lang_pred", "score")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(spelling.damaged_words(read(spark, sf_dir, "documents")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.mask_counts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_chat_tree, op2_exact_dedup, op3_packing, op4_template_extract, op5_decontam, op6_token_counts, op7_lang_id, op8_simhash, op9_sharding, op10_secrets, op11_spelling, op12_filter_audit, op13_ngram_join)
}

#: Escapes add one character for each of these in a role or text.
CONTROLS = ("\\", "<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "|>")
ADDED = " + ".join(f"(length(x) - length(replace(x, '{c}', ''))) // {len(c)}" for c in CONTROLS)

#: Turns of one number and role follow the digest that the operator has of them.
TIE = "sha256(length(role) || ':' || role || text)"

#: CRC-32 in SQL: a table made from the polynomial (crc, one row with list t), and the checksum of a list of bytes as hexadecimal pairs.
CRC_TABLE = """step(i, c, k) AS (
            SELECT i::UINTEGER, i::UINTEGER, 0 FROM range(256) r(i)
            UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
        crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8)"""


def crc_of(blob: str) -> str:
    bytes_ = f"list_transform(regexp_extract_all(hex({blob}), '..'), lambda p: ('0x' || p)::UINTEGER)"
    return f"xor(list_reduce(list_prepend(4294967295::UINTEGER, {bytes_}), lambda a, v: xor(a >> 8, t[xor(a & 255, v) + 1])), 4294967295::UINTEGER)::BIGINT"


ORACLES = {
    "op1_chat_tree": f"""
        WITH said AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        sized AS (SELECT *, role || text AS both_, (SELECT {ADDED} FROM (SELECT role AS x)) + (SELECT {ADDED} FROM (SELECT text AS x)) AS added FROM said),
        told AS (
            SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, {TIE}) AS turns,
                   string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, {TIE}) AS loss,
                   sum(length(both_) + added + length('<||>') + length('<|end|>') + 2) AS formatted_chars
            FROM sized GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM told""",
    "op2_exact_dedup": """
        WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM n WINDOW g AS (PARTITION BY text_sha256)""",
    "op9_sharding": f"""
        WITH RECURSIVE {CRC_TABLE},
        raw AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
        n AS (
            SELECT doc_id, octet_length(b) + 8 AS size,
                   {crc_of("b")} AS text_crc32
            FROM raw, crc),
        summed AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM n),
        dealt AS (SELECT *, least(23, ((2 * upto - size) * 24) // (2 * total)) AS shard FROM summed)
        SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
               row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
        FROM dealt""",
    "op11_spelling": f"""
        WITH RECURSIVE {CRC_TABLE},
        said AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{spelling.UPPER}', '{spelling.LOWER}'), '{spelling.RUN}')) AS run FROM documents),
        runs AS (SELECT doc_id, run, count(*) AS n FROM said WHERE length(run) >= 6 GROUP BY ALL),
        marked AS (SELECT run, n, {crc_of("encode(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM runs, crc),
        damaged AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM marked),
        words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        cuts AS (SELECT word, n, i, left(word, i) AS before, substr(word, i + 2) AS behind, substr(word, i + 1, 1) AS letter, i = 0 OR substr(word, i, 1) != substr(word, i + 1, 1) AS first FROM words, unnest(range(length(word))) r(i)),
        gaps AS (SELECT word, n, left(word, i) AS before, substr(word, i + 1) AS behind FROM words, unnest(range(length(word) + 1)) r(i)),
        longer AS (SELECT c.word AS x, c.n AS xn, g.word AS y, g.n AS yn FROM cuts c JOIN gaps g USING (before, behind) WHERE c.first),
        near AS (
            SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b USING (before, behind) WHERE a.letter != b.letter
            UNION ALL SELECT x, y, yn FROM longer UNION ALL SELECT y, x, xn FROM longer),
        best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
        formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)),
        chain(word, here) AS (SELECT word, word FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.here WHERE f.form IS NOT NULL),
        ends AS (SELECT c.word, c.here AS root FROM chain c JOIN formed f ON f.word = c.here WHERE f.form IS NULL)
        SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)""",
    "op12_filter_audit": """
        WITH said AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        told AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        failed AS (
            SELECT doc_id, part, len(words) < 200 AS A, 100 * len(list_distinct(words)) < 50 * len(words) AS B,
                   100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS C, regexp_matches(text, '[#$%&*|]') AS D,
                   coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), min(doc_id) OVER (PARTITION BY text) IS NOT NULL) AS E
            FROM said),
        each AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, A::INT + B::INT + C::INT + D::INT + E::INT AS n_fails, [A, B, C, D, E] AS all_fails
            FROM failed LEFT JOIN told USING (doc_id)),
        masks AS (SELECT part, all_fails, n_fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM each GROUP BY ALL),
        parts AS (SELECT DISTINCT part FROM masks),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
        orders AS (
            SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
        steps AS (SELECT part, o, CAST(k AS INTEGER) AS step, substr(o, k, 1) AS letter FROM parts, orders, range(1, 6) r(k)),
        met AS (
            SELECT s.part, o, step, letter, n, good, toxic, n_fails, all_fails[ascii(letter) - 64] AS fails,
                   len(list_filter(range(1, step), lambda j: all_fails[ascii(substr(o, j, 1)) - 64])) > 0 AS gone
            FROM steps s JOIN masks m ON m.part = s.part),
        summed AS (
            SELECT part, o AS filter_order, step, letter, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS removed,
                   coalesce(sum(n) FILTER (gone AND fails), 0) AS redundant, coalesce(sum(n) FILTER (fails AND n_fails = 1), 0) AS unique_fails,
                   coalesce(sum(good) FILTER (NOT gone AND fails), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails), 0) AS toxic_lost
            FROM met GROUP BY ALL)
        SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
               good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
        FROM summed""",
    "op13_ngram_join": f"""
        WITH RECURSIVE said AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{spelling.UPPER}', '{spelling.LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        sets AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                                              ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
            FROM said),
        grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(a, b) AS (SELECT a, b FROM ends UNION SELECT r.a, l.b FROM reach r JOIN ends l ON l.a = r.b)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = doc_id), doc_id)) AS component_id FROM sets""",
}
