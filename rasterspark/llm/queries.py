"""The queries op1 to op13 over the driver's tables, with DuckDB SQL where SQL can express them.

Each applies its operator with production parameters to the whole table and derives the columns of
its contract from the operator's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterspark.llm import bpe, ctw, decontaminate, filter_audit, langid, licenses, packing, repair, simhash, substring_dedup, suffix_dedup, topk, warc
from rasterspark.llm.common import table


def _remainder(n: int, value: int):
    """Whether crc32 of doc_id as text leaves that remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == value, F.lit(False))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derive(warc.responses_of_pages(table(spark, sf_dir, "pages")))
    return made.select(
        "record_id", "warc_type", "refers_to", "target_uri", "date", "content_type", "source_digest", "payload_digest", "block_digest",
        F.array_join(F.transform("source_headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "; ").alias("source_headers"),
        F.decode("block", "UTF-8").alias("block"),
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4_licenses that SQL can express."""
    return op4_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", _remainder(4, 2))
    model = langid.fit(docs.filter(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), special=True)


def conversation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction data under three limits that differ: tokens, segments and the tokens of the answers."""
    import public_tokenizers

    return packing.pack_conversations(table(spark, sf_dir, "conversations"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", _remainder(5, 1).alias("held_out"))
    return ctw.score(docs, docs.filter(~F.col("held_out") & F.col("doc_id").isNotNull()))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audit(table(spark, sf_dir, "conversations"), damage=True)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_suffix_dedup, op3_warc, op4_licenses, license_base, op5_decontaminate, op6_langid, op7_substring_dedup, op8_topk, op9_packing, conversation_packing, op10_ctw, op11_bpe, op12_filter_audit, op13_repair)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NAMES = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

SQL = {
    "license_base": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_NAMES}) AS w FROM documents),
p AS (SELECT * FROM (VALUES ('mit', ['mit', 'license']), ('apache', ['apache', 'license']), ('gpl', ['general', 'public', 'license'])) AS t(label, p)),
hit AS (SELECT doc_id, label, i - 1 AS i FROM d, p, unnest(generate_series(1, len(w) - len(p) + 1)) AS t(i) WHERE w[i] = p[1] AND w[i:i + len(p) - 1] = p),
s AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(labels, '') AS base_labels
FROM d LEFT JOIN s ON d.doc_id = s.doc_id""",
    "op5_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_NAMES}) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, {_NAMES}) AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
       FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM d, (SELECT DISTINCT n FROM bw) AS s, unnest(generate_series(1, len(w) - n + 1)) AS t(i)),
hit AS (SELECT DISTINCT doc_id, item, i, dw.n AS n FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
marked AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, unnest(generate_series(0, n - 1)) AS t(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked ON d.doc_id = marked.doc_id LEFT JOIN items ON d.doc_id = items.doc_id""",
    "op7_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS nth
        FROM d, unnest(generate_series(1, len(w) - 19)) AS t(i)),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM win, unnest(generate_series(0, 19)) AS t(k) WHERE nth > 1),
word AS (SELECT doc_id, p, w[p] AS x FROM d, unnest(generate_series(1, len(w))) AS t(p)),
kept AS (SELECT word.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY word.p) AS text FROM word
         LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p WHERE gone.p IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op12_filter_audit": r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
low AS (SELECT text, min(doc_id) AS least FROM t GROUP BY text),
w AS (SELECT t.*, least, regexp_extract_all(t.text, '[^\x20\x09-\x0D]+') AS words FROM t JOIN low ON t.text = low.text),
m AS (SELECT doc_id, part, CAST(len(words) < 200 AS INT) AS a, CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT) AS b,
             CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS INT) AS c,
             CAST(regexp_matches(text, '[#$%&*|]') AS INT) AS d, CAST(coalesce(doc_id > least, false) AS INT) AS e FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
v AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
      FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(name, bit)),
o AS (SELECT p.name || q.name || r.name || s.name || t.name AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits FROM f p, f q, f r, f s, f t
      WHERE p.bit | q.bit | r.bit | s.bit | t.bit = 31),
x AS (SELECT filter_order, step, bits[step] AS bit, CAST(list_sum(bits[1:step - 1]) AS INT) AS before FROM o, range(1, 6) AS r(step)),
s AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (bit | coalesce(before, 0)) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0) = 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0) > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0) = 0 THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0) = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM v, x GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM s""",
    "op8_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
      FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10""",
}
