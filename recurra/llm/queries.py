"""Registered queries of the training-data operators: each operator over its whole table, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recurra.llm import chat, decontam, divergence, packing, phrases, quality, secrets, simhash, substring, suffix_dedup, token_counts, topk, url_filter
from recurra.llm.common import own_ids, table, with_given_ids


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn(
        "similarity", F.round("similarity", 6))


def document_edits(docs: DataFrame) -> DataFrame:
    """Three edits per document, derived from its row: a word in the middle is replaced by the language, a tenth is
    cut out at one third, the source is appended."""
    n = F.length(F.coalesce("text", F.lit("")))
    third = F.floor(n / 3)
    return docs.select("doc_id", F.inline(F.array(
        F.struct(F.lit(1).alias("seq"), F.floor(n / 2).alias("start"), F.lit(5).cast("long").alias("removed"), F.concat(F.lit(" "), F.coalesce("lang", F.lit("")), F.lit(" ")).alias("inserted")),
        F.struct(F.lit(2).alias("seq"), third.alias("start"), F.floor(n / 10).alias("removed"), F.lit("").alias("inserted")),
        F.struct(F.lit(3).alias("seq"), (n + 100).alias("start"), F.lit(0).cast("long").alias("removed"), F.concat(F.lit("\n"), F.coalesce("source", F.lit(""))).alias("inserted")))))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, given = own_ids(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    after = with_given_ids(token_counts.apply_edits(token_counts.trees(docs), document_edits(docs)), given)
    return after.select("doc_id", "n_before", F.get("tree", F.lit(1)).alias("n_tokens"), F.size("leaf_chars").alias("n_leaves"),
                        F.length("text").cast("long").alias("n_chars"), "n_edits", "encoded_chars")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.format_conversations(chat.events_of(rows)))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), marks).withColumn("purity", F.round("purity", 6))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, k=5)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def span_texts(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op13_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", *(count(k) for k in ("assign", "access", "hex")),
                        F.sha2(span_texts(base).cast("binary"), 256).alias("base_sha256"), span_texts(F.col("spans")).alias("spans"), count("novel"))


QUERIES = {f.__name__: f for f in (
    op1_suffix_array_dedup, op2_quality_classifier, op3_benchmark_decontamination, op4_token_counts, op5_chat_formatting,
    op6_simhash_near_dedup, op7_substring_dedup, op8_best_fit_packing, op9_url_filters, op10_exact_top_k,
    op11_phrase_collocations, op12_source_divergence, op13_secret_scans)}

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE: dict[str, str] = {}

ORACLE["op11_phrase_collocations"] = f"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {LETTERS}), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
words AS (SELECT lang, w, count(*) AS f FROM (SELECT lang, unnest(ws) AS w FROM pieces) GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM words GROUP BY lang),
two AS (SELECT lang, g[1] AS w1, g[2] AS w2, count(*) AS a FROM (
    SELECT lang, unnest([ws[i:i + 1] FOR i IN range(1, len(ws))]) AS g FROM pieces) GROUP BY ALL HAVING count(*) >= 10),
three AS (SELECT lang, g[1] AS w1, g[2] AS w2, g[3] AS w3, count(*) AS a FROM (
    SELECT lang, unnest([ws[i:i + 2] FOR i IN range(1, len(ws) - 1)]) AS g FROM pieces) GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.a, 1 AS k, x.f AS l, y.f AS r FROM two t
    JOIN words x ON x.lang = t.lang AND x.w = t.w1 JOIN words y ON y.lang = t.lang AND y.w = t.w2
    WHERE NOT EXISTS (SELECT 1 FROM three o WHERE o.lang = t.lang AND 100 * o.a >= 50 * t.a AND o.w1 = t.w1 AND o.w2 = t.w2)
      AND NOT EXISTS (SELECT 1 FROM three o WHERE o.lang = t.lang AND 100 * o.a >= 50 * t.a AND o.w2 = t.w1 AND o.w3 = t.w2)
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.a, 1, x.f, y.a FROM three t
    JOIN words x ON x.lang = t.lang AND x.w = t.w1 JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.a, 2, x.a, y.f FROM three t
    JOIN two x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN words y ON y.lang = t.lang AND y.w = t.w3),
scored AS (SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "C") AS rank FROM best)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""

ORACLE["op12_source_divergence"] = f"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS found FROM documents),
words AS (SELECT d, lang, source, translate(unnest(found), {LETTERS}) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 30),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (
  SELECT lang, source, coalesce(v, 0)::HUGEINT AS v, coalesce((SELECT sum(n) FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN v USING (lang)),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v) AS p
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * any_value(v)) AS q
  FROM counts JOIN v USING (lang) GROUP BY lang, term),
pairs AS (
  SELECT x.lang, x.source, y.source AS item, coalesce((SELECT sum(abs(a.p - b.p)) FROM shares a JOIN shares b USING (lang, term)
    WHERE a.lang = x.lang AND a.source = x.source AND b.source = y.source), 0) AS value
  FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source),
marks AS (SELECT lang, source, term AS item, p - q AS value FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value,
  (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item COLLATE "C"))::INTEGER AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value::BIGINT,
  (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item COLLATE "C"))::INTEGER AS rank FROM marks QUALIFY rank <= 50"""

ORACLE["op10_exact_top_k"] = """
WITH v AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT id, min(v) AS v FROM v WHERE id % 50 = 0 GROUP BY id),
pairs AS (
  SELECT q.id AS query_id, v.id AS vec_id, list_sum(list_transform(list_zip(q.v, v.v), lambda z: z[1] * z[2])) AS score
  FROM q JOIN v ON v.id <> q.id AND len(v.v) = len(q.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, score::BIGINT AS score FROM ranked WHERE rank <= 5"""

ORACLE["op1_suffix_array_dedup"] = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (SELECT doc_id, unnest(range(len(h) // 2)) AS i, h FROM docs),
starts AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS b, CASE WHEN 2 * i + 200 <= len(h) THEN md5(substr(h, 2 * i + 1, 200)) END AS w FROM bytes),
later AS (SELECT doc_id, i, b, w IS NOT NULL AND row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1 AS again FROM starts),
gone AS (SELECT doc_id, i, b, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS g FROM later),
runs AS (SELECT *, g AND NOT coalesce(lag(g) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM gone)
SELECT d.doc_id, count(r.i) AS n_bytes, count(*) FILTER (WHERE r.g) AS n_removed, count(*) FILTER (WHERE r.begins) AS n_spans,
       sha256(unhex(coalesce(string_agg(r.b, '' ORDER BY r.i) FILTER (WHERE NOT r.g), ''))) AS kept_sha256
FROM docs d LEFT JOIN runs r USING (doc_id) GROUP BY d.doc_id"""

ORACLE["op7_substring_dedup"] = """
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, ws FROM docs),
starts AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 12 <= len(ws) THEN md5(array_to_string(ws[i:i + 12], ' ')) END AS w FROM words),
later AS (SELECT doc_id, i, word, w IS NOT NULL AND min(doc_id) OVER (PARTITION BY w) < doc_id AS again FROM starts),
gone AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS g FROM later)
SELECT d.doc_id, count(g.i) AS n_words, count(*) FILTER (WHERE g.g) AS n_removed,
       sha256(coalesce(string_agg(g.word, ' ' ORDER BY g.i) FILTER (WHERE NOT g.g), '')) AS kept_sha256
FROM docs d LEFT JOIN gone g USING (doc_id) GROUP BY d.doc_id"""

ORACLE["op5_chat_formatting"] = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(13 + length(regexp_replace(role, '([\\\\#<' || chr(10) || '])', '..', 'g')) + length(regexp_replace(text, '[\\\\#<]', '..', 'g')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""
