"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_counts

    return line_counts(read_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import ADDED, PATTERNS, find_pii, spelled

    found = find_pii(read_table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(spelled(list(PATTERNS)), 256).alias("base_sha256"), spelled([*PATTERNS, *ADDED]).alias("spans"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import as_events, format_chats, read_back, read_spans

    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = format_chats(as_events(rows))
    out = out.withColumn("turns", read_back(F.col("formatted"))).withColumn("said", F.array_join(read_spans(F.col("formatted"), F.col("loss")), ""))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length("said").cast("long").alias("loss_chars"),
        F.sha2("said", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(role) + length(text) + 14
    + length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', ''))
    + length(role) - length(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), ':', '')) AS n
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bi AS (
  SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0
), pat AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS p FROM bi
), sizes AS (SELECT DISTINCT k FROM pat),
dw AS (
  SELECT doc_id, s.k, w, unnest(range(1, len(w) - s.k + 2)) AS i FROM d, sizes s WHERE len(w) >= s.k
), hit AS (
  SELECT dw.doc_id, dw.i, dw.k, pat.item_id FROM dw JOIN pat ON pat.k = dw.k AND pat.p = array_to_string(dw.w[dw.i : dw.i + dw.k - 1], ' ')
), covered AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_documents, train

    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select("doc_id", "held_out", "score", "predicted")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"), near=True)


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import fingerprint_documents

    return fingerprint_documents(read_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup_substrings

    return dedup_substrings(read_table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13
), win AS (
  SELECT doc_id, i, sha256(array_to_string(w[i : i + 12], ' ')) AS p FROM s
), firsts AS (
  SELECT p, min(doc_id) AS low FROM win GROUP BY p
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM win JOIN firsts USING (p) WHERE low < doc_id
), g AS (
  SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN js IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(js, k)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocked keys are those of the corpus that no page reaches by https."""
    from .url_filter import filter_urls, url_host, url_key, url_path

    pages = read_table(spark, sf_dir, "pages")
    secure = F.coalesce(F.col("url").startswith("https://"), F.lit(False))
    keys = pages.select(url_key(url_host(F.col("url")), url_path(F.col("url"))).alias("key"), secure.alias("secure"))
    listed = keys.groupBy("key").agg(F.bool_or("secure").alias("secure")).filter("not secure")
    return filter_urls(pages, listed)


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), listed AS (
  SELECT host || path AS k FROM p GROUP BY 1 HAVING NOT bool_or(coalesce(starts_with(url, 'https://'), false))
), r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN host || path IN (SELECT k FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align_tokens

    return align_tokens(read_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import collapse

    return collapse(read_table(spark, sf_dir, "documents"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_files

    return token_files(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_pii": op2_pii,
    "op3_chat_format": op3_chat_format,
    "op4_decontaminate": op4_decontaminate,
    "op5_quality": op5_quality,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_minhash_dedup": op10_minhash_dedup,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_files": op13_token_files,
}
ORACLE = {"op4_decontaminate": OP4_SQL, "op3_chat_format": OP3_SQL, "op8_substring_dedup": OP8_SQL, "op9_url_filter": OP9_SQL}
