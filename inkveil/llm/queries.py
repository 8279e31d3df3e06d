"""The registered queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm import chat, decontaminate, exact_dedup, langid, licenses, ngram_join, packing, quality, token_counts, token_index
from inkveil.llm.shared import crc_of_id, documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    store = token_index.write_store(docs)
    return token_index.records(store, docs.select("doc_id").distinct(), digests=True)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir), crc_of_id(F.col("doc_id")) % 4 != 2)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.report(decontaminate.contamination(documents(spark, sf_dir), items))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_groups(documents(spark, sf_dir))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(documents(spark, sf_dir))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score_quality(documents(spark, sf_dir), labels, crc_of_id(F.col("doc_id")) % 3 != 1)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hostile = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_chats(rows.unionByName(extra)))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir)).drop("rid")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir), "doc_id", licenses.path_of_documents(spark))


def queries() -> dict[str, Query]:
    found = [
        op1_token_index,
        op2_language_id,
        op3_benchmark_decontamination,
        op4_token_counts,
        op5_ngram_jaccard_join,
        op6_best_fit_packing,
        op7_quality_classifier,
        op8_chat_formatting,
        op9_exact_dedup,
        op10_license_scan,
    ]
    return {f.__name__: f for f in found}


OP9_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""



#: Windows as space-joined words; every start at which one occurs marks its words.
OP3_SQL = """
WITH RECURSIVE az AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, az),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, az),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT k FROM win),
run AS (
  SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, sizes WHERE len(w) >= k)
),
occ AS (SELECT DISTINCT r.doc_id, r.i, r.k, win.item_id FROM run r JOIN win ON r.g = win.g AND r.k = win.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM occ) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS joined
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

#: Links by shared shingles, and what each document reaches.
OP5_SQL = r"""
WITH RECURSIVE az AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x20\x09-\x0D]+') AS w FROM documents, az),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n, string_agg(g, chr(10) ORDER BY g) AS k FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
near AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(s, t) AS (SELECT doc_id, doc_id FROM d UNION SELECT s, near.b FROM reach JOIN near ON t = near.a),
m AS (SELECT s, min(t) AS component_id FROM reach GROUP BY s)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, coalesce(min(n.doc_id) OVER (PARTITION BY k), d.doc_id) AS class_id
FROM d JOIN m ON s = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

#: A turn needs escapes if its raw text does not read back.
OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
),
f AS (
  SELECT *, CASE WHEN contains(text, '###') OR contains(text, '</turn>') OR contains(text, '\\') OR contains(text, '\:') OR ends_with(text, '\')
                 THEN replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') ELSE text END AS body
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ' || role || ': ' || body || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_benchmark_decontamination": OP3_SQL, "op5_ngram_jaccard_join": OP5_SQL, "op8_chat_formatting": OP8_SQL, "op9_exact_dedup": OP9_SQL, "op10_license_scan": licenses.oracle_sql()}
