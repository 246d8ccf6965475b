"""The library's tables as views of the test data. Each view has one SQL text that either engine runs.

``{ts(x)}`` in a text stands for a timestamp of x seconds, which the engines spell differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIME = {"spark": "timestamp_seconds({0})", "duckdb": "make_timestamp(CAST({0} AS BIGINT) * 1000000)"}
LINES = {
    "spark": "SELECT doc_id, lang, source, pos, line FROM documents LATERAL VIEW posexplode(split(text, '\\n')) l AS pos, line",
    "duckdb": "SELECT doc_id, lang, source, CAST(pos AS INT) AS pos, line FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line,"
    " unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)",
}

VIEWS = {
    "corrections": (
        ["conversations"],
        """SELECT u.conv_id * 100 + u.turn AS id, CAST(u.conv_id % 5 AS INT) AS project_id, u.text AS source_text,
  CASE WHEN (u.conv_id + u.turn) % 7 = 6 THEN NULL WHEN (u.conv_id + u.turn) % 3 = 0 THEN a.text ELSE replace(replace(a.text, 'tion', 'sion'), 'er', 'ar') END AS ai_translation,
  a.text AS final_translation, CAST(u.conv_id % 4 AS INT) AS reuse_count, {ts(1704067200 + u.conv_id * 7200 + u.turn * 60)} AS created_at,
  CASE WHEN u.conv_id % 4 = 0 THEN NULL WHEN (u.conv_id + u.turn) % 3 = 0 THEN 'approved' ELSE 'corrected' END AS kind,
  u.conv_id AS page_id, concat('bubble_', u.turn) AS bubble_id
FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""",
    ),
    "bubbles": (
        ["documents"],
        """SELECT doc_id AS page_id, pos, concat('bubble_', pos + 1) AS bubble_id, line AS text, source, lang, CAST(length(source) % 2 + doc_id % 4 AS INT) AS project_id,
  CASE WHEN (doc_id + pos) % 5 = 0 THEN '' WHEN (doc_id + pos) % 3 = 0 THEN line ELSE replace(line, 'th', 't') END AS ai_translation,
  CASE WHEN (doc_id + pos) % 11 = 0 THEN '' ELSE line END AS translation,
  CASE WHEN doc_id % 2 = 0 THEN line END AS confirmed_translation, CASE WHEN doc_id % 6 = 0 THEN 'page' END AS confirmed_via,
  pos % 13 = 12 AS skip FROM ({lines}) WHERE line <> ''""",
    ),
    "logs": (
        ["events"],
        """SELECT event_id AS id, user_id AS page_id, concat('bubble_', k % 7) AS bubble_id, CAST(user_id % 5 AS INT) AS project_id,
  CASE WHEN event_type IN ('view', 'signup') THEN 'zero_shot' ELSE 'memory_injected' END AS variant, concat('line ', k) AS source_text,
  concat('out ', k % 3) AS output_text, CASE WHEN event_type NOT IN ('view', 'signup') THEN (k % 20) * 100 END AS matched_correction_id,
  value / 500 AS similarity_score, CASE WHEN event_type = 'error' THEN NULL ELSE 0.67 END AS threshold_used, event_type AS model_used,
  CASE WHEN user_id % 4 = 0 THEN NULL ELSE concat('key', user_id % 4) END AS key_label,
  CASE WHEN k % 5 = 0 THEN '[{"source_term":"Wyvern","target_term":"wywerna"}]' WHEN k % 7 = 0 THEN 'no json' ELSE '[]' END AS glossary_terms_used,
  CASE WHEN event_type = 'purchase' THEN '{"exact":"x"}' END AS hints_json, CAST(NULL AS VARCHAR(9)) AS memory_lane,
  CASE WHEN k % 3 = 0 THEN concat('{"lane":"fuzzy","memory_probe":{"lane":"fuzzy","candidates":3,"best":0.', lpad(CAST(k AS VARCHAR(9)), 2, '0'), ',"size":', k, '}}')
    WHEN k % 3 = 1 THEN concat('{"model_output":"Out ', k % 2, '"}') ELSE '{broken' END AS injection_json,
  concat(user_id, '-', CAST(ts AS DATE)) AS run_id, CAST(ts AS TIMESTAMP) AS created_at, k
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)""",
    ),
    "glossary": (
        ["benchmark"],
        """SELECT item_id AS id, CAST(item_id % 5 AS INT) AS project_id, regexp_extract(text, '([A-Za-z]{5,})', 1) AS source_term, lower(regexp_extract(text, '([A-Za-z]{6,})', 1)) AS target_term
FROM benchmark WHERE regexp_extract(text, '([A-Za-z]{5,})', 1) <> ''""",
    ),
    "key_events": (
        ["events"],
        """SELECT CAST(ts AS TIMESTAMP) AS at, CASE WHEN user_id % 2 = 0 THEN 'gemini' ELSE 'other' END AS provider, concat('key', user_id % 6) AS key_id, event_type AS model,
  CASE WHEN k % 8 = 0 THEN 'limit' WHEN k % 10 = 7 AND user_id % 3 = 0 THEN 'server_counts' ELSE 'success' END AS kind, k % 16 = 0 AS daily,
  CASE WHEN (k % 8 = 0 AND k % 3 <> 0) OR (k % 10 = 7 AND user_id % 3 = 0 AND k % 4 = 1) THEN k END AS limit_value,
  CASE WHEN k % 10 = 7 AND user_id % 3 = 0 AND k % 3 = 0 THEN k END AS left_value, event_id FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)""",
    ),
    "manual_ops": (
        ["events"],
        """SELECT user_id AS page_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'layout' WHEN 'click' THEN 'merge' WHEN 'signup' THEN 'layout' WHEN 'error' THEN 'edit_source' ELSE 'unknown_op' END AS op,
  CAST(ts AS TIMESTAMP) AS at, concat('bubble_', CAST(user_id % 3 AS INT)) AS bubble, event_type AS detail FROM events""",
    ),
    "files": (
        ["documents"],
        """SELECT source AS folder, concat('page_', doc_id, '.jpg') AS name, {ts(1704067200 + (doc_id * 7919) % 100000)} AS mtime, sha1(text) AS sha1, doc_id FROM documents""",
    ),
    "boxes": (
        ["lineitem", "part"],
        """SELECT l_orderkey AS page_id, pos, CAST(pos % 3 AS INT) AS slice_id, p_name AS text, 0.7 + l_discount * 3 AS score, x1, y1, x1 + 40 + (l_partkey % 60) AS x2, y1 + 20 AS y2
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_tax) - 1 AS INT) AS pos,
  CAST((l_partkey * 37) % 300 AS DOUBLE) AS x1, CAST((l_suppkey * 13 + l_quantity * 7) % 200 AS DOUBLE) AS y1 FROM lineitem) JOIN part ON l_partkey = p_partkey""",
    ),
    "memory_vectors": (
        ["embeddings", "documents"],
        """SELECT e.vec_id AS id, e.label AS project_id, coalesce(d.text, concat('vector ', e.vec_id)) AS source_text, concat('final ', e.vec_id % 40) AS final_translation,
  CASE WHEN e.vec_id % 3 = 0 THEN 'approved' ELSE 'corrected' END AS kind, e.embedding FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id WHERE e.vec_id % 5 <> 0""",
    ),
    "query_vectors": (
        ["embeddings", "documents"],
        """SELECT e.vec_id AS query_id, e.label AS project_id, coalesce(d.text, concat('vector ', e.vec_id)) AS text, e.embedding
FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id WHERE e.vec_id % 5 = 0""",
    ),
    "page_meta": (
        ["documents"],
        """SELECT doc_id AS page_id, CAST(doc_id % 4 AS INT) AS project_id, CASE WHEN doc_id % 17 = 0 THEN 'excluded' WHEN doc_id % 13 = 0 THEN 'pending' WHEN doc_id % 29 = 0 THEN 'failed' ELSE 'processed' END AS status, concat(source, '_', doc_id, '.png') AS file_name,
  CASE WHEN doc_id % 3 = 0 THEN {ts(1704100000 + doc_id)} END AS layout_checked_at, {ts(1704067200 + doc_id * 60)} AS updated_at,
  CASE WHEN doc_id % 5 <> 0 THEN {ts(1704067200 + doc_id * 3600)} END AS ocr_at FROM documents""",
    ),
}


def sql_of(name: str, engine: str) -> str:
    import re

    text = VIEWS[name][1].replace("{lines}", LINES[engine])
    return re.sub(r"\{ts\((.*?)\)\}", lambda m: TIME[engine].format(f"({m[1]})"), text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the tables of a folder."""
    sql = sql_of(name, "spark")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in VIEWS[name][0]}
    for t, df in tables.items():
        df.createOrReplaceTempView(t)
    out = spark.sql(sql)
    return out if name != "boxes" else out.withColumn("box", F.expr("array(array(x1, y1), array(x2, y1), array(x2, y2), array(x1, y2))"))


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the named views in front of it."""
    ctes, own = ", ".join(f"{n} AS ({sql_of(n, 'duckdb')})" for n in names), sql.lstrip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if own.upper().startswith(start):
            return f"{start}{ctes}, {own[len(start):]}"
    return f"WITH {ctes} {own}"
