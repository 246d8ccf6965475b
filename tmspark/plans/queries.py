"""The registered queries of the library's own operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tmspark.functions import geometry as geo
from tmspark.functions import helpers, splitting, text
from tmspark.operators import catalog, glossary, logs, memory, ocr, progress, repair, replay
from tmspark.plans.views import view, with_views
from tmspark.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: SQL of the phrase key, of words, and of "reviewed", for use in the texts below.
KEY = r"trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"
CONTENT = "list_distinct(list_filter(string_split({0}, ' '), lambda x: length(x) > 1 AND x NOT IN (" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ")))"
WORDS = r"len(list_filter(regexp_split_to_array(coalesce({0}, ''), '\s+'), lambda w: w <> ''))"
WHOLE = r"regexp_replace({0}, '(^|[^\p{{L}}\p{{N}}_]){1}($|[^\p{{L}}\p{{N}}_])', '\1{2}\2', 'g')"
SEEN = "(trim(translation) <> '' AND (trim(translation) <> trim(coalesce(ai_translation, '')) OR coalesce(confirmed_translation = translation, false)))"


def query(sql: str | None = None, *views: str):
    """Registers a query under its function's name, with its SQL over the named views (or over none)."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = with_views(sql, *views) if views else sql
        return function

    return add


def secs(c) -> Column:
    return F.unix_seconds(c)


# --- memory


@query(
    """WITH ranked AS (SELECT q.query_id, m.id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(m.embedding AS DOUBLE[])) AS sim, m.final_translation, m.kind
  FROM query_vectors q JOIN memory_vectors m ON q.project_id = m.project_id),
s AS (SELECT *, sim + CASE WHEN kind = 'corrected' THEN 0.02 ELSE 0 END AS score FROM ranked WHERE sim >= 0.25),
once AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, lower(trim(final_translation)) ORDER BY score DESC, id) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id AS correction_id, final_translation FROM once
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 3""",
    "query_vectors", "memory_vectors",
)
def tm_retrieve(spark, d):
    """No lexical gate; tm_fuzzy has it."""
    m = view(spark, d, "memory_vectors").withColumn("first_id", F.col("id"))
    found = memory.block_examples(view(spark, d, "query_vectors"), m, 0.25, 3)
    entries = m.select(F.col("id").alias("correction_id"), "first_id", "final_translation")
    return memory.top_examples(found.join(entries, "correction_id"), 3).select("query_id", "rank", "correction_id", "final_translation")


@query(
    f"""WITH q AS (SELECT *, {CONTENT.format(KEY.format('text'))} AS cw FROM query_vectors WHERE {WORDS.format('text')} > 2),
m AS (SELECT *, CASE WHEN {KEY.format('source_text')} = '' THEN source_text ELSE {KEY.format('source_text')} END AS k, {CONTENT.format(KEY.format('source_text'))} AS cw FROM memory_vectors WHERE {WORDS.format('source_text')} > 2),
held AS (SELECT *, min(id) OVER (PARTITION BY project_id, k) AS first_id FROM m QUALIFY row_number() OVER (PARTITION BY project_id, k ORDER BY id DESC) = 1),
p AS (SELECT q.query_id, held.id, held.first_id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(held.embedding AS DOUBLE[])) AS sim, final_translation, kind, q.cw AS a, held.cw AS b FROM q JOIN held ON q.project_id = held.project_id),
s AS (SELECT *, sim + CASE WHEN kind = 'corrected' THEN 0.02 ELSE 0 END AS score, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE 100.0 * len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS overlap FROM p WHERE sim >= 0.25),
g AS (SELECT * FROM s WHERE sim >= 0.35 OR overlap >= 2),
once AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY query_id, lower(trim(final_translation)) ORDER BY score DESC, first_id) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_id) AS rank, id AS correction_id, round(overlap, 6) AS overlap FROM once QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_id) <= 3""",
    "query_vectors", "memory_vectors",
)
def tm_fuzzy(spark, d):
    """J4 with both gates."""
    found = memory.tm_fuzzy(view(spark, d, "query_vectors"), view(spark, d, "memory_vectors"), threshold=0.25, lexical_min=2, strong=0.35)
    return found.select("query_id", "rank", "correction_id", F.round("overlap", 6).alias("overlap"))


@query(
    f"""WITH q AS (SELECT * REPLACE (CASE WHEN query_id % 10 = 0 THEN 'Word' || (query_id % 4) || '!' ELSE text END AS text) FROM query_vectors),
a AS (SELECT * REPLACE (CASE WHEN id % 7 = 0 THEN 'word' || (id % 3) ELSE source_text END AS source_text) FROM memory_vectors),
m AS (SELECT *, CASE WHEN {KEY.format('source_text')} = '' THEN source_text ELSE {KEY.format('source_text')} END AS k, {CONTENT.format(KEY.format('source_text'))} AS cw FROM a WHERE {WORDS.format('source_text')} > 2),
held AS (SELECT *, min(id) OVER (PARTITION BY project_id, k) AS first_id FROM m QUALIFY row_number() OVER (PARTITION BY project_id, k ORDER BY id DESC) = 1),
p AS (SELECT query_id, held.id, first_id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(held.embedding AS DOUBLE[])) AS sim, {CONTENT.format(KEY.format('text'))} AS w, cw, count(held.id) OVER (PARTITION BY query_id) AS n FROM q LEFT JOIN held ON q.project_id = held.project_id WHERE {WORDS.format('text')} > 2),
t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC NULLS LAST, first_id) = 1)
SELECT query_id, 'fuzzy' AS lane, n AS candidates, round(sim, 6) AS best, round(CASE WHEN id IS NULL THEN NULL WHEN len(w) = 0 OR len(cw) = 0 THEN 0.0 ELSE 100.0 * len(list_intersect(w, cw)) / len(list_distinct(list_concat(w, cw))) END, 6) AS best_overlap FROM t
UNION ALL SELECT query_id, 'exact', (SELECT count(*) FROM a WHERE a.project_id = q.project_id), CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.project_id = q.project_id AND {KEY.format('a.source_text')} = {KEY.format('q.text')} AND {KEY.format('q.text')} <> '') THEN 1.0 END, NULL FROM q WHERE {WORDS.format('text')} <= 2""",
    "query_vectors", "memory_vectors",
)
def tm_probe(spark, d):
    """J4's probe columns, with some short lines on both sides."""
    q = view(spark, d, "query_vectors").withColumn("text", F.when(F.col("query_id") % 10 == 0, F.concat(F.lit("Word"), F.col("query_id") % 4, F.lit("!"))).otherwise(F.col("text")))
    m = view(spark, d, "memory_vectors").withColumn("source_text", F.when(F.col("id") % 7 == 0, F.concat(F.lit("word"), F.col("id") % 3)).otherwise(F.col("source_text")))
    return memory.tm_probe(q, m).withColumns({"best": F.round("best", 6), "best_overlap": F.round("best_overlap", 6)})


@query(
    f"""WITH b AS (SELECT *, pos + page_id * 100000 AS id, CASE WHEN {KEY.format('text')} = '' THEN text ELSE {KEY.format('text')} END AS k FROM bubbles WHERE {WORDS.format('text')} <= 2)
SELECT project_id, k AS phrase_key, max(id) AS id, min(id) AS first_id FROM b GROUP BY ALL""",
    "bubbles",
)
def latest_short_lines(spark, d):
    """J5 over short lines."""
    b = view(spark, d, "bubbles").where(text.is_short_phrase(F.col("text")))
    return memory.latest_per_source(b.select("project_id", F.col("text").alias("source_text"), (F.col("pos") + F.col("page_id") * 100000).alias("id"))).select("project_id", "phrase_key", "id", "first_id")


@query(
    f"""WITH b AS (SELECT *, pos + page_id * 100000 AS id, {KEY.format('text')} AS k FROM bubbles WHERE {WORDS.format('text')} <= 2), m AS (SELECT project_id, k, max(id) AS correction_id FROM b WHERE k <> '' GROUP BY ALL)
SELECT b.id AS query_id, b.project_id, m.correction_id, CAST(1.0 AS DOUBLE) AS similarity FROM b JOIN m USING (project_id, k)""",
    "bubbles",
)
def tm_exact(spark, d):
    """Every line asks, and all lines are the memory."""
    b = view(spark, d, "bubbles").withColumn("id", F.col("pos") + F.col("page_id") * 100000)
    m = b.select("id", "project_id", F.col("text").alias("source_text"), F.col("translation").alias("final_translation"))
    return memory.tm_exact(b.select(F.col("id").alias("query_id"), "project_id", "text"), m.where(text.is_short_phrase(F.col("source_text")))).drop("final_translation")


@query(
    f"""WITH r AS (SELECT id, final_translation AS before, {WHOLE.format(WHOLE.format(WHOLE.format(WHOLE.format(WHOLE.format(WHOLE.format('final_translation', 'the', 'ten'), 'the', 'ten'), 'The', 'Ten'), 'The', 'Ten'), 'THE', 'TEN'), 'THE', 'TEN')} AS after FROM corrections)
SELECT id, after FROM r WHERE before <> after""",
    "corrections",
)
def replace_words(spark, d):
    """Whole words, in the case of what they replace."""
    return memory.replace_in_memory(view(spark, d, "corrections"), "the", "ten").select("id", "after")


@query(
    """WITH r AS (SELECT id, final_translation AS before, regexp_replace(regexp_replace(regexp_replace(final_translation, '(^|[^\\p{L}\\p{N}_])th', '\\1dr', 'g'), '(^|[^\\p{L}\\p{N}_])Th', '\\1Dr', 'g'), '(^|[^\\p{L}\\p{N}_])TH', '\\1DR', 'g') AS after FROM corrections)
SELECT id, before, after FROM r WHERE before <> after""".replace("\\\\", "\\"),
    "corrections",
)
def replace_in_memory(spark, d):
    """Beginnings of words; each keeps its own ending."""
    return memory.replace_in_memory(view(spark, d, "corrections"), "th", "dr", "prefix").drop("source_text")


@query(
    """WITH e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_text, lower(trim(final_translation)) ORDER BY id) AS n FROM corrections) WHERE n = 1)
SELECT id, project_id FROM e WHERE trim(source_text) <> '' AND trim(final_translation) <> '' AND NOT EXISTS (SELECT 1 FROM corrections c WHERE c.project_id = 0 AND c.source_text = e.source_text AND lower(trim(c.final_translation)) = lower(trim(e.final_translation)))""",
    "corrections",
)
def import_corrections(spark, d):
    """Project 0 is there, everything is the file."""
    c = view(spark, d, "corrections")
    return memory.import_corrections(c.where("project_id = 0"), c.withColumn("seq", F.col("id"))).select("id", "project_id")


@query(
    """SELECT l.matched_correction_id, l.id AS log_id, l.run_id, l.bubble_id, l.output_text, z.without_memory, f.latest_final FROM lines l JOIN corrections c ON l.matched_correction_id = c.id
LEFT JOIN (SELECT run_id, bubble_id, arg_min(output_text, id) AS without_memory FROM logs WHERE variant = 'zero_shot' GROUP BY ALL) z ON z.run_id = l.run_id AND z.bubble_id = l.bubble_id
LEFT JOIN (SELECT project_id, source_text, arg_max(final_translation, created_at) AS latest_final FROM corrections GROUP BY ALL) f ON f.project_id = c.project_id AND f.source_text = l.source_text
WHERE l.variant = 'memory_injected'""".replace("lines l", "(SELECT g.* EXCLUDE (source_text), coalesce(s.source_text, g.source_text) AS source_text FROM logs g LEFT JOIN corrections s ON s.id = g.matched_correction_id) l"),
    "logs", "corrections",
)
def correction_usage(spark, d):
    """Logs that an entry was injected in, with its source as theirs."""
    c, l = view(spark, d, "corrections"), view(spark, d, "logs")
    source = c.select(F.col("id").alias("matched_correction_id"), F.col("source_text").alias("_s"))
    l = l.join(source, "matched_correction_id", "left").withColumn("source_text", F.coalesce("_s", "source_text")).drop("_s")
    return memory.correction_usage(c, l)


@query("SELECT matched_correction_id AS correction_id, count(*) AS reuse_count FROM logs WHERE variant = 'memory_injected' GROUP BY ALL", "logs")
def reuse_counts(spark, d):
    return logs.reuse_counts(view(spark, d, "logs"))


@query()
def fold_corrections(spark, d):
    c = view(spark, d, "corrections")
    saves = c.select(F.col("id").alias("seq"), F.col("created_at").alias("at"), F.when(F.col("id") % 9 == 0, "use").otherwise("save").alias("event"), "project_id", "page_id", "bubble_id", "source_text", "ai_translation", "final_translation", (F.col("id") % 2 == 0).alias("approve"))
    return memory.fold_corrections(saves).select("id", "project_id", "kind", "reuse_count", secs("created_at").alias("created"))


@query("SELECT id, coalesce(kind, 'corrected') AS kind, reuse_count FROM corrections WHERE coalesce(kind, 'corrected') = 'corrected' AND (contains(lower(source_text), 'the') OR contains(lower(final_translation), 'the'))", "corrections")
def memory_view(spark, d):
    return memory.memory_view(view(spark, d, "corrections"), "corrected", "the", "most_used").select("id", "kind", "reuse_count")


@query(
    """SELECT id, CASE WHEN id % 3 = 0 AND final_translation <> 'neu' THEN 'neu' ELSE final_translation END AS final_translation,
CASE WHEN id % 3 = 0 AND final_translation <> 'neu' THEN 'corrected' ELSE kind END AS kind, CASE WHEN id % 3 = 0 AND final_translation <> 'neu' THEN final_translation END AS final_before_edit FROM corrections""",
    "corrections",
)
def edit_final(spark, d):
    c = view(spark, d, "corrections").withColumns({"edited_at": F.lit(None).cast("timestamp"), "final_before_edit": F.lit(None).cast("string")})
    edits = c.where("id % 3 = 0").select("id", F.lit(" neu ").alias("new_final"), F.lit("2024-06-01").cast("timestamp").alias("at"))
    return memory.edit_final(c, edits).select("id", "final_translation", "kind", "final_before_edit")


@query("SELECT id, CASE WHEN id % 2 = 0 AND reuse_count = 0 THEN 'new source' ELSE source_text END AS source_text, (id % 2 = 0 AND reuse_count = 0) AS re_embed FROM corrections", "corrections")
def follow_source_edits(spark, d):
    c = view(spark, d, "corrections")
    edits = c.where("id % 2 = 0").select("page_id", "bubble_id", F.upper("source_text").alias("old_text"), F.lit("new source").alias("new_text"))
    return memory.follow_source_edits(c, edits).select("id", "source_text", "re_embed")


# --- text functions


@query(
    f"SELECT page_id, pos, {KEY.format('text')} AS phrase_key, CASE WHEN {WORDS.format('text')} <= 2 THEN 'exact' ELSE 'fuzzy' END AS lane, "
    r"""CASE WHEN NOT regexp_matches(text, '\S') THEN 'empty' WHEN regexp_matches(text, '\p{L}') THEN NULL WHEN regexp_matches(text, '\p{Nd}') THEN 'number' ELSE 'symbols' END AS skip_reason,
length(regexp_replace(text, '[^\p{L}]', '', 'g')) >= 2 AND length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) >= 0.9 * length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS caps FROM bubbles""",
    "bubbles",
)
def line_functions(spark, d):
    """F1, F2, F5, P5."""
    t = F.col("text")
    return view(spark, d, "bubbles").select("page_id", "pos", text.normalize_phrase(t).alias("phrase_key"), text.lane(t).alias("lane"), text.skip_reason(t).alias("skip_reason"), text.is_caps_line(t).alias("caps"))


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query(
    f"""WITH w AS (SELECT item_id, list_distinct(list_filter(string_split({KEY.format('text')}, ' '), lambda x: length(x) > 1 AND x NOT IN ({_STOP}))) AS c FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, CAST(CASE WHEN len(a.c) = 0 OR len(b.c) = 0 THEN 0 ELSE 100.0 * len(list_intersect(a.c, b.c)) / len(list_distinct(list_concat(a.c, b.c))) END AS DOUBLE) AS overlap
FROM w a JOIN w b ON b.item_id = a.item_id + 1"""
)
def lexical_overlap(spark, d):
    """each benchmark text against the next one."""
    w = spark.read.parquet(f"{d}/benchmark.parquet").withColumn("c", text.content_words(F.col("text")))
    x, y = w.select(F.col("item_id").alias("a"), F.col("c").alias("ca")), w.select(F.col("item_id").alias("b"), F.col("c").alias("cb"))
    return x.join(y, F.col("b") == F.col("a") + 1).select("a", "b", text.jaccard_percent(F.col("ca"), F.col("cb")).alias("overlap"))


@query(
    r"""SELECT page_id, CASE WHEN n <> '' THEN 'Chapter_' || CASE WHEN ltrim(n, '0') = '' THEN '0' ELSE ltrim(n, '0') END ELSE CASE WHEN p = '' THEN 'Chapter' ELSE p END END AS label
FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]+/[a-z]+/([^/?#]*)', 1) AS p, regexp_extract(regexp_extract(url, '^https?://[^/]+/[a-z]+/([^/?#]*)', 1), '^(\d+)$', 1) AS n FROM pages)"""
)
def chapter_labels(spark, d):
    """The last part of a page's address as its folder."""
    p = spark.read.parquet(f"{d}/pages.parquet")
    return p.select("page_id", text.chapter_label(F.regexp_extract("url", r"^https?://[^/]+/[a-z]+/([^/?#]*)", 1)).alias("label"))


@query(
    """SELECT page_id, bubble_id, CASE WHEN a = '' THEN 'no_draft' WHEN a = f THEN 'unchanged' WHEN ba = bf THEN 'minor' ELSE 'edited' END AS status, CASE WHEN a <> '' THEN length(f) - length(a) END AS char_dist, length(f) AS final_chars
FROM (SELECT *, trim(ai_translation) AS a, trim(translation) AS f, regexp_replace(lower(nfkc(ai_translation)), '[\\p{P}\\p{Z}\\p{S}\\s]', '', 'g') AS ba, regexp_replace(lower(nfkc(translation)), '[\\p{P}\\p{Z}\\p{S}\\s]', '', 'g') AS bf FROM bubbles
WHERE NOT skip AND """.replace("\\\\", "\\").replace("nfkc(", "(") + SEEN + ")",
    "bubbles",
)
def edit_effort(spark, d):
    """Drafts are final texts with letters left out, so the distance is the number of these."""
    return progress.bubble_effort(view(spark, d, "bubbles")).select("page_id", "bubble_id", "status", "char_dist", "final_chars")


@query(
    """SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'INFO' WHEN 'click' THEN 'WARNING' WHEN 'signup' THEN 'INFO' ELSE 'ERROR' END AS has_level,
CASE event_type WHEN 'view' THEN 'user ' || user_id || ' ' || props WHEN 'click' THEN 'x.py:' || user_id || ': UserWarning: ' || props WHEN 'signup' THEN 'Loading: ' || user_id || '%|##| 1/9' WHEN 'error' THEN props ELSE props || ' ' || user_id END AS message FROM events"""
)
def log_levels(spark, d):
    """lines put together from the events."""
    e = spark.read.parquet(f"{d}/events.parquet")
    kind, user, props = F.col("event_type"), F.col("user_id").cast("string"), F.col("props")
    lines = {
        "view": F.concat(F.lit("INFO: user "), user, F.lit(" "), props), "click": F.concat(F.lit("x.py:"), user, F.lit(": UserWarning: "), props),
        "signup": F.concat(F.lit("Loading: "), user, F.lit("%|##| 1/9")), "error": F.concat(F.lit("\x1b[31m"), props, F.lit("\x1b[0m")),
    }
    line = F.coalesce(*[F.when(kind == k, v) for k, v in lines.items()], F.concat(props, F.lit(" "), user))
    return e.select(F.col("event_id").alias("id"), text.log_level(line).alias("_l")).select("id", F.col("_l.level").alias("has_level"), F.col("_l.message").alias("message"))


@query(
    """SELECT event_id AS id, CASE WHEN event_type = 'view' THEN user_id % 2 = 0 WHEN event_type = 'error' THEN user_id % 3 = 0 ELSE false END AS daily, CASE WHEN event_type = 'view' THEN round(value, 2) END AS retry_seconds,
CASE WHEN event_type IN ('view', 'error') THEN CAST(user_id AS INT) END AS limit_value, CASE WHEN event_type = 'view' THEN 'requests_' || user_id % 5 WHEN event_type = 'error' THEN CASE WHEN user_id % 3 = 0 THEN 'requests per day' ELSE 'requests per minute' END WHEN event_type = 'click' THEN 'tokens per minute' END AS metric FROM events"""
)
def rate_limits(spark, d):
    """F16: refusals put together from the events."""
    e = spark.read.parquet(f"{d}/events.parquet")
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    span = F.when(F.col("user_id") % 2 == 0, "PerDay").otherwise("PerMinute")
    wait = F.format_string("%.2f", F.col("value"))
    status = F.concat(F.lit("Quota exceeded for metric: api/x/requests_"), F.col("user_id") % 5, F.lit(", limit: "), user, F.lit(", quotaId: Requests"), span, F.lit("PerModel. Please retry in "), wait, F.lit("s"))
    per = F.when(F.col("user_id") % 3 == 0, "day (RPD)").otherwise("minute (RPM)")
    plain = F.when(kind == "error", F.concat(F.lit("Rate limit reached on requests per "), per, F.lit(": Limit "), user, F.lit(", Used 9"))).when(kind == "click", F.concat(F.lit("on tokens per minute (TPM): Limit "), user)).otherwise(F.col("props"))
    found = F.when(kind == "view", text.rate_limit_info(status, "status")).otherwise(text.rate_limit_info(plain, "plain"))
    return e.select(F.col("event_id").alias("id"), found.alias("_r")).select("id", "_r.*")


@query("SELECT event_id AS id, CASE WHEN user_id % 2 = 0 THEN CAST(timezone('America/Los_Angeles', timezone('UTC', ts)) AS DATE) ELSE CAST(ts AS DATE) END AS day FROM events")
def quota_days(spark, d):
    """F19."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_id").alias("id"), text.quota_day(F.col("ts").cast("timestamp"), F.when(F.col("user_id") % 2 == 0, "gemini").otherwise("other")).alias("day"))


@query("SELECT vec_id, row_number() OVER (ORDER BY list_dot_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) DESC, vec_id) AS place FROM embeddings QUALIFY place <= 25")
def cosine_rank(spark, d):
    """a top-k report."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    first = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("_q")))
    top = e.crossJoin(first).select("vec_id", text.cosine(F.col("embedding"), F.col("_q")).alias("c")).orderBy(F.desc("c"), "vec_id").limit(25)
    from pyspark.sql import Window

    return top.select("vec_id", F.row_number().over(Window.orderBy(F.desc("c"), "vec_id")).alias("place"))


# --- progress and effort

STAGES_SQL = f"""c AS (SELECT page_id, count(*) FILTER (NOT skip) AS bubbles, count(*) FILTER (NOT skip AND trim(translation) <> '') AS translated, count(*) FILTER (NOT skip AND {SEEN}) AS reviewed,
  count(*) FILTER (NOT skip AND {SEEN} AND confirmed_via = 'page') AS page_accepted FROM bubbles GROUP BY page_id),
st AS (SELECT m.page_id, m.project_id, m.status, m.updated_at, coalesce(bubbles, 0) AS bubbles, coalesce(translated, 0) AS translated, coalesce(reviewed, 0) AS reviewed, coalesce(page_accepted, 0) AS page_accepted,
  CASE WHEN coalesce(reviewed, 0) = coalesce(bubbles, 0) THEN CASE WHEN layout_checked_at IS NOT NULL THEN 'checked' ELSE 'reviewed' END WHEN translated = 0 THEN 'ocr' WHEN translated < bubbles THEN 'partial' ELSE 'translated' END AS stage
  FROM page_meta m LEFT JOIN c USING (page_id))"""


@query(f"WITH {STAGES_SQL} SELECT page_id, bubbles, translated, reviewed, page_accepted, stage FROM st", "bubbles", "page_meta")
def page_stage(spark, d):
    """A1, P1."""
    return progress.page_stage(view(spark, d, "page_meta"), view(spark, d, "bubbles")).select("page_id", "bubbles", "translated", "reviewed", "page_accepted", "stage")


@query(
    f"""WITH {STAGES_SQL}, p AS (SELECT project_id, updated_at, status, CASE WHEN status = 'processed' THEN stage ELSE status END AS base, CASE WHEN status = 'processed' AND page_id % 4 = 0 THEN CASE WHEN page_id % 8 = 0 THEN 'current' ELSE 'outdated' END END AS export FROM st WHERE status <> 'excluded'),
i AS (SELECT *, CASE WHEN base IN ('reviewed', 'checked') AND export = 'current' THEN 'exported' ELSE base END AS stage FROM p)
SELECT project_id, count(*) AS total, {', '.join(f"count(*) FILTER (stage = '{s}') AS {s}" for s in progress.STAGE_WEIGHT)}, count(*) FILTER (stage IN ('pending', 'failed')) AS other,
count(*) FILTER (stage NOT IN ('pending', 'failed')) AS processed, count(*) FILTER (stage IN ('reviewed', 'checked', 'exported')) AS text_reviewed,
count(*) FILTER (stage = 'exported' AND base = 'checked') AS exported_checked, count(*) FILTER (export = 'current' AND stage NOT IN ('reviewed', 'checked', 'exported')) AS exported_draft,
CAST(floor(epoch(max(updated_at) FILTER (status = 'processed'))) AS BIGINT) AS last_activity,
CAST(sum(CASE stage {' '.join(f"WHEN '{s}' THEN {w}" for s, w in progress.STAGE_WEIGHT.items())} ELSE 0 END) AS DOUBLE) / (5 * count(*)) AS done_score FROM i GROUP BY project_id""",
    "bubbles", "page_meta",
)
def project_progress(spark, d):
    """A2, A3, A4: some pages aren't read yet, some exports are older than their page."""
    m = view(spark, d, "page_meta")
    late = F.when(F.col("page_id") % 8 == 0, F.col("updated_at")).otherwise(F.col("updated_at") - F.expr("interval 1 second"))
    exports = m.where("page_id % 4 = 0").select("page_id", late.alias("at"))
    stages = progress.page_stage(m, view(spark, d, "bubbles"))
    return progress.project_progress(progress.page_progress(stages, exports)).withColumn("last_activity", secs("last_activity"))


@query("SELECT page_id, CAST(floor(epoch(min(created_at))) AS BIGINT) AS first_at FROM logs GROUP BY page_id", "logs")
def first_translation(spark, d):
    """A17."""
    return progress.first_translation(view(spark, d, "logs")).select("page_id", secs("first_at").alias("first_at"))


@query(
    f"""WITH e AS (SELECT *, trim(ai_translation) AS a, trim(translation) AS f, coalesce(confirmed_via = 'page', false) AS via FROM bubbles WHERE NOT skip AND {SEEN}),
x AS (SELECT *, unnest(CASE WHEN via THEN ['all'] ELSE ['all', 'one_by_one'] END) AS subset FROM e)
SELECT subset, count(*) AS bubbles, count(*) FILTER (a = '') AS no_draft, count(*) FILTER (a <> '' AND a = f) AS unchanged, CAST(sum(length(f)) FILTER (a <> '') AS BIGINT) AS chars_final, CAST(sum(length(f) - length(a)) FILTER (a <> '') AS BIGINT) AS chars_edited,
CAST(sum(length(a)) FILTER (a <> '') AS BIGINT) AS chars_saved, round(avg((length(f) - length(a)) / greatest(1, length(f))) FILTER (a <> ''), 9) AS mean_edit_rate, round(100.0 * sum(length(f) - length(a)) FILTER (a <> '') / sum(length(f)) FILTER (a <> ''), 9) AS char_edit_pct FROM x GROUP BY subset""",
    "bubbles",
)
def translation_effort(spark, d):
    """A15."""
    out = progress.translation_effort(progress.bubble_effort(view(spark, d, "bubbles")))
    return out.select("subset", "bubbles", "no_draft", "unchanged", "chars_final", "chars_edited", "chars_saved", F.round("mean_edit_rate", 9).alias("mean_edit_rate"), F.round("char_edit_pct", 9).alias("char_edit_pct"))


@query(
    f"""WITH e AS (SELECT page_id, count(*) AS reviewed, count(*) FILTER (trim(ai_translation) = '') AS no_draft, count(*) FILTER (trim(ai_translation) <> '' AND trim(ai_translation) = trim(translation)) AS unchanged,
  CAST(coalesce(sum(length(trim(translation)) - length(trim(ai_translation))) FILTER (trim(ai_translation) <> ''), 0) AS BIGINT) AS char_dist FROM bubbles WHERE NOT skip AND {SEEN} GROUP BY page_id),
o AS (SELECT page_id, count(*) FILTER (op = 'merge') AS b, count(*) FILTER (op = 'layout') AS l, count(*) AS n FROM manual_ops GROUP BY page_id), f AS (SELECT page_id, min(created_at) AS first_at FROM logs GROUP BY page_id)
SELECT page_id, coalesce(reviewed, 0) AS reviewed, coalesce(no_draft, 0) AS no_draft, coalesce(unchanged, 0) AS unchanged, coalesce(char_dist, 0) AS char_dist, coalesce(least(ocr_at, first_at) >= TIMESTAMP '2024-01-05', false) AS tracked,
CASE WHEN least(ocr_at, first_at) >= TIMESTAMP '2024-01-05' THEN coalesce(b, 0) END AS ops_bubbles, CASE WHEN least(ocr_at, first_at) >= TIMESTAMP '2024-01-05' THEN coalesce(l, 0) END AS ops_lettering, CASE WHEN least(ocr_at, first_at) >= TIMESTAMP '2024-01-05' THEN coalesce(n, 0) END AS ops_total,
CASE WHEN ocr_at IS NULL THEN '' WHEN ocr_at >= TIMESTAMP '2024-01-20' THEN 'new' ELSE 'old' END AS "grouping" FROM page_meta LEFT JOIN e USING (page_id) LEFT JOIN o USING (page_id) LEFT JOIN f USING (page_id)""",
    "bubbles", "manual_ops", "logs", "page_meta",
)
def page_work(spark, d):
    """A14."""
    b, m = view(spark, d, "bubbles"), view(spark, d, "page_meta")
    work = progress.page_work(m.select("page_id", "ocr_at"), progress.bubble_effort(b), view(spark, d, "manual_ops"), progress.first_translation(view(spark, d, "logs")), "2024-01-05", "2024-01-20")
    return work.select("page_id", "reviewed", "no_draft", "unchanged", "char_dist", "tracked", "ops_bubbles", "ops_lettering", "ops_total", "grouping")


@query(
    """WITH o AS (SELECT page_id, count(*) FILTER (op = 'merge') AS b, count(*) FILTER (op = 'edit_source') AS t, count(*) FILTER (op = 'layout') AS l, count(*) FILTER (op = 'unknown_op') AS x, count(*) AS n FROM manual_ops GROUP BY page_id),
f AS (SELECT page_id, min(created_at) AS first_at FROM logs GROUP BY page_id),
r AS (SELECT coalesce(b, 0) AS b, coalesce(t, 0) AS t, coalesce(l, 0) AS l, coalesce(x, 0) AS x, coalesce(n, 0) AS n FROM page_meta LEFT JOIN o USING (page_id) LEFT JOIN f USING (page_id) WHERE least(ocr_at, first_at) >= TIMESTAMP '2024-01-01 12:00:00'),
g AS (SELECT unnest(['bubbles', 'ocr_text', 'translation', 'cleaning', 'lettering', 'other', 'total']) AS "group", unnest([b, t, 0, 0, l, x, n]) AS v FROM r)
SELECT "group", count(*) AS pages, CAST(sum(v) AS BIGINT) AS total, CAST(avg(v) AS DOUBLE) AS mean, CAST(median(v) AS DOUBLE) AS median, 100.0 * count(*) FILTER (v > 0) / count(*) AS with_pct FROM g GROUP BY "group" """,
    "manual_ops", "page_meta", "logs",
)
def ops_effort(spark, d):
    """A14, A16."""
    m, b = view(spark, d, "page_meta").select("page_id", "ocr_at"), view(spark, d, "bubbles")
    work = progress.page_work(m, progress.bubble_effort(b), view(spark, d, "manual_ops"), progress.first_translation(view(spark, d, "logs")), "2024-01-01 12:00:00", "2024-01-20")
    return progress.ops_effort(work)


@query(
    """WITH s AS (SELECT *, CASE WHEN op = 'layout' AND lag(op) OVER w = 'layout' AND lag(bubble) OVER w = bubble AND lag(detail) OVER w = detail AND epoch_us(manual_ops.at) - epoch_us(lag(manual_ops.at) OVER w) BETWEEN 0 AND 21600000000 THEN 0 ELSE 1 END AS st
  FROM manual_ops WINDOW w AS (PARTITION BY page_id ORDER BY seq)), r AS (SELECT *, sum(st) OVER (PARTITION BY page_id ORDER BY seq) AS run FROM s)
SELECT page_id, min(seq) AS seq, arg_min(op, seq) AS op, arg_min(bubble, seq) AS bubble, count(*) AS n FROM r GROUP BY page_id, run""",
    "manual_ops",
)
def coalesce_ops(spark, d):
    """W3, with a gap of six hours as the events are sparse."""
    return progress.coalesce_ops(view(spark, d, "manual_ops"), gap_seconds=21600).select("page_id", "seq", "op", "bubble", "n")


@query(
    """SELECT page_id, pos, len(list_filter([lag(t, 2) OVER w, lag(t, 1) OVER w, lead(t, 1) OVER w, lead(t, 2) OVER w], lambda x: x IS NOT NULL AND x <> '')) AS n
FROM (SELECT page_id, pos, CASE WHEN skip THEN '' ELSE trim(text) END AS t FROM bubbles) WINDOW w AS (PARTITION BY page_id ORDER BY pos)""",
    "bubbles",
)
def neighbour_context(spark, d):
    """W2."""
    return progress.neighbour_context(view(spark, d, "bubbles")).select("page_id", "pos", F.size("context").cast("long").alias("n"))


@query(
    f"""SELECT page_id, bubble_id, CASE WHEN page_id % 3 = 0 AND trim(translation) <> '' AND NOT {SEEN} AND NOT skip THEN translation WHEN page_id % 3 = 1 AND coalesce(confirmed_via = 'page', false) THEN NULL ELSE confirmed_translation END AS confirmed_translation FROM bubbles""",
    "bubbles",
)
def review_page(spark, d):
    """P16."""
    b = view(spark, d, "bubbles").withColumn("confirmed_at", F.lit(None).cast("timestamp"))
    pages = b.select("page_id").distinct()
    return progress.review_page(b, pages.where("page_id % 3 = 0"), pages.where("page_id % 3 = 1"), "2024-02-01").select("page_id", "bubble_id", "confirmed_translation")


@query("SELECT page_id, bubble_id FROM bubbles WHERE NOT skip AND trim(text) <> '' AND trim(translation) = trim(ai_translation)", "bubbles")
def retranslate_targets(spark, d):
    """P11."""
    return progress.retranslate_targets(view(spark, d, "bubbles")).select("page_id", "bubble_id")


@query(
    f"""WITH r AS (SELECT page_id, bubble_id, translation AS before, {WHOLE.format(WHOLE.format(WHOLE.format(WHOLE.format('translation', 'the', 'ten'), 'the', 'ten'), 'The', 'Ten'), 'THE', 'TEN')} AS translation, confirmed_translation FROM bubbles)
SELECT page_id, bubble_id, translation, 1 AS n_edits, CASE WHEN confirmed_translation = before THEN translation ELSE confirmed_translation END AS confirmed_translation FROM r WHERE before <> translation""",
    "bubbles",
)
def replace_in_translations(spark, d):
    """The review stamp follows."""
    b = view(spark, d, "bubbles").withColumn("bulk_edits", F.lit(None).cast("array<struct<at:string,find:string,replace:string>>"))
    return progress.replace_in_translations(b, "the", "ten", "word", "2024-02-01").where("changed").select("page_id", "bubble_id", "translation", F.size("bulk_edits").alias("n_edits"), "confirmed_translation")


# --- glossary


@query(
    """WITH f AS (SELECT lower('Wyvern') AS term, run_id, page_id, bubble_id, created_at FROM logs WHERE glossary_terms_used LIKE '[{%')
SELECT term, count(DISTINCT (run_id, page_id, bubble_id)) AS uses, CAST(floor(epoch(max(created_at))) AS BIGINT) AS last_used FROM f GROUP BY term""",
    "logs",
)
def term_usage_counts(spark, d):
    """Unreadable lists have no terms."""
    return glossary.term_usage_counts(view(spark, d, "logs")).select("term", "uses", secs("last_used").alias("last_used"))


@query(
    """WITH f AS (SELECT * FROM logs WHERE glossary_terms_used LIKE '[{%'), p AS (SELECT 'wyvern' AS term, run_id, page_id, bubble_id, arg_min(output_text, id) FILTER (variant = 'zero_shot') AS zero_shot,
  arg_min(output_text, id) FILTER (variant = 'memory_injected') AS memory_injected, arg_min({'p': project_id, 's': source_text}, id) AS s FROM f GROUP BY run_id, page_id, bubble_id),
l AS (SELECT CAST(page_id % 5 AS INT) AS p, 'line ' || pos AS s, arg_max(translation, page_id) AS latest_final FROM bubbles GROUP BY ALL)
SELECT p.* EXCLUDE (s), b.translation AS now, l.latest_final FROM p LEFT JOIN bubbles b USING (page_id, bubble_id) LEFT JOIN l ON l.p = p.s.p AND l.s = p.s.s""",
    "logs", "bubbles",
)
def term_usage(spark, d):
    """With the latest final text of each source (here: of lines by their place)."""
    b = view(spark, d, "bubbles")
    c = b.select((F.col("page_id") % 5).cast("int").alias("project_id"), F.concat(F.lit("line "), "pos").alias("source_text"), F.col("translation").alias("final_translation"), F.timestamp_seconds("page_id").alias("created_at"), F.col("page_id").alias("id"))
    return glossary.term_usage(view(spark, d, "logs"), b, c)


@query(
    r"""WITH g AS (SELECT DISTINCT project_id, source_term, CASE WHEN regexp_matches(source_term, '[^sS][sS]$') THEN lower(left(source_term, -1)) ELSE lower(source_term) END AS stem FROM glossary),
k AS (SELECT project_id, source_term, unnest([stem, stem || 's', stem || 'es']) AS word FROM g),
w AS (SELECT page_id, pos, project_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM bubbles)
SELECT DISTINCT page_id, pos, source_term FROM w JOIN k USING (project_id, word)""",
    "bubbles", "glossary",
)
def match_glossary(spark, d):
    """Which terms occur in which lines; one-word terms, so none lies inside another."""
    g = view(spark, d, "glossary").dropDuplicates(["project_id", "source_term"])
    found = glossary.match_glossary(view(spark, d, "bubbles").select("page_id", "pos", "project_id", "text"), g)
    return found.select("page_id", "pos", F.explode("matches.source_term").alias("source_term")).distinct()


@query()
def suggest_terms(spark, d):
    """Names that the draft and the final text spell otherwise; the source has them as the final text does."""
    c = view(spark, d, "corrections").withColumn("source_text", F.col("final_translation"))
    return glossary.suggest_terms(c, view(spark, d, "glossary"), min_occurrences=2)


@query()
def suggestions_for_saved(spark, d):
    """The suggestions that a saved line of the first project's pages would raise."""
    c = view(spark, d, "corrections").withColumn("source_text", F.col("final_translation"))
    found = glossary.suggest_terms(c, view(spark, d, "glossary"), min_occurrences=2)
    return glossary.suggestions_for(found, c.select("project_id", "source_text")).select("project_id", "term", "wrong", "right")


@query(
    """SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY project_id ORDER BY id DESC) AS n FROM corrections WHERE coalesce(kind, 'corrected') = 'corrected' AND coalesce(ai_translation, '') <> '' AND lower(trim(ai_translation)) <> lower(trim(final_translation))) WHERE n <= 80""",
    "corrections",
)
def edits_for_extraction(spark, d):
    """The feature is a limit of 80."""
    return glossary.edits_for_extraction(view(spark, d, "corrections")).select("id")


#: SQL of a term's inflected presence, from the rules of the term check: words of letters, a stem, at most four letters more.
LETTERS_SQL = r"regexp_extract_all(lower({0}), '\p{{L}}+(?:[-'']\p{{L}}+)*')"
STEM_SQL = "CASE WHEN length(regexp_replace({0}, '[aeiouyąęó]+$', '')) >= 3 THEN regexp_replace({0}, '[aeiouyąęó]+$', '') WHEN length({0}) > 3 THEN left({0}, 3) ELSE {0} END"
PRESENT_SQL = f"""len(list_filter(want, lambda w: len(list_filter(said, lambda t: starts_with(t, {STEM_SQL.format('w')}) AND length(t) - length({STEM_SQL.format('w')}) <= 4
  AND (list_contains(want, t) OR NOT list_contains(foreign_words, t)))) = 0)) = 0"""


@query(
    f"""WITH g AS (SELECT min(id) AS id, project_id, regexp_extract(source_text, '([A-Za-z]{{5,}})', 1) AS word, min(regexp_extract(final_translation, '([A-Za-z]{{5,}})', 1)) AS target_term FROM corrections WHERE regexp_extract(source_text, '([A-Za-z]{{5,}})', 1) <> '' GROUP BY project_id, word),
p AS (SELECT id, project_id, CASE WHEN id % 7 = 0 THEN word || 'zq' ELSE word END AS source_term, target_term FROM g),
k AS (SELECT p.* FROM p JOIN corrections c ON c.id = p.id AND c.project_id = p.project_id WHERE target_term <> '' AND contains(lower(c.source_text), lower(source_term))
  AND NOT EXISTS (SELECT 1 FROM p k WHERE k.id % 3 = 0 AND k.project_id = p.project_id AND upper(k.source_term) = upper(p.source_term))),
f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY project_id, upper(source_term) ORDER BY id, source_term) = 1),
w AS (SELECT f.*, {LETTERS_SQL.format('c.final_translation')} AS said, {LETTERS_SQL.format('source_term')} AS foreign_words, {LETTERS_SQL.format('target_term')} AS tokens FROM f JOIN corrections c ON c.project_id = f.project_id AND contains(lower(c.source_text), lower(source_term))),
v AS (SELECT * EXCLUDE (tokens), CASE WHEN len(list_filter(tokens, lambda x: length(x) >= 3)) > 0 THEN list_filter(tokens, lambda x: length(x) >= 3) ELSE tokens END AS want FROM w)
SELECT project_id, lower(source_term) AS term, CAST(greatest(1, count_if({PRESENT_SQL})) AS BIGINT) AS support FROM v GROUP BY ALL""",
    "corrections",
)
def rank_extracted_terms(spark, d):
    """Each entry's first long words as proposals, some of them known, some that their entry doesn't hold."""
    c = view(spark, d, "corrections")
    first = lambda col: F.regexp_extract(col, "([A-Za-z]{5,})", 1)
    p = c.where(first("source_text") != "").groupBy("project_id", first("source_text").alias("source_term")).agg(F.min("id").alias("id"), F.min(first("final_translation")).alias("target_term"))
    p = p.withColumn("source_term", F.when(F.col("id") % 7 == 0, F.concat("source_term", F.lit("zq"))).otherwise(F.col("source_term")))
    return glossary.rank_extracted_terms(p, c, p.where("id % 3 = 0")).select("project_id", F.lower("source_term").alias("term"), "support")


@query("SELECT min(id) AS id, 'import' AS origin FROM glossary g WHERE source_term <> '' AND target_term <> '' AND NOT EXISTS (SELECT 1 FROM glossary h WHERE h.project_id = 0 AND lower(h.source_term) = lower(g.source_term) AND lower(h.target_term) = lower(g.target_term)) GROUP BY lower(source_term), lower(target_term)", "glossary")
def import_glossary(spark, d):
    """S5."""
    g = view(spark, d, "glossary")
    return glossary.import_glossary(g.where("project_id = 0"), g.withColumns({"seq": F.col("id"), "origin": F.lit("elsewhere")})).select("id", "origin")


@query(
    r"""WITH g AS (SELECT DISTINCT ON (project_id, lower(source_term)) project_id, lower(source_term) AS stem FROM glossary WHERE NOT regexp_matches(source_term, '[sS]$') ORDER BY project_id, lower(source_term), id),
k AS (SELECT project_id, stem, unnest([stem, stem || 's', stem || 'es']) AS word FROM g), w AS (SELECT page_id, pos, project_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM bubbles),
m AS (SELECT page_id, pos, count(DISTINCT stem) AS n FROM w JOIN k USING (project_id, word) GROUP BY ALL)
SELECT page_id, pos, CAST(coalesce(n, 0) AS INT) AS n, CAST(CASE WHEN trim(translation) = '' THEN 0 ELSE coalesce(n, 0) END AS INT) AS still FROM bubbles LEFT JOIN m USING (page_id, pos)""",
    "bubbles", "glossary",
)
def check_terms(spark, d):
    """terms whose translation no line holds, so all that occur are missing from a line with a translation."""
    g = view(spark, d, "glossary").where("not source_term rlike '[sS]$'").withColumns({"source_term": F.lower("source_term"), "target_term": F.lit("Zyzzyxa")})
    g = g.groupBy("project_id", "source_term", "target_term").agg(F.min("id").alias("id"))
    rows = glossary.match_glossary(view(spark, d, "bubbles").select("page_id", "pos", "project_id", "text", "ai_translation", "translation"), g)
    out = glossary.check_terms(rows.withColumns({"draft": F.col("ai_translation"), "edited": F.col("translation")}))
    return out.select("page_id", "pos", F.size("matches").alias("n"), F.size("still").alias("still"))


# --- logs

PAIRS_SQL = """o AS (SELECT run_id, bubble_id, variant, arg_min({'i': id, 'o': output_text, 't': threshold_used, 'h': hints_json, 'j': injection_json, 's': similarity_score, 'g': glossary_terms_used, 'k': k, 'c': created_at, 'p': project_id, 'q': page_id}, (created_at, id)) AS r FROM logs GROUP BY ALL),
p AS (SELECT coalesce(z.run_id, m.run_id) AS run_id, coalesce(z.bubble_id, m.bubble_id) AS bubble_id, z.r AS z, m.r AS m FROM (SELECT * FROM o WHERE variant = 'zero_shot') z FULL JOIN (SELECT * FROM o WHERE variant = 'memory_injected') m ON z.run_id = m.run_id AND z.bubble_id = m.bubble_id),
l AS (SELECT *, CASE WHEN m IS NULL THEN NULL WHEN m.k % 3 = 0 THEN 'fuzzy' WHEN m.h IS NOT NULL THEN 'exact' WHEN m.t IS NULL THEN 'exact' ELSE 'fuzzy' END AS lane FROM p)"""


@query(f"WITH {PAIRS_SQL} SELECT run_id, bubble_id, z.i AS zero_shot_id, m.i AS memory_id, lane FROM l", "logs")
def pair_logs(spark, d):
    """A10."""
    return logs.pair_logs(view(spark, d, "logs")).select("run_id", "bubble_id", F.col("zero_shot.id").alias("zero_shot_id"), F.col("memory_injected.id").alias("memory_id"), "lane")


@query(
    f"""WITH {PAIRS_SQL}, x AS (SELECT *, CASE WHEN z.k % 3 = 1 THEN 'out ' || (z.k % 2) ELSE z.o END AS zo, CASE WHEN m.k % 3 = 1 THEN 'out ' || (m.k % 2) ELSE m.o END AS mo, coalesce(m, z) AS s FROM l)
SELECT count(*) AS bubbles, count(*) FILTER (lane = 'fuzzy') AS fuzzy, count(*) FILTER (lane = 'exact') AS exact, count(*) FILTER (lane = 'fuzzy' AND z IS NOT NULL) AS paired,
count(*) FILTER (lane = 'fuzzy' AND z IS NOT NULL AND zo <> mo) AS changed, min(m.s) FILTER (lane = 'fuzzy') AS least_similarity, max(m.s) FILTER (lane = 'fuzzy') AS most_similarity, '0.67' AS thresholds,
count(*) FILTER (s.g LIKE '[{{%') AS glossary_fired, 0 AS terms_missing, 0 AS terms_fixed FROM x""",
    "logs",
)
def experiment_summary(spark, d):
    """A11."""
    return logs.experiment_summary(logs.pair_logs(view(spark, d, "logs")))


@query("SELECT l.id, (SELECT count(*) FROM corrections c WHERE c.project_id = l.project_id AND c.created_at < l.created_at) AS memory_size FROM logs l", "logs", "corrections")
def memory_size_at(spark, d):
    """An as-of count."""
    rows = view(spark, d, "logs").select("id", "project_id", F.col("created_at").alias("ts"))
    return logs.memory_size_at(rows, view(spark, d, "corrections")).select("id", "memory_size")


@query(
    f"""WITH {PAIRS_SQL}, x AS (SELECT lane, coalesce(z, m).c AS t, coalesce(z, m).p AS p, CASE WHEN coalesce(m, z).k % 3 = 0 THEN coalesce(m, z).k END AS known FROM l),
y AS (SELECT lane, known IS NOT NULL AS ex, coalesce(known, (SELECT count(*) FROM corrections c WHERE c.project_id = x.p AND c.created_at < x.t)) AS n FROM x)
SELECT CASE WHEN n >= 400 THEN 400 WHEN n >= 200 THEN 200 WHEN n >= 100 THEN 100 WHEN n >= 50 THEN 50 WHEN n >= 25 THEN 25 WHEN n >= 10 THEN 10 ELSE 0 END AS bucket, count(*) AS n, count(*) FILTER (lane = 'fuzzy') AS fuzzy, count(*) FILTER (lane = 'exact') AS exact, count(*) FILTER (NOT ex) AS approximate FROM y GROUP BY 1""",
    "logs", "corrections",
)
def hit_rate_by_memory_size(spark, d):
    """A12."""
    l = view(spark, d, "logs")
    pairs = logs.pair_logs(l).withColumns({"ts": F.col("base.created_at"), "probed": F.col("shown.injection.memory_probe.size")})
    pairs = pairs.join(l.select(F.col("id").alias("_i"), "project_id"), F.col("base.id") == F.col("_i")).select("project_id", "ts", "lane", "probed")
    sized = logs.memory_size_at(pairs, view(spark, d, "corrections"))
    return logs.hit_rate_by_memory_size(sized.select("lane", F.coalesce("probed", "memory_size").alias("memory_size"), F.col("probed").isNotNull().alias("exact_size")))


@query(
    "SELECT t AS threshold, count(*) FILTER (k / 100.0 >= t) AS hits, count(*) AS probed FROM (SELECT k FROM logs WHERE k % 3 = 0), (SELECT CAST(unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9]) AS DOUBLE) AS t) GROUP BY t",
    "logs",
)
def threshold_what_if(spark, d):
    """A13."""
    l = view(spark, d, "logs").select(F.from_json("injection_json", logs.INJECTION)["memory_probe"].alias("_p")).select("_p.*")
    return logs.threshold_what_if(l)


@query("SELECT coalesce(key_label, 'unknown') AS key_label, coalesce(model_used, 'unknown') AS model, count(*) AS requests, count(*) FILTER (created_at >= TIMESTAMP '2024-01-29 00:00:00') AS last_day FROM logs GROUP BY ALL", "logs")
def key_model_stats(spark, d):
    """A5."""
    return logs.key_model_stats(view(spark, d, "logs"), "2024-01-30 00:00:00")


@query(
    f"SELECT l.id, b.pos + 1 AS number, b.translation AS current_translation, CASE WHEN b.pos IS NOT NULL THEN {SEEN} END AS reviewed FROM logs l LEFT JOIN bubbles b USING (page_id, bubble_id)",
    "logs", "bubbles",
)
def logs_with_bubble_now(spark, d):
    """J2."""
    return logs.logs_with_bubble_now(view(spark, d, "logs"), view(spark, d, "bubbles")).select("id", "number", "current_translation", "reviewed")


@query("SELECT l.id FROM logs l WHERE l.page_id % 5 = 2", "logs")
def logs_for_project(spark, d):
    """Pages of user u belong to chapter u % 20, chapters to project c % 5."""
    l = view(spark, d, "logs")
    pages = l.select(F.col("page_id").alias("id"), (F.col("page_id") % 20).alias("chapter_id")).distinct()
    chapters = pages.select(F.col("chapter_id").alias("id"), (F.col("chapter_id") % 5).alias("project_id")).distinct()
    return logs.logs_for_project(l, pages, chapters, 2).select("id")


HISTORY_SQL = PAIRS_SQL + f""", b AS (SELECT page_id, bubble_id, coalesce(translation, '') AS now, {SEEN} AS reviewed, coalesce(confirmed_via, '') = 'page' AS paged FROM bubbles),
h AS (SELECT l.*, b.reviewed, b.now, CASE WHEN b.now IS NULL THEN 'gone' WHEN NOT b.reviewed THEN 'open' WHEN trim(b.now) <> trim(coalesce(coalesce(m, z).o, '')) THEN 'edited' WHEN b.paged THEN 'page' ELSE 'accepted' END AS now_status,
  CASE WHEN m IS NOT NULL AND coalesce(m, z).g LIKE '[{{%' THEN 0 WHEN m IS NOT NULL THEN 1 WHEN coalesce(m, z).g LIKE '[{{%' THEN 2 ELSE 3 END AS hint_rank FROM l LEFT JOIN b ON b.page_id = coalesce(z, m).q AND b.bubble_id = l.bubble_id)"""


def _history(spark, d):
    b = view(spark, d, "bubbles").select("page_id", "bubble_id", F.col("translation").alias("current_translation"), text.reviewed(F.col("translation"), F.col("ai_translation"), F.col("confirmed_translation")).alias("reviewed"), (F.coalesce("confirmed_via", F.lit("")) == "page").alias("page_accepted"))
    pairs = logs.pair_logs(view(spark, d, "logs")).withColumn("page_id", F.col("base.page_id"))
    return logs.history(pairs.join(b, ["page_id", "bubble_id"], "left"))


@query(f"WITH {HISTORY_SQL} SELECT now_status, hint_rank, count(*) AS n FROM h GROUP BY ALL", "logs", "bubbles")
def history_counts(spark, d):
    """As many rows under each status and hint rank."""
    return _history(spark, d).groupBy("now_status", "hint_rank").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {HISTORY_SQL} SELECT count(*) AS "all", count(*) FILTER (now IS NOT NULL AND trim(now) <> trim(coalesce(coalesce(m, z).o, ''))) AS changed, count(*) FILTER (NOT reviewed) AS unreviewed, count(*) FILTER (m IS NOT NULL) AS memory, count(*) FILTER (lane = 'fuzzy') AS fuzzy,
count(*) FILTER (lane = 'exact') AS exact, count(*) FILTER (m IS NOT NULL AND z IS NOT NULL) AS ab, count(*) FILTER (coalesce(m, z).g LIKE '[{{%') AS glossary, 0 AS postedit FROM h""",
    "logs", "bubbles",
)
def filter_counts(spark, d):
    """P10."""
    return logs.filter_counts(_history(spark, d))


@query(
    f"""WITH {HISTORY_SQL} SELECT run_id, bubble_id, now_status, CAST(CAST(coalesce(z, m).c AS DATE) AS VARCHAR) AS day, count(*) OVER (PARTITION BY CAST(coalesce(z, m).c AS DATE)) AS day_rows FROM h ORDER BY coalesce(z, m).c DESC, coalesce(z, m).i DESC LIMIT 200""",
    "logs", "bubbles",
)
def history_sort(spark, d):
    """T5: the newest 200 rows are the feature."""
    return logs.history_sort(_history(spark, d)).select("run_id", "bubble_id", "now_status", F.col("group_label").alias("day"), F.col("group_rows").alias("day_rows"))


@query(
    """SELECT id, CASE WHEN k % 3 = 2 THEN 'broken' ELSE 'filled' END AS state, CASE WHEN k % 3 = 2 THEN injection_json ELSE left(injection_json, -1) || ',"temperature":0.3,"backfilled":"2024"}' END AS injection_json FROM logs""", "logs",
)
def backfill_json_key(spark, d):
    """P7."""
    return logs.backfill_json_key(view(spark, d, "logs"), "temperature", 0.3, "2024").select("id", "state", "injection_json")


@query(
    """WITH b AS (SELECT page_id, 'bubble_' || (k % 7) AS bubble_id, min('LINE ' || (k % 50)) AS t, any_value(project_id) AS project_id FROM logs GROUP BY 1, 2),
s AS (SELECT b.*, l.id, l.run_id, l.variant, l.matched_correction_id AS m, l.bubble_id = b.bubble_id AS own FROM b JOIN logs l ON l.page_id = b.page_id AND upper(l.source_text) = b.t),
n AS (SELECT page_id, bubble_id, arg_max(run_id, {'o': own, 'i': id}) AS run, max(own) AS o FROM s GROUP BY ALL),
u AS (SELECT page_id, bubble_id, max(id) AS log_id FROM s JOIN n USING (page_id, bubble_id) WHERE s.run_id = n.run AND own = o AND variant = 'memory_injected' GROUP BY ALL)
SELECT b.page_id, b.bubble_id, u.log_id, n.run IS NULL AND EXISTS (SELECT 1 FROM logs l WHERE l.page_id = b.page_id AND l.bubble_id = b.bubble_id) AS stale, CASE WHEN u.log_id IS NOT NULL AND l.hints_json IS NOT NULL THEN 'x' END AS shown
FROM b LEFT JOIN n USING (page_id, bubble_id) LEFT JOIN u USING (page_id, bubble_id) LEFT JOIN logs l ON l.id = u.log_id WHERE u.log_id IS NOT NULL OR (n.run IS NULL AND EXISTS (SELECT 1 FROM logs l WHERE l.page_id = b.page_id AND l.bubble_id = b.bubble_id))""",
    "logs",
)
def memory_used(spark, d):
    """J8."""
    l = view(spark, d, "logs")
    b = l.select("page_id", F.concat(F.lit("bubble_"), F.col("k") % 7).alias("bubble_id"), F.concat(F.lit(" LINE  "), F.col("k") % 50).alias("text"), "project_id")
    b = b.groupBy("page_id", "bubble_id").agg(F.min("text").alias("text"), F.min("project_id").alias("project_id"))
    return logs.memory_used(b, l, view(spark, d, "corrections")).select("page_id", "bubble_id", "log_id", "stale", F.get("entries.pl_shown", F.lit(0)).alias("shown"))


@query(
    """WITH e AS (SELECT *, CASE WHEN provider = 'gemini' THEN CAST(timezone('America/Los_Angeles', timezone('UTC', key_events.at)) AS DATE) ELSE CAST(key_events.at AS DATE) END AS day FROM key_events WHERE kind = 'success'), c AS (SELECT provider, key_id, model, day, count(*) AS requests FROM e GROUP BY ALL)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY key_id, model ORDER BY day DESC) <= 8""",
    "key_events",
)
def key_days(spark, d):
    """W6."""
    return logs.key_days(view(spark, d, "key_events"))


@query("SELECT event_id, count(*) OVER (PARTITION BY key_id, model ORDER BY key_events.at RANGE BETWEEN INTERVAL '59.999999 seconds' PRECEDING AND CURRENT ROW) AS in_minute FROM key_events WHERE kind = 'success'", "key_events")
def last_minute(spark, d):
    return logs.last_minute(view(spark, d, "key_events")).select("event_id", "in_minute")


@query(
    """WITH e AS (SELECT *, CASE WHEN provider = 'gemini' THEN CAST(timezone('America/Los_Angeles', timezone('UTC', key_events.at)) AS DATE) ELSE CAST(key_events.at AS DATE) END AS day, DATE '2024-01-30' AS now FROM key_events WHERE key_events.at <= TIMESTAMP '2024-01-30 12:00:00'),
r AS (SELECT x.*, (SELECT count(*) FROM e y WHERE y.provider = x.provider AND y.key_id = x.key_id AND y.model = x.model AND y.kind = 'success' AND y.day = x.day AND y.at <= x.at) AS so_far FROM e x WHERE kind <> 'success'),
server AS (SELECT provider, key_id, model, arg_max(limit_value, r.at) AS n FROM r WHERE limit_value IS NOT NULL AND (kind = 'server_counts' OR daily AND limit_value <> 0) GROUP BY ALL),
guess AS (SELECT provider, key_id, model, arg_max(greatest(1, so_far), r.at) AS n FROM r WHERE kind = 'limit' AND daily AND coalesce(limit_value, 0) = 0 GROUP BY ALL),
u AS (SELECT provider, key_id, model, count(*) FILTER (kind = 'success' AND day = now) AS today, count(*) FILTER (kind = 'success' AND day > now - 7) AS week, count(*) FILTER (kind = 'success' AND e.at > TIMESTAMP '2024-01-30 11:59:00') AS last_minute,
  arg_max(limit_value, e.at) FILTER (kind = 'limit' AND NOT daily AND coalesce(limit_value, 0) <> 0) AS limit_minute, arg_max(left_value, e.at) FILTER (kind = 'server_counts' AND left_value IS NOT NULL AND day = now) AS said,
  coalesce(bool_or(kind = 'limit' AND daily AND day = now), false) AS exhausted FROM e GROUP BY ALL)
SELECT u.* EXCLUDE (said), CAST(coalesce(s.n, g.n) AS INT) AS limit_day, CASE WHEN s.n IS NOT NULL THEN 'server' WHEN g.n IS NOT NULL THEN 'estimate' END AS limit_source,
CAST(CASE WHEN exhausted THEN 0 WHEN said IS NOT NULL THEN said WHEN coalesce(s.n, g.n, 0) <> 0 THEN greatest(0, coalesce(s.n, g.n) - today) END AS INT) AS "left"
FROM u LEFT JOIN server s USING (provider, key_id, model) LEFT JOIN guess g USING (provider, key_id, model)""",
    "key_events",
)
def key_usage(spark, d):
    """Limits of days and minutes, with and without numbers, and what servers say."""
    return logs.key_usage(view(spark, d, "key_events"), "2024-01-30 12:00:00")


# --- catalog


@query("SELECT folder, count(*) AS n_pages, sha1(string_agg(sha1, chr(10) ORDER BY sha1)) AS fingerprint FROM files GROUP BY folder", "files")
def chapter_fingerprint(spark, d):
    """A18."""
    return catalog.chapter_fingerprint(view(spark, d, "files"))


@query(
    "SELECT doc_id, row_number() OVER (PARTITION BY folder ORDER BY doc_id) AS position, CAST(sum(CAST(n <> t AS INT)) OVER (PARTITION BY folder) AS BIGINT) AS differs FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY doc_id) AS n, row_number() OVER (PARTITION BY folder ORDER BY mtime, doc_id) AS t FROM files)",
    "files",
)
def page_order(spark, d):
    """W4, T4."""
    return catalog.page_order(view(spark, d, "files")).select("doc_id", "position", "differs")


@query(
    """WITH s AS (SELECT folder AS chapter_id, sha1, min(doc_id * 31 % 97) AS position FROM files WHERE doc_id % 3 <> 0 GROUP BY ALL) SELECT f.doc_id AS id, row_number() OVER (PARTITION BY f.folder ORDER BY s.position NULLS LAST, f.doc_id) AS new_order
FROM files f LEFT JOIN s ON s.chapter_id = f.folder AND s.sha1 = f.sha1""",
    "files",
)
def repair_page_order(spark, d):
    """W5."""
    f = view(spark, d, "files")
    pages = f.select(F.col("folder").alias("chapter_id"), F.col("doc_id").alias("id"), F.col("doc_id").alias("order"), "sha1")
    source = f.where("doc_id % 3 <> 0").select(F.col("folder").alias("chapter_id"), "sha1", (F.col("doc_id") * 31 % 97).alias("position"))
    return catalog.repair_page_order(pages, source).select("id", "new_order")


@query(
    """WITH a AS (SELECT DISTINCT folder AS chapter, sha1 FROM files WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT folder, sha1 FROM files), s AS (SELECT chapter, folder, count(*) AS shared FROM a JOIN b USING (sha1) GROUP BY ALL),
r AS (SELECT *, (SELECT count(*) FROM a x WHERE x.chapter = s.chapter) AS pages, (SELECT count(*) FROM b x WHERE x.folder = s.folder) AS files FROM s)
SELECT chapter, folder, shared, pages, files FROM r QUALIFY rank() OVER (PARTITION BY chapter ORDER BY (shared = pages AND shared = files) DESC, shared DESC) = 1""",
    "files",
)
def match_source_folder(spark, d):
    """J13, O2."""
    f = view(spark, d, "files")
    return catalog.match_source_folder(f.where("doc_id % 2 = 0").select(F.col("folder").alias("chapter"), "sha1"), f).select("chapter", "folder", "shared", "pages", "files")


@query(
    """WITH RECURSIVE c AS (SELECT doc_id AS seq, sha1, lower(CASE WHEN doc_id % 7 = 0 THEN 'Taken' ELSE 'L' || (doc_id * 5 // 7) END) AS label, row_number() OVER (ORDER BY doc_id) AS n FROM files WHERE doc_id % 3 <> 0),
r AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS verdict, (SELECT list(DISTINCT sha1) FROM files WHERE doc_id % 3 = 0) AS prints, ['taken'] AS labels
UNION ALL SELECT n, seq, verdict, CASE WHEN verdict = 'new' THEN list_append(prints, sha1) ELSE prints END, CASE WHEN verdict = 'new' THEN list_append(labels, label) ELSE labels END
FROM (SELECT c.*, prints, labels, CASE WHEN list_contains(prints, sha1) THEN 'duplicate' WHEN list_contains(labels, label) THEN 'label_conflict' ELSE 'new' END AS verdict FROM r JOIN c ON c.n = r.n + 1))
SELECT seq, verdict FROM r WHERE n > 0""",
    "files",
)
def import_preview(spark, d):
    """Some labels are there, others are taken by candidates before."""
    label = F.when(F.col("doc_id") % 7 == 0, "Taken").otherwise(F.concat(F.lit("L"), F.floor(F.col("doc_id") * 5 / 7).cast("long")))
    f = view(spark, d, "files").withColumns({"fingerprint": F.col("sha1"), "label": label})
    there = f.where("doc_id % 3 = 0").select("fingerprint", F.lit("taken").alias("label"))
    return catalog.import_preview(f.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("seq"), "label", "fingerprint"), there).select("seq", "verdict")


@query("SELECT doc_id AS seq, folder || CASE WHEN n = 1 THEN '' ELSE ' (' || n || ')' END AS unique_label FROM (SELECT *, row_number() OVER (PARTITION BY lower(folder) ORDER BY doc_id) AS n FROM files)", "files")
def unique_label(spark, d):
    """W11."""
    return catalog.unique_label(view(spark, d, "files").select(F.col("doc_id").alias("seq"), F.col("folder").alias("label"))).select("seq", "unique_label")


@query("SELECT doc_id AS id, row_number() OVER (PARTITION BY folder ORDER BY doc_id % 10 DESC, doc_id) = 1 AS keep FROM files", "files")
def duplicate_chapters(spark, d):
    """W12."""
    f = view(spark, d, "files").select(F.col("doc_id").alias("id"), "folder", (F.col("doc_id") % 10).alias("processed"))
    return catalog.duplicate_chapters(f).select("id", "keep")


@query(
    """WITH c AS (SELECT folder, name, CASE WHEN doc_id % 11 = 0 THEN 'excluded' WHEN doc_id % 2 = 0 THEN 'processed' ELSE 'pending' END AS status FROM files WHERE doc_id % 5 <> 0),
l AS (SELECT folder, name, doc_id % 7 <> 0 AND right(folder, 1) <> '3' AS raw, doc_id % 3 = 0 AS processed FROM files WHERE doc_id % 4 <> 0 AND right(folder, 1) <> '5'),
dirs AS (SELECT DISTINCT folder FROM l WHERE raw), outputs AS (SELECT DISTINCT folder FROM l WHERE processed),
j AS (SELECT coalesce(c.folder, l.folder) AS chapter, coalesce(c.name, l.name) AS name, status, coalesce(raw, false) AS raw, coalesce(processed, false) AS processed FROM c FULL JOIN l ON c.folder = l.folder AND c.name = l.name)
SELECT chapter, name, 'add' AS action, CASE WHEN processed THEN 'processed' ELSE 'pending' END AS new_status FROM j WHERE status IS NULL AND raw
UNION ALL SELECT chapter, name, 'keep', NULL FROM j WHERE status IS NULL AND NOT raw
UNION ALL SELECT chapter, name, CASE WHEN chapter IN (SELECT folder FROM outputs) THEN 'warn' ELSE 'remove' END, NULL FROM j WHERE status IS NOT NULL AND chapter NOT IN (SELECT folder FROM dirs)
UNION ALL SELECT chapter, name, CASE WHEN status = 'excluded' THEN 'keep' WHEN NOT raw THEN 'warn' WHEN status = 'processed' AND NOT processed THEN 'to_pending' WHEN status = 'pending' AND processed THEN 'to_processed' ELSE 'keep' END,
  CASE WHEN status = 'processed' AND raw AND NOT processed THEN 'pending' WHEN status = 'pending' AND raw AND processed THEN 'processed' END FROM j WHERE status IS NOT NULL AND chapter IN (SELECT folder FROM dirs)""",
    "files",
)
def reconcile(spark, d):
    """Some chapters have no file left, some only outputs."""
    f = view(spark, d, "files").withColumnRenamed("folder", "chapter")
    status = F.when(F.col("doc_id") % 11 == 0, "excluded").when(F.col("doc_id") % 2 == 0, "processed").otherwise("pending")
    c = f.where("doc_id % 5 <> 0").select("chapter", "name", status.alias("status"))
    there = (F.col("doc_id") % 7 != 0) & (F.substring("chapter", -1, 1) != "3")
    listing = f.where("doc_id % 4 <> 0 and right(chapter, 1) <> '5'").select("chapter", "name", there.alias("raw"), (F.col("doc_id") % 3 == 0).alias("processed"))
    return catalog.reconcile(c, listing).select("chapter", "name", "action", "new_status")


@query(
    """SELECT p AS project_id, (SELECT count(DISTINCT folder) FROM files WHERE doc_id % 5 = p) AS chapters, (SELECT count(*) FROM files WHERE doc_id % 5 = p) AS pages, (SELECT count(*) FROM corrections c WHERE c.project_id = p) AS corrections, (SELECT count(*) FROM glossary g WHERE g.project_id = p) AS terms FROM range(5) t(p)""",
    "files", "corrections", "glossary",
)
def project_summary(spark, d):
    """A20."""
    f = view(spark, d, "files")
    chapters = f.select((F.col("doc_id") % 5).alias("project_id"), "folder").distinct().withColumn("id", F.xxhash64("folder", "project_id"))
    pages = f.select(F.xxhash64("folder", F.col("doc_id") % 5).alias("chapter_id"))
    projects = spark.range(5).select("id", F.concat(F.lit("p"), "id").alias("name"))
    return catalog.project_summary(projects, chapters, pages, view(spark, d, "corrections"), view(spark, d, "glossary")).select("project_id", "chapters", "pages", "corrections", "terms")


@query("SELECT DISTINCT sha1, 'new' AS found FROM files WHERE doc_id % 2 = 0 AND sha1 NOT IN (SELECT sha1 FROM files WHERE doc_id % 3 = 0) UNION ALL SELECT DISTINCT sha1, 'missing' FROM files WHERE doc_id % 3 = 0 AND sha1 NOT IN (SELECT sha1 FROM files WHERE doc_id % 2 = 0)", "files")
def new_and_missing(spark, d):
    """O1."""
    f = view(spark, d, "files")
    return catalog.new_and_missing(f.where("doc_id % 2 = 0").select("sha1"), f.where("doc_id % 3 = 0").select("sha1"), ["sha1"])


# --- boxes


@query(
    r"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}'']+')) AS word FROM documents), c AS (SELECT word, count(*) AS n FROM w GROUP BY word) SELECT word, round(log10(n * 1e9 / (SELECT sum(n) FROM c)), 6) AS zipf FROM c"""
)
def zipf_table(spark, d):
    """A25."""
    return ocr.zipf_table(spark.read.parquet(f"{d}/documents.parquet")).select("word", F.round("zipf", 6).alias("zipf"))


@query(
    r"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}'']+')) AS word FROM documents), c AS (SELECT word, count(*) AS n FROM w GROUP BY word), z AS (SELECT word, word AS known FROM c WHERE log10(n * 1e9 / (SELECT sum(n) FROM c)) >= 5),
t AS (SELECT page_id, pos, CASE WHEN pos % 5 = 0 THEN '?！' WHEN pos % 5 = 1 THEN '(' || text || '), sol 12' ELSE text || ' ' || left(text, 1) || ' sol' END AS text, score FROM boxes),
near AS (SELECT *, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS raw FROM t WHERE score < 0.85 AND score >= 0.70 AND NOT regexp_matches(text, '^[?!？！‽]{1,4}$')),
k AS (SELECT page_id, pos FROM (SELECT *, regexp_replace(lower(raw), '^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$', '', 'g') AS word FROM near) LEFT JOIN z USING (word) GROUP BY ALL HAVING 2 * count(known) >= count(*))
SELECT page_id, pos FROM t WHERE score >= 0.85 UNION ALL SELECT page_id, pos FROM t WHERE score < 0.85 AND score >= 0.70 AND regexp_matches(text, '^[?!？！‽]{1,4}$') UNION ALL SELECT page_id, pos FROM k""",
    "boxes",
)
def text_threshold(spark, d):
    """Words count as known by their frequency in the documents; some texts are marks, some have marks and numbers."""
    own = F.when(F.col("pos") % 5 == 0, "?！").when(F.col("pos") % 5 == 1, F.concat(F.lit("("), "text", F.lit("), sol 12"))).otherwise(F.concat("text", F.lit(" "), F.substring("text", 1, 1), F.lit(" sol")))
    t = view(spark, d, "boxes").select("page_id", "pos", own.alias("text"), "score", F.concat_ws("-", "page_id", "pos").alias("id"))
    zipf = ocr.zipf_table(spark.read.parquet(f"{d}/documents.parquet"))
    return ocr.text_threshold(t, zipf, known=5.0).select("page_id", "pos")


@query(r"SELECT page_id, pos FROM bubbles WHERE NOT (length(regexp_replace(trim(text), '^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$', '', 'g')) = 1 AND regexp_replace(trim(text), '^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$', '', 'g') NOT IN ('I', '?', '!'))", "bubbles")
def drop_noise(spark, d):
    """P3."""
    return ocr.drop_noise(view(spark, d, "bubbles")).select("page_id", "pos")


@query("SELECT page_id, pos FROM bubbles WHERE NOT regexp_matches(text, '(?i)license|www\\.')", "bubbles")
def ignore_rows(spark, d):
    """An invalid pattern is left out."""
    return ocr.ignore_rows(view(spark, d, "bubbles"), ["license", r"www\.", "("]).select("page_id", "pos")


@query("SELECT count(*) FILTER (regexp_matches(text, '(?i)license')) AS bubbles_removed, count(DISTINCT page_id) FILTER (regexp_matches(text, '(?i)license')) AS pages_changed FROM bubbles", "bubbles")
def purge_ignored(spark, d):
    """P6."""
    return ocr.purge_ignored(view(spark, d, "bubbles"), view(spark, d, "logs"), ["license"])[2].select("bubbles_removed", "pages_changed")


@query(
    """WITH p AS (SELECT a.page_id, a.pos AS first, b.pos AS second, floor(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0)) * floor(greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)) AS inter,
least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) AS small FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.pos < b.pos AND a.slice_id <> b.slice_id) SELECT page_id, first, second FROM p WHERE inter / small > 0.3""",
    "boxes",
)
def box_overlaps(spark, d):
    """F14, J11's candidates: any text."""
    return ocr.boundary_pairs(view(spark, d, "boxes"), ratio=-1.0).select("page_id", "first", "second")


@query()
def slice_boundary_dedup(spark, d):
    return ocr.slice_boundary_dedup(view(spark, d, "boxes")).select("page_id", "pos")


@query()
def vertical_streams(spark, d):
    """A26."""
    return ocr.vertical_streams(view(spark, d, "boxes").withColumn("id", F.col("pos")))


@query()
def build_text_lines(spark, d):
    """A27."""
    lines = ocr.build_text_lines(view(spark, d, "boxes").withColumn("id", F.col("pos").cast("string")))
    return lines.select("page_id", "line_no", "text", F.concat_ws(",", "word_ids").alias("words"), "stream", "angle")


@query()
def group_bubbles(spark, d):
    """A26 to A28, U8."""
    items = view(spark, d, "boxes").withColumn("id", F.col("pos").cast("string"))
    return ocr.group_bubbles(items, image_width=1000.0).select("page_id", "bubble_no", "text", "line_count", F.concat_ws(",", "word_ids").alias("words"))


@query()
def line_dedup(spark, d):
    """Items of a page that lie at about the same height are a line here."""
    items = view(spark, d, "boxes").withColumn("id", F.col("pos").cast("string"))
    lines = items.groupBy("page_id", F.floor(F.array_min(F.transform("box", lambda p: p[1])) / 40).alias("line_no")).agg(F.array_sort(F.collect_list("id")).alias("word_ids"))
    return ocr.line_dedup(items, lines).select("page_id", "id", "text", "trimmed")


@query("SELECT page_id, pos, row_number() OVER (PARTITION BY page_id ORDER BY (y1 + y2) / 2, (x1 + x2) / 2, CAST(pos AS VARCHAR)) AS order_no FROM boxes", "boxes")
def reading_order(spark, d):
    """T6, W10."""
    return ocr.reading_order(view(spark, d, "boxes").withColumn("bubble_id", F.col("pos").cast("string"))).select("page_id", "pos", "order_no")


@query()
def reading_order_rtl(spark, d):
    b = view(spark, d, "boxes").withColumn("bubble_id", F.col("pos").cast("string"))
    return ocr.reading_order(b, "rtl").select("page_id", "pos", "order_no")


def _bubbles_of_boxes(spark, d):
    return view(spark, d, "boxes").withColumns({"bubble_id": F.col("pos").cast("string"), "translation": F.upper("text"), "line_count": F.lit(1)}).select("page_id", "pos", "bubble_id", "text", "translation", "box", "line_count")


@query(
    """SELECT page_id, pos // 3 AS set_id, string_agg(text, ' ' ORDER BY (y1 + y2) / 2, (x1 + x2) / 2, CAST(pos AS VARCHAR)) AS text, string_agg(upper(text), ' ' ORDER BY (y1 + y2) / 2, (x1 + x2) / 2, CAST(pos AS VARCHAR)) AS translation, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS line_count FROM boxes GROUP BY ALL""",
    "boxes",
)
def merge_sets(spark, d):
    """All bubbles of a page, three and three."""
    b = _bubbles_of_boxes(spark, d)
    return ocr.merge_sets(b, b.select("page_id", "bubble_id", F.expr("pos div 3").cast("int").alias("set_id"))).select("page_id", "set_id", "text", "translation", "x1", "y1", "x2", "y2", "line_count")


@query(
    """WITH m AS (SELECT page_id, pos // 3 AS set_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM boxes WHERE text < 'm' GROUP BY ALL)
SELECT b.page_id, CAST(b.pos AS VARCHAR) AS bubble_id, m.set_id FROM boxes b JOIN m USING (page_id) WHERE b.text >= 'm' AND (b.x1 + b.x2) / 2 BETWEEN m.x1 AND m.x2 AND (b.y1 + b.y2) / 2 BETWEEN m.y1 AND m.y2""",
    "boxes",
)
def covered_bubbles(spark, d):
    """Bubbles of early words are merged, those of later ones are free."""
    b = _bubbles_of_boxes(spark, d)
    sets = b.where("text < 'm'").select("page_id", "bubble_id", F.expr("pos div 3").cast("int").alias("set_id"))
    return ocr.covered_bubbles(b, ocr.merge_sets(b, sets), sets)


@query(
    """SELECT g.page_id, g.pos FROM boxes g WHERE g.pos % 3 = 0 AND NOT EXISTS (SELECT 1 FROM boxes s WHERE s.page_id = g.page_id AND s.pos % 3 <> 0 AND
floor(greatest(least(g.x2, s.x2) - greatest(g.x1, s.x1), 0)) * floor(greatest(least(g.y2, s.y2) - greatest(g.y1, s.y1), 0)) / ((g.x2 - g.x1) * (g.y2 - g.y1)) > 0.6)""",
    "boxes",
)
def dropped_report(spark, d):
    """J18."""
    b = view(spark, d, "boxes").withColumn("id", F.col("pos"))
    return ocr.dropped_report(b.select("page_id", "id", "pos", "box"), b.where("pos % 3 <> 0").select("page_id", "id", "box"), "score").select("page_id", "pos")


@query(
    """WITH r AS (SELECT page_id, pos, score, CASE WHEN pos % 2 = 0 THEN x1 + 8 ELSE x2 END AS x2, x1, y1, y1 + 20 + pos * 6 AS y2 FROM boxes WHERE score < 0.85), a AS (SELECT page_id AS p, x1 AS ax1, y1 AS ay1, x2 AS ax2, y2 AS ay2 FROM boxes WHERE score >= 0.85),
f AS (SELECT *, CASE WHEN y2 - y1 >= 36 AND y2 - y1 >= 2.5 * greatest(x2 - x1, 1) THEN 'stacked' ELSE 'line' END AS kind FROM r WHERE NOT EXISTS (SELECT 1 FROM a WHERE p = page_id AND floor(greatest(least(x2, ax2) - greatest(x1, ax1), 0)) * floor(greatest(least(y2, ay2) - greatest(y1, ay1), 0)) / ((x2 - x1) * (y2 - y1)) > 0.5)),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id, kind ORDER BY score DESC, pos) AS rank FROM f WHERE kind = 'stacked' OR score >= 0.3) SELECT page_id, pos, kind, rank FROM k WHERE kind = 'stacked' OR rank <= 12""",
    "boxes",
)
def rescue_candidates(spark, d):
    """Stacked columns, and the best twelve lines of a page, which are the feature."""
    b = view(spark, d, "boxes").withColumn("id", F.col("pos"))
    shape = F.expr("array(array(x1, y1), array(if(pos % 2 = 0, x1 + 8, x2), y1), array(if(pos % 2 = 0, x1 + 8, x2), y1 + 20 + pos * 6), array(x1, y1 + 20 + pos * 6))")
    return ocr.rescue_candidates(b.where("score < 0.85").withColumn("box", shape), b.where("score >= 0.85")).select("page_id", "pos", "kind", "rank")


@query(
    """SELECT page_id, pos FROM boxes WHERE NOT (y2 + slice_id * 100 >= slice_id * 100 + 200 - 3 AND y1 + slice_id * 100 >= slice_id * 100 + 100)""",
    "boxes",
)
def cut_by_slice(spark, d):
    """P12."""
    b = view(spark, d, "boxes")
    s = F.col("slice_id") * 100.0
    slices = b.select("page_id", "slice_id").distinct().withColumns({"top": s, "bottom": s + 200, "left": F.lit(0.0), "next_top": s + 100})
    return ocr.cut_by_slice(b, slices).select("page_id", "pos")


@query(
    f"""WITH b AS (SELECT *, {KEY.format('text')} AS k FROM bubbles), o AS (SELECT *, row_number() OVER (PARTITION BY page_id, k ORDER BY pos) AS n FROM b WHERE trim(translation) <> ''), x AS (SELECT *, row_number() OVER (PARTITION BY page_id, k ORDER BY pos) AS n FROM b)
SELECT x.page_id, x.pos, o.pos AS old_pos, o.translation, CASE WHEN o.confirmed_translation = o.translation THEN o.confirmed_translation END AS confirmed_translation, CASE WHEN o.confirmed_translation = o.translation THEN o.confirmed_via END AS confirmed_via FROM x LEFT JOIN o ON o.page_id = x.page_id AND o.k = x.k AND o.n = x.n AND x.k <> ''""",
    "bubbles",
)
def carry_over(spark, d):
    """Pages read again, in upper case."""
    b = view(spark, d, "bubbles").withColumn("skip_reason", F.lit(None).cast("string"))
    return ocr.carry_over(b, b.select("page_id", "pos", F.upper("text").alias("text"))).select("page_id", "pos", "old_pos", "translation", "confirmed_translation", "confirmed_via")


@query(
    """WITH l AS (SELECT page_id, pos, CASE WHEN pos % 4 = 3 THEN '+' WHEN pos % 8 = 6 THEN 'll' ELSE text END AS text FROM bubbles), n AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (text = '+') OVER w AS s FROM l WINDOW w AS (PARTITION BY page_id)),
m AS (SELECT *, n >= 3 AND s > 0 AND s < n AND text IN ('+', 'll') AS m FROM n), b AS (SELECT *, lag(m) OVER (PARTITION BY page_id ORDER BY pos) AS before FROM m)
SELECT page_id, pos AS line_no, CASE WHEN m AND text = 'll' THEN '||' ELSE text END AS text, CAST(sum(CASE WHEN before IS NOT NULL AND (m OR before) THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS BIGINT) AS block FROM b""",
    "bubbles",
)
def split_operator_blocks(spark, d):
    """Lines with signs put between them."""
    mark = F.when(F.col("pos") % 4 == 3, "+").when(F.col("pos") % 8 == 6, "ll").otherwise(F.col("text"))
    lines = view(spark, d, "bubbles").select("page_id", F.lit("b").alias("bubble_id"), F.col("pos").alias("line_no"), mark.alias("text"))
    return ocr.split_operator_blocks(lines).select("page_id", "line_no", "text", "block")


@query()
def fixed_text(spark, d):
    """lines with words torn by a line break, against the words of the documents."""
    zipf = ocr.zipf_table(spark.read.parquet(f"{d}/documents.parquet"))
    b = view(spark, d, "bubbles").select("page_id", "pos", F.regexp_replace("text", r"\b([a-z]{3})([a-z]{3,})\b", "$1- $2").alias("text"))
    return repair.memory_text(b, zipf).select("page_id", "pos", "memory_text")


@query(
    r"""SELECT page_id, pos, CAST(2 * len(list_filter(regexp_split_to_array(translation, '\s+'), lambda w: contains(w, 'th'))) AS INT) AS n_changes FROM bubbles WHERE ai_translation <> translation AND trim(ai_translation) <> '' AND trim(translation) <> ''""",
    "bubbles",
)
def word_diffs(spark, d):
    """Drafts lack letters of some words, each of which is one word out and one in."""
    b = view(spark, d, "bubbles").where("ai_translation <> translation and trim(ai_translation) <> '' and trim(translation) <> ''")
    return b.select("page_id", "pos", F.size(F.filter(helpers.word_diff("ai_translation", "translation"), lambda x: x["type"] != "same")).alias("n_changes"))


@query()
def split_translations(spark, d):
    """An entry's final text dealt to its source's first sentence and the rest."""
    c = view(spark, d, "corrections")
    pieces = F.array(F.regexp_extract("source_text", r"^([^.]*\.)", 1), F.regexp_replace("source_text", r"^[^.]*\.", ""))
    found = splitting.split_translation(c.select("id", "final_translation", pieces.alias("pieces")), "final_translation", "pieces")
    return found.select("id", "method", F.concat_ws("|", "parts").alias("parts"))


# --- replay


@query(
    """WITH p AS (SELECT page_id, CAST(page_id % 5 AS INT) AS project_id, min(created_at) AS first_at FROM logs GROUP BY ALL), c AS (SELECT *, """ + "CASE WHEN " + KEY.format("source_text") + " = '' THEN source_text ELSE " + KEY.format("source_text") + """ END AS k FROM corrections)
SELECT p.page_id, max(c.id) AS id FROM p JOIN c ON c.project_id = p.project_id AND c.created_at < p.first_at AND c.page_id <> p.page_id GROUP BY p.page_id, p.project_id, c.k""",
    "logs", "corrections",
)
def eligible_examples(spark, d):
    """J10."""
    pages = view(spark, d, "logs").groupBy("page_id").agg(F.min("created_at").alias("first_at")).withColumn("project_id", (F.col("page_id") % 5).cast("int"))
    return replay.eligible_examples(pages, view(spark, d, "corrections"))


@query(
    """WITH c AS (SELECT *, (length(final_translation) - length(replace(final_translation, 'tion', ''))) // 4 + (length(final_translation) - length(replace(final_translation, 'er', ''))) // 2 AS size FROM corrections WHERE ai_translation IS NOT NULL AND ai_translation <> final_translation AND coalesce(kind, 'corrected') = 'corrected'
UNION ALL SELECT *, length(final_translation) FROM corrections WHERE ai_translation IS NULL AND coalesce(kind, 'corrected') = 'corrected')
SELECT id, rank, CAST(size AS INT) AS size FROM (SELECT id, size, row_number() OVER (PARTITION BY project_id ORDER BY size DESC, id DESC) AS rank FROM c WHERE size > 0) WHERE rank <= 3""",
    "corrections",
)
def biggest_corrections(spark, d):
    """The largest three of a project are the feature. Drafts differ from final texts by one letter at known places."""
    return replay.biggest_corrections(view(spark, d, "corrections")).select("id", "rank", "size")


@query()
def random_examples(spark, d):
    """Of all pairs of a cosine of .2 or more."""
    m = view(spark, d, "memory_vectors")
    pairs = memory.candidate_pairs(view(spark, d, "query_vectors"), m, 0.2)
    return replay.random_examples(pairs.join(m.select(F.col("id").alias("correction_id"), "final_translation"), "correction_id")).select("query_id", "rank", "correction_id")


@query(
    """WITH f AS (SELECT page_id, min(created_at) AS first_at FROM logs GROUP BY page_id), r AS (SELECT *, row_number() OVER (ORDER BY first_at, page_id) - 1 AS position, count(*) OVER () AS n FROM f)
SELECT DISTINCT page_id, position FROM r, range(20) t(i) WHERE position = CAST(round_even(i * (n - 1) / 19, 0) AS BIGINT)""",
    "logs",
)
def spread_sample(spark, d):
    """20 pages are the feature."""
    first = progress.first_translation(view(spark, d, "logs"))
    return replay.spread_sample(first, 20).select("page_id", "position")


@query()
def payloads(spark, d):
    """F13."""
    b = view(spark, d, "bubbles")
    g = glossary.match_glossary(b.select("page_id", "bubble_id", "project_id", "text"), view(spark, d, "glossary")).select("page_id", "bubble_id", F.col("matches").alias("glossary"))
    examples = b.where("pos % 3 = 0").select("page_id", "bubble_id", F.lit(1).alias("rank"), F.col("text").alias("en"), F.col("translation").alias("pl"), F.lit(0.7).alias("similarity"), F.lit("corrected").alias("kind"), F.col("ai_translation").alias("draft"))
    exact = b.where("pos % 3 = 1").select("page_id", "bubble_id", F.col("translation").alias("exact"))
    return replay.build_payload(b, examples, exact, g).select("page_id", F.length("payload").alias("chars"))


def _outputs(spark, d):
    c = view(spark, d, "corrections").where("ai_translation is not null")
    variants = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), o.alias("output")) for v, o in (
        ("A0", F.col("ai_translation")), ("A0b", F.col("ai_translation")), ("A1", F.replace("ai_translation", F.lit("ar"), F.lit("er"))), ("A2", F.col("final_translation")), ("A3", F.replace("ai_translation", F.lit("sion"), F.lit("tion"))))]))
    rows = c.select("*", variants.alias("_v"))
    return rows.select(
        "page_id", "bubble_id", "_v.variant", "_v.output", F.col("final_translation").alias("final"), F.col("ai_translation").alias("ai_first"), F.col("id").alias("seq"),
        F.lit(False).alias("short"), F.lit(None).cast("string").alias("confirmed_via"), ((F.col("id") % 100) / 100).alias("nearest"),
    )


@query()
def replay_scores(spark, d):
    """A21, U9, U2."""
    return replay.mean_scores(replay.replay_scores(_outputs(spark, d)))


@query()
def paired_statistics(spark, d):
    """Means, intervals and signed-rank tests."""
    diffs = replay.differences(replay.replay_scores(_outputs(spark, d)))
    return replay.bootstrap(diffs).join(replay.wilcoxon(diffs).drop("n"), replay.KEYS, "left")


@query("SELECT event_type AS variant, count(*) AS requests, avg(length(props)) AS mean_chars FROM events WHERE user_id % 3 <> 0 AND event_id % 2 = 0 GROUP BY event_type")
def request_stats(spark, d):
    """A23."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return replay.request_stats(e.select(F.col("event_type").alias("variant"), (F.col("user_id") % 3 != 0).alias("ok"), (F.col("event_id") % 2 != 0).alias("skipped"), F.length("props").alias("payload_chars")))


# --- batch twins of the streams


@query("SELECT provider, key_id, model, CAST(CASE WHEN provider = 'gemini' THEN timezone('America/Los_Angeles', timezone('UTC', key_events.at)) ELSE key_events.at END AS DATE) AS day, count(*) AS requests FROM key_events WHERE kind = 'success' GROUP BY ALL", "key_events")
def key_usage_by_day(spark, d):
    """ST2: quota days as tumbling windows."""
    return jobs.key_usage_by_day(view(spark, d, "key_events")).select("provider", "key_id", "model", F.to_date("window.start").alias("day"), "requests")


@query("SELECT coalesce(key_label, 'unknown') AS key_label, coalesce(model_used, 'unknown') AS model, variant, CAST(floor(epoch(created_at) / 3600) AS BIGINT) * 3600 AS start, count(*) AS requests FROM logs GROUP BY ALL", "logs")
def translation_stats(spark, d):
    """ST4."""
    return jobs.translation_stats(view(spark, d, "logs")).select("key_label", "model", "variant", secs("window.start").alias("start"), "requests")


@query(
    """WITH o AS (SELECT page_id, op, bubble, manual_ops.at AS t, CASE WHEN manual_ops.at - lag(manual_ops.at) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM manual_ops WHERE op = 'layout' WINDOW w AS (PARTITION BY page_id, op, bubble ORDER BY manual_ops.at)),
s AS (SELECT *, sum(new) OVER (PARTITION BY page_id, op, bubble ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT page_id, op, bubble, CAST(floor(epoch(min(t))) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY page_id, op, bubble, k""",
    "manual_ops",
)
def layout_sessions(spark, d):
    """ST3."""
    return jobs.layout_sessions(view(spark, d, "manual_ops"), gap="6 hours").select("page_id", "op", "bubble", secs("session_window.start").alias("start"), "n")


@query("SELECT page_id, pos, x1 + (x2 - x1) / 2 AS cx, y1 + (y2 - y1) / 2 AS cy, (x2 - x1) * (y2 - y1) AS area FROM boxes", "boxes")
def box_geometry(spark, d):
    """F14."""
    b = geo.bbox(F.col("box"))
    return view(spark, d, "boxes").select("page_id", "pos", geo.center(b)["x"].alias("cx"), geo.center(b)["y"].alias("cy"), geo.area(b).alias("area"))
