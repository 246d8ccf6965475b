"""Sources and sinks. Schemas are fixed; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tmspark.functions import text

BOX = "array<array<double>>"
#: ``layout``, ``merged_from`` and ``interior_box`` are kept as they are, whatever they hold.
BUBBLE = (
    f"bubble_id string, text string, text_raw string, translation string, ai_translation string, box {BOX}, line_count int, avg_score double, "
    "skip boolean, skip_reason string, confirmed_translation string, confirmed_at string, confirmed_via string, "
    "bulk_edits array<struct<at:string,find:string,replace:string>>, layout variant, merged_from variant, interior_box variant, missed_text boolean, refined boolean"
)
ITEM = f"id string, text string, score double, slice_id int, box {BOX}, rescued boolean"
LINE = f"line_id string, bubble_id string, text string, score double, box {BOX}, angle double, word_ids array<string>"
OP = "op string, at string, last_at string, n long, bubble string, detail map<string,string>"
_fields = lambda s: ",".join(f"{f.split()[0]}:{f.split(None, 1)[1]}" for f in s.split(", "))
_struct = lambda s: f"array<struct<{_fields(s)}>>"
DEBUG = f"at string, threshold double, slices array<array<long>>, rejected {_struct(f'text string, score double, box {BOX}')}, dropped {_struct(f'text string, score double, box {BOX}, why string')}"
META = "layout_checked_at string, updated_at string, bubble_order string, pending_translation boolean, detect_rotation boolean"
PAGE = f"items {_struct(ITEM)}, lines {_struct(LINE)}, bubbles {_struct(BUBBLE)}, manual_ops {_struct(OP)}, ocr_debug struct<{_fields(DEBUG)}>, {META}"
TABLES = {
    "projects": "id int, name string, source_lang string, target_lang string, status string, created_at timestamp",
    "chapters": "id int, project_id int, number string, title string",
    "pages": "id int, chapter_id int, file_name string, `order` int, status string",
    "corrections": "id long, project_id int, source_text string, ai_translation string, final_translation string, embedding array<float>, "
    "reuse_count int, created_at timestamp, kind string, edited_at timestamp, final_before_edit string, page_id long, bubble_id string",
    "translation_logs": "id long, page_id long, bubble_id string, variant string, source_text string, output_text string, matched_correction_id long, "
    "similarity_score double, threshold_used double, model_used string, key_label string, glossary_terms_used string, hints_json string, "
    "memory_lane string, injection_json string, run_id string, created_at timestamp",
    "glossary_terms": "id int, project_id int, source_term string, target_term string, auto_detected boolean, occurrences int, origin string, "
    "proposed_term string, created_at timestamp",
}
REPLAY = (
    "page_id long, variant string, bubble_id string, seq long, short boolean, source string, final string, ai_first string, confirmed_via string, "
    "output string, nearest double, ok boolean"
)
#: File extensions of page images.
IMAGES = ("jpg", "jpeg", "png", "webp", "jfif", "bmp", "tif", "tiff")


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in TABLES.items()}


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int = 16) -> DataFrame:
    """A table of a database, read in ranges of a numeric column side by side."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts)


def read_page_json(spark: SparkSession, path: str, folders: bool = False) -> dict[str, DataFrame]:
    """Page documents as flat tables: items, lines, bubbles (with pos), manual_ops (with seq), debug (what steps dropped),
    rejected and slices (with pos), meta, and ``unreadable``: the documents that aren't JSON of this form, with their text.

    Documents are files ``<chapter>/<page>.json``, or with ``folders`` what ``write_page_json`` writes; an unreadable one has
    no rows in the other tables."""
    schema, name = f"{PAGE}, _broken string", F.col("_metadata.file_path")
    if folders:
        docs = spark.read.schema(f"{schema}, chapter string, page string").option("basePath", path).json(path, multiLine=True, columnNameOfCorruptRecord="_broken")
    else:
        docs = spark.read.schema(schema).json(path, multiLine=True, columnNameOfCorruptRecord="_broken").withColumns(
            {"chapter": F.element_at(F.split(name, "/"), -2), "page": F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.json$", "")}
        )
    # Spark doesn't read the text of broken documents alone, so another column is asked for too.
    broken = docs.select("chapter", "page", name.alias("path"), "_broken", "bubble_order").where("_broken is not null and length(coalesce(bubble_order, '')) >= 0")
    docs = docs.where("_broken is null")
    flat = lambda c, at: docs.select("chapter", "page", F.posexplode(c).alias(at, "_x")).select("chapter", "page", at, "_x.*")
    return {
        "items": flat("items", "pos"), "lines": flat("lines", "pos"), "bubbles": flat("bubbles", "pos"), "manual_ops": flat("manual_ops", "seq"),
        "debug": flat("ocr_debug.dropped", "pos"), "rejected": flat("ocr_debug.rejected", "pos"),
        "slices": docs.select("chapter", "page", F.posexplode("ocr_debug.slices").alias("pos", "_x")).select("chapter", "page", "pos", F.get("_x", F.lit(0)).alias("top"), F.get("_x", F.lit(1)).alias("bottom")),
        "meta": docs.select("chapter", "page", text.parse_utc(F.col("ocr_debug.at")).alias("ocr_at"), F.col("ocr_debug.threshold").alias("threshold"), *[f.split()[0] for f in META.split(", ")]),
        "unreadable": broken.select("chapter", "page", "path", F.col("_broken").alias("content")),
    }


def _ordered(table: DataFrame, at: str, name: str) -> DataFrame:
    """(chapter, page, name): the rows of each page as one array in order, without the columns that place them."""
    fields = [c for c in table.columns if c not in ("chapter", "page", at)]
    rows = F.array_sort(F.collect_list(F.struct(at, F.struct(*fields).alias("r"))), lambda a, b: F.when(a[at] < b[at], -1).when(a[at] > b[at], 1).otherwise(0))
    return table.groupBy("chapter", "page").agg(F.transform(rows, lambda x: x["r"]).alias(name))


def write_page_json(
    bubbles: DataFrame, path: str, items: DataFrame | None = None, lines: DataFrame | None = None, manual_ops: DataFrame | None = None,
    debug: DataFrame | None = None, rejected: DataFrame | None = None, slices: DataFrame | None = None, meta: DataFrame | None = None,
) -> None:
    """One document a page, in ``<path>/chapter=<chapter>/page=<page>/``, from the tables that ``read_page_json`` gives: its
    bubbles in order, and what else is given. Drafts start as the translation, skipped bubbles have none. Columns of a
    bubble that aren't known are written too. A page that is in any of the tables has its document."""
    translation = F.when(F.coalesce("skip", F.lit(False)), "").otherwise(F.coalesce("translation", F.lit("")))
    rows = bubbles.withColumns({"translation": translation, "ai_translation": F.when(F.coalesce("skip", F.lit(False)), "").otherwise(F.coalesce("ai_translation", translation))})
    pages = _ordered(rows, "pos", "bubbles")
    for name, table, at in (("items", items, "pos"), ("lines", lines, "pos"), ("manual_ops", manual_ops, "seq"), ("_dropped", debug, "pos"), ("_rejected", rejected, "pos")):
        if table is not None:
            pages = pages.join(_ordered(table, at, name), ["chapter", "page"], "full")
    if slices is not None:
        one = _ordered(slices.select("chapter", "page", "pos", F.array("top", "bottom").alias("ends")), "pos", "_slices")
        pages = pages.join(one.withColumn("_slices", F.transform("_slices", lambda x: x["ends"])), ["chapter", "page"], "full")
    if meta is not None:
        pages = pages.join(meta, ["chapter", "page"], "full")
    there = set(pages.columns)
    parts = {"at": F.date_format("ocr_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'") if "ocr_at" in there else None} | {
        name: F.col(column) if column in there else None for name, column in (("threshold", "threshold"), ("slices", "_slices"), ("rejected", "_rejected"), ("dropped", "_dropped"))
    }
    parts = {name: column for name, column in parts.items() if column is not None}
    if parts:
        some = text.any_of([column.isNotNull() for column in parts.values()])
        pages = pages.withColumn("ocr_debug", F.when(some, F.struct(*[column.alias(name) for name, column in parts.items()])))
    gone = [c for c in ("ocr_at", "threshold", "_slices", "_rejected", "_dropped") if c in there]
    pages.drop(*gone).write.mode("overwrite").partitionBy("chapter", "page").json(path)


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def export_logs(logs: DataFrame, path: str) -> None:
    """Logs in order of their time."""
    logs.orderBy("created_at", "id").write.mode("overwrite").json(path)


def read_replay(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPLAY).json(path)


def append_replay(rows: DataFrame, done: DataFrame, path: str) -> None:
    """Appends the rows of pages and variants that aren't done yet, so a broken run goes on where it stopped."""
    todo = rows.join(done.where("ok").select("page_id", "variant").distinct(), ["page_id", "variant"], "left_anti")
    todo.write.mode("append").json(path)


def write_metrics(pages: DataFrame, summary: DataFrame, path: str) -> None:
    pages.write.mode("overwrite").option("header", True).csv(f"{path}/pages")
    summary.write.mode("overwrite").json(f"{path}/summary")


def read_chapter_files(spark: SparkSession, root: str) -> DataFrame:
    """Image files below a folder: folder, name, mtime, sha1. Digests are made where the files are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    parts = F.split("path", "/")
    rows = files.select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), F.col("modificationTime").alias("mtime"), F.sha1("content").alias("sha1"))
    return rows.where(F.lower(F.regexp_extract("name", r"\.(\w+)$", 1)).isin(*IMAGES))


def skipped_files(spark: SparkSession, root: str) -> DataFrame:
    """Files of other kinds: how many of each extension a folder has."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    rows = files.select(F.element_at(F.split("path", "/"), -2).alias("folder"), F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("extension"))
    return rows.where(~F.col("extension").isin(*IMAGES)).groupBy("folder", "extension").agg(F.count(F.lit(1)).alias("files"))


def read_app_logs(spark: SparkSession, path: str, errors_only: bool = False) -> DataFrame:
    """Lines ``<date> <time> <level> <message>`` of text logs; a line of another form is part of a message."""
    pattern = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)\S*\s+\[?(DEBUG|INFO|WARNING|ERROR|CRITICAL)\]?\s*:?\s*(.*)$"
    rows = spark.read.text(path).select(
        text.parse_utc(F.nullif(F.regexp_extract("value", pattern, 1), F.lit(""))).alias("ts"), F.nullif(F.regexp_extract("value", pattern, 2), F.lit("")).alias("level"),
        F.when(F.col("value").rlike(pattern), F.regexp_extract("value", pattern, 3)).otherwise(F.col("value")).alias("message"),
    )
    return rows.where(F.col("level").isin("ERROR", "CRITICAL")) if errors_only else rows


def last_lines(rows: DataFrame, n: int = 200) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last("ts")).limit(n)
