"""Chapters and files: labels, order, fingerprints, imports, reconciling with what is on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tmspark.cluster import cut_lineage
from tmspark.functions import text


def chapter_fingerprint(files: DataFrame) -> DataFrame:
    """Each folder: page count and a digest of its pages' digests, whatever their names and order."""
    return files.groupBy("folder").agg(F.count(F.lit(1)).alias("n_pages"), F.sha1(F.array_join(F.sort_array(F.collect_list("sha1")), "\n")).alias("fingerprint"))


def clean_sequence(files: DataFrame) -> DataFrame:
    """Each folder: whether its two or more names differ only in their last number, and all those numbers differ."""
    low = F.lower("name")
    rows = files.select("folder", F.regexp_extract(low, r"(\d+)\D*$", 1).alias("_d"), F.regexp_replace(low, r"\d+(\D*)$", "#$1").alias("_k"))
    return rows.groupBy("folder").agg(
        ((F.count(F.lit(1)) >= 2) & (F.count_if(F.col("_d") == "") == 0) & (F.count_distinct("_k") == 1)
         & (F.count_distinct(F.expr("try_cast(_d as decimal(38,0))")) == F.count(F.lit(1)))).alias("clean")
    )


def page_order(files: DataFrame, mode: str = "auto") -> DataFrame:
    """Each file's position in its folder: by name where names are a clean sequence (or mode ``name``), else by time;
    ``differs`` counts the folder's positions on which the two orders disagree."""
    name = Window.partitionBy("folder").orderBy(text.natural_sort_key(F.col("name")), "name")
    time = Window.partitionBy("folder").orderBy("mtime", text.natural_sort_key(F.col("name")), "name")
    rows = files.join(clean_sequence(files), "folder").withColumns({"_n": F.row_number().over(name), "_t": F.row_number().over(time)})
    by_name = {"auto": F.col("clean"), "name": F.lit(True), "time": F.lit(False)}[mode]
    differs = F.sum((F.col("_n") != F.col("_t")).cast("int")).over(Window.partitionBy("folder"))
    return rows.withColumns({"position": F.when(by_name, F.col("_n")).otherwise(F.col("_t")), "differs": differs}).drop("_n", "_t")


def repair_page_order(pages: DataFrame, source: DataFrame) -> DataFrame:
    """Pages (chapter_id, id, order, sha1) in the order of their source (chapter_id, sha1, position); those without one
    last, in their old order; with the new file name."""
    s = source.groupBy("chapter_id", "sha1").agg(F.min("position").alias("_p"))
    order = Window.partitionBy("chapter_id").orderBy(F.asc_nulls_last("_p"), "order", "id")
    out = pages.join(s, ["chapter_id", "sha1"], "left").withColumn("new_order", F.row_number().over(order)).drop("_p")
    return out.withColumn("new_name", F.format_string("page_%03d", "new_order"))


def match_source_folder(raw: DataFrame, source: DataFrame) -> DataFrame:
    """Each chapter's (chapter, sha1) best source folders (folder, sha1): most shared digests, a full match first; ties are
    all listed; ``sure`` at nine in ten."""
    a, b = raw.select("chapter", "sha1").distinct(), source.select("folder", "sha1").distinct()
    shared = a.join(b, "sha1").groupBy("chapter", "folder").agg(F.count(F.lit(1)).alias("shared"))
    rows = shared.join(a.groupBy("chapter").agg(F.count(F.lit(1)).alias("pages")), "chapter").join(b.groupBy("folder").agg(F.count(F.lit(1)).alias("files")), "folder")
    full = (F.col("shared") == F.col("pages")) & (F.col("shared") == F.col("files"))
    rank = F.rank().over(Window.partitionBy("chapter").orderBy(F.desc(full), F.desc("shared")))
    return rows.withColumn("exact", full).withColumn("_r", rank).where("_r = 1").drop("_r").withColumn("sure", F.col("shared") >= 0.9 * F.col("pages"))


def import_preview(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates (seq, label, fingerprint) in their order: duplicate (content that is there, or that an earlier new one
    has), label_conflict (a label that is there or that an earlier new one took, whatever its case) or new.

    Only new ones take their label and content. So in each round those are new that come first of all open ones with
    their content and first with their label, and those that share either with one of these are settled; rounds go on
    until none is open, which takes few, as a chain of refusals must link every one of them. Rows without a fingerprint
    are like no other."""
    prints, labels = existing.select(F.col("fingerprint").alias("_p")).distinct(), existing.select(F.lower("label").alias("_l")).distinct()
    rows = candidates.withColumns({"_p": F.coalesce("fingerprint", F.concat(F.lit("\u0000"), F.col("seq").cast("string"))), "_l": F.lower("label")})
    left = cut_lineage(rows.select("seq", "_p", "_l").join(prints, "_p", "left_anti").join(labels, "_l", "left_anti"))
    taken = left.limit(0)
    while not left.isEmpty():
        first = [F.min("seq").over(Window.partitionBy(c)) for c in ("_p", "_l")]
        new = cut_lineage(left.withColumns({"_a": first[0], "_b": first[1]}).where("seq = _a and seq = _b").select(left.columns))
        left = cut_lineage(left.join(new.select("_p"), "_p", "left_anti").join(new.select("_l"), "_l", "left_anti"))
        taken = taken.unionByName(new)
    same = prints.withColumn("_at", F.lit(None).cast("long")).unionByName(taken.select("_p", F.col("seq").cast("long").alias("_at")))
    out = rows.join(taken.select("seq", F.lit(True).alias("_new")), "seq", "left").join(same.groupBy("_p").agg(F.bool_or(F.col("_at").isNull()).alias("_there"), F.min("_at").alias("_at")), "_p", "left")
    verdict = F.when(F.col("_new"), "new").when(F.col("_there") | (F.col("_at") < F.col("seq")), "duplicate").otherwise("label_conflict")
    return out.withColumn("verdict", verdict).drop("_p", "_l", "_new", "_there", "_at")


def unique_label(rows: DataFrame) -> DataFrame:
    """Labels (seq, label) made unique whatever the case: the first stays, the others get (2), (3); names that are taken
    as they stand are passed over."""
    low = F.lower("label")
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(low).orderBy("seq")))
    taken = rows.select(F.regexp_extract(low, r"^(.*) \((\d+)\)$", 1).alias("_base"), F.expr(r"try_cast(regexp_extract(lower(label), '^(.*) \\((\\d+)\\)$', 2) as int)").alias("_k"))
    held = taken.where("_k is not null").groupBy("_base").agg(F.collect_set("_k").alias("_held"))
    out = ranked.join(held, F.lower(ranked["label"]) == held["_base"], "left").withColumn("_held", F.coalesce("_held", F.array().cast("array<int>")))
    free = F.filter(F.sequence(F.lit(2), F.col("_n") + F.size("_held") + 1), lambda k: ~F.array_contains("_held", k))
    return out.withColumn("unique_label", F.when(F.col("_n") == 1, F.col("label")).otherwise(F.concat("label", F.lit(" ("), F.element_at(free, F.greatest(F.col("_n") - 1, F.lit(1))), F.lit(")")))).drop("_n", "_base", "_held")


def duplicate_chapters(rows: DataFrame) -> DataFrame:
    """Chapters (id, folder, processed) of one source folder: the one with most processed pages, then the lowest id, stays."""
    order = Window.partitionBy("folder").orderBy(F.desc("processed"), "id")
    return rows.withColumn("keep", F.row_number().over(order) == 1)


def reconcile(catalog: DataFrame, listing: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """What to do about each page (``by``, such as a project, chapter, name), from the catalog (with status) and the disk
    (raw, processed): add, remove, to_pending, to_processed, warn or keep. ``new_status`` is what an added or mended page
    gets.

    A page whose file is missing in a chapter that is there is only warned of. The pages of a chapter that is gone are
    removed, unless any of its output is left (warn) or nothing at all is on the disk, which might be offline (keep)."""
    keys = list(by)
    shown = listing.groupBy(*keys, "chapter").agg(F.count_if("raw").alias("_seen"), F.count_if("processed").alias("_left"))
    every = listing.groupBy(*keys).agg(F.count_if("raw").alias("_any"))
    both = catalog.join(listing, [*keys, "chapter", "name"], "full_outer").join(shown, [*keys, "chapter"], "left")
    both = both.join(every, keys, "left") if keys else both.crossJoin(F.broadcast(every))
    raw, processed = F.coalesce("raw", F.lit(False)), F.coalesce("processed", F.lit(False))
    gone = F.coalesce("_seen", F.lit(0)) == 0
    action = (
        F.when(F.col("status").isNull(), F.when(raw, "add").otherwise("keep"))
        .when(gone & (F.coalesce("_any", F.lit(0)) == 0), "keep")
        .when(gone, F.when(F.coalesce("_left", F.lit(0)) > 0, "warn").otherwise("remove"))
        .when(F.col("status") == "excluded", "keep")
        .when(~raw, "warn")
        .when((F.col("status") == "processed") & ~processed, "to_pending")
        .when(F.col("status").isin("pending", "failed") & processed, "to_processed")
        .otherwise("keep")
    )
    out = both.select(*keys, "chapter", "name", "status", raw.alias("raw"), processed.alias("processed"), action.alias("action"))
    ready = F.when(F.col("processed"), "processed").otherwise("pending")
    return out.withColumn("new_status", F.when(F.col("action").isin("add", "to_pending", "to_processed"), ready))


def project_summary(projects: DataFrame, chapters: DataFrame, pages: DataFrame, corrections: DataFrame, terms: DataFrame) -> DataFrame:
    """Counts of chapters, pages, entries and terms of each project."""
    paged = pages.join(chapters.select(F.col("id").alias("chapter_id"), "project_id"), "chapter_id")
    out = projects.select(F.col("id").alias("project_id"), "name")
    for name, rows in (("chapters", chapters), ("pages", paged), ("corrections", corrections), ("terms", terms)):
        out = out.join(rows.groupBy("project_id").agg(F.count(F.lit(1)).alias(name)), "project_id", "left")
    return out.na.fill(0, ["chapters", "pages", "corrections", "terms"])


def new_and_missing(disk: DataFrame, catalog: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only the disk has (new) or only the catalog has (missing)."""
    new = disk.select(*keys).distinct().join(catalog, keys, "left_anti").withColumn("found", F.lit("new"))
    return new.unionByName(catalog.select(*keys).distinct().join(disk, keys, "left_anti").withColumn("found", F.lit("missing")))


def page_filter(pages: DataFrame, hidden_groups: list[str], q: str | None = None) -> DataFrame:
    rows = pages.where(~F.col("stage").isin(hidden_groups)) if hidden_groups else pages
    return rows.where(F.lower("file_name").contains(q.lower())) if q else rows


def chapter_sort(chapters: DataFrame, by: str = "number", descending: bool | None = None) -> DataFrame:
    """Chapters (id, title, and for some orders done_score, reviewed_pages, last_activity) by number, progress, reviewed,
    updated or name, each in its own direction unless one is given; ties by number."""
    number = text.chapter_sort_key(F.col("title"))
    sorts = {
        "number": (lambda: number, False), "progress": (lambda: F.col("done_score"), True), "reviewed": (lambda: F.col("reviewed_pages"), True),
        "updated": (lambda: F.coalesce("last_activity", F.lit(0).cast("timestamp")), True), "name": (lambda: text.natural_sort_key(F.col("title")), False),
    }
    column, own = sorts[by]
    down = own if descending is None else descending
    return chapters.orderBy(column().desc() if down else column().asc(), number, "id")
