"""Pages and projects: review state, stages, progress, human effort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tmspark.functions import helpers, text

#: Stages in order with their weights, and the groups of manual operations.
STAGE_WEIGHT = {"ocr": 1, "partial": 2, "translated": 3, "reviewed": 4, "checked": 5, "exported": 5}
OP_GROUPS = {
    "bubbles": "merge split move_lines add_bubble add_bubble_manual delete_bubble skip unskip reorder".split(),
    "ocr_text": "reocr_bubble reocr_undo edit_source reocr_page".split(),
    "translation": ["retranslate_bubble"],
    "cleaning": "cleanup_add cleanup_undo cleanup_clear erase_off erase_on".split(),
    "lettering": "layout layout_reset layout_bulk".split(),
}
GROUPS = [*OP_GROUPS, "other"]


def op_group(op):
    out = F.lit("other")
    for group, names in OP_GROUPS.items():
        out = F.when(op.isin(names), group).otherwise(out)
    return out


def page_stage(pages: DataFrame, bubbles: DataFrame) -> DataFrame:
    """Each page: counts of bubbles that aren't skipped, and its stage. A page with nothing to do is reviewed."""
    todo = ~F.coalesce("skip", F.lit(False))
    filled = F.trim(F.coalesce("translation", F.lit(""))) != ""
    seen = text.reviewed(F.col("translation"), F.col("ai_translation"), F.col("confirmed_translation"))
    counts = bubbles.groupBy("page_id").agg(
        F.count_if(todo).alias("bubbles"), F.count_if(todo & filled).alias("translated"), F.count_if(todo & seen).alias("reviewed"),
        F.count_if(todo & seen & (F.coalesce("confirmed_via", F.lit("")) == "page")).alias("page_accepted"),
    )
    stage = (
        F.when(F.col("reviewed") == F.col("bubbles"), F.when(F.col("layout_checked_at").isNotNull(), "checked").otherwise("reviewed"))
        .when(F.col("translated") == 0, "ocr").when(F.col("translated") < F.col("bubbles"), "partial").otherwise("translated")
    )
    return pages.join(counts, "page_id", "left").na.fill(0, ["bubbles", "translated", "reviewed", "page_accepted"]).withColumn("stage", stage)


#: Stages of pages that were read, and those whose text is reviewed.
DONE_STAGES = list(STAGE_WEIGHT)
REVIEWED_STAGES = ["reviewed", "checked", "exported"]


def page_progress(stages: DataFrame, exports: DataFrame) -> DataFrame:
    """Adds export (current or outdated, null for none) and ``shown_stage``: exported for finished pages whose export is
    current. A page that isn't processed has its status as its stage, and no export."""
    last = exports.groupBy("page_id").agg(F.max("at").alias("exported_at"))
    ready = F.coalesce("status", F.lit("processed")) == "processed"
    export = F.when(~ready | F.col("exported_at").isNull(), None).when(F.col("exported_at") >= F.coalesce("updated_at", F.col("exported_at")), "current").otherwise("outdated")
    done = F.col("stage").isin("reviewed", "checked") & (F.col("export") == "current")
    rows = stages.join(last, "page_id", "left").withColumn("export", export).withColumn("stage", F.when(ready, F.col("stage")).otherwise(F.col("status")))
    return rows.withColumn("shown_stage", F.when(F.coalesce(done, F.lit(False)), "exported").otherwise(F.col("stage")))


def project_progress(progress: DataFrame) -> DataFrame:
    """Counts of a project's pages by stage (``other``: not read yet, by whatever status), how many are processed, how many
    have their text reviewed, the weighted score (0 to 1), and the last activity. Excluded pages don't count.

    exported_checked are exported pages that were fully reviewed; exported_draft those whose export is current although
    their text isn't reviewed."""
    rows = progress.where(F.coalesce("status", F.lit("")) != "excluded")
    shown, full = F.col("shown_stage"), F.col("stage")
    draft = (F.col("export") == "current") & ~shown.isin(REVIEWED_STAGES)
    active = F.when(full.isin(DONE_STAGES), F.col("updated_at"))
    out = rows.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(shown == s).alias(s) for s in STAGE_WEIGHT], F.count_if(~shown.isin(DONE_STAGES)).alias("other"),
        F.count_if(shown.isin(DONE_STAGES)).alias("processed"), F.count_if(shown.isin(REVIEWED_STAGES)).alias("text_reviewed"),
        F.count_if((shown == "exported") & (full == "checked")).alias("exported_checked"),
        F.count_if(draft).alias("exported_draft"), F.max(active).alias("last_activity"),
    )
    weighted = sum((F.col(s) * w for s, w in STAGE_WEIGHT.items()), F.lit(0))
    return out.withColumn("done_score", weighted / (5 * F.col("total")))


def stage_groups(counts: DataFrame, track_exported: bool = False) -> DataFrame:
    """Rows of ``project_progress`` with their stages as shown in groups: unless exports are tracked, exported pages are
    folded back into reviewed, or checked where they were fully reviewed. ``reviewed_pages``: pages whose text is."""
    done = F.col("reviewed") + F.col("checked") + F.col("exported")
    if track_exported:
        return counts.withColumn("reviewed_pages", done)
    return counts.withColumns(
        {
            "reviewed": F.col("reviewed") + F.col("exported") - F.col("exported_checked"), "checked": F.col("checked") + F.col("exported_checked"),
            "exported": F.lit(0).cast("long"), "reviewed_pages": done,
        }
    )


def project_sort(projects: DataFrame, by: str = "updated", descending: bool | None = None) -> DataFrame:
    """Projects (project_id, name, created_at, last_activity, done_score) by updated, progress, created or name, each in
    its own direction unless one is given; never active ones count as oldest."""
    sorts = {
        "updated": ([F.coalesce("last_activity", F.lit(0).cast("timestamp"))], True), "progress": ([F.col("done_score")], True),
        "created": ([F.coalesce("created_at", F.lit(0).cast("timestamp"))], True), "name": ([text.natural_sort_key(F.col("name"))], False),
    }
    columns, own = sorts[by]
    down = own if descending is None else descending
    return projects.orderBy(*[c.desc() if down else c.asc() for c in columns], F.asc("project_id"))


def first_translation(logs: DataFrame) -> DataFrame:
    return logs.groupBy("page_id").agg(F.min("created_at").alias("first_at"))


def bubble_effort(bubbles: DataFrame, shifts: bool = False) -> DataFrame:
    """Reviewed bubbles with status and distances between draft and final; those without a draft have none. With
    ``shifts`` also ``ter_edits``, the word edits and block shifts from draft to final; ``bulk_edited`` marks bubbles that a
    bulk replacement changed, where the bubbles have such a list."""
    ai, final = (F.trim(F.coalesce(c, F.lit(""))) for c in ("ai_translation", "translation"))
    rows = bubbles.where(~F.coalesce("skip", F.lit(False)) & text.reviewed(F.col("translation"), F.col("ai_translation"), F.col("confirmed_translation")))
    draft = ai != ""
    return rows.select(
        "page_id", "bubble_id", (F.coalesce("confirmed_via", F.lit("")) == "page").alias("via_page"),
        text.edit_status(F.col("ai_translation"), F.col("translation")).alias("status"),
        F.length(final).alias("final_chars"), F.size(text.words(final)).alias("final_words"),
        F.when(draft, helpers.char_distance(F.when(draft, ai), F.when(draft, final))).alias("char_dist"), F.when(draft, helpers.token_levenshtein(ai, final)).alias("word_dist"),
        (F.size(F.coalesce("bulk_edits", F.array())) > 0 if "bulk_edits" in bubbles.columns else F.lit(False)).alias("bulk_edited"),
        *([F.when(draft, helpers.ter_edit_count(ai, final)).alias("ter_edits")] if shifts else []),
    ).withColumn("chars_saved", F.col("final_chars") - F.col("char_dist"))


def percent(part, whole):
    return 100.0 * part / F.nullif(whole, F.lit(0))


def translation_effort(effort: DataFrame) -> DataFrame:
    """Rates over all reviewed bubbles and over those reviewed one by one (``subset``). ``hter_pct``, the drafts' edit rate
    over the final words, is null unless ``bubble_effort`` counted shifts."""
    both = F.explode(F.array(F.lit("all"), F.when(~F.col("via_page"), "one_by_one"))).alias("subset")
    rows = effort.select("*", both).where("subset is not null")
    drafted = F.col("status") != "no_draft"
    edited = F.col("status").isin("minor", "edited")
    s = lambda c, cond=drafted: F.sum(F.when(cond, F.col(c)))
    out = rows.groupBy("subset").agg(
        F.count(F.lit(1)).alias("bubbles"), *[F.count_if(F.col("status") == x).alias(x) for x in ("unchanged", "minor", "edited", "no_draft")],
        s("final_chars").alias("chars_final"), s("char_dist").alias("chars_edited"), s("final_words").alias("words_final"), s("word_dist").alias("words_edited"),
        s("chars_saved").alias("chars_saved"), F.avg(F.when(drafted, F.col("char_dist") / F.greatest(F.lit(1), F.col("final_chars")))).alias("mean_edit_rate"),
        F.count_if(drafted & (F.col("chars_saved") < 0)).alias("worse_than_typing"),
        s("char_dist", edited).alias("_ed"), s("final_chars", edited).alias("_ef"), F.count_if("bulk_edited").alias("bulk_edited"),
        *([s("ter_edits").alias("_te")] if "ter_edits" in effort.columns else [F.lit(None).cast("long").alias("_te")]),
    )
    return out.withColumns(
        {
            "char_edit_pct": percent(F.col("chars_edited"), F.col("chars_final")), "word_edit_pct": percent(F.col("words_edited"), F.col("words_final")),
            "saved_pct": percent(F.col("chars_saved"), F.col("chars_final")), "edited_only_pct": percent(F.col("_ed"), F.col("_ef")),
            "hter_pct": percent(F.col("_te"), F.col("words_final")),
        }
    ).drop("_ed", "_ef", "_te")


def page_work(pages: DataFrame, effort: DataFrame, ops: DataFrame, first: DataFrame, ops_since, grouping_change) -> DataFrame:
    """Each page (page_id, ocr_at): statuses, distances, operations of each group where they were tracked, old or new
    grouping."""
    e = effort.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("reviewed"), *[F.count_if(F.col("status") == x).alias(x) for x in ("unchanged", "minor", "edited", "no_draft")],
        F.sum("char_dist").alias("char_dist"), F.sum("word_dist").alias("word_dist"),
    )
    o = ops.withColumn("_g", op_group(F.col("op"))).groupBy("page_id").agg(
        *[F.count_if(F.col("_g") == g).alias(f"ops_{g}") for g in GROUPS], F.count(F.lit(1)).alias("ops_total")
    )
    numbers = ["reviewed", "unchanged", "minor", "edited", "no_draft", "char_dist", "word_dist"]
    names = [f"ops_{g}" for g in GROUPS] + ["ops_total"]
    rows = pages.join(e, "page_id", "left").join(o, "page_id", "left").join(first, "page_id", "left").na.fill(0, numbers + names)
    rows = rows.withColumn("tracked", F.coalesce(F.least("ocr_at", "first_at") >= F.lit(ops_since).cast("timestamp"), F.lit(False)))
    rows = rows.withColumns({n: F.when(F.col("tracked"), F.col(n)) for n in names})
    return rows.withColumn("grouping", F.when(F.col("ocr_at").isNull(), "").when(F.col("ocr_at") >= F.lit(grouping_change).cast("timestamp"), "new").otherwise("old"))


def ops_effort(work: DataFrame) -> DataFrame:
    """One row a group of operations over the tracked pages: total, mean and median a page, share of pages with any."""
    rows = work.where("tracked")
    groups = F.explode(F.array(*[F.struct(F.lit(g).alias("group"), F.col(f"ops_{g}").alias("n")) for g in [*GROUPS, "total"]])).alias("s")
    return rows.select(groups).groupBy("s.group").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("s.n").alias("total"), F.avg("s.n").alias("mean"), F.median("s.n").alias("median"),
        percent(F.count_if(F.col("s.n") > 0), F.count(F.lit(1))).alias("with_pct"),
    )


def coalesce_ops(events: DataFrame, gap_seconds: int = 60, most: int = 2000) -> DataFrame:
    """Consecutive layout events (page_id, seq, op, at, bubble, detail) of a page that repeat the last one within the gap
    become one, with n and last_at; a page keeps its first ``most`` and says if it had more."""
    order = Window.partitionBy("page_id").orderBy("seq")
    before = {c: F.lag(c).over(order) for c in ("op", "bubble", "detail", "at")}
    age = F.unix_micros("at") - F.unix_micros(before["at"])
    joins = (
        F.col("op").isin("layout", "layout_bulk") & (F.col("op") == before["op"]) & F.col("bubble").eqNullSafe(before["bubble"])
        & F.col("detail").eqNullSafe(before["detail"]) & age.between(0, gap_seconds * 1_000_000)
    )
    runs = events.withColumn("_new", (~F.coalesce(joins, F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    one = runs.groupBy("page_id", "_run").agg(
        F.min("seq").alias("seq"), F.first("op").alias("op"), F.first("bubble").alias("bubble"), F.min("at").alias("at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("n")
    )
    return one.withColumn("truncated", F.max("_run").over(Window.partitionBy("page_id")) > most).where(F.col("_run") <= most).drop("_run")


def neighbour_context(bubbles: DataFrame, before: int = 2, after: int = 2) -> DataFrame:
    """Each bubble with the texts around it; empty and skipped ones are dropped after the window is taken."""
    item = F.struct("pos", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("skip", F.lit(False)).alias("skip"))
    order = Window.partitionBy("page_id").orderBy("pos")
    both = F.concat(F.collect_list(item).over(order.rowsBetween(-before, -1)), F.collect_list(item).over(order.rowsBetween(1, after)))
    kept = F.filter(both, lambda x: (F.trim(x["text"]) != "") & ~x["skip"])
    return bubbles.withColumn("context", F.transform(kept, lambda x: x["text"]))


def review_page(bubbles: DataFrame, accept: DataFrame, unaccept: DataFrame, at) -> DataFrame:
    """Stamps the translated, unreviewed bubbles of accepted pages; takes such stamps of other pages back."""
    marks = accept.select("page_id", F.lit(1).alias("_do")).unionByName(unaccept.select("page_id", F.lit(-1).alias("_do"))).groupBy("page_id").agg(F.max("_do").alias("_do"))
    seen = text.reviewed(F.col("translation"), F.col("ai_translation"), F.col("confirmed_translation"))
    stamp = (F.col("_do") == 1) & (F.trim(F.coalesce("translation", F.lit(""))) != "") & ~seen & ~F.coalesce("skip", F.lit(False))
    undo = (F.col("_do") == -1) & (F.col("confirmed_via") == "page")
    pick = lambda new, old: F.when(F.coalesce(stamp, F.lit(False)), new).when(F.coalesce(undo, F.lit(False)), None).otherwise(F.col(old))
    joined = bubbles.join(marks, "page_id", "left")
    flagged = joined.withColumns({"_c": pick(F.col("translation"), "confirmed_translation"), "_a": pick(F.lit(at).cast("timestamp"), "confirmed_at"), "_v": pick(F.lit("page"), "confirmed_via")})
    return flagged.withColumns({"confirmed_translation": F.col("_c"), "confirmed_at": F.col("_a"), "confirmed_via": F.col("_v")}).drop("_c", "_a", "_v", "_do")


def reset_stale(pages: DataFrame) -> DataFrame:
    return pages.withColumn("status", F.when(F.col("status").isin("queued", "processing"), "pending").otherwise(F.col("status")))


def retranslate_targets(bubbles: DataFrame, overwrite: bool = False) -> DataFrame:
    """Bubbles to translate again: not skipped, and not edited unless ``overwrite``."""
    edited = F.trim(F.coalesce("translation", F.lit(""))) != F.trim(F.coalesce("ai_translation", F.lit("")))
    return bubbles.where(~F.coalesce("skip", F.lit(False)) & (F.trim(F.coalesce("text", F.lit(""))) != "") & (F.lit(overwrite) | ~edited))


def replace_in_translations(bubbles: DataFrame, find: str, new: str, mode: str, at: str) -> DataFrame:
    """Bubbles after a find and replace; a review stamp of the old text follows, and ``bulk_edits`` counts it."""
    after = F.when(F.lower("translation").contains(find.strip().lower()), helpers.replace_terms(find, new, mode)(F.col("translation"))).otherwise(F.col("translation"))
    rows = bubbles.withColumn("_after", after)
    changed = F.coalesce(F.col("_after") != F.col("translation"), F.lit(False))
    mark = F.array(F.struct(F.lit(at).alias("at"), F.lit(find).alias("find"), F.lit(new).alias("replace")))
    none = F.array().cast("array<struct<at:string,find:string,replace:string>>")
    return rows.withColumns(
        {
            "changed": changed,
            "confirmed_translation": F.when(changed & (F.col("confirmed_translation") == F.col("translation")), F.col("_after")).otherwise(F.col("confirmed_translation")),
            "bulk_edits": F.when(changed, F.concat(F.coalesce("bulk_edits", none), mark)).otherwise(F.coalesce("bulk_edits", none)),
            "translation": F.col("_after"),
        }
    ).drop("_after")
