"""Translation logs: project and bubble views, paired variants, experiment summaries, key and quota usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tmspark.functions import text

EXAMPLE = "struct<en:string,pl:string,similarity:double,kind:string>"
INJECTION = (
    f"examples array<{EXAMPLE}>, exact string, glossary array<struct<source_term:string,target_term:string>>, "
    "lane string, model_output string, temperature double, terms struct<missing:array<string>,postedit:struct<applied:boolean>>, "
    "memory_probe struct<lane:string,candidates:int,best:double,size:long,threshold:double>, correction_ids array<long>"
)
VARIANTS = ("zero_shot", "memory_injected")


def logs_for_project(logs: DataFrame, pages: DataFrame, chapters: DataFrame, project_id: int) -> DataFrame:
    """A project's logs, newest first."""
    own = chapters.where(F.col("project_id") == project_id).select(F.col("id").alias("_c"))
    page = pages.join(own, pages["chapter_id"] == own["_c"]).select(F.col("id").alias("page_id"))
    return logs.join(page, "page_id").orderBy(F.desc("created_at"), F.desc("id"))


def logs_with_bubble_now(logs: DataFrame, bubbles: DataFrame) -> DataFrame:
    """Logs with what their bubble holds now: number, current_translation, reviewed, page_accepted; null where it is gone."""
    now = bubbles.select(
        "page_id", "bubble_id", (F.col("pos") + 1).alias("number"), F.coalesce("translation", F.lit("")).alias("current_translation"),
        text.reviewed(F.col("translation"), F.col("ai_translation"), F.col("confirmed_translation")).alias("reviewed"),
        (F.coalesce("confirmed_via", F.lit("")) == "page").alias("page_accepted"),
    )
    return logs.join(now, ["page_id", "bubble_id"], "left")


def pair_logs(logs: DataFrame) -> DataFrame:
    """One row for each (run_id, bubble_id) with a struct of either variant (the oldest log of it) and the lane."""
    parsed = logs.withColumn("injection", F.from_json("injection_json", INJECTION))
    keep = ["id", "page_id", "source_text", "output_text", *[c for c in ("model_used", "key_label") if c in logs.columns], "similarity_score", "threshold_used", "glossary_terms_used", "hints_json", "memory_lane", "injection", "created_at"]
    row = F.struct(*keep)
    one = lambda v: F.min_by(F.when(F.col("variant") == v, row), F.when(F.col("variant") == v, F.struct("created_at", "id"))).alias(v)
    pairs = parsed.where(F.col("variant").isin(*VARIANTS)).groupBy("run_id", "bubble_id").agg(*[one(v) for v in VARIANTS])
    m = F.col("memory_injected")
    older = F.when(m["hints_json"].isNotNull(), F.when(m["hints_json"].contains('"exact"'), "exact").otherwise("fuzzy")).when(
        m["threshold_used"].isNull(), "exact"
    ).otherwise("fuzzy")
    lane = F.when(m.isNotNull(), F.coalesce(m["memory_lane"], m["injection"]["lane"], older))
    return pairs.withColumns({"lane": lane, "shown": F.coalesce("memory_injected", "zero_shot"), "base": F.coalesce("zero_shot", "memory_injected")})


def _model_text(log: str) -> Column:
    return F.trim(F.coalesce(F.col(f"{log}.injection.model_output"), F.col(f"{log}.output_text"), F.lit("")))


def glossary_fired(log: Column) -> Column:
    return F.size(F.coalesce(F.from_json(log["glossary_terms_used"], "array<struct<source_term:string>>"), F.array().cast("array<struct<source_term:string>>"))) > 0


def experiment_summary(pairs: DataFrame) -> DataFrame:
    """One row: bubbles, lanes, pairs whose model output memory changed, similarities, thresholds, terms."""
    fuzzy = F.col("lane") == "fuzzy"
    paired = fuzzy & F.col("zero_shot").isNotNull()
    shown = F.col("shown")
    return pairs.agg(
        F.count(F.lit(1)).alias("bubbles"),
        F.count_if(fuzzy).alias("fuzzy"),
        F.count_if(F.col("lane") == "exact").alias("exact"),
        F.count_if(paired).alias("paired"),
        F.count_if(paired & (F.lower(_model_text("zero_shot")) != F.lower(_model_text("memory_injected")))).alias("changed"),
        F.min(F.when(fuzzy, F.col("memory_injected.similarity_score"))).alias("least_similarity"),
        F.max(F.when(fuzzy, F.col("memory_injected.similarity_score"))).alias("most_similarity"),
        F.array_join(F.array_sort(F.array_union(F.collect_set("memory_injected.threshold_used"), F.collect_set("zero_shot.threshold_used"))), ",").alias("thresholds"),
        F.count_if(glossary_fired(shown)).alias("glossary_fired"),
        F.count_if(F.size(F.coalesce(shown["injection"]["terms"]["missing"], F.array().cast("array<string>"))) > 0).alias("terms_missing"),
        F.count_if(F.coalesce(shown["injection"]["terms"]["postedit"]["applied"], F.lit(False))).alias("terms_fixed"),
    )


def memory_size_at(rows: DataFrame, corrections: DataFrame, buckets: str = "day") -> DataFrame:
    """``rows`` (project_id, ts, ..) with ``memory_size``: entries of the project created before ts.

    Entries and rows are put on one timeline and counted in two steps, within a day and over the days before it, so no
    project's whole history is one window."""
    names = rows.columns
    line = rows.select("project_id", F.col("ts").alias("_t"), F.lit(0).alias("_is"), F.struct(*names).alias("_r")).unionByName(
        corrections.where("created_at is not null").select("project_id", F.col("created_at").alias("_t"), F.lit(1).alias("_is")), allowMissingColumns=True
    ).withColumn("_d", F.date_trunc(buckets, "_t"))
    days = line.groupBy("project_id", "_d").agg(F.sum("_is").alias("_new"))
    before = Window.partitionBy("project_id").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_before", F.coalesce(F.sum("_new").over(before), F.lit(0)))
    within = Window.partitionBy("project_id", "_d").orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("project_id", "_d", "_t")
    counted = line.withColumn("_in", F.sum("_is").over(within) - F.sum("_is").over(same)).join(
        days.select(F.col("project_id").alias("_p"), F.col("_d").alias("_e"), "_before"), F.col("project_id").eqNullSafe(F.col("_p")) & F.col("_d").eqNullSafe(F.col("_e"))
    )
    return counted.where("_is = 0").select("_r.*", (F.col("_in") + F.col("_before")).alias("memory_size"))


#: Lower ends of the buckets of memory sizes, and the thresholds of the what-if table.
SIZE_BUCKETS = (0, 10, 25, 50, 100, 200, 400)
WHAT_IF = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9)


def hit_rate_by_memory_size(rows: DataFrame) -> DataFrame:
    """Rows (lane, memory_size, exact_size) by bucket: n, fuzzy, exact, approximate."""
    bucket = F.lit(SIZE_BUCKETS[0])
    for low in SIZE_BUCKETS[1:]:
        bucket = F.when(F.col("memory_size") >= low, low).otherwise(bucket)
    return rows.where("memory_size is not null").groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("lane") == "fuzzy").alias("fuzzy"), F.count_if(F.col("lane") == "exact").alias("exact"),
        F.count_if(~F.col("exact_size")).alias("approximate"),
    )


def threshold_what_if(probes: DataFrame, thresholds=WHAT_IF) -> DataFrame:
    """Probes (lane, candidates, best) of the fuzzy lane: for each threshold, how many reach it of how many."""
    fuzzy = probes.where("lane = 'fuzzy' and candidates > 0")
    steps = F.array(*[F.struct(F.lit(t).alias("threshold"), (F.coalesce("best", F.lit(-1.0)) >= t).alias("hit")) for t in thresholds])
    return fuzzy.select(F.explode(steps).alias("s")).groupBy("s.threshold").agg(F.count_if("s.hit").alias("hits"), F.count(F.lit(1)).alias("probed"))


def key_model_stats(logs: DataFrame, now) -> DataFrame:
    """Requests of each key and model, in all and in the last 24 hours."""
    return logs.groupBy(F.coalesce("key_label", F.lit("unknown")).alias("key_label"), F.coalesce("model_used", F.lit("unknown")).alias("model")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("created_at") >= F.lit(now).cast("timestamp") - F.expr("interval 24 hours")).alias("last_day")
    )


def history(rows: DataFrame) -> DataFrame:
    """Paired rows joined with their bubble's present: adds now_status, its rank, and hint_rank."""
    trim = lambda c: F.trim(F.coalesce(c, F.lit("")))
    status = (
        F.when(F.col("current_translation").isNull(), "gone").when(~F.col("reviewed"), "open")
        .when(trim(F.col("current_translation")) != trim(F.col("shown.output_text")), "edited").when(F.col("page_accepted"), "page").otherwise("accepted")
    )
    memory, fired = F.col("memory_injected").isNotNull(), glossary_fired(F.col("shown"))
    ranks = F.create_map(*[F.lit(x) for pair in (("edited", 0), ("accepted", 1), ("page", 2), ("open", 3), ("gone", 4)) for x in pair])
    hint = F.when(memory & fired, 0).when(memory, 1).when(fired, 2).otherwise(3)
    return rows.withColumn("now_status", status).withColumns({"status_rank": F.element_at(ranks, F.col("now_status")), "hint_rank": hint})


def log_filters() -> dict[str, Column]:
    """Conditions of the history's filters over rows of ``history``."""
    memory = F.col("memory_injected").isNotNull()
    differs = F.trim("current_translation") != F.trim(F.coalesce("shown.output_text", F.lit("")))
    return {
        "all": F.lit(True), "changed": F.coalesce(differs, F.lit(False)), "unreviewed": F.coalesce(~F.col("reviewed"), F.lit(False)), "memory": memory,
        "fuzzy": F.coalesce(F.col("lane") == "fuzzy", F.lit(False)), "exact": F.coalesce(F.col("lane") == "exact", F.lit(False)),
        "ab": memory & F.col("zero_shot").isNotNull(), "glossary": F.coalesce(glossary_fired(F.col("shown")), F.lit(False)),
        "postedit": F.coalesce(F.col("shown.injection.terms.postedit.applied"), F.lit(False)),
    }


def log_filter(rows: DataFrame, mode: str = "all", q: str | None = None, chapter: str | None = None) -> DataFrame:
    """Rows of a mode, of a chapter (column ``chapter``) if one is given, that hold ``q`` in source, output, bubble or, where
    there is such a column, the file's name."""
    kept = rows.where(log_filters()[mode])
    kept = kept if chapter is None else kept.where(F.col("chapter") == chapter)
    if q and q.strip():
        names = ["base.source_text", "shown.output_text", "current_translation", *(["file_name"] if "file_name" in rows.columns else [])]
        hay = [F.lower(F.coalesce(c, F.lit(""))) for c in names]
        kept = kept.where(text.any_of([h.contains(q.strip().lower()) for h in hay]))
    return kept


def filter_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.count_if(c).alias(name) for name, c in log_filters().items()])


def history_sort(rows: DataFrame, key: str = "time", descending: bool | None = None, n: int = 200) -> DataFrame:
    """The first n rows by time, where (chapter, file_name, number), source, now, hints, model or temperature, each in its
    own direction unless one is given. By time rows have ``group_label`` of their day, by where of their chapter; with it
    goes the number of the group's rows, shown or not."""
    natural = lambda c: text.natural_sort_key(F.coalesce(c, F.lit("")))
    at, there = F.col("base.created_at"), set(rows.columns)
    place = [natural(F.col(c)) if c in there else F.lit("") for c in ("chapter", "file_name")]
    number = F.coalesce("number", F.lit(1_000_000_000)) if "number" in there else F.lit(0)
    sorts = {
        "time": ([at, F.col("base.id")], True), "where": ([*place, number], False), "source": ([natural(F.col("base.source_text"))], False),
        "now": ([F.col("status_rank")], False), "hints": ([F.col("hint_rank"), -F.unix_micros(at)], False),
        "model": ([natural(F.col("shown.model_used")), natural(F.col("shown.key_label"))] if key == "model" else [], False),
        "temperature": ([F.coalesce("shown.injection.temperature", F.lit(99.0)), -F.unix_micros(at)], False),
    }
    by, natural_direction = sorts[key]
    down = natural_direction if descending is None else descending
    label = {"time": F.to_date(at).cast("string"), "where": F.coalesce("chapter", F.lit("No chapter")) if "chapter" in there else F.lit("No chapter")}.get(key, F.lit(None).cast("string"))
    labelled = rows.withColumn("group_label", label)
    sizes = labelled.groupBy("group_label").agg(F.count(F.lit(1)).alias("group_rows"))
    top = labelled.orderBy(*[c.desc() if down else c.asc() for c in by], F.desc("base.id")).limit(n)
    return top.join(sizes, top["group_label"].eqNullSafe(sizes["group_label"]), "left").drop(sizes["group_label"])


def backfill_json_key(logs: DataFrame, key: str, value, stamp: str) -> DataFrame:
    """``injection_json`` with the key and a mark of the backfill where it lacks it; ``state``: has_value, no_json,
    broken or filled."""
    parsed = F.try_parse_json("injection_json")
    has = F.try_variant_get(parsed, f"$.{key}", "string").isNotNull()
    is_object = parsed.isNotNull() & F.trim("injection_json").startswith("{")
    state = F.when(F.coalesce(F.trim("injection_json"), F.lit("")) == "", "no_json").when(~is_object, "broken").when(has, "has_value").otherwise("filled")
    added = f'"{key}":{value},"backfilled":"{stamp}"}}'
    body = F.regexp_replace(F.trim("injection_json"), r"\s*\}$", "")
    new = F.concat(body, F.when(body.rlike(r"^\{\s*$"), "").otherwise(","), F.lit(added))
    return logs.withColumn("state", state).withColumn("injection_json", F.when(F.col("state") == "filled", new).otherwise(F.col("injection_json")))


def memory_used(bubbles: DataFrame, logs: DataFrame, corrections: DataFrame) -> DataFrame:
    """What the memory gave to the present text of each bubble (page_id, bubble_id, project_id, text).

    The newest run counts that was logged for that text: for the bubble itself, or else for any bubble of the page, as ids
    move. ``stale``: other texts of the bubble were logged, this one wasn't. ``entries``: the examples shown, or the exact
    phrase, each with the entry it came from (by the logged id, in old logs by an equal phrase key) and its text now."""
    upper = lambda c: F.upper(text.collapse(F.col(c)))
    b = bubbles.select("page_id", "bubble_id", "project_id", upper("text").alias("_t"))
    log = F.struct("id", "run_id", "variant", "source_text", "injection_json", "hints_json", "memory_lane", "matched_correction_id").alias("_log")
    of_text = logs.select("page_id", F.col("bubble_id").alias("_lb"), upper("source_text").alias("_t"), log)
    same = b.join(of_text, ["page_id", "_t"]).withColumn("_own", F.col("_lb") == F.col("bubble_id"))
    newest = F.max_by(F.col("_log.run_id"), F.struct("_own", "_log.id")).alias("_run")
    own = same.groupBy("page_id", "bubble_id").agg(newest, F.max("_own").alias("_is_own"))
    rows = same.join(own, ["page_id", "bubble_id"]).where((F.col("_log.run_id") == F.col("_run")) & (F.col("_own") == F.col("_is_own")) & (F.col("_log.variant") == "memory_injected"))
    used = rows.groupBy("page_id", "bubble_id", "project_id").agg(F.max_by("_log", "_log.id").alias("_log"))
    hints, said = F.from_json("_log.hints_json", INJECTION), F.from_json("_log.injection_json", INJECTION)
    bare = (F.size(F.coalesce(said["examples"], F.array().cast(f"array<{EXAMPLE}>"))) == 0) & said["exact"].isNull()
    used = used.withColumns({"_x": F.when(bare, hints["examples"]).otherwise(said["examples"]), "_e": F.when(bare, hints["exact"]).otherwise(said["exact"]), "_ids": said["correction_ids"]})
    exact = F.struct(F.col("_log.source_text").alias("en"), F.col("_e").alias("pl"), F.lit(1.0).alias("similarity"), F.lit(None).cast("string").alias("kind"))
    none = F.array().cast(f"array<{EXAMPLE}>")
    first = F.coalesce(F.get("_ids", F.lit(0)), F.col("_log.matched_correction_id"))
    shown = F.concat(
        F.when(F.col("_e").isNotNull(), F.array(F.struct(F.lit(-1).alias("n"), exact.alias("x"), first.alias("id")))).otherwise(F.array()),
        F.transform(F.coalesce("_x", none), lambda x, k: F.struct(k.alias("n"), x.alias("x"), F.get("_ids", k).alias("id"))),
    )
    each = used.select("page_id", "bubble_id", "project_id", F.explode(shown).alias("_s")).select("page_id", "bubble_id", "project_id", "_s.*")
    key = lambda c: text.normalize_phrase(c)
    latest = corrections.select("project_id", key(F.col("source_text")).alias("_k"), F.col("id").alias("_found")).groupBy("project_id", "_k").agg(F.max("_found").alias("_found"))
    each = each.withColumn("_k", F.when(F.col("id").isNull(), key(F.col("x.en")))).join(latest, ["project_id", "_k"], "left").withColumn("id", F.coalesce("id", "_found"))
    now = corrections.select("project_id", F.col("id"), F.col("source_text").alias("_src"), F.col("final_translation").alias("pl_now"), F.coalesce("kind", F.lit("corrected")).alias("_kind"))
    each = each.join(now, ["project_id", "id"], "left")
    entry = F.struct(
        "n", F.when(F.col("pl_now").isNotNull(), F.col("id")).alias("correction_id"), F.coalesce("x.en", "_src").alias("en"), F.col("x.pl").alias("pl_shown"), "pl_now",
        F.col("x.similarity").alias("similarity"), F.coalesce("x.kind", "_kind").alias("kind"),
    )
    entries = each.groupBy("page_id", "bubble_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    ever = logs.select("page_id", "bubble_id").distinct().withColumn("_ever", F.lit(True))
    met = own.select("page_id", "bubble_id", F.lit(True).alias("_met"))
    out = b.join(ever, ["page_id", "bubble_id"], "left").join(met, ["page_id", "bubble_id"], "left").join(used.select("page_id", "bubble_id", F.col("_log.id").alias("log_id"), F.coalesce("_log.memory_lane", said["lane"]).alias("lane")), ["page_id", "bubble_id"], "left")
    stale = F.coalesce("_ever", F.lit(False)) & F.col("_met").isNull()
    return out.withColumn("stale", stale).where("log_id is not null or stale").join(entries, ["page_id", "bubble_id"], "left").select("page_id", "bubble_id", "log_id", "lane", "stale", "entries")


def reuse_counts(logs: DataFrame) -> DataFrame:
    """Times each entry was injected, over all entries a log names."""
    ids = F.from_json("injection_json", INJECTION)["correction_ids"]
    return logs.where("variant = 'memory_injected'").select(F.explode(F.coalesce(ids, F.array("matched_correction_id"))).alias("correction_id")).where(
        "correction_id is not null"
    ).groupBy("correction_id").agg(F.count(F.lit(1)).alias("reuse_count"))


def key_days(events: DataFrame, days: int = 8) -> DataFrame:
    """Requests of each key and model a quota day, for its last days that have any."""
    each = events.where("kind = 'success'").groupBy("provider", "key_id", "model", text.quota_day(F.col("at"), F.col("provider")).alias("day")).agg(F.count(F.lit(1)).alias("requests"))
    order = Window.partitionBy("key_id", "model").orderBy(F.desc("day"))
    return each.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= days).drop("_n")


def last_minute(events: DataFrame) -> DataFrame:
    """Each request with the number of the key's requests in the minute before it (60 seconds aside), itself included.

    Requests are looked at by minute, together with those of the minute before, so a key's history is many groups."""
    micros, minute = F.unix_micros("at"), 60_000_000
    rows = events.where("kind = 'success'").withColumn("_m", F.floor(micros / minute))
    both = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_later")).withColumn("_m", F.col("_m") + F.col("_later"))
    window = Window.partitionBy("key_id", "model", "_m").orderBy(micros).rangeBetween(1 - minute, 0)
    return both.withColumn("in_minute", F.count(F.lit(1)).over(window)).where("_later = 0").drop("_m", "_later")


def key_usage(events: DataFrame, now) -> DataFrame:
    """Each key and model: requests today and in a week, the day's limit and where it is from, what is left, whether it is
    exhausted, and the minute's limit.

    The day's limit is the last number a server named for a day; as long as none did, it is the requests that were made
    on a day when a refusal without a number came. Refusals of a minute say nothing about the day. What a server said
    today is left wins over the limit less today's requests; a day's refusal today leaves 0."""
    at = F.lit(now).cast("timestamp")
    key = ["provider", "key_id", "model"]
    e = events.where(F.col("at") <= at).withColumns({"_day": text.quota_day(F.col("at"), F.col("provider")), "_now": text.quota_day(at, F.col("provider"))})
    today = F.col("_day") == F.col("_now")
    done, refused = F.col("kind") == "success", F.col("kind") == "limit"
    daily, number = F.coalesce("daily", F.lit(False)), F.coalesce("limit_value", F.lit(0)) != 0
    named = (F.col("kind") == "server_counts") & F.col("limit_value").isNotNull() | refused & daily & number
    latest = lambda column, condition: F.max_by(column, F.when(condition, F.col("at")))
    out = e.groupBy(*key).agg(
        F.count_if(done & today).alias("today"),
        F.count_if(done & (F.col("_day") > F.date_sub("_now", 7))).alias("week"),
        F.count_if(done & (F.col("at") > at - F.expr("interval 60 seconds"))).alias("last_minute"),
        latest("limit_value", named).alias("_named"),
        latest("limit_value", refused & ~daily & number).alias("limit_minute"),
        latest("left_value", (F.col("kind") == "server_counts") & F.col("left_value").isNotNull() & today).alias("_left"),
        F.coalesce(F.bool_or(refused & daily & today), F.lit(False)).alias("exhausted"),
    )
    bare = e.where(refused & daily & ~number).groupBy(*key).agg(F.max(F.struct("at", "_day")).alias("_r"))
    bare = bare.select(*key, F.col("_r._day").alias("_day"), F.col("_r.at").alias("_refused"))
    reached = bare.join(e.where(done).select(*key, "_day", "at"), [*key, "_day"], "left").groupBy(*key).agg(
        F.greatest(F.lit(1), F.count_if(F.col("at") <= F.col("_refused"))).cast("int").alias("_reached")
    )
    out = out.join(reached, key, "left")
    limit = F.coalesce("_named", "_reached")
    source = F.when(F.col("_named").isNotNull(), "server").when(F.col("_reached").isNotNull(), "estimate")
    left = F.when(F.col("exhausted"), 0).otherwise(F.coalesce("_left", F.when(F.col("limit_day") != 0, F.greatest(F.lit(0), F.col("limit_day") - F.col("today")))))
    out = out.withColumns({"limit_day": limit, "limit_source": source}).withColumn("left", left.cast("int"))
    return out.drop("_named", "_reached", "_left")
