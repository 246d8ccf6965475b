"""Operators on small tables: rules, ties, and equal results whatever the partitions."""

import json
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from statistics import median

import pytest
from pyspark.sql import functions as F

from tmspark.functions import helpers, layout
from tmspark.operators import catalog, glossary, logs, memory, ocr, progress, replay
from tmspark.plans import queries as registered
from tmspark.plans.views import VIEWS, view
from tmspark.sources import io
from tmspark.streaming import jobs

T0 = datetime(2024, 1, 1)


def test_every_view_reads(spark, sf_dir):
    for name in VIEWS:
        assert view(spark, sf_dir, name).limit(1).count() == 1, name


def test_every_query_has_a_stable_schema(spark, sf_dir):
    for name, query in registered.QUERIES.items():
        assert query(spark, sf_dir).columns, name
    assert set(registered.ORACLE_SQL) <= set(registered.QUERIES)


@pytest.mark.parametrize("block, parts", [(3, 2), (1000, 1), (7, 5)])
def test_fuzzy_pairs_do_not_depend_on_blocks(spark, sf_dir, block, parts):
    q, m = view(spark, sf_dir, "query_vectors"), view(spark, sf_dir, "memory_vectors")
    rows = {(r.query_id, r.correction_id) for r in memory.candidate_pairs(q, m, 0.25, block_rows=block, query_rows=parts).collect()}
    vectors = {r.id: (r.project_id, r.embedding) for r in m.collect()}
    want = {(r.query_id, i) for r in q.collect() for i, (p, e) in vectors.items() if p == r.project_id and sum(a * b for a, b in zip(r.embedding, e)) >= 0.25}
    assert rows == want


def saves(spark):
    rows, at = [], T0
    base = dict(project_id=1, page_id=1, bubble_id="b1", source_text="WHERE ARE WE NOW", ai_translation="gdzie jestesmy", approve=False)
    def add(event, final, **more):
        rows.append({**base, "seq": len(rows) + 1, "at": at + timedelta(minutes=len(rows)), "event": event, "final_translation": final, **more})
    add("save", "gdzie my teraz")
    add("save", "gdzie my teraz jestesmy")  # the same bubble, unused: changed in place
    add("use", None)
    add("save", "gdzie my wlasciwie teraz")  # used by now: a second entry
    add("save", "GDZIE MY WLASCIWIE TERAZ", bubble_id="b2")  # a duplicate
    add("save", "co", source_text="WHAT IS ALL THIS")  # too short
    add("save", "nie", source_text="NO!")  # the short lane
    add("save", "no", source_text="?!")  # nothing to match on
    add("save", "gdzie jestesmy")  # back to the draft: the unused entry goes
    schema = "project_id int, page_id long, bubble_id string, source_text string, ai_translation string, approve boolean, seq long, at timestamp, event string, final_translation string"
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)


WANT = [(1, "gdzie my teraz jestesmy", 1), (7, "nie", 0)]


def test_fold(spark):
    got = memory.fold_corrections(saves(spark)).collect()
    assert sorted((r.id, r.final_translation, r.reuse_count) for r in got) == WANT


def test_streams_equal_their_batch_twins(spark, sf_dir, tmp_path):
    events = view(spark, sf_dir, "key_events")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    jobs.run_available(jobs.key_usage_by_day(stream), "usage", "complete", f"{tmp_path}/cp")
    assert sorted(map(str, spark.table("usage").collect())) == sorted(map(str, jobs.key_usage_by_day(events).collect()))


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "provider string, key_id string, model string, kind string, at timestamp"
    make = lambda hours: spark.createDataFrame([("p", "k", "m", "success", T0 + timedelta(hours=h)) for h in hours], schema)
    for n, hours in enumerate(([0, 100], [1, 101], [200])):
        make(hours).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = jobs.key_usage_by_day(stream).writeStream.outputMode("append").foreachBatch(lambda df, b: df.write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r["window"].start: r.requests for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert sum(got.values()) == 3  # hours 0, 100 and 101; hour 1 came after the watermark had passed it


def test_coalesce_ops(spark):
    def run(seconds, ops=None):
        ops = ops or ["layout"] * len(seconds)
        rows = [(1, k, op, T0 + timedelta(seconds=s), "b", "d") for k, (s, op) in enumerate(zip(seconds, ops))]
        df = spark.createDataFrame(rows, "page_id long, seq int, op string, at timestamp, bubble string, detail string")
        return sorted((r.seq, r.n) for r in progress.coalesce_ops(df).collect())

    assert run([0, 30, 90]) == [(0, 3)] and run([0, 61]) == [(0, 1), (1, 1)]
    assert run([0, 10, 20], ["layout", "merge", "layout"]) == [(0, 1), (1, 1), (2, 1)]


def test_glossary_matches(spark):
    terms = [(1, 1, "WYVERN", "w"), (2, 1, "DRAGOONS", "d"), (3, 1, "WYVERN KNIGHTS", "k"), (4, 1, "QUA-TOYNE", "q"), (5, 2, "OTHER", "o")]
    g = spark.createDataFrame(terms, "id int, project_id int, source_term string, target_term string")
    lines = ["WYVERNS", "a wyvern's wing", "WYVERNES", "DRAGOON'S HONOR", "THE WYVERN KNIGHTS", "QUA- TOYNE", "QUA TOYNE", "WYVERNLIKE", "other", None, ""]
    rows = spark.createDataFrame([(k, 1, t) for k, t in enumerate(lines)], "k int, project_id int, text string")
    got = {r.k: [m.source_term for m in r.matches] for r in glossary.match_glossary(rows, g).collect()}
    assert [got[k] for k in range(11)] == [["WYVERN"], ["WYVERN"], ["WYVERN"], ["DRAGOONS"], ["WYVERN KNIGHTS"], ["QUA-TOYNE"], ["QUA-TOYNE"], [], [], [], []]


def test_suggest_terms(spark):
    rows = [(1, 1, "THE WIVERN FLIES", "wiwern leci", "wywern leci"), (2, 1, "A WIVERN", "Wiwern", "Wywern"), (3, 1, "WIVERN!", "WIWERN", "WYWERN"), (4, 1, "MAIHARK", "Maiharka", "Maihark"), (5, 1, "MAIHARK", "Maiharka", "Maihark")]
    c = spark.createDataFrame(rows, "id long, project_id int, source_text string, ai_translation string, final_translation string")
    g = spark.createDataFrame([], "project_id int, source_term string")
    got = glossary.suggest_terms(c, g).collect()
    assert [(r.term, r.wrong, r.right, r.occurrences) for r in got] == [("WIVERN", "wiwern", "wywern", 3)]
    known = spark.createDataFrame([(1, "wivern")], "project_id int, source_term string")
    assert glossary.suggest_terms(c, known).count() == 0


def test_entries_follow_edits_whatever_the_case(spark):
    rows = [(1, 1, "b", "Große Straße", 0), (2, 1, "b", "Große Straße", 1), (3, 1, "b", "other", 0), (4, 2, "b", "große straße", None), (5, None, "b", "große straße", 0)]
    c = spark.createDataFrame(rows, "id long, page_id long, bubble_id string, source_text string, reuse_count int")
    edits = [(1, "b", "GROSSE STRASSE!", "new"), (1, "b", "grosse straße", "new"), (1, "b", "absent", "x"), (2, "b", "Grosse Strasse", "neu"), (2, "b", "GROSSE STRASSE", None)]
    e = spark.createDataFrame(edits, "page_id long, bubble_id string, old_text string, new_text string")
    got = sorted((r.id, r.source_text, r.re_embed) for r in memory.follow_source_edits(c, e).collect())
    assert got == [(1, "new", True), (2, "Große Straße", False), (3, "other", False), (4, "neu", True), (5, "große straße", False)]


def test_suggested_terms_are_compared_within_an_entry(spark):
    rng = random.Random(5)
    word = lambda letters, most: "".join(rng.choice(letters) for _ in range(rng.randint(1, most)))
    for letters, most in (("abc", 12), ("abcdefghijklmnopqrstuvwxyz", 14), ("ab", 90)):
        terms, words = [word(letters, most) for _ in range(30)], [word(letters, most) for _ in range(40)]
        sims = [[helpers.ratio(t, w) for w in words] for t in terms]
        assert helpers.likest(terms, words, cells=100) == ([s.index(max(s)) for s in sims], [max(s) for s in sims])
    # Entries of one id count each for themselves, and no pair of words is a row of a join.
    rows = [(1, 1, "WIVERN WIVERN", "a Wiwern", "a Wywern wywern"), (1, 1, "WIVERN!", "wiwern", "wywern"), (2, 1, "WIVERN", "", "wywern"), (3, 1, "WIVERN", "smok", "wywern")]
    c = spark.createDataFrame(rows, "id long, project_id int, source_text string, ai_translation string, final_translation string")
    got = glossary.suggest_terms(c, spark.createDataFrame([], "project_id int, source_term string"))
    assert [(r.term, r.wrong, r.right, r.occurrences) for r in got.collect()] == [("WIVERN", "Wiwern", "Wywern", 3)]
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def box(x1, y1, x2, y2):
    return [[float(x1), float(y1)], [float(x2), float(y1)], [float(x2), float(y2)], [float(x1), float(y2)]]


ITEMS = "page_id long, pos int, id string, text string, score double, slice_id int, box array<array<double>>"


def test_boundary_duplicates(spark):
    rows = [(1, 0, "a", "BUG'S", 0.9, 0, box(0, 0, 50, 20)), (1, 1, "b", "BUG'5", 0.8, 1, box(2, 2, 52, 22)), (1, 2, "c", "BUG'S", 0.7, 0, box(1, 1, 51, 21)), (2, 0, "d", "BUG'S", 0.1, 1, box(0, 0, 50, 20))]
    got = ocr.slice_boundary_dedup(spark.createDataFrame(rows, ITEMS)).collect()
    assert sorted((r.page_id, r.pos) for r in got) == [(1, 0), (1, 2), (2, 0)]


def words_page():
    rows = []
    for k, (x, y, t) in enumerate([(0, 0, "ONE"), (60, 0, "TWO"), (10, 25, "THREE"), (600, 0, "FAR"), (605, 25, "AWAY"), (0, 300, "77")]):
        rows.append((1, k, str(k), t, 0.95, 0, box(x, y, x + 50, y + 20)))
    return rows


def test_bubbles_do_not_depend_on_the_order_of_rows(spark):
    want = None
    for seed in range(3):
        rows = words_page() + [(p, *r[1:]) for p in range(2, 8) for r in words_page()]
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, ITEMS).repartition(seed + 1)
        got = sorted((r.page_id, r.bubble_no, r.text) for r in ocr.group_bubbles(df).collect())
        assert want is None or got == want
        want = got
    assert [t for p, _, t in want if p == 1] == ["ONE TWO THREE", "FAR AWAY", "77"]


def test_reading_order(spark):
    rows = [(1, "a", box(0, 0, 50, 50)), (1, "b", box(100, 5, 150, 55)), (1, "c", box(0, 200, 50, 250))]
    df = spark.createDataFrame(rows, "page_id long, bubble_id string, box array<array<double>>")
    order = lambda mode: [r.bubble_id for r in ocr.reading_order(df, mode).orderBy("order_no").collect()]
    assert order("rtl") == ["b", "a", "c"] and order("ltr") == order("ttb") == ["a", "b", "c"]


def test_operator_blocks(spark):
    df = spark.createDataFrame([(1, "b", k, t) for k, t in enumerate(["A", "+", "B", "||", "C"])] + [(2, "b", k, t) for k, t in enumerate(["A", "||", "B"])], "page_id long, bubble_id string, line_no int, text string")
    got = sorted((r.page_id, r.line_no, r.block) for r in ocr.split_operator_blocks(df).collect())
    assert [b for p, _, b in got if p == 1] == [0, 1, 2, 3, 4] and {b for p, _, b in got if p == 2} == {0}


def test_clean_sequence(spark):
    rows = [("a", "page_01.jpg"), ("a", "page_02.jpg"), ("b", "cover.jpg"), ("b", "a3f9.jpg"), ("c", "1.jpg")]
    got = {r.folder: r.clean for r in catalog.clean_sequence(spark.createDataFrame(rows, "folder string, name string")).collect()}
    assert got == {"a": True, "b": False, "c": False}


def test_unique_labels_pass_over_taken_names(spark):
    rows = spark.createDataFrame([(1, "A"), (2, "a"), (3, "A (2)"), (4, "A")], "seq int, label string")
    labels = [r.unique_label for r in catalog.unique_label(rows).orderBy("seq").collect()]
    assert labels[0] == "A" and len({x.lower() for x in labels}) == 4


def test_bubbles_of_small_and_large_pages_are_the_same(spark):
    rng = random.Random(3)
    for n in (0, 3, 12, 50):
        lines = []
        for _ in range(n):
            x, y, w, h = rng.randrange(0, 300, 10), rng.randrange(0, 300, 10), rng.choice([0, 20, 40, 90]), rng.choice([0, 20, 30])
            lines.append({"flat": layout.level(float(x), float(y), float(x + w), float(y + h)), "score": rng.choice([0.6, 0.9]), "angle": rng.choice([0.0, 0.0, 30.0]), "stream": rng.choice([-1, 0, 3])})
        assert layout.bubbles_of(lines, 0.7) == layout.bubbles_of(lines, 0.7, few=0)
    # Pages are dealt once: their bubbles are numbered within a page's row.
    found = ocr.group_bubbles(spark.createDataFrame([(1, 0, "0", "a", 0.9, [[0.0, 0.0], [9.0, 0.0], [9.0, 9.0], [0.0, 9.0]])], "page_id long, pos int, id string, text string, score double, box array<array<double>>"))
    assert [(r.page_id, r.bubble_no, r.text) for r in found.collect()] == [(1, 0, "a")]
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_bubbles_are_drawn_and_scored_once_for_all_differences(spark):
    keys = [(s, p, m) for s in ("all", "fuzzy") for p in ("A1-A0", "A2-A0") for m in ("chrf", "ter")]
    rows = [(*key, page, "b", float((page * (k + 3)) % 11 - 4)) for k, key in enumerate(keys) for page in range(300)]
    df = spark.createDataFrame(rows, "subset string, pair string, metric string, page_id long, bubble_id string, difference double")
    together = {(r.subset, r.pair, r.metric): r for r in replay.bootstrap(df, rounds=200).collect()}
    for key in keys:
        alone = replay.bootstrap(df.where(F.struct("subset", "pair", "metric") == F.struct(*map(F.lit, key))), rounds=200).collect()[0]
        assert together[key][3:] == pytest.approx(alone[3:])
    outputs = spark.createDataFrame(
        [(1, "b", v, o, "the final text", "a draft", k, False, None, 0.4) for k, (v, o) in enumerate([("A0", "a draft"), ("A0b", "a draft"), ("A1", "the text")])],
        "page_id long, bubble_id string, variant string, output string, final string, ai_first string, seq long, short boolean, confirmed_via string, nearest double",
    )
    diffs = replay.differences(replay.replay_scores(outputs))
    assert diffs.count() == 4 * 2 * 2  # subsets, pairs, metrics
    plan = diffs._jdf.queryExecution().executedPlan().toString()
    # An exchange stands between the scores and what is made of them, so that uses of the differences share it.
    assert plan.index("REPARTITION_BY_COL") < plan.index("ArrowEvalPython")


def test_wilcoxon_and_bootstrap(spark):
    rows = [("s", "A1-A0", "chrf", k, "b", float(d)) for k, d in enumerate([1, 2, 3, 4, 5, 6, 7, -0.5])] + [("t", "A1-A0", "chrf", k, "b", 0.0) for k in range(8)]
    df = spark.createDataFrame(rows, "subset string, pair string, metric string, page_id long, bubble_id string, difference double")
    p = {r.subset: r.p for r in replay.wilcoxon(df).collect()}
    assert p["s"] == pytest.approx(2 * 2 / 256) and p["t"] is None
    b = {r.subset: r for r in replay.bootstrap(df.repartition(5), rounds=300).collect()}
    again = {r.subset: r for r in replay.bootstrap(df.repartition(1), rounds=300).collect()}
    assert b["s"].low < b["s"].mean < b["s"].high and (b["t"].low, b["t"].high) == (0, 0)
    assert (b["s"].low, b["s"].high) == pytest.approx((again["s"].low, again["s"].high))


def test_page_documents_round_trip(spark, tmp_path):
    rows = [("c1", "p1", k, f"bubble_{k}", f"T{k}", "x" if k else None, None, k == 2) for k in range(3)]
    df = spark.createDataFrame(rows, "chapter string, page string, pos int, bubble_id string, text string, translation string, ai_translation string, skip boolean")
    io.write_page_json(df, f"{tmp_path}/out")
    back = io.read_page_json(spark, f"{tmp_path}/out", folders=True)["bubbles"].orderBy("pos").collect()
    assert [(r.pos, r.text, r.translation) for r in back] == [(0, "T0", ""), (1, "T1", "x"), (2, "T2", "")]


def test_files_and_app_logs(spark, tmp_path):
    (tmp_path / "f" / "ch1").mkdir(parents=True)
    (tmp_path / "f" / "ch1" / "1.jpg").write_bytes(b"a")
    (tmp_path / "f" / "ch1" / "2.txt").write_bytes(b"b")
    got = io.read_chapter_files(spark, f"{tmp_path}/f").collect()
    assert [(r.folder, r.name, r.sha1) for r in got] == [("ch1", "1.jpg", "86f7e437faa5a7fce15d1ddcb9eaeaea377667b8")]
    assert [(r.extension, r.files) for r in io.skipped_files(spark, f"{tmp_path}/f").collect()] == [("txt", 1)]
    (tmp_path / "app.log").write_text("2024-01-01 10:00:00 INFO started\n2024-01-01 10:00:01 ERROR broke\n  at line 1\n")
    logs = io.read_app_logs(spark, f"{tmp_path}/app.log")
    assert logs.count() == 3 and [r.message for r in io.read_app_logs(spark, f"{tmp_path}/app.log", True).collect()] == ["broke"]
    assert io.last_lines(logs, 1).first().message == "broke"


def test_resumable_append(spark, tmp_path):
    schema = io.REPLAY
    row = lambda page, ok: (page, "A0", "b", 1, False, "s", "f", "a", None, "o", 0.5, ok)
    io.append_replay(spark.createDataFrame([row(1, True)], schema), spark.createDataFrame([], schema), f"{tmp_path}/r")
    done = io.read_replay(spark, f"{tmp_path}/r")
    io.append_replay(spark.createDataFrame([row(1, True), row(2, True)], schema), done, f"{tmp_path}/r")
    assert sorted(r.page_id for r in io.read_replay(spark, f"{tmp_path}/r").collect()) == [1, 2]


def test_embedding_hook(spark):
    import struct

    def letters(texts):
        return [[t.count("a"), t.count("b")] for t in texts]

    rows = spark.createDataFrame([(1, "aab b", None, True), (2, None, [1.0, 0.0], True), (3, "b", [1.0, 0.0], False), (4, "", None, False)], "id int, source_text string, embedding array<float>, re_embed boolean")
    got = {r.id: r.embedding for r in memory.reembed(rows, letters).collect()}
    assert got[1] == pytest.approx([0.5**0.5] * 2) and got[2] == [1.0, 0.0] and got[3] == [1.0, 0.0] and got[4] == [0.0, 0.0]
    blobs = spark.createDataFrame([(bytearray(struct.pack("<2f", 1.5, -2.0)),), (None,)], "embedding binary")
    assert [r.embedding for r in memory.decode_vectors(blobs).collect()] == [[1.5, -2.0], None]


def test_origins_and_filters(spark):
    terms = spark.createDataFrame([("ai", True, "x", "y"), (None, True, None, "y"), (None, False, "y", "y")], "origin string, auto_detected boolean, proposed_term string, target_term string")
    assert [(r.shown_origin, r.changed_proposal) for r in glossary.origin_of(terms).collect()] == [("ai", True), ("scan", False), ("manual", False)]
    pages = spark.createDataFrame([("ocr", "A1.png"), ("checked", "a2.png"), ("checked", "b.png")], "stage string, file_name string")
    assert [r.file_name for r in catalog.page_filter(pages, ["ocr"], "A").collect()] == ["a2.png"]
    readings = spark.createDataFrame([("one two", "one two three"), ("one two", "xx yy zz"), ("one two", "one"), ("ONE, SQUADRON", "one squadrom !? three")], "old_text string, new_text string")
    assert [r.c for r in readings.select(ocr.more_complete().alias("c")).collect()] == [True, False, False, True]


def test_quota_days_follow_summer_time(spark):
    at = [datetime(2024, 7, 1, 6, 30), datetime(2024, 7, 1, 7, 30), datetime(2024, 1, 1, 7, 30)]
    rows = spark.createDataFrame([(p, "k", "m", "success", t) for p in ("gemini", "other") for t in at], "provider string, key_id string, model string, kind string, at timestamp")
    got = sorted((r.provider, str(r.window.start)[:10], r.requests) for r in jobs.key_usage_by_day(rows).collect())
    assert got == [("gemini", "2023-12-31", 1), ("gemini", "2024-06-30", 1), ("gemini", "2024-07-01", 1), ("other", "2024-01-01", 1), ("other", "2024-07-01", 2)]


def test_reuse_counts_take_all_entries_that_a_log_names(spark, tmp_path):
    logs = spark.createDataFrame([("memory_injected", 1, '{"correction_ids":[1,2]}'), ("memory_injected", 3, None), ("zero_shot", 9, None)], "variant string, matched_correction_id long, injection_json string")
    assert sorted((r.correction_id, r.reuse_count) for r in jobs.reuse_counts(logs).collect()) == [(1, 1), (2, 1), (3, 1)]


def test_enriched_batches_have_terms(spark, tmp_path):
    bubbles = spark.createDataFrame([(1, "Wyverns!"), (1, "wait"), (2, "wyvern")], "project_id int, text string")
    memory_rows = spark.createDataFrame([(5, 1, "Wait!", "czekaj")], "id long, project_id int, source_text string, final_translation string")
    terms = spark.createDataFrame([(1, 1, "WYVERN", "wywern")], "id int, project_id int, source_term string, target_term string")
    bubbles.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(bubbles.schema).parquet(f"{tmp_path}/in")
    jobs.enrich_batches(stream, memory_rows, terms, f"{tmp_path}/out", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = {(r.project_id, r.text): (r.final_translation, [t.target_term for t in r.terms]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(1, "Wyverns!"): (None, ["wywern"]), (1, "wait"): ("czekaj", []), (2, "wyvern"): (None, [])}


def test_carry_over_of_all_fields(spark):
    schema = "page_id long, pos int, bubble_id string, text string, text_raw string, translation string, ai_translation string, skip boolean, skip_reason string, confirmed_translation string, confirmed_at timestamp, confirmed_via string, layout string, no_auto_erase boolean, bulk_edits array<string>"
    old = [
        (1, 0, "b1", "UNIT ONE", "LNIT ONE", "jednostka", "jedn", False, None, "jednostka", T0, "page", "L", True, ["e"]),
        (1, 1, "b2", "Same", None, "pierwszy", None, False, None, "inny", T0, "page", None, None, None),
        (1, 2, "b3", "same!", None, "drugi", "d", False, None, None, None, None, None, None, None),
        (1, 3, "b4", "boom", None, "", None, True, "manual", None, None, None, None, None, None),
        (1, 4, "b5", "nothing", None, " ", None, False, None, None, None, None, None, None, None),
    ]
    new = [(1, 0, "lnit one"), (1, 1, "SAME"), (1, 2, "same"), (1, 3, "same"), (1, 4, "BOOM"), (1, 5, "nothing"), (2, 0, "same")]
    rows = ocr.carry_over(spark.createDataFrame(old, schema), spark.createDataFrame(new, "page_id long, pos int, text string"))
    got = {(r.page_id, r.pos): r for r in rows.collect()}
    r = got[1, 0]
    assert (r.text, r.text_raw, r.translation, r.ai_translation, r.confirmed_translation, r.confirmed_via, r.layout, r.no_auto_erase, r.bulk_edits) == ("UNIT ONE", "LNIT ONE", "jednostka", "jedn", "jednostka", "page", "L", True, ["e"])
    r = got[1, 1]
    assert (r.old_pos, r.translation, r.ai_translation, r.confirmed_translation, r.confirmed_via) == (1, "pierwszy", "pierwszy", None, None)
    assert got[1, 2].old_pos == 2 and got[1, 3].old_pos is None and got[1, 3].translation is None
    assert (got[1, 4].skip, got[1, 4].skip_reason, got[1, 4].translation) == (True, "manual", None)
    assert got[1, 5].old_pos is None and got[2, 0].old_pos is None


def brute_layout(page, width):
    """Lines and bubbles of one page, word by word, as the rules are written: no arrays."""
    words = sorted(page, key=lambda w: (w["y1"] + w["y2"], w["pos"]))
    for w in words:
        w["cx"], w["cy"], w["w"], w["h"] = (w["x1"] + w["x2"]) / 2, (w["y1"] + w["y2"]) / 2, max(1.0, w["x2"] - w["x1"]), max(1.0, w["y2"] - w["y1"])
    level = lambda a, b: abs(a["cy"] - b["cy"]) <= max(5.0, 0.3 * min(a["h"], b["h"]))
    sets = [{k} for k in range(len(words))]

    def tie(i, j):
        if sets[i] is not sets[j]:
            sets[i] |= sets[j]
            for k in sets[j]:
                sets[k] = sets[i]

    for i, a in enumerate(words):
        for j in range(i + 1, min(i + 15, len(words))):
            b = words[j]
            gap = b["y1"] - a["y2"]
            if gap > 150:
                break
            shared = max(0.0, min(a["x2"], b["x2"]) - max(a["x1"], b["x1"])) / min(a["w"], b["w"])
            if gap >= -0.5 * min(a["h"], b["h"]) and (shared >= 0.35 or abs(a["cx"] - b["cx"]) <= 0.6 * max(a["w"], b["w"])):
                tie(i, j)
    columns = sorted({min(s): sorted(s) for s in sets if len(s) > 1}.items())

    def partner(i, others):
        a = words[i]
        return any(
            level(a, words[o]) and min(a["h"], words[o]["h"]) >= 0.7 * max(a["h"], words[o]["h"])
            and max(words[o]["x1"] - a["x2"], a["x1"] - words[o]["x2"]) <= 0.3 * min(a["h"], words[o]["h"]) for o in others
        )

    joined = []
    for n, (_, s) in enumerate(columns):
        for _, t in columns[n + 1 :]:
            small, big = (s, t) if len(s) <= len(t) else (t, s)
            if all(partner(i, big) for i in small):
                joined.append((small[0], big[0]))
    for i, j in joined:
        tie(i, j)
    for i, w in enumerate(words):
        w["stream"] = min(sets[i]) if len(sets[i]) > 1 else -1
    rows = []
    for w in words:
        home = next((r for r in rows if level(w, r[-1])), None)
        home.append(w) if home is not None else rows.append([w])
    lines = []
    for row in rows:
        row.sort(key=lambda w: w["x1"])
        limit = min(3 * sum(w["w"] for w in row) / len(row), 0.05 * width)
        parts = [[row[0]]]
        for a, b in zip(row, row[1:]):
            if b["x1"] - a["x2"] > limit or a["stream"] != b["stream"] and min(a["stream"], b["stream"]) >= 0:
                parts.append([])
            parts[-1].append(b)
        for p in parts:
            known = [w["stream"] for w in p if w["stream"] >= 0]
            box = [min(w["x1"] for w in p), min(w["y1"] for w in p), max(w["x2"] for w in p), max(w["y2"] for w in p)]
            lines.append({"text": " ".join(w["text"] for w in p), "score": sum(w["score"] for w in p) / len(p), "box": box, "stream": Counter(known).most_common(1)[0][0] if known else -1})
    groups = []
    for line in sorted((x for x in lines if x["score"] >= 0.7), key=lambda x: x["box"][1] + x["box"][3]):
        x1, y1, x2, y2 = line["box"]
        best = None
        for g in groups:
            streams = [x["stream"] for x in g if x["stream"] >= 0]
            stream = Counter(streams).most_common(1)[0][0] if streams else -1
            if stream != line["stream"] and min(stream, line["stream"]) >= 0:
                continue
            gx1, gy1, gx2, gy2 = (f(x["box"][k] for x in g) for k, f in enumerate((min, min, max, max)))
            gap, most = y1 - gy2, min(120.0, 1.5 * max(1.0, gy2 - gy1))
            if gap >= most or gap >= 3 * max(median(max(1.0, x["box"][3] - x["box"][1]) for x in g), max(1.0, y2 - y1)):
                continue
            w, gw = max(1.0, x2 - x1), max(1.0, gx2 - gx1)
            over = max(0.0, min(x2, gx2) - max(x1, gx1))
            share = over / max(1.0, w + gw - over)
            if w < 0.4 * gw or gw < 0.4 * w:
                share = max(share, over / w, over / gw)
            apart = abs((x1 + x2) / 2 - median((x["box"][0] + x["box"][2]) / 2 for x in g))
            if share <= 0.35 or apart >= 0.45 * (w + gw):
                continue
            score = 0.6 * gap / max(1.0, most) + 0.4 * apart / max(1.0, 0.45 * (w + gw))
            if best is None or score < best[0]:
                best = (score, g)
        best[1].append(line) if best else groups.append([line])
    return [x["text"] for x in lines], [" ".join(x["text"] for x in g) for g in groups]


def test_layout_against_the_rules_word_by_word(spark):
    rng, rows = random.Random(4), []
    for page in range(40):
        n = rng.randrange(1, 45)
        for pos in range(n):
            x, y, w, h = rng.randrange(0, 700), rng.randrange(0, 22) * 26 + rng.randrange(-6, 7), rng.randrange(8, 160), rng.choice((18, 20, 24, 60))
            rows.append((page, pos, str(pos), f"w{pos}", rng.choice((0.5, 0.8, 0.9, 0.99)), 0, box(x, y, x + w, y + h)))
    df = spark.createDataFrame(rows, ITEMS)
    lines, bubbles = ocr.build_text_lines(df, image_width=900.0), ocr.group_bubbles(df, image_width=900.0)
    got_lines, got_bubbles = defaultdict(list), defaultdict(list)
    for r in lines.orderBy("page_id", "line_no").collect():
        got_lines[r.page_id].append(r.text)
    for r in bubbles.orderBy("page_id", "bubble_no").collect():
        got_bubbles[r.page_id].append(r.text)
    for page in range(40):
        own = [{"pos": r[1], "text": r[3], "score": r[4], "x1": r[6][0][0], "y1": r[6][0][1], "x2": r[6][2][0], "y2": r[6][2][1]} for r in rows if r[0] == page]
        want = brute_layout(own, 900.0)
        assert (got_lines[page], got_bubbles[page]) == want, page


def test_tilted_lines_have_a_slanted_box(spark):
    slant = [[0.0, 0.0], [100.0, 50.0], [91.0, 68.0], [-9.0, 18.0]]
    rows = [(1, 0, "a", "MAP", 0.9, 0, slant), (1, 1, "b", "LEVEL", 0.9, 0, box(0, 70, 90, 90)), (1, 2, "c", "183", 0.9, 0, box(0, 160, 60, 180))]
    got = {r.text: r for r in ocr.build_text_lines(spark.createDataFrame(rows, ITEMS)).collect()}
    assert got["MAP"].angle == 26.6 and got["LEVEL"].angle == 0 and [list(map(round, p)) for p in got["MAP"].box] == [[0, 0], [100, 50], [91, 68], [-9, 18]]
    assert len(ocr.group_bubbles(spark.createDataFrame(rows, ITEMS)).collect()) == 3


def test_rescue_keeps_all_columns_and_the_best_lines(spark):
    tall = [(1, k, 0.01 * k, box(40 * k, 0, 40 * k + 10, 60)) for k in range(15)]
    lines = [(1, 20 + k, 0.2 + 0.04 * k, box(0, 100 + 30 * k, 90, 120 + 30 * k)) for k in range(16)] + [(1, 99, 0.9, box(0, 800, 90, 807))]
    df = spark.createDataFrame(tall + lines, "page_id long, id long, score double, box array<array<double>>")
    taken = spark.createDataFrame([(1, box(0, 0, 12, 70))], "page_id long, box array<array<double>>")
    got = sorted((r.kind, r.id) for r in ocr.rescue_candidates(df, taken).collect())
    assert got == [("line", 20 + k) for k in range(4, 16)] + [("stacked", k) for k in range(1, 15)]


def test_payload_shows_rejected_drafts_and_context(spark):
    b = spark.createDataFrame([(1, 0, "b1", "HELLO THERE MY FRIEND", False), (1, 1, "b2", "wait", False)], "page_id long, pos int, bubble_id string, text string, skip boolean")
    ex = spark.createDataFrame([(1, "b1", 1, "HELLO YOU", "witaj", 0.712, "corrected", "czesc")], "page_id long, bubble_id string, rank int, en string, pl string, similarity double, kind string, draft string")
    exact = spark.createDataFrame([(1, "b2", "czekaj")], "page_id long, bubble_id string, exact string")
    none = spark.createDataFrame([], "page_id long, bubble_id string, glossary array<string>")
    around = spark.createDataFrame([(1, 9, "b9", "before", False), (1, 8, "b8", " ", False)], "page_id long, pos int, bubble_id string, text string, skip boolean")
    got = json.loads(replay.build_payload(b, ex, exact, none, context=around).first().payload)
    assert [r["bubble_id"] for r in got] == ["b9", "b1", "b2"] and got[0]["context_only"] is True and got[2]["exact"] == "czekaj"
    assert got[1]["examples"] == [{"rank": 1, "en": "HELLO YOU", "pl": "WITAJ", "similarity": 0.71, "kind": "corrected", "rejected": "CZESC"}]
    plain = json.loads(replay.build_payload(b, ex, exact, none, memory_fields=False).first().payload)
    assert all("examples" not in r and "exact" not in r for r in plain)


def test_memory_used_resolves_entries(spark):
    logs_ = [
        (1, "r1", "zero_shot", 7, "b1", "HELLO  there", None, None, None, None), (2, "r1", "memory_injected", 7, "b1", "hello there", '{"lane":"fuzzy","examples":[{"en":"Hi","pl":"cz"},{"en":"Yo!","pl":"y"}],"correction_ids":[50]}', None, None, 50),
        (3, "r2", "memory_injected", 7, "b2", "other", '{"exact":"inne"}', None, "exact", 51), (4, "r3", "zero_shot", 7, "b4", "gone text", None, None, None, None),
    ]
    l = spark.createDataFrame(logs_, "id long, run_id string, variant string, page_id long, bubble_id string, source_text string, injection_json string, hints_json string, memory_lane string, matched_correction_id long")
    c = spark.createDataFrame([(50, 1, "hi", "czesc", None), (51, 1, "other", "inne teraz", "approved"), (52, 1, "yo", "hej", None), (53, 2, "yo", "nie", None)], "id long, project_id int, source_text string, final_translation string, kind string")
    b = spark.createDataFrame([(7, "b1", 1, "Hello There"), (7, "b3", 1, "OTHER"), (7, "b4", 1, "new text"), (7, "b5", 1, "never")], "page_id long, bubble_id string, project_id int, text string")
    got = {r.bubble_id: r for r in logs.memory_used(b, l, c).collect()}
    assert set(got) == {"b1", "b3", "b4"} and got["b4"].stale and not got["b1"].stale
    assert [(e.correction_id, e.en, e.pl_now) for e in got["b1"].entries] == [(50, "Hi", "czesc"), (52, "Yo!", "hej")]
    assert [(e.correction_id, e.pl_shown, e.pl_now, e.kind) for e in got["b3"].entries] == [(51, "inne", "inne teraz", "approved")] and got["b3"].lane == "exact"


def test_history_orders(spark):
    schema = "run_id string, chapter string, file_name string, number int, base struct<id:long,created_at:timestamp,source_text:string>, shown struct<model_used:string,key_label:string,injection:struct<temperature:double>>, status_rank int, hint_rank int"
    rows = [(f"r{k}", f"Chapter_{c}", f"{f}.png", n, (k, T0 + timedelta(days=k % 2), f"line {k}"), (f"m{9 - k}", "k", (None if k == 2 else 0.1 * k,)), k % 3, k % 2) for k, (c, f, n) in enumerate([(10, 1, 1), (9, 2, 1), (9, 1, 2), (9, 1, 1)])]
    df = spark.createDataFrame(rows, schema)
    order = lambda key, **s: [r.run_id for r in logs.history_sort(df, key, **s).collect()]
    by = {k: {r.run_id: (r.group_label, r.group_rows) for r in logs.history_sort(df, k).collect()} for k in ("where", "time", "model")}
    assert set(order("where", n=2)) == {"r3", "r2"} and set(order("model", n=1)) == {"r3"} and set(order("temperature", n=3)) == {"r0", "r1", "r3"}
    assert by["where"]["r0"] == ("Chapter_10", 1) and by["where"]["r1"] == ("Chapter_9", 3) and by["time"]["r0"] == ("2024-01-01", 2) and by["model"]["r0"][0] is None


def test_stage_groups_and_sorts(spark):
    counts = spark.createDataFrame([(1, 2, 3, 4, 1)], "project_id int, reviewed long, checked long, exported long, exported_checked long")
    assert progress.stage_groups(counts).first().asDict() == {"project_id": 1, "reviewed": 5, "checked": 4, "exported": 0, "exported_checked": 1, "reviewed_pages": 9}
    assert progress.stage_groups(counts, True).first().exported == 4
    ch = spark.createDataFrame([(1, "Chapter_10", 0.1, 5), (2, "Chapter_9", 0.9, 1), (3, "Epilog", 0.5, 9)], "id int, title string, done_score double, reviewed_pages int")
    ids = lambda **s: [r.id for r in catalog.chapter_sort(ch, **s).collect()]
    assert ids() == [2, 1, 3] and ids(by="progress") == [2, 3, 1] and ids(by="reviewed", descending=False) == [2, 1, 3] and ids(by="name") == [2, 1, 3]


def test_examples_do_not_depend_on_blocks(spark, sf_dir):
    q, m = view(spark, sf_dir, "query_vectors"), view(spark, sf_dir, "memory_vectors").withColumn("first_id", F.col("id"))
    run = lambda **s: sorted((r.query_id, r.rank, r.correction_id) for r in memory.top_examples(memory.block_examples(q, m, 0.2, 3, **s).join(m.select(F.col("id").alias("correction_id"), "first_id", "final_translation"), "correction_id"), 3).collect())
    assert run() == run(block_rows=7, query_rows=3)
