"""Golden cases of the rules that the reference's lines state: scores, limits, progress, reconciling, order, documents."""

import random
from collections import Counter
from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.core.test_operators import T0
from tmspark.functions import helpers
from tmspark.operators import catalog, logs, memory, ocr, progress, replay
from tmspark.sources import io


def test_edit_rate_ignores_case_and_counts_shifts():
    assert helpers.ter_score("THE CAT SAT", "the cat sat") == 0
    assert helpers.ter_score("sat the cat", "the cat sat") == pytest.approx(1 / 3)  # one block moves
    assert helpers.ter_score("a b", "") == 1 and helpers.ter_score("", "") == 0 and helpers.ter_score("", "a b") == 1


def test_scores_are_worked_out_once_a_pair_over_arrays():
    rng = random.Random(4)
    for most, letters in ((3, 2), (40, 3), (40, 30), (60, 2000)):
        a, b = ([rng.randrange(letters) for _ in range(rng.randint(0, most))] for _ in range(2))
        want = []
        for n in range(1, 7):
            x, y = (Counter(tuple(t[k : k + n]) for k in range(len(t) - n + 1)) for t in (a, b))
            want.append((sum((x & y).values()), sum(x.values()), sum(y.values())))
        assert helpers.shared_ngrams(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), 6) == want
    asked = []
    got = helpers._by_pair(lambda x, y: asked.append((x, y)) or len(x), pd.Series(["aa", "aa", None]), pd.Series(["b", "b", "b"]), "int32")
    assert list(got) == [2, 2, 0] and asked == [("aa", "b"), ("", "b")]


def test_chrf_averages_precision_and_recall_over_the_orders_of_both():
    assert helpers.marks_apart('"Wait," he said... (x) ? don\'t') == ['"Wait,', '"', "he", "said..", ".", "(x", ")", "?", "don't"]
    recall = (6 / 9 + 5 / 8 + 4 / 7 + 3 / 6 + 2 / 5 + 1 / 4 + 2 / 3 + 1 / 2) / 8
    assert helpers.chrf_score("the cat", "the cat sat") == pytest.approx(500 * recall / (4 + recall))
    # Orders that the shorter text lacks don't count: two characters and one word here.
    precision, recall = (1 + 1 + 1) / 3, (2 / 3 + 1 / 2 + 0) / 3
    precision = (1 + 1 + 0) / 3
    assert helpers.chrf_score("ab", "abc") == pytest.approx(500 * precision * recall / (4 * precision + recall))


def test_a_blank_latest_output_hides_older_ones(spark):
    rows = [(1, "b", "A0", 1, "old"), (1, "b", "A0", 2, " "), (1, "c", "A0", 1, "kept")]
    out = replay.latest_outputs(spark.createDataFrame(rows, "page_id long, bubble_id string, variant string, seq long, final string"))
    assert [(r.bubble_id, r.final) for r in out.collect()] == [("c", "kept")]


def test_edit_rate_of_drafts_and_bulk_edits(spark):
    schema = "page_id long, bubble_id string, translation string, ai_translation string, confirmed_translation string, confirmed_via string, skip boolean, bulk_edits array<string>"
    rows = [(1, "a", "the cat sat", "sat the cat", None, None, False, ["e"]), (1, "b", "one two", "ONE two", None, None, False, None), (1, "c", "new text", "", None, None, False, None)]
    effort = progress.bubble_effort(spark.createDataFrame(rows, schema), shifts=True)
    got = {r.subset: r for r in progress.translation_effort(effort).collect()}["all"]
    assert got.hter_pct == pytest.approx(100 * 1 / 5) and got.bulk_edited == 1 and got.bubbles == 3
    assert progress.translation_effort(progress.bubble_effort(spark.createDataFrame(rows, schema))).first().hter_pct is None


def test_limits_of_minutes_and_days_are_apart(spark):
    schema = "provider string, key_id string, model string, kind string, daily boolean, limit_value int, left_value int, at timestamp"
    hour = lambda h: T0 + timedelta(hours=h)
    ok = lambda key, h: ("x", key, "m", "success", None, None, None, hour(h))
    rows = [ok("minute", 1), ("x", "minute", "m", "limit", False, 5, None, hour(2))]
    rows += [ok("guess", 1), ok("guess", 2), ("x", "guess", "m", "limit", True, None, None, hour(3)), ok("guess", 25)]
    rows += [("x", "named", "m", "server_counts", None, 9, None, hour(1)), ("x", "named", "m", "limit", True, None, None, hour(2)), ok("named", 25)]
    rows += [("x", "left", "m", "server_counts", None, 9, 7, hour(25)), ok("left", 26), ("x", "today", "m", "limit", True, 4, None, hour(26))]
    got = {r.key_id: (r.limit_day, r.limit_source, r.limit_minute, r.left, r.exhausted) for r in logs.key_usage(spark.createDataFrame(rows, schema), hour(30)).collect()}
    assert got == {
        "minute": (None, None, 5, None, False), "guess": (2, "estimate", None, 1, False), "named": (9, "server", None, 8, False),
        "left": (9, "server", None, 7, False), "today": (4, "server", None, 0, True),
    }


def test_progress_of_pages_that_are_not_read(spark):
    schema = "page_id long, project_id int, status string, layout_checked_at timestamp, updated_at timestamp"
    pages = spark.createDataFrame([(1, 1, "pending", None, T0), (2, 1, "processed", None, T0), (3, 1, "excluded", None, T0), (4, 1, "processed", None, T0)], schema)
    bubbles = spark.createDataFrame([(2, "draft", "draft", None, None, False)], "page_id long, translation string, ai_translation string, confirmed_translation string, confirmed_via string, skip boolean")
    exports = spark.createDataFrame([(2, T0), (1, T0), (4, T0)], "page_id long, at timestamp")
    r = progress.project_progress(progress.page_progress(progress.page_stage(pages, bubbles), exports)).first()
    assert (r.total, r.other, r.processed, r.text_reviewed, r.translated, r.exported, r.exported_draft) == (3, 1, 2, 1, 1, 1, 1)


def test_reconcile_warns_of_missing_pages_and_removes_vanished_chapters(spark):
    c = spark.createDataFrame([("a", "1", "processed"), ("a", "2", "pending"), ("gone", "1", "excluded"), ("left", "1", "pending")], "chapter string, name string, status string")
    disk = [("a", "1", True, True), ("a", "3", True, True), ("left", "1", False, True)]
    got = catalog.reconcile(c, spark.createDataFrame(disk, "chapter string, name string, raw boolean, processed boolean"))
    assert sorted((r.chapter, r.name, r.action, r.new_status) for r in got.collect()) == [
        ("a", "1", "keep", None), ("a", "2", "warn", None), ("a", "3", "add", "processed"), ("gone", "1", "remove", None), ("left", "1", "warn", None),
    ]
    offline = catalog.reconcile(c, spark.createDataFrame([], "chapter string, name string, raw boolean, processed boolean"))
    assert {r.action for r in offline.collect()} == {"keep"}


def test_memory_view_in_polish_order(spark):
    finals = ["luk", "Łuk", "lza", "Zebra", "ćma", "cykl", "CZAS", "mak"]
    rows = [(k, "s", t, "approved" if k % 3 == 0 else None, k, T0 - timedelta(days=k)) for k, t in enumerate(finals)]
    c = spark.createDataFrame(rows, "id long, source_text string, final_translation string, kind string, reuse_count int, created_at timestamp")
    shown = lambda sort: [r.final_translation for r in memory.memory_view(c, sort=sort).collect()]
    assert shown("text_asc") == ["cykl", "CZAS", "ćma", "luk", "lza", "Łuk", "mak", "Zebra"]
    assert shown("newest")[0] == "luk" and shown("oldest")[0] == "mak"
    kinds = [r.kind for r in memory.memory_view(c, sort="kind_asc").collect()]
    assert kinds == ["corrected"] * 5 + ["approved"] * 3


def test_plausible_texts(spark):
    zipf = spark.createDataFrame([("hello", 5.0), ("there", 2.2), ("rare", 1.9)], "word string, zipf double")
    texts = ["?！", "!!!!!", "I", "a", '"Hello," xqz', "hello zz yy", "there", "rare", "12 hello", "hello-there"]
    items = spark.createDataFrame([(str(k), t, 0.8) for k, t in enumerate(texts)] + [("s", "zz", 0.9), ("l", "hello", 0.6)], "id string, text string, score double")
    assert {r.text for r in ocr.text_threshold(items, zipf).collect()} == {"?！", "I", '"Hello," xqz', "there", "12 hello", "zz"}


def test_page_documents_round_trip_and_unreadable_ones(spark, tmp_path):
    import json
    import os

    for n in range(6):
        os.makedirs(f"{tmp_path}/in/ch{n % 2}", exist_ok=True)
        bubble = {"bubble_id": "bubble_1", "text": f"t{n}", "translation": "x", "ai_translation": "y", "layout": {"font": "f", "size": [1, 2.5]}, "merged_from": ["a", 2]}
        doc = {
            "items": [{"id": "i", "text": "w", "score": 0.5, "box": [[0, 1], [2, 1]], "rescued": True}], "bubbles": [bubble, bubble | {"skip": True, "text": "12"}],
            "lines": [], "manual_ops": [{"op": "merge", "at": "2024-01-01T00:00:00+00:00", "n": 2}], "bubble_order": "rtl",
            "ocr_debug": {"at": "2024-01-01T00:00:00+00:00", "threshold": 0.85, "slices": [[0, 10], [8, 20]], "rejected": [{"text": "r", "score": 0.1, "box": []}], "dropped": [{"text": "d", "why": "noise"}]},
        }
        with open(f"{tmp_path}/in/ch{n % 2}/{n:03}.json", "w") as f:
            json.dump(doc, f)
    with open(f"{tmp_path}/in/ch0/bad.json", "w") as f:
        f.write('{"items": [')
    first = io.read_page_json(spark, f"{tmp_path}/in/*/*.json")
    assert [(r.chapter, r.page, r.content) for r in first["unreadable"].collect()] == [("ch0", "bad", '{"items": [')]
    names = ["items", "lines", "manual_ops", "debug", "rejected", "slices", "meta"]
    io.write_page_json(first["bubbles"], f"{tmp_path}/out", **{n: first[n] for n in names})
    files = [f for _, _, fs in os.walk(f"{tmp_path}/out") for f in fs if f.endswith(".json")]
    assert len(files) == 6
    again = io.read_page_json(spark, f"{tmp_path}/out", folders=True)
    assert again["unreadable"].count() == 0
    for name in ["bubbles", *names]:
        plain = lambda t: sorted(map(str, t.select(F.to_json(F.struct(*[c for c in t.columns]))).collect()))
        want = first[name]
        if name == "bubbles":
            want = want.withColumns({c: F.when(F.coalesce("skip", F.lit(False)), "").otherwise(F.col(c)) for c in ("translation", "ai_translation")})
        assert plain(again[name].select(want.columns)) == plain(want), name
    assert {r.page for r in again["meta"].collect()} == {f"{n:03}" for n in range(6)}


def test_duplicates_within_a_line(spark):
    box = lambda x1, x2, y=0.0: [[x1, y], [x2, y], [x2, y + 20.0], [x1, y + 20.0]]
    rows = [
        (1, 0, "a", "hello world", 0.9, box(0.0, 110.0)), (1, 1, "b", "world bye", 0.8, box(60.0, 140.0)),  # the beginning goes
        (1, 2, "c", "say hello", 0.7, box(-60.0, 50.0)),  # the end goes
        (1, 3, "d", "hello", 0.6, box(0.0, 50.0)),  # nothing would be left
        (1, 4, "e", "hello", 0.5, box(500.0, 550.0)),  # far away: stays
        (1, 5, "f", "hello world", 0.4, box(0.0, 110.0, 5.0)),  # another line
        (2, 0, "a", "one two three four five six seven eight nine ten", 0.9, box(0.0, 100.0)), (2, 1, "b", "ten x1 x2 x3 x4 x5 x6 x7 x8 x9", 0.8, box(80.0, 180.0)),  # a tenth is shared
    ]
    items = spark.createDataFrame(rows, "page_id long, pos int, id string, text string, score double, box array<array<double>>")
    lines = spark.createDataFrame([(1, ["a", "b", "c", "d", "e"]), (1, ["f"]), (2, ["a", "b"])], "page_id long, word_ids array<string>")
    got = {(r.page_id, r.id): (r.text, r.trimmed, round(r.box[0][0], 3), round(r.box[1][0], 3)) for r in ocr.line_dedup(items, lines).collect()}
    assert got[1, "b"] == ("bye", True, 60 + 80 * 5 / 8, 140.0) and got[1, "c"] == ("say", True, -60.0, round(50 - 110 * 5 / 8, 3))
    assert (1, "d") not in got and got[1, "e"][:2] == ("hello", False) and got[1, "f"][:2] == ("hello world", False)
    assert got[2, "b"][:2] == ("x1 x2 x3 x4 x5 x6 x7 x8 x9", True)


def test_import_preview_equals_going_through_candidates_in_order(spark):
    import random

    rng = random.Random(5)
    rows = [(k, rng.choice(["A", "a", "B", "c", "D", "E", "f"]) + str(rng.randint(0, 5)), rng.choice([None, *map(str, range(30))])) for k in range(120)]
    rows += [(200, "x1", "p1"), (201, "X1", "p2"), (202, "x2", "p2"), (203, "x2", "p3"), (204, "x3", "p3"), (205, "x9", "p2")]  # refusals that free the next
    existing = [("A0", "7"), ("zz", None)]
    prints, labels, want = {"7"}, {"a0", "zz"}, {}
    for k, label, p in rows:
        want[k] = "duplicate" if p in prints and p is not None else "label_conflict" if label.lower() in labels else "new"
        if want[k] == "new":
            prints.add(p)
            labels.add(label.lower())
    got = catalog.import_preview(spark.createDataFrame(rows, "seq long, label string, fingerprint string"), spark.createDataFrame(existing, "label string, fingerprint string"))
    assert {r.seq: r.verdict for r in got.collect()} == want
