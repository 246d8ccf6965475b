"""Joins that replace all pairs: substrings, glossary terms, time ranges; each against plain loops."""

import random
from datetime import timedelta

import pytest

from tests.core.test_operators import T0
from tmspark.operators import glossary, replay
from tmspark.operators.substrings import holding


def test_texts_that_hold_short_strings(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))) for _ in range(120)] + [None, "", "zażółć", "abc" * 9]
    needles = ["a", "ab", "abc", "cab", "abcabc", "b c", "żół", "zzz", "", None, "c" * 5] + ["".join(rng.choice("abc ") for _ in range(4)) for _ in range(30)]
    lines = spark.createDataFrame([(1 + k % 2, k, t) for k, t in enumerate(texts)], "p int, k int, t string")
    wanted = spark.createDataFrame([(1 + k % 2, n) for k, n in enumerate(needles)], "p int, n string")
    got = sorted((r.k, r.n) for r in holding(lines, wanted, ["p"], "t", "n").collect())
    want = {(k, n) for k, t in enumerate(texts) for j, n in enumerate(needles) if t is not None and n and j % 2 == k % 2 and n in t}
    assert got == sorted(want)
    plan = holding(lines, wanted, ["p"], "t", "n")._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("most", [20_000, 0])
def test_glossary_by_automaton_and_by_words(spark, most):
    rng = random.Random(9)
    words = ["the", "wyvern", "knights", "qua", "toyne", "flag", "o'brien", "dragoons", "boss", "gas", "élan"]
    terms = [" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(60)] + ["QUA-TOYNE", "the the", "?!", "-", "DRAGOONS", "a-b", "C++"]
    texts = [rng.choice([" ", "- ", "-", "  "]).join(rng.choice([w, w + "s", w + "'s", w + "es", w.upper()]) for w in rng.choices(words, k=rng.randint(0, 9))) for _ in range(150)]
    texts += [None, "", "c++ and a-b", "WYVERNLIKE", "Qua -  Toyne!", "ÉLAN"]
    g = spark.createDataFrame([(k, 1 + k % 2, t, f"t{k}") for k, t in enumerate(terms)], "id int, project_id int, source_term string, target_term string")
    rows = spark.createDataFrame([(k, 1 + k % 2, t) for k, t in enumerate(texts)], "k int, project_id int, text string")
    got = {r.k: [(m.source_term, m.target_term) for m in r.matches] for r in glossary.match_glossary(rows, g, most_terms=most).collect()}
    import re

    for k, t in enumerate(texts):
        left, want = t, []
        for n, term in sorted(((n, x) for n, x in enumerate(terms) if n % 2 == k % 2 and re.search(r"\w", x)), key=lambda x: (-len(x[1]), x[0])):
            parts = [p for p in re.split(r"[\s-]+", term) if p]
            if len(parts[-1]) > 3 and re.search("[^sS][sS]$", parts[-1]):
                parts[-1] = parts[-1][:-1]
            pattern = r"(?<![^\W])" + r"(?:\s*-\s*|\s+)".join(map(re.escape, parts)) + r"(?:['’]?s|es)?(?!\w)"
            if left and re.search(pattern, left, re.I):
                left = re.sub(pattern, "\1", left, flags=re.I)
                want.append((term, f"t{n}"))
        assert got[k] == want, (t, got[k], want)


def test_terms_that_begin_alike_meet_by_their_rarest_word(spark):
    terms = spark.createDataFrame([(k, 1, f"THE name{k}", "x") for k in range(50)], "id int, project_id int, source_term string, target_term string")
    texts = spark.createDataFrame([(k, 1, f"the name{k % 60} and the rest") for k in range(300)], "k int, project_id int, text string")
    got = glossary.match_glossary(texts, terms, most_terms=0)
    assert sum(len(r.matches) for r in got.collect()) == sum(k % 60 < 50 for k in range(300))
    wanted = glossary._by_words(texts, terms.selectExpr("*", "source_term AS plain", "source_term AS pattern"))
    assert all(len(r._terms) <= 1 for r in wanted.collect())  # not the 50 that share THE


def test_support_of_proposed_terms(spark):
    c = spark.createDataFrame(
        [(1, 1, "THE WYVERN FLIES", "WYWERNY LATAJA"), (2, 1, "A wyvern!", "to jest WYWERNA"), (3, 1, "WYVERNS", "smoki"), (4, 1, "FLAG", "flaga"), (5, 2, "WYVERN", "wywerna")],
        "id long, project_id int, source_text string, final_translation string",
    )
    p = spark.createDataFrame(
        [(1, 1, "WYVERN", "WYWERNA"), (2, 1, "wyvern", "other"), (4, 1, "Flag", "banner"), (4, 1, "ship", "statek"), (9, 1, "THE", "ten"), (3, 1, " ", "x"), (3, 1, "WYVERNS", " "), (5, 2, "WYVERN", "WYWERNA")],
        "id long, project_id int, source_term string, target_term string",
    )
    known = spark.createDataFrame([(2, " wyvern ")], "project_id int, source_term string")
    got = sorted((r.project_id, r.source_term, r.target_term, r.support) for r in glossary.rank_extracted_terms(p, c, known).collect())
    # All inflected forms count; a term without any support counts once; reworded, known, repeated and blank ones go.
    assert got == [(1, "Flag", "banner", 1), (1, "WYVERN", "WYWERNA", 2)]


def test_suggestions_that_a_saved_line_holds(spark):
    s = spark.createDataFrame([(1, "WIVERN"), (1, "KNIGHT"), (2, "WIVERN")], "project_id int, term string")
    saved = spark.createDataFrame([(1, "the wiverns fly"), (1, None), (2, "nothing")], "project_id int, source_text string")
    assert [(r.project_id, r.term) for r in glossary.suggestions_for(s, saved).collect()] == [(1, "WIVERN")]


def test_saved_lines_are_searched_by_their_distinct_runs_of_letters(spark, monkeypatch):
    s = spark.createDataFrame([(1, "WIVERN"), (1, "KNIGHT"), (1, "STRASSE"), (2, "WIVERN")], "project_id int, term string")
    saved = spark.createDataFrame([(1, f"the wiverns fly, {k} Straßen") for k in range(9)] + [(1, "kni ght"), (2, "a wi-vern")], "project_id int, source_text string")
    searched, holding = [], glossary.holding
    monkeypatch.setattr(glossary, "holding", lambda lines, *rest: searched.extend(lines.collect()) or holding(lines, *rest))
    assert sorted((r.project_id, r.term) for r in glossary.suggestions_for(s, saved).collect()) == [(1, "STRASSE"), (1, "WIVERN")]
    assert sorted(r["_line"] for r in searched if r.project_id == 1) == ["FLY", "GHT", "KNI", "STRASSEN", "THE", "WIVERNS"]


def test_eligible_entries_by_time_ranges(spark):
    rng = random.Random(12)
    entries = []
    for k in range(1, 141):
        at = T0 + timedelta(seconds=rng.randint(0, 60) if k % 2 else rng.randint(0, 10**7), microseconds=rng.choice([0, 1, 500_000]))
        entries.append((k, rng.choice([1, 2]), rng.choice(["Wait!", "wait", "NO", "line here", "?!", "..."]), rng.choice([None, 1, 2, 3, 4]), at))
    pages = [(p, rng.choice([1, 2]), rng.choice([e[4] for e in entries]) + timedelta(microseconds=rng.choice([-1, 0, 1]))) for p in range(1, 30)]
    c = spark.createDataFrame(entries, "id long, project_id int, source_text string, page_id long, created_at timestamp")
    got = replay.eligible_examples(spark.createDataFrame(pages, "page_id long, project_id int, first_at timestamp"), c)
    want = set()
    for page, project, first in pages:
        newest = {}
        for k, own, source, on, at in entries:
            key = "".join(x for x in source.lower() if x.isalnum() or x == " ").strip() or source
            if own == project and at < first and (on is None or on != page):
                newest[key] = max(newest.get(key, 0), k)
        want |= {(page, k) for k in newest.values()}
    assert sorted((r.page_id, r.id) for r in got.collect()) == sorted(want)
