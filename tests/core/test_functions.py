"""Golden cases of the scalar functions and helpers."""

import pytest
from pyspark.sql import functions as F

from tmspark.functions import geometry as geo
from tmspark.functions import helpers, splitting, text
from tmspark.operators import repair


def one(spark, value, column):
    row = spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("r")).first()
    return row.r


def two(spark, a, b, column):
    return spark.createDataFrame([(a, b)], "a string, b string").select(column(F.col("a"), F.col("b")).alias("r")).first().r


@pytest.mark.parametrize("value, want", [("WAIT!", "wait"), ("Wait...", "wait"), ("  wait ", "wait"), ("?!", ""), (None, ""), ("ZAŻÓŁĆ, Gęś", "zażółć gęś")])
def test_normalize_phrase(spark, value, want):
    assert one(spark, value, text.normalize_phrase) == want


def test_lexical_overlap(spark):
    assert round(two(spark, "FLAG OF QUA-TOYNE PRINCIPALITY", "QUA-TOYNE PRINCIPALITY", text.lexical_overlap), 1) == 66.7
    assert two(spark, "the of", "a word", text.lexical_overlap) == 0.0


@pytest.mark.parametrize("value, want", [("11", "number"), ("9:55", "number"), ("3/4", "number"), ("?!", "symbols"), ("...", "symbols"), ("", "empty"), (None, "empty"), ("A1", None)])
def test_skip_reason(spark, value, want):
    assert one(spark, value, text.skip_reason) == want


@pytest.mark.parametrize(
    "value, want",
    [("chapter_13_5", "Chapter_13.5"), ("Eternal_Knight_Chapter_10", "Chapter_10"), ("013", "Chapter_13"), ("Epilog", "Epilog"), ("March 3", "March 3"), (None, "Chapter")],
)
def test_chapter_label(spark, value, want):
    assert one(spark, value, text.chapter_label) == want


def test_chapter_and_name_order(spark):
    rows = spark.createDataFrame([("Chapter_14",), ("Epilog",), ("Chapter_13.5",), ("Chapter_13",)], "x string")
    assert [r.x for r in rows.orderBy(text.chapter_sort_key(F.col("x"))).collect()] == ["Chapter_13", "Chapter_13.5", "Chapter_14", "Epilog"]
    rows = spark.createDataFrame([("10_a.jpg",), ("2_a.jpg",)], "x string")
    assert [r.x for r in rows.orderBy(text.natural_sort_key(F.col("x"))).collect()] == ["2_a.jpg", "10_a.jpg"]


def test_overlap_of_words(spark):
    assert two(spark, "Hello World", "World Bye", text.suffix_prefix_overlap) == ["world"]
    assert two(spark, "Hello", "World Bye", text.suffix_prefix_overlap) is None


def test_match_case(spark):
    assert two(spark, "WHAT IS IT", "zażółć", text.match_case) == "ZAŻÓŁĆ"
    assert two(spark, "What is it", "co", text.match_case) == "co"
    assert two(spark, "I", "ja", text.match_case) == "ja"


@pytest.mark.parametrize("said, want", [("WYWERNY", True), ("z wywernami", True), ("WYWERNIE", True), ("smok", False)])
def test_term_present(spark, said, want):
    row = spark.createDataFrame([("WYWERNA", said, "WYVERN")], "t string, s string, o string")
    assert row.select(text.term_present(F.col("t"), F.col("s"), F.col("o")).alias("r")).first().r is want


def test_term_of_another_stem_or_left_as_it_is(spark):
    row = spark.createDataFrame([("flota", "we flocie", "fleet"), ("QUA-TOYN", "do QUA-TOYNE", "QUA-TOYNE")], "t string, s string, o string")
    assert [r.r for r in row.select(text.term_present(F.col("t"), F.col("s"), F.col("o")).alias("r")).collect()] == [False, False]


@pytest.mark.parametrize(
    "a, b, want",
    [("gemini-2.5-flash", "models/gemini-2.5-flash-001", True), ("gemini-2.5-flash", "gemini-2.5-flash-lite", False), ("m", None, True), ("x/m", "m", True), ("m", "m-preview-05", True)],
)
def test_same_model(spark, a, b, want):
    assert two(spark, a, b, text.same_model) is want


def test_edit_status(spark):
    rows = [("Ala", "Ala", "unchanged"), ("Ala!", "ala", "minor"), ("Ala", "Ola", "edited"), ("", "Ola", "no_draft"), (None, "x", "no_draft")]
    got = spark.createDataFrame(rows, "a string, b string, w string").select(text.edit_status(F.col("a"), F.col("b")).alias("r"), "w").collect()
    assert all(r.r == r.w for r in got)


def test_rate_limits_and_quota_day(spark):
    r = one(spark, "quotaId GenerateRequestsPerDayPerProject, Please retry in 46.6s", lambda c: text.rate_limit_info(c, "status"))
    assert (r.daily, r.retry_seconds) == (True, 46.6)
    r = one(spark, "Rate limit on requests per day (RPD): Limit 1000", lambda c: text.rate_limit_info(c, "plain"))
    assert (r.daily, r.limit_value) == (True, 1000)
    day = spark.sql("select timestamp'2024-01-02 03:00:00' as t").select(text.quota_day(F.col("t"), F.lit("gemini")).cast("string").alias("p"), text.quota_day(F.col("t"), F.lit("o")).cast("string").alias("o")).first()
    assert (day.p, day.o) == ("2024-01-01", "2024-01-02")


def test_log_level(spark):
    assert tuple(one(spark, "INFO:     127.0.0.1", text.log_level)) == ("INFO", "127.0.0.1")
    assert one(spark, "\x1b[33mCareful\x1b[0m", text.log_level).level == "WARNING"
    assert one(spark, "Traceback", text.log_level).level == "ERROR"


def test_parse_utc(spark):
    got = [str(one(spark, t, text.parse_utc)) for t in ("2024-01-02T03:00:00+02:00", "2024-01-02 03:00:00", "2024-01-02T03:00:00Z", "x")]
    assert got == ["2024-01-02 01:00:00", "2024-01-02 03:00:00", "2024-01-02 03:00:00", "None"]


def test_geometry(spark):
    row = spark.sql("select array(array(0D,0D),array(10D,0D),array(10D,10D),array(0D,10D)) a, array(array(5D,5D),array(15D,5D),array(15D,15D),array(5D,15D)) b")
    a, b = geo.bbox(F.col("a")), geo.bbox(F.col("b"))
    got = row.select(geo.overlap_of_smaller(a, b), geo.gap(a, b), geo.same_line(a, b), geo.angle(F.col("a")), geo.contains_center(a, b)).first()
    assert list(got) == [0.25, 0.0, True, 0.0, True]


def test_helpers_distances():
    assert helpers.ratio("abcd", "abxd") == 75.0 and helpers.ratio("", "") == 100.0 and helpers.ratio("", "a") == 0.0
    assert helpers.levenshtein_tokens("a b c".split(), "a x c d".split()) == 2 and helpers.levenshtein_tokens([], ["a"]) == 1
    assert helpers.ter_score("a b c d", "a b c d") == 0 and helpers.ter_score("c d a b", "a b c d") == 0.25
    assert helpers.chrf_score("same text", "same text") == pytest.approx(100) and helpers.chrf_score("xyz", "abc") == 0


def test_word_diff():
    assert [(x["t"], x["type"]) for x in helpers.diff_tokens("a b c", "a x c")] == [("a", "same"), (" ", "same"), ("b", "del"), ("x", "ins"), (" ", "same"), ("c", "same")]


def test_word_diff_as_a_table_function(spark):
    spark.udtf.register("word_diff_rows", helpers.word_diff_table())
    got = spark.sql("select d.t, d.type from values ('a b', 'a x'), (null, 'y') as v(a, b), lateral word_diff_rows(v.a, v.b) d where type <> 'same'").collect()
    assert sorted(map(tuple, got)) == [("b", "del"), ("x", "ins"), ("y", "ins")]


def test_replacement_keeps_case_and_endings(spark):
    rows = spark.createDataFrame([("WIWERN, WIWERNY i Wiwernami",), (None,)], "x string")
    got = rows.select(helpers.replace_terms("wiwern", "wywern", "prefix")(F.col("x")).alias("p"), helpers.replace_terms("wiwern", "wywern")(F.col("x")).alias("w")).collect()
    assert (got[0].p, got[0].w) == ("WYWERN, WYWERNY i Wywernami", "WYWERN, WIWERNY i Wiwernami") and got[1].p is None


def test_letter_case_of_a_replacement():
    cases = {"wiwern": "wywern", "Wiwern": "Wywern", "WIWERN": "WYWERN", "wiWern": "WYWern", "123": "WYWern"}
    assert {k: helpers.with_case_of(k, "WYWern") for k in cases} == cases


def test_split_translation(spark):
    cases = [
        ("Co? To jest? Nie wiem.", ["WHAT... IS THIS?!", "I DON'T KNOW."], ["Co? To jest?", "Nie wiem."], "sentences"),
        ("Jest dziewiąta, ALE mam czas", ["IT IS NINE", "BUT I HAVE TIME"], ["Jest dziewiąta", "ALE mam czas"], "clauses"),
        ("Raz. Dwa dwa dwa dwa. Trzy. Cztery.", ["A LONG FIRST PIECE", "B"], ["Raz. Dwa dwa dwa dwa. Trzy.", "Cztery."], "proportional"),
        ("aaa, bbb – ccc, ddd", ["xxx", "yyy", "zzz"], ["aaa, bbb", "– ccc", "ddd"], "clauses"),
        ("Tak", ["YES", "NO"], ["Tak", ""], "unsplit"), (None, ["YES", "NO"], ["", ""], "unsplit"), ("Tak.", ["YES"], ["Tak."], "sentences"), ("Tak.", [], ["Tak."], "sentences"),
    ]
    rows = spark.createDataFrame([(k, c[0], c[1]) for k, c in enumerate(cases)], "id int, text string, sources array<string>")
    got = {r.id: (r.parts, r.method) for r in splitting.split_translation(rows, "text", "sources").collect()}
    assert [got[k] for k in range(len(cases))] == [(c[2], c[3]) for c in cases]


def test_repair(spark):
    zipf = {"squadron": 4.0, "unit": 5.0, "about": 6.0, "currently": 5.0, "so": 6.0, "called": 5.5, "current": 5.2, "time": 6.0}
    table = spark.createDataFrame(list(zipf.items()), "word string, zipf double")
    want = {
        "SQUAD- RON": "SQUADRON", "TH- THEN": "TH- THEN", "SO- CALLED": "SO-CALLED", "QUA- TOYNE": "QUA-TOYNE", "LNIT ABOLT": "UNIT ABOUT", "CUR- RENT- LY": "CURRENTLY",
        "squad- \nron's 'lnit'": "squadron's 'unit'", "": "", "A- B": "A- B",
    }
    rows = spark.createDataFrame([(t,) for t in want] + [(None,), ("SQUAD- RON",)], "text string")
    got = [(r.text, r.fixed) for r in repair.fix_ocr_text(rows, table, ["qua-toyne"]).collect()]
    assert sorted(got, key=str) == sorted([*want.items(), (None, ""), ("SQUAD- RON", "SQUADRON")], key=str)
    assert [r.memory_text for r in repair.memory_text(spark.createDataFrame([(" SQUAD-   RON  x ",)], "text string"), table).collect()] == ["SQUADRON x"]
    assert repair.fix_ocr_text(rows.limit(0), table).count() == 0


def test_torn_words_are_joined_from_left_to_right(spark):
    table = spark.createDataFrame([("zzbb", 4.0), ("bbcc", 4.0), ("us", 4.0)], "word string, zipf double")
    # A pair is where it was found: bb- cc is not torn out of zz- bb- cc because it is a pair elsewhere.
    texts = ["zz- bb- cc bb- cc", "zz- bb", "bb-  cc! bb- cc", "no- no", "x", None, "bb- cc " * 500]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: r.fixed for r in repair.fix_ocr_text(rows, table).collect()}
    assert got == dict(zip(texts, ["zzbb-cc bbcc", "zzbb", "bbcc! bbcc", "no- no", "x", "", "bbcc " * 500], strict=True))


def test_bare_text_folds_compatibility_forms(spark):
    rows = spark.createDataFrame([("\ufb01x \uff21!",), ("STRASSE",), ("stra\u00dfe",), (None,), ("A b-C",)], "x string")
    assert [r.b for r in rows.select(text.bare_text(F.col("x")).alias("b")).collect()] == ["fixa", "strasse", "strasse", "", "abc"]


def test_char_distance_against_the_table(spark):
    import random

    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("ab\u0107") for _ in range(rng.randrange(0, 90)))
    pairs = [(word(), word()) for _ in range(60)] + [("", ""), ("", "abc"), ("same", "same"), ("abcX" * 30, "abcY" * 30)]
    assert [helpers.char_edits(a, b) for a, b in pairs] == [table(a, b) for a, b in pairs]
    got = spark.createDataFrame(pairs + [(None, "a")], "a string, b string").select(helpers.char_distance(F.col("a"), F.col("b"), most=50).alias("d")).collect()
    assert [r.d for r in got] == [table(a, b) for a, b in pairs] + [None]


def test_ter_tries_shifts_of_every_length_without_a_cap():
    spans = helpers._shifts("c d e a b".split(), "a b c d e".split(), 10, 50)
    assert {(1, 3, 0), (2, 3, 0)} <= set(spans)
    words = [f"w{k // 2}" for k in range(200)]
    repeated = helpers._shifts(words[::-1], words, 10, 500)
    assert len(repeated) > 200 and {f[0] for f in repeated} == {1, 2}
