"""Repair of scanned text against word frequencies: torn words are joined, confused letters put right.

Texts aren't judged word by word in Python. Each step takes the distinct torn pairs or doubtful words of all texts, looks
their frequencies up by joins, decides once for each, and puts the decisions back into the texts that hold them. Texts go
by a 64-bit key; no join or group is by a text, and only texts that hold a torn pair go through the steps for these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tmspark.functions import text

#: log10 occurrences in a thousand million words of a common word, a word, and a word of two torn parts.
COMMON, WORD, TORN = 3.0, 2.5, 1.5
TORN_PAIR = r"\b([A-Za-z]{2,})-\s+([A-Za-z]{2,})\b"
LETTERS = r"[A-Za-z']+"


def _frequency(rows: DataFrame, zipf: DataFrame, word: str, name: str) -> DataFrame:
    """Adds the frequency of a column's words, 0 for unknown ones."""
    known = zipf.select(F.col("word").alias("_w"), F.col("zipf").alias(name))
    return rows.join(known, F.lower(F.col(word)) == F.col("_w"), "left").drop("_w").withColumn(name, F.coalesce(name, F.lit(0.0)))


def _apply(rows: DataFrame, held: DataFrame, pattern: str, new: Column) -> DataFrame:
    """Texts (_key, _now) with each match of a pattern made ``new``, an array of all matches' new forms that ``held``
    (_key, ..) gives for the texts it has. A text is taken apart and put together once, whatever is put in."""
    whole = F.zip_with(F.split("_now", pattern, -1), new, lambda gap, word: F.concat(gap, F.coalesce(word, F.lit(""))))
    done = F.when(F.col("_held").isNull(), F.col("_now")).otherwise(F.array_join(whole, ""))
    return rows.join(held, "_key", "left").select("_key", done.alias("_now"))


def _protected(column: Column, protected: list[str]) -> Column:
    return F.upper(column).isin([p.upper() for p in protected]) if protected else F.lit(False)


def join_torn(rows: DataFrame, zipf: DataFrame, protected: list[str]) -> DataFrame:
    """One pass over hyphens that a line break left: the two parts are one word if that is common, or if it is a word and
    one part isn't common, or if it occurs at all and neither part is a word; else only the space goes. Stutters stay."""
    parts = [F.regexp_extract_all("_now", F.lit(TORN_PAIR), F.lit(k)).alias(n) for k, n in enumerate(("all", "a", "b"))]
    found = rows.select("_key", F.posexplode(F.arrays_zip(*parts)).alias("_at", "_p")).select("_key", "_at", "_p.all", F.struct("_p.a", "_p.b").alias("_old"))
    pairs = found.select("_old").distinct().where(~F.lower("_old.b").startswith(F.lower("_old.a")))
    pairs = pairs.withColumns({"_a": F.col("_old.a"), "_b": F.col("_old.b")}).withColumn("_whole", F.concat("_a", "_b"))
    for word, name in (("_a", "_fa"), ("_b", "_fb"), ("_whole", "_fw")):
        pairs = _frequency(pairs, zipf, word, name)
    kept = F.concat_ws("-", "_a", "_b")
    one_word = (
        (F.col("_fw") >= COMMON)
        | (F.col("_fw") >= WORD) & (F.least("_fa", "_fb") < COMMON)
        | (F.col("_fw") >= TORN) & (F.greatest("_fa", "_fb") < WORD)
    )
    named = _protected(kept, protected) | _protected(F.col("_whole"), protected)
    decided = pairs.select("_old", F.when(one_word & ~named, F.col("_whole")).otherwise(kept).alias("_new"))
    new = F.struct("_at", F.coalesce("_new", "all").alias("_new"))
    held = found.join(decided, "_old", "left").groupBy("_key").agg(F.array_sort(F.collect_list(new)).alias("_held"))
    return _apply(rows, held, TORN_PAIR, F.transform("_held", lambda d: d["_new"]))


def right_letters(rows: DataFrame, zipf: DataFrame, protected: list[str], wrong: str = "L", right: str = "U") -> DataFrame:
    """Words of three letters or more that are none get the one letter changed that makes the most common word of them."""
    core = lambda w: F.regexp_replace(w, "^'+|'+$", "")
    every = F.regexp_extract_all("_now", F.lit(LETTERS), F.lit(0))
    places = F.transform(every, lambda w, k: F.struct(k.alias("_at"), w.alias("_old")))
    places = F.filter(places, lambda p: F.upper(p["_old"]).contains(wrong) & (F.length(core(p["_old"])) >= 3))
    tokens = rows.select("_key", F.inline(places))
    doubtful = tokens.select("_old").distinct().withColumn("_core", core(F.col("_old")))
    doubtful = doubtful.where(F.upper("_core").contains(wrong) & ~_protected(F.col("_core"), protected))
    doubtful = _frequency(doubtful, zipf, "_core", "_f").where(F.col("_f") < WORD)
    letter = F.substring("_core", F.col("_at"), F.lit(1))
    tried = doubtful.withColumn("_at", F.explode(F.sequence(F.lit(1), F.length("_core")))).where(F.upper(letter) == wrong)
    tried = tried.withColumn("_try", F.overlay("_core", F.when(letter == wrong, right).otherwise(right.lower()), F.col("_at"), F.lit(1)))
    best = _frequency(tried, zipf, "_try", "_ft").where(F.col("_ft") > COMMON).groupBy("_old", "_core").agg(F.max_by("_try", F.struct("_ft", -F.col("_at"))).alias("_try"))
    decided = best.select("_old", F.replace(F.col("_old"), F.col("_core"), F.col("_try")).alias("_new"))
    held = tokens.join(decided, "_old").groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("_at", "_new"))).alias("_held"))
    return _apply(rows, held, LETTERS, F.transform(every, lambda w, k: F.coalesce(F.col("_held")[k], w)))


def fix_ocr_text(rows: DataFrame, zipf: DataFrame, protected: list[str] = (), text_col: str = "text", out: str = "fixed") -> DataFrame:
    """``rows`` with ``out``: the text with torn words joined (two passes, as a word may be torn twice) and letters right.
    Each distinct text is worked on once; null texts come out empty."""
    own = F.coalesce(F.col(text_col), F.lit(""))
    keyed = rows.withColumn("_key", F.xxhash64(own))
    texts = keyed.groupBy("_key").agg(F.first(own).alias("_now"))
    torn, whole = (texts.where(c) for c in (F.col("_now").rlike(TORN_PAIR), ~F.col("_now").rlike(TORN_PAIR)))
    for _ in range(2):
        torn = join_torn(torn, zipf, list(protected))
    fixed = right_letters(whole.unionByName(torn), zipf, list(protected)).select("_key", F.col("_now").alias(out))
    return keyed.join(fixed, "_key").drop("_key")


def memory_text(rows: DataFrame, zipf: DataFrame, text_col: str = "text", out: str = "memory_text") -> DataFrame:
    """``rows`` with the form of a line that is embedded and matched: single spaces, then repaired. Never stored."""
    return fix_ocr_text(rows.withColumn("_line", text.collapse(F.col(text_col))), zipf, (), "_line", out).drop("_line")
