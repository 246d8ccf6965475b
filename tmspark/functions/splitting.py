"""Dealing a translation to the pieces of its source, with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Openers of English clauses, and the Polish words that usually open their translations.
LINKS = {
    "BUT": ("ALE", "LECZ", "JEDNAK", "A"),
    "AND": ("I", "A", "ORAZ"),
    "OR": ("ALBO", "LUB", "CZY"),
    "SO": ("WIĘC", "TO", "DLATEGO", "TAK"),
    "BECAUSE": ("BO", "PONIEWAŻ", "GDYŻ"),
    "SINCE": ("SKORO", "PONIEWAŻ", "OD"),
    "IF": ("JEŚLI", "JEŻELI", "GDY", "GDYBY"),
    "WHEN": ("GDY", "KIEDY"),
    "THEN": ("TO", "WTEDY", "POTEM"),
    "THAT": ("ŻE", "KTÓRY", "KTÓRA", "KTÓRE"),
    "WHICH": ("KTÓRY", "KTÓRA", "KTÓRE", "CO"),
    "WHO": ("KTÓRY", "KTÓRA", "KTO"),
    "ALTHOUGH": ("CHOĆ", "CHOCIAŻ", "MIMO"),
    "UNTIL": ("AŻ", "DOPÓKI"),
    "WHILE": ("PODCZAS", "GDY", "A"),
}
#: Where sentences end, and where a clause may be cut (the white space belongs to what follows).
SENTENCE_END = r"(?U)(?<=[.!?…])\s+"
CLAUSE_CUT = r"(?U)(?<=[,;:–—-])(?=\s)|(?=\s+[–—-]\s)(?<=\S)"


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.trim(F.coalesce(text, F.lit(""))), SENTENCE_END), F.trim), lambda s: s != "")


def running(rows: DataFrame, sizes: str, out: str) -> DataFrame:
    """Adds the sums of an array's numbers up to each of them."""
    up_to = F.transform(sizes, lambda _, k: F.aggregate(F.slice(sizes, F.lit(1), k + 1), F.lit(0), lambda s, x: s + x))
    return rows.withColumn(out, up_to)


def shares(rows: DataFrame, sizes: str, out: str) -> DataFrame:
    """Adds what part of the whole lies before each boundary between pieces of these sizes."""
    rows = running(rows, sizes, "_sums")
    inner = F.slice("_sums", F.lit(1), F.greatest(F.size("_sums") - 1, F.lit(0)))
    return rows.withColumn(out, F.transform(inner, lambda s: s / F.try_element_at("_sums", F.lit(-1)))).drop("_sums")


def nearest(rows: DataFrame, places: str, goals: str, out: str, rank=lambda k, p: F.lit(0)) -> DataFrame:
    """Adds, for each goal in order, the number (from 1) of the place that is best by ``rank`` and then nearest, past the
    one chosen before and leaving one for each later goal; null where there are fewer places than goals."""

    def choose(chosen: Column, k: Column) -> Column:
        low = F.coalesce(F.try_element_at(chosen, F.lit(-1)), F.lit(0)) + 1
        options = F.sequence(low, F.size(places) - F.size(goals) + k)
        ranked = F.transform(options, lambda p: F.struct(rank(k, p).alias("r"), F.abs(F.get(places, p - 1) - F.get(goals, k - 1)).alias("d"), p.alias("p")))
        return F.concat(chosen, F.array(F.array_min(ranked)["p"]))

    none = F.array().cast("array<int>")
    cuts = F.aggregate(F.sequence(F.lit(1), F.size(goals)), none, choose)
    return rows.withColumn(out, F.when(F.size(goals) == 0, none).when(F.size(places) >= F.size(goals), cuts))


def dealt(rows: DataFrame, pieces: str, cuts: str, between: str, out: str) -> DataFrame:
    """Adds the pieces joined in runs that end at the numbers in ``cuts``; the last run takes the rest."""
    rows = rows.withColumn("_ends", F.concat(F.array(F.lit(0)), cuts, F.array(F.size(pieces))))
    runs = F.sequence(F.lit(1), F.size("_ends") - 1)
    joined = F.transform(runs, lambda k: F.array_join(F.slice(pieces, F.get("_ends", k - 1) + 1, F.greatest(F.get("_ends", k) - F.get("_ends", k - 1), F.lit(0))), between))
    return rows.withColumn(out, F.when(F.col(cuts).isNotNull(), joined)).drop("_ends")


def _bare(word: Column) -> Column:
    return F.upper(F.btrim(word, F.lit(".,!?\"'")))


def split_translation(rows: DataFrame, text_col: str, sources_col: str) -> DataFrame:
    """``rows`` with ``parts`` and ``method`` of a translation for an array of source pieces.

    sentences: it has as many sentences as all pieces together, and each gets as many as its source has. proportional:
    more sentences than pieces, cut where the share of the text is nearest to that of the source. clauses: cut after
    commas and at dashes, first where a word follows that answers the next piece's opener, then by share. unsplit: all
    of it goes to the first piece. A null text is empty."""
    space = F.lit(" \t\n\r")
    names = rows.columns
    rows = rows.withColumn("_whole", F.btrim(F.coalesce(F.col(text_col), F.lit("")), space))
    rows = rows.withColumns(
        {
            "_n": F.size(sources_col), "_own": sentences(F.col("_whole")), "_clauses": F.split("_whole", CLAUSE_CUT),
            "_counts": F.transform(sources_col, lambda s: F.size(sentences(s))), "_lengths": F.transform(sources_col, lambda s: F.greatest(F.length(s), F.lit(1))),
            "_openers": F.transform(sources_col, lambda s: _bare(F.coalesce(F.try_element_at(F.split(F.ltrim(s), r"\s+"), F.lit(1)), F.lit("")))),
        }
    )
    rows = rows.withColumns({"_sizes": F.transform("_own", lambda s: F.length(s) + 1), "_widths": F.transform("_clauses", F.length)})
    for sizes, out in (("_lengths", "_goals"), ("_sizes", "_shares"), ("_widths", "_spots")):
        rows = shares(rows, sizes, out)
    rows = running(rows, "_counts", "_counted").withColumn("_by_count", F.slice("_counted", F.lit(1), F.greatest(F.col("_n") - 1, F.lit(0))))
    # What follows each clause's end: the first word of the rest.
    rest = F.transform(F.sequence(F.lit(1), F.size("_clauses")), lambda p: F.ltrim(F.array_join(F.slice("_clauses", p + 1, F.size("_clauses")), ""), F.lit(" ,;:-–—")))
    rows = rows.withColumn("_rest", rest).withColumn("_follows", F.transform("_rest", lambda r: _bare(F.split(r, " ")[0])))
    links = F.create_map(*[x for opener, words in LINKS.items() for x in (F.lit(opener), F.array(*map(F.lit, words)))])
    rows = rows.withColumn("_answers", F.transform("_openers", lambda o: F.coalesce(F.try_element_at(links, o), F.array().cast("array<string>"))))
    rows = nearest(rows, "_shares", "_goals", "_by_share")
    rows = nearest(rows, "_spots", "_goals", "_by_clause", lambda k, p: F.when(F.array_contains(F.get("_answers", k), F.get("_follows", p - 1)), 0).otherwise(1))
    for pieces, cuts, between, out in (("_own", "_by_count", " ", "_counted_parts"), ("_own", "_by_share", " ", "_shared_parts"), ("_clauses", "_by_clause", "", "_cut")):
        rows = dealt(rows, pieces, cuts, between, out)
    cut = F.transform("_cut", lambda s, k: F.when(k < F.col("_n") - 1, F.rtrim(F.btrim(s, space), F.lit(" ,;:–—-"))).otherwise(F.btrim(s, space)))
    rows = rows.withColumn("_cut", cut)
    many, matching = F.size("_own") >= F.col("_n"), F.forall("_counts", lambda c: c > 0) & (F.try_element_at("_counted", F.lit(-1)) == F.size("_own"))
    clauses = F.col("_cut").isNotNull() & F.forall("_cut", lambda s: s != "")
    method = (
        F.when(F.col("_n") < 2, "sentences").when(F.col("_whole") == "", "unsplit").when(many & F.coalesce(matching, F.lit(False)), "sentences").when(many, "proportional")
        .when(F.coalesce(clauses, F.lit(False)), "clauses").otherwise("unsplit")
    )
    alone = F.concat(F.array("_whole"), F.array_repeat(F.lit(""), F.greatest(F.col("_n") - 1, F.lit(0))))
    rows = rows.withColumn("method", method)
    parts = (
        F.when((F.col("_n") < 2) | (F.col("method") == "unsplit"), alone).when(F.col("method") == "sentences", F.col("_counted_parts"))
        .when(F.col("method") == "proportional", F.col("_shared_parts")).otherwise(F.col("_cut"))
    )
    return rows.withColumn("parts", parts).select(*[c for c in names if c not in ("parts", "method")], "parts", "method")
