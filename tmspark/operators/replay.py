"""Replay of past pages with other examples: eligible entries, payloads, scores, paired statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tmspark.functions import helpers, text
from tmspark.operators import memory

#: Pairs of variants that are compared, and bins of the nearest example's similarity.
PAIRS = [("A0b", "A0"), ("A1", "A0"), ("A2", "A0"), ("A3", "A0"), ("A2", "A1"), ("A3", "A2")]
BINS = [(0.0, 0.3), (0.3, 0.5), (0.5, 0.67), (0.67, 1.01)]


#: Levels of time ranges: a range of level k is 2^k seconds from a multiple of that; so many hold all of 31 bits.
LEVELS = 32
LAST_SECOND = 2**31 - 1


def time_ranges(first: Column, last: Column) -> Column:
    """Structs (level, number) of the fewest time ranges that hold the seconds from ``first`` to ``last``: two of a level
    at most, so some 60 however long the time."""

    def ends(level):
        low = F.floor((first + F.pow(F.lit(2.0), level) - 1) / F.pow(F.lit(2.0), level)).cast("long")
        high = (F.floor((last + 1) / F.pow(F.lit(2.0), level)) - 1).cast("long")
        left = F.when((low <= high) & (low % 2 == 1), F.struct(level.alias("level"), low.alias("number")))
        right = F.when((low <= high) & (high % 2 == 0), F.struct(level.alias("level"), high.alias("number")))
        return F.array_compact(F.array(left, right))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), ends))


def eligible_examples(pages: DataFrame, corrections: DataFrame) -> DataFrame:
    """(page_id, id) of the newest entries of each phrase among those made before a page's first translation (pages:
    page_id, project_id, first_at) and not on that page.

    An entry stands from its time until that of any newer one of its phrase (a changed entry keeps its id and gets a new
    time, so the times needn't ascend); where the newer one is the page's own it still stands. The times entries stand are kept as time ranges, and a page looks up the range of each level that holds its
    time, so pages meet the entries that stand then and no others. Only phrases with an entry of the page are worked out
    by themselves."""
    c = corrections.withColumn("phrase_key", memory.phrase_key(F.col("source_text"))).select("id", "project_id", "phrase_key", "page_id", "created_at")
    newer = Window.partitionBy("project_id", "phrase_key").orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    spans = c.withColumn("_until", F.min("created_at").over(newer)).where("_until is null or _until > created_at")
    second = lambda c: F.least(F.greatest(F.unix_seconds(c), F.lit(0)), F.lit(LAST_SECOND))
    last = F.when(F.col("_until").isNull(), F.lit(LAST_SECOND).cast("long")).otherwise(second(F.col("_until")))
    ranges = time_ranges(second(F.col("created_at")), last)
    spans = spans.withColumn("_r", F.explode(ranges)).select("*", F.col("_r.level").alias("_level"), F.col("_r.number").alias("_number")).drop("_r")
    own = c.where("page_id is not null").select("project_id", "phrase_key", F.col("page_id").alias("_page")).distinct()
    p = pages.select(F.col("page_id").alias("_page"), "project_id", "first_at")
    asked = p.where("first_at is not null").withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    asked = asked.withColumn("_number", F.floor(second(F.col("first_at")) / F.pow(F.lit(2.0), F.col("_level"))).cast("long"))
    plain = asked.join(spans, ["project_id", "_level", "_number"]).where("created_at < first_at and (_until is null or _until >= first_at)")
    plain = plain.select("_page", "project_id", "phrase_key", "id").join(own, ["_page", "project_id", "phrase_key"], "left_anti")
    special = p.join(own, ["_page", "project_id"])
    rest = special.join(c, ["project_id", "phrase_key"]).where("created_at < first_at and (page_id is null or page_id <> _page)")
    rest = rest.groupBy("_page", "project_id", "phrase_key").agg(F.max("id").alias("id"))
    return plain.select(F.col("_page").alias("page_id"), "id").unionByName(rest.select(F.col("_page").alias("page_id"), "id"))


def biggest_corrections(corrections: DataFrame, k: int = 3) -> DataFrame:
    """A project's entries that were edited most (characters between draft and final), newer first on ties."""
    size = helpers.char_distance(F.coalesce("ai_translation", F.lit("")), F.col("final_translation"))
    rows = corrections.where(F.coalesce("kind", F.lit("corrected")) == "corrected").withColumn("size", size).where("size > 0")
    order = Window.partitionBy("project_id").orderBy(F.desc("size"), F.desc("id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def random_examples(pairs: DataFrame, k: int = 3, seed: int = 7) -> DataFrame:
    """k entries of each query drawn by a seeded hash, one for each final text, then by similarity."""
    draw = F.xxhash64(F.lit(seed), "query_id", "correction_id")
    once = pairs.withColumn("_d", draw).withColumn("_n", F.row_number().over(Window.partitionBy("query_id", F.lower(F.trim("final_translation"))).orderBy("_d", "correction_id"))).where("_n = 1")
    picked = once.withColumn("_k", F.row_number().over(Window.partitionBy("query_id").orderBy("_d", "correction_id"))).where(F.col("_k") <= k)
    return picked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "correction_id"))).drop("_d", "_n", "_k")


def spread_sample(pages: DataFrame, n: int) -> DataFrame:
    """n pages spread evenly over the order of their first translations (page_id, first_at).

    Positions are counted by range of time, so the order is not one task's."""
    spark = pages.sparkSession
    days = pages.groupBy(F.to_date("first_at").alias("_d")).agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.withColumn("_before", before)
    total = pages.agg(F.count(F.lit(1)).alias("_total"))
    within = F.row_number().over(Window.partitionBy(F.to_date("first_at")).orderBy("first_at", "page_id"))
    placed = pages.withColumn("_d", F.to_date("first_at")).withColumn("_w", within - 1).join(F.broadcast(days), "_d").withColumn("_at", F.col("_before") + F.col("_w"))
    steps = spark.range(n).crossJoin(total).select(F.expr(f"cast(bround(id * (_total - 1) / {max(n - 1, 1)}, 0) as bigint)").alias("_at")).distinct()
    return placed.join(F.broadcast(steps), "_at").select("page_id", "first_at", F.col("_at").alias("position"))


def example_fields(examples: DataFrame) -> DataFrame:
    """Examples (page_id, bubble_id, rank, en, pl, similarity, kind, draft) as a payload shows them: in capitals where the
    source is, and with the draft that was rejected where an entry was corrected."""
    caps = text.is_caps_line(F.col("en"))
    draft = F.trim(F.coalesce("draft", F.lit("")))
    rejected = (F.coalesce("kind", F.lit("corrected")) == "corrected") & (draft != "") & (F.lower(draft) != F.lower(F.trim("pl")))
    return examples.withColumns(
        {"pl": F.when(caps, F.upper("pl")).otherwise(F.col("pl")), "rejected": F.when(rejected, F.when(caps, F.upper(draft)).otherwise(draft))}
    )


def build_payload(
    bubbles: DataFrame, examples: DataFrame, exact: DataFrame, glossary: DataFrame, memory_fields: bool = True, context: DataFrame | None = None
) -> DataFrame:
    """One JSON document a page: first the bubbles of ``context`` (page_id, pos, bubble_id, text, skip), marked
    context_only, then its bubbles in order with their examples, exact phrase and glossary terms. Without
    ``memory_fields`` it is the counterfactual."""
    seen = lambda rows: rows.where(~F.coalesce("skip", F.lit(False)) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    row = F.struct("rank", "en", "pl", F.round("similarity", 2).alias("similarity"), "kind", "rejected")
    shown = example_fields(examples).groupBy("page_id", "bubble_id").agg(F.array_sort(F.collect_list(row)).alias("examples"))
    rows = seen(bubbles).select("page_id", F.lit(1).alias("part"), "pos", "bubble_id", "text")
    rows = rows.join(shown, ["page_id", "bubble_id"], "left").join(exact.select("page_id", "bubble_id", "exact"), ["page_id", "bubble_id"], "left")
    rows = rows.withColumn("exact", F.when(text.is_caps_line(F.col("text")), F.upper("exact")).otherwise(F.col("exact")))
    rows = rows.join(glossary.select("page_id", "bubble_id", "glossary"), ["page_id", "bubble_id"], "left").withColumn("context_only", F.lit(None).cast("boolean"))
    if context is not None:
        around = seen(context).select("page_id", F.lit(0).alias("part"), "pos", "bubble_id", "text", F.lit(True).alias("context_only"))
        rows = rows.unionByName(around, allowMissingColumns=True)
    fields = ["part", "pos", "bubble_id", "text", "context_only", "glossary"] + (["examples", "exact"] if memory_fields else [])
    items = F.array_sort(F.collect_list(F.struct(*fields)), lambda a, b: F.when((a["part"] < b["part"]) | (a["part"] == b["part"]) & (a["pos"] < b["pos"]), -1).otherwise(1))
    return rows.groupBy("page_id").agg(F.to_json(F.transform(items, lambda r: r.dropFields("part"))).alias("payload"))


def latest_outputs(outputs: DataFrame) -> DataFrame:
    """The last row of each page, bubble and variant; those whose final text is blank are then left out. A bubble's rows
    are in one task, where outputs that are the same are scored once."""
    row = F.max_by(F.struct(*[F.col(c) for c in outputs.columns]), "seq").alias("_r")
    latest = outputs.repartition("page_id", "bubble_id").groupBy("page_id", "bubble_id", "variant").agg(row).select("_r.*")
    return latest.where(F.trim(F.coalesce("final", F.lit(""))) != "")


def subsets(outputs: DataFrame) -> DataFrame:
    """Adds a row for each subset that an output belongs to: all, fuzzy, fuzzy_edited, and its bin."""
    fuzzy = ~F.coalesce("short", F.lit(False))
    edited = fuzzy & (F.trim(F.coalesce("ai_first", F.lit(""))) != F.trim("final"))
    bins = [F.when(fuzzy & (F.col("nearest") >= a) & (F.col("nearest") < b), f"bin_{a:g}_{b:g}") for a, b in BINS]
    names = F.array(F.lit("all"), F.when(fuzzy, "fuzzy"), F.when(edited, "fuzzy_edited"), *bins)
    return outputs.select("*", F.explode(F.array_compact(names)).alias("subset"))


def replay_scores(outputs: DataFrame, page_accepted: bool = False) -> DataFrame:
    """Mean chrF++ and TER of each subset and variant."""
    rows = latest_outputs(outputs)
    rows = rows if page_accepted else rows.where(F.coalesce("confirmed_via", F.lit("")) != "page")
    scored = rows.withColumns({"chrf": helpers.chrf("output", "final"), "ter": 100 * helpers.ter("output", "final")})
    return subsets(scored)


def mean_scores(scored: DataFrame) -> DataFrame:
    return scored.groupBy("subset", "variant").agg(F.count(F.lit(1)).alias("n"), F.avg("chrf").alias("chrf"), F.avg("ter").alias("ter"))


def differences(scored: DataFrame) -> DataFrame:
    """subset, pair, metric, difference of each bubble that has both variants of a pair. Scores are dealt by bubble without
    their texts; what is made of the differences reads them there, so texts are scored once."""
    dealt = scored.select("subset", "page_id", "bubble_id", "variant", "chrf", "ter").repartition("page_id", "bubble_id")
    wide = dealt.groupBy("subset", "page_id", "bubble_id").pivot("variant", sorted({v for p in PAIRS for v in p})).agg(F.first(F.struct("chrf", "ter")))
    steps = [F.struct(F.lit(f"{a}-{b}").alias("pair"), F.lit(m).alias("metric"), (F.col(f"{a}.{m}") - F.col(f"{b}.{m}")).alias("difference")) for a, b in PAIRS for m in ("chrf", "ter")]
    return wide.select("subset", "page_id", "bubble_id", F.explode(F.array(*steps)).alias("_s")).select("subset", "page_id", "bubble_id", "_s.*").where("difference is not null")


KEYS = ["subset", "pair", "metric"]


def ranked_sizes(diffs: DataFrame, ranges: int = 64) -> DataFrame:
    """The distinct absolute differences of each key: ``size``, how many differences have it (``ties``; ``plus``, ``minus``
    and ``zero`` of them), and their average rank.

    Equal sizes are counted before they are ranked, and ranks are counted up within ranges of sizes, so a key with very
    many differences is many groups."""
    size, d = F.abs("difference"), F.col("difference")
    counted = diffs.groupBy(*KEYS, size.alias("size")).agg(
        F.count(F.lit(1)).alias("ties"), F.count_if(d > 0).alias("plus"), F.count_if(d < 0).alias("minus"), F.count_if(d == 0).alias("zero")
    )
    cuts = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    bounds = diffs.groupBy(*KEYS).agg(F.percentile_approx(size, cuts, 1_000).alias("_cuts"))
    placed = counted.join(F.broadcast(bounds), KEYS).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("size")))).drop("_cuts")
    before = placed.groupBy(*KEYS, "_range").agg(F.sum("ties").alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy(*KEYS).orderBy("_range")) - F.col("_n")).drop("_n")
    up_to = F.sum("ties").over(Window.partitionBy(*KEYS, "_range").orderBy("size")) - F.col("ties")
    ranked = placed.withColumn("_up_to", up_to).join(F.broadcast(before), [*KEYS, "_range"])
    return ranked.withColumn("rank", F.col("_before") + F.col("_up_to") + (F.col("ties") + 1) / 2).drop("_range", "_before", "_up_to")


def signed_ranks(diffs: DataFrame) -> DataFrame:
    """Average ranks of the absolute differences of each key, with the number of its ties."""
    ranks = ranked_sizes(diffs).select(*KEYS, "size", "ties", "rank")
    return diffs.withColumn("size", F.abs("difference")).join(ranks, [*KEYS, "size"]).drop("size")


def _two_sided(n: int, plus: float, minus: float, variance: float, plain: bool) -> float:
    """p of the smaller rank sum: exact for up to 50 differences without ties or zeros, else by the normal law."""
    low = min(plus, minus)
    if plain and n <= 50:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + ways[:-k].copy()
        return float(min(1.0, 2 * ways[: int(low) + 1].sum() / 2.0**n))
    z = (low - n * (n + 1) / 4) / math.sqrt(variance) if variance > 0 else 0.0
    return math.erfc(abs(z) / math.sqrt(2))


def wilcoxon(diffs: DataFrame) -> DataFrame:
    """subset, pair, metric, n, p of the signed-rank test; zeros are split between the signs; null below six differences
    or if all are zero."""
    t = F.col("ties")
    sums = ranked_sizes(diffs).groupBy(*KEYS).agg(
        F.sum(t).alias("n"), F.sum(F.col("rank") * (F.col("plus") + F.col("zero") / 2)).alias("plus"),
        F.sum(F.col("rank") * (F.col("minus") + F.col("zero") / 2)).alias("minus"), F.sum("zero").alias("zeros"),
        F.max(t).alias("most_ties"), F.sum(t * (t * t - 1) / 48).alias("tied"),
    )

    @F.pandas_udf("double")
    def p_value(n: pd.Series, plus: pd.Series, minus: pd.Series, zeros: pd.Series, ties: pd.Series, tied: pd.Series) -> pd.Series:
        out = []
        for a, b, c, z, t, s in zip(n, plus, minus, zeros, ties, tied, strict=True):
            spread = a * (a + 1) * (2 * a + 1) / 24 - s
            out.append(None if a < 6 or z == a else _two_sided(int(a), b, c, spread, z == 0 and t == 1))
        return pd.Series(out, dtype="float64")

    return sums.withColumn("p", p_value("n", "plus", "minus", "zeros", "most_ties", "tied")).select(*KEYS, "n", "p")


def bootstrap(diffs: DataFrame, rounds: int = 2000, seed: int = 7) -> DataFrame:
    """subset, pair, metric, mean and the middle 95 percent of resampled means.

    Each bubble gets a Poisson(1) weight in each round, drawn by a hash of it and the round, so weights don't depend on
    tasks and are drawn once for all differences of a batch that are the bubble's; tasks send a sum and a weight for each
    round and key, never their rows."""
    law = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
    step = np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    # Weights by the upper 16 bits of a draw; where a border of the law lies within these, the draw is looked up.
    low, high = (np.searchsorted(law, (np.arange(1 << 16) + k) / 2.0**16, "right") for k in (0, 1 - 2.0**-37))
    by_bits, split = low.astype(np.uint8), low != high

    def weights(rows: np.ndarray) -> np.ndarray:
        x = rows[:, None] ^ step
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
        bits = (x >> np.uint64(48)).astype(np.intp)
        out = by_bits[bits].astype(np.float64)
        near = split[bits]
        out[near] = np.searchsorted(law, (x[near] >> np.uint64(11)) / 2.0**53, "right")
        return out

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            number = batch.groupby(KEYS, sort=False).ngroup().to_numpy()
            first = np.unique(number, return_index=True)[1]
            names = list(zip(*[batch[c].to_numpy()[first] for c in KEYS], strict=True))
            seeds, bubble = np.unique(batch["h"].to_numpy().view(np.uint64), return_inverse=True)
            order = np.argsort(bubble, kind="stable")
            number, bubble, values = number[order], bubble[order], batch["difference"].to_numpy()[order]
            own = np.zeros((2, len(names), rounds))
            for a in range(0, len(seeds), 256):
                draw = weights(seeds[a : a + 256])
                some = slice(*np.searchsorted(bubble, (a, a + 256)))
                table = np.zeros((2, len(names), len(draw)))
                at = (number[some], bubble[some] - a)
                np.add.at(table[0], at, values[some])
                np.add.at(table[1], at, 1.0)
                own += table @ draw
            for k, key in enumerate(names):
                totals[key] = totals.get(key, 0) + own[:, k]
        for key, own in totals.items():
            yield pd.DataFrame({"subset": key[0], "pair": key[1], "metric": key[2], "round": np.arange(rounds), "s": own[0], "w": own[1]})

    sums = diffs.select(*KEYS, "difference", F.xxhash64(F.lit(seed), "page_id", "bubble_id").alias("h")).mapInPandas(weigh, "subset string, pair string, metric string, round int, s double, w double")
    means = sums.groupBy(*KEYS, "round").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    spread = means.groupBy(*KEYS).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    n = diffs.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.avg("difference").alias("mean"))
    nan = F.lit(float("nan"))
    return n.join(spread, KEYS).select(*KEYS, "n", "mean", F.when(F.col("n") < 2, nan).otherwise(F.col("low")).alias("low"), F.when(F.col("n") < 2, nan).otherwise(F.col("high")).alias("high"))


def request_stats(requests: DataFrame) -> DataFrame:
    """Requests that went through, and their mean size, by variant."""
    return requests.where("ok and not skipped").groupBy("variant").agg(F.count(F.lit(1)).alias("requests"), F.avg("payload_chars").alias("mean_chars"))


