"""Boxes of recognised text: thresholds, noise, duplicates, lines, bubbles, order and cleaning."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tmspark.functions import geometry as geo
from tmspark.functions import helpers, layout, text

#: Default limits of the steps below (pixels, shares and ratios).
SCORE, TOLERANCE = 0.85, 0.15
BUBBLE_SCORE, NUMBER_HEIGHTS = 0.7, 1.5
#: From where on a word is known, the marks that may end a bubble, and characters that stand alone.
KNOWN, ENDING, ALONE = 2.0, "^[?!？！‽]{1,4}$", ["I"]


def zipf_table(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, zipf: log10 of its occurrences in a thousand million words."""
    tokens = docs.select(F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(r"[\p{L}']+"), F.lit(0))).alias("word"))
    counts = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all")))).select("word", F.log10(F.col("n") * 1e9 / F.col("_all")).alias("zipf"))


def text_threshold(items: DataFrame, zipf: DataFrame, threshold: float = SCORE, tolerance: float = TOLERANCE, known: float = KNOWN) -> DataFrame:
    """Items (id, text, score) of the threshold or more, and those within the tolerance whose text is plausible: at least
    half of its white-space words are known without the ASCII marks around them; marks that end a bubble pass, a single
    character only if it is one of the few that stand alone."""
    near = items.where((F.col("score") < threshold) & (F.col("score") >= threshold - tolerance))
    core = lambda w: F.regexp_replace(F.lower(w), r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", "")
    words = near.select("id", "text", F.explode_outer(F.transform(text.words(F.col("text")), core)).alias("word"))
    held = words.join(zipf.where(F.col("zipf") >= known).select("word", F.lit(1).alias("_k")), "word", "left")
    share = held.groupBy("id", "text").agg(F.count("word").alias("n"), F.coalesce(F.sum("_k"), F.lit(0)).alias("k"))
    clean = F.regexp_replace("text", r"^\s+|\s+$", "")
    plausible = F.when(clean.rlike(ENDING), True).when(F.length(clean) == 1, F.upper(clean).isin(ALONE)).otherwise((F.col("n") > 0) & (2 * F.col("k") >= F.col("n")))
    kept = share.where(plausible).select("id")
    return items.where(F.col("score") >= threshold).unionByName(near.join(kept, "id", "left_semi"))


def drop_noise(rows: DataFrame) -> DataFrame:
    return rows.where(~text.noise(F.col("text")))


def ignore_rows(rows: DataFrame, patterns: list[str]) -> DataFrame:
    return rows.where(~text.ignore_filter(F.col("text"), patterns)[0])


def purge_ignored(bubbles: DataFrame, logs: DataFrame, patterns: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept bubbles, kept logs, one row of what went): rows whose text holds a pattern go, and their bubbles' logs."""
    hit = text.ignore_filter(F.col("text"), patterns)[0]
    gone = bubbles.where(hit).select("page_id", "bubble_id").distinct()
    bad_log = text.ignore_filter(F.col("source_text"), patterns)[0]
    kept_logs = logs.where(~bad_log)
    removed = logs.where(bad_log).agg(F.count(F.lit(1)).alias("logs_removed"))
    stats = gone.agg(F.count(F.lit(1)).alias("bubbles_removed"), F.count_distinct("page_id").alias("pages_changed")).crossJoin(removed)
    return bubbles.where(~hit), kept_logs, stats


def cut_by_slice(items: DataFrame, slices: DataFrame, near: float = 3.0) -> DataFrame:
    """Items (slice coordinates) of each slice (page_id, slice_id, top, bottom, left, next_top): those that the slice's end
    cuts and the next slice shows whole go; the rest move to page coordinates."""
    b = geo.bbox(F.col("box"))
    rows = items.join(slices, ["page_id", "slice_id"]).withColumn("_b", b)
    cut = (F.col("_b.y2") + F.col("top") >= F.col("bottom") - near) & (F.col("_b.y1") + F.col("top") >= F.col("next_top"))
    moved = F.transform("box", lambda p: F.array(p[0] + F.col("left"), p[1] + F.col("top")))
    return rows.where(~F.coalesce(cut, F.lit(False))).withColumn("box", moved).select(*items.columns)


def boundary_pairs(items: DataFrame, share: float = 0.3, ratio: float = 0.6, bucket: float = 256.0) -> DataFrame:
    """Pairs (page_id, first, second: positions) of different slices whose boxes overlap and whose texts are alike.

    Boxes meet in buckets of y, so a page is compared with itself only where boxes are near."""
    b = geo.bbox(F.col("box"))
    rows = items.select("page_id", "pos", "slice_id", "score", F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}_]", "").alias("t"), b.alias("b"))
    low, high = F.floor(F.col("b.y1") / bucket), F.floor(F.col("b.y2") / bucket)
    rows = rows.withColumn("_k", F.explode(F.sequence(low, high)))
    x, y = rows.alias("x"), rows.alias("y")
    near = x.join(y, (F.col("x.page_id") == F.col("y.page_id")) & (F.col("x._k") == F.col("y._k")) & (F.col("x.pos") < F.col("y.pos")) & (F.col("x.slice_id") != F.col("y.slice_id")))
    over = near.where(geo.overlap_of_smaller(F.col("x.b"), F.col("y.b")) > share)
    pairs = over.select(F.col("x.page_id").alias("page_id"), F.col("x.pos").alias("first"), F.col("y.pos").alias("second"), F.col("x.t").alias("a"), F.col("y.t").alias("c"), F.col("x.score").alias("s1"), F.col("y.score").alias("s2")).distinct()
    return pairs.where(helpers.indel_ratio("a", "c") >= 100 * ratio).select("page_id", "first", "second", "s1", "s2")


def slice_boundary_dedup(items: DataFrame, **settings) -> DataFrame:
    """Items without the worse of each pair of duplicates; pairs count in order, and what is gone removes nothing more."""
    pairs = boundary_pairs(items, **settings)

    def losers(rows: list[dict]) -> list[dict]:
        gone: set = set()
        for r in sorted(rows, key=lambda r: (r["first"], r["second"])):
            if r["first"] not in gone and r["second"] not in gone:
                gone.add(r["second"] if r["s1"] >= r["s2"] else r["first"])
        return [{"page_id": rows[0]["page_id"], "pos": p} for p in sorted(gone)]

    drop = per_page(pairs, losers, "page_id long, pos int")
    return items.join(drop, ["page_id", "pos"], "left_anti")


BOX = "box array<array<double>>"


def per_page(rows: DataFrame, build: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """``build`` over the rows of each page, pages being dealt by their id and read in order of it; a page is in one task.

    Rows are put into frames a batch at a time, as most pages are small."""
    names = [f.split()[0] for f in re.split(r", (?=\w+ \w)", schema)]

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                if held and row["page_id"] != held[0]["page_id"]:
                    out += build(held)
                    held = []
                held.append(row)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(build(held) if held else [], columns=names)

    return rows.repartition("page_id").sortWithinPartitions("page_id").mapInPandas(pages, schema)


def whole_pages(items: DataFrame, build: Callable[[layout.Boxes, np.ndarray, dict], list[dict]], schema: str) -> DataFrame:
    """``build`` over each page's words: their boxes, columns and other fields (arrays by name), by vertical centre. A page
    is in one task; columns are found for all pages of a batch at a time."""
    box = geo.bbox(F.col("box"))
    rows = items.select(
        "page_id", "pos", F.col("id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.col("score").cast("double").alias("score"),
        F.flatten("box").alias("points"), box.alias("_b"), F.degrees(F.atan2(F.expr("box[1][1] - box[0][1]"), F.expr("box[1][0] - box[0][0]"))).alias("tilt"),
    ).where("_b.x1 is not null and _b.y1 is not null")
    rows = rows.select("*", "_b.*").drop("_b").repartition("page_id").sortWithinPartitions("page_id", F.expr("y1 + y2"), "pos")
    names = [field.split()[0] for field in re.split(r", (?=\w+ \w)", schema)]

    def laid_out(batch: pd.DataFrame) -> pd.DataFrame:
        fields = {c: batch[c].to_numpy() for c in ("page_id", "pos", "id", "text", "score", "tilt", "points")}
        page, boxes = fields["page_id"], layout.Boxes(*(batch[c].to_numpy() for c in ("x1", "y1", "x2", "y2")))
        column, out = layout.columns_of(page, boxes), []
        edges = np.flatnonzero(np.concatenate(([True], page[1:] != page[:-1], [True])))
        for a, b in zip(edges, edges[1:], strict=False):
            own = column[a:b]
            out += build(boxes.take(slice(a, b)), np.where(own >= 0, own - a, -1), {c: v[a:b] for c, v in fields.items()})
        return pd.DataFrame(out, columns=names)

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for batch in batches:
            page = batch["page_id"].to_numpy()
            cut = int(np.searchsorted(page, page[-1])) if len(page) else 0
            if cut or rest and len(page) and rest[0]["page_id"].iloc[0] != page[-1]:
                yield laid_out(pd.concat([*rest, batch.iloc[:cut]], ignore_index=True))
                rest = []
            rest.append(batch.iloc[cut:])
        if sum(map(len, rest)):
            yield laid_out(pd.concat(rest, ignore_index=True))

    return rows.mapInPandas(pages, schema)


def _with_box(rows: DataFrame) -> DataFrame:
    corners = F.array(*[F.array(F.col("flat")[2 * k], F.col("flat")[2 * k + 1]) for k in range(4)])
    return rows.withColumn("flat", corners).withColumnRenamed("flat", "box")


def _lines(boxes: layout.Boxes, column: np.ndarray, page: dict, image_width: float) -> list[dict]:
    texts, scores, ids = (page[c].tolist() for c in ("text", "score", "id"))
    return layout.lines_of(boxes, column, page["tilt"], page["points"], texts, scores, ids, image_width)


def vertical_streams(items: DataFrame) -> DataFrame:
    """Each item's column on its page (the smallest position in it), -1 for one alone. Items without a box are left out."""

    def find(boxes: layout.Boxes, column: np.ndarray, page: dict) -> list[dict]:
        pos = page["pos"]
        least = np.full(len(pos), np.iinfo(np.int64).max)
        np.minimum.at(least, column[column >= 0], pos[column >= 0])
        number = page["page_id"][0]
        return [{"page_id": number, "pos": p, "stream": least[c] if c >= 0 else -1} for p, c in zip(pos, column, strict=True)]

    return whole_pages(items, find, "page_id long, pos int, stream int")


def build_text_lines(items: DataFrame, image_width: float = 1000.0) -> DataFrame:
    """Lines of each page; a tilted one has an angle and a slanted box."""

    def build(boxes: layout.Boxes, column: np.ndarray, page: dict) -> list[dict]:
        number = page["page_id"][0]
        return [{"page_id": number, "line_no": k, **r} for k, r in enumerate(_lines(boxes, column, page, image_width))]

    schema = "page_id long, line_no int, text string, score double, word_ids array<string>, flat array<double>, angle double, stream int"
    return _with_box(whole_pages(items, build, schema))


def _bounds(parts: Column) -> Column:
    """The bounds of an array of lines with x1, y1, x2 and y2."""
    side = lambda f, c: f(F.transform(parts, lambda p: p[c])).alias(c)
    return F.struct(side(F.array_min, "x1"), side(F.array_min, "y1"), side(F.array_max, "x2"), side(F.array_max, "y2"))


def split_far_numbers(lines: Column, heights: float = NUMBER_HEIGHTS) -> Column:
    """An array of a bubble's lines (text, x1, y1, x2, y2, ..) as arrays of lines: the lines that stay, then each line of
    digits alone whose distance from every line of words exceeds ``heights`` heights, its own or that of the words' lines
    (the upper one of the two in the middle), whichever is more."""
    digits = lambda p: p["text"].rlike(r"\p{Nd}") & ~p["text"].rlike(r"[\p{L}\p{Nl}\p{No}]")
    words = F.filter(lines, lambda p: ~digits(p))
    usual = F.get(F.array_sort(F.transform(words, lambda p: p["y2"] - p["y1"])), F.floor(F.size(words) / 2).cast("int"))

    def distance(p, q):
        across, down = F.greatest(p["x1"] - q["x2"], q["x1"] - p["x2"], F.lit(0.0)), F.greatest(p["y1"] - q["y2"], q["y1"] - p["y2"], F.lit(0.0))
        return F.hypot(across, down)

    far = lambda p: digits(p) & F.coalesce(F.forall(words, lambda q: distance(p, q) > heights * F.greatest(p["y2"] - p["y1"], usual)), F.lit(False))
    leave = F.when(F.size(words) > 0, F.filter(lines, far)).otherwise(F.slice(lines, 1, 0))
    stay = F.when(F.size(words) > 0, F.filter(lines, lambda p: ~far(p))).otherwise(lines)
    return F.when(F.exists(lines, digits), F.concat(F.array(stay), F.transform(leave, lambda p: F.array(p)))).otherwise(F.array(lines))


def group_bubbles(items: DataFrame, image_width: float = 1000.0, min_score: float = BUBBLE_SCORE) -> DataFrame:
    """Bubbles of each page from its words: lines are grouped in one pass over a page, all pages side by side; far numbers
    leave their bubbles by array conditions. A page from which a number left is numbered anew, by vertical centre. A page's
    bubbles stay one row until they are numbered, so pages are dealt once."""

    def build(boxes: layout.Boxes, column: np.ndarray, page: dict) -> list[dict]:
        lines = _lines(boxes, column, page, image_width)
        found = []
        for group in layout.bubbles_of(lines, min_score):
            found.append([{c: lines[n][c] for c in ("text", "score", "word_ids")} | {"line_id": n} | dict(zip(("x1", "y1", "x2", "y2"), layout._bounds(lines[n]["flat"]))) for n in group])
        return [{"page_id": page["page_id"][0], "bubbles": found}] if found else []

    line = "array<struct<text:string,score:double,word_ids:array<string>,line_id:int,x1:double,y1:double,x2:double,y2:double>>"
    rows = whole_pages(items, build, f"page_id long, bubbles array<{line}>")
    parts = rows.select("page_id", F.size("bubbles").alias("_n"), F.flatten(F.transform("bubbles", lambda lines: split_far_numbers(lines))).alias("_parts"))
    place = lambda lines: (_bounds(lines)["y1"] + _bounds(lines)["y2"]).alias("place")
    placed = F.array_sort(F.transform("_parts", lambda lines, k: F.struct(place(lines), k.alias("k"), lines.alias("lines"))))
    numbered = F.when(F.size("_parts") > F.col("_n"), F.transform(placed, lambda p: p["lines"])).otherwise(F.col("_parts"))
    parts = parts.select("page_id", F.posexplode(numbered).alias("bubble_no", "lines")).select("*", _bounds(F.col("lines")).alias("_b"))
    each = lambda c: F.transform("lines", lambda p: p[c])
    corners = F.array(*[F.array(F.col(f"_b.{x}"), F.col(f"_b.{y}")) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))])
    mean = F.aggregate(each("score"), F.lit(0.0), lambda a, x: a + x) / F.size("lines")
    return parts.select(
        "page_id", "bubble_no", F.array_join(each("text"), " ").alias("text"), F.size("lines").alias("line_count"), mean.alias("score"),
        each("line_id").alias("line_ids"), F.flatten(each("word_ids")).alias("word_ids"), corners.alias("box"),
    )


def _seam(first: list[str], second: list[str]) -> int:
    """The most words that end the first and begin the second."""
    return max((n for n in range(1, min(len(first), len(second)) + 1) if first[-n:] == second[:n]), default=0)


def _trimmed(better: dict, worse: dict) -> dict | None:
    """The worse reading without the words that it shares with the better one at their seam, its box cut by their share of
    its characters: at its beginning, or else at its end. None if neither leaves a text without any of these words."""
    words = worse["text"].split()
    for left in (True, False):
        n = _seam(better["bare"], worse["bare"]) if left else _seam(worse["bare"], better["bare"])
        gone, rest = (slice(0, n), slice(n, None)) if left else (slice(len(words) - n, None), slice(0, len(words) - n))
        if n and n < len(words) and not set(worse["bare"][gone]) & set(worse["bare"][rest]):
            cut = (worse["x2"] - worse["x1"]) * sum(map(len, words[gone])) / max(1, sum(map(len, words)))
            return worse | {"text": " ".join(words[rest]), "bare": worse["bare"][rest], "trimmed": True} | ({"x1": worse["x1"] + cut} if left else {"x2": worse["x2"] - cut})
    return None


def line_dedup(items: DataFrame, lines: DataFrame, word_share: float = 0.1, geo_share: float = 0.1, min_px: float = 5.0) -> DataFrame:
    """Items (page_id, pos, id, text, score, box) of the text lines (page_id, word_ids, and any number of the line's own)
    without duplicates: page_id, id, text, score, box, trimmed. Items of no line aren't among them.

    Of a line's items the best scores come first. One that shares enough words and area with a kept one loses the words at
    their seam; where none is left that way, it goes. Only items of one line are compared."""
    within = lines.select("page_id", F.col("word_ids"), F.xxhash64("page_id", "word_ids").alias("_line")).distinct()
    within = within.select("page_id", "_line", F.explode("word_ids").alias("id"))
    b = geo.bbox(F.col("box"))
    rows = items.select("page_id", "pos", "id", "text", "score", b.alias("_b")).join(within, ["page_id", "id"]).select("page_id", "_line", "pos", "id", "text", "score", "_b.*")

    def clean(line: list[dict]) -> list[dict]:
        kept: list[dict] = []
        for r in sorted(line, key=lambda r: (-r["score"], r["pos"])):
            r = r | {"trimmed": False, "bare": [re.sub(r"\W", "", w.lower()) for w in (r["text"] or "").split()]}
            for k in kept:
                mine, theirs = set(r["bare"]), set(k["bare"])
                inter = int(max(0.0, min(r["x2"], k["x2"]) - max(r["x1"], k["x1"]))) * int(max(0.0, min(r["y2"], k["y2"]) - max(r["y1"], k["y1"])))
                smaller = min((o["x2"] - o["x1"]) * (o["y2"] - o["y1"]) for o in (r, k))
                alike = mine and theirs and len(mine & theirs) / min(len(mine), len(theirs)) >= word_share
                if alike and inter >= min_px and smaller > 0 and inter / smaller > geo_share:
                    r = _trimmed(k, r)
                    break
            kept += [r] if r else []
        return [r | {"flat": layout.level(r["x1"], r["y1"], r["x2"], r["y2"])} for r in kept]

    def by_line(page: list[dict]) -> list[dict]:
        page.sort(key=lambda r: r["_line"])
        return [r for _, line in groupby(page, key=lambda r: r["_line"]) for r in clean(list(line))]

    return _with_box(per_page(rows, by_line, "page_id long, id string, text string, score double, flat array<double>, trimmed boolean"))


def reading_order(bubbles: DataFrame, mode: str = "ttb") -> DataFrame:
    """Adds ``order_no``: ttb by centre; rtl and ltr in rows of bubbles whose centres are near their row's mean."""
    c = geo.center(geo.bbox(F.col("box")))
    if mode == "ttb":
        return bubbles.withColumn("order_no", F.row_number().over(Window.partitionBy("page_id").orderBy(c["y"], c["x"], "bubble_id")))

    def order(page: list[dict]) -> list[dict]:
        middles = [(r["y1"] + r["y2"]) / 2 for r in page]
        heights = sorted(r["y2"] - r["y1"] for r in page)
        near = 0.8 * heights[len(heights) // 2]
        rows: list[list[int]] = []
        for k in sorted(range(len(page)), key=middles.__getitem__):
            if rows and abs(middles[k] - np.mean([middles[j] for j in rows[-1]])) <= near:
                rows[-1].append(k)
            else:
                rows.append([k])
        side = -1 if mode == "rtl" else 1
        flat = [k for row in rows for k in sorted(row, key=lambda k: side * (page[k]["x1"] + page[k]["x2"]))]
        return [{"page_id": page[k]["page_id"], "bubble_id": page[k]["bubble_id"], "order_no": n} for n, k in enumerate(flat, 1)]

    rows = bubbles.select("page_id", "bubble_id", geo.bbox(F.col("box")).alias("_b")).select("*", "_b.*").drop("_b")
    placed = per_page(rows, order, "page_id long, bubble_id string, order_no int")
    return bubbles.join(placed, ["page_id", "bubble_id"])


def renumber(bubbles: DataFrame) -> DataFrame:
    c = geo.center(geo.bbox(F.col("box")))
    order = Window.partitionBy("page_id").orderBy(c["y"], c["x"], "bubble_id")
    return bubbles.withColumn("new_id", F.concat(F.lit("bubble_"), F.row_number().over(order)))


#: Signs that part a bubble, and readings of an upright equals sign that do where there is a sure one.
SURE_SIGNS = "+=＋＝‖↓↑→←⇒⇓⇑⇐⬇⬆➡⬅"
WEAK_SIGNS = ["||", "|", "II", "ll", "Il", "lI"]


def split_operator_blocks(lines: DataFrame) -> DataFrame:
    """Lines (page_id, bubble_id, line_no, text) with ``block``: lines of signs alone part a bubble of three or more lines,
    each sign being a block; weak signs count once there is a sure one, and are written as ||. A bubble of signs alone
    stays whole."""
    bare = F.replace("text", F.lit(" "), F.lit(""))
    sure = (bare != "") & (F.translate(bare, SURE_SIGNS, "") == "")
    whole = Window.partitionBy("page_id", "bubble_id")
    order = whole.orderBy("line_no")
    rows = lines.withColumn("_sure", F.coalesce(sure, F.lit(False)))
    rows = rows.withColumns({"_signs": F.sum(F.col("_sure").cast("int")).over(whole), "_n": F.count(F.lit(1)).over(whole)})
    parted = (F.col("_n") >= 3) & (F.col("_signs") > 0) & (F.col("_signs") < F.col("_n"))
    weak = parted & ~F.col("_sure") & F.coalesce(bare.isin(WEAK_SIGNS), F.lit(False))
    rows = rows.withColumn("_weak", weak).withColumn("_m", parted & (F.col("_sure") | F.col("_weak")))
    before = F.lag("_m").over(order)
    start = before.isNotNull() & (F.col("_m") | before)
    rows = rows.withColumn("_s", start.cast("int")).withColumn("block", F.sum("_s").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("text", F.when(F.col("_weak"), "||").otherwise(F.col("text"))).drop("_sure", "_signs", "_n", "_weak", "_m", "_s")


def merge_sets(bubbles: DataFrame, sets: DataFrame) -> DataFrame:
    """Bubbles of each set (page_id, set_id, bubble_id) merged in reading order: texts, translations, box, lines."""
    rows = reading_order(bubbles).join(sets, ["page_id", "bubble_id"]).withColumn("_b", geo.bbox(F.col("box")))
    ordered = F.array_sort(F.collect_list(F.struct("order_no", "bubble_id", F.coalesce("text", F.lit("")).alias("t"), F.coalesce("translation", F.lit("")).alias("x"))))
    out = rows.groupBy("page_id", "set_id").agg(ordered.alias("_o"), F.min("_b.x1").alias("x1"), F.min("_b.y1").alias("y1"), F.max("_b.x2").alias("x2"), F.max("_b.y2").alias("y2"), F.sum("line_count").alias("line_count"))
    joined = lambda name: F.array_join(F.filter(F.transform("_o", lambda r: F.trim(r[name])), lambda s: s != ""), " ")
    return out.select("page_id", "set_id", F.transform("_o", lambda r: r["bubble_id"]).alias("merged_from"), joined("t").alias("text"), joined("x").alias("translation"), "x1", "y1", "x2", "y2", "line_count")


def covered_bubbles(bubbles: DataFrame, merged: DataFrame, sets: DataFrame) -> DataFrame:
    """Bubbles of no set whose centre lies in a merged set's box."""
    free = bubbles.join(sets, ["page_id", "bubble_id"], "left_anti").withColumn("_c", geo.center(geo.bbox(F.col("box"))))
    m = merged.select(F.col("page_id").alias("_p"), "set_id", "x1", "y1", "x2", "y2")
    inside = F.col("_c.x").between(F.col("x1"), F.col("x2")) & F.col("_c.y").between(F.col("y1"), F.col("y2"))
    return free.join(m, (free["page_id"] == m["_p"]) & inside).select("page_id", "bubble_id", "set_id")


def dropped_report(before: DataFrame, after: DataFrame, why: str, share: float = 0.6) -> DataFrame:
    """Rows (page_id, id, box) that a step removed, but for those that a survivor of the page mostly covers."""
    gone = before.join(after, ["page_id", "id"], "left_anti").withColumn("_b", geo.bbox(F.col("box")))
    left = after.select(F.col("page_id").alias("_p"), geo.bbox(F.col("box")).alias("_a"))
    covered = (gone["page_id"] == left["_p"]) & (geo.cover_share(F.col("_b"), F.col("_a")) > share)
    return gone.join(left, covered, "left_anti").drop("_b").withColumn("why", F.lit(why))


#: Boxes at least so tall, and so many times their width, are stacked letters; lower ones are specks.
TALL_PX, TALL_RATIO, SPECK_PX = 36.0, 2.5, 8.0


def rescue_candidates(readings: DataFrame, accepted: DataFrame, least: float = 0.3, share: float = 0.5, most: int = 12) -> DataFrame:
    """Rejected readings of a height of 8 pixels or more that no accepted box covers by half, with ``kind``: stacked
    columns, all of them, and lines of the score ``least`` or more, the best twelve of a page (``rank``)."""
    rows = readings.withColumn("_b", geo.bbox(F.col("box"))).where(F.col("_b.y2") - F.col("_b.y1") >= SPECK_PX)
    a = accepted.select(F.col("page_id").alias("_p"), geo.bbox(F.col("box")).alias("_a"))
    free = rows.join(a, (rows["page_id"] == a["_p"]) & (geo.cover_share(F.col("_b"), F.col("_a")) > share), "left_anti")
    w, h = F.col("_b.x2") - F.col("_b.x1"), F.col("_b.y2") - F.col("_b.y1")
    kind = F.when((h >= TALL_PX) & (h >= TALL_RATIO * F.greatest(w, F.lit(1.0))), "stacked").otherwise("line")
    free = free.withColumn("kind", kind).where((F.col("kind") == "stacked") | (F.col("score") >= least))
    rank = F.row_number().over(Window.partitionBy("page_id", "kind").orderBy(F.desc("score"), "id"))
    return free.withColumn("rank", rank).where((F.col("kind") == "stacked") | (F.col("rank") <= most)).drop("_b")


def carried_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """(page_id, pos, old_pos): for each new bubble of a page, in order, the first old one not yet taken that has a key in
    common; a bubble's keys are those of its text and of its text before corrections (text_raw)."""
    keys = lambda rows: F.array_distinct(F.filter(F.array(*[text.normalize_phrase(F.col(c)) for c in ("text", "text_raw") if c in rows.columns]), lambda k: k != ""))
    both = old.select("page_id", "pos", keys(old).alias("keys"), F.lit(True).alias("old")).unionByName(
        new.select("page_id", "pos", keys(new).alias("keys"), F.lit(False).alias("old"))
    )

    def match(page: list[dict]) -> list[dict]:
        pool: dict[str, list[int]] = {}
        for r in sorted((r for r in page if r["old"]), key=lambda r: -r["pos"]):
            for k in r["keys"]:
                pool.setdefault(k, []).append(r["pos"])
        taken, out = set(), []
        for r in sorted((r for r in page if not r["old"]), key=lambda r: r["pos"]):
            for k in r["keys"]:
                while pool.get(k) and pool[k][-1] in taken:
                    pool[k].pop()
            free = [pool[k][-1] for k in r["keys"] if pool.get(k)]
            if free:
                taken.add(min(free))
                out.append({"page_id": r["page_id"], "pos": r["pos"], "old_pos": min(free)})
        return out

    return per_page(both, match, "page_id long, pos int, old_pos int")


def carry_over(old: DataFrame, new: DataFrame) -> DataFrame:
    """New bubbles of re-read pages (page_id, pos, text, ..) with ``old_pos`` and what the old bubble of the same text had:
    a corrected source (text and text_raw), a manual skip, translation and draft, the review stamp where it belongs to that
    translation (and how it came about), layout, the mark against erasing, and the bulk edits. Old bubbles without a
    translation or a manual skip carry nothing."""
    said = F.trim(F.coalesce("translation", F.lit(""))) != ""
    manual = F.coalesce(F.col("skip_reason") == "manual", F.lit(False))
    worth = old.where(said | manual)
    have = [c for c in old.columns if c not in ("page_id", "pos")]
    pairs = carried_pairs(worth, new)
    o = worth.select("page_id", F.col("pos").alias("old_pos"), F.struct(*have).alias("_o"))
    rows = new.join(pairs, ["page_id", "pos"], "left").join(o, ["page_id", "old_pos"], "left")
    was = lambda c, kind="string": F.col(f"_o.{c}") if c in have else F.lit(None).cast(kind)
    mine = lambda c, kind="string": F.col(c) if c in new.columns else F.lit(None).cast(kind)
    translated = F.trim(F.coalesce(was("translation"), F.lit(""))) != ""
    stamped = translated & (was("confirmed_translation") == was("translation"))
    stamped = stamped & was("confirmed_at").isNotNull() if "confirmed_at" in have else stamped
    corrected = F.trim(F.coalesce(was("text_raw"), F.lit(""))) != ""
    skipped = F.coalesce(was("skip_reason") == "manual", F.lit(False))
    out = {
        "text": F.when(corrected, was("text")).otherwise(F.col("text")), "text_raw": F.when(corrected, was("text_raw")).otherwise(mine("text_raw")),
        "skip": skipped | F.coalesce(mine("skip", "boolean"), F.lit(False)), "skip_reason": F.when(skipped, "manual").otherwise(mine("skip_reason")),
        "translation": F.when(translated, was("translation")).otherwise(mine("translation")),
        "ai_translation": F.when(translated, F.coalesce(was("ai_translation"), was("translation"))).otherwise(mine("ai_translation")),
    }
    out |= {c: F.when(stamped, was(c)).otherwise(mine(c)) for c in ("confirmed_translation", "confirmed_at", "confirmed_via") if c in have}
    out |= {c: F.coalesce(was(c), new[c] if c in new.columns else was(c)) for c in ("layout", "no_auto_erase") if c in have}
    if "bulk_edits" in have:
        out["bulk_edits"] = F.when(translated, was("bulk_edits"))
    return rows.withColumns(out).drop("_o")


def more_complete(old: str = "old_text", new: str = "new_text"):
    """A condition: the new reading has more words, and three fifths of the old ones are still there, or ones like them."""
    bare = lambda c: F.filter(F.transform(text.words(F.lower(F.col(c))), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", "")), lambda w: w != "")
    a, b = bare(old), bare(new)
    more = F.size(b) > F.size(a)
    return more & ((F.size(a) == 0) | (helpers.kept_words(a, F.when(more, b).otherwise(F.array().cast("array<string>"))) >= 0.6 * F.size(a)))
