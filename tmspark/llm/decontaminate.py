"""Benchmark decontamination: a hash set of normalised test windows goes to every task, which scans training windows.

A window is ``n`` consecutive words of an item; an item of fewer words, but not none, is one window. A document's word
windows are looked up by hash and verified word by word. The set is some arrays, of about sixteen bytes a word of the
benchmark, and is broadcast only below ``broadcast_bytes`` of benchmark text; beyond it windows meet by a shuffle join
on their hashes instead, with the same result, whether documents or spans are removed.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tmspark.llm.common import broadcast_value, chunks, give_back, materialize, small_batches, words_of

HITS = "n_words long, n_hit long, items array<long>, spans array<struct<start:int,stop:int>>"
_LOWER = {c: c + 32 for c in range(65, 91)}
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WindowIndex:
    """Windows of all items as arrays: the items' word ids in a row, and for each length the sorted hashes of the
    windows of that length with where each begins. A window that an item repeats is held once."""

    def __init__(self, items: list[tuple[int | None, str | None]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items = [item for item, _ in items]
        ids = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)] for _, text in items]
        lengths = np.array([len(i) for i in ids], dtype=np.int64)
        self.flat = np.fromiter((i for own in ids for i in own), dtype=np.uint64, count=int(lengths.sum()))
        self.edges = np.concatenate(([0], np.cumsum(lengths)))
        sizes = np.minimum(lengths, n)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in np.unique(sizes[sizes > 0]).tolist():
            starts = np.concatenate([np.arange(self.edges[k], self.edges[k + 1] - size + 1) for k in np.flatnonzero(sizes == size)])
            hashes = rolling(self.flat, starts, size)
            order = np.lexsort((self.item_at(starts), hashes))
            hashes, starts = hashes[order], starts[order]
            again = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (self.item_at(starts[1:]) == self.item_at(starts[:-1]))))
            again[1:] &= self.same(self.flat, starts[1:], self.flat, starts[:-1], size) if len(starts) > 1 else True
            self.windows[size] = hashes[~again], starts[~again]

    def item_at(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, places, "right") - 1

    @staticmethod
    def same(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: int) -> np.ndarray:
        equal = np.ones(len(at), dtype=bool)
        for k in range(size):
            equal &= a[at + k] == b[bt + k]
        return equal

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in words), dtype=np.uint64, count=len(words))

    def find(self, ids: np.ndarray) -> Iterator[tuple[int, int, set[int | None]]]:
        """(first word, length, items) of each window in the ids of many documents parted by zeros."""
        known = np.concatenate(([0], np.cumsum(ids != 0)))
        for size, (hashes, places) in self.windows.items():
            if len(ids) < size:
                continue
            starts = np.flatnonzero(known[size:] - known[:-size] == size)
            hashed = rolling(ids, starts, size)
            low, high = np.searchsorted(hashes, hashed, "left"), np.searchsorted(hashes, hashed, "right")
            for k in np.flatnonzero(high > low):
                held = places[low[k] : high[k]]
                held = held[self.same(self.flat, held, ids, np.full(len(held), starts[k]), size)]
                if len(held):
                    yield int(starts[k]), size, {self.items[i] for i in self.item_at(held)}


def rolling(ids: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` ids at the given places."""
    total = np.zeros(len(starts), dtype=np.uint64)
    for k in range(size):
        total = total * _MULTIPLIER + ids[starts + k]
    return total


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def hits_in(texts: list[str | None], index: WindowIndex) -> list[dict]:
    """n_words, n_hit, items and hit word spans of each text, all texts scanned as one array of word ids."""
    words = [words_of(t) for t in texts]
    flat: list[bytes] = []
    starts = []
    for w in words:
        starts.append(len(flat))
        flat.extend(w)
        flat.append(b"")  # no word: windows don't run on into the next document
    found: dict[int, tuple[list, set]] = defaultdict(lambda: ([], set()))
    edges = np.array(starts)
    for at, size, items in index.find(index.ids(flat)):
        doc = int(np.searchsorted(edges, at, side="right")) - 1
        spans, its = found[doc]
        spans.append((at - starts[doc], at - starts[doc] + size))
        its |= items
    rows = []
    for doc, w in enumerate(words):
        spans, its = found.get(doc, ([], set()))
        spans = merged(spans)
        rows.append(
            {
                "n_words": len(w),
                "n_hit": sum(b - a for a, b in spans),
                "items": sorted((i for i in its if i is not None), key=str),
                "spans": [{"start": a, "stop": b} for a, b in spans],
            }
        )
    return rows


def _index(benchmark: DataFrame, n: int, item_col: str, text_col: str) -> WindowIndex:
    return WindowIndex([tuple(r) for r in benchmark.select(F.col(item_col).cast("long"), text_col).distinct().collect()], n)


def small_enough(benchmark: DataFrame, limit: int, text_col: str = "text") -> bool:
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    return size <= limit


def hit_column(text: Column, benchmark: DataFrame, n: int = 10, item_col: str = "item_id", text_col: str = "text") -> Column:
    """struct<n_words, n_hit, items, spans> of a text column; the benchmark is broadcast, so check its size before."""
    small_batches(benchmark.sparkSession)
    shared = broadcast_value(benchmark.sparkSession, _index(benchmark, n, item_col, text_col))

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            texts = texts.tolist()
            rows = [row for a, b in chunks(texts) for row in hits_in(texts[a:b], shared.value)]
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans"])
            give_back()

    return F.pandas_udf(scan, HITS)(text)


def text_key(text: Column) -> Column:
    """128 bits of hash that stand for a text in joins."""
    return F.struct(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2"))


def hits_by_join(docs: DataFrame, benchmark: DataFrame, n: int, text_col: str, item_col: str) -> DataFrame:
    """The same hits for a benchmark of any size, of the distinct texts: key (``text_key``), n_words, n_hit, items, spans.

    Short windows need every length that items have. Both sides are exploded to windows, of which a row is two hashes,
    and on the documents' side the text's key and the place; texts and words don't travel."""
    items = benchmark.select(F.col(item_col).cast("long").alias("_item"), _word_array(F.col("text")).alias("_w"))
    items = items.where(F.size("_w") > 0).withColumn("_size", F.least(F.size("_w"), F.lit(n))).distinct()
    windows = items.select("_item", "_size", F.explode(_windows("_w", "_size")).alias("_g")).select("_item", "_size", "_g.h").distinct()
    sizes = sorted(r[0] for r in windows.select("_size").distinct().collect())  # at most n numbers
    words = docs.select(text_key(F.col(text_col)).alias("key"), _word_array(F.col(text_col)).alias("_w"))
    found = None
    for size in sizes:
        at = words.select("key", F.explode(_windows("_w", F.lit(size))).alias("_g")).select("key", "_g.at", "_g.h")
        hit = at.join(windows.where(F.col("_size") == size).select("_item", "h"), "h").select("key", "_item", "at", F.lit(size).alias("size"))
        found = hit if found is None else found.unionByName(hit)
    base = words.select("key", F.size("_w").cast("long").alias("n_words")).distinct()
    if found is None:
        none = F.array().cast("array<struct<start:int,stop:int>>")
        return base.withColumns({"n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<long>"), "spans": none})
    places = found.select("key", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("p")).distinct()
    # Runs of hit words: their place less their rank is one number a run.
    run = F.col("p") - F.row_number().over(Window.partitionBy("key").orderBy("p"))
    runs = places.withColumn("_r", run).groupBy("key", "_r").agg(F.min("p").alias("start"), (F.max("p") + 1).cast("int").alias("stop"))
    spans = runs.groupBy("key").agg(F.sum(F.col("stop") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    names = found.select("key", "_item").distinct().groupBy("key").agg(F.array_sort(F.collect_list("_item")).alias("items"))
    return base.join(spans, "key", "left").join(names, "key", "left").select(
        "key", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<long>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")).alias("spans"),
    )


def _word_array(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(
        F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)), F.array().cast("array<string>")
    )


def _windows(words: str, size) -> Column:
    w, n = F.col(words), F.col(size) if isinstance(size, str) else size
    starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
    gram = lambda k: F.array_join(F.slice(w, k + 1, n), " ")
    return F.transform(starts, lambda k: F.struct(k.alias("at"), text_key(gram(k)).alias("h")))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    broadcast_bytes: int = 16 << 20,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit (words inside any occurring window), items (their ids).

    Null and empty texts have no words. An item with a null id marks words but is not listed; repeated items count
    once. An empty benchmark hits nothing; an empty table gives an empty one; other columns of ``docs`` aren't read."""
    if small_enough(benchmark, broadcast_bytes):
        scanned = docs.select(F.col(id_col), hit_column(F.col(text_col), benchmark, n, item_col).alias("_h"))
        return scanned.select(id_col, "_h.n_words", "_h.n_hit", "_h.items")
    hits = hits_by_join(docs, benchmark, n, text_col, item_col)
    rows = docs.select(F.col(id_col), text_key(F.col(text_col)).alias("key"))
    return rows.join(hits, "key").select(id_col, "n_words", "n_hit", "items")


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    words = list(_WORD.finditer(text.translate(_LOWER)))
    for start, stop in reversed(spans):
        text = text[: words[start].start()] + text[words[stop - 1].end() :]
    return text


def _cut_column(text: Column, spans: Column) -> Column:
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([cut_spans(t, [(s["start"], s["stop"]) for s in own]) for t, own in zip(texts, spans, strict=True)])

    return F.pandas_udf(cut, "string")(text, spans)


def cut_by_join(docs: DataFrame, benchmark: DataFrame, n: int, text_col: str, item_col: str) -> DataFrame:
    """``docs`` with the hit words cut, round by round: a round works on the distinct texts that the last one changed."""
    name = "_now"
    while name in docs.columns:
        name += "_"
    changed, left = None, docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("_was"), F.col(text_col).alias("_text")).distinct()
    while True:
        hits = hits_by_join(left, benchmark, n, "_text", item_col).where("n_hit > 0").select("key", "spans")
        hit = left.join(hits, text_key(F.col("_text")) == F.col("key")).select("_was", _cut_column(F.col("_text"), F.col("spans")).alias("_text"))
        hit = materialize(hit)
        if not hit.limit(1).count():
            break
        # A later round's text takes the place of an earlier one's.
        changed = hit if changed is None else changed.join(hit, "_was", "left_anti").unionByName(hit)
        left = hit
    if changed is None:
        return docs
    rows = docs.withColumn(name, text_key(F.col(text_col)))
    new = changed.select(text_key(F.col("_was")).alias(name), F.col("_text").alias(name + "new"))
    out = rows.join(new, name, "left").withColumn(text_col, F.coalesce(F.col(name + "new"), F.col(text_col)))
    return out.select(docs.columns)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents", text_col: str = "text", item_col: str = "item_id",
    broadcast_bytes: int = 16 << 20,
) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) without the hit words; columns stay as they are.

    Spans are cut again until no window occurs, as what a cut brings together may form one. Null and empty texts have no
    word and stay as they are; repeated rows go or stay together; an empty benchmark changes nothing, an empty table
    gives an empty one."""
    small = small_enough(benchmark, broadcast_bytes)
    if remove == "documents":
        if small:
            return docs.where(hit_column(F.col(text_col), benchmark, n, item_col)["n_hit"] == 0)
        bad = hits_by_join(docs, benchmark, n, text_col, item_col).where("n_hit > 0").select("key")
        return docs.join(bad, text_key(F.col(text_col)) == bad["key"], "left_anti")
    if not small:
        return cut_by_join(docs, benchmark, n, text_col, item_col)
    shared = broadcast_value(docs.sparkSession, _index(benchmark, n, item_col, "text"))

    def clean(texts: pd.Series) -> pd.Series:
        out = texts.tolist()
        for k, text in enumerate(out):
            while text and (spans := hits_in([text], shared.value)[0]["spans"]):
                text = out[k] = cut_spans(text, [(s["start"], s["stop"]) for s in spans])
        return pd.Series(out)

    return docs.withColumn(text_col, F.pandas_udf(clean, "string")(F.col(text_col)))
