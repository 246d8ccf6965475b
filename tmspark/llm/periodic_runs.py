"""Periodic runs of words, by string synchronising sets.

A run is a stretch of words that repeats with a period q at least four times over and that no neighbour extends. At each
dyadic scale t the positions are chosen whose window of t words, or the window t words on, has the least hash of all
windows that begin from here to t words on; windows that repeat a period of at most t / 4 take no part. Whether a position
is chosen hangs on its next 2 t words alone, so equal contexts are chosen alike, and outside of the highly periodic
regions one of any t positions is chosen. A run whose period lies in [t, 2 t) therefore holds two chosen positions of
equal context just one period apart: chosen positions, joined with the next of equal context, propose all its periods.
The regions left out at a scale are those of runs found at smaller scales, which supply the small periods. A proposal is
followed word by word both ways, so what is returned is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tmspark.llm.common import chunks, give_back, mix64, small_batches

RUN_TYPE = "array<struct<start:long,length:long,period:long>>"
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: A run of period q has at least this many times q words: the scales' guarantee needs four.
TIMES = 4


def _shifted(values: np.ndarray, by: int) -> np.ndarray:
    """values[i + by]; beyond the end, the largest value."""
    out = np.full(len(values), NONE)
    out[: max(len(values) - by, 0)] = values[by:]
    return out


def _agree(codes: np.ndarray, at: np.ndarray, period: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """How many positions from ``at`` on, going by ``step``, hold the word that is one period on; at most ``room``."""
    count, open_, width = np.zeros(len(at), dtype=np.int64), np.flatnonzero(room > 0), 16
    while len(open_):
        reach = count[open_, None] + np.arange(width)
        inside = reach < room[open_, None]
        here = np.where(inside, at[open_, None] + step * reach, 0)
        same = inside & (codes[here] == codes[np.where(inside, here + period[open_, None], 0)])
        whole = same.all(axis=1)
        count[open_] += np.where(whole, width, same.argmin(axis=1))
        open_ = open_[whole]
        width = max(16, min(4 * width, 4096, (1 << 20) // max(len(open_), 1)))
    return count


def _chosen(keys: np.ndarray, ends: np.ndarray, scale: int) -> np.ndarray:
    """The scale's synchronising positions, in order: the least key from a position to ``scale`` on is at either end."""
    least, width = keys, 1
    while width < scale:
        least = np.minimum(least, _shifted(least, width))
        width *= 2
    far = _shifted(keys, scale)
    least = np.minimum(least, far)
    fits = np.arange(2 * scale, len(keys) + 2 * scale) <= ends
    return np.flatnonzero(fits & (least != NONE) & ((keys == least) | (far == least)))


def find_runs(codes: np.ndarray, lengths: np.ndarray, least: int = 6) -> np.ndarray:
    """Rows (document, start, length, period) of all runs of at least max(least, 4 period) words, in this order.

    ``codes`` are the documents' words as numbers, one document after another; ``lengths`` their numbers of words."""
    order = np.argsort(-lengths, kind="stable")  # the longest first, so those that a scale concerns are a prefix
    sizes = lengths[order]
    firsts = np.cumsum(sizes) - sizes
    was = (np.cumsum(lengths) - lengths)[order]
    codes = codes[np.arange(len(codes)) + np.repeat(was - firsts, sizes)]
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    hashes, scale, found = mix64(codes), 1, np.empty((0, 3), dtype=np.int64)
    while m := int(sizes[sizes >= TIMES * scale].sum()):
        codes_m, doc_m, hashes = codes[:m], doc[:m], hashes[:m]
        ends = (firsts + sizes)[doc_m]
        edge = np.zeros(m + 1, dtype=np.int32)
        start, length, period = found[(found[:, 2] * TIMES <= scale) & (found[:, 1] >= scale) & (found[:, 0] < m)].T
        np.add.at(edge, start, 1)
        np.add.at(edge, start + length - scale + 1, -1)
        at = _chosen(np.where(np.cumsum(edge[:m]) > 0, NONE, hashes), ends, scale)
        hashes = mix64(hashes * np.uint64(0x9E3779B97F4A7C15) + _shifted(hashes, scale))  # of twice as many words
        at = at[np.argsort(hashes[at], kind="stable")]
        one, two = at[:-1], at[1:]
        apart = two - one
        pair = (hashes[one] == hashes[two]) & (doc_m[one] == doc_m[two]) & (apart >= scale) & (apart < 2 * scale)
        one, apart = one[pair], apart[pair]
        by = np.lexsort((one, apart))
        one, apart = one[by], apart[by]
        new = np.ones(len(one), dtype=bool)  # proposals of one period that overlap by a period are of one run
        new[1:] = (apart[1:] != apart[:-1]) | (one[1:] - one[:-1] > 2 * scale) | (doc_m[one[1:]] != doc_m[one[:-1]])
        one, apart = one[new], apart[new]
        low = firsts[doc_m[one]]
        right = one + _agree(codes_m, one, apart, ends[one] - apart - one, 1)
        left = one - _agree(codes_m, one - 1, apart, one - low, -1)
        runs = np.stack([left, right + apart - left, apart], axis=1)
        found = np.concatenate([found, np.unique(runs[runs[:, 1] >= TIMES * runs[:, 2]], axis=0)])
        scale *= 2
    found = found[found[:, 1] >= least]
    at = doc[found[:, 0]]
    rows = np.stack([order[at], found[:, 0] - firsts[at], found[:, 1], found[:, 2]], axis=1)
    return rows[np.lexsort(rows.T[::-1])]


def _of_texts(texts: pa.Array, least: int) -> pa.Array:
    """struct<n_words, runs, collapsed> of each text."""
    count = len(texts)
    words = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    doc, flat = pc.list_parent_indices(words), pc.list_flatten(words)
    real = pc.greater(pc.binary_length(flat), 0)  # the ends of a text that begins or ends with a space
    doc, flat = np.asarray(doc.filter(real), dtype=np.int64), flat.filter(real)
    lengths = np.bincount(doc, minlength=count)
    runs = find_runs(np.asarray(flat.dictionary_encode().indices, dtype=np.int64), lengths, least)
    firsts = np.cumsum(lengths) - lengths
    edge = np.zeros(len(doc) + 1, dtype=np.int64)
    np.add.at(edge, firsts[runs[:, 0]] + runs[:, 1] + runs[:, 3], 1)
    np.add.at(edge, firsts[runs[:, 0]] + runs[:, 1] + runs[:, 2], -1)
    kept = np.cumsum(edge[:-1]) == 0
    fields = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
    ends = np.append(0, np.cumsum(np.bincount(runs[:, 0], minlength=count))).astype(np.int32)
    left = np.append(0, np.cumsum(np.bincount(doc[kept], minlength=count)))
    joined = pc.binary_join(pa.LargeListArray.from_arrays(left, flat.filter(pa.array(kept))), pa.scalar(" ", pa.large_string()))
    return pa.StructArray.from_arrays(
        [pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(ends, fields), joined.cast(pa.string())], ["n_words", "runs", "collapsed"]
    )


def runs_column(text: Column, least: int = 6) -> Column:
    """struct<n_words, runs, collapsed> of a text: its number of words ``[^\\x20\\x09-\\x0D]+``, its runs by start and
    period, and its words without those of a run after the run's first period, joined by single spaces. Null and empty
    texts have no word, no run and an empty ``collapsed``."""

    @F.arrow_udf(f"struct<n_words:long,runs:{RUN_TYPE},collapsed:string>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
            parts = [_of_texts(texts[a:b], least) for a, b in chunks(sizes)]
            yield pa.concat_arrays(parts) if parts else _of_texts(texts, least)
            give_back()

    return found(text)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6) -> DataFrame:
    """One row per row of ``docs``: the id, n_words, runs (array of start, length, period) and the collapsed text.

    No shuffle: texts are worked on whole, where they are. Repeated rows stay, null texts have no words, very long texts
    take time and memory in proportion to their length, columns other than id and text aren't read, and an empty table
    gives an empty one."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col), runs_column(F.col(text_col), least).alias("_r")).select(id_col, "_r.*")


def planted(text: Column, doc_id: Column) -> Column:
    """The text with a run in place of its words from some word on, where a hash of the id is a multiple of ten: the
    case that ``op12_periodic_runs`` adds to its table. Words are then parted by single spaces."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    h = F.crc32(doc_id.cast("string"))
    g, n = F.floor(h / 10), F.size(words).cast("long")
    first = g % F.greatest(n, F.lit(1))
    period = 1 + F.floor((n - first) / (3 + g % 8))
    unit = F.slice(words, (first + 1).cast("int"), period.cast("int"))
    tail = F.flatten(F.array_repeat(unit, F.ceil((n - first) / period).cast("int")))
    whole = F.slice(F.concat(F.slice(words, F.lit(1), first.cast("int")), tail), F.lit(1), n.cast("int"))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(whole, " ")).otherwise(text)
