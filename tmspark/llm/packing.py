"""Packing of tokenised documents into sequences of a fixed capacity, by large-item matching and best fit.

Lengths are integers up to the capacity, so the packing of all pieces follows from a histogram of lengths, which has
as many rows as the capacity however large the corpus is. The plan is made on that histogram: pieces above a third of
the capacity fill a bin at most two at a time, so the largest is matched with the largest partner that still fits;
smaller pieces then go, largest first, to the fullest bin that takes them. Bins of equal history are planned as one
kind with a multiplicity. Pieces find their bin by their rank among the pieces of their length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tmspark.llm.common import give_back, materialize, small_batches

PIECE_SCHEMA = "piece int, start long, length long, ids_crc32 long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@dataclass
class Kind:
    """``count`` bins, numbered from ``first``, that hold pieces of these lengths in this order."""

    first: int
    count: int
    lengths: tuple[int, ...]


def plan_bins(histogram: dict[int, int], capacity: int) -> list[Kind]:
    """Bins for ``histogram[length]`` pieces of each length from 1 to ``capacity``."""
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(not 1 <= n <= capacity for n in left):
        raise ValueError("a piece is longer than the capacity or empty")
    kinds: list[Kind] = []
    made = 0

    def add(count: int, lengths: tuple[int, ...]) -> None:
        nonlocal made
        kinds.append(Kind(made, count, lengths))
        made += count

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        big = large[-1]
        at = bisect.bisect_right(large, capacity - big) - 1
        if at < 0:
            add(left[big], (big,))
            left[big] = 0
        elif large[at] == big:
            if left[big] > 1:
                add(left[big] // 2, (big, big))
                left[big] %= 2
            else:  # one is left: its partner is the next smaller one
                if at:
                    small = large[at - 1]
                    add(1, (big, small))
                    left[small] -= 1
                    if not left[small]:
                        large.pop(at - 1)
                else:
                    add(1, (big,))
                left[big] = 0
        else:
            small = large[at]
            n = min(left[big], left[small])
            add(n, (big, small))
            left[big] -= n
            left[small] -= n
            if not left[small]:
                large.pop(at)
        if not left[big]:
            large.pop()
    gaps: dict[int, list[Kind]] = defaultdict(list)
    for kind in kinds:
        gaps[capacity - sum(kind.lengths)].append(kind)
    done = gaps.pop(0, [])
    for size in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        n = left[size]
        while n:
            gap = min((g for g in gaps if g >= size and gaps[g]), default=None)
            if gap is None:  # no bin takes it: as many new ones as these pieces fill
                fill = capacity // size
                whole, rest = divmod(n, fill)
                for count, times in ((whole, fill), (1, rest)):
                    if count and times:
                        kind = Kind(made, count, (size,) * times)
                        made += count
                        (gaps[g] if (g := capacity - size * times) else done).append(kind)
                n = 0
                continue
            kind = gaps[gap].pop()
            times = min(gap // size, n)
            count = min(kind.count, n // times)
            if count < kind.count:
                gaps[gap].append(Kind(kind.first + count, kind.count - count, kind.lengths))
            kind = Kind(kind.first, count, kind.lengths + (size,) * times)
            (gaps[g] if (g := gap - size * times) else done).append(kind)
            n -= count * times
    return done + [kind for kinds in gaps.values() for kind in kinds]


def placements(kinds: list[Kind]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, last rank, first bin, offset): the piece of rank r is in bin first + (r - first rank)."""
    given: dict[int, int] = defaultdict(int)
    rows = []
    for kind in kinds:
        offset = 0
        for length in kind.lengths:
            rank = given[length]
            rows.append((length, rank, rank + kind.count - 1, kind.first, offset))
            given[length] += kind.count
            offset += length
    return rows


def token_pieces(
    docs: DataFrame, capacity: int, end_id: int, vocabulary: str | None, id_col: str, text_col: str
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, and the document's number of ids.

    A document longer than the capacity is cut so that all pieces but the first are full. The ids are those that
    ``tokenizers`` gives for the vocabulary file; see ``encoder``."""
    path = vocabulary or default_vocabulary()

    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(path)
        for texts in batches:
            rows = []
            for text in texts:
                ids = np.append(np.asarray(encode(text or ""), dtype="<u4"), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                rows.append(
                    [
                        {"piece": k, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[a:b].tobytes())}
                        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
                    ]
                )
            yield pd.Series(rows)
            give_back()

    pieces = F.pandas_udf(cut, f"array<struct<{PIECE_SCHEMA.replace(' ', ':').replace(',:', ',')}>>")
    return docs.select(F.col(id_col), F.explode(pieces(F.col(text_col))).alias("_p")).select(id_col, "_p.*")


def byte_pieces(spec: dict) -> dict[bytes, int] | None:
    """Bytes of each piece of a byte-level BPE file to its id; None unless ids are the 256 bytes and then the merges in
    their order, for only then is the order of merges that of the ids."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "fuse_unk"))
    if not plain or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex"):
        return None
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    extra = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in piece): n for piece, n in model["vocab"].items() if piece not in extra}
    pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
    merged = (model["vocab"].get(a + b) for a, b in pairs)
    return ranks if all(n == 256 + k for k, n in enumerate(merged)) else None


def encoder(path: str):
    """Text to the ids that ``tokenizers`` gives for the file, without added special tokens.

    A byte-level BPE file is read into the quicker of the two libraries that run its merges; texts that hold one of the
    file's added tokens, and files of any other kind, go to ``tokenizers`` itself. Tests hold both against each other
    over a whole table."""
    import json
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    tokenizer = Tokenizer.from_file(path)
    ranks = byte_pieces(spec)
    if ranks is None:
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    import tiktoken

    from tmspark.llm.token_counts import PRE_TOKEN

    plain = tiktoken.Encoding(os.path.basename(path), pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    added = [t["content"] for t in spec.get("added_tokens", [])]

    def encode(text: str) -> list[int]:
        if any(token in text for token in added):
            return tokenizer.encode(text, add_special_tokens=False).ids
        return plain(text)

    return encode


def pack(
    docs: DataFrame,
    capacity: int = 1024,
    end_id: int = 2,
    vocabulary: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_rows: int = 50_000,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty and is a piece of just the end id; repeated rows are packed each by itself; an empty table gives
    an empty one; columns other than id and text aren't read. A full piece is a sequence by itself (of a negative
    number). The others are ranked within groups of their length of about ``group_rows``, so no length gathers in one
    task; the plan that is broadcast has some rows per length and never grows with the corpus."""
    spark = docs.sparkSession
    small_batches(spark)
    pieces = materialize(
        token_pieces(docs, capacity, end_id, vocabulary, id_col, text_col).withColumn("_row", F.monotonically_increasing_id())
    )
    names = [id_col, "piece", "start", "length", "ids_crc32"]
    full = pieces.where(F.col("length") == capacity).select(
        *names, (-F.col("_row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    part = pieces.where(F.col("length") < capacity)
    histogram = {r["length"]: r["count"] for r in part.groupBy("length").count().collect()}  # at most capacity rows
    plan = spark.createDataFrame(
        placements(plan_bins(histogram, capacity)), "length long, _from long, _to long, _bin long, offset long"
    )
    runs = plan.groupBy("length").agg(
        F.array_sort(F.collect_list(F.struct("_from", "_bin", "offset"))).alias("_runs")
    )
    sizes = spark.createDataFrame([(n, -(-c // group_rows)) for n, c in histogram.items()], "length long, _groups long")
    dealt = part.join(F.broadcast(runs.join(sizes, "length")), "length").withColumn(
        "_group", F.pmod(F.xxhash64("_row"), F.col("_groups"))
    )
    base = dealt.groupBy("length", "_group").agg(F.count(F.lit(1)).alias("_n"))
    base = base.select(
        "length", "_group", (F.sum("_n").over(Window.partitionBy("length").orderBy("_group")) - F.col("_n")).alias("_base")
    )
    order = Window.partitionBy("length", "_group").orderBy(id_col, "piece", "ids_crc32", "_row")
    ranked = (
        dealt.withColumn("_n", F.row_number().over(order) - 1)
        .join(base, ["length", "_group"])
        .withColumn("_rank", F.col("_base") + F.col("_n"))
        .withColumn("_run", F.element_at(F.filter("_runs", lambda r: r["_from"] <= F.col("_rank")), -1))
    )
    return full.unionByName(
        ranked.select(
            *names, (F.col("_run._bin") + F.col("_rank") - F.col("_run._from")).alias("sequence_id"), F.col("_run.offset").alias("offset")
        )
    )
