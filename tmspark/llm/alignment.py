"""Alignment of two tokenizers' tokens over the same bytes, and how often each pair of ids is linked.

Tokens of a batch of texts are rows (document, first byte) on either side. An as-of merge keyed by document finds for
each token the other side's token that covers its first byte; two tokens overlap if either begins within the other, so
both directions together give every link once. Places where both sides' tokens end cut a text into groups.

How many documents hold a pair of ids linked is counted over the corpus. Documents ask for those counts by blocks, each
of which names a pair once: so a pair that every document holds is one row a block, wherever rows are joined by pairs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tmspark.llm.byte_bpe import Memo
from tmspark.llm.common import chunks, give_back, materialize, small_batches
from tmspark.llm.packing import byte_pieces
from tmspark.llm.token_counts import PRE_TOKEN

PAIRS = "array<struct<a:int,b:int,docs:int>>"
ROW_SCHEMA = f"n_a long, n_b long, n_groups long, n_links long, groups string, _block long, _links binary, _pairs {PAIRS}"


NO_TOKENS = (b"", b"")
#: A text may be cut before a space that follows no white space: no token of either side spans such a place,
#: nor does the pattern look past it.
CUT, GLUED = re.compile(r"(?<=\S)(?= )"), re.compile(r"\s ")


def cut_at_spaces(text: str) -> tuple[str, list[str]]:
    """The text's first part, and its other ones without the space that each begins with; see CUT."""
    if GLUED.search(text) is None:
        first, *rest = text.split(" ")
        return first, rest
    first, *rest = CUT.split(text)
    return first, [part[1:] for part in rest]


class Tokenizers:
    """Both sides of a text that a space is put before: A a byte-level byte-pair file of ``tokenizers``, B a model of
    ``sentencepiece`` that puts the space itself.

    No token of either spans a place before a space that follows no white space, so texts are encoded by the parts
    between these, and parts met before are remembered."""

    def __init__(self, path_a: str, path_b: str, memo: int = 200_000):
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as file:
            ranks = byte_pieces(json.load(file))
        if ranks is None:
            raise ValueError(f"not a byte-level file: {path_a}")
        self.a = tiktoken.Encoding("a", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = {n: piece for piece, n in ranks.items()}
        names = [self.b.id_to_piece(n) for n in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(n) else p.replace("▁", " ").encode() for n, p in enumerate(names)]
        if any("▁" in p.lstrip("▁") for p in names):
            raise ValueError(f"pieces of {path_b} span spaces")
        self.size_a = np.zeros(max(self.bytes_a) + 1, dtype=np.int64)
        self.size_a[list(self.bytes_a)] = [len(p) for p in self.bytes_a.values()]
        self.size_b = np.array([len(p) for p in self.bytes_b], dtype=np.int64)
        self.space, self.memo = self.b.piece_to_id("▁"), Memo(memo)
        shown = [f"{n}" for n in range(max(len(self.size_a), len(names)))]
        self.shown = {mark: np.array([n + mark for n in shown], dtype=object) for mark in ",|;"}

    def _part(self, part: str) -> tuple[bytes, bytes]:
        """Ids of both sides; none if either side's bytes aren't the part's."""
        a, b, whole = self.a.encode_ordinary(" " + part), self.b.encode(part) if part else [self.space], f" {part}".encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return NO_TOKENS
        return np.array(a, dtype=np.int32).tobytes(), np.array(b, dtype=np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Packed ids of both sides of each text; none where the text is empty or either side's bytes aren't the text's."""
        cut = []
        for text in texts:
            first, rest = cut_at_spaces(f" {text}") if text else ("", [])
            cut.append([first[1:], *rest] if first else rest)
        for part in self.memo.missing({p for parts in cut for p in parts}):
            self.memo.new[part] = self._part(part)
        out = []
        for parts in cut:
            pairs = [self.memo.new[p] for p in parts]
            whole = not any(p is NO_TOKENS for p in pairs)
            out.append((b"".join([a for a, _ in pairs]), b"".join([b for _, b in pairs])) if whole else NO_TOKENS)
        return out


def batch_links(sides: Tokenizers, texts: list[str]) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Of each text n_a, n_b, n_groups and groups; and a row a link: the text's number, and both ids."""
    coded = sides.encode(texts)
    n_a, n_b = (np.array([len(pair[k]) // 4 for pair in coded], dtype=np.int64) for k in (0, 1))
    a, b = (np.frombuffer(b"".join([pair[k] for pair in coded]), dtype=np.int32) for k in (0, 1))
    rows = pd.DataFrame({"n_a": n_a, "n_b": n_b, "n_groups": 0, "groups": ""})
    if not len(a):
        return rows, pd.DataFrame({"doc": a, "a": a, "b": a})
    end_a, end_b = np.cumsum(sides.size_a[a]), np.cumsum(sides.size_b[b])  # both sides have the same bytes
    doc = np.arange(len(texts))
    left = pd.DataFrame({"at": end_a - sides.size_a[a], "doc": np.repeat(doc, n_a), "a": a})
    right = pd.DataFrame({"at": end_b - sides.size_b[b], "doc": np.repeat(doc, n_b), "b": b})
    over_a = pd.merge_asof(left, right, on="at", by="doc")
    over_b = pd.merge_asof(right, left.assign(begin=left["at"]), on="at", by="doc")
    over_b = over_b[over_b["begin"] < over_b["at"]]  # where both begin together, the other direction has the link
    links = pd.concat([over_a[["doc", "a", "b"]], over_b[["doc", "a", "b"]]])
    ends = np.intersect1d(end_a, end_b, assume_unique=True)
    group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
    rows["n_groups"] = np.bincount(left["doc"].to_numpy()[np.searchsorted(end_a, ends)], minlength=len(texts))
    shown = np.empty(len(a) + len(b), dtype=object)
    last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
    place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")
    place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
    for ids, place, last, mark in ((a, place_a, last_a, "|"), (b, place_b, last_b, ";")):
        shown[place] = sides.shown[","][ids]
        shown[place[last]] = sides.shown[mark][ids[last]]
    to = np.cumsum(n_a + n_b)
    rows["groups"] = ["".join(shown[x:y].tolist())[:-1] for x, y in zip((to - n_a - n_b).tolist(), to.tolist())]
    return rows, links


class Block:
    """The pairs of ids that some texts hold, numbered as they are met, with the number of texts that hold each."""

    def __init__(self):
        self.codes, self.numbers = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.docs = np.empty(0, dtype=np.int64)

    def add(self, links: pd.DataFrame, texts: int) -> list[bytes]:
        """Each text's pairs by their numbers, and how often it holds them; see ``packed``."""
        codes = links["a"].to_numpy(dtype=np.int64) << 32 | links["b"].to_numpy(dtype=np.int64)
        met, which = np.unique(codes, return_inverse=True)
        at = np.searchsorted(self.codes, met)
        old = np.zeros(len(met), dtype=bool)
        old[at < len(self.codes)] = self.codes[at[at < len(self.codes)]] == met[at < len(self.codes)]
        numbers = np.empty(len(met), dtype=np.int64)
        numbers[old] = self.numbers[at[old]]
        numbers[~old] = len(self.codes) + np.arange((~old).sum())
        self.codes, self.numbers = np.insert(self.codes, at[~old], met[~old]), np.insert(self.numbers, at[~old], numbers[~old])
        keys, times = np.unique(links["doc"].to_numpy(dtype=np.int64) << 32 | numbers[which], return_counts=True)
        number = keys & 0xFFFFFFFF
        self.docs = np.append(self.docs, np.zeros(len(self.codes) - len(self.docs), dtype=np.int64))
        self.docs += np.bincount(number, minlength=len(self.docs))
        ends = np.cumsum(np.bincount(keys >> 32, minlength=texts))
        return [packed(number[a:b], times[a:b]) for a, b in zip([0, *ends[:-1]], ends)]

    def pairs(self) -> pa.Array:
        """A row of all pairs, by number."""
        codes = self.codes[np.argsort(self.numbers)]
        fields = [(codes >> 32), codes & 0xFFFFFFFF, self.docs]
        rows = pa.StructArray.from_arrays([pa.array(f.astype(np.int32)) for f in fields], ["a", "b", "docs"])
        return pa.ListArray.from_arrays(np.array([0, len(codes)], dtype=np.int32), rows)


def packed(numbers: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending numbers as steps, and times less one, byte plane after byte plane: the high ones are zeros."""
    values = np.concatenate([np.diff(numbers, prepend=0), times - 1]).astype("<u4")
    return values.view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    values = np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    return np.cumsum(values[: len(values) // 2]), values[len(values) // 2 :] + 1


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


_sides: dict[tuple[str, str], Tokenizers] = {}


def align(
    docs: DataFrame, files: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", most_pairs: int = 300_000
) -> DataFrame:
    """One row per row of ``docs``: the id, n_a, n_b, n_groups, n_links and ``groups``, the aligned ids as
    ``a1,a2|b1;a3|b2,b3``; and what ``with_counts`` reads, which is some rows more (those with ``_pairs``).

    Null and empty texts, and those that either side doesn't give back byte by byte, have no tokens: zeros and an empty
    ``groups``. Repeated rows stay, texts are aligned whole whatever their length, columns other than id and text aren't
    read, and an empty table gives an empty one. No shuffle; a block of rows ends when it holds ``most_pairs`` pairs."""
    small_batches(docs.sparkSession)
    files = files or default_files()
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = source.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if files not in _sides:
            _sides.clear()
            _sides[files] = Tokenizers(*files)
        number, block, of = TaskContext.get().partitionId() << 32, Block(), None
        names = ["_id", "n_a", "n_b", "n_groups", "n_links", "groups", "_block", "_links", "_pairs"]
        kinds = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int32())]))

        def closing() -> pa.RecordBatch:
            one = [pa.nulls(1, of), *[pa.array([0], pa.int64())] * 4, pa.nulls(1, pa.string()), pa.array([number], pa.int64()), pa.nulls(1, pa.binary())]
            return pa.RecordBatch.from_arrays([*one, block.pairs().cast(kinds)], names)

        for batch in batches:
            of, texts = batch.column(0).type, pc.fill_null(batch.column(1), "").to_pylist()
            for x, y in chunks(texts):
                rows, links = batch_links(_sides[files], texts[x:y])
                counted = np.bincount(links["doc"].to_numpy(dtype=np.int64), minlength=y - x)
                held = block.add(links, y - x)
                longs = [pa.array(np.asarray(c, dtype=np.int64)) for c in (rows["n_a"], rows["n_b"], rows["n_groups"], counted)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(x, y - x), *longs, pa.array(rows["groups"], pa.string()), pa.array([number] * (y - x), pa.int64())]
                    + [pa.array(held, pa.binary()), pa.nulls(y - x, kinds)],
                    names,
                )
                if len(block.codes) >= most_pairs:
                    yield closing()
                    number, block = number + 1, Block()
            give_back()
        if len(block.codes):
            yield closing()

    return source.mapInArrow(run, f"_id {id_type}, {ROW_SCHEMA}").withColumnRenamed("_id", id_col)


def with_counts(aligned: DataFrame) -> DataFrame:
    """The rows of ``align`` (with any columns added to it or taken from it, but for those that begin with ``_``), and
    n_best: links whose pair is held by as many documents as any pair of its A id; count_sum: over links, the documents
    that hold the pair.

    Rows are written once. A pair is a row a block where pairs are counted and where counts are given back, and a block's
    rows meet what it asked for in one task, which holds the pairs of one block."""
    table = materialize(aligned)
    pairs = table.where("_pairs is not null").select(F.col("_block").alias("_of"), F.posexplode("_pairs").alias("_n", "_p"))
    pairs = pairs.select("_of", "_n", "_p.*")
    counts = pairs.groupBy("a", "b").agg(F.sum("docs").alias("_count"))
    counts = counts.withColumn("_best", F.col("_count") == F.max("_count").over(Window.partitionBy("a")))
    answers = pairs.join(counts.hint("merge"), ["a", "b"]).select("_of", "_n", "_count", "_best")
    rows = table.where("_pairs is null").drop("_pairs")
    kept = [c for c in rows.columns if c not in ("_block", "_links")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(kept).schema) + ", n_best long, count_sum long"

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["_n"].to_numpy())
        count, best = right["_count"].to_numpy()[order], right["_best"].to_numpy()[order].astype(np.int64)
        n_best, total = [], []
        for data in left["_links"].to_pylist():
            number, times = unpacked(data)
            n_best.append(int((best[number] * times).sum()))
            total.append(int((count[number] * times).sum()))
        out = left.select(kept)
        return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))

    return rows.groupBy("_block").cogroup(answers.groupBy("_of")).applyInArrow(sums, schema)
