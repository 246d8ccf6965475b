"""Byte-level byte-pair encoding and decoding, as recursive and ordered DuckDB queries inside Spark's tasks.

A text is split by the vocabulary's pattern. A match that is an entry of the vocabulary is its id. The bytes of the
others are rows (word, position, token) of a recursive query: each step joins neighbours with the merge table, finds the
least rank of each word and contracts its leftmost pair; words without any pair left are given out. Words also end where
no entry spans the place. Other places of the same rank are contracted in the same step where that gives the same: if no
pair of a lower rank comes of it, so that the least rank stays the least until they are all contracted; so is any pair of
a lower rank than all entries that span its ends, as nothing can come before it there. Ids are read back in order of
position. Decoding joins (text, position, id) with the vocabulary and puts the bytes together by an ordered aggregate.

Only matches not met before in a worker are encoded; a bounded memo holds the others.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tmspark.llm.common import chunks, give_back, small_batches
from tmspark.llm.token_counts import PRE_TOKEN

#: Rows (word, pos, tok, bound) of ``given``, ``pos`` counted over all words, to those of the words' ids; ``bound`` is at
#: most the rank of any entry that spans the place before the row, and a word begins where it is 2147483647. ``made`` is
#: the rank of a row's pair with the next one, then its position; a pair is ``alone`` if it is of a lower rank than the
#: bounds of both its ends. Of a word's least rank there can be more pairs (``tied``). One is ``early`` if contracting it
#: makes a pair of lower rank, which would then come first: such a one is contracted as the word's leftmost only, and none
#: to the right of it in the same step. Of a run of pairs that overlap every second one is contracted.
ENCODE = """
WITH RECURSIVE step AS (
  SELECT word, pos, tok, bound, false AS done FROM given
  UNION ALL
  (WITH pairs AS (SELECT word, pos, tok, bound, lead(pos) OVER w AS next, lead(tok) OVER w AS after, lead(tok, 2) OVER w AS beyond,
                    lag(tok) OVER w AS before, lead(bound) OVER w AS edge, lead(bound, 2) OVER w AS far FROM step WHERE NOT done WINDOW w AS (ORDER BY pos)),
   ranked AS (SELECT p.word, p.pos, p.tok, p.bound, p.next, p.before, p.beyond, m.made::BIGINT << 32 | p.pos AS made,
                m.made < p.bound AND m.made < coalesce(p.far, 2147483647) AS alone
              FROM pairs p LEFT JOIN merges m ON m.pair = CASE WHEN p.edge < 2147483647 THEN p.tok::BIGINT << 32 | p.after END),
   least AS (SELECT word, min(made) AS least FROM ranked GROUP BY word),
   marked AS (SELECT r.*, l.least, coalesce(NOT r.alone AND r.made >> 32 = l.least >> 32, false) AS tie FROM ranked r JOIN least l ON r.word = l.word),
   several AS (SELECT DISTINCT word FROM marked WHERE tie AND made > least),
   tied AS (SELECT m.word, m.pos, m.next, m.made, m.least,
              coalesce(l.made < (m.made >> 32), false) OR coalesce(r.made < (m.made >> 32), false) OR coalesce(t.made < (m.made >> 32), false) AS early
            FROM marked m SEMI JOIN several s ON m.word = s.word
            LEFT JOIN lower l ON l.pair = (m.before::BIGINT << 32 | (m.made >> 32))
            LEFT JOIN lower r ON r.pair = ((m.made >> 32 << 32) | m.beyond)
            LEFT JOIN lower t ON t.pair = ((m.made >> 32 << 32) | (m.made >> 32))
            WHERE m.tie),
   open AS (SELECT pos, next FROM (SELECT *, min(CASE WHEN early THEN made END) OVER (PARTITION BY word) AS stop FROM tied)
            WHERE made = least OR stop IS NULL OR made < stop),
   runs AS (SELECT pos, row_number() OVER w AS nth, lag(next) OVER w IS DISTINCT FROM pos AS new FROM open WINDOW w AS (ORDER BY pos)),
   second AS (SELECT pos FROM (SELECT pos, nth - max(CASE WHEN new THEN nth END) OVER (ORDER BY pos) AS k FROM runs) WHERE k % 2 = 0),
   dealt AS (SELECT m.*, coalesce(m.alone OR m.made = m.least, false) OR s.pos IS NOT NULL AS wanted FROM marked m LEFT JOIN second s ON s.pos = m.pos),
   dropped AS (SELECT *, lag(wanted) OVER (ORDER BY pos) AS joined FROM dealt)
   SELECT word, pos, CASE WHEN wanted THEN (made >> 32)::INTEGER ELSE tok END, bound, least IS NULL FROM dropped WHERE joined IS DISTINCT FROM true)
)
SELECT pos, tok FROM step WHERE done ORDER BY pos
"""

DECODE = """
SELECT doc, array_to_string(list(piece ORDER BY pos), '') AS shown FROM given JOIN vocabulary USING (tok) GROUP BY doc ORDER BY doc
"""

def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    """Bytes of each entry to its rank, which is its id."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("not a byte-level vocabulary: it has no entry for some byte")
    return ranks


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """Each way to put an entry together from two others: pair (left << 32 | right), made, and whether it is of a lower
    rank than one of the two (lower)."""
    rows = []
    for piece, made in ranks.items():
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                rows.append((left, right, made))
    left, right, made = np.array(rows, dtype=np.int64).reshape(-1, 3).T
    return pa.table({"pair": left << 32 | right, "made": made.astype(np.int32), "lower": (made < left) | (made < right)})


class Bounds:
    """For each place between two bytes of a word, a rank that no entry which spans it goes below: an entry is either the
    two bytes, or holds three bytes around the place. Three bytes are told apart by a hash, which can only lower a bound."""

    NEVER = np.int32(2**31 - 1)

    def __init__(self, ranks: dict[bytes, int]):
        self.two, self.three = np.full(1 << 16, self.NEVER), np.full(1 << 18, self.NEVER)
        pieces = [p for p in ranks if len(p) > 1]
        size = np.array([len(p) for p in pieces], dtype=np.int64)
        rank = np.array([ranks[p] for p in pieces], dtype=np.int32)
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.int64)
        ends = np.cumsum(size)
        first = (ends - size)[size == 2]
        np.minimum.at(self.two, data[first] << 8 | data[first + 1], rank[size == 2])
        at = np.flatnonzero(np.arange(len(data)) + 2 < np.repeat(ends, size))
        np.minimum.at(self.three, self._hash(data, at), np.repeat(rank, size)[at])

    @staticmethod
    def _hash(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((data[at] << 16 | data[at + 1] << 8 | data[at + 2]) * 0x9E3779B1 & 0xFFFFFFFF) >> 14

    def of(self, data: np.ndarray, pos: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The bound before each byte; ``pos`` bytes of its word stand before it, ``left`` from it on. Before a word: never."""
        data, out = data.astype(np.int64), np.full(len(data), self.NEVER)
        at = np.flatnonzero(pos > 0)
        out[at] = self.two[data[at - 1] << 8 | data[at]]
        for back, more in ((2, 1), (1, 2)):
            near = at[(pos[at] >= back) & (left[at] >= more)]
            out[near] = np.minimum(out[near], self.three[self._hash(data, near - back)])
        return out


class Memo:
    """Strings to values, in two generations: when the newer is full it becomes the older one, which is let go."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def missing(self, keys: set[str]) -> list[str]:
        """Those keys that have no value yet; all others can then be read from ``new``."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        left = keys.difference(new)
        met = [key for key in left if key in old]
        new.update(zip(met, map(old.__getitem__, met)))
        return list(left.difference(met))


def splitter() -> Callable[[str], list[str]]:
    """All matches of the pattern in a text. For ASCII text the pattern's classes are written out character by character,
    as the standard module, which is faster there, doesn't know them."""
    space, letter, number = (
        "".join(f"\\x{ord(c):02x}" for c in regex.findall(kind, bytes(range(128)).decode())) for kind in (r"\s", r"\p{L}", r"\p{N}")
    )
    own = PRE_TOKEN.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]").replace(r"\S", f"[^{space}]")
    for kind, listed in ((r"\s", space), (r"\p{L}", letter), (r"\p{N}", number)):
        own = own.replace(kind, f"[{listed}]")
    ascii_only, every = re.compile(own).findall, regex.compile(PRE_TOKEN).findall
    return lambda text: ascii_only(text) if text.isascii() else every(text)


class Codec:
    """A vocabulary in a DuckDB connection of its own, on one thread."""

    def __init__(self, path: str, most_bytes: int = 400_000, memo: int = 400_000):
        import duckdb

        self.ranks, self.most_bytes = read_ranks(path), most_bytes
        self.split = splitter()
        self.matches = Memo(memo)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.bounds = Bounds(self.ranks)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        self.made: set[str] = set()

    def _table(self, name: str) -> None:
        """Makes the table of merges or the vocabulary when it is first wanted."""
        if name not in self.made:
            shown = [piece.decode("latin-1") for piece in self.ranks]  # a character a byte, as bytes aren't joined
            rows = merge_table(self.ranks) if name == "merges" else pa.table({"tok": pa.array(list(self.ranks.values()), pa.int32()), "piece": shown})
            self.db.register("rows", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM rows")
            self.db.unregister("rows")
            if name == "merges":
                self.db.execute("CREATE TABLE lower AS SELECT pair, made FROM merges WHERE lower")
            self.made.add(name)

    def _query(self, sql: str, **columns: np.ndarray) -> pa.Table:
        self.db.register("given", pa.table(columns))
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister("given")

    def contract(self, words: list[bytes]) -> list[bytes]:
        """The ids of each non-empty word, as little-endian 32-bit numbers."""
        self._table("merges")
        sizes = np.array([len(w) for w in words])
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        place = np.arange(len(data), dtype=np.int32)
        pos = (place - np.repeat(starts, sizes)).astype(np.int32)
        bound = self.bounds.of(data, pos, np.repeat(sizes, sizes) - pos)
        word = np.cumsum(bound == Bounds.NEVER, dtype=np.int32)
        rows = self._query(ENCODE, word=word, pos=place, tok=self.byte_ids[data], bound=bound)
        ids = rows["tok"].to_numpy().astype("<u4").tobytes()
        ends = [*(4 * np.searchsorted(rows["pos"].to_numpy(), starts)).tolist(), len(ids)]
        return [ids[a:b] for a, b in zip(ends, ends[1:])]

    def _learn(self, strings: list[str], memo: dict[str, bytes]) -> None:
        """Puts the ids of these matches of the pattern into the memo."""
        waiting, size = [], 0
        for k, string in enumerate(strings):
            word = string.encode()
            whole = self.ranks.get(word)
            if whole is not None:
                memo[string] = whole.to_bytes(4, "little")
            elif word:
                waiting.append((string, word))
                size += len(word)
            if waiting and (size > self.most_bytes or k + 1 == len(strings)):
                memo.update(zip([s for s, _ in waiting], self.contract([w for _, w in waiting])))
                waiting, size = [], 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit numbers."""
        found = [self.split(text) for text in texts]
        self._learn(self.matches.missing(set().union(*found)), self.matches.new)
        of_match = self.matches.new.__getitem__
        return [b"".join(map(of_match, matches)) for matches in found]

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of each run of ``sizes`` ids. An id that the vocabulary doesn't have is an error."""
        self._table("vocabulary")
        out = [b""] * len(sizes)
        if len(ids) and not np.isin(ids, np.fromiter(self.ranks.values(), dtype=np.int64)).all():
            raise ValueError("an id is not in the vocabulary")
        doc, pos = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.arange(len(ids), dtype=np.int32)
        rows = self._query(DECODE, doc=doc, pos=pos, tok=ids)
        for k, shown in zip(rows["doc"].to_pylist(), rows["shown"].to_pylist()):
            out[k] = shown.encode("latin-1")
        return out


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a vocabulary file; workers, and what they have met, outlive a task."""
    if path not in _codecs:
        _codecs.clear()
        _codecs[path] = Codec(path)
    return _codecs[path]


def _decoded(path: str, packed: list[bytes], most: int = 2_000_000) -> list[bytes]:
    """The bytes of each of some packed ids, at most that many bytes of ids at a time."""
    out = []
    for a, b in chunks(packed, most):
        sizes = np.array([len(v) // 4 for v in packed[a:b]], dtype=np.int64)
        out += codec(path).decode(np.frombuffer(b"".join(packed[a:b]), dtype="<i4"), sizes)
    return out


def encode_column(text: Column, vocabulary: str | None = None, packed: bool = False) -> Column:
    """A text's ids, as the public library of this vocabulary gives them for ordinary text: array<int>, or packed as
    little-endian unsigned 32-bit numbers (binary). Null and empty texts have none."""
    path = vocabulary or default_vocabulary()

    @F.arrow_udf("binary" if packed else "array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            strings, out = pc.fill_null(texts, "").to_pylist(), []
            for a, b in chunks(strings, 4_000_000):
                out += codec(path).encode(strings[a:b])
            if packed:
                yield pa.array(out, pa.binary())
            else:
                ends = np.append(0, np.cumsum([len(ids) // 4 for ids in out])).astype(np.int32)
                yield pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(out), dtype="<i4"))
            give_back()

    return encode(text)


def decode_column(packed: Column, vocabulary: str | None = None, most: int = 2_000_000) -> Column:
    """The bytes (binary) that packed ids stand for; null and none have none. An id that the vocabulary doesn't have is an
    error."""
    path = vocabulary or default_vocabulary()

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids in batches:
            yield pa.array(_decoded(path, pc.fill_null(ids, b"").to_pylist(), most), pa.binary())
            give_back()

    return decode(packed)


def round_trip_column(text: Column, vocabulary: str | None = None) -> Column:
    """A text's packed ids and the bytes that they stand for, struct<ids, bytes>: what ``decode_column`` gives for
    ``encode_column``, in one Python process a task instead of two."""
    path = vocabulary or default_vocabulary()

    @F.arrow_udf("struct<ids: binary, bytes: binary>")
    def round_trip(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            strings, ids, back = pc.fill_null(texts, "").to_pylist(), [], []
            for a, b in chunks(strings, 4_000_000):
                found = codec(path).encode(strings[a:b])
                ids += found
                back += _decoded(path, found)
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(back, pa.binary())], ["ids", "bytes"])
            give_back()

    return round_trip(text)


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", packed: bool = False) -> DataFrame:
    """One row per row of ``docs``: the id and ``ids`` (array<int>, or packed). No shuffle; null and empty texts have no
    ids, repeated rows stay, texts are encoded whole whatever their length, columns other than id and text aren't read,
    and an empty table gives an empty one."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col), encode_column(F.col(text_col), vocabulary, packed).alias("ids"))


def decode(encoded: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: the id, the packed ``ids`` and their ``bytes``. No shuffle; nulls have no bytes."""
    small_batches(encoded.sparkSession)
    ids = F.col(ids_col)
    return encoded.select(F.col(id_col), ids.alias("ids"), decode_column(ids, vocabulary).alias("bytes"))


def round_trip(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode`` of the packed ``encode`` in one step: the id, the packed ``ids`` and their ``bytes``."""
    small_batches(docs.sparkSession)
    found = docs.select(F.col(id_col), round_trip_column(F.col(text_col), vocabulary).alias("_found"))
    return found.select(F.col(id_col), "_found.ids", "_found.bytes")
