"""Language-model scoring by online logistic context mixing over counts of the whole corpus.

Bytes. A byte is predicted bit by bit, from the highest. For each of several contexts (the last 0 to 5 bytes) it is
known how often the next bit was 0 and 1 after that context and the bits of the byte so far. Predictions are mixed in
the logistic domain by weights of a set that the bits so far choose (the gate), and the mix is refined by an adaptive
map from the mixed probability and the byte before to the share of ones that followed.

Passages. Where a hash of the last three words (split at white space) is 0 modulo 16, one more bit says whether what
follows up to the next such place followed the same three words elsewhere. It is predicted by an adaptive map from how
often these words were seen and how many continuations they had. If it did, the passage costs that bit and the choice among
the continuations, by their counts; if not, that bit and its bytes. So long repeats are told from new text.

Leaving out. An occurrence in a training text is predicted by all others of the corpus, never by itself: counts are
taken one down. So training and held-out texts are scored alike, and a text that occurs twice shows.

Words are told apart by their own bytes (those of more than ``LONG`` bytes by SHA-512), windows are bytes; passages and the
words before them are hashes.

Counts are exact, of all training texts, and in tables in parts by context, so they grow with the corpus and no task or
driver holds them. Rows are dealt into blocks of some MB, of training texts or held-out ones. A block asks each part for
its distinct windows, passages and words, and says how often it has them; the part adds the blocks up and answers each.
Contexts of up to two bytes run over all parts; their counts (2^24 at most) are broadcast.

Weights are learned online: each part's windows come in small batches, each batch is predicted with the weights so far,
then these take a Newton step on it. The streams of all parts are merged by their curvatures, twice over all training
bytes; the map follows the second pass. In scoring, weights and maps stand still, so a text's score hangs on no order.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tmspark.llm.common import broadcast_value, discard, give_back, materialize, mix64

#: Lengths of the contexts in bytes; those of more than ``LOW`` are counted within a part.
ORDERS = (0, 1, 2, 3, 4, 5)
LOW = 2
REACH = max(ORDERS)
SPAN = REACH + 1
#: Words that a passage follows, and one in how many places begins one.
FOLLOWED, SPARSE = 3, 16
WINDOWS, PASSAGES, WORDS = 0, 1, 2
#: Bytes of the longest words that are kept as they are; the SHA-512 of a longer one has more hexadecimal digits.
LONG = 100
_BYTE, _EIGHT = np.uint64(255), np.uint64(8)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SCRAMBLED = mix64(np.arange(1, 257, dtype=np.uint64))
_PRIME, _BASE = np.uint64((1 << 31) - 1), 1_103_515_245
_RESIDUES = _SCRAMBLED % _PRIME
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def residues(n: int, base: int) -> np.ndarray:
    """The first n powers of the base modulo the prime."""
    out = np.ones(n, dtype=np.uint32)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, int(_PRIME))) % _PRIME
        done += more
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first n powers of the odd number and of its inverse, and of a base and its inverse modulo the prime; made once
    a process for the longest so far."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _ODD), ("back", _ODD_INVERSE)):
            made = np.full(n, base, dtype=np.uint64)
            made[:1] = 1
            _powers[name] = np.cumprod(made, out=made)
        _powers["up_prime"], _powers["back_prime"] = residues(n, _BASE), residues(n, pow(_BASE, -1, int(_PRIME)))
    return _powers["up"], _powers["back"], _powers["up_prime"], _powers["back_prime"]


class Slices:
    """Hashes of slices of a byte array, from running sums of scrambled bytes times powers of an odd number, and modulo a
    prime as well: modulo 2^64 alone, Thue-Morse words of a thousand bytes have the same sum whatever the number."""

    def __init__(self, data: np.ndarray):
        up, self.back, up_prime, self.back_prime = powers(max(len(data) + 1, 1 << 21))
        self.sums, self.primes = np.zeros((2, len(data) + 1), dtype=np.uint64)
        np.cumsum(_SCRAMBLED[data] * up[: len(data)], out=self.sums[1:])
        terms = _RESIDUES[data] * up_prime[: len(data)]
        np.cumsum((terms & _PRIME) + (terms >> np.uint64(31)), out=self.primes[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        prime = (self.primes[end] - self.primes[start]) % _PRIME * self.back_prime[start] % _PRIME
        return mix64((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) ^ mix64(prime))


def pair_key(context: np.ndarray, passage: np.ndarray) -> np.ndarray:
    return mix64(context ^ mix64(passage.astype(np.uint64)))


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order of appearance, and the number of each value's."""
    codes, kinds = pd.factorize(values.view(np.int64))
    return kinds.view(np.uint64), codes


def sorted_distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(values)), dtype=bool), values[1:] != values[:-1])))
    return values[first], np.diff(first, append=len(values))


class Places:
    """Where each of given values is among distinct keys, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys, bits = keys, max(4, int(4 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.zeros(1 << bits, dtype=np.int32)
        left, at = np.arange(len(keys)), self._first(keys)
        while len(left):
            free = self.slots[at[left]] == 0
            self.slots[at[left[free]]] = left[free]
            left = left[self.slots[at[left]] != left]
            at[left] = (at[left] + 1) & self.last

    def _first(self, values: np.ndarray) -> np.ndarray:
        return ((values * _ODD) >> self.shift).astype(np.int64)

    def find(self, values: np.ndarray) -> np.ndarray:
        """For values that all are keys."""
        at = self._first(values)
        found = self.slots[at]
        left = np.flatnonzero(self.keys[found] != values)
        while len(left):
            at[left] = (at[left] + 1) & self.last
            found[left] = self.slots[at[left]]
            left = left[self.keys[found[left]] != values[left]]
        return found


def windows_of(data: np.ndarray) -> np.ndarray:
    """For each byte but the first ``REACH``, the bytes before it, the nearest highest, and itself lowest."""
    n = len(data) - REACH
    out = np.zeros(n, dtype=np.uint64)
    for k in range(1, REACH + 1):
        out <<= _EIGHT
        out |= data[REACH - k : REACH - k + n]
    out <<= _EIGHT
    out |= data[REACH:]
    return out


@dataclass
class Piece:
    """Some texts of a block. Places are those of the text's own bytes, without what lies between texts."""

    texts: slice
    edges: np.ndarray  # where each text begins, and the end
    data: np.ndarray
    begin: np.ndarray  # where each text begins in the data, after some zeros
    windows: np.ndarray  # distinct ones, sorted
    n_windows: np.ndarray
    context: np.ndarray  # of each passage: the words before
    passage: np.ndarray
    passage_text: np.ndarray
    passage_start: np.ndarray
    passage_end: np.ndarray
    words: np.ndarray  # each lower-case word's number in the block
    word_text: np.ndarray


def windows_in(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The window of each byte of the texts."""
    own = np.ones(len(data), dtype=bool)
    for k in range(1, REACH + 1):
        own[begin - k] = False
    return windows_of(data)[own[REACH:]]


def read_piece(texts: list[bytes], first: int, numbers: dict[bytes, int]) -> Piece:
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(b"\0" * REACH + t for t in texts), dtype=np.uint8)
    edges = np.concatenate(([0], np.cumsum(sizes)))
    gap = REACH * np.arange(1, len(texts) + 1)  # bytes between texts up to each
    begin = edges[:-1] + gap
    spaces = _SPACE[data]
    for k in range(1, REACH + 1):  # the bytes between texts are no part of a word
        spaces[begin - k] = True
    window, n = sorted_distinct(windows_in(data, begin))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], spaces, [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    text = np.searchsorted(begin, start, "right") - 1
    slices = Slices(data)
    word = slices.hash(start, end)
    context = np.zeros(len(start), dtype=np.uint64)
    for back in range(FOLLOWED, 0, -1):
        context[back:] = mix64(context[back:] * _ODD + word[:-back])
    place = np.flatnonzero((np.arange(len(start)) - np.searchsorted(text, text) >= FOLLOWED) & (context % np.uint64(SPARSE) == 0))
    of = text[place]
    stop = begin[of] + sizes[of]  # up to the next passage of the text, or its end
    if len(place) > 1:
        stop[:-1] = np.where(of[1:] == of[:-1], start[place[1:]], stop[:-1])
    passage = slices.hash(start[place], stop) >> np.uint64(32)
    lower = _LOWER[data]
    lower[spaces] = 32
    words = np.fromiter(map(numbers.__getitem__, lower.tobytes().split()), np.int32, len(start))
    return Piece(
        slice(first, first + len(texts)), edges, data, begin, window, n, context[place], passage, of,
        start[place] - gap[of], stop - gap[of], words, text,
    )


def pieces_of(texts: list, numbers: dict[bytes, int], most: int = 2_000_000) -> Iterator[Piece]:
    """Some texts at a time, or one longer one. ``numbers`` gives each new word the next number."""
    raw, size, first = [], 0, 0
    for k, text in enumerate(texts):
        own = (text or "").encode("utf-8", "surrogatepass")
        if raw and size + len(own) > most:
            yield read_piece(raw, first, numbers)
            raw, size, first = [], 0, k
        raw.append(own)
        size += len(own)
    if raw:
        yield read_piece(raw, first, numbers)


def keys_of(window: np.ndarray, order: int) -> np.ndarray:
    """Context of that many bytes, and the byte."""
    return window >> np.uint64(8 * (SPAN - order)) << _EIGHT | window & _BYTE


def part_of_windows(window: np.ndarray, parts: int) -> np.ndarray:
    return (mix64(window >> np.uint64(8 * (SPAN - LOW - 1))) % np.uint64(parts)).astype(np.int64)


def part_of_hashes(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (mix64(hashes) % np.uint64(parts)).astype(np.int64)


def part_of_words(words: np.ndarray, parts: int) -> np.ndarray:
    return part_of_hashes(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)), parts)


@dataclass
class Asked:
    """What a block asks: distinct keys of each kind, and how often the block has each. Windows are sorted."""

    pieces: list[Piece]
    window: np.ndarray
    n_window: np.ndarray
    context: np.ndarray
    passage: np.ndarray
    n_passage: np.ndarray
    of_passage: np.ndarray
    word: np.ndarray  # bytes objects
    n_word: np.ndarray
    of_word: np.ndarray


def _joined(arrays: list[np.ndarray], kind=np.uint64) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=kind), *arrays])


def ask_of(texts: list) -> Asked:
    numbers: dict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    pieces = list(pieces_of(texts, numbers))
    window, n = added([_joined([]), *[p.windows for p in pieces]], [_joined([], np.int64), *[p.n_windows for p in pieces]])
    context, passage = _joined([p.context for p in pieces]), _joined([p.passage for p in pieces])
    pairs, of_passage = distinct(pair_key(context, passage))
    first = np.zeros(len(pairs), dtype=np.int64)
    first[of_passage] = np.arange(len(of_passage))
    of_word = _joined([p.words for p in pieces], np.int32)
    words = np.empty(len(numbers), dtype=object)
    words[:] = [w if len(w) <= LONG else hashlib.sha512(w).hexdigest().encode() for w in numbers]
    return Asked(
        pieces, window, n, context[first], passage[first], np.bincount(of_passage, minlength=len(pairs)), of_passage,
        words, np.bincount(of_word, minlength=len(words)), of_word,
    )


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    flat, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(flat, kind="stable")
    flat, n = flat[order], n[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(flat)), dtype=bool), flat[1:] != flat[:-1])))
    return flat[first], np.add.reduceat(n, first) if len(first) else n


def by_part(part: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The parts that occur, and the places of each, in order."""
    order = np.argsort(part, kind="stable")
    kinds, at = np.unique(part[order], return_index=True)
    return kinds, np.split(order, at[1:]) if len(kinds) else []


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted integers as compressed bytes of their differences, each place of a byte by itself."""
    steps = np.diff(x, prepend=np.uint64(0)).astype(np.uint64)
    return zlib.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64), dtype=np.uint64)


def pack_words(words: Iterable[bytes]) -> bytes:
    return zlib.compress(b"\n".join(words), 1)


def unpack_words(data: bytes) -> list[bytes]:
    return zlib.decompress(data).split()


def pack_counts(n: np.ndarray) -> bytes:
    return zlib.compress(n.astype("<i8").tobytes(), 1)


def unpack_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype="<i8")


ASKED = "kind int, part int, block int, held boolean, keys binary, more binary, counts binary"
TABLE = "kind int, part int, keys binary, counts binary, more binary"


def _arrow(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "long": pa.int64(), "double": pa.float64()}
    fields = [field.split(" ") for field in ddl.split(", ")]
    return pa.table({name: pa.array([r[k] for r in rows], kinds[kind]) for k, (name, kind) in enumerate(fields)})


def _ask(parts: int):
    def ask(rows: pa.Table) -> pa.Table:
        give_back()
        held, block = rows["_held"][0].as_py(), rows["_block"][0].as_py()
        asked, out = ask_of(rows["_text"].to_pylist()), []
        counts = lambda n: pack_counts(n * 0 if held else n)  # noqa: E731  held-out texts aren't counted
        for part, at in zip(*by_part(part_of_windows(asked.window, parts)), strict=True):
            out.append((WINDOWS, int(part), block, held, pack_sorted(asked.window[at]), b"", counts(asked.n_window[at])))
        for part, at in zip(*by_part(part_of_hashes(asked.context, parts)), strict=True):
            passage = asked.passage[at].astype(np.uint32).tobytes()
            out.append((PASSAGES, int(part), block, held, asked.context[at].tobytes(), passage, counts(asked.n_passage[at])))
        for part, at in zip(*by_part(part_of_words(asked.word, parts)), strict=True):
            out.append((WORDS, int(part), block, held, pack_words(asked.word[at]), b"", counts(asked.n_word[at])))
        return _arrow(out, ASKED)

    return ask


def _keys(kind: int, keys: bytes, more: bytes) -> np.ndarray:
    if kind == WINDOWS:
        return unpack_sorted(keys)
    return pair_key(np.frombuffer(keys, dtype=np.uint64), np.frombuffer(more, dtype=np.uint32))


def _add_blocks(rows: pa.Table) -> pa.Table:
    """The part's distinct keys and their counts, sorted but for words; blocks are added 32 at a time. A passage also has
    the count and the number of continuations of the words before it."""
    kind, part = rows["kind"][0].as_py(), rows["part"][0].as_py()
    keys, more, n = (rows[c].to_pylist() for c in ("keys", "more", "counts"))
    held = rows["held"].to_pylist()
    if kind == WORDS:
        sums: dict[bytes, int] = {}
        for k in np.flatnonzero(~np.array(held)):
            for word, times in zip(unpack_words(keys[k]), unpack_counts(n[k]).tolist(), strict=True):
                sums[word] = sums.get(word, 0) + times
        return _arrow([(kind, part, pack_words(sums), pack_counts(np.array(list(sums.values()), dtype=np.int64)), b"")], TABLE)
    total, counts, before = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    for a in range(0, len(keys), 32):
        # Held-out blocks' windows are needed in the table, as the answers are worked out for it.
        some = [k for k in range(a, min(a + 32, len(keys))) if kind == WINDOWS or not held[k]]
        own = [_keys(kind, keys[k], more[k]) for k in some]
        if kind == PASSAGES:
            flat = np.concatenate([total, *own])
            context = np.concatenate([before, *[np.frombuffer(keys[k], dtype=np.uint64) for k in some]])
            order = np.argsort(flat, kind="stable")
            flat, context = flat[order], context[order]
            before = context[np.concatenate((np.ones(min(1, len(flat)), dtype=bool), flat[1:] != flat[:-1]))]
        total, counts = added([total, *own], [counts, *[unpack_counts(n[k]) for k in some]])
    about = b""
    if kind == PASSAGES:
        codes, kinds = pd.factorize(before.view(np.int64))
        seen, ways = np.bincount(codes, counts, len(kinds)).astype(np.int64), np.bincount(codes, counts > 0, len(kinds)).astype(np.int64)
        about = pack_counts(np.concatenate((seen[codes], ways[codes])))
    return _arrow([(kind, part, pack_sorted(total), pack_counts(counts), about)], TABLE)


# --- passages


def passage_state(seen: np.ndarray, ways: np.ndarray) -> np.ndarray:
    """The cell of the passage map: how often the words before were seen, by powers of 2, and their continuations."""
    return np.minimum(np.log2(np.maximum(seen, 1)).astype(np.int64), 15) * 4 + np.minimum(np.maximum(ways, 1), 4) - 1


PASSAGE_CELLS = 64


def passage_bits(n: np.ndarray, seen: np.ndarray, ways: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log2 probability of what is coded at the place, whether the passage is) for counts without the occurrence."""
    chance = again[passage_state(seen, ways)]
    hit = n > 0
    bits = np.where(hit, np.log2(chance) + np.log2(np.maximum(n, 1) / np.maximum(seen, 1)), np.log2(1 - chance))
    return np.where(seen > 0, bits, 0.0), hit


def _passages_followed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums over a task's parts: how often a passage came again in each state, and how often the state occurred."""
    total = np.zeros((2, PASSAGE_CELLS))
    for batch in batches:
        for counts, more in zip(batch["counts"], batch["more"], strict=True):
            n = unpack_counts(counts)
            seen, ways = unpack_counts(more).reshape(2, -1)
            some = (n > 0) & (seen > 1)
            state = passage_state(seen[some] - 1, ways[some] - (n[some] == 1))
            total[0] += np.bincount(state, np.where(n[some] > 1, n[some], 0), PASSAGE_CELLS)
            total[1] += np.bincount(state, n[some], PASSAGE_CELLS)
    yield pd.DataFrame({"sums": [total.tobytes()]})


# --- bytes


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -12, 12)))


def node_inputs(key: np.ndarray, n: np.ndarray, less: int) -> np.ndarray:
    """(8, keys): for each bit of the byte of sorted distinct keys, the stretched prediction of its context and the bits
    so far in sixteenths, from the counts less that many of the key's own; 0 where nothing is left (or for a key that
    has not so many)."""
    out = np.zeros((8, len(key)), dtype=np.int8)
    if not len(key):
        return out
    for k in range(8):
        node = key >> np.uint64(8 - k)
        new = np.concatenate(([True], node[1:] != node[:-1]))
        first = np.flatnonzero(new)
        bit = key >> np.uint64(7 - k) & np.uint64(1) == 1
        to = np.cumsum(new) - 1
        ones = np.add.reduceat(np.where(bit, n, 0), first)[to] - less * bit
        total = np.add.reduceat(n, first)[to] - less
        some = (total > 0) & (ones >= 0) & (ones <= total)
        values = np.clip(np.rint(stretch((np.where(some, ones, 0) + 0.1) / (np.where(some, total, 0) + 0.2)) * 16), -127, 127)
        out[k] = np.where(some, values, 0).astype(np.int8)
    return out


@dataclass
class LowOrders:
    """Sorted keys of the two bytes before and the byte, and their training counts."""

    key: np.ndarray
    counts: np.ndarray

    def inputs(self, window: np.ndarray, less: int) -> list[np.ndarray]:
        asked, at = np.unique(keys_of(window, LOW), return_inverse=True)
        key = np.union1d(self.key, asked)
        n = np.zeros(len(key), dtype=np.int64)
        n[np.searchsorted(key, self.key)] = self.counts
        place = np.searchsorted(key, asked)[at]
        out = []
        for order in ORDERS[: LOW + 1]:
            own, to = np.unique(((key >> np.uint64(8 * (1 + LOW - order))) << _EIGHT) | (key & _BYTE), return_inverse=True)
            out.append(node_inputs(own, np.bincount(to, n, len(own)).astype(np.int64), less)[:, to[place]])
        return out


def inputs_of(window: np.ndarray, counts: np.ndarray, low: LowOrders, less: int) -> np.ndarray:
    """(orders, 8, windows) for a part's sorted windows: what their contexts say without ``less`` of each's own."""
    high = []
    for order in ORDERS[LOW + 1 :]:
        key, to = np.unique(keys_of(window, order), return_inverse=True)
        high.append(node_inputs(key, np.bincount(to, counts, len(key)).astype(np.int64), less)[:, to])
    return np.stack(low.inputs(window, less) + high)


STEPS = 49
WIDE = 1 + len(ORDERS)


@dataclass
class Mixing:
    weights: np.ndarray  # (256 gates, a constant and the orders)
    refined: np.ndarray  # (256 bytes before, steps)
    again: np.ndarray  # of passages

    def mix(self, inputs: np.ndarray, gate: np.ndarray, k: int) -> np.ndarray:
        x = self.weights[gate, 0].astype(np.float32)
        for order in range(len(ORDERS)):
            x += inputs[order, k] * np.float32(1 / 16) * self.weights[gate, 1 + order]
        return np.clip(x, -11, 11)

    def log2(self, window: np.ndarray, inputs: np.ndarray) -> np.ndarray:
        """log2 probability of the byte of each window: half the mix, half what followed such mixes."""
        byte, before = bytes_of(window)
        total = np.zeros(len(window), dtype=np.float32)
        refined = self.refined.reshape(-1)
        for k in range(8):
            x = self.mix(inputs, (byte | 256) >> (8 - k), k)
            p = (squash(x) + refined[cell_of(x, before)]) * np.float32(0.5)
            p = np.clip(p, 1 / 65536, 1 - 1 / 65536)
            total += np.log2(np.where((byte >> (7 - k)) & 1 == 1, p, 1 - p))
        return total


def cell_of(x: np.ndarray, before: np.ndarray) -> np.ndarray:
    return before * STEPS + ((x + np.float32(12)) * np.float32((STEPS - 1) / 24) + np.float32(0.5)).astype(np.int64)


def bytes_of(window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (window & _BYTE).astype(np.int64), (window >> np.uint64(8 * REACH)).astype(np.int64)


PRIOR = 4.0  # pulls gates that hardly occur to the start


def learn_online(window: np.ndarray, n: np.ndarray, inputs: np.ndarray, weights: np.ndarray, curve: np.ndarray, followed: np.ndarray | None, batch: int = 40_000) -> None:
    """Goes through windows (each ``n`` occurrences) batch by batch, in an order of its own: predicts, then moves the
    weights by the inverse of the curvature so far times the slope. ``weights``, ``curve`` and the map's sums change."""
    mixing = Mixing(weights, followed, followed)
    order = np.argsort(mix64(window), kind="stable")
    for a in range(0, len(order), batch):
        at = order[a : a + batch]
        at = at[np.argsort(window[at] & _BYTE, kind="stable")]  # a gate's windows lie together
        own, times, (byte, before) = inputs[:, :, at], n[at].astype(np.float64), bytes_of(window[at])
        slope = np.zeros((256, WIDE))
        for k in range(8):
            gate, bit = (byte | 256) >> (8 - k), (byte >> (7 - k)) & 1
            x = mixing.mix(own, gate, k)
            if followed is not None:
                cell = cell_of(x, before)
                followed[0] += np.bincount(cell, times * bit, followed.shape[1])
                followed[1] += np.bincount(cell, times, followed.shape[1])
            p = squash(x.astype(np.float64))
            signals = np.concatenate((np.ones((1, len(at))), own[:, k] / 16.0))
            first = np.concatenate(([0], np.flatnonzero(np.diff(gate)) + 1))
            gates = gate[first]
            slope[gates] += np.add.reduceat(signals * (times * (bit - p)), first, axis=1).T
            wave = times * p * (1 - p)
            for i in range(WIDE):
                curve[gates, i] += np.add.reduceat(signals * (signals[i] * wave), first, axis=1).T
        step = np.linalg.solve(curve, slope[:, :, None])[:, :, 0]
        weights += step * np.minimum(1, 1 / np.maximum(np.linalg.norm(step, axis=1), 1e-9))[:, None]


def _stream(start, low, mapped: bool):
    """A task's parts in a stream: its weights times its curvature, the curvature, and the map's sums."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = start.value.copy()
        curve = np.tile(np.eye(WIDE) * PRIOR, (256, 1, 1))
        followed = np.zeros((2, 256 * STEPS)) if mapped else None
        some = False
        for batch in batches:
            for keys, counts in zip(batch["keys"], batch["counts"], strict=True):
                window, n = unpack_sorted(keys), unpack_counts(counts)
                known = n > 0
                if known.any():
                    some = True
                    window, n = window[known], n[known]
                    learn_online(window, n, inputs_of(window, n, low.value, 1), weights, curve, followed)
        if some:
            moved = (curve @ weights[:, :, None])[:, :, 0]
            yield pd.DataFrame({"sums": [np.concatenate([moved.reshape(-1), curve.reshape(-1), np.zeros(0) if followed is None else followed.reshape(-1)]).tobytes()]})

    return run


def _sum_of(table: DataFrame, function, size: int) -> np.ndarray:
    """One task's sums at a time come to the driver, and are of a fixed size."""
    total = np.zeros(size)
    for row in table.mapInPandas(function, "sums binary").toLocalIterator():
        total += np.frombuffer(row["sums"])
    return total


def learn(table: DataFrame, low) -> Mixing:
    """Weights and maps from the tables of counts: two passes over all training windows, one over the passages."""
    spark = table.sparkSession
    windows, weights = table.where(F.col("kind") == WINDOWS), np.full((256, WIDE), 0.3)
    weights[:, 0] = 0
    cells = squash((np.arange(STEPS) * 24 / (STEPS - 1)) - 12)
    followed = np.zeros((2, 256 * STEPS))
    for mapped in (False, True):
        start = broadcast_value(spark, weights)
        size = 256 * WIDE * (1 + WIDE) + (followed.size if mapped else 0)
        sums = _sum_of(windows, _stream(start, low, mapped), size)
        start.unpersist()
        curve = sums[256 * WIDE : 256 * WIDE * (1 + WIDE)].reshape(256, WIDE, WIDE)
        if curve.any():
            weights = np.linalg.solve(curve, sums[: 256 * WIDE].reshape(256, WIDE, 1))[:, :, 0]
        if mapped:
            followed = sums[256 * WIDE * (1 + WIDE) :].reshape(2, -1)
    ones, n = followed.reshape(2, 256, STEPS)
    hits, tried = _sum_of(table.where(F.col("kind") == PASSAGES), _passages_followed, 2 * PASSAGE_CELLS).reshape(2, -1)
    return Mixing(weights.astype(np.float32), ((ones + 30 * cells) / (n + 30)).astype(np.float32), (hits + 0.4) / (tried + 2))


def low_orders(table: DataFrame) -> LowOrders:
    """Counts of the short contexts, summed over the parts; at most 2^24 rows, whatever the corpus."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for keys, n in zip(batch["keys"], batch["counts"], strict=True):
                key, to = np.unique(keys_of(unpack_sorted(keys), LOW), return_inverse=True)
                yield pd.DataFrame({"key": key.astype(np.int64), "n": np.bincount(to, unpack_counts(n), len(key)).astype(np.int64)})

    found = table.where(F.col("kind") == WINDOWS).mapInPandas(sums, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = found.where("n > 0").orderBy("key").toArrow()
    return LowOrders(found["key"].to_numpy().astype(np.uint64), found["n"].to_numpy())


# --- blocks and parts


def in_blocks(rows: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """Rows (_id, _held, _text) with ``_block``, of about that much text each, and the number of blocks. A block's texts
    are all training ones or all held out."""
    sizes = {r["_held"]: r["n"] for r in rows.groupBy("_held").agg(F.sum(F.octet_length("_text")).alias("n")).collect()}
    known, held = (max(4, -(-(sizes.get(h) or 0) // block_bytes)) for h in (False, True))
    dealt = F.xxhash64(F.lit("block"), "_id", "_text")
    block = F.when(F.col("_held"), F.lit(known) + F.pmod(dealt, F.lit(held))).otherwise(F.pmod(dealt, F.lit(known)))
    return rows.withColumn("_block", block.cast("int")), known + held


def count_all(blocks: DataFrame, parts: int, bag: list[str]) -> tuple[DataFrame, DataFrame]:
    """What blocks ask (a row a block, kind and part), and the tables of counts (a row a kind and part)."""
    asked = materialize(blocks.select("_block", "_held", "_text").groupBy("_block").applyInArrow(_ask(parts), ASKED), bag)
    return asked, materialize(asked.groupBy("kind", "part").applyInArrow(_add_blocks, TABLE), bag)


def bits_of_windows(mixing: Mixing, low: LowOrders, window: np.ndarray, counts: np.ndarray, held: bool) -> np.ndarray:
    """log2 of each window of a part for training occurrences (less their own) or for held-out ones."""
    bits = np.zeros(len(window), dtype=np.float32)
    inputs = inputs_of(window, counts, low, int(not held))
    for a in range(0, len(window), 250_000):
        bits[a : a + 250_000] = mixing.log2(window[a : a + 250_000], inputs[:, :, a : a + 250_000])
    return bits


def _answer(mixing, low):
    """For each block its keys' answers, in the order asked: log2 probabilities of windows and of passages (above 0, and
    negated, where the passage is coded), counts of words."""

    def answer(asked: pa.Table, table: pa.Table) -> pa.Table:
        kind = asked["kind"][0].as_py()
        key, n, more = (table[c][0].as_py() for c in ("keys", "counts", "more"))
        n, out, bits = unpack_counts(n), [], {}
        if kind == WORDS:
            known = dict(zip(unpack_words(key), n.tolist(), strict=True))
            for keys in asked["keys"].to_pylist():
                out.append(pack_counts(np.array([known.get(w, 0) for w in unpack_words(keys)], dtype=np.int64)))
            return _answered(asked, out)
        key = unpack_sorted(key)
        if kind == PASSAGES:
            seen, ways = unpack_counts(more).reshape(2, -1)
            by_context: dict = {}
        for held, keys, also in zip(asked["held"].to_pylist(), asked["keys"].to_pylist(), asked["more"].to_pylist(), strict=True):
            own = _keys(kind, keys, also)
            at = np.minimum(np.searchsorted(key, own), max(len(key) - 1, 0))
            known = key[at] == own if len(key) else np.zeros(len(own), dtype=bool)
            if kind == WINDOWS:
                if held not in bits:
                    bits[held] = bits_of_windows(mixing.value, low.value, key, n, held)
                out.append(bits[held][at].tobytes())
            elif held and not known.all():
                # The words before may be known though this continuation isn't.
                context = np.frombuffer(keys, dtype=np.uint64)
                if not by_context:
                    trained = [np.zeros(0, dtype=np.uint64)]
                    rows = zip(asked["held"].to_pylist(), asked["keys"].to_pylist(), asked["more"].to_pylist(), strict=True)
                    for h, c, m in rows:
                        if not h:
                            trained.append(np.stack((np.frombuffer(c, dtype=np.uint64), _keys(kind, c, m)), 1).reshape(-1))
                    flat = np.concatenate(trained).reshape(-1, 2)
                    kinds, first = np.unique(flat[:, 0], return_index=True)
                    place = np.searchsorted(key, flat[first, 1])
                    by_context.update(context=kinds, place=place)
                where = np.minimum(np.searchsorted(by_context["context"], context), max(len(by_context["context"]) - 1, 0))
                met = by_context["context"][where] == context if len(by_context["context"]) else np.zeros(len(context), dtype=bool)
                place = by_context["place"][where] if met.any() else np.zeros(len(context), dtype=np.int64)
                s, w = (np.where(met, v[place] if met.any() else 0, 0) for v in (seen, ways))
                out.append(_signed(*passage_bits(np.where(known, n[at] if len(key) else 0, 0), s, w, mixing.value.again)))
            else:
                one = int(not held)
                counts = n[at] - one
                out.append(_signed(*passage_bits(counts, seen[at] - one, ways[at] - (counts == 0) * one, mixing.value.again)))
        return _answered(asked, out)

    return answer


def _answered(asked: pa.Table, out: list[bytes]) -> pa.Table:
    return pa.table({"block": asked["block"], "kind": asked["kind"], "part": asked["part"], "answer": pa.array(out, pa.binary())})


def _signed(bits: np.ndarray, hit: np.ndarray) -> bytes:
    return np.where(hit, -bits, bits).astype(np.float32).tobytes()


def in_order(kind: int, parts_of: np.ndarray, rows: list[tuple], read, dtype) -> np.ndarray:
    """A block's answers of one kind, put back in the order of its keys."""
    out = np.zeros(len(parts_of), dtype=dtype)
    found = {part: data for k, part, data in rows if k == kind}
    for part, at in zip(*by_part(parts_of), strict=True):
        out[at] = read(found[int(part)])
    return out


def text_scores(asked: Asked, bits: np.ndarray, passages: np.ndarray, n: int) -> np.ndarray:
    """log2 probability of each of a block's n texts from those of its windows and passages."""
    total, done, places = np.zeros(n), 0, Places(asked.window)
    for piece in asked.pieces:
        of_byte = bits[places.find(windows_in(piece.data, piece.begin))]
        so_far = np.concatenate(([0.0], np.cumsum(of_byte, dtype=np.float64)))
        own = passages[asked.of_passage[done : done + len(piece.context)]]
        done += len(piece.context)
        inside = so_far[piece.passage_end] - so_far[piece.passage_start]
        more = np.where(own > 0, -own - inside, own)  # a passage that came again takes the place of its bytes
        total[piece.texts] = np.diff(so_far[piece.edges]) + np.bincount(piece.passage_text, more, len(piece.edges) - 1)
    return total


SCANNED = "n_tokens long, n_known long, base double, bits double, n_bytes long"


def _scan(parts: int, ends: int):
    end = np.log10(ends + 0.5)

    def scan(rows: pa.Table, answers: pa.Table) -> pa.Table:
        give_back()
        texts = rows["_text"].to_pylist()
        asked, n = ask_of(texts), len(texts)
        found = list(zip(*(answers[c].to_pylist() for c in ("kind", "part", "answer")), strict=True))
        floats = lambda data: np.frombuffer(data, dtype=np.float32)
        bits = in_order(WINDOWS, part_of_windows(asked.window, parts), found, floats, np.float32)
        passages = in_order(PASSAGES, part_of_hashes(asked.context, parts), found, floats, np.float32)
        counts = in_order(WORDS, part_of_words(asked.word, parts), found, unpack_counts, np.int64)[asked.of_word]
        text = _joined([p.word_text + p.texts.start for p in asked.pieces], np.int64)
        columns = {
            "n_tokens": np.bincount(text, minlength=n) + 1,
            "n_known": np.bincount(text, counts > 0, n).astype(np.int64) + int(ends > 0),
            "base": np.bincount(text, np.log10(counts + 0.5), n) + end,
            "bits": text_scores(asked, bits, passages, n),
            "n_bytes": _joined([np.diff(p.edges) for p in asked.pieces], np.int64),
        }
        return pa.table({"_id": rows["_id"], "_held": rows["_held"]} | {c: pa.array(v) for c, v in columns.items()})

    return scan


def parts_for(number: int) -> int:
    return max(6, -(-number // 2))


def score(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 16 << 20, parts: int | None = None
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Learns from the rows where ``held_out`` is false. ``score`` is the mixing model's log10 probability of the text
    (0 for null and empty texts), a training text's without its own occurrences, and ``bits_per_byte`` what that comes
    to (null for empty texts). ``base_score`` sums log10((c + 0.5) / (N + 0.5 * (V + 1))) over words and one end, by full
    counts. ``block_bytes`` is the text of a block; neither it nor the number of
    parts changes counts. Repeated rows stay and count as occurrences of each other, very long texts are blocks of their
    size, an empty table gives an empty one, other columns aren't read."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(held_out, F.lit(False)).alias("_held"), F.col(text_col).alias("_text"))
    bag: list[str] = []
    blocks, number = in_blocks(rows, block_bytes)
    parts = parts or parts_for(number)
    asked, table = count_all(blocks, parts, bag)
    low = broadcast_value(spark, low_orders(table))
    model = broadcast_value(spark, learn(table, low))
    answers = asked.groupBy("kind", "part").cogroup(table.groupBy("kind", "part")).applyInArrow(
        _answer(model, low), "block int, kind int, part int, answer binary"
    )

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = [unpack_counts(c) for c in batch["counts"]]
            yield pd.DataFrame({"n": [int(x.sum()) for x in n], "kinds": [int((x > 0).sum()) for x in n]})

    words = table.where(F.col("kind") == WORDS).mapInPandas(totals, "n long, kinds long")
    n_words, n_kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    ends = rows.where(~F.col("_held")).count()
    n_all, n_kinds = n_words + ends, n_kinds + (ends > 0)
    norm = float(np.log10(n_all + 0.5 * (n_kinds + 1)))
    id_type = rows.schema["_id"].dataType.simpleString()
    kept: list[str] = []
    scanned = materialize(
        blocks.groupBy("_block").cogroup(answers.groupBy("block")).applyInArrow(_scan(parts, ends), f"_id {id_type}, _held boolean, {SCANNED}"), kept
    )
    discard(spark, bag)
    return scanned.select(
        F.col("_id").alias(id_col),
        F.col("_held").alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("bits") * F.lit(float(np.log10(2.0)))).alias("score"),
        F.when(F.col("n_bytes") > 0, -F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )
