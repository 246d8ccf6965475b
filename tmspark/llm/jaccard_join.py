"""A self-join of texts on the Jaccard similarity of their word n-grams, by chosen paths.

A text is the set of its n-word shingles. Texts of equal sets are one node. In each run a set chooses each of its
tokens with probability 1 / (threshold * size), by hashes that all sets share, and goes to the bucket of each token
chosen; two sets at the threshold meet in a run with probability 1 - 1/e or more, so the number of runs follows from
the target recall: ``runs`` leave exp(-runs) unmet. Buckets above ``bucket_rows`` are split again by further chosen tokens, down to ``depth``. In the
last buckets all pairs are compared; one that stays large is compared in pairs of blocks, so nothing is dropped. Rows
that have met in a smaller bucket aren't paired again.

A pair is compared only in the smallest bucket that holds both, and only if sizes and sketches (how many
hashes lie in each of 64 ranges) allow it: sets differ by no less than their counts do, so no true pair is ruled out.
First the buckets are scanned without shingles for sets that have such a pair; then those alone are sent there with
their shingles, and pairs are verified exactly. Shingles are never stored: where a set's are wanted they are made again
from a text of it. What leaves a bucket is a row a set: the number of its links, and one link toward the set that
stands for the bucket's component. Intermediate tables go as soon as nothing reads them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tmspark.llm.common import chunks, discard, give_back, materialize, mix64, small_batches, words_of

BINS = 64
#: Tokens that a set offers for deeper choices: those of the lowest hashes, so many on average (times 1 / threshold).
OFFERED = 64
_FULL = float(2**64)
#: Shingles are told apart by 48 bits.
_KEPT = np.uint64(0xFFFFFFFFFFFF0000)
_COMBINE = np.uint64(0x9E3779B97F4A7C15)
SETS = "node long, size int, sketch binary, keys array<long>"


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of a text of fewer words, of all its words together."""
    n = min(n, len(words))
    if not n:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        total = total * _COMBINE + words[k : k + len(total)]
    return np.unique(mix64(total + np.uint64(n)) & _KEPT)


def pack(hashes: np.ndarray) -> bytes:
    """Six bytes a hash, as the two lowest are zero."""
    return np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpack(data: bytes) -> np.ndarray:
    whole = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    whole[:, 2:] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return whole.reshape(-1).view(np.uint64)


def _limit(share: np.ndarray) -> np.ndarray:
    """The hash below which tokens of this share lie."""
    return np.minimum(share * _FULL, _FULL - 2048).astype(np.uint64)


def describe(sets: list[np.ndarray], threshold: float, runs: int) -> list[tuple]:
    """(node, size, sketch, keys) of each set; an empty set has no node."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, dtype=np.uint64)
    doc = np.repeat(np.arange(len(sets)), sizes)
    sketch = np.zeros((len(sets), BINS), dtype=np.uint8)
    if len(flat):
        bins = (flat >> np.uint64(58)).astype(np.int64)
        counts = np.bincount(doc * BINS + bins, minlength=len(sets) * BINS).reshape(-1, BINS)
        sketch = np.minimum(counts, 255).astype(np.uint8)  # cut off, counts differ by less, never by more
    limit = _limit(1 / (threshold * np.maximum(sizes, 1)))[doc]
    keys: list[list[int]] = [[] for _ in sets]
    for run in range(runs):
        seed = np.uint64((0xA5A5A5A5 * (2 * run + 1)) & (2**64 - 1))
        chosen = np.flatnonzero(mix64(flat ^ mix64(np.array([seed]))) <= limit)
        for d, key in zip(doc[chosen].tolist(), mix64(flat[chosen] * _COMBINE + seed).view(np.int64).tolist(), strict=True):
            keys[d].append(key)
    return [
        (node_of(s), len(s), k.tobytes(), sorted(set(own))) if len(s) else None
        for s, k, own in zip(sets, sketch, keys, strict=True)
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def node_of(hashes: np.ndarray) -> int:
    """The number of a set, by a hash of its sorted shingles."""
    return _signed(xxhash.xxh64_intdigest(hashes.tobytes()))


def sets_in(batches: Iterator[pd.Series], n: int) -> Iterator[list[np.ndarray]]:
    """The shingle sets of the texts of each batch, some texts at a time; an empty list ends a batch."""
    memo: dict[bytes, int] = {}
    for texts in batches:
        texts = texts.tolist()
        for a, b in chunks(texts, 500_000):
            sets = []
            for text in texts[a:b]:
                words = words_of(text)
                for w in set(words):
                    if w not in memo:
                        memo[w] = xxhash.xxh64_intdigest(w)
                sets.append(shingle_hashes(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)), n))
                if len(memo) > 60_000:
                    memo.clear()
            yield sets
        yield []
        give_back()


def set_column(text, n: int, threshold: float, runs: int):
    """struct of SETS for a text column; null where the text has no word."""

    def make(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        rows: list = []
        for sets in sets_in(batches, n):
            if sets:
                rows += [r or (None, 0, None, []) for r in describe(sets, threshold, runs)]
                continue
            out = pd.DataFrame(rows, columns=["node", "size", "sketch", "keys"])
            out["node"] = out["node"].astype("Int64")
            rows = []
            yield out

    return F.pandas_udf(make, SETS)(text)


def offered_share(size: int, threshold: float) -> float:
    return min(1.0, OFFERED / (threshold * max(size, 1)))


def offer(tokens: np.ndarray, threshold: float) -> np.ndarray:
    """The tokens of the lowest hashes, ``OFFERED`` / threshold on average."""
    return tokens[tokens <= _limit(np.array([offered_share(len(tokens), threshold)]))[0]]


def shingle_column(text, n: int, offered: float | None = None):
    """struct of a text's set and its shingles, packed; with ``offered`` (the threshold), only those that it offers for
    deeper choices."""

    def make(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        rows: list = []
        for sets in sets_in(batches, n):
            if sets:
                rows += [(node_of(s), pack(s if offered is None else offer(s, offered))) for s in sets]
                continue
            yield pd.DataFrame(rows, columns=["node", "shingles"])
            rows = []

    # Not deterministic to the optimiser, or it would test the result for null below the join that leaves most texts out.
    return F.pandas_udf(make, "node long, shingles binary").asNondeterministic()(text)


def _children(threshold: float, branch: float):
    """Keys of the next level for a bucket's key, from the tokens that the set offers."""

    def make(keys: pd.Series, sizes: pd.Series, shingles: pd.Series) -> pd.Series:
        out = []
        for key, size, data in zip(keys, sizes, shingles, strict=True):
            tokens = unpack(data)
            share = min(1.0, branch / (threshold * size) / offered_share(size, threshold))
            path = mix64(np.array([key], dtype=np.int64).view(np.uint64))
            chosen = tokens[mix64(tokens ^ path) <= _limit(np.array([share]))[0]]
            out.append(mix64(chosen * _COMBINE + path).view(np.int64).tolist())
        return pd.Series(out)

    return F.pandas_udf(make, "array<long>")


class Texts:
    """The texts of ``docs`` and which of them stands for each node."""

    def __init__(self, docs: DataFrame, text_col: str, n: int, nodes: DataFrame):
        self.texts = docs.select(F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_key")).where("_text is not null")
        self.n, self.nodes = n, nodes

    def sets_of(self, nodes: DataFrame, offered: float | None = None, slots: int = 1 << 20) -> DataFrame:
        """(node, shingles) of each of the given nodes, made from its text; the offered ones only, if a threshold is given.

        Texts are first held against the wanted keys' residues, a table that is broadcast and has at most ``slots`` rows,
        so that the shingles of few but the wanted ones are made and shuffled; where most residues occur this filters
        little and changes nothing. Texts themselves are never shuffled."""
        wanted = self.nodes.join(nodes.select("node").distinct(), "node", "left_semi").select("node", "_key")
        residue = F.pmod("_key", F.lit(slots))
        some = F.broadcast(wanted.select(residue.alias("_slot")).distinct())
        near = self.texts.withColumn("_slot", residue).join(some, "_slot", "left_semi")
        made = near.select(shingle_column(F.col("_text"), self.n, offered).alias("_s")).select("_s.*")
        # Copies of a text may be very many: one a map task is shuffled.
        one = made.groupBy("node").agg(F.first("shingles").alias("shingles"))
        return one.join(wanted.select("node"), "node", "left_semi")


def leaf_buckets(nodes: DataFrame, texts: Texts, threshold: float, bucket_rows: int, depth: int, branch: float, bag: list[str]) -> DataFrame:
    """(key, node, members) of the buckets of 2 sets or more that aren't split further.

    A bucket whose largest child would hold half of it or more is one of near copies; no split parts those, so it is
    kept whole."""
    rows = nodes.select(F.explode("keys").alias("key"), "node")
    leaves = None
    for level in range(depth + 1):
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        rows = materialize(rows.join(sizes, "key"), bag)
        done = rows if level == depth else rows.where(F.col("members") <= bucket_rows)
        leaves = done if leaves is None else leaves.unionByName(done)
        large = rows.where(F.col("members") > bucket_rows)
        if level == depth or not large.limit(1).count():
            return leaves
        own = texts.sets_of(large, threshold).join(nodes.select("node", "size"), "node")
        child = large.join(own, "node").select(
            "node", "key", "members", F.explode(_children(threshold, branch)("key", "size", "shingles")).alias("child")
        )
        child = materialize(child.distinct(), bag)
        kept = child.groupBy("key", "members", "child").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(
            F.max(F.col("n") / F.col("members")).alias("share")
        ).where("share >= 0.5").select("key")
        leaves = leaves.unionByName(large.join(kept, "key", "left_semi"))
        rows = child.join(kept, "key", "left_anti").select(F.col("child").alias("key"), "node").distinct()
    return leaves


def _in_blocks(leaves: DataFrame, least: DataFrame, bucket_rows: int, block_rows: int) -> DataFrame:
    """Rows (key, node, members) with ``blocks``, ``block`` and ``pair``: a large bucket's rows are dealt to blocks, and a
    row goes to each pair of blocks that it is compared in; all 0 for the rest.

    Rows that have a smaller bucket in common as their smallest (``least``: node, p) have met there. Where so many of a
    bucket do that they fill a block, they are blocks by themselves and not paired with each other: of the many buckets
    that a group of near copies shares, all its pairs are looked at in one."""
    zero = F.lit(0).cast("long")
    small = leaves.where(F.col("members") <= bucket_rows).select("key", "node", "members", zero.alias("blocks"), zero.alias("block"), zero.alias("pair"))
    large = leaves.where(F.col("members") > bucket_rows).join(least, "node")
    sizes = large.groupBy("key", "p").agg(F.count(F.lit(1)).alias("c"))
    met = (F.col("p") < F.col("key")) & (F.col("c") >= block_rows)
    own = sizes.where(met).select("key", "p", F.ceil(F.col("c") / block_rows).cast("long").alias("n"))
    own = own.withColumn("first", F.sum("n").over(Window.partitionBy("key").orderBy("p")) - F.col("n"))
    mixed = sizes.groupBy("key").agg(F.ceil(F.sum(F.when(~met, F.col("c")).otherwise(0)) / block_rows).cast("long").alias("mixed"))
    total = mixed.join(own.groupBy("key").agg(F.sum("n").alias("_own")), "key", "left").select(
        "key", "mixed", (F.col("mixed") + F.coalesce("_own", F.lit(0))).alias("blocks")
    )
    rows = large.join(own, ["key", "p"], "left").join(total, "key")
    dealt = F.xxhash64("node", "key")
    first = F.col("mixed") + F.col("first")
    block = F.when(F.col("n").isNull(), F.pmod(dealt, F.greatest("mixed", F.lit(1)))).otherwise(first + F.pmod(dealt, F.col("n")))
    rows = rows.withColumn("block", block)
    every = F.sequence(zero, F.col("blocks") - 1)
    others = F.filter(every, lambda x: F.col("n").isNull() | (x < first) | (x >= first + F.col("n")))
    pairs = F.transform(others, lambda x: F.least(x, F.col("block")) * F.col("blocks") + F.greatest(x, F.col("block")))
    return small.unionByName(rows.select("key", "node", "members", "blocks", "block", F.explode(pairs).alias("pair")))


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches cut so that no (key, pair) runs over two of them; rows come sorted by these."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        if not len(batch):
            continue
        last = (batch["key"].to_numpy() == batch["key"].iloc[-1]) & (batch["pair"].to_numpy() == batch["pair"].iloc[-1])
        cut = len(batch) - int(last.sum())
        rest = batch.iloc[cut:]
        if cut:
            yield batch.iloc[:cut].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True)


def possible_pairs(rows: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (left, right) of the pairs of one bucket that are to be compared in it.

    Left out: pairs in another smaller bucket, pairs of one block in another pair of blocks, and pairs whose sizes or
    sketches show a similarity below the threshold. At the threshold t two sets of a and b shingles differ in at most
    (1 - t) / (1 + t) * (a + b) of them."""
    key, pair, block = (rows[c].to_numpy() for c in ("key", "pair", "block"))
    size, blocks = rows["size"].to_numpy(), np.maximum(rows["blocks"].to_numpy(), 1)
    sketch = np.frombuffer(b"".join(rows["sketch"]), dtype=np.uint8).reshape(-1, BINS)
    lists = [np.asarray(k) for k in rows["keys"]]
    width = max(map(len, lists))
    own_keys = np.full((len(rows), width), np.iinfo(np.int64).max)
    for k, x in enumerate(lists):
        own_keys[k, : len(x)] = x
    lefts, rights = [], []
    group = np.concatenate(([0], np.cumsum((key[1:] != key[:-1]) | (pair[1:] != pair[:-1]))))
    ends = np.append(np.flatnonzero(np.diff(group)) + 1, len(rows))[group]
    at = np.arange(len(rows))
    step = 1
    while len(at := at[at + step < ends[at]]):
        for part in np.array_split(at, max(1, len(at) // 100_000)):
            a, b = part, part + step
            ok = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b])
            a, b = a[ok], b[ok]
            same = block[a] == block[b]  # a block's own pairs belong to the pair of it and itself
            inner = pair[a] == 0
            ok = ~same | inner | (pair[a] == block[a] * blocks[a] + block[a])
            a, b = a[ok], b[ok]
            x, y = sketch[a], sketch[b]
            apart = (np.maximum(x, y) - np.minimum(x, y)).sum(axis=1, dtype=np.int64)
            ok = apart <= (1 - threshold) / (1 + threshold) * (size[a] + size[b]) + 1e-6
            a, b = a[ok], b[ok]
            for first in range(0, len(a), 20_000):
                p, q = a[first : first + 20_000], b[first : first + 20_000]
                smaller = np.zeros(len(p), dtype=bool)
                for column in range(width):
                    mine = own_keys[p, column]
                    look = mine < key[p]
                    if not look.any():
                        break
                    smaller[look] |= (own_keys[q[look]] == mine[look][:, None]).any(axis=1)
                lefts.append(p[~smaller])
                rights.append(q[~smaller])
        step += 1
    empty = np.zeros(0, dtype=np.int64)
    return (np.concatenate(lefts), np.concatenate(rights)) if lefts else (empty, empty)


def _scan(threshold: float):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _groups(batches):
            left, right = possible_pairs(rows, threshold)
            some = np.unique(np.concatenate((left, right)))
            yield rows.loc[some, ["key", "pair", "block", "blocks", "members", "node"]]
            give_back()

    return scan


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the given pairs of sorted sets."""
    used = np.unique(np.concatenate((left, right)))
    if len(left) * 8 < len(used) ** 2:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right, strict=True)])
    flat = np.concatenate([sets[k] for k in used])
    row = np.repeat(np.arange(len(used)), [len(sets[k]) for k in used])
    _, token, n = np.unique(flat, return_inverse=True, return_counts=True)
    shared = n[token] > 1
    _, token = np.unique(token[shared], return_inverse=True)
    row = row[shared]
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    total = np.zeros((len(used), len(used)), dtype=np.float32)
    width = max(64, (2 << 20) // len(used))  # 8 MB of a block of tokens
    for low in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        part = slice(*np.searchsorted(token, (low, low + width)))
        inside = np.zeros((len(used), width), dtype=np.float32)
        inside[row[part], token[part] - low] = 1
        total += inside @ inside.T
    place = np.zeros(int(used.max()) + 1, dtype=np.int64)
    place[used] = np.arange(len(used))
    return np.rint(total[place[left], place[right]]).astype(np.int64)


def _verify(threshold: float):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _groups(batches):
            left, right = possible_pairs(rows, threshold)
            node, copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
            data = [unpack(s) for s in rows["shingles"]]
            size = rows["size"].to_numpy()
            links, root = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
            key, pair = rows["key"].to_numpy(), rows["pair"].to_numpy()
            group = np.concatenate(([0], np.cumsum((key[1:] != key[:-1]) | (pair[1:] != pair[:-1]))))
            by = np.argsort(group[left], kind="stable")
            left, right = left[by], right[by]
            edges = np.flatnonzero(np.diff(group[left])) + 1 if len(left) else []
            for a, b in zip(np.split(left, edges), np.split(right, edges), strict=True):
                if not len(a):
                    continue
                both = intersections(data, a, b)
                ok = both >= threshold * (size[a] + size[b] - both) - 1e-9
                a, b = a[ok], b[ok]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                while len(a):  # the smallest place that each set of the bucket reaches
                    low = np.minimum(root[a], root[b])
                    before = root.copy()
                    np.minimum.at(root, a, low)
                    np.minimum.at(root, b, low)
                    root = root[root]
                    if (root == before).all():
                        break
            some = links > 0
            yield pd.DataFrame({"node": node[some], "links": links[some], "toward": node[root[some]]})
            del data, rows, left, right
            give_back()

    return verify


def _with_least(pairs: DataFrame, n_pairs: int) -> DataFrame:
    """``pairs`` (u, v) with ``m``, the least of each u and its v.

    A u of very many pairs isn't joined by a shuffle: such ones are broadcast, and as each has a ten-thousandth of all
    pairs or more, there are at most some ten thousand."""
    hub = max(1_000, n_pairs // 10_000)
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    hubs = F.broadcast(least.where(F.col("n") > hub).select("u", F.col("m").alias("hub_m")))
    marked = pairs.join(hubs, "u", "left")
    rest = marked.where("hub_m is null").join(least.where(F.col("n") <= hub).select("u", "m"), "u")
    return marked.where("hub_m is not null").select("u", "v", F.col("hub_m").alias("m")).unionByName(rest.select("u", "v", "m"))


def components(edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """(node, root) for the nodes of ``edges`` (node, toward): root is the smallest node reachable; and its folder.

    Alternates two steps until no edge changes: each node's larger neighbours are tied to its smallest neighbour, then
    its smaller ones are. Each step is a grouping and a join, so no neighbourhood is gathered in one place. A round's
    table goes when the next is written."""
    bag: list[str] = []
    now = materialize(edges.where("node <> toward").select(F.greatest("node", "toward").alias("u"), F.least("node", "toward").alias("v")).distinct(), bag)
    marks = (F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40)))
    mark = now.agg(*marks).first()
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * mark[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        turned = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(turned, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        old = list(bag)
        bag.clear()
        now = materialize(small.select("e.u", "e.v").where("u <> v").distinct(), bag)
        discard(edges.sparkSession, old)
        before, mark = mark, now.agg(*marks).first()
        if mark == before:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")), bag


def runs_for(target_recall: float) -> int:
    """Runs after which two sets at the threshold have met with this probability."""
    return max(1, math.ceil(-math.log(1 - target_recall)))


def join(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
    target_recall: float = 0.999999, runs: int | None = None, bucket_rows: int = 1024, depth: int = 2, branch: float = 1.5,
) -> DataFrame:
    """One row per row of ``docs``: id, class_id, n_links.

    n_links: other rows whose shingle sets have a Jaccard similarity of the threshold or more, equal sets included.
    class_id: the smallest id of the rows that links connect. Texts of fewer than ``n`` words have one shingle of all
    their words; those without a word (null, empty) are in no class but their own and have no links. Repeated rows are
    copies of each other. Rows with a null id take part; a class of such rows alone has a null class_id. An empty table
    gives an empty one; other columns aren't read. ``runs`` follow from ``target_recall`` unless given."""
    spark = docs.sparkSession
    small_batches(spark)
    runs = runs or runs_for(target_recall)
    raw, scratch, kept = [], [], []
    rows = materialize(
        docs.select(
            F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_key"), set_column(F.col(text_col), n, threshold, runs).alias("_s")
        ).select("_id", "_key", "_s.*"),
        raw,
    )
    nodes = materialize(
        rows.where("node is not null").groupBy("node").agg(
            F.count(F.lit(1)).alias("copies"), F.min("_id").alias("least"), F.min("_key").alias("_key"), F.first("size").alias("size"),
            F.first("sketch").alias("sketch"), F.first("keys").alias("keys"),
        ),
        scratch,
    )
    ids = materialize(rows.select("_id", "node"), kept)
    discard(spark, raw)
    texts = Texts(docs, text_col, n, nodes.select("node", "_key"))
    levels: list[str] = []
    leaves = materialize(leaf_buckets(nodes, texts, threshold, bucket_rows, depth, branch, levels).distinct(), scratch)
    discard(spark, levels)
    placed = _in_blocks(leaves, leaves.groupBy("node").agg(F.min("key").alias("p")), bucket_rows, bucket_rows)
    own = leaves.groupBy("node").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    about = nodes.select("node", "copies", "size", "sketch").join(own, "node")
    needed = materialize(
        placed.join(about, "node").select("key", "pair", "block", "blocks", "members", "node", "size", "sketch", "keys")
        .repartition("key", "pair").sortWithinPartitions("key", "pair", "node")
        .mapInPandas(_scan(threshold), "key long, pair long, block long, blocks long, members long, node long"),
        scratch,
    )
    found: list[str] = []
    verified = materialize(
        needed.join(about, "node").join(texts.sets_of(needed), "node")
        .repartition("key", "pair").sortWithinPartitions("key", "pair", "node")
        .mapInPandas(_verify(threshold), "node long, links long, toward long"),
        found,
    )
    about = materialize(nodes.select("node", "copies", "least"), kept)
    discard(spark, scratch)
    links = materialize(verified.groupBy("node").agg(F.sum("links").alias("links")), kept)
    root, last = components(verified.select("node", "toward"))
    known = materialize(
        about.join(links, "node", "left").join(root, "node", "left").withColumn("root", F.coalesce("root", "node")), kept
    )
    discard(spark, last + found)
    classes = known.groupBy("root").agg(F.min("least").alias("class_id"))
    result = known.join(classes, "root").select(
        "node", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    return ids.join(result, "node", "left").select(
        F.col("_id").alias(id_col),
        F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
