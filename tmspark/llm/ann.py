"""Approximate nearest neighbours by a hash-prefix forest.

A tree gives every vector a long string of hash bits: the signs of orthogonal projections against their medians, which
are fitted on a bounded sample. The strings of a tree are kept as one sorted array, so all vectors that share a prefix
with a query lie together. A query descends in every tree to its longest matching prefix, then all trees ascend
together, one bit at a time, until the vectors below the reached nodes are as many as wanted; all of those are measured
exactly. There is no cap: what a node holds is taken whole.

Rows are dealt to blocks of about ``block_rows`` by a hash of the id, queries to blocks of ``query_rows``, so that the
index goes to one task a block and some thousands of queries share the sorting of its trees. Each pair of blocks is one
task's work, and the nearest of each are merged by a grouping on the query.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tmspark.llm.common import broadcast_value


@dataclass
class Forest:
    """Projections and medians of every tree: directions[t] is (dimension, bits), medians[t] is (bits,)."""

    directions: np.ndarray
    medians: np.ndarray

    @property
    def bits(self) -> int:
        return self.medians.shape[1]

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """Hash strings as integers, a row for each tree; the first bit of a string is the highest."""
        weights = np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64)
        return np.stack(
            [((vectors @ d > m) * weights).sum(axis=1, dtype=np.uint64) for d, m in zip(self.directions, self.medians, strict=True)]
        )


def fit_forest(sample: np.ndarray, trees: int, bits: int, seed: int) -> Forest:
    draw = np.random.default_rng(seed)
    size = sample.shape[1]
    directions = []
    for _ in range(trees):
        blocks = [np.linalg.qr(draw.normal(size=(size, size)))[0] for _ in range(-(-bits // size))]
        directions.append(np.concatenate(blocks, axis=1)[:, :bits])
    directions = np.array(directions)
    medians = np.array([np.median(sample @ d, axis=0) for d in directions])
    return Forest(directions, medians)


class SortedTrees:
    """The forest over the rows of one block: a sorted array of strings a tree, and the rows in that order."""

    def __init__(self, forest: Forest, vectors: np.ndarray):
        strings = forest.strings(vectors)
        self.bits, self.n = forest.bits, vectors.shape[0]
        self.rows = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.rows, axis=1)

    def reach(self, query: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """For each tree, the range in its array of strings that share the first ``level`` bits with the query."""
        shift = np.uint64(self.bits - level)
        low = (query >> shift) << shift if level else np.zeros_like(query)
        high = low + ((np.uint64(1) << shift) - np.uint64(1))
        start = np.array([np.searchsorted(s, x, "left") for s, x in zip(self.sorted, low, strict=True)])
        stop = np.array([np.searchsorted(s, x, "right") for s, x in zip(self.sorted, high, strict=True)])
        return start, stop

    def candidates(self, query: np.ndarray, wanted: int) -> np.ndarray:
        """Rows found by descent and synchronous ascent; at least ``wanted`` of them, or all."""
        if wanted >= self.n:
            return np.arange(self.n)
        # Descent: the deepest level at which the ranges of all trees together could hold enough, by bisection.
        low, high = 0, self.bits
        while low < high:
            level = (low + high + 1) // 2
            start, stop = self.reach(query, level)
            low, high = (level, high) if (stop - start).sum() >= wanted else (low, level - 1)
        seen, found = np.zeros(self.n, dtype=bool), 0
        for level in range(low, -1, -1):  # all trees together, a bit at a time; within a level tree by tree
            start, stop = self.reach(query, level)
            for rows, a, b in zip(self.rows, start, stop, strict=True):
                below = rows[a:b]
                found += int((~seen[below]).sum())
                seen[below] = True
                if found >= wanted:
                    return np.flatnonzero(seen)
        return np.arange(self.n)


def usable(vector: Column) -> Column:
    """True for vectors that are not null, not empty, not all zero, and hold only finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    rows: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = 64,
    bits: int = 48, share: float = 0.45, least: int | None = None, block_rows: int = 20_000, query_rows: int = 20_000,
    sample_rows: int = 8_192, seed: int = 7,
) -> DataFrame:
    """For each row where ``queries`` is true, the ``k`` nearest other rows by Euclidean distance: query_id, rank (from
    1), vec_id, score (that distance, in double precision on the original vectors).

    A block gives a query at least ``share`` of its rows, or ``least`` (30 times ``k`` by default), as candidates. The
    default share is for vectors without much structure, where near and far differ little; clustered ones need less.
    Ties go to the smaller id. Vectors that are null, zero, of another length than most, or hold null or non-finite
    components take no part, nor do null ids; a repeated id is a row of its own, except that a query is never its own
    neighbour. An empty table gives an empty one. Other columns aren't read."""
    spark, least = rows.sparkSession, 30 * k if least is None else least
    schema = "query_id long, vec_id long, score double"
    wide = rows.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"), F.coalesce(queries, F.lit(False)).alias("_q"))
    good = wide.where(F.col("_id").isNotNull() & usable(F.col("_v")))
    sizes = good.groupBy(F.size("_v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_q").cast("long")).alias("q")).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    most = max(sizes, key=lambda r: (r["n"], r["d"]))
    good = good.where(F.size("_v") == most["d"])
    hashed = F.pmod(F.xxhash64(F.lit(seed), "_id", "_v"), F.lit(1 << 20))
    chosen = good.where(hashed < max(1, round(min(1.0, sample_rows / most["n"]) * (1 << 20)))).select("_v").toPandas()
    sample = np.array(chosen["_v"].tolist()) if len(chosen) else np.zeros((1, most["d"]))
    forest = broadcast_value(spark, fit_forest(sample, trees, bits, seed))
    blocks, query_blocks = -(-most["n"] // block_rows), max(1, -(-most["q"] // query_rows))
    block = F.pmod(F.xxhash64(F.lit("row"), "_id", "_v"), F.lit(blocks)).cast("int")
    query_block = F.pmod(F.xxhash64(F.lit("query"), "_id"), F.lit(query_blocks)).cast("int")
    pair = F.array(*[F.lit(x) for x in range(query_blocks)]) if query_blocks <= 1000 else F.sequence(F.lit(0), F.lit(query_blocks - 1))
    index = good.select("_id", "_v", block.alias("_b"), F.explode(pair).alias("_qb"))
    asked = good.where("_q").select("_id", "_v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"), query_block.alias("_qb")).distinct()

    def search(asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or index.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        vectors, ids = np.array(index["_v"].tolist(), dtype=np.float64), index["_id"].to_numpy()
        by_id = np.argsort(ids, kind="stable")
        vectors, ids = vectors[by_id], ids[by_id]
        tree = SortedTrees(forest.value, vectors)
        wanted = max(least, int(share * len(ids)))
        out = []
        questions = np.array(asked["_v"].tolist(), dtype=np.float64)
        for own, vector, string in zip(asked["_id"], questions, forest.value.strings(questions).T, strict=True):
            found = tree.candidates(string, wanted + 1)
            found = found[ids[found] != own]
            distance = np.sqrt(((vectors[found] - vector) ** 2).sum(axis=1))
            if len(found) > k:  # the k nearest and all that tie with the last of them
                keep = distance <= np.partition(distance, k - 1)[k - 1]
                found, distance = found[keep], distance[keep]
            best = np.lexsort((ids[found], distance))[:k]
            out.append(pd.DataFrame({"query_id": own, "vec_id": ids[found][best], "score": distance[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    found = asked.groupBy("_b", "_qb").cogroup(index.groupBy("_b", "_qb")).applyInPandas(search, schema)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
