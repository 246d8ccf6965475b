"""A quality classifier: naive Bayes features in a linear support vector machine, fitted by dual coordinate descent.

Features are indicators of hashed n-grams: words, and runs of up to three token shapes (case, digits, punctuation,
repetition of the word before). Each is scaled by the log ratio of its smoothed share in the two classes; on these a
hinge-loss model is fitted. The fit uses a sample of labelled rows, ``rows_per_class`` of each class (all where there
are fewer): shares are counted by Spark; one descent goes over the sample; a fifth of it, kept out of both, calibrates the
margin to a probability at the classes' true shares.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tmspark.llm.common import broadcast_value, discard, give_back, materialize, small_batches

_TOKEN = re.compile(r"\w+|[^\w\s]+")


def shape_of(token: str) -> str:
    if not (token[0].isalnum() or token[0] == "_"):
        return token[:3]
    if token.isdigit():
        return "9"
    if not token.isalpha():
        return "x9"
    if len(token) > 1 and token.isupper():
        return "XX"
    return "Xx" if token[0].isupper() else "xx"


def features_of(text: str | None, bits: int, memo: dict[str, tuple[str, int]]) -> np.ndarray:
    """Sorted distinct buckets of the text's n-grams; a null or empty text has the one of the empty shape."""
    mask = (1 << bits) - 1
    shapes, found, before = ["^"], set(), ""
    for token in _TOKEN.findall(text or ""):
        known = memo.get(token)
        if known is None:
            if len(memo) > 60_000:
                memo.clear()
            known = memo[token] = (shape_of(token), zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) & mask)
        shapes.append("=" if token == before and len(token) > 1 else known[0])
        found.add(known[1])
        before = token if known[0][0] in "Xx9" else before
    shapes.append("$")
    grams = set(shapes) | set(zip(shapes, shapes[1:], strict=False)) | set(zip(shapes, shapes[1:], shapes[2:], strict=False))
    for gram in grams:
        name = gram if isinstance(gram, str) else "\x00".join(gram)
        found.add(zlib.crc32(("\x01" + name).encode("utf-8", "surrogatepass")) & mask)
    return np.array(sorted(found), dtype=np.int32)


@dataclass
class QualityModel:
    bits: int
    weights: np.ndarray  # of buckets, with the log ratios multiplied in
    bias: float
    slope: float
    offset: float

    def probability(self, buckets: np.ndarray) -> float:
        margin = (float(self.weights[buckets].sum()) / np.sqrt(len(buckets)) if len(buckets) else 0.0) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40))))


def descend(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2 / 2 + cost * sum max(0, 1 - y w.x), x = scale[row] / sqrt(len(row)) and a constant."""
    weights, bias = np.zeros(len(scale)), 0.0
    values = [scale[r] / np.sqrt(max(len(r), 1)) for r in rows]
    norms = [float(v @ v) + 1.0 for v in values]
    alpha = np.zeros(len(rows))
    share = {y: cost * len(rows) / (2 * max(int((labels == y).sum()), 1)) for y in (-1, 1)}  # classes weigh alike
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for k in draw.permutation(len(rows)):
            y = int(labels[k])
            gradient = y * (float(weights[rows[k]] @ values[k]) + bias) - 1
            new = min(max(alpha[k] - gradient / norms[k], 0.0), share[y])
            if step := (new - alpha[k]) * y:
                weights[rows[k]] += step * values[k]
                bias += step
                worst = max(worst, abs(step))
                alpha[k] = new
        if worst < 1e-3:
            break
    return weights, bias


def calibrate(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and offset of the logistic curve through margins and 0/1 labels, by Newton steps."""
    n1, n0 = weights[labels == 1].sum(), weights[labels == 0].sum()
    if not n1 or not n0:
        return 2.0, 0.0
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = weights * (p - target)
        h = weights * np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(g * margins).sum() + 1e-3 * a, g.sum()])
        hess = np.array([[(h * margins**2).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def _features(bits: int):
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict[str, tuple[str, int]] = {}
        for texts in batches:
            yield pd.Series([features_of(t, bits, memo) for t in texts], dtype=object)
            give_back()

    return F.pandas_udf(make, "array<int>")


def part_of(id_col: str, text_col: str) -> Column:
    """Which fifth of the sample a row is in; the first one is kept out of the fit."""
    return F.pmod(F.xxhash64(F.lit("part"), id_col, text_col), F.lit(5)).cast("int")


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    bits: int = 18, rows_per_class: int = 4_000, cost: float = 1.0, epochs: int = 20,
) -> QualityModel:
    """Learns from the rows of ``docs`` that ``labels`` (id, label 0 or 1) marks: about ``rows_per_class`` of each class,
    drawn by a hash of id and text, so that an id of many texts is not drawn whole. Ids that are null, or marked 0 and 1,
    teach nothing. Without rows of both classes every score is the share of label 1 (0.5 without any)."""
    spark = docs.sparkSession
    marks = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
        .where("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_top")).where("_y = _top").drop("_top")
    )
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.withColumn("_draw", F.pmod(F.xxhash64(F.lit("quality"), "_id", "_text"), F.lit(1_000_000)) / 1_000_000)
    marked = rows.select("_id", "_draw").join(marks, "_id")
    sizes = {r["_y"]: r["count"] for r in marked.groupBy("_y").count().collect()}
    if len(sizes) < 2:
        share = 0.5 if not sizes else float(next(iter(sizes)))
        return QualityModel(bits, np.zeros(1 << bits), 0.0, 1.0, float(np.log((share + 0.01) / (1.01 - share))))
    share = {y: min(1.0, rows_per_class / n) for y, n in sizes.items()}
    drawn = F.col("_draw") < F.when(F.col("_y") == 1, share[1]).otherwise(share[0])
    # The ids that are broadcast have a drawn row each, so there are no more of them than drawn rows.
    chosen = F.broadcast(marked.where(drawn).select("_id", "_y").distinct())
    sample = rows.join(chosen, "_id").where(drawn).withColumn("_part", part_of("_id", "_text"))
    sample = sample.select("_id", "_draw", "_y", "_part", _features(bits)("_text").alias("_f"))
    bag: list[str] = []
    sample = materialize(sample, bag)
    fit = sample.where("_part > 0")
    counts = fit.select("_y", F.explode("_f").alias("_b")).groupBy("_b").agg(
        F.sum("_y").alias("p"), F.sum(1 - F.col("_y")).alias("q")
    ).toPandas()  # at most 2**bits rows
    p, q = np.ones(1 << bits), np.ones(1 << bits)
    p[counts["_b"]] += counts["p"].to_numpy()
    q[counts["_b"]] += counts["q"].to_numpy()
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    shared = broadcast_value(spark, ratio)

    def fit_all(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_id", "_draw"], kind="stable")
        y = np.where(rows["_y"].to_numpy() == 1, 1, -1)
        w, b = descend([np.asarray(f) for f in rows["_f"]], y, shared.value, cost, epochs, 0)
        return pd.DataFrame({"weights": [w], "bias": [b]})

    found = fit.withColumn("_whole", F.col("_part") > 0).groupBy("_whole").applyInPandas(fit_all, "weights array<double>, bias double").collect()  # one row
    weights = np.array(found[0]["weights"]) * ratio if found else np.zeros(1 << bits)
    model = QualityModel(bits, weights, found[0]["bias"] if found else 0.0, 1.0, 0.0)
    held = sample.where("_part = 0").select("_y", "_f").toPandas()  # a fifth of the sample
    discard(spark, bag)
    if len(held):
        margins = np.array([(weights[f].sum() / np.sqrt(len(f)) if len(f) else 0.0) + model.bias for f in map(np.asarray, held["_f"])])
        y = held["_y"].to_numpy()
        model.slope, model.offset = calibrate(margins, y, np.where(y == 1, 1 / share[1], 1 / share[0]))
    return model


def score_column(text: Column, model: QualityModel, spark) -> Column:
    """The probability of label 1; null and empty texts get that of the empty text."""
    small_batches(spark)
    shared = broadcast_value(spark, model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, memo = shared.value, {}
        for texts in batches:
            yield pd.Series([model.probability(features_of(t, model.bits, memo)) for t in texts], dtype="float64")
            give_back()

    return F.pandas_udf(score, "double")(text)


def classify(docs: DataFrame, learn_from: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **settings) -> DataFrame:
    """One row per row of ``docs``: id, score, predicted (1 where score >= threshold, so also at a tie with it). Null and
    empty texts have the score of a text without tokens, very long ones are read whole. Repeated rows stay and score
    alike, an empty table gives an empty one, other columns aren't read."""
    model = train(learn_from, labels, id_col, text_col, **settings)
    scored = docs.select(F.col(id_col), score_column(F.col(text_col), model, docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
