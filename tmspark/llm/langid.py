"""Language identification by interpolated Kneser-Ney character models, one a language, in sorted hash arrays.

Text is reduced to lower-case letters with single spaces between words. N-gram counts of each language come from a Spark
job over a sample of labelled rows, bounded by ``train_docs_per_lang`` (all rows where there are fewer). From them the
driver makes one table an order: sorted 64-bit hashes of the n-grams that any language has, and for each a row of log
probabilities, one a language; likewise the back-off weights of contexts. A text's score in a language is the
cross-entropy a character; the lowest wins. Rows kept out of the counts calibrate rejection: a text is rejected if its
cross-entropy lies above its language's usual one by more than three quarters of the way to that of foreign texts, and
by more than ``reject_sigmas`` deviations of texts of its length. So a text that mixes known languages is accepted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tmspark.llm.common import broadcast_value, chunks, give_back, small_batches

RESULT = "lang_pred string, score double, entropy double, accepted boolean"
UNDETERMINED = "und"
_GAP, _LETTER = re.compile(r"[\W\d_]+"), regex.compile(r"\p{L}")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def code_points(text: str | None, order: int) -> np.ndarray | None:
    """The normalised text with ``order - 1`` spaces before and one after it; None for null or no letter."""
    if text is None or not _LETTER.search(text):
        return None
    text = " " * (order - 1) + _GAP.sub(" ", text.lower()).strip() + " "
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def gram_hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the n-grams that end at each position from ``order - 1`` on."""
    n = len(codes) - order + 1
    total = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(order):
        total = (total + codes[k : k + max(n, 0)] + np.uint64(1)) * _STEP
        total ^= total >> np.uint64(29)
    return total


def lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the keys in a sorted array, -1 where absent."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


@dataclass
class KneserNey:
    """grams[n]: sorted hashes of order n + 1, logp[n]: their log probabilities; contexts and back-offs likewise."""

    languages: list[str]
    order: int
    grams: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: np.ndarray
    usual: dict[str, tuple[float, float, float, float]] = field(default_factory=dict)

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """A row for each character after the leading spaces, a column for each language."""
        first = self.order - 1
        n = len(codes) - first
        out = np.zeros((n, len(self.languages)), dtype=np.float32)
        open_ = np.arange(n)
        for order in range(self.order, 0, -1):
            window = codes[first - order + 1 :]
            keys = gram_hashes(window, order)
            at = lookup(self.grams[order - 1], keys[open_])
            out[open_[at >= 0]] += self.logp[order - 1][at[at >= 0]]
            open_ = open_[at < 0]
            if not len(open_):
                return out
            if order > 1:
                back = lookup(self.contexts[order - 2], gram_hashes(window[:-1], order - 1)[open_])
                out[open_[back >= 0]] += self.backoff[order - 2][back[back >= 0]]
        out[open_] += self.floor
        return out

    def entropies(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Nats a character in each language."""
        return [h for a, b in chunks(texts, 300_000) for h in self._entropies(texts[a:b])]

    def _entropies(self, texts: list[str | None]) -> list[np.ndarray | None]:
        codes = [code_points(t, self.order) for t in texts]
        sizes = [0 if c is None else len(c) - self.order + 1 for c in codes]
        some = [c for c in codes if c is not None]
        if not some:
            return [None] * len(texts)
        joined = np.concatenate(some)
        logp = np.concatenate((np.zeros((1, len(self.languages))), np.cumsum(self.log_probabilities(joined), axis=0, dtype=np.float64)))
        out, at = [], 0
        for c, n in zip(codes, sizes, strict=True):
            if c is None:
                out.append(None)
                continue
            out.append((logp[at] - logp[at + n]) / n)
            at += len(c)  # what follows a text and the leading spaces of the next one belongs to neither
        return out


def _grams(texts: list[str], order: int) -> Iterator[tuple[str, int]]:
    """Distinct n-grams of the texts and their counts."""
    codes = [c for t in texts if (c := code_points(t, order)) is not None]
    if not codes:
        return
    joined = np.concatenate(codes)
    inside = np.ones(len(joined) - order + 1, dtype=bool)
    for end in np.cumsum([len(c) for c in codes])[:-1]:
        inside[end - order + 1 : end] = False  # windows across two texts
    starts = np.flatnonzero(inside)
    _, first, n = np.unique(gram_hashes(joined, order)[starts], return_index=True, return_counts=True)
    for gram, k in zip(joined[starts[first][:, None] + np.arange(order)].astype(np.uint32), n, strict=True):
        yield gram.tobytes().decode("utf-32-le", "surrogatepass"), int(k)


def _counts(order: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, dict[str, int]] = {}
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                own, texts = totals.setdefault(lang, {}), texts.tolist()
                for a, b in chunks(texts):
                    for gram, k in _grams(texts[a:b], order):
                        own[gram] = own.get(gram, 0) + k
        rows = [(lang, g, k) for lang, own in totals.items() for g, k in own.items()]
        yield pd.DataFrame(rows, columns=["lang", "gram", "n"])

    return count


def kneser_ney(counts: pd.DataFrame, languages: list[str], order: int) -> KneserNey:
    """The tables from counts (lang, gram, n) of n-grams of the full order."""
    per_order: list[dict[str, dict[str, float]]] = [{} for _ in range(order)]
    for lang, own in counts.groupby("lang"):
        now = dict(zip(own["gram"], own["n"], strict=True))
        per_order[order - 1][lang] = now
        for size in range(order - 1, 0, -1):  # lower orders count the characters that precede
            lower: dict[str, int] = {}
            for gram in now:
                lower[gram[1:]] = lower.get(gram[1:], 0) + 1
            per_order[size - 1][lang] = now = lower
    grams, logps, contexts, backoffs = [], [], [], []
    lower_p: dict[str, np.ndarray] = {}
    letters = set().union(*(per_order[0][lang] for lang in per_order[0])) if per_order[0] else set()
    uniform = np.full(len(languages), 1.0 / (len(letters) + 1000))
    back_of: dict[str, np.ndarray] = {"": np.ones(len(languages))}
    for size in range(1, order + 1):
        tables = [per_order[size - 1].get(lang, {}) for lang in languages]
        every = sorted(set().union(*tables)) if tables else []
        discount, totals, kinds = [], [], []
        for own in tables:
            n1, n2 = sum(v == 1 for v in own.values()), sum(v == 2 for v in own.values())
            discount.append(n1 / (n1 + 2 * n2) if n1 and n2 else 0.5)
            total: dict[str, float] = {}
            kind: dict[str, int] = {}
            for gram, n in own.items():
                total[gram[:-1]] = total.get(gram[:-1], 0) + n
                kind[gram[:-1]] = kind.get(gram[:-1], 0) + 1
            totals.append(total)
            kinds.append(kind)
        heads = sorted(set().union(*totals)) if totals else []
        back_of = {
            h: np.array([d * k[h] / t[h] if h in t else 1.0 for d, t, k in zip(discount, totals, kinds, strict=True)])
            for h in heads
        }
        here: dict[str, np.ndarray] = {}
        for gram in every:
            head, below = gram[:-1], lower_p.get(gram[1:], uniform) if size > 1 else uniform
            own = np.array(
                [max(t.get(gram, 0) - d, 0.0) / s[head] if head in s else 0.0 for t, d, s in zip(tables, discount, totals, strict=True)]
            )
            here[gram] = own + back_of[head] * below
        for store, values, found in ((grams, logps, here), (contexts, backoffs, back_of)):
            if store is contexts and size == 1:
                floor = np.log(back_of.get("", np.ones(len(languages))) * uniform).astype(np.float32)
                continue
            length = size if store is grams else size - 1
            keys = np.array([_hash_of(g, length) for g in found], dtype=np.uint64)
            by = np.argsort(keys)
            rows = np.array([found[g] for g in found]).reshape(-1, len(languages))
            store.append(keys[by])
            values.append(np.log(rows[by]).astype(np.float32))
        lower_p = here
    return KneserNey(languages, order, grams, logps, contexts, backoffs, floor)


def _hash_of(gram: str, length: int) -> int:
    codes = np.frombuffer(gram.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    return int(gram_hashes(codes, length)[0])


def train(
    labelled: DataFrame, order: int = 4, train_docs_per_lang: int = 3_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> KneserNey | None:
    """The model of the languages of ``labelled``; None if no row has both a language and a letter.

    About ``train_docs_per_lang`` rows of each language, chosen by a hash of id and text (so repeated ids are drawn text by
    text), are used whole; a tenth of them measures the usual cross-entropy and is not counted. So the model's size is
    bounded by that number and the number of languages, whatever the corpus."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return None
    languages = sorted(sizes)
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, train_docs_per_lang / sizes[lang]))])
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col("id").cast("string"), "text"), F.lit(1_000_000)) / 1_000_000
    sample = rows.withColumn("_draw", draw).where(F.col("_draw") < F.element_at(share, F.col("lang")))
    kept_out = F.pmod(F.xxhash64(F.lit("calibrate"), "id", "text"), F.lit(10)) == 0
    counted = sample.where(~kept_out).select("lang", "text").mapInPandas(_counts(order), "lang string, gram string, n long")
    counts = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()  # bounded by the sample
    if counts.empty:
        counted = sample.select("lang", "text").mapInPandas(_counts(order), "lang string, gram string, n long")
        counts = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if counts.empty:
        return None
    model = kneser_ney(counts, sorted(set(counts["lang"])), order)
    shared = broadcast_value(rows.sparkSession, model)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known = batch[batch["lang"].isin(shared.value.languages)]
            found = zip(known["lang"], known["text"], shared.value.entropies(known["text"].tolist()), strict=True)
            yield pd.DataFrame(
                [(lang, of, float(x), len(t)) for lang, t, h in found if h is not None for of, x in zip(shared.value.languages, h, strict=True)],
                columns=["lang", "model", "h", "n"],
            )

    all_ = sample.where(kept_out).select("lang", "text").mapInPandas(measure, "lang string, model string, h double, n long").toPandas()
    for lang in model.languages:
        own = all_[(all_["model"] == lang) & (all_["lang"] == lang)]
        foreign = all_.loc[(all_["model"] == lang) & (all_["lang"] != lang), "h"]
        h, n = own["h"].to_numpy(), own["n"].to_numpy()
        if len(h) < 5:
            model.usual[lang] = (2.5, 0.5, 3.0, 0.0)
            continue
        middle = float(np.median(h))
        spread = float(np.median(np.abs(h - middle)) * 1.4826)
        noise = float(np.sqrt(np.median((h - middle) ** 2 * n)) * 1.4826)
        apart = 0.75 * max(float(np.median(foreign)) - middle, 0.0) if len(foreign) else 0.0
        model.usual[lang] = (middle, max(spread, 0.02), max(noise, 1.5), apart)
    return model


def language_column(text: Column, model: KneserNey | None, spark, reject_sigmas: float = 8.0) -> Column:
    """struct<lang_pred, score, entropy, accepted> of a text column; ``und`` with score 0 where there is no letter."""
    small_batches(spark)
    shared = broadcast_value(spark, model)

    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts in batches:
            rows = []
            found = model.entropies(texts.tolist()) if model else [None] * len(texts)
            for text, h in zip(texts, found, strict=True):
                if h is None:
                    rows.append((UNDETERMINED, 0.0, None, False))
                    continue
                best = int(np.argmin(h))
                n = len(text)
                weight = np.exp(-(h - h[best]) * min(n, 50))
                middle, spread, noise, apart = model.usual[model.languages[best]]
                limit = middle + max(apart, reject_sigmas * np.sqrt(spread**2 + noise**2 / n))
                rows.append((model.languages[best], float(1 / weight.sum()), float(h[best]), bool(h[best] <= limit)))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "entropy", "accepted"])
            give_back()

    return F.pandas_udf(identify, RESULT)(text)


def identify(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", reject_sigmas: float = 8.0, **settings) -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score (0 to 1), entropy (nats a character), accepted.

    ``und``, score 0, not accepted: null text, a text without a letter, or no labelled row to learn from. Equal
    cross-entropies go to the alphabetically first language. Repeated rows and empty tables stay as they are; other
    columns of ``docs`` aren't read."""
    model = train(labelled, id_col=id_col, text_col=text_col, **settings)
    scored = docs.select(F.col(id_col), language_column(F.col(text_col), model, docs.sparkSession, reject_sigmas).alias("_l"))
    return scored.select(id_col, "_l.*")
