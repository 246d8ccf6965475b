"""Language ID, quality, LM scoring, neighbours, similarity join and the pipeline: held-out accuracy and brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

import corpus_pipeline
from tmspark.llm import ann, jaccard_join, langid, lm_scoring, quality, queries
from tmspark.llm.common import fold_of, mix64, words_of

SF01 = "/root/testdata/sf0.01"


def docs_of(spark, texts, schema="doc_id long, text string, lang string, node string, key string, score string"):
    return spark.createDataFrame([(k, t, "en", "n", "k", "s") for k, t in enumerate(texts)], schema)


# --- language


def test_language_accuracy_and_und(spark):
    got = queries.op2_language_id(spark, SF01)
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang")
    right = got.join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98
    assert got.where("score < 0 or score > 1 or lang_pred is null").count() == 0
    model = langid.train(spark.read.parquet(f"{SF01}/documents.parquet"))
    odd = docs_of(spark, [None, "", "123 !?", "²", "ж", "the and of in with", "x" * 200_000, "qzx jkv wqp zzkx vvq jjxq kqz wvx " * 30])
    rows = {r.doc_id: r._l for r in odd.select("doc_id", langid.language_column(F.col("text"), model, spark).alias("_l")).collect()}
    assert [rows[k].lang_pred for k in range(4)] == ["und"] * 4 and not rows[0].accepted
    assert rows[4].lang_pred != "und" and rows[5].lang_pred == "en" and rows[5].accepted
    assert not rows[6].accepted and not rows[7].accepted
    assert langid.identify(odd.limit(0), odd).count() == 0
    nobody = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(odd, nobody).collect()} == {"und"}


def test_kneser_ney_sums_to_one():
    import pandas as pd

    grams = Counter("  abracadabra "[k : k + 3] for k in range(12))
    counts = pd.DataFrame([("x", g, n) for g, n in grams.items()], columns=["lang", "gram", "n"])
    model = langid.kneser_ney(counts, ["x"], 3)
    letters = sorted({g[-1] for g in grams})
    for history in ("ab", "ra", "ca", "zz"):
        p = 0.0
        for letter in letters:
            codes = np.array([ord(c) for c in history + letter], dtype=np.uint64)
            p += math.exp(float(model.log_probabilities(codes)[-1, 0]))
        assert 0.5 < p <= 1.0001  # what is left goes to letters never seen


def plain_kneser_ney(grams, order, letters):
    """p(character | history) of one language by the formula, from counts of the full order."""
    counts = {order: dict(grams)}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount = {}
    for n, own in counts.items():
        once, twice = sum(v == 1 for v in own.values()), sum(v == 2 for v in own.values())
        discount[n] = once / (once + 2 * twice) if once and twice else 0.5

    def p(history, letter, n=order):
        if n == 0:
            return 1 / (letters + 1000)
        history = history[len(history) - n + 1 :]
        follow = {g: v for g, v in counts[n].items() if g[:-1] == history}
        if not follow:
            return p(history, letter, n - 1)
        total = sum(follow.values())
        return max(follow.get(history + letter, 0) - discount[n], 0) / total + discount[n] * len(follow) / total * p(history, letter, n - 1)

    return p


def test_kneser_ney_against_the_formula(spark):
    import pandas as pd

    rng = np.random.default_rng(7)
    texts = {x: "  " + "".join(rng.choice(list(chars), 300)) + " " for x, chars in (("aa", "abc de"), ("bb", "bcdf g"), ("cc", "xyz"))}
    grams = {x: Counter(t[k : k + 4] for k in range(len(t) - 3)) for x, t in texts.items()}
    counts = pd.DataFrame([(x, g, n) for x, own in grams.items() for g, n in own.items()], columns=["lang", "gram", "n"])
    names = sorted(texts)
    model = langid.kneser_ney(counts, names, 4)
    letters = len({c for own in grams.values() for g in own for c in g[-1:]})
    plain = {x: plain_kneser_ney(grams[x], 4, len(set().union(*({g[-1] for g in own} | {g[2] for g in own} for own in grams.values())))) for x in names}
    for _ in range(200):
        word = "".join(rng.choice(list("abcdefgxyz q"), 4))
        got = model.log_probabilities(np.array([ord(c) for c in word], dtype=np.uint64))[-1]
        for k, x in enumerate(names):
            assert abs(float(got[k]) - math.log(plain[x](word[:3], word[3]))) < 1e-3, (word, x, letters)


def test_language_query_against_the_plain_model(spark, sf_dir):
    """The whole query: each text's language is the one of the highest probability, added up character by character; ties go to the first."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), fold_of("doc_id", 4, 2)
    model = langid.train(docs.where(~held))
    got = {r.doc_id: r for r in queries.op2_language_id(spark, sf_dir).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows[::3]:
        codes = langid.code_points(r.text, model.order)
        if codes is None:
            assert got[r.doc_id].lang_pred == "und"
            continue
        total = model.log_probabilities(codes).astype(float).sum(axis=0) / (len(codes) - model.order + 1)
        assert got[r.doc_id].lang_pred == model.languages[int(np.argmax(total))]
    twin = langid.kneser_ney(pd.DataFrame([(x, g, 1) for x in ("aa", "bb") for g in ("abcd", "bcde")], columns=["lang", "gram", "n"]), ["aa", "bb"], 4)
    h = twin.entropies(["abcde"])[0]
    assert h[0] == h[1] and int(np.argmin(h)) == 0


# --- quality


def test_quality_on_held_out_rows(spark):
    got = queries.op6_quality_classifier(spark, SF01)
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.93
    assert got.where("score < 0 or score > 1 or score is null").count() == 0
    assert got.count() == spark.read.parquet(f"{SF01}/documents.parquet").count()


def test_quality_scores_against_plain_arithmetic(spark, sf_dir):
    """The whole query: features text by text, ratios by counting, and the score from the fitted weights; ties and repeats alike."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), fold_of("doc_id", 4, 2)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs.where(~held), labels.where(~held))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in queries.op6_quality_classifier(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for k, text in texts.items():
        at = set(quality.features_of(text, model.bits, {}).tolist())
        margin = sum(model.weights[b] for b in at) / math.sqrt(len(at)) + model.bias
        want = 1 / (1 + math.exp(-(model.slope * margin + model.offset)))
        assert abs(got[k].score - want) < 1e-9 and got[k].predicted == int(want >= 0.7) and got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2)
    plain = docs.where(~held).join(labels, "doc_id").collect()
    marked = [(r.doc_id, r.quality, set(quality.features_of(r.text, model.bits, {}).tolist())) for r in plain]
    fitting = {r.doc_id for r in docs.where(quality.part_of("doc_id", "text") > 0).select("doc_id").collect()}
    kept = [(y, f) for i, y, f in marked if i in fitting]
    ones, zeros = Counter(b for y, f in kept if y == 1 for b in f), Counter(b for y, f in kept if y == 0 for b in f)
    size = 1 << model.bits
    ratio = lambda b: math.log((1 + ones[b]) / (size + sum(ones.values()))) - math.log((1 + zeros[b]) / (size + sum(zeros.values())))
    rows, y = [np.array(sorted(f), dtype=np.int32) for _, f in kept], np.array([1 if v else -1 for v, _ in kept])
    scale = np.array([ratio(b) for b in range(size)])
    w, b = quality.descend(rows, y, scale, 1.0, 200, 1)
    cost = {v: len(y) / (2 * max(int((y == v).sum()), 1)) for v in (-1, 1)}

    def objective(w, b):
        margins = [(w * scale)[f].sum() / math.sqrt(len(f)) + b for f in rows]
        return (w @ w + b * b) / 2 + sum(cost[int(v)] * max(0, 1 - v * m) for v, m in zip(y, margins))

    fitted = np.divide(model.weights, scale, out=np.zeros(size), where=np.abs(scale) > 1e-12)
    assert objective(fitted, model.bias) <= 1.03 * objective(w, b)  # the optimum of the whole sample, not of its parts


def test_scores_at_the_threshold_and_repeated_rows(spark):
    docs = docs_of(spark, ["same words"] * 3)
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    score = quality.classify(docs, docs, labels).first().score
    got = quality.classify(docs, docs, labels, threshold=score).collect()
    assert {(r.score, r.predicted) for r in got} == {(score, 1)} and len(got) == 3


def test_quality_without_labels_and_odd_rows(spark):
    odd = docs_of(spark, [None, "", "words here", "!!! " * 50_000])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {round(r.score, 3) for r in quality.classify(odd, odd, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, 0), (3, 1)], "doc_id long, quality int")
    rows = quality.classify(odd, odd, one).collect()
    assert len(rows) == 4 and all(0.9 < r.score <= 1 and r.predicted == 1 for r in rows)
    assert quality.classify(odd.limit(0), odd, one).count() == 0


def test_descent_reaches_the_hinge_optimum():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(20, 5, replace=False)) for _ in range(80)]
    labels = np.array([1 if 3 in r or 7 in r else -1 for r in rows])
    scale = np.ones(20)
    w, b = quality.descend(rows, labels, scale, 1.0, 400, 0)
    x = np.zeros((80, 20))
    for k, r in enumerate(rows):
        x[k, r] = 1 / math.sqrt(5)
    cost = {y: 80 / (2 * (labels == y).sum()) for y in (-1, 1)}
    value = lambda w, b: (w @ w + b * b) / 2 + sum(cost[int(y)] * max(0, 1 - y * (v @ w + b)) for v, y in zip(x, labels))
    best = value(w, b)
    assert all(best <= value(w + rng.normal(0, 0.02, 20), b + rng.normal(0, 0.02)) + 1e-3 for _ in range(200))


# --- LM scoring


@pytest.mark.parametrize("settings", [{}, {"block_bytes": 20_000, "parts": 3}, {"parts": 1}])
def test_base_scores_are_exact(spark, sf_dir, settings):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(80)
    docs = docs.unionByName(docs_of(spark, [None, "", "one one Two\tsix \u00c9 \x00a", "x" * 50_000]).select((F.col("doc_id") + 100_000).alias("doc_id"), "text"))
    rows = docs.collect()
    got = lm_scoring.score(docs, fold_of("doc_id", 5, 1), **settings).collect()
    words = {r.doc_id: [w.lower() if w.isascii() else w.translate({k: k + 32 for k in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", r.text or "")] for r in rows}
    training = [r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 != 1]
    counts = Counter(w for i in training for w in words[i])
    n = sum(counts.values()) + len(training)
    assert len(got) == len(rows)
    for r in got:
        own = [counts[w] for w in words[r.doc_id]] + [len(training)]
        want = sum(math.log10((c + 0.5) / (n + 0.5 * (len(counts) + 2))) for c in own)
        assert r.n_tokens == len(own) and r.n_known == sum(c > 0 for c in own) and r.train_tokens == n
        assert abs(r.base_score - want) < 1e-6 * abs(want)


def thue_morse(letters):
    """Two words of the letters whose sums of bytes times powers of an odd number are equal modulo 2^64."""
    one, other = letters
    for _ in range(11):
        one, other = one + other, other + one
    return one, other


def test_words_of_equal_polynomial_sums_are_told_apart(spark):
    known, new = thue_morse("ab")
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    rows = [(k, f"{known} w") for k in range(100) if zlib.crc32(str(k).encode()) % 5 != 1] + [(held, f"{new} w {'x' * 99} {'x' * 101}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scoring.score(docs, fold_of("doc_id", 5, 1)).collect()}
    n = len(rows) - 1
    size = 3 * n + 0.5 * (3 + 1)
    assert (got[held].n_tokens, got[held].n_known, got[held].train_tokens) == (5, 2, 3 * n)
    assert abs(got[held].base_score - 2 * math.log10((n + 0.5) / size) - 3 * math.log10(0.5 / size)) < 1e-9
    assert all(r.n_known == 3 and abs(r.base_score - 3 * math.log10((n + 0.5) / size)) < 1e-9 for i, r in got.items() if i != held)


def test_slices_of_equal_polynomial_sums_are_told_apart():
    texts = [np.frombuffer(t.encode(), dtype=np.uint8) for t in thue_morse("ab")]
    a, b = (lm_scoring.Slices(np.tile(t, 2)) for t in texts)
    n = len(texts[0])
    hashes = [int(s.hash(np.array([k]), np.array([k + n]))[0]) for s in (a, b) for k in (0, n)]
    assert hashes[0] == hashes[1] != hashes[2] == hashes[3]


def scoring_case():
    rng = np.random.default_rng(3)
    common = [f"w{k}" for k in range(40)]
    passage = " ".join(f"p{k}q" for k in rng.integers(0, 900, 120))
    texts = [" ".join(rng.choice(common, int(rng.integers(1, 60)))) for _ in range(30)]
    texts += [passage, "first " + passage, passage + " last", "  two  spaces \n and a line", "\u017c\u00f3\u0142w \x00", "", None, "a"]
    return texts + texts[:4] + [passage[:300] + " then something else " + passage[300:]]


def brute_scores(texts, held, model):
    """log2 of each text, bit by bit and passage by passage, from counts in dictionaries; none of it shared with the operator but hashes."""
    raw = [(t or "").encode() for t in texts]
    nodes, followers = defaultdict(lambda: [0, 0]), defaultdict(Counter)

    def contexts(text, at):
        past = (b"\0" * 5 + text)[at : at + 5]
        return [past[5 - o :] for o in lm_scoring.ORDERS]

    def passages(text):
        """(start, end, words before, passage) of each."""
        ends = [k + 1 for k, c in enumerate(text) if c == 32] + ([len(text)] if text and text[-1] != 32 else [])
        units = [text[a:b] for a, b in zip([0] + ends, ends)]
        own = [lm_scoring.Slices(np.frombuffer(u.removesuffix(b" "), np.uint8)).hash(np.array([0]), np.array([len(u.removesuffix(b" "))])) for u in units]
        opened = []
        for k in range(3, len(units)):
            h = np.zeros(1, np.uint64)
            for back in (3, 2, 1):
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + own[k - back])
            if int(h[0]) % 16 == 0:
                opened.append(k)
        out = []
        for k, to in zip(opened, opened[1:] + [len(units)]):
            start, end = sum(map(len, units[:k])), sum(map(len, units[:to]))
            out.append((start, end, tuple(u.removesuffix(b" ") for u in units[k - 3 : k]), text[start:end].removesuffix(b" ")))
        return out

    for text, h in zip(raw, held):
        if not h:
            for at, byte in enumerate(text):
                for c in contexts(text, at):
                    for k in range(8):
                        nodes[c, k, byte >> (8 - k)][byte >> (7 - k) & 1] += 1
            for _, _, before, passage in passages(text):
                followers[before][passage] += 1
    scores = []
    for text, h in zip(raw, held):
        bits, less = np.zeros(len(text)), int(not h)
        for at, byte in enumerate(text):
            before = text[at - 1] if at else 0
            for k in range(8):
                bit, gate, signals = byte >> (7 - k) & 1, (byte | 256) >> (8 - k), []
                for c in contexts(text, at):
                    n = list(nodes[c, k, byte >> (8 - k)])
                    n[bit] -= less
                    signals.append(np.clip(np.rint(math.log((n[1] + 0.1) / (n[0] + 0.1)) * 16), -127, 127) / 16 if sum(n) > 0 else 0)
                x = min(max(model.weights[gate, 0] + float(np.dot(signals, model.weights[gate, 1:])), -11), 11)
                p = 0.5 / (1 + math.exp(-x)) + 0.5 * model.refined[before, int(np.float32(x + 12) * np.float32(2) + np.float32(0.5))]
                p = min(max(p, 1 / 65536), 1 - 1 / 65536)
                bits[at] += math.log2(p if bit else 1 - p)
        total = bits.sum()
        for start, end, before, passage in passages(text):
            n = Counter(followers[before])
            n[passage] -= less
            seen, ways = sum(n.values()), sum(c > 0 for c in n.values())
            if seen > 0:
                chance = model.again[min(int(math.log2(seen)), 15) * 4 + min(ways, 4) - 1]
                total += math.log2(chance * n[passage] / seen) - bits[start:end].sum() if n[passage] > 0 else math.log2(1 - chance)
        scores.append(total)
    return scores


@pytest.mark.parametrize("settings", [{"parts": 1}, {"block_bytes": 300, "parts": 1}, {"block_bytes": 300, "parts": 5}])
def test_scores_equal_brute_force(spark, settings):
    texts = scoring_case()
    docs = docs_of(spark, texts)
    held = fold_of("doc_id", 5, 1)
    got = {r.doc_id: r for r in lm_scoring.score(docs, held, **settings).collect()}
    bag: list = []
    blocks, _ = lm_scoring.in_blocks(docs.select(F.col("doc_id").alias("_id"), held.alias("_held"), F.col("text").alias("_text")), 1 << 20)
    _, table = lm_scoring.count_all(blocks, 1, bag)
    low = spark.sparkContext.broadcast(lm_scoring.low_orders(table))
    model = lm_scoring.learn(table, low)
    out = [zlib.crc32(str(k).encode()) % 5 == 1 for k in range(len(texts))]
    want = brute_scores(texts, out, model)
    if settings["parts"] > 1:  # other parts are other streams, so the weights differ a little; counts don't
        assert abs(sum(r.score for r in got.values()) - sum(want) * math.log10(2)) < 0.1 * abs(sum(want))
        return
    for k, t in enumerate(texts):
        assert got[k].held_out == out[k] and abs(got[k].score - want[k] * math.log10(2)) <= 0.002 * abs(want[k]) + 1e-6, (k, t)
        assert got[k].bits_per_byte is None if not t else abs(got[k].bits_per_byte * len(t.encode()) + got[k].score * math.log2(10)) < 1e-6 * abs(got[k].score) + 1e-9


def test_mixing_is_a_distribution_and_beats_the_base(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    rows = docs.select(F.col("doc_id").alias("_id"), F.lit(False).alias("_held"), F.col("text").alias("_text"))
    _, table = lm_scoring.count_all(lm_scoring.in_blocks(rows, 1 << 24)[0], 1, [])
    low = lm_scoring.low_orders(table)
    model = lm_scoring.learn(table, spark.sparkContext.broadcast(low))
    [known] = table.where("kind = 0").collect()
    key, n = lm_scoring.unpack_sorted(known["keys"]), lm_scoring.unpack_counts(known["counts"])
    for past in (b"of th", b"qqqqq", b"\0\0\0\0\0"):
        after = lm_scoring.windows_of(np.frombuffer(b"".join(past + bytes([c]) for c in range(256)), np.uint8))[::6]
        both, counts = lm_scoring.added([key, after], [n, np.zeros(256, np.int64)])
        bits = lm_scoring.bits_of_windows(model, low, both, counts, True)[np.searchsorted(both, np.sort(after))]
        assert abs((2.0 ** bits.astype(float)).sum() - 1) < 0.01
    got = lm_scoring.score(docs, fold_of("doc_id", 5, 1)).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.avg("bits_per_byte")).first()
    assert got[0] > got[1] and got[2] < 3


def test_texts_that_occur_twice_are_told_apart(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text", F.count("*").over(Window.partitionBy("text")).alias("n"))
    got = lm_scoring.score(docs, F.lit(False)).join(docs, "doc_id").where("length(text) > 500")
    twice, once = ([r.bits_per_byte for r in got.where(c).collect()] for c in ("n > 1", "n = 1"))
    assert np.median(twice) < np.quantile(once, 0.1) / 2


def test_scoring_odd_tables(spark):
    empty = docs_of(spark, ["a"]).limit(0)
    assert lm_scoring.score(empty, F.lit(False)).count() == 0
    docs = docs_of(spark, ["a b c", None, "d e f g"])
    for held in (F.lit(True), F.lit(None).cast("boolean"), F.lit(False)):
        got = lm_scoring.score(docs.select("doc_id", "text", F.lit(1).alias("score"), F.lit(2).alias("_block"), F.lit(3).alias("_held"), F.lit(4).alias("kind")), held).collect()
        assert len(got) == 3 and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    same = docs_of(spark, ["the same text of some words"] * 5)
    assert len({(r.score, r.base_score) for r in lm_scoring.score(same, F.lit(False)).collect()}) == 1


# --- neighbours


def brute_nearest(rows, asked, k):
    out = {}
    for q in asked:
        d = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(rows[q], v))), i) for i, v in rows.items() if i != q)
        out[q] = d[:k]
    return out


def test_forest_recall_and_exact_scores(spark, sf_dir):
    got = defaultdict(dict)
    for r in queries.op4_hash_prefix_forest(spark, sf_dir).collect():
        got[r.query_id][r.rank] = (r.score, r.vec_id)
    rows = {r.vec_id: [float(x) for x in r.embedding] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    want = brute_nearest(rows, [i for i in rows if i % 100 == 0], 10)
    assert set(got) == set(want) and all(sorted(g) == list(range(1, 11)) for g in got.values())
    hits = sum(len({i for _, i in got[q].values()} & {i for _, i in w}) for q, w in want.items())
    assert hits / sum(map(len, want.values())) >= 0.9


def test_ascent_over_many_small_blocks(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 400")
    asked = F.col("vec_id") % 50 == 0
    rows = {r.vec_id: [float(x) for x in r.embedding] for r in table.collect()}
    want = brute_nearest(rows, [i for i in rows if i % 50 == 0], 5)
    found = ann.nearest(table, asked, k=5, block_rows=90, query_rows=3, least=10, share=0.6).collect()
    hits = sum(r.vec_id in {i for _, i in want[r.query_id]} for r in found)
    assert hits / 40 >= 0.9
    whole = ann.nearest(table, asked, k=5, block_rows=90, query_rows=3, least=1000).collect()
    assert {(r.query_id, r.rank): r.vec_id for r in whole} == {(q, k): i for q, w in want.items() for k, (_, i) in enumerate(w, 1)}


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (100, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]),
            (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0, 2.0, 3.0]), (9, []), (None, [1.0, 1.0])]
    table = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, rank string, score string")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(table, F.col("vec_id") % 100 == 0, k=2).collect()]
    far = math.sqrt(5.0)
    assert sorted(got) == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (100, 1, 0, far), (100, 2, 1, far)]
    assert ann.nearest(table.limit(0), F.lit(True)).count() == 0


# --- similarity join


def brute_join(rows, n, threshold):
    sets, parent, links = [], list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, text in rows:
        words = [w for w in words_of(text)]
        size = min(n, len(words))
        sets.append({tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if size else set())
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        groups[find(k)].append(i)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted(((i, least[find(k)], links[k]) for k, (i, _) in enumerate(rows)), key=str)


def near_copies():
    rng = np.random.default_rng(5)
    rows, i = [], 0
    passage = " ".join(f"p{k}" for k in range(60))
    for group in range(12):
        base = [f"g{group}w{k}" for k in range(80)]
        for _ in range(int(rng.integers(1, 30))):
            own = list(base)
            for k in rng.integers(0, 80, int(rng.integers(0, 3))):
                own[k] = f"e{rng.integers(1000)}"
            rows.append((i, " ".join(own)))
            i += 1
    for k in range(40):
        rows.append((i, passage + " " + " ".join(f"d{k}x{j}" for j in range(50))))
        i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, "?"), (i + 3, "two words"), (i + 4, "two words"), (None, "two words"), (i + 3, "two words"), (None, "no id")]
    return rows


@pytest.mark.parametrize("settings", [{}, {"bucket_rows": 8, "depth": 2}, {"bucket_rows": 5, "depth": 0}])
def test_join_equals_brute_force(spark, settings):
    rows = near_copies()
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, key string, node int, n_links string")
    got = jaccard_join.join(docs, **settings).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == brute_join(rows, 5, 0.8)


def test_join_of_very_long_texts_and_clashing_columns(spark):
    words = [f"w{k}" for k in range(150_000)]
    long, near = " ".join(words), " ".join(["x", *words[5_000:]])
    docs = spark.createDataFrame([(1, long), (2, near), (3, "short one"), (4, long)], "doc_id long, text string")
    docs = docs.select("*", F.lit("c").alias("node"), F.lit(1).alias("_key"), F.lit(2).alias("class_id"), F.lit(3).alias("_text"))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.join(docs).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 0), 4: (1, 2)}


def test_runs_follow_from_the_target_recall():
    assert jaccard_join.runs_for(0.999999) == 14 and jaccard_join.runs_for(0.9) == 3
    rng, met = np.random.default_rng(11), Counter()
    for trial in range(300):  # sets of 90 and 90 tokens, 80 of them common: a similarity of 0.8
        tokens = np.unique(rng.integers(0, 2**63, 100, dtype=np.uint64) & np.uint64(0xFFFFFFFFFFFF0000))
        a, b = (set(r[3]) for r in jaccard_join.describe([tokens[:90], tokens[10:]], 0.8, 14))
        met[bool(a & b)] += 1
    assert met[False] == 0


def test_sketches_never_rule_out_a_pair_at_the_threshold():
    """Two sets that share 512 of 640 shingles, and in each range differ in the lowest ones."""
    tokens = (np.arange(64, dtype=np.uint64)[:, None] << np.uint64(58)) + (np.arange(1, 11, dtype=np.uint64) << np.uint64(16))
    first, second = np.unique(tokens[:, 1:]), np.unique(np.delete(tokens, 1, axis=1))
    assert len(np.intersect1d(first, second)) == 0.8 * len(np.union1d(first, second)) == 512
    rows = jaccard_join.describe([first, second], 0.8, 1)
    pairs = pd.DataFrame([(1, 0, 0, 0, r[1], r[2], [1]) for r in rows], columns=["key", "pair", "block", "blocks", "size", "sketch", "keys"])
    assert len(jaccard_join.possible_pairs(pairs, 0.8)[0]) == 1


def test_join_of_whole_table_and_of_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in queries.op9_ngram_jaccard_join(spark, sf_dir).collect()), key=str)
    assert got == brute_join([(r.doc_id, r.text) for r in docs.collect()], 5, 0.8)
    assert jaccard_join.join(docs.limit(0)).count() == 0


# --- pipeline


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(None, None, None, None, None)] * 2 + [(10_000, "", "en", None, 0)], docs.schema)
    docs = docs.unionByName(extra)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.count() <= docs.count(), name
            docs = out
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_dedup_stage_keeps_one_of_each_class(spark):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
    classes = {c for _, c, _ in brute_join(rows, 5, 0.8)}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(classes, key=str)


def test_dedup_stage_keeps_unrelated_texts_of_one_id(spark):
    """Ids repeat, one of them a near copy of another row; a column has the name that the stage would take."""
    words = [f"w{k}" for k in range(60)]
    near = " ".join(["other", *words[1:]])
    rows = [(7, " ".join(words), "a"), (7, "quite another text of eight words or so", "b"), (3, near, "c"), (7, None, "d"), (7, None, "e"), (None, None, "f"),
            (None, None, "g"), (9, "the same text of one id twice over", "h"), (9, "the same text of one id twice over", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _number string")
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(r._number for r in kept.collect())
    assert got in (list("bcdefgh"), list("bcdefgi"))


def test_repeated_ids_are_drawn_text_by_text(spark):
    """One id for all rows: languages above the bound are still learned, and the classifier's sample stays bounded."""
    from tmspark.llm import quality

    words = {"en": "the house and garden of this", "de": "das haus und der garten", "fr": "la maison et le jardin"}
    rows = [(7, f"{w} {k} {w.upper()} {k * k}", lang) for lang, w in words.items() for k in range(400 if lang == "en" else 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, train_docs_per_lang=100)
    assert set(model.languages) == set(words)
    texts = [(1, f"good words here {k}") for k in range(500)] + [(k, f"bad words there {k}") for k in range(2, 200)]
    labelled = spark.createDataFrame([(1, 1)] + [(k, 0) for k in range(2, 200)], "doc_id long, quality int")
    seen = []

    def watched(rows, *rest):
        seen.append(len(rows))
        return real(rows, *rest)

    real, frame = quality.calibrate, spark.createDataFrame(texts, "doc_id long, text string")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(quality, "calibrate", watched)
        found = quality.train(frame, labelled, rows_per_class=50)
    assert seen and seen[0] <= 50  # the fifth kept out of some hundred rows, not of the 500 texts of one id
    assert found.probability(quality.features_of("good words here", found.bits, {})) > found.probability(quality.features_of("bad words there", found.bits, {}))


def test_recall_of_the_forest_at_its_defaults(spark):
    """A few thousand vectors without structure, and clustered ones; every query against brute force, through the trees."""
    rng = np.random.default_rng(4)
    plain = rng.normal(size=(3_000, 64))
    clustered = rng.normal(size=(60, 64))[rng.integers(0, 60, 3_000)] + 0.3 * rng.normal(size=(3_000, 64))
    for vectors in (plain, clustered):
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
        got = {}
        for r in ann.nearest(rows, F.col("vec_id") % 50 == 0).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        hits = 0
        for q, found in got.items():
            distance = np.linalg.norm(vectors - vectors[q], axis=1)
            distance[q] = np.inf
            hits += len(found & set(np.argsort(distance, kind="stable")[:10].tolist()))
        assert len(got) == 60 and hits / 600 >= 0.9
