"""Periodic runs against plain search, and the query against the contract's own arithmetic over whole texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tmspark.llm import periodic_runs, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=6):
    """(start, length, period) of each run, by trying every period."""
    found = []
    for period in range(1, len(words) // 4 + 1):
        at = 0
        while at + period < len(words):
            end = at
            while end + period < len(words) and words[end] == words[end + period]:
                end += 1
            size = end + period - at
            if end > at and size >= max(least, 4 * period):
                stretch = words[at : at + size]
                if all(any(a != b for a, b in zip(stretch, stretch[q:])) for q in range(1, period)):
                    found.append((at, size, period))
            at = max(end, at + 1)
    return sorted(found)


def collapsed(words, runs):
    gone = {i for start, size, period in runs for i in range(start + period, start + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_equal_plain_search_for_random_texts_with_planted_repeats():
    rng = random.Random(11)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 4)):
            words = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.choice([0, 1, 5, 6, 8, 30, 90, 200]))]
            for _ in range(rng.randint(0, 3)):
                if len(words) > 8:
                    first = rng.randrange(len(words))
                    unit = words[first : first + 1 + rng.randrange(12)]
                    for i in range(first, rng.randint(first, len(words))):
                        words[i] = unit[(i - first) % len(unit)]
            docs.append(words)
        got = periodic_runs.find_runs(np.array(sum(docs, []), dtype=np.int64), np.array([len(d) for d in docs]))
        assert [tuple(r) for r in got.tolist()] == [(k, *r) for k, d in enumerate(docs) for r in plain_runs(d)]


def test_runs_nested_in_runs_and_at_both_ends():
    inner = [1] * 9 + [2]
    words = inner * 4 + [3] + [4, 5] * 4
    got = periodic_runs.find_runs(np.array(words), np.array([len(words)]))
    assert [tuple(r[1:]) for r in got.tolist()] == [(0, 9, 1), (0, 40, 10), (10, 9, 1), (20, 9, 1), (30, 9, 1), (41, 8, 2)] == plain_runs(words)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "x " * 5), (5, "  x" * 6), (6, "a b " * 4 + "c"), (6, "a b " * 4 + "c"), (7, "wórd wórd " * 7), (None, "y\n" * 50_000)]
    docs = spark.createDataFrame([(i, t, "n", 0) for i, t in rows], "doc_id int, text string, runs string, n_words int")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(docs).collect()), key=str)
    want = []
    for i, t in rows:
        words = WORD.findall(t or "")
        runs = [(0, 50_000, 1)] if i is None else plain_runs(words)
        want.append((i, len(words), runs, collapsed(words, runs)))
    assert got == sorted(want, key=str)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_query_equals_plain_arithmetic(spark, sf_dir, parts, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.octet_length("text") < 8_000)
    docs.repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    seen = 0
    for doc_id, text in docs.select("doc_id", "text").collect():
        words, h = WORD.findall(text or ""), zlib.crc32(str(doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs, row = plain_runs(words), got[doc_id]
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        seen += len(runs)
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *(best or (None, None, None)))
        assert row.exponent_milli == (best and 1000 * best[1] // best[2])
        assert row.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert seen and len(got) == docs.count()
