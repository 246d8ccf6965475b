"""Token counts, packing, decontamination, chat formatting, sharding: brute force, round trips and odd inputs."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tmspark.llm import chat, decontaminate, packing, queries, sharding, token_counts
from tmspark.llm.common import words_of

DOCS = "doc_id long, text string, length string, score string, n_tokens string, items string, piece string"


def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and columns named like results."""
    long = " ".join(f"w{k % 977} Überß" for k in range(30_000))
    rows = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "x"), (4, long), (5, "?!? \n"), (6, "日本語 текст 🎉")]
    return spark.createDataFrame([(i, t, "l", "s", "n", "i", "p") for i, t in rows], DOCS)


# --- token counts


def brute_count(word, scores):
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - 130), end):
            s = scores.get(word[start:end])
            if s is not None:
                new = (best[start][0] + s, best[start][1] + 1)
                if new[0] > best[end][0] or new[0] == best[end][0] and new[1] < best[end][1]:
                    best[end] = new
    return best[-1][1]


def test_trie_counts_equal_plain_forward_scores():
    scores = token_counts.unigram_scores(token_counts.default_vocabulary())
    trie = token_counts.ForwardTrie(scores)
    words = [w.encode() for w in "the then thence there theatre Überß 日本語 1999 anti-disestablishment aaaaaaaaaaaa".split()]
    assert [trie.count(w) for w in words] == [brute_count(w, scores) for w in words]
    small = token_counts.ForwardTrie(scores, max_nodes=8)
    assert [small.count(w) for w in words + words] == [trie.count(w) for w in words + words]
    assert trie.count(b"") == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=7), max_size=8))
def test_trie_on_small_vocabularies(words):
    scores = {b"a": -2.0, b"b": -2.5, b"ab": -3.0, b"aab": -4.1, b"ba": -4.5}
    trie = token_counts.ForwardTrie(scores)
    for w in words:
        assert trie.count(w.encode()) == brute_count(w.encode(), scores)


def test_token_counts_of_whole_texts_against_plain_scores(spark, sf_dir):
    """Each pre-token of each text by itself, scored from the vocabulary without a trie or a memo."""
    scores = token_counts.unigram_scores(token_counts.default_vocabulary())
    longest, split = max(map(len, scores)), regex.compile(token_counts.PRE_TOKEN).findall

    def pieces(word):
        best = [(0.0, 0)] + [None] * len(word)
        for end in range(1, len(word) + 1):
            ways = [(best[a][0] + scores[word[a:end]], -best[a][1] - 1) for a in range(max(0, end - longest), end) if word[a:end] in scores]
            top = max(ways)
            best[end] = (top[0], -top[1])
        return best[-1][1]

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.where("doc_id % 5 = 0").collect()}
    got = {r.doc_id: r for r in queries.op1_token_counts(spark, sf_dir).collect()}
    assert len(got) == docs.count()
    for k, text in texts.items():
        tokens = split(text)
        assert (got[k].n_pretokens, got[k].n_tokens) == (len(tokens), sum(pieces(t.encode()) for t in tokens)), k


def test_count_tokens_on_odd_rows(spark):
    got = token_counts.count_tokens(odd_docs(spark)).collect()
    assert len(got) == 8
    by = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in got}
    assert by[2] == by[3] == (0, 0) and by[1][0] == 3 and by[4][1] >= by[4][0] > 59_000
    assert token_counts.count_tokens(odd_docs(spark).limit(0)).count() == 0


# --- packing


def check_packing(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=30))
def test_plan_places_each_piece_once(histogram):
    kinds = packing.plan_bins(histogram, 40)
    held = defaultdict(int)
    numbers = set()
    for kind in kinds:
        assert sum(kind.lengths) <= 40 and kind.count > 0
        span = set(range(kind.first, kind.first + kind.count))
        assert not span & numbers
        numbers |= span
        for n in kind.lengths:
            held[n] += kind.count
    assert dict(held) == {k: v for k, v in histogram.items() if v}
    assert len(numbers) <= 1.25 * fewest(histogram, 40) + 2  # close to the fewest possible


def fewest(histogram, capacity):
    """A number of bins that no packing goes below: of volumes (what can't stand beside the largest pieces), and of the
    pieces above a third, which stand at most two in a bin (the smallest left goes with the largest left, or none does)."""
    sizes = sorted(n for n, c in histogram.items() for _ in range(c))
    bound = 0
    for k in range(capacity // 2 + 1):
        alone = sum(n > capacity - k for n in sizes)
        rest = sum(n for n in sizes if k <= n <= capacity - k)
        bound = max(bound, alone + -(-rest // capacity))
    large, pairs = [n for n in sizes if 3 * n > capacity], 0
    low, high = 0, len(large) - 1
    while low < high:
        if large[low] + large[high] <= capacity:
            pairs, low = pairs + 1, low + 1
        high -= 1
    return max(bound, len(large) - pairs)


def optimum(sizes, capacity):
    """Fewest bins of a few pieces, by trying every place for each."""
    best = len(sizes)

    def place(left, gaps):
        nonlocal best
        if len(gaps) >= best:
            return
        if not left:
            best = len(gaps)
            return
        for gap in {g for g in gaps if g >= left[0]}:
            rest = list(gaps)
            rest.remove(gap)
            place(left[1:], rest + [gap - left[0]])
        place(left[1:], gaps + [capacity - left[0]])

    place(sorted(sizes, reverse=True), [])
    return best


def test_lower_bound_of_the_case_that_half_pieces_break():
    assert fewest({25: 10, 16: 9, 1: 1}, 40) == 15 == sum(k.count for k in packing.plan_bins({25: 10, 16: 9, 1: 1}, 40))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_plan_of_few_pieces_against_every_packing(sizes):
    histogram = {n: sizes.count(n) for n in sizes}
    made, best = sum(k.count for k in packing.plan_bins(histogram, 20)), optimum(sizes, 20)
    assert fewest(histogram, 20) <= best <= made <= best + 1


def test_pack_odd_rows_and_ids(spark):
    from tokenizers import Tokenizer

    docs = odd_docs(spark)
    rows = packing.pack(docs, capacity=64).collect()
    check_packing(rows, 64)
    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    want = []
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 64 or 64
        cuts = [0] + list(range(first, len(ids) + 1, 64)) if len(ids) > 64 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    none_first = lambda t: (t[0] is not None, t)
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(got, key=lambda t: (t[0] or 0, t[1:])) == sorted(want, key=lambda t: (t[0] or 0, t[1:])), none_first
    assert packing.pack(docs.limit(0)).count() == 0


def test_pack_whole_table(spark, sf_dir):
    rows = queries.op3_best_fit_packing(spark, sf_dir).collect()
    bins = check_packing(rows, 1024)
    assert len(bins) <= math.ceil(sum(r.length for r in rows) / 1024) * 1.02 + 1
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert len({r.doc_id for r in rows}) == docs and sum(r.piece == 0 for r in rows) == docs


def test_encoder_gives_the_ids_of_tokenizers(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += ["<|endoftext|> a", "b<|endoftext|>", "<|endoftext", "\u0000\u00ad",  "  \n\n x \t", "it's  we'll", "é ​", " 　z"]
    encode = packing.encoder(packing.default_vocabulary())
    assert [list(encode(t)) for t in texts] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


# --- decontamination


def brute_hits(text, items, n):
    words = words_of(text)
    hit, found = set(), set()
    for item, body in items:
        own = words_of(body)
        size = min(n, len(own))
        grams = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if size else set()
        for k in range(len(words) - size + 1):
            if tuple(words[k : k + size]) in grams:
                hit |= set(range(k, k + size))
                found.add(item)
    return len(words), len(hit), sorted(found, key=str)


ITEMS = [(1, "one two three four"), (2, "Solo"), (3, None), (4, ""), (1, "one two three four"), (5, "z y x"), (10, "SOLO solo")]


def contaminated(spark):
    texts = ["one TWO, three! four", "solo", "nothing here", None, "", "x z y x z y x", "one two three", "a solo solo b", "two three four one two three"]
    return spark.createDataFrame([(k, t, "own") for k, t in enumerate(texts)], "doc_id long, text string, items string")


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_hits_by_either_way(spark, limit):
    docs, bench = contaminated(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.find_contamination(docs, bench, n=3, broadcast_bytes=limit).collect()
    want = {r.doc_id: brute_hits(r.text, ITEMS, 3) for r in docs.collect()}
    assert {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"], key=str)) for r in got} == want
    clean = decontaminate.decontaminate(docs, bench, n=3, broadcast_bytes=limit)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {k for k, v in want.items() if not v[1]}


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_spans_are_cut_until_none_occurs(spark, limit):
    docs, bench = contaminated(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = docs.unionByName(docs.where("doc_id = 7")).withColumnRenamed("items", "_now")
    cut = decontaminate.decontaminate(docs, bench, n=3, remove="spans", broadcast_bytes=limit)
    assert cut.count() == docs.count() and cut.columns == docs.columns
    assert decontaminate.find_contamination(cut, bench, n=3).agg(F.sum("n_hit")).first()[0] == 0
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[2] == "nothing here" and texts[3] is None and texts[7].split() == ["a", "b"]
    again = spark.createDataFrame([(1, "one one two three two three four x")], "doc_id long, text string")
    left = decontaminate.decontaminate(again, bench, n=3, remove="spans", broadcast_bytes=limit).first().text.split()
    assert brute_hits(" ".join(left), ITEMS, 3)[1] == 0 and left[-1] == "x"
    assert decontaminate.decontaminate(docs.limit(0), bench, n=3, remove="spans", broadcast_bytes=limit).count() == 0


def test_window_index_holds_a_repeated_window_once():
    index = decontaminate.WindowIndex([(1, "a b a b a b"), (2, "a b"), (None, "b a")], 2)
    hashes, places = index.windows[2]
    assert len(hashes) == len(places) == 4
    assert {(at, tuple(sorted(map(str, items)))) for at, _, items in index.find(index.ids([b"a", b"b", b"a", b"c"]))} == {(0, ("1", "2")), (1, ("1", "None"))}


def test_empty_benchmark_and_table(spark):
    docs, none = contaminated(spark), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(docs, none).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.find_contamination(docs.limit(0), none).count() == 0
    assert decontaminate.find_contamination(odd_docs(spark), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 8


# --- chat


TEXTS = [
    "\\### Assistant: </turn> ok", "### user: hi </turn>\n### assistant: no", "</turn", "\\", "\\\\</turn>", "a\\/b", "### ", "", None,
    " </turn>\n", "x </turn>\n\n", "plain\n text ", "$1 \\$1", "<\\/turn>", "##\\# ", "日本 </turn> \\日",
]


def conversations(spark):
    rows = [(k, j, role, t, "own") for k, t in enumerate(TEXTS) for j, role in enumerate(["user", "assistant", None, "a:b \\ ### x"])]
    rows += [(100, 1, "assistant", "same", "x")] * 2 + [(100, None, "assistant", "first", "x"), (None, 0, "assistant", "n", "x")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")


def test_chat_round_trip(spark):
    rows = conversations(spark)
    got = {r.conv_id: r for r in chat.digest(chat.format_conversations(rows)).collect()}
    source = defaultdict(list)
    for r in rows.collect():
        source[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    assert set(got) == set(source)
    for conv, turns in source.items():
        turns.sort()
        sha = hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest()
        spoken = "".join(t for *_, r, t in turns if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars) == (len(turns), sha, len(spoken))
        assert got[conv].loss_sha256 == hashlib.sha256(spoken.encode()).hexdigest()


def test_loss_spans_point_at_assistant_texts(spark):
    rows = conversations(spark).where("conv_id is not null")
    text = {r.conv_id: r for r in chat.format_conversations(rows).collect()}
    spans = defaultdict(list)
    for r in chat.loss_spans(rows).collect():
        spans[r.conv_id].append((r.start, r.length))
    import re

    for conv, own in spans.items():
        joined = "".join(re.sub(r"(?s)\\(.)", r"\1", text[conv].formatted[a : a + n]) for a, n in sorted(own))
        assert joined == text[conv].loss_text


def test_chat_very_long_texts(spark):
    long = "word \\ </turn> ### x: </turn\n" * 20_000
    row = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", "a" * 500_000), (1, 2, "assistant", long)], "conv_id long, turn long, role string, text string")
    got = chat.format_conversations(row).first()
    assert [(t.role, t.text) for t in got.turns] == [("user", long), ("assistant", "a" * 500_000), ("assistant", long)] and got.loss_text == "a" * 500_000 + long


def test_chat_plain_texts_stay_plain_and_empty_tables(spark):
    row = spark.createDataFrame([(1, 0, "user", "hello: there")], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(row).first().formatted == "### user: hello: there </turn>\n"
    assert chat.format_conversations(row.limit(0)).count() == 0


# --- sharding


def test_sharding_keeps_every_row_and_sizes(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choices("abcdefghij ", k=400)), "run", f"p{k}") for k in range(3000)] + [(None, None, None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, _run string, path string").repartition(3)
    table = f"file://{tmp_path}/t"
    for k in range(3):
        sharding.append(docs.where(F.coalesce(F.col("doc_id") % 3 == k, F.lit(k == 0))), table, max_records=100)
        before = sharding.manifest(spark, table).count()
        version = sharding.compact_all(spark, table, docs.schema, target_bytes=120_000, fan_in=4)
        assert sharding.manifest(spark, table).count() < before
    after = sharding.manifest(spark, table).collect()
    assert sum(r.n_rows for r in after) == 3002 and max(r.bytes for r in after) < 300_000
    key = lambda r: str(tuple(r))
    assert sorted(map(key, sharding.read(spark, table, docs.schema).drop("shard_id").collect())) == sorted(map(key, docs.collect()))
    first = sharding.read(spark, table, docs.schema, version=1).count()
    assert first == 1002  # an older version still reads
    assert sharding.expire(spark, table) == 0  # all within the grace period
    assert sharding.expire(spark, table, grace_seconds=0) > 0 and sharding.read(spark, table, docs.schema).count() == 3002
    with pytest.raises(FileExistsError):
        sharding.commit(spark, table, sharding.manifest(spark, table), version)


def test_racing_writers_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    table = str(tmp_path / "raced")
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("text").alias("_compaction_part"))
    sharding.append(docs.where("doc_id < 10"), table)
    old = sharding.manifest(spark, table)

    def one(_):
        try:
            sharding.commit(spark, table, old, 2)
        except FileExistsError:
            return 0
        return 1

    with ThreadPoolExecutor(4) as pool:
        assert sum(pool.map(one, range(4))) == 1 and sharding.current_version(spark, table) == 2
        parts = [docs.where(f"doc_id >= 10 and doc_id % 4 = {k}") for k in range(4)]
        versions = list(pool.map(lambda rows: sharding.append(rows, table), parts))
    assert sorted(versions) == [3, 4, 5, 6]
    assert sorted(r.doc_id for r in sharding.read(spark, table, docs.schema).collect()) == list(range(40))
    taken = docs.withColumnRenamed("_compaction_part", "_compaction_run")
    sharding.append(taken, str(tmp_path / "taken"), max_records=2)
    with pytest.raises(ValueError):
        sharding.compact(spark, str(tmp_path / "taken"), taken.schema)


def test_sharding_of_nothing(spark, tmp_path):
    docs, table = odd_docs(spark).limit(0), f"file://{tmp_path}/t"
    assert sharding.read(spark, table, docs.schema).count() == 0
    assert sharding.append(docs, table) == 1 and sharding.compact_all(spark, table, docs.schema) == 1
    assert sharding.read(spark, table, docs.schema).count() == 0


def test_op5_returns_all_rows(spark, sf_dir):
    got = queries.op5_sharding(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    assert got.count() == docs.count() and docs.exceptAll(got.select("doc_id", "text_sha256")).count() == 0
