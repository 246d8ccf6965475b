"""Byte-level encoding against the public library of the vocabulary, and exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tmspark.llm import byte_bpe, queries


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(byte_bpe.default_vocabulary(), most_bytes=3_000)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def same(codec, library, texts):
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode_ordinary(text), text[:80]


def test_every_kind_of_character(codec, library):
    points = [*range(0x3100), *range(0xA640, 0xABFF, 3), *range(0xF900, 0x10000, 2), *range(0x1F300, 0x1F700, 5), 0xE0041, 0x10FFFF]
    same(codec, library, [f"a{c} b{c}{c}c  {c} {c}9{c}" for c in map(chr, points)])


def test_white_space_and_long_words(codec, library):
    rng = random.Random(3)
    odd = ["", " ", "  ", "x ", " x", "\n \n  x  y \n", "a\x1c b", "a   b", "it's we'll 'S", "<|endoftext|>", "\x00", "#\x00 \x00"]
    long_ = ["a" * 30_001, "tab" * 9_000, "ê" * 4_000, " " * 5_000 + "x", "".join(rng.choice("abcdeé") for _ in range(2_000))]
    mixed = ["".join(rng.choice(["th", "e", " ", "  ", "\n", "1", "ß", "!", "ing", "\t"]) for _ in range(60)) for _ in range(300)]
    same(codec, library, odd + long_ + mixed)


def test_pairs_that_come_first_after_a_contraction():
    """Ranks no training gives: contracting one pair makes a pair of lower rank, so equal pairs must wait."""
    rng = random.Random(8)
    for trial in range(60):
        pieces = {bytes([b]) for b in range(256)}
        while len(pieces) < 256 + 25:
            pieces.add(bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))))
        made = [p for p in pieces if len(p) > 1]
        rng.shuffle(made)
        ranks = {bytes([b]): b for b in range(256)} | {p: 256 + k for k, p in enumerate(made)}
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(byte_bpe, "read_ranks", lambda _, ranks=ranks: ranks)
            codec = byte_bpe.Codec("made up")
        for word in ["".join(rng.choice("abc") for _ in range(rng.randint(2, 40))) for _ in range(20)]:
            left = [bytes([b]) for b in word.encode()]
            while left[1:]:
                rank, at = min((ranks.get(a + b, 1 << 30), k) for k, (a, b) in enumerate(zip(left, left[1:])))
                if rank == 1 << 30:
                    break
                left[at : at + 2] = [left[at] + left[at + 1]]
            got = np.frombuffer(codec.contract([word.encode()])[0], dtype="<u4").tolist()
            assert got == [ranks[p] for p in left], (trial, word)


def test_memo_of_two_generations_forgets_and_stays_right(library):
    small = byte_bpe.Codec(byte_bpe.default_vocabulary(), memo=5)
    texts = [f"word{k % 7} other{k % 11} xyz{k}" for k in range(60)]
    for k in range(0, 60, 6):
        same(small, library, texts[k : k + 6])


def test_odd_rows_and_round_trip(spark):
    rows = [(1, None), (2, ""), (3, "same text"), (3, "same text"), (None, "né\u0000 " * 5), (5, "long " * 60_000)]
    docs = spark.createDataFrame([(i, t, 0, "n") for i, t in rows], "doc_id int, text string, ids int, bytes string")
    arrays = {(r.doc_id, len(r.ids)) for r in byte_bpe.encode(docs).collect()}
    packed = byte_bpe.decode(byte_bpe.encode(docs, packed=True)).collect()
    assert sorted(((r.doc_id, bytes(r.bytes)) for r in packed), key=str) == sorted(((i, (t or "").encode()) for i, t in rows), key=str)
    assert arrays == {(r.doc_id, len(r.ids) // 4) for r in packed}
    assert byte_bpe.decode(byte_bpe.encode(docs.limit(0), packed=True)).count() == 0
    foreign = spark.range(1).select(F.col("id").alias("doc_id"), F.unhex(F.lit("FFFFFF00")).alias("ids"))
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decode(foreign).collect()


def test_round_trip_is_one_python_step_and_equals_two(spark):
    rows = [(1, None), (2, ""), (3, "same text"), (3, "same text"), (None, "n\u00e9\u0000 " * 5), (5, "long \u0142 " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got, two = byte_bpe.round_trip(docs), byte_bpe.decode(byte_bpe.encode(docs, packed=True))
    plain = lambda frame: sorted(((r.doc_id, bytes(r.ids), bytes(r.bytes)) for r in frame.collect()), key=str)
    assert plain(got) == plain(two) and byte_bpe.round_trip(docs.limit(0)).count() == 0
    digests = got.select("doc_id", F.sha2("ids", 256), F.sha2("bytes", 256), F.octet_length("ids"))
    assert digests._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1


def test_ascii_texts_are_split_as_all_are():
    split, whole = byte_bpe.splitter(), byte_bpe.regex.compile(byte_bpe.PRE_TOKEN).findall
    letters = [chr(k) for k in range(128)]
    rng = random.Random(11)
    for text in ["".join(rng.choice(letters) for _ in range(50)) for _ in range(500)] + [f"a{x}{y} {x}'{y}s" for x in letters for y in letters]:
        assert split(text) == whole(text), text


def test_query_equals_the_library(spark, sf_dir, library):
    got = {r.doc_id: r for r in queries.op13_byte_bpe(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids = np.array(library.encode_ordinary(text or ""), dtype="<u4")
        row = got[doc_id]
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
