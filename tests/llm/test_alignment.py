"""Alignment against tokens from the libraries themselves and links by plain comparison of ranges."""

import hashlib
import json
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tmspark.llm import alignment, queries

ODD = [
    None, "", " ", "  ", "a", "a b", " a  b ", "x\n y", "\n", "tab\t \t here", "▁ literal", "über naïve œuvre 日本語 🙂", "<s> </s> <|endoftext|>",
    "à é", "ﬁne", "it's 12345  67", "\x00\x01", "word " * 3_000, "trailing ", "same text", "same text", "　wide space x", "##@@!! ((",
]


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174]
    byte = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    names = {n: p for p, n in json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))["model"]["vocab"].items()}

    def tokens(text):
        whole = f" {text}".encode()
        a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text, num_threads=1)
        a_bytes = [bytes(byte[c] for c in names[n]) for n in a_ids]
        pieces = [b.id_to_piece(n) for n in b_ids]
        b_bytes = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            return [], []
        out = []
        for ids, parts in ((a_ids, a_bytes), (b_ids, b_bytes)):
            at, rows = 0, []
            for n, part in zip(ids, parts):
                rows.append((n, at, at + len(part)))
                at += len(part)
            out.append(rows)
        return out

    return tokens


def plain(sides, texts):
    """Rows of the contract, by comparing ranges."""
    rows, holding = [], Counter()
    for text in texts:
        a, b = sides(text or "")
        links, low = [], 0
        for n, x, y in a:
            while low < len(b) and b[low][2] <= x:
                low += 1
            k = low
            while k < len(b) and b[k][1] < y:
                links.append((n, b[k][0]))
                k += 1
        ends = sorted({y for *_, y in a} & {y for *_, y in b})
        groups = []
        for first, last in zip([0, *ends], ends):
            groups.append("|".join(",".join(str(n) for n, x, _ in side if first <= x < last) for side in (a, b)) if len(a) < 3_000 else "")
        holding.update(set(links))
        rows.append((len(a), len(b), len(ends), links, ";".join(groups)))
    best = Counter()
    for (n, _), count in holding.items():
        best[n] = max(best[n], count)
    return [
        (n_a, n_b, n_groups, len(links), sum(holding[x] == best[x[0]] for x in links), sum(holding[x] for x in links), groups)
        for n_a, n_b, n_groups, links, groups in rows
    ]


@pytest.mark.parametrize(("parts", "most_pairs"), [(1, 300_000), (5, 20)])
def test_odd_rows(spark, sides, parts, most_pairs):
    rows = [(None if k == 3 else k % 20, text) for k, text in enumerate(ODD)]
    docs = spark.createDataFrame([(i, t, 1, b"x") for i, t in rows], "doc_id int, text string, n_a int, _links binary").repartition(parts)
    found = alignment.with_counts(alignment.align(docs, most_pairs=most_pairs))
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    got = sorted((str(r.doc_id), *(r[n] for n in names)) for r in found.collect())
    want = sorted((str(i), *row) for (i, _), row in zip(rows, plain(sides, ODD)))
    long_ = [(w[:-1], g[:-1]) for w, g in zip(want, got) if w[1] >= 3_000]
    assert long_ and all(w == g for w, g in long_)
    assert [g for g in got if g[1] < 3_000] == [w for w in want if w[1] < 3_000]
    assert alignment.with_counts(alignment.align(docs.limit(0))).count() == 0


def test_planes_hold_any_numbers():
    import numpy as np

    for numbers, times in ([], []), ([0], [1]), ([3, 70_000, 4_000_000_000], [1, 300, 70_000]):
        got = alignment.unpacked(alignment.packed(np.array(numbers, dtype=np.int64), np.array(times, dtype=np.int64)))
        assert [x.tolist() for x in got] == [numbers, times]


def test_query_equals_plain_comparison(spark, sf_dir, sides):
    got = {r.doc_id: r for r in queries.op11_token_alignment(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for (doc_id, _), row in zip(docs, plain(sides, [t for _, t in docs])):
        found = got[doc_id]
        assert (found.n_a, found.n_b, found.n_groups, found.n_links, found.n_best, found.count_sum) == row[:6]
        if row[0] < 3_000:
            assert found.groups_sha256 == (hashlib.sha256(row[6].encode()).hexdigest() if row[0] else "")
