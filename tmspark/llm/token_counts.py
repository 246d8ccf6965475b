"""Token counts under a unigram model, by a trie that shares the forward scores of common prefixes.

The vocabulary is a public byte-level file; a piece of rank r has the Zipf probability 1 / ((r + 1) * H). A text is
split into pre-tokens, and each pre-token into the pieces of the highest total log probability. Distinct pre-tokens are
inserted in a trie. A node is made once, and with it the best score and the piece count of its prefix; so a prefix
that many pre-tokens share is scored once, and a pre-token's count is what its last node holds.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the split pattern that belongs to the public byte-level vocabulary.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def unigram_scores(path: str) -> dict[bytes, float]:
    """Piece to log probability, by rank."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    total = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {piece: -math.log(r + 1) - total for piece, r in ranks.items()}


class ForwardTrie:
    """Pre-tokens as paths of bytes; each node holds the best score of its prefix and the pieces that reach it."""

    def __init__(self, scores: dict[bytes, float], max_nodes: int = 400_000):
        self.scores, self.max_nodes = scores, max_nodes
        by_last: dict[int, set[int]] = {}
        for piece in scores:
            by_last.setdefault(piece[-1], set()).add(len(piece))
        self.lengths = {last: sorted(n) for last, n in by_last.items()}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.pieces = [0.0], [0]

    def count(self, word: bytes) -> int:
        """Pieces of the best split; of equal scores the one with fewer pieces. An empty word has none."""
        if len(self.best) + len(word) > max(self.max_nodes, len(word) + 1):
            self.clear()
        child, best, pieces, path = self.child, self.best, self.pieces, [0]
        for end, byte in enumerate(word, 1):
            key = path[-1] << 8 | byte
            node = child.get(key)
            if node is None:
                top, n = -math.inf, 0
                for size in self.lengths.get(byte, ()):
                    if size > end:
                        break
                    score = self.scores.get(word[end - size : end])
                    if score is not None:
                        before = path[end - size]
                        score += best[before]
                        if score > top or score == top and pieces[before] + 1 < n:
                            top, n = score, pieces[before] + 1
                node = child[key] = len(best)
                best.append(top)
                pieces.append(n)
            path.append(node)
        return pieces[path[-1]]


def _counter(path: str, max_nodes: int, memo_size: int):
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie, split, memo = ForwardTrie(unigram_scores(path), max_nodes), regex.compile(PRE_TOKEN).findall, {}
        for texts in batches:
            rows = []
            for text in texts:
                found = [] if text is None else split(text)
                if len(memo) > memo_size:
                    memo.clear()
                for token in set(found):
                    if token not in memo:
                        memo[token] = trie.count(token.encode("utf-8", "surrogatepass"))
                rows.append((len(found), sum(map(memo.__getitem__, found))))
            yield pd.DataFrame(rows, columns=["n_pretokens", "n_tokens"], dtype="int64")

    return counts


def token_count_column(
    text: Column, vocabulary: str | None = None, max_nodes: int = 400_000, memo_size: int = 300_000
) -> Column:
    """struct<n_pretokens, n_tokens> of a text column; null and empty texts have 0 of both. The trie and the memo are
    emptied at their bounds, which costs time but changes no count."""
    path = vocabulary or default_vocabulary()
    kind = "n_pretokens long, n_tokens long"
    return F.pandas_udf(_counter(path, max_nodes, memo_size), kind)(text)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row per row of ``docs``: the id, n_pretokens, n_tokens. No shuffle; repeated rows stay, other columns go."""
    counted = docs.select(F.col(id_col), token_count_column(F.col(text_col), **settings).alias("_c"))
    return counted.select(id_col, "_c.n_pretokens", "_c.n_tokens")
