"""Token counts by the best unigram segmentation, with forward scores shared in a trie of distinct pre-tokens."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from sievework.llm.byte_vocab import ByteVocab, read_vocab
from sievework.llm.common import id_and_text, map_texts

#: Bounds of a task's memory: nodes of the trie, pre-tokens whose count is kept, bytes of a pre-token that enters the trie.
MAX_NODES, MAX_WORDS, MAX_TRIE_WORD = 1_000_000, 500_000, 256
#: A piece's cost is 1000 * ln(id + OFFSET), rounded: Zipf's law with Mandelbrot's offset, as ids are ranks.
OFFSET = 2.7


def piece_costs(vocab: ByteVocab) -> dict[bytes, int]:
    return {t: round(1000 * math.log(i + OFFSET)) for t, i in vocab.ids.items()}


class TrieCounter:
    """Of each trie node the least (cost, number of pieces) of the prefix that ends there: the forward score, computed once."""

    def __init__(self, costs: dict[bytes, int]):
        self.costs = costs
        self.longest = max(map(len, costs))
        self.clear()

    def clear(self) -> None:
        self.edges: dict[int, int] = {}  # 256 * node + byte -> node
        self.best: list[tuple[int, int]] = [(0, 0)]

    def _forward(self, word: bytes, end: int, path: list[tuple[int, int]]) -> tuple[int, int]:
        out = None
        for k in range(1, min(end, self.longest) + 1):
            c = self.costs.get(word[end - k : end])
            if c is not None:
                cost, n = path[end - k]
                if out is None or (cost + c, n + 1) < out:
                    out = (cost + c, n + 1)
        if out is None:
            raise ValueError("a byte is missing in the vocabulary")
        return out

    def count(self, word: bytes) -> tuple[int, int]:
        """(cost, number of pieces) of the best segmentation; of equal costs the one with fewer pieces."""
        path = [(0, 0)]
        if len(word) > MAX_TRIE_WORD:
            for end in range(1, len(word) + 1):
                path.append(self._forward(word, end, path))
            return path[-1]
        if len(self.best) > MAX_NODES:
            self.clear()
        edges, best, node = self.edges, self.best, 0
        for i, byte in enumerate(word):
            below = edges.get(256 * node + byte)
            if below is None:
                below = edges[256 * node + byte] = len(best)
                best.append(self._forward(word, i + 1, path))
            node = below
            path.append(best[node])
        return path[-1]


def count_tokens(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, n_pretokens, n_tokens, cost (of the whole text, in thousandths of a nat).

    A map without a shuffle over whole texts. Null and empty texts have none. A text of any length is counted whole; a pre-token beyond
    MAX_TRIE_WORD bytes takes the same forward pass without entering the trie, so that no single one fills a task's memory. Of equal costs
    the segmentation with fewer pieces counts. Repeated rows give repeated results; a null id stays null; an empty table gives no
    rows; other columns of df, also ones named as results are, play no part.

    The scores come from the public vocabulary alone: tokenizers are not trained here, so neither are a unigram tokenizer's scores.
    """
    content = read_vocab(vocab_path)

    def make():
        vocab = ByteVocab(content)
        counter = TrieCounter(piece_costs(vocab))
        known: dict[str, tuple[int, int]] = {}  # the terminal counts

        def one(text: str) -> tuple[int, int, int]:
            pieces = vocab.pieces(text)
            try:
                got = [known[p] for p in pieces]
            except KeyError:
                new = {p for p in pieces if p not in known}
                if len(known) + len(new) > MAX_WORDS:
                    known.clear()
                    new = set(pieces)
                for b, p in sorted((p.encode("utf-8", "replace"), p) for p in new):
                    known[p] = (0, 1) if p in vocab.special else counter.count(b)
                got = [known[p] for p in pieces]
            return len(pieces), sum([x[1] for x in got]), sum([x[0] for x in got])

        def f(texts: list[str]) -> dict[str, list]:
            rows = [one(t) for t in texts]
            return {n: [r[i] for r in rows] for i, n in enumerate(("n_pretokens", "n_tokens", "cost"))}

        return f

    return map_texts(id_and_text(df, id_col, text_col), make, [("n_pretokens", "bigint"), ("n_tokens", "bigint"), ("cost", "bigint")])
