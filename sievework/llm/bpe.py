"""BPE encoding by a trie of distinct words that carries the last token of each prefix, and decoding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sievework.llm.byte_vocab import ByteVocab, read_vocab
from sievework.llm.common import id_and_text, map_texts

#: Bounds of a task's memory: words whose encoding is kept (twice as many with older ones), texts whose new words make one trie,
#: bytes of a word that enters a trie.
MAX_WORDS, TRIE_TEXTS, MAX_TRIE_WORD = 150_000, 256, 64
_STEP = 0x9E3779B97F4A7C15  # of the rolling hash of a prefix


class _Lookup:
    """Values by 64-bit keys, for arrays: a table of flags sends most strangers away before the sorted keys are searched."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.flags = np.zeros(1 << 20, dtype=bool)
        self.flags[self.slot(keys)] = True

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(_STEP) >> np.uint64(44)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and their values."""
        maybe = np.flatnonzero(self.flags[self.slot(keys)])
        at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        there = self.keys[at] == keys[maybe]
        return maybe[there], self.values[at[there]]


class TrieEncoder:
    """Encodes words exactly as repeated merging by rank does; every piece of the vocabulary must be what its own bytes merge to.

    The tokens of a prefix are those of a shorter prefix and one last token: the only piece that ends the prefix and whose
    left neighbour, the last token of the rest, has no merge across the seam that comes first. So a trie node needs one
    token, its state, and words that share a prefix share its encoding. The sorted words are the trie in depth-first order:
    a node is a run of words with one prefix. States pass from the nodes of one depth to their children, all at a time.
    """

    def __init__(self, vocab: ByteVocab):
        self.vocab = vocab
        top = max(vocab.bytes) + 1
        self.size = np.zeros(top, dtype=np.int64)
        self.rank = np.full(top, -1, dtype=np.int64)
        self.left, self.right = np.zeros(top, dtype=np.int64), np.zeros(top, dtype=np.int64)
        for i, b in vocab.bytes.items():
            self.size[i] = len(b)
        for i, (rank, left, right) in vocab.parts.items():
            self.rank[i], self.left[i], self.right[i] = rank, left, right
        self.pieces = _Lookup(np.array([self._hash(b) for b in vocab.ids], dtype=np.uint64), np.array(list(vocab.ids.values()), dtype=np.int64))
        self.merges = _Lookup(np.array([a << 32 | b for a, b in vocab.pairs], dtype=np.uint64), np.array([r for r, _ in vocab.pairs.values()], dtype=np.int64))
        self.power = np.ones(MAX_TRIE_WORD + 1, dtype=np.uint64)
        for k in range(1, MAX_TRIE_WORD + 1):
            self.power[k] = pow(_STEP, k, 2**64)

    @staticmethod
    def _hash(b: bytes) -> int:
        h = 0
        for x in b:
            h = (h * _STEP + x + 1) % 2**64
        return h

    def seams_hold(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the bytes of left and right, merged together, end as these two tokens side by side.

        Taken back in time: of the two the one merged later is undone first, of equals the right one; at no time may the pair
        at the seam have had a merge of its own that came earlier than the step undone last.
        """
        out = np.zeros(len(left), dtype=bool)
        at = np.arange(len(left))
        before = np.full(len(left), 1 << 60)  # four times the rank of the step undone last; two more on the right side
        while len(at):
            own, rank = self.merges.find((left << 32 | right).astype(np.uint64))
            lost = np.zeros(len(at), dtype=bool)
            lost[own] = 4 * rank + 1 < before[own]
            a, b = self.rank[left], self.rank[right]
            whole = (a < 0) & (b < 0)
            out[at[whole & ~lost]] = True
            go = np.flatnonzero(~lost & ~whole)
            at, left, right, a, b = at[go], left[go], right[go], a[go], b[go]
            on_left = a > b
            before = np.where(on_left, 4 * a, 4 * b + 2)
            left, right = np.where(on_left, self.right[left], left), np.where(on_left, right, self.left[right])
        return out

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """ids of distinct words in sorted order; what doesn't come back to its bytes goes through encode_alone, so no hash is trusted."""
        short = [w for w in words if len(w) <= MAX_TRIE_WORD]
        quick = dict(zip(short, self._through_trie(short)))
        piece = self.vocab.bytes
        return [ids if (ids := quick.get(w)) and b"".join([piece[i] for i in ids]) == w else self.encode_alone(w) for w in words]

    def _through_trie(self, words: list[bytes]) -> list[list[int]]:
        if not words:
            return []
        size = np.array([len(w) for w in words])
        width = int(size.max())
        chars = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), dtype=np.uint8).reshape(len(words), width)
        prefix = np.zeros((width + 1, len(words)), dtype=np.uint64)
        for d in range(width):
            prefix[d + 1] = prefix[d] * np.uint64(_STEP) + chars[:, d] + np.uint64(1)
        last = np.full((width + 1, len(words)), -1, dtype=np.int64)  # the state of each word's prefix
        for d in range(1, width + 1):
            active = np.flatnonzero(size >= d)
            h = prefix[d, active]
            first = np.concatenate([[True], h[1:] != h[:-1]])
            node = active[first]  # a word that stands for each node
            h = h[first]
            state = np.full(len(node), -1, dtype=np.int64)
            whole, piece = self.pieces.find(h)
            fits = self.size[piece] == d
            state[whole[fits]] = piece[fits]
            rest = np.flatnonzero(state < 0)
            who, tok, prev = [], [], []
            for k in range(1, min(d, self.vocab.longest + 1)):
                i, piece = self.pieces.find(h[rest] - prefix[d - k, node[rest]] * self.power[k])
                fits = self.size[piece] == k
                who.append(rest[i[fits]])
                tok.append(piece[fits])
                prev.append(last[d - k, node[who[-1]]])
            if len(rest) and who:
                owner, right, left = np.concatenate(who), np.concatenate(tok), np.concatenate(prev)
                holds = self.seams_hold(left, right)
                state[owner[holds]] = right[holds]
            last[d, active] = state[np.cumsum(first) - 1]
        out: list[list[int]] = [[] for _ in words]
        at, end = np.arange(len(words)), size.copy()
        while len(at):
            t = last[end, at]
            for i, x in zip(at.tolist(), t.tolist()):
                out[i].append(x)
            end = end - np.where(t < 0, end, self.size[t])
            go = end > 0
            at, end = at[go], end[go]
        for ids in out:
            ids.reverse()
        return [[] if ids and ids[0] < 0 else ids for ids in out]

    def encode_alone(self, word: bytes) -> list[int]:
        """One word, prefix by prefix; for long words, which hardly share a beginning."""
        path, ids = [-1], self.vocab.ids
        for end in range(1, len(word) + 1):
            found = [(k, t) for k in range(1, min(end, self.vocab.longest) + 1) if (t := ids.get(word[end - k : end])) is not None]
            if not found:
                raise ValueError("a byte is missing in the vocabulary")
            if found[-1][0] == end:
                path.append(found[-1][1])
            else:
                holds = self.seams_hold(np.array([path[end - k] for k, _ in found]), np.array([t for _, t in found]))
                path.append(found[int(holds.argmax())][1])
        out, end = [], len(word)
        while end:
            out.append(path[end])
            end -= len(self.vocab.bytes[path[end]])
        return out[::-1]


class Codec:
    """Texts to ids and back; encodings of words are kept up to MAX_WORDS."""

    def __init__(self, content: bytes):
        self.vocab = ByteVocab(content)
        self.encoder = TrieEncoder(self.vocab)
        self.number = {i: str(i) for i in self.vocab.bytes}
        self.words: dict[str, tuple[str, int, bytes]] = {}
        self.older: dict[str, tuple[str, int, bytes]] = {}

    def learn(self, pieces: set[str]) -> None:
        """Encode the words that aren't known yet, in sorted order."""
        new = pieces.difference(self.words)
        if len(self.words) + len(new) > MAX_WORDS:  # words met since the last time stay at hand, older ones go
            self.words, self.older = {}, self.words
            new = pieces
        if self.older:
            again = new.intersection(self.older)
            self.words.update({p: self.older[p] for p in again})
            new = new.difference(again)
        special, number, piece, words = self.vocab.special, self.number, self.vocab.bytes, self.words
        ordered = sorted([(p.encode("utf-8", "replace"), p) for p in new if p not in special])
        for (_, p), ids in zip(ordered, self.encoder.encode([b for b, _ in ordered])):
            words[p] = (",".join([number[i] for i in ids]), len(ids), b"".join([piece[i] for i in ids]))
        for p in new.intersection(special):
            words[p] = (number[special[p]], 1, piece[special[p]])

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocab.bytes.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def known(self, texts: list[str]) -> Iterator[list[tuple[str, int, bytes]]]:
        """For each text its words' (ids, number of ids, decoded bytes)."""
        for at in range(0, len(texts), TRIE_TEXTS):
            pieces = [self.vocab.pieces(t) for t in texts[at : at + TRIE_TEXTS]]
            self.learn(set().union(*pieces))
            words = self.words
            yield from ([words[p] for p in ps] for ps in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[int(i) for w in known for i in w[0].split(",")] for known in self.known(texts)]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of tokens, SHA-256 of the ids, SHA-256 of the text decoded from the ids."""
        out = []
        for known in self.known(texts):
            decoded = b"".join([w[2] for w in known]).decode("utf-8", "replace")
            ids = ",".join([w[0] for w in known])
            out.append((sum([w[1] for w in known]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        return out


def encode_documents(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, ids array<int>. A map without a shuffle; null texts count as empty and have no ids."""
    content = read_vocab(vocab_path)

    def make():
        codec = Codec(content)
        return lambda texts: {"ids": codec.encode(texts)}

    return map_texts(id_and_text(df, id_col, text_col), make, [("ids", "array<int>")])


def decode_documents(df: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row for each row of df: doc_id, text. Null ids give an empty text; bytes that are no UTF-8 become U+FFFD."""
    content = read_vocab(vocab_path)
    schema = f"doc_id {df.schema[id_col].dataType.simpleString()}, text string"

    def run(batches):
        codec = Codec(content)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return df.select(id_col, ids_col).mapInArrow(run, schema)


def bpe_digests(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, n_tokens, ids_sha256, decoded_sha256 of the whole text encoded and decoded again.

    A map without a shuffle. The trie's nodes are visited in sorted order of the words, which is depth first, a level of states at a time, so
    that array operations serve all words of a batch. Null and empty texts have no tokens. A text of any length is encoded whole; a
    word longer than the trie takes is merged on its own, with equal results. Of equal merges the leftmost comes first. Repeated rows
    give repeated results; a null id stays null; an empty table gives no rows; other columns of df, also ones named as results
    are, play no part.
    """
    content = read_vocab(vocab_path)

    def make():
        codec = Codec(content)

        def f(texts: list[str]) -> dict[str, list]:
            rows = codec.digests(texts)
            return {n: [r[i] for r in rows] for i, n in enumerate(("n_tokens", "ids_sha256", "decoded_sha256"))}

        return f

    return map_texts(id_and_text(df, id_col, text_col), make, [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")])
