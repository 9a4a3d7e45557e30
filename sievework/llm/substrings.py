"""Exact removal of long strings that an earlier document holds, by sorting the suffixes at content-defined places."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import id_and_text, if_small
from sievework.llm.deep_shallow import deep_shallow
from sievework.llm.near_duplicates import in_groups
from sievework.session import cut

LENGTH = 50  # bytes of a string whose repetition counts
SEED = 16  # bytes of the seed by which a string is filed: its seed of least hash, the leftmost of such
BLOCK_BYTES = 16_000_000  # text of a block that one step of a task holds
BUCKET_BYTES = 16_000_000  # text whose seeds and contexts one bucket takes on average
CHUNK = 500_000  # strings sorted at a time
HOT = 20_000  # places of a seed in all documents, from which on its strings are dealt to buckets one by one
SEND_BYTES = 8_000_000  # of packed rows handed on at once
STEP = 1 << 22  # windows of a text hashed at a time

_PLACE = np.uint64((1 << 24) - 1)
_BYTES = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def seed_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k bytes in a row, by doubling; k is a power of two."""
    h, step = _BYTES[b], 1
    while step < k:
        left = h[:-step]
        h = (left * _M1 ^ (left >> np.uint64(29))) + h[step:]
        step *= 2
    h = h * _M2
    return h ^ (h >> np.uint64(32))


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    m, step = h, 1
    while 2 * step <= w:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    n = len(h) - w + 1
    return np.minimum(m[:n], m[w - step : w - step + n]) if step < w else m


def anchors(b: np.ndarray, length: int = LENGTH, k: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a text its seeds that file strings: hash, first string's start, number of strings (a run of neighbours).

    Which seed files a string depends on the string alone, so equal strings meet under one hash, at one offset from the seed.
    """
    hs, los, ns = [], [], []
    w = length - k + 1
    for at in range(0, len(b) - length + 1, STEP):
        part = b[at : at + STEP + length - 1]
        h = seed_hashes(part, k)
        least = sliding_min((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), w)
        where = (least & _PLACE).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        hs.append(h[where[begin]])
        los.append(begin + at)
        ns.append(np.diff(np.append(begin, len(where))))
    if not hs:
        none = np.empty(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    return np.concatenate(hs), np.concatenate(los), np.concatenate(ns)


class Block:
    """The documents of a block, unpacked: ids (with null flags), the bytes one after the other, and the anchors of all.

    Anchors: hash, lo (in the block), n, doc (number in the block); seeds: the distinct hashes, with which the place of each.
    """

    def __init__(self, row: dict, buckets: int):
        self.buckets = np.uint64(buckets)
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.null = np.frombuffer(row["nulls"], dtype=np.uint8).astype(bool)
        self.sizes = np.frombuffer(row["sizes"], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.sizes)])
        self.raw = zstandard.ZstdDecompressor().decompress(row["packed"], max_output_size=max(1, int(self.start[-1])))
        self.bytes = np.frombuffer(self.raw, dtype=np.uint8)
        kept = zstandard.ZstdDecompressor().decompress(row["anchors"], max_output_size=21 * row["n_anchors"] + 1)
        m = row["n_anchors"]
        part = lambda t, at: np.frombuffer(kept, dtype=t, offset=at * m, count=m)
        self.hash, self.lo, self.doc, self.n = part(np.uint64, 0), part(np.int64, 8), part(np.int32, 16).astype(np.int64), part(np.uint8, 20).astype(np.int64)
        self.seeds, self.which = np.unique(self.hash, return_inverse=True)

    def text(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.start[i + 1]]

    def seed_rows(self) -> Iterator[dict]:
        """By bucket the block's seeds in it, and its documents in it by their text's hash. A row for each bucket at most, and at most as many as there are seeds.

        Seeds are packed as nine bytes: the hash, and a flag (in two documents of the block) with the logarithm of the number of places.
        """
        least = np.full(len(self.seeds), np.iinfo(np.int64).max)
        most = np.full(len(self.seeds), np.iinfo(np.int64).min)
        np.minimum.at(least, self.which, self.ids[self.doc])
        np.maximum.at(most, self.which, self.ids[self.doc])
        places = np.minimum(127, 8 * np.log2(np.bincount(self.which, minlength=len(self.seeds)) + 1e-9)).astype(np.uint8)
        flags = places | ((least < most).astype(np.uint8) << 7)
        to = (self.seeds % self.buckets).astype(np.int64)
        digests = np.array([[int.from_bytes((d := xxhash.xxh3_128_digest(self.text(i)))[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), self.ids[i], i] for i in np.flatnonzero(~self.null & (self.sizes >= LENGTH))], dtype=np.int64).reshape(-1, 4)
        doc_to = (digests[:, 0].view(np.uint64) % self.buckets).astype(np.int64) if len(digests) else np.empty(0, dtype=np.int64)
        order, doc_order = np.argsort(to, kind="stable"), np.argsort(doc_to, kind="stable")
        used = np.union1d(to, doc_to)
        packed = np.empty((len(order), 9), dtype=np.uint8)
        packed[:, :8] = self.seeds[order][:, None].view(np.uint8).reshape(-1, 8)
        packed[:, 8] = flags[order]
        ends = lambda x: np.searchsorted(x, np.append(used, np.iinfo(np.int64).max))
        yield from packed_rows({"bucket": used}, {"seeds": (packed, ends(to[order])), "docs": (digests[doc_order], ends(doc_to[doc_order]))})

    def choose(self, shared: list[dict]) -> None:
        """Take in which seeds are shared or hot, and which documents are copies; then gather the contexts of shared seeds in other documents.

        A context is the run of bytes that a seed's strings cover. Equal ones of the block are one record, under its smallest id. What
        is sent: the contexts of most seeds, and of hot ones their single strings, each filed by its own hash.
        """
        alive = np.zeros(len(self.seeds), dtype=bool)
        hot = np.zeros(len(self.seeds), dtype=bool)
        self.copy = np.zeros(len(self.ids), dtype=bool)
        to = (self.seeds % self.buckets).astype(np.int64)
        order = np.argsort(to, kind="stable")
        ordered = to[order]
        for s in shared:
            own = order[np.searchsorted(ordered, s["bucket"]) : np.searchsorted(ordered, s["bucket"], "right")]
            bits = np.unpackbits(np.frombuffer(s["bits"], dtype=np.uint8), count=2 * len(own)).astype(bool)
            alive[own], hot[own] = bits[: len(own)], bits[len(own) :]
            self.copy[np.frombuffer(s["copies"], dtype=np.int64)] = True
        take = np.flatnonzero(alive[self.which] & ~self.copy[self.doc]) if len(self.hash) else np.empty(0, dtype=np.int64)
        self.at_lo, self.at_n, self.at_doc = self.lo[take], self.n[take], self.doc[take]
        at_hash = self.hash[take]
        texts = contexts(self.bytes, self.at_lo, self.at_n)
        firsts, self.at_record = distinct(at_hash, self.at_n, texts)
        rec_hash, self.rec_n, rec_text = at_hash[firsts], self.at_n[firsts], texts[firsts]
        self.rec_id = np.full(len(firsts), np.iinfo(np.int64).max)
        np.minimum.at(self.rec_id, self.at_record, self.ids[self.at_doc])
        self.rec_hot = hot[self.which[take]][firsts]
        cold, warm = np.flatnonzero(~self.rec_hot), np.flatnonzero(self.rec_hot)
        self.str_rec = np.repeat(warm, self.rec_n[warm])
        count = self.rec_n[warm]
        self.str_off = np.arange(len(self.str_rec)) - np.repeat(np.cumsum(count) - count, count)
        strings = np.zeros((len(self.str_rec), WIDTH), dtype=np.uint8)
        reach = np.arange(LENGTH)
        for at in range(0, len(strings), 100_000):
            part = slice(at, at + 100_000)
            strings[part, :LENGTH] = rec_text[self.str_rec[part][:, None], self.str_off[part][:, None] + reach]
        str_hash = mixed(rec_hash[self.str_rec], strings)
        first, self.str_sent = distinct(str_hash, np.ones(len(str_hash), dtype=np.int64), strings)
        str_id = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(str_id, self.str_sent, self.rec_id[self.str_rec])
        # what is sent, in order of buckets
        h = np.concatenate([rec_hash[cold], str_hash[first]])
        by = np.argsort(h % self.buckets, kind="stable")
        self.place = np.empty(len(by), dtype=np.int64)
        self.place[by] = np.arange(len(by))
        self.cold = cold
        self.sent_hash, self.sent_id = h[by], np.concatenate([self.rec_id[cold], str_id])[by]
        self.sent_n = np.concatenate([self.rec_n[cold], np.ones(len(first), dtype=np.int64)])[by]
        self.sent_text = np.concatenate([rec_text[cold], strings[first]])[by]
        self.sent_bucket = (self.sent_hash % self.buckets).astype(np.int64)

    def context_rows(self) -> Iterator[dict]:
        """By bucket the records sent to it: hash, id, number of strings, bytes."""
        used = np.unique(self.sent_bucket)
        ends = np.searchsorted(self.sent_bucket, np.append(used, np.iinfo(np.int64).max))
        packed = np.concatenate([self.sent_hash[:, None].view(np.uint8).reshape(-1, 8), self.sent_id[:, None].view(np.uint8).reshape(-1, 8), self.sent_n[:, None].astype(np.uint8), self.sent_text], axis=1)
        yield from packed_rows({"bucket": used}, {"records": (packed, ends)})

    def removed(self, answers: list[dict]) -> Iterator[tuple[int, np.ndarray]]:
        """Of each document the limits (start, end) of its removed runs, as (m, 2)."""
        got = np.zeros(len(self.sent_hash), dtype=np.uint64)
        z = zstandard.ZstdDecompressor()
        for a in answers:
            own = slice(np.searchsorted(self.sent_bucket, a["bucket"]), np.searchsorted(self.sent_bucket, a["bucket"], "right"))
            got[own] = np.frombuffer(z.decompress(a["masks"]), dtype=np.uint64)
        masks = np.zeros(len(self.rec_id), dtype=np.uint64)
        masks[self.cold] = got[self.place[: len(self.cold)]]
        sent = self.place[len(self.cold) + self.str_sent]
        early = (got[sent] != 0) | (self.rec_id[self.str_rec] > self.sent_id[sent])
        np.bitwise_or.at(masks, self.str_rec[early], np.uint64(1) << self.str_off[early].astype(np.uint64))
        mask = np.where(self.ids[self.at_doc] > self.rec_id[self.at_record], np.uint64(2**64 - 1), masks[self.at_record])
        order = np.argsort(self.at_lo, kind="stable")
        doc, lo, n, mask = self.at_doc[order], self.at_lo[order], self.at_n[order], mask[order]
        limits = np.searchsorted(doc, np.arange(len(self.ids) + 1))
        for i in range(len(self.ids)):
            size = int(self.sizes[i])
            if self.copy[i]:
                yield i, np.array([[0, size]])
                continue
            own = slice(limits[i], limits[i + 1])
            gone = mask[own] != 0
            edge = np.zeros(size + 1, dtype=np.int32)
            for a, c, m in zip((lo[own][gone] - self.start[i]).tolist(), n[own][gone].tolist(), mask[own][gone].tolist()):
                if m & ((1 << c) - 1) == (1 << c) - 1:
                    edge[a] += 1
                    edge[a + c + LENGTH - 1] -= 1
                else:
                    for j in range(c):
                        if m >> j & 1:
                            edge[a + j] += 1
                            edge[a + j + LENGTH] -= 1
            if not gone.any():
                yield i, np.empty((0, 2), dtype=np.int64)
                continue
            inside = np.cumsum(edge[:-1]) > 0
            turn = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
            yield i, turn.reshape(-1, 2)


WIDTH = -(-(2 * LENGTH - SEED) // 8) * 8  # a context's bytes, padded to whole words
STRING = -(-LENGTH // 8) * 8


def mixed(seed: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """A hash of each seed and row of bytes."""
    out = seed.copy()
    words = texts.view(np.uint64)
    for c in range(words.shape[1]):
        out = (out ^ words[:, c]) * _M1
        out ^= out >> np.uint64(29)
    return out


def distinct(seed: np.ndarray, n: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row of each distinct (seed, n, text), and of each row the number of its like. Rows are compared as bytes; the hash only orders them."""
    order = np.lexsort((mixed(seed, texts), seed))
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (seed[order[1:]] == seed[order[:-1]]) & (n[order[1:]] == n[order[:-1]]) & (texts[order[1:]] == texts[order[:-1]]).all(axis=1)
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(~same) - 1
    return order[~same], number


def packed_rows(keys: dict[str, np.ndarray], cols: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[dict]:
    """Rows of keys and binaries, in batches of bounded size: of each column its items, one after the other, and where each row's begin."""
    n = len(next(iter(keys.values())))
    weight = sum(ends[1:] * (items.shape[1] * items.itemsize) for items, ends in cols.values()) if n else np.empty(0)
    at = 0
    while at < n:
        before = weight[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(weight, before + SEND_BYTES)))
        out = {k: v[at:to] for k, v in keys.items()}
        for name, (items, ends) in cols.items():
            width = items.shape[1] * items.itemsize
            offsets = ((ends[at : to + 1] - ends[at]) * width).astype(np.int32)
            out[name] = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(items[ends[at] : ends[to]]).tobytes())])
        yield out
        at = to


def contexts(b: np.ndarray, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(len(lo), WIDTH) bytes from lo on, of n strings each; zeros behind."""
    out = np.zeros((len(lo), WIDTH), dtype=np.uint8)
    reach = np.arange(WIDTH)
    for at in range(0, len(lo), 100_000):
        part = slice(at, at + 100_000)
        inside = reach < (n[part] + LENGTH - 1)[:, None]
        out[part] = np.where(inside, b[np.minimum(lo[part, None] + reach, len(b) - 1)], 0)
    return out


def blocks_of(docs: DataFrame) -> DataFrame:
    """Documents packed into blocks: block (a number), raw (bytes), ids, nulls, sizes, packed, and the anchors of all documents, computed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        part = TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list[bytes] = []
        raw = made = 0

        def block() -> pa.RecordBatch:
            begin = np.cumsum([0, *(len(t) for t in texts)])
            found = [(i, anchors(np.frombuffer(t, dtype=np.uint8))) for i, t in enumerate(texts) if ids[i] is not None and len(t) >= LENGTH]
            cat = lambda x, t: np.concatenate(x).astype(t).tobytes() if x else b""
            m = sum(len(a[0]) for _, a in found)
            kept = cat([a[0] for _, a in found], np.uint64) + cat([a[1] + begin[i] for i, a in found], np.int64) + cat([np.full(len(a[0]), i) for i, a in found], np.int32) + cat([a[2] for _, a in found], np.uint8)
            return pa.RecordBatch.from_pydict({
                "block": [part + made], "raw": [raw], "ids": [np.array([x or 0 for x in ids], dtype=np.int64).tobytes()], "nulls": [bytes(x is None for x in ids)],
                "sizes": [np.array([len(t) for t in texts], dtype=np.int64).tobytes()], "packed": [z.compress(b"".join(texts))],
                "n_anchors": [m], "anchors": [z.compress(kept)],
            })

        for b in batches:
            for at in range(0, b.num_rows, 256):
                piece = b.slice(at, 256)
                for i, t in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                    ids.append(i)
                    texts.append(t.encode("utf-8", "replace"))
                    raw += len(texts[-1])
                    if raw >= BLOCK_BYTES:
                        yield block()
                        ids, texts, raw, made = [], [], 0, made + 1
        if ids:
            yield block()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "block long, raw long, ids binary, nulls binary, sizes binary, packed binary, n_anchors long, anchors binary")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def file_seeds(blocks: DataFrame, buckets: int) -> DataFrame:
    """block, bucket, bits, copies: which of the block's seeds another document has too, and which are hot; which of its documents repeat a smaller id's text."""

    def send(batches):
        for row in rows_of(batches):
            for part in Block(row, buckets).seed_rows():
                yield pa.RecordBatch.from_pydict({**part, "block": np.full(len(part["bucket"]), row["block"])})

    def meet(batches):
        for g in in_groups(batches, "bucket"):
            counts = np.array([len(s) // 9 for s in g["seeds"]], dtype=np.int64)
            packed = np.frombuffer(b"".join(g["seeds"]), dtype=np.uint8).reshape(-1, 9)
            hashes = np.ascontiguousarray(packed[:, :8]).view(np.uint64).ravel()
            alive = packed[:, 8] >> 7 > 0
            order = np.argsort(hashes, kind="stable")
            twin = hashes[order[1:]] == hashes[order[:-1]]
            alive[order[1:][twin]] = True
            alive[order[:-1][twin]] = True
            many, hot = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=bool)  # what one block tells of a hash holds in all
            if len(order):
                run = np.cumsum(np.concatenate([[True], ~twin])) - 1
                many[order] = np.bincount(run, weights=alive[order])[run] > 0
                hot[order] = np.bincount(run, weights=2.0 ** ((packed[order, 8] & 127) / 8))[run] >= HOT
            docs = [np.frombuffer(d, dtype=np.int64).reshape(-1, 4) for d in g["docs"]]
            whole = np.concatenate(docs)
            by = np.lexsort((whole[:, 2], whole[:, 1], whole[:, 0]))
            first = np.ones(len(by), dtype=bool)
            first[1:] = (whole[by[1:], :2] != whole[by[:-1], :2]).any(axis=1)
            copies = np.zeros(len(by), dtype=bool)
            if len(by):
                copies[by] = whole[by, 2] > whole[by[first], 2][np.cumsum(first) - 1]
            end, doc_end = np.cumsum(counts), np.cumsum([len(d) for d in docs])
            out = {"block": g["block"], "bucket": g["bucket"], "bits": [], "copies": []}
            for i in range(len(counts)):
                own, mine = slice(end[i] - counts[i], end[i]), slice(doc_end[i] - len(docs[i]), doc_end[i])
                out["bits"].append(np.packbits(np.concatenate([many[own], hot[own]])).tobytes())
                out["copies"].append(whole[mine][copies[mine], 3].tobytes())
            yield pa.RecordBatch.from_pydict(out)

    sent = blocks.mapInArrow(send, "bucket long, seeds binary, docs binary, block long")
    return sent.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(meet, "block long, bucket long, bits binary, copies binary")


def earlier_strings(hash_: np.ndarray, ids: np.ndarray, n: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Of each record a mask of its strings: bit j is set if the j-th string also is in a record with a smaller id.

    Equal records are one with their smallest id. Of seeds with several different records the strings are sorted, offset by
    offset of the seed's place; equal neighbours in the order share their smallest id.
    """
    full = np.uint64(2**64 - 1)
    if not len(hash_):
        return np.empty(0, dtype=np.uint64)
    order, leaf = deep_shallow(np.ascontiguousarray(np.concatenate([hash_[:, None].view(np.uint8).reshape(-1, 8), n[:, None].astype(np.uint64).view(np.uint8).reshape(-1, 8), texts], axis=1)))
    kind = np.empty(len(order), dtype=np.int64)
    kind[order] = leaf
    firsts = order[np.concatenate([[True], leaf[1:] != leaf[:-1]])]
    least = np.full(len(firsts), np.iinfo(np.int64).max)
    np.minimum.at(least, kind, ids)
    masks = np.zeros(len(firsts), dtype=np.uint64)
    h = hash_[firsts]
    by = np.argsort(h, kind="stable")
    run = np.cumsum(np.concatenate([[True], h[by[1:]] != h[by[:-1]]])) - 1
    mixed = by[np.bincount(run)[run] > 1]  # seeds with different records, seed by seed
    count = n[firsts[mixed]]
    at = 0
    while at < len(mixed):
        end = at + max(1, int(np.searchsorted(np.cumsum(count[at:]), CHUNK)))
        while end < len(mixed) and h[mixed[end]] == h[mixed[end - 1]]:
            end += 1
        part = mixed[at:end]
        at = end
        c = n[firsts[part]]
        owner = np.repeat(np.arange(len(part)), c)
        off = np.arange(len(owner)) - np.repeat(np.cumsum(c) - c, c)
        pieces = -(-len(owner) // (2 * CHUNK))
        if pieces == 1:
            _sort_strings(np.arange(len(owner)), owner, off, part, firsts, texts, least, h, masks)
            continue
        begins = np.concatenate([texts[firsts[part[owner[p]]][:, None], off[p][:, None] + np.arange(8)].view(np.uint64).ravel() for p in np.array_split(np.arange(len(owner)), pieces)])
        to = (begins * _M1 >> np.uint64(32)) % np.uint64(pieces)  # strings that begin alike stay together
        for k in range(pieces):
            _sort_strings(np.flatnonzero(to == k), owner, off, part, firsts, texts, least, h, masks)
    out = masks[kind]
    return np.where(ids > least[kind], full, out)


def _sort_strings(sel, owner, off, part, firsts, texts, least, h, masks) -> None:
    """Sort the strings sel of the records part, and set the masks' bits of those that a record with a smaller id has."""
    if not len(sel):
        return
    rec = part[owner[sel]]
    strings = np.zeros((len(sel), 8 + STRING), dtype=np.uint8)
    strings[:, :8] = h[rec][:, None].view(np.uint8).reshape(-1, 8)
    reach = np.arange(LENGTH)
    for at in range(0, len(sel), 100_000):
        p = slice(at, at + 100_000)
        strings[p, 8 : 8 + LENGTH] = texts[firsts[rec[p]][:, None], off[sel[p]][:, None] + reach]
    order, leaf = deep_shallow(strings, 24)
    best = np.full(leaf[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(best, leaf, least[rec[order]])
    early = np.zeros(len(sel), dtype=bool)
    early[order] = best[leaf] < least[rec[order]]
    np.bitwise_or.at(masks, rec[early], np.uint64(1) << off[sel[early]].astype(np.uint64))


def sort_contexts(blocks: DataFrame, shared: DataFrame, buckets: int) -> DataFrame:
    """block, bucket, masks: of the block's records in the bucket, which strings a smaller id has."""

    def send(batches):
        z = zstandard.ZstdCompressor(level=1)
        for row in rows_of(batches):
            block = Block(row, buckets)
            block.choose(row["shared"] or [])
            for part in block.context_rows():
                part["records"] = pa.array([z.compress(r) for r in part["records"].to_pylist()], pa.binary())
                yield pa.RecordBatch.from_pydict({**part, "block": np.full(len(part["bucket"]), row["block"])})

    def meet(batches):
        z, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        for g in in_groups(batches, "bucket"):
            raw = [z.decompress(r) for r in g["records"]]
            counts = [len(r) // (17 + WIDTH) for r in raw]
            all_ = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(-1, 17 + WIDTH)
            col = lambda a, b, t: np.ascontiguousarray(all_[:, a:b]).view(t).ravel()
            masks = earlier_strings(col(0, 8, np.uint64), col(8, 16, np.int64), all_[:, 16].astype(np.int64), np.ascontiguousarray(all_[:, 17:]))
            end = np.cumsum(counts)
            packed = [pack.compress(masks[e - c : e].tobytes()) for c, e in zip(counts, end)]
            yield pa.RecordBatch.from_pydict({"block": g["block"], "bucket": g["bucket"], "masks": packed})

    sent = with_lists(blocks, shared, "shared").mapInArrow(send, "bucket long, records binary, block long")
    return sent.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(meet, "block long, bucket long, masks binary")


def with_lists(blocks: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """blocks with the rows of each as an array; a block has one for each bucket at most."""
    fields = [c for c in rows.columns if c != "block"]
    lists = rows.groupBy("block").agg(F.collect_list(F.struct(*fields)).alias(name))
    size = sum((F.octet_length(f) for f in fields if f != "bucket"), F.lit(50))
    total = F.aggregate(F.transform(F.col(name), lambda x: sum((F.octet_length(x[f]) for f in fields if f != "bucket"), F.lit(50))), F.lit(0).cast("long"), lambda a, x: a + x) if size is not None else None
    return blocks.join(if_small(lists, total), "block", "left")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row for each row of df: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with_text: kept (binary) and spans.

    Bytes are removed that any 50-byte string covers which also starts in a document with a smaller doc_id. Strings are filed
    by their seed; seeds of one document only are dropped first, then the strings of the rest meet by seed and are put in
    order by deep-shallow sorting, where equal strings are neighbours.

    What is exchanged grows with the input: a block of documents sends each of its distinct seeds once, in a row for each bucket
    at most, and of shared seeds their distinct contexts; strings of a seed with HOT places or more are dealt one by one, so that no
    task takes all of them. Whole copies of a document are told by 128-bit hashes; all other strings are compared as bytes.

    Ids must be integers. Null texts are empty; texts under 50 bytes lose nothing. A text longer than a block is a block of its own, held
    whole by one task. Rows with one doc_id are one document, so they take nothing from each other; repeated rows give repeated
    results; of equal strings the smallest doc_id keeps its own. Rows with a null id neither lose nor take bytes. An empty table
    gives no rows; other columns of df, whatever their names, play no part.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    blocks = cut(blocks_of(id_and_text(df, id_col, text_col)))
    raw = blocks.agg(F.sum("raw").alias("b")).first()["b"] or 0
    buckets = max(1, -(-raw // BUCKET_BYTES))
    shared = cut(file_seeds(blocks, buckets))
    masks = cut(sort_contexts(blocks, shared, buckets))

    def finish(batches):
        for row in rows_of(batches):
            block = Block(row, buckets)
            block.choose(row["shared"] or [])
            out: dict[str, list] = {n: [] for n in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
            for i, spans in block.removed(row["masks"] or []):
                text = block.text(i)
                ends = np.concatenate([[0], spans.ravel(), [len(text)]]).tolist()
                kept = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2]))
                for n, v in zip(out, (None if block.null[i] else int(block.ids[i]), len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans.tolist() if with_text else None, kept if with_text else None)):
                    out[n].append(v)
            for at in range(0, len(out["doc_id"]), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(out[n][at : at + 2000], t) for n, t in zip(out, types)], names=list(out))

    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.binary()]
    done = with_lists(with_lists(blocks, shared, "shared"), masks, "masks").mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<bigint>>, kept binary")
    cols = [F.col("doc_id").cast(id_type).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return done.select(*cols, *(["spans", "kept"] if with_text else []))
