"""Suffix-array dedup against brute force."""

import hashlib
import random

import numpy as np

from sievework.llm import substrings
from sievework.llm import deep_shallow as sorting
from sievework.llm.deep_shallow import deep_shallow


def brute(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is None:
            continue
        for p in range(len(b) - length + 1):
            k = b[p : p + length]
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1 if i is not None else 0):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "on", "é", "a", "st", "ing"]) for _ in range(rng.randint(1, 3)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            k = rng.random()
            if k < 0.4:
                parts.append(rng.choice(passages))
            elif k < 0.5:
                parts.append("ab " * rng.randint(10, 60))
            elif k < 0.6 and rows:
                t = rng.choice(rows)[1] or ""
                a = rng.randint(0, max(0, len(t) - 1))
                parts.append(t[a : a + rng.randint(30, 300)])
            else:
                parts.append(" ".join(word() for _ in range(rng.randint(1, 60))))
        rows.append((rng.randint(0, 10**6) if rng.random() < 0.9 else (rows[-1][0] if rows else 7), " ".join(parts)))
    return rows + [(5, None), (None, rows[0][1]), (6, ""), rows[3], rows[4], (10**7, rows[5][1]), (10**7 + 1, rows[5][1])]


def test_against_brute_force(spark, monkeypatch):
    for seed, hot in ((0, 20_000), (1, 3), (2, 1)):  # seeds that are hot, in no, some and all cases
        monkeypatch.setattr(substrings, "HOT", hot)
        monkeypatch.setattr(substrings, "BLOCK_BYTES", 4000)
        monkeypatch.setattr(substrings, "BUCKET_BYTES", 9000)
        rows = corpus(seed)
        df = spark.createDataFrame([(t, i, "x", 1) for i, t in rows], "text string, doc_id long, n_bytes string, block int").repartition(3)
        got = sorted((tuple(r) for r in substrings.remove_repeats(df).collect()), key=str)
        assert got == sorted(brute(rows), key=str)


def test_rows_sent_are_bounded(monkeypatch):
    """A block sends each distinct seed once, in at most as many rows as it has seeds, however many buckets there are; batches are bounded."""
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(3000)).encode() for _ in range(20)]
    z = substrings.zstandard.ZstdCompressor()
    found = [substrings.anchors(np.frombuffer(t, dtype=np.uint8)) for t in texts]
    kept = np.concatenate([a[0] for a in found]).tobytes() + np.concatenate([a[1] + 3000 * i for i, a in enumerate(found)]).astype(np.int64).tobytes()
    kept += np.concatenate([np.full(len(a[0]), i) for i, a in enumerate(found)]).astype(np.int32).tobytes() + np.concatenate([a[2] for a in found]).astype(np.uint8).tobytes()
    row = {"ids": np.arange(20).tobytes(), "nulls": bytes(20), "sizes": np.full(20, 3000).tobytes(), "packed": z.compress(b"".join(texts)), "anchors": z.compress(kept), "n_anchors": sum(len(a[0]) for a in found)}
    monkeypatch.setattr(substrings, "SEND_BYTES", 2000)
    for buckets in (1, 7, 1000, 10**9, 10**15):
        block = substrings.Block(row, buckets)
        parts = list(block.seed_rows())
        rows = [(b, s) for p in parts for b, s in zip(p["bucket"].tolist(), p["seeds"].to_pylist())]
        assert len(rows) <= min(buckets, len(block.seeds) + 20) and len({b for b, _ in rows}) == len(rows)
        got = np.frombuffer(b"".join(s for _, s in rows), dtype=np.uint8).reshape(-1, 9)
        assert sorted(np.ascontiguousarray(got[:, :8]).view(np.uint64).ravel().tolist()) == block.seeds.tolist()
        assert all(sum(map(len, p["seeds"].to_pylist())) <= 2000 or len(p["bucket"]) == 1 for p in parts)
        assert all(int(h) % buckets == b for b, s in rows for h in np.ascontiguousarray(np.frombuffer(s, dtype=np.uint8).reshape(-1, 9)[:, :8]).view(np.uint64).ravel())


def test_chunks_give_the_same(monkeypatch):
    rng = np.random.default_rng(1)
    texts = rng.integers(97, 99, (400, substrings.WIDTH), dtype=np.uint8)
    texts[200:] = texts[:200]
    texts[200:, 70:] = 0
    n = np.where(np.arange(400) < 200, 35, 21)
    ids, hash_ = rng.integers(0, 300, 400), rng.integers(0, 3, 400).astype(np.uint64)
    hash_[200:] = hash_[:200]
    whole = substrings.earlier_strings(hash_, ids, n, texts)
    monkeypatch.setattr(substrings, "CHUNK", 100)
    assert (substrings.earlier_strings(hash_, ids, n, texts) == whole).all() and whole.any()


def test_sorting_order_and_leaves(monkeypatch):
    rng = np.random.default_rng(0)
    for shallow, small in ((0, 1024), (8, 1024), (16, 1024), (8, 1), (16, 1), (24, 7)):
        monkeypatch.setattr(sorting, "SMALL", small)
        s = rng.integers(97, 99, (500, 24), dtype=np.uint8)
        s[:, :14] = 97
        s[rng.integers(0, 500, 200)] = s[rng.integers(0, 500, 200)]
        order, leaf = deep_shallow(s, shallow)
        rows = [bytes(x) for x in s]
        assert [rows[i] for i in order] == sorted(rows)
        assert [a == b for a, b in zip(leaf[1:], leaf)] == [rows[a] == rows[b] for a, b in zip(order[1:], order)]


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
