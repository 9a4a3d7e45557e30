"""Groups of equal texts in the sharding."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import shards
from sievework.session import table


def test_small_groups_stay_whole(spark):
    """Pairs of copies in a small table, and a group of some dozens in a larger one, are placed as one."""
    for n, copies in ((300, 2), (4000, 40)):
        texts = [f"text {i // copies} " + "x" * 50 for i in range(n // 4)] + [f"only {i} " + "y" * 50 for i in range(n - n // 4)]
        rows = shards.assign_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
        where = collections.defaultdict(set)
        for r in rows:
            where[texts[r["doc_id"]]].add(r["shard"])
        assert len(rows) == n and all(len(s) == 1 for s in where.values())
        sizes = collections.Counter(r["shard"] for r in rows)
        assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) < 0.3 * n / 16


def test_place_against_brute_force():
    """Largest share first, each to the shard whose residual capacity has the highest dot product with it."""
    rng = np.random.default_rng(3)
    for n in (0, 1, 50):
        w = np.round(rng.random((n, 3)), 1) / max(1, n)
        residual = [[0.25] * 3 for _ in range(4)]
        want = [0] * n
        for i in sorted(range(n), key=lambda i: (-max(w[i]), i)):
            s = max(range(4), key=lambda s: (sum(a * b for a, b in zip(residual[s], w[i])), -s))
            want[i] = s
            residual[s] = [a - b for a, b in zip(residual[s], w[i])]
        got = shards.place(w, np.full(3, 0.25), 4)
        # sums in another order may turn a tie
        assert (got == np.array(want, dtype=int)).mean() > 0.9 if n else len(got) == 0


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_settling_keeps_the_balance_of_all(seed):
    """Bytes, tokens and rows that don't go together: evening out the bytes spoils neither of the others."""
    rng = np.random.default_rng(seed)
    w = rng.lognormal(0, 0.8, (400, 3)) * [1000, 200, 10]
    placed = shards.place(w / w.sum(axis=0), np.full(3, 1 / 16), 16)
    off = lambda s: np.array([(b := np.bincount(s, weights=w[:, k], minlength=16)).max() / b.mean() - 1 for k in range(3)])
    before, after = off(placed), off(shards.settle(w, placed, 16))
    assert after[0] <= before[0] and (after[1:] <= np.maximum(before[1:], shards.TOLERANCE) + 0.03).all() and after.max() < 0.05
    spread = lambda s: np.abs(np.bincount(s, weights=w[:, 1], minlength=16) / (w[:, 1].sum() / 16) - 1).max()
    assert spread(shards.settle(w, placed, 16)) <= max(spread(placed), shards.TOLERANCE) + 1e-9


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_equal_texts_share_a_shard(spark, sf):
    docs = table(spark, f"/root/testdata/{sf}", "documents")
    got = shards.assign_shards(docs).join(docs.select("doc_id", "text"), "doc_id")
    groups = got.groupBy("text").agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.countDistinct("shard").alias("shards"))
    total = got.agg(F.count("*").alias("n"), F.sum("size").alias("b")).first()
    most = max(shards.LEAST_SPLIT, total["n"] // (shards.WHOLE * 16))
    whole = groups.where((F.col("n") <= most) & ((F.col("n") == 1) | (F.col("b") <= total["b"] // (shards.WHOLE * 16))))
    assert whole.where("n > 1").count() > 10 and whole.where("shards > 1").count() == 0
    by = got.groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("t")).collect()
    for k, most in (("b", 0.01), ("n", 0.1 if sf == "sf0.01" else 0.02), ("t", 0.1 if sf == "sf0.01" else 0.02)):
        v = [r[k] for r in by]
        assert len(v) == 16 and max(v) / (sum(v) / 16) - 1 < most, (k, v)
