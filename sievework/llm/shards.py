"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly, groups of equal texts kept together where small."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import id_and_text
from sievework.session import cut

#: Rows that a cell, packed in one task, has on average; cells at most; groups split for their rows alone at most.
CELL_ROWS, MAX_CELLS, MAX_SPLIT = 4096, 4096, 65_536
#: A group of more than 1/WHOLE of a shard's rows or bytes is split, for its rows only beyond LEAST_SPLIT of them.
WHOLE, LEAST_SPLIT = 4, 8
#: What evening out the bytes may cost the other dimensions, as a share of a shard; bins tried around the one that would fit best.
TOLERANCE, NEAR = 0.005, 8


def slim(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), text_crc32, tokens (runs without white space), and a 128-bit key of the text."""
    t = F.col("text")
    return id_and_text(df, id_col, text_col).select(
        "doc_id",
        (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.regexp_count(t, F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long").alias("tokens"),
        F.xxhash64(t).alias("k1"),
        F.xxhash64(F.lit(1), t).alias("k2"),
    )


def place(weights: np.ndarray, capacity: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item. Items, largest share first, go where the dot product of their weights with the residual capacity is highest.

    weights: (items, dimensions) in shares of the whole; capacity: a shard's room in each dimension. Ties go to the lowest shard.
    """
    residual = np.tile(capacity, (shards, 1))
    out = np.zeros(len(weights), dtype=np.int64)
    order = np.lexsort((np.arange(len(weights)), -weights.max(axis=1))) if len(weights) else []
    for i in order:
        s = int(np.argmax(residual @ weights[i]))
        out[i] = s
        residual[s] -= weights[i]
    return out


def assign_shards(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Groups are rows of equal texts. A group with more than 1/WHOLE of a shard's rows or bytes, or with more rows than a cell has
    room for, is split by doc_id into parts of about half that; others are placed whole. Groups and parts are dealt by hash to cells of about CELL_ROWS rows; each cell packs its groups into
    as many bins as there are shards; then the bins, at most MAX_CELLS * shards of them, are packed into the shards, the
    bins of a cell into different ones where the byte sums allow. Slots count a shard's rows from 0 without gaps, by cell,
    then doc_id (ties by the text's key). At last bins are moved to even out the bytes, as far as tokens and rows stay balanced.

    Null texts have size 1 and form the group of empty texts. A text larger than a shard's share fills a shard beyond it, as it can't be
    split; only a text's size and hashes leave its row. Repeated rows are rows of their own; a null id is kept; of equal residual
    products the lowest shard wins; an empty table gives no rows; other columns of df, whatever their names, play no part.
    """
    spark = df.sparkSession
    rows = cut(slim(df, id_col, text_col))
    total = rows.agg(F.count("*").alias("n"), F.sum("size").alias("b")).first()
    n, size = total["n"], total["b"] or 0
    cells = max(1, min(MAX_CELLS, n // CELL_ROWS))
    most = max(LEAST_SPLIT, min(n // (WHOLE * shards), max(CELL_ROWS, n // MAX_SPLIT)))
    heavy = size // (WHOLE * shards)
    groups = rows.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.sum("size").alias("b")).where((F.col("n") > most) | ((F.col("n") > 1) & (F.col("b") > heavy)))
    hot = groups.select("k1", "k2", F.least("n", F.ceil(F.greatest(2 * F.col("n") / most, 2 * F.col("b") / max(1, heavy)))).alias("parts"))
    # at most 2 * WHOLE * shards + MAX_SPLIT rows by the condition above
    hot = cut(hot)
    salted = rows.join(F.broadcast(hot), ["k1", "k2"], "left").withColumn("salt", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("parts"))).otherwise(F.lit(0).cast("long")))
    dealt = salted.withColumn("cell", F.pmod(F.xxhash64("k1", "k2", "salt"), F.lit(cells)).cast("int")).select("cell", "doc_id", "size", "text_crc32", "tokens", "k1", "k2", "salt")

    def pack(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["doc_id", "k1", "k2"], na_position="first", kind="stable")
        groups = cell.groupby(["k1", "k2", "salt"], sort=True)
        sums = groups.agg(size=("size", "sum"), tokens=("tokens", "sum"), rows=("size", "size"))
        w = sums.to_numpy(dtype=float)
        w /= np.maximum(w.sum(axis=0), 1)
        shard = place(w, np.full(3, 1 / shards), shards)[groups.ngroup().to_numpy()]
        return cell[["cell", "doc_id", "size", "text_crc32", "tokens"]].assign(bin=shard.astype("int32"))

    id_type = rows.schema["doc_id"].dataType.simpleString()
    binned = cut(dealt.groupBy("cell").applyInPandas(pack, f"cell int, doc_id {id_type}, size long, text_crc32 long, tokens long, bin int"))
    bins = binned.groupBy("cell", "bin").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n")).orderBy("cell", "bin").collect()  # at most MAX_CELLS * shards rows
    w = np.array([[r["b"], r["t"], r["n"]] for r in bins], dtype=float).reshape(-1, 3)
    shard = settle(w, place(w / np.maximum(w.sum(axis=0), 1), np.full(3, 1 / shards), shards), shards)
    offset, ends = [], [0] * shards
    for r, s in zip(bins, shard):
        offset.append((r["cell"], r["bin"], int(s), ends[s]))
        ends[s] += r["n"]
    where = spark.createDataFrame(offset, "cell int, bin int, shard int, first long")
    order = Window.partitionBy("cell", "bin").orderBy("doc_id", "text_crc32", "size")
    return binned.join(F.broadcast(where), ["cell", "bin"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.row_number().over(order) - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def settle(w: np.ndarray, shard: np.ndarray, shards: int) -> np.ndarray:
    """Bins moved or swapped between the fullest and the emptiest shard as long as that brings their bytes nearer.

    A move passes only if in no other dimension a shard's distance from the mean grows beyond both TOLERANCE of the mean and
    the largest distance that the packing left there: the packing's balance of tokens and rows stays.
    """
    if not len(w):
        return shard
    shard = shard.copy()
    sums = np.stack([np.bincount(shard, weights=w[:, k], minlength=shards) for k in range(w.shape[1])], axis=1)
    mean = sums.mean(axis=0)
    room = np.maximum(np.abs(sums - mean).max(axis=0), TOLERANCE * mean)
    for _ in range(40 * shards):
        hi, lo = int(sums[:, 0].argmax()), int(sums[:, 0].argmin())
        gap = sums[hi, 0] - sums[lo, 0]
        gives = np.flatnonzero(shard == hi)
        gives = gives[np.argsort(w[gives, 0], kind="stable")]
        takes = np.concatenate([[-1], np.flatnonzero(shard == lo)])
        back = np.where(takes[:, None] >= 0, w[np.maximum(takes, 0)], 0.0)
        at = np.searchsorted(w[gives, 0], back[:, 0] + gap / 2)
        # of each bin that may come back (or none) the bins nearest to what would close the gap
        near = np.clip(at[:, None] + np.arange(-NEAR, NEAR), 0, len(gives) - 1)
        moved = w[gives[near]] - back[:, None, :]
        left = np.abs(gap - 2 * moved[:, :, 0])
        fits = ((np.abs(sums[hi] - moved - mean) <= room) & (np.abs(sums[lo] + moved - mean) <= room))[:, :, 1:].all(axis=2)
        left = np.where(fits, left, np.inf)
        k, j = np.unravel_index(int(left.argmin()), left.shape)
        if left[k, j] >= gap:
            break
        shard[gives[near[k, j]]] = lo
        if takes[k] >= 0:
            shard[takes[k]] = hi
        sums[hi] -= moved[k, j]
        sums[lo] += moved[k, j]
    return shard
