"""Quality classifier by compression: how much better a dictionary of good text helps than one of bad text."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import id_and_text, map_texts

#: Bounds of the fit: labelled rows of a class for its dictionary and for the calibration; bytes of a dictionary, and of one of its texts.
DICT_ROWS, CALIBRATION_ROWS, DICT_BYTES, TEXT_BYTES = 2000, 2000, 500_000, 10_000
LEVEL = 6
SEGMENT = 32_768  # bytes compressed at once, each time anew with the whole dictionary, so that it weighs the same throughout a long text
SHRINK = 100  # bytes added to a text's size, so that a few bytes weigh little in short texts


def held_out(id_col: Column) -> Column:
    """Rows that no fit may see; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    scale: float
    slope: float
    intercept: float

    def features(self):
        """A function of texts: (size with the bad dictionary - size with the good one) / (bytes + SHRINK), sizes summed over segments."""

        def compressor(content: bytes):
            if not content:
                return zstandard.ZstdCompressor(level=LEVEL)
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=d)

        good, bad = compressor(self.good), compressor(self.bad)

        def f(texts: list[str]) -> list[float]:
            out = []
            for t in texts:
                b = t.encode("utf-8", "replace")
                parts = [b[i : i + SEGMENT] for i in range(0, len(b), SEGMENT)]
                out.append(sum(len(bad.compress(s)) - len(good.compress(s)) for s in parts) / (len(b) + SHRINK))
            return out

        return f

    def score(self, x: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * math.asinh(x / self.scale) + self.intercept))))


def platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic regression on one feature, by Newton steps with a small ridge; the slope is not negative."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(g * x).sum() + 1e-3 * a, g.sum() + 1e-3 * b])
        hess = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-6), float(b)


def whole_rows(sizes: list[int], limit: int = DICT_BYTES, most: int = TEXT_BYTES) -> list[int]:
    """Which texts fill a dictionary: whole ones in the order given, of at most `most` bytes while there are such, then the shorter of the others."""
    order = [i for i, n in enumerate(sizes) if n <= most] + sorted((i for i, n in enumerate(sizes) if n > most), key=lambda i: (sizes[i], i))
    out, left = [], limit
    for i in order:
        if 0 < sizes[i] <= left:
            out.append(i)
            left -= sizes[i]
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on a bounded sample of labelled rows outside the held-out fold.

    Of each class the rows with the smallest hash of the id: at most DICT_ROWS for its dictionary and CALIBRATION_ROWS other
    ones for the calibration (of fewer rows, two thirds and one third), weighted to the classes' true counts. A dictionary takes whole
    texts until its DICT_BYTES are full, first those of at most TEXT_BYTES; texts are never cut. Only the sample's ids, the
    dictionaries and the calibration's features reach the driver.

    Rows with a null label or id are left out, and so are ids that labels contradict each other about; repeated labels count once. Of
    a repeated doc_id the text with the smallest hash is taken. Null and empty texts say nothing. With no labelled rows of a class its
    dictionary is empty, and the score is about the share of label 1 (one half if no labels or no documents). Further columns of
    both tables, whatever their names, play no part.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    ids = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("doc_id", "y")
    count = {r["y"]: r["n"] for r in ids.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = []
    for y in (0, 1):
        for_dict = min(DICT_ROWS, -(-2 * count.get(y, 0) // 3))
        rows = ids.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(DICT_ROWS + CALIBRATION_ROWS).collect()
        picked += [(r["doc_id"], y, i < for_dict, i) for i, r in enumerate(rows)]
    if not picked:
        return QualityModel(b"", b"", 1.0, 1e-6, 0.0)
    id_type = labels.schema[id_col].dataType.simpleString()
    sample = spark.createDataFrame(picked, f"doc_id {id_type}, y int, for_dict boolean, i int")  # at most 2 * (DICT_ROWS + CALIBRATION_ROWS) rows
    texts = id_and_text(docs, id_col, text_col)
    one = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y", "for_dict", "i").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"))).alias("t"))
    one = one.select("doc_id", "y", "for_dict", "i", "t.*").orderBy("i").collect()  # a row for each of the sample's ids at most
    chosen = [r for r in one if not r["for_dict"]]
    for y in (0, 1):
        rows = [r for r in one if r["for_dict"] and r["y"] == y]
        chosen += [rows[k] for k in whole_rows([r["n"] for r in rows])]
    if not chosen:
        return QualityModel(b"", b"", 1.0, 1e-6, 0.0)
    wanted = spark.createDataFrame([(r["doc_id"], r["y"], r["for_dict"], r["i"], r["h"]) for r in chosen], f"doc_id {id_type}, y int, for_dict boolean, i int, h long")
    rows = texts.join(F.broadcast(wanted), "doc_id").where(F.xxhash64("text") == F.col("h")).dropDuplicates(["doc_id"])
    pieces = rows.where("for_dict").select("y", "i", "text").orderBy("i").collect()  # at most 2 * DICT_BYTES
    by = {y: b"\n".join(r["text"].encode("utf-8", "replace") for r in pieces if r["y"] == y) for y in (0, 1)}
    rough = QualityModel(by[1], by[0], 1.0, 1.0, 0.0)
    rest = rows.where("not for_dict").select(F.struct("doc_id", "y").alias("doc_id"), "text")
    seen = [(r["x"], r["doc_id"]["y"]) for r in _features(rest, rough).collect()]
    x, y = np.array([s[0] for s in seen], dtype=float), np.array([s[1] for s in seen], dtype=float)
    if len(set(y.tolist())) < 2:
        share = (count.get(1, 0) + 1) / (sum(count.values()) + 2)
        return QualityModel(rough.good, rough.bad, 1.0, 1e-6, math.log(share / (1 - share)))
    scale = max(1e-4, float(np.median(np.abs(x))))
    weight = np.where(y == 1, count[1] / (y == 1).sum(), count[0] / (y == 0).sum()) * len(y) / (count[0] + count[1])
    slope, intercept = platt(np.arcsinh(x / scale), y, weight)
    return QualityModel(rough.good, rough.bad, scale, slope, intercept)


def _features(df: DataFrame, model: QualityModel) -> DataFrame:
    def make():
        f = model.features()
        return lambda texts: {"x": f(texts)}

    return map_texts(df, make, [("x", "double")])


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    A map without a shuffle; each whole text, however long, is compressed twice, in segments. Null texts count as empty; an empty text has
    the score of no difference. A score of exactly the threshold is predicted 1. Repeated rows give repeated results; a null id is kept
    and not held out; an empty table gives no rows; other columns, whatever their names, play no part.
    """

    def make():
        f = model.features()
        return lambda texts: {"score": [model.score(x) for x in f(texts)]}

    out = map_texts(id_and_text(docs, id_col, text_col), make, [("score", "double")])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
