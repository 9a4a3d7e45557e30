"""Quality rules in DataFrame operations only: fixed limits, and robust distances in each language and source."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.session import cut, stored

GRAM = 5
WHITE = r"[\x20\x09-\x0D]+"  # fixed pattern of what separates words
SYMBOLS = r"[#*$%&|<>]"  # fixed set of symbols
STRIPPED = " \t\n\x0b\x0c\r"


def statistics(df: DataFrame, *keep: str) -> DataFrame:
    """keep's columns with n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words of text.

    All within the row: nothing is shuffled. Grams are told apart by 64-bit hashes within one text.
    """
    t = F.col("text")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(STRIPPED)) != "")
    a = df.select(*keep, "text", F.array_remove(F.split(t, WHITE, -1), "").alias("w"), lines.alias("lines"))
    gram = lambda i: F.xxhash64(*(F.get(F.col("w"), i + k) for k in range(GRAM)))
    a = a.select(
        *keep,
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= GRAM, F.transform(F.sequence(F.lit(0), F.size("w") - GRAM), gram)).otherwise(F.array().cast("array<bigint>")).alias("g"),
    )
    some = F.size(F.array_distinct("g")) < F.size("g")
    a = a.withColumn("s", F.when(some, F.array_sort(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("s", lambda x, k: F.coalesce(F.get(F.col("s"), k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(F.col("s"), k + 1)["h"] == x["h"], F.lit(False)))
    a = a.withColumn("at", F.array_sort(F.transform(twice, lambda x: x["i"])))
    cover = F.aggregate("at", F.struct(F.lit(0).alias("c"), F.lit(-GRAM).alias("last")), lambda acc, i: F.struct((acc["c"] + F.least(F.lit(GRAM), i - acc["last"])).alias("c"), i.alias("last")), lambda acc: acc["c"].cast("long"))
    return a.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(cover, F.lit(0).cast("long")).alias("n_repeat_words"))


#: Feature -> least standard deviation, so that a feature that hardly varies doesn't reject small differences.
FEATURES = {"f_words": 1.0, "f_length": 0.08, "f_symbols": 0.03, "f_repeats": 0.04}
SHARE = 0.5  # of a group's rows that the estimate rests on: nearly half may be outliers
STARTS = 4  # first estimates: one by medians, the others by small subsets
SUBSET = 12  # rows of such a subset, on average; the least that spans the space is one more than there are features
STEPS = 3  # concentration steps of each start
LAST_STEPS = 2  # further steps of the start with the least determinant
TAIL = 1e-9  # share of a normal group that lies beyond the cutoff; far out, as the statistics of prose have longer tails than that
MIN_ROWS = 40  # smaller groups are judged by the estimate of their language, and in a language with fewer rows by that of all rows
BROADCAST_GROUPS = 100_000  # estimates of up to so many groups are broadcast, 200 bytes each
BINS = 1024  # histogram bins of a unit, for medians; of a doubling, an eighth of that


def chi2_cdf(x: float, df: int) -> float:
    """The regularised lower incomplete gamma function of df / 2 at x / 2, by its series."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 0.0
    if x > 700:
        return 1.0
    term = total = 1 / a
    n = a
    while term > total * 1e-17:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


def chi2_quantile(q: float, df: int) -> float:
    lo, hi = 0.0, 1400.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, df) < q else (lo, mid)
    return hi


def features(stats: DataFrame) -> DataFrame:
    """Transformed statistics: logarithms of the number of words and of their mean length, square root of the symbols' share, the larger of the shares of repeated words and of lines that repeat an earlier one."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return stats.withColumns({"f_words": F.log(n + 0.0), "f_length": F.log(chars / n), "f_symbols": F.sqrt(F.col("n_symbols") / chars), "f_repeats": F.greatest(F.col("n_repeat_words") / n, F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)))})


def with_estimates(rows: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(groups) if few else groups, "g")


def distance(rows: DataFrame, scale: float = 1.0) -> DataFrame:
    """d2: the squared Mahalanobis distance by the group's means m_i and Cholesky factors c_i_j, by forward substitution."""
    names = list(FEATURES)
    d2 = F.lit(0.0)
    for i, f in enumerate(names):
        rest = F.col(f) - F.col(f"m_{i}")
        for j in range(i):
            rest = rest - F.col(f"c_{i}_{j}") * F.col(f"z_{j}")
        rows = rows.select("*", (rest / F.col(f"c_{i}_{i}")).alias(f"z_{i}"))
        d2 = d2 + F.col(f"z_{i}") * F.col(f"z_{i}")
    return rows.select("*", (d2 / scale).alias("d2"))


def covariance(rows: DataFrame) -> DataFrame:
    """Of each g and start the means m_i, the Cholesky factors c_i_j of the covariance with the least variances added, and ld, the logarithm of its determinant."""
    names = list(FEATURES)
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    out = rows.groupBy("g", "start").agg(*(F.avg(f).alias(f"m_{i}") for i, f in enumerate(names)), *(F.covar_pop(names[i], names[j]).alias(f"s_{i}_{j}") for i, j in pairs))
    for j, f in enumerate(names):
        for i in range(j, len(names)):
            rest = F.col(f"s_{i}_{j}") + (FEATURES[f] ** 2 if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"c_{i}_{k}") * F.col(f"c_{j}_{k}")
            out = out.withColumn(f"c_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"c_{j}_{j}"))
    return with_determinant(out.select("g", "start", *(f"m_{i}" for i in range(len(names))), *(f"c_{i}_{j}" for i, j in pairs)))


def with_determinant(est: DataFrame) -> DataFrame:
    return est.withColumn("ld", sum((F.log(f"c_{i}_{i}") for i in range(1, len(FEATURES))), F.log("c_0_0")) * 2)


def quantile(rows: DataFrame, by: list[str], bin_: Column, q: float) -> DataFrame:
    """by's columns and at, the least bin up to which a share q of the rows lies.

    Counts of bins are merged from partial ones in any order with one result; a group has a bounded number of bins, however many rows.
    """
    counts = rows.groupBy(*by, bin_.alias("at")).agg(F.count("*").alias("n"))
    up = Window.partitionBy(*by).orderBy("at")
    summed = counts.withColumns({"below": F.sum("n").over(up), "all": F.sum("n").over(Window.partitionBy(*by))})
    return summed.where(F.col("below") >= q * F.col("all")).groupBy(*by).agg(F.min("at").alias("at"))


def medians(rows: DataFrame, values: list[Column]) -> DataFrame:
    """g and at_i, the median of each value, to 1 / BINS."""
    each = rows.select("g", F.posexplode(F.array(*values)).alias("i", "v"))
    at = quantile(each, ["g", "i"], F.floor(F.col("v") * BINS), 0.5)
    return at.groupBy("g").agg(*(F.max(F.when(F.col("i") == i, (F.col("at") + 0.5) / BINS)).alias(f"at_{i}") for i in range(len(values))))


def first_estimates(rows: DataFrame, few: bool) -> DataFrame:
    """Estimates by g and start: start 0 by medians and median deviations, each other one by a subset of some SUBSET rows.

    Subsets are chosen by a hash of the row's features: alike in every run, and without sorting a group.
    """
    names = list(FEATURES)
    med = cut(medians(rows, [F.col(f) for f in names]))
    mad = medians(with_estimates(rows, med, few), [F.abs(F.col(f) - F.col(f"at_{i}")) for i, f in enumerate(names)])
    spread = mad.select("g", *(F.col(f"at_{i}").alias(f"a_{i}") for i in range(len(names))))
    scale = lambda i, j: F.greatest(F.lit(1.4826) * F.col(f"a_{i}"), F.lit(FEATURES[names[i]])) if i == j else F.lit(0.0)
    start = med.join(spread, "g").select("g", F.lit(0).alias("start"), *(F.col(f"at_{i}").alias(f"m_{i}") for i in range(len(names))), *(scale(i, j).alias(f"c_{i}_{j}") for i in range(len(names)) for j in range(i + 1)))
    sizes = rows.groupBy("g").agg(F.count("*").alias("size"))
    chance = F.pmod(F.xxhash64("start", *names), F.lit(1 << 30)) / (1 << 30)
    others = with_estimates(rows, sizes, few).withColumn("start", F.explode(F.array(*(F.lit(k) for k in range(1, STARTS))))).where(chance * F.col("size") < SUBSET)
    return with_determinant(start).unionByName(covariance(others))


def concentrate(rows: DataFrame, est: DataFrame, few: bool, share: float) -> DataFrame:
    """One step for each g and start: the rows with the smallest distances, a share of each group, give the next means and covariances."""
    far = distance(with_estimates(rows, est.drop("ld"), few)).select("g", "start", *FEATURES, F.floor(F.log2(F.col("d2") + 1.0) * (BINS // 8)).alias("at"))
    limit = quantile(far, ["g", "start"], F.col("at"), share).withColumnRenamed("at", "limit")
    side = F.broadcast(limit) if few else limit
    return cut(covariance(far.join(side, ["g", "start"]).where(F.col("at") <= F.col("limit"))))


def robust_estimates(rows: DataFrame, few: bool, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """Minimum covariance determinant of each g: concentration steps from several starts, then more of them from the start whose covariance
    has the least determinant. Sums and histograms are merged from partial ones, so a group of any size spreads over all tasks."""
    est = cut(first_estimates(rows, few))
    for _ in range(steps):
        est = concentrate(rows, est, few, share)
    for _ in range(LAST_STEPS):
        values = [c for c in est.columns if c not in ("g", "ld")]
        best = est.groupBy("g").agg(F.min(F.struct("ld", *values)).alias("b"))
        est = concentrate(rows, best.select("g", *(f"b.{c}" for c in values), "b.ld"), few, share)
    return est.drop("start", "ld")


def with_group(df: DataFrame, text_col: str, lang_col: str, source_col: str, *keep) -> DataFrame:
    """keep's columns, text (null: empty), g0, the hash of the row's language and source, and g1, that of its language."""
    lang = (F.col(lang_col).isNull(), F.col(lang_col))
    return df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(*lang, F.col(source_col).isNull(), F.col(source_col)).alias("g0"), F.xxhash64(*lang).alias("g1"))


def with_base(stats: DataFrame) -> DataFrame:
    return features(stats).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def fit(rows: DataFrame) -> tuple[DataFrame, bool]:
    """Estimates by g, and whether they are few enough to broadcast: of the groups g0 with MIN_ROWS passing rows or more; for smaller ones of
    their languages g1, if these have as many; and for still smaller languages, as g = 0, of all rows."""
    passing = rows.where(~F.col("base_failed")).select("g0", "g1", *FEATURES)
    sizes = cut(passing.groupBy("g0", "g1").agg(F.count("*").alias("n")))
    few = sizes.count() <= BROADCAST_GROUPS
    large = F.col("n") >= MIN_ROWS
    langs = sizes.groupBy("g1").agg(F.sum("n").alias("n"), F.min("n").alias("least"))
    groups = cut(sizes.where(large).select(F.lit(0).alias("level"), F.col("g0").alias("g")).unionAll(langs.where(large & (F.col("least") < MIN_ROWS)).select(F.lit(1), "g1")).unionAll(langs.where(~large).select(F.lit(2), F.lit(0).cast("long")).distinct()))
    levels = passing.select(F.posexplode(F.array("g0", "g1", F.lit(0).cast("long"))).alias("level", "g"), *FEATURES)
    return robust_estimates(stored(levels.join(F.broadcast(groups) if few else groups, ["level", "g"], "left_semi").drop("level")), few), few


def with_verdict(rows: DataFrame, est: DataFrame, few: bool) -> DataFrame:
    """rows with outlier and kept."""
    p = len(FEATURES)
    shrunk = SHARE / chi2_cdf(chi2_quantile(SHARE, p), p + 2)  # what the covariance of the nearest rows lacks against all of a normal group
    values = [c for c in est.columns if c != "g"]
    named = lambda g, prefix: est.where("g <> 0").select(F.col("g").alias(g), *(F.col(c).alias(f"{prefix}_{c}") for c in values))
    own, lang = named("g0", "own"), named("g1", "lang")
    overall = est.where("g = 0").select(*(F.col(c).alias(f"all_{c}") for c in values))  # one row at most
    joined = rows.join(F.broadcast(own) if few else own, "g0", "left").join(F.broadcast(lang) if few else lang, "g1", "left").join(F.broadcast(overall), F.lit(True), "left")
    by = F.when(F.col("own_m_0").isNotNull(), "source").when(F.col("lang_m_0").isNotNull(), "language").when(F.col("all_m_0").isNotNull(), "all")
    # the values of a row come from one estimate
    chosen = {c: F.when(F.col("own_m_0").isNotNull(), F.col(f"own_{c}")).when(F.col("lang_m_0").isNotNull(), F.col(f"lang_{c}")).otherwise(F.col(f"all_{c}")) for c in values}
    far = distance(joined.withColumns(chosen | {"estimate": by}), shrunk)
    far = far.withColumn("estimate", F.when(~F.col("base_failed"), F.col("estimate"))).withColumn("outlier", ~F.col("base_failed") & F.coalesce(F.col("d2") > chi2_quantile(1 - TAIL, p), F.lit(False)))
    return far.withColumn("kept", ~F.col("base_failed") & ~F.col("outlier"))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row for each row of df: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, outlier, estimate, kept.

    base_failed: fewer than 10 words, or more than a fifth of the words in repeated 5-word windows. outlier: the squared
    Mahalanobis distance of the transformed statistics lies beyond the cutoff of the row's language and source; of groups
    with fewer than MIN_ROWS rows, of their language; of languages with fewer, of all rows. estimate names which of them judged
    the row (source, language, all; null for rows that fail the base). Estimates rest on all rows that the base keeps.

    Null and empty texts have no words and fail the base; null languages or sources are groups of their own. Statistics of a text of any
    length are counted whole, within its row. A distance of exactly the cutoff is no outlier; repeated rows count each and are judged
    alike; a null id is kept as it is; an empty table gives no rows; other columns, whatever their names, play no part.
    """
    rows = stored(with_base(statistics(with_group(df, text_col, lang_col, source_col, F.col(id_col).alias("doc_id")), "doc_id", "g0", "g1")))
    est, few = fit(rows)
    return with_verdict(rows, est, few).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "outlier", "estimate", "kept")


def keep_good(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of df, all columns as they are, that judge() keeps, in its terms also on odd rows.

    The statistics are written once beside the rows; the estimates read them alone, and the verdict is taken as the rows are read again.
    """
    whole = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").alias("l"), F.col(f"`{source_col}`").alias("s"))
    rows = stored(with_base(statistics(with_group(whole, "t", "l", "s", "row"), "row", "g0", "g1")).select("row", "g0", "g1", "base_failed", *FEATURES))
    est, few = fit(rows)
    return with_verdict(rows, est, few).where("kept").select("row.*")
