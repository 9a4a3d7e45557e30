"""Ranking and sizing: rarity of items, spread of places, coverage curves and their knee, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KNEE = 0.05  # least rise above the straight line


def item_tokens(item: Column) -> Column:
    """Distinct tokens with digits made alike, of two characters or more."""
    parts = F.split(F.regexp_replace(F.lower(item), r"\p{N}+", "N"), r"[^\p{L}\p{N}_-]+")
    return F.array_distinct(F.filter(parts, lambda t: F.char_length(t) > 1))


def spread_order(n: int) -> list[int]:
    """Places 0 to n-1: the middle first, then the middles of both halves, and so on, level by level."""
    out, level = [], [(0, n - 1)]
    while level:
        below = []
        for a, b in level:
            if a <= b:
                m = (a + b) // 2
                out.append(m)
                below += [(a, m - 1), (m + 1, b)]
        level = below
    return out


def spread_ranks(n: Column) -> Column:
    """For each of n places its rank in the spread order, as an array, by levels of the halving tree.

    A place's level is how often its range was halved until it was the middle; within a level places go from left to right.
    """

    def level(i: Column) -> Column:
        start = F.struct(F.lit(0).alias("a"), (n - 1).alias("b"), F.lit(0).alias("d"), F.lit(False).alias("done"))

        def step(s: Column, _: Column) -> Column:
            m = F.floor((s["a"] + s["b"]) / 2).cast("int")
            stop = s["done"] | (m == i)
            return F.struct(
                F.when(stop | (i < m), s["a"]).otherwise(m + 1).alias("a"), F.when(stop | (i > m), s["b"]).otherwise(m - 1).alias("b"), F.when(stop, s["d"]).otherwise(s["d"] + 1).alias("d"), stop.alias("done")
            )

        return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(n + 1.0)).cast("int")), start, step)["d"]

    return F.transform(F.sequence(F.lit(0), n - 1), level)


def ranked_items(items: DataFrame, required: str = "required") -> DataFrame:
    """items (id, idx, item, required) that aren't required, with information, coverage, score and rank: 1 is best.

    Rarity is the mean over an item's distinct tokens of their inverse document frequency among the items of its id.
    """
    group = Window.partitionBy("id")
    d = items.withColumn("n", F.count("*").over(group)).withColumn("longest", F.greatest(F.lit(1), F.max(F.char_length("item")).over(group)))
    tokens = d.select("id", "idx", "n", F.explode(item_tokens(F.col("item"))).alias("token"))
    freq = tokens.withColumn("df", F.count("*").over(Window.partitionBy("id", "token")))
    rarity = freq.groupBy("id", "idx").agg(F.avg(F.log((F.col("n") + 1) / (F.col("df") + 1)) / F.log(F.col("n") + 1.0)).alias("rarity"))
    d = d.join(rarity, ["id", "idx"], "left").withColumn("information", F.coalesce("rarity", F.lit(0.0)) * 0.85 + F.char_length("item") / F.col("longest") * 0.15)
    levels = d.select("id", "n").distinct().select("id", F.posexplode(spread_ranks(F.col("n").cast("int"))).alias("idx", "level"))
    free = d.where(~F.col(required)).join(levels, ["id", "idx"])
    m = F.count("*").over(group)
    place = F.row_number().over(group.orderBy("level", "idx")) - 1
    free = free.withColumn("m", m).withColumn("coverage", F.when(F.col("m") <= 1, 1.0).otherwise(1 - place / (F.col("m") - 1)))
    free = free.withColumn("score", F.col("information") * 0.8 + F.col("coverage") * 0.2)
    return free.withColumn("rank", F.row_number().over(group.orderBy(F.desc("score"), "idx"))).drop("n", "longest", "rarity", "level", "m")


def bigrams(item: Column) -> Column:
    """Distinct pairs of neighbouring words; of one word, the word and nothing; of Han text without spaces, of characters."""
    low = F.lower(item)
    words = F.filter(F.split(F.trim(low), r"\s+"), lambda w: w != "")
    chars = F.split(low, "")
    pairs = lambda xs: F.transform(F.sequence(F.lit(0), F.size(xs) - 2), lambda i: F.concat(F.get(xs, i), F.lit("\u0001"), F.get(xs, i + 1)))
    han = (F.size(words) == 1) & (F.size(chars) > 1) & low.rlike(r"\p{IsHan}") & ~low.rlike(r"\s")
    return F.array_distinct(F.when(han, pairs(chars)).when(F.size(words) < 2, F.array(F.concat(F.coalesce(F.get(words, F.lit(0)), F.lit("")), F.lit("\u0001")))).otherwise(pairs(words)))


def coverage_curve(items: DataFrame) -> DataFrame:
    """id, idx, seen: how many distinct bigrams the items of an id hold up to this one."""
    firsts = items.select("id", "idx", F.explode(bigrams(F.col("item"))).alias("b")).groupBy("id", "b").agg(F.min("idx").alias("idx")).groupBy("id", "idx").agg(F.count("*").alias("new"))
    upto = Window.partitionBy("id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return items.select("id", "idx").join(firsts, ["id", "idx"], "left").withColumn("seen", F.sum(F.coalesce("new", F.lit(0))).over(upto)).drop("new")


def knees(curve: DataFrame) -> DataFrame:
    """id, items, knee: the place, from 1, where the curve stands farthest above the straight line; 1 if it is flat, null if too near or short."""
    g = Window.partitionBy("id")
    d = curve.withColumns({"n": F.count("*").over(g), "first": F.min("seen").over(g), "last": F.max("seen").over(g)})
    rise = (F.col("seen") - F.col("first")) / F.nullif(F.col("last") - F.col("first"), F.lit(0)) - F.col("idx") / F.nullif(F.col("n") - 1, F.lit(0))
    best = d.withColumn("rise", rise).groupBy("id").agg(F.first("n").alias("items"), F.first("first").alias("first"), F.first("last").alias("last"), F.max(F.struct(F.col("rise"), (-F.col("idx")).alias("at"))).alias("m"))
    knee = F.when(F.col("items") < 3, None).when(F.col("first") == F.col("last"), 1).when(F.col("m.rise") >= KNEE, 1 - F.col("m.at"))
    return best.select("id", "items", knee.cast("int").alias("knee"))
