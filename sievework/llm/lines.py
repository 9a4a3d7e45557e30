"""Line dedup in DataFrame operations only: first occurrences of line hashes, returned as keep bitmaps of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import id_and_text, if_small
from sievework.session import cut

MIN_CHARS = 10
#: A line in more than 1/HOT of all line occurrences, and in more than LEAST_HOT, is hot: its first document comes from a pre-aggregated
#: table of at most HOT rows. Only lines of hash buckets that hold so many can be hot; BUCKETS bounds the table of buckets.
HOT, LEAST_HOT, BUCKETS = 4096, 1000, 65_536
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STRIPPED = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, LOWER)


def with_row(docs: DataFrame) -> DataFrame:
    """docs with r, a hash of the text: (doc_id, r) tells rows of one doc_id apart; equal rows have equal lines at equal positions."""
    return docs.withColumn("r", F.xxhash64("text"))


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row for each line whose key has min_chars code points: h1, h2 (128 bits of the key), doc_id, r, pos."""
    lines = with_row(docs).select("doc_id", "r", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).select("doc_id", "r", "pos", line_key(F.col("line")).alias("key"))
    return lines.where(F.length("key") >= min_chars).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "r", "pos")


def hot_lines(occ: DataFrame) -> DataFrame:
    """h1, h2, first_doc of the heavy hitters: counted by bucket first, then line by line within the buckets that are heavy themselves."""
    bucket = F.pmod("h1", F.lit(BUCKETS))
    counts = occ.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).collect()  # at most BUCKETS rows
    least = max(LEAST_HOT, sum(r["n"] for r in counts) // HOT)
    heavy = [r["bucket"] for r in counts if r["n"] > least]  # at most HOT of them
    near = occ.where(bucket.isin(heavy)) if heavy else occ.where("false")
    return near.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where(F.col("n") > least).select("h1", "h2", "first_doc")


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, r, pos) of every line whose key occurs in a document with a smaller doc_id.

    Hashes are dealt to partitions by range and sorted there by document and position; of each hash the first document is
    streamed along its run. Hot hashes, counted before the shuffle, skip it: their first documents, at most HOT rows, are
    broadcast.
    """
    occ = cut(occurrences(docs, min_chars))  # some 40 bytes a line
    hot = cut(hot_lines(occ))  # at most HOT rows by its condition
    by_hot = occ.join(F.broadcast(hot), ["h1", "h2"], "left")
    direct = by_hot.where(F.col("doc_id") > F.col("first_doc")).select("doc_id", "r", "pos")
    cold = by_hot.where(F.col("first_doc").isNull()).select("h1", "h2", "doc_id", "r", "pos")
    run = Window.partitionBy("h1").orderBy("h2", "doc_id", "r", "pos")
    ranged = cold.repartitionByRange("h1").withColumn("first_doc", F.when((F.lag("h2").over(run) == F.col("h2")), F.lit(None)).otherwise(F.col("doc_id")))
    streamed = ranged.withColumn("first_doc", F.last("first_doc", ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    return direct.unionAll(streamed.where(F.col("doc_id") > F.col("first_doc")).select("doc_id", "r", "pos"))


def run_lengths(dropped: Column) -> Column:
    """Of the sorted positions of dropped lines the lengths of the runs: kept, dropped, kept, dropped, ... as far as the last dropped line."""
    starts = F.filter(dropped, lambda p, i: F.coalesce(F.get(dropped, i - 1) != p - 1, F.lit(True)))
    ends = F.filter(dropped, lambda p, i: F.coalesce(F.get(dropped, i + 1) != p + 1, F.lit(True)))
    pairs = lambda s, e: F.flatten(F.transform(s, lambda p, k: F.array(p - F.coalesce(F.get(e, k - 1), F.lit(-1)) - 1, F.get(e, k) - p + 1)))
    return F.transform(F.array(F.struct(starts.alias("s"), ends.alias("e"))), lambda x: pairs(x["s"], x["e"]))[0]  # bound once


def keep_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, r, n_dropped, runs of the rows that lose lines: the row's keep bitmap, compressed as run lengths.

    runs: numbers of lines kept, dropped, kept, dropped, ... as far as the last dropped line; all lines after it are kept.
    r: the hash of the row's text, which tells rows of one doc_id apart. A row of a million lines, every other one of them dropped,
    has a million numbers; rows with null ids, and rows that keep all lines, have no bitmap. An empty table gives none.
    """
    dropped = dropped_lines(id_and_text(df, id_col, text_col).where(F.col("doc_id").isNotNull()), min_chars)
    by_row = dropped.groupBy("doc_id", "r").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    return by_row.select("doc_id", "r", F.size("dropped").cast("long").alias("n_dropped"), run_lengths(F.col("dropped")).alias("runs"))


def kept_text(text: Column, runs: Column) -> Column:
    """The text's kept lines joined by newlines; null runs keep all."""
    # a byte for each line, bound once a row: a byte of a binary is read in constant time, a character of a string is not
    bits = F.array_join(F.transform(runs, lambda n, i: F.repeat(F.when(i % 2 == 0, "1").otherwise("0"), n)), "").cast("binary")
    kept = lambda b: F.filter(F.split(text, "\n", -1), lambda x, i: F.coalesce(F.substring(b, i + 1, F.lit(1)) != F.lit(b"0"), F.lit(True)))
    return F.when(runs.isNull(), text).otherwise(F.transform(F.array(bits), lambda b: F.array_join(kept(b), "\n"))[0])


def _maps(df: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The bitmaps as a join's side, broadcast if they were counted to be small."""
    maps = bitmaps.select(F.col("doc_id").alias("__id"), F.col("r").alias("__r"), F.col("n_dropped").alias("__n"), F.col("runs").alias("__runs"))
    return if_small(cut(maps), 4 * F.size("__runs"))


def apply_bitmaps(df: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the texts that the bitmaps leave; rows whose lines all stay keep their text, null included.

    Repeated rows lose the same lines; rows of one doc_id with different texts have bitmaps of their own. All other columns, whatever
    their names, stay as they are. An empty df gives no rows; empty bitmaps change nothing.
    """
    text = F.col(f"d.`{text_col}`")
    cols = [F.when(F.col("__runs").isNull(), text).otherwise(kept_text(text, F.col("__runs"))).alias(c) if c == text_col else F.col(f"d.`{c}`") for c in df.columns]
    own = (F.col(f"d.`{id_col}`") == F.col("__id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("__r"))
    return df.alias("d").join(_maps(df, bitmaps), own, "left").select(*cols)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each row of df: doc_id, n_lines, n_dropped, kept_sha256, keep_bitmap ('' if all lines stay).

    A key of at least min_chars code points keeps its lines only in the smallest doc_id that holds it, there all of them.
    keep_bitmap holds comma-joined run lengths: lines kept, dropped, kept, ... as far as the last dropped one.

    Null and empty texts are one empty line. Texts of any length are split whole; a long one's lines are dealt to all tasks. Rows with one
    doc_id count as one document when holders are compared (ties: all of them keep their lines), but each row drops its own lines by
    their positions in its own text; equal rows give equal results. Rows with a null id keep all lines and take none from others. An
    empty table gives no rows; other columns of df, whatever their names, play no part.
    """
    docs = with_row(id_and_text(df, id_col, text_col))
    maps = _maps(df, keep_bitmaps(df, id_col, text_col, min_chars))
    joined = docs.join(maps, (F.col("doc_id") == F.col("__id")) & (F.col("r") == F.col("__r")), "left")
    return joined.select(
        "doc_id",
        F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce("__n", F.lit(0).cast("long")).alias("n_dropped"),
        F.sha2(kept_text(F.col("text"), F.col("__runs")).cast("binary"), 256).alias("kept_sha256"),
        F.coalesce(F.array_join("__runs", ","), F.lit("")).alias("keep_bitmap"),
    )


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
firsts AS (SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k),
judged AS (SELECT keyed.*, coalesce(doc_id > first_doc, false) AS gone FROM keyed LEFT JOIN firsts USING (k)),
docs AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256,
    string_agg(CASE WHEN gone THEN '0' ELSE '1' END, '' ORDER BY pos) AS bits
  FROM judged GROUP BY doc_id),
cut AS (SELECT *, rtrim(bits, '1') AS b FROM docs)
SELECT doc_id, n_lines, n_dropped, kept_sha256,
  CASE WHEN b LIKE '0%' THEN '0,' ELSE '' END || array_to_string(list_transform(regexp_extract_all(b, '1+|0+'), lambda x: length(x)), ',') AS keep_bitmap
FROM cut
"""
