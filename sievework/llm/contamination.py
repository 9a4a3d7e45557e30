"""Benchmark decontamination in DataFrame operations only: a positional inverted index, intersected from the rarest test terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import let
from sievework.llm.common import id_and_text, if_small
from sievework.session import cut, stored

WINDOW, SLOP = 13, 3
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # fixed pattern of what separates words, after lower-casing A-Z
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case."""
    ascii_only = F.octet_length(text) == F.char_length(text)  # there lower() does the same and is faster
    return F.array_remove(F.split(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), NO_WORD, -1), "")


def test_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each distinct window of the items: win_id, win (its words), n (their number), items (ids of the items that hold it)."""
    w = items.select(F.col("doc_id").alias("item_id"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = w.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))).alias("at"))
    wins = starts.select("item_id", F.slice("w", F.col("at"), F.lit(window)).alias("win"))
    return wins.groupBy("win").agg(F.collect_set("item_id").alias("items")).select(F.xxhash64("win").alias("win_id"), "win", F.size("win").alias("n"), "items")


def flat_index(docs: DataFrame) -> DataFrame:
    """The stored index, a row for each row of docs: r (a number), doc_id, n_words, terms (distinct, in order), places (all positions, by term and ascending), begins (where each term's list begins in places, and their number at the end).

    Lists are kept by document, as segments of a distributed index are: nothing is shuffled to build them, and a hot term's list is as
    long as its document allows at most. They lie one behind another, so that no array is built for each term.
    """
    words = docs.select("doc_id", words_of(F.col("text")).alias("w"))
    count = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1)).otherwise(F.array().cast("array<int>"))
    runs = words.select("doc_id", F.size("w").alias("n_words"), F.sort_array(F.arrays_zip(F.col("w").alias("term"), count.alias("pos"))).alias("s"))
    new = lambda e: F.filter(F.sequence(F.lit(0), F.size(e)), lambda i: ~F.get(e, i).eqNullSafe(F.get(e, i - 1)))
    terms = lambda e, b: F.transform(F.slice(b, F.lit(1), F.greatest(F.lit(0), F.size(b) - 1)), lambda i: F.get(e, i))
    lists = let(F.col("s")["term"], lambda e: let(new(e), lambda b: F.struct(b.alias("begins"), terms(e, b).alias("terms"))))
    flat = runs.select("doc_id", "n_words", F.col("s")["pos"].alias("places"), lists.alias("lists"))
    return stored(flat.select(F.monotonically_increasing_id().alias("r"), "doc_id", "n_words", "lists.terms", "places", "lists.begins"))


def with_lists(index: DataFrame) -> DataFrame:
    """Rows of the stored index with hashes (of the terms, to find them by) and postings (of each term its positions) in place of places and begins."""
    postings = F.transform("terms", lambda _, k: F.slice(F.col("places"), F.get(F.col("begins"), k) + 1, F.get(F.col("begins"), k + 1) - F.get(F.col("begins"), k)))
    return index.withColumns({"hashes": F.transform("terms", lambda t: F.hash(t)), "postings": postings}).drop("places", "begins")


def positional_index(docs: DataFrame) -> DataFrame:
    """The index with its lists: r, doc_id, n_words, terms, hashes, postings."""
    return with_lists(flat_index(docs))


def rarest_first(index: DataFrame, windows: DataFrame) -> DataFrame:
    """The windows with their rarest term by occurrences in the index (term, off) and the other ones from rare to frequent (rest: off, term, hash).

    Windows with a term that the index lacks are left out: they can't occur there.
    """
    terms = windows.select("win_id", "win", F.posexplode("win").alias("off", "term"))
    vocab = cut(terms.select("term").distinct())
    lists = index.select(F.posexplode("terms").alias("k", "term"), "begins").select("term", (F.get("begins", F.col("k") + 1) - F.get("begins", F.col("k"))).alias("n"))
    df = lists.join(if_small(vocab, F.octet_length("term")), "term").groupBy("term").agg(F.sum("n").alias("df"))
    ranked = terms.join(df, "term", "left").groupBy("win_id", "win").agg(F.min(F.coalesce("df", F.lit(0))).alias("least"), F.sort_array(F.collect_list(F.struct("df", "off", "term"))).alias("by_df"))
    first = F.col("by_df")[0]
    rest = F.transform(F.slice("by_df", F.lit(2), F.size("by_df")), lambda x: F.struct(x["off"].alias("off"), x["term"].alias("term"), F.hash(x["term"]).alias("hash")))
    return windows.join(ranked.where(F.col("least") > 0).select("win_id", "win", first["term"].alias("term"), first["off"].alias("off"), rest.alias("rest")), ["win_id", "win"])


def shifted(list_: Column, off: Column, slop: int = 0) -> Column:
    """The places where a window may begin whose word at off stands in the list, or up to slop words beside it."""
    return F.transform(list_, lambda p: p - off) if not slop else F.flatten(F.transform(list_, lambda p: F.sequence(p - off - slop, p - off + slop)))


def find_matches(index: DataFrame, windows: DataFrame, slop: int = SLOP) -> DataFrame:
    """A row for each row of the index and window that match there: r, win_id, n (words), items, exact (starts), near (starts).

    A row is asked for a window if it has the window's rarest term, the next rarest one, and all others. The list of the rarest term,
    shifted by its offset, holds the places where the window may begin; the other terms' lists are intersected with it one by one,
    from rare to frequent, until no place is left. exact: each list has the place's word at its offset. near: each list has a position within slop words of that; exact places
    are near, too. Windows that are small together are broadcast; beyond the bound terms meet them by a shuffle. Rows that are asked for
    something, and no others as long as their numbers can be broadcast, meet their windows by a shuffle, and lists are intersected in
    the index's row, once for all its windows.
    """
    size = 2 * F.octet_length(F.array_join("win", " ")) + 40 * F.col("n") + 16 * F.size("items")
    side = if_small(windows, size)
    if side is not windows:
        met = index.select("r", "terms", F.posexplode("terms").alias("k", "term")).join(side, "term")
    else:
        rarest = cut(windows.select("term").distinct())
        found = index.select("r", F.explode("terms").alias("term")).join(if_small(rarest, F.octet_length("term")), "term", "left_semi").join(windows, "term")
        met = found.join(index.select("r", "terms"), "r")
    # two short tests that generated code has, so that no document's lists are copied beside a candidate: the next rarest term, then all of them
    next_ = F.get(F.col("rest"), F.lit(0))["term"]
    some = next_.isNull() | F.array_contains("terms", next_)
    met = met.where(F.when(some, F.size(F.array_except("win", "terms")) == 0).otherwise(False))
    asked = cut(met.groupBy("r").agg(F.collect_list(F.struct("win_id", "n", "items", "off", "term", "rest")).alias("asked")))
    # rows that are asked for nothing stay where they are; the others meet their windows by a shuffle at every size
    rows = with_lists(index.select("r", "terms", "places", "begins").join(if_small(asked.select("r")), "r", "left_semi").join(asked.hint("merge"), "r"))

    def of(t: Column) -> Column:
        """A term's list; terms are found by their hashes, as numbers are compared faster, and by themselves if two share one."""
        at = F.array_position("hashes", F.hash(t)).cast("int") - 1
        return F.when(F.get(F.col("terms"), at) == t, F.get(F.col("postings"), at)).otherwise(F.get(F.col("postings"), F.array_position("terms", t).cast("int") - 1))

    fold = lambda rest, start, d: F.aggregate(rest, start, lambda acc, t: F.when(F.size(acc) == 0, acc).otherwise(F.array_intersect(acc, shifted(of(t["term"]), t["off"], d))))
    near = F.transform("asked", lambda c: F.struct(c["win_id"].alias("win_id"), c["n"].alias("n"), c["items"].alias("items"), c["rest"].alias("rest"), fold(c["rest"], shifted(of(c["term"]), c["off"]), slop).alias("near")))
    both = F.transform(F.filter(near, lambda c: F.size(c["near"]) > 0), lambda c: F.struct(c["win_id"].alias("win_id"), c["n"].alias("n"), c["items"].alias("items"), fold(c["rest"], F.filter(c["near"], lambda s: s >= 0), 0).alias("exact"), c["near"].alias("near")))
    return rows.select("r", F.explode_outer(both).alias("m")).where("m is not null").select("r", "m.*")


def covered(spans: Column) -> Column:
    """Number of positions in a sorted array of (start, n)."""
    step = lambda acc, x: F.struct((acc["c"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(acc["to"], x["start"]))).alias("c"), F.greatest(acc["to"], x["start"] + x["n"]).alias("to"))
    return F.aggregate(spans, F.struct(F.lit(0).alias("c"), F.lit(0).alias("to")), step, lambda acc: acc["c"].cast("long"))


def find_contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """One row for each row of df: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near (windows met only in proximity).

    n_hit, n_items and contaminated rest on exact matches alone.

    Null and empty texts, of either side, have no words; items without words have no windows. Texts of any length are indexed whole; a
    term's list never leaves its document's row. Rows with one doc_id, or with none, are judged one by one. Repeated items count
    once by item_id, items with a null item_id only as hits. Of equally rare terms the window's first one begins. An empty benchmark
    contaminates nothing; an empty df gives no rows; other columns, whatever their names, play no part.
    """
    index = flat_index(id_and_text(df, id_col, text_col))
    windows = cut(test_windows(id_and_text(benchmark, item_col, item_text_col), window))
    found = find_matches(index, cut(rarest_first(index, windows)), slop)
    spans = F.transform("exact", lambda s: F.struct(s.alias("start"), F.col("n").alias("n")))
    hit = F.size("exact") > 0
    rows = index.select("r", "doc_id", "n_words", F.lit(None).cast("array<struct<start:int,n:int>>").alias("spans"), F.lit(None).cast(windows.schema["items"].dataType).alias("items"), F.lit(0).alias("near_only"))
    matches = found.select("r", F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("int").alias("n_words"), spans.alias("spans"), F.when(hit, F.col("items")).alias("items"), F.when(hit, 0).otherwise(1).alias("near_only"))
    by_row = rows.unionAll(matches).groupBy("r").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").cast("long").alias("n_words"),
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("ids"),
        F.sum("near_only").alias("n_near"),
    )
    digest = F.sha2(F.array_join(F.sort_array(F.transform("ids", lambda x: x.cast("string"))), ",").cast("binary"), 256)
    out = by_row.select("doc_id", "n_words", covered(F.col("spans")).alias("n_hit"), F.size("ids").cast("long").alias("n_items"), digest.alias("items_sha256"), "n_near")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


#: Without an index: each window against each place of each document, and for proximity each word against all places of its document's like words.
ORACLE = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, spot, spot + least(len(w), 13) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS spot FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS spot, w FROM dw),
hits AS (SELECT p.doc_id, p.spot, s.n, wins.item_id
  FROM places p CROSS JOIN sizes s JOIN wins ON wins.n = s.n AND wins.win = array_to_string(list_slice(p.w, p.spot, p.spot + s.n - 1), ' ')
  WHERE p.spot + s.n - 1 <= len(p.w)),
cover AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(spot, spot + n)) AS pos FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id),
tokens AS (SELECT doc_id, spot - 1 AS pos, w[spot] AS term FROM places),
df AS (SELECT term, count(*) AS df FROM tokens GROUP BY term),
wt AS (SELECT win, n, unnest(range(0, n::BIGINT)) AS off, unnest(string_split(win, ' ')) AS term FROM (SELECT DISTINCT win, n FROM wins)),
rare AS (SELECT win, term, off FROM wt JOIN df USING (term) QUALIFY row_number() OVER (PARTITION BY win ORDER BY df, off) = 1),
starts AS (SELECT doc_id, win, pos - off AS at FROM tokens JOIN rare USING (term)),
nears AS (SELECT doc_id, win FROM (
    SELECT s.doc_id, s.win, s.at FROM starts s JOIN wt ON wt.win = s.win JOIN tokens t ON t.doc_id = s.doc_id AND t.term = wt.term AND t.pos BETWEEN s.at + wt.off - 3 AND s.at + wt.off + 3
    GROUP BY s.doc_id, s.win, s.at, wt.n HAVING count(DISTINCT wt.off) = wt.n) GROUP BY ALL),
near AS (SELECT doc_id, count(*) AS n_near FROM (SELECT doc_id, win FROM nears EXCEPT
    SELECT h.doc_id, w.win FROM hits h JOIN wins w ON w.item_id IS NOT DISTINCT FROM h.item_id AND w.n = h.n JOIN dw ON dw.doc_id = h.doc_id AND w.win = array_to_string(list_slice(dw.w, h.spot, h.spot + h.n - 1), ' ')) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM dw LEFT JOIN cover USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN near USING (doc_id)
"""
