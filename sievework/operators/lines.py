"""Line-level operators on logs, search results, diffs, tables and prose.

A payload's lines become rows that keep its id; windows and groups are by id, so a payload is the largest group. Payloads
are bounded by the admission gate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import ABNORMAL, DIFF_PRIORITY, KEYWORDS, SEVERE, any_word, lines_of, not_blank, query_words, strip
from sievework.functions.detect import table_format

#: Fixed budgets of the balanced profile.
LOG_ERRORS, LOG_STACKS, LOG_STACK_LINES, LOG_WARNINGS, LOG_CONTEXT, LOG_MIN_LINES, TRACE_LINES = 10, 3, 20, 5, 3, 50, 24
DIFF_FILES, DIFF_HUNKS, DIFF_CONTEXT, DIFF_MIN_LINES, DIFF_RATIO = 20, 10, 2, 50, 0.8
SEARCH_FILES, SEARCH_MIN = 15, 20
#: Fixed markers of log formats, in the order of preference.
LOG_FORMATS = {
    "pytest": ("=== FAILURES", "=== ERRORS", "=== test session", "=== short test summary", "PASSED [", "FAILED [", "ERROR [", "SKIPPED [", "collected "),
    "npm": ("npm ERR!", "npm WARN", "npm info", "npm http"),
    "cargo": ("Compiling ", "Finished ", "Running ", "warning: ", "error[E"),
    "jest": ("PASS ", "FAIL ", "Test Suites:"),
    "make": ("make[", "make:", "gcc ", "g++ ", "clang "),
}


def exploded(df: DataFrame, id_col: str = "id", content: str = "content") -> DataFrame:
    """id, idx (from 0), line."""
    return df.select(F.col(id_col).alias("id"), F.posexplode(lines_of(F.col(content))).alias("idx", "line"))


def any_of(line: Column, words: Column) -> Column:
    """How many of the words the lower-cased line contains."""
    low = F.lower(line)
    return F.size(F.filter(words, lambda w: low.contains(w)))


# --- logs


def log_level(line: Column) -> Column:
    level = lambda words, more="": line.rlike(f"(?i){any_word(words)}{more}")
    return F.when(level("ERROR|FATAL|CRITICAL", "|^npm ERR!"), "ERROR").when(level("FAIL|FAILED"), "FAIL").when(level("WARN|WARNING", "|^npm WARN"), "WARN").when(level("INFO", "|^npm info"), "INFO").when(level("DEBUG"), "DEBUG").when(level("TRACE"), "TRACE").otherwise("UNKNOWN")


def is_summary(line: Column) -> Column:
    return line.rlike(r"^={3,}|^-{3,}|^\d+ (?:passed|failed|skipped|error|warning)|^(?:Tests?|Suites?):?\s+\d+|^(?:TOTAL|Total|Summary)|^(?:Build|Compile|Test).*(?:succeeded|failed|complete)")


def trace_flavor(line: Column) -> Column:
    """python, js, java, rust or go if a trace begins or goes on in this line, else null."""
    t = F.regexp_replace(line, r"^\s+", "")
    place = t.rlike(r":\d+:\d+")
    return (
        F.when(t.startswith("Traceback (most recent call last)") | t.rlike(r'^File ".+", line \d+'), "python")
        .when(t.startswith("at ") & t.contains("(") & place, "js")
        .when(t.rlike(r"^at [\w.$]+\("), "java")
        .when(t.startswith("--> ") & place, "rust")
        .when(line.rlike(r"(?i)^\s*\d+:\s+0x[0-9a-f]+"), "go")
    )


def ends_trace(flavor: Column, line: Column) -> Column:
    t = F.regexp_replace(line, r"^\s+", "")
    goes_on = line.startswith(" ") | line.startswith("\t") | (line == "") | t.rlike(r"^(?:Traceback|File |During handling|The above exception|[A-Z])")
    return (
        F.when(flavor == "python", ~goes_on)
        .when(flavor.isin("js", "java"), ~t.startswith("at ") & (line != ""))
        .when(flavor == "rust", ~t.startswith("--> ") & (line != ""))
        .otherwise(~t.rlike(r"^\d") & (line != ""))
    )


def stack_flags(lines: Column) -> Column:
    """For each line whether it belongs to a trace: one pass that carries the open trace's flavor and length."""

    def step(acc: Column, x: Column) -> Column:
        closed = acc["flavor"].isNull() | (acc["n"] >= TRACE_LINES) | ends_trace(acc["flavor"], x)
        flavor = F.when(closed, trace_flavor(x)).otherwise(acc["flavor"])
        n = F.when(flavor.isNull(), 0).when(closed, 1).otherwise(acc["n"] + 1)
        return F.struct(flavor.alias("flavor"), n.alias("n"), F.concat(acc["out"], F.array(flavor.isNotNull())).alias("out"))

    return F.aggregate(lines, F.struct(F.lit(None).cast("string").alias("flavor"), F.lit(0).alias("n"), F.array().cast("array<boolean>").alias("out")), step)["out"]


def log_lines(df: DataFrame, id_col: str = "id", content: str = "content") -> DataFrame:
    """id, idx, line, level, stack, summary, score of each line."""
    ls = df.select(F.col(id_col).alias("id"), lines_of(F.col(content)).alias("l"))
    # without a line that opens a trace, which a pattern tells at once, the pass is left out
    opens = F.exists("l", lambda x: trace_flavor(x).isNotNull())
    rows = ls.withColumn("s", F.when(opens, stack_flags(F.col("l")))).select("id", "s", F.posexplode("l").alias("idx", "line"))
    x = F.col("line")
    rows = rows.select("id", "idx", "line", log_level(x).alias("level"), F.coalesce(F.get("s", F.col("idx")), F.lit(False)).alias("stack"), is_summary(x).alias("summary"))
    base = F.when(F.col("level").isin("ERROR", "FAIL"), 1.0).when(F.col("level") == "WARN", 0.5).when(F.col("level").isin("INFO", "UNKNOWN"), 0.1).when(F.col("level") == "DEBUG", 0.05).otherwise(0.02)
    return rows.withColumn("score", F.least(F.lit(1.0), base + F.when(F.col("stack"), 0.3).otherwise(0.0) + F.when(F.col("summary"), 0.4).otherwise(0.0)))


def dedupe_key(line: Column) -> Column:
    """The line with numbers, addresses and paths behind its first : or = made alike."""
    head = F.regexp_extract(line, r"^[^:=]*", 0)
    rest = F.substr(line, F.char_length(head) + 1)
    return F.concat(head, F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"\d+", "N"), r"(?i)0x[0-9a-f]+", "ADDR"), r"/[\w/]+/", "/PATH/"))


def with_first_last(rows: DataFrame, budget: int, keys: list[str], score: str = "score") -> DataFrame:
    """Of each group the rows that fit a budget: all if they are few enough, else first, last, and the best by score."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("__n", F.count("*").over(w)).withColumn("__end", (F.row_number().over(w.orderBy("idx")) == 1) | (F.row_number().over(w.orderBy(F.desc("idx"))) == 1))
    ranked = ranked.withColumn("__r", F.row_number().over(w.orderBy(F.desc("__end"), F.desc(score), "idx")))
    return ranked.where((F.col("__n") <= budget) | (F.col("__r") <= budget)).drop("__n", "__end", "__r")


def log_selection(df: DataFrame, query: str = "", id_col: str = "id", content: str = "content") -> DataFrame:
    """id, idx, line, level, score, required, warning, context of the lines that a log's selection draws on; short logs are left out."""
    rows = log_lines(df, id_col, content)
    whole = Window.partitionBy("id")
    rows = rows.withColumn("n", F.count("*").over(whole)).where(F.col("n") >= LOG_MIN_LINES)
    asked = any_of(F.col("line"), F.array_distinct(query_words(F.lit(query), r"[^\p{L}\p{N}_-]+", 2))) > 0
    in_order = Window.partitionBy("id").orderBy("idx")
    w = Window.partitionBy("id", "level")
    ends = (F.row_number().over(w.orderBy("idx")) == 1) | (F.row_number().over(w.orderBy(F.desc("idx"))) == 1)
    rows = rows.withColumn("ends", ends).withColumn("place", F.row_number().over(w.orderBy(F.desc("ends"), F.desc("score"), "idx")))
    bad = F.col("level").isin("ERROR", "FAIL") & (F.col("place") <= LOG_ERRORS)
    rows = rows.withColumn("opens", F.col("stack") & ~F.coalesce(F.lag("stack").over(in_order), F.lit(False))).withColumn("grp", F.sum(F.col("opens").cast("int")).over(in_order))
    in_group = F.row_number().over(Window.partitionBy("id", "grp", "stack").orderBy("idx"))
    traced = F.col("stack") & (F.col("grp") <= LOG_STACKS) & (in_group <= LOG_STACK_LINES)
    rows = rows.withColumn("key", dedupe_key(F.col("line"))).withColumn("fresh", (F.col("level") == "WARN") & (F.row_number().over(Window.partitionBy("id", "level", "key").orderBy("idx")) == 1))
    rows = rows.withColumn("warning", F.col("fresh") & (F.sum(F.col("fresh").cast("int")).over(in_order) <= LOG_WARNINGS))
    rows = rows.withColumn("required", asked | bad | traced | F.col("summary"))
    around = F.max(F.col("required") | F.col("warning")).over(in_order.rowsBetween(-LOG_CONTEXT, LOG_CONTEXT))
    rows = rows.withColumn("context", around & ~F.col("required") & ~F.col("warning"))
    return rows.select("id", "idx", "line", "level", "score", "required", "warning", "context")


def log_format(df: DataFrame, id_col: str = "id", content: str = "content") -> DataFrame:
    """id, format: the format whose markers stand in most of the first 100 lines, the earlier one of equals; generic without any."""
    first = F.slice(lines_of(F.col(content)), 1, 100)

    def votes(markers: tuple[str, ...]) -> Column:
        def hit(x: Column) -> Column:
            out = x.contains(markers[0])
            for m in markers[1:]:
                out = out | x.contains(m)
            return out

        return F.size(F.filter(first, hit))

    ranked = F.array(*(F.struct(votes(m).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("format")) for i, (name, m) in enumerate(LOG_FORMATS.items())))
    best = F.array_max(ranked)
    return df.select(F.col(id_col).alias("id"), F.when(best["n"] > 0, best["format"]).otherwise("generic").alias("format"))


# --- search results


def search_matches(df: DataFrame, id_col: str = "id", content: str = "content") -> DataFrame:
    """id, idx, file, line_number, content of each result: file:line:content, file-line-content, or line:content under a heading.

    A heading is a line that is no result and has a numbered one behind it; it holds until another line that isn't numbered.
    """
    rows = exploded(df, id_col, content)
    x = F.col("line")
    colon, dash = r"^(.+?):(\d+):(.*)$", r"^(.+?)-(\d+)-(.*)$"
    at = lambda p: F.when(x.rlike(p), F.char_length(F.regexp_extract(x, p, 1)))
    use_colon = at(colon).isNotNull() & (at(dash).isNull() | (at(colon) <= at(dash)))
    part = lambda k: F.when(use_colon, F.regexp_extract(x, colon, k)).when(at(dash).isNotNull(), F.regexp_extract(x, dash, k))
    numbered = r"^(\d+):(.*)$"
    in_order = Window.partitionBy("id").orderBy("idx")
    rows = rows.select("id", "idx", "line", part(1).alias("file"), part(2).alias("number"), part(3).alias("rest"), x.rlike(numbered).alias("numbered"))
    rows = rows.withColumn("next_numbered", F.coalesce(F.lead("numbered").over(in_order), F.lit(False)))
    plain = F.col("file").isNull()
    # what each line makes of the heading: a path, '' for none, null for no change
    mark = F.when(~plain, "").when(~F.col("numbered") & (x != "") & F.col("next_numbered"), x).when(~F.col("numbered"), "")
    rows = rows.withColumn("heading", F.last(mark, ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
    under = plain & F.col("numbered") & (F.coalesce("heading", F.lit("")) != "")
    return rows.where(~plain | under).select(
        "id", "idx", F.coalesce("file", "heading").alias("file"), F.expr("try_cast(coalesce(number, regexp_extract(line, '^(\\\\d+):', 1)) AS BIGINT)").alias("line_number"), F.coalesce("rest", F.regexp_extract(x, numbered, 2)).alias("content")
    )


def scored_matches(matches: DataFrame, query: str = "") -> DataFrame:
    """matches with severe, hits, score, and required: severe or two words of the query."""
    words = query_words(F.lit(query), r"\W+", 2)
    d = matches.withColumn("severe", F.col("content").rlike(SEVERE)).withColumn("hits", any_of(F.col("content"), words))
    return d.withColumn("score", F.when(F.col("severe"), 1.0).otherwise(0.0) + F.col("hits") * 0.3).withColumn("required", F.col("severe") | (F.col("hits") >= 2))


def ranked_files(scored: DataFrame) -> DataFrame:
    """id, file, matches, top (best score), rank: by best score, then by first appearance."""
    files = scored.groupBy("id", "file").agg(F.count("*").alias("matches"), F.max("score").alias("top"), F.min("idx").alias("first"))
    return files.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("top"), "first"))).drop("first")


# --- diffs


def diff_lines(df: DataFrame, id_col: str = "id", content: str = "content") -> DataFrame:
    """id, idx, line, file_no, hunk_no (0: before the first), what: prelude, file, header, hunk or body; and in_file, the place in its hunk."""
    rows = exploded(df, id_col, content)
    x = F.col("line")
    in_order = Window.partitionBy("id").orderBy("idx")
    rows = rows.withColumn("is_file", x.rlike(r"^diff --(?:git|cc|combined) ")).withColumn("is_hunk", x.rlike(r"^@@@?\s"))
    rows = rows.withColumn("file_no", F.sum(F.col("is_file").cast("int")).over(in_order))
    rows = rows.withColumn("hunk_no", F.sum(F.col("is_hunk").cast("int")).over(Window.partitionBy("id", "file_no").orderBy("idx")))
    what = F.when(F.col("file_no") == 0, "prelude").when(F.col("is_file"), "file").when(F.col("is_hunk"), "hunk").when(F.col("hunk_no") == 0, "header").otherwise("body")
    return rows.select("id", "idx", "line", "file_no", "hunk_no", what.alias("what"))


def trimmed(rows: DataFrame) -> DataFrame:
    """rows of diff_lines with keep: body lines near a change, the first two of a hunk without one, and lines that are no context."""
    x = F.col("line")
    change = x.startswith("+") | x.startswith("-")
    h = Window.partitionBy("id", "file_no", "hunk_no", "what")
    near = F.max(change).over(h.orderBy("idx").rowsBetween(-DIFF_CONTEXT, DIFF_CONTEXT))
    none = ~F.max(change).over(h)
    early = F.row_number().over(h.orderBy("idx")) <= DIFF_CONTEXT
    return rows.withColumn("keep", (F.col("what") != "body") | near | (none & early) | (~x.startswith(" ") & ~change))


def diff_files(rows: DataFrame, query: str = "") -> DataFrame:
    """id, file_no, header, additions, deletions, priority, hits, selected: the first files by priority, hits, changes and place."""
    words = F.array_distinct(query_words(F.lit(query), r"[^\p{L}\p{N}_]+", 1))
    x, body = F.col("line"), F.col("what") == "body"
    files = rows.where("file_no > 0").groupBy("id", "file_no").agg(
        F.min(F.when(F.col("what") == "file", x)).alias("header"),
        F.sum((body & x.startswith("+")).cast("long")).alias("additions"),
        F.sum((body & x.startswith("-")).cast("long")).alias("deletions"),
        F.max(x.rlike(DIFF_PRIORITY)).alias("priority"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.filter(words, lambda w: F.lower(x).contains(w)))))).alias("hits"),
    )
    order = Window.partitionBy("id").orderBy(F.desc("priority"), F.desc("hits"), F.desc(F.col("additions") + F.col("deletions")), "file_no")
    return files.withColumn("selected", F.row_number().over(order) <= DIFF_FILES)


def diff_hunks(rows: DataFrame, query: str = "") -> DataFrame:
    """id, file_no, hunk_no, changes, priority, hits, score, selected: first and last, and the best between them."""
    words = F.array_distinct(query_words(F.lit(query), r"[^\p{L}\p{N}_]+", 1))
    x = F.col("line")
    hunks = rows.where("hunk_no > 0").groupBy("id", "file_no", "hunk_no").agg(
        F.sum(((F.col("what") == "body") & x.rlike(r"^[+-]")).cast("long")).alias("changes"),
        F.max(x.rlike(DIFF_PRIORITY)).alias("priority"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.filter(words, lambda w: F.lower(x).contains(w)))))).alias("hits"),
    )
    score = F.least(F.lit(1.0), F.least(F.lit(0.3), F.col("changes") * 0.03) + F.col("hits") * 0.2 + F.when(F.col("priority"), 0.3).otherwise(0.0))
    f = Window.partitionBy("id", "file_no")
    hunks = hunks.withColumn("score", score).withColumn("n", F.max("hunk_no").over(f))
    edge = (F.col("hunk_no") == 1) | (F.col("hunk_no") == F.col("n"))
    hunks = hunks.withColumn("edge", edge).withColumn("r", F.row_number().over(f.orderBy(F.desc("edge"), F.desc("priority"), F.desc("score"), "hunk_no")))
    return hunks.withColumn("selected", (F.col("n") <= DIFF_HUNKS) | (F.col("r") <= DIFF_HUNKS)).drop("n", "edge", "r")


def compact_diff(df: DataFrame, query: str = "", id_col: str = "id", content: str = "content") -> DataFrame:
    """id, original_lines, candidate, candidate_lines, additions, deletions, files, hunks_omitted, files_omitted, changed.

    changed is false where the candidate has no less than 0.8 of the lines, or isn't shorter, or the diff is short or broken.
    """
    rows = trimmed(diff_lines(df, id_col, content))
    files, hunks = diff_files(rows, query), diff_hunks(rows, query)
    kept = rows.join(files.select("id", "file_no", F.col("selected").alias("file_kept")), ["id", "file_no"], "left").join(hunks.select("id", "file_no", "hunk_no", F.col("selected").alias("hunk_kept")), ["id", "file_no", "hunk_no"], "left")
    in_file = F.coalesce("file_kept", F.lit(True))
    in_hunk = in_file & F.coalesce("hunk_kept", F.lit(True))
    x, body = F.col("line"), F.col("what") == "body"
    total = kept.groupBy("id").agg(
        F.count("*").alias("original_lines"),
        F.transform(F.array_sort(F.collect_list(F.when(in_hunk & F.col("keep"), F.struct("idx", "line")))), lambda s: s["line"]).alias("l"),
        F.sum((in_hunk & body & x.startswith("+")).cast("long")).alias("additions"),
        F.sum((in_hunk & body & x.startswith("-")).cast("long")).alias("deletions"),
        F.sum((in_file & (F.col("what") == "file")).cast("long")).alias("files"),
        F.sum((in_file & ~F.coalesce("hunk_kept", F.lit(True)) & (F.col("what") == "hunk")).cast("long")).alias("hunks_omitted"),
        F.sum((~in_file & (F.col("what") == "file")).cast("long")).alias("files_omitted"),
        F.max((F.col("what") == "hunk")).alias("has_hunks"),
    )
    parts = F.concat_ws(", ", F.format_string("%d files changed", "files"), F.format_string("+%d -%d lines", "additions", "deletions"), F.when(F.col("hunks_omitted") > 0, F.format_string("%d hunks omitted", "hunks_omitted")), F.when(F.col("files_omitted") > 0, F.format_string("%d files omitted", "files_omitted")))
    out = total.withColumn("candidate", F.concat(F.array_join("l", "\n"), F.lit("\n["), parts, F.lit("]"))).withColumn("candidate_lines", (F.size("l") + 1).cast("long"))
    sizes = df.select(F.col(id_col).alias("id"), F.char_length(content).alias("chars"))
    out = out.join(sizes, "id")
    ok = F.col("has_hunks") & (F.col("original_lines") >= DIFF_MIN_LINES) & (F.col("candidate_lines") < F.col("original_lines") * DIFF_RATIO) & (F.char_length("candidate") < F.col("chars"))
    return out.withColumn("changed", ok).drop("l", "has_hunks", "chars")


# --- tables


def table_rows(df: DataFrame, id_col: str = "id", content: str = "content") -> DataFrame:
    """id, format, idx, row, cells of the rows behind a table's header; payloads that are no tables are left out."""
    c = F.col(content)
    d = df.select(F.col(id_col).alias("id"), table_format(c).alias("format"), F.filter(lines_of(c), not_blank).alias("l")).where(F.col("format").isNotNull())
    head = F.when(F.col("format") == "markdown", 2).otherwise(1)
    rows = d.select("id", "format", F.posexplode(F.slice("l", head + 1, F.greatest(F.lit(0), F.size("l") - head))).alias("idx", "row"))
    cells = F.when(F.col("format") == "markdown", F.split("row", r"\|", -1)).when(F.col("format") == "csv", F.split("row", ",", -1)).otherwise(F.split("row", "\t", -1))
    return rows.withColumn("cells", F.transform(cells, strip))


def numeric_outliers(cells: DataFrame, keys: list[str], field: str, value: str, threshold: float = 3.0) -> DataFrame:
    """cells with z of its value within a key's field, where there are five values or more that differ, and z reaches the threshold."""
    w = Window.partitionBy(*keys, field)
    d = cells.withColumn("__n", F.count(value).over(w)).withColumn("__m", F.avg(value).over(w)).withColumn("__s", F.stddev_pop(value).over(w))
    return d.where((F.col("__n") >= 5) & (F.col("__s") > 0)).withColumn("z", F.abs(F.col(value) - F.col("__m")) / F.col("__s")).where(F.col("z") >= threshold).drop("__n", "__m", "__s")


def required_rows(rows: DataFrame, query: str = "") -> DataFrame:
    """rows with abnormal, asked, edge, outlier and required, of tables with 20 rows or more."""
    n = F.count("*").over(Window.partitionBy("id"))
    rows = rows.withColumn("n", n).where("n >= 20")
    number = F.expr("try_cast(cell AS DOUBLE)")
    cells = rows.select("id", "idx", F.posexplode("cells").alias("col", "cell")).where(F.col("cell").rlike(r"^(?i)-?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?$")).withColumn("x", number)
    odd = numeric_outliers(cells, ["id"], "col", "x").select("id", "idx").distinct().withColumn("outlier", F.lit(True))
    asked = any_of(F.col("row"), query_words(F.lit(query), r"[^\p{L}\p{N}_-]+", 2)) > 0
    d = rows.join(odd, ["id", "idx"], "left").withColumns({"abnormal": F.col("row").rlike(ABNORMAL), "asked": asked, "edge": (F.col("idx") < 2) | (F.col("idx") >= F.col("n") - 2), "outlier": F.coalesce("outlier", F.lit(False))})
    return d.withColumn("required", F.col("abnormal") | F.col("asked") | F.col("edge") | F.col("outlier")).drop("n", "cells")


# --- prose


def segments_of(content: Column) -> Column:
    """Trimmed lines that aren't blank, cut behind . ! or ? where white space follows."""
    cut = F.transform(F.filter(F.transform(lines_of(content), strip), lambda x: x != ""), lambda x: F.split(F.regexp_replace(x, r"([.!?])\s", "$1\u0001"), "\u0001"))
    return F.filter(F.transform(F.flatten(cut), strip), lambda x: x != "")


def salient(word: Column) -> Column:
    bare = F.regexp_replace(word, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")
    letters = F.regexp_replace(word, r"\P{L}", "")
    dotted = word.rlike(r"^[A-Za-z_][^.]*\.[A-Za-z_]")
    return word.rlike(r"\d") | F.lower(bare).isin(*KEYWORDS) | ((F.char_length(letters) >= 2) & (letters == F.upper(letters))) | dotted


def scored_segments(df: DataFrame, query: str = "", id_col: str = "id", content: str = "content") -> DataFrame:
    """id, idx, segment, score, priority. Scored within the row; no shuffle."""
    words = query_words(F.lit(query), r"[^\p{L}\p{N}_]+", 2)
    d = df.select(F.col(id_col).alias("id"), segments_of(F.col(content)).alias("s"))
    d = d.select("id", F.size("s").alias("n"), F.posexplode("s").alias("idx", "segment"))
    x = F.col("segment")
    tokens = F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}_]+"), lambda t: t != "")
    parts = F.filter(F.split(x, r"\s+"), lambda t: t != "")
    relevance = F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.filter(words, lambda w: F.array_contains(tokens, w))) / F.size(words))
    heading = x.rlike(r"^#{1,6}\s+")
    d = d.withColumns({"relevance": relevance, "salience": F.size(F.filter(parts, salient)) / (F.size(parts) + 1), "heading": heading})
    score = (F.col("idx") + 1) / F.col("n") + F.col("relevance") * 2 + F.col("salience") * 1.5 + F.when(F.col("heading"), 1.25).otherwise(0.0)
    keyed = F.exists(tokens, lambda t: t.isin(*KEYWORDS))
    return d.withColumn("score", F.when((F.char_length(x) < 12) & ~F.col("heading"), score * 0.25).otherwise(score)).withColumn("priority", F.col("heading") | keyed | (F.col("relevance") > 0)).select("id", "idx", "segment", "score", "priority")
