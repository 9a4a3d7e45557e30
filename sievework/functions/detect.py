"""Which kind a payload is: json, search, log, text, code, diff, table or html. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import R, any_word, count_where, let, lines_of, not_blank, strip

#: Fixed patterns.
HTML = rf"(?i)<!doctype\s+html{R}|<html{R}|<main{R}|<article{R}"
DIFF_HEADER = r"^(diff --git|diff --combined |diff --cc |--- a/|@@\s+-\d+)"
DIFF_CHANGE = r"^[+-][^+-]"
SEARCH_COLON = r"^([^\s:][^:\n]*):\d+(?=[:\-\s])"
SEARCH_DASH = r"^([^\s:\n][^:\n]*)-\d+(?=[:\-\s])"
LOG = "|".join((
    f"(?i:{any_word('error|fail|failed|fatal|critical|warn|warning|info|debug|trace')})",
    r"^\s*\d{4}-\d{2}-\d{2}", r"^\s*\[\d{2}:\d{2}:\d{2}\]", r"(?i:^npm ERR!|^yarn error|^cargo error)", r"Traceback \(most recent call last\)", r"^\s*at\s+[\w.$]+\(",
))
DECLARATION = "|".join((
    r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+[$\w]+\s*\(",
    r"^\s*(?:export\s+)?(?:abstract\s+)?(?:class|interface|type|enum|namespace)\s+[$\w]+",
    r"^\s*(?:async\s+)?def\s+\w+\s*\(",
    r"^\s*class\s+\w+(?:\([^)]*\))?\s*:",
    r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+\w+\s*\(",
    r"^\s*(?:package\s+\w+|func\s+(?:\([^)]*\)\s*)?\w+\s*\()",
    r"^\s*#include\s+[<\"]|^\s*using\s+namespace\s+\w+",
))
SUPPORT = "|".join((
    r"^\s*(?:const|let|var)\s+[$\w]+(?:\s*:[^=]+)?\s*=",
    rf"^\s*(?:return|throw|yield){R}",
    r"^\s*(?:if|for|while|switch|catch)\s*\(",
    r"^\s*(?:import|export)\s+",
    r"^\s*(?:from\s+\S+\s+import|import\s+\S+)",
    rf"^\s*(?:pub\s+)?(?:struct|impl|trait|enum){R}",
))
RULE_ROW = r"^\s*\|?(?:\s*:?-+:?\s*\|)+\s*:?-+:?\s*\|?\s*$"


def is_search_line(line: Column) -> Column:
    """Whether the first token reads path:N or path-N with a separator behind, and the path looks like one."""
    token = F.split(F.regexp_replace(line, r"^\s+", ""), r"\s+", 2)[0]
    path = F.coalesce(F.nullif(F.regexp_extract(token, SEARCH_COLON, 1), F.lit("")), F.nullif(F.regexp_extract(token, SEARCH_DASH, 1), F.lit("")))
    return F.coalesce(path.rlike(r"[/\\.]"), F.lit(False))


def columns_of(line: Column, delimiter: str) -> Column:
    """Number of cells; delimiters aren't quoted here."""
    return F.char_length(line) - F.char_length(F.replace(line, F.lit(delimiter), F.lit(""))) + 1


def table_format(content: Column, first: Column | None = None) -> Column:
    """markdown, csv or tsv, or null if the payload is no table. The first twenty rows decide; first, the payload's first lines, mostly holds them."""
    def regular(rows: Column, delimiter: str) -> Column:
        n = columns_of(F.get(rows, F.lit(0)), delimiter)
        return (n >= 2) & F.forall(F.slice(rows, 2, 19), lambda r: columns_of(r, delimiter) == n)

    def of(rows: Column) -> Column:
        markdown = F.get(rows, F.lit(0)).contains("|") & F.get(rows, F.lit(1)).rlike(RULE_ROW)
        return F.when(F.size(rows) < 8, F.lit(None)).when(markdown, "markdown").when(regular(rows, ","), "csv").when(regular(rows, "\t"), "tsv")

    whole = F.filter(lines_of(content), not_blank)
    if first is None:
        return let(whole, of)
    return let(F.filter(F.slice(first, 1, 100), not_blank), lambda rows: F.when(F.size(rows) >= 20, of(rows)).otherwise(let(whole, of)))


def is_json(content: Column) -> Column:
    """Parses as JSON and begins as an object or an array. Unlike the JavaScript parser, repeated keys count as invalid."""
    return F.when(content.rlike(r"^\s*[\[{]"), F.try_parse_json(strip(content)).isNotNull()).otherwise(False)


def kind_of(c: Column) -> Column:
    """kind and confidence of a text as one struct: a single expression, as each projection on the way would copy the text once more."""
    some = lambda test, count: F.when(test, count).otherwise(0)
    sure = {"text": 0.0, "html": 0.98, "json": 1.0, "table": 0.95}

    def of(first: Column) -> Column:
        early = F.when(~not_blank(c), "text").when(F.contains(c, F.lit("<")) & c.rlike(HTML), "html").when(is_json(c), "json").when(table_format(c, first).isNotNull(), "table")
        return let(early, lambda kind: counted(first, kind))

    # each kind's lines are counted only if no kind before it is met
    def counted(first: Column, early: Column) -> Column:
        hundred = F.filter(F.slice(first, 1, 100), not_blank)
        two_hundred = F.filter(F.slice(first, 1, 200), not_blank)
        headers = some(early.isNull(), count_where(first, lambda x: x.rlike(DIFF_HEADER)))
        lines = lambda h: F.struct(h.alias("headers"), some(h > 0, count_where(first, lambda x: x.rlike(DIFF_CHANGE))).alias("changes"), some(early.isNull() & (h == 0), count_where(hundred, lambda x: x.rlike(DECLARATION))).alias("declared"))
        code = lambda d: some(d["declared"] > 0, count_where(hundred, lambda x: x.rlike(DECLARATION) | x.rlike(SUPPORT)))
        search = lambda d, k: F.when(early.isNull() & (d["headers"] == 0) & (k < 3), count_where(hundred, is_search_line) / F.nullif(F.size(hundred), F.lit(0)))
        log = lambda s: F.when(s < 0.3, count_where(two_hundred, lambda x: x.rlike(LOG)) / F.nullif(F.size(two_hundred), F.lit(0)))
        return let(headers, lambda h: let(lines(h), lambda d: let(code(d), lambda k: let(search(d, k), lambda s: let(log(s), lambda g: verdict(early, d, k, s, g))))))

    def verdict(early: Column, diff: Column, code: Column, search: Column, log: Column) -> Column:
        rules = [
            ("diff", diff["headers"] > 0, F.least(F.lit(1.0), 0.5 + diff["headers"] * 0.2 + diff["changes"] * 0.05)),
            ("code", code >= 3, F.least(F.lit(1.0), 0.5 + code * 0.03)),
            ("search", search >= 0.3, F.least(F.lit(1.0), 0.4 + search * 0.6)),
            ("log", log >= 0.1, F.least(F.lit(1.0), 0.3 + log * 0.5)),
        ]
        kind, conf = F.when(early.isNotNull(), early), F.when(early == "text", F.lit(sure["text"]))
        for name in ("html", "json", "table"):
            conf = conf.when(early == name, F.lit(sure[name]))
        for name, test, value in rules:
            kind, conf = kind.when(test, name), conf.when(test, value)
        return F.struct(kind.otherwise("text").alias("kind"), conf.otherwise(0.5).alias("confidence"))

    return let(F.slice(F.split(c, r"\r?\n", 501), 1, 500), of)


def with_kind(df: DataFrame, content: str = "content") -> DataFrame:
    """df with kind and confidence of its content column. No row leaves its partition."""
    d = df.withColumn("__kind", kind_of(F.col(content)))
    return d.withColumns({"kind": F.col("__kind.kind"), "confidence": F.col("__kind.confidence")}).drop("__kind")
