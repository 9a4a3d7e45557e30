"""Bounded views of stored originals: query with context, range, head, tail, summary, full."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sievework.functions.text import clip, lines_of

#: Fixed defaults.
LINES, CONTEXT, MATCHES, CHARS = 80, 2, 20, 12_000
TITLE = "[Retrieve]"
MISS = "Entry not found or expired."
ADVICE = "Use mode=query with a specific query, mode=range with start_line/end_line, mode=head, mode=tail, or mode=full for the exact original."
NONE_FOUND = "No matching lines found. Try a broader query, mode=head, mode=tail, mode=range, or mode=full."


def folded(text: str) -> str:
    return unicodedata.normalize("NFKC", text).lower()


@F.pandas_udf(StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(folded, na_action="ignore")


def pretty_json(text: str) -> str:
    """JSON with its tokens as they are, one value a line; text that is no JSON comes back as it is."""
    compact = text.strip()
    try:
        json.loads(compact, parse_constant=lambda n: (_ for _ in ()).throw(ValueError(n)))
    except (ValueError, RecursionError):
        return text
    out: list[str] = []
    depth, i, n = 0, 0, len(compact)
    newline = lambda: "\n" + "  " * depth
    while i < n:
        c = compact[i]
        if c == '"':
            end = i + 1
            while compact[end] != '"':
                end += 2 if compact[end] == "\\" else 1
            out.append(compact[i : end + 1])
            i = end + 1
            continue
        if c in "[{":
            rest = compact[i + 1 :].lstrip() if compact[i + 1].isspace() else compact[i + 1 : i + 2]
            if rest[:1] in ("]", "}"):
                out.append(c + rest[0])
                i = compact.index(rest[0], i) + 1
                continue
            depth += 1
            out.append(c + newline())
        elif c in "]}":
            depth -= 1
            out.append(newline() + c)
        elif c == ",":
            out.append("," + newline())
        elif c == ":":
            out.append(": ")
        elif not c.isspace():
            out.append(c)
        i += 1
    return "".join(out)


@F.pandas_udf(StringType())
def _pretty(x: pd.Series) -> pd.Series:
    return x.map(pretty_json, na_action="ignore")


def _whole(c: Column, default) -> Column:
    return F.when(c.isNull(), default).otherwise(F.greatest(F.lit(1), F.floor(c).cast("int")))


def normalized(requests: DataFrame) -> DataFrame:
    """requests with mode, query, lines, context, max_matches, max_chars filled in: a given mode, else range, query, the entry's default."""
    query = F.nullif(F.trim("query"), F.lit(""))
    ranged = F.col("start_line").isNotNull() | F.col("end_line").isNotNull()
    default_mode = F.coalesce("default_mode", F.lit("summary"))
    plain = F.col("mode").isNull() & ~ranged & query.isNull()
    mode = F.coalesce("mode", F.when(ranged, "range").when(query.isNotNull(), "query").otherwise(default_mode))
    own = F.when(F.col("default_max_chars").isNull(), F.when(default_mode != "full", CHARS)).otherwise(_whole(F.col("default_max_chars"), CHARS))
    chars = F.when(F.col("max_chars").isNotNull(), _whole(F.col("max_chars"), 1)).when(plain, own).when(mode != "full", CHARS)
    return requests.withColumns({
        "mode": mode, "query": query, "lines": _whole(F.col("lines"), LINES), "context": F.greatest(F.lit(0), F.coalesce(F.floor("context").cast("int"), F.lit(CONTEXT))),
        "max_matches": _whole(F.col("max_matches"), MATCHES), "max_chars": chars.cast("int"),
    })


def numbered(lines: Column, first: Column, last: Column) -> Column:
    """Lines first to last as 'N: line'."""
    return F.transform(F.slice(lines, first, F.greatest(F.lit(0), last - first + 1)), lambda x, i: F.concat((first + i).cast("string"), F.lit(": "), x))


def retrieve(requests: DataFrame) -> DataFrame:
    """requests joined with their entries (see store.latest), with output: the bounded view that each asks for.

    Within the row; only texts that need it - JSON on one line, queries or texts beyond ASCII - pass through Python.
    """
    d = normalized(requests)
    one_line = (F.col("strategy") == "json") & ~F.col("content").contains("\n")
    d = d.where(one_line).withColumn("view", _pretty("content")).unionByName(d.where(~F.coalesce(one_line, F.lit(False))).withColumn("view", F.col("content")))
    d = d.withColumn("source", F.when(F.col("view").contains("\n") & (F.col("view") != F.col("content")), "pretty-json").otherwise("original"))
    d = d.withColumn("view", F.when(F.col("source") == "original", F.col("content")).otherwise(F.col("view")))
    asked = (F.col("mode") == "query") & F.col("content").isNotNull()
    ascii_only = ~F.concat("view", F.coalesce("query", F.lit(""))).rlike(r"[^\x00-\x7F]")
    quick = d.where(~asked | ascii_only).withColumn("low", F.lower("view")).withColumn("q", F.lower(F.coalesce("query", F.lit(""))))
    slow = d.where(asked & ~ascii_only).withColumn("low", _nfkc("view")).withColumn("q", _nfkc(F.coalesce("query", F.lit(""))))
    d = quick.unionByName(slow)
    # NFKC keeps line breaks, so places in both arrays are the same
    d = d.withColumn("l", lines_of(F.col("view"))).withColumn("n", F.size("l")).withColumn("ll", lines_of(F.col("low")))
    words = F.filter(F.regexp_extract_all("q", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike(r"[^\x00-\x7F]") | (F.char_length(w) >= 3))
    d = d.withColumn("w", words).withColumn("hits", F.slice(F.filter(F.transform("ll", lambda x, i: F.when(F.exists("w", lambda w: F.contains(x, w)), i)), lambda i: i.isNotNull()), 1, F.col("max_matches")))
    near = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda i: F.sequence(F.greatest(F.lit(0), i - F.col("context")), F.least(F.col("n") - 1, i + F.col("context")))))))
    d = d.withColumn("near", F.when(F.size("hits") > 0, near).otherwise(F.array().cast("array<int>")))
    head = lambda detail: F.array(
        F.lit(TITLE), F.concat(F.lit("hash: "), F.col("hash")), F.concat(F.lit("mode: "), F.col("mode")), F.concat(F.lit("strategy: "), F.col("strategy")), F.concat(F.lit("original tokens: "), F.col("original_tokens").cast("string")),
        F.concat(F.lit("original chars: "), F.char_length("content").cast("string")), detail, F.lit(""),
    )
    lined = F.concat(F.col("source"), F.lit(" lines: "), F.col("n").cast("string"))
    span = lambda a, b: F.concat(F.lit("lines: "), a.cast("string"), F.lit("-"), b.cast("string"), F.lit(" | "), lined)
    n, l = F.col("n"), F.col("l")
    start = _whole(F.col("start_line"), F.lit(1))
    end = _whole(F.col("end_line"), start + F.col("lines") - 1)
    a = F.least(start, n)
    b = F.greatest(a, F.least(end, n))
    until, since = F.least(F.col("lines"), n), F.greatest(F.lit(1), n - F.col("lines") + 1)
    preview = F.concat(numbered(l, F.lit(1), F.least(F.lit(5), n)), F.when(n > 10, F.concat(F.array(F.lit("...")), numbered(l, F.greatest(F.lit(1), n - 4), n))).otherwise(F.array().cast("array<string>")))
    summary = F.concat(
        head(lined), F.array(F.concat(F.lit("tool: "), F.coalesce("tool", F.lit("unknown"))), F.concat(F.lit("call: "), F.coalesce(F.col("call_id").cast("string"), F.lit("unknown"))), F.concat(F.lit("compressed tokens: "), F.col("compressed_tokens").cast("string")),
        F.concat(F.lit("retrieval count: "), F.col("retrieval_count").cast("string")), F.lit(""), F.lit(ADVICE), F.lit(""), F.lit("Preview:")), preview,
    )
    about = F.concat(F.lit("query: "), F.coalesce("query", F.lit("")), F.lit(" | matches: "), F.size("hits").cast("string"))
    query = F.when(F.size("near") == 0, F.concat(head(F.concat(about, F.lit(" | "), lined)), F.array(F.lit(NONE_FOUND)))).otherwise(
        F.concat(head(F.concat(about, F.lit(" | returned lines: "), F.size("near").cast("string"), F.lit(" | "), lined)), F.transform("near", lambda i: F.concat((i + 1).cast("string"), F.lit(": "), F.get(l, i))))
    )
    parts = F.when(F.col("mode") == "summary", summary).when(F.col("mode") == "query", query).when(F.col("mode") == "range", F.concat(head(span(start, end)), numbered(l, a, b))).when(F.col("mode") == "head", F.concat(head(span(F.lit(1), until)), numbered(l, F.lit(1), until))).otherwise(F.concat(head(span(since, n)), numbered(l, since, n)))
    out = F.when(F.col("content").isNull(), MISS).when(F.col("mode") == "full", clip(F.col("content"), F.col("max_chars"))).otherwise(clip(F.array_join(parts, "\n"), F.col("max_chars")))
    return d.withColumn("output", out).drop("view", "source", "low", "q", "l", "n", "ll", "w", "hits", "near")
