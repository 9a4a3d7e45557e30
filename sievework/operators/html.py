"""HTML pages to text, and the facts of a payload that a shorter form must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import PROTECTED, R, let, lines_of, not_blank, strip
from sievework.operators.lines import segments_of

NOISE = ("script", "style", "svg", "noscript", "nav", "footer", "aside", "form")
DECLARED = rf"^(?:import{R}|from\s+\S+\s+import{R}|export{R}|(?:public|private|protected|static|abstract|async|pub\s+)*\s*(?:function|class|interface|type|enum|namespace|def|fn|struct|trait|func){R})"
LINK = r"(?is)<a\b[^>]*href\s*=\s*[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"


def squeeze(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"\s+", " "))


def decode(x: Column) -> Column:
    """The six entities that matter, in the order that leaves no new ones behind but those of an ampersand's own text."""
    for pattern, to in ((r"(?i)&nbsp;", " "), (r"(?i)&amp;", "&"), (r"(?i)&lt;", "<"), (r"(?i)&gt;", ">"), (r"(?i)&quot;", '"'), (r"(?i)&#39;|&apos;", "'")):
        x = F.regexp_replace(x, pattern, to)
    return x


def plain(x: Column) -> Column:
    return squeeze(decode(F.regexp_replace(x, r"<[^>]+>", " ")))


def title(html: Column) -> Column:
    return plain(F.regexp_extract(html, rf"(?is)<title{R}[^>]*>(.*?)</title>", 1))


def main_part(html: Column) -> Column:
    """The page without comments and noise: its first main or article part, else its body, else all."""
    clean = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), rf"(?is)<({'|'.join(NOISE)})\b[^>]*>.*?</\1>", "")
    part = F.nullif(F.regexp_extract(clean, r"(?is)<(main|article)\b[^>]*>(.*?)</\1>", 2), F.lit(""))
    body = F.nullif(F.regexp_extract(clean, r"(?is)<body\b[^>]*>(.*?)</body>", 1), F.lit(""))
    return F.coalesce(part, body, clean)


def linked(x: Column) -> Column:
    """Anchors as [label](target). A label's markup goes with all other markup; white space in it is squeezed with its line's."""
    return F.regexp_replace(x, LINK, "[$2]($1)")


def text_lines(html: Column) -> Column:
    """The lines of a page's text, without blank ones."""
    x = linked(main_part(html))
    for pattern, to in ((rf"(?i)</?(?:table|thead|tbody){R}[^>]*>", "\n"), (rf"(?i)</?tr{R}[^>]*>", "\n"), (rf"(?i)<(?:th|td){R}[^>]*>", ""), (r"(?i)</(?:th|td)>", " | "), (r"(?i)<br\s*/?>", "\n"), (rf"(?i)</?(?:h[1-6]|p|li|ul|ol|section|div|pre|blockquote){R}[^>]*>", "\n"), (r"<[^>]+>", " ")):
        x = F.regexp_replace(x, pattern, to)
    each = lambda y: strip(F.regexp_replace(F.regexp_replace(y, r"\s+", " "), r"^\s*\|\s*|\s*\|\s*$", ""))
    return F.filter(F.transform(lines_of(decode(x)), each), lambda y: y != "")


def to_text(df: DataFrame, id_col: str = "id", content: str = "content") -> DataFrame:
    """id, title, lines, output (title and lines), of pages with 500 characters or more that hold markup."""
    c = F.col(content)
    d = df.where((F.char_length(c) >= 500) & c.rlike(r"(?is)<[a-z].*>")).select(F.col(id_col).alias("id"), title(c).alias("title"), text_lines(c).alias("lines"))
    return d.withColumn("output", F.array_join(F.when(F.col("title") != "", F.concat(F.array("title"), F.col("lines"))).otherwise(F.col("lines")), "\n"))


def page_text(html: Column) -> Column:
    """The page's title and lines as one text, null if it has no lines."""
    ls = text_lines(html)
    return F.when(F.size(ls) > 0, F.array_join(F.concat(F.when(title(html) != "", F.array(title(html))).otherwise(F.array().cast("array<string>")), ls), "\n"))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?i)href\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1))


def may_hold_facts(content: Column) -> Column:
    """Whether some line, segment or part of a page may be protected: plain words are looked for, as most payloads have none of them."""

    def of(small: Column) -> Column:
        out = F.contains(small, F.lit("file")) & small.rlike(r"file\s+\"")
        for w in ("error", "fail", "fatal", "critical", "exception", "warning", "security", "traceback"):
            out = F.contains(small, F.lit(w)) | out
        return out | small.rlike(r"(?m)^\s*at\s|[.!?>]\s*at\s")

    return let(F.lower(content), of)


def protected_facts(kind: Column, content: Column) -> Column:
    """What a shorter form must hold: lines, segments or parts that the kind protects. JSON's facts need a parser and are left to it."""
    hit = lambda x: x.rlike(PROTECTED)
    none = F.array().cast("array<string>")
    some = may_hold_facts(content)
    trimmed = F.filter(F.transform(lines_of(content), strip), lambda x: x != "")
    rows = F.filter(lines_of(content), not_blank)
    head = squeeze(F.regexp_replace(F.regexp_extract(content, rf"(?is)<title{R}[^>]*>(.*?)</title>", 1), r"<[^>]+>", " "))
    nodes = F.when(~some, none).otherwise(F.filter(F.transform(F.regexp_extract_all(content, F.lit(r">([^<>]+)<"), F.lit(1)), squeeze), lambda x: (x != "") & hit(x)))
    page = F.array_distinct(F.filter(F.concat(F.array(head), links(content), nodes), lambda x: x != ""))
    return (
        F.when(kind == "json", none)
        .when((kind == "code") & ~some, F.filter(trimmed, lambda x: x.rlike(DECLARED)))
        .when(kind == "code", F.filter(trimmed, lambda x: x.rlike(DECLARED) | hit(x)))
        .when((kind == "table") & ~some, F.slice(rows, 1, 2))
        .when(kind == "table", let(rows, lambda r: F.concat(F.slice(r, 1, 2), F.filter(F.slice(r, 3, F.greatest(F.lit(1), F.size(r))), hit))))
        .when(kind == "html", page)
        .when(~some, none)
        .when(kind == "diff", F.filter(lines_of(content), hit))
        .when(kind == "text", F.filter(segments_of(content), hit))
        .otherwise(F.filter(F.transform(F.filter(lines_of(content), hit), strip), lambda x: x != ""))
    )


#: From so many facts on, those that are whole lines of a text are found by one look at its lines.
MANY_FACTS = 100


def lost_fact(facts: Column, text: Column) -> Column:
    """Whether some fact doesn't stand in the text. Most facts are lines of it, so the text is searched from its start for the others only."""
    missing = lambda fs: F.exists(fs, lambda f: ~F.contains(text, f))
    lines = lines_of(text)
    return let(facts, lambda fs: F.when(F.size(fs) < MANY_FACTS, missing(fs)).otherwise(missing(F.array_except(fs, F.concat(lines, F.transform(lines, strip))))))


def gate(kind: Column, original_tokens: Column, candidate: Column, candidate_tokens: Column, facts: Column) -> Column:
    """accepted, or why a candidate is not: empty, broken structure, a lost fact, no fewer tokens - in this order."""
    ls = lines_of(candidate)
    diff_ok = F.exists(ls, lambda x: x.startswith("diff --git ")) & F.exists(ls, lambda x: x.rlike(r"^@@@?\s")) & F.exists(ls, lambda x: x.rlike(r"^[+-](?![+-]{2})"))
    broken = ((kind == "diff") & ~diff_ok) | ((kind == "json") & F.try_parse_json(candidate).isNull())
    return F.when(~not_blank(candidate), "empty_candidate").when(broken, "invalid_structure").when(lost_fact(facts, candidate), "protected_fact_lost").when(candidate_tokens >= original_tokens, "no_token_savings").otherwise("accepted")
