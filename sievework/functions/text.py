"""Column helpers and fixed patterns for text payloads. Word limits are ASCII: a letter beyond ASCII ends a word."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

L, R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"  # an ASCII word begins, ends



def any_word(alternatives: str) -> str:
    """A pattern of whole ASCII words; their first letters are tried before anything else, as most places fail there."""
    first = "".join(sorted({a[0].lower() for a in alternatives.split("|")}))
    return rf"(?=[{first}]){L}(?:{alternatives}){R}"


#: Fixed patterns of the compaction rules.
PROTECTED = rf"(?i){any_word('error|failed|failure|fatal|critical|exception|warning|security|traceback')}|(?=f){L}File\s+\"[^\"]+\",\s+line\s+\d+|^\s*at\s+.*[\w./\\-]+:\d+(?::\d+)?{R}"
SEVERE = "(?i)" + any_word("error|fail|failed|fatal|critical|exception|warn|warning|todo|fixme|hack|secret|password|security")
ABNORMAL = "(?i)" + any_word("error|failed|failure|fatal|critical|exception|warning|invalid|denied|blocked")
DIFF_PRIORITY = "(?i)" + any_word("error|exception|fail|failed|failure|fatal|critical|crash|panic|important|todo|fixme|bug|security|auth|password|secret|token")
KEYWORDS = ("error", "exception", "failed", "failure", "fail", "warning", "traceback", "assert", "todo", "fixme", "auth", "secret", "password", "security")
STRONG_ERRORS = ("error", "fail", "exception", "traceback", "fatal", "panic", "crash")
TRIVIAL_LINES = ("return", "pass", "else:", "try:", "except:", "finally:", "break", "continue", "});", "})", "],", "),", '"""', "'''", "...")
MARKERS = (
    r"<<ccr:[0-9a-fA-F]{12,24}(?![A-Za-z0-9_])[^>]*>>",
    r"(?i)\[[^\]]*(?:Retrieve more:|Retrieve original:)\s*hash=[0-9a-f]{24}[^\]]*\]",
    r"(?i)\[[^\]]*compressed[^\]]*hash=[0-9a-f]{24}[^\]]*\]",
)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row, whatever the optimizer does to the expression around it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines_of(content: Column) -> Column:
    return F.split(content, r"\r?\n", -1)


def strip(x: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(x, F.lit(" \t\n\x0b\f\r"))


def not_blank(x: Column) -> Column:
    return x.rlike(r"\S")


def count_where(xs: Column, test) -> Column:
    """Number of array elements for which test holds."""
    return F.size(F.filter(xs, test))


def has_marker(content: Column) -> Column:
    """Whether the text already holds a retrieval marker."""
    return content.rlike(MARKERS[0]) | content.rlike(MARKERS[1]) | content.rlike(MARKERS[2])


def valid_hash(h: Column) -> Column:
    return h.rlike("^[0-9a-fA-F]{24}$")


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 24)


def retrieve_marker(h: Column) -> Column:
    return F.concat(F.lit("[Retrieve more: hash="), h, F.lit("]"))


def strong_error(content: Column) -> Column:
    """Short text with at least two of the strong error words."""
    low = F.lower(content)
    hits = sum((low.contains(w).cast("int") for w in STRONG_ERRORS[1:]), low.contains(STRONG_ERRORS[0]).cast("int"))
    return (F.char_length(content) <= 8000) & (hits >= 2)


def query_words(query: Column, separator: str, longer_than: int) -> Column:
    """Lower-cased words of a query, between separators, longer than so many characters."""
    return F.filter(F.split(F.lower(query), separator), lambda w: F.char_length(w) > longer_than)


def clip(content: Column, limit: Column) -> Column:
    """content, or its beginning with a note, limit characters in all."""
    note = F.concat(F.lit("\n[truncated to "), limit.cast("string"), F.lit(" chars; use narrower query/range or mode=full]"))
    short = F.when(F.char_length(note) >= limit, F.left(F.regexp_replace(note, r"^\s+", ""), limit)).otherwise(F.concat(F.left(content, limit - F.char_length(note)), note))
    return F.when(limit.isNull() | (F.char_length(content) <= limit), content).otherwise(short)


def glob_regex(pattern: str) -> str:
    """A glob of tool names as an anchored regular expression without regard to case."""
    special = set(".+^${}()|[]\\")
    return "(?i)^" + "".join("\\" + c if c in special else ".*" if c == "*" else "." if c == "?" else c for c in pattern) + "$"
