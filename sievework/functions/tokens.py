"""Calibrated token estimate: class of a text, and a count by the class's rule. Built-in functions only."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sievework.functions.text import R, let, strip

#: Fixed patterns.
CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"
CODE_LINE = rf"(?m)^\s*(?:import|export|class|interface|type|function|def|fn|const|let|var|public|private|protected){R}"
HIGH_ENTROPY = r"^[A-Za-z0-9+/=_-]+$"
PROSE_TOKEN = r"[\p{L}\p{N}_]{1,4}|[^\s\p{L}\p{N}_]"  # a word of n characters gives n / 4 matches, rounded up
NAME, NUMBER = r"[A-Za-z_$][\w$]*+", r"\d++(?:\.\d++)?+"
#: Groups hold a character for each quarter of a name, a number, a character for each third of one (of numbers alone, apart), a mark; nothing of the rest.
NAME_QUARTERS = rf"(?:([A-Za-z_$])|\G(?<=[\w$])([\w$]))[\w$]{{0,3}}+|{NUMBER}|[^\w$]++"
NUMBERS = rf"{NAME}|({NUMBER})|[^\w$]++"
NUMBER_THIRDS = r"(?:(\d)|\G(?<=\d)(\.))[\d.]{0,2}+|\s++"
MARKS = rf"{NAME}|{NUMBER}|([^\s\w])|\s++"


def reads_like_code(x: Column) -> Column:
    """An arrow, a closing brace behind an opening one, or a line that begins with one of some words; the cheap signs first."""
    return F.contains(x, F.lit("=>")) | (F.contains(x, F.lit("{")) & F.contains(x.substr(F.instr(x, "{"), F.char_length(x)), F.lit("}"))) | x.rlike(CODE_LINE)


def token_class(x: Column) -> Column:
    n = F.char_length(x)
    cats = sum((x.rlike(p).cast("int") for p in ("[A-Z]", r"\d", "[+/=_-]")), x.rlike("[a-z]").cast("int"))
    ascii_only = F.octet_length(x) == n
    random = (n >= 32) & x.rlike(HIGH_ENTROPY) & (cats >= 3) & (F.size(F.array_distinct(F.split(x, ""))) / n >= 0.25)
    return F.when(n == 0, "prose").when(~ascii_only & (cjk_chars(x) / n >= 0.15), "cjk").when(random, "high_entropy").when(reads_like_code(x), "code").otherwise("prose")


def cjk_chars(x: Column) -> Column:
    return F.char_length(x) - F.char_length(F.regexp_replace(x, CJK, ""))


def prose_tokens(x: Column) -> Column:
    """A quarter of each word's length, rounded up; one for each other mark.

    Matches are counted as characters of a shorter text: regexp_count would list all of them, at many times the text's size.
    """
    return F.char_length(strip(F.regexp_replace(x, rf"(?:{PROSE_TOKEN})\s*+", "x"))).cast("long")


def cjk_tokens(x: Column) -> Column:
    return cjk_chars(x) + prose_tokens(F.regexp_replace(x, CJK, " "))


def code_tokens(x: Column) -> Column:
    """Names by quarters, numbers by thirds, other marks 0.6 each; summed in fifths so that no rounding creeps in."""
    count = lambda y, pattern, kept: F.char_length(F.regexp_replace(y, pattern, kept)).cast("long")
    wholes = count(x, NAME_QUARTERS, "$1$2") + count(F.regexp_replace(x, NUMBERS, "$1 "), NUMBER_THIRDS, "$1$2")
    return F.greatest(F.lit(1), F.ceil((5 * wholes + 3 * count(x, MARKS, "$1")) / 5))


def tokens(x: Column, klass: Column | None = None) -> Column:
    """Estimated tokens of a text; nulls stay null."""
    n = F.char_length(x)

    def by(k: Column) -> Column:
        counts = F.when(k == "cjk", cjk_tokens(x)).when(k == "code", code_tokens(x)).when(k == "high_entropy", F.greatest(F.lit(1), F.ceil(n * 5 / 8)))
        return counts.otherwise(F.greatest(F.lit(1), prose_tokens(x)))

    return F.when(x.isNull(), F.lit(None)).when(n == 0, F.lit(0)).otherwise(let(token_class(x), by) if klass is None else by(klass)).cast("long")


_CODE_LINE, _RANDOM = re.compile(CODE_LINE, re.ASCII), re.compile(HIGH_ENTROPY[1:-1] + r"\n?")
_MARK, _NAME, _DIGIT, _SPACE, _CJK, _OTHER = range(6)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Of code points below 65536 their class in prose and in code; _OTHER where Java and Python may know different characters or line ends."""
    prose = np.full(0x10000, _OTHER, dtype=np.uint8)
    for c in (*range(0x590), *range(0x2010, 0x2028), *range(0x202A, 0x2060), *range(0x20A0, 0x20C0), *range(0x3000, 0x3003)):
        prose[c] = _NAME if unicodedata.category(chr(c))[0] in "LN" or c == 95 else _MARK
    prose[[ord(c) for c in " \t\n\x0b\f\r"]] = _SPACE
    for first, last in ((0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FEF), (0xAC00, 0xD7A3)):
        prose[first : last + 1] = _CJK
    prose[[0x0D, 0x85]] = _OTHER
    code = prose.copy()
    code[128:][code[128:] != _OTHER] = _MARK
    code[48:58], code[ord("$")] = _DIGIT, _NAME
    return prose, code


_PROSE_CLASS, _CODE_CLASS = _classes()
#: Long texts are counted in pieces that end with a line.
PIECE = 1_000_000


def counted_tokens(x: str | None) -> int | None:
    """What tokens() gives, counted over arrays of code points; None for texts that are left to tokens(): null, random ones, those with rarer characters."""
    if x is None or "\r" in x or (len(x) >= 32 and _RANDOM.fullmatch(x)):
        return None
    if not x:
        return 0
    cjk = 0
    if not x.isascii():
        for p in _pieces(x):
            if int(p.max()) > 0xFFFF:
                return None
            count = np.bincount(_PROSE_CLASS[p], minlength=_OTHER + 1)
            if count[_OTHER]:
                return None
            cjk += int(count[_CJK])
    dense = cjk / len(x) >= 0.15
    code = not dense and ("=>" in x or ("{" in x and x.find("}", x.find("{")) >= 0) or _CODE_LINE.search(x) is not None)
    n = -(-sum(_fifths(p, code, dense) for p in _pieces(x)) // 5)
    return n + cjk if dense else max(1, n)


def _pieces(x: str) -> Iterator[np.ndarray]:
    """Code points of pieces that no word crosses."""
    at = 0
    while at < len(x):
        end = x.find("\n", at + PIECE) + 1 or len(x)
        yield np.frombuffer(x[at:end].encode("ascii"), dtype=np.uint8) if x.isascii() else np.frombuffer(x[at:end].encode("utf-32-le"), dtype=np.uint32)
        at = end


def _fifths(points: np.ndarray, code: bool, dense: bool) -> int:
    """Five times the tokens of a piece that no name or number crosses."""
    klass = (_CODE_CLASS if code else _PROSE_CLASS)[points]
    marks = int(np.count_nonzero(klass == _MARK))
    word = np.zeros(len(klass) + 2, dtype=np.int8)
    word[1:-1] = (klass == _NAME) | (klass == _DIGIT) | ((klass == _CJK) & (not dense))  # counted by itself where the text is dense with it
    edge = np.flatnonzero(np.diff(word))
    first, end = edge[::2], edge[1::2]  # runs of word characters
    if not code or not len(first):
        return 5 * (int(((end - first + 3) // 4).sum()) + (0 if code else marks)) + (3 * marks if code else 0)
    names = np.append(np.flatnonzero(klass == _NAME), len(klass))
    digits = np.minimum(names[np.searchsorted(names, first)], end) - first  # a run's digits before its name
    name = end - first - digits
    # a number goes on behind a dot if digits follow, but not behind a second one
    goes_on = (name[:-1] == 0) & (first[1:] == end[:-1] + 1) & (points[np.minimum(end[:-1], len(points) - 1)] == ord(".")) & (digits[1:] > 0)
    place = np.arange(len(goes_on))
    broken = np.maximum.accumulate(np.where(goes_on, -1, place))
    joined = np.append(goes_on & ((place - broken) % 2 == 1), False)
    length = np.where(joined, digits + 1 + np.append(digits[1:], 0), digits)
    length[1:][joined[:-1]] = 0
    return 5 * int(((name + 3) // 4).sum() + ((length + 2) // 3).sum()) + 3 * (marks - int(joined.sum()))


def counted_by(df: DataFrame, count, content: str = "content", out: str = "tokens") -> DataFrame:
    """df with tokens from a caller's own function of a text, in Arrow batches; a negative or odd count stops the query."""

    def run(batches):
        for b in batches:
            got = [None if t is None else count(t) for t in b.column(b.schema.get_field_index(content)).to_pylist()]
            if any(n is not None and (not isinstance(n, int) or isinstance(n, bool) or n < 0) for n in got):
                raise ValueError("a token count must be a whole number from zero on")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.int64())], names=[*b.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, LongType())]))
