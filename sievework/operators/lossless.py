"""Folds that can be undone: runs of equal lines, and search results under headings. Within the row, without a shuffle."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sievework.functions.text import let

GREP_ROW = r"^([^\n:]+):(\d+):(.*)$"
RUN_NOTE = re.compile(r"\.\.\. \(repeated (\d+) times\)")
NUMBERED = re.compile(r"(\d+):(.*)")
TABLE_HEAD = re.compile(r"\[(\d+)\](\[[^\n]*\])")
MAX_RUN = 250_000
MIN_TABLE_SAVINGS = 0.3


def body_lines(text: Column) -> Column:
    """Lines without the empty one behind a final newline."""
    return F.split(F.when(text.endswith("\n"), F.left(text, F.char_length(text) - 1)).otherwise(text), "\n", -1)


def _joined(lines: Column, text: Column) -> Column:
    return F.concat(F.array_join(lines, "\n"), F.when(text.endswith("\n"), "\n").otherwise(""))


def runs_folded(t: Column) -> Column:
    """The text with each run of equal lines as the line and a note of its length."""

    def starts(l: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(l) - 1), lambda i: (i == 0) | (F.get(l, i) != F.get(l, i - 1)))

    def run(l: Column, s: Column):
        def one(at: Column, k: Column) -> Column:
            n = F.coalesce(F.get(s, k + 1), F.size(l)) - at
            return F.when(n >= 2, F.array(F.get(l, at), F.format_string("... (repeated %d times)", n))).otherwise(F.array(F.get(l, at)))

        return one

    return F.when(t == "", t).otherwise(let(body_lines(t), lambda l: let(starts(l), lambda s: _joined(F.flatten(F.transform(s, run(l, s))), t))))


def headings_folded(t: Column) -> Column:
    """The text with path:line:content rows as the path once, then line:content; other lines end a path's group."""

    def row(l: Column):
        def one(x: Column, i: Column) -> Column:
            rest = F.substr(x["line"], F.char_length(x["path"]) + 2)
            again = F.coalesce(F.get(l, i - 1)["path"] == x["path"], F.lit(False))
            return F.when(x["path"].isNull(), F.array(x["line"])).when(again, F.array(rest)).otherwise(F.array(x["path"], rest))

        return one

    parsed = F.transform(body_lines(t), lambda x: F.struct(x.alias("line"), F.nullif(F.regexp_extract(x, GREP_ROW, 1), F.lit("")).alias("path")))
    return F.when(t == "", t).otherwise(let(parsed, lambda l: _joined(F.flatten(F.transform(l, row(l))), t)))


def with_runs_folded(df: DataFrame, text: str = "content", out: str = "folded") -> DataFrame:
    return df.withColumn(out, runs_folded(F.col(text)))


def with_headings(df: DataFrame, text: str = "content", out: str = "folded") -> DataFrame:
    return df.withColumn(out, headings_folded(F.col(text)))


def _split(text: str) -> tuple[list[str], str]:
    return (text[:-1].split("\n"), "\n") if text.endswith("\n") else (text.split("\n"), "")


def unfold_runs(text: str) -> str:
    """Inverse of the run fold."""
    if not text:
        return text
    lines, tail = _split(text)
    out: list[str] = []
    i = 0
    while i < len(lines):
        note = RUN_NOTE.fullmatch(lines[i + 1]) if i + 1 < len(lines) else None
        n = int(note[1]) if note else 0
        if 2 <= n <= MAX_RUN:
            out += [lines[i]] * n
            i += 2
        else:
            out.append(lines[i])
            i += 1
    return "\n".join(out) + tail


#: GREP_ROW for a single line: in Java a dot takes no line end of any kind, and one may follow.
_GREP_LINE = re.compile(r"([^\n:]+):[0-9]+:[^\r\x85\u2028\u2029]*[\r\x85\u2028\u2029]?")


def fold_headings(text: str) -> str:
    """What headings_folded() gives, for payloads that are in Python anyway: the folded text needn't be made and sent beside them."""
    if not text:
        return text
    lines, tail = _split(text)
    out: list[str] = []
    path = None
    for line in lines:
        m = _GREP_LINE.fullmatch(line)
        if m is None:
            out.append(line)
            path = None
            continue
        if m[1] != path:
            path = m[1]
            out.append(path)
        out.append(line[len(path) + 1 :])
    return "\n".join(out) + tail


def unfold_headings(text: str) -> str:
    """Inverse of the heading fold: a line without a number whose next line has one is a heading."""
    if not text:
        return text
    lines, tail = _split(text)
    numbered = [bool(NUMBERED.fullmatch(x)) for x in lines]
    out: list[str] = []
    path = ""
    for i, line in enumerate(lines):
        if numbered[i] and path:
            out.append(f"{path}:{line}")
        elif not numbered[i] and i + 1 < len(lines) and numbered[i + 1]:
            path = line
        else:
            path = ""
            out.append(line)
    return "\n".join(out) + tail


def _strict(name: str):
    raise ValueError(name)


def number_text(x: float) -> str:
    """A number as JavaScript writes it."""
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    r = repr(x)
    if "e" not in r:
        return r
    m, e = r.split("e")
    k = int(e)
    if -7 <= k < 0:
        digits = m.replace(".", "").replace("-", "")
        return ("-" if x < 0 else "") + "0." + "0" * (-k - 1) + digits
    return f"{m}e{'+' if k > 0 else '-'}{abs(k)}"


class OddNumber(Exception):
    """A number that Python and JavaScript write in different ways."""


def _real(x: str) -> float | int:
    v = float(x)
    if v.is_integer() and abs(v) < 1e21:
        return int(v)
    if 1e-4 <= abs(v) < 1e21:
        return v
    raise OddNumber(x)


def _whole(x: str) -> float | int:
    return int(x) if len(x) < 16 else _real(x)


_read = json.JSONDecoder(parse_int=_whole, parse_float=_real, parse_constant=_strict).decode
_encoder = json.JSONEncoder(ensure_ascii=False, check_circular=False, separators=(",", ":"))
_chunks = json.encoder.c_make_encoder and json.encoder.c_make_encoder(None, _encoder.default, json.encoder.encode_basestring, None, ":", ",", False, False, True)


def _write(v) -> str:
    """encode() makes its encoder anew each time, which for a short value takes most of the time."""
    return "".join(_chunks(v, 0)) if _chunks else _encoder.encode(v)


def read_json(text: str):
    """The JSON's value, and what writes it and its parts as JavaScript does: the library itself where all numbers allow it."""
    try:
        return _read(text), _write
    except OddNumber:
        return parse_json(text), dump_json


def parse_json(text: str):
    """JSON as JavaScript reads it: all numbers are doubles, no NaN; of repeated keys the last counts."""
    return json.loads(text, parse_int=float, parse_constant=_strict)


def dump_json(v) -> str:
    """Compact JSON, as JSON.stringify writes it."""
    if isinstance(v, str):
        return json.dumps(v, ensure_ascii=False)
    if isinstance(v, dict):
        return "{" + ",".join(f"{dump_json(k)}:{dump_json(x)}" for k, x in v.items()) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(dump_json, v)) + "]"
    return "null" if v is None else "true" if v is True else "false" if v is False else number_text(v)


def fold_table(text: str) -> str:
    """An array of records with the same scalar keys in the same order as a header and a row of values for each; else the text."""
    try:
        rows, write = read_json(text)
    except (ValueError, RecursionError):
        return text
    if not isinstance(rows, list) or len(rows) < 2 or not all(isinstance(r, dict) for r in rows):
        return text
    keys = list(rows[0])
    if len(keys) < 2 or any(list(r) != keys or any(isinstance(v, (list, dict)) for v in r.values()) for r in rows):
        return text
    return "\n".join([f"[{len(rows)}]{write(keys)}", *(write(list(r.values()))[1:-1] for r in rows)])


def unfold_table(text: str) -> str | None:
    """Compact JSON of a folded table; None if it is none."""
    head, _, rest = text.partition("\n")
    m = TABLE_HEAD.fullmatch(head)
    if not m:
        return None

    def by(read, write) -> str | None:
        try:
            keys = read(m[2])
            rows = [read(f"[{x}]") for x in rest.split("\n")]
        except ValueError:
            return None
        if len(rows) != int(m[1]) or len(set(keys)) != len(keys) or any(len(r) != len(keys) for r in rows):
            return None
        return write([dict(zip(keys, r)) for r in rows])

    try:
        return by(_read, _write)
    except OddNumber:
        return by(parse_json, dump_json)


def fold(text: str, kind: str) -> str:
    """The fold that a kind allows, if it is shorter and comes back to the same text; else the text."""
    if kind == "json":
        out = fold_table(text)
        if out == text or len(out) > len(text) * (1 - MIN_TABLE_SAVINGS):
            return text
        value, write = read_json(text)
        return out if unfold_table(out) == write(value) else text
    return text


def not_undone(df: DataFrame, kind: str, id_col: str = "id", text: str = "content", folded: str = "folded") -> DataFrame:
    """id of the rows whose folded text doesn't come back to the text."""
    back = unfold_headings if kind == "search" else unfold_runs
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[back(f) != t for f, t in zip(b["f"], b["t"])], ["id"]]

    return df.select(F.col(id_col).alias("id"), F.col(text).alias("t"), F.col(folded).alias("f")).mapInPandas(run, f"id {id_type}")


@F.pandas_udf(StringType())
def table_folded(x: pd.Series) -> pd.Series:
    return x.map(lambda t: fold(t, "json"), na_action="ignore")


def with_native_folds(df: DataFrame, kind: str = "kind", text: str = "content") -> DataFrame:
    """df with folded: the run or heading fold that the kind allows, null for other kinds. CASE is lazy for built-in functions."""
    return df.withColumn("folded", F.when(F.col(kind).isin("log", "text"), runs_folded(F.col(text))).when(F.col(kind) == "search", headings_folded(F.col(text))))


def checked(kind: str, text: str, folded: str | None) -> str:
    """The fold of a text, if it is shorter and comes back to the text; else the text itself."""
    if kind == "json":
        return fold(text, kind)
    if folded is None or len(folded) >= len(text):
        return text
    back = unfold_headings(folded) if kind == "search" else unfold_runs(folded)
    return folded if back == text else text


def parts(batch: pa.RecordBatch, text: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have at most so many bytes together, or of one row: what lies in Python at once, and goes back at once."""
    at = held = 0
    for i, n in enumerate(pc.binary_length(batch.column(batch.schema.get_field_index(text))).to_pylist()):
        if held + (n or 0) > most and i > at:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n or 0
    yield batch.slice(at)


def compact(df: DataFrame, kind: str = "kind", text: str = "content") -> DataFrame:
    """df with lossless: the text folded as its kind allows, if that is shorter and can be undone; else the text itself."""
    d = with_native_folds(df, kind, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in parts(whole, text)):
            ks, ts, fs = (b.column(b.schema.get_field_index(n)).to_pylist() for n in (kind, text, "folded"))
            kept = [i for i, n in enumerate(b.schema.names) if n != "folded"]
            found = (None if t is None else checked(k, t, f) for k, t, f in zip(ks, ts, fs))
            out = pa.array([None if x == t else x for x, t in zip(found, ts)], pa.string())  # what stays as it is needn't travel twice
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), out], names=[*(b.schema.names[i] for i in kept), "lossless"])

    return d.mapInArrow(run, StructType([*df.schema.fields, StructField("lossless", StringType())])).withColumn("lossless", F.coalesce("lossless", F.col(text)))
