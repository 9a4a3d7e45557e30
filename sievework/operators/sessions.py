"""Session operators: repeated outputs, folded spans, states of file reads, live context parts, intent, pending calls."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import TRIVIAL_LINES, content_hash, has_marker, lines_of, strip
from sievework.functions.tokens import tokens

#: Fixed limits.
MAX_FINGERPRINTS, MIN_FINGERPRINTS, SIMILAR, SESSION_ENTRIES = 256, 8, 0.9, 32
SPAN_LINES, SPAN_CHARS, ANCHORS = 3, 40, 16
READ_TOOLS, WRITE_TOOLS = ("read",), ("edit", "write", "multiedit", "notebookedit", "apply_patch")
INTENT_CHARS = 2000


# --- repetition


def exact_repeats(outputs: DataFrame) -> DataFrame:
    """outputs (session_id, seq, content) with of_seq: the newest earlier output of the session with the same content, else null."""
    d = outputs.withColumn("hash", content_hash(F.col("content")))
    return d.withColumn("of_seq", F.lag("seq").over(Window.partitionBy("session_id", "hash").orderBy("seq")))


def fingerprints(content: Column) -> Column:
    """The least hashes of the distinct lines, white space squeezed, blank ones left out."""
    ls = F.filter(F.transform(lines_of(content), lambda x: strip(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return F.slice(F.array_sort(F.array_distinct(F.transform(ls, lambda x: F.xxhash64(x)))), 1, MAX_FINGERPRINTS)


def similar_repeats(outputs: DataFrame) -> DataFrame:
    """(session_id, seq) with of_seq and similarity of the most similar earlier output, the newest of equals, at least SIMILAR.

    A join on fingerprints: outputs meet only where they share lines, and of a line only the SESSION_ENTRIES outputs before.
    """
    d = outputs.select("session_id", "seq", fingerprints(F.col("content")).alias("f")).where(F.size("f") >= MIN_FINGERPRINTS)
    line = d.select("session_id", "seq", F.size("f").alias("n"), F.explode("f").alias("h"))
    before = F.collect_list(F.struct("seq", "n")).over(Window.partitionBy("session_id", "h").orderBy("seq").rowsBetween(-SESSION_ENTRIES, -1))
    pairs = line.withColumn("before", before).withColumn("o", F.explode("before")).groupBy("session_id", "seq", "n", F.col("o.seq").alias("of_seq"), F.col("o.n").alias("m")).agg(F.count("*").alias("both"))
    scored = pairs.withColumn("similarity", F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).where(F.col("similarity") >= SIMILAR)
    best = Window.partitionBy("session_id", "seq").orderBy(F.desc("similarity"), F.desc("of_seq"))
    return scored.withColumn("r", F.row_number().over(best)).where("r = 1").select("session_id", "seq", "of_seq", "similarity")


def repeat_note(similarity: Column) -> Column:
    """What stands for a repeated output."""
    return F.when(similarity >= 1, "[Repeated tool output: exact match to an earlier result in this session]").otherwise(F.concat(F.lit("[Repeated tool output: "), F.round(similarity * 100).cast("int").cast("string"), F.lit("% similar to an earlier result in this session]")))


# --- spans


def anchor_lines(blocks: DataFrame) -> DataFrame:
    """blocks (session_id, turn, text) as lines that can anchor a span: idx, number, key, content; short and common ones left out."""
    rows = blocks.select("session_id", "turn", F.posexplode(F.split("text", "\n", -1)).alias("idx", "line"))
    x = F.col("line")
    marked = r"(?s)^(\d+)([:\t])(.*)$"
    rows = rows.withColumns({
        "number": F.expr("try_cast(nullif(regexp_extract(line, '(?s)^(\\\\d+)[:\\\\t]', 1), '') AS BIGINT)"),
        "key": F.when(x.rlike(marked), F.concat(F.regexp_extract(x, marked, 2), F.regexp_extract(x, marked, 3))).otherwise(x),
        "content": F.when(x.rlike(marked), F.regexp_extract(x, marked, 3)).otherwise(x),
    })
    bare = strip(F.col("content"))
    return rows.where((F.char_length(bare) >= 4) & ~bare.isin(*TRIVIAL_LINES))


def span_anchors(blocks: DataFrame) -> DataFrame:
    """Where each line could begin a fold: the first ANCHORS places of its key in earlier turns of its session."""
    a = anchor_lines(blocks)
    early = a.withColumn("place", F.row_number().over(Window.partitionBy("session_id", "key").orderBy("turn", "idx"))).where(F.col("place") <= ANCHORS)
    e = early.select("session_id", "key", F.col("turn").alias("of_turn"), F.col("idx").alias("of_idx"), F.col("number").alias("of_number"))
    return a.join(e, ["session_id", "key"]).where("of_turn < turn").select("session_id", "turn", "idx", "of_turn", "of_idx", (F.col("number") - F.col("of_number")).alias("line_delta"))


_NUMBERED = re.compile(r"(\d+)([:\t])(.*)", re.S)


def _parsed(line: str) -> tuple[int | None, str, str]:
    m = _NUMBERED.fullmatch(line)
    return (int(m[1]), m[2] + m[3], m[3]) if m else (None, line, line)


def fold_spans(blocks: list[tuple[int, str, bool]], min_lines: int = SPAN_LINES, min_chars: int = SPAN_CHARS, anchors: int = ANCHORS) -> tuple[list[str], int, int]:
    """Texts of a session's blocks (turn, text, protected), in order, with spans that an earlier block holds replaced by pointers.

    Greedy from left to right; of an anchor's places the one with the longest match, the earliest of equals. Folded lines
    anchor nothing. Also the numbers of spans and of lines folded.
    """
    seen: list[list[tuple[int | None, str, str, str] | None]] = []
    where: dict[str, list[tuple[int, int]]] = {}
    out: list[str] = []
    spans = folded = 0
    for turn, text, protected in blocks:
        lines = [(*_parsed(x), x) for x in text.split("\n")]
        here: list = list(lines)
        shown: list[str] = []
        i = 0
        while i < len(lines):
            best = (0, 0, 0)
            for b, j in () if protected else where.get(lines[i][1], ()):
                n, delta = 0, None
                for mine, theirs in zip(lines[i:], seen[b][j:]):
                    if theirs is None or mine[1] != theirs[1]:
                        break
                    if mine[0] is not None and theirs[0] is not None:
                        step = mine[0] - theirs[0]
                        if delta is not None and step != delta:
                            break
                        delta = step
                    elif mine[3] != theirs[3]:
                        break
                    n += 1
                if n > best[0]:
                    best = (n, b, delta or 0)
            n, b, delta = best
            whole = "\n".join(x[3] for x in lines[i : i + n])
            note = _pointer([x[2] for x in lines[i : i + n]], blocks[b][0], delta) if n >= min_lines and len(whole) >= min_chars else whole
            if len(note) < len(whole):
                shown.append(note)
                here[i : i + n] = [None] * n
                spans, folded, i = spans + 1, folded + n, i + n
            else:
                shown.append(lines[i][3])
                i += 1
        for i, x in enumerate(here):
            if x is not None and len(x[2].strip()) >= 4 and x[2].strip() not in TRIVIAL_LINES:
                places = where.setdefault(x[1], [])
                if len(places) < anchors:
                    places.append((len(seen), i))
        seen.append(here)
        out.append(text if protected else "\n".join(shown))
    return out, spans, folded


def _pointer(span: list[str], turn: int, delta: int) -> str:
    first = next((x.strip() for x in span if x.strip()), "")
    first = first if len(first) <= 20 else first[:17] + "..."
    return f"[↑{len(span)}L same as msg {turn}{f' {delta:+d}L' if delta else ''}: {json.dumps(first, ensure_ascii=False)}]"


def with_spans_folded(blocks: DataFrame) -> DataFrame:
    """blocks (session_id, turn, text, protected) with folded, and the session's spans and lines. A session goes to one task; its texts are bounded by its context."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn", kind="stable")
        texts, spans, lines = fold_spans(list(zip(pdf["turn"].tolist(), pdf["text"].fillna("").tolist(), pdf["protected"].fillna(False).tolist())))
        return pdf[["session_id", "turn"]].assign(folded=texts, spans=spans, lines=lines)

    types = {f.name: f.dataType.simpleString() for f in blocks.schema}
    return blocks.select("session_id", "turn", "text", "protected").groupBy("session_id").applyInPandas(run, f"session_id {types['session_id']}, turn {types['turn']}, folded string, spans long, lines long")


# --- file reads


def read_states(ops: DataFrame) -> DataFrame:
    """The reads among ops (session_id, seq, kind, path, offset_, limit_) with state: stale, superseded or fresh.

    Stale: a later write to the path. Superseded: a later full read, or one whose range covers this one's. A read without
    offset and limit is full; a negative value, or a limit of zero, makes the range invalid: only a full read covers it.
    """
    full = F.col("offset_").isNull() & F.col("limit_").isNull()
    valid = (F.coalesce("offset_", F.lit(0)) >= 0) & (F.coalesce("limit_", F.lit(1)) > 0)
    low = F.when(~full & valid, F.coalesce("offset_", F.lit(0)).cast("long"))
    high = F.when(low.isNotNull(), F.when(F.col("limit_").isNull(), F.lit(2**62)).otherwise(low + F.col("limit_")))
    later = Window.partitionBy("session_id", "path").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    is_read = F.col("kind") == "read"
    d = ops.withColumns({"full": is_read & full, "low": F.when(is_read, low), "high": F.when(is_read, high)})
    d = d.withColumns({"written": F.coalesce(F.max(F.col("kind") == "write").over(later), F.lit(False)), "whole": F.coalesce(F.max("full").over(later), F.lit(False))})
    reads = d.where(is_read)
    open_ = reads.where(~F.col("written") & ~F.col("whole") & F.col("low").isNotNull())  # only these need ranges compared
    other = d.where(F.col("low").isNotNull()).select("session_id", "path", F.col("seq").alias("s2"), F.col("low").alias("l2"), F.col("high").alias("h2"))
    covered = open_.alias("a").join(other.alias("b"), (F.col("a.session_id") == F.col("b.session_id")) & (F.col("a.path") == F.col("b.path")) & (F.col("s2") > F.col("seq")) & (F.col("l2") <= F.col("low")) & (F.col("h2") >= F.col("high")), "left_semi").select("session_id", "path", "seq", F.lit(True).alias("covered"))
    state = F.when(F.col("written"), "stale").when(F.col("whole") | F.col("covered"), "superseded").otherwise("fresh")
    return reads.join(covered, ["session_id", "path", "seq"], "left").withColumn("state", state).drop("full", "low", "high", "written", "whole", "covered")


def read_marker(path: Column, state: Column, h: Column) -> Column:
    """What stands for an outdated read: its path without control characters and brackets, why, and where the original is."""
    shown = F.left(F.regexp_replace(path, r"[\p{Cc}\p{Cf}  \[\]]", "?"), F.lit(256))
    why = F.when(state == "stale", "is stale after a later write").when(state == "superseded", "is superseded by a later Read")
    return F.concat(F.lit("[Read of "), shown, F.lit(" "), why, F.lit(". Retrieve original: hash="), h, F.lit("]"))


def replaceable(reads: DataFrame, min_bytes: int = 512) -> DataFrame:
    """reads (from read_states, with call_id, output) with marker and replace: outdated, long enough, not yet marked, with a call, and cheaper as a marker."""
    o = F.col("output")
    d = reads.withColumn("marker", read_marker(F.col("path"), F.col("state"), content_hash(o)))
    ok = (F.col("state") != "fresh") & (F.octet_length(o) >= min_bytes) & o.rlike(r"\S") & ~has_marker(o) & F.col("call_id").isNotNull() & (tokens(F.col("marker")) < tokens(o))
    return d.withColumn("replace", F.coalesce(ok, F.lit(False)))


def replayed(marked: DataFrame, entries: DataFrame, now_ms: int) -> DataFrame:
    """marked (id, output, original) with shown: the marker while its entry is live and holds the same original, else the original."""
    h = F.regexp_extract("output", r"Retrieve original: hash=([0-9a-f]{24})\]$", 1)
    held = entries.where(F.col("expires_ms") > now_ms).select("hash", F.sha2("content", 256).alias("held")).distinct().withColumn("backed", F.lit(True))
    d = marked.withColumn("hash", h).withColumn("held", F.sha2("original", 256)).join(held, ["hash", "held"], "left")
    return d.withColumn("shown", F.when(F.col("backed"), F.col("output")).otherwise(F.col("original"))).drop("hash", "held", "backed")


def replays(parts: DataFrame) -> DataFrame:
    """parts (session_id, snapshot, key, source, sent) with shown: what was sent first for a key, as long as its source stays the same.

    A changed source starts anew: its own sent form counts from then on.
    """
    w = Window.partitionBy("session_id", "key").orderBy("snapshot")
    d = parts.withColumn("fresh", F.coalesce(F.sha2("source", 256) != F.lag(F.sha2("source", 256)).over(w), F.lit(True)))
    d = d.withColumn("run", F.sum(F.col("fresh").cast("int")).over(w))
    first = F.first("sent").over(Window.partitionBy("session_id", "key", "run").orderBy("snapshot"))
    return d.withColumn("shown", first).drop("fresh", "run")


# --- context


def live_parts(parts: DataFrame) -> DataFrame:
    """parts (session_id, snapshot, message_idx, part_idx, call_id, cache_control) with live.

    Live: seen for the first time in a snapshot after the session's first, its key unique there, behind the last cache mark.
    """
    key = ["session_id", "message_idx", "part_idx", "call_id"]
    d = parts.withColumn("first_snapshot", F.min("snapshot").over(Window.partitionBy("session_id"))).withColumn("seen", F.min("snapshot").over(Window.partitionBy(*key)))
    d = d.withColumn("copies", F.count("*").over(Window.partitionBy("snapshot", *key))).withColumn("frontier", F.max(F.when(F.col("cache_control"), F.col("message_idx"))).over(Window.partitionBy("session_id", "snapshot")))
    new = (F.col("seen") == F.col("snapshot")) & (F.col("snapshot") > F.col("first_snapshot")) & (F.col("copies") == 1)
    return d.withColumn("live", new & (F.col("message_idx") > F.coalesce("frontier", F.lit(-1)))).drop("first_snapshot", "seen", "copies", "frontier")


def intents(turns: DataFrame) -> DataFrame:
    """turns (session_id, turn, role, text) with intent: the trimmed, bounded text of the latest user turn so far that has one."""
    said = F.when((F.col("role") == "user") & (strip(F.col("text")) != ""), F.left(strip(F.col("text")), F.lit(INTENT_CHARS)))
    return turns.withColumn("intent", F.last(said, ignorenulls=True).over(Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)))


def pending_parts(parts: DataFrame, pending: DataFrame) -> DataFrame:
    """Live parts whose call still waits to be compacted."""
    return live_parts(parts).where("live").join(pending, ["session_id", "call_id"], "left_semi")
