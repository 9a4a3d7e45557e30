"""Selections that depend on their own earlier choices: sizing by similarity and compression, and the shorter forms of
JSON, search results, logs, prose, tables and code. They work on one payload and run in Arrow batches of one kind."""

from __future__ import annotations

import ast
import json
import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import regex

from sievework.functions import braces
from sievework.functions.text import ABNORMAL, DIFF_PRIORITY, KEYWORDS, PROTECTED, SEVERE
from sievework.operators.lossless import dump_json, read_json
from sievework.operators.rank import spread_order


@dataclass(frozen=True)
class Budget:
    """What a strength allows."""

    bias: float
    items: int
    fields: int
    files: int
    per_file: int
    matches: int
    rows: int
    errors: int
    stacks: int
    stack_lines: int
    warnings: int
    log_lines: int
    context: int
    ratio: float


#: Fixed budgets of the strengths.
BUDGETS = {
    "conservative": Budget(1.5, 24, 24, 25, 7, 50, 24, 16, 5, 24, 10, 160, 4, 0.7),
    "balanced": Budget(1.0, 13, 13, 15, 5, 30, 13, 10, 3, 20, 5, 100, 3, 0.5),
    "aggressive": Budget(0.7, 8, 8, 10, 3, 20, 8, 6, 2, 14, 3, 60, 2, 0.3),
}
_compiled = lambda p: re.compile(p, re.ASCII)
SEVERE_RE, ABNORMAL_RE, PROTECTED_RE = _compiled(SEVERE), _compiled(ABNORMAL), _compiled(PROTECTED)
JSON_PRIORITY = _compiled(r"(?i)\b(?:error|fail|failed|fatal|critical|exception|warn|warning|todo|fixme|hack|auth|secret|password|security)\b")
CODE_ERRORS = _compiled(r"(?i)\b(?:throw|raise|panic|fatal|critical|error|exception|failed|security)\b")
PYTHON_SIGNAL = re.compile(r"^\s*(?:async\s+)?def\b|^\s*class\s+[A-Za-z_]\w*[^\n]*:\s*(?:#.*)?$|^\s*from\s+\S+\s+import\b", re.M | re.ASCII)
_ITEM_SPLIT = regex.compile(r"[^\p{L}\p{N}_-]+")
_DIGITS, _ASCII_DIGITS = regex.compile(r"\p{N}+"), re.compile("[0-9]+")
_HAN = regex.compile(r"\p{Han}")
_WORD_SPLIT = regex.compile(r"[^\p{L}\p{N}_]+")
_NO_LETTER = regex.compile(r"\P{L}")
_EDGES = regex.compile(r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$")
_DIGIT, _DOTTED = re.compile(r"\d", re.ASCII), re.compile(r"[A-Za-z_][^.]*\.[A-Za-z_]")
NUMBER = re.compile(r"-?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?", re.I | re.ASCII)


def marker(key: str) -> str:
    return f"[Retrieve more: hash={key}]"


# --- sizing


def hash_grams(points: np.ndarray, seed: int) -> np.ndarray:
    """A 32-bit hash of each row of code points (zero: none)."""
    h = np.full(len(points), seed, dtype=np.uint32)
    for c in points.T:
        h = np.where(c > 0, (h ^ c) * np.uint32(0x01000193), h)
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    return h ^ (h >> np.uint32(13))


def simhashes(texts: list[str]) -> np.ndarray:
    """Of each text 64 bits, each the majority vote of all its four-character grams."""
    low = [t.lower().ljust(4, "\0") for t in texts]
    size = np.array([len(t) for t in low])
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    grams = size - 3
    first = np.cumsum(size) - size
    begin = np.cumsum(grams) - grams
    at = np.arange(int(grams.sum())) + np.repeat(first - begin, grams)
    windows = points[at[:, None] + np.arange(4)]
    bits = np.arange(32, dtype=np.uint32)
    out = np.zeros(len(texts), dtype=np.uint64)
    for half, seed in enumerate((0x811C9DC5, 0x9E3779B9)):
        votes = np.add.reduceat((hash_grams(windows, seed)[:, None] >> bits & np.uint32(1)).astype(np.int32), begin, axis=0)
        won = (2 * votes > grams[:, None]).astype(np.uint64)
        out |= (won << (bits + np.uint32(32 * half)).astype(np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def leaders(prints: np.ndarray, distance: int = 3) -> int:
    """How many fingerprints lie farther than distance from all that counted before."""
    reps, n = np.empty(len(prints), dtype=np.uint64), 0
    for f in prints:
        if not n or np.bitwise_count(reps[:n] ^ f).min() > distance:
            reps[n] = f
            n += 1
    return n


def bigram_curve(items: list[str]) -> list[int]:
    seen: set = set()
    met: set = set()
    out = []
    for item in items:
        if item in met:
            out.append(len(seen))
            continue
        met.add(item)
        low = item.lower()
        words = low.split()
        if len(words) == 1 and len(low) > 1 and low == words[0] and _HAN.search(low):
            seen.update(zip(low, low[1:]))
        elif len(words) < 2:
            seen.add((words[0] if words else "", ""))
        else:
            seen.update(zip(words, words[1:]))
        out.append(len(seen))
    return out


def knee(curve: list[int]) -> int | None:
    if len(curve) < 3:
        return None
    if curve[0] == curve[-1]:
        return 1
    rise = [(y - curve[0]) / (curve[-1] - curve[0]) - i / (len(curve) - 1) for i, y in enumerate(curve)]
    best = max(range(len(rise)), key=lambda i: (rise[i], -i))
    return None if rise[best] < 0.05 else best + 1


def deflated(text: bytes) -> float:
    return len(zlib.compress(text, 1)) / len(text)


def fitting(items: list[str], bias: float, least: int, most: int) -> int:
    """How many of the items, best first, say most of what all say."""
    most = min(len(items), max(0, most))
    least = min(most, max(0, least))
    if most == 0 or len(items) <= 8:
        return most
    look = items[: max(256, 4 * most)]
    groups = leaders(simhashes(list(dict.fromkeys(look))))  # equal texts have equal fingerprints
    clamp = lambda k: min(most, max(least, k))
    if groups <= 3:
        return clamp(max(least, groups))
    diversity = groups / len(look)
    floor = max(least, int(len(look) * (0.3 + 0.7 * diversity)))
    at = knee(bigram_curve(look))
    base = floor if at is None else max(at, floor) if diversity > 0.7 else at
    k = clamp(int(base * (bias if math.isfinite(bias) and bias > 0 else 1)))
    whole, part = "\n".join(look).encode("utf-8", "replace"), "\n".join(look[:k]).encode("utf-8", "replace")
    if 0 < k < min(most, len(look)) and len(whole) >= 200 and part and abs(deflated(whole) - deflated(part)) > 0.15:
        k = min(most, int(k * 1.2))
    return k


def by_information(items: list[str], required: set[int]) -> list[int]:
    """Places that aren't required, those of rare and spread items first."""
    free = [i for i in range(len(items)) if i not in required]
    if len(free) <= 1:
        return free
    alike = [digits_alike(x.lower()) for x in items]
    count = Counter(alike)  # records mostly differ by their numbers alone
    tokens = {x: {t for t in _ITEM_SPLIT.split(x) if len(t) > 1} for x in count}
    df: Counter = Counter()
    for x, ts in tokens.items():
        for t in ts:
            df[t] += count[x]
    n, longest = len(items), max(1, *map(len, items))
    rarity = {t: math.log((n + 1) / (c + 1)) / math.log(n + 1) for t, c in df.items()}
    mean = {x: sum(rarity[t] for t in ts) / len(ts) if ts else 0 for x, ts in tokens.items()}
    place = {i: r for r, i in enumerate(i for i in spread_order(n) if i not in required)}
    score = lambda i: 0.8 * (0.85 * mean[alike[i]] + 0.15 * len(items[i]) / longest) + 0.2 * (1 - place[i] / (len(free) - 1))
    return sorted(free, key=lambda i: (-score(i), i))


def outliers(records: list[dict[str, float]], threshold: float = 3.0) -> set[int]:
    columns: dict[str, list[tuple[int, float]]] = {}
    for i, r in enumerate(records):
        for k, v in r.items():
            if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v):
                columns.setdefault(k, []).append((i, v))
    out: set[int] = set()
    for values in columns.values():
        x = np.array([v for _, v in values], dtype=float)
        sd = x.std()
        if len(x) >= 5 and sd:
            out |= {values[j][0] for j in np.flatnonzero(np.abs(x - x.mean()) / sd >= threshold)}
    return out


def fill(items: list[str], required: set[int], budget: int, bias: float, shape=lambda x: x) -> list[int]:
    """The required places and as many of the others as fit, in order."""
    free = by_information(items, required)
    slots = max(0, budget - len(required))
    k = fitting([shape(items[i]) for i in free], bias, min(3, slots, len(free)), min(slots, len(free)))
    return sorted(required | set(free[:k]))


def words_of(query: str, separator: str, longer_than: int = 2) -> list[str]:
    return [w for w in regex.split(separator, query.lower()) if len(w) > longer_than]


def digits_alike(x: str) -> str:
    return (_ASCII_DIGITS if x.isascii() else _DIGITS).sub("N", x)


# --- kinds: each gives (shorter text or None, reason)

Result = tuple[str | None, str]


def shorter_json(text: str, query: str, key: str, b: Budget) -> Result:
    try:
        value, write = read_json(text)
    except (ValueError, RecursionError):
        return None, "invalid_json"
    words = words_of(query, r"[^A-Za-z0-9_]+")

    def priority(s: str) -> bool:
        low = s.lower()
        return bool(JSON_PRIORITY.search(s)) or any(w in low for w in words)

    dropped = False

    def array(rows: list) -> list:
        nonlocal dropped
        keys = ["\0".join(sorted(r)) if isinstance(r, dict) else "" for r in rows]
        texts = [write(r) for r in rows]
        usual = Counter(keys).most_common(1)[0][0]  # of equals the one met first
        need = {0, len(rows) - 1} | {i for i in range(len(rows)) if keys[i] != usual or priority(texts[i])} | outliers([r if isinstance(r, dict) else {} for r in rows])
        kept = fill(texts, need, b.items, b.bias, digits_alike)
        lost = len(rows) - len(kept)
        dropped |= lost > 0
        return [rows[i] for i in kept] + ([{"_ccr_dropped": f"<<ccr:{key} {lost}_rows_offloaded>>"}] if lost else [])

    if isinstance(value, list):
        if len(value) <= b.items:
            return None, "not_large_array"
        out = array(value)
    elif isinstance(value, dict):
        nested = [k for k in ("results", "data", "items") if isinstance(value.get(k), list) and len(value[k]) > b.items]
        out = {k: array(v) if k in nested else v for k, v in value.items()}
        if not nested:
            names = list(value)
            if len(names) <= b.fields or "_ccr_dropped" in value:
                return None, "not_large_array"
            keep = {0, len(names) - 1} | {i for i, k in enumerate(names) if isinstance(value[k], (list, dict)) or priority(write({k: value[k]}))}
            for i in range(len(names)):
                if len(keep) >= b.fields:
                    break
                keep.add(i)
            lost = len(names) - len(keep)
            dropped = lost > 0
            out = {names[i]: value[names[i]] for i in sorted(keep)} | {"_ccr_dropped": f"<<ccr:{key} {lost}_fields_offloaded>>"}
    else:
        return None, "not_large_array"
    return (pretty(out, write), "ok") if dropped else (None, "nothing_dropped")


def pretty(v, write=dump_json, indent: str = "") -> str:
    """JSON with two spaces a level."""
    inner = indent + "  "
    if isinstance(v, dict) and v:
        return "{\n" + ",\n".join(f"{inner}{write(k)}: {pretty(x, write, inner)}" for k, x in v.items()) + f"\n{indent}}}"
    if isinstance(v, list) and v:
        return "[\n" + ",\n".join(inner + pretty(x, write, inner) for x in v) + f"\n{indent}]"
    return write(v)


SEARCH_ROW, NUMBERED = re.compile(r"(.+?)([:-])(\d+)\2(.*)"), re.compile(r"(\d+):(.*)")


def search_rows(text: str) -> list[tuple[str, int, str]]:
    """(file, line, content) of each result; a heading holds until a line that neither is a result nor has a number."""
    lines = re.split(r"\r?\n", text)
    out, heading = [], ""
    for i, x in enumerate(lines):
        if m := SEARCH_ROW.fullmatch(x):
            out.append((m[1], int(m[3]), m[4]))
            heading = ""
        elif heading and (m := NUMBERED.fullmatch(x)):
            out.append((heading, int(m[1]), m[2]))
        else:
            heading = x if i + 1 < len(lines) and NUMBERED.fullmatch(lines[i + 1]) else ""
    return out


def shorter_search(text: str, query: str, key: str, b: Budget) -> Result:
    rows = search_rows(text)
    if len(rows) < 20:
        return None, "too_few_matches"
    words = words_of(query, r"[^A-Za-z0-9_]+")
    hits = lambda r: sum(w in r[2].lower() for w in words)
    score = {r: (1 if SEVERE_RE.search(r[2]) else 0) + 0.3 * hits(r) for r in rows}
    files: dict[str, list] = {}
    for r in rows:
        files.setdefault(r[0], []).append(r)
    kept = {r[:2]: r for r in rows if SEVERE_RE.search(r[2]) or hits(r) >= 2}
    ranked = sorted(files, key=lambda f: -max(score[r] for r in files[f]))
    rank = {f: i for i, f in enumerate(ranked)}
    rest: dict = {}
    for f in ranked[: b.files]:
        mine = files[f]
        needed = {r[1] for r in mine if r[:2] in kept}
        chosen = {mine[0][1]: mine[0], mine[-1][1]: mine[-1]}
        for r in sorted(mine, key=lambda r: -score[r]):
            if len(needed) + len(chosen) >= b.per_file:
                break
            if r[1] not in needed:
                chosen[r[1]] = r
        rest |= {(f, n): r for n, r in chosen.items() if (f, n) not in kept}
    order = sorted(rest.values(), key=lambda r: (-score[r], rank[r[0]], r[1]))
    slots = max(0, b.matches - len(kept))
    k = fitting([r[2] for r in order], b.bias, min(5, slots, len(order)), min(slots, len(order)))
    final = sorted([*kept.values(), *order[:k]], key=lambda r: (r[0], r[1]))
    count = Counter(r[0] for r in final)
    lost = [f"{len(m) - count[f]}@{f}" for f, m in files.items() if len(m) > count[f]]
    return "\n".join([*(f"{f}:{n}:{c}" for f, n, c in final), *([f"[omitted: {'; '.join(lost)}]"] if lost else []), marker(key)]), "ok"


LEVELS = [("ERROR", r"\b(?:ERROR|FATAL|CRITICAL)\b|^npm ERR!"), ("FAIL", r"\b(?:FAIL|FAILED)\b"), ("WARN", r"\b(?:WARN|WARNING)\b|^npm WARN"), ("INFO", r"\bINFO\b|^npm info"), ("DEBUG", r"\bDEBUG\b"), ("TRACE", r"\bTRACE\b")]
LEVEL_RES = [(n, re.compile(p, re.I | re.ASCII)) for n, p in LEVELS]
SUMMARY = re.compile(r"={3,}|-{3,}|\d+ (?:passed|failed|skipped|error|warning)|(?:Tests?|Suites?):?\s+\d+|(?:TOTAL|Total|Summary)|(?:Build|Compile|Test).*(?:succeeded|failed|complete)")
WEIGHT = {"ERROR": 1.0, "FAIL": 1.0, "WARN": 0.5, "INFO": 0.1, "UNKNOWN": 0.1, "DEBUG": 0.05, "TRACE": 0.02}
OPENERS = [("python", r'Traceback \(most recent call last\)|File ".+", line \d+'), ("js", r"at (?=.*\()(?=.*:\d+:\d+)"), ("java", r"at [\w.$]+\("), ("rust", r"--> (?=.*:\d+:\d+)"), ("go", r"(?i:\d+:\s+0x[0-9a-f]+)")]
OPENER_RES = [(n, re.compile(p, re.ASCII)) for n, p in OPENERS]
STAYS = {"python": re.compile(r"Traceback|File |During handling|The above exception|[A-Z]"), "js": re.compile("at "), "java": re.compile("at "), "rust": re.compile("--> "), "go": re.compile(r"\d", re.ASCII)}


def log_level(x: str) -> str:
    return next((n for n, p in LEVEL_RES if p.search(x)), "UNKNOWN")


def trace_flags(lines: list[str], limit: int = 24) -> list[bool]:
    out, flavor, n = [], None, 0
    for x in lines:
        t = x.lstrip()
        goes_on = flavor and n < limit and (x == "" or STAYS[flavor].match(t) or (flavor == "python" and x[:1] in (" ", "\t")))
        if goes_on:
            n += 1
        else:
            flavor = next((f for f, p in OPENER_RES if p.match(t)), None)
            n = 1 if flavor else 0
        out.append(flavor is not None)
    return out


def log_key(x: str) -> str:
    cut = next((i for i, c in enumerate(x) if c in ":="), len(x))
    tail = re.sub(r"\d+", "N", x[cut:], flags=re.ASCII)
    return x[:cut] + re.sub(r"/[\w/]+/", "/PATH/", re.sub(r"(?i)0x[0-9a-f]+", "ADDR", tail), flags=re.ASCII)


def with_ends(places: list[int], score: list[float], limit: int) -> list[int]:
    """Places that fit a limit: first, last, and the best."""
    if len(places) <= limit:
        return places
    ends = {places[0], places[-1]}
    return sorted(places, key=lambda i: (i not in ends, -score[i], i))[: max(limit, len(ends))]


def shorter_log(text: str, query: str, key: str, b: Budget) -> Result:
    lines = re.split(r"\r?\n", text)
    if len(lines) < 50:
        return None, "too_few_lines"
    level, stack = [log_level(x) for x in lines], trace_flags(lines)
    summary = [bool(SUMMARY.match(x)) for x in lines]
    score = [min(1.0, WEIGHT[v] + 0.3 * s + 0.4 * m) for v, s, m in zip(level, stack, summary)]
    words = words_of(query, r"[^\p{L}\p{N}_-]+")
    need = {i for i, x in enumerate(lines) if summary[i] or any(w in x.lower() for w in words)}
    for v in ("ERROR", "FAIL"):
        need.update(with_ends([i for i, y in enumerate(level) if y == v], score, b.errors))
    starts = [i for i, s in enumerate(stack) if s and not (i and stack[i - 1])]
    for i in starts[: b.stacks]:
        end = i
        while end < len(lines) and stack[end] and end - i < b.stack_lines:
            end += 1
        need.update(range(i, end))
    first: dict[str, int] = {}
    for i, v in enumerate(level):
        if v == "WARN":
            first.setdefault(log_key(lines[i]), i)
    more = set(list(first.values())[: b.warnings])
    near = {j for i in need | more for j in range(max(0, i - b.context), min(len(lines), i + b.context + 1))}
    free = sorted((more | near) - need, key=lambda i: (-score[i], i))
    slots = max(0, b.log_lines - len(need))
    k = fitting([log_key(lines[i]) for i in free], b.bias, min(10, slots, len(free)), min(slots, len(free)))
    kept = sorted(need | set(free[:k]))
    lost, count = len(lines) - len(kept), Counter(level)
    told = [f"{count[v]} {v}" for v in ("ERROR", "FAIL", "WARN", "INFO") if count[v]]
    return "\n".join([lines[i] for i in kept] + ([f"[{lost} lines omitted: {', '.join(told)}]"] if lost > 0 and told else []) + [marker(key)]), "ok"


def segments(text: str) -> list[str]:
    return [s for x in re.split(r"\r?\n", text) if x.strip() for y in re.split(r"(?<=[.!?])\s", x.strip()) if (s := y.strip())]


@lru_cache(1 << 16)  # texts repeat their words
def salient(word: str) -> bool:
    letters = _NO_LETTER.sub("", word)
    bare = _EDGES.sub("", word).lower()
    return bool(_DIGIT.search(word)) or bare in KEYWORD_SET or (len(letters) >= 2 and letters == letters.upper()) or bool(_DOTTED.match(word))


def shorter_text(text: str, query: str, key: str, b: Budget) -> Result:
    segs = segments(text)
    if len(segs) < 6:
        return None, "too_few_segments"
    tokens = [[t for t in _WORD_SPLIT.split(s.lower()) if t] for s in segs]
    words = [w for w in _WORD_SPLIT.split(query.lower()) if len(w) > 2]
    relevance = [sum(w in set(t) for w in words) / len(words) if words else 0.0 for t in tokens]
    heading = [bool(re.match(r"#{1,6}\s+", s)) for s in segs]

    def score(i: int) -> float:
        parts = segs[i].split()
        s = (i + 1) / len(segs) + 2 * relevance[i] + 1.5 * sum(map(salient, parts)) / (len(parts) + 1) + (1.25 if heading[i] else 0)
        return s * 0.25 if len(segs[i]) < 12 and not heading[i] else s

    force = sorted({0, len(segs) - 1} | {i for i in range(len(segs)) if heading[i] or relevance[i] > 0 or not KEYWORD_SET.isdisjoint(tokens[i])})
    target, kept, seen, chars = max(1, int(sum(map(len, segs)) * b.ratio)), set(), set(), 0

    def add(i: int) -> int:
        grams = shingles(tokens[i])
        if i in kept or (grams and len(grams & seen) / len(grams) >= 0.85):
            return 0
        kept.add(i)
        seen.update(grams)
        return len(segs[i])

    for i in force:
        chars += add(i)
    for i in sorted(range(len(segs)), key=lambda i: (-score(i), i)):
        if chars >= target:
            break
        chars += add(i)
    return "\n".join([segs[i] for i in sorted(kept)] + [marker(key)]), "ok"


KEYWORD_SET = frozenset(KEYWORDS)


def shingles(words: list[str], size: int = 3) -> set[tuple[str, ...]]:
    """Runs of three words; of fewer words all runs."""
    widths = [size] if len(words) >= size else range(1, len(words) + 1)
    return {tuple(words[i : i + w]) for w in widths for i in range(len(words) - w + 1)}


def table_of(text: str) -> tuple[list[str], list[str], str] | None:
    rows = [x for x in re.split(r"\r?\n", text) if x.strip()]
    if len(rows) < 8:
        return None
    if "|" in rows[0] and re.fullmatch(r"\s*\|?(?:\s*:?-+:?\s*\|)+\s*:?-+:?\s*\|?\s*", rows[1]):
        return rows[:2], rows[2:], "|"
    for d in (",", "\t"):
        if rows[0].count(d) and all(r.count(d) == rows[0].count(d) for r in rows[1:20]):
            return rows[:1], rows[1:], d
    return None


def shorter_table(text: str, query: str, key: str, b: Budget) -> Result:
    t = table_of(text)
    if t is None or len(t[1]) < 20:
        return None, "too_few_lines"
    head, rows, d = t
    words = words_of(query, r"[^\p{L}\p{N}_-]+")
    need = {i for i, r in enumerate(rows) if ABNORMAL_RE.search(r) or any(w in r.lower() for w in words)} | {0, 1, len(rows) - 2, len(rows) - 1}
    need |= outliers([{str(c): float(v) for c, v in enumerate(x.strip() for x in r.split(d)) if NUMBER.fullmatch(v)} for r in rows])
    kept = fill(rows, need, b.rows, b.bias, digits_alike)
    lost = len(rows) - len(kept)
    return ("\n".join([*head, *(rows[i] for i in kept), f"[{lost} rows omitted]", marker(key)]), "ok") if lost else (None, "nothing_dropped")


#: Where Python may be parsed in parts: a definition on the left behind an empty line, about so many characters on.
DEFINITION, PART_CHARS = re.compile(r"\n\n(?=@|def\b|class\b|async\b)", re.ASCII), 20_000


def python_parts(text: str) -> list[str]:
    """Parts of the text, each likely a module of its own. Modules one behind the other are a module, whose tree needn't lie in memory at once."""
    parts, at = [], 0
    while "\r" not in text and (m := DEFINITION.search(text, at + PART_CHARS)):
        parts.append(text[at : m.end()])
        at = m.end()
    return [*parts, text[at:]]


def shorter_python(text: str, query: str, key: str, b: Budget) -> Result:
    """Bodies of long functions give way to a note; a function that raises or that the query names stays whole."""
    if not PYTHON_SIGNAL.search(text):
        return None, "unsupported_language"
    words = words_of(query, r"[^\p{L}\p{N}_$]+")
    parts = python_parts(text)
    try:
        out = [without_bodies(x, words) for x in parts]
    except (SyntaxError, ValueError, RecursionError):  # of one part, as where a definition stands in a string
        parts = [text]
        try:
            out = [without_bodies(text, words)]
        except (SyntaxError, ValueError, RecursionError):
            return None, "invalid_syntax"
    if all(x is y for x, y in zip(parts, out)):
        return None, "nothing_to_compress"
    whole = "".join(out) + f"\n# {marker(key)}"
    try:
        for x, y in zip(parts, out):
            if x is not y:
                ast.parse(y)
    except SyntaxError:
        try:
            ast.parse(whole)
        except SyntaxError:
            return None, "invalid_syntax"
    return whole, "ok"


def without_bodies(text: str, words: list[str]) -> str:
    """The Python text with a note for each long body; itself if it has none. What is no Python raises the parser's error."""
    tree = ast.parse(text)
    lines = text.split("\n")
    cuts: list[tuple[int, int, list[str]]] = []

    def walk(node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            if not isinstance(child, (ast.stmt, ast.excepthandler, ast.match_case)):  # expressions hold no statements
                continue
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                whole = "\n".join(lines[child.lineno - 1 : child.end_lineno])
                if CODE_ERRORS.search(whole) or any(w in whole.lower() for w in words):
                    continue
                first = child.body[0]
                body = lines[first.lineno - 1 : child.end_lineno]
                n = sum(bool(x.strip()) for x in body)
                if n > 5 and first.lineno > child.lineno:
                    pad = re.match(r"[ \t]*", lines[first.lineno - 1])[0]
                    doc = ast.get_docstring(child, clean=False)
                    said = next((x.strip() for x in (doc or "").split("\n") if x.strip()), "")
                    cuts.append((first.lineno - 1, child.end_lineno, [*([pad + json.dumps(said, ensure_ascii=False)] if said else []), f"{pad}pass  # … {n} lines omitted …"]))
                    continue
            walk(child)

    walk(tree)
    for a, z, new in sorted(cuts, reverse=True):
        lines[a:z] = new
    return "\n".join(lines) if cuts else text


DIFF_PRIORITY_RE = _compiled(DIFF_PRIORITY)


def shorter_diff(text: str, query: str, key: str, b: Budget) -> Result:
    """Up to 20 files and 10 hunks of each, by priority, hits and size, with two lines of context around changes."""
    lines = re.split(r"\r?\n", text)
    if len(lines) < 50:
        return None, "too_few_lines"
    is_file = [x.startswith(("diff --git ", "diff --cc ", "diff --combined ")) for x in lines]
    if not any(is_file):
        return None, "invalid_diff"
    at = is_file.index(True)
    prelude, files = lines[:at], []  # a file: its head, and its hunks as lists with their header first
    for x, new in zip(lines[at:], is_file[at:]):
        if new:
            files.append(([x], []))
        elif re.match(r"@@@?\s", x):
            files[-1][1].append([x])
        else:
            (files[-1][1][-1] if files[-1][1] else files[-1][0]).append(x)
    if not any(h for _, h in files):
        return None, "invalid_diff"
    words = sorted(set(words_of(query, r"[^\p{L}\p{N}_]+", 1)))
    changes = lambda hunk: sum(x[:1] in ("+", "-") for x in hunk[1:])

    def worth(part: list[str]) -> tuple[bool, int]:
        low = "\n".join(part).lower()
        return bool(DIFF_PRIORITY_RE.search(low)), sum(w in low for w in words)

    def best(parts: list, limit: int, rank) -> list:
        return parts if len(parts) <= limit else [parts[i] for i in sorted(sorted(range(len(parts)), key=lambda i: (rank(i), i))[:limit])]

    def file_rank(i: int):
        priority, hits = worth([*files[i][0], *(x for h in files[i][1] for x in h)])
        return (not priority, -hits, -sum(map(changes, files[i][1])))

    kept_files = best(files, 20, file_rank)
    out, plus, minus, lost = [*prelude], 0, 0, 0
    for head, hunks in kept_files:
        def hunk_rank(i: int, hunks=hunks):
            priority, hits = worth(hunks[i])
            return (i not in (0, len(hunks) - 1), not priority, -min(1.0, min(0.3, changes(hunks[i]) * 0.03) + hits * 0.2 + 0.3 * priority))

        kept = best(hunks, 10, hunk_rank)
        lost += len(hunks) - len(kept)
        out += head
        for h in kept:
            body = h[1:]
            moved = [i for i, x in enumerate(body) if x[:1] in ("+", "-")]
            plus += sum(x[:1] == "+" for x in body)
            minus += sum(x[:1] == "-" for x in body)
            near = {j for i in moved for j in range(i - 2, i + 3)} or {0, 1}
            out += [h[0], *(x for i, x in enumerate(body) if i in near or x[:1] not in (" ", "+", "-"))]
    notes = [f"{len(kept_files)} files changed", f"+{plus} -{minus} lines", *([f"{lost} hunks omitted"] if lost else []), *([f"{len(files) - len(kept_files)} files omitted"] if len(files) > len(kept_files) else [])]
    out.append(f"[{', '.join(notes)}]")
    whole = "\n".join(out)
    return (f"{whole}\n{marker(key)}", "ok") if len(out) < 0.8 * len(lines) and len(whole) < len(text) else (None, "insufficient_savings")


def shorter_code(text: str, query: str, key: str, b: Budget) -> Result:
    """Python by its syntax tree, JavaScript and TypeScript by their braces; other languages stay whole."""
    if PYTHON_SIGNAL.search(text):
        return shorter_python(text, query, key, b)
    if not braces.SIGNAL.search(text):
        return None, "unsupported_language"
    words = words_of(query, r"[^\p{L}\p{N}_$]+")
    out, why, _ = braces.fold_bodies(text, lambda f: bool(CODE_ERRORS.search(f)) or any(w in f.lower() for w in words))
    return (None if out is None else f"{out}\n// {marker(key)}"), why


SHORTER = {"diff": shorter_diff, "json": shorter_json, "search": shorter_search, "log": shorter_log, "text": shorter_text, "table": shorter_table, "code": shorter_code}


def shorten(kind: str, text: str, query: str, key: str, strength: str = "balanced") -> Result:
    """The shorter form of a text by its kind, and 'ok'; or None and why there is none. Whatever fails leaves the text whole."""
    try:
        out, why = SHORTER[kind](text, query, key, BUDGETS[strength])
    except Exception as e:  # fail open: a payload that a kernel can't take is passed on as it is
        return None, f"strategy_error:{type(e).__name__}"
    if out is not None and kind != "code" and len(out) >= len(text):
        return None, "no_savings"
    return out, why


def json_facts(text: str) -> list[str]:
    """All strings in the JSON that read like something to be kept."""
    try:
        stack, out = [read_json(text)[0]], []
    except (ValueError, RecursionError):
        return []
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            out += [v] if PROTECTED_RE.search(v) else []
        else:
            stack += list(v.values()) if isinstance(v, dict) else v if isinstance(v, list) else []
    return out
