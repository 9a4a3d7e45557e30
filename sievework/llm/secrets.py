"""Secret scans: fixed patterns, and spans whose sliding-window Shannon entropy is high in some character class."""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from sievework.llm.common import id_and_text, map_texts

KINDS = ("assign", "access", "hex", "entropy")  # the order of kinds that start at one place

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ASSIGN_WORDS = re.compile("password|passwd|secret|token|api_?key", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


@dataclass(frozen=True)
class EntropyRule:
    """A character class, its window, and the bits a character from which a window counts as random.

    A shorter candidate is one window, and needs bits in proportion to the most that so many characters can have.
    """

    name: str
    alphabet: str
    window: int
    bits: float


@dataclass(frozen=True)
class SecretConfig:
    rules: tuple[EntropyRule, ...] = (
        EntropyRule("hex", "0123456789abcdefABCDEF", 24, 3.0),
        EntropyRule("upper_digit", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20, 3.5),
        EntropyRule("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 24, 4.0),
    )
    #: whole candidate strings that are no secrets: one class of letters only, digests of nothing, identifiers of words, paths, placeholder words
    allow: tuple[str, ...] = field(default=(r"[a-z]+", r"[A-Z]+", r"[0-9]+", r"[A-Z]?[a-z]+(?:[-_/][A-Za-z]?[a-z]*)+", r"(?:.)\1+", r"0x[0-9a-f]{1,16}", r"(?i)(?:(?:example|sample|dummy|placeholder|test)[-_/=+]*)+"))


def window_entropies(s: str, window: int, inside: frozenset[str] | None = None) -> list[float]:
    """Shannon entropy in bits a character of each window of s, by incremental counts: a step takes one character out and one in.

    Windows with a character that is not inside the class get -1. The sum of c*log2(c) changes by two terms at each end.
    """
    n = len(s)
    if n < window:
        return []
    xlog = [0.0, *(c * math.log2(c) for c in range(1, window + 2))]  # one more than the window is in for a moment
    counts: dict[str, int] = {}
    total, outside, out = 0.0, 0, []
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += xlog[c + 1] - xlog[c]
        outside += inside is not None and ch not in inside
        if i >= window:
            old = s[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += xlog[c - 1] - xlog[c]
            outside -= inside is not None and old not in inside
        if i >= window - 1:
            out.append(-1.0 if outside else math.log2(window) - total / window)
    return out


class SecretScanner:
    """Spans (kind, start, end) of a text, in code points with the end exclusive."""

    def __init__(self, config: SecretConfig | None = None):
        self.config = config or SecretConfig()
        self._allow = re.compile("|".join(f"(?:{p})" for p in self._plain_allow()))
        self._classes = [(r, frozenset(r.alphabet)) for r in self.config.rules]

    def _plain_allow(self) -> list[str]:
        """The patterns with inline flags and group numbers made safe to be joined."""
        return [p.replace(r"(?:.)\1+", r"(?P<one>.)(?P=one)+").replace("(?i)(?:", "(?i:") for p in self.config.allow]

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, number of the kind, end) of the fixed patterns' matches, leftmost and non-overlapping for each kind."""
        out = []
        if _ASSIGN_WORDS.search(text):
            out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
        return sorted(out)

    def random_spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, 3, end) of maximal runs of windows with high entropy in candidate strings that no allow pattern covers."""
        out = []
        for m in _CANDIDATE.finditer(text):
            s = m.group()
            if self._allow.fullmatch(s):
                continue
            hot: list[tuple[int, int]] = []
            for rule, inside in self._classes:
                window = min(rule.window, len(s))
                bits = rule.bits * math.log2(window) / math.log2(rule.window)
                for i, h in enumerate(window_entropies(s, window, inside)):
                    if h >= bits and self._mixed(s[i : i + window]):
                        hot.append((i, i + window))
            for a, b in merge(hot):
                out.append((m.start() + a, 3, m.start() + b))
        return out

    @staticmethod
    def _mixed(w: str) -> bool:
        """Words run together are no secrets: a window needs digits and letters, or both cases often changing."""
        digits = sum(c.isdigit() for c in w)
        return 2 <= digits < len(w) or sum(a.islower() != b.islower() for a, b in zip(w, w[1:])) >= len(w) // 3

    def scan(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """The base spans, and all spans: base ones, and what of those by entropy lies outside base spans."""
        base = self.base(text)
        extra = []
        for a, k, end in self.random_spans(text):
            for b in base:  # by their starts
                if a < b[2] and b[0] < end:
                    if a < b[0]:
                        extra.append((a, k, b[0]))
                    a = max(a, b[2])
            if a < end:
                extra.append((a, k, end))
        return base, sorted(base + extra)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: SecretConfig | None = None) -> DataFrame:
    """One row for each row of df: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans.

    A map without a shuffle over whole texts. Null and empty texts have no spans. A text of any length is scanned in one piece, in time by
    its length; a match as long as the text is one span. Spans that start at one place come in the order of KINDS, entropy spans give way to
    base ones. Repeated rows give repeated results; a null id stays null; an empty table gives no rows; other columns of df, also
    ones named as results are, play no part.
    """

    def make():
        scanner = SecretScanner(config)

        def f(texts: list[str]) -> dict[str, list]:
            out: dict[str, list] = {n: [] for n in ("n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans")}
            for t in texts:
                base, spans = scanner.scan(t)
                for k, n in enumerate(("n_assign", "n_access", "n_hex", "n_entropy")):
                    out[n].append(sum(x[1] == k for x in spans))
                out["base_sha256"].append(hashlib.sha256(render(base).encode()).hexdigest())
                out["spans"].append(render(spans))
            return out

        return f

    return map_texts(id_and_text(df, id_col, text_col), make, [("n_assign", "bigint"), ("n_access", "bigint"), ("n_hex", "bigint"), ("n_entropy", "bigint"), ("base_sha256", "string"), ("spans", "string")])
