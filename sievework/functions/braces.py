"""Folding of function bodies in brace languages (JavaScript, TypeScript) without a parser: a scanner that gives up when in doubt."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Fixed words.
BLOCK_WORDS = ("if", "for", "while", "switch", "catch", "with", "return", "typeof", "await", "else", "do", "new", "in", "of")
BEFORE_REGEX = "(,=:[!&|?{};+-*%~^<>"
SIGNAL = re.compile(r"\b(?:function|interface|namespace|enum|implements|extends)\b|=>|^\s*(?:import|export|class|type|const|let|var)\b", re.M | re.ASCII)
NAME_END = re.compile(r"([A-Za-z_$][\w$]*)\s*(?:<[^<>(){}]*>)?\s*$", re.ASCII)
RETURN_TYPE = re.compile(r"\)\s*:\s*[\w$<>\[\]|&.,'\"\s]+$", re.ASCII)


@dataclass
class Pair:
    open: int
    close: int
    char: str


def scan(src: str) -> tuple[list[Pair], str] | None:
    """All bracket pairs, and the source with strings, comments and patterns blanked; None if anything is left open or unclear."""
    out: list[Pair] = []
    stack: list[tuple[str, int]] = []
    clean = list(src)
    i, n = 0, len(src)

    def blank(a: int, z: int) -> None:
        for k in range(a, z):
            if clean[k] != "\n":
                clean[k] = " "

    def behind(at: int) -> str:
        k = at - 1
        while k >= 0 and clean[k].isspace():
            k -= 1
        return clean[k] if k >= 0 else ""

    while i < n:
        c = src[i]
        if src.startswith("//", i) or (i == 0 and src.startswith("#!")):
            end = src.find("\n", i)
            end = n if end < 0 else end
            blank(i, end)
            i = end
        elif src.startswith("/*", i):
            end = src.find("*/", i + 2)
            if end < 0:
                return None
            blank(i, end + 2)
            i = end + 2
        elif c in "'\"":
            m = re.compile(rf"{c}(?:\\.|[^\\\n{c}])*{c}", re.S).match(src, i)
            if not m:
                return None
            blank(i + 1, m.end() - 1)
            i = m.end()
        elif c == "`" or (c == "}" and stack and stack[-1][0] == "${"):
            start = i
            if c == "}":
                stack.pop()
            i += 1
            while i < n and src[i] != "`" and not src.startswith("${", i):
                i += 2 if src[i] == "\\" else 1
            if i >= n:
                return None
            blank(start, i)
            if src[i] == "`":
                clean[i] = '"'
                i += 1
            else:
                blank(i, i + 2)
                stack.append(("${", i))
                i += 2
        elif c == "/" and (behind(i) in BEFORE_REGEX or behind(i) == "" or re.search(r"\b(?:return|typeof|case|in|of)\s*$", "".join(clean[max(0, i - 12) : i]))):
            m = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*").match(src, i)
            if not m:
                return None
            blank(i, m.end())
            clean[i] = '"'
            i = m.end()
        elif c in "([{":
            stack.append((c, i))
            i += 1
        elif c in ")]}":
            if not stack or stack[-1][0] != {")": "(", "]": "[", "}": "{"}[c]:
                return None
            char, at = stack.pop()
            out.append(Pair(at, i, char))
            i += 1
        else:
            i += 1
    return None if stack else (out, "".join(clean))


def function_start(clean: str, pairs: dict[int, Pair], at: int) -> int | None:
    """Where the function begins whose body opens at a brace; None if the brace opens something else."""
    base = max(0, at - 2000)  # headers are short; what reaches farther back is left alone
    head = clean[base:at].rstrip()
    arrow = head.endswith("=>")
    if arrow:
        head = head[:-2].rstrip()
    typed = RETURN_TYPE.search(head)
    head = head[: typed.start() + 1] if typed else head
    end = base + len(head) - 1
    if not head.endswith(")"):
        m = NAME_END.search(head) if arrow else None
        return base + m.start() if m else None
    if end not in pairs:
        return None
    opened = pairs[end].open
    if arrow:
        return opened
    low = max(0, opened - 300)
    before = clean[low:opened]
    m = NAME_END.search(before)
    if not m or m[1] in BLOCK_WORDS:
        return None
    if m[1] == "function":
        return low + m.start()
    keyword = re.search(r"(?:\basync\s+)?\bfunction\s*\*?\s*$", before[: m.start()])
    return low + (keyword.start() if keyword else m.start())


def fold_bodies(src: str, required, least: int = 6) -> tuple[str | None, str, int]:
    """src with the bodies of functions of at least so many lines as notes; functions for which required(text) holds stay whole.

    Also the reason, and how many lines went. A fold isn't looked into, nor is a function that is required.
    """
    found = scan(src)
    if found is None:
        return None, "invalid_syntax", 0
    all_pairs, clean = found
    pairs = {p.close: p for p in all_pairs}
    out, last, gone, skip = [], 0, 0, -1
    for p in sorted((p for p in all_pairs if p.char == "{"), key=lambda p: p.open):
        start = function_start(clean, pairs, p.open) if p.open > skip else None
        if start is None:
            continue
        if required(src[start : p.close + 1]):
            skip = p.close
            continue
        lines = sum(bool(x.strip()) for x in re.split(r"\r?\n", src[p.open + 1 : p.close]))
        if lines >= least:
            out += [src[last : p.open], f"{{ /* … {lines} lines omitted … */ }}"]
            last, skip, gone = p.close + 1, p.close, gone + lines
    if not out:
        return None, "nothing_to_compress", 0
    folded = "".join([*out, src[last:]])
    return (folded, "ok", gone) if scan(folded) else (None, "invalid_syntax", 0)
