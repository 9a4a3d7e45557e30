"""Byte-level vocabularies read from a tokenizer file: pieces as bytes, merges, and the split of a text into pre-tokens."""

from __future__ import annotations

import json
from functools import cached_property

import regex

#: Fixed pattern of byte-level pre-tokens, with white space as the Unicode property.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in such files: printable Latin-1 ones for themselves, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteVocab:
    """content: the bytes of a tokenizers JSON file with a byte-level BPE model."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        model = spec["model"]
        self.ids: dict[bytes, int] = {as_bytes(t): i for t, i in model["vocab"].items()}
        self.special: dict[str, int] = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
        self.bytes: dict[int, bytes] = {i: t for t, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}  # (left, right) -> (rank, merged)
        self.parts: dict[int, tuple[int, int, int]] = {}  # merged -> (rank, left, right)
        for rank, m in enumerate(model["merges"]):
            a, b = (as_bytes(x) for x in (m if isinstance(m, list) else m.split(" ")))
            left, right, both = self.ids[a], self.ids[b], self.ids[a + b]
            self.pairs.setdefault((left, right), (rank, both))
            self.parts.setdefault(both, (rank, left, right))
        self.longest = max(map(len, self.ids))

    @cached_property
    def pattern(self):
        return regex.compile(PRE_TOKEN)

    @cached_property
    def special_pattern(self):
        return regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text; special tokens stand as pieces of their own. Joined they are the text."""
        if self.special_pattern is None or not any(s in text for s in self.special):
            return self.pattern.findall(text)
        out: list[str] = []
        for part in self.special_pattern.split(text):
            out += [part] if part in self.special else self.pattern.findall(part)
        return out


def read_vocab(path: str) -> bytes:
    """The file's content, read once on the driver and sent along with the tasks (a fixed size of some MB)."""
    with open(path, "rb") as f:
        return f.read()
