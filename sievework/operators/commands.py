"""Which shell commands only show a file's content, so that their output must stay exact."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Fixed names.
READERS = ("cat", "head", "tail", "nl", "bat", "less", "more")
WRAPPERS = ("rtk", "sudo", "env", "time", "nice", "ionice", "nohup", "stdbuf", "command", "timeout", "xargs")
SHELLS, RUN_FLAGS = ("sh", "bash", "zsh", "dash"), ("-c", "-lc", "-lic", "-ic")
KINDS_LET_GO = ("json", "search", "log", "diff", "table", "html")
LOCKFILES = re.compile(r"(?:^|[\s/])(?:bun\.lockb?|package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|uv\.lock|poetry\.lock|Pipfile\.lock|requirements\.txt\.lock|Cargo\.lock|go\.sum|Gemfile\.lock|composer\.lock|flake\.lock|Package\.resolved|gradle\.lockfile|packages\.lock\.json)(?:\s|$)", re.I)
WRITES = re.compile(r"(?:^|\s)(?:\d*>>?|tee\b|<<)")


def command_of(args: str | None) -> str:
    """The command in a call's arguments: JSON with command or cmd, a string or a list; other text is the command."""
    try:
        value = json.loads(args or "")
    except ValueError:
        return args or ""
    got = value.get("command", value.get("cmd")) if isinstance(value, dict) else None
    return " ".join(map(str, got)) if isinstance(got, list) else got if isinstance(got, str) else ""


def shows_a_file(command: str) -> bool:
    """cat and its like, sed -n, also behind cd, assignments, wrappers and sh -c; not with redirection, not of lockfiles."""
    while m := re.match(r"cd\s+[^&;|]+(?:&&|;)\s*(.*)", command.strip(), re.S):
        command = m[1]
    if WRITES.search(command):
        return False
    words = command.split()
    while words:
        name = words[0].split("/")[-1].lower()
        if "=" in words[0] and not words[0].startswith("-"):
            words = words[1:]
        elif name in WRAPPERS:
            words = words[1:]
            while words and re.fullmatch(r"-.*|\d+(?:\.\d+)?", words[0]):
                words = words[1:]
        else:
            break
    if not words:
        return False
    if name in SHELLS:
        at = next((i for i, w in enumerate(words) if i and w in RUN_FLAGS), None)
        return at is not None and at + 1 < len(words) and shows_a_file(re.sub(r"^['\"]|['\"]$", "", " ".join(words[at + 1 :])))
    return (name in READERS or (name == "sed" and "-n" in words[1:])) and not LOCKFILES.search(command)


@F.pandas_udf(BooleanType())
def is_file_read(args: pd.Series) -> pd.Series:
    return args.map(lambda a: shows_a_file(command_of(a)))


def read_protected(args: Column, kind: Column) -> Column:
    """Whether an output must stay as it is: a file's content that isn't of a kind that can be shortened safely."""
    return is_file_read(args) & ~kind.isin(*KINDS_LET_GO)
