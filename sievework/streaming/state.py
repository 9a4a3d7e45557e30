"""Stateful streams: live entries, repetition, intent, decision cache, circuit breaker, context parts - state by key, bounded.

Rows of a key arrive unordered within a micro-batch, so each step sorts by seq. A batch function next to each stream gives
the same rows for the same input at rest.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed limits.
CACHE_ENTRIES, CACHE_TTL_MS = 512, 30 * 60_000
BREAKER_FAILURES, BREAKER_COOLDOWN_MS = 3, 60_000
REPEAT_ENTRIES = 32
IDLE_MS = 24 * 3_600_000  # of a key, until its state goes


class Breaker:
    """Closed until so many failures in a row; then open for a time; then one trial decides."""

    def __init__(self, failures: int = 0, opened_ms: int = -1):
        self.failures, self.opened_ms = failures, opened_ms

    def allows(self, now: int) -> str:
        if self.opened_ms < 0:
            return "closed"
        return "half_open" if now - self.opened_ms >= BREAKER_COOLDOWN_MS else "open"

    def step(self, now: int, ok: bool) -> str:
        """What an attempt meets; its outcome counts unless the breaker is open."""
        met = self.allows(now)
        if met == "open":
            return met
        if ok:
            self.failures, self.opened_ms = 0, -1
        else:
            self.failures += 1
            if met == "half_open" or self.failures >= BREAKER_FAILURES:
                self.opened_ms = now
        return met


class Cache:
    """Decisions by key: least recently used go beyond the limit, all go after their time, which reading doesn't lengthen."""

    def __init__(self, entries: list[tuple[str, int]] | None = None):
        self.entries = dict(entries or [])  # key -> time it was put, the oldest use first

    def step(self, now: int, key: str) -> bool:
        """Whether the key was there; afterwards it is."""
        self.entries = {k: t for k, t in self.entries.items() if now - t < CACHE_TTL_MS}
        hit = key in self.entries
        put = self.entries.pop(key, now)
        self.entries[key] = put
        while len(self.entries) > CACHE_ENTRIES:
            self.entries.pop(next(iter(self.entries)))
        return hit


class Repeats:
    """The newest entries of a session: which earlier one an output repeats. Only newer entries displace one that has no expiry."""

    def __init__(self, entries: list[tuple[str, int, int | None]] | None = None):
        self.entries = entries or []  # digest, seq, expiry

    def step(self, now: int, digest: str, seq: int, ttl: int | None = None) -> int | None:
        self.entries = [e for e in self.entries if e[2] is None or e[2] > now]
        of = next((s for d, s, _ in reversed(self.entries) if d == digest), None)
        self.entries = [*self.entries, (digest, seq, None if ttl is None else now + ttl)][-REPEAT_ENTRIES:]
        return of


class Intent:
    """The latest text that a user gave."""

    def __init__(self, text: str | None = None):
        self.text = text

    def step(self, role: str, text: str | None) -> str | None:
        if role == "user" and (text or "").strip():
            self.text = text.strip()[:2000]
        return self.text


def _breaker(rows: pd.DataFrame, state) -> tuple[pd.DataFrame, object]:
    b = Breaker(*(state or (0, -1)))
    met = [b.step(int(t), bool(ok)) for t, ok in zip(rows["seq"], rows["ok"])]
    return rows[["key", "seq"]].assign(result=met), (b.failures, b.opened_ms)


def _cache(rows: pd.DataFrame, state) -> tuple[pd.DataFrame, object]:
    c = Cache([tuple(x) for x in state or []])
    hits = [str(c.step(int(t), k)).lower() for t, k in zip(rows["seq"], rows["value"])]
    return rows[["key", "seq"]].assign(result=hits), list(c.entries.items())


def _repeats(rows: pd.DataFrame, state, ttl_ms: int | None = None) -> tuple[pd.DataFrame, object]:
    r = Repeats([tuple(x) for x in state or []])
    of = [r.step(int(t), v, int(t), ttl_ms) for t, v in zip(rows["seq"], rows["value"])]
    return rows[["key", "seq"]].assign(result=[None if o is None else str(o) for o in of]), r.entries


def _intent(rows: pd.DataFrame, state) -> tuple[pd.DataFrame, object]:
    i = Intent(state)
    return rows[["key", "seq"]].assign(result=[i.step(r, v) for r, v in zip(rows["role"], rows["value"])]), i.text


STEPS = {"breaker": _breaker, "cache": _cache, "repeats": _repeats, "intent": _intent}


def _step(name: str, ttl_ms: int | None):
    return STEPS[name] if ttl_ms is None else partial(STEPS[name], ttl_ms=ttl_ms)


def run_stream(events: DataFrame, step: str, idle_ms: int = IDLE_MS, ttl_ms: int | None = None) -> DataFrame:
    """events (key, seq, value, role, ok) -> key, seq, result, with state by key; a row whose role is 'delete' clears the key's state.

    A key without rows for idle_ms of processing time loses its state, too, so that the state doesn't grow with all keys ever seen.
    ttl_ms is for 'repeats' whose seq is a time: outputs expire so long after it, as the stored entries that they name do.
    """
    run = _step(step, ttl_ms)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        held = json.loads(state.get[0]) if state.exists else None
        gone = rows["role"].eq("delete")
        if gone.any():  # what came before the last deletion still counts for its own rows
            last = rows.loc[gone, "seq"].max()
            first, rows = rows[(rows["seq"] < last) & ~gone], rows[rows["seq"] > last]
            if len(first):
                yield run(first, held)[0]
            held = None
        if len(rows):
            out, held = run(rows, held)
            yield out
        if held is None:
            state.remove()
        else:
            state.update((json.dumps(held),))
            state.setTimeoutDuration(idle_ms)

    kind = events.schema["key"].dataType.simpleString()
    return events.groupBy("key").applyInPandasWithState(update, f"key {kind}, seq long, result string", "held string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def run_batch(events: DataFrame, step: str, ttl_ms: int | None = None) -> DataFrame:
    """The same over events at rest; a key's rows go to one task in order of seq."""
    run = _step(step, ttl_ms)

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq", kind="stable")
        cut = rows["role"].eq("delete").cumsum()
        parts = [run(g[g["role"] != "delete"], None)[0] for _, g in rows.groupby(cut, sort=True) if (g["role"] != "delete").any()]
        return pd.concat(parts) if parts else rows[["key", "seq"]].assign(result=None).iloc[:0]

    kind = events.schema["key"].dataType.simpleString()
    return events.select("key", "seq", "value", "role", "ok").groupBy("key").applyInPandas(whole, f"key {kind}, seq long, result string")
