"""Savings, outcomes, latencies and retrieval costs, over all sessions and for each one, in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators.policy import known_reason

MODES = ("summary", "query", "range", "head", "tail", "full")
PRICE, CACHED_PRICE, FUTURE_TURNS = 3.0, 0.3, 3  # USD for a million tokens, and turns that read the context again


def snapshot(compressions: DataFrame, retrievals: DataFrame) -> DataFrame:
    """A row for each session and one, with a null session_id, for all: outcomes, savings, latency, retrievals, net savings.

    compressions: session_id, outcome, tokens_saved, latency_ms. retrievals: session_id, mode, miss, output_tokens.
    """
    one = lambda c: F.sum(c.cast("long"))
    events = compressions.select("session_id", "outcome", "tokens_saved", "latency_ms", *(F.lit(None).cast(t).alias(n) for n, t in (("mode", "string"), ("miss", "boolean"), ("output_tokens", "long")))).unionByName(
        retrievals.select("session_id", "mode", "miss", F.col("output_tokens").cast("long").alias("output_tokens"), *(F.lit(None).cast(t).alias(n) for n, t in (("outcome", "string"), ("tokens_saved", "long"), ("latency_ms", "double"))))
    )
    per = [F.sum(F.when(F.col("mode") == m, F.col("output_tokens")).otherwise(0)).alias(f"tokens_{m}") for m in MODES]
    agg = events.rollup("session_id").agg(
        F.grouping("session_id").alias("overall"),
        *(one(F.coalesce(F.col("outcome") == o, F.lit(False))).alias(o) for o in ("compressed", "skipped", "error")),
        F.sum(F.when(F.col("outcome") == "compressed", F.col("tokens_saved")).otherwise(0)).alias("gross_saved"),
        F.count("latency_ms").alias("latency_count"), F.sum("latency_ms").alias("latency_total"), F.max("latency_ms").alias("latency_max"),
        F.count("mode").alias("retrievals"), one(F.coalesce("miss", F.lit(False))).alias("misses"), F.avg((F.col("mode") == "full").cast("int")).alias("full_rate"), *per,
    )
    spent = sum((F.col(f"tokens_{m}") for m in MODES[1:]), F.col(f"tokens_{MODES[0]}"))
    return agg.withColumn("full_rate", F.coalesce("full_rate", F.lit(0.0))).withColumn("net_saved", F.col("gross_saved") - spent)


def reasons(compressions: DataFrame) -> DataFrame:
    """session_id (null: all), overall, reason, events; reasons that telemetry doesn't know count as unknown."""
    d = compressions.select("session_id", known_reason(F.col("reason")).alias("reason"))
    return d.groupingSets([("session_id", "reason"), ("reason",)], "session_id", "reason").agg(F.grouping("session_id").alias("overall"), F.count("*").alias("events"))


def reason_map(found: DataFrame) -> DataFrame:
    """overall, session_id, reasons: a map from reason to events, in order of the reasons."""
    return found.groupBy("overall", "session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "events")))).alias("reasons"))


def scenarios(payloads: DataFrame) -> DataFrame:
    """payloads (id, original, compact, targeted) under four scenarios: tokens in context and the cost of the lifecycle in USD."""
    zero = F.lit(0).cast("long")
    row = lambda name, first, got: F.struct(F.lit(name).alias("scenario"), first.cast("long").alias("first"), got.cast("long").alias("retrieved"))
    original, compact = F.col("original"), F.col("compact")
    names = F.array(row("uncompressed", original, zero), row("no_retrieve", compact, zero), row("targeted_retrieve", compact, F.col("targeted")), row("full_retrieve", compact, original))
    d = payloads.select("id", "original", F.explode(names).alias("s")).select("id", "original", "s.*")
    context = F.col("first") + F.col("retrieved")
    cost = context * PRICE / 1e6 + FUTURE_TURNS * context * CACHED_PRICE / 1e6
    return d.select("id", "scenario", context.alias("tokens"), cost.alias("cost"), (100 * (1 - context / F.nullif(F.col("original"), F.lit(0)))).alias("reduction_pct"))


def break_even(costs: DataFrame) -> DataFrame:
    """id, rate: the share of payloads that could be retrieved in full before compaction stops paying; between 0 and 1."""
    of = lambda s: F.max(F.when(F.col("scenario") == s, F.col("cost")))
    d = costs.groupBy("id").agg(of("uncompressed").alias("base"), of("no_retrieve").alias("none"), of("full_retrieve").alias("all"))
    extra = F.col("all") - F.col("none")
    return d.select("id", F.when(extra <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("base") - F.col("none")) / extra))).alias("rate"))


def parity(results: DataFrame, reference: DataFrame) -> DataFrame:
    """kind, fixtures, median_ratio, savings_ratio of results against reference (both: id, kind, original, output).

    Outputs are compared as shares of their own originals, as the counters differ.
    """
    r = reference.select("id", F.col("original").alias("ref_original"), F.col("output").alias("ref_output"))
    d = results.join(r, "id").withColumn("share", F.col("output") / F.col("original")).withColumn("ref_share", F.col("ref_output") / F.col("ref_original"))
    return d.groupBy("kind").agg(F.count("*").alias("fixtures"), (F.median("share") / F.median("ref_share")).alias("median_ratio"), (F.sum(1 - F.col("share")) / F.nullif(F.sum(1 - F.col("ref_share")), F.lit(0.0))).alias("savings_ratio"))


def rendered(stats: DataFrame) -> DataFrame:
    """stats (from store.stats) with text: one line that tells them."""
    share = F.round(100 * F.col("saved_tokens") / F.nullif(F.col("original_tokens"), F.lit(0)), 1)
    return stats.withColumn("text", F.format_string("entries: %d | original tokens: %d | compressed tokens: %d | saved: %d (%.1f%%) | retrievals: %d", "entries", "original_tokens", "compressed_tokens", "saved_tokens", F.coalesce(share, F.lit(0.0)), "retrievals"))
