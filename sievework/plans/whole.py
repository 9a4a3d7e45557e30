"""Queries: the whole compaction, and what must hold of its results."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions.text import content_hash
from sievework.operators import compaction, html
from sievework.plans.views import DUCK, spark_view, view_sql


def _payloads(spark, d):
    return spark_view(spark, d, "v_all").select(F.concat("view_name", F.lit("/"), "id").alias("id"), "content", F.lit("").alias("query"))


def compact_all(spark, d):
    return compaction.compact(_payloads(spark, d)).select("id", "kind", "strategy", "reason", "changed", "original_tokens", "compressed_tokens", F.sha2("output", 256).alias("output_sha256"))


def compact_by_kind(spark, d):
    return compaction.compact(_payloads(spark, d)).groupBy("kind", "strategy").agg(F.count("*").alias("payloads"), F.sum("original_tokens").alias("original_tokens"), F.sum("compressed_tokens").alias("compressed_tokens"))


def compact_broken_promises(spark, d):
    """Payloads whose result breaks a promise: no fewer tokens, a lost fact, a changed text without savings. There should be none."""
    return broken_promises(compaction.compact(_payloads(spark, d)))


def broken_promises(c):
    """The test is one more column of the compaction's own pass, so texts are neither stored nor shuffled. A filter alone would be pushed below
    the columns that it reads and compute them again; none passes a generator.
    """
    lossy = F.col("changed") & (F.col("strategy") != "lossless") & (F.col("kind") != "json")
    lost = html.lost_fact(html.protected_facts(F.col("kind"), F.col("content")), F.col("output"))
    bad = (F.col("changed") & (F.col("compressed_tokens") >= F.col("original_tokens"))) | (~F.col("changed") & (F.col("output") != F.col("content"))) | (lossy & lost) | (F.col("hash") != content_hash(F.col("content")))
    tested = F.array(F.struct("id", "kind", "strategy", bad.alias("bad")))
    return c.select(F.inline(tested)).where("bad").drop("bad")


def envelopes(spark, d):
    v = spark_view(spark, d, "v_log").select("id", F.concat(F.lit("<returncode>0</returncode>\n<stdout>\n"), "content", F.lit("\n</stdout>")).alias("content"))
    return compaction.unwrapped(v).select("id", "prefix", F.sha2("payload", 256).alias("payload_sha256"), "suffix")


def mixed_sections(spark, d):
    v = spark_view(spark, d, "v_log").select("id", F.concat(F.lit("<stdout>\n"), "content", F.lit("\n</stdout>\n<stderr>oops "), "id", F.lit("</stderr>")).alias("content"))
    return compaction.sections(v).select("id", "pos", "open", F.sha2("body", 256).alias("body_sha256"))


QUERIES = {f.__name__: f for f in (compact_all, compact_by_kind, compact_broken_promises, envelopes, mixed_sections)}



_LOG = view_sql("v_log", DUCK)
ORACLES = {
    "compact_broken_promises": "SELECT ''::VARCHAR AS id, ''::VARCHAR AS kind, ''::VARCHAR AS strategy WHERE false",
    "envelopes": f"SELECT id, '<returncode>0</returncode>' || chr(10) || '<stdout>' || chr(10) AS prefix, sha256(content) AS payload_sha256, chr(10) || '</stdout>' AS suffix FROM ({_LOG}) v",
    "mixed_sections": f"SELECT id, 0::INT AS pos, '<stdout>' || chr(10) AS open, sha256(content) AS body_sha256 FROM ({_LOG}) v UNION ALL SELECT id, 1, '<stderr>', sha256('oops ' || id) FROM ({_LOG}) v",
}
