"""Queries: bounded state by key, commands, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.operators import commands
from sievework.plans.views import DUCK, spark_view, view_sql
from sievework.sources import outputs
from sievework.streaming import state


def _events(spark, d):
    v = spark_view(spark, d, "v_tool_calls")
    return v.select(F.col("session_id").alias("key"), (F.col("call_id") * 1000).alias("seq"), F.col("output").alias("value"), F.when(F.col("seq") % 3 == 0, "user").otherwise("assistant").alias("role"), (~F.col("output").startswith("request error")).alias("ok"))


def breaker_states(spark, d):
    return state.run_batch(_events(spark, d), "breaker")


def decision_cache(spark, d):
    return state.run_batch(_events(spark, d), "cache")


def repetition_state(spark, d):
    return state.run_batch(_events(spark, d), "repeats")


def intent_state(spark, d):
    return state.run_batch(_events(spark, d), "intent")


def file_read_commands(spark, d):
    p = F.array(F.lit("cat "), F.lit("cd /x && sudo head -n 5 "), F.lit("bash -lc 'tail "), F.lit("sed -n 1,5p "), F.lit("grep x "), F.lit("cat a > "), F.lit("FOO=1 timeout 5 less "))
    from sievework.session import table

    cmd = F.concat(F.get(p, (F.col("p_partkey") % 7).cast("int")), F.when(F.col("p_size") % 4 == 0, "go.sum").otherwise("f.py"))
    part = table(spark, d, "part").select("p_partkey", cmd.alias("cmd"))
    return part.select("p_partkey", commands.is_file_read("cmd").alias("reads"))


def root_containment(spark, d):
    v = spark_view(spark, d, "v_tool_calls").select("call_id", F.concat(F.when(F.col("call_id") % 2 == 0, "/work/out/").otherwise("/work/outside/"), "tool", F.when(F.col("call_id") % 3 == 0, "/../x").otherwise(".txt")).alias("path"))
    return v.select("call_id", outputs.within_root(F.col("path"), "/work/out").alias("inside"), outputs.truncated(F.concat(F.lit("  ...output truncated"), F.lit(" x")), F.col("call_id") > 5).alias("truncated"))


QUERIES = {f.__name__: f for f in (breaker_states, decision_cache, repetition_state, intent_state, file_read_commands, root_containment)}

_T = view_sql("v_tool_calls", DUCK)
ORACLES = {
    "intent_state": f"SELECT session_id AS key, call_id * 1000 AS seq, last_value(CASE WHEN seq % 3 = 0 AND output <> '' THEN output END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq) AS result FROM ({_T}) t",
    "file_read_commands": "SELECT p_partkey, p_partkey % 7 IN (0, 1, 2, 3, 6) AND p_size % 4 <> 0 OR (p_partkey % 7 = 2 AND p_size % 4 = 0 AND false) AS reads FROM part",
    "root_containment": f"SELECT call_id, call_id % 2 = 0 AND call_id % 3 <> 0 AS inside, true AS truncated FROM ({_T}) t",
    "repetition_state": f"WITH t AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM ({_T}) x) SELECT a.session_id AS key, a.call_id * 1000 AS seq, (SELECT max(b.call_id * 1000) FROM t b WHERE b.session_id = a.session_id AND b.output = a.output AND b.n < a.n AND b.n >= a.n - 32)::VARCHAR AS result FROM t a",
}
