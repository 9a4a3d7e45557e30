"""Queries: the store, retrieval, sessions, telemetry and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import text, tokens
from sievework.operators import lossless, policy, retrieve, sessions, store, telemetry
from sievework.plans.basic import tokens_sql
from sievework.plans.views import DUCK, spark_view, view_sql
from sievework.session import table

NOW = 950_000
_E = view_sql("v_entries", DUCK)


def _entries(spark, d):
    return spark_view(spark, d, "v_entries").withColumn("tool", F.lit(None).cast("string")).withColumn("call_id", F.col("id")).withColumn("default_mode", F.lit(None).cast("string")).withColumn("default_max_chars", F.lit(None).cast("int"))


def store_live(spark, d):
    return store.live(_entries(spark, d), NOW).select("id", "hash")


def store_newest(spark, d):
    return store.newest(store.live(_entries(spark, d), NOW), 100).select("id", "hash")


def store_stats(spark, d):
    return store.stats(_entries(spark, d), NOW, "session_id")


def store_latest(spark, d):
    e = _entries(spark, d)
    asked = e.select(F.col("id").alias("request_id"), "hash", F.when(F.col("id") % 2 == 0, F.col("session_id")).alias("session_id"))
    return store.latest(asked, e, NOW).select("request_id", F.col("entry.id").alias("entry_id"))


def store_orphans(spark, d):
    e = _entries(spark, d)
    return store.orphans(e.select("hash", store.digest(F.col("content")).alias("digest")).distinct(), store.without_session(store.live(e, NOW), "en")).select("hash")


def store_keys(spark, d):
    """Keys under a base hash of two digits, so that contents do collide: distinct keys for distinct contents."""
    e = _entries(spark, d).drop("hash")
    keyed = store.with_keys(e, base=F.substring(F.sha2("content", 256), 1, 2))
    return keyed.agg(F.count("*").alias("entries"), F.countDistinct("hash").alias("keys"), F.countDistinct("content").alias("contents"))


def _asked(spark, d, **columns):
    e = _entries(spark, d)
    blank = {"mode": "string", "query": "string", "start_line": "int", "end_line": "int", "lines": "int", "context": "int", "max_matches": "int", "max_chars": "int"}
    return retrieve.retrieve(e.withColumns({n: columns.get(n, F.lit(None)).cast(t) for n, t in blank.items()}))


def _out(df):
    return df.select("id", F.char_length("output").cast("long").alias("chars"), F.sha2("output", 256).alias("output_sha256"))


def retrieve_query(spark, d):
    return _out(_asked(spark, d, query=F.lit("thation und qui"), context=F.lit(1), max_matches=F.lit(3)))


def retrieve_range(spark, d):
    return _out(_asked(spark, d, start_line=F.lit(2), end_line=F.lit(4)))


def retrieve_head(spark, d):
    return _out(_asked(spark, d, mode=F.lit("head"), lines=F.lit(3)))


def retrieve_tail(spark, d):
    return _out(_asked(spark, d, mode=F.lit("tail"), lines=F.lit(3), max_chars=F.lit(400)))


def retrieve_summary(spark, d):
    return _out(_asked(spark, d))


def retrieve_full(spark, d):
    return _out(_asked(spark, d, mode=F.lit("full")))


def repetition_exact(spark, d):
    v = spark_view(spark, d, "v_repeat")
    return sessions.exact_repeats(v).where("of_seq is not null").select("session_id", "seq", "of_seq")


def repetition_similar(spark, d):
    return sessions.similar_repeats(spark_view(spark, d, "v_repeat")).select("session_id", "seq", "of_seq", F.round("similarity", 6).alias("similarity"), sessions.repeat_note(F.col("similarity")).alias("note"))


def _blocks(spark, d):
    v = spark_view(spark, d, "v_repeat")
    return v.select("session_id", F.col("seq").cast("long").alias("turn"), F.col("content").alias("text"), F.lit(False).alias("protected"))


def span_anchors(spark, d):
    return sessions.span_anchors(_blocks(spark, d)).groupBy("session_id", "turn").agg(F.count("*").alias("anchors"), F.sum(F.col("idx").cast("long")).alias("idx_sum"), F.sum(F.col("of_idx").cast("long")).alias("of_idx_sum"))


def span_fold_stats(spark, d):
    return sessions.with_spans_folded(_blocks(spark, d)).select("session_id", "turn", "spans", "lines", F.char_length("folded").alias("chars"))


def read_states(spark, d):
    return sessions.read_states(spark_view(spark, d, "v_file_ops")).select("session_id", "seq", "path", "state")


def read_markers(spark, d):
    r = sessions.read_states(spark_view(spark, d, "v_file_ops")).where("state <> 'fresh'")
    path = F.concat(F.lit("src/[x]/"), F.col("path"))
    return r.select("seq", sessions.read_marker(path, F.col("state"), text.content_hash(F.col("path"))).alias("marker"))


def context_live_parts(spark, d):
    return sessions.live_parts(spark_view(spark, d, "v_parts")).where("live").select("session_id", "snapshot", "call_id")


def session_intent(spark, d):
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", "text")
    return sessions.intents(t).select("session_id", "turn", F.sha2("intent", 256).alias("intent_sha256"))


def pending_parts(spark, d):
    parts = spark_view(spark, d, "v_parts")
    waiting = parts.where("message_idx % 2 = 1").select("session_id", "call_id").distinct()
    return sessions.pending_parts(parts, waiting).select("session_id", "snapshot", "call_id")


def telemetry_sessions(spark, d):
    t = spark_view(spark, d, "v_telemetry")
    s = telemetry.snapshot(t.select("session_id", "outcome", "tokens_saved", "latency_ms"), t.where("mode is not null").select("session_id", "mode", "miss", "output_tokens"))
    return s.select("session_id", "compressed", "skipped", "error", "gross_saved", "latency_count", F.round("latency_total", 4).alias("latency_total"), "latency_max", "retrievals", "misses", F.round("full_rate", 6).alias("full_rate"), "tokens_summary", "tokens_full", "net_saved")


def telemetry_reasons(spark, d):
    return telemetry.reasons(spark_view(spark, d, "v_telemetry")).select("session_id", "reason", "events")


#: Reasons of all sorts, some of them unknown to telemetry.
_SOME_REASONS = ("invalid_json", "strategy_circuit_open", "candidate_empty_candidate", "candidate_protected_fact_lost", "engine_error", "mixed_passthrough", "code_passthrough", "skip_tool", "nothing_to_compress", "strategy_error:KeyError", "Compressed", "")


def reason_projection(spark, d):
    r = F.get(F.array(*map(F.lit, _SOME_REASONS)), (F.col("event_id") % len(_SOME_REASONS)).cast("int"))
    return table(spark, d, "events").select("event_id", policy.known_reason(r).alias("reason"))


def _payloads(spark, d):
    f = lossless.with_runs_folded(spark_view(spark, d, "v_log_runs"))
    return f.select("id", tokens.tokens(F.col("content")).alias("original"), tokens.tokens(F.col("folded")).alias("compact"), F.lit(100).cast("long").alias("targeted"))


def cost_scenarios(spark, d):
    return telemetry.scenarios(_payloads(spark, d)).select("id", "scenario", "tokens", F.round("cost", 9).alias("cost"), F.round("reduction_pct", 6).alias("reduction_pct"))


def break_even(spark, d):
    return telemetry.break_even(telemetry.scenarios(_payloads(spark, d))).select("id", F.round("rate", 6).alias("rate"))


def parity_ratios(spark, d):
    p = _payloads(spark, d)
    kind = F.when(F.col("id") < "2024-01-15", "early").otherwise("late")
    return telemetry.parity(p.select("id", kind.alias("kind"), "original", F.col("compact").alias("output")), p.select("id", "original", F.ceil(F.col("original") / 2).alias("output"))).select("kind", "fixtures", F.round("median_ratio", 6).alias("median_ratio"), F.round("savings_ratio", 6).alias("savings_ratio"))


def _marked_reads(spark, d):
    r = sessions.read_states(spark_view(spark, d, "v_file_ops"))
    return r.withColumn("call_id", F.when(F.col("seq") % 7 != 0, F.col("seq"))).withColumn("output", F.concat(F.repeat(F.concat(F.lit("row of "), "path", F.lit("; ")), (F.col("seq") % 90).cast("int")), F.when(F.col("seq") % 11 == 0, "[Retrieve more: hash=0123456789abcdef01234567]").otherwise("")))


def read_replacements(spark, d):
    return sessions.replaceable(_marked_reads(spark, d)).select("seq", "state", "replace")


def read_replays(spark, d):
    e = _entries(spark, d)
    note = F.concat(F.lit("[Read of f is stale after a later write. Retrieve original: hash="), "hash", F.lit("]"))
    marked = e.select("id", note.alias("output"), F.when(F.col("id") % 6 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")).alias("original"))
    return sessions.replayed(marked, e, NOW).select("id", F.sha2("shown", 256).alias("shown_sha256"))


def context_replays(spark, d):
    p = spark_view(spark, d, "v_parts")
    q = p.select("session_id", "snapshot", F.col("call_id").alias("key"), F.concat("output", F.when(F.col("snapshot") > 3, "x").otherwise("")).alias("source"), F.concat(F.lit("s"), "snapshot").alias("sent"))
    return sessions.replays(q).select("session_id", "snapshot", "key", "shown")


def store_stats_text(spark, d):
    return telemetry.rendered(store.stats(_entries(spark, d), NOW, "session_id")).select("session_id", "text")


QUERIES = {
    f.__name__: f
    for f in (
        store_live, store_newest, store_stats, store_latest, store_orphans, store_keys, retrieve_query, retrieve_range, retrieve_head, retrieve_tail, retrieve_summary, retrieve_full, repetition_exact, repetition_similar, span_anchors, span_fold_stats,
        read_states, read_markers, read_replacements, read_replays, context_replays, store_stats_text, context_live_parts, session_intent, pending_parts, telemetry_sessions, telemetry_reasons, reason_projection, cost_scenarios, break_even, parity_ratios,
    )
}

_LIVE = f"e AS ({_E}), l AS (SELECT * FROM e WHERE expires_ms > {NOW})"
_REQ = f"e AS (SELECT *, string_split_regex(content, '\\r?\\n') AS ls FROM ({_E}) x)"


def _head(mode: str, detail: str) -> str:
    return f"'[Retrieve]' || chr(10) || 'hash: ' || hash || chr(10) || 'mode: {mode}' || chr(10) || 'strategy: ' || strategy || chr(10) || 'original tokens: ' || original_tokens || chr(10) || 'original chars: ' || length(content) || chr(10) || {detail} || chr(10)"


def _clip(x: str, n: int) -> str:
    note = f"chr(10) || '[truncated to {n} chars; use narrower query/range or mode=full]'"
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE substr({x}, 1, {n} - length({note})) || {note} END"


def _num(a: str, b: str) -> str:
    return f"array_to_string(list_transform(range(({a})::BIGINT, ({b})::BIGINT + 1), lambda i: i || ': ' || ls[i]), chr(10))"


def _final(mode: str, expr: str, n: int = 12_000) -> str:
    return f"SELECT id, length(o) AS chars, sha256(o) AS output_sha256 FROM (SELECT id, {_clip('raw', n)} AS o FROM (SELECT id, {expr} AS raw FROM e) y) z"


_WORDS = "['thation', 'und', 'qui']"
_PARTS = view_sql("v_parts", DUCK)
_LIVE_PARTS = f"""p AS ({_PARTS}), q AS (SELECT *, min(snapshot) OVER (PARTITION BY session_id) AS f, min(snapshot) OVER (PARTITION BY session_id, message_idx, part_idx, call_id) AS seen, max(CASE WHEN cache_control THEN message_idx END) OVER (PARTITION BY session_id, snapshot) AS fr FROM p), v AS (SELECT session_id, snapshot, call_id, message_idx FROM q WHERE seen = snapshot AND snapshot > f AND message_idx > coalesce(fr, -1))"""
_OPS = f"o AS (SELECT *, offset_ IS NULL AND limit_ IS NULL AS full_read FROM ({view_sql('v_file_ops', DUCK)}) x), st AS (SELECT a.session_id, a.seq, a.path, CASE WHEN EXISTS (SELECT 1 FROM o b WHERE b.session_id = a.session_id AND b.path = a.path AND b.seq > a.seq AND b.kind = 'write') THEN 'stale' WHEN EXISTS (SELECT 1 FROM o b WHERE b.session_id = a.session_id AND b.path = a.path AND b.seq > a.seq AND b.kind = 'read' AND (b.full_read OR (NOT a.full_read AND b.offset_ <= a.offset_ AND b.offset_ + b.limit_ >= a.offset_ + a.limit_))) THEN 'superseded' ELSE 'fresh' END AS state FROM o a WHERE a.kind = 'read')"
_REP = view_sql("v_repeat", DUCK)
_TOK = f"""tk AS (SELECT id, {tokens_sql('content')} AS original, {tokens_sql('folded')} AS compact FROM (SELECT id, folded, content FROM o JOIN v USING (id)) y)"""
_TEL = view_sql("v_telemetry", DUCK)


def _costs() -> str:
    from sievework.plans.basic import runs_sql

    base = runs_sql(view_sql("v_log_runs", DUCK))
    return f"""{base}, {_TOK}, sc AS (SELECT id, original, 'uncompressed' AS scenario, original AS tokens FROM tk UNION ALL SELECT id, original, 'no_retrieve', compact FROM tk UNION ALL SELECT id, original, 'targeted_retrieve', compact + 100 FROM tk UNION ALL SELECT id, original, 'full_retrieve', compact + original FROM tk),
 co AS (SELECT *, tokens * 3.0::DOUBLE / 1e6 + 3 * tokens * 0.3::DOUBLE / 1e6 AS cost FROM sc)"""


def _snap(where: str, key: str) -> str:
    return f"""SELECT {key} AS session_id, count(*) FILTER (WHERE outcome = 'compressed') AS compressed, count(*) FILTER (WHERE outcome = 'skipped') AS skipped, count(*) FILTER (WHERE outcome = 'error') AS error, coalesce(sum(tokens_saved) FILTER (WHERE outcome = 'compressed'), 0)::BIGINT AS gross_saved, count(*) AS latency_count, round(sum(latency_ms), 4) AS latency_total, max(latency_ms) AS latency_max,
 count(mode) AS retrievals, count(*) FILTER (WHERE miss AND mode IS NOT NULL) AS misses, round(coalesce(avg((mode = 'full')::INT) FILTER (WHERE mode IS NOT NULL), 0), 6) AS full_rate, coalesce(sum(output_tokens) FILTER (WHERE mode = 'summary'), 0)::BIGINT AS tokens_summary, coalesce(sum(output_tokens) FILTER (WHERE mode = 'full'), 0)::BIGINT AS tokens_full, (gross_saved - coalesce(sum(output_tokens) FILTER (WHERE mode IS NOT NULL), 0))::BIGINT AS net_saved FROM ({_TEL}) t {where}"""


_ROW = "repeat('row of ' || path || '; ', (seq % 90)::INT) || CASE WHEN seq % 11 = 0 THEN '[Retrieve more: hash=0123456789abcdef01234567]' ELSE '' END"

ORACLES = {
    "read_replacements": f"""WITH {_OPS}, r AS (SELECT *, {_ROW} AS output, '[Read of ' || path || CASE state WHEN 'stale' THEN ' is stale after a later write' ELSE ' is superseded by a later Read' END || '. Retrieve original: hash=' || substr(sha256({_ROW}), 1, 24) || ']' AS marker FROM st)
 SELECT seq, state, state <> 'fresh' AND seq % 7 <> 0 AND strlen(output) >= 512 AND seq % 11 <> 0 AND {tokens_sql('marker')} < {tokens_sql('output')} AS replace FROM r""",
    "read_replays": f"WITH {_LIVE} SELECT id, sha256(CASE WHEN id % 6 <> 0 AND EXISTS (SELECT 1 FROM l WHERE l.hash = e.hash) THEN '[Read of f is stale after a later write. Retrieve original: hash=' || hash || ']' WHEN id % 6 = 0 THEN content || '!' ELSE content END) AS shown_sha256 FROM e",
    "context_replays": f"WITH p AS ({_PARTS}) SELECT session_id, snapshot, call_id AS key, 's' || min(snapshot) OVER (PARTITION BY session_id, call_id, snapshot > 3) AS shown FROM p",
    "store_stats_text": f"WITH {_LIVE} SELECT session_id, 'entries: ' || count(*) || ' | original tokens: ' || sum(original_tokens)::BIGINT || ' | compressed tokens: ' || sum(compressed_tokens)::BIGINT || ' | saved: ' || sum(greatest(0, original_tokens - compressed_tokens))::BIGINT || ' (' || printf('%.1f', round(100 * sum(greatest(0, original_tokens - compressed_tokens)) / sum(original_tokens), 1)) || '%) | retrievals: ' || sum(retrieval_count)::BIGINT AS text FROM l GROUP BY session_id",
    "store_live": f"WITH {_LIVE} SELECT id, hash FROM l",
    "store_newest": f"WITH {_LIVE}, r AS (SELECT *, row_number() OVER (ORDER BY created_ms DESC, id DESC) AS r FROM l) SELECT id, hash FROM r WHERE r <= 100",
    "store_stats": f"WITH {_LIVE} SELECT session_id, count(*) AS entries, sum(original_tokens)::BIGINT AS original_tokens, sum(compressed_tokens)::BIGINT AS compressed_tokens, sum(greatest(0, original_tokens - compressed_tokens))::BIGINT AS saved_tokens, sum(retrieval_count)::BIGINT AS retrievals FROM l GROUP BY session_id",
    "store_latest": f"WITH {_LIVE} SELECT r.id AS request_id, (SELECT max(l.id) FROM l WHERE l.hash = r.hash AND (r.id % 2 <> 0 OR l.session_id = r.session_id)) AS entry_id FROM e r",
    "store_orphans": f"WITH {_LIVE} SELECT DISTINCT hash FROM e WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.hash = e.hash AND l.session_id <> 'en')",
    "store_keys": "SELECT count(*) AS entries, count(DISTINCT text) AS keys, count(DISTINCT text) AS contents FROM documents",
    "retrieve_query": f"WITH {_REQ}, h AS (SELECT *, list_slice(list_filter(range(1, len(ls) + 1), lambda i: len(list_filter({_WORDS}, lambda w: contains(lower(nfc_normalize(ls[i])), w))) > 0), 1, 3) AS hits FROM e), s AS (SELECT *, list_sort(list_distinct(flatten(list_transform(hits, lambda i: range(greatest(1, i - 1), least(len(ls), i + 1) + 1))))) AS near FROM h), f AS (SELECT id, CASE WHEN len(hits) = 0 THEN " + _head("query", "'query: thation und qui | matches: 0 | original lines: ' || len(ls)") + " || chr(10) || 'No matching lines found. Try a broader query, mode=head, mode=tail, mode=range, or mode=full.' ELSE " + _head("query", "'query: thation und qui | matches: ' || len(hits) || ' | returned lines: ' || len(near) || ' | original lines: ' || len(ls)") + " || chr(10) || array_to_string(list_transform(near, lambda i: i || ': ' || ls[i]), chr(10)) END AS raw FROM s) SELECT id, length(o) AS chars, sha256(o) AS output_sha256 FROM (SELECT id, " + _clip("raw", 12_000) + " AS o FROM f) z",
    "retrieve_range": f"WITH {_REQ} " + _final("range", _head("range", "'lines: 2-4 | original lines: ' || len(ls)") + " || chr(10) || " + _num("least(2, len(ls))", "greatest(least(2, len(ls)), least(4, len(ls)))")),
    "retrieve_head": f"WITH {_REQ} " + _final("head", _head("head", "'lines: 1-' || least(3, len(ls)) || ' | original lines: ' || len(ls)") + " || chr(10) || " + _num("1", "least(3, len(ls))")),
    "retrieve_tail": f"WITH {_REQ} " + _final("tail", _head("tail", "'lines: ' || greatest(1, len(ls) - 2) || '-' || len(ls) || ' | original lines: ' || len(ls)") + " || chr(10) || " + _num("greatest(1, len(ls) - 2)", "len(ls)"), 400),
    "retrieve_summary": f"WITH {_REQ} " + _final("summary", _head("summary", "'original lines: ' || len(ls)") + f" || chr(10) || 'tool: unknown' || chr(10) || 'call: ' || id || chr(10) || 'compressed tokens: ' || compressed_tokens || chr(10) || 'retrieval count: ' || retrieval_count || chr(10) || chr(10) || '{retrieve.ADVICE}' || chr(10) || chr(10) || 'Preview:' || chr(10) || " + _num("1", "least(5, len(ls))") + " || CASE WHEN len(ls) > 10 THEN chr(10) || '...' || chr(10) || " + _num("len(ls) - 4", "len(ls)") + " ELSE '' END"),
    "retrieve_full": f"SELECT id, length(content) AS chars, sha256(content) AS output_sha256 FROM ({_E}) e",
    "repetition_exact": f"WITH r AS ({_REP}) SELECT a.session_id, a.seq, max(b.seq) AS of_seq FROM r a JOIN r b ON a.session_id = b.session_id AND a.content = b.content AND b.seq < a.seq GROUP BY 1, 2",
    "repetition_similar": f"""WITH r AS ({_REP}), l AS (SELECT DISTINCT session_id, seq, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS k FROM (SELECT session_id, seq, unnest(string_split(content, chr(10))) AS line FROM r) x WHERE regexp_matches(line, '\\S')), n AS (SELECT session_id, seq, count(*) AS n FROM l GROUP BY 1, 2 HAVING count(*) >= 8),
 b AS (SELECT x.session_id, x.seq, y.seq AS of_seq, count(*) AS c FROM l x JOIN l y ON x.session_id = y.session_id AND x.k = y.k AND y.seq < x.seq GROUP BY 1, 2, 3), j AS (SELECT b.*, c / (n1.n + n2.n - c) AS s FROM b JOIN n n1 ON n1.session_id = b.session_id AND n1.seq = b.seq JOIN n n2 ON n2.session_id = b.session_id AND n2.seq = b.of_seq),
 k AS (SELECT *, row_number() OVER (PARTITION BY session_id, seq ORDER BY s DESC, of_seq DESC) AS rn FROM j WHERE s >= 0.9) SELECT session_id, seq, of_seq, round(s, 6) AS similarity, CASE WHEN s >= 1 THEN '[Repeated tool output: exact match to an earlier result in this session]' ELSE '[Repeated tool output: ' || round(s * 100)::INT || '% similar to an earlier result in this session]' END AS note FROM k WHERE rn = 1""",
    "span_anchors": f"""WITH r AS ({_REP}), l AS (SELECT session_id, seq::BIGINT AS turn, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS idx, unnest(string_split(content, chr(10))) AS line FROM r), a AS (SELECT *, CASE WHEN regexp_matches(line, '(?s)^\\d+[:\\t]') THEN regexp_extract(line, '(?s)^\\d+([:\\t].*)$', 1) ELSE line END AS k FROM l WHERE length(trim(line)) >= 4),
 f AS (SELECT *, row_number() OVER (PARTITION BY session_id, k ORDER BY turn, idx) AS p FROM a) SELECT a.session_id, a.turn, count(*) AS anchors, sum(a.idx)::BIGINT AS idx_sum, sum(f.idx)::BIGINT AS of_idx_sum FROM a JOIN f ON a.session_id = f.session_id AND a.k = f.k AND f.turn < a.turn AND f.p <= 16 GROUP BY 1, 2""",
    "read_states": f"WITH {_OPS} SELECT * FROM st",
    "read_markers": f"WITH {_OPS} SELECT seq, '[Read of src/?x?/' || path || CASE state WHEN 'stale' THEN ' is stale after a later write' ELSE ' is superseded by a later Read' END || '. Retrieve original: hash=' || substr(sha256(path), 1, 24) || ']' AS marker FROM st WHERE state <> 'fresh'",
    "context_live_parts": f"WITH {_LIVE_PARTS} SELECT session_id, snapshot, call_id FROM v",
    "pending_parts": f"WITH {_LIVE_PARTS} SELECT session_id, snapshot, call_id FROM v WHERE message_idx % 2 = 1",
    "session_intent": "SELECT conv_id AS session_id, turn, sha256((SELECT left(trim(c.text, ' ' || chr(9) || chr(10) || chr(13)), 2000) FROM conversations c WHERE c.conv_id = a.conv_id AND c.turn <= a.turn AND c.role = 'user' AND trim(c.text, ' ' || chr(9) || chr(10) || chr(13)) <> '' ORDER BY c.turn DESC LIMIT 1)) AS intent_sha256 FROM conversations a",
    "telemetry_sessions": _snap("GROUP BY session_id", "session_id") + " UNION ALL " + _snap("", "NULL"),
    "telemetry_reasons": f"WITH t AS (SELECT session_id, CASE reason WHEN 'odd_reason' THEN 'unknown' ELSE reason END AS reason FROM ({_TEL}) x) SELECT session_id, reason, count(*) AS events FROM t GROUP BY GROUPING SETS ((session_id, reason), (reason))",
    "reason_projection": "SELECT event_id, list_value('invalid_json', 'strategy_circuit_open', 'candidate_empty_candidate', 'candidate_protected_fact_lost', 'engine_error', 'mixed_passthrough', 'code_passthrough', 'skip_tool', 'unknown', 'unknown', 'unknown', 'unknown')[(event_id % 12) + 1] AS reason FROM events",
    "cost_scenarios": _costs() + " SELECT id, scenario, tokens, round(cost, 9) AS cost, round(100 * (1 - tokens / original), 6) AS reduction_pct FROM co",
    "break_even": _costs() + ", w AS (SELECT id, max(cost) FILTER (WHERE scenario = 'uncompressed') AS b, max(cost) FILTER (WHERE scenario = 'no_retrieve') AS n, max(cost) FILTER (WHERE scenario = 'full_retrieve') AS a FROM co GROUP BY id) SELECT id, round(CASE WHEN a <= n THEN 1.0 ELSE greatest(0, least(1, (b - n) / (a - n))) END, 6) AS rate FROM w",
    "parity_ratios": _costs() + ", z AS (SELECT CASE WHEN id < '2024-01-15' THEN 'early' ELSE 'late' END AS kind, compact / original AS s, ceil(original / 2) / original AS r FROM tk) SELECT kind, count(*) AS fixtures, round(median(s) / median(r), 6) AS median_ratio, round(sum(1 - s) / sum(1 - r), 6) AS savings_ratio FROM z GROUP BY kind",
}
