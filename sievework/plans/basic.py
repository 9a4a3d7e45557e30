"""Queries: tokens, hashes, markers, policy, admission, detection, lossless folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import detect, text, tokens
from sievework.operators import lossless, policy
from sievework.plans.views import DUCK, spark_view, view_sql

POLICY = policy.Policy(rules=(policy.Rule("keep-db", ("mcp_db_*",), "preserve"), policy.Rule("hard-grep", ("gre?",), "compress", "aggressive", min_tokens=1, min_chars=1)))


def token_count(spark, d):
    c = F.col("content")
    return spark_view(spark, d, "v_all").select("view_name", "id", tokens.token_class(c).alias("class"), tokens.tokens(c).alias("tokens"))


def token_count_turns(spark, d):
    return spark_view(spark, d, "v_turns").select("id", tokens.tokens(F.col("content")).alias("tokens"))


def content_hash_dups(spark, d):
    h = spark_view(spark, d, "v_text").select("id", text.content_hash(F.col("content")).alias("hash"))
    return h.groupBy("hash").agg(F.count("*").alias("copies"), F.min(F.col("id").cast("long")).alias("first_id")).where("copies > 1")


def marker_flags(spark, d):
    o = F.col("output")
    return spark_view(spark, d, "v_tool_calls").select("call_id", text.has_marker(o).alias("marked"), text.strong_error(o).alias("strong_error"), text.valid_hash(F.regexp_extract(o, "hash=([0-9A-Za-z]*)", 1)).alias("valid_hash"))


def policy_resolution(spark, d):
    return policy.with_policy(spark_view(spark, d, "v_tool_calls").select("tool").distinct(), POLICY).select("tool", "rule_id", "rule_source", "action", "strength")


def admission(spark, d):
    return policy.admit(spark_view(spark, d, "v_tool_calls"), POLICY).select("call_id", "original_tokens", "reason")


def admission_protected(spark, d):
    """Payloads of all kinds as outputs of commands, some of which show a file: what is held back so that it stays exact."""
    v = spark_view(spark, d, "v_all").select("view_name", "id", "content", F.lit("shell").alias("tool"), F.when(F.char_length("content") % 2 == 0, '{"command": "cd /x && cat -n f.py"}').otherwise('{"cmd": ["grep", "-n", "x"]}').alias("args"))
    return policy.admit(v, POLICY, output="content", args="args").select("view_name", "id", "reason")


def detect_kind(spark, d):
    return detect.with_kind(spark_view(spark, d, "v_all")).select("view_name", "id", "kind", F.round("confidence", 6).alias("confidence"))


def compression_queries(spark, d):
    v = spark_view(spark, d, "v_tool_calls").select("call_id", F.array("tool", "output", F.lit(""), F.repeat("tool", 40)).alias("args"), F.concat(F.lit("  look at "), F.col("output"), F.lit(" ")).alias("intent"))
    return v.select("call_id", policy.compression_query(F.col("args"), F.col("intent")).alias("query"))


def lossless_runs(spark, d):
    v = spark_view(spark, d, "v_log_runs").unionAll(spark_view(spark, d, "v_text"))
    return lossless.with_runs_folded(v).select("id", F.sha2("folded", 256).alias("folded_sha256"), F.char_length("folded").cast("long").alias("folded_chars"))


def lossless_runs_not_undone(spark, d):
    """Rows of which the fold doesn't come back: there should be none but texts that hold run notes themselves."""
    v = spark_view(spark, d, "v_log_runs").unionAll(spark_view(spark, d, "v_text"))
    return lossless.not_undone(lossless.with_runs_folded(v), "log")


def search_heading(spark, d):
    return lossless.with_headings(spark_view(spark, d, "v_search")).select("id", F.sha2("folded", 256).alias("folded_sha256"), F.char_length("folded").cast("long").alias("folded_chars"))


def search_heading_not_undone(spark, d):
    return lossless.not_undone(lossless.with_headings(spark_view(spark, d, "v_search")), "search")


def json_table_fold(spark, d):
    v = spark_view(spark, d, "v_json")
    return v.select("id", F.sha2(lossless.table_folded("content"), 256).alias("folded_sha256"))


def lossless_by_kind(spark, d):
    out = lossless.compact(detect.with_kind(spark_view(spark, d, "v_all")))
    return out.groupBy("kind").agg(F.count("*").alias("payloads"), F.sum((F.col("lossless") != F.col("content")).cast("long")).alias("folded"), F.sum(F.char_length("lossless").cast("long")).alias("chars"))


QUERIES = {f.__name__: f for f in (token_count, token_count_turns, content_hash_dups, marker_flags, policy_resolution, admission, admission_protected, detect_kind, compression_queries, lossless_runs, lossless_runs_not_undone, search_heading, search_heading_not_undone, json_table_fold, lossless_by_kind)}

_CJK = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]"
_PROSE = "greatest(1, coalesce(list_sum(list_transform(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+|[^\\s\\p{{L}}\\p{{N}}_]'), lambda p: CASE WHEN regexp_matches(p, '^[\\p{{L}}\\p{{N}}_]') THEN ceil(length(p) / 4.0) ELSE 1 END)), 0))"
_CODE = "greatest(1, ceil(coalesce(list_sum(list_transform(regexp_extract_all({x}, '[A-Za-z_$][\\w$]*|\\d+(?:\\.\\d+)?|[^\\s\\w]'), lambda p: CASE WHEN regexp_matches(p, '^[A-Za-z_$]') THEN 5 * ceil(length(p) / 4.0) WHEN regexp_matches(p, '^\\d') THEN 5 * ceil(length(p) / 3.0) ELSE 3 END)), 0) / 5.0))"


def tokens_sql(x: str) -> str:
    return f"""CASE WHEN {x} = '' THEN 0 ELSE CASE {class_sql(x)}
  WHEN 'code' THEN {_CODE.format(x=x)} WHEN 'high_entropy' THEN greatest(1, ceil(length({x}) * 5 / 8.0))
  WHEN 'cjk' THEN len(regexp_extract_all({x}, '{_CJK}')) + {_PROSE.format(x=f"regexp_replace({x}, '{_CJK}', ' ', 'g')")} ELSE {_PROSE.format(x=x)} END END::BIGINT"""


def class_sql(x: str) -> str:
    return f"""(CASE WHEN {x} = '' THEN 'prose' WHEN len(regexp_extract_all({x}, '{_CJK}')) / length({x}) >= 0.15 THEN 'cjk'
  WHEN length({x}) >= 32 AND regexp_matches({x}, '^[A-Za-z0-9+/=_-]+$') AND regexp_matches({x}, '[a-z]')::INT + regexp_matches({x}, '[A-Z]')::INT + regexp_matches({x}, '\\d')::INT + regexp_matches({x}, '[+/=_-]')::INT >= 3 AND len(list_distinct(string_split({x}, ''))) / length({x}) >= 0.25 THEN 'high_entropy'
  WHEN regexp_matches({x}, '(?m)(?:^|\\n)\\s*(?:import|export|class|interface|type|function|def|fn|const|let|var|public|private|protected)\\b|=>|\\{{(?s:.*)\\}}') THEN 'code' ELSE 'prose' END)"""


_V = {n: view_sql(n, DUCK) for n in ("v_all", "v_turns", "v_text", "v_tool_calls", "v_log_runs", "v_search", "v_json")}
_MARKED = r"(regexp_matches({x}, '<<ccr:[0-9a-fA-F]{{12,24}}\b[^>]*>>') OR regexp_matches({x}, '(?i)\[[^\]]*(?:Retrieve more:|Retrieve original:)\s*hash=[0-9a-f]{{24}}[^\]]*\]') OR regexp_matches({x}, '(?i)\[[^\]]*compressed[^\]]*hash=[0-9a-f]{{24}}[^\]]*\]'))"
_STRONG = "(length({x}) <= 8000 AND len(list_filter(['error', 'fail', 'exception', 'traceback', 'fatal', 'panic', 'crash'], lambda w: contains(lower({x}), w))) >= 2)"
_POLICY = """CASE WHEN tool ILIKE 'sieve\\_%' ESCAPE '\\' THEN ['safety-own-tools', 'builtin', 'preserve', 'balanced'] WHEN tool ILIKE 'mcp\\_db\\_%' ESCAPE '\\' THEN ['keep-db', 'user', 'preserve', 'balanced']
 WHEN regexp_matches(tool, '(?i)^gre.$') THEN ['hard-grep', 'user', 'compress', 'aggressive'] WHEN tool ILIKE 'ctx\\_%' ESCAPE '\\' THEN ['legacy-skip-tools', 'compatibility', 'preserve', 'balanced']
 WHEN lower(tool) IN ('read', 'edit', 'write', 'apply_patch') THEN ['builtin-exact-content', 'builtin', 'preserve', 'balanced'] ELSE ['default', 'default', 'compress', 'balanced'] END"""


def search_line_sql(x: str) -> str:
    tok = f"regexp_extract(ltrim({x}, ' ' || chr(9)), '^\\S+')"
    path = f"coalesce(nullif(regexp_extract({tok}, '^([^\\s:][^:\\n]*):\\d+[:\\-]', 1), ''), nullif(regexp_extract({tok}, '^([^\\s:\\n][^:\\n]*)-\\d+[:\\-]', 1), ''), '')"
    return f"(regexp_matches({path}, '[/\\\\]') OR contains({path}, '.'))"


def any_sql(x: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, '{p}')" for p in patterns) + ")"


_LOG_SQL = [r"(?i)\b(ERROR|FAIL|FAILED|FATAL|CRITICAL)\b", r"(?i)\b(WARN|WARNING)\b", r"(?i)\b(INFO|DEBUG|TRACE)\b", r"^\s*\d{4}-\d{2}-\d{2}", r"^\s*\[\d{2}:\d{2}:\d{2}\]", r"(?i)^npm ERR!|^yarn error|^cargo error", r"Traceback \(most recent call last\)", r"^\s*at\s+[\w.$]+\("]
_DECL_SQL = [r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+[$\w]+\s*\(", r"^\s*(?:export\s+)?(?:abstract\s+)?(?:class|interface|type|enum|namespace)\s+[$\w]+", r"^\s*(?:async\s+)?def\s+\w+\s*\(", r"^\s*class\s+\w+(?:\([^)]*\))?\s*:", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+\w+\s*\(", r"^\s*(?:package\s+\w+|func\s+(?:\([^)]*\)\s*)?\w+\s*\()", r"^\s*#include\s+[<\"]|^\s*using\s+namespace\s+\w+"]
_SUPP_SQL = [r"^\s*(?:const|let|var)\s+[$\w]+(?:\s*:[^=]+)?\s*=", r"^\s*(?:return|throw|yield)\b", r"^\s*(?:if|for|while|switch|catch)\s*\(", r"^\s*(?:import|export)\s+", r"^\s*(?:from\s+\S+\s+import|import\s+\S+)", r"^\s*(?:pub\s+)?(?:struct|impl|trait|enum)\b"]


def kind_sql(view: str) -> str:
    """kind and confidence of each row of view (view_name, id, content)."""
    cells = lambda x, c: f"len(string_split({x}, {c}))"
    return rf"""SELECT * EXCLUDE (ls, rows, h, chg, decl, code, nh, sl, nt, lg, fmt), CASE WHEN trim(content, chr(32) || chr(9) || chr(10) || chr(13)) = '' THEN 'text' WHEN regexp_matches(content, '(?i)<!doctype\s+html\b|<html\b|<main\b|<article\b') THEN 'html'
  WHEN regexp_matches(content, '^\s*[\[{{]') AND json_valid(content) THEN 'json' WHEN fmt IS NOT NULL THEN 'table' WHEN h > 0 THEN 'diff' WHEN decl >= 1 AND code >= 3 THEN 'code' WHEN nh > 0 AND sl / nh >= 0.3 THEN 'search' WHEN nt > 0 AND lg / nt >= 0.1 THEN 'log' ELSE 'text' END AS kind,
  CASE kind WHEN 'html' THEN 0.98 WHEN 'json' THEN 1.0 WHEN 'table' THEN 0.95 WHEN 'diff' THEN least(1.0, 0.5 + h * 0.2 + chg * 0.05) WHEN 'code' THEN least(1.0, 0.5 + code * 0.03) WHEN 'search' THEN least(1.0, 0.4 + sl / nh * 0.6) WHEN 'log' THEN least(1.0, 0.3 + lg / nt * 0.5) ELSE 0.5 END AS raw_confidence
FROM (SELECT *,
  len(list_filter(ls[1:500], lambda x: regexp_matches(x, '^(diff --git|diff --combined |diff --cc |--- a/|@@\s+-\d+)'))) AS h, len(list_filter(ls[1:500], lambda x: regexp_matches(x, '^[+-][^+-]'))) AS chg,
  len(list_filter(ls[1:100], lambda x: {any_sql('x', _DECL_SQL)})) AS decl, len(list_filter(ls[1:100], lambda x: {any_sql('x', _DECL_SQL + _SUPP_SQL)})) AS code,
  len(list_filter(ls[1:100], lambda x: regexp_matches(x, '\S'))) AS nh, len(list_filter(ls[1:100], lambda x: {search_line_sql('x')})) AS sl,
  len(list_filter(ls[1:200], lambda x: regexp_matches(x, '\S'))) AS nt, len(list_filter(ls[1:200], lambda x: regexp_matches(x, '\S') AND {any_sql('x', _LOG_SQL)})) AS lg,
  CASE WHEN len(rows) < 8 THEN NULL WHEN contains(rows[1], '|') AND regexp_matches(rows[2], '^\s*\|?(?:\s*:?-+:?\s*\|)+\s*:?-+:?\s*\|?\s*$') THEN 'markdown'
    WHEN {cells('rows[1]', "','")} >= 2 AND len(list_filter(rows[2:20], lambda r: {cells('r', "','")} <> {cells('rows[1]', "','")})) = 0 THEN 'csv'
    WHEN {cells('rows[1]', 'chr(9)')} >= 2 AND len(list_filter(rows[2:20], lambda r: {cells('r', 'chr(9)')} <> {cells('rows[1]', 'chr(9)')})) = 0 THEN 'tsv' END AS fmt
FROM (SELECT *, string_split_regex(content, '\r?\n') AS ls, list_filter(string_split_regex(content, '\r?\n'), lambda x: regexp_matches(x, '\S')) AS rows FROM ({view}) src) a) b"""


def runs_sql(view: str) -> str:
    return f"""WITH v AS ({view}), l AS (SELECT id, content, generate_subscripts(string_split(body, chr(10)), 1) AS pos, unnest(string_split(body, chr(10))) AS line FROM (SELECT *, CASE WHEN ends_with(content, chr(10)) THEN content[:-2] ELSE content END AS body FROM v) x),
 f AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY pos) AS run FROM (SELECT *, (line IS DISTINCT FROM lag(line) OVER (PARTITION BY id ORDER BY pos) OR pos = 1)::INT AS fresh FROM l) y),
 g AS (SELECT id, run, min(pos) AS p, any_value(line) || CASE WHEN count(*) >= 2 THEN chr(10) || '... (repeated ' || count(*) || ' times)' ELSE '' END AS txt, any_value(content) AS content FROM f GROUP BY id, run),
 o AS (SELECT id, string_agg(txt, chr(10) ORDER BY p) || CASE WHEN ends_with(any_value(content), chr(10)) THEN chr(10) ELSE '' END AS folded FROM g GROUP BY id)"""


ORACLES = {
    "token_count": f"SELECT view_name, id, {class_sql('content')} AS class, {tokens_sql('content')} AS tokens FROM ({_V['v_all']}) v",
    "token_count_turns": f"SELECT id, {tokens_sql('content')} AS tokens FROM ({_V['v_turns']}) v",
    "content_hash_dups": "SELECT substr(sha256(text), 1, 24) AS hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "marker_flags": f"SELECT call_id, {_MARKED.format(x='output')} AS marked, {_STRONG.format(x='output')} AS strong_error, regexp_matches(regexp_extract(output, 'hash=([0-9A-Za-z]*)', 1), '^[0-9a-fA-F]{{24}}$') AS valid_hash FROM ({_V['v_tool_calls']}) v",
    "policy_resolution": f"SELECT tool, p[1] AS rule_id, p[2] AS rule_source, p[3] AS action, p[4] AS strength FROM (SELECT DISTINCT tool, {_POLICY} AS p FROM ({_V['v_tool_calls']}) v) x",
    "admission": f"""SELECT call_id, n AS original_tokens, CASE WHEN p[3] = 'preserve' THEN CASE p[2] WHEN 'user' THEN 'user_preserve' WHEN 'compatibility' THEN 'legacy_skip_tool' ELSE 'builtin_preserve' END
 WHEN output = '' OR {_MARKED.format(x='output')} THEN 'empty_or_marked' WHEN length(output) > 250000 THEN 'too_large' WHEN length(output) < lim AND n < lim THEN 'below_threshold' WHEN {_STRONG.format(x='output')} THEN 'protected_error_output' ELSE 'admitted' END AS reason
 FROM (SELECT *, {tokens_sql('output')} AS n, {_POLICY} AS p, CASE WHEN p[1] = 'hard-grep' THEN 1 ELSE 25 END AS lim FROM ({_V['v_tool_calls']}) v) x""",
    "admission_protected": f"""SELECT view_name, id, CASE WHEN length(content) % 2 = 0 AND kind IN ('text', 'code') AND content <> '' THEN 'read_protected' WHEN content = '' OR {_MARKED.format(x='content')} THEN 'empty_or_marked' WHEN length(content) > 250000 THEN 'too_large'
 WHEN length(content) < 25 AND n < 25 THEN 'below_threshold' WHEN {_STRONG.format(x='content')} THEN 'protected_error_output' WHEN kind = 'code' THEN 'protected_recent_code' ELSE 'admitted' END AS reason FROM (SELECT view_name, id, content, kind, {tokens_sql('content')} AS n FROM ({kind_sql(_V['v_all'])}) k) x""",
    "detect_kind": f"SELECT view_name, id, kind, round(raw_confidence, 6) AS confidence FROM ({kind_sql(_V['v_all'])}) k",
    "lossless_runs": runs_sql(f"{_V['v_log_runs']} UNION ALL {_V['v_text']}") + " SELECT id, sha256(folded) AS folded_sha256, length(folded) AS folded_chars FROM o",
    "lossless_runs_not_undone": "SELECT doc_id::VARCHAR AS id FROM documents WHERE false",
    "search_heading": f"""WITH v AS ({_V['v_search']}), l AS (SELECT id, generate_subscripts(string_split(content, chr(10)), 1) AS pos, unnest(string_split(content, chr(10))) AS line FROM v),
 m AS (SELECT *, CASE WHEN regexp_matches(line, '^[^:]+:\\d+:') THEN regexp_extract(line, '^([^:]+):', 1) END AS path FROM l), n AS (SELECT *, lag(path) OVER (PARTITION BY id ORDER BY pos) AS before FROM m),
 o AS (SELECT id, string_agg(CASE WHEN path IS NULL THEN line WHEN path = before THEN substr(line, length(path) + 2) ELSE path || chr(10) || substr(line, length(path) + 2) END, chr(10) ORDER BY pos) AS folded FROM n GROUP BY id) SELECT id, sha256(folded) AS folded_sha256, length(folded) AS folded_chars FROM o""",
    "search_heading_not_undone": "SELECT source AS id FROM documents WHERE false",
    "json_table_fold": """WITH r AS (SELECT user_id, event_id, event_id || ',"' || event_type || '",' || regexp_replace(regexp_replace(value::DECIMAL(18,2)::VARCHAR, '(\\.\\d*?)0+$', '\\1'), '\\.$', '') || ',"' || strftime(ts, '%Y-%m-%d') || '"' AS row FROM events)
 SELECT user_id::VARCHAR AS id, sha256('[' || count(*) || ']["id","type","value","day"]' || chr(10) || string_agg(row, chr(10) ORDER BY event_id)) AS folded_sha256 FROM r GROUP BY user_id""",
}
