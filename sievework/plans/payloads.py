"""Queries: log, search, diff, table and prose operators on derived payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.operators import lines
from sievework.plans.basic import tokens_sql
from sievework.plans.views import DUCK, spark_view, view_sql

QUERY = "error user click 1992"


def r6(c):
    return F.round(c, 6)


def log_levels(spark, d):
    return lines.log_lines(spark_view(spark, d, "v_log")).groupBy("id", "level").agg(F.count("*").alias("lines"))


def log_scores(spark, d):
    return lines.log_lines(spark_view(spark, d, "v_log")).select("id", "idx", "level", "summary", r6("score").alias("score"))


def log_warning_dedupe(spark, d):
    rows = lines.log_lines(spark_view(spark, d, "v_log")).where("level = 'WARN'").withColumn("k", lines.dedupe_key(F.col("line")))
    return rows.groupBy("id", "k").agg(F.min("idx").alias("first_idx"), F.count("*").alias("lines"))


def log_required(spark, d):
    return lines.log_selection(spark_view(spark, d, "v_log_sparse"), "view").where("required or warning or context").select("id", "idx", "required", "warning", "context")


def log_errors_kept(spark, d):
    rows = lines.log_lines(spark_view(spark, d, "v_log")).where("level = 'ERROR'")
    return lines.with_first_last(rows, 10, ["id"]).select("id", "idx")


def log_omitted(spark, d):
    """Lines that no rule asks for, by level: what the omitted note tells at most."""
    rows = lines.log_selection(spark_view(spark, d, "v_log_sparse"))
    return rows.groupBy("id").agg(*(F.sum((F.col("level") == x).cast("long")).alias(f"n_{x.lower()}") for x in ("ERROR", "FAIL", "WARN", "INFO")), F.sum((~F.col("required")).cast("long")).alias("free"))


def log_formats(spark, d):
    return lines.log_format(spark_view(spark, d, "v_all"))


def search_parse(spark, d):
    return lines.search_matches(spark_view(spark, d, "v_search")).select("id", "file", "line_number", F.sha2("content", 256).alias("content_sha256"))


def search_file_rank(spark, d):
    return lines.ranked_files(lines.scored_matches(lines.search_matches(spark_view(spark, d, "v_search")), "that tion with")).select("id", "file", "matches", r6("top").alias("top"), "rank")


def search_required(spark, d):
    m = lines.scored_matches(lines.search_matches(spark_view(spark, d, "v_search")), "that tion with")
    return m.where("required").select("id", "file", "line_number", "hits").distinct()


def search_omitted(spark, d):
    m = lines.scored_matches(lines.search_matches(spark_view(spark, d, "v_search")), "that tion with")
    return m.groupBy("id", "file").agg(F.count("*").alias("matches"), F.countDistinct(F.when(F.col("required"), F.col("line_number"))).alias("kept")).where("matches > kept")


def diff_stats(spark, d):
    return lines.diff_files(lines.diff_lines(spark_view(spark, d, "v_diff"))).select("id", "file_no", "header", "additions", "deletions")


def diff_top_files(spark, d):
    return lines.diff_files(lines.diff_lines(spark_view(spark, d, "v_diff")), "size steel").where("selected").select("id", "file_no", "priority", "hits")


def diff_trim_context(spark, d):
    return lines.trimmed(lines.diff_lines(spark_view(spark, d, "v_diff"))).where("keep and what = 'body'").groupBy("id").agg(F.count("*").alias("kept"), F.sum(F.col("idx").cast("long")).alias("idx_sum"))


def diff_compact(spark, d):
    return lines.compact_diff(spark_view(spark, d, "v_diff"), "size steel").select("id", F.sha2("candidate", 256).alias("candidate_sha256"), "candidate_lines", "additions", "deletions", "files", "files_omitted", "changed")


def table_required_rows(spark, d):
    return lines.required_rows(lines.table_rows(spark_view(spark, d, "v_csv"))).where("required").select("id", "idx", "abnormal", "edge", "outlier")


def numeric_outliers(spark, d):
    from sievework.session import table

    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), "l_orderkey", "l_linenumber", F.explode(F.map_from_arrays(F.array(F.lit("price"), F.lit("quantity")), F.array("l_extendedprice", "l_quantity"))).alias("field", "x"))
    return lines.numeric_outliers(li, ["grp"], "field", "x", 1.72).select("grp", "l_orderkey", "l_linenumber", "field", F.round("z", 4).alias("z"))


def text_segments(spark, d):
    return spark_view(spark, d, "v_text").select("id", lines.segments_of(F.col("content")).alias("s")).select("id", F.size("s").cast("long").alias("segments"), F.sha2(F.array_join("s", "\n"), 256).alias("segments_sha256"))


def segment_scores(spark, d):
    return lines.scored_segments(spark_view(spark, d, "v_text"), "the shall und").select("id", "idx", r6("score").alias("score"), "priority")


QUERIES = {f.__name__: f for f in (log_levels, log_scores, log_warning_dedupe, log_required, log_errors_kept, log_omitted, log_formats, search_parse, search_file_rank, search_required, search_omitted, diff_stats, diff_top_files, diff_trim_context, diff_compact, table_required_rows, numeric_outliers, text_segments, segment_scores)}


def _lines(view: str) -> str:
    return f"SELECT id, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS idx, unnest(string_split(content, chr(10))) AS line FROM ({view_sql(view, DUCK)}) src"


_LEVEL = r"CASE WHEN regexp_matches(line, '(?i)\b(?:ERROR|FATAL|CRITICAL)\b|^npm ERR!') THEN 'ERROR' WHEN regexp_matches(line, '(?i)\b(?:FAIL|FAILED)\b') THEN 'FAIL' WHEN regexp_matches(line, '(?i)\b(?:WARN|WARNING)\b|^npm WARN') THEN 'WARN' WHEN regexp_matches(line, '(?i)\bINFO\b|^npm info') THEN 'INFO' WHEN regexp_matches(line, '(?i)\bDEBUG\b') THEN 'DEBUG' WHEN regexp_matches(line, '(?i)\bTRACE\b') THEN 'TRACE' ELSE 'UNKNOWN' END"
_SUMMARY = r"regexp_matches(line, '^={3,}|^-{3,}|^\d+ (?:passed|failed|skipped|error|warning)|^(?:Tests?|Suites?):?\s+\d+|^(?:TOTAL|Total|Summary)|^(?:Build|Compile|Test).*(?:succeeded|failed|complete)')"
_SCORE = f"least(1.0, CASE level WHEN 'ERROR' THEN 1.0 WHEN 'FAIL' THEN 1.0 WHEN 'WARN' THEN 0.5 WHEN 'INFO' THEN 0.1 WHEN 'UNKNOWN' THEN 0.1 WHEN 'DEBUG' THEN 0.05 ELSE 0.02 END + CASE WHEN {_SUMMARY} THEN 0.4 ELSE 0 END)"
_KEY = r"regexp_extract(line, '^[^:=]*') || regexp_replace(regexp_replace(regexp_replace(substr(line, length(regexp_extract(line, '^[^:=]*')) + 1), '\d+', 'N', 'g'), '(?i)0x[0-9a-f]+', 'ADDR', 'g'), '/[\w/]+/', '/PATH/', 'g')"
_LOGL = f"lv AS (SELECT id, idx, line, {_LEVEL} AS level FROM ({_lines('v_log')}) l), sc AS (SELECT *, {_SCORE} AS score, {_SUMMARY} AS summary FROM lv)"
_SPARSE = f"""lv AS (SELECT id, idx, line, {_LEVEL} AS level, count(*) OVER (PARTITION BY id) AS n FROM ({_lines('v_log_sparse')}) l), sc AS (SELECT *, {_SCORE} AS score, {_SUMMARY} AS summary FROM lv WHERE n >= 50)"""


def _selection(asked: str) -> str:
    return f"""WITH {_SPARSE},
 e AS (SELECT *, row_number() OVER (PARTITION BY id, level ORDER BY idx) = 1 OR row_number() OVER (PARTITION BY id, level ORDER BY idx DESC) = 1 AS ends FROM sc),
 p AS (SELECT *, row_number() OVER (PARTITION BY id, level ORDER BY ends DESC, score DESC, idx) AS place, {_KEY} AS k FROM e),
 w AS (SELECT *, level = 'WARN' AND row_number() OVER (PARTITION BY id, level, k ORDER BY idx) = 1 AS fresh FROM p),
 f AS (SELECT *, fresh AND sum(fresh::INT) OVER (PARTITION BY id ORDER BY idx) <= 5 AS warning, {asked} OR (level IN ('ERROR', 'FAIL') AND place <= 10) OR summary AS required FROM w),
 c AS (SELECT *, NOT required AND NOT warning AND bool_or(required OR warning) OVER (PARTITION BY id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS context FROM f)"""


_MATCH = f"m AS (SELECT id, idx, regexp_extract(line, '^([^:]+):(\\d+):(.*)$', 1) AS file, regexp_extract(line, '^([^:]+):(\\d+):(.*)$', 2)::BIGINT AS line_number, regexp_extract(line, '^([^:]+):(\\d+):(.*)$', 3) AS content FROM ({_lines('v_search')}) l)"
_SEVERE = r"(?i)\b(error|fail|failed|fatal|critical|exception|warn|warning|todo|fixme|hack|secret|password|security)\b"
_HITS = f"s AS (SELECT *, regexp_matches(content, '{_SEVERE}') AS severe, len(list_filter(['that', 'tion', 'with'], lambda w: contains(lower(content), w))) AS hits FROM m)"
_DL = f"""dl AS (SELECT *, starts_with(line, 'diff --git ') AS is_file, regexp_matches(line, '^@@@?\\s') AS is_hunk FROM ({_lines('v_diff')}) l), dn AS (SELECT *, sum(is_file::INT) OVER (PARTITION BY id ORDER BY idx) AS file_no FROM dl),
 dh AS (SELECT *, sum(is_hunk::INT) OVER (PARTITION BY id, file_no ORDER BY idx) AS hunk_no FROM dn), db AS (SELECT *, hunk_no > 0 AND NOT is_hunk AS body FROM dh),
 dk AS (SELECT *, NOT body OR bool_or(body AND regexp_matches(line, '^[+-]')) OVER (PARTITION BY id, file_no, hunk_no, body ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) OR NOT regexp_matches(line, '^[ +-]') AS keep FROM db),
 fs AS (SELECT id, file_no, min(CASE WHEN is_file THEN line END) AS header, count(*) FILTER (WHERE body AND starts_with(line, '+')) AS additions, count(*) FILTER (WHERE body AND starts_with(line, '-')) AS deletions,
   bool_or(regexp_matches(line, '(?i)\\b(?:error|exception|fail(?:ed|ure)?|fatal|critical|crash|panic|important|todo|fixme|bug|security|auth|password|secret|token)\\b')) AS priority, bool_or(contains(lower(line), 'size'))::INT + bool_or(contains(lower(line), 'steel'))::INT AS hits FROM db GROUP BY id, file_no),
 fr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY priority DESC, hits DESC, additions + deletions DESC, file_no) <= 20 AS selected FROM fs)"""
_SEG = r"list_filter(list_transform(flatten(list_transform(list_filter(string_split_regex({x}, '\r?\n'), lambda a: regexp_matches(a, '\S')), lambda a: string_split(regexp_replace(trim(a, ' ' || chr(9) || chr(13)), '([.!?])\s', '\1' || chr(1), 'g'), chr(1)))), lambda b: trim(b, ' ' || chr(9) || chr(13))), lambda c: c <> '')"
_KW = "['error', 'exception', 'failed', 'failure', 'fail', 'warning', 'traceback', 'assert', 'todo', 'fixme', 'auth', 'secret', 'password', 'security']"
_SALIENT = rf"(regexp_matches(w, '\d') OR list_contains({_KW}, lower(regexp_replace(w, '^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$', '', 'g'))) OR (length(regexp_replace(w, '\P{{L}}', '', 'g')) >= 2 AND regexp_replace(w, '\P{{L}}', '', 'g') = upper(regexp_replace(w, '\P{{L}}', '', 'g'))) OR regexp_matches(w, '^[A-Za-z_][^.]*\.[A-Za-z_]'))"

ORACLES = {
    "log_levels": f"WITH {_LOGL} SELECT id, level, count(*) AS lines FROM sc GROUP BY id, level",
    "log_scores": f"WITH {_LOGL} SELECT id, idx::INT AS idx, level, summary, round(score::DOUBLE, 6) AS score FROM sc",
    "log_warning_dedupe": f"WITH {_LOGL} SELECT id, {_KEY} AS k, min(idx)::INT AS first_idx, count(*) AS lines FROM sc WHERE level = 'WARN' GROUP BY 1, 2",
    "log_required": _selection("contains(lower(line), 'view')") + " SELECT id, idx::INT AS idx, required, warning, context FROM c WHERE required OR warning OR context",
    "log_errors_kept": f"WITH {_LOGL}, e AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY idx) AS a, row_number() OVER (PARTITION BY id ORDER BY idx DESC) AS z FROM sc WHERE level = 'ERROR'), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY a = 1 OR z = 1 DESC, score DESC, idx) AS r FROM e) SELECT id, idx::INT AS idx FROM r WHERE r <= 10",
    "log_omitted": _selection("false") + " SELECT id, count(*) FILTER (WHERE level = 'ERROR') AS n_error, count(*) FILTER (WHERE level = 'FAIL') AS n_fail, count(*) FILTER (WHERE level = 'WARN') AS n_warn, count(*) FILTER (WHERE level = 'INFO') AS n_info, count(*) FILTER (WHERE NOT required) AS free FROM c GROUP BY id",
    "search_parse": f"WITH {_MATCH} SELECT id, file, line_number, sha256(content) AS content_sha256 FROM m",
    "search_file_rank": f"WITH {_MATCH}, {_HITS}, f AS (SELECT id, file, count(*) AS matches, max(severe::INT + 0.3 * hits) AS top, min(idx) AS first FROM s GROUP BY id, file) SELECT id, file, matches, round(top::DOUBLE, 6) AS top, row_number() OVER (PARTITION BY id ORDER BY top DESC, first)::INT AS rank FROM f",
    "search_required": f"WITH {_MATCH}, {_HITS} SELECT DISTINCT id, file, line_number, hits::INT AS hits FROM s WHERE severe OR hits >= 2",
    "search_omitted": f"WITH {_MATCH}, {_HITS} SELECT id, file, count(*) AS matches, count(DISTINCT line_number) FILTER (WHERE severe OR hits >= 2) AS kept FROM s GROUP BY id, file HAVING matches > kept",
    "diff_stats": f"WITH {_DL} SELECT id, file_no::BIGINT AS file_no, header, additions, deletions FROM fs WHERE file_no > 0",
    "diff_top_files": f"WITH {_DL} SELECT id, file_no::BIGINT AS file_no, priority, hits::INT AS hits FROM fr WHERE selected",
    "diff_trim_context": f"WITH {_DL} SELECT id, count(*) AS kept, sum(idx)::BIGINT AS idx_sum FROM dk WHERE body AND keep GROUP BY id",
    "diff_compact": f"""WITH {_DL}, j AS (SELECT dk.*, fr.selected FROM dk JOIN fr USING (id, file_no)),
 t AS (SELECT id, count(*) AS all_lines, string_agg(line, chr(10) ORDER BY idx) FILTER (WHERE selected AND keep) AS body_text, count(*) FILTER (WHERE selected AND keep) + 1 AS candidate_lines, count(*) FILTER (WHERE selected AND body AND starts_with(line, '+')) AS additions, count(*) FILTER (WHERE selected AND body AND starts_with(line, '-')) AS deletions, count(*) FILTER (WHERE selected AND is_file) AS files, count(*) FILTER (WHERE NOT selected AND is_file) AS files_omitted, sum(length(line) + 1) - 1 AS chars FROM j GROUP BY id),
 r AS (SELECT *, body_text || chr(10) || '[' || files || ' files changed, +' || additions || ' -' || deletions || ' lines' || CASE WHEN files_omitted > 0 THEN ', ' || files_omitted || ' files omitted' ELSE '' END || ']' AS candidate FROM t)
 SELECT id, sha256(candidate) AS candidate_sha256, candidate_lines, additions, deletions, files, files_omitted, all_lines >= 50 AND candidate_lines < 0.8 * all_lines AND length(candidate) < chars AS changed FROM r""",
    "table_required_rows": """WITH r AS (SELECT strftime(o_orderdate, '%Y-%m') AS id, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey) - 1 AS idx, count(*) OVER (PARTITION BY strftime(o_orderdate, '%Y-%m')) AS n, o_orderkey::DOUBLE AS a, o_custkey::DOUBLE AS b, o_totalprice::DECIMAL(18,2)::DOUBLE AS c FROM orders),
 z AS (SELECT *, abs(a - avg(a) OVER w) / nullif(stddev_pop(a) OVER w, 0) AS za, abs(b - avg(b) OVER w) / nullif(stddev_pop(b) OVER w, 0) AS zb, abs(c - avg(c) OVER w) / nullif(stddev_pop(c) OVER w, 0) AS zc FROM r WHERE n >= 20 WINDOW w AS (PARTITION BY id)),
 q AS (SELECT id, idx::INT AS idx, false AS abnormal, idx < 2 OR idx >= n - 2 AS edge, coalesce(greatest(za, zb, zc) >= 3, false) AS outlier FROM z) SELECT * FROM q WHERE edge OR outlier""",
    "numeric_outliers": """WITH x AS (SELECT l_returnflag AS grp, l_orderkey, l_linenumber, 'price' AS field, l_extendedprice AS x FROM lineitem UNION ALL SELECT l_returnflag, l_orderkey, l_linenumber, 'quantity', l_quantity FROM lineitem),
 z AS (SELECT *, abs(x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0) AS raw FROM x WINDOW w AS (PARTITION BY grp, field)) SELECT grp, l_orderkey, l_linenumber, field, round(raw, 4) AS z FROM z WHERE raw >= 1.72""",
    "text_segments": f"SELECT doc_id::VARCHAR AS id, len(s) AS segments, sha256(array_to_string(s, chr(10))) AS segments_sha256 FROM (SELECT doc_id, {_SEG.format(x='text')} AS s FROM documents) x",
    "segment_scores": rf"""WITH g AS (SELECT doc_id::VARCHAR AS id, {_SEG.format(x='text')} AS s FROM documents), e AS (SELECT id, len(s) AS n, generate_subscripts(s, 1) - 1 AS idx, unnest(s) AS seg FROM g),
 t AS (SELECT *, list_filter(string_split_regex(lower(seg), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '') AS toks, list_filter(string_split_regex(seg, '\s+'), lambda x: x <> '') AS parts, regexp_matches(seg, '^#{{1,6}}\s+') AS heading FROM e),
 r AS (SELECT *, len(list_filter(['the', 'shall', 'und'], lambda w: list_contains(toks, w))) / 3 AS rel, len(list_filter(parts, lambda w: {_SALIENT})) / (len(parts) + 1) AS sal FROM t),
 q AS (SELECT *, (idx + 1) / n + rel * 2 + sal * 1.5 + CASE WHEN heading THEN 1.25 ELSE 0 END AS raw FROM r)
 SELECT id, idx::INT AS idx, round(CASE WHEN length(seg) < 12 AND NOT heading THEN raw * 0.25 ELSE raw END, 6) AS score, heading OR rel > 0 OR list_has_any(toks, {_KW}) AS priority FROM q""",
}
