"""Derived tool-output views over the driver's tables, in Spark SQL and in DuckDB SQL.

A view has id and content (and query where said); views of another shape name their columns. Both texts come from one
recipe with the dialects' spellings filled in; results are computed from them by operators on one side and SQL on the other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sievework.session import table


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def agg(self, what: str, sep: str, order: str) -> str:
        return f"listagg({what}, {sep}) WITHIN GROUP (ORDER BY {order})" if self.spark else f"string_agg({what}, {sep} ORDER BY {order})"

    def stamp(self, ts: str) -> str:
        return f"date_format({ts}, 'yyyy-MM-dd HH:mm:ss')" if self.spark else f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"

    def day(self, ts: str) -> str:
        return f"date_format({ts}, 'yyyy-MM-dd')" if self.spark else f"strftime({ts}, '%Y-%m-%d')"

    def month(self, ts: str) -> str:
        return f"date_format({ts}, 'yyyy-MM')" if self.spark else f"strftime({ts}, '%Y-%m')"

    def text(self, x: str) -> str:
        return f"cast({x} AS STRING)" if self.spark else f"({x})::VARCHAR"

    def lines(self, doc: str, key: str, text: str) -> str:
        """A subquery with key, pos (from 1) and line."""
        if self.spark:
            return f"(SELECT {key}, pos + 1 AS pos, line FROM {doc} LATERAL VIEW posexplode(split({text}, '\\n', -1)) t AS pos, line)"
        return f"(SELECT {key}, generate_subscripts(string_split({text}, chr(10)), 1) AS pos, unnest(string_split({text}, chr(10))) AS line FROM {doc})"


SPARK, DUCK = Dialect(True), Dialect(False)
TOOLS = ("Bash", "Read", "Edit", "Grep", "ctx_info", "sieve_x", "mcp_db_export")


def view_sql(name: str, d: Dialect) -> str:
    nl, t = "chr(10)", d.text
    money = lambda x: t(f"cast({x} AS DECIMAL(18,2))")
    tool = "CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(TOOLS)) + " END"
    record = f"""'{{"id":' || {t('event_id')} || ',"type":"' || event_type || '","value":' || {money('value')} || ',"day":"' || {d.day('ts')} || '"}}'"""
    log_line = f"{d.stamp('ts')} || CASE event_type WHEN 'error' THEN ' ERROR request failed user=' || {t('user_id')} || ' code=' || {t('event_id % 7')} WHEN 'signup' THEN ' WARN slow signup user=' || {t('user_id')} ELSE ' INFO ' || event_type || ' user=' || {t('user_id')} END"
    sparse = f"{d.stamp('ts')} || CASE WHEN event_type = 'error' AND event_id % 37 = 0 THEN ' ERROR request failed user=' || {t('user_id')} || ' code=' || {t('event_id % 7')} WHEN event_type = 'signup' AND event_id % 37 = 1 THEN ' WARN slow signup user=' || {t('user_id')} ELSE ' INFO ' || event_type || ' user=' || {t('user_id')} END"
    runs = "CASE event_type WHEN 'error' THEN 'ERROR request failed' WHEN 'signup' THEN 'WARN slow signup' ELSE 'INFO ' || event_type END"
    hunk = f"""'diff --git a/parts/' || {t('p_partkey')} || '.ts b/parts/' || {t('p_partkey')} || '.ts' || {nl} || '--- a/parts/' || {t('p_partkey')} || '.ts' || {nl} || '+++ b/parts/' || {t('p_partkey')} || '.ts' || {nl} || '@@ -1,7 +1,7 @@' || {nl} || ' // ' || p_name || {nl} || ' // ' || p_type || {nl} || ' export const id = ' || {t('p_partkey')} || ';' || {nl} || '-const size = ' || {t('p_size')} || ';' || {nl} || '+const size = ' || {t('p_size + 1')} || ';' || {nl} || ' const a = 1;' || {nl} || ' const b = 2;' || {nl} || ' export default size;'"""
    code = f"""'def part_' || {t('p_partkey')} || '(x):' || {nl} || '    size = ' || {t('p_size')} || {nl} || '    total = 0' || {nl} || '    for i in range(size):' || {nl} || '        total = total + i * x' || {nl} || '    total = total * ' || {t('p_partkey')} || {nl} || CASE WHEN p_size % 5 = 0 THEN '    raise ValueError(total)' ELSE '    total = total - 1' END || {nl} || '    return total'"""
    log = lambda line: f"SELECT {d.day('ts')} AS id, {d.agg(line, nl, 'event_id')} AS content FROM events GROUP BY {d.day('ts')}"
    row = f"{t('o_orderkey')} || ',' || {t('o_custkey')} || ',' || o_orderstatus || ',' || {money('o_totalprice')}"
    table_ = {
        "v_json": f"SELECT {t('user_id')} AS id, '[' || {d.agg(record, chr(39) + ',' + chr(39), 'event_id')} || ']' AS content FROM events GROUP BY user_id",
        "v_json_nested": f"""SELECT {t('user_id')} AS id, '{{"items":[' || {d.agg(record.replace('"}', '","props":{"k":1}}'), chr(39) + ',' + chr(39), 'event_id')} || ']}}' AS content FROM events GROUP BY user_id""",
        "v_log": log(log_line),
        "v_log_sparse": log(sparse),
        "v_log_runs": log(runs),
        "v_search": f"SELECT source AS id, {d.agg(f''' 'src/' || source || '/' || {t('doc_id')} || '.txt:' || {t('pos')} || ':' || line''', nl, 'doc_id, pos')} AS content FROM {d.lines('documents', 'doc_id, source', 'text')} l WHERE line <> '' GROUP BY source",
        "v_csv": f"SELECT {d.month('o_orderdate')} AS id, 'order,cust,status,total' || {nl} || {d.agg(row, nl, 'o_orderkey')} AS content FROM orders GROUP BY {d.month('o_orderdate')} HAVING count(*) >= 20",
        "v_diff": f"SELECT p_brand AS id, {d.agg(hunk, nl, 'p_partkey')} AS content FROM part GROUP BY p_brand",
        "v_code": f"SELECT p_brand AS id, {d.agg(code, nl + ' || ' + nl, 'p_partkey')} AS content FROM part GROUP BY p_brand",
        "v_html": f"SELECT {t('page_id')} AS id, html AS content FROM pages",
        "v_text": f"SELECT {t('doc_id')} AS id, text AS content FROM documents",
        "v_turns": f"SELECT {t('conv_id')} || ':' || {t('turn')} AS id, text AS content FROM conversations",
    }
    kinds = ("json", "json_nested", "log", "log_sparse", "log_runs", "search", "csv", "diff", "code", "html", "text")
    table_["v_all"] = " UNION ALL ".join(f"SELECT '{k}' AS view_name, id, content FROM ({table_['v_' + k]}) v_{k}" for k in kinds)
    table_["v_lines_log"] = f"SELECT id, pos, line FROM {d.lines('(' + table_['v_log'] + ') v', 'id', 'content')} l"
    table_["v_tool_calls"] = f"SELECT {t('user_id')} AS session_id, event_id AS call_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, {tool} AS tool, CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN 'see [Retrieve more: hash=0123456789abcdef01234567]' WHEN event_type = 'error' THEN 'request error: fatal crash ' || {t('event_id')} ELSE event_type || ' ' || props END AS output FROM events"
    table_["v_file_ops"] = f"SELECT {t('user_id')} AS session_id, event_id AS seq, CASE WHEN event_type = 'error' THEN 'write' ELSE 'read' END AS kind, 'f' || {t('event_id % 5')} AS path, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id % 4) * 50 END AS offset_, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 50 ELSE 100 END AS limit_ FROM events"
    sha = (lambda x: f"substr(sha2({x}, 256), 1, 24)") if d.spark else (lambda x: f"substr(sha256({x}), 1, 24)")
    table_["v_entries"] = f"SELECT doc_id AS id, {sha('text')} AS hash, lang AS session_id, text AS content, CASE WHEN doc_id % 2 = 0 THEN 'text' ELSE 'log' END AS strategy, n_chars AS original_tokens, cast(floor(n_chars / 3) AS BIGINT) AS compressed_tokens, doc_id * 1000 AS created_ms, doc_id * 1000 + CASE doc_id % 3 WHEN 0 THEN 100000 WHEN 1 THEN 3000000 ELSE 900000 END AS expires_ms, doc_id % 4 AS retrieval_count FROM documents"
    table_["v_parts"] = f"SELECT c.conv_id AS session_id, s.turn AS snapshot, c.turn AS message_idx, 0 AS part_idx, {t('c.conv_id')} || '-' || {t('c.turn')} AS call_id, c.text AS output, c.conv_id % 3 = 0 AND c.turn = 1 AS cache_control FROM conversations c JOIN conversations s ON c.conv_id = s.conv_id AND c.turn <= s.turn"
    table_["v_repeat"] = f"SELECT id AS session_id, 1 AS seq, {d.agg('line', nl, 'pos')} AS content FROM ({table_['v_lines_log']}) a WHERE pos <= 100 GROUP BY id UNION ALL SELECT id, 2, {d.agg('line || CASE WHEN pos % 40 = 0 THEN ' + chr(39) + ' changed' + chr(39) + ' ELSE ' + chr(39) + chr(39) + ' END', nl, 'pos')} FROM ({table_['v_lines_log']}) b WHERE pos <= 100 GROUP BY id UNION ALL SELECT id, 3, {d.agg('line', nl, 'pos')} FROM ({table_['v_lines_log']}) c WHERE pos <= 100 GROUP BY id UNION ALL SELECT id, 4, {d.agg('line', nl, 'pos')} FROM ({table_['v_lines_log']}) e WHERE pos > 100 GROUP BY id"
    table_["v_telemetry"] = f"SELECT event_id, {t('user_id')} AS session_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'skipped' ELSE 'compressed' END AS outcome, CASE event_type WHEN 'error' THEN 'hook_error' WHEN 'view' THEN 'below_threshold' WHEN 'click' THEN 'compressed' ELSE 'odd_reason' END AS reason, event_id % 500 AS tokens_saved, value AS latency_ms, CASE event_id % 5 WHEN 0 THEN 'summary' WHEN 1 THEN 'query' WHEN 2 THEN 'head' WHEN 3 THEN 'full' END AS mode, event_id % 17 = 0 AS miss, event_id % 90 AS output_tokens FROM events"
    return table_[name]


TABLES = ("events", "documents", "orders", "part", "pages", "conversations")


#: Partitions for each core that the payloads of all kinds are dealt to, and the stored bytes that one of them takes at most: the views are
#: some ten times as large as their tables' files, and a partition's rows meet in Arrow batches.
SHARES, SHARE_BYTES = 4, 1_000_000


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view's rows. The payloads of all kinds are dealt out evenly: some are a thousand times as long as others, and each costs work by its length."""
    sql = view_sql(name, SPARK)
    df = run_sql(spark, sf_dir, sql)
    return df.repartition(shares(spark, (table(spark, sf_dir, t) for t in TABLES if t in sql))) if name == "v_all" else df


def shares(spark: SparkSession, tables) -> int:
    """How many partitions payloads made of these tables are dealt to."""
    stored = sum(int(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for t in tables)
    return max(SHARES * spark.sparkContext.defaultParallelism, -(-stored // SHARE_BYTES))


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A Spark SQL text over the driver's tables, which are bound as parameters of this one statement."""
    frames = {t: table(spark, sf_dir, t) for t in TABLES if t in sql}
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in frames:
        sql = _named(sql, t)
    return spark.sql(sql, **frames)


def _named(sql: str, t: str) -> str:
    for word in ("FROM ", "JOIN "):
        sql = sql.replace(f"{word}{t} ", f"{word}{{{t}}} ").replace(f"{word}{t})", f"{word}{{{t}}})")
        if sql.endswith(f"{word}{t}"):
            sql = sql[: -len(t)] + f"{{{t}}}"
    return sql
