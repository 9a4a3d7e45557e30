"""Queries: pages to text, protected facts, the gate, ranking and sizing."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import detect, text, tokens
from sievework.operators import html, lines, lossless, rank
from sievework.plans.basic import kind_sql, tokens_sql
from sievework.plans.payloads import _SEG, _lines
from sievework.plans.views import DUCK, spark_view, view_sql
from sievework.session import table


def html_to_text(spark, d):
    return html.to_text(spark_view(spark, d, "v_html")).select("id", "title", F.size("lines").cast("long").alias("lines"), F.sha2("output", 256).alias("output_sha256"))


def html_links(spark, d):
    return spark_view(spark, d, "v_html").select("id", F.posexplode(html.links(F.col("content"))).alias("pos", "href"))


def protected_facts(spark, d):
    v = detect.with_kind(spark_view(spark, d, "v_all"))
    facts = F.when(F.col("kind") != "json", html.protected_facts(F.col("kind"), F.col("content")))  # JSON's facts need a parser
    one = text.let(facts, lambda f: F.when(f.isNotNull(), F.array(F.struct(F.size(f).cast("long").alias("facts"), F.sha2(F.array_join(f, "\n"), 256).alias("facts_sha256")))))
    # the filter stays above the generator, so kinds and facts are computed once
    return v.select("view_name", "id", F.explode_outer(one).alias("f")).where("f is not null").select("view_name", "id", "f.*")


def gate_decisions(spark, d):
    """Half of each log payload's lines, and its run fold, before the gate."""
    v = spark_view(spark, d, "v_log").withColumn("view_name", F.lit("log")).unionByName(spark_view(spark, d, "v_log_runs").withColumn("view_name", F.lit("runs"))).unionByName(spark_view(spark, d, "v_diff").withColumn("view_name", F.lit("diff")))
    kind = F.when(F.col("view_name") == "diff", "diff").otherwise("log")
    v = v.withColumn("l", F.split("content", "\n", -1)).withColumn("candidate", F.array_join(F.slice("l", 1, F.ceil(F.size("l") / 2).cast("int")), "\n"))
    t = lambda c: tokens.tokens(F.col(c))
    return v.select("view_name", "id", html.gate(kind, t("content"), F.col("candidate"), t("candidate"), html.protected_facts(kind, F.col("content"))).alias("decision"))


def _items(spark, d):
    rows = lines.required_rows(lines.table_rows(spark_view(spark, d, "v_csv")))
    return rows.select("id", "idx", F.col("row").alias("item"), "required")


def info_rank(spark, d):
    return rank.ranked_items(_items(spark, d)).select("id", "idx", F.round("score", 6).alias("score"), F.round("coverage", 6).alias("coverage"))


def bigram_curve(spark, d):
    v = lines.exploded(spark_view(spark, d, "v_log_sparse")).select("id", "idx", F.col("line").alias("item"))
    return rank.coverage_curve(v)


def knee(spark, d):
    v = lines.exploded(spark_view(spark, d, "v_log_sparse")).select("id", "idx", F.col("line").alias("item"))
    return rank.knees(rank.coverage_curve(v))


def latency_percentiles(spark, d):
    """Nearest-rank percentiles."""
    t = spark_view(spark, d, "v_telemetry").withColumn("r", F.expr("row_number() over (partition by outcome order by latency_ms, event_id)")).withColumn("n", F.expr("count(*) over (partition by outcome)"))
    at = lambda p: F.max(F.when(F.col("r") == F.greatest(F.lit(1), F.ceil(F.col("n") * p)), F.col("latency_ms")))
    return t.groupBy("outcome").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("latency_ms").alias("max_ms"), F.median("latency_ms").alias("median_ms"))


def fold_savings(spark, d):
    """Tokens that the run and heading folds save, and how many folds the token gate takes."""
    both = lossless.with_runs_folded(spark_view(spark, d, "v_log_runs")).withColumn("view_name", F.lit("log_runs")).unionByName(lossless.with_headings(spark_view(spark, d, "v_search")).withColumn("view_name", F.lit("search")))
    t = both.select("view_name", "id", tokens.tokens(F.col("content")).alias("before"), tokens.tokens(F.col("folded")).alias("after"))
    return t.select("view_name", "id", "before", "after", (F.col("after") < F.col("before")).alias("taken"))


QUERIES = {f.__name__: f for f in (html_to_text, html_links, protected_facts, gate_decisions, info_rank, bigram_curve, knee, latency_percentiles, fold_savings)}

_PROT = r"(?i)\b(?:error|failed|failure|fatal|critical|exception|warning|security|traceback)\b|\bFile\s+\"[^\"]+\",\s+line\s+\d+|^\s*at\s+.*[\w./\\-]+:\d+(?::\d+)?\b"
_DECLARED = r"^(?:import\b|from\s+\S+\s+import\b|export\b|(?:public|private|protected|static|abstract|async|pub\s+)*\s*(?:function|class|interface|type|enum|namespace|def|fn|struct|trait|func)\b)"
_DECODE = lambda x: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?i)&nbsp;', ' ', 'g'), '(?i)&amp;', '&', 'g'), '(?i)&lt;', '<', 'g'), '(?i)&gt;', '>', 'g'), '(?i)&quot;', '\"', 'g'), '(?i)&#39;|&apos;', '''', 'g')"
_WS = "' ' || chr(9) || chr(10) || chr(13)"
_NOISE = "|".join(rf"<{t}\b[^>]*>.*?</{t}>" for t in html.NOISE)
_PLAIN = lambda x: f"trim(regexp_replace({_DECODE(f'''regexp_replace({x}, '<[^>]+>', ' ', 'g')''')}, '\\s+', ' ', 'g'), {_WS})"


def _chain(x: str, steps: list[tuple[str, str]]) -> str:
    for pattern, to in steps:
        x = f"regexp_replace({x}, '{pattern}', {to}, 'g')"
    return x


_BLOCKS = _chain("linked", [(r"(?i)</?(?:table|thead|tbody)\b[^>]*>", "chr(10)"), (r"(?i)</?tr\b[^>]*>", "chr(10)"), (r"(?i)<(?:th|td)\b[^>]*>", "''"), (r"(?i)</(?:th|td)>", "' | '"), (r"(?i)<br\s*/?>", "chr(10)"), (r"(?i)</?(?:h[1-6]|p|li|ul|ol|section|div|pre|blockquote)\b[^>]*>", "chr(10)"), (r"<[^>]+>", "' '")])
_CSV_ROWS = "SELECT strftime(o_orderdate, '%Y-%m') AS id, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey) - 1 AS idx, count(*) OVER (PARTITION BY strftime(o_orderdate, '%Y-%m')) AS n, o_orderkey::VARCHAR || ',' || o_custkey::VARCHAR || ',' || o_orderstatus || ',' || o_totalprice::DECIMAL(18,2)::VARCHAR AS item, o_orderkey::DOUBLE AS a, o_custkey::DOUBLE AS b, o_totalprice::DECIMAL(18,2)::DOUBLE AS c FROM orders"

ORACLES = {
    "html_to_text": rf"""WITH c AS (SELECT page_id::VARCHAR AS id, html, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is){_NOISE}', '', 'g') AS clean FROM pages WHERE length(html) >= 500),
 m AS (SELECT id, html, coalesce(nullif(regexp_extract(clean, '(?is)<main\b[^>]*>(.*?)</main>|<article\b[^>]*>(.*?)</article>', 1), ''), nullif(regexp_extract(clean, '(?is)<main\b[^>]*>(.*?)</main>|<article\b[^>]*>(.*?)</article>', 2), ''), nullif(regexp_extract(clean, '(?is)<body\b[^>]*>(.*?)</body>', 1), ''), clean) AS part FROM c),
 l AS (SELECT id, html, regexp_replace(part, '(?is)<a\b[^>]*href\s*=\s*["'']([^"'']+)["''][^>]*>(.*?)</a>', '[\2](\1)', 'g') AS linked FROM m),
 t AS (SELECT id, {_PLAIN("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1)")} AS title, list_filter(list_transform(string_split_regex({_DECODE(_BLOCKS)}, '\r?\n'), lambda y: trim(regexp_replace(regexp_replace(y, '\s+', ' ', 'g'), '^\s*\|\s*|\s*\|\s*$', '', 'g'), {_WS})), lambda y: y <> '') AS ls FROM l)
 SELECT id, title, len(ls) AS lines, sha256(CASE WHEN title <> '' THEN title || chr(10) ELSE '' END || array_to_string(ls, chr(10))) AS output_sha256 FROM t""",
    "html_links": r"SELECT id, (generate_subscripts(h, 1) - 1)::INT AS pos, unnest(h) AS href FROM (SELECT page_id::VARCHAR AS id, regexp_extract_all(html, '(?i)href\s*=\s*[\"'']([^\"'']+)[\"'']', 1) AS h FROM pages) x",
    "protected_facts": rf"""WITH k AS ({kind_sql(view_sql('v_all', DUCK))}), w AS (SELECT *, string_split_regex(content, '\r?\n') AS ls, list_filter(list_transform(string_split_regex(content, '\r?\n'), lambda a: trim(a, {_WS})), lambda a: a <> '') AS tr FROM k WHERE kind <> 'json'),
 f AS (SELECT view_name, id, CASE kind WHEN 'code' THEN list_filter(tr, lambda a: regexp_matches(a, '{_DECLARED}') OR regexp_matches(a, '{_PROT}')) WHEN 'diff' THEN list_filter(ls, lambda a: regexp_matches(a, '{_PROT}'))
  WHEN 'table' THEN list_concat(list_slice(list_filter(ls, lambda a: regexp_matches(a, '\S')), 1, 2), list_filter(list_slice(list_filter(ls, lambda a: regexp_matches(a, '\S')), 3, NULL), lambda a: regexp_matches(a, '{_PROT}')))
  WHEN 'html' THEN (SELECT coalesce(list(x ORDER BY first_at), []) FROM (SELECT x, min(n) AS first_at FROM (SELECT unnest(h) AS x, generate_subscripts(h, 1) AS n FROM (SELECT list_filter(list_concat([trim(regexp_replace(regexp_replace(regexp_extract(content, '(?is)<title\b[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), {_WS})], regexp_extract_all(content, '(?i)href\s*=\s*["'']([^"'']+)["'']', 1),
     list_filter(list_transform(regexp_extract_all(content, '>([^<>]+)<', 1), lambda a: trim(regexp_replace(a, '\s+', ' ', 'g'), {_WS})), lambda a: regexp_matches(a, '{_PROT}'))), lambda a: a <> '') AS h) q) r GROUP BY x) y)
  WHEN 'text' THEN list_filter({_SEG.format(x='content')}, lambda a: regexp_matches(a, '{_PROT}')) ELSE list_filter(tr, lambda a: regexp_matches(a, '{_PROT}')) END AS f FROM w)
 SELECT view_name, id, len(f) AS facts, sha256(array_to_string(f, chr(10))) AS facts_sha256 FROM f""",
    "gate_decisions": rf"""WITH v AS (SELECT 'log' AS view_name, * FROM ({view_sql('v_log', DUCK)}) a UNION ALL SELECT 'runs', * FROM ({view_sql('v_log_runs', DUCK)}) b UNION ALL SELECT 'diff', * FROM ({view_sql('v_diff', DUCK)}) c),
 h AS (SELECT *, array_to_string(string_split(content, chr(10))[1:ceil(len(string_split(content, chr(10))) / 2)::BIGINT], chr(10)) AS cand, list_filter(list_transform(string_split(content, chr(10)), lambda a: CASE WHEN view_name = 'diff' THEN a ELSE trim(a, {_WS}) END), lambda a: regexp_matches(a, '{_PROT}')) AS f FROM v)
 SELECT view_name, id, CASE WHEN NOT regexp_matches(cand, '\S') THEN 'empty_candidate' WHEN len(list_filter(f, lambda a: NOT contains(cand, a))) > 0 THEN 'protected_fact_lost' WHEN {tokens_sql('cand')} >= {tokens_sql('content')} THEN 'no_token_savings' ELSE 'accepted' END AS decision FROM h""",
    "info_rank": rf"""WITH RECURSIVE r AS ({_CSV_ROWS}), z AS (SELECT *, coalesce(greatest(abs(a - avg(a) OVER w) / nullif(stddev_pop(a) OVER w, 0), abs(b - avg(b) OVER w) / nullif(stddev_pop(b) OVER w, 0), abs(c - avg(c) OVER w) / nullif(stddev_pop(c) OVER w, 0)) >= 3, false) OR idx < 2 OR idx >= n - 2 AS required FROM r WHERE n >= 20 WINDOW w AS (PARTITION BY id)),
 tk AS (SELECT DISTINCT id, idx, n, tok FROM (SELECT id, idx, n, unnest(string_split_regex(regexp_replace(lower(item), '\p{{N}}+', 'N', 'g'), '[^\p{{L}}\p{{N}}_-]+')) AS tok FROM z) x WHERE length(tok) > 1), fq AS (SELECT *, count(*) OVER (PARTITION BY id, tok) AS df FROM tk),
 ra AS (SELECT id, idx, avg(ln((n + 1) / (df + 1)) / ln(n + 1)) AS rarity FROM fq GROUP BY id, idx), inf AS (SELECT z.*, 0.85 * coalesce(rarity, 0) + 0.15 * length(item) / max(length(item)) OVER (PARTITION BY z.id) AS information FROM z LEFT JOIN ra USING (id, idx)),
 sp AS (SELECT DISTINCT n, 0::BIGINT AS a, n - 1 AS b, 0 AS depth FROM z UNION ALL SELECT n, CASE WHEN s = 0 THEN a ELSE (a + b) // 2 + 1 END, CASE WHEN s = 0 THEN (a + b) // 2 - 1 ELSE b END, depth + 1 FROM sp, (VALUES (0), (1)) q(s) WHERE CASE WHEN s = 0 THEN a <= (a + b) // 2 - 1 ELSE (a + b) // 2 + 1 <= b END),
 fr AS (SELECT inf.*, row_number() OVER (PARTITION BY id ORDER BY depth, idx) - 1 AS place, count(*) OVER (PARTITION BY id) AS m FROM inf JOIN sp ON sp.n = inf.n AND (sp.a + sp.b) // 2 = idx WHERE NOT required),
 cv AS (SELECT id, idx, information, CASE WHEN m <= 1 THEN 1.0 ELSE 1 - place / (m - 1) END AS coverage FROM fr) SELECT id, idx::INT AS idx, round(0.8 * information + 0.2 * coverage, 6) AS score, round(coverage::DOUBLE, 6) AS coverage FROM cv""",
    "bigram_curve": f"WITH l AS ({_lines('v_log_sparse')}), w AS (SELECT id, idx, string_split_regex(trim(lower(line)), '\\s+') AS w FROM l), b AS (SELECT id, idx, unnest(list_transform(range(1, len(w)), lambda i: w[i] || chr(1) || w[i + 1])) AS g FROM w), f AS (SELECT id, g, min(idx) AS idx FROM b GROUP BY id, g), c AS (SELECT id, idx, count(*) AS fresh FROM f GROUP BY id, idx) SELECT l.id, l.idx::INT AS idx, (sum(coalesce(fresh, 0)) OVER (PARTITION BY l.id ORDER BY l.idx))::BIGINT AS seen FROM l LEFT JOIN c USING (id, idx)",
    "latency_percentiles": f"SELECT outcome, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95, max(latency_ms) AS max_ms, median(latency_ms) AS median_ms FROM ({view_sql('v_telemetry', DUCK)}) t GROUP BY outcome",
}
ORACLES["knee"] = f"WITH cu AS ({ORACLES['bigram_curve']}), g AS (SELECT id, idx, count(*) OVER (PARTITION BY id) AS n, (seen - min(seen) OVER (PARTITION BY id)) / nullif(max(seen) OVER (PARTITION BY id) - min(seen) OVER (PARTITION BY id), 0) - idx / nullif(count(*) OVER (PARTITION BY id) - 1, 0) AS rise, max(seen) OVER (PARTITION BY id) = min(seen) OVER (PARTITION BY id) AS flat FROM cu), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rise DESC, idx) AS rn FROM g) SELECT id, n AS items, CASE WHEN n < 3 THEN NULL WHEN flat THEN 1 WHEN rise >= 0.05 THEN idx + 1 END::INT AS knee FROM r WHERE rn = 1"
