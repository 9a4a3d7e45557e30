"""Kernels on small payloads with planted facts, and native forms against them."""

import ast
import json
import random

import pytest
from pyspark.sql import functions as F

from sievework.functions import kernels as k
from sievework.functions import detect, text, tokens
from sievework.operators import commands, compaction, html, lines, lossless, policy, rank, retrieve, sessions, store
from sievework.plans import views
from sievework.sources import outputs
from sievework.streaming import state

B = k.BUDGETS["balanced"]
KEY = "0" * 24


def log_text():
    rows = [f"2026-01-01 00:00:{i % 60:02d} INFO step {i} ok" for i in range(100)]
    rows[30] = "2026-01-01 ERROR worker lost"
    rows[60:60] = ["Traceback (most recent call last):", '  File "a.py", line 3, in f', "    x()", "ValueError: bad"]
    return "\n".join(rows)


def test_log_keeps_errors_and_traces():
    out, why = k.shorter_log(log_text(), "", KEY, B)
    assert why == "ok" and "ERROR worker lost" in out and 'File "a.py", line 3' in out and out.endswith(f"[Retrieve more: hash={KEY}]") and len(out.split("\n")) < 60


def test_json_array_keeps_odd_rows():
    rows = [{"id": i, "level": "info", "message": f"row {i}"} for i in range(80)]
    rows[41] = {"id": 41, "level": "ERROR", "message": "boom"}
    rows[25]["extra"] = True
    out = json.loads(k.shorter_json(json.dumps(rows), "", KEY, B)[0])
    assert rows[41] in out and any("extra" in r for r in out) and out[-1]["_ccr_dropped"].endswith("_rows_offloaded>>") and len(out) <= 14


def test_json_object_and_small_and_bad():
    wide = {f"k{i}": i for i in range(40)} | {"password": "x"}
    out = json.loads(k.shorter_json(json.dumps(wide), "", KEY, B)[0])
    assert out["password"] == "x" and "k0" in out and out["_ccr_dropped"] == f"<<ccr:{KEY} {41 - 13}_fields_offloaded>>"
    assert k.shorter_json("[1, 2]", "", KEY, B)[1] == "not_large_array" and k.shorter_json("{", "", KEY, B)[1] == "invalid_json"


def test_search_keeps_severe():
    rows = [f"src/a.ts:{i}:const v{i} = {i}" for i in range(70)] + [f"src/b.ts:{i}:let w{i}" for i in range(40)]
    rows[34] = "src/a.ts:34:throw error"
    out, _ = k.shorter_search("\n".join(rows), "", KEY, B)
    assert "src/a.ts:34:throw error" in out and "[omitted: " in out and "@src/b.ts" in out


def test_text_keeps_headings_and_drops_copies():
    t = "# Report\n" + "\n".join(f"Paragraph {i} says something about topic {i}." for i in range(60)) + "\nA security warning stands here."
    out, _ = k.shorter_text(t, "", KEY, B)
    assert out.startswith("# Report") and "security warning" in out and len(out) < 0.7 * len(t)


def test_table_keeps_abnormal_rows():
    rows = ["name,status,n"] + [f"job{i},ok,{i % 5}" for i in range(60)]
    rows[44] = "job43,failed,3"
    out, _ = k.shorter_table("\n".join(rows), "", KEY, B)
    assert "job43,failed,3" in out and "rows omitted]" in out and out.startswith("name,status,n")


def test_python_folds_long_bodies_only():
    body = "\n".join(f"    a{i} = {i}" for i in range(9))
    src = f'import os\n\ndef long(x):\n    """Says it."""\n{body}\n    return x\n\ndef bad(x):\n{body}\n    raise ValueError(x)\n\ndef short():\n    return 1\n'
    out, _ = k.shorter_python(src, "", KEY, B)
    ast.parse(out)
    assert '"Says it."' in out and "lines omitted" in out and "raise ValueError" in out and "return 1" in out and out.count("a3 = 3") == 1
    assert k.shorter_python("def f(:\n", "", KEY, B)[1] == "invalid_syntax"


def test_diff_kernel_equals_native_form(spark):
    rng = random.Random(2)
    files = []
    for f in range(26):
        hunks = []
        for h in range(rng.choice([1, 2, 13])):
            body = [rng.choice([" same", " other line", "+new token" if f == 3 else "+new", "-old"]) for _ in range(rng.randint(3, 14))]
            hunks += [f"@@ -{h},5 +{h},5 @@", *body]
        files += [f"diff --git a/f{f} b/f{f}", "index 1..2", *hunks]
    t = "\n".join(files)
    native = lines.compact_diff(spark.createDataFrame([("x", t)], "id string, content string"), "token new").collect()[0]
    out, why = k.shorter_diff(t, "token new", KEY, B)
    assert native["changed"] == (why == "ok")
    if out:
        assert out == native["candidate"] + f"\n[Retrieve more: hash={KEY}]"


def test_sizing():
    assert k.fitting(["a"] * 5, 1, 0, 3) == 3
    assert k.fitting(["same line here"] * 50, 1, 2, 20) == 2  # one group: no more than the least
    rng = random.Random(0)
    varied = ["".join(rng.choice("abcdefghij ") for _ in range(40)) for _ in range(60)]
    assert k.fitting(varied, 1, 3, 30) == 30
    assert k.knee([1, 1, 1]) == 1 and k.knee([1, 2]) is None and k.knee(list(range(10))) is None
    assert rank.spread_order(7) == [3, 1, 5, 0, 2, 4, 6]


def test_sizing_curve_equals_native(spark):
    items = ["the cat sat", "the cat ran", "漢字文", "one", ""]
    df = spark.createDataFrame([("x", i, s) for i, s in enumerate(items)], "id string, idx int, item string")
    assert [r["seen"] for r in rank.coverage_curve(df).orderBy("idx").collect()] == k.bigram_curve(items)


@pytest.mark.parametrize("t", ["", "a", "a\n", "a\na\n", "\n\n\n", "x\nx\ny\ny\ny", "... (repeated 3 times)\nz"])
def test_run_fold(spark, t):
    out = lossless.with_runs_folded(spark.createDataFrame([(t,)], "content string")).collect()[0]["folded"]
    if "repeated" not in t:
        assert lossless.unfold_runs(out) == t


def test_ambiguous_run_notes_fail_open():
    t = "a\n... (repeated 3 times)\nb\nb\nb\nb\nb\nb\nb\nb\nb\nb\nb\nb"
    assert lossless.checked("log", t, "a\n... (repeated 3 times)\nb\n... (repeated 12 times)") == t


def test_json_table_round_trip():
    t = json.dumps([{"a": i, "b": f"v{i}", "c": 1.5} for i in range(30)])
    out = lossless.fold(t, "json")
    assert out.startswith('[30]["a","b","c"]') and json.loads(lossless.unfold_table(out)) == json.loads(t)
    assert lossless.fold('[{"a":1,"b":2},{"b":1,"a":2}]', "json") == '[{"a":1,"b":2},{"b":1,"a":2}]'


def test_detection(spark):
    cases = {
        "json": '{"a": 1}', "html": "<main>x</main>", "table": "\n".join("a,b,c" for _ in range(9)), "diff": "diff --git a/x b/x\n@@ -1 +1 @@\n-a\n+b", "text": "Just words.\nNothing else.",
        "code": "def f(x):\n    return x\nimport os\nclass A:\n    pass", "search": "src/a.py:3:x\nsrc/b.py:4:y", "log": "2026-01-01 INFO ok\n2026-01-01 INFO fine",
    }
    df = spark.createDataFrame([(n, c) for n, c in cases.items()], "id string, content string")
    assert {r["id"]: r["kind"] for r in detect.with_kind(df).collect()} == {n: n for n in cases}
    stamps = spark.createDataFrame([("x", "2026-01-01T10:20:30Z INFO a\n2026-01-01T10:20:31Z INFO b")], "id string, content string")
    assert detect.with_kind(stamps).collect()[0]["kind"] == "log"


def test_tokens(spark):
    df = spark.createDataFrame([("",), ("hello world!",), ("漢字かな交じり文",), ("const x = 1;\nlet y = 22;",), ("aB3+" * 10 + "cD4_eF5-gH6",), (None,)], "x string")
    got = [(r[0], r[1]) for r in df.select(tokens.token_class(F.col("x")), tokens.tokens(F.col("x"))).collect()]
    assert got[0] == ("prose", 0) and got[1] == ("prose", 5) and got[2] == ("cjk", 8) and got[3][0] == "code" and got[4][0] == "high_entropy" and got[5][1] is None


def test_compaction_keeps_its_promises(spark):
    rows = [("log", log_text(), ""), ("env", f"<returncode>0</returncode>\n<output>\n{log_text()}\n</output>", ""), ("none", None, ""), ("empty", "", ""), ("short", "hi", "")]
    out = {r["id"]: r for r in compaction.compact(spark.createDataFrame(rows, "id string, content string, query string")).collect()}
    assert set(out) == {"log", "env", "empty", "short"}
    assert out["log"]["changed"] and out["log"]["compressed_tokens"] < out["log"]["original_tokens"] and "ERROR worker lost" in out["log"]["output"]
    assert out["env"]["output"].startswith("<returncode>0</returncode>\n<output>\n") and out["env"]["output"].endswith("\n</output>")
    assert out["short"]["output"] == "hi" and not out["empty"]["changed"]


def test_sections(spark):
    t = "<returncode>1</returncode>\n<stdout>\na\n</stdout>\n<stderr>b</stderr>\n"
    got = compaction.sections(spark.createDataFrame([("x", t), ("y", "loose " + t)], "id string, content string")).orderBy("pos").collect()
    assert [(r["id"], r["body"]) for r in got] == [("x", "a"), ("x", "b")]
    assert "".join(r["gap"] + r["open"] + r["body"] + r["close"] for r in got) == t


def test_policy_checks():
    with pytest.raises(ValueError):
        policy.Policy(rules=(policy.Rule("a", ("x",)), policy.Rule("a", ("y",)))).checked()
    with pytest.raises(ValueError):
        policy.Policy(rules=(policy.Rule("a", ("x",), "preserve", "balanced"),)).checked()


def test_commands():
    for c in ("cat a.py", "cd /x && head -n 3 a", "sudo -n timeout 5 tail f", "bash -lc 'cat x'", "sed -n 1p f", "A=1 env less f"):
        assert commands.shows_a_file(c), c
    for c in ("", "grep x f", "cat a > b", "cat go.sum", "sed s/a/b/ f", "bash x.sh", "echo hi | tee f"):
        assert not commands.shows_a_file(c), c
    assert commands.command_of('{"cmd": ["cat", "x"]}') == "cat x" and commands.command_of("plain") == "plain" and commands.command_of(None) == ""


def test_span_folding():
    shared = "\n".join(f"shared line number {i}" for i in range(60))
    blocks = [(1, shared + "\nunique a", False), (2, "intro\n" + shared, False), (3, shared, True)]
    out, spans, folded = sessions.fold_spans(blocks)
    assert out[0] == blocks[0][1] and out[2] == shared and spans == 1 and folded == 60 and out[1].startswith("intro\n[↑60L same as msg 1: ")
    numbered = [(1, "\n".join(f"{i}: value of {i - 3} here" for i in range(10, 20)), False), (2, "\n".join(f"{i + 5}: value of {i - 3} here" for i in range(10, 20)), False)]
    assert "+5L" in sessions.fold_spans(numbered)[0][1]
    assert all(sessions.fold_spans(blocks[:n])[0] == out[:n] for n in range(1, 4))  # a longer session changes no earlier block


def test_spans_by_session(spark):
    df = spark.createDataFrame([("s", 1, "aaaa bbbb cccc dddd\n" * 5, False), ("s", 2, None, None), ("t", 1, "x", False)], "session_id string, turn long, text string, protected boolean")
    assert sessions.with_spans_folded(df).count() == 3


def test_read_ranges(spark):
    rows = [("s", 1, "read", "f", None, None), ("s", 2, "read", "f", 0, 10), ("s", 3, "read", "f", 0, 20), ("s", 4, "read", "g", 0, 0), ("s", 5, "read", "g", None, None), ("s", 6, "read", "h", 5, 5), ("s", 7, "write", "h", None, None)]
    df = spark.createDataFrame(rows, "session_id string, seq int, kind string, path string, offset_ int, limit_ int")
    assert {r["seq"]: r["state"] for r in sessions.read_states(df).collect()} == {1: "fresh", 2: "superseded", 3: "fresh", 4: "superseded", 5: "fresh", 6: "stale"}


def test_store_put_and_files(spark, tmp_path):
    new = lambda rows: spark.createDataFrame(rows, "id long, session_id string, content string, created_ms long, expires_ms long")
    empty = spark.createDataFrame([], store.SCHEMA)
    t = store.put(empty, new([(1, "a", "x", 0, 100), (2, "a", "y", 1, 900), (3, "b", "y", 2, 900)]), 10, 10)
    assert sorted(r["id"] for r in store.put(t, new([(4, "b", "z", 3, 900)]), 200, 2).collect()) == [3, 4]
    with pytest.raises(ValueError):
        store.put(empty, new([(1, "a", "x", 5, 5)]), 0)
    store.write(t, str(tmp_path / "t"))
    assert store.read(spark, str(tmp_path / "t")).count() == 3
    t.withColumn("odd", F.lit(1)).write.parquet(str(tmp_path / "u"))
    with pytest.raises(ValueError):
        store.read(spark, str(tmp_path / "u"))


def test_pretty_json():
    t = '{"a":[1,2.0,{}],"b":"x\\",y","c":[ ],"d":{"e":null}}'
    out = retrieve.pretty_json(t)
    assert json.loads(out) == json.loads(t) and "2.0" in out and '"c": []' in out and retrieve.pretty_json("{bad") == "{bad"


def test_retrieve_folds_width(spark):
    cols = {"id": 1, "hash": KEY, "session_id": "s", "content": "one\nＥＲＲＯＲ here\nthree", "strategy": "log", "original_tokens": 5, "compressed_tokens": 2, "retrieval_count": 0, "mode": None, "query": "error", "start_line": None, "end_line": None, "lines": None, "context": 0, "max_matches": None, "max_chars": None, "default_mode": None, "default_max_chars": None, "tool": None, "call_id": "c"}
    schema = "id long, hash string, session_id string, content string, strategy string, original_tokens long, compressed_tokens long, retrieval_count long, mode string, query string, start_line int, end_line int, lines int, context int, max_matches int, max_chars int, default_mode string, default_max_chars int, tool string, call_id string"
    rows = [tuple(cols.values()), tuple((cols | {"content": None}).values()), tuple((cols | {"query": "zebra"}).values()), tuple((cols | {"query": None, "mode": "full", "max_chars": 5}).values())]
    out = [r["output"] for r in retrieve.retrieve(spark.createDataFrame(rows, schema)).collect()]
    assert any("2: ＥＲＲＯＲ here" in o and "matches: 1" in o for o in out) and retrieve.MISS in out and any(retrieve.NONE_FOUND in o for o in out)
    assert any(len(o) == 5 for o in out)


def test_trusted_files(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    (root / "a.txt").write_text("hello")
    (root / "big.txt").write_text("x" * 100)
    (tmp_path / "out.txt").write_text("no")
    (root / "link").symlink_to(tmp_path / "out.txt")
    got = {r["path"].split("/")[-1]: (r["content"], r["reason"]) for r in outputs.trusted_files(spark, [str(root / n) for n in ("a.txt", "big.txt", "link", "none")] + [str(tmp_path / "out.txt")], str(root), 50).collect()}
    assert got == {"a.txt": ("hello", None), "big.txt": (None, "output_path_too_large"), "link": (None, "untrusted_output_path"), "none": (None, "output_path_read_error"), "out.txt": (None, "untrusted_output_path")}


def test_state_machines():
    b = state.Breaker()
    assert [b.step(t, False) for t in range(4)] == ["closed"] * 3 + ["open"]
    assert b.step(2 + 60_000, False) == "half_open" and b.step(2 + 60_001, True) == "open" and b.step(2 + 120_000, True) == "half_open" and b.step(2 + 120_001, True) == "closed"
    c = state.Cache()
    assert [c.step(0, "a"), c.step(1, "a"), c.step(state.CACHE_TTL_MS, "a")] == [False, True, False]


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"k{rng.randint(0, 3)}", i * 20_000, rng.choice(["x", "y", "z"]), "delete" if i % 31 == 30 else rng.choice(["user", "assistant"]), rng.random() > 0.6) for i in range(120)]
    schema = "key string, seq long, value string, role string, ok boolean"
    for n in range(3):  # three micro-batches, in order of seq
        spark.createDataFrame(rows[n * 40 : n * 40 + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rest = spark.createDataFrame(rows, schema)
    for step in state.STEPS:
        events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = state.run_stream(events, step).writeStream.format("memory").queryName(f"out_{step}").option("checkpointLocation", str(tmp_path / f"cp_{step}")).trigger(availableNow=True).outputMode("append").start()
        q.awaitTermination(90)
        got = sorted(tuple(r) for r in spark.table(f"out_{step}").collect())
        assert got == sorted(tuple(r) for r in state.run_batch(rest, step).collect()), step


def test_repeats_expire_only_where_asked(spark):
    """Rows far apart in seq, of a key with few of them: the last 32 outputs count, whatever their seq, unless they were given a lifetime."""
    rest = spark.createDataFrame([("a", i * 50_000_000, "xyz"[i % 3], "user", True) for i in range(9)], "key string, seq long, value string, role string, ok boolean")
    got = lambda **a: [r["result"] for r in state.run_batch(rest, "repeats", **a).sort("seq").collect()]
    assert got() == [None] * 3 + [str(i * 50_000_000) for i in range(6)]
    assert got(ttl_ms=24 * 3_600_000) == [None] * 9


def test_tokens_list_no_matches(spark):
    """Pieces are counted, never listed: a list of them is many times as large as a long payload. Counts equal those of the listed pieces."""
    rng, marks = random.Random(3), ["a", "Z", "_", "$", "0", "7", "1", ".", ".", " ", "\n", "\t", "\xa0", "é", "漢", "-", "{", "=>", "😀", "abcd", "12"]
    texts = ["".join(rng.choices(marks, k=rng.randint(1, 60))) for _ in range(400)] + ["1.2.3.4", "12.34.56", "a1.5", "1.a5", "123abc4567", " \n ", "abcd1234efgh5", "1234.5678 9."]
    df = spark.createDataFrame([(t,) for t in texts], "x string").select("x", tokens.code_tokens(F.col("x")).alias("code"), tokens.prose_tokens(F.col("x")).alias("prose"), tokens.tokens(F.col("x")).alias("n"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "regexp_count" not in plan
    pieces = k.re.compile(r"([A-Za-z_$][\w$]*)|(\d+(?:\.\d+)?)|[^ \t\n\x0b\f\r\w]", k.re.ASCII)
    prose = k.regex.compile(r"[\p{L}\p{N}_]{1,4}|[^ \t\n\x0b\f\r\p{L}\p{N}_]")
    for r in df.collect():
        fifths = sum(5 * -(-len(m[1]) // 4) if m[1] else 5 * -(-len(m[2]) // 3) if m[2] else 3 for m in pieces.finditer(r["x"]))
        assert (r["code"], r["prose"]) == (max(1, -(-fifths // 5)), len(prose.findall(r["x"]))), r["x"]


def test_admission_carries_no_outputs(spark):
    """What is asked behind the gates holds no output: neither the Python function's rows nor copies of them."""
    df = spark.createDataFrame([("a", "def f():\n    return 1\nimport os\nclass A:\n    pass\n", "cat f.py"), ("b", None, "cat f.py"), ("c", "", "cat f.py"), ("d", "word " * 40, "ls")], "id string, content string, args string")
    d = policy.admit(df.withColumn("tool", F.lit("shell")), policy.Policy(), output="content", args="args").select("id", "reason")
    assert sorted(map(tuple, d.collect())) == [("a", "read_protected"), ("b", "source_denied"), ("c", "empty_or_marked"), ("d", "admitted")]
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("Generate")[0]
    assert "ArrowEvalPython" in above and "content#" not in above


def test_payloads_are_dealt_by_size(spark, tmp_path):
    """More tables' bytes give more partitions, so that what meets in a batch stays bounded."""
    cores = spark.sparkContext.defaultParallelism
    small = spark.range(10)
    large = spark.range(10).select(F.explode(F.sequence(F.lit(1), F.lit(200_000))).alias("x"), F.rand(1).alias("y")).repartition(1)
    large.write.parquet(str(tmp_path / "large"))
    assert views.shares(spark, [small]) == 4 * cores
    stored = sum(f.stat().st_size for f in (tmp_path / "large").glob("*.parquet"))
    got = views.shares(spark, [small, spark.read.parquet(str(tmp_path / "large"))] * 3)
    assert got >= 3 * stored // views.SHARE_BYTES > 4 * cores


def test_batches_are_bounded_by_bytes():
    texts = ["x" * n for n in (3, 9, 2, 2, 2, 30, 0)] + [None, "é" * 5]
    got = [p.column(0).to_pylist() for p in lossless.parts(lossless.pa.RecordBatch.from_pydict({"t": texts}), "t", 10)]
    assert [x for p in got for x in p] == texts and [[len((x or "").encode()) for x in p] for p in got] == [[3], [9], [2, 2, 2], [30], [0, 0, 10]]
    assert [p.num_rows for p in lossless.parts(lossless.pa.RecordBatch.from_pydict({"t": lossless.pa.array([], "string")}), "t")] == [0]


def test_text_helpers(spark):
    df = spark.createDataFrame([("abcdefghij" * 20,)], "x string")
    assert len(df.select(text.clip(F.col("x"), F.lit(90))).collect()[0][0]) == 90
    assert text.glob_regex("a*b?.c") == r"(?i)^a.*b.\.c$"


def test_brace_folding():
    body = "\n".join(f"  const a{i} = `x${{y}} }} {i}`; // }}" for i in range(8))
    src = f"import x from 'y';\nexport async function long(a: number): Promise<void> {{\n{body}\n}}\nclass A {{\n  method(b) {{\n{body}\n  }}\n  bad() {{\n{body}\n    throw new Error('}}');\n  }}\n}}\nconst f = (x) => {{\n{body}\n}};\nif (x) {{\n{body}\n}}\nconst r = /[}}/]{{2}}/g;\n"
    out, why = k.shorter_code(src, "", KEY, B)
    assert why == "ok" and out.count("8 lines omitted") == 3 and "throw new Error" in out and out.count("const a3") == 2 and "export async function long(a: number): Promise<void> { /*" in out
    assert out.endswith(f"// [Retrieve more: hash={KEY}]")
    assert k.shorter_code("const a = {", "", KEY, B)[1] == "invalid_syntax" and k.shorter_code("const a = 1;", "", KEY, B)[1] == "nothing_to_compress"
    assert k.shorter_code(src, "const", KEY, B)[1] == "nothing_to_compress" and k.shorter_code("fn main() {}", "", KEY, B)[1] == "unsupported_language"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, tmp_path):
    """The compaction shuffles nothing; a lookup reads only the columns and rows it needs; a popular hash is aggregated before its join."""
    rows = [("1", log_text(), "")]
    spark.createDataFrame(rows, "id string, content string, query string").write.parquet(str(tmp_path / "p"))
    p = plan_of(compaction.compact(spark.read.parquet(str(tmp_path / "p"))))
    assert "Exchange" not in p and p.count("MapInArrow") == 1
    spark.createDataFrame([], store.SCHEMA).write.parquet(str(tmp_path / "e"))
    e = spark.read.parquet(str(tmp_path / "e"))
    p = plan_of(store.live(e, 5).where("session_id = 'a'").select("id", "hash"))
    assert "GreaterThan(expires_ms,5)" in p and "EqualTo(session_id,a)" in p and "content" not in p.split("ReadSchema")[1]


def test_compaction_of_a_stream(spark, tmp_path):
    schema = "id string, content string, query string"
    spark.createDataFrame([("1", log_text(), ""), ("2", "short", None)], schema).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = compaction.compact(s).writeStream.format("memory").queryName("compacted").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {r["id"]: r["changed"] for r in spark.table("compacted").collect()}
    assert got == {"1": True, "2": False}


def test_sources_and_sinks(spark, tmp_path):
    out = spark.createDataFrame([("s", "c", 1, "Bash", {"a": "b"}, None, "x", 1, None), ("s", "d", 2, "Bash", None, None, None, 1, None)], outputs.OUTPUTS)
    out.write.parquet(str(tmp_path / "o"))
    assert [r["call_id"] for r in outputs.tool_outputs(spark, str(tmp_path / "o")).collect()] == ["c"]
    m = spark.sql("SELECT 's' AS session_id, 3 AS message_idx, array(named_struct('call_id', 'a', 'output', 'x'), named_struct('call_id', 'b', 'output', 'y')) AS parts")
    assert [(r["part_idx"], r["call_id"]) for r in outputs.parts(m).orderBy("part_idx").collect()] == [(0, "a"), (1, "b")]
    r = outputs.with_result_note(compaction.compact(spark.createDataFrame([("1", log_text(), "")], "id string, content string, query string"))).collect()[0]
    assert r["note"]["tokens_saved"] == r["original_tokens"] - r["compressed_tokens"] > 0 and r["note"]["hash"] == r["hash"]
    debug = spark.createDataFrame([(1, ["a"])], "id int, selections array<string>")
    outputs.write_debug(debug, str(tmp_path / "d"))
    outputs.write_debug(debug, str(tmp_path / "d"), "trace")
    assert spark.read.json(str(tmp_path / "d")).where("selections is not null").count() == 1


def test_own_token_counter(spark):
    df = spark.createDataFrame([("a b c",), (None,)], "content string")
    assert [r["tokens"] for r in tokens.counted_by(df, lambda t: len(t.split())).collect()] == [3, None]
    with pytest.raises(Exception, match="whole number"):
        tokens.counted_by(df, lambda t: -1).collect()


def test_many_facts_are_looked_up_by_line(spark):
    """facts that are lines are found without a search of the text for each; others still count as parts of lines, and lost ones as lost."""
    lines = [f"  def f{i}(x):" for i in range(500)]
    facts = [x.strip() for x in lines]
    rows = [("all", facts, "\n".join(lines)), ("part", [*facts, "f3(x"], "\n".join(lines)), ("lost", [*facts, "gone"], "\n".join(lines)), ("few", ["gone"], "x"), ("none", [], "x")]
    df = spark.createDataFrame(rows, "id string, facts array<string>, text string")
    lost = df.select("id", html.lost_fact(F.col("facts"), F.col("text")).alias("lost"))
    assert {r["id"]: r["lost"] for r in lost.collect()} == {"all": False, "part": False, "lost": True, "few": True, "none": False}


def test_python_is_parsed_in_parts():
    """a long module is parsed in parts, and gives what it gives as a whole; a definition in a string makes it one part."""
    def one(i, n=8):
        return "\n".join([f"def part_{i}(x):", *(f"    y{j} = {i} * x" for j in range(n)), "    return x"])

    t = "\n\n".join(one(i) for i in range(600))
    assert len(k.python_parts(t)) > 3 and "".join(k.python_parts(t)) == t
    out, why = k.shorten("code", t, "", "0" * 24)
    assert why == "ok" and out == f"{k.without_bodies(t, [])}\n# {k.marker('0' * 24)}" and out.count("lines omitted") == 600
    text = 's = """\n' + t + '\n"""\n\n' + one(7)
    assert k.shorten("code", text, "", "0" * 24)[0].count("lines omitted") == 1
    assert k.shorten("code", t + "\n\ndef broken(:\n    pass", "", "0" * 24) == (None, "invalid_syntax")


def test_tokens_counted_over_arrays(spark, monkeypatch):
    """counts over arrays equal those of the built-in functions, on odd texts and across pieces."""
    from sievework.functions import tokens as t

    monkeypatch.setattr(t, "PIECE", 20)
    parts = ["1", "23", ".", "a", "Zb", "_", "$", " ", "\n", "-", "{", "}", "=>", "1.2.3", "x1.5", "\t", "\x00", "\x1c", "import ", "é", "日本", "語", "ж", "“", " ", "²"]
    pick = random.Random(3)
    xs = ["".join(pick.choices(parts, k=pick.randint(0, 40))) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in xs], "x string").select("x", t.tokens(F.col("x")).alias("n"))
    got = [(r["x"], t.counted_tokens(r["x"]), r["n"]) for r in df.collect()]
    assert [g for g in got if g[1] is not None and g[1] != g[2]] == [] and sum(g[1] is not None for g in got) > 1900
    assert [t.counted_tokens(x) for x in (None, "a\rb", "😀", "aB3" * 20, " ")] == [None] * 5


@pytest.mark.parametrize("text", ['[{"a":1,"b":2.50},{"a":-0,"b":1e3}]', '[{"a":1e-7,"b":"x"},{"a":1e21,"b":"é"}]', '[{"a":12345678901234567890,"b":0.1},{"a":true,"b":null}]'])
def test_json_written_by_the_library(text):
    """numbers that the library writes otherwise than JavaScript go the longer way; all give the same text."""
    value, write = lossless.read_json(text)
    assert write(value) == lossless.dump_json(lossless.parse_json(text)) == lossless.unfold_table(lossless.fold_table(text))


def test_headings_folded_in_python(spark):
    """search results are folded as the built-in functions fold them, odd line ends included."""
    parts = ["a/b.py:", "c:", "12:", "3:x", ":", "\n", "\n", "\r", "\u2028", "é", " ", "4:"]
    pick = random.Random(5)
    xs = ["".join(pick.choices(parts, k=pick.randint(0, 30))) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in xs], "x string").select("x", lossless.headings_folded(F.col("x")).alias("f"))
    got = [(r["x"], r["f"]) for r in df.collect()]
    assert [x for x, f in got if lossless.fold_headings(x) != f] == [] and sum(x != f for x, f in got) > 100


def test_broken_promises_store_no_texts(spark, sf):
    """the promises are tested in the compaction's own pass; nothing is checkpointed."""
    from sievework.plans import whole

    assert "MapInArrow" in plan_of(whole.compact_broken_promises(spark, sf))
    c = spark.createDataFrame([("a", "x y", "text", "text", True, "x", content_hash_of("x y"), 5, 1), ("b", "x y", "text", "none", False, "x", content_hash_of("x y"), 5, 5)], "id string, content string, kind string, strategy string, changed boolean, output string, hash string, original_tokens long, compressed_tokens long")
    assert [tuple(r) for r in whole.broken_promises(c).collect()] == [("b", "text", "none")]


def content_hash_of(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()[:24]
