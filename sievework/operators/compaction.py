"""The compaction of payloads: classify, fold, shorten by kind, gate, choose."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from sievework.functions.detect import with_kind
from sievework.functions.kernels import json_facts, shorten
from sievework.functions.text import content_hash, retrieve_marker
from sievework.functions.tokens import counted_tokens, tokens
from sievework.operators import html, lossless

ENVELOPE = r"(?s)^(\s*(?:<returncode>\s*-?\d+\s*</returncode>\s*)?<(output|stdout|stderr|tool_result|result)>\n?)(.*?)(\n?</\2>\s*)$"
SECTION = r"(?s)<(output|stdout|stderr|tool_result|result)>.*?</\1>"


def unwrapped(df: DataFrame, content: str = "content") -> DataFrame:
    """df with prefix, payload, suffix: a single tagged envelope taken off, else the whole content as payload."""
    c = F.col(content)
    single = c.rlike(ENVELOPE) & (F.regexp_count(c, F.lit(SECTION)) == 1)
    part = lambda k, other: F.when(single, F.regexp_extract(c, ENVELOPE, k)).otherwise(other)
    return df.withColumns({"prefix": part(1, F.lit("")), "payload": part(3, c), "suffix": part(4, F.lit(""))})


def sections(df: DataFrame, id_col: str = "id", content: str = "content") -> DataFrame:
    """Of contents that are nothing but two tagged sections or more: id, pos, gap (what stands before), open, body, close; each section is a payload of its own."""
    c = F.col(content)
    only = F.regexp_replace(F.regexp_replace(c, SECTION, ""), r"^\s*<returncode>\s*-?\d+\s*</returncode>", "")
    d = df.where((F.regexp_count(c, F.lit(SECTION)) >= 2) & ~only.rlike(r"\S"))
    each = d.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(c, F.lit(rf"(?s)\s*(?:<returncode>\s*-?\d+\s*</returncode>\s*)?{SECTION[4:].replace(chr(92) + '1', chr(92) + '1')}\s*"), F.lit(0))).alias("pos", "section"))
    pattern = r"(?s)^(.*?)(<(output|stdout|stderr|tool_result|result)>\n?)(.*?)(\n?</\3>\s*)$"
    x = F.col("section")
    return each.select("id", "pos", *(F.regexp_extract(x, pattern, k).alias(n) for k, n in ((1, "gap"), (2, "open"), (4, "body"), (5, "close"))))


def _with_candidates(df: DataFrame, strength: str) -> DataFrame:
    """df with candidate, why, json_facts, lossless (null: no fold), and the tokens of the three texts where they are counted there: one pass
    through Arrow batches, in which each row takes its kind's kernel."""
    counts = ("original_n", "candidate_n", "lossless_n")
    new = [("candidate", pa.string()), ("why", pa.string()), ("json_facts", pa.list_(pa.string())), ("lossless", pa.string()), *((n, pa.int64()) for n in counts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in lossless.parts(whole, "payload")):
            rows = [b.column(b.schema.get_field_index(n)).to_pylist() for n in ("kind", "payload", "query", "hash", "folded", "page")]
            out: list[list] = [[] for _ in new]
            for kind, text, query, key, folded, page in zip(*rows):
                short, why = (page, "ok" if page else "too_few_lines") if kind == "html" else shorten(kind, text, query, key, strength)
                fold = lossless.checked(kind, text, lossless.fold_headings(text) if kind == "search" else folded)
                fold = None if fold == text else fold
                for o, v in zip(out, (short, why, json_facts(text) if kind == "json" and short is not None else [], fold, *map(counted_tokens, (text, short, fold)))):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v, t) for v, (_, t) in zip(out, new))], names=[*b.schema.names, *(n for n, _ in new)])

    schema = StructType([*df.schema.fields, *(StructField(n, ArrayType(StringType()) if n == "json_facts" else LongType() if n in counts else StringType()) for n, _ in new)])
    return df.mapInArrow(run, schema)


def compact(payloads: DataFrame, strength: str = "balanced") -> DataFrame:
    """payloads (id, content, query) with kind, strategy, reason, changed, output, hash, original_tokens, compressed_tokens.

    No row leaves its partition: classification, tokens, folds, pages, facts and the gate are built-in functions; what selects
    by its own earlier choices runs in Arrow batches, one pass for all kinds. Of the lossy and the lossless form the first that passes the
    gate is taken; otherwise the content stays, with the reason. Rows with a null content are left out.
    """
    d = payloads.where(F.col("content").isNotNull()).select("id", "content", F.coalesce(F.col("query"), F.lit("")).alias("query"))
    d = with_kind(unwrapped(d), "payload").drop("confidence").withColumn("hash", content_hash(F.col("content")))
    page = F.when((F.col("kind") == "html") & (F.char_length("payload") >= 500), html.page_text(F.col("payload")))
    folded = F.when(F.col("kind").isin("log", "text"), lossless.runs_folded(F.col("payload")))  # long search results are folded where they are read
    d = d.withColumn("folded", folded).withColumn("page", F.concat(page, F.lit("\n"), retrieve_marker(F.col("hash"))))
    # the content is its three parts, so it needn't travel a second time
    j = _with_candidates(d.drop("content"), strength).drop("page", "folded")
    facts = F.when(F.col("kind") == "json", F.col("json_facts")).otherwise(html.protected_facts(F.col("kind"), F.col("payload")))
    for name, text in (("original", "payload"), ("candidate", "candidate"), ("lossless", "lossless")):
        j = j.withColumn(f"{name}_tokens", F.coalesce(f"{name}_n", tokens(F.col(text)))).drop(f"{name}_n")
    verdict = F.when(F.col("candidate").isNull(), F.col("why")).otherwise(html.gate(F.col("kind"), F.col("original_tokens"), F.col("candidate"), F.col("candidate_tokens"), facts))
    fold_ok = F.coalesce(F.col("lossless_tokens") < F.col("original_tokens"), F.lit(False))
    json_fold = (F.col("kind") == "json") & fold_ok  # a folded table is no JSON any more, so nothing is dropped from it
    j = j.withColumn("verdict", verdict).withColumn("took", F.when(json_fold, "lossless").when(F.col("verdict") == "accepted", F.col("kind")).when(fold_ok, "lossless"))
    took = F.col("took")
    out = F.when(took == "lossless", F.col("lossless")).when(took.isNotNull(), F.col("candidate")).otherwise(F.col("payload"))
    rejected = F.col("verdict").isin("empty_candidate", "invalid_structure", "protected_fact_lost", "no_token_savings")
    reason = F.when(took.isNotNull(), "compressed").when(rejected, F.concat(F.lit("candidate_"), F.col("verdict"))).otherwise(F.col("verdict"))
    return j.select(
        "id", F.concat("prefix", "payload", "suffix").alias("content"), "kind", F.coalesce(took, F.lit("none")).alias("strategy"), reason.alias("reason"), took.isNotNull().alias("changed"), F.concat("prefix", out, "suffix").alias("output"), "hash", "original_tokens",
        F.when(took == "lossless", F.col("lossless_tokens")).when(took.isNotNull(), F.col("candidate_tokens")).otherwise(F.col("original_tokens")).alias("compressed_tokens"),
    )
