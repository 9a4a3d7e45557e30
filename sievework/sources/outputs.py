"""Sources of payloads and sinks of results."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schema of tool outputs.
OUTPUTS = "session_id string, call_id string, seq bigint, tool string, args map<string,string>, intent string, output string, ttl_ms bigint, strength string"
TRUNCATED = "...output truncated"


def tool_outputs(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Tool outputs from Parquet, at rest or as a stream; rows without an output wait for it elsewhere."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(OUTPUTS).parquet(path).where(F.col("output").isNotNull())


def truncated(display: Column, flag: Column) -> Column:
    """Whether what is shown is only the beginning of an output that lies in a file."""
    return F.coalesce(flag, F.lit(False)) | F.ltrim(display).startswith(TRUNCATED)


def within_root(path: Column, root: str) -> Column:
    """Whether a normal absolute path is the root or lies below it."""
    base = os.path.normpath(root)
    clean = ~path.rlike(r"(^|/)\.\.?(/|$)|//")
    return clean & ((path == base) | path.startswith(base.rstrip("/") + "/"))


def trusted_files(spark: SparkSession, paths: list[str], root: str, max_bytes: int, max_chars: int = 250_000) -> DataFrame:
    """path, content, reason of files that stand in for truncated outputs.

    Links are resolved and the root is checked on the driver, before anything is read; Spark reads only files of up to
    max_bytes, whole; the rest come with a reason and no content.
    """
    base = os.path.realpath(root)
    good, rows = [], []
    for p in paths:
        real = os.path.realpath(p)
        if os.path.commonpath([base, real]) != base or os.path.islink(p):
            rows.append((p, None, "untrusted_output_path"))
        elif not os.path.isfile(real):
            rows.append((p, None, "output_path_not_regular" if os.path.exists(real) else "output_path_read_error"))
        elif os.path.getsize(real) > max_bytes:
            rows.append((p, None, "output_path_too_large"))
        else:
            good.append(real)
    bad = spark.createDataFrame(rows, "path string, content string, reason string")
    if not good:
        return bad
    files = spark.read.format("binaryFile").load(good).where(F.col("length") <= max_bytes)
    read = files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.left(F.decode(F.col("content"), "UTF-8"), F.lit(max_chars)).alias("content"))
    return bad.unionByName(read.withColumn("reason", F.lit(None).cast("string")))


def parts(messages: DataFrame) -> DataFrame:
    """messages (session_id, message_idx, parts array<struct>) as a row for each part: session_id, message_idx, part_idx, and the part's fields."""
    return messages.select("session_id", "message_idx", F.posexplode("parts").alias("part_idx", "p")).select("session_id", "message_idx", "part_idx", "p.*")


def with_result_note(results: DataFrame) -> DataFrame:
    """Results of the compaction with what is told along with an output: strategy, hash, tokens, tokens saved."""
    saved = F.greatest(F.lit(0), F.col("original_tokens") - F.col("compressed_tokens"))
    return results.withColumn("note", F.struct("strategy", F.when(F.col("changed"), F.col("hash")).alias("hash"), F.col("original_tokens").alias("tokens"), saved.alias("tokens_saved")))


def write_debug(records: DataFrame, path: str, level: str = "summary") -> None:
    """Records appended as lines of JSON; a summary drops the selections that a trace keeps. A sink that fails must not stop the work, so callers may ignore errors."""
    out = records.drop("selections") if level == "summary" else records
    out.write.mode("append").json(path)
