"""The table of stored originals: keys, expiry, capacity, lookup, deletion, statistics. The time now is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import content_hash

SCHEMA = "id bigint, hash string, session_id string, call_id string, tool string, strategy string, content string, compressed string, original_tokens bigint, compressed_tokens bigint, original_chars bigint, created_ms bigint, expires_ms bigint, retrieval_count bigint, default_mode string, default_max_chars int"


def digest(content: Column) -> Column:
    """Digest in a domain of its own over UTF-16, so that it can't be taken for a content hash."""
    return F.sha2(F.concat(F.lit("content-digest:v1\x00").cast("binary"), F.encode(content, "UTF-16LE")), 256)


def with_keys(entries: DataFrame, content: str = "content", base: Column | None = None) -> DataFrame:
    """entries with hash: the content hash, or if other contents took it before, a hash with the number of the attempt.

    Contents are ranked by their first entry's id; equal contents share a key.
    """
    d = entries.withColumn("__b", content_hash(F.col(content)) if base is None else base).withColumn("__d", digest(F.col(content)))
    firsts = d.groupBy("__b", "__d").agg(F.min("id").alias("__first")).withColumn("__n", F.row_number().over(Window.partitionBy("__b").orderBy("__first")) - 1)
    again = F.substring(F.sha2(F.concat_ws(":", F.lit("collision"), "__b", "__d", "__n"), 256), 1, 24)
    return d.join(firsts.drop("__first"), ["__b", "__d"]).withColumn("hash", F.when(F.col("__n") == 0, F.col("__b")).otherwise(again)).drop("__b", "__d", "__n")


def live(entries: DataFrame, now_ms: int) -> DataFrame:
    """Entries that expire after now."""
    return entries.where(F.col("expires_ms") > now_ms)


def newest(entries: DataFrame, capacity: int) -> DataFrame:
    """The capacity newest entries by (created_ms, id). A sort with a limit; no window over all rows."""
    edge = entries.select("created_ms", "id").orderBy(F.desc("created_ms"), F.desc("id")).limit(capacity)
    last = edge.agg(F.min(F.struct("created_ms", "id")).alias("m")).select("m.*").toDF("__c", "__i")  # one row
    return entries.join(F.broadcast(last), (F.col("created_ms") > F.col("__c")) | ((F.col("created_ms") == F.col("__c")) & (F.col("id") >= F.col("__i")))).drop("__c", "__i")


def put(entries: DataFrame, new: DataFrame, now_ms: int, capacity: int = 10_000) -> DataFrame:
    """The table after new rows (as SCHEMA without hash): expired rows go first, then the oldest ones beyond the capacity."""
    bad = new.where((F.col("expires_ms") <= F.col("created_ms")) | F.col("expires_ms").isNull())
    if not bad.isEmpty():
        raise ValueError("entries must live for some time")
    return newest(live(entries, now_ms).unionByName(with_keys(new), allowMissingColumns=True), capacity)


def latest(requests: DataFrame, entries: DataFrame, now_ms: int) -> DataFrame:
    """requests (hash, session_id null: any) with the newest live entry, in its session if one is named; without one, nulls.

    The newest entry of each hash, and of each hash and session, is an aggregate, so popular hashes are small on the join.
    """
    alive = live(entries, now_ms)
    cols = [c for c in alive.columns if c not in ("hash", "session_id")]
    pick = F.max_by(F.struct("session_id", *cols), "id").alias("entry")
    by_hash = alive.groupBy("hash").agg(pick)
    by_both = alive.groupBy("hash", "session_id").agg(pick)
    named = requests.where(F.col("session_id").isNotNull()).join(by_both, ["hash", "session_id"], "left")
    other = requests.where(F.col("session_id").isNull()).join(by_hash, "hash", "left")
    return named.unionByName(other)


def without_session(entries: DataFrame, session: str) -> DataFrame:
    return entries.where(~F.col("session_id").eqNullSafe(session))


def orphans(history: DataFrame, entries: DataFrame) -> DataFrame:
    """history (hash, digest) of hashes that no entry has any more."""
    return history.join(entries.select("hash").distinct(), "hash", "left_anti")


def stats(entries: DataFrame, now_ms: int, *by: str) -> DataFrame:
    saved = F.greatest(F.lit(0), F.col("original_tokens") - F.col("compressed_tokens"))
    return live(entries, now_ms).groupBy(*by).agg(F.count("*").alias("entries"), F.sum("original_tokens").alias("original_tokens"), F.sum("compressed_tokens").alias("compressed_tokens"), F.sum(saved).alias("saved_tokens"), F.sum("retrieval_count").alias("retrievals"))


def write(entries: DataFrame, path: str) -> None:
    """The table as Parquet, sorted by hash within files so that lookups skip row groups; replaced as a whole."""
    entries.repartition("hash").sortWithinPartitions("hash", "id").write.mode("overwrite").parquet(path)


def read(spark, path: str) -> DataFrame:
    """The table at path; columns that older files lack are null, newer unknown ones are refused."""
    d = spark.read.option("mergeSchema", "true").parquet(path)
    known = spark.createDataFrame([], SCHEMA).schema
    odd = [c for c in d.columns if c not in known.names]
    if odd:
        raise ValueError(f"written by a newer version: {odd}")
    return d.select(*((F.col(f.name).cast(f.dataType) if f.name in d.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in known.fields))
