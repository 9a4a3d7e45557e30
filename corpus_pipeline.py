"""The corpus pipeline: stages that hand documents on, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import bpe, contamination, lines, near_duplicates, quality_rules
from sievework.llm.catalog import vocab_path
from sievework.llm.common import if_small
from sievework.session import cut, remove_folder, shared_folder, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the robust distances reject.

    Null, empty and short texts fail the base rules and go. Null ids, languages and sources don't matter; repeated rows are judged alike; long
    texts are judged whole; ties at the cutoff stay. No documents give none; further columns, whatever their names, stay.
    """
    return quality_rules.keep_good(docs)


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a smaller doc_id holds; n_chars follows. Documents that lose all their words with them go.

    Texts that lose nothing stay as they are, null and empty ones included, and so do rows with a null id. Rows of one doc_id keep their
    lines against each other; long texts are split whole. No documents give none; further columns stay.
    """
    emptied = (F.btrim("text", F.lit(lines.STRIPPED)) == "") & (F.octet_length("text") < F.col("__before")) & F.col("__some")
    marked = lines.apply_bitmaps(docs.withColumns({"__before": F.octet_length("text"), "__some": F.btrim("text", F.lit(lines.STRIPPED)) != ""}), lines.keep_bitmaps(docs))
    left = marked.where(~F.coalesce(emptied, F.lit(False)))
    return left.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long"))).select(*(F.col(f"`{c}`") for c in docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the document with the smallest doc_id.

    Rows of one doc_id are one document and stay or go together. Null, empty and wordless texts and null ids are no one's duplicates and
    stay; long texts are compared whole. No documents give none; further columns stay.
    """
    found = near_duplicates.near_duplicates(docs)
    return _without(docs, found.where(~F.col("kept")).select("doc_id"))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passages beyond the limit.

    Null and empty texts hold none and stay, and so do null ids. Rows of one doc_id go together if any of them is contaminated; long texts
    are searched whole; a share of exactly a twentieth contaminates. No documents give none, an empty benchmark keeps all; further columns stay.
    """
    found = contamination.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("contaminated").select("doc_id"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' token ids, counted and digested, with the digest of what they decode to: a row for each row.

    Null and empty texts have no tokens; null ids stay null; repeated rows give repeated results; long texts are encoded whole. No documents
    give none; further columns are left out.
    """
    return bpe.bpe_digests(docs, vocab_path())


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the ids that go; a null id never goes."""
    ids = cut(gone.select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(if_small(ids), F.col("doc_id") == F.col("__gone"), "left_anti")


STAGES = [("quality rules", good_documents), ("line dedup", first_lines), ("near-duplicates", one_of_each_group), ("decontamination", uncontaminated), ("bpe", encoded)]

#: None: the rejection by robust distances and the encoding have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of sf_dir, with each stage's rows written to the shared folder and read again.

    A stage's folder goes once the next one's is written; the last one's, which the result reads, when the driver's process ends.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        at = shared_folder(spark, f"pipeline-{name.replace(' ', '_')}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            remove_folder(spark, before)
        before = at
    return docs
