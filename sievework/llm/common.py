"""What the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns, doc_id and text (null: empty). All other columns, whatever their names, stay out of the operator."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def map_texts(df: DataFrame, make: Callable[[], Callable[[list[str]], dict[str, list]]], fields: list[tuple[str, str]]) -> DataFrame:
    """doc_id and new columns computed from text, batch by batch in Python, without a shuffle.

    make() is called once in each task and returns the function of a batch's texts; fields: (name, SQL type) of what that returns.
    """
    schema = StructType([df.schema["doc_id"], *(StructField(n, _sql_type(t)) for n, t in fields)])
    arrow = [(n, to_arrow_type(_sql_type(t))) for n, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            for at in range(0, b.num_rows, 512):  # bounds what lies in Python at once
                part = b.slice(at, 512)
                out = f(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(out[n], t) for n, t in arrow)], names=["doc_id", *(n for n, _ in arrow)])

    return df.select("doc_id", "text").mapInArrow(run, schema)


def _sql_type(t: str):
    return StructType.fromDDL(f"x {t}")["x"].dataType




#: A side that is broadcast has at most so many rows and bytes, counted before; larger ones meet the other side by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64_000_000


def if_small(side: DataFrame, size=None) -> DataFrame:
    """side, marked for broadcast if it is small: counted rows, and the summed Column size (bytes of a row beyond some fixed ones)."""
    got = side.agg(F.count("*").alias("n"), F.sum(size if size is not None else F.lit(0)).alias("b")).first()
    return F.broadcast(side) if got["n"] <= BROADCAST_ROWS and (got["b"] or 0) <= BROADCAST_BYTES else side
