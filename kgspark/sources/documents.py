"""Text documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from kgspark.operators.streams import pieces


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file; bytes that are not UTF-8 are dropped."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(
        F.col("_metadata.file_name").alias("name"),
        F.lower(F.regexp_extract(F.col("_metadata.file_name"), r"\.([^.]*)$", 1)).alias("file_type"),
        decoded(F.col("content")).alias("text"),
    )


@F.arrow_udf(StringType())
def _without_bad_bytes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for contents in batches:
        for start, n in pieces(contents):
            part = contents.slice(start, n).to_pylist()
            yield pa.array([None if c is None else c.decode("utf-8", "ignore") for c in part], type=pa.string())


def decoded(content: Column) -> Column:
    """UTF-8 with invalid bytes left out; only contents that hold some go to Python."""
    text = content.cast("string")
    bad = ~F.is_valid_utf8(text)
    return F.when(bad, _without_bad_bytes(F.when(bad, content))).otherwise(text)


def document_table(documents: DataFrame, text: str = "text") -> DataFrame:
    return documents.select("doc_id", F.col(text).alias("text"), F.length(text).alias("total_chars"))
