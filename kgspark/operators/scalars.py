"""Row filters on mentions and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def confidence_filter(rows: DataFrame, minimum: float = 0.5) -> DataFrame:
    return rows.filter(F.col("confidence") >= minimum)
