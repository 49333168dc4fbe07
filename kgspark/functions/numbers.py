"""Rounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_to(c: Column | str, digits: int) -> Column:
    """Round half up on the scaled double.

    Spark's own ``round`` works on the shortest decimal text of a double, which moves
    values just below a half up; this form agrees with other engines.
    """
    scale = float(10**digits)
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * scale + 0.5) / scale
