"""Results of graph endpoints (JSON bindings) as rows, and CSV export of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kgspark.schemas import BINDINGS


def bindings_to_rows(bodies: DataFrame, variables: list[str], keys: list[str], body: str = "body") -> DataFrame:
    """One row per binding; a variable that a binding lacks is null."""
    parsed = bodies.select(*keys, F.from_json(body, BINDINGS).alias("r"))
    rows = parsed.select(*keys, F.explode("r.results.bindings").alias("b"))
    return rows.select(*keys, *[F.element_at("b", F.lit(v))["value"].alias(v) for v in variables])


def boolean_results(bodies: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    parsed = bodies.select(*keys, F.from_json(body, BINDINGS).alias("r"))
    return parsed.filter("r.boolean IS NOT NULL").select(*keys, F.col("r.boolean").alias("result"))


def write_result_csv(rows: DataFrame, path: str) -> None:
    """Header line, quotes doubled, values quoted where needed."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def csv_line(columns: list[str]):
    """The CSV text of a row as a column."""

    def cell(name):
        v = F.coalesce(F.col(name).cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(v.rlike('[",\n]'), quoted).otherwise(v)

    return F.concat_ws(",", *[cell(c) for c in columns])
