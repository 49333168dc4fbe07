"""Rows that become many rows are dealt by their number, not by their compressed bytes."""

import pytest
from pyspark.sql import functions as F

from kgspark.plans import graph_queries as Q
from kgspark.sources import fixtures as X, turtle


def most_in_a_task(rows):
    return rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Few suppliers and regions, 20000 parts, customers and line items, all pairs twice, and documents with equal and null keys."""
    folder = str(tmp_path_factory.mktemp("tables"))
    ids = spark.range(20000)
    made = {
        "region": spark.range(2).selectExpr("id AS r_regionkey", "concat('R', id) AS r_name"),
        "nation": spark.range(4).selectExpr("id AS n_nationkey", "concat('N', id) AS n_name", "id % 2 AS n_regionkey"),
        "supplier": spark.range(50).selectExpr("id AS s_suppkey", "concat('S', id) AS s_name", "id % 4 AS s_nationkey"),
        "customer": ids.selectExpr("id AS c_custkey", "concat('C', id) AS c_name", "id % 4 AS c_nationkey"),
        "part": ids.selectExpr("id AS p_partkey", "concat('p', id) AS p_name", "'B' AS p_brand", "'LARGE' AS p_type", "1 AS p_size"),
        "lineitem": ids.selectExpr("id AS l_orderkey", "id % 10000 AS l_partkey", "id % 50 AS l_suppkey", "1 AS l_linenumber"),
        "documents": ids.selectExpr("IF(id % 100 = 0, NULL, id div 2) AS doc_id", "'some words in a text' AS text"),
    }
    for name, rows in made.items():
        rows.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_triples_are_dealt_by_the_number_of_rows(spark, tables, monkeypatch):
    monkeypatch.setattr(X, "ROWS_DEALT", 1000)
    triples = X.triples(spark, tables)
    assert triples.count() == 2 * 2 + 4 * 3 + 50 * 3 + 20000 * 3 + 20000 * 4 + 10000 + X._class_rows(X.table(spark, tables, "region")).count()
    assert most_in_a_task(triples) < 4 * 2000
    assert {r["start"] for r in Q.turtle_lines(spark, tables).select("start").distinct().collect()} == set(range(-1, 36))


def test_documents_are_dealt_by_their_number(spark, tables, monkeypatch):
    monkeypatch.setattr(X, "DOCUMENTS_DEALT", 500)
    documents = X.table(spark, tables, "documents")
    assert documents.count() == 20000
    assert most_in_a_task(documents) < 2000


def test_turtle_triples_meet_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(turtle, "DEALT", 100)
    lines = spark.range(3000).selectExpr("'f' AS file", "id div 500 AS start", "id AS row", "concat('<s', id % 1500, '> <p> <o> .') AS value")
    good, errors = turtle.parse_turtle(lines)
    assert errors.count() == 0 and good.count() == 1500
    assert most_in_a_task(good) < 300
