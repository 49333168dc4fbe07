"""Registered queries: triple sources and graph patterns."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from kgspark.functions import labels as L
from kgspark.operators import graph as G
from kgspark.sources import bindings, fixtures as X, triples as T, turtle
from kgspark.vocab import BASE, CANONICAL_KG_TYPES, LABEL_PREDICATES, RDF_TYPE, RDFS_LABEL, RELATIONS, TYPES

LOCATED, TREATS, AFFECTS = RELATIONS + "located_in", RELATIONS + "treats", RELATIONS + "affects"
CTE = lambda body, *more: X.with_tables("triples", *more, body=body)
sql_local = lambda c: f"regexp_extract({c}, '[^/#]*$')"
sql_map = lambda m: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in m.items()) + "}"
sql_in = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"


def triples(spark, d):
    return X.triples(spark, d)


def scan_triples(spark, d):
    """Triples go out as N-Triples lines and are parsed back into a set."""
    t = triples(spark, d).withColumn("value", T.ntriples_line(named=True))
    good = T.parse_ntriples(t.select("value", "src")).filter("ok")
    return good.select("s", "p", "o", "o_kind", "g", "src").dropDuplicates(["s", "p", "o", "g", "src"])


def turtle_lines(spark, d):
    """Triples as Turtle, a file per source in splits: prefixes, then one statement per subject with a line per triple.

    As real files have splits of one size, there are more than 16 of a source where the tables are longer.
    """
    splits = 16 + max(spark.read.parquet(f"{d}/{n}.parquet").count() for n in ("part", "customer", "lineitem")) // X.ROWS_DEALT
    t = triples(spark, d).withColumn("start", F.pmod(F.xxhash64("s"), F.lit(splits))).repartition(splits, "src", "start")
    short = lambda c: F.when(F.col(c).rlike(f"^{RELATIONS}[a-z_]+$"), F.concat(F.lit("rel:"), F.substring_index(c, "/", -1))).when(
        F.col(c) == RDF_TYPE, F.lit("a")).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
    text = F.concat(F.lit('"""'), F.replace(F.replace("o", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"""'))
    obj = F.when(F.col("o_kind") == "literal", text).otherwise(short("o"))
    subject = Window.partitionBy("src", "start", "s").orderBy("p", "o", "g")
    t = t.withColumns({"first": F.row_number().over(subject) == 1, "last": F.lead("p").over(subject).isNull()})
    value = F.concat(F.when(F.col("first"), F.concat(F.lit("<"), "s", F.lit("> "))).otherwise("  "), short("p"), F.lit(" "), obj,
                     F.when(F.col("last"), F.lit(" .")).otherwise(" ;"))
    row = F.row_number().over(Window.partitionBy("src", "start").orderBy("s", "p", "o", "g"))
    body = t.select(F.col("src").alias("file"), "start", row.cast("long").alias("row"), value.alias("value"))
    head = body.select("file").distinct().selectExpr("file", "-1L AS start", "0L AS row", f"'@prefix rel: <{RELATIONS}> .' AS value")
    return head.unionByName(body)


def scan_turtle(spark, d):
    """Triples go out as Turtle files and are parsed back into a set."""
    return turtle.parse_turtle(turtle_lines(spark, d))[0].select("s", "p", "o", "o_kind", "src")


def skip_disabled(spark, d):
    t = triples(spark, d)
    off = t.filter(F.col("p") == LOCATED).select("src").distinct()
    return T.skip_disabled(t, off).groupBy("src", "p").agg(F.count(F.lit(1)).alias("n"))


def toggled(spark, d):
    """Sources with places are disabled; sources with labels are toggled."""
    t = triples(spark, d)
    return T.toggle_disabled(t.filter(F.col("p") == LOCATED).select("src"), t.filter(F.col("p") == RDFS_LABEL).select("src"))


def append_new(spark, d):
    """Customers' and parts' triples are known; all triples arrive once more."""
    t = triples(spark, d)
    new = T.new_triples(t.filter(F.col("src").isin("customer", "part")), t)
    return new.groupBy("src").agg(F.count(F.lit(1)).alias("added"))


def write_lines(spark, d):
    return triples(spark, d).select(T.ntriples_line(named=True).alias("line"))


def drop_graph(spark, d):
    t = triples(spark, d)
    named = T.drop_graph(t, X.SUPPLIER_GRAPH).select(F.lit("named").alias("dropped"), "s", "p", "o")
    default = T.drop_graph(t).select(F.lit("default").alias("dropped"), "s", "p", "o")
    return named.unionByName(default)


def _bodies(spark, d):
    """One JSON answer per class: entity and label, where the label is missing for long ones."""
    t = triples(spark, d)
    e = G.join_patterns(G.pattern(t, "?entity", RDF_TYPE, "?class"), G.pattern(t, "?entity", RDFS_LABEL, "?label"))
    cell = lambda c, k: F.struct(F.lit(k).alias("type"), c.alias("value"))
    short = F.length("label") <= 11
    b = F.when(short, F.to_json(F.struct(cell(F.col("entity"), "uri").alias("entity"), cell(F.col("label"), "literal").alias("label")))).otherwise(
        F.to_json(F.struct(cell(F.col("entity"), "uri").alias("entity"))))
    return e.select("class", F.concat(F.lit('{"head":{"vars":["entity","label"]},"results":{"bindings":['), b, F.lit("]}}")).alias("body"))


def bindings_rows(spark, d):
    return bindings.bindings_to_rows(_bodies(spark, d), ["entity", "label"], ["class"])


def export_csv(spark, d):
    t = triples(spark, d)
    rows = t.select("s", F.when(F.col("o_kind") == "literal", F.concat(F.col("o"), F.lit(', "'), F.col("src"), F.lit('"')))
                    .otherwise(F.col("o")).alias("o"))
    return rows.select(bindings.csv_line(["s", "o"]).alias("line"))


def source_catalog(spark, d):
    return T.source_catalog(triples(spark, d))


def bgp_match(spark, d):
    """A constant predicate, and a variable used twice."""
    t = triples(spark, d)
    edges = G.pattern(t, "?source", LOCATED, "?target")
    loops = G.pattern(t.withColumn("s", F.when(F.col("p") == TREATS, F.col("o")).otherwise(F.col("s"))), "?x", TREATS, "?x")
    return edges.unionByName(loops.select(F.col("x").alias("source"), F.col("x").alias("target")))


def typed_entities(spark, d):
    return G.typed_entities(triples(spark, d), TYPES + "Disease")


def construct(spark, d):
    t = triples(spark, d)
    sol = G.join_patterns(G.pattern(t, "?a", TREATS, "?b"), G.pattern(t, "?a", LOCATED, "?c"))
    rel = F.lit(RELATIONS + "available_in")
    return G.construct(sol, [(F.col("b"), rel, F.col("c")), (F.col("a"), F.lit(RELATIONS + "serves"), F.col("c"))])


def describe(spark, d):
    t = triples(spark, d)
    return G.describe(t, G.pattern(t, "?s", RDF_TYPE, TYPES + "Procedure"))


def query_source(spark, d):
    t = triples(spark, d)
    count = lambda df, n: df.groupBy(F.lit(n).alias("route"), "p").agg(F.count(F.lit(1)).alias("n"))
    return (
        count(G.query_source(t, src="part"), "file")
        .unionByName(count(G.query_source(t, graph=X.SUPPLIER_GRAPH), "graph"))
        .unionByName(count(G.query_source(t), "all"))
    )


def federated_union(spark, d):
    t = triples(spark, d)
    one = lambda src: G.pattern(G.query_source(t, src=src), "?entity", RDF_TYPE, "?type").select("type")
    return G.federated_union([one(s) for s in ("region", "nation", "supplier", "customer", "part")])


def federated_ask(spark, d):
    t = triples(spark, d)
    one = lambda s: G.ask(G.pattern(G.query_source(t, src=s), "?a", LOCATED, "?b")).select(F.lit(s).alias("src"), "result")
    return G.federated_ask([one(s) for s in ("region", "nation", "supplier", "customer", "part", "lineitem")])


def ask(spark, d):
    t = triples(spark, d)
    yes = G.ask(G.pattern(t, "?a", TREATS, "?b")).withColumn("query", F.lit("treats"))
    no = G.ask(G.pattern(t, "?a", RELATIONS + "rules_out", "?b")).withColumn("query", F.lit("rules_out"))
    return yes.unionByName(no)


def values_in(spark, d):
    t = G.values_in(triples(spark, d), "p", LABEL_PREDICATES)
    return G.pattern(t, "?entity", "?label_predicate", "?label")


QUERIES = {
    "scan_triples": scan_triples,
    "scan_turtle": scan_turtle,
    "skip_disabled_files": skip_disabled,
    "toggle_disabled": toggled,
    "append_new_triples": append_new,
    "write_triples": write_lines,
    "drop_graph": drop_graph,
    "bindings_to_rows": bindings_rows,
    "export_result_csv": export_csv,
    "source_catalog": source_catalog,
    "bgp_match": bgp_match,
    "entities_with_labels": lambda s, d: G.entities_with_labels(triples(s, d)),
    "count_by_type": lambda s, d: G.count_by_type(triples(s, d)),
    "typed_entities": typed_entities,
    "relation_edges": lambda s, d: G.relation_edges(triples(s, d)),
    "label_search": lambda s, d: G.label_search(triples(s, d), "ring"),
    "two_hop_labels": lambda s, d: G.two_hop_labels(triples(s, d), TREATS),
    "triple_count": lambda s, d: G.triple_count(triples(s, d)),
    "predicate_usage": lambda s, d: G.predicate_usage(triples(s, d)),
    "ask": ask,
    "construct": construct,
    "describe": describe,
    "query_source": query_source,
    "federated_union": federated_union,
    "federated_ask": federated_ask,
    "store_entity_stats": lambda s, d: G.store_entity_stats(triples(s, d)),
    "store_sample_entities": lambda s, d: G.sample_entities(triples(s, d)),
    "kg_stats": lambda s, d: G.kg_stats(triples(s, d)),
    "values_in_filter": values_in,
}

_line = ("'<' || s || '> <' || p || '> ' || CASE WHEN o_kind = 'uri' THEN '<' || o || '>' ELSE '\"' || "
         "replace(replace(o, '\\', '\\\\'), '\"', '\\\"') || '\"' END || ' ' || "
         "CASE WHEN g IS NOT NULL THEN '<' || g || '> ' ELSE '' END || '.'")
_csv_o = "CASE WHEN o_kind = 'literal' THEN o || ', \"' || src || '\"' ELSE o END"

ORACLES = {
    "scan_turtle": CTE("SELECT DISTINCT s, p, o, o_kind, src FROM triples"),
    "scan_triples": CTE("SELECT DISTINCT s, p, o, o_kind, g, src FROM triples"),
    "skip_disabled_files": CTE(
        f"SELECT src, p, count(*) AS n FROM triples WHERE src NOT IN (SELECT src FROM triples WHERE p = '{LOCATED}') GROUP BY src, p"),
    "toggle_disabled": CTE(f"""SELECT src FROM (SELECT DISTINCT src FROM triples WHERE p = '{LOCATED}' UNION ALL SELECT DISTINCT src FROM triples WHERE p = '{RDFS_LABEL}') x
GROUP BY src HAVING count(*) = 1"""),
    "append_new_triples": CTE("""SELECT src, count(*) AS added FROM (SELECT DISTINCT s, p, o, src FROM triples) t
WHERE NOT EXISTS (SELECT 1 FROM triples k WHERE k.src IN ('customer', 'part') AND k.s = t.s AND k.p = t.p AND k.o = t.o) GROUP BY src"""),
    "write_triples": CTE(f"SELECT {_line} AS line FROM triples"),
    "drop_graph": CTE(f"""SELECT 'named' AS dropped, s, p, o FROM triples WHERE g IS DISTINCT FROM '{X.SUPPLIER_GRAPH}'
UNION ALL SELECT 'default', s, p, o FROM triples WHERE g IS NOT NULL"""),
    "bindings_to_rows": CTE(f"""SELECT a.o AS class, a.s AS entity, CASE WHEN length(b.o) <= 11 THEN b.o END AS label
FROM triples a JOIN triples b ON a.s = b.s AND a.p = '{RDF_TYPE}' AND b.p = '{RDFS_LABEL}'"""),
    "export_result_csv": CTE(f"""SELECT s || ',' || CASE WHEN v LIKE '%,%' OR v LIKE '%"%' THEN '"' || replace(v, '"', '""') || '"' ELSE v END AS line
FROM (SELECT s, {_csv_o} AS v FROM triples) t"""),
    "source_catalog": CTE("SELECT src, count(*) AS triple_count FROM triples GROUP BY src"),
    "bgp_match": CTE(f"""SELECT s AS source, o AS target FROM triples WHERE p = '{LOCATED}'
UNION ALL SELECT o, o FROM triples WHERE p = '{TREATS}'"""),
    "entities_with_labels": CTE(f"SELECT s AS entity, o AS label FROM triples WHERE p = '{RDFS_LABEL}' ORDER BY o, s LIMIT 50"),
    "count_by_type": CTE(f"SELECT o AS type, count(*) AS count FROM triples WHERE p = '{RDF_TYPE}' GROUP BY o"),
    "typed_entities": CTE(f"""SELECT a.s AS entity, b.o AS label FROM triples a JOIN triples b ON a.s = b.s
WHERE a.p = '{RDF_TYPE}' AND a.o = '{TYPES}Disease' AND b.p = '{RDFS_LABEL}'"""),
    "relation_edges": CTE(f"""SELECT e.s AS source, e.p AS relation, e.o AS target, a.o AS source_label, b.o AS target_label
FROM triples e LEFT JOIN triples a ON a.s = e.s AND a.p = '{RDFS_LABEL}' LEFT JOIN triples b ON b.s = e.o AND b.p = '{RDFS_LABEL}'
WHERE starts_with(e.p, '{RELATIONS}')"""),
    "label_search": CTE(f"""SELECT a.s AS entity, a.o AS label, b.o AS type FROM triples a
LEFT JOIN triples b ON a.s = b.s AND b.p = '{RDF_TYPE}' WHERE a.p = '{RDFS_LABEL}' AND contains(lower(a.o), 'ring')"""),
    "two_hop_labels": CTE(f"""SELECT e.s AS source, e.o AS target, a.o AS source_label, b.o AS target_label
FROM triples e JOIN triples a ON a.s = e.s AND a.p = '{RDFS_LABEL}' JOIN triples b ON b.s = e.o AND b.p = '{RDFS_LABEL}' WHERE e.p = '{TREATS}'"""),
    "triple_count": CTE("SELECT g, count(*) AS n FROM triples GROUP BY g"),
    "predicate_usage": CTE("SELECT p AS predicate, count(*) AS usage FROM triples GROUP BY p"),
    "ask": CTE(f"""SELECT 'treats' AS query, count(*) > 0 AS result FROM triples WHERE p = '{TREATS}'
UNION ALL SELECT 'rules_out', count(*) > 0 FROM triples WHERE p = '{RELATIONS}rules_out'"""),
    "construct": CTE(f"""SELECT DISTINCT a.o AS subject, '{RELATIONS}available_in' AS predicate, b.o AS object
FROM triples a JOIN triples b ON a.s = b.s AND a.p = '{TREATS}' AND b.p = '{LOCATED}'
UNION SELECT DISTINCT a.s, '{RELATIONS}serves', b.o FROM triples a JOIN triples b ON a.s = b.s AND a.p = '{TREATS}' AND b.p = '{LOCATED}'"""),
    "describe": CTE(f"SELECT DISTINCT s, p, o FROM triples WHERE s IN (SELECT s FROM triples WHERE p = '{RDF_TYPE}' AND o = '{TYPES}Procedure')"),
    "query_source": CTE(f"""SELECT 'file' AS route, p, count(*) AS n FROM triples WHERE src = 'part' GROUP BY p
UNION ALL SELECT 'graph', p, count(*) FROM triples WHERE g = '{X.SUPPLIER_GRAPH}' GROUP BY p
UNION ALL SELECT 'all', p, count(*) FROM triples GROUP BY p"""),
    "federated_union": CTE(f"SELECT DISTINCT o AS type FROM triples WHERE p = '{RDF_TYPE}' AND src IN ('region', 'nation', 'supplier', 'customer', 'part')"),
    "federated_ask": CTE(f"""SELECT src, coalesce(bool_or(p = '{LOCATED}'), false) AS result FROM triples
WHERE src IN ('region', 'nation', 'supplier', 'customer', 'part', 'lineitem') GROUP BY src"""),
    "store_entity_stats": CTE(f"""SELECT 'triples' AS stat, '' AS name, count(*) AS value FROM triples
UNION ALL SELECT 'predicates', '', count(DISTINCT p) FROM triples
UNION ALL SELECT 'labels', '', count(*) FROM triples WHERE p = '{RDFS_LABEL}'
UNION ALL SELECT 'class', {sql_local('o')}, count(DISTINCT s) FROM triples WHERE p = '{RDF_TYPE}' GROUP BY o
UNION ALL SELECT 'entities_summed', '', count(*) FROM (SELECT DISTINCT s, o FROM triples WHERE p = '{RDF_TYPE}') x
UNION ALL SELECT 'entities', '', count(DISTINCT s) FROM triples WHERE p = '{RDF_TYPE}'"""),
    "store_sample_entities": CTE(f"""SELECT b.o AS label, min({sql_local('a.o')}) AS type FROM triples a JOIN triples b ON a.s = b.s
AND a.p = '{RDF_TYPE}' AND b.p = '{RDFS_LABEL}' GROUP BY b.o ORDER BY b.o LIMIT 20"""),
    "kg_stats": CTE(f"""SELECT 'triples' AS stat, '' AS name, count(*) AS value FROM (SELECT DISTINCT s, p, o FROM triples) x
UNION ALL SELECT 'entities', '', count(DISTINCT s) FROM triples
UNION ALL SELECT 'labels', '', count(*) FROM (SELECT DISTINCT s, o FROM triples WHERE p IN {sql_in(LABEL_PREDICATES)}) y
UNION ALL SELECT 'type', name, count(*) FROM (SELECT {sql_map(CANONICAL_KG_TYPES)}[lower({sql_local('o')})] AS name
  FROM (SELECT DISTINCT s, o FROM triples WHERE p = '{RDF_TYPE}') z) t WHERE name IS NOT NULL GROUP BY name"""),
    "values_in_filter": CTE(f"SELECT s AS entity, p AS label_predicate, o AS label FROM triples WHERE p IN {sql_in(LABEL_PREDICATES)}"),
}
