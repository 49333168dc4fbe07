"""Graph patterns over a triple table.

A pattern's terms are constants or variables (``"?name"``). Every function returns a DataFrame
whose columns are the variables, so patterns combine with ordinary joins, filters and aggregates
and Catalyst orders them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kgspark.functions.labels import canonical_kg_type, local_name_slash_first
from kgspark.operators.grams import GramIndex
from kgspark.vocab import LABEL_PREDICATES, RDF_TYPE, RDFS_LABEL, RELATIONS


def pattern(triples: DataFrame, s: str, p: str, o: str) -> DataFrame:
    """One triple pattern: constants filter, variables project, a repeated variable is an equality."""
    first: dict[str, str] = {}
    for col, term in (("s", s), ("p", p), ("o", o)):
        if not term.startswith("?"):
            triples = triples.filter(F.col(col) == F.lit(term))
        elif term in first:
            triples = triples.filter(F.col(col) == F.col(first[term]))
        else:
            first[term] = col
    return triples.select(*[F.col(c).alias(v[1:]) for v, c in first.items()])


def _shared(a: DataFrame, b: DataFrame) -> list[str]:
    keys = [c for c in a.columns if c in b.columns]
    if not keys:
        raise ValueError("patterns share no variable; joining them would be a cross product")
    return keys


def join_patterns(*parts: DataFrame) -> DataFrame:
    """Natural join on the shared variables."""
    return reduce(lambda a, b: a.join(b, _shared(a, b)), parts)


def optional(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, _shared(left, right), "left")


def values_in(triples: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return triples.filter(F.col(column).isin(allowed))


def values_in_table(triples: DataFrame, column: str, allowed: DataFrame) -> DataFrame:
    """The same for a list kept in a table with one column of the same name."""
    return triples.join(allowed.select(column), column, "left_semi")


def query_source(triples: DataFrame, src: str | None = None, graph: str | None = None) -> DataFrame:
    """One file, one named graph, or everything."""
    if src is not None:
        triples = triples.filter(F.col("src") == src)
    if graph is not None:
        triples = triples.filter(F.col("g") == graph)
    return triples


def ask(solutions: DataFrame) -> DataFrame:
    """One row: is there any solution. The limit lets the scan stop at the first one."""
    return solutions.limit(1).agg((F.count(F.lit(1)) > 0).alias("result"))


def construct(solutions: DataFrame, templates: list[tuple[Column, Column, Column]]) -> DataFrame:
    """Solutions to triples; incomplete ones are dropped and equal ones kept once."""
    made = F.array(*[F.struct(s.alias("subject"), p.alias("predicate"), o.alias("object"))
                     for s, p, o in templates])
    return (
        solutions.select(F.explode(made).alias("t")).select("t.*")
        .dropna().distinct()
    )


def describe(triples: DataFrame, resources: DataFrame) -> DataFrame:
    """All triples whose subject is one of ``resources(s)``."""
    return triples.join(resources.select("s"), "s", "left_semi").select("s", "p", "o").distinct()


def federated_union(results: list[DataFrame]) -> DataFrame:
    """The same query's rows from several sources, equal rows once; columns of the first source."""
    columns = results[0].columns
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results)
    return merged.select(*columns).distinct()


def federated_ask(results: list[DataFrame]) -> DataFrame:
    """One answer row per source."""
    return reduce(lambda a, b: a.unionByName(b), results)


# Ready-made queries


def entities_with_labels(triples: DataFrame, limit: int | None = 50) -> DataFrame:
    out = pattern(triples, "?entity", RDFS_LABEL, "?label").orderBy("label", "entity")
    return out.limit(limit) if limit else out


def count_by_type(triples: DataFrame) -> DataFrame:
    return pattern(triples, "?entity", RDF_TYPE, "?type").groupBy("type").agg(F.count(F.lit(1)).alias("count"))


def typed_entities(triples: DataFrame, class_uri: str) -> DataFrame:
    return join_patterns(
        pattern(triples, "?entity", RDF_TYPE, class_uri), pattern(triples, "?entity", RDFS_LABEL, "?label")
    )


def relation_edges(triples: DataFrame, namespace: str = RELATIONS) -> DataFrame:
    edges = pattern(triples.filter(F.col("p").startswith(namespace)), "?source", "?relation", "?target")
    out = optional(edges, pattern(triples, "?source", RDFS_LABEL, "?source_label"))
    return optional(out, pattern(triples, "?target", RDFS_LABEL, "?target_label"))


def label_search(triples: DataFrame, token: str, index: GramIndex | None = None) -> DataFrame:
    """Labels that contain a lower-case token, with the entity's types where it has any.

    With a maintained index of the lower-case labels only the labels that it finds are joined.
    """
    names = pattern(triples, "?entity", RDFS_LABEL, "?label")
    if index and token:
        found = index.contained_pairs(triples.sparkSession.createDataFrame([(token,)], "needle string")).select("hay").distinct()
        hits = names.join(found, F.lower("label") == F.col("hay"), "left_semi")
    else:
        hits = names.filter(F.lower("label").contains(token))
    return optional(hits, pattern(triples, "?entity", RDF_TYPE, "?type"))


def two_hop_labels(triples: DataFrame, predicate: str) -> DataFrame:
    return join_patterns(
        pattern(triples, "?source", predicate, "?target"),
        pattern(triples, "?source", RDFS_LABEL, "?source_label"),
        pattern(triples, "?target", RDFS_LABEL, "?target_label"),
    )


def triple_count(triples: DataFrame) -> DataFrame:
    return triples.groupBy("g").agg(F.count(F.lit(1)).alias("n"))


def predicate_usage(triples: DataFrame) -> DataFrame:
    return triples.groupBy(F.col("p").alias("predicate")).agg(F.count(F.lit(1)).alias("usage"))


def store_entity_stats(triples: DataFrame) -> DataFrame:
    """Totals of a store and its entities per class, as ``(stat, name, value)`` rows.

    One pass reduces the triples to distinct (class, subject) pairs and predicate counts; the sum
    over classes counts a subject with two classes twice, the distinct total counts it once.
    """
    typed = pattern(triples, "?entity", RDF_TYPE, "?type").distinct()
    name = local_name_slash_first(F.col("type"))
    per_class = typed.groupBy("type").agg(F.count(F.lit(1)).alias("value"))
    per_predicate = triples.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    overall = per_predicate.agg(
        total.alias("triples"),
        F.count(F.lit(1)).alias("predicates"),
        F.coalesce(F.sum(F.when(F.col("p") == RDFS_LABEL, F.col("n"))), F.lit(0)).alias("labels"),
    )
    stat = lambda n, c: F.struct(F.lit(n).alias("stat"), F.lit("").alias("name"), F.col(c).alias("value"))
    rows = overall.select(F.explode(F.array(stat("triples", "triples"), stat("predicates", "predicates"),
                                            stat("labels", "labels"))).alias("x")).select("x.*")
    classes = per_class.select(F.lit("class").alias("stat"), name.alias("name"), "value")
    summed = per_class.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value")).select(
        F.lit("entities_summed").alias("stat"), F.lit("").alias("name"), "value")
    distinct = typed.select("entity").distinct().agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("entities").alias("stat"), F.lit("").alias("name"), "value")
    return rows.unionByName(classes).unionByName(summed).unionByName(distinct)


def sample_entities(triples: DataFrame, n: int = 20) -> DataFrame:
    """n labels with one class each, in label order."""
    both = join_patterns(
        pattern(triples, "?entity", RDFS_LABEL, "?label"), pattern(triples, "?entity", RDF_TYPE, "?type")
    )
    named = both.select("label", local_name_slash_first(F.col("type")).alias("type"))
    return named.groupBy("label").agg(F.min("type").alias("type")).orderBy("label").limit(n)


def kg_stats(triples: DataFrame, strict_local_name: bool = False) -> DataFrame:
    """Distinct triples, entities and labels, and entities per canonical type.

    An entity with two classes of the same canonical type counts twice. A class name is what
    follows the last "/"; ``strict_local_name`` also cuts at "#".
    """
    distinct = triples.select("s", "p", "o").distinct()
    per_subject = distinct.groupBy("s").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(F.when(F.col("p").isin(LABEL_PREDICATES), F.col("o"))).alias("labels"),
    )
    totals = per_subject.agg(
        F.sum("n").alias("triples"), F.count(F.lit(1)).alias("entities"), F.sum("labels").alias("labels")
    )
    stat = lambda n: F.struct(F.lit(n).alias("stat"), F.lit("").alias("name"), F.col(n).alias("value"))
    rows = totals.select(F.explode(F.array(stat("triples"), stat("entities"), stat("labels"))).alias("x")).select("x.*")
    cut = F.substring_index("o", "/", -1)
    if strict_local_name:
        cut = F.substring_index(cut, "#", -1)
    types = (
        distinct.filter(F.col("p") == RDF_TYPE)
        .groupBy(canonical_kg_type(cut).alias("name")).agg(F.count(F.lit(1)).alias("value"))
        .filter("name IS NOT NULL")
        .select(F.lit("type").alias("stat"), "name", "value")
    )
    return rows.unionByName(types)
