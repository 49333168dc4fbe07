"""Growing the graph from approved entities and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kgspark.functions.labels import class_name, link_predicate, lookup, mint_uri
from kgspark.vocab import PARENT_CLASSES, RDF_TYPE, RDFS_LABEL, RDFS_SUBCLASS, RELATIONS, SKOS_PREF, TYPES

TRIPLE = ["s", "p", "o", "o_kind"]


def _triple(s: Column, p, o: Column, kind: str = "uri") -> Column:
    p = F.lit(p) if isinstance(p, str) else p
    return F.struct(s.alias("s"), p.alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))


def _class_triples(uri: Column, entity_type: Column) -> list[Column]:
    """The class of an entity, and the class's parent where it has one."""
    cls = class_name(entity_type)
    class_uri = F.concat(F.lit(TYPES), cls)
    parent = F.concat(F.lit(TYPES), lookup(PARENT_CLASSES, cls))
    return [_triple(uri, RDF_TYPE, class_uri), _triple(class_uri, RDFS_SUBCLASS, parent)]


def _emit(rows: DataFrame, made: list[Column]) -> DataFrame:
    return rows.select(F.explode(F.array(*made)).alias("t")).select("t.*").dropna().dropDuplicates(["s", "p", "o", "o_kind"])


def emit_entity_triples(entities: DataFrame, stamp_ms: int) -> DataFrame:
    """Triples of approved entities: label, class, parent class, preferred label, optional link.

    ``entities(text, entity_type[, normalized_form, uri, link_to_uri, link_type])``.
    """
    has = lambda c: F.col(c) if c in entities.columns else F.lit(None).cast("string")
    given = has("uri")
    uri = F.when(given != "", given).otherwise(mint_uri(F.col("text"), stamp_ms, F.col("entity_type")))
    form = F.when(has("normalized_form") != "", has("normalized_form"))
    linked = F.when((has("link_to_uri") != "") & (has("link_type") != ""), has("link_to_uri"))
    return _emit(entities, [
        _triple(uri, RDFS_LABEL, F.col("text"), "literal"),
        *_class_triples(uri, F.col("entity_type")),
        _triple(uri, SKOS_PREF, form, "literal"),
        _triple(uri, link_predicate(has("link_type")), linked),
    ])


def get_or_create_uris(texts: DataFrame, triples: DataFrame, stamp_ms: int) -> DataFrame:
    """``text, uri, created``: the first subject with exactly that label, else a new URI."""
    known = triples.filter((F.col("p") == RDFS_LABEL) & (F.col("o_kind") == "literal")).groupBy(
        F.col("o").alias("text")).agg(F.min("s").alias("known"))
    return texts.select("text").distinct().join(known, "text", "left").select(
        "text", F.coalesce("known", mint_uri(F.col("text"), stamp_ms)).alias("uri"), F.col("known").isNull().alias("created"))


def emit_relation_triples(relations: DataFrame, triples: DataFrame, stamp_ms: int, order: str = "id") -> DataFrame:
    """Relation triples, and triples of the ends that the graph lacks.

    A new end gets the type of its first use: earlier relations first, sources before targets.
    """
    side = lambda i, which: F.struct(F.col(f"{which}_entity").alias("text"), F.col(f"{which}_type").alias("entity_type"), F.lit(i).alias("side"))
    ends = relations.select(order, F.explode(F.array(side(0, "source"), side(1, "target"))).alias("x")).select(order, "x.*")
    first = ends.groupBy("text").agg(F.min_by("entity_type", F.struct(order, "side")).alias("entity_type"))
    uris = get_or_create_uris(first, triples, stamp_ms)
    made = first.join(uris.filter("created"), "text")
    new = _emit(made, [_triple(F.col("uri"), RDFS_LABEL, F.col("text"), "literal"),
                       *_class_triples(F.col("uri"), F.col("entity_type"))])
    # Each distinct relation once, so that the joins on the end texts are small.
    distinct = relations.select("source_entity", "relation_type", "target_entity").distinct()
    named = distinct.join(uris.select(F.col("text").alias("source_entity"), F.col("uri").alias("s")), "source_entity").join(
        uris.select(F.col("text").alias("target_entity"), F.col("uri").alias("o")), "target_entity")
    edges = named.select("s", F.concat(F.lit(RELATIONS), F.col("relation_type")).alias("p"), "o", F.lit("uri").alias("o_kind"))
    return edges.unionByName(new).dropDuplicates(["s", "p", "o", "o_kind"])


def approve_entities(
    pending: DataFrame, reviews: DataFrame, approved: DataFrame, stamp_ms: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Triples of ``approved(id[, link_to_uri, link_type])``, and both tables without those rows.

    An id that is approved more than once takes one of its approvals: the one with the smallest link, then link type;
    given ones come before missing ones.
    """
    ids = approved.select("id").distinct()
    extra = [c for c in ("link_to_uri", "link_type") if c in approved.columns]
    order = [f for c in extra for f in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]
    links = approved.groupBy("id").agg(F.min(F.struct(*order)).alias("x")).select("id", *[f"x.{c}" for c in extra]) if extra else ids
    rows = pending.join(links, "id")
    form = F.coalesce(F.when(F.col("normalized_text") != "", F.col("normalized_text")), F.col("text"))
    made = emit_entity_triples(rows.withColumn("normalized_form", form), stamp_ms)
    left = pending.join(ids, "id", "left_anti")
    left_reviews = reviews.join(ids.select(F.col("id").alias("pending_entity_id")), "pending_entity_id", "left_anti")
    return made, left, left_reviews


RELATION_FIELDS = ["source_entity", "source_type", "relation_type", "target_entity", "target_type"]


def approve_relations(
    pending: DataFrame, approved: DataFrame, triples: DataFrame, stamp_ms: int
) -> tuple[DataFrame, DataFrame]:
    """Triples of the approved rows and the table with them marked approved.

    ``approved(id)`` may carry any of the five relation columns as overrides.
    """
    over = [c for c in RELATION_FIELDS if c in approved.columns]
    a = approved.select("id", *[F.col(c).alias(f"new_{c}") for c in over], F.lit(True).alias("chosen"))
    joined = pending.join(a, "id", "left")
    final = joined.withColumns({c: F.coalesce(F.when(F.col(f"new_{c}") != "", F.col(f"new_{c}")), F.col(c)) for c in over})
    final = final.withColumn("status", F.when(F.col("chosen"), F.lit("approved")).otherwise(F.col("status")))
    made = emit_relation_triples(final.filter("chosen"), triples, stamp_ms)
    return made, final.select(*pending.columns)
