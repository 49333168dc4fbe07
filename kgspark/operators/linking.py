"""Linking mention texts to the entities of a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from kgspark.functions.labels import allowed_kg_types, canonical_kg_type, type_compatible
from kgspark.functions.text import normalize_text
from kgspark.operators.grams import GramIndex
from kgspark.operators.similarity import LONG_LABEL, best_pairs, contained_pairs, link_scores, score_pairs
from kgspark.schemas import MATCHES
from kgspark.vocab import DEFAULT_ENTITY_TYPE, ENTITY_TYPES, EXACT_AT, LABEL_PREDICATES, LOW_AT, RDF_TYPE, SIMILAR_AT, TYPES


def _signature(type_names: Column) -> Column:
    return F.array_join(type_names, "|")


def _label_groups(labels: DataFrame, k: int) -> DataFrame:
    """(norm, sig) with its k first entities by URI: the others tie with them and rank behind."""
    each = labels.withColumn("sig", _signature(F.col("type_names"))).groupBy("norm", "sig", "uri").agg(
        F.min("label").alias("label"), F.first("type_names").alias("type_names")
    )
    w = Window.partitionBy("norm", "sig").orderBy("uri")
    return each.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k)


def score_candidates(
    texts: DataFrame, labels: DataFrame, k: int, threshold: float, contain: bool = True,
    filed: DataFrame | None = None, asked: DataFrame | None = None,
) -> DataFrame:
    """``q, uri, kg_label, type_names, score``: every entity that can be among the best k of a text.

    ``texts(q)`` are normalised; ``labels`` is a label table. A text is scored once, whatever
    number of mentions carry it and whatever entity types they have: the best k are kept per
    class signature, which covers any later filter on classes. ``filed`` and ``asked`` are entries of
    a stored index.
    """
    groups = _label_groups(labels, k)
    heads = groups.groupBy("norm", "sig").agg(F.min("uri").alias("rep"))
    pairs = best_pairs(texts.select("q").distinct(), heads, k, threshold, contain, filed=filed, asked=asked)
    found = pairs.join(groups, ["norm", "sig"])
    best = F.min_by(F.struct("label", "score"), F.struct((-F.col("score")).alias("a"), F.col("label").alias("b")))
    return found.groupBy("q", "uri").agg(best.alias("b"), F.first("type_names").alias("type_names")).select(
        "q", "uri", F.col("b.label").alias("kg_label"), "type_names", F.col("b.score").alias("score")
    )


def top_k(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Best k by score, ties by URI. Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("uri"))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def as_matches(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """At most k ranked rows per key as one array, best first."""
    item = F.struct(
        "rank", F.col("uri").alias("kg_uri"), "kg_label", F.get("type_names", F.lit(0)).alias("kg_type"),
        F.col("score").alias("similarity_score"),
    )
    ordered = F.array_sort(F.collect_list(item))
    plain = F.transform(ordered, lambda x: F.struct(
        x["kg_uri"].alias("kg_uri"), x["kg_label"].alias("kg_label"), x["kg_type"].alias("kg_type"),
        x["similarity_score"].alias("similarity_score")))
    return ranked.groupBy(*keys).agg(plain.cast(MATCHES).alias("kg_matches"))


def attach(mentions: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    none = F.array().cast(MATCHES)
    return mentions.join(matches, keys, "left").withColumn("kg_matches", F.coalesce("kg_matches", none)).drop("q")


def find_matches(
    mentions: DataFrame, labels: DataFrame, k: int = 5, min_score: float = SIMILAR_AT, typed: bool = False
) -> DataFrame:
    """Mentions with ``kg_matches``; ``typed`` keeps only entities that fit ``entity_type``."""
    m = mentions.withColumn("q", normalize_text(F.col("text")))
    candidates = score_candidates(m.select("q"), labels, k, min_score)
    if not typed:
        return attach(m, as_matches(top_k(candidates, ["q"], k), ["q"]), ["q"])
    wanted = m.select("q", "entity_type").distinct().join(candidates, "q")
    fits = wanted.filter(type_compatible(F.col("type_names"), F.col("entity_type")))
    keys = ["q", "entity_type"]
    return attach(m, as_matches(top_k(fits, keys, k), keys), keys)


def link_typed_fallback(mentions: DataFrame, labels: DataFrame, k: int = 5, min_score: float = LOW_AT) -> DataFrame:
    """Matches that fit the type; where there is none, matches of any type."""
    m = mentions.withColumn("q", normalize_text(F.col("text")))
    candidates = score_candidates(m.select("q"), labels, k, min_score)
    keys = ["q", "entity_type"]
    wanted = m.select(*keys).distinct().join(candidates, "q").withColumn(
        "fits", type_compatible(F.col("type_names"), F.col("entity_type"))
    )
    w = Window.partitionBy(*keys).orderBy(F.desc("fits"), F.desc("score"), F.asc("uri"))
    ranked = wanted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    typed = F.max("fits").over(Window.partitionBy(*keys))
    kept = ranked.withColumn("typed", typed).filter(F.col("fits") | ~F.col("typed"))
    return attach(m, as_matches(kept, keys), keys)


def link_joint_extract(entities: DataFrame, labels: DataFrame) -> DataFrame:
    """Unknown types become finding and a missing confidence 0.8 before linking."""
    t = F.col("entity_type")
    ready = entities.withColumns(
        {
            "entity_type": F.when(t.isin(ENTITY_TYPES), t).otherwise(F.lit(DEFAULT_ENTITY_TYPE)),
            "confidence": F.coalesce("confidence", F.lit(0.8)),
        }
    )
    return validate_status(link_typed_fallback(ready, labels))


def find_matches_exact(mentions: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """Ranked rows of entities with a label equal to the normalised text."""
    m = mentions.select("text").distinct().withColumn("norm", normalize_text(F.col("text")))
    groups = _label_groups(labels, k)
    hits = m.join(groups.drop("n"), "norm").groupBy("text", "uri").agg(
        F.min("label").alias("kg_label"), F.first("type_names").alias("type_names")
    ).withColumn("score", F.lit(1.0))
    return top_k(hits, ["text"], k)


def contains_search(
    texts: DataFrame, triples: DataFrame, k: int = 5, min_score: float = SIMILAR_AT, typed: bool = False,
    index: GramIndex | None = None,
) -> DataFrame:
    """Search of an external source: labels whose lower-case form contains the lower-case text.

    ``texts(text[, entity_type])``. Every hit is scored, then the best label per entity and the
    best k entities are kept. ``index`` is a maintained index of the lower-case labels.
    """
    names = triples.filter(F.col("p").isin(LABEL_PREDICATES)).select(
        F.col("s").alias("uri"), F.col("o").alias("label")
    ).distinct().withColumns({"hay": F.lower("label"), "norm": normalize_text(F.col("label"))})
    keys = ["text", "entity_type"] if typed else ["text"]
    wanted = texts.select(*keys).distinct().withColumn("needle", F.lower("text")).withColumn(
        "q", normalize_text(F.col("text"))
    ).filter("q <> ''")
    needles = wanted.select("needle").distinct()
    pairs = index.contained_pairs(needles) if index else contained_pairs(needles, names.select("hay").distinct())
    hits = wanted.join(pairs, "needle").join(names, "hay")
    classes = triples.filter(F.col("p") == RDF_TYPE).select(F.col("s").alias("uri"), F.col("o").alias("class")).distinct()
    hits = hits.withColumn("score", link_closed_form(F.col("q"), F.col("norm")))
    hits = hits.filter(F.col("score") >= min_score)
    if typed:
        allowed = F.transform(allowed_kg_types(F.col("entity_type")), lambda t: F.concat(F.lit(TYPES), t))
        hits = hits.join(classes, "uri", "left").filter(
            allowed.isNull() | F.coalesce(F.array_contains(allowed, F.col("class")), F.lit(False)))
    else:
        hits = hits.join(classes, "uri", "left")
    kind = F.array(F.substring_index(F.substring_index(F.col("class"), "#", -1), "/", -1))
    order = F.struct((-F.col("score")).alias("a"), F.col("label").alias("b"), F.coalesce("class", F.lit("")).alias("c"))
    best = hits.groupBy(*keys, "uri").agg(F.min_by(F.struct(F.col("label").alias("kg_label"), kind.alias("type_names"), "score"), order).alias("b"))
    return top_k(best.select(*keys, "uri", "b.*"), keys, k)


def link_closed_form(query: Column, label: Column) -> Column:
    """Score of two texts of which one contains the other.

    The ratio is then 2 * shorter / (sum of lengths), as long as the label is under 200
    characters; above, difflib itself is asked.
    """
    a, b = F.length(query), F.length(label)
    short = F.when(query == label, F.lit(1.0)).when((a > 0) & (b > 0), 2.0 * F.least(a, b) / (a + b)).otherwise(F.lit(0.0))
    closed = (b < LONG_LABEL) & (F.contains(label, query) | F.contains(query, label))
    asked = link_scores(F.when(~closed, query), F.when(~closed, label))
    return F.when(closed, short).otherwise(asked)


def merge_matches(parts: list[DataFrame], keys: list[str], k: int = 5) -> DataFrame:
    """Ranked rows of several sources: best score per entity, the earlier source on ties; best k."""
    tagged = [p.drop("rank").withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    rows = reduce(lambda a, b: a.unionByName(b), tagged)
    order = F.struct((-F.col("score")).alias("a"), F.col("part").alias("b"))
    best = rows.groupBy(*keys, "uri").agg(F.min_by(F.struct("kg_label", "type_names", "score"), order).alias("b"))
    return top_k(best.select(*keys, "uri", "b.*"), keys, k)


def backend_filter(triples: DataFrame, internal: list[str], backend: str = "all") -> DataFrame:
    """Triples of the sources that take part: ``all``, ``internal`` or ``external``."""
    if backend not in ("all", "internal", "external"):
        raise ValueError(f"unknown backend {backend!r}")
    if backend == "all":
        return triples
    is_internal = F.col("src").isin(internal)
    return triples.filter(is_internal if backend == "internal" else ~is_internal)


def validate_status(linked: DataFrame) -> DataFrame:
    """Status, flag and note from the best match."""
    best = F.get("kg_matches", F.lit(0))
    score, label = best["similarity_score"], best["kg_label"]
    percent = F.format_string("%.0f", F.bround(score * 100, 0))
    note = lambda kind: F.concat(F.lit(f"{kind} match: '"), label, F.lit("' ("), percent, F.lit("%)"))
    return linked.withColumns(
        {
            "validation_status": F.when(score >= EXACT_AT, F.lit("exact_match")).when(score >= SIMILAR_AT, F.lit("similar_match"))
            .when(score.isNotNull(), F.lit("low_match")).otherwise(F.lit("not_found")),
            "is_validated": F.coalesce(score >= SIMILAR_AT, F.lit(False)),
            "validation_notes": F.when(score >= EXACT_AT, note("Exact")).when(score >= SIMILAR_AT, note("Similar"))
            .when(score.isNotNull(), note("Low")).otherwise(F.lit("Not found in Knowledge Graph")),
        }
    )


def validate_untyped(mentions: DataFrame, labels: DataFrame) -> DataFrame:
    return validate_status(find_matches(mentions, labels, min_score=LOW_AT))


def find_similar(mentions: DataFrame, labels: DataFrame) -> DataFrame:
    """Up to five entities from 0.5 on; the entity type plays no part."""
    return find_matches(mentions, labels, k=5, min_score=0.5)


def validation_summary(validated: DataFrame) -> DataFrame:
    s = F.col("validation_status")
    return validated.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(s == v).alias(n) for n, v in (("exact_matches", "exact_match"), ("similar_matches", "similar_match"),
                                                   ("low_matches", "low_match"), ("not_found", "not_found"))],
    )


def best_match_columns(validated: DataFrame) -> DataFrame:
    """Mentions that are not exact, with the best match's score, label and URI."""
    best = F.get("kg_matches", F.lit(0))
    return validated.filter("validation_status <> 'exact_match'").withColumns(
        {
            "similarity_score": best["similarity_score"],
            "matched_kg_label": best["kg_label"],
            "matched_kg_uri": best["kg_uri"],
        }
    ).drop("kg_matches")


def _search_type(type_names: Column) -> Column:
    known = F.filter(F.transform(type_names, lambda t: canonical_kg_type(t)), lambda t: t.isNotNull())
    return F.coalesce(F.get(known, F.lit(0)), F.lit("unknown"))


def search_containment(queries: DataFrame, labels: DataFrame, index: GramIndex | None = None) -> DataFrame:
    """Entities with a label that contains the query or lies inside it: first such label by name.

    ``queries(query)``; texts that are empty once normalised find nothing. ``index`` is a maintained index of
    the normalised labels; labels inside a query are looked up in the grams of the queries, which are the batch.
    """
    wanted = queries.select("query").distinct().withColumn("q", normalize_text(F.col("query"))).filter("q <> ''")
    texts = wanted.select("q").distinct()
    norms = labels.select("norm").filter("norm <> ''").distinct()
    needles = texts.withColumnRenamed("q", "needle")
    inside = index.contained_pairs(needles) if index else contained_pairs(needles, norms.withColumnRenamed("norm", "hay"))
    around = contained_pairs(norms.withColumnRenamed("norm", "needle"), texts.withColumnRenamed("q", "hay"))
    pairs = inside.select(F.col("needle").alias("q"), F.col("hay").alias("norm")).unionByName(
        around.select(F.col("hay").alias("q"), F.col("needle").alias("norm"))
    ).distinct()
    hits = pairs.join(labels, "norm").groupBy("q", "uri").agg(
        F.min(F.struct("label", "norm")).alias("l"), F.first("type_names").alias("type_names")
    )
    q, norm = F.col("q"), F.col("l.norm")
    a, b = F.length(q), F.length(norm)
    closed = F.when(q == norm, F.lit(1.0)).otherwise(2.0 * F.least(a, b) / (a + b))
    is_closed = (b < LONG_LABEL) | (q == norm)
    score = F.when(is_closed, closed).otherwise(score_pairs(F.when(~is_closed, q), F.when(~is_closed, norm)))
    scored = hits.select("q", "uri", F.col("l.label").alias("kg_label"), _search_type(F.col("type_names")).alias("type"), score.alias("score"))
    return wanted.join(scored, "q")


def search_entities(queries: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """Containment hits, filled up with entities of ratio 0.5 and more where they are fewer than k.

    An entity found by ratio shows its closest label. A query has fewer than k containment hits
    when it is filled up, so 2k candidates leave k others.
    """
    first = search_containment(queries, labels)
    counts = first.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    short = (
        queries.select("query").distinct().withColumn("q", normalize_text(F.col("query"))).filter("q <> ''")
        .join(counts.filter(F.col("n") >= k), "query", "left_anti")
    )
    near = score_candidates(short.select("q"), labels, 2 * k, 0.5, contain=False)
    fuzzy = (
        short.join(near, "q").join(first.select("query", "uri"), ["query", "uri"], "left_anti")
        .select("query", "q", "uri", "kg_label", _search_type(F.col("type_names")).alias("type"), "score")
    )
    both = first.select("query", "q", "uri", "kg_label", "type", "score").unionByName(fuzzy)
    return top_k(both, ["query"], k).drop("q")
