"""Registered queries: entity dictionary and linking."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.functions.numbers import round_to
from kgspark.functions.text import normalize_text
from kgspark.operators import dictionary as D, graph as G, linking as K, similarity as S
from kgspark.operators.grams import GramIndex
from kgspark.operators.incremental import MatchStore
from kgspark.plans import sqlkit as Q
from kgspark.schemas import MATCHES
from kgspark.sources import fixtures as X
from kgspark.sources.versions import shared_folder, written
from kgspark.vocab import ALLOWED_KG_TYPES, CANONICAL_KG_TYPES, LABEL_PREDICATES, RDF_TYPE, RDFS_LABEL

INTERNAL = ["region", "nation", "part", "classes"]


def labels(spark, d):
    return D.label_table(D.build_entity_dict(X.triples(spark, d)))


def flat(linked, *keys):
    """Matches as one row each, for comparison and reading."""
    rows = linked.select(*keys, F.posexplode("kg_matches").alias("rank", "m"))
    return rows.select(*keys, (F.col("rank") + 1).alias("rank"), "m.kg_uri", "m.kg_label", "m.kg_type",
                       round_to("m.similarity_score", 6).alias("score"))


def entity_dict(spark, d):
    join = lambda c: F.array_join(c, "|").alias(c)
    return D.build_entity_dict(X.triples(spark, d)).select("uri", join("labels"), join("norm_labels"), join("types"))


def _texts(spark, d):
    return X.mentions(spark, d).select("text").distinct()


def candidate_pairs(spark, d):
    """Best text pairs per class signature, before they are tied to entities."""
    lab = labels(spark, d)
    groups = K._label_groups(lab, 5).groupBy("norm", "sig").agg(F.min("uri").alias("rep"))
    q = _texts(spark, d).select(normalize_text(F.col("text")).alias("q")).distinct()
    pairs = S.best_pairs(q, groups, 5, 0.7)
    best = pairs.groupBy("q", "sig").agg(F.max("score").alias("score"))
    return best.select("q", "sig", round_to("score", 6).alias("score"))


def score_pairs(spark, d):
    """Ratio of each mention's text to its normal form."""
    m = X.mentions(spark, d).filter("normalized_form IS NOT NULL").select("text", "normalized_form").distinct()
    a, b = normalize_text(F.col("text")), normalize_text(F.col("normalized_form"))
    return m.select("text", "normalized_form", S.score_pairs(a, b).alias("score"))


def find_matches(spark, d):
    return flat(K.find_matches(_texts(spark, d), labels(spark, d)), "text")


def exact(spark, d):
    r = K.find_matches_exact(_texts(spark, d), labels(spark, d))
    return r.select("text", "uri", "kg_label", "score", "rank")


def contains(spark, d):
    r = K.contains_search(_texts(spark, d), X.triples(spark, d), min_score=0.7)
    return r.select("text", "uri", "kg_label", F.get("type_names", F.lit(0)).alias("kg_type"), round_to("score", 6).alias("score"), "rank")


def contains_typed(spark, d):
    texts = X.mentions(spark, d).select("text", "entity_type")
    r = K.contains_search(texts, X.triples(spark, d), min_score=0.7, typed=True)
    return r.select("text", "entity_type", "uri", "kg_label", round_to("score", 6).alias("score"), "rank")


def _maintained(spark, hays, early, withdrawn):
    """An index of all of hays, after batches: those of one kind, all, some withdrawn, one batch repeated, some back."""
    index = GramIndex(spark, shared_folder(spark))
    hays = written(hays)  # every batch reads them
    index.apply("early", hays.filter(early).select("hay"))
    index.apply("all", hays.select("hay"))
    index.apply("withdrawn", hays.limit(0).select("hay"), hays.filter(withdrawn).select("hay"))
    index.apply("all", hays.select("hay"))
    index.apply("back", hays.filter(withdrawn).select("hay"))
    return index


def _lower_labels(spark, d):
    t = X.triples(spark, d).filter(F.col("p").isin(LABEL_PREDICATES))
    return t.select("src", F.lower("o").alias("hay")).distinct()


def contains_indexed(spark, d):
    """The search of ``contains`` in a maintained index."""
    index = _maintained(spark, _lower_labels(spark, d), "src = 'part'", "src in ('nation', 'supplier')")
    r = K.contains_search(_texts(spark, d), X.triples(spark, d), min_score=0.7, index=index)
    return r.select("text", "uri", "kg_label", F.get("type_names", F.lit(0)).alias("kg_type"), round_to("score", 6).alias("score"), "rank")


def label_search_indexed(spark, d):
    index = _maintained(spark, _lower_labels(spark, d), "src = 'nation'", "hay like '%bolt%'")
    return G.label_search(X.triples(spark, d), "ring", index)


def search_containment_indexed(spark, d):
    names = written(labels(spark, d))  # filed, looked up in the queries and joined to the pairs
    hays = names.select(F.col("norm").alias("hay"), "type_names").distinct()
    index = _maintained(spark, hays, "array_contains(type_names, 'Finding')", "length(hay) % 3 = 0")
    r = K.search_containment(_queries(spark, d), names, index)
    return r.select("query", "uri", "kg_label", "type", round_to("score", 6).alias("score"))


def find_matches_incremental(spark, d):
    """The matches of ``find_matches`` after four batches of texts and labels, one of them with labels withdrawn."""
    store = MatchStore(spark, shared_folder(spark))
    texts, names = _texts(spark, d), labels(spark, d)
    old = F.length("text") % 2 == 0
    parts = F.col("uri").contains("/part/")
    store.apply("parts", texts.filter(old), names.filter(parts))
    store.apply("rest", texts.limit(0), names)
    store.apply("withdrawn", texts.limit(0), names.limit(0), names.filter(parts & (F.length("label") % 4 == 0)))
    store.apply("texts", texts, names)
    return flat(store.find_matches(texts), "text")


def merged(spark, d):
    texts = _texts(spark, d)
    local = K.find_matches_exact(texts, labels(spark, d))
    cols = ["text", "uri", "kg_label", "type_names", "score", "rank"]
    external = K.contains_search(texts, X.triples(spark, d), min_score=0.7)
    r = K.merge_matches([local.select(cols), external.select(cols)], ["text"])
    return r.select("text", "uri", round_to("score", 6).alias("score"), "rank")


def backends(spark, d):
    t = X.triples(spark, d)
    parts = [K.backend_filter(t, INTERNAL, b).groupBy(F.lit(b).alias("backend"), "src").agg(F.count(F.lit(1)).alias("n"))
             for b in ("all", "internal", "external")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def linked(spark, d):
    return K.validate_status(K.link_typed_fallback(X.mentions(spark, d), labels(spark, d)))


def typed_fallback(spark, d):
    m = X.mentions(spark, d).select("text", "entity_type").distinct()
    return flat(K.link_typed_fallback(m, labels(spark, d)), "text", "entity_type")


def _scored(spark, d):
    """Mentions whose only match is their normal form, with the stored score."""
    one = F.array(F.struct(F.concat(F.lit("u:"), F.col("text")).alias("kg_uri"), F.col("text").alias("kg_label"),
                           F.lit("Finding").alias("kg_type"), F.col("similarity_score")))
    p = X.pending_entities(spark, d)
    m = F.when(F.col("similarity_score") >= 0.6, one).otherwise(F.array()).cast(MATCHES)
    return K.validate_status(p.select("id", "text", "similarity_score").withColumn("kg_matches", F.coalesce(m, F.array().cast(MATCHES))))


def status(spark, d):
    return _scored(spark, d).select("id", "validation_status", "is_validated",
                                    F.regexp_replace("validation_notes", r" \(.*\)$", "").alias("note"))


def summary(spark, d):
    return K.validation_summary(_scored(spark, d).drop("similarity_score"))


def best_columns(spark, d):
    return K.best_match_columns(_scored(spark, d).drop("similarity_score")).select(
        "id", "similarity_score", "matched_kg_label", "matched_kg_uri")


def untyped(spark, d):
    v = K.validate_untyped(_texts(spark, d), labels(spark, d))
    return v.select("text", "validation_status", "is_validated", "validation_notes")


def _queries(spark, d):
    return X.table(spark, d, "part").select(F.col("p_name").alias("query")).distinct()


def search_containment(spark, d):
    r = K.search_containment(_queries(spark, d), labels(spark, d))
    return r.select("query", "uri", "kg_label", "type", round_to("score", 6).alias("score"))


def search_fuzzy(spark, d):
    texts = X.mentions(spark, d).select(F.col("text").alias("query"))
    r = K.search_entities(texts, labels(spark, d))
    return r.select("query", "uri", "kg_label", "type", round_to("score", 6).alias("score"), "rank")


def similar(spark, d):
    return flat(K.find_similar(_texts(spark, d), labels(spark, d)), "text")


def joint(spark, d):
    m = X.mentions(spark, d).select("text", "entity_type", F.when(F.col("source") != "llm", F.col("confidence")).alias("confidence")).distinct()
    v = K.link_joint_extract(m, labels(spark, d))
    return v.select("text", "entity_type", "confidence", "validation_status", F.size("kg_matches").alias("n_matches"))


QUERIES = {
    "build_entity_dict": entity_dict,
    "score_pairs": score_pairs,
    "candidate_pairs": candidate_pairs,
    "find_matches": find_matches,
    "find_matches_exact": exact,
    "contains_search": contains,
    "contains_search_typed": contains_typed,
    "contains_search_indexed": contains_indexed,
    "label_search_indexed": label_search_indexed,
    "search_containment_indexed": search_containment_indexed,
    "find_matches_incremental": find_matches_incremental,
    "merge_matches": merged,
    "backend_filter": backends,
    "link_typed_fallback": typed_fallback,
    "validate_status": status,
    "validate_untyped": untyped,
    "validation_summary": summary,
    "link_status_counts": lambda s, d: K.validation_summary(linked(s, d)),
    "search_containment": search_containment,
    "search_fuzzy": search_fuzzy,
    "find_similar": similar,
    "best_match_columns": best_columns,
    "link_for_joint_extract": joint,
}

_lab = f"SELECT DISTINCT s AS uri, o AS label, lower(o) AS hay, {Q.normalized('o')} AS norm FROM triples WHERE p IN {Q.names(LABEL_PREDICATES)}"
_cls = f"SELECT DISTINCT s AS uri, o AS class FROM triples WHERE p = '{RDF_TYPE}'"
_rank = lambda keys: f"CAST(row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, uri) AS INTEGER)"
_closed = "CASE WHEN q = norm THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * least(length(q), length(norm)) / (length(q) + length(norm)) END"
_exact = f"""SELECT text, uri, min(label) AS kg_label, 1.0::DOUBLE AS score FROM
(SELECT DISTINCT text, {Q.normalized('text')} AS norm FROM mentions) m JOIN lab USING (norm) GROUP BY text, uri"""
_hits = f"""SELECT text, uri, label, class, {_closed} AS score FROM
(SELECT DISTINCT text, lower(text) AS needle, {Q.normalized('text')} AS q FROM mentions) m JOIN lab ON contains(hay, needle)
LEFT JOIN cls USING (uri) WHERE q <> ''"""
_best = "SELECT text, uri, arg_min(label, [lpad(CAST(CAST(round((1 - score) * 1e9) AS BIGINT) AS VARCHAR), 10, '0'), label]) AS kg_label, min(class) AS class, max(score) AS score FROM hits WHERE score >= 0.7 GROUP BY text, uri"
_allowed = "CASE entity_type " + " ".join(
    f"WHEN '{k}' THEN {Q.array(['http://example.org/medical/types/' + x for x in v])}" for k, v in ALLOWED_KG_TYPES.items()) + " END"
_scores = "SELECT id, text, CASE WHEN similarity_score >= 0.6 THEN similarity_score END AS x FROM pending_entities"
_status = "CASE WHEN x >= 0.95 THEN 'exact_match' WHEN x >= 0.7 THEN 'similar_match' WHEN x IS NOT NULL THEN 'low_match' ELSE 'not_found' END"
_contains = {"lab": _lab, "cls": _cls, "hits": _hits}

ORACLES = {
    "build_entity_dict": X.with_tables("triples", body=f"""SELECT uri, coalesce(array_to_string(list_sort(l), '|'), '') AS labels,
  coalesce(array_to_string(list_transform(list_sort(l), lambda x: {Q.normalized('x')}), '|'), '') AS norm_labels,
  coalesce(array_to_string(list_sort(t), '|'), '') AS types
FROM (SELECT s AS uri, list(DISTINCT o) FILTER (p IN {Q.names(LABEL_PREDICATES)}) AS l, list(DISTINCT o) FILTER (p = '{RDF_TYPE}') AS t FROM triples GROUP BY s) x"""),
    "find_matches_exact": X.with_tables("triples", "mentions", extra={"lab": _lab}, body=f"""SELECT * FROM (SELECT text, uri, kg_label, score,
{_rank('text')} AS rank FROM ({_exact}) e) r WHERE rank <= 5"""),
    "contains_search": X.with_tables("triples", "mentions", extra=_contains, body=f"""SELECT * FROM (SELECT text, uri, kg_label,
{Q.local_name('class')} AS kg_type, round(score, 6) AS score, {_rank('text')} AS rank FROM ({_best}) b) r WHERE rank <= 5"""),
    "contains_search_typed": X.with_tables("triples", "mentions", extra={**_contains, "wanted": "SELECT DISTINCT text, entity_type FROM mentions"}, body=f"""
SELECT * FROM (SELECT text, entity_type, uri, kg_label, round(score, 6) AS score, {_rank('text, entity_type')} AS rank FROM (
  SELECT text, entity_type, uri, arg_min(label, [lpad(CAST(CAST(round((1 - score) * 1e9) AS BIGINT) AS VARCHAR), 10, '0'), label]) AS kg_label, max(score) AS score
  FROM hits JOIN wanted USING (text) WHERE score >= 0.7 AND ({_allowed} IS NULL OR list_contains({_allowed}, class)) GROUP BY text, entity_type, uri) b) r WHERE rank <= 5"""),
    "merge_matches": X.with_tables("triples", "mentions", extra={**_contains, "parts": f"""
SELECT text, uri, score FROM (SELECT text, uri, score, {_rank('text')} AS rank FROM ({_exact}) e) a WHERE rank <= 5
UNION ALL SELECT text, uri, score FROM (SELECT text, uri, score, {_rank('text')} AS rank FROM ({_best}) b) c WHERE rank <= 5"""}, body=f"""
SELECT text, uri, round(score, 6) AS score, rank FROM (SELECT text, uri, score, {_rank('text')} AS rank
FROM (SELECT text, uri, max(score) AS score FROM parts GROUP BY text, uri) m) r WHERE rank <= 5"""),
    "backend_filter": X.with_tables("triples", body=f"""SELECT 'all' AS backend, src, count(*) AS n FROM triples GROUP BY src
UNION ALL SELECT 'internal', src, count(*) FROM triples WHERE src IN {Q.names(INTERNAL)} GROUP BY src
UNION ALL SELECT 'external', src, count(*) FROM triples WHERE src NOT IN {Q.names(INTERNAL)} GROUP BY src"""),
    "validate_status": X.with_tables("pending_entities", body=f"""SELECT id, {_status} AS validation_status, coalesce(x >= 0.7, false) AS is_validated,
CASE WHEN x >= 0.95 THEN 'Exact match: ''' || text || '''' WHEN x >= 0.7 THEN 'Similar match: ''' || text || ''''
  WHEN x IS NOT NULL THEN 'Low match: ''' || text || '''' ELSE 'Not found in Knowledge Graph' END AS note FROM ({_scores}) s"""),
    "validation_summary": X.with_tables("pending_entities", body=f"""SELECT count(*) AS total, count(*) FILTER (v = 'exact_match') AS exact_matches,
count(*) FILTER (v = 'similar_match') AS similar_matches, count(*) FILTER (v = 'low_match') AS low_matches,
count(*) FILTER (v = 'not_found') AS not_found FROM (SELECT {_status} AS v FROM ({_scores}) s) t"""),
    "search_containment": X.with_tables("triples", extra={"lab": _lab, "cls": f"SELECT s AS uri, {Q.mapping(CANONICAL_KG_TYPES)}[lower({Q.local_name('o')})] AS type FROM triples WHERE p = '{RDF_TYPE}'",
        "hits": f"""SELECT query, q, uri, min(label) AS kg_label FROM (SELECT DISTINCT p_name AS query, {Q.normalized('p_name')} AS q FROM part) m
JOIN lab ON norm <> '' AND (contains(norm, q) OR contains(q, norm)) GROUP BY query, q, uri"""}, body=f"""
SELECT query, uri, kg_label, coalesce(type, 'unknown') AS type, round({_closed}, 6) AS score
FROM (SELECT *, {Q.normalized('kg_label')} AS norm FROM hits) h LEFT JOIN cls USING (uri)"""),
    "label_search_indexed": X.with_tables("triples", body=f"""SELECT a.s AS entity, a.o AS label, b.o AS type FROM triples a
LEFT JOIN triples b ON a.s = b.s AND b.p = '{RDF_TYPE}' WHERE a.p = '{RDFS_LABEL}' AND contains(lower(a.o), 'ring')"""),
    "best_match_columns": X.with_tables("pending_entities", body=f"""SELECT id, x AS similarity_score, CASE WHEN x IS NOT NULL THEN text END AS matched_kg_label,
CASE WHEN x IS NOT NULL THEN 'u:' || text END AS matched_kg_uri FROM ({_scores}) s WHERE x IS NULL OR x < 0.95"""),
}
ORACLES["contains_search_indexed"] = ORACLES["contains_search"]
ORACLES["search_containment_indexed"] = ORACLES["search_containment"]
