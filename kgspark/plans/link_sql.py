"""SQL for linking: the matching-blocks ratio of all pairs of texts, as a recursive query.

A count of common characters rules out most pairs; what is left is cut at its longest common piece (leftmost in the
query, then in the label), and both sides again, until nothing is common. That is difflib's rule for labels of
fewer than 200 characters; the test tables have no longer ones.
"""

from __future__ import annotations

from kgspark.plans import sqlkit as Q
from kgspark.sources import fixtures as X
from kgspark.vocab import ALLOWED_KG_TYPES, CANONICAL_KG_TYPES, DEFAULT_ENTITY_TYPE, ENTITY_TYPES, LABEL_PREDICATES, RDF_TYPE

# What a normalised text can hold.
CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "
_counts = lambda c: ", ".join(f"(length({c}) - length(replace({c}, '{x}', '')))::SMALLINT AS c{i}" for i, x in enumerate(CHARACTERS))
_common = " + ".join(f"least(x.c{i}, y.c{i})" for i in range(len(CHARACTERS)))
# 1000 * length of the longest piece of a that b has, less its place in a; the leftmost of equal ones is the largest.
_piece = lambda a, b: (f"list_max(list_transform(range(1, length({a}) + 1), lambda i: len(list_filter(range(1, length({a}) - i + 2), "
                       f"lambda n: contains({b}, substr({a}, i, n)))) * 1000 - i))")
_allowed = "CASE entity_type " + " ".join(f"WHEN '{k}' THEN {Q.array(v)}" for k, v in ALLOWED_KG_TYPES.items()) + " END"

GRAPH = {
    "lab": f"SELECT DISTINCT s AS uri, o AS label, {Q.normalized('o')} AS norm FROM triples WHERE p IN {Q.names(LABEL_PREDICATES)}",
    "kinds": f"SELECT s AS uri, list(DISTINCT o) AS classes FROM triples WHERE p = '{RDF_TYPE}' GROUP BY s",
    "named": f"""SELECT lab.*, list_transform(list_sort(coalesce(classes, [])), lambda x: {Q.local_name('x')}) AS type_names
FROM lab LEFT JOIN kinds USING (uri)""",
}


def matched(pairs: str) -> dict[str, str]:
    """CTEs that end in ``ratios(q, norm, ratio)`` for the pairs (q, norm) of a query; pairs without a common character are left out."""
    return {
        "near": pairs,
        "work": f"""SELECT q, norm, q AS a, norm AS b, {_piece('q', 'norm')} AS code FROM near WHERE q <> ''
UNION ALL SELECT q, norm, a, b, code FROM (SELECT q, norm, p.a AS a, p.b AS b, {_piece('p.a', 'p.b')} AS code FROM (
  SELECT q, norm, unnest([{{'a': substr(a, 1, i - 1), 'b': substr(b, 1, j - 1)}}, {{'a': substr(a, i + n), 'b': substr(b, j + n)}}]) AS p FROM (
    SELECT *, instr(b, substr(a, i, n)) AS j FROM (SELECT *, (code + 999) // 1000 AS n, (code + 999) // 1000 * 1000 - code AS i FROM work WHERE code > 0))) WHERE p.a <> '' AND p.b <> '')""",
        "ratios": "SELECT q, norm, 2.0::DOUBLE * sum((code + 999) // 1000) / (length(q) + length(norm)) AS ratio FROM work WHERE code > 0 GROUP BY q, norm",
    }


def scored(texts: str, t: float, contain: bool = True) -> dict[str, str]:
    """CTEs that end in ``best(q, uri, kg_label, type_names, score)``: each entity's best label for the texts (q) of a query."""
    share = "least(length(q), length(norm))::DOUBLE / greatest(length(q), length(norm))"
    held = f"CASE WHEN norm <> '' AND (contains(q, norm) OR contains(norm, q)) THEN greatest(ratio, {share}) ELSE ratio END" if contain else "ratio"
    far = t / (2 - t)
    return {
        **GRAPH,
        "qs": texts,
        "qc": f"SELECT q, length(q) AS n, {_counts('q')} FROM qs",
        "lc": f"SELECT norm, length(norm) AS m, {_counts('norm')} FROM (SELECT DISTINCT norm FROM lab)",
        **matched(f"SELECT q, norm FROM qc x JOIN lc y ON n >= m * {far} - 1e-6 AND m >= n * {far} - 1e-6 WHERE q <> norm AND 2 * ({_common}) >= {t} * (n + m) - 1e-6"),
        "scores": f"""SELECT * FROM (SELECT q, norm, {held} AS score FROM ratios) WHERE score >= {t}
UNION ALL SELECT q, norm, 1.0::DOUBLE FROM qs JOIN (SELECT DISTINCT norm FROM lab) ON q = norm""",
        "best": """SELECT q, uri, label AS kg_label, type_names, score FROM scores JOIN named USING (norm)
QUALIFY row_number() OVER (PARTITION BY q, uri ORDER BY score DESC, label) = 1""",
    }


_TEXTS = f"SELECT DISTINCT {Q.normalized('text')} AS q FROM mentions"
_top = lambda k, keys="q": f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, uri) AS rank FROM best QUALIFY rank <= {k}"
_flat = "CAST(rank AS INTEGER) AS rank, uri AS kg_uri, kg_label, type_names[1] AS kg_type, round(score, 6) AS score"
_status = "CASE WHEN s >= 0.95 THEN 'exact_match' WHEN s >= 0.7 THEN 'similar_match' WHEN s IS NOT NULL THEN 'low_match' ELSE 'not_found' END"


def _matches(k: int, t: float, source: str = "mentions") -> str:
    ctes = scored(f"SELECT DISTINCT {Q.normalized('text')} AS q FROM {source}", t)
    return X.with_tables("triples", source, extra={**ctes, "top": _top(k)}, body=f"""
SELECT text, {_flat} FROM (SELECT DISTINCT text, {Q.normalized('text')} AS q FROM {source}) m JOIN top USING (q)""")


def _fallback(source: str) -> dict[str, str]:
    """CTEs that end in ``top``: matches that fit the type of (q, entity_type) of a query, else any."""
    return {
        **scored(_TEXTS, 0.6),
        "wanted": source,
        "judged": f"SELECT w.q, entity_type, uri, kg_label, type_names, score, {_allowed} IS NULL OR list_has_any(type_names, {_allowed}) AS fits FROM wanted w JOIN best USING (q)",
        "top": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, entity_type ORDER BY fits DESC, score DESC, uri) AS rank,
  bool_or(fits) OVER (PARTITION BY q, entity_type) AS typed FROM judged) WHERE rank <= 5 AND (fits OR NOT typed)""",
        "first": "SELECT q, entity_type, max(score) AS s, count(*) AS n FROM top GROUP BY ALL",
    }


_WANTED = f"SELECT DISTINCT {Q.normalized('text')} AS q, entity_type FROM mentions"
_kind = f"CASE WHEN entity_type IN {Q.names(ENTITY_TYPES)} THEN entity_type ELSE '{DEFAULT_ENTITY_TYPE}' END"
_percent = "CAST(CAST(round_even(s * 100, 0) AS BIGINT) AS VARCHAR) || '%)'"
_search_type = f"coalesce(list_filter(list_transform(type_names, lambda x: {Q.mapping(CANONICAL_KG_TYPES)}[lower(x)]), lambda x: x IS NOT NULL)[1], 'unknown')"

ORACLES = {
    "score_pairs": X.with_tables("mentions", extra={
        "pairs": f"SELECT DISTINCT text, normalized_form, {Q.normalized('text')} AS q, {Q.normalized('normalized_form')} AS norm FROM mentions WHERE normalized_form IS NOT NULL",
        **matched("SELECT DISTINCT q, norm FROM pairs WHERE norm <> ''")}, body="""
SELECT text, normalized_form, CASE WHEN p.q = p.norm THEN 1.0::DOUBLE ELSE coalesce(ratio, 0) END AS score FROM pairs p LEFT JOIN ratios r ON r.q = p.q AND r.norm = p.norm"""),
    "candidate_pairs": X.with_tables("triples", "mentions", extra=scored(_TEXTS, 0.7), body="""
SELECT q, array_to_string(type_names, '|') AS sig, round(max(score), 6) AS score FROM best GROUP BY ALL"""),
    "find_matches": _matches(5, 0.7),
    "find_matches_incremental": _matches(5, 0.7),
    "find_similar": _matches(5, 0.5),
    "kg_evidence": _matches(10, 0.5, "pending_entities"),
    "validate_untyped": X.with_tables("triples", "mentions", extra={**scored(_TEXTS, 0.6), "top": _top(1),
        "told": f"SELECT text, score AS s, kg_label FROM (SELECT DISTINCT text, {Q.normalized('text')} AS q FROM mentions) LEFT JOIN top USING (q)"}, body=f"""
SELECT text, {_status} AS validation_status, coalesce(s >= 0.7, false) AS is_validated,
  CASE WHEN s IS NULL THEN 'Not found in Knowledge Graph' ELSE CASE WHEN s >= 0.95 THEN 'Exact' WHEN s >= 0.7 THEN 'Similar' ELSE 'Low' END
  || ' match: ''' || kg_label || ''' (' || {_percent} END AS validation_notes FROM told"""),
    "link_typed_fallback": X.with_tables("triples", "mentions", extra=_fallback(_WANTED), body=f"""
SELECT text, entity_type, {_flat} FROM (SELECT DISTINCT text, {Q.normalized('text')} AS q, entity_type FROM mentions) m JOIN top USING (q, entity_type)"""),
    "link_status_counts": X.with_tables("triples", "mentions", extra={**_fallback(_WANTED),
        "told": f"SELECT {_status} AS v FROM (SELECT s FROM (SELECT {Q.normalized('text')} AS q, entity_type FROM mentions) LEFT JOIN first USING (q, entity_type))"}, body="""
SELECT count(*) AS total, count(*) FILTER (v = 'exact_match') AS exact_matches, count(*) FILTER (v = 'similar_match') AS similar_matches,
  count(*) FILTER (v = 'low_match') AS low_matches, count(*) FILTER (v = 'not_found') AS not_found FROM told"""),
    "link_for_joint_extract": X.with_tables("triples", "mentions", extra={
        "m": f"SELECT text, {_kind} AS entity_type, coalesce(confidence, 0.8::DOUBLE) AS confidence, {Q.normalized('text')} AS q FROM (SELECT DISTINCT text, entity_type, CASE WHEN source <> 'llm' THEN confidence END AS confidence FROM mentions)",
        **_fallback("SELECT DISTINCT q, entity_type FROM m")}, body=f"""
SELECT text, entity_type, confidence, {_status} AS validation_status, CAST(coalesce(n, 0) AS INTEGER) AS n_matches FROM m LEFT JOIN first USING (q, entity_type)"""),
    "search_fuzzy": X.with_tables("triples", "mentions", extra={
        "asked": f"SELECT DISTINCT text AS query, {Q.normalized('text')} AS q FROM mentions WHERE {Q.normalized('text')} <> ''",
        **scored("SELECT DISTINCT q FROM asked", 0.5, False),
        "held": """SELECT query, q, uri, min(label) AS kg_label, any_value(type_names) AS type_names FROM asked JOIN named ON norm <> '' AND (contains(norm, q) OR contains(q, norm)) GROUP BY ALL""",
        "first": f"""SELECT query, uri, kg_label, type_names, CASE WHEN q = norm THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * least(length(q), length(norm)) / (length(q) + length(norm)) END AS score
FROM (SELECT *, {Q.normalized('kg_label')} AS norm FROM held)""",
        "short": "SELECT * FROM asked WHERE query NOT IN (SELECT query FROM first GROUP BY query HAVING count(*) >= 10)",
        "both_kinds": """SELECT * FROM first UNION ALL SELECT query, uri, b.kg_label, b.type_names, b.score FROM short JOIN best b USING (q) ANTI JOIN first USING (query, uri)"""}, body=f"""
SELECT query, uri, kg_label, {_search_type} AS type, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, uri) AS rank FROM both_kinds) WHERE rank <= 10"""),
    "relation_coverage": X.with_tables("triples", "relations", extra={
        "ends": "SELECT source_entity AS text FROM relations UNION SELECT target_entity FROM relations",
        **scored(f"SELECT DISTINCT {Q.normalized('text')} AS q FROM ends", 0.7), "top": _top(5),
        "counts": f"SELECT text, count(uri)::INTEGER AS n FROM (SELECT text, {Q.normalized('text')} AS q FROM ends) LEFT JOIN top USING (q) GROUP BY text"}, body="""
SELECT id, n_source, n_target, round(CASE WHEN n = 0 THEN 0.5::DOUBLE + 0.3::DOUBLE WHEN n < 3 THEN 0.5::DOUBLE + 0.3::DOUBLE * 0.5::DOUBLE ELSE greatest(0.3::DOUBLE, 0.6::DOUBLE - 0.1::DOUBLE * n) END, 6) AS score
FROM (SELECT relation_id AS id, a.n AS n_source, b.n AS n_target, least(a.n, b.n) AS n FROM relations JOIN counts a ON a.text = source_entity JOIN counts b ON b.text = target_entity)"""),
}
