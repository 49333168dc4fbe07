"""Registered queries: staging tables and graph growth."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from kgspark.operators import growth as W, staging as S
from kgspark.operators.pages import PageIndex
from kgspark.plans import sqlkit as Q
from kgspark.sources import fixtures as X
from kgspark.vocab import (
    BASE, CLASS_NAMES, DEFAULT_LINK_PREDICATE, LINK_PREDICATES, PARENT_CLASSES, RDF_TYPE, RDFS_LABEL, RDFS_SUBCLASS,
    RELATIONS, SKOS_PREF, TYPES,
)

STAMP = 1700000000000
LINKS = ["sameAs", "relatedTo", "narrowerThan", "broaderThan", "closeMatch", "exactMatch", "other"]


def staged_relations(spark, d):
    """The relation table: returned items approved, accepted ones rejected, the rest pending."""
    r = X.relations(spark, d)
    status = F.when(F.col("flag") == "R", F.lit("approved")).when(F.col("flag") == "A", F.lit("rejected")).otherwise(F.lit("pending"))
    return r.select(F.col("relation_id").alias("id"), "source_entity", "source_type", "relation_type", "target_entity", "target_type",
                    "confidence", "context", "source", status.alias("status"), "created_at")


def _incoming(spark, d):
    """All mentions arrive; those of one source are in the table already."""
    p = X.pending_entities(spark, d)
    return p.drop("status"), p.filter("source = 'bert'")


def entities(spark, d):
    new, table = _incoming(spark, d)
    return S.stage_entities(new, table, ["id"]).select("id", "text", "entity_type", "context", "status")


def joint(spark, d):
    new, table = _incoming(spark, d)
    messy = new.withColumn("text", F.when(F.col("id") % 6 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("text"), F.lit("\n"))))
    return S.stage_joint_entities(messy, table, ["id"]).select("id", "text", "entity_type", "validation_status", "source", "confidence", "status")


def relations(spark, d):
    new = staged_relations(spark, d)
    incoming = new.drop("status").withColumn("document_text", F.concat_ws(" and ", "source_entity", "target_entity"))
    return S.stage_relations(incoming, new.filter("status = 'rejected'"), ["id"]).select(
        "id", "source_entity", "relation_type", "target_entity", "context", "status")


def relations_raw(spark, d):
    new = staged_relations(spark, d)
    r = S.stage_relations_raw(new.drop("status"), new.filter("status = 'approved'"))
    return r.groupBy("status", "relation_type").agg(F.count(F.lit(1)).alias("n"))


NEWEST = S.Listing({"status": "pending"}, search="ring%1", search_in=S.SEARCHED["pending_entities"], page=2, page_size=40)
BY_SCORE = S.Listing(sort_by="similarity_score", descending=True, page_size=100)
REL_PAGE = S.Listing({"relation_type": "treats"}, search="BOLT", search_in=S.SEARCHED["pending_relations"], sort_by="target_entity", page_size=60)


def listing(spark, d):
    p = X.pending_entities(spark, d)
    page = lambda name, q: S.attach_reviews(S.list_page(p, q, S.SORTABLE["pending_entities"]), X.entity_reviews(spark, d), "pending_entity_id").select(
        F.lit(name).alias("page"), "id", "text", "status", "review_status", "overall_score")
    return page("newest", NEWEST).unionByName(page("score", BY_SCORE))


DEEP = S.Listing(sort_by="similarity_score", descending=True, page_size=50)
DEEP_REVIEWS = S.Listing(sort_by="overall_score", page_size=50)
DEEP_TABLES = {"pending_entities": DEEP, "entity_reviews": DEEP_REVIEWS}


def deep_pages(spark, d):
    """The page in the middle and the last one of two whole listings, each by its counted ranges."""
    out = None
    for name, q in DEEP_TABLES.items():
        index = PageIndex(getattr(X, name)(spark, d), q, S.SORTABLE[name])
        last = max(1, -(-index.total() // q.page_size))
        for number in {(last + 1) // 2, last}:
            page = index.page(number).select(F.lit(name).alias("listing"), F.lit(number).cast("long").alias("page"), "id")
            out = page if out is None else out.unionByName(page)
    return out


def pages_after(spark, d):
    """The page that follows the third one, found by its last row and not by number."""
    out = None
    for name, q in DEEP_TABLES.items():
        rows, sortable = getattr(X, name)(spark, d), S.SORTABLE[name]
        seen = S.list_page(rows, replace(q, page=3), sortable).select(q.sort_by, "id").collect()  # one page
        page = S.list_after(rows, q, sortable, *seen[-1]) if seen else rows.limit(0)
        page = page.select(F.lit(name).alias("listing"), "id")
        out = page if out is None else out.unionByName(page)
    return out


def listing_total(spark, d):
    p = X.pending_entities(spark, d)
    r = staged_relations(spark, d)
    parts = [("newest", p, NEWEST), ("score", p, BY_SCORE), ("relations", r, REL_PAGE)]
    out = [S.list_total(t, q).withColumn("page", F.lit(n)) for n, t, q in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def relation_listing(spark, d):
    page = S.list_page(staged_relations(spark, d), REL_PAGE, S.SORTABLE["pending_relations"])
    return S.attach_reviews(page, X.relation_reviews(spark, d), "pending_relation_id").select(
        "id", "source_entity", "target_entity", "status", "review_status", "overall_score")


def _bulk(spark, d, action):
    p = X.pending_entities(spark, d)
    ids = p.filter("kind IN ('click', 'error', 'purchase')").select("id")
    table, count = S.bulk_action(p, ids, action)
    by = table.groupBy(F.lit(action).alias("action"), F.col("status").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return by.unionByName(count.select(F.lit(action).alias("action"), F.lit("affected").alias("what"), F.col("affected_count").alias("n")))


def bulk_action(spark, d):
    parts = [_bulk(spark, d, a) for a in ("delete", "reject", "approve")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def bulk_delete(spark, d):
    r = staged_relations(spark, d)
    table, count = S.bulk_delete(r, r.filter("status = 'rejected'").select("id"))
    return table.groupBy("status").agg(F.count(F.lit(1)).alias("n")).unionByName(count.select(F.lit("deleted").alias("status"), F.col("affected_count").alias("n")))


def _edits(spark, d):
    """Views get a new text, clicks a new type, signups a new status; every fifth error gets one text and type for all."""
    p = X.pending_entities(spark, d)
    k = F.col("kind")
    same = (k == "error") & (F.col("id") % 5 == 0)
    return p.filter(k.isin("view", "click", "signup") | same).select(
        "id", F.when(k == "view", F.replace("text", F.lit(" scan test"), F.lit(""))).when(same, F.concat(F.lit("same "), (F.col("id") % 10).cast("string"))).alias("text"),
        F.when((k == "click") | same, F.lit("organ")).alias("entity_type"), F.when(k == "view", F.col("text")).alias("normalized_text"),
        F.when(k == "signup", F.lit("rejected")).alias("status"))


def edits(spark, d):
    p, r, conflicts = S.apply_edits(X.pending_entities(spark, d), X.entity_reviews(spark, d), _edits(spark, d))
    one = p.select(F.lit("pending").alias("part"), "id", "text", "entity_type", "normalized_text", "status")
    two = r.select(F.lit("review").alias("part"), "id", F.col("entity_text").alias("text"), "entity_type",
                   F.lit(None).cast("string").alias("normalized_text"), F.lit(None).cast("string").alias("status"))
    three = conflicts.select(F.lit("conflict").alias("part"), "id", *[F.lit(None).cast("string").alias(c) for c in ("text", "entity_type", "normalized_text", "status")])
    return one.unionByName(two).unionByName(three)


def relation_edits(spark, d):
    r = staged_relations(spark, d)
    e = r.filter("source = 'both'").select("id", F.upper("target_entity").alias("target_entity"), F.lit("affects").alias("relation_type"))
    return S.apply_relation_edits(r, e, ["target_entity", "relation_type"]).select("id", "target_entity", "relation_type")


def _links(spark, d):
    p = X.pending_entities(spark, d)
    link = F.when(F.col("kind") == "click", F.concat(F.lit(BASE + "part/"), (F.col("id") % 50).cast("string")))
    return p.select("id", link.alias("link_to_uri"), X.pick(LINKS, F.col("id") % 7).alias("link_type"))


def emit_entities(spark, d):
    p = X.pending_entities(spark, d).join(_links(spark, d), "id")
    e = p.select("text", "entity_type", F.col("normalized_text").alias("normalized_form"), "link_to_uri", "link_type")
    return W.emit_entity_triples(e, STAMP)


def link_predicates(spark, d):
    e = _links(spark, d)
    return e.groupBy("link_type", W.link_predicate(F.col("link_type")).alias("predicate")).agg(F.count(F.lit(1)).alias("n"))


def uris(spark, d):
    r = X.relations(spark, d)
    texts = r.select(F.explode(F.array("source_entity", "target_entity")).alias("text"))
    return W.get_or_create_uris(texts, X.triples(spark, d), STAMP)


def _named_relations(spark, d):
    """Relations whose ends are sometimes labels of the graph."""
    return staged_relations(spark, d)


def emit_relations(spark, d):
    return W.emit_relation_triples(_named_relations(spark, d), X.triples(spark, d), STAMP)


def approve_entities(spark, d):
    p, r = X.pending_entities(spark, d), X.entity_reviews(spark, d)
    made, left, left_reviews = W.approve_entities(p, r, p.filter("status = 'approved' OR kind = 'click'").select("id"), STAMP)
    n = lambda df, name: df.groupBy(F.lit(name).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*df.columns[:1]).alias("k"))
    return n(made, "triples").unionByName(n(left, "pending")).unionByName(n(left_reviews.select("id"), "reviews"))


def approve_relations(spark, d):
    r = staged_relations(spark, d)
    chosen = r.filter("status = 'pending'").select("id", F.when(F.col("source") == "both", F.lit("Somewhere")).alias("target_entity"))
    made, table = W.approve_relations(r, chosen, X.triples(spark, d), STAMP)
    one = made.groupBy(F.col("p").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    two = table.groupBy(F.concat_ws(" ", "status", F.when(F.col("target_entity") == "Somewhere", F.lit("moved"))).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return one.unionByName(two)


QUERIES = {
    "stage_entities": entities,
    "stage_joint_entities": joint,
    "stage_relations": relations,
    "stage_relations_raw": relations_raw,
    "list_pending": listing,
    "list_pending_relations": relation_listing,
    "list_pending_total": listing_total,
    "list_deep_pages": deep_pages,
    "list_after": pages_after,
    "reviewed_only": lambda s, d: S.reviewed_only(X.pending_entities(s, d), X.entity_reviews(s, d), "pending_entity_id").select("id", "text"),
    "not_reviewed": lambda s, d: S.not_reviewed(X.pending_entities(s, d), X.entity_reviews(s, d), "pending_entity_id").select("id", "text"),
    "pending_stats": lambda s, d: S.pending_stats(X.pending_entities(s, d)),
    "relation_pending_stats": lambda s, d: S.relation_pending_stats(staged_relations(s, d)),
    "bulk_action": bulk_action,
    "bulk_delete": bulk_delete,
    "apply_edits": edits,
    "apply_relation_edits": relation_edits,
    "emit_entity_triples": emit_entities,
    "link_predicate": link_predicates,
    "get_or_create_uri": uris,
    "emit_relation_triples": emit_relations,
    "approve_entities": approve_entities,
    "approve_relations": approve_relations,
}

STAGED = {"staged": """SELECT relation_id AS id, source_entity, source_type, relation_type, target_entity, target_type, confidence, context, source,
  CASE flag WHEN 'R' THEN 'approved' WHEN 'A' THEN 'rejected' ELSE 'pending' END AS status, created_at FROM relations"""}
_search = lambda *cols: lambda t: "(" + " OR ".join(f"coalesce({c} ILIKE '%{t}%', false)" for c in cols) + ")"
_ent, _rel = _search("text", "normalized_text"), _search("source_entity", "target_entity")
_newest = f"SELECT * FROM pending_entities WHERE status = 'pending' AND {_ent('ring%1')}"
_relpage = f"SELECT * FROM staged WHERE relation_type = 'treats' AND {_rel('BOLT')}"
_rev = lambda link, t: f"SELECT {link} AS id, arg_max(review_status, id) AS review_status, arg_max(overall_score, id) AS overall_score FROM {t} WHERE {link} IS NOT NULL GROUP BY {link}"
_class = f"coalesce({Q.mapping(CLASS_NAMES)}[lower(entity_type)], 'Finding')"
_mint = lambda x, kind="''": f"'{BASE}' || regexp_replace({x}, '[^a-zA-Z0-9]', '_', 'g') || '_{STAMP}_' || substr(md5({kind} || '|' || {x}), 1, 12)"
_ordered = " UNION ALL ".join(f"SELECT '{t}' AS listing, id, row_number() OVER (ORDER BY {by}, id) - 1 AS r, count(*) OVER () AS n FROM {t}" for t, by in [
    ("pending_entities", "similarity_score DESC NULLS LAST"), ("entity_reviews", "overall_score ASC NULLS FIRST")])
_ids = "SELECT id FROM pending_entities WHERE kind IN ('click', 'error', 'purchase')"


def _class_sql(frm: str, uri: str = "uri") -> str:
    return f"""SELECT {uri} AS s, '{RDF_TYPE}' AS p, '{TYPES}' || {_class} AS o, 'uri' AS o_kind FROM {frm}
UNION SELECT '{TYPES}' || {_class}, '{RDFS_SUBCLASS}', '{TYPES}' || {Q.mapping(PARENT_CLASSES)}[{_class}], 'uri' FROM {frm} WHERE {Q.mapping(PARENT_CLASSES)}[{_class}] IS NOT NULL"""


def _relation_sql(source: str) -> dict[str, str]:
    """CTEs that end in ``made``, the triples of the relations in ``source``."""
    return {
        "ends": f"""SELECT text, arg_min(entity_type, [id, side]) AS entity_type FROM (SELECT id, source_entity AS text, source_type AS entity_type, 0 AS side FROM {source}
  UNION ALL SELECT id, target_entity, target_type, 1 FROM {source}) e GROUP BY text""",
        "known": f"SELECT o AS text, min(s) AS known FROM triples WHERE p = '{RDFS_LABEL}' GROUP BY o",
        "uris": f"SELECT text, entity_type, coalesce(known, {_mint('text')}) AS uri, known IS NULL AS created FROM ends LEFT JOIN known USING (text)",
        "fresh": "SELECT * FROM uris WHERE created",
        "made": f"""SELECT a.uri AS s, '{RELATIONS}' || relation_type AS p, b.uri AS o, 'uri' AS o_kind FROM {source} r JOIN uris a ON a.text = source_entity JOIN uris b ON b.text = target_entity
UNION SELECT uri, '{RDFS_LABEL}', text, 'literal' FROM fresh UNION {_class_sql('fresh')}""",
    }


ORACLES = {
    "stage_entities": X.with_tables("pending_entities", body="""SELECT id, text, entity_type, substr(context, 1, 500) AS context, 'pending' AS status FROM (
SELECT * FROM pending_entities WHERE validation_status <> 'exact_match' QUALIFY row_number() OVER (PARTITION BY text, entity_type ORDER BY id) = 1) n
WHERE NOT EXISTS (SELECT 1 FROM pending_entities p WHERE p.source = 'bert' AND p.status = 'pending' AND p.text = n.text AND p.entity_type = n.entity_type)"""),
    "stage_joint_entities": X.with_tables("pending_entities", body="""SELECT id, text, entity_type, 'not_found' AS validation_status, 'langextract' AS source, CAST(NULL AS DOUBLE) AS confidence, 'pending' AS status FROM (
SELECT * FROM pending_entities WHERE id % 6 <> 0 QUALIFY row_number() OVER (PARTITION BY text, entity_type ORDER BY id) = 1) n
WHERE NOT EXISTS (SELECT 1 FROM pending_entities p WHERE p.source = 'bert' AND p.status = 'pending' AND p.text = n.text AND p.entity_type = n.entity_type)"""),
    "stage_relations": X.with_tables("relations", extra=STAGED, body="""SELECT id, source_entity, relation_type, target_entity,
substr(coalesce(context, source_entity || ' and ' || target_entity), 1, 500) AS context, 'pending' AS status FROM (
SELECT * FROM staged QUALIFY row_number() OVER (PARTITION BY source_entity, relation_type, target_entity ORDER BY id) = 1) n
WHERE NOT EXISTS (SELECT 1 FROM staged p WHERE p.status = 'rejected' AND p.source_entity = n.source_entity AND p.relation_type = n.relation_type AND p.target_entity = n.target_entity)"""),
    "stage_relations_raw": X.with_tables("relations", extra=STAGED, body="""SELECT status, relation_type, count(*) AS n FROM (
SELECT 'pending' AS status, relation_type FROM staged UNION ALL SELECT status, relation_type FROM staged WHERE status = 'approved') x GROUP BY 1, 2"""),
    "list_pending": X.with_tables("pending_entities", "entity_reviews", extra={"rev": _rev("pending_entity_id", "entity_reviews")}, body=f"""
SELECT page, id, text, status, review_status, overall_score FROM (SELECT * FROM (SELECT 'newest' AS page, id, text, status FROM ({_newest}) n ORDER BY created_at DESC, id LIMIT 40 OFFSET 40) a
UNION ALL SELECT * FROM (SELECT 'score', id, text, status FROM pending_entities ORDER BY similarity_score DESC NULLS LAST, id LIMIT 100) b) p LEFT JOIN rev USING (id)"""),
    "list_pending_relations": X.with_tables("relations", "relation_reviews", extra={**STAGED, "rev": _rev("pending_relation_id", "relation_reviews")}, body=f"""
SELECT id, source_entity, target_entity, status, review_status, overall_score FROM (SELECT * FROM ({_relpage}) r ORDER BY target_entity, id LIMIT 60) p LEFT JOIN rev USING (id)"""),
    "list_deep_pages": X.with_tables("pending_entities", "entity_reviews", body=f"""SELECT listing, r // 50 + 1 AS page, id FROM ({_ordered}) x
WHERE r // 50 IN ((n - 1) // 50, (n - 1) // 50 // 2)"""),
    "list_after": X.with_tables("pending_entities", "entity_reviews", body=f"SELECT listing, id FROM ({_ordered}) x WHERE r // 50 = 3"),
    "list_pending_total": X.with_tables("pending_entities", "relations", extra=STAGED, body=f"""SELECT 'newest' AS page, count(*) AS total FROM ({_newest}) n
UNION ALL SELECT 'score', count(*) FROM pending_entities UNION ALL SELECT 'relations', count(*) FROM ({_relpage}) r"""),
    "reviewed_only": X.with_tables("pending_entities", "entity_reviews", body="SELECT id, text FROM pending_entities WHERE id IN (SELECT pending_entity_id FROM entity_reviews)"),
    "not_reviewed": X.with_tables("pending_entities", "entity_reviews", body="SELECT id, text FROM pending_entities WHERE id NOT IN (SELECT pending_entity_id FROM entity_reviews WHERE pending_entity_id IS NOT NULL)"),
    "pending_stats": X.with_tables("pending_entities", body="""SELECT 'status' AS stat, status AS name, count(*) AS n FROM pending_entities GROUP BY status
UNION ALL SELECT 'type', entity_type, count(*) FROM pending_entities WHERE status = 'pending' GROUP BY entity_type
UNION ALL SELECT 'source', source, count(*) FROM pending_entities WHERE status = 'pending' GROUP BY source"""),
    "relation_pending_stats": X.with_tables("relations", extra=STAGED, body="""SELECT 'total' AS stat, '' AS name, count(*) AS n FROM staged
UNION ALL SELECT 'status', status, count(*) FROM staged GROUP BY status UNION ALL SELECT 'source', source, count(*) FROM staged GROUP BY source"""),
    "bulk_action": X.with_tables("pending_entities", extra={"ids": _ids}, body="""
SELECT 'delete' AS action, status AS what, count(*) AS n FROM pending_entities WHERE id NOT IN (SELECT id FROM ids) GROUP BY status
UNION ALL SELECT 'delete', 'affected', count(*) FROM ids
UNION ALL SELECT 'reject', s, count(*) FROM (SELECT CASE WHEN id IN (SELECT id FROM ids) THEN 'rejected' ELSE status END AS s FROM pending_entities) x GROUP BY s
UNION ALL SELECT 'reject', 'affected', count(*) FROM ids
UNION ALL SELECT 'approve', s, count(*) FROM (SELECT CASE WHEN status = 'pending' AND id IN (SELECT id FROM ids) THEN 'approved' ELSE status END AS s FROM pending_entities) y GROUP BY s
UNION ALL SELECT 'approve', 'affected', count(*) FROM pending_entities WHERE status = 'pending' AND id IN (SELECT id FROM ids)"""),
    "bulk_delete": X.with_tables("relations", extra=STAGED, body="""SELECT status, count(*) AS n FROM staged WHERE status <> 'rejected' GROUP BY status
UNION ALL SELECT 'deleted', count(*) FROM staged WHERE status = 'rejected'"""),
    "apply_edits": X.with_tables("pending_entities", "entity_reviews", extra={
        "edits": """SELECT id, CASE WHEN kind = 'view' THEN replace(text, ' scan test', '') WHEN kind = 'error' THEN 'same ' || (id % 10) END AS t, CASE WHEN kind IN ('click', 'error') THEN 'organ' END AS k,
  CASE WHEN kind = 'view' THEN text END AS n, CASE WHEN kind = 'signup' THEN 'rejected' END AS s FROM pending_entities WHERE kind IN ('view', 'click', 'signup') OR kind = 'error' AND id % 5 = 0""",
        "wanted": "SELECT id, coalesce(t, text) AS kt, coalesce(k, entity_type) AS kk FROM edits JOIN pending_entities USING (id) WHERE t IS NOT NULL OR k IS NOT NULL",
        "taken": """SELECT id FROM wanted w WHERE EXISTS (SELECT 1 FROM pending_entities p WHERE p.text = kt AND p.entity_type = kk AND p.id <> w.id)
  OR EXISTS (SELECT 1 FROM entity_reviews r WHERE r.entity_text = kt AND r.entity_type = kk AND r.pending_entity_id <> w.id)""",
        "conflicts": """SELECT id FROM taken UNION ALL SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY kt, kk ORDER BY id) AS turn
  FROM wanted WHERE id NOT IN (SELECT id FROM taken)) t WHERE turn > 1""",
        "applied": "SELECT * FROM edits WHERE id NOT IN (SELECT id FROM conflicts)"}, body="""
SELECT 'pending' AS part, p.id, coalesce(t, text) AS text, coalesce(k, entity_type) AS entity_type, coalesce(n, normalized_text) AS normalized_text, coalesce(s, status) AS status
FROM pending_entities p LEFT JOIN applied a ON a.id = p.id
UNION ALL SELECT 'review', r.id, coalesce(t, entity_text), coalesce(k, entity_type), NULL, NULL FROM entity_reviews r LEFT JOIN applied a ON a.id = r.pending_entity_id
UNION ALL SELECT 'conflict', id, NULL, NULL, NULL, NULL FROM conflicts"""),
    "apply_relation_edits": X.with_tables("relations", extra=STAGED, body="""SELECT id, CASE WHEN source = 'both' THEN upper(target_entity) ELSE target_entity END AS target_entity,
CASE WHEN source = 'both' THEN 'affects' ELSE relation_type END AS relation_type FROM staged"""),
    "emit_entity_triples": X.with_tables("pending_entities", extra={"e": f"SELECT *, {_mint('text', 'entity_type')} AS uri, {Q.array(LINKS)}[id % 7 + 1] AS link_type FROM pending_entities"}, body=f"""
SELECT uri AS s, '{RDFS_LABEL}' AS p, text AS o, 'literal' AS o_kind FROM e UNION {_class_sql('e')}
UNION SELECT uri, '{SKOS_PREF}', normalized_text, 'literal' FROM e WHERE normalized_text IS NOT NULL
UNION SELECT uri, coalesce({Q.mapping(LINK_PREDICATES)}[link_type], '{DEFAULT_LINK_PREDICATE}'), '{BASE}part/' || (id % 50), 'uri' FROM e WHERE kind = 'click'"""),
    "link_predicate": X.with_tables("mentions", body=f"""SELECT l AS link_type, coalesce({Q.mapping(LINK_PREDICATES)}[l], '{DEFAULT_LINK_PREDICATE}') AS predicate, count(*) AS n
FROM (SELECT {Q.array(LINKS)}[mention_id % 7 + 1] AS l FROM mentions) m GROUP BY 1, 2"""),
    "get_or_create_uri": X.with_tables("triples", "relations", body=f"""SELECT text, coalesce(known, {_mint('text')}) AS uri, known IS NULL AS created FROM
(SELECT source_entity AS text FROM relations UNION SELECT target_entity FROM relations) t
LEFT JOIN (SELECT o AS text, min(s) AS known FROM triples WHERE p = '{RDFS_LABEL}' GROUP BY o) k USING (text)"""),
    "emit_relation_triples": X.with_tables("triples", "relations", extra={**STAGED, **_relation_sql("staged")}, body="SELECT DISTINCT s, p, o, o_kind FROM made"),
    "approve_entities": X.with_tables("pending_entities", "entity_reviews", extra={
        "ok": "SELECT * FROM pending_entities WHERE status = 'approved' OR kind = 'click'", "e": f"SELECT *, {_mint('text', 'entity_type')} AS uri FROM ok",
        "made": f"SELECT uri AS s, '{RDFS_LABEL}' AS p, text AS o, 'literal' AS o_kind FROM e UNION {_class_sql('e')} UNION SELECT uri, '{SKOS_PREF}', coalesce(normalized_text, text), 'literal' FROM e"}, body="""
SELECT 'triples' AS part, count(*) AS n, count(DISTINCT s) AS k FROM (SELECT DISTINCT s, p, o FROM made) m
UNION ALL SELECT 'pending', count(*), count(DISTINCT id) FROM pending_entities WHERE id NOT IN (SELECT id FROM ok)
UNION ALL SELECT 'reviews', count(*), count(DISTINCT id) FROM entity_reviews WHERE pending_entity_id IS NULL OR pending_entity_id NOT IN (SELECT id FROM ok)"""),
    "approve_relations": X.with_tables("triples", "relations", extra={**STAGED, "final": """SELECT * REPLACE (CASE WHEN status = 'pending' AND source = 'both' THEN 'Somewhere' ELSE target_entity END AS target_entity,
  CASE WHEN status = 'pending' THEN 'approved' ELSE status END AS status), status = 'pending' AS chosen FROM staged""", "chosen": "SELECT * FROM final WHERE chosen", **_relation_sql("chosen")}, body="""
SELECT p AS name, count(*) AS n FROM (SELECT DISTINCT s, p, o FROM made) m GROUP BY p
UNION ALL SELECT status || CASE WHEN target_entity = 'Somewhere' THEN ' moved' ELSE '' END, count(*) FROM final GROUP BY 1"""),
}
