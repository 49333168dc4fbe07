"""Registered queries: column rules on texts, URIs, types and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.functions import labels as L
from kgspark.functions.text import normalize_text
from kgspark.operators import scalars
from kgspark.plans import sqlkit as Q
from kgspark.sources import fixtures as X
from kgspark.vocab import (
    ALLOWED_KG_TYPES, BASE, CANONICAL_KG_TYPES, CLASS_NAMES, DISPLAY_PREFIXES, ENTITY_TYPES, FOREIGN_LABELS,
    IOB_SYNONYMS, PREFIXES, TOKEN_LABELS, TYPE_HINTS, TYPES,
)

STAMP = 1700000000000  # the run's time stamp in milliseconds, an argument of the job
FOREIGN = list(FOREIGN_LABELS)


def normalize(spark, d):
    literals = X.triples(spark, d).filter("o_kind = 'literal'").select(F.col("o").alias("text"))
    texts = literals.unionByName(X.mentions(spark, d).select("text")).distinct()
    return texts.select("text", normalize_text(F.col("text")).alias("norm"))


def uris(spark, d):
    t = X.triples(spark, d)
    return t.select(F.explode(F.array("s", "p", F.when(F.col("o_kind") == "uri", F.col("o")))).alias("uri")).dropna().distinct()


def local_names(spark, d):
    u = F.col("uri")
    return uris(spark, d).select("uri", L.local_name(u).alias("local_name"), L.local_name_slash_first(u).alias("slash_first"))


def shorten(spark, d):
    return uris(spark, d).select("uri", L.shorten_uri(F.col("uri")).alias("short"))


def expand(spark, d):
    short = uris(spark, d).select(L.shorten_uri(F.col("uri")).alias("short"))
    return short.select("short", L.expand_curie(F.col("short")).alias("uri"))


def canonical(spark, d):
    local = L.local_name(F.col("o"))
    t = X.triples(spark, d).filter(F.col("o").startswith(TYPES))
    return t.groupBy(local.alias("class"), F.coalesce(L.canonical_kg_type(local), F.lit("unknown")).alias("type")).agg(
        F.count(F.lit(1)).alias("n"))


def foreign(spark, d):
    i = F.col("mention_id")
    label = (
        F.when(i % 3 == 0, F.upper("entity_type")).when(i % 3 == 1, F.replace("entity_type", F.lit("_"), F.lit("-")))
        .otherwise(X.pick(FOREIGN, i % len(FOREIGN)))
    )
    return X.mentions(spark, d).select("mention_id", label.alias("label")).select(
        "mention_id", "label", L.map_foreign_label(F.col("label")).alias("entity_type"))


def _raw_iob(spark, d):
    """Labels as other tools write them: CamelCase, upper prefix or lower prefix, plain o."""
    t = F.substring("labels", F.lit(3), F.length("labels"))
    side = F.when(F.col("pos") % 2 == 0, F.lower(F.substring("labels", 1, 2))).otherwise(F.substring("labels", 1, 2))
    raw = F.when(F.col("labels") == "O", F.when(F.col("pos") % 2 == 0, F.lit("o")).otherwise(F.lit("O"))).otherwise(
        F.concat(side, L.format_iob_type(t)))
    return X.tokens(spark, d).withColumn("raw", raw)


def normalize_iob(spark, d):
    return _raw_iob(spark, d).groupBy("raw", L.normalize_iob_label(F.col("raw")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def format_iob(spark, d):
    m = X.mentions(spark, d)
    return m.groupBy("entity_type", L.format_iob_type(F.col("entity_type")).alias("iob_type")).agg(F.count(F.lit(1)).alias("n"))


def label_ids(spark, d):
    coded = X.tokens(spark, d).withColumn("label_id", L.label_id(F.when(F.col("pos") % 50 == 0, F.lit("X-odd")).otherwise(F.col("labels"))))
    return coded.groupBy("label_id", L.id_label(F.col("label_id")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def infer(spark, d):
    docs = X.table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    m = X.mentions(spark, d).select(F.concat(F.lit("m"), F.col("mention_id").cast("string")).alias("id"), "text")
    return docs.unionByName(m).select("id", L.infer_entity_type(F.col("text")).alias("entity_type"))


def mint(spark, d):
    return X.mentions(spark, d).select("text").distinct().select("text", L.mint_uri(F.col("text"), STAMP).alias("uri"))


def confident(spark, d):
    return scalars.confidence_filter(X.mentions(spark, d)).select("mention_id", "confidence")


def compatible(spark, d):
    m = X.pick(ENTITY_TYPES, F.col("p_partkey") % 14)
    classes = F.element_at(L.literal_map(X.PART_CLASSES), F.col("p_type"))
    p = X.table(spark, d, "part").select("p_partkey", m.alias("entity_type"), F.array(classes).alias("type_names"))
    return p.select("p_partkey", "entity_type", L.type_compatible(F.col("type_names"), F.col("entity_type")).alias("ok"))


QUERIES = {
    "normalize_text": normalize,
    "local_name": local_names,
    "shorten_uri": shorten,
    "expand_curie": expand,
    "canonical_kg_type": canonical,
    "map_foreign_label": foreign,
    "normalize_iob_label": normalize_iob,
    "format_iob_type": format_iob,
    "label_to_id": label_ids,
    "infer_entity_type": infer,
    "mint_uri": mint,
    "confidence_filter": confident,
    "type_compatible": compatible,
}

_uris = "SELECT DISTINCT uri FROM (SELECT unnest([s, p, CASE WHEN o_kind = 'uri' THEN o END]) AS uri FROM triples) x WHERE uri IS NOT NULL"
_short = "CASE " + " ".join(
    f"WHEN starts_with(uri, '{PREFIXES[p]}') THEN '{p}:' || substr(uri, {len(PREFIXES[p]) + 1})" for p in DISPLAY_PREFIXES
) + " ELSE '...' || regexp_extract(uri, '[#/][^#/]*$') END"
_hints = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{t}'" for t, words in TYPE_HINTS
) + " ELSE 'finding' END"
_camel = lambda x: f"coalesce({Q.mapping(CLASS_NAMES)}[lower({x})], upper(substr({x}, 1, 1)) || lower(substr({x}, 2)))"
_allowed = "CASE entity_type " + " ".join(f"WHEN '{k}' THEN {Q.array(v)}" for k, v in ALLOWED_KG_TYPES.items()) + " END"

ORACLES = {
    "normalize_text": X.with_tables("triples", "mentions", body=f"""SELECT text, {Q.normalized('text')} AS norm
FROM (SELECT o AS text FROM triples WHERE o_kind = 'literal' UNION SELECT text FROM mentions) x"""),
    "local_name": X.with_tables("triples", body=f"SELECT uri, {Q.local_name('uri')} AS local_name, {Q.local_name('uri')} AS slash_first FROM ({_uris}) u"),
    "shorten_uri": X.with_tables("triples", body=f"SELECT uri, {_short} AS short FROM ({_uris}) u"),
    "expand_curie": X.with_tables("triples", body=f"SELECT {_short} AS short, uri FROM ({_uris}) u"),
    "canonical_kg_type": X.with_tables("triples", body=f"""SELECT {Q.local_name('o')} AS class,
coalesce({Q.mapping(CANONICAL_KG_TYPES)}[lower({Q.local_name('o')})], 'unknown') AS type, count(*) AS n
FROM triples WHERE starts_with(o, '{TYPES}') GROUP BY 1, 2"""),
    "map_foreign_label": X.with_tables("mentions", body=f"""SELECT mention_id, label,
coalesce({Q.mapping(FOREIGN_LABELS)}[regexp_replace(lower(label), '[_-]', '', 'g')],
  CASE WHEN lower(label) IN {Q.names(ENTITY_TYPES)} THEN lower(label) END, 'finding') AS entity_type
FROM (SELECT mention_id, CASE mention_id % 3 WHEN 0 THEN upper(entity_type) WHEN 1 THEN replace(entity_type, '_', '-')
  ELSE {Q.array(FOREIGN)}[mention_id % {len(FOREIGN)} + 1] END AS label FROM mentions) m"""),
    "normalize_iob_label": X.with_tables("tokens", body=f"""SELECT raw, CASE WHEN lower(raw) = 'o' THEN 'O' ELSE upper(substr(raw, 1, 2)) ||
  coalesce({Q.mapping(IOB_SYNONYMS)}[snake], snake) END AS label, count(*) AS n
FROM (SELECT raw, lower(regexp_replace(substr(raw, 3), '(.)([A-Z])', '\\1_\\2', 'g')) AS snake
  FROM (SELECT CASE WHEN labels = 'O' THEN CASE WHEN pos % 2 = 0 THEN 'o' ELSE 'O' END
    ELSE CASE WHEN pos % 2 = 0 THEN lower(substr(labels, 1, 2)) ELSE substr(labels, 1, 2) END || {_camel('substr(labels, 3)')} END AS raw FROM tokens) a) b
GROUP BY 1, 2"""),
    "format_iob_type": X.with_tables("mentions", body=f"SELECT entity_type, {_camel('entity_type')} AS iob_type, count(*) AS n FROM mentions GROUP BY 1, 2"),
    "label_to_id": X.with_tables("tokens", body=f"""SELECT label_id, {Q.array(TOKEN_LABELS)}[label_id + 1] AS label, count(*) AS n
FROM (SELECT CAST(coalesce(list_position({Q.array(TOKEN_LABELS)}, CASE WHEN pos % 50 = 0 THEN 'X-odd' ELSE labels END), 1) - 1 AS INTEGER) AS label_id FROM tokens) t GROUP BY 1, 2"""),
    "infer_entity_type": X.with_tables("mentions", body=f"""SELECT id, {_hints} AS entity_type
FROM (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'm' || mention_id, text FROM mentions) x"""),
    "mint_uri": X.with_tables("mentions", body=f"SELECT DISTINCT text, '{BASE}' || regexp_replace(text, '[^a-zA-Z0-9]', '_', 'g') || '_{STAMP}_' || substr(md5('|' || text), 1, 12) AS uri FROM mentions"),
    "confidence_filter": X.with_tables("mentions", body="SELECT mention_id, confidence FROM mentions WHERE confidence >= 0.5"),
    "type_compatible": f"""SELECT p_partkey, entity_type, list_contains({_allowed}, class) AS ok FROM (SELECT p_partkey,
{Q.array(ENTITY_TYPES)}[p_partkey % 14 + 1] AS entity_type, {Q.mapping(X.PART_CLASSES)}[p_type] AS class FROM part) p""",
}
