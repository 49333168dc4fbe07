"""Graph, mention, review and token tables derived from the parquet test tables.

``CTE`` states the same derivations in SQL for the DuckDB check; ``with_tables`` puts the ones
a query needs in front of its body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kgspark.functions.numbers import round_to
from kgspark.operators.prepare import tokenize_spans
from kgspark.sources.versions import dealt
from kgspark.vocab import (
    BASE, ENTITY_TYPES, PARENT_CLASSES, RDF_TYPE, RDFS_LABEL, RDFS_SUBCLASS, RELATIONS,
    RELATION_TYPES, SKOS_ALT, SKOS_PREF, TYPES,
)

SUPPLIER_GRAPH = BASE + "graph/suppliers"
PART_CLASSES = {
    "ECONOMY": "Substance", "LARGE": "Disease", "MEDIUM": "Finding",
    "PROMO": "Procedure", "SMALL": "QuantitativeMeasure", "STANDARD": "Symptom",
}


# Tables with much work per row; their key is also what most later steps group and join by.
FACTS = {"documents": "doc_id", "events": "event_id", "lineitem": "l_orderkey"}
# Rows per partition where a row becomes many: a document some hundred tokens, a row of the others some long triples.
DOCUMENTS_DEALT, ROWS_DEALT = 2048, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "documents":
        return dealt(rows, [FACTS[name]], DOCUMENTS_DEALT)
    return rows.repartition(FACTS[name]) if name in FACTS else rows


def _rows(table: DataFrame) -> Column:
    """The number of rows, as a scalar subquery of the plan."""
    return table.agg(F.count(F.lit(1)).alias("n")).scalar()


def pick(names: list[str], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), (i + 1).cast("int"))


def treated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier and part of the first line items, each pair once; the shuffle that deals the pairs also makes them distinct."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    partitions = items.count() // (4 * ROWS_DEALT) + 1
    return items.filter("l_linenumber = 1").select("l_suppkey", "l_partkey").repartition(partitions, "l_suppkey", "l_partkey").distinct()


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    def uri(kind, key):
        return F.concat(F.lit(f"{BASE}{kind}/"), F.col(key).cast("string"))

    def term(p, o, kind):
        p = F.lit(p) if isinstance(p, str) else p
        return F.struct(p.alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))

    def rows(df, src, subject, terms, graph=None):
        g = F.lit(graph).cast("string")
        if len(terms) == 1:  # a plain projection, so that a filter on the predicate can drop the table
            t = terms[0]
            return df.select(subject.alias("s"), t["p"].alias("p"), t["o"].alias("o"), t["o_kind"].alias("o_kind"),
                             g.alias("g"), F.lit(src).alias("src"))
        return df.select(subject.alias("s"), F.explode(F.array(*terms)).alias("t"), g.alias("g"),
                         F.lit(src).alias("src")).select("s", "t.p", "t.o", "t.o_kind", "g", "src")

    t = lambda n: table(spark, sf_dir, n)
    spread = lambda n, key: dealt(t(n), [key], ROWS_DEALT)
    cls = lambda n: term(RDF_TYPE, F.lit(TYPES + n), "uri")
    lab = lambda c, p=RDFS_LABEL: term(p, c, "literal")
    edge = lambda r, kind, key: term(RELATIONS + r, uri(kind, key), "uri")

    part_class = None
    for k, v in PART_CLASSES.items():
        part_class = (F if part_class is None else part_class).when(F.col("p_type") == k, F.lit(TYPES + v))
    size_name = F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))
    out = rows(t("region"), "region", uri("region", "r_regionkey"), [cls("Organ"), lab(F.col("r_name"))])
    for extra in (
        rows(t("nation"), "nation", uri("nation", "n_nationkey"),
             [cls("Finding"), lab(F.col("n_name")), edge("located_in", "region", "n_regionkey")]),
        rows(spread("supplier", "s_suppkey"), "supplier", uri("supplier", "s_suppkey"),
             [cls("Procedure"), lab(F.col("s_name")), edge("located_in", "nation", "s_nationkey")],
             SUPPLIER_GRAPH),
        rows(spread("customer", "c_custkey"), "customer", uri("customer", "c_custkey"),
             [cls("Disease"), lab(F.col("c_name")), edge("affects", "nation", "c_nationkey")]),
        rows(spread("part", "p_partkey"), "part", uri("part", "p_partkey"),
             [term(RDF_TYPE, part_class, "uri"), lab(size_name), lab(F.col("p_name"), SKOS_PREF),
              lab(F.concat_ws(" ", "p_brand", "p_name"), SKOS_ALT)]),
        rows(treated(spark, sf_dir), "lineitem", uri("supplier", "l_suppkey"), [edge("treats", "part", "l_partkey")]),
        _class_rows(t("region")),
    ):
        out = out.unionByName(extra)
    return out


def _class_rows(region: DataFrame) -> DataFrame:
    """The class hierarchy: one edge per region and parent class, made distinct."""
    pairs = F.array(*[F.struct(F.lit(TYPES + c).alias("s"), F.lit(TYPES + p).alias("o"))
                      for c, p in PARENT_CLASSES.items()])
    return (
        region.select(F.explode(pairs).alias("x")).distinct()
        .select("x.s", F.lit(RDFS_SUBCLASS).alias("p"), "x.o", F.lit("uri").alias("o_kind"),
                F.lit(None).cast("string").alias("g"), F.lit("classes").alias("src"))
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mention per event. Every 97th carries one of nine odd texts for the scorecard rules."""
    part = table(spark, sf_dir, "part")
    n_parts, n_docs = _rows(part), _rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    e = table(spark, sf_dir, "events").withColumn("k", F.col("event_id") % n_parts)
    j = e.join(part.select("p_partkey", "p_name", "p_type", "p_size"), F.col("k") == F.col("p_partkey"))
    size_name = F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))
    t = F.col("event_type")
    text = (
        F.when(t == "purchase", size_name)
        .when(t == "click", F.upper(size_name))
        .when(t == "view", F.concat("p_name", F.lit(" scan test")))
        .when(t == "error", F.concat(F.substring("p_name", 1, 1), F.expr("substring(p_name, 3)")))
        .otherwise(F.concat(F.lit("zz "), F.reverse("p_name")))
    )
    odd = [
        F.substring("p_name", 1, 1),
        F.lit("--"),
        F.lit("12.5"),
        F.concat(F.lit("<"), F.col("p_name"), F.lit(">")),
        F.concat(F.lit("male patients with "), F.col("p_name")),
        F.concat(F.lit("one two three four five six seven "), F.col("p_name")),
        F.lit("the"),
        F.concat(F.lit("rare "), F.col("p_name"), F.lit(" seen with cough")),
        F.concat(F.lit("a long thing seen with "), F.col("p_name")),
    ]
    which = (F.floor(F.col("event_id") / 97) % 9).cast("int")
    i = F.col("event_id")
    return j.select(
        i.alias("mention_id"),
        (i % n_docs).alias("doc_id"),
        F.when(i % 97 == 0, F.element_at(F.array(*odd), which + 1)).otherwise(text).alias("text"),
        F.when(i % 389 == 0, F.lit("gadget")).otherwise(pick(ENTITY_TYPES, i % 14)).alias("entity_type"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"),
        F.when(i % 4 == 0, F.col("p_name")).alias("normalized_form"),
        F.when(i % 5 != 0, F.concat_ws(" in ", "p_name", "p_type")).alias("context"),
        pick(["llm", "bert", "langextract"], F.col("user_id") % 3).alias("source"),
        F.concat(F.lit("model_"), (F.col("user_id") % 2).cast("string")).alias("source_model"),
        F.col("ts").alias("created_at"),
        F.col("event_type").alias("kind"),
        F.col("value").alias("value"),
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One relation per line item."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    j = li.join(part, li.l_partkey == part.p_partkey).join(sup, li.l_suppkey == sup.s_suppkey)
    rid = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    # Order and line number repeat in the data; part, supplier and quantity make rows unique.
    unique = (rid * 100000 + F.col("l_partkey")) * 100000 + F.col("l_suppkey") * 50 + F.col("l_quantity").cast("bigint")
    return j.select(
        unique.alias("relation_id"),
        F.col("l_orderkey").alias("doc_id"),
        F.col("p_name").alias("source_entity"),
        pick(ENTITY_TYPES, F.col("l_partkey") % 14).alias("source_type"),
        F.when(rid % 101 == 0, F.lit("unknown_rel"))
        .otherwise(pick(RELATION_TYPES, (F.col("l_orderkey") + F.col("l_linenumber")) % 12))
        .alias("relation_type"),
        F.when(rid % 97 == 0, F.col("p_name")).otherwise(F.col("s_name")).alias("target_entity"),
        pick(ENTITY_TYPES, F.col("l_suppkey") % 14).alias("target_type"),
        (F.col("l_quantity") / 50).alias("confidence"),
        F.when(F.col("l_returnflag") != "N", F.concat_ws(" for ", "p_name", "s_name")).alias("context"),
        F.when(F.col("l_linestatus") == "O", F.lit("both")).otherwise(F.lit("llm")).alias("source"),
        F.col("l_shipdate").alias("created_at"),
        F.col("l_returnflag").alias("flag"),
    )


def pending_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mentions(spark, sf_dir)
    return m.select(
        F.col("mention_id").alias("id"),
        "text",
        "entity_type",
        F.col("normalized_form").alias("normalized_text"),
        F.when(F.col("source") != "bert", F.least(F.lit(1.0), F.col("value") / 200)).alias("similarity_score"),
        F.when(F.col("kind") == "view", F.lit("similar_match")).when(F.col("kind") == "click", F.lit("exact_match"))
        .otherwise(F.lit("not_found")).alias("validation_status"),
        "source",
        "source_model",
        "confidence",
        "context",
        F.when(F.col("kind") == "error", F.lit("rejected")).when(F.col("kind") == "purchase", F.lit("approved"))
        .otherwise(F.lit("pending")).alias("status"),
        "created_at",
        "kind",
        "value",
    )


def entity_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored review for every click, view and signup; those of signups have no pending row."""
    m = mentions(spark, sf_dir).filter(F.col("kind").isin("click", "view", "signup"))
    score = lambda d: round_to(F.least(F.lit(1.0), F.col("value") / d), 3)
    overall = score(120)
    return m.select(
        (F.col("mention_id") + 1000000).alias("id"),
        F.when(F.col("kind") != "signup", F.col("mention_id")).alias("pending_entity_id"),
        F.col("text").alias("entity_text"),
        "entity_type",
        score(100).alias("congruence_score"),
        score(150).alias("coverage_score"),
        score(80).alias("constraint_score"),
        score(90).alias("completeness_score"),
        score(110).alias("consistency_score"),
        overall.alias("overall_score"),
        F.when(overall >= 0.75, F.lit("passed")).when(overall >= 0.5, F.lit("needs_review"))
        .when(overall >= 0.25, F.lit("failed")).otherwise(F.lit("pending")).alias("review_status"),
        F.when(overall >= 0.75, F.lit("approve")).when(overall >= 0.5, F.lit("manual_review"))
        .when(overall >= 0.25, F.lit("reject")).alias("recommendation"),
        F.lit("auto").alias("reviewed_by"),
        F.lit(None).cast("string").alias("review_notes"),
        "created_at",
    )


def relation_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored review for every returned line item."""
    r = relations(spark, sf_dir).filter("flag = 'R'")
    c = F.col("confidence")
    overall = round_to(c * 0.9, 3)
    return r.select(
        (F.col("relation_id") + 1000000).alias("id"),
        F.col("relation_id").alias("pending_relation_id"),
        "source_entity", "source_type", "relation_type", "target_entity", "target_type",
        round_to(c, 3).alias("congruence_score"),
        round_to(c * 0.8, 3).alias("coverage_score"),
        round_to(c * 0.7, 3).alias("constraint_score"),
        round_to(c * 0.6, 3).alias("completeness_score"),
        round_to(c * 0.5, 3).alias("consistency_score"),
        overall.alias("overall_score"),
        F.when(overall >= 0.75, F.lit("passed")).when(overall >= 0.5, F.lit("needs_review"))
        .when(overall >= 0.25, F.lit("failed")).otherwise(F.lit("pending")).alias("review_status"),
        F.when(overall >= 0.75, F.lit("approve")).when(overall >= 0.5, F.lit("manual_review"))
        .otherwise(F.lit("reject")).alias("recommendation"),
        "created_at",
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled tokens of the documents, with offsets (see the ``tokens`` SQL).

    A token is a run of non-blanks; its label follows from its length. Offsets are running sums of
    lengths inside one document's array.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.filter(F.split("text", "[ \n]+"), lambda w: w != "")
    w = docs.select("doc_id", F.posexplode(words).alias("pos", "words"))
    n = F.length("words")
    label = (
        F.when(n % 4 == 0, F.concat(F.lit("B-"), pick(ENTITY_TYPES, n % 14)))
        .when(n % 4 == 1, F.concat(F.lit("I-"), pick(ENTITY_TYPES, n % 14)))
        .otherwise(F.lit("O"))
    )
    return w.withColumns({"labels": label, "sentence_id": F.floor(F.col("pos") / 20).cast("int")})


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pieces of the documents' tokens; tokens over seven characters are two pieces."""
    n = F.length("token")
    long = n > 7
    piece = lambda i, a, b, gap, sub: F.struct(
        (F.col("pos") * 2 + i).alias("idx"), a.alias("start"), b.alias("end"), gap.alias("gap"),
        F.substring("token", a - F.col("start") + 1, b - a).alias("token"), F.lit(sub).alias("is_subword"))
    s, e, cut = F.col("start"), F.col("end"), F.col("start") + 4
    parts = F.when(long, F.array(piece(0, s, cut, F.col("gap"), False), piece(1, cut, e, F.lit(""), True))).otherwise(
        F.array(piece(0, s, e, F.col("gap"), False)))
    rows = tokenize_spans(docs(spark, sf_dir)).select("doc_id", "pos", F.explode(parts).alias("x")).select("doc_id", "pos", "x.*")
    m = F.length("token")
    kind = pick(ENTITY_TYPES, F.floor(m / 4) % 3)
    label = F.when(m % 4 == 0, F.concat(F.lit("B-"), kind)).when(m % 4 == 1, F.concat(F.lit("I-"), kind)).otherwise(F.lit("O"))
    return rows.withColumn("label", label)


def token_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity spans laid over the tokens, some inside a token, some across several."""
    t = tokenize_spans(docs(spark, sf_dir))
    return t.select(
        "doc_id", F.col("pos").alias("ord"), (F.col("start") + F.col("pos") % 2).alias("start"),
        (F.col("end") + F.col("pos") % 3 * 3).alias("end"), pick(ENTITY_TYPES, F.col("pos") % 14).alias("entity_type"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model answer per mention: fenced, broken, wrapped in prose or garbage by its number."""
    n_docs = _rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    m = mentions(spark, sf_dir)
    i = F.col("mention_id")
    text, kind = F.col("text"), F.col("entity_type")
    entity = F.struct(text.alias("text"), kind.alias("entity_type"), F.struct("source").alias("attributes"))
    form = F.struct(F.col("normalized_form").alias("text"), F.lit("substance").alias("entity_type"))
    rel = F.struct(text.alias("source_entity"), kind.alias("source_type"), F.lit("treats").alias("relation_type"),
                   F.col("normalized_form").alias("target_entity"), F.lit("disease").alias("target_type"), "context")
    rel2 = F.struct(text.alias("source_entity"), F.lit("affects").alias("relation_type"), F.lit("kidney").alias("target_entity"))
    first = F.to_json(entity)
    first = F.when(i % 17 == 0, F.regexp_replace(first, '"entity_type":"[^"]*"', '"entity_type":{}')).otherwise(first)
    body = F.concat(
        F.lit('{"entities":['), first, F.lit(',{"text":"","entity_type":"finding"},'), F.to_json(form),
        F.lit(',{"text":"chest pain","entity_type":5},{"text":"renal biopsy"}'),
        F.when(i % 7 == 0, F.lit(",]")).otherwise(F.lit("]")),
        F.lit(',"relations":['), F.to_json(rel), F.lit(","), F.to_json(rel2), F.lit("]}"))
    fenced = F.when(i % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    prose = F.when(i % 11 == 0, F.concat(F.lit("Here it is: "), fenced, F.lit(" Done."))).otherwise(fenced)
    raw = F.when(i % 13 == 0, F.lit("I found nothing { sorry")).otherwise(prose)
    return m.select("doc_id", F.floor(i / n_docs).cast("int").alias("chunk_index"), raw.alias("raw"), "mention_id",
                    F.col("context").alias("body"))


def _array(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _sql_triples() -> str:
    B, T, R = BASE, TYPES, RELATIONS
    ng = "CAST(NULL AS VARCHAR)"
    part_class = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{T}{v}'" for k, v in PART_CLASSES.items()) + " END"

    def unit(src, tab, key, graph, items):
        return [
            f"SELECT '{B}{src}/' || {key} AS s, {p} AS p, {o} AS o, '{kind}' AS o_kind, {graph} AS g, '{src}' AS src FROM {tab}"
            for p, o, kind in items
        ]

    q = lambda v: f"'{v}'"
    out = unit("region", "region", "r_regionkey", ng,
               [(q(RDF_TYPE), q(T + "Organ"), "uri"), (q(RDFS_LABEL), "r_name", "literal")])
    out += unit("nation", "nation", "n_nationkey", ng, [
        (q(RDF_TYPE), q(T + "Finding"), "uri"), (q(RDFS_LABEL), "n_name", "literal"),
        (q(R + "located_in"), f"'{B}region/' || n_regionkey", "uri")])
    out += unit("supplier", "supplier", "s_suppkey", q(SUPPLIER_GRAPH), [
        (q(RDF_TYPE), q(T + "Procedure"), "uri"), (q(RDFS_LABEL), "s_name", "literal"),
        (q(R + "located_in"), f"'{B}nation/' || s_nationkey", "uri")])
    out += unit("customer", "customer", "c_custkey", ng, [
        (q(RDF_TYPE), q(T + "Disease"), "uri"), (q(RDFS_LABEL), "c_name", "literal"),
        (q(R + "affects"), f"'{B}nation/' || c_nationkey", "uri")])
    out += unit("part", "part", "p_partkey", ng, [
        (q(RDF_TYPE), part_class, "uri"), (q(RDFS_LABEL), "p_name || ' ' || p_size", "literal"),
        (q(SKOS_PREF), "p_name", "literal"), (q(SKOS_ALT), "p_brand || ' ' || p_name", "literal")])
    out.append(
        f"SELECT DISTINCT '{B}supplier/' || l_suppkey AS s, '{R}treats' AS p, '{B}part/' || l_partkey AS o, "
        f"'uri' AS o_kind, {ng} AS g, 'lineitem' AS src FROM lineitem WHERE l_linenumber = 1")
    for c, p in PARENT_CLASSES.items():
        out.append(f"SELECT DISTINCT '{T}{c}', '{RDFS_SUBCLASS}', '{T}{p}', 'uri', {ng}, 'classes' FROM region")
    return " UNION ALL ".join(out)


def _band(x: str, last: str) -> str:
    return f"CASE WHEN {x} >= 0.75 THEN 'passed' WHEN {x} >= 0.5 THEN 'needs_review' WHEN {x} >= 0.25 THEN 'failed' ELSE '{last}' END"


def _cut(p: str) -> str:
    """End of the chunk that starts at p: after the last sentence end, else after the last blank."""
    e = f"least({p} + 2000, n)"
    stop = f"length(regexp_extract(substr(text, {e} - 199, 200), '(?s)^.*[.!?][ \n]'))"
    space = f"instr(reverse(substr(text, {e} - 49, 50)), ' ')"
    return f"""CASE WHEN {e} >= n THEN n WHEN {stop} > 0 THEN {e} - 200 + {stop}
  WHEN {space} BETWEEN 1 AND 49 THEN {e} - {space} + 1 ELSE {e} END"""


CTE = {
    "triples": _sql_triples(),
    "mentions": f"""
SELECT i AS mention_id, i % nd AS doc_id,
  CASE WHEN i % 97 = 0 THEN [substr(p_name, 1, 1), '--', '12.5', '<' || p_name || '>',
      'male patients with ' || p_name, 'one two three four five six seven ' || p_name, 'the',
      'rare ' || p_name || ' seen with cough', 'a long thing seen with ' || p_name][(i // 97) % 9 + 1]
    WHEN event_type = 'purchase' THEN p_name || ' ' || p_size
    WHEN event_type = 'click' THEN upper(p_name || ' ' || p_size)
    WHEN event_type = 'view' THEN p_name || ' scan test'
    WHEN event_type = 'error' THEN substr(p_name, 1, 1) || substr(p_name, 3)
    ELSE 'zz ' || reverse(p_name) END AS text,
  CASE WHEN i % 389 = 0 THEN 'gadget' ELSE {_array(ENTITY_TYPES)}[i % 14 + 1] END AS entity_type,
  least(1.0::DOUBLE, value / 100) AS confidence,
  CASE WHEN i % 4 = 0 THEN p_name END AS normalized_form,
  CASE WHEN i % 5 <> 0 THEN p_name || ' in ' || p_type END AS context,
  ['llm', 'bert', 'langextract'][user_id % 3 + 1] AS source,
  'model_' || (user_id % 2) AS source_model, ts AS created_at, event_type AS kind, value
FROM (SELECT *, event_id AS i, (SELECT count(*) FROM documents) AS nd, event_id % (SELECT count(*) FROM part) AS k FROM events) e
JOIN part ON p_partkey = k""",
    "relations": f"""
SELECT (rid * 100000 + l_partkey) * 100000 + l_suppkey * 50 + CAST(l_quantity AS BIGINT) AS relation_id, l_orderkey AS doc_id, p_name AS source_entity,
  {_array(ENTITY_TYPES)}[l_partkey % 14 + 1] AS source_type,
  CASE WHEN rid % 101 = 0 THEN 'unknown_rel' ELSE {_array(RELATION_TYPES)}[(l_orderkey + l_linenumber) % 12 + 1] END AS relation_type,
  CASE WHEN rid % 97 = 0 THEN p_name ELSE s_name END AS target_entity,
  {_array(ENTITY_TYPES)}[l_suppkey % 14 + 1] AS target_type, l_quantity / 50 AS confidence,
  CASE WHEN l_returnflag <> 'N' THEN p_name || ' for ' || s_name END AS context,
  CASE WHEN l_linestatus = 'O' THEN 'both' ELSE 'llm' END AS source, l_shipdate AS created_at, l_returnflag AS flag
FROM (SELECT *, l_orderkey * 8 + l_linenumber AS rid FROM lineitem) l
JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
    "pending_entities": """
SELECT mention_id AS id, text, entity_type, normalized_form AS normalized_text,
  CASE WHEN source <> 'bert' THEN least(1.0::DOUBLE, value / 200) END AS similarity_score,
  CASE kind WHEN 'view' THEN 'similar_match' WHEN 'click' THEN 'exact_match' ELSE 'not_found' END AS validation_status,
  source, source_model, confidence, context,
  CASE kind WHEN 'error' THEN 'rejected' WHEN 'purchase' THEN 'approved' ELSE 'pending' END AS status,
  created_at, kind, value FROM mentions""",
    "entity_reviews": f"""
SELECT *, {_band('overall_score', 'pending')} AS review_status,
  CASE WHEN overall_score >= 0.75 THEN 'approve' WHEN overall_score >= 0.5 THEN 'manual_review' WHEN overall_score >= 0.25 THEN 'reject' END AS recommendation,
  'auto' AS reviewed_by, CAST(NULL AS VARCHAR) AS review_notes
FROM (SELECT mention_id + 1000000 AS id, CASE WHEN kind <> 'signup' THEN mention_id END AS pending_entity_id,
  text AS entity_text, entity_type, """ + ", ".join(
        f"round(least(1.0::DOUBLE, value / {d}), 3) AS {n}_score" for n, d in
        [("congruence", 100), ("coverage", 150), ("constraint", 80), ("completeness", 90),
         ("consistency", 110), ("overall", 120)]) + """, created_at
  FROM mentions WHERE kind IN ('click', 'view', 'signup')) r""",
    "relation_reviews": f"""
SELECT *, {_band('overall_score', 'pending')} AS review_status,
  CASE WHEN overall_score >= 0.75 THEN 'approve' WHEN overall_score >= 0.5 THEN 'manual_review' ELSE 'reject' END AS recommendation
FROM (SELECT relation_id + 1000000 AS id, relation_id AS pending_relation_id, source_entity, source_type, relation_type,
  target_entity, target_type, """ + ", ".join(
        f"round(confidence * {k}::DOUBLE, 3) AS {n}_score" for n, k in
        [("congruence", "1.0"), ("coverage", "0.8"), ("constraint", "0.7"), ("completeness", "0.6"),
         ("consistency", "0.5"), ("overall", "0.9")]) + """, created_at
  FROM relations WHERE flag = 'R') r""",
    "tokens": f"""
SELECT doc_id, pos, words, CAST(pos // 20 AS INTEGER) AS sentence_id,
  CASE WHEN length(words) % 4 = 0 THEN 'B-' || {_array(ENTITY_TYPES)}[length(words) % 14 + 1]
       WHEN length(words) % 4 = 1 THEN 'I-' || {_array(ENTITY_TYPES)}[length(words) % 14 + 1]
       ELSE 'O' END AS labels
FROM (SELECT doc_id, unnest(w) AS words, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS pos
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> '') AS w FROM documents) d) t""",
    "toks": """
SELECT doc_id, pos, CAST(sum(brk) OVER w AS INTEGER) AS sentence_id, CAST(e - length(token) AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", gap, token,
  lag(e) OVER w AS prev_end
FROM (SELECT *, sum(length(gap) + length(token)) OVER w AS e,
    CASE WHEN pos > 0 AND (contains(gap, chr(10)) OR lag(right(token, 1)) OVER w IN ('.', '!', '?')) THEN 1 ELSE 0 END AS brk
  FROM (SELECT doc_id, unnest(w) AS token, unnest(g[1:len(w)]) AS gap, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS pos
    FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> '') AS w,
      regexp_split_to_array(text, '[^ \n]+') AS g FROM documents) d) t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) u
WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""",
    "preds": f"""
SELECT doc_id, pos, idx, start, "end", gap, token, is_subword,
  CASE WHEN length(token) % 4 = 0 THEN 'B-' || k WHEN length(token) % 4 = 1 THEN 'I-' || k ELSE 'O' END AS label
FROM (SELECT *, {_array(ENTITY_TYPES)}[length(token) // 4 % 3 + 1] AS k FROM (
  SELECT doc_id, pos, pos * 2 AS idx, start, CASE WHEN length(token) > 7 THEN start + 4 ELSE "end" END AS "end", gap,
    CASE WHEN length(token) > 7 THEN substr(token, 1, 4) ELSE token END AS token, false AS is_subword FROM toks
  UNION ALL SELECT doc_id, pos, pos * 2 + 1, start + 4, "end", '', substr(token, 5), true FROM toks WHERE length(token) > 7) p) q""",
    "token_entities": f"""
SELECT doc_id, pos AS ord, start + pos % 2 AS start, "end" + pos % 3 * 3 AS "end", {_array(ENTITY_TYPES)}[pos % 14 + 1] AS entity_type
FROM toks""",
    "parsed": """
SELECT * FROM (SELECT mention_id AS i, doc_id, CAST(mention_id // (SELECT count(*) FROM documents) AS INTEGER) AS chunk_index, pos, context,
  CASE pos WHEN 0 THEN text WHEN 2 THEN normalized_form WHEN 3 THEN 'chest pain' ELSE 'renal biopsy' END AS text,
  CASE pos WHEN 0 THEN CASE WHEN mention_id % 17 = 0 THEN NULL ELSE entity_type END WHEN 2 THEN 'substance' WHEN 3 THEN '5' END AS entity_type
FROM mentions, (VALUES (0), (2), (3), (4)) v(pos) WHERE mention_id % 13 <> 0) x WHERE text IS NOT NULL""",
    "parsed_relations": """
SELECT * FROM (SELECT mention_id AS i, doc_id, CAST(mention_id // (SELECT count(*) FROM documents) AS INTEGER) AS chunk_index, pos, text AS source_entity,
  CASE pos WHEN 0 THEN entity_type ELSE 'unknown' END AS source_type, CASE pos WHEN 0 THEN 'treats' ELSE 'affects' END AS relation_type,
  CASE pos WHEN 0 THEN normalized_form ELSE 'kidney' END AS target_entity, CASE pos WHEN 0 THEN 'disease' ELSE 'unknown' END AS target_type,
  CASE pos WHEN 0 THEN coalesce(context, '') ELSE '' END AS context
FROM mentions, (VALUES (0), (1)) v(pos) WHERE mention_id % 13 <> 0 AND mention_id % 7 <> 0) x WHERE target_entity IS NOT NULL""",
    "chunks": r"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS chunk_index,
  CAST(start AS INTEGER) AS start_char, CAST(stop AS INTEGER) AS end_char, piece AS text
FROM (SELECT doc_id, start, stop, CASE WHEN n <= 2000 THEN text ELSE trim(substr(text, start + 1, stop - start), ' ' || chr(10)) END AS piece
  FROM cuts JOIN (SELECT doc_id, text, length(text) AS n FROM documents) d USING (doc_id)) c WHERE piece <> ''""",
    "cuts": r"""
SELECT doc_id, 0 AS start, """ + _cut("0") + r""" AS stop FROM (SELECT doc_id, text, length(text) AS n FROM documents) d WHERE n > 0
UNION ALL
SELECT doc_id, p, """ + _cut("p") + r""" FROM (SELECT doc_id, text, n, greatest(start + 1, stop - 200) AS p
  FROM cuts JOIN (SELECT doc_id, text, length(text) AS n FROM documents) d USING (doc_id) WHERE stop < n) q""",
}
_NEEDS = {
    "preds": ["toks"], "token_entities": ["toks"], "parsed": ["mentions"], "parsed_relations": ["mentions"], "chunks": ["cuts"],
    "pending_entities": ["mentions"], "entity_reviews": ["mentions"], "relation_reviews": ["relations"],
}


def with_tables(*names: str, body: str, extra: dict[str, str] | None = None) -> str:
    """SQL with the named derived tables in front of the body, in dependency order."""
    order: list[str] = []
    for n in names:
        for dep in _NEEDS.get(n, []) + [n]:
            if dep not in order:
                order.append(dep)
    parts = [f"{n} AS ({CTE[n]})" for n in order] + [f"{k} AS ({v})" for k, v in (extra or {}).items()]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body
