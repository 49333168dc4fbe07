"""Registered queries: model answers, positions, merging and token labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.functions.labels import label_id
from kgspark.operators import decode as C, prepare as P
from kgspark.plans import sqlkit as Q
from kgspark.sources import fixtures as X
from kgspark.vocab import CLASS_NAMES, ENTITY_TYPES, TOKEN_LABELS

KEYS = ["doc_id", "chunk_index"]


def parse(spark, d):
    e = C.parse_entities(X.responses(spark, d), KEYS)
    return e.select(*KEYS, "pos", "text", "entity_type", F.coalesce(F.element_at("attributes", F.lit("source")), F.lit("")).alias("origin"))


def parse_relations(spark, d):
    return C.parse_relations(X.responses(spark, d), KEYS)


def repair(spark, d):
    picked = X.responses(spark, d).withColumn("json", C.select_json_object(F.col("raw")))
    return C.repaired_entities(picked, KEYS, "json")


def select_json(spark, d):
    j = C.select_json_object(F.col("raw"))
    return X.responses(spark, d).select("mention_id", j.alias("j")).select(
        "mention_id", F.col("j").isNotNull().alias("found"), F.get_json_object("j", "$.relations[1].target_entity").alias("target"))


def _bodies(spark, d):
    return X.docs(spark, d).select("doc_id", F.col("text").alias("body"))


def _needles(spark, d):
    """The words of each document, plain ASCII ones in capitals, and a text that is not there."""
    t = X.tokens(spark, d)
    word = F.when(F.col("words").rlike("^[a-zA-Z]+$") & (F.col("pos") % 2 == 0), F.upper("words")).otherwise(F.col("words"))
    text = F.when(F.col("pos") % 10 == 3, F.concat(F.lit("zz-"), F.col("words"))).otherwise(word)
    return t.select("doc_id", "pos", text.alias("text"))


def locate(spark, d):
    r = C.locate_mentions(_needles(spark, d), _bodies(spark, d), ["doc_id"])
    return r.select("doc_id", "pos", "text", "start_position", "end_position", "context")


def locate_relations(spark, d):
    n = _needles(spark, d).groupBy("doc_id", F.floor(F.col("pos") / 200).alias("part"))
    rel = n.agg(F.min_by("text", "pos").alias("source_entity"), F.max_by("text", "pos").alias("target_entity"))
    return C.locate_relations(rel, _bodies(spark, d), ["doc_id"])


def _chunk_entities(spark, d):
    chunks = P.chunk_text(X.docs(spark, d))
    words = F.filter(F.split("text", "[ \n]+"), lambda w: w != "")
    e = chunks.select(*KEYS, F.posexplode(words).alias("pos", "text"))
    e = e.withColumn("entity_type", X.pick(ENTITY_TYPES, F.length("text") % 14))
    bodies = chunks.select(*KEYS, F.col("text").alias("body"))
    return C.locate_mentions(e, bodies, KEYS), chunks


def merge_entities(spark, d):
    e, chunks = _chunk_entities(spark, d)
    r = C.merge_chunk_entities(e.drop("context"), chunks)  # the result has no contexts: merging need not move them
    return r.select("doc_id", "chunk_index", "text", "entity_type", "start_position", "end_position")


def merge_unshifted(spark, d):
    e, chunks = _chunk_entities(spark, d)
    r = C.merge_chunk_entities(e.drop("context"), chunks, shift=False)
    return r.select("doc_id", "chunk_index", "text", "entity_type", "start_position", "end_position")


def merge_extractions(spark, d):
    answers = X.responses(spark, d)
    e, r = C.merge_chunk_extractions(C.parse_entities(answers, KEYS), C.parse_relations(answers, KEYS))
    one = e.select("doc_id", F.lit("entity").alias("part"), "chunk_index", "pos", "text", F.col("entity_type").alias("kind"), F.lit("").alias("target"))
    two = r.select("doc_id", F.lit("relation").alias("part"), "chunk_index", "pos", F.col("source_entity").alias("text"),
                   F.col("relation_type").alias("kind"), F.col("target_entity").alias("target"))
    return one.unionByName(two)


def occurrences(spark, d):
    ex = X.tokens(spark, d).select("doc_id", F.col("pos").cast("bigint").alias("ord"), F.col("words").alias("text"))
    return C.assign_occurrences(ex, _bodies(spark, d))


def bio(spark, d):
    return C.decode_bio(X.preds(spark, d))


def bio_text(spark, d):
    spans = C.decode_bio(X.preds(spark, d)).select("doc_id", "start", "end", "entity_type")
    return C.slice_texts(spans, _bodies(spark, d))


def tag(spark, d):
    toks = P.tokenize_spans(X.docs(spark, d)).select("doc_id", "pos", "start", "end")
    return C.tag_iob(toks, X.token_entities(spark, d)).select("doc_id", "pos", "label")


def iob_entities(spark, d):
    return C.iob_to_entities(X.tokens(spark, d), ["doc_id"])


def _judged(spark, d):
    t = X.tokens(spark, d)
    gold = F.when(F.col("pos") % 11 == 0, F.lit(-100)).otherwise(label_id(F.col("labels")))
    pred = F.when(F.col("pos") % 7 == 0, F.lit(0)).otherwise(label_id(F.col("labels")))
    return t.select("doc_id", pred.alias("pred"), gold.alias("label"))


def accuracy(spark, d):
    return C.token_accuracy(_judged(spark, d), ["doc_id"])


def subwords(spark, d):
    p = X.preds(spark, d)
    pieces = p.select("doc_id", F.col("idx").alias("pos"), F.when(F.col("idx") % 40 != 0, F.col("pos")).alias("word_id"))
    words = X.tokens(spark, d).select("doc_id", F.col("pos").alias("word_id"), label_id(F.col("labels")).alias("label_id"))
    return C.align_subword_labels(pieces, words, ["doc_id"])


def batch(spark, d):
    """Answers per text, located in that text; nothing is merged across texts."""
    r = X.responses(spark, d)
    e = C.parse_entities(r, ["mention_id"])
    return C.locate_mentions(e, r.filter("body IS NOT NULL").select("mention_id", "body"), ["mention_id"]).select(
        "mention_id", "pos", "text", "start_position", "end_position", "context")


def splits(spark, d):
    part = F.when(F.col("doc_id") % 10 == 8, F.lit("dev")).when(F.col("doc_id") % 10 == 9, F.lit("test")).otherwise(F.lit("train"))
    return C.corpus_split_sizes(X.tokens(spark, d).select(part.alias("split"), F.col("doc_id").alias("file"), "sentence_id"))


QUERIES = {
    "parse_responses": parse,
    "parse_response_relations": parse_relations,
    "repair_json": repair,
    "select_json_object": select_json,
    "locate_mention": locate,
    "locate_relation": locate_relations,
    "merge_chunk_entities": merge_entities,
    "merge_chunk_entities_unshifted": merge_unshifted,
    "merge_chunk_extractions": merge_extractions,
    "assign_occurrences": occurrences,
    "decode_bio": bio,
    "decode_bio_text": bio_text,
    "tag_iob": tag,
    "iob_to_entities": iob_entities,
    "token_accuracy": accuracy,
    "align_subword_labels": subwords,
    "batch_extract": batch,
    "corpus_split_sizes": splits,
}

_words = """SELECT doc_id, pos, CASE WHEN pos % 10 = 3 THEN 'zz-' || words WHEN regexp_full_match(words, '[a-zA-Z]+') AND pos % 2 = 0 THEN upper(words) ELSE words END AS text
FROM tokens"""
_id = lambda x: f"CAST(coalesce(list_position({Q.array(TOKEN_LABELS)}, {x}), 1) - 1 AS INTEGER)"


def _window(lo: str, hi: str, margin: int, body: str = "body") -> str:
    a, b = f"greatest(0, {lo} - {margin})", f"least(length({body}), {hi} + {margin})"
    return (f"CASE WHEN {a} > 0 THEN '...' ELSE '' END || substr({body}, {a} + 1, {b} - {a}) || "
            f"CASE WHEN {b} < length({body}) THEN '...' ELSE '' END")


_spans1 = """SELECT doc_id, span, min(CASE WHEN r THEN kind END) AS entity_type, arg_min(start, idx) AS start, arg_max("end", idx) AS "end",
  arg_min(blanks, idx) AS ahead, arg_max(blanks, idx) AS behind FROM spanned GROUP BY doc_id, span"""
_bio = {
    "marked": """SELECT *, start < "end" AS r, CASE WHEN label <> 'O' THEN substr(label, 3) END AS kind, regexp_matches(gap, '[ \n]') AS blank,
  coalesce(lag("end") OVER w, -1) AS prev_end, coalesce(lag(CASE WHEN label <> 'O' THEN substr(label, 3) ELSE '' END) OVER w, '') AS was
  FROM preds WINDOW w AS (PARTITION BY doc_id ORDER BY idx)""",
    "spanned": """SELECT *, sum(CASE WHEN kind IS NULL OR NOT (was = kind AND (starts_with(label, 'I-') OR start = prev_end
    OR (start <= prev_end + 1 AND trim(gap, ' ' || chr(10)) = '') OR is_subword OR (prev_end > 0 AND start > prev_end AND NOT blank))) THEN 1 ELSE 0 END) OVER w AS span,
  sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER w AS blanks FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY idx)""",
    "named": f"SELECT * FROM ({_spans1}) s WHERE entity_type IS NOT NULL",
    "joined": """SELECT *, sum(CASE WHEN near THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY span) AS grp FROM (
  SELECT *, coalesce(lag(entity_type) OVER w = entity_type AND start <= lag("end") OVER w + 2 AND (start <= lag("end") OVER w OR ahead = lag(behind) OVER w), false) AS near
  FROM named WINDOW w AS (PARTITION BY doc_id ORDER BY span)) n""",
    "decoded": """SELECT doc_id, CAST(min(start) AS INTEGER) AS start, CAST(max("end") AS INTEGER) AS "end", min(entity_type) AS entity_type, 0.9::DOUBLE AS confidence
  FROM joined GROUP BY doc_id, grp""",
}
_chunk_words = f"""SELECT doc_id, chunk_index, pos, word AS text, {Q.array(ENTITY_TYPES)}[length(word) % 14 + 1] AS entity_type,
  instr(lower(body), lower(word)) - 1 AS loc, start_char FROM (SELECT doc_id, chunk_index, start_char, text AS body, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos
  FROM (SELECT *, list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> '') AS w FROM chunks) c) e"""
_rank = "row_number() OVER (PARTITION BY {} ORDER BY chunk_index, pos) = 1"

ORACLES = {
    "parse_responses": X.with_tables("parsed", body="""SELECT doc_id, chunk_index, pos, text, entity_type,
CASE WHEN pos = 0 THEN (SELECT source FROM mentions m WHERE m.mention_id = i) ELSE '' END AS origin FROM parsed WHERE i % 7 <> 0 AND entity_type IS NOT NULL"""),
    "parse_response_relations": X.with_tables("parsed_relations", body="""SELECT doc_id, chunk_index, CAST(pos AS INTEGER) AS pos, source_entity, source_type, relation_type,
target_entity, target_type, context FROM parsed_relations"""),
    "repair_json": X.with_tables("parsed", body="""SELECT doc_id, chunk_index, pos, text, CASE WHEN pos = 0 AND entity_type IS NULL THEN 'finding'
WHEN pos = 3 THEN 'symptom' WHEN pos = 4 THEN 'therapeutic_procedure' ELSE entity_type END AS entity_type FROM parsed"""),
    "select_json_object": X.with_tables("mentions", body="""SELECT mention_id, mention_id % 13 <> 0 AS found,
CASE WHEN mention_id % 13 <> 0 AND mention_id % 7 <> 0 THEN 'kidney' END AS target FROM mentions"""),
    "locate_mention": X.with_tables("tokens", extra={"needles": _words, "hits": "SELECT n.doc_id, pos, n.text, d.text AS body, instr(lower(d.text), lower(n.text)) - 1 AS loc FROM needles n JOIN documents d USING (doc_id)"}, body=f"""
SELECT doc_id, pos, text, CASE WHEN loc >= 0 THEN CAST(loc AS INTEGER) END AS start_position, CASE WHEN loc >= 0 THEN CAST(loc + length(text) AS INTEGER) END AS end_position,
CASE WHEN loc >= 0 THEN {_window('loc', '(loc + length(text))', 50)} END AS context FROM hits"""),
    "locate_relation": X.with_tables("tokens", extra={"needles": _words, "ends": """SELECT doc_id, pos // 200 AS part, arg_min(text, pos) AS source_entity, arg_max(text, pos) AS target_entity FROM needles GROUP BY 1, 2""",
        "hits": "SELECT e.*, d.text AS body, instr(lower(d.text), lower(source_entity)) - 1 AS a, instr(lower(d.text), lower(target_entity)) - 1 AS b FROM ends e JOIN documents d USING (doc_id)"}, body=f"""
SELECT doc_id, CAST(part AS BIGINT) AS part, source_entity, target_entity, CASE WHEN a >= 0 AND b >= 0 THEN
{_window('least(a, b)', 'greatest(a + length(source_entity), b + length(target_entity))', 30)} END AS context FROM hits"""),
    "merge_chunk_entities": X.with_tables("chunks", extra={"words": _chunk_words}, body=f"""SELECT doc_id, chunk_index, text, entity_type,
CAST(loc + start_char AS INTEGER) AS start_position, CAST(loc + start_char + length(text) AS INTEGER) AS end_position
FROM words QUALIFY {_rank.format('doc_id, lower(text), entity_type')}"""),
    "merge_chunk_entities_unshifted": X.with_tables("chunks", extra={"words": _chunk_words}, body=f"""SELECT doc_id, chunk_index, text, entity_type,
CAST(loc AS INTEGER) AS start_position, CAST(loc + length(text) AS INTEGER) AS end_position FROM words QUALIFY {_rank.format('doc_id, lower(text), entity_type')}"""),
    "merge_chunk_extractions": X.with_tables("parsed", "parsed_relations", body=f"""
SELECT * FROM (SELECT doc_id, 'entity' AS part, chunk_index, CAST(pos AS INTEGER) AS pos, text, entity_type AS kind, '' AS target FROM parsed WHERE i % 7 <> 0 AND entity_type IS NOT NULL
  QUALIFY {_rank.format('doc_id, lower(trim(text)), entity_type')}) a
UNION ALL SELECT * FROM (SELECT doc_id, 'relation', chunk_index, CAST(pos AS INTEGER), source_entity, relation_type, target_entity FROM parsed_relations
  QUALIFY {_rank.format('doc_id, lower(trim(source_entity)), relation_type, lower(trim(target_entity))')}) b"""),
    "decode_bio": X.with_tables("preds", extra=_bio, body="SELECT * FROM decoded"),
    "decode_bio_text": X.with_tables("preds", extra=_bio, body="""SELECT doc_id, start, "end", entity_type, substr(text, start + 1, "end" - start) AS text
FROM decoded JOIN documents USING (doc_id)"""),
    "tag_iob": X.with_tables("toks", "token_entities", body=f"""SELECT t.doc_id, t.pos, coalesce(arg_min(CASE WHEN
  CASE WHEN t.start >= e.start AND t."end" <= e."end" THEN coalesce(t.prev_end <= e.start, true) ELSE t.start <= e.start END THEN 'B-' ELSE 'I-' END
  || {Q.mapping(CLASS_NAMES)}[e.entity_type], [e.start, e.ord]), 'O') AS label
FROM toks t LEFT JOIN token_entities e ON t.doc_id = e.doc_id AND t.start < e."end" AND t."end" > e.start GROUP BY t.doc_id, t.pos"""),
    "iob_to_entities": X.with_tables("tokens", body="""SELECT doc_id, CAST(entity_no AS BIGINT) AS entity_no, string_agg(words, ' ' ORDER BY pos) AS text, arg_min(substr(labels, 3), pos) AS entity_type
FROM (SELECT *, sum(CASE WHEN labels LIKE 'B-%' THEN 1 ELSE 0 END) OVER w AS entity_no,
  last_value(CASE WHEN labels LIKE 'B-%' THEN 'B' WHEN labels = 'O' THEN 'O' END IGNORE NULLS) OVER w AS state FROM tokens
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) t
WHERE state = 'B' AND labels <> 'O' GROUP BY doc_id, entity_no"""),
    "token_accuracy": X.with_tables("tokens", body=f"""SELECT doc_id, count(*) AS total_tokens, count(*) FILTER (pos % 7 <> 0 OR {_id('labels')} = 0) AS correct_tokens,
count(*) FILTER (pos % 7 <> 0 OR {_id('labels')} = 0) / count(*)::DOUBLE AS accuracy FROM tokens WHERE pos % 11 <> 0 GROUP BY doc_id"""),
    "align_subword_labels": X.with_tables("preds", "tokens", extra={"pieces": "SELECT doc_id, idx AS pos, CASE WHEN idx % 40 <> 0 THEN pos END AS word_id FROM preds"}, body=f"""
SELECT p.doc_id, p.pos, p.word_id, CASE WHEN p.word_id IS NOT NULL AND p.word_id IS DISTINCT FROM p.was THEN {_id('t.labels')} ELSE -100 END AS label_id
FROM (SELECT *, lag(word_id) OVER (PARTITION BY doc_id ORDER BY pos) AS was FROM pieces) p LEFT JOIN tokens t ON t.doc_id = p.doc_id AND t.pos = p.word_id"""),
    "batch_extract": X.with_tables("parsed", extra={"hits": "SELECT *, instr(lower(context), lower(text)) - 1 AS loc FROM parsed WHERE i % 7 <> 0 AND entity_type IS NOT NULL"}, body=f"""
SELECT i AS mention_id, CAST(pos AS INTEGER) AS pos, text, CASE WHEN loc >= 0 THEN CAST(loc AS INTEGER) END AS start_position, CASE WHEN loc >= 0 THEN CAST(loc + length(text) AS INTEGER) END AS end_position,
CASE WHEN loc >= 0 THEN {_window('loc', '(loc + length(text))', 50, 'context')} END AS context FROM hits"""),
    "corpus_split_sizes": X.with_tables("tokens", body="""SELECT CASE doc_id % 10 WHEN 8 THEN 'dev' WHEN 9 THEN 'test' ELSE 'train' END AS split,
count(DISTINCT (doc_id, sentence_id)) AS sentences FROM tokens GROUP BY 1"""),
}
