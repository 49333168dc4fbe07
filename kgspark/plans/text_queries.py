"""Registered queries: documents, chunks, sentences, tokens, prompts and token files."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.operators import dictionary as D, prepare as P
from kgspark.plans import sqlkit as Q
from kgspark.sources import documents as S, fixtures as X, iob, triples as T
from kgspark.functions.text import strip
from kgspark.vocab import CANONICAL_KG_TYPES, LABEL_PREDICATES, RDF_TYPE, TOKEN_LABELS

SYSTEM = "You read clinical text."
EXTRA = "Prefer short names. " * 60


def chunks(spark, d):
    return P.chunk_text(X.docs(spark, d))


def clean(spark, d):
    t = X.docs(spark, d)
    # Twice the text with mixed blanks between, so that every rule has work to do.
    messy = F.concat("text", F.lit(" \t \n \n\n\n \n"), F.replace("text", F.lit(" "), F.lit(" \t")))
    return t.select("doc_id", P.clean_text(messy).alias("text"))


def oversize(spark, d):
    return P.split_oversize(chunks(spark, d).select("doc_id", "chunk_index", "text"), 900)


def sampled(spark, d):
    return P.few_shot_sample(D.build_entity_dict(X.triples(spark, d)), seed=7)


def stratified(spark, d):
    return P.few_shot_sample(D.build_entity_dict(X.triples(spark, d)), seed=7, stratified=True)


def block(spark, d):
    custom = X.table(spark, d, "region").select(F.col("r_name").alias("text"), F.lit("organ").alias("entity_type"))
    return P.few_shot_block(sampled(spark, d), custom)


def fingerprint(spark, d):
    listing = X.triples(spark, d).groupBy(F.col("src").alias("name")).agg(
        F.sum(F.length("o")).alias("size"), F.count(F.lit(1)).alias("mtime"))
    return T.snapshot_fingerprint(listing)


def iob_csv(spark, d):
    raw = X.tokens(spark, d).withColumns({"words": F.concat(F.lit(" "), F.col("words")), "labels": F.when(F.col("pos") % 9 != 0, F.col("labels"))})
    s = iob.sentences(iob.clean_tokens(raw), ["doc_id", "sentence_id"])
    return s.select("doc_id", "sentence_id", F.array_join("words", " ").alias("words"),
                    F.array_join(F.transform("label_ids", lambda x: x.cast("string")), " ").alias("label_ids"))


def iob_lines(spark, d):
    """Sentences as blocks of lines; some blank lines carry blanks, some lines have one field."""
    t = X.tokens(spark, d)
    line = F.when(F.col("pos") % 13 == 0, F.col("words")).otherwise(F.concat_ws(" ", "words", F.lit("x"), "labels"))
    s = t.groupBy("doc_id", "sentence_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("r"))
    b = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sentence_id", F.array_join("r.line", "\n").alias("b")))).alias("r"))
    parsed = iob.parse_iob_lines(b.select("doc_id", F.array_join("r.b", "\n  \n\n").alias("text")), ["doc_id"])
    return parsed.select("doc_id", "sentence_no", "words", "label_id", F.row_number().over(
        X.Window.partitionBy("doc_id", "sentence_no").orderBy("pos")).alias("n"))


def iob_out(spark, d):
    t = X.tokens(spark, d)
    return t.select("doc_id", "pos", iob.iob_csv_line(F.col("words"), F.col("sentence_id"), F.col("labels")).alias("line"))


def iob_profile(spark, d):
    t = X.tokens(spark, d)
    body = t.select(F.col("doc_id").alias("file"), (F.col("pos") + 1).alias("line_no"),
                    F.concat_ws(",", F.replace("words", F.lit(","), F.lit("")), F.col("sentence_id").cast("string"), "labels").alias("line"))
    head = X.docs(spark, d).select(F.col("doc_id").alias("file"), F.lit(0).alias("line_no"),
                                   F.when(F.col("doc_id") % 5 == 0, F.lit("words,labels")).otherwise(F.lit("Words,sentence_id,labels")).alias("line"))
    return iob.iob_file_profile(head.unionByName(body))


def scan(spark, d):
    """Texts as bytes, in two thirds of them with bytes that are not UTF-8; genuine U+FFFD stays."""
    text = F.replace("text", F.lit("e"), F.lit("\ufffd")).cast("binary")
    cut = F.col("doc_id") % 3
    bad = F.when(cut == 0, text).when(cut == 1, F.concat(F.unhex(F.lit("FF")), text, F.unhex(F.lit("E282")))).otherwise(F.concat(text, F.unhex(F.lit("80C0"))))
    read = X.docs(spark, d).select("doc_id", S.decoded(bad).alias("text"))
    return S.document_table(read)


QUERIES = {
    "scan_documents": scan,
    "snapshot_fingerprint": fingerprint,
    "clean_text": clean,
    "chunk_text": chunks,
    "document_info": lambda s, d: P.document_info(X.docs(s, d), chunks(s, d)),
    "join_chunks": lambda s, d: P.join_chunks(chunks(s, d)),
    "halve_text": oversize,
    "split_sentences": lambda s, d: P.split_sentences(X.docs(s, d)),
    "tokenize_spans": lambda s, d: P.tokenize_spans(X.docs(s, d)),
    "truncate_context": lambda s, d: X.docs(s, d).select("doc_id", P.truncate_context(F.col("text")).alias("context")),
    "build_prompts": lambda s, d: P.build_prompts(chunks(s, d), SYSTEM, "EXAMPLE\n\n", EXTRA, "none"),
    "few_shot_sample": sampled,
    "few_shot_sample_stratified": stratified,
    "few_shot_block": block,
    "read_iob_csv": iob_csv,
    "read_iob_lines": iob_lines,
    "write_iob_csv": iob_out,
    "iob_file_profile": iob_profile,
}

_id = lambda x: f"CAST(coalesce(list_position({Q.array(TOKEN_LABELS)}, {x}), 1) - 1 AS INTEGER)"
_sent = """SELECT doc_id, sentence_id, CAST(min(start) AS INTEGER) AS start, CAST(max("end") AS INTEGER) AS "end" FROM toks GROUP BY doc_id, sentence_id"""

# A piece of more than 900 characters is cut at the sentence end nearest the middle, else at a line end, else there.
_near = "flatten(list_transform(range(least(500, length(text) // 4)), lambda i: [length(text) // 2 - i, length(text) // 2 + i]))"
_blank = "' ' || chr(10) || chr(9) || chr(13)"
_halved = f"""SELECT doc_id, chunk_index, '' AS path, text, 0 AS depth FROM chunks
UNION ALL SELECT doc_id, chunk_index, path || k, CASE k WHEN 0 THEN a ELSE b END, depth + 1 FROM (
  SELECT *, unnest([0, 1]) AS k FROM (SELECT *, trim(substr(text, 1, cut + 1), {_blank}) AS a, trim(substr(text, cut + 2), {_blank}) AS b FROM (
    SELECT *, CASE WHEN stop IS NULL OR stop + 1 = length(text) // 2 THEN coalesce(line, stop, length(text) // 2 - 1) ELSE stop END AS cut FROM (
      SELECT *, list_filter(near, lambda p: substr(text, p + 1, 1) IN ('.', '!', '?') AND substr(text, p + 2, 1) IN (' ', chr(10), chr(9)))[1] AS stop,
        list_filter(near, lambda p: substr(text, p + 1, 1) = chr(10))[1] AS line FROM (
        SELECT *, list_filter({_near}, lambda p: p > 0 AND p < length(text) - 1) AS near FROM halved WHERE length(text) > 900 AND depth < 3) n) s) c) t
  WHERE a <> '' AND b <> '') u"""

ORACLES = {
    "halve_text": X.with_tables("chunks", extra={"halved": _halved}, body="""SELECT doc_id, chunk_index,
CAST(row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY path) - 1 AS INTEGER) AS piece, text
FROM halved h WHERE NOT EXISTS (SELECT 1 FROM halved c WHERE c.doc_id = h.doc_id AND c.chunk_index = h.chunk_index AND c.path = h.path || '0')"""),
    "scan_documents": "SELECT doc_id, replace(text, 'e', chr(65533)) AS text, CAST(length(text) AS INTEGER) AS total_chars FROM documents",
    "snapshot_fingerprint": X.with_tables("triples", body="""SELECT md5(string_agg(e, '|' ORDER BY e)) AS fingerprint, count(*) AS n_files
FROM (SELECT src || ':' || sum(length(o)) || ':' || count(*) AS e FROM triples GROUP BY src) x"""),
    "clean_text": """SELECT doc_id, trim(array_to_string(list_transform(string_split(
  regexp_replace(regexp_replace(text || ' ' || chr(9) || ' ' || chr(10) || ' ' || chr(10) || chr(10) || chr(10) || ' ' || chr(10) || replace(text, ' ', ' ' || chr(9)),
    '[ ' || chr(9) || ']+', ' ', 'g'), chr(10) || '{3,}', chr(10) || chr(10), 'g'),
  chr(10)), lambda x: trim(x)), chr(10)), ' ' || chr(10)) AS text FROM documents""",
    "chunk_text": X.with_tables("chunks", body="SELECT * FROM chunks"),
    "document_info": X.with_tables("chunks", body="""SELECT doc_id, CAST(length(text) AS INTEGER) AS total_chars, coalesce(n, 0) AS total_chunks
FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id) c USING (doc_id)"""),
    "join_chunks": X.with_tables("chunks", body="SELECT doc_id, string_agg(text, chr(10) ORDER BY chunk_index) AS text FROM chunks GROUP BY doc_id"),
    "split_sentences": X.with_tables("toks", body=f"""SELECT doc_id, s.sentence_id, s.start, s."end", substr(text, s.start + 1, s."end" - s.start) AS text
FROM ({_sent}) s JOIN documents USING (doc_id)"""),
    "tokenize_spans": X.with_tables("toks", body='SELECT doc_id, pos, sentence_id, start, "end", gap, token FROM toks'),
    "truncate_context": "SELECT doc_id, substr(text, 1, 500) AS context FROM documents",
    "build_prompts": X.with_tables("chunks", body=f"""SELECT doc_id, chunk_index, '{SYSTEM}' || chr(10) || chr(10) ||
  'Additional entity extraction instructions:' || chr(10) || '{EXTRA[:800]}' || chr(10) || chr(10) || 'Additional relation extraction instructions:' || chr(10) || 'none' AS system_prompt,
  'Find all entities and relations in the text below.' || chr(10) || chr(10) || 'EXAMPLE' || chr(10) || chr(10) || 'TEXT:' || chr(10) || text || chr(10) || chr(10) ||
  'Answer with JSON: "entities" and "relations".' AS user_prompt,
  CAST(least(4096, greatest(1024, 4096 - length(text) // 3)) AS INTEGER) AS max_tokens FROM chunks"""),
    "few_shot_sample_stratified": X.with_tables("triples", body=f"""SELECT uri, label, type FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY md5(uri || ':7'), uri) AS turn FROM (
  SELECT s AS uri, min(o) FILTER (p IN {Q.names(LABEL_PREDICATES)}) AS label, {Q.mapping(CANONICAL_KG_TYPES)}[lower({Q.local_name(f"min(o) FILTER (p = '{RDF_TYPE}')")})] AS type FROM triples GROUP BY s) e
  WHERE label IS NOT NULL AND type IS NOT NULL) x ORDER BY turn, md5(uri || ':7'), uri LIMIT 8"""),
    "few_shot_block": X.with_tables("triples", extra={"sampled": f"""SELECT label, type FROM (SELECT s AS uri, min(o) FILTER (p IN {Q.names(LABEL_PREDICATES)}) AS label,
  {Q.mapping(CANONICAL_KG_TYPES)}[lower({Q.local_name(f"min(o) FILTER (p = '{RDF_TYPE}')")})] AS type FROM triples GROUP BY s) e
  WHERE label IS NOT NULL AND type IS NOT NULL ORDER BY md5(uri || ':7'), uri LIMIT 8""",
      "listed": """SELECT 0 AS part, r_name AS text, 'organ' AS kind, '{}' AS origin FROM region
  UNION ALL SELECT 1, label, type, '{"source":"knowledge_graph"}' FROM sampled WHERE lower(label) NOT IN (SELECT lower(r_name) FROM region)"""}, body="""
SELECT 'EXAMPLE (for reference):' || chr(10) || 'Text: "Clinical findings include: ' || string_agg(text, ', ' ORDER BY part, text, kind) || '."' || chr(10) || 'Expected output:' || chr(10)
  || '{"entities":[' || string_agg('{"text":"' || text || '","entity_type":"' || kind || '","attributes":' || origin || '}', ',' ORDER BY part, text, kind) || '],"relations":[]}' || chr(10) || chr(10) AS block FROM listed"""),
    "few_shot_sample": X.with_tables("triples", body=f"""SELECT uri, label, type FROM (SELECT s AS uri, min(o) FILTER (p IN {Q.names(LABEL_PREDICATES)}) AS label,
  {Q.mapping(CANONICAL_KG_TYPES)}[lower({Q.local_name(f"min(o) FILTER (p = '{RDF_TYPE}')")})] AS type FROM triples GROUP BY s) e
WHERE label IS NOT NULL AND type IS NOT NULL ORDER BY md5(uri || ':7'), uri LIMIT 8"""),
    "read_iob_csv": X.with_tables("tokens", body=f"""SELECT doc_id, sentence_id, string_agg(words, ' ' ORDER BY pos) AS words,
string_agg(CAST({_id("CASE WHEN pos % 9 <> 0 THEN labels ELSE 'O' END")} AS VARCHAR), ' ' ORDER BY pos) AS label_ids FROM tokens GROUP BY doc_id, sentence_id"""),
    "read_iob_lines": X.with_tables("tokens", body=f"""SELECT doc_id, sentence_id AS sentence_no, words, {_id('labels')} AS label_id,
CAST(row_number() OVER (PARTITION BY doc_id, sentence_id ORDER BY pos) AS INTEGER) AS n FROM tokens WHERE pos % 13 <> 0"""),
    "write_iob_csv": X.with_tables("tokens", body="""SELECT doc_id, pos, CASE WHEN words LIKE '%,%' OR words LIKE '%"%' THEN '"' || words || '"' ELSE words END
|| ',' || sentence_id || ',' || labels AS line FROM tokens"""),
    "iob_file_profile": X.with_tables("tokens", body="""SELECT doc_id AS file, doc_id % 5 <> 0 AS header_ok, coalesce(n, 0) AS n_rows, coalesce(k, 0) AS n_sentences
FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n, count(DISTINCT sentence_id) AS k FROM tokens GROUP BY doc_id) t USING (doc_id)"""),
}
