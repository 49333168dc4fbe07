"""The registered queries of this subpackage and the DuckDB SQL they are checked with."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm import bpe, chat, embeddings, exact_dedup, html, jaccard, packing, prefix_trie, secrets, term_pipeline, token_rollup, toxicity, url_filter
from kgspark.llm.common import new_folder, table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_conversations(chat.canonical_turns(chat.table_records(rows))))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents enter under one version, are then revised to two, empty ones are deleted; a replay changes nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    ledger = token_rollup.Ledger(spark, new_folder(docs))
    first = {"words-v1": token_rollup.VERSIONS["words-v1"]}
    ledger.apply("insert", docs, first)
    ledger.apply("revise", docs)
    ledger.apply("delete", docs.where("coalesce(text, '') = ''"), delete=True)
    ledger.apply("insert", docs, first)
    return ledger.totals()


def op5_embedding_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.linked(table(spark, sf_dir, "embeddings"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern).drop("text")
    return bpe.decode(coded, path, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


def op8_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        "sentence_start",
        "sentence_end",
        "sentence_score",
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups_of(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_pipeline.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.judged(table(spark, sf_dir, "pages"), rules)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_main_text": op3_main_text,
    "op4_token_rollup": op4_token_rollup,
    "op5_embedding_caps": op5_embedding_caps,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_secret_scan": op7_secret_scan,
    "op8_toxicity_mil": op8_toxicity_mil,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_ranked_search": op11_ranked_search,
    "op12_url_filter": op12_url_filter,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": corpus_pipeline.run,
}


def _secret_sql() -> str:
    """Every kind's matches with their places: lengths of the pieces between matches, summed up to each match."""
    kinds = []
    for rank, rule in enumerate(secrets.RULES):
        pattern = rule.pattern.replace("'", "''")
        kinds.append(f"""
        SELECT doc_id, k, {rank} AS rank, '{rule.kind}' AS kind,
               list_sum(list_transform(pieces[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0) AS first,
               length(found[k]) AS size, length(groups[k]) AS value, {rule.least} AS least, {rule.base} AS base
        FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS pieces, regexp_extract_all(t, '{pattern}') AS found,
                     regexp_extract_all(t, '{pattern}', {rule.group}) AS groups, unnest(range(1, len(found) + 1)) AS k
              FROM texts)""")
    told = "kind || ':' || first::BIGINT || ':' || (first + size)::BIGINT"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.RULES if r.base)
    zeros = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.RULES if r.base)
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    spans AS (SELECT * FROM ({" UNION ALL ".join(kinds)}) WHERE value >= least),
    per AS (SELECT doc_id, {counts}, string_agg({told}, ',' ORDER BY first, rank) FILTER (base) AS b,
                   string_agg({told}, ',' ORDER BY first, rank) AS spans
            FROM spans GROUP BY doc_id)
    SELECT doc_id, {zeros}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM texts LEFT JOIN per USING (doc_id)"""


ORACLES: dict[str, str] = {
    "op1_chat_format": r"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
    c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
                 coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
                 sum(length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) + length('### :  </turn>') + 1) AS size
          FROM t GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, size::BIGINT AS formatted_chars FROM c""",
    "op4_token_rollup": r"""
    WITH n AS (SELECT source, lang, length(text) AS chars, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS v1,
                      len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]')) AS v2
               FROM documents WHERE coalesce(text, '') <> ''),
    v AS (SELECT source, lang, 'words-v1' AS tokenizer, v1 AS tokens, chars FROM n UNION ALL SELECT source, lang, 'words-v2', v2, chars FROM n)
    SELECT source, lang, tokenizer, count(*) AS docs, sum(tokens)::BIGINT AS tokens, sum(chars)::BIGINT AS chars FROM v GROUP BY ALL""",
    "op7_secret_scan": _secret_sql(),
    "op11_ranked_search": rf"""
    WITH words AS (SELECT row_number() OVER () AS nr, doc_id, unnest(regexp_extract_all(translate(text, '{term_pipeline.UPPER}', '{term_pipeline.LOWER}'), '{term_pipeline.TERM}')) AS term FROM documents),
    tf AS (SELECT nr, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
    docs AS (SELECT nr, sum(tf)::BIGINT AS n FROM tf GROUP BY nr),
    total AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS l FROM docs),
    weights AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term),
    asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{term_pipeline.UPPER}', '{term_pipeline.LOWER}'), '{term_pipeline.TERM}')) AS term FROM benchmark),
    scores AS (SELECT item_id, doc_id, nr, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // l))))::BIGINT AS score
               FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN docs USING (nr), total GROUP BY ALL),
    ranks AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM scores WHERE score > 0)
    SELECT * FROM ranks WHERE rank <= {term_pipeline.BEST}""",
    "op12_url_filter": rf"""
    WITH parts AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    urls AS (SELECT page_id, row_number() OVER () AS nr, translate(regexp_extract(rest, '^[^/?#]*', 0), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
    rules(rh, rp, rv) AS (VALUES {", ".join(str(r) for r in url_filter.RULES)}),
    fits AS (SELECT nr, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
             FROM urls JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY nr)
    SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM urls LEFT JOIN fits USING (nr)""",
    "op13_prefix_trie": r"""
    WITH own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS place,
                        coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (SELECT c, c - c % 20 AS base,
                     xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                                     lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 4 AS h
              FROM (SELECT DISTINCT c FROM own)),
    parts AS (SELECT convs.c, 0 AS part, place, role, text FROM convs JOIN own ON own.c = base AND place <= h
              UNION ALL SELECT convs.c, 1, place, role, text FROM convs JOIN own ON own.c = convs.c AND place > h),
    turns AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, place) AS depth, role, text FROM parts),
    prefixes AS (SELECT c, depth, text, string_agg(sha256(role) || sha256(text), ',') OVER (PARTITION BY c ORDER BY depth) AS key FROM turns
                 UNION ALL SELECT c, 0, '', '' FROM convs),
    told AS (SELECT *, depth = max(depth) OVER (PARTITION BY c) AS ends, min(c) OVER (PARTITION BY depth, key) AS top FROM prefixes),
    nodes AS (SELECT top AS conv_id, depth, count(*) AS n_convs, len(regexp_extract_all(any_value(text), '[^ 	-
]+')) AS words,
                     sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
              FROM told GROUP BY top, depth),
    linked AS (SELECT n.*, p.top AS parent_conv_id FROM nodes n LEFT JOIN told p ON p.c = n.conv_id AND p.depth = n.depth - 1),
    kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL),
    full_nodes AS (SELECT linked.*, coalesce(n_children, 0) AS n_children FROM linked LEFT JOIN kids USING (conv_id, depth)),
    sums AS (SELECT a.top AS conv_id, a.depth, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
             FROM full_nodes n JOIN told a ON a.c = n.conv_id AND a.depth <= n.depth GROUP BY ALL)
    SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM full_nodes JOIN sums USING (conv_id, depth)""",
    "op9_exact_dedup": r"""
    WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
    g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)""",
}
