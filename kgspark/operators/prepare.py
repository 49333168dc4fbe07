"""Preparing documents: cleaning, chunks, sentences, tokens and prompts."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from kgspark.functions.labels import canonical_kg_type, local_name
from kgspark.functions.text import strip
from kgspark.operators.streams import in_pieces
from kgspark.vocab import BLANK_CHARACTERS, ENTITY_TYPES

# Sizes in characters.
CHUNK_SIZE, CHUNK_LIMIT, OVERLAP = 2000, 4000, 200
BOUNDARY_SEARCH, SPACE_SEARCH = 200, 50
MIN_PIECE, MAX_DEPTH, MIDDLE_SEARCH = 300, 3, 500
CONTEXT_LIMIT, EXTRA_LIMIT = 500, 800
# Patterns of a sentence end inside a chunk and between sentences.
CHUNK_BOUNDARY = re.compile(r"[.!?]\s")
SENTENCE_GAP = re.compile(r"(?<=[.!?])\s+|\n+")


def clean_text(c: Column) -> Column:
    """Collapse blanks, limit empty lines to one, strip lines, strip the whole.

    Empty lines are limited before lines are stripped, so stripping may leave longer gaps.
    """
    one = F.regexp_replace(c, "[ \t]+", " ")
    two = F.regexp_replace(one, "\n{3,}", "\n\n")
    lines = F.transform(F.split(two, "\n"), lambda x: strip(x))
    return strip(F.array_join(lines, "\n"))


def _by_document(docs: DataFrame, columns: str) -> StructType:
    """The document's id and the columns."""
    return StructType([docs.schema["doc_id"], *StructType.fromDDL(columns).fields])


def _cut_points(text: str, size: int, overlap: int):
    """(start, end) of the chunks of a text that is longer than one chunk."""
    start, n = 0, len(text)
    while start < n:
        end = min(start + size, n)
        if end < n:
            lo = max(end - BOUNDARY_SEARCH, start)
            stops = [m.end() for m in CHUNK_BOUNDARY.finditer(text, lo, end)]
            space = text.rfind(" ", end - SPACE_SEARCH + 1, end)
            end = stops[-1] if stops else space + 1 if space >= 0 else end
        yield start, end
        if end >= n:
            return
        start = max(start + 1, end - overlap)


def _chunker(size: int, overlap: int):
    def chunks(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, found = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            n = len(text)
            cut = [(0, n, text)] if n <= size else [(a, b, text[a:b].strip()) for a, b in _cut_points(text, size, overlap)]
            kept = [c for c in cut if c[2]]
            at += [i] * len(kept)
            found += [(j, *c) for j, c in enumerate(kept)]
        number, start, end, body = zip(*found) if found else ((),) * 4
        as_int = lambda x: pa.array(x, type=pa.int32())
        return pa.record_batch({
            "doc_id": batch.column("doc_id").take(pa.array(at, type=pa.int32())), "chunk_index": as_int(number),
            "start_char": as_int(start), "end_char": as_int(end), "text": pa.array(body, type=batch.column("text").type)})

    return in_pieces(chunks)


def chunk_text(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP, limit: int = CHUNK_LIMIT) -> DataFrame:
    """``doc_id, chunk_index, start_char, end_char, text`` of ``docs(doc_id, text)``.

    A text that fits in one chunk is that chunk, as it is. For longer ones the next start depends on
    the previous end, so each text is walked once, a few texts at a time. Every document is
    chunked where it lies: no shuffle. Offsets belong to the slice before it is stripped.
    """
    if not (1 <= size <= limit and 0 <= overlap < size):
        raise ValueError(f"size must be 1..{limit}, overlap smaller than it")
    return docs.filter(F.length("text") > 0).select("doc_id", "text").mapInArrow(_chunker(size, overlap), _by_document(
        docs, "chunk_index int, start_char int, end_char int, text string"))


def document_info(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_chunks"))
    sizes = docs.select("doc_id", F.length("text").alias("total_chars"))
    return sizes.join(counts, "doc_id", "left").withColumn("total_chunks", F.coalesce("total_chunks", F.lit(0)))


def join_chunks(chunks: DataFrame) -> DataFrame:
    """The chunks of a document joined by line ends, in order."""
    rows = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))


def _halves(text: str) -> list[str]:
    """Cut near the middle: after a sentence end, else after a line end, else in the middle."""
    n = len(text)
    middle, reach = n // 2, min(MIDDLE_SEARCH, n // 4)
    around = [p for i in range(reach) for p in (middle - i, middle + i) if 0 < p < n - 1]
    ends = (p for p in around if text[p] in ".!?" and text[p + 1] in " \n\t")
    cut = next(ends, None)
    if cut is None or cut + 1 == middle:
        cut = next((p for p in around if text[p] == "\n"), middle - 1 if cut is None else cut)
    parts = [text[: cut + 1].strip(), text[cut + 1:].strip()]
    return parts if all(parts) else [text]


def _pieces(text: str, limit: int, times: int) -> list[str]:
    if len(text) <= limit or not times:
        return [text]
    parts = _halves(text)
    return parts if len(parts) == 1 else [p for half in parts for p in _pieces(half, limit, times - 1)]


def split_oversize(chunks: DataFrame, limit: int, min_piece: int = MIN_PIECE, times: int = MAX_DEPTH) -> DataFrame:
    """Chunks longer than the limit are halved up to ``times`` times; others stay as they are.

    A text of less than two ``min_piece`` is not halved, so pieces may stay longer than a small limit.
    """

    @F.pandas_udf(ArrayType(StringType()))
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _pieces(t, max(limit, 2 * min_piece), times))

    big = F.length("text") > limit
    parts = F.when(big, pieces(F.when(big, F.col("text")))).otherwise(F.array("text"))
    keys = [c for c in chunks.columns if c != "text"]
    return chunks.select(*keys, F.posexplode(parts).alias("piece", "text"))


def _sentences(text: str | None) -> list[tuple[int, int, int, str]]:
    """Number, start, end and text of each sentence, without surrounding blanks."""
    out, at = [], 0
    for piece in SENTENCE_GAP.split(text or ""):
        bare = piece.strip()
        if bare:
            at = text.index(bare, at)
            out.append((len(out), at, at + len(bare), bare))
            at += len(bare)
    return out


def _sentence_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [_sentences(text) for text in batch.column("text").to_pylist()]
    at = [i for i, rows in enumerate(found) for _ in rows]
    number, start, end, body = zip(*[r for rows in found for r in rows]) if at else ((),) * 4
    as_int = lambda x: pa.array(x, type=pa.int32())
    return pa.record_batch({
        "doc_id": batch.column("doc_id").take(pa.array(at, type=pa.int32())), "sentence_id": as_int(number),
        "start": as_int(start), "end": as_int(end), "text": pa.array(body, type=batch.column("text").type)})


# The blank characters for Arrow's regular expressions.
_ARROW_BLANK = "".join(f"\\x{{{ord(c):x}}}" for c in BLANK_CHARACTERS)
TOKEN_COLUMNS = "doc_id bigint, pos int, sentence_id int, start int, end int, gap string, token string"


def _restart(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running sums that start again at each document; ``first`` is the document's first row per row."""
    total = np.cumsum(values)
    return total - (total - values)[first]


def _token_table(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Tokens of a batch of documents, computed on whole Arrow columns."""
    text = pc.fill_null(batch.column("text"), "")
    words = pc.split_pattern_regex(text, f"[{_ARROW_BLANK}]+")
    gaps = pc.split_pattern_regex(text, f"[^{_ARROW_BLANK}]+")
    token = words.flatten()
    real = pc.not_equal(token, "")
    doc = pc.list_parent_indices(words).filter(real).to_numpy()
    token = token.filter(real)
    # A text with n tokens has n + 1 gaps; the last one comes before no token.
    sizes = pc.list_value_length(gaps).to_numpy()
    before = np.ones(int(sizes.sum()), dtype=bool)
    before[np.cumsum(sizes) - 1] = False
    gap = gaps.flatten().filter(pa.array(before))
    first = np.searchsorted(doc, doc, side="left")
    pos = np.arange(len(doc)) - first
    length = pc.utf8_length(token).to_numpy()
    end = _restart(pc.utf8_length(gap).to_numpy() + length, first)
    stop = pc.match_substring_regex(token, "[.!?]$").to_numpy(zero_copy_only=False)
    opens = pc.match_substring(gap, "\n").to_numpy(zero_copy_only=False) | np.roll(stop, 1)
    sentence = _restart((opens & (pos > 0)).astype(np.int64), first)
    as_int = lambda x: pa.array(x, type=pa.int32())
    return pa.record_batch({
        "doc_id": batch.column("doc_id").take(pa.array(doc)), "pos": as_int(pos), "sentence_id": as_int(sentence),
        "start": as_int(end - length), "end": as_int(end), "gap": gap, "token": token})


def split_sentences(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(in_pieces(_sentence_rows), _by_document(
        docs, "sentence_id int, start int, end int, text string"))


def tokenize_spans(docs: DataFrame) -> DataFrame:
    """Tokens of ``docs(doc_id, text)`` with sentence number, offsets, and the text between a token
    and the one before. No shuffle."""
    return docs.select("doc_id", "text").mapInArrow(in_pieces(_token_table), TOKEN_COLUMNS)


def truncate_context(c: Column, limit: int = CONTEXT_LIMIT) -> Column:
    return F.substring(c, 1, limit)


PROMPT = "Find all entities and relations in the text below.\n\n%sTEXT:\n%s\n\nAnswer with JSON: \"entities\" and \"relations\"."


def build_prompts(
    chunks: DataFrame, system: str, examples: str = "", entity_extra: str | None = None,
    relation_extra: str | None = None, template: str = PROMPT, extra_limit: int = EXTRA_LIMIT,
) -> DataFrame:
    """A request table: system prompt, user prompt and output budget per chunk. No model is called."""
    extras = [f"\nAdditional {kind} extraction instructions:\n{text[:extra_limit]}"
              for kind, text in (("entity", entity_extra), ("relation", relation_extra)) if text]
    whole_system = system + ("\n" + "\n".join(extras) if extras else "")
    budget = F.least(F.lit(4096), F.greatest(F.lit(1024), 4096 - F.floor(F.length("text") / 3)))
    return chunks.select(
        "doc_id", "chunk_index",
        F.lit(whole_system).alias("system_prompt"),
        F.format_string(template, F.lit(examples), F.col("text")).alias("user_prompt"),
        budget.cast("int").alias("max_tokens"),
    )


def few_shot_sample(entities: DataFrame, n: int = 8, seed: int = 0, stratified: bool = False) -> DataFrame:
    """n entities with a label and a known class, in an order that depends on the seed only.

    ``stratified`` takes them in turn from each type.
    """
    kind = canonical_kg_type(local_name(F.get("types", F.lit(0))))
    eligible = entities.select("uri", F.get("labels", F.lit(0)).alias("label"), kind.alias("type")).filter(
        F.col("label").isNotNull() & F.col("type").isin(ENTITY_TYPES)
    ).withColumn("order", F.md5(F.concat_ws(":", F.col("uri"), F.lit(str(seed)))))
    if stratified:
        turn = F.row_number().over(Window.partitionBy("type").orderBy("order", "uri"))
        eligible = eligible.withColumn("turn", turn).filter(F.col("turn") <= n).orderBy("turn", "order", "uri")
    else:
        eligible = eligible.orderBy("order", "uri")
    return eligible.select("uri", "label", "type").limit(n)


def few_shot_block(sampled: DataFrame, custom: DataFrame | None = None, most: int = 200) -> DataFrame:
    """One row with the example text for a prompt.

    ``custom(text, entity_type)`` comes first; sampled entities whose lower-case label is
    among the custom texts are left out. A prompt holds at most ``most`` examples; more raise an error.
    """
    rows = sampled.select(F.lit(1).alias("part"), F.col("label").alias("text"), F.col("type").alias("entity_type"),
                          F.lit("knowledge_graph").alias("origin"))
    if custom is not None:
        known = custom.select(F.lower("text").alias("low")).distinct()
        rows = rows.join(known, F.lower("text") == F.col("low"), "left_anti").unionByName(
            custom.select(F.lit(0).alias("part"), "text", "entity_type", F.lit(None).cast("string").alias("origin")))
    held = rows.orderBy("part", "text", "entity_type", "origin").limit(most + 1)
    ordered = F.array_sort(F.collect_list(F.struct("part", "text", "entity_type", "origin")))
    entity = lambda r: F.struct(r["text"].alias("text"), r["entity_type"].alias("entity_type"),
                                F.struct(r["origin"].alias("source")).alias("attributes"))
    made = held.agg(F.transform(ordered, entity).alias("entities"))
    made = made.withColumn("entities", F.when(F.size("entities") > most, F.raise_error(F.lit(f"more than {most} examples"))).otherwise(F.col("entities")))
    body = F.to_json(F.struct("entities", F.array().cast("array<string>").alias("relations")))
    sentence = F.concat(F.lit("Clinical findings include: "), F.array_join("entities.text", ", "), F.lit("."))
    return made.select(
        F.when(F.size("entities") > 0, F.concat(F.lit('EXAMPLE (for reference):\nText: "'), sentence,
                                                F.lit('"\nExpected output:\n'), body, F.lit("\n\n")))
        .otherwise("").alias("block"))
