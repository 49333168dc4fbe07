"""From model answers and token labels to mentions and relations."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from kgspark.functions.labels import format_iob_type, infer_entity_type
from kgspark.functions.text import strip
from kgspark.operators.streams import beside, by_body, packed, runs_of, unpacked, whole_runs
from kgspark.vocab import BLANK, IGNORED_LABEL_ID

# Patterns of code fences and of the outermost object in an answer.
FENCE_OPEN, FENCE_CLOSE = r"^```(?:json)?\s*\n?", r"\n?```\s*$"
FENCED_BLOCK = r"```(?:json)?\s*([\s\S]*?)\s*```"
OUTER_OBJECT = r"(?s)\{.*\}"
# Repairs of common mistakes in answers, in order; the last two only if JSON still fails.
REPAIRS = [
    (r'"entity_type"\s*:\s*\{\s*\}', '"entity_type": "finding"'),
    (r",(\s*[}\]])", "$1"),
]
LAST_REPAIRS = [
    (r'"entity_type"\s*:\s*\{[^}]*\}', '"entity_type": "finding"'),
    (r"\}\s*\{", "}, {"),
]
# Context margins and the confidence of decoded spans.
MENTION_MARGIN, RELATION_MARGIN = 50, 30
BIO_CONFIDENCE = 0.9
MERGE_DISTANCE = 2


# Answers


def _one_json(c: Column) -> Column:
    """True when the text is exactly one JSON value.

    Alone, the lenient readers accept text after the value; inside brackets they do not.
    """
    boxed = F.concat(F.lit("["), c, F.lit("]"))
    return F.try_parse_json(boxed).isNotNull() & (F.json_array_length(boxed) == 1)


def answer_json(raw: Column) -> Column:
    """The JSON text of an answer: without fences, else its outermost object, else null."""
    bare = strip(raw)
    bare = F.when(
        bare.startswith("```"), F.regexp_replace(F.regexp_replace(bare, FENCE_OPEN, ""), FENCE_CLOSE, "")
    ).otherwise(bare)
    outer = F.regexp_extract(bare, OUTER_OBJECT, 0)
    return F.when(_one_json(bare), bare).when(_one_json(outer), outer)


def _items(answers: DataFrame, keys: list[str], name: str, text: str = "json") -> DataFrame:
    """Elements of one array of the answer, as variants with their position."""
    parsed = F.try_variant_get(F.try_parse_json(text), f"$.{name}", "array<variant>")
    return answers.select(*keys, F.posexplode(parsed).alias("pos", "e"))


def _get(field: str, default: str | None = None) -> Column:
    value = F.try_variant_get("e", f"$.{field}", "string")
    return value if default is None else F.coalesce(value, F.lit(default))


def _present(c: Column) -> Column:
    return c.isNotNull() & ~c.isin("", "{}", "[]")


def parse_entities(responses: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """Entities with a text and a type: ``keys, pos, text, entity_type, attributes``."""
    rows = _items(responses.select(*keys, answer_json(F.col(raw)).alias("json")), keys, "entities")
    return rows.select(
        *keys, "pos", _get("text").alias("text"), _get("entity_type").alias("entity_type"),
        F.coalesce(F.try_variant_get("e", "$.attributes", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("attributes"),
    ).filter(_present(F.col("text")) & _present(F.col("entity_type")))


def parse_relations(responses: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """Relations with both ends and a type; missing end types are ``unknown``."""
    rows = _items(responses.select(*keys, answer_json(F.col(raw)).alias("json")), keys, "relations")
    out = rows.select(
        *keys, "pos", _get("source_entity").alias("source_entity"), _get("source_type", "unknown").alias("source_type"),
        _get("relation_type").alias("relation_type"), _get("target_entity").alias("target_entity"),
        _get("target_type", "unknown").alias("target_type"), _get("context", "").alias("context"),
    )
    return out.filter(_present(F.col("source_entity")) & _present(F.col("target_entity")) & _present(F.col("relation_type")))


def repair_json(text: Column) -> Column:
    """Repaired answer text."""
    for pattern, put in REPAIRS:
        text = F.regexp_replace(text, pattern, put)
    last = text
    for pattern, put in LAST_REPAIRS:
        last = F.regexp_replace(last, pattern, put)
    return F.when(_one_json(text), text).otherwise(last)


def repaired_entities(responses: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """Entities of the repaired answer; a missing, empty or non-text type is inferred from the text."""
    fixed = responses.select(*keys, repair_json(F.col(raw)).alias("json"))
    rows = _items(fixed, keys, "entities")
    kind = F.try_variant_get("e", "$.entity_type", "variant")
    is_text = F.schema_of_variant(kind) == "STRING"
    named = F.when(is_text & _present(_get("entity_type")), _get("entity_type"))
    return (
        rows.select(*keys, "pos", _get("text").alias("text"), named.alias("entity_type"))
        .filter(_present(F.col("text")))
        .withColumn("entity_type", F.coalesce("entity_type", infer_entity_type(F.col("text"))))
    )


def _answers(text: str) -> Iterator[tuple[str, dict | None]]:
    """Outermost objects of a text from left to right, each with its value if it is valid JSON.

    A valid object is read by the JSON decoder itself; a broken one, or one nested too deeply for it, reaches as
    far as its brackets balance, and what it holds is passed over. One that never closes ends the reading. The
    brackets of a text are balanced once, when its first broken object is met.
    """
    read, at, closes = json.JSONDecoder().raw_decode, text.find("{"), None
    while at >= 0:
        try:
            value, end = read(text, at)
        except (json.JSONDecodeError, RecursionError):
            value = None
            closes = _closes(text) if closes is None else closes
            if at not in closes:
                return
            end = closes[at] + 1
        yield text[at:end], value
        at = text.find("{", end)


def _closes(text: str) -> dict[int, int]:
    """For each opening bracket that is closed, where."""
    out, opened = {}, []
    for m in re.finditer("[{}]", text):
        if m[0] == "{":
            opened.append(m.start())
        elif opened:
            out[opened.pop()] = m.start()
    return out


def _choose(text: str | None) -> str | None:
    """The first object that has data, else the last object, else from the first bracket to the last."""
    if text is None:
        return None
    last = None
    for last, value in _answers(text):
        if value is not None and value.keys() & {"entities", "relations"}:
            return last
    outer = re.search(OUTER_OBJECT, text)
    return last or (outer.group() if outer else None)


def select_json_object(raw: Column) -> Column:
    """A fenced block, else the first top-level object with data, else the last object.

    Answers that are one JSON object as they stand do not go to Python.
    """

    @F.pandas_udf(StringType())
    def choose(texts: pd.Series) -> pd.Series:
        return texts.map(_choose)

    bare = strip(raw)
    fenced = bare.rlike(FENCED_BLOCK)
    plain = bare.startswith("{") & _one_json(bare)
    return (
        F.when(fenced, strip(F.regexp_extract(bare, FENCED_BLOCK, 1)))
        .when(plain, bare)
        .otherwise(choose(F.when(~fenced & ~plain, bare)))
    )


# Positions in the text


def _finder(needles: Iterable[str]):
    """All needles in one automaton, so that a text is read once whatever their number."""
    held = ahocorasick.Automaton()
    for needle in needles:
        if needle:
            held.add_word(needle, needle)
    held.make_automaton()
    return held


def _first_places(low: str, needles: set[str]) -> dict[str, int]:
    """The first start of each needle that a text has; an empty needle is at the start."""
    out = {"": 0} if "" in needles else {}
    finder = _finder(needles)
    for end, needle in finder.iter(low) if len(finder) else ():
        out.setdefault(needle, end + 1 - len(needle))
    return out


def _window(body: str, lo: int, hi: int, margin: int) -> str:
    lo, hi = max(0, lo - margin), min(len(body), hi + margin)
    return ("..." if lo > 0 else "") + body[lo:hi] + ("..." if hi < len(body) else "")


def _mention_places(bodies: list, asked: list[tuple], state: dict) -> tuple[list[int], list]:
    """The place and context of each (lower-case needle, length) in the bodies."""
    distinct = {x for x in asked if x[0] is not None}
    wanted, places = {needle for needle, _ in distinct}, []
    for text, low in bodies:
        at = _first_places(low, wanted)
        made = {(x, size): (at[x], _window(text, at[x], at[x] + size, MENTION_MARGIN)) for x, size in distinct if x in at}
        places.append([made.get(x) for x in asked])
    return by_body(places, len(asked))


def _relation_contexts(bodies: list, asked: list[tuple], state: dict) -> tuple[list[int], list]:
    """The context of each pair of (lower-case end, length) in the bodies, null where an end is absent."""
    wanted = {x for pair in asked for x in (pair[0], pair[2])} - {None}
    places = []
    for text, low in bodies:
        at = _first_places(low, wanted)
        places.append([
            (_window(text, min(at[x], at[y]), max(at[x] + n, at[y] + m), RELATION_MARGIN),) if x in at and y in at else None
            for x, n, y, m in asked])
    return by_body(places, len(asked))


def locate_mentions(mentions: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """First occurrence ignoring case: ``start_position, end_position, context``; unchanged if absent.

    ``texts(keys, body)``. Mentions come behind their document's body and are looked up some thousands at a time, in
    one reading of it.
    """
    late = {"_needle": F.lower("text"), "_size": F.length("text")}
    found = beside(mentions, texts, keys, [], late, _mention_places, {"_start": IntegerType(), "_context": StringType()})
    old = lambda c, t: F.col(c) if c in mentions.columns else F.lit(None).cast(t)
    return found.withColumns(
        {
            "start_position": F.coalesce("_start", old("start_position", "int")),
            "end_position": F.coalesce(F.col("_start") + F.length("text"), old("end_position", "int")),
            "context": F.coalesce("_context", old("context", "string")),
        }
    ).drop("_start", "_context")


def locate_relations(relations: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """Context around both ends where both occur; otherwise the relation is unchanged. One pass per text."""
    late = {"_source": F.lower("source_entity"), "_source_size": F.length("source_entity"),
            "_target": F.lower("target_entity"), "_target_size": F.length("target_entity")}
    found = beside(relations, texts, keys, [], late, _relation_contexts, {"_context": StringType()})
    old = F.col("context") if "context" in relations.columns else F.lit(None).cast("string")
    return found.withColumn("context", F.coalesce("_context", old)).drop("_context")


def first_of(rows: DataFrame, keys: dict[str, Column], order: list[str]) -> DataFrame:
    """The first row per key in the given order. A min aggregate, so it is reduced before the shuffle."""
    cols = rows.columns
    first = rows.groupBy(*[c.alias(f"_k_{n}") for n, c in keys.items()]).agg(
        F.min_by(F.struct(*cols), F.struct(*order)).alias("r")
    )
    return first.select("r.*")


def merge_chunk_entities(
    entities: DataFrame, chunks: DataFrame, shift: bool = True, exact_offsets: bool = False
) -> DataFrame:
    """One row per (document, lower-case text, type): the one of the earliest chunk.

    Positions move by the chunk's start; ``exact_offsets`` also adds the blanks that were
    stripped from the chunk, given a ``lead`` column of chunks.

    The starts of a document's chunks come before its entities, in one shuffle of both, packed into blocks; entities pass in
    order of chunk and place. Of a document only the starts and the distinct texts and types are held.
    """
    if shift:
        entities = entities.select("doc_id", "chunk_index", *[c for c in entities.columns if c not in ("doc_id", "chunk_index")])
    names, order = entities.columns, ["chunk_index", "pos"]
    both = entities.withColumns({"_low": F.lower("text"), "_move": F.lit(None).cast("int"), "_turn": F.lit(1).cast("byte")})
    if shift:
        move = F.col("start_char") + (F.col("lead") if exact_offsets else F.lit(0))
        starts = chunks.where("doc_id IS NOT NULL AND chunk_index IS NOT NULL").select(
            "doc_id", "chunk_index", F.coalesce(move, F.lit(0)).alias("_move"), F.lit(0).cast("byte").alias("_turn"))
        both = both.unionByName(starts, allowMissingColumns=True)
    rows = packed(both, ["doc_id", "_turn"], order, []).repartition(F.xxhash64("doc_id")).sortWithinPartitions("doc_id", "_turn", *order)
    content = [n for n in both.columns if n not in ("doc_id", "_turn")]
    out = StructType([*entities.schema.fields, StructField("_move", both.schema["_move"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen, moves = None, set(), {}
        for batch in unpacked(batches, ["doc_id", "_turn"], order, content):
            column = lambda name: batch.column(name).to_pylist()
            places, moved = [], []
            for i, (doc, turn, chunk, move, *what) in enumerate(zip(*map(column, ("doc_id", "_turn", "chunk_index", "_move", "_low", "entity_type")))):
                if doc != at:
                    at, seen, moves = doc, set(), {}
                if not turn:
                    moves.setdefault(chunk, []).append(move)
                elif (key := tuple(what)) not in seen:
                    seen.add(key)
                    found = moves.get(chunk, (0,))
                    places += [i] * len(found)
                    moved += found
            if places:
                kept = batch.select(names).take(pa.array(places))
                yield pa.record_batch({**dict(zip(names, kept.columns)), "_move": pa.array(moved, type=batch.schema.field("_move").type)})

    first = rows.mapInArrow(run, out)
    if not shift:
        return first.drop("_move")
    return first.withColumns({c: F.col(c) + F.col("_move") for c in ("start_position", "end_position")}).drop("_move")


def merge_chunk_extractions(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    doc, low = F.col("doc_id"), lambda c: F.lower(strip(F.col(c)))
    order = ["chunk_index", "pos"]
    return (
        first_of(entities, {"doc": doc, "text": low("text"), "type": F.col("entity_type")}, order),
        first_of(relations, {"doc": doc, "source": low("source_entity"), "type": F.col("relation_type"),
                             "target": low("target_entity")}, order),
    )


def _handed_out(low: str, needles: list[str], used: set[int]) -> list[int | None]:
    """Starts for needles in their order: each takes its first start that no other has taken.

    The text is read once for all needles; a needle's starts come in order and are tried once.
    """
    starts: dict[str, list[int]] = {}
    finder = _finder(set(needles))
    for end, needle in finder.iter(low) if len(finder) else ():
        starts.setdefault(needle, []).append(end + 1 - len(needle))
    left = {needle: iter(places) for needle, places in starts.items()}
    out = []
    for needle in needles:
        at = next((p for p in left.get(needle, ()) if p not in used), None)
        if at is not None:
            used.add(at)
        out.append(at)
    return out


def _assigned(bodies: list, asked: list[tuple], state: dict) -> tuple[list[int], list]:
    """What each body has for the extractions; ``state`` holds the starts that are taken in each.

    Extractions of one order share what they are given, each start in a row; those without an order get nothing.
    """
    real = [i for i, (needle, _) in enumerate(asked) if needle is not None]
    needles, starts = [asked[i][0] for i in real], {}
    for n, (_, low) in enumerate(bodies):
        for i, start in zip(real, _handed_out(low, needles, state.setdefault(n, set()))):
            if start is not None and asked[i][1] is not None:
                starts.setdefault(asked[i][1], []).append((start,))
    at = [(i, start) for i, (_, turn) in enumerate(asked) for start in starts.get(turn, (None,))]
    return [i for i, _ in at], [start for _, start in at]


def assign_occurrences(extractions: DataFrame, texts: DataFrame) -> DataFrame:
    """Each extraction takes the first occurrence whose start is still free in its document.

    ``extractions(doc_id, ord, text)``, in order of ``ord``; result adds ``start, end``. A document's extractions come
    behind its text, which is read once for some thousands of them; of a document only the taken starts are held.
    """
    turns = extractions.select("doc_id", "ord", *[c for c in extractions.columns if c not in ("doc_id", "ord")])
    late = {"_needle": F.lower("text"), "_turn": F.col("ord")}
    out = beside(turns, texts, ["doc_id"], ["ord"], late, _assigned, {"start": IntegerType()})
    return out.withColumn("end", F.col("start") + F.length("text"))


# Token labels


def decode_bio(preds: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans of labelled tokens: ``key, start, end, entity_type, confidence``.

    ``preds(key, idx, start, end, gap, token, label, is_subword)`` where ``gap`` is the text
    between a token and the one before. Whether a token opens a span depends on its
    neighbours only, so spans are break flags and a running sum. A second pass of the same kind
    joins spans of one type that are at most two characters apart with no blank between them.
    """
    real = F.col("start") < F.col("end")
    kind = F.when(real & (F.col("label") != "O"), F.substring("label", F.lit(3), F.length("label")))
    # What a row says by itself is worked out before the shuffle, so that no text is sent or sorted; it travels as one number, a
    # digit (no, yes, null) for each mark, and offsets that are integers as another.
    marks = {"real": real, "inner": F.col("label").startswith("I-"), "is_subword": F.col("is_subword"), "blank_gap": F.col("gap").rlike(BLANK),
             "blank_token": F.col("token").rlike(BLANK), "no_gap": strip(F.col("gap")) == "",
             "has_start": F.col("start").isNotNull(), "has_end": F.col("end").isNotNull()}
    digits = sum((F.coalesce(c.cast("int"), F.lit(2)) * 3**i for i, c in enumerate(marks.values())), F.lit(0))
    offsets, start, end = ["start", "end"], F.col("start"), F.col("end")
    if preds.schema["start"].dataType == preds.schema["end"].dataType == IntegerType():
        long = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
        offsets = [F.shiftleft(long("start"), 32).bitwiseOR(long("end").bitwiseAND(F.lit(0xFFFFFFFF))).alias("_both")]
        start, end = F.shiftright("_both", 32).cast("int"), F.shiftright(F.shiftleft("_both", 32), 32).cast("int")
    # A stated number of partitions: by their few bytes adaptive execution would join more than a task can sort in memory.
    partitions = int(preds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = preds.select(key, "idx", *offsets, kind.alias("kind"), digits.alias("_marks")).repartition(partitions, key)
    mark = {name: F.floor(F.col("_marks") / 3**i).cast("int") % 3 for i, name in enumerate(marks)}
    mark = {name: F.when(digit < 2, digit == 1) for name, digit in mark.items()}
    slim = sent.select(
        key, "idx", F.when(mark["has_start"], start).alias("start"), F.when(mark["has_end"], end).alias("end"), "kind",
        *[mark[name].alias(name) for name in ("real", "inner", "is_subword", "no_gap")],
        *[mark[name].cast("int").alias(name) for name in ("blank_gap", "blank_token")])
    w = Window.partitionBy(key).orderBy("idx")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    t = slim.withColumns(
        {
            "prev_end": F.coalesce(F.lag("end").over(w), F.lit(-1)),
            # The type of the span that is open before this token; "" when none is.
            "open": F.coalesce(F.last(F.when(F.col("real"), F.coalesce("kind", F.lit(""))), ignorenulls=True).over(before), F.lit("")),
            "blanks": F.sum(F.col("blank_gap") + F.col("blank_token")).over(w),
        }
    )
    near = F.col("start") <= F.col("prev_end") + 1
    touching = (F.col("start") == F.col("prev_end")) | (near & F.col("no_gap"))
    subword = F.col("is_subword") | ((F.col("prev_end") > 0) & (F.col("start") > F.col("prev_end")) & (F.col("blank_gap") == 0))
    continues = (F.col("open") == F.col("kind")) & (F.col("inner") | touching | subword)
    opens = F.col("real") & (F.col("kind").isNull() | ~continues)
    t = t.withColumn("span", F.sum(opens.cast("int")).over(w))
    # Blank gaps and tokens with blanks, up to but without this token, and up to and with it.
    ahead = F.col("blanks") - F.col("blank_token")
    spans = t.groupBy(key, "span").agg(
        F.min(F.when(F.col("real"), F.col("kind"))).alias("entity_type"),
        F.min_by("start", F.when(F.col("real"), F.col("idx"))).alias("start"),
        F.max_by("end", F.when(F.col("real"), F.col("idx"))).alias("end"),
        F.min_by(ahead, F.when(F.col("real"), F.col("idx"))).alias("ahead"),
        F.max_by("blanks", F.when(F.col("real"), F.col("idx"))).alias("behind"),
    )
    return _join_near_spans(spans, key)


def _join_near_spans(spans: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy("span")
    named = spans.filter("entity_type IS NOT NULL")
    last = lambda c: F.lag(c).over(w)
    near = (
        (last("entity_type") == F.col("entity_type"))
        & (F.col("start") <= last("end") + MERGE_DISTANCE)
        & ((F.col("start") <= last("end")) | (F.col("ahead") == last("behind")))
    )
    marked = named.withColumn("group", F.sum((~F.coalesce(near, F.lit(False))).cast("int")).over(w))
    return marked.groupBy(key, "group").agg(
        F.min_by("start", "span").alias("start"),
        F.max_by("end", "span").alias("end"),
        F.first("entity_type").alias("entity_type"),
        F.lit(BIO_CONFIDENCE).alias("confidence"),
    ).drop("group")


def _cut(bodies: list, asked: list[tuple], state: dict) -> tuple[list[int], list]:
    return [*range(len(asked))] * len(bodies), [(text[a:b],) for text, _ in bodies for a, b in asked]


def slice_texts(spans: DataFrame, texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add ``text`` to spans. They come behind their document's body and are cut some thousands at a time."""
    late = {"_start": F.col("start"), "_end": F.col("end")}
    return beside(spans, texts, [key], [], late, _cut, {"text": StringType()})


class _Spans:
    """Entity spans of one document in order of (start, ord)."""

    def __init__(self, parts: list[pa.RecordBatch]):
        both = pa.concat_batches(parts)
        number = lambda name: both.column(name).cast(pa.int64()).to_numpy()
        self.start, self.end, self.types = number("start"), number("end"), both.column("_type")
        self.reach = np.maximum.accumulate(self.end)

    def labels(self, start: pa.Array, end: pa.Array, prev_end: pa.Array, place: np.ndarray) -> pa.Array:
        """Labels of tokens in order of ``place`` (-1: none); tokens of one place get the label of the one whose
        span is first, and of those the one with the largest ``prev_end``."""
        number = lambda x: pc.fill_null(x, 0).cast(pa.int64()).to_numpy()
        s, e, p, first = number(start), number(end), number(prev_end), prev_end.is_null().to_numpy(zero_copy_only=False)
        known = pc.and_(start.is_valid(), end.is_valid()).to_numpy(zero_copy_only=False) & (place >= 0)
        # The first span that reaches beyond the token's start; if it begins behind the token, so do all after it.
        i = np.searchsorted(self.reach, s, side="right")
        i[~known] = len(self.start)
        i[np.append(self.start, np.iinfo(np.int64).max)[i] >= e] = len(self.start)
        edges = np.flatnonzero(np.diff(place, prepend=place[:1] - 1))
        if len(edges) < len(place):
            group = np.repeat(np.arange(len(edges)), np.diff(edges, append=len(place)))
            order = np.lexsort((np.where(first, np.iinfo(np.int64).max, -p), i, group))  # the first span, then the last token before
            chosen = order[edges][group]
            s, e, p, first, i = s[chosen], e[chosen], p[chosen], first[chosen], i[chosen]
        none = i == len(self.start)
        i = np.where(none, 0, i)
        es, ee = self.start[i], self.end[i]
        opens = np.where((s >= es) & (e <= ee), first | (p <= es), s <= es)
        side = pc.if_else(pa.array(opens), "B-", "I-")
        return pc.fill_null(pc.binary_join_element_wise(side, self.types.take(pa.array(i, mask=none)), ""), "O")


def tag_iob(tokens: DataFrame, entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """Token labels from entity spans: the first entity by start that a token overlaps.

    ``tokens(key, pos, start, end[, prev_end])``, where ``prev_end`` is the end of the token before (null at first; without
    the column it is taken from the tokens in order of ``pos``); ``entities(key, ord, start, end, entity_type)``.
    A document's spans come before its tokens, in one shuffle of both, packed into blocks. Sorted spans have a running maximum of
    their ends, in which the first span that a token overlaps is found by bisection. Only the spans of one document are held.
    """
    wanted = tokens.select(key, "pos", *[c for c in tokens.columns if c not in (key, "pos")])
    spans = entities.where(F.col(key).isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull()).select(
        key, F.col("start").alias("pos"), "start", "end", F.col("ord").alias("_ord"), format_iob_type(F.col("entity_type")).alias("_type"))
    both = wanted.withColumn("_turn", F.lit(1).cast("byte")).unionByName(spans.withColumn("_turn", F.lit(0).cast("byte")), allowMissingColumns=True)
    order = ["pos", "_ord"]
    rows = packed(both, [key, "_turn"], order, []).repartition(F.xxhash64(key)).sortWithinPartitions(key, "_turn", *order)
    names, given = wanted.columns, "prev_end" in wanted.columns
    content = [n for n in both.columns if n not in (key, "_turn")]
    out = StructType([*wanted.schema.fields, StructField("label", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held, before = None, [], None, None
        for batch in whole_runs(unpacked(batches, [key, "_turn"], order, content), [key, "_turn", "pos"]):
            turn = batch.column("_turn").to_numpy()
            place = pc.fill_null(batch.column("pos").dictionary_encode().indices, -1).to_numpy()
            edges, made = runs_of(batch, [key, "_turn"]), []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                some, document = batch.slice(a, b - a), batch.column(key)[a].as_py()
                if document != at:
                    at, parts, held, before = document, [], None, None
                if not turn[a]:
                    parts.append(some.select(["start", "end", "_type"]))
                    continue
                if parts:
                    held, parts = _Spans(parts), []
                ends = some.column("end")
                prev_end = some.column("prev_end") if given else pa.concat_arrays([pa.array([before], type=ends.type), ends[:-1]])
                before = ends[-1].as_py()
                made.append(held.labels(some.column("start"), ends, prev_end, place[a:b])
                            if held else pa.array(["O"] * (b - a), type=pa.string()))
            if made:
                kept = batch.select(names).filter(pa.array(turn == 1))
                yield pa.record_batch({**dict(zip(names, kept.columns)), "label": pa.concat_arrays(made)})

    return rows.mapInArrow(run, out)


def iob_to_entities(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """B starts an entity, I appends to it, O ends it; an I without a start is ignored."""
    w = Window.partitionBy(*keys).orderBy("pos")
    side = F.substring("labels", 1, 2)
    marks = F.when(side == "B-", F.lit("B")).when(F.col("labels") == "O", F.lit("O"))
    t = tokens.withColumns(
        {"entity_no": F.sum((side == "B-").cast("int")).over(w), "state": F.last(marks, ignorenulls=True).over(w)}
    ).filter((F.col("state") == "B") & side.isin("B-", "I-"))
    rows = F.array_sort(F.collect_list(F.struct("pos", "words", "labels")))
    out = t.groupBy(*keys, "entity_no").agg(rows.alias("r"))
    head = F.get("r", F.lit(0))
    return out.select(*keys, "entity_no", F.array_join("r.words", " ").alias("text"),
                      F.substring(head["labels"], F.lit(3), F.length(head["labels"])).alias("entity_type"))


def token_accuracy(tokens: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Share of right labels among those that count."""
    ok = (F.col("pred") == F.col("label")).cast("int")
    counted = tokens.filter(F.col("label") != IGNORED_LABEL_ID)
    g = counted.groupBy(*keys) if keys else counted
    out = g.agg(F.count(F.lit(1)).alias("total_tokens"), F.coalesce(F.sum(ok), F.lit(0)).alias("correct_tokens"))
    share = F.when(F.col("total_tokens") > 0, F.col("correct_tokens") / F.col("total_tokens")).otherwise(F.lit(0.0))
    return out.withColumn("accuracy", share)


def align_subword_labels(subwords: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """The first piece of each word gets the word's label id, other and special pieces -100.

    The words of a key come before its pieces, in one shuffle of both, packed into blocks. Only the words of one key are held.
    """
    given = words.withColumn("label_id", F.coalesce("label_id", F.lit(IGNORED_LABEL_ID)))
    same = lambda c, like: F.col(c).try_cast(subwords.schema[like].dataType)  # what does not fit equals no piece's word
    known = given.select(*keys, same("word_id", "pos").alias("pos"), same("word_id", "word_id").alias("word_id"), "label_id").where(
        " AND ".join(f"`{k}` IS NOT NULL" for k in (*keys, "word_id")))
    pieces = subwords.select(*keys, *[c for c in subwords.columns if c not in keys])
    both = pieces.withColumn("_turn", F.lit(1).cast("byte")).unionByName(known.withColumn("_turn", F.lit(0).cast("byte")), allowMissingColumns=True)
    rows = packed(both, [*keys, "_turn"], ["pos"], []).repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, "_turn", "pos")
    names, content = pieces.columns, [n for n in both.columns if n not in (*keys, "_turn")]
    out = StructType([*pieces.schema.fields, StructField("label_id", given.schema["label_id"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, before = None, [], None
        for batch in unpacked(batches, [*keys, "_turn"], ["pos"], content):
            turn, edges = batch.column("_turn").to_numpy(), runs_of(batch, [*keys, "_turn"])
            places, labels = [], []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                some, now = batch.slice(a, b - a), tuple(batch.column(k)[a].as_py() for k in keys)
                if now != at:
                    at, held, before = now, [], None
                if not turn[a]:
                    held.append(some.select(["word_id", "label_id"]))
                    continue
                if len(held) > 1:
                    held = [pa.concat_batches(held)]
                word, code = some.column("word_id"), pc.fill_null(some.column("word_id").dictionary_encode().indices, -1).to_numpy()
                first = code != np.concatenate([[-1 if word[0].as_py() != before else code[0]], code[:-1]])
                before = word[-1].as_py()
                if not held:
                    places.append(np.arange(a, b))
                    labels.append(pa.array(np.full(b - a, IGNORED_LABEL_ID), type=batch.schema.field("label_id").type))
                    continue
                # Words in order of their number among the distinct ones; a piece takes all words of its number.
                wanted = held[0].column("word_id").unique()
                number = pc.index_in(held[0].column("word_id"), value_set=wanted).to_numpy()
                order, size = np.argsort(number, kind="stable"), np.bincount(number, minlength=len(wanted))
                mine = pc.fill_null(pc.index_in(word, value_set=wanted), -1).to_numpy()
                hits = np.where(first & (code >= 0) & (mine >= 0), size[mine], 0)
                times = np.maximum(hits, 1)
                row = np.repeat(np.arange(b - a), times)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                none = hits[row] == 0
                which = order[np.where(none, 0, (np.cumsum(size) - size)[mine[row]] + nth)]
                places.append(a + row)
                labels.append(pc.fill_null(held[0].column("label_id").take(pa.array(which, mask=none)), IGNORED_LABEL_ID))
            if places:
                kept = batch.select(names).take(pa.array(np.concatenate(places)))
                yield pa.record_batch({**dict(zip(names, kept.columns)), "label_id": pa.concat_arrays(labels)})

    return rows.mapInArrow(run, out)


def corpus_split_sizes(tokens: DataFrame) -> DataFrame:
    """Sentences per split of a corpus."""
    return tokens.groupBy("split").agg(F.count_distinct("file", "sentence_id").alias("sentences"))
