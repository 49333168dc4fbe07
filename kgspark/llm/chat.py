"""Chat formatting: layouts of records are recognised by a fingerprint of their field paths and mapped to turns.

A record's nested field paths (lists as []) that belong to the vocabulary of the mappings are hashed; the hash selects
a declarative mapping, which says where roles and texts are. Fields outside the vocabulary do not count, so extra
columns change nothing. A record that no mapping fits gives one row with a null layout; it is not dropped.

The template marks a turn as `### role: text </turn>` and a line feed. Inside roles and texts every backslash, # and <
(and : in roles) is escaped by a backslash, so no text can look like a mark, and read_back() undoes it. The loss mask
is the assistant texts. Formatting is done row by row before the shuffle; a conversation's turns then pass through
one task in order, in batches, so a conversation of any length needs little memory.

Rules for input: null text and role are empty; null conversation ids are one conversation; turns are in order of
turn, then role and text, so ties and repeated rows have one order; an empty table gives no conversations.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points of formatted text in one row of assembled conversations.
CHUNK = 1 << 20


@dataclass(frozen=True)
class Mapping:
    """Turns of a layout: either a list of items with role and text paths, or fixed (role, text paths) in order."""

    name: str
    items: str = ""
    role: str = ""
    text: str = ""
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    context: tuple[str, ...] = ()

    def paths(self) -> frozenset[str]:
        """The field paths that a record of this layout has."""
        own = [f"{self.items}[].{p}" for p in (self.role, self.text)] if self.items else [self.role, self.text] if self.role else []
        return frozenset([*own, *(p for _, texts in self.fixed for p in texts), *self.context])


# Layouts in common use, and their names of roles.
MAPPINGS = [
    Mapping("turn_rows", role="role", text="text"),
    Mapping("messages", items="messages", role="role", text="content"),
    Mapping("messages_text", items="messages", role="role", text="text"),
    Mapping("messages_author", items="messages", role="author.role", text="content.text"),
    Mapping("messages_system", items="messages", role="role", text="content", context=("system",)),
    Mapping("conversations", items="conversations", role="from", text="value"),
    Mapping("conversations_system", items="conversations", role="from", text="value", context=("system",)),
    Mapping("dialog", items="dialog", role="speaker", text="utterance"),
    Mapping("data_messages", items="data.messages", role="role", text="content"),
    Mapping("prompt_completion", fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt_response", fixed=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt_response_system", fixed=(("user", ("prompt",)), ("assistant", ("response",))), context=("system",)),
    Mapping("instruction", fixed=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction_input", fixed=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("instruction_response", fixed=(("user", ("instruction",)), ("assistant", ("response",)))),
    Mapping("question_answer", fixed=(("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("context_question_answer", fixed=(("user", ("context", "question")), ("assistant", ("answer",)))),
]
ROLES = {"human": "user", "prompter": "user", "customer": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


def field_paths(value: object, at: str = "") -> set[str]:
    """The paths of all leaves of a nested record; empty lists and objects have none."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in field_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, f"{at}[]")}
    return {at}


def fingerprint(paths: set[str] | frozenset[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "replace")).hexdigest()[:16]


VOCABULARY = frozenset(p for m in MAPPINGS for p in m.paths())
BY_FINGERPRINT = {fingerprint(m.paths()): m for m in MAPPINGS}


def _at(value: object, path: str) -> object:
    for name in path.split("."):
        value = value.get(name) if isinstance(value, dict) else None
    return value


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns(record: object) -> tuple[str | None, list[tuple[str, str]]]:
    """The layout's name and the (role, text) turns of a record; (None, []) if no mapping fits."""
    mapping = BY_FINGERPRINT.get(fingerprint(field_paths(record) & VOCABULARY))
    if mapping is None:
        return None, []
    out = [("system", _text(_at(record, p))) for p in mapping.context if _at(record, p) is not None]
    if mapping.items:
        held = _at(record, mapping.items)
        out += [(_text(_at(i, mapping.role)), _text(_at(i, mapping.text))) for i in held if isinstance(i, dict)] if isinstance(held, list) else []
    elif mapping.role:
        out.append((_text(_at(record, mapping.role)), _text(_at(record, mapping.text))))
    out += [(role, "\n\n".join(t for p in paths if (t := _text(_at(record, p))))) for role, paths in mapping.fixed]
    return mapping.name, [(ROLES.get(role.lower(), role), text) for role, text in out]


def canonical_turns(records: DataFrame) -> DataFrame:
    """(conv_id, turn, part, layout, role, text) from records (conv_id, turn, record), record being JSON.

    part numbers the turns that one record holds. Broken JSON and unknown layouts give a row with layout null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv_id, turn, record in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "record")), strict=True):
                try:
                    layout, found = turns(json.loads(record or "null"))
                except ValueError:
                    layout, found = None, []
                rows += [(conv_id, turn, k, layout, *t) for k, t in enumerate(found)] or [(conv_id, turn, 0, layout, None, None)]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "turn", "part", "layout", "role", "text"])

    typed = records.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "record")
    return typed.mapInArrow(run, "conv_id long, turn long, part int, layout string, role string, text string")


def _escaped(text: str, marks: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"([{marks}])", r"\\$1")


def formatted_turns(canonical: DataFrame) -> DataFrame:
    """canonical with segment (the marked turn) and loss_start and loss_end in it, null but for the assistant's turns."""
    head, body = F.concat(F.lit("### "), _escaped("role", r"\\#<:"), F.lit(": ")), _escaped("text", r"\\#<")
    own = F.col("role") == "assistant"
    return canonical.withColumns(
        {
            "segment": F.concat(head, body, F.lit(" </turn>\n")),
            "loss_start": F.when(own, F.length(head).cast("long")),
            "loss_end": F.when(own, (F.length(head) + F.length(body)).cast("long")),
        }
    )


ASSEMBLED = "conv_id long, chunk long, formatted string, loss array<struct<start:long,end:long>>"


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of conversation and turn to rows (conv_id, chunk, formatted, loss spans in it)."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    now, chunk, held, spans, size = None, -1, [], [], 0
    rows: list[tuple] = []

    def told() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "chunk", "formatted", "loss"])

    for batch in batches:
        for conv_id, segment, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end")), strict=True):
            if chunk >= 0 and (conv_id != now or size >= CHUNK):
                rows.append((now, chunk, "".join(held), spans))
                chunk, held, spans, size = (chunk + 1 if conv_id == now else 0), [], [], 0
            now, chunk = conv_id, max(chunk, 0)
            if start is not None:
                spans.append({"start": size + start, "end": size + end})
            held.append(segment)
            size += len(segment)
        yield told()
    if chunk >= 0:
        rows.append((now, chunk, "".join(held), spans))
    yield told()


def format_conversations(canonical: DataFrame) -> DataFrame:
    """(conv_id, chunk, formatted, loss): every conversation's text, in chunks of whole turns, with its loss spans."""
    order = ["conv_id", "turn", "part", "role", "text"]
    rows = formatted_turns(canonical.where("layout is not null")).repartition("conv_id").sortWithinPartitions(*order)
    return rows.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(_assemble, ASSEMBLED)


TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<]|\\.)*) </turn>\n", re.S)


def _plain(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """The (role, text) turns of formatted text; raises ValueError where it is no formatted text."""
    at = 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if found is None:
            raise ValueError(f"no turn at {at}")
        yield _plain(found[1]), _plain(found[2])
        at = found.end()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order to one row for each conversation, read back from its formatted text."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    now, state, rows = None, None, []

    def done() -> None:
        if state:
            rows.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    def told() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        for conv_id, chunk, formatted, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "chunk", "formatted", "loss")), strict=True):
            if chunk == 0:
                done()
                now, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in read_turns(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            for span in loss:
                text = _plain(formatted[span["start"] : span["end"]])
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(formatted)
        yield told()
    done()
    yield told()


def digests(conversations: DataFrame) -> DataFrame:
    """Counts and digests of format_conversations()'s rows, as it gives them (in its order)."""
    return conversations.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def table_records(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, record) from a table with those two columns and any others."""
    rest = [c for c in rows.columns if c not in ("conv_id", "turn")]
    return rows.select("conv_id", "turn", F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest]), {"ignoreNullFields": "false"}).alias("record"))
