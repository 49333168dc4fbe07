"""Reading Turtle files: prefixes, ``;`` and ``,`` lists, ``a``, blank nodes in brackets, collections, long strings.

A file is read by as many tasks as it has splits. Only a long string can hold a line end, so what a line does to the
state of the scanner is one of three cases, by the quotes that are open when it begins: none, ``\"\"\"`` or ``'''``. A
split is summed up as the state it ends in and the statements it ends, for each of the three; these short rows, put one
after another, tell every split its state and the number of its first statement. Statements then meet by number, in
blocks, and are parsed as a stream: a task holds one line, one open string and the open brackets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from kgspark.sources.triples import KEY, TERM
from kgspark.sources.versions import dealt, written

#: Statements that are parsed one after another by one task, with the prefixes of their file.
BLOCK = 5000
#: Triples that are compared in one task, about; a triple takes some 500 bytes there.
DEALT = 200_000
RDF, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2001/XMLSchema#"
QUOTES = ["", '"""', "'''"]
_STOP = r"\s<>\"'()\[\];,#^@"
_WORD = rf"(?:\\.|[^{_STOP}.\\]|\.+(?=[^{_STOP}.]))"
TOKEN = re.compile(
    r"(?P<space>\s+|#.*)|(?P<iri><[^\x00-\x20<>]*>)|(?P<long>\"\"\"|''')"
    r"|(?P<text>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(?P<mark>[\[\](),;]|\^\^)"
    rf"|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<word>[+-]?\.[0-9]+(?:[eE][+-]?[0-9]+)?|(?!\.){_WORD}+)|(?P<dot>\.)|(?P<bad>.)", re.S)
_REST = {q: re.compile(rf"((?:[^\\]|\\.)*?){q}", re.S) for q in QUOTES[1:]}
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
_NUMBERS = [("integer", re.compile(r"[+-]?[0-9]+")), ("decimal", re.compile(r"[+-]?[0-9]*\.[0-9]+")),
            ("double", re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)[eE][+-]?[0-9]+"))]
LINES = ["file", "start", "row", "value"]
_TRIPLE = ["s", "p", "o", "o_kind", "src", "s_kind", "lang", "datatype"]
_PARSED = ", ".join(f"{c} string" for c in _TRIPLE) + ", statement long, error string"


class Malformed(ValueError):
    """A statement that is not Turtle."""


def tokens(line: str, open_quote: str) -> Iterator[tuple[str, str, int]]:
    """(kind, text, end) of a line; ``open_quote`` is open when it begins.

    ``part`` is text of a long string that goes on in the next line, ``rest`` the text up to its end.
    """
    at = 0
    while True:
        if open_quote:
            m = _REST[open_quote].match(line, at)
            if m is None:
                yield "part", line[at:], len(line)
                return
            yield "rest", m[1], m.end()
            at, open_quote = m.end(), ""
        if at >= len(line):
            return
        m = TOKEN.match(line, at)
        at = m.end()
        if m.lastgroup == "long":
            open_quote = m[0]
            yield "long", m[0], at
        elif m.lastgroup != "space":
            yield m.lastgroup, m[0], at


def _walked(line: str, open_quote: str) -> tuple[str, list[int]]:
    """The quotes open after a line, and the places where it ends a statement."""
    ends = []
    for kind, text, at in tokens(line, open_quote):
        if kind == "long":
            open_quote = text
        elif kind == "rest":
            open_quote = ""
        elif kind == "dot":
            ends.append(at)
    return open_quote, ends


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For every split in this task, in order of its lines: end state and statements ended, by state at its start."""
    key, state = None, []
    columns = ["file", "start", "begin", "end", "ends"]
    told = lambda: pd.DataFrame([(*key, i, QUOTES.index(q), n) for i, (q, n) in enumerate(state)] if key else [], columns=columns)
    for batch in batches:
        for file, start, value in zip(batch["file"], batch["start"], batch["value"], strict=True):
            if (file, start) != key:
                yield told()
                key, state = (file, start), [(q, 0) for q in QUOTES]
            walked = {q: _walked(value, q) for q in {q for q, _ in state}}
            state = [(walked[q][0], n + len(walked[q][1])) for q, n in state]
    yield told()


def _joined(splits: pd.DataFrame) -> pd.DataFrame:
    """State and number of the first statement of each split of one file; a short row per split and state."""
    out, state, number = [], 0, 0
    for start, some in splits.sort_values(["start", "begin"]).groupby("start"):
        out.append((splits["file"].iloc[0], start, state, number))
        row = some[some["begin"] == state].iloc[0]
        state, number = int(row["end"]), number + int(row["ends"])
    return pd.DataFrame(out, columns=["file", "start", "begin", "number"])


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines in order of (file, start, row) cut where statements end, with the statement's number."""
    key, state, number = None, "", 0
    for batch in batches:
        out = []
        for file, start, row, value, begin, first in zip(*(batch[c] for c in [*LINES, "begin", "number"]), strict=True):
            if (file, start) != key:
                key, state, number = (file, start), QUOTES[begin], first
            before, at = state, 0
            state, ends = _walked(value, state)
            for k, end in enumerate([*ends, len(value)]):
                # What follows the line's last end may hold no token; a line inside a long string always counts.
                if k < len(ends) or before or value[at:].lstrip()[:1] not in ("", "#"):
                    out.append((file, number, start, row, k, value[at:end], before))
                at, before, number = end, "", number + (k < len(ends))
        yield pd.DataFrame(out, columns=["file", "statement", "start", "row", "piece", "text", "quote"])


def _unescaped(text: str) -> str:
    plain = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}

    def char(m: re.Match) -> str:
        if len(m[1]) == 1:
            return plain.get(m[1], m[1])
        value = int(m[1][1:], 16)
        if value > 0x10FFFF or 0xD800 <= value < 0xE000:
            raise Malformed(f"no character: {m[0]}")
        return chr(value)

    return _ESCAPE.sub(char, text) if "\\" in text else text


def _resolved(base: str, iri: str) -> str:
    """A relative IRI in full; whole ones, and all where no base is stated, stay as they are."""
    if not base or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri):
        return iri
    if not iri or iri.startswith("#"):
        return base.partition("#")[0] + iri
    return urljoin(base, iri.removesuffix("#")) + "#" * iri.endswith("#")


class _Frame:
    """An open subject with its predicate, or an open collection with its last cell."""

    def __init__(self, listed: bool = False, s: tuple | None = None):
        self.listed, self.s, self.p, self.head, self.may_end = listed, s, None, None, False
        self.expect = "predicate" if s else "subject"


class Statement:
    """Takes a statement token by token; ``out`` has its triples, ``directives`` its (number, prefix or None for a base, IRI)."""

    def __init__(self, blanks: str, number: int, names: dict[str, str], base: str):
        self.blanks, self.number, self.names, self.base = blanks, number, names, base
        self.stack, self.out, self.directives = [_Frame()], [], []
        self.made, self.turn, self.done, self.begun = 0, 0, False, False
        self.string: list[str] | None = None
        self.literal: str | None = None
        self.typed, self.directive = False, None

    def whole(self) -> bool:
        """Ended, or nothing but directives that need no end."""
        return self.done or not (self.begun or self.directive)

    def blank(self) -> tuple:
        self.made += 1
        return ("blank", f"_:f{self.blanks}-{self.number}-{self.made}", None, None)

    def iri(self, kind: str, text: str) -> str:
        if kind == "iri":
            return _resolved(self.base, _unescaped(text[1:-1]))
        prefix, colon, local = text.partition(":")
        if not colon or prefix not in self.names:
            raise Malformed(f"unknown name: {text}")
        return self.names[prefix] + re.sub(r"\\(.)", r"\1", local)

    def put(self, term: tuple) -> None:
        top = self.stack[-1]
        if top.listed:
            cell = self.blank()
            if top.head is None:
                top.head = cell
            else:
                self.out.append((top.s, RDF + "rest", cell))
            top.s = cell
            self.out.append((cell, RDF + "first", term))
        elif top.expect == "subject" and term[0] != "literal":
            top.s, top.expect = term, "predicate"
        elif top.expect == "object":
            self.out.append((top.s, top.p, term))
            top.expect = "after"
        else:
            raise Malformed(f"{top.expect} expected: {term[1]}")

    def told(self, kind: str, text: str) -> bool:
        """Whether the token belongs to a directive at the statement's head."""
        if self.directive is None:
            word = text.lower() if kind == "word" else text
            if self.begun or word not in ("@prefix", "@base", "prefix", "base"):
                return False
            self.directive = [word]
        elif self.directive == [""]:
            if kind != "dot":
                raise Malformed(f"directive not ended: {text}")
            self.done = True
        else:
            self.directive.append(text)
            wants = "word" if len(self.directive) == 2 and self.directive[0].endswith("prefix") else "iri"
            if kind != wants or (kind == "word" and not text.endswith(":")):
                raise Malformed(f"directive: {text}")
            if kind == "iri":
                found = _resolved(self.base, _unescaped(text[1:-1]))
                if self.directive[0].endswith("prefix"):
                    self.directives.append((self.turn, self.directive[1][:-1], found))
                    self.names[self.directive[1][:-1]] = found
                else:
                    self.directives.append((self.turn, None, found))
                    self.base = found
                self.turn += 1
                # An @ directive ends with the statement, the other form goes before one.
                self.directive = [""] if self.directive[0].startswith("@") else None
        return True

    def take(self, kind: str, text: str) -> None:
        if self.string is not None:
            self.string.append(text)
            if kind == "rest":
                self.literal, self.string = "".join(self.string), None
            else:
                self.string.append("\n")
            return
        if self.done:
            raise Malformed(f"after the end: {text}")
        if self.literal is not None:
            if self.typed:
                if kind not in ("iri", "word"):
                    raise Malformed(f"datatype expected: {text}")
                literal, self.literal, self.typed = self.literal, None, False
                return self.put(("literal", _unescaped(literal), None, self.iri(kind, text)))
            if text == "^^":
                self.typed = True
                return None
            literal, self.literal = self.literal, None
            self.put(("literal", _unescaped(literal), text[1:].lower() if kind == "lang" else None, None))
            if kind == "lang":
                return None
        if self.told(kind, text):
            return None
        self.begun = True
        top = self.stack[-1]
        if kind == "long":
            self.string = []
        elif kind == "text":
            self.literal = text[1:-1]
        elif kind == "dot":
            if len(self.stack) > 1 or not (top.expect == "after" or (top.expect == "predicate" and top.may_end)):
                raise Malformed("ends too early")
            self.done = True
        elif kind == "mark":
            self.mark(text, top)
        elif kind == "iri" or (kind == "word" and text != "a" and ":" in text and not text.startswith("_:")):
            found = self.iri(kind, text)
            if top.expect == "predicate" and not top.listed:
                top.p, top.expect = found, "object"
            else:
                self.put(("uri", found, None, None))
        elif kind != "word":
            raise Malformed(f"not expected: {text}")
        elif text.startswith("_:") and len(text) > 2:
            self.put(("blank", f"_:f{self.blanks}x{text[2:]}", None, None))
        elif text == "a" and top.expect == "predicate" and not top.listed:
            top.p, top.expect = RDF + "type", "object"
        elif text in ("true", "false"):
            self.put(("literal", text, None, XSD + "boolean"))
        else:
            name = next((n for n, pattern in _NUMBERS if pattern.fullmatch(text)), None)
            if name is None:
                raise Malformed(f"not expected: {text}")
            self.put(("literal", text, None, XSD + name))
        return None

    def mark(self, text: str, top: _Frame) -> None:
        if text == "[":
            self.stack.append(_Frame(s=self.blank()))
        elif text == "(":
            self.stack.append(_Frame(listed=True))
        elif text in "])" and len(self.stack) > 1 and top.listed == (text == ")"):
            if not top.listed and top.expect == "object":
                raise Malformed("object expected: ]")
            self.stack.pop()
            if top.head is not None:
                self.out.append((top.s, RDF + "rest", ("uri", RDF + "nil", None, None)))
            below = self.stack[-1]
            below.may_end = below.expect == "subject" and not below.listed and not top.listed and top.p is not None
            self.put((top.head or ("uri", RDF + "nil", None, None)) if top.listed else top.s)
        elif text == ";" and not top.listed and (top.expect == "after" or (top.expect == "predicate" and top.p is not None)):
            top.expect, top.may_end = "predicate", True
        elif text == "," and not top.listed and top.expect == "after":
            top.expect = "object"
        else:
            raise Malformed(f"not expected: {text}")


def _parser(directives_only: bool):
    """Maps pieces in order to triples, or to the directives of their statements; errors have a row of their own.

    A row with ``known`` comes before the pieces of a block: the directives of its file, in order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, known, used, names, base, now, failed = None, [], 0, {}, "", None, False
        for batch in batches:
            out: list[tuple] = []

            def finish() -> None:
                if now is not None and not failed and not now.whole() and not directives_only:
                    out.append((*[None] * 4, place[0], *[None] * 3, now.number, "not ended"))

            for file, block, number, text, quote, given, blanks in zip(
                    *(batch[c] for c in ["file", "block", "statement", "text", "quote", "known", "blanks"]), strict=True):
                if given is not None:
                    finish()
                    place, known, used, names, base, now = (file, block), list(given), 0, {}, "", None
                    continue
                if now is None or (file, block, number) != (*place, now.number):
                    finish()
                    if place != (file, block):
                        place, known, used, names, base = (file, block), [], 0, {}, ""
                    # Of several directives for one name, the last before the statement counts.
                    while used < len(known) and known[used]["statement"] < number:
                        iri = _resolved(base, known[used]["iri"])
                        if known[used]["name"] is None:
                            base = iri
                        else:
                            names[known[used]["name"]] = iri
                        used += 1
                    now, failed = Statement(blanks, number, dict(names) if directives_only else names, base), False
                if failed or (directives_only and now.begun):
                    continue
                try:
                    for kind, token, _ in tokens(text, quote):
                        now.take(kind, token)
                        if directives_only and now.begun:
                            break
                except Malformed as e:
                    failed = True
                    if not directives_only:
                        out.append((*[None] * 4, file, *[None] * 3, number, str(e)[:200]))
                if directives_only:
                    out.extend((name, iri, str(turn), None, file, *[None] * 3, number, None) for turn, name, iri in now.directives)
                    now.directives.clear()
                else:
                    out.extend((s[1], p, o[1], o[0], file, s[0], o[2], o[3], number, None) for s, p, o in now.out)
                now.out.clear()
            yield pd.DataFrame(out, columns=[*_TRIPLE, "statement", "error"])
        if now is not None and not failed and not now.whole() and not directives_only:
            yield pd.DataFrame([(*[None] * 4, place[0], *[None] * 3, now.number, "not ended")], columns=[*_TRIPLE, "statement", "error"])

    return run


def parse_turtle(lines: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Lines ``file, start, row, value`` to one triple set and the errors ``src, statement, error``.

    ``start`` orders the splits of a file and ``row`` the lines of a split; the result is the same however a file is
    split. A null line is an empty one. A file with an error gives no triple. Blank nodes are named after their file; a
    relative IRI stays relative where the file states no base; line ends in long strings are LF. Other columns are left out.
    """
    lines = lines.select("file", F.col("start").cast("long").alias("start"), F.col("row").cast("long").alias("row"), F.coalesce("value", F.lit("")).alias("value"))
    ordered = lambda rows: rows.repartition("file", "start").sortWithinPartitions("file", "start", "row")
    splits = ordered(lines).mapInPandas(_summed, "file string, start long, begin int, end int, ends long")
    begins = splits.groupBy("file").applyInPandas(_joined, "file string, start long, begin int, number long")
    pieces = ordered(lines.join(F.broadcast(begins), ["file", "start"])).mapInPandas(
        _cut, "file string, statement long, start long, row long, piece int, text string, quote string")
    blanks = F.substring(F.md5(F.col("file").cast("binary")), 1, 8)
    pieces = written(pieces.withColumns({"block": F.expr(f"statement div {int(block)}"), "blanks": blanks}))

    order = ["file", "block", "statement", "start", "row", "piece"]
    stream = lambda rows, only: rows.repartition("file", "block").sortWithinPartitions(*order).mapInPandas(_parser(only), _PARSED)
    told = pieces.filter(F.col("text").rlike(r"(?i)(^|[\s.>])@?(prefix|base)([\s<#:]|$)")).select("file", "statement").distinct()
    kinds = "array<struct<statement:long,turn:int,name:string,iri:string>>"
    heads = stream(pieces.join(told, ["file", "statement"]).withColumn("known", F.lit(None).cast(kinds)), True)
    heads = heads.select(F.col("src").alias("file"), F.struct(
        "statement", F.col("o").cast("int").alias("turn"), F.col("s").alias("name"), F.col("p").alias("iri")).alias("d"))
    known = heads.groupBy("file").agg(F.array_sort(F.collect_list("d")).alias("known"))  # as many as the file has directives
    first = pieces.select("file", "block").distinct().join(known, "file").selectExpr(
        "file", "-1L AS statement", "-1L AS start", "-1L AS row", "-1 AS piece", "'' AS text", "'' AS quote", "block", "'' AS blanks", "known")
    parsed = written(stream(pieces.withColumn("known", F.lit(None).cast(kinds)).unionByName(first), False))
    errors = parsed.filter("error IS NOT NULL").select("src", "statement", "error")
    # Dealt first: a stored split holds far more rows than its bytes tell, and would be one map of distinct rows.
    key = [*KEY, *TERM, "src"]
    good = dealt(parsed, key, DEALT).filter("error IS NULL").join(F.broadcast(errors.select("src").distinct()), "src", "left_anti")
    good = good.select("s", "p", "o", "o_kind", F.lit(None).cast("string").alias("g"), "src", *TERM)
    return good.dropDuplicates(key), errors


def scan_turtle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All Turtle files under a path; a long file is read by several tasks. ``src`` is the path of the file."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"), "value")
    return parse_turtle(lines)
