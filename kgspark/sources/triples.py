"""Reading, writing and comparing triple tables.

A triple table is ``s, p, o, o_kind, g, src`` (see ``schemas.TRIPLES``) and may carry ``lang`` and ``datatype`` of
literals and ``s_kind``. Kinds are ``uri``, ``blank`` and ``literal``. Text files hold N-Triples lines; parquet is the
format for anything large.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

KEY = ["s", "p", "o", "o_kind"]
TERM = ["s_kind", "lang", "datatype"]
# One N-Triples (or N-Quads) line: subject, predicate, object, optional graph, dot.
_IRI, _BLANK = r"<[^\x00-\x20<>]*>", r"_:[^\s<>\"]*[^\s<>\".]"
_LITERAL = r'"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^' + _IRI + ")?"
_LINE = rf"^\s*({_IRI}|{_BLANK})\s*({_IRI})\s*({_IRI}|{_BLANK}|{_LITERAL})\s*({_IRI}|{_BLANK})?\s*\.\s*(?:#.*)?$"
_MARK = "\u0001"  # no term but a literal can hold it, and the literal comes last


def term_key(triples: DataFrame) -> list[str]:
    """The columns that make a triple: two literals of different language or type are different."""
    return [*[c for c in KEY if c in triples.columns], *[c for c in TERM if c in triples.columns]]


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    """The string escapes of N-Triples undone, in one pass from left to right; null where one names no character.

    Two escapes that are the halves of one UTF-16 pair are one character; a half alone is none.
    """
    plain = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}
    pattern = re.compile(r"\\(u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)

    def char(m: re.Match) -> str:
        code = m[1]
        if len(code) == 1:
            return plain.get(code, code)
        value = int(code[1:5], 16) if code[0] == "u" else int(code[1:], 16)
        if len(code) == 11:
            value = 0x10000 + ((value - 0xD800) << 10) + int(code[7:], 16) - 0xDC00
        if value > 0x10FFFF or 0xD800 <= value < 0xE000:
            raise ValueError(code)
        return chr(value)

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else pattern.sub(char, text)
        except ValueError:
            return None

    return texts.map(one)


def _plain(c: Column) -> Column:
    """Only texts that hold an escape go to Python."""
    escaped = F.contains(c, F.lit("\\"))
    return F.when(escaped, _unescaped(F.when(escaped, c))).otherwise(c)


def _escape(c: Column) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for ch, esc in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(ch), F.lit(esc))
    return out


def _kind(c: Column) -> Column:
    return F.when(c.startswith('"'), F.lit("literal")).when(c.startswith("_:"), F.lit("blank")).otherwise(F.lit("uri"))


def parse_ntriples(lines: DataFrame, text: str = "value", src: Column | None = None) -> DataFrame:
    """Lines to triples plus ``ok``: false for lines that are neither triple, comment nor blank.

    The line's pattern is evaluated once; its groups are cut from the result, the object last.
    """
    c = F.col(text)
    cut = F.split(F.regexp_replace(c, _LINE, f"{_MARK}$1{_MARK}$2{_MARK}$4{_MARK}$3"), _MARK, 5)
    held = lines.filter(~c.rlike(r"^\s*(#.*)?$")).select(
        cut.alias("t"), (src if src is not None else F.col("src")).alias("src"), c.alias("line"))
    held = held.withColumn("ok", (F.size("t") == 5) & (F.get("t", F.lit(0)) == "") & ~F.col("line").startswith(_MARK))
    part = lambda i: F.when(F.col("ok"), F.get("t", F.lit(i))).otherwise(F.lit(""))
    held = held.withColumns({"a": part(1), "b": part(2), "c": part(3), "d": part(4)})
    close = F.length("d") - F.position(F.lit('"'), F.reverse("d")) + 1
    literal = F.col("d").startswith('"')
    tail = F.when(literal, F.expr("substring(d, length(d) - position('\"', reverse(d)) + 2)"))
    held = held.withColumns({"body": F.when(literal, F.substring("d", F.lit(2), close - 2)), "tail": tail})
    # Generated, so that the terms below are built from finished columns and not from the pattern's expression again.
    held = held.select(F.explode(F.array(F.struct("a", "b", "c", "d", "body", "tail", "ok", "src", "line"))).alias("x")).select("x.*")
    literal = F.col("d").startswith('"')
    bare = lambda x: F.regexp_replace(x, "^<|>$", "")
    held = held.withColumns({
        "s": _plain(bare(F.col("a"))),
        "p": _plain(bare(F.col("b"))),
        "o": _plain(F.when(literal, F.col("body")).otherwise(bare(F.col("d")))),
        "g": F.when(F.col("c") != "", _plain(bare(F.col("c")))),
        "datatype": F.when(F.col("tail").startswith("^^"), _plain(F.regexp_replace("tail", r"^\^\^<|>$", ""))),
    })
    # A term with an escape that names no character is null, and its line is rejected.
    whole = F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull()
    whole = whole & ((F.col("c") == "") | F.col("g").isNotNull()) & (~F.coalesce(F.col("tail"), F.lit("")).startswith("^^") | F.col("datatype").isNotNull())
    return held.select(
        "s", "p", "o",
        _kind(F.col("d")).alias("o_kind"),
        "g", "src",
        (F.col("ok") & whole).alias("ok"),
        "line",
        _kind(F.col("a")).alias("s_kind"),
        F.when(F.col("tail").startswith("@"), F.lower(F.substring("tail", 2, 1000))).alias("lang"),
        "datatype",
    )


def scan_ntriples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All files under a path as one triple set, and the rejected lines with their file.

    Blank nodes are named after their file, so equal names in two files stay two nodes; names that a scan has given
    before are kept.
    """
    lines = spark.read.text(path).withColumn("src", F.col("_metadata.file_name"))
    parsed = parse_ntriples(lines)
    own = lambda c: F.when(F.col(c).startswith("_:") & ~F.col(c).rlike("^_:f[0-9a-f]{8}x"), F.concat(
        F.lit("_:f"), F.substring(F.md5(F.col("src").cast("binary")), 1, 8), F.lit("x"), F.substring(c, 3, 2**30))).otherwise(F.col(c))
    named = parsed.filter("ok").withColumns({
        "s": F.when(F.col("s_kind") == "blank", own("s")).otherwise(F.col("s")),
        "o": F.when(F.col("o_kind") == "blank", own("o")).otherwise(F.col("o"))})
    good = named.drop("ok", "line").dropDuplicates([*KEY, *TERM, "g", "src"])
    return good, parsed.filter("NOT ok").select("src", "line")


def distinct_triples(triples: DataFrame) -> DataFrame:
    """Set semantics: one row per triple, whole terms compared."""
    return triples.select(*term_key(triples)).distinct()


def skip_disabled(triples: DataFrame, disabled: DataFrame) -> DataFrame:
    """Leave out sources listed in ``disabled(src)``."""
    return triples.join(disabled.select("src").distinct(), "src", "left_anti")


def toggle_disabled(disabled: DataFrame, toggles: DataFrame) -> DataFrame:
    """Sources in both lists are enabled again, sources in one list are disabled."""
    both = disabled.select("src").distinct().unionByName(toggles.select("src").distinct())
    return both.groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("src")


def snapshot_fingerprint(files: DataFrame) -> DataFrame:
    """md5 over the sorted ``name:size:mtime`` of a listing ``(name, size, mtime)``.

    A listing has one short row per file and the result is one value over all of them: one task holds the
    listing, about 100 MB for a million files.
    """
    entry = F.concat_ws(":", "name", F.col("size").cast("string"), F.col("mtime").cast("string"))
    return files.agg(
        F.md5(F.array_join(F.array_sort(F.collect_list(entry)), "|")).alias("fingerprint"),
        F.count(F.lit(1)).alias("n_files"),
    )


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """File listing without reading contents (column pruning drops them)."""
    return (
        spark.read.format("binaryFile").load(path)
        .select(
            F.col("_metadata.file_name").alias("name"),
            F.col("length").alias("size"),
            F.unix_micros("modificationTime").alias("mtime"),
        )
    )


def new_triples(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming triples that the set does not have yet, each once: of copies the one with the smallest source."""
    key = term_key(incoming)
    rest = [c for c in ("src", "g") if c in incoming.columns] + [c for c in incoming.columns if c not in (*key, "src", "g")]
    once = incoming.groupBy(*key).agg(F.min(F.struct(*rest)).alias("r")).select(*key, "r.*") if rest else incoming.distinct()
    known = existing.select(*[(F.col(c) if c in existing.columns else F.lit(None).cast("string")).alias(f"_{c}") for c in key]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) if c in TERM else F.col(c) == F.col(f"_{c}") for c in key]
    return once.join(known, same, "left_anti").select(*incoming.columns)


def append_triples(incoming: DataFrame, path: str, existing: DataFrame) -> None:
    new_triples(existing, incoming).write.mode("append").partitionBy("p").parquet(path)


def drop_graph(triples: DataFrame, graph: str | None = None) -> DataFrame:
    """Everything but one named graph, or but the default graph."""
    keep = F.col("g").isNotNull() if graph is None else ~F.col("g").eqNullSafe(F.lit(graph))
    return triples.filter(keep)


def ntriples_line(named: bool = False, terms: bool = False) -> Column:
    """A line; terms: the table has ``lang`` and ``datatype``. Blank nodes are known by their ``_:``."""
    iri = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
    tail = F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), F.col("lang"))).when(
        F.col("datatype").isNotNull(), F.concat(F.lit("^^<"), F.col("datatype"), F.lit(">"))).otherwise("") if terms else F.lit("")
    obj = F.when(F.col("o_kind") != "literal", iri("o")).otherwise(F.concat(F.lit('"'), _escape(F.col("o")), F.lit('"'), tail))
    graph = F.when(F.col("g").isNotNull(), F.concat(iri("g"), F.lit(" "))).otherwise("")
    head = F.concat(iri("s"), F.lit(" <"), F.col("p"), F.lit("> "), obj, F.lit(" "))
    return F.concat(head, graph if named else F.lit(""), F.lit("."))


def write_ntriples(triples: DataFrame, path: str, named: bool = False) -> None:
    terms = {"lang", "datatype"} <= set(triples.columns)
    triples.select(ntriples_line(named, terms).alias("value")).write.mode("overwrite").text(path)


def write_snapshot(triples: DataFrame, path: str) -> None:
    """Parquet partitioned by predicate, so that a pattern with a fixed predicate reads one folder."""
    triples.write.mode("overwrite").partitionBy("p").parquet(path)


def source_catalog(triples: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Triples per source, with the file size where a listing is given."""
    counts = triples.groupBy("src").agg(F.count(F.lit(1)).alias("triple_count"))
    if files is None:
        return counts
    sizes = files.select(F.col("name").alias("src"), F.col("size").alias("size_bytes"))
    return counts.join(sizes, "src", "full_outer")
