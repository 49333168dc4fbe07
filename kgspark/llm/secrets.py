"""Secret scans by a trigram inverted index, with DataFrame functions only.

Each rule's pattern gives a Boolean query over trigrams that every match must contain: AND of parts, each part an
OR of alternatives, each alternative an AND of trigrams of the lower-cased text. Postings (trigram, document) are
made for the queries' trigrams, intersected by counting, and the candidates are verified with the pattern itself.
A rule without a mandatory trigram is run over every text.

Rules for input: null text is empty; texts are scanned whole; every row gives one row with its columns and spans
(null doc_id included; rows that share an id are each verified on their own text). Offsets are code points.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

try:
    from re import _constants as syntax
    from re import _parser as parser
except ImportError:  # before Python 3.11
    import sre_constants as syntax
    import sre_parse as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Matches of pattern, leftmost and not overlapping, whose group has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# The three base kinds in order, then the kinds added here.
RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("repository", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
]
#: Alternatives of one part of a query; a part with more is given up (a weaker query, never a wrong one).
ALTERNATIVES = 64


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Parts that must all hold; a part holds if one of its alternatives' trigrams are all in the lower-cased text."""
    parts: list[list[frozenset[str]]] = []

    def close(strings: list[str]) -> list[str]:
        every = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        grams = sorted((g for g in every if not any(h < g for h in every)), key=sorted)
        if all(grams) and len(grams) <= ALTERNATIVES:
            parts.append(grams)
        return [""]

    def exact(items) -> list[str] | None:
        """All strings the items can match, lower-cased, or None if they are many or unknown."""
        strings = [""]
        for op, value in items:
            if op is syntax.LITERAL:
                more = [chr(value).lower()]
            elif op is syntax.IN and all(o is syntax.LITERAL for o, _ in value):
                more = [chr(v).lower() for _, v in value]
            elif op is syntax.SUBPATTERN:
                more = exact(value[3])
            elif op is syntax.BRANCH:
                branches = [exact(b) for b in value[1]]
                more = None if None in branches else list(itertools.chain(*branches))
            elif op in (syntax.MAX_REPEAT, syntax.MIN_REPEAT) and value[1] is not syntax.MAXREPEAT and value[1] <= 4:
                once = exact(value[2])
                more = None if once is None else ["".join(c) for k in range(value[0], value[1] + 1) for c in itertools.product(once, repeat=k)]
            else:
                more = None
            if more is None or len(strings) * len(more) > ALTERNATIVES:
                return None
            strings = list(dict.fromkeys(a + b for a in strings for b in more))
        return strings

    def walk(items, strings: list[str]) -> list[str]:
        for item in items:
            more = exact([item])
            if more is not None and len(strings) * len(more) <= ALTERNATIVES:
                strings = list(dict.fromkeys(a + b for a in strings for b in more))
                continue
            strings = close(strings)
            op, value = item
            if op is syntax.SUBPATTERN:
                strings = close(walk(value[3], strings))
            elif op in (syntax.MAX_REPEAT, syntax.MIN_REPEAT) and value[0] > 0:
                strings = close(walk(value[2], strings))
        return strings

    close(walk(parser.parse(pattern), [""]))
    return parts


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, doc_id): which of the trigrams each document's lower-cased text has."""
    low = docs.select("doc_id", F.lower("text").alias("low"))
    has = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]))
    return low.select("doc_id", F.explode(has).alias("gram"))


def candidates(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, rules): for each document the numbers of the rules whose trigram queries it satisfies."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    grams = sorted({g for q in queries.values() for part in q for alternative in part for g in alternative})
    number = {g: i for i, g in enumerate(grams)}
    asked = [
        (number[g], i, p, a, len(alternative), len(query))
        for i, query in queries.items()
        for p, part in enumerate(query)
        for a, alternative in enumerate(part)
        for g in alternative
    ]
    # As large as the rules, not as the data.
    wanted = F.broadcast(docs.sparkSession.createDataFrame(asked, "gram int, rule int, part int, alternative int, grams int, parts int"))
    whole = postings(docs, grams).join(wanted, "gram").groupBy("doc_id", "rule", "parts", "part", "alternative", "grams").agg(F.count_distinct("gram").alias("n"))
    held = whole.where("n = grams").groupBy("doc_id", "rule", "parts").agg(F.count_distinct("part").alias("n")).where("n = parts")
    return held.groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def _kept(found: str, groups: str | None, pieces: str, rule: Rule, rank: int) -> Column:
    """Spans (start, rank, end, kind) from the matches and the pieces of text between them."""
    step = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>").alias("spans"))
    size = F.size(found)
    rows = F.arrays_zip(F.slice(pieces, F.lit(1), size).alias("before"), F.col(found).alias("match"), F.col(groups or found).alias("value"))

    def add(state: Column, row: Column) -> Column:
        start = state["at"] + F.length(row["before"])
        end = start + F.length(row["match"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        more = F.when(F.length(row["value"]) >= rule.least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), more.alias("spans"))

    return F.when(size > 0, F.aggregate(rows, step, add, lambda s: s["spans"])).otherwise(step["spans"])


def scan(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """docs with spans, an array of (start, rank, end, kind) in order of start and rule."""
    rules = RULES if rules is None else rules
    names = docs.columns
    held = candidates(docs.select("doc_id", "text"), rules).withColumnRenamed("doc_id", "__id")
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce("text", F.lit("")).alias("__text"))
    rows = rows.join(held, F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id").withColumnRenamed("rules", "__rules")
    whole = [not trigram_query(r.pattern) for r in rules]
    tried = [F.lit(True) if w else F.coalesce(F.array_contains("__rules", i), F.lit(False)) for i, w in enumerate(whole)]
    none = F.array().cast("array<string>")
    rows = rows.withColumns({f"__found{i}": F.when(tried[i], F.regexp_extract_all("__text", F.lit(r.pattern), F.lit(0))).otherwise(none) for i, r in enumerate(rules)})
    hit = [F.size(f"__found{i}") > 0 for i in range(len(rules))]
    rows = rows.withColumns(
        {f"__pieces{i}": F.when(hit[i], F.split("__text", r.pattern, -1)).otherwise(none) for i, r in enumerate(rules)}
        | {f"__groups{i}": F.when(hit[i], F.regexp_extract_all("__text", F.lit(r.pattern), F.lit(r.group))).otherwise(none) for i, r in enumerate(rules) if r.group}
    )
    spans = F.concat(*[_kept(f"__found{i}", f"__groups{i}" if r.group else None, f"__pieces{i}", r, i) for i, r in enumerate(rules)])
    return rows.select(*[F.col(f"`{c}`") for c in names if c != "spans"], F.array_sort(spans).alias("spans"))


def told(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(scanned: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Counts and digests of scan()'s spans."""
    rules = RULES if rules is None else rules
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in rules if r.base]))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select(
        "doc_id",
        *[count(r.kind) for r in rules if r.base],
        F.sha2(told(base).cast("binary"), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )


def redacted(scanned: DataFrame, text: str = "text") -> DataFrame:
    """scan()'s rows with every span of the text replaced by its kind in brackets; overlapping spans give one mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(state: Column, span: Column) -> Column:
        gap = F.concat(F.substring(F.col(text), state["at"] + 1, span["start"] - state["at"]), F.lit("["), span["kind"], F.lit("]"))
        out = F.when(span["start"] >= state["at"], F.concat(state["out"], gap)).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), out.alias("out"))

    rest = lambda s: F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, F.lit(2**31 - 1) - s["at"] - 1))
    made = F.when(F.size("spans") > 0, F.aggregate("spans", start, add, rest)).otherwise(F.col(text))
    return scanned.withColumn(text, made).drop("spans")
