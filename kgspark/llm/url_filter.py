"""URL filters by a Bloom filter cascade, with DataFrame functions only.

A url's keys are its host's suffixes joined to the beginnings of its path, in the shapes (labels of the host,
characters of the path) that the list has. Level 1 is a Bloom filter of the listed keys; level 2 is one of the
corpus's keys that level 1 takes for listed by mistake; level 3 one of the listed keys that level 2 takes for those,
and so on until no mistake is left. A key of the corpus is listed when the first level that lacks it has an even
number, or when it is in all of an odd number of levels. That is exact for every key of the corpus and every listed
key, and needs no join: the filters are literals of the plan. Level 1 is sized so that its mistakes are
about as many as the listed keys, so all levels together grow with the list and not with the corpus.

A second cascade over the listed keys tells which of them block. The longest listed key of a url is its rule; with
equal lengths the longer host. Urls without a rule get `default`, the verdict of what no list holds.

Filters beyond FILTER_BITS would be too large for the plan; such lists are joined by key instead.

Rules for input: a null url, or one without ://, has empty host and path and no keys; every row gives one row, repeated
rows and ids too; other columns are ignored. Of equal rules one stays, and block wins over allow; rules with a null
or empty host fit nothing, a null path is empty.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import checkpoint

# Fixed values: (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Bits of one level at most; 4 MB.
FILTER_BITS = 1 << 25
#: A cascade ends after a few more levels than the logarithm of its keys; more mean that the hashes are not random.
LEVELS = 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    """A Bloom filter of `bits` bits with `hashes` hash functions of its own number; words is its array of longs."""

    number: int
    bits: int
    hashes: int
    words: str

    def holds(self, key: Column) -> Column:
        words = F.split(F.lit(self.words), ",").cast("array<bigint>")  # folded to one literal
        found = F.lit(True)
        for i in range(self.hashes):
            at = _place(key, self.number, F.lit(i), self.bits)
            found = found & (F.getbit(F.get(words, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1)
        return found


def _place(key: Column, number: int, i: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(number), i), F.lit(bits).cast("long"))


def bloom_level(keys: DataFrame, number: int, rate: float, count: int, limit: int = FILTER_BITS) -> Level | None:
    """The filter of `count` distinct keys (key) with about `rate` false positives; None when it needs more than limit bits."""
    bits = 64 * math.ceil(max(1, count) * math.log2(1 / rate) / math.log(2) / 64)
    if bits > limit:
        return None
    hashes = max(1, round(math.log2(1 / rate)))
    ids = F.explode(F.array(*[F.lit(i) for i in range(hashes)]))
    places = keys.select("key", ids.alias("i")).select(_place(F.col("key"), number, F.col("i"), bits).alias("at"))
    set_bits = places.select(F.floor(F.col("at") / 64).alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bits"))
    every = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = set_bits.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    row = words.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w"))  # bits / 64 <= limit / 64 elements
    return Level(number, bits, hashes, row.select(F.array_join(F.col("w.bits").cast("array<string>"), ",")).first()[0])


def _shared_keys(left: DataFrame, right: DataFrame) -> DataFrame:
    """The keys of left with held: whether right has them too; by grouping, not by a join."""
    both = left.select("key", F.lit(False).alias("held"), F.lit(True).alias("own")).unionByName(right.select("key", F.lit(True).alias("held"), F.lit(False).alias("own")))
    return both.groupBy("key").agg(F.max("held").alias("held"), F.max("own").alias("own")).where("own").select("key", "held")


def cascade(listed: DataFrame, universe: DataFrame, limit: int = FILTER_BITS) -> list[Level] | None:
    """Levels that are exact for all keys (key) of listed and universe; None when a level needs more than limit bits."""
    listed = checkpoint(listed.select("key").where("key is not null").distinct())
    n = listed.count()
    if not n:
        return []
    spread = universe.agg(F.approx_count_distinct("key")).first()[0]
    rate = min(0.5, math.sqrt(0.5) * n / max(1, spread))
    first = bloom_level(listed, 1, rate, n, limit)
    if first is None:
        return None
    levels, inside = [first], listed
    mistaken = universe.where(first.holds(F.col("key"))).select("key").distinct()
    outside = checkpoint(_shared_keys(mistaken, listed).where("not held").select("key"))
    while count := outside.count():
        if len(levels) == LEVELS:
            raise ValueError("the levels do not get smaller")
        made = bloom_level(outside, len(levels) + 1, 0.5, count, limit)
        if made is None:
            return None
        levels.append(made)
        inside, outside = outside, checkpoint(inside.where(made.holds(F.col("key"))))
    return levels


def member(key: Column, levels: list[Level]) -> Column:
    """Whether a key is listed: decided by the first level that lacks it."""
    out = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        out = F.when(~level.holds(key), F.lit(level.number % 2 == 0)).otherwise(out)
    return out


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host after the first :// in lower case, the path up to ? or #; both empty without ://."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_table(rules: DataFrame) -> DataFrame:
    """(key, labels, size, block) of rules (host, path, verdict), one row for each key."""
    host, path = F.translate("host", UPPER, LOWER), F.coalesce("path", F.lit(""))
    shaped = rules.where("host <> ''").select(
        F.concat(host, path).alias("key"), F.size(F.split(host, "\\.")).alias("labels"), F.length(path).alias("size"), (F.col("verdict") == "block").alias("block")
    )
    return shaped.groupBy("key", "labels", "size").agg(F.max("block").alias("block"))


def url_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys (size, host_size, key) of a url in the given shapes of the list."""
    made = F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("size")) for a, b in shapes])
    labels = F.when(host == "", 0).otherwise(F.size(F.split(host, "\\.")))

    def key(shape: Column) -> Column:
        suffix = F.call_function("substring_index", host, F.lit("."), -shape["labels"])
        whole = F.concat(suffix, F.substring(path, F.lit(1), shape["size"]))
        return F.struct(F.length(whole).alias("size"), F.length(suffix).alias("host_size"), whole.alias("key"))

    return F.transform(F.filter(made, lambda s: (s["labels"] <= labels) & (s["size"] <= F.length(path))), key)


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", limit: int = FILTER_BITS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages (page_id, url) under rules (host, path, verdict)."""
    table = checkpoint(rule_table(rules))
    shapes = sorted(tuple(r) for r in table.select("labels", "size").distinct().collect())  # of the list, not of the corpus
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    no_key = F.array().cast("array<struct<size:int,host_size:int,key:string>>")
    keys = url_keys(F.col("host"), F.col("path"), shapes) if shapes else no_key
    corpus = pages.select(host.alias("host"), path.alias("path")).select(F.explode(keys).alias("k")).select("k.key")
    listed = cascade(table, corpus, limit)
    blocked = cascade(table.where("block"), table, limit)
    if listed is None or blocked is None:
        return _joined(urls.withColumn("keys", keys), table, default)
    best = F.array_max(F.filter(keys, lambda k: member(k["key"], listed)))["key"]
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(member(F.col("rule"), blocked), F.lit("block")).otherwise(F.lit("allow"))
    return urls.withColumn("rule", best).select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def _joined(urls: DataFrame, table: DataFrame, default: str) -> DataFrame:
    """The same for lists beyond the filters' bound: distinct keys meet the list in a join, and pages meet the hits by key."""
    rows = checkpoint(urls.withColumn("row", F.monotonically_increasing_id()))
    exploded = rows.select("row", F.explode("keys").alias("k")).select("row", "k", F.col("k.key").alias("key"))
    hits = exploded.join(table.select("key", "block"), "key").groupBy("row").agg(F.max(F.struct("k", "block")).alias("best"))
    verdict = F.when(F.col("best.block"), "block").when(F.col("best").isNotNull(), "allow").otherwise(default)
    return rows.join(hits, "row", "left").select("page_id", "host", "path", F.col("best.k.key").alias("rule"), verdict.alias("verdict"))
