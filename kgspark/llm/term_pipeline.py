"""Ranked lexical search by pipelined term partitioning.

Documents are read once, in shards of at most SHARD_DOCS; every shard keeps an inverted list for each term that an item
may hold. Terms belong to owners by weight, the heaviest first. Items travel in bundles: a bundle's sparse
accumulators of one shard pass through the owners' stages, each a cogroup of that shard's lists of the owner with
the accumulators, and every stage adds its integer contributions. After a stage the 10th best partial score of an
item is known over all shards; what cannot reach it with all terms still to come is left out, which is exact because
contributions are never negative. The last stage gives each shard's best documents, and the best of all are chosen.

Rules for input: null text has no terms; texts are read whole, in slices; every row is one document, repeated rows and
ids too; a null doc_id ranks behind equal scores; rows of items that share an id (null included) are one item with the
terms of all; other columns are ignored. Items without terms, and corpora without terms, give no rows.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgspark.llm.common import checkpoint, portions, small_batches, stored

#: Documents and distinct (document, term) pairs of one shard; a shard ends with the document that reaches either.
SHARD_DOCS, SHARD_PAIRS = 8192, 2_000_000
#: Items of one bundle, on average.
BUNDLE_ITEMS = 128
#: The share of all pairs that the first owners hold, up to each stage; the last owner has the rest.
OWNER_SHARES = (0.1, 0.4)
BEST = 10
#: Bits of the map of item terms that readers of documents look into: a fixed 1 MB for any number of items.
MAP_BITS = 1 << 23
#: Bytes of a text that are cut into terms at once.
SLICE = 1 << 20
# The terms of the contract.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of other ASCII characters become spaces, A-Z become lower case, bytes of longer characters stay.
FOLD = bytes(ord(chr(b).lower()) if b >= 128 or chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))

INDEX = "shard long, term binary, docs binary, tfs binary, df long, max_tf int, ratio double, ids array<long>, lens binary, n_docs long, n_terms long"


def counted(text: bytes) -> Counter:
    """How often each term occurs in a UTF-8 text."""
    if len(text) <= SLICE:
        return Counter(text.translate(FOLD).split())
    found, at = Counter(), 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        part = text[at:end].translate(FOLD)
        if end < len(text):
            space = part.rfind(b" ")
            while space < 0 and end < len(text):  # one term longer than a slice
                end = min(len(text), end + SLICE)
                part = text[at:end].translate(FOLD)
                space = part.rfind(b" ")
            if end < len(text):
                part, end = part[:space], at + space + 1
        found.update(part.split())
        at = end
    return found


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term) of items (item_id, text)."""
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    return items.select("item_id", F.explode(found.cast("array<binary>")).alias("term")).distinct()


def _term_map(terms: DataFrame) -> bytes:
    """A bit for the checksum of every item term; MAP_BITS bits, whatever the number of items."""
    at = F.pmod(F.crc32("term"), F.lit(MAP_BITS))
    words = terms.select(at.alias("at")).groupBy(F.floor(F.col("at") / 8).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(at % 8 as int))")).alias("bits"))
    out = bytearray(MAP_BITS // 8)
    for row in words.toLocalIterator():
        out[row["byte"]] = row["bits"]
    return bytes(out)


def indexed(docs: DataFrame, term_map: bytes) -> DataFrame:
    """INDEX rows: for every shard one row with its documents (ids, lens), and one row for each term with its list."""
    names = [f.split()[0] for f in INDEX.split(", ")]
    types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip(names, types)))
    shared = docs.sparkSession.sparkContext.broadcast(term_map)

    def rows(shard: int, ids: list, lens: array, lists: dict) -> Iterator[pa.RecordBatch]:
        sizes = np.frombuffer(lens, np.int32)
        head = [shard, None, None, None, None, None, None, ids, sizes.tobytes(), int((sizes > 0).sum()), int(sizes.sum(dtype=np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(head, types)], schema=schema)
        terms = list(lists)
        for start in range(0, len(terms), 5000):
            some = terms[start : start + 5000]
            made = []
            for term in some:
                at, tf = (np.frombuffer(a, np.int32) for a in lists[term])
                made.append((at.tobytes(), tf.tobytes(), len(at), int(tf.max()), float((sizes[at] / tf).min())))
            columns = [[shard] * len(some), some, *map(list, zip(*made)), *[[None] * len(some)] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types)], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, base, number = shared.value, TaskContext.get().partitionId() << 32, 0
        ids, lens, lists, pairs = [], array("i"), {}, 0
        for batch in portions(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                found = counted(text or b"")
                for term, tf in found.items():
                    bit = zlib.crc32(term) & (MAP_BITS - 1)
                    if held[bit >> 3] >> (bit & 7) & 1:
                        if (own := lists.get(term)) is None:
                            own = lists[term] = (array("i"), array("i"))
                        own[0].append(len(ids))
                        own[1].append(tf)
                        pairs += 1
                ids.append(doc_id)
                lens.append(found.total())
                if len(ids) == SHARD_DOCS or pairs >= SHARD_PAIRS:
                    yield from rows(base + number, ids, lens, lists)
                    ids, lens, lists, pairs, number = [], array("i"), {}, 0, number + 1
        if ids:
            yield from rows(base + number, ids, lens, lists)

    return small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(read, INDEX)


def _bundled(items: DataFrame) -> tuple[DataFrame, int]:
    """(item_id, bundle, item) with the items of a bundle numbered from 0, and the number of bundles."""
    ids = checkpoint(items.select("item_id").distinct())
    bundles = max(1, math.ceil(ids.count() / BUNDLE_ITEMS))
    placed = ids.withColumn("bundle", F.pmod(F.xxhash64("item_id"), F.lit(bundles)).cast("int"))
    number = F.row_number().over(Window.partitionBy("bundle").orderBy("item_id")) - 1
    return checkpoint(placed.withColumn("item", number)), bundles


def _weighted(terms: DataFrame, index: DataFrame, docs: int, length: int) -> DataFrame:
    """(item_id, term, weight, most, df): most bounds what the term can add to any document's score."""
    told = index.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("ratio").alias("ratio"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    # m is over 9 + 90 n N / L before rounding, so tf / (1000 tf + 8 m) is at most this.
    least = 1000 + 8 * (9 / F.col("max_tf") + 90.0 * docs / length * F.col("ratio"))
    most = F.floor(1e9 / least * (1 + 1e-9)).cast("long") + 1
    return terms.join(told, "term").select("item_id", "term", weight.alias("weight"), (weight * most).alias("most"), "df")


def _owner(shares: list[float]) -> Column:
    """The owner of a term by its weight; shares are falling weights where the next owner begins."""
    out = F.lit(len(shares))
    for i, least in reversed(list(enumerate(shares))):
        out = F.when(F.col("weight") >= least, i).otherwise(out)
    return out


def _stage(last: bool, docs: int, length: int):
    """The cogrouped work of one owner on one bundle in one shard."""
    best_type = pa.list_(pa.struct([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())]))
    schema = pa.schema([("shard", pa.int64()), ("bundle", pa.int32()), ("cells", pa.binary()), ("scores", pa.binary()), ("best", best_type)])

    def top(scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> list[dict]:
        out = []
        for item, row in enumerate(scores):
            at = np.flatnonzero(row)
            if len(at) > BEST:
                at = at[row[at] >= np.partition(row[at], -BEST)[-BEST]]
            at = at[np.lexsort((ids[at], null[at], -row[at]))][:BEST]
            out += [{"item": item, "doc_id": None if null[i] else int(ids[i]), "score": int(row[i])} for i in at]
        return out

    def work(key, lists: pa.Table, carried: pa.Table) -> pa.Table:
        head = carried.filter(pc.is_valid(carried["lens"])).to_pylist()[0]
        lens = np.frombuffer(head["lens"], np.int32)
        null = np.array([i is None for i in head["ids"]], bool)
        ids = np.array([0 if i is None else i for i in head["ids"]], np.int64)
        wide = lens.astype(object) if len(lens) and 90 * int(lens.max()) * docs >= 1 << 63 else lens.astype(np.int64)
        m = (10 + (90 * wide * docs) // length).astype(np.int64)
        floor, rest = np.array(head["floor"], np.int64), np.array(head["rest"], np.int64)
        scores = np.zeros((len(floor), len(lens)), np.int64)
        for cells, held in zip(carried["cells"].to_pylist(), carried["scores"].to_pylist()):
            if cells is not None:
                scores.ravel()[np.frombuffer(cells, np.int32)] = np.frombuffer(held, np.int64)
        for weight, items, at, tf in zip(*(lists[c].to_pylist() for c in ("weight", "items", "docs", "tfs"))):
            at, tf = np.frombuffer(at, np.int32), np.frombuffer(tf, np.int32).astype(np.int64)
            added = weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[at]))
            for item in items:
                scores[item, at] += added
        scores[scores + rest[:, None] < floor[:, None]] = 0
        cells = np.flatnonzero(scores)
        sparse = [None, None] if last else [cells.astype(np.int32).tobytes(), scores.ravel()[cells].tobytes()]
        values = [head["shard"], head["bundle"], *sparse, top(scores, ids, null)]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types)], schema=schema)

    return work


def ranked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score): the BEST documents (doc_id, text) of each item (item_id, text)."""
    numbered, bundles = _bundled(items)
    terms = checkpoint(item_terms(items))
    index = stored(indexed(docs, _term_map(terms)))
    heads = index.where("term is null")
    n_docs, length = heads.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    typed = numbered.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    if not n_docs:
        return typed.where("false")
    weighted = checkpoint(_weighted(terms, index, n_docs, length))
    cuts = weighted.select("term", "weight", "df").distinct().agg(F.expr(f"percentile(weight, array({', '.join(str(1 - s) for s in OWNER_SHARES)}), df)")).first()[0] or []
    same = F.col("w.item_id").eqNullSafe(F.col("n.item_id"))
    held = weighted.withColumn("owner", _owner(cuts)).alias("w").join(numbered.alias("n"), same)
    held = stored(held.select("term", "weight", "owner", "most", "bundle", "item"))
    per_bundle = held.groupBy("term", "weight", "owner", "bundle").agg(F.collect_list("item").alias("items"))
    lists = index.where("term is not null").select("shard", "term", "docs", "tfs").join(per_bundle, "term").drop("term")

    every = numbered.select("bundle", "item")
    carried, floors = None, every.withColumn("floor", F.lit(0).cast("long"))
    for owner in range(len(cuts) + 1):
        later = held.where(F.col("owner") > owner).groupBy("bundle", "item").agg(F.sum("most").alias("rest"))
        bounds = floors.join(later, ["bundle", "item"], "left").groupBy("bundle").agg(
            F.array_sort(F.collect_list(F.struct("item", F.coalesce("floor", F.lit(0)).alias("floor"), F.coalesce("rest", F.lit(0)).alias("rest")))).alias("b")
        )
        told = heads.select(F.col("shard").alias("of"), "ids", "lens", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("bundle")).join(
            bounds.select("bundle", F.col("b.floor").alias("floor"), F.col("b.rest").alias("rest")), "bundle"
        ).withColumnRenamed("of", "shard")
        right = told if carried is None else told.unionByName(carried.select("shard", "bundle", "cells", "scores"), allowMissingColumns=True)
        if carried is None:
            right = right.withColumns({"cells": F.lit(None).cast("binary"), "scores": F.lit(None).cast("binary")})
        own = lists.where(F.col("owner") == owner).select("shard", "bundle", "weight", "items", "docs", "tfs")
        made = own.groupBy("shard", "bundle").cogroup(right.groupBy("shard", "bundle")).applyInArrow(
            _stage(owner == len(cuts), n_docs, length), "shard long, bundle int, cells binary, scores binary, best array<struct<item:int,doc_id:long,score:long>>"
        )
        carried = stored(made)
        best = carried.select("bundle", F.explode("best").alias("b")).select("bundle", "b.*")
        order = Window.partitionBy("bundle", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= BEST)
        floors = every.join(top.where(F.col("rank") == BEST).select("bundle", "item", F.col("score").alias("floor")), ["bundle", "item"], "left")
    return top.join(numbered, ["bundle", "item"]).select("item_id", "rank", "doc_id", "score")
