"""Exact deduplication against immutable snapshots that carry static binary-fuse filters.

A snapshot is the table of its exact buckets (digest, smallest id, number of rows) and, for each shard of the digests,
a binary-fuse filter (three slots, one byte each: no false negative, one in 256 false positives). An incoming batch
is grouped by digest, screened by the filter of its shard, and only positives join the snapshot's buckets. What
remains is new, and its duplicates are the batch's own groups. Members of groups of more than one row are
compared byte by byte: their texts are grouped again by (digest, text), and a digest with two texts is split.

Texts are equal when identical after each run of white space (space, tab to carriage return) is one space.
Rules for input: null text is empty, and empty texts are equal; every row gives one row, repeated rows and ids
too; rows that repeat the staying row with its id are all marked kept, and kept_rows() leaves one of them; other
columns are ignored. A row without id never stays for others unless all its group lacks ids.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import attach_groups, checkpoint, stored

#: Digests of one filter, on average.
SHARD_KEYS = 200_000
U = np.uint64


class FuseFilter:
    """A binary-fuse filter of distinct 64-bit keys; peeled in rounds, each as whole arrays."""

    def __init__(self, segment: int, count: int, seed: int, prints: np.ndarray) -> None:
        self.segment, self.count, self.seed, self.prints = segment, count, seed, prints

    @staticmethod
    def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
        x = keys + U(seed)
        x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U(33))

    @staticmethod
    def _slots(mixed: np.ndarray, segment: int, count: int) -> np.ndarray:
        """Three slots in three neighbouring segments for every key, and no key twice in one slot."""
        first = ((mixed >> U(32)) * U(count)) >> U(32)
        inside = U(segment - 1)
        low = (mixed * U(0x9E3779B97F4A7C15)) >> U(8)
        return np.stack([(first + U(k)) * U(segment) + ((low >> U(18 * k)) & inside) for k in range(3)]).astype(np.int64)

    @staticmethod
    def _print(mixed: np.ndarray) -> np.ndarray:
        return (mixed ^ (mixed >> U(32))).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys)
        n = max(2, len(keys))
        segment = min(1 << max(2, int(math.log(n) / math.log(3.33) + 2.25)), 1 << 18)
        slots = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
        count = max(1, math.ceil(slots / segment) - 2)
        for seed in range(1, 200):
            if seed % 20 == 0:
                count += max(1, count // 10)
            mixed = cls._mixed(keys, seed * 0x9E3779B97F4A7C15 % (1 << 64))
            if (made := cls._peeled(mixed, segment, count)) is not None:
                return cls(segment, count, seed, made)
        raise ValueError("no seed peels these keys")

    @classmethod
    def _peeled(cls, mixed: np.ndarray, segment: int, count: int) -> np.ndarray | None:
        size = (count + 2) * segment
        slots, rounds, open_keys = cls._slots(mixed, segment, count), [], np.arange(len(mixed))
        while len(open_keys):
            at = slots[:, open_keys]
            load = np.bincount(at.ravel(), minlength=size)
            alone = load[at] == 1
            free = alone.any(axis=0)
            if not free.any():
                return None
            rounds.append((open_keys[free], at[:, free], alone[:, free].argmax(axis=0)))
            open_keys = open_keys[~free]
        prints = np.zeros(size, np.uint8)
        for keys, at, which in reversed(rounds):
            own = at[which, np.arange(len(keys))]
            prints[own] = 0
            prints[own] = cls._print(mixed[keys]) ^ prints[at[0]] ^ prints[at[1]] ^ prints[at[2]]
        return prints

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        """True for every key of the filter, and for about one other in 256."""
        mixed = self._mixed(keys, self.seed * 0x9E3779B97F4A7C15 % (1 << 64))
        at = self._slots(mixed, self.segment, self.count)
        return self._print(mixed) == (self.prints[at[0]] ^ self.prints[at[1]] ^ self.prints[at[2]])


def normalised(text: str | Column = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def digest(text: str | Column = "text") -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def buckets(keyed: DataFrame) -> DataFrame:
    """The exact buckets (digest, first, size) of rows (doc_id, digest)."""
    return keyed.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("size"))


def _sharded(bucketed: DataFrame, shards: int) -> DataFrame:
    key = F.xxhash64("digest")
    return bucketed.withColumn("key", key).withColumn("shard", F.pmod(F.hash("key"), F.lit(shards)))


def build_filters(bucketed: DataFrame, shards: int) -> DataFrame:
    """One filter for each shard of a snapshot's digests, about SHARD_KEYS of them in each."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        made = FuseFilter.build(rows["key"].to_numpy(np.int64).astype(U))
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "segment": [made.segment], "count": [made.count], "seed": [made.seed], "prints": [made.prints.tobytes()]})

    return _sharded(bucketed, shards).select("shard", "key").groupBy("shard").applyInPandas(build, "shard int, segment int, count int, seed int, prints binary")


def screen(bucketed: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """bucketed with column maybe: whether the snapshot's filter of the digest's shard has it."""

    def look(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = rows.drop(columns=["key", "shard"])
        if len(held):
            made = held.iloc[0]
            found = FuseFilter(int(made["segment"]), int(made["count"]), int(made["seed"]), np.frombuffer(made["prints"], np.uint8))
            return out.assign(maybe=found.maybe(rows["key"].to_numpy(np.int64).astype(U)))
        return out.assign(maybe=False)

    columns = ", ".join(f"{c} {t}" for c, t in bucketed.dtypes)
    return _sharded(bucketed, shards).groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(look, f"{columns}, maybe boolean")


def merge_batch(snapshot: DataFrame, filters: DataFrame, batch: DataFrame, shards: int) -> DataFrame:
    """The buckets of a snapshot and a batch together; only digests that the filters let through join the snapshot."""
    screened = checkpoint(screen(batch, filters, shards))
    known = screened.where("maybe").select("digest", F.col("first").alias("new_first"), F.col("size").alias("new_size")).join(snapshot, "digest")
    known = checkpoint(known.select("digest", F.least("first", "new_first").alias("first"), (F.col("size") + F.col("new_size")).alias("size")))
    old = snapshot.join(known.select("digest"), "digest", "left_anti")
    new = screened.where("not maybe").unionByName(screened.where("maybe").join(known.select("digest"), "digest", "left_anti")).drop("maybe")
    return old.unionByName(new).unionByName(known)


def _checked(docs: DataFrame, keyed: DataFrame, merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keyed, merged) with digests that stand for more than one text split by their bytes."""
    members = attach_groups(keyed, merged.where("size > 1"), "digest", "size").select("doc_id", "digest")
    texts = docs.select("doc_id", normalised().alias("text")).join(members.distinct(), "doc_id").where(F.sha2(F.col("text").cast("binary"), 256) == F.col("digest"))
    split = texts.groupBy("digest", "text").agg(F.min("doc_id").alias("first")).groupBy("digest").count().where("count > 1").select("digest")
    split = checkpoint(split)
    if not split.count():
        return keyed, merged
    exact = docs.select("doc_id", normalised().alias("text")).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)).join(split, "digest")
    exact = checkpoint(exact.select("doc_id", F.concat("digest", F.lit("/"), F.hex(F.col("text").cast("binary"))).alias("digest")))
    keyed = keyed.join(split, "digest", "left_anti").unionByName(exact)
    return keyed, merged.join(split, "digest", "left_anti").unionByName(buckets(exact))


def groups_of(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of docs (doc_id, text).

    The lower half of the ids is the snapshot, the others are the batch that comes to it.
    """
    keyed = stored(docs.select("doc_id", digest().alias("digest")))
    middle, total = keyed.agg(F.percentile_approx("doc_id", 0.5, 1000), F.count("*")).first()
    early = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(True))
    shards = max(1, math.ceil(total / SHARD_KEYS))
    snapshot, batch = checkpoint(buckets(keyed.where(early))), buckets(keyed.where(~early))
    merged = checkpoint(merge_batch(snapshot, build_filters(snapshot, shards), batch, shards))
    keyed, merged = _checked(docs, keyed, merged)
    return attach_groups(keyed, merged, "digest", "size").select(
        "doc_id",
        F.col("first").alias("keep_id"),
        F.col("size").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("first")).alias("kept"),
        F.substring("digest", 1, 64).alias("text_sha256"),
    )


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, whole; of repeated rows of one id and text one stays."""
    told = checkpoint(groups_of(docs).select("doc_id", "kept", F.col("text_sha256").alias("digest")))
    dropped = told.where("not kept").select("doc_id", "digest").distinct()
    repeated = told.where("kept").groupBy("doc_id", "digest").count().where("count > 1").select("doc_id", "digest")
    rows = docs.withColumn("digest", digest())
    same = F.expr("r.doc_id <=> t.doc_id and r.digest = t.digest")
    single = rows.alias("r").join(dropped.unionByName(repeated).alias("t"), same, "left_anti")
    again = rows.alias("r").join(repeated.alias("t"), same, "left_semi").dropDuplicates(["doc_id", "digest"])
    return single.unionByName(again).drop("digest")
