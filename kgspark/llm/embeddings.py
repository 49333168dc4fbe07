"""Near-duplicate vectors by spherical-cap filters: a random product code, list decoding, a join on filters, proof.

A vector is turned by a structured random rotation (signs and Hadamard steps, three times) and cut into BLOCKS
parts. Each part has a random code of unit vectors; a filter is one code word from each part, so there are
words ** BLOCKS filters. List decoding finds all filters whose direction exceeds the cap's threshold. Vectors of one
label meet under their common filters, and every pair that meets is decided by its cosine in double precision.
The number of filters follows the number of vectors, so the expected size of a bucket of unrelated vectors does not
grow; the cap is as wide as gives EXPECTED filters to a vector on average, and no vector gets fewer than LEAST.

A bucket of more than TILE vectors is cut into tiles of two chunks. A pair that meets under several filters counts
under the smallest common one. Each tile returns only a number of links and one star edge for each vector.

Rules for input: vectors that are null, zero, or hold null or non-finite components, rows without label and rows
without id link with nothing; vectors of different lengths do not link. vec_id is the key: rows that repeat an id
give equal rows, made from the smallest (label, embedding) of that id. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import attach_groups, checkpoint, stored
from kgspark.llm.components import components

THRESHOLD = 0.98
BLOCKS, EXPECTED, TILE, SEED = 4, 40, 512, 20240229
#: Filters that a vector gets at least: its best ones, where fewer exceed the cap.
LEAST = 16
#: Filters for each emitted (vector, filter) row.
FILTERS_PER_ROW = 4


class CapCode:
    """The rotation, code words and cap threshold for vectors of one length."""

    def __init__(self, size: int, words: int) -> None:
        random = np.random.default_rng([SEED, size])
        self.size, self.words = size, words
        self.width = max(4 * BLOCKS, 1 << (size - 1).bit_length())
        self.signs = random.choice([-1.0, 1.0], (3, self.width))
        code = random.standard_normal((BLOCKS, words, self.width // BLOCKS))
        self.code = code / np.linalg.norm(code, axis=2, keepdims=True)
        share = min(0.25, EXPECTED / words**BLOCKS)
        self.least = NormalDist().inv_cdf(1 - share) / math.sqrt(self.width) * math.sqrt(BLOCKS)

    def rotated(self, unit: np.ndarray) -> np.ndarray:
        x = np.zeros((len(unit), self.width))
        x[:, : self.size] = unit
        for signs in self.signs:
            x = x * signs
            step = 1
            while step < self.width:
                pairs = x.reshape(len(x), -1, 2, step)
                x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(x), self.width)
                step *= 2
            x = x / math.sqrt(self.width)
        return x

    def filters(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each vector the sorted numbers of all filters whose direction exceeds the cap."""
        parts = self.rotated(unit).reshape(len(unit), BLOCKS, -1)
        scores = np.einsum("nbw,bcw->nbc", parts, self.code)
        out = []
        for row in scores:
            left = (row[0][:, None] + row[1]).ravel()
            right = (row[2][:, None] + row[3]).ravel()
            # halves that can reach the threshold with the best of the other half
            a, b = np.flatnonzero(left + right.max() >= self.least), np.flatnonzero(right + left.max() >= self.least)
            i, j = np.nonzero(left[a][:, None] + right[b] >= self.least)
            if len(i) < LEAST:  # the best LEAST pairs are among the best LEAST of both halves
                a, b = np.argsort(-left)[:LEAST], np.argsort(-right)[:LEAST]
                sums = left[a][:, None] + right[b]
                i, j = np.unravel_index(np.argsort(-sums, axis=None)[:LEAST], sums.shape)
            out.append(np.sort(a[i].astype(np.int64) * self.words**2 + b[j]))
        return out


def _decoded(words: int):
    """Maps (vec_id, label, embedding) to (vec_id, label, size, unit, filters) of the vectors that can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, CapCode] = {}
        for batch in batches:
            column = batch.column("embedding")
            sizes = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            ids, labels = batch.column("vec_id").to_pylist(), batch.column("label").to_pylist()
            rows: list[list] = [[], [], [], [], []]
            for size in set(sizes.tolist()) - {0}:
                at = np.flatnonzero(sizes == size)
                values = column.take(pa.array(at)).flatten().cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False).reshape(-1, size)
                with np.errstate(all="ignore"):
                    # scaled first, so that no square is lost or infinite
                    scaled = values / np.abs(values).max(axis=1, keepdims=True)
                    unit = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
                good = np.isfinite(values).all(axis=1) & np.isfinite(unit).all(axis=1)
                at, unit = at[good], unit[good]
                code = codes.setdefault(size, CapCode(size, words))
                for place, vector, found in zip(at.tolist(), unit, code.filters(unit), strict=True):
                    for held, value in zip(rows, (ids[place], labels[place], size, vector.tobytes(), found), strict=True):
                        held.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], ["vec_id", "label", "size", "unit", "filters"])

    return run


def _tile_links(ids: np.ndarray, chunks: np.ndarray, units: np.ndarray, filters: list[np.ndarray], own: int, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that count in this tile, and the smallest id each vector reaches inside it."""
    near = units @ units.T >= THRESHOLD
    near &= ids[:, None] != ids
    if i != j:
        near &= chunks[:, None] != chunks
    root = ids.copy()
    while True:
        reached = np.minimum(root, np.where(near, root, np.iinfo(np.int64).max).min(axis=1))
        if (reached == root).all():
            break
        root = reached
    some = np.flatnonzero(near.any(axis=1))
    links = np.zeros(len(ids), np.int64)
    if len(some):
        before = [filters[k][filters[k] < own] for k in some]
        names, column = np.unique(np.concatenate(before), return_inverse=True)
        has = np.zeros((len(some), len(names)), np.float32)
        has[np.repeat(np.arange(len(some)), [len(b) for b in before]), column] = 1
        links[some] = (near[np.ix_(some, some)] & ~(has @ has.T > 0)).sum(axis=1)
    return links, root


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, links, root) for each vector of each tile; rows come in order of tile, at most two chunks of each."""
    key, held = None, []

    def done() -> list[tuple]:
        if len(held) < 2:
            return []
        _, _, own, i, j = key
        ids = np.array([r[0] for r in held], np.int64)
        units = np.stack([np.frombuffer(r[2]) for r in held])
        links, root = _tile_links(ids, np.array([r[1] for r in held]), units, [np.array(r[3], np.int64) for r in held], own, i, j)
        return [(a, n, r) for a, n, r in zip(ids.tolist(), links.tolist(), root.tolist(), strict=True) if n or a != r]

    def told(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["vec_id", "links", "root"])

    for batch in batches:
        out = []
        names = ("label", "size", "filter", "i", "j"), ("vec_id", "chunk", "unit", "filters")
        tiles, rows = (zip(*(batch.column(c).to_pylist() for c in group), strict=True) for group in names)
        for tile, row in zip(tiles, rows, strict=True):
            if tile != key:
                out += done()
                key, held = tile, []
            held.append(row)
        yield told(out)
    yield told(done())


def links_and_roots(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, n_links) of linked vectors, and the star edges (a, b) of their components."""
    fit = embeddings.where("vec_id is not null and label is not null and embedding is not null")
    one = fit.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct(F.col("label").cast("long").alias("label"), "embedding")).alias("row"))
    one = one.select("vec_id", "row.label", "row.embedding")
    words = max(8, math.ceil((FILTERS_PER_ROW * EXPECTED * max(1, embeddings.count())) ** (1 / BLOCKS)))
    decoded = stored(one.mapInArrow(_decoded(words), "vec_id long, label long, size int, unit binary, filters array<long>"))

    rows = decoded.select("vec_id", "label", "size", F.explode("filters").alias("filter")).select("vec_id", F.struct("label", "size", "filter").alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / TILE).cast("int"))
    members = attach_groups(rows, checkpoint(buckets), "bucket", "n").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), "parts").cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least("chunk", k).alias("i"), F.greatest("chunk", k).alias("j")))
    tiled = members.select("vec_id", "bucket.label", "bucket.size", "bucket.filter", "chunk", F.explode(others).alias("tile"))
    tiled = tiled.select("vec_id", "label", "size", "filter", "chunk", "tile.i", "tile.j")
    order = ["label", "size", "filter", "i", "j"]
    found = stored(
        tiled.join(decoded.select("vec_id", "unit", "filters"), "vec_id")
        .repartition(*order)
        .sortWithinPartitions(*order, "vec_id")
        .mapInArrow(_tiles, "vec_id long, links long, root long")
    )
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    return counts, found.where("vec_id != root").select(F.col("vec_id").alias("a"), F.col("root").alias("b"))


def linked(embeddings: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of embeddings (vec_id, label, embedding)."""
    counts, edges = links_and_roots(embeddings.select("vec_id", "label", "embedding"))
    groups = components(edges).withColumnRenamed("node", "vec_id")
    return (
        embeddings.select(F.col("vec_id").cast("long").alias("vec_id"))
        .join(counts, "vec_id", "left")
        .join(groups, "vec_id", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
            F.col("vec_id").eqNullSafe(F.coalesce("component", "vec_id")).alias("kept"),
        )
    )
