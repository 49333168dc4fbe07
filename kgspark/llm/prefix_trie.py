"""The prefix trie of conversations, its subtree totals by time-forward processing.

Nodes are known by 128-bit hashes of their turns: the exclusive or of one hash for each (place, role, text), so that
parts of one long conversation can be hashed apart and put together. Conversations are ordered by range, so that
no conversation has to be one task; what a range needs from the ranges before it is one row for each.

Subtree totals: nodes are sorted externally (by Spark) in reverse level order, and each node passes its totals to
its parent through a priority queue that spills sorted runs. That is done within shards of about SHARD_NODES nodes
(a range of conversations and a band of depths). What leaves a shard is summed for each receiving node; the
receivers form a smaller tree, whose parents are the nodes where their shard's roots report to. Its totals come by the
same processing across shard roots, and enter the shards' queues in a last pass. When a tree of receivers does not
shrink to half, its shards are made four times as large; queues spill, so memory stays bounded there too.

Rules for input: turns are ordered by number (null first), then role, then the text's SHA-256; null role and text are
empty; repeated rows are turns of their own; rows without conv_id belong to no conversation and are left out; other
columns are ignored. An empty table has no root.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgspark.llm.common import attach_groups, checkpoint, stored

#: Nodes of one shard, about; also the depths of one band.
SHARD_NODES = 250_000
#: Messages that a queue holds as Python objects; more go to a sorted run on disk.
QUEUE = 100_000
#: Ids of one piece of a node's list of conversations.
PIECE = 5000
# Fixed value: a word of the contract.
WORD = r"[^\x20\x09-\x0D]+"


class SpillingQueue:
    """A priority queue of rows of four integers; beyond `limit` rows they go to sorted runs in the task's scratch file."""

    def __init__(self, limit: int) -> None:
        self.limit, self.heap, self.file, self.runs, self.made = limit, [], None, [], 0

    def push(self, row: tuple[int, int, int, int]) -> None:
        heapq.heappush(self.heap, row)
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            folders = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")  # where Spark's own tasks spill
            self.file = tempfile.TemporaryFile(dir=folders[0] if os.path.isdir(folders[0]) else None)
        start = self.file.seek(0, os.SEEK_END)
        rows = np.array(sorted(self.heap), np.int64)
        self.file.write(rows.tobytes())
        self.heap = []
        run = self._read(start, len(rows))
        self.made += 1
        heapq.heappush(self.runs, (next(run), self.made, run))

    def _read(self, start: int, rows: int, block: int = 1024) -> Iterator[tuple[int, int, int, int]]:
        for at in range(0, rows, block):
            self.file.seek(start + 32 * at)
            data = self.file.read(32 * min(block, rows - at))
            yield from map(tuple, np.frombuffer(data, np.int64).reshape(-1, 4).tolist())

    def pop_to(self, key: tuple[int, int]) -> Iterator[tuple[int, int, int, int]]:
        """Removes and yields all rows whose first two numbers are key or less."""
        while self.heap and self.heap[0][:2] <= key:
            yield heapq.heappop(self.heap)
        while self.runs and self.runs[0][0][:2] <= key:
            row, number, run = self.runs[0]
            yield row
            if (after := next(run, None)) is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (after, number, run))


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text_hash, digest, words): what the trie needs of each turn."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return conversations.where("conv_id is not null").select(
        "conv_id", "turn", role.alias("role"), F.sha2(text.cast("binary"), 256).alias("text_hash"), F.unhex(digest).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )


def _ranges(df: DataFrame, *keys: Column) -> DataFrame:
    """df in sorted ranges; rows equal in all keys are still dealt out evenly, by their place in the input."""
    spread = df.withColumn("__at", F.monotonically_increasing_id())
    return spread.repartitionByRange(*keys, "__at").sortWithinPartitions(*keys, "__at").drop("__at")


def _numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, place, digest, words) with places from 1 in each conversation."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            convs = batch.column("conv_id").to_numpy()
            if not len(convs):
                continue
            new = np.ones(len(convs), bool)
            new[1:] = convs[1:] != convs[:-1]
            new[0] = convs[0] != last
            at = np.arange(len(convs))
            start = np.maximum.accumulate(np.where(new, at, -held))
            place = at - start + 1
            last, held = convs[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(place.astype(np.int64)), pa.array(np.full(len(convs), part, np.int32)), batch.column("digest"), batch.column("words")],
                names=["conv_id", "place", "part", "digest", "words"],
            )

    ranged = _ranges(turns, F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("text_hash"))
    local = stored(ranged.select("conv_id", "digest", "words").mapInArrow(number, "conv_id long, place long, part int, digest binary, words long"))
    counts = local.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Only the first conversation of a range can go on from the range before: at most one row for each range.
    carried = checkpoint(counts.withColumn("before", before).where("before > 0").select("conv_id", "part", "before"))
    rows = local.join(F.broadcast(carried), ["conv_id", "part"], "left")
    return rows.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "digest", "words")


def rebuilt(conversations: DataFrame, block: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(convs, turns) of the rebuilt conversations: convs (conv_id, length) and turns (conv_id, depth, digest, words).

    Conversation c begins with the first h = crc32(c) % heads turns of conversation c - c % block and goes on
    with its own turns after its first h.
    """
    own = stored(_numbered(_turns(conversations)))
    start = own.where((F.col("conv_id") % block == 0) & (F.col("place") < heads)).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "digest", "words"))).alias("head")
    )
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % block})
    convs = convs.join(start.withColumnRenamed("conv_id", "base"), "base", "left")
    head = F.when(F.col("head").isNull(), F.array().cast("array<struct<place:bigint,digest:binary,words:bigint>>")).otherwise(F.slice("head", F.lit(1), F.col("h").cast("int")))
    convs = convs.withColumn("head", head).withColumn("shift", F.size("head") - F.col("h"))
    convs = stored(convs.withColumn("length", (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long")))
    first = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.place").alias("depth"), "t.digest", "t.words")
    rest = attach_groups(own, convs.select("conv_id", "h", "shift", "n"), "conv_id", "n").where("place > h")
    rest = rest.select("conv_id", (F.col("place") + F.col("shift")).cast("long").alias("depth"), "digest", "words")
    return convs.select("conv_id", "length"), first.unionByName(rest)


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, words, key, up): the hashes of each turn's prefix and of the prefix before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, state = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            keys = []
            for conv, depth, digest in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "digest"))):
                if conv != last:
                    last, state = conv, 0
                before = state
                state ^= int.from_bytes(hashlib.sha256(depth.to_bytes(8, "big") + digest).digest()[:16], "big")
                keys.append((before >> 64, before & (1 << 64) - 1, state >> 64, state & (1 << 64) - 1))
            made = np.array(keys, np.uint64).reshape(-1, 4).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("depth"), pa.array(np.full(len(made), part, np.int32)), batch.column("words"), *[pa.array(made[:, i].copy()) for i in range(4)]],
                names=["conv_id", "depth", "part", "words", "u1", "u2", "k1", "k2"],
            )

    ranged = _ranges(turns, F.col("conv_id"), F.col("depth"))
    local = stored(ranged.mapInArrow(run, "conv_id long, depth long, part int, words long, u1 long, u2 long, k1 long, k2 long"))
    ends = local.groupBy("conv_id", "part").agg(F.max_by(F.struct("k1", "k2"), "depth").alias("k"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("conv_id", "part", F.bit_xor("k.k1").over(before).alias("c1"), F.bit_xor("k.k2").over(before).alias("c2"), F.sum("n").over(before).alias("n"))
    carried = checkpoint(ends.where("n > 0").drop("n"))  # at most one row for each range
    rows = local.join(F.broadcast(carried), ["conv_id", "part"], "left")
    whole = {k: F.col(k).bitwiseXOR(F.coalesce(c, F.lit(0))) for k, c in (("k1", "c1"), ("k2", "c2"), ("u1", "c1"), ("u2", "c2"))}
    return rows.select("conv_id", "depth", "words", F.struct(whole["k1"].alias("k1"), whole["k2"].alias("k2")).alias("key"), F.struct(whole["u1"].alias("k1"), whole["u2"].alias("k2")).alias("up"))


def id_digests(members: DataFrame) -> DataFrame:
    """(key, ends_sha256): of the ascending ids (key, conv_id) of each key, joined by commas.

    Ranges of (key, conv_id) make pieces of PIECE ids; a key's pieces are hashed in order as they are read.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, out = None, [], []

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["k1", "k2", "first", "ids"])

        for batch in batches:
            for k1, k2, conv in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "conv_id"))):
                if ids and (key != (k1, k2) or len(ids) == PIECE):
                    out.append((*key, ids[0], ",".join(map(str, ids))))
                    ids = []
                key = (k1, k2)
                ids.append(conv)
            if out:
                yield batch_of(out)
                out = []
        if ids:
            yield batch_of([(*key, ids[0], ",".join(map(str, ids)))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids"))):
                if key != (k1, k2):
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    state.update(("," + ids).encode())
            yield from rows(out)
        if key:
            yield from rows([(*key, state.hexdigest())])

    def rows(out: list) -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out]) for i in range(3)], names=["k1", "k2", "ends_sha256"])

    flat = members.select("key.k1", "key.k2", "conv_id").repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    pieces = flat.mapInArrow(cut, "k1 long, k2 long, first long, ids string")
    whole = pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(hashed, "k1 long, k2 long, ends_sha256 string")
    return whole.select(F.struct("k1", "k2").alias("key"), "ends_sha256")


def nodes_of(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, children, words, ends_sha256) of each node, the root included."""
    prefixes = stored(_prefixes(turns))
    found = prefixes.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("up").alias("up"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    zero = F.struct(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("key"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("struct<k1:bigint,k2:bigint>").alias("up"), "n_convs", F.lit(0).cast("long").alias("words"))
    found = stored(found.unionByName(root))
    children = found.where("up is not null").groupBy("up").agg(F.count("*").alias("children"))
    parents = checkpoint(children.join(found.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id")), "up"))
    below = attach_groups(found.where("up is not null"), parents, "up", "children").drop("children")
    linked = below.unionByName(found.where("up is null").withColumn("parent_conv_id", F.lit(None).cast("long")))
    linked = linked.join(parents.select(F.col("up").alias("key"), "children"), "key", "left")
    last = attach_groups(prefixes.select("conv_id", "depth", "key"), convs.where("length > 0").withColumnRenamed("length", "depth_of"), "conv_id", "depth_of").where("depth = depth_of")
    ends = last.select("key", "conv_id").unionByName(convs.where("length = 0").select(zero.alias("key"), "conv_id"))
    linked = linked.join(id_digests(ends), "key", "left")
    return linked.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("children", F.lit(0)).cast("long").alias("children"), "words",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def _placed(nodes: DataFrame, bounds: list[int], band: int) -> DataFrame:
    """nodes with the shard (bucket, band) of each node and of its parent."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(bounds, np.int64)
        for batch in batches:
            told = []
            for conv, depth in (("conv_id", "depth"), ("up_conv", "up_depth")):
                ids = batch.column(conv).fill_null(0).to_numpy(zero_copy_only=False)
                told.append(pa.array(np.searchsorted(edges, ids, side="right").astype(np.int64)))
                told.append(pa.array(batch.column(depth).fill_null(-1).to_numpy(zero_copy_only=False) // band))
            yield pa.RecordBatch.from_arrays([*batch.columns, *told], names=[*batch.schema.names, "bucket", "band", "up_bucket", "up_band"])

    columns = "conv_id long, depth long, up_conv long, up_depth long, leaves long, saved long"
    return nodes.select(*[c.split()[0] for c in columns.split(", ")]).mapInArrow(place, f"{columns}, bucket long, band long, up_bucket long, up_band long")


STREAM = ["bucket", "band", "conv_id", "depth", "outside", "up_conv", "up_depth", "up_bucket", "up_band", "leaves", "saved"]


def _columns(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in names))


def _long_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names=names)


def _up_the_levels(placed: DataFrame, arrived: DataFrame | None, totals: bool) -> DataFrame:
    """One pass in reverse level order over every shard.

    arrived (conv_id, depth, leaves, saved, bucket, band) are totals from other shards. Gives the nodes' totals, or
    else what leaves the shards: (conv_id, depth, leaves, saved) for the receiving nodes.
    """
    names = ["conv_id", "depth", "leaves", "saved"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, queue, more = None, SpillingQueue(QUEUE), (0, 0)
        for batch in batches:
            out = []
            for bucket, band, conv, depth, outside, up_conv, up_depth, up_bucket, up_band, leaves, saved in _columns(batch, STREAM):
                if shard != (bucket, band):
                    shard, queue = (bucket, band), SpillingQueue(QUEUE)
                if outside:
                    more = (leaves, saved)
                    continue
                leaves, saved, more = leaves + more[0], saved + more[1], (0, 0)
                for _, _, below, spared in queue.pop_to((-depth, conv)):
                    leaves, saved = leaves + below, saved + spared
                if up_conv is not None and (up_bucket, up_band) == shard:
                    queue.push((-up_depth, up_conv, leaves, saved))
                elif up_conv is not None and not totals:
                    out.append((up_conv, up_depth, leaves, saved))
                if totals:
                    out.append((conv, depth, leaves, saved))
            if out:
                yield _long_batch(out, names)

    rows = placed.withColumn("outside", F.lit(False))
    if arrived is not None:
        rows = rows.unionByName(arrived.withColumn("outside", F.lit(True)), allowMissingColumns=True)
    order = ["bucket", "band", F.desc("depth"), "conv_id", F.desc("outside")]
    sorted_rows = rows.select(*STREAM).repartition("bucket", "band").sortWithinPartitions(*order)
    return sorted_rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _exits(placed: DataFrame, ports: DataFrame) -> DataFrame:
    """ports with up_conv and up_depth: where the root of their shard above them reports to.

    One pass in level order. All nodes of one conversation in one shard have the same exit, so the tops of
    its runs are enough.
    """
    names = ["conv_id", "depth", "up_conv", "up_depth", "leaves", "saved"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, exits = None, {}
        for batch in batches:
            out = []
            for bucket, band, conv, depth, outside, up_conv, up_depth, up_bucket, up_band, leaves, saved in _columns(batch, STREAM):
                if shard != (bucket, band):
                    shard, exits = (bucket, band), {}
                if outside:
                    out.append((conv, depth, *exits[conv], leaves, saved))
                elif up_conv is not None and (up_bucket, up_band) == shard:
                    exits[conv] = exits[up_conv]
                else:
                    exits[conv] = (up_conv, up_depth)
            if out:
                yield _long_batch(out, names)

    inside = "up_conv <=> conv_id and up_bucket = bucket and up_band = band"
    rows = placed.where(f"not ({inside})").withColumn("outside", F.lit(False)).unionByName(ports.withColumn("outside", F.lit(True)), allowMissingColumns=True)
    sorted_rows = rows.select(*STREAM).repartition("bucket", "band").sortWithinPartitions("bucket", "band", "depth", "conv_id", "outside")
    return sorted_rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def subtree_totals(nodes: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """(conv_id, depth, leaves, saved): sums over the subtrees of nodes (conv_id, depth, up_conv, up_depth, leaves, saved).

    A node is known by conv_id and depth. Its parent is less deep, and nodes of one conv_id lie on one path.
    """
    nodes = stored(nodes)
    total = nodes.count()
    shards = -(-total // shard_nodes)
    if shards <= 1:
        return _up_the_levels(_placed(nodes, [], 1 << 62), None, True)
    steps = ", ".join(str(i / shards) for i in range(1, shards))
    bounds = nodes.agg(F.expr(f"percentile_approx(conv_id, array({steps}), {max(10_000, 10 * shards)})")).first()[0]
    placed = stored(_placed(nodes, sorted(set(bounds)), shard_nodes))
    left = _up_the_levels(placed, None, False).groupBy("conv_id", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    empty = {"up_conv": F.lit(None).cast("long"), "up_depth": F.lit(None).cast("long")}
    ports = stored(_placed(left.withColumns(empty), sorted(set(bounds)), shard_nodes).drop("up_conv", "up_depth", "up_bucket", "up_band"))
    up = stored(_exits(placed, ports))
    arrived = subtree_totals(up, shard_nodes if 2 * up.count() <= total else 4 * shard_nodes)
    arrived = _placed(arrived.withColumns(empty), sorted(set(bounds)), shard_nodes).drop("up_conv", "up_depth", "up_bucket", "up_band")
    return _up_the_levels(placed, arrived, True)


def trie(conversations: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """One row for each node of the prefix trie of the rebuilt conversations (conv_id, turn, role, text)."""
    nodes = stored(nodes_of(*rebuilt(conversations)))
    own = nodes.select(
        "conv_id", "depth", F.col("parent_conv_id").alias("up_conv"), F.when(F.col("parent_conv_id").isNotNull(), F.col("depth") - 1).alias("up_depth"),
        (F.col("children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    totals = subtree_totals(own, shard_nodes).select("conv_id", "depth", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    return nodes.join(totals, ["conv_id", "depth"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), "n_leaves", "saved_tokens", "ends_sha256"
    )
