"""Work on texts in Python, a few of them at a time.

A task may read batches of many long texts; what Python makes of a batch (lists, words, offsets) is several
times larger than the batch. So batches are cut into pieces of bounded size, and rows that belong to a text
come behind it in sorted order instead of as one array beside it.

Before a shuffle, rows of one key that lie together are packed into one row with a compressed block (``packed``): a
token is a few bytes then, and not a row of its own that is sent and sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DataType, StructField, StructType

PIECE = 1 << 20  # bytes of text that are worked on at once; a longer text is a piece of its own
PACKED = 16  # rows of a key that are worth a block
ROWS = 10_000  # rows that are unpacked at once


def pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges (start, length) of the texts (or binaries) that hold at most PIECE bytes or one text."""
    start = held = 0
    for i, size in enumerate(pc.binary_length(texts).to_pylist()):
        if i > start and held + (size or 0) > PIECE:
            yield start, i - start
            start, held = i, 0
        held += size or 0
    if start < len(texts):
        yield start, len(texts) - start


def in_pieces(work: Callable[[pa.RecordBatch], pa.RecordBatch], column: str = "text"):
    """A function for ``mapInArrow`` that does ``work`` on pieces of the batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in pieces(batch.column(column)):
                yield work(batch.slice(start, n))

    return run


def runs_of(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Where runs of rows with equal values (null is a value) begin, and the number of rows."""
    new = np.zeros(batch.num_rows + 1, dtype=bool)
    new[[0, -1]] = True
    for name in names:
        codes = pc.fill_null(batch.column(name).dictionary_encode().indices, -1).to_numpy()
        new[1:-1] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def whole_runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that cut no run of equal values; only the last run of a batch is held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1].column(n)[-1].as_py() != batch.column(n)[0].as_py() for n in names):
            yield pa.concat_batches(held)
            held = []
        last = int(runs_of(batch, names)[-2])
        if last:
            yield pa.concat_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.concat_batches(held)


def _in_order(batch: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    """Sorted as Spark sorts, nulls first."""
    options = pc.SortOptions([(n, "ascending") for n in names], null_placement="at_start")
    return batch.take(pc.sort_indices(batch.select(names), options=options))


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same integers in as few bytes each as all of them fit in."""
    low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    return values.astype(next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _encoded(batch: pa.RecordBatch, runs: list[tuple[int, int]]) -> Iterator[bytes]:
    """Each run of rows as a compressed block: differences of integers, lengths and bytes of texts, other columns in Arrow's format."""
    parts = []
    others = [f.name for f in batch.schema if not (pa.types.is_integer(f.type) or pa.types.is_string(f.type))]
    for name in (n for n in batch.schema.names if n not in others):
        column = batch.column(name)
        valid = None if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
        if pa.types.is_integer(column.type):
            values = pc.fill_null(column, 0).cast(pa.int64(), safe=False).to_numpy()
            steps = np.diff(values, prepend=values[:1])
            steps[[a for a, _ in runs]] = 0
            parts.append((valid, _narrow(steps), values, None))
        else:
            column = pc.fill_null(column, "")
            offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1]
            parts.append((valid, _narrow(np.diff(offsets)), offsets, column.buffers()[2] or pa.py_buffer(b"")))
    codec = pa.Codec("zstd", compression_level=3)
    for start, end in runs:
        out = []
        for valid, small, values, data in parts:
            there = 0 if valid is None or valid[start:end].all() else 1 if valid[start:end].any() else 2
            out.append(bytes((there, small.dtype.itemsize)))
            if there == 1:
                out.append(np.packbits(valid[start:end], bitorder="little").tobytes())
            if there < 2:
                out.append(small[start:end].tobytes())
                first, last = int(values[start]), int(values[end]) if data is not None else 0
                out.append((first if data is None else last - first).to_bytes(8, "little", signed=True))
                if data is not None:
                    out.append(data.slice(first, last - first).to_pybytes())
        if others:
            out.append(batch.select(others).slice(start, end - start).serialize().to_pybytes())
        raw = b"".join(out)
        yield (end - start).to_bytes(4, "little") + len(raw).to_bytes(4, "little") + codec.compress(raw, asbytes=True)


def _decoded(block: pa.Buffer, schema: pa.Schema, codec: pa.Codec) -> pa.RecordBatch:
    """The rows of a block, all columns of the schema."""
    head = block[:8].to_pybytes()
    n, size = int.from_bytes(head[:4], "little"), int.from_bytes(head[4:], "little")
    raw = codec.decompress(block[8:], size)
    mem, at, made, others = memoryview(raw), 0, {}, []
    for f in schema:
        whole = pa.types.is_integer(f.type)
        if not whole and not pa.types.is_string(f.type):
            others.append(f)
            continue
        there, width = mem[at], mem[at + 1]
        at += 2
        if there == 2:
            made[f.name] = pa.nulls(n, f.type)
            continue
        bits = None
        if there:
            bits, at = raw.slice(at, (n + 7) // 8), at + (n + 7) // 8
        small, at = np.frombuffer(mem[at:at + n * width], dtype=f"<i{width}"), at + n * width
        first, at = int.from_bytes(mem[at:at + 8], "little", signed=True), at + 8
        if whole:
            values = (np.cumsum(small, dtype=np.int64) + first).astype(f.type.to_pandas_dtype())
            made[f.name] = pa.Array.from_buffers(f.type, n, [bits, pa.py_buffer(values)])
        else:
            offsets = np.zeros(n + 1, dtype=np.int32)
            np.cumsum(small, out=offsets[1:])
            made[f.name] = pa.Array.from_buffers(f.type, n, [bits, pa.py_buffer(offsets), raw.slice(at, first)])
            at += first
    if others:
        rest = pa.ipc.read_record_batch(raw.slice(at), pa.schema(others))
        made |= {f.name: rest.column(f.name) for f in others}
    return pa.RecordBatch.from_arrays([made[f.name] for f in schema], schema=schema)


def packed(rows: DataFrame, keys: list[str], order: list[str], inside: list[str]) -> DataFrame:
    """The same rows, of which those of a key that lie together are one row with a ``_block`` of all but the keys.

    A packed row holds its keys and the first values of ``order``; blocks are in that order. Columns named ``inside`` are only
    in blocks: what is not packed, as few rows of its key lie together, has to get them again.
    """
    sent = [f for f in rows.schema.fields if f.name not in inside]
    out = StructType([*(StructField(f.name, f.dataType) for f in sent), StructField("_block", BinaryType())])
    names = [f.name for f in sent]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if order:
                batch = _in_order(batch, [*keys, *order])
            edges = runs_of(batch, keys)
            sizes = np.diff(edges)
            many = sizes >= PACKED
            runs = list(zip(edges[:-1][many].tolist(), edges[1:][many].tolist()))
            blocks = list(_encoded(batch.drop_columns(keys), runs)) if runs else []
            alone = batch.select(names).filter(pa.array(np.repeat(~many, sizes)))
            if alone.num_rows:
                yield pa.record_batch({**dict(zip(names, alone.columns)), "_block": pa.nulls(alone.num_rows, pa.binary())})
            if blocks:
                first = batch.select(names).take(pa.array(edges[:-1][many]))
                kept = {n: c if n in keys or n in order else pa.nulls(len(blocks), c.type) for n, c in zip(names, first.columns)}
                yield pa.record_batch({**kept, "_block": pa.array(blocks, type=pa.binary())})

    return rows.mapInArrow(run, out)


def unpacked(batches: Iterator[pa.RecordBatch], keys: list[str], order: list[str], content: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows as they were before they were packed, of input sorted by keys and order, in that order.

    ``content`` names the columns of blocks as they were written. Blocks of a key that overlap in the order are sorted together.
    """
    place = lambda batch, i: tuple((v is not None, v) for v in (batch.column(n)[i].as_py() for n in order))
    ready: list[pa.RecordBatch] = []  # in order
    held: list[pa.RecordBatch] = []  # of one key, the next may lie between them
    key = last = None

    def settle() -> None:
        nonlocal held
        ready.extend(held if len(held) < 2 else [_in_order(pa.concat_batches(held), order)])
        held = []

    def full() -> bool:
        return sum(b.num_rows for b in ready) >= ROWS

    codec = pa.Codec("zstd")
    for batch in batches:
        names = [n for n in batch.schema.names if n != "_block"]
        schema = pa.schema([batch.schema.field(n) for n in names])
        written = pa.schema([batch.schema.field(n) for n in content])
        is_block = batch.column("_block").is_valid().to_numpy(zero_copy_only=False)
        edges = runs_of(batch, keys)
        if is_block.any():
            edges = np.unique(np.concatenate([edges, np.flatnonzero(is_block), np.flatnonzero(is_block) + 1]))
        flat = batch.select(names)
        columns = [batch.column(n) for n in keys]
        if not order and not is_block.any():
            edges = edges[[0, -1]]
        for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
            piece = flat.slice(start, end - start)
            if is_block[start]:
                rows = _decoded(batch.column("_block")[start].as_buffer(), written, codec)
                n = rows.num_rows
                made = {name: pa.nulls(n, schema.field(name).type) for name in names if name not in content}
                made |= {name: pa.repeat(c[start], n) for name, c in zip(keys, columns)}
                made |= dict(zip(content, rows.columns))
                piece = pa.RecordBatch.from_arrays([made[name] for name in names], schema=schema)
            if order:
                now = tuple(c[start].as_py() for c in columns)
                if held and (now != key or place(piece, 0) > last):
                    settle()
                    last = None
                key, late = now, place(piece, piece.num_rows - 1)
                last = late if not held else max(last, late)
                held.append(piece)
            else:
                ready.append(piece)
            if full():
                yield pa.concat_batches(ready)
                ready = []
    settle()
    if ready:
        yield pa.concat_batches(ready)


def beside(
    asked: DataFrame, texts: DataFrame, keys: list[str], order: list[str], late: dict[str, Column], work, added: dict[str, DataType]
) -> DataFrame:
    """Rows that belong to texts, worked on in one pass over both; gives them with the ``added`` columns.

    ``texts(keys, body)``; the rows of one key come in the given order behind the texts of that key.
    ``work(bodies, args, state)`` gets them by parts that cut no rows of equal order: ``bodies`` are the pairs (body,
    lower-case body) of the key (several if the key repeats, none if it is null), ``args`` the values of the ``late`` columns
    row by row, ``state`` a dictionary that lasts as long as the key does. It returns numbers of these rows,
    in any order and number, and for each the added values or null.
    """
    held = texts.select(*keys, F.col("body").alias("_body")).where("_body IS NOT NULL")
    names, given, nothing = asked.columns, list(late), (None,) * len(added)
    blocks = packed(asked.withColumns(late), keys, order, given)
    both = held.withColumn("_row", F.lit(False)).unionByName(blocks.withColumn("_row", F.lit(True)), allowMissingColumns=True)
    # By a hash of its own: both sides may be dealt by the keys already, into partitions that are not the same.
    rows = both.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, "_row", *order).withColumns({**late, "_low": F.lower("_body")})
    content = [n for n in (*names, *given) if n not in keys]
    out = StructType([*asked.schema.fields, *(StructField(n, t) for n, t in added.items())])
    kinds = to_arrow_schema(StructType([StructField(n, t) for n, t in added.items()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, bodies, state = None, [], {}
        flat = unpacked(batches, [*keys, "_row"], order, content)
        for batch in whole_runs(flat, [*keys, "_row", *order]) if order else flat:
            column = lambda name: batch.column(name).to_pylist()
            found, is_row, args = list(zip(*map(column, keys))), column("_row"), list(zip(*map(column, given)))
            at, values = [], []
            i, n = 0, batch.num_rows
            while i < n:
                if found[i] != key:
                    key, bodies, state = found[i], [], {}
                if not is_row[i]:
                    if None not in key:
                        bodies.append((batch.column("_body")[i].as_py(), batch.column("_low")[i].as_py()))
                    i += 1
                    continue
                end = i + 1
                while end < n and is_row[end] and found[end] == key:
                    end += 1
                numbers, some = work(bodies, args[i:end], state)
                at += [i + x for x in numbers]
                values += some
                i = end
            if at:
                made = zip(*[nothing if v is None else v for v in values])
                new = {f.name: pa.array(v, type=f.type) for f, v in zip(kinds, made)}
                kept = batch.select(names).take(pa.array(at, type=pa.int32()))
                yield pa.record_batch({**dict(zip(names, kept.columns)), **new})

    return rows.select(*names, "_row", *given, "_body", "_low", "_block").mapInArrow(run, out)


def by_body(places: list[list], n: int) -> tuple[list[int], list]:
    """What an outer join with the bodies of a key would give, from what each body gave each of n rows (null: nothing).

    Numbers of rows and what was found for them; a row that no body gave anything is there once, with null.
    """
    if len(places) <= 1:
        return list(range(n)), places[0] if places else [None] * n
    hits = [[p[i] for p in places if p[i] is not None] or [None] for i in range(n)]
    return [i for i in range(n) for _ in hits[i]], [x for found in hits for x in found]
