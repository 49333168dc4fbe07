"""Exact Jaccard join of word n-gram sets.

Method: distinct sets meet in tiles (a prefix shingle, then size bands inside it). Hashed bitmap signatures bound
the overlap of two sets of a tile from above by their bit counts; pairs that the bound leaves are decided by
intersecting the sorted sets. Two rounds keep large groups of near copies linear: first every set of a tile is
held against the tile's most central sets, and those links give components; then only pairs that are still in
different components are bounded and decided. No link between components is lost: prefixes are so long that two
sets that link share at least _needed() of their shingles there, so sets that share fewer with all others together
leave before any tile is worked on, and pairs inside a component cannot change it.

Shingles and sets are known by 64-bit hashes. Rules for input: null text is empty; a text without words has an
empty set and links with nothing; rows with equal sets are one node, whatever their ids; every input row gives
one output row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import attach_groups, checkpoint, portions, small_batches, stored
from kgspark.llm.components import components

WORDS = 5
#: Links need NUMERATOR * union <= DENOMINATOR * intersection.
NUMERATOR, DENOMINATOR = 4, 5
#: Bytes of text that are hashed at once; bounds the memory of a task, not the text.
SLICE = 1 << 18
#: Shingles counted together when frequent ones are looked for, and the share of sets that makes one frequent.
COUNTED, FREQUENT_SHARE = 1 << 20, 0.001
#: A prefix is longer than one shared shingle asks for by this part of the set.
EXTRA = 12
#: Sets held against one copy of their centre when pairs are decided.
MEMBERS = 4096
#: Bits of the map that keeps most other texts from being sent when a few are picked (1 MB).
PICK_BITS = 1 << 23
#: Centres of a tile in the first round.
CENTRES = 3
#: Bytes of signatures that are compared at once.
PORTION = 4 << 20
#: Pairs of sets that are compared at once; pairs that a task remembers to send once; tile rows of one cluster to a task.
COMPARED, REMEMBERED, CLUSTER_ROWS = 1 << 18, 400_000, 50_000
#: Sets of one side of a tile that are compared at once.
BLOCK = 1024
#: Bits of a signature for every element of a set, as a power of two around it.
BITS_PER_ELEMENT = 4
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class Shingler:
    """Sets of hashed n-word shingles of the rows of an Arrow text column."""

    def __init__(self) -> None:
        self.code = _mix(np.arange(1, 257, dtype=U))
        self.code[ord("A") : ord("Z") + 1] = self.code[ord("a") : ord("z") + 1]
        self.space = np.zeros(256, dtype=bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        base = 0x9E3779B97F4A7C15
        self.power = np.cumprod(np.concatenate(([U(1)], np.full(SLICE * 2, U(base)))), dtype=U)
        self.inverse = np.cumprod(np.concatenate(([U(1)], np.full(SLICE * 2, U(pow(base, -1, 1 << 64))))), dtype=U)
        self.weight = _mix(np.arange(1001, 1001 + WORDS, dtype=U)) | U(1)

    def _words(self, raw: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and start positions of the words of raw; first marks bytes where a new text begins."""
        if not len(raw):
            return np.empty(0, U), np.empty(0, np.int64)
        if len(raw) > 2 * SLICE:  # one word that is longer than two slices
            halves = [raw[i : i + SLICE] for i in range(0, len(raw), SLICE)]
            parts = [int((self.code[h] * self.power[: len(h)]).sum(dtype=U)) for h in halves]
            total = sum(p * pow(0x9E3779B97F4A7C15, SLICE * i, 1 << 64) for i, p in enumerate(parts)) % (1 << 64)
            return _mix(np.array([total], U) + U(len(raw))), np.zeros(1, np.int64)
        solid = ~self.space[raw]
        before = np.empty_like(solid)
        before[0], before[1:] = False, solid[:-1]
        starts = np.flatnonzero(solid & (~before | first))
        after = np.empty_like(solid)
        after[-1], after[:-1] = True, ~solid[1:] | first[1:]
        ends = np.flatnonzero(solid & after) + 1
        sums = np.zeros(len(raw) + 1, U)
        np.cumsum(self.code[raw] * self.power[: len(raw)], dtype=U, out=sums[1:])
        return _mix((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(U)), starts

    def _cuts(self, raw: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
        """Slices that end between two words: at most SLICE bytes of whole words and white space, or one longer word."""
        at = 0
        while at < len(raw):
            end = min(at + SLICE, len(raw))
            if end < len(raw):
                free = np.flatnonzero(self.space[raw[at : end + 1]] | first[at : end + 1])
                if len(free) and free[-1]:
                    end = at + int(free[-1])
                elif len(free) and self.space[raw[at]]:
                    end = at + 1
                else:
                    while end < len(raw):
                        step = min(end + SLICE, len(raw))
                        free = np.flatnonzero(self.space[raw[end:step]] | first[end:step])
                        if len(free):
                            end += int(free[0])
                            break
                        end = step
            yield at, end
            at = end

    def sets(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The sorted set of every row, in order."""
        column = column.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        row = 0
        while row < len(column):
            last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
            lo, hi = int(offsets[row]), int(offsets[last])
            first = np.zeros(hi - lo, dtype=bool)
            begins = offsets[row:last] - lo
            first[begins[begins < hi - lo]] = True
            words, places = [np.empty(0, U)], [np.empty(0, np.int64)]
            for a, b in self._cuts(raw[lo:hi], first):
                w, p = self._words(raw[lo + a : lo + b], first[a:b])
                words.append(w)
                places.append(p + a)
            yield from self._shingles(np.concatenate(words), np.concatenate(places), begins, hi - lo)
            row = last

    def _shingles(self, words: np.ndarray, places: np.ndarray, begins: np.ndarray, size: int) -> Iterator[np.ndarray]:
        n = max(0, len(words) - WORDS + 1)
        rolled = np.zeros(n, U)
        for k in range(WORDS):
            rolled += words[k : k + n] * self.weight[k]
        rolled = _mix(rolled)
        bounds = np.searchsorted(places, np.append(begins, size))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= WORDS:
                yield np.unique(rolled[a : b - WORDS + 1])
            elif b > a:
                yield _mix((words[a:b] * self.weight[: b - a]).sum(dtype=U, keepdims=True) + U(b - a))
            else:
                yield np.empty(0, U)


def _node(found: np.ndarray) -> int:
    """A 64-bit name of a set."""
    with np.errstate(over="ignore"):
        mixed = _mix(_mix(found) + U(len(found)))
        return int(_mix(mixed.sum(dtype=U, keepdims=True) + _mix(np.bitwise_xor.reduce(mixed, keepdims=True)))[0].astype(np.int64))


def _least(n: int) -> int:
    """The smallest intersection with which a set of n elements can link."""
    return -(-n * NUMERATOR // DENOMINATOR)


def _needed(n: int) -> int:
    """Prefix shingles that a set of n elements shares with every set it links with.

    Prefixes of a - least + k and b - least + k elements of two sets that link share k; the smaller of two that link
    has at least _least(n) elements, and k follows from the smaller set.
    """
    return 1 + _least(n) // EXTRA


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind 0: id, set size, node, mark) of every text, and (kind 1: shingle, its sets here) of frequent shingles."""
    shingler, held, sets, waiting = Shingler(), [], 0, 0

    def frequent() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held or [np.empty(0, U)]), return_counts=True)
        often = counts >= max(3, sets * FREQUENT_SHARE)
        return _rows(1, values[often].astype(np.int64), counts[often], *np.zeros((2, often.sum()), np.int64))

    def _rows(kind: int, *columns) -> pa.RecordBatch:
        arrays = [pa.array(c, pa.int64()) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(arrays[0]), kind, np.int32)), *arrays], ["kind", "a", "n", "node", "mark"])

    for batch in portions(batches, "text"):
        sizes, nodes = [], []
        for found in shingler.sets(batch.column("text")):
            sizes.append(len(found))
            nodes.append(_node(found) if len(found) else None)
            held.append(found)
            sets += 1
            waiting += len(found)
            if waiting >= COUNTED:
                yield frequent()
                held, sets, waiting = [], 0, 0
        yield _rows(0, batch.column("doc_id").cast(pa.int64()), sizes, nodes, batch.column("mark"))
    yield frequent()


def _prefixes(often: np.ndarray):
    """Maps texts to (shingle, node, n) for the prefix of each set: frequent shingles last, else by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(), set()
        for batch in portions(batches, "text"):
            keys, nodes, sizes = [np.empty(0, U)], [], []
            for found in shingler.sets(batch.column("text")):
                n = len(found)
                if not n or (node := _node(found)) in seen:
                    continue  # an equal set of this task has been sent
                if len(seen) >= 1 << 20:
                    seen.clear()
                seen.add(node)
                late = often[np.minimum(np.searchsorted(often, found), len(often) - 1)] == found if len(often) else np.zeros(n, bool)
                kept = np.concatenate((found[~late], found[late]))[: n - _least(n) + 1 + n // EXTRA]
                keys.append(kept)
                nodes.append((node, len(kept)))
                sizes.append(n)
            repeats = [k for _, k in nodes]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(keys).astype(np.int64)),
                    pa.array(np.repeat(np.array([x for x, _ in nodes], np.int64), repeats)),
                    pa.array(np.repeat(np.array(sizes, np.int32), repeats)),
                ],
                ["shingle", "node", "n"],
            )

    return run


TILE_ROWS = "shingle long, part int, stored boolean, node long, n int, met int"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of (shingle, n, node): the tiles of shingles that more than one set has.

    A shingle's sets are cut in that order into parts of at most BLOCK sets. A set comes back once as stored in its
    own part (met: the sets of the part), and once more for every earlier part that holds sets large enough to link
    with it. Between batches one part is held, and (part, largest size) of each part within reach.
    """
    now, held, part, reach, out = None, [], 0, [], []

    def flush() -> None:
        if part or len(held) > 1:
            out.extend((now, part, True, x, m, len(held)) for x, m in held)

    def told() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 6
        kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int32()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["shingle", "part", "stored", "node", "n", "met"])

    for batch in batches:
        key, node, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(key):
            continue
        same = np.append(now is not None and now == key[0], key[1:] == key[:-1])
        for i in np.flatnonzero(same | np.append(same[1:], True)).tolist():
            x, m = int(node[i]), int(n[i])
            if not same[i]:
                flush()
                now, held, part, reach = int(key[i]), [(x, m)], 0, []
                continue
            if x == held[-1][0]:
                continue  # the same set from another task
            if len(held) == BLOCK:
                flush()
                reach, held, part = [*reach, (part, held[-1][1])], [], part + 1
            reach = [p for p in reach if p[1] >= _least(m)]
            out.extend((now, p, False, x, m, 0) for p, _ in reach)
            held.append((x, m))
        if not same[-1] and now != key[-1]:
            flush()
            now, held, part, reach = int(key[-1]), [(int(node[-1]), int(n[-1]))], 0, []
        yield told()
    flush()
    yield told()


def signature(found: np.ndarray) -> np.ndarray:
    """A bitmap with one bit set for the low hash bits of each element; its width is a power of two."""
    width = 1 << max(6, (BITS_PER_ELEMENT * len(found) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(found & U(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little")


def _folded(bitmaps: np.ndarray, size: int) -> np.ndarray:
    """Rows of bitmaps of the same sets at a smaller width."""
    while (width := bitmaps.shape[1]) > size:
        bitmaps = bitmaps[:, : width // 2] | bitmaps[:, width // 2 :]
    return bitmaps


def _links(left: np.ndarray, right: np.ndarray) -> bool:
    """The exact decision on two sorted sets."""
    small, large = (left, right) if len(left) <= len(right) else (right, left)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return common * DENOMINATOR >= (len(left) + len(right) - common) * NUMERATOR


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, node, n, signature) of texts."""
    shingler = Shingler()
    for batch in portions(batches, "text"):
        found = list(shingler.sets(batch.column("text")))
        nodes = pa.array([_node(x) if len(x) else None for x in found], pa.int64())
        bits = pa.array([signature(x).tobytes() if len(x) else None for x in found], pa.binary())
        sizes = pa.array([len(x) for x in found], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), nodes, sizes, bits], ["doc_id", "node", "n", "signature"])


def _may_link(bits: list[pa.Array], sizes: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether the sets at rows left of the first and right of the second side may link by their bit counts.

    Bits that differ are at most the elements that differ: common <= (total - differ) / 2, union = total - common.
    """
    total = sizes[0][left] + sizes[1][right]
    differ = np.empty(len(left), np.int64)
    widths, packed, raw = [], [], []
    for side in bits:
        offsets = np.frombuffer(side.buffers()[1], np.int32)[side.offset : side.offset + len(side) + 1].astype(np.int64)
        widths.append(np.diff(offsets))
        packed.append(offsets[:-1])
        raw.append(np.frombuffer(side.buffers()[2] or b"", np.uint8))
    a, b = widths[0][left], widths[1][right]
    for x, y in np.unique(np.stack((a, b), axis=1), axis=0).tolist():
        rows = np.flatnonzero((a == x) & (b == y))
        step = max(1, PORTION // max(x, y))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            first = raw[0][packed[0][left[some]][:, None] + np.arange(x)]
            second = raw[1][packed[1][right[some]][:, None] + np.arange(y)]
            size = min(x, y)
            differ[some] = np.bitwise_count(_folded(first, size) ^ _folded(second, size)).sum(axis=1, dtype=np.int64)
    most = (total - differ) // 2
    return most * DENOMINATOR >= (total - most) * NUMERATOR


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both signatures and sizes, those that may link by their bit counts."""
    for batch in batches:
        rows = np.arange(len(batch))
        sizes = [batch.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b")]
        kept = _may_link([batch.column("bits_a"), batch.column("bits_b")], sizes, rows, rows)
        yield batch.select(["a", "b", "first_a", "first_b"]).filter(pa.array(kept, pa.bool_()))


def _picked(texts: DataFrame, ids: DataFrame, then=iter, schema: str = "doc_id long, text string") -> DataFrame:
    """The rows of texts with an id of ids (doc_id), and a few more, mapped by then: an exact join follows and ships little.

    The ids set bits of a map of PICK_BITS bits, whatever their number; a row whose bit is not set is left out.
    """
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(PICK_BITS))
    words = ids.select(place.alias("p")).select(F.expr("p div 64").alias("word"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("bit"))
    held = np.zeros(PICK_BITS // 64, np.int64)
    for row in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        held[row["word"]] = row["bits"]
    held = held.view(U)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("place").to_numpy(zero_copy_only=False)
            kept = (held[p // 64] >> (p % 64).astype(U)) & U(1)
            yield batch.select(["doc_id", "text"]).filter(pa.array(kept.astype(bool)))

    rows = texts.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", place.alias("place"))
    return rows.mapInArrow(lambda batches: then(pick(batches)), schema)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each row replaced by its sorted set; rows of another text with the same id go."""
    shingler = Shingler()
    for batch in portions(batches, "text"):
        found = list(shingler.sets(batch.column("text")))
        asked = [b if a is None else a for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
        right = pa.array([len(x) > 0 and _node(x) == node for x, node in zip(found, asked, strict=True)], pa.bool_())
        rest = ["a", "b", "part"]
        elements = pa.array([x.tobytes() for x in found], pa.binary())
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], elements], [*rest, "elements"]).filter(right)


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of (b, part, a), where the centre's row has no a: the pairs (a, b) that link."""
    centre, held = None, None
    for batch in batches:
        kept = []
        for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
            elements = np.frombuffer(batch.column("elements")[i].as_buffer(), U)
            if a is None:
                centre, held = b, elements.copy()
            elif b == centre and _links(elements, held):
                kept.append(i)
        yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))


def _pairs(left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs, the larger node first where they are not centres."""
    pairs = np.unique(np.stack((left, right), axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches in order of (shingle, part) cut so that no tile is in two, each with the starts of its tiles."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if held is not None and len(held):
            batch = pa.concat_batches([held, batch])
        if not len(batch):
            continue
        shingle, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shingle", "part"))
        starts = np.append(0, np.flatnonzero((shingle[1:] != shingle[:-1]) | (part[1:] != part[:-1])) + 1)
        held = batch.slice(int(starts[-1]))
        if len(starts) > 1:
            yield batch.slice(0, int(starts[-1])), starts[:-1]
    if held is not None and len(held):
        yield held, np.zeros(1, np.int64)


def _centre_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From tiles in order of (shingle, part): pairs of a set and one of its tile's CENTRES sets of the highest score."""
    for batch, starts in _whole_tiles(batches):
        node, n, score = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "score"))
        sizes = np.diff(np.append(starts, len(batch)))
        order = np.lexsort((node, -score, np.repeat(np.arange(len(starts)), sizes)))
        node, n = node[order], n[order].astype(np.int64)
        left, right = [], []
        for c in range(CENTRES):
            centre = np.repeat(np.where(sizes > c, starts + c, starts), sizes)
            fit = (np.minimum(n, n[centre]) * DENOMINATOR >= np.maximum(n, n[centre]) * NUMERATOR) & (node != node[centre])
            left.append(node[fit])
            right.append(node[centre[fit]])
        yield _pairs(np.concatenate(left), np.concatenate(right))


def _open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From whole tiles, rows in order of (shingle, part, n, node): pairs in different components that the bit counts leave.

    A tile's at most BLOCK stored sets are held against all sets of the tile after them. Tiles of the same sets
    come one after another, so a pair is sent once for as long as it is remembered.
    """
    seen: set[tuple[int, int]] = set()
    for batch, starts in _whole_tiles(batches):
        node, n, component, stored_here = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "component", "stored"))
        n, bits = n.astype(np.int64), batch.column("signature")
        names, number = np.unique(node, return_inverse=True)
        tile = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(batch))))
        left, right, waiting, found = [], [], 0, []

        def decide() -> None:
            a, b = np.concatenate(left), np.concatenate(right)
            key = np.minimum(number[a], number[b]) * len(names) + np.maximum(number[a], number[b])
            once = np.unique(key, return_index=True)[1]
            a, b = a[once], b[once]
            kept = _may_link([bits, bits], [n, n], a, b)
            found.extend(zip(np.maximum(node[a], node[b])[kept].tolist(), np.minimum(node[a], node[b])[kept].tolist(), strict=True))
            left.clear()
            right.clear()

        rows, step = np.flatnonzero(stored_here.astype(bool)), 1
        while len(rows):
            rows = rows[rows + step < len(batch)]
            rows = rows[(tile[rows + step] == tile[rows]) & (n[rows] * DENOMINATOR >= n[rows + step] * NUMERATOR)]
            other = rows[(component[rows + step] != component[rows]) & (node[rows + step] != node[rows])]
            left.append(other)
            right.append(other + step)
            waiting += len(other)
            if waiting >= COMPARED:
                decide()
                waiting = 0
            step += 1
        if waiting:
            decide()
        if len(seen) > REMEMBERED:
            seen.clear()
        new = sorted(set(found) - seen)
        seen.update(new)
        pairs = np.array(new, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _decided(pairs: DataFrame, facts: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that link; facts are (node, doc_id, n, signature).

    Only sets of pairs that the bit counts leave are made again from their texts. Each is sent once for every
    pair, to its centre b, of which there is one copy for every MEMBERS pairs.
    """
    left, right = facts.toDF("a", "first_a", "n_a", "bits_a"), facts.toDF("b", "first_b", "n_b", "bits_b")
    near = checkpoint(pairs.join(left, "a").join(right, "b").mapInArrow(_bounded, "a long, b long, first_a long, first_b long"))
    parts = F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts")
    centres = near.groupBy("b").agg(F.min("first_b").alias("doc_id"), parts)
    members = attach_groups(near, near.groupBy("b").agg(parts, F.count("*").alias("size")), "b", "size")
    wanted = members.select(F.col("first_a").alias("doc_id"), "a", "b", F.pmod(F.xxhash64("a"), "parts").cast("int").alias("part")).unionByName(
        centres.select("doc_id", F.lit(None).cast("long").alias("a"), "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    )
    return (
        _picked(texts, wanted.select("doc_id"))
        .join(wanted, "doc_id")
        .select("a", "b", "part", "text")
        .mapInArrow(_sets, "a long, b long, part int, elements binary")
        .repartition("b", "part")
        .sortWithinPartitions("b", "part", F.asc_nulls_first("a"))
        .mapInArrow(_decide, "a long, b long")
    )


def _sharing(tiles: DataFrame, *sums) -> DataFrame:
    """(node, n, ...) of the sets that are stored in enough of the tiles to link with another set."""
    least = f"((n * {NUMERATOR} + {DENOMINATOR - 1}) div {DENOMINATOR})"
    held = tiles.where("stored").groupBy("node", "n").agg(F.count("*").alias("shared"), *sums)
    return held.where(f"shared >= 1 + {least} div {EXTRA}").drop("shared")


def _tiles(texts: DataFrame, often: np.ndarray) -> DataFrame:
    """The rows of all tiles, of sets that share enough prefix shingles with others; score: how central a set is."""
    tiles = stored(
        texts.mapInArrow(_prefixes(often), "shingle long, node long, n int")
        .repartition("shingle")
        .sortWithinPartitions("shingle", "n", "node")
        .mapInArrow(_shared, TILE_ROWS)
    )
    enough = _sharing(tiles, F.sum("met").alias("met")).select("node", (F.col("met") / F.col("n")).alias("score"))
    return stored(tiles.drop("met").join(enough, "node"))


def _centred(tiles: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets with the centres of their tiles."""
    rows = tiles.where("stored").select("shingle", "part", "node", "n", "score")
    return rows.repartition("shingle", "part").sortWithinPartitions("shingle", "part", "n", "node").mapInArrow(_centre_pairs, "a long, b long").distinct()


def _still_open(tiles: DataFrame, facts: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) that the components (node, component) leave open.

    A set that links with another component shares enough shingles with it, so it is in enough mixed tiles.
    """
    rows = tiles.drop("score").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def mixed(rows: DataFrame) -> DataFrame:
        held = rows.groupBy("shingle").agg(F.min("component").alias("cluster"), F.max("component").alias("hi"), F.count("*").alias("rows"))
        return held.where("cluster != hi").drop("hi")

    rows = stored(rows.join(mixed(rows).select("shingle"), "shingle"))
    rows = stored(rows.join(_sharing(rows).select("node"), "node"))
    # Tiles with the same smallest component are mostly the same sets: they go to one task, in shares if they are many.
    clusters = checkpoint(mixed(rows))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"), F.ceil(F.sum("rows") / CLUSTER_ROWS).cast("int").alias("shares"))
    placed = attach_groups(clusters.select("shingle", "cluster"), sizes, "cluster", "size").drop("size")
    rows = rows.join(placed, "shingle").withColumn("share", F.pmod(F.xxhash64("shingle", "part"), "shares").cast("int"))
    rows = rows.join(facts.select("node", "signature"), "node")
    order = ["cluster", "share", "shingle", "part", "n", "node"]
    return rows.repartition("cluster", "share").sortWithinPartitions(*order).drop("cluster", "share", "shares").mapInArrow(_open_pairs, "a long, b long").distinct()


def mark(text: str = "text") -> Column:
    """Tells apart texts of rows that share an id."""
    return F.xxhash64(text)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for every row of docs (doc_id, text)."""
    return marked_components(docs).drop("mark")


def marked_components(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n_shingles, component_id), a row for every row of docs (doc_id, text)."""
    texts = small_batches(docs.select("doc_id", "text"))
    told = stored(texts.withColumn("mark", mark()).mapInArrow(_summaries, "kind int, a long, n long, node long, mark long"))
    rows = told.where("kind = 0").select(F.col("a").alias("doc_id"), "mark", "n", "node")
    nodes = stored(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("size")))

    # At most average set size / FREQUENT_SHARE shingles are frequent, whatever the number of texts.
    total = rows.count()
    often = told.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= max(3, total * FREQUENT_SHARE)).select("a").collect()
    often = np.sort(np.array([r[0] for r in often], np.int64).astype(U))

    tiles = _tiles(texts, often)
    wanted = checkpoint(tiles.select("node").distinct().join(nodes.select("node", F.col("first").alias("doc_id")), "node"))
    facts = stored(
        _picked(texts, wanted.select("doc_id"), _signatures, "doc_id long, node long, n int, signature binary")
        .join(wanted, ["node", "doc_id"])
        .dropDuplicates(["node"])
        .select("node", "doc_id", "n", "signature")
    )
    links = checkpoint(_decided(_centred(tiles), facts, texts))
    links = links.unionByName(checkpoint(_decided(_still_open(tiles, facts, components(links)), facts, texts)))

    named = nodes.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"), F.sum("size").alias("members"))
    groups = attach_groups(named.select("node", "size", "component"), least, "component", "members").select("node", "size", "component_id")
    linked = attach_groups(rows.where("node is not null"), groups, "node", "size")
    alone = rows.where("node is null").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "mark", F.col("n").alias("n_shingles"), "component_id"]
    return linked.select(*columns).unionByName(alone.select(*columns))
