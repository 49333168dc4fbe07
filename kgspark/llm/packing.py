"""Best-fit packing of token pieces into sequences, after a Martello-Toth dominance reduction.

Pieces of one length are alike, so both steps work on the number of pieces of each length: at most CAPACITY
counts, whatever the number of documents. The reduction fixes sequences that dominate every other way to place
their largest piece; best fit, longest first, places the rest. The plan says for ranges of ranks within a length
which sequence and offset they get. A range of sequences moves to a residual less than half of the one before
whenever pieces are added, so the plan has at most about log2(CAPACITY) * 3 * CAPACITY rows and goes into the
tasks whole. Ranks come from salted windows, so a length that a third of all pieces share is many small sorts.

Rules for input: null text is empty and gives one piece of one token; every row of the input is packed, repeated
rows and ids too; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm.common import checkpoint, portions, small_batches

CAPACITY = 2048
END_ID = 0
#: Parts that the pieces of one length are ranked in.
SALTS = 256
#: Words and their parts whose ids a task remembers; when full, the half that came first stays, which is mostly the
#: frequent ones, and changes no result.
REMEMBERED = 500_000
#: Marks that are cut off from the end of a word.
MARKS = "".join(c for c in map(chr, range(128)) if not c.isalnum())


class WordIds:
    """Ids of texts by a tokenizer that drops white space: every run between spaces is encoded once."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {"": b""}

    @staticmethod
    def _core(word: str) -> tuple[str, str]:
        """Two parts with the word's ids: marks after a letter or digit are tokens of their own, and case goes.

        Only plain marks are cut off and only Latin letters lowered, where neither meets Unicode composition.
        """
        core = word.rstrip(MARKS)
        # The small form of one letter, \u0130, ends in a combining mark, which would be one token with the marks after it.
        if not core[-1:].isalnum() or not core[-1].lower().isalnum():
            core = word
        mark = word[len(core) :]
        return core.lower() if core.isascii() or max(core) < "\u0250" else core, mark

    def _parts(self, word: str) -> tuple[str, str]:
        """A word that holds a token added to the vocabulary stays whole: the library finds it before any other rule."""
        return (word, "") if any(token in word for token in self.special) else self._core(word)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, followed by END_ID."""
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        known = self.known
        codes = list(map(known.get, words))
        if None in codes:
            if len(known) > REMEMBERED:
                known = self.known = dict(islice(known.items(), REMEMBERED // 2))
            missing = [i for i, code in enumerate(codes) if code is None]
            cut = self._parts if any(token in text for token in self.special) else self._core
            halves = [cut(words[i]) for i in missing]
            new = [half for half in {half for both in halves for half in both} if half not in known]
            for half, code in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
                known[half] = array("I", code.ids).tobytes()
            for i, (core, mark) in zip(missing, halves, strict=True):
                codes[i] = known[words[i]] = known[core] + known[mark] if mark else known[core]
        codes.append(END_ID.to_bytes(4, "little"))
        return b"".join(codes)


@lru_cache(maxsize=1)
def _word_ids(path: str) -> WordIds:
    """One for each Python worker, so that its words are remembered from task to task."""
    return WordIds(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids) of every document's ids, cut every capacity tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(path)
        for batch in portions(batches, "text"):
            rows: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = words.ids(text.as_py() or "")
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(rows, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


class Plan:
    """Ranges of ranks within a length, with the sequences and offsets that they get."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY) -> None:
        self.capacity = capacity
        self.left = {n: c for n, c in sorted(counts.items()) if c > 0}
        self.rank = dict.fromkeys(self.left, 0)
        self.ranges: list[tuple[int, int, int, int, int]] = []  # length, first rank, first sequence, offset, pieces each
        self.sequences = 0
        self._reduce()
        self.reduced = self.sequences
        self._best_fit()

    def _place(self, length: int, count: int, sequence: int, offset: int, each: int = 1) -> None:
        """Puts count pieces into sequences from sequence on, each of them each."""
        self.ranges.append((length, self.rank[length], sequence, offset, each))
        self.rank[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]

    def _smallest(self, lengths: list[int], without: int, most: int) -> list[int]:
        """Up to most smallest pieces, one piece of length without left out."""
        out: list[int] = []
        for n in lengths:
            out += [n] * min(most - len(out), self.left[n] - (n == without))
            if len(out) >= most:
                break
        return out

    def _partner(self, length: int, lengths: list[int]) -> int | None:
        """The piece whose set with a piece of length dominates all others: 0 for none, None if undecided."""
        room = self.capacity - length
        least = self._smallest(lengths, length, 3)
        if not least or least[0] > room:
            return 0
        fits = [n for n in lengths if n <= room and self.left[n] - (n == length) > 0]
        if fits[-1] == room or len(least) < 2 or least[0] + least[1] > room:
            return fits[-1]
        if len(least) < 3 or sum(least) > room:  # at most two pieces fit beside it
            best, hi = 0, len(fits) - 1
            for lo, n in enumerate(fits):
                while hi >= 0 and n + fits[hi] > room:
                    hi -= 1
                for other in fits[max(hi, 0) : hi + 1]:
                    if hi > lo or (hi == lo and self.left[n] - (n == length) > 1):
                        best = max(best, n + other)
            if best <= fits[-1]:
                return fits[-1]
        return None

    def _reduce(self) -> None:
        changed = True
        while changed:
            changed = False
            for length in sorted(self.left, reverse=True):
                while self.left.get(length) and (partner := self._partner(length, sorted(self.left))) is not None:
                    changed = True
                    if partner == 0:
                        count = self.left[length] if length * 2 > self.capacity else 1
                        self._place(length, count, self.sequences, 0)
                    elif partner == length:
                        count = self.left[length] // 2
                        self._place(length, 2 * count, self.sequences, 0, 2)
                    else:
                        count = min(self.left[length], self.left[partner])
                        self._place(length, count, self.sequences, 0)
                        self._place(partner, count, self.sequences, length)
                    self.sequences += count

    def _best_fit(self) -> None:
        rooms: dict[int, list[tuple[int, int]]] = {}  # residual: ranges of sequences (first, number)
        for length in sorted(self.left, reverse=True):
            while count := self.left.get(length, 0):
                room = min((r for r in rooms if r >= length), default=None)
                if room is None:
                    room, first = self.capacity, self.sequences
                    number = -(-count // (self.capacity // length))
                    self.sequences += number
                else:
                    first, number = rooms[room].pop()
                    if not rooms[room]:
                        del rooms[room]
                each = min(room // length, count)
                used = min(number, count // each)
                self._place(length, used * each, first, self.capacity - room, each)
                rooms.setdefault(room - each * length, []).append((first, used))
                if used < number:
                    rooms.setdefault(room, []).append((first + used, number - used))
        self.rooms = rooms

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by length and rank within the length."""
        if not len(length):
            return length, length
        rows = np.array(sorted(self.ranges), np.int64)
        at = np.searchsorted(rows[:, 0] * (1 << 40) + rows[:, 1], length * (1 << 40) + rank, "right") - 1
        _, first, sequence, offset, each = rows[at].T
        step = rank - first
        return sequence + step // each, offset + step % each * length


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items (doc_id, piece, start, length, ids_crc32, ...) with sequence_id and offset; lengths are 1 to capacity."""
    key = ["doc_id", "piece", "ids_crc32", "start"]
    salted = items.withColumn("salt", F.pmod(F.xxhash64(*key), F.lit(SALTS)))
    counts = checkpoint(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    plan = Plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = salted.join(before, ["length", "salt"]).withColumn(
        "rank", F.col("before") + F.row_number().over(Window.partitionBy("length", "salt").orderBy(*key)) - 1
    )
    columns = items.columns
    schema = ", ".join(f"`{c}` {items.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.find(batch.column("length").to_numpy().astype(np.int64), batch.column("rank").to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*columns, "sequence_id", "offset"])

    return ranked.select(*columns, F.col("rank").cast("long").alias("rank")).mapInArrow(run, f"{schema}, sequence_id long, `offset` long")


def packed_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents, without their ids, and their places."""
    return pack(checkpoint(pieces(docs, path, capacity).drop("ids")), capacity)
