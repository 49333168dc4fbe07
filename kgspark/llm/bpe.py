"""Byte-level BPE by a monoid of encoded text: halves are encoded on their own and joined at the seam.

A join re-encodes a window around the seam and widens it until what lies outside provably stays as it is. That
happens on two levels. Between pieces (matches of the splitting pattern): a match of the left half that ends at
least LOOKAHEAD characters before the seam cannot see it, and once the window's matches and the right half's
matches share a boundary that no longer sees the window's end, all later matches are equal. Inside a long piece:
an adjacent pair of tokens is stable when the two tokens' bytes encode to just these two, and a sequence whose
adjacent pairs are all stable is the encoding of its bytes. Decoding concatenates up the same tree.

Rules for input: null text encodes to no ids; texts are taken whole, whatever their length; every input row gives
one output row with its columns and the new one (which replaces a column of the same name).
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import portions, small_batches

#: Characters of a text that are encoded without being halved, and bytes of a piece likewise.
LEAF_CHARS, LEAF_BYTES = 4096, 32
#: No match of the pattern depends on more than so many characters after its end: a contraction has three
#: characters, the white-space rule looks one past a run.
LOOKAHEAD = 3
#: Pieces whose ids are remembered; the memory is emptied when full, which changes no result.
REMEMBERED = 300_000


class ByteBpe:
    def __init__(self, path: str, pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES) -> None:
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.matches = regex.compile(pattern).findall
        self.leaf_chars, self.leaf_bytes = leaf_chars, leaf_bytes
        self.known: dict[str, bytes] = {}

    # Inside one piece

    def _merged(self, data: bytes) -> list[int]:
        """Merges by rank, lowest first and leftmost among equals, until none is left."""
        rank_of, never = self.ranks.get, 1 << 40
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [rank_of(data[i : i + 2], never) for i in range(len(data) - 1)]
        while ranks and (least := min(ranks)) < never:
            at = ranks.index(least)
            parts[at] += parts.pop(at + 1)
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of(parts[at - 1] + parts[at], never)
            if at < len(ranks):
                ranks[at] = rank_of(parts[at] + parts[at + 1], never)
        return [self.ranks[p] for p in parts]

    def _stable(self, left: int, right: int) -> bool:
        return self._merged(self.tokens[left] + self.tokens[right]) == [left, right]

    def _joined_tokens(self, left: list[int], right: list[int]) -> list[int]:
        width = 2
        while True:
            tail, head = left[-width:], right[:width]
            window = self._merged(b"".join(self.tokens[t] for t in tail + head))
            rest, more = left[: len(left) - len(tail)], right[len(head) :]
            if (not rest or self._stable(rest[-1], window[0])) and (not more or self._stable(window[-1], more[0])):
                return rest + window + more
            width *= 2

    def _halved(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf_bytes:
            return self._merged(data)
        middle = len(data) // 2
        return self._joined_tokens(self._halved(data[:middle]), self._halved(data[middle:]))

    def _code(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "replace")
        ids = [self.ranks[data]] if data in self.ranks else self._halved(data)
        return struct.pack(f"<{len(ids)}I", *ids)

    # Between pieces

    def _codes(self, pieces: list[str]) -> list[bytes]:
        codes = list(map(self.known.get, pieces))
        if None in codes:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            for i, code in enumerate(codes):
                if code is None:
                    piece = pieces[i]
                    if (code := self.known.get(piece)) is None:
                        code = self.known[piece] = self._code(piece)
                    codes[i] = code
        return codes

    def _join(self, left: tuple[list[str], list[bytes]], right: tuple[list[str], list[bytes]]) -> tuple[list[str], list[bytes]]:
        (pieces, codes), (more, more_codes) = left, right
        seen, keep = 0, len(pieces)
        while keep and seen < LOOKAHEAD:
            keep -= 1
            seen += len(pieces[keep])
        tail, width = "".join(pieces[keep:]), LOOKAHEAD
        while True:
            head = more[:width]
            window = self.matches(tail + "".join(head))
            whole = width >= len(more)
            ends, at = {}, len(tail)
            for i, piece in enumerate(["", *head]):
                at += len(piece)
                ends[at] = i
            limit, at = at - LOOKAHEAD, 0
            for taken, piece in enumerate(["", *window]):
                at += len(piece)
                if at <= limit and at in ends:
                    window, used = window[:taken], ends[at]
                    break
            else:
                used = len(more)
                if not whole:
                    width *= 2
                    continue
            return pieces[:keep] + window + more[used:], codes[:keep] + self._codes(window) + more_codes[used:]

    def _tree(self, text: str) -> tuple[list[str], list[bytes]]:
        if len(text) <= self.leaf_chars:
            pieces = self.matches(text)
            return pieces, self._codes(pieces)
        middle = len(text) // 2
        return self._join(self._tree(text[:middle]), self._tree(text[middle:]))

    def encode(self, text: str) -> bytes:
        """The ids of text as little-endian unsigned 32-bit integers."""
        return b"".join(self._tree(text)[1])

    def decode(self, ids: memoryview | bytes) -> bytes:
        """The bytes that ids (as encode gives them) stand for."""
        numbers = memoryview(ids).cast("I")
        if len(numbers) <= 1 << 16:
            return b"".join(map(self.tokens.__getitem__, numbers))
        middle = len(numbers) // 2 * 4
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


@lru_cache(maxsize=1)
def _bpe(path: str, pattern: str) -> ByteBpe:
    """One for each Python worker, so that its pieces are remembered from task to task."""
    return ByteBpe(path, pattern)


def _mapped(df: DataFrame, name: str, source: str, make) -> DataFrame:
    """df with binary column name, made from the column source by make() of each task."""
    rest = [c for c in df.columns if c != name]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convert = make()
        for batch in portions(batches, "__source"):
            values = batch.column("__source")
            made = pa.array([convert(v) for v in values], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], made], [*rest, name])

    return small_batches(df).select(*[F.col(f"`{c}`") for c in rest], F.col(source).alias("__source")).mapInArrow(run, f"{schema}, `{name}` binary")


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", to: str = "ids") -> DataFrame:
    """df with the ids of column text as binary column to (little-endian unsigned 32-bit integers)."""

    def make():
        bpe = _bpe(path, pattern)
        return lambda value: bpe.encode(value.as_py() or "")

    return _mapped(df, to, text, make)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """df with the bytes that column ids stands for as binary column to; null ids give no bytes."""

    def make():
        bpe = _bpe(path, pattern)
        return lambda value: bpe.decode(value.as_py() or b"")

    return _mapped(df, to, ids, make)
