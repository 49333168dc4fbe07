"""Exact similarity join of short texts, and containment join.

``best_pairs`` finds, for every query text, the labels that can be among its best k, with
``difflib`` ratios, without comparing every query with every label:

1. characters are numbered by occurrence (the second ``a`` of a text is another item than the
   first), so texts are sets. A score of at least t needs ``t * (l1 + l2) / 2`` common items, so with
   items ordered from rare to frequent a pair that can match shares an item among the first few of both
   (``l - needed + 1``). That is an inverted index: labels are filed under (class of lengths, item), and
   a query text is sent only to the items of its own beginning, for the lengths that it can match;
2. an item that many labels begin with is several blocks of bounded size, and so are its queries; a block
   of labels is sent once to each task that works on it, and the query blocks pass it there;
3. in a block one numpy pass computes the longest common subsequence of a query with the labels
   that hold the item early enough (bit-parallel, one machine word per label).
   ``2 * lcs / (l1 + l2)`` bounds both the ratio and the containment score from above. A pair is taken
   under the first item it shares only;
4. a text with many such labels in a block scores some with the highest bounds there; what can't come before the k-th
   best of them (by score, then representative), in the class signature of the label, stays in the block. Near-equal
   labels by the thousand would otherwise send their square to the next step;
5. the other pairs whose bound reaches the threshold are sorted by text and falling bound and scored until the
   bound is below the k-th best score of that text and class signature.

Nothing is sampled or cut: a pair is only skipped when k better ones exist or it cannot reach
the threshold. Labels of more than WORD characters are filed under their class of lengths alone:
their characters tell little and their beginnings are long.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

LABELS_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 256
BLOCKS_PER_TASK = 64  # query blocks that pass one copy of a label block
BLOCKS_PER_STRIPE = 16  # label blocks that one task passes with these query blocks, so that it knows their best scores so far
FEW = 64  # labels that a text takes from a block without scoring some of them first
CELLS = 1 << 17  # pairs that are bounded at once
WORD = 64
LONG_LABEL = 200  # from this length on difflib drops characters that are too common
SLACK = 1e-9  # bounds are compared with scores computed in another order
ORDERED = 4096  # items whose frequency is known; all others count as rarer
EXACT_LENGTHS = 32  # up to here every length is a class of its own, above classes grow by a tenth
NO_ITEM = -(1 << 62)


def _class_starts() -> np.ndarray:
    starts = list(range(EXACT_LENGTHS + 1))
    while starts[-1] < 1 << 31:
        after = max(starts[-1] + 1, starts[-1] * 11 // 10)
        starts.append(WORD + 1 if starts[-1] <= WORD < after else after)
    return np.array(starts, dtype=np.int64)


CLASS_STARTS = _class_starts()


def _matched(a: str, b: str) -> int:
    """Characters in matching blocks: the longest common piece (leftmost in a, then in b), and
    the same again on both sides of it."""
    todo, total = [(a, b)], 0
    while todo:
        a, b = todo.pop()
        size = at = 0
        for i in range(len(a)):
            while i + size < len(a) and a[i:i + size + 1] in b:
                size, at = size + 1, i
            if i + size >= len(a):
                break
        if size:
            total += size
            j = b.find(a[at:at + size])
            if at and j:
                todo.append((a[:at], b[:j]))
            if at + size < len(a) and j + size < len(b):
                todo.append((a[at + size:], b[j + size:]))
    return total


def ratio(query: str, label: str) -> float:
    """``SequenceMatcher(None, query, label).ratio()``; the order of arguments matters.

    Below 200 characters no character of the label counts as too common, and substring search
    finds the blocks several times faster.
    """
    if len(label) >= LONG_LABEL:
        return SequenceMatcher(None, query, label).ratio()
    both = len(query) + len(label)
    return 2.0 * _matched(query, label) / both if both else 1.0


def link_score(query: str, label: str) -> float:
    """1 for equal texts, else the larger of the ratio and the containment share."""
    if query == label:
        return 1.0
    best = ratio(query, label)
    if query and label and (query in label or label in query):
        best = max(best, min(len(query), len(label)) / max(len(query), len(label)))
    return best


def _each(score, query: pd.Series, label: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else score(a, b) for a, b in zip(query, label)], dtype="float64")


@F.pandas_udf(DoubleType())
def score_pairs(query: pd.Series, label: pd.Series) -> pd.Series:
    """Ratio of each pair; null in, null out."""
    return _each(ratio, query, label)


@F.pandas_udf(DoubleType())
def link_scores(query: pd.Series, label: pd.Series) -> pd.Series:
    return _each(link_score, query, label)


def needed(a: int, b: int, threshold: float) -> int:
    """Common characters that texts of these lengths need for the threshold."""
    return math.ceil(threshold * (a + b) / 2 - SLACK)


def _reach(n: int, threshold: float) -> tuple[int, int]:
    """Shortest and longest text that a text of n characters can match."""
    return math.ceil(n * threshold / (2 - threshold) - SLACK), math.floor(n * (2 - threshold) / threshold + SLACK)


def items(text: str, ranks: dict[tuple[str, int], int]) -> list[int]:
    """The numbered characters of a text from rare to frequent; any fixed order is right."""
    seen: Counter = Counter()
    out = []
    for ch in text:
        seen[ch] += 1
        rank = ranks.get((ch, seen[ch]))
        out.append(-(ord(ch) << 32 | seen[ch]) if rank is None else rank)
    return sorted(out)


class _Block:
    """Labels of one tile as bit patterns: for each character, the positions it has in each label."""

    def __init__(self, labels: list[str]):
        self.lengths = np.array([len(x) for x in labels], dtype=np.int64)
        self.short = np.flatnonzero(self.lengths <= WORD)
        self.long = np.flatnonzero(self.lengths > WORD)
        self.long_counts = [Counter(labels[i]) for i in self.long]
        size = self.lengths[self.short]
        # Half words are enough for blocks of shorter labels.
        self.word = np.uint32 if size.max(initial=0) <= WORD // 2 else np.uint64
        width = np.iinfo(self.word).bits
        codes = np.frombuffer("".join(labels[i] for i in self.short).encode("utf-32-le"), dtype=np.uint32)
        row = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
        bit = self.word(1) << place.astype(self.word)
        # By character and label; a character of few labels keeps only their rows.
        order = np.lexsort((row, codes))
        codes, row, bit = codes[order], row[order], bit[order]
        self.masks = {}
        edges = np.flatnonzero(np.diff(codes, prepend=codes[:1] + 1, append=codes[-1:] + 1)) if len(codes) else []
        for start, end in zip(edges[:-1], edges[1:]):
            firsts = start + np.flatnonzero(np.diff(row[start:end], prepend=-1))
            rows, bits = row[firsts], np.bitwise_or.reduceat(bit, np.append(firsts, end) if end < len(bit) else firsts)[:len(firsts)]
            if 4 * len(rows) >= len(size):
                mask = np.zeros(len(size), dtype=self.word)
                mask[rows] = bits
                rows, bits = None, mask
            self.masks[chr(codes[start])] = rows, bits
        below = (self.word(1) << np.minimum(size, width - 1).astype(self.word)) - self.word(1)
        self.used_bits = np.where(size == width, ~self.word(0), below)

    def bounds(self, query: str) -> np.ndarray:
        """Upper bound of the score of every label: common subsequence, or common characters."""
        common = np.zeros(len(self.lengths), dtype=np.int64)
        common[self.short] = self._matched([query], len(self.short))[0]
        if len(self.long):
            counts = Counter(query)
            common[self.long] = [sum(min(n, c[ch]) for ch, n in counts.items()) for c in self.long_counts]
        total = self.lengths + len(query)
        return np.where(total > 0, 2.0 * common / np.maximum(total, 1), 1.0)

    def bounds_of(self, queries: list[str], first: int) -> np.ndarray:
        """Bounds of several queries with the first labels, in a block without long ones."""
        total = np.array([len(q) for q in queries])[:, None] + self.lengths[:first]
        return 2.0 * self._matched(queries, first) / np.maximum(total, 1)

    def _matched(self, queries: list[str], n: int) -> np.ndarray:
        """Longest common subsequence of each query with each of the first n short labels."""
        used = sorted(set().union(*queries) & self.masks.keys())
        number = {ch: i + 1 for i, ch in enumerate(used)}
        table = np.zeros((len(used) + 1, n), dtype=self.word)  # its first row is of characters that no label has
        for ch, i in number.items():
            rows, mask = self.masks[ch]
            if rows is None:
                table[i] = mask[:n]
            else:
                table[i, rows[:np.searchsorted(rows, n)]] = mask[:np.searchsorted(rows, n)]
        codes = np.zeros((max(map(len, queries)), len(queries)), dtype=np.int64)
        for i, q in enumerate(queries):
            codes[:len(q), i] = [number.get(ch, 0) for ch in q]
        v = np.full((len(queries), n), ~self.word(0))
        w = np.empty_like(v)
        for code in codes:
            both = table[code]
            both &= v
            np.add(v, both, out=w)
            v -= both
            v |= w
        return np.bitwise_count(~v & self.used_bits[:n])


class _Best:
    """Best k scores of one query and signature, per representative entity."""

    def __init__(self, k: int):
        self.k, self.scores, self.floor = k, {}, -1.0

    def add(self, rep: int, score: float) -> None:
        if score > self.scores.get(rep, -1.0):
            self.scores[rep] = score
            if len(self.scores) > self.k:
                del self.scores[min(self.scores, key=self.scores.get)]
            if len(self.scores) == self.k:
                self.floor = min(self.scores.values())


def _nulls_first(value) -> tuple:
    return value is not None, value


class _Ranked:
    """The first k representatives by falling score and then in their order; ``last`` is (score, representative) of the k-th."""

    def __init__(self, k: int):
        self.k, self.scores, self.last = k, {}, None

    def add(self, rep, score: float) -> None:
        if score > self.scores.get(rep, -1.0):
            self.scores[rep] = score
            if len(self.scores) >= self.k:
                behind = lambda r: (-self.scores[r], _nulls_first(r))
                if len(self.scores) > self.k:
                    del self.scores[max(self.scores, key=behind)]
                rep = max(self.scores, key=behind)
                self.last = self.scores[rep], rep


LABEL_ROWS = "part int, item bigint, pos int, norm string, head array<bigint>"
QUERY_ROWS = "part int, item bigint, pos int, q string, head array<bigint>"


def _label_rows(ranks: dict, threshold: float):
    """The index entries of a label: one for each item that a matching text can share first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for norm in batch["norm"]:
                m = len(norm)
                part = int(np.searchsorted(CLASS_STARTS, m, side="right")) - 1
                if m == 0 or m > WORD:
                    out.append((part, NO_ITEM, 0, norm, []))
                    continue
                head = items(norm, ranks)[:m - needed(_reach(m, threshold)[0], m, threshold) + 1]
                out += [(part, item, pos, norm, head) for pos, item in enumerate(head)]
            yield pd.DataFrame(out, columns=["part", "item", "pos", "norm", "head"])

    return run


def _query_rows(ranks: dict, threshold: float):
    """Where a text is looked up: for each class of lengths, the items of its beginning."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for q in batch["q"]:
                n = len(q)
                low, high = _reach(n, threshold)
                every = items(q, ranks)
                first, last = (int(np.searchsorted(CLASS_STARTS, x, side="right")) - 1 for x in (low, high))
                for part in range(first, last + 1):
                    start = int(CLASS_STARTS[part])
                    if start == 0 or start > WORD:
                        out.append((part, NO_ITEM, 0, q, []))
                        continue
                    head = every[:n - needed(n, max(start, low), threshold) + 1]
                    out += [(part, item, pos, q, head[:pos]) for pos, item in enumerate(head)]
            yield pd.DataFrame(out, columns=["part", "item", "pos", "q", "head"])

    return run


def _padded(lists: list, blank: int) -> np.ndarray:
    out = np.full((len(lists), max(map(len, lists), default=0)), blank, dtype=np.int64)
    for i, x in enumerate(lists):
        out[i, :len(x)] = x
    return out


class _Held:
    """A block of labels filed under one item, those that hold it earliest first."""

    def __init__(self, labels: list):
        labels = sorted(labels, key=lambda x: (x["pos"], x["norm"]))
        self.norms = np.array([x["norm"] for x in labels], dtype=object)
        self.pos = np.array([x["pos"] for x in labels], dtype=np.int64)
        self.block = _Block(list(self.norms))
        self.earlier = _padded([x["head"][:x["pos"]] for x in labels], NO_ITEM)
        if labels and "sigs" in labels[0]:
            # Class signatures by number: those of label i are sig_of[first[i]:first[i + 1]], with their representatives.
            self.first = np.cumsum([0, *(len(x["sigs"]) for x in labels)])
            number: dict = {}
            self.sig_of = np.array([number.setdefault(s, len(number)) for x in labels for s in x["sigs"]])
            self.sigs, self.rep_of = list(number), [r for x in labels for r in x["reps"]]
            # Representatives in their order, and the place of each in it.
            self.reps = sorted(set(self.rep_of), key=_nulls_first)
            place = {r: i for i, r in enumerate(self.reps)}
            self.place_of = np.array([place[r] for r in self.rep_of])
            self.early = np.minimum.reduceat(self.place_of, self.first[:-1]) / (len(self.reps) + 1)  # of a label, below 1

    def possible(self, query: str, found: np.ndarray, bound: np.ndarray, best: dict, k: int, score) -> np.ndarray:
        """Which of the found labels can be among the best k of the query in one of their signatures.

        ``best`` holds the best of the query by signature so far. Labels with the highest bounds are scored: some in
        any case, and more while a signature of those that are left has no k-th best.
        """
        limits, places = np.full(len(self.sigs), -1.0), np.zeros(len(self.sigs), dtype=np.int64)

        def limit(i: int) -> None:
            last = best[self.sigs[i]].last
            if last:
                limits[i], places[i] = last[0], bisect_right(self.reps, _nulls_first(last[1]), key=_nulls_first) - 1

        for i, sig in enumerate(self.sigs):
            if sig in best:
                limit(i)
        every = np.full(len(self.norms), -2.0)
        every[found] = bound
        every = np.repeat(every, np.diff(self.first))
        at, scored, turn = np.arange(len(found)), np.zeros(len(found), dtype=bool), 0
        while True:
            lowest = limits[self.sig_of]
            ahead = (every > lowest) | ((every + SLACK >= lowest) & (self.place_of <= places[self.sig_of]))
            at = at[np.logical_or.reduceat(ahead, self.first[:-1])[found[at]]]
            open_ = np.minimum.reduceat(lowest, self.first[:-1])[found[at]] < 0
            todo = at[~scored[at] & (open_ | (turn == 0))]
            if len(at) <= FEW or not len(todo):
                return at
            if len(todo) > 4 * k:  # of equal bounds the first representatives, roughly
                todo = todo[np.argpartition(1e-6 * self.early[found[todo]] - bound[todo], 4 * k)[:4 * k]]
            for label in found[todo].tolist():
                value = score(query, self.norms[label])
                for j in range(self.first[label], self.first[label + 1]):
                    best.setdefault(self.sigs[self.sig_of[j]], _Ranked(k)).add(self.rep_of[j], value)
            for i in set(self.sig_of[j] for label in found[todo].tolist() for j in range(self.first[label], self.first[label + 1])):
                limit(int(i))
            scored[todo] = True
            turn += 1

    def reached(self, queries: list, item: int, threshold: float) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray, int]]:
        """For some queries at a time: these, and by query the numbers of query and label of the pairs whose bound reaches the
        threshold and that share no earlier item, their bounds, and how many pairs were bounded."""
        if item == NO_ITEM:
            for x in queries:
                bound = self.block.bounds(x["q"])
                found = np.flatnonzero(bound >= threshold - SLACK)
                yield [x["q"]], np.zeros(len(found), dtype=np.int64), found, bound[found], len(bound)
            return
        longest = int(self.block.lengths.max())
        # The beginning of a label of this length, among texts of n characters, ends here.
        ends = lambda x: longest - needed(len(x["q"]), longest, threshold) + 1
        queries = sorted(queries, key=lambda x: len(x["q"]))  # the shortest have the longest beginnings
        at = 0
        while at < len(queries):
            first = int(np.searchsorted(self.pos, ends(queries[at])))
            if not first:
                return
            some = queries[at:at + max(1, CELLS // first)]
            at += len(some)
            bound = self.block.bounds_of([x["q"] for x in some], first)
            asking, found = np.nonzero(bound >= threshold - SLACK)
            if len(found):
                heads = _padded([x["head"] for x in some], NO_ITEM + 1)
                again = (self.earlier[found][:, :, None] == heads[asking][:, None, :]).any(axis=(1, 2))
                asking, found = asking[~again], found[~again]
            yield [x["q"] for x in some], asking, found, bound[asking, found], bound.size


def _bound_tiles(threshold: float, counted: bool, k: int = 0, score=None):
    """Pairs (q, norm, bound) of the tiles that pass by; or, counted, how many pairs were bounded and kept.

    With k and a score, only those of labels that can be among the best k of the text and a signature; equal scores rank by
    representative.
    """

    def kept(held: _Held, texts: list[str], asking: np.ndarray, found: np.ndarray, bound: np.ndarray, best: dict) -> np.ndarray:
        """Numbers of the pairs that are kept."""
        if not k or len(found) <= FEW:
            return np.arange(len(found))
        edges = np.searchsorted(asking, np.arange(len(texts) + 1))
        out = []
        for text, start, end in zip(texts, edges[:-1].tolist(), edges[1:].tolist()):
            if end - start > FEW:
                out.append(start + held.possible(text, found[start:end], bound[start:end], best.setdefault(text, {}), k, score))
            elif end > start:
                out.append(np.arange(start, end))
        return np.concatenate(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come in order of label block; its labels come first and are held while its query blocks pass.
        at = held = asked = None
        labels, queries, best = [], [], {}

        def passed() -> Iterator[pd.DataFrame]:
            """The query block that is read has passed the held label block, if there is one."""
            nonlocal held, labels, queries
            if labels and queries:
                held, labels = _Held(labels), []
            if held and queries:
                for texts, asking, found, bound, n in held.reached(queries, at[1], threshold):
                    if counted:
                        yield pd.DataFrame({"bounded": [n], "kept": [len(asking)]})
                    elif len(found):
                        some = kept(held, texts, asking, found, bound, best)
                        yield pd.DataFrame({"q": np.array(texts, dtype=object)[asking[some]], "norm": held.norms[found[some]], "bound": bound[some]})
            queries = []

        for batch in batches:
            more = [batch[c] for c in ("sigs", "reps")] if k else [[None] * len(batch)] * 2
            for *place, turn, text, pos, head, sigs, reps in zip(
                    *[batch[c] for c in ("part", "item", "stripe", "share", "block", "turn", "text", "pos", "head")], *more):
                if place != at or turn != asked:
                    yield from passed()
                    if place != at:
                        if at is None or place[:4] != at[:4]:
                            best = {}
                        at, held, labels = place, None, []
                    asked = turn
                if turn < 0:
                    labels.append({"norm": text, "pos": pos, "head": head} | ({"sigs": sigs, "reps": reps} if k else {}))
                else:
                    queries.append({"q": text, "head": head})
        yield from passed()

    return run


def _score_of(contain: bool):
    return link_score if contain else (lambda a, b: 1.0 if a == b else ratio(a, b))


def _score_sorted(k: int, threshold: float, contain: bool):
    """Scores the pairs of a text in falling order of bound, as long as one of its signatures needs them."""
    score = _score_of(contain)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, found = None, {}
        for batch in batches:
            out: list[tuple[str, str, str, float]] = []
            for q, norm, bound, groups in zip(batch["q"], batch["norm"], batch["bound"], batch["groups"]):
                if q != at:
                    at, found = q, {}
                value = None
                for group in groups:
                    mine = found.setdefault(group["sig"], _Best(k))
                    if bound + SLACK < mine.floor:
                        continue
                    value = score(q, norm) if value is None else value
                    if value >= threshold:
                        out.append((q, norm, group["sig"], value))
                        mine.add(group["rep"], value)
            yield pd.DataFrame(out, columns=["q", "norm", "sig", "score"])

    return run


def item_ranks(labels: DataFrame) -> dict[tuple[str, int], int]:
    """Ranks of the ORDERED most frequent numbered characters, the rarest of them first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for batch in batches:
            for norm in batch["norm"]:
                for ch, n in Counter(norm[:WORD]).items():
                    found.update((ch, i) for i in range(1, n + 1))
        yield pd.DataFrame([(ch, i, n) for (ch, i), n in found.items()], columns=["ch", "i", "n"])

    totals = labels.select("norm").mapInPandas(count, "ch string, i int, n bigint").groupBy("ch", "i").agg(F.sum("n").alias("n"))
    top = totals.orderBy(F.desc("n"), "ch", "i").limit(ORDERED).collect()  # at most ORDERED rows
    return {(r["ch"], r["i"]): rank for rank, r in enumerate(reversed(top))}


def file_labels(labels: DataFrame, ranks: dict, threshold: float) -> DataFrame:
    """Index entries (LABEL_ROWS) of distinct label texts (norm)."""
    return labels.select("norm").mapInPandas(_label_rows(ranks, threshold), LABEL_ROWS)


def ask_texts(queries: DataFrame, ranks: dict, threshold: float) -> DataFrame:
    """Where distinct texts (q) are looked up (QUERY_ROWS); of the same ranks and threshold as the index."""
    return queries.select("q").mapInPandas(_query_rows(ranks, threshold), QUERY_ROWS)


def _tiles(filed: DataFrame, asked: DataFrame, threshold: float, tasks: int | None, groups: DataFrame | None = None) -> DataFrame:
    """Rows of label blocks, and behind each those of the query blocks that share its class of lengths and its item.

    Labels carry the signatures and representatives of ``groups(norm, sigs, reps)``, if given.
    """
    spark = filed.sparkSession
    tasks = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    key = ["part", "item"]
    # One row for each class and item, however many texts there are.
    size = lambda rows, per, name: rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / per).alias(name))
    keys = size(filed, LABELS_PER_BLOCK, "label_blocks").join(size(asked, QUERIES_PER_BLOCK, "query_blocks"), key)
    keys = keys.withColumn("shares", F.ceil(F.col("query_blocks") / BLOCKS_PER_TASK))
    block = lambda rows, text, n: F.pmod(F.xxhash64(text), F.col(n))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    carried = ["sigs", "reps"] if groups else []
    named = filed.join(groups, "norm") if groups else filed
    sent = named.join(keys, key).withColumn("block", block(filed, "norm", "label_blocks")).select(
        *key, "block", every("shares").alias("share"), F.lit(-1).cast("bigint").alias("turn"), F.col("norm").alias("text"), "pos", "head", *carried)
    passing = asked.join(keys, key).withColumn("turn", block(asked, "q", "query_blocks")).select(
        *key, every("label_blocks").alias("block"), F.pmod("turn", "shares").alias("share"), "turn", F.col("q").alias("text"), "pos", "head")
    both = sent.unionByName(passing, allowMissingColumns=True).withColumn("stripe", F.floor(F.col("block") / BLOCKS_PER_STRIPE))
    place = [*key, "stripe", "share"]
    return both.repartition(tasks, *place).sortWithinPartitions(*place, "block", "turn").select(
        *place, "block", "turn", "text", "pos", "head", *carried)


def _indexed(queries: DataFrame, labels: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    ranks = item_ranks(labels)
    return file_labels(labels, ranks, threshold), ask_texts(queries, ranks, threshold)


def best_pairs(
    queries: DataFrame, labels: DataFrame, k: int, threshold: float, contain: bool = True, tasks: int | None = None,
    filed: DataFrame | None = None, asked: DataFrame | None = None,
) -> DataFrame:
    """Pairs ``q, norm, sig, score`` that hold the best k of every query and signature.

    ``queries(q)`` are distinct normalised texts; ``labels(norm, sig, rep)`` are distinct in
    (norm, sig), where ``rep`` is the first entity with that label, in the order in which equal scores rank. ``filed`` and
    ``asked`` are entries of a stored index for (at least) these labels and these queries.
    """
    groups = labels.groupBy("norm").agg(F.collect_list(F.struct("sig", "rep")).alias("groups"))
    if filed is None or asked is None:
        filed, asked = _indexed(queries, groups, threshold)
    named = groups.select("norm", F.col("groups.sig").alias("sigs"), F.col("groups.rep").alias("reps"))
    tiles = _tiles(filed, asked, threshold, tasks, named)
    bounded = tiles.mapInPandas(_bound_tiles(threshold, False, k, _score_of(contain)), "q string, norm string, bound double")
    pairs = bounded.join(groups, "norm")
    ordered = pairs.repartition("q").sortWithinPartitions("q", F.desc("bound"), "norm").select("q", "norm", "bound", "groups")
    return ordered.mapInPandas(_score_sorted(k, threshold, contain), "q string, norm string, sig string, score double")


def pair_report(queries: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """One row: pairs possible, pairs that the index brought together and that were bounded, and pairs kept for scoring."""
    texts, names = queries.select("q").distinct(), labels.select("norm").distinct()
    done = _tiles(*_indexed(texts, names, threshold), threshold, None).mapInPandas(_bound_tiles(threshold, True), "bounded bigint, kept bigint")
    sums = done.agg(F.coalesce(F.sum("bounded"), F.lit(0)).alias("bounded"), F.coalesce(F.sum("kept"), F.lit(0)).alias("kept"))
    return sums.select(F.lit(texts.count() * names.count()).alias("possible"), "bounded", "kept")


GRAM = 3
GRAM_ROWS = 50_000  # entries of one part of a gram; a gram of more entries is in several parts
POSTINGS = "gram string, hay_no bigint"


def _grams(text, n):
    """Distinct substrings of length n, null for shorter texts."""
    n = F.lit(n)
    positions = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(positions, lambda i: F.substring(text, i, n))))


def gram_postings(hays: DataFrame) -> DataFrame:
    """(gram, hay_no) for every character 1-, 2- and 3-gram of distinct texts (hay)."""
    every = F.flatten(F.array(*[F.coalesce(_grams(F.col("hay"), n), F.array().cast("array<string>")) for n in range(1, GRAM + 1)]))
    return hays.select(hay_number().alias("hay_no"), F.explode(every).alias("gram")).select("gram", "hay_no")


def hay_number():
    return F.xxhash64("hay")


def rarest_grams(needles: DataFrame, frequency: DataFrame) -> DataFrame:
    """(needle, gram, df): the gram of each needle that the fewest hays have; needles with a gram that none has are left out."""
    probe_size = F.least(F.length("needle"), F.lit(GRAM))
    probes = needles.select("needle", F.explode(_grams(F.col("needle"), probe_size)).alias("gram"))
    rarest = probes.join(frequency, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("g"))
    return rarest.filter("g.df > 0").select("needle", "g.gram", "g.df")


def looked_up(rarest: DataFrame, postings: DataFrame, hays: DataFrame) -> DataFrame:
    """(needle, hay) for needles filed under a gram, postings of (at least) these grams, and hays (hay_no, hay).

    A gram is in as many parts as its measured frequency asks for, so each needle is sent to one part of a rare
    gram and to all parts of a frequent one; parts are of bounded size. Two hays of one number would both be checked.
    """
    parts = F.ceil(F.col("df") / GRAM_ROWS)
    wanted = rarest.select("needle", "gram", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("share"))
    # At most one row for each GRAM_ROWS entries of the index.
    hot = rarest.filter(F.col("df") > GRAM_ROWS).select("gram", parts.alias("parts")).distinct()
    filed = postings.join(F.broadcast(hot), "gram", "left").select("gram", "hay_no", F.pmod("hay_no", F.coalesce("parts", F.lit(1))).alias("share"))
    pairs = wanted.join(filed, ["gram", "share"]).select("needle", "hay_no")
    return pairs.join(hays, "hay_no").filter(F.contains("hay", "needle")).select("needle", "hay")


def contained_pairs(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """``needle, hay`` for every hay that contains the needle; inputs are distinct, non-empty texts.

    Every hay is indexed by its grams; a needle is looked up under its rarest one. That turns the containment
    test into an equi join whose residual check is ``contains``. The index holds the number of a hay, not
    its text, which joins the pairs that are left. ``grams.GramIndex`` keeps such an index between searches.
    """
    index = gram_postings(hays)
    frequency = index.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    return looked_up(rarest_grams(needles, frequency), index, hays.select("hay", hay_number().alias("hay_no")))
