"""Texts and what belongs to them are worked on a few at a time."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kgspark.operators import decode as C, prepare as P, similarity as S, streams
from kgspark.sources import documents as D

TEXTS = [(1, "Ab cd ab ce. " * 3), (2, "x y"), (2, "z y x"), (None, "ab"), (3, None)]
MENTIONS = [(1, i, w) for i, w in enumerate(["AB", "ce", "ab", "nix", None, "cd"] * 3)] + [(2, 0, "x"), (2, 1, "z"), (2, 2, "q"), (None, 0, "ab"), (3, 0, "ab"), (4, 0, "ab")]


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    yield spark.createDataFrame(TEXTS, "doc_id bigint, body string"), spark.createDataFrame(MENTIONS, "doc_id bigint, ord bigint, text string")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_mentions_in_several_batches_repeated_and_null_keys(small_batches):
    texts, mentions = small_batches
    out = C.locate_mentions(mentions, texts, ["doc_id"])
    assert "collect_" not in plan(out)
    want = []
    for doc, ord_, text in MENTIONS:
        bodies = [b for d, b in TEXTS if d == doc and None not in (d, b, text)]
        at = [(b.lower().find(text.lower()), b) for b in bodies if text.lower() in b.lower()]
        want += [(doc, ord_, text, a, a + len(text), C._window(b, a, a + len(text), C.MENTION_MARGIN)) for a, b in at] or [(doc, ord_, text, None, None, None)]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)


def test_occurrences_in_several_batches(small_batches):
    texts, mentions = small_batches
    out = C.assign_occurrences(mentions.where("doc_id = 1"), texts)
    assert "collect_" not in plan(out)
    body, used, want = TEXTS[0][1].lower(), set(), {}
    for _, ord_, text in MENTIONS[:18]:
        free = [i for i in range(len(body)) if text and body.startswith(text.lower(), i) and i not in used]
        want[ord_] = free[0] if free else None
        used |= set(free[:1])
    assert {r["ord"]: r["start"] for r in out.collect()} == want


def test_relations_and_spans_come_as_rows(small_batches):
    texts, mentions = small_batches
    pairs = mentions.select("doc_id", F.col("text").alias("source_entity"), F.lit("AB").alias("target_entity"))
    related = C.locate_relations(pairs, texts, ["doc_id"])
    assert "collect_" not in plan(related) and related.count() == len(MENTIONS) and related.where("context IS NOT NULL").count() == 12
    spans = mentions.where("doc_id IN (1, 2)").select("doc_id", F.lit(1).alias("start"), F.lit(2).alias("end"))
    cut = C.slice_texts(spans, texts)
    assert "collect_" not in plan(cut)
    assert sorted(map(tuple, cut.collect())) == sorted([(1, 1, 2, "b")] * 18 + [(2, 1, 2, " ")] * 6)


@pytest.mark.parametrize("work", [P._token_table, P._sentence_rows, None])
def test_batches_of_documents_are_worked_on_in_pieces(work):
    texts = ["One two. Three\nfour " * 20_000, "", None if work else "", "a b. c", "word " * 300_000]
    batch = pa.record_batch({"doc_id": pa.array(range(5), pa.int64()), "text": texts})
    run = streams.in_pieces(work) if work else P._chunker(2000, 200)
    parts = list(run(iter([batch])))
    assert len(parts) == 2 and pa.Table.from_batches(parts).num_rows > 0
    assert set(pa.Table.from_batches(parts)["doc_id"].to_pylist()) <= {0, 3, 4}


def test_bad_bytes_are_decoded_in_pieces(spark):
    rows = spark.range(40).select("id", F.concat(F.unhex(F.lit("FF")), F.repeat(F.lit("é"), 50_000).cast("binary")).alias("c"))
    read = rows.select("id", D.decoded(F.col("c")).alias("t"))
    assert read.where(F.col("t") == F.repeat(F.lit("é"), 50_000)).count() == 40
    assert [n for _, n in streams.pieces(pa.array([b"x" * 400_000] * 5))] == [2, 2, 1]


def test_tiles_hold_a_row_per_text(spark):
    labels = spark.createDataFrame([("abcd",), ("abce",), ("xyz",)], "norm string")
    queries = spark.createDataFrame([("abcd",), ("xyzz",)], "q string")
    tiles = S._tiles(*S._indexed(queries, labels, 0.7), 0.7, 2)
    assert "array<struct" not in tiles.schema.simpleString() and "collect_" not in plan(tiles)
    got = tiles.mapInPandas(S._bound_tiles(0.7, False), "q string, norm string, bound double").collect()
    assert {(r["q"], r["norm"]) for r in got} == {("abcd", "abcd"), ("abcd", "abce"), ("xyzz", "xyz")}


def test_sides_that_are_dealt_by_the_key_already(spark):
    texts = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("ab cd").alias("body")).repartition("doc_id")
    spans = spark.range(2000).select((F.col("id") % 200).alias("doc_id"), (F.col("id") % 3).alias("start")).groupBy("doc_id", "start").count()
    spans = spans.groupBy("doc_id").agg(F.min("start").cast("int").alias("start")).withColumn("end", F.lit(5))
    out = C.slice_texts(spans, texts)
    assert out.count() == 200 and {r["text"] for r in out.collect()} == {"ab cd"}


def test_blocks_hold_rows_of_any_type():
    r = random.Random(1)
    pick = lambda values, kind: pa.array([r.choice(values) for _ in range(500)], kind)
    batch = pa.record_batch({
        "a": pick([None, 2**40, -2**40], pa.int64()), "b": pa.array(range(500), pa.int32()), "c": pick([-2**63, 2**63 - 1, 0], pa.int64()),
        "d": pick([None, "", "ab", "é漢" * 9], pa.string()), "e": pa.nulls(500, pa.string()), "f": pick([0.5, None], pa.float64()),
        "g": pick([[("k", "v")], [], None], pa.map_(pa.string(), pa.string())), "h": pick([True, None], pa.bool_())})
    for rows in (batch, batch.slice(37, 400)):
        runs = [(0, 16), (16, 17), (30, rows.num_rows)]
        for (start, end), block in zip(runs, streams._encoded(rows, runs)):
            got = streams._decoded(pa.py_buffer(block), rows.schema, pa.Codec("zstd"))
            got.validate(full=True)
            assert got.to_pylist() == rows.slice(start, end - start).to_pylist()


@pytest.mark.parametrize("order", [[], ["ord"]])
def test_packed_rows_come_back_in_order(spark, order):
    """Rows of a key that lie together, some of several partitions that overlap, few ones, and null keys and orders."""
    r = random.Random(2)
    rows = [(None if i % 9 == 0 else i % 5, None if i % 50 == 3 else i // 3, f"w{r.randrange(30)}") for i in range(3000)]
    rows = sorted(rows, key=lambda x: str(x[0])) + [(100 + i, 1, "few") for i in range(200)]
    df = spark.createDataFrame(rows, "key bigint, ord int, text string").repartition(3).sortWithinPartitions("key").withColumn("more", F.length("text"))
    sent = streams.packed(df, ["key"], order, ["more"])
    assert sent.count() < 700 and sent.where("_block IS NOT NULL").count() == 18
    back = sent.repartition(F.xxhash64("key")).sortWithinPartitions("key", *order).withColumn("more", F.length("text")).select("key", "ord", "text", "more", "_block")
    flat = back.mapInArrow(lambda batches: streams.unpacked(batches, ["key"], order, ["ord", "text", "more"]), df.schema)
    got = [tuple(x) for x in flat.collect()]
    assert sorted(got, key=repr) == sorted([(*x, len(x[2])) for x in rows], key=repr)
    if order:
        for key in {x[0] for x in rows}:
            turns = [(x[1] is not None, x[1] or 0) for x in got if x[0] == key]
            assert turns == sorted(turns)


def test_tokens_travel_in_blocks(spark):
    docs = spark.createDataFrame([(i, "one two three four five " * 40) for i in range(20)], "doc_id bigint, text string")
    t = P.tokenize_spans(docs).select("doc_id", "pos", "start", "end", F.col("token").alias("text"))
    spans = t.select("doc_id", F.col("pos").alias("ord"), "start", "end", F.lit("disease").alias("entity_type"))
    texts = docs.withColumnRenamed("text", "body")
    for out in (C.locate_mentions(t, texts, ["doc_id"]), C.tag_iob(t.drop("text"), spans),
                C.assign_occurrences(t.select("doc_id", F.col("pos").alias("ord"), "text"), texts)):
        assert "_block" in plan(out) and "Join" not in plan(out) and out.count() == 4000


def test_occurrences_of_equal_and_null_orders(spark):
    """Rows of one order share what they are given, also those without a text; null orders take starts and get none."""
    rows = [(1, 0, "a"), (1, 1, "a"), (1, 1, None), (1, 1, "b"), (1, None, "a"), (1, 2, "a"), (1, 3, None), (None, 0, "a"), (2, 0, "a")]
    ex = spark.createDataFrame(rows, "doc_id bigint, ord bigint, text string")
    texts = spark.createDataFrame([(1, "a a a b a"), (None, "a")], "doc_id bigint, body string")
    got = sorted((tuple(r) for r in C.assign_occurrences(ex, texts).select("doc_id", "ord", "text", "start").collect()), key=repr)
    want = [(1, 0, "a", 2), (1, 2, "a", 8), (1, 3, None, None), (None, 0, "a", None), (2, 0, "a", None), (1, None, "a", None)]
    want += [(1, 1, text, start) for text in ("a", None, "b") for start in (4, 6)]
    assert got == sorted(want, key=repr)


def test_first_entities_of_chunks_with_repeated_starts_and_null_documents(small_batches, spark):
    r = random.Random(3)
    rows = [(r.choice([None, 1, 2, 3]), r.choice([None, 0, 1, 2]), i, r.choice(["Ab", "aB", "cd", None]), r.choice(["x", None]), i, None if i % 7 == 0 else i + 2) for i in range(300)]
    rows += [(5, c, i, f"w{i % 30}", "x", i, i + 2) for c in (0, 1) for i in range(100)]
    starts = [(1, 0, 100), (1, 0, 200), (2, 1, None), (3, 2, 300), (None, 0, 400), (5, 1, 50)]
    cols = "chunk_index int, pos int, text string, entity_type string, start_position int, end_position int"
    e, chunks = spark.createDataFrame(rows, f"doc_id bigint, {cols}"), spark.createDataFrame(starts, "doc_id bigint, chunk_index int, start_char int")
    first = {}
    for row in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2])):
        first.setdefault((row[0], row[3] and row[3].lower(), row[4]), row)
    plus = lambda a, b: None if a is None else a + b
    moved = [(*x[:5], plus(x[5], m or 0), plus(x[6], m or 0)) for x in first.values()
             for m in [s for d, c, s in starts if None not in (x[0], x[1]) and (d, c) == x[:2]] or [0]]
    for shift, want in ((True, moved), (False, first.values())):
        out = C.merge_chunk_entities(e, chunks, shift)
        assert "Join" not in plan(out) and "Aggregate" not in plan(out)
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_pieces_take_the_labels_of_their_words(small_batches, spark):
    r = random.Random(4)
    words = [(d, w, r.choice([None, 3, 4])) for d in (None, 1, 2) for w in (None, *range(20)) for _ in range(r.choice([0, 1, 1, 2]))]
    pieces = []
    for d in (None, 1, 2, 3):
        word = 0
        for pos in range(60):
            word += r.choice([0, 0, 1])
            pieces.append((d, pos, None if r.random() < 0.1 else word))
    out = C.align_subword_labels(spark.createDataFrame(pieces, "doc_id bigint, pos int, word_id int"),
                                 spark.createDataFrame(words, "doc_id bigint, word_id bigint, label_id int"), ["doc_id"])
    assert "Join" not in plan(out) and "Window" not in plan(out)
    want, before = [], {}
    for d, pos, word in pieces:
        first = word is not None and before.get(d) != word
        before[d] = word
        labels = [-100 if x is None else x for e, w, x in words if first and d is not None and (e, w) == (d, word)] or [-100]
        want += [(d, pos, word, x) for x in labels]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("number", ["int", "bigint"])
def test_labelled_tokens_travel_as_few_numbers(spark, number):
    """Marks and offsets, also null and negative ones, are what they were behind the shuffle."""
    rows = [(1, 0, -5, 2, "", "ab", "B-x", False), (1, 1, 2, 6, "", "cd", "I-x", None), (1, 2, 9, 9, " ", "e", "B-x", False), (1, 3, None, 12, " ", "f", "B-x", True),
            (1, 4, 12, 14, None, "gh", "B-x", False), (1, 5, 20, 2**31 - 1, " ", "i j", "B-y", False), (1, 6, 21, None, " ", "k", "B-y", False)]
    preds = spark.createDataFrame(rows, f"doc_id bigint, idx int, start {number}, end {number}, gap string, token string, label string, is_subword boolean")
    out = C.decode_bio(preds)
    assert sorted((r["start"], r["end"], r["entity_type"]) for r in out.collect()) == [(-5, 14, "x"), (20, 2**31 - 1, "y")]
    assert out.schema["start"].dataType == preds.schema["start"].dataType
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    sent = re.findall(r"\) Exchange\s*\nInput \[(\d+)\]", out._jdf.queryExecution().explainString(mode))
    assert sent and max(map(int, sent)) <= 6
