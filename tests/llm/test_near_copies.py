"""N-gram Jaccard join, exact dedup and embedding links against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from kgspark.llm import components as components_module
from kgspark.llm import embeddings, exact_dedup, jaccard
from kgspark.llm.components import components


def roots(ids, links):
    least = {i: i for i in ids}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        least[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def corpus():
    random.seed(5)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(random.choices(words, k=random.choice((1, 4, 5, 6, 30, 120, 400)))) for _ in range(60)]
    common = " ".join(random.choices(words, k=60))
    for base in list(texts[:25]):
        for _ in range(6):
            copy = base.split()
            for _ in range(random.randrange(1 + len(copy) // 25)):
                copy[random.randrange(len(copy))] = random.choice(words)
            texts.append(" ".join(copy))
    base = random.choices(words, k=150)
    for k in range(80):  # a large group of near copies, of which far ones link only through others
        copy = list(base)
        for _ in range(k // 8):
            copy[random.randrange(len(copy))] = random.choice(words)
        texts.append("\t".join(copy).upper())
    texts += [common + " " + " ".join(random.choices(words, k=80)) for _ in range(30)]
    texts += [None, "", " \n\t", "one", "ONE", "one two three", "é è ê ë ü", "É è ê ë ü", " ".join(random.choices(words, k=20000))]
    return list(enumerate(texts))


def test_jaccard_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)  # hot tiles of several parts
    rows = corpus()
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    expected = roots(sets, links)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {i: (len(s), expected[i]) for i, s in sets.items()}


def test_jaccard_repeated_rows_and_empty_table(spark):
    text = "a b c d e f g h"
    docs = spark.createDataFrame([(3, text), (3, text), (2, text), (None, text), (1, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard.jaccard_components(docs).collect())
    assert got == [(0, 2), (1, 1), (2, 2), (3, 2), (3, 2)]
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_shingles_do_not_depend_on_slices(monkeypatch):
    texts = [t for _, t in corpus()] + ["x" * 500 + " y z", "é" * 300]
    whole = [s.tolist() for s in jaccard.Shingler().sets(pa.array(texts))]
    monkeypatch.setattr(jaccard, "SLICE", 64)
    assert [s.tolist() for s in jaccard.Shingler().sets(pa.array(texts))] == whole
    assert [len(s) for s in whole] == [len(shingles(t)) for t in texts]


def test_a_word_longer_than_two_slices_leaves_the_words_around_it(monkeypatch):
    short = " ".join(f"w{i}" for i in range(40))
    texts = [f"{a}{x}{b}{y}{c}" for x in ("q" * 130, "q" * 700) for y in ("z" * 129, "z" * 400) for a in ("", " ", "\n \t", short + " ", short + "  ") for b in (" ", f" {short} ", "\t\t") for c in ("", " ", " " + short)]
    whole = [s.tolist() for s in jaccard.Shingler().sets(pa.array(texts))]
    assert [len(s) for s in whole] == [len(shingles(t)) for t in texts]
    monkeypatch.setattr(jaccard, "SLICE", 64)
    assert [s.tolist() for s in jaccard.Shingler().sets(pa.array(texts))] == whole


def test_component_rounds_have_as_many_partitions_as_their_edges_need(spark, monkeypatch):
    rounds, keep = [], components_module.checkpoint

    def counted(df):
        rounds.append(kept := keep(df))
        return kept

    monkeypatch.setattr(components_module, "checkpoint", counted)
    monkeypatch.setattr(components_module, "EDGES", 100)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(held, ("16", "false"), strict=True):
            spark.conf.set(k, v)
        edges = [(k, k + 1) for k in range(0, 300, 2)] + [(k, 500) for k in range(0, 300, 2)]
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == {x: 0 for x in [*range(300), 500]}
    assert len(rounds) > 1 and all(r.rdd.getNumPartitions() <= 3 for r in rounds[1:])


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}


def exact_expected(rows):
    plain = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = {}
    for i, t in plain:
        groups.setdefault(t, []).append(i)
    return sorted((i, min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in plain)


def test_exact_groups_equal_brute_force(spark):
    random.seed(2)
    rows = [(i, random.choice(["a  b", "a b", "a\tb", "", None, "x" * 100_000, "é", f"only {i}"])) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "z", "q") for i, t in rows], "doc_id long, text string, digest string, size string")
    assert sorted(tuple(r) for r in exact_dedup.groups_of(docs.select("doc_id", "text")).collect()) == exact_expected(rows)
    kept = exact_dedup.kept_rows(docs.select("doc_id", "text"))
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, keep, *_ in exact_expected(rows) if i == keep]


def test_exact_dedup_ties_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    assert sorted((r.doc_id, r.group_size, r.kept) for r in exact_dedup.groups_of(docs).collect()) == [(1, 3, True), (1, 3, True), (2, 3, False), (3, 1, True)]
    assert sorted(r.doc_id for r in exact_dedup.kept_rows(docs).collect()) == [1, 3]
    assert exact_dedup.groups_of(docs.limit(0)).count() == 0


def test_rows_without_ids_are_dropped_as_copies(spark):
    rows = [(None, "a"), (None, "a"), (None, "b"), (5, "b"), (None, "c"), (None, "d"), (None, "d"), (6, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in exact_dedup.kept_rows(docs).collect()) == [(0, "a"), (0, "c"), (5, "b"), (6, "d")]


def test_digest_collisions_are_split_by_bytes(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "sha2", lambda column, bits: F.lit("same"))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    got = sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.groups_of(docs).collect())
    assert got == [(1, 1, 2), (2, 2, 1), (3, 1, 2)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 30000])
def test_fuse_filter_has_no_false_negative(n):
    random_ = np.random.default_rng(n)
    keys = random_.integers(0, 1 << 63, n).astype(np.uint64)
    made = exact_dedup.FuseFilter.build(keys)
    assert made.maybe(keys).all()
    assert made.maybe(random_.integers(0, 1 << 63, 20000).astype(np.uint64)).mean() < 0.02


def vectors():
    random_ = np.random.default_rng(1)
    out = []
    for group in range(30):
        base = random_.standard_normal(64)
        for _ in range(random_.integers(1, 12)):
            out.append((group % 3, (base + random_.standard_normal(64) * 0.13).astype(np.float32).tolist()))
    base = random_.standard_normal(64)
    out += [(7, (base + random_.standard_normal(64) * 0.1).astype(np.float32).tolist()) for _ in range(90)]
    return out


def test_embedding_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 20)
    rows = [(i, v, label) for i, (label, v) in enumerate(vectors())]
    units = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    labels = {i: label for i, _, label in rows}
    links = [(a, b) for a in units for b in units if a < b and labels[a] == labels[b] and units[a] @ units[b] >= 0.98]
    odd = [(1000, None, 1), (1001, [0.0] * 64, 1), (1002, [math.nan] * 64, 1), (1003, [math.inf] + [0.0] * 63, 1), (1004, rows[0][1], None), (1005, [], 1), (1006, [None] + [1.0] * 63, 0), (1007, [1.0, 2.0], 0), (1008, [2.0, 4.0], 0)]
    table = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<float>, label int, filters string")
    got = {r.vec_id: r for r in embeddings.linked(table).collect()}
    links.append((1007, 1008))
    expected = roots([r[0] for r in rows + odd], links)
    found = sum(r.n_links for r in got.values())
    assert 0.99 * 2 * len(links) <= found <= 2 * len(links)
    degrees = {i: sum(i in p for p in links) for i in expected}
    assert all(r.n_links <= degrees[i] for i, r in got.items())
    assert sum(got[i].component_id == c for i, c in expected.items()) >= 0.97 * len(expected)
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    assert embeddings.linked(table.limit(0)).count() == 0


def test_a_repeated_vector_id_is_one_vector(spark):
    v = [1.0] * 8
    table = spark.createDataFrame([(1, v, 0), (1, v, 0), (2, v, 0)], "vec_id long, embedding array<float>, label int")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.linked(table).collect()) == [(1, 1, 1), (1, 1, 1), (2, 1, 1)]
