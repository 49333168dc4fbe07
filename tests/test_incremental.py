"""Linking by batches against a full run, and the versioned tables below it."""

import random

from pyspark.sql import functions as F

from kgspark.operators import incremental, linking, similarity
from kgspark.sources.versions import Versions
from test_linking import TEXTS, WORDS, norm

SCHEMA = "uri string, label string, norm string, type_names array<string>"


def label_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        types = rng.choice([["Disease"], ["Finding"], ["Disease", "Finding"], []])
        for _ in range(rng.choice([1, 2])):
            label = " ".join(rng.sample(WORDS, rng.choice([1, 2, 3]))) + rng.choice(["", " x", "-3"]) * (i % 3)
            rows.append((f"http://x/{seed}/{i:03d}", label, norm(label), types))
    rows += [(f"http://x/{seed}/long", "abc" * 70, "abc" * 70, ["Finding"]), (f"http://x/{seed}/none", "--", "", [])]
    return [r for i, r in enumerate(rows) if r not in rows[:i]]


def found(store_or_none, mentions, labels, k, threshold):
    linked = store_or_none.find_matches(mentions) if store_or_none else linking.find_matches(mentions, labels, k, threshold)
    return {r.text: [tuple(m) for m in r.kg_matches] for r in linked.collect()}


def test_batches_equal_a_full_run(spark, tmp_path):
    k, threshold = 3, 0.6
    store = incremental.MatchStore(spark, str(tmp_path / "store"), k, threshold)
    a, b, c = label_rows(1, 40), label_rows(2, 25), label_rows(3, 15)
    rng = random.Random(8)
    gone = rng.sample(a, 12)
    moved = [(u, lab, n, ["Procedure"]) for u, lab, n, _ in a if (u, lab) not in {g[:2] for g in gone} and u == a[20][0]]
    gone += [r for r in a if r[0] == a[20][0] and r not in gone]
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    texts = lambda rows: spark.createDataFrame([(t,) for t in rows], "text string")
    steps = [
        ("one", TEXTS[:8], a, []),
        ("two", TEXTS[6:12] + [None], b, gone),
        ("three", TEXTS[12:], c + moved, []),
        ("four", [], [], b[:5]),
    ]
    now, seen = [], []
    for name, new, added, removed in steps:
        assert store.apply(name, texts(new), df(added), df(removed))
        assert not store.apply(name, texts(TEXTS), df(c))
        now = [r for r in now if r not in removed] + added
        seen += [t for t in new if t is not None]
        assert {tuple(map(str, r)) for r in store.labels().collect()} == {tuple(map(str, r)) for r in now}
        mentions = texts(sorted(set(seen)))
        assert found(store, mentions, None, k, threshold) == found(None, mentions, df(now), k, threshold)
    before = found(store, mentions, None, k, threshold)
    assert store.compact("tidy") and found(store, mentions, None, k, threshold) == before
    assert store.store.live("matches") == [5] and store.apply("six", texts(["renal pain"]), df(a[:3]))
    assert "renal pain" in {r.q for r in store.matches().collect()}


def test_an_uncommitted_version_is_not_read(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "v"))
    rows = spark.createDataFrame([(1,), (2,)], "x int")
    assert store.begin("a") == 1 and store.rows("t", "x int").count() == 0
    store.put("t", 1, rows)
    assert store.rows("t", "x int").count() == 0  # broke off here
    assert store.begin("b") == 1
    store.put("t", 1, rows.filter("x = 1"))
    store.commit(1, "b", ["t"])
    assert store.begin("b") is None and [r.x for r in store.rows("t", "x int").collect()] == [1]
    assert store.begin("a") == 2


def test_index_brings_together_few_pairs_and_loses_none(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("etaoinshrdlucmfwypvbgkjqxz", range(26, 0, -1), k=rng.randint(3, 9)))
    texts = sorted({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(400)} | {"", "漢字テキスト", "漢字テキス", "é" * 30})
    labels = sorted({t[:-1] + rng.choice("xyz") for t in texts[::3] if t} | {" ".join(word() for _ in range(2)) for _ in range(600)} | {"", "x" * 80, "漢字"})
    q = spark.createDataFrame([(t,) for t in texts], "q string")
    heads = spark.createDataFrame([(t, "s", i) for i, t in enumerate(labels)], "norm string, sig string, rep bigint")
    for threshold in (0.5, 0.8):
        got = {(r.q, r.norm) for r in similarity.best_pairs(q, heads, len(labels), threshold).collect()}
        assert got == {(a, b) for a in texts for b in labels if similarity.link_score(a, b) >= threshold}
        report = similarity.pair_report(q, heads, threshold).first()
        assert len(got) <= report.kept <= report.bounded
    assert report.bounded < 0.5 * report.possible  # at 0.8; a pair is counted under every item it shares early


def test_a_block_of_many_characters_stays_small():
    rng = random.Random(2)
    labels = ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(12)) for _ in range(4000)]
    block = similarity._Block(labels)
    held = sum(mask.nbytes + (rows.nbytes if rows is not None else 0) for rows, mask in block.masks.values())
    assert held < 2_000_000
    assert block.bounds(labels[7])[7] == 1.0 and block.bounds(labels[7][::-1]).max() < 1.0
