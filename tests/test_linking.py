"""Linking against brute force with difflib."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from kgspark import vocab
from kgspark.operators import dictionary, linking, similarity


def norm(t):
    return " ".join(re.sub(r"[^a-z0-9\s]", "", t.lower()).split())


def local(uri):
    return uri.split("#")[-1].split("/")[-1]


WORDS = "acute chronic renal liver pain fever ring bolt mild severe scan left right cough 12 7".split()


def make_graph(seed=3, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        uri = f"http://x/{i:04d}"
        if i % 17 == 0:
            rows.append((uri, "http://x/p", "http://x/o"))
            continue
        for c in rng.sample(["Disease", "Finding", "Procedure", "Substance"], rng.choice([0, 1, 1, 2])):
            rows.append((uri, vocab.RDF_TYPE, vocab.TYPES + c))
        for p in rng.sample(vocab.LABEL_PREDICATES, rng.choice([1, 2, 3])):
            words = rng.sample(WORDS, rng.choice([1, 2, 3]))
            label = " ".join(words)
            if i % 11 == 0:
                label = label.title() + "-" + str(i % 3)
            if i % 23 == 0:
                label = (label + " ") * 12
            if i % 29 == 0:
                label = "abc" * 90
            rows.append((uri, p, label))
    rows.append(("http://x/empty", vocab.RDFS_LABEL, "--"))
    return rows


TEXTS = ["acute pain", "Acute  Pain!", "renal pian", "liver", "ring bolt", "ringbolt 12", "severe left", "xyzzy qq",
         "abc", "abc" * 70, "--", "", "mild chronic fever scan", "7", "cough fever pain " * 9, "rihgt cuogh"]


def brute(rows, text, k, min_score, etype=None):
    ents = {}
    for s, p, o in rows:
        e = ents.setdefault(s, ([], []))
        if p in vocab.LABEL_PREDICATES and o not in e[0]:
            e[0].append(o)
        if p == vocab.RDF_TYPE and o not in e[1]:
            e[1].append(o)
    q = norm(text)
    out = []
    for uri, (labels, types) in ents.items():
        allowed = vocab.ALLOWED_KG_TYPES.get(etype)
        if allowed and not any(local(t) in allowed for t in types):
            continue
        best, name = 0.0, ""
        for lab in sorted(labels):
            n = norm(lab)
            if n == q:
                s = 1.0
            else:
                s = SequenceMatcher(None, q, n).ratio()
                if q and n and (q in n or n in q):
                    s = max(s, min(len(q), len(n)) / max(len(q), len(n)))
            if s > best:
                best, name = s, lab
        if best >= min_score:
            out.append((uri, name, local(sorted(types)[0]) if types else None, best))
    out.sort(key=lambda m: (-m[3], m[0]))
    return out[:k]


@pytest.fixture(scope="module")
def graph(spark):
    rows = make_graph()
    t = spark.createDataFrame([(s, p, o) for s, p, o in rows], "s string, p string, o string")
    return rows, dictionary.label_table(dictionary.build_entity_dict(t)), t


@pytest.mark.parametrize("k,threshold,blocks", [(5, 0.7, None), (5, 0.6, 7), (10, 0.5, 3)])
def test_find_matches_is_brute_force(spark, graph, monkeypatch, k, threshold, blocks):
    rows, labels, _ = graph
    if blocks:
        monkeypatch.setattr(similarity, "LABELS_PER_BLOCK", blocks)
        monkeypatch.setattr(similarity, "QUERIES_PER_BLOCK", 2)
    m = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    got = {r.id: [tuple(x) for x in r.kg_matches] for r in linking.find_matches(m, labels, k, threshold).collect()}
    assert got == {i: brute(rows, t, k, threshold) for i, t in enumerate(TEXTS)}


def test_typed_fallback(spark, graph):
    rows, labels, _ = graph
    cases = [(i, t, e) for i, t in enumerate(TEXTS) for e in ("disease", "therapy", "score", "gadget")]
    m = spark.createDataFrame(cases, "id int, text string, entity_type string")
    got = {(r.id, r.entity_type): [tuple(x) for x in r.kg_matches] for r in linking.link_typed_fallback(m, labels).collect()}
    want = {(i, e): brute(rows, t, 5, 0.6, e) or brute(rows, t, 5, 0.6) for i, t, e in cases}
    assert got == want


def test_exact_matches(spark, graph):
    rows, labels, _ = graph
    m = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    got = {}
    for r in linking.find_matches_exact(m, labels).collect():
        got.setdefault(r.text, []).append((r["rank"], r.uri))
    for t in TEXTS:
        want = [x[0] for x in brute(rows, t, 5, 1.0)]
        assert [u for _, u in sorted(got.get(t, []))] == want


def test_search_entities(spark, graph):
    rows, labels, _ = graph
    qs = ["acute pain", "liver", "rihgt cuogh", "Ring", "abc", "--", "cough fever pain " * 9]
    got = {}
    for r in linking.search_entities(spark.createDataFrame([(q,) for q in qs], "query string"), labels, 6).collect():
        got.setdefault(r.query, []).append((r.uri, r.score))
    ents = {}
    for s, p, o in rows:
        if p in vocab.LABEL_PREDICATES:
            ents.setdefault(s, set()).add(o)
    for q in qs:
        nq = norm(q)
        if not nq:
            assert q not in got
            continue
        ratio = lambda n: 1.0 if n == nq else SequenceMatcher(None, nq, n).ratio()
        first, second = {}, {}
        for uri, labs in ents.items():
            hit = [norm(x) for x in sorted(labs) if norm(x) and (nq in norm(x) or norm(x) in nq)]
            if hit:
                first[uri] = ratio(hit[0])
            elif max(ratio(norm(x)) for x in labs) >= 0.5:
                second[uri] = max(ratio(norm(x)) for x in labs)
        found = dict(first)
        if len(first) < 6:
            found.update(second)
        want = sorted(found.items(), key=lambda x: (-x[1], x[0]))[:6]
        have = sorted(got.get(q, []), key=lambda x: (-x[1], x[0]))
        assert [u for u, _ in have] == [u for u, _ in want]
        assert [s for _, s in have] == pytest.approx([s for _, s in want])


def test_contains_search_and_merge(spark, graph):
    rows, labels, t = graph
    texts = spark.createDataFrame([(x,) for x in TEXTS], "text string")
    hits = linking.contains_search(texts, t, 5, 0.5)
    got = {}
    for r in hits.collect():
        got.setdefault(r.text, []).append((r.uri, round(r.score, 9)))
    names = {(s, o) for s, p, o in rows if p in vocab.LABEL_PREDICATES}
    for x in TEXTS:
        best = {}
        for s, o in names:
            if norm(x) and x.lower() in o.lower():
                v = similarity.link_score(norm(x), norm(o))
                if v >= 0.5:
                    best[s] = max(best.get(s, 0), v)
        want = sorted(best.items(), key=lambda y: (-y[1], y[0]))[:5]
        assert sorted(got.get(x, []), key=lambda y: (-y[1], y[0])) == [(u, round(v, 9)) for u, v in want]
    merged = linking.merge_matches([hits, linking.find_matches_exact(texts, labels)], ["text"])
    assert merged.filter("score = 1.0").count() >= hits.filter("score = 1.0").count()


def test_status_bands(spark):
    scores = [0.95, 0.9499, 0.70, 0.6999, 0.60, None]
    rows = [(i, [] if s is None else [("u", "lab", "T", s)]) for i, s in enumerate(scores)]
    from kgspark.schemas import MATCHES
    df = spark.createDataFrame(rows, f"id int, kg_matches {MATCHES}")
    got = [r.validation_status for r in linking.validate_status(df).orderBy("id").collect()]
    assert got == ["exact_match", "similar_match", "similar_match", "low_match", "low_match", "not_found"]


def test_contained_pairs(spark):
    rng = random.Random(5)
    needles = sorted({"".join(rng.choices("abc ", k=rng.randint(1, 5))) for _ in range(60)})
    hays = sorted({"".join(rng.choices("abc ", k=rng.randint(1, 9))) for _ in range(80)})
    got = similarity.contained_pairs(
        spark.createDataFrame([(x,) for x in needles], "needle string"),
        spark.createDataFrame([(x,) for x in hays], "hay string"),
    ).collect()
    assert sorted(map(tuple, got)) == sorted((n, h) for n in needles for h in hays if n in h)


def test_bound_is_never_below_score():
    rng = random.Random(11)
    labels = ["".join(rng.choices("abcde 12", k=rng.randint(0, 80))) for _ in range(300)] + ["a" * 64, "", "ab" * 32]
    block = similarity._Block(labels)
    for _ in range(60):
        q = "".join(rng.choices("abcde 12", k=rng.randint(0, 90)))
        b = block.bounds(q)
        for i, lab in enumerate(labels):
            assert similarity.link_score(q, lab) <= b[i] + 1e-9


def test_ratio_is_difflib():
    rng = random.Random(23)
    for _ in range(20000):
        letters = rng.choice(["ab", "abc ", "abcdefgh 12"])
        a, b = ("".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(2))
        assert similarity.ratio(a, b) == SequenceMatcher(None, a, b).ratio(), (a, b)
    for n in (199, 200, 201, 300):
        a, b = "".join(rng.choices("abc", k=n)), "".join(rng.choices("abc", k=n))
        assert similarity.ratio(a, b) == SequenceMatcher(None, a, b).ratio()
    assert similarity.ratio("abcd", "bcde") == 0.75


def test_contained_pairs_with_a_needle_in_every_hay(spark):
    hays = [f"r{i} text{i % 7}" for i in range(300)]
    needles = ["r", "t", "xt3", "r29", "zz", "r1 text1", "é"]
    got = similarity.contained_pairs(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(h,) for h in hays], "hay string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((n, h) for n in needles for h in hays if n in h)


def test_near_equal_labels_stay_in_their_block(spark, monkeypatch):
    """Of hundreds of labels that all reach the threshold only those leave a block that can be among the best."""
    monkeypatch.setattr(similarity, "LABELS_PER_BLOCK", 900)
    labels = [f"supplier{i:09d}" for i in range(0, 20000, 10)]
    kinds = lambda i: ["A", "B"] if i % 7 == 0 else ["C"] if i % 1900 == 0 else ["A"]
    heads = [(x, s, i // 2) for i, x in enumerate(labels) for s in kinds(i)]
    texts = labels[::100] + ["supplier00000001", "supplier99"]
    q = spark.createDataFrame([(t,) for t in texts], "q string")
    rows = spark.createDataFrame(heads, "norm string, sig string, rep bigint")
    k, threshold = 3, 0.7
    pairs = similarity.best_pairs(q, rows, k, threshold)
    got = {(r.q, r.norm, r.sig, round(r.score, 9)) for r in pairs.collect()}
    for t in texts:
        for sig in "ABC":
            scored = [(similarity.link_score(t, x), rep, x) for x, s, rep in heads if s == sig]
            best = {}
            for value, rep, _ in scored:
                best[rep] = max(value, best.get(rep, 0.0))
            first = sorted(best, key=lambda rep: (-best[rep], rep))[:k]
            want = {(t, x, sig, round(value, 9)) for value, rep, x in scored if rep in first and value == best[rep] >= threshold}
            assert want <= got, (t, sig)
    assert got <= {(t, x, s, round(similarity.link_score(t, x), 9)) for t in texts for x, s, _ in heads}
    possible = similarity.pair_report(q, rows, threshold).first().kept
    assert possible > 0.8 * len(texts) * len(labels)
    groups = rows.where("sig = 'A'").select("norm", F.array("sig").alias("sigs"), F.array("rep").alias("reps"))
    tiles = similarity._tiles(*similarity._indexed(q, groups, threshold), threshold, 4, groups)
    left = tiles.mapInPandas(similarity._bound_tiles(threshold, False, k, similarity.link_score), "q string, norm string, bound double").count()
    assert left < 0.2 * possible
