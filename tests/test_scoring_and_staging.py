"""Scorecard thresholds, batch rules of the staging tables, and the registry."""

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kgspark.operators import growth as W, reviews as R, scorecards as C, staging as S
from kgspark.schemas import MATCHES

E, L = C.EntityConfig(), C.RelationConfig()


def test_entity_decision_thresholds(spark):
    cases = [(0.9, 0.5, 0.39, True, None, "failed"), (0.9, 0.5, 0.40, True, None, "passed"), (0.9, 0.5, 1.0, False, None, "failed"),
             (0.75, 0.5, 1.0, True, None, "passed"), (0.749, 0.5, 1.0, True, False, "verify_type"), (0.749, 0.96, 1.0, True, None, "check_duplicate"),
             (0.5, 0.5, 1.0, True, True, "manual_review"), (0.249, 0.5, 1.0, True, None, "failed"), (0.25, 0.5, 1.0, True, None, "needs_review")]
    df = spark.createDataFrame(cases, "o double, g double, c double, t boolean, a boolean, want string")
    got = df.select("want", C.entity_decision(F.col("o"), F.col("g"), F.col("c"), F.col("t"), F.col("a"), E).alias("d")).collect()
    assert all(r.want in (r.d.review_status, r.d.recommendation) for r in got)


def test_constraint_rules(spark):
    # "--" breaks two rules: it is a symbol, and it has only digits, blanks and ".,-".
    texts = {"x": ("disease", 0.5), "--": ("disease", 0.3), "12.5": ("disease", 0.8), "<tag>": ("disease", 0.75),
             "male patients with cough": ("finding", 0.75), "the": ("substance", 0.75), "rash": ("gadget", 0.7), "fever": ("symptom", 1.0)}
    df = spark.createDataFrame([(t, k, w) for t, (k, w) in texts.items()], "text string, kind string, want double")
    for r in df.select("*", C.entity_constraint(F.col("text"), F.col("kind"), E).alias("c")).collect():
        assert r.c.score == pytest.approx(r.want), r
        assert (r.c.score == 1.0) == (not r.c.violations)


def test_coverage_and_consistency(spark):
    m = lambda *s: [("u", "l", "T", x) for x in s]
    df = spark.createDataFrame([(0, m(), 0.8), (1, m(0.79), 0.71), (2, m(0.8, 0.6), 0.5), (3, m(1.0, 0.9, 0.5), 0.3), (4, m(0.5, 0.5, 0.5), 0.45)], f"i int, k {MATCHES}, want double")
    for r in df.select("want", C.entity_coverage(F.col("k"), E)["score"].alias("s")).collect():
        assert r.s == pytest.approx(r.want)
    rows = [("a", "disease", 0.5, "disease", 0.5, False, 0.65), ("b", "disease", 0.5, "organ", 0.4, False, 0.41), ("c", "disease", 0.5, None, None, False, 0.4), ("d", "disease", 0.5, "organ", 0.4, True, 0.45)]
    df = spark.createDataFrame(rows, "i string, k string, c double, s string, sc double, f boolean, want double")
    for r in df.select("want", C.entity_consistency(F.col("k"), F.col("c"), E, F.col("s"), F.col("sc"), F.col("f"))["score"].alias("x")).collect():
        assert r.x == pytest.approx(r.want)


def test_relation_parts_and_config(spark):
    df = spark.createDataFrame([("substance", "treats", "disease"), ("disease", "treats", "substance"), ("disease", "odd", "organ")], "s string, r string, t string")
    got = [r[0] for r in df.select(C.relation_congruence(F.col("s"), F.col("r"), F.col("t"), L)).collect()]
    assert got == pytest.approx([0.9, 0.0, 0.2])
    rel = C.relation_constraint(F.lit("a b"), F.col("s"), F.col("r"), F.lit("A B "), F.col("t"), F.lit(0.2), F.lit(None).cast("string"), L)
    assert [r[0] for r in df.select(rel).collect()] == pytest.approx([0.45, 0.2, 0.15])
    with pytest.raises(ValueError):
        C.EntityConfig(pass_at=0.4)
    with pytest.raises(ValueError):
        C.RelationConfig(weights={"congruence": 2.0})


def test_staging_is_first_wins(spark):
    new = spark.createDataFrame([(1, "a", "x", "low_match", "c" * 600), (2, "a", "x", "not_found", None), (3, "A", "x", "not_found", None),
                                 (4, "b", "x", "exact_match", None), (5, "p", "x", None, None), (6, "q", "x", None, None)],
                                "id int, text string, entity_type string, validation_status string, context string")
    table = spark.createDataFrame([("p", "x", "pending"), ("q", "x", "approved")], "text string, entity_type string, status string")
    got = {r.id: r for r in S.stage_entities(new, table, ["id"]).collect()}
    assert sorted(got) == [1, 3, 5 + 1] and len(got[1].context) == 500
    with pytest.raises(ValueError):
        S.list_page(new, S.Listing(page_size=201), [])


@pytest.mark.parametrize("down", [True, False])
def test_pages_by_key_range_are_the_pages_by_number(spark, down):
    rows = spark.createDataFrame([(i, [None, 1.0, 2.0][i % 3]) for i in range(50)], "id int, score double")
    first = S.list_page(rows, S.Listing(sort_by="score", descending=down, page_size=7), ["score"]).collect()
    for page in range(2, 9):
        want = S.list_page(rows, S.Listing(sort_by="score", descending=down, page=page, page_size=7), ["score"]).collect()
        first = S.list_after(rows, S.Listing(sort_by="score", descending=down, page_size=7), ["score"], first[-1].score, first[-1].id).collect()
        assert first == want


def test_uris_are_reused(spark):
    t = spark.createDataFrame([("http://b", "http://www.w3.org/2000/01/rdf-schema#label", "Asthma", "literal"), ("http://a", "http://www.w3.org/2000/01/rdf-schema#label", "Asthma", "literal")], "s string, p string, o string, o_kind string")
    rel = spark.createDataFrame([(1, "Asthma", "disease", "affects", "left lung", "organ"), (2, "left lung", "score", "affects", "Asthma", "organ")],
                                "id int, source_entity string, source_type string, relation_type string, target_entity string, target_type string")
    got = {(r.s, r.p.rsplit("/", 1)[-1].rsplit("#", 1)[-1], r.o.rsplit("/", 1)[-1]) for r in W.emit_relation_triples(rel, t, 5).collect()}
    lung = next(s for s, p, _ in got if p == "label")
    assert lung.startswith("http://example.org/medical/left_lung_5_")
    assert got == {("http://a", "affects", lung.rsplit("/", 1)[-1]), (lung, "affects", "a"), (lung, "label", "left lung"), (lung, "type", "Organ")}


def test_uris_of_different_entities_differ(spark):
    texts = [("chest pain", "symptom"), ("chest-pain", "disease"), ("胸痛痛痛痛", "symptom"), ("頭痛痛痛痛", "symptom"), ("chest pain", "disease")]
    e = spark.createDataFrame(texts, "text string, entity_type string")
    made = W.emit_entity_triples(e, 5).filter("o_kind = 'literal'").collect()
    assert len({r.s for r in made}) == len(made) == 5
    assert sorted(r.s for r in W.emit_entity_triples(e, 5).filter("o_kind = 'literal'").collect()) == sorted(r.s for r in made)


def test_edits_of_one_batch_see_each_other(spark):
    p = spark.createDataFrame([(1, "a", "x", None, "pending"), (2, "b", "x", None, "pending"), (3, "c", "y", None, "pending")],
                              "id int, text string, entity_type string, normalized_text string, status string")
    r = spark.createDataFrame([], "pending_entity_id int, entity_text string, entity_type string")
    e = spark.createDataFrame([(1, "z", None, None, None), (2, "z", None, None, None), (3, "a", "x", None, None)], p.schema)
    got, _, conflicts = S.apply_edits(p, r, e)
    assert sorted((x.id, x.text, x.entity_type) for x in got.collect()) == [(1, "z", "x"), (2, "b", "x"), (3, "a", "x")]
    assert sorted(x.id for x in conflicts.collect()) == [2]


def one_by_one(pending, reviews, edits):
    """The edits as a loop over rows."""
    pending, reviews, rejected = {i: [t, k] for i, t, k in pending}, [list(r) for r in reviews], set()
    same = lambda a, b: None not in (*a, *b) and list(a) == list(b)
    for i, text, kind in sorted(edits):
        if i not in pending:
            continue
        pair = [text if text is not None else pending[i][0], kind if kind is not None else pending[i][1]]
        if text is not None or kind is not None:
            if any(j != i and same(p, pair) for j, p in pending.items()) or any(j is not None and j != i and same((t, k), pair) for j, t, k in reviews):
                rejected.add(i)
                continue
        pending[i] = pair
        for r in reviews:
            if r[0] == i:
                r[1], r[2] = text if text is not None else r[1], kind if kind is not None else r[2]
    return pending, reviews, rejected


def test_edits_are_those_of_a_loop(spark):
    rng = random.Random(12)
    pick = lambda: rng.choice([*"abcdefgh", None])
    pending, reviews, edits = [], [], []
    for block in range(25):  # apart by their texts, so that each is a case of its own
        base, tag = block * 100, f"{block}-"
        name = lambda t: None if t is None else tag + t
        ids = list(range(base, base + 12))
        pairs = rng.sample([(a, k) for a in "abcdefgh" for k in "xy"], 12)
        pending += [(i, name(t) if rng.random() > 0.05 else None, k) for i, (t, k) in zip(ids, pairs)]
        reviews += [(rng.choice([*ids, None]), name(pick()), rng.choice("xy")) for _ in range(rng.randrange(4))]
        edits += [(i, name(pick()), rng.choice(["x", "y", None])) for i in rng.sample([*ids, base + 50], 9)]
    pending += [(9000 + i, f"chain {i}", "x") for i in range(8)] + [(9100, "p", "x"), (9101, "q", "x")]
    edits += [(9000 + i, f"chain {i - 1}", None) for i in range(8)] + [(9100, "q", None), (9101, "p", None)]  # a chain and a cycle
    p = spark.createDataFrame([(*r, None, "pending") for r in pending], "id int, text string, entity_type string, normalized_text string, status string")
    r = spark.createDataFrame(reviews, "pending_entity_id int, entity_text string, entity_type string")
    e = spark.createDataFrame([(*x, None, None) for x in edits], p.schema)
    want_pending, want_reviews, rejected = one_by_one(pending, reviews, edits)
    got, got_reviews, conflicts = S.apply_edits(p, r, e)
    assert {x.id: [x.text, x.entity_type] for x in got.collect()} == want_pending
    assert sorted(map(tuple, got_reviews.collect()), key=repr) == sorted(map(tuple, want_reviews), key=repr)
    assert {x.id for x in conflicts.collect()} == rejected and len(rejected) > 20


def test_an_approval_keeps_its_link_and_type_together(spark):
    p = spark.createDataFrame([(1, "a", "disease", None), (2, "b", "disease", None)], "id int, text string, entity_type string, normalized_text string")
    r = spark.createDataFrame([], "pending_entity_id int")
    chosen = [(1, "http://x/A", "zMatch"), (1, "http://x/B", "aMatch"), (2, None, "aMatch"), (2, "http://x/C", "exactMatch")]
    made, left, _ = W.approve_entities(p, r, spark.createDataFrame(chosen, "id int, link_to_uri string, link_type string"), 5)
    links = {(x.p, x.o) for x in made.filter("o like 'http://x/%'").collect()}
    name = lambda t: spark.range(1).select(W.link_predicate(F.lit(t))).first()[0]
    assert links == {(name("zMatch"), "http://x/A"), (name("exactMatch"), "http://x/C")} and not left.count()


def test_bulk_review_outcomes(spark):
    p = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, "c", "x")], "id int, text string, entity_type string")
    r = spark.createDataFrame([(3, "zz", "x"), (None, "c", "x")], "pending_entity_id int, entity_text string, entity_type string")
    ids = spark.createDataFrame([(2, 0), (1, 1), (3, 2), (4, 3), (9, 4)], "id int, ord int")
    todo, outcomes = R.bulk_review_entities(ids, p, r)
    assert [x.id for x in todo.collect()] == [2]
    assert {x.id: x.outcome for x in outcomes.collect()} == {2: "reviewed", 1: R.DUPLICATE, 3: R.ALREADY, 4: R.DUPLICATE, 9: R.MISSING}


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 130


def test_flagship_runs(spark):
    row = entry.entry(spark).collect()[0]
    assert row.total == row.exact_matches + row.similar_matches + row.low_matches + row.not_found > 0


def test_relation_scores_move_no_contexts_to_the_linked_ends(spark):
    """The parts that need no graph are made before the joins with the counts of both ends."""
    cols = "id bigint, source_entity string, source_type string, relation_type string, target_entity string, target_type string, confidence double, context string, source string"
    rows = [(1, "acute pain", "disease", "treats", "renal scan", "procedure", 0.9, "some text", "llm"),
            (2, "nix", "disease", "odd", "zz", "procedure", None, None, "both")]
    relations = spark.createDataFrame(rows, cols)
    labels = spark.createDataFrame([("u1", "acute pain", "acute pain", ["Disease"]), ("u2", "acute pains", "acute pains", ["Disease"])],
                                   "uri string, label string, norm string, type_names array<string>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        scored = C.relation_scorecard(relations, labels)
        assert {r["id"]: r["coverage_score"] for r in scored.collect()} == {1: 0.8, 2: 0.8}
        slim = scored.select("id", "coverage_score", "congruence_score", "constraint_score", "overall_score")
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        moved = re.findall(r"\) Exchange\s*\nInput \[\d+\]: \[([^\]]*)\]", slim._jdf.queryExecution().explainString(mode))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    wide = [m for m in moved if "id#" in m and "source_entity#" in m]
    assert wide and not any("context#" in m or "relation_type#" in m for m in wide)
