"""The maintained gram index against a rebuilt one."""

import random

from kgspark.operators import similarity
from kgspark.operators.grams import GramIndex
from kgspark.plans import link_queries


def test_index_follows_its_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(similarity, "GRAM_ROWS", 9)  # frequent grams are in several parts
    rng = random.Random(3)
    text = lambda: "".join(rng.choices("abc \u00e9", k=rng.randint(1, 9)))
    one, two = sorted({text() for _ in range(60)}), sorted({text() for _ in range(60)})
    needles = sorted({text()[:4] for _ in range(50)} | {"a", "zz", "ab"})
    df = lambda rows, c="hay": spark.createDataFrame([(r,) for r in rows], f"{c} string")
    index, live = GramIndex(spark, str(tmp_path / "grams")), set()

    def check():
        got = index.contained_pairs(df(needles, "needle")).collect()
        assert sorted(map(tuple, got)) == sorted((n, h) for n in needles for h in live if n in h)
        assert {r.gram: r.df for r in index.frequency().collect()} == {
            r.gram: r["count"] for r in similarity.gram_postings(df(sorted(live))).groupBy("gram").count().collect()}

    steps = [("a", one, []), ("b", two + [None, ""], one[:20]), ("c", one[5:12], two[:10] + ["not there"]), ("d", two[:5], one[5:8] + two[:5])]
    for name, added, removed in steps:
        assert index.apply(name, df(added), df(removed))
        assert not index.apply(name, df(["never"]))
        gone, new = set(removed) - set(added), set(added) - set(removed) - {None, ""}
        live = (live - gone) | new
        check()
    assert index.compact("e")
    check()
    assert index.store.live("postings") == [5] and index.apply("f", df(one[:3]))
    live |= set(one[:3])
    check()


def test_batches_of_an_index_read_stored_texts(spark, monkeypatch):
    stored, apply = [], GramIndex.apply

    def noted(self, batch, added, removed=None):
        stored.append(bool((added if removed is None else removed).inputFiles()))
        return apply(self, batch, added, removed)

    monkeypatch.setattr(GramIndex, "apply", noted)
    hays = spark.createDataFrame([("ring bolt", 1), ("bolt", 2), ("nut", 2)], "hay string, kind int")
    index = link_queries._maintained(spark, hays, "kind = 1", "hay like '%bolt%'")
    assert stored == [True] * 5
    assert sorted(r.hay for r in index.hays().collect()) == ["bolt", "nut", "ring bolt"]
