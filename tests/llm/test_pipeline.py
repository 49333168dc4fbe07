"""The pipeline's stages on a small corpus against plain Python."""

import random
import re

import public_tokenizers
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from kgspark.llm import packing


def corpus(spark, folder):
    random.seed(8)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(random.choices(words, k=n))
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        rows.append((i, text(40) + (" vile rotten." if toxic else ".") + " " + text(30), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    base = text(200)
    rows += [(1000, "exact  copy " + base, "en", "s", 0), (1001, "exact copy\n" + base, "en", "s", 0), (1001, "exact copy\n" + base, "en", "s", 0)]
    near = base.split()
    near[100] = "changed"
    rows += [(1002, "exact copy " + " ".join(near), "en", "s", 0), (1003, "token=abcdefgh12345 " + text(50), "en", "s", 0), (1004, None, None, None, None), (1005, "", "", "", 0)]
    rows = [(*r[:4], len(r[1] or "")) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, {i for i, _, t in labels if t}


def test_stages_and_run(spark, tmp_path):
    rows, toxic = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "best-fit packing":
            assert out.schema.names == docs.schema.names
        out.write.parquet(str(tmp_path / "out" / name))
        docs = spark.read.parquet(str(tmp_path / "out" / name))
        kept[name] = [r.doc_id for r in docs.collect()]
    clean = [r[0] for r in rows if r[0] not in toxic]
    assert sorted(kept["toxicity"]) == sorted(clean)
    assert sorted(kept["exact dedup"]) == sorted(set(clean) - {1001, 1005})
    assert sorted(kept["n-gram Jaccard join"]) == sorted(kept["secret scans"]) == sorted(set(clean) - {1001, 1002, 1005})
    masked = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "out" / "secret scans")).collect()}
    assert masked[1003].text.startswith("[assign] ") and masked[1003].n_chars == len(masked[1003].text)
    made = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    last = sorted((r.doc_id, r.piece, r.length) for r in docs.collect())
    assert sum(n for _, _, n in last) == sum(len(made.ids(re.sub(r"\[assign\]", "[assign]", r.text or ""))) // 4 for r in masked.values())
    assert sorted((r.doc_id, r.piece, r.length) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == last


def test_near_copies_go_by_id_and_text(spark, tmp_path):
    random.seed(3)
    one, other, third = (" ".join(random.choices([f"w{i}" for i in range(300)], k=200)) for _ in range(3))
    rows = [(1, one), (7, one + " more"), (7, other), (None, one.upper()), (None, third)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.without_near_copies(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(0, third), (1, one), (7, other)])


def test_columns_with_names_of_the_operators_pass_through(spark, tmp_path):
    names = ["digest", "spans", "score", "mark", "kept", "node", "component_id", "__text", "__found", "ids", "size", "first", "key", "lang"]
    corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").drop("lang", "source")
    docs = docs.select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name == "best-fit packing":
            assert out.count() > 0
            continue
        out.write.parquet(str(tmp_path / "kept" / name))
        docs = spark.read.parquet(str(tmp_path / "kept" / name))
        assert docs.columns == ["doc_id", "text", "n_chars", *names]
        same = [F.col(f"`{n}`").eqNullSafe(F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string"))) for n in names]
        assert docs.where(~F.forall(F.array(*same), lambda x: x)).count() == 0


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14))
