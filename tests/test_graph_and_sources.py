"""Triple sources, graph patterns and token files on small inputs."""

import pytest
from pyspark.sql import functions as F

from kgspark.operators import graph as G
from kgspark.sources import bindings, documents, iob, triples as T

ROWS = [
    ("a", "p", "b", "uri", None, "f1"), ("b", "p", "c", "uri", "g1", "f1"), ("a", "q", "a", "uri", None, "f2"),
    ("a", "label", 'say "hi"\tnow\\n', "literal", None, "f2"), ("c", "label", "Ünï <x> .", "literal", "g1", "f2"),
]
DDL = "s string, p string, o string, o_kind string, g string, src string"


@pytest.fixture(scope="module")
def graph(spark):
    return spark.createDataFrame(ROWS, DDL)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_round_trip_through_files(spark, graph, tmp_path):
    T.write_ntriples(graph, str(tmp_path / "nt"), named=True)
    (tmp_path / "nt" / "extra.txt").write_text("# comment\n\nnot a triple\n<a> <p> <b> .\n")
    good, bad = T.scan_ntriples(spark, str(tmp_path / "nt"))
    got = {tuple(r) for r in good.select("s", "p", "o", "o_kind", "g").collect()}
    assert got == {r[:5] for r in ROWS}
    assert [(r.src, r.line) for r in bad.collect()] == [("extra.txt", "not a triple")]
    assert T.distinct_triples(good).count() == 5


def test_terms_keep_their_identity(spark):
    lines = ['<s> <p> "x"@en .', '<s> <p> "4"^^<http://int> .', "_:b1 <p> _:b2 <g> .", r"""<s> <p> "caf\u00e9 \U0001F600 \t\b\f\' \\n" .""",
             '<s> <p> "http://x" .', "<s> <p> <http://x> .", '<s> <p> "x"@de .', '<s> <p> "a@b^^c" . # "no"', "<s> <p> .", '<s> <p> "\u0001" .']
    df = spark.createDataFrame([(x, "f") for x in lines], "value string, src string")
    got = T.parse_ntriples(df)
    assert [tuple(r) for r in got.select("s", "o", "o_kind", "lang", "datatype", "g", "ok").collect()] == [
        ("s", "x", "literal", "en", None, None, True), ("s", "4", "literal", None, "http://int", None, True), ("_:b1", "_:b2", "blank", None, None, "g", True),
        ("s", "café 😀 \t\b\f' \\n", "literal", None, None, None, True), ("s", "http://x", "literal", None, None, None, True),
        ("s", "http://x", "uri", None, None, None, True), ("s", "x", "literal", "de", None, None, True), ("s", "a@b^^c", "literal", None, None, None, True),
        ("", "", "uri", None, None, None, False), ("s", "\x01", "literal", None, None, None, True)]
    good = got.filter("ok").drop("ok", "line")
    assert T.distinct_triples(good).count() == 9
    assert T.new_triples(good.filter("lang IS NULL OR lang <> 'de'"), good).select("o", "lang").collect() == [("x", "de")]


def test_files_with_all_terms_read_equal_after_writing(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.nt").write_text('<s> <p> "x\\"\\n\\u00e9"@en .\n_:b0 <p> "1"^^<int> .\n<s> <p> _:b0 <g> .\n')
    (tmp_path / "one" / "b.nt").write_text("_:b0 <p> <o> .\n")
    columns = ["s", "p", "o", "o_kind", "s_kind", "lang", "datatype", "g"]
    first, bad = T.scan_ntriples(spark, str(tmp_path / "one"))
    assert bad.count() == 0 and len({r.s for r in first.filter("s_kind = 'blank'").collect()}) == 2
    T.write_ntriples(first, str(tmp_path / "two"), named=True)
    again, _ = T.scan_ntriples(spark, str(tmp_path / "two"))
    assert rows(again.select(*columns)) == rows(first.select(*columns))


def test_append_snapshot_and_fingerprint(spark, graph, tmp_path):
    more = spark.createDataFrame([("a", "p", "b", "uri", None, "f3"), ("z", "p", "b", "uri", None, "f3"), ("z", "p", "b", "uri", None, "f4")], DDL)
    assert [r.s for r in T.new_triples(graph, more).collect()] == ["z"]
    path = str(tmp_path / "snap")
    T.write_snapshot(graph, path)
    T.append_triples(more, path, spark.read.parquet(path))
    back = spark.read.parquet(path)
    assert back.count() == 6
    assert "PartitionFilters: [isnotnull(p" in back.filter("p = 'label'")._jdf.queryExecution().toString()
    files = T.list_files(spark, path + "/p=label")
    one, two = (T.snapshot_fingerprint(files).collect()[0] for _ in range(2))
    assert one == two and one.n_files >= 1


def test_toggle_and_drop(spark, graph):
    off = spark.createDataFrame([("f1",)], "src string")
    both = spark.createDataFrame([("f1",), ("f2",)], "src string")
    assert [r.src for r in T.toggle_disabled(off, both).collect()] == ["f2"]
    assert T.skip_disabled(graph, off).count() == 3
    assert T.drop_graph(graph).count() == 2 and T.drop_graph(graph, "g1").count() == 3
    assert {r.src: r.triple_count for r in T.source_catalog(graph).collect()} == {"f1": 2, "f2": 3}


def test_patterns(graph):
    assert rows(G.pattern(graph, "?x", "q", "?x")) == [("a",)]
    two = G.join_patterns(G.pattern(graph, "?a", "p", "?b"), G.pattern(graph, "?b", "p", "?c"))
    assert rows(two.select("a", "b", "c")) == [("a", "b", "c")]
    opt = G.optional(G.pattern(graph, "?a", "p", "?b"), G.pattern(graph, "?b", "label", "?l"))
    assert rows(opt.select("a", "b", "l")) == [("a", "b", None), ("b", "c", "Ünï <x> .")]
    with pytest.raises(ValueError):
        G.join_patterns(G.pattern(graph, "?a", "p", "?b"), G.pattern(graph, "?c", "q", "?d"))
    made = G.construct(two, [(F.col("a"), F.lit("far"), F.col("c")), (F.col("a"), F.lit("none"), F.lit(None).cast("string"))])
    assert rows(made) == [("a", "far", "c")]
    assert G.ask(G.pattern(graph, "zz", "p", "?b")).collect()[0].result is False
    assert G.describe(graph, graph.filter("p = 'q'").select("s")).count() == 3
    assert G.values_in_table(graph, "p", graph.filter("src = 'f1'").select("p")).count() == 2


def test_bindings(spark, tmp_path):
    body = '{"head":{"vars":["x","y"]},"results":{"bindings":[{"x":{"type":"uri","value":"u"}},{"x":{"type":"uri","value":"v"},"y":{"type":"literal","value":"a,\\"b\\""}}]}}'
    df = spark.createDataFrame([("s1", body), ("s2", '{"boolean":true}')], "src string, body string")
    got = bindings.bindings_to_rows(df, ["x", "y"], ["src"])
    assert rows(got) == sorted([("s1", "u", None), ("s1", "v", 'a,"b"')], key=repr)
    assert rows(bindings.boolean_results(df, ["src"])) == [("s2", True)]
    bindings.write_result_csv(got, str(tmp_path / "csv"))
    assert rows(spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))) == rows(got)


def test_documents_and_token_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.TXT").write_bytes("héllo".encode() + b"\xff\xfe!" + "\ufffd".encode() + b"\xe2\x82")
    (tmp_path / "d" / "b.odd").write_bytes(b"x")
    got = {r.name: (r.file_type, r.text) for r in documents.scan_documents(spark, str(tmp_path / "d")).collect()}
    assert got == {"a.TXT": ("txt", "héllo!\ufffd"), "b.odd": ("odd", "x")}

    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.conll").write_text("The O\npatient x O\nalone\n\ndiabetes B-Disease\n \n\nmellitus I-Drug\n")
    lines = iob.read_iob_lines(spark, str(tmp_path / "t")).orderBy("file", "pos").collect()
    assert [(r.words, r.labels) for r in lines] == [("The", "O"), ("patient", "O"), ("diabetes", "B-disease"), ("mellitus", "I-substance")]
    assert len({(r.file, r.sentence_no) for r in lines}) == 3

    csv = "words,sentence_id,labels\nThe,0,O\ndiabetes,0,B-Disease\nmellitus,0,I-Disease\n\"a,b\",1,\ninsulin,1,B-Substance\n"
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.csv").write_text(csv)
    s = iob.sentences(iob.read_iob_csv(spark, str(tmp_path / "c")), ["sentence_id"]).orderBy("sentence_id").collect()
    assert [(r.words, r.label_ids) for r in s] == [(["The", "diabetes", "mellitus"], [0, 1, 2]), (["a,b", "insulin"], [0, 25])]
    toks = spark.createDataFrame([('a"b', 0, "O"), ("c", 1, "B-Organ")], "words string, sentence_id int, labels string")
    iob.write_iob_csv(toks, str(tmp_path / "o"))
    assert iob.read_iob_csv(spark, str(tmp_path / "o")).select("words").count() == 2
    line = toks.select(iob.iob_csv_line(F.col("words"), F.col("sentence_id"), F.col("labels"))).collect()
    assert [x[0] for x in line] == ['"a"b",0,O', "c,1,B-Organ"]


def test_positions_do_not_depend_on_splits(spark, tmp_path):
    """A file of several splits gives the same rows as one split, with LF and with CRLF."""
    for end in ("\n", "\r\n"):
        folder = tmp_path / f"lines{len(end)}"
        (folder / "t").mkdir(parents=True)
        (folder / "c").mkdir()
        for name in ("a", "b"):
            body = [f"{name}word{i} {'B-Disease' if i % 5 == 0 else 'O'}" if i % 7 else "" for i in range(1, 400)]
            (folder / "t" / f"{name}.conll").write_bytes(end.join(body).encode())
            rows = ["words,sentence_id,labels", *[f"{name}word{i},{i // 7},O" for i in range(300)]]
            (folder / "c" / f"{name}.csv").write_bytes(end.join(rows).encode())
        got = []
        for size in ("64m", "900b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "100b")
            try:
                lines, table = iob.read_iob_lines(spark, str(folder / "t")), iob.read_iob_csv(spark, str(folder / "c"))
                got.append((sorted(map(tuple, lines.collect())), sorted((r.file, r.pos, r.words, r.sentence_id, r.labels) for r in table.collect())))
                parts = spark.read.text(str(folder / "t")).rdd.getNumPartitions()
            finally:
                spark.conf.unset("spark.sql.files.maxPartitionBytes")
                spark.conf.unset("spark.sql.files.openCostInBytes")
        assert parts > 4 and got[0] == got[1]
        assert [r[2] for r in got[0][0] if r[0] == "a.conll"] == [i - 1 for i in range(1, 400) if i % 7]
        assert [(p, w) for f, p, w, *_ in got[0][1] if f == "b.csv"] == [(i, f"bword{i}") for i in range(300)]


def test_escapes_that_name_no_character_reject_their_line(spark):
    text = ['<s> <p> "\\uD83D\\uDE00 \\U0001F600 \\\\uD83D" .', '<s> <p> "\\uD83D" .', '<s> <p> "\\uDE00\\uD83D" .', '<s> <p> "\\U00110000" .', '<s> <p> "x"^^<t\\uD800> .', '<s\\u0041> <p> <o> .']
    got = T.parse_ntriples(spark.createDataFrame([(t, "f") for t in text], "value string, src string")).collect()
    assert [r.ok for r in got] == [True, False, False, False, False, True]
    assert got[0].o == "\U0001F600 \U0001F600 \\uD83D" and got[5].s == "sA"
