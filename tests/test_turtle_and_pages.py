"""Turtle files against hand-made triples and the line format, and pages by order statistics against pages by number."""

import random
import re

import pytest
from pyspark.sql import functions as F

from kgspark.operators import staging as S
from kgspark.operators.pages import PageIndex
from kgspark.sources import triples as T, turtle

DOC = '''@prefix ex: <http://x/> . # ex:no ex:comment ex:counts .
@base <http://base/a/> .
PREFIX : <#>
<s> a ex:Type ; ex:p "one.", 'two'@EN , 3 , -4.5, .5e3 , true ;
   :q """long . "quoted"
line ' two \\u00e9

end.""" ; .
ex:a.b ex:p <http://y/z.html> .@prefix ex: <http://other/> .
ex:c ex:p [ ex:q "x"^^ex:dt ; ex:r [] ] , ( 1 ( ) "b" ) .
[ ex:p ex:o ] .
[] ex:p _:n1 . _:n1 ex:p ex:e\\,f, \'\'\'a\'\'b\'\'\' .'''
XSD, RDF = turtle.XSD, turtle.RDF


def lines_of(spark, files, split):
    """Lines of texts, cut into splits of so many lines."""
    data = [(f, i // split * 1000, i, line, "extra") for f, text in files.items() for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(data, "file string, start long, row long, value string, known string").repartition(5)


def found(df):
    return sorted(map(tuple, df.select("s", "p", "o", "o_kind", "lang", "datatype").collect()), key=repr)


def renamed(rows):
    """Blank nodes by order of appearance in the sorted rows, so that sets can be compared."""
    names = {}
    name = lambda x: names.setdefault(x, f"_:{len(names)}") if x.startswith("_:") else x
    return [(name(s), p, name(o), *rest) for s, p, o, *rest in rows]


@pytest.mark.parametrize("block", [2, 5000])
def test_turtle_is_the_same_for_any_splits(spark, block):
    whole, errors = turtle.parse_turtle(lines_of(spark, {"f": DOC}, 1000), block)
    assert errors.count() == 0
    got = found(whole)
    for split in (1, 3):
        assert found(turtle.parse_turtle(lines_of(spark, {"f": DOC}, split), block)[0]) == got
    s, q = "http://base/a/s", "http://base/a/#q"
    plain = {r for r in got if not r[0].startswith("_:") and not r[2].startswith("_:")}
    assert plain == {
        (s, RDF + "type", "http://x/Type", "uri", None, None), (s, "http://x/p", "one.", "literal", None, None),
        (s, "http://x/p", "two", "literal", "en", None), (s, "http://x/p", "3", "literal", None, XSD + "integer"),
        (s, "http://x/p", "-4.5", "literal", None, XSD + "decimal"), (s, "http://x/p", ".5e3", "literal", None, XSD + "double"),
        (s, "http://x/p", "true", "literal", None, XSD + "boolean"),
        (s, q, 'long . "quoted"\nline \' two é\n\nend.', "literal", None, None), ("http://x/a.b", "http://x/p", "http://y/z.html", "uri", None, None)}
    other = "http://other/"
    by = {}
    for r in got:
        by.setdefault((r[0], r[1]), []).append(r)
    box, top = sorted(by[other + "c", other + "p"], key=lambda r: (r[2], other + "q") not in by)
    assert by[box[2], other + "q"][0][2:] == ("x", "literal", None, other + "dt") and by[box[2], other + "r"][0][3] == "blank"
    cells, cell = [], top[2]
    while cell != RDF + "nil":
        cells.append(by[cell, RDF + "first"][0][2])
        cell = by[cell, RDF + "rest"][0][2]
    assert cells == ["1", RDF + "nil", "b"]
    assert sum(r[1:3] == (other + "p", other + "o") for r in got) == 1
    named = [r for r in got if r[2] in (other + "e,f", "a''b")]
    assert len(named) == 2 and len({r[0] for r in named}) == 1 and len(got) == 9 + 2 + 2 + 6 + 1 + 1 + 2


BROKEN = ["<a> <b> .", "<a> <b> <c>", '<a> <b> "x', '<a> <b> """x\n. ', "<a> <b> no:name .", "<a> <b> (1 .", "<a> <b> ] .", "@prefix x <y> .", "<a> b <c> .",
          '"lit" <b> <c> .', '<a> <b> "\\uD800" .', "<a> <b> <c> <d> .", "@prefix x: <y> <a> <b> <c> .", "[] .", "<a> , <b> .", "<a> <b> 1x .", "() ."]


def test_files_with_errors_are_left_out(spark):
    files = {f"bad{i}": f"<http://ok> <http://ok> {i} .\n{text}" for i, text in enumerate(BROKEN)}
    good, errors = turtle.parse_turtle(lines_of(spark, {**files, "good": "<a> <b> <c> .\n# end", "empty": "", "note": "# only . this", "head": "PREFIX a: <b>"}, 1))
    assert {r.src for r in errors.collect()} == set(files)
    assert [(r.s, r.src) for r in good.collect()] == [("a", "good")]


def test_long_turtle_file_over_many_splits_reads_as_lines_do(spark, tmp_path):
    rnd = random.Random(5)
    texts = ['say "hi"', "tab\tend.", "multi\nline. <x> ;", "é😀 # no", "\\", "plain"]
    data = [(f"http://s/{rnd.randrange(300)}", f"http://p/{rnd.randrange(5)}", rnd.choice(texts) + str(i), "literal", None, "f") for i in range(2000)]
    graph = spark.createDataFrame(data, "s string, p string, o string, o_kind string, g string, src string")
    (tmp_path / "ttl").mkdir()
    T.write_ntriples(graph.coalesce(1), str(tmp_path / "nt"))
    text = "".join(p.read_text() for p in (tmp_path / "nt").glob("part-*"))
    # Line ends inside some strings, so that splits begin inside them.
    text = re.sub(r'"((?:[^"\\]|\\[^\n])*)" \.', lambda m: f'"""{m[1]}""" .'.replace("\\n", "\n"), text)
    (tmp_path / "ttl" / "a.ttl").write_text(text)
    want = sorted({d[:3] for d in data})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("4096", old):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            good, errors = turtle.scan_turtle(spark, str(tmp_path / "ttl"))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert errors.count() == 0
        assert sorted(tuple(r) for r in good.select("s", "p", "o").collect()) == want


@pytest.mark.parametrize("down", [True, False])
def test_deep_pages_are_the_pages_by_number(spark, down):
    rows = spark.createDataFrame([(i, [None, 1.0, 2.0, 0.5][i % 4], i * 7 % 50, i) for i in range(203)], "id int, score double, created_at int, range int")
    for by in ("score", "none"):
        listing = S.Listing(sort_by=by, descending=down, page_size=9)
        index = PageIndex(rows, listing, ["score"], range_rows=20)
        assert index.total() == 203 and len(index.ranges) > 5
        for page in range(1, 25):
            want = S.list_page(rows, S.Listing(sort_by=by, descending=down, page=page, page_size=9), ["score"]).collect()
            assert index.page(page).collect() == want
    assert PageIndex(rows.filter("id < 0"), listing, ["score"]).page(1).count() == 0
    plan = index.page(12)._jdf.queryExecution().toString()
    assert "PartitionFilters: [range_#" in plan or "PartitionFilters: [isnotnull(range_" in plan
    with pytest.raises(ValueError):
        index.page(0)
