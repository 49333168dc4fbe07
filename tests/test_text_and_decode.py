"""Text preparation and decoding against plain-Python brute force."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from kgspark.functions import labels as L
from kgspark.functions.text import normalize_text, strip
from kgspark.operators import decode as C, dictionary as D, prepare as P


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x"))).collect()[0][0]


def test_scalars(spark):
    for t in ["  Caf\xe9   au-LAIT \x1c\x85", "", "A　B\tC", "\U0001F600 x"]:
        want = " ".join(re.sub(r"[^a-z0-9\s]", "", t.lower()).split())
        assert one(spark, t, normalize_text) == want
        assert one(spark, t, strip) == t.strip()
    assert one(spark, "b-ImagingProcedure", L.normalize_iob_label) == "B-imaging_procedure"
    assert one(spark, "I-Drug", L.normalize_iob_label) == "I-substance"
    assert one(spark, "odd", L.normalize_iob_label) == "odd"
    assert one(spark, "quantitative_measure", L.map_foreign_label) == "finding"
    assert one(spark, "Body-System", L.map_foreign_label) == "organ"
    assert one(spark, "new TYPE", L.format_iob_type) == "New type"
    assert one(spark, "rdfs:label", L.expand_curie) == "http://www.w3.org/2000/01/rdf-schema#label"
    assert one(spark, "http://x/y#z", L.shorten_uri) == "...#z"
    assert one(spark, "X-ray of chest", L.infer_entity_type) == "imaging_procedure"


def test_clean_text_keeps_order_of_steps(spark):
    assert one(spark, "a  \t b\n \n \nc", P.clean_text) == "a b\n\n\nc"
    assert one(spark, "\n\n x \n\n\n\n y\t\tz ", P.clean_text) == "x\n\ny z"


def brute_chunks(text, size, overlap):
    if not text:
        return []
    if len(text) <= size:
        return [(0, len(text), text)]
    out, pos = [], 0
    while pos < len(text):
        end = min(pos + size, len(text))
        if end < len(text):
            base = max(pos + size - 200, pos)
            found = [m.end() for m in re.finditer(r"[.!?]\s", text[base:end])]
            if found:
                end = base + found[-1]
            elif text[end - 50:end].rfind(" ") > 0:
                end = end - 50 + text[end - 50:end].rfind(" ") + 1
        if text[pos:end].strip():
            out.append((pos, end, text[pos:end].strip()))
        if end >= len(text):
            break
        pos = max(pos + 1, end - overlap)
    return out


def test_chunks(spark):
    rng = random.Random(2)
    words = lambda n: "".join(rng.choice(["abc", "d", ". ", " ", "! ", "\n", "é\U0001F600", "x" * 30]) for _ in range(n))
    texts = ["", "a" * 500, "a" * 501, "a" * 1400, " " * 1200, words(300), words(900), words(900).replace(".", ""), "a" * 499 + ". " + "b" * 700]
    got = {}
    for r in P.chunk_text(docs(spark, texts), 500, 60).orderBy("doc_id", "chunk_index").collect():
        assert r.chunk_index == len(got.setdefault(r.doc_id, []))
        got[r.doc_id].append((r.start_char, r.end_char, r.text))
    for i, t in enumerate(texts):
        assert got.get(i, []) == brute_chunks(t, 500, 60)


def test_halves_are_at_most_eight_and_keep_the_text(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["word", "end.", "line\n"]) for _ in range(n)) for n in (10, 200, 900)] + ["x" * 5000]
    df = docs(spark, texts).select("doc_id", F.lit(0).alias("chunk_index"), "text")
    got = {}
    for r in P.split_oversize(df, 700).orderBy("doc_id", "piece").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    squeeze = lambda t: re.sub(r"\s", "", t)
    for i, t in enumerate(texts):
        assert squeeze("".join(got[i])) == squeeze(t) and len(got[i]) <= 8
    assert P._halves("aaa. bbb. ccc ddd") == ["aaa. bbb.", "ccc ddd"]
    assert P._halves("aaaa bbbb\ncccc dddd") == ["aaaa bbbb", "cccc dddd"]


def test_sentences_and_tokens(spark):
    rng = random.Random(8)
    texts = ["", "  ", "One two. Three!  Four\n\nfive", " Ab?　c \n d."] + [
        "".join(rng.choice(["ab", ".", " ", "\n", "!", "é", "\t"]) for _ in range(200)) for _ in range(20)]
    s = {}
    for r in P.split_sentences(docs(spark, texts)).orderBy("doc_id", "sentence_id").collect():
        s.setdefault(r.doc_id, []).append((r.start, r.end, r.text))
    t = {}
    for r in P.tokenize_spans(docs(spark, texts)).orderBy("doc_id", "pos").collect():
        t.setdefault(r.doc_id, []).append((r.sentence_id, r.start, r.end, r.gap, r.token))
    for i, text in enumerate(texts):
        want, at, toks, last = [], 0, [], 0
        for piece in (p.strip() for p in re.split(r"(?<=[.!?])\s+|\n+", text)):
            if piece:
                at = text.find(piece, at)
                for m in re.finditer(r"\S+", piece):
                    toks.append((len(want), at + m.start(), at + m.end(), text[last:at + m.start()], m.group()))
                    last = at + m.end()
                want.append((at, at + len(piece), piece))
                at += len(piece)
        assert s.get(i, []) == want and t.get(i, []) == toks


def test_prompts_and_examples(spark):
    long = docs(spark, ["a" * 100, "b" * 9000, "c" * 20000]).select("doc_id", F.lit(0).alias("chunk_index"), "text")
    assert [r.max_tokens for r in P.build_prompts(long, "s").orderBy("doc_id").collect()] == [4063, 1096, 1024]
    t = spark.createDataFrame([(f"u{i}", p, o) for i in range(9) for p, o in (
        ("http://www.w3.org/2000/01/rdf-schema#label", f"L{i}"),
        ("http://www.w3.org/1999/02/22-rdf-syntax-ns#type", f"http://x/{['Disease', 'Organ', 'Odd'][i % 3]}"))], "s string, p string, o string")
    e = D.build_entity_dict(t)
    assert {r.type for r in P.few_shot_sample(e, 6).collect()} == {"disease", "organ"}
    even = [r.type for r in P.few_shot_sample(e, 4, stratified=True).collect()]
    assert sorted(even) == ["disease", "disease", "organ", "organ"]
    custom = spark.createDataFrame([("l0", "symptom")], "text string, entity_type string")
    block = P.few_shot_block(P.few_shot_sample(e, 6), custom).collect()[0][0]
    assert '"text":"l0"' in block and '"text":"L0"' not in block and '"text":"L1"' in block


def test_select_json(spark):
    cases = {
        "x ```json\n{\"a\":1}\n``` y": '{"a":1}',
        'pre {"b":1} mid {"entities":[]} post {"c":2}': '{"entities":[]}',
        'pre {"b":1} post {"c":{"d":2}}': '{"c":{"d":2}}',
        "none": None,
    }
    got = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", C.select_json_object(F.col("raw")).alias("j")).collect()
    assert {r.raw: r.j for r in got} == cases


def test_parse_rejects_what_json_rejects(spark):
    raws = ['{"entities":[{"text":"a","entity_type":"x"},7,{"text":"b"}]}', "{'entities':[{'text':'a','entity_type':'x'}]}",
            '{"entities":[{"text":"a","entity_type":"x"}]} trailing', '{"entities":[{"text":"a","entity_type":"x"}]} {x}', "[1"]
    df = spark.createDataFrame(list(enumerate(raws)), "id int, raw string")
    got = sorted((r.id, r.text) for r in C.parse_entities(df, ["id"]).collect())
    assert got == [(0, "a"), (2, "a")]
    fixed = spark.createDataFrame([(1, '{"entities":[{"text":"renal scan","entity_type":{}},{"text":"asthma x","entity_type":""},{"entity_type":"y"},]}')], "id int, raw string")
    assert sorted((r.text, r.entity_type) for r in C.repaired_entities(fixed, ["id"]).collect()) == [("asthma x", "finding"), ("renal scan", "finding")]


def brute_bio(text, preds):
    spans, cur, prev = [], None, -1
    for a, b, label, sub in preds:
        if a == b:
            prev = b
            continue
        gap = text[prev:a] if prev >= 0 else ""
        near = a == prev or (a <= prev + 1 and not gap.strip())
        sub = sub or (prev > 0 and a > prev and not re.search(r"\s", gap))
        kind = label[2:] if label != "O" else None
        if kind and cur and cur[2] == kind and (label[0] == "I" or near or sub):
            cur[1] = b
        else:
            if cur:
                spans.append(cur)
            cur = [a, b, kind] if kind else None
        prev = b
    if cur:
        spans.append(cur)
    out = []
    for s in spans:
        if out and out[-1][2] == s[2] and s[0] <= out[-1][1] + 2 and not re.search(r"\s", text[out[-1][1]:s[0]]):
            out[-1][1] = s[1]
        else:
            out.append(list(s))
    return [tuple(s) for s in out]


def test_decode_bio(spark):
    rng = random.Random(6)
    rows, bodies, want = [], [], {}
    for d in range(40):
        text, preds, at = "", [(0, 0, "O", False)] if d % 3 == 0 else [], 0
        for _ in range(40):
            gap = rng.choice(["", "", " ", "-", "  ", "-_", "\n"])
            tok = "".join(rng.choices("abc", k=rng.randint(1, 4)))
            start = len(text) + len(gap)
            text += gap + tok
            preds.append((start, len(text), rng.choice(["O", "B-x", "I-x", "B-y", "I-y"]), rng.random() < 0.1))
        last = 0
        for i, (a, b, label, sub) in enumerate(preds):
            rows.append((d, i, a, b, text[last:a], text[a:b], label, sub))
            last = b
        bodies.append((d, text))
        want[d] = brute_bio(text, preds)
    df = spark.createDataFrame(rows, "doc_id bigint, idx int, start int, end int, gap string, token string, label string, is_subword boolean")
    spans = C.decode_bio(df)
    got = {d: [] for d in want}
    for r in C.slice_texts(spans.drop("confidence"), spark.createDataFrame(bodies, "doc_id bigint, body string")).collect():
        got[r.doc_id].append((r.start, r.end, r.entity_type))
        assert r.text == bodies[r.doc_id][1][r.start:r.end]
    assert {d: sorted(v) for d, v in got.items()} == {d: sorted(v) for d, v in want.items()}


def test_assign_occurrences(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choices("aAb c", k=80)) for _ in range(12)]
    ex = [(d, i, "".join(rng.choices("abA", k=rng.randint(1, 3)))) for d in range(12) for i in range(60)]
    want = {}
    for d, text in enumerate(texts):
        used = set()
        for _, i, word in (e for e in ex if e[0] == d):
            at = text.lower().find(word.lower())
            while at >= 0 and at in used:
                at = text.lower().find(word.lower(), at + 1)
            want[d, i] = at if at >= 0 else None
            used.add(at)
    df = spark.createDataFrame(ex, "doc_id bigint, ord bigint, text string")
    got = C.assign_occurrences(df, spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, body string")).collect()
    assert {(r.doc_id, r.ord): r.start for r in got} == want
    assert all(r.end == (None if r.start is None else r.start + len(r.text)) for r in got)


def test_iob_sample_round_trip(spark):
    words = "The patient has diabetes mellitus . Treatment includes insulin".split()
    text = " ".join(words)
    start = lambda w: text.index(w)
    ents = [(0, 0, start("diabetes"), start("mellitus") + 8, "disease"), (0, 1, start("insulin"), len(text), "substance")]
    e = spark.createDataFrame(ents, "doc_id bigint, ord int, start int, end int, entity_type string")
    toks = P.tokenize_spans(docs(spark, [text]))
    from pyspark.sql import Window
    toks = toks.withColumn("prev_end", F.lag("end").over(Window.partitionBy("doc_id").orderBy("pos")))
    tagged = C.tag_iob(toks, e).orderBy("pos").collect()
    assert [r.label for r in tagged] == ["O", "O", "O", "B-Disease", "I-Disease", "O", "O", "O", "B-Substance"]
    assert [r.sentence_id for r in tagged] == [0] * 6 + [1] * 3
    back = C.iob_to_entities(spark.createDataFrame([(r.doc_id, r.pos, r.token, r.label) for r in tagged],
                                                   "doc_id bigint, pos int, words string, labels string"), ["doc_id"]).orderBy("entity_no").collect()
    assert [(r.text, r.entity_type) for r in back] == [("diabetes mellitus", "Disease"), ("insulin", "Substance")]


def test_deep_and_broken_answers():
    """Neither nesting nor many broken objects end or slow down the choice."""
    deep = "{" + '"a":{' * 100_000
    assert C._choose(deep + "}" * 100_001) == deep + "}" * 100_001
    broken = "{bad} " * 40_000
    start = time.perf_counter()
    assert C._choose(broken + '{"entities": []}') == '{"entities": []}'
    assert C._choose(broken) == "{bad}" and C._choose("{bad} {open") == "{bad}"
    assert C._choose('x } {"b": {c} } {"relations": 1}') == '{"relations": 1}'
    assert time.perf_counter() - start < 20


def brute_tags(tokens, spans):
    """The label of each (key, pos): of the token whose first span by (start, ord) is first."""
    found = {}
    for key, pos, start, end, prev_end in tokens:
        for k, order, es, ee, kind in spans:
            if None in (key, pos, start, end, es, ee) or k != key or not (start < ee and end > es):
                continue
            opens = prev_end is None or prev_end <= es if start >= es and end <= ee else start <= es
            found[key, pos] = min(found.get((key, pos), (es + 1, 0, "")), (es, order, ("B-" if opens else "I-") + kind.capitalize()))
    return [(key, pos, found.get((key, pos), (0, 0, "O"))[2]) for key, pos, *_ in tokens]


def test_tag_iob_meets_spans_in_one_shuffle(spark):
    rng = random.Random(11)
    tokens, spans = [], []
    for d in range(30):
        at, before = 0, None
        for pos in range(rng.choice([1, 5, 60])):
            start = at + rng.randint(0, 3)
            at = start + rng.randint(0, 9)
            tokens.append((d, pos, start, at, before))
            before = at
        for order in range(rng.choice([0, 3, 40])):
            es = rng.randint(0, max(at, 1))
            spans.append((d, order, es, es + rng.randint(-1, 30), rng.choice(["aa", "bb", "cc"])))
    d = 40  # several tokens of one place, a missing place, key or end; a span around all, one without end
    tokens += [(d, 0, 5, 9, None), (d, 0, 1, 4, None), (d, 0, None, 3, None), (d, None, 1, 4, None), (None, 0, 1, 4, None), (d, 1, 9, None, 4)]
    spans += [(d, 1, 6, 8, "aa"), (d, 0, 2, 3, "bb"), (d, 2, 2, None, "cc"), (None, 0, 0, 9, "aa")]
    t = spark.createDataFrame(tokens, "doc_id bigint, pos int, start int, end int, prev_end int")
    e = spark.createDataFrame(spans, "doc_id bigint, ord bigint, start int, end int, entity_type string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # documents and places go over several batches
    try:
        tagged = C.tag_iob(t, e)
        got = sorted(map(tuple, tagged.select("doc_id", "pos", "label").collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(brute_tags(tokens, spans), key=str)
    whole = t.where("doc_id < 40")  # without the column, the end of the token before comes from the tokens
    alone = C.tag_iob(whole.drop("prev_end"), e).select("doc_id", "pos", "label")
    assert sorted(map(tuple, alone.collect())) == sorted(x for x in map(tuple, got) if x[0] is not None and x[0] < 40)
    plan = tagged._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_decode_bio_shuffles_no_text(spark):
    rows = [(1, 0, 0, 3, "", "abc", "B-x", False), (1, 1, 4, 7, " ", "def", "I-x", False)]
    preds = spark.createDataFrame(rows, "doc_id bigint, idx int, start int, end int, gap string, token string, label string, is_subword boolean")
    spans = C.decode_bio(preds)
    assert [tuple(r) for r in spans.collect()] == [(1, 0, 7, "x", 0.9)]
    sent = spans._jdf.queryExecution().executedPlan().toString().split("Exchange")[0]
    assert not re.search(r"\b(gap|token|label)#", sent)
