"""Ranked search, URL filters and the prefix trie against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from kgspark.llm import prefix_trie, term_pipeline, url_filter


def best(docs, items):
    fold = lambda t: re.findall(term_pipeline.TERM, (t or "").translate(str.maketrans(term_pipeline.UPPER, term_pipeline.LOWER)))
    counts = [(i, Counter(fold(t))) for i, t in docs]
    counts = [(i, c, c.total()) for i, c in counts if c]
    n, length = len(counts), sum(k for _, _, k in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    terms = defaultdict(set)
    for i, t in items:
        terms[i] |= set(fold(t))
    out = set()
    for item, asked in terms.items():
        rows = []
        for i, c, k in counts:
            m = 10 + (90 * k * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if score > 0:
                rows.append((-score, i is None, i or 0, i))
        out |= {(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(rows, key=lambda r: r[:3])[:10], 1)}
    return out


def test_ranked_search_equals_brute_force(spark, monkeypatch):
    random.seed(5)
    words = [f"w{i}" for i in range(300)] + ["Über", "漢字", "x_y", "A-B", "😀q"]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: " ".join(random.choices(words, weights, k=n))
    docs = [(i, text(random.randrange(1, 60)), "s") for i in range(700)]
    docs += [(3, docs[3][1], "s"), (None, text(30), None), (900, None, None), (901, "", ""), (902, " .,;", ""), (903, text(3000), "")]
    docs += [(1000 + i, docs[10][1], "copy") for i in range(40)]
    items = [(i, text(12)) for i in range(30)] + [(7, "w250 w251"), (None, "w5 w9"), (50, None), (51, "unknownterm"), (52, docs[10][1])]
    for sizes in ((8192, 128, 1 << 20), (37, 5, 64)):
        for name, size in zip(("SHARD_DOCS", "BUNDLE_ITEMS", "SLICE"), sizes):
            monkeypatch.setattr(term_pipeline, name, size)
        made = term_pipeline.ranked(
            spark.createDataFrame(docs, "doc_id long, text string, shard string").repartition(3).withColumn("term", F.lit(1)),
            spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("x")),
        )
        got = made.collect()
        assert {tuple(r) for r in got} == best([d[:2] for d in docs], items) and len(got) == len({tuple(r) for r in got})


def test_ranked_search_without_terms(spark):
    docs, items = (spark.createDataFrame([], f"{c} long, text string") for c in ("doc_id", "item_id"))
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    blank = spark.createDataFrame([(1, " - "), (2, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs, items), (docs, asked), (some, items), (blank, asked)):
        made = term_pipeline.ranked(d, i)
        assert made.columns == ["item_id", "rank", "doc_id", "score"] and not made.collect()


def test_terms_of_sliced_texts(monkeypatch):
    text = ("short " * 30 + "y" * 500 + " é漢" * 40 + "z" * 90).encode()
    whole = term_pipeline.counted(text)
    for size in (7, 64, 100):
        monkeypatch.setattr(term_pipeline, "SLICE", size)
        assert term_pipeline.counted(text) == whole


def test_urls_equal_the_rules_one_by_one(spark):
    random.seed(6)
    hosts = ["example.com", "www.example.com", "A.b.Example.COM", "com", "xcom", "example.net", "net", "notnet", "", "a..net", "example.com.", "user@example.com"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/es/", "/fr/a/b", "/EN/", "//en/"]
    tails = ["", "?q=/en/", "#top", "?a#b", "/more"]
    urls = [f"{s}{h}{p}{t}" for s in ("http://", "https://", "", "a://b://") for h in hosts for p in paths for t in tails] + [None, "", "://", "no scheme", "http://" + "a." * 500 + "com/" + "x" * 3000]
    extra = [(f"h{i}.{random.choice(['org', 'com', 'example.net'])}", random.choice(["/", "/p", "/en/", ""]), random.choice(["allow", "block"])) for i in range(400)]
    rules = url_filter.RULES + extra + [extra[0][:2] + ("block",), (None, "/", "block"), ("", "/", "block"), ("UPPER.org", None, "block")]
    urls += [f"http://{random.choice('ab')}.{h}{p}{random.choice(['', 'q', '/en/'])}" for h, p, _ in extra] + ["http://upper.ORG", "http://x.upper.org?z"]
    table, by_key = {}, {}
    for h, p, v in rules:
        if h:
            key = (h.lower(), p or "")
            table[key] = "block" if "block" in (v, table.get(key)) else v
    want = []
    for n, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest).group()
        path = re.match("[^?#]*", rest[len(host):]).group()
        host = "".join(c.lower() if c in url_filter.UPPER else c for c in host)
        fits = [(len(h + p), len(h), h + p, v) for (h, p), v in table.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        by_key[n] = max(fits, default=(0, 0, None, "allow"))
        want.append((n, host, path, by_key[n][2], by_key[n][3]))
    pages = spark.createDataFrame([(n, u, "x") for n, u in enumerate(urls)], "page_id long, url string, rule string").withColumn("host", F.lit(1))
    given = spark.createDataFrame(rules, "host string, path string, verdict string")
    for limit in (url_filter.FILTER_BITS, 64):
        assert sorted(tuple(r) for r in url_filter.judged(pages, given, limit=limit).collect()) == want
    assert not url_filter.judged(pages.where("false"), given).collect()
    assert {r.verdict for r in url_filter.judged(pages, given.where("false"), default="block").collect()} == {"block"}


def test_cascade_is_exact_and_grows_with_the_list(spark):
    universe = spark.range(60_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.where("pmod(xxhash64(key), 30) = 0")
    levels = url_filter.cascade(listed, universe)
    n = listed.count()
    assert len(levels) > 3 and sum(level.bits for level in levels) < 16 * n
    wrong = universe.where(url_filter.member(F.col("key"), levels) != F.expr("pmod(xxhash64(key), 30) = 0"))
    assert wrong.count() == 0


def trie_rows(rows):
    """The contract's nodes in plain Python."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for key in members:
        if key:
            children[key[:-1]].append(key)
    below = {}
    for key in sorted(members, key=len, reverse=True):
        saved = (len(members[key]) - 1) * len(re.findall(prefix_trie.WORD, key[-1][1])) if key else 0
        below[key] = (sum(below[k][0] for k in children[key]) or 1, saved + sum(below[k][1] for k in children[key]))
    digest = lambda key: hashlib.sha256(",".join(map(str, sorted(c for c in members[key] if len(whole[c]) == len(key)))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), *below[k], digest(k)) for k, m in members.items())


def conversations():
    random.seed(11)
    rows = []
    for c in [*range(-30, 160), 1000, 1020, 1021]:
        for turn in range(random.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c, turn, random.choice(["user", "assistant"]), random.choice(["hello there", "a b  c", "same", f"own {random.randrange(5)}"])))
    rows += [(500, t, "user", f"turn {t % 7}") for t in range(300)] + [(501, t, "user", f"turn {t % 7}") for t in range(250)]  # two long ones
    rows += [(c, 0, "user", "hot") for c in range(600, 680)] + [(c, 1, "user", "x") for c in range(600, 680, 3)]
    rows += [(700, None, None, None), (700, None, None, "a"), (700, 1, "", ""), (700, 1, "", ""), (None, 1, "user", "lost"), (701, 1, "user", "né é\x0b漢\u00a0b")]
    random.shuffle(rows)
    return rows


def test_trie_equals_brute_force_in_any_shards(spark, monkeypatch):
    rows = conversations()
    want = trie_rows(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    df = df.withColumns({"depth": F.lit("x"), "key": F.lit(1), "part": F.lit(None)})
    for shard, queue in ((prefix_trie.SHARD_NODES, prefix_trie.QUEUE), (60, 5), (4, 2)):
        monkeypatch.setattr(prefix_trie, "QUEUE", queue)
        assert sorted(map(tuple, prefix_trie.trie(df, shard).collect()), key=lambda r: (r[0], r[1])) == want
    assert prefix_trie.trie(df.where("false")).collect() == []


def test_long_lists_of_ids_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    key = F.struct((F.col("id") % 3).alias("k1"), F.lit(0).cast("long").alias("k2"))
    got = prefix_trie.id_digests(spark.range(0, 900, 2).select(key.alias("key"), F.col("id").alias("conv_id"))).collect()
    assert {r.key.k1: r.ends_sha256 for r in got} == {k: hashlib.sha256(",".join(str(i) for i in range(0, 900, 2) if i % 3 == k).encode()).hexdigest() for k in range(3)}


def test_queue_spills_and_keeps_order():
    random.seed(2)
    rows = [(random.randrange(40), random.randrange(40), i, i) for i in range(3000)]
    queue, out = prefix_trie.SpillingQueue(50), []
    for i, row in enumerate(rows):
        queue.push(row)
    for key in [(10, 5), (10, 39), (39, 39)]:
        popped = list(queue.pop_to(key))
        assert all(r[:2] <= key for r in popped)
        out += popped
    assert sorted(out) == sorted(rows) and len(queue.runs) == 0
