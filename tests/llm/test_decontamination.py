import re

from subrecon.llm import decontamination as dc

WORDS = [f"w{i}" for i in range(400)]


def split(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items, window=13):
    out = []
    for i, text in docs:
        w = split(text)
        hit, found = set(), set()
        for item, t in items:
            b = split(t)
            for k in range(max(1, len(b) - window + 1) if b else 0):
                x = b[k:k + window]
                for s in range(len(w) - len(x) + 1):
                    if w[s:s + len(x)] == x:
                        hit.update(range(s, s + len(x)))
                        found.add(str(item))
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def run(spark, docs_of, docs, items, **build):
    index = dc.build_index(docs_of(docs), **build)
    items = spark.createDataFrame(items, "item_id long, text string")
    found = dc.search(index, items)
    return sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in dc.by_document(index, found).collect()], key=str)


ITEM = " ".join(WORDS[:20])
SHORT = "short item of Five words"
ITEMS = [(1, ITEM), (2, SHORT), (3, None), (4, ""), (5, "..."), (10, ITEM.upper()), (6, "the the the the the the the the the the the the the the"),
         (7, "é漢字 x"), (8, "solo")]
DOCS = [(0, f"start {ITEM} end"), (1, f"{' '.join(WORDS[3:16])}"), (2, " ".join(WORDS[3:15])), (3, None), (4, ""),
        (5, "a short item, of five WORDS! again short item of five words"), (6, "the " * 40), (7, "É漢字 x é漢字 X"),
        (8, " ".join(WORDS[7:]) + " " + ITEM), (9, "w0 w1 " * 3000), (10, "solo"), (11, " ".join(WORDS[:13]) + " " + " ".join(WORDS[5:20])),
        (None, SHORT), (12, "short item of"), (13, "five words")]


def test_against_brute_force(spark, docs_of):
    want = brute(DOCS, ITEMS)
    assert run(spark, docs_of, DOCS, ITEMS) == want
    assert run(spark, docs_of, DOCS, ITEMS, shard_bytes=200) == want


def test_blocks_of_items_give_the_same(spark, docs_of):
    index = dc.build_index(docs_of(DOCS))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = dc.search(index, items, block_words=5)
    got = sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in dc.by_document(index, found).collect()], key=str)
    assert got == brute(DOCS, ITEMS)


def test_proximity(spark, docs_of):
    item = [(1, "alpha beta gamma delta")]
    docs = [(0, "delta x gamma alpha beta"), (1, "alpha x x x x x x x x x x beta gamma delta"), (2, "alpha beta gamma delta"),
            (3, "alpha beta gamma")]
    index = dc.build_index(docs_of(docs))
    items = spark.createDataFrame(item, "item_id long, text string")
    got = {r["doc_id"]: (r["n_near_items"], r["n_hit"]) for r in dc.by_document(index, dc.search(index, items, slack=4)).collect()}
    assert got == {0: (1, 0), 1: (0, 0), 2: (1, 4), 3: (0, 0)}


def test_empty_tables_and_clashing_columns(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    index = dc.build_index(docs_of([]))
    assert dc.by_document(index, dc.search(index, items)).count() == 0
    index = dc.build_index(docs_of(DOCS).selectExpr("*", "1 AS term", "2 AS shard", "3 AS kind"))
    assert [r["n_hit"] for r in dc.by_document(index, dc.search(index, none)).collect()] == [0] * len(DOCS)


def test_contaminated_at_one_word_in_twenty(spark):
    d = spark.createDataFrame([(0, 0), (20, 1), (21, 1), (1, 1)], "n_words long, n_hit long")
    assert [r[0] for r in d.select(dc.contaminated()).collect()] == [False, True, False, True]


def test_items_without_an_id_hit(spark, docs_of):
    items = [(None, ITEM), (2**60 + 1, SHORT), (None, "solo"), (2**60 + 1, "é漢字 x")]
    want = [(i, n, hit, [x for x in found if x != "None"]) for i, n, hit, found in brute(DOCS, items)]
    assert run(spark, docs_of, DOCS, items) == want
    index = dc.build_index(docs_of(DOCS))
    found = dc.search(index, spark.createDataFrame(items, "item_id long, text string"), block_words=5)
    got = sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in dc.by_document(index, found).collect()], key=str)
    assert got == want
