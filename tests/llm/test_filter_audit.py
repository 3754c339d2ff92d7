import itertools
import random

from pyspark.sql import types as T

from subrecon.llm import filter_audit as A

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()),
                       T.StructField("toxic", T.IntegerType()), T.StructField("part", T.StringType())])


def failing(rows):
    """Letters that each (doc_id, text, lang) fails."""
    lowest = {}
    for i, t, _ in rows:
        if i is not None:
            lowest[t or ""] = min(i, lowest.get(t or "", i))
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t) if x]
        f = set()
        if len(w) < 200:
            f.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            f.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t):
            f.add("C")
        if set(t) & set("#$%&*|"):
            f.add("D")
        if i is not None and lowest[t] < i:
            f.add("E")
        out.append(f)
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, x in labels if x == 1 and i is not None}
    fails = failing(rows)
    out = {}
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                total[letter] += len(gone)
                out[part, "".join(order), step] = (
                    len(left), len(gone), sum(letter in f for _, f in own) - len(gone),
                    sum(f == {letter} for _, f in own), sum(i in good for i, _ in gone), sum(i in bad for i, _ in gone))
        for key in out:
            if key[0] == part:
                out[key] += (total[key[1][key[2] - 1]],)
    return out


def audited(spark, docs, labels):
    got = A.audit(A.cells(A.masks(docs), spark.createDataFrame([(*r, "x") for r in labels], LABELS)))
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[m] for m in (*A.METRICS, "shapley")) for r in got.collect()}


def sample_rows():
    rng = random.Random(8)
    rows = []
    for i in range(150):
        n = rng.choice([0, 1, 150, 199, 200, 201, 260])
        w = [f"w{rng.randrange(rng.choice([20, 5000]))}" for _ in range(n)]
        if rng.random() < 0.3:
            w = [x.upper() for x in w]
        if rng.random() < 0.3 and w:
            w[0] += rng.choice("#$%&*|")
        rows.append((i, rng.choice([" ", "\n", " \t", "  "]).join(w), rng.choice(["en", "de", None, ""])))
    rows += [(1000 + i, rows[i % 40][1], rng.choice(["en", "fr"])) for i in range(80)]
    return rows


def test_matches_brute_force(spark, docs_of):
    rows = sample_rows()
    rng = random.Random(9)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 1080, 2)] * 2 + [(None, 1, 1)]
    want = brute(rows, labels)
    assert audited(spark, docs_of(rows).repartition(3), labels) == want
    assert len(want) == 4 * 600


def test_odd_rows(spark, docs_of):
    rows = [(1, None, "en"), (2, "", "en"), (3, None, None), (None, "", "en"), (None, None, "en"), (4, "a b", "en"),
            (4, "a b", "en"), (5, "a b", "en"), (0, "A" * 500_000, "en"), (6, "w " * 300_000, "en"), (7, "É " * 300, "fr")]
    labels = [(1, 1, None), (1, 0, 1), (4, 1, 0)]
    assert audited(spark, docs_of(rows), labels) == brute(rows, labels)


def test_empty_table(spark, docs_of):
    assert audited(spark, docs_of([]), [(1, 1, 1)]) == {}


def test_enumeration_is_a_recursion_over_325_prefixes(spark):
    walk = A.enumeration(spark)
    assert "Recursion" in walk._jdf.queryExecution().analyzed().toString() or "UnionLoop" in \
        walk._jdf.queryExecution().analyzed().toString()
    assert walk.select("prefix").distinct().count() == 325 and walk.count() == 325 * 32


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "en", 5, "k"), (2, "a b", "en", 6, "k")],
                                 "doc_id long, text string, lang string, mask int, digest string")
    assert {r["mask"] for r in A.masks(docs).collect()} == {1, 17}
