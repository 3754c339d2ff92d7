from subrecon.llm import quality_rules as qr


def judged(docs):
    return {r["doc_id"]: r for r in qr.judge(docs).collect()}


def brute(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    where = {}
    for i in range(len(w) - 2):
        where.setdefault(tuple(w[i:i + 3]), []).append(i)
    hit = {p for s in where.values() if len(s) > 1 for i in s for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))


def test_metrics_against_brute_force(docs_of):
    texts = [None, "", " \t\n", "a", "a b a b a b a b", "x y z x y z q", "l\nl\n\n \nl2\nl", "## *$%&|<> ok",
             "é ü 漢字 🙂 é ü 漢字", "a b c a b c a b c d", "w " * 5000, "a\x0bb\x0cc\rd"]
    got = judged(docs_of(texts))
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in qr.BASE_METRICS) == brute(t), t


def test_verdicts(docs_of):
    clean = " ".join(f"the word{i} of plain{i} text" for i in range(20))
    junk = " ".join(f"the%%% of$$$ thing{i}###" for i in range(40))
    shout = clean.upper()
    got = judged(docs_of([clean, junk, shout, "the short of it", "the of " * 60]))
    assert [got[i]["kept"] for i in range(5)] == [True, False, False, False, False]
    assert "symbol_ratio" in got[1]["failed_rules"] and "upper_ratio" in got[2]["failed_rules"]
    assert [got[i]["base_failed"] for i in range(5)] == [False, False, False, True, True]


def test_clashing_columns_and_empty_table(spark, docs_of):
    d = docs_of(["one two"]).selectExpr("*", "'x' AS n_words", "1 AS symbol_ratio", "2 AS kept")
    r = qr.judge(d).collect()[0]
    assert r["n_words"] == 2 and r["kept"] is False
    assert qr.judge(docs_of([])).count() == 0


def test_one_projection_without_user_functions(docs_of):
    plan = qr.judge(docs_of(["a b"]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Exchange", "Generate", "Join"))
