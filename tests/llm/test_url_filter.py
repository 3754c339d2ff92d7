import re
import time

from subrecon.llm import url_filter as uf
from subrecon.llm.queries import URL_RULES

URLS = [None, "", "nothing", "http://", "https://WWW.Example.COM/en/1", "http://a.example.com/en/", "http://example.com/EN/", "http://com/",
        "http://xcom/a", "http://a.net/es/1?x=1#y", "http://a.net/esx", "http://net/fr/", "http://a.com?u=http://b.net/es/",
        "ftp://Ünï.org#frag/x", "://host/p", "http://a.com", "a://b://c/d", "http://a.net/fr/\nnew", "http://h.org/12/" + "p" * 50_000]


def brute(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host) + len(r.path), default=None)


def judged(spark, rows, labelled, **params):
    pages = spark.createDataFrame(rows, "page_id long, url string")
    examples = spark.createDataFrame(labelled, "url string, blocked boolean")
    return uf.judge(pages.selectExpr("*", "1 AS host", "2 AS tokens", "3 AS row", "4 AS t"), examples, URL_RULES, **params).collect()


def test_parts_and_given_rules(spark):
    got = {r["page_id"]: r for r in judged(spark, list(enumerate(URLS)), [("http://a.org/", False)])}
    for i, u in enumerate(URLS):
        assert (got[i]["host"], got[i]["path"]) == brute(u), u
        rule = brute_rule(*brute(u))
        assert got[i]["rule"] == (rule.name if rule else None)
        assert got[i]["verdict"] == (rule.verdict if rule else "allow")


def test_mined_rules_block(spark):
    spam = [(f"http://win{i}.casino-x.org/play/{i}?ref=a", True) for i in range(40)]
    fine = [(f"http://blog{i}.good.org/play/{i}", False) for i in range(60)] + [(f"http://n{i}.casino-x.org/news/{i}", False) for i in range(50)]
    rows = [(0, "http://new.casino-x.org/play/7?ref=b"), (1, "http://new.good.org/play/7"), (2, "http://z.casino-x.org/news/1"),
            (3, "http://z.com/play?ref=q"), (4, None), (0, "http://new.casino-x.org/play/7?ref=b")]
    got = judged(spark, rows, [*spam, *fine, (None, True), ("http://q.org/", None)], min_support=0.05, min_confidence=0.8)
    verdicts = sorted((r["page_id"], r["verdict"]) for r in got)
    assert verdicts == [(0, "block"), (0, "block"), (1, "allow"), (2, "allow"), (3, "allow"), (4, "allow")]


def test_rules_against_brute_force(spark):
    import itertools
    import random

    rng = random.Random(4)
    names = [f"t{i}" for i in range(8)]
    rows = [(sorted(rng.sample(names, 4)), rng.random() < 0.4) for _ in range(200)]
    rows += [(sorted([*rng.sample(names, 3), "sure"]), True) for _ in range(20)]
    names.append("sure")
    df = spark.createDataFrame(rows, "tokens array<string>, blocked boolean")
    got = {tuple(r["tokens"]): (round(r["confidence"], 9), round(r["support"], 9)) for r in uf.mine(df, 0.05, 0.45, 1).collect()}
    found = {}
    base = sum(b for _, b in rows) / len(rows)
    for n in (1, 2, 3, 4):
        for s in itertools.combinations(names, n):
            has = [b for t, b in rows if set(s) <= set(t)]
            if has and sum(has) >= 0.05 * len(rows) and sum(has) / len(has) >= 0.45 and sum(has) / len(has) > base:
                found[s] = (sum(has) / len(has), sum(has) / len(rows))
    want = {s: (round(c, 9), round(p, 9)) for s, (c, p) in found.items()
            if not any(set(x) < set(s) and found[x][0] >= c for x in found)}
    assert got == want


def test_rules_of_any_length_and_tokens_that_go_together(spark):
    """Four tokens needed to block, and a family of forty tokens as one item."""
    need = ["a", "b", "c", "d"]
    rows = [(need + [f"x{i}"], True) for i in range(6)] + [([t for t in need if t != out], False) for out in need for _ in range(8)]
    family = [f"f{i:02d}" for i in range(40)]
    rows += [(family, True)] * 5 + [(["z"], False)] * 20
    rules = uf.mine(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), 0.01, 0.9)
    got = {tuple(r["tokens"]): (r["confidence"], [len(g) for g in r["groups"]]) for r in rules.collect()}
    assert got == {tuple(need): (1.0, [1] * 4), ("f00",): (1.0, [40])}
    urls = spark.createDataFrame([(0, need), (1, need[:3]), (2, ["f07", "q"]), (3, ["q"])], "row int, tokens array<string>")
    for max_rules in (100_000, 0):
        assert sorted(r["row"] for r in uf.match(urls, rules, max_rules=max_rules).collect()) == [0, 2]


def test_a_long_url_does_not_explode(spark):
    rows = [(f"http://h{i}.org/p", i % 2 == 0) for i in range(100)]
    long = "http://long.org/" + "/".join(f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60))
    started = time.monotonic()
    got = judged(spark, [(0, long), (1, "http://h.org/")], [*rows, (long, True)])
    assert sorted((r["page_id"], r["verdict"]) for r in got) == [(0, "allow"), (1, "allow")]
    judged(spark, [(0, long)], [*rows, *[(long, True)] * 50])
    assert time.monotonic() - started < 60


def test_tokens_of_blocked_rows_only_do_not_explode(spark):
    """24 tokens, each missing from rows of its own: every set of up to 23 of them is frequent."""
    family = [f"f{i:02d}" for i in range(24)]
    rows = [([t for t in family if t != out] + ["shared"], True) for out in family for _ in range(6)]
    rows += [(["shared", "good"], False)] * 400 + [(["good", "odd"], i < 30) for i in range(40)]
    started = time.monotonic()
    rules = uf.mine(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), 0.01, 0.5)
    got = {tuple(r["tokens"]): r["confidence"] for r in rules.collect()}
    assert got == {**{(t,): 1.0 for t in family}, ("odd",): 0.75}
    assert time.monotonic() - started < 60


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    examples = spark.createDataFrame([], "url string, blocked boolean")
    assert uf.judge(pages, examples, URL_RULES).count() == 0
