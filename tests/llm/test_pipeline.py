"""Each stage of the pipeline on its own input, against brute force."""

import pytest

import corpus_pipeline as cp
from llm_paths import SF_SMALL
from subrecon.llm.common import staged
from test_decontamination import brute as brute_hits
from test_packing import check_sequences
from test_simhash import brute_components, brute_print
from test_substring_dedup import brute as brute_passages

STAGES = dict(cp.STAGES)


def test_order():
    assert [n for n, _ in cp.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination",
                                        "best_fit_packing"]


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


def test_language_keeps_documents_with_a_language(spark, documents):
    extra = documents.limit(0).unionByName(documents).selectExpr("*", "'x' AS __lang", "1 AS lang_pred")
    got = STAGES["language_id"](spark, extra, SF_SMALL)
    assert got.columns == extra.columns
    kept = {r["doc_id"] for r in rows(got)}
    lettered = {r["doc_id"] for r in rows(documents) if any(c.isalpha() for c in r["text"] or "")}
    assert kept <= lettered and len(lettered - kept) <= 0.01 * len(lettered)


def test_one_document_of_each_component_stays(spark, documents):
    got = STAGES["simhash_near_dedup"](spark, documents, SF_SMALL)
    assert got.columns == documents.columns
    all_rows = rows(documents)
    comp = brute_components([r["doc_id"] for r in all_rows], [brute_print(r["text"]) for r in all_rows], 3)
    assert sorted(map(str, rows(got))) == sorted(str(r) for r in all_rows if comp[r["doc_id"]] == r["doc_id"])


def test_passages_are_cut(spark, documents):
    got = {r["doc_id"]: r for r in rows(STAGES["substring_dedup"](spark, documents, SF_SMALL))}
    want = brute_passages([(r["doc_id"], r["text"]) for r in rows(documents)])
    assert {i: r["text"] for i, r in got.items()} == {i: t for i, (t, _) in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values() if want[r["doc_id"]][1])


def test_contaminated_documents_go(spark, documents):
    items = [(r["item_id"], r["text"]) for r in rows(spark.read.parquet(f"{SF_SMALL}/benchmark.parquet"))]
    want = {i for i, n, hit, _ in brute_hits([(r["doc_id"], r["text"]) for r in rows(documents)], items)
            if not (hit and 20 * hit >= n)}
    assert {r["doc_id"] for r in rows(STAGES["benchmark_decontamination"](spark, documents, SF_SMALL))} == want


def test_run(spark, documents):
    d = documents
    for name, stage in cp.STAGES:
        d = staged(stage(spark, d, SF_SMALL), "test")
    got = rows(cp.run(spark, SF_SMALL))
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, got)) == sorted(map(key, rows(d)))
    assert check_sequences(got) <= -(-sum(r["length"] for r in got) // 2048) + 1


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_edge_rows(spark, docs_of, name):
    text = "the thing and the other of it was here for all to see in the end of that"
    odd = [(None, None, None), (None, "", None), (1, text), (1, text), (None, text), (None, text), (2, "ab " * 20_000), (3, "...")]
    d = docs_of(odd).selectExpr("*", "1 AS __key", "2 AS row", "3 AS fp", "4 AS removed", "5 AS score", "6 AS term")
    out = STAGES[name](spark, staged(d, "test-edge"), SF_SMALL)
    n = out.count()
    if name == "best_fit_packing":
        assert n >= len(odd)
    else:
        assert out.columns == d.columns
        assert n == {"simhash_near_dedup": 4, "substring_dedup": 8, "benchmark_decontamination": 8}.get(name, n)
    empty = STAGES[name](spark, staged(docs_of([]), "test-empty"), SF_SMALL)
    assert empty.count() == 0


def test_unlabelled_corpus_stays(spark, documents):
    bare = documents.withColumn("lang", documents["lang"].substr(1, 0)).selectExpr("doc_id", "text", "nullif(lang, '') AS lang",
                                                                                  "source", "n_chars")
    got = STAGES["language_id"](spark, staged(bare, "test-bare"), SF_SMALL)
    assert got.count() == documents.count()


def test_text_of_four_languages_stays(spark, documents):
    by = {}
    for r in rows(documents.where("length(text) > 400")):
        by.setdefault(r["lang"], r["text"][:300])
    assert len(by) == 4
    mixed = spark.createDataFrame([(10**6, "\n".join(by.values()), None, "s", 1200)], documents.schema)
    got = STAGES["language_id"](spark, staged(documents.unionByName(mixed), "test-mixed"), SF_SMALL)
    assert got.where("doc_id = 1000000").count() == 1


def test_two_texts_under_one_id(spark, docs_of):
    a, b, c = ("the first text is about one thing and says it at some length", "quite another text of unlike words that share no shingle",
               "a third that nobody else has written down before today at all")
    docs = staged(docs_of([(1, a), (5, b), (5, a), (5, c), (5, c), (7, b)]), "test-one-id")
    kept = sorted((r["doc_id"], r["text"]) for r in rows(STAGES["simhash_near_dedup"](spark, docs, SF_SMALL)))
    assert [t for _, t in kept].count(a) == [t for _, t in kept].count(b) == [t for _, t in kept].count(c) == 1
    assert (1, a) in kept and len(kept) == 3
