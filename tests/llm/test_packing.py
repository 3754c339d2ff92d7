import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm_paths import SF_SMALL
from subrecon.llm import packing
from subrecon.llm.common import staged

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a", "  two  spaces\n\n\ttabs", "it's we're I'll 've", "123456 7.5%", "<|endoftext|> stays text", "漢字かな 🙂👩‍👩‍👧 é́",
       "  x​", "ñandú ÇA ßtraße", "x" * 5000, "ab " * 9000, "\x00\x01\x7f", "ര്‍"]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(PATH, public_tokenizers.PATTERN)


def check_sequences(rows, capacity=2048):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_encoder_gives_the_tokenizers_ids(reference, encoder):
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.ids(ODD)] == [
        x.ids for x in reference.encode_batch(ODD, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_encoder_on_any_text(reference, encoder, text):
    assert np.frombuffer(encoder.ids([text])[0], "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids


def test_encoder_on_the_small_table(spark, reference, encoder):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.ids(texts)] == [
        x.ids for x in reference.encode_batch(texts, add_special_tokens=False)]


def test_pieces(spark, docs_of, reference):
    texts = [None, *ODD]
    got = packing.tokenise(docs_of(texts), PATH, public_tokenizers.PATTERN).orderBy("doc_id", "piece").collect()
    want = []
    for i, t in enumerate(texts):
        ids = reference.encode(t or "", add_special_tokens=False).ids + [0]
        start = k = 0
        while start < len(ids):
            n = 2048 if k or len(ids) % 2048 == 0 else len(ids) % 2048
            crc = zlib.crc32(np.array(ids[start:start + n], "<u4").tobytes())
            want.append((i, k, start, n, crc))
            start, k = start + n, k + 1
    assert [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got] == want


def test_packs_tightly_in_rounds(spark):
    rng = np.random.default_rng(2)
    n = 3000
    rows = [(i, i, 0, 0, int(x), 0) for i, x in enumerate(rng.integers(1, 1500, n))] + [(n, n, k, 0, 2048, 0) for k in range(5)]
    pieces = staged(spark.createDataFrame(rows, packing.PIECES), "test-pieces")
    least = -(-sum(r[4] for r in rows) // 2048)
    for params in ({}, {"group_pieces": 300, "fan_in": 3, "carry": 200}, {"group_pieces": 50, "fan_in": 2, "carry": 10}):
        got = packing.pack(pieces, **params).collect()
        assert sorted((r["doc_id"], r["piece"]) for r in got) == sorted((r[0], r[2]) for r in rows)
        assert check_sequences(got) <= 1.05 * least + 2


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, fill = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert fill.tolist() == [10, 10] and (offsets + np.array([6, 5, 4, 3, 2]) <= 10).all()


def test_null_ids_repeated_rows_empty_table(spark, docs_of):
    from subrecon.llm.queries import packed

    d = docs_of([(None, "a"), (1, "b"), (1, "b"), (2, None)]).selectExpr("*", "1 AS row", "2 AS bin", "3 AS piece")
    got = packed(d).collect()
    assert sorted((str(r["doc_id"]), r["piece"]) for r in got) == [("1", 0), ("1", 0), ("2", 0), ("None", 0)]
    assert check_sequences(got) == 1
    assert packed(docs_of([])).count() == 0


def test_query_over_the_small_table(spark):
    from subrecon.llm.queries import QUERIES

    got = QUERIES["op3_best_fit_packing"](spark, SF_SMALL).collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    assert check_sequences(got) <= -(-sum(r["length"] for r in got) // 2048) + 1


ADDED = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>  x", "a  <|endoftext|>", "<|endoftext|", "<<|endoftext|>>"]


@pytest.fixture(scope="module")
def unchanged():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def added_encoder():
    return packing.Encoder(PATH, public_tokenizers.PATTERN, added=True)


def test_added_tokens_get_the_ids_of_the_unchanged_tokenizer(unchanged, added_encoder):
    got = [np.frombuffer(b, "<u4").tolist() for b in added_encoder.ids(ODD + ADDED)]
    assert got == [x.ids for x in unchanged.encode_batch(ODD + ADDED, add_special_tokens=False)]
    assert got[len(ODD)] == [64, 220, 50256, 275]


def test_query_takes_added_tokens(spark, docs_of, unchanged):
    from subrecon.llm.queries import packed

    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packed(docs_of(ADDED)).collect()}
    want = [np.array(unchanged.encode(t, add_special_tokens=False).ids + [0], "<u4") for t in ADDED]
    assert got == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(want)}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=20), st.sampled_from(["<|endoftext|>", "<|", "|>", " ", "endoftext"])), max_size=8))
def test_added_tokens_in_any_text(unchanged, added_encoder, parts):
    text = "".join(parts)
    assert np.frombuffer(added_encoder.ids([text])[0], "<u4").tolist() == unchanged.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("run", [" " * 3_000_000, "\n" * 3_000_000, "\r\n" * 1_500_000, " \n\t" * 1_000_000, "\u3000" * 400_000])
def test_long_white_space(run):
    """A run of white space is cut out of the pattern's way, and gives the ids of the unchanged tokenizer."""
    t = Tokenizer.from_file(PATH)
    encoder = packing.Encoder(PATH, public_tokenizers.PATTERN, added=True)
    for text in (run, run + "x", "x" + run, f"a b{run}c  d{run[:20_000]} .", f"{run[:15_000]}<|endoftext|>{run[:12_000]}\x1cq"):
        assert encoder._ids(text) == t.encode(text, add_special_tokens=False).ids


def test_long_white_space_is_packed(spark, docs_of):
    docs = docs_of([" " * 1_000_000 + "x", "\n" * 1_200_000, "a"])
    pieces = packing.tokenise(docs, PATH, public_tokenizers.PATTERN, added=True)
    rows = packing.pack(staged(pieces, "test-pieces")).collect()
    check_sequences(rows)
    assert {r["doc_id"] for r in rows} == {0, 1, 2}
