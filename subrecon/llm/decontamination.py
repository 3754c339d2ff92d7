"""Benchmark decontamination over a distributed positional inverted index.

**Index.** ``build_index`` cuts the training documents into shards of about
``shard_bytes`` of whole texts. For each shard it stores every term's posting
list (one row per term: the sorted word positions, packed), and one row per
document (its base position and word count). Documents lie ``GAP`` positions
apart in a shard's numbering, so no phrase or proximity match spans two. A
frequent term is spread over all shards like any other, so no task meets all
its postings.

**Search.** Test items are cut into windows of ``window`` words and handled in
blocks of item rows (by hash of a number of their own) of ``block_words`` words on average at most, one pass over the index each. Posting
counts of the test terms over the whole index (one pre-aggregated sum) give
their rarity. Only lists of the block's terms leave the index; they are grouped by shard.
There, each window begins with the list of its rarest term, shifted by the
term's place in the window, and is intersected with the shifted lists of
its other terms, next rarest first; what survives all of them is an exact
occurrence. For proximity, the same order keeps those occurrences of the rarest
term that have every other term of the window within ``window + slack - 1``
positions on either side.

Words are compared by 64-bit hashes of their bytes.

Defined results: null and empty texts have no words and match nothing; an
item of fewer words than ``window``, but not none, is one window; items or
documents that repeat are matched each, and rows with the same id are
separate documents, each reported; null document ids are kept; an item row
with a null id hits like any other and is left out of the lists and counts of items only; other
columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subrecon.llm.common import ALNUM, staged, text_bytes, words_of

WINDOW = 13
SLACK = 4
GAP = 4 * WINDOW
INDEX = "kind string, shard long, term long, n int, postings binary, row long, doc_id long, base long"


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = 4 << 20,
                gap: int = GAP) -> DataFrame:
    """The stored index: rows of ``kind`` 'doc' (``n`` words) and 'term' (``n`` postings)."""
    schema = pa.schema([("kind", pa.string()), ("shard", pa.int64()), ("term", pa.int64()), ("n", pa.int32()),
                        ("postings", pa.binary()), ("row", pa.int64()), ("doc_id", pa.int64()), ("base", pa.int64())])

    def shard_rows(ids: list, shard: int, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        w = words_of(texts, ALNUM)
        before = np.cumsum(w.count) - w.count
        base = before + gap * np.arange(len(texts))
        at = (np.arange(len(w.start)) + gap * w.text).astype("<u4")
        terms = w.hashes().view(np.int64)
        order = np.argsort(terms, kind="stable")
        terms, at = terms[order], at[order]
        first = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, np.int64)
        offsets = np.r_[first, len(terms)].astype(np.int32)
        lists = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((offsets * 4).astype(np.int32)),
                                                                pa.py_buffer(at)])
        n = len(texts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(["doc"] * n), pa.array([shard] * n, pa.int64()), pa.nulls(n, pa.int64()),
             pa.array(w.count.astype(np.int32)), pa.nulls(n, pa.binary()), pa.array(shard + np.arange(n)), pa.array(ids, pa.int64()), pa.array(base)],
            schema=schema)
        m = len(first)
        for lo in range(0, m, 20_000):
            k = min(20_000, m - lo)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["term"] * k), pa.array(np.full(k, shard)), pa.array(terms[first[lo:lo + k]]),
                 pa.array(np.diff(offsets)[lo:lo + k]), lists.slice(lo, k), *[pa.nulls(k, pa.int64())] * 3], schema=schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, shard = [], [], 0, None
        for b in batches:
            place, doc = b.column(0).to_pylist(), b.column(1).to_pylist()
            part = text_bytes(b.column(2))
            for p, i, t in zip(place, doc, part):
                if texts and size + len(t) > shard_bytes:
                    yield from shard_rows(ids, shard, texts)
                    ids, texts, size = [], [], 0
                if not texts:
                    shard = p
                ids.append(i)
                texts.append(t)
                size += len(t)
        if texts:
            yield from shard_rows(ids, shard, texts)

    # a shard is named by the place of its first row; its rows' places follow on
    d = docs.select(F.monotonically_increasing_id().alias("place"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                    F.col(f"`{text}`").alias("text"))
    return staged(d.mapInArrow(rows, INDEX), "positional-index", ("kind",))


def windows_of(items: pd.DataFrame, window: int) -> pd.DataFrame:
    """(item, terms) for each window of each item's words; ``items`` has (item, text)."""
    out: list[tuple[int, np.ndarray]] = []
    texts = [(t or "").encode() for t in items["text"]]
    w = words_of(texts, ALNUM)
    h = w.hashes().view(np.int64)
    ends = np.cumsum(w.count)
    for item, n, end in zip(items["item"], w.count, ends):
        words = h[end - n:end]
        for k in range(max(1, n - window + 1) if n else 0):
            out.append((item, words[k:k + window]))
    return pd.DataFrame(out, columns=["item", "terms"])


class _Query:
    """Windows of one block as arrays: rarest term first, padded with -1."""

    def __init__(self, win: pd.DataFrame, counts: dict[int, int], window: int):
        self.item = win["item"].to_numpy(np.int64)
        self.size = np.array([len(t) for t in win["terms"]], np.int64)
        self.vocabulary = np.unique(np.concatenate([*win["terms"], np.zeros(0, np.int64)]).astype(np.int64))
        df = np.array([counts.get(int(t), 0) for t in self.vocabulary], np.int64)
        self.term = np.full((len(win), window), -1, np.int32)
        self.place = np.zeros((len(win), window), np.int16)
        for i, t in enumerate(win["terms"]):
            v = np.searchsorted(self.vocabulary, t)
            order = np.argsort(df[v], kind="stable")
            self.term[i, :len(t)] = v[order]
            self.place[i, :len(t)] = order
        # a window with a term that no document has occurs nowhere
        self.live = np.flatnonzero([len(t) > 0 and df[self.term[i, 0]] > 0 for i, t in enumerate(win["terms"])])


def _intersect(q: _Query, lists: list, slack: int, piece: int = 1 << 20):
    """Exact starts and near places of the windows in one shard: (window, position, exact)."""
    # one sorted array of (term, position) keys over the shard's lists
    size = np.array([len(x) for x in lists], np.int64)
    begin = np.cumsum(size) - size
    base = np.uint64(1) << np.uint64(32)
    keys = np.concatenate([np.uint64(t) * base + x.astype(np.uint64) for t, x in enumerate(lists) if len(x)]
                          or [np.zeros(0, np.uint64)])
    if not len(keys):
        return
    first = q.term[q.live, 0]
    found = q.live[size[first] > 0]
    many = size[q.term[found, 0]]
    lo = 0
    while lo < len(found):
        hi = lo + max(1, int(np.searchsorted(np.cumsum(many[lo:]), piece, side="right")))
        w = np.repeat(found[lo:hi], many[lo:hi])
        k = np.arange(len(w)) - np.repeat(np.cumsum(many[lo:hi]) - many[lo:hi], many[lo:hi])
        at = (keys[begin[q.term[w, 0]] + k] % base).astype(np.int64)
        for exact in (True, False) if slack >= 0 else (True,):
            cw, cp = w, at - q.place[w, 0] if exact else at
            if exact:
                cw, cp = cw[cp >= 0], cp[cp >= 0]
            for j in range(1, q.term.shape[1]):
                t = q.term[cw, j]
                more = t >= 0
                reach = 0 if exact else q.size[cw] + slack - 1
                low = np.maximum(cp + q.place[cw, j] if exact else cp - reach, 0)
                want = np.maximum(t, 0).astype(np.uint64) * base + low.astype(np.uint64)
                i = np.searchsorted(keys, want)
                got = keys[np.minimum(i, len(keys) - 1)]
                ok = (i < len(keys)) & ((got == want) if exact else
                                        (got <= np.maximum(t, 0).astype(np.uint64) * base + (cp + reach).astype(np.uint64)))
                ok |= ~more
                cw, cp = cw[ok], cp[ok]
                if not len(cw):
                    break
            if len(cw):
                yield cw, cp, exact
        lo = hi


MATCHES = "row long, item long, item_id long, exact boolean, start int, end int"


def _shard_matches(q: _Query, ids: pd.Series, slack: int):
    """Matches of the block's windows in one shard; ``ids`` has the (nullable) id of each item row's number."""

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        docs = pdf[pdf["postings"].isna()].sort_values("base")
        terms = pdf[pdf["postings"].notna()]
        lists: list = [np.zeros(0, "<u4")] * len(q.vocabulary)
        for i, x in zip(np.searchsorted(q.vocabulary, terms["term"].to_numpy(np.int64)), terms["postings"]):
            lists[i] = np.frombuffer(x, "<u4")
        out = []
        base, row = docs["base"].to_numpy(np.int64), docs["row"].to_numpy(np.int64)
        for w, p, exact in _intersect(q, lists, slack):
            d = np.searchsorted(base, p, side="right") - 1
            start = p - base[d]
            out.append(pd.DataFrame({"row": row[d], "item": q.item[w], "exact": exact, "start": start,
                                     "end": start + (q.size[w] if exact else 1)}))
        if not out:
            return pd.DataFrame({c.split()[0]: [] for c in MATCHES.split(", ")})
        found = pd.concat(out)
        # touching occurrences of one item row in one document become one span
        found = found.sort_values(["row", "item", "exact", "start"]).reset_index(drop=True)
        g = [found[c].to_numpy() for c in ("row", "item", "exact")]
        same = np.r_[False, np.logical_and.reduce([x[1:] == x[:-1] for x in g])]
        joined = same & (found["start"].to_numpy() <= np.r_[-1, found["end"].to_numpy()[:-1]])
        span = np.cumsum(~joined)
        found = found.groupby(span).agg(row=("row", "first"), item=("item", "first"), exact=("exact", "first"),
                                        start=("start", "min"), end=("end", "max")).reset_index(drop=True)
        found.insert(2, "item_id", ids.reindex(found["item"]).array)
        return found
    return search


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW,
           slack: int = SLACK, block_words: int = 2_000_000) -> DataFrame:
    """``MATCHES``: word spans of exact occurrences, and places of proximity matches, by document row and item row.

    ``row`` is the document's in the index, ``item`` a number of the item row's own. ``slack`` below zero leaves
    proximity out.
    """
    named = staged(items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{item_id}`").cast("long").cast("string").alias("item_id"),
                                F.col(f"`{text}`").alias("text")), "benchmark-items")
    chars = named.select(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(chars) // (2 * block_words)))  # a word and its gap take two characters at least
    terms = index.where("kind = 'term'")
    found = None
    for k in range(blocks):
        # bounded by block_words
        part = named.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).toPandas()
        win = windows_of(part, window)
        if not len(win):
            continue
        vocabulary = pd.DataFrame({"term": np.unique(np.concatenate(list(win["terms"])))})
        # at most block_words numbers: sent to the tasks, so that only matching lists are shuffled
        wanted = F.broadcast(index.sparkSession.createDataFrame(vocabulary, "term long"))
        counted = terms.join(wanted, "term").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
        q = _Query(win, dict(zip(counted["term"], counted["n"])), window)
        lists = terms.join(wanted, "term", "left_semi").select(
            "shard", "term", "postings", F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("base"))
        docs = index.where("kind = 'doc'").select("shard", F.lit(0).cast("long").alias("term"), "postings", "row", "base")
        # ids come as text: beside a null, numbers would come as floats
        ids = pd.Series([None if pd.isna(i) else int(i) for i in part["item_id"]], part["item"].to_numpy(), "Int64")
        hits = lists.unionByName(docs).groupBy("shard").applyInPandas(_shard_matches(q, ids, slack), MATCHES)
        found = hits if found is None else found.unionByName(hits)
    return found if found is not None else index.sparkSession.createDataFrame([], MATCHES)


def by_document(index: DataFrame, matches: DataFrame) -> DataFrame:
    """Per document: its words, words hit by exact occurrences, the items found and items near."""
    spans = F.sort_array(F.collect_set(F.struct("start", "end")))
    hit = matches.where("exact").groupBy("row").agg(
        spans.alias("s"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    # words covered by the union of the spans
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("e"))
    covered = F.aggregate("s", none, lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], acc["e"]))).alias("n"),
        F.greatest(acc["e"], x["end"]).alias("e"))).getField("n")
    hit = hit.select("row", covered.alias("n_hit"), "items")
    near = matches.where("NOT exact").groupBy("row").agg(F.countDistinct("item_id").alias("n_near_items"))
    docs = index.where("kind = 'doc'").select("row", "doc_id", F.col("n").cast("long").alias("n_words"))
    zero = F.lit(0).cast("long")
    return (docs.join(hit, "row", "left").join(near, "row", "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                    F.coalesce("n_near_items", zero).alias("n_near_items")))


def contaminated(share: int = 20) -> Column:
    """Whether at least one word in ``share`` is hit."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
