"""SimHash near-duplicates: a binary trie self-join over fingerprints.

**Fingerprints.** ``fingerprints`` takes word shingles of each text and sets
each of 64 bits that more than half the shingles' XXH64 values have.

**Links.** Equal fingerprints are collapsed first (one row each, with the
smallest id), so a group of copies, however large, is one leaf. ``links``
then joins the trie of distinct fingerprints with itself: pairs of nodes are
followed together from the root, differing bits are added up, and a pair is
dropped once they exceed ``max_bits``. Two fingerprints within ``max_bits`` agree
in at least one of ``max_bits + 1`` blocks of bits; so the trie is kept in
that many bit orders, each beginning with another block, and order ``k`` only follows
pairs that agree in its first block. Each subtree below a first block is one
group of rows, joined by itself in a task. A subtree of more than
``max_subtree`` fingerprints (a block that a third of all rows share) is cut
further: its rows go to the pairs of child nodes some bits deeper (as few as make the pairs small, and at
most ``split_bits`` a round) whose differing bits are within the budget, and each such node pair is a task, until every
one is small. A row is written once for each node that its own meets: four times for two million under one node. Inside a task the pairs are followed level by level over sorted
arrays in bounded pieces, and only a spanning forest of the links found is
emitted, never all pairs of a group.

**Components.** ``components`` spreads the smallest fingerprint over the
links (large-star, small-star), with a checkpoint in each round; then one
aggregation gives each component the smallest id of its rows.

Defined results: null and empty texts have no shingles, hence fingerprint
zero, and are linked like any other; a text of fewer words than a shingle
has one shingle of all its words; repeated rows share a component; rows with
a null id link like any other and are ignored as a component's smallest id
(null if it has no other); unlike rows with the same id are not linked by it; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subrecon.llm.common import by_bytes, checkpoint_dir, staged, text_bytes

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_AZ = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes, k: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one text as an unsigned integer."""
    words = _WORD.findall(text.translate(_AZ))
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n = max(1, len(words) - k + 1)
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, 65536):
        h = np.fromiter((digest(join(words[i:i + k]), SEED) for i in range(lo, min(n, lo + 65536))), np.uint64)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fingerprint long: the 64 bits as a signed number) for every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in by_bytes(texts := text_bytes(b.column(1)), 4 << 20):
                fp = np.array([fingerprint(t, k) for t in texts[lo:hi]], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(fp)],
                                                 names=["doc_id", "fingerprint"])

    d = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return d.mapInArrow(rows, "doc_id long, fingerprint long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def _follow(a: np.ndarray, b: np.ndarray, budget: int, same: bool, top: np.ndarray, leaf: int = 24,
            piece: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (index into ``a``, index into ``b``) within ``budget`` bits.

    ``a`` and ``b`` are sorted; with ``same`` they are one array and each pair
    is given once. Node pairs (``top``: first and end row in ``a`` and ``b``,
    differing bits so far) are ranges of rows that share their leading bits;
    a stack of arrays of pairs is followed from the highest bit down, a piece
    at a time. Small pairs of nodes are compared directly.
    """
    stack = [(63, top)]
    while stack:
        level, nodes = stack.pop()
        if len(nodes) > piece:
            stack.append((level, nodes[piece:]))
            nodes = nodes[:piece]
        small = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2]) <= leaf * leaf
        if level < 0:
            small[:] = True
        for part in _leaf_pairs(a, b, nodes[small], budget, same):
            yield part
        nodes = nodes[~small]
        if not len(nodes):
            continue
        bit = np.uint64(1) << np.uint64(level)
        cuts_a, cuts_b = _cut(a, nodes[:, 0], nodes[:, 1], bit), _cut(b, nodes[:, 2], nodes[:, 3], bit)
        err = nodes[:, 4]
        children = []
        for sa, sb in ((0, 0), (1, 1), (0, 1), (1, 0)):
            lo_a, hi_a = (nodes[:, 0], cuts_a) if sa == 0 else (cuts_a, nodes[:, 1])
            lo_b, hi_b = (nodes[:, 2], cuts_b) if sb == 0 else (cuts_b, nodes[:, 3])
            e = err + (sa != sb)
            keep = (hi_a > lo_a) & (hi_b > lo_b) & (e <= budget)
            if same and (sa, sb) == (1, 0):  # of two equal nodes, (0, 1) stands for (1, 0)
                keep &= nodes[:, 0] != nodes[:, 2]
            children.append(np.stack([lo_a, hi_a, lo_b, hi_b, e], axis=1)[keep])
        stack.append((level - 1, np.concatenate(children)))


def _cut(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where, in each range of equal leading bits, ``bit`` becomes 1."""
    first = x[lo] & ~(bit - np.uint64(1)) | bit
    return np.clip(np.searchsorted(x, first), lo, hi)


def _leaf_pairs(a, b, nodes, budget, same, room: int = 1 << 21):
    size = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2])
    lo = 0
    while lo < len(nodes):
        hi = lo + max(1, int(np.searchsorted(np.cumsum(size[lo:]), room, side="right")))
        n, s = nodes[lo:hi], size[lo:hi]
        if len(n) == 1 and s[0] > room:  # one pair of large nodes at the last level: equal rows
            for r in range(n[0, 0], n[0, 1]):
                j = np.arange(n[0, 2], n[0, 3])
                yield from _near(a, b, np.full(len(j), r), j, budget, same)
        else:
            at = np.repeat(np.arange(len(n)), s)
            k = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
            width = (n[:, 3] - n[:, 2])[at]
            yield from _near(a, b, n[at, 0] + k // width, n[at, 2] + k % width, budget, same)
        lo = hi


def _near(a, b, i, j, budget, same):
    keep = _popcount(a[i] ^ b[j]) <= budget
    if same:
        keep &= i < j
    if keep.any():
        yield i[keep], j[keep]


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index of each row's component, over pairs taken a piece at a time."""
    parent = np.arange(n)
    for i, j in pairs:
        while True:  # hook the larger root under the smaller, then flatten
            pi, pj = parent[i], parent[j]
            apart = pi != pj
            if not apart.any():
                break
            i, j = i[apart], j[apart]
            hi, lo = np.maximum(pi, pj)[apart], np.minimum(pi, pj)[apart]
            np.minimum.at(parent, hi, lo)
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
    return parent


def _rotated(fp: np.ndarray, by: int) -> np.ndarray:
    if by == 0:
        return fp
    return (fp << np.uint64(by)) | (fp >> np.uint64(64 - by))


def _near_links(budget: int):
    """Forest of the links in one group of rows of one bit order.

    Groups with unlike ``left`` and ``right`` hold a pair of nodes, named by their leading ``depth``
    bits. Others hold whole subtrees of ``depth`` leading bits, each joined with itself.
    """

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        turn, depth, left, right = (int(pdf[c].iloc[0]) for c in ("turn", "depth", "left", "right"))
        fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        rot = np.sort(_rotated(fp, turn))
        node = rot >> np.uint64(64 - depth)
        if left != right:
            side = node != np.int64(left).view(np.uint64)
            rot, cut = np.r_[rot[~side], rot[side]], int((~side).sum())
            top = np.array([[0, cut, 0, len(rot) - cut, 0]], np.int64)
            pairs = ((i, j + cut) for i, j in _follow(rot[:cut], rot[cut:], budget, False, top))
        else:
            edge = np.flatnonzero(np.diff(node)) + 1
            lo, hi = np.r_[0, edge], np.r_[edge, len(rot)]
            pairs = _follow(rot, rot, budget, True, np.stack([lo, hi, lo, hi, 0 * lo], axis=1))
        root = _forest(len(rot), pairs)
        linked = root != np.arange(len(rot))
        fp = _rotated(rot, (64 - turn) % 64)
        return pd.DataFrame({"a": fp[root[linked]].view(np.int64), "b": fp[linked].view(np.int64)})
    return join


def _blocks(max_bits: int) -> list[tuple[int, int]]:
    """(rotation, width) of each block: ``max_bits + 1`` of nearly equal widths."""
    n = max_bits + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _masks(bits: int, budget: int) -> list[int]:
    return [m for m in range(1 << bits) if m.bit_count() <= budget]


_ROTATED = "CASE WHEN turn = 0 THEN fp ELSE shiftleft(fp, turn) | shiftrightunsigned(fp, 64 - turn) END"


def _own() -> Column:
    """The node of a row: the leading ``depth`` bits of its fingerprint in the bit order."""
    return F.expr(f"shiftrightunsigned({_ROTATED}, 64 - depth)")


def links(prints: DataFrame, max_bits: int = MAX_BITS, max_subtree: int = 1_000_000, split_bits: int = 6,
          group_rows: int = 20_000) -> DataFrame:
    """(a, b) pairs of distinct fingerprints: for every two within ``max_bits``, a path of pairs.

    ``prints`` has one column ``fp`` (long) of distinct fingerprints. A task joins up to ``max_subtree`` of
    them under one node (some 32 bytes each); small subtrees share tasks of about ``group_rows``.
    """
    n = prints.count()
    join = _near_links(max_bits)
    turned = F.array(*[F.struct(F.lit(t).alias("turn"), F.lit(w).alias("depth")) for t, w in _blocks(max_bits)])
    rows = prints.select("fp", F.explode(turned).alias("t")).select("fp", "t.*").select("fp", "turn", "depth", _own().alias("top"))
    sizes = rows.groupBy("turn", "top").agg(F.count("*").alias("__n")).where("__n > 1")
    sizes = staged(sizes, "simhash-subtrees")
    buckets = max(1, -(-n // group_rows))
    small = rows.join(sizes.where(F.col("__n") <= max_subtree).select("turn", "top"), ["turn", "top"], "left_semi")
    none = F.lit(0).cast("long")
    small = small.select("fp", "turn", "depth", none.alias("left"), none.alias("right"),
                         F.pmod(F.xxhash64("top"), F.lit(buckets)).alias("bucket"))
    result = small.groupBy("turn", "bucket").applyInPandas(join, "a long, b long")
    large = sizes.where(F.col("__n") > max_subtree)
    largest = large.agg(F.max("__n")).first()[0]
    if largest is not None:
        rows = rows.join(large.select("turn", "top"), ["turn", "top"], "left_semi").select(
            "fp", "turn", "depth", F.col("top").alias("left"), F.col("top").alias("right"))
        for pairs in _split(rows, largest, max_bits, max_subtree, split_bits):
            result = result.unionByName(pairs.groupBy("turn", "left", "right").applyInPandas(join, "a long, b long"))
    return result


def _split(rows: DataFrame, largest: int | None, max_bits: int, max_subtree: int, split_bits: int) -> Iterator[DataFrame]:
    """Cut pairs of nodes into pairs of deeper nodes until each is small; a table of small ones a round.

    ``rows`` (fp, turn, depth, left, right) has a pair's nodes by their leading ``depth`` bits, a node with itself twice;
    ``largest`` is the most rows of a pair. A row is copied once for each node that its own meets, so a round goes
    no deeper than it must, and rows of pairs with an empty side are not written.
    """
    key, step, was = ["turn", "left", "right"], 0, None
    depth = max(w for _, w in _blocks(max_bits))
    while largest is not None:
        wanted = max(1, math.ceil(math.log2(2 * largest / max_subtree)))
        if was is not None and 4 * largest > 3 * was:  # the last bits hardly told rows apart
            wanted = max(wanted, 2 * step)
        step = min(split_bits, 64 - depth, wanted)
        depth += step
        masks = F.array(*[F.lit(m).cast("long") for m in _masks(step, max_bits)])
        met = F.when(_own() == F.col("left"), F.col("right")).otherwise(F.col("left"))
        rows = rows.select("fp", "turn", (F.col("depth") + step).alias("depth"), met.alias("met"), F.explode(masks).alias("x"))
        bits = _own().bitwiseAND(F.lit((1 << step) - 1).cast("long")).bitwiseXOR(F.col("x"))
        other = F.shiftleft("met", step).bitwiseOR(bits)
        rows = (rows.select("fp", "turn", "depth", F.least(_own(), other).alias("left"), F.greatest(_own(), other).alias("right"))
                .where(F.bit_count(F.col("left").bitwiseXOR(F.col("right"))) <= max_bits))
        last = depth >= 64
        sizes = rows.groupBy(*key).agg(F.count("*").alias("__n"), F.min(_own()).alias("__l"), F.max(_own()).alias("__h"))
        # a pair with an empty side has no links, nor has a single leaf with itself
        live = staged(sizes.where("__n > 1 AND (left = right OR __l < __h)").select(
            *key, "__n", (F.lit(last) | (F.col("__n") <= max_subtree)).alias("fits")), "simhash-sizes")
        rows = staged(rows.join(live.select(*key, "fits"), key), "simhash-nodes")
        yield rows.where("fits").drop("fits")
        was, largest = largest, live.where("NOT fits").agg(F.max("__n")).first()[0]
        rows = rows.where("NOT fits").drop("fits")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` (a, b), for every node that has any.

    Alternates large-star and small-star until nothing changes; each round is
    checkpointed to shared storage.
    """
    checkpoint_dir(edges.sparkSession)
    pairs = (edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
             .where("u <> v").distinct().checkpoint())
    mark = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        pairs = (small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(small.select("u", F.col("m").alias("v"))).distinct().checkpoint())
        was, mark = mark, tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if mark == was:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))


def grouped(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``prints`` (doc_id, fingerprint; written)."""
    groups = staged(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("low")), "simhash-groups")
    # fingerprints are the nodes, whatever ids their rows have; a component is named once it is whole
    roots = components(links(groups.select("fp"), max_bits))
    rooted = staged(groups.join(roots, groups["fp"] == roots["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    # written, so that both sides of the join are shuffles and a large component can be split
    named = staged(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "simhash-named")
    by_print = rooted.select("fp", "root").join(named, "root")
    return (prints.join(by_print, prints["fingerprint"] == by_print["fp"])
            .select("doc_id", "fingerprint", "component_id"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE_WORDS,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    return grouped(staged(fingerprints(docs, doc_id, text, k), "simhash-prints"), max_bits)
