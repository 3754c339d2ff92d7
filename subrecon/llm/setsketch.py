"""MinHash near-duplicates: SetSketch registers, banded, jointly estimated, then verified.

**Registers.** A document's set is its distinct word shingles. For each of
``REGISTERS`` hash functions the smallest hash over the set, taken as an exponential variate of rate
``RATE``, is truncated to the exponentially spaced value ``floor(1 - log_BASE(h))`` between 0 and
``TOP``: 16 bits. Registers of a union are the larger of each (``merged``), so long
texts are sketched in pieces. Two sets agree in a register with about the probability of their
similarity, which makes bands of registers locality-sensitive.

**Search.** Equal sets are one node. Registers are cut into bands of ``ROWS``; nodes that
agree in a whole band share a bucket; a pair is looked at in the first band in which it agrees.
A pair at the threshold misses all bands once in 2 * 10^7. Of the pairs in a bucket, those of incompatible sizes are dropped
exactly; for the others the counts of larger, smaller and equal registers and the two exact set sizes
give the joint likelihood of the similarity, and a pair is dropped if its most likely similarity is
below the threshold and ``RATIO`` more likely (in logarithm) than the threshold itself: five
standard deviations.

**Links.** Only a spanning forest of the remaining pairs is verified, never all pairs of a
group: two documents need no check once they are known to hang together.
Forest edges are verified on full sets, recomputed from the texts of the nodes involved. Where an edge fails,
the nodes of its tree go to the task again, now with their full sets, and every likely pair of them that is not yet
connected is judged there exactly; so a failed edge hides no link.

**Hot buckets.** A bucket of more than ``hot`` nodes, or of larger sets than a task should hold, is dealt in
chunks, each joined with itself; then every node outside the bucket's largest component is sent to every
chunk. So a group of near copies costs one more pass, not the square of its size, and no pair is left out.

Defined results: null and empty texts and texts without words have the empty set and are linked with
nothing; a text of fewer words than a shingle has one shingle of all its words; texts of any length
are read whole, in pieces; repeated rows have equal sets, so they share a component; rows with
a null id link like any other and are ignored as a component's smallest id; a component without
any id has the component id null, and its rows count as kept; unlike rows with the same id are not linked by
it; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subrecon.llm.common import SPACED, by_bytes, mix64, sent_if_small, staged, text_bytes, words_of
from subrecon.llm.simhash import components

SHINGLE_WORDS = 2
PERCENT = 80
REGISTERS = 128
ROWS = 4
BANDS = REGISTERS // ROWS
BASE = 1.001
RATE = 20.0
TOP = 65_535
RATIO = 12.5
#: Odd multipliers of the register hashes: splitmix of 1, 2, ...
_MULTIPLIERS = mix64(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_TURN = np.uint64(0xD1342543DE82EF95)
_SPACE = b" \t\n\x0b\x0c\r"


def _shingled(words: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word shingles of runs of words of the same text, and their text."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = mix64(h * _TURN + words[i:i + n] + np.uint64(i + 1))
    whole = text[:n] == text[k - 1:]
    return h[whole], text[:n][whole]


def _short(words: np.ndarray) -> np.uint64:
    """Hash of a whole sequence of fewer words than a shingle."""
    h = np.zeros(1, np.uint64)
    for i, w in enumerate(words):
        h = mix64(h * _TURN + w + np.uint64(i + 1))
    return mix64(h + np.uint64(len(words)))[0]


def long_pieces(text: bytes, limit: int) -> Iterator[bytes]:
    """A long text in pieces of about ``limit`` bytes that end where a word does."""
    lo = 0
    while lo < len(text):
        hi = min(len(text), lo + limit)
        while hi < len(text) and text[hi] not in _SPACE:  # the next white space of any kind
            hi = min((p for c in _SPACE if (p := text.find(bytes([c]), hi, hi + limit)) >= 0), default=min(len(text), hi + limit))
        yield text[lo:hi]
        lo = hi


def sets_of(texts: list[bytes], k: int = SHINGLE_WORDS, limit: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text (UTF-8), sorted within it, and where each text's begin and end."""
    found: list[np.ndarray] = []
    if len(texts) == 1 and len(texts[0]) > limit:
        last, parts, count = np.empty(0, np.uint64), [], 0
        for piece in long_pieces(texts[0], limit):
            words = np.r_[last, words_of([piece], SPACED).hashes()]
            count += len(words) - len(last)
            parts.append(np.unique(_shingled(words, np.zeros(len(words), np.int64), k)[0]))
            last = words[max(0, len(words) - k + 1):]
        h = np.unique(np.concatenate(parts)) if count >= k else np.array([_short(last)] if count else [], np.uint64)
        return h, np.array([0, len(h)])
    w = words_of(texts, SPACED)
    words = w.hashes()
    h, text = _shingled(words, w.text, k)
    few = np.flatnonzero((w.count > 0) & (w.count < k))
    if len(few):
        begins = np.cumsum(w.count) - w.count
        found = [_short(words[begins[t]:begins[t] + w.count[t]]) for t in few]
        h, text = np.r_[h, np.array(found, np.uint64)], np.r_[text, few]
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.r_[0, np.cumsum(np.bincount(text, minlength=len(texts)))]


def registers(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Registers (sets x REGISTERS) of the sets that begin at ``starts`` in ``h`` (none is empty)."""
    smallest = np.empty((len(starts), REGISTERS), np.uint64)
    for i, m in enumerate(_MULTIPLIERS):
        smallest[:, i] = np.minimum.reduceat(h * m, starts)
    uniform = (smallest.astype(np.float64) + 0.5) * 2.0 ** -64
    exponential = -np.log1p(-np.minimum(uniform, 1 - 2.0 ** -53)) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def sketch_set(h: np.ndarray, at_once: int = 1 << 16) -> np.ndarray:
    """Registers of one set, some elements at a time."""
    out = np.zeros(REGISTERS, np.uint16)
    for lo in range(0, len(h), at_once):
        out = merged(out, registers(h[lo:lo + at_once], np.array([0]))[0])
    return out


def _p(x: np.ndarray) -> np.ndarray:
    """Probability that a register is larger, for a part ``x`` of the two set sizes' sum."""
    return -np.log1p(-np.maximum(x, 0) * ((BASE - 1) / BASE)) / np.log(BASE)


def log_likelihood(j: np.ndarray | float, larger, smaller, equal, n_a, n_b) -> np.ndarray:
    """Of similarity ``j``, given how often a register of a is larger, smaller, equal, and the set sizes."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    a, b = _p(u - v * j), _p(v - u * j)
    tiny = 1e-12
    return (larger * np.log(np.maximum(a, tiny)) + smaller * np.log(np.maximum(b, tiny))
            + equal * np.log(np.maximum(1 - a - b, tiny)))


def estimated(larger, smaller, equal, n_a, n_b, steps: int = 14) -> np.ndarray:
    """The most likely similarity: the likelihood is concave in it, so halving by the sign of its slope finds it."""
    u = n_a / (n_a + n_b)
    v, c, tiny = 1 - u, (BASE - 1) / BASE, 1e-12
    lo = np.zeros(len(larger))
    hi = np.minimum(n_a / n_b, n_b / n_a).astype(float)
    for _ in range(steps):
        j = (lo + hi) / 2
        x, y = u - v * j, v - u * j
        a, b = _p(x), _p(y)
        # slopes of a and b against the similarity, but for a common factor
        da, db = v / (1 - x * c), u / (1 - y * c)
        rises = equal * (da + db) / np.maximum(1 - a - b, tiny) > (
            larger * da / np.maximum(a, tiny) + smaller * db / np.maximum(b, tiny))
        lo, hi = np.where(rises, j, lo), np.where(rises, hi, j)
    return (lo + hi) / 2


def compared(sketch: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, band: np.ndarray, percent: int,
             at_once: int = 1 << 13) -> np.ndarray:
    """Most likely similarity of each pair of rows, or -1 where the pair is dropped.

    A pair is met in every band in which it agrees; all but the first of them drop it.
    """
    out = np.full(len(i), -1.0)
    bands = sketch.view("<u8")  # ROWS registers of 16 bits
    met = np.flatnonzero(100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
    least = percent / 100
    for lo in range(0, len(met), at_once):
        at = met[lo:lo + at_once]
        at = at[(bands[i[at]] == bands[j[at]]).argmax(axis=1) == band[at]]
        a, b = sketch[i[at]], sketch[j[at]]
        larger, equal = (a > b).sum(axis=1), (a == b).sum(axis=1)
        counts = [larger, REGISTERS - larger - equal, equal, n[i[at]].astype(float), n[j[at]].astype(float)]
        # the likelihood is concave, so a few similarities below the threshold bound the best one from below
        here = log_likelihood(least, *counts)
        guesses = np.linspace(0, least, 9)[:-1, None]
        far = (log_likelihood(guesses, *counts) - here > RATIO).any(axis=0)
        at, counts = at[~far], [c[~far] for c in counts]
        out[at] = estimated(*counts)
    return out


class _Groups:
    """Labels of nodes that merge."""

    def __init__(self, label: np.ndarray):
        self.label = np.unique(label, return_inverse=True)[1]

    def apart(self, a: int, b: int) -> bool:
        return self.label[a] != self.label[b]

    def join(self, a: int, b: int) -> None:
        self.label[self.label == self.label[b]] = self.label[a]


def _likeliest(guess: np.ndarray) -> np.ndarray:
    """Places of the pairs that are not dropped, the likeliest first."""
    at = np.flatnonzero(guess >= 0)
    return at[np.argsort(-guess[at], kind="stable")]


def _pivots(members: np.ndarray, groups: _Groups, against) -> None:
    """Forest over one bucket: a member at a time is compared with all of other groups.

    Members of the largest group need no turn, once all others had theirs.
    """
    done = np.zeros(len(members), bool)
    while True:
        label = groups.label[members]
        kinds, size = np.unique(label, return_counts=True)
        left = ~done & ((label != kinds[size.argmax()]) | (size.max() == 1))
        if len(kinds) == 1 or not left.any():
            return
        p = int(left.argmax())
        done[p] = True
        against(members[p], members[label != label[p]])


def _forest(percent: int, exact: bool, few: int = 16, at_once: int = 64):
    """Edges of a spanning forest over the pairs of one task's buckets: the likely ones or, with ``exact``, the linked."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        unique = pdf.drop_duplicates("node").sort_values("node")
        nodes, n, comp = (unique[c].to_numpy() for c in ("node", "n", "comp"))
        sketch = np.frombuffer(b"".join(unique["sketch"]), "<u2").reshape(-1, REGISTERS)
        sets = [np.frombuffer(x, np.uint64) for x in unique["set"]] if exact else None
        row = np.searchsorted(nodes, pdf["node"].to_numpy())
        bucket, band, probe = pdf["bucket"].to_numpy(), pdf["band"].to_numpy(), pdf["probe"].to_numpy(bool)
        groups, edges = _Groups(comp), []

        def link(a: int, b: int) -> None:
            edges.append((min(a, b), max(a, b)))
            groups.join(a, b)

        def against(p: int, others: np.ndarray, of_band: int) -> None:
            """Link ``p`` with each other group that has a pair with it."""
            guess = compared(sketch, n, np.full(len(others), p), others, np.full(len(others), of_band), percent)
            likely = np.flatnonzero(guess >= 0)
            others = others[likely[np.argsort(-guess[likely], kind="stable")]]
            while len(others):
                others = others[groups.label[others] != groups.label[p]]
                some, others = others[:at_once], others[at_once:]
                for o in some[similar(sets[p], [sets[o] for o in some], percent)] if exact and len(some) else some:
                    if groups.apart(p, o):
                        link(p, o)

        own = np.flatnonzero(~probe)
        order = own[np.lexsort((row[own], bucket[own]))]
        if probe.any():  # one hot bucket: nodes outside its largest component against a chunk of it
            chunk = np.unique(row[own])
            for p in np.unique(row[probe]):
                against(p, chunk[groups.label[chunk] != groups.label[p]], band[0])
            order = order[:0]
        small = []
        for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            if len(at) > few:
                _pivots(row[at], groups, lambda p, others, b=band[at[0]]: against(p, others, b))
            elif len(at) > 1:
                i, j = np.triu_indices(len(at), 1)
                small.append(np.stack([row[at[i]], row[at[j]], band[at[i]]], axis=1))
        if small:
            pairs = np.concatenate(small)
            pairs = pairs[groups.label[pairs[:, 0]] != groups.label[pairs[:, 1]]]
            guess = compared(sketch, n, pairs[:, 0], pairs[:, 1], pairs[:, 2], percent)
            pairs, guess = pairs[guess >= 0], guess[guess >= 0]
            # the likeliest tier first; within it the lowest nodes, so that tasks choose alike
            for a, b, _ in pairs[np.lexsort((pairs[:, 1], pairs[:, 0], -np.digitize(guess, [0.84, 0.9])))].tolist():
                if groups.apart(a, b) and (not exact or similar(sets[a], [sets[b]], percent)[0]):
                    link(a, b)
        a, b = np.array(edges, np.int64).reshape(-1, 2).T
        return pd.DataFrame({"task": pdf["task"].iloc[0], "tree": groups.label[a], "a": nodes[a], "b": nodes[b],
                             "comp_a": comp[a], "comp_b": comp[b]})
    return run


EDGES = "task string, tree long, a long, b long, comp_a long, comp_b long"


def similar(x: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether each of the other sets reaches the similarity with ``x`` (none empty; distinct, sorted values)."""
    size = np.array([len(y) for y in others])
    every = np.concatenate(others)
    hit = x[np.minimum(np.searchsorted(x, every), len(x) - 1)] == every
    same = np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size)
    return 100 * same >= percent * (len(x) + size - same)


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, row, text_key, n, digest, sketch) for every row: set size, and digest and registers of the set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = text_bytes(b.column(3))
            for lo, hi in by_bytes(texts, 1 << 18):
                h, edge = sets_of(texts[lo:hi], k)
                n = np.diff(edge)
                full = np.flatnonzero(n)
                if hi - lo == 1 and n[0] > 1 << 16:
                    found = sketch_set(h)[None, :]
                else:
                    found = registers(h, edge[full]) if len(full) else None
                digest, sketch = [None] * (hi - lo), [None] * (hi - lo)
                for r, t in enumerate(full):
                    digest[t] = hashlib.blake2b(h[edge[t]:edge[t + 1]].tobytes(), digest_size=16).digest()
                    sketch[t] = found[r].astype("<u2").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo),
                     pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary())],
                    names=["doc_id", "row", "text_key", "n", "digest", "sketch"])

    d = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                    text_key(text).alias("text_key"), F.col(f"`{text}`").alias("text"))
    return d.mapInArrow(rows, "doc_id long, row long, text_key string, n long, digest binary, sketch binary")


def text_key(text: str) -> Column:
    return F.md5(F.col(f"`{text}`").cast("binary"))


#: Bytes of a member's row beside 8 bytes a shingle.
_ROW = 2 * REGISTERS + 64


def _members(reps: DataFrame, hot: int, task_bytes: int) -> DataFrame:
    """(bucket, band, node, n, sketch, chunks, bin) of the nodes of every bucket that holds more than one."""
    rows = reps.select("node", "n", "sketch", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    rows = rows.select("node", "n", "band", F.xxhash64("band", F.expr(f"substring(sketch, band * {2 * ROWS} + 1, {2 * ROWS})"))
                       .alias("bucket"))
    size, weight = F.count("*"), F.sum(8 * F.col("n") + _ROW)
    many = rows.groupBy("bucket").agg(
        F.greatest(F.ceil(size / hot), F.ceil(weight / task_bytes)).cast("int").alias("chunks"), size.alias("nodes"))
    # written, so that both sides of the join are shuffles and a hot bucket can be split
    many = staged(many.where("nodes > 1").drop("nodes"), "setsketch-buckets")
    found = staged(rows.join(sent_if_small(many), "bucket").select("bucket", "band", "node", "n", "chunks"),
                   "setsketch-found")
    total = found.where("chunks = 1").agg(F.sum(8 * F.col("n") + _ROW)).first()[0] or 0
    bins = max(1, -(-total // task_bytes))
    wide = found.join(reps.select("node", "sketch"), "node")
    return staged(wide.withColumn("bin", F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("bucket"), F.lit(bins)))),
                  "setsketch-members")


def _with_component(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """``rows`` with the component of their node: itself where it has no link yet."""
    if comps is None:
        return rows.withColumn("comp", F.col("node"))
    return rows.join(sent_if_small(comps), "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")


_OWN = ["bucket", "band", "node", "n", "sketch", "comp"]


def _local_tasks(members: DataFrame) -> DataFrame:
    """Rows of every task: the buckets of a bin, and the chunks of hot buckets."""
    rows = members.withColumn("comp", F.col("node"))
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks"))
    task = F.when(F.col("bin").isNull(), F.concat_ws(" ", "bucket", chunk)).otherwise(F.concat(F.lit("bin "), F.col("bin")))
    return rows.select(task.alias("task"), *_OWN, F.lit(False).alias("probe"))


def _hot_tasks(members: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Tiles of hot buckets: a chunk, and a block of the nodes outside the bucket's largest component."""
    large = staged(_with_component(members.where("bin IS NULL"), comps), "setsketch-large")  # read three times
    by_comp = large.groupBy("bucket", "comp").agg(F.count("*").alias("c"), F.max("chunks").alias("chunks"))
    main = by_comp.groupBy("bucket").agg(
        F.max_by("comp", F.struct("c", "comp")).alias("main"),
        F.ceil((F.sum("c") - F.max("c")) / F.sum("c") * F.max("chunks")).cast("int").alias("blocks")).where("blocks > 0")
    large = large.join(sent_if_small(staged(main, "setsketch-hot")), "bucket").withColumn(
        "chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    chunk = large.withColumn("block", each("blocks")).select(
        F.concat_ws(" ", "bucket", "chunk", "block").alias("task"), *_OWN, F.lit(False).alias("probe"))
    active = large.where("comp <> main").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks"))).drop(
        "chunk").withColumn("chunk", each("chunks")).select(
        F.concat_ws(" ", "bucket", "chunk", "block").alias("task"), *_OWN, F.lit(True).alias("probe"))
    return chunk.unionByName(active)


class _Search:
    """What a search has found so far: the components that its links make."""

    def __init__(self, reps: DataFrame, docs: DataFrame, text: str, k: int, percent: int):
        self.reps, self.docs, self.text, self.k, self.percent = reps, docs, text, k, percent
        self.components: DataFrame | None = None

    def add(self, edges: DataFrame) -> None:
        """Take in verified links (a, b; written): components over those known so far, then over all nodes."""
        for end in "ab":
            edges = _with_component(edges.withColumnRenamed(end, "node"), self.components).drop("node").withColumnRenamed(
                "comp", end)
        edges = staged(edges.where("a <> b").distinct(), "setsketch-links")
        if edges.isEmpty():
            return
        new = staged(components(edges), "setsketch-joined")
        if self.components is not None:
            old = self.components.select("node", F.col("root").alias("was"))
            moved = old.join(new.select(F.col("node").alias("was"), "root"), "was", "left").select(
                "node", F.coalesce("root", "was").alias("root"))
            # roots that joined others and nodes that had no link are in no row of the old table
            new = staged(moved.unionByName(new.join(old.select("node"), "node", "left_anti")), "setsketch-components")
        self.components = new

    def full_sets(self, nodes: DataFrame) -> DataFrame:
        """(node, set) of the given nodes, from their texts."""
        k, text = self.k, self.text
        nodes = staged(nodes.distinct(), "setsketch-nodes")
        keys = staged(self.reps.select("node", "text_key").join(sent_if_small(nodes), "node"), "setsketch-keys")
        texts = self.docs.select(text_key(text).alias("text_key"), F.col(f"`{text}`").alias("text"))
        texts = texts.join(sent_if_small(keys), "text_key").select("node", "text").dropDuplicates(["node"])

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = text_bytes(b.column(1))
                for lo, hi in by_bytes(found, 1 << 20):
                    h, edge = sets_of(found[lo:hi], k)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(lo, hi - lo),
                         pa.array([h[x:y].tobytes() for x, y in zip(edge, edge[1:])], pa.binary())], names=["node", "set"])

        return staged(texts.mapInArrow(sets, "node long, set binary"), "setsketch-sets")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b, linked) of pairs of nodes, by their full sets."""
        percent = self.percent
        full = self.full_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")))

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                both = [[np.frombuffer(s.as_buffer(), np.uint64) for s in batch.column(c)] for c in (2, 3)]
                linked = [bool(similar(x, [y], percent)[0]) for x, y in zip(*both)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())],
                                                 names=["a", "b", "linked"])

        a, b = (full.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
        return staged(pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(
            judge, "a long, b long, linked boolean"), "setsketch-judged")

    def run(self, tasks: DataFrame) -> None:
        """Add the links of the given tasks: a forest of likely pairs first, then what its failed edges hid."""
        edges = staged(tasks.groupBy("task").applyInPandas(_forest(self.percent, False), EDGES), "setsketch-edges")
        judged = self.verified(staged(edges.select("a", "b").distinct(), "setsketch-pairs"))
        found = judged.where("linked").select("a", "b")
        trees = edges.join(judged.where("NOT linked"), ["a", "b"]).select("task", "tree").distinct()
        again = edges.join(trees, ["task", "tree"]).select(
            "task", F.explode(F.array("comp_a", "comp_b")).alias("comp")).distinct()
        rows = staged(tasks.join(sent_if_small(staged(again, "setsketch-again")), ["task", "comp"], "left_semi"),
                      "setsketch-rows")
        if not rows.isEmpty():
            rows = rows.join(self.full_sets(rows.select("node")), "node")
            exact = rows.groupBy("task").applyInPandas(_forest(self.percent, True), EDGES)
            found = staged(found.unionByName(exact.select("a", "b")), "setsketch-found")
        self.add(found)


def links(reps: DataFrame, docs: DataFrame, text: str = "text", k: int = SHINGLE_WORDS, percent: int = PERCENT,
          hot: int = 500, task_bytes: int = 8 << 20) -> DataFrame | None:
    """(node, root) of every node that has a link; None if there is none. ``reps``: node, n, text_key, sketch (written)."""
    search = _Search(reps, docs, text, k, percent)
    members = _members(reps, hot, task_bytes)
    search.run(_local_tasks(members))
    if not members.where("bin IS NULL").isEmpty():
        search.run(_hot_tasks(members, search.components))
    return search.components


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE_WORDS,
                    percent: int = PERCENT, hot: int = 500, task_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    rows = staged(sketches(docs, doc_id, text, k), "setsketch-rows")
    sets = staged(rows.where("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("low")),
                  "setsketch-digests")
    reps = staged(rows.select(F.col("row").alias("node"), "n", "text_key", "sketch").join(
        sets.select("node"), "node", "left_semi"), "setsketch-nodes")
    comps = links(reps, docs, text, k, percent, hot, task_bytes)
    rooted = staged(_with_component(sets, comps), "setsketch-rooted")
    named = staged(rooted.groupBy("comp").agg(F.min("low").alias("component_id")), "setsketch-named")
    by_digest = staged(rooted.join(named, "comp").select("digest", "component_id"), "setsketch-result")
    out = rows.select("doc_id", "n", "digest").join(by_digest, "digest", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
