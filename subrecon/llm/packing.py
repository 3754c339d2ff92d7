"""Best-fit packing of token sequences by hierarchical residual packing.

**Pieces.** ``tokenise`` gives each document its token ids and an end id. A
document of more than ``capacity`` ids is cut into pieces of ``capacity`` ids,
of which the first may be shorter; others are one piece.

**Packing.** Full pieces are sequences by themselves. The rest is dealt over
groups of about ``group_pieces``; each group is packed best-fit decreasing by
one task. Bins that are nearly full (at most ``slack`` free) are final. The
others become items of the next round, where ``fan_in`` groups meet in one,
and so on up the tree until one group is left; at the top every bin is
final. A group passes on bins of at most ``carry`` pieces: beyond that, the
fullest of its open bins, which have least to gain, become final too. So no
task ever holds more than ``group_pieces`` or ``fan_in * carry`` pieces,
whatever the input. Each round is written to shared storage.

Defined results: a null text counts as empty, an empty text is the end id
alone; a text of any length is encoded whole, also one of millions of white-space characters; rows with the same id are separate documents and both are packed;
ties in length are broken by place in the group; other columns are ignored;
an empty table gives no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subrecon.llm.common import by_bytes, staged

CAPACITY = 2048
END_ID = 0
#: White space as the pattern's ``\\s`` has it, and the length from which a run of it is encoded by itself.
LONG_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{10000,}")
PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"
def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes
    stand for themselves, the others for the characters from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Ids of whole texts under the byte-level BPE vocabulary of a ``tokenizers`` file.

    The file's vocabulary is in merge order, so its ids are ranks, and
    ``tiktoken`` gives the ids of ``tokenizers`` itself (tests hold them against each other)
    in a third of the time. ``pattern`` is the file's pre-tokeniser. With ``added``,
    texts are first cut at the file's added tokens (leftmost, then longest), which get their own
    ids, as ``tokenizers`` does unless told otherwise; without, they count as ordinary text (its
    ``encode_special_tokens``). ``ids`` gives little-endian unsigned 32-bit ids, as bytes.
    """

    def __init__(self, path: str, pattern: str, added: bool = False):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        own = {t["content"]: t["id"] for t in file["added_tokens"]}
        byte = byte_of_char()
        ranks = {bytes(byte[c] for c in t): i for t, i in file["model"]["vocab"].items() if t not in own}
        self.bpe = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # a run of white space is one piece, but for its last character where a word follows; a run of
        # a million would exhaust the pattern's stack, so long ones are cut out and encoded as the piece that they are
        self.long_space = LONG_SPACE if pattern.endswith(r"|\s+(?!\S)|\s+") and r"\s*" not in pattern else None
        self.added, self.cuts = {}, None
        if added and own:
            for t in file["added_tokens"]:
                odd = [k for k in ("single_word", "lstrip", "rstrip", "normalized") if t[k]]
                if odd:
                    raise ValueError(f"added token {t['content']!r} of {path} is {', '.join(odd)}: not supported")
            self.added = own
            self.cuts = re.compile(f"({'|'.join(map(re.escape, sorted(own, key=len, reverse=True)))})")

    def _plain(self, text: str) -> list[int]:
        """Ids of a text without added tokens."""
        ids, done = [], 0
        for run in self.long_space.finditer(text) if self.long_space and len(text) >= 10_000 else ():
            end = run.end() if run.end() == len(text) else run.end() - 1
            ids += self.bpe.encode_ordinary(text[done:run.start()])
            ids += self.bpe._encode_single_piece(text[run.start():end])
            done = end
        return ids + self.bpe.encode_ordinary(text[done:])

    def _ids(self, text: str) -> list[int]:
        parts = self.cuts.split(text) if self.cuts else [text]
        ids = self._plain(parts[0])
        for token, after in zip(parts[1::2], parts[2::2]):
            ids.append(self.added[token])
            ids += self._plain(after)
        return ids

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(self._ids(t), "<u4").tobytes() for t in texts]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: only the first may be shorter."""
    count = max(1, -(-n // capacity))
    first = n - (count - 1) * capacity
    return [(0, first)] + [(first + k * capacity, capacity) for k in range(count - 1)]


def tokenise(docs: DataFrame, tokenizer_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text",
             capacity: int = CAPACITY, end_id: int = END_ID, added: bool = False) -> DataFrame:
    """One row per piece (``PIECES``); ``row`` tells rows with the same id apart; ``added`` as in ``Encoder``."""
    names = [x.split()[0] for x in PIECES.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    end = np.array([end_id], "<u4").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path, pattern, added)
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            for lo, hi in by_bytes(texts, 1 << 20):
                out: list[list] = [[] for _ in names]
                keys = zip(b.column(0).slice(lo, hi - lo).to_pylist(), b.column(1).slice(lo, hi - lo).to_pylist())
                for (doc, row), ids in zip(keys, encoder.ids(texts[lo:hi])):
                    ids += end
                    for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        crc = zlib.crc32(ids[4 * start:4 * (start + length)])
                        for c, v in zip(out, (doc, row, k, start, length, crc)):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    d = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                    F.monotonically_increasing_id().alias("row"), F.col(f"`{text}`").alias("text"))
    return d.mapInArrow(rows, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, and how full each bin is.

    Open bins are kept by free space; the least free space that fits is the
    lowest set bit of an integer with a bit for each free space in use.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fill: list[int] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        fits = used >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                used &= ~(1 << free)
        else:
            free, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        by_free[free - n].append(b)
        used |= 1 << (free - n)
    return bins, offsets, np.array(fill, np.int64)


_PACKED = PIECES + ", grp long, bin long, offset long, open boolean"


def _round(capacity: int, slack: int, carry: int, last: bool):
    """Packs one group's open bins (or, at first, its pieces) and marks which bins stay open."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bin", "offset"], kind="stable").reset_index(drop=True)
        _, item = np.unique(pdf["bin"].to_numpy(), return_inverse=True)
        length = np.bincount(item, weights=pdf["length"].to_numpy()).astype(np.int64)
        bins, offsets, fill = best_fit(length, capacity)
        pieces = np.bincount(bins, weights=np.bincount(item)).astype(np.int64)
        still = (fill < capacity - slack) & (not last)
        # emptiest first; those past the bound are final
        order = np.lexsort((np.arange(len(fill)), fill))
        order = order[still[order]]
        still[order[np.cumsum(pieces[order]) > carry]] = False
        grp = int(pdf["grp"].iloc[0])
        b = bins[item]
        return pdf.assign(bin=(grp << 32) + b, offset=pdf["offset"].to_numpy() + offsets[item], open=still[b])
    return pack


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = 20_000, fan_in: int = 8,
         carry: int = 4_000, slack: int = 8) -> DataFrame:
    """``pieces`` (written, as ``staged`` gives them) with ``sequence_id`` and ``offset``."""
    own = [x.split()[0] for x in PIECES.split(", ")]
    full = pieces.where(F.col("length") >= capacity)
    rest = pieces.where(F.col("length") < capacity)  # one a document at most: its row is its first bin
    groups = max(1, -(-rest.count() // group_pieces))
    rows = rest.select(*own, F.pmod(F.xxhash64("row"), F.lit(groups)).alias("grp"), F.col("row").alias("bin"),
                       F.lit(0).cast("long").alias("offset"))
    # full pieces are numbered below zero by their place in the written table; the others by round, group and bin
    out = full.select(*own, F.lit(0).cast("long").alias("offset"),
                      (-F.monotonically_increasing_id() - 1).alias("sequence_id"))
    level = 0
    while True:
        last = groups == 1
        packed = staged(rows.groupBy("grp").applyInPandas(_round(capacity, slack, carry, last), _PACKED),
                        f"packing-{level}", ("open",))
        out = out.unionByName(packed.where("NOT open").select(
            *own, "offset", (F.lit(level << 56) + F.col("bin")).alias("sequence_id")))
        if last:
            return out.select(*[c for c in own if c != "row"], "sequence_id", "offset")
        groups, level = -(-groups // fan_in), level + 1
        rows = packed.where("open").select(*own, F.floor(F.col("grp") / fan_in).alias("grp"), "bin", "offset")
