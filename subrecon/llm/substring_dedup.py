"""Substring de-duplication by hashed units (sentences, lines or paragraphs).

Texts are cut into units that cover them without gaps. A unit's normal form
(lower case, runs of letters and digits joined by one space) is hashed to 128
bits; digests are grouped over the whole corpus and the occurrence of the
lowest (doc_id, offset) is the one that stays. In every document, maximal
runs of neighbouring units that all occur earlier are removed when the run
has at least ``min_words`` words; a shorter run (a one-word sentence that
two documents share by chance) stays. Removed spans are reported as code
point offsets into the original text.

Shuffles: one pre-aggregation by digest (a digest holding a third of all
units is one row per task), one join of the units with the repeated digests
only (AQE splits a hot digest; no row meets more than one row), one grouping
of the repeated units by document, one join back to the texts. Nothing is
broadcast by hint or collected.

Defined results: null and empty texts have no units and pass unchanged; a text of any length is
read whole, and costs in proportion to its length and units; a
null id ranks before all others; rows with the same id and the same text
rank alike, so each keeps what the first keeps; repeats inside a document
count like repeats across documents; other columns pass through; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subrecon.llm.common import staged

MIN_WORDS = 10

#: A unit: text up to and with its end marks and the white space behind them.
UNITS = {
    "sentence": r"[^.!?\n]*[.!?\n]+[ \t\r\n]*|[^.!?\n]+",
    "line": r"[^\n]*\n+|[^\n]+",
    "paragraph": r"(?:[^\n]+\n?)+\n*|\n+",
}
NOT_WORD = r"[\W_]+"
KEY = ("__id", "__th")


def _unit_rows(unit: str):
    find, gap = re.compile(UNITS[unit]).finditer, re.compile(NOT_WORD)
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("__id", pa.int64()), ("__th", pa.int64()),
                        ("at", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in schema]

            def flush(cols=cols):
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

            for i in range(batch.num_rows):
                doc, th, text = (batch.column(k)[i].as_py() for k in range(3))
                at = 0
                for m in find(text or ""):
                    norm = gap.sub(" ", m.group().lower()).strip(" ")
                    if not norm:
                        continue
                    d = xxhash.xxh3_128_digest(norm)
                    for c, v in zip(cols, (int.from_bytes(d[:8], "little", signed=True),
                                           int.from_bytes(d[8:], "little", signed=True),
                                           doc, th, at, m.start(), m.end(), norm.count(" ") + 1)):
                        c.append(v)
                    at += 1
                if len(cols[0]) > 100_000:
                    yield flush()
                    cols = [[] for _ in schema]

                    def flush(cols=cols):
                        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)],
                                                          schema=schema)
            yield flush()
    return rows


UNIT_SCHEMA = "h1 long, h2 long, __id long, __th long, at int, start int, end int, words int"


def units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "sentence") -> DataFrame:
    """One row per unit with words: its digest, document, place and length."""
    d = docs.select(F.col(f"`{doc_id}`").cast("long").alias("__id"), F.xxhash64(F.col(f"`{text}`")).alias("__th"),
                    F.col(f"`{text}`").alias("__text"))
    return d.mapInArrow(_unit_rows(unit), UNIT_SCHEMA)


def repeated_units(u: DataFrame) -> DataFrame:
    """The units whose digest occurs at an earlier (document, offset)."""
    first = F.min(F.struct("__id", "__th", "start")).alias("first")
    groups = (u.groupBy("h1", "h2").agg(first, F.count("*").alias("n")).where("n > 1")
              .select("h1", "h2", F.col("first.__id").alias("i0"), F.col("first.__th").alias("t0"),
                      F.col("first.start").alias("s0")))
    groups = staged(groups, "substring-digests")  # so both sides of the join are shuffled, and AQE can split a hot digest
    earlier = ~(F.col("__id").eqNullSafe(F.col("i0")) & (F.col("__th") == F.col("t0"))
                & (F.col("start") == F.col("s0")))
    return u.join(groups, ["h1", "h2"]).where(earlier).select(*KEY, "at", "start", "end", "words")


def removable_spans(repeats: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per document, its removable runs as ``removed`` array<struct<start,end>>.

    Neighbours have the same place minus rank, so one sort by document finds the runs; rows of the same id and text
    share their ranks. The list is bounded by the document's own runs.
    """
    by_place = Window.partitionBy(*KEY).orderBy("at")
    rows = repeats.withColumn("__run", F.col("at") - F.dense_rank().over(by_place)).withColumn(
        "__new", ~F.col("at").eqNullSafe(F.lag("at").over(by_place)))
    runs = rows.groupBy(*KEY, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"),
                                           F.sum(F.when(F.col("__new"), F.col("words"))).alias("words"))
    return runs.where(F.col("words") >= min_words).groupBy(*KEY).agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed"))


def without(text: str, start: list[int], end: list[int]) -> str:
    """``text`` without the given spans (code points, ascending)."""
    return "".join(text[a:b] for a, b in zip([0, *end], [*start, len(text)]))


def _cut(text: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else without(t, a, b) for t, a, b in zip(text, start, end)])


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "sentence",
          min_words: int = MIN_WORDS, names: tuple[str, str] = ("removed", "original_chars")) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``.

    Adds two columns, named ``names``: the removed spans (array<struct<start,end>> of code point
    offsets into the original text, null where nothing went) and the original length.
    """
    spans = removable_spans(repeated_units(units(docs, doc_id, text, unit)), min_words)
    spans = staged(spans, "substring-spans").select(F.col("__id").alias("__i"), F.col("__th").alias("__t"),
                                                    F.col("removed").alias("__r"))
    own = [c for c in docs.columns if c not in names]
    t = F.col(f"`{text}`")
    d = docs.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{doc_id}`").cast("long").alias("__id"),
                    F.xxhash64(t).alias("__th"))
    j = d.join(spans, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__th") == F.col("__t")), "left")
    r = F.col("__r")
    n = F.length(t)
    # what stays lies between the removed spans; only texts that lose something go to Python, where a cut costs its length
    rest = F.pandas_udf(_cut, "string")(F.when(r.isNotNull(), t), F.transform(r, lambda x: x.getField("start")),
                                        F.transform(r, lambda x: x.getField("end")))
    kept = F.when(r.isNull(), t).otherwise(rest)
    return j.select(*[kept.alias(c) if c == text else F.col(f"`{c}`") for c in own],
                    r.alias(names[0]), n.cast("long").alias(names[1]))
