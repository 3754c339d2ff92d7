"""Quality rules: a threshold table compiled into one projection.

Every metric is a built-in Spark expression over the whole text, every rule
a row of ``RULES``; ``judge`` compiles both into columns of a projection
without user functions, joins, shuffles or per-document state outside the
row.

Defined results: a null text counts as empty; an empty text has zero words,
all metrics zero and fails the base rule; repeated rows are judged alike;
other columns pass through untouched unless they bear a metric's name, in
which case the metric replaces them. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Frequent function words of the four corpus languages.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "that", "with", "is", "for",
    "der", "die", "das", "und", "nicht", "mit", "den", "ein",
    "le", "la", "les", "des", "et", "une", "pour", "que",
    "el", "los", "las", "y", "de", "en", "con", "por",
)


@dataclass(frozen=True)
class Rule:
    """A document passes when ``low <= metric <= high`` (an open end is None)."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Ratios are null for a text without words, and a null passes.
RULES = (
    Rule("mean_word_length", "mean_word_length", 2.0, 14.0),
    Rule("symbol_ratio", "symbol_ratio", high=0.1),
    Rule("upper_ratio", "upper_ratio", high=0.5),
    Rule("stop_words", "n_stop_words", low=2),
    Rule("stop_word_ratio", "stop_word_ratio", low=0.01),
    Rule("dup_line_ratio", "dup_line_ratio", high=0.5),
    Rule("bullet_line_ratio", "bullet_line_ratio", high=0.9),
    Rule("ellipsis_line_ratio", "ellipsis_line_ratio", high=0.3),
)

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BASE_METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("mean_word_length", "symbol_ratio", "upper_ratio", "n_stop_words", "stop_word_ratio",
          "dup_line_ratio", "bullet_line_ratio", "ellipsis_line_ratio")


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the base metrics and ratios of ``text`` to every row.

    Repeated 3-word windows are found by sorting a text's windows and
    comparing neighbours, so the cost is n log n in the words of one text
    and nothing leaves the row.
    """
    taken = set(BASE_METRICS) | set(RATIOS)
    own = [c for c in df.columns if c not in taken]
    df = df.select(*[F.col(f"`{c}`") for c in own], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__t"))
    df = df.withColumns({
        "__w": F.regexp_extract_all("__t", F.lit(WORD), F.lit(0)),
        "__l": F.filter(F.split("__t", "\n", -1), lambda x: F.trim(F.translate(x, SPACE, "")) != ""),
        "word_chars": _without(F.col("__t"), SPACE).cast("long"),
        "n_symbols": (F.length("__t") - _without(F.col("__t"), SYMBOLS)).cast("long"),
        "__upper": F.length("__t") - _without(F.col("__t"), UPPER),
    })
    w = F.col("__w")
    df = df.withColumns({
        "n_words": F.size(w).cast("long"),
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long"),
        "__lines": F.size("__l").cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "__bullets": F.size(F.filter("__l", lambda x: F.ltrim(x).rlike("^[-*•]"))),
        "__dots": F.size(F.filter("__l", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))),
        # windows in text order as (words, place), then sorted: equal windows become neighbours
        "__s": F.when(F.size(w) >= 3, F.sort_array(F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))),
            lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("k"),
                               i.alias("i"))))).otherwise(F.array().cast("array<struct<k:string,i:int>>")),
    })
    s = F.col("__s")
    key = lambda j: F.get(s, j).getField("k")
    df = df.withColumn("__r", F.when(F.size(s) > 1, F.sort_array(F.filter(F.transform(s, lambda x, j: F.when(
        (x.getField("k") == F.when(j > 0, key(j - 1))) | (x.getField("k") == key(j + 1)), x.getField("i"))),
        lambda x: x.isNotNull()))).otherwise(F.array().cast("array<int>")))
    r = F.col("__r")
    # a window covers 3 words; two repeated windows that overlap share the rest
    gaps = F.aggregate(F.transform(r, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(r, j + 1) - x, F.lit(3)))),
                       F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    df = df.withColumn("n_repeat_words", gaps)
    n, lines = F.col("n_words"), F.col("__lines")
    df = df.withColumns({
        "mean_word_length": _ratio(F.col("word_chars"), n),
        "symbol_ratio": _ratio(F.col("n_symbols"), n),
        "upper_ratio": _ratio(F.col("__upper"), F.col("word_chars")),
        "stop_word_ratio": _ratio(F.col("n_stop_words"), n),
        "dup_line_ratio": _ratio(F.col("n_dup_lines"), lines),
        "bullet_line_ratio": _ratio(F.col("__bullets"), lines),
        "ellipsis_line_ratio": _ratio(F.col("__dots"), lines),
    })
    return df.select(*[F.col(f"`{c}`") for c in own], *BASE_METRICS, *RATIOS)


def _passes(rule: Rule) -> Column:
    c = F.col(rule.metric)
    ok = F.lit(True)
    if rule.low is not None:
        ok = ok & (c >= rule.low)
    if rule.high is not None:
        ok = ok & (c <= rule.high)
    return F.coalesce(ok, F.lit(True))


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Metrics plus ``base_failed``, ``failed_rules`` (names) and ``kept``."""
    m = metrics(df, text)
    base = ((F.col("n_words") < MIN_WORDS)
            | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words")))
    failed = F.array_compact(F.array(*[F.when(~_passes(r), F.lit(r.name)) for r in rules]))
    return m.withColumn("base_failed", base).withColumn("failed_rules", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
