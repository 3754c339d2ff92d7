"""Toxicity by class-conditional Kneser-Ney models of characters.

**Counts.** A text is a sequence of words, a word the characters between
``order - 1`` spaces before and one behind it. An expression is a character after
its history, the ``order - 1`` characters before it. One pre-aggregated grouping by word gives,
over all documents, the distinct words, and over the labelled training
documents in how many toxic and ordinary texts each occurs. A second grouping takes them to expressions:
class counts, and in how many distinct words of the whole corpus one occurs.

**Shared model.** Interpolated Kneser-Ney over all documents, with discount D. ``n`` of the
highest order is the number of distinct words; of each lower order, the
continuation count (before how many characters the shorter expression stands)::

    shared(x | h) = (max(n(hx) - D, 0) + sum_y min(n(hy), D) * shared(x | h without its first)) / sum_y n(hy)

and one share each of all characters below the lowest order.

**Class models.** The same with the counts n_c of class c at the highest order and the
shared model for what the discount frees, then interpolated with ``K`` parts of the shared one::

    kn_c(x | h) = (max(n_c(hx) - D, 0) + sum_y min(n_c(hy), D) * shared(x | h)) / sum_y n_c(hy)
    p_c(x | h) = (kn_c(x | h) + K * shared(x | h)) / (1 + K)

A history that a class has not seen has kn_c = shared. No expression is cut off.

**Score.** The log-likelihood of a text's characters (of every occurrence of
every word) under the toxic model less that under the ordinary one, divided by the number of
characters, put through a logistic curve over its inverse hyperbolic sine. The curve is fitted on a slice of the training rows
(at most ``calibration_rows``, lowest hash first) whose ratios come from counts without that slice;
the scores come from the counts of all training rows.

A model of at most ``max_model_rows`` expressions is sent to the tasks; a larger
one stays a table that the corpus's distinct words, and then the texts' words, are joined
with. Both give the same scores.

Defined results: null and empty texts, and texts without a letter or digit, have a ratio of zero and the score of
that; a text of any length is one task's row, and takes memory by its distinct words; null labels are no labels; an id labelled
twice counts as toxic if any label is; without training rows of both classes every score is the share of
toxic rows (zero without any); rows with a null id have a null ``held_out`` and no label; repeated rows score alike; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subrecon.llm.common import fold, mix64, staged

ORDER = 5
DISCOUNT = 0.75
SHARED_WEIGHT = 8.0
FOLDS = 5
COUNTS = ("tox", "ord", "tox_fit", "ord_fit")
_find = re.compile(r"[^\W_]+").findall


def words_in(text: str | None) -> Counter:
    """How often each word occurs."""
    return Counter(_find(text.lower())) if text else Counter()


def expressions(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, index into ``words``, expression) of every character of each word and the space behind it."""
    padded = [" " * (order - 1) + w + " " for w in words]
    c = np.frombuffer("".join(padded).encode("utf-32-le"), "<u4")
    size = np.fromiter(map(len, padded), np.int64, len(padded))
    at = np.repeat(np.arange(len(words)), size)
    n = max(0, len(c) - order + 1)
    whole = np.flatnonzero(at[:n] == at[order - 1:]) if n else np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(c, order)[whole] if n else np.zeros((0, order), "<u4")
    return hashes(windows), at[whole], windows


def hashes(windows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(windows), np.uint64)
    for k in range(windows.shape[1]):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + windows[:, k].astype(np.uint64))
    return h


def as_strings(windows: np.ndarray) -> pa.Array:
    order = windows.shape[1]
    return pa.array(np.ascontiguousarray(windows).view(f"<U{order}").reshape(len(windows)), pa.string())


def count_words(docs: DataFrame) -> DataFrame:
    """(word, tox, ord, tox_fit, ord_fit) of every distinct word: the texts of each class that hold it.

    ``docs`` has (text, toxic, fit): toxic is null where not trained on, and the
    last two counts leave out the rows that fit the curve.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                known, counts = set(), [Counter() for _ in COUNTS]
                for text, toxic, fit in zip(*(part.column(k).to_pylist() for k in range(3))):
                    w = words_in(text).keys()
                    known.update(w)
                    if toxic is not None:
                        counts[0 if toxic else 1].update(w)
                        if not fit:
                            counts[2 if toxic else 3].update(w)
                words = list(known)
                for k in range(0, len(words), 50_000):
                    w = words[k:k + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(w, pa.string()), *(pa.array([c[x] for x in w], pa.int64()) for c in counts)],
                        names=["word", *COUNTS])

    counted = docs.select("text", "toxic", "fit").mapInArrow(rows, "word string, " + ", ".join(f"{c} long" for c in COUNTS))
    return counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in COUNTS])


def count_expressions(words: DataFrame, order: int) -> DataFrame:
    """(gram, tox, ord, tox_fit, ord_fit, n) of every expression, from the distinct words; n is how many hold it, repeats included."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, at, windows = expressions(b.column(0).to_pylist(), order)
            if len(h):
                _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
                sums = [np.bincount(inverse, weights=b.column(k + 1).to_numpy()[at]).astype(np.int64) for k in range(len(COUNTS))]
                yield pa.RecordBatch.from_arrays(
                    [as_strings(windows[first]), *map(pa.array, sums), pa.array(np.bincount(inverse))],
                    names=["gram", *COUNTS, "n"])

    fields = ", ".join(f"{c} long" for c in (*COUNTS, "n"))
    grams = words.select("word", *COUNTS).mapInArrow(rows, f"gram string, {fields}")
    return grams.groupBy("gram").agg(*[F.sum(c).alias(c) for c in (*COUNTS, "n")])


def shared_model(grams: DataFrame, order: int, discount: float = DISCOUNT) -> DataFrame:
    """(gram, shared) for every expression of ``grams`` (gram, n): Kneser-Ney over all documents."""
    levels = {order: grams.select("gram", "n")}
    for k in range(order - 1, 0, -1):
        shorter = levels[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n"))
        levels[k] = staged(shorter, "toxicity-continuations")
    below = None
    for k in range(1, order + 1):
        rows = levels[k].select("gram", "n", F.substring("gram", 1, k - 1).alias("h"), F.substring("gram", 2, k - 1).alias("rest"))
        total = rows.groupBy("h").agg(F.sum("n").alias("all"), F.sum(F.least("n", F.lit(discount))).alias("freed"))
        rows = rows.join(total, "h")
        if below is None:
            rows = rows.withColumn("lower", F.lit(1.0 / max(1, levels[1].count())))
        else:
            rows = rows.join(below.withColumnsRenamed({"gram": "rest", "shared": "lower"}), "rest")
        p = (F.greatest(F.col("n") - discount, F.lit(0.0)) + F.col("freed") * F.col("lower")) / F.col("all")
        below = rows.select("gram", p.alias("shared"))
    return below


def class_models(grams: DataFrame, order: int = ORDER, discount: float = DISCOUNT, weight: float = SHARED_WEIGHT) -> DataFrame:
    """(gram, llr, llr_fit): log p_tox / p_ord of each expression, of all counts and of those without the fit's rows.

    Expressions whose ratios are both zero are left out.
    """
    history = F.substring("gram", 1, order - 1)
    totals = grams.groupBy(history.alias("h")).agg(
        *[F.sum(c).alias(f"all_{c}") for c in COUNTS],
        *[F.sum(F.least(c, F.lit(discount))).alias(f"freed_{c}") for c in COUNTS]).where("all_tox + all_ord > 0")
    rows = grams.withColumn("h", history).join(totals, "h").join(shared_model(grams, order, discount), "gram")

    def p(c: str) -> Column:
        kn = (F.greatest(F.col(c) - discount, F.lit(0.0)) + F.col(f"freed_{c}") * F.col("shared")) / F.col(f"all_{c}")
        return F.when(F.col(f"all_{c}") > 0, (kn + weight * F.col("shared")) / (1 + weight)).otherwise(F.col("shared"))

    llr = rows.select("gram", (F.log(p("tox")) - F.log(p("ord"))).alias("llr"),
                      (F.log(p("tox_fit")) - F.log(p("ord_fit"))).alias("llr_fit"))
    return staged(llr.where("llr != 0 OR llr_fit != 0"), "toxicity-model")


def ratio_sent(docs: DataFrame, table: DataFrame, order: int, keep_words: int = 500_000) -> DataFrame:
    """``docs`` with ``ratio`` in place of ``text``, by a bounded model (gram, llr) sent to the tasks."""
    t = table.toArrow()
    llr = t["llr"].to_numpy()
    windows = np.frombuffer("".join(t["gram"].to_pylist()).encode("utf-32-le"), "<u4").reshape(-1, order)
    gram = hashes(windows)
    order_ = np.argsort(gram)
    sent = docs.sparkSession.sparkContext.broadcast((gram[order_], llr[order_]))
    names = [c for c in docs.columns if c != "text"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = sent.value
        known: dict[str, float] = {}
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts = [words_in(x) for x in part.column("text").to_pylist()]
                new = list(set().union(*texts).difference(known))
                if len(known) + len(new) > keep_words:
                    known, new = {}, list(set().union(*texts))
                for k in range(0, len(new), 50_000):
                    w = new[k:k + 50_000]
                    g, at, _ = expressions(w, order)
                    i = np.minimum(np.searchsorted(keys, g), max(len(keys) - 1, 0))
                    r = np.where(keys[i] == g, values[i], 0.0) if len(keys) else np.zeros(len(g))
                    known.update(zip(w, np.bincount(at, weights=r, minlength=len(w)).tolist()))
                ratio = [sum(known[x] * n for x, n in w.items()) / sum((len(x) + 1) * n for x, n in w.items()) if w else 0.0
                         for w in texts]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(ratio, pa.float64())],
                                                 names=[*names, "ratio"])

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != "text")
    return docs.mapInArrow(rows, f"{fields}, ratio double")


def ratio_joined(docs: DataFrame, words: DataFrame, table: DataFrame, order: int) -> DataFrame:
    """The same by joins: the corpus's distinct words with the model, then the texts' words with theirs."""
    names = [c for c in docs.columns if c != "text"]

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = b.column(0).to_pylist()
            _, at, windows = expressions(w, order)
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()).take(pa.array(at)), as_strings(windows)],
                                             names=["word", "gram"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words_in(text)
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(w), pa.int64()), pa.array(list(w), pa.string()),
                                                  pa.array(list(w.values()), pa.int64())], names=["__row", "word", "times"])

    by_word = (words.select("word").mapInArrow(grams, "word string, gram string").join(table, "gram", "left")
               .groupBy("word").agg(F.sum(F.coalesce("llr", F.lit(0.0))).alias("llr")))
    docs = staged(docs.withColumn("__row", F.monotonically_increasing_id()), "toxicity-rows")
    means = (docs.select("__row", "text").mapInArrow(split, "__row long, word string, times long").join(by_word, "word")
             .groupBy("__row").agg((F.sum(F.col("llr") * F.col("times")) / F.sum((F.length("word") + 1) * F.col("times"))).alias("ratio")))
    return docs.join(means, "__row", "left").select(*names, F.coalesce("ratio", F.lit(0.0)).alias("ratio"))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-3) -> tuple[float, float, float, float]:
    """(centre, scale, slope, intercept) of P(y | x) by Newton's method on asinh((x - centre) / scale).

    Ratios of texts with many rare expressions lie far out; centre and scale are medians, and the inverse hyperbolic
    sine keeps the order and the detail where the classes meet.
    """
    centre = float(np.median(x))
    scale = float(np.median(np.abs(x - centre))) or 1.0
    z = np.stack([np.arcsinh((x - centre) / scale), np.ones(len(x))], axis=1)
    beta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (y - p) - ridge * len(x) * beta * [1, 0]
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag([ridge * len(x), 1e-9])
        step = np.clip(np.linalg.solve(hess, grad), -2, 2)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, float(beta[0]), float(beta[1])


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          folds: int = FOLDS, held_out: int = 0, order: int = ORDER, calibration_rows: int = 20_000,
          max_model_rows: int = 8_000_000, max_label_rows: int = 4_000_000) -> DataFrame:
    """(doc_id, held_out, score, ratio) of every row of ``docs``.

    Labels of rows whose fold is ``held_out`` are not used; those of the next
    fold also fit the logistic curve, by a model that does not count them.
    """
    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"),
                    fold(F.col(f"`{doc_id}`"), folds).alias("fold"))
    y = labels.where(F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{doc_id}`").alias("doc_id")).agg(
        (F.max(f"`{label}`") > 0).alias("toxic")).where(fold("doc_id", folds) != held_out)
    y = staged(y, "toxicity-labels")
    n_labels, n_toxic = y.agg(F.count("*"), F.sum(F.col("toxic").cast("long"))).first()
    y = F.broadcast(y) if n_labels <= max_label_rows else y
    slice_ = (held_out + 1) % folds
    words = count_words(d.join(y, "doc_id", "left").select("text", "toxic", (F.col("fold") == slice_).alias("fit")))
    out = (F.col("fold") == held_out).alias("held_out")
    if not n_toxic or n_toxic == n_labels:
        share = float((n_toxic or 0) / n_labels) if n_labels else 0.0
        return d.select("doc_id", out, F.lit(share).alias("score"), F.lit(0.0).alias("ratio"))
    model = class_models(staged(count_expressions(words, order), "toxicity-expressions"), order)
    small = model.count() <= max_model_rows

    def ratios(rows: DataFrame, column: str) -> DataFrame:
        table = model.select("gram", F.col(column).alias("llr"))
        return ratio_sent(rows, table, order) if small else ratio_joined(rows, words, table, order)

    fit = d.where(F.col("fold") == slice_).join(y, "doc_id")
    if n_labels > calibration_rows:
        lowest = fit.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(calibration_rows)
        fit = fit.join(F.broadcast(lowest), "doc_id", "left_semi")
    got = ratios(fit.select("toxic", "text"), "llr_fit").toPandas()
    if got["toxic"].nunique() == 2:
        centre, scale, slope, bias = logistic(got["ratio"].to_numpy(float), got["toxic"].to_numpy(float))
    else:
        centre, scale, slope, bias = 0.0, 1.0, 1.0, float(np.log(n_toxic / (n_labels - n_toxic)))
    p = 1 / (1 + F.exp(-(F.asinh((F.col("ratio") - centre) / scale) * slope + bias)))
    return ratios(d.select("doc_id", "fold", "text"), "llr").select("doc_id", out, p.alias("score"), "ratio")
