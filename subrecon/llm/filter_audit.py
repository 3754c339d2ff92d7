"""Filter interaction audit: what each filter removes in every order of application.

**Cells.** Five filters look at whole texts (``FILTERS``). Each document gets
a mask with a bit for every filter it fails; the documents of a part are then
counted by mask: at most 32 cells a part, with map-side partial sums.

**Enumeration.** A recursive CTE starts from the empty prefix with all mask
cells and extends every prefix by each letter not yet used (``applied & bit =
0``). It carries the applied bits, and each level of the recursion says of
each mask cell what the new letter does to it: kept, removed here, removed earlier
though it fails here, fails here only. That is 325 prefixes times 32 cells,
whatever the data hold; the parts' counts are joined to it by mask, summed per
prefix, and laid out for the 120 full orders.

**Shapley.** A prefix of ``k`` letters begins ``(5 - k)!`` orders, so a filter's
removals over all orders are its removals by prefix times that number.

**Copies.** A document fails ``E`` if a smaller id has the same text anywhere in the table.
Texts are compared by their SHA-256; only digests that occur more than once are joined
back, both sides being written tables, so that Spark can split a digest that
a third of all rows share.

Defined results: a null text is empty and equals an empty one; an empty text
has no words, no characters and fails ``A`` only (and ``E``); rows with a null
id have no place in the order of ids, so they never fail ``E`` nor make others fail it, and they have
no labels; repeated rows with one id do not make each other fail ``E`` and count once each; several
labels of one id count as 1 if any is 1; a null part is the empty string, as an empty one is; a
text of any length is read whole (its words are one array while it is judged);
other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subrecon.llm.common import sent_if_small, staged

LETTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 3
SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#$%&*|]"
METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_masks(text: Column) -> Column:
    """The bits (1, 2, 4, 8) of the filters A to D that a text (not null) fails."""
    words = F.array_remove(F.split(text, SPACE), "")
    n_upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [F.size(words) < MIN_WORDS,
             100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * F.size(words),
             100 * n_upper.cast("long") > MAX_UPPER_PERCENT * F.length(text).cast("long"),
             text.rlike(SYMBOL)]
    out = F.lit(0)
    for k, failed in enumerate(fails):
        out = out.bitwiseOR(F.when(failed, 1 << k).otherwise(0))
    return out


def masks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, mask) for every row of ``docs``; bit ``k`` of ``mask`` is the ``k``-th filter."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
                       text_masks(t).alias("mask"), F.unhex(F.sha2(t.cast("binary"), 256)).alias("digest"))
    rows = staged(rows, "audit-masks")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    copied = staged(first.where("low < high").select("digest", "low"), "audit-copied")
    e = F.when(F.col("doc_id") > F.col("low"), 1 << 4).otherwise(0)
    return rows.join(sent_if_small(copied, 200_000), "digest", "left").select(
        "doc_id", "part", F.col("mask").bitwiseOR(e).alias("mask"))


def cells(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask, and how many have a label of 1.

    ``labels`` has doc_id, quality and toxic; it may hold an id more than once.
    """
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    known = staged(labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality"), flag("toxic")), "audit-labels")
    joined = masked.join(sent_if_small(known), "doc_id", "left")
    return joined.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"),
        F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


#: Every prefix of an order with every mask cell; 0/1 flags of what the prefix's last letter does to the cell.
ENUMERATION = """
WITH RECURSIVE
letters AS (SELECT substr('{letters}', k + 1, 1) AS letter, shiftleft(1, k) AS bit
            FROM (SELECT explode(sequence(0, length('{letters}') - 1)) AS k)),
walk (prefix, letter, bit, before, applied, mask) AS (
  SELECT '', '', 0, 0, 0, mask
  FROM (SELECT explode(sequence(0, CAST(pow(2, length('{letters}')) AS INT) - 1)) AS mask)
  UNION ALL
  SELECT concat(walk.prefix, letters.letter), letters.letter, letters.bit, walk.applied,
         walk.applied | letters.bit, walk.mask
  FROM walk JOIN letters ON walk.applied & letters.bit = 0)
SELECT prefix, letter, length(prefix) AS step, mask,
       CAST(mask & applied = 0 AS INT) AS kept,
       CAST(mask & bit <> 0 AND mask & before = 0 AS INT) AS removed,
       CAST(mask & bit <> 0 AND mask & before <> 0 AS INT) AS redundant,
       CAST(mask = bit AS INT) AS unique_fails
FROM walk WHERE prefix <> ''
"""


def enumeration(spark: SparkSession, letters: str = LETTERS) -> DataFrame:
    """(prefix, letter, step, mask, four flags): the recursion over prefixes, each level with all mask cells."""
    return spark.sql(ENUMERATION.format(letters=letters))


def audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Metrics of every part, full order and step from ``cells``."""
    spark, n = counts.sparkSession, len(letters)
    walk = staged(enumeration(spark, letters), "audit-walk")  # 325 prefixes times 32 masks: bounded by the letters
    count = lambda flag, c: F.sum(F.col(flag) * F.col(c)).cast("long")
    by_prefix = counts.join(F.broadcast(walk), "mask").groupBy("part", "prefix", "letter", "step").agg(
        *[count(f, "n").alias(f) for f in METRICS[:4]],
        count("removed", "good").alias("good_lost"), count("removed", "toxic").alias("toxic_lost"))
    by_prefix = staged(by_prefix, "audit-prefixes")
    orders = walk.where((F.col("step") == n) & (F.col("mask") == 0)).select(
        F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step")).withColumn(
        "prefix", F.expr("substr(filter_order, 1, step)"))
    shapley = by_prefix.groupBy("part", "letter").agg(
        F.sum(F.col("removed") * F.factorial(F.lit(n) - F.col("step"))).cast("long").alias("shapley"))
    return by_prefix.drop("step").join(F.broadcast(orders), "prefix").join(shapley, ["part", "letter"]).select(
        "part", "filter_order", "step", *METRICS, "shapley")
