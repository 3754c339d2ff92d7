"""URL filter by association rules.

**Tokens.** A URL becomes a set of tokens: its host's labels and last two
labels, words of its path (numbers as one token), and its query's keys.

**Items.** Tokens that occur in the very same labelled URLs are one item, named
by the first of them: any of its tokens stands for it. So a family of URLs that shares any number
of tokens is no set of as many items, and no support or confidence changes.

**Mining.** An item that occurs in URLs to block only is a rule by itself, and every set with it would be
pruned below. The other items of the labelled URLs to block go through Spark's FP-growth;
the sets found are then counted over all labelled URLs. A set of any length is a rule if
``min_support`` of the labelled URLs, and at least ``min_rows``, hold it and are
to be blocked, and if it has ``min_confidence`` and a lift above one; a rule is pruned
when a rule of fewer of its items is as confident.

**Matching.** Rules are indexed under the tokens of their rarest item. A URL's tokens look
up the index, candidates are verified to have all their rule's items, and the
most confident match (then the larger support, then the items in order)
blocks the URL; a URL that no rule matches is allowed. At most
``max_rules`` rules are broadcast; more are joined.

**Given rules** (host suffix, path prefix, verdict) come first: of those that
fit a URL's host or a parent domain and whose path the URL's path starts with,
the longest wins.

Defined results: a null URL or one without ``://`` has an empty host and path
and no tokens, and is allowed unless a rule has neither; a URL of any length is judged
whole, and takes memory by its tokens; repeated rows are judged alike, and each counts in mining;
without labelled URLs of the block label, or with fewer than ``min_rows``, there are no mined rules; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subrecon.llm.common import staged

RULES = "tokens array<string>, confidence double, support double, groups array<array<string>>, index_token string"
_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Given:
    """A rule stated beforehand."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), *_AZ)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(host: Column, path: Column, rules: Sequence[Given]) -> tuple[Column, Column]:
    """(name, verdict) of the longest given rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), len(r.host), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The set of a URL's tokens."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")
    words = F.filter(F.split(F.translate(path, *_AZ), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    keys = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), "[&;]"), lambda x: x != "")
    return F.array_distinct(F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("host="), x)),
        F.when(F.size(labels) > 0, F.array(F.concat(F.lit("domain="), domain))).otherwise(F.array().cast("array<string>")),
        F.transform(words, lambda x: F.concat(F.lit("path="), F.regexp_replace(x, r"^\p{N}+$", "#"))),
        F.transform(keys, lambda x: F.concat(F.lit("key="), F.regexp_extract(x, "^([^=]*)", 1)))))


def items_of(baskets: DataFrame, least: int) -> DataFrame:
    """(item, token, freq, hits) of the tokens that at least ``least`` blocked rows hold; ``baskets`` has (row, tokens, blocked).

    ``freq`` counts the rows of a token, ``hits`` those of them to be blocked.

    Tokens of the same rows share an item; two 64-bit sums over row hashes and two counts tell the rows apart.
    """
    same = ["freq", "hits", "x", "y"]
    token = (baskets.select("row", "blocked", F.explode("tokens").alias("token")).groupBy("token")
             .agg(F.count("*").alias("freq"), F.sum(F.col("blocked").cast("long")).alias("hits"),
                  F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"))
             .where(F.col("hits") >= least))
    item = token.groupBy(*same).agg(F.min("token").alias("item"))
    return staged(token.join(item, same).select("item", "token", "freq", "hits"), "url-items")


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.5, min_rows: int = 5,
         max_rules: int = 100_000) -> DataFrame:
    """(tokens, confidence, support, groups, index_token) of the rules that block; ``labelled`` has (tokens, blocked).

    ``tokens`` names the items of a rule, ``groups`` holds the tokens of each.
    """
    spark = labelled.sparkSession
    baskets = staged(labelled.select(F.monotonically_increasing_id().alias("row"), "tokens", "blocked"), "url-baskets")
    n, n_blocked = baskets.agg(F.count("*"), F.coalesce(F.sum(F.col("blocked").cast("long")), F.lit(0))).first()
    least = max(min_rows, math.ceil(min_support * n - 1e-9), 1)
    if n_blocked < least:
        return spark.createDataFrame([], RULES)
    items = items_of(baskets, least)
    known = (baskets.select("row", "blocked", F.explode("tokens").alias("token"))
             .join(items.where("hits < freq").select("item", "token"), "token")
             .groupBy("row", "blocked").agg(F.sort_array(F.collect_set("item")).alias("items")))
    known = staged(known, "url-itemsets")
    blocked = known.where("blocked").select("items")
    rows = blocked.count()
    # an item of blocked rows only is as sure as a rule can be: no set with it says more, so it is not mined with others
    found = items.where("hits = freq").select(F.array("item").alias("tokens"), "hits").distinct()
    if rows >= least:
        sets = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / rows,
                        numPartitions=max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))).fit(blocked).freqItemsets
        found = found.unionByName(sets.select(F.sort_array("items").alias("tokens"), F.col("freq").alias("hits")).where(F.col("hits") >= least))
    found = staged(found, "url-sets")
    # the rarest item of each set is its place in the index
    group = items.groupBy("item").agg(F.sort_array(F.collect_list("token")).alias("group"), F.first("freq").alias("freq"))
    parts = found.select("tokens", "hits", F.explode("tokens").alias("item")).join(group, "item")
    sets = staged(parts.groupBy("tokens", "hits").agg(
        F.min(F.struct("freq", "item")).getField("item").alias("index_token"),
        F.transform(F.sort_array(F.collect_list(F.struct("item", "group"))), lambda x: x.getField("group")).alias("groups")), "url-index")
    # sets of one item are counted already, the others in all rows that hold their rarest item
    index = sets.where(F.size("tokens") > 1).select("tokens", F.col("index_token").alias("item"))
    index = F.broadcast(index) if index.count() <= max_rules else index
    many = (known.select("items", F.explode("items").alias("item")).join(index, "item")
            .where(F.size(F.array_except("tokens", "items")) == 0).groupBy("tokens").agg(F.count("*").alias("all")))
    one = group.select(F.array("item").alias("tokens"), F.col("freq").alias("all"))
    confidence = F.col("hits") / F.col("all")
    rules = staged(sets.join(many.unionByName(one), "tokens")
                   .select("tokens", confidence.alias("confidence"), (F.col("hits") / F.lit(n)).alias("support"), "groups", "index_token")
                   .where((F.col("confidence") >= min_confidence) & (F.col("confidence") > n_blocked / n)), "url-rules")
    # a rule says nothing new if fewer of its items are as confident
    parts = rules.select("tokens", "confidence", F.explode("tokens").alias("t"))
    smaller = rules.select(F.col("tokens").alias("s"), F.col("confidence").alias("sc"), F.col("tokens")[0].alias("t"))
    told = (parts.join(smaller, "t").where((F.size("s") < F.size("tokens")) & (F.size(F.array_except("s", "tokens")) == 0)
                                           & (F.col("sc") >= F.col("confidence"))).select("tokens").distinct())
    return staged(rules.join(told, "tokens", "left_anti"), "url-kept")


def match(urls: DataFrame, rules: DataFrame, key: str = "row", max_rules: int = 100_000) -> DataFrame:
    """(key, matched): the best rule of each URL that any matches; ``urls`` has (key, tokens)."""
    place = F.array_position("tokens", F.col("index_token")).cast("int")
    index = rules.select(F.explode(F.element_at("groups", place)).alias("t"), F.col("tokens").alias("r"), "groups", "confidence", "support")
    index = F.broadcast(index) if index.count() <= max_rules else index
    found = (urls.select(key, "tokens", F.explode("tokens").alias("t")).join(index, "t")
             .where(F.forall("groups", lambda g: F.arrays_overlap(g, F.col("tokens")))))
    best = F.max(F.struct("confidence", "support", F.col("r"))).alias("b")
    return found.groupBy(key).agg(best).select(key, F.col("b.r").alias("matched"), F.col("b.confidence").alias("confidence"))


def judge(pages: DataFrame, labelled: DataFrame, given: Sequence[Given] = (), page_id: str = "page_id", url: str = "url",
          **params) -> DataFrame:
    """(page_id, host, path, rule, verdict, matched) of every page; ``labelled`` has (url, blocked)."""

    def parsed(df, *more):
        u = F.col(f"`{url}`")
        d = df.select(u.alias("url"), host_of(u).alias("host"), path_of(u).alias("path"), *more)
        return d.withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))

    rules = mine(parsed(labelled, "blocked").where("blocked IS NOT NULL").select("tokens", "blocked"), **params)
    rows = staged(parsed(pages, F.col(f"`{page_id}`").alias("page_id"), F.monotonically_increasing_id().alias("row")),
                  "url-pages")
    name, verdict = given_rule(F.col("host"), F.col("path"), given)
    return rows.join(match(rows, rules), "row", "left").select(
        "page_id", "host", "path", name.alias("rule"),
        F.coalesce(verdict, F.when(F.col("matched").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.array_join("matched", " ").alias("matched"))
