"""The training-data pipeline: language, near-duplicates, repeated passages, contamination, packing.

Each stage of ``STAGES`` takes ``(spark, docs, sf_dir)``, works on every row it
is given and returns the rows that stay, with the columns of ``docs``; the last
returns the packed pieces. ``run`` writes each stage's result to shared storage
and reads it back for the next.

Defined results, in every stage: an empty table gives an empty result; extra
columns pass through all but the last stage, whatever their names; rows with
the same id and the same text are one document, rows with the same id and unlike texts are
several; rows without an id are named by their text, so equal texts without an id are one document.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subrecon.llm import decontamination, language_id, simhash, substring_dedup
from subrecon.llm.common import bounded_batches, read_table, sent_if_small, staged
from subrecon.llm.queries import packed

log = logging.getLogger(__name__)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key, and its name: the id, or a number beyond ordinary ids from id and text.

    Of several texts under one id, the one with the smallest hash keeps the id as its key.
    """
    name, own, low = (_free(c, docs) for c in ("__key", "__id", "__low"))
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    beyond = F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    ids = docs.select(F.col("doc_id").cast("long").alias(own), digest.alias(low)).where(F.col(own).isNotNull())
    shared = ids.groupBy(own).agg(F.min(low).alias(low), F.max(low).alias("high")).where(F.col(low) < F.col("high")).drop("high")
    shared = staged(shared, "pipeline-shared-ids")
    keyed = docs.withColumn(own, F.col("doc_id").cast("long")).join(sent_if_small(shared), own, "left")
    key = F.when(F.col(own).isNull() | (digest != F.col(low)), beyond).otherwise(F.col(own))
    return keyed.withColumn(name, key).drop(own, low), name


def _free(name: str, docs: DataFrame) -> str:
    """``name``, made longer until no column has it."""
    while name in docs.columns:
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts in which a learned language is found; null, empty and letterless texts go.

    A text of several languages stays, whichever prevails. Without any labelled text there is no language to
    reject by, so all rows stay.
    """
    bounded_batches(spark)
    model = language_id.fit(docs)
    if model is None:
        log.warning("language_id: no labelled text to learn from, all documents stay")
        return docs
    lang, score = _free("__lang", docs), _free("__score", docs)
    out = language_id.label(docs, model, names=(lang, score), keep_text=True)
    return out.where(F.col(lang) != language_id.UNKNOWN).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each SimHash component."""
    bounded_batches(spark)
    keyed, key = _keyed(docs)
    first = simhash.near_duplicates(keyed, key).where("doc_id = component_id").select(F.col("doc_id").alias(key))
    return keyed.join(first.distinct(), key, "left_semi").dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in docs.columns])


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated passages out of the texts; every document stays, with its new length."""
    bounded_batches(spark)
    keyed, key = _keyed(docs)
    removed, chars = _free("__removed", docs), _free("__chars", docs)
    out = substring_dedup.dedup(keyed, key, names=(removed, chars))
    return out.select(*[F.when(F.col(removed).isNull(), F.col("`n_chars`")).otherwise(F.length("text").cast("long"))
                        .alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which benchmark windows hit at least one word in twenty."""
    bounded_batches(spark)
    keyed, key = _keyed(docs)
    index = decontamination.build_index(keyed, key)
    found = decontamination.search(index, read_table(spark, sf_dir, "benchmark"), slack=-1)
    hit = decontamination.by_document(index, staged(found, "benchmark-matches")).where(decontamination.contaminated())
    hit = staged(hit.select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return keyed.join(sent_if_small(hit), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences: one row per piece."""
    bounded_batches(spark)
    return packed(docs)


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]

#: No SQL: models, XXH64 fingerprints and tokenizers are outside it; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; how many rows each leaves is logged."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        log.warning("%s: %d rows stay", name, docs.count())
    return docs
