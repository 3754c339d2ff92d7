"""The operators bound to the test tables: ``QUERIES`` and their ``SQL``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subrecon.llm import bitplane_kmeans, decontamination, filter_audit, language_id, oracle, packing
from subrecon.llm import quality_classifier, quality_rules, setsketch, simhash
from subrecon.llm import substring_dedup, toxicity, url_filter, warc_derivatives
from subrecon.llm.common import fold, read_table, staged


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule metrics and verdict of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs).select(
        "doc_id", *quality_rules.BASE_METRICS, "base_failed", "kept",
        F.array_join("failed_rules", ",").alias("failed_rules"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document hit by benchmark windows, and the items found."""
    index = decontamination.build_index(read_table(spark, sf_dir, "documents"))
    found = decontamination.search(index, read_table(spark, sf_dir, "benchmark"))
    return decontamination.by_document(index, staged(found, "benchmark-matches")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        decontamination.contaminated().alias("contaminated"), "n_near_items")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated passages, and the spans that went."""
    out = substring_dedup.dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.transform("removed", lambda s: F.concat_ws("-", s.getField("start").cast("string"),
                                                         s.getField("end").cast("string")))
    return out.select("doc_id", "text", F.coalesce(F.array_join(spans, ","), F.lit("")).alias("removed_spans"),
                      "original_chars")


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    import public_tokenizers

    pieces = packing.tokenise(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN,
                              added=True)
    return packing.pack(staged(pieces, "packing-pieces"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens holding every document."""
    return packed(read_table(spark, sf_dir, "documents"))


def response_records(pages: DataFrame) -> DataFrame:
    """Stand-in responses: the schema of parsed WARC responses, filled from the pages."""
    return pages.select(
        "page_id", F.col("url").alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("date"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                 F.octet_length(F.coalesce("html", F.lit(""))).cast("string")).alias("http_headers"),
        F.col("html").alias("payload"), F.lit(None).cast("string").alias("record_id"))


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page's response."""
    return warc_derivatives.derive(response_records(read_table(spark, sf_dir, "pages")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = read_table(spark, sf_dir, "documents")
    model = language_id.fit(docs)
    held_out = (fold("doc_id", language_id.FOLDS) == language_id.HELD_OUT).alias("held_out")
    return language_id.label(docs.select("doc_id", held_out, "text"), model)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = read_table(spark, sf_dir, "documents")
    model, share = quality_classifier.fit(docs, read_table(spark, sf_dir, "labels"))
    held_out = (fold("doc_id", quality_classifier.FOLDS) == quality_classifier.HELD_OUT).alias("held_out")
    scored = quality_classifier.score(docs.select("doc_id", held_out, "text"), model, share)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


#: The given rules of the URL contract.
URL_RULES = (
    url_filter.Given("com", "/", "allow"),
    url_filter.Given("example.com", "/en/", "block"),
    url_filter.Given("www.example.com", "/en/", "allow"),
    url_filter.Given("net", "/es/", "block"),
    url_filter.Given("net", "/fr/", "block"),
)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url; a page of a low-quality document (labels) is an example to block."""
    pages = read_table(spark, sf_dir, "pages")
    low = read_table(spark, sf_dir, "labels").where("quality IS NOT NULL").groupBy(F.col("doc_id").alias("page_id")).agg(
        (F.min("quality") == 0).alias("blocked"))
    return url_filter.judge(pages, pages.select("page_id", "url").join(low, "page_id"), URL_RULES)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    scored = toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_bitplane_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, exact distance and inertias of every kept vector."""
    return bitplane_kmeans.cluster(spark, read_table(spark, sf_dir, "embeddings"))[0]


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes, in every order, by language."""
    masked = filter_audit.masks(read_table(spark, sf_dir, "documents"))
    return filter_audit.audit(filter_audit.cells(masked, read_table(spark, sf_dir, "labels")))


def op13_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document by word-pair sets."""
    return setsketch.near_duplicates(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_url_filter": op4_url_filter,
    "op5_language_id": op5_language_id,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_quality_rules": op7_quality_rules,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_warc_derivatives": op9_warc_derivatives,
    "op10_toxicity": op10_toxicity,
    "op11_bitplane_kmeans": op11_bitplane_kmeans,
    "op12_filter_audit": op12_filter_audit,
    "op13_setsketch_near_dedup": op13_setsketch_near_dedup,
}

SQL: dict[str, str] = dict(oracle.SQL)
