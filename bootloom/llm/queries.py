"""The queries of this part, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bootloom.llm import alignment, bpe, decontamination, filter_audit, fingerprints, language_model, licenses, mixing
from bootloom.llm import simhash, spans, token_counts, toxicity, urls
from bootloom.llm.oracles import ORACLES as SQL
from bootloom.llm.common import bounded_batches, bucket_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = dict(SQL)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf}/documents.parquet")


@query
def op1_token_counts(spark, sf):
    counted = token_counts.token_counts(documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op2_language_model(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    learned = language_model.learned_from(F.col("doc_id"))
    model = language_model.train(docs.where(learned))
    return language_model.scored(docs, model).select(
        "doc_id",
        (~learned).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


@query
def op3_decontamination(spark, sf):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    found = decontamination.decontaminated(documents(spark, sf).select("doc_id", "text"), benchmark)
    ids = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", ids, "contaminated")


@query
def op4_fingerprints(spark, sf):
    return fingerprints.fingerprints(documents(spark, sf))


@query
def op5_toxicity(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    held_out = F.coalesce(bucket_of(F.col("doc_id"), toxicity.FOLDS) == 0, F.lit(False)).alias("held_out")
    return toxicity.scored(docs, model).select("doc_id", held_out, "score", "predicted")


@query
def op6_simhash(spark, sf):
    found = simhash.near_duplicates(documents(spark, sf))
    return found.select("doc_id", "fingerprint", "component_id")


@query
def op7_urls(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    return urls.judged(pages).select("page_id", "host", "path", "rule", "verdict")


@query
def op8_licenses(spark, sf):
    return licenses.license_scan(documents(spark, sf))


@query
def op9_spans(spark, sf):
    return spans.without_repeats(documents(spark, sf).select("doc_id", "text"))


@query
def op10_bpe(spark, sf):
    coded = bpe.bpe_digests(documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op11_alignment(spark, sf):
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    found = alignment.aligned(documents(spark, sf), *paths)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query
def op12_filter_audit(spark, sf):
    return filter_audit.filter_audit(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


@query
def op13_mixing(spark, sf):
    taken = (F.col("n_copies") * F.col("size")).alias("taken")
    return mixing.copies(documents(spark, sf)).select("doc_id", "size", "source_size", "target", taken)
