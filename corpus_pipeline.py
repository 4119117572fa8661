"""A training corpus from raw documents, as stages that hand a table of documents on."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bootloom.llm import bpe, decontamination, near_copies, spans, toxicity
from bootloom.llm.common import bounded_batches
from bootloom.llm.simhash import Ring
from bootloom.operators.lineage import settle, settled_within

#: SQL has no classifier and no BPE; the tests compare with plain loops.
ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic.

    Null and empty texts have the score of no words, which is below one half.
    Without labels nothing is toxic.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs, model).where("predicted = 0")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies (five-word shingles, Jaccard 0.8), the one with the smallest id.

    SimHash with pigeonring ties texts first, and each tie is compared exactly; an
    exact join then finds what 4 of 64 bits miss, most pairs at that similarity.

    Texts without words, null ones too, are copies of each other.  A document
    without an id comes last; rows equal in id and text stay or go together.
    """
    return near_copies.without_near_copies(docs, ring=Ring(most=4, segments=5))


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand in an earlier document or place; ``n_chars`` follows the text, if it is there.

    Null texts stay null; rows equal in id and text lose nothing to each other.
    """
    return spans.without_repeats(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark; null and empty texts have none."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.decontaminated(docs, benchmark).where(~F.col("contaminated"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add token counts and digests of ids and of the decoded text; null and empty texts have no tokens."""
    return bpe.bpe_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


ADDED = ["n_tokens", "ids_sha256", "decoded_sha256"]


def staged(operator: Stage, *added: str) -> Stage:
    """The operator as a stage: other columns than id and text are out of its reach, and batches to Python are bounded.

    A stage returns the columns of its documents as they were, whatever names
    they have, and then those in ``added``; documents' own columns of these names
    are dropped.  An empty table gives an empty table with the same columns.
    """

    @wraps(operator)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        others = [c for c in docs.columns if c not in ("doc_id", "text")]
        own = [F.struct(*others).alias("_own")] if others else []
        got = operator(spark, docs.select("doc_id", "text", *own), sf_dir)
        columns = {c: F.col(c if c in ("doc_id", "text") else f"_own.{c}") for c in docs.columns}
        if "n_chars" in others and "n_removed" in got.columns:
            n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(columns["n_chars"])
            columns["n_chars"] = n_chars.cast(docs.schema["n_chars"].dataType)
        kept = [column.alias(c) for c, column in columns.items() if c not in added]
        return got.select(*kept, *added)

    return stage


STAGES = [
    ("toxicity", staged(not_toxic)),
    ("near_duplicates", staged(one_of_each)),
    ("substrings", staged(no_repeats)),
    ("decontamination", staged(no_benchmark)),
    ("bpe", staged(encoded, *ADDED)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each written and read again before the next.

    What a stage has written on its way is removed once its result is there.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        with settled_within(spark) as inner:
            docs = settle(stage(spark, docs, sf_dir))
            inner.keep(docs)
    return docs
