"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bootloom.llm.common import bucket_of, release_memory

#: Fold modulus: ids whose crc32 leaves no remainder are held out.
FOLDS = 5
#: The bounded sample that the classifier is fitted on: confirmed toxic and unlabelled documents.
POSITIVES, UNLABELLED = 4_000, 8_000
#: Hashed words; positive documents that a word must be in to be a feature, and by how many standard errors
#: its share of the positives must be above its share of the unlabelled.
FEATURES = 1 << 20
LEAST = 3
ERRORS = 4.0
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def features_of(text: bytes | None) -> np.ndarray:
    """The distinct hashed words of a whole text, sorted; none for null and empty texts."""
    words = set(_WORD.findall(text.lower())) if text else ()
    return np.unique(np.fromiter((crc32(w) % FEATURES for w in words), np.int32, len(words)))


@dataclass
class Sparse:
    """Binary rows: the columns of each, one after another."""

    columns: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Sparse:
        return cls(
            np.concatenate(rows) if rows else np.zeros(0, np.int32), np.array([len(r) for r in rows], np.int64)
        )

    def only(self, usable: np.ndarray) -> Sparse:
        """The rows with just the usable columns."""
        kept = usable[self.columns]
        ends = np.cumsum(self.lengths)
        before = np.concatenate([[0], np.cumsum(kept)])
        return Sparse(self.columns[kept], before[ends] - before[ends - self.lengths])

    def scores(self, weights: np.ndarray) -> np.ndarray:
        ends = np.cumsum(self.lengths)
        total = np.concatenate([[0.0], np.cumsum(weights[self.columns], dtype=np.float64)])
        return total[ends] - total[ends - self.lengths]

    def gradient(self, by_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, np.repeat(by_row, self.lengths), FEATURES)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def telling_words(positive: Sparse, unlabelled: Sparse) -> np.ndarray:
    """Features whose share of the positives is far above their share of the unlabelled."""
    n_p, n_u = len(positive.lengths), len(unlabelled.lengths)
    seen = np.bincount(positive.columns, minlength=FEATURES)
    share_u = (np.bincount(unlabelled.columns, minlength=FEATURES) + 1) / (n_u + 1)
    error = np.sqrt(share_u * (1 / n_p + 1 / n_u))
    return (seen >= min(LEAST, n_p)) & (seen / n_p - share_u >= ERRORS * error)


def fit(
    positive: Sparse, unlabelled: Sparse, prior: float, *, steps: int = 200, rate: float = 0.05, decay: float = 1e-4
) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier that minimises the non-negative PU risk.

    With the logistic loss l, class prior p, and means over positives (P) and
    unlabelled (U), the risk is  p P[l(g)] + max(0, U[l(-g)] - p P[l(-g)]).  The
    second part estimates the risk on negatives, which cannot be negative; where
    it is, the step goes back up along it instead, so that positives hidden
    among the unlabelled are not learned as negatives.  Adam over full batches.
    """
    weights, bias = np.zeros(FEATURES), -1.0
    n_p, n_u = len(positive.lengths), len(unlabelled.lengths)
    if not n_p or not n_u:
        return weights, bias
    usable = telling_words(positive, unlabelled)
    positive, unlabelled = positive.only(usable), unlabelled.only(usable)
    first, second = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    columns = np.append(np.flatnonzero(usable), FEATURES)
    for step in range(1, steps + 1):
        # The chance of being called positive is also the slope of the loss of being called negative.
        s_p, s_u = (_sigmoid(side.scores(weights) + bias) for side in (positive, unlabelled))
        negative_risk = -np.log1p(-s_u.clip(0, 1 - 1e-12)).mean() + prior * np.log1p(-s_p.clip(0, 1 - 1e-12)).mean()
        if negative_risk >= 0:
            rows_p, rows_u = -prior * (1 - s_p) / n_p - prior * s_p / n_p, s_u / n_u
        else:
            rows_p, rows_u = prior * s_p / n_p, -s_u / n_u
        slope = positive.gradient(rows_p) + unlabelled.gradient(rows_u)
        slope = np.append(slope + decay * weights, rows_p.sum() + rows_u.sum())[columns]
        first[columns] = 0.9 * first[columns] + 0.1 * slope
        second[columns] = 0.999 * second[columns] + 0.001 * slope**2
        move = first[columns] / (1 - 0.9**step) / (np.sqrt(second[columns] / (1 - 0.999**step)) + 1e-8)
        weights[columns[:-1]] -= rate * move[:-1]
        bias -= rate * move[-1]
    return weights, float(bias)


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float
    prior: float
    #: Positive and unlabelled texts that it was fitted on.
    fitted: tuple[int, int] = (0, 0)


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
) -> ToxicityModel:
    """Fit the classifier on documents outside the held-out fold.

    Positives are documents that ``labels`` calls toxic; the unlabelled are
    drawn from all documents outside the fold, whatever their label, as the risk
    estimator wants them.  Both are bounded samples of ids, the ones with the
    smallest hashes; an id has one text in each, the one with the least hash if
    it has several, so no more than ``positives + unlabelled`` texts are fitted on.  The class prior is the toxic share of all labelled
    rows outside the fold.  Rows of ``labels`` with a null id or label do not
    count; of several labels of an id the largest holds.  Without any positive,
    every score is below one half.
    """
    learned = bucket_of(F.col(doc_id), FOLDS) != 0
    known = labels.where(learned).where(F.col("toxic").isNotNull()).groupBy(doc_id).agg(F.max("toxic").alias("_toxic"))
    share = known.agg(F.avg((F.col("_toxic") == 1).cast("double"))).first()[0] or 0.0
    prior = min(max(share, 1e-3), 0.5)

    def smallest(ids: DataFrame, limit: int, kind: int) -> DataFrame:
        ids = ids.withColumn("_h", F.xxhash64(doc_id)).orderBy("_h", doc_id).limit(limit)
        return ids.select(doc_id, F.lit(kind).alias("_kind"))

    sample = smallest(known.where("_toxic = 1").select(doc_id), positives, 1).unionByName(
        smallest(docs.where(learned).select(doc_id).distinct(), unlabelled, 0)
    )
    # An id may be in both; of several rows with an id the one with the least hash of its text stands for it.
    hashed = docs.select(doc_id, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_text_hash"))
    one = hashed.join(F.broadcast(sample.select(doc_id).distinct()), doc_id).groupBy(doc_id).agg(F.min("_text_hash").alias("_text_hash"))
    whole = docs.select(doc_id, F.col(text).alias("_text")).withColumn("_text_hash", F.xxhash64(F.coalesce("_text", F.lit(""))))
    # One text for each id, also where its rows are equal.
    texts = whole.join(F.broadcast(one), [doc_id, "_text_hash"]).groupBy(doc_id).agg(F.min("_text").alias("_text"))
    chosen = texts.join(F.broadcast(sample), doc_id)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features_of(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["_kind", "columns"]
            )
        release_memory()

    got = chosen.select("_kind", "_text").mapInArrow(rows, "_kind int, columns array<int>").toArrow()
    kinds = got.column("_kind").to_numpy()
    each = [np.asarray(c, np.int32) for c in got.column("columns").to_pylist()]
    sides = [Sparse.of([c for c, k in zip(each, kinds) if k == kind]) for kind in (1, 0)]
    weights, bias = fit(*sides, prior)
    return ToxicityModel(weights, bias, prior, (len(sides[0].lengths), len(sides[1].lengths)))


def scored(docs: DataFrame, model: ToxicityModel, *, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1, higher: likelier toxic) and ``predicted`` (1 from one half on) from whole texts.

    Null and empty texts get the score of no words.  Columns of these names are
    replaced, all others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, bias = shared.value.weights, shared.value.bias
        for batch in texts:
            found = [weights[features_of(t)].sum() for t in batch.cast(pa.binary()).to_pylist()]
            yield pa.array(_sigmoid(np.array(found, np.float64) + bias))
        release_memory()

    return docs.withColumn("score", score(F.col(text))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
