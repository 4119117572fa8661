"""What filters take from each other, over all orders they could be applied in.

Filters stand in lexicographic order of their letters, and so do their orders:
an order's Lehmer rank is its place among all of them.  Documents that fail the
same filters behave alike in every order, and the orders that begin alike are
neighbours.  So what happens to a mask of failing filters at a step is a few
intervals of ranks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bootloom.llm.common import release_memory
from bootloom.operators.lineage import settle

#: The filters' letters; a document's mask has bit k if it fails the k-th.
FILTERS = "ABCDE"
#: Fewest words, least percentage of distinct words, most percentage of capitals, signs.
FEWEST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
SIGNS = re.compile(rb"[#$%&*|]")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: What is counted of the documents of a mask.
COUNTED = ["documents", "good", "toxic"]
RESULTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_mask(text: bytes, code_points: int) -> int:
    """Which of the filters A to D a text fails: few words, repeated words, capitals, signs."""
    words = text.split()
    n = len(words)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (
        (n < FEWEST_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * n) << 1
        | (100 * capitals > CAPITAL_PERCENT * code_points) << 2
        | (SIGNS.search(text) is not None) << 3
    )


def _text_masks(text: Column) -> Column:
    @F.arrow_udf("int")
    def masks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            points = pc.utf8_length(texts)
            rows = zip(texts.cast(pa.binary()), points.to_pylist())
            yield pa.array([text_mask(t.as_py(), n) for t, n in rows], pa.int32())
        release_memory()

    return masks(text)


def failing(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """(``doc_id``, ``part``, ``mask``) of each document, as a table.

    Null texts are empty, null sources are the empty part.  Filter E fails where
    another document of the whole table has the same text and a smaller id; a
    null id is larger than any other.  Rows that are equal in id and text do not
    fail it by each other.  Texts are compared by SHA-256, so none of them moves.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = settle(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"),
            F.unhex(F.sha2(whole, 256)).alias("_text"),
            _text_masks(whole).alias("mask"),
        )
    )
    # Only texts that several rows have go into the join; it is split where one text has very many.
    least, n = F.min("doc_id").alias("_least"), F.count("*").alias("_n")
    several = settle(rows.groupBy("_text").agg(least, n).where("_n > 1 and _least is not null").drop("_n"))
    copy = F.col("_least").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("_least")))
    found = rows.join(several, "_text", "left")
    return found.select("doc_id", "part", F.when(copy, F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"))


@lru_cache
def _prefixes(n: int) -> list[tuple[tuple[int, ...], int, int]]:
    """(filters so far, first rank, rank after the last) for each beginning of an order of ``n`` filters."""
    found = []
    for step in range(1, n + 1):
        width = factorial(n - step)
        found += [(order, k * width, (k + 1) * width) for k, order in enumerate(permutations(range(n), step))]
    return found


def audit_counts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The audit of one part: (orders, steps, RESULTS) and the orders' filters (orders, steps).

    ``counts`` has a row for each mask and a column for each of COUNTED.  Each
    beginning of an order is an interval of ranks, in which the filter that was
    applied last meets the same documents: the counts are added at its start and
    taken off at its end, and sums along the ranks give every order.
    """
    n = int(len(counts)).bit_length() - 1
    ranks = factorial(n)
    steps = np.zeros((ranks + 1, n, len(RESULTS)), np.int64)
    for order, start, stop in _prefixes(n):
        last, earlier = order[-1], sum(1 << f for f in order[:-1])
        masks = np.arange(len(counts))
        fails, gone = (masks >> last & 1).astype(bool), (masks & earlier).astype(bool)
        documents, good, toxic = counts[fails & ~gone].sum(axis=0)
        found = [0, documents, counts[fails & gone, 0].sum(), counts[1 << last, 0], good, toxic]
        steps[start, len(order) - 1] += found
        steps[stop, len(order) - 1] -= found
    steps = np.cumsum(steps, axis=0)[:-1]
    steps[:, :, 0] = counts[:, 0].sum() - np.cumsum(steps[:, :, 1], axis=1)
    return steps, np.array(list(permutations(range(n))))


def _audit_part(key: tuple, rows: pa.Table) -> pa.Table:
    """All orders and steps of one part, from at most one row for each mask."""
    counts = np.zeros((1 << len(FILTERS), len(COUNTED)), np.int64)
    counts[rows.column("mask").to_numpy()] = np.stack([rows.column(c).to_numpy() for c in COUNTED], axis=1)
    steps, orders = audit_counts(counts)
    by_filter = np.bincount(orders.ravel(), minlength=len(FILTERS)) * 0
    np.add.at(by_filter, orders.ravel(), steps[:, :, RESULTS.index("removed")].ravel())
    n = len(FILTERS)
    names = ["".join(FILTERS[f] for f in order) for order in orders]
    return pa.table(
        {
            "part": pa.array([key[0].as_py()] * steps[:, :, 0].size, pa.string()),
            "filter_order": pa.array(np.repeat(names, n)),
            "step": pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders))),
            **{c: pa.array(steps[:, :, k].ravel()) for k, c in enumerate(RESULTS)},
            "shapley": pa.array(by_filter[orders.ravel()]),
        }
    )


def filter_audit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """Of each source (``part``), each order of the five filters and each ``step``: what the step's filter does.

    ``kept`` after the step, ``removed`` by it, ``redundant`` (fails the filter but
    went earlier), ``unique_fails`` (fails no other filter), ``good_lost`` and
    ``toxic_lost`` (removed here, with label ``quality`` or ``toxic`` 1), and
    ``shapley``: what the filter removes at any step, summed over all orders.
    The filters are those of :func:`failing`.

    Labels are those of the document's id; of several the largest holds, and a
    document with a null id, or whose id has no label, is neither good nor toxic.
    Repeated rows count each.  Other columns of ``docs`` are not carried, so
    their names cannot clash.  An empty table has no parts and no rows.

    Documents are counted by part and mask before anything is brought together,
    so a part with any share of them makes 32 rows; a part's 600 rows of results
    come from these.
    """
    flags = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(
        F.max(F.col("quality") == 1).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic")
    )
    found = failing(docs, text=text, doc_id=doc_id, source=source).join(settle(flags), "doc_id", "left")
    counts = found.groupBy("part", "mask").agg(
        F.count("*").alias("documents"), F.count_if("_good").alias("good"), F.count_if("_toxic").alias("toxic")
    )
    ddl = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in [*RESULTS, "shapley"])
    return counts.groupBy("part").applyInArrow(_audit_part, ddl)
