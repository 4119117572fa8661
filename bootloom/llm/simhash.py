"""SimHash near-duplicates, with candidates from pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bootloom.llm.common import KEY, unsized, with_key
from bootloom.llm.components import components
from bootloom.llm.simhash_bits import BITS, SHINGLE, simhash
from bootloom.operators.lineage import settle

#: Fingerprints that may share a chain before their links are found through the points between them.
CROWD = 512


@dataclass(frozen=True)
class Ring:
    """How 64 bits are cut into segments on a ring, and what a chain of segments may differ by.

    If two fingerprints differ in at most ``most`` bits, then from some segment
    on every chain of l segments differs in at most l * most / segments bits
    (else the ring could be cut into chains that together differ in more).
    """

    most: int = 4
    segments: int = 5

    def __post_init__(self):
        if self.most % 2:
            raise ValueError("an even number of bits: two fingerprints must have a point half-way")

    @property
    def bounds(self) -> list[tuple[int, int]]:
        """(lowest bit, width) of each segment; widths differ by one at most."""
        cuts = [BITS * i // self.segments for i in range(self.segments + 1)]
        return [(a, b - a) for a, b in zip(cuts, cuts[1:])]

    def budget(self, length: int) -> int:
        return length * self.most // self.segments

    def mask(self, start: int, length: int) -> int:
        """The bits of ``length`` segments from segment ``start`` on, as a signed 64-bit number."""
        bits = 0
        for i in range(start, start + length):
            low, width = self.bounds[i % self.segments]
            bits |= ((1 << width) - 1) << low
        return signed(bits)

    def flips(self, start: int) -> list[int]:
        """How two segments from ``start`` on may differ: the first within its budget, both within theirs."""
        (low, width), (next_low, next_width) = self.bounds[start], self.bounds[(start + 1) % self.segments]
        first, second = range(low, low + width), range(next_low, next_low + next_width)
        return [
            signed(sum(1 << b for b in (*of_first, *of_second)))
            for n in range(self.budget(1) + 1)
            for of_first in combinations(first, n)
            for k in range(self.budget(2) - n + 1)
            for of_second in combinations(second, k)
        ]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: Column, size: int = SHINGLE) -> Column:
    """The SimHash of each whole text as a signed long; 0 for null and for texts without words."""

    @F.arrow_udf("bigint")
    def prints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            found = [signed(simhash(t, size)) for t in batch.cast(pa.binary()).to_pylist()]
            yield pa.array(found, pa.int64())

    return prints(text)


def links(prints: DataFrame, ring: Ring = Ring(), crowd: int = CROWD) -> DataFrame:
    """Pairs (``u``, ``v``) of distinct fingerprints (``fp``) that connect whatever differs in ``ring.most`` bits or fewer.

    Each fingerprint is filed under the two segments that begin at each place of
    the ring, and looked up under all values of them that the chain's budget
    allows.  What meets there must keep the budgets of the longer chains from
    the same place, and then the full distance.  Looking up both ways would find
    each pair twice, so only the larger one of a pair looks up the smaller.

    Where more than ``crowd`` fingerprints share two segments, their pairs could
    grow with the square of their number.  They are linked through midpoints
    instead: two fingerprints within 4 bits have a point within 2 bits of both,
    and all that are near one point are tied to the least of them.  This takes a
    fixed number of rows for each fingerprint and loses no connection.
    """
    start = F.explode(F.array(*[F.lit(i) for i in range(ring.segments)]))
    masks = F.array(*[F.lit(ring.mask(i, 2)) for i in range(ring.segments)])
    filed = prints.select("fp", start.alias("at")).withColumn("chain", F.col("fp").bitwiseAND(masks[F.col("at")]))
    flips = F.array(*[F.array(*[F.lit(x) for x in ring.flips(i)]) for i in range(ring.segments)])
    asked = filed.select(F.col("fp").alias("u"), "at", "chain", F.explode(flips[F.col("at")]).alias("flip"))
    asked = asked.select("u", "at", F.expr("chain ^ flip").alias("chain"))
    crowded = settle(filed.groupBy("at", "chain").count().where(F.col("count") > crowd).select("at", "chain"))
    difference = F.expr("u ^ v")
    kept = F.bit_count(difference) <= ring.most
    for length in range(2, ring.segments):
        of_chain = F.array(*[F.lit(ring.mask(i, length)) for i in range(ring.segments)])[F.col("at")]
        kept = kept & (F.bit_count(difference.bitwiseAND(of_chain)) <= ring.budget(length))
    if crowded.isEmpty():
        met = unsized(asked).join(filed.withColumnRenamed("fp", "v"), ["at", "chain"]).where("v < u")
        return met.where(kept).select("u", "v").distinct()
    sparse = filed.join(crowded, ["at", "chain"], "left_anti")
    met = unsized(asked).join(sparse.withColumnRenamed("fp", "v"), ["at", "chain"]).where("v < u")
    near_crowd = asked.join(crowded, ["at", "chain"], "left_semi").select(F.col("u").alias("fp")).distinct()
    return met.where(kept).select("u", "v").unionByName(_midpoint_links(near_crowd, ring.most)).distinct()


def _midpoint_links(prints: DataFrame, most: int) -> DataFrame:
    near = [signed(sum(1 << b for b in bits)) for n in range(most // 2 + 1) for bits in combinations(range(BITS), n)]
    points = prints.select("fp", F.explode(F.array(*[F.lit(x) for x in near])).alias("x"))
    points = points.select("fp", F.expr("fp ^ x").alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1")
    return unsized(points).join(least, "point").where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


def near_duplicates(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    size: int = SHINGLE,
    ring: Ring = Ring(),
    crowd: int = CROWD,
) -> DataFrame:
    """One row per document: its id, ``_kd`` and ``_kt`` (see ``with_key``), ``fingerprint``, ``component_id``, ``stays``.

    Documents link where their fingerprints differ in ``ring.most`` bits or
    fewer; ``component_id`` is the smallest id in the connected component, the
    document's own included.  ``stays`` marks the one document of each component
    that has this id (documents without an id come last; rows equal in id and
    text are one document).  Texts without words have fingerprint 0 and link
    like any other.  Copies have one fingerprint, so they take part in the search
    once however many they are.
    """
    keyed = with_key(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "_text")
    prints = settle(keyed.select("doc_id", *KEY, fingerprint(F.col("_text"), size).alias("fp")))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *KEY)
    distinct = settle(prints.groupBy("fp").agg(F.min(rank).alias("first")))
    roots = components(links(distinct.select("fp"), ring, crowd))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = rooted.select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("least"))
    found = settle(rooted.join(firsts, "root").select("fp", "least"))
    return prints.join(found, "fp").select(
        F.col("doc_id").alias(doc_id),
        *KEY,
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("least.doc_id").alias("component_id"),
        (F.struct(*KEY) == F.struct(*[F.col(f"least.{k}") for k in KEY])).alias("stays"),
    )


def without_near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **settings) -> DataFrame:
    """The documents that stay, with all their columns: one of each group that ``near_duplicates`` finds.

    Rows equal in id and text are one document, so they stay or go together.
    """
    found = near_duplicates(docs, text=text, doc_id=doc_id, **settings)
    return with_key(docs, text, doc_id).join(found.where("stays").select(*KEY).distinct(), KEY, "left_semi").drop(*KEY)
