"""Mixing sources to target weights by systematic sampling, in Spark's own functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bootloom.llm.common import SPACED_WORD
from bootloom.operators.lineage import settle

#: Weights of the sources in order, repeated as often as needed.
WEIGHTS = (3, 1, 2)
#: What the mix takes, as a share of all words, and at most of each source.
SHARE, MOST = 1.5, 2
#: Expected copies are whole multiples of 1 / 2^so many, so that sums of them are exact.
RATE_BITS = 26


def running(rows: DataFrame, order: list[str], sums: dict[str, Column], by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Sums over earlier rows in a total order, in two levels, so that no key needs to fit one task.

    Returns the rows, dealt out by ranges of (``by``, ``order``) and written, with
    ``_range`` and the sums over earlier rows of the same range and key; and one row
    for each range and key with the same sums over earlier ranges (``_before_``)
    and its own (``_own_``).  ``order`` must tell all rows apart that are many.
    """
    keys = [by] if by else []
    placed = settle(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    earlier = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    local = placed.withColumns({n: F.coalesce(F.sum(e).over(earlier), none) for n, e in sums.items()})
    own = placed.groupBy("_range", *keys).agg(*[F.sum(e).alias(f"_own_{n}") for n, e in sums.items()])
    ranges = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return local, own.withColumns({f"_before_{n}": F.coalesce(F.sum(f"_own_{n}").over(ranges), none) for n in sums})


def _whole(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Rows with the sums over all earlier rows."""
    local, ranges = running(rows, order, sums)
    joined = local.join(ranges.drop(*[f"_own_{n}" for n in sums]), "_range")
    return joined.withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in sums}).drop(*[f"_before_{n}" for n in sums])


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Add ``target`` to a table of sources (``_source`` and its ``source_size``).

    Sources in their order have the weights in turn.  All targets together are
    ``share`` times all sizes; one stops at ``most`` times its source's size, and what
    is above goes to the others by weight.  That is a water level: each target
    is the weight times the level, or where it stops.  With the sources by the
    level at which they stop, the level is the largest of what is left for a
    source and those after it, divided by their weights.
    """
    one = F.lit(1).cast("bigint")
    ranked = _whole(sizes, ["_source"], {"_rank": one})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    stops = ranked.drop("_range").withColumn("_weight", weight).withColumn("_stop", F.col("source_size") * F.lit(float(most)))
    stops = stops.withColumn("_level", F.col("_stop") / F.col("_weight"))
    sums = {"_stopped": F.col("_stop"), "_used": F.col("_weight")}
    ordered = settle(_whole(stops, ["_level", "_source"], sums))
    size, weight_sum = ordered.agg(F.sum("source_size"), F.sum("_weight")).first()
    left = (F.lit(share * (size or 0)) - F.col("_stopped")) / (F.lit(weight_sum or 1.0) - F.col("_used"))
    level = ordered.agg(F.max(left)).first()[0] or 0.0
    return ordered.select("_source", "source_size", F.least("_stop", F.col("_weight") * F.lit(level)).alias("target"))


def _counted(
    docs: DataFrame,
    row: Column,
    text: str,
    doc_id: str,
    source: str,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = 0,
) -> DataFrame:
    """:func:`copies`, with ``row`` as ``_row``, which tells equal rows apart."""
    whole = F.coalesce(F.col(text), F.lit(""))
    name = F.col(source).cast("string")
    rows = settle(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            name.alias("source"),
            # Null after all names, in one order of code points.
            F.when(name.isNull(), "t").otherwise(F.concat(F.lit("s"), name)).alias("_source"),
            F.xxhash64(whole).alias("_key"),
            F.regexp_count(whole, F.lit(SPACED_WORD)).cast("bigint").alias("size"),
            row.alias("_row"),
        )
    )
    sizes = settle(rows.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs")))
    wanted = targets(sizes.select("_source", "source_size"), weights, share, most).join(sizes.drop("source_size"), "_source")
    unit = 1 << RATE_BITS
    rate = F.round(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) * unit)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_source"))), 1, 6), 16, 10).cast("bigint")
    wanted = wanted.withColumns({"_rate": rate.cast("bigint"), "_offset": offset * (unit >> 24)})
    order = ["size", "doc_id", "_key", "_row"]
    local, ranges = running(rows, order, {"_nth": F.lit(1).cast("bigint")}, by="_source")
    ranges = ranges.join(wanted, "_source").drop("_own__nth")
    nth = F.col("_nth") + F.col("_before__nth")

    def reached(n: Column) -> Column:
        return F.shiftright(n * F.col("_rate") + F.col("_offset"), RATE_BITS)

    # Up with every second document, and down with the others.
    half = F.shiftright(nth, 1)
    place = F.when(nth % 2 == 0, half).otherwise(F.col("_docs") - 1 - half)
    taken = reached(place + 1) - reached(place)
    return local.join(ranges, ["_range", "_source"]).select(
        "_row", "doc_id", "source", "size", "source_size", "target", taken.alias("n_copies")
    )


def copies(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = 0,
) -> DataFrame:
    """How often the mix takes each document: ``n_copies``, beside ``size``, ``source_size`` and ``target``.

    ``size`` is the number of words; null and empty texts have none.  Every
    document of a source is expected ``target / source_size`` times.  Along the
    source's documents, by size and then id, these expectations are added up, from
    an offset that the seed and the source's name give; a document is taken once
    for each whole number that the sum reaches with it.  So it is taken the whole
    number of times below or above its expectation, at most ``most`` times if
    that is whole, and as neighbours have like sizes, the words taken from a
    source differ from its target by no more than its largest document.

    One row per document: ``doc_id``, ``source`` and the columns above.  A null source is a source, the last one; null ids are
    documents.  Rows that are equal in source, id and text are taken in turn, and
    only which of them is which is open.  A source without words has target 0,
    and its documents are not taken.  Other columns of ``docs`` are not carried,
    so their names cannot clash; an empty table gives no rows.
    """
    rows = _counted(docs, F.monotonically_increasing_id(), text, doc_id, source, weights, share, most, seed)
    return rows.drop("_row")


def mixed(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with all their columns and ``copy`` from 1.

    A column ``copy`` of ``docs`` is replaced.  Options are those of :func:`copies`.
    The rows are written once with a number each, so that equal ones are told apart.
    """
    kept = settle(docs.drop("copy").withColumn("_mix_row", F.monotonically_increasing_id()))
    counted = _counted(kept, F.col("_mix_row"), text, doc_id, source, **options).where("n_copies > 0")
    taken = kept.join(counted.select(F.col("_row").alias("_mix_row"), F.col("n_copies").alias("_mix_times")), "_mix_row")
    repeated = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_mix_times"))).alias("copy")
    return taken.select(*[c for c in docs.columns if c != "copy"], repeated)
