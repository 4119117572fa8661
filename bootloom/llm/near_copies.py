"""Near-copies of documents: SimHash with pigeonring, then an exact similarity join over sets of word shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bootloom.llm.common import KEY, marked, release_memory, unsized, with_key
from bootloom.llm.components import components
from bootloom.llm.simhash import Ring, links, signed
from bootloom.llm.simhash_bits import majority
from bootloom.operators.lineage import drop_settled, settle

#: Words of a shingle, and the Jaccard similarity from which two texts are near-copies.
SHINGLE, THRESHOLD = 5, 0.8
#: One text in so many tells which shingles are common: those that this many of them have, at most the largest number.
SAMPLE, COMMON, MOST_COMMON = 64, 8, 1 << 17
#: Bits of a set's sketch, in longs: as it goes with looked-up shingles, and the fewest of its whole sketch.
SKETCH = 4
#: Meetings for each looked-up shingle above which crowds are tied before all that meet are compared, and how many others
#: at the same shingle a set is held against in a turn of that.
CROWDED, NEIGHBOURS = 4, 4
_EPS = 1e-9


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct 64-bit hashes of the runs of ``size`` words of a UTF-8 text, in order.

    A-Z count as a-z and words stand between ASCII white space; a text of fewer
    words is one run, a text without words has none.
    """
    words = text.lower().split() if text else []
    run = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    found = {digest(b" ".join(words[i : i + run])) for i in range(len(words) - run + 1)} if words else set()
    return np.sort(np.fromiter(found, np.uint64, len(found)).view(np.int64))


def prefix_length(n: int, threshold: float) -> int:
    """How many of n shingles are looked up: two sets that are similar enough have one of these in common."""
    return n - int(np.ceil(threshold * n - _EPS)) + 1 if n else 0


def sketch(hashes: np.ndarray, longs: int = SKETCH) -> np.ndarray:
    """For each of some classes of hashes, whether their number is odd, as the bits of longs.

    A hash that only one of two sets has changes one bit, so the sketches differ in no
    more bits than the sets do in hashes.  Of a sketch of twice the longs, the halves'
    exclusive or is the sketch.
    """
    odd = np.bincount(hashes.view(np.uint64) % np.uint64(64 * longs), minlength=64 * longs) % 2
    return np.packbits(odd.astype(bool)).view(np.int64)


def whole_sketch(hashes: np.ndarray) -> np.ndarray:
    """A sketch with a bit for each hash at least: few bits tell nothing of large sets, about half of them differ anyway."""
    longs = SKETCH
    while 64 * longs < len(hashes):
        longs *= 2
    return sketch(hashes, longs)


def _common(keyed: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts of a sample have, in order, with their counts; they only set the order of lookups."""

    @F.arrow_udf("array<bigint>")
    def all_of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([shingles(t, size) for t in batch.cast(pa.binary()).to_pylist()], pa.list_(pa.int64()))
        release_memory()

    sample = keyed.where(F.pmod("_kt", F.lit(SAMPLE)) == 0).select("_kt", "_text").dropDuplicates(["_kt"])
    counted = sample.select(F.explode(all_of(F.col("_text"))).alias("h")).groupBy("h").count().where(F.col("count") >= COMMON)
    rows = counted.orderBy(F.desc("count"), "h").limit(MOST_COMMON).collect()
    names, counts = np.array([r["h"] for r in rows], np.int64), np.array([r["count"] for r in rows], np.int64)
    order = np.argsort(names)
    return names[order], counts[order]


def _simhash_pairs(prints: DataFrame, ring: Ring) -> DataFrame:
    """Pairs (``u``, ``v``) of sets ``s`` that SimHash takes for near-copies, one or two for each set.

    Sets with one fingerprint ``fp`` are paired with the least of them, and these
    where pigeonring links their fingerprints, each with its least neighbour.
    """
    first = settle(prints.groupBy("fp").agg(F.min("s").alias("first")))
    same = prints.join(first, "fp").where("s <> first").select(F.col("s").alias("u"), F.col("first").alias("v"))
    linked = links(first.select("fp"), ring).groupBy("u").agg(F.min("v").alias("v"))
    near = linked.join(first.select(F.col("fp").alias("u"), F.col("first").alias("s")), "u")
    near = near.join(first.select(F.col("fp").alias("v"), F.col("first").alias("s2")), "v")
    near = near.select(F.greatest("s", "s2").alias("u"), F.least("s", "s2").alias("v"))
    return same.unionByName(near)


def _of_similar_size(n: Column, n2: Column, threshold: float) -> Column:
    return F.least(n, n2) >= threshold * F.greatest(n, n2) - _EPS


def _may_differ(n: Column, n2: Column, threshold: float) -> Column:
    """In how many shingles two near-copies of these sizes differ at most."""
    return (1 - threshold) / (1 + threshold) * (n + n2) + _EPS


def _near_enough(a: Callable[[str], Column], b: Callable[[str], Column], threshold: float) -> Column:
    """Whether two sets of sizes ``n`` may be near-copies as far as their sketches tell; ``a`` and ``b`` give their columns."""
    differ = sum((F.bit_count(a(f"k{i}_").bitwiseXOR(b(f"k{i}_"))) for i in range(SKETCH)), F.lit(0))
    return differ <= _may_differ(a("n"), b("n"), threshold)


def _short(k: str, i: int) -> Column:
    """The i-th of ``SKETCH`` longs that whole sketches of any length fold to."""
    return F.aggregate(F.filter(k, lambda x, at: at % SKETCH == i), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x))


def _wholly_near_enough(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The ``pairs`` that may be near-copies as far as their sizes and whole sketches tell."""
    own = sets.select(F.col("s").alias("u"), F.col("n").alias("nu"), F.col("k").alias("ku"))
    other = sets.select(F.col("s").alias("v"), F.col("n").alias("nv"), F.col("k").alias("kv"))
    n, n2 = F.col("nu"), F.col("nv")

    def folded(k: str, to: str) -> Column:
        # Sets of similar sizes have sketches of one length, or one has twice the longs.
        half = F.floor(F.size(k) / 2).cast("int")
        halves = F.zip_with(F.slice(k, F.lit(1), half), F.slice(k, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(k) > F.size(to), halves).otherwise(F.col(k))

    bits = F.zip_with(folded("ku", "kv"), folded("kv", "ku"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(bits, F.lit(0), lambda a, x: a + x)
    both = pairs.join(own, "u").join(other, "v")
    similar = F.when(_of_similar_size(n, n2, threshold), differ <= _may_differ(n, n2, threshold))
    return both.where(similar).select("u", "v")


def _apart(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` at shingles where sets of different ``root`` meet; ``earlier`` adds up to the number of these meetings."""
    place = Window.partitionBy("h")
    rooted = rows.join(roots.withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    # Ranks by root count the rows of smaller roots, with no need to hold those of one root.
    rooted = rooted.withColumn("earlier", F.rank().over(place.orderBy("root")).cast("bigint") - 1)
    return rooted.withColumn("most", F.max("earlier").over(place)).where("most > 0").drop("most")


def _neighbours(rooted: DataFrame, threshold: float, turn: int) -> DataFrame:
    """Pairs (``u``, ``v``) of sets apart that stand near each other at a shingle, in an order of this turn, with near sketches."""
    nearby = Window.partitionBy("h").orderBy(F.xxhash64("s", "h", F.lit(turn)))
    own = F.struct("s", "n", "root", *[f"k{i}_" for i in range(SKETCH)])
    others = F.array(*[F.lag(own, i).over(nearby) for i in range(1, NEIGHBOURS + 1)])

    def may_be(o: Column) -> Column:
        fits = _of_similar_size(F.col("n"), o["n"], threshold)
        return o.isNotNull() & (o["root"] != F.col("root")) & fits & _near_enough(F.col, lambda c: o[c], threshold)

    met = rooted.select("*", others.alias("others")).select("s", F.explode(F.filter("others", may_be)).alias("o"))
    return met.select(F.greatest("s", "o.s").alias("u"), F.least("s", "o.s").alias("v")).distinct()


def _links(
    rows: DataFrame, sets: DataFrame, texts: Callable[[DataFrame], DataFrame], size: int, threshold: float, ring: Ring
) -> DataFrame:
    """Pairs (``u``, ``v``) of sets that are near-copies.

    ``rows`` are looked-up shingles ``h`` with their set ``s``, its size ``n`` and
    the shingle's place ``at`` in the common order; ``sets`` have the size ``n``, the
    fingerprint ``fp`` and the whole sketch ``k`` of each set, and ``texts`` gives a text for each
    set that is asked for.  First the pairs of SimHash are compared, and every set with
    the least one at each of its shingles, which ties crowds of near-copies together.
    As long as many still meet that are not tied, each set is held against a few others
    at each of its shingles, in turns and in another order each time: a crowd of n is tied
    by some n comparisons and not by the square of n.  Then all pairs that meet, are not
    tied yet and whose sketches are near enough are compared: what SimHash's few bits and
    the turns miss is found here, so nothing depends on the turns but what it costs.

    A pair that meets must leave room for the overlap from its first place on, and of
    the one whose looked-up shingles end first, those that did not meet are not
    in the other.  What keeps both bounds, and that of the whole sketches, is compared in full:
    texts are fetched for these pairs only.
    """

    @F.arrow_udf("array<bigint>")
    def all_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([shingles(t, size) for t in batch.cast(pa.binary()).to_pylist()], pa.list_(pa.int64()))
        release_memory()

    def bounded(met: DataFrame) -> DataFrame:
        overlap = threshold / (1 + threshold) * (F.col("n") + F.col("n2")) - _EPS
        fits = _of_similar_size(F.col("n"), F.col("n2"), threshold)
        room = F.max(F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))).alias("room")
        pairs = met.where(fits).groupBy(F.greatest("s", "s2").alias("u"), F.least("s", "s2").alias("v"))
        larger, smaller = F.max(F.greatest("n", "n2")).alias("n"), F.max(F.least("n", "n2")).alias("n2")
        pairs = pairs.agg(F.count("*").alias("c"), room, larger, smaller)
        behind = F.ceil(threshold * F.col("n") - _EPS) - 1
        return pairs.where((F.col("room") >= overlap) & (F.col("c") + behind >= overlap)).select("u", "v")

    def alike(pairs: DataFrame) -> DataFrame:
        pairs = settle(_wholly_near_enough(pairs, sets, threshold))
        asked = pairs.select(F.explode(F.array("u", "v")).alias("s")).distinct()
        wanted = settle(sets.join(unsized(asked), "s", "left_semi").select("s", *KEY))
        full = settle(texts(wanted).select("s", all_of(F.col("_text")).alias("all")).dropDuplicates(["s"]))
        both = pairs.join(full.select(F.col("s").alias("u"), F.col("all").alias("a")), "u")
        both = both.join(full.select(F.col("s").alias("v"), F.col("all").alias("b")), "v")
        shared = F.size(F.array_intersect("a", "b"))
        enough = shared >= threshold * (F.size("a") + F.size("b") - shared) - _EPS
        found = settle(both.where(enough).select("u", "v"))
        for used in (pairs, wanted, full):
            drop_settled(used)
        return found

    place = Window.partitionBy("h")
    least = F.min(F.struct("s", "n", "at")).over(place)
    starred = rows.withColumn("least", least).select(
        "s", "n", "at", *[F.col(f"least.{c}").alias(f"{c}2") for c in ("s", "n", "at")]
    )
    # Sets that nobody meets are no near-copies, whatever their fingerprints.
    by_simhash = _simhash_pairs(sets.select("s", "fp").join(rows.select("s").distinct(), "s", "left_semi"), ring)
    roots = components(alike(bounded(starred.where("s <> s2")).unionByName(by_simhash).distinct()))
    sketches = sets.select("s", *[_short("k", i).alias(f"k{i}_") for i in range(SKETCH)])
    turn, before, rooted = 0, None, None
    while True:
        last, rooted = rooted, settle(_apart(rows, roots))
        if last is not None:
            drop_settled(last)
        kept, meetings = rooted.agg(F.count("*"), F.sum("earlier")).first()
        # A turn that ties little of what meets is the last: the rest are no near-copies, or few.
        if not kept or meetings <= CROWDED * kept or (before and meetings > 0.8 * before):
            break
        turn, before = turn + 1, meetings
        rows = rooted.select("s", "n", "at", "h")
        found = alike(_neighbours(rooted.drop("at", "earlier").join(sketches, "s"), threshold, turn))
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(found))
    rooted = rooted.drop("earlier").join(sketches, "s")
    other = rooted.select("h", *[F.col(c).alias(f"{c}2") for c in rooted.columns if c != "h"])
    met = rooted.join(other, "h").where("s > s2 and root <> root2").where(_near_enough(F.col, lambda c: F.col(f"{c}2"), threshold))
    return roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(alike(bounded(met)))


def near_copies(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    size: int = SHINGLE,
    threshold: float = THRESHOLD,
    ring: Ring = Ring(),
) -> DataFrame:
    """One row per document: its id, ``_kd`` and ``_kt`` (see ``with_key``), ``component_id``, ``stays``.

    Documents link where the Jaccard similarity of their sets of shingles is at
    least ``threshold``; ``component_id`` is the smallest id in the connected
    component, and ``stays`` marks the one document that has it (documents
    without an id come last; rows equal in id and text are one document).  Texts
    without words are copies of each other.

    SimHash ties what is within ``ring.most`` bits, by pigeonring as in
    :mod:`bootloom.llm.simhash` but from the set of shingles, and what it ties is
    compared in full.  The join then finds the rest and is exact.  Each set stands in one order of all shingles, and two
    similar sets meet within their first fifth (at 0.8), where the first shingle
    that both have must leave room for the overlap.  Common shingles, as a
    sample tells, come last in that order; this changes what it costs, never
    what is found.  Shingles are told apart by 64-bit hashes.  Copies are one
    set, however many they are.
    """
    spark = docs.sparkSession
    keyed = with_key(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "_text")
    shared = spark.sparkContext.broadcast(_common(keyed, size))

    @F.arrow_udf("struct<s: bigint, n: int, fp: bigint, k: array<bigint>, prefix: array<bigint>>")
    def looked_up(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, counts = shared.value
        for batch in texts:
            ids, sizes, prints, sketches, prefixes = [], [], [], [], []
            for value in batch.cast(pa.binary()).to_pylist():
                own = shingles(value, size)
                ids.append(xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63))
                sizes.append(len(own))
                prints.append(signed(majority(own.astype(">u8"))))
                sketches.append(whole_sketch(own))
                if len(names):
                    at = np.minimum(np.searchsorted(names, own), len(names) - 1)
                    own = own[np.argsort(np.where(names[at] == own, counts[at], 0), kind="stable")]
                prefixes.append(own[: prefix_length(len(own), threshold)])
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (sketches, prefixes)]
            columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), *lists]
            yield pa.StructArray.from_arrays(columns, ["s", "n", "fp", "k", "prefix"])
        release_memory()

    seen = settle(keyed.select("doc_id", *KEY, looked_up(F.col("_text")).alias("of")).select("doc_id", *KEY, "of.*"))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *KEY)
    distinct = seen.groupBy("s").agg(F.min(rank).alias("first"), *[F.first(c).alias(c) for c in ("n", "fp", "k", "prefix")])
    distinct = settle(distinct)
    looked = distinct.select("s", "n", F.posexplode("prefix").alias("at", "h"))
    rows = settle(looked.withColumn("times", F.count("*").over(Window.partitionBy("h"))).where("times > 1").drop("times"))
    # Most of what was written are prefixes; none are needed from here on.
    named, sets = settle(seen.select("doc_id", *KEY, "s")), settle(distinct.drop("prefix"))
    drop_settled(seen)
    drop_settled(distinct)

    def texts(wanted: DataFrame) -> DataFrame:
        return marked(keyed, wanted).where("_marked").join(wanted, KEY).select("s", "_text")

    links_of = sets.select("s", "n", "fp", "k", *[f"first.{k}" for k in KEY])
    roots = components(_links(rows, links_of, texts, size, threshold, ring))
    rooted = sets.select("s", "first").join(roots.withColumnRenamed("node", "s"), "s", "left")
    rooted = rooted.select("s", "first", F.coalesce("root", "s").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("least"))
    found = settle(rooted.join(firsts, "root").select("s", "least"))
    return named.join(found, "s").select(
        F.col("doc_id").alias(doc_id),
        *KEY,
        F.col("least.doc_id").alias("component_id"),
        (F.struct(*KEY) == F.struct(*[F.col(f"least.{k}") for k in KEY])).alias("stays"),
    )


def without_near_copies(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **settings) -> DataFrame:
    """The documents that stay, with all their columns: one of each group that ``near_copies`` finds.

    Rows equal in id and text are one document, so they stay or go together.
    """
    found = near_copies(docs, text=text, doc_id=doc_id, **settings)
    # Fewer go than stay, and most texts that stay need no shuffle.
    going = settle(found.where("not stays").select(*KEY).distinct())
    told = marked(with_key(docs, text, doc_id), going)
    staying = told.where("_marked").join(going, KEY, "left_anti")
    return told.where("not _marked").unionByName(staying).drop("_marked", *KEY)
