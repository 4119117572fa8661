"""I-Match fingerprints over randomised lexicons, in Spark's own functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bootloom.llm.common import KEY, plain_words, with_key
from bootloom.operators.lineage import settle

#: The band of inverse document frequency, ln(documents / documents with the term).
LEAST_IDF, MOST_IDF = 3.0, 6.9
#: Of each share of the lexicon, this many random subsets: sparse ones tell long texts apart, dense ones short texts.
SHARES, SUBSETS = tuple(2.0**-k for k in range(2, 10)), 3
#: Terms of a lexicon that is sent to all tasks; a larger one is joined by a shuffle.
BROADCAST_TERMS = 500_000


def lexicon(docs: DataFrame, text: str = "text", least: float = LEAST_IDF, most: float = MOST_IDF) -> DataFrame:
    """(term, subset): the terms within the band over all documents, for each random subset that they are in.

    At most e^most times the mean number of distinct terms of a document are in
    the band, however large the corpus is, and a term is in fewer than two
    subsets on average.  It is in a subset if the part of its MD5 that belongs to
    the subset is below the subset's share.
    """
    total = docs.count()
    terms = docs.select(F.explode(F.array_distinct(plain_words(F.col(text)))).alias("term"))
    counted = terms.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(float(max(total, 1))) / F.col("df"))
    kept = counted.where((idf >= least) & (idf <= most)).select("term")
    subsets = []
    for i, share in enumerate(share for share in SHARES for _ in range(SUBSETS)):
        digest = F.md5(F.concat(F.col("term"), F.lit(f" {i // 8}")).cast("binary"))
        drawn = F.conv(F.substring(digest, 4 * (i % 8) + 1, 4), 16, 10).cast("int")
        subsets.append(F.when(drawn < int(share * 65536), F.lit(i)))
    return kept.select("term", F.explode(F.array_compact(F.array(*subsets))).alias("subset"))


#: The order of documents: null ids first, then by id, and by a hash of their texts.
ORDER = ["_has_id", "doc_id", *KEY]


def _starts(keyed: DataFrame) -> list:
    """Places in the order that cut the documents into about equal ranges, at most one for each shuffle partition."""
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = keyed.select(*ORDER).repartitionByRange(parts, *ORDER)
    firsts = places.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(*ORDER)).alias("first"))
    return [row["first"] for row in firsts.orderBy("first").collect()][1:]


def _bucket(keyed: DataFrame, starts: list) -> Column:
    """The number of ``starts`` at or below the document's place, looked up in two steps."""
    if not starts:
        return F.lit(0)
    kinds = [keyed.schema[c].dataType for c in ORDER]

    def place(row) -> Column:
        return F.struct(*[F.lit(row[c]).cast(kind).alias(c) for c, kind in zip(ORDER, kinds)])

    own = F.struct(*ORDER)
    step = max(1, int(len(starts) ** 0.5))
    blocks = [starts[i : i + step] for i in range(0, len(starts), step)]
    coarse = F.array(*[place(b[0]) for b in blocks])
    fine = F.array(*[F.array(*[place(x) for x in b]) for b in blocks])
    block = F.size(F.filter(coarse, lambda x: x <= own))
    within = F.size(F.filter(F.get(fine, block - 1), lambda x: x <= own))
    return F.when(block > 0, (block - 1) * step + within).otherwise(0)


def with_next(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(``_bucket``, ``_nth``, ``_extra``, doc_id, text, ``next``): each text with the next one by ascending id.

    Null ids come first, equal ids are in the order of a hash of their texts,
    and after the last document comes the first.  The documents are shuffled
    once, by ranges of that order, so many documents without an id, or with one
    and the same, are in many ranges; the first document of a range is also given
    to the range before it, as a row with ``_extra``.
    """
    keyed = with_key(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")))
    keyed = keyed.withColumn("_has_id", F.col("doc_id").isNotNull())
    keyed = keyed.withColumn("_bucket", _bucket(keyed, _starts(keyed))).drop("_has_id")
    order = F.struct(F.col("doc_id").isNotNull().alias("has_id"), "doc_id", *KEY)
    firsts = keyed.groupBy("_bucket").agg(F.min(order).alias("first")).collect()
    firsts = sorted((r["_bucket"], r["first"]["_kd"], r["first"]["_kt"]) for r in firsts)
    before = [(kd, kt, firsts[i - 1][0]) for i, (_, kd, kt) in enumerate(firsts)]
    given = docs.sparkSession.createDataFrame(before, "_kd long, _kt long, _to int")
    places = F.filter(
        F.array(
            F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("x")), F.struct(F.col("_to").alias("b"), F.lit(True).alias("x"))
        ),
        lambda p: p.b.isNotNull(),
    )
    placed = keyed.join(F.broadcast(given), KEY, "left").withColumn("_place", F.explode(places))
    placed = placed.select(F.col("_place.b").alias("_bucket"), F.col("_place.x").alias("_extra"), "doc_id", *KEY, "text")
    inside = Window.partitionBy("_bucket").orderBy("_extra", F.col("doc_id").asc_nulls_first(), *KEY)
    return placed.select(
        "_bucket",
        F.row_number().over(inside).alias("_nth"),
        "_extra",
        "doc_id",
        "text",
        F.coalesce(F.lead("text").over(inside), F.lit("")).alias("next"),
    )


def likeness(a: Column, b: Column) -> Column:
    """The share of equal hashes among the subsets that are not empty for both; 1 for equal fingerprints."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    asked = F.size(F.filter(pairs, lambda p: (p.a != "") | (p.b != "")))
    same = F.size(F.filter(pairs, lambda p: (p.a != "") & (p.a == p.b)))
    return F.when(a == b, 1.0).when(asked == 0, 0.0).otherwise(same / asked)


def _places(hashes: Column, rest: Column) -> Column:
    """Hashes by subset as an array, '' for an empty subset.

    The last place is for a document without a term in any subset: a hash of all
    its terms, so that two such documents are alike only if they are equal in them.
    """
    found = F.map_from_entries(hashes)
    each = [F.coalesce(F.try_element_at(found, F.lit(i)), F.lit("")) for i in range(len(SHARES) * SUBSETS)]
    return F.array(*each, F.when(F.size(hashes) == 0, rest).otherwise(""))


def fingerprints(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A fingerprint of each text and of its edited text, and how alike neighbours are.

    The edited text is the text with its last quarter replaced by the beginning
    of the next document.  A fingerprint is the hashes of the document's terms in
    the random subsets of the lexicon, joined by ``-``.  Null texts count as
    empty; equal texts have equal fingerprints; repeated rows each have a row.

    The terms are exploded, kept if the lexicon has them, and gathered again
    without leaving the partition that the shuffle by ranges has put the
    document in.
    """
    terms = settle(lexicon(docs, text))
    size = terms.count()
    # The row that carries a document's own columns passes the join as a term of its own.
    known = terms.unionByName(docs.sparkSession.createDataFrame([("", -1)], "term string, subset int"))
    near = with_next(docs, text, doc_id)
    n_chars = F.length("text")
    quarter = F.floor(n_chars / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n_chars - quarter), F.substring(F.col("next"), F.lit(1), quarter))
    words = near.select("_bucket", "_nth", "_extra", "doc_id", n_chars.alias("n_chars"), "text", edited.alias("edited")).select(
        "_bucket",
        "_nth",
        F.struct(
            "_extra",
            "doc_id",
            "n_chars",
            F.sha2(F.col("edited").cast("binary"), 256).alias("sha"),
        ).alias("doc"),
        F.array_distinct(plain_words(F.col("text"))).alias("own"),
        F.array_distinct(plain_words(F.col("edited"))).alias("new"),
    )

    def digest(terms: str) -> Column:
        return F.md5(F.array_join(F.array_sort(terms), " ").cast("binary"))

    carried = F.col("doc").withField("rest", digest("own")).withField("new_rest", digest("new"))
    nothing = F.lit(None)

    def flagged(found: Column, flag: int) -> Column:
        return F.transform(found, lambda t: F.struct(t.alias("term"), F.lit(flag).alias("flags"), nothing.alias("doc")))

    exploded = words.withColumn("doc", carried).select(
        "_bucket",
        "_nth",
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("").alias("term"), F.lit(0).alias("flags"), "doc")),
                flagged(F.array_intersect("own", "new"), 3),
                flagged(F.array_except("own", "new"), 1),
                flagged(F.array_except("new", "own"), 2),
            )
        ).alias("t"),
    )
    exploded = exploded.select("_bucket", "_nth", "t.term", "t.flags", "t.doc")
    kept = exploded.join(F.broadcast(known) if size <= BROADCAST_TERMS else known, "term")
    def hashed(flag: int) -> Column:
        own = F.collect_list(F.when(F.col("flags").bitwiseAND(flag) != 0, F.col("term")))
        digest = F.md5(F.array_join(F.array_sort(own), " ").cast("binary"))
        return F.when(F.size(own) > 0, F.substring(digest, 1, 16))

    by_subset = kept.groupBy("_bucket", "_nth", "subset").agg(
        F.max("doc").alias("doc"), hashed(1).alias("own"), hashed(2).alias("new")
    )

    def listed(name: str) -> Column:
        return F.collect_list(F.when(F.col(name).isNotNull(), F.struct("subset", name)))

    gathered = by_subset.groupBy("_bucket", "_nth").agg(
        F.max("doc").alias("doc"), listed("own").alias("own"), listed("new").alias("new")
    )
    hashed_docs = gathered.select(
        "_bucket",
        "_nth",
        "doc.*",
        _places(F.col("own"), F.col("doc.rest")).alias("own"),
        _places(F.col("new"), F.col("doc.new_rest")).alias("new"),
    )
    inside = Window.partitionBy("_bucket").orderBy("_nth")
    whole = hashed_docs.withColumn("after", F.lead("own").over(inside)).where(~F.col("_extra"))
    return whole.select(
        F.col("doc_id").alias(doc_id),
        F.col("n_chars").cast("bigint").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        F.array_join("own", "-").alias("fingerprint"),
        F.array_join("new", "-").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"),
        likeness(F.col("own"), F.col("after")).alias("near_next"),
    )
