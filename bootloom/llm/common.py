"""What several operators share."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words between ASCII white space, and words of ASCII letters and digits and all other characters.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_SPACE = re.compile(rb"[ \t-\r]")


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and all else as it is.

    The whole-Unicode ``lower`` would change more letters, so only pure ASCII
    texts take that faster way.
    """
    pure = F.length(text) == F.octet_length(text)
    return F.when(pure, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def plain_words(text: Column) -> Column:
    """The lower-cased plain words of a text; none for null."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"({PLAIN_WORD})"), F.lit(1))


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def cut_at_space(data: bytes, limit: int) -> Iterator[bytes]:
    """``data`` in parts of about ``limit`` bytes, cut only at ASCII white space; a longer word stays whole."""
    start = 0
    while len(data) - start > limit:
        found = _SPACE.search(data, start + limit)
        if not found:
            break
        yield data[start : found.start()]
        start = found.end()
    yield data[start:] if start else data


def with_key(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Add ``_kd`` and ``_kt``, two non-null longs that name a document: its id and its text.

    Rows that are equal in both count as one document, and operators that join
    a result back give each of them the same result.
    """
    return docs.withColumns(
        {
            "_kd": F.coalesce(F.xxhash64(doc_id), F.lit(0)),
            "_kt": F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(doc_id).isNull()),
        }
    )


def unsized(df: DataFrame) -> DataFrame:
    """``df``, whose joins are to sort and merge whatever size Spark takes it for.

    Spark does not know how many rows an explode makes: it sizes the result, and all
    sums and distinct rows of it, like the table that was exploded.  A few MB of that would be
    broadcast by way of the driver, with some seventy times their rows.
    """
    return df.hint("merge")


KEY = ["_kd", "_kt"]

#: Bitmaps of 4 KB in which ``marked`` files keys.
MAPS = 256


def marked(keyed: DataFrame, wanted: DataFrame, maps: int = MAPS) -> DataFrame:
    """``keyed`` documents (see ``with_key``) with ``_marked``: true for all whose key is in ``wanted``, and some others.

    A join that needs few of the texts then shuffles little more than these.  The
    keys are bits in ``maps`` bitmaps of 4 KB, which are broadcast: 1 MB, however
    many keys there are, so what is marked has still to be joined.
    """
    width = 8 * 4096
    place = F.pmod(F.xxhash64(*KEY), F.lit(maps * width))
    filed = wanted.select(F.floor(place / width).alias("_map"), (place % width).alias("_at"))
    bits = filed.groupBy("_map").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    told = keyed.withColumns({"_map": F.floor(place / width), "_at": place % width})
    told = told.join(F.broadcast(bits), "_map", "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    is_set = F.getbit(byte.cast("bigint"), (F.col("_at") % 8).cast("int")) == 1
    return told.withColumn("_marked", F.coalesce(is_set, F.lit(False))).drop("_map", "_at", "_bits")


def bounded_batches(spark: SparkSession, size: int = 16 << 20) -> None:
    """Have the session send at most about ``size`` bytes at once to a Python worker, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def release_memory() -> None:
    """Give back what a Python worker has freed, at the end of a task: the same worker goes on to other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
