"""Benchmark passages in documents, found by Wu-Manber search over words."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bootloom.llm.common import release_memory
from bootloom.operators.lineage import settle

#: Words of a window, and bytes of benchmark text in one block of patterns.
WINDOW = 10
BLOCK_BYTES = 32 << 20
#: Words of ASCII letters and digits and all other characters, over bytes in lower case.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

# Odd multipliers that spread the numbers of a block's words over a table.
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall(text.encode().lower()) if text else []


class WuManber:
    """Search for all windows of one length in a text of word numbers.

    ``words`` has the number of each word that is in a window, ``text`` the numbers
    of all items' words, one after another; a window is a place in it.  ``shift``
    says by hash of a block of words how far the search may move when such a block
    ends at the current place; a block that is in no window lets it skip all
    places that the block would cover.  Where the shift is 0 the block may be the
    suffix of some windows: those of the suffix's hash are in one bucket, and
    their words are compared.  Equal windows are one, with the items of all.

    All of it is a few arrays, about 30 bytes for each window.
    """

    def __init__(self, words: dict[bytes, int], text: np.ndarray, starts: np.ndarray, items: np.ndarray, length: int):
        self.words, self.text, self.length, self.block = words, text, length, min(2, length)
        self.skip = length - self.block + 1
        # Equal windows side by side; should two that differ have one hash, they stay two.
        key = np.zeros(len(starts), np.uint64)
        for k in range(length):
            key = (key ^ text[starts + k].astype(np.uint64)) * np.uint64(_MIX[0])
            key ^= key >> np.uint64(29)
        order = np.lexsort((items, key))
        starts, items, key = starts[order], items[order], key[order]
        new = np.ones(len(starts), bool)
        new[1:] = key[1:] != key[:-1]
        for k in range(length):
            new[1:] |= text[starts[1:] + k] != text[starts[:-1] + k]
        first = np.flatnonzero(new)
        self.items, self.ends = items.astype(np.int32), np.append(first, len(items)).astype(np.int32)
        self.starts = starts[first].astype(np.int32)

        self.bits = max(8, int(np.ceil(np.log2(2 * len(first) + 1))))
        shift = np.full(1 << self.bits, self.skip, np.uint8)
        for end in range(self.block, length + 1):
            place = self._hashes(self.starts + end - self.block)
            np.minimum.at(shift, place, np.uint8(length - end))
        self.shift = shift.tobytes()
        suffix = self._hashes(self.starts + length - self.block)
        self.by_suffix = np.argsort(suffix, kind="stable").astype(np.int32)
        self.buckets = np.searchsorted(suffix[self.by_suffix], np.arange((1 << self.bits) + 1)).astype(np.int32)

    def _hashes(self, places: np.ndarray) -> np.ndarray:
        mixed = np.zeros(len(places), np.uint64)
        for k in range(self.block):
            mixed += (self.text[places + k].astype(np.uint64) + np.uint64(1)) * np.uint64(_MIX[k])
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    @property
    def nbytes(self) -> int:
        arrays = (self.items, self.ends, self.starts, self.by_suffix, self.buckets)
        return sum(a.nbytes for a in arrays) + len(self.shift)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """(start, numbers of items) of each occurrence, by start."""
        number, shift, skip, down = self.words.get, self.shift, self.skip, 64 - self.bits
        at, end = self.length - 1, len(words)  # the last word of a window
        first_mix, second_mix = _MIX
        pairs = self.block == 2
        while at < end:
            last = number(words[at])
            if last is None:
                at += self.length  # no window has this word
                continue
            if pairs:
                before = number(words[at - 1])
                if before is None:
                    at += skip
                    continue
                place = ((before + 1) * first_mix + (last + 1) * second_mix & _MASK) >> down
            else:
                place = ((last + 1) * first_mix & _MASK) >> down
            step = shift[place]
            if step:
                at += step
                continue
            start = at - self.length + 1
            own = [number(w, -1) for w in words[start : at + 1]]
            for window in self.by_suffix[self.buckets[place] : self.buckets[place + 1]].tolist():
                begin = self.starts[window]
                if self.text[begin] == own[0] and self.text[begin : begin + self.length].tolist() == own:
                    yield start, self.items[self.ends[window] : self.ends[window + 1]]
            at += 1


@dataclass
class Index:
    """The searches of a block of items, one for each length of window, and the items' ids."""

    searches: list[WuManber]
    names: list[str | None]

    @property
    def nbytes(self) -> int:
        """Of the arrays; the dictionary of words comes on top."""
        return sum(one.nbytes for one in self.searches) + (self.searches[0].text.nbytes if self.searches else 0)


def index_of(items: Iterable[tuple[str | None, str | None]], window: int) -> Index:
    """Index (id, text) items; made once, on the driver, item by item."""
    words: dict[bytes, int] = {}
    numbers: dict[str | None, int] = {}
    text, by_length = array("i"), {}
    for item_id, item in items:
        own = [words.setdefault(w, len(words)) for w in words_of(item)]
        length = min(window, len(own))
        if length:
            starts, owners = by_length.setdefault(length, (array("i"), array("i")))
            starts.extend(range(len(text), len(text) + len(own) - length + 1))
            owners.extend([numbers.setdefault(item_id, len(numbers))] * (len(own) - length + 1))
            text.extend(own)
    whole = np.array(text, np.int32)
    searches = [
        WuManber(words, whole, np.array(starts, np.int64), np.array(owners, np.int64), length)
        for length, (starts, owners) in sorted(by_length.items())
    ]
    return Index(searches, list(numbers))


def _search_all(index: Index, words: list[bytes], spans: list[int]) -> tuple[list[int], set[str]]:
    """Hit words as starts and ends of spans that do not touch, with the given ones; and the items."""
    pairs = list(zip(spans[::2], spans[1::2]))
    items: set[str] = set()
    for one in index.searches:
        for start, ids in one.search(words):
            pairs.append((start, start + one.length))
            items.update(index.names[i] for i in ids.tolist())
    items.discard(None)
    merged: list[int] = []
    for start, end in sorted(pairs):
        if merged and start <= merged[-1]:
            merged[-1] = max(merged[-1], end)
        else:
            merged += [start, end]
    return merged, items


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The benchmark on the driver, one block of about ``block_bytes`` at a time."""
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).distinct()
    size = items.agg(F.sum(F.octet_length("t") + 20)).first()[0] or 0
    count = -(-size // block_bytes)
    for block in range(count):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == block) if count > 1 else items
        yield [tuple(row) for row in part.collect()]


def decontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add to each document how much of it stands in benchmark items.

    Added, or replaced where there are such columns: ``n_words``, ``n_hit``
    (words inside any occurrence of a window), ``n_items``, ``item_ids`` (sorted
    strings), ``contaminated``.  A window is ``window`` consecutive words of an
    item, or all words of an item with fewer; an item without words has none.
    Null and empty texts have no words and no hits.  Items that share an id
    count once, copies of an item count each by its id, and an item with a null
    id marks words but is not counted or listed.

    The benchmark is the query set: it goes to the workers in blocks of bounded
    size, each as an index of arrays that takes about ten times the block's text.  A benchmark of several blocks takes one pass over the documents for
    each, with hits so far written between them.
    """
    spark = docs.sparkSession
    got = docs.withColumn("_hits", F.lit(None).cast("struct<n:bigint,spans:array<int>,items:array<string>>"))
    passes = 0
    for block in _blocks(benchmark, item_id, item_text, block_bytes):
        if passes:
            got = settle(got)
        passes += 1
        got = got.withColumn("_hits", _hits(spark, block, window)(F.col(text), F.col("_hits")))
    if not passes:
        got = got.withColumn("_hits", _hits(spark, [], window)(F.col(text), F.col("_hits")))
    spans = F.col("_hits.spans")
    # Ends less starts: every second element counts negatively.
    hit = F.aggregate(
        F.transform(spans, lambda place, i: F.when(i % 2 == 1, place).otherwise(-place).cast("bigint")),
        F.lit(0).cast("bigint"),
        lambda total, place: total + place,
    )
    return got.withColumns(
        {
            "n_words": F.col("_hits.n"),
            "n_hit": hit,
            "n_items": F.size("_hits.items").cast("bigint"),
            "item_ids": F.col("_hits.items"),
            "contaminated": F.size(spans) > 0,
        }
    ).drop("_hits")


def _hits(spark, block: list[tuple], window: int):
    # A worker reads it once and keeps it for all its tasks.
    index = spark.sparkContext.broadcast(index_of(block, window))

    @F.arrow_udf("struct<n: bigint, spans: array<int>, items: array<string>>")
    def hits(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        found = index.value
        for texts, before in batches:
            counts, spans, names = [], [], []
            for doc, known in zip(texts, before):
                words = words_of(doc.as_py())
                old = known.as_py() or {"spans": [], "items": []}
                own, ids = _search_all(found, words, old["spans"])
                counts.append(len(words))
                spans.append(own)
                names.append(sorted(ids.union(old["items"])))
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))],
                ["n", "spans", "items"],
            )
        release_memory()

    return hits
