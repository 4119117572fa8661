"""Repeated passages, as runs of sentences that occur before."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bootloom.llm.common import release_memory, with_key
from bootloom.operators.lineage import settle

#: Sentences and words that a run has at least.
SENTENCES, WORDS = 3, 16
#: A sentence of more words is cut, at one word at least of each so many in a row.
LONG, WINDOW = 24, 8
_NEVER = np.iinfo(np.int64).max
_SENTENCE = re.compile(rb"[^.!?\n]+(?:[.!?\n][.!? \t\n\r]*)?|[.!?\n][.!? \t\n\r]*")
_WORD = re.compile(rb"[^ \t-\r]+[ \t-\r]*|[ \t-\r]+")


def cuts(words: list[bytes], lengths: list[int]) -> list[list[int]]:
    """After how many words each of several long sentences is cut: of each ``WINDOW`` words, after the last with the least hash.

    ``words`` are those of all sentences, ``lengths`` their numbers.  A cut
    depends on the ``WINDOW`` words on both sides of it and on nothing else, so
    cuts fall in step inside equal passages whatever stands before them.  A word
    that repeats the one before has no hash; where no word of a window has one,
    cuts are counted from the last.
    """
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(w) for w in words], np.uint64)
    values = (hashes >> np.uint64(2)).astype(np.int64)
    ends = np.cumsum(lengths)
    repeats = np.flatnonzero(hashes[1:] == hashes[:-1]) + 1
    values[repeats[~np.isin(repeats, ends)]] = _NEVER
    windows = np.lib.stride_tricks.sliding_window_view(values, WINDOW)[:, ::-1]
    best = windows.argmin(axis=1)
    at = np.arange(len(windows))
    owner = np.searchsorted(ends, at, side="right")
    inside = (at + WINDOW <= ends[owner]) & (windows[at, best] < _NEVER)
    found = np.unique((at + WINDOW - best)[inside])
    # A cut after a sentence's last word is that sentence's.
    upto = np.searchsorted(found, ends, side="right").tolist()
    starts, found = (ends - lengths).tolist(), found.tolist()
    out, first = [], 0
    for start, length, stop in zip(starts, lengths, upto):
        own, last = [], 0
        for cut in [*[c - start for c in found[first:stop]], length]:
            if cut > last:
                own.extend(range(last + WINDOW, cut, WINDOW))
                own.append(cut)
                last = cut
        out.append(own)
        first = stop
    return out


def sentences(text: bytes) -> list[tuple[bytes, int]]:
    """The parts of a text, whose concatenation is the text, each with its number of words.

    A sentence ends after ``.``, ``!``, ``?`` or a line end and what follows of
    these and white space.  One of more than 24 words is cut by its content (see
    ``cuts``) into parts of at most 8.
    """
    found = _SENTENCE.findall(text)
    split = [s.split() for s in found]
    sizes = [len(w) for w in split]
    long = [k for k, n in enumerate(sizes) if n > LONG]
    if not long:
        return list(zip(found, sizes))
    out, done = [], 0
    lengths = [sizes[k] for k in long]
    for k, places in zip(long, cuts([w.lower() for i in long for w in split[i]], lengths)):
        out += zip(found[done:k], sizes[done:k])
        words = _WORD.findall(found[k])
        if words[0].isspace():
            words[:2] = [words[0] + words[1]]
        last = 0
        for cut in places:
            out.append((b"".join(words[last:cut]), cut - last))
            last = cut
        done = k + 1
    return [*out, *zip(found[done:], sizes[done:])]


def _runs(text: bytes | None, least: int, words: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The number of sentences, and of each run its first sentence, the one after its last, and its hash."""
    parts = sentences(text.lower()) if text else []
    none = np.zeros(0, np.int64)
    if len(parts) < least:
        return len(parts), none, none, none
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s.strip()) for s, _ in parts], "<u8").tobytes()
    total = np.concatenate([[0], np.cumsum([n for _, n in parts])])
    first = np.arange(len(parts))
    # The least end with enough words from each start, and the largest start with enough words to each end.
    ends = np.maximum(np.searchsorted(total, total[:-1] + words), first + least)
    starts = np.minimum(np.searchsorted(total, total[1:] - words, side="right") - 1, first + 1 - least)
    forward, back = ends <= len(parts), starts >= 0
    both = [first[forward] << 32 | ends[forward], starts[back] << 32 | first[back] + 1]
    found = np.unique(np.concatenate(both))
    first, after = found >> 32, found & 0xFFFFFFFF
    got = [digest(hashes[8 * a : 8 * b]) for a, b in zip(first.tolist(), after.tolist())]
    return len(parts), first, after, (np.array(got, np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def runs(text: bytes | None, least: int = SENTENCES, words: int = WORDS) -> list[tuple[int, int, int]]:
    """(first sentence, number of sentences, hash) of each run of a text.

    From each sentence on, and up to each sentence, the shortest run of at least
    ``least`` sentences and ``words`` words; shorter texts have none.  Sentences
    are compared in lower case (A-Z) and without the white space around them.
    """
    _, first, after, got = _runs(text, least, words)
    return list(zip(first.tolist(), (after - first).tolist(), got.tolist()))


def without(text: bytes | None, ranges: list[tuple[int, int]]) -> tuple[bytes | None, int]:
    """``text`` without the sentences of these (first, number) ranges, and how many went."""
    if not text:
        return text, 0
    parts = [s for s, _ in sentences(text)]
    gone = np.zeros(len(parts), bool)
    for first, n in ranges:
        gone[first : first + n] = True
    kept = b"".join(s for s, g in zip(parts, gone) if not g) if gone.any() else text
    return kept, int(gone.sum())


def _all_runs(docs: DataFrame, text: str, least: int, words: int) -> DataFrame:
    """A row for each run, and one for each document: its number of sentences as ``n``, and no run."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary())
            for at in range(0, batch.num_rows, 256):
                each = [_runs(t, least, words) for t in texts[at : at + 256].to_pylist()]
                own = np.arange(at, at + len(each))
                owner = pa.array(np.concatenate([own, np.repeat(own, [len(r[1]) for r in each])]))
                first = np.concatenate([np.zeros(len(each), np.int64), *[r[1] for r in each]])
                n = np.concatenate([[r[0] for r in each], *[r[2] - r[1] for r in each]])
                run = np.concatenate([np.zeros(len(each), np.int64), *[r[3] for r in each]])
                columns = [batch.column(i).take(owner) for i in range(batch.num_columns - 1)]
                columns += [pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))]
                columns.append(pa.array(run, mask=np.arange(len(run)) < len(each)))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "_kt", "at", "n", "run"])
        release_memory()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "_kt", text).mapInArrow(rows, f"doc_id {kind}, _kt long, at int, n int, run long")


def repeated_spans(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", least: int = SENTENCES, words: int = WORDS
) -> DataFrame:
    """(``_kd``, ``_kt``, ``_n``, ``_ranges``): each document's number of sentences, and where its repeated runs stand.

    The ranges are null for a document without any run that stands elsewhere
    before.  The first of equal runs is the one in the document with the smallest
    id (none comes last; then by the text's hash), and there the one nearest to
    the start.  Runs are compared by 64-bit hashes.  The count and first place of
    each run are combined before they are shuffled, so a passage in any share of
    all documents makes one row for each task; what is joined back is split by
    adaptive execution where one run has many rows.
    """
    keyed = with_key(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "_text")
    table = settle(_all_runs(keyed, "_text", least, words))
    found, sizes = table.where("run is not null"), table.where("run is null")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_kt", "at")
    repeated = found.groupBy("run").agg(F.count("*").alias("times"), F.min(place).alias("first")).where("times > 1")
    first = repeated.select("run", *[F.col(f"first.{c}").alias(f"_first_{c}") for c in ("doc_id", "_kt", "at")])
    # Written, so that both sides of the join are plain shuffles and a run with very many rows can be split.
    later = found.join(settle(first), "run").where("not (doc_id <=> _first_doc_id) or _kt <> _first__kt or at <> _first_at")
    marks = later.select("doc_id", "_kt", F.struct("at", "n").alias("_range"), F.lit(None).cast("int").alias("_n"))
    marks = marks.unionByName(sizes.select("doc_id", "_kt", F.col("n").alias("_n")), allowMissingColumns=True)
    ranges = F.collect_set("_range")
    return marks.groupBy("doc_id", "_kt").agg(
        F.max("_n").alias("_n"), F.when(F.size(ranges) > 0, ranges).alias("_ranges")
    ).select(F.coalesce(F.xxhash64("doc_id"), F.lit(0)).alias("_kd"), "_kt", "_n", "_ranges")


def without_repeats(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", least: int = SENTENCES, words: int = WORDS
) -> DataFrame:
    """Take every sentence out of ``text`` that lies in a repeated run other than its first occurrence.

    Adds ``n_sentences`` and ``n_removed``; columns of these names are replaced,
    all others stay.  All else of a text stays as it is; a document whose every
    sentence is removed keeps its row with an empty text; null stays null.  Rows
    equal in id and text are one document and lose nothing to each other.  Only
    texts with repeated runs are split again.
    """
    keyed = with_key(docs, text, doc_id)
    marks = repeated_spans(docs, text=text, doc_id=doc_id, least=least, words=words)

    @F.arrow_udf("struct<text: string, gone: bigint>")
    def cut(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, marked in batches:
            rows = zip(texts.cast(pa.binary()).to_pylist(), marked.to_pylist())
            got = [without(t, [(r["at"], r["n"]) for r in m or []]) for t, m in rows]
            yield pa.StructArray.from_arrays(
                [pa.array([g[0] for g in got], pa.binary()).cast(pa.string()), pa.array([g[1] for g in got], pa.int64())],
                ["text", "gone"],
            )
        release_memory()

    repeated = F.col("_ranges").isNotNull()
    got = keyed.join(marks, ["_kd", "_kt"], "left").withColumn("_cut", cut(F.when(repeated, F.col(text)), F.col("_ranges")))
    named = {
        text: F.when(repeated, F.col("_cut.text")).otherwise(F.col(text)),
        "n_sentences": F.col("_n").cast("bigint"),
        "n_removed": F.col("_cut.gone"),
    }
    return got.withColumns(named).drop("_cut", "_kd", "_kt", "_n", "_ranges")
