"""Token counts of whole texts with a public tokenizer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bootloom.llm.common import cut_at_space

#: Bytes of text in one call of the library, and of what one long text is cut into.
BATCH_BYTES = 1 << 19
#: Distinct words whose lengths a worker remembers before it starts anew.
REMEMBERED = 1 << 20


def batches(pieces: list[bytes], limit: int) -> Iterator[list[str]]:
    """``pieces`` decoded, in lists of about equal bytes, so that no call of the library gets much more than another."""
    batch, size = [], 0
    for piece in pieces:
        batch.append(piece.decode())
        size += len(piece)
        if size >= limit:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


@lru_cache(maxsize=2)
def _json_lengths(model: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(model)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    normal = tokenizer.normalizer.normalize_str("a \n b") if tokenizer.normalizer else "a \n b"
    parts = tokenizer.pre_tokenizer.pre_tokenize_str(normal) if tokenizer.pre_tokenizer else [normal]
    drops_space = len(parts) == 2 and not any(" " in p or "Ġ" in p for p, _ in parts)
    return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], drops_space


@lru_cache(maxsize=2)
def _piece_lengths(model: bytes) -> Callable[[list[str]], list[int]]:
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    return lambda texts: [len(e) for e in processor.encode(texts, num_threads=1)]


class WordLengths:
    """Counts for tokenizers that drop white space: the count of a text is the sum of its words' counts.

    White space is then a safe boundary everywhere.  Each distinct word is encoded
    once and remembered; a text of any length is worked off in parts.
    """

    def __init__(self, lengths: Callable[[list[str]], list[int]], batch_bytes: int, remembered: int):
        self.lengths, self.batch_bytes, self.remembered = lengths, batch_bytes, remembered
        self.known: dict[bytes, int] = {}

    def __call__(self, texts: list[bytes]) -> list[int]:
        totals = [0] * len(texts)
        waiting: list[tuple[int, list[bytes]]] = []
        size = 0
        for row, text in enumerate(texts):
            for part in cut_at_space(text, self.batch_bytes):
                waiting.append((row, part.split()))
                size += len(part)
                if size >= self.batch_bytes:
                    self._settle(waiting, totals)
                    waiting, size = [], 0
        self._settle(waiting, totals)
        return totals

    def _settle(self, waiting: list[tuple[int, list[bytes]]], totals: list[int]) -> None:
        if len(self.known) > self.remembered:
            self.known.clear()
        new = [w for w in set().union(*(words for _, words in waiting)) if w not in self.known]
        done = 0
        for batch in batches(new, self.batch_bytes):
            self.known.update(zip(new[done : done + len(batch)], self.lengths(batch)))
            done += len(batch)
        for row, words in waiting:
            totals[row] += sum(map(self.known.__getitem__, words))


class TextLengths:
    """Counts for tokenizers that keep white space.

    A text is cut only where one space stands between an ASCII letter or digit and
    another: there no token reaches across.  ``keeps_space`` says whether the
    space belongs to the right part or, with a prefix that the library adds to
    each text, stands for it.
    """

    def __init__(self, lengths: Callable[[list[str]], list[int]], batch_bytes: int, keeps_space: bool):
        self.lengths, self.batch_bytes, self.keeps_space = lengths, batch_bytes, keeps_space

    def _parts(self, text: bytes) -> Iterator[bytes]:
        start = 0
        while len(text) - start > self.batch_bytes:
            at = start + self.batch_bytes
            while (at := text.find(b" ", at)) > 0 and not (text[at - 1 : at] + text[at + 1 : at + 2]).isalnum():
                at += 1
            if at < 0 or at + 1 >= len(text):
                break
            yield text[start:at]
            start = at if self.keeps_space else at + 1
        yield text[start:]

    def __call__(self, texts: list[bytes]) -> list[int]:
        totals = [0] * len(texts)
        rows, parts = [], []
        for row, text in enumerate(texts):
            for part in self._parts(text):
                rows.append(row)
                parts.append(part)
        done = 0
        for batch in batches(parts, self.batch_bytes):
            for row, n in zip(rows[done : done + len(batch)], self.lengths(batch)):
                totals[row] += n
            done += len(batch)
        return totals


def counter(kind: str, model: str | bytes, batch_bytes: int = BATCH_BYTES, remembered: int = REMEMBERED):
    """A function from texts to counts for a tokenizer file of that kind (``json`` or ``model``)."""
    if kind == "json":
        lengths, drops_space = _json_lengths(model)
        return (
            WordLengths(lengths, batch_bytes, remembered) if drops_space else TextLengths(lengths, batch_bytes, True)
        )
    return TextLengths(_piece_lengths(model), batch_bytes, False)


_counters: dict[int, Callable[[list[bytes]], list[int]]] = {}


def _counter_of(kind: str, model: Broadcast, batch_bytes: int) -> Callable[[list[bytes]], list[int]]:
    """One counter for all tasks of a Python worker, so that it remembers words from task to task."""
    key = hash((kind, model.value, batch_bytes))
    if key not in _counters:
        _counters.clear()
        _counters[key] = counter(kind, model.value, batch_bytes)
    return _counters[key]


def token_count(docs: DataFrame, path: str, text: str = "text", batch_bytes: int = BATCH_BYTES) -> Column:
    """The number of tokens of each text, as the library of the tokenizer file gives it.

    Arrow batches go in and lengths come out; token ids never leave the worker.
    No begin, end or added special token counts; special strings inside a text
    are what the library makes of them by default.  Null and empty texts have 0
    tokens.  A word or text without a safe boundary is encoded whole.  The file
    is read on the driver and sent to the workers (a vocabulary, a few MB).
    """
    kind = "model" if path.endswith(".model") else "json"
    with open(path, "rb") as file:
        content = file.read()
    model = docs.sparkSession.sparkContext.broadcast(content if kind == "model" else content.decode())

    @F.arrow_udf("bigint")
    def lengths(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = _counter_of(kind, model, batch_bytes)
        for batch in texts:
            rows = batch.cast(pa.binary()).to_pylist()
            yield pa.array(count([row or b"" for row in rows]), pa.int64())

    return lengths(F.col(text))


def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit``; columns of these names are replaced, all others stay."""
    return docs.withColumns(
        {
            "n_bytes": F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint"),
            "n_tokens": token_count(docs, path, text),
        }
    ).withColumn("over_limit", F.col("n_tokens") > limit)
