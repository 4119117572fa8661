"""Alignment of two tokenizers over a corpus, by inverted bitmaps of token pairs.

Both tokenizers cut the same bytes.  Where a token of each ends at the same
byte, a *group* ends; every token of the one and every token of the other in a
group are a *link*.  A pair of ids is worth as much as the number of documents
that hold it linked, which only the whole corpus tells.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bootloom.llm.bpe import _BYTE_CHARS
from bootloom.llm.common import release_memory
from bootloom.operators.lineage import settle

#: Bytes of text that are worked off together; a longer text is cut where no token can reach across.
CALL_BYTES = 1 << 21
#: Bytes of distinct units that are encoded as one text, and of what a task remembers of units, about.
JOINED_BYTES = 1 << 12
REMEMBERED = 96 << 20
#: A block of documents ends after so many documents or entries (pair and document).
BLOCK_DOCS, BLOCK_ENTRIES = 1 << 13, 4_000_000
#: Bits of a document's place in its block and of an id of the second tokenizer in an entry's key.
SLOT_BITS, ID_BITS = 16, 23
#: Links that a group may have to be worked off together with others.
SMALL = 256
# A space before anything but white space, after anything but a space: both tokenizers begin a token there.
_START = rb"[!-~\xc3-\xdf\xe4-\xff]"
_SAFE = re.compile(_START)
_BOUNDARY = re.compile(rb"[^ ](?= " + _START + rb")")
_UNIT = re.compile(rb"(?<=[^ ])(?= " + _START + rb")")
_ODD_SPACE = re.compile(rb" (?!" + _START + rb")")


def parts(data: bytes, limit: int) -> Iterator[bytes]:
    """``data``, which begins with a space, in parts of about ``limit`` bytes that all begin with a space."""
    start = 0
    while len(data) - start > limit:
        found = _BOUNDARY.search(data, start + limit)
        if not found:
            break
        yield data[start : found.end()]
        start = found.end()
    yield data[start:]


def _byte_level(model: str) -> dict[int, bytes]:
    """Bytes of each id of a byte-level vocabulary file; added tokens are what they say."""
    config = json.loads(model)
    byte_of = {chr(c): b for b, c in _BYTE_CHARS.items()}
    byte_of |= {chr(b): b for b in range(256) if b not in _BYTE_CHARS}
    added = {t["id"]: t["content"].encode() for t in config["added_tokens"]}
    return {i: bytes(map(byte_of.__getitem__, t)) for t, i in config["model"]["vocab"].items() if i not in added} | added


class Pair:
    """The two tokenizers, and the bytes of their tokens."""

    def __init__(self, byte_level: str, pieces: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker's task has one core
        self.first = Tokenizer.from_str(byte_level)
        self.first.no_padding()
        self.first.no_truncation()
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.a_bytes, self.b_bytes = _byte_level(byte_level), {}
        for i in range(self.second.get_piece_size()):
            piece = self.second.id_to_piece(i)
            self.b_bytes[i] = bytes([int(piece[3:5], 16)]) if self.second.is_byte(i) else piece.replace("▁", " ").encode()
        if max(self.b_bytes) >> ID_BITS or max(self.a_bytes) >> 62 - ID_BITS - SLOT_BITS:
            raise ValueError("a vocabulary is too large for the keys of its pairs")
        self.sizes = [
            np.array([len(known.get(i, b"")) for i in range(max(known) + 1)], np.int64)
            for known in (self.a_bytes, self.b_bytes)
        ]

    def encode(self, texts: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that begin with a space, which the second tokenizer adds itself."""
        words = [t.decode() for t in texts]
        first = [e.ids for e in self.first.encode_batch_fast(words, add_special_tokens=False)]
        return first, self.second.encode([w[1:] for w in words], num_threads=1)


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The digits of 0 to n - 1, left in rows with room for a sign after them, and their numbers."""
    width = len(str(n))
    digits = np.array([f"{i:<{width + 1}}" for i in range(n)], f"S{width + 1}")
    rows = digits.view(np.uint8).reshape(n, width + 1)
    return rows, np.char.str_len(np.char.rstrip(digits)).astype(np.int64)


@dataclass
class Block:
    """Documents side by side, and what has been found of them so far."""

    n_a: list[int] = field(default_factory=list)
    n_b: list[int] = field(default_factory=list)
    n_groups: list[int] = field(default_factory=list)
    valid: list[bool] = field(default_factory=list)
    digests: list = field(default_factory=list)
    texts: list[list[bytes]] = field(default_factory=list)
    keys: list[np.ndarray] = field(default_factory=list)
    times: list[np.ndarray] = field(default_factory=list)
    entries: int = 0

    def open(self) -> int:
        for counts in (self.n_a, self.n_b, self.n_groups):
            counts.append(0)
        self.valid.append(True)
        self.digests.append(None)
        self.texts.append([])
        return len(self.valid) - 1


@dataclass
class Units:
    """Distinct stretches of text that both tokenizers cut alike wherever they stand, and what is known of each."""

    valid: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    texts: list[bytes]  # the groups
    pairs: np.ndarray  # linked pairs of ids, those of a unit side by side
    times: np.ndarray
    starts: np.ndarray  # the first pair of each unit, and the end

    def __add__(self, more: Units) -> Units:
        joined = {
            c: np.concatenate([getattr(self, c), getattr(more, c)]) for c in ("valid", "n_a", "n_b", "n_groups", "pairs", "times")
        }
        starts = np.concatenate([self.starts, more.starts[1:] + self.starts[-1]])
        return Units(**joined, texts=self.texts + more.texts, starts=starts)


def units_of(part: bytes) -> list[bytes]:
    """A part that begins with a space, cut before each space at which both tokenizers begin a token; without that space."""
    if _ODD_SPACE.search(part):
        return [unit[1:] for unit in _UNIT.split(part)]
    return part[1:].split(b" ")


class Aligner:
    """Aligns texts and gathers the entries (pair, document, number of links) of a block."""

    def __init__(self, pair: Pair, keep_groups: bool):
        self.pair, self.keep_groups = pair, keep_groups
        self.digits = _decimals(max(len(s) for s in pair.sizes))
        self.rest()

    def rest(self) -> None:
        """Forget the units: between tasks, and when there are too many."""
        self.number: dict[bytes, int] = {}
        self.known: Units | None = None
        self.held = 0

    def add(self, block: Block, texts: list[tuple[int, bytes]]) -> None:
        """Parts of texts by slot; parts of one text follow each other.  A unit that is remembered is not encoded again."""
        if self.held > REMEMBERED:
            self.rest()
        split = [units_of(text) for _, text in texts]
        new = [u for u in dict.fromkeys(chain.from_iterable(split)) if u not in self.number]
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            learned = self._learn(new)
            self.known = learned if self.known is None else self.known + learned
            self.held += sum(map(len, new)) + sum(map(len, learned.texts)) + 16 * len(learned.pairs) + 250 * len(new)
        lengths, known = [len(words) for words in split], self.known
        unit = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, sum(lengths))
        at = 0
        whole = known.valid.all()
        texts_of = known.texts.__getitem__
        for (slot, _), n in zip(texts, lengths):
            own = unit[at : at + n]
            at += n
            if not whole and not known.valid[own].all():
                block.valid[slot] = False
                continue
            block.n_a[slot] += int(known.n_a[own].sum())
            block.n_b[slot] += int(known.n_b[own].sum())
            block.n_groups[slot] += int(known.n_groups[own].sum())
            text = b";".join(map(texts_of, own.tolist()))
            if block.digests[slot] is None:
                block.digests[slot] = hashlib.sha256(text)
            else:
                text = b";" + text
                block.digests[slot].update(text)
            if self.keep_groups:
                block.texts[slot].append(text)
        # Each distinct unit of a document stands for its pairs, as often as it is there.
        slots = np.repeat(np.array([slot for slot, _ in texts], np.int64), lengths)
        both, often = np.unique(unit << SLOT_BITS | slots, return_counts=True)
        unit, slots = both >> SLOT_BITS, both & ((1 << SLOT_BITS) - 1)
        n = known.starts[unit + 1] - known.starts[unit]
        where = np.repeat(known.starts[unit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        keys = known.pairs[where] << SLOT_BITS | np.repeat(slots, n)
        times = known.times[where] * np.repeat(often, n)
        order = np.argsort(keys)
        keys, times = keys[order], times[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        block.keys.append(keys[first])
        block.times.append(np.add.reduceat(times, first) if len(first) else times)
        block.entries += len(first)

    def _learn(self, distinct: list[bytes]) -> Units:
        """Encode and align units, many of them as one text; those whose ends are not safe stand alone."""
        chunks: list[list[int]] = []
        size = JOINED_BYTES
        alone = []
        for k, unit in enumerate(distinct):
            if not _SAFE.match(unit) or unit.endswith(b" "):
                alone.append([k])
                continue
            if size >= JOINED_BYTES:
                chunks.append([])
                size = 0
            chunks[-1].append(k)
            size += len(unit) + 1
        valid = np.ones(len(distinct), bool)
        todo, done = chunks + alone, []
        while todo:
            texts = [b" " + b" ".join([distinct[k] for k in chunk]) for chunk in todo]
            first, second = self.pair.encode(texts)
            again = []
            for chunk, text, a, b in zip(todo, texts, first, second):
                same = b"".join(map(self.pair.a_bytes.__getitem__, a)) == text
                if same and b"".join(map(self.pair.b_bytes.__getitem__, b)) == text:
                    done.append((chunk, a, b))
                elif len(chunk) > 1:
                    again += [[k] for k in chunk]
                else:
                    valid[chunk[0]] = False
            todo = again
        order = np.array([k for chunk, _, _ in done for k in chunk], np.int64)
        ends = np.cumsum([len(distinct[k]) + 1 for k in order.tolist()])
        a, b = (
            np.fromiter(chain.from_iterable([d[side] for d in done]), np.int64, sum(len(d[side]) for d in done))
            for side in (1, 2)
        )
        return self._align(valid, order, ends, a, b)

    def _align(self, valid: np.ndarray, order: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> Units:
        """Units in this order, by the ids of their texts one after another; ``ends`` are those of units."""
        a_end, b_end = np.cumsum(self.pair.sizes[0][a]), np.cumsum(self.pair.sizes[1][b])
        a_last, b_last = np.isin(a_end, b_end), np.isin(b_end, a_end)
        # A token's group: the groups that have ended before it.
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        n = int(a_last.sum())
        n_a, n_b = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
        unit = np.searchsorted(ends, a_end[a_last])  # of each group, by place in the order
        if not np.isin(ends, a_end[a_last]).all():
            raise ValueError("a token reaches across the end of a unit")
        total = len(valid)
        sums = []
        for each in (n_a, n_b, np.ones(n, np.int64)):
            of_unit = np.zeros(total, np.int64)
            np.add.at(of_unit, order[unit], each)
            sums.append(of_unit)
        texts = [b""] * total
        for k, text in zip(order.tolist(), self._texts(unit, len(order), (a, a_group, a_last, n_a), (b, b_group, b_last, n_b))):
            texts[k] = text
        keys, times = self._links(order[unit] if n else unit, (a, a_group, n_a), (b, b_group, n_b))
        starts = np.searchsorted(keys[:, 0], np.arange(total + 1)) if len(keys) else np.zeros(total + 1, np.int64)
        return Units(valid, *sums, texts, keys[:, 1] if len(keys) else np.zeros(0, np.int64), times, starts)

    def _texts(self, unit: np.ndarray, n_units: int, first: tuple, second: tuple) -> list[bytes]:
        """The groups of each unit as text: ids of the one, a bar, ids of the other, a semicolon between groups."""
        (a, a_group, a_last, n_a), (b, b_group, b_last, n_b) = first, second
        ids, signs = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        a_at = np.arange(len(a)) + (np.cumsum(n_b) - n_b)[a_group]
        b_at = np.arange(len(b)) + np.cumsum(n_a)[b_group]
        ids[a_at], ids[b_at] = a, b
        signs[a_at[a_last]], signs[b_at[b_last]] = ord("|"), ord(";")
        rows, lengths = self.digits[0][ids], self.digits[1][ids]
        rows[np.arange(len(ids)), lengths] = signs
        flat = rows[np.arange(rows.shape[1]) <= lengths[:, None]].tobytes()
        tokens = np.bincount(unit, n_a + n_b, n_units).astype(np.int64)
        stops = np.append(0, np.cumsum(lengths + 1))[np.cumsum(tokens)].tolist()
        return [flat[start : stop - 1] for start, stop in zip([0, *stops], stops)]

    @staticmethod
    def _links(unit: np.ndarray, first: tuple, second: tuple) -> tuple[np.ndarray, np.ndarray]:
        """(unit, pair) of the linked pairs, sorted, with how often each is linked; ``unit`` is that of each group."""
        (a, a_group, n_a), (b, b_group, n_b) = first, second
        a_start, b_start = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        small = n_a * n_b <= SMALL
        times = np.where(small, n_b, 0)[a_group]
        group = np.repeat(a_group, times)
        within = np.arange(len(group)) - np.repeat(np.cumsum(times) - times, times)
        units = [unit[group]]
        pairs = [np.repeat(a, times) << ID_BITS | b[b_start[group] + within]]
        often = [np.ones(len(group), np.int64)]
        for g in np.flatnonzero(~small).tolist():
            # Of a large group, distinct ids only.
            ids_a, of_a = np.unique(a[a_start[g] : a_start[g] + n_a[g]], return_counts=True)
            ids_b, of_b = np.unique(b[b_start[g] : b_start[g] + n_b[g]], return_counts=True)
            pairs.append((ids_a[:, None] << ID_BITS | ids_b[None, :]).ravel())
            often.append((of_a[:, None] * of_b[None, :]).ravel())
            units.append(np.full(len(pairs[-1]), unit[g]))
        units, pairs, often = np.concatenate(units), np.concatenate(pairs), np.concatenate(often)
        order = np.lexsort((pairs, units))
        units, pairs, often = units[order], pairs[order], often[order]
        new = np.ones(len(units), bool)
        new[1:] = (units[1:] != units[:-1]) | (pairs[1:] != pairs[:-1])
        starts = np.flatnonzero(new)
        return np.stack([units[starts], pairs[starts]], axis=1), np.add.reduceat(often, starts) if len(starts) else often


def bitmaps(keys: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(pair, number of documents, documents) of sorted keys.

    The documents of a pair are the sorted list of their places, two bytes each,
    or one bit for each document of the block where that is shorter.
    """
    pairs, starts, counts = np.unique(keys >> SLOT_BITS, return_index=True, return_counts=True)
    slots = (keys & ((1 << SLOT_BITS) - 1)).astype("<u2")
    width = -(-n_docs // 8)
    dense = 2 * counts > width
    data = [slots[~np.repeat(dense, counts)].view(np.uint8)]
    for k in np.flatnonzero(dense).tolist():
        bits = np.zeros(n_docs, bool)
        bits[slots[starts[k] : starts[k] + counts[k]]] = True
        data.append(np.packbits(bits, bitorder="little"))
    order = np.concatenate([np.flatnonzero(~dense), np.flatnonzero(dense)])
    pairs, counts = pairs[order], counts[order]
    offsets = np.concatenate([[0], np.cumsum(np.minimum(2 * counts, width))]).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(data))]
    return pairs, counts, pa.Array.from_buffers(pa.binary(), len(pairs), buffers)


def places_of(packed: pa.ChunkedArray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of each document of each row that :func:`bitmaps` has made."""
    rows = packed.to_pylist()
    listed = np.array([len(x) for x in rows], np.int64) == 2 * counts
    places = [np.frombuffer(b"".join([x for x, y in zip(rows, listed) if y]), "<u2").astype(np.int64)]
    owners = [np.repeat(np.flatnonzero(listed), counts[listed])]
    for k in np.flatnonzero(~listed).tolist():
        places.append(np.flatnonzero(np.unpackbits(np.frombuffer(rows[k], np.uint8), bitorder="little")))
        owners.append(np.full(len(places[-1]), k))
    return np.concatenate(owners), np.concatenate(places)


def _rows_of(block: Block, number: int, ids: pa.Array, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A block's documents, and its pairs plane by plane."""
    n_docs = len(block.valid)
    valid = np.array(block.valid, bool)

    def rows(**columns) -> pa.RecordBatch:
        length = max(map(len, columns.values()))
        columns["block"] = pa.array(np.full(length, number, np.int64))
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(length, f.type)) for f in schema], schema=schema)

    def postings(keys: np.ndarray, plane: int) -> Iterator[pa.RecordBatch]:
        pairs, n, docs = bitmaps(keys, n_docs)
        for at in range(0, len(pairs), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield rows(
                plane=pa.array(np.full(len(pairs[part]), plane, np.int8)),
                a=pa.array((pairs[part] >> ID_BITS).astype(np.int32)),
                b=pa.array((pairs[part] & ((1 << ID_BITS) - 1)).astype(np.int32)),
                n=pa.array(n[part].astype(np.int32)),
                docs=docs[part],
            )

    found = np.array([d is not None for d in block.digests], bool) & valid
    counts = {c: pa.array(np.where(found, getattr(block, c), 0).astype(np.int64)) for c in ("n_a", "n_b", "n_groups")}
    digests = [d.hexdigest() if ok else "" for d, ok in zip(block.digests, found)]
    if "groups" in schema.names:
        counts["groups"] = pa.array([b"".join(t).decode() if ok else "" for t, ok in zip(block.texts, found)], pa.string())
    yield rows(slot=pa.array(np.arange(n_docs, dtype=np.int32)), doc_id=ids, groups_sha256=pa.array(digests), **counts)
    keys = np.concatenate([np.zeros(0, np.int64), *block.keys])
    times = np.concatenate([np.zeros(0, np.int64), *block.times])
    block.keys, block.times = [], []
    kept = valid[keys & ((1 << SLOT_BITS) - 1)]
    if not kept.all():
        keys, times = keys[kept], times[kept]
    order = np.argsort(keys)
    keys, times = keys[order], times[order]
    # Entries of one document that came from several calls are put together.
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    if len(starts) < len(keys):
        keys, times = keys[starts], np.add.reduceat(times, starts)
    yield from postings(keys, 0)
    more = times - 1
    for plane in range(1, 64):
        kept = more > 0
        keys, more = keys[kept], more[kept]
        if not len(keys):
            break
        odd = (more & 1).astype(bool)
        yield from postings(keys[odd], plane)
        more = more >> 1


_aligners: dict[tuple, Aligner] = {}


def _aligner_of(byte_level: str, pieces: bytes, keep_groups: bool) -> Aligner:
    """One for all tasks of a Python worker."""
    key = hash(byte_level), hash(pieces), keep_groups
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(Pair(byte_level, pieces), keep_groups)
    return _aligners[key]


def postings(
    docs: DataFrame,
    byte_level: str,
    pieces: str,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    groups: bool = False,
    call_bytes: int = CALL_BYTES,
    block_docs: int = BLOCK_DOCS,
    block_entries: int = BLOCK_ENTRIES,
) -> DataFrame:
    """A written table with two kinds of rows, from one pass over the texts.

    Documents (``plane`` null): ``block``, ``slot``, ``doc_id``, ``n_a``, ``n_b``,
    ``n_groups``, ``groups_sha256`` and, if asked for, ``groups``.  Postings:
    ``block``, the pair ``a`` and ``b``, and ``n`` documents of the block as a
    compressed bitmap ``docs``: in plane 0 those that hold the pair linked, in
    plane k those whose number of further links has bit k - 1.

    A block is up to ``block_docs`` documents that follow each other in a task.
    Bitmaps of calls are merged in it; blocks have no document in common, so
    beyond them merging is putting side by side, and popcounts add up.
    """
    if not 0 < block_docs <= 1 << SLOT_BITS:
        raise ValueError(f"block_docs is at most {1 << SLOT_BITS}")
    spark = docs.sparkSession
    with open(byte_level, encoding="utf-8") as file:
        first = spark.sparkContext.broadcast(file.read())
    with open(pieces, "rb") as file:
        second = spark.sparkContext.broadcast(file.read())
    kind = docs.schema[doc_id].dataType.simpleString()
    ddl = (
        "block long, slot int, plane tinyint, a int, b int, n int, docs binary, "
        f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string"
    ) + ", groups string" * groups

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner_of(first.value, second.value, groups)
        number = TaskContext.get().partitionId() << 32
        block, ids, waiting, size = Block(), [], [], 0
        schema = None

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal block, ids, number, waiting, size
            if waiting:
                aligner.add(block, waiting)
            if block.valid:
                yield from _rows_of(block, number, pa.concat_arrays(ids), schema)
                number += 1
            block, ids, waiting, size = Block(), [], [], 0

        for batch in batches:
            id_type = batch.schema.field(0).type
            schema = schema or pa.schema(
                [("block", pa.int64()), ("slot", pa.int32()), ("plane", pa.int8()), ("a", pa.int32()), ("b", pa.int32())]
                + [("n", pa.int32()), ("docs", pa.binary()), ("doc_id", id_type), ("n_a", pa.int64()), ("n_b", pa.int64())]
                + [("n_groups", pa.int64()), ("groups_sha256", pa.string())] + [("groups", pa.string())] * groups
            )
            taken = 0
            for row, value in enumerate(batch.column(1).cast(pa.binary())):
                slot = block.open()
                for part in parts(b" " + value.as_py(), call_bytes) if value.is_valid and len(value.as_py()) else ():
                    waiting.append((slot, part))
                    size += len(part)
                    if size >= call_bytes:
                        aligner.add(block, waiting)
                        waiting, size = [], 0
                if slot + 1 == block_docs or block.entries >= block_entries:
                    ids.append(batch.column(0).slice(taken, row + 1 - taken))
                    taken = row + 1
                    yield from close()
            if taken < batch.num_rows:
                ids.append(batch.column(0).slice(taken))
        yield from close()
        aligner.rest()
        release_memory()

    return settle(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(aligned, ddl))


def pair_counts(found: DataFrame) -> DataFrame:
    """Of each linked pair: ``documents`` that hold it, ``links`` by the planes, and whether it is the ``best`` of ``a``.

    The best of an id are the pairs with the most documents, ties included.  The
    table of these maxima has at most one row for each id of the first
    vocabulary, so it is broadcast.
    """
    weight = F.when(F.col("plane") == 0, F.lit(1).cast("bigint")).otherwise(F.expr("shiftleft(1L, plane - 1)"))
    counted = found.where("plane is not null").groupBy("a", "b").agg(
        F.sum(F.when(F.col("plane") == 0, F.col("n").cast("bigint"))).alias("documents"), F.sum(F.col("n") * weight).alias("links")
    )
    counted = settle(counted)
    most = counted.groupBy("a").agg(F.max("documents").alias("_most"))
    best = (F.col("documents") == F.col("_most")).alias("best")
    return counted.join(F.broadcast(most), "a").select("a", "b", "documents", "links", best)


def _score(rows: pa.Table) -> pa.Table:
    """One block: its postings return what their pairs are worth to its documents."""
    is_doc = rows.column("slot").is_valid()
    docs = rows.filter(is_doc).sort_by("slot")
    worth = rows.filter(rows.column("documents").is_valid())
    posted = rows.filter(rows.column("docs").is_valid())

    def keys(table: pa.Table) -> np.ndarray:
        return table.column("a").to_numpy().astype(np.int64) << ID_BITS | table.column("b").to_numpy().astype(np.int64)

    pairs, documents, best = keys(worth), worth.column("documents").to_numpy(), worth.column("best").to_numpy()
    order = np.argsort(pairs)
    at = order[np.searchsorted(pairs, keys(posted), sorter=order)]
    plane = posted.column("plane").to_numpy().astype(np.int64)
    links = np.left_shift(1, np.maximum(plane - 1, 0))
    owner, place = places_of(posted.column("docs"), posted.column("n").to_numpy().astype(np.int64))
    sums = {}
    for name, each in (("n_links", links), ("n_best", links * best[at]), ("count_sum", links * documents[at])):
        total = np.zeros(docs.num_rows, np.int64)
        np.add.at(total, place, each[owner])
        sums[name] = pa.array(total)
    kept = [c for c in docs.column_names if c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "groups")]
    return pa.table({c: docs.column(c) for c in kept} | sums)


def aligned(docs: DataFrame, byte_level: str, pieces: str, **options) -> DataFrame:
    """One row for each document: its tokens, groups and links, and what its links are worth in the corpus.

    ``n_a``, ``n_b``: tokens of a space and the text by the byte-level file, and
    of the text by the piece file, which adds the space.  ``n_groups``: stretches
    between bytes where tokens of both end.  ``n_links``: pairs of tokens in one
    group.  A link counts as many documents as hold its pair of ids linked;
    ``count_sum`` adds these up over the links, ``n_best`` counts the links whose
    pair has the most documents among all pairs of its first id, ties included.
    ``groups_sha256`` is the digest of the groups as text (``a1,a2|b1;a3|b2``);
    with ``groups=True`` that text comes too.  Options are those of :func:`postings`.

    Null and empty texts, and texts whose tokens do not spell a space and the
    text on both sides, have no tokens: zeros, and empty strings; they count in
    no document count.  Each row is a document of its own, also with an id or
    text that others have, or a null id.  Other columns of ``docs`` are not
    carried, so their names cannot clash; an empty table gives no rows.

    Bitmaps stay with their block.  What goes by pair are narrow rows, one for
    each pair and block, so a pair that all documents hold has a row for each
    block, and adaptive execution can split these.  A block's postings and what
    its pairs are worth then meet in one task, which is bounded by the block.
    """
    found = postings(docs, byte_level, pieces, **options)
    worth = settle(pair_counts(found).select("a", "b", "documents", "best"))
    by_block = found.where("plane = 0").select("block", "a", "b").join(worth, ["a", "b"])
    together = found.unionByName(by_block, allowMissingColumns=True)
    schema = found.schema
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", *(["groups"] if "groups" in schema.names else [])]
    ddl = ", ".join(f"{c} {schema[c].dataType.simpleString()}" for c in names)
    return together.groupBy("block").applyInArrow(_score, f"{ddl}, n_links long, n_best long, count_sum long")
