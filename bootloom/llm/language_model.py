"""A bigram language model whose quantised counts are kept in a log-frequency Bloom filter."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bootloom.llm.common import KEY, SPACED_WORD, ascii_lower, bucket_of, release_memory, with_key
from bootloom.operators.lineage import drop_settled, settle, shuffles_removed

#: Fold modulus and the remainder that is held out.
FOLDS, HELD_OUT = 7, 2
#: Bigrams that occur less often are not kept: none, as 1 is the filter's first level.
LEAST = 1
#: Bits of the filter for each entry, probes of each entry, and bits of a block.
BITS_PER_ENTRY, PROBES, BLOCK_BITS = 12, 4, 1 << 20
#: Weight of the estimate from pairs, for a history that was seen.
TRUST = 0.25
#: Filter and counts up to this size are broadcast; larger ones stay distributed.
BROADCAST_BYTES = 128 << 20
#: Tokens that are worked on at once.
STEP = 1 << 19
#: Tokens whose n-grams are asked for together: the more, the fewer n-grams are asked for twice.
CHUNK = 1 << 21
#: Blocks that are asked together have so many at least, and are so many groups at most.
GROUP_BLOCKS, GROUPS = 8, 1 << 10
_END = "\n"  # no word has a line end in it


def tokens(text: Column) -> Column:
    """64-bit hashes of the words of a text in lower case (A-Z), and of its end."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"({SPACED_WORD})"), F.lit(1))
    return F.concat(F.transform(words, lambda w: F.xxhash64(w)), F.array(F.xxhash64(F.lit(_END))))


# N-grams are named by 64-bit numbers: even ones are single tokens, odd ones pairs.


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def single_names(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.uint64) << np.uint64(1)


def pair_names(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each token the name of the pair it ends; the first token of a text follows 0."""
    before = np.concatenate([[0], hashes[:-1]]).astype(np.int64)
    before[starts] = 0
    return _mixed(before.view(np.uint64) * np.uint64(3) ^ _mixed(hashes.view(np.uint64))) | np.uint64(1)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and where each row starts; every row has at least its end token."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.asarray(column.offsets, np.int64)
    return np.asarray(column.values)[offsets[0] : offsets[-1]].astype(np.int64), offsets - offsets[0]


def _steps(column: pa.Array, size: int = STEP) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` tokens."""
    offsets = np.asarray(column.offsets, np.int64)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1)
        yield start, min(end, len(column))
        start = end


def _ngram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams of a batch: combined here, so that a frequent one is one row for each step."""
    for batch in batches:
        column = batch.column(0)
        for a, b in _steps(column):
            values, starts = _flat(column.slice(a, b - a))
            for names in (single_names(values), pair_names(values, starts[:-1])):
                found, counts = np.unique(names, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts)], names=["name", "n"])


# The filter. A token of count c has the levels 1 .. 1 + floor(log2 c), a pair those of c / LEAST, as no kept pair is
# rarer; each level is one entry.


def levels_of(names: np.ndarray, counts: np.ndarray) -> np.ndarray:
    least = np.where(names & np.uint64(1) == 0, 1, LEAST)
    return np.where(counts >= least, 1 + np.floor(np.log2(np.maximum(counts / least, 1))), 0).astype(np.int64)


def expected(names: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The middle of the counts that have so many levels."""
    least = np.where(names & np.uint64(1) == 0, 1, LEAST)
    return np.where(levels > 0, (3 * least * 2.0 ** (levels - 1) - 1) / 2, 0.0)


def blocks_of(names: np.ndarray, blocks: int) -> np.ndarray:
    return ((names >> np.uint64(34)) % np.uint64(blocks)).astype(np.int64)


def _bits(names: np.ndarray, level: np.ndarray | int, probe: int) -> np.ndarray:
    """Where an entry's probe falls in its block."""
    entry = np.atleast_1d(level).astype(np.uint64) * np.uint64(PROBES) + np.uint64(probe)
    at = _mixed(names + np.uint64(0x9E3779B97F4A7C15) * entry)
    return (at >> np.uint64(20)) % np.uint64(BLOCK_BITS)


def filter_block(names: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One block of the filter, with all levels of the n-grams that fall into it."""
    levels = levels_of(names, counts)
    block = np.zeros(BLOCK_BITS // 8, np.uint8)
    each = np.repeat(names, levels)
    level = np.arange(len(each)) - np.repeat(np.cumsum(levels) - levels, levels) + 1
    for probe in range(PROBES):
        bits = _bits(each, level, probe)
        np.bitwise_or.at(block, (bits >> np.uint64(3)).astype(np.int64), (1 << (bits & np.uint64(7))).astype(np.uint8))
    return block


def probe_levels(names: np.ndarray, where: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """How many levels, one after another from the first, the filter has of each n-gram.

    ``where`` is the first byte of each n-gram's block in ``bits``.
    """
    levels = np.zeros(len(names), np.int64)
    left = np.arange(len(names))
    level = 1
    while len(left):
        for probe in range(PROBES):
            at = _bits(names[left], level, probe)
            byte = bits[where[left] + (at >> np.uint64(3)).astype(np.int64)]
            left = left[(byte >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        levels[left] = level
        level += 1
    return levels


@dataclass
class LanguageModel:
    """What was learned: exact counts and filter blocks as tables in the shared folder, and three figures."""

    counts: DataFrame  # name, n: single tokens
    blocks: DataFrame  # block, bits
    n_blocks: int
    n_tokens: int
    n_types: int


def _settled(df: DataFrame) -> DataFrame:
    """``df``, settled; what was shuffled for it is removed."""
    with shuffles_removed(df.sparkSession):
        return settle(df)


def train(docs: DataFrame, text: str = "text") -> LanguageModel:
    """Count tokens and pairs of all of ``docs`` and put their quantised counts into the filter.

    The filter has a fixed number of bits for each entry, so it grows with the
    corpus and its error does not.  A block has the n-grams whose names fall to
    it and is made in one task, of bounded size however large the corpus is.
    """
    hashed = docs.select(tokens(F.col(text)).alias("t"))
    counted = hashed.mapInArrow(_ngram_counts, "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))
    single = F.col("name").bitwiseAND(1) == 0
    kept = _settled(counted.where(single | (F.col("n") >= LEAST)))
    entries = F.sum(F.floor(F.log2(F.col("n") / F.when(single, 1).otherwise(LEAST)) + 1e-12) + 1)
    figures = kept.agg(
        F.sum(F.when(single, F.col("n"))).alias("tokens"), F.sum(F.when(single, 1)).alias("types"), entries.alias("entries")
    ).first()
    n_blocks = max(1, -(-int(figures["entries"] or 0) * BITS_PER_ENTRY // BLOCK_BITS))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        names = np.asarray(table.column("name").combine_chunks(), np.int64).view(np.uint64)
        bits = filter_block(names, np.asarray(table.column("n").combine_chunks(), np.int64))
        block = table.column("block").combine_chunks()[:1]
        yield pa.RecordBatch.from_arrays([block, pa.array([bits.tobytes()], pa.binary())], names=["block", "bits"])

    block = F.pmod(F.shiftrightunsigned("name", 34), F.lit(n_blocks)).cast("long").alias("block")
    blocks = _settled(kept.select(block, "name", "n").groupBy("block").applyInArrow(make, "block long, bits binary"))
    # Most of what was counted are pairs, which only the filter needs.
    counts = settle(kept.where(single))
    drop_settled(kept)
    return LanguageModel(counts, blocks, n_blocks, int(figures["tokens"] or 0), int(figures["types"] or 0))


def _probability(word: np.ndarray, history: np.ndarray, pair: np.ndarray, total: float) -> np.ndarray:
    """Interpolated estimate of a token from expected counts; ``total`` is tokens + types + 1."""
    alone = (word + 1) / total
    weight = np.where(history > 0, TRUST, 0.0)
    return weight * np.minimum(pair, history) / np.maximum(history, 1) + (1 - weight) * alone


def _totals(
    starts: np.ndarray, word: np.ndarray, pair: np.ndarray, base: np.ndarray, known: np.ndarray, total: float
) -> list[np.ndarray]:
    """The figures of each text from those of its tokens: expected counts, the logarithm of the base score, and whether they are known."""
    history = np.concatenate([[0.0], word[:-1]])
    # A text begins after an end.
    history[starts[:-1]] = word[starts[1:] - 1]
    own = np.log10(_probability(word, history, pair, total))
    return [
        starts[1:] - starts[:-1],
        np.add.reduceat(known.astype(np.int64), starts[:-1]),
        np.add.reduceat(base, starts[:-1]),
        np.add.reduceat(own, starts[:-1]),
    ]


class ExactCounts:
    """Counts by name in little memory: a byte each, and the few from 255 on in full."""

    def __init__(self, names: np.ndarray, counts: np.ndarray):
        order = np.argsort(names)
        self.names = names[order]
        self.bytes = np.minimum(counts, 255).astype(np.uint8)[order]
        self.large = np.flatnonzero(self.bytes == 255)
        self.in_full = counts[order[self.large]]

    def of(self, names: np.ndarray) -> np.ndarray:
        if not len(self.names):
            return np.zeros(len(names), np.int64)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        found = np.where(self.names[at] == names, self.bytes[at], 0).astype(np.int64)
        large = found == 255
        found[large] = self.in_full[np.searchsorted(self.large, at[large])]
        return found


def _on_driver(model: LanguageModel) -> tuple[ExactCounts, np.ndarray]:
    """Counts of single tokens, and the bits of all blocks; only for a checked size."""
    table = model.counts.select("name", "n").toArrow()
    names = np.asarray(table.column("name").combine_chunks(), np.int64).view(np.uint64)
    exact = ExactCounts(names, np.asarray(table.column("n").combine_chunks(), np.int64))
    bits = np.zeros(model.n_blocks * (BLOCK_BITS // 8), np.uint8)
    for row in model.blocks.toLocalIterator():
        start = row["block"] * (BLOCK_BITS // 8)
        bits[start : start + BLOCK_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return exact, bits


_SCORES = "n_tokens long, n_known long, base_score double, score double"


def scored(docs: DataFrame, model: LanguageModel, *, text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``n_tokens``, ``n_known``, ``base_score`` and ``score``, the log10 probability of each whole text.

    Null and empty texts have one token, their end.  ``base_score`` adds one to
    the exact counts; ``score`` interpolates pairs and single tokens, with counts
    as the filter has them.  Columns of these names are replaced, all others stay.

    Counts and filter go to all workers if they are at most ``broadcast_bytes``
    large.  Larger ones stay where they are: the distinct n-grams of the documents
    are sent to the blocks that can tell their levels, and the answers are joined
    back.  Both ways give the same figures.
    """
    size = model.n_types * 9 + model.n_blocks * (BLOCK_BITS // 8)
    if size > broadcast_bytes:
        return _scored_apart(docs, model, text)
    shared = docs.sparkSession.sparkContext.broadcast(_on_driver(model))
    known_tokens, known_types, n_blocks = model.n_tokens, model.n_types, model.n_blocks

    @F.arrow_udf(f"struct<{', '.join(c.replace(' ', ': ', 1) for c in _SCORES.split(', '))}>")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counts, bits = shared.value
        total = float(known_tokens + known_types + 1)

        def levels(of: np.ndarray) -> np.ndarray:
            return expected(of, probe_levels(of, blocks_of(of, n_blocks) * (BLOCK_BITS // 8), bits))

        for column in columns:
            parts = []
            for a, b in _steps(column):
                values, starts = _flat(column.slice(a, b - a))
                # Each distinct n-gram of the step is looked up once, in order.
                single, back = np.unique(single_names(values), return_inverse=True)
                exact = counts.of(single)
                word = levels(single)[back]
                pairs, pair_back = np.unique(pair_names(values, starts[:-1]), return_inverse=True)
                pair = levels(pairs)[pair_back]
                base = np.log10((exact + 1) / total)[back]
                parts.append(_totals(starts, word, pair, base, (exact > 0)[back], total))
            joined = [np.concatenate(p) for p in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
            yield pa.StructArray.from_arrays([pa.array(x) for x in joined], [c.split(" ")[0] for c in _SCORES.split(", ")])

    found = docs.withColumn("_score", score(tokens(F.col(text))))
    return found.withColumns({c.split(" ")[0]: F.col(f"_score.{c.split(' ')[0]}") for c in _SCORES.split(", ")}).drop("_score")


# Without a broadcast, texts are worked on in chunks. The names of a chunk's distinct n-grams go to the groups of blocks
# that they fall to, each once, and a byte for each comes back.


def _planes(numbers: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bytes of unsigned numbers, as a row for each number."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def _packed(planes: np.ndarray) -> bytes:
    """Bytes of numbers, all lowest ones first, so that high bytes that are 0 stand together; the first byte is their width."""
    return bytes([planes.shape[1]]) + planes.T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    numbers = np.zeros((planes.shape[1], 8), np.uint8)
    numbers[:, :width] = planes.T
    return numbers.reshape(-1).view("<u8").astype(np.uint64)


def _width(numbers: np.ndarray) -> int:
    return max(1, -(-int(numbers.max()).bit_length() // 8)) if len(numbers) else 1


@dataclass(frozen=True)
class Groups:
    """Blocks of the filter in groups of ``each``, and names as numbers that are small in their group."""

    n_blocks: int
    each: int

    @staticmethod
    def of(n_blocks: int) -> Groups:
        return Groups(n_blocks, min(n_blocks, max(GROUP_BLOCKS, -(-n_blocks // GROUPS))))

    def group(self, names: np.ndarray) -> np.ndarray:
        return (blocks_of(names, self.n_blocks) // self.each).astype(np.uint16)

    def short(self, names: np.ndarray) -> np.ndarray:
        """Names of one group in order give numbers in order."""
        n, each = np.uint64(self.n_blocks), np.uint64(self.each)
        high = names >> np.uint64(34)
        return (high // n * each + high % n % each) << np.uint64(34) | names & np.uint64((1 << 34) - 1)

    def long(self, short: np.ndarray, group: int) -> np.ndarray:
        n, each = np.uint64(self.n_blocks), np.uint64(self.each)
        high = short >> np.uint64(34)
        high = high // each * n + np.uint64(group) * each + high % each
        return high << np.uint64(34) | short & np.uint64((1 << 34) - 1)

    def parts(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For sorted names their places by group, the groups that have any, and where each of these starts and ends."""
        group = self.group(names)
        order = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.diff(group[order].astype(np.int64), prepend=-1))
        return order, group[order[starts]], np.append(starts, len(names))


_CHUNK = "chunk long, kd array<long>, kt array<long>, ends array<long>, words binary, at binary"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in chunks of about ``CHUNK`` tokens: distinct hashes in order, and each token's place among them."""
    for batch in batches:
        column = batch.column(2)
        for a, b in _steps(column, CHUNK):
            values, starts = _flat(column.slice(a, b - a))
            words, at = np.unique(values.view(np.uint64), return_inverse=True)
            steps = np.diff(words, prepend=np.uint64(0))
            at = _planes(at, _width(at))
            row = [
                [uuid.uuid4().int >> 65],
                [batch.column(0).slice(a, b - a).to_numpy(False)],
                [batch.column(1).slice(a, b - a).to_numpy(False)],
                [starts],
                [_packed(_planes(steps, _width(steps)))],
                # Some words are far more frequent than others, which Spark's codecs make no use of.
                [bytes([at.shape[1]]) + pa.compress(at.T.tobytes(), "zstd", asbytes=True)],
            ]
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary(), pa.binary()]
            names = [c.split(" ")[0] for c in _CHUNK.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds)], names=names)
    release_memory()


def _ngrams_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk where its texts start, the names of its n-grams in order, and the place among them of each token and of the pair it ends."""
    starts = np.asarray(row["ends"], np.int64)
    words = np.cumsum(_unpacked(row["words"]), dtype=np.uint64)
    width, n = row["at"][0], int(starts[-1])
    at = _unpacked(row["at"][:1] + pa.decompress(row["at"][1:], n * width, "zstd", asbytes=True)).astype(np.int64)
    pairs = pair_names(words[at].view(np.int64), starts[:-1])
    names, back = np.unique(np.concatenate([single_names(words), pairs]), return_inverse=True)
    return starts, names, back[: len(words)][at], back[len(words) :]


def _told(
    names: list[np.ndarray], group: int, groups: Groups, bits: np.ndarray, exact: ExactCounts
) -> Iterator[tuple[bytes, bytes, bytes]]:
    """For each array of names their levels, and the exact counts of single tokens: a byte each, and those from 255 on in full."""
    each = np.concatenate(names)
    where = (blocks_of(each, groups.n_blocks) - group * groups.each) * (BLOCK_BITS // 8)
    levels = probe_levels(each, where, bits).astype(np.uint8)
    single = each & np.uint64(1) == 0
    counts = np.zeros(len(each), np.int64)
    counts[single] = exact.of(each[single])
    start = 0
    for own in names:
        end = start + len(own)
        n = counts[start:end][single[start:end]]
        yield levels[start:end].tobytes(), np.minimum(n, 255).astype(np.uint8).tobytes(), n[n >= 255].tobytes()
        start = end


def _scored_apart(docs: DataFrame, model: LanguageModel, text: str) -> DataFrame:
    """As ``scored``, with nothing broadcast.

    Each chunk of texts sends a name of some six bytes for each distinct n-gram to the
    group of blocks that can tell its level, and gets a byte back.  So what is
    shuffled is in proportion to the distinct n-grams of chunks, and each text's
    tokens stay in one row.
    """
    keyed, groups = with_key(docs, text), Groups.of(model.n_blocks)
    # Rows equal in id and text are scored each, as telling them apart first would shuffle all texts.
    chunks = settle(keyed.select(*KEY, tokens(F.col(text)).alias("_t")).mapInArrow(_chunks, _CHUNK))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                names = _ngrams_of(row)[1]
                order, group, starts = groups.parts(names)
                short = groups.short(names[order])
                steps = np.diff(short, prepend=np.uint64(0))
                steps[starts[:-1]] = short[starts[:-1]]
                planes = _planes(steps, _width(steps))
                columns = [
                    pa.array(group, pa.int32()),
                    pa.array(np.full(len(group), row["chunk"], np.int64)),
                    pa.array([_packed(planes[a:b]) for a, b in zip(starts, starts[1:])], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["grp", "chunk", "names"])
        release_memory()

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], [], [], []]
        if left.num_rows:
            group = left.column("grp")[0].as_py()
            bits = np.zeros(groups.each * (BLOCK_BITS // 8), np.uint8)
            is_block = right.column("bits").is_valid()
            for row in right.filter(is_block).select(["block", "bits"]).to_pylist():
                start = (row["block"] - group * groups.each) * (BLOCK_BITS // 8)
                bits[start : start + BLOCK_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
            counted = right.filter(right.column("name").is_valid())
            of_counted = [np.asarray(counted.column(c).combine_chunks(), np.int64) for c in ("name", "n")]
            exact = ExactCounts(of_counted[0].view(np.uint64), of_counted[1])
            asked = left.column("names").combine_chunks()
            at, waiting, n = 0, [], 0
            for i in range(left.num_rows):
                waiting.append(groups.long(np.cumsum(_unpacked(asked[i].as_py()), dtype=np.uint64), group))
                n += len(waiting[-1])
                if n >= STEP or i + 1 == left.num_rows:
                    for k, told in enumerate(_told(waiting, group, groups, bits, exact)):
                        for column, value in zip(out, (left.column("chunk")[at + k].as_py(), group, *told)):
                            column.append(value)
                    at, waiting, n = i + 1, [], 0
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 3]
        return pa.table([pa.array(v, t) for v, t in zip(out, kinds)], names=["chunk", "grp", "levels", "counts", "large"])

    block = F.pmod(F.shiftrightunsigned("name", 34), F.lit(model.n_blocks)).cast("long")
    of_group = F.floor(F.col("block") / groups.each).cast("int").alias("grp")
    no = {c: F.lit(None).cast(t).alias(c) for c, t in (("bits", "binary"), ("name", "long"), ("n", "long"))}
    tables = model.blocks.select(of_group, "block", "bits", no["name"], no["n"]).unionByName(
        model.counts.withColumn("block", block).select(of_group, "block", no["bits"], "name", "n")
    )
    asked = chunks.mapInArrow(ask, "grp int, chunk long, names binary")
    answer = "chunk long, grp int, levels binary, counts binary, large binary"
    answers = _settled(asked.groupBy("grp").cogroup(tables.groupBy("grp")).applyInArrow(probe, answer))
    total = float(model.n_tokens + model.n_types + 1)

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        row = right.to_pylist()[0]
        starts, names, of_word, of_pair = _ngrams_of(row)
        order = groups.parts(names)[0]
        given = left.sort_by("grp")
        told = [np.frombuffer(b"".join(given.column(c).to_pylist()), t) for c, t in (("levels", np.uint8), ("counts", np.uint8), ("large", np.int64))]
        levels = np.zeros(len(names), np.int64)
        levels[order] = told[0]
        counts = told[1].astype(np.int64)
        counts[counts == 255] = told[2]
        exact = np.zeros(len(names), np.int64)
        exact[order[names[order] & np.uint64(1) == 0]] = counts
        likely, base = expected(names, levels), np.log10((exact + 1) / total)
        figures = _totals(starts, likely[of_word], likely[of_pair], base[of_word], (exact > 0)[of_word], total)
        keys = [np.asarray(row["kd"], np.int64), np.asarray(row["kt"], np.int64)]
        return pa.table([pa.array(x) for x in keys + figures], names=[*KEY, *new])

    new = [c.split(" ")[0] for c in _SCORES.split(", ")]
    figures = answers.groupBy("chunk").cogroup(chunks.groupBy("chunk")).applyInArrow(add, f"_kd long, _kt long, {_SCORES}")
    sums = _settled(figures.dropDuplicates(KEY))
    for used in (chunks, answers):
        drop_settled(used)
    return keyed.drop(*new).join(sums, KEY).drop(*KEY)


def learned_from(doc_id: Column) -> Column:
    """Whether a document is one to learn from; one without an id is."""
    return F.coalesce(bucket_of(doc_id, FOLDS) != HELD_OUT, F.lit(True))
