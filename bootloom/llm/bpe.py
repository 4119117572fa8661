"""BPE encoding and decoding through a trie of distinct words."""

from __future__ import annotations

import gc
import hashlib
import json
import math
import re
import struct
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bootloom.llm.common import cut_at_space, release_memory

#: Bytes of text that are worked off at once; bytes of words, and of pieces, that a task remembers in each of two
#: generations; and pairs of tokens that a worker remembers.
PART_BYTES = 1 << 21
REMEMBERED = 32 << 20
PAIRS = 200_000
#: What a remembered word takes beside its own bytes and ids, about.
_OVERHEAD = 180
#: Ids that are decoded at once.
_DECODED = 1 << 18
#: Texts of a batch whose results are held at once.
ROWS = 1000
#: Fixed value: the split pattern of word-level files as their JSON has it, and the same for lower-case printable ASCII.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Printable ASCII and the Latin letters whose normal form is themselves and whose lower case is one letter.
_LATIN = re.compile(r"[!-~À-ÖØ-öø-įĲ-ňŊ-ž]+")
#: The split pattern for lower-case text of these characters.
_LATIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-ž]+|[0-9]|[^a-z0-9ß-ž]+")
#: How byte-level vocabularies write the bytes that are not printable: with code points from 256 on, in order.
_UNSHOWN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(_UNSHOWN)}


class Vocabulary:
    """Tokens, merges and their ranks, and which pairs of tokens stand side by side in an encoding."""

    def __init__(self, model: dict):
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.tokens = {i: t for t, i in self.ids.items()}
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.ranks = {p: rank for rank, p in enumerate(pairs)}
        # By last symbol: the most characters of a token that ends with it.
        self.reach: dict[str, int] = {}
        for token in self.ids:
            *body, symbol = self.symbols(token)
            self.reach[symbol] = max(self.reach.get(symbol, 0), len(body) + 1)
        self._spines: dict[str, tuple[list[tuple[str, float]], list[tuple[str, float]]] | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def symbols(self, token: str) -> list[str]:
        """The first symbols of a token: its characters, the last one with the end mark."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def spines(self, token: str) -> tuple[list[tuple[str, float]], list[tuple[str, float]]] | None:
        """The symbols at the left and at the right end of a token as it is merged, each with the rank that ends it.

        Merges the adjacent pair of lowest rank, the leftmost first, until none
        is left.  None if that gives anything but the one token.
        """
        if token not in self._spines:
            symbols = self.symbols(token)
            left, right = [], []
            while len(symbols) > 1:
                rank, at = min((self.ranks.get(p, math.inf), i) for i, p in enumerate(zip(symbols, symbols[1:])))
                if rank == math.inf:
                    break
                if at == 0:
                    left.append((symbols[0], rank))
                if at == len(symbols) - 2:
                    right.append((symbols[-1], rank))
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            whole = symbols == [token]
            last = [(token, math.inf)]
            self._spines[token] = (left + last, right + last) if whole else None
        return self._spines[token]

    def side_by_side(self, left: str, right: str) -> bool:
        """Whether the encoding of the two tokens' text is these two tokens (``left`` empty: this one token).

        It is unless some symbol at the right end of ``left`` merges with one at
        the left end of ``right`` before either is merged inside its own token.
        """
        key = (left, right)
        if (known := self.pairs.get(key)) is None:
            known = self.pairs[key] = self._stays_apart(left, right)
        return known

    def _stays_apart(self, left: str, right: str) -> bool:
        ends, starts = self.spines(left) if left else None, self.spines(right)
        if starts is None or not left:
            return starts is not None
        i = j = 0
        while True:
            (a, a_ends), (b, b_ends) = ends[1][i], starts[0][j]
            across = self.ranks.get((a, b), math.inf)
            # Of equal ranks the leftmost is merged first.
            if across < a_ends and across <= b_ends and across < math.inf:
                return False
            if a_ends == b_ends == math.inf:
                return True
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1


class Trie:
    """Distinct words by symbol.  Each node stands for a prefix; a prefix that words share is one node.

    A node is a dict by symbol; under a word's last symbol, with the end mark,
    is the word itself.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.root: dict = {}

    def insert(self, word: str) -> None:
        node = self.root
        for char in word[:-1]:
            below = node.get(char)
            if below is None:
                below = node[char] = {}
            node = below
        node[word[-1] + self.vocabulary.end] = word

    def encodings(self) -> Iterator[tuple[str, list[str]]]:
        """Each word with its tokens.

        A BPE encoding without its last token is the encoding of the text before
        that token, and any two neighbours in it are what BPE makes of their own
        text.  So the last token of a prefix follows from the last tokens of
        shorter prefixes: it is the suffix token that can stand beside the last
        token of what precedes it.  Depth first, each prefix gets its last token
        once; the words below it only read it.
        """
        end = len(self.vocabulary.end)
        ids, pairs, reach = self.vocabulary.ids, self.vocabulary.pairs, self.vocabulary.reach
        last: list[str] = [""]  # by depth: the last token of the prefix on the way from the root
        stack = [(symbol, 1, node) for symbol, node in self.root.items()]
        while stack:
            prefix, depth, node = stack.pop()
            del last[depth:]
            while True:
                # Of the suffix tokens, the longest that can stand beside what is before it.
                for start in range(max(depth - reach.get(prefix[depth - 1 :], 0), 0), depth):
                    token = prefix[start:]
                    if token in ids:
                        pair = last[start], token
                        if pairs[pair] if pair in pairs else self.vocabulary.side_by_side(*pair):
                            last.append(token)
                            break
                else:
                    raise ValueError(f"no token ends {prefix!r}: a symbol is not in the vocabulary")
                if type(node) is str:
                    yield node, self._tokens(last, end)
                    break
                if len(node) > 1:
                    stack += [(prefix + symbol, depth + 1, below) for symbol, below in node.items()]
                    break
                # A prefix with one continuation goes on without the stack.
                ((symbol, node),) = node.items()
                prefix += symbol
                depth += 1

    @staticmethod
    def _tokens(last: list[str], end: int) -> list[str]:
        tokens, at = [], len(last) - 1
        while at > 0:
            token = last[at]
            tokens.append(token)
            at -= len(token) - end
            end = 0
        tokens.reverse()
        return tokens


class Codec:
    """Ids and decoded text of whole texts, for a tokenizer that drops white space.

    The words between white space are remembered with their ids, so a word is
    split and encoded once.  Normal form and split of a word that is not plain
    Latin text are the library's own.  What is remembered has two generations:
    once the newer one is full it becomes the older one, and what is still in
    use comes back from there.  The decoded text is made from the ids.
    """

    def __init__(self, content: str, part_bytes: int = PART_BYTES, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.part_bytes, self.remembered = part_bytes, remembered
        config = json.loads(content)
        self.vocabulary = Vocabulary(config["model"])
        self.library = Tokenizer.from_str(content)
        special = sorted((t["content"] for t in config["added_tokens"]), key=len, reverse=True)
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, special)) + ")" if special else "(?!)")
        # Special strings are no words, as a word never has letters next to signs; so they can stand among the words.
        self.special = {t["content"]: struct.pack("<I", t["id"]) for t in config["added_tokens"]}
        self.plain_split = SPLIT in content
        by_id = self.vocabulary.tokens | {t["id"]: t["content"] for t in config["added_tokens"]}
        self.token_of = [by_id.get(i, "") for i in range(max(by_id) + 1)]
        self.rest()

    def rest(self) -> None:
        """Forget: between tasks a worker that waits keeps the vocabulary only."""
        # Ids of pieces between white space, and of words.
        self.ids: dict[bytes, bytes] = {}
        self.ids_before: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = dict(self.special)
        self.words_before: dict[str, bytes] = {}
        self.held = self.held_words = 0

    def _split(self, text: str) -> list[str]:
        """Words in the vocabulary's alphabet and special strings of a text without white space."""
        if self.plain_split and _LATIN.fullmatch(text) and "<|" not in text:
            words = _LATIN_WORD.findall(text.lower())
            if text.isascii():
                return words
            return [w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_CHARS) for w in words]
        found = []
        for part in self.special_pattern.split(text):
            if part in self.special:
                found.append(part)
            elif part:
                normal = self.library.normalizer.normalize_str(part)
                found += [word for word, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return found

    def learn(self, pieces: set[bytes]) -> None:
        """Have the ids of all of ``pieces``; the words that are new are encoded in one trie."""
        if self.held > self.remembered:
            self.ids_before, self.ids, self.held = self.ids, {}, 0
        if self.held_words > self.remembered:
            self.words_before, self.words, self.held_words = self.words, dict(self.special), 0
        if len(self.vocabulary.pairs) > PAIRS:
            self.vocabulary.pairs.clear()
        ids, words, ids_before, words_before = self.ids, self.words, self.ids_before, self.words_before
        found: list[tuple[bytes, list[str]]] = []
        new: set[str] = set()
        known, known_words = len(ids), len(words)
        for piece in pieces.difference(ids):
            if piece in ids_before:
                ids[piece] = ids_before[piece]
                continue
            split = [piece.decode().lower()] if piece.isalpha() else self._split(piece.decode())
            found.append((piece, split))
            for word in split:
                if word not in words:
                    if word in words_before:
                        words[word] = words_before[word]
                    else:
                        new.add(word)
        trie = Trie(self.vocabulary)
        for word in new:
            trie.insert(word)
        numbers = self.vocabulary.ids
        for word, tokens in trie.encodings():
            words[word] = struct.pack(f"<{len(tokens)}I", *[numbers[t] for t in tokens])
        for piece, split in found:
            ids[piece] = words[split[0]] if len(split) == 1 else b"".join([words[w] for w in split])
            self.held += len(piece) + len(ids[piece])
        self.held += _OVERHEAD * (len(ids) - known)
        self.held_words += _OVERHEAD * (len(words) - known_words) + 4 * sum(map(len, new))

    def results(self, texts: list[bytes]) -> Iterator[tuple[int, bytes, str]]:
        """Number of tokens, ids and decoded text of each text, worked off in parts of bounded size."""
        rows: list[list[bytes]] = [[] for _ in texts]
        waiting, size = [], 0
        for row, text in enumerate(texts):
            for part in cut_at_space(text, self.part_bytes):
                waiting.append((row, part.split()))
                size += len(part)
                if size >= self.part_bytes:
                    self._settle(waiting, rows)
                    waiting, size = [], 0
        self._settle(waiting, rows)
        for parts in rows:
            ids = b"".join(parts)
            parts.clear()
            yield len(ids) // 4, ids, self.decoded(ids)

    def decoded(self, ids: bytes) -> str:
        """The tokens of ids, with a space between them."""
        token_of = self.token_of.__getitem__
        step = 4 * _DECODED
        parts = (array("I", ids[at : at + step]) for at in range(0, len(ids), step))
        return " ".join([" ".join(map(token_of, part)) for part in parts])

    def _settle(self, waiting: list[tuple[int, list[bytes]]], rows: list[list[bytes]]) -> None:
        gc.disable()  # many small containers and no cycles among them
        try:
            self.learn(set().union(*(pieces for _, pieces in waiting)))
        finally:
            gc.enable()
        ids_of = self.ids.__getitem__
        for row, pieces in waiting:
            rows[row].append(b"".join(map(ids_of, pieces)))


_codecs: dict[int, Codec] = {}


def _codec_of(content: str) -> Codec:
    """One codec for all tasks of a Python worker."""
    key = hash(content)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(content)
    return _codecs[key]


def _row_groups(batches: Iterator[pa.Array], codec: Codec) -> Iterator[list[bytes]]:
    """The texts of a task a thousand at a time, so that results of few are in memory at once."""
    for batch in batches:
        for at in range(0, max(len(batch), 1), ROWS):
            yield [row or b"" for row in batch.slice(at, ROWS).cast(pa.binary()).to_pylist()]
    codec.rest()
    release_memory()


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encoded(docs: DataFrame, path: str, text: str = "text") -> Column:
    """A struct of ``ids`` (array of int) and ``decoded`` for each text.

    As the library encodes with no special tokens added, truncation or padding,
    and decodes with special tokens kept.  Null and empty texts give no ids and
    an empty decoded text.
    """
    model = docs.sparkSession.sparkContext.broadcast(_read(path))

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def codes(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec_of(model.value)
        for rows in _row_groups(texts, codec):
            got = list(codec.results(rows))
            offsets = [0]
            for n, _, _ in got:
                offsets.append(offsets[-1] + n)
            values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(g[1] for g in got))])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            yield pa.StructArray.from_arrays([ids, pa.array([g[2] for g in got], pa.string())], ["ids", "decoded"])

    return codes(F.col(text))


def digests(docs: DataFrame, path: str, text: str = "text") -> Column:
    """A struct of ``n_tokens`` and the digests of ids and decoded text; the long values stay in the worker."""
    model = docs.sparkSession.sparkContext.broadcast(_read(path))

    @F.arrow_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")
    def sums(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec_of(model.value)
        for rows in _row_groups(texts, codec):
            got = [
                (n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                for n, ids, decoded in codec.results(rows)
            ]
            yield pa.StructArray.from_arrays(
                [pa.array([g[0] for g in got], pa.int64()), *(pa.array([g[i] for g in got], pa.string()) for i in (1, 2))],
                ["n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return sums(F.col(text))


def bpe_digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256`` (ids as little-endian unsigned 32-bit integers) and ``decoded_sha256``.

    Columns of these names are replaced, all others stay.
    """
    got = docs.withColumn("_bpe", digests(docs, path, text))
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    return got.withColumns({n: F.col(f"_bpe.{n}") for n in names}).drop("_bpe")
