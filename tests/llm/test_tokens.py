import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from bootloom.llm import bpe, token_counts
from tests.llm.plain import ODD, prose, table

WORD = public_tokenizers.path("word_bpe_49k.json")


def expected(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(library.encode(t or ""))
    library = Tokenizer.from_file(path)
    return lambda t: len(library.encode(t or "", add_special_tokens=False))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_are_the_library_s(spark, name):
    want = expected(name)
    got = token_counts.token_counts(table(spark), public_tokenizers.path(name)).collect()
    assert sorted((r.text or "", r.n_tokens, r.n_bytes, r.over_limit) for r in got) == sorted(
        (t or "", want(t), len((t or "").encode()), want(t) > 2048) for _, t in ODD
    )
    assert {r.component_id for r in got} == {"mine"}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_cuts_are_safe(name):
    """Tiny batches cut every text in many places and forget words all the time."""
    path = public_tokenizers.path(name)
    kind = name.rpartition(".")[2]
    with open(path, "rb") as file:
        content = file.read()
    count = token_counts.counter(kind, content if kind == "model" else content.decode(), batch_bytes=64, remembered=10)
    texts = [t or "" for _, t in ODD] + ["a  b   c", "one two", "x. y's don't 3 4", "tail "]
    want = expected(name)
    assert count([t.encode() for t in texts]) == [want(t) for t in texts]


def test_counts_of_nothing(spark):
    assert token_counts.token_counts(table(spark).limit(0), WORD).collect() == []


def library_digests(text):
    library = Tokenizer.from_file(WORD)
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    packed = struct.pack(f"<{len(ids)}I", *ids)
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_bpe_is_the_library_s(spark):
    got = bpe.bpe_digests(table(spark), WORD).collect()
    assert sorted((r.text or "", r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(
        (t or "", *library_digests(t)) for _, t in ODD
    )
    assert bpe.bpe_digests(table(spark).limit(0), WORD).collect() == []


def test_bpe_ids_and_text(spark):
    docs = spark.createDataFrame([(1, "Hello, World's <|endoftext|>"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.c for r in docs.select("doc_id", bpe.encoded(docs, WORD).alias("c")).collect()}
    library = Tokenizer.from_file(WORD)
    ids = library.encode("Hello, World's <|endoftext|>", add_special_tokens=False).ids
    assert list(got[1].ids) == ids and got[1].decoded == library.decode(ids, skip_special_tokens=False)
    assert list(got[2].ids) == [] and got[2].decoded == ""


def test_trie_on_random_words():
    """Words of few letters meet every order of merges; small generations forget and learn anew."""
    with open(WORD, encoding="utf-8") as file:
        content = file.read()
    codec = bpe.Codec(content, part_bytes=200, remembered=2000)
    library = Tokenizer.from_str(content)
    rng = random.Random(5)
    texts = [
        " ".join("".join(rng.choice("aaabelnost'-.é1") for _ in range(rng.randint(1, 14))) for _ in range(40))
        for _ in range(150)
    ] + [prose(3, 400)]
    for text, (n, ids, decoded) in zip(texts, codec.results([t.encode() for t in texts])):
        want = library.encode(text, add_special_tokens=False)
        assert list(struct.unpack(f"<{n}I", ids)) == want.ids
        assert decoded == library.decode(want.ids, skip_special_tokens=False)


def test_shared_prefixes_are_one_node():
    with open(WORD, encoding="utf-8") as file:
        trie = bpe.Trie(bpe.Codec(file.read()).vocabulary)
    for word in ("kalam", "kalat", "kala"):
        trie.insert(word)
    node = trie.root
    for char in "kal":
        assert list(node) == [char]
        node = node[char]
    assert sorted(node) == ["a", "a</w>"]
    assert {w for w, _ in trie.encodings()} == {"kalam", "kalat", "kala"}
