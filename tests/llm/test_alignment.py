import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from bootloom.llm import alignment as al
from tests.llm.plain import ODD, prose, table

PATHS = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
SIGNS = [" ", "  ", "\n", "\t", " \n ", " ", "　", "a", "Zo", "é", "日本", "1", "23", ".", ",", "'s", "<|endoftext|>", "</s>", "<0x41>"]
SIGNS += ["🙂", "é", "\x00", "\r\n", "--", "xxxx", " ", " ", "\x1c"]


def strange(seed):
    rng = random.Random(seed)
    return "".join(rng.choices(SIGNS, k=rng.randint(1, 60)))


DOCS = ODD + [(100 + i, strange(i)) for i in range(60)] + [(300, "a ▁ b"), (301, " "), (302, "ab" * 900), (303, "日" * 300)]
DOCS += [(304, "zo an " * 4000)]


def byte_of(char):
    """How byte-level vocabularies write bytes: printable ones as they are, the others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    code = ord(char)
    return code if code in shown else [b for b in range(256) if b not in shown][code - 256]


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(PATHS[0])
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def tokens(text, libraries):
    """Two lists of (id, bytes), empty where the bytes are not a space and the text."""
    first, second = libraries
    if not text:
        return [], []
    a = [(i, bytes(map(byte_of, first.id_to_token(i)))) for i in first.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in second.encode(text):
        piece = second.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = b" " + text.encode()
    return (a, b) if all(b"".join(t for _, t in side) == whole for side in (a, b)) else ([], [])


def groups_of(a, b):
    """Walk along both until they meet."""
    found, i, j = [], 0, 0
    while i < len(a):
        left, right, x, y = [], [], 0, 0
        while not left or x != y:
            if x <= y:
                left.append(a[i][0])
                x += len(a[i][1])
                i += 1
            else:
                right.append(b[j][0])
                y += len(b[j][1])
                j += 1
        found.append((left, right))
    return found


def brute(docs, libraries):
    each, holds = [], Counter()
    for doc_id, text in docs:
        a, b = tokens(text, libraries)
        groups = groups_of(a, b)
        links = Counter((x, y) for left, right in groups for x in left for y in right)
        holds.update(links.keys())
        each.append((doc_id, len(a), len(b), groups, links))
    most = {}
    for (x, _), n in holds.items():
        most[x] = max(n, most.get(x, 0))
    out = []
    for doc_id, n_a, n_b, groups, links in each:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append(
            (
                doc_id, n_a, n_b, len(groups), sum(links.values()),
                sum(n for p, n in links.items() if holds[p] == most[p[0]]),
                sum(n * holds[p] for p, n in links.items()),
                hashlib.sha256(text.encode()).hexdigest() if groups else "",
            )
        )
    return sorted(out, key=str), holds, sum((e[4] for e in each), Counter())


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("options", [{}, {"call_bytes": 40, "block_docs": 7}, {"block_entries": 1, "call_bytes": 1000}])
def test_against_plain_loops(spark, libraries, options):
    got = al.aligned(table(spark, DOCS), *PATHS, **options).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(DOCS, libraries)[0]


def test_pairs_and_planes(spark, libraries):
    _, holds, links = brute(DOCS, libraries)
    got = al.pair_counts(al.postings(table(spark, DOCS), *PATHS, block_docs=20)).collect()
    assert {(r.a, r.b): (r.documents, r.links) for r in got} == {p: (n, links[p]) for p, n in holds.items()}
    most = {}
    for (a, _), n in holds.items():
        most[a] = max(n, most.get(a, 0))
    assert all(r.best == (r.documents == most[r.a]) for r in got)


def test_groups_as_text(spark):
    got = al.aligned(table(spark, DOCS), *PATHS, groups=True, call_bytes=40).collect()
    assert all(r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in got)
    assert sum(r.groups.count(";") + 1 for r in got if r.groups) == sum(r.n_groups for r in got)


def test_parts_end_where_both_tokenizers_begin_a_token(libraries):
    for seed in range(400):
        text = strange(seed) + " " + strange(seed + 1000)
        a, b = tokens(text, libraries)
        pieces = [tokens(p[1:].decode(), libraries) for p in al.parts(b" " + text.encode(), 1)]
        if a and all(p[0] for p in pieces):
            assert [sum((p[k] for p in pieces), []) for k in (0, 1)] == [a, b], text


def test_bitmaps_are_the_shorter_form():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    keys = np.unique(np.concatenate([rng.integers(0, 5, 3000) * 7 << 16 | rng.integers(0, 900, 3000), [99 << 16 | 3]]))
    pairs, n, docs = al.bitmaps(keys, 900)
    assert max(len(x.as_py()) for x in docs) <= -(-900 // 8)
    owner, place = al.places_of(pa.chunked_array([docs]), n)
    assert sorted(zip(pairs[owner].tolist(), place.tolist())) == sorted((k >> 16, k & 0xFFFF) for k in keys.tolist())


def test_nothing(spark):
    empty = table(spark, DOCS).limit(0)
    assert al.aligned(empty, *PATHS).collect() == []
    got = al.aligned(table(spark, [(1, None), (2, ""), (None, "▁")]), *PATHS).select(*COLUMNS[1:]).collect()
    assert {tuple(r) for r in got} == {(0, 0, 0, 0, 0, 0, "")}
