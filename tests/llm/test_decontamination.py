import pickle
import random

import pytest

from bootloom.llm import decontamination as dc
from tests.llm.plain import ODD, PASSAGE, plain_words, prose, table

ITEMS = [
    (1, PASSAGE[30:200]),
    (2, prose(1, 12)),
    (3, "kalata"),
    (3, "kalata"),
    (4, "never words seen anywhere"),
    (5, None),
    (6, "..."),
    (7, prose(5, 9_000)[2000:2300].upper()),
    (10, PASSAGE[30:200]),
    (None, "tofeta zo"),
]


def brute(docs, items, window=10):
    for doc_id, text in docs:
        words, hit, ids = plain_words(text), set(), set()
        for item_id, item in items:
            own = plain_words(item)
            m = min(window, len(own))
            for k in range(len(own) - m + 1 if m else 0):
                for s in range(len(words) - m + 1):
                    if words[s : s + m] == own[k : k + m]:
                        hit.update(range(s, s + m))
                        ids |= {str(item_id)} - {"None"}
        yield doc_id or 0, text or "", len(words), len(hit), len(ids), sorted(ids), bool(hit)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_against_all_windows(spark, block_bytes):
    docs = [(i, t if t is None else t[:3000]) for i, t in ODD]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = dc.decontaminated(table(spark, docs), items, block_bytes=block_bytes).collect()
    rows = [(r.doc_id or 0, r.text or "", r.n_words, r.n_hit, r.n_items, list(r.item_ids), r.contaminated) for r in got]
    assert sorted(rows) == sorted(brute(docs, ITEMS))
    assert sum(r.contaminated for r in got) > 3 and {r.component_id for r in got} == {"mine"}


def test_without_benchmark_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.contaminated for r in dc.decontaminated(table(spark), none).collect()} == {False}
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert dc.decontaminated(table(spark).limit(0), items).collect() == []


def test_search_skips():
    """A text without any word of the windows is looked at once for each window's length."""
    looked = []

    class Words(dict):
        def get(self, key, default=None):
            looked.append(key)
            return super().get(key, default)

    index = dc.index_of([("1", " ".join("p%d" % i for i in range(10)))], 10)
    (search,) = index.searches
    search.words = Words(search.words)
    assert list(search.search([b"w"] * 900)) == [] and len(looked) <= 90
    looked.clear()
    # Words of windows in another order: a block in no window lets it skip nine.
    assert list(search.search([b"p5", b"p5"] * 450)) == [] and len(looked) <= 2 * 101


def test_the_index_is_small():
    rng = random.Random(1)
    names = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(20_000)]
    items = [(str(n), " ".join(rng.choices(names, k=120))) for n in range(2_000)]
    index = dc.index_of(items, 10)
    windows = sum(111 for _ in items)
    assert index.nbytes <= 40 * windows and len(pickle.dumps(index)) <= 60 * windows
    text = [f"x{k}".encode() for k in range(30)] + dc.words_of(items[7][1])[40:60] + [b"x"] * 5
    found = [(start, [index.names[i] for i in ids]) for start, ids in index.searches[0].search(text)]
    assert found == [(30 + k, ["7"]) for k in range(11)]


def test_equal_windows_have_all_their_items():
    index = dc.index_of([("a", "one two three"), ("b", "ONE two, three"), ("a", "one two three"), (None, "one two three")], 10)
    (search,) = index.searches
    ((start, ids),) = search.search(dc.words_of("zero one two three four"))
    assert start == 1 and {index.names[i] for i in ids} == {"a", "b", None} and len(search.starts) == 1
