import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from bootloom.llm import filter_audit as fa
from tests.llm.plain import ODD, prose

DOCS = [(i, t, f"s{(i or 0) % 3}") for i, t in ODD]
DOCS += [(30, "", None), (31, "", ""), (32, "CAPITALS " * 60, "s0"), (33, "a $ b " * 60, "s1"), (34, "a $ b " * 60, "s2")]
DOCS += [(33, "a $ b " * 60, "s1"), (35, prose(40, 200), "s9"), (36, "ÀÉ ÜX " * 30, "s9"), (37, "x" * 40 + "AAAA", "s9")]
LABELS = [(1, 1, 0), (5, 1, 1), (5, 0, 0), (33, 0, 1), (35, None, 1), (None, 1, 1), (999, 1, 1), (34, 1, None)]


def fails(doc, docs):
    """The letters of the filters that a document fails."""
    doc_id, text, _ = doc
    text = text or ""
    words = "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ")
    words = [w for w in words if w]
    found = set()
    if len(words) < 50:
        found.add("A")
    if 100 * len(set(words)) < 65 * len(words):
        found.add("B")
    if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text):
        found.add("C")
    if any(c in text for c in "#$%&*|"):
        found.add("D")
    for other_id, other, _ in docs:
        if (other or "") == text and other_id is not None and (doc_id is None or other_id < doc_id):
            found.add("E")
    return found


def brute(docs, labels):
    """Apply every order, document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = []
    for part in {s or "" for _, _, s in docs}:
        own = [(d, fails(d, docs)) for d in docs if (d[2] or "") == part]
        rows, shapley = [], Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                removed = [d for d, f in left if letter in f]
                before = len(left)
                left = [(d, f) for d, f in left if letter not in f]
                shapley[letter] += before - len(left)
                redundant = sum(letter in f for _, f in own) - len(removed)
                unique = sum(f == {letter} for _, f in own)
                lost = [sum(d[0] in kind for d in removed) for kind in (good, toxic)]
                rows.append((part, "".join(order), step, len(left), len(removed), redundant, unique, *lost, letter))
        out += [(*r[:-1], shapley[r[-1]]) for r in rows]
    return sorted(out)


def tables(spark, docs, labels):
    wide = [(i, t, s, 1, "x", 2.0) for i, t, s in docs]
    named = "doc_id long, text string, source string, mask int, part string, kept double"
    return (
        spark.createDataFrame(wide, named).repartition(3),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_against_applying_every_order(spark):
    got = sorted(tuple(r) for r in fa.filter_audit(*tables(spark, DOCS, LABELS)).collect())
    want = brute(DOCS, LABELS)
    assert len(want) == 600 * 5 and got == want


def test_other_names_and_no_labels(spark):
    docs, labels = tables(spark, DOCS[:6], [])
    docs = docs.withColumnsRenamed({"text": "t", "doc_id": "i", "source": "s"})
    got = fa.filter_audit(docs, labels.withColumnRenamed("doc_id", "i"), text="t", doc_id="i", source="s").collect()
    assert sorted(tuple(r) for r in got) == brute(DOCS[:6], [])


def test_nothing(spark):
    docs, labels = tables(spark, DOCS[:1], LABELS)
    assert fa.filter_audit(docs.limit(0), labels).collect() == []


def test_intervals_of_ranks():
    """Each step's beginnings cover every rank once, and name the orders in lexicographic order."""
    orders = list(permutations(range(5)))
    seen = np.zeros((5, 120), int)
    for begin, start, stop in fa._prefixes(5):
        seen[len(begin) - 1, start:stop] += 1
        assert all(o[: len(begin)] == begin for o in orders[start:stop])
    assert (seen == 1).all()


@pytest.mark.parametrize("seed", range(3))
def test_counts_of_random_masks(seed):
    rng = random.Random(seed)
    counts = np.array([[rng.randint(0, 9)] * 3 for _ in range(32)], np.int64)
    steps, orders = fa.audit_counts(counts)
    for rank in rng.sample(range(120), 10):
        gone = 0
        for step, f in enumerate(orders[rank]):
            removed = sum(int(counts[m, 0]) for m in range(32) if m >> f & 1 and not m & gone)
            assert steps[rank, step, fa.RESULTS.index("removed")] == removed
            gone |= 1 << int(f)
