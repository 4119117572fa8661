import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from bootloom.llm import mixing as mx
from tests.llm.plain import ODD, prose

DOCS = [(i, t, f"s{(i or 0) % 3}") for i, t in ODD]
DOCS += [(100 + i, prose(i, 5 + 7 * i % 90), ["a", None, "", "é", "𝄞", "￿"][i % 6]) for i in range(240)]
DOCS += [(50, "", "empty"), (51, None, "empty"), (60, "one", "single"), (None, "two words", None)] + [(61, "b c", "a")] * 5


def size(text):
    return len([w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w])


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Share out, stop those above, share the excess again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    stopped, left = {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in stopped]
        total = sum(weight[s] for s in free)
        shared = {s: left * weight[s] / total for s in free}
        above = [s for s in free if shared[s] > most * sizes[s]]
        if not above:
            return stopped | shared
        for s in above:
            stopped[s] = most * sizes[s]
            left -= stopped[s]


def brute(docs, seed=0):
    """(id, source, size, target, copies) by walking along each source."""
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + size(t)
    wanted, out = brute_targets(sizes), []
    for s, target in wanted.items():
        own = sorted((size(t), i is not None, i or 0, i) for i, t, name in docs if name == s)
        walk = own[::2] + own[1::2][::-1]
        name = "t" if s is None else "s" + s
        reached = (int(hashlib.md5(f"{seed}:{name}".encode()).hexdigest()[:6], 16)) << 2
        rate = round(target / sizes[s] * 2**26) if sizes[s] else 0
        for n, _, _, i in walk:
            after = reached + rate
            out.append((i, s, n, pytest.approx(target), (after >> 26) - (reached >> 26)))
            reached = after
    return out


def key(row):
    return (str(row[1]), row[2], str(row[0]), row[4])


def table(spark, docs):
    wide = [(i, t, s, 1, "x", 2.0) for i, t, s in docs]
    named = "doc_id long, text string, source string, size int, target string, n_copies double"
    return spark.createDataFrame(wide, named).repartition(3)


def test_against_walking_along_each_source(spark):
    got = mx.copies(table(spark, DOCS)).collect()
    rows = sorted(((r.doc_id, r.source, r["size"], r.target, r.n_copies) for r in got), key=key)
    assert rows == sorted(brute(DOCS), key=key)


def test_totals_come_near_their_targets(spark):
    docs = [(i, "w " * (1 + i * i % 301), f"s{i % 4}" if i % 3 else "hot") for i in range(3000)]
    got = mx.copies(table(spark, docs)).groupBy("source").agg(
        F.sum(F.col("n_copies") * F.col("size")).alias("taken"), F.max("target").alias("target"), F.max("n_copies").alias("most")
    )
    for r in got.collect():
        assert abs(r.taken - r.target) <= 301 and r.most <= 2


def test_reruns_agree_however_the_rows_are_dealt(spark):
    one, other = (
        sorted(mx.copies(table(spark, DOCS).repartition(n)).collect(), key=str) for n in (1, 7)
    )
    assert one == other
    moved = mx.copies(table(spark, DOCS), seed=1).collect()
    assert sorted(moved, key=str) != one


def test_the_mix_has_whole_rows(spark):
    docs = table(spark, DOCS)
    counted = mx.copies(docs).collect()
    got = mx.mixed(docs).collect()
    assert got[0].asDict().keys() == {*docs.columns, "copy"} and {r.target for r in got} == {"x"}
    words = sum(r.n_copies * r["size"] for r in counted)
    assert len(got) == sum(r.n_copies for r in counted) and sum(size(r.text) for r in got) == words
    assert {(r.doc_id, r.copy) for r in got if r.doc_id == 60} <= {(60, 1), (60, 2)}


def test_many_sources(spark):
    """As many sources as documents: targets are shared out without one task for all."""
    docs = [(i, "w " * (i % 17), f"n{i:05}") for i in range(500)]
    got = mx.copies(table(spark, docs)).collect()
    want = brute_targets({s: size(t) for _, t, s in docs})
    assert all(math.isclose(r.target, want[r.source], abs_tol=1e-9) for r in got)


def test_nothing(spark):
    assert mx.copies(table(spark, DOCS).limit(0)).collect() == [] and mx.mixed(table(spark, DOCS).limit(0)).collect() == []
    assert [r.n_copies for r in mx.copies(table(spark, [(1, None, None)])).collect()] == [0]
