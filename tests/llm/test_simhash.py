import random

import pytest
import xxhash

from bootloom.llm import simhash as sh
from bootloom.llm.components import components
from tests.llm.plain import ODD, broadcast_part, prose, spaced_words, table, unions


def brute_print(text):
    words = spaced_words(text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def rows_of(docs):
    prints = [(i, brute_print(t)) for i, t in docs]
    distinct = {p for _, p in prints}
    roots = unions(distinct, [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 4])
    least = {}
    for i, p in prints:
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    return sorted(((i, f"{p:016x}", least.get(roots[p])) for i, p in prints), key=str)


@pytest.mark.parametrize("crowd", [512, 2])
def test_against_all_pairs(spark, crowd):
    docs = ODD + [(200 + i, " ".join(["kala"] * i + ["miru"] * (30 - i))) for i in range(30)]
    docs += [(300 + i, prose(1, 120)[: -3 * i]) for i in range(12)]
    got = sh.near_duplicates(table(spark, docs), crowd=crowd).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == rows_of(docs)
    stay = {(r.doc_id, r._kt) for r in got if r.stays}
    groups = {(r.component_id, r.fingerprint if r.component_id is None else "") for r in got}
    assert len(stay) == len(groups)


@pytest.mark.parametrize("crowd", [512, 1])
def test_links_of_random_neighbours(spark, crowd):
    """All fingerprints within 4 bits of a few centres, wherever the bits fall."""
    rng = random.Random(3)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(14):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    df = spark.createDataFrame([(sh.signed(p),) for p in prints], "fp long")
    linked = [(r.u, r.v) for r in sh.links(df, crowd=crowd).collect()]
    nodes = {sh.signed(p) for p in prints}
    near = [(a, b) for a in nodes for b in nodes if a < b and (a ^ b & (1 << 64) - 1).bit_count() >= 0 and bin((a ^ b) & (1 << 64) - 1).count("1") <= 4]
    assert unions(nodes, linked) == unions(nodes, near)
    if crowd == 512:
        assert {tuple(sorted(p)) for p in linked} == {tuple(sorted(p)) for p in near}


def test_long_chains_are_one_component(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1005), (1005, 1000), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1005: 1000}


def test_one_of_each_stays(spark):
    kept = sh.without_near_duplicates(table(spark)).collect()
    ids = [r.doc_id for r in kept]
    assert 1 in ids and 5 not in ids and ids.count(12) == 2 and {r.component_id for r in kept} == {"mine"}
    assert sh.without_near_duplicates(table(spark).limit(0)).collect() == []


def test_ring_budgets():
    ring = sh.Ring()
    assert [ring.budget(n) for n in range(1, 6)] == [0, 1, 2, 3, 4]
    assert sum(w for _, w in ring.bounds) == 64
    rng = random.Random(1)
    for _ in range(500):
        bits = rng.sample(range(64), rng.randint(0, 4))
        segments = [sum(low <= b < low + w for b in bits) for low, w in ring.bounds]
        assert any(all(sum(segments[(s + k) % 5] for k in range(n)) <= ring.budget(n) for n in range(1, 6)) for s in range(5))


@pytest.mark.parametrize("crowd", [512, 1])
def test_looked_up_chains_are_not_broadcast(spark, crowd, tmp_path):
    """A small table of fingerprints has 70 lookups for each, or 2,081 points, and Spark sizes both like the table."""
    rng = random.Random(7)
    spark.createDataFrame([(sh.signed(rng.getrandbits(64)),) for _ in range(3000)], "fp long").write.parquet(f"{tmp_path}/fp")
    plan = sh.links(spark.read.parquet(f"{tmp_path}/fp"), crowd=crowd)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "Generate" not in broadcast_part(plan)
