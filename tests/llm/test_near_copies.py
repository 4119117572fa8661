import random

import numpy as np

import corpus_pipeline
from bootloom.llm import components as components_module
from bootloom.llm import near_copies as nc
from bootloom.llm import simhash
from bootloom.llm.common import KEY, marked, with_key
from bootloom.operators.lineage import settle
from tests.llm.plain import ODD, broadcast_part, prose, spaced_words, table, unions

ABC = "kala miru tofe sund ralo bine vost yuki del an zo".split()


def shingle_set(text):
    words = spaced_words(text)
    run = min(5, len(words))
    return {tuple(words[i : i + run]) for i in range(len(words) - run + 1)} if words else set()


def edited(text, *places):
    """The text with other words at these places."""
    words = text.split()
    for k in places:
        words[k] = f"w{k}"
    return " ".join(words)


def brute(docs):
    """(id, smallest id of the component) by comparing all pairs."""
    sets = [shingle_set(t) for _, t in docs]
    pairs = []
    for a in range(len(docs)):
        for b in range(a):
            together = len(sets[a] | sets[b])
            if not together or 5 * len(sets[a] & sets[b]) >= 4 * together:
                pairs.append((a, b))
    roots = unions(range(len(docs)), pairs)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[roots[k]] = min(i, least.get(roots[k], i))
    return sorted(((i, least.get(roots[k])) for k, (i, _) in enumerate(docs)), key=str)


def noise(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=4)) for _ in range(n))


NEAR = [(500 + i, edited(noise(1, 150), *random.Random(i).sample(range(150), i % 6))) for i in range(40)]
NEAR += [(600 + i, noise(2, 200 - 12 * i)) for i in range(10)] + [(700, noise(3, 300)), (701, edited(noise(3, 300), 9, 99, 199, 299))]


def test_against_all_pairs(spark):
    docs = ODD + NEAR + [(200 + i, " ".join(ABC[: i % 7])) for i in range(9)]
    got = nc.near_copies(table(spark, docs)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == brute(docs)


def test_the_order_of_lookups_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(nc, "SAMPLE", 1)
    monkeypatch.setattr(nc, "COMMON", 2)
    docs = ODD + NEAR
    got = nc.near_copies(table(spark, docs)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == brute(docs)


def test_the_stage_takes_edited_copies(spark):
    """Two words of 200 changed: 10 of 196 shingles differ, and SimHash is 4 bits apart or more for most."""
    docs = [(1000 * i + k, edited(noise(i, 200), *range(40 * k, 200, 120)[: 2 * k])) for i in range(1, 13) for k in (0, 1)]
    kept = corpus_pipeline.one_of_each(spark, table(spark, docs), "").collect()
    assert sorted(r.doc_id for r in kept) == [1000 * i for i in range(1, 13)]
    assert corpus_pipeline.one_of_each(spark, table(spark).limit(0), "").collect() == []


def test_the_stage_runs_simhash(spark, monkeypatch):
    """Pigeonring gets the fingerprints of sets that meet others, with the stage's ring."""
    asked, links = [], simhash.links

    def seen(prints, ring, *args):
        asked.append((prints.count(), ring))
        return links(prints, ring, *args)

    monkeypatch.setattr(nc, "links", seen)
    docs = NEAR + [(900, noise(9, 60))]
    corpus_pipeline.one_of_each(spark, table(spark, docs), "").collect()
    assert asked == [(len({nc.shingles(t.encode()).tobytes() for _, t in NEAR}), simhash.Ring(4, 5))]


def test_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(1)
    base = rng.integers(-(1 << 62), 1 << 62, 300)
    for lost in range(0, 300, 7):
        other = np.concatenate([base[lost:], rng.integers(-(1 << 62), 1 << 62, lost // 2)])
        apart = sum(int(x).bit_count() for x in (nc.sketch(base) ^ nc.sketch(other)).view(np.uint64))
        assert (apart > 0) == (lost > 0) and apart <= lost + lost // 2
    assert not nc.sketch(base[:0]).any()


def test_a_crowd_that_is_not_linked_is_told_by_sketches(spark, monkeypatch):
    """Copies with edits of their own are further apart than they are from the text: few pairs are compared in full."""
    crowd = [(i, edited(noise(5, 120), *[(7 * i + 23 * k) % 116 + 2 for k in range(4)])) for i in range(60)]
    compared, settle = [], nc.settle

    def counted(df):
        kept = settle(df)
        if kept.columns == ["u", "v"]:
            compared.append(kept.count())
        return kept

    monkeypatch.setattr(nc, "settle", counted)
    got = nc.near_copies(table(spark, crowd)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == brute(crowd)
    assert max(compared) < 60 * 59 / 8


def test_a_crowd_of_edited_copies_is_tied_by_few_comparisons(spark, monkeypatch):
    """Many copies link with many others, but not with the text they come from: it takes no square of them to tie them."""
    n, compared, settle = 320, [], nc.settle
    rng = random.Random(4)
    crowd = [(i, edited(noise(8, 160), *rng.sample(range(2, 150), rng.choice((1, 2))))) for i in range(n)]

    def counted(df):
        kept = settle(df)
        if kept.columns == ["u", "v"]:
            compared.append(kept.count())
        return kept

    monkeypatch.setattr(nc, "settle", counted)
    monkeypatch.setattr(nc, "_simhash_pairs", lambda prints, ring: spark.createDataFrame([], "u long, v long"))
    got = nc.near_copies(table(spark, crowd)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == brute(crowd)
    assert sum(compared) < n * n / 4, compared


def test_long_texts_that_only_share_passages_are_not_fetched(spark, monkeypatch):
    """Short sketches tell nothing of sets of many hundred shingles; whole ones do, so these texts are not read again."""
    passage, fetched, settle = noise(10, 60), [], nc.settle
    long = [(i, f"{noise(100 + i, 900)} {passage}") for i in range(40)] + [(40, edited(noise(100, 900), 300) + " " + passage)]

    def counted(df):
        kept = settle(df)
        if kept.columns == ["s", "all"]:
            fetched.append(kept.count())
        return kept

    monkeypatch.setattr(nc, "settle", counted)
    got = nc.near_copies(table(spark, long)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == brute(long)
    assert sum(fetched) == 2, fetched


def test_whole_sketches_keep_every_near_copy(spark):
    """Also where one of two sets has a sketch of twice the length, and with the least similarity there may be."""
    rng, sets, near, far = np.random.default_rng(2), [], [], []
    for n in (1, 5, 255, 256, 257, 300, 512, 513, 600, 1024, 1025, 1200, 2049):
        base = rng.integers(-(1 << 62), 1 << 62, 2 * n)
        lost = n // 5
        for own in (base[:n], base[lost:n], np.concatenate([base[lost // 2 : n], base[n : n + lost // 2]]), base[n:]):
            sets.append((len(sets), len(own), nc.whole_sketch(own).tolist()))
        u = len(sets) - 4
        near += [(u, u), (u + 1, u), (u, u + 1)] + [(u + 2, u)] * (lost == 0)
        far += [(u + 3, u)] * (n >= 255)
    frame = spark.createDataFrame(sets, "s long, n int, k array<long>")
    pairs = spark.createDataFrame(near + far, "u long, v long")
    got = {(r.u, r.v) for r in nc._wholly_near_enough(pairs, frame, 0.8).collect()}
    assert set(near) <= got and not set(far) & got
    folded = frame.select("s", *[nc._short("k", i) for i in range(nc.SKETCH)]).collect()
    assert all(list(r[1:]) == np.bitwise_xor.reduce(np.reshape(sets[r.s][2], (-1, nc.SKETCH))).tolist() for r in folded)


def test_most_texts_are_not_shuffled(spark):
    """Documents whose key is asked for are marked, null and repeated ones too, and few others."""
    docs = with_key(table(spark, ODD + ODD + [(5000 + i, f"text {i}") for i in range(2000)]))
    for wanted in (docs.where("doc_id is null or doc_id % 50 = 0"), docs.limit(0)):
        keys = wanted.select(*KEY).distinct()
        expected = docs.join(keys, KEY, "left_semi").count()
        told = marked(docs, keys)
        assert told.where("_marked").join(keys, KEY, "left_semi").count() == expected
        assert told.count() == docs.count() and told.where("_marked").count() <= expected + 20
        assert marked(docs, keys, 1).where("_marked").join(keys, KEY, "left_semi").count() == expected


def test_no_lookups_of_the_stage_are_broadcast(spark, tmp_path, monkeypatch):
    """What an explode makes is larger than Spark takes it for, also its distinct rows: plans of all that is written."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df)

    for module in (nc, simhash, components_module):
        monkeypatch.setattr(module, "settle", seen)
    table(spark, ODD + NEAR).write.parquet(f"{tmp_path}/docs")
    nc.near_copies(spark.read.parquet(f"{tmp_path}/docs"), ring=simhash.Ring(most=4, segments=5)).collect()
    assert sum("Generate" in p for p in plans) > 2
    assert not [p for p in plans if "Generate" in broadcast_part(p)]
