import math
from collections import Counter
from pathlib import Path
from urllib.parse import unquote
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from bootloom.llm import language_model as lm
from bootloom.operators.lineage import settle
from tests.llm.plain import ODD, prose, spaced_words, table


@pytest.fixture(scope="module")
def docs():
    return ODD + [(100 + i, prose(i, 150)) for i in range(40)]


def tokens(text):
    return [*spaced_words(text), "\n"]


def learned(doc_id):
    return doc_id is None or crc32(str(doc_id).encode()) % 7 != 2


def test_base_scores_and_both_ways(spark, docs):
    df = table(spark, docs)
    model = lm.train(df.where(lm.learned_from(F.col("doc_id"))))
    counts = Counter(t for i, text in docs if learned(i) for t in tokens(text))
    total = sum(counts.values())
    assert (model.n_tokens, model.n_types) == (total, len(counts))
    for limit in (lm.BROADCAST_BYTES, 0):
        got = lm.scored(df, model, broadcast_bytes=limit).collect()
        assert len(got) == len(docs)
        for row in got:
            words = tokens(row.text)
            base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in words)
            assert (row.n_tokens, row.n_known) == (len(words), sum(counts[w] > 0 for w in words))
            assert row.base_score == pytest.approx(base) and row.score < 0
            assert row.component_id == "mine"
    near = {(r.doc_id, r.text): r.score for r in lm.scored(df, model).collect()}
    far = {(r.doc_id, r.text): r.score for r in lm.scored(df, model, broadcast_bytes=0).collect()}
    assert near.keys() == far.keys() and all(near[k] == pytest.approx(far[k]) for k in near)


def test_held_out_text_is_likelier_with_pairs(spark, docs):
    df = table(spark, docs)
    model = lm.train(df.where(lm.learned_from(F.col("doc_id"))))
    rows = [r for r in lm.scored(df, model).collect() if not learned(r.doc_id)]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_filter_never_misses_a_level():
    rng = np.random.default_rng(1)
    names = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    counts = rng.integers(1, 5000, 3000)
    block = lm.filter_block(names, counts)
    found = lm.probe_levels(names, np.zeros(3000, np.int64), block)
    levels = lm.levels_of(names, counts)
    assert (found >= levels).all() and (found > levels).mean() < 0.02
    middle = lm.expected(names, levels)[levels > 0]
    assert (middle / counts[levels > 0] > 0.5).all() and (middle / counts[levels > 0] <= 1.5).all()
    strange = rng.integers(0, 1 << 62, 20000).astype(np.uint64)
    assert (lm.probe_levels(strange, np.zeros(20000, np.int64), block) > 0).mean() < 0.02


def test_exact_counts():
    names = np.array([9, 4, 7, 2], np.uint64)
    exact = lm.ExactCounts(names, np.array([1, 255, 70_000, 254]))
    assert list(exact.of(np.array([2, 3, 4, 7, 9, 11], np.uint64))) == [254, 0, 255, 70_000, 1, 0]
    assert list(lm.ExactCounts(names[:0], np.zeros(0, np.int64)).of(names)) == [0, 0, 0, 0]


def test_probabilities_sum_to_at_most_one():
    """Over all next words of a history, from counts as the filter gives them exactly."""
    pair = np.array([4.0, 2.0, 2.0, 0.0])
    word = np.array([9.0, 5.0, 4.0, 2.0])
    assert lm._probability(word, np.full(4, 8.0), pair, 20 + 4 + 1.0).sum() <= 1
    assert lm._probability(word, np.zeros(4), pair * 0, 20 + 4 + 1.0).sum() <= 1


def test_nothing_to_learn_from(spark):
    df = table(spark)
    model = lm.train(df.limit(0))
    for limit in (lm.BROADCAST_BYTES, 0):
        rows = lm.scored(df, model, broadcast_bytes=limit).collect()
        assert {r.n_known for r in rows} == {0} and all(r.base_score == 0 for r in rows)
    assert lm.scored(df.limit(0), model).collect() == []


def test_a_pair_that_occurs_once_counts(spark):
    """Every pair of the only text occurs once; in its order each token has 1 of 1 after its history."""
    words = [f"w{i}" for i in range(60)]
    df = table(spark, [(1, " ".join(words)), (2, " ".join(reversed(words)))])
    model = lm.train(df.where("doc_id = 1"))
    for limit in (lm.BROADCAST_BYTES, 0):
        got = {r.doc_id: r.score for r in lm.scored(df, model, broadcast_bytes=limit).collect()}
        assert got[1] == pytest.approx(61 * math.log10(0.25 + 0.75 * 2 / (61 + 61 + 1)))
        assert got[1] > got[2] + 20


def test_scores_against_a_plain_loop(spark, docs):
    """From dictionaries of counts, rounded as the filter rounds them; the filter is nearly empty, so it has no false levels."""
    df = table(spark, docs)
    model = lm.train(df.where(lm.learned_from(F.col("doc_id"))))
    words, pairs = Counter(), Counter()
    for i, text in docs:
        if learned(i):
            own = tokens(text)
            words.update(own)
            pairs.update(zip(["<text>", *own], own))
    total = sum(words.values()) + len(words) + 1

    def rounded(n):
        level = n.bit_length()
        return (3 * 2 ** (level - 1) - 1) / 2 if n else 0.0

    for row in lm.scored(df, model).collect():
        own, score = tokens(row.text), 0.0
        for before, word in zip(["<text>", *own], own):
            history = rounded(words["\n" if before == "<text>" else before])
            seen = min(rounded(pairs[before, word]), history) / max(history, 1)
            weight = 0.25 if history else 0.0
            score += math.log10(weight * seen + (1 - weight) * (rounded(words[word]) + 1) / total)
        assert row.score == pytest.approx(score, rel=1e-9), row.doc_id


@pytest.mark.parametrize("n_blocks", [1, 7, 8, 761, 9_000, 3_000_000])
def test_names_of_a_group_come_back(n_blocks):
    rng = np.random.default_rng(n_blocks)
    names = np.unique(np.concatenate([rng.integers(0, 1 << 64, 5000, np.uint64), np.array([0, 1, (1 << 64) - 1], np.uint64)]))
    groups = lm.Groups.of(n_blocks)
    assert -(-n_blocks // groups.each) <= lm.GROUPS
    order, found, starts = groups.parts(names)
    assert sorted(order) == list(range(len(names))) and len(found) + 1 == len(starts)
    for group, a, b in zip(found, starts, starts[1:]):
        own = names[order[a:b]]
        assert set(lm.blocks_of(own, n_blocks) // groups.each) == {group}
        short = groups.short(own)
        assert (np.diff(short.astype(object)) > 0).all()
        steps = np.diff(short, prepend=np.uint64(0))
        back = lm._unpacked(lm._packed(lm._planes(steps, lm._width(steps))))
        assert (groups.long(np.cumsum(back, dtype=np.uint64), int(group)) == own).all()


def test_both_ways_over_many_blocks_and_chunks(spark):
    """Words that occur over 255 times, too, and rows that come twice; the same sums in the same order."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)} v{rng.integers(1 << 14)}" for x in rng.pareto(0.6, 2000).clip(0, 1e12)) for _ in range(60)]
    df = table(spark, [(i % 50, t) for i, t in enumerate(texts)] + [(1, texts[1])] * 2).repartition(4).cache()
    model = lm.train(df)
    assert model.n_blocks > 1
    rows = [
        sorted(map(tuple, lm.scored(df, model, broadcast_bytes=limit).select("doc_id", "n_tokens", "n_known", "base_score", "score").collect()))
        for limit in (lm.BROADCAST_BYTES, 0)
    ]
    assert rows[0] == rows[1] and len(rows[0]) == 62


def test_disk_is_in_proportion_to_the_tokens(spark, monkeypatch):
    """Without a broadcast some 10 bytes a token are written and shuffled at a time, not several rows; and what was shuffled goes."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{int(x)}" for x in rng.pareto(0.6, 3000).clip(0, 1e6)) for _ in range(100)]
    df = table(spark, list(enumerate(texts))).repartition(4).cache()
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def on_disk():
        files = manager.getAllFiles()
        return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))

    written = []

    def seen(df):
        out = settle(df)
        files = [Path(unquote(f.removeprefix("file://"))) for f in out.inputFiles()]
        written.append(sum(f.stat().st_size for f in files))
        return out

    df.count()
    spark._jvm.System.gc()
    before = on_disk()
    monkeypatch.setattr(lm, "settle", seen)
    model = lm.train(df)
    assert on_disk() - before < 100_000
    written.clear()
    lm.scored(df, model, broadcast_bytes=0)
    assert on_disk() - before < 100_000
    # Chunks and answers; distinct words are many here.
    assert sum(written) < 10 * model.n_tokens
