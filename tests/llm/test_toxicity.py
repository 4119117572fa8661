from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from bootloom.llm import toxicity as tx
from tests.llm.plain import ODD, prose, table

BAD = "grubby wretch vile".split()


def corpus(n=600):
    rows, labels = [], []
    for i in range(n):
        text = prose(i, 60)
        toxic = i % 6 == 0
        if toxic:
            text = text.replace(". ", f" {BAD[i % 3]}. ", 2)
        rows.append((i, text))
        if i // 6 % 2 == 0:
            labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    df = table(spark, rows)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = tx.train(df, known)
    got = {r.doc_id: r for r in tx.scored(df, model).collect()}
    held = [i for i, _ in rows if crc32(str(i).encode()) % 5 == 0]
    right = [got[i].predicted == int(i % 6 == 0) for i in held]
    assert len(held) > 80 and np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    # The labels of held-out rows are not looked at.
    flipped = known.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1).otherwise(F.col("toxic")))
    again = tx.train(df, flipped)
    assert (again.weights == model.weights).all() and again.bias == model.bias


def test_odd_rows_and_labels(spark):
    labels = spark.createDataFrame([(1, None), (None, 1), (4, 0), (4, 1), (99, 1)], "doc_id long, toxic int")
    df = table(spark)
    for known in (labels, labels.limit(0)):
        rows = tx.scored(df, tx.train(df, known)).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows) and {r.n for r in rows} == {1}
        assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    assert tx.scored(df.limit(0), tx.train(df.limit(0), labels)).collect() == []


def test_risk_is_not_negative():
    """Even where the unlabelled are all positive, training does not call positives negative."""
    side = tx.Sparse.of([np.array([3, 5], np.int32)] * 40)
    other = tx.Sparse.of([np.array([3, 5], np.int32)] * 10 + [np.array([7], np.int32)] * 90)
    weights, bias = tx.fit(side, other, 0.1)
    assert weights[3] + weights[5] + bias > 0 > weights[7] + bias


def test_an_id_with_very_many_rows_is_one_text(spark):
    """The sample's bound holds for texts, not only for ids."""
    rows, labels = corpus(60)
    many = [(13, prose(13, 60))] * 3000 + [(19, prose(900 + k, 40)) for k in range(500)]
    df, known = table(spark, rows + many), spark.createDataFrame(labels + [(13, 1), (19, 1)], "doc_id long, toxic int")
    model = tx.train(df, known, positives=4, unlabelled=8)
    assert model.fitted[0] <= 4 and model.fitted[1] <= 8 and sum(model.fitted) >= 8
    assert tx.train(df.repartition(7), known, positives=4, unlabelled=8).bias == model.bias


def words_of(text):
    out, word = set(), ""
    for byte in [*(text or "").encode(), 32]:
        byte += 32 if 65 <= byte <= 90 else 0
        if 48 <= byte <= 57 or 97 <= byte <= 122 or byte >= 128:
            word += chr(byte)
        else:
            out.add(word)
            word = ""
    return {crc32(w.encode("latin-1")) % tx.FEATURES for w in out - {""}}


def brute_model(positive, unlabelled, prior, steps=200, rate=0.05, decay=1e-4):
    """The same risk and the same steps, feature by feature and row by row."""
    n_p, n_u = len(positive), len(unlabelled)
    usable = []
    for f in set().union(*positive):
        seen, other = sum(f in r for r in positive), sum(f in r for r in unlabelled)
        share = (other + 1) / (n_u + 1)
        if seen >= min(3, n_p) and seen / n_p - share >= 4.0 * (share * (1 / n_p + 1 / n_u)) ** 0.5:
            usable.append(f)
    names = [*usable, "bias"]
    w = dict.fromkeys(usable, 0.0) | {"bias": -1.0}
    m, v = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0)
    called = lambda r: 1 / (1 + np.exp(-(sum(w[f] for f in usable if f in r) + w["bias"])))
    for step in range(1, steps + 1):
        s_p, s_u = [called(r) for r in positive], [called(r) for r in unlabelled]
        risk = sum(-np.log(1 - s) for s in s_u) / n_u - prior * sum(-np.log(1 - s) for s in s_p) / n_p
        if risk >= 0:
            each = [-prior * (1 - s) / n_p - prior * s / n_p for s in s_p] + [s / n_u for s in s_u]
        else:
            each = [prior * s / n_p for s in s_p] + [-s / n_u for s in s_u]
        for f in names:
            slope = sum(e for e, r in zip(each, positive + unlabelled) if f == "bias" or f in r)
            slope += 0 if f == "bias" else decay * w[f]
            m[f], v[f] = 0.9 * m[f] + 0.1 * slope, 0.999 * v[f] + 0.001 * slope**2
        for f in names:
            w[f] -= rate * m[f] / (1 - 0.9**step) / ((v[f] / (1 - 0.999**step)) ** 0.5 + 1e-8)
    return w


def test_scores_against_a_plain_loop(spark):
    rows, labels = corpus(120)
    df = table(spark, rows)
    toxic = {i for i, t in labels if t}
    learned = [(i, t) for i, t in rows if crc32(str(i).encode()) % 5]
    known = [t for i, t in labels if crc32(str(i).encode()) % 5]
    w = brute_model([words_of(t) for i, t in learned if i in toxic], [words_of(t) for _, t in learned], sum(known) / len(known))
    assert len(w) > 1
    model = tx.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    text = dict(rows)
    for r in tx.scored(df, model).collect():
        z = sum(w.get(f, 0.0) for f in words_of(text[r.doc_id])) + w["bias"]
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-6
