import hashlib
import math
from collections import Counter

import pytest

from bootloom.llm import fingerprints as fp
from tests.llm.plain import ODD, plain_words, prose, table


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def brute(docs, order):
    df = Counter(w for _, t in docs for w in set(plain_words(t)))
    known = {w for w, n in df.items() if fp.LEAST_IDF <= math.log(len(docs) / n) <= fp.MOST_IDF}
    shares = [s for s in fp.SHARES for _ in range(fp.SUBSETS)]

    def prints(text):
        words = set(plain_words(text))
        out = []
        for i, share in enumerate(shares):
            own = [w for w in words & known if int(md5(f"{w} {i // 8}")[4 * (i % 8) :][:4], 16) < int(share * 65536)]
            out.append(md5(" ".join(sorted(own)))[:16] if own else "")
        return [*out, "" if any(out) else md5(" ".join(sorted(words)))]

    def like(a, b):
        asked = [(x, y) for x, y in zip(a, b) if x or y]
        return 1.0 if a == b else sum(x == y for x, y in asked) / len(asked) if asked else 0.0

    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        part = len(text) // 4
        edited = text[: len(text) - part] + after[:part]
        own, new, other = prints(text), prints(edited), prints(after)
        sha = hashlib.sha256(edited.encode()).hexdigest()
        yield i, len(text), sha, "-".join(own), "-".join(new), like(own, new), like(own, other)


@pytest.mark.parametrize("partitions", [1, 5])
def test_against_plain_loops(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        docs = [d for d in ODD if d[0] not in (None, 12)] + [(20 + i, prose(i // 2, 30 + i)) for i in range(30)]
        got = [tuple(r) for r in fp.fingerprints(table(spark, docs)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert sorted(got) == sorted(brute(docs, sorted(docs)))


def test_null_and_repeated_ids(spark):
    got = fp.fingerprints(table(spark)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in ODD)
    by_text = {}
    for row in got:
        by_text.setdefault((row.doc_id, row.n_chars), set()).add(row.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    assert fp.fingerprints(table(spark).limit(0)).collect() == []
    assert [r.near_next for r in fp.fingerprints(table(spark, [(1, "only one")])).collect()] == [1.0]


def test_shuffled_lexicon_gives_the_same(spark, monkeypatch):
    one = sorted(tuple(r) for r in fp.fingerprints(table(spark, [d for d in ODD if d[0] not in (None, 12)])).collect())
    monkeypatch.setattr(fp, "BROADCAST_TERMS", 0)
    two = sorted(tuple(r) for r in fp.fingerprints(table(spark, [d for d in ODD if d[0] not in (None, 12)])).collect())
    assert one == two


def test_no_python_in_the_plan(spark):
    df = fp.fingerprints(table(spark))
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def test_documents_without_an_id_are_in_many_ranges(spark):
    docs = [(None, f"text {k}") for k in range(300)] + [(7, f"other {k}") for k in range(60)] + [(k, "x") for k in range(8, 48)]
    got = fp.with_next(table(spark, docs)).where("not _extra").groupBy("_bucket").count().collect()
    assert sum(r["count"] for r in got) == 400 and max(r["count"] for r in got) <= 130
    follows = Counter(r.next for r in fp.with_next(table(spark, docs)).where("not _extra and next <> ''").collect())
    assert follows["x"] == 40 and sum(n for t, n in follows.items() if t.startswith("text")) == 300
