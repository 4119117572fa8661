import random

from bootloom.llm import spans as sp
from tests.llm.plain import ODD, PASSAGE, plain_words, prose, table


def brute(docs):
    """Remove by comparing runs of sentences themselves, document by document in order."""
    key = lambda d: (d[0] is None, d[0] or 0)
    first, out = {}, []
    texts = [(i, (t or "").encode()) for i, t in docs]
    for doc_id, text in sorted(texts, key=key):
        parts = [s.strip().lower() for s, _ in sp.sentences(text)]
        for at, n, _ in sp.runs(text):
            first.setdefault(tuple(parts[at : at + n]), (doc_id, text, at))
    for doc_id, text in texts:
        parts = [s for s, _ in sp.sentences(text)]
        gone = set()
        for at, n, _ in sp.runs(text):
            if first[tuple(s.strip().lower() for s in parts[at : at + n])] != (doc_id, text, at):
                gone.update(range(at, at + n))
        out.append((b"".join(s for k, s in enumerate(parts) if k not in gone).decode(), len(parts), len(gone)))
    return out


def test_against_comparing_sentences(spark):
    docs = [d for d in ODD if d[0] is not None] + [(400, PASSAGE + PASSAGE)]
    got = sp.without_repeats(table(spark, docs)).collect()
    assert sorted((r.text or "", r.n_sentences, r.n_removed) for r in got) == sorted(brute(docs))
    assert {r.component_id for r in got} == {"mine"} and [r.text for r in got if r.doc_id == 2] == [None]


def test_passages_go_and_the_rest_stays(spark):
    docs = [(i, prose(i + 50, 100) + "\n" + PASSAGE + "\n" + prose(i + 80, 100)) for i in range(6)] + [(9, prose(7, 400))]
    got = {r.doc_id: r.text for r in sp.without_repeats(table(spark, docs)).collect()}
    middle = " ".join(plain_words(PASSAGE))
    for i, text in docs:
        words = " ".join(plain_words(got[i]))
        if i in (0, 9):
            assert got[i] == text
        else:
            assert middle not in words and got[i].startswith(prose(i + 50, 100)) and got[i].endswith(prose(i + 80, 100))


def test_runs_cover_a_long_passage():
    """Any passage of over 50 words that begins and ends with sentences is covered, whatever its sentences are."""
    for text in (PASSAGE, "a " * 51, "one. " * 51, ("word " * 30 + ". ") * 2, "x, " * 60, "long " * 49 + ". end. now."):
        parts = list(sp.sentences(text.encode()))
        assert b"".join(s for s, _ in parts).decode() == text
        covered = set()
        for at, n, _ in sp.runs(text.encode()):
            covered.update(range(at, at + n))
        assert covered == set(range(len(parts)))


def test_nothing(spark):
    assert sp.without_repeats(table(spark).limit(0)).collect() == []
    assert sp.runs(None) == [] and sp.runs(b"") == [] and sp.without(None, []) == (None, 0)


def letters(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=4)) for _ in range(n))


def test_a_passage_inside_long_sentences_goes_whatever_stands_before(spark):
    rng = random.Random(5)
    passage = letters(rng, 60)
    docs = [(i, f"{letters(rng, n)} {passage} {letters(rng, n)}") for i, n in enumerate((5, 9, 16, 2))]
    got = {r.doc_id: r.text.split() for r in sp.without_repeats(table(spark, docs)).collect()}
    words = passage.split()
    assert " ".join(got[0]) == docs[0][1]
    for i in (1, 2, 3):
        left = " ".join(got[i])
        assert not any(" ".join(words[k : k + 51]) in left for k in range(10)) and got[i][0] == docs[i][1].split()[0]


def test_any_51_words_of_a_long_sentence_share_a_run():
    rng = random.Random(6)
    for k in range(300):
        passage = letters(rng, 51) if k % 3 else " ".join(rng.choices(["ab", "cd", "ef"], k=51))
        both = [f"{letters(rng, rng.randint(0, 40))} {passage} {letters(rng, rng.randint(0, 40))}" for _ in range(2)]
        one, other = ({h for _, _, h in sp.runs(t.encode())} for t in both)
        assert one & other
    parts = list(sp.sentences(("  " + passage + "\t").encode()))
    assert b"".join(s for s, _ in parts).decode() == "  " + passage + "\t" and sum(n for _, n in parts) == 51
    assert max(n for _, n in parts) <= sp.WINDOW


def test_cuts_of_several_sentences_are_those_of_each():
    rng = random.Random(7)
    for _ in range(100):
        each = [rng.choices([b"ab", b"cd", b"ef", b"gh"], k=rng.randint(9, 40)) for _ in range(rng.randint(1, 6))]
        together = sp.cuts([w for words in each for w in words], [len(w) for w in each])
        assert together == [sp.cuts(words, [len(words)])[0] for words in each]
        assert all(c[-1] == len(w) and sorted(set(c)) == c for c, w in zip(together, each))
