from bootloom.llm import licenses as lc
from tests.llm.plain import ODD, plain_words, prose, table

NOTICES = [
    (50, "Intro.\nLicensed under CC BY-NC 4.0.\nEnd cc by, cc by"),
    (51, "LICENSED UNDER THE APACHE LICENSE VERSION 2"),
    (52, "the apache license is older"),
    (53, "all rights\nreserved"),
    (54, "rights all reserved"),
    (55, prose(4, 2000) + "\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software\n"),
    (56, "Released under MIT"),
    (57, "released under the mit\nlicense"),
    (58, "general public license general public license gnu"),
    (59, "Cc By"),
    (60, None),
    (61, "Released under the MIT License and licensed under the Apache License 2.0"),
    (62, "All rights reserved. Licensed under the Apache License 2.0"),
    (63, "Licensed under the Apache License 2.0"),
    (64, "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"),
    (65, "released " + "far away " * 300 + "under the " + "far away " * 300 + "mit " + "far away " * 300 + "license"),
    (66, "x " * 70 + "Licensed under CC BY-SA 4.0, licensed under CC BY 4.0 " + "y " * 70 + "all rights reserved reserved all rights"),
    (67, "licensed under the the the gnu lesser public license under general gnu public license version 3 this work is"),
    (68, ("Released under the MIT License\n" * 40)),
]


def brute(docs):
    """Every window of words against every template."""
    for doc_id, text in docs:
        words = plain_words(text)
        places, base, met = [], set(), []
        for phrase, label in lc.PHRASES.items():
            p = phrase.split()
            found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += found
            base |= {label} if found else set()
        for label, template in lc.TEMPLATES:
            want = set(plain_words(template))
            for first in range(len(words)):
                block = words[first : first + len(plain_words(template))]
                shared = len(want & set(block))
                if block[0] in want and shared >= 0.8 * len(want) - 1e-9:
                    last = first + max(k for k, w in enumerate(block) if w in want)
                    met.append((label, first, last, shared, shared / len(want)))
        kept = [
            x for x in met
            if not any(x[0] != y[0] and x[1] <= y[2] and y[1] <= x[2] and (y[4], y[3]) > (x[4], x[3]) for y in met)
        ]
        labels, share = {x[0] for x in kept}, max([x[4] for x in kept], default=0.0)
        yield (
            doc_id, len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if places else share,
        ), [(doc_id, x[0], x[1], x[2], x[4]) for x in kept]


def test_against_all_windows_and_templates(spark):
    docs = ODD + NOTICES + [(59, "Cc By")]
    got = [tuple(r) for r in lc.license_scan(table(spark, docs)).collect()]
    assert sorted(got, key=str) == sorted((row for row, _ in brute(docs)), key=str)
    blocks = [tuple(r) for r in lc.license_blocks(table(spark, docs)).collect()]
    assert set(blocks) == {x for _, found in brute(docs) for x in found} and len(blocks) == len(set(blocks))


def test_each_notice_of_a_text_counts(spark):
    got = {r.doc_id: (r.labels, r.score) for r in lc.license_scan(table(spark, NOTICES)).collect()}
    assert got[50][0] == "cc-by,cc-by-nc" and got[51][0] == got[63][0] == "apache" and got[58][0] == "gpl"
    assert got[61] == ("apache,mit", 1.0) and got[62] == ("apache,reserved", 1.0) and got[64] == ("bsd", 1.0)
    assert got[65] == ("", 0.0) and got[57] == ("mit", 1.0) and got[66][0] == "cc-by,cc-by-sa,reserved" and got[56][0] == ""


def test_nothing(spark):
    assert lc.license_scan(table(spark).limit(0)).collect() == [] and lc.license_blocks(table(spark).limit(0)).collect() == []
    assert {r.labels for r in lc.license_scan(table(spark), templates=[], phrases={}).collect()} == {""}


def test_prefixes():
    index = lc.template_index([("x", "a b c d e")], 0.8, {"a": 9, "b": 1})
    assert [row[0] for row in index] == ["c", "d"] and [row[2] for row in index] == [0, 1] and index[0][4:] == (4, 5)


def test_no_python_in_the_plan(spark):
    assert "Python" not in lc.license_scan(table(spark))._jdf.queryExecution().toString()
