"""Licence notices in documents, by an exact set-similarity join, in Spark's own functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bootloom.llm.common import KEY, plain_words, with_key
from bootloom.operators.lineage import settle

#: Phrases that name a licence, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Templates of notices, with their labels.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it under the terms of the GNU General Public License"),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("reserved", "All rights reserved"),
]
#: The share of a template's distinct words that a block of text must contain.
THRESHOLD = 0.8


#: Places of a document are compared within stretches of 2^so many words; no template is longer than one.
STRETCH_BITS = 6


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def template_words(text: str) -> set[str]:
    return set(words_of(text))


def _frequencies(words: DataFrame, universe: list[str]) -> dict[str, int]:
    """In how many documents each word of the templates stands; one row for each such word comes to the driver."""
    found = words.select(F.explode(F.array_intersect("words", F.array(*[F.lit(w) for w in universe]))).alias("word"))
    return {row["word"]: row["count"] for row in found.groupBy("word").count().collect()}


def template_index(templates: list[tuple[str, str]], threshold: float, frequency: dict[str, int]) -> list[tuple]:
    """(word, label, place, words in order, least overlap, length) for each word of each template's prefix.

    The distinct words of a template stand in the global order, the rarest first.
    A block that has ``least`` of n words has one of any n - least + 1 of them, so
    only the first so many, the prefix, are looked up.
    """
    index = []
    for label, text in templates:
        words = sorted(template_words(text), key=lambda w: (frequency.get(w, 0), w))
        least, length = math.ceil(threshold * len(words) - 1e-9), len(words_of(text))
        if length > 1 << STRETCH_BITS:
            raise ValueError(f"a template has more than {1 << STRETCH_BITS} words")
        index += [(words[p], label, p, words, least, length) for p in range(len(words) - least + 1 if words else 0)]
    return index


def _places(words: Column, phrase: list[str]) -> Column:
    """Starts of a phrase in an array of words; looked for word by word only where its words occur."""
    there = F.array_contains(words, phrase[0])
    for word in phrase[1:]:
        there = there & F.array_contains(words, word)
    starts = F.sequence(F.lit(0), F.size(words) - 1)

    def begins(i: Column) -> Column:
        same = F.get(words, i) == phrase[0]
        for k, word in enumerate(phrase[1:], 1):
            same = same & (F.coalesce(F.get(words, i + k), F.lit("")) == word)
        return same

    return F.when(there, F.filter(starts, begins)).otherwise(F.array().cast("array<int>"))


def _worded(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    plain = with_key(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")))
    return plain.withColumn("words", plain_words(F.col("text")))


def _literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def _hits(words: Column, index: list[tuple]) -> Column:
    """Where prefix words stand in a text, each with the words around it that a block could reach."""
    reach = max([length for *_, length in index], default=1) - 1
    prefix = sorted({row[0] for row in index})
    at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(prefix))

    def around(i: Column) -> Column:
        first = F.greatest(i - reach, F.lit(0))
        return F.struct(i.alias("at"), first.alias("first"), F.slice(words, first + 1, i - first + 1 + reach).alias("near"))

    return F.when(F.arrays_overlap(words, _literal(prefix)), F.transform(at, around))


def _met(table: DataFrame, index: list[tuple]) -> DataFrame:
    """The blocks: a stretch of words as long as a template, from one of its words on, with enough of them.

    A block meets a template through the prefix word that stands first in the
    global order among those in the block, and the first place of that word, so
    each is met once.  The block's number of words and what remains behind that
    word in the order must reach the least overlap; then the overlap is counted.
    ``first`` and ``last`` are the places of the first and last template word in it.
    """
    spark = table.sparkSession
    filed = spark.createDataFrame(index, "word string, label string, place int, template array<string>, least int, length int")
    hits = table.where("hits is not null").select(*KEY, F.explode("hits").alias("hit"))
    asked = hits.select(*KEY, "hit.*", F.get("hit.near", F.col("hit.at") - F.col("hit.first")).alias("word"))
    met = asked.join(F.broadcast(filed), "word")
    starts = F.sequence(F.greatest(F.col("at") - F.col("length") + 1, F.col("first")), F.col("at"))
    blocks = met.withColumn("start", F.explode(starts)).withColumn(
        "block", F.slice("near", F.col("start") - F.col("first") + 1, F.col("length"))
    )
    blocks = blocks.where(
        (F.size("block") >= F.col("least"))
        & F.array_contains("template", F.get("block", F.lit(0)))
        & (F.array_position("block", F.col("word")) == F.col("at") - F.col("start") + 1)
        & (F.size("template") - F.col("place") >= F.col("least"))
        & (F.size(F.array_intersect(F.slice("template", F.lit(1), F.col("place")), F.col("block"))) == 0)
    )
    shared = blocks.withColumn("shared", F.size(F.array_intersect("template", "block"))).where("shared >= least")
    after = F.array_position(F.transform(F.reverse("block"), lambda w: F.array_contains("template", w)), F.lit(True))
    return shared.select(
        *KEY, "label", F.col("start").alias("first"), (F.col("start") + F.size("block") - after).cast("int").alias("last"),
        "shared", (F.col("shared") / F.size("template")).alias("share"),
    ).distinct()


def _settled(met: DataFrame) -> DataFrame:
    """The blocks that no better one of another label shares a place with: one with a larger share, or more words."""
    columns = ["label", "first", "last", "shared", "share"]
    stretches = F.sequence(F.shiftright("first", STRETCH_BITS), F.shiftright("last", STRETCH_BITS))
    # A stretch has a bounded number of blocks: some for each of its words and each template.
    near = met.withColumn("_stretch", F.explode(stretches)).groupBy(*KEY, "_stretch").agg(
        F.collect_list(F.struct(*columns)).alias("_near")
    )

    def better(x: Column, y: Column) -> Column:
        rank = [F.struct(b["share"], b["shared"]) for b in (x, y)]
        return (x["label"] != y["label"]) & (x["first"] <= y["last"]) & (y["first"] <= x["last"]) & (rank[0] > rank[1])

    beaten = F.transform(
        "_near", lambda y: F.struct(y.alias("block"), F.exists("_near", lambda x: better(x, y)).alias("beaten"))
    )
    flagged = near.select(*KEY, F.explode(beaten).alias("_b")).select(*KEY, "_b.block.*", "_b.beaten")
    return flagged.groupBy(*KEY, *columns).agg(F.max("beaten").alias("beaten")).where("not beaten").drop("beaten")


def license_blocks(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    templates: list[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Every block of text that meets a template: ``doc_id``, ``label``, ``first`` and ``last`` word, ``share``.

    A block is as many words of the text as the template has, wherever lines end;
    it begins at a word of the template and has at least ``threshold`` of its
    distinct words.  Blocks of different templates that share places are
    settled: one gives way to another with a larger share, or with the same share
    and more words.  Rows equal in id and text are one document.
    """
    worded = _worded(docs, text, doc_id)
    index = _index(worded, templates, threshold)
    table = settle(worded.select("doc_id", *KEY, _hits(F.col("words"), index).alias("hits")).where("hits is not null"))
    ids = table.select("doc_id", *KEY).distinct()
    found = _settled(_met(table, index)).join(ids, KEY)
    return found.select(F.col("doc_id").alias(doc_id), "label", "first", "last", "share")


def _index(worded: DataFrame, templates: list[tuple[str, str]], threshold: float) -> list[tuple]:
    universe = sorted(set().union(*(template_words(t) for _, t in templates)))
    return template_index(templates, threshold, _frequencies(worded, universe) if universe else {})


def license_scan(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    templates: list[tuple[str, str]] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document: id, ``n_words``, phrase places, labels and ``score``.

    A label comes from a phrase whose words stand consecutively anywhere, or from
    a block of :func:`license_blocks`.  ``score`` is 1 where a phrase is found,
    else the largest share of its blocks, else 0.  Null texts count as empty;
    rows equal in id and text are one document and get the same result.  Other
    columns are not carried, so their names cannot clash; an empty table gives
    no rows.

    The join: a document that has no word of any template's prefix is passed
    over; of the others, the places of prefix words go into the join with the
    few words around them, and the templates are its fixed, small side.
    """
    worded = _worded(docs, text, doc_id)
    index = _index(worded, templates, threshold)
    places = [(label, _places(F.col("words"), phrase.split(" "))) for phrase, label in phrases.items()]
    all_places = F.concat(*[p for _, p in places]) if places else F.array().cast("array<int>")
    labels = [F.when(F.size(p) > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for label, p in places]
    table = settle(
        worded.select(
            "doc_id",
            *KEY,
            F.size("words").cast("bigint").alias("n_words"),
            F.size(all_places).cast("bigint").alias("n_base"),
            F.array_min(all_places).cast("bigint").alias("first_word"),
            F.array_max(all_places).cast("bigint").alias("last_word"),
            F.array_sort(F.array_distinct(F.flatten(F.array(*labels)))).alias("base") if labels
            else F.array().cast("array<string>").alias("base"),
            _hits(F.col("words"), index).alias("hits"),
        )
    )
    found = _settled(_met(table, index)).groupBy(*KEY).agg(
        F.collect_set("label").alias("more"), F.max("share").alias("share")
    )
    none = F.array().cast("array<string>")
    return table.drop("hits").join(found, KEY, "left").select(
        F.col("doc_id").alias(doc_id),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
