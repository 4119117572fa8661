"""Small texts with every oddity, and plain loops that say what the operators should find."""

from __future__ import annotations

import random
import re

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = str.maketrans(UPPER, LOWER)


def lower(text: str | None) -> str:
    return (text or "").translate(_LOWER)


def plain_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def spaced_words(text: str | None) -> list[str]:
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text)) if w]


def prose(seed: int, n: int) -> str:
    """Words in sentences and lines."""
    rng = random.Random(seed)
    words = [rng.choice("kala miru tofe sund ralo bine vost yuki del an zo".split()) + rng.choice(["", "ta", "ri"]) for _ in range(n)]
    out = []
    for i, word in enumerate(words):
        out.append(word + (".\n" if i % 23 == 22 else ". " if i % 9 == 8 else ", " if i % 5 == 4 else " "))
    return "".join(out)


PASSAGE = prose(99, 70)
ODD = [
    (1, prose(1, 120)),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, prose(1, 120)),
    (6, prose(2, 60) + "\n" + PASSAGE + "\n" + prose(3, 60)),
    (7, prose(4, 80) + "\n" + PASSAGE),
    (8, prose(4, 80).upper()),
    (9, "x" * 30_000),
    (10, prose(5, 9_000)),
    (11, "Ünïcode ÀÉ straße 日本語 ١٢  á K <|endoftext|>İ\x00\x1c end!"),
    (None, prose(6, 40)),
    (None, None),
    (12, prose(7, 50)),
    (12, prose(7, 50)),
    (-5, prose(8, 3)),
    (13, prose(1, 118) + " zo an."),
]


def table(spark, rows=ODD):
    """The rows with columns that clash with what operators add."""
    wide = [(i, t, "own", 7.5, "mine", 1, "f") for i, t in rows]
    return spark.createDataFrame(
        wide, "doc_id long, text string, n_tokens string, score double, component_id string, n long, fingerprint string"
    ).repartition(3)


def unions(nodes, linked) -> dict:
    """The least node that each node reaches."""
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def broadcast_part(plan):
    """The lines of a physical plan that stand below its broadcasts."""
    found, limit = [], None
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-*("))
        if limit is not None and depth <= limit:
            limit = None
        if limit is not None:
            found.append(line)
        elif "BroadcastExchange" in line:
            limit = depth
    return "\n".join(found)
