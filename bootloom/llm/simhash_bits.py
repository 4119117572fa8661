"""The 64-bit SimHash of a text."""

from __future__ import annotations

import numpy as np
import xxhash

BITS = 64
SHINGLE = 4
SEED = 42
#: Shingles whose bits are counted at once.
_STEP = 1 << 15


def simhash(text: bytes | None, size: int = SHINGLE) -> int:
    """The fingerprint of a whole UTF-8 text, unsigned.

    A-Z count as a-z and words stand between ASCII white space.  Each run of
    ``size`` words, joined by single spaces and with repeats counted, is hashed
    by XXH64; a bit is set if it is set in more than half the hashes.  A text of
    fewer words is one run, a text without words has fingerprint 0.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    run = min(size, len(words))
    starts = (ends - lengths)[: len(words) - run + 1].tolist()
    stops = ends[run - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops)], ">u8"))


def majority(hashes: np.ndarray) -> int:
    """The number, unsigned, of the bits that are set in more than half the hashes, given as big-endian ``>u8``."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _STEP):
        part = hashes[at : at + _STEP]
        counts += np.unpackbits(part.view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")
