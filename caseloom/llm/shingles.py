"""Word shingles of whole texts as 64-bit hashes, in numpy.

Words are runs without the six white-space bytes, A-Z lower-cased.  A word's
hash is a sum of its bytes times a random odd number for each place, mixed; a
shingle's is a sum of its words' hashes times one for each place, mixed.  Both
are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
#: Bytes of text handled at once.
CHUNK_BYTES = 1 << 20

_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _random(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_PLACES = _random(512, 1)
_WORDS = _random(WORDS, 2)


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of folded text that ends with a space."""
    raw = np.frombuffer(data, np.uint8)
    inside = raw != 32
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not starts.size:
        return starts, np.zeros(0, np.uint64)
    length = ends - starts
    most = int(length.max())
    places = _PLACES if most <= len(_PLACES) else _random(most, 1)
    at = np.flatnonzero(inside)
    first = np.cumsum(length) - length
    terms = (raw[at].astype(np.uint64) + np.uint64(1)) * places[at - np.repeat(starts, length)]
    return starts, mix(np.add.reduceat(terms, first) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than five make one shingle, none make none."""
    folded = ((t or "").encode().translate(_FOLD) for t in texts)
    chunk: list[bytes] = []
    size = 0
    for data in folded:
        chunk.append(data)
        size += len(data)
        if size >= CHUNK_BYTES:
            yield from _sets(chunk)
            chunk, size = [], 0
    if chunk:
        yield from _sets(chunk)


def _sets(chunk: list[bytes]) -> Iterator[np.ndarray]:
    starts, words = _word_hashes(b" ".join(chunk) + b" ")
    begins = np.cumsum([0] + [len(d) + 1 for d in chunk])
    cuts = np.searchsorted(starts, begins)
    n = len(words)
    total = np.zeros(max(n - WORDS + 1, 0), np.uint64)
    for k in range(WORDS):
        total += words[k : n - WORDS + 1 + k] * _WORDS[k]
    hashes = mix(total)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a >= WORDS:
            own = np.sort(hashes[a : b - WORDS + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            yield own[keep]
        elif b > a:
            yield mix(np.array([(words[a:b] * _WORDS[: b - a]).sum() + np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def set_id(own: np.ndarray) -> int:
    """A signed 64-bit name of a set: equal sets have equal names."""
    return int(mix(np.array([mix(own).sum() + np.uint64(len(own))], np.uint64)).view(np.int64)[0])
