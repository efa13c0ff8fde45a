"""Names of words and word sequences, a batch of texts at a time.

Words are maximal runs of bytes other than space and \t..\r, as in
``[^\x20\x09-\x0D]+`` on the text. Names are 64 bits that depend on the bytes
only: the same on every executor and in every run. A word of up to eight bytes
is its own name, scrambled, so no two of one length share one; up to sixteen
bytes, both halves are scrambled one after the other; longer words and lines go
by BLAKE2b. Names choose candidates; what deletes text compares ``digests`` of
the words themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Texts are hashed in groups of about so many bytes.
GROUP_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The low bytes of an eight-byte word that belong to a span of 0 to 8 bytes.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def groups(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about GROUP_BYTES together (one text at least)."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text or b"")
        if i > start and size + n > GROUP_BYTES:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (in bytes) of the words of ``data``."""
    inner = ~_SPACE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inner, [False]]).view(np.int8)))
    return edges[::2], edges[1::2]


def long_name(data: bytes) -> int:
    """The name of one long word, or of a line."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name of each span of ``data``."""
    eights = np.ndarray(len(data) + 9, "<u8", data + bytes(16), strides=(1,))
    size = ends - starts
    names = mix((eights[starts] & _LOW[np.minimum(size, 8)]) + np.uint64(_BASE) * (np.minimum(size, 17).astype(np.uint64) + np.uint64(1)))
    more = np.flatnonzero(size > 8)
    if len(more):
        rest = eights[starts[more] + 8] & _LOW[np.minimum(size[more] - 8, 8)]
        names[more] = mix(names[more] ^ mix(rest + np.uint64(_BASE)))
        for i in more[size[more] > 16].tolist():
            names[i] = long_name(data[starts[i] : ends[i]])
    return names


def spaced(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of ``data`` with one space after each, and their starts and ends there."""
    size = ends - starts
    after = np.cumsum(size + 1)
    take = np.ones(int(after[-1]) if len(after) else 0, bool)
    take[after - 1] = False
    out = np.full(len(take), 32, np.uint8)
    out[take] = np.frombuffer(data, np.uint8)[~_SPACE[np.frombuffer(data, np.uint8)]]
    return out.tobytes(), after - size - 1, after - 1


def digests(data: bytes, starts: list[int], ends: list[int]) -> bytes:
    """128-bit digests of spans of ``data``, one after another."""
    make = hashlib.blake2b
    return b"".join([make(data[a:b], digest_size=16).digest() for a, b in zip(starts, ends, strict=True)])


def word_hashes(texts: list[bytes | None], separator: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts one after another, and each text's number of words."""
    data = separator.join(text or b"" for text in texts)
    starts, ends = word_spans(data)
    sizes = np.array([len(text or b"") + 1 for text in texts], np.int64)
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)])))
    return span_hashes(data, starts, ends), counts


def join_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A name for each ordered pair of names."""
    return mix(mix(left + np.uint64(_BASE)) + right * np.uint64(0xD6E8FEB86659FD93))


def sequence_hashes(names: np.ndarray, width: int) -> np.ndarray:
    """A name for every ``width`` consecutive names, by doubling (empty if there are fewer)."""
    if len(names) < width:
        return names[:0]
    found, size = names, 1
    while 2 * size <= width:
        found = join_hashes(found[:-size], found[size:]) if len(found) > size else found[:0]
        size *= 2
    if size < width:
        rest = width - size
        found = join_hashes(found[:-rest], found[rest:])
    return mix(found + np.uint64(width))


def shingles(names: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct names of a document's ``width``-word shingles.

    A document with fewer words has one shingle, the whole sequence; none without words.
    """
    if not len(names):
        return names
    return np.unique(sequence_hashes(names, min(width, len(names))))
