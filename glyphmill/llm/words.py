"""Vectorised words of whole UTF-8 texts, as 64-bit hashes.

All word classes used here are unions of ASCII characters and of *all* characters beyond ASCII, so words can be
found byte by byte.  A word's hash is a polynomial of random values per byte modulo 2**64, finished by a bit mixer;
two given different words agree with a chance near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy pass takes; a longer document is cut between words.
PIECE = 1 << 19

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Word bytes: everything but white space (space, tab to carriage return).
NON_SPACE = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
#: Word bytes: digits, a-z (texts are lowered first) and everything beyond ASCII.
ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)

_VALUES = np.random.default_rng(71).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_ODD = np.random.default_rng(72).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers[:] = made
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def words(text: np.ndarray, word_bytes: np.ndarray) -> Words:
    """Hashes and byte spans of the words of ``text`` (uint8), A-Z lowered."""
    found = []
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text):  # up to a byte outside words
            gap = np.flatnonzero(~word_bytes[LOWER[text[end : end + 4096]]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(text), end + 4096)
        piece = LOWER[text[at:end]]
        inside = np.zeros(len(piece) + 2, dtype=np.int8)
        inside[1:-1] = word_bytes[piece]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edge[0::2], edge[1::2]
        power, inverse = _power_table(len(piece) + 1)
        total = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(_VALUES[piece] * power[: len(piece)], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        found.append((hashes, starts + at, ends + at))
        at = end
    if not found:
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(found) == 1:
        return Words(*found[0])
    return Words(*(np.concatenate(x) for x in zip(*found)))


def word_hash(word: bytes) -> int:
    """The hash of one word, as ``words`` gives it."""
    return int(words(np.frombuffer(word, dtype=np.uint8), np.ones(256, dtype=bool)).hashes[0])


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        total += hashes[i : i + n] * _ODD[i]
    return mix(total + np.uint64(size))


class Chunk(NamedTuple):
    """Some documents of a batch: each text followed by a newline, in one buffer."""

    first: int
    text: np.ndarray
    bounds: np.ndarray  # len(documents) + 1 byte offsets


def chunks(column: pa.Array) -> Iterator[Chunk]:
    """The texts of a column (null: empty) in pieces of about PIECE bytes of whole documents."""
    column = column.cast(pa.large_string()).fill_null("")
    column = pc.binary_join_element_wise(column, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1
        last = min(max(last, first + 1), n)
        yield Chunk(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last
