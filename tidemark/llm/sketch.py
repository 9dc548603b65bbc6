"""Count-min sketches of 64-bit hashes, merged from parts, to tell which may occur more than once.

A sketch has two rows of counters that stop at two, since no more is asked of them, and ROOM counters a row for each
hash, whatever the input's size: it isn't held anywhere as a whole. A row is cut into chunks. A part (a bucket of
documents, say) writes the sorted cells it touched and which of them twice, packed by chunk; parts of a chunk are
merged on one task, which holds that chunk alone and answers each part with a bit per touched cell: counted twice or
more, over all parts. A hash whose cells have that bit in both rows may be repeated; one that is repeated always has
it. Of the hashes that occur once about one in twelve passes, (1 - exp(-1 / ROOM))**2, at any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import zstandard

ROWS, ROOM = 2, 3
#: Cells of a chunk, a byte each where it's merged.
CHUNK = 1 << 22
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_LOW, _32 = np.uint64((1 << 32) - 1), np.uint64(32)


class Shape(NamedTuple):
    chunks: int
    width: int


def shape(hashes: float, chunk: int = CHUNK) -> Shape:
    """Chunks of a row, and the cells of each, for about so many hashes."""
    cells = max(1024, math.ceil(ROOM * hashes))
    chunks = -(-cells // chunk)
    return Shape(chunks, -(-cells // chunks))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def cells(h: np.ndarray, row: int, form: Shape) -> np.ndarray:
    """The chunk, in the high half, and the cell in it."""
    g = mix(h * _MULTIPLIERS[row])
    return ((g >> _32) * np.uint64(form.chunks) >> _32) << _32 | (g & _LOW) * np.uint64(form.width) >> _32


@lru_cache(maxsize=1)
def _tools() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """One of each for a worker, which has one thread."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(a: np.ndarray) -> bytes:
    """An array of whole numbers, its bytes by significance, compressed."""
    return _tools()[0].compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(_tools()[1].decompress(b), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def _by_chunk(key: np.ndarray, form: Shape) -> Iterator[tuple[int, slice]]:
    """The chunks that sorted keys are of."""
    at = (key >> _32).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True]) if len(key) else np.zeros(1, np.int64)
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
        yield int(at[lo]), slice(lo, hi)


def touched(h: np.ndarray, form: Shape) -> Iterator[tuple[int, bytes, bytes]]:
    """(chunk over both rows, cells, which of them twice) of a part's hashes."""
    for row in range(ROWS):
        key, n = np.unique(cells(h, row, form), return_counts=True)
        for chunk, at in _by_chunk(key, form):
            yield row * form.chunks + chunk, pack(np.diff((key[at] & _LOW).astype(np.uint32), prepend=np.uint32(0))), np.packbits(n[at] > 1).tobytes()


def merged(packs: Iterable[tuple[bytes, bytes]], form: Shape) -> Iterator[bytes]:
    """The answer to each of one chunk's packs (cells, which twice), in their order; packs are gone through twice."""
    count = np.zeros(form.width, np.uint8)
    for once, twice in packs:
        at = np.cumsum(unpack(once, np.uint32), dtype=np.uint32)
        count[at] = np.minimum(count[at] + 1 + np.unpackbits(np.frombuffer(twice, np.uint8), count=len(at)), 2)
    for once, _ in packs:
        yield np.packbits(count[np.cumsum(unpack(once, np.uint32), dtype=np.uint32)] > 1).tobytes()


def maybe_repeated(h: np.ndarray, answers: dict[int, bytes], form: Shape) -> np.ndarray:
    """Which of a part's hashes may be repeated, by the answers to what it touched."""
    out = np.ones(len(h), bool)
    for row in range(ROWS):
        key, inverse = np.unique(cells(h, row, form), return_inverse=True)
        bits = [np.unpackbits(np.frombuffer(answers[row * form.chunks + chunk], np.uint8), count=at.stop - at.start) for chunk, at in _by_chunk(key, form)]
        out &= np.concatenate([np.zeros(0, np.uint8), *bits])[inverse] == 1
    return out
