"""Vectorised words: hashes and places of all words in a block of texts, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTERS = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_POWERS: dict[str, np.ndarray] = {}
#: Texts are worked on in blocks of about so many bytes, which fit the processor's caches; longer ones in parts of as many.
BLOCK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that every bit of the result depends on every bit of x."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64, as far as a part of a block needs them."""
    if not _POWERS:
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            row = np.full(BLOCK + 2, base, _U)
            row[0] = 1
            _POWERS[name] = np.multiply.accumulate(row)
    return _POWERS["up"], _POWERS["down"]


@dataclass
class Block:
    """Words of several texts. doc: each word's text (index in the block); first: each text's first word, and one more."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def _ends(data: np.ndarray) -> list[int]:
    """Where data is cut into parts of at most BLOCK bytes that end with white space; a longer word makes a part of its own."""
    out, at = [], 0
    while at < len(data):
        stop = at + BLOCK
        if stop < len(data):
            gaps = np.flatnonzero(_SPACE[data[at:stop]])
            while not len(gaps):
                gaps = stop - at + np.flatnonzero(_SPACE[data[stop : stop + BLOCK]])  # data ends with a space
                stop += BLOCK
            stop = at + int(gaps[-1] if stop == at + BLOCK else gaps[0]) + 1
        out.append(at := min(stop, len(data)))
    return out


def _part(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words of data, which ends with white space."""
    up, down = _powers()
    if len(data) > BLOCK + 1:  # a single word and its space: its sum is put together from pieces
        n = len(data) - 1
        total = sum(pow(_BASE, k, 1 << 64) * int((_LETTERS[data[k : min(k + BLOCK, n)]] * up[: min(BLOCK, n - k)]).sum()) for k in range(0, n, BLOCK))
        return np.array([0]), np.array([n]), mix(np.array([(total + n) % (1 << 64)], _U))
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_LETTERS[data] * up[: len(data)], out=sums[1:])
    return start, end, mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U))


def cut(texts: list[bytes], lower: bool = True) -> Block:
    """texts: UTF-8; A-Z are lower-cased here, if asked. Texts are kept apart by a space that belongs to none.

    Beside the bytes and the words' rows, memory is bounded by BLOCK, or by the longest word.
    """
    joined = b" ".join([*texts, b""]) if texts else b" "
    data = np.frombuffer(joined.lower() if lower else joined, np.uint8)
    parts, at = [], 0
    for stop in _ends(data):
        start, end, hashes = _part(data[at:stop])
        parts.append((start + at, end + at, hashes))
        at = stop
    start, end, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(start, begins)
    return Block(data, start, end, hashes, np.repeat(np.arange(len(texts)), np.diff(first)), first)


def blocks(texts: Iterable[bytes | None], limit: int = BLOCK, lower: bool = True) -> Iterator[tuple[int, int, Block]]:
    """(from, to, words) of successive runs of texts of about limit bytes; a longer text makes a block of its own."""
    held: list[bytes] = []
    at = size = 0
    for t in texts:
        t = t or b""
        if held and size + len(t) > limit:
            yield at, at + len(held), cut(held, lower)
            at, held, size = at + len(held), [], 0
        held.append(t)
        size += len(t)
    if held:
        yield at, at + len(held), cut(held, lower)
