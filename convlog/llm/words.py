"""Words of many texts at once, as 64-bit hashes in numpy arrays; used inside Spark tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20_240_229)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
AS_IS = np.arange(256, dtype=np.uint8)
FOLD = AS_IS.copy()
FOLD[65:91] += 32
NOT_LETTERS = np.array([not (c >= 128 or chr(c).isalnum()) for c in range(256)])


def multipliers(n: int) -> np.ndarray:
    """An odd multiplier drawn for each place of a word, the same for all words. They aren't powers of one number, so
    different words have one hash with a chance of about 2^-60 whatever they are made of."""
    return np.random.default_rng(20_240_301).integers(0, 2**64, max(n, 64), dtype=np.uint64) | np.uint64(1)


_MULTIPLIERS = multipliers(64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads each bit over all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed_words(texts: pa.Array, separators: np.ndarray = SPACE, fold: np.ndarray = AS_IS, stem: int = 0) -> tuple[np.ndarray, ...]:
    """hash and row of each word, in order; with stem also the hash of its first bytes, as many as stem. Null: no words."""
    rows = texts.cast(pa.binary()).to_pylist()
    data = fold[np.frombuffer(b"\n".join(x or b"" for x in rows) + b"\n", np.uint8)]
    inside = ~separators[data]
    inside[-1] = False
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    row_ends = np.cumsum(np.array([len(x or b"") + 1 for x in rows], np.int64))
    if not len(starts):
        none = np.zeros(0, np.uint64)
        return (none, np.zeros(0, np.int64), none) if stem else (none, np.zeros(0, np.int64))
    at = np.flatnonzero(inside)
    word = np.cumsum(np.diff(at, prepend=at[0] - 2) != 1) - 1
    place = at - starts[word]
    longest = int(place.max()) + 1
    part = BYTE[data[at]] * (_MULTIPLIERS if longest <= len(_MULTIPLIERS) else multipliers(longest))[place]
    first = np.searchsorted(at, starts)
    hashes = mixed(np.add.reduceat(part, first))
    row = np.searchsorted(row_ends, starts, side="right")
    if stem:
        return hashes, row, mixed(np.add.reduceat(np.where(place < stem, part, np.uint64(0)), first))
    return hashes, row
