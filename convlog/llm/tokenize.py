"""What the two tokenising operators share: cutting a text into units that encode independently."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE_AFTER_SPACE = re.compile(r"\s ")
_CUT = re.compile(r"(?<!\s)(?= )")


def units(text: str) -> list[str]:
    """Cut before each blank that follows a character other than white space.

    No match of the pre-tokenising pattern spans such a place: a match holds a blank only as its first character or
    within a run of white space, and nothing in the pattern looks back. So the tokens of a text are those of its units.
    """
    if "\0" in text or _SPACE_AFTER_SPACE.search(text):
        return _CUT.split(text)
    return text.replace(" ", "\0 ").split("\0")


def marked_units(text: str) -> str:
    """The text, which has no NUL, with a NUL between units."""
    return _CUT.sub("\0", text) if _SPACE_AFTER_SPACE.search(text) else text.replace(" ", "\0 ")


def slices(batch: pa.RecordBatch, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a batch (id, text) with about limit bytes of text, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at, before = 0, 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, end - at)
        at, before = end, int(ends[end - 1])


class Memory:
    """Ids of units in two generations: when the younger one is full it becomes the older, and what is used again moves
    back. So frequent units stay known and the memory of a Python worker stays bounded."""

    def __init__(self, limit: int):
        self.limit, self.known, self.older = limit, {}, {}

    def missing(self, cuts: list[list[str]], turn: bool = True) -> list[str]:
        """The units that are in neither generation; all others are in `known` afterwards. turn: a new generation may begin."""
        if turn and len(self.known) > self.limit:
            self.older, self.known = self.known, {}
        wanted: set[str] = set()
        wanted.update(*cuts)
        wanted.difference_update(self.known)
        again = wanted & self.older.keys()
        self.known.update(zip(again, map(self.older.__getitem__, again), strict=True))
        return list(wanted - again)
