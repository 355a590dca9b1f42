"""Chunks of growing logs by keyed state: what is open of a log is a few numbers, so a pass costs what is new.

A log's state is the row expected next and its open chunk: start, turns, characters, the last completed turn's end, the
characters behind it, the phases that began there, and whether a user row waits for its answer. Rows that come too early wait in a list. A row that was
seen before (an edit), or a first row that isn't a log's beginning (the state expired or never was), can't be answered
from the state: it is told as `rebuild`, and the log is planned from its table from then on.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from convlog.functions.text import utf16_length

STATE = "next_id long, chunk long, start_id long, turns long, chars long, done_id long, behind long, waits boolean, marks string"
ROW = "message_id long, is_user boolean, is_system boolean, chars long, new_phase boolean"
TOLD = "conv_id long, kind string, chunk long, start_id long, end_id long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Open:
    """The open chunk of a log, row by row. Boundary rows are the user's."""

    def __init__(self, turns: int, chars: int, state: tuple | None = None):
        self.most_turns, self.most_chars = turns, chars
        self.next_id, self.chunk, self.start_id, self.turns, self.chars, self.done_id, self.behind, self.waits, marks = state or (0, 0, 0, 0, 0, None, 0, False, "")
        self.marks = [list(map(int, m.split(":"))) for m in marks.split()]

    def state(self) -> tuple:
        return (self.next_id, self.chunk, self.start_id, self.turns, self.chars, self.done_id, self.behind, self.waits, " ".join(f"{b}:{n}" for b, n in self.marks))

    def _close(self, end: int) -> tuple[int, int, int]:
        told = (self.chunk, self.start_id, end)
        self.chunk, self.start_id, self.turns, self.chars, self.done_id, self.behind = self.chunk + 1, end + 1, 0, 0, None, 0
        return told

    def _cut(self) -> Iterator[tuple[int, int, int]]:
        """Before the first completed turn of a chunk nothing can keep a phase from ending it."""
        for b, chars in self.marks:
            if b > self.start_id:
                yield self._close(b - 1)
            self.chars += chars
        self.marks = []

    def add(self, is_user: bool, is_system: bool, chars: int, new_phase: bool) -> Iterator[tuple[int, int, int]]:
        """(chunk, start, end) of the chunks that the next row closes."""
        at, self.next_id = self.next_id, self.next_id + 1
        if self.done_id is not None and self.chars + chars > self.most_chars:
            behind = self.behind
            yield self._close(self.done_id)
            self.chars = behind
            yield from self._cut()
        if new_phase and at > self.start_id:
            # behind a completed turn the limit may still end the chunk there, so the phase waits for the next completion
            self.marks.append([at, 0])
            if self.done_id is None:
                yield from self._cut()
        self.chars += chars
        if self.marks:
            self.marks[-1][1] += chars
        else:
            self.behind += chars
        if is_system:
            return
        if is_user:
            self.waits = True
        elif self.waits:
            if self.marks:
                yield from self._cut()
            self.waits, self.turns, self.done_id, self.behind = False, self.turns + 1, at, 0
            if self.turns >= self.most_turns or self.chars >= self.most_chars:
                yield self._close(at)


class OpenChunks(StatefulProcessor):
    def __init__(self, turns: int, chars: int, ttl_ms: int | None):
        self.turns, self.chars, self.ttl = turns, chars, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", STATE, self.ttl)
        self.early = handle.getListState("early", ROW, self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new = [(r.message_id, r.is_user, r.is_system, r.chars, r.new_phase) for r in rows]
        known = self.open.get()  # each call of a state is a message to the JVM, so none is asked whether it exists
        waiting = [] if known is None else list(map(tuple, self.early.get()))
        rows = sorted(waiting + new, key=lambda r: r[0])
        log, told = Open(self.turns, self.chars, known and tuple(known)), []
        ids = [int(r[0]) for r in rows]
        first = min(ids, default=0)
        lost = known is None and first > 0  # no state, and the log began before
        again = sorted({i for i in ids if i < log.next_id} | {a for a, b in zip(ids, ids[1:], strict=False) if a == b})
        if lost or again:
            self.open.clear()
            self.early.clear()
            told = [("rebuild", None, min(again, default=first), None)]
        else:
            k = 0
            while k < len(rows) and ids[k] == log.next_id:
                _, is_user, is_system, chars, new_phase = rows[k]
                told += [("closed", *c) for c in log.add(bool(is_user), bool(is_system), int(chars or 0), bool(new_phase))]
                k += 1
            self.open.update(log.state())
            if k < len(rows):
                self.early.put([(int(r[0]), bool(r[1]), bool(r[2]), int(r[3] or 0), bool(r[4])) for r in rows[k:]])
            elif waiting:
                self.early.clear()
        for t in told:
            yield Row(conv_id=key[0], kind=t[0], chunk=t[1], start_id=t[2], end_id=t[3])

    def close(self) -> None:
        pass


def open_chunks(rows: DataFrame, turns: int, chars: int, boundary: Column | None = None, ttl_seconds: int | None = None) -> DataFrame:
    """conv_id, kind, chunk, start_id, end_id from a stream of new rows (conv_id, message_id, is_user, is_system, text): `closed`
    chunks as soon as they are, by the same rules as plan_chunks; `rebuild` where a log must be planned from its table,
    from start_id on or before. A stream of appended rows only: edits make their log rebuild. With ttl_seconds the state of
    a log that had no new row for so long goes; Spark then has a batch due at any time, so such a stream ends by trigger
    once or by hand, not with availableNow. Needs state stores that transformWithState works with: see state_provider."""
    marked = boundary if boundary is not None else F.lit(False)
    narrow = rows.select("conv_id", "message_id", "is_user", "is_system", utf16_length(F.coalesce("text", F.lit(""))).alias("chars"), F.coalesce(marked, F.lit(False)).alias("new_phase"))
    return narrow.groupBy("conv_id").transformWithState(OpenChunks(turns, chars, ttl_seconds and 1000 * ttl_seconds), TOLD, "Append", "ProcessingTime" if ttl_seconds else "None")


class state_provider:  # noqa: N801
    """The state store that transformWithState needs, for the streams started inside."""

    KEY = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(self.KEY, None)
        self.spark.conf.set(self.KEY, PROVIDER)

    def __exit__(self, *_) -> None:
        self.spark.conf.unset(self.KEY) if self.before is None else self.spark.conf.set(self.KEY, self.before)
