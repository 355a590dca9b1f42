"""Streamed answers put together while they arrive, by keyed state.

Of each open stream the state holds what is behind the last whole event, and the events so far. A stream closes at its
first terminal event; one that breaks a rule (an error, unreadable data, too many bytes) or that has been silent for too
long is told as rejected. A closed stream stays closed: pieces that come later are told as late and change nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from convlog.operators.usage import STREAM_ENDS, stream_completion

STATE = "next_seq long, rest string, count long, bytes long, status string"
TOLD = "conv_id long, status string, no int, event string, data string"
_BLANK_LINE, _LINE = re.compile(r"\r\n\r\n|\n\n|\r\r"), re.compile(r"\r\n|\n|\r")


def events_in(buffer: str) -> tuple[list[tuple[str, str]], str]:
    """The events (name, data) of the whole blocks in a buffer, and what is left of it."""
    *blocks, rest = _BLANK_LINE.split(buffer)
    out = []
    for block in blocks:
        lines = [line.partition(":") for line in _LINE.split(block) if line and not line.startswith(":")]
        named = [v.removeprefix(" ") for k, _, v in lines if k == "event"]
        data = [v.removeprefix(" ") for k, _, v in lines if k == "data"]
        if data:
            out.append((named[-1] or "message" if named else "message", "\n".join(data)))
    return out, rest


def ends_stream(event: str, data: str) -> bool | None:
    """Whether an event ends its stream; None if its data can't be read."""
    if data == "[DONE]":
        return True
    try:
        value = json.loads(data)
    except ValueError:
        return None
    if not isinstance(value, dict):
        return False
    kind = value.get("type")
    kind = kind.strip() if isinstance(kind, str) and kind.strip() else event.strip()
    return kind in STREAM_ENDS or value.get("done") is True


class Assembly(StatefulProcessor):
    """One stream a key: tells its events when it is closed, or that it is rejected."""

    def __init__(self, silence_ms: int | None, most_bytes: int):
        self.silence, self.most = silence_ms, most_bytes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", STATE)
        self.events = handle.getListState("events", "event string, data string")
        self.early = handle.getListState("early", "seq long, piece string")

    def _tell(self, key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["conv_id", "status", "no", "event", "data"]).astype({"no": "Int32"})

    def _timer(self, now: int) -> None:
        if self.silence:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(now + self.silence)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(int(r.seq), r.piece) for part in rows for r in part[["seq", "piece"]].itertuples(index=False)]
        state = tuple(self.open.get()) if self.open.exists() else (0, "", 0, 0, "open")
        at, rest, count, size, status = state
        if status != "open":
            yield self._tell(key, [("late", None, None, None)])
            return
        waiting = [(int(s), p) for s, p in self.early.get()] if self.early.exists() else []
        pieces = dict(sorted(waiting + new, reverse=True))
        told = []
        while at in pieces and status == "open":
            piece = pieces.pop(at) or ""
            at, size = at + 1, size + len(piece.encode())
            found, rest = events_in(rest + piece)
            if size > self.most:
                status = "too long"
            for event, data in found:
                if status != "open":
                    break
                ends = ends_stream(event, data)
                told.append((event, data))
                status = "unreadable" if ends is None else "closed" if ends else "open"
        if told:
            self.events.appendList(told)
            count += len(told)
        self.open.update((at, rest if status == "open" else "", count, size, status))
        later = [(s, p) for s, p in pieces.items() if s > at]
        if status == "open":
            self.early.put(sorted(later)) if later else self.early.clear()
            self._timer(timerValues.getCurrentProcessingTimeInMs())
            return
        self.early.clear()
        if status == "closed":
            yield self._tell(key, [("closed", no, e, d) for no, (e, d) in enumerate(self.events.get())])
        else:
            yield self._tell(key, [(status, None, None, None)])
        self.events.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, _, count, size, status = self.open.get()
        if status == "open":
            self.open.update((at, "", count, size, "silent"))
            held = list(self.events.get()) if self.events.exists() else []
            self.events.clear()
            self.early.clear()
            # a stream that named its reason is whole though its last event never came
            yield self._tell(key, [("ended", no, e, d) for no, (e, d) in enumerate(held)] or [("silent", None, None, None)])

    def close(self) -> None:
        pass


def assembled(pieces: DataFrame, silence_seconds: int | None = None, most_bytes: int = 2 << 20) -> DataFrame:
    """conv_id, status, no, event, data from a stream of pieces (conv_id, seq from 0, piece): the events of streams as they
    close (`closed`), or of what was there when they fell silent (`ended`); a row for each that is rejected (`unreadable`,
    `too long`, `silent`), and one for pieces that came `late`. Pieces may come out of turn. With silence_seconds Spark has
    a batch due at any time: such a stream ends by trigger once or by hand. Needs open_chunks.state_provider."""
    mode = "ProcessingTime" if silence_seconds else "None"
    return pieces.groupBy("conv_id").transformWithStateInPandas(Assembly(silence_seconds and 1000 * silence_seconds, most_bytes), TOLD, "Append", mode)


def completions(told: DataFrame) -> DataFrame:
    """The completions (see stream_completion) of assembled streams: of those that fell silent only if a reason was named."""
    return stream_completion(told.filter(F.col("status").isin("closed", "ended")).select("conv_id", "no", "event", "data"))


def rejects(told: DataFrame) -> DataFrame:
    """status, n: the streams that were rejected, and late pieces, by what was wrong."""
    return told.filter(~F.col("status").isin("closed", "ended")).groupBy("status").agg(F.count("*").alias("n"))
