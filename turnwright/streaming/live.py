"""Live sessions as streams: sound is held until a flush, a silence or a transcript ends it; turns end after a second of silence.

Rows of SESSION are messages (`functions.messages.parsed` reads them from JSON and base64). Their own times, not the time of
the micro-batch, say when a silence has passed, so the cuts between micro-batches change no result: a row that comes after
a silence first ends what was held before it, and a timer of the state store does the same for sessions that stay silent.

Modes, by what ends the sound that is held:
- `flush`: a flush row gives its transcript, an empty one where nothing is held.
- `silence`: 0.35 s without sound give it; flush rows do nothing.
- `direct`: every row with sound gives the transcript of all that is held, as a partial; one that is not blank clears it. A
  silence of 1.0 s clears what is held without a row.

In all modes `start` clears what is held and answers `ready`, or `error` if its model is not known, which ends the session;
`stop` answers `done` and ends it. Rows of a session that ended are left out. Sound that is not transcribed by then is dropped.

Scale: one shuffle by session. State is the sound held and six numbers; of a session that ended, only that it did, for
`forget` of event time. A session's rows of one micro-batch are sorted in memory: bound these by `streams.read_files`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SESSION = "session string, seq long, ts timestamp, kind string, payload binary, rate int, model string"
EVENT = "session string, seq long, event string, transcript string, n_chunks int, seconds double"
#: Milliseconds of silence that end what is held, by mode, and the rate of sound that names none.
SILENCE_MS = {"silence": 350, "direct": 1000}
RATE = 16_000
MODES = ("flush", "silence", "direct")
#: Chunks of sound that are handed to the state store in one call.
AT_ONCE = 100


def as_text(chunks: list[bytes], rate: int) -> str:
    """A stand-in for a recogniser: chunks are texts already."""
    return " ".join(c.decode("utf-8", "replace") for c in chunks)


class LiveSession(StatefulProcessor):
    def __init__(self, mode: str, transcribe: Callable[[list[bytes], int], str] = as_text, models: tuple[str, ...] = (), forget_ms: int = 600_000) -> None:
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}; known: {MODES}")
        self.mode, self.transcribe, self.models, self.forget_ms = mode, transcribe, models, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "chunk binary")
        self.facts = handle.getValueState("facts", "last_ms long, rate int, ended boolean, seq long, timer long")

    def _load(self, key: tuple) -> None:
        self.key = key[0]
        facts = self.facts.get()
        self.last_ms, self.rate, self.ended, self.seq, self.timer = facts or (0, RATE, False, -1, 0)
        # Each call to the state store is a round trip to the JVM; a session that is new or ended has no sound stored.
        self.chunks = [bytes(c[0]) for c in self.held.get()] if facts and not self.ended else []
        self.stored = len(self.chunks)
        self.cleared = False

    def _store(self) -> None:
        if self.cleared:
            if self.stored:
                self.held.clear()
            self.stored = 0
        for at in range(self.stored, len(self.chunks), AT_ONCE):
            self.held.appendList([(chunk,) for chunk in self.chunks[at : at + AT_ONCE]])
        silence = SILENCE_MS.get(self.mode)
        timer = self.last_ms + self.forget_ms if self.ended else self.last_ms + silence + 1 if silence and self.chunks else 0
        if timer != self.timer:
            if self.timer:
                self.handle.deleteTimer(self.timer)
            if timer:
                self.handle.registerTimer(timer)
            self.timer = timer
        self.facts.update((self.last_ms, self.rate, self.ended, self.seq, self.timer))

    def _clear(self) -> None:
        self.chunks, self.cleared = [], True

    def _event(self, event: str, seq: int, transcript: str = "", chunks: list[bytes] | None = None) -> Row:
        held = chunks or []
        return Row(session=self.key, seq=seq, event=event, transcript=transcript, n_chunks=len(held), seconds=sum(map(len, held)) / (2.0 * self.rate))

    def _given(self, event: str, seq: int) -> Row:
        return self._event(event, seq, self.transcribe(self.chunks, self.rate) if self.chunks else "", self.chunks)

    def _after_silence(self) -> Iterator[Row]:
        """What a silence does with the sound held."""
        if self.chunks:
            if self.mode == "silence":
                yield self._given("data", self.seq)
            self._clear()

    def _message(self, row: Row) -> Iterator[Row]:
        if self.ended:
            return
        now = int(row.ts.timestamp() * 1000)
        silence = SILENCE_MS.get(self.mode)
        if silence and self.chunks and now - self.last_ms > silence:
            yield from self._after_silence()
        self.rate = row.rate or self.rate
        if row.payload:
            self.chunks.append(bytes(row.payload))
            self.last_ms, self.seq = now, row.seq
            if self.mode == "direct":
                done = self._given("partial", row.seq)
                yield done
                if done.transcript.strip():
                    self._clear()
        if row.kind == "flush" and self.mode == "flush":
            yield self._given("data", row.seq)
            self._clear()
        elif row.kind == "start":
            self._clear()
            known = row.model is None or not self.models or row.model in self.models
            yield self._event("ready" if known else "error", row.seq)
            self.ended = not known
        elif row.kind == "stop":
            self._clear()
            yield self._event("done", row.seq)
            self.ended = True
        if self.ended:
            self.last_ms = now

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self._load(key)
        for row in sorted(rows, key=lambda r: r.seq):
            yield from self._message(row)
        self._store()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._load(key)
        if self.ended:
            self.held.clear()
            self.facts.clear()
            return
        yield from self._after_silence()
        self.timer = 0
        self._store()

    def close(self) -> None:
        pass


def live_sessions(stream: DataFrame, mode: str = "flush", transcribe: Callable[[list[bytes], int], str] = as_text, models: tuple[str, ...] = (), late: str = "10 seconds") -> DataFrame:
    """EVENT rows of a stream of SESSION rows, in append mode; the query needs the RocksDB state store (`streams.ROCKSDB`)."""
    kept = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("session")
    return kept.transformWithState(LiveSession(mode, transcribe, models), EVENT, "append", "EventTime")


CHUNKS = "call_id string, seq long, db array<double>"
TURN = "call_id string, seq long, start_sec double, end_sec double, is_final boolean, too_short boolean, speaker string"
#: Seconds of silence that end a turn, the gap that parts two spans, the pad on both sides, the least span and tail.
TURN_SILENCE, GAP, PAD, LEAST_SPAN, LEAST_TAIL, LEAST_STEP = 1.0, 0.4, 0.1, 0.05, 0.1, 0.01


def segmented(db: np.ndarray, state: tuple, frame: float, threshold: float) -> tuple[tuple, tuple | None]:
    """State after a chunk's loudness, and (start, end, final, spans) of the last span of speech after the last final turn, or None.

    state: frames so far, end of the last final turn, number of spans since, first and last loud frame of the last of them.
    It is all that cutting the whole tail into spans anew would need: a new loud frame lengthens the last span if it is less
    than GAP after it, else it begins another.
    """
    frames, done, spans, first, last = state
    loud = np.flatnonzero(db >= threshold) + frames
    loud = loud[loud * frame >= done - 1e-9]
    frames += len(db)
    if len(loud):
        apart = np.diff(np.concatenate([[last if spans else loud[0]], loud])) - 1
        starts = np.flatnonzero(apart * frame >= GAP - 1e-9)
        spans, first = (spans + len(starts), int(loud[starts[-1]])) if len(starts) else (spans, first)
        if not state[2]:
            spans, first = spans + 1, first if len(starts) else int(loud[0])
        last = int(loud[-1])
    now = frames * frame
    if not spans or now - done < LEAST_TAIL - 1e-9:
        return (frames, done, spans, first, last), None
    start, end = max(done, first * frame - PAD), min(now, (last + 1) * frame + PAD)
    if end <= done + LEAST_STEP:
        return (frames, done, spans, first, last), None
    final = now - end >= TURN_SILENCE - 1e-9
    out = (start, end, final, spans)
    return (frames, end, 0, 0, 0) if final else (frames, done, spans, first, last), out


def turn_finals(stream: DataFrame, frame: float = 0.02, threshold: float = -40.0) -> DataFrame:
    """TURN rows of a stream of CHUNKS (loudness by frame): each chunk gives the last span of speech, partial until TURN_SILENCE after it."""

    def ended(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, out = state.get if state.exists else (0, 0.0, 0, 0, 0), []
        for seq, db in sorted(((s, d) for part in frames for s, d in zip(part["seq"], part["db"], strict=True)), key=lambda x: x[0]):
            now, span = segmented(np.asarray(db if db is not None else [], float), now, frame, threshold)
            if span:
                start, end, final, spans = span
                out.append((key[0], seq, start, end, final, end - start <= LEAST_SPAN, f"Speaker {2 - spans % 2}"))
        state.update(now)
        yield pd.DataFrame(out, columns=["call_id", "seq", "start_sec", "end_sec", "is_final", "too_short", "speaker"])

    return stream.groupBy("call_id").applyInPandasWithState(ended, TURN, "frames long, done double, spans int, first long, last long", "append", GroupStateTimeout.NoTimeout)
