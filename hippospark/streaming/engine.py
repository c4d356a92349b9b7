"""One stream of a session's events: count and idle runs, the second layer, stops and evictions, in event time.

State is a value (cursor, counts, due times) and a list (messages that wait for a run); one timer per session stands at the
earliest due time. Before a message counts, everything that was due by its time happens, so what comes out depends on event
times only, not on how the stream was cut into batches.

X1: messages not later than the session's last one, or than the floor at the start, are dropped. X2, W5: a run after 1, 2, 4
... and then every `every` messages. X3: a run when a session with waiting messages is idle. X6: the second layer runs `delay`
after a run, no sooner than `least` after its last time, a due time only ever moves earlier; while the session is active it
runs every `most` at least. X7: inactive for a window, a session stops; after three windows its state goes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "session_key string, kind string, at_ms long, run long, messages long, records array<string>"
NEVER = (1 << 62) - 1


@dataclass
class Times:
    """Milliseconds."""

    idle: int = 600_000
    delay: int = 90_000
    least: int = 900_000
    most: int = 3_600_000
    window: int = 86_400_000


@dataclass
class Session:
    """The value state; NEVER is no time."""

    cursor: int
    threshold: int = 1
    runs: int = 0
    waiting: int = 0
    last: int = -NEVER
    idle_at: int = NEVER
    second_at: int = NEVER
    second_last: int = -NEVER
    timer: int = NEVER

    def evict_at(self, times: Times) -> int:
        return NEVER if self.last == -NEVER else self.last + 3 * times.window

    def due(self, times: Times) -> tuple[int, str]:
        """The earliest time; of equal ones idleness comes first, eviction last."""
        at, what = (self.idle_at, "idle") if self.idle_at <= self.second_at else (self.second_at, "second")
        end = self.evict_at(times)
        return (at, what) if at <= end else (end, "evict")

    def ran(self, at: int, times: Times) -> None:
        """After a run at this time: the second layer's time moves earlier, or stays."""
        self.runs += 1
        self.second_at = min(self.second_at, max(at + times.delay, self.second_last + times.least))


STATE = ", ".join(f"{f.name} long" for f in fields(Session))


def fire(s: Session, records: list[str], upto: int, times: Times) -> Iterator[tuple]:
    """What is due up to a time, in order: (kind, at, run, messages, records). After an eviction the session is as new."""
    while (due := s.due(times))[0] <= upto:
        at, what = due
        if what == "idle":
            s.ran(at, times)
            yield "idle", at, s.runs, s.waiting, list(records)
            s.waiting, s.idle_at = 0, NEVER
            records.clear()
        elif what == "second" and at - s.last >= times.window:
            s.second_at = NEVER
            yield "stop", at, s.runs, 0, []
        elif what == "second":
            # again and again until something else is due
            n = (min(upto, s.idle_at - 1, s.last + times.window - 1) - at) // times.most + 1
            s.second_at, s.second_last = at + n * times.most, at + (n - 1) * times.most
            yield from zip(repeat("second"), range(at, s.second_at, times.most), repeat(s.runs), repeat(0), repeat([]), strict=False)
        else:
            yield "evict", at, s.runs, 0, []
            for f in fields(Session):
                if f.name not in ("cursor", "timer"):
                    setattr(s, f.name, f.default)


def take(s: Session, records: list[str], at: int, record: str, times: Times, every: int) -> Iterator[tuple]:
    """A message at a time later than the cursor."""
    s.cursor = s.last = at
    s.waiting += 1
    records.append(record)
    if s.waiting >= s.threshold:
        s.ran(at, times)
        yield "count", at, s.runs, s.waiting, list(records)
        s.waiting, s.threshold = 0, min(every, s.threshold * 2)
        records.clear()
    s.idle_at = at + times.idle if s.waiting else NEVER


class SessionEngine(StatefulProcessor):
    def __init__(self, times: Times, every: int, floor: int):
        self.times, self.every, self.floor = times, every, floor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("session", STATE)
        self.waiting = handle.getListState("waiting", "record string")

    # Every call of the state is a message to the JVM: a list is read, written or cleared only where messages wait or did.

    def _load(self) -> tuple[Session, list[str], int]:
        """The session, its waiting messages, and how many these are."""
        held = self.value.get()
        s = Session(self.floor) if held is None else Session(*held)
        return s, [x[0] for x in self.waiting.get()] if s.waiting else [], s.waiting

    def _store(self, s: Session, records: list[str], held: int) -> None:
        due = s.due(self.times)[0]
        if s.timer not in (due, NEVER):
            self.handle.deleteTimer(s.timer)
        if due == NEVER:  # evicted: nothing of the session stays
            self.value.clear()
            if held:
                self.waiting.clear()
            return
        if s.timer != due:
            self.handle.registerTimer(due)
            s.timer = due
        self.value.update(tuple(vars(s).values()))
        if records:
            self.waiting.put([(x,) for x in records])
        elif held:
            self.waiting.clear()

    @staticmethod
    def _frames(key: tuple, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            kinds, at, runs, messages, records = zip(*out, strict=True)
            lists = np.empty(len(out), object)
            lists[:] = records
            yield pd.DataFrame({"session_key": np.full(len(out), key[0], object), "kind": np.array(kinds, object), "at_ms": np.array(at, np.int64), "run": np.array(runs, np.int64), "messages": np.array(messages, np.int64), "records": lists})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        s, records, held = self._load()
        out: list[tuple] = []
        # a session's messages of one batch, by time; what does not follow the last one goes
        batch = [x for part in rows for x in zip(part.at_ms.tolist(), part.record.tolist(), strict=True)]
        for at, record in sorted(batch, key=lambda x: (x[0], x[1] is None, x[1])):
            if at <= s.cursor:
                continue
            out += fire(s, records, at, self.times)
            out += take(s, records, at, record, self.times, self.every)
        self._store(s, records, held)
        yield from self._frames(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        s, records, held = self._load()
        if s.timer == expiredTimerInfo.getExpiryTimeInMs():
            s.timer = NEVER  # it is gone
        out = list(fire(s, records, timerValues.getCurrentWatermarkInMs(), self.times))
        self._store(s, records, held)
        yield from self._frames(key, out)

    def close(self) -> None:
        pass


def session_events(messages: DataFrame, times: Times | None = None, every: int = 5, floor_ms: int = -NEVER, late: str = "0 seconds") -> DataFrame:
    """EVENT rows of a stream of messages (session_key, record_id, ts). Timers fire as the watermark passes, `late` behind the latest
    message of any session. The state store has to keep lists and timers."""
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = messages.withWatermark("ts", late).select("session_key", F.col("record_id").cast("string").alias("record"), "ts", F.unix_millis("ts").alias("at_ms"))
    return rows.groupBy("session_key").transformWithStateInPandas(SessionEngine(times or Times(), every, floor_ms), EVENT, "append", "EventTime")


SITUATION = "session_key string, seq long, files array<string>, errors array<string>, tools array<string>"
#: How many of each a situation holds.
KEPT = {"files": 5, "errors": 5, "tools": 8}


class SituationState(StatefulProcessor):
    """The last files, error signatures and tools of a session, each once, as list state that tool events fold into."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lists = {name: handle.getListState(name, "value string, seq long") for name in KEPT}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = {name: dict(state.get()) if state.exists() else {} for name, state in self.lists.items()}
        for batch in rows:
            for seq, tool, file, errors in zip(batch.seq.tolist(), batch.tool, batch.file, batch.errors, strict=True):
                for name, values in (("files", [file]), ("errors", [] if errors is None else errors), ("tools", [tool])):
                    for v in values:
                        if v:
                            held[name][v] = max(seq, held[name].get(v, seq))
        out = {}
        for name, most in KEPT.items():
            # the latest last; of equal ones the smaller value counts as later
            last = sorted(sorted(held[name].items(), reverse=True), key=lambda x: x[1])[-most:]
            out[name] = [v for v, _ in last]
            if last:
                self.lists[name].put(last)
        seq = max((x for h in held.values() for x in h.values()), default=0)
        yield pd.DataFrame({"session_key": [key[0]], "seq": [seq], **{name: [out[name]] for name in KEPT}})

    def close(self) -> None:
        pass


def situations(tools: DataFrame) -> DataFrame:
    """SITUATION rows of a stream of tool events (session_key, seq, tool, file, errors): a session's situation after each batch that has
    events of it. A value that comes late takes its place by its number."""
    tools.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return tools.select("session_key", "seq", "tool", "file", "errors").groupBy("session_key").transformWithStateInPandas(SituationState(), SITUATION, "update", "None")
