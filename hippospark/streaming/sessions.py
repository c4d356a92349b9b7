"""Session pipelines on Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hippospark.functions.commits import Versions
from hippospark.functions.storage import remove


def captured(messages: DataFrame, session: str = "session_key", ts: str = "ts_ms", floor: int = -(1 << 62), ttl_ms: int | None = None) -> DataFrame:
    """Per session only rows later than the last one captured, and than the floor at the start; late rows are dropped. The cursor is
    keyed state, which goes after ttl_ms without a row; a session that comes back then begins at the floor."""
    schema = messages.schema
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout

    def each(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        cursor = state.get[0] if state.exists else floor
        last = cursor
        for rows in batches:
            rows = rows[rows[ts] > cursor]
            if len(rows):
                last = max(last, int(rows[ts].max()))
                yield rows
        state.update((last,))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)

    return messages.groupBy(session).applyInPandasWithState(each, schema, "cursor long", "append", timeout)


def triggers(messages: DataFrame, every: int = 5, idle_ms: int | None = None, session: str = "session_key") -> DataFrame:
    """A run fires after 1, 2, 4, ... and then every `every` messages of a session, and when it falls idle."""
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout

    def each(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, threshold, runs = state.get if state.exists else (0, 1, 0)
        out = []
        if state.hasTimedOut:
            if waiting:
                out.append((key[0], runs + 1, waiting, "idle"))
            state.update((0, threshold, runs + bool(waiting)))
        else:
            for rows in batches:
                waiting += len(rows)
                while waiting >= threshold:  # one step per run, not per message
                    runs += 1
                    out.append((key[0], runs, threshold, "count"))
                    waiting, threshold = waiting - threshold, min(every, threshold * 2)
            state.update((waiting, threshold, runs))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["session_key", "run", "messages", "reason"])

    return messages.groupBy(session).applyInPandasWithState(each, "session_key string, run long, messages long, reason string", "waiting long, threshold long, runs long", "append", timeout)


def idle_sessions(messages: DataFrame, ts: str = "ts", session: str = "session_key", gap: str = "600 seconds", late: str = "10 minutes") -> DataFrame:
    """X3 in event time: sessions that a gap closes, behind a watermark."""
    return messages.withWatermark(ts, late).groupBy(session, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("messages")).select(session, F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "messages")


def ledger(messages: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """Each key once."""
    return messages.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def run_to_end(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Everything that is there now, then stop; a restart goes on at the checkpoint.

    write(batch, number) must replace what it wrote for that number before, so that a repeated batch leaves one copy.
    """
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Retries:
    """Batches that fail are kept and tried again when their time has come, by whichever batch comes next; after so many tries
    they go to the dead letters. The stream never waits for them, and the cursor stands before the first that is open.

    process must replace what it wrote for a batch's number before. clock: seconds. A line of state per open batch.
    """

    def __init__(self, spark: SparkSession, root: str, process: Callable[[DataFrame, int], None], wait: float = 30.0, tries: int = 5, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.process, self.wait, self.tries, self.clock = spark, root.rstrip("/"), process, wait, tries, clock
        self.versions = Versions(spark, f"{self.root}/state")

    def state(self) -> dict:
        """Open batches by number (tries, due time), dead ones, and the last number seen."""
        return self.versions.last()[1] or {"open": {}, "dead": [], "last": -1}

    def cursor(self) -> int:
        """The number up to which every batch is done with: worked off, or dead."""
        s = self.state()
        return min((int(n) - 1 for n in s["open"]), default=s["last"])

    def dead_letters(self) -> list[str]:
        """Folders of the rows of dead batches."""
        return [f"{self.root}/rows/batch={n}" for n in self.state()["dead"]]

    def _try(self, rows: DataFrame, number: int, s: dict) -> None:
        tried = s["open"].pop(str(number), [0, 0])[0] + 1
        try:
            self.process(rows, number)
            remove(self.spark, f"{self.root}/rows/batch={number}")
        except Exception:
            if tried >= self.tries:
                s["dead"].append(number)
            else:
                s["open"][str(number)] = [tried, self.clock() + self.wait]

    def due(self) -> None:
        """Try again what is due."""
        number, s = self.versions.last()
        ready = sorted(int(n) for n, (_, at) in (s or {"open": {}})["open"].items() if at <= self.clock())
        for n in ready:
            self._try(self.spark.read.parquet(f"{self.root}/rows/batch={n}"), n, s)
        if ready:
            self.versions.put(number + 1, s)

    def write(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch. The rows are kept before they are worked on: a failure loses none, and a repeated batch is the same."""
        self.due()
        version, s = self.versions.last()
        s = s or {"open": {}, "dead": [], "last": -1}
        if number <= s["last"]:
            return  # a restart brings the last batch again: it is done, open or dead
        batch.write.mode("overwrite").parquet(f"{self.root}/rows/batch={number}")
        self._try(self.spark.read.schema(batch.schema).parquet(f"{self.root}/rows/batch={number}"), number, s)
        s["last"] = number
        self.versions.put(version + 1, s)


def quarantining(process: Callable[[DataFrame], None], dead_letters: str, tries: int = 3) -> Callable[[DataFrame, int], None]:
    """X10 without waiting: a batch that fails `tries` times at once goes to the dead letters, and the stream goes on."""

    def write(batch: DataFrame, number: int) -> None:
        for attempt in range(tries):
            try:
                process(batch)
                return
            except Exception:
                if attempt == tries - 1:
                    batch.write.mode("overwrite").parquet(f"{dead_letters}/batch={number}")

    return write


def next_run(now: Column, last_run: Column, scheduled: Column, delay: int = 90, least: int = 900) -> Column:
    """When a session's second layer runs after an extraction: a delay from now, no sooner than the least interval after its last run,
    and only ever earlier than what is scheduled. Times in seconds; nulls where there is none."""
    wanted = F.greatest(now + delay, F.coalesce(last_run + least, F.lit(0)))
    return F.when(scheduled.isNull() | (wanted < scheduled), wanted).otherwise(scheduled)


def run_due(now: Column, scheduled: Column, last_run: Column, most: int = 3600) -> Column:
    """A scheduled time that has come, or the largest interval since the last run."""
    return F.coalesce(scheduled <= now, F.lit(False)) | F.coalesce(now - last_run >= most, F.lit(False))


def session_fate(now: Column, last_active: Column, queued: Column, buffered: Column, window: int = 86_400) -> Column:
    """Cold sessions (inactive for a window) stop; after three windows their state goes, unless they have work."""
    idle = now - last_active
    return F.when((idle >= 3 * window) & ~queued & (buffered == 0), "evict").when(idle >= window, "stop").otherwise("active")


def persona_trigger(requested: Column, scenes: Column, last_persona: Column, has_scenes: Column, has_body: Column, memories: Column, interval: int = 50) -> Column:
    """Why a persona is to be written, null if it is not: a request, a cold start, a lost body, the first scene, enough memories."""
    return (
        F.when(requested, "request").when((scenes > 0) & (last_persona == 0) & has_scenes, "cold start").when((last_persona > 0) & has_scenes & ~has_body, "recovery")
        .when((scenes == 1) & (memories > 0), "first scene").when(memories >= interval, "threshold")
    )


class Progress(StreamingQueryListener):
    """The latest progress of every query, and those whose last batch was slow."""

    def __init__(self, slow_ms: int = 5_000):
        self.slow_ms, self.latest, self.slow, self.ended = slow_ms, {}, [], {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.latest[str(event.id)] = None

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.latest[str(p.id)] = {"batch": p.batchId, "rows": p.numInputRows, "ms": p.batchDuration}
        if p.batchDuration >= self.slow_ms:
            self.slow.append((str(p.id), p.batchId, p.batchDuration))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended[str(event.id)] = event.exception
