"""The session engine against a plain simulation, however the stream is cut, and over restarts."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hippospark.operators import lookups
from hippospark.streaming import sessions
from hippospark.streaming.engine import NEVER, Session, SessionEngine, Times, fire, session_events, situations

TIMES = Times(idle=600_000, delay=90_000, least=900_000, most=3_600_000, window=14_400_000)
START = 1_700_000_000_000


def simulated(rows, end, every=5, floor=0):
    """Step by step, second by second of what can happen: rows (session, at, record) in order of arrival; end: how far time goes."""
    out = []
    for key in sorted({r[0] for r in rows}):
        state, mine = None, sorted((at, rec) for k, at, rec in rows if k == key)
        cursor = floor
        for at, rec in [*mine, (end, None)]:
            if rec is not None and at <= cursor:
                continue
            while state:
                times = {"1idle": state["last"] + TIMES.idle if state["held"] else None, "2second": state["second"], "3evict": state["last"] + 3 * TIMES.window}
                when, what = min((t, w) for w, t in times.items() if t is not None)
                if when > at:
                    break
                if what == "1idle":
                    state["runs"] += 1
                    out.append((key, "idle", when, state["runs"], len(state["held"]), state["held"]))
                    state["held"] = []
                    wanted = max(when + TIMES.delay, state["done"] + TIMES.least if state["done"] else 0)
                    state["second"] = wanted if state["second"] is None else min(wanted, state["second"])
                elif what == "2second" and when - state["last"] >= TIMES.window:
                    out.append((key, "stop", when, state["runs"], 0, []))
                    state["second"] = None
                elif what == "2second":
                    out.append((key, "second", when, state["runs"], 0, []))
                    state["done"], state["second"] = when, when + TIMES.most
                else:
                    out.append((key, "evict", when, state["runs"], 0, []))
                    state = None
            if rec is None:
                continue
            cursor = at
            state = state or {"held": [], "runs": 0, "second": None, "done": None, "need": 1, "last": None}
            state["last"] = at
            state["held"] = [*state["held"], rec]
            if len(state["held"]) >= state["need"]:
                state["runs"] += 1
                out.append((key, "count", at, state["runs"], len(state["held"]), state["held"]))
                state["held"], state["need"] = [], min(every, 2 * state["need"])
                wanted = max(at + TIMES.delay, state["done"] + TIMES.least if state["done"] else 0)
                state["second"] = wanted if state["second"] is None else min(wanted, state["second"])
    return sorted(out)


def messages(seed):
    rng = random.Random(seed)
    rows, at = [("d", START + 1, "only")], START + 2
    for i in range(160):
        at += rng.choice([1_000, 20_000, 500_000, 2_000_000, 30_000_000 if i % 9 == 0 else 1_000])
        rows.append((rng.choice("abc"), at, f"m{i:03d}"))
    return rows


def run(spark, folder, batches, out, **more):
    """Each batch as a file of its own, and the stream to its end after each of them: a restart from the checkpoint every time."""
    schema = "session_key string, record_id string, ts timestamp"
    for rows in batches:
        df = spark.createDataFrame([(k, rec, at) for k, at, rec in rows], "session_key string, record_id string, at long").select("session_key", "record_id", F.timestamp_millis("at").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = session_events(spark.readStream.schema(schema).parquet(f"{folder}/in"), TIMES, **more)
        sessions.run_to_end(stream, lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"), f"{folder}/checkpoint")
    got = spark.read.option("recursiveFileLookup", True).parquet(out).collect()
    return sorted((r["session_key"], r["kind"], r["at_ms"], r["run"], r["messages"], list(r["records"])) for r in got)


@pytest.mark.parametrize("cuts", [[], [40, 41, 120]])
def test_engine(spark, tmp_path, cuts):
    rows = messages(2)
    edges = [0, *cuts, len(rows)]
    batches = [rows[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True)]
    got = run(spark, f"file://{tmp_path}", batches, f"file://{tmp_path}/out")
    # timers have fired up to the latest message of any session
    assert got == simulated(rows, rows[-1][1])
    assert {r[1] for r in got} == {"count", "idle", "second", "stop", "evict"}


def test_a_long_wait_is_one_step():
    """The second layer's times between two messages come without a look at all due times for each of them."""
    s = Session(START, last=START, second_at=START + 1)
    looks, due = [], Session.due
    s.due = lambda times: looks.append(1) or due(s, times)
    got = list(fire(s, [], START + 3 * TIMES.window - 1, TIMES))
    assert [x[1] for x in got] == [START + 1, START + 1 + TIMES.most, START + 1 + 2 * TIMES.most, START + 1 + 3 * TIMES.most, START + 1 + 4 * TIMES.most] and [x[0] for x in got] == ["second"] * 4 + ["stop"]
    assert len(looks) == 3 and s.second_at == NEVER and s.second_last == START + 1 + 3 * TIMES.most


def test_state_is_called_no_more_than_it_changes():
    """A session without waiting messages leaves its list alone: every call of the state is a message to the JVM."""
    calls = []

    class State:
        def __init__(self, name):
            self.name, self.held = name, None

        def __getattr__(self, what):
            def call(*x):
                calls.append((self.name, what))
                self.held = {"update": x[0] if x else None, "put": x[0] if x else None, "clear": None}.get(what, self.held)
                return self.held

            return call

    engine = SessionEngine(TIMES, 5, -NEVER)
    engine.value, engine.waiting, engine.handle = State("value"), State("list"), State("handle")
    feed = lambda *rows: [x for f in engine.handleInputRows(("k",), iter([pd.DataFrame(rows, columns=["at_ms", "record"])]), None) for x in f.to_dict("records")]
    assert [(r["kind"], list(r["records"])) for r in feed((START, "a"))] == [("count", ["a"])]
    assert calls == [("value", "get"), ("handle", "registerTimer"), ("value", "update")]
    calls.clear()
    assert feed((START + 1, "b")) == [] and [c for c in calls if c[0] == "list"] == [("list", "put")]
    calls.clear()
    assert [(r["kind"], list(r["records"])) for r in feed((START + 2, "c"))] == [("count", ["b", "c"])]
    assert [c for c in calls if c[0] == "list"] == [("list", "get"), ("list", "clear")]


def test_late_messages_and_the_floor(spark, tmp_path):
    early = [("a", START - 5, "before"), ("a", START + 1_000, "one"), ("b", START + 2_000, "two"), ("a", START + 9_000, "three"), ("a", START + 9_000, "twin")]
    late = [("a", START + 9_000, "again"), ("b", START + 9_500, "four")]
    got = run(spark, f"file://{tmp_path}", [early, late], f"file://{tmp_path}/out", floor_ms=START)
    assert [(r[0], r[1], r[5]) for r in got] == [("a", "count", ["one"]), ("b", "count", ["two"])]
    assert got == simulated([r for r in early + late if r[2] not in ("again", "twin")], START + 9_500, floor=START)


def test_situations_over_batches(spark, tmp_path):
    """The state after several batches and restarts is the situation over all rows, late and repeated ones included."""
    rng = random.Random(7)
    rows = [("ab"[rng.randrange(2)], i, rng.choice(["Read", "Edit", "", None, "Bash"] + [f"t{j}" for j in range(9)]), rng.choice(["", None] + [f"f{j}" for j in range(9)]), [f"E{rng.randrange(8)}" for _ in range(rng.randrange(3))]) for i in range(60)]
    rows[10], rows[50] = rows[50], rows[10]
    schema = "session_key string, seq long, tool string, file string, errors array<string>"
    for part in (rows[:20], rows[20:21], rows[21:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = situations(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        sessions.run_to_end(stream, lambda batch, number: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}"), f"{tmp_path}/checkpoint")
    got = {r["session_key"]: (r["batch"], r) for r in sorted(spark.read.parquet(f"{tmp_path}/out").collect(), key=lambda r: r["batch"])}
    want = {r["session_key"]: r for r in lookups.recent_situation(spark.createDataFrame(rows, schema)).collect()}
    assert {k: (list(x["files"]), list(x["errors"]), list(x["tools"])) for k, (_, x) in got.items()} == {k: (list(x["files"]), list(x["errors"]), list(x["tools"])) for k, x in want.items()}
