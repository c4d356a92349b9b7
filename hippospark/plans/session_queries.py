"""Queries over message and event logs: cursors, windows, rounds, health, budgets, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hippospark.functions import scalar as S
from hippospark.operators import windows as W

from .bindings import BASE_MS, DAY_MS, EVENTS_SQL, L0_SQL, epoch_s, kb_events, l0_messages, table
from .common import Queries

q = Queries()
QUERIES, ORACLES = q.queries, q.oracles
CURSOR = BASE_MS + 5 * DAY_MS


@q(f"WITH {L0_SQL} SELECT record_id, ts_ms FROM l0 WHERE ts_ms > {CURSOR} OR (ts_ms = {CURSOR} AND turn > 0) ORDER BY ts_ms, turn LIMIT 50")
def l0_incremental_cursor(spark: SparkSession, d: str) -> DataFrame:
    """S2, X12."""
    return W.incremental(l0_messages(spark, d), "ts_ms", "turn", CURSOR, 0, 50).select("record_id", "ts_ms")


@q(f"WITH {L0_SQL} SELECT record_id FROM l0 WHERE record_id > 'conv_1' ORDER BY record_id LIMIT 40")
def keyset_cursor(spark: SparkSession, d: str) -> DataFrame:
    """S4, S5."""
    return W.keyset(l0_messages(spark, d).select("record_id"), "record_id", "conv_1", 40)


@q(f"""WITH {L0_SQL}, w AS (SELECT session_key, turn, (row_number() OVER (PARTITION BY session_key ORDER BY turn) - 1) // 10 AS win FROM l0)
SELECT session_key, CAST(win AS BIGINT) AS "window", count(*) AS messages, min(turn) AS first, max(turn) AS last, CAST(least(5, win * 10) AS BIGINT) AS background FROM w GROUP BY session_key, win""")
def message_windows(spark: SparkSession, d: str) -> DataFrame:
    """W3, W11."""
    return W.message_windows(l0_messages(spark, d), "session_key", "turn")


@q(f"""WITH {L0_SQL}, f AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY session_key ORDER BY turn) = 'assistant' AND role = 'user' THEN 1 ELSE 0 END AS b FROM l0)
SELECT session_key, turn, CAST(sum(b) OVER (PARTITION BY session_key ORDER BY turn) AS BIGINT) AS round FROM f""")
def turn_rounds(spark: SparkSession, d: str) -> DataFrame:
    """W4, S14."""
    return W.rounds(l0_messages(spark, d), "session_key", "turn").select("session_key", "turn", "round")


@q("WITH g AS (SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2) SELECT user_id, event_type, event_id FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3")
def recent_unique(spark: SparkSession, d: str) -> DataFrame:
    """W8, W9."""
    return W.recent_unique(table(spark, d, "events"), "user_id", "event_id", "event_type", 3).select("user_id", "event_type", "event_id")


@q(f"""WITH {L0_SQL}, t AS (SELECT session_key, turn, CAST(ceil(length(message_text) / 4.0) AS BIGINT) AS tokens FROM l0), c AS (SELECT *, sum(tokens) OVER (PARTITION BY session_key ORDER BY turn) AS upto, sum(tokens) OVER (PARTITION BY session_key) AS total FROM t)
SELECT session_key, count(*) FILTER (upto - tokens < total * 0.5) AS "drop", CAST(max(total) AS BIGINT) AS total FROM c GROUP BY 1""")
def prefix_token_budget(spark: SparkSession, d: str) -> DataFrame:
    """W12, O3."""
    m = l0_messages(spark, d).withColumn("tokens", F.ceil(F.char_length("message_text") / 4).cast("long"))
    return W.prefix_budget(m, "session_key", "turn", "tokens", 0.5)


@q("""WITH s AS (SELECT user_id, least(CAST(floor(value) AS BIGINT) % 9, 7) AS step FROM events WHERE CAST(floor(value) AS BIGINT) % 9 >= 1), n AS (SELECT user_id, step, count(*) AS n FROM s GROUP BY 1, 2),
u AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY step DESC) AS upto FROM n) SELECT user_id, coalesce(max(CASE WHEN upto >= 10 THEN step END), 1) AS threshold, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY 1""")
def score_cascade(spark: SparkSession, d: str) -> DataFrame:
    """W13, O2, A22."""
    e = table(spark, d, "events").select("user_id", (F.floor("value") % 9).cast("long").alias("score"))
    return W.score_cascade(e, "user_id", "score")


@q("""WITH m AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS tt, event_type FROM events), a AS (SELECT user_id, max(tt) AS lm, min(tt) AS fm, max(CASE WHEN event_type = 'purchase' THEN tt END) AS le FROM m GROUP BY 1), n AS (SELECT max(tt) AS now FROM m)
SELECT user_id, lm AS last_message, CAST(floor((lm - coalesce(le, fm)) / 3600.0 + 0.5) AS BIGINT) AS lag_hours, (lm >= now - 259200 AND lm - coalesce(le, fm) > 129600) AS stale FROM a, n""")
def memory_health(spark: SparkSession, d: str) -> DataFrame:
    """Purchases stand for what was extracted."""
    e = table(spark, d, "events").select("user_id", epoch_s("ts").alias("at"), "event_type")
    now = e.agg(F.max("at")).first()[0] or 0
    return W.health(e, e.where("event_type = 'purchase'"), "user_id", now)


@q("WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS tt, event_id FROM events), g AS (SELECT *, CASE WHEN tt - lag(tt) OVER (PARTITION BY user_id ORDER BY tt, event_id) <= 600 THEN 0 ELSE 1 END AS fresh FROM e), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY tt, event_id) AS sess FROM g) SELECT user_id, min(tt) AS begins, max(tt) AS last, count(*) AS n FROM s GROUP BY user_id, sess")
def session_gap_windows(spark: SparkSession, d: str) -> DataFrame:
    """Spark's own session windows."""
    e = table(spark, d, "events").select("user_id", "ts")
    e = e.withColumn("ts", F.date_trunc("second", "ts"))
    g = e.groupBy("user_id", F.session_window("ts", "600 seconds").alias("w")).agg(F.min("ts").alias("b"), F.max("ts").alias("l"), F.count("*").alias("n"))
    return g.select("user_id", epoch_s("b").alias("begins"), epoch_s("l").alias("last"), "n")


@q("SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    g = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(epoch_s("w.start").alias("hour"), "event_type", "n", "total")


@q("WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) SELECT user_id, event_id, k FROM p WHERE k IN (1, 3, 7, 12) OR (k > 12 AND (k - 12) % 5 = 0)")
def threshold_triggers(spark: SparkSession, d: str) -> DataFrame:
    """Runs fire after 1, 2, 4, then every 5 conversations."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    e = table(spark, d, "events").select("user_id", "event_id", k.alias("k"))
    return e.where(F.col("k").isin(1, 3, 7, 12) | ((F.col("k") > 12) & ((F.col("k") - 12) % 5 == 0)))


@q(f"WITH {L0_SQL} SELECT session_key, max(turn) AS last_user FROM l0 WHERE role = 'user' GROUP BY 1")
def last_user_message(spark: SparkSession, d: str) -> DataFrame:
    """W14."""
    return W.last_of_role(l0_messages(spark, d), "session_key", "turn").withColumnRenamed("last", "last_user")


@q("WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS tt, event_id, event_type FROM events) SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY tt, event_id) AS boundary FROM e")
def boundary_asof(spark: SparkSession, d: str) -> DataFrame:
    """The latest boundary up to each row, by a running last value."""
    mark = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return W.last_boundary(table(spark, d, "events"), "user_id", [epoch_s("ts"), F.col("event_id")], mark).select("event_id", "boundary")


@q("SELECT conv_id, count(*) AS turns, count(*) FILTER (text IS NULL OR trim(text) = '') AS blank, bool_or(role NOT IN ('user', 'assistant')) AS odd_role FROM conversations GROUP BY 1")
def seed_validation(spark: SparkSession, d: str) -> DataFrame:
    """P26."""
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("blank"), F.bool_or(~F.col("role").isin("user", "assistant")).alias("odd_role"))


@q("SELECT conv_id, CAST(sum(ceil(length(text) / 4.0)) + ceil(0.5 * count(*)) AS BIGINT) AS tokens, CASE WHEN sum(ceil(length(text) / 4.0)) + ceil(0.5 * count(*)) >= 950 THEN 'emergency' WHEN sum(ceil(length(text) / 4.0)) + ceil(0.5 * count(*)) >= 850 THEN 'aggressive' WHEN sum(ceil(length(text) / 4.0)) + ceil(0.5 * count(*)) >= 500 THEN 'mild' ELSE 'none' END AS route FROM conversations GROUP BY 1")
def context_route(spark: SparkSession, d: str) -> DataFrame:
    """O1, M37, O11."""
    from hippospark.operators.offload import route

    g = table(spark, d, "conversations").groupBy("conv_id").agg((F.sum(F.ceil(F.char_length("text") / 4)) + F.ceil(0.5 * F.count("*"))).cast("long").alias("tokens"))
    return g.withColumn("route", route(F.col("tokens"), 1000))


@q("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    """M35."""
    return table(spark, d, "documents").select("doc_id", S.token_estimate(F.col("text")).alias("tokens"))
