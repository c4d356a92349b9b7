"""Queries that run a stream to its end and read back what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hippospark.functions.storage import shared_dir
from hippospark.streaming import sessions
from hippospark.streaming.engine import session_events, situations

from .bindings import table
from .common import Queries

q = Queries()
QUERIES, ORACLES = q.queries, q.oracles


def through(spark: SparkSession, d: str, name: str, work) -> DataFrame:
    """Read a table as a stream, apply work, and read the batches that were written."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, d, name).schema
    out = work(spark.readStream.schema(schema).parquet(f"{d}/{name}.parquet*"))
    sessions.run_to_end(out, lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}"), f"{root}/checkpoint")
    return spark.read.schema(out.schema).option("recursiveFileLookup", True).parquet(f"{root}/out")


@q("SELECT event_type, count(DISTINCT (user_id, CAST(ts AS DATE))) AS user_days FROM events GROUP BY 1")
def streaming_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Each user, type and day once; keys repeat within a day, so the ledger need not remember longer."""
    def work(s: DataFrame) -> DataFrame:
        key = F.concat_ws("|", "user_id", "event_type", F.to_date("ts"))
        return sessions.ledger(s.select("event_type", F.col("ts").cast("timestamp").alias("ts"), key.alias("key")), "key", "ts").select("event_type", "key")

    return through(spark, d, "events", work).groupBy("event_type").agg(F.count("*").alias("user_days"))


@q("""WITH RECURSIVE m AS (SELECT CAST(user_id AS VARCHAR) AS k, list_sort(list_distinct(list(epoch_us(ts) // 1000))) AS t FROM events GROUP BY 1), z AS (SELECT max(epoch_us(ts) // 1000) AS z FROM events),
s AS (SELECT k, CAST(1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS waiting, CAST(1 AS BIGINT) AS threshold, CAST(0 AS BIGINT) AS run, CAST(NULL AS BIGINT) AS last, CAST(NULL AS BIGINT) AS idle, CAST(NULL AS BIGINT) AS layer, CAST(NULL AS BIGINT) AS done, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS BIGINT) AS at_ms, CAST(0 AS BIGINT) AS messages FROM m
UNION ALL SELECT k, CASE a WHEN 'row' THEN i + 1 ELSE i END,
  CASE a WHEN 'row' THEN CASE WHEN fires THEN 0 ELSE waiting + 1 END WHEN 'idle' THEN 0 WHEN 'evict' THEN 0 ELSE waiting END,
  CASE WHEN a = 'row' AND fires THEN least(5, threshold * 2) WHEN a = 'evict' THEN 1 ELSE threshold END,
  CASE WHEN ran THEN run + 1 WHEN a = 'evict' THEN 0 ELSE run END,
  CASE a WHEN 'row' THEN nxt WHEN 'evict' THEN NULL ELSE last END,
  CASE WHEN a = 'row' AND NOT fires THEN nxt + 600000 WHEN a IN ('row', 'idle', 'evict') THEN NULL ELSE idle END,
  CASE WHEN ran THEN least(coalesce(layer, greatest(moment + 90000, coalesce(done + 900000, 0))), greatest(moment + 90000, coalesce(done + 900000, 0))) WHEN a = 'second' THEN moment + 3600000 WHEN a IN ('stop', 'evict') THEN NULL ELSE layer END,
  CASE a WHEN 'second' THEN moment WHEN 'evict' THEN NULL ELSE done END,
  CASE WHEN a <> 'row' THEN a WHEN fires THEN 'count' END, moment, CASE WHEN a = 'row' AND fires THEN waiting + 1 WHEN a = 'idle' THEN waiting ELSE 0 END
FROM (SELECT *, a = 'idle' OR a = 'row' AND fires AS ran FROM (SELECT *, CASE WHEN due > coalesce(nxt, z) THEN 'row' WHEN due = idle THEN 'idle' WHEN due = layer THEN CASE WHEN due - last >= 86400000 THEN 'stop' ELSE 'second' END ELSE 'evict' END AS a, CASE WHEN due > coalesce(nxt, z) THEN nxt ELSE due END AS moment, waiting + 1 >= threshold AS fires
  FROM (SELECT s.*, m.t[s.i] AS nxt, z, least(coalesce(idle, 4611686018427387903), coalesce(layer, 4611686018427387903), coalesce(last + 259200000, 4611686018427387903)) AS due FROM s JOIN m USING (k), z) WHERE nxt IS NOT NULL OR due <= z)))
SELECT k AS session_key, kind, at_ms, CASE WHEN kind = 'evict' THEN 0 ELSE run END AS run, messages FROM s WHERE kind IS NOT NULL""")
def session_engine(spark: SparkSession, d: str) -> DataFrame:
    """Page events as a session's messages; runs by count and idleness, the second layer, stops and evictions."""
    def work(s: DataFrame) -> DataFrame:
        return session_events(s.select(F.col("user_id").cast("string").alias("session_key"), F.col("event_id").alias("record_id"), F.col("ts").cast("timestamp").alias("ts")))

    return through(spark, d, "events", work).select("session_key", "kind", "at_ms", F.when(F.col("kind") == "evict", 0).otherwise(F.col("run")).alias("run"), "messages")


@q("""WITH t AS (SELECT 'u' || user_id AS s, event_id AS n, event_type AS tool, 'f' || (event_id % 11) AS file, CASE WHEN event_id % 3 = 0 THEN 'E' || (event_id % 7) END AS err FROM events),
l AS (SELECT s, 'file' AS kind, file AS v, max(n) AS n FROM t GROUP BY 1, 3 UNION ALL SELECT s, 'tool', tool, max(n) FROM t GROUP BY 1, 3 UNION ALL SELECT s, 'err', err, max(n) FROM t WHERE err IS NOT NULL GROUP BY 1, 3), r AS (SELECT *, row_number() OVER (PARTITION BY s, kind ORDER BY n DESC, v) AS p FROM l)
SELECT s AS session_key, coalesce(list(v ORDER BY p DESC) FILTER (kind = 'file' AND p <= 5), []) AS files, coalesce(list(v ORDER BY p DESC) FILTER (kind = 'err' AND p <= 5), []) AS errors, coalesce(list(v ORDER BY p DESC) FILTER (kind = 'tool' AND p <= 8), []) AS tools FROM r GROUP BY 1""")
def streaming_situations(spark: SparkSession, d: str) -> DataFrame:
    """Page events as tool events, folded into each session's situation; its last one."""
    k = F.col("event_id")

    def work(s: DataFrame) -> DataFrame:
        errors = F.when(k % 3 == 0, F.array(F.concat(F.lit("E"), k % 7))).otherwise(F.array().cast("array<string>"))
        return situations(s.select(F.concat(F.lit("u"), "user_id").alias("session_key"), k.alias("seq"), F.col("event_type").alias("tool"), F.concat(F.lit("f"), k % 11).alias("file"), errors.alias("errors")))

    last = through(spark, d, "events", work).groupBy("session_key").agg(F.max_by(F.struct("files", "errors", "tools"), "seq").alias("x"))
    return last.select("session_key", "x.*")


@q("SELECT user_id AS session_key, CASE WHEN n < 1 THEN 0 WHEN n < 3 THEN 1 WHEN n < 7 THEN 2 ELSE 3 + (n - 7) // 5 END AS runs FROM (SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS n FROM events GROUP BY 1)")
def threshold_trigger_state(spark: SparkSession, d: str) -> DataFrame:
    """How often each session's runs fired."""
    out = through(spark, d, "events", lambda s: sessions.triggers(s.select(F.col("user_id").cast("string").alias("session_key"))))
    return out.groupBy("session_key").agg(F.max("run").alias("runs"))


@q("SELECT 'conv_' || conv_id AS session_key, count(*) AS n FROM conversations GROUP BY 1")
def streaming_capture(spark: SparkSession, d: str) -> DataFrame:
    """X1."""
    def work(s: DataFrame) -> DataFrame:
        return sessions.captured(s.select(F.concat(F.lit("conv_"), "conv_id").alias("session_key"), F.col("turn").alias("ts_ms"), "role"))

    return through(spark, d, "conversations", work).groupBy("session_key").agg(F.count("*").alias("n"))
