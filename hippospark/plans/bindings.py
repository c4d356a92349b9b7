"""Memory relations as views over the driver's tables, for queries that stand in for memory workloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-01-01T00:00:00Z; conversations lie a day apart, turns a minute.
BASE_MS, DAY_MS, TURN_MS = 1_704_067_200_000, 86_400_000, 60_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_s(ts: str) -> Column:
    """Seconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    t = F.col(ts)
    return F.unix_date(F.to_date(t)) * F.lit(86_400).cast("long") + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def epoch_us(ts: str) -> Column:
    t = F.col(ts)
    minutes = F.unix_date(F.to_date(t)) * F.lit(1440).cast("long") + F.hour(t) * 60 + F.minute(t)
    return minutes * 60_000_000 + (F.date_part(F.lit("SECONDS"), t) * 1_000_000).cast("long")


def l0_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.concat(F.lit("conv_"), "conv_id", F.lit("#"), "turn").alias("record_id"), F.concat(F.lit("conv_"), "conv_id").alias("session_key"), "conv_id", "turn", "role",
        F.col("text").alias("message_text"), (F.lit(BASE_MS) + F.col("conv_id") * DAY_MS + F.col("turn") * TURN_MS).cast("long").alias("ts_ms"),
    )


L0_SQL = f"""l0 AS (SELECT 'conv_' || conv_id || '#' || turn AS record_id, 'conv_' || conv_id AS session_key, conv_id, turn, role, text AS message_text,
  CAST({BASE_MS} + conv_id * {DAY_MS} + turn * {TURN_MS} AS BIGINT) AS ts_ms FROM conversations)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priority of each customer over time, as asserted by orders."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("entity_id"), F.lit("order_priority").alias("attribute"), F.col("o_orderpriority").alias("value"), epoch_s("o_orderdate").alias("valid_from"), F.col("o_orderkey").alias("seq"), F.lit(0.8).alias("confidence"))


FACTS_SQL = "facts AS (SELECT o_custkey AS entity_id, 'order_priority' AS attribute, o_orderpriority AS value, CAST(epoch(o_orderdate) AS BIGINT) AS valid_from, o_orderkey AS seq, CAST(0.8 AS DOUBLE) AS confidence FROM orders)"


def kb_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select("event_id", epoch_us("ts").alias("ts_us"), F.col("user_id").alias("session_key"), F.col("event_type").alias("type"), "value", F.array(F.col("event_type"), F.concat(F.lit("k"), k % 20)).alias("entities"))


EVENTS_SQL = "ev AS (SELECT event_id, CAST(epoch_us(ts) AS BIGINT) AS ts_us, user_id AS session_key, event_type AS type, value, [event_type, 'k' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 20)] AS entities FROM events)"


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per line: the customer that ordered (src) and the part (dst)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer to part, supported by the lines that were ordered."""
    return ordered(spark, sf_dir).groupBy("src", "dst").agg(F.count("*").alias("support"))


RELATIONS_SQL = "rel AS (SELECT 'c' || o_custkey AS src, 'p' || l_partkey AS dst, count(*) AS support FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"


# A knowledge base over the tables: customers are entities (every tenth is merged into the one before), their orders assert
# a priority and a status, page events are what happened, and customers that ordered a part are related to it.
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("c"), k).alias("id"), F.lit("person").alias("type"), F.col("c_name").alias("name"), F.concat(F.lit("person:"), F.lower("c_name")).alias("canonical_key"), F.lit("default").alias("namespace"),
        F.array(F.concat(F.lower("c_mktsegment"), F.lit("-"), k)).alias("aliases"), F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("c_acctbal") / 100)).alias("importance"), k.cast("string").alias("created_time"), k.cast("string").alias("updated_time"),
        F.when(k % 10 == 7, F.concat(F.lit("c"), k - 1)).alias("merged_into"),
    )


ENTITIES_SQL = """ent AS (SELECT 'c' || c_custkey AS id, 'person' AS type, c_name AS name, 'person:' || lower(c_name) AS canonical_key, 'default' AS namespace, [lower(c_mktsegment) || '-' || c_custkey] AS aliases,
  least(100.0, greatest(0.0, c_acctbal / 100)) AS importance, CAST(c_custkey AS VARCHAR) AS created_time, CAST(c_custkey AS VARCHAR) AS updated_time, CASE WHEN c_custkey % 10 = 7 THEN 'c' || (c_custkey - 1) END AS merged_into FROM customer)"""


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    both = F.explode(F.array(F.struct(F.lit("order_priority").alias("attribute"), F.col("o_orderpriority").alias("value")), F.struct(F.lit("status").alias("attribute"), F.col("o_orderstatus").alias("value"))))
    a = o.select(F.concat(F.lit("f"), "o_orderkey").alias("base"), F.concat(F.lit("c"), "o_custkey").alias("entity_id"), both.alias("x"), epoch_s("o_orderdate").alias("valid_from"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 5 / 10 + 0.5).alias("confidence"))
    return a.select(F.concat("base", F.lit("-"), "x.attribute").alias("id"), "entity_id", "x.attribute", "x.value", "valid_from", F.col("seq").alias("learned_at"), "seq", "confidence", F.lit(1).cast("long").alias("support"))


ASSERTIONS_SQL = """asr AS (SELECT 'f' || o_orderkey || '-' || a AS id, 'c' || o_custkey AS entity_id, a AS attribute, CASE WHEN a = 'status' THEN o_orderstatus ELSE o_orderpriority END AS value, CAST(epoch(o_orderdate) AS BIGINT) AS valid_from, o_orderkey AS learned_at,
  o_orderkey AS seq, CAST(o_orderkey % 5 AS DOUBLE) / 10 + 0.5 AS confidence, 1 AS support FROM orders, (SELECT unnest(['order_priority', 'status']) AS a))"""
#: Heads by islands of equal values: the last version of each entity and attribute.
HEADS_SQL = ASSERTIONS_SQL + """, am AS (SELECT *, CASE WHEN lag(value) OVER (PARTITION BY entity_id, attribute ORDER BY valid_from, seq) = value THEN 0 ELSE 1 END AS fresh FROM asr),
ai AS (SELECT *, sum(fresh) OVER (PARTITION BY entity_id, attribute ORDER BY valid_from, seq) AS island FROM am),
av AS (SELECT entity_id, attribute, island, min(value) AS value, min(valid_from) AS valid_from, count(*) AS support, max(confidence) AS confidence, arg_min(seq, (valid_from, seq)) AS seq FROM ai GROUP BY 1, 2, 3),
hd AS (SELECT entity_id, attribute, value, valid_from, CAST(support AS BIGINT) AS support, confidence, seq, entity_id || '/' || attribute AS id FROM av QUALIFY row_number() OVER (PARTITION BY entity_id, attribute ORDER BY island DESC) = 1)"""


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hippospark.operators.kb import fact_versions

    h = fact_versions(assertions(spark, sf_dir)).where("is_head")
    return h.select("entity_id", "attribute", "value", "valid_from", "support", "confidence", "seq", F.concat_ws("/", "entity_id", "attribute").alias("id"))


def happenings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "decision").when(F.col("event_type") == "click", "bug").when(F.col("event_type") == "view", "fix").otherwise("observation")
    k = F.get_json_object("props", "$.k").cast("long") % 20
    return e.select(
        F.concat(F.lit("e"), "event_id").alias("id"), "event_id", epoch_us("ts").alias("ts_us"), F.concat(F.lit("u"), "user_id").alias("session_key"), F.concat(F.lit("u"), "user_id", F.lit("-"), F.col("event_id") % 3).alias("session_id"), F.concat(F.lit("p"), F.col("event_id") % 4).alias("project"),
        kind.alias("type"), F.concat("event_type", F.lit(" on k"), k).alias("text"), F.array(F.concat(F.lit("c"), "user_id"), F.concat(F.lit("k"), k)).alias("entities"), F.array(F.concat(F.lit("m"), "event_id")).alias("source_message_ids"),
    )


HAPPENINGS_SQL = """hp AS (SELECT 'e' || event_id AS id, event_id, CAST(epoch_us(ts) AS BIGINT) AS ts_us, 'u' || user_id AS session_key, 'u' || user_id || '-' || (event_id % 3) AS session_id, 'p' || (event_id % 4) AS project,
  CASE event_type WHEN 'purchase' THEN 'decision' WHEN 'click' THEN 'bug' WHEN 'view' THEN 'fix' ELSE 'observation' END AS type, event_type || ' on k' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 20) AS text,
  ['c' || user_id, 'k' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 20)] AS entities, ['m' || event_id] AS source_message_ids FROM events)"""
ROOTS_SQL = "rt AS (SELECT e.id, coalesce(m.id, e.id) AS root FROM ent e LEFT JOIN ent m ON m.id = e.merged_into)"
