"""Queries of the knowledge base: facts over time, entities, relations, merges, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hippospark.functions import scalar as S
from hippospark.operators import kb
from hippospark.operators import windows as W
from hippospark.sources import sinks

from .bindings import EVENTS_SQL, FACTS_SQL, L0_SQL, RELATIONS_SQL, epoch_s, facts, kb_events, l0_messages, relations, table
from .common import Queries

q = Queries()
QUERIES, ORACLES = q.queries, q.oracles

ISLANDS = FACTS_SQL + """, m AS (SELECT *, CASE WHEN lag(value) OVER (PARTITION BY entity_id ORDER BY valid_from, seq) = value THEN 0 ELSE 1 END AS fresh FROM facts),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY entity_id ORDER BY valid_from, seq) AS island FROM m),
isl AS (SELECT entity_id, attribute, island, min(value) AS value, min(valid_from) AS valid_from, count(*) AS support, min(seq) AS seq FROM g GROUP BY 1, 2, 3),
ver AS (SELECT *, lead(valid_from) OVER (PARTITION BY entity_id ORDER BY island) AS valid_to FROM isl)"""


@q("WITH " + ISLANDS + " SELECT entity_id, value, valid_from, support FROM isl")
def fact_islands(spark: SparkSession, d: str) -> DataFrame:
    """W6, K20."""
    return kb.fact_islands(facts(spark, d)).select("entity_id", "value", "valid_from", "support")


@q("WITH " + ISLANDS + " SELECT entity_id, value, valid_from, valid_to, support, valid_to IS NULL AS is_head FROM ver")
def fact_scd2_validity(spark: SparkSession, d: str) -> DataFrame:
    """K10, W7."""
    return kb.fact_versions(facts(spark, d)).select("entity_id", "value", "valid_from", "valid_to", "support", "is_head")


@q("WITH " + ISLANDS + " SELECT entity_id, value, valid_from, valid_to, support FROM ver")
def fact_upsert_fold(spark: SparkSession, d: str) -> DataFrame:
    """K10 as the arrival-order fold; orders arrive in the order of their dates, so versions agree with the windows'."""
    f = facts(spark, d).withColumn("learned_at", F.col("valid_from"))
    return kb.upsert_facts(f).select("entity_id", "value", "valid_from", "valid_to", "support")


@q("WITH " + ISLANDS + " SELECT entity_id, value, valid_from, support FROM ver WHERE valid_to IS NULL")
def fact_heads(spark: SparkSession, d: str) -> DataFrame:
    return kb.fact_versions(facts(spark, d)).where("is_head").select("entity_id", "value", "valid_from", "support")


@q("WITH " + FACTS_SQL + " SELECT entity_id, value, count(*) AS support, max(confidence) AS confidence, min(valid_from) AS valid_from FROM facts GROUP BY 1, 2")
def fact_support_fold(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).groupBy("entity_id", "value").agg(F.count("*").alias("support"), F.max("confidence").alias("confidence"), F.min("valid_from").alias("valid_from"))


@q("WITH " + ISLANDS + " SELECT entity_id, value FROM ver WHERE valid_from <= 852076800 AND (valid_to IS NULL OR valid_to > 852076800)")
def asof_fact(spark: SparkSession, d: str) -> DataFrame:
    """What held on 1997-01-01."""
    return kb.asof_facts(facts(spark, d), 852_076_800).select("entity_id", "value")


@q("WITH m AS (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS last FROM orders) SELECT o_custkey AS entity_id, list_sort(list(DISTINCT o_orderstatus)) AS values FROM m WHERE o_orderdate = last GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def contradictions(spark: SparkSession, d: str) -> DataFrame:
    """A8, J14, of true head facts: statuses that the orders of a customer's last date assert at once, whatever that date."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("entity_id"), F.lit("status").alias("attribute"), F.col("o_orderstatus").alias("value"), "o_orderdate")
    return kb.contradictions(kb.newest(o, "o_orderdate")).select("entity_id", "values")


@q("SELECT p_partkey, 'library:' || lower(trim(p_name)) AS canonical_key FROM part")
def canonical_key(spark: SparkSession, d: str) -> DataFrame:
    """M23."""
    return table(spark, d, "part").select("p_partkey", S.canonical_key(F.lit("library"), F.concat("p_name", F.lit("@1.2"))).alias("canonical_key"))


@q("WITH RECURSIVE p AS (SELECT p_partkey AS node, p_partkey // 3 AS target FROM part WHERE p_partkey >= 3), r AS (SELECT node, target AS root FROM p UNION ALL SELECT r.node, p.target FROM r JOIN p ON p.node = r.root) SELECT node, min(root) AS root FROM r GROUP BY node")
def merge_pointer_chase(spark: SparkSession, d: str) -> DataFrame:
    """Every part points to a third of its key."""
    p = table(spark, d, "part").where("p_partkey >= 3").select(F.col("p_partkey").alias("node"), F.floor(F.col("p_partkey") / 3).cast("long").alias("target"))
    return kb.chase_pointers(p).where("not cyclic").select("node", "root")


@q("WITH " + RELATIONS_SQL + " SELECT src, dst, support FROM rel")
def relation_support(spark: SparkSession, d: str) -> DataFrame:
    """K11."""
    return relations(spark, d)


@q("SELECT CAST(o_custkey // 10 AS BIGINT) AS src, 'p' || (l_partkey // 10) AS dst, count(*) AS support FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def relation_rekey(spark: SparkSession, d: str) -> DataFrame:
    """Ten customers, and ten parts, are merged into one each."""
    r = relations(spark, d)
    merge = lambda c: F.floor(F.substring(c, 2, 20).cast("long") / 10).cast("long")
    nodes = r.select(F.col("src").alias("old")).distinct().select("old", F.concat(F.lit("C"), merge(F.col("old"))).alias("canonical"))
    nodes = nodes.unionByName(r.select(F.col("dst").alias("old")).distinct().select("old", F.concat(F.lit("p"), merge(F.col("old"))).alias("canonical")))
    return kb.rekey_edges(r, nodes).select(F.substring("src", 2, 20).cast("long").alias("src"), "dst", "support")


@q("SELECT c_custkey, 'ent_' || substr(sha1('default|person|' || lower(c_name)), 1, 16) AS id FROM customer")
def sha1_ids(spark: SparkSession, d: str) -> DataFrame:
    """M28."""
    return table(spark, d, "customer").select("c_custkey", S.sha1_id("ent", F.lit("default"), F.lit("person"), F.lower("c_name")).alias("id"))


@q("SELECT conv_id, turn, substr(sha1(conv_id || '|' || turn), 1, 12) AS id FROM conversations")
def import_ids(spark: SparkSession, d: str) -> DataFrame:
    """M30."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.substring(F.sha1(F.concat_ws("|", "conv_id", "turn")), 1, 12).alias("id"))


@q("SELECT doc_id, 'profile:v1:' || sha256('default' || chr(0) || 'scene' || chr(0) || source || '-' || doc_id) AS id, md5(text) AS md5 FROM documents")
def profile_ids(spark: SparkSession, d: str) -> DataFrame:
    """M31."""
    name = F.concat("source", F.lit("-"), "doc_id")
    return table(spark, d, "documents").select("doc_id", S.profile_id(F.lit("default"), F.lit("scene"), name).alias("id"), F.md5("text").alias("md5"))


@q("""WITH a AS (SELECT doc_id AS name, md5(text) AS md5, doc_id % 3 AS baseline FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id AS name, CASE WHEN doc_id % 2 = 0 THEN md5(text) ELSE md5(text || 'x') END AS md5, 1 AS version FROM documents WHERE doc_id % 5 <> 0)
SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'create' WHEN a.name IS NULL THEN 'delete' WHEN a.md5 = b.md5 THEN 'skip' WHEN a.baseline <> b.version THEN 'conflict' ELSE 'update' END AS action,
CAST(CASE WHEN b.name IS NULL THEN 1 WHEN a.name IS NOT NULL AND a.md5 <> b.md5 AND a.baseline = b.version THEN 2 ELSE b.version END AS BIGINT) AS version FROM a FULL JOIN b ON a.name = b.name""")
def profile_sync_actions(spark: SparkSession, d: str) -> DataFrame:
    """K18, J27."""
    t = table(spark, d, "documents")
    a = t.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("name"), F.md5("text").alias("md5"), (F.col("doc_id") % 3).alias("baseline"))
    b = t.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("name"), F.when(F.col("doc_id") % 2 == 0, F.md5("text")).otherwise(F.md5(F.concat("text", F.lit("x")))).alias("md5"), F.lit(1).alias("version"))
    return kb.profile_sync(a, b)


@q("SELECT arg_max(event_id, (ts, event_id)) AS n, user_id AS session_key, arg_max(event_type, (ts, event_id)) AS type FROM events GROUP BY user_id")
def latest_by_key(spark: SparkSession, d: str) -> DataFrame:
    """A11."""
    return kb.latest_by(table(spark, d, "events").withColumns({"session_key": F.col("user_id"), "type": F.col("event_type"), "n": F.col("event_id")}), "session_key", ["ts", "event_id"], "n", "type")


@q("WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, event_type, n FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")
def mode_project(spark: SparkSession, d: str) -> DataFrame:
    """A13, A14, A24."""
    from hippospark.operators.clusters import mode_of

    return mode_of(table(spark, d, "events"), "user_id", "event_type")


@q("WITH " + EVENTS_SQL + ", x AS (SELECT event_id, session_key, unnest(entities) AS entity FROM ev) SELECT entity, count(DISTINCT event_id) AS n_events, count(DISTINCT session_key) AS n_sessions FROM x GROUP BY 1 HAVING count(DISTINCT event_id) >= 2 AND count(DISTINCT session_key) >= 2")
def principle_clusters(spark: SparkSession, d: str) -> DataFrame:
    """A7. An event holds an entity once and is a row, so events are counted plainly; only sessions need a distinct count."""
    e = kb_events(spark, d).select("session_key", F.explode(F.array_distinct("entities")).alias("entity"))
    g = e.groupBy("entity", "session_key").agg(F.count("*").alias("n")).groupBy("entity").agg(F.sum("n").alias("n_events"), F.count("*").alias("n_sessions"))
    return g.where("n_events >= 2 and n_sessions >= 2")


@q("WITH " + L0_SQL + " SELECT session_key, count(*) AS messages, list(record_id ORDER BY ts_ms) AS ids, min(ts_ms) AS first_ts FROM l0 GROUP BY 1")
def l0_grouped_by_session(spark: SparkSession, d: str) -> DataFrame:
    """A3."""
    return W.by_session(l0_messages(spark, d))


@q("SELECT role, count(*) AS n FROM conversations GROUP BY 1")
def counts_by_role(spark: SparkSession, d: str) -> DataFrame:
    """A1, A26."""
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"))


@q("WITH n AS (SELECT lang, floor(n_chars / 500) * 500.0 AS step, count(*) AS n FROM documents WHERE n_chars IS NOT NULL GROUP BY 1, 2) SELECT lang, step, n, CAST(sum(n) OVER (PARTITION BY lang ORDER BY step DESC) AS BIGINT) AS or_above FROM n")
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Documents by length, per language."""
    return W.score_histogram(table(spark, d, "documents"), "n_chars", 500.0, "lang").select("lang", F.col("step").cast("double").alias("step"), "n", "or_above")


@q("SELECT c_custkey, CASE WHEN n >= 1000 THEN 5 WHEN n >= 500 THEN 4 WHEN n >= 200 THEN 3 WHEN n >= 100 THEN 2 WHEN n >= 50 THEN 1 ELSE 0 END AS bucket FROM (SELECT o_custkey AS c_custkey, count(*) * 10 AS n FROM orders GROUP BY 1)")
def heat_buckets(spark: SparkSession, d: str) -> DataFrame:
    """M46."""
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.count("*") * 10).alias("n"))
    return n.select("c_custkey", S.heat_bucket(F.col("n")).alias("bucket"))


@q("WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate FROM orders) SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus, CAST(min(epoch(o_orderdate)) AS BIGINT) AS created FROM o GROUP BY 1")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """K1, K2: upserts of one record per customer; the creation time stays the first."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.struct("o_orderdate", "o_orderkey").alias("version"), epoch_s("o_orderdate").alias("created"))
    return kb.upsert_latest(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 <> 0"), "o_custkey", "version", "created").drop("version")


@q("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 11 = 0 OR o_orderdate >= TIMESTAMP '1998-08-02' - INTERVAL 29 DAY * 14")
def retention_filter(spark: SparkSession, d: str) -> DataFrame:
    """K5, K6: what a retention of 407 days at the evening of 1998-08-02 leaves; rows with an unknown time stay."""
    cutoff = sinks.retention_cutoff(902_088_000, 29 * 14 + 1)
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 11 != 0, epoch_s("o_orderdate")).alias("updated"))
    return sinks.without(o, sinks.expired(o, "updated", cutoff).select("o_orderkey"), "o_orderkey").select("o_orderkey", "o_custkey")


@q("SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O')")
def orphan_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Old orders that no open line refers to."""
    o = table(spark, d, "orders").select("o_orderkey", epoch_s("o_orderdate").alias("changed"))
    used = table(spark, d, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey"))
    return sinks.orphans(o, used, "o_orderkey", "changed", 852_076_800).select("o_orderkey")


@q("WITH f AS (SELECT o_custkey, count(*) AS facts, min(epoch(o_orderdate)) AS created FROM orders GROUP BY 1) SELECT c_nationkey, c_custkey AS id FROM customer LEFT JOIN f ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY round(c_acctbal / 1000) DESC, coalesce(facts, 0) DESC, coalesce(created, 0), c_custkey) = 1")
def canonical_pick(spark: SparkSession, d: str) -> DataFrame:
    """Of each nation the customer that stands for it: by balance in thousands, number of orders, the first order, id."""
    f = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("facts"), F.min(epoch_s("o_orderdate")).alias("created"))
    c = table(spark, d, "customer").select("c_nationkey", F.col("c_custkey").alias("id"), F.round(F.col("c_acctbal") / 1000).alias("importance"))
    members = c.join(f, "id", "left").withColumns({"facts": F.coalesce("facts", F.lit(0)), "created": F.coalesce("created", F.lit(0))})
    return kb.canonical_pick(members, "c_nationkey")


@q("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_quantity > 49")
def ids_in_both(spark: SparkSession, d: str) -> DataFrame:
    """A semi-join over distinct ids."""
    f = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey").distinct()
    return f.join(table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("o_custkey")), "o_custkey", "left_semi")
