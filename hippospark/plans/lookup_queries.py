"""Queries of reads: scans, candidate joins, files, situations, recaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hippospark.functions import scalar as S
from hippospark.operators import lookups as L

from .bindings import ENTITIES_SQL, HAPPENINGS_SQL, HEADS_SQL, L0_SQL, RELATIONS_SQL, ROOTS_SQL, entities, happenings, heads, l0_messages, relations, table
from .common import Queries

q = Queries()
QUERIES, ORACLES = q.queries, q.oracles


def records(spark: SparkSession, d: str) -> DataFrame:
    return l0_messages(spark, d).select("record_id", "session_key", F.concat("session_key", F.lit("-"), F.col("turn") % 2).alias("session_id"), F.col("ts_ms").cast("string").alias("updated_time"))


@q(f"WITH {L0_SQL} SELECT record_id FROM l0 WHERE session_key || '-' || (turn % 2) = 'conv_3-1' AND CAST(ts_ms AS VARCHAR) > '1704326460000' ORDER BY ts_ms")
def filtered_scan(spark: SparkSession, d: str) -> DataFrame:
    """The id of a session wins over a key."""
    return L.filtered_scan(records(spark, d), "conv_1", "conv_3-1", "1704326460000").select("record_id")


@q(f"WITH {L0_SQL} SELECT record_id FROM l0 WHERE session_key = 'conv_2' AND ts_ms > 1704240000000 ORDER BY ts_ms DESC LIMIT 5")
def newest_first(spark: SparkSession, d: str) -> DataFrame:
    """S3, S18, S21."""
    return L.newest_first(l0_messages(spark, d), "session_key", "ts_ms", "record_id", "conv_2", 1_704_240_000_000, 5).select("record_id")


@q(f"WITH {HAPPENINGS_SQL} SELECT id, type FROM hp WHERE session_key = 'u3' ORDER BY ts_us, id")
def session_events(spark: SparkSession, d: str) -> DataFrame:
    """S19."""
    return L.session_events(happenings(spark, d), "u3").select("id", "type")


@q(f"WITH {ENTITIES_SQL} SELECT id, importance FROM ent WHERE merged_into IS NULL AND type IN ('person') ORDER BY importance DESC, updated_time DESC, id LIMIT 40")
def live_entity_listing(spark: SparkSession, d: str) -> DataFrame:
    """S20."""
    return L.entity_listing(entities(spark, d), ("person",), 40).select("id", "importance")


@q("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def paged_scan(spark: SparkSession, d: str) -> DataFrame:
    """S17."""
    return L.page(table(spark, d, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 50, 25, F.col("o_orderstatus") == "F").select("o_orderkey")


@q("SELECT vec_id FROM embeddings WHERE vec_id % 4 = 0")
def valid_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Three quarters are too short, or hold a null or an infinity."""
    k = F.col("vec_id") % 4
    e = S.doubles("embedding")
    v = F.when(k == 1, F.slice(e, 1, 63)).when(k == 2, F.concat(F.slice(e, 1, 63), F.array(F.lit(None).cast("double")))).when(k == 3, F.concat(F.slice(e, 1, 63), F.array(F.lit(float("inf"))))).otherwise(e)
    return L.valid_vectors(table(spark, d, "embeddings").withColumn("v", v), "v", 64).select("vec_id")


@q("SELECT 'd' || doc_id AS owner_id, round(CAST(embedding[1] AS DOUBLE), 6) AS x FROM documents JOIN embeddings ON vec_id = doc_id * 4")
def first_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Four vectors are the chunks of one document."""
    v = table(spark, d, "embeddings").select(F.concat(F.lit("d"), F.floor(F.col("vec_id") / 4).cast("long")).alias("owner_id"), (F.col("vec_id") % 4).alias("chunk_ix"), "embedding")
    return L.first_chunks(v, table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("owner_id"))).select("owner_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("x"))


@q(f"""WITH {ENTITIES_SQL}, {HEADS_SQL}, n AS (SELECT entity_id AS id, count(*) AS n FROM hd GROUP BY 1), v AS (SELECT entity_id AS id, avg(seq % 7 + 1.0) AS a, avg(seq % 5 + 1.0) AS b FROM hd GROUP BY 1)
SELECT e.id, CAST(coalesce(n, 0) AS BIGINT) AS n_facts, round(a / sqrt(a * a + b * b), 6) AS x FROM ent e LEFT JOIN n USING (id) LEFT JOIN v USING (id) WHERE merged_into IS NULL""")
def reconciliation_load(spark: SparkSession, d: str) -> DataFrame:
    """S24, A21."""
    h = heads(spark, d)
    v = h.select("id", F.array(F.col("seq") % 7 + 1.0, F.col("seq") % 5 + 1.0).alias("embedding"))
    return L.reconciliation_load(entities(spark, d), h, v).select("id", "n_facts", F.round(F.col("vector")[0], 6).alias("x"))


@q("SELECT vec_id, lang FROM embeddings JOIN documents ON doc_id = vec_id")
def hits_with_meta(spark: SparkSession, d: str) -> DataFrame:
    """J1."""
    return L.with_meta(table(spark, d, "embeddings").select("vec_id", F.col("vec_id").alias("doc_id")), table(spark, d, "documents"), "doc_id").select("vec_id", "lang")


@q(f"WITH {HEADS_SQL}, {ENTITIES_SQL} SELECT hd.id, coalesce(CASE WHEN substr(entity_id, 2)::BIGINT % 2 = 0 THEN name END, entity_id) || ' — ' || attribute || ': ' || value AS text FROM hd LEFT JOIN ent ON ent.id = entity_id")
def head_texts(spark: SparkSession, d: str) -> DataFrame:
    """Half of the entities are not there."""
    e = entities(spark, d).where(F.substring("id", 2, 20).cast("long") % 2 == 0)
    return L.head_texts(heads(spark, d), e).select("id", "text")


@q(f"WITH {HEADS_SQL}, {ENTITIES_SQL} SELECT hd.id FROM hd JOIN ent ON ent.id = entity_id WHERE name ILIKE '%1_' OR value ILIKE '%1_' ORDER BY valid_from DESC, hd.id LIMIT 15")
def facts_like(spark: SparkSession, d: str) -> DataFrame:
    """J3."""
    return L.facts_like(heads(spark, d), entities(spark, d), "%1_", 15).select("id")


@q(f"WITH {HEADS_SQL}, m AS (SELECT 'c' || c_custkey AS entity_id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer QUALIFY place <= 10) SELECT id, row_number() OVER (ORDER BY place, attribute, id) - 1 AS rank FROM hd JOIN m USING (entity_id) QUALIFY rank < 12")
def entity_candidates(spark: SparkSession, d: str) -> DataFrame:
    """J4."""
    from pyspark.sql import Window

    top = table(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(10)
    m = top.select(F.concat(F.lit("c"), "c_custkey").alias("entity_id"), F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey")).alias("place"))
    return L.entity_head_candidates(m, heads(spark, d), 12).select("id", "rank")


@q(f"WITH {HAPPENINGS_SQL}, x AS (SELECT id, ts_us, unnest(entities) AS entity_id FROM hp) SELECT entity_id, id FROM x WHERE entity_id LIKE 'k%' QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts_us DESC, id DESC) <= 4")
def events_of_entities(spark: SparkSession, d: str) -> DataFrame:
    """J5."""
    return L.events_of_entities(happenings(spark, d), spark.range(20).select(F.concat(F.lit("k"), "id").alias("entity_id")), 4).select("entity_id", "id")


LESSONS_SQL = """ls AS (SELECT 'L' || p_partkey AS id, p_brand AS domain, ['k' || (p_partkey % 20), 'c' || (p_partkey % 50)] AS files, p_size / 50.0 AS confidence, p_partkey % 5 AS evidence_count, p_partkey % 3 AS version, CASE WHEN p_partkey % 4 = 0 THEN 'x' END AS superseded_by,
  CASE WHEN p_partkey % 3 > 0 THEN (p_partkey % 10) / 10.0 END AS willingness, p_name AS lesson_text FROM part)"""


def lessons(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        F.concat(F.lit("L"), k).alias("id"), F.col("p_brand").alias("domain"), F.array(F.concat(F.lit("k"), k % 20), F.concat(F.lit("c"), k % 50)).alias("files"), (F.col("p_size") / 50.0).alias("confidence"), (k % 5).alias("evidence_count"), (k % 3).alias("version"),
        F.when(k % 4 == 0, "x").alias("superseded_by"), F.when(k % 3 > 0, k % 10 / 10.0).alias("willingness"), F.col("p_name").alias("lesson_text"),
    )


@q(f"WITH {LESSONS_SQL}, x AS (SELECT id, unnest(files) AS file, confidence, evidence_count, version FROM ls WHERE superseded_by IS NULL) SELECT file, id FROM x QUALIFY row_number() OVER (PARTITION BY file ORDER BY confidence DESC, evidence_count DESC, version DESC, id) <= 3")
def lessons_by_file(spark: SparkSession, d: str) -> DataFrame:
    """Of every file that a lesson names."""
    x = lessons(spark, d)
    return L.lessons_by_file(x, x.select(F.explode("files").alias("file"))).select("file", "id")


@q(f"WITH {LESSONS_SQL} SELECT domain, files[1] AS file, id FROM ls WHERE superseded_by IS NULL QUALIFY row_number() OVER (PARTITION BY domain, files[1] ORDER BY version DESC, id) = 1")
def head_lessons(spark: SparkSession, d: str) -> DataFrame:
    """T15."""
    return L.head_lessons(lessons(spark, d).withColumn("file", F.col("files")[0]), "domain", "file").select("domain", "file", "id")


SEVERITY_SQL = "CASE WHEN confidence < 0.6 OR evidence_count < 2 OR coalesce(willingness, 1) < 0.25 THEN 'silent' WHEN version > 0 AND coalesce(willingness, 1) >= 0.45 THEN 'hard' ELSE 'soft' END"


@q(f"""WITH {LESSONS_SQL}, s AS (SELECT *, {SEVERITY_SQL} AS severity FROM ls), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY severity = 'hard' DESC, confidence DESC, id) AS p FROM s WHERE severity <> 'silent'), u AS (SELECT *, CASE WHEN severity = 'hard' AND p = 1 THEN 'hard' ELSE 'soft' END AS surface FROM r)
SELECT domain, id, surface, row_number() OVER (PARTITION BY domain, surface ORDER BY confidence DESC, id) AS place FROM u""")
def stance_surface(spark: SparkSession, d: str) -> DataFrame:
    """Lessons of a manufacturer, later versions standing for high stakes."""
    x = lessons(spark, d)
    tier = F.when(F.col("willingness").isNotNull(), S.willingness_tier(F.col("willingness")))
    x = x.withColumn("severity", S.severity(F.col("confidence"), F.col("evidence_count"), tier, F.when(F.col("version") > 0, "high").otherwise("none"))).withColumn("seq", F.col("id"))
    return L.stances(x, "domain").select("domain", "id", "surface", "place")


@q(f"WITH {HAPPENINGS_SQL} SELECT id, CASE WHEN session_key LIKE 'u%1' THEN '' ELSE 'P' || session_key END AS project FROM hp")
def session_projects(spark: SparkSession, d: str) -> DataFrame:
    """J9."""
    e = happenings(spark, d)
    known = e.select("session_key").distinct().where(~F.col("session_key").like("u%1")).withColumn("project", F.concat(F.lit("P"), "session_key"))
    return L.session_projects(e.drop("project"), known).select("id", "project")


@q(f"""WITH {HAPPENINGS_SQL}, {RELATIONS_SQL}, m AS (SELECT c_nationkey AS id, list('c' || c_custkey) AS e FROM customer GROUP BY 1), t AS (SELECT n1.c_nationkey AS a, s_nationkey AS b FROM rel JOIN customer n1 ON src = 'c' || n1.c_custkey JOIN supplier ON dst = 'p' || s_suppkey)
SELECT x.id AS a, y.id AS b, EXISTS (SELECT 1 FROM t WHERE t.a = x.id AND t.b = y.id) OR EXISTS (SELECT 1 FROM t WHERE t.a = y.id AND t.b = x.id) AS linked FROM (SELECT DISTINCT c_nationkey AS id FROM customer) x JOIN (SELECT DISTINCT c_nationkey AS id FROM customer) y ON x.id < y.id""")
def linked_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Nations by their customers and their suppliers' numbers, linked by what was ordered."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    e = c.select(F.col("c_nationkey").alias("id"), F.concat(F.lit("c"), "c_custkey").alias("e")).unionByName(s.select(F.col("s_nationkey").alias("id"), F.concat(F.lit("p"), "s_suppkey").alias("e")))
    members = e.groupBy("id").agg(F.collect_set("e").alias("entities"))
    ids = c.select(F.col("c_nationkey").alias("a")).distinct()
    pairs = ids.join(ids.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))
    return L.linked_pairs(pairs, members, relations(spark, d).withColumn("type", F.lit("caused")))


@q(f"WITH {HEADS_SQL}, {HAPPENINGS_SQL}, x AS (SELECT id, 'event' AS kind, text FROM hp WHERE event_id % 3 = 0 UNION ALL SELECT id, 'fact', attribute || ': ' || value FROM hd WHERE seq % 2 = 0) SELECT id AS owner_id, kind AS owner_kind, text FROM x")
def pending_texts(spark: SparkSession, d: str) -> DataFrame:
    """J15, T17."""
    e, h = happenings(spark, d), heads(spark, d)
    state = lambda c: F.when(c, "pending_confirmation").otherwise("clear").alias("gate_state")
    life = e.select(F.col("id").alias("owner_id"), F.lit("event").alias("owner_kind"), state(F.col("event_id") % 3 == 0)).unionByName(h.select(F.col("id").alias("owner_id"), F.lit("fact").alias("owner_kind"), state(F.col("seq") % 2 == 0)))
    return L.pending_texts(life, e, h).select("owner_id", "owner_kind", "text")


@q("SELECT o_custkey FROM orders GROUP BY 1 HAVING NOT bool_or(o_orderkey % 10 = 0)")
def duplicate_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Customers none of whose orders is evidence."""
    o = table(spark, d, "orders")
    g = o.groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("ids"))
    return L.uncovered(g, "ids", o.where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("id")), "o_custkey").select("o_custkey")


@q("SELECT o_custkey FROM orders GROUP BY 1 HAVING NOT bool_or(o_orderkey % 10 = 0)")
def usage_coverage(spark: SparkSession, d: str) -> DataFrame:
    """J18."""
    o = table(spark, d, "orders").withColumn("id", F.concat(F.lit("e"), "o_orderkey"))
    g = o.groupBy("o_custkey").agg(F.collect_list("id").alias("ids"))
    return L.uncovered_by_markers(g, "ids", o.where("o_orderkey % 10 = 0").select(F.array(F.lit("k1"), F.concat(F.lit("usage-src:"), "id")).alias("entities")), "o_custkey").select("o_custkey")


@q("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def principle_coverage(spark: SparkSession, d: str) -> DataFrame:
    """J30."""
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("c"), "c_custkey").alias("entity"))
    e = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "principle").otherwise("bug").alias("type"), F.array(F.concat(F.lit("c"), "o_custkey"), F.lit("evidence:2")).alias("entities"))
    return L.without_principle(c, "entity", e).select("c_custkey")


FILES_SQL = "fe AS (SELECT 'k' || i AS id, CASE WHEN i % 2 = 0 THEN 'file:src/f' || i || '.py' ELSE 'file:f' || i || '.py' END AS key FROM range(20) t(i))"


def files(spark: SparkSession, d: str) -> DataFrame:
    """Twenty files, half by their whole path and half by their last part."""
    i = F.col("i")
    key = F.when(i % 2 == 0, F.concat(F.lit("file:src/f"), i, F.lit(".py"))).otherwise(F.concat(F.lit("file:f"), i, F.lit(".py")))
    return spark.range(20).withColumnRenamed("id", "i").select(F.concat(F.lit("k"), i).alias("id"), F.lit("file").alias("type"), F.concat(F.lit("File "), i).alias("name"), key.alias("canonical_key"), F.lit(None).cast("string").alias("merged_into"))


def touched(spark: SparkSession, d: str) -> DataFrame:
    """A path per event's number, with capitals and back slashes."""
    k = F.col("event_id") % 25
    return table(spark, d, "events").select(F.concat(F.lit("SRC\\F"), k, F.lit(".PY")).alias("path"), F.when(k % 3 == 0, "high").otherwise("none").alias("stakes")).distinct()


@q(f"WITH {FILES_SQL} SELECT DISTINCT 'SRC\\F' || (event_id % 25) || '.PY' AS path, id AS entity_id FROM events JOIN fe ON key IN ('file:src/f' || (event_id % 25) || '.py', 'file:f' || (event_id % 25) || '.py')")
def file_candidates(spark: SparkSession, d: str) -> DataFrame:
    """J22."""
    return L.file_entities(touched(spark, d), files(spark, d)).select("path", "entity_id")


@q(f"""WITH {FILES_SQL}, {HEADS_SQL}, {HAPPENINGS_SQL}, {LESSONS_SQL}, t AS (SELECT DISTINCT 'SRC\\F' || (event_id % 25) || '.PY' AS path, 'k' || (event_id % 25) AS f, CASE WHEN event_id % 25 % 3 = 0 THEN 'high' ELSE 'none' END AS stakes FROM events WHERE event_id % 25 < 20),
kf AS (SELECT 'k' || (substr(entity_id, 2)::BIGINT % 20) AS f, entity_id, attribute, value, id FROM hd),
ff AS (SELECT path, 'fact' AS kind, row_number() OVER (PARTITION BY path ORDER BY attribute, id) AS place, attribute || ': ' || value AS text, NULL AS severity FROM kf JOIN t USING (f) QUALIFY place <= 5),
xx AS (SELECT id, ts_us, type, text, unnest(entities) AS f FROM hp), ee AS (SELECT path, 'event' AS kind, row_number() OVER (PARTITION BY path ORDER BY ts_us DESC, id DESC) AS place, '(' || type || ') ' || text AS text, NULL AS severity FROM xx JOIN t USING (f) QUALIFY place <= 4),
lx AS (SELECT id, unnest(files) AS f, confidence, evidence_count, version, willingness, lesson_text FROM ls WHERE superseded_by IS NULL), l2 AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY confidence DESC, evidence_count DESC, version DESC, id) AS place FROM lx QUALIFY place <= 2),
l3 AS (SELECT path, id, place, lesson_text, confidence, stakes = 'high' AND confidence >= 0.6 AND evidence_count >= 2 AND coalesce(willingness, 1) >= 0.45 AS h FROM l2 JOIN t USING (f) WHERE coalesce(willingness, 1) >= 0.25),
l4 AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY h DESC, confidence DESC, place) AS r FROM l3)
SELECT path, 'lesson' AS kind, CAST(place AS BIGINT) AS place, lesson_text AS text, CASE WHEN h AND r = 1 THEN 'hard' ELSE 'soft' END AS severity FROM l4 UNION ALL SELECT * FROM ff UNION ALL SELECT * FROM ee""")
def file_memory(spark: SparkSession, d: str) -> DataFrame:
    """Facts of customers by the last digits of their number, events by the numbers they name, lessons by their trigger."""
    h = heads(spark, d).withColumn("entity_id", F.concat(F.lit("k"), F.substring("entity_id", 2, 20).cast("long") % 20))
    return L.file_memory(touched(spark, d), files(spark, d), h, happenings(spark, d), lessons(spark, d))


PRINTS_SQL = "fp AS (SELECT o_orderkey AS id, list_distinct(list('p' || (l_partkey % 40))) AS files, list_distinct(list(l_returnflag || l_linestatus)) AS errors, max(o_orderpriority) AS task, max(o_custkey) AS c FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)"


def prints(spark: SparkSession, d: str) -> DataFrame:
    o, li = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_custkey"), table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus")
    g = o.join(li, o["o_orderkey"] == li["l_orderkey"]).groupBy("o_orderkey").agg(F.collect_set(F.concat(F.lit("p"), F.col("l_partkey") % 40)).alias("files"), F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("errors"), F.max("o_orderpriority").alias("task"), F.max("o_custkey").alias("c"))
    return g.select(F.col("o_orderkey").alias("fingerprint_id"), "files", "errors", "task", F.array(F.concat(F.lit("c"), "c"), F.concat(F.lit("c"), F.col("c") + 1), F.lit("nobody"), F.concat(F.lit("c"), F.col("c") + 2), F.concat(F.lit("c"), F.col("c") + 3)).alias("owner_ids"))


SCORE_SQL = "round((0.6 * len(list_intersect(a.files, b.files)) / len(list_distinct(list_concat(a.files, b.files))) + 0.25 * len(list_intersect(a.errors, b.errors)) / len(list_distinct(list_concat(a.errors, b.errors))) + 0.15 * CASE WHEN a.task = b.task THEN 1 ELSE 0 END) / 1.0, 6)"


@q(f"""WITH {PRINTS_SQL}, {ENTITIES_SQL}, {ROOTS_SQL}, {HEADS_SQL}, s AS (SELECT a.id AS session, b.id AS fingerprint_id, b.c, {SCORE_SQL} AS score FROM fp a, fp b WHERE a.id % 100 = 0 AND b.id % 100 <> 0),
t AS (SELECT * FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY session ORDER BY score DESC, fingerprint_id) = 1), o AS (SELECT session, fingerprint_id, score, CASE WHEN score >= 0.6 THEN 'strong' ELSE 'medium' END AS tier, i, 'c' || (c + i) AS owner_id FROM t, range(4) r(i) WHERE score >= 0.3 AND NOT (i = 0 AND session % 200 = 0)),
fs AS (SELECT entity_id, arg_min(value, attribute) AS snippet FROM hd GROUP BY 1)
SELECT session, fingerprint_id, score, tier, row_number() OVER (PARTITION BY session ORDER BY i) AS place, owner_id, ent.name, snippet FROM o JOIN rt ON rt.id = owner_id JOIN ent ON ent.id = rt.root LEFT JOIN fs ON fs.entity_id = rt.root QUALIFY place <= 3""")
def situation_matches(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose key is divisible by 100 against all others; half of them have seen the first owner."""
    p = prints(spark, d)
    current = p.where("fingerprint_id % 100 = 0").withColumnRenamed("fingerprint_id", "session")
    stored = p.where("fingerprint_id % 100 <> 0")
    none = spark.createDataFrame([], "session long, owner_id string")
    best = L.best_situations(current, stored)
    first = L.situation_match(current, stored, none, entities(spark, d), heads(spark, d), best)
    shown = first.where("session % 200 = 0 and place = 1").select("session", "owner_id")
    return L.situation_match(current, stored, shown, entities(spark, d), heads(spark, d), best)


@q(f"""WITH {HAPPENINGS_SQL}, {ENTITIES_SQL}, {ROOTS_SQL}, {PRINTS_SQL}, rc AS (SELECT session_key, unnest(entities) AS id FROM (SELECT * FROM hp QUALIFY row_number() OVER (PARTITION BY session_key ORDER BY ts_us DESC, id DESC) <= 30)),
f5 AS (SELECT c FROM fp ORDER BY id DESC LIMIT 5), ow AS (SELECT DISTINCT root AS id FROM f5, range(4) r(i) JOIN rt ON true WHERE rt.id = 'c' || (c + i)),
a AS (SELECT session_key, id, 1.0 AS w FROM rc UNION ALL SELECT DISTINCT session_key, ow.id, 0.7 FROM hp, ow UNION ALL SELECT session_key, 'k' || (event_id % 20), 0.4 FROM hp WHERE type = 'fix'),
g AS (SELECT session_key, id, max(w) AS weight FROM a GROUP BY 1, 2) SELECT session_key, id, CAST(weight AS DOUBLE) AS weight FROM g QUALIFY row_number() OVER (PARTITION BY session_key ORDER BY weight DESC, id) <= 24""")
def situation_seeds(spark: SparkSession, d: str) -> DataFrame:
    """T21."""
    e = happenings(spark, d)
    f = e.where("type = 'fix'").select("session_key", F.concat(F.lit("k"), F.col("event_id") % 20).alias("entity_id"))
    return L.situation_seeds(e, prints(spark, d).withColumn("ts_us", F.col("fingerprint_id")), f, entities(spark, d)).select("session_key", "id", "weight")


@q("""WITH t AS (SELECT 'u' || user_id AS s, event_id AS n, event_type AS tool, 'f' || (event_id % 11) AS file, CASE WHEN event_id % 3 = 0 THEN 'E' || (event_id % 7) END AS err FROM events),
l AS (SELECT s, 'file' AS kind, file AS v, max(n) AS n FROM t GROUP BY 1, 3 UNION ALL SELECT s, 'tool', tool, max(n) FROM t GROUP BY 1, 3 UNION ALL SELECT s, 'err', err, max(n) FROM t WHERE err IS NOT NULL GROUP BY 1, 3), r AS (SELECT *, row_number() OVER (PARTITION BY s, kind ORDER BY n DESC, v) AS p FROM l)
SELECT s AS session_key, coalesce(list(v ORDER BY p DESC) FILTER (kind = 'file' AND p <= 5), []) AS files, coalesce(list(v ORDER BY p DESC) FILTER (kind = 'err' AND p <= 5), []) AS errors, coalesce(list(v ORDER BY p DESC) FILTER (kind = 'tool' AND p <= 8), []) AS tools FROM r GROUP BY 1""")
def recent_situations(spark: SparkSession, d: str) -> DataFrame:
    """W9, X16."""
    k = F.col("event_id")
    t = table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("session_key"), k.alias("seq"), F.col("event_type").alias("tool"), F.concat(F.lit("f"), k % 11).alias("file"), F.when(k % 3 == 0, F.array(F.concat(F.lit("E"), k % 7))).otherwise(F.array().cast("array<string>")).alias("errors"))
    return L.recent_situation(t)


@q("SELECT doc_id FROM documents WHERE doc_id % 5 = 0 OR DATE '2024-01-01' + CAST(doc_id % 200 AS INTEGER) > DATE '2024-04-01'")
def changed_scenes(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth has an unreadable time."""
    at = F.when(F.col("doc_id") % 5 == 0, "?").otherwise(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 200).cast("int")).cast("string"))
    t = table(spark, d, "documents").select("doc_id", at.alias("updated"))
    return L.changed_since(t, spark.range(1).select(F.lit("2024-04-01").cast("timestamp").alias("last_persona"))).select("doc_id")


@q("SELECT CASE WHEN doc_id % 7 = 0 THEN 'created' WHEN doc_id % 5 = 0 THEN 'deleted' ELSE 'updated' END AS status, count(*) AS n FROM documents WHERE (doc_id % 7 = 0 AND doc_id % 5 <> 0) OR (doc_id % 5 = 0 AND doc_id % 7 <> 0) OR (doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND doc_id % 2 = 0) GROUP BY 1")
def scene_change_counts(spark: SparkSession, d: str) -> DataFrame:
    """A31."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("name"), F.md5(F.coalesce("text", F.lit(""))).alias("md5"))
    after = t.where("name % 5 <> 0").withColumn("md5", F.when(F.col("name") % 2 == 0, F.concat("md5", F.lit("x"))).otherwise(F.col("md5")))
    return L.scene_changes(t.where("name % 7 <> 0"), after)


CURRENT_SQL = "cu AS (SELECT session_key, arg_max(session_id, (ts_us, id)) AS cur FROM hp GROUP BY 1)"


def current(spark: SparkSession, d: str) -> DataFrame:
    return happenings(spark, d).groupBy("session_key").agg(F.max_by("session_id", F.struct("ts_us", "id")).alias("session_id"))


@q(f"WITH {HAPPENINGS_SQL}, {CURRENT_SQL} SELECT hp.session_key, arg_max(session_id, (ts_us, id)) AS session_id FROM hp JOIN cu USING (session_key) WHERE session_id <> cur GROUP BY 1")
def previous_sessions(spark: SparkSession, d: str) -> DataFrame:
    """A12."""
    return L.previous_session(happenings(spark, d), current(spark, d))


THREAD_SQL = """tt AS (SELECT * FROM hp WHERE type IN ('decision', 'task', 'result', 'bug', 'fix', 'config_change')), li AS (SELECT session_key, session_id, list('- (' || type || ') ' || text || '   [anchor: msg ' || source_message_ids[1] || ']' ORDER BY ts_us, id) AS l FROM (SELECT * FROM tt QUALIFY row_number() OVER (PARTITION BY session_key, session_id ORDER BY ts_us DESC, id DESC) <= 6) GROUP BY 1, 2),
nx AS (SELECT session_key, session_id, arg_max('- Prossimo passo: ' || text || '   [anchor: msg ' || source_message_ids[1] || ']', (ts_us, id)) AS nx FROM hp WHERE type IN ('task', 'decision') GROUP BY 1, 2),
pj AS (SELECT session_key, session_id, project FROM (SELECT session_key, session_id, project, count(*) AS n, min(ts_us) AS f FROM hp GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY session_key, session_id ORDER BY n DESC, f, project) = 1)"""


@q(f"WITH {HAPPENINGS_SQL}, {THREAD_SQL} SELECT session_key, session_id, project, CAST(coalesce(len(l), 0) AS INTEGER) AS n, nx IS NOT NULL AS has_next FROM pj LEFT JOIN li USING (session_key, session_id) LEFT JOIN nx USING (session_key, session_id)")
def recap_threads(spark: SparkSession, d: str) -> DataFrame:
    """W10, A13."""
    t = L.recap_threads(happenings(spark, d))
    return t.select("session_key", "session_id", "project", F.coalesce(F.size("thread"), F.lit(0)).alias("n"), F.col("next_step").isNotNull().alias("has_next"))


@q(f"""WITH {HAPPENINGS_SQL}, {CURRENT_SQL}, {THREAD_SQL}, pv AS (SELECT hp.session_key, arg_max(session_id, (ts_us, id)) AS session_id FROM hp JOIN cu USING (session_key) WHERE session_id <> cur GROUP BY 1)
SELECT session_key, session_id, 'DOVE ERAVAMO — ' || project || ' (2024-06-01)' || chr(10) || chr(10) || coalesce('PROSSIMO PASSO:' || chr(10) || nx || chr(10) || chr(10), '') || 'FILO (ricostruito dalle nostre parole reali):' || chr(10) || array_to_string(l, chr(10)) AS text FROM pv JOIN pj USING (session_key, session_id) JOIN li USING (session_key, session_id) LEFT JOIN nx USING (session_key, session_id) WHERE session_key NOT LIKE 'u%5'""")
def rollover_recaps(spark: SparkSession, d: str) -> DataFrame:
    """Sessions whose recap is up to date get none."""
    e = happenings(spark, d)
    done = L.previous_session(e, current(spark, d)).where(F.col("session_key").like("u%5")).select(F.concat(F.lit("r"), "session_key").alias("id"), F.lit(1 << 60).alias("ts_us"), "session_key", "session_id", F.lit("session_recap").alias("type"))
    return L.rollover_recaps(e.unionByName(done, allowMissingColumns=True), current(spark, d), 1, "2024-06-01T00:00:00Z").select("session_key", "session_id", "text")


@q(f"WITH {ENTITIES_SQL} SELECT id, name, CAST(contains(t, 'building') AS BIGINT) + CAST(contains(t, '7') AS BIGINT) + CAST(contains(t, 'person:customer#000000042') AS BIGINT) AS hits FROM (SELECT *, lower(name || chr(10) || canonical_key || chr(10) || aliases[1]) AS t FROM ent) WHERE hits > 0 ORDER BY hits DESC, id LIMIT 12")
def entity_alias_match(spark: SparkSession, d: str) -> DataFrame:
    """In names, keys and aliases."""
    from hippospark.operators.retrieval import entity_matches

    return entity_matches(entities(spark, d), ("Building", "7", "person:customer#000000042"), "id", "name", 12, ("canonical_key", "aliases"))


@q("WITH m AS (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS l FROM orders), h AS (SELECT o_custkey, o_orderkey, o_orderpriority AS v FROM m WHERE o_orderdate >= l - INTERVAL 200 DAY), g AS (SELECT o_custkey, list_sort(list(DISTINCT v)) AS a FROM h GROUP BY 1 HAVING count(DISTINCT v) > 1) SELECT o_orderkey AS id, list_filter(a, lambda x: x <> v) AS siblings FROM h JOIN g USING (o_custkey)")
def contradiction_siblings(spark: SparkSession, d: str) -> DataFrame:
    """What other orders of a customer's last two hundred days say against each."""
    from hippospark.operators import kb

    from .bindings import epoch_s

    o = table(spark, d, "orders").select(F.col("o_custkey").alias("entity_id"), F.lit("priority").alias("attribute"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("id"), epoch_s("o_orderdate").alias("at"))
    last = o.groupBy("entity_id").agg(F.max("at").alias("last"))
    return kb.contradicting_facts(o.join(last, "entity_id").where("at >= last - 200 * 86400")).select("id", "siblings")


@q("SELECT o_custkey, min(CAST(CAST(o_orderdate AS DATE) AS VARCHAR)) AS timestamp_start, max(CAST(CAST(o_orderdate AS DATE) AS VARCHAR)) AS timestamp_end FROM orders GROUP BY 1")
def record_times(spark: SparkSession, d: str) -> DataFrame:
    """K1."""
    from hippospark.operators import kb

    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.col("o_orderdate").cast("date").cast("string")).alias("timestamps"))
    return kb.record_times(g).select("o_custkey", "timestamp_start", "timestamp_end")


@q(f"WITH {L0_SQL}, r AS (SELECT ts_ms, turn FROM l0 WHERE ts_ms > 1704240000000 ORDER BY ts_ms, turn LIMIT 50) SELECT max(ts_ms) AS ts_ms, arg_max(turn, (ts_ms, turn)) AS turn FROM r")
def cursor_after_read(spark: SparkSession, d: str) -> DataFrame:
    """Where the next read goes on."""
    from hippospark.operators.windows import incremental, next_cursor

    return next_cursor(incremental(l0_messages(spark, d), "ts_ms", "turn", 1_704_240_000_000, 1 << 30, 50), "ts_ms", "turn")


@q("SELECT conv_id, CAST(sum(ceil(length(text) / 4.0)) + ceil(0.5 * count(*)) + 120 + 30 AS BIGINT) AS tokens FROM conversations GROUP BY 1")
def context_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """With the system's and the prompt's tokens."""
    from hippospark.operators.windows import context_tokens

    m = table(spark, d, "conversations").select("conv_id", F.ceil(F.char_length("text") / 4).alias("tokens"))
    return context_tokens(m, "conv_id", "tokens", 120, 30)
