"""Queries of writing knowledge, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hippospark.functions import scalar as S
from hippospark.operators import clusters as K
from hippospark.operators import kb
from hippospark.operators import knowledge as W
from hippospark.sources import sinks

from .bindings import ASSERTIONS_SQL, ENTITIES_SQL, HAPPENINGS_SQL, HEADS_SQL, RELATIONS_SQL, ROOTS_SQL, assertions, entities, epoch_s, happenings, heads, relations, table
from .common import Queries
from .lifecycle_queries import DIRECTIVES, directed

q = Queries()
QUERIES, ORACLES = q.queries, q.oracles


@q(f"WITH {ENTITIES_SQL}, {ROOTS_SQL} SELECT r.id AS asked, e.id, e.name FROM rt r JOIN ent e ON e.id = r.root")
def entity_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every entity by its id, merges followed."""
    e = entities(spark, d)
    return W.lookup(e, e.select("id")).select("asked", "id", "name")


@q(f"WITH {ENTITIES_SQL}, {ROOTS_SQL} SELECT r.id AS asked, r.root AS id FROM rt r JOIN orders ON o_custkey = CAST(substr(r.id, 2) AS BIGINT) GROUP BY 1, 2")
def entity_lookup_by_key(spark: SparkSession, d: str) -> DataFrame:
    """By namespace, type and key, for the customers that ordered."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().join(table(spark, d, "customer"), "c_custkey")
    keys = o.select(F.lit("default").alias("namespace"), F.lit("person").alias("type"), F.concat(F.lit("person:"), F.lower("c_name")).alias("canonical_key"))
    return W.lookup_key(entities(spark, d), keys).select("asked", "id")


INCOMING = """inc AS (SELECT 'r' || o_orderkey AS ref, CASE o_orderkey % 3 WHEN 0 THEN '  ' || upper(c_name) || ' ' WHEN 1 THEN lower(c_mktsegment) || '-' || c_custkey ELSE 'Visitor  ' || (o_orderkey % 50) END AS name, ['Alias ' || (o_custkey % 20), c_name] AS aliases FROM orders JOIN customer ON c_custkey = o_custkey),
kd AS (SELECT *, regexp_replace(trim(lower(name)), '\\s+', ' ', 'g') AS norm FROM inc),
rs AS (SELECT kd.ref, kd.norm, kd.name, kd.aliases, coalesce(x.id, a.id) AS hit, CASE WHEN x.id IS NOT NULL THEN 'key' WHEN a.id IS NOT NULL THEN 'alias' ELSE 'new' END AS how FROM kd LEFT JOIN ent x ON x.canonical_key = 'person:' || norm LEFT JOIN ent a ON x.id IS NULL AND a.aliases[1] = norm),
re AS (SELECT ref, norm, name, aliases, how, coalesce(rt.root, 'ent_' || substr(sha1('default|person|person:' || norm), 1, 16)) AS id FROM rs LEFT JOIN rt ON rt.id = hit)"""


def incoming(spark: SparkSession, d: str) -> DataFrame:
    """A mention per order: by name in capitals, by alias, or of somebody new."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("  "), F.upper("c_name"), F.lit(" "))).when(k % 3 == 1, F.concat(F.lower("c_mktsegment"), F.lit("-"), "c_custkey")).otherwise(F.concat(F.lit("Visitor  "), k % 50))
    return o.select(F.concat(F.lit("r"), k).alias("ref"), F.lit("default").alias("namespace"), F.lit("Person").alias("type"), name.alias("name"), F.array(F.concat(F.lit("Alias "), F.col("o_custkey") % 20), "c_name").alias("aliases"), F.lit("now").alias("now"))


@q(f"WITH {ENTITIES_SQL}, {ROOTS_SQL}, {INCOMING} SELECT ref, id, how FROM re")
def entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    """K7."""
    return W.resolve_entities(entities(spark, d), incoming(spark, d))[0]


@q(f"""WITH {ENTITIES_SQL}, {ROOTS_SQL}, {INCOMING}, ev AS (SELECT id, name, aliases FROM ent UNION ALL SELECT id, arg_min(trim(name), ref), [] FROM re WHERE how = 'new' GROUP BY id),
br AS (SELECT id, regexp_replace(trim(lower(unnest(CASE WHEN how = 'alias' THEN list_append(aliases, name) ELSE aliases END))), '\\s+', ' ', 'g') AS n FROM re),
ho AS (SELECT id, regexp_replace(trim(lower(unnest(list_append(aliases, name)))), '\\s+', ' ', 'g') AS n FROM ev)
SELECT ev.id, CAST(len(any_value(ev.aliases)) + count(DISTINCT br.n) AS BIGINT) AS n_aliases FROM ev LEFT JOIN br ON br.id = ev.id AND NOT EXISTS (SELECT 1 FROM ho WHERE ho.id = br.id AND ho.n = br.n) GROUP BY ev.id""")
def alias_merge(spark: SparkSession, d: str) -> DataFrame:
    """Entities after all mentions, with how many aliases each has."""
    return W.resolve_entities(entities(spark, d), incoming(spark, d))[1].select("id", F.size("aliases").cast("long").alias("n_aliases"))


@q("SELECT 'evt_' || substr(sha1('u' || user_id || '|' || CAST(epoch_us(ts) AS BIGINT) || '|' || event_type || '|x' || event_id), 1, 16) AS id, 'default' AS namespace, 'und' AS language, CAST(0 AS INTEGER) AS n_entities FROM events WHERE event_id % 4 <> 0")
def event_append(spark: SparkSession, d: str) -> DataFrame:
    """K9: a quarter has no text and is refused."""
    from .bindings import epoch_us

    e = table(spark, d, "events").select(epoch_us("ts").cast("string").alias("ts"), F.concat(F.lit("u"), "user_id").alias("session_key"), F.col("event_type").alias("type"), F.when(F.col("event_id") % 4 == 0, "  ").otherwise(F.concat(F.lit("x"), "event_id")).alias("text"))
    empty = spark.createDataFrame([], "id string, ts string, session_key string, session_id string, namespace string, project string, type string, text string, language string, entities array<string>, source_message_ids array<string>")
    return W.append_events(empty, e).select("id", "namespace", "language", F.size("entities").alias("n_entities"))


DELTA_ENTITIES = "array<struct<ref:string,type:string,name:string,aliases:array<string>>>"


def deltas(spark: SparkSession, d: str) -> DataFrame:
    """A delta per order: its customer, its parts as libraries, the status as a fact, an event, relations to the parts and to nothing."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"))
    o = table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    none = F.array().cast("array<string>")
    part = F.transform("parts", lambda p: F.struct(F.concat(F.lit("p"), p).alias("ref"), F.when(p % 2 == 0, "library").otherwise("gadget").alias("type"), F.concat(F.lit("Part "), p).alias("name"), none.alias("aliases")))
    who = F.array(F.struct(F.lit("c").alias("ref"), F.lit("person").alias("type"), F.col("c_name").alias("name"), none.alias("aliases")))
    facts = F.array(F.struct(F.lit("c").alias("entity_ref"), F.lit("Stato").alias("attribute"), F.col("o_orderstatus").alias("value"), epoch_s("o_orderdate").alias("valid_from"), F.lit(0.8).alias("confidence")))
    events = F.array(F.struct(F.lit("v").alias("ref"), F.lit("ordering").alias("type"), F.col("o_orderdate").cast("string").alias("ts"), F.concat(F.lit("order "), "o_orderkey").alias("text"), F.array(F.lit("c")).alias("entity_refs"), F.array(F.concat(F.lit("m"), "o_orderkey")).alias("source_message_ids")))
    rel = F.transform("parts", lambda p: F.struct(F.lit("c").alias("src_ref"), F.when(p % 3 == 0, "uses").otherwise("likes").alias("type"), F.when(p % 7 == 0, "v").otherwise(F.concat(F.lit("p"), p)).alias("dst_ref")))
    raw = F.struct(F.concat(who, part).cast(DELTA_ENTITIES).alias("entities"), facts.alias("facts"), events.alias("events"), rel.alias("relations"))
    rows = o.select(F.col("o_orderkey").cast("string").alias("delta_id"), F.concat(F.lit("u"), "o_custkey").alias("session_key"), F.lit("").alias("session_id"), F.lit("now").alias("now"), F.col("o_orderkey").alias("learned_at"), W.coerced_delta(raw).alias("x"))
    return rows.withColumn("errors", W.delta_errors(F.col("x"))).select("delta_id", "session_key", "session_id", "now", "learned_at", "errors", "x.*")


LINES = "ln AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)"


@q(f"WITH {LINES} SELECT CAST(o_orderkey AS VARCHAR) AS delta_id, CAST(1 + count(*) AS INTEGER) AS n_entities, CAST(count(*) FILTER (l_partkey % 2 = 1) AS INTEGER) AS concepts, 'stato' AS attribute, 'observation' AS event_type, CAST(count(*) FILTER (l_partkey % 7 <> 0) AS INTEGER) AS n_relations, CAST(count(*) FILTER (l_partkey % 7 <> 0 AND l_partkey % 3 = 0) AS INTEGER) AS n_uses, CAST(0 AS INTEGER) AS errors FROM orders JOIN ln ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def delta_coercion(spark: SparkSession, d: str) -> DataFrame:
    """P25."""
    x = deltas(spark, d)
    count = lambda c, f: F.size(F.filter(c, f))
    return x.select(
        "delta_id", F.size("entities").alias("n_entities"), count("entities", lambda e: e["type"] == "concept").alias("concepts"), F.col("facts")[0]["attribute"].alias("attribute"), F.col("events")[0]["type"].alias("event_type"), F.size("relations").alias("n_relations"),
        count("relations", lambda r: r["type"] == "uses").alias("n_uses"), F.size("errors").alias("errors"),
    )


def before_deltas(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {
        "entities": entities(spark, d),
        "events": spark.createDataFrame([], "id string, ts string, session_key string, session_id string, namespace string, project string, type string, text string, language string, entities array<string>, source_message_ids array<string>"),
        "facts": spark.createDataFrame([], "entity_id string, attribute string, value string, valid_from long, learned_at long, seq long, confidence double"),
        "relations": spark.createDataFrame([], "src string, type string, dst string, support long"),
    }


def applied(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return W.apply_delta(before_deltas(spark, d), deltas(spark, d))


PART_ID = "'ent_' || substr(sha1('default|' || CASE WHEN l_partkey % 2 = 0 THEN 'library|library:part ' ELSE 'concept|concept:part ' END || l_partkey), 1, 16)"


@q(f"WITH {ENTITIES_SQL}, {ROOTS_SQL}, {LINES} SELECT root AS src, CASE WHEN l_partkey % 3 = 0 THEN 'uses' ELSE 'related-to' END AS type, {PART_ID} AS dst, count(*) AS support FROM orders JOIN ln ON l_orderkey = o_orderkey JOIN rt ON rt.id = 'c' || o_custkey WHERE l_partkey % 7 <> 0 GROUP BY 1, 2, 3")
def delta_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations of all deltas."""
    return applied(spark, d)["relations"]


@q(f"""WITH {ENTITIES_SQL}, {ROOTS_SQL}, oo AS (SELECT root AS entity_id, o_orderstatus AS value, o_orderkey AS seq, epoch(o_orderdate) AS vf FROM orders JOIN rt ON rt.id = 'c' || o_custkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
h AS (SELECT entity_id, arg_max(value, (vf, seq)) AS value FROM oo GROUP BY 1)
SELECT 'fact' AS owner_kind, name || ' — status: ' || value AS text FROM h JOIN ent ON ent.id = h.entity_id UNION ALL SELECT 'event', 'order ' || o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def delta_index(spark: SparkSession, d: str) -> DataFrame:
    """What the deltas give to the index; orders are learned in the order of their dates, so heads are the latest."""
    x = deltas(spark, d).withColumn("learned_at", F.col("facts")[0]["valid_from"] * 1_000_000_000 + F.col("delta_id").cast("long"))
    return W.apply_delta(before_deltas(spark, d), x)["index"].select("owner_kind", "text")


@q("SELECT CAST(o_custkey AS BIGINT) AS batch, CAST(count(DISTINCT o_orderpriority) AS INTEGER) AS n_entities, CAST(count(*) AS INTEGER) AS n_facts, arg_min(o_orderpriority, o_orderkey) AS first_name, CAST(1 AS INTEGER) AS refs_found FROM orders GROUP BY 1")
def facts_to_delta(spark: SparkSession, d: str) -> DataFrame:
    """An order's priority as an entity, its status as the value."""
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("batch"), F.col("o_orderkey").alias("seq"), F.lit(None).cast("string").alias("entity_type"), F.concat(F.lit(" "), "o_orderpriority").alias("entity_name"), F.lit("status").alias("attribute"), F.col("o_orderstatus").alias("value"), F.lit(0.5).alias("confidence"))
    x = W.delta_of_facts(o)
    found = F.size(F.array_except(F.transform("facts", lambda f: f["entity_ref"]), F.transform("entities", lambda e: e["ref"]))) == 0
    return x.select("batch", F.size("entities").alias("n_entities"), F.size("facts").alias("n_facts"), F.col("entities")[0]["name"].alias("first_name"), F.when(found & (F.col("entities")[0]["ref"] == "e0"), 1).otherwise(0).alias("refs_found"))


@q("SELECT CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'new' ELSE 'old' END AS version, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY 1")
def index_upsert(spark: SparkSession, d: str) -> DataFrame:
    """New vectors of a third of all documents reach only those that are there."""
    docs = table(spark, d, "documents").select("doc_id")
    here = docs.where("doc_id % 2 = 0")
    old, new = here.withColumn("version", F.lit("old")), docs.where("doc_id % 3 = 0").withColumn("version", F.lit("new"))
    return W.update_vectors(old, here, new, "doc_id").groupBy("version").agg(F.count("*").alias("n"))


@q("SELECT doc_id AS owner_id, CASE WHEN doc_id % 3 = 0 THEN [CAST(0 AS DOUBLE)] ELSE [CAST(length(text) AS DOUBLE)] END AS embedding FROM documents WHERE text IS NOT NULL")
def reindex_resume(spark: SparkSession, d: str) -> DataFrame:
    """A run that goes on; a third has its vector already. Lengths stand for a model."""
    t = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("owner_id"), "text")
    done = t.where("owner_id % 3 = 0").select("owner_id", F.array(F.lit(0.0)).alias("embedding"))
    return W.reindexed(t, done, lambda texts: [[float(len(x))] for x in texts])


@q("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'done' WHEN event_id % 2 = 0 THEN 'open' END AS status FROM events")
def status_update(spark: SparkSession, d: str) -> DataFrame:
    """K17."""
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "open").alias("status"))
    return W.marked(e, e.where("event_id % 5 = 0").select("event_id", F.lit("done").alias("status")), "event_id", "status")


@q(f"WITH {ASSERTIONS_SQL}, c AS (SELECT * FROM (SELECT *, 'k' AS k FROM asr)) SELECT entity_id, attribute, value, CAST(support AS BIGINT) AS support FROM (SELECT entity_id, attribute, island, min(value) AS value, sum(support) AS support FROM (SELECT *, sum(fresh) OVER (PARTITION BY entity_id, attribute ORDER BY valid_from, seq) AS island FROM (SELECT *, CASE WHEN lag(value) OVER (PARTITION BY entity_id, attribute ORDER BY valid_from, seq) = value THEN 0 ELSE 1 END AS fresh FROM asr)) GROUP BY 1, 2, 3)")
def attribute_canonicalization(spark: SparkSession, d: str) -> DataFrame:
    """Half of all assertions name the status in Italian; as heads of one attribute they fold."""
    a = assertions(spark, d).withColumn("attribute", F.when((F.col("attribute") == "status") & (F.col("seq") % 2 == 0), "Stato").otherwise(F.col("attribute")))
    return W.canonicalized(a)[0].select("entity_id", "attribute", "value", "support")


@q("SELECT 'f' || o_orderkey || '-status' AS id, 'Stato' AS old_attribute, 'status' AS new_attribute FROM orders WHERE o_orderkey % 2 = 0")
def attribute_changes(spark: SparkSession, d: str) -> DataFrame:
    """K19 as a dry run."""
    a = assertions(spark, d).withColumn("attribute", F.when((F.col("attribute") == "status") & (F.col("seq") % 2 == 0), "Stato").otherwise(F.col("attribute")))
    return W.canonicalized(a)[1]


def merges(spark: SparkSession, d: str) -> DataFrame:
    """Two of each ten customers into the one before, the rest of the wishes impossible."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").where("c_custkey % 10 in (2, 3, 7, 9)").select(F.concat(F.lit("c"), k).alias("old"), F.when(k % 10 == 9, F.lit("nobody")).otherwise(F.concat(F.lit("c"), k - k % 10 + 1)).alias("canonical"))


def store(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"entities": entities(spark, d), "heads": heads(spark, d).withColumn("learned_at", F.col("seq")), "events": happenings(spark, d), "relations": relations(spark, d)}


MERGES = "mg AS (SELECT 'c' || c_custkey AS old, 'c' || (c_custkey - c_custkey % 10 + 1) AS canonical FROM customer WHERE c_custkey % 10 IN (2, 3))"


@q("SELECT 'c' || c_custkey AS old, CASE WHEN c_custkey % 10 = 9 THEN 'nobody' ELSE 'c' || (c_custkey - 6) END AS canonical, CASE WHEN c_custkey % 10 = 9 THEN 'canonical not found' ELSE 'already merged' END AS error FROM customer WHERE c_custkey % 10 IN (7, 9)")
def merge_errors(spark: SparkSession, d: str) -> DataFrame:
    """K21."""
    return W.merge_errors(entities(spark, d), merges(spark, d))


@q(f"WITH {ENTITIES_SQL}, {MERGES}, x AS (SELECT canonical AS id, list_distinct(flatten(list(list_prepend(name, aliases)))) AS a FROM ent JOIN mg ON mg.old = ent.id GROUP BY 1) SELECT e.id, CAST(len(list_filter(list_distinct(list_concat(e.aliases, coalesce(x.a, []))), lambda y: y <> e.name)) AS INTEGER) AS n_aliases, coalesce(mg.canonical, e.merged_into) AS merged_into FROM ent e LEFT JOIN x ON x.id = e.id LEFT JOIN mg ON mg.old = e.id")
def merged_entities(spark: SparkSession, d: str) -> DataFrame:
    """Aliases and pointers afterwards."""
    return W.merge_entities(store(spark, d), merges(spark, d))["entities"].select("id", F.size("aliases").alias("n_aliases"), "merged_into")


@q(f"""WITH {HEADS_SQL}, {MERGES}, r AS (SELECT coalesce(mg.canonical, hd.entity_id) AS entity_id, attribute, value, valid_from, support, seq, hd.id FROM hd LEFT JOIN mg ON mg.old = hd.entity_id),
m AS (SELECT *, CASE WHEN lag(value) OVER w = value THEN 0 ELSE 1 END AS fresh FROM r WINDOW w AS (PARTITION BY entity_id, attribute ORDER BY valid_from, seq, id)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY entity_id, attribute ORDER BY valid_from, seq, id) AS i FROM m),
v AS (SELECT entity_id, attribute, i, min(value) AS value, sum(support) AS support, min(valid_from) AS vf FROM g GROUP BY 1, 2, 3)
SELECT entity_id, attribute, value, CAST(support AS BIGINT) AS support, lead(vf) OVER (PARTITION BY entity_id, attribute ORDER BY i) IS NULL AS is_head FROM v""")
def merged_facts(spark: SparkSession, d: str) -> DataFrame:
    """Heads of merged entities collide and fold; supports add up."""
    return W.merge_entities(store(spark, d), merges(spark, d))["heads"].select("entity_id", "attribute", "value", "support", "is_head")


@q(f"WITH {HAPPENINGS_SQL}, {MERGES} SELECT hp.id, [coalesce(mg.canonical, entities[1]), entities[2]] AS entities FROM hp LEFT JOIN mg ON mg.old = entities[1]")
def merged_events(spark: SparkSession, d: str) -> DataFrame:
    """Entities within events."""
    return W.merge_entities(store(spark, d), merges(spark, d))["events"].select("id", "entities")


@q(f"WITH {RELATIONS_SQL}, {ENTITIES_SQL}, {ROOTS_SQL} SELECT coalesce(a.root, src) AS src, dst, CAST(sum(support) AS BIGINT) AS support FROM rel LEFT JOIN rt a ON a.id = src GROUP BY 1, 2")
def relation_backfill(spark: SparkSession, d: str) -> DataFrame:
    """K32, K22."""
    return W.relation_backfill(relations(spark, d), entities(spark, d))[0]


@q(f"WITH {RELATIONS_SQL}, {ENTITIES_SQL}, {ROOTS_SQL}, x AS (SELECT coalesce(a.root, src) AS s, dst, a.root <> src AS hit FROM rel LEFT JOIN rt a ON a.id = src), n AS (SELECT count(*) FILTER (hit) AS touched, count(*) AS kept FROM x), m AS (SELECT count(*) AS c FROM (SELECT DISTINCT s, dst FROM x)) SELECT touched, CAST(0 AS BIGINT) AS loops, kept - c AS folded, touched - (kept - c) AS moved FROM n, m")
def relation_backfill_counts(spark: SparkSession, d: str) -> DataFrame:
    """K32 as a dry run."""
    return W.relation_backfill(relations(spark, d), entities(spark, d))[1]


REPORT = """rp AS (SELECT p_brand, list('p' || p_partkey ORDER BY 'p' || p_partkey) AS ids, arg_max('p' || p_partkey, (p_size, p_partkey)) AS keep FROM part GROUP BY 1)"""


def report(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("id", F.concat(F.lit("p"), "p_partkey"))
    g = p.groupBy("p_brand").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.max_by("id", F.struct("p_size", "p_partkey")).alias("keep"), F.map_from_entries(F.collect_list(F.struct("id", "p_name"))).alias("names"))
    return W.merge_report(g.select(F.col("p_brand").alias("component"), F.lit("part").alias("type"), "ids", "keep", "names", F.lit(0.851).alias("least"), F.lit(0.96).alias("most"), F.when(F.col("p_brand") < "Brand#3", "auto").otherwise("ask").alias("band")))


@q(f"WITH {REPORT} SELECT ids[1] AS cluster, CASE WHEN p_brand < 'Brand#3' THEN 'auto' ELSE 'ask' END AS band, CASE WHEN p_brand < 'Brand#3' THEN 'OK' ELSE 'NO' END AS decision, keep, CASE WHEN p_brand < 'Brand#3' THEN list_filter(ids, lambda x: x <> keep) ELSE [] END AS merges, CASE WHEN p_brand < 'Brand#3' AND len(ids) < 2 THEN 'nothing to merge' END AS error FROM rp")
def merge_report_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Clusters by brand, rendered and read back."""
    lines = report(spark, d).select("component", F.posexplode(F.split("text", "\n")).alias("no", "value")).select(F.struct("component", "no").alias("at"), "value")
    return W.parsed_report(lines).drop("excluded")


@q("SELECT conv_id, CASE WHEN n < 3 THEN 'a' || chr(10) || 'b' || chr(10) || 'c' ELSE 'X' || chr(10) || 'b' || chr(10) || 'new' || chr(10) || 'line' || chr(10) || 'c' END AS text, n < 3 AS valid FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)")
def line_patches(spark: SparkSession, d: str) -> DataFrame:
    """Replace the first line, insert before the third, and one impossible block; long conversations only."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    block = lambda a, b, t: F.struct(F.lit(a).alias("first"), F.lit(b).alias("last"), F.lit(t).alias("content"))
    blocks = F.when(F.col("n") < 3, F.array().cast("array<struct<first:int,last:int,content:string>>")).otherwise(F.array(block(1, 1, "X"), block(3, 2, "new\nline"), block(9, 9, "no")))
    return c.select("conv_id", W.patched(F.lit("a\nb\nc"), blocks).alias("x")).select("conv_id", "x.text", "x.valid")


@q("SELECT user_id AS owner_id, CASE WHEN n + 1 = 3 THEN 'promote' ELSE 'reinforce' END AS operation, '{\"count\":' || n || '}' AS before, '{\"count\":' || (n + 1) || '}' AS after FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) WHERE n % 2 = 0")
def audit_log(spark: SparkSession, d: str) -> DataFrame:
    """Only what changed is written down."""
    g = table(spark, d, "events").groupBy(F.col("user_id").alias("owner_id")).agg(F.count("*").alias("count"))
    after = g.withColumn("count", F.when(F.col("count") % 2 == 0, F.col("count") + 1).otherwise(F.col("count")))
    return W.audit_rows(g, after, "owner_id", ("count",), F.when(F.get_json_object(F.to_json("a"), "$.count") == "3", "promote").otherwise("reinforce"), "reinforcement", F.lit("now")).select("owner_id", "operation", "before", "after")


@q("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'episodic' WHEN 1 THEN 'instruction' ELSE 'persona' END AS type, CAST(CASE WHEN turn % 5 = 0 THEN 50 ELSE least(100, turn * 30) END AS INTEGER) AS priority FROM conversations WHERE turn % 4 <> 3 AND length(trim(text)) BETWEEN 1 AND 1000")
def memory_validity(spark: SparkSession, d: str) -> DataFrame:
    """P23, P24."""
    k = F.col("turn")
    m = table(spark, d, "conversations").select("conv_id", "turn", F.when(k % 4 == 0, "Episode").when(k % 4 == 1, "instruct").when(k % 4 == 2, " preference ").otherwise("dream").alias("type"), F.col("text").alias("content"), F.when(k % 5 != 0, k * 30).alias("priority"))
    return W.valid_memories(m).select("conv_id", "turn", "type", "priority")


@q(f"""WITH {DIRECTIVES}, f AS (SELECT 'rule_' || CASE WHEN s = '' THEN 'law' ELSE s END AS attribute, strength FROM (SELECT strength, regexp_replace(substr(regexp_replace(regexp_replace(lower(trim(text)), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '^_|_$', '', 'g'), 1, 48), '_$', '') AS s FROM dir WHERE strength >= 0.4)),
g AS (SELECT attribute, max(strength) AS strength FROM f GROUP BY 1)
SELECT attribute, CASE WHEN length(attribute) % 2 = 0 THEN round(greatest(0.1, least(0.99, greatest(0.6, strength) + 0.25 * (0.99 - greatest(0.6, strength)))), 6) ELSE round(strength, 6) END AS confidence, length(attribute) % 2 = 0 AS reinforced FROM g""")
def law_capture(spark: SparkSession, d: str) -> DataFrame:
    """Rules of even length are known already."""
    t = directed(spark, d).select("text", F.lit("now").alias("now"))
    first = W.captured_laws(t, spark.createDataFrame([], "entity_id string, attribute string, confidence double"), "me")
    known = first.where(F.char_length("attribute") % 2 == 0).select("entity_id", "attribute", F.lit(0.6).alias("confidence"))
    return W.captured_laws(t, known, "me").select("attribute", F.round("confidence", 6).alias("confidence"), "reinforced")


@q(f"""WITH {HAPPENINGS_SQL}, x AS (SELECT id, session_key, session_id, project, ts_us, source_message_ids, unnest(entities) AS entity FROM hp WHERE type IN ('decision', 'fix')),
g AS (SELECT entity, count(*) AS n, count(DISTINCT session_id) AS s FROM x GROUP BY 1), sk AS (SELECT entity, session_key FROM (SELECT entity, session_key, count(*) AS n FROM x GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY entity ORDER BY n DESC, session_key) = 1),
pj AS (SELECT entity, project FROM (SELECT entity, project, count(*) AS n, min(ts_us) AS f FROM x GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY entity ORDER BY n DESC, f, project) = 1)
SELECT entity, CAST(n AS BIGINT) AS n_events, s AS n_sessions, session_key, project, CAST(n AS INTEGER) AS n_messages FROM g JOIN sk USING (entity) JOIN pj USING (entity) WHERE n >= 2 AND s >= 2 AND entity LIKE 'k%'""")
def principle_cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    """A7, A13, A14."""
    e = happenings(spark, d)
    kinds = spark.range(20).select(F.concat(F.lit("k"), "id").alias("id"))
    return K.principle_clusters(e, kinds).select("entity", "n_events", "n_sessions", "session_key", "project", F.size("provenance").alias("n_messages"))


@q(f"WITH {HAPPENINGS_SQL}, x AS (SELECT unnest(entities) AS entity, id, session_id FROM hp WHERE type IN ('decision', 'fix')), g AS (SELECT entity, count(*) AS n FROM x WHERE entity LIKE 'k%' GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT session_id) >= 2) SELECT [entity, 'principle-domain:area', 'evidence:' || n] AS entities, CAST(0.8 AS DOUBLE) AS salience FROM g")
def principle_events(spark: SparkSession, d: str) -> DataFrame:
    """K37."""
    c = K.principle_clusters(happenings(spark, d), spark.range(20).select(F.concat(F.lit("k"), "id").alias("id")))
    c = c.select(F.col("entity").alias("domain_entity"), F.lit("area").alias("domain"), "session_key", "project", F.concat(F.lit("principle of "), "entity").alias("text"), F.col("provenance").alias("event_ids"), F.col("provenance").alias("source_message_ids"))
    e, life = W.derived_events(c, "principle", "now")
    return e.join(life, F.col("id") == F.col("owner_id")).select("entities", "salience")


@q(f"WITH {ENTITIES_SQL}, t AS (SELECT id, unnest(list_distinct(list_filter(regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 3 OR regexp_matches(x, '^[0-9]+$')))) AS tok FROM ent), s AS (SELECT tok, count(*) AS n FROM t GROUP BY 1) SELECT tok AS token, n FROM s WHERE n > 50")
def reconciliation_glue(spark: SparkSession, d: str) -> DataFrame:
    """Tokens that too many entities share."""
    e = entities(spark, d).withColumn("v", F.array(F.lit(1.0), F.col("importance") + 1))
    return K.reconciliation_pairs(e, "id", "type", "name", "v")[1].select("token", "n")


RECON = """rc AS (SELECT p_partkey AS id, p_name || ' ' || (p_partkey % 40) AS name, [CAST(p_size AS DOUBLE), CAST(p_retailprice AS DOUBLE) / 40, CAST(p_partkey % 7 AS DOUBLE)] AS v FROM part),
tk AS (SELECT id, unnest(list_distinct(list_filter(regexp_extract_all(lower(name), '[\\p{L}\\p{N}]+'), lambda x: length(x) >= 3 OR regexp_matches(x, '^[0-9]+$')))) AS tok FROM rc), fw AS (SELECT tok FROM tk GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50),
pq AS (SELECT DISTINCT a.id AS a, b.id AS b FROM tk a JOIN tk b ON a.tok = b.tok AND a.id < b.id WHERE a.tok IN (SELECT tok FROM fw)),
ls AS (SELECT id, list_distinct(list_filter(regexp_extract_all(lower(name), '[\\p{L}\\p{N}]+'), lambda x: length(x) >= 3 OR regexp_matches(x, '^[0-9]+$'))) AS t, lower(name) AS n, v FROM rc),
sc AS (SELECT a, b, round(greatest(list_cosine_similarity(x.v, y.v), CASE WHEN x.n = y.n THEN 1 ELSE len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))) END), 6) AS score FROM pq JOIN ls x ON x.id = a JOIN ls y ON y.id = b)"""


def recon(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    v = F.array(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double") / 40, (F.col("p_partkey") % 7).cast("double"))
    return p.select(F.col("p_partkey").alias("id"), F.lit("part").alias("type"), F.concat("p_name", F.lit(" "), F.col("p_partkey") % 40).alias("name"), v.alias("v"))


@q(f"WITH {RECON} SELECT a, b, score, CASE WHEN score >= 0.95 THEN 'auto' ELSE 'ask' END AS band FROM sc WHERE score >= 0.85")
def reconciliation_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose names share a token, with score and band."""
    return K.reconciliation_pairs(recon(spark, d), "id", "type", "name", "v")[0]


@q(f"""WITH RECURSIVE {RECON}, pr AS (SELECT * FROM sc WHERE score >= 0.85), ed AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr), r(node, c) AS (SELECT a, a FROM ed UNION SELECT ed.b, r.c FROM r JOIN ed ON ed.a = r.node), cc AS (SELECT node, min(c) AS component FROM r GROUP BY 1)
SELECT component, CAST(count(DISTINCT node) AS INTEGER) AS size, min(score) AS least, max(score) AS most, CASE WHEN bool_or(score < 0.95) THEN 'ask' ELSE 'auto' END AS band FROM cc JOIN pr ON pr.a = node OR pr.b = node GROUP BY 1""")
def reconciliation_clusters(spark: SparkSession, d: str) -> DataFrame:
    """A28."""
    return K.reconciliation_clusters(K.reconciliation_pairs(recon(spark, d), "id", "type", "name", "v")[0]).select("component", F.size("ids").alias("size"), "least", "most", "band")


@q("WITH m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1) SELECT label, list(round(x / n, 5) ORDER BY i) AS vector FROM m JOIN n USING (label) GROUP BY 1")
def mean_pooled_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A21."""
    return K.mean_vectors(table(spark, d, "embeddings"), "label", "embedding").select("label", F.transform("vector", lambda x: F.round(x, 5)).alias("vector"))


@q("SELECT CAST(s_nationkey AS BIGINT) AS plan, count(DISTINCT s_suppkey % 3) FILTER (true) > 1 AS wrong FROM supplier GROUP BY 1 HAVING count(DISTINCT s_suppkey % 3) > 1")
def plan_subset_errors(spark: SparkSession, d: str) -> DataFrame:
    """Plans by nation against clusters by the rest of the key."""
    s = table(spark, d, "supplier")
    plans = s.groupBy(F.col("s_nationkey").cast("long").alias("plan")).agg(F.collect_list("s_suppkey").alias("ids"))
    return K.plan_errors(plans, s.select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") % 3).alias("component"))).select("plan", F.lit(True).alias("wrong"))


@q("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) > 3")
def backup_rotation(spark: SparkSession, d: str) -> DataFrame:
    """All but the newest three of each customer."""
    return sinks.backups_to_drop(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 3)


@q("""WITH o AS (SELECT o_custkey, o_orderkey, epoch(o_orderdate) AS c, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), x AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY c, o_orderkey) AS r FROM o WHERE n > 5 AND o_orderkey % 9 <> 0 AND c < 852076800)
SELECT o_custkey, o_orderkey FROM x WHERE r <= n - 5""")
def canvas_gc(spark: SparkSession, d: str) -> DataFrame:
    """K29, with five for the fifteen: old orders of customers with many, but for every ninth, which is active."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", epoch_s("o_orderdate").alias("changed"))
    active = o.where("o_orderkey % 9 = 0").select("o_custkey", "o_orderkey")
    return sinks.canvases_to_delete(o, "o_custkey", "changed", "o_orderkey", active, 852_076_800, keep=5).select("o_custkey", "o_orderkey")


@q("SELECT o_orderkey FROM orders WHERE (o_orderkey % 10 = 0 OR o_orderdate >= TIMESTAMP '1997-01-01') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def registry_prune(spark: SparkSession, d: str) -> DataFrame:
    """An unknown time stays; a row whose file is gone does not."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderkey") % 10 != 0, epoch_s("o_orderdate")).alias("updated"))
    return sinks.pruned(o, "updated", 852_076_800, table(spark, d, "customer").where("c_acctbal > 0"), "c_custkey").select("o_orderkey")
