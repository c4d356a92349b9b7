"""Queries of graphs and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hippospark.functions import scalar as S
from hippospark.operators import clusters as K
from hippospark.operators import graph as G
from hippospark.operators import retrieval as R
from hippospark.operators import vectors as V

from .bindings import EVENTS_SQL, RELATIONS_SQL, kb_events, ordered, relations, table
from .common import Queries
from .kept import kept_table
from .recall_queries import ISOLATION, isolation

q = Queries()
QUERIES, ORACLES = q.queries, q.oracles
BOTH = RELATIONS_SQL + ", nb AS (SELECT src, dst, support AS w FROM rel UNION ALL SELECT dst, src, support FROM rel)"
HOP = """h1 AS (SELECT n.src, n.dst, n.w, row_number() OVER (PARTITION BY n.src ORDER BY n.w DESC, n.dst) AS p FROM nb n JOIN seeds s ON s.id = n.src), t1 AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM h1 WHERE p <= 8),
a1 AS (SELECT dst AS id, sum(s.activation * share * 0.5) AS activation FROM t1 JOIN seeds s ON s.id = t1.src GROUP BY 1)"""
HOP2 = """h2 AS (SELECT n.src, n.dst, n.w, row_number() OVER (PARTITION BY n.src ORDER BY n.w DESC, n.dst) AS p FROM nb n JOIN a1 s ON s.id = n.src), t2 AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM h2 WHERE p <= 8),
a2 AS (SELECT dst AS id, sum(s.activation * share * 0.5) AS activation FROM t2 JOIN a1 s ON s.id = t2.src GROUP BY 1)"""
SEEDS = "seeds AS (SELECT 'c' || c_custkey AS id, 1.0 AS activation FROM customer WHERE c_custkey IN (1, 2, 4, 7) UNION ALL SELECT min(dst), 1.0 FROM rel WHERE src = 'c1')"


def weighted(spark: SparkSession, d: str) -> DataFrame:
    return relations(spark, d).withColumnRenamed("support", "weight")


def near(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours as a store keeps them."""
    return kept_table(spark, d, "neighbours", ["orders", "lineitem"], lambda: G.strongest(ordered(spark, d).withColumn("weight", F.lit(1).cast("long"))))


def seeds(spark: SparkSession, d: str) -> DataFrame:
    """Four customers, and a part that one of them ordered: two seeds are neighbours."""
    part = relations(spark, d).where("src = 'c1'").agg(F.min("dst").alias("id")).withColumn("activation", F.lit(1.0))
    return table(spark, d, "customer").where("c_custkey in (1, 2, 4, 7)").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit(1.0).alias("activation")).unionByName(part)


@q(f"WITH {BOTH} SELECT dst, CAST(sum(w) AS BIGINT) AS weight FROM nb WHERE src = 'p10' GROUP BY 1")
def neighbors(spark: SparkSession, d: str) -> DataFrame:
    """G1."""
    return G.both_ways(weighted(spark, d)).where("src = 'p10'").select("dst", "weight")


@q(f"WITH {BOTH}, {SEEDS}, {HOP} SELECT id, round(activation, 6) AS activation FROM a1 WHERE id NOT IN (SELECT id FROM seeds) AND round(activation, 6) >= 0.05 ORDER BY 2 DESC, 1 LIMIT 50")
def spread_activation_1hop(spark: SparkSession, d: str) -> DataFrame:
    """G2, G6."""
    return G.spread(weighted(spark, d), seeds(spark, d), 1, near=near(spark, d))


@q(f"WITH {BOTH}, {SEEDS}, {HOP}, {HOP2}, u AS (SELECT * FROM a1 UNION ALL SELECT * FROM a2), s AS (SELECT id, round(sum(activation), 6) AS activation FROM u WHERE id NOT IN (SELECT id FROM seeds) GROUP BY 1) SELECT id, activation FROM s WHERE activation >= 0.05 ORDER BY 2 DESC, 1 LIMIT 50")
def spread_activation_2hop(spark: SparkSession, d: str) -> DataFrame:
    """G2, G3."""
    return G.spread(weighted(spark, d), seeds(spark, d), 2, near=near(spark, d))


@q(f"WITH {EVENTS_SQL} SELECT least(entities[1], entities[2]) AS src, greatest(entities[1], entities[2]) AS dst, count(*) AS weight FROM ev WHERE entities[1] <> entities[2] GROUP BY 1, 2")
def adjacency_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """A17, G7."""
    return G.cooccurrence(kb_events(spark, d), "event_id", "entities")


PAIRS = """pr AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) >= 0.55)"""


BLOCKED = "t AS (SELECT s_suppkey, s_nationkey, unnest([CAST(s_nationkey AS VARCHAR), CAST(CAST(floor(s_acctbal / 500) AS BIGINT) AS VARCHAR)]) AS token FROM supplier), f AS (SELECT token FROM t GROUP BY 1 HAVING count(DISTINCT s_suppkey) BETWEEN 2 AND 12), pr AS (SELECT DISTINCT a.s_suppkey AS a, b.s_suppkey AS b FROM t a JOIN t b ON a.token = b.token AND a.s_suppkey < b.s_suppkey WHERE a.token IN (SELECT token FROM f))"


@q(f"WITH {BLOCKED} SELECT a, b FROM pr")
def blocking_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers that share a token; tokens of more than twelve suppliers are glue and dropped, as the operator has it."""
    s = table(spark, d, "supplier").select("s_suppkey", F.array(F.col("s_nationkey").cast("string"), F.floor(F.col("s_acctbal") / 500).cast("string")).alias("tokens"))
    return K.blocked_pairs(s, "s_suppkey", "tokens", 12)


CC = f"WITH RECURSIVE {BLOCKED}, ed AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr), r(node, c) AS (SELECT a, a FROM ed UNION SELECT ed.b, r.c FROM r JOIN ed ON ed.a = r.node), cc AS (SELECT node, min(c) AS component FROM r GROUP BY 1)"


@q(CC + " SELECT node, component FROM cc")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    """G5."""
    return K.clusters(blocking_pairs(spark, d))


@q(CC + " SELECT component, count(*) AS size, count(DISTINCT node % 3) AS sessions, list_sort(list(node)) AS ids FROM cc GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT node % 3) >= 2")
def cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    """A9, A10."""
    return K.summary(K.clusters(blocking_pairs(spark, d)).withColumn("session", F.col("node") % 3), "session")


BUGS = """bg AS (SELECT CAST(substr(p_brand, 7) AS BIGINT) AS id, [count(*) FILTER (p_size % 5 = 0), count(*) FILTER (p_size % 5 = 1), count(*) FILTER (p_size % 5 = 2), count(*) FILTER (p_size % 5 = 3), count(*) FILTER (p_size % 5 = 4)] AS v, list(DISTINCT p_type) AS c FROM part GROUP BY 1),
bp AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS cos, len(list_intersect(a.c, b.c)) / len(list_distinct(list_concat(a.c, b.c))) AS jac, len(list_filter(a.c, lambda x: list_contains(b.c, x) AND x LIKE 'PROMO%')) > 0 AS linked FROM bg a JOIN bg b ON a.id < b.id)"""


def bugs(spark: SparkSession, d: str) -> DataFrame:
    """A brand as a failure: its parts' sizes as a vector, their types as what it touches."""
    sizes = F.array(*(F.count_if(F.col("p_size") % 5 == i).cast("double") for i in range(5)))
    return table(spark, d, "part").groupBy(F.substring("p_brand", 7, 9).cast("long").alias("id")).agg(sizes.alias("v"), F.collect_set("p_type").alias("c"))


@q(f"WITH {BUGS} SELECT a, b, round(0.6 * round(cos, 6) + 0.3 * jac + CASE WHEN linked THEN 0.1 ELSE 0 END, 6) AS weight FROM bp WHERE round(0.6 * round(cos, 6) + 0.3 * jac + CASE WHEN linked THEN 0.1 ELSE 0 END, 6) >= 0.55")
def bug_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Cosine, Jaccard and links of pairs of brands; types of promotions are linked to themselves."""
    promo = table(spark, d, "part").where("p_type like 'PROMO%'").select(F.col("p_type").alias("src"), F.col("p_type").alias("dst"))
    return K.weighted_pairs(bugs(spark, d), "id", "v", "c", promo)


@q(f"WITH {BUGS}, nw AS (SELECT id FROM bg ORDER BY id DESC LIMIT 300) SELECT a, b, round(0.85 * round(cos, 6) + 0.15 * jac, 6) AS weight FROM bp WHERE a IN (SELECT id FROM nw) AND b IN (SELECT id FROM nw) AND round(0.85 * round(cos, 6) + 0.15 * jac, 6) >= 0.72")
def usage_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The newest three hundred."""
    return K.usage_pairs(bugs(spark, d), "id", "v", "c")


@q("WITH o AS (SELECT o_custkey AS g, o_orderkey, unnest(list(DISTINCT l_returnflag || l_linestatus)) AS item FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2), t AS (SELECT g, count(DISTINCT o_orderkey) AS total FROM o GROUP BY 1) SELECT g, item, count(*) AS n, total FROM o JOIN t USING (g) GROUP BY 1, 2, 4 HAVING count(*) >= ceil(total / 2.0)")
def majority_trigger(spark: SparkSession, d: str) -> DataFrame:
    """The parts of an order's lines that at least half of a customer's orders hold, flags standing for files."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("items"))
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("g")).join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return K.majority_items(o, "g", "items")


TK = "tk AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda x: length(x) >= 2))) AS token FROM documents), df AS (SELECT token, count(*) AS df FROM tk GROUP BY 1), nn AS (SELECT count(*) AS n FROM documents)"


@q(f"WITH {TK} SELECT token, df FROM df")
def doc_frequency(spark: SparkSession, d: str) -> DataFrame:
    """A6."""
    t = table(spark, d, "documents").select(S.word_tokens(F.col("text")).alias("tokens"))
    return K.document_frequency(t, "tokens")


RARITY = TK + ", ix AS (SELECT doc_id, greatest(0, ln((n + 1) / (df + 1))) AS idf, n FROM tk JOIN df USING (token), nn), rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idf DESC) AS p FROM ix), ra AS (SELECT doc_id, round(greatest(0, least(1, avg(idf) / ln((max(n) + 1) / 2))), 6) AS rarity FROM rk WHERE p <= 10 GROUP BY 1)"


def rarity(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", S.word_tokens(F.col("text")).alias("tokens"))
    return K.term_rarity(t, "doc_id", "tokens")


@q(f"WITH {RARITY} SELECT doc_id, round(rarity, 4) AS rarity FROM ra")
def term_rarity(spark: SparkSession, d: str) -> DataFrame:
    """M10, M11."""
    return rarity(spark, d).withColumn("rarity", F.round("rarity", 4))


PEAKS = RARITY + f", iso AS ({ISOLATION}), di AS (SELECT doc_id, round(0.5 * rarity + 0.5 * coalesce(isolation, 1), 6) AS score FROM ra LEFT JOIN iso ON vec_id = doc_id)"


def distinct_scores(spark: SparkSession, d: str) -> DataFrame:
    """M13 of M11 and M12: the vector of a document has its id; without one its isolation is 1."""
    i = isolation(spark, d).withColumnRenamed("vec_id", "doc_id")
    return rarity(spark, d).join(i, "doc_id", "left").select("doc_id", F.round(S.distinctiveness(F.col("rarity"), F.coalesce("isolation", F.lit(1.0))), 6).alias("score"))


@q(f"WITH {PEAKS} SELECT doc_id, round(score, 4) AS distinctiveness FROM di")
def distinctiveness(spark: SparkSession, d: str) -> DataFrame:
    """M13, fed by isolation."""
    return distinct_scores(spark, d).select("doc_id", F.round("score", 4).alias("distinctiveness"))


@q(f"WITH {PEAKS} SELECT doc_id, round(round(score, 4) * (1 - exp(-ln(2) * (doc_id % 97) / 48.0)), 4) AS score FROM di ORDER BY score DESC, doc_id LIMIT 3")
def cornerstones(spark: SparkSession, d: str) -> DataFrame:
    """T16, M14, of M13; the tables hold no times of injection, so doc_id % 97 is the age in hours."""
    m = distinct_scores(spark, d).select(F.col("doc_id").alias("id"), F.round("score", 4).alias("distinctiveness"), (-3600 * (F.col("doc_id") % 97)).alias("injected_at"))
    return R.cornerstones(m, 0).select(F.col("id").alias("doc_id"), "score")


@q("""WITH b AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) > 1)) AS t FROM benchmark)
SELECT x.item_id AS a, y.item_id AS b, round(CASE WHEN len(list_distinct(list_concat(x.t, y.t))) = 0 THEN 0 ELSE len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))) END, 6) AS score FROM b x JOIN b y ON x.item_id <> y.item_id WHERE x.item_id % 100 = 0""")
def near_dup_token_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """The items whose id is divisible by 100 against all others."""
    t = table(spark, d, "benchmark").select("item_id", S.similarity_tokens(F.col("text")).alias("t"))
    a = t.where("item_id % 100 = 0").select(F.col("item_id").alias("a"), F.col("t").alias("ta"))
    return t.crossJoin(a).where("a <> item_id").select("a", F.col("item_id").alias("b"), F.round(S.jaccard(F.col("ta"), F.col("t")), 6).alias("score"))


@q("""WITH f AS (SELECT o_orderkey, list_distinct(list('p' || (l_partkey % 40))) AS files, list_distinct(list(l_returnflag)) AS errors, max(o_orderpriority) AS task FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), c AS (SELECT * FROM f WHERE o_orderkey = (SELECT min(o_orderkey) FROM f))
SELECT f.o_orderkey, round(0.6 * len(list_intersect(f.files, c.files)) / len(list_distinct(list_concat(f.files, c.files))) + 0.25 * len(list_intersect(f.errors, c.errors)) / len(list_distinct(list_concat(f.errors, c.errors))) + 0.15 * CASE WHEN f.task = c.task THEN 1 ELSE 0 END, 6) AS score FROM f, c""")
def jaccard_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """One current fingerprint, a single row, against all stored ones."""
    o, li = table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), table(spark, d, "lineitem")
    f = o.join(li, o["o_orderkey"] == li["l_orderkey"]).groupBy("o_orderkey").agg(F.collect_set(F.concat(F.lit("p"), F.col("l_partkey") % 40)).alias("files"), F.collect_set("l_returnflag").alias("errors"), F.max("o_orderpriority").alias("task"))
    c = F.broadcast(f.orderBy("o_orderkey").limit(1).select(F.col("files").alias("cf"), F.col("errors").alias("ce"), F.col("task").alias("ct")))
    return f.crossJoin(c).select("o_orderkey", F.round(S.fingerprint_score((F.col("cf"), F.col("files")), (F.col("ce"), F.col("errors")), (F.col("ct"), F.col("task"))), 6).alias("score"))
