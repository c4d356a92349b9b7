"""Queries of composite recalls, associations, lifecycles, offload and session timers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hippospark.functions import scalar as S
from hippospark.functions.storage import saved
from hippospark.operators import graph as G
from hippospark.operators import lifecycle as L
from hippospark.operators import offload as O
from hippospark.operators import projections as P
from hippospark.operators import retrieval as R
from hippospark.operators import windows as W
from hippospark.operators.keyword_index import SegmentIndex
from hippospark.sources import readers
from hippospark.streaming import sessions as X

from .bindings import ENTITIES_SQL, HAPPENINGS_SQL, HEADS_SQL, RELATIONS_SQL, entities, epoch_s, happenings, heads, ordered, relations, table
from .common import Queries
from .kept import kept_index, kept_table
from .recall_queries import BM25_SQL, COS_SQL, TERMS, document_index, query_vector
from .lifecycle_queries import STAKES_SQL

q = Queries()
QUERIES, ORACLES = q.queries, q.oracles


def word_hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    return document_index(spark, d).search(TERMS, k)


def vector_hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    return R.vector_topk(table(spark, d, "embeddings"), query_vector(spark, d), k)


def places(hits: DataFrame, id_col: str, score: str) -> DataFrame:
    """A short list with its ranks from 0."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), id_col)) - 1)


LISTS = "WITH " + BM25_SQL.replace("{k}", "30") + ", " + COS_SQL.replace("{k}", "30") + """, fu AS (SELECT id, sum(1.0 / (61 + rank)) AS rrf, max(cosine) AS cosine, bool_or(w) AS w FROM (SELECT doc_id AS id, row_number() OVER (ORDER BY bm25 DESC, doc_id) - 1 AS rank, NULL AS cosine, true AS w FROM bm
UNION ALL SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) - 1, score, false FROM cs) GROUP BY 1)"""


def lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    w = places(word_hits(spark, d, 30), "id", "bm25").withColumn("score", S.bm25_rank_score(-F.col("bm25")))
    v = places(vector_hits(spark, d, 30), "vec_id", "score").select(F.col("vec_id").alias("id"), "rank", F.col("score").alias("cosine"))
    return w, v


@q("WITH " + BM25_SQL.replace("{k}", "10") + " SELECT doc_id AS id, round(bm25 / (1 + bm25), 6) AS score FROM bm WHERE bm25 / (1 + bm25) >= 0.75 ORDER BY score DESC, id LIMIT 5")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    """T8."""
    return R.keyword_search(word_hits(spark, d, 10), 5, 0.75).select("id", "score")


@q("WITH " + BM25_SQL.replace("{k}", "4") + " SELECT doc_id AS id, round(bm25 / (1 + bm25), 6) AS score FROM bm ORDER BY score DESC, id LIMIT 5")
def keyword_search_few(spark: SparkSession, d: str) -> DataFrame:
    """None over the threshold, but few: all of them."""
    return R.keyword_search(word_hits(spark, d, 4), 5, 0.9999).select("id", "score")


@q(LISTS + " SELECT id, round(rrf * (1 + 0.15 * pow(0.5, (id % 90) / 30.0)), 6) AS score, cosine, w AS from_words FROM fu WHERE w OR cosine >= 0.3 ORDER BY score DESC, id LIMIT 10")
def hybrid_recall(spark: SparkSession, d: str) -> DataFrame:
    """Gate and recency; a document's number stands for its age."""
    w, v = lists(spark, d)
    ids = table(spark, d, "documents").select(F.col("doc_id").alias("id")).unionByName(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))).distinct()
    return R.hybrid(w, v, ids.withColumn("age_days", F.col("id") % 90), 10)


@q(LISTS + " SELECT id, round(rrf, 6) AS score FROM fu JOIN documents ON doc_id = id WHERE lang = 'en' AND contains(lower(source), 'src') ORDER BY score DESC, id LIMIT 10")
def memory_search_tool(spark: SparkSession, d: str) -> DataFrame:
    """T10."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("type"), F.col("source").alias("scene_name"))
    return R.search_tool(*lists(spark, d), rows, 10, kind="en", scene="SRC")


@q("WITH " + BM25_SQL.replace("{k}", "30") + " SELECT doc_id AS id, round(bm25 / (1 + bm25), 6) AS score FROM bm JOIN documents USING (doc_id) WHERE source = 'src1' OR lang = 'de' ORDER BY score DESC, id LIMIT 5")
def conversation_search_tool(spark: SparkSession, d: str) -> DataFrame:
    """One list alone, of one session."""
    w, v = lists(spark, d)
    session = F.when((F.col("source") == "src1") | (F.col("lang") == "de"), "s").otherwise("t")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), session.alias("session_key"))
    return R.search_tool(w, v.limit(0), rows, 5, session_key="s")


@q("WITH qv AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM embeddings, qv WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 10")
def kind_topk(spark: SparkSession, d: str) -> DataFrame:
    """Of one kind, filtered before the top k."""
    return R.vector_topk(table(spark, d, "embeddings"), query_vector(spark, d), 10, where=F.col("label") == 3)


@q("WITH qv AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), m AS (SELECT conv_id * 1000 + turn AS id, row_number() OVER (ORDER BY conv_id, turn) - 1 AS vec_id FROM conversations) SELECT id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM m JOIN embeddings USING (vec_id), qv ORDER BY score DESC, id LIMIT 10")
def message_topk(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of messages, by their places among all."""
    m = W.numbered(table(spark, d, "conversations").select("conv_id", "turn"), [F.asc_nulls_last("conv_id"), F.asc_nulls_last("turn")], "vec_id").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "vec_id")
    return R.vector_topk(m.join(table(spark, d, "embeddings"), "vec_id"), query_vector(spark, d), 10, "id")


KB = ("urgent", "click", "status")
KB_ROWS = f"""kr AS (SELECT hd.id, 'fact' AS kind, coalesce(name, entity_id) || ' — ' || attribute || ': ' || value AS text, entity_id, valid_from / 86400.0 AS day, (coalesce(importance, 50) / 100 + confidence + CASE WHEN support > 0 THEN 1 - 1.0 / support ELSE 0 END) / 3 AS importance, CAST(substr(entity_id, 2) AS BIGINT) AS vec_id FROM hd LEFT JOIN ent ON ent.id = entity_id
  UNION ALL SELECT id, 'event', text, NULL, ts_us / 86400000000.0, 0.5, event_id FROM hp)"""
KB_WORDS = """kt AS (SELECT id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t FROM kr), kc AS (SELECT id, len(t) AS dl, len(list_filter(t, lambda x: x = 'urgent')) AS a, len(list_filter(t, lambda x: x = 'click')) AS b, len(list_filter(t, lambda x: x = 'status')) AS c FROM kt),
ks AS (SELECT count(*) AS n, avg(dl) AS av, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db, count(*) FILTER (c > 0) AS dc FROM kc), ki AS (SELECT *, greatest(ln((n - da + 0.5) / (da + 0.5)), 1e-6) AS ia, greatest(ln((n - db + 0.5) / (db + 0.5)), 1e-6) AS ib, greatest(ln((n - dc + 0.5) / (dc + 0.5)), 1e-6) AS ic FROM ks),
kb AS (SELECT id, round(ia * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / av)) + ib * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / av)) + ic * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * dl / av)), 6) AS bm25 FROM kc, ki WHERE a + b + c > 0 ORDER BY bm25 DESC, id LIMIT 15),
kv AS (SELECT id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(z.embedding AS DOUBLE[])), 6) AS score FROM kr JOIN embeddings e USING (vec_id), embeddings z WHERE z.vec_id = 0 ORDER BY score DESC, id LIMIT 15),
km AS (SELECT id AS entity_id, row_number() OVER (ORDER BY CAST(contains(lower(name), '7') AS INTEGER) + CAST(contains(lower(name), '42') AS INTEGER) DESC, id) AS place FROM ent WHERE contains(lower(name), '7') OR contains(lower(name), '42') QUALIFY place <= 15),
ke AS (SELECT id, row_number() OVER (ORDER BY place, attribute, id) - 1 AS rank FROM hd JOIN km USING (entity_id) QUALIFY rank < 15),
kf AS (SELECT id, sum(1.0 / (61 + rank)) AS rrf, max(cosine) AS cosine FROM (SELECT id, row_number() OVER (ORDER BY bm25 DESC, id) - 1 AS rank, NULL AS cosine FROM kb UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1, score FROM kv UNION ALL SELECT id, rank, NULL FROM ke) GROUP BY 1),
kx AS (SELECT kr.*, rrf, cosine, rrf * (1 + 0.15 * CASE WHEN 20089 - day < 0 THEN 1 ELSE pow(0.5, (20089 - day) / 30) END) * (1 + 0.15 * importance) AS ranking FROM kf JOIN kr USING (id))"""


KB_TABLES = ("orders", "customer", "events", "embeddings")


def kb_heads(spark: SparkSession, d: str) -> DataFrame:
    """Head facts as a store keeps them."""
    return kept_table(spark, d, "kb-heads", KB_TABLES, lambda: heads(spark, d), "entity_id")


def kb_rows(spark: SparkSession, d: str) -> DataFrame:
    """What may be recalled: id, kind, text, entity_id, day, importance."""

    def build() -> DataFrame:
        h = kb_heads(spark, d).join(entities(spark, d).select(F.col("id").alias("entity_id"), "name", F.col("importance").alias("_imp")), "entity_id", "left")
        f = h.select("id", F.lit("fact").alias("kind"), F.concat(F.coalesce("name", "entity_id"), F.lit(" — "), "attribute", F.lit(": "), "value").alias("text"), "entity_id", (F.col("valid_from") / 86400.0).alias("day"), S.fact_importance(F.col("_imp"), F.col("confidence"), F.col("support")).alias("importance"))
        e = happenings(spark, d).select("id", F.lit("event").alias("kind"), "text", F.lit(None).cast("string").alias("entity_id"), (F.col("ts_us") / 86400000000.0).alias("day"), F.lit(0.5).alias("importance"))
        return f.unionByName(e)

    return kept_table(spark, d, "kb-rows", KB_TABLES, build, "id")


def kb_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors by their owners: a customer's facts and an event have the vector of their number."""

    def build() -> DataFrame:
        e = table(spark, d, "embeddings").select("vec_id", "embedding")
        f = kb_heads(spark, d).select("id", F.substring("entity_id", 2, 20).cast("long").alias("vec_id"))
        return f.unionByName(table(spark, d, "events").select(F.concat(F.lit("e"), "event_id").alias("id"), F.col("event_id").alias("vec_id"))).join(e, "vec_id").select("id", "embedding")

    return kept_table(spark, d, "kb-vectors", KB_TABLES, build)


def kept_near(spark: SparkSession, d: str) -> DataFrame:
    """The neighbours of all relations."""
    return kept_table(spark, d, "relation-neighbours", ["orders", "lineitem"], lambda: G.strongest(G.relation_edges(relations(spark, d))))


def kb_index(spark: SparkSession, d: str) -> SegmentIndex:
    return kept_index(spark, d, "kb-index", KB_TABLES, lambda: kb_rows(spark, d), "id", "text", "string")


def kb_candidates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ranked lists by keyword, vector and entity; nothing is built for them."""
    from hippospark.operators.lookups import entity_head_candidates

    w = places(kb_index(spark, d).search(KB, 15), "id", "bm25")
    v = places(R.vector_topk(kb_vectors(spark, d), query_vector(spark, d), 15, "id"), "id", "score").select("id", "rank", F.col("score").alias("cosine"))
    m = places(R.entity_matches(entities(spark, d), ("7", "42"), "id", "name", 15), "id", "hits").select(F.col("id").alias("entity_id"), (F.col("rank") + 1).alias("place"))
    return w, v, entity_head_candidates(m, kb_heads(spark, d), 15).select("id", "rank")


def recalled(spark: SparkSession, d: str, neighbours: DataFrame | None) -> DataFrame:
    return R.kb_recall(*kb_candidates(spark, d), kb_rows(spark, d), 5, 20_089.0, neighbours)


KB_HEAD = f"WITH {HEADS_SQL}, {ENTITIES_SQL}, {HAPPENINGS_SQL}, {KB_ROWS}, {KB_WORDS}"


@q(KB_HEAD + " SELECT id, kind, text, round(greatest(0, least(1, coalesce(cosine, rrf * 61 / (rrf * 61 + 1)))), 6) AS score, round(ranking, 8) AS ranking FROM kx ORDER BY ranking DESC, id LIMIT 5")
def kb_recall(spark: SparkSession, d: str) -> DataFrame:
    """Keyword, vector and entity candidates of head facts and events, weighed by recency and importance."""
    return recalled(spark, d, None)


@q(KB_HEAD + f""", {RELATIONS_SQL}, be AS (SELECT entity_id AS id, max(ranking) AS ranking FROM kx WHERE entity_id IS NOT NULL GROUP BY 1), cn AS (SELECT DISTINCT a.src, b.src AS dst FROM (SELECT src, dst FROM rel WHERE src IN (SELECT id FROM be)) a JOIN (SELECT src, dst FROM rel WHERE src IN (SELECT id FROM be)) b ON a.dst = b.dst AND a.src <> b.src),
tp AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS p FROM cn QUALIFY p <= 8), sh AS (SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY src) AS share FROM tp), bo AS (SELECT dst AS entity_id, 0.15 * sum(ranking * share * 0.5) AS boost FROM sh JOIN be ON be.id = src GROUP BY 1),
ky AS (SELECT kx.*, ranking + coalesce(boost, 0) AS r FROM kx LEFT JOIN bo USING (entity_id)) SELECT id, kind, text, round(greatest(0, least(1, coalesce(cosine, rrf * 61 / (rrf * 61 + 1)))), 6) AS score, round(r, 8) AS ranking FROM ky ORDER BY round(r, 8) DESC, id LIMIT 5""")
def kb_recall_primed(spark: SparkSession, d: str) -> DataFrame:
    """Customers that ordered a part in common prime each other."""
    # three times fifteen ids at most: as a filter they reach the orders before these meet their lines
    ids = [r["entity_id"] for r in recalled_candidates(spark, d).collect()]
    r = saved(ordered(spark, d).where(F.col("src").isin(ids)).select("src", F.col("dst").alias("part")).distinct(), "related")
    near = r.join(r.withColumnRenamed("src", "dst"), "part").where("src <> dst").select("src", "dst").distinct().withColumn("weight", F.lit(1.0))
    return recalled(spark, d, near)


def recalled_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Entities of all facts that the three lists hold: three times fifteen ids at most."""
    w, v, e = kb_candidates(spark, d)
    ids = w.select("id").unionByName(v.select("id")).unionByName(e.select("id")).distinct()
    return kb_rows(spark, d).join(ids, "id").where("entity_id is not null").select("entity_id").distinct()


@q("""WITH k AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) AS term, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS dl, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t FROM benchmark)
SELECT item_id AS id, term, CAST(len(list_filter(t, lambda x: x = term)) AS BIGINT) AS tf, CAST(dl AS INTEGER) AS dl FROM k""")
def keyword_postings(spark: SparkSession, d: str) -> DataFrame:
    """What an index holds: words, their counts, and the texts' lengths."""
    return R.postings(table(spark, d, "benchmark"), "item_id", "text")


# Associations

CANDS = "cd AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT 'k' || i FROM range(20) t(i) UNION ALL SELECT 'p' || p_partkey FROM part WHERE p_partkey % 4 = 0)"


def candidates(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_custkey % 5 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    p = table(spark, d, "part").where("p_partkey % 4 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    return c.unionByName(spark.range(20).select(F.concat(F.lit("k"), "id").alias("id"))).unionByName(p)


@q(f"WITH {HAPPENINGS_SQL}, {RELATIONS_SQL}, {CANDS}, e AS (SELECT entities[1] AS src, entities[2] AS dst, 1 AS w FROM hp WHERE entities[1] IN (SELECT id FROM cd) UNION ALL SELECT src, dst, support FROM rel WHERE src IN (SELECT id FROM cd) AND dst IN (SELECT id FROM cd)), b AS (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e) SELECT src, dst, CAST(sum(w) AS BIGINT) AS weight FROM b GROUP BY 1, 2")
def candidate_adjacency(spark: SparkSession, d: str) -> DataFrame:
    """Events and relations among candidates."""
    return G.adjacency(happenings(spark, d), relations(spark, d), candidates(spark, d)).select("src", "dst", F.col("weight").cast("long").alias("weight"))


@q(f"""WITH {HAPPENINGS_SQL}, {RELATIONS_SQL}, {CANDS}, e AS (SELECT entities[1] AS src, entities[2] AS dst, 1 AS w FROM hp WHERE entities[1] IN (SELECT id FROM cd) UNION ALL SELECT src, dst, support FROM rel WHERE src IN (SELECT id FROM cd) AND dst IN (SELECT id FROM cd)), b AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e) GROUP BY 1, 2),
t AS (SELECT src, dst, w FROM b QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) <= 8), s AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM t), g AS (SELECT dst AS id, sum((1 + length(src)) / 10.0 * share * 0.5) AS a FROM s GROUP BY 1)
SELECT cd.id, round(0.15 * coalesce(a, 0), 6) AS boost FROM cd LEFT JOIN g USING (id)""")
def priming(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate, ranked by the length of its name."""
    near = G.adjacency(happenings(spark, d), relations(spark, d), candidates(spark, d))
    r = candidates(spark, d).withColumn("ranking", (1 + F.char_length("id")) / 10.0)
    return G.primed(r, near).select("id", F.round("boost", 6).alias("boost"))


HOPS = """nb AS (SELECT src, dst, sum(support) AS w FROM (SELECT src, dst, support FROM rel UNION ALL SELECT dst, src, support FROM rel) GROUP BY 1, 2), tp AS (SELECT src, dst, w FROM nb QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) <= 8), sh AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM tp),
a1 AS (SELECT dst AS id, sum(share * 0.5) AS a FROM sh WHERE src IN ('c1', 'c2', 'c4') GROUP BY 1), a2 AS (SELECT dst AS id, sum(a1.a * share * 0.5) AS a FROM sh JOIN a1 ON a1.id = src GROUP BY 1), a3 AS (SELECT dst AS id, sum(a2.a * share * 0.5) AS a FROM sh JOIN a2 ON a2.id = src GROUP BY 1)"""
BEST = """bf AS (SELECT entity_id, arg_max({'id': id, 'text': attribute || ': ' || value}, (confidence, id)) AS m FROM hd GROUP BY 1), px AS (SELECT 'p' || (event_id % 2500) AS entity_id, arg_max({'id': id, 'text': text}, (ts_us, id)) AS m FROM hp GROUP BY 1)"""
REACHED = "SELECT entity_id, activation, coalesce(bf.m.id, px.m.id) AS owner_id, CASE WHEN bf.m IS NOT NULL THEN 'fact' ELSE 'event' END AS owner_kind, coalesce(bf.m.text, px.m.text) AS text FROM ac LEFT JOIN bf USING (entity_id) LEFT JOIN px USING (entity_id) WHERE coalesce(bf.m.id, px.m.id) IS NOT NULL"


def about_parts(spark: SparkSession, d: str) -> DataFrame:
    return happenings(spark, d).withColumn("entities", F.array(F.concat(F.lit("p"), F.col("event_id") % 2500)))


def three_seeds(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([("c1",), ("c2",), ("c4",)], "id string")


@q(f"WITH {RELATIONS_SQL}, {HEADS_SQL}, {HAPPENINGS_SQL}, {HOPS}, {BEST}, ac AS (SELECT id AS entity_id, round(sum(a), 6) AS activation FROM (SELECT * FROM a1 UNION ALL SELECT * FROM a2) WHERE id NOT IN ('c1', 'c2', 'c4') GROUP BY 1 HAVING round(sum(a), 6) >= 0.05 ORDER BY 2 DESC, 1 LIMIT 6) {REACHED}")
def associations(spark: SparkSession, d: str) -> DataFrame:
    """G3."""
    return G.associations(relations(spark, d), three_seeds(spark, d), kb_heads(spark, d), about_parts(spark, d), near=kept_near(spark, d))


@q(f"WITH {RELATIONS_SQL}, {HEADS_SQL}, {HAPPENINGS_SQL}, {HOPS}, {BEST}, ac AS (SELECT id AS entity_id, round(sum(a), 6) AS activation FROM (SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3) WHERE id NOT IN ('c1', 'c2', 'c4') GROUP BY 1 HAVING round(sum(a), 6) >= 0.05 ORDER BY 2 DESC, 1 LIMIT 16) {REACHED}")
def thin_recall_deepening(spark: SparkSession, d: str) -> DataFrame:
    """Two hits are few, so the search goes deeper."""
    hits = spark.createDataFrame([(0.9,), (0.1,)], "score double")
    return G.deepened(hits, "score", relations(spark, d), three_seeds(spark, d), kb_heads(spark, d), about_parts(spark, d), near=kept_near(spark, d))


@q(f"""WITH {HAPPENINGS_SQL}, {RELATIONS_SQL}, bg AS (SELECT session_key AS cluster, id, entities FROM hp WHERE type = 'bug'), ow AS (SELECT DISTINCT cluster, unnest(entities) AS e FROM bg), lk AS (SELECT DISTINCT src, 'k' || (CAST(substr(dst, 2) AS BIGINT) % 20) AS dst FROM rel WHERE support >= 2),
lb AS (SELECT src, dst FROM lk UNION SELECT dst, src FROM lk), fx AS (SELECT DISTINCT cluster, dst AS e FROM ow JOIN lb ON src = e EXCEPT SELECT cluster, e FROM ow) SELECT DISTINCT cluster, text FROM fx JOIN (SELECT id, text, unnest(entities) AS e FROM hp) USING (e) WHERE NOT EXISTS (SELECT 1 FROM bg WHERE bg.cluster = fx.cluster AND bg.id = id)""".replace("bg.id = id)", "bg.id = x.id)").replace("unnest(entities) AS e FROM hp) USING", "unnest(entities) AS e FROM hp) x USING"))
def fix_texts(spark: SparkSession, d: str) -> DataFrame:
    """A session's bugs are a cluster; what its customers ordered twice leads to what is said of the same numbers."""
    e = happenings(spark, d)
    r = relations(spark, d).where("support >= 2").select("src", F.concat(F.lit("k"), F.substring("dst", 2, 20).cast("long") % 20).alias("dst"), F.lit("fixed-by").alias("type"))
    return G.fix_texts(e.where("type = 'bug'").select(F.col("session_key").alias("cluster"), "id"), r, e)


# Lifecycles

LIFE = "owner_id string, owner_kind string, salience double, permanence_score double, reinforcement_count long, last long, created long, tier string, state string, gate_state string, origin string, contradiction boolean, updated long"
LIVES_SQL = "lf AS (SELECT id AS owner_id, event_id % 10 / 10.0 AS salience, event_id % 4 AS n, CAST(floor(ts_us / 1000000) AS BIGINT) AS created, session_key, text, type FROM hp WHERE event_id % 2 = 0)"


def lives(spark: SparkSession, d: str) -> DataFrame:
    """Half of the events have a lifecycle."""
    k = F.col("event_id")
    e = happenings(spark, d).where("event_id % 2 = 0").select(F.col("id").alias("owner_id"), F.lit("event").alias("owner_kind"), (k % 10 / 10.0).alias("salience"), (k % 4).alias("reinforcement_count"), F.floor(F.col("ts_us") / 1_000_000).cast("long").alias("created"))
    e = e.withColumn("permanence_score", S.permanence(F.col("reinforcement_count"), F.col("salience")))
    e = e.withColumns({"last": F.lit(None).cast("long"), "tier": F.lit("short"), "state": F.lit("active"), "gate_state": F.lit("clear"), "origin": F.lit("conversation"), "contradiction": F.lit(False), "updated": F.lit(0).cast("long")})
    return e.select(*[c.split()[0] for c in LIFE.split(", ")])


@q(f"WITH {HAPPENINGS_SQL} SELECT id AS owner_id, CASE WHEN event_id % 2 = 0 THEN event_id % 10 / 10.0 ELSE 0 END AS salience, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 4 AS BIGINT) ELSE 0 END AS n FROM hp")
def lifecycle_ensure(spark: SparkSession, d: str) -> DataFrame:
    """LC1."""
    owners = happenings(spark, d).select(F.col("id").alias("owner_id"), F.lit("event").alias("owner_kind"))
    return L.ensured(lives(spark, d), owners, 1).select("owner_id", "salience", F.col("reinforcement_count").alias("n"))


@q(f"WITH {HAPPENINGS_SQL} SELECT id AS owner_id, round(CASE WHEN event_id % 2 = 0 THEN greatest(event_id % 10 / 10.0, 0.45) ELSE 0.45 END, 6) AS salience, round(CASE WHEN event_id % 2 = 0 THEN 0.5 * (event_id % 4) + greatest(event_id % 10 / 10.0, 0.45) ELSE 0.45 END, 6) AS permanence FROM hp")
def salience_stamp(spark: SparkSession, d: str) -> DataFrame:
    """LC3."""
    peaks = happenings(spark, d).select(F.col("id").alias("owner_id"), F.lit("event").alias("owner_kind"), F.lit(0.45).alias("salience"))
    return L.stamped(lives(spark, d), peaks, 1).select("owner_id", F.round("salience", 6).alias("salience"), F.round("permanence_score", 6).alias("permanence"))


GATED = STAKES_SQL.replace("html", "said")


@q(f"WITH {HAPPENINGS_SQL}, {LIVES_SQL}, s AS (SELECT owner_id, CASE type WHEN 'bug' THEN 'git push --force origin main' WHEN 'fix' THEN 'rm -rf build' ELSE text END AS said FROM lf) SELECT owner_id, CASE WHEN {GATED} <> 'none' THEN 'pending_confirmation' ELSE 'clear' END AS gate_state FROM s")
def gate_recalled(spark: SparkSession, d: str) -> DataFrame:
    """LC8, P15, P17."""
    said = F.when(F.col("type") == "bug", "git push --force origin main").when(F.col("type") == "fix", "rm -rf build").otherwise(F.col("text"))
    r = happenings(spark, d).select(F.col("id").alias("owner_id"), F.lit("event").alias("owner_kind"), said.alias("text"))
    return L.gate_recalled(lives(spark, d), r).select("owner_id", "gate_state")


@q("SELECT 'f' || o_orderkey AS id, CAST(CASE WHEN o_orderkey % 6 = 0 THEN 0.99 ELSE 0.5 END AS DOUBLE) AS confidence, CASE WHEN o_orderkey % 6 = 1 THEN 'f' || (o_orderkey - 1) END AS superseded_by, CASE WHEN o_orderkey % 6 = 1 THEN 9 END AS valid_to FROM orders WHERE NOT (o_orderkey % 6 = 1 AND (o_orderkey - 1) NOT IN (SELECT o_orderkey FROM orders)) UNION ALL SELECT 'f' || o_orderkey, 0.5, NULL, NULL FROM orders WHERE o_orderkey % 6 = 1 AND (o_orderkey - 1) NOT IN (SELECT o_orderkey FROM orders)")
def memory_confirmation(spark: SparkSession, d: str) -> DataFrame:
    """LC7: every sixth fact is confirmed in place of the next."""
    o = table(spark, d, "orders")
    f = o.select(F.concat(F.lit("f"), "o_orderkey").alias("id"), F.lit(0.5).alias("confidence"), F.lit(None).cast("string").alias("superseded_by"), F.lit(None).cast("long").alias("valid_to"))
    c = o.where("o_orderkey % 6 = 0").select(F.concat(F.lit("f"), "o_orderkey").alias("owner_id"), F.lit("fact").alias("owner_kind"), F.concat(F.lit("f"), "o_orderkey").alias("fact_id"), F.concat(F.lit("f"), F.col("o_orderkey") + 1).alias("superseded_fact_id"))
    return L.confirmed(spark.createDataFrame([], LIFE), f, c, 9)[1]


@q(f"WITH {HAPPENINGS_SQL}, b AS (SELECT DISTINCT unnest(entities) AS e FROM hp WHERE session_key = 'u3' AND type = 'bug'), x AS (SELECT p_partkey AS id, p_size / 50.0 AS c, p_partkey % 6 AS a, 'k' || (p_partkey % 20) AS f FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 6 >= 3) SELECT id, f IN (SELECT e FROM b) AS relapsed, round(greatest(0.1, least(0.99, CASE WHEN f IN (SELECT e FROM b) THEN 0.8 * c ELSE c + 0.25 * (0.99 - c) END)), 6) AS confidence, CAST(a + CASE WHEN f IN (SELECT e FROM b) THEN 0 ELSE 1 END AS BIGINT) AS avoidance_count FROM x")
def avoidance_credit(spark: SparkSession, d: str) -> DataFrame:
    """LC9, M16."""
    k = F.col("p_partkey")
    x = table(spark, d, "part").select(k.alias("id"), F.array(F.concat(F.lit("k"), k % 20)).alias("files"), (F.col("p_size") / 50.0).alias("confidence"), (k % 6).alias("avoidance_count"), F.when(k % 2 == 0, "u3").otherwise("u4").alias("last_session"))
    return L.credited(x, happenings(spark, d), "u3").select("id", "relapsed", F.round("confidence", 6).alias("confidence"), F.col("avoidance_count").cast("long").alias("avoidance_count"))


@q("SELECT 'L' || k AS id, CAST(coalesce(n, 0) AS BIGINT) AS exposure_count, coalesce(s, '') AS last_session FROM range(30) t(k) LEFT JOIN (SELECT event_id % 25 AS k, count(*) AS n, arg_max('u' || user_id, event_id) AS s FROM events GROUP BY 1) USING (k)")
def exposure_counters(spark: SparkSession, d: str) -> DataFrame:
    """LC12."""
    x = spark.range(30).select(F.concat(F.lit("L"), "id").alias("id"), F.lit(0).cast("long").alias("exposure_count"), F.lit("").alias("last_session"))
    log = table(spark, d, "events").select(F.concat(F.lit("L"), F.col("event_id") % 25).alias("id"), F.concat(F.lit("u"), "user_id").alias("session"), F.col("event_id").alias("at"))
    return L.counted(x, log, "exposure_count", "session")


@q("""WITH RECURSIVE v AS (SELECT user_id, event_type = 'purchase' AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events), w AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS p, CAST(0.5 AS DOUBLE) AS x FROM events UNION ALL SELECT w.user_id, v.p, greatest(0.05, least(0.99, CASE WHEN v.c THEN x + 0.25 * (0.99 - x) ELSE 0.65 * x END)) FROM w JOIN v ON v.user_id = w.user_id AND v.p = w.p + 1)
SELECT user_id AS id, round(arg_max(x, p), 6) AS willingness FROM w GROUP BY 1""")
def stance_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """M17 over a stance's whole record: purchases confirm, others reject."""
    e = table(spark, d, "events")
    x = e.select(F.col("user_id").alias("id")).distinct().withColumn("willingness", F.lit(0.5))
    return L.judged(x, e.select(F.col("user_id").alias("id"), (F.col("event_type") == "purchase").alias("confirmed"), F.col("event_id").alias("at"))).select("id", F.round("willingness", 6).alias("willingness"))


@q(f"""WITH {HAPPENINGS_SQL}, {LIVES_SQL}, nw AS (SELECT CAST(max(floor(ts_us / 1000000)) AS BIGINT) + 1000000 AS now FROM hp), u AS (SELECT id AS owner_id, 'event' AS owner_kind, coalesce(n, 0) + CASE WHEN hp.session_key = 'u3' THEN 1 ELSE 0 END AS n, coalesce(salience, 0) AS s, hp.session_key = 'u3' AS hit, created FROM hp LEFT JOIN lf ON owner_id = id WHERE owner_id IS NOT NULL OR hp.session_key = 'u3'
UNION ALL SELECT 'f' || event_id, 'fact', 1, 0, true, NULL FROM events WHERE user_id = 3), p AS (SELECT *, 0.5 * n + s AS perm, CASE WHEN n >= 3 AND 0.5 * n + s >= 1.5 AND hit THEN 'long' ELSE 'short' END AS tier, NOT hit AND created < now - 1209600 AS stale FROM u, nw),
c AS (SELECT owner_id, owner_kind, CAST(n AS BIGINT) AS n, round(CASE WHEN stale THEN CASE WHEN s >= 0.7 THEN greatest(0.25, perm * 0.9) ELSE perm * 0.5 END ELSE perm END, 6) AS permanence, tier, CASE WHEN stale AND s < 0.7 AND perm * 0.5 < 0.25 THEN 'dormant' ELSE 'active' END AS state, false AS contradiction FROM p),
k AS (SELECT 'h' || o_orderkey AS owner_id FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS l FROM orders) WHERE o_orderdate = l QUALIFY count(DISTINCT o_orderstatus) OVER (PARTITION BY o_custkey) > 1)
SELECT * FROM c UNION ALL SELECT owner_id, 'fact', 0, 0.0, 'short', 'active', true FROM k""".replace("QUALIFY count(DISTINCT o_orderstatus) OVER (PARTITION BY o_custkey) > 1", "AND o_custkey IN (SELECT o_custkey FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS l FROM orders) WHERE o_orderdate = l GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1)"))
def consolidation(spark: SparkSession, d: str) -> DataFrame:
    """LC10: a session ends; every event has a fact from it, and a customer's last orders are head facts."""
    from hippospark.operators import kb

    e = happenings(spark, d)
    now = (e.agg(F.floor(F.max("ts_us") / 1_000_000)).first()[0] or 0) + 1_000_000
    facts = e.select(F.concat(F.lit("f"), "event_id").alias("id"), F.col("id").alias("source_event_id"))
    o = table(spark, d, "orders").select(F.concat(F.lit("h"), "o_orderkey").alias("id"), F.col("o_custkey").alias("entity_id"), F.lit("status").alias("attribute"), F.col("o_orderstatus").alias("value"), "o_orderdate")
    out = L.consolidated(lives(spark, d), e, facts, kb.newest(o, "o_orderdate"), "u3", int(now))
    return out.select("owner_id", "owner_kind", F.col("reinforcement_count").alias("n"), F.round("permanence_score", 6).alias("permanence"), "tier", "state", "contradiction")


@q("""WITH n AS (SELECT 'm' || o_orderkey AS record_id, 'order ' || o_orderkey AS content, CASE o_orderkey % 4 WHEN 0 THEN 'store' WHEN 1 THEN 'skip' WHEN 2 THEN 'merge' END AS action, o_orderkey - 2 AS t FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 4 = 1)
SELECT record_id, CASE WHEN action = 'merge' AND t % 8 = 0 THEN 'merged' ELSE content END AS content, CAST(CASE WHEN action = 'merge' THEN 90 ELSE 50 END AS INTEGER) AS priority FROM n WHERE action IS NULL OR action <> 'skip'
UNION ALL SELECT 'm' || o_orderkey, 'old', 10 FROM orders WHERE o_orderkey % 4 = 3 AND NOT EXISTS (SELECT 1 FROM n WHERE action = 'merge' AND n.t + 1 = o_orderkey)""")
def decisions_applied(spark: SparkSession, d: str) -> DataFrame:
    """LC14: memories stored, skipped or merged over the records of old orders."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    old = o.where(k % 4 == 3).select(F.concat(F.lit("m"), k).alias("record_id"), F.lit("old").alias("content"), F.lit("episodic").alias("type"), F.lit(10).alias("priority"))
    new = o.where((k % 2 == 0) | (k % 4 == 1)).select(
        F.concat(F.lit("m"), k).alias("record_id"), F.concat(F.lit("order "), k).alias("content"), F.lit("episodic").alias("type"), F.lit(50).alias("priority"), F.when(k % 4 == 0, "store").when(k % 4 == 1, "skip").when(k % 4 == 2, "merge").alias("action"),
        F.array(F.concat(F.lit("m"), k - 1)).alias("target_ids"), F.when((k - 2) % 8 == 0, "merged").alias("merged_content"), F.lit(None).cast("string").alias("merged_type"), F.lit(90).alias("merged_priority"),
    )
    return L.applied(old, new).select("record_id", "content", "priority")


# Offload

ENTRIES_SQL = "en AS (SELECT user_id AS session_key, event_id AS idx, CASE event_type WHEN 'purchase' THEN NULL WHEN 'click' THEN 'wait' ELSE '00' || (event_id % 3) || '-N' || (event_id % 5) END AS node_id, 'call_' || (event_id % 40) || '_x' AS tool_call_id, CASE WHEN event_id % 4 > 0 THEN 'c' || (event_id % 3) END AS canvas, CAST(floor(epoch(ts)) AS BIGINT) AS said_at FROM events)"


def entries(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    node = F.when(F.col("event_type") == "click", "wait").when(F.col("event_type") != "purchase", F.concat(F.lit("00"), k % 3, F.lit("-N"), k % 5))
    return table(spark, d, "events").select(F.col("user_id").alias("session_key"), k.alias("idx"), node.alias("node_id"), F.concat(F.lit("call_"), k % 40, F.lit("_x")).alias("tool_call_id"), F.when(k % 4 > 0, F.concat(F.lit("c"), k % 3)).alias("canvas"), epoch_s("ts").alias("at"))


@q(f"""WITH {ENTRIES_SQL}, nw AS (SELECT max(said_at) AS now FROM en), e AS (SELECT en.*, now, CASE WHEN session_key % 3 > 0 THEN now - session_key * 40 END AS drawn FROM en, nw WHERE canvas IS NOT NULL AND (node_id IS NULL OR (node_id = 'wait' AND now - said_at >= 120))),
g AS (SELECT session_key, count(*) FILTER (node_id IS NULL) AS nulls, count(DISTINCT canvas || '/' || tool_call_id) AS entries, count(DISTINCT canvas) AS canvases, max(drawn) AS drawn, min(CASE WHEN node_id IS NULL THEN said_at END) AS oldest, count(*) FILTER (node_id = 'wait') AS waits, max(now) AS now FROM e GROUP BY 1)
SELECT session_key, nulls, entries, canvases, nulls >= 4 OR coalesce(now - drawn >= 300, false) OR (drawn IS NULL AND (waits > 0 OR coalesce(now - oldest >= 300, false))) AS fire FROM g""")
def canvas_triggers(spark: SparkSession, d: str) -> DataFrame:
    """A23."""
    e = entries(spark, d)
    now = e.agg(F.max("at")).first()[0] or 0
    return O.canvas_triggers(e.withColumn("last_drawn", F.when(F.col("session_key") % 3 > 0, now - F.col("session_key") * 40)), now)


@q(f"WITH {ENTRIES_SQL} SELECT DISTINCT unnest([tool_call_id, replace(tool_call_id, '_', '')]) AS tool_call_id FROM en WHERE idx % 3 = 0")
def confirmed_ids(spark: SparkSession, d: str) -> DataFrame:
    """O6, O5."""
    return O.known_ids(entries(spark, d).withColumn("offloaded", F.when(F.col("idx") % 3 == 0, "confirmed").when(F.col("idx") % 3 == 1, "deleted")), "confirmed")


@q(f"""WITH {ENTRIES_SQL}, m AS (SELECT 'call_' || i || '_x' AS tool_call_id, '009-N' || (i % 4) AS mapped FROM range(0, 40, 3) t(i)), j AS (SELECT en.*, mapped FROM en LEFT JOIN m USING (tool_call_id)), c AS (SELECT session_key, mapped AS common FROM (SELECT session_key, mapped, count(*) AS n FROM j WHERE mapped IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY session_key ORDER BY n DESC, mapped) = 1)
SELECT idx, coalesce(mapped, CASE WHEN node_id = 'wait' THEN coalesce(common, session_key || '-N1') END, node_id) AS node_id FROM j LEFT JOIN c USING (session_key)""")
def node_backfill(spark: SparkSession, d: str) -> DataFrame:
    """O7, A24."""
    m = spark.range(0, 40, 3).select(F.concat(F.lit("call_"), "id", F.lit("_x")).alias("tool_call_id"), F.concat(F.lit("009-N"), F.col("id") % 4).alias("node_id"))
    return O.backfill_nodes(entries(spark, d), m).select("idx", "node_id")


@q("""WITH b AS (SELECT conv_id AS session_key, turn AS idx, role, 'call' || (turn // 2) AS id, turn // 2 % 3 = 0 AS beat, turn % 4 = 0 AS talks FROM conversations)
SELECT session_key, idx, role, CAST(CASE WHEN role = 'user' THEN 1 + CASE WHEN beat THEN 0 ELSE 1 END WHEN talks THEN 1 + CASE WHEN beat THEN 0 ELSE 1 END ELSE 1 END AS INTEGER) AS n FROM b WHERE NOT (role <> 'user' AND NOT talks AND beat)""")
def heartbeat_filter(spark: SparkSession, d: str) -> DataFrame:
    """Calls of every third pair of turns are heartbeats; their results stand with the user's next text."""
    k = F.floor(F.col("turn") / 2)
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), F.concat(F.lit("call"), k).alias("tool_call_id"), text.alias("text"))
    said = F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("tool_call_id"), F.col("text").alias("text"))
    use, result = block("tool_use", F.when(k % 3 == 0, "HEARTBEAT check").otherwise("read")), block("tool_result", F.lit("fine"))
    blocks = F.when(F.col("role") == "user", F.array(said, result)).when(F.col("turn") % 4 == 0, F.array(said, use)).otherwise(F.array(use))
    c = table(spark, d, "conversations")
    # every pair has its call, whoever speaks
    calls = c.where("role = 'user'").select(F.col("conv_id").alias("session_key"), (F.col("turn") + 100_000).alias("idx"), F.lit("assistant").alias("role"), F.array(use).alias("blocks"))
    m = c.select(F.col("conv_id").alias("session_key"), F.col("turn").alias("idx"), "role", blocks.alias("blocks"))
    return O.without_heartbeats(m.unionByName(calls)).where("idx < 100000").select("session_key", "idx", "role", F.size("blocks").alias("n"))


@q("""WITH t AS (SELECT conv_id AS session_key, turn AS idx, role, text, sum(CASE WHEN role = 'user' AND length(text) > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS no FROM conversations), l AS (SELECT *, max(no) OVER (PARTITION BY session_key) AS last FROM t),
k AS (SELECT * FROM l WHERE no > 0 AND no > last - 5 AND ((role = 'user' AND length(text) > 5) OR (role = 'assistant' AND length(text) > 10))), a AS (SELECT *, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY session_key, no ORDER BY idx) AS p FROM k)
SELECT session_key, CAST(no AS BIGINT) AS turn, idx, role, substr(text, 1, 400) AS text FROM a WHERE role = 'user' OR p <= 3""")
def recent_turns(spark: SparkSession, d: str) -> DataFrame:
    """O10."""
    m = table(spark, d, "conversations").select(F.col("conv_id").alias("session_key"), F.col("turn").alias("idx"), "role", "text")
    return O.recent_turns(m).select("session_key", "turn", "idx", "role", "text")


@q("""WITH RECURSIVE m AS (SELECT conv_id AS s, turn AS i, CASE WHEN role <> 'user' AND turn % 4 = 3 THEN 'tool' ELSE role END AS role, CAST(ceil(length(text) / 4.0) AS BIGINT) AS t FROM conversations),
l AS (SELECT s, list(t ORDER BY i) AS t, list(role ORDER BY i) AS r, count(*) AS n, list(i ORDER BY i) AS i FROM m GROUP BY s),
g AS (SELECT s, CAST(0 AS BIGINT) AS gone FROM l UNION ALL
  SELECT s, gone + least(list_filter(range(least(greatest(1, CAST(ceil((n - gone) * least(0.5, (total - 60) / total)) AS BIGINT)), n - gone - 4), n - gone - 3), lambda j: j = n - gone - 4 OR r[gone + j + 1] <> 'tool')[1], last - gone) FROM
  (SELECT g.s, gone, l.n, l.r, list_sum(l.t[gone + 1:]) AS total, coalesce(list_max(list_filter(range(l.n), lambda j: l.r[j + 1] = 'user')), l.n) AS last FROM g JOIN l USING (s) WHERE l.n - gone > 4) WHERE total > 60 AND last > gone),
e AS (SELECT s, max(gone) AS gone FROM g GROUP BY s)
SELECT s AS session_key, unnest(i) AS idx, unnest(list_transform(range(n), lambda j: j < gone)) AS deleted FROM l JOIN e USING (s)""")
def emergency_delete(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth turn is a tool's result; users speak to the end, so the front is enough."""
    role = F.when((F.col("role") != "user") & (F.col("turn") % 4 == 3), "tool").otherwise(F.col("role"))
    m = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session_key"), F.col("turn").cast("long").alias("idx"), role.alias("role"), F.concat(F.lit("call"), F.floor(F.col("turn") / 4)).alias("tool_call_id"), F.ceil(F.char_length("text") / 4).cast("long").alias("tokens"))
    return O.emergency(m, 60).select(F.col("session_key").cast("long").alias("session_key"), "idx", "deleted")


@q("""WITH RECURSIVE c AS (SELECT o_custkey AS s, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || '-' || o_orderstatus AS name, CAST(o_totalprice / 1000 AS BIGINT) AS f, 20 AS m, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS p FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 3 > 0),
r AS (SELECT DISTINCT s, CAST(0 AS BIGINT) AS p, CAST(0 AS BIGINT) AS used, '' AS form, '' AS name, CAST(0 AS BIGINT) AS tokens FROM c UNION ALL SELECT r.s, c.p, used + CASE WHEN used + f <= 400 THEN f WHEN used + m <= 400 THEN m ELSE 0 END, CASE WHEN used + f <= 400 THEN 'full' WHEN used + m <= 400 THEN 'meta' ELSE '' END, c.name, CASE WHEN used + f <= 400 THEN f ELSE m END FROM r JOIN c ON c.s = r.s AND c.p = r.p + 1)
SELECT s AS session_key, name, form, tokens FROM r WHERE form <> ''""")
def history_canvases(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as canvases; those divisible by seven are active, a third of the nodes is still there."""
    o = table(spark, d, "orders")
    key = F.lpad(F.col("o_orderkey").cast("string"), 9, "0")
    c = o.select(F.col("o_custkey").alias("session_key"), F.concat(key, F.lit("-"), "o_orderstatus").alias("name"), (F.col("o_orderkey") % 7 == 0).alias("active"), F.rint(F.col("o_totalprice") / 1000).cast("long").alias("full_tokens"), F.lit(20).cast("long").alias("meta_tokens"))
    gone = o.where("o_orderkey % 3 > 0").select(F.col("o_custkey").alias("session_key"), F.concat(key, F.lit("-N4")).alias("node_id"))
    return O.history_canvases(c, gone, 2_000)


@q("""SELECT 'log' AS kind, 'l' || o_orderkey AS name FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' UNION ALL SELECT 'ref', 'l' || o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' AND o_orderkey % 2 = 0 UNION ALL SELECT 'registry', 'l' || o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' OR o_orderkey % 5 = 0
UNION ALL SELECT 'canvas', name FROM (SELECT 'l' || o_orderkey AS name, o_orderdate, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, 'l' || o_orderkey) AS r FROM orders) WHERE n > 15 AND r <= n - 15 AND o_orderdate < TIMESTAMP '1997-01-01'""")
def reclaim_plan(spark: SparkSession, d: str) -> DataFrame:
    """Ten days before the eleventh of January 1997."""
    o = table(spark, d, "orders")
    f = o.select(F.concat(F.lit("l"), "o_orderkey").alias("name"), epoch_s("o_orderdate").alias("changed"), (F.col("o_orderkey") % 2 == 1).alias("used"), F.col("o_custkey").alias("folder"), F.lit(False).alias("active"), (F.col("o_orderkey") % 5 > 0).alias("here"))
    return O.reclaim(f, f, f.select("folder", "name", "changed", "active"), f.select("name", F.col("changed").alias("updated"), "here"), 852_076_800 + 10 * 86_400, 10)


# Timers

TIMES_SQL = "tm AS (SELECT user_id, CAST(floor(epoch(max(ts))) AS BIGINT) AS last, count(*) AS n FROM events GROUP BY 1), nw AS (SELECT max(last) + 100000 AS now FROM tm)"


def times(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    t = table(spark, d, "events").groupBy("user_id").agg(F.max(epoch_s("ts")).alias("last"), F.count("*").alias("n"))
    return t, (t.agg(F.max("last")).first()[0] or 0) + 100_000


@q(f"WITH {TIMES_SQL}, w AS (SELECT *, CASE WHEN n % 3 > 0 THEN now - n * 10 END AS run, CASE WHEN n % 2 = 0 THEN now + n * 2 END AS sch FROM tm, nw), x AS (SELECT *, greatest(now + 90, coalesce(run + 900, 0)) AS want FROM w) SELECT user_id, CASE WHEN sch IS NULL OR want < sch THEN want ELSE sch END - now AS wait, coalesce(now - run >= 3600, false) AS due FROM x")
def second_layer_timers(spark: SparkSession, d: str) -> DataFrame:
    """X6."""
    t, now = times(spark, d)
    run, scheduled = F.when(F.col("n") % 3 > 0, now - F.col("n") * 10), F.when(F.col("n") % 2 == 0, now + F.col("n") * 2)
    return t.select("user_id", (X.next_run(F.lit(now), run, scheduled) - now).alias("wait"), X.run_due(F.lit(now), F.lit(None).cast("long"), run).alias("due"))


@q(f"WITH {TIMES_SQL} SELECT user_id, CASE WHEN now - last >= 259200 AND n % 5 > 0 THEN 'evict' WHEN now - last >= 86400 THEN 'stop' ELSE 'active' END AS fate FROM tm, nw")
def cold_sessions(spark: SparkSession, d: str) -> DataFrame:
    """X7."""
    t, now = times(spark, d)
    return t.select("user_id", X.session_fate(F.lit(now), F.col("last"), F.lit(False), F.when(F.col("n") % 5 == 0, 1).otherwise(0)).alias("fate"))


@q("SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'request' WHEN c_custkey % 4 > 0 AND c_custkey % 3 = 0 AND c_custkey % 5 > 0 THEN 'cold start' WHEN c_custkey % 3 > 0 AND c_custkey % 5 > 0 AND c_custkey % 2 = 0 THEN 'recovery' WHEN c_custkey % 4 = 1 AND c_custkey % 80 > 0 THEN 'first scene' WHEN c_custkey % 80 >= 50 THEN 'threshold' END AS reason FROM customer")
def persona_triggers(spark: SparkSession, d: str) -> DataFrame:
    """X13."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", X.persona_trigger(k % 11 == 0, k % 4, k % 3, k % 5 > 0, k % 2 == 1, k % 80).alias("reason"))


@q("SELECT question_type, count(*) AS n, round(avg(CASE WHEN ok THEN 1 ELSE 0 END), 6) AS accuracy FROM (SELECT lang AS question_type, doc_id % 3 = 0 AS ok FROM documents UNION ALL SELECT 'overall', doc_id % 3 = 0 FROM documents) GROUP BY 1")
def benchmark_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """A25."""
    from hippospark.operators.windows import accuracy

    return accuracy(table(spark, d, "documents").select(F.col("lang").alias("question_type"), (F.col("doc_id") % 3 == 0).alias("correct")))


@q("""WITH t AS (SELECT event_type AS stage, user_id, event_id, greatest(CAST(floor(value) AS BIGINT) - 80, 0) AS saved FROM events) SELECT user_id, event_id, stage, CAST(sum(saved) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS saved_so_far, count(*) OVER (PARTITION BY user_id, stage ORDER BY event_id) AS runs_so_far FROM t""")
def trigger_report_running(spark: SparkSession, d: str) -> DataFrame:
    """What each session has saved so far, and how often a stage ran."""
    from hippospark.operators.windows import trigger_totals

    return trigger_totals(table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("stage"), F.floor("value").cast("long").alias("tokens")), "user_id", "event_id", "stage", "tokens")


# What a session is opened with


@q(f"""WITH {HAPPENINGS_SQL}, {ENTITIES_SQL}, rt AS (SELECT e.id, coalesce(m.id, e.id) AS root FROM ent e LEFT JOIN ent m ON m.id = e.merged_into), n AS (SELECT * FROM hp ORDER BY ts_us DESC, id DESC LIMIT 200)
SELECT coalesce(root, '__general__') AS scene, count(*) AS heat, min(ts_us) AS created, max(ts_us) AS updated FROM n LEFT JOIN rt ON rt.id = entities[1] GROUP BY 1""")
def scene_projection(spark: SparkSession, d: str) -> DataFrame:
    """The two hundred newest events by their first known entity."""
    return P.scenes(happenings(spark, d), entities(spark, d))


@q(f"""WITH {HAPPENINGS_SQL}, {ENTITIES_SQL}, rt AS (SELECT e.id, coalesce(m.id, e.id) AS root FROM ent e LEFT JOIN ent m ON m.id = e.merged_into), n AS (SELECT * FROM hp ORDER BY ts_us DESC, id DESC LIMIT 200), s AS (SELECT coalesce(root, '__general__') AS scene, count(*) AS heat FROM n LEFT JOIN rt ON rt.id = entities[1] GROUP BY 1)
SELECT 'scene-' || CASE WHEN name IS NULL THEN 'general-activity' ELSE regexp_replace(regexp_replace(lower('person-' || name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') END || '.md' AS file, coalesce(name, 'General Activity') || ': ' || heat || ' event(s)' AS summary, row_number() OVER (ORDER BY heat DESC, scene) AS place FROM s LEFT JOIN ent ON ent.id = scene QUALIFY place <= 12""")
def scene_files(spark: SparkSession, d: str) -> DataFrame:
    """The twelve hottest scenes."""
    return P.scene_blocks(P.scenes(happenings(spark, d), entities(spark, d)), entities(spark, d)).select("file", "summary", "place")


PERSONA_SQL = f"""ph AS (SELECT entity_id, CASE attribute WHEN 'status' THEN 'rule_of_' || lower(value) ELSE 'role' END AS attribute, value, confidence FROM hd), pe AS (SELECT * FROM ent WHERE merged_into IS NULL AND substr(id, 2)::BIGINT % 3 = 0), pl AS (SELECT CASE WHEN attribute = 'role' THEN 'identity' ELSE 'process' END AS section, '- **' || name || '** — ' || replace(attribute, '_', ' ') || ': ' || value AS line, max(confidence) AS c FROM ph JOIN pe ON pe.id = entity_id GROUP BY 1, 2)"""


def persona(spark: SparkSession, d: str) -> DataFrame:
    h = heads(spark, d).withColumn("attribute", F.when(F.col("attribute") == "status", F.concat(F.lit("Rule of "), F.lower("value"))).otherwise("Role"))
    # names of attributes as they are shown
    h = h.withColumn("attribute", F.lower(F.regexp_replace("attribute", " ", "_")))
    e = entities(spark, d).where(F.substring("id", 2, 20).cast("long") % 3 == 0)
    return P.persona_lines(e, h)


@q(f"WITH {HEADS_SQL}, {ENTITIES_SQL}, {PERSONA_SQL} SELECT section, row_number() OVER (PARTITION BY section ORDER BY CASE WHEN section = 'process' THEN -c ELSE 0 END, line) AS place, line FROM pl")
def persona_projection(spark: SparkSession, d: str) -> DataFrame:
    """Rules by confidence, other lines by text."""
    return persona(spark, d)


@q(f"WITH {HEADS_SQL}, {ENTITIES_SQL}, {PERSONA_SQL}, o AS (SELECT section, row_number() OVER (PARTITION BY section ORDER BY CASE WHEN section = 'process' THEN -c ELSE 0 END, line) AS place, line FROM pl), b AS (SELECT section, string_agg(line, chr(10) ORDER BY place) AS body FROM o GROUP BY 1) SELECT string_agg('## ' || upper(section[1]) || section[2:] || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY section) AS text FROM b")
def persona_document(spark: SparkSession, d: str) -> DataFrame:
    """K35."""
    return P.persona_text(persona(spark, d))


# Windows over messages

MESSAGES_SQL = "ms AS (SELECT user_id AS s, event_id AS i, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


@q(f"WITH {MESSAGES_SQL} SELECT s AS user_id, i AS event_id, CAST(p // 10 AS BIGINT) AS \"window\", 'new' AS part FROM ms UNION ALL SELECT s, i, CAST(p // 10 + 1 AS BIGINT), 'background' FROM ms WHERE p % 10 >= 5 AND p // 10 < (n - 1) // 10")
def windows_with_background(spark: SparkSession, d: str) -> DataFrame:
    """W3."""
    return W.windows_with_background(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id")


@q(f"WITH {MESSAGES_SQL} SELECT s AS user_id, i AS event_id, CASE WHEN n - p <= 10 THEN 'new' ELSE 'background' END AS part FROM ms WHERE n - p <= 15")
def last_messages(spark: SparkSession, d: str) -> DataFrame:
    """W11."""
    return W.last_with_background(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id")


@q(f"""WITH {MESSAGES_SQL}, c AS (SELECT s, i, i % 9 AS score FROM ms WHERE p + 1 <= floor(n * 0.7) AND i % 5 > 0 AND i % 4 > 0 AND i % 7 * 10 <= 40), n2 AS (SELECT s, least(score, 7) AS step, count(*) AS n FROM c WHERE score >= 1 GROUP BY 1, 2), u AS (SELECT *, sum(n) OVER (PARTITION BY s ORDER BY step DESC) AS upto FROM n2), t AS (SELECT s, coalesce(max(CASE WHEN upto >= 10 THEN step END), 1) AS threshold FROM u GROUP BY 1)
SELECT s AS user_id, i AS event_id, threshold FROM c JOIN t USING (s) WHERE score >= threshold""")
def score_cascade_replacements(spark: SparkSession, d: str) -> DataFrame:
    """The first seventy of a hundred messages, without replaced ones and without longer summaries."""
    k = F.col("event_id")
    m = table(spark, d, "events").select("user_id", "event_id", F.when(k % 4 > 0, F.concat(F.lit("t"), k)).alias("tool_call_id"), (k % 5 == 0).alias("replaced"), F.lit(40).alias("length"))
    e = table(spark, d, "events").select(F.concat(F.lit("t"), k).alias("tool_call_id"), (k % 9).alias("score"), (k % 7 * 10).alias("summary_length"))
    c = W.cascade_candidates(m, e, "user_id", "event_id")
    return W.replaced_by_cascade(c, "user_id").select("user_id", "event_id", "threshold")


@q("""WITH RECURSIVE m AS (SELECT conv_id AS s, turn AS i, CASE WHEN turn % 4 = 3 THEN 'tool' ELSE role END AS role, CAST(ceil(length(text) / 4.0) AS BIGINT) AS t FROM conversations),
l AS (SELECT s, list(t ORDER BY i) AS t, list(role ORDER BY i) AS r, count(*) AS n, list(i ORDER BY i) AS i FROM m GROUP BY s),
g AS (SELECT s, CAST(0 AS BIGINT) AS gone FROM l UNION ALL SELECT s, gone + cut FROM
  (SELECT s, gone, least(list_filter(range(first, n - gone + 1), lambda j: j = n - gone OR r[gone + j + 1] <> 'tool')[1], last - gone) AS cut FROM
    (SELECT *, coalesce(list_filter(range(1, n - gone - 1), lambda j: list_sum(t[gone + 1:gone + j]) >= total * CAST(0.4 AS DOUBLE))[1], n - gone - 2) AS first FROM
      (SELECT g.s, gone, l.n, l.r, l.t, list_sum(l.t[gone + 1:]) AS total, coalesce(list_max(list_filter(range(l.n), lambda j: l.r[j + 1] = 'user')), l.n) AS last FROM g JOIN l USING (s) WHERE l.n - gone > 2) WHERE total >= 40)) WHERE cut > 0),
e AS (SELECT s, max(gone) AS gone FROM g GROUP BY s)
SELECT CAST(s AS VARCHAR) AS session_key, unnest(i) AS idx, unnest(list_transform(range(n), lambda j: j < gone)) AS deleted FROM l JOIN e USING (s)""")
def aggressive_delete(spark: SparkSession, d: str) -> DataFrame:
    """O3: round after round; every fourth turn is a tool's result."""
    k = F.col("turn")
    m = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session_key"), k.cast("long").alias("idx"), F.when(k % 4 == 3, "tool").otherwise(F.col("role")).alias("role"), F.lit(None).cast("string").alias("tool_call_id"), F.ceil(F.char_length("text") / 4).cast("long").alias("tokens"))
    return O.aggressive(m, 40)


@q("SELECT conv_id AS session_no, turn AS idx, 1704067200000 + 100 * (row_number() OVER (ORDER BY conv_id, turn) - 1) AS ts_ms FROM conversations")
def seed_times(spark: SparkSession, d: str) -> DataFrame:
    """No message of the seed has a time."""
    m = table(spark, d, "conversations").select(F.col("conv_id").alias("session_no"), F.lit(0).alias("round"), F.col("turn").alias("idx"), F.lit(None).cast("long").alias("ts_ms"))
    return readers.timed(m, 1_704_067_200_000).select("session_no", "idx", "ts_ms")


@q("SELECT conv_id, turn, 1704067200000 + 1000 * (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS ts_ms FROM conversations")
def synthetic_timestamps(spark: SparkSession, d: str) -> DataFrame:
    """W15."""
    return W.stepped(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn", 1_704_067_200_000)
