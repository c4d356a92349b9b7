"""Queries of retrieval: keyword, vector and entity candidates, fusion, boosts, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hippospark.functions import scalar as S
from hippospark.operators import retrieval as R
from hippospark.operators import vectors as V
from hippospark.operators.keyword_index import SegmentIndex

from .bindings import epoch_s, l0_messages, table
from .common import Queries
from .kept import kept_index, kept_vectors

q = Queries()
QUERIES, ORACLES = q.queries, q.oracles
TERMS = ("that", "the", "idiot", "und")
NOW = 1_735_689_600

BM25_SQL = """tk AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t FROM documents),
c AS (SELECT doc_id, len(t) AS dl, len(list_filter(t, lambda x: x = 'that')) AS a, len(list_filter(t, lambda x: x = 'the')) AS b, len(list_filter(t, lambda x: x = 'idiot')) AS c, len(list_filter(t, lambda x: x = 'und')) AS d FROM tk),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db, count(*) FILTER (c > 0) AS dc, count(*) FILTER (d > 0) AS dd FROM c),
i AS (SELECT *, greatest(ln((n - da + 0.5) / (da + 0.5)), 1e-6) AS ia, greatest(ln((n - db + 0.5) / (db + 0.5)), 1e-6) AS ib, greatest(ln((n - dc + 0.5) / (dc + 0.5)), 1e-6) AS ic, greatest(ln((n - dd + 0.5) / (dd + 0.5)), 1e-6) AS id FROM s),
bm AS (SELECT doc_id, round(ia * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / avgdl)) + ib * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / avgdl)) + ic * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * dl / avgdl)) + id * d * 2.2 / (d + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS bm25
  FROM c, i WHERE a > 0 OR b > 0 OR c > 0 OR d > 0 ORDER BY bm25 DESC, doc_id LIMIT {k})"""
COS_SQL = """qv AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0),
cs AS (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM embeddings, qv ORDER BY score DESC, vec_id LIMIT {k})"""


def query_vector(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id = 0").select(S.doubles("embedding").alias("q"))


def document_index(spark: SparkSession, d: str) -> SegmentIndex:
    return kept_index(spark, d, "documents", ["documents"], lambda: table(spark, d, "documents"), "doc_id", "text", "long")


def keyword_hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    return document_index(spark, d).search(TERMS, k).withColumnRenamed("id", "doc_id")


@q("WITH " + BM25_SQL.replace("{k}", "10") + " SELECT doc_id, bm25 FROM bm")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return keyword_hits(spark, d, 10)


@q("WITH " + BM25_SQL.replace("{k}", "10") + " SELECT doc_id, round(bm25 / (1 + bm25), 6) AS score FROM bm")
def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    return keyword_hits(spark, d, 10).select("doc_id", F.round(S.bm25_rank_score(-F.col("bm25")), 6).alias("score"))


@q("WITH " + COS_SQL.replace("{k}", "10") + " SELECT vec_id, score FROM cs")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.vector_topk(table(spark, d, "embeddings"), query_vector(spark, d), 10)


@q("WITH " + COS_SQL.replace("{k}", "1000000") + " SELECT vec_id, score FROM cs WHERE score >= 0.3 ORDER BY score DESC, vec_id LIMIT 10")
def embedding_search(spark: SparkSession, d: str) -> DataFrame:
    """At least a cosine of 0.3."""
    return R.vector_topk(table(spark, d, "embeddings"), query_vector(spark, d), 10, least=0.3)


@q()
def vector_index_search(spark: SparkSession, d: str) -> DataFrame:
    """T5: the ten nearest of every hundredth vector, by the kept index; tests measure its recall against all rows."""
    e = table(spark, d, "embeddings")
    index = kept_vectors(spark, d, "vector-index", ["embeddings"], lambda: e, "vec_id", "embedding", "long")
    return index.search_many(e.where("vec_id % 100 = 0"), 10, None, "vec_id", "embedding")


FUSED_SQL = """r AS (SELECT doc_id AS id, 0 AS list_no, row_number() OVER (ORDER BY bm25 DESC, doc_id) - 1 AS rank FROM bm UNION ALL SELECT vec_id, 1, row_number() OVER (ORDER BY score DESC, vec_id) - 1 FROM cs),
fu AS (SELECT id, round(sum(1.0 / (61 + rank)), 6) AS score, count(*) AS n_lists, min(list_no) AS first_list FROM r GROUP BY id ORDER BY score DESC, id LIMIT {k})"""


def fused(spark: SparkSession, d: str, k: int) -> DataFrame:
    words = R.ranked(keyword_hits(spark, d, 30), 0, "doc_id", "bm25")
    vectors = R.ranked(R.vector_topk(table(spark, d, "embeddings"), query_vector(spark, d), 30), 1, "vec_id", "score")
    return R.rrf_merge([words, vectors], k)


@q("WITH " + BM25_SQL.replace("{k}", "30") + ", " + COS_SQL.replace("{k}", "30") + ", " + FUSED_SQL.replace("{k}", "5") + " SELECT id, score, n_lists FROM fu")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Keyword and vector lists fused by reciprocal rank."""
    return fused(spark, d, 5).select("id", "score", "n_lists")


@q("WITH " + BM25_SQL.replace("{k}", "30") + ", " + COS_SQL.replace("{k}", "30") + ", " + FUSED_SQL.replace("{k}", "60") + " SELECT id, score, n_lists, first_list FROM fu")
def rrf_merge(spark: SparkSession, d: str) -> DataFrame:
    return fused(spark, d, 60)


@q("WITH " + BM25_SQL.replace("{k}", "30") + ", " + COS_SQL.replace("{k}", "30") + ", " + FUSED_SQL.replace("{k}", "60") + " SELECT id, round(coalesce(cs.score, fu.score * 61 / (1 + fu.score * 61)), 5) AS calibrated FROM fu LEFT JOIN cs ON id = vec_id")
def calibrated_scores(spark: SparkSession, d: str) -> DataFrame:
    """T12, M6."""
    c = R.vector_topk(table(spark, d, "embeddings"), query_vector(spark, d), 30).withColumnRenamed("score", "cosine")
    f = fused(spark, d, 60).join(F.broadcast(c), F.col("id") == F.col("vec_id"), "left")
    return f.select("id", F.round(S.calibrated(F.col("cosine"), F.col("score")), 5).alias("calibrated"))


@q("WITH " + COS_SQL.replace("{k}", "50") + " SELECT count(*) AS total, count(*) FILTER (score >= 0.4) AS strong, (count(*) < 3 OR count(*) FILTER (score >= 0.4) = 0) AS thin FROM cs")
def recall_confidence(spark: SparkSession, d: str) -> DataFrame:
    return R.recall_confidence(R.vector_topk(table(spark, d, "embeddings"), query_vector(spark, d), 50), "score")


@q("""WITH qs AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM qs, embeddings WHERE vec_id <> query_id)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5""")
def cosine_topk_per_query(spark: SparkSession, d: str) -> DataFrame:
    """The vectors whose id is divisible by 100 against all, in blocks."""
    e = table(spark, d, "embeddings")
    pairs = V.topk(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 5).withColumnRenamed("id", "vec_id")
    return R.topk_per_query(pairs, "query_id", "score", "vec_id", 5)


@q("""WITH qs AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 100 < 2),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM qs, embeddings WHERE vec_id % 100 >= 2)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5""")
def dedup_candidates(spark: SparkSession, d: str) -> DataFrame:
    """A batch of records, two in a hundred, against all that were there before."""
    e = table(spark, d, "embeddings")
    pairs = V.dedup_candidates(e.where("vec_id % 100 < 2"), e, "vec_id", "embedding", 5).withColumnRenamed("id", "vec_id")
    return R.topk_per_query(pairs, "query_id", "score", "vec_id", 5)


@q("WITH " + COS_SQL.replace("{k}", "1000000") + """, b AS (SELECT vec_id // 4 AS owner, vec_id % 4 AS chunk, score FROM cs), r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY score DESC, chunk) AS p FROM b)
SELECT owner, score, chunk FROM r WHERE p = 1 ORDER BY score DESC, owner LIMIT 20""")
def best_chunk_per_owner(spark: SparkSession, d: str) -> DataFrame:
    """Four vectors are chunks of one owner."""
    e = table(spark, d, "embeddings").select("vec_id", S.doubles("embedding").alias("v")).crossJoin(F.broadcast(query_vector(spark, d)))
    hits = e.select(F.floor(F.col("vec_id") / 4).cast("long").alias("owner"), (F.col("vec_id") % 4).alias("chunk"), F.round(S.cosine(F.col("v"), F.col("q")), 6).alias("score"))
    return R.best_chunk(hits, "owner", "score", "chunk").orderBy(F.desc("score"), "owner").limit(20)


@q(f"SELECT o_orderkey, round(o_totalprice / 1e6 * (1 + 0.15 * pow(0.5, ({NOW} - epoch(o_orderdate)) / 86400.0 / 30)), 6) AS boosted FROM orders")
def recency_boost(spark: SparkSession, d: str) -> DataFrame:
    """M3."""
    age = (F.lit(NOW) - epoch_s("o_orderdate")) / 86400.0
    return table(spark, d, "orders").select("o_orderkey", F.round(S.recency_boosted(F.col("o_totalprice") / 1e6, age), 6).alias("boosted"))


@q("SELECT c_custkey, c_name, CAST(contains(lower(c_name), 'customer') AS BIGINT) + CAST(contains(lower(c_name), '7') AS BIGINT) + CAST(contains(lower(c_name), '42') AS BIGINT) AS hits FROM customer WHERE hits > 0 ORDER BY hits DESC, c_custkey LIMIT 10")
def entity_token_match(spark: SparkSession, d: str) -> DataFrame:
    return R.entity_matches(table(spark, d, "customer"), ("customer", "7", "42"), "c_custkey", "c_name", 10)


@q("SELECT c_custkey, round((greatest(0, least(1, c_acctbal / 10000)) + 0.8 + CASE WHEN n > 0 THEN 1 - 1.0 / n ELSE 0 END) / 3, 6) AS importance FROM (SELECT c_custkey, c_acctbal, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)")
def fact_importance(spark: SparkSession, d: str) -> DataFrame:
    """M7: account balance as an entity's importance, orders as a fact's support."""
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    c = table(spark, d, "customer").join(n, "c_custkey", "left")
    return c.select("c_custkey", F.round(S.fact_importance(F.col("c_acctbal") / 100, F.lit(0.8), F.coalesce("n", F.lit(0))), 6).alias("importance"))


@q("""WITH e AS (SELECT conv_id, turn, text, CASE WHEN conv_id % 3 = 0 THEN 'a' ELSE 'b' END AS project FROM conversations)
SELECT conv_id, turn, round(CASE WHEN project = 'a' THEN 1.0 ELSE 0.5 END * length(text) / 1000, 6) AS score FROM e ORDER BY score DESC, conv_id, turn LIMIT 20""")
def project_penalty(spark: SparkSession, d: str) -> DataFrame:
    """Events of another project count half."""
    m = l0_messages(spark, d).join(l0_messages(spark, d).select("conv_id").distinct().withColumn("project", F.when(F.col("conv_id") % 3 == 0, "a").otherwise("b")), "conv_id", "left")
    score = F.when(F.col("project") == "a", 1.0).otherwise(0.5) * F.char_length("message_text") / 1000
    return m.select("conv_id", "turn", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "conv_id", "turn").limit(20)


@q("SELECT d.doc_id, d.source FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def rejected_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """J16, U4."""
    bad = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return table(spark, d, "documents").join(bad, "doc_id", "left_anti").select("doc_id", "source")


ISOLATION = "SELECT vec_id, round(1 - coalesce((SELECT max(greatest(0, list_cosine_similarity(CAST(b.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])))) FROM embeddings b WHERE b.vec_id <> a.vec_id), 0), 6) AS isolation FROM embeddings a"


@q(ISOLATION)
def isolation(spark: SparkSession, d: str) -> DataFrame:
    """M12 of every vector among all; 1 where there is nothing to compare."""
    e = table(spark, d, "embeddings")
    near = V.nearest(e, "vec_id", "embedding").withColumnRenamed("id", "vec_id")
    return e.select("vec_id").join(near, "vec_id", "left").select("vec_id", F.round(1 - F.coalesce("near", F.lit(0.0)), 6).alias("isolation"))


@q("SELECT doc_id, list_no FROM (SELECT doc_id, 1 AS list_no FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id, 2 FROM documents WHERE source = 'src1') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY list_no) = 1")
def candidate_union(spark: SparkSession, d: str) -> DataFrame:
    """Each candidate from the first list that has it."""
    t = table(spark, d, "documents")
    lists = [t.where("lang = 'de'").select("doc_id", F.lit(1).alias("list_no")), t.where("source = 'src1'").select("doc_id", F.lit(2).alias("list_no"))]
    return R.merged_candidates(lists, "doc_id")
