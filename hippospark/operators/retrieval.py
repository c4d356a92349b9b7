"""Candidate generation, fusion and gating of recalls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hippospark.functions import scalar as S
from hippospark.functions.storage import saved

K1, B = 1.2, 0.75


def postings(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per text and word: id, term, tf, and dl, the text's number of words. Texts without words have none."""
    tokens = rows.select(F.col(id_col).alias("id"), S.token_list(F.col(text_col)).alias("tokens"))
    words = tokens.select("id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    return words.groupBy("id", "dl", "term").agg(F.count("*").alias("tf")).select("id", "term", "tf", "dl")


class KeywordIndex:
    """Postings in the order of their terms, so that a query reads the pages of its terms alone, and the corpus's two numbers."""

    def __init__(self, table: DataFrame, n: int, words: int):
        self.table, self.n, self.words = table, n, words

    @classmethod
    def build(cls, rows: DataFrame, id_col: str, text_col: str) -> "KeywordIndex":
        n = rows.count()
        p = postings(rows, id_col, text_col)
        # a word of all texts spreads over partitions by its texts
        table = saved(p.repartitionByRange("term", "id").sortWithinPartitions("term", "id"), "postings")
        words = table.agg(F.sum("tf")).first()[0] or 0
        return cls(table, n, words)

    def search(self, terms: Sequence[str], k: int = 10) -> DataFrame:
        """id, bm25: the k best texts for an OR of terms."""
        hit = self.table.where(F.col("term").isin([t.lower() for t in dict.fromkeys(terms)]))
        # as many rows as terms
        df = hit.groupBy("term").agg(F.count("*").alias("df"))
        idf = F.ln((self.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        idf = F.when(idf > 0, idf).otherwise(1e-6)
        mean = self.words / max(1, self.n)
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / mean))
        scored = hit.join(F.broadcast(df), "term").groupBy("id").agg(F.round(F.sum(part), 6).alias("bm25"))
        return scored.orderBy(F.desc("bm25"), "id").limit(k)


def bm25(docs: DataFrame, terms: Sequence[str], id_col: str, text_col: str, k: int = 10) -> DataFrame:
    """T4 without an index that stays: one is built for the call."""
    return KeywordIndex.build(docs, id_col, text_col).search(terms, k).withColumnRenamed("id", id_col)


def keyword_search(hits: DataFrame, k: int, threshold: float) -> DataFrame:
    """Of twice as many hits (id, bm25) those with a score over the threshold; where none is and they are few, all of them."""
    scored = hits.limit(2 * k).withColumn("score", F.round(S.bm25_rank_score(-F.col("bm25")), 6))
    every = Window.partitionBy()  # 2 k rows
    fits = F.col("score") >= threshold
    kept = scored.withColumn("_any", F.max(fits).over(every)).withColumn("_n", F.count("*").over(every)).where(fits | (~F.col("_any") & (F.col("_n") <= k)))
    return kept.drop("_any", "_n").orderBy(F.desc("score"), "id").limit(k)


def vector_topk(vectors: DataFrame, query: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", least: float | None = None, where: Column | None = None) -> DataFrame:
    """Exact top k by cosine to one query vector (a single row with column q), among the rows of a kind where one is
    asked for. A vector of norm 0 never ranks."""
    v = (vectors if where is None else vectors.where(where)).select(id_col, S.doubles(vec_col).alias("v")).crossJoin(F.broadcast(query.limit(1)))
    v = v.where(S.norm(F.col("v")) > 0).select(id_col, F.round(S.cosine(F.col("v"), F.col("q")), 6).alias("score"))
    return (v if least is None else v.where(F.col("score") >= least)).orderBy(F.desc("score"), id_col).limit(k)


def ranked(hits: DataFrame, list_no: int, id_col: str, score_col: str) -> DataFrame:
    """Places from 0 in a short candidate list."""
    place = F.row_number().over(Window.orderBy(F.desc(score_col), id_col)) - 1
    return hits.select(F.col(id_col).cast("long").alias("id"), F.lit(list_no).alias("list_no"), place.alias("rank"))


def rrf_merge(lists: Sequence[DataFrame], k: int = 10) -> DataFrame:
    """A4, A5: reciprocal rank fusion of ranked lists (id, list_no, rank)."""
    every = lists[0]
    for x in lists[1:]:
        every = every.unionByName(x)
    fused = every.groupBy("id").agg(F.round(F.sum(S.rrf(F.col("rank"))), 6).alias("score"), F.count("*").alias("n_lists"), F.min("list_no").alias("first_list"))
    return fused.orderBy(F.desc("score"), "id").limit(k)


def fused(words: DataFrame, vectors: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """A5: ranked lists (id, rank; vectors with cosine) as id, rrf, the best cosine, and whether keyword or entity lists held it."""
    one = words.select("id", "rank", F.lit(None).cast("double").alias("cosine"), F.lit(0).alias("source"))
    every = one.unionByName(vectors.select("id", "rank", "cosine", F.lit(1).alias("source")))
    if entities is not None:
        every = every.unionByName(entities.select("id", "rank", F.lit(None).cast("double").alias("cosine"), F.lit(2).alias("source")))
    return every.groupBy("id").agg(F.sum(S.rrf(F.col("rank"))).alias("rrf"), F.max("cosine").alias("cosine"), F.bool_or(F.col("source") == 0).alias("from_words"), F.bool_or(F.col("source") == 2).alias("from_entity"))


def hybrid(words: DataFrame, vectors: DataFrame, ages: DataFrame, k: int, threshold: float = 0.3) -> DataFrame:
    """Both lists fused; a text needs a keyword hit or a cosine of the threshold; the newer weigh more. ages: id, age_days."""
    f = fused(words, vectors).where(F.col("from_words") | (F.col("cosine") >= threshold)).join(ages, "id", "left")
    return f.withColumn("score", F.round(S.recency_boosted(F.col("rrf"), F.col("age_days")), 6)).orderBy(F.desc("score"), "id").limit(k).select("id", "score", "cosine", "from_words")


def search_tool(words: DataFrame, vectors: DataFrame, rows: DataFrame, k: int, kind: str | None = None, scene: str | None = None, session_key: str | None = None) -> DataFrame:
    """The lists fused where both have hits, else the one that has; then filters by type, by part of a scene's name, by
    session; k of what is left. rows: id and the columns filtered by. Lists are candidates: three times k, or four with a session."""
    f = fused(words, vectors)
    both = words.limit(1).agg(F.count("*").alias("w")).crossJoin(vectors.limit(1).agg(F.count("*").alias("v")))
    own = vectors.select("id", F.col("cosine").alias("own")).unionByName(words.select("id", F.col("score").alias("own"))).groupBy("id").agg(F.max("own").alias("own"))
    f = f.join(own, "id").crossJoin(F.broadcast(both)).withColumn("score", F.round(F.when((F.col("w") > 0) & (F.col("v") > 0), F.col("rrf")).otherwise(F.col("own")), 6)).join(rows, "id")
    f = f if kind is None else f.where(F.col("type") == kind)
    f = f if scene is None else f.where(F.contains(F.lower("scene_name"), F.lit(scene.lower())))
    f = f if session_key is None else f.where(F.col("session_key") == session_key)
    return f.orderBy(F.desc("score"), "id").limit(k).select("id", "score")


def kb_recall(words: DataFrame, vectors: DataFrame, entities: DataFrame, rows: DataFrame, k: int, now_days: float, neighbours: DataFrame | None = None) -> DataFrame:
    """Candidates of three sources (three times k each) fused by owner, rendered, weighed by recency and importance, primed, cut, calibrated.

    rows: what may be recalled, head facts and events only: id, kind, text, entity_id, day, and importance (0.5 for events).
    neighbours: src, dst, weight among entities; what flows into a fact's entity from others raises it (G6).
    """
    f = fused(words, vectors, entities).join(rows, "id")
    ranking = S.recency_boosted(F.col("rrf"), F.lit(now_days) - F.col("day")) * (1 + 0.15 * F.col("importance"))
    f = f.withColumn("ranking", ranking)
    if neighbours is not None:
        from hippospark.operators.graph import primed

        best = f.where("entity_id is not null").groupBy(F.col("entity_id").alias("id")).agg(F.max("ranking").alias("ranking"))
        boosts = primed(best, neighbours).select(F.col("id").alias("entity_id"), "boost")
        f = f.join(boosts, "entity_id", "left").withColumn("ranking", F.col("ranking") + F.coalesce("boost", F.lit(0.0)))
    f = f.withColumn("ranking", F.round("ranking", 8)).orderBy(F.desc("ranking"), "id").limit(k)
    return f.select("id", "kind", "text", F.round(S.clamp(S.calibrated(F.col("cosine"), F.col("rrf"))), 6).alias("score"), "ranking")


def with_penalty(hits: DataFrame, current: str, score: str = "score", penalty: float = 0.5) -> DataFrame:
    """Hits of another project count half; without a project, or outside any, they count whole."""
    other = (F.coalesce("project", F.lit("")) != "") & (F.col("project") != current)
    return hits.withColumn(score, F.when(other, F.col(score) * penalty).otherwise(F.col(score)))


def recall_confidence(hits: DataFrame, score_col: str, strong: float = 0.4, few: int = 3) -> DataFrame:
    """A20."""
    return hits.agg(F.count("*").alias("total"), F.count_if(F.col(score_col) >= strong).alias("strong")).withColumn("thin", (F.col("total") < few) | (F.col("strong") == 0))


def entity_matches(entities: DataFrame, terms: Sequence[str], id_col: str, name_col: str, k: int = 10, also: Sequence[str] = ()) -> DataFrame:
    """Entities whose name, or another of their texts (key, aliases), holds most query tokens."""
    text = F.lower(F.concat_ws("\n", name_col, *also))
    hits = sum((text.contains(t.lower()).cast("int") for t in terms), F.lit(0))
    return entities.select(id_col, name_col, hits.cast("long").alias("hits")).where("hits > 0").orderBy(F.desc("hits"), id_col).limit(k)


def best_chunk(hits: DataFrame, owner: str, score: str, chunk: str) -> DataFrame:
    """The best chunk of each owner."""
    return hits.groupBy(owner).agg(F.max(F.col(score)).alias(score), F.max_by(chunk, F.struct(F.col(score), -F.col(chunk))).alias(chunk))


def topk_per_query(pairs: DataFrame, query: str, score: str, id_col: str, k: int) -> DataFrame:
    """T22."""
    w = Window.partitionBy(query).orderBy(F.desc(score), id_col)
    return pairs.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def merged_candidates(lists: Sequence[DataFrame], key: str) -> DataFrame:
    """The rows of candidate lists one after the other, each key from the first list that has it."""
    every = None
    for i, x in enumerate(lists):
        x = x.withColumn("_list", F.lit(i))
        every = x if every is None else every.unionByName(x)
    rest = [c for c in lists[0].columns if c != key]
    return every.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("_list", *rest)).alias("_row")).select(key, "_row.*")


def cornerstones(memories: DataFrame, now: int, most: int = 3, half_life: float = 48.0) -> DataFrame:
    """The most distinctive memories that were not injected of late: id, distinctiveness, injected_at (seconds, null for never)."""
    age = (F.lit(now) - F.col("injected_at")) / 3600
    fresh = F.when(F.col("injected_at").isNull(), F.lit(1.0)).otherwise(1 - S.injection_decay(age, half_life))
    return memories.withColumn("score", F.round(F.col("distinctiveness") * fresh, 4)).orderBy(F.desc("score"), "id").limit(most)
