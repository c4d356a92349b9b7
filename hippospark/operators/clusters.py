"""Similarity clusters and what is read off them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hippospark.functions import parsing as P
from hippospark.functions import scalar as S
from hippospark.functions.storage import forget, saved
from hippospark.operators import vectors
from hippospark.operators.components import connected_components


def blocked_pairs(rows: DataFrame, id_col: str, tokens: str, most: int | None = None) -> DataFrame:
    """Pairs that share a token, once each. `most` drops glue tokens, those of more rows, which the operator defines."""
    t = rows.select(id_col, F.explode(F.array_distinct(tokens)).alias("token"))
    if most is not None:
        few = t.groupBy("token").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n") <= most)).select("token")
        t = t.join(few, "token")
    a, b = t.select(F.col(id_col).alias("a"), "token"), t.select(F.col(id_col).alias("b"), "token")
    return a.join(b, "token").where("a < b").select("a", "b").distinct()


def similar_pairs(rows: DataFrame, id_col: str, vec: str, block: str, least: float) -> DataFrame:
    """Pairs within a block whose cosine is at least `least`."""
    v = rows.select(id_col, block, S.doubles(vec).alias("v")).withColumn("n", S.norm(F.col("v"))).where("n > 0")
    a, b = v.select(F.col(id_col).alias("a"), block, F.col("v").alias("va"), F.col("n").alias("na")), v.select(F.col(id_col).alias("b"), block, F.col("v").alias("vb"), F.col("n").alias("nb"))
    score = F.round(S.clamp(S.dot(F.col("va"), F.col("vb")) / (F.col("na") * F.col("nb")), -1.0, 1.0), 6)
    return a.join(b, block).where("a < b").select("a", "b", score.alias("score")).where(F.col("score") >= least)


def pair_weight(cosine: Column, jaccard: Column, linked: Column) -> Column:
    """The bug-cluster weight."""
    return 0.6 * cosine + 0.3 * jaccard + 0.1 * linked


def weighted_pairs(rows: DataFrame, id_col: str, vec: str, context: str, links: DataFrame, least: float = 0.55) -> DataFrame:
    """J10 over all rows: a < b, weight >= least. links: src, dst of linked context ids, either way. As Jaccard and link add 0.4 at most, pairs below the cosine that this leaves are out (least above 0.4)."""
    c = rows.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(context), F.array().cast("array<string>")).alias("c"))
    near = vectors.all_pairs(rows, id_col, vec, (least - 0.4) / 0.6 - 1e-6)
    both = near.join(c.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(c.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b")
    hits = both.select("a", "b", F.explode("ca").alias("src"), "cb").select("a", "b", "src", F.explode("cb").alias("dst")).join(links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), ["src", "dst"])
    both = both.join(hits.select("a", "b", F.lit(1.0).alias("linked")).distinct(), ["a", "b"], "left")
    w = pair_weight(F.col("score"), S.jaccard(F.col("ca"), F.col("cb")), F.coalesce("linked", F.lit(0.0)))
    return both.select("a", "b", F.round(w, 6).alias("weight")).where(F.col("weight") >= least)


def usage_pairs(rows: DataFrame, id_col: str, vec: str, context: str, least: float = 0.72, newest: int = 300) -> DataFrame:
    """Pairs among the newest rows by id, a < b, weight = 0.85 cosine + 0.15 Jaccard >= least. As Jaccard adds 0.15 at most,
    pairs below the cosine that this leaves are out."""
    rows = saved(rows.orderBy(F.desc(id_col)).limit(newest), "usages")
    c = rows.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(context), F.array().cast("array<string>")).alias("c"))
    near = vectors.all_pairs(rows, id_col, vec, (least - 0.15) / 0.85 - 1e-6)
    both = near.join(c.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(c.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b")
    return both.select("a", "b", F.round(0.85 * F.col("score") + 0.15 * S.jaccard(F.col("ca"), F.col("cb")), 6).alias("weight")).where(F.col("weight") >= least)


def band(score: Column) -> Column:
    """What becomes of a pair of entities."""
    return F.when(score >= 0.95, "auto").when(score >= 0.85, "ask").otherwise("skip")


def reconciliation_pairs(entities: DataFrame, id_col: str, kind: str, name: str, vec: str, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """Pairs of one type that share a name token, with score max(cosine, likeness of names) and band; and the glue tokens, those
    of more than `most` entities of a type, that were left out."""
    t = entities.select(id_col, kind, F.explode(P.name_tokens(F.col(name))).alias("token"))
    sizes = t.groupBy(kind, "token").agg(F.count("*").alias("n"))
    few = t.join(sizes.where((F.col("n") > 1) & (F.col("n") <= most)), [kind, "token"])
    ids = few.select(F.col(id_col).alias("a"), kind, "token").join(few.select(F.col(id_col).alias("b"), kind, "token"), [kind, "token"]).where("a < b").select("a", "b").distinct()
    side = lambda x: entities.select(F.col(id_col).alias(x), F.col(name).alias(f"n{x}"), S.doubles(vec).alias(f"v{x}"))
    both = ids.join(side("a"), "a").join(side("b"), "b")
    score = F.greatest(F.coalesce(S.cosine(F.col("va"), F.col("vb")), F.lit(0.0)), P.name_similarity(F.col("na"), F.col("nb")))
    scored = both.select("a", "b", F.round(score, 6).alias("score")).withColumn("band", band(F.col("score")))
    return scored.where("band <> 'skip'"), sizes.where(F.col("n") > most)


def reconciliation_clusters(pairs: DataFrame) -> DataFrame:
    """Components of the pairs with their members, range of scores, and the weaker band of any of their pairs."""
    nodes = connected_components(pairs, "a", "b")
    ranges = pairs.join(nodes, F.col("a") == F.col("node")).groupBy("component").agg(F.min("score").alias("least"), F.max("score").alias("most"), F.when(F.bool_or(F.col("band") == "ask"), "ask").otherwise("auto").alias("band"))
    return nodes.groupBy("component").agg(F.array_sort(F.collect_set("node")).alias("ids")).join(ranges, "component")


def mean_vectors(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """The normalised mean of each key's vectors, component by component, so that a hot key is summed where its rows are."""
    e = rows.select(key, F.posexplode(S.doubles(vec)).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    g = e.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return g.select(key, S.l2_normalized(F.transform("v", lambda c: c["x"])).alias("vector"))


def plan_errors(plans: DataFrame, members: DataFrame) -> DataFrame:
    """Plans (plan, ids) whose ids are not all members (node, component) of one cluster."""
    e = plans.select("plan", F.explode("ids").alias("node"), F.size("ids").alias("size")).join(members, "node", "left")
    best = e.groupBy("plan", "component").agg(F.count_if(F.col("component").isNotNull()).alias("n"), F.first("size").alias("size")).groupBy("plan").agg(F.max("n").alias("found"), F.first("size").alias("size"))
    return best.where(F.col("found") < F.col("size"))


def principle_clusters(events: DataFrame, entities: DataFrame, types: tuple[str, ...] = ("decision", "preference_stated", "config_change", "fix")) -> DataFrame:
    """Entities with two eligible events or more from two sessions or more: counts, the commonest session key (ties to the
    smallest), the commonest project (ties to the first seen) and all source messages.

    events: event_id, ts_us, session_key, session_id, project, type, entities, source_message_ids; entities: id, type.
    """
    e = events.where(F.col("type").isin(*types)).withColumn("entity", F.explode(F.array_distinct("entities"))).join(entities.select(F.col("id").alias("entity")), "entity", "left_semi")
    g = e.groupBy("entity", "session_id").agg(F.count("*").alias("n")).groupBy("entity").agg(F.sum("n").alias("n_events"), F.count_if(F.coalesce("session_id", F.lit("")) != "").alias("n_sessions")).where("n_events >= 2 and n_sessions >= 2")
    sessions = mode_of(e, "entity", "session_key").select("entity", "session_key")
    projects = mode_of(e, "entity", "project", "ts_us").select("entity", "project")
    messages = e.select("entity", F.explode("source_message_ids").alias("m")).groupBy("entity").agg(F.array_sort(F.collect_set("m")).alias("provenance"))
    return g.join(sessions, "entity", "left").join(projects, "entity", "left").join(messages, "entity", "left")


def cluster_texts(members: DataFrame, rows: DataFrame, session: str = "session_key", least: int = 2) -> DataFrame:
    """Clusters (node, component) of two rows and two sessions or more with their ids, texts, sessions, and the union of
    entities; the theme is the text of the least id. rows: node, session, text, entities."""
    j = members.join(rows, "node")
    g = j.groupBy("component").agg(
        F.count("*").alias("size"), F.count_distinct(F.when(F.col(session).cast("string") != "", F.col(session))).alias("n_sessions"), F.array_sort(F.collect_list("node")).alias("ids"), F.array_sort(F.collect_list(F.struct("node", "text"))).alias("t"),
        F.array_sort(F.collect_set(session)).alias("sessions"),
    )
    e = j.select("component", F.explode("entities").alias("e")).groupBy("component").agg(F.array_sort(F.collect_set("e")).alias("entities"))
    g = g.where((F.col("size") >= least) & (F.col("n_sessions") >= 2)).join(e, "component", "left")
    return g.select("component", "size", "n_sessions", "ids", F.transform("t", lambda x: x["text"]).alias("texts"), "sessions", "entities", F.col("t")[0]["text"].alias("theme"))


def clusters(pairs: DataFrame) -> DataFrame:
    """Node, component of the pairs (a, b)."""
    return connected_components(pairs, "a", "b")


def summary(members: DataFrame, session: str, node: str = "node", component: str = "component") -> DataFrame:
    """Clusters of two members and two sessions or more."""
    g = members.groupBy(component).agg(F.count("*").alias("size"), F.count_distinct(session).alias("sessions"), F.array_sort(F.collect_set(node)).alias("ids"))
    return g.where("size >= 2 and sessions >= 2")


def mode_of(rows: DataFrame, key: str, value: str, seen: str | None = None) -> DataFrame:
    """The commonest known value of each key; ties go to the smallest, or with `seen` to the first by that column."""
    first = F.min(seen if seen else value).alias("_first")
    n = rows.where(F.col(value).isNotNull() & (F.col(value).cast("string") != "")).groupBy(key, value).agg(F.count("*").alias("n"), first)
    w = Window.partitionBy(key).orderBy(F.desc("n"), "_first", value)
    return n.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place", "_first")


def majority_items(rows: DataFrame, key: str, items: str) -> DataFrame:
    """Items that at least half of a key's rows hold."""
    total = rows.groupBy(key).agg(F.count("*").alias("total"))
    held = rows.select(key, F.explode(F.array_distinct(items)).alias("item")).groupBy(key, "item").agg(F.count("*").alias("n"))
    return held.join(total, key).where(F.col("n") >= F.ceil(F.col("total") / 2)).select(key, "item", "n", "total")


def document_frequency(rows: DataFrame, tokens: str) -> DataFrame:
    """A6."""
    return rows.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def term_rarity(rows: DataFrame, id_col: str, tokens: str, top: int = 10) -> DataFrame:
    """The mean of a text's `top` largest idf, over the largest possible. Tokens are cut once and written; of each text's only the
    rarest leave a partition."""
    words = saved(rows.select(id_col, F.explode(F.array_distinct(tokens)).alias("token")), "words")
    n = rows.count()
    df = words.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(0.0), S.idf(F.lit(n), F.col("df")))
    t = words.join(df, "token").select(id_col, idf.alias("idf"))
    t = t.withColumn("_place", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("idf")))).where(F.col("_place") <= top)
    most = math.log((n + 1) / 2) if n > 1 else 0.0
    mean = F.avg("idf")
    out = saved(t.groupBy(id_col).agg(F.round(S.clamp(mean / F.lit(most)) if most else F.lit(0.0), 6).alias("rarity")), "rarity")
    forget(words)
    return out
