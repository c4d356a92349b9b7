"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hippospark.functions.storage import saved

FAN_OUT, DECAY, THRESHOLD, MOST = 8, 0.5, 0.05, 50


def both_ways(edges: DataFrame) -> DataFrame:
    """G1: edges (src, dst, weight) as neighbours in both directions, weights of a pair summed."""
    one = edges.select("src", "dst", "weight")
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).where("weight > 0").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def top_neighbours(sums: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """The strongest neighbours of every node with their share of its activation. sums: both_ways.

    A hub's edges are cut to `fan_out` in each task before they meet (the window's group limit), so a hub is no hot task.
    """
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    top = sums.withColumn("place", F.row_number().over(w)).where(F.col("place") <= fan_out)
    return top.select("src", "dst", (F.col("weight") / F.sum("weight").over(Window.partitionBy("src"))).alias("share"))


def strongest(edges: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """top_neighbours of edges: what a store keeps for all spreading to come. A pair's weights are summed once and then seen from both ends;
    nodes stay where their neighbours were ranked, each task's in their order."""
    pairs = edges.where("src <> dst and weight > 0").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").alias("weight"))
    ends = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    sums = pairs.select(F.explode(F.array(ends("a", "b"), ends("b", "a"))).alias("x"), "weight").select("x.src", "x.dst", "weight")
    return top_neighbours(sums, fan_out).sortWithinPartitions("src")


def updated_neighbours(sums: DataFrame, near: DataFrame, changes: DataFrame, fan_out: int = FAN_OUT) -> tuple[DataFrame, DataFrame]:
    """Kept sums and strongest neighbours after changes (src, dst, weight, which is added and may be negative): only the nodes at
    the ends of changed edges are ranked anew."""
    c = changes.where("src <> dst").select("src", "dst", "weight")
    delta = c.unionByName(c.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    touched = delta.select("src").distinct()
    new = sums.join(touched, "src", "left_semi").select("src", "dst", "weight").unionByName(delta).groupBy("src", "dst").agg(F.sum("weight").alias("weight")).where("weight > 0")
    new = saved(new, "sums")
    return sums.join(touched, "src", "left_anti").select("src", "dst", "weight").unionByName(new), near.join(touched, "src", "left_anti").unionByName(top_neighbours(new, fan_out))


def spread(edges: DataFrame, seeds: DataFrame, hops: int = 2, threshold: float = THRESHOLD, most: int | None = MOST, include_seeds: bool = False, digits: int | None = 6, near: DataFrame | None = None) -> DataFrame:
    """Spreading activation from seeds (id, activation). digits: None where the caller goes on computing, and rounds at its own end.
    near: kept neighbours (strongest) in place of edges.

    Per hop a node passes activation * share * decay to its strongest neighbours, seeds like others; what reaches other
    nodes than seeds adds up over the hops.
    """
    near = saved(strongest(edges), "neighbours") if near is None else near
    frontier, total = seeds.where("activation > 0").groupBy("id").agg(F.sum("activation").alias("activation")), None
    for _ in range(hops):
        # written, so that a small one is known to be small: then it goes to the neighbours, and they stay
        frontier = saved(frontier, "frontier")
        frontier = near.join(frontier, near["src"] == frontier["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("activation") * F.col("share") * DECAY).alias("activation"))
        total = frontier if total is None else total.unionByName(frontier)
    if not include_seeds:
        total = total.join(seeds.select("id").distinct(), "id", "left_anti")
    flow = F.sum("activation")
    total = total.groupBy("id").agg((flow if digits is None else F.round(flow, digits)).alias("activation")).where(F.col("activation") >= threshold)
    return total if most is None else total.orderBy(F.desc("activation"), "id").limit(most)


def cooccurrence(events: DataFrame, event_id: str, entities: str) -> DataFrame:
    """Pairs of entities within one event, weight = number of events."""
    # pairs are made inside each event's own array, without a self-join
    pairs = events.select(F.array_sort(F.array_distinct(entities)).alias("x")).select(F.explode(F.flatten(F.transform("x", lambda a: F.transform(F.filter("x", lambda b: b > a), lambda b: F.struct(a.alias("src"), b.alias("dst")))))).alias("p"))
    return pairs.select("p.src", "p.dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def adjacency(events: DataFrame, relations: DataFrame, candidates: DataFrame) -> DataFrame:
    """Among candidates (id), events that name both and the support of relations, in both directions."""
    c = candidates.select("id").distinct()
    inner = events.select("id", F.explode(F.array_distinct("entities")).alias("e")).join(c.withColumnRenamed("id", "e"), "e").groupBy("id").agg(F.collect_list("e").alias("entities")).where("size(entities) > 1")
    pairs = cooccurrence(inner, "id", "entities")
    known = relations.join(c.withColumnRenamed("id", "src"), "src").join(c.withColumnRenamed("id", "dst"), "dst").where("src <> dst").select("src", "dst", F.when(F.col("support") > 0, F.col("support")).otherwise(1).alias("weight"))
    return both_ways(pairs.unionByName(known))


def primed(rankings: DataFrame, neighbours: DataFrame, weight: float = 0.15) -> DataFrame:
    """Rankings (id, ranking) with boost, the share of what flows into each from the others in one hop. neighbours: both directions."""
    seeds = rankings.where("ranking > 0").select("id", F.col("ranking").alias("activation"))
    one = neighbours.where("src < dst")
    got = spread(one, seeds, hops=1, threshold=0.0, most=None, include_seeds=True, digits=None)
    return rankings.join(got, "id", "left").select("id", "ranking", (weight * F.coalesce("activation", F.lit(0.0))).alias("boost"))


def relation_edges(relations: DataFrame) -> DataFrame:
    """Relations as edges that weigh their support, 1 where there is none."""
    return relations.where("src <> dst").select("src", "dst", F.when(F.col("support") > 0, F.col("support")).otherwise(1).alias("weight"))


def associations(relations: DataFrame, seeds: DataFrame, heads: DataFrame, events: DataFrame, hops: int = 2, most: int = 6, near: DataFrame | None = None) -> DataFrame:
    """What seeds (id) call to mind: entities that activation reaches over their relations, each with its most confident head fact
    that is no noise, else its latest event."""
    from hippospark.functions import text as X

    near = spread(relation_edges(relations), seeds.select("id", F.lit(1.0).alias("activation")).distinct(), hops, THRESHOLD, most, near=near)
    f = heads.where(~X.noise_attribute(F.col("attribute"))).join(near.select(F.col("id").alias("entity_id")), "entity_id")
    fact = f.groupBy("entity_id").agg(F.max_by(F.struct("id", F.lit("fact").alias("kind"), F.concat("attribute", F.lit(": "), "value").alias("text")), F.struct("confidence", "id")).alias("fact"))
    e = events.select("id", "ts_us", "text", F.explode(F.array_distinct("entities")).alias("entity_id")).join(near.select(F.col("id").alias("entity_id")), "entity_id")
    event = e.groupBy("entity_id").agg(F.max_by(F.struct("id", F.lit("event").alias("kind"), "text"), F.struct("ts_us", "id")).alias("event"))
    j = near.select(F.col("id").alias("entity_id"), "activation").join(fact, "entity_id", "left").join(event, "entity_id", "left").withColumn("m", F.coalesce("fact", "event")).where("m is not null")
    return j.select("entity_id", "activation", F.col("m.id").alias("owner_id"), F.col("m.kind").alias("owner_kind"), F.col("m.text").alias("text"))


def deepened(hits: DataFrame, score: str, relations: DataFrame, seeds: DataFrame, heads: DataFrame, events: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Associations of a recall; where it was thin (A20), one hop farther and up to sixteen."""
    from hippospark.operators.retrieval import recall_confidence

    thin = recall_confidence(hits, score).first()["thin"]
    return associations(relations, seeds, heads, events, *((3, 16) if thin else (2, 6)), near)


def fix_texts(bugs: DataFrame, relations: DataFrame, events: DataFrame) -> DataFrame:
    """Per cluster the texts of other events about what its bugs' entities are linked to by caused or fixed-by, either way. bugs: cluster,
    id (of an event in the cluster)."""
    own = events.select("id", "entities").join(bugs.select("cluster", "id"), "id").select("cluster", F.explode("entities").alias("e")).distinct()
    r = relations.where("type in ('caused', 'fixed-by')").select("src", "dst")
    both = r.unionByName(r.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    # what is said of an entity is said once, however many events say it
    said = events.where("text <> ''").select("text", F.explode("entities").alias("dst")).distinct()
    # links lead to a text from each entity, counted; those that end in the cluster's own entities are taken off. So links of a much linked
    # entity are never paired with all clusters that name it. An event of the cluster names the cluster's own only, and counts with these
    reached = both.join(said, "dst").groupBy(F.col("src").alias("e"), "text").agg(F.count("*").alias("n"))
    every = own.join(reached, "e").groupBy("cluster", "text").agg(F.sum("n").alias("n"))
    inside = own.withColumnRenamed("e", "src").join(own.withColumnRenamed("e", "dst"), "cluster").join(both, ["src", "dst"]).join(said, "dst")
    inside = inside.groupBy("cluster", "text").agg(F.count("*").alias("_own"))
    return every.join(inside, ["cluster", "text"], "left").where(F.col("n") > F.coalesce("_own", F.lit(0))).select("cluster", "text")
