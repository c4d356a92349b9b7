"""The knowledge base: bitemporal facts, entities, relations and merges as DataFrame transformations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hippospark.functions import scalar as S
from hippospark.functions.storage import forget, saved

KEY = ("entity_id", "attribute")


def fact_islands(facts: DataFrame) -> DataFrame:
    """Facts in (valid_from, seq) order; consecutive equal values fold into one version. Values are compared in normal
    form, the first one as it was stored stands for a version; supports (1 where there is no such column) add up."""
    w = Window.partitionBy(*KEY).orderBy("valid_from", "seq")
    rows = facts.withColumn("_norm", S.fact_value(F.col("value"))).withColumn("support", F.col("support") if "support" in facts.columns else F.lit(1))
    same = F.lag("_norm").over(w) == F.col("_norm")
    marked = rows.withColumn("fresh", F.when(same, 0).otherwise(1)).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.struct("valid_from", "seq", "value")).alias("first")
    g = marked.groupBy(*KEY, "island").agg(first, F.sum("support").alias("support"), F.max("confidence").alias("confidence"))
    return g.select(*KEY, "island", "first.value", "first.valid_from", "support", "confidence", "first.seq")


def fact_versions(facts: DataFrame) -> DataFrame:
    """K10 for input in valid_from order, W7: versions with valid_to from the next one; the last of each key is the head."""
    w = Window.partitionBy(*KEY).orderBy("island")
    return fact_islands(facts).withColumn("valid_to", F.lead("valid_from").over(w)).withColumn("is_head", F.col("valid_to").isNull())


HEAD = "struct<value:string,norm:string,valid_from:bigint,confidence:double,support:bigint>"
VERSION = "struct<value:string,valid_from:bigint,valid_to:bigint,confidence:double,support:bigint>"


def fold_facts(facts: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Assertions in arrival order (learned_at, seq) folded onto the heads of their keys, whatever order valid_from comes in.

    A value that is the same in normal form supports the head, which keeps the value as first stored; a value not older than
    the head closes it; an older one goes straight to history. heads: what held before (entity_id, attribute, value,
    valid_from, confidence, support), one row a key. Rows: the versions that the batch closed, and the head of each of its
    keys (valid_to null). Only a batch's own assertions of a key meet in a row, however long the key's history is.
    """
    facts = facts.withColumn("_norm", S.fact_value(F.col("value")))
    one = F.struct("learned_at", "seq", "value", F.col("_norm").alias("norm"), "valid_from", "confidence")
    rows = facts.groupBy(*KEY).agg(F.array_sort(F.collect_list(one)).alias("rows"))
    none = F.lit(None).cast(HEAD)
    if heads is None:
        rows = rows.withColumn("head", none)
    else:
        before = F.struct("value", S.fact_value(F.col("value")).alias("norm"), F.col("valid_from").cast("long").alias("valid_from"), "confidence", F.col("support").cast("long").alias("support"))
        rows = rows.join(heads.select(*KEY, before.alias("head")), list(KEY), "left")
    start = F.struct(F.col("head").cast(HEAD).alias("head"), F.array().cast(f"array<{VERSION}>").alias("closed"))

    def version(value, valid_from, valid_to, confidence, support):
        return F.struct(value.alias("value"), valid_from.alias("valid_from"), valid_to.cast("bigint").alias("valid_to"), confidence.alias("confidence"), support.cast("bigint").alias("support"))

    def step(acc, x):
        h = acc["head"]
        fresh = F.struct(x["value"].alias("value"), x["norm"].alias("norm"), x["valid_from"].alias("valid_from"), x["confidence"].alias("confidence"), F.lit(1).cast("bigint").alias("support"))
        stronger = F.struct(h["value"].alias("value"), h["norm"].alias("norm"), F.least(h["valid_from"], x["valid_from"]).alias("valid_from"), F.greatest(h["confidence"], x["confidence"]).alias("confidence"), (h["support"] + 1).alias("support"))
        close = F.concat(acc["closed"], F.array(version(h["value"], h["valid_from"], x["valid_from"], h["confidence"], h["support"])))
        late = F.concat(acc["closed"], F.array(version(x["value"], x["valid_from"], h["valid_from"], x["confidence"], F.lit(1))))
        return (
            F.when(h.isNull(), F.struct(fresh.alias("head"), acc["closed"].alias("closed")))
            .when(h["norm"] == x["norm"], F.struct(stronger.alias("head"), acc["closed"].alias("closed")))
            .when(x["valid_from"] >= h["valid_from"], F.struct(fresh.alias("head"), close.alias("closed")))
            .otherwise(F.struct(h.alias("head"), late.alias("closed")))
        )

    def finish(acc):
        h = acc["head"]
        return F.concat(acc["closed"], F.array(version(h["value"], h["valid_from"], F.lit(None), h["confidence"], h["support"])))

    folded = rows.select(*KEY, F.aggregate("rows", start, step, finish).alias("versions"))
    return folded.select(*KEY, F.explode("versions").alias("v")).select(*KEY, "v.*")


def upsert_facts(facts: DataFrame) -> DataFrame:
    """K10 from nothing: all versions of all keys."""
    return fold_facts(facts)


def asof_facts(facts: DataFrame, at: int) -> DataFrame:
    """The version of each key that was valid at a time."""
    return fact_versions(facts).where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def contradictions(heads: DataFrame) -> DataFrame:
    """Keys whose head facts hold two distinct values or more, with the siblings' values."""
    g = heads.withColumn("_norm", S.fact_value(F.col("value"))).groupBy(*KEY).agg(F.array_sort(F.collect_set("_norm")).alias("values"))
    return g.where(F.size("values") > 1)


def contradicting_facts(heads: DataFrame) -> DataFrame:
    """Each head fact of a contradictory key with the values of its siblings that are not its own. A key's distinct values make one
    row, however many facts assert them."""
    h = heads.withColumn("_norm", S.fact_value(F.col("value")))
    g = h.groupBy(*KEY).agg(F.array_sort(F.collect_set("_norm")).alias("_all")).where(F.size("_all") > 1)
    return h.join(g, list(KEY)).withColumn("siblings", F.array_remove("_all", F.col("_norm"))).drop("_norm", "_all")


def contradicted_keys(heads: DataFrame, touched: DataFrame) -> DataFrame:
    """A8 by change: of the keys (entity_id, attribute) that a batch touched, whether their heads contradict each other now; what is
    true of other keys cannot have changed."""
    keys = touched.select(*KEY).distinct()
    now = contradictions(heads.join(keys, list(KEY), "left_semi")).select(*KEY, F.lit(True).alias("_now"))
    return keys.join(now, list(KEY), "left").select(*KEY, F.coalesce("_now", F.lit(False)).alias("contradiction"))


def newest(assertions: DataFrame, time: str) -> DataFrame:
    """Head facts: the assertions of each key's last time, all of them."""
    last = assertions.groupBy(*KEY).agg(F.max(time).alias("_last"))
    return assertions.join(last, list(KEY)).where(F.col(time) == F.col("_last")).drop("_last")


def upsert_latest(old: DataFrame, new: DataFrame, key: str, version: str, keep: str | None = None) -> DataFrame:
    """K1, K2: the newest row per key; `keep` (a creation time) stays the oldest."""
    every = old.unionByName(new)
    w = Window.partitionBy(key).orderBy(F.desc(version))
    if keep:
        every = every.withColumn(keep, F.min(keep).over(Window.partitionBy(key)))
    return every.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def record_times(records: DataFrame, times: str = "timestamps") -> DataFrame:
    """K1: records with the first and the last of their times, empty where they have none."""
    t = F.filter(times, lambda x: x.isNotNull() & (x != ""))
    return records.withColumns({"timestamp_start": F.coalesce(F.array_min(t), F.lit("")), "timestamp_end": F.coalesce(F.array_max(t), F.lit(""))})


def support_edges(edges: DataFrame, src: str, dst: str, *more: str) -> DataFrame:
    """One relation per ends and type, with the support of all assertions."""
    return edges.groupBy(src, dst, *more).agg(F.count("*").alias("support"))


def rekey_edges(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Map both ends by merges (old, canonical), drop loops, fold collisions. Edges: src, dst, support."""
    for end in ("src", "dst"):
        m = merges.select(F.col("old").alias(end), F.col("canonical").alias(f"_{end}"))
        edges = edges.join(m, end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    return edges.where("src <> dst").groupBy("src", "dst").agg(F.sum("support").alias("support"))


def chase_pointers(pointers: DataFrame) -> DataFrame:
    """Node -> root along (node, target) by pointer jumping; nodes of a cycle report themselves as cyclic.

    Each round doubles the distance, so there are logarithmically many; a pointer past the end stays. Only nodes that lead
    into a cycle still move after as many rounds as the number of pointers has binary digits.
    """
    p = saved(pointers.select("node", F.col("target").alias("root")), "pointers")
    for _ in range(p.count().bit_length() + 1):
        on = p.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = saved(p.join(on, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "pointers")
        moved = new.where("moved and root <> node").count()
        changed = new.select("node", "root").exceptAll(p).limit(1).count()
        forget(p)
        p = new.select("node", "root")
        p.saved_path = new.saved_path
        if not moved or not changed:
            break
    ends = pointers.select(F.col("node").alias("root"), F.lit(True).alias("cyclic"))
    return p.join(ends, "root", "left").select("node", "root", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def profile_sync(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Actions from (name, md5, baseline) and (name, md5, version)."""
    a, b = local.alias("a"), remote.alias("b")
    both = a.join(b, F.col("a.name") == F.col("b.name"), "full_outer")
    action = F.when(F.col("b.name").isNull(), "create").when(F.col("a.name").isNull(), "delete").when(F.col("a.md5") == F.col("b.md5"), "skip").when(F.col("a.baseline") != F.col("b.version"), "conflict").otherwise("update")
    version = F.when(F.col("b.name").isNull(), 1).when(action == "update", F.col("b.version") + 1).otherwise(F.col("b.version"))
    return both.select(F.coalesce("a.name", "b.name").alias("name"), action.alias("action"), version.cast("long").alias("version"))


def latest_by(rows: DataFrame, key: str, order: Sequence[str], *columns: str) -> DataFrame:
    """Per key the columns of its last row in this order."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last")).select(key, "_last.*")


def canonical_pick(members: DataFrame, group: str) -> DataFrame:
    """Of each group the member that stands for it: by importance, then number of facts, then the earlier made, then id. members: id,
    importance, facts, created."""
    # of full ties the least id: ids are compared only among members that agree in all else
    top = members.groupBy(group).agg(F.max(F.struct("importance", "facts", (-F.col("created")).alias("created"))).alias("_top"))
    tied = members.join(top.select(group, "_top"), group).where((F.col("importance") == F.col("_top.importance")) & (F.col("facts") == F.col("_top.facts")) & (-F.col("created") == F.col("_top.created")))
    return tied.groupBy(group).agg(F.min("id").alias("id"))
