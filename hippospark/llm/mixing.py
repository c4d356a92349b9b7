"""Mixing sources to target weights, with DataFrame functions only.

Each source is cut by a seeded hash into blocks. A source's target over its size gives whole passes over its blocks, and
a remainder of blocks drawn in a seeded order; the last block gives documents until the target is met. The counts of
drawn blocks go down a splitting tree: at every node they are divided between two halves of the output shards by a
multivariate hypergeometric draw (source after source, each conditional on those before), so each shard gets an exact
quota of blocks of each source. A source's blocks, permuted, are then dealt to the shards by these quotas, and each
shard is ordered by a seeded hash, the slot of every copy.

A source's blocks are as many as its words over `BLOCK_WORDS`, a few bytes each, and pass one ordered window per source; a
node of the tree holds a number per source, so sources are kinds of text and not, say, a site each.

Defined results: a null text has size 0 and takes nothing; a null source is a source of its own, last; repeated rows are
taken alike; sources of size 0 have target 0; an empty table gives no rows; all columns of the caller are carried in one
struct, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WEIGHTS, SHARE, CEILING, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, 7_411
BLOCK_WORDS, LEVELS, PART_SIZE = 1 << 15, 4, 4 << 20


def uniform(*key: object) -> Column:
    """A seeded number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *key), 11) / F.lit(float(1 << 53))


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """Per source: rank (by code point, null last), source_size, target. Water-filling: sources are filled in step with
    their weights until their ceiling; as many rows as there are sources pass through the ordered windows."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("source_rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_rank") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * ceiling)
    every = Window.partitionBy()
    below = Window.orderBy(F.col("cap") / F.col("weight"), "source_rank").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))))
    # the first source in this order that stays below its ceiling fixes the level of all others
    first = F.min(F.when(F.col("level") < F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "source_rank", "level"))).over(every)
    s = s.withColumn("fill", first["level"])
    return s.select("source", "source_rank", "source_size", F.when(F.col("fill").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("fill") * F.col("weight"))).alias("target"))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `marked` among `total` are in `drawn` draws: the inverse of the distribution at u, within 9 deviations."""
    mean = drawn.cast("double") * marked / F.greatest(total, F.lit(1))
    spread = F.sqrt(mean * (1 - marked / F.greatest(total, F.lit(1)))) * 9 + 3
    low = F.greatest(F.lit(0), drawn - (total - marked), F.floor(mean - spread)).cast("long")
    high = F.least(drawn, marked, F.ceil(mean + spread)).cast("long")
    ratio = lambda k: (marked - k).cast("double") * (drawn - k) / ((k + 1).cast("double") * (total - marked - drawn + k + 1))
    ks = F.sequence(low, F.greatest(low, high))
    start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"))
    mass = F.aggregate(ks, start, lambda a, k: F.struct((a.w * ratio(k)).alias("w"), (a.s + a.w).alias("s"))).s
    found = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), low.alias("k"))
    return F.aggregate(ks, found, lambda a, k: F.struct((a.w * ratio(k)).alias("w"), (a.s + a.w).alias("s"), F.when(a.s <= u * mass, k).otherwise(a.k).alias("k"))).k


def halve(level: int):
    """One source's share of a node's left half, drawn given what earlier sources took."""

    def step(a: Column, p: Column) -> Column:
        k = hypergeometric(a.rest, p.n, a.draws, uniform(F.lit(level), F.col("node"), p.source_rank)).cast("long")
        return F.struct((a.rest - p.n).alias("rest"), (a.draws - k).alias("draws"), F.concat(a.left, F.array(k)).alias("left"))

    return step


def splitting_tree(quotas: DataFrame, levels: int = LEVELS) -> DataFrame:
    """quotas: source_rank, n (blocks). Per shard (0 to 2**levels - 1) and source: quota. A node is one row with its sources."""
    node = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct("source_rank", F.col("n").cast("long").alias("n")))).alias("parts")).withColumn("node", F.lit(0).cast("long"))
    for level in range(levels):
        total = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p.n)
        begin = F.struct(total.alias("rest"), F.floor((total + F.col("node") % 2) / 2).cast("long").alias("draws"), F.array().cast("array<long>").alias("left"))

        split = node.withColumn("left", F.aggregate("parts", begin, halve(level), lambda a: a.left))
        one = F.zip_with("parts", "left", lambda p, k: F.struct(p.source_rank.alias("source_rank"), k.alias("n")))
        two = F.zip_with("parts", "left", lambda p, k: F.struct(p.source_rank.alias("source_rank"), (p.n - k).alias("n")))
        node = C.saved(split.select(F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), one.alias("parts")), F.struct((F.col("node") * 2 + 1).alias("node"), two.alias("parts")))).alias("c")).select("c.*"), "op3-tree")
    return node.select(F.col("node").alias("shard"), F.explode("parts").alias("p")).select("shard", "p.source_rank", F.col("p.n").alias("quota"))


def mix(docs: DataFrame, size: Column, source: str = "source", levels: int = LEVELS) -> DataFrame:
    """docs: a source and any columns; size: a non-negative number of each row. Per row: row (a struct of all columns of docs), size,
    source_size, target, taken, shards (one for each time it is taken), slots (the seeded key that orders each of these
    copies within its shard). A row's block and slots follow from all its columns, so equal rows share them and are taken
    alike, and reruns agree whatever the partitions."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(source).cast("string").alias("source"), size.cast("long").alias("size"), F.xxhash64(F.lit(SEED), *docs.columns).alias("hash"))
    narrow = C.saved(rows.select("source", "size", "hash"), "op3-sizes")
    sources = C.saved(targets(narrow), "op3-targets").withColumnRenamed("source", "_source")

    def placed(x: DataFrame) -> DataFrame:
        met = x.join(sources, x["source"].eqNullSafe(F.col("_source"))).drop("_source")
        return met.withColumn("block", F.pmod("hash", F.greatest(F.lit(1), F.ceil(F.col("source_size") / BLOCK_WORDS))))

    units = placed(narrow)
    blocks = units.groupBy("source_rank", "block").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target")).where("words > 0")
    order = Window.partitionBy("source_rank").orderBy(F.xxhash64(F.lit(SEED + 1), "source_rank", "block"), "block")
    blocks = blocks.withColumn("passes", F.floor(F.col("target") / F.col("source_size")).cast("long"))
    blocks = blocks.withColumns({"before": F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "place": F.row_number().over(order)})
    rest = F.greatest(F.lit(0.0), F.least(F.col("target") - F.col("passes") * F.col("source_size") - F.col("before"), F.col("words").cast("double")))
    blocks = C.saved(blocks.withColumn("rest", rest).withColumn("copies", (F.col("passes") + (F.col("rest") > 0).cast("long"))), "op3-blocks")
    quotas = splitting_tree(blocks.groupBy("source_rank").agg(F.sum("copies").alias("n")), levels)
    upto = quotas.groupBy("source_rank").agg(F.sort_array(F.collect_list(F.struct("shard", "quota"))).alias("q"))
    upto = upto.select("source_rank", F.aggregate("q", F.array().cast("array<long>"), lambda a, q: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + q.quota))).alias("upto"))
    # a block's copies: first all first copies in permuted order, then the second ones
    copy = blocks.where("copies > 0").select("source_rank", "block", "place", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("pass"))
    dealt = copy.withColumn("index", F.row_number().over(Window.partitionBy("source_rank").orderBy("pass", "place")) - 1).join(upto, "source_rank")
    dealt = dealt.withColumn("shard", F.size(F.filter("upto", lambda x: x <= F.col("index"))))
    dealt = dealt.groupBy("source_rank", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("dealt"))
    plan = C.saved(blocks.select("source_rank", "block", "words", "passes", "rest").join(dealt, ["source_rank", "block"], "left"), "op3-plan")
    # of the one block per source that is drawn in part, rows in hash order; equal rows go together
    partial = (F.col("rest") > 0) & (F.col("rest") < F.col("words"))
    cut = units.join(plan.where(partial).select("source_rank", "block", "rest"), ["source_rank", "block"])
    cut = cut.groupBy("source_rank", "block", "hash", "size").agg(F.sum("size").alias("all"), F.first("rest").alias("rest")).where("all > 0")
    inner = Window.partitionBy("source_rank", "block").orderBy("hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    # what is larger than the whole remainder is passed over
    fits = (F.col("all") <= F.col("rest")) & (F.coalesce(F.sum(F.when(F.col("all") <= F.col("rest"), F.col("all"))).over(inner), F.lit(0)) + F.col("all") <= F.col("rest"))
    cut = C.saved(cut.withColumn("fits", fits), "op3-cut")
    gap = cut.groupBy("source_rank", "block").agg((F.first("rest") - F.coalesce(F.sum(F.when(F.col("fits"), F.col("all"))), F.lit(0))).alias("gap"))
    # and the one among the others that comes nearest to what is then missing
    near = cut.where("not fits").join(gap, ["source_rank", "block"]).withColumn("off", F.abs(F.col("all") - F.col("gap"))).where("off < gap")
    near = near.groupBy("source_rank", "block").agg(F.min(F.struct("off", "hash", "size")).alias("near")).select("source_rank", "block", "near.hash", "near.size")
    more = cut.where("fits").select("source_rank", "block", "hash", "size").unionByName(near).withColumn("more", F.lit(1).cast("long"))
    out = placed(rows).join(plan, ["source_rank", "block"], "left").join(more, ["source_rank", "block", "hash", "size"], "left")
    extra = F.when(partial, F.coalesce("more", F.lit(0))).otherwise((F.coalesce("rest", F.lit(0.0)) > 0).cast("long"))
    out = out.withColumn("times", F.when(F.col("size") > 0, F.coalesce("passes", F.lit(0)) + extra).otherwise(0))
    none = F.array().cast("array<struct<pass:bigint,shard:int>>")
    shards = F.transform(F.slice(F.coalesce("dealt", none), F.lit(1), F.col("times").cast("int")), lambda x: x.shard)
    out = out.withColumn("taken", F.col("size") * F.col("times")).withColumn("shards", F.when(F.col("times") > 0, shards).otherwise(F.array().cast("array<int>")))
    slots = F.transform("shards", lambda shard, i: F.shiftrightunsigned(F.xxhash64(F.lit(SEED + 2), shard, i, F.col("hash"), F.col("size")), 1))
    out = out.select("row", "size", "source_size", "target", "taken", "shards", slots.alias("slots"))
    out.total = sources.agg(F.sum("target")).first()[0] or 0.0
    return out


def in_order(mixed: DataFrame, levels: int = LEVELS, part: int = PART_SIZE) -> DataFrame:
    """The rows that a mix takes, once for each time, shard by shard in the order of their slots: a partition is a stretch of a shard
    with about `part` of size. Slots are uniform, so stretches are cut without a look at the rows."""
    each = max(1, -(-int(mixed.total) // (part << levels)))
    copies = mixed.where(F.size("shards") > 0).select("row", F.explode(F.arrays_zip("shards", "slots")).alias("copy"))
    stretch = F.least(F.lit(each - 1), F.floor(F.col("copy.slots") / F.lit(float(1 << 63)) * each))
    placed = copies.repartitionById(each << levels, (F.col("copy.shards") * each + stretch).cast("int"))
    return placed.sortWithinPartitions("copy.shards", "copy.slots").select("row.*")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = C.saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count("text").alias("size")), "op3-docs")
    return mix(sized, F.col("size")).select("row.doc_id", "size", "source_size", "target", "taken", "shards", "slots")
