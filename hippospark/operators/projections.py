"""What a session is opened with: scenes and the persona, projected from the knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hippospark.functions import parsing as P
from hippospark.functions import scalar as S
from hippospark.functions import text as X
from hippospark.functions.render import scene_entry

GENERAL = "__general__"
# How many events make scenes, how many scenes are shown, and the order of a persona's sections.
RECENT, TOP = 200, 12
SECTIONS = ("identity", "languages", "preferences", "process", "credentials")


def scenes(events: DataFrame, entities: DataFrame, limit: int = RECENT) -> DataFrame:
    """The newest events by their first known entity, merged ones by their canonical, others as general: heat, first and last time.

    Events that carry something like a secret, or name an entity that sounds like one, are left out. events: id, ts_us, text,
    entities; entities: id, name, merged_into."""
    from hippospark.operators.knowledge import canonical_ids

    e = events.orderBy(F.desc("ts_us"), F.desc("id")).limit(limit)
    named = canonical_ids(entities).select(F.col("id").alias("entity"), "root").join(entities.select(F.col("id").alias("root"), F.col("name").alias("_name")), "root")
    m = e.select("id", F.posexplode("entities").alias("at", "entity")).join(named, "entity")
    g = m.groupBy("id").agg(F.min_by("root", "at").alias("scene"), F.bool_or(P.looks_secret(F.col("_name"))).alias("_secret"))
    j = e.where(~P.looks_secret(F.col("text"))).join(g, "id", "left").where(~F.coalesce("_secret", F.lit(False)))
    return j.groupBy(F.coalesce("scene", F.lit(GENERAL)).alias("scene")).agg(F.count("*").alias("heat"), F.min("ts_us").alias("created"), F.max("ts_us").alias("updated"))


def scene_blocks(found: DataFrame, entities: DataFrame, top: int = TOP) -> DataFrame:
    """The hottest scenes with their file, summary and place; files that are there beyond these are stale."""
    named = found.join(entities.select(F.col("id").alias("scene"), "name", "type"), "scene", "left")
    title = F.coalesce("name", F.lit("General Activity"))
    file = F.concat(F.lit("scene-"), F.when(F.col("name").isNull(), "general-activity").otherwise(S.slug(S.nfkc(F.concat_ws("-", "type", "name")), "-")), F.lit(".md"))
    rows = named.select("scene", file.alias("file"), F.concat(title, F.lit(": "), "heat", F.lit(" event(s)")).alias("summary"), "heat", "created", "updated")
    place = F.row_number().over(Window.orderBy(F.desc("heat"), "scene"))
    rows = rows.orderBy(F.desc("heat"), "scene").limit(top).withColumn("place", place)
    return rows.withColumn("navigation", scene_entry(F.col("file"), F.col("heat"), F.col("updated").cast("string"), F.col("summary")))


def persona_lines(entities: DataFrame, heads: DataFrame) -> DataFrame:
    """Head facts of persons and preferences whose attribute may be shown and that hold nothing like a secret, each line once in its
    section: section, place, line. Rules come by confidence, other lines by their text."""
    e = entities.where("merged_into is null").where(F.col("type").isin("person", "preference") & ~P.looks_secret(F.col("name"))).select(F.col("id").alias("entity_id"), "name")
    h = heads.join(e, "entity_id").withColumn("section", P.persona_section(F.col("attribute"))).where(F.col("section").isNotNull() & ~P.looks_secret(F.col("value")))
    line = X.escaped_tags(F.concat(F.lit("- **"), "name", F.lit("** — "), F.regexp_replace("attribute", "_", " "), F.lit(": "), "value"))
    g = h.select("section", line.alias("line"), "confidence").groupBy("section", "line").agg(F.max("confidence").alias("confidence"))
    strength = F.when(F.col("section") == "process", -F.col("confidence")).otherwise(0.0)
    return g.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy(strength, "line"))).select("section", "place", "line")


def persona_text(lines: DataFrame) -> DataFrame:
    """The persona as one text; as many rows as a persona has lines meet."""
    order = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section"))
    g = lines.groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("body"))
    block = F.concat(F.lit("## "), F.initcap("section"), F.lit("\n\n"), "body")
    return g.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("at"), block.alias("block")))), lambda x: x["block"]), "\n\n").alias("text"))
