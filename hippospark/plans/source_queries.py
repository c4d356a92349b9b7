"""Queries that write logs, exports and documents from the tables, and read them back by the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hippospark.functions.storage import shared_dir
from hippospark.operators import lookups as L
from hippospark.operators.offload import repaired_json
from hippospark.sources import readers, sinks

from .bindings import table
from .common import Queries

q = Queries()
QUERIES, ORACLES = q.queries, q.oracles
#: Files that a query's rows are dealt to.
FILES = 5


def written(spark: SparkSession, rows: DataFrame) -> str:
    """A folder with the lines of rows (file, value), in files of these names, in the shared folder."""
    root = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    rows.repartition("file").select("file", "value").write.partitionBy("file").text(f"{root}/raw")
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{root}/out"))
    for folder in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/raw")):
        name = folder.getPath().getName()
        if name.startswith("file="):
            part = [f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
            fs.rename(part[0], jvm.org.apache.hadoop.fs.Path(f"{root}/out/{name[5:]}"))
    return f"{root}/out"


def dealt(key: str, pattern: str) -> Column:
    return F.format_string(pattern, (F.col(key) % FILES + 1).cast("int")).alias("file")


def with_broken(rows: DataFrame, every: int = 7) -> DataFrame:
    """A broken line beside every seventh."""
    return rows.select("file", "value").unionByName(rows.where(F.col("k") % every == 0).select("file", F.lit('{"id": broken').alias("value")))


@q("SELECT 'm' || conv_id || '-' || turn AS id, 's' || (conv_id % 3) AS session, role, turn % 4 = 0 AS unknown FROM conversations")
def day_shards(spark: SparkSession, d: str) -> DataFrame:
    """Days of messages with broken lines; every fourth has an unreadable time."""
    c = table(spark, d, "conversations")
    at = F.when(F.col("turn") % 4 == 0, "when").otherwise("2024-01-01T00:00:00Z")
    value = F.to_json(F.struct(F.concat(F.lit("m"), "conv_id", F.lit("-"), "turn").alias("id"), F.concat(F.lit("s"), F.col("conv_id") % 3).alias("sessionKey"), "role", F.col("text").alias("content"), at.alias("recordedAt")))
    path = written(spark, with_broken(c.select(dealt("conv_id", "2024-01-%02d.jsonl"), value.alias("value"), F.col("conv_id").alias("k"))))
    return readers.read_l0_days(spark, path).where("id is not null").select("id", F.col("sessionKey").alias("session"), "role", F.col("recorded").isNull().alias("unknown"))


@q("SELECT 'r' || doc_id AS id, lang AS type, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN 'c' || doc_id ELSE 'u' || doc_id END AS changed FROM documents")
def memory_records(spark: SparkSession, d: str) -> DataFrame:
    """Updated, else created, else unknown."""
    k = F.col("doc_id")
    value = F.to_json(F.struct(F.concat(F.lit("r"), k).alias("id"), F.col("lang").alias("type"), F.when(k % 3 == 1, F.concat(F.lit("c"), k)).alias("createdAt"), F.when(k % 3 == 2, F.concat(F.lit("u"), k)).alias("updatedAt")))
    path = written(spark, with_broken(table(spark, d, "documents").select(dealt("doc_id", "records-%d.jsonl"), value.alias("value"), k.alias("k"))))
    return readers.read_l1(spark, path).where("id is not null").select("id", "type", "changed")


def offload_folder(spark: SparkSession, d: str) -> str:
    k = F.col("event_id")
    value = F.concat(F.lit('{"tool_call_id": '), F.when(k % 6 == 0, "null").otherwise(F.concat(F.lit('"t'), k, F.lit('"'))), F.lit(', "summary": "a'), F.when(k % 4 == 0, "\x01").otherwise(""), F.lit('b"}'))
    return written(spark, with_broken(table(spark, d, "events").select(dealt("user_id", "offload-%d.jsonl"), value.alias("value"), k.alias("k"))))


@q("SELECT 't' || event_id AS id, 'ab' AS summary, 'offload-' || (user_id % 5 + 1) || '.jsonl' AS source_file FROM events WHERE event_id % 6 > 0")
def offload_entries(spark: SparkSession, d: str) -> DataFrame:
    """Control characters are stripped and the line read again."""
    rows, _ = readers.read_offload(spark, offload_folder(spark, d))
    return rows.select(F.col("tool_call_id").alias("id"), F.regexp_replace("summary", "\x01", "").alias("summary"), "source_file")


@q("SELECT 'offload-' || (user_id % 5 + 1) || '.jsonl' AS source_file, count(*) + count(*) FILTER (event_id % 7 = 0) AS lines, count(*) FILTER (event_id % 7 = 0) AS corrupt, count(*) FILTER (event_id % 6 = 0) AS invalid FROM events GROUP BY 1")
def offload_counts(spark: SparkSession, d: str) -> DataFrame:
    """S11."""
    return readers.read_offload(spark, offload_folder(spark, d))[1]


def export(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as exports of a chat, with images, parts, empty and repeated messages."""
    c = table(spark, d, "conversations")
    k = F.col("turn")
    text = F.when(k % 5 == 4, " ").when(k % 3 == 1, F.concat("text", F.lit(" data:image/png;base64,QUJD="))).otherwise(F.col("text"))
    parts = F.when(k % 3 == 2, F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("image").alias("type"), F.lit("x").alias("text")), F.struct(F.lit("text").alias("type"), F.lit("more").alias("text"))))
    m = F.struct("turn", F.concat(F.lit("u"), "conv_id", F.lit("-"), F.when(k % 7 == 6, k - 1).otherwise(k)).alias("uuid"), F.when(F.col("role") == "user", "human").otherwise("bot").alias("sender"), F.when(k % 3 == 2, "").otherwise(text).alias("text"), parts.alias("content"), F.lit("2024-01-01T00:00:00Z").alias("created_at"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(m)).alias("m"))
    one = F.to_json(F.struct(F.concat(F.lit("c"), "conv_id").alias("uuid"), F.transform("m", lambda x: x.dropFields("turn")).alias("chat_messages")))
    whole = g.groupBy(dealt("conv_id", "export-%d.json")).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(one)), ","), F.lit("]")).alias("value"))
    return readers.read_chat_export(spark, written(spark, whole))


SAID = "CASE WHEN turn % 3 = 2 THEN text || chr(10) || 'more' WHEN turn % 5 = 4 THEN '' WHEN turn % 3 = 1 THEN text || ' [image]' ELSE text END"


@q(f"SELECT 'c' || conv_id AS conversation, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS idx, CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END AS role, {SAID} AS text FROM conversations")
def chat_export(spark: SparkSession, d: str) -> DataFrame:
    """S12, P22."""
    return export(spark, d).select("conversation", "idx", "role", "text")


@q(f"""WITH m AS (SELECT conv_id, turn, 'u' || conv_id || '-' || CASE WHEN turn % 7 = 6 THEN turn - 1 ELSE turn END AS u, {SAID} AS text FROM conversations), s AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY conv_id, turn) = 1 AS f FROM m), t AS (SELECT CASE WHEN NOT f OR conv_id % 4 = 0 THEN 'd' WHEN trim(text) = '' THEN 'e' ELSE 'i' END AS k FROM s)
SELECT count(*) AS total, count(*) FILTER (k = 'd') AS duplicate, count(*) FILTER (k = 'e') AS empty, count(*) FILTER (k = 'i') AS ingested FROM t""")
def chat_import_counts(spark: SparkSession, d: str) -> DataFrame:
    """A quarter of the conversations was imported before."""
    m = export(spark, d)
    known = m.where(F.substring("conversation", 2, 9).cast("long") % 4 == 0).select("uuid")
    return readers.ingested(m, known)[1].drop("redacted")


def seeds(spark: SparkSession, d: str, wrap: bool) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("r", F.floor(F.col("turn") / 2))
    m = c.groupBy("conv_id", "r").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    s = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("r", F.transform("m", lambda x: x.dropFields("turn")).alias("m")))).alias("c"))
    one = F.to_json(F.struct(F.concat(F.lit("k"), "conv_id").alias("sessionKey"), F.concat(F.lit("s"), "conv_id").alias("sessionId"), F.transform("c", lambda x: x["m"]).alias("conversations")))
    body = F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(one)), ","), F.lit("]"))
    return s.groupBy(dealt("conv_id", "seed-%d.json")).agg((F.concat(F.lit('{"sessions":'), body, F.lit("}")) if wrap else body).alias("value"))


SEED_SQL = "SELECT 'k' || conv_id AS \"key\", dense_rank() OVER (PARTITION BY conv_id ORDER BY turn // 2) - 1 AS round, row_number() OVER (PARTITION BY conv_id, turn // 2 ORDER BY turn) - 1 AS idx, role, text AS content FROM conversations"


@q(SEED_SQL)
def seed_wrapped(spark: SparkSession, d: str) -> DataFrame:
    """S13, format A."""
    return readers.read_seed(spark, written(spark, seeds(spark, d, True))).select(F.col("sessionKey").alias("key"), "round", "idx", "role", "content")


@q(SEED_SQL)
def seed_list(spark: SparkSession, d: str) -> DataFrame:
    """S13, format B."""
    return readers.read_seed(spark, written(spark, seeds(spark, d, False))).select(F.col("sessionKey").alias("key"), "round", "idx", "role", "content")


@q("""WITH m AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT 'q' || conv_id AS question_id, idx, role, 1704074520000 + 86400000 * (conv_id % 20) + 1000 * idx AS ts_ms, sum(CASE WHEN before = 'assistant' AND role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS round FROM m""")
def question_sets(spark: SparkSession, d: str) -> DataFrame:
    """S14, M38, W4, W15."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    date = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 20).cast("int")), "yyyy/MM/dd (EEE) '02:02'")
    one = F.to_json(F.struct(F.concat(F.lit("q"), "conv_id").alias("question_id"), F.array(date).alias("haystack_dates"), F.array(F.lit("s")).alias("haystack_session_ids"), F.array(F.transform("m", lambda x: x.dropFields("turn"))).alias("haystack_sessions")))
    g = c.groupBy(dealt("conv_id", "questions-%d.json")).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(one)), ","), F.lit("]")).alias("value"))
    return readers.read_questions(spark, written(spark, g)).select("question_id", "idx", "role", "ts_ms", "round")


@q("WITH m AS (SELECT conv_id % 5 AS f, lpad(CAST(conv_id AS VARCHAR), 9, '0') || lpad(CAST(turn AS VARCHAR), 6, '0') AS t, role, text FROM conversations), l AS (SELECT f, max(t) AS since FROM m WHERE role = 'user' GROUP BY 1) SELECT t AS uuid, role, text AS content FROM m JOIN l USING (f) WHERE t >= since")
def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Of each file the last turn."""
    c = table(spark, d, "conversations")
    t = F.concat(F.lpad(F.col("conv_id").cast("string"), 9, "0"), F.lpad(F.col("turn").cast("string"), 6, "0"))
    value = F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message"), t.alias("uuid"), t.alias("timestamp")))
    path = written(spark, with_broken(c.select(dealt("conv_id", "session-%d.jsonl"), value.alias("value"), F.col("turn").alias("k"))))
    return readers.read_transcript(spark, path).select("uuid", "role", "content")


@q("SELECT source || '.md' AS file, 'about ' || source AS summary, CAST(CASE WHEN min(doc_id) % 2 = 0 THEN count(*) ELSE 0 END AS INTEGER) AS heat, 'Body of ' || source AS body FROM documents WHERE source IS NOT NULL GROUP BY source")
def scene_documents(spark: SparkSession, d: str) -> DataFrame:
    """A scene per source; half of the heats cannot be read."""
    g = table(spark, d, "documents").where("source is not null").groupBy("source").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    lines = F.array(F.lit("-----META-START-----"), F.concat(F.lit("summary: about "), "source"), F.concat(F.lit("heat: "), F.when(F.col("first") % 2 == 0, F.col("n").cast("string")).otherwise("hot")), F.lit("-----META-END-----"), F.concat(F.lit("Body of "), "source"))
    path = written(spark, g.select(F.concat("source", F.lit(".md")).alias("file"), F.array_join(lines, "\n").alias("value")))
    s = readers.read_scenes(spark, path)
    return s.select("file", "summary", "heat", F.trim(F.regexp_replace("body", "\n", " ")).alias("body"))


@q("SELECT DISTINCT 'k' || (event_id % 300) AS id FROM events WHERE event_id % 300 >= 100")
def log_append(spark: SparkSession, d: str) -> DataFrame:
    """Tool calls that are not in the log yet, each once; ids compare without underscores."""
    old = spark.range(100).select(F.concat(F.lit("k_"), "id").alias("id"))
    new = table(spark, d, "events").select(F.concat(F.lit("k"), F.col("event_id") % 300).alias("id"))
    return sinks.append_new(old, new, "id")


@q("SELECT user_id % 3 AS g, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY 1")
def rewrite_by_source(spark: SparkSession, d: str) -> DataFrame:
    """A rewritten log and a new version of a table hold all their rows."""
    root = f"{shared_dir(spark)}/rewrite-{uuid.uuid4().hex}"
    e = table(spark, d, "events").select(F.concat(F.lit("f"), F.col("user_id") % 3).alias("source_file"), "event_id")
    sinks.write_by_source(e, f"{root}/log")
    back = spark.read.schema("event_id long, source_file string").json(f"{root}/log")
    again = spark.read.parquet(sinks.snapshot(back, f"{root}/table", 1))
    return again.groupBy(F.substring("source_file", 2, 9).cast("long").alias("g")).agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


@q("SELECT doc_id FROM documents WHERE doc_id % 4 > 0")
def delete_by_id(spark: SparkSession, d: str) -> DataFrame:
    """K4."""
    t = table(spark, d, "documents").select("doc_id")
    return sinks.without(t, t.where("doc_id % 4 = 0"), "doc_id")


@q("SELECT conv_id, turn, role, 'x' || chr(10) || 'y' AS said FROM conversations")
def json_repair(spark: SparkSession, d: str) -> DataFrame:
    """Raw line feeds within strings, control characters outside."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit('{"said": "x\ny", \x02"role": "'), "role", F.lit('"}')).alias("json"))
    j = F.from_json("json", "said string, role string")
    return repaired_json(c, "json").select("conv_id", "turn", j["role"].alias("role"), j["said"].alias("said"))


@q("SELECT 'first rule' || chr(10) || chr(10) || 'second rule' AS text")
def principles_text(spark: SparkSession, d: str) -> DataFrame:
    """Two files that are there, one that is not."""
    path = written(spark, spark.createDataFrame([("global.md", "first rule"), ("project.md", "second rule")], "file string, value string"))
    text = L.principles(spark, f"{path}/global.md", f"{path}/none.md", f"{path}/project.md")
    return spark.range(1).select(F.lit(text).alias("text"))


@q("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'debug' WHEN c_custkey % 4 = 1 THEN 'implement' WHEN c_custkey % 4 = 2 THEN 'explore' ELSE '' END AS task, CASE c_custkey % 5 WHEN 0 THEN 'episodic' WHEN 1 THEN 'instruction' WHEN 2 THEN 'persona' END AS kind, c_custkey % 2 = 0 AS cjk FROM customer")
def task_and_type(spark: SparkSession, d: str) -> DataFrame:
    """P29, P23, P14."""
    from hippospark.functions import text as X

    k = F.col("c_custkey")
    none = F.array().cast("array<string>")
    errors = F.when(k % 4 == 0, F.array(F.lit("E"))).otherwise(none)
    tools = F.when(k % 4 == 1, F.array(F.lit("Read"), F.lit("Edit"))).when(k % 4 == 2, F.array(F.lit("Grep"))).otherwise(none)
    kind = F.when(k % 5 == 0, "Episode").when(k % 5 == 1, "INSTRUCT").when(k % 5 == 2, " preference").otherwise("dream")
    return table(spark, d, "customer").select("c_custkey", X.task_type(errors, tools).alias("task"), X.memory_type(kind).alias("kind"), X.has_cjk(F.when(k % 2 == 0, "日本").otherwise("Nihon")).alias("cjk"))
