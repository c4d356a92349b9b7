"""Readers of message logs, exports and documents. All read by path through Spark, so any store that it knows will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hippospark.functions.text import redacted
from hippospark.operators.windows import rounds
from hippospark.sources.exports import read_array

L0 = "id string, sessionKey string, sessionId string, role string, content string, timestamp long, recordedAt string"
L1 = "id string, content string, type string, priority int, scene_name string, sessionKey string, sessionId string, source_message_ids array<string>, timestamps array<string>, metadata struct<activity_start_time:string,activity_end_time:string>, createdAt string, updatedAt string"
OFFLOAD = "timestamp string, node_id string, tool_call string, summary string, result_ref string, tool_call_id string, session_key string, score double, offloaded string"
EXPORT = "uuid string, created_at string, chat_messages array<struct<uuid:string,sender:string,created_at:string,text:string,content:array<struct<type:string,text:string>>>>"
SEED = "sessionKey string, sessionId string, conversations array<array<struct<role:string,content:string,timestamp:long>>>"
QUESTION = "question_id string, question_type string, question string, answer string, question_date string, haystack_dates array<string>, haystack_session_ids array<string>, haystack_sessions array<array<struct<role:string,content:string,has_answer:boolean>>>, answer_session_ids array<string>"


def read_l0_days(spark: SparkSession, folder: str, session_key: str | None = None) -> DataFrame:
    """Day shards YYYY-MM-DD.jsonl; malformed lines are skipped; `recorded` is null where the time is unreadable. `by_time` sorts."""
    rows = spark.read.schema(L0).option("mode", "DROPMALFORMED").option("pathGlobFilter", "[0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9].jsonl").json(folder)
    rows = rows.withColumn("recorded", F.try_to_timestamp("recordedAt"))
    return (rows if session_key is None else rows.where(F.col("sessionKey") == session_key))


def by_time(rows: DataFrame, at: str = "recorded", key: str = "id") -> DataFrame:
    """Oldest first, unknown times last, for a caller that needs an order."""
    return rows.orderBy(F.asc_nulls_last(at), key)


def read_l1(spark: SparkSession, folder: str) -> DataFrame:
    """Memory records with `changed`, the time of update or of creation."""
    rows = spark.read.schema(L1).option("mode", "DROPMALFORMED").json(folder)
    return rows.withColumn("changed", F.coalesce("updatedAt", "createdAt", F.lit("")))


def read_offload(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Entries with their file, and per file the lines read, corrupt and invalid (without a tool_call_id)."""
    schema = T.StructType([*T._parse_datatype_string(OFFLOAD).fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.option("pathGlobFilter", "offload-*.jsonl").text(folder).where(F.trim("value") != "").select(F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0).alias("source_file"), "value")
    first = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    again = F.from_json(F.regexp_replace("value", r"[\x00-\x1f\x{fffd}\x{200b}-\x{200f}\x{feff}]", ""), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.withColumn("x", first).withColumn("x", F.when(F.col("x._corrupt_record").isNotNull(), again).otherwise(F.col("x"))).select("source_file", "x.*")
    counts = rows.groupBy("source_file").agg(F.count("*").alias("lines"), F.count_if(F.col("_corrupt_record").isNotNull()).alias("corrupt"), F.count_if(F.col("_corrupt_record").isNull() & F.col("tool_call_id").isNull()).alias("invalid"))
    return rows.where("_corrupt_record is null and tool_call_id is not null").drop("_corrupt_record"), counts


def read_chat_export(spark: SparkSession, path: str) -> DataFrame:
    """One row per message; human is user, every other sender assistant; text parts join, images are named. A file is one export,
    however large; many tasks read it."""
    c = read_array(spark, path, EXPORT).where("uuid is not null")
    m = c.select(F.col("uuid").alias("conversation"), F.posexplode("chat_messages").alias("idx", "m"))
    parts = F.array_join(F.transform(F.filter("m.content", lambda p: p.type == "text"), lambda p: p.text), "\n")
    text = F.when(F.coalesce(F.trim("m.text"), F.lit("")) != "", F.col("m.text")).otherwise(F.coalesce(parts, F.lit("")))
    role = F.when(F.col("m.sender") == "human", "user").otherwise("assistant")
    text = F.regexp_replace(text, r"(?i)data:image/[a-z+]+;base64,[A-Za-z0-9+/=]+", "[image]")
    return m.select("conversation", "idx", "m.uuid", F.substring(F.sha1(F.concat_ws("|", "conversation", "m.uuid")), 1, 12).alias("record_id"), role.alias("role"), text.alias("text"), F.try_to_timestamp("m.created_at").alias("ts"))


def ingested(messages: DataFrame, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Messages of an export that are neither in the ledger (uuid) nor empty, each uuid once, redacted; and the counts of all,
    duplicates, empty ones, redactions and what is ingested."""
    rows = messages.withColumn("_first", F.row_number().over(Window.partitionBy("uuid").orderBy("conversation", "idx")) == 1)
    known = ledger.select("uuid").distinct().withColumn("_known", F.lit(True)) if ledger is not None else None
    rows = rows.join(known, "uuid", "left") if known is not None else rows.withColumn("_known", F.lit(None).cast("boolean"))
    clean = redacted(F.col("text"))
    state = F.when(F.coalesce("_known", F.lit(False)) | ~F.col("_first"), "duplicate").when(F.trim("text") == "", "empty").otherwise("ingested")
    rows = rows.withColumns({"_state": state, "_clean": clean})
    count = lambda c: F.count_if(c)
    counts = rows.agg(F.count("*").alias("total"), *(count(F.col("_state") == x).alias(x) for x in ("duplicate", "empty", "ingested")), count((F.col("_state") == "ingested") & (F.col("_clean") != F.col("text"))).alias("redacted"))
    return rows.where("_state = 'ingested'").withColumn("text", F.col("_clean")).select(*messages.columns), counts


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """Format A ({sessions: [...]}) or B ([...]); ts_ms is null where a message has no time (see `timed`)."""
    text = spark.read.text(path, wholetext=True)
    a = F.from_json("value", f"struct<sessions:array<struct<{_fields(SEED)}>>>")["sessions"]
    b = F.from_json("value", f"array<struct<{_fields(SEED)}>>")
    s = text.select(F.posexplode(F.coalesce(a, b)).alias("session_no", "s"))
    r = s.select("session_no", "s.sessionKey", "s.sessionId", F.posexplode("s.conversations").alias("round", "messages"))
    m = r.select("session_no", "sessionKey", "sessionId", "round", F.posexplode("messages").alias("idx", "m"))
    return m.select("session_no", "sessionKey", "sessionId", "round", "idx", "m.role", "m.content", F.col("m.timestamp").alias("ts_ms"))


def timed(rows: DataFrame, now_ms: int) -> DataFrame:
    """Where no message of a seed has a time, they follow each other by 100 ms from now, session after session, so that a later
    session is never before a cursor; some with and some without is an error. A seed is one file's messages."""
    every = Window.partitionBy()
    some, none = F.max(F.col("ts_ms").isNotNull()).over(every), F.max(F.col("ts_ms").isNull()).over(every)
    at = F.row_number().over(Window.orderBy("session_no", "round", "idx")) - 1
    rows = rows.withColumns({"_some": some, "_none": none, "_at": at})
    wrong = F.raise_error(F.lit("some messages of the seed have a time and some have none")).cast("long")
    return rows.withColumn("ts_ms", F.when(F.col("_some") & F.col("_none"), wrong).when(F.col("_some"), F.col("ts_ms")).otherwise(F.lit(now_ms) + 100 * F.col("_at"))).drop("_some", "_none", "_at")


def _fields(ddl: str) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in T._parse_datatype_string(ddl).fields)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Long-memory questions as messages with their rounds, a message a second; a date that is not
    `YYYY/MM/DD (Dow) HH:MM` is an error."""
    rows = spark.read.schema(QUESTION).option("multiLine", True).json(path)
    s = rows.select("question_id", F.posexplode(F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")).alias("session_no", "s"))
    date = F.col("s.haystack_dates")
    strict = F.when(date.rlike(r"^\d{4}/\d{2}/\d{2} \([A-Za-z]{3}\) \d{2}:\d{2}$"), date).otherwise(F.raise_error(F.concat(F.lit("not a date: "), F.coalesce(date, F.lit("none")))).cast("string"))
    at = F.to_timestamp(F.regexp_replace(strict, r" \([A-Za-z]+\)", ""), "yyyy/MM/dd HH:mm")
    m = s.select("question_id", "session_no", F.col("s.haystack_session_ids").alias("session_id"), at.alias("begins"), F.posexplode("s.haystack_sessions").alias("idx", "m"))
    rows = m.select("question_id", "session_no", "session_id", "idx", "m.role", "m.content", F.coalesce("m.has_answer", F.lit(False)).alias("has_answer"), (F.unix_millis("begins") + 1000 * F.col("idx")).alias("ts_ms"))
    return rounds(rows.withColumn("_session", F.struct("question_id", "session_no")), "_session", "idx").drop("_session", "session_no")


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    """The last turn of a host's transcript: from the last user message on."""
    rows = spark.read.schema("type string, message struct<role:string,content:string>, uuid string, parentUuid string, timestamp string").option("mode", "DROPMALFORMED").json(path)
    rows = rows.where("message.content is not null").withColumn("file", F.col("_metadata.file_path"))
    last = rows.where("message.role = 'user'").groupBy("file").agg(F.max("timestamp").alias("since"))
    return rows.join(last, "file").where("timestamp >= since").select("file", "uuid", "message.role", "message.content", "timestamp")


def read_scenes(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown blocks with a META comment; missing fields are empty, an unreadable heat is 0."""
    t = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0).alias("file"), "value")
    field = lambda name: F.regexp_extract("value", rf"(?m)^\s*{name}:\s*(.*?)\s*$", 1)
    body = F.trim(F.regexp_replace("value", r"(?s)-----META-START-----.*?-----META-END-----", ""))
    return t.select("file", field("summary").alias("summary"), field("created").alias("created"), field("updated").alias("updated"), F.coalesce(field("heat").try_cast("int"), F.lit(0)).alias("heat"), body.alias("body"))
