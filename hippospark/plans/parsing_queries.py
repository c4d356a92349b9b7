"""Queries of parsers, normalisers and rendered blocks over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hippospark.functions import parsing as P
from hippospark.functions import render as R
from hippospark.functions import scalar as S

from .bindings import table
from .common import Queries

q = Queries()
QUERIES, ORACLES = q.queries, q.oracles
NOW_MS = 1_735_689_600_000
WORDS = "SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[\\p{L}_]+'))) AS w FROM conversations"


def words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}_]+"), F.lit(0))).alias("w")).select(F.lower("w").alias("w")).distinct()


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


SYNONYMS = " ".join(f"WHEN {quoted(w)} THEN {quoted(c)}" for c, ws in P.ATTRIBUTE_SYNONYMS.items() for w in ws)
EVERY_SYNONYM = ", ".join(quoted(w) for ws in P.ATTRIBUTE_SYNONYMS.values() for w in ws)


@q(f"WITH w AS ({WORDS} UNION SELECT unnest([{EVERY_SYNONYM}])) SELECT w AS word, CASE w {SYNONYMS} ELSE w END AS attribute FROM w")
def canonical_attributes(spark: SparkSession, d: str) -> DataFrame:
    """M25 of all words of the conversations and all synonyms, in capitals with space around."""
    known = F.explode(F.array(*(F.lit(w) for ws in P.ATTRIBUTE_SYNONYMS.values() for w in ws)))
    w = words(spark, d).unionByName(spark.range(1).select(known.alias("w"))).distinct()
    return w.select(F.col("w").alias("word"), P.canonical_attribute(F.concat(F.lit("  "), F.when(F.col("w").rlike("^[a-z_]+$"), F.initcap("w")).otherwise(F.col("w")), F.lit(" "))).alias("attribute"))


SECTIONS = " ".join(f"WHEN k IN ({', '.join(map(quoted, ws))}) THEN {quoted(s)}" for s, ws in P.PERSONA_SECTIONS.items())


@q(f"""WITH w AS ({WORDS}), a AS (SELECT w, unnest([w, 'rule_' || w, w || '_path', 'role', 'os', 'workflow', 'timezone']) AS k FROM w)
SELECT w AS word, k AS attribute, CASE {SECTIONS} WHEN regexp_matches(k, '^(rule|process|workflow|convention|working_style|communication_style)_') THEN 'process' WHEN regexp_matches(k, '_(location|path|file|dir)$') THEN 'credentials' END AS section FROM a""")
def persona_sections(spark: SparkSession, d: str) -> DataFrame:
    """P21."""
    w = words(spark, d)
    w = w.select("w", F.explode(F.array("w", F.concat(F.lit("rule_"), "w"), F.concat("w", F.lit("_path")), *map(F.lit, ("role", "os", "workflow", "timezone")))).alias("k"))
    return w.select(F.col("w").alias("word"), F.col("k").alias("attribute"), P.persona_section(F.upper("k")).alias("section"))


@q("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'src/' || user_id || '/f.py' END AS path, CAST(CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS INTEGER) AS touched FROM events")
def files_touched(spark: SparkSession, d: str) -> DataFrame:
    """Clicks and views stand for edits and reads, others for tools that name no file."""
    tool = F.when(F.col("event_type") == "click", "Edit").when(F.col("event_type") == "view", "Read").otherwise("Bash")
    path = P.file_touched(tool, F.concat(F.lit("src\\"), "user_id", F.lit("\\f.py")))
    return table(spark, d, "events").select("event_id", path.alias("path"), F.when(path.isNotNull(), 1).otherwise(0).alias("touched"))


@q("SELECT page_id, regexp_matches(html, '(?i)\\b(secret|segreto|password|api[_\\s-]?key|apikey|token|credential|credenziali)\\b') OR regexp_matches(html, '\\b[A-Z][A-Z0-9]{2,}-[A-Z0-9]{2,}(?:-[A-Z0-9]+)*-?\\d{1,}\\b') AS secret FROM pages")
def secret_heuristic(spark: SparkSession, d: str) -> DataFrame:
    """P11."""
    return table(spark, d, "pages").select("page_id", P.looks_secret(F.col("html")).alias("secret"))


@q("""WITH k AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'agent:a:' || c_custkey WHEN 1 THEN 'agent:a:subagent:' || c_custkey WHEN 2 THEN 'temp:' || c_name WHEN 3 THEN 'agent:cron:' || c_custkey WHEN 4 THEN 'bench-judge-' || c_name ELSE c_mktsegment END AS key, CASE WHEN c_custkey % 7 = 0 THEN 'Heartbeat' END AS trigger FROM customer)
SELECT c_custkey, (c_custkey % 6 IN (1, 2, 3, 4) OR trigger IS NOT NULL) AS skipped FROM k""")
def skipped_sessions(spark: SparkSession, d: str) -> DataFrame:
    """P10, M54."""
    k = F.col("c_custkey")
    key = F.when(k % 6 == 0, F.concat(F.lit("agent:a:"), k)).when(k % 6 == 1, F.concat(F.lit("agent:a:subagent:"), k)).when(k % 6 == 2, F.concat(F.lit("temp:"), "c_name")).when(k % 6 == 3, F.concat(F.lit("agent:cron:"), k))
    key = key.when(k % 6 == 4, F.concat(F.lit("bench-judge-"), "c_name")).otherwise(F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", P.skipped_session(key, F.when(k % 7 == 0, "Heartbeat"), ("bench-*-Customer*",)).alias("skipped"))


@q("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN 'main' ELSE 'main-w' || (c_custkey % 5) END AS agent, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN replace(c_name, '#', '#') || '_1' ELSE 'swebench-w' || (c_custkey % 5) || '_x_y' END AS session FROM customer")
def session_key_parts(spark: SparkSession, d: str) -> DataFrame:
    """M45."""
    k = F.col("c_custkey")
    key = F.when(k % 3 == 0, F.concat(F.lit("user:main:"), k)).when(k % 3 == 1, F.concat(F.lit("agent:main:"), "c_name", F.lit(":1"))).otherwise(F.concat(F.lit("agent:main:swebench-w"), k % 5, F.lit("/x..y")))
    return table(spark, d, "customer").select("c_custkey", P.session_parts(key).alias("p")).select("c_custkey", "p.agent", "p.session")


@q("""WITH v AS (SELECT p_partkey, [p_size % 3, p_partkey % 12, p_size] AS a, [1, 9, 25] AS b FROM part) SELECT p_partkey, CASE WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END AS cmp FROM v""")
def version_compare(spark: SparkSession, d: str) -> DataFrame:
    """Numbers, not text, decide (9 is before 12)."""
    return table(spark, d, "part").select("p_partkey", P.version_order(F.concat_ws(".", F.col("p_size") % 3, F.col("p_partkey") % 12, "p_size"), F.lit("1.9.25")).alias("cmp"))


@q(f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN {NOW_MS} ELSE CAST(epoch_ms(o_orderdate) AS BIGINT) END AS ms FROM orders")
def map_timestamps(spark: SparkSession, d: str) -> DataFrame:
    """Unreadable times become now."""
    o = table(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 5 == 0, "no time").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return o.select("o_orderkey", P.millis_or(text, NOW_MS).alias("ms"))


@q("SELECT event_id, CASE WHEN strftime(ts, '%H:%M') = '00:00' THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS shown FROM events")
def short_times(spark: SparkSession, d: str) -> DataFrame:
    """M40."""
    return table(spark, d, "events").select("event_id", P.short_time(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("shown"))


@q("""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'conversation' WHEN doc_id % 4 = 0 THEN 'authoritative_source' WHEN doc_id % 4 = 1 THEN 'tool_output' ELSE 'conversation' END AS origin,
CASE WHEN doc_id % 4 = 0 THEN 'trusted' ELSE 'unverified' END AS trust, CASE WHEN doc_id % 4 <> 3 AND toxic = 1 THEN 'rejected' ELSE 'clear' END AS gate, CAST(CASE WHEN doc_id % 4 <> 3 THEN 1 ELSE 0 END AS INTEGER) AS sources FROM labels""")
def provenance_stamps(spark: SparkSession, d: str) -> DataFrame:
    """A stamp's own trust is not believed; a stamp that does not hold becomes the default."""
    k = F.col("doc_id")
    origin = F.when(k % 4 == 0, "authoritative_source").when(k % 4 == 1, "tool_output").when(k % 4 == 2, "conversation").otherwise("hearsay")
    json = F.concat(F.lit('{"origin":"'), origin, F.lit('","trust":"trusted","source_message_ids":["m'), k, F.lit('"]'), F.when(F.col("toxic") == 1, ',"gate_state":"rejected"').otherwise(""), F.lit(',"schema":2}'))
    rows = table(spark, d, "labels").select("doc_id", P.provenance(json).alias("p"))
    return rows.select("doc_id", "p.origin", "p.trust", P.gate_state(F.col("p")).alias("gate"), F.size("p.source_message_ids").alias("sources"))


@q("SELECT item_id, nullif(array_to_string([ '\"' || t || '\"' FOR t IN regexp_extract_all(text, '[\\p{L}\\p{N}_]+')], ' OR '), '') AS query FROM benchmark")
def fts_queries(spark: SparkSession, d: str) -> DataFrame:
    """M32."""
    return table(spark, d, "benchmark").select("item_id", P.fts_query(F.col("text")).alias("query"))


@q("""WITH s AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]{2,}') AS l, regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}\\x{3040}-\\x{30ff}\\x{ac00}-\\x{d7af}]') AS c FROM documents)
SELECT doc_id, CAST(len(list_distinct(list_concat(l, c, [c[i] || c[i + 1] FOR i IN range(1, len(c))]))) AS INTEGER) AS n, md5(array_to_string(list_sort(list_distinct(list_concat(l, c, [c[i] || c[i + 1] FOR i IN range(1, len(c))]))), ' ')) AS words FROM s""")
def extracted_words(spark: SparkSession, d: str) -> DataFrame:
    """M34."""
    w = table(spark, d, "documents").select("doc_id", P.extract_words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").alias("n"), F.md5(F.array_join(F.array_sort("w"), " ")).alias("words"))


@q("SELECT doc_id, CAST(coalesce(ceil((length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10ffff}]'))) / 4.0), 0) AS BIGINT) AS tokens FROM documents")
def token_counts_fallback(spark: SparkSession, d: str) -> DataFrame:
    """M36 without a vocabulary."""
    return table(spark, d, "documents").select("doc_id", P.token_count(F.col("text")).alias("tokens"))


NAMES = "regexp_extract_all(lower(%s), '[\\p{L}\\p{N}]+')"
TOKENS = "list_distinct(list_filter(" + NAMES + ", lambda t: (length(t) >= 3 AND t NOT IN (" + ", ".join(map(quoted, P.NAME_STOP_WORDS)) + ")) OR regexp_matches(t, '^[0-9]+$')))"


@q(f"""WITH n AS (SELECT p_partkey, {TOKENS % "p_name || ' 7'"} AS a, {TOKENS % "p_type || ' the 7'"} AS b, lower(p_name || ' 7') AS x, lower(p_type || ' the 7') AS y FROM part)
SELECT p_partkey, round(CASE WHEN x = y THEN 1 WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS score FROM n""")
def name_similarities(spark: SparkSession, d: str) -> DataFrame:
    """A part's name against its type, both with a number."""
    return table(spark, d, "part").select("p_partkey", F.round(P.name_similarity(F.concat("p_name", F.lit(" 7")), F.concat("p_type", F.lit(" the 7"))), 6).alias("score"))


@q("""SELECT o_orderkey, '{"files":[' || array_to_string(['"p' || x || '"' FOR x IN list_sort(list(DISTINCT CAST(l_partkey AS VARCHAR)))], ',') || '],"error_signatures":[' || array_to_string(['"' || x || '"' FOR x IN list_sort(list(DISTINCT l_returnflag))], ',') || '],"task_type":"' || max(o_orderpriority) || '"}' AS trigger FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def trigger_keys(spark: SparkSession, d: str) -> DataFrame:
    """An order's parts, flags and priority as files, errors and task."""
    o, li = table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    g = o.join(li, o["o_orderkey"] == li["l_orderkey"]).groupBy("o_orderkey").agg(F.collect_set(F.concat(F.lit("p"), "l_partkey")).alias("f"), F.collect_set("l_returnflag").alias("e"), F.max("o_orderpriority").alias("t"))
    return g.select("o_orderkey", P.trigger_key(F.col("f"), F.col("e"), F.col("t")).alias("trigger"))


@q("""WITH n AS (SELECT o_custkey, list('00' || (o_orderkey % 10) || '-N' || o_orderkey ORDER BY o_orderkey) AS ids, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS doing, count(*) FILTER (o_orderstatus = 'P') AS todo FROM orders GROUP BY 1)
SELECT o_custkey, 'goal ' || o_custkey AS goal, done, doing, todo, CASE WHEN len(ids) > 2 THEN ids[-2:] ELSE ids END AS nodes FROM n""")
def canvas_meta(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as the nodes of a canvas."""
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "doing").otherwise("todo")
    node = F.concat(F.lit("00"), F.col("o_orderkey") % 10, F.lit("-N"), "o_orderkey", F.lit('["step<br/>status: '), status, F.lit("<br/>summary: order "), "o_orderkey", F.lit('"]'))
    c = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", node.alias("node")))).alias("n"))
    text = F.concat(F.lit('%%{ "taskGoal": "goal '), "o_custkey", F.lit('", "createdTime": "2024-01-01" }%%\n'), F.array_join(F.transform("n", lambda x: x["node"]), "\n"))
    m = c.select("o_custkey", P.canvas_meta(text).alias("m"))
    return m.select("o_custkey", "m.goal", F.col("m.done").cast("long").alias("done"), F.col("m.doing").cast("long").alias("doing"), F.col("m.todo").cast("long").alias("todo"), F.transform("m.nodes", lambda x: x["node_id"]).alias("nodes"))


@q("""SELECT item_id, CASE WHEN item_id % 3 = 0 THEN NULL ELSE 'area ' || (item_id % 7) END AS domain, CASE WHEN item_id % 3 = 0 THEN NULL ELSE 'keep {braces} "quoted" ' || item_id END AS lesson, CASE WHEN item_id % 3 = 0 THEN NULL WHEN item_id % 3 = 1 THEN CAST(1 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS confidence FROM benchmark""")
def distilled_lessons(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a model with prose and a fence around the object; a third lacks the domain."""
    k = F.col("item_id")
    body = F.concat(F.lit('{"domain": "'), F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit("area "), k % 7)), F.lit('", "lesson_text": "keep {braces} \\"quoted\\" '), k, F.lit('", "nested": {"a": "}"}'), F.when(k % 3 == 1, ', "confidence": 7}').otherwise(', "confidence": "high"}'))
    raw = table(spark, d, "benchmark").select("item_id", P.first_json_object(F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n``` and {more}"))).alias("json"))
    return raw.select("item_id", P.distilled(F.col("json"), "lesson").alias("x")).select("item_id", "x.domain", F.col("x.text").alias("lesson"), "x.confidence")


@q("""WITH t AS (SELECT conv_id, turn, role, text, strftime(TIMESTAMP '2024-01-01' + to_minutes(CAST(turn * 7 AS BIGINT)), '%Y-%m-%d %H:%M') AS shown FROM conversations)
SELECT conv_id, turn, md5('- [' || role || '|scene ' || (conv_id % 5) || '] ' || text || CASE WHEN turn % 3 = 0 THEN ' (active: ' || CASE WHEN turn = 0 THEN '2024-01-01' ELSE shown END || ' ~ 2024-02-01)' WHEN turn % 3 = 1 THEN ' (active: from ' || shown || ')' ELSE ' (active: until 2024-02-01)' END) AS line FROM t""")
def memory_lines(spark: SparkSession, d: str) -> DataFrame:
    """M41."""
    k = F.col("turn")
    at = F.date_format(F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01 00:00:00Z").cast("timestamp")) + k * 7 * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = R.memory_line(F.col("role"), F.concat(F.lit("scene "), F.col("conv_id") % 5), F.col("text"), F.when(k % 3 != 2, at), F.when(k % 3 != 1, "2024-02-01T00:00:00Z"), F.lit(None).cast("string"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(line).alias("line"))


TRIMMED = quoted(R.TRIMMED).replace("\n", "' || chr(10) || '")


@q(f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS a, CASE WHEN doc_id % 3 = 0 THEN '' ELSE repeat(source || ' ', CAST(doc_id % 3000 AS INTEGER)) END AS b, length({TRIMMED}) AS m FROM documents),
c AS (SELECT *, 10000 - length(b) - 2 AS room, a || chr(10) || chr(10) || b AS whole FROM t)
SELECT doc_id, md5(CASE WHEN a = '' AND b = '' THEN '' WHEN b = '' THEN CASE WHEN length(a) <= 10000 THEN a ELSE substr(a, 1, CAST(10000 - m AS BIGINT)) || {TRIMMED} END
WHEN a = '' OR (length(whole) > 10000 AND room <= 0) THEN CASE WHEN length(b) <= 10000 THEN b ELSE substr(b, 1, CAST(10000 - m AS BIGINT)) || {TRIMMED} END
WHEN length(whole) <= 10000 THEN whole ELSE CASE WHEN length(a) <= room THEN a ELSE substr(a, 1, CAST(greatest(0, room - m) AS BIGINT)) || {TRIMMED} END || chr(10) || chr(10) || b END) AS context FROM c""")
def composed_context(spark: SparkSession, d: str) -> DataFrame:
    """Documents as the stable part, repeated sources as the part that must survive."""
    dynamic = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.expr("repeat(concat(source, ' '), cast(doc_id % 3000 as int))"))
    return table(spark, d, "documents").select("doc_id", F.md5(R.composed(F.col("text"), dynamic)).alias("context"))


@q("""WITH t AS (SELECT conv_id, list('- (' || role || ') ' || substr(trim(text), 1, 240) || '   [anchor: msg ' || turn || ']' ORDER BY turn) FILTER (turn % 2 = 0 AND trim(text) <> '') AS l FROM conversations GROUP BY 1)
SELECT conv_id, md5(CASE WHEN l IS NULL THEN '' ELSE 'DOVE ERAVAMO — project ' || (conv_id % 3) || ' (2024-01-05)' || chr(10) || chr(10) || 'FILO (ricostruito dalle nostre parole reali):' || chr(10) || rtrim(array_to_string(CASE WHEN len(l) > 6 THEN l[-6:] ELSE l END, chr(10)), ' ' || chr(10)) END) AS recap FROM t""")
def session_recaps(spark: SparkSession, d: str) -> DataFrame:
    """Every second turn is anchored; no next step."""
    item = F.struct("turn", F.col("role").alias("type"), "text", F.when(F.col("turn") % 2 == 0, F.array(F.col("turn").cast("string"))).otherwise(F.array().cast("array<string>")).alias("source_message_ids"))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("thread"))
    none = F.lit(None).cast("struct<turn:bigint,type:string,text:string,source_message_ids:array<string>>")
    return c.select("conv_id", F.md5(R.recap(F.concat(F.lit("project "), F.col("conv_id") % 3), F.lit("2024-01-05T10:00:00Z"), F.col("thread"), none)).alias("recap"))


@q("""SELECT c_custkey, '<session-open-banner>' || chr(10) || 'FIRST TURN OF THIS SESSION — begin your very first reply with this exact one-line banner, then answer normally:' || chr(10) || '🧠 ' || CASE WHEN c_custkey % 4 = 0 THEN '⚠️ stale · ' ELSE '' END || 'Sul pezzo · ' || CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment || ' · ' ELSE '' END || 'ricordo chi sei' || CASE WHEN c_custkey % 5 > 0 THEN ' · ultimo: ' || c_name ELSE '' END ||
CASE WHEN c_custkey % 2 = 0 AND c_custkey % 7 > 0 THEN ' · memoria: persona ✓ · ' || (c_custkey % 7) || ' scene' WHEN c_custkey % 2 = 0 THEN ' · memoria: persona ✓' WHEN c_custkey % 7 > 0 THEN ' · memoria: ' || (c_custkey % 7) || ' scene' ELSE '' END || chr(10) || '</session-open-banner>' AS banner FROM customer""")
def session_banners(spark: SparkSession, d: str) -> DataFrame:
    """M51."""
    k = F.col("c_custkey")
    b = R.banner(F.when(k % 3 > 0, F.col("c_mktsegment")), k % 2 == 0, k % 7, F.when(k % 5 > 0, F.col("c_name")), F.when(k % 4 == 0, "stale"))
    return table(spark, d, "customer").select("c_custkey", b.alias("banner"))


@q("""WITH c AS (SELECT source, list('- ' || replace(replace(substr(trim(text), 1, 300), '<system>', '&lt;system&gt;'), '</system>', '&lt;/system&gt;') ORDER BY doc_id) AS l FROM (SELECT * FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3) GROUP BY 1)
SELECT source, md5('<cornerstone-memories>' || chr(10) || 'Distinctive peak memories — rare, isolated events that human memory resurfaces unbidden (von Restorff effect). Reference for context; these are NOT current tasks:' || chr(10) || array_to_string(l, chr(10)) || chr(10) || '</cornerstone-memories>') AS block FROM c""")
def cornerstone_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The first three documents of each source as its cornerstones."""
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    t = table(spark, d, "documents").where("text is not null").withColumn("p", first).where("p <= 3")
    g = t.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("c"))
    return g.select("source", F.md5(R.cornerstone_block(F.transform("c", lambda x: x["text"]))).alias("block"))


@q("""WITH s AS (SELECT source, count(*) AS heat, CAST(max(doc_id) AS VARCHAR) AS updated FROM documents GROUP BY 1)
SELECT string_agg('### Path: scene_blocks/' || coalesce(source, 'none') || '.md' || chr(10) || '**heat**: ' || heat || CASE WHEN heat >= 1000 THEN ' 🔥🔥🔥🔥🔥' WHEN heat >= 500 THEN ' 🔥🔥🔥🔥' WHEN heat >= 200 THEN ' 🔥🔥🔥' WHEN heat >= 100 THEN ' 🔥🔥' WHEN heat >= 50 THEN ' 🔥' ELSE '' END || ' | **updated**: ' || updated || chr(10) || 'Summary: scene of ' || coalesce(source, 'none'), chr(10) || chr(10) ORDER BY heat DESC, source) AS navigation FROM s""")
def scene_navigation(spark: SparkSession, d: str) -> DataFrame:
    """Scenes by heat."""
    s = table(spark, d, "documents").groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("heat"), F.max("doc_id").cast("string").alias("updated"))
    entry = R.scene_entry(F.concat("source", F.lit(".md")), F.col("heat"), F.col("updated"), F.concat(F.lit("scene of "), "source"))
    g = s.agg(F.array_sort(F.collect_list(F.struct((-F.col("heat")).alias("heat"), "source", entry.alias("entry")))).alias("e"))
    return g.select(F.array_join(F.transform("e", lambda x: x["entry"]), "\n\n").alias("navigation"))


@q("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_access(spark: SparkSession, d: str) -> DataFrame:
    """M48."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@q("SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x / sqrt(list_sum([y * y FOR y IN CAST(embedding AS DOUBLE[])])), 6)) AS v FROM embeddings")
def normalized_vectors(spark: SparkSession, d: str) -> DataFrame:
    """M22."""
    return table(spark, d, "embeddings").select("vec_id", F.transform(S.l2_normalized(S.doubles("embedding")), lambda x: S.rounded(x)).alias("v"))
