"""Queries of lifecycles, stances and text hygiene."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hippospark.functions import parsing as P
from hippospark.functions import scalar as S
from hippospark.functions import text as X
from hippospark.operators import lifecycle as L

from .bindings import HAPPENINGS_SQL, epoch_s, happenings, table
from .common import Queries

q = Queries()
QUERIES, ORACLES = q.queries, q.oracles
LIFE_SQL = """life AS (SELECT user_id AS owner_id, 'event' AS owner_kind, count(*) AS reinforcement_count, round(max(value) / 200.0, 6) AS salience, CAST(floor(max(epoch(ts))) AS BIGINT) AS last, CAST(floor(min(epoch(ts))) AS BIGINT) AS created, CASE WHEN count(*) > 12 THEN 'long' ELSE 'short' END AS tier, 'active' AS state FROM events GROUP BY 1)"""


def life(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("s", epoch_s("ts"))
    g = e.groupBy(F.col("user_id").alias("owner_id")).agg(F.count("*").alias("reinforcement_count"), F.round(F.max("value") / 200.0, 6).alias("salience"), F.max("s").alias("last"), F.min("s").alias("created"))
    g = g.withColumn("permanence_score", S.permanence(F.col("reinforcement_count"), F.col("salience")))
    return g.withColumns({"tier": F.when(F.col("reinforcement_count") > 12, "long").otherwise("short"), "state": F.lit("active")})


@q(f"WITH {LIFE_SQL} SELECT owner_id, reinforcement_count + 1 AS reinforcement_count, round(0.5 * (reinforcement_count + 1) + salience, 6) AS permanence, CASE WHEN tier = 'short' AND reinforcement_count + 1 >= 3 AND 0.5 * (reinforcement_count + 1) + salience >= 1.5 THEN 'long' ELSE tier END AS tier FROM life")
def lifecycle_reinforce(spark: SparkSession, d: str) -> DataFrame:
    """LC2, M15."""
    return L.reinforced(life(spark, d)).select("owner_id", "reinforcement_count", F.round("permanence_score", 6).alias("permanence"), "tier")


@q(f"""WITH {LIFE_SQL}, p AS (SELECT *, CASE WHEN salience >= 0.7 THEN greatest(0.25, (0.5 * reinforcement_count + salience) * 0.9) ELSE (0.5 * reinforcement_count + salience) * 0.5 END AS x FROM life)
SELECT owner_id, round(x, 6) AS permanence, CASE WHEN tier = 'short' AND salience < 0.7 AND x < 0.25 THEN 'dormant' ELSE state END AS state, CASE WHEN tier = 'long' AND x < 1.5 THEN 'short' ELSE tier END AS tier FROM p""")
def lifecycle_decay(spark: SparkSession, d: str) -> DataFrame:
    """LC4."""
    return L.decayed(life(spark, d)).select("owner_id", F.round("permanence_score", 6).alias("permanence"), "state", "tier")


@q(f"WITH {LIFE_SQL}, n AS (SELECT max(last) + 13 * 86400 AS now FROM life) SELECT owner_id FROM life, n WHERE coalesce(last, created) < now - 14 * 86400")
def staleness_sweep(spark: SparkSession, d: str) -> DataFrame:
    """LC5, X17: thirteen days after the last event."""
    rows = life(spark, d)
    now = (rows.agg(F.max("last")).first()[0] or 0) + 13 * L.DAY
    return rows.where(L.is_stale(now, F.col("last"), F.col("created"), F.col("state"))).select("owner_id")


@q("SELECT p_partkey, round(greatest(0.05, least(0.99, w + 0.25 * (0.99 - w))), 6) AS confirmed, round(greatest(0.05, least(0.99, 0.65 * w)), 6) AS rejected, CASE WHEN w < 0.25 THEN 'suppressed' WHEN w < 0.45 THEN 'demoted' ELSE 'trusted' END AS tier FROM (SELECT p_partkey, p_size / 50.0 AS w FROM part)")
def stance_tiers(spark: SparkSession, d: str) -> DataFrame:
    """M17."""
    w = F.col("p_size") / 50.0
    return table(spark, d, "part").select("p_partkey", F.round(S.willingness_after(w, True), 6).alias("confirmed"), F.round(S.willingness_after(w, False), 6).alias("rejected"), S.willingness_tier(w).alias("tier"))


@q("SELECT p_partkey, round(greatest(0.1, least(0.99, c + 0.25 * (0.99 - c))), 6) AS avoided, round(greatest(0.1, least(0.99, 0.8 * c)), 6) AS recurred FROM (SELECT p_partkey, p_size / 50.0 AS c FROM part)")
def lesson_confidence(spark: SparkSession, d: str) -> DataFrame:
    """M16."""
    c = F.col("p_size") / 50.0
    return table(spark, d, "part").select("p_partkey", F.round(S.confidence_after(c, True), 6).alias("avoided"), F.round(S.confidence_after(c, False), 6).alias("recurred"))


@q("SELECT p_partkey, CASE WHEN p_size / 50.0 < 0.6 OR p_partkey % 5 < 2 OR p_partkey % 7 = 0 THEN 'silent' WHEN p_partkey % 2 = 0 AND p_partkey % 3 <> 0 THEN 'hard' ELSE 'soft' END AS severity FROM part")
def stance_severity(spark: SparkSession, d: str) -> DataFrame:
    """M18, T19."""
    k = F.col("p_partkey")
    tier = F.when(k % 7 == 0, "suppressed").when(k % 3 == 0, "demoted").otherwise("trusted")
    return table(spark, d, "part").select("p_partkey", S.severity(F.col("p_size") / 50.0, k % 5, tier, F.when(k % 2 == 0, "high").otherwise("none")).alias("severity"))


def sql_match(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '" + pattern.replace("'", "''") + "')"


SECRET_SQL = " OR ".join(sql_match("html", p) for _, p in X.SECRETS)
STAKES_SQL = "CASE " + " ".join(f"WHEN {sql_match('html', p)}{' OR ' + SECRET_SQL if name == 'credential' else ''} THEN '{name}'" for name, p in X.STAKES) + " ELSE 'none' END"


@q(f"SELECT page_id, {STAKES_SQL} AS domain FROM pages")
def stakes_classify(spark: SparkSession, d: str) -> DataFrame:
    """P15."""
    return table(spark, d, "pages").select("page_id", X.stakes(F.col("html")).alias("domain"))


@q("SELECT doc_id, CASE WHEN quality = 0 AND toxic = 0 THEN 'pending_confirmation' ELSE 'clear' END AS gate FROM labels")
def gate_pending(spark: SparkSession, d: str) -> DataFrame:
    """P17, LC6, LC8, T17."""
    t = table(spark, d, "labels")
    hot = X.should_gate(F.when(F.col("quality") == 0, "unverified").otherwise("trusted"), F.when(F.col("toxic") == 0, "high").otherwise("none"), F.lit("clear"))
    return t.select("doc_id", F.when(hot, L.gate_after(F.lit("clear"), "ask")).otherwise("clear").alias("gate"))


@q("""WITH p AS (SELECT o_orderkey, o_custkey % 4 AS targets, o_custkey % 3 <> 0 AS same, o_custkey % 5 <> 0 AS recalled, o_totalprice / 100000 AS alike, CASE WHEN o_orderkey % 7 = 0 THEN 'drop' WHEN o_orderkey % 11 = 0 THEN 'skip' WHEN o_orderstatus = 'F' THEN 'merge' WHEN o_orderstatus = 'P' THEN 'update' WHEN o_orderkey % 3 = 0 THEN 'skip' END AS d, CASE WHEN o_orderkey % 13 = 0 THEN 'persona' END AS merged FROM orders)
SELECT o_orderkey, CASE WHEN d = 'skip' AND alike >= 0.6 THEN 'skip' WHEN d IN ('merge', 'update') AND merged IS NULL AND (targets = 0 OR targets = 1 AND same AND recalled AND alike >= 0.6) THEN d ELSE 'store' END AS decision FROM p""")
def dedup_decision_guards(spark: SparkSession, d: str) -> DataFrame:
    """LC13, LC14: proposals with up to three targets, skips, unknown and missing ones, some that change the type."""
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    proposal = F.when(key % 7 == 0, "drop").when(key % 11 == 0, "skip").when(F.col("o_orderstatus") == "F", "merge").when(F.col("o_orderstatus") == "P", "update").when(key % 3 == 0, "skip")
    guarded = L.guarded_decision(proposal, F.col("o_custkey") % 4, F.col("o_custkey") % 3 != 0, F.col("o_custkey") % 5 != 0, F.col("o_totalprice") / 100_000, F.when(key % 13 == 0, "persona"), F.lit("episodic"))
    return o.select("o_orderkey", guarded.alias("decision"))


@q("WITH h AS (SELECT p_brand, max(p_size) AS confidence, count(*) AS version FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), n AS (SELECT p_brand, max(p_size) AS confidence FROM part WHERE p_partkey % 2 = 1 GROUP BY 1) SELECT n.p_brand, n.confidence, coalesce(h.version + 1, 1) AS version FROM n LEFT JOIN h USING (p_brand) WHERE h.confidence IS NULL OR n.confidence > h.confidence")
def lesson_accept(spark: SparkSession, d: str) -> DataFrame:
    """LC11, T15."""
    p = table(spark, d, "part")
    h = p.where("p_partkey % 2 = 0").groupBy("p_brand").agg(F.max("p_size").alias("confidence"), F.count("*").alias("version"))
    n = p.where("p_partkey % 2 = 1").groupBy("p_brand").agg(F.max("p_size").alias("confidence"))
    return L.better_lessons(n, h, "p_brand").select("p_brand", "confidence", "version")


@q("WITH c AS (SELECT doc_id, text, CASE WHEN length(text) <= 2000 THEN 1 ELSE least(50, CAST(ceil((length(text) - 200) / 1800.0) AS INTEGER)) END AS n FROM documents WHERE trim(text) <> ''), i AS (SELECT doc_id, text, unnest(range(0, n)) AS ix FROM c) SELECT doc_id, CAST(ix AS INTEGER) AS ix, md5(substr(text, ix * 1800 + 1, 2000)) AS md5 FROM i")
def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    """M20."""
    t = table(spark, d, "documents").select("doc_id", F.explode(S.chunks(F.col("text"))).alias("c"))
    return t.select("doc_id", "c.ix", F.md5("c.chunk").alias("md5"))


@q("WITH c AS (SELECT doc_id, text, CASE WHEN length(text) <= 300 THEN 1 ELSE least(4, CAST(ceil((length(text) - 299) / 1.0) AS INTEGER)) END AS n FROM documents WHERE trim(text) <> ''), i AS (SELECT doc_id, text, unnest(range(0, n)) AS ix FROM c) SELECT doc_id, CAST(ix AS INTEGER) AS ix, md5(substr(text, ix + 1, 300)) AS md5 FROM i")
def chunk_settings(spark: SparkSession, d: str) -> DataFrame:
    """Settings that do not fit: a broken size, an overlap over the size, a number that is no whole one."""
    o = P.chunk_options(300.9, 10_000, 4.7)
    t = table(spark, d, "documents").select("doc_id", F.explode(S.chunks(F.col("text"), *o)).alias("c"))
    return t.select("doc_id", "c.ix", F.md5("c.chunk").alias("md5"))


@q(f"WITH {HAPPENINGS_SQL} SELECT event_id, type = 'decision' AND event_id % 10 / 10.0 >= 0.7 AND event_id % 4 <> 0 AS vision FROM hp")
def vision_stakes(spark: SparkSession, d: str) -> DataFrame:
    """Decisions that are distinctive and of no operative stakes; numbers stand for the scores."""
    k = F.col("event_id")
    operative = F.when(k % 4 == 0, "prod").otherwise("none")
    return happenings(spark, d).select("event_id", X.vision(F.col("type"), k % 10 / 10.0, operative).alias("vision"))


ERR = "regexp_extract_all(x, '%s'%s)"
ERRORS_SQL = "list_sort(list_distinct(list_concat(" + ", ".join((
    ERR % (r"\b([A-Z][a-z]+[A-Za-z]*(?:Error|Exception))\b", ", 1"), ERR % (r"\bERR_[A-Z0-9_]+\b", ""), ERR % (r"\bE[A-Z]{2,}\b", ""), "['HTTP_' || h FOR h IN " + ERR % (r"\b(?:HTTP[/ ]?)?([45]\d{2})\b", ", 1") + "]",
    "['\"' || trim(h) || '\"' FOR h IN list_concat(" + ERR % ('"([^"]{1,60})"', ", 1") + ", " + ERR % ("''([^'']{1,60})''", ", 1") + ") IF regexp_matches(trim(h), '(?i)error|fail|refused|denied|timeout|not found')]",
)) + ")))"


@q(f"WITH t AS (SELECT doc_id, text || ' raised TypeError ' || doc_id || ' \"disk failure\" then ERR_MODULE_' || (doc_id % 3) || ' and ENOENT' AS x FROM documents WHERE text IS NOT NULL) SELECT doc_id, {ERRORS_SQL} AS signatures FROM t")
def error_signatures(spark: SparkSession, d: str) -> DataFrame:
    """P20 of every document, each with some errors after its text."""
    x = F.concat("text", F.lit(" raised TypeError "), "doc_id", F.lit(' "disk failure" then ERR_MODULE_'), F.col("doc_id") % 3, F.lit(" and ENOENT"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.error_signatures(x).alias("signatures"))


@q("SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '\\S') AND NOT starts_with(text, '/')")
def l0_capture_filter(spark: SparkSession, d: str) -> DataFrame:
    """P3, P6."""
    return table(spark, d, "conversations").where(X.capturable(F.col("text"))).select("conv_id", "turn")


@q("SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN s = '' THEN 'law' ELSE s END AS slug FROM (SELECT doc_id, text, regexp_replace(substr(regexp_replace(regexp_replace(lower(nfc_normalize(text)), '[^\\p{L}\\p{N}]+', '_', 'g'), '^_|_$', '', 'g'), 1, 48), '_$', '') AS s FROM documents)")
def rule_slug(spark: SparkSession, d: str) -> DataFrame:
    """Of whole texts. The twin has the canonical form only, which is all that these texts need; fixtures have the other."""
    return table(spark, d, "documents").select("doc_id", S.rule_slug(F.col("text")).alias("slug"))


@q("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM conversations), a AS (SELECT w, unnest([w || 'Size', 'char_' || w, 'Action phase', w]) AS x FROM w),
s AS (SELECT w, x, regexp_replace(regexp_replace(lower(regexp_replace(x, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS attribute FROM a)
SELECT w, x, attribute, regexp_matches(attribute, '_(count|phase|size|index|offset)$|^(line|char|byte|token)_|^action_phase$|^rowid$') AS noise FROM s""")
def snake_attributes(spark: SparkSession, d: str) -> DataFrame:
    """M26, P13 on the words of the conversations."""
    w = table(spark, d, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).distinct()
    w = w.select("w", F.explode(F.array(F.concat("w", F.lit("Size")), F.concat(F.lit("char_"), "w"), F.lit("Action phase"), "w")).alias("x"))
    return w.withColumn("attribute", S.snake_attribute(F.col("x"))).withColumn("noise", X.noise_attribute(F.col("attribute")))


def sql_replace(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, '" + pattern.replace("'", "''") + f"', '{by}', 'g')"


def chained(x: str, patterns) -> str:
    for pattern, by in patterns:
        x = sql_replace(x, pattern, by)
    return x


SQUEEZED = ((r"\n{3,}", "\n\n"), (r"^\s+|\s+$", ""))
UNSAFE = r"[\x{fffd}\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}-\x{9f}\x{200b}-\x{200f}\x{2028}-\x{202f}\x{2060}\x{feff}]"
SANITIZED = chained(
    "text",
    (
        (UNSAFE, ""), (r"```[^\n]*\n[\s\S]*?```", ""), *SQUEEZED, *((p, "") for p in X.INJECTED), *SQUEEZED, *((p, f"[REDACTED:{kind}]") for kind, p in X.SECRETS),
        ("(?i)<(/?(?:" + "|".join(X.TAGS) + "))>", r"&lt;\1&gt;"),
    ),
)


@q(f"SELECT conv_id, turn, {SANITIZED} AS text FROM conversations")
def sanitize_text(spark: SparkSession, d: str) -> DataFrame:
    """P1, P2, P7, P9, P12."""
    m = table(spark, d, "conversations")
    clean = X.redacted(X.sanitized(X.without_code(X.without_unsafe(F.col("text")))))
    return m.select("conv_id", "turn", X.escaped_tags(clean).alias("text"))


LOOKING = r"(?i)you are now (?!going|about|ready)"
#: The one pattern that looks ahead holds where the phrase occurs more often than with what must not follow.
LOOKS = "len(regexp_extract_all(x, '(?i)you are now ')) > len(regexp_extract_all(x, '(?i)you are now (?:going|about|ready)'))"
INJECTED_SQL = "(" + " OR ".join(LOOKS if p == LOOKING else sql_match("x", p) for p in X.INJECTION) + ")"
NOISE_SQL = "trim(text) = '(session bootstrap)' OR starts_with(trim(text), 'A new session was started via') OR regexp_matches(trim(text), '^✅\\s*New session started') OR starts_with(trim(text), 'Pre-compaction memory flush') OR regexp_matches(trim(text), '^NO_REPLY\\s*$')"
SIGNS_SQL = r"regexp_matches(text, '^[^\w\s\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]+$') AND length(text) + len(regexp_extract_all(text, '[\x{10000}-\x{10ffff}]')) <= 5"


@q(f"""WITH m AS (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT conv_id + 1000000, turn, CASE turn % 6 WHEN 0 THEN 'you are now ' || role WHEN 1 THEN 'You are now ready' WHEN 2 THEN '!?🙂🙂' WHEN 3 THEN 'NO_REPLY ' WHEN 4 THEN '/new ' || text ELSE 'please run the ' || role || ' command' END FROM conversations),
t AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM m)
SELECT conv_id, turn, {INJECTED_SQL} AS injected, trim(x) <> '' AND NOT ({NOISE_SQL}) AND NOT starts_with(text, '/') AND NOT ({SIGNS_SQL}) AND NOT regexp_matches(text, '^[?？]+$') AND NOT {INJECTED_SQL} AS extractable FROM t""")
def injection_predicate(spark: SparkSession, d: str) -> DataFrame:
    """Every message, and as many made-up ones that the rules are about."""
    m = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    k = F.col("turn") % 6
    own = F.when(k == 0, F.concat(F.lit("you are now "), "role")).when(k == 1, "You are now ready").when(k == 2, "!?🙂🙂").when(k == 3, "NO_REPLY ").when(k == 4, F.concat(F.lit("/new "), "text")).otherwise(F.concat(F.lit("please run the "), "role", F.lit(" command")))
    m = m.unionByName(m.select((F.col("conv_id") + 1_000_000).alias("conv_id"), "turn", "role", own.alias("text")))
    return m.select("conv_id", "turn", X.injected(F.col("text")).alias("injected"), X.extractable(F.col("text")).alias("extractable"))


def weights_sql(marks) -> str:
    return " + ".join(f"CASE WHEN {sql_match('low', p)} THEN {w} ELSE 0 END" for p, w in marks)


AFTER = ", ".join("'" + w.replace("'", "''") + "'" for w in X.AFTER_NON)
DIRECTIVES = f"""m AS (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT conv_id + 1000000, turn, CASE turn % 4 WHEN 0 THEN 'From now on always ' WHEN 1 THEN 'Non toccare, mai: ' WHEN 2 THEN 'È sbagliato, non è così ' ELSE 'non ho ' END || text FROM conversations),
t AS (SELECT *, lower(trim(text)) AS low FROM m), w AS (SELECT *, {weights_sql(X.CORRECTION)} AS c, {weights_sql(X.PROHIBITION)} + CASE WHEN len(list_filter(regexp_extract_all(low, '\\bnon\\s+([a-zàèéìòù'']+)', 1), lambda x: x NOT IN ({AFTER}))) > 0 THEN 0.4 ELSE 0 END AS p, {weights_sql(X.PRESCRIPTION)} AS s FROM t),
dir AS (SELECT conv_id, turn, text, CASE WHEN c > 0 THEN 'correction' WHEN p > 0 THEN 'prohibition' WHEN s > 0 THEN 'prescription' END AS kind, CASE WHEN c > 0 OR p > 0 OR s > 0 THEN CAST(least(1.0, c + p + s) AS DOUBLE) END AS strength FROM w)"""


def directed(spark: SparkSession, d: str) -> DataFrame:
    """Every message, and as many with a directive before it."""
    m = table(spark, d, "conversations").select("conv_id", "turn", "text")
    k = F.col("turn") % 4
    own = F.concat(F.when(k == 0, "From now on always ").when(k == 1, "Non toccare, mai: ").when(k == 2, "È sbagliato, non è così ").otherwise("non ho "), "text")
    return m.unionByName(m.select((F.col("conv_id") + 1_000_000).alias("conv_id"), "turn", own.alias("text"))).withColumn("d", X.directive(F.col("text")))


@q(f"WITH {DIRECTIVES} SELECT conv_id, turn, kind, round(strength, 6) AS strength FROM dir")
def directive_detection(spark: SparkSession, d: str) -> DataFrame:
    """P18."""
    return directed(spark, d).select("conv_id", "turn", "d.kind", F.round("d.strength", 6).alias("strength"))
