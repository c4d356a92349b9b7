"""Lifecycle of memories: reinforcement, decay, staleness, gates, decisions, as projections of a lifecycle table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hippospark.functions import scalar as S

DAY = 86_400


def reinforced(rows: DataFrame) -> DataFrame:
    """LC2: one more reinforcement; short memories of three and of permanence 1.5 become long."""
    rows = rows.withColumn("reinforcement_count", F.col("reinforcement_count") + 1)
    rows = rows.withColumn("permanence_score", S.permanence(F.col("reinforcement_count"), F.col("salience")))
    return rows.withColumn("tier", F.when((F.col("tier") == "short") & (F.col("reinforcement_count") >= 3) & (F.col("permanence_score") >= 1.5), "long").otherwise(F.col("tier")))


def decayed(rows: DataFrame) -> DataFrame:
    """LC4: halve; peaks of salience (0.7) lose a tenth, keep 0.25 and never go dormant."""
    peak = F.col("salience") >= 0.7
    rows = rows.withColumn("permanence_score", F.when(peak, F.greatest(F.lit(0.25), F.col("permanence_score") * 0.9)).otherwise(F.col("permanence_score") * 0.5))
    was_short = F.col("tier") == "short"
    rows = rows.withColumn("state", F.when(was_short & ~peak & (F.col("permanence_score") < 0.25), "dormant").otherwise(F.col("state")))
    return rows.withColumn("tier", F.when((F.col("tier") == "long") & (F.col("permanence_score") < 1.5), "short").otherwise(F.col("tier")))


def is_stale(now: int, last: Column, created: Column, state: Column, days: int = 14) -> Column:
    """LC5: active and not reinforced for more than `days`."""
    return (state == "active") & (F.coalesce(last, created) < now - days * DAY)


def gate_after(gate: Column, event: str) -> Column:
    """LC6: only a clear gate opens a question; a rejection stands."""
    if event == "ask":
        return F.when(gate == "clear", "pending_confirmation").otherwise(gate)
    if event == "reject":
        return F.lit("rejected")
    return F.when(gate == "rejected", "rejected").otherwise("clear")


def guarded_decision(decision: Column, targets: Column, same_type: Column, recalled: Column, similarity: Column, merged_type: Column | None = None, own_type: Column | None = None) -> Column:
    """LC13: what is no known decision stores. A merge or update falls back to storing where it has more than one target, changes the type,
    or its target is of another type, was not recalled or is not alike; without a target it stands. A memory is skipped only where a
    recalled one is a near duplicate. similarity: to the target, or for skips the largest to a recalled memory."""
    fits = (targets == 0) | ((targets == 1) & same_type & recalled & (similarity >= 0.6))
    if merged_type is not None:
        fits = fits & (merged_type.isNull() | (merged_type == own_type))
    d = F.when(decision.isin("update", "merge", "skip"), decision).otherwise("store")
    return guarded_skip(F.when(d.isin("update", "merge") & ~F.coalesce(fits, F.lit(False)), "store").otherwise(d), similarity)


def suppressed(recalled: DataFrame, lifecycle: DataFrame, key: str) -> DataFrame:
    """Without memories that were rejected."""
    return recalled.join(lifecycle.where("gate_state = 'rejected'").select(key), key, "left_anti")


def pending(lifecycle: DataFrame, limit: int = 50) -> DataFrame:
    """T17."""
    return lifecycle.where("gate_state = 'pending_confirmation'").orderBy(F.desc("updated"), "owner_id").limit(max(1, min(50, limit)))


def better_lessons(new: DataFrame, heads: DataFrame, key: str) -> DataFrame:
    """LC11: accepted where there is no head or the confidence exceeds it; the version goes on."""
    h = heads.select(key, F.col("confidence").alias("_old"), F.col("version").alias("_version"))
    j = new.join(h, key, "left").where(F.col("_old").isNull() | (F.col("confidence") > F.col("_old")))
    return j.withColumn("version", F.coalesce(F.col("_version") + 1, F.lit(1))).drop("_old", "_version")


def ensured(lifecycle: DataFrame, owners: DataFrame, now: int) -> DataFrame:
    """LC1: a lifecycle row for each owner (owner_id, owner_kind, and a salience where there is one) that has none."""
    key = ["owner_id", "owner_kind"]
    salience = F.coalesce("salience", F.lit(0.0)) if "salience" in owners.columns else F.lit(0.0)
    new = owners.dropDuplicates(key).withColumn("salience", salience).join(lifecycle.select(*key), key, "left_anti")
    fill = {"permanence_score": S.permanence(F.lit(0), F.col("salience")), "reinforcement_count": F.lit(0), "last": F.lit(None), "created": F.lit(now), "tier": F.lit("short"), "state": F.lit("active"), "gate_state": F.lit("clear"), "origin": F.lit("conversation"), "contradiction": F.lit(False), "updated": F.lit(now)}
    for name, value in fill.items():
        new = new if name in new.columns else new.withColumn(name, value)
    return lifecycle.unionByName(new.select(*[F.col(c).cast(lifecycle.schema[c].dataType).alias(c) for c in lifecycle.columns]))


def stamped(lifecycle: DataFrame, peaks: DataFrame, now: int) -> DataFrame:
    """LC3: a salience that only goes up, and the permanence that follows; owners without a row get one. peaks: owner_id, owner_kind, salience."""
    key = ["owner_id", "owner_kind"]
    p = peaks.groupBy(*key).agg(F.max("salience").alias("_peak"))
    rows = ensured(lifecycle, p.select(*key), now).join(p, key, "left")
    rows, up = rows.withColumn("_up", F.coalesce(F.col("_peak") > F.col("salience"), F.lit(False))), F.col("_up")
    rows = rows.withColumns({"salience": F.when(up, F.col("_peak")).otherwise(F.col("salience")), "updated": F.when(up, F.lit(now)).otherwise(F.col("updated"))})
    return rows.withColumn("permanence_score", F.when(up, S.permanence(F.col("reinforcement_count"), F.col("salience"))).otherwise(F.col("permanence_score"))).select(*lifecycle.columns)


def reinforced_by(lifecycle: DataFrame, owners: DataFrame, now: int) -> DataFrame:
    """LC2 for some owners, which get a row first where they have none."""
    key = ["owner_id", "owner_kind"]
    rows = ensured(lifecycle, owners, now).join(owners.select(*key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    hit = F.col("_hit").isNotNull()
    more = reinforced(rows.where(hit)).withColumns({"last": F.lit(now).cast("long"), "updated": F.lit(now).cast("long")})
    return rows.where(~hit).select(*lifecycle.columns).unionByName(more.select(*lifecycle.columns))


def gate_recalled(lifecycle: DataFrame, recalled: DataFrame) -> DataFrame:
    """LC8: recalled owners (owner_id, owner_kind, text) of high stakes that are unverified and clear become a question."""
    from hippospark.functions import parsing as P
    from hippospark.functions import text as X

    r = recalled.dropDuplicates(["owner_id", "owner_kind"]).select("owner_id", "owner_kind", X.stakes(F.col("text")).alias("_domain"))
    j = lifecycle.join(r, ["owner_id", "owner_kind"], "left")
    level = F.when(F.coalesce("_domain", F.lit("none")) == "none", "none").otherwise("high")
    ask = X.should_gate(P.trust_of(F.col("origin")), level, F.col("gate_state"))
    return j.withColumn("gate_state", F.when(ask, gate_after(F.col("gate_state"), "ask")).otherwise(F.col("gate_state"))).select(*lifecycle.columns)


def confirmed(lifecycle: DataFrame, facts: DataFrame, confirmations: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """LC7: confirmations (owner_id, owner_kind, fact_id, superseded_fact_id): the owner is trusted and its gate clear, the fact's confidence
    is 0.99, the superseded fact is closed. Facts: id, confidence, superseded_by, valid_to."""
    c = confirmations.select("owner_id", "owner_kind").distinct().withColumn("_hit", F.lit(True))
    rows = ensured(lifecycle, confirmations.select("owner_id", "owner_kind"), now).join(c, ["owner_id", "owner_kind"], "left")
    hit = F.col("_hit").isNotNull()
    rows = rows.withColumns({"gate_state": F.when(hit, "clear").otherwise(F.col("gate_state")), "origin": F.when(hit, "user_confirmed").otherwise(F.col("origin")), "updated": F.when(hit, F.lit(now)).otherwise(F.col("updated"))})
    sure = confirmations.where("fact_id is not null").select(F.col("fact_id").alias("id")).distinct().withColumn("_sure", F.lit(True))
    gone = confirmations.where("superseded_fact_id is not null").groupBy(F.col("superseded_fact_id").alias("id")).agg(F.min(F.coalesce("fact_id", "owner_id")).alias("_by"))
    f = facts.join(sure, "id", "left").join(gone, "id", "left")
    f = f.withColumns({"confidence": F.when(F.col("_sure"), 0.99).otherwise(F.col("confidence")), "superseded_by": F.coalesce("_by", "superseded_by"), "valid_to": F.when(F.col("_by").isNotNull(), F.lit(now)).otherwise(F.col("valid_to"))})
    return rows.select(*lifecycle.columns), f.select(*facts.columns)


def credited(lessons: DataFrame, events: DataFrame, session: str) -> DataFrame:
    """LC9: lessons that a session was exposed to, in their implicit phase (three avoidances): tempered where the session has a bug about
    one of their files, else credited. lessons: id, files, confidence, avoidance_count, last_session."""
    exposed = lessons.where((F.col("last_session") == session) & (F.col("avoidance_count") >= 3))
    bugs = events.where((F.col("session_key") == session) & (F.col("type") == "bug")).select(F.explode("entities").alias("file")).distinct()
    relapsed = exposed.select("id", F.explode("files").alias("file")).join(bugs, "file", "left_semi").select("id").distinct().withColumn("_relapsed", F.lit(True))
    j = exposed.join(relapsed, "id", "left").withColumn("relapsed", F.coalesce("_relapsed", F.lit(False)))
    return j.select("id", "relapsed", F.when(F.col("relapsed"), S.confidence_after(F.col("confidence"), False)).otherwise(S.confidence_after(F.col("confidence"), True)).alias("confidence"), (F.col("avoidance_count") + F.when(F.col("relapsed"), 0).otherwise(1)).alias("avoidance_count"))


def counted(lessons: DataFrame, log: DataFrame, counter: str, session: str | None = None) -> DataFrame:
    """LC12: a counter of each lesson goes up by its rows in a log (id, and the session of an exposure, of which the last is kept)."""
    last = [F.max_by(session, "at").alias("_last")] if session else []
    n = log.groupBy("id").agg(F.count("*").alias("_n"), *last)
    j = lessons.join(n, "id", "left").withColumn(counter, F.col(counter) + F.coalesce("_n", F.lit(0)))
    return (j.withColumn("last_session", F.coalesce("_last", "last_session")) if session else j).select(*lessons.columns)


def judged(lessons: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The willingness of lessons after verdicts (id, confirmed, at), one after the other."""
    seq = F.transform(F.array_sort(F.collect_list(F.struct("at", "confirmed"))), lambda x: x["confirmed"])
    v = verdicts.groupBy("id").agg(seq.alias("_v"))
    after = F.aggregate("_v", F.col("willingness"), lambda w, c: F.when(c, S.willingness_after(w, True)).otherwise(S.willingness_after(w, False)))
    return lessons.join(v, "id", "left").withColumn("willingness", F.when(F.col("_v").isNotNull(), after).otherwise(F.col("willingness"))).select(*lessons.columns)


def consolidated_owners(lifecycle: DataFrame, owners: DataFrame, now: int) -> DataFrame:
    """LC10 but for contradictions: owners (owner_id, owner_kind) are reinforced, then the stale decay."""
    rows = reinforced_by(lifecycle, owners, now)
    stale = is_stale(now, F.col("last"), F.col("created"), F.col("state"))
    return rows.where(~stale).unionByName(decayed(rows.where(stale)).select(*rows.columns))


def consolidated(lifecycle: DataFrame, events: DataFrame, facts: DataFrame, heads: DataFrame, session: str, now: int) -> DataFrame:
    """LC10: after a session: its events and the facts from them are reinforced, the stale decay, and facts that contradict others of
    their key are flagged, others cleared. facts: id, source_event_id; heads: id, entity_id, attribute, value."""
    e = events.where(F.col("session_key") == session).select("id")
    owners = e.select(F.col("id").alias("owner_id"), F.lit("event").alias("owner_kind"))
    owners = owners.unionByName(facts.join(e, facts["source_event_id"] == e["id"], "left_semi").select(F.col("id").alias("owner_id"), F.lit("fact").alias("owner_kind")).distinct())
    rows = consolidated_owners(lifecycle, owners, now)
    h = heads.withColumn("_norm", S.fact_value(F.col("value")))
    clash = h.groupBy("entity_id", "attribute").agg(F.count_distinct("_norm").alias("n")).where("n > 1")
    flagged = h.join(clash, ["entity_id", "attribute"]).select(F.col("id").alias("owner_id"), F.lit("fact").alias("owner_kind")).distinct().withColumn("_flag", F.lit(True))
    rows = ensured(rows, flagged.select("owner_id", "owner_kind"), now)
    return rows.join(flagged, ["owner_id", "owner_kind"], "left").withColumn("contradiction", F.coalesce("_flag", F.lit(False))).select(*lifecycle.columns)


def flagged_by_change(lifecycle: DataFrame, facts: DataFrame, changed: DataFrame, now: int) -> DataFrame:
    """A8, LC10 by change: facts (id, entity_id, attribute) of keys whose contradiction is known anew (entity_id, attribute, contradiction)
    are flagged or cleared. Rows that differ from the lifecycle's, and no others; what contradicts gets a row where it has none."""
    key = ["owner_id", "owner_kind"]
    wanted = facts.join(changed, ["entity_id", "attribute"]).select(F.col("id").alias("owner_id"), F.lit("fact").alias("owner_kind"), F.col("contradiction").alias("_now")).distinct()
    rows = ensured(lifecycle.join(wanted.select(*key), key, "left_semi"), wanted.where("_now").select(*key), now)
    rows = rows.join(wanted, key).where(F.col("contradiction") != F.col("_now"))
    return rows.withColumns({"contradiction": F.col("_now"), "updated": F.lit(now).cast("long")}).select(*lifecycle.columns)


def guarded_skip(decision: Column, similarity: Column, least: float = 0.6) -> Column:
    """LC13: a memory is skipped only for a near duplicate."""
    return F.when((decision == "skip") & (F.coalesce(similarity, F.lit(0.0)) < least), "store").otherwise(decision)


def applied(records: DataFrame, new: DataFrame) -> DataFrame:
    """LC14: new memories with a decision: skipped ones go, targets of updates and merges go, merged fields override; what stays is stored
    redacted. new: record_id, content, type, priority, action, target_ids, merged_content, merged_type, merged_priority."""
    from hippospark.functions import text as X

    n = new.withColumn("action", F.coalesce("action", F.lit("store")))
    change = F.col("action").isin("update", "merge")
    targets = n.where(change).select(F.explode("target_ids").alias("record_id")).distinct()
    pick = lambda c: F.when(change, F.coalesce(f"merged_{c}", c)).otherwise(F.col(c)).alias(c)
    kept = n.where("action <> 'skip'").select("record_id", X.redacted(F.when(change, F.coalesce("merged_content", "content")).otherwise(F.col("content"))).alias("content"), pick("type"), pick("priority"))
    old = records.join(targets, "record_id", "left_anti").join(kept.select("record_id"), "record_id", "left_anti")
    return old.unionByName(kept.select(*records.columns))
