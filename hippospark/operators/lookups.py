"""Reads of sessions, files, lessons and situations: scans, joins of candidates, top-k per owner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hippospark.functions import scalar as S
from hippospark.functions.storage import saved
from hippospark.operators.knowledge import lookup

# How many items a block may show, and the weight of each kind of seed.
MAX_FACTS, MAX_EVENTS, MAX_LESSONS, MAX_OWNERS = 5, 4, 2, 3
SEED_WEIGHTS = {"recap": 1.0, "fingerprint": 0.7, "recent-file": 0.4}
RECENT_EVENTS, RECENT_FINGERPRINTS, MAX_SEEDS = 30, 5, 24
THREAD_TYPES = ("decision", "task", "result", "bug", "fix", "config_change")
NEXT_STEP_TYPES = ("task", "decision")
RECAP = "session_recap"


def filtered_scan(rows: DataFrame, session_key: str | None = None, session_id: str | None = None, updated_after: str | None = None) -> DataFrame:
    """One session (its id wins over its key), strictly later than a time, oldest first."""
    if session_id is not None:
        rows = rows.where(F.col("session_id") == session_id)
    elif session_key is not None:
        rows = rows.where(F.col("session_key") == session_key)
    if updated_after is not None:
        rows = rows.where(F.col("updated_time") > updated_after)
    return rows.orderBy("updated_time", "record_id")


def newest_first(rows: DataFrame, session: str, at: str, key: str, session_key: object | None = None, after: object | None = None, limit: int = 200, most: int = 5000) -> DataFrame:
    """The newest rows, of one session and past a cursor where these are given."""
    rows = rows if session_key is None else rows.where(F.col(session) == session_key)
    rows = rows if after is None else rows.where(F.col(at) > after)
    return rows.orderBy(F.desc(at), F.desc(key)).limit(max(1, min(most, limit)))


def session_events(events: DataFrame, session_key: str) -> DataFrame:
    """S19."""
    return events.where(F.col("session_key") == session_key).orderBy("ts_us", "id")


def entity_listing(entities: DataFrame, types: tuple[str, ...] | None = None, limit: int = 500) -> DataFrame:
    """Entities that are not merged away, the most important first."""
    rows = entities.where("merged_into is null")
    rows = rows if types is None else rows.where(F.col("type").isin(*types))
    return rows.orderBy(F.desc("importance"), F.desc("updated_time"), "id").limit(limit)


def page(rows: DataFrame, order: list[Column], offset: int, limit: int, where: Column | None = None) -> DataFrame:
    """S17."""
    rows = rows if where is None else rows.where(where)
    return rows.orderBy(*order).offset(offset).limit(limit)


def valid_vectors(rows: DataFrame, vec: str, dim: int) -> DataFrame:
    """Vectors of the right length, all of whose components are finite numbers."""
    fine = F.forall(S.doubles(vec), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col(vec).isNotNull() & (F.size(vec) == dim) & fine)


def first_chunks(vectors: DataFrame, owners: DataFrame, key: str = "owner_id") -> DataFrame:
    """Owners with the vector of their first chunk; those without one go."""
    return owners.join(vectors.where("chunk_ix = 0").select(key, "embedding"), key)


def reconciliation_load(entities: DataFrame, heads: DataFrame, vectors: DataFrame) -> DataFrame:
    """Live entities with the number of their head facts and the mean of these facts' vectors (id of fact, embedding)."""
    from hippospark.operators.clusters import mean_vectors

    counts = heads.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("n_facts"))
    means = mean_vectors(heads.select(F.col("entity_id").alias("entity"), "id").join(vectors, "id"), "entity", "embedding").withColumnRenamed("entity", "id")
    return entities.where("merged_into is null").join(counts, "id", "left").join(means, "id", "left").withColumn("n_facts", F.coalesce("n_facts", F.lit(0)))


def principles(spark: SparkSession, *paths: str) -> str:
    """The principles of all files that are there, in their order."""
    found = []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            found.append((spark.read.text(path, wholetext=True).first() or [""])[0].strip())
    return "\n\n".join(x for x in found if x)


def with_meta(hits: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Hits that have a record; orphans go."""
    return hits.join(rows, key)


def head_texts(heads: DataFrame, entities: DataFrame) -> DataFrame:
    """Head facts as text; an entity that is not there goes by its id."""
    names = entities.select(F.col("id").alias("entity_id"), "name")
    j = heads.join(names, "entity_id", "left")
    return j.select(*heads.columns, F.concat(F.coalesce("name", "entity_id"), F.lit(" — "), "attribute", F.lit(": "), "value").alias("text"))


def facts_like(heads: DataFrame, entities: DataFrame, pattern: str, limit: int = 15) -> DataFrame:
    """Head facts of entities whose name, or whose own value, is like a pattern, newest first."""
    j = heads.join(entities.select(F.col("id").alias("entity_id"), "name"), "entity_id")
    return j.where(F.ilike("name", F.lit(pattern)) | F.ilike("value", F.lit(pattern))).orderBy(F.desc("valid_from"), "id").limit(limit)


def entity_head_candidates(matches: DataFrame, heads: DataFrame, limit: int) -> DataFrame:
    """Head facts of matched entities (entity_id, place), one ranking on through all of them, cut at the limit."""
    j = matches.join(heads, "entity_id").orderBy("place", "attribute", "id").limit(limit)
    return j.withColumn("rank", F.row_number().over(Window.orderBy("place", "attribute", "id")) - 1)


def events_of_entities(events: DataFrame, ids: DataFrame, most: int | None = None) -> DataFrame:
    """Events that name an entity (entity_id), newest first, at most so many each."""
    e = events.withColumn("entity_id", F.explode(F.array_distinct("entities"))).join(ids.select("entity_id").distinct(), "entity_id")
    if most is None:
        return e
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("ts_us"), F.desc("id")))
    return e.withColumn("place", place).where(F.col("place") <= most)


def lessons_by_file(lessons: DataFrame, files: DataFrame, limit: int = 3) -> DataFrame:
    """Of each file (file) the head lessons whose trigger holds it, by confidence, evidence and version."""
    t = lessons.where("superseded_by is null").withColumn("file", F.explode(F.array_distinct("files"))).join(files.select("file").distinct(), "file")
    place = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("confidence"), F.desc("evidence_count"), F.desc("version"), "id"))
    return t.withColumn("place", place).where(F.col("place") <= limit)


def head_lessons(lessons: DataFrame, *key: str) -> DataFrame:
    """Of each domain and trigger the head lesson of the highest version."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("version"), "id"))
    return lessons.where("superseded_by is null").withColumn("place", place).where("place = 1").drop("place")


def stances(lessons: DataFrame, group: str) -> DataFrame:
    """Lessons with a severity: of each group the hard one of the highest confidence (the first on ties) stays hard, other hard
    ones and soft ones are notes, by confidence; silent ones go."""
    w = Window.partitionBy(group).orderBy(F.desc(F.col("severity") == "hard"), F.desc("confidence"), "seq")
    rows = lessons.where("severity <> 'silent'").withColumn("_first", F.row_number().over(w))
    rows = rows.withColumn("surface", F.when((F.col("severity") == "hard") & (F.col("_first") == 1), "hard").otherwise("soft"))
    place = F.row_number().over(Window.partitionBy(group, "surface").orderBy(F.desc("confidence"), "seq"))
    return rows.withColumn("place", place).drop("_first")


def session_projects(rows: DataFrame, projects: DataFrame, key: str = "session_key") -> DataFrame:
    """Rows with the project of their session, empty where none is known."""
    return rows.join(projects.select(key, F.col("project").alias("_project")), key, "left").withColumn("project", F.coalesce("_project", F.lit(""))).drop("_project")


def linked_pairs(pairs: DataFrame, members: DataFrame, relations: DataFrame, kinds: tuple[str, ...] = ("caused", "fixed-by")) -> DataFrame:
    """Pairs (a, b) with linked: whether any entity of a (id, entities) is related by one of these kinds, either way, to one of b."""
    m = members.select("id", F.explode("entities").alias("e"))
    r = relations.where(F.col("type").isin(*kinds)).select("src", "dst")
    both = r.unionByName(r.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    near = m.join(both, F.col("e") == F.col("src")).select(F.col("id").alias("a"), "dst").join(m.select(F.col("id").alias("b"), F.col("e").alias("dst")), "dst").select("a", "b").distinct()
    return pairs.join(near.withColumn("linked", F.lit(True)), ["a", "b"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))


def pending_texts(lifecycle: DataFrame, events: DataFrame, heads: DataFrame) -> DataFrame:
    """What each pending owner says, whatever its kind; owners without a text go."""
    texts = events.select(F.col("id").alias("owner_id"), F.lit("event").alias("owner_kind"), "text").unionByName(heads.select(F.col("id").alias("owner_id"), F.lit("fact").alias("owner_kind"), F.concat("attribute", F.lit(": "), "value").alias("text")))
    return lifecycle.where("gate_state = 'pending_confirmation'").join(texts, ["owner_id", "owner_kind"]).where("trim(text) <> ''")


def uncovered(clusters: DataFrame, ids: str, evidence: DataFrame, key: str) -> DataFrame:
    """Clusters none of whose ids is evidence of a lesson (evidence: id)."""
    hit = clusters.select(key, F.explode(ids).alias("id")).join(evidence.select("id").distinct(), "id").select(key).distinct()
    return clusters.join(hit, key, "left_anti")


def uncovered_by_markers(clusters: DataFrame, ids: str, usages: DataFrame, key: str) -> DataFrame:
    """As J17, the evidence being markers usage-src:<id> among the entities of usage events."""
    seen = usages.select(F.explode("entities").alias("m")).where(F.col("m").startswith("usage-src:")).select(F.expr("substring(m, 11)").alias("id"))
    return uncovered(clusters, ids, seen, key)


def without_principle(clusters: DataFrame, entity: str, principle_events: DataFrame) -> DataFrame:
    """Clusters whose domain entity has no principle yet."""
    return clusters.join(principle_events.where("type = 'principle'").select(F.explode("entities").alias(entity)).distinct(), entity, "left_anti")


def file_keys(paths: Column) -> Column:
    """Candidate keys of a path in order of preference: the whole of it, then its last part."""
    full = S.canonical_key(F.lit("file"), paths)
    last = F.concat(F.lit("file:"), F.regexp_extract(full, r"([^/:]+)$", 1))
    return F.array_distinct(F.array(full, last))


def file_entities(touched: DataFrame, entities: DataFrame) -> DataFrame:
    """Path to its file's entity, merges followed, by the first candidate key that is known."""
    k = touched.withColumn("_keys", file_keys(F.col("path"))).select("path", F.posexplode("_keys").alias("pref", "canonical_key"))
    hit = entities.where("type = 'file'").select(F.col("id").alias("asked"), "canonical_key").join(k, "canonical_key")
    best = hit.groupBy("path").agg(F.min_by("asked", "pref").alias("asked"))
    roots = lookup(entities, best.select(F.col("asked").alias("id"))).select("asked", F.col("id").alias("entity_id"), "name")
    return best.join(roots, "asked").select("path", "entity_id", "name")


def file_memory(touched: DataFrame, entities: DataFrame, heads: DataFrame, events: DataFrame, lessons: DataFrame) -> DataFrame:
    """What memory holds about touched files (path, stakes): at most five head facts, four events and two lessons each, lessons first.

    Suppressed lessons (willingness below 0.25) are silent; where the action is of high stakes, one well-attested lesson
    is hard. Rows: path, kind, place, text, severity; files that nothing is known of have none.
    """
    f = file_entities(touched, entities)
    facts = heads.join(f, "entity_id").withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy("attribute", "id"))).where(F.col("place") <= MAX_FACTS)
    happened = events_of_entities(events, f.select("entity_id"), MAX_EVENTS).join(f.select("path", "entity_id"), "entity_id")
    taught = lessons_by_file(lessons, f.select(F.col("entity_id").alias("file")), MAX_LESSONS).withColumnRenamed("file", "entity_id").join(f.select("path", "entity_id"), "entity_id").join(touched.select("path", "stakes").distinct(), "path")
    tier = S.willingness_tier(F.col("willingness"))
    taught = taught.where(F.coalesce(tier, F.lit("trusted")) != "suppressed").withColumn("severity", S.severity(F.col("confidence"), F.col("evidence_count"), F.when(F.col("willingness").isNotNull(), tier), F.col("stakes"))).withColumn("seq", F.col("place"))
    hard = stances(taught, "path").where("surface = 'hard'").select("path", "id", F.lit("hard").alias("surface"))
    taught = taught.join(hard, ["path", "id"], "left").withColumn("surface", F.coalesce("surface", F.lit("soft")))
    none = F.lit(None).cast("string").alias("severity")
    out = taught.select("path", F.lit("lesson").alias("kind"), "place", F.col("lesson_text").alias("text"), F.col("surface").alias("severity"))
    out = out.unionByName(facts.select("path", F.lit("fact").alias("kind"), "place", F.concat("attribute", F.lit(": "), "value").alias("text"), none))
    return out.unionByName(happened.select("path", F.lit("event").alias("kind"), "place", F.concat(F.lit("("), "type", F.lit(") "), "text").alias("text"), none))


#: Files of a fingerprint beyond which its sets of files are not enumerated; such ones meet all that share something.
MOST_FILES = 16
#: In how many files two may differ, round by round (None: any); most sessions are settled in the first two.
ROUNDS = (0, 2, 3, 4, 6, None)
#: Scores are rounded at the sixth digit; bounds on them give way by so much.
SLACK = 2e-6


def _without(files: Column, most: Column) -> Column:
    """The set of all files, and all sets that lack up to `most` of them: key (of 64 bits) and lacks, how many."""
    hashes = F.transform(files, lambda f: F.xxhash64(f))
    whole = F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(h))
    start = F.array(F.struct(whole.alias("key"), F.lit(0).alias("lacks")))
    less = lambda x, h: F.struct(x["key"].bitwiseXOR(h).alias("key"), (x["lacks"] + 1).alias("lacks"))
    return F.aggregate(hashes, start, lambda acc, h: F.concat(acc, F.transform(F.filter(acc, lambda x: x["lacks"] < most), lambda x: less(x, h))))


def _sharing(c: DataFrame, s: DataFrame) -> DataFrame:
    """session, fingerprint_id, score of all pairs that share a file or an error, or their task."""
    sig = F.concat(F.transform("files", lambda f: F.concat(F.lit("f"), f)), F.transform("errors", lambda e: F.concat(F.lit("e"), e)), F.when(F.col("task") != "", F.array(F.concat(F.lit("t"), "task"))).otherwise(F.array().cast("array<string>")))
    near = c.select("session", F.explode(sig).alias("k")).join(s.select("fingerprint_id", F.explode(sig).alias("k")), "k").select("session", "fingerprint_id").distinct()
    return _scored(near, c, s).select("session", "fingerprint_id", "score")


def _scored(pairs: DataFrame, c: DataFrame, s: DataFrame) -> DataFrame:
    j = pairs.join(c.select("session", F.struct("files", "errors", "task").alias("c")), "session").join(s.select("fingerprint_id", F.struct(*s.drop("fingerprint_id").columns).alias("s")), "fingerprint_id")
    return j.withColumn("score", F.round(S.fingerprint_score((F.col("c.files"), F.col("s.files")), (F.col("c.errors"), F.col("s.errors")), (F.col("c.task"), F.col("s.task"))), 6))


def _first(scored: DataFrame) -> DataFrame:
    """Per session the highest score and the first fingerprint that has it."""
    g = scored.where("score > 0").groupBy("session", "score").agg(F.min("fingerprint_id").alias("fingerprint_id"))
    return g.groupBy("session").agg(F.max("score").alias("score"), F.max_by("fingerprint_id", "score").alias("fingerprint_id"))


def _asked(c: DataFrame, before: int, most: int | None) -> DataFrame:
    """session, context, n and the sets (key, k files) that a stored one of sn files has to hold to differ from the session in more than
    `before` files and at most `most`, as far as it could reach the session's best score so far."""
    n, k, lacks, like = F.col("n"), F.col("k"), F.col("lacks"), F.col("like")
    # two of which the files are alike by x score 0.4 + 0.6 x at most
    c = c.select("session", "context", "files", F.size("files").alias("n"), F.greatest(F.lit(0.0), (F.col("score") - SLACK - 0.4) / 0.6).alias("like"))
    fewest = F.floor(n * (1 - like)).cast("int")
    sets = c.select("session", "context", "n", "like", F.explode(_without(F.col("files"), fewest if most is None else F.least(fewest, F.lit(most)))).alias("x"))
    sets = sets.select("session", "context", "n", "like", "x.key", "x.lacks", (n - F.col("x.lacks")).alias("k"))
    more = F.least(MOST_FILES - k, F.when(like > 0, F.floor(k / F.when(like > 0, like) - n).cast("int")).otherwise(MOST_FILES), *([] if most is None else [most - lacks]))
    sets = sets.withColumns({"least": F.greatest(F.lit(0), before + 1 - lacks), "more": more}).where("more >= least")
    return sets.select("session", "context", "n", "key", "k", F.explode(F.sequence("least", "more")).alias("more")).select("session", "context", "n", "key", "k", (k + F.col("more")).alias("sn"))


def _by_shared_files(c: DataFrame, s: DataFrame, contexts: DataFrame, before: int, most: int | None) -> DataFrame:
    """session, fingerprint_id, score: for each session (with its best score so far) the first of the best of all that differ from it in
    more than `before` files and at most `most`, and could be as good.

    What two share is one of the sets of files of both. So stored ones are reduced to the first for each set, number of files and context,
    and no pair is made; a larger set that is shared counts more, so the highest score is the right one.
    """
    asked = saved(_asked(c, before, most).withColumn("key", F.xxhash64("key", "k", "sn")), "keys")
    # a row for each number of files that a fingerprint may have
    wanted = asked.groupBy("sn").agg(F.collect_set(F.col("sn") - F.col("k")).alias("wanted"))
    parts = F.filter(_without(F.col("files"), F.array_max("wanted")), lambda x: F.array_contains("wanted", x["lacks"]))
    sets = s.withColumn("sn", F.size("files")).join(F.broadcast(wanted), "sn").select("fingerprint_id", F.col("context").alias("other"), "sn", F.explode(parts).alias("x"))
    sets = sets.select("fingerprint_id", "other", F.xxhash64("x.key", F.col("sn") - F.col("x.lacks"), "sn").alias("key"))
    # few sets are asked for among many: a hash table of the former spares sorting the latter
    kinds = sets.join(asked.select("key").hint("shuffle_hash"), "key", "left_semi").groupBy("key", "other").agg(F.min("fingerprint_id").alias("fingerprint_id"))
    ours, theirs = contexts.toDF("context", "ce", "ct"), contexts.withColumnRenamed("context", "other")
    score = F.round(S.fingerprint_score_of_counts((F.col("n"), F.col("sn"), F.col("k")), (F.col("ce"), F.col("errors")), (F.col("ct"), F.col("task"))), 6)
    return _first(asked.join(kinds, "key").join(ours, "context").join(theirs, "other").select("session", "fingerprint_id", score.alias("score")))


def best_situations(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Session, fingerprint_id, score, owner_ids: per current fingerprint the stored one that is most like it, the first on ties.

    Equal fingerprints are looked for once and found once. Each finds those of the same files, then those that differ in few, then as many
    as could still be as good as the best so far. The pairs found are scored again on what they hold: where two sets had one key, which
    only raises a score, the session looks at all pairs.
    """
    # in one order, so that equal sets are one
    what = {**{x: F.array_sort(F.array_distinct(x)) for x in ("files", "errors")}, "task": F.coalesce("task", F.lit(""))}
    c = saved(current.withColumns(what).select("session", *what), "situations")
    s = saved(stored.withColumns(what).select("fingerprint_id", *what, "owner_ids"), "fingerprints")
    both = c.select("errors", "task").unionByName(s.select("errors", "task")).distinct()
    contexts = saved(both.select(F.monotonically_increasing_id().alias("context"), "errors", "task"), "contexts")
    placed = c.join(contexts, ["errors", "task"]).select("session", "files", "context")
    asking = saved(placed.groupBy("files", "context").agg(F.min("session").alias("session")), "situations")
    kinds = saved(s.join(contexts, ["errors", "task"]).groupBy("files", "context").agg(F.min("fingerprint_id").alias("fingerprint_id")), "fingerprints")
    small, n = F.size("files") <= MOST_FILES, F.size("files")
    rest, parts, before = asking.where(small).withColumn("score", F.lit(0.0)), [], -1
    for most in ROUNDS:
        got = saved(_by_shared_files(rest, kinds.where(small), contexts, before, most), "matches")
        parts.append(got)
        if most is not None:
            # whoever differs in more files holds all of the session's and as many others at best
            best = F.greatest("score", F.coalesce("_score", F.lit(0.0)))
            rest = rest.join(got.select("session", F.col("score").alias("_score")), "session", "left").withColumn("score", best).drop("_score")
            rest = saved(rest.where(F.col("score") <= 0.4 + 0.6 * n / (n + most + 1) + SLACK), "situations")
            before = most
            if rest.isEmpty():
                break
    for x, y in ((asking.where(~small), kinds), (asking.where(small), kinds.where(~small))):
        if not (x.isEmpty() or y.isEmpty()):
            parts.append(_sharing(x.join(contexts, "context"), y.join(contexts, "context")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p.select(*every.columns))
    found = _scored(_first(every).withColumnRenamed("score", "_score"), c, s)
    found = saved(found.select("session", "fingerprint_id", "score", "s.owner_ids", "_score"), "matches")
    wrong = found.where("score <> _score").select("session")
    found_well = found.where("score = _score").drop("_score")
    if not wrong.isEmpty():
        again = _first(_sharing(c.join(wrong, "session", "left_semi"), s)).join(s.select("fingerprint_id", "owner_ids"), "fingerprint_id")
        found_well = found_well.unionByName(again.select(*found_well.columns))
    alike = placed.join(asking.withColumnRenamed("session", "_asking"), ["files", "context"]).select("session", "_asking")
    return saved(alike.join(found_well.withColumnRenamed("session", "_asking"), "_asking").select("session", "fingerprint_id", "score", "owner_ids"), "matches")


def situation_match(current: DataFrame, stored: DataFrame, shown: DataFrame, entities: DataFrame, heads: DataFrame, best: DataFrame | None = None) -> DataFrame:
    """Per current fingerprint (session, files, errors, task) the stored one that is most like it (the first on ties) and,
    unless it is too weak, up to three of its owners that the session was not shown, with their first head fact. best: of best_situations,
    where a caller has it already."""
    best = best_situations(current, stored) if best is None else best
    best = best.withColumn("tier", S.match_tier(F.col("score"))).where("tier <> 'none'").select("session", "fingerprint_id", "score", "tier", F.posexplode("owner_ids").alias("at", "owner_id"))
    fresh = best.join(shown.select("session", "owner_id"), ["session", "owner_id"], "left_anti")
    named = fresh.join(lookup(entities, fresh.select(F.col("owner_id").alias("id"))).select(F.col("asked").alias("owner_id"), F.col("id").alias("entity_id"), "name"), "owner_id")
    first = heads.groupBy("entity_id").agg(F.min_by("value", F.struct("attribute", "id")).alias("snippet"))
    named = named.join(first, "entity_id", "left").withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy("at")))
    return named.where(F.col("place") <= MAX_OWNERS).select("session", "fingerprint_id", "score", "tier", "place", "owner_id", "name", "snippet")


def situation_seeds(events: DataFrame, fingerprints: DataFrame, files: DataFrame, entities: DataFrame) -> DataFrame:
    """Per session the entities of its last thirty events, the owners of the five latest fingerprints and its files' entities, each at
    its largest weight, the strongest twenty-four. files: session_key, entity_id; fingerprints: ts_us, owner_ids."""
    recent = events.withColumn("p", F.row_number().over(Window.partitionBy("session_key").orderBy(F.desc("ts_us"), F.desc("id")))).where(F.col("p") <= RECENT_EVENTS)
    a = recent.select("session_key", F.explode("entities").alias("id"), F.lit("recap").alias("source"))
    owners = fingerprints.orderBy(F.desc("ts_us"), F.desc("fingerprint_id")).limit(RECENT_FINGERPRINTS).select(F.explode("owner_ids").alias("asked")).distinct()
    known = lookup(entities, owners.select(F.col("asked").alias("id"))).agg(F.collect_set("id").alias("ids"))
    b = events.select("session_key").distinct().crossJoin(F.broadcast(known)).select("session_key", F.explode("ids").alias("id"), F.lit("fingerprint").alias("source"))
    c = files.select("session_key", F.col("entity_id").alias("id"), F.lit("recent-file").alias("source"))
    weight = F.create_map(*(F.lit(x) for kv in SEED_WEIGHTS.items() for x in kv))
    s = a.unionByName(b).unionByName(c).where("id <> ''").withColumn("weight", F.element_at(weight, F.col("source")))
    s = s.groupBy("session_key", "id").agg(F.max(F.struct("weight", "source")).alias("w")).select("session_key", "id", "w.weight", "w.source")
    return s.withColumn("place", F.row_number().over(Window.partitionBy("session_key").orderBy(F.desc("weight"), "id"))).where(F.col("place") <= MAX_SEEDS)


def recent_situation(tools: DataFrame) -> DataFrame:
    """Per session the last five files, five error signatures and eight tools, each once, latest last. tools: session_key, seq,
    tool, file, errors."""
    def last(value: Column, most: int, name: str) -> DataFrame:
        v = tools.select("session_key", "seq", value.alias("v")).where("v is not null and v <> ''").groupBy("session_key", "v").agg(F.max("seq").alias("seq"))
        v = v.withColumn("p", F.row_number().over(Window.partitionBy("session_key").orderBy(F.desc("seq"), "v"))).where(F.col("p") <= most)
        return v.groupBy("session_key").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("p"), "v"))), lambda x: x["v"]).alias(name))

    out = tools.select("session_key").distinct()
    for value, most, name in ((F.col("file"), 5, "files"), (F.explode("errors"), 5, "errors"), (F.col("tool"), 8, "tools")):
        out = out.join(last(value, most, name), "session_key", "left")
    return out.select("session_key", *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("files", "errors", "tools")))


def changed_since(scenes: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Scenes updated after the last persona (last_persona of one row); an unreadable time counts as changed."""
    j = scenes.crossJoin(F.broadcast(checkpoint.limit(1)))
    at = F.try_to_timestamp("updated")
    return j.where(at.isNull() | F.col("last_persona").isNull() | (at > F.col("last_persona"))).select(*scenes.columns)


def scene_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many scenes (name, md5) were created, updated or deleted between two snapshots."""
    a, b = before.select("name", F.col("md5").alias("_old")), after.select("name", F.col("md5").alias("_new"))
    status = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "updated")
    return a.join(b, "name", "full_outer").withColumn("status", status).where("status is not null").groupBy("status").agg(F.count("*").alias("n"))


def previous_session(events: DataFrame, current: DataFrame) -> DataFrame:
    """Per session key the session id of its latest event that is no recap and not of the current session (session_key, session_id)."""
    c = current.select("session_key", F.col("session_id").alias("_current"))
    e = events.where((F.col("type") != RECAP) & (F.coalesce("session_id", F.lit("")) != "")).join(c, "session_key", "left").where(F.col("_current").isNull() | (F.col("session_id") != F.col("_current")))
    return e.groupBy("session_key").agg(F.max_by("session_id", F.struct("ts_us", "id")).alias("session_id"))


def recap_threads(events: DataFrame) -> DataFrame:
    """Per session key and session id what its recap is made of: project (the commonest, ties to the first seen), the last six
    anchored items of a thread, the latest task or decision as next step, and all source messages."""
    from hippospark.operators.clusters import mode_of

    e = events.where(F.col("type") != RECAP).withColumn("_session", F.struct("session_key", "session_id"))
    item = F.struct("type", "text", "source_message_ids")
    thread = e.where(F.col("type").isin(*THREAD_TYPES))
    anchored = thread.where(F.exists("source_message_ids", lambda x: F.char_length(x) > 0) & (F.trim("text") != ""))
    last = anchored.withColumn("p", F.row_number().over(Window.partitionBy("session_key", "session_id").orderBy(F.desc("ts_us"), F.desc("id")))).where("p <= 6")
    t = last.groupBy("session_key", "session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("p"), item.alias("item")))), lambda x: x["item"]).alias("thread"))
    n = thread.where(F.col("type").isin(*NEXT_STEP_TYPES)).groupBy("session_key", "session_id").agg(F.max_by(item, F.struct("ts_us", "id")).alias("next_step"))
    p = mode_of(e, "_session", "project", "ts_us").select("_session.session_key", "_session.session_id", "project")
    latest = e.groupBy("session_key", "session_id").agg(F.max("ts_us").alias("latest"))
    return latest.join(t, ["session_key", "session_id"], "left").join(n, ["session_key", "session_id"], "left").join(p, ["session_key", "session_id"], "left")


def rollover_recaps(events: DataFrame, current: DataFrame, now_us: int, day: str) -> DataFrame:
    """A recap event of each session key's previous session, unless it has one that is not older than its latest event or
    nothing in it is anchored."""
    from hippospark.functions.render import recap

    prev = previous_session(events, current)
    done = events.where(F.col("type") == RECAP).groupBy("session_key", "session_id").agg(F.max("ts_us").alias("_recap"))
    t = recap_threads(events).join(prev, ["session_key", "session_id"]).join(done, ["session_key", "session_id"], "left").where(F.col("_recap").isNull() | (F.col("_recap") < F.col("latest")))
    empty = F.array().cast("array<struct<type:string,text:string,source_message_ids:array<string>>>")
    thread = F.coalesce("thread", empty)
    text = recap(F.col("project"), F.lit(day), thread, F.col("next_step"))
    sources = F.array_distinct(F.concat(F.flatten(F.transform(thread, lambda x: x["source_message_ids"])), F.coalesce(F.col("next_step")["source_message_ids"], F.array().cast("array<string>"))))
    out = t.withColumn("text", text).where("text <> ''")
    return out.select(S.sha1_id("evt", F.col("session_key"), F.lit(str(now_us)), F.lit(RECAP), F.col("text")).alias("id"), F.lit(now_us).alias("ts_us"), "session_key", "session_id", F.coalesce("project", F.lit("")).alias("project"), F.lit(RECAP).alias("type"), "text", sources.alias("source_message_ids"))


