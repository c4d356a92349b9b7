"""A memory store over logs of Parquet folders: what a host calls.

A table is a log: a write appends immutable folders under its number, a read takes those of finished writes, so that a write
costs what it brings and a lost job leaves nothing that is read. A writer claims its number before it writes and marks it
when all of its tables are there: two writers never share one, and what a write changes in several tables holds as a whole.
`compact` folds a table's folders into one. Rows that replace others (lifecycles, lessons, vectors, heads) carry the number
of their write; the latest counts.

What recalls read is kept, not built: a batch of facts folds onto the heads of its keys, and keyword indexes take in what
writes have changed, by number.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hippospark.functions import parsing as P
from hippospark.functions import scalar as S
from hippospark.functions import text as X
from hippospark.functions.commits import Folder
from hippospark.functions.storage import forget, saved
from hippospark.operators import graph, kb, knowledge, lifecycle, lookups, retrieval
from hippospark.operators.keyword_index import SegmentIndex
from hippospark.sources.sinks import append_new

MESSAGES = "record_id string, session_key string, session_id string, role string, message_text string, ts_ms long"
FACTS = "entity_id string, attribute string, value string, valid_from long, learned_at long, seq long, confidence double"
EVENTS = "event_id string, session_key string, session_id string, type string, text string, ts_ms long, entities array<string>"
EDGES = "src string, dst string, weight double"
LIFECYCLES = "owner_id string, owner_kind string, salience double, reinforcement_count long, created long, permanence_score double, last long, tier string, state string, gate_state string, origin string, contradiction boolean, updated long"
ENTITIES = "id string, type string, name string, canonical_key string, namespace string, aliases array<string>, importance double, created_time string, updated_time string, merged_into string"
VECTORS = "owner_id string, embedding array<double>"
LESSONS = "id string, domain string, lesson_text string, files array<string>, confidence double, willingness double, evidence_count long, version long, avoidance_count long, exposure_count long, last_session string, superseded_by string"
#: Head facts and closed ones; a head that was superseded from elsewhere is closed too.
HEADS = "entity_id string, attribute string, value string, valid_from long, confidence double, support long, closed boolean"
HISTORY = "entity_id string, attribute string, value string, valid_from long, valid_to long, confidence double, support long"
#: What hosts may leave out: the event that a fact comes from, an event's project.
SCHEMAS = {"messages": MESSAGES, "facts": FACTS + ", source_event_id string", "events": EVENTS + ", project string", "relations": EDGES, "lifecycles": LIFECYCLES, "entities": ENTITIES, "vectors": VECTORS, "lessons": LESSONS, "heads": HEADS, "history": HISTORY}
#: Tables whose rows replace earlier ones of the same key.
KEYS = {"lifecycles": ["owner_id", "owner_kind"], "entities": ["id"], "vectors": ["owner_id"], "lessons": ["id"], "heads": ["entity_id", "attribute"]}


def fact_id() -> Column:
    """Of a row's entity, attribute and value."""
    return S.sha1_id("fact", F.col("entity_id"), F.col("attribute"), F.col("value"))


class MemoryStore:
    """root: a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.numbers = Folder(spark, f"{self.root}/_numbers")
        self.indexes = {name: SegmentIndex(spark, f"{self.root}/_index_{name}") for name in ("messages", "knowledge")}

    # Logs

    def _claims(self) -> tuple[list[int], set[int]]:
        """Numbers that were claimed, and those whose writes are finished."""
        names = self.numbers.names()
        return sorted(int(n[1:]) for n in names if n[0] == "c"), {int(n[1:]) for n in names if n[0] == "d"}

    def last_write(self) -> int:
        """The number up to which all writes are finished: what is read up to here will not change."""
        claimed, done = self._claims()
        return next((n - 1 for n in claimed if n not in done), claimed[-1] if claimed else 0)

    def _parts(self, name: str, after: int = 0, upto: int | None = None) -> list[str]:
        """Folders of finished writes to read: the latest compacted one, and what came after what it holds."""
        _, done = self._claims()
        base, parts = (0, 0, ""), []
        for folder in Folder(self.spark, f"{self.root}/{name}").names():
            number = int(folder[-8:])
            if number not in done:
                continue
            if folder[0] == "c":  # c<what it holds>-<its write>
                base = max(base, (int(folder[1:9]), number, folder))
            elif number > after and (upto is None or number <= upto):
                parts.append((number, folder))
        if after:
            return [f for _, f in parts]
        return ([base[2]] if base[2] else []) + [f for n, f in parts if n > base[0]]

    def _log(self, name: str, after: int = 0, upto: int | None = None) -> DataFrame:
        parts = self._parts(name, after, upto)
        schema = SCHEMAS[name] + ", write_no long"
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/{f}" for f in parts]) if parts else self.spark.createDataFrame([], schema)

    @staticmethod
    def _latest(rows: DataFrame, key: list[str]) -> DataFrame:
        return rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), "write_no").alias("row")).select("row.*")

    def table(self, name: str) -> DataFrame:
        rows = self._log(name)
        return (self._latest(rows, KEYS[name]) if name in KEYS else rows).drop("write_no")

    def _write(self, tables: dict[str, DataFrame], folder: str = "v", keep_numbers: bool = False) -> int:
        """Append rows to tables as one write: all of it is read, or none."""
        number = max(self._claims()[0], default=0) + 1
        while not self.numbers.create(f"c{number:08d}"):
            number += 1
        for name, rows in tables.items():
            schema = self.spark.createDataFrame([], SCHEMAS[name]).schema
            columns = [(F.col(c.name) if c.name in rows.columns else F.lit(None)).cast(c.dataType).alias(c.name) for c in schema]
            rows.select(*columns, F.col("write_no") if keep_numbers else F.lit(number).cast("long").alias("write_no")).write.parquet(f"{self.root}/{name}/{folder}{number:08d}")
        self.numbers.create(f"d{number:08d}")
        return number

    def compact(self, name: str) -> None:
        """CLI reindex's share: one folder in place of many; older ones stay until no reader needs them. Writes that are under way meanwhile
        are read beside it."""
        upto = self.last_write()
        rows = self._log(name, upto=upto)
        self._write({name: self._latest(rows, KEYS[name]) if name in KEYS else rows}, f"c{upto:08d}-", keep_numbers=True)

    # Writing

    def capture(self, messages: DataFrame) -> None:
        """POST /capture, /seed: sanitise, drop what is no content, keep each record once and only rows past the session's cursor."""
        old = self.table("messages")
        cursor = old.groupBy("session_key").agg(F.max("ts_ms").alias("_cursor"))
        text = F.when(F.col("role") == "assistant", X.without_code(F.col("message_text"))).otherwise(F.col("message_text"))
        new = messages.withColumn("message_text", X.redacted(X.sanitized(text))).where(X.capturable(F.col("message_text")))
        new = new.join(cursor, "session_key", "left").where(F.col("_cursor").isNull() | (F.col("ts_ms") > F.col("_cursor"))).select(old.columns)
        self._write({"messages": append_new(old.select("record_id"), new, "record_id")})
        self.sync()

    def kb_write(self, facts: DataFrame | None = None, events: DataFrame | None = None, relations: DataFrame | None = None, vectors: DataFrame | None = None, lessons: DataFrame | None = None, now_ms: int = 0) -> None:
        """POST /kb/write, /observe. Facts fold onto the heads of their keys; what contradicts now is flagged, what no longer does cleared."""
        tables = {name: rows for name, rows in (("facts", facts), ("events", events), ("relations", relations), ("vectors", vectors), ("lessons", lessons)) if rows is not None}
        made = []
        if facts is not None:
            keys = facts.select(*kb.KEY).distinct()
            folded = saved(kb.fold_facts(facts, self.heads().join(keys, list(kb.KEY), "left_semi")), "folded")
            made.append(folded)
            tables["heads"] = folded.where("valid_to is null").withColumn("closed", F.lit(False))
            tables["history"] = folded.where("valid_to is not null")
        self._write(tables)
        if facts is not None:
            self.flag_contradictions(keys, now_ms)
        for x in made:
            forget(x)
        self.sync()

    def flag_contradictions(self, keys: DataFrame, now_ms: int) -> None:
        """A8 for the keys (entity_id, attribute) that changed: flags set and cleared; other keys are as they were."""
        mine = self.table("facts").join(keys.select(*kb.KEY).distinct(), list(kb.KEY), "left_semi").withColumn("id", fact_id())
        last = kb.newest(mine, "valid_from")
        flags = kb.contradicted_keys(last, keys)
        # facts that are no longer among the last ones are cleared as well
        now = last.select("id", *kb.KEY).distinct()
        other = mine.select("id", *kb.KEY).distinct().join(now.select("id"), "id", "left_anti")
        lives = self.table("lifecycles")
        rows = lifecycle.flagged_by_change(lives, now, flags, now_ms // 1000).unionByName(lifecycle.flagged_by_change(lives, other, flags.withColumn("contradiction", F.lit(False)), now_ms // 1000))
        rows = saved(rows, "flags")
        if not rows.isEmpty():
            self._write({"lifecycles": rows})
        forget(rows)

    def sync(self) -> None:
        """Take into the keyword indexes what writes have changed since they were last brought up; nothing where they are up to date."""
        upto = self.last_write()
        messages, knowledge = self.indexes["messages"], self.indexes["knowledge"]
        after = messages.note() or 0
        if self._parts("messages", after, upto):
            messages.update(self._log("messages", after, upto), id_col="record_id", text_col="message_text", note=upto)
        after = knowledge.note() or 0
        if any(self._parts(name, after, upto) for name in ("events", "heads", "history", "entities")):
            keys = self._log("heads", after, upto).select(*kb.KEY).unionByName(self._log("history", after, upto).select(*kb.KEY)).distinct()
            renamed = self._log("entities", after, upto).select(F.col("id").alias("entity_id")).distinct()
            every = self._latest(self._log("heads", upto=upto), KEYS["heads"])
            changed = every.join(keys, list(kb.KEY), "left_semi").unionByName(every.join(renamed, "entity_id", "left_semi")).distinct()
            rows = saved(self._fact_rows(changed.where("not closed")).select("id", "text").unionByName(self._log("events", after, upto).select(F.col("event_id").alias("id"), "text")), "changed")
            gone = self._log("history", after, upto).select(fact_id().alias("id")).unionByName(changed.where("closed").select(fact_id().alias("id"))).join(rows.select("id"), "id", "left_anti")
            knowledge.update(rows, gone, note=upto)
            forget(rows)

    def remember(self, mentions: DataFrame) -> DataFrame:
        """Resolve mentions (ref, namespace, type, name, aliases, now) to entities, created where there are none: ref, id, how."""
        entities = self.table("entities")
        resolved, after = knowledge.resolve_entities(entities, mentions)
        resolved = self._kept(resolved)
        self._write({"entities": after.exceptAll(entities)})
        self.sync()
        return resolved

    def reconcile(self, merges: DataFrame) -> DataFrame:
        """CLI reconcile: point satellites (old) to their canonical entities; what is wrong with the others comes back."""
        entities = self.table("entities")
        wrong = knowledge.merge_errors(entities, merges)
        good = merges.join(wrong.select("old"), "old", "left_anti")
        wrong = self._kept(wrong)
        self._write({"entities": entities.join(good.select(F.col("old").alias("id"), "canonical"), "id").withColumn("merged_into", F.col("canonical"))})
        self.sync()
        return wrong

    @staticmethod
    def _kept(rows: DataFrame) -> DataFrame:
        """What a write returns is what was there before it: written, not computed again."""
        return saved(rows, "returned")

    def _owner(self, owner_id: str, owner_kind: str) -> DataFrame:
        return self.spark.createDataFrame([(owner_id, owner_kind)], "owner_id string, owner_kind string")

    def gate(self, owner_id: str, event: str, now_ms: int, owner_kind: str = "fact") -> None:
        """Tool reject_memory, and the question before it (ask). A rejection stands."""
        owner = self._owner(owner_id, owner_kind)
        rows = lifecycle.ensured(self.table("lifecycles").join(owner, KEYS["lifecycles"], "left_semi"), owner, now_ms // 1000)
        self._write({"lifecycles": rows.withColumns({"gate_state": lifecycle.gate_after(F.col("gate_state"), event), "updated": F.lit(now_ms // 1000).cast("long")})})

    def confirm(self, owner_id: str, now_ms: int, owner_kind: str = "fact", superseded: str | None = None) -> None:
        """Tool confirm_memory (LC7), one write: the owner is trusted and no longer asked about, a fact's confidence is 0.99, and the fact that
        it supersedes is closed."""
        fact = owner_id if owner_kind == "fact" else None
        c = self.spark.createDataFrame([(owner_id, owner_kind, fact, superseded)], "owner_id string, owner_kind string, fact_id string, superseded_fact_id string")
        h = self.heads().withColumn("id", fact_id()).where(F.col("id").isin([x for x in (fact, superseded) if x]))
        h = saved(h.withColumns({"superseded_by": F.lit(None).cast("string"), "valid_to": F.lit(None).cast("long")}), "confirmed")
        lives = self.table("lifecycles").join(c.select("owner_id", "owner_kind"), KEYS["lifecycles"], "left_semi")
        rows, facts = lifecycle.confirmed(lives, h, c, now_ms // 1000)
        self._write({"lifecycles": rows, "heads": facts.withColumn("closed", F.col("valid_to").isNotNull()), "history": facts.where("valid_to is not null")})
        forget(h)
        self.sync()

    def stance(self, lesson_id: str, confirmed: bool) -> None:
        """Tools stance_confirmed and stance_rejected."""
        x = self.table("lessons").where(F.col("id") == lesson_id)
        self._write({"lessons": x.withColumn("willingness", S.willingness_after(F.coalesce("willingness", F.lit(0.6)), confirmed))})

    def lesson_helped(self, lesson_id: str) -> None:
        """Tool lesson_helped: an avoidance that was seen."""
        x = self.table("lessons").where(F.col("id") == lesson_id)
        self._write({"lessons": x.withColumns({"confidence": S.confidence_after(F.col("confidence"), True), "avoidance_count": F.coalesce("avoidance_count", F.lit(0)) + 1})})

    def session_end(self, session_key: str, now_ms: int = 0) -> DataFrame:
        """POST /session/end (LC9, LC10): lessons that the session was exposed to are credited or tempered, its events and the facts from
        them reinforced, what is stale decays, and contradictions of its facts' keys are flagged. Contradictory keys of it come back."""
        events = self.table("events")
        x = self.table("lessons")
        c = lifecycle.credited(x, events, session_key)
        e = events.where(F.col("session_key") == session_key).select(F.col("event_id").alias("id"))
        facts = self.table("facts").withColumn("id", fact_id())
        mine = facts.join(e.select(F.col("id").alias("source_event_id")), "source_event_id", "left_semi")
        owners = e.select(F.col("id").alias("owner_id"), F.lit("event").alias("owner_kind")).unionByName(mine.select(F.col("id").alias("owner_id"), F.lit("fact").alias("owner_kind"))).distinct()
        lives = self.table("lifecycles")
        rows = saved(lifecycle.consolidated_owners(lives, owners, now_ms // 1000).exceptAll(lives), "consolidated")
        self._write({"lessons": x.drop("confidence", "avoidance_count").join(c.drop("relapsed"), "id"), "lifecycles": rows})
        forget(rows)
        keys = mine.select(*kb.KEY).distinct()
        self.flag_contradictions(keys, now_ms)
        return kb.contradictions(kb.newest(facts.join(keys, list(kb.KEY), "left_semi"), "valid_from"))

    def digest(self, session_key: str, now_ms: int, day: str) -> int:
        """POST /digest: a recap of the session key's previous session, if it needs one; how many were written."""
        e = self.table("events").select(F.col("event_id").alias("id"), (F.col("ts_ms") * 1000).alias("ts_us"), "session_key", "session_id", F.lit("").alias("project"), "type", "text", "entities", F.array("event_id").alias("source_message_ids"))
        current = self.spark.createDataFrame([(session_key, None)], "session_key string, session_id string")
        r = lookups.rollover_recaps(e.where(F.col("session_key") == session_key), current, now_ms * 1000, day)
        r = saved(r, "recaps")
        self._write({"events": r.select(F.col("id").alias("event_id"), "session_key", "session_id", "type", "text", F.lit(now_ms).alias("ts_ms"), F.array().cast("array<string>").alias("entities"))})
        n = r.count()
        forget(r)
        self.sync()
        return n

    # Reading

    def heads(self) -> DataFrame:
        """What holds now: one version per entity and attribute, as the writes left it."""
        return self.table("heads").where("not closed").drop("closed")

    def _rejected(self) -> DataFrame:
        return self.table("lifecycles").where("gate_state = 'rejected'").select("owner_id").distinct()

    def _fact_rows(self, heads: DataFrame) -> DataFrame:
        names = self.table("entities").select(F.col("id").alias("entity_id"), "name", F.col("importance").alias("_imp"))
        h = heads.where(~X.noise_attribute(F.col("attribute"))).join(names, "entity_id", "left")
        return h.select(fact_id().alias("id"), F.lit("fact").alias("kind"), F.concat(F.coalesce("name", "entity_id"), F.lit(" — "), "attribute", F.lit(": "), "value").alias("text"), "entity_id", (F.col("valid_from") / 86_400_000.0).alias("day"), S.fact_importance(F.col("_imp"), F.col("confidence"), F.col("support")).alias("importance"), F.lit(None).cast("string").alias("project"))

    def _rows(self) -> DataFrame:
        """All that may be recalled: head facts and events that were not rejected, as texts."""
        e = self.table("events").select(F.col("event_id").alias("id"), F.lit("event").alias("kind"), "text", F.lit(None).cast("string").alias("entity_id"), (F.col("ts_ms") / 86_400_000.0).alias("day"), F.lit(0.5).alias("importance"), "project")
        gone = self._rejected()
        return self._fact_rows(self.heads()).unionByName(e).join(gone.withColumnRenamed("owner_id", "id"), "id", "left_anti").join(gone.withColumnRenamed("owner_id", "entity_id"), "entity_id", "left_anti")

    def search_conversations(self, terms: Sequence[str], k: int = 5, session_key: str | None = None) -> DataFrame:
        """POST /search/conversations; the session filters before the top k."""
        self.sync()
        m = self.table("messages")
        among = None if session_key is None else m.where(F.col("session_key") == session_key).select(F.col("record_id").alias("id"))
        return self.indexes["messages"].search(list(terms), k, among).withColumnRenamed("id", "record_id").join(m, "record_id").orderBy(F.desc("bm25"), "record_id")

    def search_memories(self, terms: Sequence[str], k: int = 5, query_vector: Sequence[float] | None = None) -> DataFrame:
        """POST /search/memories: head facts and events by keyword and, with a vector of the query, by cosine, fused."""
        self.sync()
        rows = self._rows()
        words, vectors = self._lists(rows, terms, k, query_vector)
        return retrieval.search_tool(words, vectors, rows, k).join(rows, "id").orderBy(F.desc("score"), "id")

    def _lists(self, rows: DataFrame, terms: Sequence[str], k: int, query_vector: Sequence[float] | None) -> tuple[DataFrame, DataFrame]:
        place = lambda x, score: x.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "id")) - 1)
        words = place(self.indexes["knowledge"].search(list(terms), 3 * k, rows), "bm25").withColumn("score", S.bm25_rank_score(-F.col("bm25")))
        if query_vector is None:
            return words, self.spark.createDataFrame([], "id string, rank int, cosine double")
        q = self.spark.createDataFrame([([float(x) for x in query_vector],)], "q array<double>")
        v = self.table("vectors").join(rows.select(F.col("id").alias("owner_id")), "owner_id", "left_semi").withColumnRenamed("owner_id", "id")
        return words, place(retrieval.vector_topk(v, q, 3 * k, "id"), "score").select("id", "rank", F.col("score").alias("cosine"))

    def recall(self, terms: Sequence[str], now_ms: int, k: int = 5, rerank: Callable[[DataFrame], DataFrame] | None = None, query_vector: Sequence[float] | None = None, project: str | None = None) -> DataFrame:
        """POST /recall: keyword, vector and entity candidates fused, weighed by recency and importance and primed by the graph, and what
        they call to mind beyond. rerank is the host's seam. Hits of another project than the one given count half (J19). Unverified
        hits of high stakes become a question (LC8). Rows: id, kind, entity_id, text, score, associative, gate_state."""
        self.sync()
        rows = self._rows()
        words, vectors = self._lists(rows, terms, k, query_vector)
        matches = retrieval.entity_matches(self.table("entities").where("merged_into is null"), list(terms), "id", "name", 3 * k)
        matches = matches.select(F.col("id").alias("entity_id"), F.row_number().over(Window.orderBy(F.desc("hits"), "id")).alias("place"))
        named = lookups.entity_head_candidates(matches, rows.where("kind = 'fact'").withColumn("attribute", F.col("text")), 3 * k).select("id", "rank")
        relations = self.table("relations")
        hits = retrieval.kb_recall(words, vectors, named, rows, k, now_ms / 86_400_000.0, graph.both_ways(relations)).join(rows.select("id", "entity_id", "project"), "id")
        hits = hits if project is None else retrieval.with_penalty(hits, project)
        hits = hits.select("id", "kind", "entity_id", "text", "score")
        hits = rerank(hits) if rerank else hits
        # k rows, which several steps below read
        hits = self.spark.createDataFrame(hits.collect(), hits.schema)
        gates = self._gate_recalled(hits, now_ms)
        seeds = hits.where("entity_id is not null").select(F.col("entity_id").alias("id")).distinct()
        heads = self.heads().join(self._rejected().withColumnRenamed("owner_id", "entity_id"), "entity_id", "left_anti").withColumn("id", fact_id())
        events = self.table("events").select(F.col("event_id").alias("id"), (F.col("ts_ms") * 1000).alias("ts_us"), "text", "entities")
        more = graph.deepened(hits, "score", relations.select("src", "dst", F.col("weight").alias("support")), seeds, heads, events)
        more = more.join(hits.select(F.col("id").alias("owner_id")), "owner_id", "left_anti").select(F.col("owner_id").alias("id"), F.col("owner_kind").alias("kind"), "entity_id", "text", F.col("activation").alias("score"), F.lit(True).alias("associative"))
        out = hits.withColumn("associative", F.lit(False)).unionByName(more).join(gates.select(F.col("owner_id").alias("id"), F.col("owner_kind").alias("kind"), "gate_state"), ["id", "kind"], "left")
        return out.withColumn("gate_state", F.coalesce("gate_state", F.lit("clear"))).orderBy("associative", F.desc("score"), "id")

    def _gate_recalled(self, hits: DataFrame, now_ms: int) -> DataFrame:
        """LC8: the lifecycle rows of hits; those that become a question are written."""
        recalled = hits.select(F.col("id").alias("owner_id"), F.col("kind").alias("owner_kind"), "text")
        old = self.table("lifecycles").join(recalled.select("owner_id", "owner_kind"), KEYS["lifecycles"], "left_semi")
        all_ = lifecycle.ensured(old, recalled, now_ms // 1000)
        rows = lifecycle.gate_recalled(all_, recalled)
        rows = self.spark.createDataFrame(rows.collect(), rows.schema)  # k rows at most
        asked = rows.where("gate_state = 'pending_confirmation'").join(old.where("gate_state = 'pending_confirmation'").select("owner_id", "owner_kind"), KEYS["lifecycles"], "left_anti")
        if not asked.isEmpty():
            self._write({"lifecycles": asked.withColumn("updated", F.lit(now_ms // 1000).cast("long"))})
        return rows

    def pending(self, limit: int = 50) -> DataFrame:
        """Memories that wait for a confirmation."""
        return lifecycle.pending(self.table("lifecycles"), limit)

    def canonicalize(self) -> DataFrame:
        """CLI canonicalize as a dry run: attributes of facts that have a canonical name."""
        f = self.table("facts")
        return f.select("attribute", P.canonical_attribute(F.col("attribute")).alias("canonical")).where("attribute <> canonical").groupBy("attribute", "canonical").agg(F.count("*").alias("n"))

    def health(self) -> dict[str, int]:
        """GET /health."""
        return {name: self.table(name).count() for name in SCHEMAS}
