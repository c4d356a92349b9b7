import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from hippospark.api import EDGES, EVENTS, FACTS, LESSONS, MESSAGES, VECTORS, MemoryStore, fact_id
from hippospark.operators import kb


def test_store(spark, tmp_path):
    store = MemoryStore(spark, f"file://{tmp_path}")
    rows = [("m1", "s", "i", "user", "deploy failed again", 10), ("m2", "s", "i", "user", "/new", 11), ("m3", "s", "i", "assistant", "see\n```\ncode deploy\n```\nfixed the deploy", 12)]
    store.capture(spark.createDataFrame(rows, MESSAGES))
    store.capture(spark.createDataFrame([("m0", "s", "i", "user", "late", 5), ("m4", "s", "i", "user", "thanks", 20)], MESSAGES))
    assert sorted(r["record_id"] for r in store.table("messages").collect()) == ["m1", "m3", "m4"]
    assert {r["record_id"] for r in store.search_conversations(["deploy"]).collect()} == {"m1", "m3"}
    facts = [("anna", "city", "Rome", 1, 1, 1, 0.9), ("anna", "city", "Milan", 5, 2, 2, 0.9), ("bo", "pet", "cat", 3, 3, 3, 0.5)]
    store.kb_write(facts=spark.createDataFrame(facts, FACTS), relations=spark.createDataFrame([("anna", "bo", 2.0)], EDGES))
    assert sorted((r["entity_id"], r["value"]) for r in store.heads().collect()) == [("anna", "Milan"), ("bo", "cat")]
    got = store.recall(["milan"], 86_400_000).collect()
    assert [(r["entity_id"], r["associative"]) for r in got] == [("anna", False), ("bo", True)]
    fact = got[0]["id"]
    store.kb_write(vectors=spark.createDataFrame([(fact, [1.0, 0.0]), ("e1", [0.0, 1.0])], VECTORS), events=spark.createDataFrame([("e1", "s", "i", "bug", "printer broke", 7, ["anna"])], EVENTS))
    assert [r["id"] for r in store.recall(["nothing"], 86_400_000, query_vector=[0.1, 1.0]).where("not associative").collect()] == ["e1", fact]
    assert [r["id"] for r in store.search_memories(["printer"], query_vector=[1.0, 0.1]).collect()] == ["e1", fact]
    store.gate("anna", "ask", 1)
    store.gate("anna", "reject", 2)
    store.gate("anna", "confirm", 3)
    assert [r["gate_state"] for r in store.table("lifecycles").where("owner_id = 'anna'").collect()] == ["rejected"]
    assert store.search_memories(["milan"]).count() == 0
    assert store.health()["messages"] == 3
    before = sorted(map(tuple, store.table("facts").collect()))
    store.compact("facts")
    store.kb_write(facts=spark.createDataFrame([("bo", "pet", "dog", 9, 9, 9, 0.5)], FACTS))
    assert sorted(map(tuple, store.table("facts").where("learned_at < 9").collect())) == before and store.table("facts").count() == 4


def test_entities_and_lessons(spark, tmp_path):
    store = MemoryStore(spark, f"file://{tmp_path}")
    mention = "ref string, namespace string, type string, name string, aliases array<string>, now string"
    first = {r["ref"]: (r["id"], r["how"]) for r in store.remember(spark.createDataFrame([("1", "default", "person", "Anna", ["Annie"], "t"), ("2", "default", "person", " ANNA ", [], "t"), ("3", "default", "person", "Bo", [], "t")], mention)).collect()}
    assert first["1"] == first["2"] and first["1"][1] == "new"
    again = {r["ref"]: r["how"] for r in store.remember(spark.createDataFrame([("4", "default", "person", "annie", [], "u"), ("5", "default", "person", "Bo", [], "u")], mention)).collect()}
    assert again == {"4": "alias", "5": "key"} and store.table("entities").count() == 2
    wrong = store.reconcile(spark.createDataFrame([(first["3"][0], first["1"][0]), ("nobody", first["1"][0])], "old string, canonical string"))
    assert [r["error"] for r in wrong.collect()] == ["satellite not found"] and store.table("entities").where("merged_into is not null").count() == 1
    lesson = ("l", "d", "t", ["k1"], 0.5, 0.5, 2, 1, 3, 1, "s", None)
    store.kb_write(lessons=spark.createDataFrame([lesson], LESSONS), events=spark.createDataFrame([("a-1", "s", "i", "decision", "go left", 5, ["k2"])], EVENTS))
    store.stance("l", True)
    store.lesson_helped("l")
    store.session_end("s")
    row = store.table("lessons").first()
    assert round(row["willingness"], 4) == 0.6225 and row["avoidance_count"] == 5 and row["confidence"] > 0.7
    assert store.digest("s", 9, "2024-01-01") == 1 and store.digest("s", 10, "2024-01-01") == 0
    assert store.health()["lessons"] == 1 and store.canonicalize().count() == 0


def fact(spark, *rows):
    return spark.createDataFrame([(*r[:7], r[7] if len(r) > 7 else None) for r in rows], FACTS + ", source_event_id string")


def test_batches_fold_onto_heads(spark, tmp_path):
    """Heads and history after many batches are those of one fold over all in their order; older facts, repeats and keys that come again."""
    rng = random.Random(9)
    store = MemoryStore(spark, f"file://{tmp_path}")
    every = []
    for batch in range(5):
        rows = [(f"e{rng.randrange(4)}", "a", rng.choice(["x", "X ", "y", "z"]), rng.randrange(30), 100 * batch + i, i, rng.random()) for i in range(rng.choice([1, 12]))]
        every += rows
        store.kb_write(facts=fact(spark, *rows))
    full = {tuple(r) for r in kb.upsert_facts(fact(spark, *every)).collect()}
    heads = store.heads().select("entity_id", "attribute", "value", "valid_from", F.lit(None).cast("long"), "confidence", "support").collect()
    history = store.table("history").collect()
    assert sorted(map(str, map(tuple, heads + history))) == sorted(map(str, full)) and len(history) > 5
    for name in ("heads", "history", "facts"):
        before = sorted(map(str, store.table(name).collect()))
        store.compact(name)
        assert sorted(map(str, store.table(name).collect())) == before
    store.kb_write(facts=fact(spark, ("e0", "a", "new", 99, 999, 1, 0.5)))
    assert [r["value"] for r in store.heads().where("entity_id = 'e0'").collect()] == ["new"]


def test_contradictions_by_change_equal_a_full_pass(spark, tmp_path):
    store = MemoryStore(spark, f"file://{tmp_path}")

    def flagged():
        return {r["owner_id"] for r in store.table("lifecycles").where("contradiction").collect()}

    def full():
        last = kb.newest(store.table("facts"), "valid_from")
        return {r["id"] for r in last.join(kb.contradictions(last).select(*kb.KEY), list(kb.KEY)).select(fact_id().alias("id")).collect()}

    store.kb_write(facts=fact(spark, ("a", "city", "Rome", 1, 1, 1, 0.9), ("a", "city", "Milan", 1, 1, 2, 0.9), ("b", "pet", "cat", 1, 1, 3, 0.9)))
    assert flagged() == full() and len(full()) == 2
    store.kb_write(facts=fact(spark, ("b", "pet", "dog", 1, 2, 1, 0.9)))
    assert flagged() == full() and len(full()) == 4
    store.kb_write(facts=fact(spark, ("a", "city", "Oslo", 5, 3, 1, 0.9)))
    assert flagged() == full() and len(full()) == 2


def test_index_follows_the_writes(spark, tmp_path):
    """Superseded, renamed and confirmed facts; nothing is written by a search."""
    store = MemoryStore(spark, f"file://{tmp_path}")
    mention = "ref string, namespace string, type string, name string, aliases array<string>, now string"
    anna = store.remember(spark.createDataFrame([("1", "default", "person", "Anna", [], "t")], mention)).first()["id"]
    store.kb_write(facts=fact(spark, (anna, "city", "Rome", 1, 1, 1, 0.9), ("bo", "town", "Rome", 2, 1, 2, 0.4)))
    found = lambda *terms: sorted(r["text"] for r in store.search_memories(list(terms)).collect())
    assert found("rome") == ["Anna — city: Rome", "bo — town: Rome"] and found("anna") == ["Anna — city: Rome"]
    before = store.indexes["knowledge"].state()[0], store.last_write()
    assert store.recall(["rome"], 86_400_000).count() == 2
    assert (store.indexes["knowledge"].state()[0], store.last_write()) == before
    store.kb_write(facts=fact(spark, (anna, "city", "Milan", 5, 2, 1, 0.9)))
    assert found("rome") == ["bo — town: Rome"] and found("milan") == ["Anna — city: Milan"]
    ids = {r["entity_id"]: r["id"] for r in store.heads().withColumn("id", fact_id()).collect()}
    store.confirm(ids[anna], 7_000, superseded=ids["bo"])
    row = store.table("lifecycles").where(F.col("owner_id") == ids[anna]).first()
    assert row["gate_state"] == "clear" and row["origin"] == "user_confirmed" and row["updated"] == 7
    assert [(r["entity_id"], r["confidence"]) for r in store.heads().collect()] == [(anna, 0.99)]
    assert found("rome") == [] and [r["valid_to"] for r in store.table("history").where("entity_id = 'bo'").collect()] == [7]


def test_session_end_consolidates(spark, tmp_path):
    store = MemoryStore(spark, f"file://{tmp_path}")
    e = spark.createDataFrame([("e1", "s", "i", "note", "hello there", 5, [], None), ("e2", "t", "i", "note", "old", 5, [], None)], EVENTS + ", project string")
    store.kb_write(events=e, facts=fact(spark, ("a", "city", "Rome", 1, 1, 1, 0.9, "e1"), ("a", "city", "Oslo", 1, 1, 2, 0.9, "e2")))
    day = 86_400_000
    store.session_end("t", 1 * day)
    back = store.session_end("s", 30 * day)
    assert [r["values"] for r in back.collect()] == [["Oslo", "Rome"]]
    rows = {r["owner_id"]: r for r in store.table("lifecycles").collect()}
    assert rows["e1"]["reinforcement_count"] == 1 and rows["e1"]["last"] == 30 * 86_400
    # the other session's event went stale and decayed
    assert rows["e2"]["reinforcement_count"] == 1 and rows["e2"]["permanence_score"] == 0.25 and rows["e2"]["last"] == 86_400
    assert sum(r["contradiction"] for r in rows.values()) == 2


def test_recall_asks_and_weighs_projects(spark, tmp_path):
    store = MemoryStore(spark, f"file://{tmp_path}")
    e = [("e1", "s", "i", "note", "the doctor is deploying to production", 5, [], "here"), ("e2", "s", "i", "note", "the doctor likes tea", 5, [], "there"), ("e3", "s", "i", "note", "the doctor likes tea too", 5, [], None)]
    store.kb_write(events=spark.createDataFrame(e, EVENTS + ", project string"))
    day_ms = 86_400_000
    plain = {r["id"]: r["score"] for r in store.recall(["doctor"], day_ms).where("not associative").collect()}
    mine = {r["id"]: r["score"] for r in store.recall(["doctor"], day_ms, project="here").where("not associative").collect()}
    assert mine["e2"] == plain["e2"] / 2 and mine["e1"] == plain["e1"] and mine["e3"] == plain["e3"]
    states = {r["id"]: r["gate_state"] for r in store.recall(["doctor"], day_ms).where("not associative").collect()}
    assert states["e1"] == "pending_confirmation" and states["e2"] == "clear"
    assert [r["owner_id"] for r in store.pending().collect()] == ["e1"]
    store.confirm("e1", 2 * day_ms, "event")
    assert store.pending().count() == 0 and store.recall(["deploying"], day_ms).first()["gate_state"] == "clear"


def test_two_writers_never_share_a_number(spark, tmp_path):
    one, two = MemoryStore(spark, f"file://{tmp_path}"), MemoryStore(spark, f"file://{tmp_path}")
    edge = lambda s: spark.createDataFrame([(s, "x", 1.0)], EDGES)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: (one if i % 2 else two).kb_write(relations=edge(f"n{i}")), range(8)))
    assert sorted(r["src"] for r in one.table("relations").collect()) == [f"n{i}" for i in range(8)]
    # a writer that died has a number, and nothing of it is read; what came after is not compacted away
    one.numbers.create("c00000009")
    edge("lost").withColumn("write_no", F.lit(9).cast("long")).write.parquet(f"file://{tmp_path}/relations/v00000009")
    two.kb_write(relations=edge("later"))
    assert one.last_write() == 8 and one.table("relations").count() == 9
    one.compact("relations")
    assert two.table("relations").count() == 9
