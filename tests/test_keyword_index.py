"""The kept keyword index against one that is built anew after every change."""

import random

import pytest

from hippospark.functions.commits import Folder, Versions
from hippospark.operators import keyword_index
from hippospark.operators.keyword_index import SegmentIndex
from hippospark.operators.retrieval import KeywordIndex

WORDS = ["alpha", "beta", "gamma", "delta", "Über", "日本", "x1", "the"]


def texts(rng, n):
    return " ".join(rng.choice(WORDS[: rng.randint(1, 8)]) for _ in range(n))


@pytest.mark.parametrize("small", [0, 200_000])
def test_index_equals_a_rebuilt_one(spark, tmp_path, monkeypatch, small):
    """After upserts, deletions of what is there and what is not, and merges; all blocks scored, or only those that can reach the top."""
    monkeypatch.setattr(keyword_index, "SMALL", small)
    monkeypatch.setattr(keyword_index, "FIRST", 2)
    rng, held = random.Random(5), {}
    index = SegmentIndex(spark, f"file://{tmp_path}/index", "string", block=3, fanout=2)
    assert index.search(["alpha"]).count() == 0
    for step in range(5):
        new = {f"d{rng.randrange(40)}": rng.choice([texts(rng, rng.randint(1, 30)), texts(rng, 3), "", None]) for _ in range(rng.choice([3, 14]))}
        gone = [f"d{rng.randrange(60)}" for _ in range(4)] if step else []
        index.update(spark.createDataFrame(list(new.items()), "id string, text string"), spark.createDataFrame([(x,) for x in gone if x not in new], "id string") if step else None)
        held = {k: v for k, v in held.items() if k not in gone} | new
        fresh = KeywordIndex.build(spark.createDataFrame(list(held.items()), "id string, text string"), "id", "text")
        assert index.size() == (fresh.n, fresh.words)
        for terms, k in ((["alpha", "the", "ÜBER"], 5), (["beta", "absent"], 3), (["absent"], 3)):
            assert list(map(tuple, index.search(terms, k).collect())) == list(map(tuple, fresh.search(terms, k).collect()))
        few = spark.createDataFrame([(x,) for x in list(held)[::2]], "id string")
        allowed = set(list(held)[::2])
        assert [r["id"] for r in index.search(["alpha", "the"], 4, few).collect()] == [r["id"] for r in fresh.search(["alpha", "the"], 100).collect() if r["id"] in allowed][:4]
    assert len(index.state()[1]["segments"]) < 5
    index.update(deleted=spark.createDataFrame([(x,) for x in held], "id string"))
    assert index.size() == (0, 0) and index.search(["alpha", "the"]).count() == 0


def test_index_notes_with_its_version(spark, tmp_path):
    index = SegmentIndex(spark, f"file://{tmp_path}/index", "long")
    index.update(spark.createDataFrame([(1, "one two"), (None, "lost"), (1, "one")], "n long, t string"), id_col="n", text_col="t", note=7)
    assert index.note() == 7 and index.size() == (1, 2)
    again = SegmentIndex(spark, f"file://{tmp_path}/index", "long")
    assert [r["id"] for r in again.search(["two"]).collect()] == [1]


def test_versions_have_one_writer(spark, tmp_path):
    versions = Versions(spark, f"file://{tmp_path}/v")
    assert versions.last() == (0, {})
    assert versions.put(1, {"a": 1}) and not versions.put(1, {"a": 2})
    assert versions.last() == (1, {"a": 1})
    # what a writer left that died on the way does not count
    (tmp_path / "v" / ".half").write_text("{")
    assert versions.last() == (1, {"a": 1}) and versions.put(2, {}) and Folder(spark, f"file://{tmp_path}/v").names() == ["v00000001", "v00000002"]


def test_a_segment_of_many_parts_equals_a_rebuilt_index(spark, tmp_path, monkeypatch):
    """Texts and blocks are dealt over many tasks; texts without words and rows that share an id are among them."""
    for name, value in (("PART_BYTES", 200), ("PART_WORDS", 20), ("BLOCK_WORDS", 20)):
        monkeypatch.setattr(keyword_index, name, value)
    rng = random.Random(3)
    rows = [(i % 70, rng.choice([texts(rng, rng.randint(1, 30)), "", None])) for i in range(80)]
    index = SegmentIndex(spark, f"file://{tmp_path}/index", "long")
    index.update(spark.createDataFrame(rows, "id long, text string"))
    held = {}
    for i, t in rows:
        held[i] = max((x for x in (held.get(i), t) if x is not None), default=None)
    fresh = KeywordIndex.build(spark.createDataFrame(list(held.items()), "id long, text string"), "id", "text")
    assert index.size() == (fresh.n, fresh.words)
    assert list(map(tuple, index.search(["alpha", "the"], 9).collect())) == list(map(tuple, fresh.search(["alpha", "the"], 9).collect()))


def test_words_are_counted_in_batches():
    """A batch of texts at once, a block of them at once: texts without words keep their place, terms come in byte order."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([5, 6, 7, 8]), pa.array([["b", "a", "b"], None, [], ["ü", "b"]], pa.list_(pa.string()))], ["id", "tokens"])
    (got,) = keyword_index._count_words([batch])
    assert got.column("id").to_pylist() == [5, 6, 7, 8] and got.column("dl").to_pylist() == [3, 0, 0, 2]
    assert [sorted((w["term"], w["tf"]) for w in x) for x in got.column("words").to_pylist()] == [[("a", 1), ("b", 2)], [], [], [("b", 1), ("ü", 1)]]
    block = pa.Table.from_batches([got]).add_column(0, "block", pa.array([4] * 4, pa.int32()))
    rows = [(r["term"], r["block"], sorted((x["id"], x["tf"], x["dl"]) for x in r["rows"]), r["n"], r["most"], r["shortest"]) for r in keyword_index._postings(block).to_pylist()]
    assert rows == [("a", 4, [(5, 1, 3)], 1, 1, 3), ("b", 4, [(5, 2, 3), (8, 1, 2)], 2, 2, 2), ("ü", 4, [(8, 1, 2)], 1, 1, 2)]
    assert keyword_index._postings(block.slice(1, 2)).num_rows == 0
