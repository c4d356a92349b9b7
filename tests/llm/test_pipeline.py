"""Each stage of the pipeline on its own input, against a plain version."""

import random
from collections import Counter

import pytest

import corpus_pipeline as P

from .test_operators import corpus, reference_ids, shingles, texts_that_share_an_id, units_removed

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    return corpus(11, 50)[:-3]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], COLUMNS)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(3 * i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_classifier_keeps_clean_documents(spark, docs, folder):
    out = P.classify(spark, docs, folder)
    assert out.dtypes == docs.dtypes and out.count() == docs.count()


def test_classifier_drops_what_it_was_taught(spark, tmp_path):
    """Against the plain decision: a word of the bad ratings, or shouting, tells; held-out rows, extra names and rows without an id."""
    rng = random.Random(3)
    good = ["river", "stone", "garden", "letter", "window", "summer", "music", "paper"]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(good) for _ in range(40)]
        if i % 4 == 0:
            w[rng.randrange(40)] = "moron"
        elif i % 4 == 1:
            w = [x.upper() + "!!" for x in w]
        rows.append((i if i < 590 else None, " ".join(w), "en", "s", 1, 0.25))
        labels.append((i, int(i % 4 != 1), int(i % 4 == 0)))
    spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.createDataFrame(rows, COLUMNS + ", keep double")
    out = P.classify(spark, df, str(tmp_path))
    assert out.dtypes == df.dtypes
    got = Counter(r["text"] for r in out.collect())
    plain = Counter(r[1] for i, r in enumerate(rows) if i % 4 > 1)
    assert sum((got - plain).values()) + sum((plain - got).values()) <= 6


@pytest.mark.parametrize("parts", [1, 3])
def test_texts_that_share_an_id_stand_for_themselves(spark, folder, parts):
    rows = texts_that_share_an_id()
    df = spark.createDataFrame([(i, t, "en", s, len(t), "a", 1) for i, t, s in rows], COLUMNS + ", _id string, _key long").repartition(parts)
    out = P.drop_near_duplicates(spark, df, folder)
    assert out.dtypes == df.dtypes
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter((i, t) for i, t, _ in rows if i in (3, 5) or not t.endswith(" z"))


def test_one_document_of_each_group_stays(spark, docs, rows, folder):
    sets = {i: shingles(t, 5) for i, t, _ in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    out = P.drop_near_duplicates(spark, docs, folder)
    assert out.dtypes == docs.dtypes
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i in sets if root(i) == i)


def test_repeated_passages_go(spark, docs, rows, folder):
    plain = {i: bytes(b for b, x in zip(u, g, strict=True) if not x).decode("utf-8", "ignore") if g.any() else None for i, u, g in units_removed(rows, lambda t: (t or "").encode(), 50)}
    out = P.drop_repeated_passages(spark, docs, folder)
    assert out.dtypes == docs.dtypes
    texts = {i: t for i, t, _ in rows}
    for r in out.collect():
        expected = texts[r["doc_id"]] if plain[r["doc_id"]] is None else plain[r["doc_id"]]
        assert r["text"] == expected and r["n_chars"] == len(expected or "") and r["lang"] == "en"


def test_mix_takes_whole_documents(spark, docs, rows, folder):
    out = P.mix_sources(spark, docs, folder)
    assert out.dtypes == docs.dtypes
    times = Counter(r["doc_id"] for r in out.collect())
    words = {i: len((t or "").encode().split()) for i, t, _ in rows}
    assert max(times.values()) <= 2 and all(words[i] for i in times)
    total = sum(words[i] * n for i, n in times.items())
    assert abs(total - 1.5 * sum(words.values())) <= 0.15 * 1.5 * sum(words.values())


def test_mix_keeps_documents_without_an_id(spark, docs, rows, folder):
    extra = [(None, f"nameless {k} " * 40, "en", "src0", 0) for k in "abcdef"]
    out = [r["text"] for r in P.mix_sources(spark, docs.unionByName(spark.createDataFrame(extra, COLUMNS)), folder).collect()]
    assert sum("nameless" in (t or "") for t in out) > 0


def test_mix_leaves_the_order_of_the_shards(spark, docs, folder):
    out = P.mix_sources(spark, docs, folder).collect()
    ids = [r["doc_id"] for r in out]
    again = [r["doc_id"] for r in P.mix_sources(spark, docs.repartition(5), folder).collect()]
    assert ids == again and ids != sorted(ids)


def test_packed_sequences(spark, docs, rows, folder):
    out = P.pack_sequences(spark, docs, folder).collect()
    tokens = {i: len(ids) + 1 for (i, _, _), ids in zip(rows, reference_ids([t for _, t, _ in rows]), strict=True)}
    assert Counter({i: sum(r["length"] for r in out if r["doc_id"] == i) for i in tokens}) == Counter(tokens)
    held = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == held.get(r["sequence_id"], 0)
        held[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(held.values()) <= 1024 and len(held) == out[0]["n_sequences"] >= out[0]["least_sequences"] >= -(-sum(tokens.values()) // 1024)


def test_run_on_an_empty_table(spark, folder, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
