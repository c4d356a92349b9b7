"""Every operator against a plain version, on rows with nulls, empty and long texts, copies and repeated rows."""

import hashlib
import itertools
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from hippospark.llm import collision_ann, fingerprints, mixing, packing, parity_join, quality, sharding, substring_dedup, suffix_dedup, tokens
from hippospark.llm import common as C

#: Names that the operators use inside, as columns of the caller.
CLASHING = "doc_id long, text string, source string, text_key string, start int, n int, a string, bucket string, rest string, marks string, size string, hash string"


def alternating(one="a", two="b", times=10):
    """Words that polynomial hashes modulo a power of two take for equal."""
    word, other = one, two
    for _ in range(times):
        word, other = word + other, other + word
    return word, other


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß日") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(70))
    texts = []
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 160))]
        kind = rng.random()
        if kind < 0.2 and texts:
            texts.append(rng.choice(texts))
        elif kind < 0.4 and texts:
            old = (rng.choice(texts) or "").split(" ")
            for _ in range(rng.randint(1, 3)):
                old[rng.randrange(len(old))] = rng.choice(vocabulary)
            texts.append(" ".join(old))
        elif kind < 0.6:
            at = rng.randint(0, len(words))
            texts.append(" ".join([*words[:at], passage, *words[at:]]))
        else:
            texts.append(rng.choice(["\n", " ", "\t"]).join(words))
    texts += [None, "", "   ", "One two.", "x", " ".join(rng.choice(vocabulary) for _ in range(6000)), "A b C d e", "a B c D e"]
    for word in alternating():
        texts += [f"see {word}", f"q r s t {word}", " ".join([*passage.split(" ")[:30], word, *passage.split(" ")[30:60]])]
    rows = [(i * 3, t, f"src{i % 5}" if i % 7 else None) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], rows[5]]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, "a", "b", "r", "m", "s", "h") for r in rows], CLASHING).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASHING)


def units_removed(rows, split, window):
    """For each row which units a window covers that starts in a smaller document."""
    first = {}
    for i, t, _ in rows:
        u = split(t)
        for x in range(len(u) - window + 1):
            k = tuple(u[x : x + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t, _ in rows:
        u = split(t)
        gone = np.zeros(len(u), bool)
        for x in range(len(u) - window + 1):
            if first[tuple(u[x : x + window])] < i:
                gone[x : x + window] = True
        out.append((i, u, gone))
    return out


def test_substring_dedup(docs, rows, empty):
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.substring_dedup(docs).collect())
    plain = units_removed(rows, lambda t: (t or "").encode().split(), 50)
    assert got == sorted((i, len(u), int(g.sum()), b" ".join(w for w, x in zip(u, g, strict=True) if not x).decode()) for i, u, g in plain)
    assert any(x[2] for x in got)
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_passage_repeated_within_a_document(spark):
    """An earlier document holds a part of what a later one holds twice."""
    rng = random.Random(6)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for i in range(6):
        passage = fresh(200)
        rows.append((10 * i, " ".join([*fresh(20), *passage[40:160], *fresh(20)]), None))
        rows.append((10 * i + 1, " ".join([*fresh(30), *passage, *fresh(30), *passage, *fresh(30)]), None))
    rows.append((11, rows[3][1] + " end " + rows[3][1], None))
    out = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = sorted((r["doc_id"], r["n_removed"]) for r in out.collect())
    plain = units_removed(rows, lambda t: t.encode().split(), 50)
    assert got == sorted((i, int(g.sum())) for i, _, g in plain)
    assert (1, 240) in got


def test_index_finds_history_over_batches_and_compaction(spark):
    text = " ".join(f"w{i}" for i in range(60))
    index = substring_dedup.FingerprintIndex(fanout=2)
    seen = []
    for i in range(4):
        batch = spark.createDataFrame([(i, text), (100 + i, f"other {i} " * 40)], "doc_id long, text string")
        seen.append(index.ingest(batch)[0].count())
        assert len(index.tables) <= 2
    assert seen[0] == 0 and all(seen[1:])


def test_suffix_dedup(docs, rows, empty):
    out = suffix_dedup.suffix_dedup(docs)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out.collect())
    expected = []
    for i, u, g in units_removed(rows, lambda t: (t or "").encode(), 50):
        spans = int(np.count_nonzero(np.diff(np.concatenate(([False], g)).astype(int)) == 1))
        expected.append((i, len(u), int(g.sum()), spans, bytes(b for b, x in zip(u, g, strict=True) if not x)))
    assert got == sorted(expected)
    assert out.select("rest.start", "rest.marks").first() is not None
    assert suffix_dedup.suffix_dedup(empty).count() == 0


@pytest.mark.parametrize("alphabet", [b"a", b"ab", bytes(range(256))])
def test_suffix_order_against_sorting(alphabet):
    rng = random.Random(4)
    text = bytes(rng.choice(alphabet) for _ in range(500))
    wanted = np.zeros(len(text), bool)
    wanted[: len(text) - 50 : 2] = True
    order, same = suffix_dedup.suffix_order(np.frombuffer(text, np.uint8), wanted)
    keys = [text[i : i + 50] for i in order]
    assert keys == sorted(keys) and sorted(order) == list(np.flatnonzero(wanted))
    assert list(same[1:]) == [a == b for a, b in zip(keys, keys[1:], strict=False)]


@pytest.mark.parametrize("most", [200, 3000, 1 << 20])
def test_frequent_anchors_in_goes(most):
    rng = random.Random(2)
    n = np.array([rng.randint(1, 27) for _ in range(400)])
    common = bytes(rng.choice(b"ab") for _ in range(76))
    spans = []
    for k in n:
        text = bytearray(common[: k + 49])
        if rng.random() < 0.7:
            text[rng.randrange(len(text))] = rng.choice(b"xyz")
        spans.append(bytes(text))
    first = np.array([rng.randint(0, 300) for _ in n])
    least = {}
    for s, f in zip(spans, first, strict=True):
        for i in range(len(s) - 49):
            least[s[i : i + 50]] = min(least.get(s[i : i + 50], 999), f)
    wanted = [least[s[i : i + 50]] < f for s, f in zip(spans, first, strict=True) for i in range(len(s) - 49)]
    body = np.frombuffer(b"".join(spans), np.uint8)
    assert suffix_dedup.repeats_of_many(body, n, first, most=most).tolist() == wanted == suffix_dedup.repeats(body, n, first).tolist()


def shingles(text, k):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 50, 100)])
def test_jaccard_components(docs, rows, empty, k, num, den):
    sets = defaultdict(list)
    for i, t, _ in rows:
        sets[i] = shingles(t, k)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = sorted(tuple(r) for r in parity_join.jaccard_components(docs, k, num, den).collect())
    assert got == sorted((i, len(sets[i]), root(i)) for i, _, _ in rows)
    assert parity_join.jaccard_components(empty, k, num, den).count() == 0


def texts_that_share_an_id():
    """5 twice, with other texts; 7 is near the first of them, 9 near the second, and 9 has a text of its own too."""
    rng = random.Random(2)
    base, other, own = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(60)) for x in "bow")
    return [(5, base, "s"), (5, other, "s"), (7, base + " z", "s"), (9, other + " z", "s"), (9, own, "s"), (11, own + " z", "s"), (5, base, "s"), (3, "alone", "s")]


@pytest.mark.parametrize("parts", [1, 3, 5])
def test_components_of_texts_that_share_an_id(spark, parts):
    rows = texts_that_share_an_id()
    out = parity_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts))
    n = {t: len(shingles(t, 4)) for _, t, _ in rows}
    wanted = dict(zip([t for _, t, _ in rows], [5, 5, 5, 5, 9, 9, 5, 3], strict=True))
    assert Counter(map(tuple, out.collect())) == Counter((i, n[t], wanted[t]) for i, t, _ in rows)


def test_large_groups_of_near_copies(spark):
    """More members under a key than the forest's limit, at all likenesses."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t, 4) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    out = parity_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == {i: root(i) for i in sets}


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(0)
    for n in (5, 80, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[n // 5 :], rng.integers(0, 1 << 63, n // 7 + 1).astype(np.uint64))))
        bits = parity_join.places(min(len(a), len(b)))
        apart = np.bitwise_count(parity_join.fold(parity_join.parity(a), bits) ^ parity_join.fold(parity_join.parity(b), bits)).sum()
        assert apart <= len(np.setxor1d(a, b))


def test_fingerprints(docs, rows, empty, spark):
    got = fingerprints.compare_edits(docs).collect()
    order = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: r)
    texts = [t for _, t in order]
    expected = Counter()
    for at, (i, t) in enumerate(order):
        other = texts[(at + 1) % len(texts)]
        q = len(t) // 4
        expected[(i, len(t), hashlib.sha256((t[: len(t) - q] + other[:q]).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == expected
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    same = defaultdict(set)
    for (i, t), _ in zip(order, got, strict=True):
        same[t] |= {r["fingerprint"] for r in got if r["doc_id"] == i}
    assert all(len(v) == 1 for v in same.values())
    assert fingerprints.compare_edits(empty).count() == 0
    one = fingerprints.compare_edits(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0


def test_fingerprints_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "PART_BYTES", 500)
    rows = [(i * 7, f"{i} " * (i % 40 + 1)) for i in range(80)]
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.compare_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for at, (i, t) in enumerate(rows):
        assert got[i] == hashlib.sha256(fingerprints.edited(t, rows[(at + 1) % len(rows)][1]).encode()).hexdigest()


def test_sketches_merge_and_contain():
    data = " ".join(f"w{i}" for i in range(4000)).encode()
    half = data[: len(data) // 2]
    both = np.frombuffer(data + half, np.uint8)
    whole, part = fingerprints.sketches(both, np.array([0, len(data), len(data) + len(half)]))
    assert fingerprints.containment(part, whole) > 0.98 and 0.4 < fingerprints.containment(whole, part) < 0.6
    assert np.array_equal(fingerprints.merged(part, whole).kept, np.union1d(part.kept, whole.kept))
    assert np.array_equal(fingerprints.decoded(fingerprints.coded(whole)).kept, whole.kept)


def plain_sketch(text, k=5):
    """Hashes of the shingles one by one: those below a quarter of the range, and the least where there is none."""
    words = (text or "").encode().split()
    grams = [words[i : i + k] for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = set()
    for gram in grams:
        body = np.frombuffer(b" ".join(gram), np.uint8)
        starts, ends, _ = tokens.C.words(body, np.array([0, len(body)]))
        units = tokens.C.word_hashes(body, starts, ends)
        hashes.add(int(tokens.C.TWO.span(tokens.C.TWO.prefix(units), np.array([0]), np.array([len(units)]))[0]) >> 16)
    kept = {h for h in hashes if h < 1 << 46}
    return kept, min(hashes) if hashes and not kept else None


def test_fingerprints_against_one_shingle_at_a_time(docs, rows):
    got = fingerprints.compare_edits(docs).collect()
    texts = [t for _, t in sorted(((i, t or "") for i, t, _ in rows))]
    next_of = {}
    for at, t in enumerate(texts):
        next_of.setdefault(t, set()).add(texts[(at + 1) % len(texts)])

    def alike(a, b):
        (x, p), (y, q) = a, b
        return len(x & y) / len(x | y) if x or y else float(p == q)

    by_id = {i: t or "" for i, t, _ in rows}
    for r in got:
        own = plain_sketch(by_id[r["doc_id"]])
        sketch = fingerprints.decoded(r["fingerprint"])
        assert (set(sketch.kept.tolist()), sketch.least) == own
        assert any(r["near_next"] == pytest.approx(alike(own, plain_sketch(n))) for n in next_of[by_id[r["doc_id"]]])
        edits = [fingerprints.edited(by_id[r["doc_id"]], n) for n in next_of[by_id[r["doc_id"]]]]
        assert any(r["near_edited"] == pytest.approx(alike(own, plain_sketch(e))) for e in edits)


def test_short_texts_keep_no_hash_above_the_threshold():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    whole, *_ = fingerprints.sketches(np.frombuffer(" ".join(words).encode(), np.uint8), np.array([0, len(" ".join(words))]))
    for _ in range(200):
        at = rng.randrange(len(words) - 6)
        short = " ".join(words[at : at + 6]).encode()
        part, = fingerprints.sketches(np.frombuffer(short, np.uint8), np.array([0, len(short)]))
        both = fingerprints.merged(part, whole)
        assert both.kept.max() < 1 << 46 and np.array_equal(both.kept, whole.kept) and both.least is None
        assert fingerprints.containment(part, whole) == 1.0 if len(part.kept) else np.isnan(fingerprints.containment(part, whole))


def test_fingerprints_of_far_apart_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "PART_BYTES", 400)
    rows = [(i, f"{i} " * (i % 40 + 1)) for i in range(80)] + [(1 << 60, "far off"), (-(1 << 60), "before all")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.compare_edits(df).collect()}
    rows.sort()
    for at, (i, t) in enumerate(rows):
        assert got[i] == hashlib.sha256(fingerprints.edited(t, rows[(at + 1) % len(rows)][1]).encode()).hexdigest()
    assert fingerprints.with_next(df).groupBy("part").count().where("count > 30").count() == 0


def test_mixing(docs, rows, empty):
    sized = docs.drop("size").withColumn("size", mixing.word_count("text"))
    sized = sized.select("doc_id", "source", "size")
    fields = ("row.doc_id", "row.source", "size", "source_size", "target", "taken", "shards", "slots")
    got, again = (mixing.mix(x, F.col("size")).select(*fields).collect() for x in (sized, sized.repartition(5)))
    key = lambda r: (r["doc_id"], r["size"], r["taken"], r["shards"], r["slots"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    words = {(i, len((t or "").encode().split())) for i, t, _ in rows}
    assert {(r["doc_id"], r["size"]) for r in got} == words and len(got) == len(rows)
    by = defaultdict(lambda: [0, 0, 0.0, 0])
    for r in got:
        s = by[r["source"]]
        s[0] += r["size"]
        s[1], s[2] = r["source_size"], r["target"]
        s[3] += r["taken"]
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * len(r["shards"])
    names = sorted((x for x in by if x is not None)) + [None] * (None in by)
    weight = {x: (3, 1, 2)[i % 3] for i, x in enumerate(names)}
    left, free, target = 1.5 * sum(by[x][0] for x in names), set(names), {}
    while True:
        share = {x: left * weight[x] / sum(weight[y] for y in free) for x in free}
        over = [x for x in free if share[x] > 2 * by[x][0]]
        if not over:
            target |= share
            break
        for x in over:
            target[x] = 2 * by[x][0]
            left -= target[x]
            free.discard(x)
    for x in names:
        assert by[x][0] == by[x][1] and by[x][2] == pytest.approx(target[x])
        assert abs(by[x][3] - target[x]) <= 0.1 * target[x] + 60
    assert mixing.mix(empty, F.lit(1)).count() == 0


def test_mixing_orders_every_shard(docs):
    """All columns of the caller come back, whatever their names."""
    size = mixing.word_count("text")
    got, again = (sorted((r["row"]["doc_id"] if r["row"]["doc_id"] is not None else -1, r["size"], r["shards"], r["slots"]) for r in mixing.mix(x, size).collect()) for x in (docs, docs.repartition(5)))
    assert got == again and all(len(r[2]) == len(r[3]) for r in got)
    assert mixing.mix(docs, size).select("row.*").columns == docs.columns
    by = defaultdict(list)
    for i, _, shards, slots in got:
        for copy in zip(shards, slots, strict=True):
            by[copy[0]].append((copy[1], i))
    assert any([i for _, i in sorted(v)] != sorted(i for _, i in v) for v in by.values())


def test_mixing_of_many_blocks_and_a_hot_id(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 50)
    rng = random.Random(1)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"s{min(i % 7, 2)}", rng.randint(1, 30), i) for i in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, n int, other long"), F.col("n")).select("row.*", "target", "source_size", "taken", "shards").collect()
    assert len(got) == 900 and max(Counter(x for r in got for x in r["shards"]).values()) < 0.2 * 900
    for name in ("s0", "s1", "s2"):
        mine = [r for r in got if r["source"] == name]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 30 and all(r["taken"] <= 2 * r["n"] for r in mine)


def test_splitting_tree_keeps_quotas(spark):
    quotas = spark.createDataFrame([(1, 10), (2, 0), (3, 1000), (4, 7)], "source_rank int, n long")
    got = mixing.splitting_tree(quotas, 3).collect()
    by_source, by_shard = Counter(), Counter()
    for r in got:
        assert r["quota"] >= 0
        by_source[r["source_rank"]] += r["quota"]
        by_shard[r["shard"]] += r["quota"]
    assert by_source == Counter({1: 10, 2: 0, 3: 1000, 4: 7}) and max(by_shard.values()) - min(by_shard.values()) <= 1


def ann_case(spark, n, dim, asked):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((n, dim)) * rng.uniform(0.5, 2, (n, 1))
    v[10] = v[20]
    ids = list(range(n))
    ids[21] = 20  # two rows share an id, one of them is the other's candidate
    ids[41], v[41] = 40, v[40]  # and two rows are equal
    bad = [(10_000, None), (10_020, [0.0] * dim), (10_040, [float("nan")] * dim), (10_060, [None] + [1.0] * (dim - 1)), (10_080, [float("inf")] * dim), (10_101, [1.0, 2.0]), (None, [1.0] * dim), (10_120, [])]
    df = collision_ann.clean(spark.createDataFrame([(i, [float(x) for x in r]) for i, r in zip(ids, v, strict=True)] + bad, "vec_id long, embedding array<double>"))
    got = collision_ann.search(df, asked, 20).collect()
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_row"], r["rank"])):
        found[(r["query_id"], r["query_row"])].append((r["vec_id"], r["score"], r["rank"]))
    queries = [i for i in range(n) if ids[i] % 20 == 0]
    assert Counter(q for q, _ in found) == Counter(ids[i] for i in queries)
    lists = defaultdict(list)
    for (q, _), hit in found.items():
        lists[q].append(hit)
        assert [x[2] for x in hit] == list(range(1, 21)) and [(-x[1], x[0]) for x in hit] == sorted((-x[1], x[0]) for x in hit)
    hits = 0
    for i in queries:
        score = (v * v[i]).sum(axis=1)
        score[i] = -np.inf
        best = [(ids[j], score[j]) for j in np.lexsort((ids, -score))[:20]]
        own = max(lists[ids[i]], key=lambda hit: len({(x, round(s, 9)) for x, s, _ in hit} & {(x, round(s, 9)) for x, s in best}))
        hits += len({(x, round(s, 9)) for x, s, _ in own} & {(x, round(s, 9)) for x, s in best})
    assert hits / (20 * len(queries)) >= 0.9
    return df


def test_nearest_neighbours(spark):
    df = ann_case(spark, 700, 24, "vec_id % 20 = 0")
    assert collision_ann.search(df.where("vec_id < 0"), "true", 20).count() == 0
    assert collision_ann.search(df.where("vec_id < 5"), "vec_id = 0", 20).count() == 4


def test_nearest_neighbours_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(collision_ann, "BLOCK", 256)
    monkeypatch.setattr(collision_ann, "QUERIES", 16)
    ann_case(spark, 1500, 64, "vec_id % 20 = 0")


def test_classifier(spark):
    rng = random.Random(5)
    good = ["river", "stone", "garden", "letter", "window", "summer", "music", "paper"]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(good) for _ in range(40)]
        kind = i % 4
        if kind == 0:
            w[rng.randrange(40)] = rng.choice(["idiot", "moron"])
        elif kind == 1:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w), "extra", 0.5))
        labels.append((i, 0 if kind == 1 else 1, 1 if kind == 0 else 0))
    docs = spark.createDataFrame([*rows, (900, None, "e", 0.1), (901, "", "e", 0.1), (None, "river stone", "e", 0.1)], "doc_id long, text string, score string, keep double")
    ratings = spark.createDataFrame([*labels[:300], (5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, ratings)
    out = {r["row"]["doc_id"]: r for r in quality.grade(docs, model).collect()}
    assert len(out) == 403 and out[3]["row"]["score"] == "extra" and out[3]["row"]["keep"] == 0.5  # the caller's own columns
    right = sum(out[i]["keep"] == (i % 4 > 1) for i in range(300, 400))
    assert right >= 95
    assert all(0 <= r["p_good"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in out.values())
    assert all(r["keep"] for r in quality.grade(docs, quality.fit(docs, ratings.limit(0))).collect())
    assert quality.grade(docs.limit(0), model).count() == 0
    # scores, tails and expected grades again, one document at a time
    for i, text, *_ in rows[::37]:
        data = np.frombuffer(text.encode(), np.uint8)
        f, _ = quality.features(data, np.array([0, len(data)]))
        score = sum(float(model.weights[j]) for j in set(f.tolist()))
        above = [1 - 1 / (1 + math.exp(score - t)) if score < t else 1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert out[i]["score"] == pytest.approx(score, abs=1e-6) and out[i]["p_good"] == pytest.approx(above[-1], abs=1e-6) and out[i]["expected_grade"] == pytest.approx(sum(above), abs=1e-6)
    assert list(model.thresholds) == sorted(model.thresholds)


def test_ordinal_fit_against_plain_gradient_descent():
    """On a small problem the fit comes to the likelihood of an independent maximum, and held-out ratings to its accuracy."""
    rng = np.random.default_rng(4)
    x = rng.random((900, 12)) < 0.4
    true = np.array([2.5, -2.5, 1.5, -1.5, 1, -1, 0.5, -0.5, 0, 0, 0, 0])
    noise = np.log(1 / rng.random(900) - 1)
    y = np.digitize(x @ true + noise, [-1.0, 1.0])
    rows = [np.flatnonzero(r) for r in x]
    model = quality.Ordinal(bits=4).fit(rows[:600], y[:600], epochs=60, slow=1.0)

    def chances(w, b, data):
        c = 1 / (1 + np.exp(-(np.asarray(b)[None, :] - (data @ w)[:, None])))
        return np.stack((c[:, 0], c[:, 1] - c[:, 0], 1 - c[:, 1]), axis=1)

    def loss(p, data, grade):
        c = chances(p[:12], (p[12], p[12] + np.exp(p[13])), data)
        return -np.log(np.maximum(c[np.arange(len(grade)), grade], 1e-12)).mean()

    p = np.zeros(14)
    for _ in range(400):  # numeric gradients: nothing shared with the code under test
        g = np.array([(loss(p + d, x[:600], y[:600]) - loss(p - d, x[:600], y[:600])) / 2e-5 for d in np.eye(14) * 1e-5])
        p -= 1.0 * g
    plain = (chances(p[:12], (p[12], p[12] + np.exp(p[13])), x[600:]).argmax(axis=1) == y[600:]).mean()
    fitted = (chances(model.weights[:12], model.thresholds, x[600:]).argmax(axis=1) == y[600:]).mean()
    assert fitted >= plain - 0.05


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_hashes_of_bytes():
    """They tell apart what differs in a byte or in length, wherever it stands, and nothing else."""
    rng = random.Random(4)
    parts = [bytes(rng.choice(b"ab\0") for _ in range(n)) for n in [*range(0, 20), 63, 64, 65, 71, 130] for _ in range(4)] + [x.encode() for x in alternating() + alternating(times=3)]
    data, edge = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
    h = C.byte_hashes(data, edge[:-1], edge[1:]).tolist()
    assert len(set(h)) == len(set(parts)) == len(set(zip(h, parts, strict=True)))
    assert not len(C.byte_hashes(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)))


def test_encoder_equals_tokenizer():
    rng = random.Random(3)
    bits = ["a", "B", "the", " ", " ", "\n", ".", ",", "'s", "é", " ", "　", "1", "\t", "!?", "…", "日", " ", "\x85", "\x1c", "<|endoftext|>", "🙂"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 16))) for _ in range(2500)] + [t for _, t, _ in corpus(9, 20)]
    import pyarrow as pa

    coder, got = tokens.Encoder(tokens.vocabulary()), []
    for _, data, off in tokens.C.slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]), "text", 2000):
        ids, at = coder.encode(data, off)
        got += [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)]
    assert got == reference_ids(texts)


def test_histogram(docs, rows, empty):
    n = np.array([len(x) for x in reference_ids([t for _, t, _ in rows])])
    bars = tokens.length_histogram(docs).orderBy("length").collect()
    assert [(r["length"], r["n_docs"]) for r in bars] == sorted(Counter(n.tolist()).items())
    for r in bars:
        assert r["n_truncated"] == np.minimum(n, r["length"]).sum() and r["docs_ge"] == (n >= r["length"]).sum() and r["n_total"] == n.sum()
    assert tokens.truncated_total(tokens.length_histogram(docs), 100) == np.minimum(n, 100).sum()
    assert tokens.length_histogram(empty).count() == 0


def test_packing(docs, rows, empty):
    got = packing.pack(docs, with_ids=True, bucket_rows=20).collect()
    expected = Counter()
    for (i, _, _), ids in zip(rows, reference_ids([t for _, t, _ in rows]), strict=True):
        ids = [*ids, 2]
        count = -(-len(ids) // 1024)
        cuts = [0, *(len(ids) - (count - 1 - k) * 1024 for k in range(count))]
        for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            expected[(i, k, x, y - x, zlib.crc32(np.array(ids[x:y], "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
    for held in by.values():
        at = 0
        for o, n in sorted(held):
            assert o == at
            at += n
        assert at <= 1024
    total = sum(r["length"] for r in got)
    assert len(by) <= -(-total // 1024) + 2
    assert packing.pack(empty).count() == 0


def fewest_bins(sizes, capacity):
    """Exhaustive search over all ways to place the pieces."""
    sizes, best = sorted(sizes, reverse=True), len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= sizes[i]:
                other = list(rooms)
                other.remove(room)
                place(i + 1, [*other, room - sizes[i]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


def test_bin_completion_is_optimal_over_all_bins():
    rng = random.Random(8)
    cases = [([18, 14, 14, 13, 13, 11, 8, 6, 6, 6, 5, 4], 30)]
    for _ in range(700):
        capacity = rng.choice([20, 30, 60])
        cases.append(([rng.randint(2, capacity // 2) if rng.random() < 0.7 else rng.randint(1, capacity) for _ in range(rng.randint(1, 12))], capacity))
    for sizes, capacity in cases:
        plan = packing.complete_bins(dict(Counter(sizes)), capacity)
        used = Counter()
        for copies, fill in plan.patterns:
            assert copies > 0 and sum(fill) <= capacity
            for x in fill:
                used[x] += copies
        assert used == Counter(sizes) and sum(c for c, _ in plan.patterns) == plan.bins
        assert plan.bins == plan.bound == fewest_bins(sizes, capacity)


def test_bin_completion_beyond_its_nodes_reports_the_bound():
    rng = np.random.default_rng(2)
    lengths = np.minimum(1024, (rng.lognormal(5.5, 1, 200_000) + 1).astype(int))
    counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
    plan = packing.complete_bins(counts, nodes=50)
    used = Counter()
    for copies, fill in plan.patterns:
        assert sum(fill) <= 1024
        for x in fill:
            used[x] += copies
    assert used == counts and -(-int(lengths.sum()) // 1024) <= plan.bound <= plan.bins
    assert packing.complete_bins({}).bins == 0


@pytest.mark.parametrize(("copies", "low", "high", "capacity"), [(2, 200, 399, 1024), (3, 150, 512, 1024), (3, 300, 1023, 2048), (1, 600, 2048, 4096)])
def test_bin_completion_ends_whatever_the_lengths(copies, low, high, capacity):
    """Many lengths with many dominated fillings: every filling that is looked at counts, and no call is deeper than the lengths."""
    counts = dict.fromkeys(range(low, high + 1), copies)
    began = time.perf_counter()
    plan = packing.complete_bins(counts, capacity, nodes=1_000)
    assert time.perf_counter() - began < 30
    used = Counter()
    for n, fill in plan.patterns:
        assert sum(fill) <= capacity
        for x in fill:
            used[x] += n
    left = np.zeros(capacity + 1, np.int64)
    left[list(counts)] = copies
    assert used == counts and plan.bound <= plan.bins <= sum(n for n, _ in packing.best_fit(left, capacity))
    assert plan.nodes <= 1_000 + len(counts)


def test_fillings_and_dominance_against_plain_ones():
    rng = random.Random(12)
    for _ in range(300):
        room = rng.randint(1, 14)
        left = np.array([0, *(rng.choice([0, 0, 1, 1, 2, 5]) for _ in range(room))])
        sizes = np.flatnonzero(left)[::-1].tolist()
        plain = [[]]
        for x in sizes:
            plain = [f + [x] * k for f in plain for k in range(int(left[x]), -1, -1) if sum(f) + x * k <= room]
        got = list(packing.completions(room, left, room))
        assert sorted(got) == sorted((room - sum(f), f) for f in plain) and [w for w, _ in got] == sorted(w for w, _ in got)
        for waste, fill in got:
            subsets = {(sum(c), len(c)) for n in range(len(fill) + 1) for c in itertools.combinations(fill, n)}
            rest = {x for x in sizes if left[x] > fill.count(x)}
            assert packing.dominated(fill, waste, left) == any(s < x <= s + waste or x == s and n > 1 for s, n in subsets for x in rest)


def test_sharding(docs, rows, empty, spark):
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    clash = docs.withColumns({"_h": F.lit(1), "row": F.lit(2), "shard": F.lit(3), "slot": F.lit(4), "bucket": F.lit(5)})
    got = sharding.shard(clash, size, shards=7, bucket_bytes=4000).select("row.doc_id", "row.text", "shard", "slot").collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, t) for i, t, _ in rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and all(sorted(s) == list(range(len(s))) for s in by.values())
    again = sharding.shard(clash.repartition(5), size, shards=7, bucket_bytes=4000).select("row.doc_id", "shard", "slot").collect()
    assert Counter((r["doc_id"], r["shard"], r["slot"]) for r in got) == Counter((r["doc_id"], r["shard"], r["slot"]) for r in again)
    assert sharding.shard(empty, F.lit(1)).count() == 0
    # a hot id, and rows without one, are scattered like others
    hot = spark.createDataFrame([(None if i % 2 else 3, f"text {i}") for i in range(300)], "doc_id long, text string")
    scattered = sharding.shard(hot, F.octet_length("text"), shards=4, bucket_bytes=200).select("row.doc_id", "shard", "slot").collect()
    assert len(scattered) == 300 and {r["doc_id"] for r in sorted(scattered, key=lambda r: (r["shard"], r["slot"]))[:20]} == {None, 3}


def test_the_sharding_query_moves_whole_records(docs, spark, tmp_path, monkeypatch):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen, shard = [], sharding.shard
    monkeypatch.setattr(sharding, "shard", lambda d, *a, **k: seen.append(d.columns) or shard(d, *a, **k))
    got = sharding.op8_sharding(spark, str(tmp_path)).collect()
    assert seen == [docs.columns] and len(got) == docs.count()


def test_written_shards_come_back_whole_and_in_order(docs, rows, spark, tmp_path):
    sharding.write_shards(docs, f"{tmp_path}/shards", shards=5)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert Counter((r["doc_id"], r["text"]) for r in back.select("row.*").collect()) == Counter((i, t) for i, t, _ in rows)
    for k in range(5):
        files = list(tmp_path.glob(f"shards/shard={k}/*.parquet"))
        assert len(files) == 1
        slots = pq.read_table(files[0], partitioning=None).column("slot").to_pylist()
        assert slots == list(range(len(slots)))


def test_rows_without_an_id(spark, rows):
    """They take part with the results that the operators define, and change nothing for the others."""
    mine = rows[:25]
    extra = [(None, mine[3][1], "s"), (None, "one two three four five six seven " * 12, "s"), (None, None, None)]
    alone, both = (spark.createDataFrame(x, "doc_id long, text string, source string").repartition(3) for x in (mine, mine + extra))

    def more(run, *fields):
        with_them, without = (Counter(tuple(bytes(r[f]) if isinstance(r[f], bytearray) else r[f] for f in fields) for r in run(x).collect()) for x in (both, alone))
        assert not without - with_them
        return with_them - without

    words = lambda t: (t or "").split()
    assert more(substring_dedup.substring_dedup, "doc_id", "n_words", "n_removed", "kept_text") == Counter((None, len(words(t)), 0, " ".join(words(t))) for _, t, _ in extra)
    assert more(suffix_dedup.suffix_dedup, "doc_id", "n_bytes", "n_removed", "n_spans", "kept") == Counter((None, len((t or "").encode()), 0, 0, (t or "").encode()) for _, t, _ in extra)
    assert more(parity_join.jaccard_components, "doc_id", "n_shingles", "component_id") == Counter((None, len(shingles(t, 4)), None) for _, t, _ in extra)
    ids = [len(x) + 1 for x in reference_ids([t for _, t, _ in extra])]
    assert sum(n for (_, n), k in more(packing.pack, "doc_id", "length").items() for _ in range(k)) == sum(ids)
    assert more(lambda d: sharding.shard(d, F.lit(20)).select("row.doc_id", "row.text"), "doc_id", "text") == Counter((None, t) for _, t, _ in extra)
    assert more(lambda d: fingerprints.fingerprint(d).select("row.doc_id", "fingerprint"), "doc_id", "fingerprint") == Counter((None, fingerprints.coded(fingerprints.sketches(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0])) for _, t, _ in extra)
    edits = fingerprints.compare_edits(both).collect()
    assert sum(r["doc_id"] is None for r in edits) == 3 and len(edits) == len(mine) + 3
    last = max((r for r in edits if r["doc_id"] is not None), key=lambda r: r["doc_id"])
    text = dict((i, t or "") for i, t, _ in mine)[last["doc_id"]]
    # after the last comes the first: rows without an id, the empty one of them first
    assert last["edited_sha256"] == hashlib.sha256(fingerprints.edited(text, "").encode()).hexdigest()
    taken = [r for r in mixing.mix(both, mixing.word_count("text")).select("row.doc_id", "size", "taken").collect() if r["doc_id"] is None]
    assert len(taken) == 3 and all(r["taken"] <= 2 * r["size"] for r in taken)
