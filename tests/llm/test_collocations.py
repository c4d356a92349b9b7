"""Collocations against plain counting, and the sketches that come before."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hippospark.llm import collocations as co


def plain(rows, longest, least, top, share):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate({i: i + 32 for i in range(65, 91)})):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if a >= least}
        found = []
        for p, a in kept.items():
            if len(p) < 2:
                continue
            around = [q for q in kept if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * kept[q] >= share * a for q in around):
                continue
            score, _, left, right = min((1000 * a * n[lang] // (kept[p[:k]] * kept[p[k:]]), k, kept[p[:k]], kept[p[k:]]) for k in range(1, len(p)))
            found.append((score, a, " ".join(p), left, right))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, left, right, n[lang], score) for i, (score, a, p, left, right) in enumerate(found[:top])]
    return sorted(out)


def texts(seed):
    rng = random.Random(seed)
    words = ["der", "Haus", "日本", "é", "a", "b.c", "x", "y", "zz", "w" * 70, "no break", " "]
    set_phrases = [" ".join(rng.choice(words) for _ in range(rng.randint(2, 6))) for _ in range(5)]
    rows = []
    for _ in range(150):
        parts = [rng.choice([*words, *set_phrases, *set_phrases]) for _ in range(rng.randint(0, 25))]
        rows.append((rng.choice(["de", "en", None, "und", ""]), "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ", ", "\n", "\r\n", "; "]) for p in parts)))
    return [*rows, ("de", None), (None, ""), ("en", " ,. \t"), rows[0], rows[0], rows[1], ("fr", "same same " * 40)]


@pytest.mark.parametrize(("longest", "least", "top", "share", "cells"), [(5, 8, 2000, 100, None), (3, 5, 4, 80, None), (5, 8, 2000, 100, 8), (4, 300, 10, 100, None)])
def test_collocations(spark, longest, least, top, share, cells):
    """The results are the same with a sketch of eight counters, which lets everything through."""
    rows = texts(2)
    docs = spark.createDataFrame([(i, *r, 1, "p", "f") for i, r in enumerate(rows)], "doc_id long, lang string, text string, n_words int, phrase string, block string").repartition(5)
    got = co.collocations(docs, longest, least, top, share, cells)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    expected = plain(rows, longest, least, top, share)
    assert sorted(map(tuple, got.collect())) == expected
    assert bool(expected) == (least < 300)


def test_sketches_of_many_tasks_merge(spark, monkeypatch):
    monkeypatch.setattr(co, "MERGED", 2)
    rows = texts(4)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(9)
    assert sorted(map(tuple, co.collocations(docs, 4, 10, 50, cells=1 << 16).collect())) == plain(rows, 4, 10, 50, 100)


def test_sketch_never_counts_too_little():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 1 << 63, 3_000, dtype=np.uint64) * np.uint64(2)
    drawn = rng.choice(h, 60_000, p=(w := 1 / np.arange(1, 3_001)) / w.sum())
    for cells in (2, 256, 1 << 14):
        sketch = co.Sketch(cells, 100)
        for part in np.array_split(drawn, 7):
            sketch.add(part)
        bits = np.stack([np.packbits(row >= 100, bitorder="little") for row in sketch.rows])
        kept = co.Survivors(cells, bits).has(h)
        count = np.array([Counter(drawn.tolist())[x] for x in h.tolist()])
        assert kept[count >= 100].all()
        assert cells < 1 << 14 or kept[count < 100].mean() < 0.05


def test_score_is_exact_beyond_64_bits(spark):
    rng = random.Random(1)
    rows = [(a, 10**13 - rng.randrange(10**6), a + rng.randrange(10**7), a + rng.randrange(10**9)) for a in (100, 10**6 + 3, 10**11 + 7, 9 * 10**12) for _ in range(20)]
    rows += [(100, 10**13, 100, 100), (3, 1, 1000, 3), (10**12, 10**13, 10**12, 10**12)]
    got = spark.createDataFrame(rows, "a long, n long, l long, r long").select("a", "n", "l", "r", co.score(*map(F.col, "anlr"))).collect()
    assert all(s == 1000 * a * n // (left * right) for a, n, left, right, s in got)


def test_no_phrases(spark):
    assert co.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert co.collocations(spark.createDataFrame([(None, None), ("en", "one two")], "lang string, text string")).count() == 0
