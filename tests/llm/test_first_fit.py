"""First-fit decreasing packing against a plain one, and against the tokenizer's ids."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from hippospark.llm import first_fit

from .test_operators import corpus


def plain_first_fit(lengths, capacity):
    room, out = [], []
    for x in lengths:
        at = next((i for i, r in enumerate(room) if r >= x), len(room))
        if at == len(room):
            room.append(capacity)
        room[at] -= x
        out.append(at)
    return out


@pytest.mark.parametrize("capacity", [7, 16, 100])
def test_tournament_finds_the_first_that_fits(capacity):
    rng = random.Random(capacity)
    for n in [0, 1, 2, 3, 50, 400]:
        lengths = sorted((rng.randint(1, capacity) for _ in range(n)), reverse=True)
        assert first_fit.first_fit_decreasing(lengths, capacity) == plain_first_fit(lengths, capacity)


@pytest.mark.parametrize("capacity", [8, 12, 64])
def test_levelled_sequences_need_no_padding(capacity):
    rng = random.Random(capacity)
    for _ in range(300):
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 40))), reverse=True)
        out = first_fit.plan(lengths, capacity)
        by = defaultdict(list)
        for i, before, n, to, at in out:
            assert n > 0
            by[to].append((at, n))
        for held in by.values():
            held.sort()
            assert [a for a, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))]
            total = sum(n for _, n in held)
            assert total == capacity or total < capacity and total & (total - 1) == 0
        told = defaultdict(list)
        for i, before, n, *_ in out:
            told[i].append((before, n))
        assert {i: [b for b, _ in sorted(x)] for i, x in told.items()} == {i: [sum(n for _, n in sorted(x)[:k]) for k in range(len(x))] for i, x in told.items()}
        assert [sum(n for _, n in told[i]) for i in range(len(lengths))] == lengths


def encoded(texts):
    import public_tokenizers

    return [x.ids + [1] for x in Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_packing(spark):
    rows = corpus()
    rows += [(None, "without an id", None), (7, "long " * 5000, "s")] + [rows[1]] * 50
    docs = spark.createDataFrame([(*r, 1, b"x", 3) for r in rows], "doc_id long, text string, source string, length long, ids binary, pick long").repartition(3)
    ids = encoded([t for _, t, _ in rows])
    for group_tokens in (1 << 22, 3000):
        got = first_fit.pack(docs, with_ids=True, group_tokens=group_tokens).collect()
        assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] == len(r["ids"]) // 4 for r in got)
        # every document comes back from its pieces; repeated rows have as many of each
        whole = Counter()
        pieces = defaultdict(Counter)
        for r in got:
            pieces[r["doc_id"], r["doc_tokens"]][r["start"], r["length"]] += 1
        for (doc, i), n in Counter(((d, tuple(i)) for (d, _, _), i in zip(rows, ids, strict=True))).items():
            whole[doc, len(i)] += n
        for key, n in whole.items():
            covered = np.zeros(key[1], int)
            for (start, length), k in pieces[key].items():
                covered[start : start + length] += k
            assert (covered == n).all()
        assert set(pieces) == set(whole)
        text = {(d, len(i)): np.array(i, "<u4") for (d, _, _), i in zip(rows, ids, strict=True)}
        assert all((text[r["doc_id"], r["doc_tokens"]][r["start"] : r["start"] + r["length"]] == np.frombuffer(r["ids"], "<u4")).all() for r in got)
        by = defaultdict(list)
        for r in got:
            by[r["sequence_id"]].append((r["offset"], r["length"]))
        for held in by.values():
            held.sort()
            assert [a for a, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))]
        totals = [sum(n for _, n in x) for x in by.values()]
        assert all(n == 2048 or n < 2048 and n & (n - 1) == 0 for n in totals)
    again = first_fit.pack(docs, group_tokens=3000)
    assert Counter(map(tuple, again.collect())) == Counter(tuple(r)[:-1] for r in got)


def test_sequences_carry_their_pieces(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four five"), (3, None)], "doc_id long, text string")
    placed = first_fit.pack(docs, with_ids=True, capacity=4)
    rows = {r["sequence_id"]: r for r in first_fit.sequences(placed, 4).collect()}
    for r in placed.collect():
        own = rows[r["sequence_id"]]["ids"]
        assert own[4 * r["offset"] : 4 * (r["offset"] + r["length"])] == r["ids"]
    assert {len(r["ids"]) for r in rows.values()} <= {4, 8, 16}
    odd = spark.createDataFrame([(0, 0, 3, bytes(range(12)))], "sequence_id long, offset long, length long, ids binary")
    assert bytes(first_fit.sequences(odd, 4).first()["ids"]) == bytes(range(12)) + bytes(4)


def test_nothing_to_pack(spark):
    assert first_fit.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
