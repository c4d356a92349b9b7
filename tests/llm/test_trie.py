"""The prefix trie of conversations against a plain one."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from hippospark.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, base long, k1 string, members int, words string"


def plain_trie(rows):
    """rows: conv_id, turn, role, text. Recursion over the sets of members."""
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append(((t is not None, t or 0), hashlib.md5((hashlib.md5(role.encode()).hexdigest() + text).encode()).hexdigest(), (role, text)))
    turns = {c: [x[2] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = turns.get(base, [])[:h] + own[h:]
    out = []

    def node(members, d, parent):
        c = min(members)
        below = defaultdict(list)
        for m in members:
            if len(built[m]) > d:
                below[built[m][d]].append(m)
        ends = sorted(m for m in members if len(built[m]) == d)
        under = [node(v, d + 1, c) for v in below.values()]
        leaves = sum(x[0] for x in under) or 1
        own = 0
        if d:
            own = (len(members) - 1) * len([w for w in built[c][d - 1][1].translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w])
        saved = own + sum(x[1] for x in under)
        out.append((c, d, parent, len(members), len(under), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
        return leaves, saved

    if built:
        node(list(built), 0, None)
    return Counter(out)


def conversations(seed=3, n=140):
    rng = random.Random(seed)
    say = [None, "", "hi", "hi  there\nfriend", "a b\tc", "日 本", "no\u00a0break"] + [f"t{i} " * (i % 5 + 1) for i in range(6)]
    rows, kept = [], []
    for _ in range(n):
        c = rng.choice([rng.randrange(0, 130), rng.randrange(-50, 60), rng.randrange(10**12, 10**12 + 30)])
        if any(r[0] == c for r in rows):
            continue
        if kept and rng.random() < 0.4:
            own = list(rng.choice(kept))[: rng.randint(1, 12)]
        else:
            own = [(rng.choice(["user", "assistant", None]), rng.choice(say)) for _ in range(rng.randint(1, 7))]
        kept.append(own)
        numbers = [None if rng.random() < 0.05 else rng.choice([i, i, i, i // 2, i * 7 - 3]) for i in range(len(own))]
        rows += [(c, t, *x) for t, x in zip(numbers, own, strict=True)]
    return rows + rows[5:9] + [(None, 0, "user", "x")]


def collected(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "k", 2, "w") for r in rows], SCHEMA).repartition(3)
    return Counter(map(tuple, prefix_trie.prefix_trie(df, **more).collect()))


@pytest.mark.parametrize("seed", [3, 4])
def test_trie(spark, seed):
    rows = conversations(seed)
    expected = plain_trie(rows)
    assert collected(spark, rows) == expected
    assert any(x[3] > 2 and x[1] > 2 for x in expected)


def test_long_conversations_in_stretches(spark):
    """Copies, prefixes and forks of a conversation over many stretches, in one family and over families."""
    rng = random.Random(8)
    body = [("user", f"w{rng.randrange(50)} x") for _ in range(60)]
    rows = []
    for c in (0, 1, 2, 7, 20, 21, 45, 46):
        own = body[: rng.choice([60, 60, 31, 8, 9])]
        if c % 2:
            own = own[:20] + [("assistant", f"fork {c // 20}")] + own[20:]
        rows += [(c, t, *x) for t, x in enumerate(own)]
    rows += [(4, None, "user", "same")] * 40 + [(5, 1, "user", "one")]
    assert collected(spark, rows, stretch=4) == plain_trie(rows) == collected(spark, rows)


def test_many_ending_members(spark, monkeypatch):
    """The members of a node come from several blocks of ids, in ascending order."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 1)
    rows = [(c, 0, "user", "all alike") for c in range(-150, 400, 3)]
    expected = plain_trie(rows)
    assert collected(spark, rows) == expected


def test_no_conversations(spark):
    assert not collected(spark, []) and not collected(spark, [(None, 1, "user", "x")])
