"""Prefix trie of conversations, merged family first.

Conversations of one base id are a family. Families are cogrouped with the first turns of their base conversation; a task
rebuilds a family's conversations and builds their small trie. A node is known by the 128-bit sum of a hash of each of its
turns and that turn's depth. Only a family's combined nodes are shuffled, and merge by this key over all families.

The merged trie is read as chains: a node belongs to its smallest member, and the nodes of one member are the lower end of
its path. So a subtree's figures are sums over members: a conversation saves, in a subtree that it shares, the words
between the subtree's top and its own chain, and it adds a leaf where the end of its chain has no child. No step walks down
the trie level by level, however deep it is.

Nothing takes a conversation whole. Turns are numbered in the partitions of a range sort, and what spans partitions gets the
counts of those before. A family of long conversations is cogrouped in stretches of `stretch` turns, each of which starts
with the sums of those before. The numbers of a node's ending members are joined in blocks of ids, then hashed as a stream.

Defined results: a null role or text is empty, and equal to an empty one; rows without a conv_id belong to no
conversation and go; turns with equal numbers follow each other by the digest of role and text; repeated rows are turns
each; a base conversation that is absent lends no turns; `%` keeps the sign, so -19 to 19 are one family; an empty table
has no trie, not even a root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .mixing import word_count

FAMILY, LENT = 20, 4
#: Turns of each conversation in a task of a family, and base ids in a block of ending members.
STRETCH, BLOCK = 4_096, 64

NODE = "base long, k1 long, k2 long, p1 long, p2 long, depth long, words long, before long, members array<long>, ends array<long>"
START = "base long, stretch long, conv_id long, k1 long, k2 long, before long, more boolean"


def numbered(conversations: DataFrame) -> DataFrame:
    """Turns as conv_id, digest, words, part and at, the place among the conversation's turns in this part of a range sort."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).where("conv_id is not null")
    # equal rows may lie in different parts: their order makes no difference
    rows = rows.select("conv_id", "turn", F.unhex(F.md5(F.concat(F.md5("role"), "text"))).alias("digest"), word_count("text").alias("words"), F.monotonically_increasing_id().alias("tie"))
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("digest"), F.asc("tie")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column("conv_id").to_numpy(zero_copy_only=False)
            if not len(conv):
                continue
            head = np.concatenate(([0], np.flatnonzero(conv[1:] != conv[:-1]) + 1, [len(conv)]))
            at = np.arange(len(conv)) - np.repeat(head[:-1], np.diff(head))
            if conv[0] == last:
                at[: head[1]] += n
            last, n = conv[-1], at[-1] + 1
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("digest"), batch.column("words"), pa.array(np.full(len(conv), part, np.int64)), pa.array(at)], ["conv_id", "digest", "words", "part", "at"])

    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(each, "conv_id long, digest binary, words long, part long, at long")


def halves(digest: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    two = np.frombuffer(b"".join(digest.to_pylist()), np.uint64).reshape(-1, 2)
    return two[:, 0], two[:, 1]


def lent(conv: int) -> int:
    """How many turns of its base a conversation begins with, at most."""
    return zlib.crc32(str(conv).encode()) % LENT


class Rebuilt:
    """A family's rebuilt turns of one stretch, by member and depth: who (members), member, depth, words, v1 and v2 (hashes of turn and depth)."""

    def __init__(self, left: pa.Table, right: pa.Table):
        conv, pos = (left.column(c).to_numpy() for c in ("conv_id", "pos"))
        self.base, self.stretch = left.column("base")[0].as_py(), left.column("stretch")[0].as_py()
        self.who, member = np.unique(conv, return_inverse=True)
        n = len(self.who)
        h = np.fromiter(map(lent, self.who.tolist()), np.int64, n)
        heads = next((x for x in right.column("heads").to_pylist() if x), [])
        given = np.minimum(h, len(heads))
        own = pos >= h[member]
        d1, d2 = halves(left.column("digest"))
        parts = [(member[own], (pos - h[member] + given[member] + 1)[own], d1[own], d2[own], left.column("words").to_numpy()[own])]
        if not self.stretch and given.any():
            g1, g2 = halves(pa.array([x["digest"] for x in heads], pa.binary()))
            at = C.ranges(np.zeros(n, np.int64), given)
            parts.append((np.repeat(np.arange(n), given), at + 1, g1[at], g2[at], np.array([x["words"] for x in heads])[at]))
        member, depth, d1, d2, words = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((depth, member))
        self.member, self.depth, self.words = member[order], depth[order], words[order]
        place = C.mix(self.depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.v1, self.v2 = C.mix(d1[order] + place), C.mix(d2[order] ^ place)


def partial_sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of each conversation in a stretch: sums of hashes and of words."""
    r = Rebuilt(left, right)
    cut = np.searchsorted(r.member, np.arange(len(r.who) + 1))
    total = lambda x: np.diff(np.concatenate((np.zeros(1, x.dtype), np.cumsum(x)))[cut])
    return pa.table({"conv_id": r.who, "stretch": np.full(len(r.who), r.stretch), "k1": total(r.v1).view(np.int64), "k2": total(r.v2).view(np.int64), "words": total(r.words)})


def family_nodes(left: pa.Table, right: pa.Table) -> pa.Table:
    """The trie of a family's stretch: its nodes with members and the members that end there, both ascending."""
    r = Rebuilt(left, right)
    n = len(r.who)
    k1, k2, before, more = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(n, bool)
    for x in right.select(["conv_id", "k1", "k2", "before", "more"]).to_pylist():
        if x["conv_id"] is not None:
            i = int(np.searchsorted(r.who, x["conv_id"]))
            k1[i], k2[i], before[i], more[i] = x["k1"] % (1 << 64), x["k2"] % (1 << 64), x["before"], x["more"]
    member, depth, words, v1, v2 = r.member, r.depth, r.words, r.v1, r.v2
    if not r.stretch:  # the root is on every path
        at = np.searchsorted(member, np.arange(n))
        depth, words, v1, v2, member = (np.insert(x, at, y) for x, y in ((depth, 0), (words, 0), (v1, 0), (v2, 0), (member, np.arange(n))))
    first = np.searchsorted(member, np.arange(n))
    running = lambda x, start: (y := np.cumsum(x)) - (y[first] - x[first])[member] + start[member]
    a, b, w = running(v1, k1), running(v2, k2), running(words, before)
    ending = np.zeros(len(member), bool)
    ending[np.concatenate((first[1:], [len(member)]))[~more] - 1] = True
    order = np.lexsort((member, b, a))
    a, b = a[order], b[order]
    head = np.concatenate(([0], np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1)).astype(np.int64)
    one, ids, ending = order[head], r.who[member[order]], ending[order]
    root = pa.array(depth[one] == 0)
    up = lambda k, v: pa.compute.if_else(root, pa.scalar(None, pa.int64()), pa.array((k[head] - v[one]).view(np.int64)))
    listed = lambda ids, edge: pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids))
    ends = np.concatenate(([0], np.cumsum(ending)))[np.concatenate((head, [len(a)]))]
    return pa.table(
        {"base": np.full(len(head), r.base), "k1": a[head].view(np.int64), "k2": b[head].view(np.int64), "p1": up(a, v1), "p2": up(b, v2), "depth": depth[one], "words": words[one], "before": (w - words)[one], "members": listed(ids, np.concatenate((head, [len(a)]))), "ends": listed(ids[ending], ends)}
    )


def starts(long: DataFrame, sums: DataFrame, stretch: int) -> DataFrame:
    """What each stretch of a long conversation starts with; one row a stretch passes the task of a conversation."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, k1, k2, words = None, 0, 0, 0
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                if x["conv_id"] != last:
                    last, k1, k2, words = x["conv_id"], 0, 0, 0
                signed = [k - (1 << 64) if k >> 63 else k for k in (k1, k2)]
                out.append((x["base"], x["stretch"], last, *signed, words, x["stretch"] < x["final"]))
                k1, k2, words = (k1 + x["k1"]) % (1 << 64), (k2 + x["k2"]) % (1 << 64), words + x["words"]
            names = [c.split()[0] for c in START.split(", ")]
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], pa.schema([(c, pa.bool_() if c == "more" else pa.int64()) for c in names]))

    final = F.floor((F.col("n") - 1) / stretch).cast("long").alias("final")
    rows = sums.join(long.select("conv_id", final), "conv_id").withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "stretch").mapInArrow(each, START)


def family_tries(conversations: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The nodes of every family's trie (NODE)."""
    held = C.saved(numbered(conversations), "op13-turns")
    counts = held.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    here = Window.partitionBy("conv_id").orderBy("part")
    counts = counts.withColumns({"before": F.sum("n").over(here.rowsBetween(Window.unboundedPreceding, -1)), "n": F.sum("n").over(Window.partitionBy("conv_id"))})
    counts = C.saved(counts, "op13-counts")
    # a part begins within one conversation at most: no more rows than parts
    placed = held.join(F.broadcast(counts.where("before > 0").drop("n")), ["conv_id", "part"], "left").withColumn("pos", F.col("at") + F.coalesce("before", F.lit(0)))
    placed = placed.select((F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), F.floor(F.col("pos") / stretch).cast("long").alias("stretch"), "conv_id", "pos", "digest", "words")
    first = placed.where(f"conv_id = base and pos < {LENT - 1}").groupBy("base").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "words"))).alias("heads"))
    spans = placed.select("base", "stretch").distinct()
    none = [F.lit(None).cast(t).alias(c) for c, t in (("conv_id", "long"), ("k1", "long"), ("k2", "long"), ("before", "long"), ("more", "boolean"))]
    key = ("base", "stretch")
    lead = spans.join(first, "base", "left").select(*[F.col(c).alias(c) for c in key], *none, "heads")
    long = counts.where(F.col("n") > stretch).select("conv_id", "n").distinct()
    if not long.isEmpty():
        some = placed.join(long.select("conv_id"), "conv_id", "left_semi").select(*placed.columns)
        sums = some.groupBy(*key).cogroup(lead.groupBy(*key)).applyInArrow(lambda x, y: partial_sums(x, y) if x.num_rows else pa.table({c: np.zeros(0, np.int64) for c in ("conv_id", "stretch", "k1", "k2", "words")}), "conv_id long, stretch long, k1 long, k2 long, words long")
        begun = starts(long, sums, stretch)
        lead = lead.unionByName(begun.withColumn("heads", F.lit(None).cast(lead.schema["heads"].dataType)))
    out = C.saved(placed.groupBy(*key).cogroup(lead.groupBy(*key)).applyInArrow(family_nodes, NODE), "op13-families")
    C.forget(held)
    C.forget(counts)
    return out


def ends_hashed(families: DataFrame) -> DataFrame:
    """Per node with ending members: k1, k2, ends_sha256. Blocks of ids are joined first; a node's blocks are hashed one after the other."""
    block = F.floor(F.col("base") / (FAMILY * BLOCK)).cast("long")
    blocks = families.where(F.size("ends") > 0).groupBy("k1", "k2", block.alias("block")).agg(F.array_join(F.array_sort(F.flatten(F.collect_list("ends"))).cast("array<string>"), ",").alias("ids"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def rows(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0][0] for x in done], pa.int64()), pa.array([x[0][1] for x in done], pa.int64()), pa.array([x[1].hexdigest() for x in done], pa.string())], ["k1", "k2", "ends_sha256"])

        for batch in batches:
            done = []
            for *own, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
                if own == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((key, state))
                key, state = own, hashlib.sha256(ids.encode())
            if done:
                yield rows(done)
        if key is not None:
            yield rows([(key, state)])

    return blocks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "block").mapInArrow(each, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    families = family_tries(conversations, stretch)
    key = ["k1", "k2"]
    nodes = C.saved(families.groupBy(*key).agg(F.min(F.col("members")[0]).alias("conv_id"), F.min("depth").alias("depth"), F.sum(F.size("members").cast("long")).alias("n_convs"), F.min("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2")), "op13-nodes")
    # a member's own nodes: from depth `top` to its end
    chains = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("depth").alias("end"), F.sum("words").alias("own"), F.min_by(F.struct("p1", "p2"), "depth").alias("up"), F.max_by(F.struct(*key), "depth").alias("tail"))
    chains = C.saved(chains.select("conv_id", "top", "end", "own", "up.p1", "up.p2", "tail.k1", "tail.k2"), "op13-chains")
    begun = chains.where("top > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("begun"))
    leaf = chains.join(begun, key, "left").select("conv_id", "top", "own", F.col("begun").isNull().cast("long").alias("leaf"))
    totals = families.where(F.size("ends") > 0).select("base", F.explode("ends").alias("conv_id"), (F.col("before") + F.col("words")).alias("total"))
    # who owns no node shares all of its path
    infos = totals.join(leaf, "conv_id", "left").select("base", F.struct("conv_id", F.coalesce("top", F.lit((1 << 63) - 1)).alias("top"), (F.col("total") - F.coalesce("own", F.lit(0))).alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf")).alias("info"))
    infos = infos.groupBy("base").agg(F.collect_list("info").alias("infos"))
    mine = F.filter("infos", lambda x: F.array_contains("members", x["conv_id"]) & (x["top"] > F.col("depth")))
    shares = families.join(infos, "base").select(*key, "before", mine.alias("mine")).where(F.size("mine") > 0)
    added = lambda f: F.aggregate("mine", F.lit(0).cast("long"), lambda x, y: x + f(y))
    shares = shares.select(*key, added(lambda x: x["leaf"]).alias("leaves"), added(lambda x: x["shared"] - F.col("before")).alias("saved"), F.lit(0).cast("long").alias("begun"))
    shares = shares.unionByName(begun.withColumns({"leaves": F.lit(0).cast("long"), "saved": F.lit(0).cast("long")})).groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("leaves", "saved", "begun")])
    owners = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("owner"))
    chains_up = chains.drop("k1", "k2").join(owners, ["p1", "p2"], "left").join(leaf.select("conv_id", "leaf"), "conv_id").select("conv_id", "top", "end", "owner", "leaf")
    out = nodes.join(shares, key, "left").join(ends_hashed(families), key, "left").join(chains_up, "conv_id")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = out.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("owner")).alias("parent_conv_id"), "n_convs",
        ((F.col("depth") < F.col("end")).cast("long") + zero("begun")).alias("n_children"), (F.col("leaf") + zero("leaves")).alias("n_leaves"), zero("saved").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
    out = C.saved(out, "op13-trie")
    for table in (families, nodes, chains):
        C.forget(table)
    return out


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: CRC-32 by its bytewise table; nodes by the digest of their turns; subtrees by the paths of their members.
ORACLE = r"""
WITH bits AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b)),
own AS (SELECT conv_id AS c, md5(md5(coalesce(role, '')) || coalesce(text, '')) AS m, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(md5(coalesce(role, '')) || coalesce(text, ''))) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT c, c - c % 20 AS b, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) % 4 AS h FROM (SELECT DISTINCT c FROM own), bits),
built AS (SELECT conv.c, m, w, row_number() OVER (PARTITION BY conv.c ORDER BY part, pos) AS d FROM conv JOIN
  (SELECT conv.c, m, w, 0 AS part, pos FROM conv JOIN own ON own.c = conv.b AND pos < h UNION ALL SELECT conv.c, m, w, 1, pos FROM conv JOIN own ON own.c = conv.c AND pos >= h) AS x USING (c)),
path AS (SELECT c, 0 AS d, '' AS k, 0 AS w FROM conv UNION ALL SELECT c, d, md5(string_agg(m, ',') OVER (PARTITION BY c ORDER BY d)), w FROM built),
long AS (SELECT c, max(d) AS n FROM path GROUP BY c),
node AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w FROM path GROUP BY k, d),
up AS (SELECT DISTINCT x.k, x.d, y.k AS pk FROM path AS x JOIN path AS y ON y.c = x.c AND y.d = x.d - 1),
kids AS (SELECT pk AS k, d - 1 AS d, count(*) AS n FROM up GROUP BY ALL),
below AS (SELECT DISTINCT x.k, x.d, y.k AS k2, y.d AS d2 FROM path AS x JOIN path AS y ON y.c = x.c AND y.d >= x.d),
under AS (SELECT b.k, b.d, sum((n.n_convs - 1) * n.w) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves FROM below AS b JOIN node AS n ON n.k = b.k2 AND n.d = b.d2 LEFT JOIN kids ON kids.k = b.k2 AND kids.d = b.d2 GROUP BY b.k, b.d),
ends AS (SELECT k, d, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM path JOIN long USING (c) WHERE d = n GROUP BY k, d)
SELECT node.conv_id, node.d AS depth, p.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children, u.leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node JOIN under AS u USING (k, d) LEFT JOIN kids USING (k, d) LEFT JOIN ends USING (k, d) LEFT JOIN up USING (k, d) LEFT JOIN node AS p ON p.k = up.pk AND p.d = node.d - 1
"""
