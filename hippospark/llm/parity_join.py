"""N-gram Jaccard self-join by parity sketches.

A document is its set of word shingles. Hashing shingles into m places and keeping each place's parity gives a sketch
whose Hamming distance never exceeds the symmetric difference of two sets, and which folds to m / 2 places. Sets of a
size band (powers of two) are cut by hash into d + 1 parts and some more, d the largest difference that a linked pair
of the band can have: a linked pair agrees in a part, so the XOR of each part's shingles is a join key (the pigeonhole).
Pairs under a common key are held against the sketches and only those within their own bound are verified on the whole
sets. Under keys of many members a spanning forest of such pairs is verified first; where a pair of it fails, all pairs
that would join two of the components that came out are verified too, so components are those of all links.
Equal sets are joined beforehand and stand for one. A set with too few filled parts for the pigeonhole also files the
prefix of its sorted hashes; two such sets that link share one of these.

Defined results: null and empty texts have no shingles and their own component; texts of fewer words than a shingle
have one; repeated rows count alike; rows that share a doc_id but not their shingles are texts of their own, which link
each for itself, and a component's number is the least doc_id of its texts; a null doc_id has a null component; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hippospark.operators.components import connected_components

from . import common as C
from .suffix_dedup import by_bucket, grouped

INDEX_BYTES = 32 << 20
#: Groups above this size are joined by a forest.
SMALL = 8
#: Members that are compared at once, and the most 64-bit words of their sketches' differences.
BLOCK, WORDS = 64, 1 << 21
#: How much smaller the folded sketches are that all members of a key bring along.
SHRINK = 4
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted, and offsets."""
    data = LOWER[data]
    starts, ends, first = C.words(data, off)
    n = np.diff(first)
    pre = C.TWO.prefix(C.word_hashes(data, starts, ends))
    count = np.where(n == 0, 0, np.maximum(1, n - k + 1))
    begin = C.ranges(first[:-1], count)
    doc = np.repeat(np.arange(len(n)), count)
    h = C.TWO.span(pre, begin, np.minimum(begin + k, first[1:][doc]))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], np.searchsorted(doc[keep], np.arange(len(n) + 1))


def set_keys(h: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits by which a class of equal sets is known: two independent sums over its hashes."""
    sums = lambda x: np.concatenate((np.zeros(1, np.uint64), np.cumsum(C.mix(x))))
    one, two = sums(h + np.uint64(77)), sums((h ^ np.uint64(0xD1B54A32D192ED03)) * np.uint64(0x9FB21C651E98DF25))
    n = np.diff(edge).astype(np.uint64)
    return C.mix(one[edge[1:]] - one[edge[:-1]] + n).view(np.int64), C.mix(two[edge[1:]] - two[edge[:-1]]).view(np.int64)


@cache
def band(level: int, num: int, den: int) -> tuple[int, int]:
    """Most differing shingles of a linked pair whose smaller set is in this band, and the number of parts."""
    top = (2 << level) - 1
    d = (den - num) * (top + top * den // num) // (den + num)
    return d, (d + 1 + max(2, d // 5) if d else 1)


def places(n: int) -> int:
    """Bits of the sketch of a set of n."""
    return int(min(1 << 18, max(512, 1 << max(1, 4 * n - 1).bit_length())))


def fold(sketch: np.ndarray, bits: int) -> np.ndarray:
    while len(sketch) * 64 > bits:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def parity(h: np.ndarray) -> np.ndarray:
    """The sketch of a set: 64-bit words; place p is bit p % 64 of word p // 64."""
    bits = places(len(h))
    odd = (np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(-1, 8), axis=1, bitorder="little").reshape(-1).view(np.uint64)


def part_keys(h: np.ndarray, num: int, den: int) -> np.ndarray:
    """Join keys of one set of sorted hashes."""
    n, out, weak = len(h), [], False
    own = n.bit_length() - 1
    for level in {own, (-(-n * num // den)).bit_length() - 1}:
        d, parts = band(level, num, den)
        part = ((h >> np.uint64(13)) % np.uint64(parts)).astype(np.int64)
        x = np.zeros(parts, np.uint64)
        np.bitwise_xor.at(x, part, h)
        filled = np.flatnonzero(np.bincount(part, minlength=parts))
        weak |= len(filled) <= d
        out.append(C.mix(x[filled] + C.mix((filled + (level << 32)).astype(np.uint64) + np.uint64(1))))
    if weak:
        out.append(C.mix(h[: n - -(-n * num // den) + 1] ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    return np.concatenate(out)


def sketches(docs: DataFrame, buckets: int, k: int, num: int, den: int) -> DataFrame:
    """Rows of two kinds: one per row of docs (doc_id, text_key, n, sid, sid2, sketch, and small, the sketch folded), and join keys packed by bucket (bucket, ids, head, low)."""
    names = ["doc_id", "text_key", "n", "sid", "sid2", "sketch", "small", "bucket", "ids", "head", "low"]
    kinds = [*[pa.int64()] * 5, pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def emit(held: dict) -> pa.RecordBatch:
        sid = np.array(list(held), np.int64)
        m = np.concatenate(list(held.values()))
        doc = np.repeat(np.arange(len(sid)), [len(x) for x in held.values()])
        bucket = ((m >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
        order, cut = by_bucket(bucket)
        rows = []
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            count = np.bincount(doc[order[x:y]], minlength=len(sid))
            some = np.flatnonzero(count)
            head = np.concatenate((sid[some], count[some])).tobytes()
            rows.append((*[None] * 7, bucket[order[x]], len(some), C.packed(head), m[order[x:y]].astype(np.uint32).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for piece, data, off in C.slices(batch, "text"):
                h, edge = shingle_sets(data, off, k)
                n = np.diff(edge)
                sid, sid2 = set_keys(h, edge)
                sets = [h[x:y] for x, y in zip(edge[:-1], edge[1:], strict=True)]
                none = pa.nulls(len(n), pa.int32())
                table = [parity(x) if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("text_key"), pa.array(n, pa.int64()), pa.array(sid), pa.array(sid2), pa.array([None if t is None else t.tobytes() for t in table], pa.binary()), pa.array([None if t is None else fold(t, places(len(x)) // SHRINK).tobytes() for t, x in zip(table, sets, strict=True)], pa.binary()), none, none, pa.nulls(len(n), pa.binary()), pa.nulls(len(n), pa.binary())], names
                )
                for s, x in zip(sid.tolist(), sets, strict=True):
                    if len(x) and s not in held:
                        held[s] = part_keys(x, num, den)
                        size += len(held[s])
                if size > 1_000_000:
                    yield emit(held)
                    held, size = {}, 0
        if size:
            yield emit(held)

    return docs.select("doc_id", "text_key", "text").mapInArrow(each, "doc_id long, text_key long, n long, sid long, sid2 long, sketch binary, small binary, bucket int, ids int, head binary, low binary")


def shared(packed: DataFrame) -> DataFrame:
    """Keys that two sets or more file: sid, bucket, low halves, and whether one of these keys has more than SMALL sets."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches):
            heads = [np.frombuffer(C.unpacked(r["head"], 16 * r["ids"]), np.int64).reshape(2, -1) for r in rows]
            ids = np.concatenate([np.repeat(h[0], h[1]) for h in heads])
            low = np.concatenate([np.frombuffer(r["low"], np.uint32) for r in rows])
            order = np.argsort(low)
            cut = np.concatenate(([0], np.flatnonzero(np.diff(low[order])) + 1))
            lo, hi = np.minimum.reduceat(ids[order], cut), np.maximum.reduceat(ids[order], cut)
            keep = order[np.repeat(lo < hi, np.diff(np.concatenate((cut, [len(order)]))))]
            if not len(keep):
                continue
            keep = keep[np.lexsort((low[keep], ids[keep]))]
            i, v = ids[keep], low[keep]
            one = np.ones(len(i), bool)
            one[1:] = (np.diff(i) != 0) | (np.diff(v) != 0)
            i, v = i[one], v[one]
            _, back, count = np.unique(v, return_inverse=True, return_counts=True)
            cut = np.concatenate(([0], np.flatnonzero(np.diff(i)) + 1, [len(i)]))
            body, head = v.tobytes(), cut[:-1]
            many = np.logical_or.reduceat(count[back] > SMALL, head)
            yield pa.RecordBatch.from_arrays([pa.array(i[head]), pa.array(np.full(len(head), rows[0]["bucket"]), pa.int32()), pa.array([body[4 * x : 4 * y] for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), pa.array(many)], ["sid", "bucket", "low", "many"])

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(each, "sid long, bucket int, low binary, many boolean")


def near_pairs(n: np.ndarray, sketches: list[np.ndarray], label: np.ndarray, num: int, den: int, tree: bool) -> np.ndarray:
    """Pairs (places, two columns, the smaller first) of members of other labels that are within their bound by sketch.

    Members are taken by size, and a block of them is held against those that are not too large for it, all folded to the
    width of its smallest. With tree, a found pair joins its labels, so that only a spanning forest comes out, and rows that
    share their label with all later members are left out.
    """
    order = np.argsort(n, kind="stable")
    size, label, out, tables = n[order], label[order].copy(), [], {}
    for x in range(0, len(n) - 1, BLOCK):
        rows = np.arange(x, min(x + BLOCK, len(n)))
        bits = places(int(size[x]))
        rest = np.arange(x + 1, int(np.searchsorted(size, size[rows[-1]] * den // num, "right")))
        rest = rest[(label[rest][None, :] != label[rows][:, None]).any(axis=0)]
        if not len(rest):
            continue
        if bits not in tables:  # widths only grow
            tables = {bits: (x, np.stack([fold(sketches[i], bits) for i in order[x:]]))}
        begin, table = tables[bits]
        step = max(1, WORDS // (BLOCK * (bits // 64)))
        for z in range(0, len(rest), step):
            some = rest[z : z + step]
            apart = np.bitwise_count(table[rows - begin][:, None, :] ^ table[some - begin][None, :, :]).sum(axis=2, dtype=np.int64)
            a, b = size[rows][:, None], size[some][None, :]
            good = (apart * (den + num) <= (den - num) * (a + b)) & (b * num <= a * den) & (some[None, :] > rows[:, None]) & (label[rows][:, None] != label[some][None, :])
            i, j = np.nonzero(good)
            i, j = rows[i], some[j]
            if tree:
                keep = []
                for at, (u, v) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
                    if label[u] != label[v]:
                        label[label == label[v]] = label[u]
                        keep.append(at)
                i, j = i[keep], j[keep]
            out.append(np.sort(np.stack((order[i], order[j]), axis=1), axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def within_bound(n: tuple[int, int], left: np.ndarray, right: np.ndarray, num: int, den: int) -> bool:
    """Whether two sketches are no farther apart than a linked pair's can be."""
    bits = places(min(n))
    apart = int(np.bitwise_count(fold(left, bits) ^ fold(right, bits)).sum())
    return apart * (den + num) <= (den - num) * sum(n)


def candidates(members: DataFrame, sets: DataFrame, num: int, den: int, tree: bool) -> DataFrame:
    """members: bucket, doc, n, sketch, small, low, label; sets: doc, n, sketch. Pairs of documents within their bound by sketch: a < b.

    tree: all such pairs under keys of few members, a spanning forest of them under others; else, under the latter,
    all that join different labels. Only members of keys with many members bring their sketches along, the others a
    folded one (small), which bounds the same difference; pairs that pass it meet their sketches once, as pairs.
    """

    def passes(n: np.ndarray, small: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Pairs within their size's and their folded sketches' bounds."""
        ok = np.maximum(n[left], n[right]) * num <= np.minimum(n[left], n[right]) * den
        where, good = np.flatnonzero(ok), np.zeros(len(left), bool)
        width = np.array([len(x) for x in small])
        width, most = np.minimum(width[left], width[right]), (den - num) * (n[left] + n[right]) // (den + num)
        for size in np.unique(width[where]):
            w = where[width[where] == size]
            who, at = np.unique(np.concatenate((left[w], right[w])), return_inverse=True)
            table = np.stack([fold(small[x], int(size) * 64) for x in who])
            for x in range(0, len(w), 50_000):
                y = slice(x, x + 50_000)
                good[w[y]] = np.bitwise_count(table[at[: len(w)][y]] ^ table[at[len(w) :][y]]).sum(axis=1) <= most[w[y]]
        return good

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches):
            rows.sort(key=lambda r: r["doc"])
            docs, n = np.array([r["doc"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64)
            sketch = [None if r["sketch"] is None else np.frombuffer(r["sketch"], np.uint64) for r in rows]
            label = np.array([r["label"] for r in rows], np.int64)
            low = np.concatenate([np.frombuffer(r["low"], np.uint32) for r in rows])
            own = np.repeat(np.arange(len(rows)), [len(r["low"]) // 4 for r in rows])
            order = np.lexsort((own, low))
            low, own = low[order], own[order]
            cut = np.concatenate(([0], np.flatnonzero(np.diff(low)) + 1, [len(low)]))
            size, pairs = np.diff(cut), []
            for s in range(2, SMALL + 1) if tree else ():
                at = cut[:-1][size == s]
                for i in range(s):
                    for j in range(i + 1, s):
                        pairs.append((own[at + i] << 32) | own[at + j])
            pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
            left, right = pairs >> 32, pairs & 0xFFFFFFFF
            few, many, done = pairs[passes(n, [np.frombuffer(r["small"], np.uint64) for r in rows], left, right)], [np.zeros(0, np.int64)], set()
            for g in np.flatnonzero(size > SMALL):
                group = own[cut[g] : cut[g + 1]]
                if (tag := group.tobytes()) in done:
                    continue
                done.add(tag)
                two = near_pairs(n[group], [sketch[x] for x in group], label[group], num, den, tree)
                many.append((group[two[:, 0]] << 32) | group[two[:, 1]])
            many = np.unique(np.concatenate(many))
            few = np.setdiff1d(few, many, assume_unique=True)
            out = np.concatenate((many, few))
            yield pa.RecordBatch.from_arrays([pa.array(docs[out >> 32]), pa.array(docs[out & 0xFFFFFFFF]), pa.array(np.arange(len(out)) < len(many))], ["a", "b", "known"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, sa, sb = (batch.column(c) for c in ("na", "nb", "sa", "sb"))
            good = [within_bound((na[i].as_py(), nb[i].as_py()), np.frombuffer(sa[i].as_buffer(), np.uint64), np.frombuffer(sb[i].as_buffer(), np.uint64), num, den) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    found = members.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(each, "a long, b long, known boolean").groupBy("a", "b").agg(F.bool_or("known").alias("known"))
    if not tree:
        return found.select("a", "b")
    found = C.saved(found, "op10-found")
    side = lambda x: sets.select(F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    met = found.where("not known").join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
    return found.where("known").select("a", "b").unionByName(met.mapInArrow(close, "a long, b long"))


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Pairs of classes with whether they link, by the whole sets of their texts. classes: sid, sid2, label, and doc, a row that has a text of the class."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, off in C.slices(batch, "text"):
                h, edge = shingle_sets(data, off, k)
                body = h.tobytes()
                columns = [piece.column("doc_id"), *(pa.array(x) for x in set_keys(h, edge)), pa.array([body[8 * x : 8 * y] for x, y in zip(edge[:-1], edge[1:], strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "sid", "sid2", "shingles"])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(c)] for c in ("sa", "sb"))
            both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)]
            link = [den * i >= num * (len(x) + len(y) - i) for i, x, y in zip(both, left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(link, pa.bool_())], ["a", "b", "link"])

    involved = pairs.select(F.col("a").alias("label")).unionByName(pairs.select(F.col("b").alias("label"))).distinct()
    involved = C.saved(classes.join(involved, "label").select(F.col("doc").alias("doc_id"), "sid", "sid2", "label"), "op10-involved")
    # ids alone choose the texts: they are small enough to broadcast for longer than classes are
    texts = docs.join(involved.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text")
    # other texts under a doc_id are of other classes, and go here
    found = texts.mapInArrow(sets, "doc_id long, sid long, sid2 long, shingles binary").join(involved, ["doc_id", "sid", "sid2"])
    found = C.saved(found.groupBy("doc_id", "sid", "sid2").agg(F.first("label").alias("label"), F.first("shingles").alias("shingles")).select("label", "shingles"), "op10-sets")
    # the larger number has few partners, the smaller one may be the head of a family: its set is not repeated for each of them
    rows = pairs.join(found.select(F.col("label").alias("b"), F.col("shingles").alias("sb")), "b").join(found.select(F.col("label").alias("a"), F.col("shingles").alias("sa")), "a")
    out = C.saved(rows.select("a", "b", "sa", "sb").mapInArrow(test, "a long, b long, link boolean"), "op10-tested")
    C.forget(found)
    C.forget(involved)
    return out


def text_key(text: Column) -> Column:
    """Tells apart the texts of rows that share a doc_id."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def jaccard_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, with_keys: bool = False) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least doc_id reachable by links of Jaccard >= num / den), and text_key if asked for."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    table = C.saved(sketches(docs, max(1, -(-total // INDEX_BYTES)), k, num, den), "op10-sketches")
    of = C.saved(table.where("bucket is null").select("doc_id", "text_key", "n", "sid", "sid2"), "op10-docs")
    one = table.where("bucket is null and n > 0 and doc_id is not null").groupBy("sid", "sid2").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("small").alias("small"))
    sets = C.saved(one.withColumn("label", F.col("doc")), "op10-classes")
    # where several classes have the same least doc_id, each goes by a number of its own
    twice = sets.groupBy("doc").agg(F.count("*").alias("k")).where("k > 1").select("doc", F.lit(True).alias("twice"))
    clash = not twice.isEmpty()
    if clash:
        plain = sets
        sets = C.saved(plain.join(twice, "doc", "left").withColumn("label", F.when(F.col("twice"), F.xxhash64("doc", "sid", "sid2")).otherwise(F.col("doc"))).drop("twice").select(*plain.columns), "op10-classes")
        C.forget(plain)
    labelled = sets.select("sid", "sid2", "doc", "label")
    filed = C.saved(shared(table.where("bucket is not null").select("bucket", "ids", "head", "low")), "op10-filed")
    C.forget(table)
    few = filed.where("not many").join(sets.select("sid", "label", "n", "small"), "sid").select("bucket", "label", "n", F.lit(None).cast("binary").alias("sketch"), "small", "low")
    many = filed.where("many").join(sets, "sid").select("bucket", "label", "n", "sketch", "small", "low")
    members = few.unionByName(many).withColumns({"doc": F.col("label")})
    classes = C.saved(labelled, "op10-ids")
    sketched = sets.select(F.col("label").alias("doc"), "n", "sketch")
    pairs = C.saved(candidates(members, sketched, num, den, True), "op10-pairs")
    # below, only keys of many members are looked at again
    large = C.saved(many.withColumn("doc", F.col("label")), "op10-members")
    C.forget(filed)
    C.tidy(docs.sparkSession)
    tested = [verified(docs, classes, pairs, k, num, den)]
    C.forget(pairs)
    C.tidy(docs.sparkSession)
    components = connected_components(tested[0].where("link"), "a", "b")
    if not tested[0].where("not link").isEmpty():
        # where a forest's pair failed, all pairs under keys of many members that would join the components that are left
        apart = large.drop("label").join(components, F.col("doc") == F.col("node"), "left").withColumn("label", F.coalesce("component", "doc")).drop("node", "component")
        more = C.saved(candidates(apart, sketched, num, den, False).join(tested[0], ["a", "b"], "left_anti"), "op10-pairs")
        if not more.isEmpty():
            tested.append(verified(docs, classes, more, k, num, den))
            components = connected_components(tested[0].unionByName(tested[1]).where("link"), "a", "b")
        C.forget(more)
    for done in (large, sets, *tested):
        C.forget(done)
    C.tidy(docs.sparkSession)
    heads = classes.join(components, F.col("label") == F.col("node"), "left").select("sid", "sid2", "doc", F.coalesce("component", "label").alias("head"))
    if clash:
        heads = heads.join(heads.groupBy("head").agg(F.min("doc").alias("least")), "head")
    heads = heads.select("sid", "sid2", F.col("least" if clash else "head").alias("head"))
    out = of.join(heads, ["sid", "sid2"], "left")
    return out.select("doc_id", *["text_key"] * with_keys, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("head"))).otherwise(F.col("doc_id")).alias("component_id"))


def op10_parity_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs that share a shingle, counted; components by recursion.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s AS a JOIN s AS b ON a.k = b.k AND a.doc_id <> b.doc_id JOIN n AS x ON x.doc_id = a.doc_id JOIN n AS y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
r(node, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(c) AS c FROM r GROUP BY node) AS m ON m.node = d.doc_id
"""
