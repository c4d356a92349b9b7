"""Suffix-array dedup: 50-byte strings that also start in an earlier document, by a difference-cover suffix sort.

The suffixes are dealt out by content so that each part can be sorted by itself: a 50-byte window goes where the
hash of its anchor (the 24-gram of least hash in it, `common.runs`) sends it, and equal windows have equal anchors.
Runs whose anchor hash occurs in one document only cannot match and are left out before any text is moved. Each part
is then sorted by the difference-cover algorithm modulo 3 (`suffix_order`): sampled triples are named, the names'
triples are named again (72 bytes, past the 50 that are asked for, so recursion ends there), the remaining suffixes
are merged in, and adjacent prefixes are compared byte for byte. A frequent anchor is sorted in goes that keep equal
windows together (`repeats_of_many`), so that no go holds more than some megabytes.

Defined results: null and empty texts, and texts under 50 bytes, lose nothing; a null doc_id is never earlier than
another and loses nothing; repeated rows of one doc_id are judged alike and never against each other; an empty table
gives an empty result; other columns are carried in one struct, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WINDOW, GRAM = 50, 24
#: Bytes of text per part: of the anchor index, of the suffix sort, and of a group of documents.
INDEX_BYTES, SORT_BYTES, GROUP_BYTES = 16 << 20, 1 << 20, 6 << 20
#: Most bytes that are sorted at once within a part; larger ones are sorted in several goes.
CHUNK = 1 << 20
BUFFER = 6 << 20


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and keys of the whole text."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *rest).alias("rest"))
    return docs.withColumns({"text_key": F.xxhash64("text"), "text_crc": F.crc32(F.coalesce("text", F.lit(""))), "n_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")})


def meet(a: np.ndarray) -> np.ndarray:
    return C.mix(a ^ np.uint64(0x5851F42D4C957F2D))


def by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings buckets together, and where they begin and end in it."""
    order = np.argsort(bucket, kind="stable")
    return order, np.concatenate(([0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)])) if len(order) else np.zeros(1, int)


def anchors(docs: DataFrame, buckets: int, window: int, gram: int) -> DataFrame:
    """Anchor hashes of all documents, packed by bucket: a row holds those that one task found for one bucket."""

    def emit(held: list) -> pa.RecordBatch:
        """Per bucket: the documents, how many anchors each has there, their groups, and the anchors' low halves."""
        ids, m, n, group = (np.concatenate([h[i] for h in held]) for i in range(4))
        doc = np.repeat(np.arange(len(ids)), n)
        bucket = ((m >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
        order, cut = by_bucket(bucket)
        rows = []
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            count = np.bincount(doc[order[x:y]], minlength=len(ids))
            some = np.flatnonzero(count)
            head = np.concatenate((np.diff(ids[some], prepend=0), count[some], group[some])).tobytes()
            rows.append((bucket[order[x]], len(some), C.packed(head), m[order[x:y]].astype(np.uint32).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (2, 3))], ["bucket", "docs", "head", "low"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for piece, data, off in C.slices(batch, "text"):
                r = C.runs(data, off, window, gram, content=False)
                m = meet(r["a"])
                held.append((piece.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), m, np.bincount(r["doc"], minlength=piece.num_rows), piece.column("group").to_numpy(zero_copy_only=False).astype(np.int64)))
                size += len(m)
                if size > 1_000_000:
                    yield emit(held)
                    held, size = [], 0
        if size:
            yield emit(held)

    return docs.select("doc_id", "group", "text").mapInArrow(each, "bucket int, docs int, head binary, low binary")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows sorted by bucket, a bucket at a time."""
    held: list[dict] = []
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
            if held and held[0]["bucket"] != row["bucket"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def shared(packed: DataFrame) -> DataFrame:
    """Anchor hashes that two documents or more have, packed by group of documents: a row for each bucket and group."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches):
            heads = [np.frombuffer(C.unpacked(r["head"], 24 * r["docs"]), np.int64).reshape(3, -1) for r in rows]
            ids = np.concatenate([np.repeat(np.cumsum(h[0]), h[1]) for h in heads])
            low = np.concatenate([np.frombuffer(r["low"], np.uint32) for r in rows])
            order = np.argsort(low)
            cut = np.concatenate(([0], np.flatnonzero(np.diff(low[order])) + 1))
            lo, hi = np.minimum.reduceat(ids[order], cut), np.maximum.reduceat(ids[order], cut)
            keep = order[np.repeat(lo < hi, np.diff(np.concatenate((cut, [len(order)]))))]
            if not len(keep):
                continue
            group = np.concatenate([np.repeat(h[2], h[1]) for h in heads])[keep]
            at = np.lexsort((ids[keep], group))
            keep, group = keep[at], group[at]
            cut = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(keep)]))
            out = [(group[x], rows[0]["bucket"], y - x, C.packed(np.diff(ids[keep[x:y]], prepend=0).tobytes()), low[keep[x:y]].tobytes()) for x, y in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["group", "bucket", "count", "ids", "low"])

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(each, "group int, bucket int, count long, ids binary, low binary")


def spans(docs: DataFrame, hits: DataFrame, buckets: int, sort_buckets: int, window: int, gram: int) -> DataFrame:
    """The text under runs whose anchor is shared, packed by sort bucket. docs: group, doc_id, text_key, text; hits: see `shared`.

    A group of documents, of bounded size since documents are dealt to groups by hash, meets its hits.
    """
    def emit(held: list) -> pa.RecordBatch:
        ids, keys, m, start, n = (np.concatenate([h[i] for h in held]) for i in range(5))
        length = n + window - 1
        data, at = np.concatenate([h[5] for h in held]), np.concatenate(([0], np.cumsum(length)))[:-1]
        bucket = ((m >> np.uint64(20)) % np.uint64(sort_buckets)).astype(np.int32)
        order, cut = by_bucket(bucket)
        rows = []
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            o = order[x:y]
            o = o[np.argsort(m[o], kind="stable")]
            body = data[C.ranges(at[o], length[o])]
            rows.append((bucket[o[0]], ids[o].tobytes(), keys[o].tobytes(), m[o].tobytes(), start[o].astype(np.int32).tobytes(), n[o].astype(np.int32).tobytes(), C.packed(body.tobytes()), len(body)))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 7)), pa.array([r[7] for r in rows], pa.int64())],
            ["bucket", "ids", "keys", "m", "start", "n", "body", "size"],
        )

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({n: pa.array([], t) for n, t in zip(names, kinds, strict=True)})
        if not left.num_rows or not right.num_rows:
            return none
        # bucket -1 names texts that an earlier document holds as a whole
        copies = pc.equal(right.column("bucket"), -1)
        skip, right = right.filter(copies), right.filter(pc.invert(copies))
        if not right.num_rows:
            return none
        ids, keys = (np.frombuffer(b"".join(skip.column(c).to_pylist()), np.int64) for c in ("ids", "low"))
        skip = set(zip(ids.tolist(), keys.tolist(), strict=True))
        if skip:
            left = left.filter(pa.array([x not in skip for x in zip(left.column("doc_id").to_pylist(), left.column("text_key").to_pylist(), strict=True)], pa.bool_()))
        # wanted: document and anchor, sorted
        owner = [np.cumsum(np.frombuffer(C.unpacked(r["ids"], 8 * r["count"]), np.int64)) for r in right.select(["ids", "count"]).to_pylist()]
        low = [np.frombuffer(x.as_py(), np.uint32).astype(np.uint64) | np.uint64(b) << np.uint64(32) for x, b in zip(right.column("low"), right.column("bucket").to_pylist(), strict=True)]
        wanted = np.sort(C.mix(np.concatenate(owner).view(np.uint64)) ^ C.mix(np.concatenate(low)))
        held, size, out = [], 0, []
        for batch in left.to_batches():
            for piece, data, off in C.slices(batch, "text"):
                r = C.runs(data, off, window, gram, content=False)
                m = meet(r["a"])
                ids = piece.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                mine = ((m >> np.uint64(40)) % np.uint64(buckets)) << np.uint64(32) | (m & np.uint64(0xFFFFFFFF))
                mine = C.mix(ids.view(np.uint64))[r["doc"]] ^ C.mix(mine)
                k = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)] == mine)
                if not len(k):
                    continue
                doc, start, n = r["doc"][k], r["start"][k], r["n"][k]
                held.append((ids[doc], piece.column("text_key").to_numpy(zero_copy_only=False)[doc], m[k], start - off[doc], n, data[C.ranges(start, n + window - 1)]))
                size += len(held[-1][5])
                if size > BUFFER:
                    out.append(emit(held))
                    held, size = [], 0
        if size:
            out.append(emit(held))
        return pa.Table.from_batches(out) if out else none

    schema = "bucket int, ids binary, keys binary, m binary, start binary, n binary, body binary, size long"
    names, kinds = schema_names(schema)
    return docs.groupBy("group").cogroup(hits.groupBy("group")).applyInArrow(each, schema)


def schema_names(schema: str) -> tuple[list[str], list[pa.DataType]]:
    of = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    parts = [x.split() for x in schema.split(", ")]
    return [p[0] for p in parts], [of[p[1]] for p in parts]


def named(key: np.ndarray) -> np.ndarray:
    """Dense ranks: equal keys share a name, and names keep the keys' order."""
    order = np.argsort(key)
    name = np.empty(len(key), np.uint64)
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[order[1:]] != key[order[:-1]]
    name[order] = (np.cumsum(fresh) - 1).astype(np.uint64)
    return name


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Order the suffixes that begin at wanted (a mask) by their first bytes; depth <= 72.

    Difference cover {1, 2} modulo 3: suffixes there are sorted by triples of 8-byte words, whose names are sorted in
    triples again; a suffix at a multiple of 3 is a byte, or two, before a sampled one and is merged by that.
    Returns the sorted starts, and whether each has its first `depth` bytes in common with the one before.
    """
    size = len(text)
    t = np.concatenate((text, np.zeros(96, np.uint8))).astype(np.uint64)
    pair = t[:-1] << np.uint64(8) | t[1:]
    four = pair[:-2] << np.uint64(16) | pair[2:]
    eight = four[:-4] << np.uint64(32) | four[4:]
    del pair, four
    high = np.uint64(32)
    want = np.concatenate((wanted, np.zeros(80, bool)))
    need = want.copy()
    need[1:] |= want[:-1]
    need[2:] |= want[:-2]
    here = np.arange(len(need)) % 3 != 0
    # triples of words at sampled places: 24 bytes
    deep = need.copy()
    deep[24:] |= need[:-24]
    deep[48:] |= need[:-48]
    at = np.flatnonzero(deep & here)
    at = at[at < size + 48]
    used = np.zeros(len(eight), bool)
    for d in (0, 8, 16):
        used[np.minimum(at + d, len(used) - 1)] = True
    word = np.zeros(len(eight), np.uint64)
    spots = np.flatnonzero(used)
    word[spots] = named(eight[spots])
    last = len(word) - 1
    name = named(named(word[at] << high | word[np.minimum(at + 8, last)]) << high | word[np.minimum(at + 16, last)])
    del word
    # triples of those names: 72 bytes
    first = np.zeros(size + 256, np.uint64)
    first[at] = name
    top = np.flatnonzero(need & here)
    rank = np.zeros(size + 256, np.uint64)
    rank[top] = named(named(first[top] << high | first[top + 24]) << high | first[top + 48])
    # merge
    mask = np.uint64(40)
    start = np.flatnonzero(wanted)
    one, two, rest = (start[start % 3 == r] for r in (1, 2, 0))
    by_one = lambda p: t[p] << mask | rank[p + 1]
    by_two = lambda p: t[p] << np.uint64(48) | t[p + 1] << mask | rank[p + 2]
    sampled = np.concatenate((one, two))
    sampled = sampled[np.argsort(rank[sampled], kind="stable")]
    rest = rest[np.argsort(by_one(rest), kind="stable")]
    before = np.searchsorted(np.sort(by_one(one)), by_one(rest)) + np.searchsorted(np.sort(by_two(two)), by_two(rest))
    place = np.concatenate((2 * before, 2 * np.arange(len(sampled)) + 1))
    out = np.concatenate((rest, sampled))[np.argsort(place, kind="stable")]
    same = np.zeros(len(out), bool)
    if len(out):
        same[1:] = True
        for d in [*range(0, depth - 7, 8), depth - 8]:
            same[1:] &= eight[out[1:] + d] == eight[out[:-1] + d]
    return out, same


def repeats(body: np.ndarray, n: np.ndarray, first: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For the windows of all spans in turn: whether the window also stands in a span of a smaller `first`.

    body: the spans' bytes, each n + window - 1 long; first: each span's first document.
    """
    length = n + window - 1
    at = np.concatenate(([0], np.cumsum(length)))[:-1]
    begins = C.ranges(at, n)
    wanted = np.zeros(len(body), bool)
    wanted[begins] = True
    order, same = suffix_order(body, wanted, window)
    owner = np.zeros(len(body), np.int64)
    owner[begins] = np.repeat(first, n)
    cut = np.flatnonzero(~same)
    least = np.minimum.reduceat(owner[order], cut)
    hit = np.zeros(len(body), bool)
    hit[order] = owner[order] > np.repeat(least, np.diff(np.concatenate((cut, [len(order)]))))
    return hit[begins]


def repeats_of_many(body: np.ndarray, n: np.ndarray, first: np.ndarray, window: int = WINDOW, most: int = CHUNK) -> np.ndarray:
    """As `repeats`, for the many spans of one frequent anchor, in goes of about `most` bytes.

    Only windows whose hash occurs again are sorted; those of one hash stay together. Where one window alone is too many for a
    go, its texts are compared with the first of them, and only what differs is sorted.
    """
    at = np.concatenate(([0], np.cumsum(n + window - 1)))
    edge = np.concatenate(([0], np.cumsum(n)))
    h = np.empty(int(edge[-1]), np.uint64)
    x = 0
    while x < len(n):
        y = max(x + 1, int(np.searchsorted(at, at[x] + most, "right")) - 1)
        begins = C.ranges(at[x:y] - at[x], n[x:y])
        h[edge[x] : edge[y]] = C.ONE.span(C.ONE.prefix(body[at[x] : at[y]]), begins, begins + window)
        x = y
    order = np.argsort(h, kind="stable")
    sorted_ = h[order]
    del h
    again = np.zeros(len(order), bool)
    again[1:] = sorted_[1:] == sorted_[:-1]
    again[:-1] |= again[1:]
    order, sorted_ = order[again], sorted_[again]
    hit = np.zeros(int(edge[-1]), bool)
    cut = np.concatenate(([0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1, [len(order)])) if len(order) else np.zeros(1, np.int64)
    limit, each = max(1, most // window), np.arange(window)
    x = 0
    while x < len(cut) - 1:
        y = max(x + 1, int(np.searchsorted(cut, cut[x] + limit, "right")) - 1)
        go = order[cut[x] : cut[y]]
        x = y
        owner = np.searchsorted(edge, go, "right") - 1
        begins = at[owner] + go - edge[owner]
        if len(go) > limit:
            like = np.concatenate([(body[begins[z : z + limit, None] + each] == body[begins[0] + each]).all(axis=1) for z in range(0, len(go), limit)])
            hit[go[like]] = first[owner[like]] > first[owner[like]].min()
            go, owner, begins = go[~like], owner[~like], begins[~like]
        if len(go):
            hit[go] = repeats(body[C.ranges(begins, np.full(len(go), window))], np.ones(len(go), np.int64), first[owner], window)
    return hit


def goes(m: np.ndarray, length: np.ndarray) -> Iterator[np.ndarray]:
    """Cut spans sorted by anchor into stretches of about CHUNK bytes, never within one anchor."""
    edge = np.concatenate(([0], np.flatnonzero(np.diff(m)) + 1, [len(m)]))
    total = np.concatenate(([0], np.cumsum(length)))[edge]
    x = 0
    while x < len(edge) - 1:
        y = max(x + 1, int(np.searchsorted(total, total[x] + CHUNK, "right")) - 1)
        yield np.arange(edge[x], edge[y])
        x = y


def removals(packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """Runs of windows to remove: doc_id, text_key, start, n."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches):
            ids, keys = (np.concatenate([np.frombuffer(r[c], np.int64) for r in rows]) for c in ("ids", "keys"))
            m = np.concatenate([np.frombuffer(r["m"], np.uint64) for r in rows])
            start, n = (np.concatenate([np.frombuffer(r[c], np.int32) for r in rows]).astype(np.int64) for c in ("start", "n"))
            length = n + window - 1
            bodies, c1, c2, done = [], [], [], 0
            for r in rows:  # one task's share at a time: the hashes' prefix sums take many times its bytes
                text = np.frombuffer(C.unpacked(r["body"], r["size"]), np.uint8)
                own = length[done : done + len(r["ids"]) // 8]
                done += len(own)
                end = np.cumsum(own)
                c1.append(C.ONE.span(C.ONE.prefix(text), end - own, end))
                c2.append(C.TWO.span(C.TWO.prefix(text), end - own, end))
                bodies.append(text)
            body, c1, c2 = np.concatenate(bodies), np.concatenate(c1), np.concatenate(c2)
            del bodies
            at = np.concatenate(([0], np.cumsum(length)))[:-1]
            order = np.lexsort((ids, c2, c1, m))
            kind = np.ones(len(order), bool)
            kind[1:] = (np.diff(m[order]) != 0) | (np.diff(c1[order]) != 0) | (np.diff(c2[order]) != 0)
            cls = np.cumsum(kind) - 1
            head = order[kind]
            first = ids[head]
            late = order[ids[order] > first[cls]]
            out = [(ids[late], keys[late], start[late], n[late])]
            # an anchor with one content has nothing left to compare
            alone = np.ones(len(head), bool)
            alone[1:] &= m[head][1:] != m[head][:-1]
            alone[:-1] &= m[head][1:] != m[head][:-1]
            span, n_of = head[~alone], np.where(alone, 0, n[head])
            hit = []
            for g in goes(m[span], length[span]):
                g = span[g]
                hit.append((repeats_of_many if length[g].sum() > 2 * CHUNK else repeats)(body[C.ranges(at[g], length[g])], n[g], ids[g], window))
            hit = np.concatenate(hit) if hit else np.zeros(0, bool)
            edge = np.concatenate(([0], np.cumsum(n_of)))
            # stretches of hits within each head, then for every row of that content and document
            where = np.flatnonzero(hit)
            if len(where):
                owner = np.searchsorted(edge, where, "right") - 1
                cut = np.concatenate(([0], np.flatnonzero((np.diff(where) != 1) | (np.diff(owner) != 0)) + 1, [len(where)]))
                o, s, k = owner[cut[:-1]], where[cut[:-1]] - edge[owner[cut[:-1]]], np.diff(cut)
                own = order[ids[order] == first[cls]]
                own_cls = cls[ids[order] == first[cls]]
                lo, hi = np.searchsorted(o, own_cls, "left"), np.searchsorted(o, own_cls, "right")
                pick, rep = C.ranges(lo, hi - lo), np.repeat(own, hi - lo)
                out.append((ids[rep], keys[rep], start[rep] + s[pick], k[pick]))
            a = [np.concatenate([x[i] for x in out]) for i in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(a[0], pa.int64()), pa.array(a[1], pa.int64()), pa.array(a[2], pa.int32()), pa.array(a[3], pa.int32())], ["doc_id", "text_key", "start", "n"])

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(each, "doc_id long, text_key long, start int, n int")


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row: doc_id, text, n_bytes, n_removed, n_spans, kept (the remaining bytes), rest (a struct of all other columns)."""
    all_docs = keyed(docs)
    live = all_docs.where("doc_id is not null")
    total = live.agg(F.sum("n_bytes")).first()[0] or 0
    buckets, sort_buckets, groups = (max(1, -(-total // each)) for each in (INDEX_BYTES, SORT_BYTES, GROUP_BYTES))
    whole = ["text_key", "text_crc", "n_bytes"]
    firsts = live.groupBy(*whole).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    copies = live.select("doc_id", *whole).join(firsts.where("first < last"), whole).where(f"doc_id > first and n_bytes >= {window}")
    copies = copies.select("doc_id", "text_key", F.lit(0).alias("start"), (F.col("n_bytes") - window + 1).cast("int").alias("n")).distinct()
    group = F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int")
    live = live.withColumn("group", group)
    hits = shared(anchors(live, buckets, window, gram))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = ([x.to_bytes(8, "little", signed=True) for x in b.column(c).to_pylist()] for c in ("doc_id", "text_key"))
            yield pa.RecordBatch.from_arrays([b.column("group").cast(pa.int32()), pa.array([-1] * len(ids), pa.int32()), pa.array([1] * len(ids), pa.int64()), pa.array(ids, pa.binary()), pa.array(keys, pa.binary())], ["group", "bucket", "count", "ids", "low"])

    named_copies = copies.withColumn("group", group).select("group", "doc_id", "text_key").mapInArrow(pack, hits.schema)
    packed = spans(live.select("doc_id", "text_key", "text", "group"), hits.unionByName(named_copies), buckets, sort_buckets, window, gram)
    flags = C.saved(removals(packed, window).unionByName(copies), "op9-flags")
    C.tidy(docs.sparkSession)
    marks = flags.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "n")).alias("marks"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                out = []
                for text, mark in zip(b.column("text"), b.column("marks"), strict=True):
                    body = text.as_buffer().to_pybytes() if text.is_valid else b""
                    if not mark.is_valid:
                        out.append((len(body), 0, 0, body))
                        continue
                    v = mark.values
                    start, n = v.field("start").to_numpy(), v.field("n").to_numpy()
                    delta = np.zeros(len(body) + 1, np.int32)
                    np.add.at(delta, start, 1)
                    np.add.at(delta, start + n - 1 + window, -1)
                    gone = np.cumsum(delta[:-1]) > 0
                    runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                    out.append((len(body), int(gone.sum()), runs, np.frombuffer(body, np.uint8)[~gone].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("text"), b.column("rest"), *(pa.array([x[i] for x in out], pa.int64()) for i in range(3)), pa.array([x[3] for x in out], pa.binary())],
                    ["doc_id", "text", "rest", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    joined = all_docs.join(marks, ["doc_id", "text_key"], "left").select("doc_id", "text", "rest", "marks")
    counts = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    return joined.mapInArrow(each, T.StructType([*joined.schema.fields[:3], *counts, T.StructField("kept", T.BinaryType())]))


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Every 50-byte string by its hexadecimal digits.
ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49)) AS i FROM d WHERE len(x) >= 100),
h AS (SELECT doc_id, i, md5(substr(x, CAST(2 * i + 1 AS BIGINT), 100)) AS k FROM s),
f AS (SELECT k, min(doc_id) AS first FROM h GROUP BY k),
g AS (SELECT h.doc_id, h.i FROM h JOIN f USING (k) WHERE h.doc_id > f.first),
o AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM g),
p AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM o),
q AS (SELECT doc_id, r, min(i) AS a, max(i) + 50 AS b FROM p GROUP BY doc_id, r),
t AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS c FROM q),
u AS (SELECT t.doc_id, sum(b - a) AS gone, count(*) AS runs, max(b) AS tail, string_agg(substr(d.x, CAST(2 * c + 1 AS BIGINT), CAST(2 * (a - c) AS BIGINT)), '' ORDER BY a) AS front
  FROM t JOIN d USING (doc_id) GROUP BY t.doc_id)
SELECT d.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(front || substr(x, CAST(2 * tail + 1 AS BIGINT)), x))) AS kept_sha256
FROM d LEFT JOIN u USING (doc_id)
"""
