"""Phrase collocations: count-min sketches, then exact counts of what survives them, then scores and subsumption.

Texts are cut into pieces at punctuation and line ends, and pieces into words. Each task adds its n-grams to a count-min
sketch of two rows, whose counters stop at the least count that makes a phrase a candidate; the sketches of all tasks are
merged 64 at a time, block by block. A sketch never counts too little, so an n-gram whose estimate is below the least
count is surely rare. There are three rounds, words, pairs and longer phrases, each on what survives the one before. The
last pass takes the n-grams that survive with all of their parts and counts them exactly, by their texts. Nothing
frequent is lost, however full the sketches are; fuller ones let more n-grams through to the exact count.

A sketch has as many counters as the input needs, up to `CELLS` a row. Only one bit a counter comes to the driver and is
broadcast: at most 6 * CELLS / 8 bytes, whatever the size of the input. Beyond that size the exact count has more to do.

A phrase and the one that it lies in are counted over all texts, and both counts fall as phrases grow; so a phrase is
subsumed by some longer candidate exactly when it is by one that is a word longer.

Defined results: a null or empty text has no words; a null lang is `und`, together with texts of that lang; repeated rows
count each; a null doc_id makes no difference; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .parity_join import LOWER

LONGEST, LEAST, TOP, SHARE = 5, 100, 2_000, 100
#: Counters of a sketch's row at most; of a block; bytes of text for each counter; sketches that one task merges.
CELLS, BLOCK, BYTES_A_CELL, MERGED = 1 << 26, 1 << 18, 128, 64
#: Phrases that a task holds before it merges equal ones, and bytes of text for each bucket of counts.
HELD, BUCKET_BYTES = 1 << 20, 32 << 20

STOP, BETWEEN = np.zeros(256, bool), np.zeros(256, bool)
STOP[[*b".,;:!?", 10, 11, 12, 13]] = True
BETWEEN[[32, 9]] = True
BETWEEN |= STOP
STEP = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of a few texts: bytes, starts, ends, doc, hashes with their language's, and whether the next one follows in the same piece."""

    def __init__(self, data: np.ndarray, off: np.ndarray, seeds: np.ndarray):
        self.data = LOWER[data]
        self.starts, self.ends, first = C.words(self.data, off, BETWEEN)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
        stops = np.cumsum(STOP[self.data])[self.starts]
        self.joined = np.zeros(len(self.starts), bool)
        self.joined[:-1] = (stops[1:] == stops[:-1]) & (self.doc[1:] == self.doc[:-1])
        self.hashes = C.mix(C.byte_hashes(self.data, self.starts, self.ends) ^ seeds[self.doc])

    def longer(self, at: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of n words whose first and last n - 1 words are among those at these places: places, hashes."""
        alive = np.zeros(len(self.hashes) + 1, bool)
        alive[at] = True
        keep = self.joined[at + n - 2] & alive[at + 1]
        at, h = at[keep], h[keep]
        return at, C.mix(h * STEP + self.hashes[at + n - 1])

    def texts(self, at: np.ndarray, n: int) -> pa.Array:
        """The n words from each of these places on, joined by single spaces."""
        word = (at[:, None] + np.arange(n)).reshape(-1)
        size = self.ends[word] - self.starts[word] + 1
        edge = np.concatenate(([0], np.cumsum(size)))
        body = np.append(self.data, np.uint8(32))[C.ranges(self.starts[word], size)]
        body[edge[1:] - 1] = 32
        keep = np.ones(len(body), bool)
        keep[edge[n::n] - 1] = False
        phrase = edge[::n] - np.arange(len(at) + 1)
        return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(phrase.astype(np.int64).tobytes()), pa.py_buffer(body[keep].tobytes())])


def read(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def batches_of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str], np.ndarray]]:
    """Words of some MB of text at a time, the languages there, and each text's language."""
    for batch in batches:
        for piece, data, off in C.slices(batch, "text", 1 << 21):
            lang = piece.column("lang").dictionary_encode()
            names = lang.dictionary.to_pylist()
            seeds = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in names], np.uint64)
            place = lang.indices.to_numpy(zero_copy_only=False)
            yield Words(data, off, seeds[place]), names, place


def places(h: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash's counter in each of the two rows: its highest and its lowest bits."""
    bits = np.uint64(64 - (cells - 1).bit_length())
    return (h >> bits).astype(np.int64), (h & np.uint64(cells - 1)).astype(np.int64)


class Sketch:
    """Two rows of counters that stop at `least`."""

    def __init__(self, cells: int, least: int):
        self.cells, self.least = cells, least
        self.rows = np.zeros((2, cells), np.uint8 if least < 256 else np.uint32)

    def add(self, h: np.ndarray) -> None:
        if not len(h):
            return
        one, count = np.unique(h, return_counts=True)
        for row, place in zip(self.rows, places(one, self.cells), strict=True):
            order = np.argsort(place, kind="stable")
            place = place[order]
            head = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
            some = place[head]
            row[some] = np.minimum(row[some] + np.add.reduceat(count[order], head), self.least)

    def blocks(self) -> Iterator[tuple[int, int, bytes]]:
        size = min(BLOCK, self.cells)
        for i, row in enumerate(self.rows):
            for at in range(0, self.cells, size):
                part = row[at : at + size]
                if part.any():
                    yield i, at // size, C.packed(part.tobytes())


class Survivors:
    """One bit for each counter that reached the least count."""

    def __init__(self, cells: int, bits: np.ndarray):
        self.cells, self.bits = cells, bits

    def has(self, h: np.ndarray) -> np.ndarray:
        one, two = ((self.bits[i][place >> 3] >> (place & 7).astype(np.uint8)) & 1 for i, place in enumerate(places(h, self.cells)))
        return (one & two).astype(bool)


def surviving(w: Words, known: list[Survivors], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per length the phrases that survive together with all their parts: n, places, hashes. known: by length; those beyond it survive."""
    at, h = np.arange(len(w.hashes)), w.hashes
    for n in range(1, longest + 1):
        if n > 1:
            at, h = w.longer(at, h, n)
        if n <= len(known):
            keep = known[n - 1].has(h)
            at, h = at[keep], h[keep]
        if not len(at):
            return
        yield n, at, h


def sketched(docs: DataFrame, cells: int, lengths: range, least: int, known: Broadcast) -> Survivors:
    """The merged sketch of phrases of these lengths all of whose shorter parts survived the rounds before."""
    size, kind = min(BLOCK, cells), np.uint8 if least < 256 else np.uint32
    schema = "line int, block int, part long, counters binary"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(cells, least)
        for w, _, _ in batches_of_words(batches):
            found = [h for n, _, h in surviving(w, known.value, lengths[-1]) if n in lengths]
            if found:
                sketch.add(np.concatenate(found))
        part = TaskContext.get().partitionId()
        for line, block, counters in sketch.blocks():
            yield pa.RecordBatch.from_arrays([pa.array([line], pa.int32()), pa.array([block], pa.int32()), pa.array([part], pa.int64()), pa.array([counters], pa.binary())], ["line", "block", "part", "counters"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for x in table.column("counters"):
            total += np.frombuffer(C.unpacked(x.as_py(), size * kind().itemsize), kind)
        total = np.minimum(total, least).astype(kind)
        one = table.slice(0, 1)
        return pa.table([one.column("line"), one.column("block"), pa.array([one.column("part")[0].as_py() // MERGED], pa.int64()), pa.array([C.packed(total.tobytes())], pa.binary())], ["line", "block", "part", "counters"])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = [np.packbits(np.frombuffer(C.unpacked(x.as_py(), size * kind().itemsize), kind) >= least, bitorder="little").tobytes() for x in batch.column("counters")]
            yield pa.RecordBatch.from_arrays([batch.column("line"), batch.column("block"), pa.array(full, pa.binary())], ["line", "block", "full"])

    texts = read(docs)
    parts, out = texts.rdd.getNumPartitions(), texts.mapInArrow(each, schema)
    while parts > 1:
        out = out.groupBy("line", "block", F.floor(F.col("part") / MERGED).alias("some")).applyInArrow(merge, schema)
        parts = -(-parts // MERGED)
    # a bit a counter, of at most CELLS counters a row
    found = np.zeros((2, -(-cells // 8)), np.uint8)
    for r in out.mapInArrow(bits, "line int, block int, full binary").collect():
        full = np.frombuffer(r["full"], np.uint8)
        found[r["line"], r["block"] * size // 8 :][: len(full)] = full
    return Survivors(cells, found)


class Tally:
    """Exact counts of phrases in a task's texts, equal ones merged now and then; phrases are told apart by 128 bits."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.held = 0

    def add(self, w: Words, lang: np.ndarray, at: np.ndarray, h: np.ndarray, n: int) -> None:
        other = w.hashes[at]
        for k in range(1, n):
            other = C.mix(other ^ (w.hashes[at + k] * STEP))
        one, place, count = merged(h, other, np.ones(len(h), np.int64))
        self.put(*one, count, lang[w.doc[at[place]]], np.full(len(count), n, np.int32), w.texts(at[place], n))

    def put(self, *part) -> None:
        """Two hashes, count, language, words, text."""
        self.parts.append(part)
        self.held += len(part[0])

    def all(self) -> tuple:
        """Each phrase once."""
        h, other, count, lang, n = (np.concatenate([x[i] for x in self.parts]) for i in range(5))
        texts = pa.concat_arrays([x[5] for x in self.parts])
        one, place, count = merged(h, other, count)
        self.parts = [(*one, count, lang[place], n[place], texts.take(pa.array(place)))]
        self.held = len(count)
        return self.parts[0]


def merged(h: np.ndarray, other: np.ndarray, count: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """Equal pairs of hashes as one, the place of each, and their counts' sums."""
    order = np.lexsort((other, h))
    x, y = h[order], other[order]
    head = np.concatenate(([0], np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1))
    return (x[head], y[head]), order[head], np.add.reduceat(count[order], head)


def exact_counts(docs: DataFrame, known: Broadcast, longest: int, least: int, buckets: int) -> DataFrame:
    """lang, n_words, phrase and f of every phrase of up to `longest` words that occurs `least` times; with n_words 0, the number of all words.

    Tasks hand on their counts as arrays, packed by buckets of the phrases' hashes; a bucket's arrays are merged in one task.
    """
    columns = [("h", np.uint64), ("other", np.uint64), ("count", np.int64), ("lang", np.int64), ("n", np.int32)]
    schema = "bucket int, names array<string>, h binary, other binary, count binary, lang binary, n binary, size binary, body long, text binary"

    def packs(names: list[str], tally: tuple) -> Iterator[pa.RecordBatch]:
        bucket = (tally[0] >> np.uint64(20)) % np.uint64(buckets)
        for b in np.unique(bucket).tolist():
            at = np.flatnonzero(bucket == b)
            text = tally[5].take(pa.array(at))
            size = np.diff(np.frombuffer(text.buffers()[1], np.int64)[: len(at) + 1])
            body = b"".join(text.to_pylist())
            row = [[b], [names], *[[x[at].tobytes()] for x in tally[:5]], [size.astype(np.int32).tobytes()], [len(body)], [C.packed(body)]]
            kinds = [pa.int32(), pa.list_(pa.string()), *[pa.binary()] * 6, pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        tally = Tally()
        for w, some, lang in batches_of_words(batches):
            lang = np.array([names.setdefault(x, len(names)) for x in some], np.int64)[lang]
            own, n = np.unique(lang[w.doc], return_counts=True)
            if not len(own):
                continue
            seed = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in names], np.uint64)[own]
            tally.put(seed, seed, n.astype(np.int64), own, np.zeros(len(own), np.int32), pa.array([b""] * len(own), pa.large_binary()))
            for n, at, h in surviving(w, known.value, longest):
                tally.add(w, lang, at, h, n)
            if tally.held > HELD:
                out = tally.all()
                if tally.held > HELD // 2:  # few are repeated
                    yield from packs(list(names), out)
                    tally = Tally()
        if tally.parts:
            yield from packs(list(names), tally.all())

    def total(table: pa.Table) -> pa.Table:
        names: dict[str, int] = {}
        tally = Tally()
        for r in table.to_pylist():
            h, other, count, lang, n = (np.frombuffer(r[c], t) for c, t in columns)
            lang = np.array([names.setdefault(x, len(names)) for x in r["names"]], np.int64)[lang]
            edge = np.concatenate(([0], np.cumsum(np.frombuffer(r["size"], np.int32), dtype=np.int64)))
            text = pa.Array.from_buffers(pa.large_binary(), len(h), [None, pa.py_buffer(edge.tobytes()), pa.py_buffer(C.unpacked(r["text"], r["body"]))])
            tally.put(h, other, count, lang, n, text)
            if tally.held > 2 * HELD:
                tally.all()
        _, _, count, lang, n, text = tally.all()
        kept = np.flatnonzero((count >= least) | (n == 0))
        return pa.table({"lang": pa.array(list(names), pa.string()).take(pa.array(lang[kept])), "n_words": n[kept], "phrase": text.take(pa.array(kept)).cast(pa.binary()), "f": count[kept]})

    out = read(docs).mapInArrow(each, schema).groupBy("bucket").applyInArrow(total, "lang string, n_words int, phrase binary, f long")
    return out.withColumn("phrase", F.col("phrase").cast("string"))


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, cells: int | None = None) -> DataFrame:
    """Exact counts by sketches, a written table."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    if cells is None:
        cells = min(CELLS, max(1 << 16, 1 << (total // BYTES_A_CELL).bit_length()))
    known: list[Survivors] = []
    told = spark.sparkContext.broadcast(known)
    for lengths in (range(1, 2), range(2, 3), range(3, longest + 1)):
        if len(lengths):
            found = sketched(docs, cells, lengths, least, told)
            told.unpersist()
            known = known + [found] * len(lengths)
            told = spark.sparkContext.broadcast(known)
    out = C.saved(exact_counts(docs, told, longest, least, 1 + total // BUCKET_BYTES), "op11-counts")
    told.unpersist()
    return out


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)), exactly, up to 38 digits."""
    wide = [x.cast("decimal(19,0)") for x in (a, n, left, right)]
    top = (wide[0] * wide[1]).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (wide[2] * wide[3]).cast("decimal(38,0)")).cast("long")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, share: int = SHARE, cells: int | None = None) -> DataFrame:
    """Each language's first `top` phrases: lang, rank, phrase, a, l, r, n, score. A phrase is subsumed by a longer one of `share` per cent of its count."""
    counts = frequent_phrases(docs, longest, least, cells)
    totals, known = counts.where("n_words = 0").select("lang", F.col("f").alias("n")), counts.where("n_words > 0").select("lang", "phrase", "f")
    found = counts.where("n_words > 1").select("lang", "phrase", F.col("f").alias("a"), "n_words", F.split("phrase", " ").alias("words"))
    part = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    cut = F.col("cut")
    cuts = found.withColumn("cut", F.explode(F.expr("sequence(1, n_words - 1)"))).select("lang", "phrase", "a", "n_words", "cut", part(F.lit(1), cut).alias("first"), part(cut + 1, F.col("n_words") - cut).alias("rest"))
    side = lambda key, f: known.select("lang", F.col("phrase").alias(key), F.col("f").alias(f))
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    least_cut = F.min(F.struct(score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "cut", "l", "r", "n"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(least_cut.alias("best"))
    inside = found.where("n_words > 2").select("lang", "a", F.explode(F.array(part(F.lit(1), F.col("n_words") - 1), part(F.lit(2), F.col("n_words") - 1))).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {int(share)} * a")
    # Spark keeps the first rows of each partition before it shuffles them
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = C.saved(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "best.n", "best.score"), "op11-phrases")
    C.forget(counts)
    return out


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Every n-gram counted, all longer candidates looked at.
ORACLE = r"""
WITH p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM
  (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, w[i:i + k - 1] AS w FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, w, count(*) AS f FROM g GROUP BY lang, w HAVING count(*) >= 100),
c AS (SELECT lang, w, f AS a, len(w) AS n_words, unnest(range(1, len(w))) AS k FROM f WHERE len(w) > 1),
s AS (SELECT c.lang, c.w, a, x.f AS l, y.f AS r, n, k, (1000::HUGEINT * a * n // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM c JOIN f AS x ON x.lang = c.lang AND x.w = c.w[:k] JOIN f AS y ON y.lang = c.lang AND y.w = c.w[k + 1:] JOIN t ON t.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
i AS (SELECT lang, w[i:j] AS w, max(f) AS longer FROM (SELECT lang, w, f, i, unnest(range(i + 1, len(w) + 1)) AS j FROM (SELECT lang, w, f, unnest(range(1, len(w))) AS i FROM f WHERE len(w) > 2)) WHERE j - i + 1 < len(w) GROUP BY ALL)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(w, ' ')) AS rank, array_to_string(w, ' ') AS phrase, a, l, r, n, score
  FROM b LEFT JOIN i USING (lang, w) WHERE longer IS NULL OR 100 * longer < 100 * a) WHERE rank <= 2000
"""
