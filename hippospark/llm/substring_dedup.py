"""Substring dedup by a log-structured fingerprint index.

Batches arrive in ascending doc_id. Each batch is cut into runs of 50-word windows (`common.runs`): every window
belongs to exactly one run, and equal windows lie under equal anchor hashes. A batch's run heads (first document of
each anchor hash and content hash) are written as an immutable table sorted by anchor; the next batch is merge-joined
with those sorted tables. A run whose whole content stood in an earlier document is removed at once; where one anchor
has several contents, the windows themselves are looked up in the texts of both sides, at every place where a content's
first document holds it, and compared by 128-bit digests of their words (the verification). When `fanout` tables have gathered they are compacted into one.

Defined results: null and empty texts, and texts under 50 words, lose nothing; a null doc_id is never earlier than
another and loses nothing; repeated rows of one doc_id are judged alike, and never against each other; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW, GRAM = 50, 8
RUN = "doc_id long, text_key long, start int, n int, a long, c1 long, c2 long"
HEAD = "struct(doc_id, text_key, start, n)"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key of the text, so that rows that share a doc_id are told apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))


def extract(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per run of windows of every whole text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, off in C.slices(batch, "text"):
                starts, ends, first = C.words(data, off)
                r = C.runs(C.word_hashes(data, starts, ends), first, window, gram)
                ids = piece.column("doc_id").to_numpy(zero_copy_only=False)[r["doc"]]
                keys = piece.column("text_key").to_numpy(zero_copy_only=False)[r["doc"]]
                at = r["start"] - first[r["doc"]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(at, pa.int32()), pa.array(r["n"], pa.int32()), C.signed(r["a"]), C.signed(r["c1"]), C.signed(r["c2"])],
                    ["doc_id", "text_key", "start", "n", "a", "c1", "c2"],
                )

    return keyed(docs).where("doc_id is not null").mapInArrow(each, RUN)


class FingerprintIndex:
    """Sorted immutable tables of run heads: (a, c1, c2) -> first document and place."""

    def __init__(self, fanout: int = 3):
        self.fanout, self.tables = fanout, []

    def history(self) -> DataFrame | None:
        out = None
        for t in self.tables:
            out = t if out is None else out.unionByName(t)
        return out

    def ingest(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Add a batch whose doc_ids follow all earlier ones. Returns its runs seen earlier, and the runs to verify."""
        new = C.saved(extract(docs), "op1-batch")
        heads = new.groupBy("a", "c1", "c2").agg(F.min(F.expr(HEAD)).alias("head"), F.count("*").alias("m"))
        if (old := self.history()) is not None:
            met = old.join(heads.select("a").distinct(), "a", "left_semi").select("a", "c1", "c2", "head", F.lit(1).cast("long").alias("m"))
            merged = heads.withColumn("fresh", F.lit(1)).unionByName(met.withColumn("fresh", F.lit(0)))
            merged = merged.groupBy("a", "c1", "c2").agg(F.min("head").alias("head"), F.sum("m").alias("m"), F.min("fresh").alias("fresh"))
        else:
            merged = heads.withColumn("fresh", F.lit(1))
        merged = C.saved(merged.repartition("a", "c1", "c2").sortWithinPartitions("a", "c1", "c2"), "op1-merged")
        firsts = merged.where("m > 1").select("a", "c1", "c2", F.col("head.doc_id").alias("first"), F.col("head.text_key").alias("key"), F.col("head.start").alias("at"))
        # rows of later documents, and the first document's other rows, which keep their anchor
        met = new.join(firsts, ["a", "c1", "c2"]).where("doc_id > first or doc_id = first and (text_key <> key or start <> at)")
        met = C.saved(met.select("doc_id", "text_key", "start", "n", F.when(F.col("doc_id") == F.col("first"), F.col("a")).alias("a")), "op1-seen")
        many = merged.groupBy("a").agg(F.count("*").alias("k")).where("k > 1").select("a")
        doubtful = merged.select("a", "head.*").unionByName(met.where("a is not null")).join(many, "a", "left_semi")
        seen, doubtful = met.where("a is null").drop("a"), C.saved(doubtful.drop("a"), "op1-doubt")
        self.tables.append(C.saved(merged.where("fresh = 1").select("a", "c1", "c2", "head"), "op1-index"))
        C.forget(new)
        C.forget(merged)
        if len(self.tables) >= self.fanout:
            self.compact()
        return seen, doubtful

    def compact(self) -> None:
        one = self.history().groupBy("a", "c1", "c2").agg(F.min("head").alias("head")).repartition("a", "c1", "c2").sortWithinPartitions("a", "c1", "c2")
        one, old = C.saved(one, "op1-index"), self.tables
        self.tables = [one]
        for t in old:
            C.forget(t)


def verify(docs: DataFrame, doubtful: DataFrame, window: int = WINDOW) -> DataFrame:
    """Windows of doubtful runs (text looked up again) that also start in an earlier document: doc_id, text_key, start, n = 1."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                body = batch.column("text")[i].as_py().encode()
                data = np.frombuffer(body, np.uint8)
                starts, ends, _ = C.words(data, np.array([0, len(data)]))
                asked = np.array([(x["start"], x["n"]) for x in batch.column("asked")[i].as_py()], np.int64)
                at = np.unique(C.ranges(asked[:, 0], asked[:, 1]))
                list_of = body.split()
                sums = [xxhash.xxh3_128_digest(b" ".join(list_of[x : x + window])) for x in at]
                both = np.frombuffer(b"".join(sums), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), batch.column("doc_id")[i].as_py()), pa.int64()), pa.array(np.full(len(at), batch.column("text_key")[i].as_py()), pa.int64()), pa.array(at, pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1])],
                    ["doc_id", "text_key", "start", "d1", "d2"],
                )

    asked = doubtful.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "n")).alias("asked"))
    seen = keyed(docs).join(asked, ["doc_id", "text_key"]).mapInArrow(each, "doc_id long, text_key long, start int, d1 long, d2 long")
    seen = C.saved(seen, "op1-windows")
    C.tidy(docs.sparkSession)
    first = seen.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    out = C.saved(seen.join(first, ["d1", "d2"]).where("doc_id > first").select("doc_id", "text_key", "start", F.lit(1).alias("n")), "op1-verified")
    C.forget(seen)
    return out


def covered(docs: DataFrame, flags: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text and the flagged window runs of each document (null where there are none)."""
    marks = flags.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    return keyed(docs).join(marks, ["doc_id", "text_key"], "left")


def removed_words(n_words: int, marks: list[dict], window: int) -> np.ndarray:
    """Which words flagged windows cover."""
    delta = np.zeros(n_words + 1, np.int64)
    start, n = np.array([(m["start"], m["n"]) for m in marks], np.int64).T
    np.add.at(delta, start, 1)
    np.add.at(delta, start + n - 1 + window, -1)
    return np.cumsum(delta[:-1]) > 0


def splits(docs: DataFrame, n: int) -> list[int]:
    """Ascending doc_ids that cut the table into about n batches."""
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.01)
    return sorted({int(x) for x in cut})


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = 3) -> DataFrame:
    """Per row: doc_id, text, n_words, n_removed, kept_text (the kept words joined by one space)."""
    index, seen, doubtful = FingerprintIndex(), [], []
    cuts = splits(docs, batches)
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        batch = docs
        batch = batch if low is None else batch.where(F.col("doc_id") > low)
        batch = batch if high is None else batch.where(F.col("doc_id") <= high)
        s, d = index.ingest(batch)
        seen.append(s)
        doubtful.append(d)
    doubts, flags = doubtful[0], seen[0]
    for d, s in zip(doubtful[1:], seen[1:], strict=True):
        doubts, flags = doubts.unionByName(d), flags.unionByName(s)
    C.tidy(docs.sparkSession)
    verified = verify(docs, doubts, window)
    flags = flags.unionByName(verified)
    for table in (*index.tables, *doubtful):
        C.forget(table)
    C.tidy(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                out = []
                for text, marks in zip(b.column("text").to_pylist(), b.column("marks"), strict=True):
                    all_words = (text or "").encode().split()
                    if (marks := marks.as_py()) is None:
                        out.append((len(all_words), 0, b" ".join(all_words)))
                        continue
                    gone = removed_words(len(all_words), marks, window)
                    out.append((len(all_words), int(gone.sum()), b" ".join(all_words[i] for i in np.flatnonzero(~gone))))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("text"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2].decode() for x in out], pa.string())],
                    ["doc_id", "text", "n_words", "n_removed", "kept_text"],
                )

    return covered(docs, flags, window).select("doc_id", "text", "marks").mapInArrow(each, "doc_id long, text string, n_words long, n_removed long, kept_text string")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: Every window of 50 words by text; the words of windows that an earlier document holds go.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM s),
f AS (SELECT k, min(doc_id) AS first FROM h GROUP BY k),
g AS (SELECT DISTINCT h.doc_id, unnest(range(h.i, h.i + 50)) AS j FROM h JOIN f USING (k) WHERE h.doc_id > f.first),
r AS (SELECT doc_id, list(j) AS gone FROM g GROUP BY doc_id),
x AS (SELECT d.doc_id, d.w, coalesce(r.gone, []) AS gone FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
  sha256(array_to_string([w[j] FOR j IN range(1, len(w) + 1) IF NOT list_contains(gone, j)], ' ')) AS kept_sha256
FROM x
"""
