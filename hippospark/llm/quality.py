"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades come from the labels: 0 toxic, 1 of low quality, 2 good. One vector of hashed-text weights is shared by all grades,
and ordered thresholds cut its score: P(grade <= j) = sigmoid(threshold_j - score). The expected grade and the tail
probability P(grade = 2) of every document follow; a document is rejected when that tail is below 0.5.

Features of a text: its distinct runs of letters (lower case), their first four bytes, and runs of other signs, hashed, and in steps the shares of
repeated words, of words in capitals and of signs. At most `LABELLED` labelled documents (those of least seeded hash of
doc_id) fit the model, in one task; only its weights reach the driver. Everything else covers all rows.

Defined results: null and empty texts have their own feature and are graded like any other; labels with a null quality
and toxic are left out; repeated rows are graded alike; without labels every document has score 0, tail 1 and is kept;
an empty table gives an empty result; all columns of the caller are carried in one struct, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

BITS, LABELLED, GRADES, SEED, PREFIX = 20, 20_000, 3, 97, 4
KIND = np.ones(256, np.uint8)  # other signs
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 2  # letters
KIND[[9, 10, 11, 12, 13, 32]] = 0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CAPITAL = np.zeros(256, bool)
CAPITAL[65:91] = True


def features(data: np.ndarray, off: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each document, and offsets."""
    docs, size = len(off) - 1, len(data)
    kind = KIND[data]
    begin = np.zeros(size + 1, bool)
    begin[off] = True
    begin = begin[:size].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(begin)
    ends = np.concatenate((starts[1:], [size]))
    real = kind[starts] > 0 if size else np.zeros(0, bool)
    starts, ends = starts[real], ends[real]
    h = C.ONE.span(C.ONE.prefix(LOWER[data]), starts, ends)
    doc = np.searchsorted(off, starts, "right") - 1
    key = (doc.astype(np.uint64) << np.uint64(bits)) | (h >> np.uint64(64 - bits))
    # words by their beginning too
    stem = C.TWO.span(C.TWO.prefix(LOWER[data]), starts, np.minimum(starts + PREFIX, ends)) >> np.uint64(64 - bits)
    stem = (doc.astype(np.uint64) << np.uint64(bits)) | stem
    letters = kind[starts] == 2
    n = np.bincount(doc[letters], minlength=docs)
    once = np.bincount((np.unique(key[letters]) >> np.uint64(bits)).astype(np.int64), minlength=docs)
    caps = CAPITAL[data[starts[letters]]] & CAPITAL[data[np.maximum(ends[letters] - 1, 0)]] & (ends[letters] - starts[letters] > 1)
    loud = np.bincount(doc[letters][caps], minlength=docs)
    signs = np.bincount(doc[~letters], minlength=docs)
    step = lambda x, y: np.minimum(9, 10 * x // np.maximum(1, y))
    style = [step(once, n), step(loud, n), step(signs, n + signs), np.minimum(15, np.log2(n + 1).astype(np.int64))]
    extra = [C.mix((np.arange(docs) * 0 + 1000 * (i + 1) + s).astype(np.uint64)) >> np.uint64(64 - bits) for i, s in enumerate(style)]
    every = np.arange(docs, dtype=np.uint64) << np.uint64(bits)
    key = np.unique(np.concatenate((key, stem[letters], *(every | e for e in extra))))
    return (key & np.uint64((1 << bits) - 1)).astype(np.int32), np.searchsorted(key >> np.uint64(bits), np.arange(docs + 1))


class Ordinal:
    """Shared weights and ordered thresholds, fitted by Adagrad on small batches."""

    def __init__(self, bits: int = BITS, grades: int = GRADES):
        self.weights, self.thresholds = np.zeros(1 << bits), np.linspace(-1, 0, grades - 1) - 20.0

    def fit(self, rows: list[np.ndarray], grade: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 0.3, slow: float | None = None) -> "Ordinal":
        if not len(rows):
            return self
        # thresholds begin at the grades' shares among the ratings
        share = np.cumsum(np.bincount(grade, minlength=len(self.thresholds) + 1) + 1.0)
        share = share[:-1] / share[-1]
        rng, w, b = np.random.default_rng(SEED), self.weights, np.log(share / (1 - share))
        last, slow = len(b), slow or max(3.0, len(rows) / 20)  # words of few documents hardly count
        gw, gb = np.full(len(w), slow), np.full(last, 1.0)
        weight = np.bincount(grade, minlength=last + 1)
        weight = np.sqrt(len(grade) / np.maximum(weight, 1) / (last + 1))
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for x in range(0, len(order), batch):
                pick = order[x : x + batch]
                size = np.array([len(rows[i]) for i in pick])
                f, doc = np.concatenate([rows[i] for i in pick]), np.repeat(np.arange(len(pick)), size)
                s = np.bincount(doc, w[f], len(pick))
                y = grade[pick]
                top = np.where(y == last, np.inf, b[np.minimum(y, last - 1)]) - s
                low = np.where(y == 0, -np.inf, b[np.maximum(y - 1, 0)]) - s
                ptop, plow = sigmoid(top), sigmoid(low)
                p = np.maximum(ptop - plow, 1e-9)
                dtop, dlow = ptop * (1 - ptop) / p * weight[y], plow * (1 - plow) / p * weight[y]
                g = np.clip(dtop - dlow, -5, 5)  # of the loss by the score
                u, back = np.unique(f, return_inverse=True)
                grad = np.bincount(back, g[doc], len(u))
                gw[u] += grad * grad
                w[u] -= rate * grad / np.sqrt(gw[u])
                db = np.array([dlow[y == j + 1].sum() - dtop[y == j].sum() for j in range(last)])
                gb += db * db
                b -= rate * db / np.sqrt(gb)
                b[:] = np.maximum.accumulate(b + np.arange(last) * 1e-3)
        self.thresholds = b
        return self

    def load(self, weights: bytes, thresholds: bytes) -> "Ordinal":
        self.weights, self.thresholds = np.frombuffer(weights, "f4"), np.frombuffer(thresholds, "f8")
        return self

    def grade(self, f: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, expected grades and probabilities of the highest grade."""
        total = np.concatenate(([0.0], np.cumsum(self.weights[f], dtype=np.float64)))
        s = total[off[1:]] - total[off[:-1]]
        above = 1 - sigmoid(self.thresholds[None, :] - s[:, None])
        return s, above.sum(axis=1), above[:, -1]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def rated_sample(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """doc_id, grade and text of at most `limit` labelled documents; a document with several ratings has the lowest."""
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") <= 0, 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 2)
    rated = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.cast("int").alias("grade")).where("doc_id is not null and grade is not null")
    rated = rated.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(limit)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(rated), "doc_id").select("doc_id", "grade", "text")


def fit(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> Ordinal:
    """docs: doc_id, text; labels: doc_id, quality, toxic. Features come from all tasks, `limit` documents at most fit in one."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, off in C.slices(batch, "text"):
                f, at = features(data, off)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("grade"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(f))], ["doc_id", "grade", "f"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, grades = [], []
        for batch in batches:
            for i in range(min(batch.num_rows, limit - len(rows))):
                rows.append(batch.column("f")[i].values.to_numpy().copy())
            grades += batch.column("grade").to_pylist()
        model = Ordinal().fit(rows, np.array(grades[: len(rows)], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in ((model.weights, "f4"), (model.thresholds, "f8"))], ["weights", "thresholds"])

    rows = rated_sample(docs, labels, limit).mapInArrow(each, "doc_id long, grade int, f array<int>")
    row = rows.repartition(1).sortWithinPartitions("doc_id", "f").mapInArrow(fitted, "weights binary, thresholds binary").first()
    return Ordinal().load(row["weights"], row["thresholds"]) if row else Ordinal()


def grade(docs: DataFrame, model: Ordinal) -> DataFrame:
    """row (a struct of all columns of docs), score, expected_grade, p_good, keep."""
    extra = [("score", T.DoubleType()), ("expected_grade", T.DoubleType()), ("p_good", T.DoubleType()), ("keep", T.BooleanType())]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, off in C.slices(batch, "_text"):
                s, e, p = model.grade(*features(data, off))
                yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array(s), pa.array(e), pa.array(p), pa.array(p >= 0.5)], ["row", *(n for n, _ in extra)])

    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(each, T.StructType([rows.schema["row"], *(T.StructField(n, t) for n, t in extra)]))


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return grade(docs.select("doc_id", "text"), fit(docs, labels)).select("row.doc_id", "score", "expected_grade", "p_good", "keep")
