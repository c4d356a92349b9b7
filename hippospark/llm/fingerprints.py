"""Document fingerprints: threshold-scaled sketches.

A document's shingles are its runs of five words (all words, where there are fewer). Every shingle hash below a fixed
fraction of the hash range is retained and no other, so sketches of parts merge by union, and the containment of a short
document in a long one is estimated without bias. Where all hashes of a text lie above the threshold, its least hash is
kept apart from the sketch, marked, and compared only with that of another such text. A fingerprint is the sorted
retained hashes, 48 bits each, in base64.

Defined results: null and empty texts (and texts of white space) have the empty fingerprint; two empty ones are alike
(1.0), an empty and another are not (0.0); repeated rows count each, in doc_id order with ties by text; a null doc_id
comes first in that order; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

SHINGLE, FRACTION = 5, 1 / 4
#: Text per part of the table in doc_id order.
PART_BYTES = 8 << 20
#: Most quantiles of doc_id.
STRETCHES = 256


class Sketch(NamedTuple):
    """Retained hashes, sorted; and the least hash of all, only where none is retained (None without words)."""

    kept: np.ndarray
    least: int | None


def sketches(data: np.ndarray, off: np.ndarray, k: int = SHINGLE, fraction: float = FRACTION) -> list[Sketch]:
    """The sketch of each document, by 48-bit hashes."""
    starts, ends, first = C.words(data, off)
    n = np.diff(first)
    count = np.where(n == 0, 0, np.maximum(1, n - k + 1))
    pre = C.TWO.prefix(C.word_hashes(data, starts, ends))
    begin, doc = C.ranges(first[:-1], count), np.repeat(np.arange(len(n)), count)
    h = C.TWO.span(pre, begin, np.minimum(begin + k, first[1:][doc])) >> np.uint64(16)
    edge = np.concatenate(([0], np.cumsum(count)))
    least = np.full(len(n), np.uint64(1 << 48))
    some = np.flatnonzero(count)
    if len(some):
        least[some] = np.minimum.reduceat(h, edge[some])
    top = np.uint64(int(fraction * (1 << 48)))
    keep = h < top
    h, doc = h[keep], doc[keep]
    cut = np.searchsorted(doc, np.arange(len(n) + 1))
    return [Sketch(np.unique(h[x:y]), int(m) if c and m >= top else None) for x, y, m, c in zip(cut[:-1], cut[1:], least, count, strict=True)]


def coded(sketch: Sketch) -> str:
    """The retained hashes in base64; "~" and the least hash where none is retained; empty without words."""
    hashes = sketch.kept if sketch.least is None else np.array([sketch.least])
    return ("" if sketch.least is None else "~") + base64.b64encode(hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decoded(fingerprint: str) -> Sketch:
    raw = np.frombuffer(base64.b64decode(fingerprint.removeprefix("~")), np.uint8).reshape(-1, 6)
    hashes = np.concatenate((np.zeros((len(raw), 2), np.uint8), raw), axis=1).reshape(-1).view(">u8").astype(np.uint64)
    return Sketch(hashes[:0], int(hashes[0])) if fingerprint.startswith("~") else Sketch(hashes, None)


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated Jaccard similarity; of two texts without retained hashes, whether their least ones agree."""
    if not len(a.kept) and not len(b.kept):
        return float(a.least == b.least)
    both = len(np.intersect1d(a.kept, b.kept, assume_unique=True))
    return both / (len(a.kept) + len(b.kept) - both)


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of a's shingles that b has; not a number where a retains none."""
    return len(np.intersect1d(a.kept, b.kept, assume_unique=True)) / len(a.kept) if len(a.kept) else float("nan")


def merged(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of two documents' shingles together."""
    kept = np.union1d(a.kept, b.kept)
    least = [x.least for x in (a, b) if x.least is not None]
    return Sketch(kept, min(least) if least and not len(kept) else None)


def fingerprint(docs: DataFrame, k: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """row (a struct of all columns of docs) and fingerprint."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, off in C.slices(batch, "_text"):
                yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array([coded(s) for s in sketches(data, off, k, fraction)], pa.string())], ["row", "fingerprint"])

    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(each, T.StructType([rows.schema["row"], T.StructField("fingerprint", T.StringType())]))


def parts_of(docs: DataFrame) -> tuple[Column, int]:
    """The number of the part that a doc_id belongs to, in order: quantiles of doc_id, as many as `STRETCHES` at most, each cut
    into equal stretches, so that one far-off id leaves the others' parts as they are."""
    total, low, high = docs.agg(F.sum(F.octet_length("text")), F.min("doc_id"), F.max("doc_id")).first()
    n = max(1, -(-(total or 0) // PART_BYTES))
    if n == 1 or low is None:
        return F.lit(0).cast("long"), 1
    wide = min(n, STRETCHES)
    cuts = docs.agg(F.percentile_approx("doc_id", F.array(*(F.lit(i / wide) for i in range(1, wide))), F.lit(10_000))).first()[0] if wide > 1 else []
    edges = [low, *sorted(set(cuts) - {low}), high + 1]
    inner = -(-n // wide)
    begins, widths = (F.array(*(F.lit(x).cast("double") for x in xs)) for xs in (edges[:-1], [max(1, y - x) for x, y in zip(edges[:-1], edges[1:], strict=True)]))
    stretch = F.greatest(F.lit(1), F.size(F.filter(begins, lambda x: x <= F.col("doc_id"))))
    within = (F.col("doc_id") - F.element_at(begins, stretch)) / F.element_at(widths, stretch) * inner
    part = (stretch - 1) * inner + F.least(F.lit(inner - 1), F.floor(within))
    return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(part).cast("long"), n


def with_next(docs: DataFrame) -> DataFrame:
    """Rows in parts of consecutive doc_ids, sorted, each part ending with the row that follows it (halo)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("part", parts_of(docs)[0])
    # each part's first document also ends the part before it (the first part's the last); only numbers go through one task
    heads = docs.groupBy("part").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("order"), "text")).alias("head"))
    every = docs.select("part").distinct()
    before = every.select(F.col("part").alias("next"), F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(Window.partitionBy())).alias("part"))
    heads = heads.withColumnRenamed("part", "next").join(before, "next").select("part", F.lit(None).cast("long").alias("doc_id"), "head.text", F.lit(1).alias("halo"))
    rows = docs.select("part", "doc_id", "text", F.lit(0).alias("halo")).unionByName(heads)
    return rows.repartition("part").sortWithinPartitions("part", "halo", F.asc_nulls_first("doc_id"), "text")


def edited(text: str, other: str) -> str:
    """text with its last quarter of code points replaced by the first as many (or all) of other."""
    q = len(text) // 4
    return text[: len(text) - q] + other[:q]


def compare_edits(docs: DataFrame, k: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        for batch in batches:
            for piece, data, off in C.slices(batch, "text"):
                own = sketches(data, off, k, fraction)
                texts, ids, parts = (piece.column(c).to_pylist() for c in ("text", "doc_id", "part"))
                halo = piece.column("halo").to_pylist()
                rows = [(ids[i], texts[i], own[i], parts[i], halo[i]) for i in range(len(ids))]
                rows = ([last] if last else []) + rows
                last = rows[-1]
                pairs = [(a, b) for a, b in zip(rows[:-1], rows[1:], strict=True) if not a[4]]
                changed = [edited(a[1], b[1]) for a, b in pairs]
                body = [x.encode() for x in changed]
                at = np.concatenate(([0], np.cumsum([len(x) for x in body]))).astype(np.int64)
                new = sketches(np.frombuffer(b"".join(body), np.uint8), at, k, fraction)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([a[0] for a, _ in pairs], pa.int64()),
                        pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in body], pa.string()),
                        pa.array([coded(a[2]) for a, _ in pairs], pa.string()),
                        pa.array([coded(x) for x in new], pa.string()),
                        pa.array([likeness(a[2], x) for (a, _), x in zip(pairs, new, strict=True)], pa.float64()),
                        pa.array([likeness(a[2], b[2]) for a, b in pairs], pa.float64()),
                    ],
                    names,
                )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(each, schema)


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
