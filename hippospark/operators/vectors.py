"""Exact cosines of rows against rows, block against block. Blocks move in stripes: every stripe of one side meets every one of the other
in a task, which holds two stripes and the cosines of two blocks at most. As long as a stripe has room the number of stripes stays, so that
what is shuffled grows as the vectors do.

Rows whose vector is null, empty or holds a null, and rows without an id, take no part; vectors of different lengths
never meet; a vector of norm 0 has cosine 0 with all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hippospark.functions import scalar as S
from hippospark.functions.storage import saved

#: Rows of a block; stripes of rows that meet each other, and bytes of vectors above which a stripe is split.
BLOCK, STRIPES, STRIPE_BYTES = 1024, 12, 16 << 20


class Blocks(NamedTuple):
    """rows: dim, block (its number), rows. n blocks, in `least` stripes at least."""

    rows: DataFrame
    n: int
    least: int


def blocks(rows: DataFrame, id_col: str, vec: str) -> Blocks:
    v = rows.select(F.col(id_col).cast("long").alias("id"), S.doubles(vec).alias("v")).where("id is not null and size(v) > 0").where(F.forall("v", lambda x: x.isNotNull()))
    count, dim = v.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    n = max(1, -(-count // BLOCK))
    packed = v.groupBy(F.size("v").alias("dim"), F.pmod(F.xxhash64("id", F.hash("v")), F.lit(n)).alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    return Blocks(saved(packed, "vectors"), n, max(1, -(-count * dim * 8 // STRIPE_BYTES)))


def unit(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(norm > 0, norm, 1.0)


def meetings(left: Blocks, right: Blocks | None) -> DataFrame:
    """The blocks (dim, block, rows) of every two stripes x and y that meet, with the sides that they take there: one of each, or any two of one."""
    dealt = lambda side, n, others: side.rows.withColumn("s", F.pmod("block", F.lit(n)).cast("int")).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
    rest = ("dim", "block", "rows")
    if right is None:
        n = max(left.least, min(left.n, STRIPES))
        return dealt(left, n, n).select(F.least("s", "t").alias("x"), F.greatest("s", "t").alias("y"), (F.col("s") <= F.col("t")).alias("is_x"), (F.col("s") >= F.col("t")).alias("is_y"), *rest)
    n, m = left.least, max(right.least, min(right.n, 2 * STRIPES))
    x = dealt(left, n, m).select(F.col("s").alias("x"), F.col("t").alias("y"), F.lit(True).alias("is_x"), F.lit(False).alias("is_y"), *rest)
    return x.unionByName(dealt(right, m, n).select(F.col("t").alias("x"), F.col("s").alias("y"), F.lit(False).alias("is_x"), F.lit(True).alias("is_y"), *rest))


def cosines(left: Blocks, right: Blocks | None, keep: Callable, schema: str, fold: Callable | None = None) -> DataFrame:
    """Of all blocks of left with all of right, or of left with each other once. keep: (ids of x, ids of y, cosines, same block) to columns
    of schema; fold: the columns of a task's blocks together to fewer."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "double": pa.float64()}[c.split()[1]] for c in schema.split(", ")]
    own = right is None

    def each(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, x, y = (k.as_py() for k in key)
        xs, ys, found = [], [], []
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.column("rows")[i].values
                block = batch.column("block")[i].as_py(), r.field("id").to_numpy(), unit(r.field("v").flatten().to_numpy().reshape(-1, dim))
                for side, name in ((xs, "is_x"), (ys, "is_y")):
                    if batch.column(name)[i].as_py():
                        side.append(block)
        for p, a, va in xs:
            for q, b, vb in ys:
                if own and x == y and p > q:
                    continue
                c = va @ vb.T
                out = keep(a, b, np.clip(c, -1.0, 1.0, out=c), own and p == q)
                if fold is None:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)
                else:
                    found.append(out)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(fold(*map(np.concatenate, zip(*found, strict=True))), kinds, strict=True)], names)

    return meetings(left, right).groupBy("dim", "x", "y").applyInArrow(each, schema)


def all_pairs(rows: DataFrame, id_col: str, vec: str, least: float) -> DataFrame:
    """a < b, score: every pair whose cosine, to six digits, is at least `least` (above 0)."""

    def keep(a: np.ndarray, b: np.ndarray, c: np.ndarray, same: bool) -> tuple:
        i, j = np.nonzero(c >= least - 1e-6)
        s = np.round(c[i, j], 6)
        # a block meets itself in both orders
        fine = (s >= least) & (a[i] < b[j] if same else a[i] != b[j])
        return np.minimum(a[i], b[j])[fine], np.maximum(a[i], b[j])[fine], s[fine]

    return cosines(blocks(rows, id_col, vec), None, keep, "a long, b long, score double")


def nearest(rows: DataFrame, id_col: str, vec: str) -> DataFrame:
    """id, near: the largest cosine with any row of another id, 0 at least."""

    def keep(a: np.ndarray, b: np.ndarray, c: np.ndarray, same: bool) -> tuple:
        if len(np.intersect1d(a, b)):
            c = np.where(a[:, None] == b[None, :], 0.0, c)
        return np.concatenate((a, b)), np.maximum(np.concatenate((c.max(axis=1), c.max(axis=0))), 0.0)

    def largest(ids: np.ndarray, near: np.ndarray) -> tuple:
        order = np.argsort(ids, kind="stable")
        each, starts = np.unique(ids[order], return_index=True)
        return each, np.maximum.reduceat(near[order], starts)

    return cosines(blocks(rows, id_col, vec), None, keep, "id long, near double", largest).groupBy("id").agg(F.max("near").alias("near"))


def topk(queries: DataFrame, rows: DataFrame, id_col: str, vec: str, k: int) -> DataFrame:
    """query_id, id, score: per query and block the k rows of other ids with the largest cosine, to six digits."""

    def keep(a: np.ndarray, b: np.ndarray, c: np.ndarray, same: bool) -> tuple:
        c = np.where(a[:, None] == b[None, :], -np.inf, np.round(c, 6))
        i = np.repeat(np.arange(len(a)), min(k, len(b)))
        j = np.concatenate([np.lexsort((b, -r))[:k] for r in c])
        fine = c[i, j] > -np.inf
        return a[i][fine], b[j][fine], c[i, j][fine]

    return cosines(blocks(queries, id_col, vec), blocks(rows, id_col, vec), keep, "query_id long, id long, score double")


def dedup_candidates(batch: DataFrame, rows: DataFrame, id_col: str, vec: str, k: int) -> DataFrame:
    """query_id, id, score as topk: for each of a batch's records the nearest of all that are not in the batch, which may already be
    among the rows."""
    return topk(batch, rows.join(batch.select(id_col).distinct(), id_col, "left_anti"), id_col, vec, k)
