"""Approximate nearest neighbours by collision counting with virtual rehashing.

Every block of vectors is indexed once: for each of `tables` random projections its rows in the order of that single
projection, kept as sorted arrays in a table in the shared folder. A query looks at a window around its own projection in
each array; a vector collides where it lies in the window. Windows widen by virtual rehashing (a larger radius, the same
arrays), and vectors that collide often enough for that radius are verified by their inner product. A query stops
widening in a block once as many verified vectors as it wants lie within the radius, or none are left out. For the
largest inner product the vectors get one more component that makes their norms equal, which turns it into the nearest
distance. The first radius of a block comes from the distances within a sample of its rows.

Queries are a stated set; each part of them meets every block, index first, so a task holds one block's index and one
batch of queries, and a block gives a query at most `k` rows. The work is queries times vectors: the windows of 64 random
dimensions cover about half of a block by the time that they hold the nearest.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component, and rows without a vec_id,
take no part; vectors of different lengths never meet; a query never finds its own row, but rows that share its vec_id,
even equal ones, are candidates like any other, and each such query has a ranking of its own; ties go to the smaller
vec_id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

TABLES, GROWTH, MISSED, SEED = 32, 1.1, 1.5, 5
#: Rows of a block of vectors, and of a part of the queries.
BLOCK, QUERIES = 16_384, 8_192
#: Rows whose distances give a block's first radius, and work for each core where there are few blocks.
SAMPLE, WORKS = 64, 4


class SortedProjections:
    """The index of one block: per projection, the block's rows in its order."""

    def __init__(self, vectors: np.ndarray, order: np.ndarray, values: np.ndarray, radii: np.ndarray, lines: np.ndarray):
        self.vectors, self.light, self.order, self.values, self.radii, self.lines = vectors, vectors.astype(np.float32), order.astype(np.intp), values, radii, lines
        self.most = float(np.sqrt((vectors**2).sum(axis=1)).max())

    @staticmethod
    def projections(dim: int, tables: int) -> np.ndarray:
        return np.random.default_rng(SEED).standard_normal((dim + 1, tables))

    @classmethod
    def build(cls, vectors: np.ndarray, tables: int = TABLES) -> "SortedProjections":
        lines = cls.projections(vectors.shape[1], tables)
        norm = np.sqrt((vectors**2).sum(axis=1))
        lifted = np.concatenate((vectors / norm.max(), np.sqrt(np.maximum(0, 1 - (norm / norm.max()) ** 2))[:, None]), axis=1)
        shadow = (lifted @ lines).T
        order = np.argsort(shadow, axis=1, kind="stable").astype(np.int32)
        # sorted distances from a few rows, as queries, to the others: what radius holds how many
        some = np.random.default_rng(SEED).choice(len(vectors), min(SAMPLE, len(vectors)), replace=False)
        asked = np.concatenate((vectors[some] / norm[some][:, None], np.zeros((len(some), 1))), axis=1)
        apart = np.sort(np.sqrt(np.maximum(0, ((asked**2).sum(axis=1)[:, None] + 1) - 2 * asked @ lifted.T)), axis=1)
        return cls(vectors, order, np.take_along_axis(shadow, order.astype(np.intp), axis=1), np.quantile(apart, 0.1, axis=0), lines)

    def first_radius(self, want: int) -> float:
        """What holds as many rows as wanted around one row in ten."""
        return max(1e-3, float(self.radii[min(want, len(self.radii) - 1)]))

    def search(self, query: np.ndarray, k: int, skip: np.ndarray, id_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact inner products of the k nearest found; skip: places that take no part."""
        n, tables = len(self.vectors), len(self.order)
        want = min(k, n - len(skip))
        if want <= 0:
            return np.zeros(0, np.int64), np.zeros(0)
        length = float(np.sqrt((query**2).sum()))
        shadow, light = np.concatenate((query / length, [0.0])) @ self.lines, query.astype(np.float32)
        done = np.zeros(n, bool)
        done[skip] = True
        found, score = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        count, low, high = np.zeros(n, np.int64), None, None
        # at its radius a vector collides in a table with probability erf(1 / sqrt 2) = 0.683
        need = 0.6827 * tables - MISSED * np.sqrt(tables * 0.6827 * 0.3173)
        radius = self.first_radius(want)
        while True:
            to_low = [int(v.searchsorted(s - radius, "left")) for v, s in zip(self.values, shadow, strict=True)]
            to_high = [int(v.searchsorted(s + radius, "right")) for v, s in zip(self.values, shadow, strict=True)]
            if low is None:
                rings = [o[a:b] for o, a, b in zip(self.order, to_low, to_high, strict=True)]
            else:
                rings = [o[a:b] for o, a, b in zip(self.order, to_low, low, strict=True)] + [o[a:b] for o, a, b in zip(self.order, high, to_high, strict=True)]
            count += np.bincount(np.concatenate(rings), minlength=n)
            low, high = to_low, to_high
            near = np.flatnonzero((count >= need) & ~done)
            done[near] = True
            found.append(near)
            score.append(self.light[near] @ light)
            values = np.concatenate(score)
            # within the radius: distance**2 = 2 - 2 * product / (length * most)
            if np.count_nonzero(2 - 2 * values / (length * self.most) <= radius**2) >= want or done.all():
                break
            radius = 64.0 if radius > 2.5 else radius * GROWTH
        place, values = np.concatenate(found), np.concatenate(score)
        if len(place) > want:
            # single precision chooses, with a margin that its error stays within; double precision ranks
            least = np.partition(values, len(values) - want)[len(values) - want]
            place = place[values >= least - 1e-4 * length * self.most]
        exact = (self.vectors[place] * query).sum(axis=1)
        best = np.lexsort((id_of[place], -exact))[:want]
        return place[best], exact[best]


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding as doubles and its length, without vectors that take no part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(fine).where(F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def index(rows: DataFrame, blocks: int, tables: int) -> DataFrame:
    """One row per block of vectors (row, vec_id, v, dim): its rows and its sorted arrays, as bytes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, held = batch.column("dim")[i].as_py(), batch.column("held")[i].values
                built = SortedProjections.build(held.field("v").flatten().to_numpy().reshape(-1, dim), tables)
                parts = (held.field("row").to_numpy(), held.field("vec_id").to_numpy(), built.vectors, built.order.astype(np.int32), built.values, built.radii)
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), batch.column("block").slice(i, 1), *(pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts)], INDEX)

    packed = rows.groupBy("dim", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block")).agg(F.sort_array(F.collect_list(F.struct("row", "vec_id", "v"))).alias("held"))
    return packed.select("dim", "block", "held").mapInArrow(each, "dim int, block int, rows binary, ids binary, vectors binary, sorted binary, shadows binary, radii binary")


INDEX = ["dim", "block", "rows", "ids", "vectors", "sorted", "shadows", "radii"]


def search(vectors: DataFrame, asks: str = "true", k: int = 20, tables: int = TABLES) -> DataFrame:
    """vectors: vec_id, v, dim (see `clean`); asks: the condition on rows that are queries. Per query its k nearest: query_row (a
    number of the query's row), query_id, rank, vec_id, score."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column("dim")[i].as_py()
                if batch.column("asked")[i].as_py() is None:
                    rows, ids = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in ("rows", "ids"))
                    v, order, values, radii = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in (("vectors", np.float64), ("sorted", np.int32), ("shadows", np.float64), ("radii", np.float64)))
                    held = rows, ids, SortedProjections(v.reshape(-1, dim), order.reshape(tables, -1), values.reshape(tables, -1), radii, SortedProjections.projections(dim, tables))
                    continue
                rows, ids, built = held
                asked, out = batch.column("asked")[i].values, []
                for row, q, v in zip(asked.field("row").to_numpy(), asked.field("vec_id").to_numpy(), asked.field("v").flatten().to_numpy().reshape(-1, dim), strict=True):
                    own = np.searchsorted(rows, row)
                    own = np.array([own] if own < len(rows) and rows[own] == row else [], np.int64)
                    place, value = built.search(v, k, own, ids)
                    out.append((np.full(len(place), row), np.full(len(place), q), ids[place], value))
                a = [np.concatenate([x[j] for x in out]) for j in range(4)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in a[:3]), pa.array(a[3], pa.float64())], ["query_row", "query_id", "vec_id", "score"])

    # rows get their numbers in a written table, so they stay the same wherever they are read again
    table = C.saved(vectors.withColumn("row", F.monotonically_increasing_id()), "op4-vectors")
    n, n_asked = table.count(), table.where(asks).count()
    blocks = max(1, -(-n // BLOCK))
    parts = max(-(-n_asked // QUERIES), min(n_asked, -(-WORKS * vectors.sparkSession.sparkContext.defaultParallelism // blocks)), 1)
    built = C.saved(index(table, blocks, tables), "op4-index")
    each_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    queries = table.where(asks).select("dim", "row", "vec_id", "v", F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(parts)).cast("int").alias("part"))
    # a part of the queries comes in batches of a few hundred, whatever its size
    queries = queries.groupBy("dim", "part", F.pmod(F.xxhash64(F.lit(2), "row"), F.lit(-(-QUERIES // 256))).alias("batch")).agg(F.sort_array(F.collect_list(F.struct("row", "vec_id", "v"))).alias("asked"))
    met = built.select("dim", "block").join(queries, "dim")
    works = built.select("*", each_part).withColumn("asked", F.lit(None).cast(queries.schema["asked"].dataType)).unionByName(met.drop("batch"), allowMissingColumns=True)
    works = works.repartition(blocks * parts, "dim", "block", "part").sortWithinPartitions("dim", "block", "part", F.col("asked").isNotNull())
    found = works.select(*INDEX, "asked").mapInArrow(each, "query_row long, query_id long, vec_id long, score double")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_row", "query_id", "rank", "vec_id", "score")


def op4_collision_ann(spark, sf_dir: str) -> DataFrame:
    found = search(clean(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vec_id % 20 = 0")
    return found.select("query_id", "rank", "vec_id", "score")
