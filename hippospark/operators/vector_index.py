"""An approximate index of vectors: lists around centroids, insertion, removal, compaction.

Vectors are of length one. Centroids are fitted once, on at most `SAMPLE` of the vectors there are; every vector goes to the
list of its nearest centroid, and a list is a partition of the table, so a search reads the lists nearest to its query and no
others. Removal marks; once more than half as many are marked as live, of 200 live ones at least, the table is written anew
and the centroids are fitted again. A batch of changes is one version; of two writers of a version the second starts again.

Defined results: a vector that is null, of length zero or with components that are null or not finite is not taken in; of
rows with one id the one with the largest vector counts; an id that comes again replaces its former vector.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hippospark.functions import scalar as S
from hippospark.functions.commits import Versions
from hippospark.functions.storage import forget, saved

#: Vectors that centroids are fitted on, centroids at most, vectors of a list on average, rounds of fitting.
SAMPLE, LISTS, PER_LIST, ROUNDS = 20_000, 1_024, 500, 8
LIVE = 200


def fitted(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """k unit centroids of unit vectors by spherical k-means; no more than there are distinct vectors to begin with."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
    return c


class VectorIndex:
    def __init__(self, spark: SparkSession, root: str, id_type: str = "string", per_list: int = PER_LIST):
        self.spark, self.root, self.id_type, self.per_list = spark, root.rstrip("/"), id_type, per_list
        self.schema = f"id {id_type}, v array<double>, list int"
        self.versions = Versions(spark, f"{self.root}/versions")

    def state(self) -> tuple[int, dict]:
        """Centroids, segments by number (path), marks (paths), live and marked vectors, the next number."""
        number, s = self.versions.last()
        return number, s or {"centroids": [], "segments": {}, "marks": [], "live": 0, "marked": 0, "next": 1}

    # Writing

    def _unit(self, rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
        v = S.doubles(vec_col)
        fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        rows = rows.select(F.col(id_col).cast(self.id_type).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine)
        rows = rows.where(S.norm(F.col("v")) > 0).groupBy("id").agg(F.max("v").alias("v"))
        return rows.select("id", F.transform("v", lambda x: x / S.norm(F.col("v"))).alias("v"))

    def _centroids(self, rows: DataFrame, n: int) -> list[list[float]]:
        some = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()
        x = np.array(some.v.tolist())
        return fitted(x, max(1, min(LISTS, len(x), round(n / self.per_list)))).tolist() if len(x) else []

    def _segment(self, rows: DataFrame, centroids: list[list[float]]) -> str:
        c = np.array(centroids)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = np.array(b.column("v").to_pylist())
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array((x @ c.T).argmax(axis=1), pa.int32())], ["id", "v", "list"])

        path = f"{self.root}/s-{uuid.uuid4().hex}"
        rows.mapInArrow(each, self.schema).repartition("list").write.partitionBy("list").parquet(path)
        return path

    def _read(self, s: dict) -> DataFrame:
        """Live vectors: id, v, list, seg."""
        out = None
        for n, path in s["segments"].items():
            one = self.spark.read.schema(self.schema).parquet(path).withColumn("seg", F.lit(int(n)))
            out = one if out is None else out.unionByName(one)
        if out is None:
            return self.spark.createDataFrame([], self.schema + ", seg int")
        return out.join(self.spark.read.schema(f"id {self.id_type}, seg int").parquet(*s["marks"]), ["id", "seg"], "left_anti") if s["marks"] else out

    def _mark(self, s: dict, ids: DataFrame) -> None:
        hit = saved(self._read(s).join(ids.select("id").distinct(), "id", "left_semi").select("id", F.col("seg").cast("int").alias("seg")), "marked")
        if n := hit.count():
            path = f"{self.root}/m-{uuid.uuid4().hex}"
            hit.write.parquet(path)
            s["marks"].append(path)
            s["live"], s["marked"] = s["live"] - n, s["marked"] + n
        forget(hit)

    def insert(self, rows: DataFrame, id_col: str = "id", vec_col: str = "v") -> None:
        rows = saved(self._unit(rows, id_col, vec_col), "vectors")
        n = rows.count()
        while n:
            number, s = self.state()
            if s["segments"]:
                self._mark(s, rows)
            s["centroids"] = s["centroids"] or self._centroids(rows, n)
            s["segments"][str(s["next"])] = self._segment(rows, s["centroids"])
            s["live"], s["next"] = s["live"] + n, s["next"] + 1
            if self.versions.put(number + 1, s):
                break
        forget(rows)
        self.compact()

    def remove(self, ids: DataFrame, id_col: str = "id") -> None:
        ids = ids.select(F.col(id_col).cast(self.id_type).alias("id"))
        while True:
            number, s = self.state()
            self._mark(s, ids)
            if self.versions.put(number + 1, s):
                break
        self.compact()

    def compact(self, force: bool = False) -> None:
        """Write what lives anew once the marked are more than half of it, of 200 at least."""
        while True:
            number, s = self.state()
            if not force and not (s["marked"] > s["live"] / 2 and s["live"] >= LIVE):
                return
            rows = saved(self._read(s).select("id", "v"), "live")
            centroids = self._centroids(rows, s["live"])
            new = {"centroids": centroids, "segments": {str(s["next"]): self._segment(rows, centroids)} if s["live"] else {}, "marks": [], "live": s["live"], "marked": 0, "next": s["next"] + 1}
            forget(rows)
            if self.versions.put(number + 1, new):
                return

    # Reading

    def nearest_lists(self, q: np.ndarray, probes: int, s: dict) -> list[int]:
        return np.argsort(-(np.array(s["centroids"]) @ q), kind="stable")[:probes].tolist()

    def search(self, query: Sequence[float], k: int = 10, probes: int | None = None) -> DataFrame:
        """id, score (cosine): the k nearest in the lists nearest to the query; by default the square root of their number, times three."""
        s = self.state()[1]
        q = np.array(query, float)
        size = np.linalg.norm(q)
        if not s["segments"] or not size:
            return self.spark.createDataFrame([], f"id {self.id_type}, score double")
        q = q / size
        probes = probes or 3 * math.ceil(math.sqrt(len(s["centroids"])))
        near = self._read(s).where(F.col("list").isin(self.nearest_lists(q, probes, s)))
        score = F.aggregate(F.zip_with("v", F.array(*map(F.lit, q.tolist())), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return near.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)

    def search_many(self, queries: DataFrame, k: int = 10, probes: int | None = None, id_col: str = "id", vec_col: str = "v") -> DataFrame:
        """query_id, rank (from 1), id, score: the k nearest of each query in the lists nearest to it. A query's lists and the vectors in
        them meet by list; each partition keeps a query's best k before they are ranked."""
        s = self.state()[1]
        c = np.array(s["centroids"])
        schema = f"query_id {self.id_type}, rank int, id {self.id_type}, score double"
        if not s["segments"]:
            return self.spark.createDataFrame([], schema)
        most = probes or 3 * math.ceil(math.sqrt(len(c)))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    near = np.argsort(-(np.array(b.column("v").to_pylist()) @ c.T), axis=1, kind="stable")[:, :most]
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(near.tolist(), pa.list_(pa.int32()))], ["query_id", "q", "lists"])

        q = self._unit(queries, id_col, vec_col).mapInArrow(each, f"query_id {self.id_type}, q array<double>, lists array<int>")
        pairs = self._read(s).join(q.select("query_id", "q", F.explode("lists").alias("list")), "list")
        score = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        ranked = pairs.select("query_id", "id", F.round(score, 6).alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.select("query_id", "rank", "id", "score")
