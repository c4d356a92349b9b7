"""A keyword index that is kept: immutable segments, delete marks, merged statistics, tiers, blocks with bounds.

A segment holds the postings of some texts twice: by term, in blocks of the same texts for every term, with each block's
largest count and least text length; and by text, for deletions and merging. Deleting marks texts of segments and keeps
the counts that go with them, so statistics are always those of a rebuilt index. Four segments of about one size become
one. A search reads its terms' blocks only. It bounds every block of texts by the sum of its terms' best cases, scores the
most promising ones first, and then only those that can still reach the k-th score found.

A batch of changes is one version: it holds as a whole or not at all, and of two writers of a version the second starts
again from the first one's.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hippospark.functions import scalar as S
from hippospark.functions.commits import Versions
from hippospark.functions.storage import forget, saved
from hippospark.operators.retrieval import B, K1

#: Texts of a block on average, segments of a tier that merge, blocks that are scored first, postings below which all are.
BLOCK, FANOUT, FIRST, SMALL = 1_024, 4, 16, 200_000
#: Bytes of texts and words that a task gets while a segment is written; words above which a block is split.
PART_BYTES, PART_WORDS, BLOCK_WORDS = 8 << 20, 1_000_000, 2_000_000


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Lengths of lists (0 for none), the list of each element, and the elements."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lengths, np.repeat(np.arange(len(lengths)), lengths), lists.flatten()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (id, tokens) to id, dl, words."""
    for batch in batches:
        lengths, at, tokens = _flat(batch.column("tokens"))
        known = tokens.dictionary_encode()
        n = max(1, len(known.dictionary))
        keys, tf = np.unique(at * n + known.indices.to_numpy(), return_counts=True)
        starts = np.searchsorted(keys, np.arange(len(lengths) + 1) * n).astype(np.int32)
        words = pa.StructArray.from_arrays([known.dictionary.take(pa.array(keys % n)), pa.array(tf, pa.int64())], ["term", "tf"])
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lengths), pa.ListArray.from_arrays(pa.array(starts), words)], ["id", "dl", "words"])


def _postings(texts: pa.Table) -> pa.Table:
    """Texts of one block (block, id, dl, words) to a row per term, in the order of terms."""
    texts = texts.combine_chunks()
    one = lambda c: pa.concat_arrays(texts.column(c).chunks)
    _, at, words = _flat(one("words"))
    known = words.field("term").dictionary_encode()
    places = np.empty(len(known.dictionary), np.int64)
    sort = pc.array_sort_indices(known.dictionary)
    places[sort.to_numpy()] = np.arange(len(sort))
    codes = places[known.indices.to_numpy()]
    order = np.argsort(codes, kind="stable")
    n = np.bincount(codes, minlength=len(sort))
    starts = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
    tf, dl = words.field("tf").to_numpy()[order], one("dl").to_numpy()[at[order]]
    rows = pa.StructArray.from_arrays([one("id").take(pa.array(at[order])), pa.array(tf), pa.array(dl)], ["id", "tf", "dl"])
    most, shortest = (f.reduceat(x, starts[:-1]) if len(n) else x for f, x in ((np.maximum, tf), (np.minimum, dl)))
    block = pa.array(np.full(len(n), texts.column("block")[0].as_py()), pa.int32())
    columns = [known.dictionary.take(sort), block, pa.ListArray.from_arrays(pa.array(starts), rows), pa.array(n, pa.int64()), pa.array(most, pa.int64()), pa.array(shortest, pa.int64())]
    return pa.Table.from_arrays(columns, ["term", "block", "rows", "n", "most", "shortest"])


class SegmentIndex:
    def __init__(self, spark: SparkSession, root: str, id_type: str = "string", block: int = BLOCK, fanout: int = FANOUT):
        self.spark, self.root, self.id_type, self.block, self.fanout = spark, root.rstrip("/"), id_type, block, fanout
        self.versions = Versions(spark, f"{self.root}/versions")

    # State: segments by number (path, texts, words), deletions (path, and by segment texts and words), the next number, and what the
    # caller notes (such as how far it has come).

    def state(self) -> tuple[int, dict]:
        number, state = self.versions.last()
        return number, state or {"segments": {}, "deletions": [], "next": 1, "note": None}

    def note(self) -> object:
        return self.state()[1]["note"]

    def size(self) -> tuple[int, int]:
        """Live texts and their words."""
        s = self.state()[1]
        gone = [d["gone"][n] for d in s["deletions"] for n in d["gone"] if n in s["segments"]]
        return sum(x["texts"] for x in s["segments"].values()) - sum(g[0] for g in gone), sum(x["words"] for x in s["segments"].values()) - sum(g[1] for g in gone)

    def _read(self, path: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path)

    def _union(self, parts: list[DataFrame], schema: str) -> DataFrame:
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return self.spark.createDataFrame([], schema) if out is None else out

    def _texts(self, s: dict, numbers: Sequence[str] | None = None) -> DataFrame:
        """Live texts with their words: seg, id, dl, words (of term and tf)."""
        schema = self._text_schema()
        parts = [self._read(f"{x['path']}/texts", schema).withColumn("seg", F.lit(int(n))) for n, x in s["segments"].items() if numbers is None or n in numbers]
        dead = self._dead(s)
        every = self._union(parts, schema + ", seg int")
        return every if dead is None else every.join(dead, ["id", "seg"], "left_anti")

    def _text_schema(self) -> str:
        return f"id {self.id_type}, dl long, words array<struct<term:string,tf:bigint>>"

    def _block_schema(self) -> str:
        return f"term string, block int, rows array<struct<id:{self.id_type},tf:bigint,dl:bigint>>, n long, most long, shortest long"

    def _dead(self, s: dict) -> DataFrame | None:
        paths = [f"{d['path']}/ids" for d in s["deletions"] if any(n in s["segments"] for n in d["gone"])]
        return self.spark.read.schema(f"id {self.id_type}, seg int").parquet(*paths) if paths else None

    # Writing

    def _counted(self, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """Texts (id, dl, words), of rows with one id the last text. Texts move once, by id, and a text's words are counted where it lies;
        partitions are as many as keep a task's texts small."""
        texts = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast(self.id_type).alias("id"), F.col(text_col).alias("text"))
        total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        one = texts.repartition(-(-total // PART_BYTES) or 1, "id").groupBy("id").agg(F.max("text").alias("text"))
        # as a generated row: within the aggregate's own result the words would be cut by interpreted expressions
        tokens = one.select("id", F.explode(F.array("text")).alias("text")).select("id", S.token_list(F.col("text")).alias("tokens"))
        return tokens.mapInArrow(_count_words, self._text_schema())

    def _segment(self, texts: DataFrame) -> dict:
        """Write a segment of texts (id, dl, words)."""
        path = f"{self.root}/s-{uuid.uuid4().hex}"
        texts.write.parquet(f"{path}/texts")
        held = self._read(f"{path}/texts", self._text_schema())
        n, words = held.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        blocks = max(1, -(-n // self.block), words // BLOCK_WORDS)
        # a block's texts go to one task as they are, which turns them into postings: those never move. A word of all texts spreads over
        # partitions by its blocks, and the pages of a term are found in each file, as each is in the order of terms
        parts = max(1, min(blocks, words // PART_WORDS))
        rows = held.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).repartition(parts, "block")
        packed = rows.groupBy("block").applyInArrow(_postings, self._block_schema())
        packed.sortWithinPartitions("term", "block").write.parquet(f"{path}/blocks")
        return {"path": path, "texts": n, "words": words}

    def _deletion(self, s: dict, ids: DataFrame) -> dict | None:
        """Mark live texts with these ids (id), and keep the counts of their words by segment."""
        hit = saved(self._texts(s).join(ids.select("id").distinct(), "id", "left_semi"), "deleted")
        gone = {str(r["seg"]): [r["texts"], r["words"]] for r in hit.groupBy("seg").agg(F.count("*").alias("texts"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).collect()}
        if gone:
            path = f"{self.root}/d-{uuid.uuid4().hex}"
            hit.select("id", F.col("seg").cast("int").alias("seg")).distinct().write.parquet(f"{path}/ids")
            hit.select("seg", F.explode("words.term").alias("term")).groupBy("seg", "term").agg(F.count("*").alias("n")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
        forget(hit)
        return {"path": path, "gone": gone} if gone else None

    def update(self, rows: DataFrame | None = None, deleted: DataFrame | None = None, id_col: str = "id", text_col: str = "text", note: object = None) -> None:
        """Put texts (an id's former text goes), take others out, and note something, as one version. Of rows with one id the one of the
        last text counts."""
        new = None
        if rows is not None:
            new = self._segment(self._counted(rows, id_col, text_col))
        ids = [x for x in (None if new is None else self._read(f"{new['path']}/texts", self._text_schema()).select("id"), None if deleted is None else deleted.select(F.col(id_col).cast(self.id_type).alias("id"))) if x is not None]
        while True:
            number, s = self.state()
            gone = self._deletion(s, self._union(ids, f"id {self.id_type}")) if ids and s["segments"] else None
            if gone:
                s["deletions"].append(gone)
            if new and new["texts"]:
                s["segments"][str(s["next"])] = new
                s["next"] += 1
            s["note"] = s["note"] if note is None else note
            if self.versions.put(number + 1, s):
                break
        self.merge()

    def merge(self) -> None:
        """Segments of a tier (a power of the fan-out) become one once there are enough; their deleted texts go with them."""
        while True:
            number, s = self.state()
            tiers: dict[int, list[str]] = {}
            for n, x in s["segments"].items():
                tiers.setdefault(int(math.log(max(1, x["texts"]), self.fanout) + 1e-9), []).append(n)
            full = next((t for _, t in sorted(tiers.items()) if len(t) >= self.fanout), None)
            if full is None:
                return
            new = self._segment(self._texts(s, full).drop("seg"))
            for n in full:
                del s["segments"][n]
            if new["texts"]:
                s["segments"][str(s["next"])] = new
                s["next"] += 1
            s["deletions"] = [d for d in s["deletions"] if any(n in s["segments"] for n in d["gone"])]
            self.versions.put(number + 1, s)  # who comes too late looks again

    # Reading

    def search(self, terms: Sequence[str], k: int = 10, among: DataFrame | None = None) -> DataFrame:
        """id, bm25: the k best texts for an OR of terms, of those `among` (id) if given; statistics are the whole index's."""
        terms = [t.lower() for t in dict.fromkeys(terms)]
        schema = f"id {self.id_type}, bm25 double"
        s = self.state()[1]
        texts, words = self.size()
        if not terms or not texts:
            return self.spark.createDataFrame([], schema)
        block = self._block_schema()
        hit = self._union([self._read(f"{x['path']}/blocks", block).where(F.col("term").isin(terms)).withColumn("seg", F.lit(int(n))) for n, x in s["segments"].items()], block + ", seg int")
        counts = hit.select("term", "n")
        paths = [f"{d['path']}/terms" for d in s["deletions"] if any(n in s["segments"] for n in d["gone"])]
        if paths:
            less = self.spark.read.schema("seg int, term string, n long").parquet(*paths).where(F.col("term").isin(terms) & F.col("seg").isin([int(n) for n in s["segments"]]))
            counts = counts.unionByName(less.select("term", (-F.col("n")).alias("n")))
        # as many rows as terms
        df = {r["term"]: r["n"] for r in counts.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        if not df:
            return self.spark.createDataFrame([], schema)
        idf = {t: max(math.log((texts - n + 0.5) / (n + 0.5)), 1e-6) if texts - n + 0.5 > 0 else 1e-6 for t, n in df.items()}
        weight = F.element_at(F.create_map(*[F.lit(x) for t, v in idf.items() for x in (t, v)]), F.col("term"))
        mean = max(words, 1) / texts
        part = lambda tf, dl: weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
        dead = self._dead(s)

        def scored(blocks: DataFrame) -> DataFrame:
            one = blocks.select("seg", "term", F.explode("rows").alias("r")).select("seg", "r.id", part(F.col("r.tf"), F.col("r.dl")).alias("part"))
            one = one if dead is None else one.join(dead, ["id", "seg"], "left_anti")
            one = one if among is None else one.join(among.select(F.col("id").cast(self.id_type).alias("id")), "id", "left_semi")
            return one.groupBy("id").agg(F.round(F.sum("part"), 6).alias("bm25")).orderBy(F.desc("bm25"), "id").limit(k)

        if sum(df.values()) <= SMALL:
            return scored(hit)
        bounds = hit.groupBy("seg", "block").agg(F.sum(part(F.col("most"), F.col("shortest"))).alias("bound"))
        best = [(r["seg"], r["block"]) for r in bounds.orderBy(F.desc("bound"), "seg", "block").limit(FIRST).collect()]
        first = [r["bm25"] for r in scored(hit.where(self._in(best))).collect()]
        if len(first) < k:
            return scored(hit)
        able = bounds.where(F.col("bound") >= first[-1] - 1e-6).select("seg", "block")
        return scored(hit.join(able, ["seg", "block"], "left_semi"))

    @staticmethod
    def _in(blocks: list[tuple[int, int]]) -> Column:
        return F.struct("seg", "block").isin([F.struct(F.lit(a), F.lit(b)) for a, b in blocks])
