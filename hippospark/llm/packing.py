"""Best-fit packing of documents into token sequences, by bin completion on the histogram of piece lengths.

Only counts per length (as many as the capacity at most) reach the driver. There bin completion searches over all bins
(`complete_bins`): the incumbent is best fit, fillings around the largest length left that no other dominates are the
branches, and bounds on waste and on the bins of what is left prune them. A filling is used as often as the counts allow
at first, which uses a length up, so the table of patterns is bounded by the capacity and not by the data. Every piece
then finds its sequence and offset from its rank within its length. The result carries the number of sequences and the
bound below it that was proved.

Defined results: a null text is empty and yields its end token; repeated rows are packed each; an empty table gives no
rows; a null doc_id is carried through; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .tokens import Encoder, vocabulary

CAPACITY, END = 1024, 2
#: Fillings of any kind that the search looks at; its first descent always ends. Within them it is exact; past them the
#: best so far stands and the bound that is returned with it shows what is not proved.
NODES = 10_000
#: Stretches of the ranks of a length.
CUTS = 16


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Encode whole texts, add the end token and cut what is longer than the capacity; the first piece takes the remainder."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = Encoder.of(path), np.array([END], "<u4").tobytes()
        for batch in batches:
            for rows, data, off in C.slices(batch, "text", 1 << 20):
                ids, at = coder.encode(data, off)
                body, total = ids.astype("<u4").tobytes(), np.diff(at) + 1
                count = -(-total // capacity)
                head = total - (count - 1) * capacity
                doc = np.repeat(np.arange(len(total)), count)
                piece = C.ranges(np.zeros(len(count), np.int64), count)
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                low, last = at[doc] + start, piece == count[doc] - 1
                chunks = [body[4 * x : 4 * (x + n - e)] + (end if e else b"") for x, n, e in zip(low.tolist(), length.tolist(), last.tolist(), strict=True)]
                out = [rows.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([zlib.crc32(x) for x in chunks], pa.int64())]
                yield pa.RecordBatch.from_arrays(out + [pa.array(chunks, pa.binary())] * with_ids, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each, schema)


Pattern = tuple[int, tuple[int, ...]]


def least_bins(left: np.ndarray, capacity: int) -> int:
    """A lower bound of the bins that these counts (by length) need: for each threshold t, what is longer than capacity - t is
    alone with what is shorter than t, and what is longer than half shares no bin."""
    if not left.any():
        return 0
    sizes = np.arange(capacity + 1)
    number, volume = np.cumsum(left), np.cumsum(left * sizes)
    half, best = capacity // 2, -(-int(volume[-1]) // capacity)
    t = np.arange(1, half + 1)
    longest = number[-1] - number[capacity - t]  # longer than capacity - t
    middle = number[capacity - t] - number[half]  # over half, up to capacity - t
    free = middle * capacity - (volume[capacity - t] - volume[half])
    rest = volume[half] - volume[t - 1]  # from t to half
    bound = longest + middle + np.maximum(0, -(-(rest - free) // capacity))
    return max(best, int(bound.max(initial=0)), int(number[-1] - number[half]))


def reachable(room: int, sizes: list[int], left: np.ndarray) -> list[int]:
    """Sums that the sizes from each on can still reach, as bits."""
    reach, mask = [1], (1 << room + 1) - 1
    for x in reversed(sizes):
        sums, n, k = reach[-1], min(room // x, int(left[x])), 1
        while n:
            k = min(k, n)
            sums |= sums << x * k & mask
            n, k = n - k, 2 * k
        reach.append(sums)
    return reach[::-1]


def bits(x: int, n: int) -> np.ndarray:
    """The lowest n bits of a number."""
    return np.unpackbits(np.frombuffer((x & (1 << n) - 1).to_bytes(-(-n // 8), "little"), np.uint8), count=n, bitorder="little").astype(bool)


def dominated(fill: list[int], spare: int, left: np.ndarray) -> bool:
    """Whether pieces of a filling could make room for one that is left out and larger, or equal to several of them, within
    the spare room: what they would leave can then do no worse."""
    sums, several, n = 1, 0, len(left)
    for x in fill:
        several |= (several | sums & ~1) << x
        sums |= sums << x
    free = left.copy()
    sizes, times = np.unique(np.array(fill, np.int64), return_counts=True)
    free[sizes] -= times
    free = free > 0
    upto = np.concatenate(([0], np.cumsum(free)))
    at = np.flatnonzero(bits(sums, n))
    return bool((upto[np.minimum(at + spare, n - 1) + 1] > upto[at + 1]).any() or (bits(several, n) & free).any())


def fillings(need: int, sizes: list[int], left: np.ndarray, reach: list[int]) -> Iterator[list[int]]:
    """Multisets of sizes that sum to need exactly, large pieces first; reach leads to no dead end."""
    # open choices: place in sizes, what is still needed there, and the copies taken
    open_: list[list[int]] = []
    i = 0
    while True:
        while need:
            while not reach[i + 1] >> need & 1 and not (sizes[i] <= need and left[sizes[i]]):
                i += 1
            x = sizes[i]
            k = min(need // x, int(left[x]))
            while not (need >= k * x and reach[i + 1] >> need - k * x & 1):
                k -= 1
            open_.append([i, need, k])
            need -= k * x
            i += 1
        yield [y for at, _, k in open_ for y in [sizes[at]] * k]
        while open_:
            i, need, k = open_.pop()
            x = sizes[i]
            k -= 1
            while k >= 0 and not reach[i + 1] >> need - k * x & 1:
                k -= 1
            if k >= 0:
                open_.append([i, need, k])
                need -= k * x
                i += 1
                break
        else:
            return


def completions(room: int, left: np.ndarray, most: int) -> Iterator[tuple[int, list[int]]]:
    """Fillings of `room` from what `left` has, least waste first, up to a waste of `most`: (waste, lengths)."""
    sizes = np.flatnonzero(left[: room + 1])[::-1].tolist()
    reach = reachable(room, sizes, left)
    for waste in range(0, min(room, most) + 1):
        if reach[0] >> room - waste & 1:
            for fill in fillings(room - waste, sizes, left, reach):
                yield waste, fill


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing on counts: the first incumbent."""
    left, room, out = counts.copy(), {}, []
    for x in np.flatnonzero(left)[::-1].tolist():
        n = int(left[x])
        for r in sorted(r for r in room if r >= x):
            while n and room.get(r):
                fills = room[r]
                copies, fill = fills.pop()
                times = r // x
                take = min(copies, n // times)
                if take:
                    if copies > take:
                        fills.append((copies - take, fill))
                    room.setdefault(r - times * x, []).append((take, (*fill, *[x] * times)))
                    n -= take * times
                    continue
                if copies > 1:
                    fills.append((copies - 1, fill))
                room.setdefault(r - n * x, []).append((1, (*fill, *[x] * n)))
                n = 0
        times = capacity // x
        if n // times:
            room.setdefault(capacity - times * x, []).append((n // times, (x,) * times))
        if n % times:
            room.setdefault(capacity - n % times * x, []).append((1, (x,) * (n % times)))
    for fills in room.values():
        out += fills
    return out


class Plan(NamedTuple):
    """Patterns that use up all counts; their number of bins; the bound below it; fillings that the search tried."""

    patterns: list[Pattern]
    bins: int
    bound: int
    nodes: int


def complete_bins(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> Plan:
    """Bin completion by branch and bound.

    A node completes the largest length left by an undominated filling, as often as the counts allow at first and less
    often on later branches. A branch ends where its waste, or its bins and the bound of what is left, can no longer
    beat the incumbent, which is best fit at first. The search is exact when it ends by itself. It looks at `nodes`
    fillings, dominated ones included; then the first descent ends with any fillings of least waste, at most one for each
    length, and the incumbent stands. `bound` says how far it may be from the least.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    total, bound = int((left * np.arange(capacity + 1)).sum()), least_bins(left, capacity)
    best = best_fit(left, capacity)
    fewest, tried, descended = sum(n for n, _ in best), 0, False
    path: list[Pattern] = []
    # open choices, deepest last: (counts left, largest length, fillings to try, filling in use, copies to try, used, waste, counts to fill from)
    stack: list[list] = []

    def choices(used: int, waste: int) -> list | None:
        """The open node of what is left, if it can still lead to fewer bins."""
        if used + least_bins(left, capacity) >= fewest:
            return None
        top = int(np.flatnonzero(left)[-1])
        after = left.copy()
        after[top] -= 1
        return [left.copy(), top, completions(capacity - top, after, (fewest - 1) * capacity - total - waste), None, 0, used, waste, after]

    if fewest > bound and (node := choices(0, 0)):
        stack.append(node)
    while stack and fewest > bound and (tried < nodes or not descended):
        node = stack[-1]
        before, top, fills, _, copies, used, waste, _ = node
        del path[len(stack) - 1 :]
        left[:] = before
        if not copies:
            following = next(fills, None)
            while following and tried < nodes and dominated(following[1], following[0], node[7]):
                tried, following = tried + 1, next(fills, None)
            if following is None:
                descended = True
                stack.pop()
                continue
            fill = (top, *following[1])
            sizes, times = np.unique(fill, return_counts=True)
            copies = int((left[sizes] // times).min())
            node[3] = following[0], fill, sizes, times
        spare, fill, sizes, times = node[3]
        node[4] = copies - 1
        tried += 1
        if waste + copies * spare > (fewest - 1) * capacity - total:
            continue
        left[sizes] -= copies * times
        path.append((copies, fill))
        if not left.any():
            descended = True
            if used + copies < fewest:
                best, fewest = list(path), used + copies
            continue
        if node := choices(used + copies, waste + copies * spare):
            stack.append(node)
        else:
            descended = True
    return Plan(best, fewest, fewest if not stack else bound, tried)


def slots(found: list[Pattern], counts: dict[int, int], cuts: int = CUTS) -> list[tuple[int, int, int, int, int, int, int]]:
    """Per pattern and length: length, stretch, ranks from and to, first sequence, pieces of that length in a copy, their offset.

    A length's ranks are cut into `cuts` equal stretches and a row is repeated for each that it reaches into, so that a
    piece meets the few rows of its own stretch.
    """
    used: dict[int, int] = {}
    out, sequence = [], 0
    for copies, fill in found:
        offset = 0
        for x in sorted(set(fill), reverse=True):
            times = fill.count(x)
            low = used.get(x, 0)
            used[x] = high = low + copies * times
            out += [(x, cut, low, high, sequence, times, offset) for cut in range(low * cuts // counts[x], (high - 1) * cuts // counts[x] + 1)]
            offset += times * x
        sequence += copies
    return out


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, bucket_rows: int = 50_000, nodes: int = NODES) -> DataFrame:
    """Pieces with sequence_id and offset, the number of sequences (n_sequences) and the bound below it that is proved (least_sequences)."""
    spark = docs.sparkSession
    table = C.saved(pieces(docs, path or vocabulary(), capacity, with_ids), "op7-pieces")
    counts = {r["length"]: r["count"] for r in table.groupBy("length").count().collect()}
    plan = complete_bins(counts, capacity, nodes)
    rows = slots(plan.patterns, counts)
    buckets = max(1, -(-max(counts.values(), default=1) // bucket_rows))
    table = table.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = table.groupBy("length", "bucket").count()
    upto = Window.partitionBy("length").orderBy("bucket")
    before = before.withColumns({"before": F.coalesce(F.sum("count").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("count").over(Window.partitionBy("length"))}).drop("count")
    ranked = table.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.withColumn("cut", F.floor(F.col("rank") * CUTS / F.col("total")).cast("long"))
    # as many rows as patterns and cuts, however large the data
    place = spark.createDataFrame(rows or [(0, 0, 0, 0, 0, 1, 0)], "length long, cut long, low long, high long, sequence long, times long, shift long")
    out = ranked.join(F.broadcast(place), ["length", "cut"]).where("rank >= low and rank < high")
    at = F.col("rank") - F.col("low")
    return out.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(at / F.col("times"))).cast("long").alias("sequence_id"), (F.col("shift") + at % F.col("times") * F.col("length")).cast("long").alias("offset"),
        F.lit(plan.bins).cast("long").alias("n_sequences"), F.lit(plan.bound).cast("long").alias("least_sequences"), *(["ids"] if with_ids else []),
    )


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
