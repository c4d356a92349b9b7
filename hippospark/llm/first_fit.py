"""First-fit decreasing packing of documents into token sequences, in randomised groups of documents.

A document longer than the capacity is cut into full pieces and a remainder. Pieces are dealt at random into groups of about
`GROUP_TOKENS` tokens that are not full already. Each group is packed by itself in one task: pieces in decreasing length go
to the first sequence with room, which a tournament tree of the sequences' room finds in logarithmic time. What first fit
leaves open is then levelled, since pieces may be cut anywhere: the emptiest sequences are dissolved, the longest of their
pieces fill the room of the others, and what is left over, less than one sequence, is laid out in powers of two. So no
sequence needs padding, and only the few dissolved pieces are cut.

Pieces are written once before they are dealt out, so a group holds the same pieces however often a task is repeated.

Defined results: a null text is empty and yields its end token; repeated rows are packed each, and dealt out each by
itself; a null doc_id is carried through; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .tokens import Encoder, vocabulary

CAPACITY, END, SEED = 2_048, 1, 90_217
#: Tokens in pieces that are not full, and pieces of any kind, of a group.
GROUP_TOKENS, GROUP_PIECES = 1 << 20, 1 << 13

PIECE = "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, pick long, ids binary"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pieces(docs: DataFrame, path: str, capacity: int, end: int, seed: int, with_ids: bool = False) -> DataFrame:
    """Encode whole texts, add the end token, cut what is longer than the capacity (PIECE). Full pieces need their ids no more, but for with_ids."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, done = Encoder.of(path), 0
        part = C.mix(np.array([TaskContext.get().partitionId() + seed * 1_000_003], np.uint64))
        for batch in batches:
            for rows, data, off in C.slices(batch, "text", 1 << 20):
                ids, at = coder.encode(data, off)
                total = np.diff(at) + 1
                ids = np.insert(ids, at[1:], end)
                first = at[:-1] + np.arange(len(total))
                count = -(-total // capacity)
                doc = np.repeat(np.arange(len(total)), count)
                start = C.ranges(np.zeros(len(count), np.int64), count) * capacity
                length = np.minimum(capacity, total[doc] - start)
                low = first[doc] + start
                pick = C.mix(part + (done + np.arange(len(doc))).astype(np.uint64))
                done += len(doc)
                chunks = [ids[x : x + n] for x, n in zip(low.tolist(), length.tolist(), strict=True)]
                kind = "<u2" if coder.highest < 1 << 16 else "<u4"
                body = [x.astype(kind).tobytes() if with_ids or len(x) < capacity else None for x in chunks]
                columns = [rows.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(total[doc]), pa.array([checksum(x) for x in chunks], pa.int64()), C.signed(pick), pa.array(body, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PIECE.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each, PIECE)


class Tournament:
    """Room of open sequences under a tree of maxima: the first with enough room is found from the top."""

    def __init__(self, sequences: int, capacity: int):
        self.size = 1 << max(0, sequences - 1).bit_length()
        self.room = [capacity] * (2 * self.size)

    def place(self, length: int) -> int:
        room, i = self.room, 1
        while i < self.size:
            i *= 2
            i += room[i] < length
        found = i - self.size
        room[i] -= length
        while i > 1:
            i //= 2
            most = max(room[2 * i], room[2 * i + 1])
            if room[i] == most:
                break
            room[i] = most
        return found


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """The sequence of each piece; lengths descend. Two sequences in turn hold more than one's capacity, which bounds their number."""
    tree = Tournament(2 * sum(lengths) // capacity + 1, capacity)
    return [tree.place(x) for x in lengths]


def levelled(fill: list[int], capacity: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Sequences to dissolve, and the room that their tokens go to: (sequence, tokens), new sequences from len(fill) on.

    Full sequences and those of a power of two stay. Of the others the emptiest go, as few as fill the room of the rest.
    """
    unfilled = sorted((n, i) for i, n in enumerate(fill) if n != capacity and n & (n - 1))
    room = sum(capacity - n for n, _ in unfilled)
    tokens, gone = 0, 0
    while gone < len(unfilled) and tokens < room:
        n = unfilled[gone][0]
        tokens, room, gone = tokens + n, room - (capacity - n), gone + 1
    targets = [(i, capacity - n) for n, i in unfilled[gone:]]
    rest, new = tokens - room, len(fill)
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            targets.append((new, 1 << bit))
            new += 1
    return [i for _, i in unfilled[:gone]], targets


def plan(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Where pieces of descending lengths go: (piece, tokens of it before, tokens, sequence, offset there)."""
    place = first_fit_decreasing(lengths, capacity)
    fill = [0] * (max(place, default=-1) + 1)
    for length, to in zip(lengths, place, strict=True):
        fill[to] += length
    dissolved, targets = levelled(fill, capacity)
    dissolved, free = set(dissolved), iter(targets)
    used, out, cut = [0] * (len(fill) + len(targets)), [], []
    for i, (length, to) in enumerate(zip(lengths, place, strict=True)):
        if to in dissolved:
            cut.append(i)
            continue
        out.append((i, 0, length, to, used[to]))
        used[to] += length
    room = 0
    for i in cut:
        before = 0
        while before < lengths[i]:
            if not room:
                to, room = next(free)
            n = min(room, lengths[i] - before)
            out.append((i, before, n, to, used[to]))
            used[to] += n
            before, room = before + n, room - n
    return out


def pack_group(table: pa.Table, capacity: int, groups: int, with_ids: bool) -> pa.Table:
    order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("pick", "ascending")]
    table = table.sort_by(order)
    group, length, start, crc, body = table.column("group")[0].as_py(), *(table.column(c).to_pylist() for c in ("length", "start", "ids_crc32", "ids"))
    placed = plan(length, capacity)
    row = pa.array([x[0] for x in placed], pa.int64())
    ids, sums = [], []
    for i, before, n, *_ in placed:
        own = None
        if n < length[i] or with_ids:
            own = np.frombuffer(body[i], f"<u{len(body[i]) // length[i]}")[before : before + n]
        sums.append(crc[i] if n == length[i] else checksum(own))
        ids.append(own.astype("<u4").tobytes() if with_ids else None)
    # sequences that were dissolved leave gaps in the numbers
    out = {
        "doc_id": table.column("doc_id").take(row), "start": pa.array([start[x[0]] + x[1] for x in placed], pa.int64()), "length": pa.array([x[2] for x in placed], pa.int64()), "ids_crc32": pa.array(sums, pa.int64()),
        "doc_tokens": table.column("doc_tokens").take(row), "sequence_id": pa.array([x[3] * groups + group for x in placed], pa.int64()), "offset": pa.array([x[4] for x in placed], pa.int64()),
    }
    return pa.table(out | ({"ids": pa.array(ids, pa.binary())} if with_ids else {}))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, seed: int = SEED, with_ids: bool = False, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Pieces with sequence_id and offset (PLACED), and their ids (little-endian, 32 bits) if asked for."""
    table = C.saved(pieces(docs, path or vocabulary(), capacity, end, seed, with_ids), "op12-pieces")
    open_tokens, n = table.agg(F.sum(F.when(F.col("length") < capacity, F.col("length"))), F.count("*")).first()
    groups = max(1, -(-(open_tokens or 0) // group_tokens), -(-n // GROUP_PIECES))
    dealt = table.withColumn("group", F.pmod("pick", F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(lambda x: pack_group(x, capacity, groups, with_ids), PLACED + ", ids binary" * with_ids)


def sequences(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Whole sequences of pieces that carry their ids: sequence_id, n_tokens and ids, padded with zero bytes to the capacity except at a power of two."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))), lambda x: F.hex(x["ids"]))
    out = placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.unhex(F.array_join(parts, "")).alias("ids"))
    n = F.col("n_tokens")
    return out.withColumn("ids", F.when(n.bitwiseAND(n - 1) == 0, F.col("ids")).otherwise(F.rpad("ids", 4 * capacity, F.lit(b"\0"))))


def op12_first_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
