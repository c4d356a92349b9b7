"""Token ids of whole texts by a public byte-level BPE, and the exact histogram of encoded lengths.

The ids are those of tokenizers' `Tokenizer.from_file(path("byte_bpe_50k.json"))`; tiktoken, which has the same
vocabulary as ranks and is several times as fast, computes them (the tests hold both together). A text is cut where the
tokenizer's pattern never joins two sides: before a single space, around a lone line feed, before a final ASCII mark.
The ids of each distinct stretch are computed once per worker, kept in a bounded table, and strung together by array
look-ups. A text with white space before a space goes through the tokenizer as a whole. As the tokenizer has it by default,
the string of its special token is that token wherever it stands in a text; `Encoder(..., special=None)` takes it for
ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

MARK = np.zeros(256, bool)
MARK[list(b".,;:!?")] = True
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
#: First bytes of white space beyond ASCII in UTF-8.
WIDE = np.zeros(256, bool)
WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


#: The special token of byte_bpe_50k.json.
SPECIAL = ("<|endoftext|>", 50_256)


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of documents as arrays; a table of stretches, emptied when it has `entries`.

    The table is two sorted arrays (some 50 bytes a stretch with its ids), and a small dictionary of the latest ones that
    is merged into them now and then.
    """

    LATEST = 50_000

    kept: dict[str, "Encoder"] = {}

    def __init__(self, path: str, entries: int = 1_000_000, special: tuple[str, int] | None = SPECIAL):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict([special] if special else []))
        self.plain, self.with_special, self.mark = coding.encode_ordinary, lambda t: coding.encode(t, allowed_special="all"), special and special[0]
        self.entries, self.highest = entries, coding.max_token_value
        self.clear()

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """One encoder per worker process."""
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def clear(self) -> None:
        self.keys, self.places, self.latest, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int32), {}, 0
        self.start, self.length, self.pool, self.filled = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32), 0

    def find(self, unit: np.ndarray) -> np.ndarray:
        """Places of sorted hashes, -1 where a stretch is not known."""
        place = np.full(len(unit), -1, np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, unit), len(self.keys) - 1)
            hit = self.keys[at] == unit
            place[hit] = self.places[at[hit]]
        left = np.flatnonzero(place < 0)
        place[left] = [self.latest.get(h, -1) for h in unit[left].tolist()]
        return place

    def ids_of(self, text: str) -> list[int]:
        return self.with_special(text) if self.mark and self.mark in text else self.plain(text)

    def learn(self, hashes: list[int], texts: list[str]) -> None:
        ids = list(map(self.ids_of, texts))
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        at, total = self.count, int(size.sum())
        while at + len(ids) > len(self.start):
            self.start, self.length = (np.concatenate((x, np.zeros(len(x), x.dtype))) for x in (self.start, self.length))
        while self.filled + total > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(len(self.pool), np.uint32)))
        self.length[at : at + len(ids)] = size
        self.start[at : at + len(ids)] = self.filled + np.cumsum(size) - size
        self.pool[self.filled : self.filled + total] = np.fromiter((x for y in ids for x in y), np.uint32, total)
        self.filled += total
        self.latest.update(zip(hashes, range(at, at + len(ids)), strict=True))
        self.count += len(ids)
        if len(self.latest) > self.LATEST:
            keys = np.concatenate((self.keys, np.fromiter(self.latest, np.uint64, len(self.latest))))
            places = np.concatenate((self.places, np.fromiter(self.latest.values(), np.int32, len(self.latest))))
            order = np.argsort(keys, kind="stable")
            self.keys, self.places, self.latest = keys[order], places[order], {}

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents in turn, and each document's first."""
        size = len(data)
        if self.count > self.entries:
            self.clear()
        around = np.concatenate(([0, 0, 0], data, [0, 0, 0])).astype(np.uint8)
        white = C.WHITE[around]
        # a character that may be white space ends here
        wide = (WIDE[around[1:-1]] & (around[2:] >= 128)) | (WIDE[around[:-2]] & (around[1:-1] >= 128) & (around[2:] >= 128))
        ends_white = white[2 : size + 2] | wide[: size + 0] & ((around[2 : size + 2] == 0xA0) | (around[2 : size + 2] == 0x85) | (around[1 : size + 1] >= 0x80) & (around[:size] > 0xE0))
        first = np.zeros(size + 1, bool)
        first[off] = True
        after_white = ends_white & ~first[:size]
        space = data == 32
        risky = np.zeros(len(off) - 1, bool)
        bad = np.flatnonzero(space & after_white)
        risky[np.searchsorted(off, bad, "right") - 1] = True
        begin = first[:size] | space
        line = (data == 10) & ~after_white & ~first[:size] & ~first[1:] & ~white[4 : size + 4] & ~WIDE[around[4 : size + 4]]
        begin |= line
        begin[1:] |= line[:-1]
        over = first[1:] | white[4 : size + 4] & ((around[4 : size + 4] == 32) | (around[4 : size + 4] == 10))
        begin |= MARK[data] & ALNUM[around[2 : size + 2]] & ~first[:size] & over
        starts = np.flatnonzero(begin)
        ends = np.concatenate((starts[1:], [size]))
        if risky.any():
            keep = ~risky[np.searchsorted(off, starts, "right") - 1]
            starts, ends = starts[keep], ends[keep]
        whole = np.flatnonzero(risky)
        starts, ends = np.concatenate((starts, off[whole])), np.concatenate((ends, off[whole + 1]))
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
        unit, one, back = np.unique(C.byte_hashes(data, starts, ends), return_index=True, return_inverse=True)
        place = self.find(unit)
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            body = data.tobytes()
            cut = zip(starts[one[fresh]].tolist(), ends[one[fresh]].tolist(), strict=True)
            place[fresh] = self.count + np.arange(len(fresh))
            self.learn(unit[fresh].tolist(), [body[x:y].decode("utf-8", "replace") for x, y in cut])
        at = place[back]
        n = self.length[at].astype(np.int64)
        total = np.concatenate(([0], np.cumsum(n)))
        return self.pool[C.ranges(self.start[at], n)], total[np.searchsorted(starts, off)]


def length_histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Exact token-length histogram: one row per encoded length.

    length, n_docs; n_tokens (of documents that long); docs_ge, tokens_ge (suffix sums); n_total (tokens of all); n_truncated
    (all tokens that remain when documents are cut at this length); docs_le and quantile (share of documents up to it).
    Totals and truncated totals for a limit between two lengths follow from the next longer row: see `truncated_total`.
    Defined results: null and empty texts have length 0; repeated rows count each; an empty table gives no rows; doc_id
    and extra columns are ignored.
    """
    path = path or vocabulary()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder.of(path)
        for batch in batches:
            n = [np.zeros(0, np.int64)]
            for _, data, off in C.slices(batch, "text", 1 << 20):
                n.append(np.diff(coder.encode(data, off)[1]))
            length, count = np.unique(np.concatenate(n), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(count.astype(np.int64))], ["length", "n"])

    bars = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(each, "length long, n long").groupBy("length").agg(F.sum("n").alias("n_docs"))
    # as many rows as there are distinct lengths, however many documents
    up, down = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    bars = bars.withColumn("n_tokens", F.col("length") * F.col("n_docs"))
    bars = bars.withColumns({"docs_ge": F.sum("n_docs").over(down), "tokens_ge": F.sum("n_tokens").over(down), "docs_le": F.sum("n_docs").over(up), "tokens_le": F.sum("n_tokens").over(up)})
    total = F.col("tokens_le") + F.col("tokens_ge") - F.col("n_tokens")
    docs_all = F.col("docs_le") + F.col("docs_ge") - F.col("n_docs")
    return bars.select(
        "length", "n_docs", "n_tokens", "docs_ge", "tokens_ge", total.alias("n_total"),
        (total - F.col("tokens_ge") + F.col("length") * F.col("docs_ge")).alias("n_truncated"), "docs_le", (F.col("docs_le") / docs_all).alias("quantile"),
    )


def truncated_total(bars: DataFrame, limit: int) -> int:
    """Tokens that remain when every document is cut at limit, from the histogram's suffix sums."""
    row = bars.where(F.col("length") >= limit).orderBy("length").first()
    if row is None:
        last = bars.first()
        return last["n_total"] if last else 0
    return row["n_total"] - row["tokens_ge"] + limit * row["docs_ge"]


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    return length_histogram(spark.read.parquet(f"{sf_dir}/documents.parquet"))
