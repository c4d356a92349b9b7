"""Pieces that the operators share: shared-folder tables, Arrow batches as byte arrays, vectorised hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from hippospark.functions.storage import forget, saved, shared_dir, tidy

__all__ = ["forget", "saved", "shared_dir", "tidy"]

WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True


def slices(batch: pa.RecordBatch, col: str, limit: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into pieces of about `limit` text bytes: (piece, bytes of all its texts, offsets). A null text is empty."""
    text = batch.column(col)
    if text.null_count:
        text = pc.fill_null(text, "" if pa.types.is_string(text.type) or pa.types.is_large_string(text.type) else b"")
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    bufs = text.buffers()
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        to = min(to, len(text))
        yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of stretches of bytes: blocks of 8 bytes are mixed in one after the other, and long stretches go through XXH3."""
    size = (ends - starts).astype(np.uint64)
    out = mix(size + np.uint64(0x9E3779B97F4A7C15 + seed))
    blocks = np.ndarray(len(data), np.uint64, np.concatenate((data, np.zeros(8, np.uint8))).data, strides=(1,)) if len(data) else np.zeros(0, np.uint64)
    some, at, left = np.flatnonzero((size > 0) & (size <= 64)), starts, size
    while len(some):
        n = left[some]
        block = blocks[at[some]]
        short = n < 8
        block[short] &= (np.uint64(1) << (n[short] * np.uint64(8))) - np.uint64(1)
        out[some] = mix(out[some] ^ block) + np.uint64(0x94D049BB133111EB)
        some = some[n > 8]
        if len(some):
            at, left = (at + 8, left - np.uint64(8))
    long = np.flatnonzero(size > 64)
    if len(long):
        body = data.tobytes()
        out[long] = [xxhash.xxh3_64_intdigest(body[x:y], seed) for x, y in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return out


class Rolling:
    """Polynomial hashes modulo 2**64 of short stretches of a sequence of 64-bit units, from one prefix sum.

    Only for windows, runs of them and shingles: over some thousand units there are different sequences that every such
    polynomial takes for equal. Bytes of any length go through `byte_hashes`.
    """

    def __init__(self, base: int, seed: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            up, down = np.full(size, self.base), np.full(size, self.inverse)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def prefix(self, units: np.ndarray) -> np.ndarray:
        """units: bytes (uint8) or 64-bit hashes."""
        units = self.table[units] if units.dtype == np.uint8 else units
        self.powers(len(units) + 1)
        out = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * self.up[: len(units)], out=out[1:])
        return out

    def span(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of units[start:end], equal for equal sequences wherever they stand."""
        return mix((prefix[end] - prefix[start]) * self.down[start])


ONE, TWO = Rolling(0x2545F4914F6CDD1D, 1), Rolling(0x9E6C63D0876A9A47, 2)


def words(data: np.ndarray, off: np.ndarray, between: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes other than those between words) and each document's first word."""
    black = ~between[data]
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[off] = True
    start = black.copy()
    start[1:] &= ~black[:-1] | first[1:n]
    end = black.copy()
    end[:-1] &= ~black[1:] | first[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return byte_hashes(data, starts, ends)


def runs(units: np.ndarray, off: np.ndarray, window: int, k: int, content: bool = True) -> dict[str, np.ndarray]:
    """Cut all windows of `window` units into runs that share an anchor, the k-gram of least hash in the window.

    Equal windows have equal anchors at equal places, wherever they stand, so windows need only be compared
    under one anchor hash. Returns per run: doc (index), start (first window's first unit, within all units),
    n (windows), a (anchor hash) and, if content is set, c1 and c2 (two independent hashes of all units that the
    run's windows cover).
    """
    n = np.maximum(0, np.diff(off) - window + 1)
    empty = np.zeros(0, np.int64)
    if not n.sum():
        return {"doc": empty, "start": empty, "n": empty, "a": empty.astype(np.uint64), "c1": empty.astype(np.uint64), "c2": empty.astype(np.uint64)}
    pre = ONE.prefix(units)
    total, w = len(units), window - k + 1
    at = np.arange(total - k + 1)
    grams = mix((pre[k:] - pre[:-k]) * ONE.down[: total - k + 1])
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    size = 1
    while size * 2 <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < w:
        least = np.minimum(least[: len(least) - (w - size)], least[w - size :])
    doc = np.repeat(np.arange(len(n)), n)
    begin = np.arange(len(doc)) + np.repeat(off[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    anchor = (least[begin] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.concatenate(([0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, [len(anchor)]))
    head, count = cut[:-1], np.diff(cut)
    start = begin[head]
    stop = start + count - 1 + window
    out = {"doc": doc[head], "start": start, "n": count, "a": grams[anchor[head]]}
    return out | ({"c1": ONE.span(pre, start, stop), "c2": TWO.span(TWO.prefix(units), start, stop)} if content else {})


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Concatenated start, start + 1, ... of n numbers each."""
    return np.arange(int(n.sum())) + np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n)


def packed(data: bytes) -> bytes:
    return pa.Codec("zstd", 1).compress(data, asbytes=True)


def unpacked(data: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(data, size, asbytes=True)
