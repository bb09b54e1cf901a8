"""Vectorised tokenisation of Arrow text batches: one flat byte array per chunk.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, which equals the
pattern ``[^\\x20\\x09-\\x0D]+`` on UTF-8 text. Hashes are 64-bit polynomial
hashes modulo 2**64 taken from one prefix sum, then mixed; the chance that two
of n different words meet is about n**2 / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n, grown on demand."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


@dataclass
class Spans:
    """Runs of bytes in a chunk: hash, document index and byte range of each."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray


@dataclass
class Chunk:
    """Some whole documents of a batch; ``first`` is the row of the first one."""

    first: int
    buf: np.ndarray
    offsets: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.buf[self.offsets[i] : self.offsets[i + 1]].tobytes()


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Whole documents (null: empty) in chunks of about ``limit`` bytes; a longer one is alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data = column.cast(pa.large_binary()).fill_null(b"")
    if len(data) == 0:
        return
    _, offset_buf, value_buf = data.buffers()
    offsets = np.frombuffer(offset_buf, np.int64, len(data) + 1, data.offset * 8)
    values = np.frombuffer(value_buf, np.uint8) if value_buf is not None and value_buf.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(data):
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), len(data))
        yield Chunk(at, values[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def spans(buf: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> Spans:
    """Maximal runs of bytes outside ``separator`` (a mask over ``buf``), never across documents."""
    n = len(buf)
    inside = ~separator
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    before = np.ones(n, bool)
    before[1:] = separator[:-1]
    start = np.flatnonzero(inside & (before | border[:-1]))
    after = np.ones(n, bool)
    after[:-1] = separator[1:]
    end = np.flatnonzero(inside & (after | border[1:])) + 1
    return Spans(span_hash(buf, start, end), np.searchsorted(offsets, start, "right") - 1, start, end)


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    power, inverse = _power_tables(len(buf) + 1)
    prefix = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * power[: len(buf)], out=prefix[1:], dtype=U64)
    h = (prefix[end] - prefix[start]) * inverse[start]
    return mix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def words(chunk: Chunk, lower: bool = False) -> Spans:
    buf = lower_ascii(chunk.buf) if lower else chunk.buf
    return spans(buf, chunk.offsets, _SPACE[buf])


def space_mask(buf: np.ndarray) -> np.ndarray:
    return _SPACE[buf]


def window_hash(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive entries, by its first entry."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    weight = U64(0xA0761D6478BD642F)
    for k in range(width):
        out = out * weight + h[k : k + n]
    return mix(out)
