"""Vectorised helpers over Arrow string columns: slices of bounded size, words, lines and their 64-bit hashes.

A batch is cut into slices of a few megabytes (a longer text makes a slice of its own), so that the working arrays of a
task stay small whatever the batch holds. Nothing here knows Spark; the operators call it from ``mapInArrow``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: A fixed 64-bit value per byte; equal in every task.
BYTE_CODE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64 - 1, 256, dtype=np.uint64, endpoint=True)
STEP = np.uint64(0x9E3779B97F4A7C15)


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one string array; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.string()).fill_null("")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the offsets of its values, starting at 0."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8, offsets[-1] - offsets[0], offsets[0]), offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches with at most ``limit`` bytes of text, or one row; and their texts, null as empty."""
    for batch in batches:
        texts = strings(batch.column(batch.schema.get_field_index(text)))
        if not len(texts):
            continue
        ends = raw(texts)[1]
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), texts.slice(at, to - at)
            at = to


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over the others."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans(NamedTuple):
    """Stretches of bytes: begin and end in the slice, and the text each lies in."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    text: np.ndarray
    offsets: np.ndarray

    def per_text(self) -> np.ndarray:
        return np.bincount(self.text, minlength=len(self.offsets) - 1)

    def bounds(self) -> np.ndarray:
        """Where the spans of each text begin, and the end."""
        return np.concatenate([[0], np.cumsum(self.per_text())])


def words(texts: pa.Array, lower: bool = False) -> Spans:
    """The matches of ``[^\\x20\\x09-\\x0D]+``; ``lower``: with A-Z lower-cased in ``data``."""
    data, offsets = raw(texts)
    if lower:
        data = LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~SPACE[data]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] |= inside[edge + 1]
    last[edge - 1] |= inside[edge]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Spans(data, begin, end, np.searchsorted(offsets, begin, "right") - 1, offsets)


def lines(texts: pa.Array) -> Spans:
    """Texts split at ``\\n``; a text has one line more than line feeds."""
    data, offsets = raw(texts)
    feeds = np.flatnonzero(data == 10)
    owner = np.concatenate([np.arange(len(texts)), np.searchsorted(offsets, feeds, "right") - 1])
    begin = np.concatenate([offsets[:-1], feeds + 1])
    end = np.concatenate([offsets[1:], feeds])
    by_begin, by_end = np.lexsort((begin, owner)), np.lexsort((end, owner))
    return Spans(data, begin[by_begin], end[by_end], owner[by_begin], offsets)


def hashes(spans: Spans) -> np.ndarray:
    """A 64-bit hash of each span's bytes: a polynomial over byte codes, finally mixed with the length."""
    size = spans.end - spans.begin
    out = np.zeros(len(size), np.uint64)
    some = np.flatnonzero(size)
    if not len(some):
        return mixed(out)
    n = size[some]
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    place = np.arange(n.sum()) - np.repeat(starts, n)
    powers = np.cumprod(np.full(int(n.max()), STEP, np.uint64))
    at = place + np.repeat(spans.begin[some], n)
    out[some] = np.add.reduceat(BYTE_CODE[spans.data[at]] * powers[place], starts)
    return mixed(out + size.astype(np.uint64) * STEP)


def code_points(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Code points of each stretch of UTF-8 bytes."""
    upto = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return upto[end] - upto[begin]


def windows(hashed: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k`` neighbouring values of one text, and the place of each window's first value."""
    if len(hashed) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(len(hashed) - k + 1, np.uint64)
    for i in range(k):
        total = total * STEP + hashed[i : len(hashed) - k + 1 + i]
    count = np.diff(bounds)
    whole = np.repeat(np.maximum(count - k + 1, 0) > 0, count)
    left = np.arange(len(hashed)) - np.repeat(bounds[:-1], count)
    fits = whole & (left <= np.repeat(count - k, count))
    first = np.flatnonzero(fits[: len(total)])
    return mixed(total[first]), first
