"""Byte-level helpers shared by the operators: lines, words and hashes of whole Arrow columns in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes handled at once inside a task; one longer text is handled alone.
SLICE_BYTES = 2 << 20

_SPACES = [0x20, *range(0x09, 0x0E)]
SPACE = np.zeros(256, bool)
SPACE[_SPACES] = True
#: Everything ASCII but digits and letters.
NON_ALNUM = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


class Texts(NamedTuple):
    """Bytes of the texts one after another and where each begins; null is empty."""

    data: np.ndarray
    starts: np.ndarray


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches between rows so that each slice has about `most` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes.astype(np.int64)) // most
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def texts(array: pa.Array) -> Texts:
    array = pc.fill_null(array.cast(pa.large_string()), "")
    starts = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    body = array.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return Texts(data[starts[0] : starts[-1]], starts - starts[0])


def words(source: Texts, separator: np.ndarray) -> Words:
    """Maximal runs of non-separator bytes inside each text."""
    data, starts = source
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, none)
    inside = ~separator[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    first = starts[:-1]
    before[first[first < len(data)]] = False
    begin = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    last = starts[1:] - 1
    after[last[last >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(begin, end, np.searchsorted(starts, begin, "right") - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        known = np.cumprod(steps, dtype=np.uint64)
        if len(known) <= 2 * SLICE_BYTES:
            _powers[base] = known
    return known[:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]: a polynomial from prefix sums, then mixed with the length."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=total[1:])
    value = (total[end] - total[start]) * _power(_INVERSE, len(data) + 1)[start]
    return mix(value ^ (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def grams(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words, and the index of each first word; windows never cross texts."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(count, np.uint64)
    for i in range(n):
        value = mix(value * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + count])
    at = np.flatnonzero(row[:count] == row[n - 1 :])
    return value[at], at


def row_counts(row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, minlength=n).astype(np.int64)


def row_edges(row: np.ndarray, n: int) -> np.ndarray:
    """Where each row's stretch begins in a sorted row column, with the end appended."""
    return np.searchsorted(row, np.arange(n + 1))


def checked_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns of any name cannot clash."""
    return docs.select(*(F.col(f"`{n}`") for n in names))
