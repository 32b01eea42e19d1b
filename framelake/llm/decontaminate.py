"""Benchmark decontamination: texts streamed through a generalised suffix automaton of the test items."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.llm.scratch import kept
from framelake.llm.text import LOWER, NON_ALNUM, grams, row_counts, row_edges, slices, span_hashes, text_or_empty, texts, words

#: Words of test items in one automaton; more items are met in several passes.
ITEM_WORDS = 200_000


class SuffixAutomaton:
    """All substrings of several word sequences; `item_ids` at the states that answer for a window."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.size, self.link, self.next = [0], [-1], [{}]
        for _, seq in items:
            last = 0
            for word in seq:
                last = self._extend(last, word)
        #: The state of the last `window` words, for each state that is at least as long.
        self.root_of = [self._shorten(s) for s in range(len(self.size))]
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for item, seq in items:
            state = 0
            for i, word in enumerate(seq):
                state = self.next[state][word]
                if i + 1 >= window:
                    self.items.setdefault(self.root_of[state], set()).add(item)
            if 0 < len(seq) < window:
                self.short.setdefault(state, []).append((len(seq), item))

    def _extend(self, last: int, word: int) -> int:
        if (known := self.next[last].get(word)) is not None:
            return known if self.size[known] == self.size[last] + 1 else self._clone(last, word, known)
        new = self._add(self.size[last] + 1, 0, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            known = self.next[at][word]
            self.link[new] = known if self.size[known] == self.size[at] + 1 else self._clone(at, word, known)
        return new

    def _clone(self, at: int, word: int, known: int) -> int:
        copy = self._add(self.size[at] + 1, self.link[known], dict(self.next[known]))
        self.link[known] = copy
        while at >= 0 and self.next[at].get(word) == known:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _add(self, size: int, link: int, steps: dict[int, int]) -> int:
        self.size.append(size)
        self.link.append(link)
        self.next.append(steps)
        return len(self.size) - 1

    def _shorten(self, state: int) -> int:
        while self.link[state] > 0 and self.size[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def stream(self, seq: list[int]) -> Iterator[tuple[int, int, str | None, int]]:
        """(end, length, item or None, state) of each window that ends at a word of `seq`; None: items[state]."""
        state = length = 0
        for i, word in enumerate(seq):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            step = self.next[state].get(word)
            if step is None:
                length = 0
                continue
            state, length = step, length + 1
            if length >= self.window:
                root = state
                while self.size[self.link[root]] >= self.window:
                    root = self.link[root]
                yield i + 1, self.window, None, root
            if self.short:
                at = state
                while at > 0:
                    for size, item in self.short.get(at, ()):
                        if size <= length:
                            yield i + 1, size, item, at
                    at = self.link[at]


class ItemIndex:
    """The automaton, and hashes by which whole stretches of a text are passed over without streaming.

    A window of two words or more lies in a run of word pairs that all occur in items, so only such runs that
    are long enough for some window are streamed; one-word items are looked up directly.
    """

    def __init__(self, ids: list[str], bodies: list[str | None], window: int):
        source = texts(pa.array(bodies, pa.large_string()))
        hashes, row = _hashed(source)
        self.words = np.unique(hashes)
        self.pairs = np.unique(grams(hashes, row, 2)[0])
        numbered = np.searchsorted(self.words, hashes)
        edge = row_edges(row, len(ids))
        items = [(ids[k], numbered[edge[k] : edge[k + 1]].tolist()) for k in range(len(ids)) if edge[k + 1] > edge[k]]
        self.automaton = SuffixAutomaton(items, window)
        sizes = [min(len(seq), window) for _, seq in items]
        self.single: dict[int, list[str]] = {}
        for item, seq in items:
            if len(seq) == 1 or window == 1:
                for w in set(seq):
                    self.single.setdefault(w, []).append(item)
        self.shortest = min((s for s in sizes if s > 1), default=0)

    def _known(self, values: np.ndarray, among: np.ndarray) -> np.ndarray:
        if not len(among) or not len(values):
            return np.zeros(len(values), bool)
        at = np.minimum(np.searchsorted(among, values), len(among) - 1)
        return among[at] == values

    def hits(self, hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, list[set[str]]]:
        """Which words lie in a window, and the items met in each text."""
        hit = np.zeros(len(hashes), bool)
        met: list[set[str]] = [set() for _ in range(n)]
        if not len(self.words) or not len(hashes):
            return hit, met
        known = self._known(hashes, self.words)
        number = np.searchsorted(self.words, hashes)
        if self.single:
            for i in np.flatnonzero(known & np.isin(number, list(self.single))).tolist():
                hit[i] = True
                met[row[i]].update(self.single[int(number[i])])
        if self.shortest:
            first = np.flatnonzero(known[:-1] & known[1:] & (row[:-1] == row[1:]))
            first = first[self._known(_pair(hashes, first), self.pairs)]
            breaks = np.flatnonzero(np.diff(first) != 1) + 1
            begins = np.concatenate([[0], breaks]) if len(first) else breaks
            ends = np.concatenate([breaks, [len(first)]]) if len(first) else breaks
            long = ends - begins >= self.shortest - 1
            for a, b in zip(first[begins[long]].tolist(), (first[ends[long] - 1] + 2).tolist()):
                for end, size, item, state in self.automaton.stream(number[a:b].tolist()):
                    if size > 1:
                        hit[a + end - size : a + end] = True
                        met[row[a]].update((item,) if item is not None else self.automaton.items[state])
        return hit, met


def _pair(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    two = np.stack([hashes[first], hashes[first + 1]], 1).reshape(-1)
    value, at = grams(two, np.repeat(np.arange(len(first)), 2), 2)
    return value


def _hashed(source) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[source.data]
    word = words(source, NON_ALNUM)
    return span_hashes(low, word.start, word.end), word.row


def _indexes(items: DataFrame, window: int, most: int) -> list[ItemIndex]:
    """One index for each share of the items with about `most` words at most; the driver sees a share at a time."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), text_or_empty().alias("text"))
    # A word takes two bytes with its separator, so half the bytes bound the words.
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shares = max(1, math.ceil(size / 2 / most))
    out = []
    for k in range(shares):
        share = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(shares)) == k).toArrow()
        out.append(ItemIndex(share.column("item_id").to_pylist(), share.column("text").to_pylist(), window))
    return out


def overlaps(
    docs: DataFrame, items: DataFrame, *, window: int = 10, max_coverage: float = 0.5, item_words: int = ITEM_WORDS
) -> DataFrame:
    """`docs` with n_words, n_hit, hit_items (sorted array), clean_text and over_coverage.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. A window is `window` words in
    a row of a test item, or a whole shorter item; a document word in any occurrence of a window is hit.
    `clean_text` is the text without its hit spans (from the first hit word of a run to its last);
    `over_coverage` tells that over `max_coverage` of the words are hit. Null text has no words and stays null in
    clean_text; null and empty items and equal items are allowed; an item without an id answers to no name.
    Equal rows stay separate; columns with the new names are replaced; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    plain = docs.drop(*ADDED)
    indexes = _indexes(items.where(F.col("item_id").isNotNull()), window, item_words)
    one = len(indexes) == 1
    schema = T.StructType([*plain.schema.fields, *T._parse_datatype_string(_RESULT if one else _STATE).fields])
    seen = plain if one else plain.withColumns({"hit_bits": F.lit(None).cast("binary"), "hit_items": F.array().cast("array<string>")})
    for index in indexes:
        shared = spark.sparkContext.broadcast(index)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                hit, met = _hits(part, shared.value)
                yield _cut(part, hit, met, max_coverage) if one else _noted(part, hit, met)

        seen = seen.mapInArrow(scan, schema)
        if not one:
            seen = kept(seen, "item-share")
    if one:
        return seen
    final = T.StructType([*plain.schema.fields, *T._parse_datatype_string(_RESULT).fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            hit, met = _hits(part, None)
            yield _cut(part, hit, met, max_coverage)

    return seen.mapInArrow(cut, final)


ADDED = ["n_words", "n_hit", "hit_items", "clean_text", "over_coverage"]
_RESULT = "n_words long, n_hit long, hit_items array<string>, clean_text string, over_coverage boolean"
#: What passes over shares of the items hand on: a bit for each word, and the items so far.
_STATE = "hit_bits binary, hit_items array<string>"


def _hits(part: pa.RecordBatch, index: ItemIndex | None) -> tuple[np.ndarray, list[set[str]]]:
    n = part.num_rows
    hashes, row = _hashed(texts(part.column("text")))
    hit, met = index.hits(hashes, row, n) if index else (np.zeros(len(hashes), bool), [set() for _ in range(n)])
    if "hit_bits" in part.schema.names:
        edge = row_edges(row, n)
        for r, (bits, names) in enumerate(zip(part.column("hit_bits").to_pylist(), part.column("hit_items").to_pylist())):
            if bits is not None:
                hit[edge[r] : edge[r + 1]] |= np.frombuffer(bits, np.bool_)
            met[r].update(names)
    return hit, met


def _noted(part: pa.RecordBatch, hit: np.ndarray, met: list[set[str]]) -> pa.RecordBatch:
    _, row = _hashed(texts(part.column("text")))
    edge = row_edges(row, part.num_rows)
    plain = [c for c in part.schema.names if c not in ("hit_bits", "hit_items")]
    bits = [hit[a:b].tobytes() if hit[a:b].any() else None for a, b in zip(edge, edge[1:])]
    added = [pa.array(bits, pa.binary()), pa.array([sorted(m) for m in met], pa.list_(pa.string()))]
    return pa.record_batch([*(part.column(c) for c in plain), *added], names=[*plain, "hit_bits", "hit_items"])


def _cut(part: pa.RecordBatch, hit: np.ndarray, met: list[set[str]], max_coverage: float) -> pa.RecordBatch:
    """The rows with their counts and the text outside the hit spans."""
    n = part.num_rows
    column = part.column("text")
    source = texts(column)
    word = words(source, NON_ALNUM)
    n_words, n_hit = row_counts(word.row, n), row_counts(word.row[hit], n)
    bodies = column.to_pylist()
    edge = row_edges(word.row, n)
    for r in np.flatnonzero(n_hit).tolist():
        a, b = edge[r], edge[r + 1]
        flags = np.concatenate([[False], hit[a:b], [False]])
        begin, end = np.flatnonzero(~flags[:-1] & flags[1:]), np.flatnonzero(flags[:-1] & ~flags[1:])
        body = source.data[source.starts[r] : source.starts[r + 1]].tobytes()
        at, left = 0, []
        for x, y in zip(begin, end):
            left.append(body[at : word.start[a + x] - source.starts[r]])
            at = word.end[a + y - 1] - source.starts[r]
        bodies[r] = b"".join([*left, body[at:]]).decode("utf-8")
    plain = [c for c in part.schema.names if c not in ("hit_bits", "hit_items")]
    added = [
        pa.array(n_words, pa.int64()),
        pa.array(n_hit, pa.int64()),
        pa.array([sorted(s) for s in met], pa.list_(pa.string())),
        pa.array(bodies, pa.string()),
        pa.array(n_hit > max_coverage * n_words, pa.bool_()),
    ]
    return pa.record_batch([*(part.column(c) for c in plain), *added], names=[*plain, *ADDED])
