"""Passages repeated across documents, by sparse suffix arrays over content-selected positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.scratch import kept
from framelake.llm.text import LOWER, SPACE, Texts, Words, mix, row_edges, slices, span_hashes, text_or_empty, texts, words

#: A repeated passage has this many words at least.
LENGTH = 50
#: Words of the hash that selects positions; every window of LENGTH words has its smallest hash selected.
GRAM = 8
REACH = LENGTH - GRAM
#: Documents with one gram whose suffixes are sorted together at most; of larger groups each window is counted by
#: its hash. The result is the same for any value.
SHARE = 10_000
_WORD = np.dtype(">u2")
SPAN = "doc_id long, first long, last long, removable boolean"


def minimisers(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Selected word positions, their gram hashes, and the first and last window start each is the smallest of.

    For every window of LENGTH words the leftmost smallest of its gram hashes is selected, so equal windows
    select equal positions. Sliding minima come from running minima of blocks, in linear time.
    """
    none = np.zeros(0, np.int64)
    if len(hashes) < LENGTH:
        return none, np.zeros(0, np.uint64), none, none
    n = len(hashes) - GRAM + 1
    value = np.zeros(n, np.uint64)
    for i in range(GRAM):
        value = mix(value * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + n])
    bits = np.uint64(max(1, int(n).bit_length()))
    key = (value >> bits << bits) | np.arange(n, dtype=np.uint64)
    width = REACH + 1
    size = -(-n // width) * width
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = np.flatnonzero(row[: len(row) - LENGTH + 1] == row[LENGTH - 1 :])
    least = np.minimum(behind[starts], ahead[starts + REACH])
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    position, first, count = np.unique(at, return_index=True, return_counts=True)
    # Starts with one minimiser stand together, as a window only moves on.
    return position, value[position], starts[first], starts[first + count - 1]


def _hashed(array: pa.Array) -> tuple[Texts, Words, np.ndarray]:
    source = texts(array)
    word = words(source, SPACE)
    return source, word, span_hashes(LOWER[source.data], word.start, word.end)


def _suffixes(part: pa.RecordBatch) -> pa.RecordBatch:
    """The wanted suffixes of each text: 42 words before (nearest first) and after the gram, two bytes a word.

    A suffix of a hot gram comes as one row for each of its windows: `h` is then the hash of the whole window, `least`
    and `most` are the number of its words before the gram, and `after` and `before` are null.
    """
    _, word, hashes = _hashed(part.column("text"))
    position, value, first, last = minimisers(hashes, word.row)
    edge = row_edges(word.row, part.num_rows)
    row = word.row[position]
    wanted = part.column("wanted")
    owner = np.repeat(np.arange(part.num_rows), np.diff(wanted.offsets.to_numpy()))
    asked = wanted.flatten()
    names = asked.field("h").to_numpy().view(np.uint64)
    heat = asked.field("hot").to_numpy(zero_copy_only=False)
    ids = np.unique(mix(names + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    mine = mix(value + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at = np.minimum(np.searchsorted(ids[0], mine), max(len(ids[0]) - 1, 0))
    chosen = np.flatnonzero(ids[0][at] == mine) if len(ids[0]) else np.zeros(0, np.int64)
    position, value, row, first, last = position[chosen], value[chosen], row[chosen], first[chosen], last[chosen]
    hot = heat[ids[1][at[chosen]]]
    short = np.concatenate([(hashes & np.uint64(0xFFFF)).astype(_WORD), np.zeros(1, _WORD)])
    steps = np.arange(REACH)
    after = position[:, None] + GRAM + steps
    after = np.where(after < edge[row + 1][:, None], after, len(short) - 1)
    before = position[:, None] - 1 - steps
    before = np.where(before >= edge[row][:, None], before, len(short) - 1)
    # In periodic text the same suffix comes again every few words: such a run is one row.
    context = mix(_running(short[after])[:, -1] + mix(_running(short[before])[:, -1] + mix(value + (first - position).astype(np.uint64))))
    context = mix(context + mix((last - position).astype(np.uint64) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.lexsort((position, context))
    apart = (context[order][1:] != context[order][:-1]) | (np.diff(position[order]) > REACH)
    begin = np.flatnonzero(np.append(True, apart)) if len(order) else order
    until = position[order][np.append(begin[1:], len(order)) - 1] if len(order) else position
    keep = order[begin]
    position, value, row, first, last, hot = position[keep], value[keep], row[keep], first[keep], last[keep], hot[keep]
    doc = part.column("doc_id")
    base = edge[row]
    after, before = short[after[keep]], short[before[keep]]
    least, most = position - last, position - first
    cold, hot = np.flatnonzero(~hot), np.flatnonzero(hot)
    each = most[hot] - least[hot] + 1
    o = np.repeat(least[hot], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    of = np.repeat(np.arange(len(hot)), each)
    ahead, back = _running(after[hot])[of, REACH - o], _running(before[hot])[of, o]
    window = mix(ahead + mix(back + mix(value[hot][of] + o.astype(np.uint64) + np.uint64(1))))
    who = np.concatenate([cold, hot[of]])
    none = [None] * len(of)
    return pa.record_batch(
        [
            pa.array(np.concatenate([value[cold], window]).view(np.int64)),
            doc.take(pa.array(row[who])),
            pa.array((position - base)[who].astype(np.int64)),
            pa.array((until - base)[who].astype(np.int64)),
            pa.array(np.concatenate([least[cold], o]).astype(np.int64)),
            pa.array(np.concatenate([most[cold], o]).astype(np.int64)),
            pa.array([r.tobytes() for r in after[cold]] + none, pa.binary()),
            pa.array([r.tobytes() for r in before[cold]] + none, pa.binary()),
        ],
        names=["h", "doc_id", "position", "until", "least", "most", "after", "before"],
    )


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each pair of rows."""
    same = a == b
    return np.where(same.all(axis=1), a.shape[1], np.argmin(same, axis=1))


def repeats_of(table: pa.Table) -> pa.RecordBatch:
    """Stretches of repeated windows among suffixes sorted by (h, after).

    A suffix and its two neighbours tell how far it goes on in common with any other; those that could not reach
    LENGTH words even with all words before them go. For the others each window that they stand in is the
    gram, `o` words before and the rest after: windows of two documents with equal words are repeated.
    """
    h = table.column("h").to_numpy()
    group = np.cumsum(np.append(False, h[1:] != h[:-1]))
    after = np.frombuffer(b"".join(table.column("after").to_pylist()), _WORD).reshape(-1, REACH)
    before = np.frombuffer(b"".join(table.column("before").to_pylist()), _WORD).reshape(-1, REACH)
    doc = table.column("doc_id").to_numpy()
    position, until, least, most = (table.column(c).to_numpy() for c in ("position", "until", "least", "most"))
    shared = np.where(group[1:] == group[:-1], _common(after[1:], after[:-1]), -1)
    right = np.maximum(np.append(shared, -1), np.append(-1, shared))
    use = np.flatnonzero((right >= 0) & (right + np.minimum(most, REACH) >= REACH))
    ahead, back = _running(after[use]), _running(before[use])
    repeated = np.zeros((len(use), REACH + 1), bool)
    removable = np.zeros((len(use), REACH + 1), bool)
    number = group[use].astype(np.uint64)
    for o in range(REACH + 1):
        ok = np.flatnonzero((least[use] <= o) & (o <= most[use]) & (right[use] >= REACH - o))
        if len(ok) < 2:
            continue
        key = mix(ahead[ok, REACH - o] + mix(back[ok, o] + mix(number[ok] + np.uint64(1))))
        order = np.lexsort((doc[use[ok]], key))
        key, docs = key[order], doc[use[ok]][order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        lowest, highest = np.repeat(docs[first], size), np.repeat(docs[first + size - 1], size)
        repeated[ok[order], o] = lowest != highest
        removable[ok[order], o] = docs != lowest
    return _spans(repeated, removable, use, position, until, doc)


def _running(rows: np.ndarray) -> np.ndarray:
    """Hash of each beginning of each row."""
    out = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
    for i in range(rows.shape[1]):
        out[:, i + 1] = mix(out[:, i] * np.uint64(0xD6E8FEB86659FD93) + rows[:, i].astype(np.uint64) + np.uint64(1))
    return out


def _spans(repeated: np.ndarray, removable: np.ndarray, use: np.ndarray, position: np.ndarray, until: np.ndarray, doc: np.ndarray):
    out = [_stretches(flags, use, position, until, doc, kind) for flags, kind in ((repeated, False), (removable, True))]
    return pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], names=["doc_id", "first", "last", "removable"])


def _hot_spans(windows: DataFrame) -> DataFrame:
    """doc_id, first, last, removable of the repeated ones among rows of single windows (h is the window's hash).

    The smallest and largest holder of each window are found by partial aggregates, so a window that all documents
    have is a row a task there; the bits of a suffix's windows then come together in one row.
    """
    c = F.col
    holders = windows.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    holders = kept(holders.where(c("a") != c("b")).select("h", "a"), "suffix-windows")
    bit = F.expr("shiftleft(1L, cast(least as int))")
    flags = (
        windows.join(holders, "h")
        .groupBy("doc_id", "position", "until")
        .agg(F.bit_or(bit).alias("repeated"), F.bit_or(F.when(c("doc_id") != c("a"), bit).otherwise(F.lit(0).cast("long"))).alias("removable"))
    )

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            doc, position, until, *bits = (part.column(n).to_numpy() for n in ("doc_id", "position", "until", "repeated", "removable"))
            repeated, removable = ((b[:, None] >> np.arange(REACH + 1) & 1).astype(bool) for b in bits)
            yield _spans(repeated, removable, np.arange(len(doc)), position, until, doc)

    return flags.mapInArrow(spread, SPAN)


def _stretches(flags: np.ndarray, use: np.ndarray, position: np.ndarray, until: np.ndarray, doc: np.ndarray, kind: bool):
    edge = np.zeros((len(flags), flags.shape[1] + 2), np.int8)
    edge[:, 1:-1] = flags
    step = np.diff(edge, axis=1)
    who, begin = np.nonzero(step == 1)
    _, end = np.nonzero(step == -1)
    return doc[use[who]], position[use[who]] - (end - 1), until[use[who]] - begin + LENGTH, np.full(len(who), kind)


def _merged(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(first, last)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_passages(docs: DataFrame, *, share: int = SHARE) -> DataFrame:
    """doc_id, n_repeated, spans and removable_spans of the documents with a passage that another one has.

    Words are runs without white space, A-Z lower-cased. Of each text the suffixes at selected positions are
    looked at (one of some 22 words). A gram that no two documents select has no repeated window; the other
    suffixes are sorted by what follows, compared with their neighbours and extended to both sides up to the
    window. Spans are [first word, behind the last word) and cover all words in windows of LENGTH words that
    occur in two documents; removable_spans leave out what the document with the smallest id holds.
    Where more than `share` documents select one gram, each window of its suffixes is grouped by the hash of all its
    words instead, with the smallest and largest holder; the result is the same. Words are compared by two
    bytes of their hashes beside the 64-bit gram: a differing word counts as equal once in 65,536 times.
    Rows without an id, and null, empty and short texts have no spans; rows with equal ids are one document.
    An empty table gives an empty result.
    """
    c = F.col
    rows = docs.where(c("doc_id").isNotNull()).select(c("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            _, word, hashes = _hashed(part.column("text"))
            position, value, _, _ = minimisers(hashes, word.row)
            both = np.unique(np.stack([word.row[position], value.view(np.int64)], 1), axis=0) if len(position) else np.zeros((0, 2), np.int64)
            yield pa.record_batch([part.column("doc_id").take(pa.array(both[:, 0])), pa.array(both[:, 1])], names=["doc_id", "h"])

    chosen = kept(rows.mapInArrow(select, "doc_id long, h long"), "suffix-grams")
    groups = chosen.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    groups = kept(groups.where(c("a") != c("b")).select("h", (c("k") > share).alias("hot")), "suffix-groups")
    wanted = chosen.join(groups, "h").groupBy("doc_id").agg(F.collect_list(F.struct("h", "hot")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield _suffixes(part)

    schema = "h long, doc_id long, position long, until long, least long, most long, after binary, before binary"
    suffixes = rows.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(cut, schema)
    hot = None
    if not groups.where("hot").isEmpty():
        # Written once, as both ways read it.
        suffixes = kept(suffixes, "suffix-rows")
        hot = _hot_spans(suffixes.where(c("after").isNull()).drop("after", "before"))
        suffixes = suffixes.where(c("after").isNotNull())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            size += batch.num_rows
            if size < 20_000:
                continue
            # All but the last group, which may go on in the next batch.
            table = pa.Table.from_batches(waiting)
            h = table.column("h").to_numpy()
            other = np.flatnonzero(h != h[-1])
            whole = int(other[-1]) + 1 if len(other) else 0
            if whole:
                yield repeats_of(table.slice(0, whole))
            waiting = table.slice(whole).to_batches()
            size = table.num_rows - whole
        if size:
            yield repeats_of(pa.Table.from_batches(waiting))

    found = suffixes.repartition("h").sortWithinPartitions("h", "after").mapInArrow(compare, SPAN)
    if hot is not None:
        found = found.unionByName(hot)
    spans = found.groupBy("doc_id").agg(
        F.collect_set(F.when(~c("removable"), F.struct("first", "last"))).alias("spans"),
        F.collect_set(F.when(c("removable"), F.struct("first", "last"))).alias("removable_spans"),
    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for part in batches:
            out, length = [], []
            for name in ("spans", "removable_spans"):
                merged = [_merged([s["first"] for s in v], [s["last"] for s in v]) for v in part.column(name).to_pylist()]
                out.append(pa.array([[{"first": a, "last": b} for a, b in v] for v in merged], kind))
                length.append([sum(b - a for a, b in v) for v in merged])
            yield pa.record_batch(
                [part.column("doc_id"), pa.array(length[0], pa.int64()), pa.array(length[1], pa.int64()), *out],
                names=["doc_id", "n_repeated", "n_removable", "spans", "removable_spans"],
            )

    span = "array<struct<first:long,last:long>>"
    return spans.mapInArrow(merge, f"doc_id long, n_repeated long, n_removable long, spans {span}, removable_spans {span}")


def without_spans(docs: DataFrame, spans: DataFrame, name: str = "removable_spans") -> DataFrame:
    """`docs` with the text cut at the word spans of `spans` (doc_id, name); rows that have none stay as they are."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            source, word, _ = _hashed(part.column("text"))
            bodies = part.column("text").to_pylist()
            edge = row_edges(word.row, part.num_rows)
            for r, cuts in enumerate(part.column("__spans").to_pylist()):
                if cuts and bodies[r] is not None:
                    low = source.starts[r]
                    body = source.data[low : source.starts[r + 1]].tobytes()
                    at, left = 0, []
                    for s in cuts:
                        left.append(body[at : word.start[edge[r] + s["first"]] - low])
                        at = word.end[edge[r] + s["last"] - 1] - low
                    bodies[r] = b"".join([*left, body[at:]]).decode("utf-8")
            columns = [pa.array(bodies, pa.string()) if c == "text" else part.column(c) for c in names]
            yield pa.record_batch(columns, names=names)

    names = docs.columns
    joined = docs.join(spans.select(F.col("doc_id").alias("__id"), F.col(name).alias("__spans")), F.col("doc_id") == F.col("__id"), "left")
    return joined.drop("__id").mapInArrow(apply, docs.schema)
