"""Mixing sources to target weights by Pfair scheduling of their blocks."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A source without a weight gets one part in so many of the given weights' sum.
CYCLE = 1000
BLOCK_DOCS = 32
#: Rows ranked in one window; only the number of windows depends on it, no rank does.
RANKED_ROWS = 4_000
#: Slots that one task assigns from a carried state, or twenty times the number of sources where that is more.
INTERVAL = 20_000
#: A table of slots up to this many rows is broadcast.
SENT_SLOTS = 500_000


class Cycle(NamedTuple):
    """Slots of one cycle: (source, k, release, deadline, slot) for block k = 1.. of each source."""

    length: int
    blocks: list[tuple[int, int, int, int, int]]


class State(NamedTuple):
    """Where a schedule stands: next slot, phase and its first slot, blocks of each source before it and in it."""

    slot: int
    phase: int
    begun: int
    before: list[int]
    taken: list[int]


def whole_weights(weights: list[float], least: int = CYCLE) -> list[int]:
    """The weights as whole numbers in the same proportions, exactly; a source without one gets 1 / least of the sum."""
    exact = [Fraction(str(w)) for w in weights]
    total = sum(exact)
    exact = [w or total / least for w in exact] if total else [Fraction(1)] * len(exact)
    scale = math.lcm(*(w.denominator for w in exact))
    return [int(w * scale) for w in exact]


class Schedule:
    """Earliest deadline first over blocks of sources, `sizes[i]` of source i, with weights in whole numbers.

    In a phase the same sources have blocks left; the next begins, without debts, when one has none. Block k of a
    source with weight w among those (which sum to one) is released at floor((k - 1) / w) and due at ceil(k / w),
    in exact whole numbers. So every block meets its deadline and each source is less than one block away from
    w * t at any slot t of the phase. A schedule goes on from any `state` of an equal one.
    """

    def __init__(self, sizes: list[int], weights: list[int], state: State | None = None):
        self.sizes, self.weights = sizes, weights
        self.slot, self.phase, self.begun, before, taken = state or State(0, 0, 0, [0] * len(sizes), [0] * len(sizes))
        self.before, self.taken = list(before), list(taken)
        self._enter()

    @property
    def state(self) -> State:
        return State(self.slot, self.phase, self.begun, list(self.before), list(self.taken))

    def _enter(self) -> None:
        left = [i for i, n in enumerate(self.sizes) if self.before[i] < n]
        self.total = sum(self.weights[i] for i in left)
        self.ready: list[tuple[int, int, int]] = []
        self.waiting: list[tuple[int, int, int]] = []
        for i in left:
            self._queue(i)

    def _queue(self, i: int) -> None:
        k, w = self.taken[i], self.weights[i]
        heapq.heappush(self.waiting, (k * self.total // w, -(-(k + 1) * self.total // w), i))

    def run(self, steps: int) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(source, block from 0, phase, release, deadline, slot) of the next slots."""
        for _ in range(steps):
            while self.waiting and self.waiting[0][0] <= self.slot - self.begun:
                release, deadline, i = heapq.heappop(self.waiting)
                heapq.heappush(self.ready, (deadline, i, release))
            deadline, i, release = heapq.heappop(self.ready)
            yield i, self.before[i] + self.taken[i], self.phase, self.begun + release, self.begun + deadline, self.slot
            self.slot += 1
            self.taken[i] += 1
            if self.before[i] + self.taken[i] < self.sizes[i]:
                self._queue(i)
            else:
                self.before = [a + b for a, b in zip(self.before, self.taken)]
                self.taken, self.phase, self.begun = [0] * len(self.sizes), self.phase + 1, self.slot
                self._enter()


def edf_cycle(share: dict[int, int]) -> Cycle:
    """Earliest deadline first over one cycle, in which source i has share[i] blocks."""
    names, length = list(share), sum(share.values())
    blocks = Schedule([n + 1 for n in share.values()], list(share.values())).run(length)
    return Cycle(length, [(names[i], k + 1, release, deadline, slot) for i, k, _, release, deadline, slot in blocks])


def _slots(spark, names: list[str | None], sizes: list[int], weights: list[int]) -> DataFrame:
    """s, block, mix_phase, mix_release, mix_deadline and mix_slot of all blocks.

    The driver runs through the schedule once and keeps only its state at the beginning of each interval; tasks
    assign the slots of their intervals from there.
    """
    total, step = sum(sizes), max(INTERVAL, 20 * len(sizes))
    schedule, states = Schedule(sizes, weights), []
    while schedule.slot < total:
        states.append(schedule.state)
        for _ in schedule.run(min(step, total - schedule.slot)):
            pass
    shared = spark.sparkContext.broadcast((names, sizes, weights))
    kind = "slot long, phase int, begun long, before array<long>, taken array<long>"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, counts, each = shared.value
        for part in batches:
            for row in part.to_pylist():
                at = Schedule(counts, each, State(**row))
                found = list(zip(*at.run(min(step, sum(counts) - at.slot))))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array([of[i] for i in found[0]], pa.string()), *(pa.array(v, k) for v, k in zip(found[1:], kinds))]
                yield pa.record_batch(columns, names=["s", "block", "mix_phase", "mix_release", "mix_deadline", "mix_slot"])

    rows = spark.createDataFrame([tuple(s) for s in states], kind).repartition(max(1, len(states)))
    return rows.mapInArrow(assign, "s string, block long, mix_phase int, mix_release long, mix_deadline long, mix_slot long")


def _ranked(docs: DataFrame, key: Column) -> DataFrame:
    """Adds __rank, from 0, of each row in its source in hash order; no window holds a whole source."""
    keys = ["__key", "__null", "__part"]
    parts = max(1, math.ceil(docs.count() / RANKED_ROWS))
    high = F.shiftrightunsigned(F.xxhash64("doc_id"), 32)
    rows = docs.withColumns(
        {
            "__key": F.coalesce(key, F.lit("")),
            "__null": key.isNull(),
            "__part": F.floor(high * parts / F.lit(float(1 << 32))).cast("long"),
        }
    )
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    running = F.sum("n").over(Window.partitionBy("__key", "__null").orderBy("__part"))
    before = sizes.select(*keys, (running - F.col("n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(high, F.xxhash64("doc_id"), "doc_id")) - 1
    return rows.withColumn("__within", within).join(before, keys).withColumn("__rank", F.col("__before") + F.col("__within"))


def mix_sources(
    docs: DataFrame, weights: dict[str | None, float] | None = None, *, source: Column | None = None,
    power: float = 0.5, block_docs: int = BLOCK_DOCS, cycle: int = CYCLE,
) -> DataFrame:
    """`docs` with mix_phase, mix_block, mix_release, mix_deadline, mix_slot and mix_order.

    `weights` are target weights by source, taken as written (none or 0 given: one part in `cycle` of their sum);
    without them a source weighs its document count to `power`. A source's documents, in hash order of their
    ids, fill blocks of `block_docs`; the blocks of all sources get slots by earliest deadline first. No document
    is left out: when a source has no more, a new phase goes on with the others. In a phase every source is less
    than one block away from its unrounded target at each slot. Sorting by (mix_slot, mix_order) gives the mixed
    order. Only counts a source go to the driver, which walks through the blocks and sends out the schedule's
    state at each interval. A null source is one of its own; equal ids keep an order of their own; columns with
    the new names are replaced; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    source = F.col("source") if source is None else source
    kept = docs.drop("mix_phase", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_order")
    key = source.cast("string")
    counted = kept.groupBy(key.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()
    named = sorted(((r.s, r.n) for r in counted), key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [-(-n // block_docs) for _, n in named]
    wanted = [float((weights or {}).get(s) or 0.0) if weights else n**power for s, n in named]
    slots = _slots(spark, [s for s, _ in named], sizes, whole_weights(wanted, cycle) if named else [])
    if sum(sizes) <= SENT_SLOTS:
        slots = F.broadcast(slots)
    ranked = _ranked(kept, key).withColumn("mix_block", F.floor(F.col("__rank") / block_docs).cast("long"))
    c = F.col
    placed = ranked.join(slots, key.eqNullSafe(c("s")) & (c("mix_block") == c("block")))
    return placed.select(
        *(F.col(f"`{n}`") for n in kept.columns),
        "mix_phase",
        "mix_block",
        "mix_release",
        "mix_deadline",
        "mix_slot",
        (c("__rank") % block_docs).cast("int").alias("mix_order"),
    )


def in_mixed_order(mixed: DataFrame) -> DataFrame:
    """The rows dealt and sorted by slot, so that files read one after another are the mixture."""
    return mixed.repartitionByRange("mix_slot", "mix_order").sortWithinPartitions("mix_slot", "mix_order")
