"""Prefix trie of conversations: sorted shards between splitters, and a skeleton of the splitters' paths.

Paths of turns are sorted and range-partitioned by sampled rows, the splitters. A node whose rows lie in more than one
shard begins the path of a splitter. So the trie of the splitters' paths, the skeleton, is sent to all tasks: a
shard finishes every other node by itself, walking through its sorted rows with one path of open nodes in memory, and
gives partial aggregates of skeleton nodes, which are summed afterwards.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.scratch import kept
from framelake.llm.text import text_or_empty
from framelake.plans.scan import ordinal

#: Turns of a path that one row holds; a longer conversation has several rows, each below the node at which it begins.
LEVELS = 64
#: Rows of a shard, most shards, and sampled rows for each splitter. The skeleton has at most MOST_SHARDS * (LEVELS + 1) nodes.
SHARD_ROWS, MOST_SHARDS, SAMPLED = 20_000, 1024, 8
#: Ids in one row of `Trie.ends`.
ENDS = 4096

ID = 16


class Trie(NamedTuple):
    """nodes: conv_id (the smallest member) and depth name a node; parent_conv_id, n_convs, n_children, n_leaves, saved_tokens.
    ends: conv_id and depth of a node, and in `ids` members that end there; rows in order of `first`, ids ascending."""

    nodes: DataFrame
    ends: DataFrame


class Skeletal(NamedTuple):
    """The conversation that stands for a skeleton node, that of the first splitter through it, and its skeleton children."""

    conv_id: int
    seg: int
    children: int


class Node:
    """An open node: its partial aggregates, and finished children that wait for its smallest member."""

    __slots__ = ("ref", "skeletal", "depth", "words", "n", "low", "children", "leaves", "saved", "ends", "goes_on", "stands", "waiting", "opened")

    def __init__(self, ref: bytes | None, skeletal: Skeletal | None, depth: int, words: int, opened: int) -> None:
        self.ref, self.skeletal, self.depth, self.words, self.opened = ref, skeletal, depth, words, opened
        self.n = self.children = self.leaves = self.saved = 0
        self.low: int | None = None
        self.ends = array("q")
        self.goes_on = self.stands = False
        self.waiting: list[tuple] = []


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place, digest and words of each turn; null turns come first, equal ones in order of their digest.

    The digest is the MD5 of role and text, a null one being empty. Rows without conv_id belong to no conversation.
    Long conversations are numbered in stretches of turn numbers, not in one window.
    """
    c = F.col
    role, text = F.coalesce(c("role").cast("string"), F.lit("")), text_or_empty()
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where(c("conv_id").isNotNull()).select(
        c("conv_id").cast("long").alias("conv_id"),
        c("turn").cast("long").alias("turn"),
        digest.alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    rows = kept(rows.withColumn("stretch", F.coalesce(F.shiftright("turn", 6), F.lit(-(1 << 62)))), "trie-turns")
    return ordinal(rows, ["conv_id"], "stretch", ["turn", "digest"], "place").select("conv_id", "place", "digest", "words")


def share_openings(turns: DataFrame, *, every: int = 20, upto: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, digest, words) and ids of rebuilt conversations.

    With h the CRC-32 of the id modulo `upto`, a conversation begins with the first h turns of that whose id is the
    next lower multiple of `every` (fewer if it has fewer) and goes on with its own turns behind its first h.
    """
    c = F.col
    opening = lambda conv_id: F.crc32(conv_id.cast("string").cast("binary")) % upto
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    counts = kept(counts, "trie-counts")
    base = counts.select("conv_id", (c("conv_id") - c("conv_id") % every).alias("base"), opening(c("conv_id")).alias("h"))
    given = counts.select(c("conv_id").alias("base"), c("n").alias("has"))
    convs = base.join(given, "base", "left").withColumn("given", F.least("h", F.coalesce("has", F.lit(0))))
    heads = turns.where(c("place") < upto).select(c("conv_id").alias("base"), "place", "digest", "words")
    first = convs.where("h > 0").join(heads, "base").where(c("place") <= c("h")).select("conv_id", c("place").alias("depth"), "digest", "words")
    own = turns.where(c("place") > opening(c("conv_id"))).join(convs.select("conv_id", "given"), "conv_id")
    own = own.select("conv_id", (c("place") - opening(c("conv_id")) + c("given")).alias("depth"), "digest", "words")
    return first.unionByName(own), counts.select("conv_id")


def _segments(turns: DataFrame, ids: DataFrame, levels: int) -> DataFrame:
    """conv_id, seg, key, words, after, last: each conversation in rows of up to `levels` turns.

    The key is the name of the node where the row begins and the digests of its turns, 16 bytes each, so keys sort as
    paths. A name is a digest of sums over (depth, turn) hashes, which need no order and add up over rows. `after`
    names the node at the end of a full row.
    """
    c = F.col
    marks = turns.select("conv_id", "depth", "digest", "words").unionByName(
        ids.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("words"))
    )
    real = c("digest").isNotNull()
    hashes = [F.xxhash64(F.lit(1), c("depth"), c("digest")), F.xxhash64(F.lit(2), c("digest"), c("depth"))]
    halves = [half for h in hashes for half in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]
    rows = (
        marks.withColumn("seg", F.when(real, F.floor((c("depth") - 1) / levels)).otherwise(0).cast("long"))
        .groupBy("conv_id", "seg")
        .agg(
            F.array_sort(F.collect_list(F.when(real, F.struct("depth", "digest", "words")))).alias("path"),
            *(F.sum(F.when(real, x).otherwise(0)).alias(f"s{i}") for i, x in enumerate(halves)),
        )
    )
    along = Window.partitionBy("conv_id").orderBy("seg")
    before = [F.coalesce(F.sum(f"s{i}").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for i in range(4)]
    name = lambda sums: F.md5(F.concat_ws(",", *(s.cast("string") for s in sums)))
    rows = rows.withColumns({f"b{i}": b for i, b in enumerate(before)} | {"last": F.lead("seg").over(along).isNull()})
    behind = name([c(f"b{i}") + c(f"s{i}") for i in range(4)])
    return rows.select(
        "conv_id", "seg",
        F.unhex(F.concat(name([c(f"b{i}") for i in range(4)]), F.array_join("path.digest", ""))).alias("key"),
        c("path.words").alias("words"),
        F.when(F.size("path") == levels, F.unhex(behind)).alias("after"),
        "last",
    )


def _splitters(rows: DataFrame, shards: int) -> list[tuple[bytes, int, int, bytes | None]]:
    """(key, conv_id, seg, after) of rows that cut the sorted rows into about equal parts, from a sample bounded by the number of shards."""
    n = rows.count()
    wanted = SAMPLED * shards
    picked = rows if n <= 2 * wanted else rows.where(F.pmod(F.xxhash64("conv_id", "seg"), F.lit(n // wanted)) == 0)
    sample = sorted((bytes(r.key), r.conv_id, r.seg, r.after and bytes(r.after)) for r in picked.select("key", "conv_id", "seg", "after").collect())
    return [sample[i] for i in sorted({len(sample) * s // shards for s in range(1, shards)}) if 0 < i < len(sample)]


def _ref(key: bytes, level: int, levels: int, after: bytes | None) -> bytes:
    """Sixteen bytes that name the node `level` turns below the beginning of a row, the same in all shards."""
    if level == 0:
        return key[:ID]
    return after if level == levels else hashlib.md5(key[: ID * (level + 1)]).digest()


def _skeleton(splitters: list[tuple[bytes, int, int, bytes | None]], levels: int) -> dict[tuple[bytes, bool], Skeletal]:
    """Nodes of the splitters' paths by name and whether rows begin there."""
    stands: dict[tuple[bytes, bool], tuple[int, int]] = {}
    below: dict[tuple[bytes, bool], set[bytes]] = {}
    for key, conv_id, seg, after in splitters:
        above = None
        for level in range(len(key) // ID):
            node = (_ref(key, level, levels, after), level == 0)
            stands.setdefault(node, (conv_id, seg))
            below.setdefault(node, set())
            if above:
                below[above].add(node[0])
            above = node
    return {node: Skeletal(*of, len(below[node])) for node, of in stands.items()}


class Walk:
    """Open nodes of a shard's sorted rows. `close` is called with a node and the one above it when its last row has passed."""

    def __init__(self, skeleton: dict[tuple[bytes, bool], Skeletal], levels: int) -> None:
        self.skeleton, self.levels = skeleton, levels
        self.stand_ins = {(s.conv_id, s.seg) for s in skeleton.values()}
        self.open: list[Node] = []
        self.key = b""
        self.out: list[tuple] = []

    def row(self, conv_id: int, seg: int, key: bytes, words: list[int], after: bytes | None) -> None:
        """Closes what the row is not below and opens its own nodes."""
        shared, most = 0, ID * len(self.open)
        while ID * shared < most and self.key[ID * shared : ID * (shared + 1)] == key[ID * shared : ID * (shared + 1)]:
            shared += 1
        while len(self.open) > shared:
            self.shut()
        for level in range(len(self.open), len(key) // ID):
            skeletal = ref = None
            if level == 0 or self.open[-1].skeletal:
                ref = _ref(key, level, self.levels, after)
                skeletal = self.skeleton.get((ref, level == 0))
            if level in (0, self.levels):
                ref = _ref(key, level, self.levels, after)
            self.open.append(Node(ref, skeletal, seg * self.levels + level, words[level - 1] if level else 0, conv_id))
        self.key = key
        if (conv_id, seg) in self.stand_ins:
            for node in self.open:
                if node.skeletal and (node.skeletal.conv_id, node.skeletal.seg) == (conv_id, seg):
                    node.stands = True

    def shut(self) -> None:
        node = self.open.pop()
        self.close(node, self.open[-1] if self.open else None)

    def close(self, node: Node, above: Node | None) -> None:
        raise NotImplementedError

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


class Carry(Walk):
    """What a row adds to all nodes above its beginning: (conv_id, seg, saved, leaves, ref, children) in `out`.

    Each node has one stand-in, the row that opened it or that of its splitter, whose turn is not saved but paid for. A leaf counts
    for its stand-in; of skeleton nodes that is known when the children of all shards are summed.
    """

    def add(self, conv_id: int, seg: int, key: bytes, words: list[int], after: bytes | None, last: bool) -> None:
        self.row(conv_id, seg, key, words, after)
        self.open[-1].goes_on |= not last
        saved = 0
        for node in self.open[1:]:
            stands = node.skeletal.conv_id if node.skeletal else node.opened
            saved += node.words * (stands != conv_id)
        self.out.append((conv_id, seg, saved, 0, None, None))

    def close(self, node: Node, above: Node | None) -> None:
        if above is None:
            return
        seg = (node.depth - 1) // self.levels
        if node.skeletal:
            below = node.children + node.goes_on + (node.skeletal.children if node.stands else 0)
            self.out.append((node.skeletal.conv_id, node.skeletal.seg, 0, 0, node.ref, below))
            return
        above.children += 1
        if not node.children and not node.goes_on:
            self.out.append((node.opened, seg, 0, 1, None, None))


class Count(Walk):
    """Finished nodes, partial nodes, ends and leaf paths of a shard, as rows of `COUNTED` in `out`."""

    def add(self, conv_id: int, seg: int, key: bytes, words: list[int], after: bytes | None, last: bool, saved: int, leaves: int) -> None:
        self.row(conv_id, seg, key, words, after)
        node = self.open[-1]
        node.n += 1
        node.low = conv_id if node.low is None else min(node.low, conv_id)
        node.saved += saved
        node.leaves += leaves
        if last:
            node.ends.append(conv_id)
        else:
            node.goes_on = True

    def close(self, node: Node, above: Node | None) -> None:
        continued = above is None and node.depth > 0
        merged = node.skeletal is not None or continued or node.goes_on
        if node.skeletal:
            node.saved += node.n * node.words
            if node.stands:
                node.saved -= node.words
                node.children += node.skeletal.children
                if not node.skeletal.children:
                    # To the nodes above the beginning of the row, the leaf has been carried.
                    self.out += [("leaf", up.ref, node.ref, *[None] * 9) for up in [*self.open[bool(self.open[:1] and self.open[0].depth) :], node]]
        else:
            node.saved += max(node.n - 1, 0) * node.words
            if not merged and not node.children:
                node.leaves += 1
        ref = node.ref if merged else None
        for a in range(0, len(node.ends), ENDS):
            ids = node.ends[a : a + ENDS].tolist()
            self.out.append(("ends", ref, None, None if merged else node.low, node.depth, None, None, None, None, None, ids, False))
        if above is not None:
            above.n += node.n
            above.low = node.low if above.low is None else min(above.low, node.low)
            above.saved += node.saved
            above.leaves += node.leaves
            above.children += node.skeletal is None
        elif continued:
            # The row above the beginning has counted these conversations.
            node.n, node.low, node.saved, node.leaves = 0, None, 0, 0
        done = ("skeletal" if node.skeletal else "node", ref, None, node.low, node.depth, None, node.n, node.children, node.leaves, node.saved, None, False)
        for child in node.waiting:
            self.out.append((*child[:5], node.low, *child[6:]))
        node.waiting.clear()
        if above is None:
            self.out.append(done)
        elif above.skeletal or (above.depth and above is self.open[0]):
            self.out.append((*done[:2], above.ref, *done[3:11], above.skeletal is not None))
        else:
            above.waiting.append(done)


CARRIED = "conv_id long, seg long, saved long, leaves long, ref binary, children long"
COUNTED = (
    "kind string, ref binary, above binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ids array<long>, above_skeletal boolean"
)


def _walked(rows: DataFrame, names: list[str], splitters: list[tuple[bytes, int, int, bytes | None]], levels: int, kind: type[Walk], schema: str) -> DataFrame:
    """A walk through each shard; shard s has the rows from splitter s - 1 on and before splitter s."""
    context = rows.sparkSession.sparkContext
    cuts = context.broadcast([(key, conv_id) for key, conv_id, _, _ in splitters])
    skeleton = context.broadcast(_skeleton(splitters, levels))

    @F.pandas_udf("int")
    def shard(key: pd.Series, conv_id: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts.value, (bytes(k), int(c))) for k, c in zip(key, conv_id)], dtype="int32")

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def batch(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out) if out else [[] for _ in arrow]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: Any = kind(skeleton.value, levels)
        for part in batches:
            for row in zip(*(part.column(n).to_pylist() for n in names)):
                state.add(*row)
                if len(state.out) >= 5000:
                    yield batch(state.taken())
        while state.open:
            state.shut()
        yield batch(state.taken())

    dealt = rows.select(*names).withColumn("shard", shard("key", "conv_id")).repartitionById(len(splitters) + 1, F.col("shard"))
    return dealt.sortWithinPartitions("key", "conv_id").select(*names).mapInArrow(walk, schema)


def _carried(long: DataFrame, shards: int, levels: int) -> DataFrame:
    """conv_id, seg, and what the rows of the conversation behind that one add to each node of its path."""
    c = F.col
    found = kept(_walked(long, ["conv_id", "seg", "key", "words", "after", "last"], _splitters(long, shards), levels, Carry, CARRIED), "trie-carried")
    leaf = found.where("ref IS NOT NULL").groupBy("ref", "conv_id", "seg").agg(F.sum("children").alias("children")).where("children = 0")
    leaf = leaf.select("conv_id", "seg", F.lit(0).cast("long").alias("saved"), F.lit(1).cast("long").alias("leaves"))
    each = found.where("ref IS NULL").select("conv_id", "seg", "saved", "leaves").unionByName(leaf)
    each = each.groupBy("conv_id", "seg").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    behind = Window.partitionBy("conv_id").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, 0)
    return each.select(
        "conv_id", (c("seg") - 1).alias("seg"), F.sum("saved").over(behind).alias("saved"), F.sum("leaves").over(behind).alias("leaves")
    )


def prefix_trie(turns: DataFrame, ids: DataFrame, *, levels: int = LEVELS, shards: int | None = None) -> Trie:
    """Nodes and ends of the trie of conversations; turns: conv_id, depth (from 1, no gaps), digest (MD5 as hex), words; ids: conv_id, once each.

    A node is a distinct sequence of first turns, the root the empty one. n_convs counts the conversations that begin
    with it, n_leaves the childless nodes of its subtree, itself included, and saved_tokens sums (n_convs - 1) * words of the last turn over it.
    Conversations without turns end at the root. Equal conversations share all nodes. A conversation of more than
    `levels` turns is cut into rows that lie in the shards on their own; a first walk over those behind the first finds what they
    add to the nodes above them. Without conversations the result is empty.
    """
    c, spark = F.col, turns.sparkSession
    rows = kept(_segments(turns, ids, levels), "trie-rows")
    n = rows.count()
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SHARD_ROWS))
    shards = max(1, min(MOST_SHARDS, shards or wanted))
    long = rows.where("seg > 0")
    none = F.lit(0).cast("long")
    if long.isEmpty():
        whole = rows.withColumns({"saved": none, "leaves": none})
    else:
        whole = rows.join(_carried(long, shards, levels), ["conv_id", "seg"], "left").withColumns(
            {k: F.coalesce(k, none) for k in ("saved", "leaves")}
        )
    names = ["conv_id", "seg", "key", "words", "after", "last", "saved", "leaves"]
    found = kept(_walked(whole, names, _splitters(rows, shards), levels, Count, COUNTED), "trie-counted")
    nodes = found.where("kind IN ('node', 'skeletal')")
    totals = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    met = nodes.where("ref IS NOT NULL").groupBy("ref").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_conv_id").alias("parent_conv_id"),
        F.max("above").alias("above"), F.max("above_skeletal").alias("above_skeletal"), F.max("kind").alias("kind"), *(F.sum(t).alias(t) for t in totals),
    )
    met = kept(met, "trie-met")
    tips = found.where("kind = 'leaf'").select("ref", c("above").alias("tip")).distinct()
    tips = tips.join(met.where("n_children = 0").select(c("ref").alias("tip")), "tip").groupBy("ref").agg(F.count(F.lit(1)).alias("tips"))
    met = kept(met.join(tips, "ref", "left").withColumn("n_leaves", c("n_leaves") + F.coalesce("tips", none)).drop("tips"), "trie-summed")
    columns = ["conv_id", "depth", "parent_conv_id", *totals]
    named = met.select(c("ref").alias("above"), c("conv_id").alias("parent"))
    every = nodes.where("ref IS NULL").select(*columns, "above", "above_skeletal").unionByName(met.select(*columns, "above", "above_skeletal"))
    # The skeleton is bounded by MOST_SHARDS * (LEVELS + 1); one of its nodes may have any number of children.
    skeleton = F.broadcast(met.where("kind = 'skeletal'").select(c("ref").alias("above"), c("conv_id").alias("parent")))
    done = [
        every.where("above IS NULL").select(*columns),
        every.where("above_skeletal").drop("parent_conv_id").join(skeleton, "above").withColumnRenamed("parent", "parent_conv_id").select(*columns),
        every.where("above IS NOT NULL AND NOT above_skeletal").drop("parent_conv_id").join(named, "above")
        .withColumnRenamed("parent", "parent_conv_id").select(*columns),
    ]
    ends = found.where("kind = 'ends'").select("ref", "conv_id", "depth", F.element_at("ids", 1).alias("first"), "ids")
    at = met.select("ref", c("conv_id").alias("low"))
    shared = ends.where("ref IS NOT NULL").drop("conv_id").join(at, "ref").select(c("low").alias("conv_id"), "depth", "first", "ids")
    return Trie(done[0].unionByName(done[1]).unionByName(done[2]), ends.where("ref IS NULL").drop("ref").unionByName(shared))


def ends_digest(ends: DataFrame) -> DataFrame:
    """conv_id, depth and the SHA-256 of the ids at each node, ascending and joined by commas, read as a stream in order."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running = None, hashlib.sha256()
        done: list[tuple[int, int, str]] = []
        for part in batches:
            for conv_id, depth, ids in zip(*(part.column(n).to_pylist() for n in ("conv_id", "depth", "ids"))):
                text = ",".join(map(str, ids)).encode()
                if node == (conv_id, depth):
                    running.update(b"," + text)
                    continue
                if node:
                    done.append((*node, running.hexdigest()))
                node, running = (conv_id, depth), hashlib.sha256(text)
            yield _digests(done)
            done = []
        yield _digests([(*node, running.hexdigest())] if node else [])

    ordered = ends.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first")
    return ordered.select("conv_id", "depth", "ids").mapInArrow(digest, "conv_id long, depth long, ends_sha256 string")


def _digests(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string()]
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["conv_id", "depth", "ends_sha256"])
