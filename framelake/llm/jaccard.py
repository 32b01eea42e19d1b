"""Jaccard self-join on word n-grams by prefixes under several global token orders, and its components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.scratch import kept, noted, remove
from framelake.llm.text import LOWER, SPACE, Texts, grams, mix, row_edges, slices, span_hashes, text_or_empty, texts, words
from framelake.operators.graphs import connected_components

#: Words of a shingle and the least similarity a / b of a link, b * intersection >= a * union, unless given.
SHINGLE, THRESHOLD = 3, (9, 10)
#: A band's ends have sizes of this ratio times b / a; linked sets differ by b / a at most, so they share a band.
BAND = 1.008
#: Seeds of the hash that deals tokens to parts and of the one that a part's tokens are summed by.
DEAL, SUM = 0x5851F42D4C957F2D, 0x14057B7EF767814F
#: One part in so many beyond those needed is cut besides, and the smallest of a set are left out for them.
SPARE = 4
#: Rounds in which one member of a group is compared with its others, before the rest is compared in blocks.
ROUNDS = 2
#: Families up to this size are compared row by row of a sorted stream; larger ones block by block.
SMALL, BLOCK = 48, 2_048
#: Bits of the map by which texts are told that are not wanted, and 64-bit words of it in a row: 2 MB in all, at any size of the input.
BITS, ROW_WORDS = 1 << 24, 128
#: Tokens of a set are counted in so many cells; two sets differ in at least as many tokens as their counts do.
CELLS = 256
#: Bytes of text whose sets are made at once. Signatures lie in so many columns by their values, and one column at a time is shuffled.
SLICE, SHARES = 1 << 19, 4
#: Tokens that the pairs of one pass bring together: one part in so many of all tokens, or this many if that is more.
PASS_SHARE, PASS_TOKENS = 4, 16_000_000


def shingle_sets(source: Texts, n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a text with fewer words has one, of all its words."""
    word = words(source, SPACE)
    hashes = span_hashes(LOWER[source.data], word.start, word.end)
    value, at = grams(hashes, word.row, n)
    rows = len(source.starts) - 1
    edge, gram_edge = row_edges(word.row, rows), row_edges(word.row[at], rows)
    out = []
    for r in range(rows):
        if gram_edge[r + 1] > gram_edge[r]:
            out.append(np.unique(value[gram_edge[r] : gram_edge[r + 1]]))
        elif edge[r + 1] > edge[r]:
            few = hashes[edge[r] : edge[r + 1]]
            out.append(grams(few, np.zeros(len(few), np.int64), len(few))[0])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that tell different sets apart, in any order of their tokens."""
    a = int(mix(tokens + np.uint64(1)).sum(dtype=np.uint64)) if len(tokens) else 0
    b = int(mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)) if len(tokens) else 0
    return int(np.uint64(a).astype(np.int64)), int(np.uint64(b).astype(np.int64))


def signatures(sets: list[np.ndarray], threshold: tuple[int, int] = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """64-bit signatures of sets, of which linked sets have one in common, and their number for each set.

    Linked sets of at most t tokens differ in no more than h = 2 t (b - a) / (a + b) tokens. Their tokens are dealt to
    h + 1 + s parts by a hash, so at least s + 1 parts are equal, and a signature stands for a part's tokens. Each set leaves out
    its s smallest parts: the largest of the equal parts is left out by neither set, as all the others would have to be as well.
    Sizes fall into bands, and a set has signatures for two of them; the last bit tells the two apart.
    """
    a, b = threshold
    n = np.array([len(x) for x in sets], np.int64)
    rows, ratio = len(sets), math.log(BAND * b / a)
    token = np.concatenate(sets) if rows else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(rows), n)
    dealt, value = mix(token ^ np.uint64(DEAL)) >> np.uint64(32), mix(token ^ np.uint64(SUM))
    halves = [(value >> np.uint64(32)).astype(float), (value & np.uint64(0xFFFFFFFF)).astype(float)]
    band = np.floor(np.log(np.maximum(n, 1)) / ratio).astype(np.int64)
    found, owners = [], []
    for key in (band, band + 1):
        top = np.ceil(np.exp((key + 1) * ratio)).astype(np.int64) + 1
        apart = 2 * top * (b - a) // (a + b)
        spare = np.where(apart > 0, -(-(apart + 1) // SPARE), 0)
        parts = np.where(n > 0, apart + 1 + spare, 0)
        first = np.cumsum(parts) - parts
        slot = first[row] + (dealt % np.maximum(parts, 1).astype(np.uint64)[row]).astype(np.int64)
        slots = int(parts.sum())
        high, low = (np.bincount(slot, half, slots).astype(np.uint64) for half in halves)
        size = np.bincount(slot, minlength=slots)
        owner = np.repeat(np.arange(rows), parts)
        place = np.arange(slots) - first[owner]
        named = mix((key[owner].astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64))
        named = mix(low + mix(high + named))
        order = np.lexsort((place, size, owner))
        order = order[np.arange(slots) - first[owner[order]] >= spare[owner[order]]]
        found.append((named[order] & ~np.uint64(1)) | (key[owner[order]] & 1).astype(np.uint64))
        owners.append(owner[order])
    owner = np.concatenate(owners)
    by_owner = np.argsort(owner, kind="stable")
    return np.concatenate(found)[by_owner].view(np.int64), np.bincount(owner, minlength=rows)


def _shares(values: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
    """The signatures of each text in columns: each value has its column."""
    share, row = (values.view(np.uint64) >> np.uint64(1)) % np.uint64(SHARES), np.repeat(np.arange(len(counts)), counts)
    out = []
    for k in range(SHARES):
        mine = share == k
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row[mine], minlength=len(counts)))]).astype(np.int32)
        out.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values[mine])))
    return out


def _described(docs: DataFrame, shingle: int, threshold: tuple[int, int]) -> DataFrame:
    """doc_id, n, f1, f2, the sketch of each text and the columns s0, s1, ... of its signatures."""
    columns = [f"s{k}" for k in range(SHARES)]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=SLICE):
            sets = shingle_sets(texts(part.column("text")), shingle)
            prints = [fingerprint(s) for s in sets]
            yield pa.record_batch(
                [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([f[0] for f in prints], pa.int64()),
                    pa.array([f[1] for f in prints], pa.int64()),
                    pa.array([_sketch(s) for s in sets], pa.binary()),
                    *_shares(*signatures(sets, threshold)),
                ],
                names=["doc_id", "n", "f1", "f2", "sketch", *columns],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    signed = ", ".join(f"{s} array<long>" for s in columns)
    return rows.mapInArrow(describe, f"doc_id {kind}, n long, f1 long, f2 long, sketch binary, {signed}")


def _groups(described: DataFrame) -> DataFrame:
    """(g, u, n): the signatures that more than one class has, with their classes."""
    c = F.col
    found = []
    for k in range(SHARES):
        rows = described.where("n > 0").select(F.explode(f"s{k}").alias("g"), c("f1").alias("u"), "n")
        # A window has both in one shuffle; counts that are joined back take a second one of all signatures.
        same = Window.partitionBy("g")
        shared = rows.withColumns({"a": F.min("u").over(same), "b": F.max("u").over(same)}).where(c("a") != c("b"))
        found.append(kept(shared.select("g", "u", "n").distinct(), "jaccard-groups"))
    return reduce(DataFrame.union, found)


def _verified(pairs: DataFrame, docs: DataFrame, wanted: DataFrame, whole: int, shingle: int, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) whose sets are linked. wanted: u, first_id and n of their classes; whole: the tokens of all documents.

    Sets are large beside pairs, so only those of pairs are made, and in as many passes as keep the tokens of one pass a
    part of the input, however many pairs there are. What a pass leaves on disk goes before the next one.
    """
    a, b = threshold
    c = F.col
    size = wanted.select("u", "n")
    met = pairs.join(size, "u").join(size.select(c("u").alias("v"), c("n").alias("m")), "v")
    carried = met.agg(F.sum(c("n") + c("m"))).first()[0]
    if not carried:
        return pairs.select("u", "v")
    passes, found = -(-carried // max(PASS_TOKENS, whole // PASS_SHARE)), []
    for turn in range(passes):
        some = pairs.where(F.pmod(F.xxhash64("u"), F.lit(passes)) == turn)
        ends = some.select("u").union(some.select("v")).distinct()
        with noted() as paths:
            tokens = _tokens_of(docs, kept(wanted.join(ends, "u", "left_semi").select("u", "first_id"), "jaccard-wanted"), shingle)
        linked = (
            some.join(tokens, "u")
            .join(tokens.select(c("u").alias("v"), c("toks").alias("other")), "v")
            .withColumn("both", F.size(F.array_intersect("toks", "other")))
            .where(b * c("both") >= a * (F.size("toks") + F.size("other") - c("both")))
        )
        found.append(kept(linked.select("u", "v"), "jaccard-verified"))
        remove(pairs.sparkSession, paths)
    return reduce(DataFrame.union, found)


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (g, u, n) of groups that links leave in more than one component, with their component as label."""
    c = F.col
    ends = links.select(c("u").alias("node")).union(links.select(c("v").alias("node"))).distinct()
    parts = kept(connected_components(ends, links.select(c("u").alias("a"), c("v").alias("b"))), "jaccard-parts")
    marked = rows.join(parts.select(c("node").alias("u"), "component"), "u", "left").withColumn("label", F.coalesce("component", "u")).drop("component")
    mixed = marked.groupBy("g").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).where(c("l1") != c("l2"))
    return kept(marked.join(mixed.select("g"), "g", "left_semi"), "jaccard-mixed")


def _lists(arrays: list[np.ndarray], kind: type = np.int64) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def _long_enough(n: str, m: str, threshold: tuple[int, int]):
    a, b = threshold
    return b * F.least(n, m) >= a * F.greatest(n, m)


def _sketch(tokens: np.ndarray) -> bytes:
    cell = (mix(tokens ^ np.uint64(DEAL)) % np.uint64(CELLS)).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=CELLS), 127).astype(np.int8).tobytes()


def _near_in_groups(rows: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs (u, v) of different labels in groups (g, u, label, n, sketch) that sizes and sketches allow to be linked.

    Rows come sorted by group, each is compared with the ones behind it in arrays, and other pairs never become rows.
    A task holds one batch and the group that goes on from the one before; groups have `SMALL` members at most.
    """
    a, b = threshold

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not part.num_rows:
                continue
            g, u, label, n = (part[k].to_numpy().astype(np.int64) for k in ("g", "u", "label", "n"))
            counts = np.frombuffer(b"".join(part["sketch"].to_pylist()), np.int8).reshape(len(g), CELLS)
            new = len(g) - batch.num_rows
            for step in range(1, SMALL):
                j = np.arange(max(step, new), len(g))
                i = j - step
                some = (g[i] == g[j]) & (label[i] != label[j]) & (b * np.minimum(n[i], n[j]) >= a * np.maximum(n[i], n[j]))
                i, j = i[some], j[some]
                for at in range(0, len(i), 8_192):
                    x, y = i[at : at + 8_192], j[at : at + 8_192]
                    apart = np.abs(counts[x].astype(np.int16) - counts[y]).sum(axis=1, dtype=np.int64)
                    near = (a + b) * apart <= (b - a) * (n[x] + n[y])
                    x, y = u[x[near]], u[y[near]]
                    if len(x):
                        yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["u", "v"])
            held = part.slice(int(np.searchsorted(g, g[-1])))

    return rows.select("g", "u", "label", "n", "sketch").repartition("g").sortWithinPartitions("g").mapInArrow(compare, "u long, v long")


def _near_in_blocks(rows: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The same for groups of any size: two blocks of a group meet in a task, which holds no more of it."""
    a, b = threshold
    c = F.col
    last = F.ceil(F.count(F.lit(1)) / BLOCK).cast("int") - 1
    dealt = rows.join(rows.groupBy("g").agg(last.alias("last")), "g").withColumn("own", F.pmod(F.xxhash64("u"), c("last") + 1).cast("int"))
    sent = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), c("last")))).withColumns(
        {"one": F.least("own", "other"), "two": F.greatest("own", "other")}
    )

    def compare(part: pa.Table) -> pa.Table:
        own, u, label, n = (part[k].to_numpy().astype(np.int64) for k in ("own", "u", "label", "n"))
        counts = np.frombuffer(b"".join(part["sketch"].to_pylist()), np.int8).reshape(len(u), CELLS).astype(np.int16)
        pairs = []
        ones, twos = (np.flatnonzero(own == part[k][0].as_py()) for k in ("one", "two"))
        few = np.ascontiguousarray(counts[:, : CELLS // 4])
        for x in ones:
            y = twos[(label[twos] != label[x]) & (b * np.minimum(n[twos], n[x]) >= a * np.maximum(n[twos], n[x]))]
            for cells in (few, counts):
                apart = np.abs(cells[y] - cells[x]).sum(axis=1, dtype=np.int64)
                y = y[(a + b) * apart <= (b - a) * (n[x] + n[y])]
            pairs.append((np.full(len(y), u[x]), u[y]))
        x, y = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table({"u": np.minimum(x, y), "v": np.maximum(x, y)})

    return sent.select("g", "one", "two", "own", "u", "label", "n", "sketch").groupBy("g", "one", "two").applyInArrow(compare, "u long, v long")


def _possible(pairs: DataFrame, sketches: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) that their sketches allow to be linked."""
    a, b = threshold

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.int8).reshape(-1, CELLS) for k in ("sketch", "other"))
            apart = np.abs(left.astype(np.int16) - right).sum(axis=1, dtype=np.int64)
            both = batch.column("n").to_numpy().astype(np.int64) + batch.column("m").to_numpy()
            yield batch.select(["u", "v"]).filter(pa.array((a + b) * apart <= (b - a) * both))

    c = F.col
    joined = pairs.join(sketches, "u").join(sketches.select(c("u").alias("v"), c("n").alias("m"), c("sketch").alias("other")), "v")
    return joined.select("u", "v", "n", "m", "sketch", "other").mapInArrow(near, "u long, v long")


def jaccard_components(docs: DataFrame, *, shingle: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of `docs` at b * |A & B| >= a * |A | B|, (a, b) the threshold.

    A and B are sets of `shingle` words in a row.
    Texts with equal sets form a class. Classes that share a signature form a group (`signatures`); one member of each is compared
    with the others, on whole sets, and the components of the links found so far decide which groups still have members to
    compare. What is left after some rounds is joined to families, whose members of different components are compared by
    sketches, in arrays and block by block; only pairs that a sketch allows become rows and are verified. component_id is the
    smallest doc_id reachable; null ids count as none. Null, empty and word-free texts have no shingle and are linked with nothing; equal rows
    stay separate and share a component; an empty table gives an empty result.
    """
    c = F.col
    a, b = threshold
    if not 0 < a < b:
        raise ValueError("threshold is a / b with 0 < a < b")
    docs = docs.select("doc_id", "text")
    with noted() as signed_paths:
        signed = kept(_described(docs, shingle, threshold), "jaccard-signatures")
    described = kept(signed.select("doc_id", "n", "f1", "f2"), "jaccard-documents")
    sets = kept(
        described.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("first_id")).withColumnRenamed("f1", "u"),
        "jaccard-classes",
    )
    held = _groups(signed)
    needed = kept(sets.select("u", "first_id", "n").join(held.select("u").distinct(), "u"), "jaccard-needed")
    # All rows of a class have one sketch.
    sketches = signed.select(c("f1").alias("u"), "n", "sketch").join(needed.select("u"), "u").dropDuplicates(["u"])
    sketches = kept(sketches, "jaccard-sketches")
    # From here on the signatures are only disk.
    remove(docs.sparkSession, signed_paths)
    whole = described.agg(F.sum("n")).first()[0] or 0
    left = held.withColumn("label", c("u"))
    links = needed.select("u", c("u").alias("v")).limit(0)
    for turn in range(ROUNDS):
        # The same few classes come first in most of their groups, so a pair comes up in many groups and is compared once.
        first = left.groupBy("g").agg(F.min(F.struct(F.xxhash64("u", F.lit(turn)).alias("h"), "u", "n", "label")).alias("p"))
        met = kept(left.join(first, "g").where(c("u") != c("p.u")), "jaccard-met")
        pairs = met.where((c("label") != c("p.label")) & _long_enough("n", "p.n", threshold))
        pairs = pairs.select(F.least("u", "p.u").alias("u"), F.greatest("u", "p.u").alias("v")).distinct()
        pairs = kept(_possible(pairs, sketches, threshold), "jaccard-pairs")
        links = kept(links.union(_verified(pairs, docs, needed, whole, shingle, threshold)), "jaccard-links")
        # The first one is through with its group.
        left = _labelled(met.select("g", "u", "n"), links)

    # A family holds the members of the groups left in one band, as far as they hang together.
    nodes = left.select("g", "u", "label", F.xxhash64("u", c("g").bitwiseAND(F.lit(1))).alias("node"))
    hot = kept(nodes.join(nodes.groupBy("g").agg(F.min("node").alias("lowest")), "g").select("node", "u", "label", "lowest").distinct(), "jaccard-hot")
    members = hot.select("node", "u", "label").distinct()
    family_of = kept(connected_components(members, hot.select(c("node").alias("a"), c("lowest").alias("b"))), "jaccard-families")
    families = family_of.select("u", "label", c("component").alias("g")).join(sketches, "u")
    families = kept(families.join(family_of.groupBy(c("component").alias("g")).agg(F.count(F.lit(1)).alias("size")), "g"), "jaccard-sketches")
    candidates = _near_in_groups(families.where(c("size") <= SMALL), threshold).union(_near_in_blocks(families.where(c("size") > SMALL), threshold))
    candidates = kept(candidates.distinct(), "jaccard-candidates")
    links = kept(links.union(_verified(candidates, docs, needed, whole, shingle, threshold)).distinct(), "jaccard-links")
    ends = links.select(c("u").alias("node")).union(links.select(c("v").alias("node"))).distinct()
    component = connected_components(ends, links.select(c("u").alias("a"), c("v").alias("b")))
    named = sets.select("u", "f2", "first_id").join(component.withColumnRenamed("node", "u"), "u", "left")
    named = named.withColumn("component", F.coalesce("component", "u"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_class = named.join(smallest, "component").select(c("u").alias("f1"), "f2", "component_id")
    return (
        described.select("doc_id", "n", "f1", "f2")
        .join(of_class, ["f1", "f2"], "left")
        .select(
            "doc_id",
            c("n").alias("n_shingles"),
            F.when(c("n") > 0, c("component_id")).otherwise(c("doc_id")).alias("component_id"),
        )
    )


def _perhaps(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id may be a first_id of `wanted`, all that are and few others.

    A map of bits set by the hashes of the wanted ids goes to all tasks. It has one size, so it sifts less the more ids
    there are, and no wanted row is ever lost: the join behind it decides.
    """

    def placed(rows: DataFrame, key: str) -> DataFrame:
        bit = F.pmod(F.xxhash64(key), F.lit(BITS))
        return rows.withColumns(
            {"__row": F.floor(bit / (64 * ROW_WORDS)), "__word": (F.floor(bit / 64) % ROW_WORDS).cast("int"), "__bit": (bit % 64).cast("int")}
        )

    words = placed(wanted.select("first_id"), "first_id").groupBy("__row", "__word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__mask"))
    packed = words.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("__word", "__mask"))).alias("__masks")).select(
        "__row", F.transform(F.sequence(F.lit(0), F.lit(ROW_WORDS - 1)), lambda i: F.coalesce(F.try_element_at("__masks", i), F.lit(0).cast("long"))).alias("__masks")
    )
    asked = placed(docs, "doc_id").join(F.broadcast(packed), "__row")
    return asked.where(F.expr("getbit(get(__masks, __word), __bit) = 1")).select(*docs.columns)


def _tokens_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """u and the sorted tokens of one text of each wanted class (u, first_id)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=SLICE):
            sets = shingle_sets(texts(part.column("text")), shingle)
            asked = part.column("u").to_pylist()
            same = [i for i, s in enumerate(sets) if fingerprint(s)[0] == asked[i]]
            yield pa.record_batch([pa.array([asked[i] for i in same], pa.int64()), _lists([sets[i].view(np.int64) for i in same])], names=["u", "toks"])

    # Texts are large: without the sieve all of them would be shuffled to meet the few wanted ids.
    some = _perhaps(docs, wanted)
    asked = some.join(wanted, some["doc_id"].eqNullSafe(wanted["first_id"])).select("u", text_or_empty().alias("text"))
    tokens = kept(asked.mapInArrow(read, "u long, toks array<long>"), "jaccard-tokens")
    # Only an id that several rows have gives a class twice; then the sets are shuffled once more.
    if tokens.groupBy("u").count().where("count > 1").isEmpty():
        return tokens
    return kept(tokens.dropDuplicates(["u"]), "jaccard-tokens")


def nearest_kept(docs: DataFrame, components: DataFrame) -> DataFrame:
    """Of each component the row with the smallest id; of equal ids one row; rows without an id all stay."""
    chosen = components.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.where(F.col("doc_id").isNotNull()).join(chosen, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where(F.col("doc_id").isNull()))

