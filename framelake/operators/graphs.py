"""Connected components, region statistics and graph features."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.geometry import touches_border
from framelake.functions.numeric import clip, ratio
from framelake.plans.boxes import with_cells
from framelake.plans.greedy import greedy_keep
from framelake.plans.quantiles import quantiles
from framelake.session import truncate_lineage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of its neighbourhood."""
    both = _both_ways(edges)
    low = both.groupBy("a").agg(F.min("b").alias("__m"))
    return (
        both.join(low, "a")
        .filter(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.least("a", "__m").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("__m"))
    ties = down.join(low, "a").filter(F.col("b") != F.col("__m")).select(F.col("b").alias("a"), F.col("__m").alias("b"))
    return ties.unionByName(low.select("a", F.col("__m").alias("b"))).distinct()


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds ``component``, the smallest node reachable (nodes: node; edges: a, b of the same type).

    Alternating star contraction: the number of rounds grows with the logarithm of the graph and not with
    its diameter, neighbourhoods are only ever reduced to their minimum, and a checkpoint ends each round.
    """
    links = truncate_lineage(edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct())

    def fingerprint(df: DataFrame) -> tuple:
        row = df.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        return row["n"], row["h"]

    before = fingerprint(links)
    while before[0]:
        links = truncate_lineage(_small_star(_large_star(links)))
        now = fingerprint(links)
        if now == before:
            break
        before = now
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))


#: Sides of a tile whose cells are labelled in one array, and edges of a block that are contracted in one.
TILE, EDGES = 64, 65_536


def _smallest(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node reachable of each of the nodes 0, 1, ... over the edges a, b."""
    root = np.arange(size)
    while (root[a] != root[b]).any():
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
    return root


def _contracted(edges: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Edges (keys, a, b) as rows (keys, node, root, whole): a block's nodes with the smallest they reach in it; whole: the key has one block."""
    last = F.ceil(F.count(F.lit(1)) / block).cast("int") - 1
    dealt = edges.select(*keys, "a", "b").join(edges.groupBy(*keys).agg(last.alias("__last")), keys)
    dealt = dealt.withColumn("__i", F.pmod(F.xxhash64("a", "b"), F.col("__last") + 1).cast("int"))

    def contract(part: pa.Table) -> pa.Table:
        a, b = (part[n].to_numpy() for n in "ab")
        node, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = _smallest(len(node), place[: len(a)], place[len(a) :])
        repeated = pa.array(np.zeros(len(node), np.int64))
        kind = part.schema.field("a").type
        columns = {"node": pa.array(node, kind), "root": pa.array(node[root], kind), "whole": pa.array(np.full(len(node), part["__last"][0].as_py() == 0))}
        return pa.table({**{k: part[k].take(repeated) for k in keys}, **columns})

    ddl, kind = ", ".join(f"`{k}` {edges.schema[k].dataType.simpleString()}" for k in keys), edges.schema["a"].dataType.simpleString()
    return dealt.groupBy(*keys, "__i").applyInArrow(contract, f"{ddl}, node {kind}, root {kind}, whole boolean")


def components_in_groups(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], *, block: int = EDGES) -> DataFrame:
    """Adds ``component``, the smallest node reachable, where no edge leaves its key (nodes: keys, node; edges: keys, a, b).

    A key's edges are contracted block by block; only what is left of keys of several blocks goes through the rounds.
    """
    keys, c = list(keys), F.col
    stars = truncate_lineage(_contracted(edges, keys, block))

    def tagged(n: str) -> Column:
        return F.struct(*keys, c(n).alias("node"))

    rest = stars.filter(~c("whole"))
    joined = connected_components(rest.select(tagged("node").alias("node")).distinct(), rest.select(tagged("node").alias("a"), tagged("root").alias("b")))
    roots = stars.filter("whole").select(*keys, "node", c("root").alias("component")).unionByName(
        joined.select("node.*", c("component.node").alias("component"))
    )
    return nodes.join(roots, [*keys, "node"], "left").withColumn("component", F.coalesce("component", "node"))


def grid_components(cells: DataFrame, keys: Sequence[str], *, diagonal: bool = False, tile: int = TILE) -> DataFrame:
    """Components of occupied cells (keys, u, v) of each grid; the smallest (keys, v, u) names one.

    Cells are labelled inside tiles, each in one array; only the labels that meet at a tile's edge go through the rounds.
    """
    keys, c = list(keys), F.col
    offsets = [(1, 0), (0, 1), *([(1, 1), (-1, 1)] if diagonal else [])]
    placed = cells.select(*keys, "u", "v", F.floor(c("u") / tile).alias("__tu"), F.floor(c("v") / tile).alias("__tv"))

    def label(part: pa.Table) -> pa.Table:
        u, v = (part[n].to_numpy().astype(np.int64) for n in "uv")
        # Places in row-major order, with a margin for neighbours that are none.
        place, row = np.unique((v % tile + 1) * (tile + 2) + u % tile + 1, return_inverse=True)
        index = np.full((tile + 2) ** 2, -1)
        index[place] = np.arange(len(place))
        a, b = [], []
        for du, dv in offsets:
            seen = index[place + dv * (tile + 2) + du]
            a.append(np.flatnonzero(seen >= 0))
            b.append(seen[seen >= 0])
        first = np.empty(len(place), np.int64)
        first[row] = np.arange(len(row))
        top = first[_smallest(len(place), np.concatenate(a), np.concatenate(b))][row]
        out = part.select([*keys, "u", "v"])
        return out.append_column("__u", out["u"].take(pa.array(top))).append_column("__v", out["v"].take(pa.array(top)))

    def ddl(names: Sequence[str], prefix: str = "") -> str:
        return ", ".join(f"`{prefix}{n}` {cells.schema[n].dataType.simpleString()}" for n in names)

    known = c("u").isNotNull() & c("v").isNotNull()
    local = placed.filter(known).groupBy(*keys, "__tu", "__tv").applyInArrow(label, f"{ddl([*keys, 'u', 'v'])}, {ddl(['u', 'v'], '__')}")
    local = truncate_lineage(local.withColumn("__root", F.struct(*keys, c("__v").alias("v"), c("__u").alias("u"))).drop("__u", "__v"))
    rim = local.filter((c("u") % tile).isin(0, tile - 1, -1, 1 - tile) | (c("v") % tile).isin(0, tile - 1, -1, 1 - tile))
    at = F.struct(*keys, c("v").cast("long").alias("v"), c("u").cast("long").alias("u"))
    steps = F.array(*[F.struct(*keys, (c("v") + dv).cast("long").alias("v"), (c("u") + du).cast("long").alias("u")) for du, dv in offsets])
    sent = rim.select(c("__root").alias("a"), F.explode(steps).alias("at"))
    edges = sent.join(rim.select(at.alias("at"), c("__root").alias("b")), "at").filter(c("a") != c("b")).select("a", "b").distinct()
    found = connected_components(edges.select(c("a").alias("node")).union(edges.select(c("b").alias("node"))).distinct(), edges)
    named = local.join(found.withColumnRenamed("node", "__root"), "__root", "left").withColumn("component", F.coalesce("component", "__root"))
    alone = cells.filter(~known).select(*keys, "v", "u", F.struct("v", "u").alias("component"))
    return named.select(*keys, "v", "u", F.struct(c("component.v").alias("v"), c("component.u").alias("u")).alias("component")).unionByName(alone)


def component_stats(
    pixels: DataFrame, keys: Sequence[str], *, width: int, height: int, margin: int = 3, medians_of: Sequence[str] = (), low_high: str | None = None
) -> DataFrame:
    """Area, box, fill ratio, border contact and medians of each component (keys, component, u, v)."""
    group = [*keys, "component"]
    base = pixels.groupBy(*group).agg(
        F.count(F.lit(1)).alias("area"), F.min("u").alias("x"), F.min("v").alias("y"),
        (F.max("u") - F.min("u") + 1).alias("w"), (F.max("v") - F.min("v") + 1).alias("h"),
        F.avg("u").alias("cx"), F.avg("v").alias("cy"),
    )
    c = F.col
    out = base.withColumns(
        {
            "fill_ratio": c("area") / F.greatest(c("w") * c("h"), F.lit(1)),
            "touches_border": touches_border(c("x"), c("y"), c("w"), c("h"), width, height, margin),
        }
    )
    for name in medians_of:
        out = out.join(quantiles(pixels, group, c(name), {f"median_{name}": 0.5}), group, "left")
    if low_high:
        out = out.join(quantiles(pixels, group, c(low_high), {"height_min": 0.05, "height_max": 0.95}), group, "left")
    return out


def area_gate(stats: DataFrame, *, smallest: float, largest: float, min_fill: float = 0.45) -> DataFrame:
    return stats.filter(F.col("area").between(smallest, largest) & (F.col("fill_ratio") >= min_fill))


def central_component(stats: DataFrame, keys: Sequence[str], *, width: int, height: int, smallest: float = 180, largest_share: float = 0.8, reject_border: bool = True) -> DataFrame:
    """Largest component near the image centre: area times max(.25, 1 - .55 x relative distance)."""
    cx, cy = width / 2.0, height / 2.0
    reach = max((cx**2 + cy**2) ** 0.5, 1.0)
    distance = F.hypot(F.col("cx") - cx, F.col("cy") - cy) / reach
    score = F.col("area") * F.greatest(F.lit(0.25), 1.0 - 0.55 * distance)
    fits = F.col("area").between(max(smallest, width * height * 0.0005), width * height * largest_share)
    if reject_border:
        fits = fits & ~F.col("touches_border")
    return stats.filter(fits).groupBy(*keys).agg(
        F.max_by(F.struct("component", score.alias("score")), F.struct(score, F.col("component"))).alias("b"),
        F.count(F.lit(1)).alias("candidates"),
    ).select(*keys, "b.component", "b.score", "candidates")


def graph_features(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sizes, degrees, components and independent cycles of each object's graph.

    nodes: keys, node; edges: keys, a, b, sources (array of strings).
    """
    keys = list(keys)
    real = edges.filter(F.col("a") != F.col("b"))
    degree = (
        real.select(*keys, F.explode(F.array("a", "b")).alias("node"))
        .groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("degree"))
    )
    per_node = nodes.select(*keys, "node").join(degree, [*keys, "node"], "left").na.fill(0, ["degree"])
    sizes = per_node.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("nodes"), F.max("degree").alias("degree_max"),
        ratio(F.count_if(F.col("degree") >= 3), F.count(F.lit(1))).alias("degree3_ratio"),
    )
    links = real.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("edges"),
        ratio(F.count_if(F.size("sources") > 1), F.count(F.lit(1))).alias("multi_source_ratio"),
        ratio(F.count_if(F.array_contains("sources", "SIDE_DEPTH_SUPPORTED")), F.count(F.lit(1))).alias("side_ratio"),
    )

    parts = components_in_groups(nodes.select(*keys, "node"), real, keys)
    pieces = parts.groupBy(*keys).agg(F.count_distinct("component").alias("components"))
    out = sizes.join(links, keys, "left").na.fill(0).join(pieces, keys, "left")
    return out.withColumn("cycles", F.greatest(F.lit(0), F.col("edges") - F.col("nodes") + F.col("components")))


ANGLE_BINS = ((0, 15), (15, 45), (45, 75), (75, 181))
JUNCTION = 0.08


def _pair_angles(one: np.ndarray, two: np.ndarray, same: bool) -> np.ndarray:
    """Count, sums of the angle and its square about 45 degrees, and bin counts, of all pairs of normals."""
    out = np.zeros(3 + len(ANGLE_BINS))
    for first in range(0, len(one), 64):
        begin = first if same else 0
        angle = np.degrees(np.arccos(np.clip(np.abs(one[first : first + 64] @ two[begin:].T), 0.0, 1.0)))
        angle = angle[np.triu(np.ones(angle.shape, bool), 1)] if same else angle.ravel()
        out[:3] += len(angle), (angle - 45.0).sum(), ((angle - 45.0) ** 2).sum()
        out[3:] += [np.count_nonzero((angle >= lo) & (angle < hi)) for lo, hi in ANGLE_BINS]
    return out


def _junctions(one: np.ndarray, two: np.ndarray, three: np.ndarray, same_left: bool, same_right: bool) -> int:
    """Triples of normals, one of each block, that span a volume; a block that comes twice gives each pair once."""
    total = 0
    for i, n in enumerate(one):
        crossed = np.cross(n, two)
        for first in range(i + 1 if same_left else 0, len(two), 64):
            found = np.abs(crossed[first : first + 64] @ three[first if same_right else 0 :].T) >= JUNCTION
            total += np.count_nonzero(np.triu(found, 1) if same_right else found)
    return total


def _group_features(faces: DataFrame, keys: list[str], shared: str, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Angles, degrees and triple junctions where all faces with one value of ``shared`` are adjacent.

    Pairs and triples are counted block by block and never become rows: a task holds at most three blocks of normals.
    """
    group = [*keys, shared]
    rows = faces.filter(F.col(shared).isNotNull()).select(*group, "face", "nx", "ny", "nz")
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    degree = sizes.filter("__n > 1").groupBy(*keys).agg((F.max("__n") - 1).alias("degree_max"))
    last = F.ceil(F.col("__n") / block).cast("int") - 1
    dealt = rows.join(sizes, group).filter("__n > 1").withColumn("__i", F.pmod(F.xxhash64("face"), last + 1).cast("int"))
    # Each set of three blocks (one may come twice or three times) is one task's work, and each of its blocks goes there once.
    dealt = dealt.withColumn("__j", F.explode(F.sequence(F.lit(0), last))).withColumn("__k", F.explode(F.sequence(F.col("__j"), last)))
    sent = dealt.withColumn("__t", F.array_sort(F.array("__i", "__j", "__k"))).select(*group, "__t", "__i", "nx", "ny", "nz")
    names = ["pairs", "angle", "square", *[f"bin_{i}" for i in range(len(ANGLE_BINS))]]

    def count(table: pa.Table) -> pa.Table:
        ids = table["__t"][0].as_py()
        normals = np.stack([table[n].to_numpy() for n in ("nx", "ny", "nz")], axis=1)
        place = table["__i"].to_numpy()
        one, two, three = (normals[place == i] for i in ids)
        angles = _pair_angles(one, two, ids[0] == ids[1]) if ids[1] == ids[2] else np.zeros(len(names))
        corners = _junctions(one, two, three, ids[0] == ids[1], ids[1] == ids[2])
        return pa.table({**{k: table[k].slice(0, 1) for k in keys}, **{n: [float(a)] for n, a in zip(names, angles)}, "corners": [corners]})

    ddl = ", ".join(f"`{k}` {faces.schema[k].dataType.simpleString()}" for k in keys)
    # Few bytes bring much work, so the partitions are counted here and not joined by their size.
    sent = sent.repartition(int(faces.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group, "__t")
    counted = sent.groupBy(*group, "__t").applyInArrow(count, f"{ddl}, {', '.join(f'{n} double' for n in names)}, corners bigint")
    summed = counted.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in (*names, "corners")])
    n, mean = F.col("pairs"), F.col("angle") / F.col("pairs")
    per_pair = summed.filter("pairs > 0").select(
        *keys, n.cast("bigint").alias("adjacent_pairs"), (mean + 45.0).alias("angle_mean"),
        F.sqrt(F.greatest(F.col("square") / n - mean * mean, F.lit(0.0))).alias("angle_std"),
        *[(F.col(f"bin_{i}") / n).alias(f"angle_bin_{i}") for i in range(len(ANGLE_BINS))],
    )
    return per_pair, degree, summed.filter("corners > 0").select(*keys, F.col("corners").alias("triple_junctions"))


def _edge_features(faces: DataFrame, adjacency: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Angles, degrees and triple junctions of given pairs of faces."""
    normal = faces.select(*keys, "face", F.struct("nx", "ny", "nz").alias("n"))

    def with_normal(df: DataFrame, column: str) -> DataFrame:
        return df.join(normal.select(*keys, F.col("face").alias(column), F.col("n").alias(f"n_{column}")), [*keys, column])

    pairs = with_normal(with_normal(adjacency.select(*keys, "a", "b"), "a"), "b")
    cosine = F.abs(F.col("n_a.nx") * F.col("n_b.nx") + F.col("n_a.ny") * F.col("n_b.ny") + F.col("n_a.nz") * F.col("n_b.nz"))
    angles = pairs.withColumn("angle", F.degrees(F.acos(clip(cosine, 0.0, 1.0))))
    per_pair = angles.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("adjacent_pairs"),
        F.avg("angle").alias("angle_mean"), F.stddev_pop("angle").alias("angle_std"),
        *[F.avg(((F.col("angle") >= lo) & (F.col("angle") < hi)).cast("double")).alias(f"angle_bin_{i}") for i, (lo, hi) in enumerate(ANGLE_BINS)],
    )
    degree = (
        adjacency.select(*keys, F.explode(F.array("a", "b")).alias("f")).groupBy(*keys, "f").agg(F.count(F.lit(1)).alias("d"))
        .groupBy(*keys).agg(F.max("d").alias("degree_max"))
    )
    ab = pairs.select(*keys, "a", "b", "n_a", "n_b")
    ac = pairs.select(*keys, "a", F.col("b").alias("c"), F.col("n_b").alias("n_c"))
    bc = adjacency.select(*keys, F.col("a").alias("b"), F.col("b").alias("c"))
    corners = ab.join(ac, [*keys, "a"]).filter(F.col("b") < F.col("c")).join(bc, [*keys, "b", "c"])

    def part(i: str, axis: str) -> Column:
        return F.col(f"n_{i}.n{axis}")

    det = (
        part("a", "x") * (part("b", "y") * part("c", "z") - part("b", "z") * part("c", "y"))
        - part("a", "y") * (part("b", "x") * part("c", "z") - part("b", "z") * part("c", "x"))
        + part("a", "z") * (part("b", "x") * part("c", "y") - part("b", "y") * part("c", "x"))
    )
    triples = corners.filter(F.abs(det) >= JUNCTION).groupBy(*keys).agg(F.count(F.lit(1)).alias("triple_junctions"))
    return per_pair, degree, triples


def face_features(faces: DataFrame, adjacency: DataFrame | str, keys: Sequence[str], *, block: int = 2_048) -> DataFrame:
    """Area shares, fit errors, adjacency, angle bins and triple junctions of visible faces.

    faces: keys, face, area, rmse, nx, ny, nz; adjacency: keys, a < b. Where adjacency is a column of the faces, those
    with equal values are adjacent; their pairs are not formed as rows.
    """
    from framelake.plans.scan import top_n_per_key

    keys = list(keys)
    base = faces.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("faces"), F.sum("area").alias("__area"), F.avg("rmse").alias("rmse_mean"), F.max("rmse").alias("rmse_max")
    )
    largest = top_n_per_key(faces.select(*keys, "face", "area"), keys, [F.desc("area"), F.asc("face")], 3, "__r")
    top = largest.groupBy(*keys).agg(*[F.max(F.when(F.col("__r") == i, F.col("area"))).alias(f"__a{i}") for i in (1, 2, 3)])
    counted = _group_features(faces, keys, adjacency, block) if isinstance(adjacency, str) else _edge_features(faces, adjacency, keys)
    per_pair, degree, triples = counted
    joined = base.join(top, keys, "left").join(per_pair, keys, "left").join(degree, keys, "left").join(triples, keys, "left")
    whole = F.greatest(F.col("__area").cast("double"), F.lit(1.0))
    return joined.select(
        *keys, "faces", *[(F.coalesce(f"__a{i}", F.lit(0)) / whole).alias(f"area_share_{i}") for i in (1, 2, 3)],
        "rmse_mean", "rmse_max",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("adjacent_pairs", "degree_max", "triple_junctions")],
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("angle_mean", "angle_std", *[f"angle_bin_{i}" for i in range(4)])],
    )


def _cells3(df: DataFrame, prefix: str, size: float, grow: bool) -> DataFrame:
    out = df
    for axis, cell in zip("xyz", ("cu", "cv", "cw")):
        place = F.floor(F.col(f"{prefix}{axis}") / size)
        out = out.withColumn(cell, F.explode(F.array(place - 1, place, place + 1)) if grow else place)
    return out


def _nearest_anchors(placed: DataFrame, anchors: DataFrame, keys: list[str], merge: float, block: int) -> DataFrame:
    """keys, node, target: the nearest anchor each node reaches; of equal ones an existing one, then the smallest.

    A cell's nodes meet its anchors in arrays, and pairs never become rows; a task holds one block of a cell's anchors.
    """
    cell = [*keys, "cu", "cv", "cw"]
    for name in cell:
        placed, anchors = placed.filter(F.col(name).isNotNull()), anchors.filter(F.col(name).isNotNull())
    sizes = anchors.groupBy(*cell).agg((F.ceil(F.count(F.lit(1)) / block).cast("int") - 1).alias("__last"))
    near = anchors.join(sizes, cell).withColumn("__i", F.pmod(F.xxhash64("k_node"), F.col("__last") + 1).cast("int")).drop("__last")
    spots = placed.join(sizes, cell).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__last")))).drop("__last")
    # Cells without a node have nothing to compare. Both sides descend from the same tables, so their columns are named anew.
    near = near.join(placed.select(*cell).distinct(), cell, "left_semi")
    spots, near = (df.select(*[F.col(n).alias(n) for n in df.columns]) for df in (spots, near))

    def meet(spots: pa.Table, near: pa.Table) -> pa.Table:
        near = near.sort_by([("late", "ascending"), ("k_node", "ascending")])
        late, names = near["late"].to_numpy(), near["k_node"].to_numpy()
        nodes = spots["node"].to_numpy()
        ends = [near[f"k_{n}"].to_numpy() for n in "xyz"]
        own = [spots[n].to_numpy() for n in "xyz"]
        best, gaps = np.zeros(len(nodes), np.int64), np.full(len(nodes), np.inf)
        step = max(1, 2**18 // max(len(names), 1))
        for at in range(0, len(nodes) if len(names) else 0, step):
            some = slice(at, at + step)
            x, y, z = ((o[some, None] - e) ** 2 for o, e in zip(own, ends))
            gap = np.sqrt(x + y + z)
            gap[~((gap <= merge) & (~late | (names <= nodes[some, None])))] = np.inf
            # The first of equal gaps comes first in the order of the anchors.
            best[some] = gap.argmin(axis=1)
            gaps[some] = gap.min(axis=1)
        kept = np.flatnonzero(gaps < np.inf)
        chosen = near.take(pa.array(best[kept]))
        out = spots.select([*keys, "node"]).take(pa.array(kept)).append_column("__g", pa.array(gaps[kept]))
        return out.append_column("late", chosen["late"]).append_column("k_node", chosen["k_node"])

    ddl = ", ".join(f"`{k}` {placed.schema[k].dataType.simpleString()}" for k in [*keys, "node"])
    found = spots.groupBy(*cell, "__i").cogroup(near.groupBy(*cell, "__i")).applyInArrow(meet, f"{ddl}, __g double, late boolean, k_node bigint")
    return found.groupBy(*keys, "node").agg(F.min_by("k_node", F.struct("__g", "late", "k_node")).alias("target"))


def augment_graph(nodes: DataFrame, added: DataFrame, edges: DataFrame, new_edges: DataFrame, keys: Sequence[str], *, merge: float = 2.0, block: int = 65_536) -> tuple[DataFrame, DataFrame]:
    """Adds measured nodes and edges to a graph; a node closer than ``merge`` to one is that node.

    nodes and added: keys, node (bigint, unique over both), x, y, z, sources. A new node joins the nearest
    node that exists when its turn comes (existing ones and new ones kept before it, in node order).
    Returns nodes with joined sources and degrees, and edges (keys, a, b, sources).
    """
    keys = list(keys)
    near = _cells3(nodes.select(*keys, *[F.col(c).alias(f"k_{c}") for c in ("node", "x", "y", "z")]), "k_", merge, True)

    def gap(a: str = "", b: str = "k_") -> Column:
        return F.sqrt(sum(((F.col(f"{a}{c}") - F.col(f"{b}{c}")) ** 2 for c in "yz"), (F.col(f"{a}x") - F.col(f"{b}x")) ** 2))

    def apart(rows: DataFrame, kept: DataFrame) -> DataFrame:
        placed = _cells3(rows, "", merge, False)
        spread = _cells3(kept.select(*keys, *[F.col(c).alias(f"k_{c}") for c in ("node", "x", "y", "z")]), "k_", merge, True)
        condition = gap() <= merge
        for k in [*keys, "cu", "cv", "cw"]:
            condition = condition & (placed[k] == spread[k])
        return placed.join(spread, condition, "left_anti").drop("cu", "cv", "cw")

    def decide(pdf):
        import numpy as np
        import pandas as pd

        points, kept, mask = pdf[["x", "y", "z"]].to_numpy(float), [], []
        for i, p in enumerate(points):
            free = not kept or np.linalg.norm(points[kept] - p, axis=1).min() > merge
            mask.append(free)
            if free:
                kept.append(i)
        return pd.Series(mask)

    fresh = apart(added.select(*keys, "node", "x", "y", "z"), nodes.select(*keys, "node", "x", "y", "z"))
    kept = greedy_keep(fresh, keys, "node", [F.asc("node")], decide, apart).drop("kept_rank")
    anchors = near.withColumn("late", F.lit(False)).unionByName(
        _cells3(kept.select(*keys, *[F.col(c).alias(f"k_{c}") for c in ("node", "x", "y", "z")]), "k_", merge, True).withColumn("late", F.lit(True))
    )
    placed = _cells3(added.select(*keys, "node", "x", "y", "z"), "", merge, False)
    mapping = _nearest_anchors(placed, anchors, keys, merge, block)
    mapped = added.join(mapping, [*keys, "node"]).select(*keys, F.col("target").alias("node"), "sources")
    positions = nodes.select(*keys, "node", "x", "y", "z").unionByName(kept.select(*keys, "node", "x", "y", "z"))
    sources = (
        nodes.select(*keys, "node", "sources").unionByName(mapped)
        .select(*keys, "node", F.explode("sources").alias("s")).groupBy(*keys, "node").agg(F.array_sort(F.collect_set("s")).alias("sources"))
    )
    to_a = mapping.select(*keys, F.col("node").alias("a"), F.col("target").alias("ta"))
    to_b = mapping.select(*keys, F.col("node").alias("b"), F.col("target").alias("tb"))
    moved = new_edges.join(to_a, [*keys, "a"]).join(to_b, [*keys, "b"]).select(
        *keys, F.col("ta").alias("a"), F.col("tb").alias("b"), "sources"
    )
    merged = (
        edges.select(*keys, "a", "b", "sources").unionByName(moved).filter(F.col("a") != F.col("b"))
        .select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.explode("sources").alias("s"))
        .groupBy(*keys, "a", "b").agg(F.array_sort(F.collect_set("s")).alias("sources"))
    )
    degree = merged.select(*keys, F.explode(F.array("a", "b")).alias("node")).groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("degree"))
    out = positions.join(sources, [*keys, "node"], "left").join(degree, [*keys, "node"], "left").na.fill(0, ["degree"])
    return out, merged
