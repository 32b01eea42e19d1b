"""Standardisation, nearest exemplars and acceptance by distance and margin."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.numeric import truth
from framelake.plans.quantiles import histogram_cell, quantiles
from framelake.plans.scan import ordinal

#: Exemplars compared at once in a task, unless a caller says otherwise.
BLOCK_ROWS = 1_024
#: Rows of a block that travels to a task.
SENT_ROWS = 65_536
#: Blocks of queries that small inputs are dealt into.
SPREAD = 16
#: Rows of a tile that stays in a core's cache, and queries it meets at a time.
TILE_ROWS, SLICE_ROWS = 1_024, 64
#: Queries, vectors and bins of a dimension whose distances are bounded by one matrix product, from this many vectors on, and vectors that
#: a query without any distance is compared with first, beyond those asked for.
BOUND_QUERIES, BOUND_ROWS, BOUND_FROM, SEEDS = 4_096, 2_048, 512, 5
#: Edges of the bins in standard deviations.
BIN_EDGES = np.array([-2.49, -1.31, -0.6, 0.0, 0.6, 1.31, 2.49])
#: Pairs whose distances are taken at a time, while their differences stay in a core's cache.
TAKEN_ROWS = 2_048

_DISTANCES = pa.list_(pa.field("element", pa.float64()))


def long_vectors(df: DataFrame, keys: Sequence[str], vector: str = "v") -> DataFrame:
    return df.select(*keys, F.posexplode(vector).alias("dim", "x"))


def fit_standardizer(df: DataFrame, keys: Sequence[str] = (), *, vector: str = "v", floor: float = 1e-4, replacement: float | None = 1.0) -> DataFrame:
    """Mean and population deviation of each dimension.

    Deviations below ``floor`` become ``replacement``, or the floor itself where that is null.
    """
    sd = F.stddev_pop("x")
    scale = F.when(sd < floor, F.lit(floor if replacement is None else replacement)).otherwise(sd)
    return long_vectors(df, keys, vector).groupBy(*keys, "dim").agg(F.avg("x").alias("mean"), scale.alias("scale"))


def scale_arrays(standard: DataFrame, keys: Sequence[str] = (), *, weights: Sequence[float] | None = None) -> DataFrame:
    """One row per key with the mean and scale as arrays; weights (mean one) are folded into the scale."""
    scale = F.col("scale")
    if weights is not None:
        mean = sum(weights) / len(weights)
        scale = scale / F.get(F.array(*[F.lit(float(w) / mean) for w in weights]), F.col("dim"))
    rows = standard.withColumn("__s", scale)
    packed = F.array_sort(F.collect_list(F.struct("dim", "mean", F.col("__s").alias("scale"))))
    return rows.groupBy(*keys).agg(packed.alias("__p")).select(
        *keys, F.transform("__p", lambda e: e["mean"]).alias("mean"), F.transform("__p", lambda e: e["scale"]).alias("scale")
    )


def standardize(vector: Column, mean: Column, scale: Column) -> Column:
    centred = F.zip_with(vector, mean, lambda x, m: x - m)
    return F.zip_with(centred, scale, lambda x, s: x / s)


def unstandardize(vector: Column, mean: Column, scale: Column) -> Column:
    return F.zip_with(F.zip_with(vector, scale, lambda x, s: x * s), mean, lambda x, m: x + m)


def with_standard(df: DataFrame, arrays: DataFrame, *, vector: str = "v", out: str = "z") -> DataFrame:
    # One row by construction, so sending it everywhere is safe at any size of the other side.
    joined = df.withColumn("__one", F.lit(1)).join(F.broadcast(arrays.withColumn("__one", F.lit(1))), "__one")
    return joined.withColumn(out, standardize(F.col(vector), F.col("mean"), F.col("scale"))).drop("__one", "mean", "scale")


def class_centroids(df: DataFrame, label: str = "label", vector: str = "z") -> DataFrame:
    return long_vectors(df, [label], vector).groupBy(label, "dim").agg(F.avg("x").alias("x"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    lengths = pc.unique(pc.list_value_length(column))
    if len(lengths) != 1 or not lengths[0].is_valid:
        raise ValueError("vectors must have one length and not be null")
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _dimension_weights(metric: str, dims: int, groups: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """What each dimension's absolute (l1) or squared difference counts in the distance (its square)."""
    if metric == "l1" or groups is None:
        return np.full(dims, 1.0 / dims)
    out = np.zeros(dims)
    for g, w in enumerate(groups[1]):
        own = groups[0] == g
        if own.any():
            out[own] = w / own.sum()
    return out / max(groups[1].sum(), 1e-6)


def _smallest(points: np.ndarray, factors: np.ndarray, vectors: np.ndarray, ends: np.ndarray, metric: str, k: int, tile: int, own: np.ndarray | None, tags: np.ndarray | None) -> np.ndarray:
    """The k smallest distances (class, weighting, query, rank) to the vectors, which are ordered by class and end there.

    factors: what a dimension counts, for each query (or one for all) and weighting. Tiles of vectors meet slices of queries, so
    memory holds one tile of differences, one slice of distances and the smallest so far.
    """
    weightings, starts = factors.shape[2], np.concatenate([[0], ends[:-1]])
    best = np.full((len(ends), weightings, len(points), k), np.inf)
    tile = min(tile, TILE_ROWS, len(vectors))
    buffer, found = np.empty((tile, vectors.shape[1])), np.empty((weightings, SLICE_ROWS, tile))
    for first in range(0, len(vectors), tile):
        part = vectors[first : first + tile]
        delta = buffer[: len(part)]
        classes = range(np.searchsorted(ends, first, "right"), np.searchsorted(starts, first + len(part), "left"))
        for at in range(0, len(points), SLICE_ROWS):
            some = points[at : at + SLICE_ROWS]
            here = found[:, : len(some), : len(part)]
            for i, point in enumerate(some):
                np.subtract(part, point, out=delta)
                np.abs(delta, out=delta) if metric == "l1" else np.multiply(delta, delta, out=delta)
                here[:, i] = (delta @ factors[min(at + i, len(factors) - 1)]).T
            if tags is not None:
                here[:, own[at : at + len(some), None] == tags[None, first : first + len(part)]] = np.inf
            for c in classes:
                mine = here[:, :, max(starts[c] - first, 0) : ends[c] - first]
                known = best[c, :, at : at + len(some)]
                both = np.concatenate([known, np.partition(mine, k - 1, axis=2)[:, :, :k] if mine.shape[2] > k else mine], axis=2)
                known[:] = np.sort(both, axis=2)[:, :, :k]
    return best if metric == "l1" else np.sqrt(best)


def _bound_features(x: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features whose product is what two vectors have in common above the lowest edge, or more, and each vector's sum above it.

    A vector fills the bins below its value; in the bin with both values a and b (shares of it) a b + 1/4 stands for the smaller one.
    """
    width = np.diff(edges, axis=0)
    share = x[:, None, :] - edges[None, :-1]
    share /= np.where(width > 0, width, 1.0)
    np.clip(share, 0.0, 1.0, out=share)
    size, root = share[0].size, np.sqrt(width)
    out = np.empty((len(x), 2 * size + 1), np.float32)
    out[:, :size] = (share * root).reshape(len(x), -1)
    out[:, size:-1] = (((share > 0) & (share < 1)) * (root / 2)).reshape(len(x), -1)
    return out, np.einsum("itd,td->i", share, width)


def _smallest_bounded(points: np.ndarray, factors: np.ndarray, vectors: np.ndarray, ends: np.ndarray, k: int, tile: int, own: np.ndarray | None, tags: np.ndarray | None) -> np.ndarray:
    """`_smallest` for l1: a matrix product bounds the distances of many pairs from below, and only those that may be among the k smallest are taken.

    With values held within the outer edges |x - y| is x + y - 2 min(x, y) or more, and the product is no less than the sum of the
    minima, so no pair is lost. Where queries have factors of their own, the smallest of each dimension bounds all of them.
    """
    starts = np.concatenate([[0], ends[:-1]])
    best = np.full((len(ends), factors.shape[2], len(points), k), np.inf)
    tile = min(tile, BOUND_ROWS)
    mean, deviation = vectors.mean(axis=0), vectors.std(axis=0)
    # Few tags, as those of batches, leave out much of a tile; ids leave out the query itself, which is seen among the pairs taken.
    grouped = tags is not None and len(np.unique(tags)) < len(tags) // 8

    def taken(rows: np.ndarray, others: np.ndarray, w: int) -> np.ndarray:
        distance = np.empty(len(rows))
        for at in range(0, len(rows), TAKEN_ROWS):
            i, j = rows[at : at + TAKEN_ROWS], others[at : at + TAKEN_ROWS]
            delta = vectors[j]
            delta -= points[i]
            np.abs(delta, out=delta)
            distance[at : at + len(i)] = np.einsum("id,id->i", delta, factors[i, :, w]) if len(factors) > 1 else delta @ factors[0, :, w]
        if tags is not None:
            distance[own[rows] == tags[others]] = np.inf
        return distance

    for w in range(factors.shape[2]):
        least = factors[:, :, w].min(axis=0)
        edges = (mean + deviation * BIN_EDGES[:, None]) * least
        for at in range(0, len(points), BOUND_QUERIES):
            asked = np.arange(at, min(at + BOUND_QUERIES, len(points)))
            left, left_sum = _bound_features(points[asked] * least, edges)
            left[:, -1] = 1.0
            for first in range(0, len(vectors), tile):
                part = vectors[first : first + tile]
                right, right_sum = _bound_features(part * least, edges)
                right[:, -1] = right_sum / -2
                common = left @ right.T
                # More than all roundings of the product in single precision.
                slack = (left_sum.max() + right_sum.max()) * left.shape[1] * 2.0**-22
                if grouped:
                    common[own[asked, None] == tags[None, first : first + len(part)]] = -np.inf
                for c in range(np.searchsorted(ends, first, "right"), np.searchsorted(starts, first + len(part), "left")):
                    low = max(starts[c] - first, 0)
                    mine = common[:, low : ends[c] - first]
                    known = best[c, w]
                    limit = known[asked, -1]
                    fresh = np.flatnonzero(np.isinf(limit))
                    seeds = k + SEEDS
                    if mine.shape[1] > seeds and len(fresh):
                        near = np.argpartition(mine[fresh], -seeds, axis=1)[:, -seeds:] + (first + low)
                        some = taken(np.repeat(asked[fresh], seeds), near.ravel(), w).reshape(-1, seeds)
                        limit[fresh] = np.partition(some, k - 1, axis=1)[:, k - 1]
                    rows, others = np.divmod(np.flatnonzero(mine >= ((left_sum - limit - slack) / 2).astype(np.float32)[:, None]), mine.shape[1])
                    for some in range(0, len(rows), 65_536):
                        i, j = asked[rows[some : some + 65_536]], others[some : some + 65_536] + (first + low)
                        distance = taken(i, j, w)
                        nearer = distance < known[i, -1]
                        i, distance = i[nearer], distance[nearer]
                        order = np.lexsort((distance, i))
                        i, distance = i[order], distance[order]
                        new, begin, place = np.unique(i, return_index=True, return_inverse=True)
                        rank = np.arange(len(i)) - begin[place]
                        found = np.full((len(new), k), np.inf)
                        found[place[rank < k], rank[rank < k]] = distance[rank < k]
                        known[new] = np.sort(np.concatenate([known[new], found], axis=1), axis=1)[:, :k]
    return best


def _boundable(points: np.ndarray, factors: np.ndarray, vectors: np.ndarray) -> bool:
    """Whether bounds in single precision make sense: enough vectors, all numbers of a usual size, and no negative weight."""
    return len(vectors) >= BOUND_FROM and bool((factors >= 0).all()) and all(bool((np.abs(x) < 1e12).all()) for x in (points, factors, vectors))


def nearest_per_class(
    queries: DataFrame, exemplars: DataFrame, *, k: int = 3, metric: str = "l1", exclude: str | None = None,
    groups: tuple[Sequence[int], Sequence[float]] | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The k nearest exemplars of each class for every query: qid, weighting, label, distances (ascending).

    queries: qid, v, optional scales (standardisations of the query, one for each weighting) and tag; exemplars: v, label
    and tag. All weightings are compared while a block of queries and one of exemplars are together; weighting is their number.
    ``exclude='tag'`` skips exemplars with the query's tag (its own id, or its batch). Blocks of queries meet
    blocks of exemplars, and the nearest of the blocks are merged, so all exemplars are compared and none passes
    through the driver. Blocks that travel hold up to ``SENT_ROWS`` rows, so what is shuffled does not follow the number
    of comparisons; in a task at most ``block_rows`` exemplars are compared at once. Most l1 distances are only bounded,
    by matrix products, and those that may count are taken exactly.
    """
    scaled, tagged = "scales" in queries.columns, exclude is not None
    fixed = None if groups is None else (np.asarray(groups[0]), np.asarray(groups[1], float))
    query_type = queries.schema["qid"].dataType.simpleString()
    schema = f"qid {query_type}, weighting int, label string, distances array<double>"

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"qid": a["qid"].slice(0, 0), "weighting": pa.array([], pa.int32()), "label": pa.array([], pa.string()), "distances": pa.array([], _DISTANCES)})
        names = pc.unique(b["label"]).sort()
        codes = pc.index_in(b["label"], names).to_numpy()
        order = np.argsort(codes, kind="stable")
        ends = np.cumsum(np.bincount(codes, minlength=len(names)))
        points, vectors = _matrix(a["v"]), _matrix(b["v"])[order]
        factors = _dimension_weights(metric, points.shape[1], fixed)[None, :, None]
        if scaled:
            scales = a["scales"].combine_chunks()
            scales = _matrix(pa.chunked_array([scales.flatten()])).reshape(len(points), -1, points.shape[1]).transpose(0, 2, 1)
            factors = factors / (scales if metric == "l1" else scales * scales)
        own = tags = None
        if tagged:
            known = pc.unique(b["tag"]).drop_null()
            own = pc.fill_null(pc.index_in(a["tag"], known), -1).to_numpy()
            tags = pc.fill_null(pc.index_in(b["tag"], known), -2).to_numpy()[order]
        if metric == "l1" and _boundable(points, factors, vectors):
            best = _smallest_bounded(points, factors, vectors, ends, k, block_rows, own, tags)
        else:
            best = _smallest(points, factors, vectors, ends, metric, k, block_rows, own, tags)
        flat = best.reshape(-1, k)
        finite = np.isfinite(flat)
        offsets = np.concatenate([[0], np.cumsum(finite.sum(axis=1))]).astype(np.int32)
        classes, weightings, rows = np.indices(best.shape[:3], np.int32).reshape(3, -1)
        return pa.table({
            "qid": a["qid"].combine_chunks().take(pa.array(rows)), "weighting": pa.array(weightings), "label": names.take(pa.array(classes)),
            "distances": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[finite]), type=_DISTANCES),
        })

    columns = ["v", "label", *(["tag"] if tagged else [])]
    blocks = max(1, -(-exemplars.count() // SENT_ROWS))
    asked = queries.count()
    parts = max(1, -(-asked // SENT_ROWS), min(SPREAD, -(-asked // 256)))
    # New column names on both sides, as queries and exemplars may come from one table.
    left = queries.select(*[F.col(c).alias(c) for c in queries.columns]).withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("bigint")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    right = exemplars.select(*[F.col(c).alias(c) for c in columns]).withColumn("block", F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint")))
    )
    # Pairs of blocks are few and take long: by their bytes, or in few partitions, several would share a task while others wait.
    left, right = (side.repartition(4 * parts * blocks, "part", "block") for side in (left, right))
    partial = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(meet, schema)
    return partial.groupBy("qid", "weighting", "label").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("distances"))), 1, k).alias("distances")
    )


def class_distances(queries: DataFrame, exemplars: DataFrame, **options) -> DataFrame:
    """Mean distance to the k nearest exemplars of each class; null for a class without any. Queries with scales keep their weighting."""
    near = nearest_per_class(queries, exemplars, **options)
    total = F.aggregate("distances", F.lit(0.0), lambda a, x: a + x)
    return near.select("qid", *(["weighting"] if "scales" in queries.columns else []), "label", F.when(F.size("distances") > 0, total / F.size("distances")).alias("distance"))


def accept_reject(
    distances: DataFrame, *, distance_limit: Column | float, margin_limit: Column | float = 0.0, relative: str = "second",
    thresholds: DataFrame | None = None,
) -> DataFrame:
    """Nearest class per query, accepted unless too far or too close to the runner-up.

    ``relative``: margin as a share of the runner-up (second), of the best distance (best) or as is
    (absolute). thresholds: label, distance_limit and optionally margin_limit per class.
    """
    # The distances are read once: of each query the two nearest classes, or none where no class has a distance.
    pairs = F.array_sort(F.collect_list(F.when(F.col("distance").isNotNull(), F.struct("distance", "label"))))
    every = distances.groupBy("qid").agg(pairs.alias("__p")).select(
        "qid", F.get("__p", F.lit(0))["label"].alias("label"), F.get("__p", F.lit(0))["distance"].alias("distance"), F.get("__p", F.lit(1))["distance"].alias("__next")
    )
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    far, close = lit(distance_limit), lit(margin_limit)
    if thresholds is not None:
        per_class = thresholds.withColumnsRenamed({"distance_limit": "__d", **({"margin_limit": "__m"} if "margin_limit" in thresholds.columns else {})})
        every = every.join(per_class, "label", "left")
        far = F.coalesce("__d", far)
        close = F.coalesce("__m", close) if "__m" in every.columns else close
    gap = F.col("__next") - F.col("distance")
    base = {"second": F.greatest("__next", F.lit(1e-6)), "best": F.greatest("distance", F.lit(0.05)), "absolute": F.lit(1.0)}
    margin = gap / base[relative]
    reason = (
        F.when(F.col("label").isNull(), "invalid_features")
        .when(F.col("distance") > far, "distance_rejected")
        .when(truth(margin < close), "margin_rejected")
        .otherwise("accepted")
    )
    return every.select("qid", "label", "distance", margin.alias("margin"), reason.alias("reason")).withColumn(
        "decision", F.when(F.col("reason") == "accepted", F.col("label")).otherwise("unknown")
    )


def loo_threshold(df: DataFrame, *, k: int = 3, metric: str = "l1", percentile: float = 0.98, factor: float = 1.35, offset: float = 0.04, floor: float = 0.35, empty: float = 0.75) -> DataFrame:
    """Distance limit of each class from the distances of its rows to their own class without themselves.

    df: id, label, v (standardised).
    """
    queries = df.select(F.col("id").alias("qid"), "v", F.col("id").alias("tag"))
    exemplars = df.select("v", "label", F.col("id").alias("tag"))
    own = class_distances(queries, exemplars, k=k, metric=metric, exclude="tag").join(
        df.select(F.col("id").alias("qid"), "label"), ["qid", "label"]
    )
    marks = quantiles(own, ["label"], F.col("distance"), {"p": percentile})
    return df.select("label").distinct().join(marks, "label", "left").select(
        "label", F.coalesce(F.greatest(F.lit(floor), F.col("p") * factor + offset), F.lit(empty)).alias("distance_limit")
    )


def leave_out_scales(df: DataFrame, *, by: str, floor: float = 1e-4) -> DataFrame:
    """Scale of each row's training set, the rows with another ``by`` value, from sums and not by refitting.

    Returns the ``by`` value and its scale array.
    """
    sums = long_vectors(df, [by]).groupBy(by, "dim").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")
    )
    whole = sums.groupBy("dim").agg(F.sum("n").alias("n_all"), F.sum("s").alias("s_all"), F.sum("q").alias("q_all"))
    rest = sums.join(whole, "dim").select(
        by, "dim", (F.col("n_all") - F.col("n")).alias("m"), (F.col("s_all") - F.col("s")).alias("a"), (F.col("q_all") - F.col("q")).alias("b")
    )
    mean = F.col("a") / F.col("m")
    sd = F.sqrt(F.greatest(F.col("b") / F.col("m") - mean * mean, F.lit(0.0)))
    fitted = rest.select(by, "dim", mean.alias("mean"), F.when(sd < floor, 1.0).otherwise(sd).alias("scale"))
    return scale_arrays(fitted, [by]).select(by, "scale")


def weighted_scales(scale: Column, weights: Sequence[Sequence[float]] | None) -> Column:
    """The scale under each weighting; weights are taken relative to their mean and divide the scale."""
    each = []
    for weighting in weights or [None]:
        if weighting is None:
            each.append(scale)
        else:
            mean = sum(weighting) / len(weighting)
            each.append(F.zip_with(scale, F.array(*[F.lit(float(w) / mean) for w in weighting]), lambda s, w: s / w))
    return F.array(*each)


def leave_out_eval(
    df: DataFrame, *, by: str, k: int = 3, metric: str = "l1", weights: Sequence[Sequence[float]] | None = None
) -> DataFrame:
    """Predicts every row from the rows with another ``by`` value: id, weighting, truth, label, distance.

    by='id' is leave-one-out, by='batch' leaves capture batches out. The work is quadratic by its definition; it
    runs block by block at any size and is never sampled. Pairs of blocks meet once for all weightings.
    """
    exemplars = df.select("v", "label", F.col(by).alias("tag"))
    scales = leave_out_scales(df, by=by).select(by, weighted_scales(F.col("scale"), weights).alias("scales"))
    queries = df.join(scales, by).select(F.col("id").alias("qid"), "v", "scales", F.col(by).alias("tag"))
    best = class_distances(queries, exemplars, k=k, metric=metric, exclude="tag").groupBy("qid", "weighting").agg(
        F.min_by("label", F.struct("distance", "label")).alias("label"), F.min("distance").alias("distance")
    )
    return best.join(df.select(F.col("id").alias("qid"), F.col("label").alias("truth"), *([by] if by != "id" else [])), "qid")


# Prototypes ---------------------------------------------------------------------------------------


def fit_prototypes(df: DataFrame, *, chunks: int = 3, minimum: int = 6, brightness: int = -1) -> DataFrame:
    """Median vector of each brightness third of a class (id, label, v): label, chunk, v.

    Classes with fewer than ``minimum`` rows get none. The first chunks take the remainder.
    """
    level = F.element_at("v", brightness if brightness < 0 else brightness + 1)
    placed = ordinal(df.withColumn("__l", level).withColumn("__b", histogram_cell(F.col("__l"))), ["label"], "__b", ["__l", "id"], "__o")
    sizes = df.groupBy("label").agg(F.count(F.lit(1)).alias("__n"))
    n, o = F.col("__n"), F.col("__o") - 1
    small, extra = F.floor(n / chunks), n % chunks
    cut = extra * (small + 1)
    chunk = F.when(o < cut, F.floor(o / (small + 1))).otherwise(extra + F.floor((o - cut) / F.greatest(small, F.lit(1))))
    marked = placed.join(sizes, "label").filter(n >= minimum).withColumn("chunk", chunk)
    medians = quantiles(long_vectors(marked, ["label", "chunk"]), ["label", "chunk", "dim"], F.col("x"), {"x": 0.5})
    packed = F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda e: e["x"])
    return medians.groupBy("label", "chunk").agg(packed.alias("v"))


def nearest_prototype(df: DataFrame, prototypes: DataFrame, *, spread: float = 0.15) -> DataFrame:
    """Smallest Euclidean distance per class with its share of exp(-d/spread): qid, label, distance, score.

    Prototypes are a few per class and travel with every row as one array.
    """
    packed = prototypes.agg(F.collect_list(F.struct("label", "v")).alias("__p")).withColumn("__one", F.lit(1))
    joined = df.withColumn("__one", F.lit(1)).join(F.broadcast(packed), "__one")

    def gap(p: Column) -> Column:
        return F.sqrt(F.aggregate(F.zip_with(F.col("v"), p["v"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))

    long = joined.select("qid", F.explode(F.transform("__p", lambda p: F.struct(p["label"].alias("label"), gap(p).alias("d")))).alias("e"))
    best = long.groupBy("qid", F.col("e.label").alias("label")).agg(F.min("e.d").alias("distance"))
    weight = F.exp(-F.col("distance") / spread)
    totals = best.groupBy("qid").agg(F.sum(weight).alias("__t"))
    return best.join(totals, "qid").withColumn("score", weight / F.greatest("__t", F.lit(1e-12))).drop("__t")
