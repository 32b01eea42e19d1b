"""Joins of captures, runs, reviews and contracts.

No side is forced to be broadcast: the planner does that from measured sizes and splits hot keys.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import geometry
from framelake.functions.numeric import first_reason, truth
from framelake.plans.boxes import with_cells
from framelake.plans.scan import top_n_per_key

# Samples and splits ------------------------------------------------------------------------------


def attach_reference(
    samples: DataFrame, references: DataFrame, *, batch: str = "batch_id", order: Sequence[str] = ("sample",), latest: bool = True
) -> DataFrame:
    """Each sample with the reference of its batch (last or first by ``order``) and a reason."""
    key = F.struct(*[F.col(c) for c in order])
    pick = F.max_by if latest else F.min_by
    dim = references.groupBy(batch).agg(pick(F.struct("sample", "width", "height"), key).alias("ref"))
    joined = samples.join(dim, batch, "left")
    reason = first_reason(
        ("missing_batch_empty_tray", F.col("ref").isNull()),
        ("reference_intrinsics_mismatch", (F.col("ref.width") != F.col("width")) | (F.col("ref.height") != F.col("height"))),
        ok="accepted",
    )
    return joined.select(*samples.columns, F.col("ref.sample").alias("reference_sample"), reason.alias("reason"))


def exclude_seen(train: DataFrame, test: DataFrame, hash_column: str = "sha256") -> DataFrame:
    """Test rows whose content is not in the training set."""
    return test.join(train.select(hash_column), hash_column, "left_anti")


def seen_rows(train: DataFrame, test: DataFrame, hash_column: str = "sha256") -> DataFrame:
    return test.join(train.select(hash_column), hash_column, "left_semi")


def leaked_hashes(df: DataFrame, hash_column: str = "sha256") -> DataFrame:
    """Hashes that appear in more than one split (splits are few, so the set stays small)."""
    return (
        df.groupBy(hash_column)
        .agg(F.array_sort(F.collect_set("split")).alias("splits"))
        .filter(F.size("splits") > 1)
    )


def leaked_instances(df: DataFrame, *, final: str = "final_holdout", development: Sequence[str] = ("train", "probability_calibration")) -> DataFrame:
    """Instances met both in the final split and in development."""
    return (
        df.filter("instance_id is not null")
        .groupBy("instance_id")
        .agg(F.bool_or(F.col("split") == final).alias("f"), F.bool_or(F.col("split").isin(*development)).alias("d"))
        .filter("f and d")
        .select("instance_id")
    )


def reserved_overlap(reserved: DataFrame, training: DataFrame, key: str) -> DataFrame:
    return reserved.select(key).intersect(training.select(key))


def complete_frozen(frozen: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Every frozen row with its record; a missing one is ``unknown`` and not accepted."""
    joined = frozen.join(records.select(key, "prediction", "accepted"), key, "left")
    return joined.withColumns(
        {
            "prediction": F.coalesce("prediction", F.lit("unknown")),
            "accepted": F.coalesce("accepted", F.lit(False)),
        }
    )


def outside_frozen(frozen: DataFrame, records: DataFrame, key: str) -> DataFrame:
    return records.join(frozen.select(key), key, "left_anti")


# Runs --------------------------------------------------------------------------------------------


def paired_runs(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Before and after of every key with its problem: duplicate, only on one side, or none."""

    def side(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c != key]
        return df.groupBy(key).agg(
            F.count(F.lit(1)).alias(f"{name}_rows"), F.min(F.struct(*rest)).alias(name)
        )

    joined = side(before, "before").join(side(after, "after"), key, "full")
    return joined.select(
        key,
        "before",
        "after",
        first_reason(
            ("missing_before", F.col("before").isNull()),
            ("missing_after", F.col("after").isNull()),
            ("duplicate_key", (F.col("before_rows") > 1) | (F.col("after_rows") > 1)),
        ).alias("problem"),
    )


def run_keys_agree(pairs: DataFrame) -> DataFrame:
    """One row: whether both runs cover the same keys once."""
    return pairs.agg(
        F.count(F.lit(1)).alias("keys"), F.count_if(F.col("problem") != "ok").alias("problems")
    ).withColumn("comparable", F.col("problems") == 0)


def compare_models(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Predictions of two models per file; an absent side reads ``missing``."""
    a = first.select(key, F.col("prediction").alias("__a"))
    b = second.select(key, F.col("prediction").alias("__b"))
    missing = F.lit("missing")
    return a.join(b, key, "full").select(
        key, F.coalesce("__a", missing).alias("first"), F.coalesce("__b", missing).alias("second")
    ).withColumn("agree", F.col("first") == F.col("second"))


# Reviews -----------------------------------------------------------------------------------------


def confirmed_assignments(detections: DataFrame, annotations: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Objects with their confirmed label and reason; a frame passes only if all its objects do."""
    notes = annotations.groupBy("frame_id", "object_id").agg(
        F.count(F.lit(1)).alias("__n"),
        F.min(F.struct("reviewed", "label_id", "bbox_px")).alias("note"),
    )
    reason = first_reason(
        ("duplicate_annotation", F.col("__n") > 1),
        ("not_confirmed", F.col("note").isNull() | ~truth(F.col("note.reviewed"))),
        ("invalid_label", ~truth(F.col("note.label_id").isin(*labels)) | (F.col("note.label_id") == "unknown")),
        ("bbox_changed", ~F.col("note.bbox_px").eqNullSafe(F.col("bbox_px"))),
        ok="accepted",
    )
    marked = detections.join(notes, ["frame_id", "object_id"], "left").withColumn("reason", reason)
    frames = marked.groupBy("frame_id").agg(F.bool_and(F.col("reason") == "accepted").alias("frame_passes"))
    return marked.join(frames, "frame_id").select(
        "frame_id", "object_id",
        F.when(F.col("reason") == "accepted", F.col("note.label_id")).alias("label_id"),
        "reason", "frame_passes",
    )


# Checks that every review has to answer.
REVIEW_CHECKS = ("roi_ok", "association_ok", "shadow_ok", "depth_ok", "instance_split_ok")


def apply_reviews(
    reviews: DataFrame, samples: DataFrame, objects: DataFrame, compositions: DataFrame, aliases: DataFrame
) -> DataFrame:
    """Outcome of each review: a reason, or the resolved label and whether the sample is reviewed.

    samples: sample, is_multi, label_id, object_count. objects (of multi-object reviews): sample, object_id,
    true_label, association_ok, side_occluded, side_visible_ratio. compositions: sample, label, count.
    The reference reports the first faulty object; here that is the one with the smallest id.
    """
    from framelake.functions.labels import alias_key

    names = aliases.filter("enabled").select(F.col("alias_key"), F.col("class_id").alias("__class"))

    def resolved(df: DataFrame, column: str, out: str) -> DataFrame:
        return (
            df.withColumn("alias_key", alias_key(F.col(column)))
            .join(names, "alias_key", "left")
            .withColumnRenamed("__class", out)
            .drop("alias_key")
        )

    checked = resolved(objects, "true_label", "label").withColumn(
        "fault",
        F.when(F.coalesce("object_id", F.lit("")) == "", "multi_object_id_missing")
        .when(F.col("association_ok").isNull(), F.concat(F.lit("multi_association_check_missing:"), "object_id"))
        .when(F.col("side_occluded").isNull(), F.concat(F.lit("multi_occlusion_check_missing:"), "object_id"))
        .when(~truth(F.col("side_visible_ratio").between(0, 1)), F.concat(F.lit("multi_visible_ratio_out_of_range:"), "object_id"))
        .when(F.col("label").isNull(), F.concat(F.lit("unknown_label:"), "true_label")),
    )
    per_sample = checked.groupBy("sample").agg(
        F.count(F.lit(1)).alias("o_rows"),
        F.count_distinct("object_id").alias("o_ids"),
        F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("object_id"))).alias("o_fault"),
        F.bool_and("association_ok").alias("o_associated"),
    )
    expected = resolved(compositions, "label", "class").groupBy("sample", "class").agg(F.sum("count").alias("n"))
    found = checked.groupBy("sample", F.col("label").alias("class")).agg(F.count(F.lit(1)).alias("m"))
    same = (
        expected.join(found, ["sample", "class"], "full")
        .groupBy("sample")
        .agg(F.bool_and(F.col("n").eqNullSafe(F.col("m"))).alias("same_labels"))
    )
    base = samples.select("sample", "is_multi", F.col("label_id").alias("__label"), "object_count", F.lit(True).alias("__known"))
    joined = resolved(
        reviews.join(base, "sample", "left").withColumn("__given", F.coalesce("true_label", "__label")), "__given", "single"
    )
    joined = joined.join(per_sample, "sample", "left").join(same, "sample", "left")
    missing = F.filter(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REVIEW_CHECKS]), lambda c: c.isNotNull()
    )
    multi = truth(F.col("is_multi"))
    reason = (
        F.when(~truth(F.col("__known")), "metadata_missing")
        .when(F.size(missing) > 0, F.concat(F.lit("missing_boolean_checks:"), F.array_join(missing, ",")))
        .when(multi & F.col("o_rows").isNull(), "multi_objects_missing")
        .when(multi & F.col("o_fault").isNotNull(), F.col("o_fault"))
        .when(multi & (F.col("o_ids") != F.col("o_rows")), "multi_object_ids_not_unique")
        .when(multi & (F.col("o_rows") != F.col("object_count")), "multi_object_review_count_mismatch")
        .when(multi & ~truth(F.col("same_labels")), "multi_object_labels_do_not_match_composition")
        .when(~multi & F.col("__given").isNotNull() & (F.col("__given") != "empty_tray") & F.col("single").isNull(), "unknown_label")
        .otherwise("updated")
    )
    approved = truth(F.col("approved"))
    for c in REVIEW_CHECKS:
        approved = approved & truth(F.col(c))
    approved = approved & (~multi | truth(F.col("o_associated")))
    label = F.when(~multi, F.coalesce("single", F.when(F.col("__given") == "empty_tray", F.lit("empty_tray"))))
    return joined.select("sample", reason.alias("reason"), label.alias("__l"), approved.alias("__a")).select(
        "sample",
        "reason",
        F.when(F.col("reason") == "updated", F.col("__l")).alias("label_id"),
        ((F.col("reason") == "updated") & F.col("__a")).alias("human_reviewed"),
    )


# Regions -----------------------------------------------------------------------------------------


def component_overlaps(components: DataFrame, objects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixels shared by each component and object of a frame, with both sizes."""
    keys = list(keys)
    sizes = components.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("pixels"))
    areas = objects.groupBy(*keys, "object").agg(F.count(F.lit(1)).alias("area"))
    shared = components.join(objects, [*keys, "u", "v"]).groupBy(*keys, "component", "object").agg(
        F.count(F.lit(1)).alias("shared")
    )
    return shared.join(sizes, [*keys, "component"]).join(areas, [*keys, "object"])


def unique_owner(
    overlaps: DataFrame, keys: Sequence[str], *, min_pixels: int = 20, min_share: float = 0.10, cover: float = 0.65, max_growth: float = 8.0
) -> DataFrame:
    """Component to the one object it may extend: a single owner, well covered, not too large."""
    keys = list(keys)
    owns = F.col("shared") >= F.greatest(F.lit(float(min_pixels)), F.col("area") * min_share)
    owners = overlaps.filter(owns).groupBy(*keys, "component").agg(
        F.count(F.lit(1)).alias("owners"),
        F.min(F.struct("object", "shared", "area", "pixels")).alias("o"),
    )
    kept = (F.col("owners") == 1) & (F.col("o.shared") >= F.col("o.area") * cover) & (
        F.col("o.pixels") <= F.col("o.area") * max_growth
    )
    return owners.filter(kept).select(*keys, "component", "o.object", "o.shared", "o.area", "o.pixels")


def object_component(
    overlaps: DataFrame, keys: Sequence[str], *, min_pixels: int = 20, min_share: float = 0.10, min_support: float = 0.35, rival: float = 0.25
) -> DataFrame:
    """Object to its component or the reason it has none (owner = share of the component)."""
    keys = list(keys)
    owns = (F.col("shared") >= min_pixels) & (F.col("shared") >= F.col("pixels") * min_share)
    owned = overlaps.filter(owns)
    owners = owned.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("owners"))
    marked = owned.join(owners, [*keys, "component"])
    per_object = marked.groupBy(*keys, "object").agg(F.bool_or(F.col("owners") > 1).alias("contested"))
    fit = marked.filter((F.col("owners") == 1) & (F.col("shared") >= F.col("pixels") * min_support))
    best = top_n_per_key(
        fit, [*keys, "object"], [F.desc("shared"), F.desc("pixels"), F.asc("component")], 2
    ).groupBy(*keys, "object").agg(
        F.max(F.when(F.col("rank") == 1, F.col("component"))).alias("component"),
        F.max(F.when(F.col("rank") == 1, F.col("shared"))).alias("s1"),
        F.max(F.when(F.col("rank") == 2, F.col("shared"))).alias("s2"),
    )
    everything = overlaps.select(*keys, "object").distinct()
    joined = everything.join(per_object, [*keys, "object"], "left").join(best, [*keys, "object"], "left")
    ambiguous = truth(F.col("contested")) | truth(F.col("s2") >= F.col("s1") * rival)
    reason = (
        F.when(ambiguous, "ambiguous_side_color_correspondence")
        .when(F.col("component").isNull(), "no_matching_side_color_component")
        .otherwise("accepted")
    )
    return joined.select(
        *keys, "object", F.when(~ambiguous, F.col("component")).alias("component"), reason.alias("reason")
    )


# Correspondences ----------------------------------------------------------------------------------


def mutual_unique_match(
    primary: DataFrame, side: DataFrame, keys: Sequence[str], *, limit: float = 3.0, ambiguity_gap: float = 0.25, auxiliary: Column | None = None
) -> DataFrame:
    """Mutually best pairs whose runner-up is clearly worse in both directions.

    Both sides have ``corner_id`` and ``line`` (position across the epipolar lines); candidates lie within
    ``limit`` of each other and are found through neighbouring strips of that width. ``auxiliary`` may use
    the columns of the primary side and those of the other prefixed with ``s_``.
    """
    keys = list(keys)
    strip = F.floor(F.col("line") / limit)
    left = primary.withColumn("__strip", F.explode(F.array(strip - 1, strip, strip + 1)))
    right = side.withColumn("__strip", strip)
    right = right.select(*keys, "__strip", *[F.col(c).alias(f"s_{c}") for c in side.columns if c not in keys])
    error = F.abs(F.col("line") - F.col("s_line"))
    cost = error / limit + (auxiliary if auxiliary is not None else F.lit(0.0))
    pairs = left.join(right, [*keys, "__strip"]).filter(error <= limit).select(
        *keys, "corner_id", "s_corner_id", error.alias("epipolar_error"), cost.alias("cost")
    )

    def unique(own: str, other: str) -> DataFrame:
        top = top_n_per_key(pairs, [*keys, own], [F.asc("cost"), F.asc(other)], 2)
        best = top.groupBy(*keys, own).agg(
            F.max(F.when(F.col("rank") == 1, F.col(other))).alias(other),
            F.max(F.when(F.col("rank") == 1, F.col("cost"))).alias("cost"),
            F.max(F.when(F.col("rank") == 1, F.col("epipolar_error"))).alias("epipolar_error"),
            F.max(F.when(F.col("rank") == 2, F.col("cost"))).alias("next"),
        )
        return best.filter(F.col("next").isNull() | (F.col("next") - F.col("cost") >= ambiguity_gap))

    forward = unique("corner_id", "s_corner_id")
    backward = unique("s_corner_id", "corner_id").select(*keys, "corner_id", "s_corner_id")
    return forward.join(backward, [*keys, "corner_id", "s_corner_id"]).select(
        *keys, "corner_id", "s_corner_id", "cost", "epipolar_error"
    )


def _segment(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")]


def lines_by_cell(lines: DataFrame, keys: Sequence[str], prefix: str, *, cell: float = 32.0, tolerance: float = 3.0) -> DataFrame:
    """Lines (x1, y1, x2, y2) spread over the cells a supported endpoint can lie in."""
    renamed = lines.select(*keys, *[F.col(c).alias(f"{prefix}{c}") for c in lines.columns if c not in keys])
    x1, y1, x2, y2 = _segment(prefix)
    margin_x, margin_y = 0.1 * F.abs(x2 - x1) + tolerance, 0.1 * F.abs(y2 - y1) + tolerance
    low = (F.least(x1, x2) - margin_x, F.least(y1, y2) - margin_y)
    high = (F.greatest(x1, x2) + margin_x, F.greatest(y1, y2) + margin_y)
    return with_cells(renamed, low, high, cell)


def supported_by_line(edges: DataFrame, lines: DataFrame, keys: Sequence[str], endpoints: Sequence[str], *, cell: float = 32.0, tolerance: float = 3.0) -> DataFrame:
    """Edges whose projected endpoints lie on some line of the same object."""
    a = [F.col(c) for c in endpoints]
    spread = lines_by_cell(lines, keys, "l_", cell=cell, tolerance=tolerance)
    placed = edges.withColumn("cu", F.floor(a[0] / cell)).withColumn("cv", F.floor(a[1] / cell))
    keys_on = [placed[k] == spread[k] for k in keys] + [placed["cu"] == spread["cu"], placed["cv"] == spread["cv"]]
    condition = geometry.line_contains(_segment("l_"), a, tolerance)
    for k in keys_on:
        condition = condition & k
    return placed.join(spread, condition, "left_semi").drop("cu", "cv")


# The two kinds of evidence that together confirm an edge.
EDGE_EVIDENCE = ("TOP_PLANE_INTERSECTION", "SIDE_DEPTH_SUPPORTED")


def confirm_edges(edges: DataFrame, primary_lines: DataFrame, side_lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges with both kinds of evidence or a two-view match, seen on a verified line in each view.

    edges: sources, two_view, p1..p4 (primary endpoints) and q1..q4 (side endpoints).
    """
    kinds = F.array(*map(F.lit, EDGE_EVIDENCE))
    evident = (F.size(F.array_intersect("sources", kinds)) == len(EDGE_EVIDENCE)) | truth(F.col("two_view"))
    seen = supported_by_line(edges.filter(evident), primary_lines, keys, ("p1", "p2", "p3", "p4"))
    return supported_by_line(seen, side_lines, keys, ("q1", "q2", "q3", "q4"))


def node_line_incidence(nodes: DataFrame, lines: DataFrame, keys: Sequence[str], u: str, v: str, *, cell: float = 32.0, tolerance: float = 3.0) -> DataFrame:
    """Nodes near a long enough line, within its ends extended by a tenth: node_id, line_id, along."""
    spread = lines_by_cell(lines, keys, "l_", cell=cell, tolerance=tolerance)
    placed = nodes.withColumn("cu", F.floor(F.col(u) / cell)).withColumn("cv", F.floor(F.col(v) / cell))
    line = _segment("l_")
    along = geometry.along_segment(F.col(u), F.col(v), line)
    near = geometry.point_line_distance(F.col(u), F.col(v), line) <= tolerance
    long_enough = (line[2] - line[0]) ** 2 + (line[3] - line[1]) ** 2 >= 64
    return placed.join(spread, [*keys, "cu", "cv"]).filter(near & long_enough & along.between(-0.1, 1.1)).select(
        *keys, "node_id", F.col("l_line_id").alias("line_id"), along.alias("along"), *[c.alias(n) for c, n in zip(line, ("x1", "y1", "x2", "y2"))]
    )


_ENDS = ("x1", "y1", "x2", "y2")


class _BlockPair:
    """Pairs of two blocks of nodes: on how many lines of a view they lie, two standing for more, and on which."""

    def __init__(self, one: pa.Table, two: pa.Table, same: bool):
        self.nodes = one, two
        self.open = ~np.tri(one.num_rows, dtype=bool) if same else np.ones((one.num_rows, two.num_rows), bool)
        self.found: list[list[tuple]] = []
        self.view = None

    def begin(self, view: int) -> None:
        while self.view != view:
            self.close()
            self.view = 0 if self.view is None else self.view + 1
            names = (("pu", "pv"), ("su", "sv"))[self.view]
            self.at = [tuple(t[n].to_numpy().astype(float) for n in names) for t in self.nodes]
            self.count = np.zeros(self.open.shape, np.int8)
            self.which = np.zeros(self.open.shape, np.int32)
            self.lines: list[tuple] = []

    def close(self) -> None:
        if self.view is not None:
            self.open &= self.count == 1
            self.found.append((self.which, self.lines))

    def add(self, lines: pa.Table, tolerance: float) -> None:
        ends = [lines[c].to_numpy().astype(float)[:, None] for c in _ENDS]
        dx, dy = ends[2] - ends[0], ends[3] - ends[1]
        square, length = np.maximum(dx * dx + dy * dy, 1e-9), np.maximum(np.hypot(dx, dy), 1e-6)
        left = self.open & (self.count < 2)
        seen, places = [np.flatnonzero(left.any(axis=1)), np.flatnonzero(left.any(axis=0))], []
        for (u, v), some in zip(self.at, seen):
            px, py = u[some] - ends[0], v[some] - ends[1]
            along = (px * dx + py * dy) / square
            near = np.abs(dx * py - dy * px) / length <= tolerance
            places.append(np.where(near & (along >= -0.1) & (along <= 1.1), along, np.nan))
        first = len(self.lines)
        self.lines.extend(zip(lines["line_id"].to_pylist(), *(e[:, 0].tolist() for e in ends)))
        for k, (ta, tb) in enumerate(zip(*places)):
            i, j = np.flatnonzero(~np.isnan(ta)), np.flatnonzero(~np.isnan(tb))
            if not len(i) or not len(j):
                continue
            far = np.abs(ta[i, None] - tb[j]) >= 0.5
            x, y = np.nonzero(far)
            x, y = seen[0][i[x]], seen[1][j[y]]
            self.count[x, y] = np.minimum(self.count[x, y] + 1, 2)
            self.which[x, y] = first + k

    def rows(self) -> pa.Table | None:
        self.begin(1)
        self.close()
        x, y = np.nonzero(self.open)
        if not len(x):
            return None
        columns = {}
        for end, table, at in zip("ab", self.nodes, (x, y)):
            columns[end] = table["node_id"].take(pa.array(at))
            for axis in "xyz":
                columns[f"{end}_{axis}"] = table[axis].take(pa.array(at))
        for tag, (which, lines) in zip(("top", "side"), self.found):
            used = which[x, y]
            columns[f"{tag}_line"] = pa.array([lines[k][0] for k in used])
            for n, name in enumerate(_ENDS):
                columns[f"{tag}_{name}"] = pa.array([lines[k][n + 1] for k in used], pa.float64())
        return pa.table(columns)


def _pairs_on_one_line(nodes: DataFrame, top: DataFrame, side: DataFrame, keys: list[str], *, block: int, tolerance: float = 3.0, chunk: int = 256) -> DataFrame:
    """Node pairs that both views have on exactly one line: keys, a, b, pa, pb (positions), top and side (the lines).

    Two blocks of nodes and their key's lines make one run of sorted rows: the nodes, the lines of the first view, those of the
    second. A run is read as a stream; a task holds two blocks, one byte and four for each of their pairs, and `chunk` lines.
    """
    c = F.col
    usable = lambda df: df.filter(" and ".join(f"{k} is not null" for k in keys)) if keys else df
    known = usable(nodes).filter("node_id is not null")
    sizes = known.groupBy(*keys).agg((F.ceil(F.count(F.lit(1)) / block).cast("int") - 1).alias("__last"))
    every = F.flatten(F.transform(F.sequence(F.lit(0), c("__last")), lambda i: F.transform(F.sequence(i, c("__last")), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    own = F.pmod(F.xxhash64("node_id"), c("__last") + 1).cast("int")
    dealt = known.join(sizes, keys).withColumn("__i", own).withColumn(
        "__t", F.explode(F.transform(F.sequence(F.lit(0), c("__last")), lambda j: F.struct(F.least("__i", j).alias("i"), F.greatest("__i", j).alias("j"))))
    )
    places = ["pu", "pv", "su", "sv", "x", "y", "z"]
    rows = dealt.select(*keys, "__t", F.lit(-1).alias("__kind"), "__i", "node_id", *[c(n).cast("double").alias(n) for n in places])
    long_enough = (c("x2") - c("x1")) ** 2 + (c("y2") - c("y1")) ** 2 >= 64
    for kind, lines in enumerate((top, side)):
        sent = usable(lines).filter(long_enough).join(sizes, keys).withColumn("__t", F.explode(every))
        rows = rows.unionByName(
            sent.select(*keys, "__t", F.lit(kind).alias("__kind"), "line_id", *[c(n).cast("double").alias(n) for n in _ENDS]), allowMissingColumns=True
        )
    rows = rows.withColumns({"__one": c("__t.i"), "__two": c("__t.j")}).drop("__t")
    group = [*keys, "__one", "__two"]
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes.sparkSession.sparkContext.defaultParallelism)
    sorted_rows = rows.repartition(tasks, *group).sortWithinPartitions(*group, "__kind")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, name, held, state = None, None, [], None

        def paired() -> _BlockPair:
            table = pa.concat_tables(held) if held else None
            if table is None:
                return None
            own = table["__i"].to_numpy()
            one, two = (table.take(pa.array(np.flatnonzero(own == name[n]))) for n in ("__one", "__two"))
            return _BlockPair(one, two, name["__one"] == name["__two"])

        def finished() -> Iterator[pa.RecordBatch]:
            found = state.rows() if state else None
            if found is None:
                return
            for k in keys:
                found = found.append_column(k, pa.array([name[k]] * found.num_rows, kinds[k]))
            yield from found.select(names).cast(pa.schema([(n, kinds[n]) for n in names])).to_batches()

        kinds = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            kinds = {k: table.schema.field(k).type for k in keys} | {n: pa.float64() for n in names if n not in keys}
            kinds |= {e: table.schema.field("node_id").type for e in "ab"}
            kinds |= {f"{t}_line": table.schema.field("line_id").type for t in ("top", "side")}
            run = np.zeros(max(table.num_rows - 1, 0), bool)
            for k in [*group, "__kind"]:
                column = table[k].combine_chunks()
                run |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(run) + 1).tolist(), table.num_rows]
            for start, end in zip(edges, edges[1:]):
                if start == end:
                    continue
                part = table.slice(start, end - start)
                key = tuple(part[k][0].as_py() for k in group)
                if key != current:
                    yield from finished()
                    current, name, held, state = key, dict(zip(group, key)), [], None
                kind = part["__kind"][0].as_py()
                if kind < 0:
                    held.append(part)
                    continue
                if state is None:
                    state = paired()
                    held = []
                if state is not None:
                    state.begin(kind)
                    for at in range(0, part.num_rows, chunk):
                        state.add(part.slice(at, chunk), tolerance)
        yield from finished()

    kind_of = {f.name: f.dataType.simpleString() for f in sorted_rows.schema}
    fields = [f"`{k}` {kind_of[k]}" for k in keys]
    for end in "ab":
        fields += [f"{end} {kind_of['node_id']}", *[f"{end}_{axis} double" for axis in "xyz"]]
    for tag in ("top", "side"):
        fields += [f"{tag}_line {kind_of['line_id']}", *[f"{tag}_{n} double" for n in _ENDS]]
    names = [*keys, *[f"{e}{n}" for e in "ab" for n in ("", "_x", "_y", "_z")], *[f"{t}_{n}" for t in ("top", "side") for n in ("line", *_ENDS)]]
    found = sorted_rows.mapInArrow(meet, ", ".join(fields))
    low = c("a") < c("b")

    def position(first: str, second: str) -> Column:
        return F.struct(*[F.when(low, c(f"{first}_{axis}")).otherwise(c(f"{second}_{axis}")).alias(axis) for axis in "xyz"])

    return found.filter(c("a") != c("b")).select(
        *keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), position("a", "b").alias("pa"), position("b", "a").alias("pb"),
        *[F.struct(c(f"{t}_line").alias("line_id"), *[c(f"{t}_{n}").alias(n) for n in _ENDS]).alias(t) for t in ("top", "side")],
    )


def two_view_edges(
    nodes: DataFrame, top_lines: DataFrame, side_lines: DataFrame, keys: Sequence[str], *,
    camera: dict, rotation: Sequence[Sequence[float]], translation: Sequence[float],
    max_residual: float = 2.0, min_length: float = 4.0, block: int = 1_024,
) -> DataFrame:
    """Node pairs on exactly one line in each view whose two ray planes agree with their positions.

    nodes: node_id (unique in its key), pu, pv, su, sv (pixels in both views), x, y, z (position in the primary camera).
    Pairs become rows only when both views have them on one line.
    """
    keys = list(keys)

    both = _pairs_on_one_line(nodes, top_lines, side_lines, keys, block=block)

    def normalized(tag: str) -> dict[str, Column]:
        out = {}
        for i in (1, 2):
            out[f"{tag}_px{i}"] = (F.col(f"{tag}.x{i}") - camera["cx"]) / camera["fx"]
            out[f"{tag}_py{i}"] = (F.col(f"{tag}.y{i}") - camera["cy"]) / camera["fy"]
        return out

    def raw_normal(tag: str) -> dict[str, Column]:
        px, py = ([F.col(f"{tag}_{axis}{i}") for i in (1, 2)] for axis in ("px", "py"))
        n = [py[0] - py[1], px[1] - px[0], px[0] * py[1] - py[0] * px[1]]
        return {f"{tag}_n{i}": c for i, c in enumerate(n)}

    def unit(tag: str) -> dict[str, Column]:
        n = [F.col(f"{tag}_n{i}") for i in range(3)]
        norm = F.greatest(F.sqrt(geometry.dot(n, n)), F.lit(1e-9))
        return {f"{tag}_u{i}": c / norm for i, c in enumerate(n)}

    normal_a = [F.col(f"top_u{i}") for i in range(3)]
    normal_s = [F.col(f"side_u{i}") for i in range(3)]
    turned = {
        f"back_u{i}": geometry.dot(normal_s, [F.lit(float(rotation[k][i])) for k in range(3)]) for i in range(3)
    } | {"shift": geometry.dot(normal_s, [F.lit(float(t)) for t in translation])}
    normal_b = [F.col(f"back_u{i}") for i in range(3)]
    crossed = {
        "c0": normal_a[1] * normal_b[2] - normal_a[2] * normal_b[1],
        "c1": normal_a[2] * normal_b[0] - normal_a[0] * normal_b[2],
        "c2": normal_a[0] * normal_b[1] - normal_a[1] * normal_b[0],
    }
    placed = both
    for step in (
        normalized("top") | normalized("side"),
        raw_normal("top") | raw_normal("side"),
        unit("top") | unit("side"),
        turned,
        crossed,
    ):
        placed = placed.withColumns(step)
    ends = [[F.col(f"{e}.{c}") for c in "xyz"] for e in ("pa", "pb")]
    residual = F.greatest(
        *[F.abs(geometry.dot(e, normal_a)) for e in ends],
        *[F.abs(geometry.dot(e, normal_b) + F.col("shift")) for e in ends],
    )
    step = [ends[1][i] - ends[0][i] for i in range(3)]
    cross = [F.col(c) for c in crossed]
    return placed.select(
        *keys, "a", "b", F.col("top.line_id").alias("top_line"), F.col("side.line_id").alias("side_line"),
        F.sqrt(geometry.dot(step, step)).alias("length"), residual.alias("residual"),
        F.sqrt(geometry.dot(cross, cross)).alias("__cross"),
    ).filter(
        (F.col("residual") <= max_residual) & (F.col("length") >= min_length) & (F.col("__cross") >= 0.02)
    ).drop("__cross")


# Contracts and safety --------------------------------------------------------------------------------


def composition_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One text per scene that is equal for equal compositions (label, count)."""
    entry = F.concat_ws("x", F.col("label"), F.col("count").cast("string"))
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("composition"))


def scene_consistency(scenes: DataFrame, keys: Sequence[str] = ("batch_id", "scene_index"), order: Sequence[str] = ("ns", "sample")) -> DataFrame:
    """Captures whose composition differs from the first one recorded for their scene."""
    first = scenes.groupBy(*keys).agg(F.min_by("composition", F.struct(*order)).alias("expected"))
    return scenes.join(first, list(keys)).withColumn("consistent", F.col("composition") == F.col("expected"))


def contract_guard(rows: DataFrame, contracts: DataFrame, key: str) -> DataFrame:
    """Rows joined to the model they use, with the reason they must not be scored by it."""
    model = contracts.select(
        key, F.col("registry_hash").alias("__r"), F.col("feature_contract").alias("__f"), F.col("intrinsics").alias("__i")
    )
    reason = first_reason(
        ("model_missing", F.col("__r").isNull()),
        ("registry_hash_mismatch", ~F.col("registry_hash").eqNullSafe(F.col("__r"))),
        ("feature_contract_mismatch", ~F.col("feature_contract").eqNullSafe(F.col("__f"))),
        ("intrinsics_mismatch", ~F.col("intrinsics").eqNullSafe(F.col("__i"))),
        ok="accepted",
    )
    return rows.join(model, key, "left").withColumn("reason", reason).drop("__r", "__f", "__i")


# States that no later evidence may lift.
SAFETY_FAILURES = ("OCCLUDED", "DEPTH_INVALID", "NO_GRASP_SURFACE")


def illegal_upgrades(baseline: DataFrame, fused: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Objects that failed with one camera and are pickable or selected with two."""
    base = baseline.select(*keys, F.col("status").alias("baseline_status")).filter(
        F.col("baseline_status").isin(*SAFETY_FAILURES)
    )
    return fused.join(base, list(keys)).filter((F.col("status") == "PICKABLE") | F.col("selected"))


def colour_conflict_veto(primary: DataFrame, side: DataFrame, keys: Sequence[str], *, confidence: float = 0.85) -> DataFrame:
    """Demotes and deselects objects whose two views are sure of different colours."""
    other = side.select(*keys, F.col("colour").alias("__c"), F.col("colour_confidence").alias("__p"))
    joined = primary.join(other, list(keys), "left")
    known = F.coalesce("colour", F.lit("unknown")) != "unknown"
    known = known & (F.coalesce("__c", F.lit("unknown")) != "unknown")
    conflict = truth(
        known & (F.col("colour_confidence") >= confidence) & (F.col("__p") >= confidence) & (F.col("colour") != F.col("__c"))
    )
    soft = F.col("status").isin("PICKABLE", "UNCERTAIN")
    return joined.withColumns(
        {
            "colour_conflict": conflict,
            "selected": F.col("selected") & ~conflict,
            "status": F.when(conflict & soft, "UNCERTAIN").otherwise(F.col("status")),
        }
    ).drop("__c", "__p")
