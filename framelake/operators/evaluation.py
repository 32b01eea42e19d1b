"""Metrics, comparisons and gates over decisions.

Everything is a partial aggregate per class followed by an aggregate over classes, so one hot class does
not end up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.numeric import ratio, truth
from framelake.plans.quantiles import mad, quantiles
from framelake.plans.small import one_row, side_by_side


def confusion(df: DataFrame, actual: str = "truth", predicted: str = "prediction", keys: Sequence[str] = ()) -> DataFrame:
    """Long confusion counts; a missing prediction is ``unknown``."""
    return df.groupBy(
        *keys, F.col(actual).alias("truth"), F.coalesce(predicted, F.lit("unknown")).alias("prediction")
    ).agg(F.count(F.lit(1)).alias("rows"))


def confusion_matrix(df: DataFrame, labels: Sequence[str], actual: str = "truth", predicted: str = "prediction") -> DataFrame:
    """Pivoted confusion with one column per label and always an ``unknown`` column."""
    return df.groupBy(F.col(actual).alias("truth")).agg(
        *[F.count_if(F.col(predicted) == name).alias(f"as_{name}") for name in labels],
        F.count_if(F.coalesce(F.col(predicted), F.lit("unknown")) == "unknown").alias("as_unknown"),
    )


def per_class_metrics(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows, raw accuracy and accepted recall of every true class (columns truth, prediction, accepted)."""
    right = truth(F.col("prediction") == F.col("truth"))
    return df.groupBy(*keys, "truth").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(right).alias("correct"),
        F.count_if(F.col("accepted")).alias("accepted"),
        F.count_if(right & F.col("accepted")).alias("accepted_correct"),
    ).withColumns(
        {
            "raw_accuracy": ratio(F.col("correct"), F.col("rows")),
            "accepted_recall": ratio(F.col("accepted_correct"), F.col("rows")),
        }
    )


def decision_metrics(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Raw accuracy, macro recall with rejection, coverage, accuracy of the accepted, wrong accepts."""
    classes = per_class_metrics(df, keys)
    return classes.groupBy(*keys).agg(
        F.sum("rows").alias("rows"),
        ratio(F.sum("correct"), F.sum("rows")).alias("raw_accuracy"),
        F.avg("accepted_recall").alias("macro_recall"),
        ratio(F.sum("accepted"), F.sum("rows")).alias("coverage"),
        ratio(F.sum("accepted_correct"), F.sum("accepted")).alias("accepted_accuracy"),
        (F.sum("accepted") - F.sum("accepted_correct")).alias("wrong_accepts"),
    )


def label_macro_recall(df: DataFrame, predicted: str, keys: Sequence[str] = (), actual: str = "truth") -> DataFrame:
    """Macro recall that looks at labels only, whether or not they were accepted."""
    classes = df.groupBy(*keys, F.col(actual).alias("__t")).agg(
        ratio(F.count_if(F.col(predicted) == F.col(actual)), F.count(F.lit(1))).alias("__r")
    )
    return classes.groupBy(*keys).agg(F.avg("__r").alias("macro_recall"))


def holdout_report(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Correct, wrong and unknown with precision of the accepted and macro recall (unknown = rejected)."""
    known = F.coalesce(F.col("prediction"), F.lit("unknown"))
    classes = df.groupBy(*keys, "truth").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(known == F.col("truth")).alias("c"),
        F.count_if(known == "unknown").alias("u"),
    )
    return classes.groupBy(*keys).agg(
        F.sum("n").alias("rows"),
        F.sum("c").alias("correct"),
        F.sum(F.col("n") - F.col("c") - F.col("u")).alias("wrong"),
        F.sum("u").alias("unknown"),
        ratio(F.sum("c"), F.sum("n") - F.sum("u")).alias("accepted_precision"),
        ratio(F.sum("u"), F.sum("n")).alias("rejection_rate"),
        F.avg(F.col("c") / F.col("n")).alias("macro_recall"),
    )


def macro_colour(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Macro recall, wrong acceptances and unknowns of colours (columns truth, prediction)."""
    return holdout_report(df, keys).select(
        *keys, F.col("rows").alias("samples"), "macro_recall", F.col("wrong").alias("wrong_acceptance_count"),
        F.col("unknown").alias("unknown_count"),
    )


# Devices that must both meet the latency gate, and the platform of the final runs.
DEPLOYMENT_TARGETS = ("orin_nano", "n100")
FINAL_PLATFORM = "competition"


def promotion_gates(records: DataFrame) -> DataFrame:
    """One row with the metrics, the eleven gates and the verdict over the evaluation records."""
    reviewed = F.coalesce(F.col("human_reviewed"), F.lit(False))
    final = reviewed & (F.col("split") == "final_holdout")
    multi = reviewed & (F.col("split") == "final_acceptance")
    development = reviewed & (F.col("split") == "development")
    measured = final | multi
    rows = records.filter(measured | development)

    def wrong(prefix: str) -> Column:
        return truth(F.col(f"{prefix}_accepted")) & ~F.col(f"{prefix}_label").eqNullSafe(F.col("true_label"))

    totals = rows.agg(
        F.count_if(final).alias("record_count"),
        F.count_if(final & wrong("mono")).alias("mono_wrong"),
        F.count_if(final & wrong("fused")).alias("fused_wrong"),
        F.count_if(multi & wrong("fused")).alias("multi_wrong_accepts"),
        F.count_if(measured & truth(F.col("safety_state_upgraded"))).alias("safety_upgrades"),
        F.count_if(measured & truth(F.col("association_error")) & ~truth(F.col("side_occluded"))).alias(
            "association_errors"
        ),
        F.count_if(multi & truth(F.col("missed_object"))).alias("missed_objects"),
        F.count_distinct(F.when(multi, F.col("scene_id"))).alias("final_scenes"),
        F.count_distinct(F.when(development, F.col("scene_id"))).alias("development_scenes"),
        F.coalesce(
            F.bool_and(F.when(measured, F.coalesce("platform_id", F.lit("")) == FINAL_PLATFORM)), F.lit(False)
        ).alias("platform_ok"),
    )
    holdout = rows.filter(final)
    recalls = holdout.groupBy("true_label").agg(
        ratio(F.count_if(F.col("mono_label") == F.col("true_label")), F.count(F.lit(1))).alias("m"),
        ratio(F.count_if(F.col("fused_label") == F.col("true_label")), F.count(F.lit(1))).alias("f"),
    ).agg(
        F.coalesce(F.avg("m"), F.lit(0.0)).alias("mono_macro_recall"),
        F.coalesce(F.avg("f"), F.lit(0.0)).alias("fused_macro_recall"),
    )
    target = F.lower(F.coalesce("deployment_target", F.lit("")))
    numbers = rows.filter(measured).select(
        F.explode(
            F.array(
                F.struct(F.lit("projection").alias("m"), F.col("projection_error_px").alias("x")),
                F.struct(F.lit("pair_delta").alias("m"), F.col("pair_delta_ms").alias("x")),
                F.struct(F.lit("latency").alias("m"), F.col("latency_ms").alias("x")),
                F.struct(
                    F.when(target.isin(*DEPLOYMENT_TARGETS), target).alias("m"), F.col("latency_ms").alias("x")
                ),
            )
        ).alias("e")
    ).select("e.m", "e.x").filter("m is not null")
    p95 = one_row(
        quantiles(numbers, ["m"], F.col("x"), {"p95": 0.95}),
        "m",
        {
            "projection": "projection_p95_px",
            "pair_delta": "pair_delta_p95_ms",
            "latency": "latency_p95_ms",
            **{t: f"latency_p95_{t}" for t in DEPLOYMENT_TARGETS},
        },
        "p95",
    )
    c = F.col
    row = side_by_side(totals, recalls, p95).withColumns(
        {
            "macro_recall_gain": c("fused_macro_recall") - c("mono_macro_recall"),
            "mono_wrong_accept_rate": ratio(c("mono_wrong"), c("record_count")),
            "fused_wrong_accept_rate": ratio(c("fused_wrong"), c("record_count")),
        }
    )
    devices = truth(c(f"latency_p95_{DEPLOYMENT_TARGETS[0]}") <= 1000)
    for name in DEPLOYMENT_TARGETS[1:]:
        devices = devices & truth(c(f"latency_p95_{name}") <= 1000)
    gates = {
        "gate_recall_gain": c("macro_recall_gain") >= 0.03,
        "gate_wrong_accept_zero": c("fused_wrong") == 0,
        "gate_multi_wrong_accept_zero": c("multi_wrong_accepts") == 0,
        "gate_scene_counts": (c("development_scenes") >= 30) & (c("final_scenes") >= 30),
        "gate_no_missed_object": c("missed_objects") == 0,
        "gate_no_safety_upgrade": c("safety_upgrades") == 0,
        "gate_no_association_error": c("association_errors") == 0,
        "gate_projection": truth(c("projection_p95_px") <= 3.0),
        "gate_pair_delta": truth(c("pair_delta_p95_ms") <= 50.0),
        "gate_latency": devices,
        "gate_platform": c("platform_ok"),
    }
    row = row.withColumns(gates)
    verdict = c("record_count") > 0
    for name in gates:
        verdict = verdict & c(name)
    return row.withColumn("promote", verdict)


def metric_gates(
    metrics: DataFrame, run: str, scope: Sequence[str], old: str, new: str, gates: dict[str, tuple[str, str]]
) -> DataFrame:
    """Compares two runs per scope. ``gates`` maps a gate name to (metric, one of gt, ge, lt, le).

    A metric missing on either side fails its gate.
    """
    compare = {
        "gt": lambda n, o: n > o,
        "ge": lambda n, o: n >= o,
        "lt": lambda n, o: n < o,
        "le": lambda n, o: n <= o,
    }
    names = sorted({metric for metric, _ in gates.values()})
    wide = metrics.groupBy(*scope).agg(
        *[F.max(F.when(F.col(run) == old, F.col(m))).alias(f"__o_{m}") for m in names],
        *[F.max(F.when(F.col(run) == new, F.col(m))).alias(f"__n_{m}") for m in names],
    )
    return wide.select(
        *scope,
        *[
            truth(compare[op](F.col(f"__n_{m}"), F.col(f"__o_{m}"))).alias(name)
            for name, (m, op) in gates.items()
        ],
    )


def class_delta_gate(
    df: DataFrame, old: str, new: str, *, min_gain: float = 0.03, max_drop: float = 0.05
) -> DataFrame:
    """Macro gain and worst class change between two predictions of the same rows, with the verdict."""
    classes = df.groupBy("truth").agg(
        ratio(F.count_if(F.col(old) == F.col("truth")), F.count(F.lit(1))).alias("o"),
        ratio(F.count_if(F.col(new) == F.col("truth")), F.count(F.lit(1))).alias("n"),
    )
    return classes.agg(
        (F.avg("n") - F.avg("o")).alias("macro_delta"), F.min(F.col("n") - F.col("o")).alias("worst_class_delta")
    ).withColumn(
        "passed", (F.col("macro_delta") >= min_gain) & (F.col("worst_class_delta") >= -max_drop)
    )


def corrected_damaged(paired: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows fixed and broken by a change (columns truth, before, after)."""
    was = F.col("before").eqNullSafe(F.col("truth"))
    now = F.col("after").eqNullSafe(F.col("truth"))
    return paired.groupBy(*keys).agg(
        F.count_if(~was & now).alias("corrected"),
        F.count_if(was & ~now).alias("damaged"),
        (F.count_if(~was & now) - F.count_if(was & ~now)).alias("net"),
    )


def changed_rows(paired: DataFrame, key: str) -> DataFrame:
    was = F.col("before").eqNullSafe(F.col("truth"))
    now = F.col("after").eqNullSafe(F.col("truth"))
    kind = F.when(~was & now, "corrected").when(was & ~now, "damaged")
    return paired.select(key, kind.alias("change")).filter("change is not null")


def change_summary(paired: DataFrame) -> DataFrame:
    """Boxes changed, pixels up and down, objects found and lost (before_*/after_* box and pixels)."""
    old, new = F.col("before_box"), F.col("after_box")
    before, after = F.coalesce("before_pixels", F.lit(0)), F.coalesce("after_pixels", F.lit(0))
    return paired.agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(old.isNull()).alias("before_missing"),
        F.count_if(new.isNull()).alias("after_missing"),
        F.count_if(~old.eqNullSafe(new)).alias("box_changed"),
        F.count_if(after > before).alias("pixels_increased"),
        F.count_if(after < before).alias("pixels_decreased"),
        F.count_if(old.isNull() & new.isNotNull()).alias("newly_detected"),
        F.count_if(old.isNotNull() & new.isNull()).alias("newly_missing"),
    )


def composition_match(expected: DataFrame, predicted: DataFrame, frame: str = "frame_id") -> DataFrame:
    """Expected against predicted label multisets per frame (one row per object on both sides)."""
    both = expected.select(frame, F.col("label"), F.lit(1).alias("e"), F.lit(0).alias("p")).unionByName(
        predicted.select(frame, F.col("label"), F.lit(0).alias("e"), F.lit(1).alias("p"))
    )
    counts = both.groupBy(frame, "label").agg(F.sum("e").alias("e"), F.sum("p").alias("p"))
    return counts.groupBy(frame).agg(
        F.sum("e").alias("expected"),
        F.sum("p").alias("predicted"),
        F.sum(F.least("e", "p")).alias("overlap"),
        (F.sum("e") == F.sum("p")).alias("count_match"),
        F.bool_and(F.col("e") == F.col("p")).alias("exact_match"),
    )


def composition_totals(matches: DataFrame) -> DataFrame:
    return matches.agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if("count_match").alias("count_matches"),
        F.count_if("exact_match").alias("exact_matches"),
        F.sum("expected").alias("expected"),
        F.sum("predicted").alias("predicted"),
        F.sum("overlap").alias("overlap"),
    )


def review_inventory(objects: DataFrame, statuses: Sequence[str], keys: Sequence[str] = ("frame_id",)) -> DataFrame:
    """Candidates, unknown shapes, selected objects and a count per status for every frame."""
    return objects.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(F.coalesce("shape", F.lit("unknown")) == "unknown").alias("unknown"),
        F.count_if(F.col("selected")).alias("selected"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in statuses],
    )


def modal_outliers(counts: DataFrame, batch: str, frame: str, value: str) -> DataFrame:
    """Frames whose value differs from their batch's mode; a tie goes to the value met first."""
    tally = counts.groupBy(batch, value).agg(F.count(F.lit(1)).alias("__n"), F.min(frame).alias("__first"))
    modes = tally.groupBy(batch).agg(F.min_by(value, F.struct(-F.col("__n"), F.col("__first"))).alias("mode"))
    return counts.join(modes, batch).filter(F.col(value) != F.col("mode"))


def latency_profile(df: DataFrame, stages: str, *, target_ms: float = 1000.0) -> DataFrame:
    """Median, 95th percentile and mean per stage (a map column) and for the total of all stages."""
    total = F.aggregate(F.map_values(stages), F.lit(0.0), lambda a, x: a + x)
    long = df.select(F.explode(F.map_concat(stages, F.create_map(F.lit("total"), total))).alias("stage", "ms"))
    means = long.groupBy("stage").agg(F.avg("ms").alias("mean_ms"), F.count(F.lit(1)).alias("samples"))
    marks = quantiles(long, ["stage"], F.col("ms"), {"p50_ms": 0.5, "p95_ms": 0.95})
    return means.join(marks, "stage").withColumn("target_met", F.col("p95_ms") <= target_ms)


def nearest_rank_p95(df: DataFrame, keys: Sequence[str], value: Column, name: str = "p95") -> DataFrame:
    return quantiles(df, keys, value, {name: 0.95}, method="nearest")


def sorted_alignment(df: DataFrame, frame: str = "frame_id", actual: str = "truth", predicted: str = "prediction") -> DataFrame:
    """Positions at which the two sorted label lists of a frame agree, 0 when their lengths differ.

    Each label fills one interval of positions in either sorted list, so the agreement is the overlap of
    the intervals; label counts per frame are enough and no list is built.
    """
    both = df.select(
        frame,
        F.explode(
            F.array(
                F.struct(F.col(actual).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")),
                F.struct(F.col(predicted).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")),
            )
        ).alias("e"),
    ).select(frame, "e.*").filter("label is not null")
    counts = both.groupBy(frame, "label").agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
    along = Window.partitionBy(frame).orderBy("label")
    placed = counts.withColumn("t_end", F.sum("t").over(along)).withColumn("p_end", F.sum("p").over(along))
    shared = F.least("t_end", "p_end") - F.greatest(F.col("t_end") - F.col("t"), F.col("p_end") - F.col("p"))
    return placed.groupBy(frame).agg(
        F.sum("t").alias("expected"),
        F.sum("p").alias("detected"),
        F.when(F.sum("t") == F.sum("p"), F.sum(F.greatest(shared, F.lit(0)))).otherwise(F.lit(0)).alias("correct"),
    )


def edge_audit(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Acceptance, coverage and edge counts (columns accepted, edges, rejected_edges)."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("images"),
        F.count_if("accepted").alias("accepted_images"),
        ratio(F.count_if("accepted"), F.count(F.lit(1))).alias("coverage_rate"),
        ratio(F.count_if(F.col("edges") >= 2), F.count(F.lit(1))).alias("two_edges_rate"),
        F.avg("edges").alias("mean_edges"),
        F.sum("edges").alias("fused_edges"),
        F.sum("rejected_edges").alias("rejected_edges"),
    )


def structure_audit(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Clean-structure, dangling, overlap and internal-line rates."""
    return df.groupBy(*keys).agg(
        ratio(F.count_if("accepted"), F.count(F.lit(1))).alias("clean_rate"),
        ratio(F.count_if(F.col("dangling") == 0), F.count(F.lit(1))).alias("zero_dangling_rate"),
        F.avg("outer_iou").alias("mean_iou"),
        F.avg("rejected_ratio").alias("mean_rejected_ratio"),
        ratio(F.count_if(F.col("internal_lines") > 0), F.count(F.lit(1))).alias("line_coverage"),
    )


def line_precision_recall(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Precision and recall as ratios of sums."""
    return df.groupBy(*keys).agg(
        ratio(F.sum("matched_predicted"), F.sum("predicted_support")).alias("precision"),
        ratio(F.sum("matched_true"), F.sum("true_support")).alias("recall"),
    )


def mask_iou(predicted: DataFrame, actual: DataFrame, keys: Sequence[str], cell: Sequence[str]) -> DataFrame:
    """IoU, missed and excess fraction of two pixel sets per key, in one grouping and no join."""
    marks = predicted.select(*keys, *cell, F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(
        actual.select(*keys, *cell, F.lit(0).alias("p"), F.lit(1).alias("t"))
    )
    pixels = marks.groupBy(*keys, *cell).agg(F.max("p").alias("p"), F.max("t").alias("t"))
    both = F.count_if((F.col("p") == 1) & (F.col("t") == 1))
    return pixels.groupBy(*keys).agg(
        ratio(both, F.count(F.lit(1))).alias("iou"),
        ratio(F.count_if((F.col("p") == 0) & (F.col("t") == 1)), F.sum("t")).alias("missed_fraction"),
        ratio(F.count_if((F.col("p") == 1) & (F.col("t") == 0)), F.sum("p")).alias("excess_fraction"),
    )


def sparse_summary(objects: DataFrame, rejections: DataFrame) -> DataFrame:
    """Long summary of two-view matching: states, nodes, edges, frames with either, rejection reasons, p95.

    ``objects`` has frame_id, state, nodes, edges, max_error; ``rejections`` has reason.
    """

    def section(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("section"), F.col("key").cast("string"), F.col("value").cast("double"))

    states = objects.groupBy(F.col("state").alias("key")).agg(F.count(F.lit(1)).alias("value"))
    reasons = rejections.groupBy(F.col("reason").alias("key")).agg(F.count(F.lit(1)).alias("value"))
    totals = objects.agg(
        F.sum("nodes").alias("nodes"),
        F.sum("edges").alias("edges"),
        F.count_distinct(F.when(F.col("nodes") > 0, F.col("frame_id"))).alias("frames_with_nodes"),
        F.count_distinct(F.when(F.col("edges") > 0, F.col("frame_id"))).alias("frames_with_edges"),
    )
    names = totals.columns
    long = totals.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in names])).alias("e")
    ).select("e.*")
    p95 = quantiles(objects.filter("nodes > 0"), [], F.col("max_error"), {"value": 0.95}).select(
        F.lit("reprojection_p95").alias("key"), "value"
    )
    return (
        section(states, "state")
        .unionByName(section(reasons, "rejection"))
        .unionByName(section(long, "total"))
        .unionByName(section(p95, "error"))
    )


def fusion_summary(objects: DataFrame) -> DataFrame:
    """State counts with wrong pickables, illegal upgrades, accuracy and hash mismatches per state."""
    wrong = (F.col("status") == "PICKABLE") & ~F.col("shape").eqNullSafe(F.col("truth"))
    return objects.groupBy(F.coalesce("fusion_state", F.lit("NO_DUAL_RESULT")).alias("fusion_state")).agg(
        F.count(F.lit(1)).alias("objects"),
        F.count_if(wrong).alias("wrong_pickable"),
        F.count_if(F.col("illegal")).alias("illegal_upgrades"),
        F.count_if("selected").alias("selected"),
        ratio(F.count_if(F.col("shape") == F.col("truth")), F.count(F.lit(1))).alias("accuracy"),
        F.count_if(F.col("hash") != F.col("expected_hash")).alias("hash_mismatches"),
    )


def backend_parity(df: DataFrame, reference: str, requested: Sequence[str], *, limit_ms: float = 1000.0) -> DataFrame:
    """Mismatches of each requested backend against the reference one, p95 and verdict.

    Needs backend, sample, label, accepted, latency_ms.
    """
    base = df.filter(F.col("backend") == reference).select(
        "sample", F.col("label").alias("__l"), F.col("accepted").alias("__a")
    )
    compared = df.join(base, "sample", "left")
    differs = ~(F.col("label").eqNullSafe(F.col("__l")) & F.col("accepted").eqNullSafe(F.col("__a")))
    counts = compared.groupBy("backend").agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(differs).alias("mismatches")
    )
    p95 = quantiles(df, ["backend"], F.col("latency_ms"), {"p95_ms": 0.95})
    asked = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, requested))).alias("backend"))
    return asked.join(counts, "backend", "left").join(p95, "backend", "left").select(
        "backend",
        F.col("samples").isNotNull().alias("tested"),
        F.coalesce("samples", F.lit(0)).alias("samples"),
        F.coalesce("mismatches", F.lit(0)).alias("mismatches"),
        "p95_ms",
        truth((F.col("mismatches") == 0) & (F.col("p95_ms") <= limit_ms)).alias("passed"),
    )


def robust_outliers(df: DataFrame, keys: Sequence[str], value: str, *, floor: float = 1.2, factor: float = 3.0) -> DataFrame:
    """Rows above max(floor, median + factor * 1.4826 * MAD) of their set."""
    limits = mad(df, keys, F.col(value)).withColumn(
        "limit", F.greatest(F.lit(floor), F.col("median") + factor * 1.4826 * F.col("mad"))
    )
    return df.join(limits.select(*keys, "limit"), list(keys)).withColumn("outlier", F.col(value) > F.col("limit"))
