"""Score maps: normalising, scaling, fusing and deciding.

Ties between labels always go to the smaller label.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.functions.numeric import clip, truth

FUSION_METHODS = ("probability_sum", "log_product", "top2_logistic", "evidence_adaptive")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once.

    A column used inside a lambda, or several times by array functions, is otherwise computed anew at each
    use, which multiplies with nesting.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _mean(values: Column) -> Column:
    return _total(values) / F.size(values)


def _std(values: Column) -> Column:
    return let(_mean(values), lambda m: F.sqrt(_mean(F.transform(values, lambda x: (x - m) * (x - m)))))


def array_median(values: Column) -> Column:
    def middle(ordered: Column) -> Column:
        size = F.size(ordered)
        low, high = F.floor((size - 1) / 2).cast("int"), F.floor(size / 2).cast("int")
        return (F.get(ordered, low) + F.get(ordered, high)) / 2.0

    return let(F.array_sort(values), middle)


def _nothing(scores: Column) -> Column:
    return F.map_filter(scores, lambda k, v: F.lit(False))


def normalize_scores(scores: Column) -> Column:
    def shares(positive: Column) -> Column:
        return let(
            _total(F.map_values(positive)),
            lambda total: F.when(total > 0, F.transform_values(positive, lambda _, v: v / total)).otherwise(
                _nothing(positive)
            ),
        )

    return let(F.transform_values(scores, lambda _, v: F.greatest(F.lit(0.0), v)), shares)


def temperature_scale(scores: Column, temperature: Column | float) -> Column:
    heat = F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature
    power = F.lit(1.0) / F.greatest(heat, F.lit(1e-3))
    return normalize_scores(
        F.transform_values(normalize_scores(scores), lambda _, v: F.pow(F.greatest(v, F.lit(1e-9)), power))
    )


def _softmax(keys: Column, filled: Column, scale: Column) -> Column:
    weights = let(
        F.array_min(filled), lambda low: let(scale, lambda s: F.transform(filled, lambda d: F.exp(-(d - low) / s)))
    )
    return let(
        weights,
        lambda w: let(
            F.greatest(_total(w), F.lit(1e-12)), lambda t: F.map_from_arrays(keys, F.transform(w, lambda x: x / t))
        ),
    )


def _finite(values: Column) -> Column:
    return F.filter(values, lambda d: d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf")))


def _filled(distances: Column, ceiling: Callable[[Column], Column], body: Callable[[Column], Column]) -> Column:
    """``body`` of the distance array with gaps replaced by a ceiling over the finite ones."""
    values = F.map_values(distances)
    return let(
        ceiling(_finite(values)),
        lambda top: let(
            F.transform(values, lambda d: F.when(truth(F.abs(d) < float("inf")), d).otherwise(top)), body
        ),
    )


def softmax_mad(distances: Column, temperature: float = 1.0) -> Column:
    """Distances to probabilities; scale is the median absolute deviation, at least 0.05.

    A class without a distance gets the largest one plus four standard deviations (at least four).
    """
    heat = max(float(temperature), 1e-3)

    def ceiling(finite: Column) -> Column:
        return F.array_max(finite) + F.greatest(_std(finite), F.lit(1.0)) * 4.0

    def body(filled: Column) -> Column:
        spread = let(array_median(filled), lambda m: array_median(F.transform(filled, lambda d: F.abs(d - m))))
        return _softmax(F.map_keys(distances), filled, F.greatest(spread, F.lit(0.05)) * heat)

    known = F.size(_finite(F.map_values(distances))) > 0
    return F.when(known, _filled(distances, ceiling, body)).otherwise(_nothing(distances))


def softmax_std(distances: Column) -> Column:
    """Distances to probabilities; scale is the standard deviation, at least 0.10."""
    return _filled(
        distances,
        lambda finite: F.array_max(finite) + 5.0,
        lambda filled: _softmax(F.map_keys(distances), filled, F.greatest(_std(filled), F.lit(0.10))),
    )


def ranked(scores: Column) -> Column:
    """Entries as (label, p), best first."""
    entries = F.transform(
        F.map_entries(scores),
        lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("label"), e["value"].alias("p")),
    )
    return F.transform(
        F.array_sort(entries), lambda e: F.struct(e["label"].alias("label"), e["p"].alias("p"))
    )


def top2_margin(scores: Column) -> Column:
    """Struct of best label, its probability, runner-up and the gap between them."""

    def pick(order: Column) -> Column:
        best, second = F.get(order, F.lit(0)), F.get(order, F.lit(1))
        return F.struct(
            F.coalesce(best["label"], F.lit("unknown")).alias("label"),
            F.coalesce(best["p"], F.lit(0.0)).alias("probability"),
            second["label"].alias("second"),
            (F.coalesce(best["p"], F.lit(0.0)) - F.coalesce(second["p"], F.lit(0.0))).alias("margin"),
        )

    return let(ranked(scores), pick)


def shape_family(label: Column) -> Column:
    return (
        F.when(label.endswith("_prism"), "prism")
        .when(label.endswith("_pyramid"), "pyramid")
        .when(label == "octahedron", "bipyramid")
        .when(label.isin("cone", "cylinder"), "round")
        .otherwise(label)
    )


def pair_reliability(first: Column, second: Column, same_family_scale: Column | float = 0.35) -> Column:
    """How far the side view can tell two classes apart (only scales side evidence)."""
    scale = clip(same_family_scale if isinstance(same_family_scale, Column) else F.lit(same_family_scale), 0.0, 1.0)
    family, other = shape_family(first), shape_family(second)
    round_pair = (
        first.isin("cone", "cylinder") & second.isin("cone", "cylinder") & (first != second)
    )
    return (
        F.when(round_pair | (family != other), F.lit(1.0))
        .when(family == "pyramid", F.greatest(scale, F.lit(0.45)))
        .when(family == "prism", scale)
        .otherwise(F.lit(0.75))
    )


def top2_features(top_a: Column, top_b: Column, side_a: Column, side_b: Column, quality: Column) -> list[Column]:
    """Five numbers describing two candidates: log ratios, quality and differences."""
    floor = F.lit(1e-8)
    ta, tb, sa, sb = (F.greatest(F.coalesce(x, F.lit(0.0)), floor) for x in (top_a, top_b, side_a, side_b))
    return [F.ln(ta / tb), F.ln(sa / sb), clip(quality, 0.0, 1.0), ta - tb, sa - sb]


def fuse_pair(
    top_a: Column,
    top_b: Column,
    side_a: Column,
    side_b: Column,
    label_a: Column,
    label_b: Column,
    quality: Column,
    *,
    method: str = "log_product",
    side_weight: Column | float = 0.30,
    topology: Column | float = 0.0,
    same_family_scale: Column | float = 0.35,
    guard_strength: Column | float = 0.65,
    weights: Sequence[float] = (),
    bias: float = 0.0,
) -> Column:
    """Fused probability of the first of two candidates whose shares are normalised to one."""
    if method not in FUSION_METHODS:
        raise ValueError(f"unsupported fusion method: {method}")

    def lit(x):
        return x if isinstance(x, Column) else F.lit(float(x))

    effective = clip(lit(side_weight) * quality, 0.0, 0.95)
    if method == "evidence_adaptive":
        guard = F.lit(1.0) - clip(lit(guard_strength), 0.0, 1.0) * clip(lit(topology), 0.0, 1.0)
        reliability = pair_reliability(label_a, label_b, lit(same_family_scale))
        effective = clip(effective * reliability * guard, 0.0, 0.95)
    if method == "probability_sum":
        a = (1.0 - effective) * top_a + effective * side_a
        b = (1.0 - effective) * top_b + effective * side_b
        return a / (a + b)
    if method == "top2_logistic":
        if len(weights) != 5:
            raise ValueError("top2_logistic needs five weights")
        features = top2_features(top_a, top_b, side_a, side_b, quality)
        logit = F.lit(float(bias))
        for weight, feature in zip(weights, features):
            logit = logit + float(weight) * feature
        return 1.0 / (1.0 + F.exp(-clip(logit, -40.0, 40.0)))

    def logged(p: Column) -> Column:
        return F.ln(F.greatest(p, F.lit(1e-9)))

    gap = (1.0 - effective) * (logged(top_b) - logged(top_a)) + effective * (logged(side_b) - logged(side_a))
    return 1.0 / (1.0 + F.exp(gap))


def fuse(top: Column, side: Column, quality: Column, **options) -> Column:
    """Array of (label, p) over the two best primary classes, fused with the side view."""

    def entry(label: Column, value: Column) -> Column:
        return F.struct(label.alias("label"), value.alias("p"))

    def pair(order: Column) -> Column:
        a, b = F.get(order, F.lit(0)), F.get(order, F.lit(1))
        zero = F.lit(0.0)
        shares = F.struct(
            F.greatest(a["p"], zero).alias("ta"),
            F.greatest(b["p"], zero).alias("tb"),
            F.greatest(F.coalesce(F.try_element_at(side, a["label"]), zero), zero).alias("sa"),
            F.greatest(F.coalesce(F.try_element_at(side, b["label"]), zero), zero).alias("sb"),
        )

        def joined(x: Column) -> Column:
            top_sum, side_sum = x["ta"] + x["tb"], x["sa"] + x["sb"]
            ta = x["ta"] / top_sum
            fused = fuse_pair(
                ta, x["tb"] / top_sum, x["sa"] / side_sum, x["sb"] / side_sum, a["label"], b["label"], quality, **options
            )
            return F.when(truth(side_sum > 0), fused).otherwise(ta)

        both = let(let(shares, joined), lambda p: F.array(entry(a["label"], p), entry(b["label"], 1.0 - p)))
        return (
            F.when(F.size(order) == 0, F.filter(order, lambda e: F.lit(False)))
            .when(F.size(order) == 1, F.array(entry(a["label"], F.lit(1.0))))
            .otherwise(both)
        )

    return let(ranked(top), pair)


def fusion_decision(
    top: Column,
    side: Column,
    quality: Column,
    *,
    top_reason: Column,
    side_reason: Column,
    minimum_side_quality: float = 0.60,
    top_only_probability: float = 0.85,
    probability_threshold: float = 0.72,
    margin_threshold: float = 0.12,
    conflict_probability: float = 0.75,
    **options,
) -> Column:
    """Winner, probability, margin and acceptance of a fused pair of score maps."""
    degraded = (quality < minimum_side_quality) | (side_reason != "accepted") | (F.size(side) == 0)
    entries = F.when(degraded, ranked(top)).otherwise(fuse(top, side, quality, **options))
    ordered = F.transform(
        F.array_sort(
            F.transform(entries, lambda e: F.struct((-e["p"]).alias("n"), e["label"].alias("label")))
        ),
        lambda e: F.struct(e["label"].alias("label"), (-e["n"]).alias("p")),
    )

    def decide(x: Column) -> Column:
        order, top_best, side_best, weak = x["order"], x["top"], x["side"], x["degraded"]
        best, second = F.get(order, F.lit(0)), F.get(order, F.lit(1))
        probability = F.coalesce(best["p"], F.lit(0.0))
        margin = probability - F.coalesce(second["p"], F.lit(0.0))
        conflict = (
            ~weak
            & (top_best["probability"] >= conflict_probability)
            & (side_best["probability"] >= conflict_probability)
            & (top_best["label"] != side_best["label"])
        )
        alone = (top_reason == "accepted") & (probability >= top_only_probability)
        joint = (
            top_reason.isin("accepted", "margin_rejected")
            & (F.size(order) > 0)
            & (probability >= probability_threshold)
            & (margin >= margin_threshold)
        )
        accepted = F.when(weak, alone).otherwise(joint) & ~conflict
        return F.struct(
            F.coalesce(best["label"], F.lit("unknown")).alias("winner"),
            probability.alias("probability"),
            margin.alias("margin"),
            weak.alias("degraded"),
            conflict.alias("conflict"),
            accepted.alias("accepted"),
        )

    parts = F.struct(
        ordered.alias("order"),
        top2_margin(top).alias("top"),
        top2_margin(side).alias("side"),
        degraded.alias("degraded"),
    )
    return let(parts, decide)


def apply_decision(
    status: Column,
    selected: Column,
    decision: Column,
    *,
    top_reason: Column,
    upgrade_allowed: Column,
    usable: Column,
    top_probability: Column,
    top_only_probability: float = 0.85,
    missing_state: Column,
) -> Column:
    """New status, selection and state of an object.

    Only a margin-rejected object that is allowed to may rise to PICKABLE; states of a failed depth,
    a covered object or a missing grasp never change. Without usable side evidence a PICKABLE object
    must reach the stricter single-view probability.
    """
    soft = status.isin("PICKABLE", "UNCERTAIN")
    refused = F.when(soft, F.lit("UNCERTAIN")).otherwise(status)
    raised = F.when(
        (status == "UNCERTAIN") & (top_reason == "margin_rejected") & truth(upgrade_allowed), F.lit("PICKABLE")
    ).otherwise(status)
    weak = (status == "PICKABLE") & (top_probability < top_only_probability)
    single = F.when(weak, F.lit("UNCERTAIN")).otherwise(status)
    accepted = decision["accepted"]
    new_status = F.when(~usable, single).when(decision["conflict"] | ~accepted, refused).otherwise(raised)
    keep = (
        F.when(~usable, selected & ~weak)
        .when(decision["conflict"] | ~accepted, F.lit(False))
        .otherwise(selected & (new_status == "PICKABLE"))
    )
    state = (
        F.when(~usable, missing_state)
        .when(decision["conflict"], F.lit("CONFLICT"))
        .when(accepted, F.lit("FUSED"))
        .otherwise(F.lit("TOP_ONLY"))
    )
    return F.struct(new_status.alias("status"), keep.alias("selected"), state.alias("state"))


def negative_log_likelihood(p: Column) -> Column:
    return -F.ln(F.greatest(p, F.lit(1e-9)))


def weighted_sum(terms: Sequence[tuple[float, Column]], wrap: Callable[[Column], Column] | None = None) -> Column:
    total = None
    for weight, term in terms:
        part = F.lit(float(weight)) * term
        total = part if total is None else total + part
    return wrap(total) if wrap else total
