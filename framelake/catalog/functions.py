"""FN1-FN30."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.catalog.base import query
from framelake.catalog.projections import part_aliases
from framelake.catalog.views import detections, frames, points, scores, segments, table, vectors
from framelake.functions import geometry as G
from framelake.functions import labels
from framelake.functions import numeric as N
from framelake.functions import scores as S
from framelake.operators import audits
from framelake.operators import segments as seg_ops

ORDER = [f"c{i}" for i in range(10)]


def wide(column, names=ORDER, digits=6, prefix=""):
    return [F.round(F.try_element_at(column, F.lit(n)), digits).alias(prefix + n) for n in names]


def _pivot(value, names=ORDER):
    return ", ".join(f"round(max(CASE WHEN cls = '{n}' THEN {value} END), 6) AS {n}" for n in names)


@query(
    "fn1_normalize_scores",
    f"""WITH n AS (SELECT id, cls, greatest(p - 1, 0) AS p FROM scores), t AS (SELECT id, sum(p) AS tot FROM n GROUP BY 1)
    SELECT id, {_pivot('p / tot')} FROM n JOIN t USING (id) GROUP BY 1""",
    ("vec", "scores"),
)
def _(spark, sf):
    shifted = F.transform_values("top", lambda _, v: v - 1.0)
    return scores(spark, sf).withColumn("m", S.normalize_scores(shifted)).select("id", *wide(F.col("m")))


TEMP_SQL = """tn AS (SELECT id, label, cls, k, quality, topology, p / sum(p) OVER (PARTITION BY id) AS p, s / sum(s) OVER (PARTITION BY id) AS s FROM scores)"""


@query(
    "fn2_temperature_scale",
    f"""WITH {TEMP_SQL}, w AS (SELECT id, cls, pow(greatest(p, 1e-9), 1 / 1.7::DOUBLE) AS w FROM tn), t AS (SELECT id, sum(w) AS tot FROM w GROUP BY 1)
    SELECT id, {_pivot('w / tot')} FROM w JOIN t USING (id) GROUP BY 1""",
    ("vec", "scores"),
)
def _(spark, sf):
    return scores(spark, sf).withColumn("m", S.temperature_scale(F.col("top"), 1.7)).select("id", *wide(F.col("m")))


DIST_SQL = """ds AS (SELECT id, cls, CASE WHEN (id + k) % 9 = 0 THEN NULL ELSE s END AS d FROM scores),
  fs AS (SELECT id, max(d) + greatest(stddev_pop(d), 1) * 4 AS ceil4, max(d) + 5 AS ceil5 FROM ds GROUP BY 1)"""


def _distances(spark, sf):
    entries = F.transform(
        F.map_entries("side"),
        lambda e: F.struct(
            e["key"], F.when((F.col("id") + F.substring(e["key"], 2, 9).cast("int")) % 9 != 0, e["value"]).alias("value")
        ),
    )
    return scores(spark, sf).select("id", F.map_from_entries(entries).alias("d"))


@query(
    "fn3_softmax_mad",
    f"""WITH {DIST_SQL}, f AS (SELECT id, cls, coalesce(d, ceil4) AS d FROM ds JOIN fs USING (id)), m AS (SELECT id, median(d) AS med, min(d) AS lo FROM f GROUP BY 1),
     a AS (SELECT id, median(abs(d - med)) AS mad FROM f JOIN m USING (id) GROUP BY 1), e AS (SELECT id, cls, exp(-(d - lo) / (greatest(mad, 0.05) * 1.5)) AS w FROM f JOIN m USING (id) JOIN a USING (id)),
     t AS (SELECT id, sum(w) AS tot FROM e GROUP BY 1)
    SELECT id, {_pivot('w / tot')} FROM e JOIN t USING (id) GROUP BY 1""",
    ("vec", "scores"),
)
def _(spark, sf):
    return _distances(spark, sf).withColumn("m", S.softmax_mad(F.col("d"), 1.5)).select("id", *wide(F.col("m")))


@query(
    "fn4_softmax_std",
    f"""WITH {DIST_SQL}, f AS (SELECT id, cls, coalesce(d, ceil5) AS d FROM ds JOIN fs USING (id)), m AS (SELECT id, min(d) AS lo, greatest(stddev_pop(d), 0.1) AS sc FROM f GROUP BY 1),
     e AS (SELECT id, cls, exp(-(d - lo) / sc) AS w FROM f JOIN m USING (id)), t AS (SELECT id, sum(w) AS tot FROM e GROUP BY 1)
    SELECT id, {_pivot('w / tot')} FROM e JOIN t USING (id) GROUP BY 1""",
    ("vec", "scores"),
)
def _(spark, sf):
    return _distances(spark, sf).withColumn("m", S.softmax_std(F.col("d"))).select("id", *wide(F.col("m")))


@query(
    "fn5_combined_confidence",
    """WITH p AS (SELECT frame_id, object_id, [confidence, tax * 12, price / 100000, w / 50, 1.0::DOUBLE - tax] AS c FROM det)
    SELECT frame_id, object_id, round(exp(list_avg(list_transform(c, lambda x: ln(greatest(1e-6, least(1, x)))))), 6) AS combined,
     round(exp(list_avg(list_transform(c[1:4], lambda x: ln(greatest(1e-6, least(1, x)))))), 6) AS combined_2d FROM p""",
    "det",
)
def _(spark, sf):
    c = F.col
    parts = [c("confidence"), c("tax") * 12, c("price") / 100000, c("w") / 50, F.lit(1.0) - c("tax")]
    return detections(spark, sf).select(
        "frame_id", "object_id", F.round(N.geometric_mean(*parts), 6).alias("combined"),
        F.round(N.geometric_mean(*parts[:4]), 6).alias("combined_2d"),
    )


TOP2_SQL = f"""{TEMP_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, cls) AS r, row_number() OVER (PARTITION BY id ORDER BY s DESC, cls) AS rs FROM tn),
  pr AS (SELECT a.id, a.label, a.quality, a.topology, a.cls AS la, b.cls AS lb, a.p AS pa, b.p AS pb, a.s AS sa, b.s AS sb, a.p / (a.p + b.p) AS ta, b.p / (a.p + b.p) AS tb, a.s / (a.s + b.s) AS xa, b.s / (a.s + b.s) AS xb,
    sm.cls AS ls, sm.s AS smax FROM rk a JOIN rk b ON a.id = b.id AND a.r = 1 AND b.r = 2 JOIN rk sm ON sm.id = a.id AND sm.rs = 1)"""


def normalized(spark, sf):
    return scores(spark, sf).select(
        "id", "label", "quality", "topology", S.normalize_scores(F.col("top")).alias("top"), S.normalize_scores(F.col("side")).alias("side")
    )


@query(
    "fn6_top2_features",
    f"""WITH {TOP2_SQL} SELECT id, round(ln(pa / pb), 6) AS top_log_ratio, round(ln(sa / sb), 6) AS side_log_ratio, round(quality, 6) AS quality, round(pa - pb, 6) AS top_gap, round(sa - sb, 6) AS side_gap FROM pr""",
    ("vec", "scores"),
)
def _(spark, sf):
    order = S.ranked(F.col("top"))
    base = normalized(spark, sf).select("id", "quality", "side", F.get(order, F.lit(0)).alias("a"), F.get(order, F.lit(1)).alias("b"))
    side = lambda c: F.try_element_at("side", F.col(f"{c}.label"))
    feats = S.top2_features(F.col("a.p"), F.col("b.p"), side("a"), side("b"), F.col("quality"))
    names = ("top_log_ratio", "side_log_ratio", "quality", "top_gap", "side_gap")
    return base.select("id", *[F.round(f, 6).alias(n) for f, n in zip(feats, names)])


SHAPES = ["cone", "cylinder", "cube", "hexagonal_prism", "pentagonal_prism", "square_pyramid", "triangular_pyramid", "octahedron", "sphere", "triangular_prism"]
_FAMILY = "CASE WHEN {x} LIKE '%\\_prism' ESCAPE '\\' THEN 'prism' WHEN {x} LIKE '%\\_pyramid' ESCAPE '\\' THEN 'pyramid' WHEN {x} = 'octahedron' THEN 'bipyramid' WHEN {x} IN ('cone', 'cylinder') THEN 'round' ELSE {x} END"
_RELIABLE = f"""CASE WHEN ({{a}} IN ('cone', 'cylinder') AND {{b}} IN ('cone', 'cylinder') AND {{a}} <> {{b}}) OR {_FAMILY.format(x='{a}')} <> {_FAMILY.format(x='{b}')} THEN 1.0
  WHEN {_FAMILY.format(x='{a}')} = 'pyramid' THEN 0.45 WHEN {_FAMILY.format(x='{a}')} = 'prism' THEN 0.35 ELSE 0.75 END"""
_NAMED = "CASE {x} " + " ".join(f"WHEN 'c{i}' THEN '{n}'" for i, n in enumerate(SHAPES)) + " END"

FUSE_SQL = f"""{TOP2_SQL}, nm AS (SELECT *, {_NAMED.format(x='la')} AS na, {_NAMED.format(x='lb')} AS nb FROM pr),
  ef AS (SELECT *, least(0.95, 0.3 * quality) AS e, least(0.95, least(0.95, 0.3 * quality) * ({_RELIABLE.format(a='na', b='nb')}) * (1 - 0.65 * topology)) AS ea FROM nm),
  fu AS (SELECT *, ((1 - e) * ta + e * xa) AS f_sum, 1 / (1 + exp((1 - e) * (ln(tb) - ln(ta)) + e * (ln(xb) - ln(xa)))) AS f_log, 1 / (1 + exp((1 - ea) * (ln(tb) - ln(ta)) + ea * (ln(xb) - ln(xa)))) AS f_evi,
    1 / (1 + exp(-greatest(-40, least(40, ln(ta / tb) + 0.3 * ln(xa / xb) + 0.1 * quality + 0.2 * (ta - tb) + 0.1 * (xa - xb) - 0.05)))) AS f_lgt FROM ef)"""


def _rename(column):
    names = F.create_map(*[x for i, n in enumerate(SHAPES) for x in (F.lit(f"c{i}"), F.lit(n))])
    return F.transform_keys(column, lambda k, v: names[k])


@query(
    "fn7_fuse",
    f"""WITH {FUSE_SQL} SELECT id, la AS first, lb AS second, round(f_sum / (f_sum + (1 - e) * tb + e * xb), 6) AS probability_sum, round(f_log, 6) AS log_product, round(f_evi, 6) AS evidence_adaptive, round(f_lgt, 6) AS top2_logistic FROM fu""",
    ("vec", "scores"),
)
def _(spark, sf):
    base = normalized(spark, sf).withColumns({"ntop": _rename(F.col("top")), "nside": _rename(F.col("side"))})
    order = S.ranked(F.col("top"))
    options = {
        "probability_sum": {}, "log_product": {}, "evidence_adaptive": {"topology": F.col("topology")},
        "top2_logistic": {"weights": (1.0, 0.3, 0.1, 0.2, 0.1), "bias": -0.05},
    }
    fused = {
        m: S.fuse(F.col("ntop"), F.col("nside"), F.col("quality"), method=m, **o) for m, o in options.items()
    }
    # The renamed labels keep the ranking of the scores, so the first entry is the same class.
    return base.select(
        "id", F.get(order, F.lit(0))["label"].alias("first"), F.get(order, F.lit(1))["label"].alias("second"),
        *[F.round(F.get(f, F.lit(0))["p"], 6).alias(m) for m, f in fused.items()],
    )


@query(
    "fn8_pair_reliability",
    f"""WITH p AS (SELECT a.p_name || '_' || CASE a.p_type WHEN 'ECONOMY' THEN 'prism' WHEN 'SMALL' THEN 'pyramid' ELSE 'body' END AS a0, a.p_partkey AS part, a.p_size, b.p_type AS tb FROM part a JOIN part b ON b.p_partkey = a.p_partkey),
      q AS (SELECT part, CASE WHEN p_size < 5 THEN 'cone' WHEN p_size < 9 THEN 'octahedron' ELSE a0 END AS a, CASE WHEN p_size % 3 = 0 THEN 'cylinder' WHEN p_size % 3 = 1 THEN 'x_prism' ELSE 'y_pyramid' END AS b FROM p)
    SELECT part, a, b, {_FAMILY.format(x='a')} AS family, CAST({_RELIABLE.format(a='a', b='b')} AS DOUBLE) AS reliability FROM q""",
)
def _(spark, sf):
    c = F.col
    kind = F.when(c("p_type") == "ECONOMY", "prism").when(c("p_type") == "SMALL", "pyramid").otherwise("body")
    rows = table(spark, sf, "part").select(
        c("p_partkey").alias("part"),
        F.when(c("p_size") < 5, "cone").when(c("p_size") < 9, "octahedron").otherwise(F.concat_ws("_", "p_name", kind)).alias("a"),
        F.when(c("p_size") % 3 == 0, "cylinder").when(c("p_size") % 3 == 1, "x_prism").otherwise("y_pyramid").alias("b"),
    )
    return rows.select("part", "a", "b", S.shape_family(c("a")).alias("family"), S.pair_reliability(c("a"), c("b")).alias("reliability"))


DECIDE_SQL = f"""{FUSE_SQL}, dc AS (SELECT id, label, quality, la, lb, pa, pb, f_log, ls, smax, CASE WHEN id % 7 = 0 THEN 'distance_rejected' WHEN id % 3 = 0 THEN 'margin_rejected' ELSE 'accepted' END AS treason,
    quality < 0.2 OR id % 11 = 0 AS degraded FROM fu),
  de AS (SELECT *, CASE WHEN degraded OR f_log >= 0.5 THEN la ELSE lb END AS winner, CASE WHEN degraded THEN pa ELSE greatest(f_log, 1 - f_log) END AS probability,
    CASE WHEN degraded THEN pa - pb ELSE abs(2 * f_log - 1) END AS margin, NOT degraded AND pa >= 0.3 AND smax >= 0.3 AND la <> ls AS conflict FROM dc),
  dd AS (SELECT *, NOT conflict AND CASE WHEN degraded THEN treason = 'accepted' AND probability >= 0.35 ELSE treason IN ('accepted', 'margin_rejected') AND probability >= 0.55 AND margin >= 0.12 END AS accepted FROM de)"""


def decided(spark, sf):
    k = F.col("id")
    base = normalized(spark, sf).withColumns(
        {
            "treason": F.when(k % 7 == 0, "distance_rejected").when(k % 3 == 0, "margin_rejected").otherwise("accepted"),
            "sreason": F.when(k % 11 == 0, "insufficient_side").otherwise("accepted"),
        }
    )
    decision = S.fusion_decision(
        F.col("top"), F.col("side"), F.col("quality"), top_reason=F.col("treason"), side_reason=F.col("sreason"),
        minimum_side_quality=0.2, top_only_probability=0.35, probability_threshold=0.55, conflict_probability=0.3,
    )
    return base.withColumn("d", decision)


@query(
    "fn9_fusion_decision",
    f"WITH {DECIDE_SQL} SELECT id, winner, round(probability, 6) AS probability, round(margin, 6) AS margin, degraded, conflict, accepted FROM dd",
    ("vec", "scores"),
)
def _(spark, sf):
    return decided(spark, sf).select(
        "id", "d.winner", F.round("d.probability", 6).alias("probability"), F.round("d.margin", 6).alias("margin"),
        "d.degraded", "d.conflict", "d.accepted",
    )


@query(
    "fn10_apply_decision",
    f"""WITH {DECIDE_SQL}, st AS (SELECT *, CASE id % 5 WHEN 0 THEN 'PICKABLE' WHEN 1 THEN 'UNCERTAIN' WHEN 2 THEN 'DEPTH_INVALID' WHEN 3 THEN 'PICKABLE' ELSE 'OCCLUDED' END AS st, id % 5 = 0 AS sel, id % 2 = 0 AS up, NOT degraded AS usable FROM dd)
    SELECT id, CASE WHEN NOT usable THEN CASE WHEN st = 'PICKABLE' AND pa < 0.35 THEN 'UNCERTAIN' ELSE st END WHEN conflict OR NOT accepted THEN CASE WHEN st IN ('PICKABLE', 'UNCERTAIN') THEN 'UNCERTAIN' ELSE st END
       WHEN st = 'UNCERTAIN' AND treason = 'margin_rejected' AND up THEN 'PICKABLE' ELSE st END AS status,
     CASE WHEN NOT usable THEN sel AND NOT (st = 'PICKABLE' AND pa < 0.35) WHEN conflict OR NOT accepted THEN false ELSE sel AND CASE WHEN st = 'UNCERTAIN' AND treason = 'margin_rejected' AND up THEN 'PICKABLE' ELSE st END = 'PICKABLE' END AS selected,
     CASE WHEN NOT usable THEN 'SIDE_MISSING' WHEN conflict THEN 'CONFLICT' WHEN accepted THEN 'FUSED' ELSE 'TOP_ONLY' END AS state FROM st""",
    ("vec", "scores"),
)
def _(spark, sf):
    k = F.col("id")
    status = F.when(k % 5 == 0, "PICKABLE").when(k % 5 == 1, "UNCERTAIN").when(k % 5 == 2, "DEPTH_INVALID").when(k % 5 == 3, "PICKABLE").otherwise("OCCLUDED")
    rows = decided(spark, sf).withColumns({"status": status, "sel": k % 5 == 0})
    applied = S.apply_decision(
        F.col("status"), F.col("sel"), F.col("d"), top_reason=F.col("treason"), upgrade_allowed=k % 2 == 0,
        usable=~F.col("d.degraded"), top_probability=S.top2_margin(F.col("top"))["probability"],
        top_only_probability=0.35, missing_state=F.lit("SIDE_MISSING"),
    )
    return rows.withColumn("r", applied).select("id", "r.status", "r.selected", "r.state")


@query(
    "fn11_side_quality",
    """SELECT frame_id, object_id, round(CASE WHEN truth = 'R' THEN 0 ELSE least(confidence, least(1, w * 4 / 120), least(1, price / 2111 / 35), least(1, (1 - tax * 6) / 0.65)) END, 6) AS quality,
     round(least(1, 0.45 * least(1, w / 10000 / 0.003) + 0.35 * least(1, price / 713 / 120) + 0.2 * confidence), 6) AS quality_weighted FROM det""",
    "det",
)
def _(spark, sf):
    c = F.col
    reason = F.when(c("truth") == "R", "ambiguous").otherwise("accepted")
    return detections(spark, sf).select(
        "frame_id", "object_id",
        F.round(G.side_quality(c("confidence"), c("w") * 4, c("price") / 2111, 1 - c("tax") * 6, reason), 6).alias("quality"),
        F.round(G.side_quality_weighted(c("w") / 10000, c("price") / 713, c("confidence")), 6).alias("quality_weighted"),
    )


@query(
    "fn12_grasp_score",
    """SELECT frame_id, object_id, round(0.35 * greatest(0, 1 - tax * 20 / 1.2) + 0.25 * greatest(0, 1 - w / 35) + 0.2 * confidence + 0.2 * greatest(0, least(1, (price / 8013 - 7.5) / 6)), 6) AS score,
     tax * 20 <= 1.2 AND w <= 35 AND confidence >= 0.9 AS allowed FROM det""",
    "det",
)
def _(spark, sf):
    c = F.col
    return detections(spark, sf).select(
        "frame_id", "object_id",
        F.round(G.grasp_score(c("tax") * 20, c("w"), c("confidence"), c("price") / 8013), 6).alias("score"),
        G.grasp_allowed(c("tax") * 20, c("w"), c("confidence")).alias("allowed"),
    )


@query(
    "fn13_confidences",
    """SELECT frame_id, object_id, round(least(1, 0.75 * greatest(0, 1 - w / 48) + 0.25 * least(1, h / 25)), 6) AS colour, round(least(1, 0.72 * exp(-pow(tax * 10 / 0.5, 2)) + 0.28 * least(1, confidence / 0.35)), 6) AS knn,
     round(0.78 + 0.21 * greatest(0, least(1, 1 - tax * 10 / 0.6)), 6) AS class_threshold, round(greatest(0, least(0.99, 0.8 + 0.19 * (1 - tax * 10 / 0.65))), 6) AS prototype FROM det""",
    "det",
)
def _(spark, sf):
    c = F.col
    return detections(spark, sf).select(
        "frame_id", "object_id", F.round(G.colour_confidence(c("w"), c("h")), 6).alias("colour"),
        F.round(G.knn_confidence(c("tax") * 10, F.lit(0.5), c("confidence")), 6).alias("knn"),
        F.round(G.class_threshold_confidence(c("tax") * 10, F.lit(0.6)), 6).alias("class_threshold"),
        F.round(G.prototype_confidence(c("tax") * 10), 6).alias("prototype"),
    )


@query(
    "fn14_hybrid_vote",
    """WITH q AS (SELECT frame_id, object_id, CASE WHEN truth = 'A' THEN 'octahedron' ELSE truth END AS l, confidence AS p, CASE WHEN truth = 'A' AND line < 3 THEN 'hexagonal_prism' WHEN truth = 'A' THEN 'octahedron' ELSE prediction END AS bl, tax * 12 AS bp, w AS s, w + 5 AS g, price / 100000 AS near FROM det),
     r AS (SELECT *, l = 'octahedron' AND s >= 35 AND g >= 42 AND near >= 0.35 AS ov FROM q), t AS (SELECT *, CASE WHEN ov THEN 'hexagonal_prism' ELSE l END AS ul, CASE WHEN ov THEN greatest(p, 0.86) ELSE p END AS up FROM r)
    SELECT frame_id, object_id, CASE WHEN ul <> bl AND up < 0.8 THEN 'unknown' ELSE ul END AS label, round(least(1, 0.8 * up + CASE WHEN ul = bl THEN (1 - 0.8::DOUBLE) * bp ELSE 0 END), 6) AS confidence, ov AS override FROM t""",
    "det",
)
def _(spark, sf):
    c = F.col
    label = F.when(c("truth") == "A", "octahedron").otherwise(c("truth"))
    base = F.when((c("truth") == "A") & (c("line") < 3), "hexagonal_prism").when(c("truth") == "A", "octahedron").otherwise(c("prediction"))
    vote = G.hybrid_vote(label, c("confidence"), base, c("tax") * 12, c("w"), c("w") + 5, c("price") / 100000)
    return detections(spark, sf).withColumn("v", vote).select(
        "frame_id", "object_id", "v.label", F.round("v.confidence", 6).alias("confidence"), "v.override"
    )


@query(
    "fn15_shape_rules",
    """WITH q AS (SELECT frame_id, object_id, part % 200 AS pts, line + 1 AS ve, confidence AS ci, tax * 40 AS rm, tax / 20 AS cu, w / 50 AS si FROM det)
    SELECT frame_id, object_id, CASE WHEN pts < 40 THEN 'unknown' WHEN ci >= 0.78 AND ve >= 7 THEN CASE WHEN rm >= 1 OR cu >= 0.0015 THEN 'sphere' ELSE 'cylinder' END WHEN ve = 3 THEN 'triangular_prism'
       WHEN ve = 4 THEN CASE WHEN ci < 0.68 AND si > 0.75 THEN 'triangular_prism' WHEN si >= 0.82 THEN 'cube' ELSE 'cuboid' END WHEN ve = 5 THEN 'pentagonal_prism' WHEN ve = 6 THEN 'hexagonal_prism' ELSE 'unknown' END AS primitive,
     round(CASE WHEN pts < 40 THEN 0 WHEN ci >= 0.78 AND ve >= 7 THEN 0.82 + 0.16 * least(1, abs(rm - 1) / 2) WHEN ve = 3 THEN 0.86 WHEN ve = 4 THEN CASE WHEN ci < 0.68 AND si > 0.75 THEN 0.78 ELSE 0.82 + 0.15 * least(1, abs(si - 0.82) / 0.3) END
       WHEN ve IN (5, 6) THEN 0.84 ELSE 0.35 END, 6) AS primitive_confidence,
     CASE WHEN ci >= 0.82 AND ve >= 7 THEN 'circle' WHEN ve = 3 THEN 'triangle' WHEN ve = 4 AND si >= 0.84 THEN 'square' WHEN ve = 4 THEN 'rectangle' WHEN ve = 5 THEN 'pentagon' WHEN ve = 6 THEN 'hexagon' ELSE 'unknown' END AS polygon,
     round(CASE WHEN ci >= 0.82 AND ve >= 7 THEN least(1, ci) WHEN ve = 3 THEN 0.9 * ci WHEN ve = 4 AND si >= 0.84 THEN (0.78 + 0.22 * least(1, (si - 0.84) / 0.16)) * ci WHEN ve = 4 THEN (0.8 + 0.2 * least(1, (0.84 - si) / 0.35)) * ci
       WHEN ve IN (5, 6) THEN 0.88 * ci ELSE 0.35 * ci END, 6) AS polygon_confidence FROM q""",
    "det",
)
def _(spark, sf):
    c = F.col
    primitive = G.primitive_shape(c("part") % 200, c("line") + 1, c("confidence"), c("tax") * 40, c("tax") / 20, c("w") / 50)
    polygon = G.polygon_shape(c("line") + 1, c("confidence"), c("w") / 50, c("confidence"))
    return detections(spark, sf).withColumns({"a": primitive, "b": polygon}).select(
        "frame_id", "object_id", c("a.label").alias("primitive"), F.round("a.confidence", 6).alias("primitive_confidence"),
        c("b.label").alias("polygon"), F.round("b.confidence", 6).alias("polygon_confidence"),
    )


@query(
    "fn16_circular",
    """WITH q AS (SELECT seg_id, x1 * 9 AS p, y1 * 7 AS q FROM seg) SELECT seg_id, round(least(((abs(p - q) % 180) + 180) % 180, 180 - ((abs(p - q) % 180) + 180) % 180), 6) AS hue_distance,
     round((((p + 90) % 180) + 180) % 180 - 90, 6) AS wrapped FROM q""",
    ("vec", "seg"),
)
def _(spark, sf):
    p, q = F.col("x1") * 9, F.col("y1") * 7
    return segments(spark, sf).select(
        "seg_id", F.round(N.circular_distance(p, q, 180), 6).alias("hue_distance"), F.round(N.wrap_half_turn(p), 6).alias("wrapped")
    )


@query(
    "fn17_colours",
    """WITH q AS (SELECT p_partkey AS part, p_partkey % 256 AS r, (p_partkey * 7) % 256 AS g, (p_partkey * 31) % 256 AS b FROM part),
     h AS (SELECT *, greatest(b, g, r) AS hi, least(b, g, r) AS lo FROM q),
     l AS (SELECT *, [CASE WHEN c / 255 <= 0.04045 THEN c / 255 / 12.92 ELSE pow((c / 255 + 0.055) / 1.055, 2.4) END for c in [r::DOUBLE, g::DOUBLE, b::DOUBLE]] AS n FROM h),
     x AS (SELECT *, [CASE WHEN t > 0.008856 THEN cbrt(t) ELSE 7.787 * t + 16.0::DOUBLE / 116 END for t in [(0.412453 * n[1] + 0.357580 * n[2] + 0.180423 * n[3]) / 0.950456, 0.212671 * n[1] + 0.715160 * n[2] + 0.072169 * n[3], (0.019334 * n[1] + 0.119193 * n[2] + 0.950227 * n[3]) / 1.088754]] AS k FROM l),
     s AS (SELECT *, CASE WHEN hi = lo THEN 0.0::DOUBLE WHEN hi = r THEN 60.0::DOUBLE * (g - b) / (hi - lo) WHEN hi = g THEN 120 + 60.0::DOUBLE * (b - r) / (hi - lo) ELSE 240 + 60.0::DOUBLE * (r - g) / (hi - lo) END AS hue FROM x)
    SELECT part, CAST(r AS INT) AS r, CAST(g AS INT) AS g, CAST(b AS INT) AS b, CAST(round_even(((hue % 360 + 360) % 360) / 2, 0) AS INT) % 180 AS h, CAST(CASE WHEN hi = 0 THEN 0 ELSE round_even(255.0::DOUBLE * (hi - lo) / hi, 0) END AS INT) AS s, CAST(hi AS INT) AS v,
     round(116 * k[2] - 16, 4) AS lab_l, round(500 * (k[1] - k[2]), 4) AS lab_a, round(200 * (k[2] - k[3]), 4) AS lab_b FROM s""",
)
def _(spark, sf):
    k = F.col("p_partkey")
    code = F.concat(F.lit("#"), *[F.lpad(F.hex((k * f) % 256), 2, "0") for f in (1, 7, 31)])
    r, g, b = G.hex_to_rgb(F.col("code"))
    rows = table(spark, sf, "part").select(k.alias("part"), code.alias("code")).select("part", r.alias("r"), g.alias("g"), b.alias("b"))
    h, s, v = G.bgr_to_hsv(F.col("b"), F.col("g"), F.col("r"))
    lab = G.srgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    return rows.select(
        "part", "r", "g", "b", h.alias("h"), s.alias("s"), v.alias("v"),
        *[F.round(x, 4).alias(n) for x, n in zip(lab, ("lab_l", "lab_a", "lab_b"))],
    )


@query(
    "fn18_pixel_to_mm",
    """SELECT frame_id, object_id, round(x * 160 / 799, 6) AS x_mm, round((799 - y) * 160 / 799, 6) AS y_mm, round((1.1 * x + 0.02 * y + 3) / (0.0001 * x + 0.0002 * y + 1), 6) AS hx, round((0.01 * x + 0.95 * y - 2) / (0.0001 * x + 0.0002 * y + 1), 6) AS hy FROM det""",
    "det",
)
def _(spark, sf):
    x, y = F.col("x"), F.col("y")
    mm = G.pixel_to_mm(x, y)
    h = G.homography(x, y, [[1.1, 0.02, 3.0], [0.01, 0.95, -2.0], [0.0001, 0.0002, 1.0]])
    return detections(spark, sf).select(
        "frame_id", "object_id", *[F.round(e, 6).alias(n) for e, n in zip([*mm, *h], ("x_mm", "y_mm", "hx", "hy"))]
    )


MATRIX = [[0.8, 0.0, 0.6, 10.0], [0.0, 1.0, 0.0, -5.0], [-0.6, 0.0, 0.8, 40.0]]


@query(
    "fn19_camera_geometry",
    """WITH t AS (SELECT object_id, x, y, z, 0.8 * x + 0.6 * z + 10 AS tx, y - 5 AS ty, -0.6 * x + 0.8 * z + 40 AS tz FROM pts)
    SELECT object_id, count(*) AS n, round(sum((x - 320) * z / 600), 3) AS bx, round(sum((y - 240) * z / 610), 3) AS by, round(sum(tx * 600 / tz + 320), 3) AS u, round(sum(ty * 610 / tz + 240), 3) AS v, round(sum(0.6 * x + 0.0 * y - 0.8 * z + 250), 3) AS d FROM t GROUP BY 1""",
    "pts",
)
def _(spark, sf):
    c = F.col
    ray = G.backproject(c("x"), c("y"), c("z"), 600.0, 610.0, 320.0, 240.0)
    moved = G.rigid_transform([c("x"), c("y"), c("z")], MATRIX)
    u, v = G.project(*moved, 600.0, 610.0, 320.0, 240.0)
    d = G.signed_distance([c("x"), c("y"), c("z")], [0.6, 0.0, -0.8], 250.0)
    return points(spark, sf).groupBy("object_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.sum(e), 3).alias(n) for e, n in zip((ray[0], ray[1], u, v, d), ("bx", "by", "u", "v", "d"))]
    )


@query(
    "fn20_rotation_to_quaternion",
    """WITH q AS (SELECT id, v[1] AS x0, v[2] AS y0, v[3] AS z0, v[4] AS w0 FROM vec), n AS (SELECT id, x0 / l AS x, y0 / l AS y, z0 / l AS z, w0 / l AS w FROM (SELECT *, sqrt(x0*x0 + y0*y0 + z0*z0 + w0*w0) AS l FROM q)),
     s AS (SELECT id, x, y, z, w, 4*w*w - 1 AS tr, 1 - 2*(y*y + z*z) AS a, 1 - 2*(x*x + z*z) AS b, 1 - 2*(x*x + y*y) AS c FROM n),
     g AS (SELECT *, CASE WHEN tr > 0 THEN sign(w) WHEN a >= b AND a >= c THEN sign(x) WHEN b >= c THEN sign(y) ELSE sign(z) END AS sg FROM s)
    SELECT id, round(sg * x, 6) AS x, round(sg * y, 6) AS y, round(sg * z, 6) AS z, round(sg * w, 6) AS w FROM g""",
    "vec",
)
def _(spark, sf):
    raw = vectors(spark, sf).select("id", *[F.col("v")[i].alias(n) for i, n in enumerate("abcd")])
    norm = F.sqrt(sum((F.col(n) ** 2 for n in "bcd"), F.col("a") ** 2))
    unit = raw.withColumn("l", norm).select("id", *[(F.col(s) / F.col("l")).alias(n) for s, n in zip("abcd", "xyzw")])
    x, y, z, w = (F.col(n) for n in "xyzw")
    m = [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]
    named = unit.select("id", *[e.alias(f"m{i}{j}") for i, row in enumerate(m) for j, e in enumerate(row)])
    q = G.rotation_to_quaternion([[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)])
    return named.select("id", q.alias("q")).select("id", *[F.round(f"q.{n}", 6).alias(n) for n in "xyzw"])


@query(
    "fn21_boxes",
    """SELECT frame_id, object_id, round(sqrt(pow(greatest(200 - (x + w), x - 240, 0), 2) + pow(greatest(100 - (y + h), y - 130, 0), 2)), 6) AS gap, x <= 4 OR y <= 4 OR x + w >= 636 OR y + h >= 476 AS border,
     CAST(round_even(x / 0.75, 0) AS INT) AS rx, CAST(round_even(y / 0.75, 0) AS INT) AS ry, CAST(round_even(w / 0.75, 0) AS INT) AS rw, CAST(round_even(h / 0.75, 0) AS INT) AS rh FROM det""",
    "det",
)
def _(spark, sf):
    box = [F.col(c) for c in "xywh"]
    fixed = [F.lit(v) for v in (200.0, 100.0, 40.0, 30.0)]
    scaled = G.bbox_rescale(box, 0.75)
    return detections(spark, sf).select(
        "frame_id", "object_id", F.round(G.bbox_gap(box, fixed), 6).alias("gap"), G.touches_border(*box, 640, 480, 4).alias("border"),
        *[e.alias(f"r{n}") for e, n in zip(scaled, "xywh")],
    )


@query(
    "fn22_segment_geometry",
    """WITH q AS (SELECT seg_id, x1, y1, x2, y2, a * 40 - 5 AS p1, b * 40 - 5 AS q1, c * 40 AS p2, 12.0::DOUBLE - a * 30 AS q2 FROM seg),
     m AS (SELECT *, sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)) AS l, sqrt((p2-p1)*(p2-p1) + (q2-q1)*(q2-q1)) AS k, (x2-x1)*(q2-q1) - (y2-y1)*(p2-p1) AS den FROM q),
     t AS (SELECT *, ((p1-x1)*(q2-q1) - (q1-y1)*(p2-p1)) / den AS t, ((p1-x1)*(y2-y1) - (q1-y1)*(x2-x1)) / den AS u, ((p1-x1)*(x2-x1) + (q1-y1)*(y2-y1)) / l AS s1, ((p2-x1)*(x2-x1) + (q2-y1)*(y2-y1)) / l AS s2 FROM m)
    SELECT seg_id, round(abs((x2-x1)*(q1-y1) - (y2-y1)*(p1-x1)) / greatest(l, 1e-6), 6) AS distance, round(greatest(0 - greatest(s1, s2), least(s1, s2) - l, 0), 6) AS gap,
     CASE WHEN abs(den) >= 1e-5 AND t BETWEEN -2 / l AND 1 + 2 / l AND u BETWEEN -2 / k AND 1 + 2 / k THEN round(x1 + t * (x2-x1), 6) END AS cross_x,
     l * l >= 64 AND greatest(abs((x2-x1)*(q1-y1) - (y2-y1)*(p1-x1)), abs((x2-x1)*(q2-y1) - (y2-y1)*(p2-x1))) / l <= 3 AND least(s1, s2) / l >= -0.1 AND greatest(s1, s2) / l <= 1.1 AND abs(s1 - s2) / l >= 0.5 AS contains FROM t""",
    ("vec", "seg"),
)
def _(spark, sf):
    c = F.col
    rows = segments(spark, sf).select(
        "seg_id", "x1", "y1", "x2", "y2", (c("a") * 40 - 5).alias("p1"), (c("b") * 40 - 5).alias("q1"), (c("c") * 40).alias("p2"), (12.0 - c("a") * 30).alias("q2")
    )
    s, o = [c(n) for n in ("x1", "y1", "x2", "y2")], [c(n) for n in ("p1", "q1", "p2", "q2")]
    return rows.select(
        "seg_id", F.round(G.point_line_distance(o[0], o[1], s), 6).alias("distance"), F.round(G.projection_gap(s, o), 6).alias("gap"),
        F.round(G.segment_intersection(s, o, 2.0)["x"], 6).alias("cross_x"), G.line_contains(s, o).alias("contains"),
    )


@query(
    "fn23_parse_composition",
    """WITH t AS (SELECT p_partkey AS part, p_name || ':2，' || p_type || ' = 1; ' || p_name || CASE WHEN p_size % 2 = 0 THEN ' ; ; x：3' ELSE '' END AS text FROM part),
     i AS (SELECT part, trim(unnest(string_split_regex(text, '[,，;；]'))) AS item FROM t), e AS (SELECT part, trim(string_split_regex(item, '[:：=]')[1]) AS label, coalesce(CAST(trim(string_split_regex(item, '[:：=]')[2]) AS INT), 1) AS n FROM i WHERE item <> '')
    SELECT part, label, CAST(sum(n) AS BIGINT) AS count FROM e GROUP BY 1, 2""",
)
def _(spark, sf):
    tail = F.when(F.col("p_size") % 2 == 0, " ; ; x：3").otherwise("")
    text = F.concat("p_name", F.lit(":2，"), "p_type", F.lit(" = 1; "), "p_name", tail)
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("part"), text.alias("text"))
    return labels.composition_counts(rows, ["part"], "text")


@query(
    "fn24_time_delta_ms",
    """WITH q AS (SELECT frame_id, ns, CASE WHEN kind = 'click' THEN NULL ELSE ns + CAST(floor(value * 100) AS BIGINT) * 10000 END AS color_ns, CASE WHEN kind = 'view' THEN NULL ELSE ns - CAST(floor(value * 100) AS BIGINT) * 5000 END AS depth_ns FROM frames)
    SELECT frame_id, round(abs(coalesce(color_ns, ns) - coalesce(depth_ns, ns)) / 1e6::DOUBLE, 6) AS sync_ms FROM q""",
    "frames",
)
def _(spark, sf):
    c = F.col
    step = F.floor(c("value") * 100)
    colour = F.when(c("kind") != "click", c("ns") + step * 10000)
    depth = F.when(c("kind") != "view", c("ns") - step * 5000)
    return frames(spark, sf).select("frame_id", F.round(N.frame_sync_ms(c("ns"), colour, depth), 6).alias("sync_ms"))


@query(
    "fn25_resize_intrinsics",
    """SELECT s_suppkey AS camera, greatest(1, CAST(round_even((640 + s_suppkey) * 0.75, 0) AS INT)) AS width, greatest(1, CAST(round_even((480 + s_suppkey % 7) * 0.75, 0) AS INT)) AS height, round((600 + s_acctbal / 100) * 0.75, 6) AS fx,
     round((601 + s_acctbal / 100) * 0.75, 6) AS fy, round((320 + s_suppkey % 5 + 0.5) * 0.75 - 0.5, 6) AS cx, round((240 + s_suppkey % 3 + 0.5) * 0.75 - 0.5, 6) AS cy FROM supplier""",
)
def _(spark, sf):
    k, a = F.col("s_suppkey"), F.col("s_acctbal") / 100
    out = G.resize_intrinsics(640 + k, 480 + k % 7, 600 + a, 601 + a, 320 + k % 5, 240 + k % 3, 0.75)
    return table(spark, sf, "supplier").select(
        k.alias("camera"), "s_acctbal", *[e.alias(n) for n, e in out.items()]
    ).select("camera", "width", "height", *[F.round(n, 6).alias(n) for n in ("fx", "fy", "cx", "cy")])


@query(
    "fn26_canonical_json_hash",
    """SELECT p_partkey AS part, sha256(CAST(to_json(struct_pack(brand := p_brand, name := p_name, size := p_size)) AS VARCHAR)) AS hash, sha256('v7' || p_name || p_type) AS signature FROM part""",
)
def _(spark, sf):
    fields = {"size": F.col("p_size"), "name": F.col("p_name"), "brand": F.col("p_brand")}
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("part"), labels.canonical_json_hash(fields).alias("hash"),
        labels.signature("v7", F.col("p_name"), F.col("p_type")).alias("signature"),
    )


@query(
    "fn27_relative_id",
    """SELECT page_id, replace('D:\\data\\set/' || url, '\\', '/') AS unified, substr(replace('D:\\data\\set/' || url, '\\', '/'), 13) AS relative, url AS outside FROM pages""",
)
def _(spark, sf):
    path = F.concat(F.lit("D:\\data\\set/"), "url")
    return table(spark, sf, "pages").select(
        "page_id", F.regexp_replace(path, r"\\", "/").alias("unified"), labels.relative_id(path, "D:\\data\\set").alias("relative"),
        labels.relative_id(F.col("url"), "D:/data/set").alias("outside"),
    )


@query(
    "fn28_direction_entropy",
    """WITH a AS (SELECT object_id, least(CAST(floor(((degrees(atan2(y2-y1, x2-x1)) % 180) + 180) % 180 / 15) AS INT), 11) AS b FROM seg), c AS (SELECT object_id, b, count(*) AS n FROM a GROUP BY 1, 2),
     p AS (SELECT object_id, n / sum(n) OVER (PARTITION BY object_id) AS p FROM c) SELECT object_id, round(-sum(p * ln(p + 1e-12)) / ln(12.0::DOUBLE), 6) AS entropy FROM p GROUP BY 1""",
    ("vec", "seg"),
)
def _(spark, sf):
    return seg_ops.direction_entropy(segments(spark, sf), ["object_id"]).select("object_id", F.round("entropy", 6).alias("entropy"))


@query(
    "fn29_canonical_scores",
    """WITH al(k, cls) AS (VALUES ('gear','gear'),('largegear','gear'),('red_gear','gear'),('hotgear','gear'),('oldgear','gear'),('coldgear','gear'),('bolt','bolt'),('oldbolt','bolt'),('largebolt','bolt'),('hotbolt','bolt'),('plate','plate'),('smallplate','plate'),('newplate','plate'),('blueplate','plate')),
     s AS (SELECT p_brand AS brand, p_name AS raw, avg(p_retailprice) AS p FROM part GROUP BY 1, 2)
    SELECT brand, coalesce(cls, raw) AS label, round(sum(p), 4) AS p FROM s LEFT JOIN al ON al.k = regexp_replace(replace(lower(trim(raw)), '-', '_'), '\\s+', '', 'g') GROUP BY 1, 2""",
)
def _(spark, sf):
    means = table(spark, sf, "part").groupBy(F.col("p_brand").alias("brand"), "p_name").agg(F.avg("p_retailprice").alias("p"))
    maps = means.groupBy("brand").agg(F.map_from_entries(F.collect_list(F.struct("p_name", "p"))).alias("scores"))
    out = audits.canonical_scores(maps, "brand", "scores", part_aliases(spark))
    return out.withColumn("p", F.round("p", 4))


@query(
    "fn30_evidence_quality",
    """WITH q AS (SELECT frame_id, count(*) AS lines, avg(confidence) AS support, count(*) FILTER (part % 3 = 0) AS junctions, count(*) FILTER (part % 5 = 0) AS faces, avg(least(price / 90000, 1)) AS colour FROM det GROUP BY 1),
     e AS (SELECT *, greatest(0, least(1, 0.45 * least(lines / 4, 1) + 0.25 * support + 0.2 * least(junctions / 2, 1) + 0.1 * least(greatest(faces - 1, 0) / 3, 1))) AS plain,
       greatest(0, least(1, 0.3 * least(lines / 4, 1) + 0.2 * support + 0.15 * least(junctions / 2, 1) + 0.15 * least(greatest(faces - 1, 0) / 3, 1) + 0.2 * colour)) AS assisted FROM q)
    SELECT frame_id, round(plain, 6) AS plain, round(assisted, 6) AS assisted, CASE WHEN lines >= 2 AND plain >= 0.42 THEN 'accepted' ELSE 'edge_evidence_low' END AS reason FROM e""",
    "det",
)
def _(spark, sf):
    c = F.col
    q = detections(spark, sf).groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("lines"), F.avg("confidence").alias("support"), F.count_if(c("part") % 3 == 0).alias("junctions"),
        F.count_if(c("part") % 5 == 0).alias("faces"), F.avg(F.least(c("price") / 90000, F.lit(1.0))).alias("colour"),
    )
    four = (c("lines"), c("support"), c("junctions"), c("faces"))
    plain = G.evidence_quality(*four)
    return q.select(
        "frame_id", F.round(plain, 6).alias("plain"), F.round(G.evidence_quality(*four, c("colour")), 6).alias("assisted"),
        G.evidence_reason(c("lines"), plain).alias("reason"),
    )
