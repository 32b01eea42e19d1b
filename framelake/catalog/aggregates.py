"""AGG1-AGG32."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.catalog.base import query
from framelake.catalog.projections import SAFETY_SQL, STATUS_SQL, safety, status_of
from framelake.catalog.views import captures, detections, frames, grid, table, vectors
from framelake.functions import labels
from framelake.operators import audits as A
from framelake.operators import evaluation as E
from framelake.operators import grids


def r6(name: str, alias: str | None = None, digits: int = 6):
    return F.round(F.col(name), digits).alias(alias or name)


AUDIT_SQL = """ad AS (SELECT sample, batch_id, label_id, 1.0::DOUBLE - (n_chars % 100) / 400.0::DOUBLE AS valid_ratio,
   CAST(n_chars % 97 AS DOUBLE) AS sync_ms, sha256(content) AS sha256,
   CASE WHEN n_chars % 41 = 0 THEN 'manifest_label_mismatch' END AS error FROM docs)"""


def audited(spark, sf):
    n = F.col("n_chars")
    return captures(spark, sf).select(
        "sample", "batch_id", "label_id",
        (F.lit(1.0) - (n % 100) / F.lit(400.0)).alias("valid_ratio"),
        (n % 97).cast("double").alias("sync_ms"),
        labels.content_hash(F.col("content")).alias("sha256"),
        F.when(n % 41 == 0, "manifest_label_mismatch").alias("error"),
    )


@query(
    "agg1_dataset_audit",
    f"""WITH {AUDIT_SQL} SELECT CASE grouping(label_id) * 2 + grouping(batch_id) WHEN 3 THEN 'all' WHEN 1 THEN 'class' ELSE 'batch' END AS scope,
     coalesce(label_id, batch_id, '') AS key, count(*) AS samples, count(*) FILTER (error IS NULL) AS valid_samples,
     round(avg(valid_ratio) FILTER (error IS NULL), 6) AS mean_valid_ratio,
     max(sync_ms) FILTER (error IS NULL) AS max_sync_ms, count(*) FILTER (error IS NOT NULL) AS errors
    FROM ad GROUP BY GROUPING SETS ((label_id), (batch_id), ())""",
    "docs",
)
def _(spark, sf):
    return A.dataset_audit(audited(spark, sf)).withColumn("mean_valid_ratio", r6("mean_valid_ratio"))


@query(
    "agg1_duplicate_hashes",
    f"WITH {AUDIT_SQL} SELECT sha256, count(*) AS copies FROM ad GROUP BY 1 HAVING count(*) > 1",
    "docs",
)
def _(spark, sf):
    return A.duplicate_hashes(audited(spark, sf), "sha256")


IMAGE_SQL = """im AS (SELECT sample, batch_id || '-' || label_id AS label_id, 320 * (1 + n_chars % 3) AS width,
   240 * (1 + n_chars % 2) AS height, sha256(content) AS sha256 FROM docs)"""


def images(spark, sf):
    n = F.col("n_chars")
    return captures(spark, sf).select(
        "sample", F.concat_ws("-", "batch_id", "label_id").alias("label_id"),
        (320 * (1 + n % 3)).alias("width"), (240 * (1 + n % 2)).alias("height"),
        labels.content_hash(F.col("content")).alias("sha256"),
    )


@query(
    "agg2_image_audit",
    f"""WITH {IMAGE_SQL} SELECT 'class' AS section, label_id AS key, count(*) AS n, count(*) < 5 AS warning FROM im GROUP BY 2
    UNION ALL SELECT 'size', width || 'x' || height, count(*), false FROM im GROUP BY 2
    UNION ALL SELECT 'duplicate', sha256, count(*), true FROM im GROUP BY 2 HAVING count(*) > 1""",
    "docs",
)
def _(spark, sf):
    return A.image_audit(images(spark, sf))


@query(
    "agg2_duplicate_members",
    f"WITH {IMAGE_SQL} SELECT sample, sha256 FROM im WHERE sha256 IN (SELECT sha256 FROM im GROUP BY 1 HAVING count(*) > 1)",
    "docs",
)
def _(spark, sf):
    return A.duplicate_members(images(spark, sf), "sha256").select("sample", "sha256")


LANGS = [
    ("de", "German", "germanic", [], True),
    ("en", "English", "germanic", ["anglais"], True),
    ("es", "Spanish", "romance", [], True),
    ("fr", "French", "romance", [], True),
    ("it", "Italian", "romance", [], True),
    ("xx", "None", "none", [], False),
]
REG_SQL = """reg(class_id, enabled) AS (VALUES ('de', true), ('en', true), ('es', true), ('fr', true), ('it', true), ('xx', false))"""
SIDE_SQL = """sd AS (SELECT sample, label_id, CASE sample % 3 WHEN 0 THEN 'final_holdout' WHEN 1 THEN 'train'
   ELSE 'probability_calibration' END AS split, CASE WHEN n_chars % 17 = 0 THEN NULL ELSE 'col' || (n_chars % 6) END AS color_id,
   CASE WHEN n_chars % 19 = 0 THEN NULL ELSE batch_id END AS instance_id FROM docs)"""


def registry(spark):
    return labels.registry_frame(spark, LANGS)


def side_samples(spark, sf):
    n, turn = F.col("n_chars"), F.col("sample") % 3
    return captures(spark, sf).select(
        "sample", "label_id",
        F.when(turn == 0, "final_holdout").when(turn == 1, "train").otherwise("probability_calibration").alias("split"),
        F.when(n % 17 != 0, F.concat(F.lit("col"), (n % 6).cast("string"))).alias("color_id"),
        F.when(n % 19 != 0, F.col("batch_id")).alias("instance_id"),
    )


@query(
    "agg3_split_coverage",
    f"""WITH {REG_SQL}, {SIDE_SQL}, sp(split) AS (VALUES ('train'), ('probability_calibration'), ('final_holdout')),
     c AS (SELECT label_id, split, count(*) AS samples, count(DISTINCT color_id) AS colours,
       count(DISTINCT instance_id) AS instances FROM sd GROUP BY 1, 2)
    SELECT class_id, sp.split, coalesce(samples, 0) AS samples, coalesce(colours, 0) AS colours, coalesce(instances, 0) AS instances
    FROM reg CROSS JOIN sp LEFT JOIN c ON c.label_id = class_id AND c.split = sp.split WHERE enabled""",
    "docs",
)
def _(spark, sf):
    return A.split_coverage(side_samples(spark, sf), registry(spark))


@query(
    "agg3_colour_coverage",
    f"""WITH {SIDE_SQL} SELECT label_id AS class_id, split, color_id, count(*) AS samples FROM sd
    WHERE color_id IS NOT NULL GROUP BY 1, 2, 3""",
    "docs",
)
def _(spark, sf):
    return A.colour_coverage(side_samples(spark, sf))


@query(
    "agg4_collection_targets",
    f"""WITH {REG_SQL}, {SIDE_SQL}, n AS (SELECT label_id, count(*) FILTER (split = 'train') AS a,
       count(*) FILTER (split = 'probability_calibration') AS b, count(*) FILTER (split = 'final_holdout') AS c FROM sd GROUP BY 1),
     k AS (SELECT label_id, count(*) FILTER (split = 'train' AND n >= 10) AS ka,
       count(*) FILTER (split = 'probability_calibration' AND n >= 3) AS kb, count(*) FILTER (split = 'final_holdout' AND n >= 3) AS kc
       FROM (SELECT label_id, split, color_id, count(*) AS n FROM sd WHERE color_id IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1),
     i AS (SELECT label_id, sum(t) AS it, sum(p) AS ip, sum(f) AS fi, count(*) FILTER (f = 1 AND (t = 1 OR p = 1)) AS sh, count(*) AS tot
       FROM (SELECT label_id, instance_id, max((split = 'train')::INT) AS t, max((split = 'probability_calibration')::INT) AS p,
         max((split = 'final_holdout')::INT) AS f FROM sd WHERE instance_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
     v AS (SELECT class_id, coalesce(a >= 50 AND b >= 15 AND c >= 15, false) AS counts_ok,
       coalesce(ka >= 5 AND kb >= 5 AND kc >= 5, false) AS colours_ok, coalesce(it >= 2 AND ip >= 2, false) AS development_instances_ok,
       coalesce(fi > 0 AND sh = 0, false) AS final_instance_new, coalesce(tot >= 3, false) AS three_instances
       FROM reg LEFT JOIN n ON n.label_id = class_id LEFT JOIN k ON k.label_id = class_id LEFT JOIN i ON i.label_id = class_id WHERE enabled)
    SELECT *, counts_ok AND colours_ok AND development_instances_ok AND final_instance_new AND three_instances AS ready FROM v""",
    "docs",
)
def _(spark, sf):
    return A.collection_targets(side_samples(spark, sf), registry(spark))


@query(
    "agg5_batch_counts",
    "SELECT label_id, count(*) AS captures FROM docs WHERE batch_id = 'src3' GROUP BY 1",
    "docs",
)
def _(spark, sf):
    return A.batch_counts(captures(spark, sf), "src3")


@query("agg6_confusion", "SELECT truth, prediction, count(*) AS rows FROM det GROUP BY 1, 2", "det")
def _(spark, sf):
    return E.confusion(detections(spark, sf))


@query(
    "agg6_confusion_matrix",
    """WITH q AS (SELECT truth, CASE WHEN accepted THEN prediction END AS p FROM det)
    SELECT truth, count(*) FILTER (p = 'A') AS as_A, count(*) FILTER (p = 'N') AS as_N, count(*) FILTER (p = 'R') AS as_R,
     count(*) FILTER (p IS NULL) AS as_unknown FROM q GROUP BY 1""",
    "det",
)
def _(spark, sf):
    d = detections(spark, sf).withColumn("prediction", F.when(F.col("accepted"), F.col("prediction")))
    return E.confusion_matrix(d, ["A", "N", "R"])


_CLASS = """SELECT {keys} truth, count(*) AS n, count(*) FILTER (truth = prediction) AS c,
  count(*) FILTER (accepted) AS a, count(*) FILTER (accepted AND truth = prediction) AS ac FROM det GROUP BY ALL"""


@query(
    "agg7_decision_metrics",
    f"""WITH k AS ({_CLASS.format(keys='')}) SELECT CAST(sum(n) AS BIGINT) AS rows, round(sum(c) / sum(n), 6) AS raw_accuracy,
     round(avg(ac / n), 6) AS macro_recall, round(sum(a) / sum(n), 6) AS coverage, round(sum(ac) / greatest(sum(a), 1), 6) AS accepted_accuracy,
     CAST(sum(a) - sum(ac) AS BIGINT) AS wrong_accepts FROM k""",
    "det",
)
def _(spark, sf):
    return E.decision_metrics(detections(spark, sf)).select(
        "rows", r6("raw_accuracy"), r6("macro_recall"), r6("coverage"), r6("accepted_accuracy"), "wrong_accepts"
    )


@query(
    "agg7_decision_metrics_by_batch",
    f"""WITH k AS ({_CLASS.format(keys='batch_id,')}) SELECT batch_id, CAST(sum(n) AS BIGINT) AS rows, round(sum(c) / sum(n), 6) AS raw_accuracy,
     round(avg(ac / n), 6) AS macro_recall, round(sum(a) / sum(n), 6) AS coverage, round(sum(ac) / greatest(sum(a), 1), 6) AS accepted_accuracy,
     CAST(sum(a) - sum(ac) AS BIGINT) AS wrong_accepts FROM k GROUP BY 1""",
    "det",
)
def _(spark, sf):
    return E.decision_metrics(detections(spark, sf), ["batch_id"]).select(
        "batch_id", "rows", r6("raw_accuracy"), r6("macro_recall"), r6("coverage"), r6("accepted_accuracy"), "wrong_accepts"
    )


@query(
    "agg8_per_class_metrics",
    f"""WITH k AS ({_CLASS.format(keys='')}) SELECT truth, n AS rows, c AS correct, a AS accepted, ac AS accepted_correct,
     round(c / n, 6) AS raw_accuracy, round(ac / n, 6) AS accepted_recall FROM k""",
    "det",
)
def _(spark, sf):
    return (
        E.per_class_metrics(detections(spark, sf))
        .withColumn("raw_accuracy", r6("raw_accuracy")).withColumn("accepted_recall", r6("accepted_recall"))
    )


@query(
    "agg9_holdout_report",
    """WITH q AS (SELECT batch_id, truth, CASE WHEN accepted THEN prediction ELSE 'unknown' END AS p FROM det),
     k AS (SELECT batch_id, truth, count(*) AS n, count(*) FILTER (p = truth) AS c, count(*) FILTER (p = 'unknown') AS u FROM q GROUP BY 1, 2)
    SELECT batch_id, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(c) AS BIGINT) AS correct, CAST(sum(n - c - u) AS BIGINT) AS wrong,
     CAST(sum(u) AS BIGINT) AS unknown, round(sum(c) / greatest(sum(n) - sum(u), 1), 6) AS accepted_precision,
     round(sum(u) / sum(n), 6) AS rejection_rate, round(avg(c / n), 6) AS macro_recall FROM k GROUP BY 1""",
    "det",
)
def _(spark, sf):
    d = detections(spark, sf).withColumn("prediction", F.when(F.col("accepted"), F.col("prediction")))
    return E.holdout_report(d, ["batch_id"]).withColumns(
        {c: F.round(c, 6) for c in ("accepted_precision", "rejection_rate", "macro_recall")}
    )


EVAL_SQL = """ev AS (SELECT object_id, CASE frame_id % 3 WHEN 0 THEN 'final_holdout' WHEN 1 THEN 'final_acceptance' ELSE 'development' END AS split,
   CAST(frame_id AS VARCHAR) AS scene_id, part % 10 <> 0 AS human_reviewed, CASE WHEN supp % 97 = 5 THEN 'bench' ELSE 'competition' END AS platform_id,
   truth AS true_label, prediction AS mono_label, accepted AS mono_accepted,
   CASE WHEN part % 7 = 0 THEN NULL WHEN line <= 5 THEN truth ELSE prediction END AS fused_label, confidence > 0.6 AS fused_accepted,
   part % 1999 = 1 AS safety_state_upgraded, tax * 40 AS projection_error_px, w AS pair_delta_ms, price / 100 AS latency_ms,
   CASE WHEN supp % 2 = 0 THEN 'Orin_Nano' ELSE 'N100' END AS deployment_target, line = 7 AS side_occluded, line >= 6 AS association_error,
   part % 211 = 3 AS missed_object, batch_id FROM det)"""


def evaluation_rows(spark, sf):
    c, turn = F.col, F.col("frame_id") % 3
    return detections(spark, sf).select(
        "object_id", "batch_id",
        F.when(turn == 0, "final_holdout").when(turn == 1, "final_acceptance").otherwise("development").alias("split"),
        c("frame_id").cast("string").alias("scene_id"),
        (c("part") % 10 != 0).alias("human_reviewed"),
        F.when(c("supp") % 97 == 5, "bench").otherwise("competition").alias("platform_id"),
        c("truth").alias("true_label"),
        c("prediction").alias("mono_label"),
        c("accepted").alias("mono_accepted"),
        F.when(c("part") % 7 == 0, None).when(c("line") <= 5, c("truth")).otherwise(c("prediction")).alias("fused_label"),
        (c("confidence") > 0.6).alias("fused_accepted"),
        (c("part") % 1999 == 1).alias("safety_state_upgraded"),
        (c("tax") * 40).alias("projection_error_px"),
        c("w").alias("pair_delta_ms"),
        (c("price") / 100).alias("latency_ms"),
        F.when(c("supp") % 2 == 0, "Orin_Nano").otherwise("N100").alias("deployment_target"),
        (c("line") == 7).alias("side_occluded"),
        (c("line") >= 6).alias("association_error"),
        (c("part") % 211 == 3).alias("missed_object"),
    )


@query(
    "agg10_promotion_gates",
    f"""WITH {EVAL_SQL}, r AS (SELECT *, split = 'final_holdout' AS fin, split = 'final_acceptance' AS mul, split = 'development' AS dev FROM ev WHERE human_reviewed),
     rec AS (SELECT avg(m) AS m, avg(f) AS f FROM (SELECT true_label, count(*) FILTER (mono_label = true_label) / count(*) AS m,
        count(*) FILTER (fused_label = true_label) / count(*) AS f FROM r WHERE fin GROUP BY 1)),
     t AS (SELECT count(*) FILTER (fin) AS record_count,
       count(*) FILTER (fin AND mono_accepted AND mono_label IS DISTINCT FROM true_label) AS mono_wrong,
       count(*) FILTER (fin AND fused_accepted AND fused_label IS DISTINCT FROM true_label) AS fused_wrong,
       count(*) FILTER (mul AND fused_accepted AND fused_label IS DISTINCT FROM true_label) AS multi_wrong_accepts,
       count(*) FILTER (NOT dev AND safety_state_upgraded) AS safety_upgrades,
       count(*) FILTER (NOT dev AND association_error AND NOT side_occluded) AS association_errors,
       count(*) FILTER (mul AND missed_object) AS missed_objects,
       count(DISTINCT scene_id) FILTER (mul) AS final_scenes, count(DISTINCT scene_id) FILTER (dev) AS development_scenes,
       bool_and(platform_id = 'competition') FILTER (NOT dev) AS platform_ok,
       quantile_cont(projection_error_px, 0.95) FILTER (NOT dev) AS pp, quantile_cont(pair_delta_ms, 0.95) FILTER (NOT dev) AS pd,
       quantile_cont(latency_ms, 0.95) FILTER (NOT dev) AS lp,
       quantile_cont(latency_ms, 0.95) FILTER (NOT dev AND lower(deployment_target) = 'orin_nano') AS lo,
       quantile_cont(latency_ms, 0.95) FILTER (NOT dev AND lower(deployment_target) = 'n100') AS ln FROM r)
    SELECT record_count, mono_wrong, fused_wrong, multi_wrong_accepts, safety_upgrades, association_errors, missed_objects, final_scenes,
     development_scenes, platform_ok, round(m, 6) AS mono_macro_recall, round(f, 6) AS fused_macro_recall, round(pp, 4) AS projection_p95_px,
     round(pd, 4) AS pair_delta_p95_ms, round(lp, 4) AS latency_p95_ms, round(lo, 4) AS latency_p95_orin_nano, round(ln, 4) AS latency_p95_n100,
     round(f - m, 6) AS macro_recall_gain, round(mono_wrong / record_count, 6) AS mono_wrong_accept_rate,
     round(fused_wrong / record_count, 6) AS fused_wrong_accept_rate, f - m >= 0.03 AS gate_recall_gain, fused_wrong = 0 AS gate_wrong_accept_zero,
     multi_wrong_accepts = 0 AS gate_multi_wrong_accept_zero, development_scenes >= 30 AND final_scenes >= 30 AS gate_scene_counts,
     missed_objects = 0 AS gate_no_missed_object, safety_upgrades = 0 AS gate_no_safety_upgrade, association_errors = 0 AS gate_no_association_error,
     pp <= 3 AS gate_projection, pd <= 50 AS gate_pair_delta, lo <= 1000 AND ln <= 1000 AS gate_latency, platform_ok AS gate_platform,
     false AS promote FROM t, rec""",
    "det",
)
def _(spark, sf):
    out = E.promotion_gates(evaluation_rows(spark, sf))
    digits = {n: 6 for n in out.columns if n.endswith(("_recall", "_gain", "_rate"))} | {
        n: 4 for n in out.columns if "p95" in n
    }
    digits.pop("gate_recall_gain", None)
    return out.withColumns({n: F.round(n, d) for n, d in digits.items()})


@query(
    "agg11_platform_gates",
    f"""WITH k AS ({_CLASS.format(keys='batch_id, line <= 4 AS newer,')}), m AS (SELECT batch_id, newer, avg(ac / n) AS macro_recall,
       sum(a) / sum(n) AS coverage, sum(a) - sum(ac) AS wrong_accepts FROM k GROUP BY 1, 2)
    SELECT o.batch_id, n.macro_recall > o.macro_recall AS recall_improves, n.wrong_accepts <= o.wrong_accepts AS errors_do_not_increase,
     n.coverage >= o.coverage AS coverage_preserved FROM m o JOIN m n ON o.batch_id = n.batch_id AND NOT o.newer AND n.newer""",
    "det",
)
def _(spark, sf):
    d = detections(spark, sf).withColumn("run", F.when(F.col("line") <= 4, "new").otherwise("old"))
    metrics = E.decision_metrics(d, ["batch_id", "run"])
    return E.metric_gates(
        metrics, "run", ["batch_id"], "old", "new",
        {
            "recall_improves": ("macro_recall", "gt"),
            "errors_do_not_increase": ("wrong_accepts", "le"),
            "coverage_preserved": ("coverage", "ge"),
        },
    )


@query(
    "agg11_class_delta_gate",
    f"""WITH {EVAL_SQL}, k AS (SELECT true_label, count(*) FILTER (mono_label = true_label) / count(*) AS o,
      count(*) FILTER (fused_label = true_label) / count(*) AS n FROM ev GROUP BY 1)
    SELECT round(avg(n) - avg(o), 6) AS macro_delta, round(min(n - o), 6) AS worst_class_delta,
     avg(n) - avg(o) >= 0.03 AND min(n - o) >= -0.05 AS passed FROM k""",
    "det",
)
def _(spark, sf):
    rows = evaluation_rows(spark, sf).withColumnRenamed("true_label", "truth")
    return E.class_delta_gate(rows, "mono_label", "fused_label").select(
        r6("macro_delta"), r6("worst_class_delta"), "passed"
    )


@query(
    "agg12_macro_colour",
    """WITH q AS (SELECT batch_id, truth, CASE WHEN accepted THEN prediction ELSE 'unknown' END AS p FROM det),
     k AS (SELECT batch_id, truth, count(*) AS n, count(*) FILTER (p = truth) AS c, count(*) FILTER (p = 'unknown') AS u FROM q GROUP BY 1, 2)
    SELECT batch_id, CAST(sum(n) AS BIGINT) AS samples, round(avg(c / n), 6) AS macro_recall,
     CAST(sum(n - c - u) AS BIGINT) AS wrong_acceptance_count, CAST(sum(u) AS BIGINT) AS unknown_count FROM k GROUP BY 1""",
    "det",
)
def _(spark, sf):
    d = detections(spark, sf).withColumn("prediction", F.when(F.col("accepted"), F.col("prediction")))
    return E.macro_colour(d, ["batch_id"]).withColumn("macro_recall", r6("macro_recall"))


def before_after(spark, sf):
    return evaluation_rows(spark, sf).select(
        "object_id", "batch_id", F.col("scene_id"), F.col("true_label").alias("truth"),
        F.col("mono_label").alias("before"), F.col("fused_label").alias("after"),
    )


@query(
    "agg13_corrected_damaged",
    f"""WITH {EVAL_SQL}, p AS (SELECT batch_id, mono_label IS NOT DISTINCT FROM true_label AS w, fused_label IS NOT DISTINCT FROM true_label AS n FROM ev)
    SELECT batch_id, count(*) FILTER (NOT w AND n) AS corrected, count(*) FILTER (w AND NOT n) AS damaged,
     count(*) FILTER (NOT w AND n) - count(*) FILTER (w AND NOT n) AS net FROM p GROUP BY 1""",
    "det",
)
def _(spark, sf):
    return E.corrected_damaged(before_after(spark, sf), ["batch_id"])


@query(
    "agg13_changed_rows",
    f"""WITH {EVAL_SQL}, p AS (SELECT object_id, mono_label IS NOT DISTINCT FROM true_label AS w, fused_label IS NOT DISTINCT FROM true_label AS n FROM ev)
    SELECT object_id, CASE WHEN n THEN 'corrected' ELSE 'damaged' END AS change FROM p WHERE w <> n""",
    "det",
)
def _(spark, sf):
    return E.changed_rows(before_after(spark, sf), "object_id")


@query(
    "agg14_change_summary",
    """WITH p AS (SELECT CASE WHEN part % 11 <> 0 THEN x || ',' || y END AS bb, CASE WHEN part % 13 <> 0 THEN (x + (line % 2)) || ',' || y END AS ab,
       CAST(w AS BIGINT) AS bp, CAST(floor(confidence * 50) AS BIGINT) AS ap FROM det)
    SELECT count(*) AS samples, count(*) FILTER (bb IS NULL) AS before_missing, count(*) FILTER (ab IS NULL) AS after_missing,
     count(*) FILTER (bb IS DISTINCT FROM ab) AS box_changed, count(*) FILTER (ap > bp) AS pixels_increased,
     count(*) FILTER (ap < bp) AS pixels_decreased, count(*) FILTER (bb IS NULL AND ab IS NOT NULL) AS newly_detected,
     count(*) FILTER (bb IS NOT NULL AND ab IS NULL) AS newly_missing FROM p""",
    "det",
)
def _(spark, sf):
    c = F.col
    return E.change_summary(
        detections(spark, sf).select(
            F.when(c("part") % 11 != 0, F.array("x", "y")).alias("before_box"),
            F.when(c("part") % 13 != 0, F.array(c("x") + c("line") % 2, c("y"))).alias("after_box"),
            c("w").cast("bigint").alias("before_pixels"),
            F.floor(c("confidence") * 50).alias("after_pixels"),
        )
    )


_COMP = """b AS (SELECT frame_id, truth AS label, 1 AS e, 0 AS p FROM det UNION ALL
   SELECT frame_id, prediction, 0, 1 FROM det WHERE accepted),
  l AS (SELECT frame_id, label, sum(e) AS e, sum(p) AS p FROM b GROUP BY 1, 2),
  f AS (SELECT frame_id, CAST(sum(e) AS BIGINT) AS expected, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(least(e, p)) AS BIGINT) AS overlap,
   sum(e) = sum(p) AS count_match, bool_and(e = p) AS exact_match FROM l GROUP BY 1)"""


def _matches(spark, sf):
    d = detections(spark, sf)
    return E.composition_match(
        d.select("frame_id", F.col("truth").alias("label")),
        d.filter("accepted").select("frame_id", F.col("prediction").alias("label")),
    )


@query("agg15_composition_match", f"WITH {_COMP} SELECT * FROM f", "det")
def _(spark, sf):
    return _matches(spark, sf)


@query(
    "agg15_composition_totals",
    f"""WITH {_COMP} SELECT count(*) AS frames, count(*) FILTER (count_match) AS count_matches, count(*) FILTER (exact_match) AS exact_matches,
     CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(predicted) AS BIGINT) AS predicted, CAST(sum(overlap) AS BIGINT) AS overlap FROM f""",
    "det",
)
def _(spark, sf):
    return E.composition_totals(_matches(spark, sf))


@query(
    "agg16_review_inventory",
    f"""WITH {SAFETY_SQL}, s AS (SELECT frame_id, shape_known, grasp > 0.9 AS sel, {STATUS_SQL} AS status FROM saf)
    SELECT frame_id, count(*) AS candidates, count(*) FILTER (NOT shape_known) AS unknown, count(*) FILTER (sel) AS selected,
     count(*) FILTER (status = 'PICKABLE') AS n_pickable, count(*) FILTER (status = 'UNCERTAIN') AS n_uncertain,
     count(*) FILTER (status = 'OCCLUDED') AS n_occluded, count(*) FILTER (status = 'DEPTH_INVALID') AS n_depth_invalid,
     count(*) FILTER (status = 'NO_GRASP_SURFACE') AS n_no_grasp_surface FROM s GROUP BY 1""",
    "det",
)
def _(spark, sf):
    objects = safety(spark, sf).select(
        "frame_id", F.when(F.col("shape_known"), "shape").alias("shape"),
        (F.col("grasp") > 0.9).alias("selected"), status_of().alias("status"),
    )
    return E.review_inventory(
        objects, ["PICKABLE", "UNCERTAIN", "OCCLUDED", "DEPTH_INVALID", "NO_GRASP_SURFACE"]
    )


@query(
    "agg17_modal_outliers",
    """WITH c AS (SELECT batch_id, frame_id, count(*) AS candidates FROM det GROUP BY 1, 2),
     t AS (SELECT batch_id, candidates, count(*) AS n, min(frame_id) AS f FROM c GROUP BY 1, 2),
     m AS (SELECT batch_id, candidates AS mode FROM t QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY n DESC, f) = 1)
    SELECT batch_id, frame_id, candidates, mode FROM c JOIN m USING (batch_id) WHERE candidates <> mode""",
    "det",
)
def _(spark, sf):
    counts = detections(spark, sf).groupBy("batch_id", "frame_id").agg(F.count(F.lit(1)).alias("candidates"))
    return E.modal_outliers(counts, "batch_id", "frame_id", "candidates")


DEPTH_QUALITY_SQL = """c AS (SELECT * FROM grid WHERE u BETWEEN 8 AND 31 AND v BETWEEN 8 AND 31),
  d AS (SELECT a.frame_id, k.s, abs(a.depth - b.depth) AS d FROM c a, (VALUES (1, 1, 0), (1, 0, 1), (3, 3, 0), (3, 0, 3)) k(s, du, dv), c b
    WHERE a.frame_id = b.frame_id AND b.u = a.u + k.du AND b.v = a.v + k.dv),
  n AS (SELECT frame_id, quantile_cont(d, 0.95) FILTER (s = 1) AS p1, quantile_cont(d, 0.95) FILTER (s = 3) AS p3,
    count(*) FILTER (s = 1 AND d = 0) / nullif(count(*) FILTER (s = 1), 0) AS same FROM d WHERE d <= 10 GROUP BY 1),
  g AS (SELECT frame_id, count(*) * 100.0::DOUBLE / 1600 AS valid, count(*) FILTER (u BETWEEN 8 AND 31 AND v BETWEEN 8 AND 31) * 100.0::DOUBLE / 576 AS centre,
    min(depth) AS lo, median(depth) AS me, max(depth) AS hi FROM grid GROUP BY 1),
  q AS (SELECT frame_id, round(valid, 4) AS valid_percent, round(centre, 4) AS center_valid_percent, round(p1, 4) AS difference_p95,
    round(p3, 4) AS stride3_difference_p95, round(same, 4) AS identical_ratio, round(lo, 4) AS min_depth, round(me, 4) AS median_depth,
    round(hi, 4) AS max_depth FROM g LEFT JOIN n USING (frame_id))"""


def depth_quality(spark, sf):
    out = grids.depth_quality(grid(spark, sf), ["frame_id"], width=40, height=40)
    return out.select("frame_id", *[F.round(c, 4).alias(c) for c in out.columns if c != "frame_id"])


@query("agg18_depth_quality", f"WITH {DEPTH_QUALITY_SQL} SELECT * FROM q", "grid")
def _(spark, sf):
    return depth_quality(spark, sf)


@query(
    "agg19_depth_report",
    f"""WITH {DEPTH_QUALITY_SQL}, l AS (UNPIVOT (SELECT * EXCLUDE (frame_id) FROM q) ON COLUMNS(*) INTO NAME metric VALUE x)
    SELECT metric, round(min(x), 3) AS min, round(quantile_cont(x, 0.05), 3) AS p05, round(quantile_cont(x, 0.5), 3) AS median,
     round(quantile_cont(x, 0.95), 3) AS p95, round(max(x), 3) AS max FROM l GROUP BY 1""",
    "grid",
)
def _(spark, sf):
    q = depth_quality(spark, sf)
    metrics = [c for c in q.columns if c != "frame_id"]
    return grids.metric_report(q, metrics).select("metric", *[F.round(c, 3).alias(c) for c in ("min", "p05", "median", "p95", "max")])


@query(
    "agg20_latency_profile",
    """WITH s AS (SELECT unnest([{'stage': 'segment', 'ms': value}, {'stage': 'classify', 'ms': value * 2 + 1}, {'stage': kind, 'ms': value / 3},
       {'stage': 'total', 'ms': value + (value * 2 + 1) + value / 3}]) AS e FROM frames)
    SELECT e.stage AS stage, round(avg(e.ms), 4) AS mean_ms, count(*) AS samples, round(quantile_cont(e.ms, 0.5), 4) AS p50_ms,
     round(quantile_cont(e.ms, 0.95), 4) AS p95_ms, quantile_cont(e.ms, 0.95) <= 300 AS target_met FROM s GROUP BY 1""",
    "frames",
)
def _(spark, sf):
    v = F.col("value")
    stages = frames(spark, sf).select(
        F.create_map(F.lit("segment"), v, F.lit("classify"), v * 2 + 1, F.col("kind"), v / 3).alias("stages")
    )
    out = E.latency_profile(stages, "stages", target_ms=300.0)
    return out.withColumns({c: F.round(c, 4) for c in ("mean_ms", "p50_ms", "p95_ms")})


@query(
    "agg21_nearest_rank_p95",
    "SELECT kind, quantile_disc(value, 0.95) AS p95 FROM frames GROUP BY 1",
    "frames",
)
def _(spark, sf):
    return E.nearest_rank_p95(frames(spark, sf), ["kind"], F.col("value"))


@query(
    "agg21_sorted_alignment",
    """WITH q AS (SELECT frame_id, truth, CASE WHEN part % 9 <> 0 THEN prediction END AS p FROM det),
     l AS (SELECT frame_id, list_sort(list(truth)) AS t, coalesce(list_sort(list(p) FILTER (p IS NOT NULL)), []) AS p FROM q GROUP BY 1)
    SELECT frame_id, len(t) AS expected, len(p) AS detected,
     CASE WHEN len(t) = len(p) THEN len(list_filter(range(1, len(t) + 1), lambda i: t[i] = p[i])) ELSE 0 END AS correct FROM l""",
    "det",
)
def _(spark, sf):
    d = detections(spark, sf).withColumn("prediction", F.when(F.col("part") % 9 != 0, F.col("prediction")))
    return E.sorted_alignment(d)


def edge_rows(spark, sf):
    v = F.col("v")
    return vectors(spark, sf).select(
        "label",
        (v[0] > -0.05).alias("accepted"),
        F.floor(F.abs(v[1]) * 20).alias("edges"),
        F.floor(F.abs(v[2]) * 20).alias("rejected_edges"),
        F.floor(F.abs(v[3]) * 9).alias("dangling"),
        F.abs(v[4]).alias("outer_iou"),
        F.abs(v[5]).alias("rejected_ratio"),
        F.floor(F.abs(v[6]) * 9).alias("internal_lines"),
        F.floor(F.abs(v[7]) * 1000).alias("predicted_support"),
        F.floor(F.abs(v[8]) * 1000).alias("true_support"),
        F.floor(F.abs(v[7]) * 800).alias("matched_predicted"),
        F.floor(F.abs(v[8]) * 700).alias("matched_true"),
    )


EDGE_SQL = """er AS (SELECT label, v[1] > -0.05 AS accepted, CAST(floor(abs(v[2]) * 20) AS BIGINT) AS edges, CAST(floor(abs(v[3]) * 20) AS BIGINT) AS rejected_edges,
  floor(abs(v[4]) * 9) AS dangling, abs(v[5]) AS outer_iou, abs(v[6]) AS rejected_ratio, floor(abs(v[7]) * 9) AS internal_lines,
  floor(abs(v[8]) * 1000) AS ps, floor(abs(v[9]) * 1000) AS ts, floor(abs(v[8]) * 800) AS mp, floor(abs(v[9]) * 700) AS mt FROM vec)"""


@query(
    "agg22_edge_audit",
    f"""WITH {EDGE_SQL} SELECT label, count(*) AS images, count(*) FILTER (accepted) AS accepted_images, round(count(*) FILTER (accepted) / count(*), 6) AS coverage_rate,
     round(count(*) FILTER (edges >= 2) / count(*), 6) AS two_edges_rate, round(avg(edges), 6) AS mean_edges, CAST(sum(edges) AS BIGINT) AS fused_edges,
     CAST(sum(rejected_edges) AS BIGINT) AS rejected_edges FROM er GROUP BY 1""",
    "vec",
)
def _(spark, sf):
    return E.edge_audit(edge_rows(spark, sf), ["label"]).withColumns(
        {c: F.round(c, 6) for c in ("coverage_rate", "two_edges_rate", "mean_edges")}
    )


@query(
    "agg22_structure_audit",
    f"""WITH {EDGE_SQL} SELECT label, round(count(*) FILTER (accepted) / count(*), 6) AS clean_rate, round(count(*) FILTER (dangling = 0) / count(*), 6) AS zero_dangling_rate,
     round(avg(outer_iou), 6) AS mean_iou, round(avg(rejected_ratio), 6) AS mean_rejected_ratio,
     round(count(*) FILTER (internal_lines > 0) / count(*), 6) AS line_coverage FROM er GROUP BY 1""",
    "vec",
)
def _(spark, sf):
    out = E.structure_audit(edge_rows(spark, sf), ["label"])
    return out.select("label", *[F.round(c, 6).alias(c) for c in out.columns if c != "label"])


@query(
    "agg23_line_precision_recall",
    f"""WITH {EDGE_SQL} SELECT label, round(sum(mp) / greatest(sum(ps), 1), 6) AS precision, round(sum(mt) / greatest(sum(ts), 1), 6) AS recall FROM er GROUP BY 1""",
    "vec",
)
def _(spark, sf):
    return E.line_precision_recall(edge_rows(spark, sf), ["label"]).select("label", r6("precision"), r6("recall"))


@query(
    "agg24_mask_iou",
    """WITH m AS (SELECT frame_id, u, v, depth < 500 AS p, depth > 250 AS t FROM grid)
    SELECT frame_id, round(count(*) FILTER (p AND t) / greatest(count(*) FILTER (p OR t), 1), 6) AS iou,
     round(count(*) FILTER (t AND NOT p) / greatest(count(*) FILTER (t), 1), 6) AS missed_fraction,
     round(count(*) FILTER (p AND NOT t) / greatest(count(*) FILTER (p), 1), 6) AS excess_fraction FROM m GROUP BY 1""",
    "grid",
)
def _(spark, sf):
    g = grid(spark, sf)
    out = E.mask_iou(g.filter("depth < 500"), g.filter("depth > 250"), ["frame_id"], ["u", "v"])
    return out.select("frame_id", r6("iou"), r6("missed_fraction"), r6("excess_fraction"))


@query(
    "agg25_sparse_summary",
    """WITH o AS (SELECT frame_id, CASE WHEN accepted THEN 'TWO_VIEW' ELSE 'TOP_ONLY' END AS state, CAST(w AS BIGINT) % 5 AS nodes, line % 3 AS edges, tax * 40 AS e,
       CASE WHEN part % 4 = 0 THEN 'OUTSIDE_OBJECT_ENVELOPE' WHEN part % 4 = 1 THEN 'AMBIGUOUS_OR_NO_MUTUAL_MATCH' END AS reason FROM det)
    SELECT 'state' AS section, state AS key, CAST(count(*) AS DOUBLE) AS value FROM o GROUP BY 2
    UNION ALL SELECT 'rejection', reason, count(*) FROM o WHERE reason IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'total', 'nodes', sum(nodes) FROM o UNION ALL SELECT 'total', 'edges', sum(edges) FROM o
    UNION ALL SELECT 'total', 'frames_with_nodes', count(DISTINCT frame_id) FROM o WHERE nodes > 0
    UNION ALL SELECT 'total', 'frames_with_edges', count(DISTINCT frame_id) FROM o WHERE edges > 0
    UNION ALL SELECT 'error', 'reprojection_p95', round(quantile_cont(e, 0.95), 4) FROM o WHERE nodes > 0""",
    "det",
)
def _(spark, sf):
    c = F.col
    objects = detections(spark, sf).select(
        "frame_id", F.when(c("accepted"), "TWO_VIEW").otherwise("TOP_ONLY").alias("state"),
        (c("w").cast("bigint") % 5).alias("nodes"), (c("line") % 3).alias("edges"), (c("tax") * 40).alias("max_error"),
        F.when(c("part") % 4 == 0, "OUTSIDE_OBJECT_ENVELOPE").when(c("part") % 4 == 1, "AMBIGUOUS_OR_NO_MUTUAL_MATCH").alias("reason"),
    )
    out = E.sparse_summary(objects, objects.filter("reason is not null"))
    return out.withColumn("value", F.round("value", 4))


@query(
    "agg26_fusion_summary",
    f"""WITH {SAFETY_SQL}, s AS (SELECT saf.*, {STATUS_SQL} AS status, d.truth, d.prediction, d.line, d.part, d.supp FROM saf JOIN det d USING (frame_id, object_id)),
     o AS (SELECT CASE line % 4 WHEN 0 THEN 'FUSED' WHEN 1 THEN 'TOP_ONLY' WHEN 2 THEN 'CONFLICT' END AS st, status, truth, prediction,
       part % 17 = 0 AS illegal, grasp > 0.9 AS sel, CASE WHEN supp % 9 = 0 THEN 'old' ELSE 'new' END AS h FROM s)
    SELECT coalesce(st, 'NO_DUAL_RESULT') AS fusion_state, count(*) AS objects, count(*) FILTER (status = 'PICKABLE' AND truth <> prediction) AS wrong_pickable,
     count(*) FILTER (illegal) AS illegal_upgrades, count(*) FILTER (sel) AS selected, round(count(*) FILTER (truth = prediction) / count(*), 6) AS accuracy,
     count(*) FILTER (h <> 'new') AS hash_mismatches FROM o GROUP BY 1""",
    "det",
)
def _(spark, sf):
    c = F.col
    extra = detections(spark, sf).select("frame_id", "object_id", "truth", "prediction", "line", "part", "supp")
    turn = c("line") % 4
    objects = safety(spark, sf).withColumn("status", status_of()).join(extra, ["frame_id", "object_id"]).select(
        F.when(turn == 0, "FUSED").when(turn == 1, "TOP_ONLY").when(turn == 2, "CONFLICT").alias("fusion_state"),
        "status", "truth", c("prediction").alias("shape"), (c("part") % 17 == 0).alias("illegal"),
        (c("grasp") > 0.9).alias("selected"), F.when(c("supp") % 9 == 0, "old").otherwise("new").alias("hash"),
        F.lit("new").alias("expected_hash"),
    )
    return E.fusion_summary(objects).withColumn("accuracy", r6("accuracy"))


@query(
    "agg27_backend_parity",
    """WITH b AS (SELECT object_id || frame_id AS sample, k.b AS backend, CASE WHEN k.b = 'native' AND part % 50 = 0 THEN 'R' ELSE prediction END AS label,
       accepted OR (k.b = 'vector' AND part % 70 = 0) AS accepted, price / 100 * k.f AS ms FROM det, (VALUES ('plain', 1.0::DOUBLE), ('native', 0.5::DOUBLE), ('vector', 0.9::DOUBLE)) k(b, f)),
     c AS (SELECT b.backend, count(*) AS samples, count(*) FILTER (b.label <> r.label OR b.accepted <> r.accepted) AS mismatches, quantile_cont(b.ms, 0.95) AS p
       FROM b JOIN b r ON r.backend = 'plain' AND r.sample = b.sample GROUP BY 1)
    SELECT backend, true AS tested, samples, mismatches, round(p, 4) AS p95_ms, mismatches = 0 AND p <= 1000 AS passed FROM c
    UNION ALL SELECT 'absent', false, 0, 0, NULL, false""",
    "det",
)
def _(spark, sf):
    c = F.col
    kinds = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(f).alias("f")) for b, f in (("plain", 1.0), ("native", 0.5), ("vector", 0.9))])
    runs = detections(spark, sf).withColumn("k", F.explode(kinds)).select(
        F.concat(c("object_id"), c("frame_id").cast("string")).alias("sample"), c("k.b").alias("backend"),
        F.when((c("k.b") == "native") & (c("part") % 50 == 0), "R").otherwise(c("prediction")).alias("label"),
        (c("accepted") | ((c("k.b") == "vector") & (c("part") % 70 == 0))).alias("accepted"),
        (c("price") / 100 * c("k.f")).alias("latency_ms"),
    )
    return E.backend_parity(runs, "plain", ["plain", "native", "vector", "absent"]).withColumn("p95_ms", F.round("p95_ms", 4))


@query(
    "agg28_failure_denominator",
    """SELECT coalesce(reason, 'missing') AS reason, count(*) AS rows FROM (SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN NULL
      WHEN toxic = 1 THEN 'flagged' WHEN quality = 0 THEN 'low_quality' ELSE 'ok' END AS reason FROM documents LEFT JOIN labels l USING (doc_id)) GROUP BY 1""",
)
def _(spark, sf):
    outcome = F.when(F.col("toxic") == 1, "flagged").when(F.col("quality") == 0, "low_quality").otherwise("ok")
    marks = table(spark, sf, "labels").select(F.col("doc_id").alias("sample"), outcome.alias("reason"))
    return A.failure_denominator(captures(spark, sf), marks, "sample")


@query(
    "agg29_frozen_population_hash",
    """WITH ids AS (SELECT CAST(doc_id AS VARCHAR) AS id FROM documents),
     l6 AS (SELECT sha256(id)[1:6] AS leaf, sha256(CAST(to_json(list_sort(list(id))) AS VARCHAR)) AS h FROM ids GROUP BY 1),
     l4 AS (SELECT leaf[1:4] AS p, sha256(CAST(to_json(list_sort(list({'leaf': leaf, 'h': h}))) AS VARCHAR)) AS h FROM l6 GROUP BY 1),
     l2 AS (SELECT p[1:2] AS q, sha256(CAST(to_json(list_sort(list({'leaf': p, 'h': h}))) AS VARCHAR)) AS h FROM l4 GROUP BY 1)
    SELECT sha256(CAST(to_json(list_sort(list({'leaf': q, 'h': h}))) AS VARCHAR)) AS population_hash FROM l2""",
)
def _(spark, sf):
    return A.population_hash(table(spark, sf, "documents"), "doc_id")


@query(
    "agg30_class_weights",
    """WITH c AS (SELECT label, count(*) AS samples FROM vec GROUP BY 1)
    SELECT label, samples, round((SELECT sum(samples) FROM c) / ((SELECT count(*) FROM c) * samples), 6) AS weight FROM c""",
    "vec",
)
def _(spark, sf):
    return A.class_weights(vectors(spark, sf), "label").withColumn("weight", r6("weight"))


@query(
    "agg31_view_spread",
    """WITH p AS (SELECT id, v[1]*300 AS x0, v[2]*300 AS y0, v[3]*300 AS x1, v[4]*300 AS y1, v[5]*300 AS x2, v[6]*300 AS y2, v[7]*300 AS x3, v[8]*300 AS y3 FROM vec)
    SELECT id, round((x0+x1+x2+x3)/4, 6) AS cx, round((y0+y1+y2+y3)/4, 6) AS cy,
     round(ln(greatest(abs(x0*y1-x1*y0 + x1*y2-x2*y1 + x2*y3-x3*y2 + x3*y0-x0*y3) / 2, 1)), 6) AS log_area,
     round(atan2(y1-y0, x1-x0), 6) AS angle FROM p""",
    "vec",
)
def _(spark, sf):
    v = F.col("v")
    corners = F.array(*[F.struct((v[2 * i] * 300).alias("x"), (v[2 * i + 1] * 300).alias("y")) for i in range(4)])
    return vectors(spark, sf).select("id", A.view_signature(corners).alias("s")).select(
        "id", *[F.round(f"s.{c}", 6).alias(c) for c in ("cx", "cy", "log_area", "angle")]
    )


@query(
    "agg32_robust_outliers",
    """WITH m AS (SELECT kind, median(value) AS med FROM frames GROUP BY 1),
     d AS (SELECT kind, median(abs(value - med)) AS mad FROM frames JOIN m USING (kind) GROUP BY 1)
    SELECT frame_id, round(greatest(1.2, med + 3 * 1.4826 * mad), 4) AS lim, value > greatest(1.2, med + 3 * 1.4826 * mad) AS outlier
    FROM frames JOIN m USING (kind) JOIN d USING (kind)""",
    "frames",
)
def _(spark, sf):
    return E.robust_outliers(frames(spark, sf), ["kind"], "value").select("frame_id", F.round("limit", 4).alias("lim"), "outlier")
