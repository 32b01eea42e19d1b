"""WIN1-WIN21, TOP1-TOP5, SET1-SET6."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.catalog.aggregates import DEPTH_QUALITY_SQL, LANGS, depth_quality
from framelake.catalog.base import query
from framelake.catalog.joins import HALF_SQL, RUN_SQL, halves, runs
from framelake.catalog.projections import SAFETY_SQL, STATUS_SQL, safety, status_of
from framelake.catalog.views import THUMB_CELLS, captures, detections, frames, scores, segments, table, thumb_sql, thumbnail, vectors
from framelake.functions import labels
from framelake.functions import scores as score_fn
from framelake.operators import poses, sets
from framelake.operators import segments as seg_ops
from framelake.operators import sequences as Q
from framelake.operators import splits as S
from framelake.plans.small import literal_table

GROUP_SQL = """gd AS (SELECT sample, batch_id || '/' || label_id AS grp, n_chars FROM docs)"""


def grouped(spark, sf):
    return captures(spark, sf).select("sample", F.concat_ws("/", "batch_id", "label_id").alias("grp"), "n_chars")


def _rank(seed, source, group="grp", item="sample"):
    return (
        f"row_number() OVER (PARTITION BY {group} ORDER BY sha256(concat('{seed}', chr(0), {group}, chr(0), CAST({item} AS VARCHAR))), {item})"
    )


@query(
    "win1_group_holdout",
    f"WITH {GROUP_SQL} SELECT sample, grp, CASE WHEN {_rank(23, 'gd')} <= 3 THEN 'holdout' ELSE 'training' END AS role FROM gd",
    "docs",
)
def _(spark, sf):
    return S.group_holdout(grouped(spark, sf), "grp", "sample", n=3, seed=23).select("sample", "grp", "role")


@query(
    "win1_holdout_problems",
    f"WITH {GROUP_SQL} SELECT grp AS key, 'needs at least 4' AS problem, count(*) AS rows FROM gd GROUP BY 1 HAVING count(*) <= 3",
    "docs",
)
def _(spark, sf):
    return S.holdout_problems(grouped(spark, sf), "grp", "sample", 3)


@query(
    "win2_adaptive_holdout",
    f"WITH {GROUP_SQL} SELECT sample, grp, CASE WHEN {_rank(5, 'gd')} <= least(3, count(*) OVER (PARTITION BY grp) - 1) THEN 'holdout' ELSE 'training' END AS role FROM gd",
    "docs",
)
def _(spark, sf):
    return S.adaptive_holdout(grouped(spark, sf), "grp", "sample", n=3, seed=5).select("sample", "grp", "role")


@query(
    "win3_nested_split",
    f"""WITH {GROUP_SQL}, o AS (SELECT *, {_rank(7, 'gd')} <= 2 AS held FROM gd),
     i AS (SELECT sample, grp, CASE WHEN {_rank(8, 't')} <= least(2, count(*) OVER (PARTITION BY grp) - 1) THEN 'calibration' ELSE 'fit' END AS role FROM o AS t WHERE NOT held)
    SELECT sample, grp, 'holdout' AS role FROM o WHERE held UNION ALL SELECT * FROM i""",
    "docs",
)
def _(spark, sf):
    return S.nested_split(grouped(spark, sf), "grp", "sample", n=2, calibration=2, seed=7).select("sample", "grp", "role")


@query(
    "win3_frozen_split",
    f"""WITH {GROUP_SQL}, o AS (SELECT *, sample IN (SELECT doc_id FROM labels WHERE toxic = 1) AS held FROM gd),
     i AS (SELECT sample, grp, CASE WHEN {_rank(8, 't')} <= least(2, count(*) OVER (PARTITION BY grp) - 1) THEN 'calibration' ELSE 'fit' END AS role FROM o AS t WHERE NOT held),
     a AS (SELECT sample, grp, 'holdout' AS role FROM o WHERE held UNION ALL SELECT * FROM i)
    SELECT grp, role, count(*) AS rows FROM a GROUP BY 1, 2""",
    "docs",
)
def _(spark, sf):
    frozen = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("sample"))
    out = S.nested_split(grouped(spark, sf), "grp", "sample", calibration=2, seed=7, frozen=frozen)
    return S.split_counts(out, "grp")


@query(
    "win4_stratified_folds",
    f"WITH g AS (SELECT sample, label_id AS grp FROM docs) SELECT sample, grp AS label_id, ({_rank(11, 'g')} - 1) % 5 AS fold FROM g",
    "docs",
)
def _(spark, sf):
    return S.stratified_folds(captures(spark, sf), "label_id", "sample", k=5, seed=11).select("sample", "label_id", "fold")


STRATA_SQL = """st AS (SELECT sample, label_id, 'col' || n_chars % 2 AS color, CASE WHEN batch_id IN ('src3', 'src8') THEN 1 ELSE 0 END AS prio FROM docs)"""


@query(
    "win5_stratified_sample",
    f"""WITH {STRATA_SQL}, c AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY color, label_id ORDER BY prio DESC, sample) <= 2),
     r AS (SELECT *, row_number() OVER (ORDER BY sample) AS k FROM st WHERE sample NOT IN (SELECT sample FROM c))
    SELECT sample, label_id, color FROM c UNION ALL SELECT sample, label_id, color FROM r WHERE k <= 24 - (SELECT count(*) FROM c)""",
    "docs",
)
def _(spark, sf):
    rows = captures(spark, sf).select(
        "sample", "label_id", F.concat(F.lit("col"), (F.col("n_chars") % 2).cast("string")).alias("color"),
        F.col("batch_id").isin("src3", "src8").cast("int").alias("prio"),
    )
    return S.stratified_sample(rows, ["color", "label_id"], "sample", priority="prio").select("sample", "label_id", "color")


@query(
    "win6_distinct_shapes_per_colour",
    """WITH p AS (SELECT p_brand AS colour, p_name AS shape, p_type AS category, p_partkey AS item FROM part),
     f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY colour, shape ORDER BY category, item) = 1)
    SELECT colour, shape, category, item FROM f QUALIFY row_number() OVER (PARTITION BY colour ORDER BY category, item) <= 6""",
)
def _(spark, sf):
    c = F.col
    rows = table(spark, sf, "part").select(
        c("p_brand").alias("colour"), c("p_name").alias("shape"), c("p_type").alias("category"), c("p_partkey").alias("item")
    )
    return S.distinct_per_group(rows, "colour", "shape", ["category", "item"], n=6)


@query(
    "win7_temporal_split",
    """WITH o AS (SELECT sample, batch_id, label_id, row_number() OVER (PARTITION BY batch_id, label_id ORDER BY sample) AS ordinal FROM docs)
    SELECT sample, ordinal, CASE WHEN batch_id IN ('src0', 'src1') THEN 'train' WHEN batch_id IN ('src2', 'src3') THEN CASE WHEN ordinal <= 20 THEN 'train' ELSE 'test' END
      WHEN batch_id = 'src4' THEN 'validation' ELSE 'unused' END AS role FROM o""",
    "docs",
)
def _(spark, sf):
    return S.temporal_split(
        captures(spark, sf), ["batch_id", "label_id"], "sample", batch="batch_id",
        train=["src0", "src1"], mixed=["src2", "src3"], validation=["src4"],
    ).select("sample", "ordinal", "role")


@query(
    "win8_keep_first_by_hash",
    """WITH r AS (SELECT sample, sha256(content) AS sha256, CASE WHEN label_id = 'en' THEN 1 ELSE 0 END AS root FROM docs)
    SELECT sample, sha256, first_value(sample) OVER w AS kept_item, row_number() OVER w = 1 AS kept FROM r WINDOW w AS (PARTITION BY sha256 ORDER BY root, sample)""",
    "docs",
)
def _(spark, sf):
    rows = captures(spark, sf).select(
        "sample", labels.content_hash(F.col("content")).alias("sha256"), (F.col("label_id") == "en").cast("int").alias("root")
    )
    return S.keep_first_by_hash(rows, "sha256", ["root", "sample"], "sample").select("sample", "sha256", "kept_item", "kept")


@query(
    "win9_limit_per_class",
    "SELECT truth, frame_id, object_id FROM det QUALIFY row_number() OVER (PARTITION BY truth ORDER BY frame_id, object_id) <= 7",
    "det",
)
def _(spark, sf):
    from framelake.plans.scan import top_n_per_key

    return top_n_per_key(
        detections(spark, sf).select("truth", "frame_id", "object_id"), ["truth"], [F.asc("frame_id"), F.asc("object_id")], 7
    ).drop("rank")


@query(
    "win10_primary_object",
    """SELECT o_orderkey AS frame_id, coalesce(object_id, 'none') AS object_id, coalesce(prediction, 'unknown') AS prediction FROM orders LEFT JOIN det ON frame_id = o_orderkey
    QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY price DESC, object_id) = 1""",
    "det",
)
def _(spark, sf):
    frames_all = table(spark, sf, "orders").select(F.col("o_orderkey").alias("frame_id"))
    rows = frames_all.join(detections(spark, sf), "frame_id", "left")
    return Q.primary_object(rows, "frame_id", "price", "object_id", ["prediction"]).select(
        "frame_id", F.coalesce("object_id", F.lit("none")).alias("object_id"), F.coalesce("prediction", F.lit("unknown")).alias("prediction")
    )


TARGET_SQL = f"""{SAFETY_SQL}, tg AS (SELECT frame_id, object_id, colour_confidence, clearance, {STATUS_SQL} AS status,
   0.75 * colour_confidence + 0.25 * greatest(0, least(1, coalesce(clearance / 40, 1))) AS score FROM saf)"""


def targets(spark, sf):
    return safety(spark, sf).select(
        "frame_id", "object_id", "colour_confidence", "clearance", status_of().alias("status"),
        Q.selection_score(F.col("colour_confidence"), F.col("clearance")).alias("score"),
    )


@query(
    "win11_select_target",
    f"""WITH {TARGET_SQL}, b AS (SELECT frame_id, arg_min(object_id, (-score, object_id)) AS best FROM tg WHERE status = 'PICKABLE' GROUP BY 1)
    SELECT tg.frame_id, object_id, round(score, 6) AS score, status = 'PICKABLE' AND coalesce(object_id = best, false) AS selected FROM tg LEFT JOIN b USING (frame_id)""",
    "det",
)
def _(spark, sf):
    return Q.select_target(targets(spark, sf), ["frame_id"], "object_id", "score").select(
        "frame_id", "object_id", F.round("score", 6).alias("score"), "selected"
    )


@query(
    "win12_better_pass",
    """WITH a AS (SELECT frame_id, object_id, confidence, part % 5 = 0 AS selected, 1 AS pass FROM det), b AS (SELECT frame_id, object_id || 'r', confidence * 0.9, part % 3 = 0, 2 FROM det),
     u AS (SELECT * FROM a UNION ALL SELECT * FROM b), m AS (SELECT frame_id, coalesce(max(confidence) FILTER (selected AND pass = 1), -1) AS b1, coalesce(max(confidence) FILTER (selected AND pass = 2), -1) AS b2 FROM u GROUP BY 1)
    SELECT u.frame_id, object_id, selected, pass FROM u JOIN m USING (frame_id) WHERE pass = CASE WHEN b1 < 0 AND b2 > b1 THEN 2 ELSE 1 END""",
    "det",
)
def _(spark, sf):
    c = F.col
    d = detections(spark, sf)
    first = d.select("frame_id", "object_id", "confidence", (c("part") % 5 == 0).alias("selected"))
    second = d.select(
        "frame_id", F.concat("object_id", F.lit("r")).alias("object_id"), (c("confidence") * 0.9).alias("confidence"),
        (c("part") % 3 == 0).alias("selected"),
    )
    return Q.better_pass(first, second, ["frame_id"]).select("frame_id", "object_id", "selected", "pass")


TRACK_SQL = """tr AS (SELECT session_id, frame_id, ns, kind <> 'error' AS selected, CASE WHEN value < 60 THEN 'a' ELSE 'b' END AS class_key, value / 10 AS x FROM frames)"""


def tracks(spark, sf):
    c = F.col
    return frames(spark, sf).select(
        "session_id", "frame_id", "ns", "ts", "hour", (c("kind") != "error").alias("selected"),
        F.when(c("value") < 60, "a").otherwise("b").alias("class_key"), (c("value") / 10).alias("x"), F.lit(0.0).alias("y"),
    )


@query(
    "win13_temporal_stability",
    f"""WITH {TRACK_SQL}, l AS (SELECT *, row_number() OVER w AS pos, selected AND coalesce(lag(selected) OVER w AND lag(class_key) OVER w = class_key AND abs(lag(x) OVER w - x) <= 3, false) AS same FROM tr
       WINDOW w AS (PARTITION BY session_id ORDER BY ns, frame_id)),
     s AS (SELECT *, pos - max(CASE WHEN NOT same THEN pos END) OVER (PARTITION BY session_id ORDER BY pos) + 1 AS n FROM l)
    SELECT frame_id, CASE WHEN selected THEN n ELSE 0 END AS stable_count, selected AND n >= 2 AS stable_selected FROM s""",
    "frames",
)
def _(spark, sf):
    return Q.temporal_stability(tracks(spark, sf), ["session_id"], "hour", ["ns", "frame_id"]).select(
        "frame_id", "stable_count", "stable_selected"
    )


@query(
    "win14_quality_streak",
    f"""WITH th AS (SELECT *, {thumb_sql("value")} AS pic FROM frames), la AS (SELECT *, lag(pic) OVER w AS prev, row_number() OVER w AS pos FROM th WINDOW w AS (PARTITION BY session_id ORDER BY ns, frame_id)),
     l AS (SELECT *, list_sum([abs(pic[i + 1] - prev[i + 1]) for i in range({THUMB_CELLS})]) / {THUMB_CELLS}.0 AS motion FROM la),
     s AS (SELECT *, pos - max(CASE WHEN NOT coalesce(motion <= 17.5, false) THEN pos END) OVER (PARTITION BY session_id ORDER BY pos) AS stable_frames FROM l)
    SELECT frame_id, round(motion, 6) AS motion, stable_frames, stable_frames >= 3 AS ready FROM s""",
    "frames",
)
def _(spark, sf):
    pictured = frames(spark, sf).withColumn("picture", thumbnail(F.col("value")))
    return Q.quality_streak(pictured, ["session_id"], "hour", ["ns", "frame_id"], "picture", max_motion=17.5).select(
        "frame_id", F.round("motion", 6).alias("motion"), "stable_frames", "ready"
    )


@query(
    "win15_top2_margin",
    """WITH t AS (SELECT id, sum(p) AS tot FROM scores GROUP BY 1), r AS (SELECT id, cls, p / tot AS p, row_number() OVER (PARTITION BY id ORDER BY p DESC, cls) AS k FROM scores JOIN t USING (id))
    SELECT a.id, a.cls AS label, b.cls AS second, round(a.p, 6) AS probability, round(a.p - b.p, 6) AS margin FROM r a JOIN r b ON a.id = b.id AND a.k = 1 AND b.k = 2""",
    ("vec", "scores"),
)
def _(spark, sf):
    best = score_fn.top2_margin(score_fn.normalize_scores(F.col("top")))
    return scores(spark, sf).select("id", best.alias("b")).select(
        "id", "b.label", "b.second", F.round("b.probability", 6).alias("probability"), F.round("b.margin", 6).alias("margin")
    )


@query(
    "win16_next_scene",
    """WITH c AS (SELECT supp AS session, line AS scene_index, count(*) AS captures FROM det GROUP BY 1, 2), l AS (SELECT session, arg_max(scene_index, scene_index) AS s, arg_max(captures, scene_index) AS n FROM c GROUP BY 1)
    SELECT session, CAST(CASE WHEN n < 80 THEN s ELSE s + 1 END AS BIGINT) AS next_scene, CASE WHEN n < 80 THEN n + 1 ELSE 1 END AS repeat_index, CASE WHEN n < 80 THEN n + 1 ELSE 1 END = 1 AS independent_layout FROM l""",
    "det",
)
def _(spark, sf):
    counts = detections(spark, sf).groupBy(F.col("supp").alias("session"), F.col("line").alias("scene_index")).agg(
        F.count(F.lit(1)).alias("captures")
    )
    return Q.next_scene(counts, ["session"], target=80)


@query(
    "win17_next_incomplete_label",
    """WITH lab(idx, label) AS (VALUES (0, 'de'), (1, 'en'), (2, 'es'), (3, 'fr')), b AS (SELECT DISTINCT batch_id, CAST(replace(batch_id, 'src', '') AS INT) % 4 AS cur FROM docs),
     c AS (SELECT batch_id, label_id, count(*) AS n FROM docs GROUP BY 1, 2),
     j AS (SELECT b.batch_id, lab.label, (idx - cur - 1 + 4) % 4 AS step, coalesce(n, 0) AS n FROM b CROSS JOIN lab LEFT JOIN c ON c.batch_id = b.batch_id AND c.label_id = lab.label)
    SELECT batch_id, arg_min(label, step) FILTER (n < 8) AS next_label FROM j GROUP BY 1""",
    "docs",
)
def _(spark, sf):
    d = captures(spark, sf)
    names = ["de", "en", "es", "fr"]
    current = F.regexp_replace("batch_id", "src", "").cast("int") % 4
    entries = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(n).alias("label")) for i, n in enumerate(names)])
    cycle = d.select("batch_id").distinct().select(
        "batch_id", current.alias("cur"), F.lit(4).alias("n"), F.explode(entries).alias("e")
    ).select("batch_id", "cur", "n", "e.*")
    counts = d.groupBy("batch_id", F.col("label_id").alias("label")).agg(F.count(F.lit(1)).alias("captures"))
    return Q.next_incomplete_label(cycle, counts, ["batch_id"], current="cur", target=8)


@query("win18_pose_diversity")
def _(spark, sf):
    v = F.col("v")
    views = vectors(spark, sf).select(
        F.col("label").alias("session_id"), F.col("id").alias("view_id"),
        F.array(v[0] * 300, v[1] * 300, v[2] * 2, v[3] * 3).alias("signature"),
    )
    return poses.diverse_views(views, ["session_id"], "view_id").select("session_id", "view_id", "kept_rank")


@query(
    "win19_assign_by_rank",
    """WITH o AS (SELECT frame_id, object_id, CASE WHEN accepted THEN 'blue' ELSE 'teal' END AS hue_group, price AS area, part FROM det), s AS (SELECT frame_id, count(*) FILTER (hue_group = 'blue') AS b, count(*) FILTER (hue_group = 'teal') AS t,
       bool_or(part % 97 = 0) AS listed FROM o GROUP BY 1),
     r AS (SELECT o.*, CASE WHEN listed THEN 'instance_labels_need_review' WHEN b <> 1 OR t <> 2 THEN 'wrong_group_sizes' ELSE 'accepted' END AS reason,
       row_number() OVER (PARTITION BY o.frame_id, hue_group ORDER BY area, object_id) AS k FROM o JOIN s USING (frame_id))
    SELECT frame_id, object_id, CASE WHEN reason = 'accepted' THEN CASE WHEN hue_group = 'blue' THEN 'square_pyramid' WHEN k = 1 THEN 'triangular_pyramid' ELSE 'pentagonal_prism' END END AS label, reason FROM r""",
    "det",
)
def _(spark, sf):
    c = F.col
    d = detections(spark, sf)
    objects = d.select("frame_id", "object_id", F.when(c("accepted"), "blue").otherwise("teal").alias("hue_group"), c("price").alias("area"))
    mapping = literal_table(
        spark,
        [("blue", 1, "square_pyramid"), ("teal", 1, "triangular_pyramid"), ("teal", 2, "pentagonal_prism")],
        "hue_group string, rank int, label string",
    )
    listed = d.filter("part % 97 = 0").select("frame_id").distinct()
    return Q.assign_by_rank(objects, "frame_id", mapping, ambiguous=listed)


@query(
    "win20_review_ordinals",
    """SELECT sample, batch_id, label_id, row_number() OVER (PARTITION BY batch_id, label_id ORDER BY sample) AS ordinal FROM docs
    QUALIFY row_number() OVER (PARTITION BY batch_id, label_id ORDER BY sample) IN (1, 15, 30)""",
    "docs",
)
def _(spark, sf):
    return S.review_ordinals(captures(spark, sf), ["batch_id", "label_id"], "sample").select("sample", "batch_id", "label_id", "ordinal")


@query(
    "win21_sample_every",
    "SELECT session_id, frame_id FROM frames QUALIFY (row_number() OVER (PARTITION BY session_id ORDER BY ns, frame_id) - 1) % 6 = 0",
    "frames",
)
def _(spark, sf):
    return Q.sample_every(
        frames(spark, sf), ["session_id"], "hour", ["ns", "frame_id"], fps=30.0, interval_ms=200.0
    ).select("session_id", "frame_id")


@query(
    "win21_first_per_interval",
    "SELECT session_id, frame_id FROM frames QUALIFY row_number() OVER (PARTITION BY session_id, ns // 86400000000000 ORDER BY ns, frame_id) = 1",
    "frames",
)
def _(spark, sf):
    return Q.first_per_interval(frames(spark, sf), ["session_id"], interval_ns=86_400_000_000_000, item="frame_id").select("session_id", "frame_id")


@query(
    "top1_worst_frames",
    f"""WITH {DEPTH_QUALITY_SQL} SELECT frame_id, center_valid_percent, difference_p95 FROM q ORDER BY center_valid_percent, coalesce(difference_p95, 0) DESC, frame_id LIMIT 12""",
    "grid",
)
def _(spark, sf):
    order = [F.asc("center_valid_percent"), F.desc(F.coalesce("difference_p95", F.lit(0.0))), F.asc("frame_id")]
    return Q.worst_first(depth_quality(spark, sf), order, 12).select("frame_id", "center_valid_percent", "difference_p95")


@query(
    "top2_rank_candidates",
    """WITH k AS (SELECT supp AS candidate, batch_id, truth, count(*) AS n, count(*) FILTER (accepted) AS a, count(*) FILTER (accepted AND truth = prediction) AS ac FROM det GROUP BY 1, 2, 3),
     m AS (SELECT batch_id, candidate, CAST(sum(a) - sum(ac) AS BIGINT) AS wrong, round(avg(ac / n), 6) AS recall, round(sum(a) / sum(n), 6) AS coverage FROM k GROUP BY 1, 2)
    SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY wrong <> 0, wrong, recall DESC, coverage DESC, candidate) = 1""",
    "det",
)
def _(spark, sf):
    from framelake.operators.evaluation import decision_metrics

    d = detections(spark, sf).withColumn("candidate", F.col("supp"))
    m = decision_metrics(d, ["batch_id", "candidate"]).select(
        "batch_id", "candidate", F.col("wrong_accepts").alias("wrong"), F.round("macro_recall", 6).alias("recall"), F.round("coverage", 6).alias("coverage")
    )
    c = F.col
    return Q.best_candidate(m, [c("wrong") != 0, c("wrong"), -c("recall"), -c("coverage"), c("candidate")], ["batch_id"])


@query(
    "top3_reading_order",
    "SELECT frame_id, object_id, row_number() OVER (PARTITION BY frame_id ORDER BY y, x, object_id) AS position FROM det",
    "det",
)
def _(spark, sf):
    return Q.reading_order(detections(spark, sf), ["frame_id"], "object_id").select("frame_id", "object_id", "position")


@query("top4_suppressed_top_k")
def _(spark, sf):
    candidates = detections(spark, sf).select(
        F.col("batch_id").alias("object_id"), F.concat_ws("/", F.col("frame_id").cast("string"), "object_id").alias("candidate_id"),
        F.col("x").alias("u"), F.col("y").alias("v"), F.col("price").alias("distance"),
    )
    return seg_ops.suppressed_top_k(candidates, ["object_id"], "candidate_id", k=3, radius=60.0)


@query(
    "top5_review_focus",
    """WITH f AS (SELECT frame_id, CAST(sum(line) AS BIGINT) AS edges, count(*) AS nodes FROM det GROUP BY 1), t AS (FROM f ORDER BY edges DESC, nodes DESC, frame_id LIMIT 8), l AS (FROM f ORDER BY edges, nodes, frame_id DESC LIMIT 2)
    SELECT * FROM t UNION SELECT * FROM l""",
    "det",
)
def _(spark, sf):
    f = detections(spark, sf).groupBy("frame_id").agg(F.sum("line").alias("edges"), F.count(F.lit(1)).alias("nodes"))
    return Q.review_focus(f, "frame_id", ["edges", "nodes"])


@query(
    "set1_union_roots",
    """SELECT 0 AS root_order, doc_id AS sample, sha256(text) AS sha256 FROM documents UNION ALL SELECT 1, item_id, sha256(text) FROM benchmark
    UNION ALL SELECT 2, conv_id * 1000 + turn, sha256(text) FROM conversations""",
)
def _(spark, sf):
    def root(name, key):
        return table(spark, sf, name).select(key.alias("sample"), labels.content_hash(F.col("text")).alias("sha256"))

    return sets.union_roots(
        root("documents", F.col("doc_id")), root("benchmark", F.col("item_id")),
        root("conversations", F.col("conv_id") * 1000 + F.col("turn")),
    )


@query(
    "set2_key_difference",
    f"""WITH {RUN_SQL}, a AS (SELECT key FROM ra), b AS (SELECT key FROM rb)
    SELECT key, 'first' AS side FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT key, 'second' FROM (FROM b EXCEPT ALL FROM a)""",
    "det",
)
def _(spark, sf):
    return sets.key_difference(*runs(spark, sf), "key")


@query(
    "set3_key_intersection",
    f"WITH {HALF_SQL} SELECT sha256 FROM hf WHERE split = 'train' INTERSECT SELECT sha256 FROM hf WHERE split = 'final_holdout'",
    "docs",
)
def _(spark, sf):
    h = halves(spark, sf)
    return sets.key_intersection(h.filter("split = 'train'"), h.filter("split = 'final_holdout'"), "sha256")


@query(
    "set4_observed_registry",
    """WITH reg(class_id, enabled) AS (VALUES ('de', true), ('en', true), ('es', true), ('fr', true), ('it', true), ('xx', false))
    SELECT class_id, enabled, class_id IN (SELECT label_id FROM docs) AS observed FROM reg""",
    "docs",
)
def _(spark, sf):
    registry = labels.registry_frame(spark, LANGS)
    return sets.observed_registry(registry, captures(spark, sf)).select("class_id", "enabled", "observed")


@query(
    "set5_candidate_union",
    """WITH l AS (SELECT object_id, seg_id + 1000000 AS seg_id, CASE WHEN flag THEN x2 ELSE x1 END + c * 8 AS x1, CASE WHEN flag THEN y2 ELSE y1 END AS y1, CASE WHEN flag THEN x1 ELSE x2 END AS x2, CASE WHEN flag THEN y1 ELSE y2 END + a * 8 AS y2 FROM seg),
     v AS (SELECT object_id, seg_id, x1, y1, x2, y2 FROM seg WHERE flag)
    SELECT object_id, seg_id, true AS image_verified FROM v UNION ALL
    SELECT object_id, seg_id, false FROM l WHERE sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)) >= 4 AND NOT EXISTS (SELECT 1 FROM v WHERE v.object_id = l.object_id AND
      least(sqrt(pow(l.x1-v.x1,2)+pow(l.y1-v.y1,2)+pow(l.x2-v.x2,2)+pow(l.y2-v.y2,2)), sqrt(pow(l.x1-v.x2,2)+pow(l.y1-v.y2,2)+pow(l.x2-v.x1,2)+pow(l.y2-v.y1,2))) <= 3)""",
    ("vec", "seg"),
)
def _(spark, sf):
    c = F.col
    s = segments(spark, sf)
    turned = lambda a, b: F.when(c("flag"), c(b)).otherwise(c(a))
    legacy = s.select(
        "object_id", (c("seg_id") + 1000000).alias("seg_id"), (turned("x1", "x2") + c("c") * 8).alias("x1"),
        turned("y1", "y2").alias("y1"), turned("x2", "x1").alias("x2"), (turned("y2", "y1") + c("a") * 8).alias("y2"),
    )
    verified = s.filter("flag").select("object_id", "seg_id", "x1", "y1", "x2", "y2")
    return sets.candidate_union(verified, legacy, ["object_id"]).select("object_id", "seg_id", "image_verified")


@query(
    "set6_pending_labels",
    "SELECT frame_id, object_id, CAST(NULL AS VARCHAR) AS label_id, false AS reviewed FROM det WHERE NOT (part % 17 <> 0 AND part % 20 <> 0)",
    "det",
)
def _(spark, sf):
    d = detections(spark, sf)
    notes = d.filter("part % 17 <> 0").select("frame_id", "object_id", (F.col("part") % 20 != 0).alias("reviewed"))
    return sets.pending_labels(d.select("frame_id", "object_id"), notes, ["frame_id", "object_id"])
