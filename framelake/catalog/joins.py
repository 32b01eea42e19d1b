"""JOIN1-JOIN22."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.catalog.aggregates import LANGS
from framelake.catalog.base import query
from framelake.catalog.projections import SAFETY_SQL, STATUS_SQL, safety, status_of
from framelake.catalog.views import captures, detections, frames, grid, segments, table, vectors
from framelake.functions import geometry as G
from framelake.functions import labels
from framelake.operators import joins as J
from framelake.operators import pairing
from framelake.plans import boxes

PAIR_SQL = """p AS (SELECT session_id, frame_id AS primary_id, ns FROM frames WHERE kind = 'click'),
  s AS (SELECT session_id, frame_id AS side_id, ns AS sns FROM frames WHERE kind = 'view'),
  near AS (SELECT p.session_id, primary_id, ns, side_id, sns FROM p LEFT JOIN s USING (session_id)
    QUALIFY row_number() OVER (PARTITION BY p.session_id, primary_id ORDER BY abs(ns - sns), sns, side_id) = 1),
  pairs AS (SELECT session_id, primary_id, ns, side_id, sns, abs(sns - ns) / 1e6::DOUBLE AS d FROM near)"""


def pairs(spark, sf, tolerance_ms=60_000_000.0):
    f = frames(spark, sf)
    return pairing.pair_frames(
        f.filter("kind = 'click'"), f.filter("kind = 'view'"), ["session_id"], tolerance_ms=tolerance_ms
    )


@query(
    "join1_pair_frames",
    f"""WITH {PAIR_SQL} SELECT session_id, primary_id, side_id, round(d, 6) AS pair_delta_ms, coalesce(d <= 60000000, false) AS synchronized FROM pairs""",
    "frames",
)
def _(spark, sf):
    return pairs(spark, sf).select(
        "session_id", "primary_id", "side_id", F.round("pair_delta_ms", 6).alias("pair_delta_ms"), "synchronized"
    )


@query(
    "join2_pair_one_to_one",
    """WITH RECURSIVE p AS (SELECT session_id, frame_id, ns, row_number() OVER (PARTITION BY session_id ORDER BY ns, frame_id) AS k FROM frames WHERE kind = 'click'),
     s AS (SELECT session_id, frame_id, ns, row_number() OVER (PARTITION BY session_id ORDER BY ns, frame_id) AS i FROM frames WHERE kind = 'view'),
     walk AS (SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS pick FROM p
      UNION ALL SELECT w.session_id, w.k + 1, coalesce(first(s.i ORDER BY abs(s.ns - p.ns), s.i), w.used), first(s.i ORDER BY abs(s.ns - p.ns), s.i)
       FROM walk w JOIN p ON p.session_id = w.session_id AND p.k = w.k + 1 LEFT JOIN s ON s.session_id = w.session_id AND s.i > w.used GROUP BY w.session_id, w.k, w.used)
    SELECT p.session_id, p.frame_id AS primary_id, s.frame_id AS side_id, coalesce(abs(s.ns - p.ns) / 1e6 <= 60000000, false) AS synchronized
    FROM p JOIN walk w ON w.session_id = p.session_id AND w.k = p.k LEFT JOIN s ON s.session_id = p.session_id AND s.i = w.pick""",
    "frames",
)
def _(spark, sf):
    f = frames(spark, sf)
    found = pairing.pair_one_to_one(f.filter("kind = 'click'"), f.filter("kind = 'view'"), ["session_id"], tolerance_ms=60_000_000)
    return found.select("session_id", "primary_id", "side_id", "synchronized")


FILES_SQL = """fp AS (SELECT source AS folder, 'top/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.png' AS path,
    CASE WHEN source IN ('src1', 'src2') THEN 'a' || lpad(CAST(doc_id AS VARCHAR), 12, '0') ELSE lpad(CAST(doc_id AS VARCHAR), 12, '0') END AS stem FROM documents),
  fs AS (SELECT source AS folder, 'side/' || CASE WHEN source IN ('src1', 'src2') THEN 'b' ELSE '' END || lpad(CAST(doc_id + CASE WHEN source IN ('src1', 'src2') THEN 1000000 ELSE 0 END AS VARCHAR), 12, '0') || '.jpg' AS path,
    CASE WHEN source IN ('src1', 'src2') THEN 'b' || lpad(CAST(doc_id + 1000000 AS VARCHAR), 12, '0') ELSE lpad(CAST(doc_id AS VARCHAR), 12, '0') END AS stem
    FROM documents WHERE NOT (source = 'src4' AND n_chars % 2 = 0) AND NOT (source = 'src2' AND n_chars % 5 = 0))"""


@query(
    "join3_pair_by_stem",
    f"""WITH {FILES_SQL}, fp2 AS (SELECT folder, stem, CASE WHEN folder IN ('src1', 'src2') THEN 'top/x/' || stem || '.png' ELSE path END AS path FROM fp),
     byname AS (SELECT fp2.folder, fp2.stem, fp2.path AS primary_path, fs.path AS side_path FROM fp2 JOIN fs USING (folder, stem)),
     eq AS (SELECT folder FROM (SELECT folder, count(*) AS n FROM fp2 GROUP BY 1) JOIN (SELECT folder, count(*) AS m FROM fs GROUP BY 1) USING (folder)
       WHERE n = m AND folder NOT IN (SELECT folder FROM byname)),
     a AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY stem, path) AS k FROM fp2 WHERE folder IN (FROM eq)),
     b AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY stem, path) AS k FROM fs WHERE folder IN (FROM eq))
    SELECT * FROM byname UNION ALL SELECT a.folder, a.stem, a.path, b.path FROM a JOIN b ON a.folder = b.folder AND a.k = b.k""",
)
def _(spark, sf):
    d = table(spark, sf, "documents")
    odd = F.col("source").isin("src1", "src2")
    number = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    late = F.lpad((F.col("doc_id") + F.when(odd, 1000000).otherwise(0)).cast("string"), 12, "0")
    top = d.select(
        F.col("source").alias("folder"),
        F.when(odd, F.concat(F.lit("top/x/a"), number, F.lit(".png")))
        .otherwise(F.concat(F.lit("top/"), F.col("lang"), F.lit("/"), number, F.lit(".png"))).alias("path"),
    )
    dropped = ((F.col("source") == "src4") & (F.col("n_chars") % 2 == 0)) | (
        (F.col("source") == "src2") & (F.col("n_chars") % 5 == 0)
    )
    side = d.filter(~dropped).select(
        F.col("source").alias("folder"),
        F.concat(F.lit("side/"), F.when(odd, "b").otherwise(""), late, F.lit(".jpg")).alias("path"),
    )
    return pairing.pair_by_stem(top, side, ["folder"])


SIZED_SQL = """sz AS (SELECT sample, batch_id, label_id, 640 + 40 * (n_chars % 2) AS width, 480 AS height, n_chars FROM docs)"""


def sized(spark, sf):
    n = F.col("n_chars")
    return captures(spark, sf).select(
        "sample", "batch_id", "label_id", (640 + 40 * (n % 2)).alias("width"), F.lit(480).alias("height"), "n_chars"
    )


@query(
    "join4_attach_reference",
    f"""WITH {SIZED_SQL}, r AS (SELECT batch_id, arg_max(sample, sample) AS ref, arg_max(width, sample) AS rw FROM sz WHERE label_id = 'es' AND batch_id <> 'src5' GROUP BY 1)
    SELECT sample, r.ref AS reference_sample, CASE WHEN r.ref IS NULL THEN 'missing_batch_empty_tray' WHEN rw <> width THEN 'reference_intrinsics_mismatch' ELSE 'accepted' END AS reason
    FROM sz LEFT JOIN r USING (batch_id) WHERE label_id <> 'es'""",
    "docs",
)
def _(spark, sf):
    s = sized(spark, sf)
    references = s.filter("label_id = 'es' and batch_id <> 'src5'")
    return J.attach_reference(s.filter("label_id <> 'es'"), references).select("sample", "reference_sample", "reason")


HALF_SQL = """hf AS (SELECT sample, batch_id, label_id, sha256(content) AS sha256, CASE WHEN sample % 2 = 0 THEN 'train' WHEN sample % 4 = 1 THEN 'probability_calibration' ELSE 'final_holdout' END AS split,
  label_id || '-' || n_chars % 400 AS instance_id FROM docs)"""


def halves(spark, sf):
    k = F.col("sample")
    return captures(spark, sf).select(
        "sample", "batch_id", "label_id", labels.content_hash(F.col("content")).alias("sha256"),
        F.when(k % 2 == 0, "train").when(k % 4 == 1, "probability_calibration").otherwise("final_holdout").alias("split"),
        F.concat_ws("-", "label_id", (F.col("n_chars") % 400).cast("string")).alias("instance_id"),
    )


@query(
    "join5_exclude_seen",
    f"WITH {HALF_SQL} SELECT sample, sha256 FROM hf WHERE split <> 'train' AND sha256 NOT IN (SELECT sha256 FROM hf WHERE split = 'train')",
    "docs",
)
def _(spark, sf):
    h = halves(spark, sf)
    return J.exclude_seen(h.filter("split = 'train'"), h.filter("split <> 'train'")).select("sample", "sha256")


@query(
    "join5_seen_rows",
    f"WITH {HALF_SQL} SELECT sample, sha256 FROM hf WHERE split <> 'train' AND sha256 IN (SELECT sha256 FROM hf WHERE split = 'train')",
    "docs",
)
def _(spark, sf):
    h = halves(spark, sf)
    return J.seen_rows(h.filter("split = 'train'"), h.filter("split <> 'train'")).select("sample", "sha256")


@query(
    "join6_leaked_hashes",
    f"WITH {HALF_SQL} SELECT sha256, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM hf GROUP BY 1 HAVING count(DISTINCT split) > 1",
    "docs",
)
def _(spark, sf):
    return J.leaked_hashes(halves(spark, sf)).select("sha256", F.array_join("splits", ",").alias("splits"))


@query(
    "join6_leaked_instances",
    f"""WITH {HALF_SQL} SELECT instance_id FROM hf GROUP BY 1 HAVING bool_or(split = 'final_holdout') AND bool_or(split <> 'final_holdout')""",
    "docs",
)
def _(spark, sf):
    return J.leaked_instances(halves(spark, sf))


@query(
    "join6_reserved_overlap",
    f"WITH {HALF_SQL} SELECT instance_id FROM hf WHERE label_id = 'fr' INTERSECT SELECT instance_id FROM hf WHERE split = 'train'",
    "docs",
)
def _(spark, sf):
    h = halves(spark, sf)
    return J.reserved_overlap(h.filter("label_id = 'fr'"), h.filter("split = 'train'"), "instance_id")


@query(
    "join7_complete_frozen",
    """SELECT doc_id AS sample, lang AS truth, CASE WHEN quality IS NULL THEN 'unknown' WHEN quality = 1 THEN lang ELSE 'xx' END AS prediction, coalesce(toxic = 0, false) AS accepted
     FROM documents LEFT JOIN labels USING (doc_id)""",
)
def _(spark, sf):
    marks = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("sample"), F.col("lang").alias("truth"))
    records = marks.join(docs, marks["doc_id"] == docs["sample"]).select(
        "sample", F.when(F.col("quality") == 1, F.col("truth")).otherwise("xx").alias("prediction"),
        (F.col("toxic") == 0).alias("accepted"),
    )
    return J.complete_frozen(docs, records, "sample")


@query(
    "join7_outside_frozen",
    "SELECT doc_id AS sample FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("sample"))
    return J.outside_frozen(table(spark, sf, "labels").select(F.col("doc_id").alias("sample")), docs, "sample")


RUN_SQL = """ra AS (SELECT frame_id || '/' || line AS key, prediction FROM det WHERE part % 10 <> 0),
  rb AS (SELECT frame_id || '/' || line AS key, truth AS prediction FROM det WHERE part % 11 <> 0)"""


def runs(spark, sf):
    d = detections(spark, sf)
    key = F.concat_ws("/", F.col("frame_id").cast("string"), F.col("line").cast("string")).alias("key")
    return (
        d.filter("part % 10 <> 0").select(key, "prediction"),
        d.filter("part % 11 <> 0").select(key, F.col("truth").alias("prediction")),
    )


PAIRED_RUN_SQL = f"""{RUN_SQL}, a AS (SELECT key, count(*) AS n, min(prediction) AS before FROM ra GROUP BY 1), b AS (SELECT key, count(*) AS m, min(prediction) AS after FROM rb GROUP BY 1),
  pr AS (SELECT key, before, after, CASE WHEN n IS NULL THEN 'missing_before' WHEN m IS NULL THEN 'missing_after' WHEN n > 1 OR m > 1 THEN 'duplicate_key' ELSE 'ok' END AS problem
   FROM a FULL JOIN b USING (key))"""


@query("join8_paired_runs", f"WITH {PAIRED_RUN_SQL} SELECT * FROM pr", "det")
def _(spark, sf):
    return J.paired_runs(*runs(spark, sf), "key").select(
        "key", F.col("before.prediction").alias("before"), F.col("after.prediction").alias("after"), "problem"
    )


@query(
    "join8_run_keys_agree",
    f"WITH {PAIRED_RUN_SQL} SELECT count(*) AS keys, count(*) FILTER (problem <> 'ok') AS problems, count(*) FILTER (problem <> 'ok') = 0 AS comparable FROM pr",
    "det",
)
def _(spark, sf):
    return J.run_keys_agree(J.paired_runs(*runs(spark, sf), "key"))


@query(
    "join9_compare_models",
    """WITH a AS (SELECT object_id || '@' || frame_id AS key, prediction FROM det WHERE part % 10 <> 0), b AS (SELECT object_id || '@' || frame_id AS key, truth AS prediction FROM det WHERE part % 11 <> 0)
    SELECT key, coalesce(a.prediction, 'missing') AS first, coalesce(b.prediction, 'missing') AS second, coalesce(a.prediction, 'missing') = coalesce(b.prediction, 'missing') AS agree
    FROM a FULL JOIN b USING (key)""",
    "det",
)
def _(spark, sf):
    d = detections(spark, sf)
    key = F.concat_ws("@", "object_id", F.col("frame_id").cast("string")).alias("key")
    return J.compare_models(
        d.filter("part % 10 <> 0").select(key, "prediction"),
        d.filter("part % 11 <> 0").select(key, F.col("truth").alias("prediction")), "key",
    )


@query(
    "join10_confirmed_assignments",
    """WITH n AS (SELECT frame_id, object_id, part % 20 <> 0 AS reviewed, CASE WHEN part % 31 = 0 THEN 'unknown' WHEN part % 37 = 0 THEN 'Z' ELSE truth END AS label_id,
       CASE WHEN supp % 23 = 0 THEN x + 1 ELSE x END AS bx FROM det WHERE part % 17 <> 0),
     nn AS (SELECT * FROM n UNION ALL SELECT n.* FROM n JOIN det USING (frame_id, object_id) WHERE supp % 41 = 0),
     g AS (SELECT frame_id, object_id, count(*) AS c, bool_and(reviewed) AS reviewed, min(label_id) AS label_id, min(bx) AS bx FROM nn GROUP BY 1, 2),
     m AS (SELECT d.frame_id, d.object_id, g.label_id, CASE WHEN c > 1 THEN 'duplicate_annotation' WHEN c IS NULL OR NOT reviewed THEN 'not_confirmed'
       WHEN g.label_id NOT IN ('A', 'N', 'R', 'unknown') OR g.label_id = 'unknown' THEN 'invalid_label' WHEN bx <> x THEN 'bbox_changed' ELSE 'accepted' END AS reason
       FROM det d LEFT JOIN g USING (frame_id, object_id))
    SELECT frame_id, object_id, CASE WHEN reason = 'accepted' THEN label_id END AS label_id, reason, bool_and(reason = 'accepted') OVER (PARTITION BY frame_id) AS frame_passes FROM m""",
    "det",
)
def _(spark, sf):
    c = F.col
    box = lambda x: F.array(x.cast("int"), c("y").cast("int"), c("w").cast("int"), c("h").cast("int"))
    d = detections(spark, sf)
    notes = d.filter("part % 17 <> 0").select(
        "frame_id", "object_id", (c("part") % 20 != 0).alias("reviewed"),
        F.when(c("part") % 31 == 0, "unknown").when(c("part") % 37 == 0, "Z").otherwise(c("truth")).alias("label_id"),
        box(F.when(c("supp") % 23 == 0, c("x") + 1).otherwise(c("x"))).alias("bbox_px"),
        F.explode(F.when(c("supp") % 41 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return J.confirmed_assignments(
        d.select("frame_id", "object_id", box(c("x")).alias("bbox_px")), notes, ["A", "N", "R", "unknown"]
    )


ROLE_CLASSES = [
    ("user", "User", "person", ["End User"], True),
    ("assistant", "Assistant", "machine", ["AI"], True),
    ("system", "System", "machine", [], True),
    *LANGS,
]
REVIEW_SQL = """smp AS (SELECT 'd' || doc_id AS sample, false AS is_multi, lang AS label_id, 1 AS object_count FROM documents WHERE doc_id % 19 <> 0
   UNION ALL SELECT 'c' || conv_id, true, NULL, count(*) + CASE WHEN conv_id % 7 = 0 THEN 1 ELSE 0 END FROM conversations GROUP BY conv_id),
 obj AS (SELECT DISTINCT 'c' || conv_id AS sample, lpad(CAST(turn AS VARCHAR), 5, '0') AS object_id, CASE WHEN role = 'user' THEN 'End User' WHEN length(text) % 97 = 0 THEN 'ghost' ELSE upper(role) END AS true_label,
   CASE WHEN length(text) % 53 = 0 THEN NULL ELSE length(text) % 11 <> 0 END AS association_ok, false AS side_occluded,
   (length(text) % 103) / 100.0::DOUBLE AS side_visible_ratio, conv_id, turn, text FROM conversations WHERE conv_id % 23 <> 0),
 cmp AS (SELECT 'c' || conv_id AS sample, CASE WHEN conv_id % 5 = 0 AND turn = 0 THEN 'system' ELSE role END AS class FROM conversations),
 rv AS (SELECT 'd' || doc_id AS sample, CASE WHEN doc_id % 29 = 0 THEN NULL ELSE quality = 1 END AS roi_ok, CASE WHEN doc_id % 31 = 0 THEN NULL ELSE true END AS depth_ok, toxic = 0 AS approved,
    CASE WHEN doc_id % 3 = 0 THEN 'zz' WHEN doc_id % 3 = 1 THEN 'Anglais' END AS true_label FROM labels
  UNION ALL SELECT DISTINCT 'c' || conv_id, true, true, conv_id % 3 <> 0, NULL FROM conversations)"""


@query(
    "join11_apply_reviews",
    f"""WITH {REVIEW_SQL}, al(k, cls) AS (VALUES ('user','user'),('enduser','user'),('assistant','assistant'),('ai','assistant'),('system','system'),('de','de'),('german','de'),
       ('en','en'),('english','en'),('anglais','en'),('es','es'),('spanish','es'),('fr','fr'),('french','fr'),('it','it'),('italian','it')),
     o2 AS (SELECT obj.*, al.cls, CASE WHEN association_ok IS NULL THEN 'multi_association_check_missing:' || object_id
        WHEN side_visible_ratio NOT BETWEEN 0 AND 1 THEN 'multi_visible_ratio_out_of_range:' || object_id WHEN al.cls IS NULL THEN 'unknown_label:' || true_label END AS fault
        FROM obj LEFT JOIN al ON al.k = regexp_replace(lower(true_label), '\\s+', '', 'g')),
     ps AS (SELECT sample, count(*) AS n, count(DISTINCT object_id) AS ids, arg_min(fault, object_id) FILTER (fault IS NOT NULL) AS fault, bool_and(association_ok) AS assoc FROM o2 GROUP BY 1),
     lab AS (SELECT sample, bool_and(n IS NOT DISTINCT FROM m) AS same FROM (SELECT sample, class, count(*) AS n FROM cmp GROUP BY 1, 2) e
        FULL JOIN (SELECT sample, cls AS class, count(*) AS m FROM o2 GROUP BY 1, 2) f USING (sample, class) GROUP BY 1),
     j AS (SELECT rv.sample, CASE WHEN smp.sample IS NULL THEN 'metadata_missing'
        WHEN roi_ok IS NULL OR depth_ok IS NULL THEN 'missing_boolean_checks:' || concat_ws(',', CASE WHEN roi_ok IS NULL THEN 'roi_ok' END, CASE WHEN depth_ok IS NULL THEN 'depth_ok' END)
        WHEN is_multi AND ps.n IS NULL THEN 'multi_objects_missing' WHEN is_multi AND ps.fault IS NOT NULL THEN ps.fault WHEN is_multi AND ids <> n THEN 'multi_object_ids_not_unique'
        WHEN is_multi AND n <> object_count THEN 'multi_object_review_count_mismatch' WHEN is_multi AND NOT coalesce(same, false) THEN 'multi_object_labels_do_not_match_composition'
        WHEN NOT is_multi AND s.cls IS NULL THEN 'unknown_label' ELSE 'updated' END AS reason, s.cls, is_multi,
        coalesce(roi_ok AND depth_ok AND approved AND (NOT is_multi OR assoc), false) AS ok
        FROM rv LEFT JOIN smp USING (sample) LEFT JOIN ps USING (sample) LEFT JOIN lab USING (sample) LEFT JOIN al s ON s.k = lower(coalesce(rv.true_label, smp.label_id)))
    SELECT sample, reason, CASE WHEN reason = 'updated' AND NOT is_multi THEN cls END AS label_id, reason = 'updated' AND ok AS human_reviewed FROM j""",
)
def _(spark, sf):
    c = F.col
    docs, conv, marks = (table(spark, sf, n) for n in ("documents", "conversations", "labels"))
    d_id, c_id = F.concat(F.lit("d"), c("doc_id").cast("string")), F.concat(F.lit("c"), c("conv_id").cast("string"))
    singles = docs.filter("doc_id % 19 <> 0").select(
        d_id.alias("sample"), F.lit(False).alias("is_multi"), c("lang").alias("label_id"), F.lit(1).cast("bigint").alias("object_count")
    )
    multi = conv.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(
        c_id.alias("sample"), F.lit(True).alias("is_multi"), F.lit(None).cast("string").alias("label_id"),
        (c("n") + F.when(c("conv_id") % 7 == 0, 1).otherwise(0)).alias("object_count"),
    )
    size = F.length("text")
    objects = conv.filter("conv_id % 23 <> 0").select(
        c_id.alias("sample"), F.lpad(c("turn").cast("string"), 5, "0").alias("object_id"),
        F.when(c("role") == "user", "End User").when(size % 97 == 0, "ghost").otherwise(F.upper("role")).alias("true_label"),
        F.when(size % 53 != 0, size % 11 != 0).alias("association_ok"), F.lit(False).alias("side_occluded"),
        ((size % 103) / F.lit(100.0)).alias("side_visible_ratio"), "text",
    ).distinct().drop("text")
    compositions = conv.select(
        c_id.alias("sample"),
        F.when((c("conv_id") % 5 == 0) & (c("turn") == 0), "system").otherwise(c("role")).alias("label"),
        F.lit(1).alias("count"),
    )
    yes = F.lit(True)
    reviews = marks.select(
        d_id.alias("sample"), F.when(c("doc_id") % 29 != 0, c("quality") == 1).alias("roi_ok"), yes.alias("association_ok"),
        yes.alias("shadow_ok"), F.when(c("doc_id") % 31 != 0, yes).alias("depth_ok"), yes.alias("instance_split_ok"),
        (c("toxic") == 0).alias("approved"),
        F.when(c("doc_id") % 3 == 0, "zz").when(c("doc_id") % 3 == 1, "Anglais").alias("true_label"),
    ).unionByName(
        conv.select("conv_id").distinct().select(
            c_id.alias("sample"), *[yes.alias(n) for n in J.REVIEW_CHECKS],
            (c("conv_id") % 3 != 0).alias("approved"), F.lit(None).cast("string").alias("true_label"),
        )
    )
    aliases = labels.registry_aliases(labels.registry_frame(spark, ROLE_CLASSES))
    return J.apply_reviews(reviews, singles.unionByName(multi), objects, compositions, aliases)


@query(
    "join12_clearance",
    """SELECT a.frame_id, a.object_id, round(min(CASE WHEN b.object_id IS NOT NULL THEN sqrt(
        pow(greatest(b.x - (a.x + a.w), a.x - (b.x + b.w), 0), 2) + pow(greatest(b.y - (a.y + a.h), a.y - (b.y + b.h), 0), 2)) END), 6) AS clearance
     FROM det a LEFT JOIN det b ON a.frame_id = b.frame_id AND a.object_id <> b.object_id GROUP BY 1, 2""",
    "det",
)
def _(spark, sf):
    d = detections(spark, sf).select("frame_id", "object_id", *boxes.BOX)
    return boxes.nearest_gap(d, ["frame_id"]).select("frame_id", "object_id", F.round("clearance", 6).alias("clearance"))


@query(
    "join13_roi_overlap",
    """WITH b AS (SELECT batch_id * 100 + supp % 100 AS view_id, frame_id, object_id, x, y, w + 30 AS w, h * 8 AS h FROM det),
     o AS (SELECT a.frame_id, a.object_id, max(greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0)
        / least(a.w * a.h, b.w * b.h)) AS o FROM b a JOIN b ON a.view_id = b.view_id AND (a.frame_id, a.object_id) <> (b.frame_id, b.object_id) GROUP BY 1, 2)
    SELECT b.frame_id, b.object_id, round(coalesce(o, 0), 5) AS overlap, coalesce(o, 0) > 0.3 AS occluded FROM b LEFT JOIN o USING (frame_id, object_id)""",
    "det",
)
def _(spark, sf):
    c = F.col
    d = detections(spark, sf).select(
        (c("batch_id") * 100 + c("supp") % 100).alias("view_id"), "frame_id", "object_id", "x", "y",
        (c("w") + 30).alias("w"), (c("h") * 8).alias("h"),
    )
    return boxes.max_overlap(d, ["view_id"]).select(
        "frame_id", "object_id", F.round("overlap", 5).alias("overlap"), (c("overlap") > 0.3).alias("occluded")
    )


def cut_sql(polygon: str, k: int) -> str:
    """A polygon cut at edge k of the convex polygon q, whose corners turn from x to y."""
    a, b = f"q[{k + 1}]", f"q[{(k + 1) % 4 + 1}]"
    side = lambda p: f"(({b}.x - {a}.x) * ({p}.y - {a}.y) - ({b}.y - {a}.y) * ({p}.x - {a}.x))"
    here, there = f"{polygon}[i]", f"{polygon}[i % len({polygon}) + 1]"
    f, t = side(here), side(there)
    crossing = f"{{'x': {here}.x + ({there}.x - {here}.x) * {f} / ({f} - {t}), 'y': {here}.y + ({there}.y - {here}.y) * {f} / ({f} - {t})}}"
    return f"flatten([list_filter([CASE WHEN {f} >= 0 THEN {here} END, CASE WHEN {f} * {t} < 0 THEN {crossing} END], lambda e: e IS NOT NULL) for i in range(1, len({polygon}) + 1)])"


TURNED_SQL = """b AS (SELECT batch_id * 100 + supp % 100 AS view_id, frame_id, object_id, x + (w + 30) / 2 AS u, y + h * 4 AS v, w + 30 AS w, h * 8 AS h, (part % 12) * 0.2617993877991494 AS t FROM det),
  pg AS (SELECT *, [{'x': u + a[1] * w * cos(t) - a[2] * h * sin(t), 'y': v + a[1] * w * sin(t) + a[2] * h * cos(t)} for a in [[-0.5, -0.5], [0.5, -0.5], [0.5, 0.5], [-0.5, 0.5]]] AS p FROM b)"""


@query(
    "join13_roi_overlap_polygons",
    f"""WITH {TURNED_SQL}, m AS MATERIALIZED (SELECT a.frame_id, a.object_id, a.w * a.h AS s, a.p AS c0, o.p AS q, o.w * o.h AS s2 FROM pg a JOIN pg o ON a.view_id = o.view_id AND (a.frame_id, a.object_id) <> (o.frame_id, o.object_id)
       AND sqrt((a.u - o.u) ** 2 + (a.v - o.v) ** 2) <= (sqrt(a.w ** 2 + a.h ** 2) + sqrt(o.w ** 2 + o.h ** 2)) / 2),
     m1 AS MATERIALIZED (SELECT *, {cut_sql("c0", 0)} AS c1 FROM m), m2 AS MATERIALIZED (SELECT *, {cut_sql("c1", 1)} AS c2 FROM m1), m3 AS MATERIALIZED (SELECT *, {cut_sql("c2", 2)} AS c3 FROM m2), m4 AS MATERIALIZED (SELECT *, {cut_sql("c3", 3)} AS c FROM m3),
     o AS (SELECT frame_id, object_id, max(abs(coalesce(list_sum([c[i].x * c[i % len(c) + 1].y - c[i].y * c[i % len(c) + 1].x for i in range(1, len(c) + 1)]), 0)) / 2 / least(s, s2)) AS o FROM m4 GROUP BY 1, 2)
    SELECT pg.frame_id, pg.object_id, round(coalesce(o, 0) + 1e-9, 5) AS overlap, round(coalesce(o, 0) + 1e-9, 5) > 0.3 AS occluded FROM pg LEFT JOIN o USING (frame_id, object_id)""",
    "det",
)
def _(spark, sf):
    c = F.col
    d = detections(spark, sf).select(
        (c("batch_id") * 100 + c("supp") % 100).alias("view_id"), "frame_id", "object_id",
        G.turned_box(c("x"), c("y"), c("w") + 30, c("h") * 8, (c("part") % 12) * 0.2617993877991494).alias("polygon"),
    )
    found = boxes.max_polygon_overlap(d, ["view_id"]).withColumn("overlap", F.round(c("overlap") + 1e-9, 5))
    return found.select("frame_id", "object_id", "overlap", (c("overlap") > 0.3).alias("occluded"))


OWNER_SQL = """cp AS (SELECT frame_id, u, v, CAST(floor(depth / 250) AS BIGINT) * 100 + u // 7 AS component FROM grid),
  ob AS (SELECT frame_id, u, v, (u // 9) * 10 + v // 20 AS object FROM grid WHERE depth < 800),
  sz AS (SELECT frame_id, component, count(*) AS pixels FROM cp GROUP BY 1, 2), ar AS (SELECT frame_id, object, count(*) AS area FROM ob GROUP BY 1, 2),
  ov AS (SELECT frame_id, component, object, count(*) AS shared, any_value(pixels) AS pixels, any_value(area) AS area
    FROM cp JOIN ob USING (frame_id, u, v) JOIN sz USING (frame_id, component) JOIN ar USING (frame_id, object) GROUP BY 1, 2, 3)"""


def overlaps(spark, sf):
    g = grid(spark, sf)
    components = g.select("frame_id", "u", "v", (F.floor(F.col("depth") / 250) * 100 + F.expr("u div 7")).alias("component"))
    objects = g.filter("depth < 800").select("frame_id", "u", "v", F.expr("(u div 9) * 10 + v div 20").alias("object"))
    return J.component_overlaps(components, objects, ["frame_id"])


@query(
    "join14_unique_owner",
    f"""WITH {OWNER_SQL}, w AS (SELECT *, count(*) OVER (PARTITION BY frame_id, component) AS owners FROM ov WHERE shared >= greatest(3, area * 0.1))
    SELECT frame_id, component, object, shared, area, pixels FROM w WHERE owners = 1 AND shared >= area * 0.2 AND pixels <= area * 8""",
    "grid",
)
def _(spark, sf):
    return J.unique_owner(overlaps(spark, sf), ["frame_id"], min_pixels=3, cover=0.2)


@query(
    "join14_object_component",
    f"""WITH {OWNER_SQL}, w AS (SELECT *, count(*) OVER (PARTITION BY frame_id, component) AS owners FROM ov WHERE shared >= 5 AND shared >= pixels * 0.1),
     ct AS (SELECT frame_id, object, bool_or(owners > 1) AS contested FROM w GROUP BY 1, 2),
     f AS (SELECT *, row_number() OVER (PARTITION BY frame_id, object ORDER BY shared DESC, pixels DESC, component) AS k FROM w WHERE owners = 1 AND shared >= pixels * 0.35),
     b AS (SELECT frame_id, object, max(component) FILTER (k = 1) AS component, max(shared) FILTER (k = 1) AS s1, max(shared) FILTER (k = 2) AS s2 FROM f GROUP BY 1, 2),
     r AS (SELECT o.frame_id, o.object, component, coalesce(contested, false) OR coalesce(s2 >= s1 * 0.25, false) AS amb FROM (SELECT DISTINCT frame_id, object FROM ov) o LEFT JOIN ct USING (frame_id, object) LEFT JOIN b USING (frame_id, object))
    SELECT frame_id, object, CASE WHEN NOT amb THEN component END AS component,
     CASE WHEN amb THEN 'ambiguous_side_color_correspondence' WHEN component IS NULL THEN 'no_matching_side_color_component' ELSE 'accepted' END AS reason FROM r""",
    "grid",
)
def _(spark, sf):
    return J.object_component(overlaps(spark, sf), ["frame_id"], min_pixels=5)


@query(
    "join15_mutual_unique_match",
    """WITH p AS (SELECT object_id, seg_id AS corner_id, x1 AS line, y1 FROM seg WHERE flag), s AS (SELECT object_id, seg_id AS s_corner_id, x1 AS s_line, y1 AS s_y1 FROM seg WHERE NOT flag),
     c AS (SELECT object_id, corner_id, s_corner_id, abs(line - s_line) AS e, abs(line - s_line) / 3 + abs(y1 - s_y1) / 40 AS cost FROM p JOIN s USING (object_id) WHERE abs(line - s_line) <= 3),
     f AS (SELECT *, row_number() OVER (PARTITION BY object_id, corner_id ORDER BY cost, s_corner_id) AS k, lead(cost) OVER (PARTITION BY object_id, corner_id ORDER BY cost, s_corner_id) AS nx FROM c),
     b AS (SELECT *, row_number() OVER (PARTITION BY object_id, s_corner_id ORDER BY cost, corner_id) AS k, lead(cost) OVER (PARTITION BY object_id, s_corner_id ORDER BY cost, corner_id) AS nx FROM c)
    SELECT f.object_id, f.corner_id, f.s_corner_id, round(f.cost, 6) AS cost, round(f.e, 6) AS epipolar_error FROM f JOIN b ON f.object_id = b.object_id AND f.corner_id = b.corner_id AND f.s_corner_id = b.s_corner_id
    WHERE f.k = 1 AND b.k = 1 AND (f.nx IS NULL OR f.nx - f.cost >= 0.25) AND (b.nx IS NULL OR b.nx - b.cost >= 0.25)""",
    ("vec", "seg"),
)
def _(spark, sf):
    s = segments(spark, sf).select("object_id", F.col("seg_id").alias("corner_id"), F.col("x1").alias("line"), "y1", "flag")
    out = J.mutual_unique_match(
        s.filter("flag").drop("flag"), s.filter("not flag").drop("flag"), ["object_id"],
        auxiliary=F.abs(F.col("y1") - F.col("s_y1")) / 40,
    )
    return out.withColumns({c: F.round(c, 6) for c in ("cost", "epipolar_error")})


@query(
    "join16_scene_consistency",
    """WITH o AS (SELECT batch_id, supp AS scene_index, frame_id AS sample, truth AS label, count(*) AS n FROM det GROUP BY ALL),
     k AS (SELECT batch_id, scene_index, sample, string_agg(label || 'x' || n, ',' ORDER BY label) AS composition FROM o GROUP BY 1, 2, 3)
    SELECT batch_id, scene_index, sample, composition, arg_min(composition, sample) OVER (PARTITION BY batch_id, scene_index) AS expected,
     composition = arg_min(composition, sample) OVER (PARTITION BY batch_id, scene_index) AS consistent FROM k""",
    "det",
)
def _(spark, sf):
    c = F.col
    counts = detections(spark, sf).groupBy(
        "batch_id", c("supp").alias("scene_index"), c("frame_id").alias("sample"), c("truth").alias("label")
    ).agg(F.count(F.lit(1)).alias("count"))
    scenes = J.composition_key(counts, ["batch_id", "scene_index", "sample"])
    return J.scene_consistency(scenes, order=("sample",))


@query(
    "join17_contract_guard",
    """WITH m AS (SELECT s_suppkey AS model_id, 'r' || s_nationkey % 3 AS registry_hash, 'f' || s_suppkey % 2 AS feature_contract, 640 + s_suppkey % 5 AS intrinsics FROM supplier WHERE s_suppkey % 13 <> 0)
    SELECT frame_id, object_id, CASE WHEN m.model_id IS NULL THEN 'model_missing' WHEN registry_hash <> 'r' || part % 3 THEN 'registry_hash_mismatch'
      WHEN feature_contract <> 'f' || part % 2 THEN 'feature_contract_mismatch' WHEN intrinsics <> 640 + line % 5 THEN 'intrinsics_mismatch' ELSE 'accepted' END AS reason
    FROM det LEFT JOIN m ON model_id = supp""",
    "det",
)
def _(spark, sf):
    c = F.col
    models = table(spark, sf, "supplier").filter("s_suppkey % 13 <> 0").select(
        c("s_suppkey").alias("model_id"), F.concat(F.lit("r"), (c("s_nationkey") % 3).cast("string")).alias("registry_hash"),
        F.concat(F.lit("f"), (c("s_suppkey") % 2).cast("string")).alias("feature_contract"), (640 + c("s_suppkey") % 5).alias("intrinsics"),
    )
    rows = detections(spark, sf).select(
        "frame_id", "object_id", c("supp").alias("model_id"), F.concat(F.lit("r"), (c("part") % 3).cast("string")).alias("registry_hash"),
        F.concat(F.lit("f"), (c("part") % 2).cast("string")).alias("feature_contract"), (640 + c("line") % 5).cast("bigint").alias("intrinsics"),
    )
    return J.contract_guard(rows, models, "model_id").select("frame_id", "object_id", "reason")


FUSED_SQL = f"""{SAFETY_SQL}, base AS (SELECT frame_id, object_id, colour_confidence, {STATUS_SQL} AS status FROM saf),
  fus AS (SELECT b.frame_id, b.object_id, CASE WHEN part % 29 = 0 THEN 'PICKABLE' ELSE status END AS status, part % 31 = 0 AS selected FROM base b JOIN det USING (frame_id, object_id))"""


@query(
    "join18_baseline_safety_check",
    f"""WITH {FUSED_SQL} SELECT f.frame_id, f.object_id, f.status, f.selected, b.status AS baseline_status FROM fus f JOIN base b USING (frame_id, object_id)
    WHERE b.status IN ('OCCLUDED', 'DEPTH_INVALID', 'NO_GRASP_SURFACE') AND (f.status = 'PICKABLE' OR f.selected)""",
    "det",
)
def _(spark, sf):
    c = F.col
    base = safety(spark, sf).select("frame_id", "object_id", status_of().alias("status"))
    marks = detections(spark, sf).select("frame_id", "object_id", "part")
    fused = base.join(marks, ["frame_id", "object_id"]).select(
        "frame_id", "object_id", F.when(c("part") % 29 == 0, "PICKABLE").otherwise(c("status")).alias("status"),
        (c("part") % 31 == 0).alias("selected"),
    )
    return J.illegal_upgrades(base, fused, ["frame_id", "object_id"])


@query(
    "join19_colour_conflict_veto",
    f"""WITH {SAFETY_SQL}, p AS (SELECT frame_id, object_id, {STATUS_SQL} AS status FROM saf),
     j AS (SELECT p.*, part % 4 = 0 AS sel, truth <> 'A' AND prediction <> 'A' AND d.confidence >= 0.85 AND 1 - tax >= 0.95 AND truth <> prediction AND supp % 3 <> 0 AS conflict FROM p JOIN det d USING (frame_id, object_id))
    SELECT frame_id, object_id, conflict AS colour_conflict, sel AND NOT conflict AS selected, CASE WHEN conflict AND status IN ('PICKABLE', 'UNCERTAIN') THEN 'UNCERTAIN' ELSE status END AS status FROM j""",
    "det",
)
def _(spark, sf):
    c = F.col
    d = detections(spark, sf)
    known = lambda x: F.when(c(x) != "A", c(x)).otherwise("unknown")
    marks = d.select(
        "frame_id", "object_id", (c("part") % 4 == 0).alias("selected"), known("truth").alias("colour"),
    )
    primary = safety(spark, sf).withColumn("status", status_of()).select("frame_id", "object_id", "status", "colour_confidence").join(
        marks, ["frame_id", "object_id"]
    )
    side = d.filter("supp % 3 <> 0").select(
        "frame_id", "object_id", known("prediction").alias("colour"),
        F.when(1 - c("tax") >= 0.95, F.lit(0.9)).otherwise(F.lit(0.5)).alias("colour_confidence"),
    )
    return J.colour_conflict_veto(primary, side, ["frame_id", "object_id"]).select(
        "frame_id", "object_id", "colour_conflict", "selected", "status"
    )


def _contains(a: str, b: str, line: str) -> str:
    """SQL of the line test for endpoints a and b (pairs of columns) on a line alias."""
    dx, dy = f"({line}.x2 - {line}.x1)", f"({line}.y2 - {line}.y1)"
    l2 = f"({dx} * {dx} + {dy} * {dy})"

    def along(p):
        return f"((({p[0]}) - {line}.x1) * {dx} + (({p[1]}) - {line}.y1) * {dy}) / greatest({l2}, 1e-9)"

    def off(p):
        return f"abs({dx} * (({p[1]}) - {line}.y1) - {dy} * (({p[0]}) - {line}.x1)) / greatest(sqrt({l2}), 1e-6)"

    return (
        f"{l2} >= 64 AND greatest({off(a)}, {off(b)}) <= 3 AND least({along(a)}, {along(b)}) >= -0.1 "
        f"AND greatest({along(a)}, {along(b)}) <= 1.1 AND abs({along(a)} - {along(b)}) >= 0.5"
    )


EDGE3D_SQL = """eg AS (SELECT label AS object_id, id AS edge_id, v[1]*60 AS p1, v[2]*60 AS p2, v[3]*60 AS p3, v[4]*60 AS p4, v[5]*60 AS q1, v[6]*60 AS q2, v[7]*60 AS q3, v[8]*60 AS q4,
   v[9] > -0.1 AS s1, v[10] > -0.1 AS s2, v[11] > 0.05 AS two_view FROM vec),
  pl AS (SELECT label AS object_id, v[13]*100 AS x1, v[14]*100 AS y1, v[15]*100 AS x2, v[16]*100 AS y2 FROM vec),
  sl AS (SELECT label AS object_id, v[17]*100 AS x1, v[18]*100 AS y1, v[19]*100 AS x2, v[20]*100 AS y2 FROM vec)"""


def _lines(spark, sf, first):
    v = F.col("v")
    return vectors(spark, sf).select(
        F.col("label").alias("object_id"), F.col("id").alias("line_id"),
        *[(v[first + i] * 100).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))],
    )


@query(
    "join20_confirm_edges",
    f"""WITH {EDGE3D_SQL} SELECT object_id, edge_id FROM eg WHERE ((s1 AND s2) OR two_view)
      AND EXISTS (SELECT 1 FROM pl l WHERE l.object_id = eg.object_id AND {_contains(('eg.p1', 'eg.p2'), ('eg.p3', 'eg.p4'), 'l')})
      AND EXISTS (SELECT 1 FROM sl l WHERE l.object_id = eg.object_id AND {_contains(('eg.q1', 'eg.q2'), ('eg.q3', 'eg.q4'), 'l')})""",
    "vec",
)
def _(spark, sf):
    v = F.col("v")
    kinds = F.filter(
        F.array(F.when(v[8] > -0.1, J.EDGE_EVIDENCE[0]), F.when(v[9] > -0.1, J.EDGE_EVIDENCE[1])), lambda s: s.isNotNull()
    )
    edges = vectors(spark, sf).select(
        F.col("label").alias("object_id"), F.col("id").alias("edge_id"), kinds.alias("sources"), (v[10] > 0.05).alias("two_view"),
        *[(v[i] * 60).alias(n) for i, n in enumerate(("p1", "p2", "p3", "p4", "q1", "q2", "q3", "q4"))],
    )
    return J.confirm_edges(edges, _lines(spark, sf, 12), _lines(spark, sf, 16), ["object_id"]).select("object_id", "edge_id")


@query(
    "join21_reject_pair_reasons",
    f"""WITH {PAIR_SQL}, ref AS (SELECT session_id, min(ns) + 86400000000000 AS rns FROM frames WHERE session_id % 3 = 0 GROUP BY 1),
     f AS (SELECT frame_id AS primary_id, value FROM frames),
     z AS (SELECT session_id, concat_ws(',', CASE WHEN side_id IS NULL OR d > 60000000 THEN 'cameras_missing_or_unsynchronised' END, CASE WHEN value / 3 > 20 THEN 'primary_RGB_depth_sync_above_20_ms' END,
        CASE WHEN primary_id % 9 <> 2 AND primary_id % 9 > 6 THEN 'different_free_tag' END) AS reasons, coalesce(rns > 0 AND ns < rns, false) AS stale
       FROM pairs JOIN f USING (primary_id) LEFT JOIN ref USING (session_id))
    SELECT session_id, count(*) FILTER (reasons = '' AND NOT stale) AS usable_poses, count(*) FILTER (stale) AS stale_poses, count(*) FILTER (reasons = '' AND NOT stale) >= 5 AS enough FROM z GROUP BY 1""",
    "frames",
)
def _(spark, sf):
    c = F.col
    f = frames(spark, sf)
    ref = f.filter("session_id % 3 = 0").groupBy("session_id").agg((F.min("ns") + 86400000000000).alias("ns"))
    poses = pairs(spark, sf).join(f.select(c("frame_id").alias("primary_id"), "value"), "primary_id").select(
        "session_id", "primary_id", "side_id", "pair_delta_ms", c("primary_ns").alias("ns"), (c("value") / 3).alias("sync_ms"),
        F.when(c("primary_id") % 9 > 6, 3).otherwise(2).alias("tag_id"),
    )
    marked = pairing.session_pose_reasons(poses, ref, expected_tag=2, max_pair_ms=60_000_000.0)
    return pairing.session_verdicts(marked, required=5)


NODE_SQL = """nd AS (SELECT label AS object_id, id AS node_id, v[1]*60 AS pu, v[2]*60 AS pv, v[3]*60 AS su, v[4]*60 AS sv, v[5]*60 AS x, v[6]*60 AS y, 40 + v[7]*60 AS z FROM vec),
  tl AS (SELECT label AS object_id, id AS line_id, v[9]*100 AS x1, v[10]*100 AS y1, v[11]*100 AS x2, v[12]*100 AS y2 FROM vec),
  sl AS (SELECT label AS object_id, id AS line_id, v[13]*100 AS x1, v[14]*100 AS y1, v[15]*100 AS x2, v[16]*100 AS y2 FROM vec)"""


@query(
    "join22_two_view_edges",
    f"""WITH {NODE_SQL}, ab AS (SELECT a.object_id, a.node_id AS a, b.node_id AS b, a.pu AS apu, a.pv AS apv, b.pu AS bpu, b.pv AS bpv, a.su AS asu, a.sv AS asv, b.su AS bsu, b.sv AS bsv,
        a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz FROM nd a JOIN nd b ON a.object_id = b.object_id AND a.node_id < b.node_id),
     t AS (SELECT ab.object_id, a, b, any_value(line_id) AS top_line, any_value([(l.x1-320)/600, (l.y1-240)/600, (l.x2-320)/600, (l.y2-240)/600]) AS tq FROM ab JOIN tl l ON l.object_id = ab.object_id AND {_contains(('apu', 'apv'), ('bpu', 'bpv'), 'l')} GROUP BY 1, 2, 3 HAVING count(*) = 1),
     s AS (SELECT ab.object_id, a, b, any_value(line_id) AS side_line, any_value([(l.x1-320)/600, (l.y1-240)/600, (l.x2-320)/600, (l.y2-240)/600]) AS sq FROM ab JOIN sl l ON l.object_id = ab.object_id AND {_contains(('asu', 'asv'), ('bsu', 'bsv'), 'l')} GROUP BY 1, 2, 3 HAVING count(*) = 1),
     n AS (SELECT *, [tq[2]-tq[4], tq[3]-tq[1], tq[1]*tq[4]-tq[2]*tq[3]] AS na0, [sq[2]-sq[4], sq[3]-sq[1], sq[1]*sq[4]-sq[2]*sq[3]] AS ns0 FROM ab JOIN t USING (object_id, a, b) JOIN s USING (object_id, a, b)),
     m AS (SELECT *, list_transform(na0, lambda c: c / greatest(sqrt(list_sum(list_transform(na0, lambda d: d * d))), 1e-9)) AS na,
        list_transform(ns0, lambda c: c / greatest(sqrt(list_sum(list_transform(ns0, lambda d: d * d))), 1e-9)) AS nz FROM n),
     w AS (SELECT *, [nz[3], nz[2], -nz[1]] AS nb, nz[1] * 5 + nz[3] * 5 AS sh FROM m),
     r AS (SELECT object_id, a, b, top_line, side_line, sqrt((bx-ax)*(bx-ax) + (by_-ay)*(by_-ay) + (bz-az)*(bz-az)) AS length,
       greatest(abs(ax*na[1]+ay*na[2]+az*na[3]), abs(bx*na[1]+by_*na[2]+bz*na[3]), abs(ax*nb[1]+ay*nb[2]+az*nb[3]+sh), abs(bx*nb[1]+by_*nb[2]+bz*nb[3]+sh)) AS residual,
       sqrt(pow(na[2]*nb[3]-na[3]*nb[2], 2) + pow(na[3]*nb[1]-na[1]*nb[3], 2) + pow(na[1]*nb[2]-na[2]*nb[1], 2)) AS cr FROM w)
    SELECT object_id, a, b, top_line, side_line, round(length, 6) AS length, round(residual, 6) AS residual FROM r WHERE residual <= 60 AND length >= 4 AND cr >= 0.02""",
    "vec",
)
def _(spark, sf):
    v = F.col("v")
    nodes = vectors(spark, sf).select(
        F.col("label").alias("object_id"), F.col("id").alias("node_id"),
        *[(v[i] * 60).alias(n) for i, n in enumerate(("pu", "pv", "su", "sv", "x", "y"))], (40 + v[6] * 60).alias("z"),
    )
    out = J.two_view_edges(
        nodes, _lines(spark, sf, 8), _lines(spark, sf, 12), ["object_id"],
        camera={"fx": 600.0, "fy": 600.0, "cx": 320.0, "cy": 240.0},
        rotation=[[0, 0, -1], [0, 1, 0], [1, 0, 0]], translation=[5.0, 0.0, 5.0], max_residual=60.0,
    )
    return out.withColumns({c: F.round(c, 6) for c in ("length", "residual")})
