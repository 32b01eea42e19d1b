"""SRC1-SRC13 and UDF1-UDF5."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from framelake.catalog.aggregates import LANGS
from framelake.catalog.base import query
from framelake.catalog.views import captures, detections, frames, grid, table, vectors
from framelake.functions import labels
from framelake.operators import evaluation as E
from framelake.operators import extensions as X
from framelake.operators.neighbors import nearest_prototype
from framelake.plans.quantiles import mad
from framelake.session import scratch_path
from framelake.sources import images, manifest

ENTRY = "sample_dir string, batch_id string, label_id string, frame_id string"


def entries(spark, sf):
    return captures(spark, sf).select(
        F.concat_ws("/", "batch_id", "label_id", F.col("sample").cast("string")).alias("sample_dir"), "batch_id", "label_id",
        F.col("sample").cast("string").alias("frame_id"),
    )


def written(spark, sf):
    """The captures as JSON lines with blank and broken lines between them."""
    path = scratch_path(spark, "manifest")
    text = F.to_json(F.struct("sample_dir", "batch_id", "label_id", "frame_id"))
    number = F.col("frame_id").cast("bigint")
    line = F.when(number % 50 == 7, F.lit("")).when(number % 50 == 8, F.lit("{broken")).otherwise(text)
    entries(spark, sf).select(line.alias("value")).write.text(path)
    return path


@query(
    "src1_read_manifest",
    """SELECT batch_id || '/' || label_id || '/' || sample AS sample_dir, batch_id, label_id, CAST(sample AS VARCHAR) AS frame_id, '/data/' || batch_id || '/' || label_id || '/' || sample AS absolute_sample_dir FROM docs WHERE sample % 50 NOT IN (7, 8)""",
    "docs",
)
def _(spark, sf):
    return manifest.read_manifest(spark, written(spark, sf), ENTRY, root="/data").drop("line_number")


@query(
    "src1_numbered_lines",
    "SELECT row_number() OVER (ORDER BY sample) AS line_number, CAST(sample AS VARCHAR) AS line FROM docs",
    "docs",
)
def _(spark, sf):
    path = scratch_path(spark, "lines")
    # A sorted manifest in as many files as there are ranges; their names are in the same order.
    captures(spark, sf).select("sample").orderBy("sample").select(F.col("sample").cast("string").alias("value")).write.text(path)
    return manifest.numbered_lines(spark, path, through=True).select("line_number", "line")


@query("src2_manifest_errors", "SELECT '{broken' AS line, count(*) AS faults FROM docs WHERE sample % 50 = 8", "docs")
def _(spark, sf):
    return manifest.manifest_errors(spark, written(spark, sf), ENTRY).groupBy("line").agg(F.count(F.lit(1)).alias("faults"))


@query(
    "src3_scan_samples",
    """SELECT label_id, CASE WHEN sample % 11 = 3 THEN 'invalid_metadata' WHEN label_id = 'fr' THEN 'unknown_label' ELSE 'ok' END AS reason, count(*) AS n, CAST(sum(sample) AS BIGINT) AS samples FROM docs GROUP BY 1, 2""",
    "docs",
)
def _(spark, sf):
    c = F.col
    good = F.to_json(F.struct(c("label_id").alias("label"), F.lit("train").alias("split"), F.lit(True).alias("human_reviewed")))
    # The metadata file of each sample as a row; a broken one says nothing, so its label is its folder.
    files = captures(spark, sf).select(
        F.concat_ws("/", F.lit("file:/samples"), "batch_id", "label_id", c("sample").cast("string"), F.lit("metadata.json")).alias("path"),
        F.when(c("sample") % 11 == 3, F.lit('{"label": ')).otherwise(good).cast("binary").alias("content"),
    )
    names = labels.registry_aliases(labels.registry_frame(spark, [x for x in LANGS if x[0] != "fr"]))
    found = manifest.parse_samples(files, names).withColumn("sample", F.element_at(F.split("sample_dir", "/"), -1).cast("bigint"))
    return found.groupBy(c("raw_label").alias("label_id"), "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("sample").alias("samples"))


@query(
    "src4_label_files",
    """SELECT '/images/' || label_id || '/' || sample || '.png' AS path, CASE WHEN label_id <> 'fr' THEN label_id END AS label_id, CASE WHEN label_id = 'fr' THEN 'unknown_label_directory' WHEN n_chars % 9 = 0 THEN 'unreadable_image' ELSE 'ok' END AS reason FROM docs""",
    "docs",
)
def _(spark, sf):
    path = F.concat(F.lit("/images/"), F.col("label_id"), F.lit("/"), F.col("sample").cast("string"), F.lit(".png"))
    files = captures(spark, sf).select(path.alias("path"), F.when(F.col("n_chars") % 9 != 0, 640).alias("width"), F.lit(480).alias("height"))
    names = labels.registry_aliases(labels.registry_frame(spark, [c for c in LANGS if c[0] != "fr"]))
    return images.label_files(files, names).select("path", "label_id", "reason")


@query(
    "src5_decode_colour",
    """SELECT CAST(doc_id AS VARCHAR) AS path, CAST(k AS INT) AS u, 0 AS v, CAST(n_chars % 251 AS INT) AS b, CAST(doc_id % 241 AS INT) AS g, CAST(k * 7 AS INT) AS r FROM documents, range(8) t(k)""",
)
def _(spark, sf):
    def byte(x):
        return F.unhex(F.lpad(F.hex(x), 2, "0"))

    # One image row per document: eight pixels in blue, green, red order.
    pixels = F.concat(*[p for k in range(8) for p in (byte(F.col("n_chars") % 251), byte(F.col("doc_id") % 241), byte(F.lit(k * 7)))])
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("origin"), F.lit(1).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("nChannels"), pixels.alias("data")
    )
    return images.image_pixels(rows)


def _npy(pdf: pd.DataFrame) -> pd.DataFrame:
    cells = np.zeros((40, 40))
    cells[pdf["v"], pdf["u"]] = pdf["depth"]
    buffer = io.BytesIO()
    np.save(buffer, cells)
    return pd.DataFrame({"path": [str(pdf["frame_id"].iloc[0])], "content": [buffer.getvalue()]})


@query(
    "src6_decode_depth",
    """WITH f AS (SELECT DISTINCT frame_id FROM grid), c AS (SELECT frame_id, u, v FROM f, range(40) a(u), range(40) b(v))
    SELECT CAST(c.frame_id AS VARCHAR) AS path, CAST(c.u AS INT) AS u, CAST(c.v AS INT) AS v, round(coalesce(depth, 0) * 2, 6) AS depth FROM c LEFT JOIN grid USING (frame_id, u, v)""",
    "grid",
)
def _(spark, sf):
    # A frame's grid is 40 x 40 cells, so one group is one small file.
    files = grid(spark, sf).groupBy("frame_id").applyInPandas(_npy, "path string, content binary")
    return images.depth_cells(files, scale=2.0).withColumn("depth", F.round("depth", 6))


@query(
    "src7_content_hash",
    """SELECT sample, sha256(content) AS sha256, sha256(content || label_id) AS pair_sha256, sha256('v7' || batch_id || content) AS signature FROM docs""",
    "docs",
)
def _(spark, sf):
    c = F.col
    hashed = manifest.with_hashes(captures(spark, sf), sha256=[c("content")], pair_sha256=[c("content"), c("label_id")])
    return hashed.withColumn("signature", labels.signature("v7", c("batch_id"), c("content"))).select("sample", "sha256", "pair_sha256", "signature")


@query("src8_append_manifest", "SELECT batch_id, label_id, count(*) * 2 AS rows FROM docs GROUP BY 1, 2", "docs")
def _(spark, sf):
    root = scratch_path(spark, "append")
    for _ in range(2):
        manifest.append_manifest(entries(spark, sf), root)
    back = spark.read.schema("sample_dir string, frame_id string, batch_id string, label_id string").json(root)
    return back.groupBy("batch_id", "label_id").agg(F.count(F.lit(1)).alias("rows"))


@query("src9_write_once", "SELECT CAST(sample AS VARCHAR) AS frame_id, true AS second_write_refused FROM docs", "docs")
def _(spark, sf):
    path = scratch_path(spark, "once")
    manifest.write_once(entries(spark, sf), path)
    try:
        manifest.write_once(entries(spark, sf), path)
        refused = False
    except Exception:
        refused = True
    return spark.read.schema(ENTRY).json(path).select("frame_id", F.lit(refused).alias("second_write_refused"))


@query(
    "src10_write_reports",
    """SELECT truth, count(*) FILTER (prediction = 'A') AS as_A, count(*) FILTER (prediction = 'N') AS as_N, count(*) FILTER (prediction = 'R') AS as_R, CAST(0 AS BIGINT) AS as_unknown FROM det GROUP BY 1""",
    "det",
)
def _(spark, sf):
    root = scratch_path(spark, "reports")
    d = detections(spark, sf)
    manifest.write_reports(d.select("frame_id", "object_id", "truth", "prediction"), E.decision_metrics(d), E.confusion_matrix(d, ["A", "N", "R"]), root)
    return spark.read.option("header", "true").schema("truth string, as_A bigint, as_N bigint, as_R bigint, as_unknown bigint").csv(f"{root}/confusion")


@query("src11_replay_frames", "SELECT CAST(sample AS VARCHAR) AS frame_id, batch_id FROM docs", "docs")
def _(spark, sf):
    from framelake.streaming.common import run_to_table

    root = scratch_path(spark, "replay")
    entries(spark, sf).repartition(4).write.json(root)
    return run_to_table(images.replay_frames(spark, root, ENTRY, files_per_trigger=2), "replayed").select("frame_id", "batch_id")


@query("src12_explode_results", "SELECT frame_id, object_id, truth, round(confidence, 6) AS confidence, round(tax, 6) AS tax FROM det", "det")
def _(spark, sf):
    d = detections(spark, sf)
    nested = d.groupBy("frame_id").agg(
        F.collect_list(F.struct("object_id", "truth", "confidence", F.struct("tax").alias("diagnostics"))).alias("results")
    )
    out = manifest.explode_results(nested)
    return out.select("frame_id", "object_id", "truth", F.round("confidence", 6).alias("confidence"), F.round("diagnostics.tax", 6).alias("tax"))


@query(
    "src13_evaluation_records",
    """WITH res AS (SELECT frame_id AS sample, object_id, prediction AS mono_label, CASE WHEN line = 1 THEN 'distance_rejected' WHEN line = 2 THEN 'margin_rejected' END AS mono_reason, truth AS fused_label, CASE WHEN accepted THEN 'FUSED' WHEN line = 3 THEN 'SIDE_OCCLUDED' END AS fusion_state,
        CASE WHEN part % 3 = 0 THEN 'PICKABLE' ELSE 'UNCERTAIN' END AS status FROM det WHERE part % 6 <> 0),
     smp AS (SELECT o_orderkey AS sample, CASE WHEN o_orderkey % 2 = 0 THEN 'final_holdout' ELSE 'development' END AS split, o_custkey % 3 = 0 AS is_multi, o_orderstatus = 'F' AS human_reviewed, o_orderpriority AS label_id, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey % 5 = 1 END AS s_ok FROM orders),
     rev AS (SELECT frame_id AS sample, object_id, truth AS r_label, line <> 4 AS r_ok, line = 5 AS r_occ FROM det WHERE supp % 2 = 0)
    SELECT sample, object_id, split, human_reviewed AND (NOT is_multi OR r_label IS NOT NULL) AS human_reviewed, CASE WHEN is_multi THEN r_label ELSE label_id END AS true_label, mono_label, coalesce(mono_reason, 'accepted') = 'accepted' AS mono_accepted, fused_label,
      coalesce(fusion_state, '') = 'FUSED' AS fused_accepted, status = 'PICKABLE' AND coalesce(mono_reason, '') NOT IN ('accepted', 'margin_rejected') AS safety_state_upgraded, CASE WHEN r_label IS NOT NULL THEN r_occ ELSE coalesce(fusion_state, '') = 'SIDE_OCCLUDED' END AS side_occluded,
      CASE WHEN r_label IS NOT NULL THEN NOT r_ok ELSE s_ok IS NOT NULL AND NOT coalesce(s_ok, false) END AS association_error, false AS missed_object FROM res JOIN smp USING (sample) LEFT JOIN rev USING (sample, object_id)
    UNION ALL SELECT sample, object_id, split, human_reviewed, r_label, NULL, false, NULL, false, false, r_occ, NOT r_ok, true FROM rev JOIN smp USING (sample) WHERE is_multi AND NOT EXISTS (SELECT 1 FROM res WHERE res.sample = rev.sample AND res.object_id = rev.object_id)""",
    "det",
)
def _(spark, sf):
    c = F.col
    d = detections(spark, sf)
    results = d.filter("part % 6 <> 0").select(
        c("frame_id").alias("sample"), "object_id", c("prediction").alias("mono_label"),
        F.when(c("line") == 1, "distance_rejected").when(c("line") == 2, "margin_rejected").alias("mono_reason"), c("truth").alias("fused_label"),
        F.when(c("accepted"), "FUSED").when(c("line") == 3, "SIDE_OCCLUDED").alias("fusion_state"), F.when(c("part") % 3 == 0, "PICKABLE").otherwise("UNCERTAIN").alias("status"),
    )
    samples = table(spark, sf, "orders").select(
        c("o_orderkey").alias("sample"), F.when(c("o_orderkey") % 2 == 0, "final_holdout").otherwise("development").alias("split"), (c("o_custkey") % 3 == 0).alias("is_multi"),
        (c("o_orderstatus") == "F").alias("human_reviewed"), c("o_orderpriority").alias("label_id"), F.when(c("o_custkey") % 5 != 0, c("o_custkey") % 5 == 1).alias("association_ok"),
    )
    reviews = d.filter("supp % 2 = 0").select(
        c("frame_id").alias("sample"), "object_id", c("truth").alias("true_label"), (c("line") != 4).alias("association_ok"), (c("line") == 5).alias("side_occluded")
    )
    return manifest.evaluation_records(results, samples, reviews)


def _size_class(row: dict) -> dict:
    if row["area"] > 400:
        raise ValueError("object too large")
    return {"size": "small" if row["area"] < 100 else "medium", "confidence": 1.0}


@query(
    "udf1_extensions",
    """SELECT object_id || '@' || frame_id AS key, CASE WHEN w * h < 100 THEN 'small' WHEN w * h <= 400 THEN 'medium' END AS size, CASE WHEN w * h > 400 THEN 'ValueError: object too large' END AS error, CASE WHEN w * h > 400 THEN '0.0' ELSE '1.0' END AS confidence FROM det""",
    "det",
)
def _(spark, sf):
    if "size" not in X._EXTENSIONS:
        X.register_extension("size", _size_class)
    d = detections(spark, sf).select(F.concat_ws("@", "object_id", F.col("frame_id").cast("string")).alias("key"), (F.col("w") * F.col("h")).alias("area"))
    values = F.col("extensions")["size"]
    return X.apply_extensions(d, ["area"], ["size"]).select("key", values["size"].alias("size"), values["error"].alias("error"), values["confidence"].alias("confidence"))


def _linear_model():
    def run(given: pd.DataFrame) -> pd.DataFrame:
        p = 1.0 - given["tax"] * 5
        label = p.ge(0.8).map({True: "light", False: "heavy"})
        good = p >= 0.7
        return pd.DataFrame(
            {"label": label, "confidence": p.round(6), "accepted": good, "reason": good.map({True: "accepted", False: "distance_rejected"}),
             "candidates": [[{"label": a, "probability": float(b)}] for a, b in zip(label, p)]}
        )

    return run


@query(
    "udf2_shape_model",
    """SELECT object_id || '@' || frame_id AS key, CASE WHEN 1 - tax * 5 >= 0.8 THEN 'light' ELSE 'heavy' END AS label, round(1 - tax * 5, 4) AS confidence, 1 - tax * 5 >= 0.7 AS accepted, CASE WHEN 1 - tax * 5 >= 0.7 THEN 'accepted' ELSE 'distance_rejected' END AS reason, 1 AS candidates FROM det""",
    "det",
)
def _(spark, sf):
    d = detections(spark, sf).select(F.concat_ws("@", "object_id", F.col("frame_id").cast("string")).alias("key"), "tax")
    p = F.col("prediction")
    return X.shape_model(_linear_model, ["tax"])(d).select(
        "key", p["label"].alias("label"), F.round(p["confidence"], 4).alias("confidence"), p["accepted"].alias("accepted"), p["reason"].alias("reason"),
        F.size(p["candidates"]).alias("candidates"),
    )


def _words(pdf: pd.DataFrame) -> pd.DataFrame:
    spread = pdf.assign(word=pdf["content"].str.split()).explode("word")
    spread = spread[spread["word"].notna()]
    return pd.DataFrame({"sample": spread["sample"], "size": spread["word"].str.len().astype("int64")})


@query(
    "udf3_instance_model",
    """WITH w AS (SELECT sample, regexp_extract_all(content, '[^\\s]+') AS ws FROM docs)
    SELECT sample, CAST(len(ws) AS BIGINT) AS instances, CAST(list_sum([length(x) for x in ws]) AS BIGINT) AS total_size FROM w WHERE len(ws) > 0""",
    "docs",
)
def _(spark, sf):
    # Every word of a text stands for an instance that a model finds in a frame.
    found = X.instance_model(captures(spark, sf).select("sample", "content"), _words, "sample bigint, size bigint")
    return found.groupBy("sample").agg(F.count(F.lit(1)).alias("instances"), F.sum("size").alias("total_size"))


@query(
    "udf4_prediction_struct",
    """WITH pt AS (SELECT label, arg_min(v, id) AS v FROM vec GROUP BY 1), d AS (SELECT a.id AS qid, p.label, sqrt(list_sum([(a.v[i] - p.v[i]) * (a.v[i] - p.v[i]) for i in range(1, 65)])) AS distance FROM vec a CROSS JOIN pt p),
     s AS (SELECT *, exp(-distance / 0.15) / greatest(sum(exp(-distance / 0.15)) OVER (PARTITION BY qid), 1e-12) AS score, row_number() OVER (PARTITION BY qid ORDER BY distance, label) AS k FROM d)
    SELECT qid, max(CASE WHEN k = 1 THEN label END) AS label, round(max(score), 6) AS confidence,
     string_agg(label || ':' || CAST(CAST(round(score * 10000) AS BIGINT) AS VARCHAR), ',' ORDER BY score DESC, label DESC) FILTER (k <= 3) AS candidates FROM s GROUP BY 1""",
    "vec",
)
def _(spark, sf):
    c = vectors(spark, sf)
    scored = nearest_prototype(c.select(F.col("id").alias("qid"), "v"), c.groupBy("label").agg(F.min_by("v", "id").alias("v")))
    entry = F.concat_ws(":", "label", F.round(F.col("score") * 10000).cast("bigint").cast("string"))
    return scored.groupBy("qid").agg(
        F.min_by(F.col("label"), F.struct("distance", "label")).alias("label"), F.round(F.max("score"), 6).alias("confidence"),
        F.array_join(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("score", "label", entry.alias("e"))))), 1, 3)["e"], ",").alias("candidates"),
    )


@query(
    "udf5_robust_aggregates",
    """WITH m AS (SELECT kind, median(value) AS med FROM frames GROUP BY 1), d AS (SELECT kind, median(abs(value - med)) AS mad FROM frames JOIN m USING (kind) GROUP BY 1),
     c AS (SELECT kind, ((degrees(atan2(avg(sin(radians(value))), avg(cos(radians(value))))) % 360) + 360) % 360 AS direction FROM frames GROUP BY 1)
    SELECT kind, round(med, 6) AS median, round(mad, 6) AS mad, round(direction, 4) AS direction FROM m JOIN d USING (kind) JOIN c USING (kind)""",
    "frames",
)
def _(spark, sf):
    f = frames(spark, sf)
    turn = f.groupBy("kind").agg(F.round(X.circular_mean(F.col("value")), 4).alias("direction"))
    return mad(f, ["kind"], F.col("value")).join(turn, "kind").select("kind", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"), "direction")
