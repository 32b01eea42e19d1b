"""ML1-ML20."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.catalog.base import query
from framelake.catalog.joins import HALF_SQL, halves
from framelake.catalog.views import captures, detections, scores, vectors
from framelake.functions import geometry as G
from framelake.functions import labels
from framelake.functions import scores as SC
from framelake.operators import calibrate as C
from framelake.operators import neighbors as N

STD_SQL = """lv AS (SELECT id, label, unnest(range(64)) AS dim, unnest(v) AS x FROM vec), sd AS (SELECT dim, avg(x) AS mean, CASE WHEN stddev_pop(x) < 1e-4 THEN 1 ELSE stddev_pop(x) END AS scale FROM lv GROUP BY 1),
  zl AS (SELECT id, label, dim, (x - mean) / scale AS z FROM lv JOIN sd USING (dim)), za AS (SELECT id, label, list(z ORDER BY dim) AS z FROM zl GROUP BY 1, 2)"""


def rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


def standard(spark, sf):
    v = vectors(spark, sf)
    return N.with_standard(v, N.scale_arrays(N.fit_standardizer(v)))


@query("ml1_fit_standardizer", f"WITH {STD_SQL} SELECT CAST(dim AS INT) AS dim, round(mean, 6) AS mean, round(scale, 6) AS scale FROM sd", "vec")
def _(spark, sf):
    return rounded(N.fit_standardizer(vectors(spark, sf)), 6, "mean", "scale")


@query("ml2_standardize", f"WITH {STD_SQL} SELECT id, round(z[1], 6) AS z0, round(z[64], 6) AS z63, round(list_sum(z), 4) AS total FROM za", "vec")
def _(spark, sf):
    z = F.col("z")
    return standard(spark, sf).select("id", F.round(z[0], 6).alias("z0"), F.round(z[63], 6).alias("z63"), F.round(F.aggregate(z, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(
    "ml2_unstandardize",
    "SELECT id, round(v[1], 6) AS v0, round(v[64], 6) AS v63 FROM vec",
    "vec",
)
def _(spark, sf):
    v = vectors(spark, sf)
    arrays = N.scale_arrays(N.fit_standardizer(v)).withColumn("one", F.lit(1))
    z = N.with_standard(v, arrays.drop("one")).withColumn("one", F.lit(1)).join(arrays, "one")
    back = N.unstandardize(F.col("z"), F.col("mean"), F.col("scale"))
    return z.select("id", F.round(back[0], 6).alias("v0"), F.round(back[63], 6).alias("v63"))


@query("ml3_class_centroids", f"WITH {STD_SQL} SELECT label, CAST(dim AS INT) AS dim, round(avg(z), 6) AS x FROM zl GROUP BY 1, 2", "vec")
def _(spark, sf):
    return rounded(N.class_centroids(standard(spark, sf)), 6, "x")


KNN_SQL = f"""{STD_SQL}, dd AS (SELECT a.id AS qid, a.label AS truth, b.label, list_sum(list_transform(list_zip(a.z, b.z), lambda p: abs(p[1] - p[2]))) / 64 AS d FROM za a JOIN za b ON a.id <> b.id),
  nn AS (SELECT qid, truth, label, d FROM dd QUALIFY row_number() OVER (PARTITION BY qid, label ORDER BY d) <= 3), cd AS (SELECT qid, truth, label, avg(d) AS distance FROM nn GROUP BY 1, 2, 3)"""


def knn(spark, sf, **options):
    z = standard(spark, sf)
    return N.class_distances(
        z.select(F.col("id").alias("qid"), F.col("z").alias("v"), F.col("id").alias("tag")),
        z.select(F.col("z").alias("v"), "label", F.col("id").alias("tag")), k=3, exclude="tag", **options,
    )


@query("ml4_class_distances", f"WITH {KNN_SQL} SELECT qid, label, round(distance, 6) AS distance FROM cd", "vec")
def _(spark, sf):
    return rounded(knn(spark, sf), 6, "distance")


@query("ml4_class_distances_blocked", f"WITH {KNN_SQL} SELECT qid, label, round(distance, 6) AS distance FROM cd", "vec")
def _(spark, sf):
    return rounded(knn(spark, sf, block_rows=1000), 6, "distance")


ACCEPT_SQL = f"""{KNN_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, label) AS k FROM cd), b AS (SELECT a.qid, a.truth, a.label, a.distance, (n.distance - a.distance) / greatest(n.distance, 1e-6) AS margin FROM r a JOIN r n ON a.qid = n.qid AND a.k = 1 AND n.k = 2),
  ar AS (SELECT *, CASE WHEN distance > 0.95 THEN 'distance_rejected' WHEN margin < 0.02 THEN 'margin_rejected' ELSE 'accepted' END AS reason FROM b)"""


def accepted(spark, sf):
    return N.accept_reject(knn(spark, sf), distance_limit=0.95, margin_limit=0.02)


@query("ml5_accept_reject", f"WITH {ACCEPT_SQL} SELECT qid, label, round(distance, 6) AS distance, round(margin, 6) AS margin, reason, CASE WHEN reason = 'accepted' THEN label ELSE 'unknown' END AS decision FROM ar", "vec")
def _(spark, sf):
    return rounded(accepted(spark, sf), 6, "distance", "margin")


@query("ml6_loo_threshold", f"WITH {KNN_SQL} SELECT label, round(greatest(0.35, quantile_cont(distance, 0.98) * 1.35 + 0.04), 6) AS distance_limit FROM cd WHERE truth = label GROUP BY 1", "vec")
def _(spark, sf):
    z = standard(spark, sf).select("id", "label", F.col("z").alias("v"))
    return rounded(N.loo_threshold(z), 6, "distance_limit")


WEIGHTINGS = ([1.0] * 64, [2.0] * 16 + [1.0] * 48, [0.5] * 32 + [1.5] * 32)


def leave_out_sql(tag: str, weightings) -> str:
    """Best class of every row from the rows with another tag, each row under the scales of those rows."""
    each = ", ".join(f"({i}, {[w / (sum(x) / len(x)) for w in x]})" for i, x in enumerate(weightings))
    return f"""tv AS (SELECT id, label, {tag} AS tag, v FROM vec), lv AS (SELECT tag, unnest(range(64)) AS dim, unnest(v) AS x FROM tv),
      st AS (SELECT tag, dim, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM lv GROUP BY 1, 2), sa AS (SELECT dim, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM st GROUP BY 1),
      sd AS (SELECT tag, dim, sqrt(greatest((a.q - t.q) / (a.n - t.n) - ((a.s - t.s) / (a.n - t.n)) ** 2, 0)) AS sd FROM st t JOIN sa a USING (dim)),
      sc AS (SELECT tag, list(CASE WHEN sd < 1e-4 THEN 1 ELSE sd END ORDER BY dim) AS sc FROM sd GROUP BY 1), wt(weighting, w) AS (VALUES {each}),
      dd AS (SELECT a.id AS qid, weighting, a.label AS truth, b.label, list_sum([abs(a.v[i] - b.v[i]) * w[i] / sc[i] for i in range(1, 65)]) / 64 AS d
             FROM tv a JOIN sc ON sc.tag = a.tag JOIN tv b ON a.tag <> b.tag CROSS JOIN wt),
      nn AS (SELECT * FROM dd QUALIFY row_number() OVER (PARTITION BY qid, weighting, label ORDER BY d) <= 3),
      cd AS (SELECT qid, weighting, truth, label, avg(d) AS distance FROM nn GROUP BY 1, 2, 3, 4),
      lo AS (SELECT qid, CAST(weighting AS INT) AS weighting, truth, label, distance FROM cd QUALIFY row_number() OVER (PARTITION BY qid, weighting ORDER BY distance, label) = 1)"""


RANK_SQL = """SELECT weighting, count(*) FILTER (decision = truth) AS correct, count(*) FILTER (decision <> truth AND decision <> 'unknown') AS wrong, count(*) FILTER (decision = 'unknown') AS unknown,
  count(*) FILTER (decision = truth) - 2 * count(*) FILTER (decision <> truth AND decision <> 'unknown') AS score FROM (SELECT *, CASE WHEN distance > {limit} THEN 'unknown' ELSE label END AS decision FROM lo) GROUP BY 1"""


@query("ml7_leave_one_out_eval", f"WITH {leave_out_sql('id', WEIGHTINGS[:1])} SELECT qid, weighting, truth, label, round(distance, 6) AS distance FROM lo", "vec")
def _(spark, sf):
    return rounded(N.leave_out_eval(vectors(spark, sf), by="id"), 6, "distance")


def batched(spark, sf):
    return vectors(spark, sf).withColumn("batch", F.concat(F.lit("b"), (F.col("id") % 4).cast("string")))


@query("ml8_leave_batch_out_eval", f"""WITH {leave_out_sql("'b' || (id % 4)", WEIGHTINGS)} {RANK_SQL.format(limit=1.0)}""", "vec")
def _(spark, sf):
    out = N.leave_out_eval(batched(spark, sf), by="batch", weights=WEIGHTINGS)
    counted = C.rank_weightings(out.withColumn("decision", F.when(F.col("distance") > 1.0, "unknown").otherwise(F.col("label"))))
    return counted


COLOUR_SQL = """cv AS (SELECT id, label, v[1:5] AS v FROM vec), o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY v[5], id) - 1 AS o, count(*) OVER (PARTITION BY label) AS n FROM cv),
  k AS (SELECT *, CASE WHEN o < (n % 3) * (n // 3 + 1) THEN o // (n // 3 + 1) ELSE n % 3 + (o - (n % 3) * (n // 3 + 1)) // (n // 3) END AS chunk FROM o),
  pt AS (SELECT label, chunk, [median(v[1]), median(v[2]), median(v[3]), median(v[4]), median(v[5])] AS v FROM k GROUP BY 1, 2)"""


def colours(spark, sf):
    return vectors(spark, sf).select("id", "label", F.slice("v", 1, 5).alias("v"))


@query("ml9_fit_prototypes", f"WITH {COLOUR_SQL} SELECT label, CAST(chunk AS BIGINT) AS chunk, round(v[1], 6) AS v0, round(v[5], 6) AS v4 FROM pt", "vec")
def _(spark, sf):
    v = F.col("v")
    return N.fit_prototypes(colours(spark, sf)).select("label", F.col("chunk").cast("bigint").alias("chunk"), F.round(v[0], 6).alias("v0"), F.round(v[4], 6).alias("v4"))


@query(
    "ml9_nearest_prototype",
    f"""WITH {COLOUR_SQL}, d AS (SELECT a.id AS qid, p.label, min(sqrt(list_sum(list_transform(list_zip(a.v, p.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS distance FROM cv a CROSS JOIN pt p GROUP BY 1, 2)
    SELECT qid, label, round(distance, 6) AS distance, round(exp(-distance / 0.15) / sum(exp(-distance / 0.15)) OVER (PARTITION BY qid), 6) AS score FROM d""",
    "vec",
)
def _(spark, sf):
    c = colours(spark, sf)
    return rounded(N.nearest_prototype(c.select(F.col("id").alias("qid"), "v"), N.fit_prototypes(c)), 6, "distance", "score")


@query(
    "ml10_fit_temperature",
    """WITH n AS (SELECT id, label, cls, greatest(p / sum(p) OVER (PARTITION BY id), 1e-9) AS q FROM scores), g AS (SELECT 0.2 * pow(25::DOUBLE, i / 160) AS t FROM range(161) r(i)),
     l AS (SELECT t, id, ln(max(CASE WHEN cls = label THEN pow(q, 1 / t) END) / sum(pow(q, 1 / t))) AS ll FROM n CROSS JOIN g GROUP BY 1, 2), m AS (SELECT t, avg(-ll) AS nll, count(*) AS samples FROM l GROUP BY 1)
    SELECT round(t, 6) AS temperature, round(nll, 6) AS nll, samples FROM m ORDER BY m.nll, t LIMIT 1""",
    ("vec", "scores"),
)
def _(spark, sf):
    return rounded(C.fit_temperature(scores(spark, sf), "top", "label"), 6, "temperature", "nll")


DISTANCES = [0.5, 0.7, 0.8, 0.85, 0.9, 0.95, 1.0, 1.05, 1.1]
MARGINS = [0.0, 0.01, 0.02, 0.05, 0.1]


@query(
    "ml11_fit_thresholds",
    f"""WITH {ACCEPT_SQL}, g AS (SELECT d, m FROM (SELECT unnest({DISTANCES})::DOUBLE AS d) CROSS JOIN (SELECT unnest({MARGINS})::DOUBLE AS m)),
     k AS (SELECT g.d, g.m, truth, count(*) AS n, count(*) FILTER (distance <= g.d AND margin >= g.m) AS a, count(*) FILTER (distance <= g.d AND margin >= g.m AND label = truth) AS c FROM b CROSS JOIN g GROUP BY 1, 2, 3),
     s AS (SELECT d, m, CAST(sum(a) - sum(c) AS BIGINT) AS wrong_accepts, avg(c / n) AS macro_recall, sum(a) / sum(n) AS coverage FROM k GROUP BY 1, 2)
    SELECT d AS distance_threshold, m AS margin_threshold, wrong_accepts, round(macro_recall, 6) AS macro_recall, round(coverage, 6) AS coverage FROM s
    ORDER BY wrong_accepts <> 0, s.wrong_accepts, round(s.macro_recall, 9) DESC, round(s.coverage, 9) DESC, d, m DESC LIMIT 1""",
    "vec",
)
def _(spark, sf):
    observed = accepted(spark, sf).join(vectors(spark, sf).select(F.col("id").alias("qid"), F.col("label").alias("truth")), "qid").select(
        "truth", F.col("label").alias("prediction"), "distance", "margin"
    )
    out = C.fit_thresholds(observed, distances=DISTANCES, margins=MARGINS)
    return rounded(out, 6, "macro_recall", "coverage")


@query(
    "ml11_fit_thresholds_observed",
    f"""WITH {ACCEPT_SQL}, o AS (SELECT truth, label = truth AS good, round(distance, 9) AS distance, round(margin, 9) AS margin FROM b),
     t AS (SELECT greatest(max(margin), 0.4) AS top FROM o), w AS (SELECT o.* FROM o, t WHERE NOT good AND NOT (distance <= 0 AND margin >= top)),
     d AS (SELECT DISTINCT distance AS d FROM o UNION SELECT 0), l AS (SELECT d.d, max(w.margin) AS above FROM d LEFT JOIN w ON w.distance <= d.d GROUP BY 1),
     f AS (SELECT d, coalesce(above, -1) AS above FROM l, t WHERE coalesce(above, -1) < top),
     k AS (SELECT f.d, truth, count(*) AS n, count(*) FILTER (distance <= f.d AND margin > above) AS a, count(*) FILTER (distance <= f.d AND margin > above AND good) AS c,
       min(margin) FILTER (distance <= f.d AND margin > above) AS least FROM o CROSS JOIN f GROUP BY 1, 2),
     s AS (SELECT d, CAST(sum(a) - sum(c) AS BIGINT) AS wrong_accepts, avg(c / n) AS macro_recall, sum(a) / sum(n) AS coverage, min(least) AS least FROM k GROUP BY 1)
    SELECT d AS distance_threshold, coalesce(least, top) AS margin_threshold, wrong_accepts, round(macro_recall, 6) AS macro_recall, round(coverage, 6) AS coverage FROM s, t
    ORDER BY s.wrong_accepts, round(s.macro_recall, 9) DESC, round(s.coverage, 9) DESC, d LIMIT 1""",
    "vec",
)
def _(spark, sf):
    observed = accepted(spark, sf).join(vectors(spark, sf).select(F.col("id").alias("qid"), F.col("label").alias("truth")), "qid").select(
        "truth", F.col("label").alias("prediction"), F.round("distance", 9).alias("distance"), F.round("margin", 9).alias("margin")
    )
    return rounded(C.fit_thresholds(observed), 6, "macro_recall", "coverage")


POLICY_RULES = [{"method": m, "side_weight": w} for m in ("probability_sum", "log_product") for w in (0.15, 0.30, 0.45)]
RULE_SQL = """tn AS (SELECT id, label, cls, quality, p / sum(p) OVER (PARTITION BY id) AS p, s / sum(s) OVER (PARTITION BY id) AS s FROM scores), rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, cls) AS r FROM tn),
  pr AS (SELECT a.id, a.label AS truth, a.quality, a.cls AS la, b.cls AS lb, a.p / (a.p + b.p) AS ta, b.p / (a.p + b.p) AS tb, a.s / (a.s + b.s) AS xa, b.s / (a.s + b.s) AS xb FROM rk a JOIN rk b ON a.id = b.id AND a.r = 1 AND b.r = 2),
  ru AS (SELECT CAST(i AS INT) AS rule, i < 3 AS is_sum, [0.15, 0.30, 0.45][i % 3 + 1]::DOUBLE AS w FROM range(6) t(i)), e AS (SELECT *, least(0.95, w * quality) AS e FROM pr CROSS JOIN ru),
  f AS (SELECT *, CASE WHEN is_sum THEN (1-e)*ta + e*xa ELSE 1 / (1 + exp((1-e)*(ln(tb)-ln(ta)) + e*(ln(xb)-ln(xa)))) END AS p FROM e), o AS (SELECT rule, id, truth, la, CASE WHEN p > 1 - p THEN la ELSE lb END AS prediction, greatest(p, 1-p) AS probability, abs(2*p-1) AS margin FROM f)"""


@query(
    "ml12_fit_policy",
    f"""WITH {RULE_SQL}, g AS (SELECT 0.55::DOUBLE + i * 0.03::DOUBLE AS tp, 0.02::DOUBLE + j * 0.03::DOUBLE AS tm FROM range(11) a(i), range(8) b(j)),
     k AS (SELECT rule, tp, tm, truth, count(*) AS n, count(*) FILTER (probability >= tp AND margin >= tm) AS a, count(*) FILTER (probability >= tp AND margin >= tm AND prediction = truth) AS c FROM o CROSS JOIN g GROUP BY 1, 2, 3, 4),
     s AS (SELECT rule, tp, tm, CAST(sum(a) - sum(c) AS BIGINT) AS wrong_accepts, avg(c / n) AS macro_recall, sum(a) / sum(n) AS coverage FROM k GROUP BY 1, 2, 3)
    SELECT rule, round(tp, 6) AS fused_probability, round(tm, 6) AS fused_margin, wrong_accepts, round(macro_recall, 6) AS macro_recall, round(coverage, 6) AS coverage FROM s
    ORDER BY s.wrong_accepts <> 0, s.wrong_accepts, round(s.macro_recall, 9) DESC, round(s.coverage, 9) DESC, rule, tp, tm LIMIT 1""",
    ("vec", "scores"),
)
def _(spark, sf):
    out = C.fit_policy(scores(spark, sf), POLICY_RULES)
    return rounded(out, 6, "fused_probability", "fused_margin", "macro_recall", "coverage")


LOGISTIC = {"method": "top2_logistic", "side_weight": 0.30, "weights": (0.8, 0.35, -0.2, 0.5, 0.9), "bias": 0.1}


@query(
    "ml12_fit_policy_logistic",
    f"""WITH {RULE_SQL}, lg AS (SELECT id, truth, la, lb, 1 / (1 + exp(-(0.1 + 0.8 * ln(ta / tb) + 0.35 * ln(xa / xb) - 0.2 * quality + 0.5 * (ta - tb) + 0.9 * (xa - xb)))) AS p FROM pr),
     o7 AS (SELECT rule, id, truth, prediction, probability, margin FROM o UNION ALL SELECT 6, id, truth, CASE WHEN p > 1 - p THEN la ELSE lb END, greatest(p, 1 - p), abs(2 * p - 1) FROM lg),
     g AS (SELECT 0.55::DOUBLE + i * 0.03::DOUBLE AS tp, 0.02::DOUBLE + j * 0.03::DOUBLE AS tm FROM range(11) a(i), range(8) b(j)),
     k AS (SELECT rule, tp, tm, truth, count(*) AS n, count(*) FILTER (probability >= tp AND margin >= tm) AS a, count(*) FILTER (probability >= tp AND margin >= tm AND prediction = truth) AS c FROM o7 CROSS JOIN g GROUP BY 1, 2, 3, 4)
    SELECT rule, round(tp, 6) AS fused_probability, round(tm, 6) AS fused_margin, CAST(sum(a) - sum(c) AS BIGINT) AS wrong_accepts, round(avg(c / n), 6) AS macro_recall, round(sum(a) / sum(n), 6) AS coverage FROM k GROUP BY rule, tp, tm""",
    ("vec", "scores"),
)
def _(spark, sf):
    """Every candidate of the search, the logistic rule with given weights among them."""
    out = C.policy_candidates(scores(spark, sf), [*POLICY_RULES, LOGISTIC], 1.0, 1.0, C.linear_grid(0.55, 0.03, 11), C.linear_grid(0.02, 0.03, 8))
    return rounded(out, 6, "fused_probability", "fused_margin", "macro_recall", "coverage").select(
        "rule", "fused_probability", "fused_margin", "wrong_accepts", "macro_recall", "coverage"
    )


@query("ml12_fit_policy_fitted")
def _(spark, sf):
    """The policy chosen among the locked rules, with logistic weights fitted to the same rows."""
    s = scores(spark, sf)
    return rounded(C.fit_policy(s, C.locked_rules(s)), 6, "fused_probability", "fused_margin", "macro_recall", "coverage")


@query(
    "ml13_rule_scores",
    f"""WITH {RULE_SQL}, k AS (SELECT rule, truth, count(*) AS n, count(*) FILTER (prediction = truth) AS c, count(*) FILTER (la <> truth AND prediction = truth) AS fx, count(*) FILTER (la = truth AND prediction <> truth) AS br FROM o GROUP BY 1, 2)
    SELECT rule, round(sum(c) / sum(n), 6) AS raw_accuracy, round(avg(c / n), 6) AS macro_raw_recall, CAST(sum(fx) AS BIGINT) AS corrected, CAST(sum(br) AS BIGINT) AS damaged FROM k GROUP BY 1""",
    ("vec", "scores"),
)
def _(spark, sf):
    return rounded(C.rule_scores(scores(spark, sf), POLICY_RULES), 6, "raw_accuracy", "macro_raw_recall")


#: The rules of the two-stage search as rows; classes c0 to c9 are of different families, so the family's scale has no part.
STAGE_RULES = ", ".join(
    f"({i}, '{r['method']}', {r['side_weight']}::DOUBLE, {r['guard_strength'] if r['method'] == 'evidence_adaptive' else 0.0}::DOUBLE)" for i, r in enumerate(C.two_stage_rules())
)
STAGE_SQL = f"""{RULE_SQL}, pq AS (SELECT pr.*, topology FROM pr JOIN (SELECT DISTINCT id, topology FROM scores) USING (id)), r2(rule, method, w, g) AS (VALUES {STAGE_RULES}),
  e2 AS (SELECT *, greatest(0, least(0.95, greatest(0, least(0.95, w * quality)) * (1 - g * greatest(0, least(1, topology))))) AS e FROM pq CROSS JOIN r2),
  f2 AS (SELECT *, CASE WHEN method = 'probability_sum' THEN (1-e)*ta + e*xa ELSE 1 / (1 + exp((1-e)*(ln(tb)-ln(ta)) + e*(ln(xb)-ln(xa)))) END AS p FROM e2),
  o2 AS (SELECT rule, w, id, truth, la, CASE WHEN p > 1 - p THEN la ELSE lb END AS prediction, greatest(p, 1-p) AS probability, abs(2*p-1) AS margin FROM f2)"""


def limits_sql(rows: str, probabilities: list[float], margins: list[float]) -> str:
    """The best limits over a table of fused rows."""
    return f"""g2 AS (SELECT tp, tm FROM (SELECT unnest({list(probabilities)}::DOUBLE[]) AS tp), (SELECT unnest({list(margins)}::DOUBLE[]) AS tm)),
     k2 AS (SELECT rule, tp, tm, truth, count(*) AS n, count(*) FILTER (probability >= tp AND margin >= tm) AS a, count(*) FILTER (probability >= tp AND margin >= tm AND prediction = truth) AS c FROM {rows} CROSS JOIN g2 GROUP BY 1, 2, 3, 4),
     s2 AS (SELECT rule, tp, tm, CAST(sum(a) - sum(c) AS BIGINT) AS wrong_accepts, avg(c / n) AS macro_recall, sum(a) / sum(n) AS coverage FROM k2 GROUP BY 1, 2, 3)
    SELECT rule, round(tp, 6) AS fused_probability, round(tm, 6) AS fused_margin, wrong_accepts, round(macro_recall, 6) AS macro_recall, round(coverage, 6) AS coverage FROM s2
    ORDER BY s2.wrong_accepts <> 0, s2.wrong_accepts, round(s2.macro_recall, 9) DESC, round(s2.coverage, 9) DESC, rule, tp, tm LIMIT 1"""


@query(
    "ml13_fit_policy_two_stage",
    f"""WITH {STAGE_SQL}, a2 AS (SELECT rule, any_value(w) AS w, truth, count(*) AS n, count(*) FILTER (prediction = truth) AS c, count(*) FILTER (la <> truth AND prediction = truth) AS fx, count(*) FILTER (la = truth AND prediction <> truth) AS br FROM o2 GROUP BY 1, 3),
     b2 AS (SELECT rule FROM a2 GROUP BY 1 ORDER BY round(sum(c) / sum(n), 9) DESC, round(avg(c / n), 9) DESC, sum(br) - sum(fx), any_value(w), rule LIMIT 1), o3 AS (SELECT o2.* FROM o2 JOIN b2 USING (rule)),
     {limits_sql("o3", C.linear_grid(0.50, 0.03, 12), C.linear_grid(0.0, 0.03, 9))}""",
    ("vec", "scores"),
)
def _(spark, sf):
    out = C.fit_policy_two_stage(scores(spark, sf), min_coverage=0.0)
    return rounded(out, 6, "fused_probability", "fused_margin", "macro_recall", "coverage")


@query("ml13_fit_policy_strict", f"WITH {STAGE_SQL}, {limits_sql('o2', [0.72, 0.78, 0.84, 0.90, 0.96, 0.999], [0.12, 0.18, 0.24])}", ("vec", "scores"))
def _(spark, sf):
    out = C.fit_policy_two_stage(scores(spark, sf), strict=True)
    return rounded(out, 6, "fused_probability", "fused_margin", "macro_recall", "coverage")


@query("ml14_fit_top2_logistic")
def _(spark, sf):
    weights, bias = C.fit_top2_logistic(scores(spark, sf))
    entries = F.array(*[F.struct(F.lit(f"w{i}").alias("name"), F.lit(w).alias("value")) for i, w in enumerate(weights)], F.struct(F.lit("bias").alias("name"), F.lit(bias).alias("value")))
    return spark.range(1).select(F.explode(entries).alias("e")).select("e.name", F.round("e.value", 3).alias("value"))


@query("ml15_forest_scores")
def _(spark, sf):
    v = vectors(spark, sf)
    model = C.fit_forest(v, trees=20, depth=6, seed=3)
    return C.forest_scores(model, v).select("id", "label", "best.label", F.round("best.probability", 6).alias("probability")).toDF("id", "truth", "prediction", "probability")


@query(
    "ml16_model_comparison",
    """WITH n AS (SELECT id, label, cls, p / sum(p) OVER (PARTITION BY id) AS p, s / sum(s) OVER (PARTITION BY id) AS s FROM scores), l AS (SELECT id, label, 'top' AS model, cls, p FROM n UNION ALL SELECT id, label, 'side', cls, s FROM n),
     r AS (SELECT *, row_number() OVER w AS k, lead(p) OVER w AS nx FROM l WINDOW w AS (PARTITION BY model, id ORDER BY p DESC, cls)), b AS (SELECT * FROM r WHERE k = 1), g(gate, gap) AS (VALUES (0.0::DOUBLE, 0.0::DOUBLE), (0.25, 0.05), (0.35, 0.1))
    SELECT model, gate, count(*) AS total, count(*) FILTER (p >= gate AND p - nx >= gap AND cls = label) AS correct, count(*) FILTER (NOT (p >= gate AND p - nx >= gap)) AS unknown FROM b CROSS JOIN g GROUP BY 1, 2""",
    ("vec", "scores"),
)
def _(spark, sf):
    s = scores(spark, sf)
    long = None
    for model in ("top", "side"):
        best = s.select("id", F.col("label").alias("truth"), SC.top2_margin(SC.normalize_scores(F.col(model))).alias("b")).select(
            F.lit(model).alias("model"), "truth", F.col("b.label").alias("prediction"), "b.probability", "b.margin"
        )
        long = best if long is None else long.unionByName(best)
    return C.gated_models(long, [(0.0, 0.0), (0.25, 0.05), (0.35, 0.1)])


@query("ml17_weight_sweep", f"WITH {leave_out_sql('id', WEIGHTINGS)} {RANK_SQL.format(limit=0.95)}", "vec")
def _(spark, sf):
    out = N.leave_out_eval(vectors(spark, sf), by="id", weights=WEIGHTINGS)
    return C.rank_weightings(out.withColumn("decision", F.when(F.col("distance") > 0.95, "unknown").otherwise(F.col("label"))))


CACHE_SQL = """sp AS (SELECT sample, sha256(content) AS source_hash FROM docs), ca AS (SELECT sample, CASE WHEN n_chars % 13 = 0 THEN 'stale' ELSE sha256(content) END AS source_hash, CASE WHEN n_chars % 7 = 0 THEN 'v6' ELSE 'v7' END AS contract FROM docs WHERE n_chars % 5 <> 0)"""


def _cache(spark, sf):
    c = F.col
    d = captures(spark, sf)
    hashed = labels.content_hash(c("content"))
    cache = d.filter("n_chars % 5 <> 0").select(
        "sample", F.when(c("n_chars") % 13 == 0, "stale").otherwise(hashed).alias("source_hash"),
        F.when(c("n_chars") % 7 == 0, "v6").otherwise("v7").alias("contract"), F.array(c("n_chars").cast("double")).alias("features"),
    )
    return C.feature_cache(d.select("sample", hashed.alias("source_hash")), cache, contract="v7")


@query("ml18_feature_cache_reused", f"WITH {CACHE_SQL} SELECT sample FROM sp JOIN ca USING (sample, source_hash) WHERE contract = 'v7'", "docs")
def _(spark, sf):
    return _cache(spark, sf)[0].select("sample")


@query("ml18_feature_cache_missing", f"WITH {CACHE_SQL} SELECT sample FROM sp WHERE (sample, source_hash) NOT IN (SELECT (sample, source_hash) FROM ca WHERE contract = 'v7')".replace("(sample, source_hash) NOT IN (SELECT (sample, source_hash) FROM ca WHERE contract = 'v7')", "NOT EXISTS (SELECT 1 FROM ca WHERE ca.sample = sp.sample AND ca.source_hash = sp.source_hash AND contract = 'v7')"), "docs")
def _(spark, sf):
    return _cache(spark, sf)[1].select("sample")


@query(
    "ml19_bundle_manifest",
    f"""WITH {HALF_SQL}, k AS (SELECT sha256, count(DISTINCT split) AS k FROM hf GROUP BY 1)
    SELECT split, count(*) AS rows, count(DISTINCT sha256) AS contents, CAST(sum(CAST('0x' || substr(sha256, 1, 12) AS BIGINT)) AS VARCHAR) AS fingerprint, count(*) FILTER (k > 1) AS overlapping, count(*) FILTER (k > 1) = 0 AS clean FROM hf JOIN k USING (sha256) GROUP BY 1""",
    "docs",
)
def _(spark, sf):
    return C.bundle_manifest(halves(spark, sf))


@query(
    "ml20_perturbation_sensitivity",
    """WITH q AS (SELECT frame_id, object_id, x AS u, y AS v, 300 + price / 1013 AS z FROM det), s AS (SELECT *, z * 0.5 / 600 AS a, z * 0.5 / 610 AS b FROM q),
     d AS (SELECT *, sqrt(pow((u - 320) / 600 * 0.5, 2) + pow((v - 240) / 610 * 0.5, 2) + 0.25) AS c FROM s)
    SELECT object_id || '@' || frame_id AS key, round(greatest(a, b, c), 6) AS maximum_shift, round(a + b + c - greatest(a, b, c) - least(a, b, c), 6) AS median_shift FROM d""",
    "det",
)
def _(spark, sf):
    c = F.col
    rows = detections(spark, sf).select(
        F.concat_ws("@", "object_id", c("frame_id").cast("string")).alias("key"), c("x").alias("u"), c("y").alias("v"), (300 + c("price") / 1013).alias("z")
    )
    out = C.perturbation_sensitivity(
        rows, "key", ["u", "v", "z"], lambda p: G.backproject(p["u"], p["v"], p["z"], 600.0, 610.0, 320.0, 240.0)
    )
    return rounded(out, 6, "maximum_shift", "median_shift")
