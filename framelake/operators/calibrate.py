"""Fitting temperatures, thresholds and fusion policies; model comparison and feature caches.

Parameter grids are literal arrays exploded next to each row and collapsed by a partial aggregate before
anything is shuffled. Threshold grids are counted once per cell and summed over the grid afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import scores as S
from framelake.plans.scan import running
from framelake.session import truncate_lineage


def geometric_grid(low: float, high: float, steps: int) -> list[float]:
    return [low * (high / low) ** (i / (steps - 1)) for i in range(steps)]


def linear_grid(start: float, step: float, count: int) -> list[float]:
    return [start + i * step for i in range(count)]


def fit_temperature(df: DataFrame, scores: str, label: str, *, low: float = 0.2, high: float = 5.0, steps: int = 161) -> DataFrame:
    """Temperature with the smallest mean negative log likelihood: temperature, nll, samples."""
    grid = F.array(*[F.lit(t) for t in geometric_grid(low, high, steps)])
    usable = df.filter(F.size(scores) > 0).select(S.normalize_scores(F.col(scores)).alias("s"), F.col(label).alias("y"))
    logs = usable.select(
        F.transform(F.map_values("s"), lambda p: F.ln(F.greatest(p, F.lit(1e-9)))).alias("l"),
        F.ln(F.greatest(F.try_element_at("s", F.col("y")), F.lit(1e-9))).alias("own"),
        F.explode(grid).alias("temperature"),
    )
    heat = F.col("temperature")
    total = F.aggregate("l", F.lit(0.0), lambda a, x: a + F.exp(x / heat))
    own = F.greatest(F.coalesce(F.exp(F.col("own") / heat) / total, F.lit(0.0)), F.lit(1e-9))
    losses = logs.groupBy("temperature").agg(F.avg(-F.ln(own)).alias("nll"), F.count(F.lit(1)).alias("samples"))
    return losses.agg(F.min_by(F.struct("temperature", "nll", "samples"), F.struct("nll", "temperature")).alias("b")).select("b.*")


def _index(value: Column, grid: Sequence[float], upward: bool) -> Column:
    """First grid place at or above the value, or last at or below it (-1 / length when there is none)."""
    items = F.array(*[F.lit(float(g)) for g in grid])
    if upward:
        return F.size(F.filter(items, lambda g: g < value))
    return F.size(F.filter(items, lambda g: g <= value)) - 1


def threshold_candidates(
    df: DataFrame, rises: Sequence[float], falls: Sequence[float], keys: Sequence[str] = (), *, rising: str, falling: str
) -> DataFrame:
    """Metrics of every pair of limits: rows with ``rising`` <= first limit and ``falling`` >= second.

    Needs truth and prediction. All rows are counted into the grid cell at which they become accepted, per
    class; running sums over the cells then give each candidate, so the cost is rows + cells.
    """
    keys = list(keys)
    cells = df.select(
        *keys, "truth", (F.col("prediction") == F.col("truth")).alias("right"),
        _index(F.col(rising), rises, True).alias("i"), _index(F.col(falling), falls, False).alias("j"),
    ).groupBy(*keys, "truth", "i", "j").agg(F.count(F.lit(1)).alias("n"), F.count_if("right").alias("c"))
    classes = cells.groupBy(*keys, "truth").agg(F.sum("n").alias("rows"))
    sizes = range(len(rises)), range(len(falls))
    frame = classes.withColumn("i", F.explode(F.array(*map(F.lit, sizes[0])))).withColumn("j", F.explode(F.array(*map(F.lit, sizes[1]))))
    full = frame.join(cells, [*keys, "truth", "i", "j"], "left").na.fill(0, ["n", "c"])
    up = Window.partitionBy(*keys, "truth", "j").orderBy("i")
    down = Window.partitionBy(*keys, "truth", "i").orderBy(F.desc("j"))
    summed = full.withColumns({x: F.sum(x).over(up) for x in "nc"}).withColumns({x: F.sum(x).over(down) for x in "nc"})
    metrics = summed.groupBy(*keys, "i", "j").agg(
        (F.sum("n") - F.sum("c")).alias("wrong_accepts"),
        F.avg(F.col("c") / F.col("rows")).alias("macro_recall"),
        (F.sum("n") / F.sum("rows")).alias("coverage"),
    )
    return metrics.select(
        *keys,
        F.get(F.array(*[F.lit(float(g)) for g in rises]), F.col("i")).alias("rising_limit"),
        F.get(F.array(*[F.lit(float(g)) for g in falls]), F.col("j")).alias("falling_limit"),
        "wrong_accepts", "macro_recall", "coverage",
    )


def _rank(*extra: Column) -> list[Column]:
    c = F.col
    return [c("wrong_accepts") != 0, c("wrong_accepts"), -F.round("macro_recall", 9), -F.round("coverage", 9), *extra]


def pick(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    return df.agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("b")).select("b.*")


def _cuts(values: DataFrame, column: str, parts: int = 200) -> Column:
    """A bucket that grows with the column: how many of up to ``parts`` approximate quantiles lie at or below it."""
    marks = values.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], 10_000).alias("m")).first()["m"]
    return _index(F.col(column), sorted(set(marks or [])), False)


def fit_observed_thresholds(df: DataFrame, *, grid_top: float = 0.4) -> DataFrame:
    """The best limits among all observed distances and margins, zero and margins up to ``grid_top``.

    A larger distance limit or a smaller margin limit accepts more, of right and of wrong rows. So with the fewest wrong rows
    that any limits accept, each distance d has one best margin: just above the margins of the other wrong rows up to d.
    A right row is then accepted from its own distance on and until the first of those wrong rows whose margin is not
    below its own. Its end comes from a scan by falling margin, the recalls from one by rising distance over +1 and -1
    at both ends, and the chosen limits are counted again on all rows. Both scans are bucketed, over one row a value.
    A null or infinite distance is never accepted; a null margin is zero.
    """
    c = F.col
    endless = F.lit(float("inf"))
    rows = truncate_lineage(df.select(
        "truth", F.coalesce(c("prediction") == c("truth"), F.lit(False)).alias("right"),
        F.coalesce(F.nullif(c("distance"), F.lit(float("nan"))), endless).alias("distance"), F.coalesce("margin", F.lit(0.0)).alias("margin"),
    ))
    sizes = rows.groupBy("truth").agg(F.count(F.lit(1)).alias("rows"))
    whole = sizes.agg(F.sum("rows").alias("all"), F.count(F.lit(1)).alias("classes"))
    # One row each: no margin limit is higher, and no wrong row above all limits lies nearer.
    top = rows.agg(F.greatest(F.max("margin"), F.lit(float(grid_top)), F.lit(0.0)).alias("top"))
    met = rows.join(F.broadcast(top), how="cross").withColumn("always", ~c("right") & (c("distance") <= 0) & (c("margin") >= c("top")))
    wall = met.agg(F.coalesce(F.min(F.when(~c("right") & ~c("always") & (c("margin") >= c("top")), c("distance"))), endless).alias("wall"))
    by_margin = met.where(~c("always")).groupBy("margin").agg(F.max(F.when(~c("right"), -c("distance"))).alias("near"))
    by_margin = by_margin.select("margin", "near", (-c("margin")).alias("falling"))
    until = running(by_margin.withColumn("part", -_cuts(by_margin, "margin")), [], "part", ["falling"], {"ends": ("max", c("near"))})
    until = until.select("margin", F.coalesce(-c("ends"), endless).alias("until"))
    weight = (F.lit(1).cast("decimal(38,20)") / (c("rows") * c("classes")).cast("decimal(20,0)")).cast("decimal(38,20)")
    spans = (
        rows.where(c("right") & (c("distance") < endless)).groupBy("truth", "distance", "margin").agg(F.count(F.lit(1)).alias("n"))
        .join(until, "margin").where(c("distance") < c("until"))
        .join(sizes, "truth").join(F.broadcast(whole), how="cross")
        .select("distance", "until", "n", (c("n") * weight).alias("share"))
    )
    moves = spans.select("distance", "n", "share").unionByName(
        spans.where(c("until") < endless).select(c("until").alias("distance"), (-c("n")).alias("n"), (-c("share")).alias("share"))
    )
    moves = moves.unionByName(rows.where("distance < double('inf')").select("distance").distinct().union(rows.sparkSession.range(1).select(F.lit(0.0))).select(
        "distance", F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,20)").alias("share")
    ))
    steps = moves.groupBy("distance").agg(F.sum("n").alias("n"), F.sum("share").cast("decimal(38,20)").alias("share"))
    summed = running(steps.withColumn("part", _cuts(steps, "distance")), [], "part", ["distance"], {"accepted": ("sum", c("n")), "recall": ("sum", c("share"))})
    best = pick(
        summed.join(F.broadcast(wall), how="cross").where(c("distance") < c("wall")),
        [-F.round(c("recall"), 9), -c("accepted"), c("distance")],
    ).select(c("distance").alias("distance_threshold"))
    chosen = met.join(F.broadcast(best), how="cross").withColumn("within", c("distance") <= c("distance_threshold"))
    above = chosen.agg(F.max(F.when(~c("right") & ~c("always") & c("within"), c("margin"))).alias("above"))
    judged = chosen.join(F.broadcast(above), how="cross").withColumn("taken", c("within") & F.coalesce(c("margin") > c("above"), F.lit(True)))
    of_class = judged.groupBy("truth").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("taken").alias("n"), F.count_if(c("taken") & c("right")).alias("c"),
        F.min(F.when(c("taken"), c("margin"))).alias("least"), F.first("top").alias("top"), F.first("distance_threshold").alias("distance_threshold"),
    )
    return of_class.agg(
        F.first("distance_threshold").alias("distance_threshold"), F.coalesce(F.min("least"), F.first("top")).alias("margin_threshold"),
        (F.sum("n") - F.sum("c")).alias("wrong_accepts"), F.avg(c("c") / c("rows")).alias("macro_recall"), (F.sum("n") / F.sum("rows")).alias("coverage"),
    ).where("distance_threshold IS NOT NULL")


def fit_thresholds(df: DataFrame, *, distances: Sequence[float] | None = None, margins: Sequence[float] | None = None) -> DataFrame:
    """Best distance and margin limit: no wrong accept, then fewest, recall, coverage, small distance, large margin.

    Without grids all observed values are tried.
    """
    if distances is None and margins is None:
        return fit_observed_thresholds(df)
    if distances is None or margins is None:
        raise ValueError("give both grids or none")
    found = threshold_candidates(df, list(distances), list(margins), rising="distance", falling="margin")
    best = pick(found, _rank(F.col("rising_limit"), -F.col("falling_limit")))
    return best.withColumnsRenamed({"rising_limit": "distance_threshold", "falling_limit": "margin_threshold"})


# Fusion policies -----------------------------------------------------------------------------------


def _candidate_pair(df: DataFrame, top_temperature: float, side_temperature: float) -> DataFrame:
    """The two best primary classes of each row with their shares in both views."""
    scaled = df.withColumns(
        {"__t": S.temperature_scale(F.col("top"), top_temperature), "__s": S.temperature_scale(F.col("side"), side_temperature)}
    ).withColumn("__o", S.ranked(F.col("__t")))
    a, b = F.get("__o", F.lit(0)), F.get("__o", F.lit(1))
    with_pair = scaled.withColumns(
        {
            "a": a["label"], "b": b["label"], "pa": a["p"], "pb": b["p"],
            "xa": F.coalesce(F.try_element_at("__s", a["label"]), F.lit(0.0)), "xb": F.coalesce(F.try_element_at("__s", b["label"]), F.lit(0.0)),
        }
    )
    c = F.col
    return with_pair.withColumns(
        {"ta": c("pa") / (c("pa") + c("pb")), "tb": c("pb") / (c("pa") + c("pb")), "sa": c("xa") / (c("xa") + c("xb")), "sb": c("xb") / (c("xa") + c("xb"))}
    )


def fused_by_rule(df: DataFrame, rules: Sequence[dict], *, top_temperature: float = 1.0, side_temperature: float = 1.0) -> DataFrame:
    """Winner, probability and margin of each row under every rule (rule number in ``rule``).

    A rule names its method and side_weight; one of ``top2_logistic`` brings its own ``weights`` and ``bias``.
    """
    c = F.col
    pairs = _candidate_pair(df, top_temperature, side_temperature)
    # What a rule leaves out.
    usual = {"same_family_scale": 0.35, "guard_strength": 0.65}
    entries = F.array(*[
        F.struct(
            F.lit(number).alias("rule"), F.lit(rule["method"]).alias("method"), F.lit(float(rule["side_weight"])).alias("side_weight"),
            *[F.lit(float(rule.get(n, v))).alias(n) for n, v in usual.items()],
        )
        for number, rule in enumerate(rules)
    ])
    columns = ["id", F.col("label").alias("truth"), "a", "b", "ta", "tb", "sa", "sb", "quality", "topology", (c("xa") + c("xb") > 0).alias("seen")]
    spread = pairs.select(*columns, F.explode(entries).alias("r"))
    p = F.lit(None).cast("double")
    learned = [(i, rule) for i, rule in enumerate(rules) if rule["method"] == "top2_logistic"]
    cases = [(c("r.method") == method, method, {}) for method in sorted({rule["method"] for rule in rules} - {"top2_logistic"})]
    cases += [(c("r.rule") == i, rule["method"], {"weights": rule["weights"], "bias": rule.get("bias", 0.0)}) for i, rule in learned]
    for applies, method, fitted in cases:
        fused = S.fuse_pair(
            c("ta"), c("tb"), c("sa"), c("sb"), c("a"), c("b"), c("quality"), topology=c("topology"), method=method,
            side_weight=c("r.side_weight"), same_family_scale=c("r.same_family_scale"), guard_strength=c("r.guard_strength"), **fitted,
        )
        p = F.when(applies, fused).otherwise(p)
    long = spread.select("id", "truth", "a", "b", c("r.rule").alias("rule"), F.when(c("seen"), p).otherwise(c("ta")).alias("p"))
    first = (c("p") > 1 - c("p")) | ((c("p") == 1 - c("p")) & (c("a") < c("b")))
    return long.select(
        "id", "rule", "truth", F.col("a").alias("top_prediction"), F.when(first, c("a")).otherwise(c("b")).alias("prediction"),
        F.greatest(c("p"), 1 - c("p")).alias("probability"), F.abs(2 * c("p") - 1).alias("margin"),
    )


def fit_policy(
    df: DataFrame, rules: Sequence[dict], *, top_temperature: float = 1.0, side_temperature: float = 1.0,
    probabilities: Sequence[float] | None = None, margins: Sequence[float] | None = None,
) -> DataFrame:
    """Best rule and limits over all rules at once (probability and margin both from below)."""
    falls = list(margins) if margins is not None else linear_grid(0.02, 0.03, 8)
    found = policy_candidates(df, rules, top_temperature, side_temperature, probabilities or linear_grid(0.55, 0.03, 11), falls)
    return pick(found, _rank(F.col("rule"), F.col("fused_probability"), F.col("fused_margin")))


def locked_rules(df: DataFrame, **heat: float) -> list[dict]:
    """The rules a policy is chosen from: sums and log products at three side weights, and a logistic one fitted to the rows."""
    weights, bias = fit_top2_logistic(df, **heat)
    rules = [{"method": m, "side_weight": w} for m in ("probability_sum", "log_product") for w in (0.15, 0.30, 0.45)]
    return [*rules, {"method": "top2_logistic", "side_weight": 0.30, "weights": weights, "bias": bias}]


def policy_candidates(df: DataFrame, rules: Sequence[dict], top_temperature: float, side_temperature: float, probabilities: Sequence[float], margins: Sequence[float]) -> DataFrame:
    fused = fused_by_rule(df, rules, top_temperature=top_temperature, side_temperature=side_temperature)
    # A lower limit on the probability is an upper one on its negative.
    flipped = fused.withColumn("doubt", -F.col("probability"))
    rises = sorted(-p for p in probabilities)
    found = threshold_candidates(flipped, rises, list(margins), ["rule"], rising="doubt", falling="margin")
    return found.withColumn("fused_probability", -F.col("rising_limit")).withColumnRenamed("falling_limit", "fused_margin").drop("rising_limit")


def rule_scores(df: DataFrame, rules: Sequence[dict], *, top_temperature: float = 1.0, side_temperature: float = 1.0) -> DataFrame:
    """Raw accuracy, macro recall, corrected and damaged rows of each rule."""
    fused = fused_by_rule(df, rules, top_temperature=top_temperature, side_temperature=side_temperature)
    was, now = F.col("top_prediction") == F.col("truth"), F.col("prediction") == F.col("truth")
    classes = fused.groupBy("rule", "truth").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(now).alias("c"), F.count_if(~was & now).alias("corrected"), F.count_if(was & ~now).alias("damaged")
    )
    return classes.groupBy("rule").agg(
        (F.sum("c") / F.sum("n")).alias("raw_accuracy"), F.avg(F.col("c") / F.col("n")).alias("macro_raw_recall"),
        F.sum("corrected").alias("corrected"), F.sum("damaged").alias("damaged"),
    )


def two_stage_rules() -> list[dict]:
    """The rules tried by the two-stage search."""
    out: list[dict] = []
    for method in ("probability_sum", "log_product", "evidence_adaptive"):
        adaptive = method == "evidence_adaptive"
        for weight in (0.15, 0.25, 0.35, 0.45, 0.60):
            for scale in (0.25, 0.35, 0.50) if adaptive else (0.35,):
                for guard in (0.35, 0.65, 0.85) if adaptive else (0.65,):
                    out.append({"method": method, "side_weight": weight, "same_family_scale": scale, "guard_strength": guard})
    return out


def fit_policy_two_stage(df: DataFrame, *, top_temperature: float = 1.0, side_temperature: float = 1.0, strict: bool = False, min_coverage: float = 0.15) -> DataFrame:
    """Score rule by accuracy first and limits second, or both jointly (strict)."""
    rules = two_stage_rules()
    heat = {"top_temperature": top_temperature, "side_temperature": side_temperature}
    if strict:
        found = policy_candidates(df, rules, top_temperature, side_temperature, (0.72, 0.78, 0.84, 0.90, 0.96, 0.999), (0.12, 0.18, 0.24))
        return pick(found, _rank(F.col("rule"), F.col("fused_probability"), F.col("fused_margin")))
    weights = F.array(*[F.lit(r["side_weight"]) for r in rules])
    c = F.col
    chosen = pick(
        rule_scores(df, rules, **heat),
        [-F.round("raw_accuracy", 9), -F.round("macro_raw_recall", 9), c("damaged") - c("corrected"), F.get(weights, c("rule")), c("rule")],
    ).first()
    found = policy_candidates(df, [rules[chosen["rule"]]], top_temperature, side_temperature, linear_grid(0.50, 0.03, 12), linear_grid(0.0, 0.03, 9))
    best = pick(found.filter(c("coverage") >= min_coverage), _rank(c("fused_probability"), c("fused_margin")))
    return best.withColumn("rule", F.lit(chosen["rule"]))


def fit_top2_logistic(df: DataFrame, *, top_temperature: float = 1.0, side_temperature: float = 1.0, l2: float = 0.1) -> tuple[list[float], float]:
    """Weights and bias of the five pair features; a fixed start where there is nothing to learn from."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    c = F.col
    pairs = _candidate_pair(df, top_temperature, side_temperature).filter(c("label").isin(c("a"), c("b")))
    features = S.top2_features(c("pa"), c("pb"), c("xa"), c("xb"), c("quality"))
    rows = pairs.select(array_to_vector(F.array(*features)).alias("features"), (c("label") == c("a")).cast("double").alias("label"))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("k")).first()
    if seen["n"] < 4 or seen["k"] < 2:
        return [1.0, 0.30, 0.0, 0.0, 0.0], 0.0
    model = LogisticRegression(regParam=l2, elasticNetParam=0.0, standardization=False, maxIter=200).fit(rows)
    return [float(w) for w in model.coefficients], float(model.intercept)


def fit_forest(df: DataFrame, *, trees: int = 160, depth: int = 12, seed: int = 0):
    """Random forest over labelled vectors with label names kept: returns a fitted pipeline model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer

    indexer = StringIndexer(inputCol="label", outputCol="__y", stringOrderType="alphabetAsc")
    forest = RandomForestClassifier(labelCol="__y", featuresCol="__f", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[indexer, forest]).fit(with_features(df))


def with_features(df: DataFrame, vector: str = "v") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("__f", array_to_vector(F.col(vector)))


def forest_scores(model, df: DataFrame) -> DataFrame:
    """Vote shares per class as a map and the winning label."""
    from pyspark.ml.functions import vector_to_array

    names = model.stages[0].labels
    scored = model.stages[1].transform(with_features(df))
    keys = F.array(*map(F.lit, names))
    shares = F.map_from_arrays(keys, vector_to_array("probability"))
    return scored.select("id", "label", shares.alias("scores")).withColumn("best", S.top2_margin(F.col("scores")))


# Comparison, caches and bundles ------------------------------------------------------------------------


def gated_models(df: DataFrame, gates: Sequence[tuple[float, float]]) -> DataFrame:
    """Correct, unknown and total per model and gate (columns model, truth, prediction, probability, margin)."""
    entries = F.array(*[F.struct(F.lit(float(g)).alias("gate"), F.lit(float(m)).alias("gap")) for g, m in gates])
    long = df.withColumn("g", F.explode(entries))
    kept = (F.col("probability") >= F.col("g.gate")) & (F.col("margin") >= F.col("g.gap"))
    return long.groupBy("model", F.col("g.gate").alias("gate")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(kept & (F.col("prediction") == F.col("truth"))).alias("correct"), F.count_if(~kept).alias("unknown")
    )


def rank_weightings(results: DataFrame) -> DataFrame:
    """Correct minus twice the wrong answers per weighting (columns weighting, truth, decision)."""
    right = F.col("decision") == F.col("truth")
    unknown = F.col("decision") == "unknown"
    out = results.groupBy("weighting").agg(
        F.count_if(right).alias("correct"), F.count_if(~right & ~unknown).alias("wrong"), F.count_if(unknown).alias("unknown")
    )
    return out.withColumn("score", F.col("correct") - 2 * F.col("wrong"))


def feature_cache(samples: DataFrame, cache: DataFrame, *, contract: str) -> tuple[DataFrame, DataFrame]:
    """Samples whose features can be reused, and those to extract (sample, source_hash).

    A cached row counts only for the same content and the same feature contract.
    """
    valid = cache.filter(F.col("contract") == contract).select("sample", "source_hash", "features")
    reused = samples.join(valid, ["sample", "source_hash"])
    return reused, samples.join(valid.select("sample", "source_hash"), ["sample", "source_hash"], "left_anti")


def bundle_manifest(df: DataFrame, *, item: str = "sample", split: str = "split", hash_column: str = "sha256") -> DataFrame:
    """Rows and content fingerprint per split, with the number of its contents met in another split.

    The fingerprint is a sum over hashes, so it does not depend on the order and merges across tasks.
    """
    shared = df.groupBy(hash_column).agg(F.count_distinct(split).alias("__k"))
    marked = df.join(shared, hash_column)
    # 48 bits a row: a bigint sum would overflow at some ten thousand rows.
    part = F.conv(F.substring(hash_column, 1, 12), 16, 10).cast("decimal(28,0)")
    return marked.groupBy(split).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(hash_column).alias("contents"),
        F.sum(part).cast("string").alias("fingerprint"), F.count_if(F.col("__k") > 1).alias("overlapping"),
    ).withColumn("clean", F.col("overlapping") == 0)


def perturbation_sensitivity(df: DataFrame, key: str, inputs: Sequence[str], outputs, *, step: float = 0.5) -> DataFrame:
    """Largest and median shift of an expression's result when each input moves by ± step.

    ``outputs`` maps a dict of input columns to a list of output columns.
    """
    base = outputs({n: F.col(n) for n in inputs})
    shifts = []
    for name in inputs:
        for sign in (-1.0, 1.0):
            moved = outputs({n: F.col(n) + sign * step if n == name else F.col(n) for n in inputs})
            total = sum(((m - b) ** 2 for m, b in zip(moved[1:], base[1:])), (moved[0] - base[0]) ** 2)
            shifts.append(F.sqrt(total))
    return df.withColumn("__s", F.array(*shifts)).select(
        key, F.array_max("__s").alias("maximum_shift"), S.array_median(F.col("__s")).alias("median_shift")
    )


