"""Score fusion, flags, summaries and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BAD_TIERS = ("gold_bad", "silver_bad", "flagged_borderline_or_disagreement")


def fuse(df: DataFrame, rf: str = "p_rf", cnn: str = "p_cnn", rf_weight: float = 0.5, cnn_weight: float = 0.5) -> DataFrame:
    """p_avg, tier (the first that applies), final_label and three flags."""
    a, b = F.col(rf), F.col(cnn)
    tier = (
        F.when((a >= 0.7) & (b >= 0.6), "gold_good").when((a < 0.2) & (b < 0.2), "gold_bad").when((a >= 0.5) & (b >= 0.5), "silver_good").when((a >= 0.4) & (b >= 0.9), "flagged_cnn_rescue")
        .when((a < 0.4) & (b < 0.4), "silver_bad").when(a >= 0.5, "flagged_rf_only_good").otherwise("flagged_borderline_or_disagreement")
    )
    return df.withColumn("p_avg", (rf_weight * a + cnn_weight * b) / (rf_weight + cnn_weight)).withColumn("tier", F.when(a.isNotNull() & b.isNotNull(), tier)).withColumns({
        "final_label": F.when(F.col("tier").isin(*BAD_TIERS), "bad").when(F.col("tier").isNotNull(), "good"),
        "model_disagreement": (a - 0.5) * (b - 0.5) < 0, "near_threshold": (F.abs(a - 0.5) < 0.1) | (F.abs(b - 0.5) < 0.1), "score_gap": F.abs(a - b) > 0.4,
    })


def flagged(df: DataFrame) -> DataFrame:
    """is_flagged: a flagged tier or any flag."""
    return df.withColumn("is_flagged", F.coalesce(F.startswith("tier", F.lit("flagged_")), F.lit(False)) | F.coalesce(F.col("model_disagreement"), F.lit(False)) | F.coalesce(F.col("near_threshold"), F.lit(False)) | F.coalesce(F.col("score_gap"), F.lit(False)))


def summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, fractions, means and medians of a run's rows by shot, and with a second key also by it
    (one pass over grouping sets; the second key is NULL in the shot's own row). Rows are scored if
    nothing rejected them; ``selected`` marks what remains after near-duplicates went."""
    scored = (F.col("rejection_reason") == "") & (F.col("gap_region") != "eae_like")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False))).cast("long")
    aggs = [
        F.count("*").alias("n_total_files"), n(F.col("rejection_reason") == "mode_load_failed").alias("n_failed_load"), n(F.col("rejection_reason").isin("invalid_metadata", "ntor-N_mismatch", "too_small_nhar", "nonfinite_mode_data", "invalid_weights")).alias("n_nan_or_invalid"),
        *(n(F.col("gap_region") == g).alias(f"n_{g}") for g in ("tae_like", "mixed", "eae_like")), n(scored).alias("n_scored"), *(n(scored & (F.col("tier") == t)).alias(f"n_{t}") for t in ("gold_good", "silver_good")),
        n(scored & (F.col("final_label") == "good")).alias("n_good_before_clustering"), n(scored & F.col("selected")).alias("n_final_good"), n(scored & (F.col("final_label") == "bad")).alias("n_final_bad"), n(scored & F.col("is_flagged")).alias("n_flagged"),
        n(scored & ~F.col("model_disagreement")).alias("n_agree"), *(F.avg(F.when(scored, F.col(p))).alias(f"mean_{p}") for p in ("p_rf", "p_cnn")), *(F.median(F.when(scored, F.col(p))).alias(f"median_{p}") for p in ("p_rf", "p_cnn")),
    ]
    cols = [F.col(k) for k in keys]
    out = df.groupBy(*cols).agg(*aggs) if len(keys) == 1 else df.groupingSets([[cols[0]], cols], *cols).agg(*aggs)
    share = lambda a: F.try_divide(F.col(a).cast("double"), F.col("n_scored").cast("double"))
    return out.withColumns({"fraction_good": share("n_final_good"), "fraction_flagged": share("n_flagged"), "rf_cnn_agreement_fraction": share("n_agree"), "mode_clusters_removed": F.col("n_good_before_clustering") - F.col("n_final_good")}).drop("n_agree")


def vertical(df: DataFrame, values: list[str]) -> DataFrame:
    """Two columns, name and value, in the order of values."""
    return df.select([F.col(v).cast("double").alias(v) for v in values]).unpivot([], values, "name", "value")


def confusion(df: DataFrame, truth: str, predicted: str, keys: list[str] | None = None) -> DataFrame:
    """Counts of the four cells; 1 is good."""
    t, p = F.col(truth), F.col(predicted)
    cells = {"tn_bad": (t == 0) & (p == 0), "fp_bad_as_good": (t == 0) & (p == 1), "fn_good_as_bad": (t == 1) & (p == 0), "tp_good": (t == 1) & (p == 1)}
    return df.groupBy(*(keys or [])).agg(F.count("*").alias("n_matched"), *(F.count_if(c).cast("long").alias(k) for k, c in cells.items()))


def metrics(df: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from the cells; NULL where a denominator is 0."""
    c = {k: F.col(k).cast("double") for k in ("tn_bad", "fp_bad_as_good", "fn_good_as_bad", "tp_good")}
    tp, fp, fn, tn = c["tp_good"], c["fp_bad_as_good"], c["fn_good_as_bad"], c["tn_bad"]
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return df.withColumns({"accuracy": F.try_divide(tp + tn, tp + tn + fp + fn), "precision_good": p, "recall_good": r, "f1_good": F.when(p + r > 0, F.try_divide(2 * p * r, p + r))})


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row a class, then macro and weighted averages; zero division gives 0. Both classes always."""
    cells = confusion(df, truth, predicted)
    one = lambda label, tp, fp, fn: F.struct(F.lit(label).alias("class"), F.coalesce(F.try_divide(F.col(tp).cast("double"), F.col(tp) + F.col(fp)), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(F.col(tp).cast("double"), F.col(tp) + F.col(fn)), F.lit(0.0)).alias("recall"), (F.col(tp) + F.col(fn)).alias("support"))
    rows = cells.select(F.inline(F.array(one("bad", "tn_bad", "fn_good_as_bad", "fp_bad_as_good"), one("good", "tp_good", "fp_bad_as_good", "fn_good_as_bad"))))
    rows = rows.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    n = F.sum("support")
    weighed = lambda c: F.try_divide(F.sum(F.col(c) * F.col("support")), n.cast("double")).alias(c)
    macro = rows.agg(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), n.alias("support"), F.avg("f1").alias("f1"))
    whole = rows.agg(F.lit("weighted avg").alias("class"), weighed("precision"), weighed("recall"), n.alias("support"), weighed("f1"))
    return rows.unionByName(macro).unionByName(whole)


def health(df: DataFrame, score: str, truth: str, threshold: float = 0.5, class_fraction: float = 0.02, least_std: float = 1e-3) -> DataFrame:
    """Whether a model's predictions have collapsed, and how."""
    p, y = F.col(score), F.col(truth)
    d = df.where(p.isNotNull() & y.isNotNull()).agg(F.count("*").alias("n_samples"), F.count_if(y == 1).alias("n_true_good"), F.count_if(p >= threshold).alias("n_predicted_good"), F.avg(p).alias("prob_mean"), F.stddev_pop(p).alias("prob_std"), F.min(p).alias("prob_min"), F.max(p).alias("prob_max"))
    n, g, t = F.col("n_samples"), F.col("n_predicted_good"), F.col("n_true_good")
    d = d.withColumns({"predicted_good_fraction": F.try_divide(g.cast("double"), n), "true_good_fraction": F.try_divide(t.cast("double"), n)})
    pf, tf = F.col("predicted_good_fraction"), F.col("true_good_fraction")
    reasons = F.array(
        F.when((t > 0) & (g == 0), "zero predicted GOOD modes").when((tf >= class_fraction) & (pf < class_fraction), "near-all-bad predictions"),
        F.when((n - t > 0) & (g == n), "zero predicted BAD modes").when((1 - tf >= class_fraction) & (pf > 1 - class_fraction), "near-all-good predictions"),
        F.when(F.col("prob_std") < least_std, "near-constant probabilities"),
    )
    return d.withColumn("collapse_reasons", F.array_join(F.filter(reasons, lambda r: r.isNotNull()), ";"))


def threshold_sweep(df: DataFrame, score: str, truth: str, parts: int = 1024) -> DataFrame:
    """True and false positives at or above each distinct score, with precision and recall. Scores are
    counted first; the counts are cut into ``parts`` ranges of the score, whose sums are added up in one
    small window, and running sums are taken inside each range, so no task orders all scores."""
    rows = df.where(F.col(score).isNotNull() & F.col(truth).isNotNull())
    seen = rows.groupBy(F.col(score).cast("double").alias("level")).agg(F.count_if(F.col(truth) == 1).alias("good"), F.count("*").alias("n"))
    seen = seen.withColumn("part", F.least(F.greatest(F.floor(F.col("level") * parts), F.lit(0)), F.lit(parts)).cast("int"))
    sums = seen.groupBy("part").agg(F.sum("good").alias("g"), F.sum("n").alias("m"))  # at most parts + 1 rows
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("part").alias("of"), F.coalesce(F.sum("g").over(above), F.lit(0)).alias("g0"), F.coalesce(F.sum("m").over(above), F.lit(0)).alias("m0"), F.sum("g").over(Window.partitionBy()).alias("all_good"))
    down = Window.partitionBy("part").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    d = seen.select("level", "part", "good", F.sum("good").over(down).alias("g1"), F.sum("n").over(down).alias("m1")).join(F.broadcast(sums), F.col("part") == F.col("of"))
    d = d.select("level", "good", (F.col("g0") + F.col("g1")).alias("tp"), (F.col("m0") + F.col("m1")).alias("above"), "all_good")
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return d.select("level", "tp", (F.col("above") - F.col("tp")).alias("fp"), share("tp", "above").alias("precision"), share("tp", "all_good").alias("recall"), share("good", "all_good").alias("step"))


def average_precision(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Sum over distinct scores of precision times the step in recall."""
    return threshold_sweep(df, score, truth).agg(F.sum(F.col("step") * F.col("precision")).alias("average_precision"))


def histogram(df: DataFrame, score: str, bins: int = 16) -> DataFrame:
    return df.where(F.col(score).isNotNull()).groupBy(F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def histogram2d(df: DataFrame, x: str, y: str, bins: int = 30) -> DataFrame:
    cut = lambda c: F.least(F.floor(F.col(c) * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(cut(x).alias("x_bin"), cut(y).alias("y_bin")).agg(F.count("*").alias("n"))


def stable_counts(df: DataFrame, key: str, group: list[str]) -> DataFrame:
    """Counts of a column's values in each group as JSON with sorted keys."""
    c = df.groupBy(*group, key).agg(F.count("*").alias("n")).where(F.col(key) != "")
    item = F.concat(F.lit('"'), F.col(key), F.lit('":'), F.col("n").cast("string"))
    return c.groupBy(*group).agg(F.concat(F.lit("{"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), item.alias("v")))), lambda s: s["v"]), ","), F.lit("}")).alias("counts_json"))


def rule_summary(df: DataFrame, unmatched: DataFrame | None = None) -> DataFrame:
    """A rule run's counts by shot (n NULL) and by shot and n: decisions before and after overrides, override
    statuses, and as JSON with sorted keys the transitions of applied overrides that changed a decision and
    the primary reasons (of an invalid row its rejection reason). Rows without n count in the shot's row only.
    unmatched(shot, key): overrides that no mode has; they belong to no n, so their count is 0 there."""
    c = F.col
    n_col = c("ntor").cast("int")
    changed = F.coalesce((c("override_status") == "APPLIED") & ~c("rule_decision").eqNullSafe(c("final_decision")), F.lit(False))
    reason = F.when((F.coalesce("rejection_reason", F.lit("")) != ""), c("rejection_reason")).otherwise(F.coalesce("primary_reason", F.lit("")))
    d = df.withColumn("of_n", F.explode(F.when(n_col.isNotNull(), F.array(F.lit(None).cast("int"), n_col)).otherwise(F.array(F.lit(None).cast("int")))))
    d = d.withColumns({"changed": changed, "reason": reason, "transition": F.when(changed, F.concat(F.coalesce("rule_decision", F.lit("None")), F.lit("->"), "final_decision")).otherwise("")})
    n = lambda x: F.count_if(F.coalesce(x, F.lit(False))).cast("long")
    evaluated = c("rule_decision").isNotNull() & (F.coalesce("rejection_reason", F.lit("")) == "")
    status = {"n_overrides_applied": "APPLIED", "n_stale_overrides": "STALE_FINGERPRINT", "n_ambiguous_overrides": "AMBIGUOUS_OVERRIDE", "n_ineligible_overrides": "INELIGIBLE_DECISION"}
    out = d.groupBy("shot", "of_n").agg(
        F.count("*").alias("n_total_files"), n(c("final_decision") == "INVALID").alias("n_invalid"), *(n(c("gap_region") == g).alias(f"n_{g}") for g in ("tae_like", "mixed", "eae_like")), n(evaluated).alias("n_rule_evaluated"),
        *(n(evaluated & (c("rule_decision") == x)).alias(f"n_preliminary_{x.lower()}") for x in ("BAD", "REVIEW", "GOOD", "INVALID")), *(n(c("final_decision") == x).alias(f"n_final_{x.lower()}") for x in ("BAD", "REVIEW")),
        n(c("final_decision") == "GOOD").alias("n_final_good_before_clustering"), n(c("selected")).alias("n_final_good"), *(n(c("override_status") == v).alias(k) for k, v in status.items()), n(c("changed")).alias("n_decisions_changed"),
    ).withColumn("n_good_removed_as_duplicates", c("n_final_good_before_clustering") - c("n_final_good"))
    for key, name in (("transition", "transition_counts_json"), ("reason", "primary_reason_counts_json")):
        counts = stable_counts(d, key, ["shot", "of_n"]).select(c("shot").alias("c_shot"), c("of_n").alias("c_n"), c("counts_json").alias(name))
        out = out.join(counts, c("shot").eqNullSafe(c("c_shot")) & c("of_n").eqNullSafe(c("c_n")), "left").drop("c_shot", "c_n").withColumn(name, F.coalesce(name, F.lit("{}")))
    out = out.withColumnRenamed("of_n", "n")
    if unmatched is None:
        return out.withColumn("n_unmatched_overrides", F.lit(0).cast("long"))
    lost = unmatched.groupBy(c("shot").alias("u_shot")).agg(F.count("*").alias("u"))
    return out.join(lost, c("shot") == c("u_shot"), "left").withColumn("n_unmatched_overrides", F.when(c("n").isNull(), F.coalesce("u", F.lit(0))).otherwise(0).cast("long")).drop("u_shot", "u")


def stratified_split(df: DataFrame, label: str, key: str, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """is_test: max(1, int(n * fraction)) rows of each label, by a seeded hash order. The order is cut into
    2^16 parts: whole parts are taken by running counts, and rows are ranked only within their part, so a
    label with most of the rows is not ordered in one place."""
    cols = df.columns
    d = df.withColumn("split__hash", F.xxhash64(F.lit(seed), key)).withColumn("split__part", F.shiftrightunsigned("split__hash", 48))
    counts = d.groupBy(F.col(label).alias("split__label"), F.col("split__part").alias("p")).agg(F.count("*").alias("n"))
    own = Window.partitionBy("split__label")
    sized = counts.withColumn("size", F.greatest(F.lit(1), F.floor(F.sum("n").over(own) * fraction))).withColumn("upto", F.sum("n").over(own.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)))
    edge = sized.where(F.col("upto") >= F.col("size")).groupBy("split__label").agg(F.min_by(F.struct("p", (F.col("size") - F.col("upto") + F.col("n")).alias("left")), "p").alias("edge"))
    ranked = d.withColumn("split__rank", F.row_number().over(Window.partitionBy(label, "split__part").orderBy("split__hash", key)))
    out = ranked.join(edge, F.col(label).eqNullSafe(F.col("split__label")))
    test = (F.col("split__part") < F.col("edge.p")) | ((F.col("split__part") == F.col("edge.p")) & (F.col("split__rank") <= F.col("edge.left")))
    return out.withColumn("is_test", test).select(*cols, "is_test")


def zscore_top(df: DataFrame, features: list[str], key: str, k: int = 3) -> DataFrame:
    """Each row's k features farthest from the mean in population standard deviations (a row array, no
    window): name and z, largest first."""
    stats = df.agg(*(F.avg(f).alias(f"m_{f}") for f in features), *(F.stddev_pop(f).alias(f"s_{f}") for f in features))
    d = df.crossJoin(F.broadcast(stats))  # one row of statistics
    z = F.array(*(F.struct(F.abs(F.try_divide(F.col(f) - F.col(f"m_{f}"), F.col(f"s_{f}"))).alias("size"), F.lit(f).alias("feature"), F.try_divide(F.col(f) - F.col(f"m_{f}"), F.col(f"s_{f}")).alias("z")) for f in features))
    return d.select(key, F.posexplode(F.slice(F.reverse(F.array_sort(z)), 1, k)).alias("rank", "x")).select(key, "rank", "x.feature", "x.z")


def rule_matrix(df: DataFrame, decision: str, truth: str) -> DataFrame:
    """Decisions against labels: agreement (BAD is bad, REVIEW or GOOD is good), share of bad found,
    share of good kept, and share of good among what is left."""
    bad, y = F.col(decision) == "BAD", F.col(truth)
    d = df.where(y.isNotNull() & F.col(decision).isin("GOOD", "BAD", "REVIEW")).agg(F.count("*").alias("n"), F.count_if(bad & (y == 0)).alias("bad_found"), F.count_if(~bad & (y == 1)).alias("good_kept"), F.count_if(y == 0).alias("n_bad"), F.count_if(y == 1).alias("n_good"), F.count_if(~bad).alias("n_left"))
    over = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return d.withColumns({"agreement": F.try_divide((F.col("bad_found") + F.col("good_kept")).cast("double"), F.col("n")), "bad_recall": over("bad_found", "n_bad"), "good_retention": over("good_kept", "n_good"), "good_precision": over("good_kept", "n_left")})
