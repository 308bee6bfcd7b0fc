"""Queries of the engine over the driver's tables, and their SQL. Doubles are rounded to 6 places on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import adapters as D
from .functions import arrays as A
from .operators import dedup, gates, ml
from .operators import features as X
from .operators import relational as R
from .operators import scoring as S
from .plans import folds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: Column | str, name: str | None = None) -> Column:
    out = F.round(c if isinstance(c, Column) else F.col(c), 6)
    return out.alias(name or (c if isinstance(c, str) else "x"))


M, SC = f"WITH {D.MODES_SQL}", f"WITH {D.SCORES_SQL}"
RAD = """, rad AS (SELECT mode_id, any_value(ntor) AS ntor, any_value(omega) AS omega, sum(w) AS w_sum, sum(w * r) / (sum(w) + 1e-14) AS rad_loc FROM w GROUP BY mode_id),
radw AS (SELECT rad.*, (SELECT sqrt(sum(w.w * (w.r - rad.rad_loc) * (w.r - rad.rad_loc)) / (sum(w.w) + 1e-14)) FROM w WHERE w.mode_id = rad.mode_id) AS rad_width FROM rad)"""
GAP = """, gp AS (SELECT mode_id, any_value(ntor) AS ntor, sum(w) AS s, sum(w * (sqrt(high2) - omega)) AS sd, sum(w * (sqrt(high2) - omega) * (sqrt(high2) - omega)) AS sdd, coalesce(sum(w) FILTER (WHERE sqrt(high2) > omega), 0e0) AS sb FROM wc WHERE high2 IS NOT NULL GROUP BY mode_id),
gap AS (SELECT mode_id, ntor, CASE WHEN sqrt(sdd / s) <= 0 THEN 0e0 ELSE (sd / s) / sqrt(sdd / s) END AS signed_delta, sb / s AS fraction_below_upper2 FROM gp),
routed AS (SELECT *, CASE WHEN fraction_below_upper2 > 0.5e0 THEN 'tae_like' WHEN fraction_below_upper2 < 0.4e0 AND signed_delta < -0.1e0 THEN 'eae_like' ELSE 'mixed' END AS gap_region FROM gap)"""
FUSED = """, f AS (SELECT *, (p_rf + p_cnn) / 2e0 AS p_avg, CASE WHEN p_rf >= 0.7e0 AND p_cnn >= 0.6e0 THEN 'gold_good' WHEN p_rf < 0.2e0 AND p_cnn < 0.2e0 THEN 'gold_bad' WHEN p_rf >= 0.5e0 AND p_cnn >= 0.5e0 THEN 'silver_good'
  WHEN p_rf >= 0.4e0 AND p_cnn >= 0.9e0 THEN 'flagged_cnn_rescue' WHEN p_rf < 0.4e0 AND p_cnn < 0.4e0 THEN 'silver_bad' WHEN p_rf >= 0.5e0 THEN 'flagged_rf_only_good' ELSE 'flagged_borderline_or_disagreement' END AS tier,
  (p_rf - 0.5e0) * (p_cnn - 0.5e0) < 0 AS model_disagreement, abs(p_rf - 0.5e0) < 0.1e0 OR abs(p_cnn - 0.5e0) < 0.1e0 AS near_threshold, abs(p_rf - p_cnn) > 0.4e0 AS score_gap FROM s),
ff AS (SELECT *, CASE WHEN tier IN ('gold_bad', 'silver_bad', 'flagged_borderline_or_disagreement') THEN 'bad' ELSE 'good' END AS final_label, starts_with(tier, 'flagged_') OR model_disagreement OR near_threshold OR score_gap AS is_flagged FROM f)"""


# --- features ------------------------------------------------------------------------------------


@query(M + RAD + " SELECT mode_id, round(w_sum, 6) AS w_sum, round(rad_loc, 6) AS rad_loc, round(rad_width, 6) AS rad_width FROM radw")
def radial_features(spark, d):
    return X.radial(D.modes(spark, d)).select("mode_id", r6("w_sum"), r6("rad_loc"), r6("rad_width"))


@query(M + " SELECT mode_id, i::INTEGER AS i, round(w, 6) AS w FROM w")
def radial_energy(spark, d):
    return X.with_energy(D.modes(spark, d)).select("mode_id", F.posexplode("w").alias("i", "v")).select("mode_id", "i", r6(F.col("v"), "w"))


@query(M + GAP + " SELECT mode_id, round(signed_delta, 6) AS signed_delta, round(fraction_below_upper2, 6) AS fraction_below_upper2 FROM gap")
def upper_gap_scalars(spark, d):
    return X.upper_gap(D.joined(spark, d)).select("mode_id", r6("signed_delta"), r6("fraction_below_upper2"))


@query(M + GAP + " SELECT ntor, gap_region, count(*) AS n_modes, round(avg(signed_delta), 6) AS mean_signed_delta FROM routed GROUP BY 1, 2")
def gap_routing(spark, d):
    return X.route(X.upper_gap(D.joined(spark, d))).groupBy("ntor", "gap_region").agg(F.count("*").alias("n_modes"), r6(F.avg("signed_delta"), "mean_signed_delta"))


@query(M + """, v AS (SELECT mode_id, CASE WHEN mode_id % 3 = 0 THEN ntor ELSE 1 END AS k FROM m) SELECT mode_id, CASE WHEN mode_id % 19 = 1 THEN 'mode_load_failed' WHEN mode_id % 23 = 2 THEN 'invalid_metadata' WHEN mode_id % 13 = 0 THEN 'ntor-N_mismatch' WHEN 4 < 4 * k THEN 'too_small_nhar' WHEN mode_id % 17 = 0 THEN 'nonfinite_mode_data' WHEN mode_id % 29 = 3 THEN 'invalid_weights' ELSE '' END AS rejection_reason FROM v""")
def mode_validation(spark, d):
    i = F.col("mode_id")
    m = D.modes(spark, d).withColumn("ntor", F.when(i % 3 == 0, F.col("ntor")).otherwise(1)).withColumn("expected_n", F.when(i % 13 == 0, F.col("ntor") + 1).otherwise(F.col("ntor")))
    cell = lambda x, k: F.when((i % 17 == 0) & (k == 3), F.lit(float("nan"))).when(i % 29 == 3, F.lit(0.0)).otherwise(x)
    broken = m.withColumn("mode", F.when(i % 19 != 1, F.transform("mode", lambda row: F.transform(row, cell)))).withColumn("omega", F.when(i % 23 == 2, F.lit(float("inf"))).otherwise(F.col("omega")))
    return X.validate(broken).select("mode_id", "rejection_reason")


@query(M + """, c AS (SELECT *, abs(a) AS b, lead(a) OVER v - a AS d1, lead(a, 2) OVER v - 2 * lead(a) OVER v + a AS d2, abs(lead(a) OVER v) - abs(a) AS e1, abs(lead(a, 2) OVER v) - 2 * abs(lead(a) OVER v) + abs(a) AS e2 FROM cells WINDOW v AS (PARTITION BY mode_id, h ORDER BY i)),
 s AS (SELECT mode_id, avg(b) AS mean_amp, stddev_pop(b) AS std_amp, median(b) AS med, max(b) AS top, avg(abs(d1)) AS d1, max(abs(e1)) AS e1, avg(abs(d2)) AS d2, max(abs(e2)) AS e2 FROM c GROUP BY 1),
 pm AS (SELECT mode_id, h, max(b) AS t, avg(b) AS m FROM c GROUP BY 1, 2), p AS (SELECT mode_id, stddev_pop(t) AS st, max(m) AS mm, stddev_pop(m) AS sm FROM pm GROUP BY 1),
 k AS (SELECT c.mode_id, count(*) FILTER (WHERE b > med + 4 * std_amp) AS n FROM c JOIN s ON s.mode_id = c.mode_id GROUP BY 1)
 SELECT s.mode_id, round(mean_amp, 6) AS mean_amp, round(std_amp, 6) AS std_amp, round(top / (mean_amp + 1e-12), 6) AS max_to_mean, round(top / (med + 1e-12), 6) AS max_to_median, round(d1, 6) AS mean_abs_d1_mode, round(e1, 6) AS max_abs_d1_abs, round(d2, 6) AS mean_abs_d2_mode, round(e2, 6) AS max_abs_d2_abs,
 round(st, 6) AS std_per_m_max, round(mm, 6) AS max_per_m_mean, round(sm, 6) AS std_per_m_mean, round(n / 4e0, 6) AS spikes_per_m, round(n / 64e0, 6) AS frac_spikes FROM s JOIN p USING (mode_id) JOIN k USING (mode_id)""")
def structure_stats(spark, d):
    names = ("mean_amp", "std_amp", "max_to_mean", "max_to_median", "mean_abs_d1_mode", "max_abs_d1_abs", "mean_abs_d2_mode", "max_abs_d2_abs", "std_per_m_max", "max_per_m_mean", "std_per_m_mean", "spikes_per_m", "frac_spikes")
    return X.structure(D.modes(spark, d)).select("mode_id", *map(r6, names))


@query(M + " SELECT mode_id, h::INTEGER AS harmonic, round(t, 6) AS peak FROM (SELECT mode_id, h, max(abs(a)) AS t, row_number() OVER (PARTITION BY mode_id ORDER BY max(abs(a)) DESC, h) AS k FROM cells GROUP BY 1, 2) WHERE k <= 2")
def topk_harmonics(spark, d):
    tops = F.array_sort(F.transform("mode", lambda row, h: F.struct((-F.array_max(A.absolute(row))).alias("minus"), h.alias("h"))))
    return D.modes(spark, d).select("mode_id", F.inline(F.slice(tops, 1, 2))).select("mode_id", F.col("h").alias("harmonic"), r6(-F.col("minus"), "peak"))


@query(M + " SELECT mode_id, h::INTEGER AS h, i::INTEGER AS i, round(d, 6) AS d1 FROM (SELECT mode_id, h, i, lead(a) OVER (PARTITION BY mode_id, h ORDER BY i) - a AS d FROM cells) WHERE d IS NOT NULL")
def finite_differences(spark, d):
    rows = D.modes(spark, d).select("mode_id", F.posexplode("mode").alias("h", "row"))
    return rows.select("mode_id", "h", F.posexplode(A.differences(F.col("row"))).alias("i", "x")).select("mode_id", "h", "i", r6(F.col("x"), "d1"))


DIST = "CASE WHEN low2 IS NULL OR high2 IS NULL THEN NULL WHEN omega * omega < low2 THEN low2 - omega * omega WHEN omega * omega > high2 THEN omega * omega - high2 ELSE 0e0 END"


@query(M + f" SELECT mode_id, i::INTEGER AS i, round({DIST}, 6) AS dist2 FROM wc")
def band_distance(spark, d):
    dist = A.band_distance(F.col("omega") * F.col("omega"), F.col("low2"), F.col("high2"))
    return D.joined(spark, d).select("mode_id", F.posexplode(dist).alias("i", "x")).select("mode_id", "i", r6(F.col("x"), "dist2"))


@query(M + RAD + f""", dd AS (SELECT *, {DIST} AS dist2 FROM wc), mn AS (SELECT mode_id, min(dist2) AS delta2_min, sum(dist2 * w) AS dw, arg_min(r, struct_pack(a := dist2, b := i)) FILTER (WHERE dist2 IS NOT NULL) AS r_star FROM dd GROUP BY 1),
 nr AS (SELECT w.mode_id, sum(w) FILTER (WHERE abs(r - r_star) <= rad_width + 1e-12) AS near FROM w JOIN mn USING (mode_id) JOIN radw USING (mode_id) GROUP BY 1)
 SELECT mode_id, round(delta2_min, 6) AS delta2_min, round(dw / (w_sum + 1e-14), 6) AS delta2_eff, round(r_star, 6) AS r_star, round(abs(r_star - rad_loc) / (rad_width + 1e-12), 6) AS S, round(near / (w_sum + 1e-14), 6) AS W_star, CASE WHEN delta2_min = 0 THEN 1e0 ELSE 0e0 END AS has_intersection FROM mn JOIN radw USING (mode_id) JOIN nr USING (mode_id)""")
def continuum_scalars(spark, d):
    return X.continuum_scalars(D.joined(spark, d)).select("mode_id", r6("delta2_min"), r6("delta2_eff"), r6("r_star"), r6("S"), r6("W_star"), "has_intersection")


CROSS = """, top AS (SELECT mode_id, max(w) AS t FROM w GROUP BY 1), b AS (SELECT mode_id, 'low' AS boundary, i, r, w / (t + 1e-14) AS wp, omega * omega - low2 AS f, high2 IS NOT NULL AND low2 IS NOT NULL AS ok FROM wc JOIN top USING (mode_id) UNION ALL SELECT mode_id, 'high', i, r, w / (t + 1e-14), omega * omega - high2, high2 IS NOT NULL AND low2 IS NOT NULL FROM wc JOIN top USING (mode_id)),
n AS (SELECT *, lead(f) OVER v AS f2, lead(r) OVER v AS r2, lead(wp) OVER v AS wp2, lead(ok) OVER v AS ok2 FROM b WINDOW v AS (PARTITION BY mode_id, boundary ORDER BY i)),
cr AS (SELECT mode_id, boundary, r + (-f / (f2 - f)) * (r2 - r) AS r_cross, wp + (-f / (f2 - f)) * (wp2 - wp) AS W_peak FROM n WHERE ok AND ok2 AND f * f2 < 0
  UNION ALL SELECT mode_id, boundary, r, wp FROM n WHERE ok AND f = 0),
cs AS (SELECT *, W_peak * greatest(r_cross - 0.2e0, 0) * greatest(r_cross - 0.2e0, 0) AS shear_weighted FROM cr)"""


@query(M + CROSS + " SELECT mode_id, boundary, round(r_cross, 6) AS r_cross, round(W_peak, 6) AS W_peak, round(shear_weighted, 6) AS shear_weighted FROM cs")
def crossing_records(spark, d):
    # An inner inline would put a filter on the size of the crossings below, which computes them again.
    rows = X.crossing_records(D.joined(spark, d)).select("mode_id", F.inline_outer("crossings")).where("boundary is not null")
    return rows.select("mode_id", "boundary", r6("r_cross"), r6("W_peak"), r6("shear_weighted"))


@query(M + CROSS + """ SELECT m.mode_id, count(cs.mode_id)::INTEGER AS n_cross, round(coalesce(arg_max(r_cross, struct_pack(a := W_peak, b := r_cross)), 0e0), 6) AS r_star_max, round(coalesce(max(W_peak), 0e0), 6) AS W_star_max, round(coalesce(sum(W_peak), 0e0), 6) AS W_star_sum,
 round(coalesce(arg_max(r_cross, struct_pack(a := shear_weighted, b := r_cross)), 0e0), 6) AS r_star_high_shear, round(coalesce(max(shear_weighted), 0e0), 6) AS W_star_high_shear, round(coalesce(sum(shear_weighted), 0e0), 6) AS W_star_high_shear_sum FROM m LEFT JOIN cs USING (mode_id) GROUP BY 1""")
def crossing_summary(spark, d):
    return X.crossing_summary(D.joined(spark, d)).select("mode_id", "n_cross", *map(r6, ("r_star_max", "W_star_max", "W_star_sum", "r_star_high_shear", "W_star_high_shear", "W_star_high_shear_sum")))


@query(M + CROSS + """, tall AS (SELECT mode_id, i, r, max(abs(a)) AS a FROM cells GROUP BY ALL), nw AS (SELECT tall.mode_id, a, wx.w / top.t AS e FROM tall JOIN w wx USING (mode_id, i) JOIN top USING (mode_id) JOIN cs ON cs.mode_id = tall.mode_id AND abs(tall.r - cs.r_cross) <= 2 * (1 / 15e0) + 64 * 2.220446049250313e-16)
 SELECT m.mode_id, round(max(a), 6) AS cross_window_A_max, round(max(e), 6) AS cross_window_W_max FROM m LEFT JOIN nw USING (mode_id) GROUP BY 1""")
def cross_window(spark, d):
    return X.cross_window(D.joined(spark, d)).select("mode_id", r6("cross_window_A_max"), r6("cross_window_W_max"))


def _features_sql(extra: str) -> str:
    """The vector's columns from the queries of its parts."""
    part = lambda name: f"({ORACLES[name]})"
    base = ("mean_amp", "std_amp", "rad_loc", "rad_width", "max_to_mean", "max_to_median", "mean_abs_d1_mode", "max_abs_d1_abs", "mean_abs_d2_mode", "max_abs_d2_abs", "std_per_m_max", "max_per_m_mean", "std_per_m_mean", "spikes_per_m", "frac_spikes")
    return (
        f"{M} SELECT mode_id, {', '.join(base)}, round(gamma_d, 6) AS gamma_d, ntor::DOUBLE AS ntor, r_star, delta2_eff, S, W_star, W_star_max{extra} FROM m JOIN {part('structure_stats')} USING (mode_id) "
        f"JOIN {part('radial_features')} USING (mode_id) JOIN {part('continuum_scalars')} USING (mode_id) JOIN {part('crossing_summary')} USING (mode_id)"
    )


@query(_features_sql(", n_cross::DOUBLE AS n_cross, r_star_max, W_star_sum, r_star_high_shear, W_star_high_shear, W_star_high_shear_sum"))
def rf_feature_vector(spark, d):
    """The 28 values of the vector under their names."""
    v = X.feature_vector(D.joined(spark, d), crossing=True)
    return v.select("mode_id", *(r6(F.get("features", F.lit(k)), name) for k, name in enumerate(X.feature_names(crossing=True))))


MEASURED = """, g AS (SELECT mode_id, ntor, CASE mode_id % 5 WHEN 0 THEN 'eae_like' WHEN 1 THEN 'mixed' ELSE 'tae_like' END AS gap_region, CASE WHEN mode_id % 31 = 4 THEN 'short' ELSE repeat('a', 64) END AS fp, mode_id % 37 = 5 AS lacks, mode_id % 41 = 6 AS failed,
  (mode_id * 7) % 100 / 100e0 AS axis_peak, mode_id % 3 = 0 AS axis_max, (mode_id * 11) % 20 / 1e0 AS axis_width, mode_id % 4 = 1 AS grid_found, (mode_id * 13) % 100 / 100e0 AS grid_peak, (mode_id % 6)::INTEGER AS n_cross,
  (mode_id * 17) % 100 / 1000e0 AS w_max, (mode_id * 19) % 100 / 200e0 AS win_a, (mode_id * 23) % 100 / 1000e0 AS win_w, mode_id % 7 = 2 AS edge_in, (mode_id * 29) % 20 / 1e0 AS edge_width FROM m)"""


@query(M + MEASURED + """, k AS (SELECT mode_id, CASE WHEN gap_region = 'eae_like' OR fp = 'short' THEN 'RULE_INPUT_INVALID' WHEN lacks OR failed THEN 'RULE_FEATURE_EXTRACTION_FAILED' WHEN axis_max AND axis_peak >= 0.2e0 AND axis_width <= 10e0 THEN 'BAD_AXIS_SPIKE' WHEN grid_found AND grid_peak >= 0.3e0 THEN 'BAD_GRID_SCALE_SPIKE'
  WHEN n_cross > 0 AND w_max > 0.03e0 THEN 'BAD_CONT_CROSS' WHEN n_cross > 0 AND (win_a >= 0.25e0 OR win_w >= 0.05e0) THEN 'BAD_CONT_CROSS_WINDOW' WHEN edge_in AND edge_width <= 10e0 THEN 'BAD_EDGE_SPIKE' ELSE 'NO_GOOD_TEMPLATE' END AS primary_reason FROM g)
 SELECT mode_id, primary_reason, CASE WHEN primary_reason LIKE 'RULE%' THEN 'INVALID' WHEN primary_reason LIKE 'BAD%' THEN 'BAD' ELSE 'REVIEW' END AS rule_decision FROM k""")
def gate_ladder(spark, d):
    """The order and limits of all gates, over measurements that reach each of them."""
    i = F.col("mode_id")
    over = lambda k, n, by: (i * k) % n / F.lit(by)
    m = D.joined(spark, d).withColumns({
        "gap_region": F.when(i % 5 == 0, "eae_like").when(i % 5 == 1, "mixed").otherwise("tae_like"), "path": F.lit("p"), "mode_key": F.lit("k"), "shot": F.lit("s"), "input_fingerprint": F.when(i % 31 == 4, "short").otherwise(F.repeat(F.lit("a"), 64)),
        "low2": F.when(i % 37 != 5, F.col("low2")), "measure_error": F.when(i % 41 == 6, "failed"), "axis_peak": over(7, 100, 100.0), "axis_peak_is_local_max": i % 3 == 0, "axis_halfmax_width_grid": over(11, 20, 1.0),
        "grid_scale_candidate_found": i % 4 == 1, "grid_scale_peak": over(13, 100, 100.0), "n_cross": (i % 6).cast("int"), "W_star_max": over(17, 100, 1000.0), "cross_window_A_max": over(19, 100, 200.0), "cross_window_W_max": over(23, 100, 1000.0),
        "edge_energy_peak_in_window": i % 7 == 2, "edge_energy_halfmax_width_grid": over(29, 20, 1.0),
    })
    return gates.decide(m).select("mode_id", "primary_reason", "rule_decision")


#: Lobes of the axis, of the edge, of the energy and of single cells (t), with the samples around their half heights.
LOBES = """, prof AS (SELECT mode_id, h, i, a AS v FROM cells UNION ALL SELECT mode_id, -1, i, w FROM w),
 ax AS (SELECT mode_id, h, i AS k FROM cells WHERE i / 15e0 <= 0.2e0 + 1e-12 QUALIFY row_number() OVER (PARTITION BY mode_id ORDER BY abs(a) DESC, h, i) = 1),
 eh AS (SELECT mode_id, h, i AS k FROM cells WHERE i / 15e0 >= 0.8e0 - 1e-12 QUALIFY row_number() OVER (PARTITION BY mode_id ORDER BY abs(a) DESC, h, i DESC) = 1),
 ee AS (SELECT mode_id, -1 AS h, i AS k FROM w QUALIFY row_number() OVER (PARTITION BY mode_id ORDER BY w DESC, i) = 1),
 gs AS (SELECT mode_id, h, i AS k FROM cells WHERE abs(a) > 2e-14 WINDOW v AS (PARTITION BY mode_id, h ORDER BY i) QUALIFY coalesce(lag(a) OVER v * sign(a) < abs(a) - 2e-14, true) AND coalesce(lead(a) OVER v * sign(a) < abs(a) - 2e-14, true)),
 cand AS (SELECT 'axis' AS t, * FROM ax UNION ALL SELECT 'edge', * FROM eh UNION ALL SELECT 'energy', * FROM ee UNION ALL SELECT 'grid', * FROM gs),
 smp AS (SELECT c.t, c.mode_id, c.h, c.k, abs(z.v) AS top, sign(z.v)::INTEGER AS sg, q.i, CASE c.t WHEN 'grid' THEN q.v * sign(z.v) ELSE abs(q.v) END AS x FROM cand c JOIN prof z ON z.mode_id = c.mode_id AND z.h = c.h AND z.i = c.k JOIN prof q ON q.mode_id = c.mode_id AND q.h = c.h),
 lob AS (SELECT t, mode_id, h, k, top, sg, list(x ORDER BY i) AS p, max(i) FILTER (WHERE i < k AND x < top / 2) AS lo, min(i) FILTER (WHERE i > k AND x < top / 2) AS hi,
  arg_max(x, i) FILTER (WHERE i < k AND abs(x - top) > 2e-14) AS bl, arg_min(x, i) FILTER (WHERE i > k AND abs(x - top) > 2e-14) AS br FROM smp GROUP BY ALL),
 cut AS (SELECT *, CASE WHEN lo IS NULL THEN 0e0 ELSE (lo + (top / 2 - p[lo + 1]) / (p[lo + 2] - p[lo + 1])) / 15e0 END AS inn, CASE WHEN hi IS NULL THEN 1e0 ELSE (hi - (top / 2 - p[hi + 1]) / (p[hi] - p[hi + 1])) / 15e0 END AS ou FROM lob),
 fit AS (SELECT *, (ou - inn) * 15e0 AS width, coalesce(bl, br) IS NOT NULL AND coalesce(bl < top, true) AND coalesce(br < top, true) AS local FROM cut),
 best AS (SELECT * FROM fit WHERE t = 'grid' AND width <= 0.75e0 + 1e-12 QUALIFY row_number() OVER (PARTITION BY mode_id ORDER BY top DESC, width, h, k) = 1)"""


@query(M + LOBES + """ SELECT m.mode_id, round(a.top, 6) AS axis_peak, a.h::INTEGER AS axis_peak_harmonic_index, round(a.k / 15e0, 6) AS axis_peak_r, a.local AS axis_peak_is_local_max, round(a.width, 6) AS axis_halfmax_width_grid, round(a.ou, 6) AS axis_halfmax_outer_edge_r, a.lo IS NULL AS axis_component_touches_boundary,
 g.mode_id IS NOT NULL AS grid_scale_candidate_found, round(g.top, 6) AS grid_scale_peak, g.sg AS grid_scale_peak_sign, g.h::INTEGER AS grid_scale_peak_harmonic_index, round(g.k / 15e0, 6) AS grid_scale_peak_r, round(g.width, 6) AS grid_scale_halfmax_width_grid, g.lo IS NULL OR g.hi IS NULL AS touches,
 round(e.k / 15e0, 6) AS edge_energy_peak_r, e.k / 15e0 >= 0.8e0 - 1e-12 AS edge_energy_peak_in_window, round(e.width, 6) AS edge_energy_halfmax_width_grid, e.hi IS NULL AS edge_energy_component_touches_boundary,
 round(b.top, 6) AS edge_harmonic_peak, b.h::INTEGER AS edge_harmonic_peak_harmonic_index, round(b.k / 15e0, 6) AS edge_harmonic_peak_r, b.local AS edge_harmonic_peak_is_local_max, round(b.width, 6) AS edge_harmonic_halfmax_width_grid
 FROM m JOIN fit a ON a.mode_id = m.mode_id AND a.t = 'axis' JOIN fit b ON b.mode_id = m.mode_id AND b.t = 'edge' JOIN fit e ON e.mode_id = m.mode_id AND e.t = 'energy' LEFT JOIN best g ON g.mode_id = m.mode_id""".replace("g.lo IS NULL OR g.hi IS NULL AS touches", "CASE WHEN g.mode_id IS NOT NULL THEN g.lo IS NULL OR g.hi IS NULL END AS grid_scale_component_touches_boundary"))
def gate_measures(spark, d):
    """What the axis, grid and edge gates measure, with windows of three and four of the sixteen radii."""
    m = gates.measure(D.joined(spark, d), gates.GateConfig(axis_r=0.2, edge_r=0.8, grid_width=0.75))
    plain = ("axis_peak_harmonic_index", "axis_peak_is_local_max", "axis_component_touches_boundary", "grid_scale_candidate_found", "grid_scale_peak_sign", "grid_scale_peak_harmonic_index", "grid_scale_component_touches_boundary", "edge_energy_peak_in_window", "edge_energy_component_touches_boundary", "edge_harmonic_peak_harmonic_index", "edge_harmonic_peak_is_local_max")
    rounded = ("axis_peak", "axis_peak_r", "axis_halfmax_width_grid", "axis_halfmax_outer_edge_r", "grid_scale_peak", "grid_scale_peak_r", "grid_scale_halfmax_width_grid", "edge_energy_peak_r", "edge_energy_halfmax_width_grid", "edge_harmonic_peak", "edge_harmonic_peak_r", "edge_harmonic_halfmax_width_grid")
    return m.select("mode_id", *plain, *map(r6, rounded))


@query()
def rule_gates(spark, d):
    routed = X.route(X.upper_gap(D.joined(spark, d))).where("gap_region in ('tae_like', 'mixed')").drop("w", "r")
    return gates.evaluate(routed, identity=()).select("mode_id", "ntor", "gap_region", "rule_decision", "primary_reason", "axis_peak", "grid_scale_peak", "n_cross", "W_star_max", "ext_dr", "ext_df_gap", "ext_energy_frac")


@query()
def extremum_screen(spark, d):
    """Candidates of the regions tae_like and mixed, aligned with an inner extremum and with little energy at
    the crossings away from it, counted by group."""
    routed = X.route(X.upper_gap(D.joined(spark, d))).where("gap_region in ('tae_like', 'mixed')").drop("w", "r")
    e = X.secondary_crossing(X.with_energy(gates.measure(routed)))
    good = F.col("ext_matched") & (F.col("ext_dr") <= 0.02) & F.col("ext_df_gap").between(0, 0.04) & (F.col("ext_energy_frac") >= 0.25)
    return e.groupBy("ntor").agg(F.count("*").alias("n_modes"), F.count_if(F.col("ext_matched")).alias("n_matched"), F.count_if(good).alias("n_candidates"), *(F.count_if(good & (F.col("W_secondary") < t)).alias(n) for t, n in ((0.001, "n_below_0_1_percent"), (0.01, "n_below_1_percent"), (0.05, "n_below_5_percent"))))


TOPOLOGY = """WITH p AS (SELECT vec_id, i, i / 31e0 AS r, e, b + x AS f FROM (SELECT vec_id, i, e, CASE WHEN e = 0 THEN 1e0 ELSE 1.3e0 END AS b, embedding[e * 32 + i + 1] AS x FROM embeddings, range(32) rs(i), range(2) es(e)) WHERE x <= 0.3),
 win AS (SELECT a.*, vec_id * 64 + e * 32 + i - row_number() OVER (PARTITION BY vec_id, e ORDER BY i) AS run FROM p a WHERE r BETWEEN 0.05e0 AND 0.40e0),
 s AS (SELECT *, f - lag(f) OVER v AS step, coalesce(lag(f) OVER v, f) AS l1, coalesce(lag(f, 2) OVER v, lag(f) OVER v, f) AS l2, coalesce(lead(f) OVER v, f) AS r1, coalesce(lead(f, 2) OVER v, lead(f) OVER v, f) AS r2 FROM win WINDOW v AS (PARTITION BY vec_id, e, run ORDER BY i)),
 t AS (SELECT *, (l2 + 2 * l1 + 3 * f + 2 * r1 + r2) / 9 AS g FROM s),
 m AS (SELECT *, sign(g - lag(g) OVER v) AS before, sign(lead(g) OVER v - g) AS after FROM t WINDOW v AS (PARTITION BY vec_id, e, run ORDER BY i)),
 edge AS (SELECT vec_id, e, CASE WHEN count(step) = 0 THEN NULL WHEN sum(abs(step)) = 0 THEN 1e0 ELSE abs(sum(step)) / sum(abs(step)) END AS mono, count(*) FILTER (WHERE before = 1 - 2 * e AND after = 2 * e - 1) AS turns FROM m GROUP BY 1, 2),
 edges AS (SELECT v.vec_id, CASE WHEN count(mono) = 2 THEN sum(mono) / 2 END AS edge_monotonicity, CASE WHEN count(turns) = 2 THEN min(turns) ELSE 0 END AS extremum_pairs FROM embeddings v LEFT JOIN edge USING (vec_id) GROUP BY 1),
 wide AS (SELECT vec_id, median(2 * (h.f - l.f) / (h.f + l.f)) AS gap_width_median FROM win l JOIN win h USING (vec_id, i) WHERE l.e = 0 AND h.e = 1 GROUP BY 1),
 top AS (SELECT vec_id // 5 AS shot, (6 + vec_id % 5)::INTEGER AS n, gap_width_median, edge_monotonicity, extremum_pairs FROM edges LEFT JOIN wide USING (vec_id))
"""


@query(TOPOLOGY + "SELECT shot, n, round(gap_width_median, 6) AS gap_width_median, round(edge_monotonicity, 6) AS edge_monotonicity, extremum_pairs FROM top")
def gap_topology(spark, d):
    t = X.topology(D.shot_profiles(spark, d))
    return t.select("shot", "n", r6("gap_width_median"), r6("edge_monotonicity"), F.col("extremum_pairs").cast("long").alias("extremum_pairs"))


@query(TOPOLOGY + "SELECT shot, count(DISTINCT n) AS n_groups, count(DISTINCT n) FILTER (WHERE gap_width_median >= 0.25e0 AND edge_monotonicity <= 0.5e0 AND extremum_pairs >= 1) AS n_suitable, count(DISTINCT n) FILTER (WHERE gap_width_median >= 0.25e0 AND edge_monotonicity <= 0.5e0 AND extremum_pairs >= 1) = 5 AS passes FROM top GROUP BY shot")
def topology_screen(spark, d):
    return X.topology_screen(D.shot_profiles(spark, d))


@query(M + RAD + """, x AS (SELECT * FROM cells WHERE h = 0), c AS (SELECT mode_id, i, r, sum(a * a) OVER (PARTITION BY mode_id ORDER BY i) / sum(a * a) OVER (PARTITION BY mode_id) AS s FROM x),
 e AS (SELECT *, lead(s) OVER v AS s2, lead(r) OVER v AS r2 FROM c WINDOW v AS (PARTITION BY mode_id ORDER BY i)),
 q AS (SELECT mode_id, q.q, coalesce(max(r + (r2 - r) * (q.q - s) / (s2 - s)) FILTER (WHERE s <= q.q AND s2 > q.q), 0e0) AS edge FROM e, (VALUES (0.1e0), (0.9e0)) q(q) GROUP BY 1, 2)
 SELECT mode_id, round(max(edge) FILTER (WHERE q = 0.9e0) - max(edge) FILTER (WHERE q = 0.1e0), 6) AS width FROM q GROUP BY 1""")
def quantile_width(spark, d):
    m = D.modes(spark, d).withColumn("r", A.grid(F.col("nr")))
    return m.select("mode_id", r6(A.quantile_width(F.get("mode", F.lit(0)), F.col("r")), "width"))


INTS = ", q AS (SELECT mode_id, i, (round_even(a * 40, 0))::INTEGER AS x FROM cells WHERE h = 0)"


def _ints(spark, d):
    return D.modes(spark, d).select("mode_id", F.transform(F.get("mode", F.lit(0)), lambda a: F.rint(a * 40).cast("int")).alias("x"))


@query(f"WITH RECURSIVE {D.MODES_SQL}{INTS}, y AS (SELECT mode_id, i, x AS y FROM q WHERE i = 0 UNION ALL SELECT q.mode_id, q.i, least(greatest(q.x, y.y - 2), y.y + 2) FROM y JOIN q ON q.mode_id = y.mode_id AND q.i = y.i + 1) SELECT mode_id, i::INTEGER AS i, y::INTEGER AS y FROM y")
def slew_limit(spark, d):
    return _ints(spark, d).select("mode_id", F.posexplode(A.slew_limit(F.col("x"), 2)).alias("i", "y"))


@query(M + INTS + " SELECT mode_id, i::INTEGER AS i, trunc(median(x) OVER (PARTITION BY mode_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))::INTEGER AS y FROM q")
def median_filter(spark, d):
    return _ints(spark, d).select("mode_id", F.posexplode(A.median_filter(F.col("x"), 3)).alias("i", "y"))


@query(M + """, q AS (SELECT mode_id, i, CASE WHEN a > 0.15e0 THEN NULL ELSE a END AS x FROM cells WHERE h = 0), b AS (SELECT *, i - row_number() OVER (PARTITION BY mode_id ORDER BY i) AS g FROM q WHERE x IS NOT NULL), e AS (SELECT *, min(i) OVER v AS f, max(i) OVER v AS l FROM b WINDOW v AS (PARTITION BY mode_id, g)),
 y AS (SELECT e.mode_id, e.i, sum((3 - abs(k)) * o.x) / 9e0 AS y FROM e, range(-2, 3) ks(k) JOIN e o ON o.mode_id = e.mode_id AND o.i = least(greatest(e.i + k, e.f), e.l) GROUP BY 1, 2) SELECT q.mode_id, q.i::INTEGER AS i, round(y, 6) AS y FROM q LEFT JOIN y USING (mode_id, i)""")
def smoothed_profiles(spark, d):
    """Sentinels out, then smoothed over the runs that are left: values above 0.15 stand as 1e4."""
    marked = F.transform(F.get("mode", F.lit(0)), lambda a: F.when(a > 0.15, F.lit(1e4)).otherwise(a))
    return D.modes(spark, d).select("mode_id", F.posexplode(A.smooth5(A.mask_sentinel(marked))).alias("i", "v")).select("mode_id", "i", r6(F.col("v"), "y"))


HOLES = ", q AS (SELECT mode_id, i, CASE WHEN abs(a) < 0.08e0 THEN NULL ELSE (round_even(a * 40, 0))::INTEGER END AS x FROM cells WHERE h = 0)"


def _holes(spark, d):
    return D.modes(spark, d).select("mode_id", F.transform(F.get("mode", F.lit(0)), lambda a: F.when(F.abs(a) < 0.08, None).otherwise(F.rint(a * 40).cast("int"))).alias("x"))


@query(M + HOLES + " SELECT mode_id, min(i)::INTEGER AS first, max(i)::INTEGER AS last FROM (SELECT mode_id, i, i - row_number() OVER (PARTITION BY mode_id ORDER BY i) AS g FROM q WHERE x IS NOT NULL) GROUP BY mode_id, g")
def finite_blocks(spark, d):
    return _holes(spark, d).select("mode_id", F.inline(A.finite_blocks(F.col("x"))))


@query(M + HOLES + " SELECT mode_id, i::INTEGER AS i, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY mode_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(x IGNORE NULLS) OVER (PARTITION BY mode_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y FROM q")
def fill_forward_back(spark, d):
    return _holes(spark, d).select("mode_id", F.posexplode(A.fill_both_ways(F.col("x"))).alias("i", "y"))


@query(M + ", v AS (SELECT mode_id, ntor, list(a ORDER BY i) AS p FROM cells WHERE h = 0 GROUP BY 1, 2), n AS (SELECT mode_id, p, lead(mode_id) OVER w AS other_id, lead(p) OVER w AS o FROM v WINDOW w AS (PARTITION BY ntor ORDER BY mode_id)) SELECT mode_id, other_id, round(abs(list_dot_product(p, o) / sqrt(list_dot_product(p, p) * list_dot_product(o, o))), 6) AS cosine FROM n WHERE other_id IS NOT NULL")
def cosine_pairs(spark, d):
    w = Window.partitionBy("ntor").orderBy("mode_id")
    p = D.modes(spark, d).select("mode_id", "ntor", F.get("mode", F.lit(0)).alias("p")).withColumns({"other_id": F.lead("mode_id").over(w), "o": F.lead("p").over(w)})
    return p.where("other_id is not null").select("mode_id", "other_id", r6(A.abs_cosine(F.col("p"), F.col("o")), "cosine"))


@query()
def dedup_representatives(spark, d):
    good = D.modes(spark, d).withColumn("score", F.col("mode_id") * 7919 % 1000 / F.lit(1000.0))
    return dedup.representatives(good.select("ntor", "mode_id", "omega", "score", "mode"), ["ntor"])


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS k FROM events WHERE value IS NOT NULL),
c AS (SELECT user_id, event_id, value, k, value AS anchor, 1 AS cluster_index FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.value, e.k, CASE WHEN abs(e.value - c.anchor) / greatest(abs(c.anchor), 1e-12) < 0.02e0 THEN c.anchor ELSE e.value END, CASE WHEN abs(e.value - c.anchor) / greatest(abs(c.anchor), 1e-12) < 0.02e0 THEN c.cluster_index ELSE c.cluster_index + 1 END FROM c JOIN e ON e.user_id = c.user_id AND e.k = c.k + 1)
SELECT user_id, event_id, round(value, 6) AS value, cluster_index::INTEGER AS cluster_index FROM c""")
def frequency_clusters(spark, d):
    out = R.frequency_clusters(D.table(spark, d, "events").where("value is not null"), ["user_id"], "value", "event_id")
    return out.select("user_id", "event_id", r6("value"), "cluster_index")


@query("WITH m AS (SELECT vec_id AS mode_id, embedding FROM embeddings) SELECT mode_id, true AS shape_equal, mode_id % 7 <> 0 AS array_equal, CASE WHEN mode_id % 7 = 0 THEN 0.25e0 ELSE 0e0 END AS max_abs_delta, CASE WHEN mode_id % 5 = 0 THEN 0.1e0 ELSE 0e0 END AS relative_omega FROM m")
def mode_diff(spark, d):
    m = D.modes(spark, d)
    other = m.withColumn("mode", F.when(F.col("mode_id") % 7 == 0, F.transform("mode", lambda row, h: F.transform(row, lambda x, i: F.when((h == 1) & (i == 4), x + 0.25).otherwise(x)))).otherwise(F.col("mode"))).withColumn("omega", F.when(F.col("mode_id") % 5 == 0, F.col("omega") * 1.1).otherwise(F.col("omega")))
    return R.mode_diff(m, other, "mode_id").select("mode_id", "shape_equal", "array_equal", r6("max_abs_delta"), r6("relative_omega"))


# --- scores --------------------------------------------------------------------------------------


def _fused(spark, d):
    return S.flagged(S.fuse(D.scores(spark, d)))


@query(SC + FUSED + " SELECT doc_id, round(p_avg, 6) AS p_avg, tier, final_label, model_disagreement, near_threshold, score_gap FROM ff")
def score_fusion(spark, d):
    return _fused(spark, d).select("doc_id", r6("p_avg"), "tier", "final_label", "model_disagreement", "near_threshold", "score_gap")


@query(SC + FUSED + " SELECT shot, count(*) FILTER (WHERE is_flagged) AS n_flagged, count(*) AS n FROM ff GROUP BY 1")
def flagged_rows(spark, d):
    return _fused(spark, d).groupBy("shot").agg(F.count_if("is_flagged").alias("n_flagged"), F.count("*").alias("n"))


SUMMARY = """count(*) AS n_total_files, count(*) FILTER (WHERE rejection_reason = 'mode_load_failed') AS n_failed_load, count(*) FILTER (WHERE rejection_reason = 'nonfinite_mode_data') AS n_nan_or_invalid, count(*) FILTER (WHERE gap_region = 'tae_like') AS n_tae_like, count(*) FILTER (WHERE gap_region = 'mixed') AS n_mixed, count(*) FILTER (WHERE gap_region = 'eae_like') AS n_eae_like,
count(*) FILTER (WHERE k) AS n_scored, count(*) FILTER (WHERE k AND tier = 'gold_good') AS n_gold_good, count(*) FILTER (WHERE k AND tier = 'silver_good') AS n_silver_good, count(*) FILTER (WHERE k AND final_label = 'good') AS n_good_before_clustering, count(*) FILTER (WHERE k AND sel) AS n_final_good, count(*) FILTER (WHERE k AND final_label = 'bad') AS n_final_bad, count(*) FILTER (WHERE k AND is_flagged) AS n_flagged,
round(avg(p_rf) FILTER (WHERE k), 6) AS mean_p_rf, round(avg(p_cnn) FILTER (WHERE k), 6) AS mean_p_cnn, round(median(p_rf) FILTER (WHERE k), 6) AS median_p_rf, round(median(p_cnn) FILTER (WHERE k), 6) AS median_p_cnn,
round(count(*) FILTER (WHERE k AND sel) / nullif(count(*) FILTER (WHERE k), 0)::DOUBLE, 6) AS fraction_good, round(count(*) FILTER (WHERE k AND is_flagged) / nullif(count(*) FILTER (WHERE k), 0)::DOUBLE, 6) AS fraction_flagged, round(count(*) FILTER (WHERE k AND NOT model_disagreement) / nullif(count(*) FILTER (WHERE k), 0)::DOUBLE, 6) AS rf_cnn_agreement_fraction,
count(*) FILTER (WHERE k AND final_label = 'good') - count(*) FILTER (WHERE k AND sel) AS mode_clusters_removed FROM (SELECT *, rejection_reason = '' AND gap_region <> 'eae_like' AS k, final_label = 'good' AND doc_id % 3 <> 0 AS sel FROM ff)"""
ROUND = ("mean_p_rf", "mean_p_cnn", "median_p_rf", "median_p_cnn", "fraction_good", "fraction_flagged", "rf_cnn_agreement_fraction")


def _summary(spark, d, keys):
    rows = _fused(spark, d).withColumn("selected", (F.col("final_label") == "good") & (F.col("doc_id") % 3 != 0))
    out = S.summary(rows, keys)
    return out.select(*(r6(c) if c in ROUND else F.col(c) for c in out.columns))


@query(SC + FUSED + f" SELECT shot, {SUMMARY} GROUP BY shot")
def shot_summary(spark, d):
    return _summary(spark, d, ["shot"])


@query(SC + FUSED + f" SELECT shot, n, {SUMMARY} GROUP BY GROUPING SETS ((shot), (shot, n))")
def summary_by_n(spark, d):
    return _summary(spark, d, ["shot", "n"])


@query(SC + FUSED + " SELECT 'n_rows' AS name, count(*)::DOUBLE AS value FROM ff UNION ALL SELECT 'n_flagged', (count(*) FILTER (WHERE is_flagged))::DOUBLE FROM ff UNION ALL SELECT 'mean_p_avg', round(avg(p_avg), 6) FROM ff")
def vertical_summary(spark, d):
    s = _fused(spark, d).agg(F.count("*").alias("n_rows"), F.count_if("is_flagged").alias("n_flagged"), F.round(F.avg("p_avg"), 6).alias("mean_p_avg"))
    return S.vertical(s, ["n_rows", "n_flagged", "mean_p_avg"])


def _truth(spark, d):
    return _fused(spark, d).where("y is not null").withColumn("predicted", (F.col("final_label") == "good").cast("int"))


CM = """, t AS (SELECT *, (final_label = 'good')::INTEGER AS p FROM ff WHERE y IS NOT NULL), cm AS (SELECT count(*) AS n_matched, count(*) FILTER (WHERE y = 0 AND p = 0) AS tn_bad, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp_bad_as_good, count(*) FILTER (WHERE y = 1 AND p = 0) AS fn_good_as_bad, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp_good FROM t)"""
MET = "round((tp_good + tn_bad) / n_matched::DOUBLE, 6) AS accuracy, round(tp_good / nullif(tp_good + fp_bad_as_good, 0)::DOUBLE, 6) AS precision_good, round(tp_good / nullif(tp_good + fn_good_as_bad, 0)::DOUBLE, 6) AS recall_good, round(CASE WHEN tp_good > 0 THEN 2e0 * tp_good / (2 * tp_good + fp_bad_as_good + fn_good_as_bad) END, 6) AS f1_good"
CELLS = ("tn_bad", "fp_bad_as_good", "fn_good_as_bad", "tp_good")


def _metric_row(df, *keys):
    return S.metrics(df).select(*keys, "n_matched", *CELLS, *map(r6, ("accuracy", "precision_good", "recall_good", "f1_good")))


@query(SC + FUSED + CM + f" SELECT *, {MET} FROM cm")
def confusion_matrix(spark, d):
    return _metric_row(S.confusion(_truth(spark, d), "y", "predicted"))


@query(SC + FUSED + CM + """, c AS (SELECT 'bad' AS class, tn_bad / nullif(tn_bad + fn_good_as_bad, 0)::DOUBLE AS p, tn_bad / nullif(tn_bad + fp_bad_as_good, 0)::DOUBLE AS r, tn_bad + fp_bad_as_good AS s FROM cm UNION ALL SELECT 'good', tp_good / nullif(tp_good + fp_bad_as_good, 0)::DOUBLE, tp_good / nullif(tp_good + fn_good_as_bad, 0)::DOUBLE, tp_good + fn_good_as_bad FROM cm),
 cf AS (SELECT class, coalesce(p, 0) AS p, coalesce(r, 0) AS r, s, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM c)
 SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, s::BIGINT AS support, round(f, 6) AS f1 FROM cf UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), sum(s)::BIGINT, round(avg(f), 6) FROM cf UNION ALL SELECT 'weighted avg', round(sum(p * s) / sum(s), 6), round(sum(r * s) / sum(s), 6), sum(s)::BIGINT, round(sum(f * s) / sum(s), 6) FROM cf""")
def classification_report(spark, d):
    return S.classification_report(_truth(spark, d), "y", "predicted").select("class", r6("precision"), r6("recall"), "support", r6("f1"))


@query(SC + FUSED + CM.replace("cm AS (SELECT count(*)", "cs AS (SELECT shot, count(*)").replace("FROM t)", "FROM t GROUP BY shot)") + f", cm AS (SELECT regime, sum(n_matched)::BIGINT AS n_matched, sum(tn_bad)::BIGINT AS tn_bad, sum(fp_bad_as_good)::BIGINT AS fp_bad_as_good, sum(fn_good_as_bad)::BIGINT AS fn_good_as_bad, sum(tp_good)::BIGINT AS tp_good FROM (SELECT *, 'all' AS regime FROM cs UNION ALL SELECT *, CASE WHEN shot LIKE 'src1%' THEN 'g' ELSE 'non_g' END FROM cs) GROUP BY 1) SELECT *, {MET} FROM cm")
def loso_totals(spark, d):
    """Counts by held-out shot summed over all, and over two regimes of shots; metrics from the sums."""
    by_shot = S.confusion(_truth(spark, d), "y", "predicted", ["shot"])
    regime = F.when(F.startswith("shot", F.lit("src1")), "g").otherwise("non_g")
    both = by_shot.withColumn("regime", F.explode(F.array(F.lit("all"), regime)))
    return _metric_row(both.groupBy("regime").agg(*(F.sum(c).alias(c) for c in ("n_matched", *CELLS))), "regime")


_FOLD_CELLS = "count(*)::BIGINT AS n_matched, count(*) FILTER (WHERE y = 0 AND q = 0)::BIGINT AS tn_bad, count(*) FILTER (WHERE y = 0 AND q = 1)::BIGINT AS fp_bad_as_good, count(*) FILTER (WHERE y = 1 AND q = 0)::BIGINT AS fn_good_as_bad, count(*) FILTER (WHERE y = 1 AND q = 1)::BIGINT AS tp_good"
_FOLD_RATES = "round((tn_bad + tp_good) / nullif(n_matched, 0)::DOUBLE, 6) AS accuracy, round(tp_good / nullif(tp_good + fp_bad_as_good, 0)::DOUBLE, 6) AS precision_good, round(tp_good / nullif(tp_good + fn_good_as_bad, 0)::DOUBLE, 6) AS recall_good, round(2 * tp_good / nullif(CASE WHEN tp_good > 0 THEN 2 * tp_good + fp_bad_as_good + fn_good_as_bad END, 0)::DOUBLE, 6) AS f1_good"


def _folds(spark, d):
    """Two models' scores over held-out shots, as a leave-one-out run has them."""
    rows = D.scores(spark, d)
    by = lambda name, p: rows.select("shot", "y", F.lit(name).alias("model"), (F.col(p) >= 0.5).cast("int").alias("predicted"))
    return folds.fold_summary(by("CNN", "p_cnn").unionByName(by("RF", "p_rf")), rows)


@query(SC + f", m AS (SELECT shot, y, 'RF' AS model, (p_rf >= 0.5)::INT AS q FROM s UNION ALL SELECT shot, y, 'CNN', (p_cnn >= 0.5)::INT FROM s), c AS (SELECT shot, model, {_FOLD_CELLS} FROM m WHERE y IN (0, 1) AND q IS NOT NULL GROUP BY 1, 2), o AS (SELECT shot, count(*) AS n, count(*) FILTER (WHERE y = 1) AS g, count(*) FILTER (WHERE y = 0) AS b FROM s GROUP BY 1), w AS (SELECT sum(n) AS n, sum(g) AS g, sum(b) AS b FROM o) SELECT c.shot, (w.n - o.n)::BIGINT AS n_train, (w.g - o.g)::BIGINT AS n_train_good, (w.b - o.b)::BIGINT AS n_train_bad, o.n::BIGINT AS n_test, o.g::BIGINT AS n_test_good, o.b::BIGINT AS n_test_bad, model, n_matched, tn_bad, fp_bad_as_good, fn_good_as_bad, tp_good, {_FOLD_RATES} FROM c JOIN o ON o.shot = c.shot, w")
def loso_fold_summary(spark, d):
    return _folds(spark, d).select(*folds.SUMMARY_COLUMNS[:-4], *(r6(c) for c in folds.RATES))


@query(SC + f", m AS (SELECT shot, y, 'RF' AS model, (p_rf >= 0.5)::INT AS q FROM s UNION ALL SELECT shot, y, 'CNN', (p_cnn >= 0.5)::INT FROM s), c AS (SELECT model, count(DISTINCT shot)::BIGINT AS n_folds, {_FOLD_CELLS} FROM m WHERE y IN (0, 1) AND q IS NOT NULL GROUP BY 1) SELECT model, n_folds, n_matched, tn_bad, fp_bad_as_good, fn_good_as_bad, tp_good, {_FOLD_RATES} FROM c")
def loso_model_totals(spark, d):
    """The joined totals of all folds, by model."""
    return folds.fold_totals(_folds(spark, d)).select(*folds.TOTAL_COLUMNS[:-4], *(r6(c) for c in folds.RATES))


@query(SC + ", o AS (SELECT shot AS fold, count(*) AS n_rows, count(*) FILTER (WHERE y = 1) AS n_good, count(*) FILTER (WHERE y = 0) AS n_bad FROM s GROUP BY 1), b AS (SELECT fold, 'test' AS split, n_rows, n_good, n_bad FROM o UNION ALL SELECT fold, 'train', (sum(n_rows) OVER () - n_rows)::BIGINT, (sum(n_good) OVER () - n_good)::BIGINT, (sum(n_bad) OVER () - n_bad)::BIGINT FROM o) SELECT *, n_rows - n_good - n_bad AS n_other FROM b")
def loso_split_counts(spark, d):
    return R.fold_counts(D.scores(spark, d), "shot", "y")


@query(SC + ", t AS (SELECT count(*) AS n_samples, count(*) FILTER (WHERE y = 1) AS n_true_good, count(*) FILTER (WHERE p_rf >= 0.5e0) AS n_predicted_good, round(avg(p_rf), 6) AS prob_mean, round(stddev_pop(p_rf), 6) AS prob_std, min(p_rf) AS prob_min, max(p_rf) AS prob_max FROM s WHERE y IS NOT NULL) SELECT *, round(n_predicted_good / n_samples::DOUBLE, 6) AS predicted_good_fraction, round(n_true_good / n_samples::DOUBLE, 6) AS true_good_fraction, '' AS collapse_reasons FROM t")
def prediction_health(spark, d):
    out = S.health(D.scores(spark, d), "p_rf", "y")
    return out.select(*(r6(c) if c in ("prob_mean", "prob_std", "predicted_good_fraction", "true_good_fraction") else F.col(c) for c in out.columns))


@query(SC + ", b AS (SELECT p_rf + p_cnn / 7e0 AS level, count(*) FILTER (WHERE y = 1) AS g, count(*) AS n FROM s WHERE y IS NOT NULL GROUP BY 1), c AS (SELECT level, sum(g) OVER w AS tp, sum(n) OVER w AS k, sum(g) OVER () AS t, g FROM b WINDOW w AS (ORDER BY level DESC)) SELECT round(sum(g / t::DOUBLE * tp / k::DOUBLE), 6) AS average_precision FROM c")
def average_precision(spark, d):
    """Of a continuous score, every value a level of its own."""
    return S.average_precision(D.scores(spark, d).withColumn("p", F.col("p_rf") + F.col("p_cnn") / F.lit(7.0)), "p", "y").select(r6("average_precision"))



@query(SC + " SELECT least(floor(p_rf * 16), 15)::INTEGER AS bin, count(*) AS n FROM s GROUP BY 1")
def score_histogram(spark, d):
    return S.histogram(D.scores(spark, d), "p_rf")


@query(SC + " SELECT least(floor(p_rf * 30), 29)::INTEGER AS x_bin, least(floor(p_cnn * 30), 29)::INTEGER AS y_bin, count(*) AS n FROM s GROUP BY 1, 2")
def score_hist2d(spark, d):
    return S.histogram2d(D.scores(spark, d), "p_rf", "p_cnn")


@query(SC + """ SELECT shot, '{' || string_agg('"' || rejection_reason || '":' || n, ',' ORDER BY rejection_reason) || '}' AS counts_json FROM (SELECT shot, rejection_reason, count(*) AS n FROM s WHERE rejection_reason <> '' GROUP BY 1, 2) GROUP BY 1""")
def reason_counts(spark, d):
    return S.stable_counts(D.scores(spark, d), "rejection_reason", ["shot"])


@query(SC + " SELECT doc_id, round(p_rf, 6) AS p_rf, y, round(abs(p_rf - 0.5e0), 6) AS confidence FROM s WHERE y IS NOT NULL AND (p_rf >= 0.5e0)::INTEGER <> y")
def disagreements(spark, d):
    return R.disagreements(D.scores(spark, d), "p_rf", "y").select("doc_id", r6("p_rf"), "y", r6("confidence"))


@query(SC + " SELECT doc_id, y, round(p_rf, 6) AS p_rf, CASE WHEN y = 1 THEN 'labeled_good_scored_bad' ELSE 'labeled_bad_scored_good' END AS flag FROM s WHERE (y = 1 AND p_rf <= 0.1e0) OR (y = 0 AND p_rf >= 0.9e0)")
def oof_suspects(spark, d):
    s = D.scores(spark, d).where("(y = 1 and p_rf <= 0.1) or (y = 0 and p_rf >= 0.9)")
    return s.select("doc_id", "y", r6("p_rf"), F.when(F.col("y") == 1, "labeled_good_scored_bad").otherwise("labeled_bad_scored_good").alias("flag")).orderBy(F.desc(F.abs(F.col("p_rf") - F.col("y"))), "doc_id")


@query(M + RAD + " SELECT ntor, round(median(rad_loc), 6) AS median_rad_loc, round(median(rad_width), 6) AS median_rad_width FROM radw GROUP BY 1")
def class_medians(spark, d):
    return X.radial(D.modes(spark, d)).groupBy("ntor").agg(r6(F.median("rad_loc"), "median_rad_loc"), r6(F.median("rad_width"), "median_rad_width"))


@query(M + RAD + ", z AS (SELECT mode_id, unnest([{'f': 'omega', 'z': (omega - avg(omega) OVER ()) / stddev_pop(omega) OVER ()}, {'f': 'rad_loc', 'z': (rad_loc - avg(rad_loc) OVER ()) / stddev_pop(rad_loc) OVER ()}, {'f': 'rad_width', 'z': (rad_width - avg(rad_width) OVER ()) / stddev_pop(rad_width) OVER ()}]) AS x FROM radw) SELECT mode_id, (k - 1)::INTEGER AS rank, f AS feature, round(z, 6) AS z FROM (SELECT mode_id, x.f AS f, x.z AS z, row_number() OVER (PARTITION BY mode_id ORDER BY abs(x.z) DESC) AS k FROM z) WHERE k <= 2")
def zscore_topk(spark, d):
    return S.zscore_top(X.radial(D.modes(spark, d)).select("mode_id", "omega", "rad_loc", "rad_width"), ["omega", "rad_loc", "rad_width"], "mode_id", 2).select("mode_id", "rank", "feature", r6("z"))


@query(M + RAD + CROSS + ", k AS (SELECT mode_id, arg_max(r_cross, struct_pack(a := W_peak, b := r_cross)) AS r, max(W_peak) AS v FROM cs GROUP BY 1) SELECT radw.ntor, count(*) AS n_modes, count(*) FILTER (WHERE v >= 0.30e0 AND r <= 0.02e0) AS n_interaction FROM radw LEFT JOIN k USING (mode_id) GROUP BY 1")
def interaction_counts(spark, d):
    c = X.crossing_summary(D.joined(spark, d))
    return c.groupBy("ntor").agg(F.count("*").alias("n_modes"), F.count_if((F.col("n_cross") > 0) & (F.col("W_star_max") >= 0.30) & (F.col("r_star_max") <= 0.02)).alias("n_interaction"))


@query(f"""WITH c AS ({ORACLES['continuum_scalars']}), t AS (SELECT r_star, W_star, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS label, CASE WHEN starts_with(source, 'src1') THEN 'g' ELSE 'non_g' END AS own FROM c JOIN documents ON doc_id = mode_id JOIN labels USING (doc_id) WHERE quality IS NOT NULL)
 SELECT label, regime, count(*) AS n_modes, count(*) FILTER (WHERE r_star <= 0.02e0 AND W_star >= 0.3e0) AS n_interaction FROM t, (VALUES ('all'), ('own')) v(k), LATERAL (SELECT CASE k WHEN 'all' THEN k ELSE own END AS regime) GROUP BY 1, 2""")
def star_interaction_counts(spark, d):
    """The same of the legacy r_star and W_star, by label and regime of shots (and over all)."""
    of_mode = D.scores(spark, d).where("y is not null").select("doc_id", F.when(F.col("y") == 1, "good").otherwise("bad").alias("label"), F.when(F.startswith("shot", F.lit("src1")), "g").otherwise("non_g").alias("own"))
    m = X.continuum_scalars(D.joined(spark, d)).join(of_mode, F.col("mode_id") == F.col("doc_id"))
    return X.star_interactions(m.withColumn("regime", F.explode(F.array(F.lit("all"), "own"))), ["label", "regime"])


@query("WITH t AS (SELECT vec_id % 4 AS label, (row_number() OVER (PARTITION BY vec_id % 4 ORDER BY vec_id)) AS k, count(*) OVER (PARTITION BY vec_id % 4) AS n FROM embeddings) SELECT label::INTEGER AS label, count(*) AS n_rows, greatest(1, floor(any_value(n) * 0.1e0))::BIGINT AS n_test FROM t GROUP BY 1")
def stratified_split(spark, d):
    rows = D.table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 4).cast("int").alias("label"))
    return S.stratified_split(rows, "label", "vec_id").groupBy("label").agg(F.count("*").alias("n_rows"), F.count_if("is_test").alias("n_test"))


# --- labels, overrides, provenance ---------------------------------------------------------------


@query("SELECT doc_id, sha256('MODE_INPUT_V1'::BLOB || '\\x00'::BLOB || 'mode'::BLOB || '\\x00'::BLOB || unhex(lpad(hex(strlen(text)), 32, '0')) || encode(text) || 'datcon'::BLOB || '\\x00'::BLOB || unhex(lpad(hex(strlen(source)), 32, '0')) || encode(source)) AS input_fingerprint FROM documents")
def fingerprint(spark, d):
    return D.table(spark, d, "documents").select("doc_id", R.fingerprint([("mode", F.col("text")), ("datcon", F.col("source"))]).alias("input_fingerprint"))


TREES = """a AS (SELECT source || '/N1/egn' || doc_id AS path, source AS shot, CASE WHEN doc_id % 9 = 0 THEN 'datcon' ELSE 'mode' END AS k, strlen(text)::BIGINT AS size, sha256(text) AS sha FROM documents WHERE lang NOT IN ('fr', 'de')),
b AS (SELECT source || '/N1/egn' || doc_id AS path, source AS shot, CASE WHEN doc_id % 9 = 0 THEN 'datcon' ELSE 'mode' END AS k, strlen(text)::BIGINT + CASE WHEN source IN ('src1', 'src2') THEN 1 ELSE 0 END AS size, sha256(text || CASE WHEN source IN ('src1', 'src2') THEN 'x' ELSE '' END) AS sha FROM documents WHERE lang NOT IN ('es', 'de')),
l AS (SELECT source || '/N1/egn' || d.doc_id AS path, source AS shot, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS label FROM documents d JOIN labels USING (doc_id)),
mf AS (SELECT coalesce(a.path, b.path, l.path) AS path, coalesce(a.shot, b.shot, l.shot) AS shot, coalesce(a.k, b.k, 'mode') AS file_kind, l.path IS NOT NULL AS in_training_csv, coalesce(label, '') AS training_label, CASE WHEN a.sha IS NOT NULL AND b.sha IS NOT NULL THEN CASE WHEN a.sha = b.sha THEN 'identical' ELSE 'different' END WHEN a.sha IS NOT NULL THEN 'training_only' WHEN b.sha IS NOT NULL THEN 'reference_only' ELSE 'missing_both' END AS status, a.size AS training_size, b.size AS reference_size, a.sha AS training_sha256, b.sha AS reference_sha256 FROM a FULL JOIN b ON a.path = b.path FULL JOIN l ON l.path = coalesce(a.path, b.path))"""


def _manifest(spark, d):
    docs = D.table(spark, d, "documents")
    path = F.concat("source", F.lit("/N1/egn"), F.col("doc_id").cast("string"))
    tree = lambda rows, text: rows.select(path.alias("path"), F.col("source").alias("shot"), F.when(F.col("doc_id") % 9 == 0, "datcon").otherwise("mode").alias("file_kind"), F.octet_length(text).cast("long").alias("size"), F.sha2(text, 256).alias("sha256"))
    ours = tree(docs.where("lang not in ('fr', 'de')"), F.col("text"))
    theirs = tree(docs.where("lang not in ('es', 'de')"), F.concat("text", F.when(F.col("source").isin("src1", "src2"), "x").otherwise("")))
    listed = docs.join(D.table(spark, d, "labels"), "doc_id").select(path.alias("path"), F.col("source").alias("shot"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"))
    return R.manifest(ours, theirs, listed)


@query(f"WITH {TREES} SELECT * FROM mf")
def provenance_manifest(spark, d):
    return _manifest(spark, d)


_PS = ", ".join([f"count(*) FILTER (WHERE file_kind = 'mode' AND status = '{s}') AS mode_{s}" for s in ("identical", "different", "training_only", "reference_only", "missing_both")] + [f"count(*) FILTER (WHERE file_kind = 'datcon' AND status = '{s}') AS datcon_{s}" for s in ("identical", "different", "training_only", "reference_only")])


@query(f"WITH {TREES}, p AS (SELECT shot, count(*) FILTER (WHERE in_training_csv) AS canonical_rows, count(*) FILTER (WHERE in_training_csv AND status = 'missing_both') AS canonical_missing_both, {_PS} FROM mf GROUP BY 1) SELECT *, CASE WHEN mode_different + mode_training_only + mode_reference_only + mode_missing_both > 0 AND datcon_different + datcon_training_only + datcon_reference_only > 0 THEN 'mode_and_continuum_mismatch' WHEN mode_different + mode_training_only + mode_reference_only + mode_missing_both > 0 THEN 'mode_mismatch' WHEN datcon_different + datcon_training_only + datcon_reference_only > 0 THEN 'continuum_mismatch' ELSE 'active_payload_aligned' END AS overall_status FROM p")
def provenance_summary(spark, d):
    return R.provenance_summary(_manifest(spark, d))


@query("""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 41 = 0 THEN 'k1' ELSE 'k' || doc_id END AS key, sha256(text) AS fp, CASE WHEN doc_id % 6 = 0 THEN 'INVALID' WHEN doc_id % 3 = 0 THEN 'BAD' ELSE 'REVIEW' END AS dec, source, lang FROM documents),
o AS (SELECT key, CASE WHEN doc_id % 10 = 5 THEN 'stale' ELSE fp END AS fp, CASE WHEN doc_id % 4 = 0 THEN 'G' WHEN doc_id % 4 = 2 THEN '' ELSE 'bad' END AS md FROM r WHERE source IN ('src0', 'src1', 'src2') UNION ALL SELECT key, fp, 'good' FROM r WHERE source = 'src1' AND lang <> 'en'),
g AS (SELECT key, count(*) AS n, any_value(fp) AS fp, any_value(md) AS md FROM o WHERE md <> '' GROUP BY 1), k AS (SELECT key, count(*) AS n FROM r GROUP BY 1),
x AS (SELECT doc_id, dec, g.md, CASE WHEN g.n IS NULL THEN CASE WHEN dec <> 'INVALID' THEN 'NOT_PRESENT' ELSE '' END WHEN k.n <> 1 OR g.n <> 1 THEN 'AMBIGUOUS_OVERRIDE' WHEN g.fp <> r.fp THEN 'STALE_FINGERPRINT' WHEN dec = 'INVALID' THEN 'INELIGIBLE_DECISION' ELSE 'APPLIED' END AS override_status FROM r JOIN k USING (key) LEFT JOIN g USING (key))
SELECT doc_id, override_status, CASE WHEN override_status = 'APPLIED' THEN CASE WHEN md = 'bad' THEN 'BAD' ELSE 'GOOD' END ELSE dec END AS final_decision FROM x""")
def override_join(spark, d):
    i = F.col("doc_id")
    rows = D.table(spark, d, "documents").select("doc_id", F.when(i % 41 == 0, "k1").otherwise(F.concat(F.lit("k"), i.cast("string"))).alias("mode_key"), F.sha2("text", 256).alias("input_fingerprint"), F.when(i % 6 == 0, "INVALID").when(i % 3 == 0, "BAD").otherwise("REVIEW").alias("rule_decision"), "source", "lang")
    one = rows.where("source in ('src0', 'src1', 'src2')").select("mode_key", F.when(i % 10 == 5, "stale").otherwise(F.col("input_fingerprint")).alias("input_fingerprint"), F.when(i % 4 == 0, "G").when(i % 4 == 2, "").otherwise("bad").alias("manual_decision"))
    two = rows.where("source = 'src1' and lang <> 'en'").select("mode_key", "input_fingerprint", F.lit("good").alias("manual_decision"))
    return R.apply_overrides(rows, one.unionByName(two)).select("doc_id", "override_status", "final_decision")


_RULE_JSON = lambda key: f"(SELECT '{{' || string_agg('\"' || {key} || '\":' || c, ',' ORDER BY {key}) || '}}' FROM (SELECT {key}, count(*) AS c FROM e x WHERE x.shot = o.shot AND x.of_n IS NOT DISTINCT FROM o.n AND {key} <> '' GROUP BY 1))"
_RULE_COUNTS = {
    "n_invalid": "final_decision = 'INVALID'", **{f"n_{g}": f"gap_region = '{g}'" for g in ("tae_like", "mixed", "eae_like")}, "n_rule_evaluated": "sound", **{f"n_preliminary_{x.lower()}": f"sound AND rule_decision = '{x}'" for x in ("BAD", "REVIEW", "GOOD", "INVALID")},
    **{f"n_final_{x.lower()}": f"final_decision = '{x}'" for x in ("BAD", "REVIEW")}, "n_final_good_before_clustering": "final_decision = 'GOOD'", "n_final_good": "final_decision = 'GOOD' AND doc_id % 2 = 0",
    "n_overrides_applied": "override_status = 'APPLIED'", "n_stale_overrides": "override_status = 'STALE_FINGERPRINT'", "n_ambiguous_overrides": "override_status = 'AMBIGUOUS_OVERRIDE'", "n_ineligible_overrides": "override_status = 'INELIGIBLE_DECISION'", "n_decisions_changed": "transition <> ''", "n_good_removed_as_duplicates": "final_decision = 'GOOD' AND doc_id % 2 = 1",
}


@query(SC + f""", ov AS ({ORACLES['override_join']}), j AS (SELECT s.*, ov.* EXCLUDE (doc_id), CASE WHEN s.doc_id % 6 = 0 THEN 'INVALID' WHEN s.doc_id % 3 = 0 THEN 'BAD' ELSE 'REVIEW' END AS rule_decision, CASE WHEN s.doc_id % 6 = 0 THEN 'RULE_INPUT_INVALID' WHEN s.doc_id % 3 = 0 THEN 'BAD_CONT_CROSS' ELSE 'NO_GOOD_TEMPLATE' END AS primary_reason FROM s JOIN ov USING (doc_id)),
 k AS (SELECT *, rejection_reason = '' AS sound, CASE WHEN rejection_reason <> '' THEN rejection_reason ELSE primary_reason END AS reason, CASE WHEN override_status = 'APPLIED' AND rule_decision IS DISTINCT FROM final_decision THEN rule_decision || '->' || final_decision ELSE '' END AS transition FROM j),
 e AS (SELECT *, NULL::INTEGER AS of_n FROM k UNION ALL SELECT *, n FROM k),
 o AS (SELECT shot, of_n AS n, count(*) AS n_total_files, {', '.join(f"count(*) FILTER (WHERE {c}) AS {name}" for name, c in _RULE_COUNTS.items())} FROM e GROUP BY 1, 2)
 SELECT o.*, coalesce({_RULE_JSON('transition')}, '{{}}') AS transition_counts_json, coalesce({_RULE_JSON('reason')}, '{{}}') AS primary_reason_counts_json, 0::BIGINT AS n_unmatched_overrides FROM o""")
def rule_summary(spark, d):
    i = F.col("doc_id")
    rows = D.scores(spark, d).join(override_join(spark, d), "doc_id").withColumns({"ntor": F.col("n"), "rule_decision": F.when(i % 6 == 0, "INVALID").when(i % 3 == 0, "BAD").otherwise("REVIEW"), "selected": (F.col("final_decision") == "GOOD") & (i % 2 == 0)})
    return S.rule_summary(rows.withColumn("primary_reason", F.when(i % 6 == 0, "RULE_INPUT_INVALID").when(i % 3 == 0, "BAD_CONT_CROSS").otherwise("NO_GOOD_TEMPLATE")).drop("n"))


@query("WITH s AS (SELECT doc_id FROM documents WHERE lang <> 'de'), l AS (SELECT doc_id FROM labels) SELECT count(*) FILTER (WHERE s.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS matched, count(*) FILTER (WHERE l.doc_id IS NULL) AS unmatched_scored, count(*) FILTER (WHERE s.doc_id IS NULL) AS labeled_not_scored FROM s FULL JOIN l ON s.doc_id = l.doc_id")
def label_match(spark, d):
    return R.label_match(D.table(spark, d, "documents").where("lang <> 'de'"), D.table(spark, d, "labels"), "doc_id")


@query("SELECT source, arg_max(lang, doc_id) AS lang, count(*) AS n_rows, min(doc_id) AS first_seq FROM documents GROUP BY 1")
def label_last_wins(spark, d):
    return R.last_wins(D.table(spark, d, "documents"), "source", "lang", "doc_id")


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'de') ORDER BY 1 LIMIT 20")
def unmatched_labels(spark, d):
    """A report of the first 20."""
    return D.table(spark, d, "labels").select("doc_id").join(D.table(spark, d, "documents").where("lang <> 'de'"), "doc_id", "left_anti").orderBy("doc_id").limit(20)


@query("SELECT doc_id, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS old_label, CASE toxic WHEN 1 THEN 'bad' ELSE 'good' END AS new_label FROM labels WHERE (quality = 1) <> (toxic <> 1)")
def label_changes(spark, d):
    y = D.table(spark, d, "labels")
    name = lambda c: F.when(c, "good").otherwise("bad").alias("label")
    return R.label_changes(y.select("doc_id", name(F.col("quality") == 1)), y.select("doc_id", name(F.col("toxic") != 1)), "doc_id")


@query("WITH a AS (SELECT doc_id, quality FROM labels WHERE toxic = 0), b AS (SELECT doc_id, toxic FROM labels WHERE quality = 1) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, quality AS first_label, toxic AS second_label, CASE WHEN quality <> toxic THEN 'conflict' WHEN quality IS NULL OR toxic IS NULL THEN 'missing' ELSE 'agree' END AS disagreement FROM a FULL JOIN b ON a.doc_id = b.doc_id")
def label_disagreements(spark, d):
    y = D.table(spark, d, "labels")
    return R.label_disagreements({"first": y.where("toxic = 0").select("doc_id", F.col("quality").alias("label")), "second": y.where("quality = 1").select("doc_id", F.col("toxic").alias("label"))}, "doc_id")


@query("SELECT source, coalesce(nullif(CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END, ''), '<blank>') AS label, count(*) AS n FROM documents GROUP BY 1, 2")
def label_groups(spark, d):
    label = F.coalesce(F.nullif(F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("lang")), F.lit("")), F.lit("<blank>"))
    return D.table(spark, d, "documents").groupBy("source", label.alias("label")).agg(F.count("*").alias("n"))


@query(SC + FUSED + ", t AS (SELECT y, CASE WHEN final_label = 'bad' THEN 'BAD' ELSE 'REVIEW' END AS d FROM ff WHERE y IS NOT NULL), c AS (SELECT count(*) AS n, count(*) FILTER (WHERE d = 'BAD' AND y = 0) AS bad_found, count(*) FILTER (WHERE d <> 'BAD' AND y = 1) AS good_kept, count(*) FILTER (WHERE y = 0) AS n_bad, count(*) FILTER (WHERE y = 1) AS n_good, count(*) FILTER (WHERE d <> 'BAD') AS n_left FROM t) SELECT *, round((bad_found + good_kept) / n::DOUBLE, 6) AS agreement, round(bad_found / n_bad::DOUBLE, 6) AS bad_recall, round(good_kept / n_good::DOUBLE, 6) AS good_retention, round(good_kept / n_left::DOUBLE, 6) AS good_precision FROM c")
def rule_label_matrix(spark, d):
    rows = _fused(spark, d).withColumn("decision", F.when(F.col("final_label") == "bad", "BAD").otherwise("REVIEW"))
    out = S.rule_matrix(rows, "decision", "y")
    return out.select(*(r6(c) if c in ("agreement", "bad_recall", "good_retention", "good_precision") else F.col(c) for c in out.columns))


@query("WITH m AS (SELECT vec_id FROM embeddings WHERE vec_id % 7 = 0 OR vec_id % 5 = 0) SELECT count(*) AS n_changed, 0::BIGINT AS n_shape, round(median(CASE WHEN vec_id % 5 = 0 THEN 0.1e0 ELSE 0e0 END), 6) AS median_abs_relative_omega, 0.1e0 AS max_abs_relative_omega, 0.25e0 AS max_abs_delta FROM m")
def changed_modes(spark, d):
    out = R.changed_modes(mode_diff(spark, d))
    return out.select("n_changed", "n_shape", *map(r6, ("median_abs_relative_omega", "max_abs_relative_omega", "max_abs_delta")))


@query("SELECT doc_id, source || '/N1/egn' || doc_id AS path FROM documents JOIN labels USING (doc_id)")
def list_filter(spark, d):
    """Files that a list of other absolute paths names by their last three parts."""
    path = F.concat("source", F.lit("/N1/egn"), F.col("doc_id").cast("string")).alias("path")
    docs = D.table(spark, d, "documents")
    listed = docs.join(D.table(spark, d, "labels").select("doc_id"), "doc_id").select(F.concat(F.lit("/other/root/"), path).alias("path"))
    return R.in_list(docs.select("doc_id", path), listed)


# --- labels, paths, resumption ----------------------------------------------------------------------

TOKENS = ("good", " G ", "1", "BAD", "b", "0 ", "Review", " r", "", "unknown", "gOOd", "2")


def _tokens(spark, d):
    k = F.col("doc_id") % (len(TOKENS) + 1)
    return D.table(spark, d, "documents").select("doc_id", F.get(F.array(*map(F.lit, TOKENS)), k.cast("int")).alias("token"))


@query("WITH t AS (SELECT doc_id, lower(trim(" + str(list(TOKENS)) + """[(doc_id % 13 + 1)::INTEGER])) AS v FROM documents) SELECT doc_id, CASE WHEN v IN ('good', 'g', '1') THEN 1 WHEN v IN ('bad', 'b', '0') THEN 0 END AS label,
 CASE WHEN v IN ('good', 'g') THEN 'GOOD' WHEN v IN ('bad', 'b') THEN 'BAD' WHEN v IN ('review', 'r') THEN 'REVIEW' END AS decision FROM t""")
def label_tokens(spark, d):
    return _tokens(spark, d).select("doc_id", R.binary_label(F.col("token")).alias("label"), R.decision(F.col("token")).alias("decision"))


def _paths(spark, d):
    i = F.col("doc_id")
    tail = F.concat(F.col("source"), F.lit("/"), F.when(i % 7 == 3, "M").otherwise("n"), (i % 9).cast("string"), F.lit("/egn"), i.cast("string"))
    return D.table(spark, d, "documents").select("doc_id", F.col("source").alias("shot"), F.concat(F.when(i % 5 == 0, "/a/b/").when(i % 5 == 1, "").otherwise("runs/"), tail).alias("path"))


_PATHS = "p AS (SELECT doc_id, source, source || '/' || CASE WHEN doc_id % 7 = 3 THEN 'M' ELSE 'n' END || doc_id % 9 || '/egn' || doc_id AS tail FROM documents)"


@query(f"WITH {_PATHS} SELECT doc_id, CASE WHEN doc_id % 7 <> 3 THEN tail END AS mode_key, tail AS shot_relative FROM p")
def path_keys(spark, d):
    return _paths(spark, d).select("doc_id", R.mode_key(F.col("path")).alias("mode_key"), R.shot_relative(F.col("path"), F.col("shot")).alias("shot_relative"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def resume_rows(spark, d):
    """Rows without an entry in a log whose paths lie under another root."""
    logged = D.table(spark, d, "labels").where("toxic = 0").select("doc_id")
    done = _paths(spark, d).join(logged, "doc_id").select(F.concat(F.lit("/log/"), F.array_join(F.slice(F.split("path", "/"), -3, 3), "/")).alias("path"))
    return R.not_done(_paths(spark, d), done).select("doc_id")


@query(SC + ", c AS (SELECT unnest([{'name': 'p_rf', 'v': p_rf}, {'name': 'p_cnn', 'v': CASE WHEN doc_id % 17 <> 0 THEN p_cnn END}]) AS c FROM s) SELECT c.name AS name, round(avg(c.v), 6) AS mean, round(stddev_pop(c.v) + 1e-6, 6) AS deviation FROM c GROUP BY 1 UNION ALL SELECT 'n', 0e0, 1e0")
def scalar_stats(spark, d):
    """Means and deviations of the finite values; of the last column none are taken."""
    i = F.col("doc_id")
    s = D.scores(spark, d).withColumn("p_cnn", F.when(i % 17 != 0, F.col("p_cnn")).when(i % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf"))))
    rows = [(k, float(m), float(v)) for k, (m, v) in ml.scalar_stats(s, ["p_rf", "p_cnn", "n"]).items()]
    return spark.createDataFrame(rows, "name string, mean double, deviation double").select("name", r6("mean"), r6("deviation"))
