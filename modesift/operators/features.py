"""Mode features, validation and gap routing: DataFrame in, DataFrame out, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A

ABSENT = 1e30


def with_energy(df: DataFrame) -> DataFrame:
    """Adds W and the radial grid once, for all features that use them."""
    return df.withColumns({"w": A.radial_energy(F.col("mode")), "r": A.grid(F.col("nr"))})


def radial(df: DataFrame) -> DataFrame:
    """w_sum, rad_loc and rad_width."""
    d = with_energy(df) if "w" not in df.columns else df
    d = d.withColumn("rad_loc", A.centroid(F.col("w"), F.col("r")))
    return d.withColumns({"w_sum": A.total(F.col("w")), "rad_width": A.spread(F.col("w"), F.col("r"), F.col("rad_loc"))})


def structure(df: DataFrame, top: int = 32) -> DataFrame:
    """Roughness statistics over all cells and over the ``top`` harmonics of largest amplitude."""
    mode = F.col("mode")
    d = df.withColumn("abs_all", F.flatten(F.transform(mode, A.absolute)))
    d = d.withColumns({
        "mean_amp": A.mean(F.col("abs_all")), "std_amp": A.population_std(F.col("abs_all")), "median_amp": A.median(F.col("abs_all")), "max_amp": F.array_max("abs_all"),
        "d1": A.flat(mode, A.differences), "d2": A.flat(mode, lambda row: A.differences(A.differences(row))),
        "d1_abs": A.flat(mode, lambda row: A.differences(A.absolute(row))), "d2_abs": A.flat(mode, lambda row: A.differences(A.differences(A.absolute(row)))),
        "per_m": F.reverse(F.array_sort(F.transform(mode, lambda row: F.struct(F.array_max(A.absolute(row)).alias("top"), A.mean(A.absolute(row)).alias("mid"))))),
    })
    tops, mids = F.transform(F.slice("per_m", 1, top), lambda x: x["top"]), F.transform(F.slice("per_m", 1, top), lambda x: x["mid"])
    spikes = F.size(F.filter("abs_all", lambda x: x > F.col("median_amp") + 4 * F.col("std_amp")))
    return d.withColumns({
        "max_to_mean": F.col("max_amp") / (F.col("mean_amp") + 1e-12), "max_to_median": F.col("max_amp") / (F.col("median_amp") + 1e-12),
        "mean_abs_d1_mode": A.mean(A.absolute(F.col("d1"))), "max_abs_d1_abs": F.array_max(A.absolute(F.col("d1_abs"))),
        "mean_abs_d2_mode": A.mean(A.absolute(F.col("d2"))), "max_abs_d2_abs": F.array_max(A.absolute(F.col("d2_abs"))),
        "std_per_m_max": A.population_std(tops), "max_per_m_mean": F.array_max(mids), "std_per_m_mean": A.population_std(mids),
        "spikes_per_m": spikes / F.col("nhar"), "frac_spikes": spikes / F.size("abs_all"),
    }).drop("abs_all", "d1", "d2", "d1_abs", "d2_abs", "per_m", "median_amp", "max_amp")


def upper_gap(df: DataFrame) -> DataFrame:
    """signed_delta and fraction_below_upper2 relative to the upper boundary; NULL without overlap or weight."""
    pairs = F.filter(F.zip_with("w", "high2", lambda w, h: F.struct(w.alias("w"), (F.sqrt(h) - F.col("omega")).alias("d"), (h >= 0).alias("ok"))), lambda p: p["ok"] & p["w"].isNotNull())
    d = with_energy(df) if "w" not in df.columns else df
    d = d.withColumn("gap_pairs", pairs)
    weight = A.total(F.transform("gap_pairs", lambda p: p["w"]))
    middle = F.try_divide(A.total(F.transform("gap_pairs", lambda p: p["w"] * p["d"])), weight)
    rms = F.sqrt(F.try_divide(A.total(F.transform("gap_pairs", lambda p: p["w"] * p["d"] * p["d"])), weight))
    below = F.try_divide(A.total(F.transform("gap_pairs", lambda p: F.when(p["d"] > 0, p["w"]).otherwise(0.0))), weight)
    ok = (F.size("gap_pairs") > 0) & (weight > 0)
    return d.withColumns({"signed_delta": F.when(ok, F.when(rms <= 0, F.lit(0.0)).otherwise(F.try_divide(middle, rms))), "fraction_below_upper2": F.when(ok, F.least(F.greatest(below, F.lit(0.0)), F.lit(1.0)))}).drop("gap_pairs")


def route(df: DataFrame, tae_fraction: float = 0.5, eae_fraction: float = 0.4, eae_delta: float = -0.1) -> DataFrame:
    """gap_region: strict comparisons, everything between is mixed; NULL without scalars."""
    if not 0 <= eae_fraction <= tae_fraction <= 1:
        raise ValueError("need 0 <= eae_fraction <= tae_fraction <= 1")
    f, d = F.col("fraction_below_upper2"), F.col("signed_delta")
    region = F.when(f.isNull(), None).when(f > tae_fraction, "tae_like").when((f < eae_fraction) & (d < eae_delta), "eae_like").otherwise("mixed")
    return df.withColumn("gap_region", region)


def validate(df: DataFrame) -> DataFrame:
    """rejection_reason: the first check that fails, '' if none. Needs mode, omega, gamma_d, ntor, nr, nhar, expected_n."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    cells = F.flatten("mode")
    weight = A.total(F.transform(cells, lambda x: x * x))
    reason = (
        F.when(F.col("mode").isNull(), "mode_load_failed")
        .when((F.size("mode") < 1) | (F.size(F.get("mode", F.lit(0))) < 1) | bad(F.col("omega")) | bad(F.col("gamma_d")) | F.col("ntor").isNull(), "invalid_metadata")
        .when(F.col("ntor") != F.col("expected_n"), "ntor-N_mismatch")
        .when(F.col("nhar") < 4 * F.col("ntor"), "too_small_nhar")
        .when(F.exists(cells, bad), "nonfinite_mode_data")
        .when(bad(weight) | (weight <= 0), "invalid_weights")
        .otherwise("")
    )
    return df.withColumn("rejection_reason", reason)


def continuum_scalars(df: DataFrame, alpha: float = 1.0, energy_tie: bool = False) -> DataFrame:
    """Distances from the band, its nearest radius and the energy near that; defaults without a valid radius."""
    d = radial(df)
    rw = F.col("rad_width") + 1e-12
    d = d.withColumn("dist2", F.coalesce(A.band_distance(F.col("omega") * F.col("omega"), F.col("low2"), F.col("high2")), F.array().cast("array<double>")))
    known = F.exists("dist2", lambda x: x.isNotNull())
    least = F.array_min("dist2")
    first = F.get("r", A.first_at(F.col("dist2"), F.col("delta2_min")))
    if energy_tie:
        tied = F.filter(F.zip_with(F.arrays_zip("w", "r"), "dist2", lambda p, x: F.struct(F.when(x == F.col("delta2_min"), p["w"]).alias("w"), p["r"].alias("r"))), lambda p: p["w"].isNotNull())
        first = F.array_max(tied)["r"]
    d = d.withColumn("delta2_min", F.when(known, least))
    d = d.withColumn("r_star", F.when(known, first).otherwise(F.col("rad_loc")))
    near = A.total(F.zip_with("w", "r", lambda w, r: F.when(F.abs(r - F.col("r_star")) <= alpha * rw, w).otherwise(0.0)))
    whole = F.col("w_sum") + A.TINY
    d = d.withColumns({
        "has_intersection": F.when(known & (F.col("delta2_min") == 0), 1.0).otherwise(0.0), "delta2_eff": F.when(known, A.dot(F.col("dist2"), F.col("w")) / whole).otherwise(ABSENT),
        "S": F.when(known, F.abs(F.col("r_star") - F.col("rad_loc")) / rw).otherwise(ABSENT), "W_star": F.when(known, near / whole).otherwise(0.0),
    })
    return d.withColumn("delta2_min", F.coalesce("delta2_min", F.lit(ABSENT))).drop("dist2")


def crossing_records(df: DataFrame, shear_from: float = 0.2) -> DataFrame:
    """crossings: the low boundary's records in radial order, then the high one's."""
    d = with_energy(df) if "w" not in df.columns else df
    peak = A.once(F.array_max("w") + A.TINY, lambda top: F.transform("w", lambda x: x / top))
    valid = F.zip_with("low2", "high2", lambda lo, hi: lo.isNotNull() & hi.isNotNull())
    omega2 = F.col("omega") * F.col("omega")
    both = lambda v: F.concat(*(A.crossings(name, F.transform(c, lambda b: omega2 - b), v["valid"], v["r"], v["w_peak"], shear_from) for name, c in (("low", "low2"), ("high", "high2"))))
    none = F.array().cast("array<struct<boundary:string,r_cross:double,W_peak:double,shear_weighted:double>>")
    return d.withColumn("crossings", F.coalesce(A.once(F.struct(peak.alias("w_peak"), valid.alias("valid"), F.col("r").alias("r")), both), none))


def crossing_summary(df: DataFrame, shear_from: float = 0.2, null_missing: bool = False) -> DataFrame:
    """Seven features of the crossings; ties for a maximum go to the larger radius. Without any they are
    zeros; with null_missing the two radii are NULL then."""
    d = crossing_records(df, shear_from) if "crossings" not in df.columns else df
    best = lambda name: F.array_max(F.transform("crossings", lambda x: F.struct(x[name].alias("v"), x["r_cross"].alias("r"))))
    zero, at = F.lit(0.0), F.lit(None if null_missing else 0.0).cast("double")
    return d.withColumns({
        "n_cross": F.size("crossings"), "r_star_max": F.coalesce(best("W_peak")["r"], at), "W_star_max": F.coalesce(best("W_peak")["v"], zero), "W_star_sum": A.total(F.transform("crossings", lambda x: x["W_peak"])),
        "r_star_high_shear": F.coalesce(best("shear_weighted")["r"], at), "W_star_high_shear": F.coalesce(best("shear_weighted")["v"], zero), "W_star_high_shear_sum": A.total(F.transform("crossings", lambda x: x["shear_weighted"])),
    })


def secondary_crossing(df: DataFrame, beyond: float = 0.03) -> DataFrame:
    """W_secondary: the largest W_peak of the crossings more than ``beyond`` from the matched extremum's
    radius ext_r; 0 without any, NULL without an extremum."""
    d = crossing_records(df) if "crossings" not in df.columns else df
    other = F.filter("crossings", lambda x: F.abs(x["r_cross"] - F.col("ext_r")) > beyond)
    return d.withColumn("W_secondary", F.when(F.col("ext_r").isNotNull(), F.coalesce(F.array_max(F.transform(other, lambda x: x["W_peak"])), F.lit(0.0))))


def star_interactions(df: DataFrame, keys: list[str], r_star: float = 0.02, w_star: float = 0.30) -> DataFrame:
    """Modes and interactions (the legacy r_star at the inner boundary, much energy about it) by keys."""
    hit = (F.col("r_star") <= r_star) & (F.col("W_star") >= w_star)
    return df.groupBy(*keys).agg(F.count("*").alias("n_modes"), F.count_if(F.coalesce(hit, F.lit(False))).alias("n_interaction"))


def cross_window(df: DataFrame, half_width: int = 2) -> DataFrame:
    """Largest amplitude and energy within ``half_width`` grid cells of any crossing (inclusive), with the
    sample's radius; NULL without crossings. Ties keep the low boundary, then the smaller radius."""
    d = crossing_records(df) if "crossings" not in df.columns else df
    step = 1 / (F.col("nr") - 1)
    reach = half_width * step + 64 * 2.220446049250313e-16
    tallest = F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda i: F.array_max(F.transform("mode", lambda row: F.abs(F.get(row, i)))))
    top = F.array_max("w")
    samples = F.zip_with(F.zip_with(tallest, "w", lambda a, w: F.struct(a.alias("a"), F.coalesce(F.try_divide(w, top), F.lit(0.0)).alias("w"))), "r", lambda p, r: F.struct(p["a"].alias("a"), p["w"].alias("w"), r.alias("r")))
    near = F.flatten(F.transform("crossings", lambda c: F.transform(F.filter(samples, lambda s: F.abs(s["r"] - c["r_cross"]) <= reach), lambda s: F.struct(s["a"].alias("a"), s["w"].alias("w"), s["r"].alias("r"), F.when(c["boundary"] == "low", 0).otherwise(1).alias("b"), c["r_cross"].alias("c")))))
    d = d.withColumn("near", near)
    win = lambda v: F.array_min(F.transform("near", lambda s: F.struct((-s[v]).alias("v"), s["b"].alias("b"), s["c"].alias("c"), s["r"].alias("r"))))
    name = lambda b: F.when(b == 0, "low").when(b == 1, "high")
    a, w = win("a"), win("w")
    return d.withColumns({
        "cross_window_A_max": -a["v"], "cross_window_A_sample_r": a["r"], "cross_window_A_boundary": name(a["b"]), "cross_window_A_distance_grid": F.abs(a["r"] - a["c"]) / step,
        "cross_window_W_max": -w["v"], "cross_window_W_sample_r": w["r"], "cross_window_W_boundary": name(w["b"]), "cross_window_W_distance_grid": F.abs(w["r"] - w["c"]) / step,
    }).drop("near")


RF_FEATURES = (
    "mean_amp", "std_amp", "rad_loc", "rad_width", "max_to_mean", "max_to_median", "mean_abs_d1_mode", "max_abs_d1_abs", "mean_abs_d2_mode", "max_abs_d2_abs", "std_per_m_max",
    "max_per_m_mean", "std_per_m_mean", "spikes_per_m", "frac_spikes", "gamma_d", "ntor", "r_star", "delta2_eff", "S", "W_star", "W_star_max",
)
CROSSING_FEATURES = ("n_cross", "r_star_max", "W_star_sum", "r_star_high_shear", "W_star_high_shear", "W_star_high_shear_sum")
EXTREMUM_FEATURES = ("ext_dr", "ext_df_gap", "ext_energy_frac")


# Fixed names of the feature schemas by (with crossings, with extremum).
SCHEMAS = {(False, False): "rf_w_star_max_22_v2", (True, False): "rf_all_crossings_28_v2", (False, True): "rf_extremum_energy_25_v2", (True, True): "rf_all_crossings_extremum_energy_31_v2"}
ENERGY_TIE_SUFFIX = "_rstar_energy_tie_v1"


def feature_names(crossing: bool = False, extremum: bool = False) -> tuple[str, ...]:
    return RF_FEATURES + CROSSING_FEATURES * crossing + EXTREMUM_FEATURES * extremum


def schema_version(crossing: bool = False, extremum: bool = False, energy_tie: bool = False) -> str:
    return SCHEMAS[crossing, extremum] + ENERGY_TIE_SUFFIX * energy_tie


def feature_vector(df: DataFrame, crossing: bool = False, extremum: bool = False, energy_tie: bool = False, alpha: float = 1.0) -> DataFrame:
    """features: the 22, 25, 28 or 31 named values in order as doubles. Without a boundary profile the
    continuum ones take their fallbacks 0, 1e30, 1e30, 0 and 0, without a matched extremum its three take
    1, 1 and 0. energy_tie: among equal distances r_star is where the energy is largest. The extremum's
    columns (ext_dr, ext_df_gap, ext_energy_frac) come from ``gates.measure``."""
    if extremum and (lack := set(EXTREMUM_FEATURES) - set(df.columns)):
        raise ValueError(f"{sorted(lack)} must be measured first")
    has = F.col("low2").isNotNull() & F.col("high2").isNotNull()
    d = crossing_summary(continuum_scalars(structure(with_energy(df)), alpha, energy_tie))
    fall = {"r_star": 0.0, "delta2_eff": ABSENT, "S": ABSENT, "W_star": 0.0, "W_star_max": 0.0}
    d = d.withColumns({k: F.when(has, F.col(k)).otherwise(F.lit(v)) for k, v in fall.items()})
    absent = dict(zip(EXTREMUM_FEATURES, (1.0, 1.0, 0.0), strict=True))
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(absent[c])) if c in absent else F.col(c).cast("double")
    return d.withColumn("features", F.array(*(value(c) for c in feature_names(crossing, extremum))))


def topology(df: DataFrame, r_min: float = 0.05, r_max: float = 0.40) -> DataFrame:
    """Shape of the gap between the boundaries low2 and high2 at r_min <= r <= r_max: the median of
    (f_high - f_low) over their mean, the mean of both edges' monotonicity (net change over length of way), and
    the number of maxima of the smoothed lower edge that a minimum of the smoothed upper edge can be paired with.
    The formulae are this library's choice. NULL widths and edges, and no pair, where nothing is known."""
    root = lambda c: F.transform(c, lambda x: F.when(x >= 0, F.sqrt(x)))
    r = A.grid(F.size("low2"))
    known = F.when(F.size("low2") > 1, F.filter(F.zip_with(F.zip_with(root(F.col("low2")), root(F.col("high2")), lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))), r, lambda e, x: F.struct(e["lo"].alias("lo"), e["hi"].alias("hi"), x.alias("r"))), lambda e: (e["r"] >= r_min) & (e["r"] <= r_max)))
    d = df.withColumn("gap_edges", known)
    lo, hi = F.col("gap_edges.lo"), F.col("gap_edges.hi")
    width = F.filter(F.transform("gap_edges", lambda e: F.try_divide(2 * (e["hi"] - e["lo"]), e["hi"] + e["lo"])), lambda x: x.isNotNull())
    pairs = F.least(A.turns(A.smooth5(lo), 1), A.turns(A.smooth5(hi), -1))
    return d.withColumns({
        "gap_width_median": F.when(F.size(width) > 0, A.median(width)), "edge_monotonicity": (A.monotonicity(lo) + A.monotonicity(hi)) / 2, "extremum_pairs": F.coalesce(F.when(F.size("gap_edges") > 0, pairs), F.lit(0)),
    }).drop("gap_edges")


def topology_screen(df: DataFrame, groups: tuple[int, ...] = (6, 7, 8, 9, 10), width: float = 0.25, wavy: float = 0.50) -> DataFrame:
    """A row a shot with any profile of the groups: how many of them are wide, wavy and hold an extremum pair,
    and whether all are. A group without a profile doesn't pass, one with several passes if one does."""
    d = topology(df.where(F.col("n").isin(*groups)))
    suits = (F.col("gap_width_median") >= width) & (F.col("edge_monotonicity") <= wavy) & (F.col("extremum_pairs") >= 1)
    passed = F.count_distinct(F.when(suits, F.col("n")))
    return d.groupBy("shot").agg(F.count_distinct("n").alias("n_groups"), passed.alias("n_suitable"), (passed == len(groups)).alias("passes"))
