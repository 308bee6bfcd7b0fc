import numpy as np
import pytest
from pyspark.sql import functions as F

from modesift import queries as Q
from modesift.functions import arrays as A
from modesift.operators import features as X
from modesift.operators import gates

SCHEMA = "mode_id int, mode array<array<double>>, omega double, gamma_d double, ntor int, nr int, nhar int, low2 array<double>, high2 array<double>"


def frame(spark, *rows):
    return spark.createDataFrame([(i, [[float(v) for v in row] for row in mode], float(omega), 0.01, 1, len(mode[0]), len(mode), low, high) for i, (mode, omega, low, high) in enumerate(rows)], SCHEMA)


def as_w(w):
    return [[float(np.sqrt(x)) for x in w]]


def test_crossings(spark):
    fl = lambda *v: [None if x is None else float(x) for x in v]
    ones = [[1] * 5] * 2
    df = frame(
        spark,
        (as_w([0, 1, 4, 1, 0]), 1, fl(0, 0.5, 1.5, 1.5, 1.5), fl(2, 2, 2, 1, 0)),
        (ones, 1, fl(0, 2, 0, 2, 0), fl(3, 3, 3, 3, 3)),
        ([[1] * 3], 1, fl(0, 1, 2), fl(3, 3, 3)),
        ([[1] * 3], 1, fl(0, None, 2), fl(3, 3, 3)),
        ([[0] * 5] * 2, 1, fl(0, 0, 0, 0, 0), fl(2, 2, 2, 2, 2)),
        ([[1] * 3], 1, fl(0, 2, 0), fl(3, 3, 3)),
        ([[1] * 5], 1, fl(0, 1, 1, 1, 2), fl(3, 3, 3, 3, 3)),
    )
    r = X.crossing_summary(df).orderBy("mode_id").collect()
    # In the first case the high boundary touches omega at r = .75 exactly; energy there is a quarter.
    assert (r[0].n_cross, r[1].n_cross, r[2].n_cross, r[3].n_cross, r[4].n_cross, r[5].n_cross, r[6].n_cross) == (2, 4, 1, 0, 0, 2, 1)
    assert r[0].r_star_max == pytest.approx(0.375) and r[0].W_star_max == pytest.approx(0.625) and r[0].W_star_sum == pytest.approx(0.875)
    assert r[0].r_star_high_shear == pytest.approx(0.75) and r[0].W_star_high_shear == pytest.approx(0.25 * 0.55**2)
    assert r[1].W_star_sum == pytest.approx(4) and r[1].r_star_max == pytest.approx(0.875)
    assert r[2].crossings[0].r_cross == pytest.approx(0.5) and r[6].crossings[0].r_cross == pytest.approx(0.5)
    assert r[5].r_star_max == pytest.approx(0.75)
    assert r[4].r_star_max == 0 and r[4].W_star_sum == 0


def test_energy_tie(spark):
    df = frame(spark, (as_w([0, 1, 4, 4, 0]), 1, [0.0] * 5, [2.0] * 5))
    first, tied = X.continuum_scalars(df).first(), X.continuum_scalars(df, energy_tie=True).first()
    assert (first.r_star, tied.r_star) == (0, 0.75) and first.delta2_eff == tied.delta2_eff


def test_cross_window(spark):
    m = np.zeros((4, 11))
    m[0, 8], m[0, 4], m[1, 5] = 1, 0.1, -0.3
    low = [0.0] * 4 + [2.0] * 7
    df = frame(spark, (m.tolist(), 1, low, [9.0] * 11))
    one, two = X.cross_window(df, 1).first(), X.cross_window(df, 2).first()
    assert one.crossings[0].r_cross == pytest.approx(0.35)
    assert one.cross_window_A_max == pytest.approx(0.1) and two.cross_window_A_max == pytest.approx(0.3)
    assert two.cross_window_A_sample_r == pytest.approx(0.5) and two.cross_window_A_distance_grid == pytest.approx(1.5) and two.cross_window_W_max == pytest.approx(0.09)


def test_routing_and_validation(spark):
    df = spark.createDataFrame([(0.3, 0.6), (-0.8, 0.2), (0.2, 0.45), (None, None)], "signed_delta double, fraction_below_upper2 double")
    assert [r.gap_region for r in X.route(df).collect()] == ["tae_like", "eae_like", "mixed", None]
    with pytest.raises(ValueError):
        X.route(df, 0.3, 0.4)
    rows = frame(spark, ([[1.0] * 3] * 4, 1, None, None), ([[1.0] * 3] * 3, 1, None, None), ([[0.0] * 3] * 4, 1, None, None), ([[float("nan")] * 3] * 4, 1, None, None), ([[1.0] * 3] * 4, float("inf"), None, None))
    got = [r.rejection_reason for r in X.validate(rows.withColumn("expected_n", F.lit(1))).orderBy("mode_id").collect()]
    assert got == ["", "too_small_nhar", "invalid_weights", "nonfinite_mode_data", "invalid_metadata"]
    assert X.validate(rows.limit(1).withColumn("expected_n", F.lit(2))).first().rejection_reason == "ntor-N_mismatch"


def test_feature_vector_widths_and_fallbacks(spark):
    df = frame(spark, ([[1.0, 2, 3]] * 4, 1, None, None))
    f = X.feature_vector(df).first().features
    assert len(f) == 22 and f[17:] == [0.0, 1e30, 1e30, 0.0, 0.0]
    assert len(X.feature_vector(df, crossing=True).first().features) == 28


def gate_mode(cells=(), n=201):
    r = np.linspace(0, 1, n)
    m = np.stack([(i + 1) * np.exp(-(((r - 0.2) / 0.03) ** 2)) for i in range(4)])
    m /= m.max()
    for h, k, v in cells:
        m[h, k] = v
    return m.tolist(), 1, [0.25] * n, ((0.9 + 4 * (r - 0.2) ** 2) ** 2).tolist()


def test_gates(spark):
    zero = np.zeros((4, 201))
    edge = zero.copy()
    edge[1, 194:199] = [0.4, 0.8, 1, 0.8, 0.4]
    far = [0.01] * 201, [9.0] * 201
    df = frame(spark, gate_mode([(2, 2, 1.0)]), gate_mode([(1, 80, 0.7), (1, 81, -0.7)]), (edge.tolist(), 1, *far), (zero.tolist(), 1, *far), gate_mode([(2, 2, 1.0), (1, 80, 0.7)])).withColumn("gap_region", F.lit("mixed"))
    off = gates.GateConfig(cross_energy=None, window_amplitude=None, window_energy=None)
    evaluate = lambda df, cfg=gates.GateConfig(): gates.evaluate(df, cfg, identity=())
    got = [r.primary_reason for r in evaluate(df, off).orderBy("mode_id").collect()]
    assert got == ["BAD_AXIS_SPIKE", "BAD_GRID_SCALE_SPIKE", "BAD_EDGE_SPIKE", "NO_GOOD_TEMPLATE", "BAD_AXIS_SPIKE"]
    quiet = gates.GateConfig(axis_amplitude=None, grid_amplitude=None, edge_width=None, cross_energy=None, window_amplitude=None, window_energy=None)
    rows = evaluate(df, quiet).orderBy("mode_id").collect()
    assert {r.rule_decision for r in rows} == {"REVIEW"} and rows[0].axis_peak == 1.0
    bad = evaluate(df.withColumn("omega", F.lit(-1.0)), off).first()
    assert (bad.rule_decision, bad.primary_reason) == ("INVALID", "RULE_INPUT_INVALID")
    assert evaluate(frame(spark, gate_mode()).withColumn("gap_region", F.lit("tae_like"))).first().primary_reason == "NO_GOOD_TEMPLATE"
    mode, _, low, high = gate_mode()
    cross = frame(spark, (mode, 0.905, low, high)).withColumn("gap_region", F.lit("tae_like"))
    r = evaluate(cross).first()
    assert r.n_cross > 0 and r.primary_reason == "BAD_CONT_CROSS"
    w = r.W_star_max
    assert evaluate(cross, gates.GateConfig(cross_energy=w, window_amplitude=None, window_energy=None)).first().primary_reason == "NO_GOOD_TEMPLATE"
    assert evaluate(cross, gates.GateConfig(cross_energy=None)).first().primary_reason == "BAD_CONT_CROSS_WINDOW"
    lone = evaluate(df.withColumn("low2", F.lit(None).cast("array<double>")), off).first()
    assert (lone.rule_decision, lone.primary_reason) == ("INVALID", "RULE_FEATURE_EXTRACTION_FAILED") and lone.r_star_max is None and lone.W_star_sum == 0
    named = df.limit(1).withColumns({"path": F.lit("p"), "mode_key": F.lit("k"), "shot": F.lit("s"), "input_fingerprint": F.lit("a" * 64)})
    assert gates.evaluate(named, off).first().primary_reason == "BAD_AXIS_SPIKE"
    for column, value in (("path", ""), ("mode_key", None), ("input_fingerprint", "a" * 63)):
        assert gates.evaluate(named.withColumn(column, F.lit(value).cast("string")), off).first().primary_reason == "RULE_INPUT_INVALID"
    assert gates.evaluate(named.drop("shot"), off).first().primary_reason == "RULE_INPUT_INVALID"


def test_feature_schemas(spark):
    df = frame(spark, (as_w([0, 1, 4, 4, 0]), 1, [0.0] * 5, [2.0] * 5), (as_w([0, 1, 4, 4, 0]), 1, None, None))
    with pytest.raises(ValueError):
        X.feature_vector(df, extremum=True)
    measured = gates.measure(df)
    for crossing in (False, True):
        for extremum in (False, True):
            names = X.feature_names(crossing, extremum)
            for r in X.feature_vector(measured, crossing, extremum).collect():
                assert len(r.features) == len(names) == 22 + 6 * crossing + 3 * extremum and None not in r.features
                if extremum:
                    assert r.features[-3:] == [1.0, 1.0, 0.0]
    at = X.RF_FEATURES.index("r_star")
    first, tied = X.feature_vector(df).first().features[at], X.feature_vector(df, energy_tie=True).first().features[at]
    assert (first, tied) == (0.0, 0.75)
    assert X.schema_version(True, True, True) == "rf_all_crossings_extremum_energy_31_v2_rstar_energy_tie_v1"


def test_secondary_crossing_against_a_loop(spark):
    """A mode with its own root at the extremum, where its energy peaks, has only far crossings as secondary."""
    mode, _, low, high = gate_mode()
    df = frame(spark, (mode, 0.901, low, high), (mode, 1.1, low, high), (mode, 1, [0.25] * 201, [4.0] * 201))
    rows = X.secondary_crossing(X.crossing_summary(X.with_energy(gates.measure(df)))).orderBy("mode_id").collect()
    for r in rows[:2]:
        far = [c.W_peak for c in r.crossings if abs(c.r_cross - r.ext_r) > 0.03]
        assert r.ext_r == pytest.approx(0.2) and r.W_secondary == max(far, default=0.0)
    assert rows[0].W_star_max > 0.05 and rows[0].W_secondary == 0
    assert rows[1].W_secondary > 0 and rows[2].W_secondary is None


def test_star_interactions_against_a_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(as_w(np.exp(-((np.arange(20) - rng.integers(0, 12)) / 3.0) ** 2)), 1, [0.0] * 20, [2.0] * 20 if k % 2 else [0.9] + [2.0] * 19) for k in range(24)]
    m = X.continuum_scalars(frame(spark, *rows)).withColumn("label", F.col("mode_id") % 3).withColumn("regime", F.col("mode_id") % 2)
    want = {}
    for r in m.collect():
        n, hits = want.get((r.label, r.regime), (0, 0))
        want[r.label, r.regime] = n + 1, hits + (r.r_star <= 0.02 and r.W_star >= 0.30)
    got = {(r.label, r.regime): (r.n_modes, r.n_interaction) for r in X.star_interactions(m, ["label", "regime"]).collect()}
    assert got == want and 0 < sum(h for _, h in got.values()) < 24


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_quantile_width_of_long_profiles_computes_each_step_once(spark):
    rng, n = np.random.default_rng(3), 201
    r, profiles = np.linspace(0, 1, n), rng.normal(size=(200, n))
    profiles[0], profiles[1, :-1] = 0, 0
    df = spark.createDataFrame([(i, p.tolist(), r.tolist()) for i, p in enumerate(profiles)], "i int, p array<double>, r array<double>")
    out = df.select("i", A.quantile_width(F.col("p"), F.col("r")).alias("width"))
    # The running sums and the two totals; each was there once for each index that the search looked at.
    assert optimized(out).count("aggregate(") == 3 and optimized(out).count("p#") <= 3
    share = np.cumsum(profiles[1:] ** 2, axis=1) / np.sum(profiles[1:] ** 2, axis=1, keepdims=True)

    def edge(s, q):
        j = np.flatnonzero(s <= q)
        return r[0] if not len(j) else r[-1] if j[-1] == n - 1 else np.interp(q, s[j[-1] : j[-1] + 2], r[j[-1] : j[-1] + 2])

    want = [0.0] + [edge(s, 0.9) - edge(s, 0.1) for s in share]
    assert [x.width for x in out.orderBy("i").collect()] == pytest.approx(want, abs=1e-12)


def test_crossing_records_computes_each_step_once(spark):
    plan = optimized(Q.QUERIES["crossing_records"](spark, "/root/testdata/sf0.001"))
    # The energy of a mode; it was there again, many times, in a filter on the size of the crossings.
    assert plan.count("aggregate(") == 1
    steps = optimized(X.crossing_records(frame(spark, ([[1.0] * 3], 1, [0.0] * 3, [2.0] * 3))).select("crossings"))
    # Each boundary for its crossings, and both for the valid radii.
    assert sum(steps.count(f"transform({c}#") for c in ("low2", "high2")) == 2 and steps.count("array_max(") == 1


def test_crossings_with_a_missing_cell_are_the_same_in_every_plan(spark):
    found = X.crossing_records(frame(spark, ([[1.0] * 4], 1, [0.0, 2.0, 0.0, 2.0], [3.0] * 4)).withColumn("mode", F.expr("array(array(1D, null, 3D, 1D))")))
    assert found.select("crossings").first().crossings == found.select("crossings", "w").first().crossings


def test_crossings_of_long_profiles_against_a_loop(spark):
    rng, n = np.random.default_rng(8), 201
    r, given = np.linspace(0, 1, n), []
    for _ in range(20):
        bounds = [[None if rng.random() < 0.1 else float(x) for x in rng.choice([0.5, 1, 1, 1, 2], size=n)] for _ in range(2)]
        given.append((rng.normal(size=(2, n)).tolist(), 1.0, *bounds))

    def loop(name, low, high, c, w):
        ok = [a is not None and b is not None for a, b in zip(low, high, strict=True)]
        zero = [ok[i] and c[i] == 1 for i in range(n)]
        for i in range(n):
            if zero[i] and not (i and zero[i - 1]):
                end = next((k for k in range(i + 1, n) if not zero[k]), n) - 1
                at = (r[i] + r[end]) / 2
                yield name, at, np.interp(at, r, w)
            elif i + 1 < n and ok[i] and ok[i + 1] and (1 - c[i]) * (1 - c[i + 1]) < 0:
                part = -(1 - c[i]) / (c[i] - c[i + 1])
                yield name, r[i] + part * (r[i + 1] - r[i]), w[i] + part * (w[i + 1] - w[i])

    for x, (mode, _, low, high) in zip(X.crossing_records(frame(spark, *given)).orderBy("mode_id").collect(), given, strict=True):
        w = np.sum(np.square(mode), axis=0)
        want = [y for name, c in (("low", low), ("high", high)) for y in loop(name, low, high, c, w / w.max())]
        assert [y.boundary for y in x.crossings] == [y[0] for y in want] and len(want) > 100
        assert [v for y in x.crossings for v in (y.r_cross, y.W_peak)] == pytest.approx([v for y in want for v in y[1:]], abs=1e-9)
