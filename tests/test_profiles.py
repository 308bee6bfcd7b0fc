import numpy as np
import pytest

from modesift.functions import profiles as P
from modesift.operators.gates import GateConfig, measure_one

R201 = np.linspace(0, 1, 201)


def flat_mode(n=201, rows=4):
    return np.zeros((rows, n))


def test_axis_single_point():
    m = flat_mode()
    m[2, 2] = 1
    a = P.axis_artifact(m)
    assert a["axis_peak_is_local_max"] and a["axis_peak_harmonic_index"] == 2
    assert (a["axis_peak_r"], a["axis_halfmax_width_grid"]) == (pytest.approx(0.01), pytest.approx(1.0))


def test_axis_window_is_inclusive_and_needs_a_maximum():
    m = flat_mode()
    m[2, 5:8] = [0.7, 1, 0.2]
    assert P.axis_artifact(m)["axis_peak_r"] == pytest.approx(0.03)
    m = flat_mode()
    m[0, :17] = np.linspace(0.1, 0.9, 17)
    assert not P.axis_artifact(m)["axis_peak_is_local_max"]
    m = flat_mode()
    m[0, :9] = [0.8, 0.9, 1, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4]
    a = P.axis_artifact(m)
    assert a["axis_halfmax_outer_edge_r"] == pytest.approx(0.035) and a["axis_halfmax_width_grid"] == pytest.approx(7.0)


def test_grid_spike():
    m = flat_mode()
    m[1, 80], m[1, 81] = 0.7, -0.7
    g = P.grid_spike(m)
    assert (g["grid_scale_peak_sign"], g["grid_scale_peak_r"], g["grid_scale_halfmax_width_grid"]) == (1, pytest.approx(0.4), pytest.approx(0.75))
    m = flat_mode()
    m[0, 50:55] = [0.2, 0.4, 0.6, 0.4, 0.2]
    assert not P.grid_spike(m)["grid_scale_candidate_found"]
    m = flat_mode()
    m[2, -1] = -0.5
    g = P.grid_spike(m)
    assert g["grid_scale_halfmax_width_grid"] == pytest.approx(0.5) and g["grid_scale_component_touches_boundary"]
    assert len(P.signed_peaks(np.array([0.0, 1, 1, 0, -2, 0, 3]))) == 3
    assert len(P.signed_peaks(np.ones(5))) == 0


def test_edge():
    m = flat_mode()
    m[1, 194:199] = [0.4, 0.8, 1, 0.8, 0.4]
    e = P.edge_artifact(m)
    assert e["edge_energy_peak_in_window"] and e["edge_energy_peak_r"] == pytest.approx(0.98)
    assert e["edge_energy_halfmax_width_grid"] == pytest.approx(2.5833333333)
    assert e["edge_harmonic_halfmax_width_grid"] == pytest.approx(3.5)


def gauss(at, width=0.025):
    return np.exp(-(((R201 - at) / width) ** 2))[None, :]


def test_extremum():
    high = (1.2 + 4 * (R201 - 0.2) ** 2) ** 2
    low = np.full(201, 0.25)
    dr, df, energy, ok = P.extremum(gauss(0.2), 1.19, low, high)
    assert ok and dr == pytest.approx(0, abs=1e-12) and df == pytest.approx((1.2 - 1.19) / 1.19) and energy > 0.95
    low = (0.8 - 2 * (R201 - 0.25) ** 2) ** 2
    dr, df, energy, ok = P.extremum(gauss(0.25), 0.81, low, np.full(201, 4.0))
    assert ok and dr == pytest.approx(0, abs=1e-12) and df == pytest.approx((0.81 - 0.8) / 0.81) and energy > 0.95
    dr, _, energy, _ = P.extremum(gauss(0.45), 1.19, np.full(201, 0.25), high)
    assert dr == pytest.approx(0.25) and energy < 1e-6
    _, _, energy, _ = P.extremum(np.concatenate([gauss(0.2), gauss(0.6)]), 1.19, np.full(201, 0.25), high)
    assert 0.45 < energy < 0.51
    assert P.extremum(np.zeros((2, 201)), 1.19, low, high) == (1.0, 1.0, 0.0, False)
    assert P.extremum(gauss(0.2), 1.0, np.full(201, 0.25), np.full(201, 4.0)) == (1.0, 1.0, 0.0, False)


def test_prominence():
    y = np.array([0, 3, 1, 2, 2, 1.5, 5, 0.0])
    assert P.peaks_with_prominence(y) == [(1, 2.0), (3, 0.5), (6, 5.0)]


def test_tail_repair():
    f = np.array([1.0, 1.1, 1.2, 1.3, 1.4, 9, 12, 15.0])
    low, high = P.repair_tail(f**2, (f + 0.2) ** 2)
    assert np.allclose(np.sqrt(low[5:]), f[1:5].mean()) and np.allclose(np.sqrt(high[5:]), (f[1:5] + 0.2).mean())
    assert np.allclose(low[:5], f[:5] ** 2)
    smooth = np.linspace(1, 2, 10)
    assert np.array_equal(P.repair_tail(smooth**2, smooth**2 + 1)[0], smooth**2)
    v = np.array([1, 2, 3, 4, 5, 80, np.nan])
    assert np.isnan(P.trim_tail(v)[5]) and P.trim_tail(v[:-1])[5] == 80
    low, _ = P.clean_boundaries(np.array([1, 2, 1000.0]), np.array([3, 4, 5.0]))
    assert np.isnan(low[2])


def test_ridge_and_straighten():
    m = np.zeros((6, 8))
    m[[1, 1, 2, 2, 3, 3, 4, 4], range(8)] = 1
    c = P.ridge(m)
    assert c.tolist() == [1, 1, 2, 2, 3, 3, 4, 4]
    assert np.allclose(P.ridge_profile(m, c), 1)
    s = P.straighten(m, 2)
    assert s.shape == (5, 8) and np.allclose(s[2], 1) and s.sum() == 8
    m[:, 3] = 0
    assert P.ridge(m)[3] in (2, 3)
    assert P.ridge(np.zeros((6, 4))).tolist() == [0] * 4
    a = P.ridge_profile(m, c)
    assert P.same_type((a, *P.profile_location(a)), (-a, *P.profile_location(a)))


def test_measure_rejects_bad_modes():
    with pytest.raises(ValueError):
        measure_one(np.full((2, 5), np.nan), 1.0, np.ones(5), np.ones(5), GateConfig())
    with pytest.raises(ValueError):
        GateConfig(grid_width=-1)
