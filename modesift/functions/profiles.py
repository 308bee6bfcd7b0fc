"""Measurements on one radial profile or mode, in NumPy: what array expressions cannot say plainly.

All take the uniform grid 0..1. Lobes are found for a whole profile at once: values are cut into runs
that are equal within a tolerance, runs into lobes by comparing neighbours, and half-maximum edges by
the first sample below half on either side of the peak.
"""

from __future__ import annotations

import numpy as np

EPS = 64 * np.finfo(float).eps


def half_max(profile: np.ndarray, peak: int) -> tuple[float, float, bool, bool]:
    """Inner and outer radius at half the height of the lobe around ``peak`` (of its own sign), and
    whether the lobe reaches either end of the grid. An edge that is not crossed is the grid's end."""
    n = len(profile)
    p = profile * (1.0 if profile[peak] > 0 else -1.0)
    half = p[peak] / 2
    low = np.flatnonzero(p[:peak] < half)
    high = np.flatnonzero(p[peak + 1 :] < half)
    r = np.linspace(0.0, 1.0, n)

    def cut(below: int, above: int) -> float:
        return r[above] if p[above] == p[below] else r[below] + (half - p[below]) / (p[above] - p[below]) * (r[above] - r[below])

    inner = cut(low[-1], low[-1] + 1) if len(low) else 0.0
    outer = cut(peak + 1 + high[0], peak + high[0]) if len(high) else 1.0
    return float(inner), float(outer), not len(low), not len(high)


def runs(values: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the runs in which each value is within the tolerance of the run's first."""
    first, start = [0], values[0]
    for i in range(1, len(values)):
        if abs(values[i] - start) > tolerance:
            first.append(i)
            start = values[i]
    first = np.array(first)
    return first, np.append(first[1:], len(values)) - 1


def signed_peaks(profile: np.ndarray) -> np.ndarray:
    """Leftmost indices of positive maxima and negative minima, flat tops counted once; an end of the grid
    needs only its one neighbour lower."""
    tol = EPS * max(1.0, float(np.abs(profile).max()))
    first, last = runs(profile, tol)
    if len(first) < 2:
        return np.zeros(0, dtype=int)
    v = profile[first]
    sign = np.where(v > 0, 1.0, -1.0)
    before = np.append(-np.inf, sign[1:] * profile[first[1:] - 1])
    after = np.append(sign[:-1] * profile[last[:-1] + 1], -np.inf)
    top = sign * v
    return first[(np.abs(v) > tol) & (before < top - tol) & (after < top - tol)]


def axis_artifact(mode: np.ndarray, r_ax: float = 0.03) -> dict:
    """The largest amplitude at radii up to r_ax: whether it is a local maximum of its harmonic, and its
    half-maximum width (the inner edge held at the axis)."""
    n = mode.shape[1]
    r = np.linspace(0.0, 1.0, n)
    size = np.abs(mode)
    near_axis = size[:, : np.searchsorted(r, r_ax + EPS * max(1.0, abs(r_ax)), side="right")]
    h = int(near_axis.max(axis=1).argmax())
    k = int(near_axis[h].argmax())
    profile = size[h]
    peak = float(profile[k])
    # The flat top ends where the profile first leaves the peak's height; there it must fall.
    away = np.flatnonzero(np.abs(profile - peak) > EPS * max(1.0, peak))
    beside = profile[np.concatenate([away[away < k][-1:], away[away > k][:1]])]
    if peak > 0:
        inner, outer, touches, _ = half_max(profile, k)
    else:
        inner, outer, touches = 0.0, 1.0, True
    return {
        "axis_peak": peak, "axis_peak_harmonic_index": h, "axis_peak_r": float(r[k]), "axis_peak_is_local_max": bool(peak > 0 and len(beside) and (beside < peak).all()),
        "axis_halfmax_width_r": outer - inner, "axis_halfmax_width_grid": (outer - inner) * (n - 1), "axis_halfmax_outer_edge_r": outer, "axis_component_touches_boundary": touches,
    }


def grid_spike(mode: np.ndarray, width_limit: float = 1.0) -> dict:
    """The strongest signed lobe no wider than the limit in grid cells; ties go to the narrower, then the
    lower harmonic, then the smaller radius. Empty without one."""
    n = mode.shape[1]
    best = None
    for h, profile in enumerate(mode):
        for k in signed_peaks(profile).tolist():
            inner, outer, low, high = half_max(profile, k)
            width = (outer - inner) * (n - 1)
            if width > width_limit + EPS * max(1.0, width_limit):
                continue
            rank = (-abs(profile[k]), width, h, k)
            if best is None or rank < best[0]:
                best = rank, {
                    "grid_scale_candidate_found": True, "grid_scale_peak": float(abs(profile[k])), "grid_scale_peak_sign": 1 if profile[k] > 0 else -1, "grid_scale_peak_harmonic_index": h,
                    "grid_scale_peak_r": k / (n - 1), "grid_scale_halfmax_width_r": outer - inner, "grid_scale_halfmax_width_grid": width, "grid_scale_component_touches_boundary": low or high,
                }
    return best[1] if best else {"grid_scale_candidate_found": False}


def edge_artifact(mode: np.ndarray, r_edge: float = 0.97) -> dict:
    """The global energy peak, its width and whether it lies at r_edge or beyond; and for the record the
    strongest harmonic there, measured as the axis artifact of the mirrored mode."""
    n = mode.shape[1]
    w = (mode * mode).sum(axis=0)
    k = int(w.argmax())
    out = {"edge_energy_peak_r": k / (n - 1), "edge_energy_peak_in_window": bool(w[k] > 0 and k / (n - 1) >= r_edge - EPS)}
    if w[k] > 0:
        inner, outer, _, high = half_max(w / w[k], k)
        out |= {"edge_energy_halfmax_width_grid": (outer - inner) * (n - 1), "edge_energy_component_touches_boundary": high}
    mirror = axis_artifact(mode[:, ::-1], 1.0 - r_edge)
    out |= {"edge_harmonic_peak": mirror["axis_peak"], "edge_harmonic_peak_harmonic_index": mirror["axis_peak_harmonic_index"], "edge_harmonic_peak_r": 1.0 - mirror["axis_peak_r"], "edge_harmonic_peak_is_local_max": mirror["axis_peak_is_local_max"]}
    if mirror["axis_peak"] > 0:
        profile = np.abs(mode[mirror["axis_peak_harmonic_index"]])
        inner, outer, _, _ = half_max(profile, round((1.0 - mirror["axis_peak_r"]) * (n - 1)))
        out["edge_harmonic_halfmax_width_grid"] = (outer - inner) * (n - 1)
    return out


def blocks(known: np.ndarray) -> list[slice]:
    """Runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], known.astype(int), [0]))))
    return [slice(a, b) for a, b in edge.reshape(-1, 2).tolist()]


def smooth(values: np.ndarray) -> np.ndarray:
    """Weights 1 2 3 2 1 over each finite run, ends repeated."""
    out = np.full(len(values), np.nan)
    for b in blocks(np.isfinite(values)):
        v = values[b]
        out[b] = np.convolve(np.pad(v, 2, mode="edge"), np.array([1, 2, 3, 2, 1]) / 9.0, mode="valid") if len(v) > 1 else v
    return out


def peaks_with_prominence(y: np.ndarray) -> list[tuple[int, float]]:
    """Strict local maxima away from the ends (flat tops at their middle, rounded down) with how far each
    rises above the higher of the two lowest points between it and higher ground."""
    cut = np.flatnonzero(np.concatenate(([True], y[1:] != y[:-1])))
    last = np.append(cut[1:], len(y)) - 1
    out = []
    for k in range(1, len(cut) - 1):
        v = y[cut[k]]
        if v > y[cut[k - 1]] and v > y[cut[k + 1]]:
            mid = (cut[k] + last[k]) // 2
            higher_left, higher_right = np.flatnonzero(y[:mid] > v), np.flatnonzero(y[mid + 1 :] > v)
            a = higher_left[-1] + 1 if len(higher_left) else 0
            b = mid + 1 + higher_right[0] if len(higher_right) else len(y)
            out.append((int(mid), float(v - max(y[a : mid + 1].min(), y[mid:b].min()))))
    return out


def extremum_at(mode: np.ndarray, omega: float, low2: np.ndarray, high2: np.ndarray, r_min: float = 0.03, r_max: float = 0.40, dr_scale: float = 0.02, df_scale: float = 0.03, half: float = 0.03) -> tuple[float, float, float, bool, float | None]:
    """Alignment with the nearest inner extremum of the gap (a minimum of the upper frequency or a maximum
    of the lower): ext_dr, ext_df_gap, ext_energy_frac, whether one matched (else 1, 1, 0) and its radius."""
    w = (mode * mode).sum(axis=0)
    n = len(w)
    r = np.linspace(0.0, 1.0, n)
    if w.max() <= 0 or omega <= 0:
        return 1.0, 1.0, 0.0, False, None
    at = r[w.argmax()]
    found = []
    for name, sign, square in (("upper_min", -1.0, high2), ("lower_max", 1.0, low2)):
        f = np.sqrt(np.where(square >= 0, square, np.nan))
        s = smooth(f)
        for b in blocks(np.isfinite(f) & np.isfinite(s) & (r >= r_min) & (r <= r_max)):
            for k, prominence in peaks_with_prominence(sign * s[b]):
                k += b.start
                df = -sign * (f[k] - omega) / omega
                dr = abs(at - r[k])
                found.append(((dr / dr_scale) ** 2 + (df / df_scale) ** 2, -prominence / abs(omega), r[k], name, dr, df))
    if not found:
        return 1.0, 1.0, 0.0, False, None
    _, _, center, _, dr, df = min(found)
    a, b = max(0.0, center - half), min(1.0, center + half)
    x = np.concatenate(([a], r[(r > a) & (r < b)], [b]))
    area = lambda y, t: float((0.5 * (y[1:] + y[:-1]) * np.diff(t)).sum())
    whole = area(w, r) if n > 1 else 0.0
    share = min(1.0, max(0.0, area(np.interp(x, r, w), x) / whole)) if whole > 0 and b > a else 0.0
    return float(dr), float(df), share, True, float(center)


def extremum(mode: np.ndarray, omega: float, low2: np.ndarray, high2: np.ndarray, **scales: float) -> tuple[float, float, float, bool]:
    """``extremum_at`` without the radius."""
    return extremum_at(mode, omega, low2, high2, **scales)[:4]


# --- boundary profiles ---------------------------------------------------------------------------


def repair_tail(low2: np.ndarray, high2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replaces an outer tail in which both frequencies blow up together by the mean of the four points
    before it. Looked for in the last 16 points of the last run with both boundaries."""
    low, high = np.sqrt(np.where(low2 >= 0, low2, np.nan)), np.sqrt(np.where(high2 >= 0, high2, np.nan))
    usable = blocks(np.isfinite(low) & np.isfinite(high) & (high >= low))
    if not usable or usable[-1].stop - usable[-1].start < 6:
        return low2, high2
    b = usable[-1]

    def blown(f: np.ndarray) -> np.ndarray:
        """For each point from the fifth on: is it a blow-up against the four before it?"""
        before = np.lib.stride_tricks.sliding_window_view(f, 5)
        past, now = before[:, :4], before[:, 4]
        slope = np.median(np.abs(np.diff(past, axis=1)), axis=1)
        mean = past.mean(axis=1)
        return (mean > 0) & (now > 2 * mean) & (now > np.sqrt(50.0)) & (now - past[:, 3] > np.maximum(1.0, 5 * slope))

    hits = np.flatnonzero(blown(low[b]) & blown(high[b])) + 4
    hits = hits[hits >= (b.stop - b.start) - 16]
    if not len(hits):
        return low2, high2
    first = b.start + int(hits[0])
    f_low, f_high = low[first - 4 : first].mean(), high[first - 4 : first].mean()
    low2, high2 = low2.copy(), high2.copy()
    low2[first : b.stop], high2[first : b.stop] = f_low**2, max(f_low, f_high) ** 2
    return low2, high2


def trim_tail(values: np.ndarray) -> np.ndarray:
    """Drops last finite points (not at the array's end) above 50 and three times the four before them."""
    out = values.copy()
    while True:
        known = np.flatnonzero(np.isfinite(out))
        if len(known) < 5 or known[-1] == len(out) - 1:
            return out
        top = out[known[-5:-1]].max()
        if not (top > 0 and out[known[-1]] > 3 * top and out[known[-1]] > 50):
            return out
        out[known[-1]] = np.nan


def clean_boundaries(low2: np.ndarray, high2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sentinels above 999 out, joint tail repaired, single spikes trimmed: in this order."""
    low2, high2 = (np.where(x > 999.0, np.nan, x) for x in (low2, high2))
    low2, high2 = repair_tail(low2, high2)
    return trim_tail(low2), trim_tail(high2)


# --- ridge of a mode and comparison of two -------------------------------------------------------


def ridge(mode: np.ndarray, floor: float = 1e-6, shift: float = 0.0, k: int = 3, step: int = 2) -> np.ndarray:
    """Harmonic index of the energy's centre at each radius: rounded, filled over radii without energy,
    median-filtered and slew-limited. ``floor`` and ``shift`` set the two variants in use."""
    mode = np.asarray(mode, dtype=np.float32)
    n_m = len(mode)
    w = mode * mode
    s = w.sum(axis=0) + np.float32(1e-12)
    valid = s > floor * float(s.max())
    if not valid.any():
        c = np.full(mode.shape[1], n_m // 2)
    else:
        raw = np.clip(np.rint((np.arange(n_m, dtype=np.float32)[:, None] * w).sum(axis=0) / (s + np.float32(shift))).astype(int), 0, n_m - 1)
        known = np.flatnonzero(valid)
        # A backward fill runs last, so a gap takes the value after it; the end takes the last known.
        c = raw[known[np.minimum(np.searchsorted(known, np.arange(len(valid))), len(known) - 1)]]
    half = k // 2
    c = np.array([int(np.median(c[max(0, i - half) : i + half + 1])) for i in range(len(c))])
    for i in range(1, len(c)):
        c[i] = min(max(c[i], c[i - 1] - step), c[i - 1] + step)
    return np.clip(c, 0, n_m - 1)


def ridge_profile(mode: np.ndarray, center: np.ndarray, band: int = 1) -> np.ndarray:
    """Amplitude-weighted mean amplitude within ``band`` harmonics of the ridge."""
    mode = np.asarray(mode, dtype=np.float32)
    near = np.abs(np.arange(len(mode))[:, None] - center[None, :]) <= band
    a = np.where(near, mode, np.float32(0))
    return (np.abs(a) * a).sum(axis=0) / (np.abs(a).sum(axis=0) + np.float32(1e-14))


def straighten(mode: np.ndarray, half: int = 8, k: int = 3, step: int = 2) -> np.ndarray:
    """The 2 half + 1 harmonics around the ridge at each radius, zeros outside the mode."""
    c = ridge(mode, floor=1e-4, shift=1e-8, k=k, step=step)
    padded = np.pad(np.asarray(mode, dtype=np.float32), ((half, half), (0, 0)))
    return np.take_along_axis(padded, c[None, :] + np.arange(2 * half + 1)[:, None], axis=0)


def profile_location(a: np.ndarray) -> tuple[float, float]:
    """Centroid and 10-90 % width of a profile's squared weight."""
    r = np.linspace(0.0, 1.0, len(a), dtype=np.float32).astype(float)
    w = a.astype(float) ** 2
    if w.sum() <= 1e-14:
        return float((r * w).sum() / (w.sum() + 1e-14)), 0.0
    share = np.cumsum(w) / w.sum()
    return float((r * w).sum() / (w.sum() + 1e-14)), float(np.interp(0.9, share, r) - np.interp(0.1, share, r))


def same_type(a: tuple, b: tuple, cosine: float = 0.90, r_tol: float = 0.10, width_tol: float = 0.05) -> bool:
    """Whether two (profile, centroid, width) agree; b's profile is resampled to a's grid if they differ."""
    x, y = np.asarray(a[0], dtype=float), np.asarray(b[0], dtype=float)
    if len(x) != len(y):
        y = np.interp(np.linspace(0, 1, len(x)), np.linspace(0, 1, len(y)), y).astype(np.float32).astype(float)
    nx, ny = np.linalg.norm(x), np.linalg.norm(y)
    c = 0.0 if min(nx, ny) < 1e-14 else abs(float(x @ y) / (nx * ny))
    return c >= cosine and abs(a[1] - b[1]) < r_tol and abs(a[2] - b[2]) < width_tol
