"""Measurements of ``profiles`` on stacks of modes of one shape (mode, harmonic, radius), equal in bits.

Each function returns arrays of a value a mode; a masked value is a measure that the mode does not have.
Flat tops and half-maximum edges are found for all profiles of a stack at once, by positions along the
radius. Only profiles with steps about as small as the tolerance go through the loop over runs.
"""

from __future__ import annotations

import numpy as np

from .profiles import EPS, runs

#: Values of a stack that is worked on at once (8 MB); larger ones are cut by modes.
CELLS = 1 << 20


def half_max(profiles: np.ndarray, peaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``profiles.half_max`` of a peak other than 0 in each row."""
    m, n = profiles.shape
    row, at = np.arange(m), np.arange(n)
    p = profiles * np.where(profiles[row, peaks] > 0, 1.0, -1.0)[:, None]
    half = p[row, peaks] / 2
    below = p < half[:, None]
    low = np.where(below & (at < peaks[:, None]), at, -1).max(axis=1)
    high = np.where(below & (at > peaks[:, None]), at, n).min(axis=1)
    r = np.linspace(0.0, 1.0, n)
    inner, outer = np.zeros(m), np.ones(m)
    for edge, under, over, k in ((inner, low, low + 1, low >= 0), (outer, high, high - 1, high < n)):
        i, a, b = row[k], under[k], over[k]
        edge[k] = r[a] + (half[i] - p[i, a]) / (p[i, b] - p[i, a]) * (r[b] - r[a])
    return inner, outer, low < 0, high == n


def signed_peaks(profiles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and positions of ``profiles.signed_peaks`` of each row."""
    m, n = profiles.shape
    tol = EPS * np.maximum(1.0, np.abs(profiles).max(axis=1))
    step = np.abs(np.diff(profiles, axis=1))
    first = np.ones((m, n), dtype=bool)
    first[:, 1:] = step > 0
    # A step of more than twice the tolerance begins a run wherever the run before began, one of 0 never does.
    for i in np.flatnonzero(((step > 0) & (step <= 3 * tol[:, None])).any(axis=1)).tolist():
        first[i] = False
        first[i, runs(profiles[i], tol[i])[0]] = True
    following = np.where(first, np.arange(n), n)
    following = np.minimum.accumulate(following[:, ::-1], axis=1)[:, ::-1]
    row, k = np.nonzero(first & (first.sum(axis=1) > 1)[:, None])
    after = np.append(following, np.full((m, 1), n), axis=1)[row, k + 1]
    value = profiles[row, k]
    sign = np.where(value > 0, 1.0, -1.0)
    top = sign * value - tol[row]
    is_peak = (np.abs(value) > tol[row]) & ((k == 0) | (sign * profiles[row, k - 1] < top)) & ((after == n) | (sign * profiles[row, np.minimum(after, n - 1)] < top))
    return row[is_peak], k[is_peak]


def axis_artifact(stack: np.ndarray, r_ax: float = 0.03) -> dict[str, np.ndarray]:
    b, _, n = stack.shape
    mode, at, r = np.arange(b), np.arange(n), np.linspace(0.0, 1.0, n)
    size = np.abs(stack)
    near = size[:, :, : np.searchsorted(r, r_ax + EPS * max(1.0, abs(r_ax)), side="right")]
    h = near.max(axis=2).argmax(axis=1)
    k = near[mode, h].argmax(axis=1)
    profile = size[mode, h]
    peak = profile[mode, k]
    away = np.abs(profile - peak[:, None]) > EPS * np.maximum(1.0, peak)[:, None]
    left = np.where(away & (at < k[:, None]), at, -1).max(axis=1)
    right = np.where(away & (at > k[:, None]), at, n).min(axis=1)
    falls = ((left < 0) | (profile[mode, left] < peak)) & ((right == n) | (profile[mode, np.minimum(right, n - 1)] < peak))
    inner, outer, touches = np.zeros(b), np.ones(b), np.ones(b, dtype=bool)
    p = peak > 0
    inner[p], outer[p], touches[p], _ = half_max(profile[p], k[p])
    return {
        "axis_peak": peak, "axis_peak_harmonic_index": h, "axis_peak_r": r[k], "axis_peak_is_local_max": p & ((left >= 0) | (right < n)) & falls,
        "axis_halfmax_width_r": outer - inner, "axis_halfmax_width_grid": (outer - inner) * (n - 1), "axis_halfmax_outer_edge_r": outer, "axis_component_touches_boundary": touches,
    }


def grid_spike(stack: np.ndarray, width_limit: float = 1.0) -> dict[str, np.ndarray]:
    b, nhar, n = stack.shape
    flat = stack.reshape(b * nhar, n)
    row, k = signed_peaks(flat)
    limit = width_limit + EPS * max(1.0, width_limit)
    # An edge further away than the limit is enough to drop a peak: look only that far for one, or the grid's end.
    sign, far = np.where(flat[row, k] > 0, 1.0, -1.0), int(min(n, np.floor(limit) + 2))
    near = np.ones(len(row), dtype=bool)
    for side in (-1, 1):
        met = np.zeros(len(row), dtype=bool)
        for step in range(1, far + 1):
            x = k + side * step
            met |= (x < 0) | (x >= n) | (sign * flat[row, np.clip(x, 0, n - 1)] < sign * flat[row, k] / 2)
        near &= met
    row, k = row[near], k[near]
    parts = [half_max(flat[row[i : i + CELLS // n + 1]], k[i : i + CELLS // n + 1]) for i in range(0, len(row), CELLS // n + 1)]
    inner, outer, low, high = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0), np.zeros(0), np.zeros(0, dtype=bool), np.zeros(0, dtype=bool))
    width, value = (outer - inner) * (n - 1), flat[row, k]
    fits = np.flatnonzero(width <= limit)
    order = fits[np.lexsort((k[fits], row[fits], width[fits], -np.abs(value[fits]), row[fits] // nhar))]
    mode, best = np.unique(row[order] // nhar, return_index=True)
    best = order[best]
    found = np.zeros(b, dtype=bool)
    found[mode] = True
    measures = {
        "grid_scale_peak": np.abs(value), "grid_scale_peak_sign": np.where(value > 0, 1, -1), "grid_scale_peak_harmonic_index": row % nhar, "grid_scale_peak_r": k / (n - 1),
        "grid_scale_halfmax_width_r": outer - inner, "grid_scale_halfmax_width_grid": width, "grid_scale_component_touches_boundary": low | high,
    }
    out: dict[str, np.ndarray] = {"grid_scale_candidate_found": found}
    for name, values in measures.items():
        out[name] = np.ma.masked_all(b, dtype=values.dtype)
        out[name][mode] = values[best]
    return out


def edge_artifact(stack: np.ndarray, r_edge: float = 0.97) -> dict[str, np.ndarray]:
    b, _, n = stack.shape
    mode = np.arange(b)
    w = (stack * stack).sum(axis=1)
    k = w.argmax(axis=1)
    top = w[mode, k]
    has = top > 0
    out = {"edge_energy_peak_r": k / (n - 1), "edge_energy_peak_in_window": has & (k / (n - 1) >= r_edge - EPS)}
    width, touches = np.ma.masked_all(b), np.ma.masked_all(b, dtype=bool)
    inner, outer, _, touches[has] = half_max(w[has] / top[has, None], k[has])
    width[has] = (outer - inner) * (n - 1)
    out |= {"edge_energy_halfmax_width_grid": width, "edge_energy_component_touches_boundary": touches}
    mirror = axis_artifact(stack[:, :, ::-1], 1.0 - r_edge)
    peak, h, r = mirror["axis_peak"], mirror["axis_peak_harmonic_index"], 1.0 - mirror["axis_peak_r"]
    out |= {"edge_harmonic_peak": peak, "edge_harmonic_peak_harmonic_index": h, "edge_harmonic_peak_r": r, "edge_harmonic_peak_is_local_max": mirror["axis_peak_is_local_max"]}
    p = peak > 0
    width = np.ma.masked_all(b)
    inner, outer, _, _ = half_max(np.abs(stack[mode[p], h[p]]), np.rint(r[p] * (n - 1)).astype(int))
    width[p] = (outer - inner) * (n - 1)
    return out | {"edge_harmonic_halfmax_width_grid": width}
