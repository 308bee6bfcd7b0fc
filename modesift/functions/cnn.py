"""Inputs and forward passes of the array models, in NumPy.

Weights are a dict of arrays under the usual ``<module>.<index>.weight`` / ``.bias`` names, so a saved
state can be converted to ``.npz`` once and scored here. Convolutions are one tensor product over
strided windows.
"""

from __future__ import annotations

import numpy as np

from .profiles import straighten

CLIP = 5.0


def resample(mode: np.ndarray, n: int = 201) -> np.ndarray:
    """Each harmonic linearly on n uniform radii, float32."""
    old, new = np.linspace(0, 1, mode.shape[1]), np.linspace(0, 1, n)
    return np.stack([np.interp(new, old, row) for row in mode]).astype(np.float32)


def normalise(x: np.ndarray, how: str) -> np.ndarray:
    if how == "none":
        return x
    if how == "standard":
        return (x - x.mean()) / (x.std() + 1e-8)
    if how == "maxabs":
        return x / (np.abs(x).max() + 1e-8)
    if how == "robust":
        centred = x - np.median(x)
        mad = float(np.median(np.abs(centred)))
        return centred if mad < 1e-3 else centred / (mad + 1e-8)
    raise ValueError(f"unknown normalisation {how}")


def fit_to(x: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Cropped or zero-padded at the end to rows x cols."""
    out = np.zeros((rows, cols), dtype=np.float32)
    out[: min(rows, x.shape[0]), : min(cols, x.shape[1])] = x[:rows, :cols]
    return out


def gap_channels(omega: float, low2: np.ndarray, high2: np.ndarray, n: int, clip: float = CLIP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """du, dl (relative distance to the upper and lower frequency, positive inside the gap) on n radii,
    interpolated over the usable ones and clipped; and which sampled radii are usable."""
    ok = np.isfinite(low2) & np.isfinite(high2) & (low2 >= 0) & (high2 >= 0)
    ok &= np.where(ok, high2 >= low2, False)
    if not ok.any():
        return np.zeros(n, dtype=np.float32), np.zeros(n, dtype=np.float32), np.zeros(n, dtype=bool)
    old, new = np.linspace(0, 1, len(ok)), np.linspace(0, 1, n)
    high, low = np.sqrt(high2[ok].astype(float)).astype(np.float32), np.sqrt(low2[ok].astype(float)).astype(np.float32)
    on = lambda y: np.clip(np.interp(new, old[ok], y), -clip, clip).astype(np.float32)
    nearest = np.rint(np.linspace(0, len(ok) - 1, n, dtype=np.float32)).astype(int)
    return on((high - omega) / omega), on((omega - low) / omega), ok[nearest]


def image(mode: np.ndarray, omega: float, low2: np.ndarray, high2: np.ndarray, rows: int, cols: int, how: str = "robust", channels: bool = False, clip: float = CLIP) -> np.ndarray:
    """(1 or 3, rows, cols): the mode and, if asked, du and dl repeated over the harmonics."""
    x = normalise(fit_to(resample(mode, cols), rows, cols)[None], how).astype(np.float32)
    if not channels:
        return x
    du, dl, _ = gap_channels(omega, low2, high2, cols, clip)
    return np.concatenate([x, np.broadcast_to(np.stack([du, dl])[:, None, :], (2, rows, cols))]).astype(np.float32)


def straight_image(mode: np.ndarray, half: int, cols: int, k: int, step: int, how: str) -> np.ndarray:
    """(1, 2 half + 1, cols): the window around the mode's ridge."""
    return normalise(straighten(resample(mode, cols), half, k, step)[None], how).astype(np.float32)


def branch(mode: np.ndarray, omega: float, low2: np.ndarray, high2: np.ndarray, cols: int, zero: bool = False, clip: float = CLIP) -> np.ndarray:
    """(4, cols): normalised W, du, dl and the mask of usable radii; du and dl are 0 outside it."""
    if zero:
        return np.zeros((4, cols), dtype=np.float32)
    w = (resample(mode, cols) ** 2).sum(axis=0)
    du, dl, ok = gap_channels(omega, low2, high2, cols, clip)
    return np.stack([w / w.max() if w.max() > 0 else w, np.where(ok, du, 0), np.where(ok, dl, 0), ok]).astype(np.float32)


def conv(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Same-size convolution of (channels, ...) with (out, channels, 3[, 3])."""
    axes = tuple(range(1, x.ndim))
    padded = np.pad(x, [(0, 0), *[(1, 1)] * len(axes)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, w.shape[2:], axis=axes)
    k = w.ndim - 2
    out = np.tensordot(w, windows, axes=([1, *range(2, 2 + k)], [0, *range(1 + k, 1 + 2 * k)]))
    return out + b.reshape(-1, *[1] * k)


def pool(x: np.ndarray) -> np.ndarray:
    """Maximum over pairs along every axis but the first, odd ends dropped."""
    for axis in range(1, x.ndim):
        n = x.shape[axis] // 2
        x = np.stack(np.split(np.take(x, range(2 * n), axis=axis), n, axis=axis), axis=axis).max(axis=axis + 1)
    return x


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


def tower(x: np.ndarray, p: dict, name: str) -> np.ndarray:
    """Three convolutions with two poolings between them."""
    for k, at in enumerate((0, 3, 6)):
        x = relu(conv(x, p[f"{name}.{at}.weight"], p[f"{name}.{at}.bias"]))
        if k < 2:
            x = pool(x)
    return x


def dense(x: np.ndarray, p: dict, name: str) -> np.ndarray:
    return p[f"{name}.weight"] @ x + p[f"{name}.bias"]


def small(p: dict, x: np.ndarray) -> float:
    """One or three channels in, a logit out."""
    z = tower(x, p, "features").mean(axis=(1, 2))
    return float(dense(relu(dense(z, p, "head.1")), p, "head.4")[0])


def with_branch(p: dict, x: np.ndarray, c: np.ndarray) -> float:
    """The image tower averaged over harmonics beside the radial one, fused along the radius."""
    z = np.concatenate([tower(x, p, "mode_features").mean(axis=1), tower(c, p, "continuum_features")])
    z = relu(conv(z, p["fusion.0.weight"], p["fusion.0.bias"])).mean(axis=1)
    return float(dense(relu(dense(z, p, "head.1")), p, "head.4")[0])


def hybrid(p: dict, x: np.ndarray, scalars: np.ndarray) -> float:
    """The image beside eight scalars."""
    z = relu(dense(tower(x, p, "features").mean(axis=(1, 2)), p, "img_fc.1"))
    s = relu(dense(relu(dense(scalars, p, "sc_fc.0")), p, "sc_fc.2"))
    return float(dense(relu(dense(np.concatenate([z, s]), p, "head.0")), p, "head.3")[0])


def kind_of(p: dict) -> str:
    """Which model a set of weights belongs to."""
    if "fusion.0.weight" in p:
        return "branch"
    if "sc_fc.0.weight" in p:
        return "hybrid"
    channels = p["features.0.weight"].shape[1]
    if channels not in (1, 3):
        raise ValueError(f"no model takes {channels} channels")
    return "raw" if channels == 1 else "raw3"


def random_weights(kind: str, seed: int = 0) -> dict:
    """Weights of the right shapes, for tests."""
    rng = np.random.default_rng(seed)
    p: dict[str, np.ndarray] = {}

    def layer(name: str, *shape: int) -> None:
        p[f"{name}.weight"] = rng.normal(size=shape).astype(np.float32) / np.sqrt(np.prod(shape[1:]))
        p[f"{name}.bias"] = rng.normal(size=shape[0]).astype(np.float32) * 0.1

    def layers(name: str, first: int, sizes: tuple[int, ...], dims: int) -> None:
        for at, size in zip((0, 3, 6), sizes, strict=True):
            layer(f"{name}.{at}", size, first, *[3] * dims)
            first = size

    if kind == "branch":
        layers("mode_features", 1, (16, 32, 64), 2)
        layers("continuum_features", 4, (8, 16, 16), 1)
        layer("fusion.0", 64, 80, 3)
    else:
        layers("features", 3 if kind == "raw3" else 1, (16, 32, 64), 2)
    if kind == "hybrid":
        for name, shape in (("img_fc.1", (64, 64)), ("sc_fc.0", (32, 8)), ("sc_fc.2", (32, 32)), ("head.0", (64, 96)), ("head.3", (1, 64))):
            layer(name, *shape)
    else:
        layer("head.1", 32, 64)
        layer("head.4", 1, 32)
    return p
