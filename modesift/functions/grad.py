"""Gradients of the array models, in NumPy: every layer gives its output and a function that carries a
gradient back to its input and adds its weights' gradients to a dict."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import cnn as C

Back = Callable[[np.ndarray, dict], np.ndarray]


def conv(x: np.ndarray, p: dict, name: str) -> tuple[np.ndarray, Back]:
    w = p[f"{name}.weight"]
    axes = tuple(range(1, x.ndim))
    padded = np.pad(x, [(0, 0), *[(1, 1)] * len(axes)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, w.shape[2:], axis=axes)

    def back(g: np.ndarray, out: dict) -> np.ndarray:
        out[f"{name}.weight"] = np.tensordot(g, windows, axes=(axes, axes))
        out[f"{name}.bias"] = g.sum(axis=axes)
        turned = np.flip(w, axis=tuple(range(2, w.ndim))).swapaxes(0, 1)
        return C.conv(g, turned, np.zeros(w.shape[1], dtype=w.dtype))

    return C.conv(x, w, p[f"{name}.bias"]), back


def pool(x: np.ndarray) -> tuple[np.ndarray, Back]:
    """Pairs along each axis in turn; of equal values the first takes the gradient."""
    steps = []
    for axis in range(1, x.ndim):
        n = x.shape[axis] // 2
        pairs = np.moveaxis(x, axis, -1)[..., : 2 * n].reshape(*np.moveaxis(x, axis, -1).shape[:-1], n, 2)
        steps.append((axis, x.shape[axis], pairs.argmax(axis=-1)))
        x = np.moveaxis(pairs.max(axis=-1), -1, axis)

    def back(g: np.ndarray, out: dict) -> np.ndarray:
        for axis, size, first in reversed(steps):
            g = np.moveaxis(g, axis, -1)
            both = np.stack([np.where(first == 0, g, 0), np.where(first == 1, g, 0)], axis=-1).reshape(*g.shape[:-1], -1)
            g = np.moveaxis(np.pad(both, [*[(0, 0)] * (both.ndim - 1), (0, size - both.shape[-1])]), -1, axis)
        return g

    return x, back


def relu(x: np.ndarray) -> tuple[np.ndarray, Back]:
    return np.maximum(x, 0), lambda g, out: g * (x > 0)


def mean(x: np.ndarray, axes: tuple[int, ...]) -> tuple[np.ndarray, Back]:
    n = np.prod([x.shape[a] for a in axes])
    return x.mean(axis=axes), lambda g, out: np.broadcast_to(np.expand_dims(g, axes) / n, x.shape)


def dense(x: np.ndarray, p: dict, name: str) -> tuple[np.ndarray, Back]:
    def back(g: np.ndarray, out: dict) -> np.ndarray:
        out[f"{name}.weight"], out[f"{name}.bias"] = np.outer(g, x), g
        return p[f"{name}.weight"].T @ g

    return C.dense(x, p, name), back


def drop(x: np.ndarray, rate: float, rng: np.random.Generator | None) -> tuple[np.ndarray, Back]:
    if rng is None or not rate:
        return x, lambda g, out: g
    keep = (rng.random(x.shape) >= rate) / (1 - rate)
    return x * keep, lambda g, out: g * keep


def chain(x: np.ndarray, *layers: Callable[[np.ndarray], tuple[np.ndarray, Back]]) -> tuple[np.ndarray, Back]:
    backs = []
    for layer in layers:
        x, back = layer(x)
        backs.append(back)

    def through(g: np.ndarray, out: dict) -> np.ndarray:
        for back in reversed(backs):
            g = back(g, out)
        return g

    return x, through


def tower(x: np.ndarray, p: dict, name: str) -> tuple[np.ndarray, Back]:
    layers = []
    for k, at in enumerate((0, 3, 6)):
        layers += [lambda v, at=at: conv(v, p, f"{name}.{at}"), relu, *([pool] if k < 2 else [])]
    return chain(x, *layers)


def logit(p: dict, kind: str, x: np.ndarray, beside: np.ndarray | None = None, rate: float = 0.0, rng: np.random.Generator | None = None) -> tuple[float, Callable[[float], dict]]:
    """A model's output for one input, and its weights' gradients for a gradient of the output. beside:
    the radial channels of ``branch``, the scalars of ``hybrid``."""
    first, last = ("head.0", "head.3") if kind == "hybrid" else ("head.1", "head.4")
    if kind == "hybrid":
        a, back_a = chain(x, lambda v: tower(v, p, "features"), lambda v: mean(v, (1, 2)), lambda v: dense(v, p, "img_fc.1"), relu)
        b, back_b = chain(beside, lambda v: dense(v, p, "sc_fc.0"), relu, lambda v: dense(v, p, "sc_fc.2"), relu)
        z, under = np.concatenate([a, b]), None
    elif kind == "branch":
        a, back_a = chain(x, lambda v: tower(v, p, "mode_features"), lambda v: mean(v, (1,)))
        b, back_b = tower(beside, p, "continuum_features")
        z, under = chain(np.concatenate([a, b]), lambda v: conv(v, p, "fusion.0"), relu, lambda v: mean(v, (1,)))
    else:
        z, back_a = chain(x, lambda v: tower(v, p, "features"), lambda v: mean(v, (1, 2)))
    y, head = chain(z, lambda v: dense(v, p, first), relu, lambda v: drop(v, rate, rng), lambda v: dense(v, p, last))

    def back(g: float) -> dict:
        out: dict = {}
        d = head(np.array([g]), out)
        if kind in ("hybrid", "branch"):
            d = d if under is None else under(d, out)
            back_a(d[: len(a)], out)
            back_b(d[len(a) :], out)
        else:
            back_a(d, out)
        return out

    return float(y[0]), back


def loss(z: float, y: float, weight: float) -> tuple[float, float]:
    """Cross entropy of a logit, positives weighing ``weight``, and its gradient."""
    p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    value = weight * y * np.logaddexp(0, -z) + (1 - y) * np.logaddexp(0, z)
    return float(value), float((1 - y) * p - weight * y * (1 - p))


def one_cycle(step: int, steps: int, peak: float, start: float = 20.0, end: float = 100.0, rise: float = 0.1) -> float:
    """The rate of a step: up from peak / start by a cosine over the share ``rise`` of steps, then down to that / end."""
    low, top = peak / start, rise * steps - 1
    wave = lambda a, b, t: b + (a - b) / 2 * (1 + np.cos(np.pi * t))
    if step <= top:
        return float(wave(low, peak, step / top if top > 0 else 1.0))
    return float(wave(peak, low / end, min(1.0, (step - max(top, 0)) / max(steps - 1 - max(top, 0), 1e-9))))


class Adam:
    def __init__(self, p: dict, beta: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8):
        self.beta, self.eps, self.t = beta, eps, 0
        self.m, self.v = ({k: np.zeros_like(x, dtype=float) for k, x in p.items()} for _ in range(2))

    def step(self, p: dict, grads: dict, rate: float, clip: float | None) -> dict:
        """New weights; gradients longer than ``clip`` as a whole are cut to it."""
        size = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        cut = min(1.0, clip / (size + 1e-6)) if clip else 1.0
        self.t += 1
        out = {}
        for k, x in p.items():
            g = grads[k] * cut
            self.m[k] = self.beta[0] * self.m[k] + (1 - self.beta[0]) * g
            self.v[k] = self.beta[1] * self.v[k] + (1 - self.beta[1]) * g**2
            m, v = self.m[k] / (1 - self.beta[0] ** self.t), self.v[k] / (1 - self.beta[1] ** self.t)
            out[k] = x - rate * m / (np.sqrt(v) + self.eps)
        return out
