"""Training of array models: steps on the driver, gradients of a batch summed by the executors.

Inputs are made once, as a stage table of flat arrays. A step's batch is a seeded slot of the rows; each
partition adds up the gradients of its rows, ``FAN`` partial sums at a time are added by the next stage,
and what is left comes to the driver: some hundred thousand numbers each, whatever the data. Weights go
out as a broadcast that is dropped after its step.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cnn as C
from ..functions import grad as G
from ..operators.scoring import stratified_split
from ..sources.tables import RunTables

FAN = 16


@dataclass(frozen=True)
class Training:
    """Settings; defaults are those of the models in use."""

    rows: int = 100
    cols: int = 201
    how: str = "robust"
    epochs: int = 80
    batch: int = 32
    rate: float = 2e-2
    dropout: float = 0.2
    clip: float | None = 1.0
    positive_weight: float | str | None = None  # "auto": bad over good
    test_share: float = 0.2
    refit: bool = True
    seed: int = 42


@dataclass
class Fitted:
    kind: str
    weights: dict[str, np.ndarray]
    epoch: int = 0
    history: list[dict] = field(default_factory=list)  # epoch, loss, test accuracy


def inputs(df: DataFrame, kind: str, key: str, label: str, t: Training) -> DataFrame:
    """(key, y, x, beside) of labelled rows: the model's inputs as flat arrays. A mode that can't be one is left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                try:
                    mode = np.array([list(x) for x in r.mode], dtype=float)
                    low, high = (np.full(mode.shape[1], np.nan) if v is None else np.array([np.nan if x is None else x for x in v], dtype=float) for v in (r.low2, r.high2))
                    if not np.isfinite(mode).all() or not np.isfinite(r.omega) or r.omega <= 0:
                        continue
                    x = C.image(mode, r.omega, low, high, t.rows, t.cols, t.how, channels=kind == "raw3")
                    beside = C.branch(mode, r.omega, low, high, t.cols) if kind == "branch" else np.zeros(0)
                    rows.append((r.key, int(r.y), x.ravel(), beside.ravel()))
                except (TypeError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=["key", "y", "x", "beside"])

    d = df.where(F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).cast("int").alias("y"), "mode", "omega", "low2", "high2")
    return d.mapInPandas(run, f"key {df.schema[key].dataType.simpleString()}, y int, x array<float>, beside array<float>")


def _flat(p: dict) -> np.ndarray:
    return np.concatenate([np.asarray(p[k], dtype=float).ravel() for k in sorted(p)])


def _shaped(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        n = like[k].size
        out[k] = flat[at : at + n].reshape(like[k].shape)
        at += n
    return out


def _pass(rows: DataFrame, p: dict, kind: str, t: Training, weight: float, step: int | None) -> tuple[int, float, int, np.ndarray | None]:
    """Rows, summed loss, right answers, and with a step the summed gradients."""
    held = rows.sparkSession.sparkContext.broadcast(p)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = held.value
        n, total, right, sums = 0, 0.0, 0, None
        for f in frames:
            for k, y, x, beside in f.itertuples(index=False):
                image = np.asarray(x, dtype=float).reshape(-1, t.rows, t.cols)
                side = np.asarray(beside, dtype=float).reshape(4, t.cols) if kind == "branch" else None
                rng = None if step is None else np.random.default_rng([t.seed, step, zlib.crc32(str(k).encode())])
                z, back = G.logit(weights, kind, image, side, t.dropout, rng)
                value, g = G.loss(z, float(y), weight)
                n, total, right = n + 1, total + value, right + ((z >= 0) == (y == 1))
                if step is not None:
                    own = _flat(back(g))
                    sums = own if sums is None else sums + own
        if n:
            yield pd.DataFrame([(n, total, right, None if sums is None else sums)], columns=["n", "loss", "right", "grad"])

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = None
        for f in frames:
            for n, total, right, sums in f.itertuples(index=False):
                own = (n, total, right, None if sums is None else np.asarray(sums))
                whole = own if whole is None else (whole[0] + n, whole[1] + total, whole[2] + right, None if sums is None else whole[3] + own[3])
        if whole:
            yield pd.DataFrame([whole], columns=["n", "loss", "right", "grad"])

    schema = "n long, loss double, right long, grad array<double>"
    out = rows.mapInPandas(partial, schema)
    parts = rows.rdd.getNumPartitions()
    while parts > FAN:
        parts = -(-parts // FAN)
        out = out.repartition(parts).mapInPandas(added, schema)
    found = list(added(iter([out.toPandas()])))
    held.destroy()
    if not found:
        return 0, 0.0, 0, None
    n, total, right, sums = found[0].iloc[0]
    return int(n), float(total), int(right), None if sums is None else np.asarray(sums)


def _fit(rows: DataFrame, test: DataFrame | None, kind: str, t: Training, epochs: int) -> Fitted:
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n = sum(counts.values())
    if len(counts) < 2:
        raise ValueError("training needs rows of both labels")
    weight = counts[0] / counts[1] if t.positive_weight == "auto" else float(t.positive_weight or 1.0)
    p = {k: np.asarray(v, dtype=float) for k, v in C.random_weights(kind, t.seed).items()}
    slots = max(1, -(-n // t.batch))
    adam, fitted, best, step = G.Adam(p), Fitted(kind, p), -1.0, 0
    for epoch in range(1, epochs + 1):
        dealt = F.pmod(F.xxhash64(F.lit(t.seed), F.lit(epoch), "key"), F.lit(slots))
        seen, total = 0, 0.0
        for slot in range(slots):
            m, value, _, sums = _pass(rows.where(dealt == slot), p, kind, t, weight, step)
            if m:
                p = adam.step(p, _shaped(sums / m, p), G.one_cycle(step, epochs * slots, t.rate), t.clip)
            seen, total, step = seen + m, total + value, step + 1
        told = {"epoch": epoch, "loss": total / max(seen, 1)}
        if test is not None:
            m, _, right, _ = _pass(test, p, kind, t, weight, None)
            told["accuracy"] = right / m if m else 0.0
        fitted.history.append(told)
        if test is None or told["accuracy"] > best:
            best, fitted.weights, fitted.epoch = told.get("accuracy", best), p, epoch
    return fitted


def train_array_model(df: DataFrame, kind: str = "raw", key: str = "path", label: str = "y", settings: Training = Training(), tables: RunTables | None = None) -> Fitted:
    """A model of kind raw, raw3 or branch fitted to df(key, label, mode, omega, low2, high2): the epoch of
    the best accuracy on a stratified share is kept, and if asked as many epochs are run again on all rows."""
    if kind not in ("raw", "raw3", "branch"):
        raise ValueError(f"models of kind {kind} are not trained here")
    tables = tables or RunTables(df.sparkSession)
    made = tables.stage("array_inputs", lambda: inputs(df, kind, key, label, settings))
    split = tables.stage("array_split", lambda: stratified_split(made.select("key", "y"), "y", "key", settings.test_share, settings.seed))
    both = made.join(split.select("key", "is_test"), "key")
    part = lambda test: tables.stage(f"array_{'test' if test else 'train'}", lambda: both.where(F.col("is_test") == test).drop("is_test"))
    fitted = _fit(part(False), part(True), kind, settings, settings.epochs)
    if settings.refit:
        whole = _fit(made, None, kind, settings, fitted.epoch)
        fitted.weights = whole.weights
    return fitted
