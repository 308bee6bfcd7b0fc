"""Rejection gates: measurements in one Arrow pass, decisions as one CASE expression.

Filter to the routed modes first: nothing is pushed through the Python stage.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import profiles as P
from ..functions import stacks as B
from . import features as X


@dataclass(frozen=True)
class GateConfig:
    """Thresholds; None disables a gate, its measurements are taken all the same."""

    axis_r: float = 0.03
    axis_amplitude: float | None = 0.2
    axis_width: float | None = 10.0
    grid_amplitude: float | None = 0.3
    grid_width: float | None = 1.0
    cross_energy: float | None = 0.03
    window_half_width: int = 2
    window_amplitude: float | None = 0.25
    window_energy: float | None = 0.05
    edge_r: float = 0.97
    edge_width: float | None = 10.0

    def __post_init__(self) -> None:
        if not 0 <= self.axis_r <= 1 or not 0 <= self.edge_r < 1 or self.window_half_width < 0:
            raise ValueError("gate radii must lie in [0, 1) and window widths be nonnegative")
        for name in ("axis_amplitude", "axis_width", "grid_amplitude", "grid_width", "cross_energy", "window_amplitude", "window_energy", "edge_width"):
            value = getattr(self, name)
            if value is not None and not (np.isfinite(value) and value >= 0):
                raise ValueError(f"{name} must be None or finite and nonnegative")


MEASURES = (
    "axis_peak double, axis_peak_harmonic_index int, axis_peak_r double, axis_peak_is_local_max boolean, axis_halfmax_width_r double, axis_halfmax_width_grid double, axis_halfmax_outer_edge_r double, axis_component_touches_boundary boolean, "
    "grid_scale_candidate_found boolean, grid_scale_peak double, grid_scale_peak_sign int, grid_scale_peak_harmonic_index int, grid_scale_peak_r double, grid_scale_halfmax_width_r double, grid_scale_halfmax_width_grid double, grid_scale_component_touches_boundary boolean, "
    "edge_energy_peak_r double, edge_energy_peak_in_window boolean, edge_energy_halfmax_width_grid double, edge_energy_component_touches_boundary boolean, edge_harmonic_peak double, edge_harmonic_peak_harmonic_index int, edge_harmonic_peak_r double, edge_harmonic_peak_is_local_max boolean, edge_harmonic_halfmax_width_grid double, "
    "ext_dr double, ext_df_gap double, ext_energy_frac double, ext_matched boolean, ext_r double, measure_error string"
)


def _array(values, n: int) -> np.ndarray:
    return np.full(n, np.nan) if values is None else np.array([np.nan if v is None else v for v in values], dtype=float)


def measure_one(mode: np.ndarray, omega: float, low2: np.ndarray, high2: np.ndarray, cfg: GateConfig) -> dict:
    if mode.ndim != 2 or mode.shape[1] < 2 or not np.isfinite(mode).all():
        raise ValueError("mode must be finite with two or more radii")
    out = P.axis_artifact(mode, cfg.axis_r) | P.edge_artifact(mode, cfg.edge_r)
    out |= P.grid_spike(mode, cfg.grid_width) if cfg.grid_width is not None else {"grid_scale_candidate_found": False}
    dr, df, energy, matched, at = P.extremum_at(mode, omega, low2, high2)
    return out | {"ext_dr": dr, "ext_df_gap": df, "ext_energy_frac": energy, "ext_matched": matched, "ext_r": at}


def _measure_stack(stack: np.ndarray, cfg: GateConfig) -> dict[str, np.ndarray]:
    grid = B.grid_spike(stack, cfg.grid_width) if cfg.grid_width is not None else {"grid_scale_candidate_found": np.zeros(len(stack), dtype=bool)}
    return B.axis_artifact(stack, cfg.axis_r) | B.edge_artifact(stack, cfg.edge_r) | grid


def _doubles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column of doubles, NaN for null, and where each list begins and ends."""
    return column.values.to_numpy(zero_copy_only=False).astype(float, copy=False), column.offsets.to_numpy()


def _by_shape(column: pa.Array) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """(row, position of its first value) of the rows that hold a matrix of two or more columns, by its shape."""
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    outer, inner = column.offsets.to_numpy(), column.values.offsets.to_numpy()
    for row, (a, b) in enumerate(zip(outer[:-1].tolist(), outer[1:].tolist(), strict=True)):
        width = np.diff(inner[a : b + 1])
        if len(width) and width[0] > 1 and (width == width[0]).all():
            found.setdefault((b - a, int(width[0])), []).append((row, int(inner[a])))
    return found


def measure(df: DataFrame, cfg: GateConfig = GateConfig()) -> DataFrame:
    """df with the array measurements; measure_error where a mode cannot be measured. The stage takes Arrow
    batches: modes of one shape are measured as one stack cut from the batch's own buffers, rows that miss an
    input or are no matrix one by one; all other columns pass through as they are, and what follows reads its
    output instead of repeating a call."""
    measures = T.StructType.fromDDL(MEASURES)
    types = {"double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    kinds = {f.name: types[f.dataType.simpleString()] for f in measures}

    def alone(batch: pa.RecordBatch, i: int) -> dict:
        try:
            m, w, low, high = (batch.column(name)[i].as_py() for name in ("mode", "omega", "low2", "high2"))
            if m is None or low is None or high is None:
                raise ValueError("mode, low2 and high2 are required")
            cells = np.array(m, dtype=float)
            return measure_one(cells, float(w), _array(low, cells.shape[1]), _array(high, cells.shape[1]), cfg)
        except (ValueError, TypeError, IndexError) as e:
            return {"measure_error": f"{type(e).__name__}: {e}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {name: np.ma.masked_all(len(batch), dtype=object if kind == pa.string() else kind.to_pandas_dtype()) for name, kind in kinds.items()}
            whole = np.all([batch.column(name).is_valid().to_numpy(zero_copy_only=False) for name in ("mode", "omega", "low2", "high2")], axis=0)
            cells, _ = _doubles(batch.column("mode").values)
            omega = batch.column("omega").to_numpy(zero_copy_only=False)
            (low, low_at), (high, high_at) = _doubles(batch.column("low2")), _doubles(batch.column("high2"))
            odd = np.ones(len(batch), dtype=bool)
            for (nhar, n), rows in _by_shape(batch.column("mode")).items():
                step = max(1, B.CELLS // (nhar * n))
                for k in range(0, len(rows), step):
                    part = [(i, np.asarray(cells[at : at + nhar * n]).reshape(nhar, n)) for i, at in rows[k : k + step] if whole[i]]
                    part = [(i, m) for i, m in part if np.isfinite(m).all()]
                    done, stack = [], []
                    for i, m in part:
                        try:
                            ends = P.extremum_at(m, float(omega[i]), low[low_at[i] : low_at[i + 1]], high[high_at[i] : high_at[i + 1]])
                        except (ValueError, TypeError, IndexError):
                            continue  # measured alone below, which says what is wrong
                        for name, value in zip(("ext_dr", "ext_df_gap", "ext_energy_frac", "ext_matched", "ext_r"), ends, strict=True):
                            if value is not None:
                                out[name][i] = value
                        done.append(i)
                        stack.append(m)
                    if done:
                        odd[done] = False
                        for name, values in _measure_stack(np.stack(stack), cfg).items():
                            out[name][done] = values
            for i in np.flatnonzero(odd).tolist():
                for name, value in alone(batch, i).items():
                    if value is not None:
                        out[name][i] = value
            found = [pa.array(out[name].data, mask=np.ma.getmaskarray(out[name]), type=kind, from_pandas=True) for name, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, *kinds])

    kept = [T.StructField(f.name, f.dataType) for f in df.schema]
    return df.mapInArrow(run, T.StructType([*kept, *measures]))


IDENTITY = ("path", "mode_key", "shot", "input_fingerprint")


def decide(df: DataFrame, cfg: GateConfig = GateConfig(), identity: tuple[str, ...] = IDENTITY) -> DataFrame:
    """rule_decision and primary_reason: the first gate that applies, else REVIEW. A mode needs its identity:
    columns that are absent, NULL or empty, or a fingerprint of another length than 64, make it invalid."""
    on = lambda *t: all(x is not None for x in t)
    c = F.col
    never = F.lit(False)
    axis = c("axis_peak_is_local_max") & (c("axis_peak") >= cfg.axis_amplitude) & (c("axis_halfmax_width_grid") <= cfg.axis_width) if on(cfg.axis_amplitude, cfg.axis_width) else never
    grid = c("grid_scale_candidate_found") & (c("grid_scale_peak") >= cfg.grid_amplitude) if on(cfg.grid_amplitude, cfg.grid_width) else never
    cross = (c("n_cross") > 0) & (c("W_star_max") > cfg.cross_energy) if on(cfg.cross_energy) else never
    hits = [c("cross_window_A_max") >= cfg.window_amplitude] * on(cfg.window_amplitude) + [c("cross_window_W_max") >= cfg.window_energy] * on(cfg.window_energy)
    window = (c("n_cross") > 0) & (hits[0] | hits[1] if len(hits) > 1 else hits[0]) if hits else never
    edge = c("edge_energy_peak_in_window") & (c("edge_energy_halfmax_width_grid") <= cfg.edge_width) if on(cfg.edge_width) else never
    bad_input = c("omega").isNull() | F.isnan("omega") | (c("omega") <= 0) | c("gamma_d").isNull() | F.isnan("gamma_d") | c("ntor").isNull() | (c("ntor") <= 0) | ~F.coalesce(c("gap_region"), F.lit("")).isin("tae_like", "mixed")
    for name in identity:
        text = c(name) if name in df.columns else F.lit(None).cast("string")
        bad_input = bad_input | F.coalesce(F.length(text) != 64 if name == "input_fingerprint" else text == "", F.lit(True))
    lacks = c("mode").isNull() | c("low2").isNull() | c("high2").isNull()
    reason = (
        F.when(bad_input, "RULE_INPUT_INVALID").when(lacks | c("measure_error").isNotNull(), "RULE_FEATURE_EXTRACTION_FAILED").when(axis, "BAD_AXIS_SPIKE").when(grid, "BAD_GRID_SCALE_SPIKE")
        .when(cross, "BAD_CONT_CROSS").when(window, "BAD_CONT_CROSS_WINDOW").when(edge, "BAD_EDGE_SPIKE").otherwise("NO_GOOD_TEMPLATE")
    )
    d = df.withColumn("primary_reason", reason)
    return d.withColumn("rule_decision", F.when(F.startswith("primary_reason", F.lit("RULE_")), "INVALID").when(F.startswith("primary_reason", F.lit("BAD_")), "BAD").otherwise("REVIEW"))


def evaluate(df: DataFrame, cfg: GateConfig = GateConfig(), identity: tuple[str, ...] = IDENTITY) -> DataFrame:
    """All gate features and the decision for routed modes. Without crossings the radii of the largest ones
    are NULL here, sums stay 0."""
    d = X.crossing_summary(X.with_energy(measure(df, cfg)), null_missing=True)
    return decide(X.cross_window(d, cfg.window_half_width), cfg, identity)
