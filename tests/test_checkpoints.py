"""Saved models of each kind, as archives of arrays and of tensors; files that name more than data."""

import collections
import io
import json
import pickle
import sys
import types
import zipfile

import numpy as np
import pytest

from modesift.functions import cnn as C
from modesift.operators import ml
from modesift.sources import checkpoints as K

SAID = {"raw": "cnn_raw", "raw3": "cnn_raw_continuum", "branch": "cnn_raw_continuum_branch", "hybrid": "cnn_hybrid"}


def tensors(held, weights, order="little"):
    """A zip archive as tensor libraries write it: names and shapes pickled, bytes beside them."""
    torch, utils = types.ModuleType("torch"), types.ModuleType("torch._utils")
    torch.FloatStorage = type("FloatStorage", (), {"__module__": "torch"})
    utils._rebuild_tensor_v2 = eval("lambda *a: None")
    utils._rebuild_tensor_v2.__module__, utils._rebuild_tensor_v2.__qualname__, utils._rebuild_tensor_v2.__name__ = "torch._utils", "_rebuild_tensor_v2", "_rebuild_tensor_v2"
    blobs = {}

    class Storage:
        def __init__(self, key):
            self.key = key

    class Tensor:
        def __init__(self, array):
            self.key, self.array = str(len(blobs)), array
            # Two elements of slack before, and columns first, so that offset and strides matter.
            blobs[self.key] = np.concatenate([[7, 7], array.ravel(order="F")]).astype("<f4" if order == "little" else ">f4").tobytes()

        def __reduce__(self):
            strides = np.cumprod([1, *self.array.shape[:-1]]).tolist() if self.array.ndim else []
            return utils._rebuild_tensor_v2, (Storage(self.key), 2, tuple(self.array.shape), tuple(strides), False, collections.OrderedDict())

    class Pickler(pickle.Pickler):
        def persistent_id(self, x):
            return ("storage", torch.FloatStorage, x.key, "cpu", 1) if isinstance(x, Storage) else None

    out = io.BytesIO()
    sys.modules |= {"torch": torch, "torch._utils": utils}
    try:
        body = io.BytesIO()
        Pickler(body, protocol=2).dump(held | {"model_state_dict": collections.OrderedDict((k, Tensor(np.asarray(v))) for k, v in weights.items())})
    finally:
        del sys.modules["torch"], sys.modules["torch._utils"]
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("model/data.pkl", body.getvalue())
        z.writestr("model/byteorder", order)
        for key, blob in blobs.items():
            z.writestr(f"model/data/{key}", blob)
    return out.getvalue()


def arrays(held, weights):
    out = io.BytesIO()
    stats = {k: held.pop(k) for k in ("scalars_mu", "scalars_sig") if k in held}
    np.savez(out, meta=json.dumps(held), **weights, **stats)
    return out.getvalue()


@pytest.mark.parametrize("kind", sorted(SAID))
@pytest.mark.parametrize("write", [tensors, arrays, lambda h, w: tensors(h, {f"module.{k}": v for k, v in w.items()}, "big")])
def test_each_kind_comes_back_and_scores(spark, tmp_path, kind, write):
    weights = {k: v.astype(np.float32) for k, v in C.random_weights(kind, seed=3).items()}
    held = {"normalize": "maxabs", "threshold": 0.25, "preprocess": {"R_target": 40, "continuum_clip": 3.0} | ({"M": 3, "median_k": 5} if kind == "hybrid" else {"M_target": 16, "continuum_channels": kind == "raw3"})}
    if kind == "hybrid":
        held |= {"scalars_mu": np.arange(8, dtype=np.float32), "scalars_sig": np.full(8, 2, dtype=np.float32)}
    (tmp_path / "m.pt").write_bytes(write(dict(held), weights))
    c = K.read_checkpoint(spark, f"file://{tmp_path}/m.pt")
    assert c.kind == kind and (c.normalise, c.threshold, c.settings["R_target"]) == ("maxabs", 0.25, 40)
    assert set(c.weights) == set(weights) and all(np.array_equal(c.weights[k], v) for k, v in weights.items())
    assert "M" not in c.assumed and ("max_step" in c.assumed) == (kind == "hybrid")
    rng = np.random.default_rng(1)
    mode = rng.normal(size=(4, 12)).astype(np.float32)
    df = spark.createDataFrame([(mode.tolist(), 1.0, 0.01, 1, [0.25] * 12, [2.25] * 12, 0.1, 0.2, 0.3, 0.4)], "mode array<array<double>>, omega double, gamma_d double, ntor int, low2 array<double>, high2 array<double>, delta2_eff double, W_star double, S double, r_star double")
    got = ml.score_checkpoint(df, c).first()
    low, high = np.full(12, 0.25), np.full(12, 2.25)
    if kind == "hybrid":
        values = (np.array([0.01, 0.1, 0.2, 0.3, 0.4, 1.0, 1, 1.0], dtype=np.float32) - np.arange(8)) / 2
        z = C.hybrid(weights, C.straight_image(mode.astype(float), 3, 40, 5, 2, "maxabs"), values.astype(np.float32))
    else:
        x = C.image(mode.astype(float), 1.0, low, high, 16, 40, "maxabs", kind == "raw3", 3.0)
        z = C.with_branch(weights, x, C.branch(mode.astype(float), 1.0, low, high, 40, clip=3.0)) if kind == "branch" else C.small(weights, x)
    assert got.p_cnn_error is None and got.p_cnn == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5) and got.p_cnn_label == ("good" if got.p_cnn >= 0.25 else "bad")


def test_kinds_without_telling_parts():
    w = {"features.0.weight": np.zeros((1, 1, 3, 3), dtype=np.float32)}
    kind = lambda name="", **held: K.interpret({"model_state_dict": w} | held, name).kind
    assert [kind(model_type=t) for t in ("cnn_raw", "raw_continuum", "straightened", "hybrid_cnn")] == ["raw", "raw3", "straightened", "hybrid"]
    assert kind(preprocess={"M_target": 9, "continuum_branch": True}) == "branch" and kind(preprocess={"M": 4}) == "straightened"
    assert kind(M_target=54) == "raw" and kind(M=8) == "straightened" and kind("best_raw_continuum.pt") == "raw3" and kind("a_straight.pt") == "straightened"
    assert K.interpret({"model_state_dict": w}, "x_raw.pt").assumed == list(K.RAW_SETTINGS) and K.interpret({"model_state_dict": w}, "x", "cnn_raw").kind == "raw"
    for bad in (lambda: kind("unknown.pt"), lambda: K.interpret({"model_state_dict": w}, "", "other"), lambda: K.interpret({"model_state_dict": {}}, "raw")):
        with pytest.raises(K.CheckpointError):
            bad()


class Call:
    def __reduce__(self):
        return print, ("called",)


@pytest.mark.parametrize("content", [b"", b"PK\x05\x06" + b"\0" * 18, b"x" * 99])
def test_no_archive(content):
    with pytest.raises(K.CheckpointError):
        K.decode(content)


def test_a_file_cannot_call_anything(capsys):
    with pytest.raises(K.CheckpointError, match="names"):
        K.decode(tensors({"extra": Call()}, C.random_weights("raw")))
    out = io.BytesIO()
    np.savez(out, meta="{}", evil=np.array([Call()], dtype=object))
    with pytest.raises(ValueError):
        K.decode(out.getvalue())
    assert capsys.readouterr().out == ""


def test_a_tensor_beyond_its_bytes():
    for args in ((np.zeros(4), 1, (2, 2), (2, 1)), (np.zeros(4), -1, (2,), (1,)), (np.zeros(4), 0, (2, 2), (1,))):
        with pytest.raises(K.CheckpointError):
            K._tensor(*args)
    assert K._tensor(np.arange(4.0), 0, (2, 2), (2, 1)).tolist() == [[0, 1], [2, 3]] and K._tensor(np.arange(4.0), 0, (0, 3), (3, 1)).shape == (0, 3)
