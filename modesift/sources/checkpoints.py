"""Saved array models: weights, kind and preprocess settings, read without running what a file says.

Two containers are read: NumPy archives (arrays by name, settings as JSON under ``meta``) and zip archives
of tensors (a pickle of names and shapes beside one file of raw bytes a tensor). The pickle is read by an
unpickler that knows the few names such a file needs, maps them to functions of its own and refuses all
others, so a file can name data but cannot call anything. Models of these kinds have under 100,000
weights; a file above ``MOST_BYTES`` is refused.
"""

from __future__ import annotations

import collections
import io
import json
import pickle
import zipfile
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import SparkSession

MOST_BYTES = 64 << 20
#: Element types of the tensors' raw bytes.
STORAGES = {"FloatStorage": "f4", "DoubleStorage": "f8", "HalfStorage": "f2", "LongStorage": "i8", "IntStorage": "i4", "ShortStorage": "i2", "CharStorage": "i1", "ByteStorage": "u1", "BoolStorage": "?"}
# Names of the kinds in files, and settings of files that state none.
KINDS = {"cnn_raw": "raw", "raw": "raw", "cnn_raw_continuum": "raw3", "raw_continuum": "raw3", "cnn_raw_continuum_branch": "branch", "raw_continuum_branch": "branch", "cnn_straightened": "straightened", "straightened": "straightened", "cnn_hybrid": "hybrid", "hybrid": "hybrid", "hybrid_cnn": "hybrid"}
RAW_SETTINGS = {"R_target": 201, "M_target": 54, "continuum_channels": False, "continuum_branch": False, "continuum_branch_zero_inputs": False, "continuum_clip": 5.0}
STRAIGHT_SETTINGS = {"R_target": 201, "M": 8, "center_power": 2.0, "median_k": 3, "max_step": 2}


class CheckpointError(ValueError):
    """A file that is no model of a known kind, or that names what data has no need of."""


@dataclass(frozen=True)
class Checkpoint:
    kind: str
    weights: dict[str, np.ndarray]
    settings: dict[str, Any]
    normalise: str = "none"
    threshold: float = 0.5
    scalars: tuple[np.ndarray, np.ndarray] | None = None
    assumed: list[str] = field(default_factory=list)  # settings that the file does not state


def _tensor(storage: np.ndarray, offset: int, size: tuple, stride: tuple, *_: Any) -> np.ndarray:
    if min((offset, *size, *stride), default=0) < 0 or len(size) != len(stride):
        raise CheckpointError("a tensor with negative or unequal sizes and strides")
    last = offset + sum((n - 1) * s for n, s in zip(size, stride, strict=True)) if all(size) else offset - 1
    if last >= len(storage):
        raise CheckpointError("a tensor reaches beyond its bytes")
    return np.lib.stride_tricks.as_strided(storage[offset:], size, tuple(s * storage.itemsize for s in stride)).copy()


def _array(kind: Any, shape: Any, code: Any) -> np.ndarray:
    return np.ndarray((0,), dtype="u1")  # its state follows and replaces all of it


class _Reader(pickle.Unpickler):
    """Names that data needs, and no others."""

    def __init__(self, file: io.BytesIO, archive: zipfile.ZipFile, root: str, order: str):
        super().__init__(file, encoding="utf-8")
        self.archive, self.root, self.order = archive, root, order
        self.held: dict[str, np.ndarray] = {}

    def find_class(self, module: str, name: str) -> Any:
        if module == "torch" and name in STORAGES:
            return STORAGES[name]
        known = {
            ("collections", "OrderedDict"): collections.OrderedDict, ("torch._utils", "_rebuild_tensor_v2"): _tensor, ("torch._utils", "_rebuild_parameter"): lambda data, *_: data,
            ("numpy", "dtype"): np.dtype, ("numpy", "ndarray"): np.ndarray, ("_codecs", "encode"): lambda text, how: text.encode("latin1") if how == "latin1" else self._no("_codecs.encode", how),
            **{(f"numpy.{core}.multiarray", n): f for core in ("core", "_core") for n, f in (("_reconstruct", _array), ("scalar", lambda kind, raw: np.frombuffer(raw, kind)[0]))},
        }
        return known.get((module, name)) or self._no(module, name)

    @staticmethod
    def _no(*names: str) -> Any:
        raise CheckpointError(f"the file names {'.'.join(names)}, which data has no need of")

    def persistent_load(self, told: Any) -> np.ndarray:
        kind, element, key = told[:3]
        if kind != "storage" or not isinstance(element, str):
            raise CheckpointError("an unknown kind of tensor bytes")
        if key not in self.held:
            self.held[key] = np.frombuffer(self.archive.read(f"{self.root}data/{key}"), dtype=np.dtype(element).newbyteorder(self.order)).astype(element)
        return self.held[key]


def decode(content: bytes) -> dict[str, Any]:
    """What a file holds: weights under ``model_state_dict`` and whatever else it states."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise CheckpointError("not an archive of arrays or tensors") from e
    if sum(i.file_size for i in archive.infolist()) > MOST_BYTES:
        raise CheckpointError(f"more than {MOST_BYTES} bytes")
    pickles = [n for n in archive.namelist() if n == "data.pkl" or n.endswith("/data.pkl")]
    if not pickles:
        if not any(n.endswith(".npy") for n in archive.namelist()):
            raise CheckpointError("an archive without arrays")
        with np.load(io.BytesIO(content), allow_pickle=False) as arrays:
            told = json.loads(str(arrays["meta"])) if "meta" in arrays.files else {}
            weights = {k: arrays[k] for k in arrays.files if k not in ("meta", "scalars_mu", "scalars_sig")}
            return told | {k: arrays[k] for k in ("scalars_mu", "scalars_sig") if k in arrays.files} | {"model_state_dict": weights}
    root = pickles[0].removesuffix("data.pkl")
    order = "<"
    if f"{root}byteorder" in archive.namelist():
        order = {b"little": "<", b"big": ">"}[archive.read(f"{root}byteorder").strip()]
    try:
        held = _Reader(io.BytesIO(archive.read(pickles[0])), archive, root, order).load()
    except (pickle.UnpicklingError, KeyError, TypeError, EOFError, AttributeError) as e:
        raise CheckpointError(f"{type(e).__name__}: {e}") from e
    if not isinstance(held, dict):
        raise CheckpointError("no set of named values")
    if "model_state_dict" not in held and isinstance(held.get("state_dict"), dict):
        held = held | {"model_state_dict": held["state_dict"]}
    return held if "model_state_dict" in held else {"model_state_dict": held}


def _kind(held: dict[str, Any], weights: dict[str, np.ndarray], settings: dict[str, Any], name: str) -> str:
    """The kind a file is of: by its parts, then by what it says of itself, then by its settings, then its name."""
    parts = {k.split(".")[0] for k in weights}
    if {"scalars_mu", "scalars_sig"} & set(held) or {"img_fc", "sc_fc"} & parts:
        return "hybrid"
    if {"mode_features", "continuum_features", "fusion"} <= parts:
        return "branch"
    if said := KINDS.get(str(held.get("model_type"))):
        return said
    if "M_target" in settings:
        return "branch" if settings.get("continuum_branch") else "raw3" if settings.get("continuum_channels") else "raw"
    if "preprocess" in held or set(STRAIGHT_SETTINGS) & set(held):
        return "raw" if "M_target" in held else "straightened"
    if "M_target" in held:
        return "raw"
    low = name.lower()
    for words, kind in ((("hybrid",), "hybrid"), (("raw", "continuum_branch"), "branch"), (("raw", "continuum"), "raw3"), (("straight",), "straightened"), (("raw",), "raw")):
        if all(w in low for w in words):
            return kind
    raise CheckpointError(f"{name}: no known kind; say which it is")


def interpret(held: dict[str, Any], name: str = "", kind: str = "auto") -> Checkpoint:
    """Kind, weights and settings of what a file holds; settings come from ``preprocess``, else from beside it, else are assumed."""
    weights = {str(k).removeprefix("module."): np.asarray(v) for k, v in held["model_state_dict"].items() if isinstance(v, np.ndarray)}
    if not weights or any(v.dtype.kind not in "fiub" for v in weights.values()):
        raise CheckpointError(f"{name}: no set of weights")
    own = held.get("preprocess") if isinstance(held.get("preprocess"), dict) else {}
    if kind != "auto" and kind not in KINDS and kind not in KINDS.values():
        raise CheckpointError(f"unknown kind {kind}; known are {', '.join(sorted(KINDS))}")
    found = _kind(held, weights, own, name) if kind == "auto" else KINDS.get(kind, kind)
    settings, assumed = {}, []
    for key, default in (STRAIGHT_SETTINGS if found in ("straightened", "hybrid") else RAW_SETTINGS).items():
        value = own.get(key) if own.get(key) is not None else held.get(key)
        if value is None:
            assumed.append(key)
        settings[key] = default if value is None else type(default)(value)
    scalars = None
    if found == "hybrid" and "scalars_mu" in held and "scalars_sig" in held:
        scalars = np.asarray(held["scalars_mu"], dtype=np.float32), np.asarray(held["scalars_sig"], dtype=np.float32)
    return Checkpoint(found, weights, settings, str(held.get("normalize") or "none"), float(held["threshold"] if held.get("threshold") is not None else 0.5), scalars, assumed)


def read_checkpoint(spark: SparkSession, path: str, kind: str = "auto") -> Checkpoint:
    """A saved model from any store that Spark reads."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    one = files.first()
    if one is None or one["length"] > MOST_BYTES:
        raise CheckpointError(f"{path}: no file, or more than {MOST_BYTES} bytes")
    content = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    return interpret(decode(bytes(content)), path.rsplit("/", 1)[-1], kind)
