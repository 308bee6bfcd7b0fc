"""Tree and array models over modes: train, score, out-of-fold, and batch classification.

The forest is ``pyspark.ml``'s: close to other forests in quality, not equal in bits (binned splits,
depth of at most 30, another bootstrap). Array models are scored, not trained: weights come as arrays.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cnn as C
from ..sources.checkpoints import Checkpoint
from .features import feature_names, schema_version
from .scoring import stratified_split

#: Width of each schema: whether it has crossings and an extremum.
WIDTHS = {len(feature_names(c, e)): (c, e) for c in (False, True) for e in (False, True)}


def schema_of(width: int, energy_tie: bool = False, r_shear0: float = 0.2) -> dict:
    """What a model must agree on with the features it scores."""
    crossing, extremum = WIDTHS[width]
    return {"count": width, "names": list(feature_names(crossing, extremum)), "version": schema_version(crossing, extremum, energy_tie), "crossing": crossing, "extremum": extremum, "energy_tie": energy_tie, "r_shear0": r_shear0}


def train_forest(df: DataFrame, label: str = "y", trees: int = 300, depth: int = 30, seed: int = 42) -> PipelineModel:
    """df(features array, label 0/1) -> model; classes weigh the same."""
    d = df.where(F.col(label).isin(0, 1))
    counts = {r[0]: r[1] for r in d.groupBy(label).count().collect()}
    n = sum(counts.values())
    weight = F.when(F.col(label) == 1, n / (2 * counts.get(1, 1))).otherwise(n / (2 * counts.get(0, 1)))
    d = d.select(array_to_vector("features").alias("raw"), F.col(label).cast("double").alias("label"), weight.alias("weight"))
    forest = RandomForestClassifier(featuresCol="scaled", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed)
    return Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), forest]).fit(d)


def score_forest(model: PipelineModel, df: DataFrame, out: str = "p_rf") -> DataFrame:
    """df with the share of good. A model without probabilities gives the logistic of its margin, and one
    without margins its prediction."""
    scored = model.transform(df.withColumn("raw", array_to_vector("features")))
    if "probability" in scored.columns:
        p = vector_to_array("probability")[1]
    elif "rawPrediction" in scored.columns:
        p = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    else:
        p = F.col("prediction")
    return scored.withColumn(out, p).drop("raw", "scaled", "rawPrediction", "probability", "prediction")


def save_forest(model: PipelineModel, path: str, spark: SparkSession, width: int, energy_tie: bool = False) -> None:
    """The model, and beside it the schema of its features."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(schema_of(width, energy_tie)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")


def load_forest(path: str, spark: SparkSession, width: int, energy_tie: bool = False) -> PipelineModel:
    """The model, if it was trained on the same features."""
    meta, want = json.loads(spark.read.text(f"{path}/schema").first()[0]), schema_of(width, energy_tie)
    if meta != want:
        raise ValueError(f"model has features {meta['version']}, need {want['version']}")
    return PipelineModel.load(f"{path}/model")


def folds(df: DataFrame, key: str, label: str = "y", k: int = 5, seed: int = 42) -> DataFrame:
    """fold 0..k-1, each label dealt out evenly: within a label rows are numbered in a seeded hash order,
    cut into 2^12 parts so that no label is ordered in one place, and parts go on where the last one ended."""
    h = F.xxhash64(F.lit(seed), key)
    d = df.withColumns({"fold__h": h, "fold__part": F.shiftrightunsigned(h, 52)})
    counts = d.groupBy(F.col(label).alias("fold__label"), F.col("fold__part").alias("fold__p")).agg(F.count("*").alias("fold__n"))
    before = Window.partitionBy("fold__label").orderBy("fold__p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("fold__before", F.coalesce(F.sum("fold__n").over(before), F.lit(0))).drop("fold__n")
    d = d.withColumn("fold__rank", F.row_number().over(Window.partitionBy(label, "fold__part").orderBy("fold__h", key)))
    d = d.join(counts, F.col(label).eqNullSafe(F.col("fold__label")) & (F.col("fold__part") == F.col("fold__p")))
    return d.withColumn("fold", F.pmod(F.col("fold__before") + F.col("fold__rank"), F.lit(k)).cast("int")).drop(*(c for c in d.columns if c.startswith("fold__")))


def cross_validate(df: DataFrame, key: str, label: str = "y", k: int = 5, **forest) -> DataFrame:
    """(fold, n, accuracy) of forests trained on the other folds."""
    scored = out_of_fold(df.where(F.col(label).isin(0, 1)), key, label, k, **forest)
    right = ((F.col("p_oof") >= 0.5).cast("int") == F.col(label)).cast("double")
    return scored.groupBy("fold").agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"))


def holdout(df: DataFrame, key: str, label: str = "y", fraction: float = 0.1, **forest) -> tuple[DataFrame, PipelineModel]:
    """Scores of a stratified share by a forest trained on the rest, and the forest refitted on all."""
    d = stratified_split(df.where(F.col(label).isin(0, 1)), label, key, fraction)
    model = train_forest(d.where(~F.col("is_test")), label, **forest)
    return score_forest(model, d.where("is_test")), train_forest(df, label, **forest)


def out_of_fold(df: DataFrame, key: str, label: str = "y", k: int = 5, **forest) -> DataFrame:
    """df with p_oof, each fold scored by a forest trained on the others."""
    d = folds(df, key, label, k)
    parts = [score_forest(train_forest(d.where(F.col("fold") != i), label, **forest), d.where(F.col("fold") == i), "p_oof") for i in range(k)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def importances(model: PipelineModel, width: int) -> list[tuple[str, float]]:
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(schema_of(width)["names"], values.tolist(), strict=True), key=lambda x: -x[1])


def score_checkpoint(df: DataFrame, checkpoint: Checkpoint, threshold: float | None = None, out: str = "p_cnn") -> DataFrame:
    """df scored by a saved model with the settings it was trained with."""
    c, s = checkpoint, checkpoint.settings
    if s.get("center_power", 2.0) != 2.0:
        raise ValueError("ridges are centres of energy: center_power must be 2")
    straight = (s["M"], s["median_k"], s["max_step"]) if c.kind in ("straightened", "hybrid") else None
    rows = 2 * s["M"] + 1 if straight else s["M_target"]
    return score_array_model(df, c.weights, rows, s["R_target"], c.normalise, c.threshold if threshold is None else threshold, out, straight, c.scalars, s.get("continuum_clip", C.CLIP), s.get("continuum_branch_zero_inputs", False))


def score_array_model(df: DataFrame, weights: dict[str, np.ndarray], rows: int = 64, cols: int = 201, how: str = "robust", threshold: float = 0.5, out: str = "p_cnn", straight: tuple[int, int, int] | None = None, scalars: tuple[np.ndarray, np.ndarray] | None = None, clip: float = C.CLIP, zero_branch: bool = False) -> DataFrame:
    """df with p (NULL where a mode cannot be scored), its label and an error. Weights are broadcast: a
    model of these kinds has under 100,000 of them. straight: half width, median and step of the window
    around the ridge that stands for the image; scalars: means and deviations of the hybrid model's."""
    kind = C.kind_of(weights)
    held = df.sparkSession.sparkContext.broadcast(weights)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def one(r, p: dict) -> float:
        mode = np.array([list(x) for x in r.mode], dtype=float)
        blank = np.full(mode.shape[1], np.nan)
        low, high = (blank if v is None else np.array([np.nan if x is None else x for x in v], dtype=float) for v in (r.low2, r.high2))
        if not np.isfinite(mode).all() or not np.isfinite(r.omega) or r.omega <= 0:
            raise ValueError("mode or omega is not usable")
        x = C.straight_image(mode, straight[0], cols, *straight[1:], how) if straight else C.image(mode, r.omega, low, high, rows, cols, how, channels=kind == "raw3", clip=clip)
        if kind == "branch":
            z = C.with_branch(p, x, C.branch(mode, r.omega, low, high, cols, zero_branch, clip))
        elif kind == "hybrid":
            has = r.low2 is not None
            values = np.array([r.gamma_d, r.delta2_eff if has else 1e3, r.W_star if has else 0.0, r.S if has else 1e3, r.r_star if has else 0.0, r.omega, r.ntor, float(has)], dtype=np.float32)
            z = C.hybrid(p, x, values if scalars is None else (values - scalars[0]) / scalars[1])
        else:
            z = C.small(p, x)
        return float(1 / (1 + np.exp(-z)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = held.value
        for frame in frames:
            values, errors = [], []
            for r in frame.itertuples(index=False):
                try:
                    values.append(one(r, p))
                    errors.append(None)
                except (ValueError, TypeError) as e:
                    values.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield frame.assign(**{out: pd.array(values, dtype="Float64"), f"{out}_error": errors})

    scored = df.mapInPandas(run, f"{fields}, `{out}` double, `{out}_error` string")
    return scored.withColumn(f"{out}_label", F.when(F.col(out) >= threshold, "good").when(F.col(out).isNotNull(), "bad"))


def scalar_stats(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation (+1e-6) of finite values; the last column is left as it is."""
    finite = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    row = df.agg(*(F.avg(finite(c)).alias(f"m_{c}") for c in columns), *(F.stddev_pop(finite(c)).alias(f"s_{c}") for c in columns)).first()
    out = {c: (row[f"m_{c}"] or 0.0, (row[f"s_{c}"] or 0.0) + 1e-6) for c in columns}
    out[columns[-1]] = (0.0, 1.0)
    return out
