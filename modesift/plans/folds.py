"""Leave-one-out over shots as a run that can be taken up again.

Each fold of each model is a stage table of its scored rows. The table's manifest is the fold's mark in
the ledger: a run given the same tables does only the folds that have none, and a dry run says which these
are. Folds are independent, so several run side by side, each in a scheduler pool of its own; one that
fails does not stop the others. Totals are made from the tables in one pass over all folds.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any
from urllib.parse import quote

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ml
from ..operators import relational as R
from ..operators import scoring as S
from ..sources import sinks
from ..sources.tables import RunTables
from . import training

COUNTS = ("n_matched", "tn_bad", "fp_bad_as_good", "fn_good_as_bad", "tp_good")
RATES = ("accuracy", "precision_good", "recall_good", "f1_good")
# Column names of the two lists, fixed by their readers.
SUMMARY_COLUMNS = ["shot", "n_train", "n_train_good", "n_train_bad", "n_test", "n_test_good", "n_test_bad", "model", *COUNTS, *RATES]
TOTAL_COLUMNS = ["model", "n_folds", *COUNTS, *RATES]


@dataclass(frozen=True)
class Model:
    """train(rows) -> what score(trained, rows) needs; score adds the column p (NULL where it can't)."""

    name: str
    train: Callable[[DataFrame], Any]
    score: Callable[[Any, DataFrame], DataFrame]


def forest(label: str = "y", name: str = "RF", **args) -> Model:
    return Model(name, lambda d: ml.train_forest(d, label, **args), lambda m, d: ml.score_forest(m, d, "p"))


def array_model(settings: training.Training, kind: str = "raw", key: str = "path", label: str = "y", name: str = "raw_CNN") -> Model:
    fit = lambda d: training.train_array_model(d, kind, key, label, settings)
    return Model(name, fit, lambda m, d: ml.score_array_model(d, m.weights, settings.rows, settings.cols, settings.how, out="p"))


class FoldError(RuntimeError):
    """Folds that failed, by (shot, model), each with its error; all others are done."""

    def __init__(self, failed: dict[tuple[str, str], BaseException]):
        super().__init__("; ".join(f"{s}/{m}: {type(e).__name__}: {e}" for (s, m), e in sorted(failed.items())))
        self.failed = failed


class LeaveOneOut:
    """The folds of df(key, shot, label, features ...) for some models. ``shots``: the folds to run (all);
    training rows are of all other shots, whether these are folds or not, and have a label of 0 or 1."""

    def __init__(self, df: DataFrame, models: list[Model], tables: RunTables, key: str = "path", shot: str = "shot", label: str = "y", shots: list[str] | None = None, threshold: float = 0.5):
        if len({m.name for m in models}) < len(models):
            raise ValueError("models need names of their own")
        self.models, self.tables, self.key, self.shot, self.label, self.threshold = models, tables, key, shot, label, threshold
        # Read by every fold, so that nothing before it is run again for each.
        self.rows = tables.stage("inputs", lambda: df.where(F.col(shot).isNotNull()))
        every = [r[0] for r in self.rows.select(shot).distinct().orderBy(shot).collect()]  # shots are few: one fold each
        self.shots = [s for s in every if shots is None or s in shots]
        if unknown := set(shots or ()) - set(every):
            raise ValueError(f"unknown shots {sorted(unknown)}")

    def _name(self, shot: str, model: str) -> str:
        return f"fold/{quote(model, safe='')}/{quote(str(shot), safe='')}"

    def ledger(self) -> list[dict]:
        """What a run would do: each fold, its rows, and whether it is done."""
        counts = {(r.fold, r.split): r for r in R.fold_counts(self.rows, self.shot, self.label).collect()}
        n = lambda s, split: {k: counts[s, split][k] for k in ("n_rows", "n_good", "n_bad")}
        return [{"shot": s, "model": m.name, "done": self.tables.has(self._name(s, m.name)), "train": n(s, "train"), "test": n(s, "test")} for s in self.shots for m in self.models]

    def _fold(self, shot: str, model: Model) -> DataFrame:
        own = F.col(self.shot) == shot
        trained = model.train(self.rows.where(~own & F.col(self.label).isin(0, 1)))
        scored = model.score(trained, self.rows.where(own))
        return scored.select(self.key, F.col(self.shot).alias("shot"), F.col(self.label).cast("int").alias("y"), F.lit(model.name).alias("model"), F.col("p").cast("double").alias("p"), (F.col("p") >= self.threshold).cast("int").alias("predicted"))

    def run(self, side_by_side: int = 4) -> list[tuple[str, str]]:
        """Does the folds that are not done; returns them. Raises FoldError after the others have ended."""
        todo = [(s, m) for s in self.shots for m in self.models if not self.tables.has(self._name(s, m.name))]
        spark: SparkSession = self.rows.sparkSession

        def one(job: tuple[int, tuple[str, Model]]) -> BaseException | None:
            slot, (shot, model) = job
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fold-{slot % side_by_side}")
            try:
                self.tables.stage(self._name(shot, model.name), lambda: self._fold(shot, model))
            except Exception as e:  # the other folds go on; run() raises it
                return e
            finally:
                spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
            return None

        with ThreadPoolExecutor(max(1, side_by_side)) as pool:
            ended = list(pool.map(inheritable_thread_target(one), enumerate(todo)))
        failed = {(s, m.name): e for (s, m), e in zip(todo, ended, strict=True) if e is not None}
        if failed:
            raise FoldError(failed)
        return [(s, m.name) for s, m in todo]

    def missing(self) -> list[tuple[str, str]]:
        return [(s, m.name) for s in self.shots for m in self.models if not self.tables.has(self._name(s, m.name))]

    def scored(self) -> DataFrame:
        """(key, shot, y, model, p, predicted) of all folds that are done."""
        kind = self.rows.schema[self.key].dataType
        out = self.rows.sparkSession.createDataFrame([], f"`{self.key}` {kind.simpleString()}, shot {self.rows.schema[self.shot].dataType.simpleString()}, y int, model string, p double, predicted int")
        for s in self.shots:
            for m in self.models:
                if self.tables.has(name := self._name(s, m.name)):
                    out = out.unionByName(self.tables.read(name))
        return out

    def summary(self) -> DataFrame:
        """A row a fold and model: rows it was trained and tested on, counts and rates."""
        return fold_summary(self.scored(), self.rows, self.shot, self.label)

    def write(self, root: str) -> None:
        """The lists of a run: folds, totals, and folds that are not there."""
        told = self.summary()
        sinks.write_csv(told, os.path.join(root, "loso_model_evaluation_summary.csv"), SUMMARY_COLUMNS, ["shot", "model"])
        sinks.write_csv(fold_totals(told), os.path.join(root, "loso_model_evaluation_totals.csv"), TOTAL_COLUMNS, ["model"])
        if lost := self.missing():
            sinks.write_rows(os.path.join(root, "loso_missing_outputs.csv"), ["shot", "missing"], [{"shot": s, "missing": self._name(s, m)} for s, m in lost])


def fold_summary(scored: DataFrame, rows: DataFrame, shot: str = "shot", label: str = "y") -> DataFrame:
    """Counts and rates of each (shot, model) of scored(shot, model, y, predicted), over rows that have a
    label and a prediction, beside the rows of the fold's two splits."""
    cells = S.metrics(S.confusion(scored.where(F.col("y").isin(0, 1) & F.col("predicted").isNotNull()), "y", "predicted", ["shot", "model"]))
    split = R.fold_counts(rows, shot, label)
    side = lambda name: split.where(F.col("split") == name).select(F.col("fold").alias("shot"), F.col("n_rows").alias(f"n_{name}"), F.col("n_good").alias(f"n_{name}_good"), F.col("n_bad").alias(f"n_{name}_bad"))
    return cells.join(side("train"), "shot").join(side("test"), "shot").select(*SUMMARY_COLUMNS)


def fold_totals(summary: DataFrame) -> DataFrame:
    """Counts summed over the folds of each model, rates from the sums."""
    return S.metrics(summary.groupBy("model").agg(F.count("*").alias("n_folds"), *(F.sum(c).alias(c) for c in COUNTS))).select(*TOTAL_COLUMNS)
