"""Quality by hierarchical empirical Bayes.

Three levels of evidence are combined. The document's own comes from a classifier on features of its
text. Hosts and paths carry posteriors: with n labelled documents and k good ones, a path's rate is
shrunk towards its host's and the host's towards the global rate,

    host = (k_h + s_h * global) / (n_h + s_h),   path = (k_p + s_p * host) / (n_p + s_p),

so that sparse sites fall back on what is above them. The strengths s are estimated from the spread of
the rates themselves (method of moments over all hosts, and over all paths around their hosts). The
score adds, in log odds, the classifier's evidence and the path's posterior shift from the global rate.

All counts are grouped aggregations over all labelled rows that are not held out, whatever their
number (a labelled row's own label is thus among those of its site); the classifier's eight weights are
fitted on at most ``sample`` of the documents (30,000), of rows that repeat an id on the least text.

Defined results: null text is empty text; null host and path are one host and path of their own; rows
without label count nowhere; hosts without labels get the global rate; with no labels every score is
1/2; repeated rows get equal scores; an empty table gives no rows; extra columns pass through, names
beginning with ``q__`` or ``quality__`` are reserved.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, crc_mod, documents, text_or_empty
from .op4_toxicity import fit_logistic, labelled

SAMPLE = 30_000


def features(text: Column) -> list[Column]:
    """Shares and rates that tell prose from junk, all between 0 and about 1."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    kept = lambda pattern: F.length(F.regexp_replace(text, pattern, "")) / n
    words = F.split(F.trim(text), r"\s+")
    count = F.greatest(F.size(words), F.lit(1)).cast("double")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(x) > 0)
    return [
        F.least(F.log1p(n) / 12, F.lit(1.0)),
        kept(r"[^\p{Lu}]"),
        kept(r"[^0-9]"),
        kept(r"[\p{L}\p{Nd}\s]"),
        F.size(F.array_distinct(words)) / count,
        F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        F.least((F.length(text) / count) / 20, F.lit(2.0)),
        kept(r"[^.!?|#@*]") * 10,
    ]


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: str) -> float:
    """Prior strength by moments: groups(k, n, mean) of binomial counts around their means."""
    row = groups.where("n > 1").select(
        F.sum(F.pow(F.col("k") / F.col("n") - F.col(mean), 2) * F.col("n")).alias("ss"), F.sum(F.col(mean) * (1 - F.col(mean))).alias("binomial"),
        F.sum(F.col("n") * F.col(mean) * (1 - F.col(mean))).alias("spread"),
    ).first()
    ss, binomial, spread = (float(x or 0.0) for x in row)
    # E[ss] = sum of m(1-m) (1 + (n-1) r) with r the correlation inside a group; strength = (1-r)/r.
    if spread - binomial <= 0 or ss <= binomial:
        return 1e6
    r = min(0.999, (ss - binomial) / (spread - binomial))
    return float(np.clip((1 - r) / max(r, 1e-6), 0.5, 1e6))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """docs with quality__own (classifier), quality__host, quality__path (posterior rates) and quality__score."""
    cols = docs.columns
    base = docs.withColumns({"q__host": host, "q__path": path})
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).where(crc_mod(F.col("doc_id"), 5) != 0).groupBy("doc_id").agg(F.max(label_col).cast("double").alias("q__y"))
    sites = Scratch(docs.sparkSession).write(base.select("doc_id", "q__host", "q__path").join(known, "doc_id").groupBy("q__host", "q__path").agg(F.sum("q__y").alias("k"), F.count("*").alias("n")))
    whole = sites.agg(F.sum("k").alias("k"), F.sum("n").alias("n")).first()
    if not whole["n"]:
        return base.select(*(F.col(f"`{c}`") for c in cols), *(F.lit(0.5).alias(f"quality__{c}") for c in ("own", "host", "path", "score")))
    overall = (whole["k"] + 0.5) / (whole["n"] + 1.0)
    hosts = sites.groupBy("q__host").agg(F.sum("k").alias("k"), F.sum("n").alias("n")).withColumn("m", F.lit(overall))
    s_host = _strength(hosts, "m")
    hosts = hosts.select(F.col("q__host").alias("q__h"), ((F.col("k") + s_host * overall) / (F.col("n") + s_host)).alias("quality__host"))
    paths = sites.join(hosts, sites.q__host.eqNullSafe(hosts.q__h))
    s_path = _strength(paths.select("k", "n", "quality__host"), "quality__host")
    paths = paths.select(F.col("q__host").alias("q__h2"), F.col("q__path").alias("q__p2"), ((F.col("k") + s_path * F.col("quality__host")) / (F.col("n") + s_path)).alias("quality__path"))

    x = features(text_or_empty(text_col))
    drawn = labelled(docs, labels, label_col, sample, text_col)
    rows = drawn.select(F.col(label_col).cast("double").alias("q__y"), *(c.alias(f"x{k}") for k, c in enumerate(features(text_or_empty("text"))))).toArrow().to_pandas()
    y = rows.pop("q__y").to_numpy()
    fit = fit_logistic(rows.to_numpy(dtype=float), y, ridge=0.1) if 0 < y.sum() < len(y) else np.array([np.log(overall / (1 - overall)), *[0.0] * len(x)])
    z = F.lit(float(fit[0]))
    for w, c in zip(fit[1:], x, strict=True):
        z = z + F.lit(float(w)) * c
    out = base.withColumn("q__z", z).join(hosts, F.col("q__host").eqNullSafe(F.col("q__h")), "left").join(paths, F.col("q__host").eqNullSafe(F.col("q__h2")) & F.col("q__path").eqNullSafe(F.col("q__p2")), "left")
    out = out.withColumn("quality__host", F.coalesce("quality__host", F.lit(overall))).withColumn("quality__path", F.coalesce("quality__path", "quality__host"))
    shift = _logit(F.least(F.greatest("quality__path", F.lit(1e-6)), F.lit(1 - 1e-6))) - F.lit(float(np.log(overall / (1 - overall))))
    sigmoid = lambda v: 1 / (1 + F.exp(-v))
    return out.withColumns({"quality__own": sigmoid(F.col("q__z")), "quality__score": sigmoid(F.col("q__z") + shift)}).select(*(F.col(f"`{c}`") for c in cols), "quality__own", "quality__host", "quality__path", "quality__score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source as host and source and language as path."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source", "lang")
    out = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.col("source"), F.col("lang"))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), *(F.col(f"quality__{c}").alias(n) for c, n in (("own", "own_score"), ("host", "host_rate"), ("path", "path_rate"), ("score", "score"))), (F.col("quality__score") >= 0.5).cast("int").alias("predicted"))
