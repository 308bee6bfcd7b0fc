"""The driver's tables in the roles of mode files, boundary profiles, scores and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HARMONICS, RADII, GROUPS = 4, 16, 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of 64 floats as modes of 4 harmonics by 16 radii."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(HARMONICS - 1)), lambda h: F.transform(F.slice("embedding", h * RADII + 1, RADII), lambda x: x.cast("double")))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("mode_id"), (F.col("label") + 1).cast("int").alias("ntor"), (F.lit(0.8) + (F.col("vec_id") % 97) / F.lit(97.0)).alias("omega"),
        (((F.col("vec_id") * 31) % 200 - 100) / F.lit(1000.0)).alias("gamma_d"), F.lit(RADII).alias("nr"), F.lit(HARMONICS).alias("nhar"), rows.alias("mode"),
    )


def continuum(spark: SparkSession) -> DataFrame:
    """Squared boundary frequencies of each group, with gaps at some radii: ten rows."""
    rows = []
    for n in range(1, GROUPS + 1):
        upper = [1.0 + 0.03 * n + 0.5 * ((i * (n + 2)) % 7) / 6.0 for i in range(RADII)]
        lower = [u - 0.35 - 0.15 * ((i * 3 + n) % 5) / 4.0 for i, u in enumerate(upper)]
        gap = [(i == 0 and n % 2 == 0) or (i == 9 and n % 3 == 0) for i in range(RADII)]
        rows.append((n, [None if g else x * x for x, g in zip(lower, gap, strict=True)], [None if g else x * x for x, g in zip(upper, gap, strict=True)]))
    return spark.createDataFrame(rows, "n int, low2 array<double>, high2 array<double>")


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes with their group's profile: ten rows of it, broadcast by size."""
    return modes(spark, sf_dir).join(F.broadcast(continuum(spark)), F.col("ntor") == F.col("n"), "left").drop("n")


def shot_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary profiles (shot, n, low2, high2): half a vector a boundary, five vectors in a row a shot, and no
    boundary where a component is above a limit."""
    edge = lambda start, base: F.transform(F.slice("embedding", start, 32), lambda x: F.when(x <= 0.3, F.pow(base + x.cast("double"), F.lit(2.0))))
    return table(spark, sf_dir, "embeddings").select((F.floor(F.col("vec_id") / 5)).alias("shot"), (6 + F.col("vec_id") % 5).cast("int").alias("n"), edge(1, F.lit(1.0)).alias("low2"), edge(33, F.lit(1.3)).alias("high2"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as scored rows of a run: two probabilities by integer arithmetic, a label where there is one."""
    d, y = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    i = F.col("doc_id")
    return d.join(y, "doc_id", "left").select(
        "doc_id", F.col("source").alias("shot"), (i % 10 + 1).cast("int").alias("n"), ((i * 7919) % 1000 / F.lit(1000.0)).alias("p_rf"), ((i * 104729) % 1000 / F.lit(1000.0)).alias("p_cnn"),
        F.col("quality").alias("y"), F.when(i % 11 == 0, "mode_load_failed").when(i % 13 == 0, "nonfinite_mode_data").otherwise("").alias("rejection_reason"),
        F.when(i % 4 == 0, "eae_like").when(i % 4 == 1, "mixed").otherwise("tae_like").alias("gap_region"),
    )


#: The same roles in DuckDB SQL, one row a cell.
MODES_SQL = f"""
m AS (SELECT vec_id AS mode_id, (label + 1)::INTEGER AS ntor, 0.8e0 + (vec_id % 97) / 97e0 AS omega, ((vec_id * 31) % 200 - 100) / 1000e0 AS gamma_d, embedding FROM embeddings),
cells AS (SELECT mode_id, ntor, omega, h, i, i / {RADII - 1}e0 AS r, embedding[h * {RADII} + i + 1]::DOUBLE AS a FROM m, range({HARMONICS}) hs(h), range({RADII}) rs(i)),
w AS (SELECT mode_id, ntor, omega, i, r, sum(a * a) AS w FROM cells GROUP BY ALL),
u AS (SELECT n, i, 1e0 + 0.03e0 * n + 0.5e0 * ((i * (n + 2)) % 7) / 6e0 AS u FROM range(1, {GROUPS + 1}) ns(n), range({RADII}) rs(i)),
cont AS (SELECT n, i, CASE WHEN (i = 0 AND n % 2 = 0) OR (i = 9 AND n % 3 = 0) THEN NULL ELSE (u - 0.35e0 - 0.15e0 * ((i * 3 + n) % 5) / 4e0) * (u - 0.35e0 - 0.15e0 * ((i * 3 + n) % 5) / 4e0) END AS low2,
  CASE WHEN (i = 0 AND n % 2 = 0) OR (i = 9 AND n % 3 = 0) THEN NULL ELSE u * u END AS high2 FROM u),
wc AS (SELECT w.*, low2, high2 FROM w JOIN cont ON cont.n = w.ntor AND cont.i = w.i)
"""
SCORES_SQL = """
s AS (SELECT d.doc_id, source AS shot, (d.doc_id % 10 + 1)::INTEGER AS n, ((d.doc_id * 7919) % 1000) / 1000e0 AS p_rf, ((d.doc_id * 104729) % 1000) / 1000e0 AS p_cnn, quality AS y,
  CASE WHEN d.doc_id % 11 = 0 THEN 'mode_load_failed' WHEN d.doc_id % 13 = 0 THEN 'nonfinite_mode_data' ELSE '' END AS rejection_reason,
  CASE WHEN d.doc_id % 4 = 0 THEN 'eae_like' WHEN d.doc_id % 4 = 1 THEN 'mixed' ELSE 'tae_like' END AS gap_region
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
"""
