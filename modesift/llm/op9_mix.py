"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Every source gets a share of the word budget by its weight, but never more than ``max_epochs`` times
its own words; what a capped source cannot take is shared among the others by weight, until no target
is above its cap. That fixed point has a closed form: sort the sources by cap / weight, cap the ones
at the front, and the water level of the rest follows from running sums. A source's rate is its target
over its size: every document is taken floor(rate) whole times, and a seeded sample takes one more.

The sample is dealt without ordering a source in one place. Documents have a seeded draw, which is cut
into digits of up to 16 bits: all documents of a source are summed by the first digit, whole digits are taken
while they fit, and of the one digit in which the target falls the documents are summed by the next, and so
on, until what is left is at most twice ``bucket_docs`` documents or one draw; those are walked in the order of their draws,
taking as many rows of each draw as still fit. The words are counted once, in a written table of ids and sizes.

Defined results: null or empty text has size 0 and takes 0; a null source is a source of its own,
last in order; draws are of the id and the text, so only rows that repeat both share one, and of these as
many are taken as fit (which ones makes no difference: they are equal); an empty table gives no rows; extra columns pass through, names beginning with ``mix__`` are
reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, text_or_empty, word_count

WEIGHTS = (5, 2, 1)
#: A per-source table up to this many rows (about 6 MB with its sampled keys) is broadcast; beyond it, joined by shuffle.
BROADCAST_SOURCES = 2_000


def water_fill(sources: DataFrame, weights: tuple[int, ...], budget: float, max_epochs: float) -> DataFrame:
    """sources(source, source_size, ...) with each source's target. Weights repeat over the sources in
    code-point order, null last; the budget is a multiple of all sizes. One row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (rank + 1).cast("int"))
    whole = Window.partitionBy()
    caps = sources.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    caps = caps.withColumn("total", F.sum("source_size").over(whole) * F.lit(float(budget))).withColumn("weights", F.sum("weight").over(whole))
    front = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = front.rowsBetween(Window.unboundedPreceding, -1)
    caps = caps.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # The first source whose cap reaches the level of itself and all after it sets the level for the rest.
    fits = F.col("cap") >= F.col("level") * F.col("weight")
    level = F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("cap") / F.col("weight"))).over(whole)
    target = F.least(F.col("cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return caps.withColumn("target", target).drop("weight", "cap", "total", "weights", "level")


def sample_bounds(light: DataFrame, plan: DataFrame, bucket_docs: int) -> DataFrame:
    """(source, bits, edge, taken) of light(source, draw, size) and plan(source, need, docs): of the draws
    cut to their first ``bits`` bits those below ``edge`` are taken, and of those at it the ones in ``taken``
    (draw, its rows, and how many of them)."""
    run = Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    scratch = Scratch(light.sparkSession)
    first = F.least(F.lit(16), F.greatest(F.lit(0), F.ceil(F.log2(F.col("docs") / F.lit(float(bucket_docs)))))).cast("int")
    # What is still open: a source, the bits fixed so far, what they have to give, and how many bits come next.
    open_, done = plan.where("need > 0").select("source", "need", F.lit(0).alias("bits"), F.lit(0).cast("long").alias("edge"), first.alias("width")), []
    while True:
        small = F.broadcast if open_.count() <= BROADCAST_SOURCES else (lambda x: x)
        met = light.join(small(open_.withColumnRenamed("source", "o_source")), F.col("source").eqNullSafe(F.col("o_source")) & (F.expr("if(bits = 0, 0, shiftrightunsigned(draw, 64 - bits))") == F.col("edge")))
        sums = met.withColumn("digit", F.expr("if(width = 0, 0, shiftrightunsigned(shiftleft(draw, bits), 64 - width))"))
        sums = sums.groupBy("source", "need", "bits", "edge", "width", "digit").agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
        at = sums.withColumn("left", F.col("need") - F.coalesce(F.sum("words").over(run), F.lit(0))).where("left >= 0 and words > left")
        at = at.select("source", "left", "docs", (F.col("bits") + F.col("width")).alias("bits"), F.expr("shiftleft(edge, width) | digit").alias("edge"))
        at = scratch.write(at)
        last = (F.col("docs") <= 2 * bucket_docs) | (F.col("bits") == 64)
        done.append(at.where(last).select("source", "bits", "edge", "left"))
        open_ = at.where(~last).select("source", F.col("left").alias("need"), "bits", "edge", F.expr("least(16, 64 - bits)").alias("width"))
        if not open_.take(1):
            break
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    f = found.select(F.col("source").alias("f_source"), "bits", "edge", "left")
    cut = F.expr("if(bits = 0, 0, shiftrightunsigned(draw, 64 - bits))")
    near = light.join(F.broadcast(f) if found.count() <= BROADCAST_SOURCES else f, F.col("source").eqNullSafe(F.col("f_source"))).where(cut == F.col("edge"))
    near = near.groupBy("source", "bits", "edge", "left", "draw", "size").agg(F.count("*").alias("rows"))
    walked = near.groupBy("source", "bits", "edge", "left").agg(F.sort_array(F.collect_list(F.struct("draw", "size", "rows"))).alias("keys"))
    fit = lambda acc, k: F.when(k["size"] > 0, F.least(k["rows"], F.floor(acc["left"] / k["size"]).cast("long"))).otherwise(k["rows"])
    take = lambda acc, k: F.struct((acc["left"] - k["size"] * fit(acc, k)).alias("left"), F.concat(acc["taken"], F.array(F.struct(k["draw"].alias("draw"), k["rows"].alias("rows"), fit(acc, k).alias("n")))).alias("taken"))
    step = lambda acc, k: F.when(fit(acc, k) > 0, take(acc, k)).otherwise(acc)
    start = F.struct(F.col("left").cast("double").alias("left"), F.array().cast("array<struct<draw: bigint, rows: bigint, n: bigint>>").alias("taken"))
    return walked.select("source", "bits", "edge", F.aggregate("keys", start, step)["taken"].alias("taken"))


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", size_col: str | None = None, mark_col: str | None = None, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, max_epochs: float = 2.0, seed: int = 9, bucket_docs: int = 256) -> DataFrame:
    """df with mix__size, mix__source_size, mix__target and mix__copies (how often the mix takes the
    document). size_col, mark_col: columns of df that hold the sizes and hashes of the texts already."""
    spark = df.sparkSession
    size = F.col(size_col).cast("long") if size_col else word_count(text_or_empty(text_col))
    mark = F.col(mark_col) if mark_col else F.xxhash64(F.col(text_col))
    keyed = df.withColumn("mix__size", size).withColumn("mix__draw", F.xxhash64(F.lit(seed), F.col(id_col), F.col("mix__size"), mark))
    light = keyed.select(F.col(source_col).alias("source"), F.col("mix__draw").alias("draw"), F.col("mix__size").alias("size"))
    light = Scratch(spark).write(light)
    totals = light.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    plan = water_fill(totals, weights, budget, max_epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("whole", F.floor(rate + F.lit(1e-12)).cast("long")).withColumn("need", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    plan = Scratch(spark).write(plan)
    bounds = Scratch(spark).write(sample_bounds(light, plan, bucket_docs).withColumnRenamed("source", "b_source"))
    plan = plan.join(bounds, F.col("source").eqNullSafe(F.col("b_source")), "left").drop("b_source", "docs")
    plan = plan.select(*(F.col(c).alias(f"mix__p_{c}") for c in plan.columns))
    small = F.broadcast if plan.count() <= BROADCAST_SOURCES else (lambda x: x)
    out = keyed.join(small(plan), F.col(source_col).eqNullSafe(F.col("mix__p_source")), "left")
    # Draws are compared without a sign: the flipped highest bit orders them as they are dealt.
    cut, edge = (F.expr(f"{c} ^ shiftleft(1L, 63)") for c in ("if(mix__p_bits = 0, 0L, shiftrightunsigned(mix__draw, 64 - mix__p_bits))", "mix__p_edge"))
    own = F.get(F.filter("mix__p_taken", lambda x: x["draw"] == F.col("mix__draw")), F.lit(0))
    out = out.withColumn("mix__p_own", F.when(F.col("mix__p_edge").isNotNull() & (cut == edge), own))
    part = F.coalesce(F.col("mix__p_own.n") < F.col("mix__p_own.rows"), F.lit(False))
    if bounds.where(F.exists("taken", lambda x: x["n"] < x["rows"])).isEmpty():
        fits = F.col("mix__p_own").isNotNull()
    else:  # equal rows of which only some fit are numbered, and no others
        place = F.row_number().over(Window.partitionBy(source_col, "mix__draw").orderBy(F.lit(0)))
        out = out.where(~part).withColumn("mix__p_place", F.lit(0)).unionByName(out.where(part).withColumn("mix__p_place", place))
        fits = F.col("mix__p_place") <= F.col("mix__p_own.n")
    extra = (F.col("mix__p_need") > 0) & (F.col("mix__p_edge").isNull() | (cut < edge) | F.coalesce(fits, F.lit(False)))
    copies = F.col("mix__p_whole") + extra.cast("long")
    out = out.withColumns({"mix__source_size": F.col("mix__p_source_size"), "mix__target": F.col("mix__p_target"), "mix__copies": F.coalesce(F.least(copies, F.lit(int(max_epochs))), F.lit(0)).cast("long")})
    return out.drop("mix__draw", *(c for c in out.columns if c.startswith("mix__p_")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    sizes = Scratch(spark).write(docs.select("doc_id", "source", word_count(text_or_empty("text")).alias("words"), F.xxhash64("text").alias("mark")))
    out = mix(sizes, size_col="words", mark_col="mark")
    return out.select("doc_id", F.col("mix__size").alias("size"), F.col("mix__source_size").alias("source_size"), F.col("mix__target").alias("target"), (F.col("mix__size") * F.col("mix__copies")).alias("taken"), F.col("mix__copies").alias("copies"))
