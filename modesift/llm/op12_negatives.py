"""Hard-negative mining by dual-tree search over integer inner products.

Vectors become integers (floor of ``scale`` times each component), so scores are exact. Two sweeps answer
two questions: an anchor's best rows of its own label (its positives), and for each positive the best
rows of other labels with scores between two shares of the positive's score. A sweep is the same search
for the best k rows with scores from a low to a high bound.

Both sides have a tree. Its upper part are cells fitted on a bounded sample: candidates are dealt to
candidate cells and anchors to anchor groups, and of each cell the ball around its rows (over all rows)
and the range of their labels are kept. For an anchor group and a cell the balls bound all inner products
between them; if that interval misses what the group's anchors still ask for, the cell is passed over for
the whole group. What is left are units of a group of at most ``ANCHORS`` anchors and a block of at most
``VALUES`` components of candidates. In a unit both sides are ball trees, pairs of nodes are pruned by
the same intervals from the roots down, and pairs of leaves are scored exactly, the most promising first;
scores found raise the low bounds, and these prune on. Partial results are merged by a ranking window.

Low bounds start from a bounded sample of rows: the k-th best of some rows is never above the k-th best
of all. So nothing is lost, whatever the sample.

Bounds: cells and first bounds come from at most 2^19 components of sampled vectors, at most ``CELLS``
cells a side; all rows take part in the search. Anchors are a stated query set; work is at worst anchors
times rows, in blocks.

Defined results: rows with a null id, a null label, a null or empty vector, a component that is null or
not finite, or one so large that a hundredfold score could leave 64 bits take no part; vectors of
different lengths are not compared; each row counts, repeated ids and vectors too (an anchor is never its
own positive, a copy of it may be); positives with a score below 0 have no negatives; equal scores go by
the smaller id; anchors without positives or negatives give no rows; extra columns are ignored. Labels
are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, draw

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 10, 30, 90, 256
ANCHORS, VALUES, SAMPLED = 1024, 1 << 19, 1 << 19
CELL, CELLS = 4096, 512
LEAF_ANCHORS, LEAF = 16, 64
_MOST = np.iinfo(np.int64).max


class Tree:
    """A ball tree of complete levels: node i of level l holds rows ``order[cut[l][i]:cut[l][i + 1]]``."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.order = np.arange(len(x))
        self.cut = [np.array([0, len(x)])]
        while (len(x) >> (len(self.cut) - 1)) > leaf:
            cut, halves = self.cut[-1], []
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                own = self.order[lo:hi]
                p = x[own[((x[own] - x[own].mean(axis=0)) ** 2).sum(axis=1).argmax()]]
                q = x[own[((x[own] - p) ** 2).sum(axis=1).argmax()]]
                along = x[own] @ (q - p)
                by = np.argsort(along, kind="stable")
                self.order[lo:hi] = own[by]
                first, stop = (hi - lo) // 2, (hi - lo) // 2 + 1
                if leaf >= 16 and hi - lo >= 64:  # at the widest gap near the middle; small nodes in halves, so that none is empty
                    first, stop = 3 * (hi - lo) // 8, 5 * (hi - lo) // 8
                halves.append(lo + first + int(np.diff(along[by[first - 1 : stop]]).argmax()))
            self.cut.append(np.sort(np.concatenate([cut, halves])))
        x = x[self.order]
        self.balls = [_balls(x, cut) for cut in self.cut]

    def leaves(self) -> np.ndarray:
        return self.balls[-1][0]


def _balls(x: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Middle and radius of each run of rows."""
    middle = np.add.reduceat(x, cut[:-1], axis=0) / np.diff(cut)[:, None]
    far = ((x - np.repeat(middle, np.diff(cut), axis=0)) ** 2).sum(axis=1)
    return middle, np.sqrt(np.maximum.reduceat(far, cut[:-1]))


def interval(a: np.ndarray, ra: np.ndarray, b: np.ndarray, rb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most inner product of points of two balls (rows of a, b with radii), with room for rounding."""
    na, nb = np.linalg.norm(a, axis=-1), np.linalg.norm(b, axis=-1)
    room = na * rb + nb * ra + ra * rb + 1e-9 * (na + ra) * (nb + rb) + 1e-6
    at = (a * b).sum(axis=-1)
    return at - room, at + room


class Asked:
    """What the anchors of a unit ask for: for each question a low and a high bound and the best found so far."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.questions = low.shape[1]
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0
        self.best = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, anchor: np.ndarray, question: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.new.append((anchor * self.questions + question, score, ids))
        self.held += len(score)
        if self.held > max(4096, 2 * self.low.size * self.k):
            self.settle()

    def settle(self) -> None:
        """Keeps the k best of each question and raises the low bounds of those that have k."""
        q, score, ids = (np.concatenate(x) for x in zip(self.best, *self.new, strict=True))
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        self.best = q[keep], score[keep], ids[keep]
        last = place == self.k - 1
        flat = self.low.reshape(-1)
        flat[q[last]] = np.maximum(flat[q[last]], score[last])
        self.new, self.held = [], 0


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; in doubles where these hold them."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 2.0**53 else a @ b.T


def dual_search(anchors: dict[str, np.ndarray], rows: dict[str, np.ndarray], k: int, same: bool, stats: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor place, question, score, id) of the best k rows of each question.

    anchors: rid, label, vec, low and high (a column a question); rows: rid, label, vec, id."""
    a_tree, c_tree = Tree(anchors["vec"].astype(np.float64), LEAF_ANCHORS), Tree(rows["vec"].astype(np.float64), LEAF)
    a = {n: v[a_tree.order] for n, v in anchors.items()}
    c = {n: v[c_tree.order] for n, v in rows.items()}
    asked = Asked(a["low"].copy(), a["high"], k)

    def open_(level: tuple[int, int], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether pairs of nodes can hold answers, and the most that they promise."""
        at, ct = a_tree.cut[level[0]], c_tree.cut[level[1]]
        (am, ar), (cm, cr) = a_tree.balls[level[0]], c_tree.balls[level[1]]
        lo, hi = interval(am[i], ar[i], cm[j], cr[j])
        fair = asked.low <= asked.high
        low = np.minimum.reduceat(np.where(fair, asked.low, _MOST).min(axis=1), at[:-1])
        high = np.maximum.reduceat(np.where(fair, asked.high, -_MOST).max(axis=1), at[:-1])
        al, ah = np.minimum.reduceat(a["label"], at[:-1])[i], np.maximum.reduceat(a["label"], at[:-1])[i]
        cl, ch = np.minimum.reduceat(c["label"], ct[:-1])[j], np.maximum.reduceat(c["label"], ct[:-1])[j]
        labels = (cl <= ah) & (ch >= al) if same else ~((al == ah) & (cl == al) & (ch == al))
        return (hi >= low[i]) & (lo <= high[i]) & labels, hi

    level, i, j = (0, 0), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    last = len(a_tree.cut) - 1, len(c_tree.cut) - 1
    while True:
        ok, most = open_(level, i, j)
        i, j, most = i[ok], j[ok], most[ok]
        if level == last or not len(i):
            break
        if level[0] < last[0]:
            i, j = np.concatenate([2 * i, 2 * i + 1]), np.concatenate([j, j])
        if level[1] < last[1]:
            i, j = np.concatenate([i, i]), np.concatenate([2 * j, 2 * j + 1])
        level = min(level[0] + 1, last[0]), min(level[1] + 1, last[1])
    order = np.argsort(-most, kind="stable")
    scored = 0
    for p, q, top in zip(i[order].tolist(), j[order].tolist(), most[order].tolist(), strict=True):
        rows_a, rows_c = slice(*a_tree.cut[-1][p : p + 2]), slice(*c_tree.cut[-1][q : q + 2])
        if top < asked.low[rows_a].min():
            continue
        scored += 1
        s = products(a["vec"][rows_a], c["vec"][rows_c])
        fits = a["label"][rows_a, None] == c["label"][None, rows_c]
        fits = fits & (a["rid"][rows_a, None] != c["rid"][None, rows_c]) if same else ~fits
        low, high = asked.low[rows_a], asked.high[rows_a]
        for question in range(low.shape[1]):
            x, y = np.nonzero(fits & (s >= low[:, question, None]) & (s <= high[:, question, None]))
            if len(x):
                asked.add(x + rows_a.start, np.full(len(x), question), s[x, y], c["id"][rows_c][y])
    asked.settle()
    if stats is not None:
        stats |= {"scored": scored, "pairs": len(a_tree.leaves()) * len(c_tree.leaves())}
    at, score, ids = asked.best
    return a_tree.order[at // asked.questions], at % asked.questions, score, ids


def _matrix(column: pd.Series, kind=np.int64) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(kind)


def _router(middles: np.ndarray | None, name: str):
    """Adds the nearest middle's number and the distance from it; vectors of another length: -1, from the origin."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            lens = f["vec"].map(len)
            cell, far = np.full(len(f), -1), np.zeros(len(f))
            for n in lens.unique():
                mine = np.flatnonzero(lens == n)
                for k in range(0, len(mine), 1024):
                    at = mine[k : k + 1024]
                    x = _matrix(f["vec"].iloc[at], np.float64)
                    if middles is not None and n == middles.shape[1]:
                        gap = (x**2).sum(axis=1)[:, None] + (middles**2).sum(axis=1)[None, :] - 2 * x @ middles.T
                        cell[at] = gap.argmin(axis=1)
                        x = x - middles[cell[at]]
                    far[at] = np.sqrt((x**2).sum(axis=1))
            yield f.assign(**{name: cell.astype(np.int32), f"{name}_far": far})

    return run


def _seeder(sample: pd.DataFrame, k: int, same: bool):
    """Raises low bounds to the k-th best score in the sample (k + 1 where an anchor may be in it)."""
    by_len = {n: (_matrix(own["vec"]), own["label"].to_numpy()) for n, own in sample.groupby(sample["vec"].map(len))} if len(sample) else {}
    k = k + 1 if same else k

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            low = _matrix(f["low"]) if len(f) else np.zeros((0, 1), dtype=np.int64)
            high = _matrix(f["high"]) if len(f) else low
            lens = f["vec"].map(len).to_numpy()
            for n in np.unique(lens):
                if n not in by_len or len(by_len[n][0]) < k:
                    continue
                x, labels = by_len[n]
                at = np.flatnonzero(lens == n)
                for part in np.array_split(at, -(-len(at) // 64)):
                    s = products(_matrix(f["vec"].iloc[part]), x)
                    fits = (f["label"].to_numpy()[part, None] == labels[None, :]) == same
                    for question in range(low.shape[1]):
                        held = np.where(fits & (s <= high[part, question, None]) & (s >= low[part, question, None]), s, -_MOST)
                        low[part, question] = np.maximum(low[part, question], np.partition(held, -k, axis=1)[:, -k])
            yield f.assign(low=list(low))

    return run


def _reach(cells: pd.DataFrame, same: bool):
    """The cells that an anchor group can't pass over."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        dim = key[0]
        own = cells[cells["dim"] == dim]
        x, low, high = _matrix(frame["vec"], np.float64), _matrix(frame["low"]), _matrix(frame["high"])
        middle, radius = _balls(x, np.array([0, len(x)]))
        b = np.stack(own["middle"].to_numpy()) if len(own) else np.zeros((0, dim))
        lo, hi = interval(middle, radius, b, own["far"].to_numpy())
        fair = low <= high
        ok = (hi >= np.where(fair, low, _MOST).min()) & (lo <= np.where(fair, high, -_MOST).max())
        al, ah, cl, ch = frame["label"].min(), frame["label"].max(), own["least"], own["most"]
        ok &= ((cl <= ah) & (ch >= al) if same else ~((al == ah) & (cl == al) & (ch == al))).to_numpy()
        cell = own["cell"].to_numpy()[ok]
        return pd.DataFrame({"dim": dim, "zone": key[1], "part": key[2], "cell": cell})

    return run


def _unit(k: int, same: bool):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["rid", "question", "score", "id"]
        if left.empty or right.empty:
            return pd.DataFrame({n: np.zeros(0, dtype=np.int64) for n in names})
        anchors = {n: left[n].to_numpy(dtype=np.int64) for n in ("rid", "label")} | {n: _matrix(left[n]) for n in ("vec", "low", "high")}
        rows = {n: right[n].to_numpy(dtype=np.int64) for n in ("rid", "label", "id")} | {"vec": _matrix(right["vec"])}
        at, question, score, ids = dual_search(anchors, rows, k, same)
        return pd.DataFrame({"rid": anchors["rid"][at], "question": question, "score": score, "id": ids})

    return run


_ASKED = "rid long, label long, dim int, zone int, part int, vec array<long>, low array<long>, high array<long>"


def _sweep(scratch: Scratch, rows: DataFrame, asked: DataFrame, cells: pd.DataFrame, blocks: DataFrame, sample: pd.DataFrame, k: int, same: bool) -> DataFrame:
    """(rid, question, place, score, id): the best k rows of each question of each anchor."""
    asked = scratch.write(asked.mapInPandas(_seeder(sample, k, same), _ASKED))
    group = ["dim", "zone", "part"]
    met = asked.groupBy(*group).applyInPandas(_reach(cells, same), "dim int, zone int, part int, cell int")
    units = scratch.write(met.join(blocks, ["dim", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks"))
    unit = [*group, "cell", "block"]
    left = asked.join(units, group).select(*unit, "rid", "label", "vec", "low", "high")
    right = rows.join(units, ["dim", "cell", "block"]).select(*unit, "rid", "label", "vec", "id")
    found = left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInPandas(_unit(k, same), "rid long, question int, score long, id long")
    place = F.row_number().over(Window.partitionBy("rid", "question").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def _middles(x: np.ndarray, cells: int) -> np.ndarray:
    return Tree(x, max(1, -(-len(x) // cells))).leaves()


def mine(df: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of df where
    ``anchor`` holds: to each of an anchor's best ``positives`` rows of its label the best ``negatives`` rows
    of other labels with scores of low to high percent of the positive's."""
    if not 0 <= low <= high:
        raise ValueError("shares must be nonnegative and in order")
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    scaled = F.transform(F.col(vec_col), lambda v: v.cast("double") * scale)
    room = F.sqrt(F.lit(2.0**62 / 100) / F.size("scaled"))
    given = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), scaled.alias("scaled"))
    sound = F.forall("scaled", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < room), F.lit(False)))
    given = given.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("scaled") > 0) & sound)
    given = given.select("id", "label", "anchor", F.transform("scaled", lambda v: F.floor(v)).alias("vec"))
    longest = given.agg(F.max(F.size("vec"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    sample = draw(given, "id", max(64, SAMPLED // longest)).select("label", "vec").toArrow().to_pandas()
    usual = sample["vec"].map(len).mode().iloc[0]
    x = _matrix(sample["vec"][sample["vec"].map(len) == usual], np.float64)

    total = given.agg(F.count("*").alias("n"), F.count_if("anchor").alias("a")).first()
    of_rows, of_anchors = (_middles(x, max(1, min(CELLS, n // size))) for n, size in ((total["n"], CELL), (total["a"], ANCHORS // 2)))
    numbered = given.select(F.monotonically_increasing_id().alias("rid"), "id", "label", "anchor", F.size("vec").alias("dim"), "vec")
    kinds = "rid long, id long, label long, anchor boolean, dim int, vec array<long>"
    routed = scratch.write(numbered.mapInPandas(_router(of_rows, "cell"), f"{kinds}, cell int, cell_far double"))
    balls = routed.groupBy("dim", "cell").agg(F.max("cell_far").alias("far"), F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n"))
    balls = scratch.write(balls)
    cells = balls.toArrow().to_pandas()
    cells["middle"] = [of_rows[c] if c >= 0 else np.zeros(d) for d, c in zip(cells["dim"], cells["cell"], strict=True)]
    blocks = balls.select("dim", "cell", F.ceil(F.col("n") * F.col("dim") / F.lit(float(VALUES))).cast("int").alias("blocks"))
    dealt = lambda n: F.pmod(F.xxhash64("rid"), n).cast("int")
    rows = routed.join(F.broadcast(blocks) if len(cells) <= 2 * CELLS else blocks, ["dim", "cell"]).withColumn("block", dealt(F.col("blocks")))
    zoned = scratch.write(routed.where("anchor").drop("cell", "cell_far").mapInPandas(_router(of_anchors, "zone"), f"{kinds}, zone int, zone_far double"))
    parts = zoned.groupBy("dim", "zone").agg(F.ceil(F.count("*") / F.lit(float(ANCHORS))).cast("int").alias("parts"))
    anchors = zoned.join(parts, ["dim", "zone"]).withColumn("part", dealt(F.col("parts")))

    every = lambda v: F.array(F.lit(v).cast("long"))
    columns = [c.split(" ")[0] for c in _ASKED.split(", ")]
    first = anchors.withColumns({"low": every(-_MOST), "high": every(_MOST)}).select(*columns)
    best = scratch.write(_sweep(scratch, rows, first, cells, blocks, sample, positives, True).where("score >= 0").select("rid", "place", "score", "id"))
    # The questions of an anchor are numbered by its positives; what it has fewer of asks for nothing.
    own = best.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("s"))
    at = [F.try_element_at("s", F.lit(p + 1)) for p in range(positives)]
    lows = F.array(*(F.coalesce(F.floor((low * s + 99).cast("decimal(38,0)") / 100).cast("long"), F.lit(_MOST)) for s in at))
    highs = F.array(*(F.coalesce(F.floor((high * s).cast("decimal(38,0)") / 100).cast("long"), F.lit(-_MOST)) for s in at))
    second = anchors.join(own, "rid").withColumns({"low": lows, "high": highs}).select(*columns)
    worst = _sweep(scratch, rows, second, cells, blocks, sample, negatives, False)
    worst = worst.select("rid", (F.col("question") + 1).alias("place"), F.col("place").alias("rank"), F.col("score").alias("negative_score"), F.col("id").alias("negative_id"))
    named = best.select("rid", "place", F.col("score").alias("positive_score"), F.col("id").alias("positive_id"))
    names = anchors.select("rid", F.col("id").alias("anchor_id"))
    return worst.join(named, ["rid", "place"]).join(names, "rid").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS e
FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.rid AS arid, a.vec_id AS anchor_id, c.rid, c.vec_id, a.label = c.label AS same, list_dot_product(a.e, c.e)::BIGINT AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.rid <> c.rid),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.arid, p.rid, p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.arid, p.rid ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
FROM p JOIN s ON s.arid = p.arid AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
