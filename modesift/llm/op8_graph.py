"""Embedding near-duplicates by a robust-pruned flat graph.

Equal vectors form classes, of which one takes part. Classes are dealt to overlapping cluster shards:
each to its nearest cell (its home) and to the ``overlap`` - 1 next ones. A cell is a centre, or all
centres that reach each other by steps in range: a large group of near copies draws many centres, and
its links must not be cut by them. In such a merged cell nearly all are in range of all, so its links
are found by plain products. Cells grow in number with the data: one that is home to more than
``group`` / ``overlap`` classes gets centres of its own, fitted in a task on some of them, and its members
are dealt on to the nearest of all finer cells, level by level. In each other shard a flat graph is built by insertion in growing batches:
a beam search over the graph so far, from the nearest of twice as many medoids as the root of the shard's
size, gives a node's candidates, and robust pruning keeps the nearest, drops those that are nearer to it
than to the node, keeps the nearest of the rest, and so on, up to ``degree``; edges are made in both
directions and pruned alike. The adjacency lists of all shards are united by node. The search then runs
in each shard for the nodes at home there, on the united graph: a beam search from the medoids, and from
all that it met in range an expansion over neighbours, by edges of either direction, for as long as they
are in range. What is found is verified by its cosine in double precision. Links between
nodes of one home are counted for both ends, those across homes are listed as pairs (of few nodes at
the edges of cells) and counted once for both, so the two ends of a link agree; only a spanning forest
leaves a shard. Recall is audited against brute force for ``audit`` vectors (a stated query set against
all rows), over all their links and as the mean of their own recalls, so that a large group does not hide
lost links of small ones. While either is below ``RECALL`` the whole is repeated with twice the overlap
and beam, up to all cells, where nothing is missed for lack of a shard; if it is still below, that is an error.

Vectors of different lengths have no cosine: each length of ``shard`` classes or more has centres of its
own, vectors of rarer lengths meet in one merged cell a length.

Bounds: the centres are fitted on about 32 vectors a centre, at most ``fan`` (2048) centres in one fit (a
sample of about 65,536 vectors) a length, and of each cell that is divided; every vector is indexed. What
``LEVELS`` divisions leave above ``group`` members, and merged cells, are dealt in blocks so that every
two blocks meet in one task.

Defined results: vectors that are null, zero, hold null or non-finite components or have no id link with
nothing; repeated vectors are links to each other; components are scaled by a power of two before they
are multiplied, so very large and very small vectors are compared like others; rows that repeat an id
and vector each count; an empty table gives no rows; extra columns are ignored; recall is null where the
audited vectors have no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, components, draw
from .op7_jaccard import _dealt

SHARD, CENTRES, GROUP, LEVELS = 2048, 2048, 16_384, 4
DEGREE, BEAM = 16, 24
COSINE, RECALL = 0.9, 0.9


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest components near 1: cosines stay, nothing overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1)[:, None]


def fit_centres(x: np.ndarray, k: int, rounds: int = 6, seed: int = 8) -> np.ndarray:
    """Spherical k-means; an empty centre takes the vector farthest from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        s = x @ c.T
        mine = s.argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, mine, x)
        empty = np.flatnonzero(np.bincount(mine, minlength=k) == 0)
        sums[empty] = x[np.argsort(s.max(axis=1))[: len(empty)]]
        norm = np.linalg.norm(sums, axis=1)
        c = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-30)[:, None], c)
    return c


def merged_cells(c: np.ndarray, cosine: float) -> np.ndarray:
    """The cell of each centre, from 0 on: centres that reach each other by steps in range share one."""
    near = c @ c.T >= cosine
    np.fill_diagonal(near, True)
    cell = np.arange(len(c))
    while True:
        new = np.where(near, cell[None, :], len(c)).min(axis=1)
        if (new == cell).all():
            return np.unique(cell, return_inverse=True)[1]
        cell = new


def robust_prune(x: np.ndarray, at: np.ndarray, near: np.ndarray, degree: int) -> np.ndarray:
    """Of each node's candidates (rows of ``near``, -1 for none) up to degree neighbours, nearest first."""
    out = np.full((len(at), degree), -1, dtype=np.int64)
    for k in range(0, len(at), 256):
        node, cand = at[k : k + 256], np.sort(near[k : k + 256], axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        cand[cand == node[:, None]] = -1
        v = x[cand]
        own = np.where(cand >= 0, np.matmul(v, x[node][:, :, None])[:, :, 0], -np.inf)
        among = np.matmul(v, v.transpose(0, 2, 1))
        left, rows = own.copy(), np.arange(len(node))
        for r in range(degree):
            best = left.argmax(axis=1)
            ok = left[rows, best] > -np.inf
            if not ok.any():
                break
            out[k : k + 256, r][ok] = cand[rows, best][ok]
            left[(among[rows, best] >= own) & ok[:, None]] = -np.inf  # nearer to the kept one than to the node
            left[rows, best] = -np.inf
    return out


def medoids(x: np.ndarray, seed: int = 8) -> np.ndarray:
    """Nodes nearest to the middles of 2 sqrt(n) cells around drawn nodes."""
    n = len(x)
    drawn = x[np.random.default_rng(seed).choice(n, min(n, max(1, int(2 * np.sqrt(n)))), replace=False)]
    cell = np.concatenate([(x[k : k + 4096] @ drawn.T).argmax(axis=1) for k in range(0, n, 4096)])
    middle = np.zeros_like(drawn)
    np.add.at(middle, cell, x)
    order = np.lexsort((-np.einsum("nd,nd->n", x, middle[cell]), cell))
    return np.sort(order[np.unique(cell[order], return_index=True)[1]])


def beam_search(x: np.ndarray, asked: np.ndarray, lists: np.ndarray, starts: np.ndarray, beam: int) -> np.ndarray:
    """The ``beam`` nearest nodes (-1 for none) that a greedy search from the nearest starts meets for each
    query, over padded neighbour lists."""
    out = np.full((len(asked), beam), -1, dtype=np.int64)
    width = min(beam, len(starts))
    for k in range(0, len(asked), 512):
        q = asked[k : k + 512]
        ids = np.full((len(q), beam), -1, dtype=np.int64)
        score = np.full((len(q), beam), -np.inf)
        done = np.zeros((len(q), beam), dtype=bool)
        s = q @ x[starts].T
        first = np.argpartition(-s, width - 1, axis=1)[:, :width]
        ids[:, :width], score[:, :width] = starts[first], np.take_along_axis(s, first, axis=1)
        active = np.arange(len(q))
        while len(active):
            open_ = np.where(done[active] | (ids[active] < 0), -np.inf, score[active])
            best = open_.argmax(axis=1)
            more = open_[np.arange(len(active)), best] > -np.inf
            active, best = active[more], best[more]
            if not len(active):
                break
            done[active, best] = True
            near = lists[ids[active, best]]
            known = (near[:, :, None] == ids[active][:, None, :]).any(axis=2) | (near < 0)
            s = np.where(known, -np.inf, np.matmul(x[near], q[active][:, :, None])[:, :, 0])
            all_ids, all_score = np.concatenate([ids[active], near], axis=1), np.concatenate([score[active], s], axis=1)
            all_done = np.concatenate([done[active], known], axis=1)
            top = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam]
            keep = np.take_along_axis(all_score, top, axis=1)
            ids[active] = np.where(keep > -np.inf, np.take_along_axis(all_ids, top, axis=1), -1)
            score[active], done[active] = keep, np.take_along_axis(all_done, top, axis=1)
        out[k : k + 512] = ids
    return out


def build_graph(x: np.ndarray, degree: int, beam: int, seed: int = 8) -> np.ndarray:
    """Padded neighbour lists of unit vectors, by insertion in batches that at most double the graph; the
    medoids, where searches start, come first and are linked among themselves."""
    n = len(x)
    lists = np.full((n, degree), -1, dtype=np.int64)
    starts = medoids(x)
    order = np.random.default_rng(seed).permutation(n)
    order = order[~np.isin(order, starts)]

    def insert(batch: np.ndarray, found: np.ndarray) -> None:
        lists[batch] = robust_prune(x, batch, np.concatenate([found, lists[batch]], axis=1), degree)
        # The other direction, at most degree new edges of a node at a time.
        src, dst = np.repeat(batch, degree), lists[batch].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        place = np.arange(len(dst)) - np.searchsorted(dst, dst)
        for r in range(0, int(place.max(initial=-1)) + 1, degree):
            use = (place >= r) & (place < r + degree)
            nodes, row = np.unique(dst[use], return_inverse=True)
            new = np.full((len(nodes), degree), -1, dtype=np.int64)
            new[row, place[use] - r] = src[use]
            lists[nodes] = robust_prune(x, nodes, np.concatenate([lists[nodes], new], axis=1), degree)

    s = x[starts] @ x[starts].T
    insert(starts, starts[np.argsort(-s, axis=1)[:, : beam + 1]])
    at = 0
    while at < len(order):
        batch = order[at : at + min(at + len(starts), max(32, n // 8))]
        insert(batch, beam_search(x, x[batch], lists, starts, beam))
        at += len(batch)
    return lists


class Walk:
    """The lists' edges in both directions, to walk over nodes in range."""

    def __init__(self, lists: np.ndarray):
        n = len(lists)
        a, b = np.repeat(np.arange(n), lists.shape[1]), lists.ravel()
        a, b = a[b >= 0], b[b >= 0]
        code = np.unique(np.concatenate([a * n + b, b * n + a]))
        self.to = code % max(n, 1)
        self.off = np.searchsorted(code // max(n, 1), np.arange(n + 1))

    def neighbours(self, front: np.ndarray) -> np.ndarray:
        lens = self.off[front + 1] - self.off[front]
        return np.unique(self.to[np.repeat(self.off[front] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())])

    def expand(self, x: np.ndarray, v: int, entries: np.ndarray, least: float) -> np.ndarray:
        """Nodes in range of node v that a walk over nodes in range reaches from the entries."""
        seen = np.zeros(len(x), dtype=bool)
        front = entries[x[entries] @ x[v] >= least]
        seen[front] = True
        while len(front):
            near = self.neighbours(front)
            near = near[~seen[near]]
            front = near[x[near] @ x[v] >= least]
            seen[front] = True
        seen[v] = False
        return np.flatnonzero(seen)


def _vectors(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["vec"].to_numpy()).astype(np.float64)


def _builder(degree: int, beam: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("sid")
        nodes = frame["sid"].to_numpy()
        lists = build_graph(unit(_vectors(frame)), degree, beam)
        return pd.DataFrame({"sid": nodes, "near": [nodes[row[row >= 0]] for row in lists]})

    return run


_FOUND = "a long, b long, links long, cross boolean"


class Links:
    """What a shard finds: links between home nodes as bits, pairs of a home node and another, and a forest of both."""

    def __init__(self, home: np.ndarray):
        self.home = np.flatnonzero(home)
        self.place = np.full(len(home), -1)
        self.place[self.home] = np.arange(len(self.home))
        self.width = -(-len(self.home) // 8)
        self.bits = np.zeros((8 * self.width, self.width), dtype=np.uint8)
        self.pairs: list[np.ndarray] = []
        self.parent = np.arange(len(home))

    def find(self, v: int) -> int:
        while self.parent[v] != v:
            self.parent[v] = self.parent[self.parent[v]]
            v = self.parent[v]
        return v

    def add(self, v: int, found: np.ndarray) -> None:
        at = self.place[found]
        row = np.zeros(8 * self.width, dtype=bool)
        row[at[at >= 0]] = True
        self.bits[self.place[v]] |= np.packbits(row)
        if (at < 0).any():
            self.pairs.append(np.column_stack([np.full((at < 0).sum(), v), found[at < 0]]))
        p = self.find(v)
        others = self.parent[found]
        for w in np.unique(others[others != p]).tolist():
            q = self.find(w)
            if p != q:
                self.parent[max(p, q)] = min(p, q)
                p = min(p, q)

    def counts(self, mult: np.ndarray) -> np.ndarray:
        """Links of each home node to home nodes, a link found from either end counting for both."""
        out, weight = np.zeros(len(self.home), dtype=np.int64), np.zeros(8 * self.width, dtype=np.int64)
        weight[: len(self.home)] = mult[self.home]
        for k in range(0, len(self.home), 512):
            there = np.unpackbits(self.bits[k : k + 512], axis=1).astype(bool)
            back = np.unpackbits(self.bits[:, k // 8 : (k + 512) // 8], axis=1).astype(bool).T
            both = (there[: len(back)] | back[: len(there)]) @ weight
            out[k : k + 512] = both[: len(out[k : k + 512])]
        return out

    def frame(self, nodes: np.ndarray, mult: np.ndarray) -> pd.DataFrame:
        roots = np.array([self.find(v) for v in range(len(nodes))], dtype=np.int64)
        links = np.zeros(len(nodes), dtype=np.int64)
        links[self.home] = self.counts(mult)
        keep = (self.place >= 0) | (roots != np.arange(len(nodes)))
        pairs = np.concatenate(self.pairs) if self.pairs else np.zeros((0, 2), dtype=np.int64)
        own = pd.DataFrame({"a": nodes[keep], "b": nodes[roots[keep]], "links": links[keep], "cross": False})
        return pd.concat([own, pd.DataFrame({"a": nodes[pairs[:, 0]], "b": nodes[pairs[:, 1]], "links": 0, "cross": True})])


def in_merged(raw: np.ndarray, home: np.ndarray, mine: np.ndarray, cross: bool, cosine: float) -> Links:
    """Links of each home node by products of all with all; cross: only those between the two blocks."""
    raw = scaled(raw)
    norm = np.linalg.norm(raw, axis=1)
    x = raw / norm[:, None]
    links = Links(home)
    for block in np.unique(mine):
        others = np.flatnonzero(mine != block) if cross else np.arange(len(raw))
        asked = np.flatnonzero(home & (mine == block))
        for k in range(0, len(asked), 512):
            part = asked[k : k + 512]
            s = x[part] @ x[others].T
            near = s >= cosine
            for q, o in np.argwhere(np.abs(s - cosine) <= 1e-9).tolist():
                v, w = part[q], others[o]
                near[q, o] = (raw[w] @ raw[v]) / (norm[w] * norm[v]) >= cosine
            near[part[:, None] == others[None, :]] = False
            for q in np.flatnonzero(near.any(axis=1)).tolist():
                links.add(int(part[q]), others[near[q]])
    return links


def _merged_searcher(cosine: float):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("sid").reset_index(drop=True)
        links = in_merged(_vectors(frame), frame["home"].to_numpy(dtype=bool), frame["mine"].to_numpy(), key[1] != key[2], cosine)
        return links.frame(frame["sid"].to_numpy(), frame["mult"].to_numpy())

    return run


def _padded(near: pd.Series, nodes: np.ndarray) -> np.ndarray:
    """The united lists as padded places in the shard; neighbours that are not in it go."""
    lens = near.map(lambda v: 0 if v is None else len(v)).to_numpy()
    flat = np.concatenate([np.asarray(v, dtype=np.int64) for v in near if v is not None]) if lens.any() else np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(nodes, flat), len(nodes) - 1)
    out = np.full((len(nodes), max(1, int(lens.max(initial=0)))), -1, dtype=np.int64)
    out[np.repeat(np.arange(len(nodes)), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = np.where(nodes[at] == flat, at, -1)
    return out


def _searcher(cosine: float, beam: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("sid").reset_index(drop=True)
        _, i, j = key
        raw = scaled(_vectors(frame))
        norm = np.linalg.norm(raw, axis=1)
        x = raw / norm[:, None]
        nodes, mine = frame["sid"].to_numpy(), frame["mine"].to_numpy()
        lists = _padded(frame["near"], nodes)
        links = Links(frame["home"].to_numpy(dtype=bool))
        met = beam_search(x, x[links.home], lists, medoids(x), beam)
        walk = Walk(lists)
        near = np.matmul(x[met], x[links.home][:, :, None])[:, :, 0] >= cosine - 1e-9
        near &= (met >= 0) & (met != links.home[:, None])
        for k in np.flatnonzero(near.any(axis=1)).tolist():
            v = int(links.home[k])
            found = walk.expand(x, v, met[k][near[k]], cosine - 1e-9)
            found = found[(raw[found] @ raw[v]) / (norm[found] * norm[v]) >= cosine]
            if i != j:  # two blocks: only links across them are counted here
                found = found[mine[found] != mine[v]]
            if len(found):
                links.add(v, found)
        return links.frame(nodes, frame["mult"].to_numpy())

    return run


_MEMBERS = "shard long, merged boolean, home boolean, score double, sid long, mult long, vec array<double>"


def _nearest(own: pd.DataFrame, c: np.ndarray, first: np.ndarray, merged: np.ndarray, shards: np.ndarray, spread: int) -> Iterator[pd.DataFrame]:
    """The rows once for each of their ``spread`` nearest cells, the nearest as their home if they live here."""
    for at in range(0, len(own), 2048):
        g = own.iloc[at : at + 2048]
        s = np.maximum.reduceat(unit(_vectors(g)) @ c.T, first, axis=1)
        top = np.argsort(-s, axis=1, kind="stable")[:, :spread]
        lives = g["home"].to_numpy(dtype=bool) if "home" in g else np.ones(len(g), dtype=bool)
        for r in range(top.shape[1]):
            cell = top[:, r]
            yield pd.DataFrame({"shard": shards[cell], "merged": merged[cell], "home": lives & (r == 0), "score": s[np.arange(len(g)), cell], "sid": g["sid"].to_numpy(), "mult": g["mult"].to_numpy(), "vec": g["vec"].to_numpy()})


def _members(classes: DataFrame, centres, spread: int) -> DataFrame:
    """Each class in its ``spread`` nearest cells of the first level."""

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for d, own in f.groupby(f["vec"].map(len), sort=False):
                if d in centres.value:
                    c, first, merged, base = centres.value[d]
                    yield from _nearest(own, c, first, merged, base + np.arange(len(first)), spread)
                else:
                    yield pd.DataFrame({"shard": -d, "merged": True, "home": True, "score": 1.0, "sid": own["sid"].to_numpy(), "mult": own["mult"].to_numpy(), "vec": own["vec"].to_numpy()})

    return classes.select("sid", "mult", "vec").mapInPandas(assign, _MEMBERS)


def _finer(members: DataFrame, level: int, spread: int, cosine: float, shard: int, fan: int, group: int) -> DataFrame | None:
    """Members with cells of more homes than ``group`` / ``spread`` divided by centres fitted on their own members; None if there are none.

    A finer cell's number is a hash of its parent's and its own: two that agreed would share a shard, which
    loses nothing.
    """
    large = members.where("not merged").groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("long")).alias("homes")).where(F.col("homes") * spread > group)
    large = large.select("shard", F.least(F.lit(fan), F.greatest(F.lit(2), F.ceil(F.col("homes") / shard))).cast("int").alias("k"), F.ceil(F.col("n") / float(group)).cast("int").alias("blocks"), "homes")
    if large.isEmpty():
        return None

    def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("sid")
        x = unit(_vectors(frame))
        fitted = fit_centres(x, min(int(frame["k"].iloc[0]), len(x)))
        cell = merged_cells(fitted, cosine)
        merged = np.bincount(cell) > 1
        return pd.DataFrame({"shard": key[0], "cell": cell.astype(np.int64), "merged": merged[cell], "centre": list(fitted)})

    def deal(key: tuple, own: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        fitted = fitted.sort_values("cell", kind="stable").reset_index(drop=True)
        first = np.flatnonzero(~fitted["cell"].duplicated().to_numpy())
        parts = list(_nearest(own, np.stack(fitted["centre"].to_numpy()), first, fitted["merged"].to_numpy()[first], fitted["child"].to_numpy()[first], spread))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["shard", "merged", "home", "score", "sid", "mult", "vec"])

    share = F.least(F.lit(1.0), F.lit(32.0) * F.col("k") / F.col("homes"))
    part = members.join(large, "shard")
    # At least one vector a centre: the share is of many times as many.
    sample = part.where("home").where(F.pmod(F.xxhash64(F.lit(100 + level), "sid"), F.lit(1 << 30)) < share * (1 << 30)).select("shard", "k", "sid", "vec")
    fitted = sample.groupBy("shard").applyInPandas(fit, "shard long, cell long, merged boolean, centre array<double>")
    fitted = fitted.join(large.select("shard", "blocks"), "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    fitted = fitted.select("shard", "block", "cell", "merged", "centre", F.xxhash64(F.lit(level), "shard", "cell").alias("child"))
    part = part.withColumn("block", F.pmod(F.xxhash64(F.lit(200 + level), "sid"), F.col("blocks")).cast("int")).select("shard", "block", "home", "sid", "mult", "vec")
    dealt = part.groupBy("shard", "block").cogroup(fitted.groupBy("shard", "block")).applyInPandas(deal, _MEMBERS)
    both = members.join(large.select("shard"), "shard", "left_anti").unionByName(dealt)
    # A class has at most spread * spread rows here. Who lives in a merged cell stays: its group is not cut.
    stays = F.col("home") & F.col("merged")
    ranked = both.withColumn("home", F.row_number().over(Window.partitionBy("sid").orderBy(stays.desc(), F.desc("score"), "shard")))
    return ranked.where(F.col("home") <= spread).withColumn("home", F.col("home") == 1)


def _linked(scratch: Scratch, classes: DataFrame, centres, spread: int, cosine: float, degree: int, beam: int, shard: int, fan: int, group: int) -> tuple[DataFrame, int]:
    """(vec, sid, mult, links, comp) of each class, searched for in shards of its ``spread`` nearest cells, and
    the number of cells."""
    members = scratch.write(_members(classes, centres, spread))
    for level in range(LEVELS):
        finer = _finer(members, level, spread, cosine, shard, fan, group)
        if finer is None:
            break
        finer = scratch.write(finer)
        scratch.drop(members)
        members = finer
    cells = members.select("shard").distinct().count()
    sizes = members.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(float(group))).cast("int").alias("blocks"))
    keyed = members.select("shard", "sid").join(sizes, "shard")
    mine = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int").alias("mine")
    marks = keyed.select("shard", "sid", mine)
    dealt = _dealt(keyed, "shard").join(members, ["shard", "sid"]).join(marks, ["shard", "sid"])
    plain = dealt.where("not merged")
    graph = plain.groupBy("shard", "i", "j").applyInPandas(_builder(degree, beam), "sid long, near array<long>")
    union = scratch.write(graph.groupBy("sid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
    walked = plain.join(union, "sid", "left").groupBy("shard", "i", "j").applyInPandas(_searcher(cosine, beam), _FOUND)
    multiplied = dealt.where("merged").groupBy("shard", "i", "j").applyInPandas(_merged_searcher(cosine), _FOUND)
    found = scratch.write(walked.unionByName(multiplied))
    comps = components(classes.sparkSession, found.select("a", "b"), scratch)
    pairs = found.where("cross").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = pairs.select(F.col("a").alias("sid"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("sid"), F.col("a").alias("other")))
    across = pairs.join(classes.select(F.col("sid").alias("other"), F.col("mult").alias("links")), "other").select("sid", "links")
    counts = found.where("not cross").select(F.col("a").alias("sid"), "links").unionByName(across).groupBy("sid").agg(F.sum("links").alias("links"))
    of_class = classes.join(counts, "sid", "left").join(comps, F.col("sid") == F.col("node"), "left").select("vec", "sid", "mult", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"), F.coalesce("comp", "sid").alias("comp"))
    of_class = scratch.write(of_class)
    scratch.drop(members, union, found)
    return of_class, cells


def _fit(classes: DataFrame, lengths: dict[int, int], shard: int, fan: int, cosine: float) -> dict[int, tuple]:
    """For each length of ``shard`` classes or more: centres by cell, each cell's first, whether it is merged, and its first shard's number."""
    out, base = {}, 0
    for d, n in sorted(lengths.items()):
        if n < shard and len(lengths) > 1:
            continue
        k = max(1, min(fan, n // shard))
        sample = draw(classes.where(F.size("vec") == d), "sid", 32 * k).select("vec").toArrow().to_pandas()
        fitted = fit_centres(unit(_vectors(sample)), k)
        cell = merged_cells(fitted, cosine)
        order = np.argsort(cell, kind="stable")
        cells = int(cell.max()) + 1
        out[d] = (fitted[order], np.searchsorted(cell[order], np.arange(cells)), np.bincount(cell) > 1, base)
        base += cells
    return out


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, overlap: int = 3, degree: int = DEGREE, beam: int = BEAM, shard: int = SHARD, audit: int = 200, fan: int = CENTRES, group: int = GROUP) -> DataFrame:
    """One row a vector: id, n_links, component_id, kept, and the audited recall of links and mean recall of vectors."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    rows = df.select(F.col(id_col).alias("vec_id"), F.transform(F.col(vec_col), lambda v: v.cast("double")).alias("vec"))
    good = F.col("vec_id").isNotNull() & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    usable = F.col("vec").isNotNull() & F.coalesce(good, F.lit(False))
    nothing = (F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    classes = scratch.write(rows.where(usable).groupBy("vec").agg(F.min("vec_id").alias("sid"), F.count("*").alias("mult")))
    lengths = {r["d"]: r["count"] for r in classes.groupBy(F.size("vec").alias("d")).count().collect()}
    if not lengths:
        return rows.select(F.col("vec_id").alias(id_col), *nothing, *(F.lit(None).cast("double").alias(c) for c in ("recall", "vector_recall")))
    centres = spark.sparkContext.broadcast(_fit(classes, lengths, shard, fan, cosine))
    while True:
        of_class, cells = _linked(scratch, classes, centres, overlap, cosine, degree, beam, shard, fan, group)
        recalls = audit_recall(of_class, classes, audit, cosine)
        if recalls is None or min(recalls) >= RECALL:
            break
        scratch.drop(of_class)
        if overlap >= cells and beam >= 8 * BEAM:
            raise RuntimeError(f"recall of links {recalls[0]:.3f}, of vectors {recalls[1]:.3f}, below {RECALL} with all {cells} cells and a beam of {beam}")
        overlap, beam = 2 * overlap, 2 * beam
    # Joined by the vector itself; a hot vector's rows are split, its class is one row.
    audited = [F.lit(r).cast("double").alias(c) for r, c in zip(recalls or (None, None), ("recall", "vector_recall"), strict=True)]
    linked = rows.where(usable).join(of_class, "vec").select("vec_id", "links", "comp")
    out = linked.select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("comp").alias("component_id"), (F.col("vec_id") == F.col("comp")).alias("kept"), *audited)
    return out.unionByName(rows.where(~usable).select("vec_id", *nothing, *audited)).withColumnRenamed("vec_id", id_col)


def audit_recall(of_class: DataFrame, classes: DataFrame, audit: int, cosine: float) -> tuple[float, float] | None:
    """For ``audit`` classes against all: links counted over links there are, and the mean of that over the
    vectors that have links; None without links."""
    drawn = draw(of_class, "sid", audit, seed=1).toArrow().to_pandas()
    if drawn.empty:
        return None
    asked = {d: (own.index.to_numpy(), unit(_vectors(own))) for d, own in drawn.groupby(drawn["vec"].map(len))}
    queries = classes.sparkSession.sparkContext.broadcast(asked)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(sum(len(at) for at, _ in queries.value.values()))
        for f in frames:
            for d, own in f.groupby(f["vec"].map(len), sort=False):
                if d in queries.value:
                    at, q = queries.value[d]
                    total[at] += (own["mult"].to_numpy()[:, None] * (unit(_vectors(own)) @ q.T >= cosine)).sum(axis=0)
        yield pd.DataFrame({"q": np.arange(len(total)), "links": total})

    truth = classes.select("vec", "mult").mapInPandas(count, "q long, links double").groupBy("q").agg(F.sum("links").alias("links")).orderBy("q").toArrow().to_pandas()["links"].to_numpy() - 1
    has = truth > 0
    got = np.minimum(drawn["links"].to_numpy(), truth)[has]
    return (float(got.sum() / truth[has].sum()), float((got / truth[has]).mean())) if has.any() else None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


#: All pairs by brute force: right where the table is small, where the graph misses none and its audit says 1.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS l FROM v),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.l * b.l) >= 0.9e0),
r AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, p.b FROM r JOIN p ON p.a = r.other)
SELECT v.vec_id, (SELECT count(*) FROM p WHERE p.a = v.vec_id)::BIGINT AS n_links, min(r.other)::BIGINT AS component_id, v.vec_id = min(r.other) AS kept, (SELECT CASE WHEN count(*) > 0 THEN 1.0e0 END FROM p) AS recall, (SELECT CASE WHEN count(*) > 0 THEN 1.0e0 END FROM p) AS vector_recall FROM v JOIN r ON r.vec_id = v.vec_id GROUP BY v.vec_id
"""
