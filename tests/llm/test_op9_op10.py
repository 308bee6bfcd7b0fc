import gzip
import hashlib
import random
from collections import defaultdict

import duckdb
import pytest

from modesift.llm import op9_mix, op10_warc


def targets(sizes, weights=(5, 2, 1), budget=1.5, cap=2.0):
    """Redistributes until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, rest = {}, set(sizes), budget * sum(sizes.values())
    while True:
        total = sum(w[s] for s in free)
        over = [s for s in free if rest * w[s] / total > cap * sizes[s] + 1e-9]
        if not over:
            return out | {s: rest * w[s] / total for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            rest -= out[s]
            free.discard(s)
        if not free:
            return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(1200):
        s = rng.choice(["hot", "hot", "hot", "b", "é", "ab", "z", None])
        rows.append((i, " ".join(["w"] * rng.choice([1, 5, 40, 200])) if rng.random() < 0.97 else None, s))
    rows += [(5000, "same words", "b")] * 7 + [(None, "no id", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'c' as weight", "3 as bits", "'mine' as size", "60.0 as target", "1 as copies", "0 as draw")
    out = op9_mix.mix(df, bucket_docs=32).collect()
    assert len(out) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in out:
        assert r.mix__size == len((r.text or "").split()) and 0 <= r.mix__copies <= 2
        assert (r.size, r.target, r.copies, r.draw) == ("mine", 60, 1, 0)
        sizes[r.source] += r.mix__size
        taken[r.source] += r.mix__size * r.mix__copies
    want = targets(sizes)
    for r in out:
        assert r.mix__source_size == sizes[r.source] and r.mix__target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(200, 0.01 * want[s])
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.mix__copies)
    again = op9_mix.mix(df.repartition(5), bucket_docs=32).collect()
    assert [key(r) for r in sorted(again, key=key)] == [key(r) for r in sorted(out, key=key)]


def test_bounds_go_down_all_digits(spark):
    """Draws that agree in their first digits: the search ends at the last one, and what it takes is what a walk in unsigned order takes."""
    rng = random.Random(8)
    highs = [0, 5 << 48, (0xFFFF << 48) - 2**64, (0xFFFF << 48 | 7 << 32) - 2**64]
    draws = [rng.choice(highs) | rng.choice([0, 9 << 16, rng.randrange(2**32)]) for _ in range(4000)]
    rows = [("s", d, 1 + d % 9) for d in draws]  # equal draws have equal sizes
    light = spark.createDataFrame(rows, "source string, draw long, size long")
    for need in (0.5, 900.0, 9000.0, 15_000.0):
        plan = spark.createDataFrame([("s", need, len(rows))], "source string, need double, docs long")
        b = op9_mix.sample_bounds(light, plan, 1).first()
        cut = lambda d: (d % 2**64) >> (64 - b.bits)  # noqa: E731,B023
        sure = [r for r in rows if cut(r[1]) < b.edge % 2**64]
        edge = [r for r in rows if cut(r[1]) == b.edge % 2**64]
        words = sum(r[2] for r in sure)
        assert b.bits == 64 or len(edge) <= 2
        assert words <= need < words + sum(r[2] for r in edge)
        assert words + sum(r[2] for r in edge if r[1] in {x.draw for x in b.taken}) <= need or any(x.n < x.rows for x in b.taken)
        held = {x.draw: x.n for x in b.taken}
        size = {r[1]: r[2] for r in edge}
        assert words + sum(size[d] * n for d, n in held.items()) <= need and all(x.n <= x.rows for x in b.taken)


@pytest.mark.parametrize("ids", ["one id and text", "no ids", "no ids, one text"])
def test_repeated_rows_come_near_their_target(spark, ids):
    rows = [(i, f"a{i} " + "w " * 9, "abc"[i % 3]) for i in range(900)]
    rows = [(r[0] if r[2] != "c" else 2 if ids == "one id and text" else None, "same " * 10 if r[2] == "c" and "one" in ids else r[1], r[2]) for r in rows]
    out = op9_mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    want = targets({s: 3000 for s in "abc"})
    for s in "abc":
        assert abs(sum(r.mix__size * r.mix__copies for r in out if r.source == s) - want[s]) <= 10, s
    assert len(out) == 900


def test_mix_edges(spark):
    schema = "doc_id long, text string, source string"
    assert op9_mix.mix(spark.createDataFrame([], schema)).count() == 0
    out = op9_mix.mix(spark.createDataFrame([(1, None, None), (2, "", "a")], schema)).collect()
    assert [(r.mix__size, r.mix__target, r.mix__copies * r.mix__size) for r in out] == [(0, 0.0, 0)] * 2
    one = op9_mix.mix(spark.createDataFrame([(1, "a b c d", "x")], schema)).first()
    assert one.mix__target == 6.0 and one.mix__copies in (1, 2)


LEAVES = "record_id long, file string, offset long, length long, leaf string"


def sha(x):
    return hashlib.sha256(str(x).encode()).hexdigest()


def files(n=600, names=("a", "b", "c"), seed=4):
    """Records (id, bytes' hash, length) of each file, in order."""
    rng = random.Random(seed)
    out = {name: [] for name in names}
    for i in range(n):
        out[names[i % len(names)]].append((i if i % 50 else None, sha(i), rng.randint(1, 400)))
    return out


def placed(content):
    rows = []
    for name, records in content.items():
        at = 0
        for i, leaf, length in records:
            rows.append((i, name, at, length, leaf))
            at += length
    return rows


def verdicts(spark, ours, theirs):
    """Counts of (record_id, leaf, verdict), with small ranges so that trees are deep."""
    df = [spark.createDataFrame(x, LEAVES).selectExpr("*", "'x' as node", "1 as side") for x in (ours, theirs)]
    out = op10_warc.audit(*df, base=512, fanout=3, levels=4).collect()
    return sorted(((r.record_id or -1, r.leaf, r.verdict) for r in out))


def expected(ours, **verdict):
    told = {leaf: v for v, leaves in verdict.items() for leaf in leaves}
    return sorted((i or -1, leaf, told.get(leaf, "ok")) for i, _, _, _, leaf in ours)


def test_merkle_tree_by_hand(spark):
    rows = placed(files())
    nodes = op10_warc.tree(spark.createDataFrame(rows, LEAVES).selectExpr("0 as side", "*"), op10_warc.Scratch(spark), base=512, fanout=3, levels=4)
    level = defaultdict(list)
    for _, name, at, length, leaf in sorted(rows, key=lambda r: (r[1], r[2])):
        level[name, at // 512].append(f"{at}:{length}:{leaf}")
    level = {k: sha(",".join(v)) for k, v in level.items()}
    for k, got in enumerate(nodes):
        assert {(r.file, r.node): r.hash for r in got.collect()} == level
        up = defaultdict(list)
        for (name, node), h in sorted(level.items()):
            up[name, node // 3 if k < 3 else 0].append(f"{node}:{h}")
        level = {key: sha(",".join(v)) for key, v in up.items()}


def test_only_differing_branches_are_compared(spark):
    content = files()
    ours = placed(content)
    content["b"][70] = (*content["b"][70][:1], sha("bad"), content["b"][70][2])
    both = spark.createDataFrame(ours, LEAVES).selectExpr("0 as side", "*").unionByName(spark.createDataFrame(placed(content), LEAVES).selectExpr("1 as side", "*"))
    bad = op10_warc.descend(op10_warc.tree(both, op10_warc.Scratch(spark), 512, 3, 4), 3).collect()
    assert [(r.file, r.node) for r in bad] == [("b", placed(content)[270][2] // 512)]


def test_damage_is_told_apart(spark):
    content = files()
    ours = placed(content)
    assert verdicts(spark, ours, ours) == expected(ours)
    # bytes changed in place
    hurt = {name: [(i, sha("bad") if k in (3, 90) else leaf, n) for k, (i, leaf, n) in enumerate(rows)] for name, rows in content.items()}
    assert verdicts(spark, ours, placed(hurt)) == expected(ours, corrupt=[rows[k][1] for rows in content.values() for k in (3, 90)])
    # shifted: every record of a file two bytes on
    shifted = [(i, name, at + 2 * (name == "b"), n, leaf) for i, name, at, n, leaf in ours]
    assert verdicts(spark, ours, shifted) == expected(ours, moved=[r[1] for r in content["b"]])
    # reordered: two neighbours of different lengths change places
    swapped = {**content, "c": [*content["c"][:8], content["c"][9], content["c"][8], *content["c"][10:]]}
    assert verdicts(spark, ours, placed(swapped)) == expected(ours, moved=[r[1] for r in content["c"][8:10]])
    # truncated, and a record that only the replica has
    cut = {**content, "a": content["a"][:150], "b": [*content["b"], (9999, sha("new"), 5)]}
    want = expected(ours, missing=[r[1] for r in content["a"][150:]])
    assert verdicts(spark, ours, placed(cut)) == sorted([*want, (9999, sha("new"), "extra")])
    # lengths, hence offsets, that differ though all bytes' hashes agree
    longer = {name: [(i, leaf, n + 1) for i, leaf, n in rows] for name, rows in content.items()}
    assert [v for _, _, v in verdicts(spark, ours, placed(longer))].count("ok") == 0
    # repeated ids, one copy lost
    twins = {"a": [(7, sha(k % 3), 10) for k in range(30)]}
    found = verdicts(spark, placed(twins), placed({"a": twins["a"][:-1]}))
    assert [v for _, _, v in found].count("missing") == 1 and len(found) == 30


def test_layout_spreads_hot_and_null_ids(spark):
    rows = [(None, 10 + i % 7, sha(i)) for i in range(900)] + [(5, 3, sha("same"))] * 900 + [(i, 4, sha(i)) for i in range(900)]
    out = op10_warc.layout(spark.createDataFrame(rows, "record_id long, length long, leaf string"), 27).collect()
    assert len(out) == len(rows)
    by_file = defaultdict(list)
    for r in out:
        by_file[r.file].append((r.ordinal, r.offset, r.length))
    assert max(map(len, by_file.values())) < 200
    for found in by_file.values():
        at = 0
        for k, (ordinal, offset, length) in enumerate(sorted(found)):
            assert (ordinal, offset) == (k, at)
            at += length


def test_empty_tables(spark):
    none = spark.createDataFrame([], LEAVES)
    assert op10_warc.audit(none, none).count() == 0
    ours = placed(files(9))
    assert verdicts(spark, ours, []) == expected(ours, missing=[r[4] for r in ours])
    assert op10_warc.layout(spark.createDataFrame([], "record_id long, length long, leaf string"), 1).count() == 0


def test_oracle(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    want = con.execute(op10_warc.ORACLE).df()
    cols = sorted(want.columns)
    got = op10_warc.query(spark, sf).select(cols).toArrow().to_pandas()
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want[cols].values.tolist()))


def test_warc_files(spark, tmp_path):
    bodies = [b"", b"\r\n\r\n", b"body" * 100_000]
    records = [f"WARC/1.0\r\nWARC-Record-ID: r{i}\r\nWARC-Target-URI: u{i}\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n" for i, b in enumerate(bodies)]
    members = [gzip.compress(r) for r in records]
    for name, parts in (("a.warc", records), ("b.warc.gz", members)):
        (tmp_path / name).write_bytes(b"".join(parts))
        out = op10_warc.read_warc(spark, str(tmp_path / name)).orderBy("offset").collect()
        assert [(r.offset, r.length, r.record_id, r.uri, r.leaf, r.error) for r in out] == [(sum(map(len, parts[:i])), len(b), f"r{i}", f"u{i}", hashlib.sha256(records[i]).hexdigest(), None) for i, b in enumerate(parts)]
        (tmp_path / f"cut-{name}").write_bytes(b"".join(parts)[:-10])
        out = op10_warc.read_warc(spark, str(tmp_path / f"cut-{name}")).collect()
        assert len(out) == 3 and [r.error is None for r in out] == [True, True, False]
    (tmp_path / "empty.warc").write_bytes(b"")
    assert op10_warc.read_warc(spark, str(tmp_path / "empty.warc")).count() == 0
    with pytest.raises(ValueError):
        list(op10_warc.parse_warc(b"nonsense"))
