"""Embedding near-dedup, centroid clustering and the Merkle manifest against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from turnwright.llm import kmeans, merkle, metric_join

H = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
VECTORS = "vec_id long, embedding array<double>, lead int, cell int, v string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], VECTORS).repartition(3)


def brute_links(rows, threshold=0.9):
    """(vec_id, n_links, component_id) of every row, sorted as texts."""
    whole = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {i: metric_join.unit(np.array([rows[i][1]], float))[0] for i in whole}
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for at, i in enumerate(whole):
        for j in whole[:at]:
            if len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    members = {}
    for i in whole:
        members.setdefault(find(i), []).append(rows[i][0])
    return sorted((str(r[0]), links[i], str(min(members[find(i)]) if i in unit else r[0])) for i, r in enumerate(rows))


def family_rows():
    draw = np.random.default_rng(3)
    base = draw.normal(size=(40, 16))
    rows = [(i, (base[i % 40] + draw.normal(size=16) * draw.choice([0.02, 0.2, 0.35, 0.5])).tolist()) for i in range(500)]
    rows += [(1000 + i, (base[0] + draw.normal(size=16) * 0.05).tolist()) for i in range(250)]  # a third are near copies of one vector
    rows += [(2000 + i, base[1].tolist()) for i in range(80)]
    odd = [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [1.0] * 15 + [None]), (3004, [float("nan")] * 16), (3005, [float("inf")] * 16), (None, base[1].tolist())]
    return rows + odd + [(3, base[1].tolist()), (5, rows[5][1]), (5000, [1.0, 2.0]), (5001, [2.0, 4.0]), (5002, [1e300, 1e300]), (5003, [1.0] * 7)]


@pytest.mark.parametrize("sizes", [{}, {"cell": 50, "block": 20, "slice_": 64}, {"cell": 10, "block": 7, "slice_": 9}])
def test_metric_join_finds_every_link(spark, sizes):
    rows = family_rows()
    got = metric_join.near_duplicates(vectors(spark, rows), **sizes).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == brute_links(rows)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)


def test_metric_join_of_nothing(spark):
    assert metric_join.near_duplicates(vectors(spark, [(1, [1.0])]).limit(0)).collect() == []
    got = metric_join.near_duplicates(vectors(spark, [(1, None), (2, [0.0])])).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_a_core_is_counted_and_not_compared(spark):
    # 3,000 near copies, of which no pair is dealt into a task.
    draw = np.random.default_rng(9)
    base = draw.normal(size=24)
    rows = [(i, (base + draw.normal(size=24) * 0.01).tolist()) for i in range(3000)] + [(5000 + i, draw.normal(size=24).tolist()) for i in range(50)]
    got = metric_join.near_duplicates(vectors(spark, rows)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == sorted([(str(i), 2999, "0") for i in range(3000)] + [(str(5000 + i), 0, str(5000 + i)) for i in range(50)])


def brute_clusters(rows, k=16, rounds=3, dims=64):
    grid = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: H(f"1:{'' if i is None else i}")
    c = [x for _, x in sorted(grid, key=lambda r: (name(r[0]), r[1]))[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        at = [near(x)[1] for _, x in grid]
        for j in range(len(c)):
            own = [x for (_, x), b in zip(grid, at, strict=True) if b == j]
            if own:
                c[j] = [sum(t) // len(own) for t in zip(*own, strict=True)]
    last = [near(x) for _, x in grid]
    inertia = [sum(d for d, j in last if j == i) for i in range(len(c))]
    return sorted((str(i), j, d, inertia[j], sum(inertia), H(",".join(map(str, c[j])))) for (i, _), (d, j) in zip(grid, last, strict=True))


def test_clusters_are_those_of_full_scans(spark):
    draw = np.random.default_rng(5)
    base = draw.normal(size=(20, 64))
    rows = [(i, (base[i % 20] * (1 if i % 3 else 0.3) + draw.normal(size=64) * 0.3).tolist()) for i in range(600)]
    rows += [(900 + i, (np.round(draw.normal(size=64)) / 64).tolist()) for i in range(100)]  # many equal distances
    rows += [(2000, None), (2001, []), (2002, [None] * 64), (2003, [float("inf")] * 64), (2004, [0.0] * 64), (2005, [0.0] * 64), (7, rows[7][1]), (None, rows[9][1]), (3000, [1e4] * 64), (3001, [-1e4] * 63 + [2e4])]
    for part in (rows, rows[:5], rows[600:604] * 3, rows[700:701]):
        got = sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in kmeans.clusters(vectors(spark, part)).collect())
        assert got == brute_clusters(part)


def test_bounds_spare_scans():
    draw = np.random.default_rng(2)
    c = draw.integers(-1000, 1000, (16, 8))
    x = np.repeat(c, 200, 0) + draw.integers(-20, 20, (3200, 8))
    best, own, second = kmeans.scanned(x, c)
    moved = c + draw.integers(-2, 3, c.shape)
    drift = np.sqrt(((moved - c) ** 2).sum(1)) * (1 + kmeans.SLACK)
    cluster, upper, lower, scans = kmeans.settled(best, np.sqrt(own) * (1 + kmeans.SLACK), np.sqrt(second.astype(float)) * (1 - kmeans.SLACK), x, moved, drift)
    truth, d, d2 = kmeans.scanned(x, moved)
    assert (cluster == truth).all() and scans < len(x) / 100
    assert (upper >= np.sqrt(d)).all() and (lower <= np.sqrt(d2)).all()


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        first = i // 8 * 8
        yield level[first:i], level[i + 1 : first + 8]
        i //= 8


def brute_manifest(rows):
    lower = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    leaf = lambda r, text: H([encoded(x) for x in (r[0], r[3], r[2], r[4], text)])
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = brute_tree([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = [*siblings(trees[g], i), *siblings(top, at)]
            now = leaf(r, lower(r[1])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else own
            for before, after in path:
                now = H([*before, now, *after])
            out.append((str(r[0]), own, trees[g][-1][0], top[-1][0], H([x for before, after in path for x in before + after]), now, now == top[-1][0]))
    return sorted(out)


def test_manifest(spark):
    draw = random.Random(1)
    rows = [(i * 7 - 50, draw.choice(["Abc déf", "", None, "lower only", "X" * 300_000]), draw.choice(["en"] * 6 + ["fr", "é", "zz", None, ""]), draw.choice(["a", None, "bé"]), draw.choice([None, 3, 0])) for i in range(400)]
    rows += [(None, "A", "en", None, 1), (None, "A", "en", None, 1), (0, "q", "en", "s", 1), (0, "Q", "en", "s", 1), (5, "A", "one", None, 1)]
    many = [(i, f"T{i}", f"l{i % 100}", "s", 1) for i in range(200)]
    for part, power in ((rows, None), (rows, 1), (rows, 2), (many, 1), (rows[:1], None), (rows[:9], 1)):
        table = spark.createDataFrame([(*r, "x", 1, 2) for r in part], "doc_id long, text string, lang string, source string, n_chars long, start string, tree int, i int").repartition(5)
        got = merkle.manifest(table, power=power).collect()
        assert sorted((str(r.doc_id), *r[1:]) for r in got) == brute_manifest(part)
    assert merkle.manifest(table.limit(0)).collect() == []


def test_forests_merge_in_any_order():
    draw = random.Random(4)
    digests = [H(str(i)) for i in range(203)]
    root = brute_tree(digests)[-1][0]
    parts = [merkle.Forest({(0, 0, i): d}, {0: len(digests)}) for i, d in enumerate(digests)]
    while len(parts) > 1:
        a, b = (parts.pop(draw.randrange(len(parts))) for _ in range(2))
        parts.append(a.merge(b))
    assert parts[0].nodes == {(0, 3, 0): root}
