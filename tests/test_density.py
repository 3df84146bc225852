"""Exact neighbours, spanning tree and density hierarchy against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labeldist.operators import density as DN
from labeldist.operators import neighbours as NB


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id LONG, x ARRAY<DOUBLE>").repartition(4)


def blobs(seed=1, n=60, noise=40):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(c, s, (m, 3)) for c, s, m in ((0, .3, n), (4, .8, 2 * n), (-5, .1, n // 2), (-5.8, .1, n // 2))]
    x = np.vstack([*parts, rng.uniform(-8, 8, (noise, 3))])
    return np.vstack([x, x[:7]])     # some rows twice


def plain_reach(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, min(k, len(x)) - 1]
    return d, np.maximum(d, np.maximum(core[:, None], core[None]))


def plain_tree(reach):
    """Edges in order of weight and ids that join two trees."""
    n = len(reach)
    up = list(range(n))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a
    out = []
    for w, a, b in sorted((reach[a, b], a, b) for a in range(n) for b in range(a + 1, n)):
        if find(a) != find(b):
            up[find(b)] = find(a)
            out.append((w, a, b))
    return out


def plain_labels(tree, n, least):
    """From the top: cut the heaviest edge, follow the parts, choose by excess of mass."""
    def parts(rows, edges):
        seen, out = {}, []
        near = {}
        for _, a, b in edges:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        for r in rows:
            if r not in seen:
                todo, group = [r], {r}
                while todo:
                    for y in near.get(todo.pop(), []):
                        if y not in group:
                            group.add(y)
                            todo.append(y)
                seen |= dict.fromkeys(group)
                out.append(group)
        return out

    def walk(rows, edges, birth):
        """(stability of the best choice, chosen groups) of the cluster with these rows."""
        rows, edges, mass = set(rows), list(edges), 0.0
        whole = frozenset(rows)
        while True:
            w, a, b = edges.pop()
            lam = 1 / max(w, DN.LEAST)
            one, two = (lambda p: (p[0], p[1]))(parts(rows, edges))
            big = [g for g in (one, two) if len(g) >= least]
            if len(big) == 2:
                mass += len(rows) * lam
                below = [walk(g, [e for e in edges if e[1] in g], lam) for g in big]
                best = below[0][0] + below[1][0], below[0][1] + below[1][1]
                break
            mass += sum(len(g) for g in (one, two) if len(g) < least) * lam
            if not big:
                best = 0.0, []
                break
            rows = big[0]
            edges = [e for e in edges if e[1] in rows]
        own = mass - len(whole) * birth
        return (own, [whole]) if own >= best[0] and birth > 0 else best

    out = [-1] * n
    for g in walk(range(n), tree, 0.0)[1] if n >= least else []:
        for r in g:
            out[r] = min(g)
    return out


def test_k_nearest_equals_all_distances(spark):
    x = blobs()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for part_bytes in (24 * 1000, 24 * 40):       # all in few parts; small parts, cells cut
        cells = NB.in_cells(frame(spark, x), rows_per_cell=20, part_bytes=part_bytes)
        got = {r.id: [(round(n.distance, 9), n.id) for n in r.near] for r in NB.k_nearest(cells, 6).collect()}
        for i in range(len(x)):
            want = sorted((round(v, 9), j) for j, v in enumerate(d[i]) if j != i)[:6]
            assert [v for v, _ in got[i]] == pytest.approx([v for v, _ in want])
            assert {j for v, j in got[i] if v < want[-1][0]} == {j for v, j in want if v < want[-1][0]}


def test_tree_and_labels_equal_plain(spark, monkeypatch):
    for seed, known, block in ((1, 16, 500_000), (2, 4, 60)):      # with searches for unknown edges, and several blocks
        monkeypatch.setattr(DN, "KNOWN", known)
        monkeypatch.setattr(DN, "BLOCK_EDGES", block)
        x = blobs(seed)
        _, reach = plain_reach(x, 5)
        cells = NB.in_cells(frame(spark, x), rows_per_cell=30, part_bytes=24 * 80)
        near = NB.written(NB.k_nearest(cells, max(known, 4)))
        core = near.select("id", F.col("near")[3]["distance"].alias("core"))
        tree = DN.spanning_tree(cells, core, near)
        want = plain_tree(reach)
        assert sorted(r.w for r in tree.collect()) == pytest.approx([w for w, _, _ in want]) and tree.count() == len(x) - 1
        got = {r.id: r.cluster for r in DN.density_hierarchy(frame(spark, x), 5).collect()}
        labels = plain_labels(want, len(x), 5)
        assert [got[i] for i in range(len(x))] == labels
        assert len(set(labels)) >= 4 and -1 in labels


def test_few_and_equal_rows(spark):
    few = frame(spark, [[0.0], [1.0], [2.0]])
    assert {r.cluster for r in DN.density_hierarchy(few, 5).collect()} == {-1}
    two = frame(spark, [[0.0]] * 6 + [[9.0]] * 7)
    assert [r.cluster for r in DN.density_hierarchy(two, 5).orderBy("id").collect()] == [0] * 6 + [6] * 7


def test_close_equals_all_distances():
    """Far-off rows, repeated rows and rows at the very reach; few pairs are measured beyond those that count."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 32))
    x[:300, 0] += 30
    x[-9:, 1] += 10.0 ** np.arange(9)
    x = np.vstack([x, x[:5], x[:5]])
    d = np.sqrt(np.array([np.einsum("ij,ij->i", x - r, x - r) for r in x]))
    q, use = np.r_[0:200, 890:910], rng.random(len(x)) < 0.9
    reach = np.sort(d[q], axis=1)[:, 12]                # exactly as far as the 12th
    asked = []

    def wanted(i, j):
        asked.append(len(i))
        return q[i] != j
    got = [set() for _ in q]
    for i, j, far in NB.Targets(x).close(x[q], reach.copy(), use, wanted):
        assert (far == d[q[i], j]).all()
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            got[a].add(b)
    assert got == [{j for j in np.flatnonzero(use).tolist() if j != a and d[a, j] <= r} for a, r in zip(q.tolist(), reach, strict=True)]
    assert sum(asked) < 0.1 * len(q) * len(x)
    # without a reach: those that may be among the nearest
    got = [[] for _ in q]
    for i, j, far in NB.Targets(x).close(x[q], np.full(len(q), np.inf), use, lambda i, j: q[i] != j, 7):
        for a, v in zip(i.tolist(), far.tolist(), strict=True):
            got[a].append(v)
    for a, found in zip(q.tolist(), got, strict=True):
        others = np.flatnonzero(use & (np.arange(len(x)) != a))
        assert sorted(found)[:7] == sorted(d[a, others].tolist())[:7] and len(found) < 0.2 * len(x)


def test_groups_apart_outliers_and_many_copies(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(260, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:100, 0] += 3
    x[-8:, 5] += 20 + 50.0 * np.arange(8)
    x = np.vstack([x, np.repeat(x[:3], 20, axis=0)])    # more copies than there are known neighbours
    _, reach = plain_reach(x, 5)
    want = plain_tree(reach)
    cells = NB.in_cells(frame(spark, x), rows_per_cell=30, part_bytes=8 * 24 * 60)
    near = NB.written(NB.k_nearest(cells, DN.KNOWN))
    core = near.select("id", F.col("near")[3]["distance"].alias("core"))
    tree = DN.spanning_tree(cells, core, near).collect()
    assert sorted(r.w for r in tree) == pytest.approx([w for w, _, _ in want]) and len({(r.a, r.b) for r in tree}) == len(x) - 1
    up = list(range(len(x)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a
    for r in tree:
        assert find(r.a) != find(r.b)
        up[find(r.b)] = find(r.a)


def test_components_by_the_driver_and_by_spark(spark, monkeypatch):
    rng = np.random.default_rng(2)
    up = [int(rng.integers(0, i)) if i % 7 else i for i in range(200)]        # trees
    edges = spark.createDataFrame([(i, j) for i, j in enumerate(up) if i != j], "ca LONG, cb LONG")
    comp = spark.createDataFrame([(1000 + i, i) for i in range(205)], "id LONG, comp LONG")
    found = []
    for few in (DN.FEW_EDGES, 0):
        monkeypatch.setattr(DN, "FEW_EDGES", few)
        found.append(sorted((r.id, r.comp) for r in DN._components(edges, comp).collect()))
    assert found[0] == found[1] and len({c for _, c in found[0]}) == 29 + 5
