"""Cover-tree search and flat-graph near-dedup against brute force."""

import math

import numpy as np

from pyspark.sql import functions as F

from labeldist.llm import cover_tree, flat_graph

SCHEMA = "vec_id LONG, embedding ARRAY<FLOAT>, label INT, score DOUBLE, rank INT, n STRING"


def table(spark, seed=3, n=700, dim=6):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    base[200:300] = base[100:200] + rng.normal(scale=0.02, size=(100, dim))   # near duplicates
    base[300:360] = base[0]                                                   # one vector many times
    rows = [(i, [float(np.float32(v)) for v in base[i]], int(i % 3) if i >= 300 else int(i % 100 % 3), 0.1, 1, "x") for i in range(n)]
    rows += [(None, rows[5][1], 0, None, None, None), (9001, None, 1, 0.0, 1, "x"), (9050, [1.0, None] + [0.0] * (dim - 2), 1, 0.0, 1, "x"),
             (9100, [float("nan")] + [0.0] * (dim - 1), 1, 0.0, 1, "x"), (9150, [float("inf")] + [0.0] * (dim - 1), 1, 0.0, 1, "x"),
             (9200, [0.0] * dim, 1, 0.0, 1, "x"), (9250, rows[7][1], None, 0.0, 1, "x"), (9300, [], 1, 0.0, 1, "x"), rows[50], rows[50]]
    return spark.createDataFrame(rows, SCHEMA), rows


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK_ROWS", 100)
    monkeypatch.setattr(cover_tree, "QUERY_ROWS", 5)
    df, rows = table(spark)
    points = [(j, r[0], [math.floor(256 * x) for x in r[1]]) for j, r in enumerate(rows) if usable(r[1])]
    want = []
    for j, i, p in points:
        if i is not None and i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(p, q)), m is None, m or 0, k) for k, m, q in points if k != j and len(q) == len(p))
            want += [(i, r, None if null else m, -s) for r, (s, null, m, _) in enumerate(best[:5], 1)]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in cover_tree.op3(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert cover_tree.op3(df.limit(0)).count() == 0 and cover_tree.op3(df.filter("vec_id = 50").limit(1)).count() == 0


def test_cover_tree_covers():
    x = np.random.default_rng(0).integers(-200, 200, size=(3000, 5))
    order, t = cover_tree.build(x)
    p = x[order].astype(float)
    assert sorted(order) == list(range(3000))
    for a, b, c, r, ch, k in zip(*(t[n] for n in ("first", "last", "center", "radius", "child", "children"))):
        d = np.sqrt(((p[a:b] - p[c]) ** 2).sum(axis=1))
        assert d.max() <= r + 1e-9
        if k:
            assert t["first"][ch] == a and t["last"][ch + k - 1] == b
            assert (t["first"][ch + 1:ch + k] == t["last"][ch:ch + k - 1]).all()


def links_of(rows):
    ok = [j for j, r in enumerate(rows) if usable(r[1]) and r[2] is not None and any(r[1])]
    links = {j: set() for j in range(len(rows))}
    for a in ok:
        for b in ok:
            if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= 0.98:
                    links[a].add(b)
    return links


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(flat_graph, "SHARD_ROWS", 60)
    df, rows = table(spark)
    links, comp = links_of(rows), {}
    for j in links:
        if j not in comp:
            todo, seen = [j], {j}
            while todo:
                for k in links[todo.pop()] - seen:
                    seen.add(k)
                    todo.append(k)
            ids = [rows[k][0] for k in seen if rows[k][0] is not None]
            comp |= dict.fromkeys(seen, min(ids) if ids else None)
    found = flat_graph.near_duplicates(df)
    got = sorted(((r["__id"], r.n_links, r.component) for r in found.collect()), key=repr)
    want = sorted(((rows[j][0], len(links[j]), comp[j]) for j in links), key=repr)
    assert len(got) == len(want)
    total, have = sum(w[1] for w in want), sum(g[1] for g in got)
    assert 0.97 * total <= have <= total                   # never a link below the threshold, hardly one missing
    assert sum(a == b for a, b in zip(got, want)) >= 0.97 * len(want)
    assert flat_graph.audit_recall(df, found) >= 0.97
    assert flat_graph.op4(df.limit(0)).count() == 0
    alone = {r.vec_id: r for r in flat_graph.op4(df).filter(F.col("vec_id") > 9000).collect()}
    assert all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for i, r in alone.items())


def families(spark, sizes, others, dim=32, seed=1):
    """Families of distinct vectors around cosine 0.985 of each other, and rows that lie elsewhere, under one label."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = np.concatenate([*(unit(rng.normal(size=dim)) + rng.normal(size=(n, dim)) * math.sqrt(0.015 / dim) for n in sizes),
                        rng.normal(size=(others, dim))])
    x = x[rng.permutation(len(x))]
    return spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id LONG, embedding ARRAY<DOUBLE>, label INT"), unit(x)


def test_large_families_of_distinct_vectors(spark, monkeypatch):
    monkeypatch.setattr(flat_graph, "SHARD_ROWS", 400)
    df, x = families(spark, (4000, 1500), 1500)
    want = (x @ x.T >= 0.98).sum(axis=1) - 1
    assert want.sum() > 5_000_000
    found = flat_graph.near_duplicates(df)
    rows = {r["__id"]: r for r in found.collect()}
    assert [rows[i].n_links for i in range(len(x))] == want.tolist()
    assert flat_graph.audit_recall(df, found) == 1.0
    group = np.arange(len(x))
    for i in range(len(x)):                                # components by brute force
        met = np.unique(group[np.append(np.flatnonzero(x @ x[i] >= 0.98), i)])
        if len(met) > 1:
            group[np.isin(group, met)] = met[0]
    assert [rows[i].component for i in range(len(x))] == group.tolist()


def test_cells_are_split_in_steps_of_few_centres(spark, monkeypatch):
    monkeypatch.setattr(flat_graph, "SHARD_ROWS", 50)
    monkeypatch.setattr(flat_graph, "FAN_OUT", 4)
    df, x = families(spark, (700,), 900, dim=8)
    nodes = df.selectExpr("label AS __label", "8 AS __dim", "embedding AS __x", "vec_id AS node", "1L AS copies")
    split = flat_graph.cells(nodes)
    assert sorted(split.columns) == sorted([*nodes.columns, "__cell"])     # no array of centres on the rows
    assert sorted(r.node for r in split.select("node").collect()) == list(range(len(x)))
    sizes = [r["count"] for r in split.groupBy("__cell").count().collect()]
    assert max(sizes) < 400 and split.filter("__cell >= 64").count() > 0    # three levels and more
    want = (x @ x.T >= 0.98).sum() - len(x)
    assert flat_graph.links_of(nodes, 0.98).agg(F.sum("links")).first()[0] == want
