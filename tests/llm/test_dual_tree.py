"""Dual-tree lexical search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from labeldist.llm import dual_tree

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    vectors = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(v.values()) for _, v in vectors]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, v in vectors for t in v)
    out = []
    for item, text in items:
        want, scores = Counter(terms(text)), []
        for row, ((doc, v), n) in enumerate(zip(vectors, sizes, strict=True)):
            m = 75 + (25 * n * n_docs) // n_terms if n_terms else 0
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * v[t] // (1000 * v[t] + 12 * m))
                    for t, c in want.items() if v[t])
            if s > 0:
                scores.append((-s, doc is None, doc, row))
        out += [(item, r, x[2], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0, x[3]))[:k], 1)]
    return out


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(13)
    words = [f"w{i}" for i in range(300)] + ["É", "naïve", "X9"]
    line = lambda n: " ".join(words[int(len(words) * rnd.random() ** 3)] for _ in range(n))
    docs = [(i, line(rnd.randrange(1, 120))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)] + [(None, docs[7][1])] * 2 + [(500, None), (501, ""), (502, "?!"), (7, docs[7][1])]
    items = [(i, line(rnd.randrange(1, 40))) for i in range(40)] + [(40, docs[7][1].upper()), (40, docs[7][1]), (41, None), (None, "w0 w1")]
    return docs, items


@pytest.mark.parametrize("small_blocks", [False, True])
def test_equals_brute_force(spark, corpus, monkeypatch, small_blocks):
    docs, items = corpus
    d = spark.createDataFrame(docs, "doc_id LONG, text STRING").repartition(5)
    b = spark.createDataFrame(items, "item_id LONG, text STRING")
    if small_blocks:
        monkeypatch.setattr(dual_tree, "ITEM_TERMS", 100)
        monkeypatch.setattr(dual_tree, "BLOCKS_AT_ONCE", 3)
    for k in (3, 20):
        assert rows(dual_tree.top_k(d, b, k)) == sorted(plain(docs, items, k), key=repr)


def test_trees_hold_maxima():
    x = np.random.default_rng(1).integers(0, 9, (77, 5)).astype(np.float32)
    tree = dual_tree.Tree(x, x, 4)
    assert sorted(tree.order) == list(range(77)) and (tree.x == x[tree.order]).all()
    for i in range(len(tree.first)):
        assert (tree.top[i] == tree.x[tree.first[i]:tree.last[i]].max(axis=0)).all()
    leaves = np.sort(tree.leaves(np.zeros(1, np.int64)))
    assert sorted(np.concatenate([np.arange(tree.first[i], tree.last[i]) for i in leaves])) == list(range(77))


def test_most_pairs_are_pruned(spark):
    """On the given documents most pairs of an item and a document are dropped by the bounds of their nodes."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    known = sorted({t for x in items for t in terms(x)})
    place = {t: i for i, t in enumerate(known)}
    x, w = np.zeros((len(docs), len(known)), np.float32), np.zeros((len(items), len(known)))
    df = Counter()
    for i, (_, text) in enumerate(docs):
        c = Counter(terms(text))
        m = 75 + 25 * sum(c.values()) // 370     # about the mean length
        for t in c.keys() & place.keys():
            x[i, place[t]] = 10**9 * c[t] // (1000 * c[t] + 12 * m)
            df[t] += 1
    for i, text in enumerate(items):
        for t, c in Counter(terms(text)).items():
            w[i, place[t]] = c * math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1)))
    tree, best = dual_tree.Tree(x, x * w.max(axis=0).astype(np.float32), dual_tree.LEAF), dual_tree.Best(len(items), 20)
    ids = np.arange(len(docs))
    scored = dual_tree.search(dual_tree.Tree(w, w, 1), tree, ids[tree.order], ids[tree.order], best)
    print("share scored", scored / len(docs) / len(items))
    assert scored < 0.5 * len(docs) * len(items)
    full = (w.astype(np.int64) @ x.T.astype(np.int64))
    for i in range(len(items)):
        want = sorted(((-s, j) for j, s in enumerate(full[i].tolist()) if s > 0))[:20]
        assert [(-a, b) for a, b in zip(best.score[i], best.id[i], strict=True) if a > 0] == want


def test_edges(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "the fox and the hill", 1), (1, "the fox and the hill", 1), (2, None, None), (3, "", 1), (4, "unheard", 1)],
                                  "item_id LONG, text STRING, rank INT")
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    want = sorted(plain(docs, [(r.item_id, r.text) for r in items.collect()], 20), key=repr)
    assert want and rows(dual_tree.op13(edge_docs, items)) == want
    assert dual_tree.op13(no_docs, items).count() == 0 and dual_tree.op13(edge_docs, items.limit(0)).count() == 0


def test_memory_is_bounded(spark, monkeypatch):
    """Rows of megabytes lie in small row groups (a reader decodes one at once), and items are laid out some at a time."""
    docs = [(i, " ".join(f"{i}x{j}" for j in range(i, 200_000 + i))) for i in range(16)]
    d = spark.createDataFrame(docs, "doc_id LONG, text STRING").coalesce(1)
    kept, stored = {}, dual_tree.stored
    monkeypatch.setattr(dual_tree, "stored", lambda df, name, **kw: kept.setdefault(name, stored(df, name, **kw)))
    items = spark.createDataFrame([(1, "3x100"), (2, "0x5 9x9")], "item_id LONG, text STRING")
    assert [(r.item_id, r.doc_id) for r in sorted(dual_tree.top_k(d, items).collect())] == [(1, 3), (2, 0), (2, 9)]
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in kept["vectors"].inputFiles()]
    groups = [m.row_group(i).total_byte_size for m in files for i in range(m.num_row_groups)]
    assert sum(groups) > 20e6 and max(groups) < 16e6
    # 10 items of 500 terms are laid out 4 at a time
    monkeypatch.setattr(dual_tree, "ITEM_CELLS", 2_000)
    owner, term = np.repeat(np.arange(10), 500), np.tile(np.arange(500), 10)
    weight = np.arange(5_000)
    trees = dual_tree._items(owner, term, weight, 10, 500)
    assert [a for a, _ in trees] == [0, 4, 8] and max(t().x.size for _, t in trees) == 2_000
    for a, t in trees:
        tree = t()
        assert (tree.x == weight.reshape(10, 500)[a + tree.order]).all()
