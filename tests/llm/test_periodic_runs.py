"""Periodic runs against a plain search over all starts and periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from labeldist.llm import periodic_runs
from labeldist.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(words):
    """All maximal runs: for each period the stretches of words that equal the word a period on."""
    best = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q):
                best.setdefault((i, j + q), q)   # the smallest period comes first
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts():
    rnd = random.Random(11)
    yield ""
    yield "a " * 400
    yield "a b " * 5 + "a " + "a b a " * 9
    yield "a b a b a b a a b a b a b a " * 2     # a period whose own words repeat with another
    for letters in (1, 2, 2, 2, 3, 4, 30):
        for n in (11, 12, 13, 50, 200):
            words = [str(rnd.randrange(letters)) for _ in range(n)]
            yield " ".join(words)
            a, p = rnd.randrange(n), rnd.randrange(1, n)
            yield " ".join(words[i if i < a else a + (i - a) % p] for i in range(n))
    for p in (5, 6, 7, 11, 12, 13, 23, 24, 25, 47, 95, 96, 97):    # both sides of the classes' borders
        for extra in (0, 1, p - 1):
            body = [f"w{rnd.randrange(99)}" for _ in range(p)]
            yield " ".join(["x"] * 3 + (body * 4)[:2 * p + extra] + ["y"] * 3)
            yield " ".join((body * 30)[:17 * p + extra])
    w = ["a"]
    for _ in range(9):      # a Fibonacci word is full of runs
        w = [w[0], "a b"] if len(w) < 2 else [w[1], w[1] + " " + w[0]]
    yield w[1]


def test_equals_plain_search():
    all_words = [WORD.findall(t) for t in texts()]
    number = {w: i for i, w in enumerate(sorted({w for ws in all_words for w in ws}))}
    flat = np.array([number[w] for ws in all_words for w in ws])
    text = np.repeat(np.arange(len(all_words)), [len(ws) for ws in all_words])
    start, end, period = periodic_runs.find_runs(flat, text)
    base = np.concatenate([[0], np.cumsum([len(ws) for ws in all_words])])
    for i, ws in enumerate(all_words):
        mine = (start >= base[i]) & (start < base[i + 1])
        assert list(zip(start[mine] - base[i], (end - start)[mine], period[mine], strict=True)) == plain(ws), i


def test_work_stays_linear():
    """One word a hundred thousand times: all lags match everywhere, and still few seeds and one run."""
    n = 100_000
    words = np.zeros(n, np.int64)
    grams = periodic_runs.Grams(words, words)
    block = periodic_runs.OVERLAP
    while 4 * block <= n:
        assert len(periodic_runs._seeds(grams, block)[0]) <= 2 * n
        grams.double(block)
        block *= 2
    assert [x.tolist() for x in periodic_runs.find_runs(words, words)] == [[0], [n], [1]]


def test_edges(spark, edge_docs, no_docs):
    got = periodic_runs.periodic_runs(edge_docs)
    assert got.columns == [*edge_docs.columns, "__n_words", "__runs", "__collapsed"]
    rows = got.collect()
    assert sorted(map(str, got.select(*edge_docs.columns).collect())) == sorted(map(str, edge_docs.collect()))
    for r in rows:
        words = WORD.findall(r.text or "")
        runs = [tuple(x) for x in r["__runs"]]
        assert r["__n_words"] == len(words) and r["__collapsed"] == collapsed(words, runs)
        if len(words) < 10_000:
            assert runs == plain(words)
    assert periodic_runs.periodic_runs(no_docs).count() == 0 and periodic_runs.op11(no_docs).count() == 0
    assert periodic_runs.op11(edge_docs).count() == edge_docs.count()


def test_long_text(spark):
    body = " ".join(f"w{i * i % 7919}" for i in range(30_000))
    docs = spark.createDataFrame([(1, "x " + " ".join([body] * 3) + " y"), (2, "go on " * 200_000)], "doc_id LONG, text STRING")
    got = {r.doc_id: [tuple(x) for x in r["__runs"]] for r in periodic_runs.periodic_runs(docs).collect()}
    # three bodies of 30,000 words, and inside each the squares repeat with the modulus
    assert got[2] == [(0, 400_000, 2)]
    assert (1, 90_000, 30_000) in got[1] and sum(r[2] == 7919 and r[1] >= 30_000 for r in got[1]) == 3


@pytest.mark.parametrize("key", ["op11_periodic_runs"])
def test_query(spark, key):
    got = {r.doc_id: r for r in QUERIES[key](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert set(got) == {d.doc_id for d in docs}
    planted = 0
    for d in docs:
        words = WORD.findall(d.text or "")
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g, planted = h // 10, planted + 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs, r = plain(words), got[d.doc_id]
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(top or (None,) * 3))
        assert r.exponent_milli == (1000 * top[1] // top[2] if top else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert planted > 10
