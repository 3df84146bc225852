"""The FM-index and decontamination against plain searches."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from labeldist.llm import fm_index

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shard(rnd, n_texts, letters, longest):
    texts = [[rnd.randrange(letters) for _ in range(rnd.randrange(longest))] for _ in range(n_texts)]
    texts += texts[:n_texts // 2]      # exact copies
    out = []
    for i, t in enumerate(texts):
        out += [x + len(texts) for x in t] + [i]
    return np.array(out), len(texts)


def test_suffix_order_search_and_locate():
    rnd = random.Random(12)
    for n_texts, letters, longest in ((1, 1, 5), (1, 1, 200), (6, 1, 40), (10, 2, 60), (30, 3, 300), (40, 400, 100)):
        symbols, n = shard(rnd, n_texts, letters, longest)
        order = fm_index.suffix_order(symbols)
        suffixes = [symbols[i:].tolist() for i in range(len(symbols))]
        assert order.tolist() == sorted(range(len(symbols)), key=suffixes.__getitem__)
        index = fm_index.Index(*fm_index.build(symbols)).size(len(symbols))
        asked = [[-1], [n], [-1, n]]
        for _ in range(200):
            i = rnd.randrange(len(symbols))
            asked.append([int(x) if rnd.random() < 0.97 else n + rnd.randrange(letters) for x in symbols[i:i + rnd.randrange(1, 12)]])
        size = np.array([len(p) for p in asked])
        low, high = index.rows(np.concatenate(asked), np.cumsum(size) - size, size, len(symbols))
        for p, a, b in zip(asked, low, high, strict=True):
            places = [i for i in range(len(symbols)) if suffixes[i][:len(p)] == p]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == places


def plain(docs, items, width=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + width]), set()).add("" if item is None else str(item))
    out = []
    for rid, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        start = sorted(i for i in hit if i - 1 not in hit)
        end = sorted(i + 1 for i in hit if i + 1 not in hit)
        out.append((rid, len(w), list(zip(start, end, strict=True)) or None, sorted(found) or None))
    return out


def rows(df):
    return [(r["__id"], r["__n_words"], r["__spans"] and [tuple(s) for s in r["__spans"]], r["__items"]) for r in df.collect()]


def corpus(spark):
    rnd = random.Random(3)
    line = lambda n: " ".join(rnd.choice("Ab cd É7 x-y, the! of".split()) for _ in range(n))
    items = [(i, line(rnd.randrange(1, 25))) for i in range(30)] + [(3, "again and again"), (None, "lost words here"), (77, None), (78, " ?! ")]
    texts = [line(200) for _ in range(20)] + [line(30) + "; " + items[i][1].upper() + ". " + line(40) for i in range(30)]
    texts += ["say Again, and again and again and again", "LOST words\nhere", "", None, line(3000)]
    docs = list(enumerate(texts)) + [(50, texts[50]), (None, texts[51])]
    return docs, items, spark.createDataFrame(docs, "doc_id LONG, text STRING"), spark.createDataFrame(items, "item_id INT, text STRING")


def test_equals_plain_search(spark, monkeypatch):
    docs, items, d, b = corpus(spark)
    want = sorted(map(str, plain(docs, items)))
    assert sorted(map(str, rows(fm_index.decontaminate(d, b)))) == want
    monkeypatch.setattr(fm_index, "BLOCK_WINDOWS", 20)     # windows in several blocks, broadcast in several rounds
    monkeypatch.setattr(fm_index, "BLOCKS_AT_ONCE", 2)
    assert sorted(map(str, rows(fm_index.decontaminate(d, b)))) == want


def test_spans_are_cut_out(spark):
    docs = spark.createDataFrame([(1, "Keep this. THE quick brown-fox jumps; and so on.", "x"), (2, "Clean.", "y"), (3, None, "z")],
                                 "doc_id LONG, text STRING, spans STRING")
    items = spark.createDataFrame([("q", "the quick brown fox jumps")], "item_id STRING, text STRING")
    got = {r.doc_id: (r.text, r.spans) for r in fm_index.without_spans(docs, items).collect()}
    assert got == {1: ("Keep this. ; and so on.", "x"), 2: ("Clean.", "y"), 3: (None, "z")}


def test_edges(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "One fine day the fox ran over the hill", 5), (1, "One fine day the fox ran over the hill", 5),
                                   (2, "w0 the w1 the w4 the w9 the w16 the w25", 5), (None, "chat", None)], "item_id LONG, text STRING, rid INT")
    got = rows(fm_index.decontaminate(edge_docs, items))
    want = plain([(r.doc_id, r.text) for r in edge_docs.collect()], [(1, "One fine day the fox ran over the hill"),
                                                                     (2, "w0 the w1 the w4 the w9 the w16 the w25"), (None, "chat")])
    assert sorted(map(str, got)) == sorted(map(str, want)) and any(x[2] for x in want)
    assert fm_index.op12(no_docs, items).count() == 0
    out = fm_index.op12(edge_docs, items.limit(0))
    assert out.count() == edge_docs.count() and out.filter("contaminated or n_items > 0").count() == 0
    clean = fm_index.without_spans(edge_docs, items)
    assert clean.columns == edge_docs.columns and clean.count() == edge_docs.count()
    assert clean.filter(F.col("text").contains("petit chat")).count() == 0


def test_long_text(spark):
    body = " ".join(f"w{i * i % 7919}" for i in range(200_000))
    passage = " ".join(f"p{i}" for i in range(15))
    docs = spark.createDataFrame([(1, body + " " + passage + " " + body), (2, "go " * 300_000)], "doc_id LONG, text STRING")
    items = spark.createDataFrame([(1, passage), (2, "go go go go go go go go go go go")], "item_id LONG, text STRING")
    got = {r[0]: r[1:] for r in rows(fm_index.decontaminate(docs, items))}
    assert got == {1: (400_015, [(200_000, 200_015)], ["1"]), 2: (300_000, [(0, 300_000)], ["2"])}
