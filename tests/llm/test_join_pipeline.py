"""Jaccard join and pipeline against brute force."""

import collections
import random
import re

import pytest

import corpus_pipeline
from labeldist.llm import mixing, ngram_join, sentencepieces
from labeldist.llm.common import stored

SF = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, width):
    w = [x for x in re.split(r"[ \t-\r]+", (text or "").translate(LOWER)) if x]
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def groups(texts, width, percent):
    """Set size and group (smallest place) of each text."""
    sets, root = [shingles(t, width) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            same = len(a & sets[j])
            if same and 100 * same >= percent * (len(a) + len(sets[j]) - same):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def family(seed):
    """Texts with exact and near copies, shared passages, and a family of close variants of one text."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    passages = [[word() for _ in range(25)] for _ in range(3)]
    texts = []
    for _ in range(40):
        t = [word() for _ in range(rng.randrange(1, 90))]
        if rng.random() < 0.5:
            at = rng.randrange(len(t))
            t[at:at] = rng.choice(passages)
        texts.append(t)
    for t in list(texts[:20]):
        u = list(t)
        for _ in range(rng.randrange(0, 4)):
            u[rng.randrange(len(u))] = word()
        texts.append(u)
    base = [word() for _ in range(80)]
    for _ in range(60):
        u = list(base)
        for _ in range(rng.randrange(0, 5)):
            u[rng.randrange(len(u))] = word() + "x"
        texts.append(u)
    texts += [[], ["a"], ["a"], ["A"], ["a", "b", "c"]] + [list(passages[0][:n]) for n in range(1, 25)]
    rng.shuffle(texts)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("width, percent, frequent", [(4, 85, 2), (5, 80, 4), (4, 85, 16), (1, 90, 3)])
def test_components_equal_brute_force(spark, monkeypatch, width, percent, frequent):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    texts = family(width + frequent)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").repartition(4)
    got = {r["__id"]: (r.n, r.component) for r in ngram_join.jaccard_components(docs, width, percent).collect()}
    assert [got[i] for i in range(len(texts))] == groups(texts, width, percent)


def test_without_broadcasts(spark, monkeypatch):
    from labeldist.llm import common
    monkeypatch.setattr(common, "MAX_BROADCAST_ROWS", 0)
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    texts = family(77)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    got = {r["__id"]: (r.n, r.component) for r in ngram_join.jaccard_components(docs, 4, 85).collect()}
    assert [got[i] for i in range(len(texts))] == groups(texts, 4, 85)


def test_join_edges(edge_docs, no_docs):
    rows = ngram_join.op5(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    got = collections.Counter((r.doc_id, r.component_id) for r in rows)
    assert got[(1, 1)] == 2 and got[(2, 1)] == 1 and got[(None, None)] == 2 and got[(3, 3)] == got[(4, 4)] == got[(5, 5)] == 1
    assert {r.doc_id: r.n_shingles for r in rows if r.doc_id in (3, 4, 5, 7)} == {3: 0, 4: 0, 5: 0, 7: 1}
    kept = ngram_join.one_of_each_group(edge_docs)
    assert kept.columns == edge_docs.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == {1: 1, None: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1}
    assert ngram_join.op5(no_docs).count() == 0 and ngram_join.one_of_each_group(no_docs).count() == 0


# --- pipeline

def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), "test")
        assert docs.columns == columns
        out[name] = docs.collect()
    identified, deduped, distinct, mix = (out[n] for n, _ in corpus_pipeline.STAGES[:-1])
    # clean documents of the four languages are recognised
    assert len(identified) >= 0.98 * before.count()
    # line dedup: three-line windows in order of the ids
    seen = set()
    want = {}
    for r in sorted(identified, key=lambda r: r.doc_id):
        lines, gone = r.text.split("\n"), set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i:i + 3])
            if any(x.strip(" ") for x in w):
                if w in seen:
                    gone |= {i, i + 1, i + 2}
                seen.add(w)
        text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        if not gone or text.strip():
            want[r.doc_id] = text
    assert {r.doc_id: r.text for r in deduped} == want and all(r.n_chars == len(r.text) for r in deduped)
    # near duplicates: the smallest id of each group stays
    rows = sorted(deduped, key=lambda r: r.doc_id)
    found = groups([r.text for r in rows], 5, 80)
    assert {r.doc_id for r in distinct} == {rows[i].doc_id for i in {g for _, g in found}}
    # the mix repeats documents as its operator says
    times = {r.doc_id: r["__repeats"] for r in mixing.mix(spark.createDataFrame(distinct, before.schema)).collect()}
    assert collections.Counter(r.doc_id for r in mix) == collections.Counter({k: v for k, v in times.items() if v})
    # segmentations spell the texts
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    back = sentencepieces.decode(last.withColumnRenamed("ids", "__ids"))
    text = {r.doc_id: r.text for r in mix}
    assert all(r["__decoded"] == text[r.doc_id] for r in back.collect())
    assert corpus_pipeline.run(spark, SF).count() == last.count() >= len(mix)


def test_stages_on_edges(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            before, docs = docs, stored(stage(spark, stored(docs, "test"), ""), "test")
            assert docs.count() <= 2 * before.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language ID", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding and decoding"]
