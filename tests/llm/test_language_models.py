"""Katz backoff, PU quality, language ID and SentencePiece sampling."""

import collections
import math
import tracemalloc
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labeldist.llm import katz, language_id, pu_quality, sentencepieces
from labeldist.llm.common import crc_mod

SF = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return [w for w in re.split(r"[ \t-\r]+", (text or "").translate(LOWER)) if w]


# --- Katz backoff

class Plain:
    """The model, stated directly."""

    def __init__(self, texts, order):
        self.c = [None] + [collections.Counter() for _ in range(order)]
        for t in texts:
            s = ["<s>", *words(t), "</s>"]
            for i in range(1, len(s)):
                for m in range(1, order + 1):
                    if i - m + 1 >= 0:
                        self.c[m][tuple(s[i - m + 1:i + 1])] += 1
        self.d = [None] + [self.discounts(self.c[m]) for m in range(1, order + 1)]
        self.n = sum(self.c[1].values())
        self.follow = collections.defaultdict(list)
        for m in range(2, order + 1):
            for g in self.c[m]:
                self.follow[g[:-1]].append(g[-1])
        self.order = order
        self.context = lru_cache(None)(self.context)

    @staticmethod
    def discounts(counts):
        n, out = collections.Counter(counts.values()), [1.0] * 7
        if n[1]:
            common = 6 * n[6] / n[1]
            for r in range(1, 6):
                d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 1.0
                out[r] = d if 0 < d < 1 else 1.0
        return out

    def kept(self, m, c):
        return c * self.d[m][min(c, 6)]

    def context(self, ctx):
        m = len(ctx) + 1
        follow = self.follow.get(ctx)
        if not follow:
            return None
        total = sum(self.c[m][(*ctx, w)] for w in follow)
        kept = sum(self.kept(m, self.c[m][(*ctx, w)]) for w in follow)
        total += total - kept < 1e-9 * total
        return total, (1 - kept / total) / (1 - sum(self.p(ctx[1:], w) for w in follow))

    def p(self, ctx, w):
        if not ctx:
            kept = sum(self.kept(1, c) for c in self.c[1].values())
            room = kept >= self.n - 1e-9 * self.n
            c = self.c[1].get((w,), 0)
            return self.kept(1, c) / (self.n + room) if c else 1 - kept / (self.n + room)
        x = self.context(ctx)
        if x is None:
            return self.p(ctx[1:], w)
        c = self.c[len(ctx) + 1].get((*ctx, w), 0)
        return self.kept(len(ctx) + 1, c) / x[0] if c else x[1] * self.p(ctx[1:], w)

    def score(self, text):
        s = ["<s>", *words(text), "</s>"]
        return sum(math.log10(self.p(tuple(s[max(0, i - self.order + 1):i]), s[i])) for i in range(1, len(s)))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz_equals_plain_model(spark, monkeypatch, order):
    monkeypatch.setattr(katz, "CHUNK_BYTES", 3000)
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(60)]
    texts = [" ".join(vocab[min(int(x), 59)] for x in rng.exponential(8, rng.integers(0, 30))) for _ in range(150)] + [None, "", "NEW Words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").repartition(3)
    train = {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 != 2}
    model = Plain([texts[i] for i in train], order)
    got = {r.id: r for r in katz.score(docs, crc_mod(F.col("doc_id"), 7) != 2, order).collect()}
    n, v = model.n, len(model.c[1])
    for i, t in enumerate(texts):
        tokens = [*words(t), "</s>"]
        assert (got[i].n_tokens, got[i].train, got[i].train_tokens) == (len(tokens), i in train, n)
        assert got[i].n_known == sum((w,) in model.c[1] for w in tokens)
        assert got[i].base_score == pytest.approx(sum(math.log10((model.c[1][(w,)] + 1) / (n + v + 1)) for w in tokens))
        assert got[i].score == pytest.approx(model.score(t), rel=1e-9)
    if order > 1:   # every context's probabilities sum to one, the unknown word included
        for ctx in [("<s>",), ("w0",), ("w40",), ("unseen",)]:
            assert sum(model.p(ctx, w) for (w,) in model.c[1]) + model.p(ctx, "?") == pytest.approx(1)


def test_katz_edges(edge_docs, no_docs):
    assert katz.op2(edge_docs).count() == edge_docs.count()
    assert katz.op2(no_docs).count() == 0
    rows = katz.score(edge_docs, F.lit(False)).collect()
    assert all(r.score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in rows)


def test_katz_packs_any_keys():
    for keys in ([], [5], [0, 1, 2**63, 2**64 - 1], [3, 4, 9]):
        k = np.array(keys, np.uint64)
        assert (katz._unpack(katz._pack(k)) == k).all()
    for c in ([], [0, 255], [256], [2**40, 1]):
        assert (katz._counts(katz._pack_counts(np.array(c, np.int64))) == np.array(c)).all()


# --- quality

def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = pu_quality.op7(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert np.mean([r.predicted for r in good]) > 0.98 and np.mean([r.predicted for r in bad]) < 0.1


def test_quality_ignores_negatives_and_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    a = pu_quality.op7(docs, labels).collect()
    held = crc_mod(F.col("doc_id"), 5) == 0
    b = pu_quality.op7(docs.withColumn("lang", F.lit("x")), labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))).collect()
    assert {r.doc_id: round(r.score, 9) for r in a} == {r.doc_id: round(r.score, 9) for r in b}


def test_quality_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 0), (None, 1, 0), (6, None, 0), (7, 0, 0)], "doc_id LONG, quality INT, toxic INT")
    rows = pu_quality.op7(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert {r.score for r in pu_quality.op7(edge_docs, labels.limit(0)).collect()} == {0.5}
    assert pu_quality.op7(no_docs, labels).count() == 0


# --- language ID

def test_languages_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.op9(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.99


def test_kneser_ney_sums_to_one():
    grams = language_id.Grams(["aba", "abba", "cab", "b"])
    counts = np.bincount(grams.gram)
    levels = language_id.kneser_ney(language_id.characters(grams.a, grams.b), counts, language_id.slot(grams.a, grams.b))
    model = {"x": levels}
    alphabet = [ord(c) for c in " abc"] + [0x4E00]    # one character stands for all unknown ones
    for context in ("   ", "  a", " ab", "abb", "zzz", " ca"):
        packed = [[ord(c) for c in context] + [x] for x in alphabet]
        a = np.array([(p[0] << 42) | (p[1] << 21) | p[2] for p in packed], np.uint64)
        p = np.exp(language_id.log_probabilities(model, a, np.array([p[3] for p in packed], np.uint64)))[:, 0]
        assert p.sum() == pytest.approx(1)


def many_types(spark):
    """Two languages of characters without spaces, so that most n-grams are seen once or twice."""
    rng = np.random.default_rng(4)
    texts = [("".join(chr(0x4E00 + first + c) for c in rng.zipf(1.3, 4000) % 3000), lang) for lang, first in (("x", 0), ("y", 2000)) for _ in range(25)]
    return spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(texts)], "doc_id LONG, text STRING, lang STRING")


def test_every_ngram_counts_at_every_order(spark):
    docs = many_types(spark)
    seen = [collections.defaultdict(set) for _ in range(5)]
    for r in docs.collect():
        s = "   " + r.text + " "
        for k in range(1, 5):
            seen[k][r.lang] |= {s[i - k + 1:i + 1] for i in range(3, len(s))}
    model = language_id.fit(docs)
    for lang, levels in model.items():
        assert [len(grams) for grams, *_ in levels] == [len(seen[k][lang]) for k in range(1, 5)]
        assert len(levels[3][0]) > 50_000
    for lang in model:                                     # the same as one language in memory
        words = [r.text for r in docs.filter(F.col("lang") == lang).collect()]
        grams = language_id.Grams(words)
        counts = np.bincount(grams.gram)
        for got, want in zip(model[lang], language_id.kneser_ney(
                language_id.characters(grams.a, grams.b), counts, language_id.slot(grams.a, grams.b)), strict=True):
            for x, y in zip(got, want, strict=True):
                assert np.allclose(x, y, rtol=1e-12) if x.dtype == float else (x == y).all()


def test_large_models_are_joined(spark, monkeypatch, edge_docs):
    for docs in (many_types(spark), spark.read.parquet(f"{SF}/documents.parquet"), edge_docs.drop("rank")):
        rows = {}
        for limit in (10**9, 0):
            monkeypatch.setattr(language_id, "BROADCAST_ENTRIES", limit)
            model = language_id.fit(docs)
            assert isinstance(model, language_id.Table) == (limit == 0)
            rows[limit] = sorted(language_id.identify(docs, model, ["doc_id"], language_id.calibrate(docs, model)).collect(), key=repr)
        assert len(rows[0]) == len(rows[10**9]) == docs.count()
        for x, y in zip(rows[0], rows[10**9]):
            assert (x.doc_id, x["__pred"], x["__chars"], x["__rejected"]) == (y.doc_id, y["__pred"], y["__chars"], y["__rejected"])
            assert x["__entropy"] == pytest.approx(y["__entropy"], nan_ok=True) and x["__score"] == pytest.approx(y["__score"])


def test_language_edges(spark, edge_docs, no_docs):
    rows = language_id.op9(edge_docs).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 5, 7)} == {"und"}
    assert {r.lang_pred for r in rows if r.doc_id not in (3, 4, 5, 7)} <= {"en", "de", "fr"}
    assert language_id.op9(no_docs).count() == 0
    kept = language_id.keep_identified(edge_docs)
    assert kept.columns == edge_docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, None, 6, 8}
    assert language_id.keep_identified(no_docs).count() == 0


def test_foreign_texts_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(10**9 + i, "zxqj wvkq jxzq qqxz vkjw zzqx " * 40, None, "s", 1) for i in range(3)], docs.schema)
    kept = language_id.keep_identified(docs.union(odd))
    assert kept.filter("doc_id >= 1000000000").isEmpty() and kept.count() >= 0.999 * docs.count()


def test_grams_of_every_place():
    g = language_id.Grams(["ab", "ç"], order=3)
    chars = language_id.characters(g.a, g.b, order=3)[g.gram]
    assert ["".join(map(chr, c)) for c in chars] == ["  a", " ab", "ab ", "  ç", " ç "]
    doc, word, vocab = language_id.words_of(pa.array(["Ab ç2ab", None, "9"]))
    assert [(d, vocab[w]) for d, w in zip(doc, word)] == [(0, "ab"), (0, "ç"), (0, "ab")]


# --- SentencePiece sampling

def segmentations(word, vocab, pieces):
    if not word:
        yield (), 0.0
    for i in range(1, len(word) + 1):
        if word[:i] in pieces:
            for rest, w in segmentations(word[i:], vocab, pieces):
                yield (pieces[word[:i]], *rest), w + vocab.weight[pieces[word[:i]]]


def drawn(texts, keys, vocab, k):
    out = collections.defaultdict(list)
    for of, _, ids, count, log_prob, value, best, _ in sentencepieces.sample(texts, np.array(keys, np.uint64), vocab, k):
        end, inclusion = np.cumsum(count), sentencepieces.log_inclusion(log_prob, best)
        for j, d in enumerate(of):
            out[int(d)].append((tuple(int(x) for x in ids[end[j] - count[j]:end[j]]), log_prob[j], value[j], inclusion[j]))
    return out


@pytest.fixture(scope="module")
def vocab():
    return sentencepieces.Vocabulary()


def test_samples_against_all_segmentations(vocab):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    pieces = {sp.id_to_piece(i): i for i in range(259, sp.vocab_size())}
    one, two = (list(segmentations(w, vocab, pieces)) for w in ("▁the", "▁cat"))
    every = {a + b: v + w for a, v in one for b, w in two}
    total = np.logaddexp.reduce(list(every.values()))
    prob = {s: math.exp(w - total) for s, w in every.items()}
    n, text = 8000, "the cat"
    out = drawn([text] * n, range(n), vocab, 3)
    for rows in out.values():
        assert len({r[0] for r in rows}) == 3
        assert all(r[1] == pytest.approx(math.log(prob[r[0]])) for r in rows)
        assert rows[0][2] >= rows[1][2] >= rows[2][2]
    first, second, chance = collections.Counter(), collections.Counter(), collections.defaultdict(float)
    for rows in out.values():
        first[rows[0][0]] += 1 / n
        second[rows[1][0]] += 1 / n
        for r in rows:
            chance[r[0]] += math.exp(-r[3]) / n
    for s, p in prob.items():
        want = sum(prob[q] * p / (1 - prob[q]) for q in prob if q != s)
        assert first[s] == pytest.approx(p, abs=0.02) and second[s] == pytest.approx(want, abs=0.025)
        if p > 0.02:
            assert chance[s] == pytest.approx(1, abs=0.1)      # a sample weighed by its inclusion score counts once
    # all of them, and no more, where k asks for more than there are
    few = drawn(["the"], [5], vocab, 50)[0]
    assert {r[0] for r in few} == {s for s, _ in one} and len(few) == len(one) and few[-1][3] == 0


def test_round_trip_and_seeds(spark, vocab, edge_docs, no_docs):
    texts = ["Hello  world\n\tx ▁y é漢\x00\U0001F600", " ", "a", "x" * 3000, "\n\n", "▁"]
    for d, rows in drawn(texts, range(len(texts)), vocab, 4).items():
        for ids, *_ in rows:
            assert b"".join(vocab.spelling[i] for i in ids)[1:].decode() == texts[d]
    encoded = sentencepieces.encode(edge_docs, sentencepieces.row_key(edge_docs))
    assert encoded.filter("text is not null").filter(~F.coalesce("__same", F.lit(False))).isEmpty()
    back = sentencepieces.decode(encoded)
    assert back.filter(~F.col("text").eqNullSafe(F.col("__decoded"))).isEmpty()
    assert [c for c in back.columns if not c.startswith("__")] == edge_docs.columns
    by_row = collections.defaultdict(set)
    for r in back.repartition(1).collect():
        by_row[(r.doc_id, r.text)].add((r["__rank"], tuple(r["__ids"] or ())))
    assert all(len({i for _, i in v}) == len(v) <= 2 for v in by_row.values())
    again = sentencepieces.encode(edge_docs.repartition(5), sentencepieces.row_key(edge_docs))
    assert {(r.doc_id, tuple(r["__ids"] or ())) for r in again.collect()} == {(r.doc_id, tuple(r["__ids"] or ())) for r in encoded.collect()}
    assert sentencepieces.op10(no_docs).count() == 0


def test_long_texts_in_stretches(vocab, monkeypatch):
    """Stretches give the samples that the whole text has, also where its beginning leaves no choice."""
    monkeypatch.setattr(sentencepieces, "HEAD_CHARS", 700)
    body = " ".join(f"word{i * i % 977}\n the ▁cat  sat é漢 on{i}" for i in range(300))
    for text in (body, "\x00 " * 2000 + "\n" + body, "\n" * 5000, "x" * 3000 + " " + body):
        for key in (3, 2**63 + 5):
            keys = np.array([key], np.uint64)
            whole = list(sentencepieces.sample([text], keys, vocab, 3))
            parts = list(sentencepieces.sample_long(text, keys, vocab, 3))
            assert len(whole) == len(parts) > 0
            for w, (rank, ids, log_prob, value, best) in zip(whole, parts, strict=True):
                assert w[1] == rank and (w[2] == ids).all() and w[5][0] == pytest.approx(value)
                assert w[4][0] == pytest.approx(log_prob) and w[6][0] == pytest.approx(best)


def test_memory_of_a_long_text(vocab):
    """Beyond the ids of one sample (twice, as they are put together) no more than a stretch is held."""
    text = " ".join(f"word{i * i % 7919} the" for i in range(50_000)) * 6
    key = np.array([1], np.uint64)
    tracemalloc.start()
    ids = 0
    for _, one, *_ in sentencepieces.sample_long(text, key, vocab, 2):
        ids = max(ids, one.nbytes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * ids + 25e6, (peak, ids, len(text))
