"""Language identification by interpolated Kneser-Ney character models.

A model per language is learned from the letter runs (words, lower-cased) of
all training texts.  Counts of character n-grams are taken in every task and
summed by Spark under the whole n-gram; Spark also derives the lower orders and
the probabilities, so every n-gram counts at every order.  A text gets the
language with the lowest cross-entropy per character, and is rejected when
that cross-entropy lies beyond what the language's own training texts show.

A model has an entry per n-gram (its discounted probability) and one per
context (the weight of the next lower order).  Up to ``BROADCAST_ENTRIES``
of all languages together, which are counted, they are broadcast as sorted
hash arrays; a larger model stays a table, and the distinct n-grams of the
texts are joined with it (:class:`Table`).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labeldist.llm.common import MAX_BROADCAST_ROWS, column_or_null, crc_mod, mixed, row_ids, slices, stored, text_batches
from labeldist.session import cut_lineage

ORDER = 4          # characters of an n-gram, at most 6
BROADCAST_ENTRIES = 4_000_000   # of 16 bytes
BATCH_BYTES = 1_500_000   # texts are worked on in slices of about so many bytes
FLUSH_TYPES = 300_000     # a task hands on its partial counts beyond so many n-grams
UND = "und"
SHARPNESS = 20.0   # characters that the score (a softmax of the cross-entropies) stands for
FALSE_REJECTS = 1e-4      # share of training texts beyond the calibrated threshold ...
MARGIN = 1.5              # ... which is widened by this factor
ROUNDING = 1e-9           # sums differ by less when they are taken in another order

_BITS = np.uint64(21)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Lower-cased letter runs: document index and word index of each, and the distinct words."""
    runs = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"\P{L}+")
    doc = pc.list_parent_indices(runs).to_numpy()
    flat = runs.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    words = flat.filter(full).dictionary_encode()
    return doc[full.to_numpy(zero_copy_only=False)], words.indices.to_numpy(zero_copy_only=False), words.dictionary.to_pylist()


class Grams:
    """The n-grams of distinct words: which word each place is in, and the distinct n-grams as packed characters."""

    def __init__(self, words: list[str], order: int = ORDER):
        gap = " " * order
        chars = np.frombuffer((gap + gap.join(words) + gap).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        letter = chars != 32
        at = np.flatnonzero(letter | np.concatenate([[False], letter[:-1]]))  # letters, and the end of each word
        ended = np.concatenate([[0], np.cumsum(~letter[at])])[:-1]
        self.word = ended
        packed = [np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)]
        for j in range(order):
            half = packed[j >= 3]
            half[:] = (half << _BITS) | chars[at - (order - 1 - j)]
        code = pd.factorize(mixed(packed[0], packed[1]))[0]
        first = np.full(code.max() + 1 if len(code) else 0, 0)
        first[code[::-1]] = np.arange(len(code))[::-1]
        self.gram, self.a, self.b = code, packed[0][first], packed[1][first]


def characters(a: np.ndarray, b: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Packed n-grams as a matrix with one column per character."""
    head, tail = min(order, 3), max(order - 3, 0)
    mask = np.uint64(2**21 - 1)
    columns = [(x >> (_BITS * np.uint64(n - 1 - j))) & mask for x, n in ((a, head), (b, tail)) for j in range(n)]
    return np.stack(columns, axis=1) if columns else np.zeros((len(a), 0), np.uint64)


def suffix_hash(chars: np.ndarray, order: int) -> np.ndarray:
    """Hash of the last ``order`` columns."""
    h = np.full(len(chars), order + 1, np.uint64)
    for j in range(chars.shape[1] - order, chars.shape[1]):
        h = mixed(h, chars[:, j])
    return h


def slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Key of n-grams of the highest order."""
    return mixed(a, b)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pd.DataFrame] = []

    def out(frames: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(frames).groupby(["__lang", "__a", "__b"], as_index=False, sort=False)["__n"].sum()

    def handed_on(counts: pd.DataFrame) -> pa.RecordBatch:
        return pa.RecordBatch.from_pandas(counts, preserve_index=False)

    for batch in batches:
        for part in slices(batch, "__text", BATCH_BYTES):
            doc, word, words = words_of(part.column("__text"))
            if not words:
                continue
            grams = Grams(words)
            lang = part.column("__lang").dictionary_encode()
            of = lang.indices.to_numpy(zero_copy_only=False)[doc]
            for k, name in enumerate(lang.dictionary.to_pylist()):
                n_word = np.bincount(word[of == k], minlength=len(words))
                n = np.bincount(grams.gram, weights=n_word[grams.word], minlength=len(grams.a)).astype(np.int64)
                seen = n > 0
                held.append(pd.DataFrame({"__lang": name, "__a": grams.a[seen].view(np.int64),
                                          "__b": grams.b[seen].view(np.int64), "__n": n[seen]}))
            if sum(map(len, held)) > FLUSH_TYPES:
                held = [out(held)]
                if len(held[0]) > FLUSH_TYPES // 2:
                    yield handed_on(held.pop())
    if held:
        yield handed_on(out(held))


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the sum of the values of each, and each row's place among the keys."""
    u, at = np.unique(keys, return_inverse=True)
    return u, np.bincount(at, weights=values, minlength=len(u)), at


def kneser_ney(chars: np.ndarray, counts: np.ndarray, top: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """One language in memory, which :func:`fit` does by aggregation.

    Levels 1 .. order: sorted n-gram keys, discounted probabilities, sorted context keys, their weights for the level below.

    ``chars``: the distinct highest-order n-grams; ``top``: their keys.  The
    highest order uses counts, every other the number of distinct n-grams of
    the next order that end in the n-gram."""
    order, levels = chars.shape[1], []
    for k in range(order, 0, -1):
        keys = top if k == order else suffix_hash(chars, k)
        context = suffix_hash(chars[:, :-1], k - 1)
        if k == order:
            grams, n, rows = keys, counts.astype(float), np.arange(len(keys))
        else:
            _, types = np.unique(suffix_hash(chars, k + 1), return_index=True)
            grams, n, _ = _sum_by(keys[types], np.ones(len(types)))
            rows = np.unique(keys, return_index=True)[1]
        ones, twos = (n == 1).sum(), (n == 2).sum()
        d = ones / (ones + 2 * twos) if ones else 0.5
        contexts, total, at = _sum_by(context[rows], n)
        types_after = np.bincount(at, minlength=len(contexts))
        d = min(d, 0.99)
        sort = np.argsort(grams, kind="stable")
        levels.append((grams[sort], (np.maximum(n - d, 0) / total[at])[sort], contexts, d * types_after / total))
    return levels[::-1]


Model = dict[str, list[tuple[np.ndarray, ...]]]


class Table(NamedTuple):
    """A model that is not broadcast: entries ``__lang, __level, __kind`` (gram or context), ``__a, __b`` and ``__value``."""

    names: list[str]
    entries: DataFrame
    alphabet: int


def _without_first(a: Column, b: Column, order: int) -> tuple[Column, Column]:
    """Packed n-grams of ``order`` characters without their first."""
    tail = max(order - 3, 0)
    if not tail:
        return a.bitwiseAND(F.lit(2 ** (21 * (order - 1)) - 1)), F.lit(0).cast("long")
    moved = F.shiftleft(a, 21).bitwiseAND(F.lit(2**63 - 1)).bitwiseOR(F.shiftright(b, 21 * (tail - 1)))
    return moved, b.bitwiseAND(F.lit(2 ** (21 * (tail - 1)) - 1))


def _without_last(a: Column, b: Column, order: int) -> tuple[Column, Column]:
    return (a, F.shiftright(b, 21)) if order > 3 else (F.shiftright(a, 21), F.lit(0).cast("long"))


def _entries(types: DataFrame) -> DataFrame:
    """The entries of all levels, from the distinct n-grams of the highest order (``__lang, __a, __b, __n``).

    As in :func:`kneser_ney`: the highest order uses counts, every other the number of distinct n-grams that end in the n-gram."""
    out, key, context = None, ["__a", "__b"], ["__lang", "__ca", "__cb"]
    a, b = F.col("__a"), F.col("__b")
    for k in range(ORDER, 0, -1):
        ca, cb = _without_last(a, b, k)
        grams = types.withColumn("__ca", ca).withColumn("__cb", cb)
        ones, twos = F.count_if(F.col("__n") == 1), F.count_if(F.col("__n") == 2)
        d = types.groupBy("__lang").agg(F.least(F.when(ones > 0, ones / (ones + 2 * twos)).otherwise(0.5), F.lit(0.99)).alias("__d"))
        contexts = stored(grams.groupBy(*context).agg(F.sum("__n").alias("__total"), F.count(F.lit(1)).alias("__types")).join(
            d, "__lang"), "contexts")
        probs = grams.join(contexts, context).select(
            "__lang", F.lit(k).alias("__level"), F.lit("gram").alias("__kind"), *key,
            (F.greatest(F.col("__n") - F.col("__d"), F.lit(0.0)) / F.col("__total")).alias("__value"))
        weights = contexts.select(
            "__lang", F.lit(k).alias("__level"), F.lit("context").alias("__kind"), F.col("__ca").alias("__a"),
            F.col("__cb").alias("__b"), (F.col("__d") * F.col("__types") / F.col("__total")).alias("__value"))
        out = probs.union(weights) if out is None else out.union(probs).union(weights)
        if k > 1:
            sa, sb = _without_first(a, b, k)
            types = stored(types.select("__lang", sa.alias("__a"), sb.alias("__b")).groupBy("__lang", *key).agg(
                F.count(F.lit(1)).alias("__n")), "grams")
    return out


def _arrays(rows: pd.DataFrame) -> pd.DataFrame:
    """One level of one language as sorted hash arrays."""
    k, out = int(rows["__level"].iloc[0]), {"lang": rows["__lang"].iloc[0], "level": int(rows["__level"].iloc[0])}
    for kind, order in (("gram", k), ("context", k - 1)):
        of = rows[rows["__kind"] == kind]
        a, b = (of[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("__a", "__b"))
        keys = slot(a, b) if order == ORDER else suffix_hash(characters(a, b, order), order)
        sort = np.argsort(keys, kind="stable")
        out |= {f"{kind}s": keys[sort].astype("<u8").tobytes(), f"{kind}_values": of["__value"].to_numpy()[sort].astype("<f8").tobytes()}
    return pd.DataFrame([out])


def fit(docs: DataFrame) -> Model | Table:
    """Learn a model of each language of ``docs`` (columns ``text`` and ``lang``; rows with a null in either are left out)."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col("text").alias("__text"), F.col("lang").alias("__lang")).dropna()
    counts = rows.mapInArrow(_count_grams, "__lang string, __a long, __b long, __n long")
    types = stored(counts.groupBy("__lang", "__a", "__b").agg(F.sum("__n").alias("__n")), "types")
    entries = stored(_entries(types), "model")
    if entries.count() > BROADCAST_ENTRIES:
        letters = entries.filter("__level = 1 AND __kind = 'gram'").groupBy("__lang").count().collect()
        return Table(sorted(r["__lang"] for r in letters), entries, max(r["count"] for r in letters) + 1)
    models = entries.groupBy("__lang", "__level").applyInPandas(
        _arrays, "lang string, level int, grams binary, gram_values binary, contexts binary, context_values binary")
    out: Model = {}
    for r in sorted(models.collect(), key=lambda r: (r.lang, r.level)):
        out.setdefault(r.lang, []).append(tuple(np.frombuffer(x, dtype=k) for x, k in (
            (r.grams, "<u8"), (r.gram_values, "<f8"), (r.contexts, "<u8"), (r.context_values, "<f8"))))
    return out


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def log_probabilities(model: Model, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log probability of the last character of each n-gram, one column per language."""
    chars = characters(a, b)
    order = chars.shape[1]
    keys = [slot(a, b) if k == order else suffix_hash(chars, k) for k in range(1, order + 1)]
    contexts = [suffix_hash(chars[:, :-1], k - 1) for k in range(1, order + 1)]
    alphabet = max((len(levels[0][0]) for levels in model.values()), default=0) + 1
    out = np.empty((len(a), len(model)))
    for j, levels in enumerate(model.values()):
        p = np.full(len(a), 1.0 / alphabet)
        for (grams, probs, known, weights), key, context in zip(levels, keys, contexts, strict=True):
            p = _look_up(grams, probs, key, 0.0) + _look_up(known, weights, context, 1.0) * p
        out[:, j] = np.log(np.maximum(p, 1e-12))
    return out


def cross_entropies(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per character (a row per text, a column per language), and the number of characters."""
    doc, word, words = words_of(texts)
    n_docs = len(texts)
    if not words or not model:
        return np.zeros((n_docs, len(model))), np.zeros(n_docs) if not words else np.bincount(doc, minlength=n_docs)
    grams = Grams(words)
    of_gram = log_probabilities(model, grams.a, grams.b)
    length = np.bincount(grams.word, minlength=len(words))[word]
    n = np.bincount(doc, weights=length, minlength=n_docs)
    h = np.empty((n_docs, len(model)))
    for j in range(len(model)):
        of_word = np.bincount(grams.word, weights=of_gram[grams.gram, j], minlength=len(words))
        h[:, j] = -np.bincount(doc, weights=of_word[word], minlength=n_docs) / np.maximum(n, 1)
    return h, n


def _text_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct n-grams of each text and how often it has them."""
    for batch in batches:
        for part in slices(batch, "__text", BATCH_BYTES):
            doc, word, words = words_of(part.column("__text"))
            if not words:
                continue
            grams = Grams(words)
            length = np.bincount(grams.word, minlength=len(words))
            start = np.concatenate([[0], np.cumsum(length)])[word]
            places = np.repeat(start - np.concatenate([[0], np.cumsum(length[word])])[:-1], length[word]) + np.arange(length[word].sum())
            pairs, n = np.unique(np.repeat(doc, length[word]) * len(grams.a) + grams.gram[places], return_counts=True)
            of, gram = pairs // len(grams.a), pairs % len(grams.a)
            yield pa.RecordBatch.from_arrays(
                [part.column("__rid").take(pa.array(of)), pa.array(grams.a[gram].view(np.int64)),
                 pa.array(grams.b[gram].view(np.int64)), pa.array(n.astype(np.int64))], names=["__rid", "__a", "__b", "__n"])


def _table_probabilities(model: Table, grams: DataFrame) -> DataFrame:
    """``__a, __b, __logs`` of distinct n-grams (as :func:`log_probabilities`), joined with the entries level by level."""
    suffix = {ORDER: (F.col("__a"), F.col("__b"))}
    for k in range(ORDER, 1, -1):
        suffix[k - 1] = _without_first(*suffix[k], k)
    out = grams.withColumn("__p", F.array_repeat(F.lit(1.0 / model.alphabet), len(model.names)))
    for k in range(1, ORDER + 1):
        for kind, missing, (a, b) in (("context", 1.0, _without_last(*suffix[k], k)), ("gram", 0.0, suffix[k])):
            values = stored(model.entries.filter((F.col("__level") == k) & (F.col("__kind") == kind)).groupBy(
                F.col("__a").alias("__ka"), F.col("__b").alias("__kb")).agg(F.array(*[
                    F.coalesce(F.max(F.when(F.col("__lang") == x, F.col("__value"))), F.lit(missing)) for x in model.names]).alias("__v")), "values")
            few = values.count() * len(model.names) <= MAX_BROADCAST_ROWS
            fold = (lambda p, v: p * v) if kind == "context" else (lambda p, v: p + v)
            met = out.withColumn("__ka", a).withColumn("__kb", b).join(F.broadcast(values) if few else values, ["__ka", "__kb"], "left")
            out = met.select("__a", "__b", F.zip_with("__p", F.coalesce(
                "__v", F.array_repeat(F.lit(missing), len(model.names))), fold).alias("__p"))
    return out.select("__a", "__b", F.transform("__p", lambda p: F.log(F.greatest(p, F.lit(1e-12)))).alias("__logs"))


def _with_sums(rows: DataFrame, model: Table) -> DataFrame:
    """``rows`` with ``__n`` characters and the cross-entropies ``__h``."""
    rows = stored(row_ids(rows), "texts")
    grams = stored(rows.select("__rid", "__text").mapInArrow(_text_grams, "__rid long, __a long, __b long, __n long"), "text-grams")
    logs = _table_probabilities(model, grams.select("__a", "__b").distinct())
    sums = grams.join(logs, ["__a", "__b"]).groupBy("__rid").agg(F.sum("__n").alias("__n"), F.array(*[
        -F.sum(F.col("__n") * F.col("__logs")[j]) / F.sum("__n") for j in range(len(model.names))]).alias("__h"))
    return rows.join(sums, "__rid", "left").withColumn("__n", F.coalesce("__n", F.lit(0))).withColumn(
        "__h", F.coalesce("__h", F.array_repeat(F.lit(0.0), len(model.names))))


def identify(docs: DataFrame, model: Model | Table, keep: list[str] | None = None, limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (default: all) plus ``__pred, __score, __entropy, __chars, __rejected``.

    Null texts, texts without a letter and all texts if there is no model are
    ``und`` with score 0.  Ties go to the language that sorts first.
    ``limits`` (see :func:`calibrate`): texts beyond them are marked as
    rejected, as are those that are ``und``; without it only the latter.
    Texts are whole, however long; repeated rows get the same result each; an empty table gives an empty result; input
    columns of any other name pass through.
    """
    keep = docs.columns if keep is None else keep
    spark = docs.sparkSession
    text_batches(spark)
    joined = isinstance(model, Table)
    shipped = spark.sparkContext.broadcast((model.names if joined else model, limits))
    fields = [docs.schema[c] for c in keep] + [
        T.StructField("__pred", T.StringType()), T.StructField("__score", T.DoubleType()),
        T.StructField("__entropy", T.DoubleType()), T.StructField("__chars", T.LongType()),
        T.StructField("__rejected", T.BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bounds = shipped.value
        names = np.array([*own, UND], dtype=object)
        for batch in batches:
            for part in slices(batch, "__text", BATCH_BYTES):
                if joined:
                    n = part.column("__n").to_numpy()
                    h = part.column("__h").flatten().to_numpy().reshape(len(n), len(own))
                else:
                    h, n = cross_entropies(own, part.column("__text"))
                found = (n > 0) & (len(own) > 0)
                best = np.where(found, h.argmin(axis=1), len(own)) if len(own) else np.zeros(len(n), int)
                low = h.min(axis=1) if len(own) else np.zeros(len(n))
                score = np.where(found, 1 / np.maximum(np.exp(-SHARPNESS * (h - low[:, None])).sum(axis=1), 1), 0.0)
                rejected = ~found
                if bounds is not None and len(own):
                    mean, most = (np.array([bounds.get(x, (0.0, np.inf))[i] for x in own] + [0.0]) for i in (0, 1))
                    rejected = rejected | ((low - mean[best]) * np.sqrt(n) > most[best] + ROUNDING)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], pa.array(names[best], pa.string()), pa.array(score),
                     pa.array(np.where(found, low, np.nan)), pa.array(n.astype(np.int64)), pa.array(rejected)],
                    names=[f.name for f in fields])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], column_or_null(docs, "text", "string").alias("__text"))
    return (_with_sums(rows, model) if joined else rows).mapInArrow(run, T.StructType(fields))


def calibrate(docs: DataFrame, model: Model | Table) -> dict[str, tuple[float, float]]:
    """Per language its mean cross-entropy, and how far above it (times the root of the length) a text may lie.

    Learned from all texts of ``docs`` that carry the language: the quantile
    that ``FALSE_REJECTS`` of them exceed, widened by ``MARGIN``."""
    own = cut_lineage(identify(docs.select("text", "lang").dropna(), model, ["lang"]).filter(
        (F.col("__pred") == F.col("lang")) & (F.col("__chars") > 0)))
    mean = own.groupBy("lang").agg((F.sum(F.col("__entropy") * F.col("__chars")) / F.sum("__chars")).alias("m")).collect()
    means = {r.lang: r.m for r in mean}
    if not means:
        return {}
    table = F.create_map(*[F.lit(x) for kv in means.items() for x in kv])
    far = (F.col("__entropy") - F.element_at(table, F.col("lang"))) * F.sqrt("__chars")
    most = own.groupBy("lang").agg(F.percentile_approx(far, 1 - FALSE_REJECTS, 20_000).alias("q"))
    return {r.lang: (means[r.lang], max(r.q, 0.0) * MARGIN) for r in most.collect()}


def op9(docs: DataFrame) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = fit(docs.filter(~held_out))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return identify(rows, model, ["doc_id", "held_out"]).select(
        "doc_id", "held_out", F.col("__pred").alias("lang_pred"), F.col("__score").alias("score"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is recognised (trained and calibrated on the documents that name theirs)."""
    if not {"text", "lang"} <= set(docs.columns):
        raise ValueError("language ID learns from the columns text and lang")
    model = fit(docs)
    return identify(docs, model, limits=calibrate(docs, model)).filter("NOT __rejected").select(
        *[F.col(f"`{c}`") for c in docs.columns])
