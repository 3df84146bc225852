"""Katz backoff language model.

Training n-grams have Good-Turing discounted counts; what the discounts free
in a context goes to the words not seen there, in proportion to the next lower
order, with a weight that makes every context's probabilities sum to one.  A
token's probability is found recursively: its n-gram if that was seen, else
the context's weight times the probability of the shorter n-gram.

The corpus is encoded once, as chunks of texts (token numbers and the hashes of
the chunk's words), in a table bucketed by chunk.  The model's tables (words,
n-grams, contexts) are partitioned by hash range.  For each of them a chunk
sends its distinct keys with what it knows of them to their ranges, one task
per range adds up, and the sums return to the chunks in the order of their
keys, so a frequent n-gram is one row per chunk wherever it occurs.  With the
sums of all orders a chunk evaluates all of its tokens.

Words and n-grams are known by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labeldist.llm.common import GAP, column_or_null, crc_mod, mixed, slices, stored, text_batches, text_bytes
from labeldist.session import scratch_path

CHUNK_BYTES = 8_000_000
SLICE_BYTES = 2_000_000    # texts are split into words in slices of about so many bytes
MAX_BUCKETS = 50_000       # a table has at most so many buckets; beyond, a bucket holds several chunks
DISCOUNTED = 5             # counts up to this are discounted
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
CHUNKS = "chunk long, ids array<long>, train array<boolean>, ends array<int>, tokens binary, words binary"
PARCEL = "chunk long, range int, keys binary, counts binary, sums binary"
REPLY = "chunk long, range int, counts binary, sums binary, stats array<long>"


# --- the encoded corpus

def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of consecutive texts of a task."""
    number = TaskContext.get().partitionId() << 24
    held: list[tuple] = []
    size = 0

    def chunk() -> pa.RecordBatch:
        nonlocal number, size
        words, code = np.unique(np.concatenate([h for *_, h, _ in held]), return_inverse=True)
        tokens = np.split(code, np.cumsum([len(h) for *_, h, _ in held])[:-1])
        flat = np.concatenate([t[c] for t, (*_, c) in zip(tokens, held, strict=True)]).astype(np.int32)
        ends = np.cumsum(np.concatenate([n for _, _, n, _, _ in held])).astype(np.int32)
        row = pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([[x for ids, *_ in held for x in ids.to_pylist()]], pa.list_(pa.int64())),
             pa.array([[x for _, t, *_ in held for x in t.to_pylist()]], pa.list_(pa.bool_())), pa.array([ends], pa.list_(pa.int32())),
             pa.array([flat.tobytes()], pa.binary()), pa.array([words.tobytes()], pa.binary())],
            names=[c.split()[0] for c in CHUNKS.split(", ")])
        held.clear()
        number, size = number + 1, 0
        return row

    for batch in batches:
        for part in slices(batch, "__text", SLICE_BYTES):
            words = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(part.column("__text"), "")), GAP)
            flat = words.flatten()
            full = pc.greater(pc.binary_length(flat), 0)
            doc = pc.list_parent_indices(words).to_numpy()[full.to_numpy(zero_copy_only=False)]
            coded = flat.filter(full).dictionary_encode()
            names = coded.dictionary.to_numpy(zero_copy_only=False).astype(object)
            hashes = np.append(pd.util.hash_array(names, categorize=False) if len(names) else np.zeros(0, np.uint64), END)
            n = np.bincount(doc, minlength=part.num_rows) + 1   # and the end
            code = np.full(int(n.sum()), len(names), np.int64)
            is_word = np.ones(len(code), bool)
            is_word[np.cumsum(n) - 1] = False
            code[is_word] = coded.indices.to_numpy(zero_copy_only=False)
            held.append((part.column("__id"), part.column("__train"), n, hashes, code))
            size += part.nbytes
            if size >= CHUNK_BYTES:
                yield chunk()
    if held:
        yield chunk()


class Chunk:
    """The distinct n-grams of a chunk, by order: sorted keys, and for each its context, its shorter n-gram and its training count."""

    def __init__(self, row: pd.Series, order: int):
        words = np.frombuffer(row["words"], np.uint64)
        self.code = np.frombuffer(row["tokens"], np.int32)
        self.ids, self.train, self.ends = list(row["ids"]), np.asarray(row["train"], bool), np.asarray(row["ends"], np.int64)
        n = np.diff(self.ends, prepend=0)
        self.doc = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(self.code)) - np.repeat(self.ends - n, n)
        taught = self.train[self.doc].astype(float)
        token = words[self.code]
        keys, before = token, None
        self.keys, self.of, self.count, self.context, self.contexts, self.shorter, self.at = [], [], [], [], [], [], []
        for m in range(1, order + 1):
            at = np.flatnonzero(place >= m - 2)
            if m == 1:
                k, of = words, self.code.astype(np.int64)
            else:
                # hash of the tokens before, of which the first may be the start of the text
                context = np.full(len(at), m, np.uint64)
                for j in range(m - 1, 0, -1):
                    context = mixed(context, np.where(place[at] >= j, token[at - j], START))
                keys = mixed(context, token[at])
                k, first, of = np.unique(keys, return_index=True, return_inverse=True)
                contexts, context = np.unique(context[first], return_inverse=True)
                self.contexts.append(contexts)
                self.context.append(context)
                self.shorter.append(before[at[first]])
            self.keys.append(k)
            self.of.append(of)
            self.at.append(at)
            self.count.append(np.bincount(of, weights=taught[at], minlength=len(k)).astype(np.int64))
            before = np.full(len(token), -1)
            before[at] = of


# --- parcels: keys to their ranges and sums back

def _bounds(ranges: int) -> np.ndarray:
    return np.array([(i << 64) // ranges for i in range(1, ranges)], dtype=np.uint64)


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences of six bytes each if these suffice, else as they are."""
    step = np.diff(keys)
    if len(keys) and (not len(step) or int(step.max()) < 1 << 48):
        return keys[:1].tobytes() + np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
    return b"\0" + keys.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if len(data) % 2:   # as they are, after one byte
        return np.frombuffer(data, np.uint64, offset=1)
    step = np.zeros(((len(data) - 8) // 6, 8), np.uint8)
    step[:, :6] = np.frombuffer(data, np.uint8, offset=8).reshape(-1, 6)
    return np.cumsum(np.concatenate([np.frombuffer(data, np.uint64, 1), step.view(np.uint64).ravel()]), dtype=np.uint64)


def _pack_counts(x: np.ndarray) -> bytes:
    """Counts in the narrowest width that holds them, which comes first."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << 8 * w)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _counts(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


def _parcels(chunk: int, keys: np.ndarray, counts: np.ndarray, sums: np.ndarray, ranges: int) -> pd.DataFrame:
    """``keys`` sorted; ``sums``: a column per sum."""
    cut = np.concatenate([[0], np.searchsorted(keys, _bounds(ranges)), [len(keys)]])
    rows = [(chunk, r, _pack(keys[a:b]), _pack_counts(counts[a:b].astype(np.int64)), sums[a:b].tobytes())
            for r, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PARCEL.split(", ")])


def _add_up(kind: str, order_stats: int = DISCOUNTED + 1):
    """Sums of a range of keys, handed back to every chunk that sent some.

    ``grams``: total counts; the first chunk that sent a key owns it (its sum is 1).  ``contexts``: log weight of the
    lower order, and total counts (scaled if no mass was free)."""
    def run(parcels: pd.DataFrame) -> pd.DataFrame:
        keys = [_unpack(x) for x in parcels["keys"]]
        n = np.array([len(k) for k in keys])
        u, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([_counts(x) for x in parcels["counts"]]), minlength=len(u))
        stats = [0] * (order_stats + 2)
        if kind == "grams":
            sums = np.zeros(len(at), np.uint8)
            sums[first] = 1
            own = np.bincount(np.minimum(counts, order_stats + 1).astype(np.int64), minlength=order_stats + 2)
            stats = [*own[1:order_stats + 1], int((counts > 0).sum()), int(counts.sum())]
            back_counts, back = counts[at].astype(np.int64), sums   # a bit each
        else:
            both = np.concatenate([np.frombuffer(x, np.float64).reshape(-1, 2) for x in parcels["sums"]])
            kept, lower = (np.bincount(at, weights=both[:, i], minlength=len(u)) for i in (0, 1))
            total = counts.copy()
            none = (counts > 0) & (counts - kept < 1e-9 * counts)   # nothing was discounted: one count more makes room
            total[none] += 1
            with np.errstate(divide="ignore", invalid="ignore"):
                weight = np.log((1 - kept / total) / np.maximum(1 - lower, 1e-300))
            weight[counts == 0] = 0.0
            back_counts, back = total[at].astype(np.int64), weight[at]
        cut = np.cumsum(n)[:-1]
        return pd.DataFrame({
            "chunk": parcels["chunk"], "range": parcels["range"],
            "counts": [_pack_counts(x) for x in np.split(back_counts, cut)],
            "sums": [(np.packbits(x) if kind == "grams" else x).tobytes() for x in np.split(back, cut)],
            "stats": [stats] + [[]] * (len(n) - 1)})
    return run


# --- the model

@dataclass
class Discounts:
    """Good-Turing discounts of an order: a factor for each count from 0, and the sum of what is kept of all counts."""
    factors: np.ndarray
    types: int
    tokens: int
    total: float

    @staticmethod
    def of(stats: list[int]) -> Discounts:
        n, (types, tokens) = [0, *stats[:DISCOUNTED + 1]], stats[-2:]
        factors = np.ones(DISCOUNTED + 2)
        if n[1]:
            common = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1]
            for r in range(1, DISCOUNTED + 1):
                if n[r] and common < 1:
                    d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
                    factors[r] = d if 0 < d < 1 else 1.0   # counts of counts that are out of order discount nothing
        return Discounts(factors, types, tokens, tokens - sum(n[r] * r * (1 - factors[r]) for r in range(1, DISCOUNTED + 1)))

    def kept(self, counts: np.ndarray) -> np.ndarray:
        return counts * self.factors[np.minimum(counts, DISCOUNTED + 1)]

    def words(self, counts: np.ndarray) -> np.ndarray:
        """Log probabilities of words by their counts; the unknown word has what the discounts free, or one count."""
        if not self.tokens:
            return np.zeros(len(counts))
        room = 0 if self.total < self.tokens - 1e-9 * self.tokens else 1
        with np.errstate(divide="ignore"):
            known = np.log(self.kept(counts)) - np.log(self.tokens + room)
        return np.where(counts > 0, known, np.log(1 - self.total / (self.tokens + room)))


def _evaluate(chunk: Chunk, replies: dict, model: list[Discounts], order: int) -> list[np.ndarray]:
    """Log probabilities of the chunk's n-grams, by order, as far as the replies go."""
    out = [model[0].words(replies[1, "grams"][0])]
    for m in range(2, order + 1):
        if (m, "contexts") not in replies:
            break
        counts = replies[m, "grams"][0].astype(np.int64)
        total, weight = replies[m, "contexts"]
        context = chunk.context[m - 2]
        lower = out[-1][chunk.shorter[m - 2]]
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = np.log(model[m - 1].kept(counts)) - np.log(total[context].astype(float))
        out.append(np.where(counts > 0, seen, weight[context] + lower))
    return out


def _replies(row: pd.Series, rounds: list[tuple[int, str]]) -> dict:
    out = {}
    for m, kind in rounds:
        parts = sorted(row[f"r{m}{kind}"], key=lambda x: x["range"])   # ranges in order are the chunk's keys in order
        counts = [_counts(x["counts"]) for x in parts]
        sums = [np.unpackbits(np.frombuffer(x["sums"], np.uint8), count=len(c)) if kind == "grams" else np.frombuffer(x["sums"], np.float64)
                for x, c in zip(parts, counts, strict=True)]
        out[m, kind] = np.concatenate(counts), np.concatenate(sums)
    return out


def _ask(m: int, kind: str, rounds: list, model: list[Discounts], ranges: int):
    """What each chunk sends in a round."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in rows.iterrows():
            chunk = Chunk(row, m)
            if kind == "grams":
                out.append(_parcels(row["chunk"], chunk.keys[m - 1], chunk.count[m - 1], np.zeros((len(chunk.keys[m - 1]), 0)), ranges))
                continue
            replies = _replies(row, rounds)
            counts, own = replies[m, "grams"]
            lower = np.exp(_evaluate(chunk, replies, model, m - 1)[m - 2][chunk.shorter[m - 2]])
            mine = (own > 0) & (counts > 0)   # every n-gram adds to its context once, by its owner
            context, keys = chunk.context[m - 2][mine], chunk.contexts[m - 2]
            add = lambda w: np.bincount(context, weights=w, minlength=len(keys))  # noqa: E731, B023
            c = counts[mine].astype(np.int64)
            out.append(_parcels(row["chunk"], keys, add(c.astype(float)), np.stack([add(model[m - 1].kept(c)), add(lower[mine])], axis=1), ranges))
        return pd.concat(out)
    return run


SCORES = "id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def _score(order: int, rounds: list, model: list[Discounts]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        d = model[0]
        for _, row in rows.iterrows():
            chunk, replies = Chunk(row, order), _replies(row, rounds)
            grams = _evaluate(chunk, replies, model, order)
            log_p = np.empty(len(chunk.code))
            for m in range(1, order + 1):   # the longest n-gram that the text's start leaves
                log_p[chunk.at[m - 1]] = grams[m - 1][chunk.of[m - 1]]
            counts = replies[1, "grams"][0][chunk.code].astype(float)
            base = np.log10((counts + 1) / (d.tokens + 1.0 * (d.types + 1)))
            n = len(chunk.ids)
            total = lambda w: np.bincount(chunk.doc, weights=w, minlength=n)  # noqa: E731, B023
            out.append(pd.DataFrame({
                "id": pd.array(chunk.ids, "Int64"), "train": chunk.train, "n_tokens": np.diff(chunk.ends, prepend=0),
                "n_known": total(counts > 0).astype(np.int64), "base_score": total(base), "score": total(log_p) / np.log(10)}))
        return pd.concat(out)
    return run


def score(docs: DataFrame, train: Column, order: int = 2) -> DataFrame:
    """``id, train, n_tokens, n_known, train_tokens, base_score, score`` of every row, by a model of the rows where ``train``.

    Tokens: words (A-Z lower-cased) and one end per text; a null text is empty.
    ``base_score`` is the add-one unigram score.  Without any training row all
    tokens are the unknown word (score 0).  Repeated rows are texts of their own, and each counts; texts are whole, a
    longer one than ``CHUNK_BYTES`` is a chunk by itself; an empty table gives an empty result; columns other than
    ``doc_id`` and ``text`` play no part, whatever their names.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(column_or_null(docs, "doc_id", "long").alias("__id"), F.coalesce(train, F.lit(False)).alias("__train"),
                       column_or_null(docs, "text", "string").alias("__text"))
    ranges = max(text_bytes(rows, "__text") // CHUNK_BYTES + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"katz_chunks_{uuid.uuid4().hex[:12]}"
    rows.mapInArrow(_encode, CHUNKS).write.bucketBy(min(ranges, MAX_BUCKETS), "chunk").format("parquet").option("compression", "zstd").option(
        "path", scratch_path(spark, "chunks")).saveAsTable(name)
    corpus = spark.table(name)
    spark.sql(f"DROP TABLE {name}")     # the frame reads the files, which stay
    replies: dict[tuple[int, str], DataFrame] = {}
    model: list[Discounts] = []

    def with_replies() -> DataFrame:
        out = corpus
        for (m, kind), reply in replies.items():
            packed = reply.groupBy("chunk").agg(F.collect_list(F.struct("range", "counts", "sums")).alias(f"r{m}{kind}"))
            out = out.join(packed, "chunk", "left")
        return out

    for m in range(1, order + 1):
        for kind in ("grams", "contexts") if m > 1 else ("grams",):
            sent = with_replies().groupBy("chunk").applyInPandas(_ask(m, kind, list(replies), list(model), ranges), PARCEL)
            reply = stored(sent.groupBy("range").applyInPandas(_add_up(kind), REPLY), "reply")
            replies[m, kind] = reply.drop("stats")
            if kind == "grams":
                stats = reply.select(F.posexplode("stats").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
                model.append(Discounts.of([v for _, v in sorted((r.k, r.v) for r in stats)] or [0] * (DISCOUNTED + 3)))
    out = with_replies().groupBy("chunk").applyInPandas(_score(order, list(replies), list(model)), SCORES)
    return out.withColumn("train_tokens", F.lit(model[0].tokens).cast("long"))


def op2(docs: DataFrame) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 7) == 2
    return score(docs, ~held_out).select(
        F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
