"""Self-join of texts by the Jaccard similarity of their word n-grams.

All n-grams (tokens) have one order: rare ones before frequent ones, by hash
within a class.  Two sets that reach the similarity differ in few tokens, so
they share a signature among the first of each: a rare token by itself, or a
pair of frequent tokens of the same subclass.  A prefix is extended until its
signatures cover one token more than a partner may lack.  With n_1 rare tokens
and n_g tokens of each frequent subclass g, a partner must lack at least
``n_1 + sum(max(0, n_g - 1))`` tokens to share none, so that sum has to exceed
the number that it may lack.

Frequent subclasses are as many as a set's size asks for (so a prefix makes
few pairs); sizes fall into bands, and a set makes its pairs for its own band
and the next, so that any two sets of fitting sizes meet in one band.

Candidates are not expanded to all pairs of a list.  First each set is held
against the centre of its list; the links found give components, and only
pairs of a list whose components still differ are looked at after that (and
exactly these are needed: a further link inside a component changes nothing).
Candidates pass bounds on their difference (by numbers of rare and frequent
tokens, then by bucketed counts), and are then verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeldist.llm.common import GAP, column_or_null, mixed, row_ids, settled, slices, small, stored, text_batches
from labeldist.llm.components import components

BATCH_BYTES = 500_000
#: A token is frequent if more sets than this have it among their first tokens.
FREQUENT = 16
BUCKETS = 256
BAND = 1.26            # width of a size band: more than 100 / 80
SUBCLASS_SHARE = 0.05  # frequent subclasses per token of a set
LONG_LIST = 128        # sets of a list of frequent tokens from which on its pairs are told from those of other such lists
EXTRA = 1.5            # first tokens that are looked at, as a multiple of a prefix of rare tokens


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of the distinct shingles of all texts, in order of both."""
    words = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), GAP)
    doc = pc.list_parent_indices(words).to_numpy()
    flat = words.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    doc = doc[full.to_numpy(zero_copy_only=False)]
    coded = flat.filter(full).dictionary_encode()
    hashes = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    word = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(doc) else np.zeros(0, np.uint64)
    count = np.bincount(doc, minlength=len(texts))
    begin = np.flatnonzero(doc[width - 1:] == doc[:len(doc) - width + 1]) if len(doc) >= width else np.zeros(0, np.int64)
    h = np.full(len(begin), width, np.uint64)
    for j in range(width):
        h = mixed(h, word[begin + j])
    few = np.flatnonzero((count > 0) & (count < width))
    first = np.searchsorted(doc, few)
    g = count[few].astype(np.uint64) + np.uint64(100)
    for j in range(width - 1):
        more = count[few] > j
        g[more] = mixed(g[more], word[first[more] + j])
    owner, h = np.concatenate([doc[begin], few]), np.concatenate([h, g])
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    return owner[new], h[new]


def _lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def least_size(percent: int) -> int:
    """Sets of fewer tokens link with equal sets only."""
    return -(-percent // (100 - percent))


def may_lack(n, percent: int):
    """How many of ``n`` tokens a partner may lack."""
    return n - (percent * n + 99) // 100


def _describe(width: int, percent: int):
    """Per text: set size, two sums that identify the set, its first tokens and its bucketed counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text", BATCH_BYTES):
                n_docs = part.num_rows
                owner, h = shingles(part.column("__text"), width)
                n = np.bincount(owner, minlength=n_docs)
                start = np.concatenate([[0], np.cumsum(n)])
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
                        for x in (h, mixed(h, h >> np.uint64(7)))]
                keys = [(s[start[1:]] - s[start[:-1]]).view(np.int64) for s in sums]
                zone = np.where(n >= least_size(percent), np.ceil(EXTRA * (may_lack(n, percent) + 1)) + 4, 0)
                first = np.arange(len(h)) - start[owner] < zone[owner]
                counts = np.bincount(owner * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), minlength=n_docs * BUCKETS)
                counts = np.minimum(counts, 255).astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("__rid"), part.column("__id"), pa.array(n), *[pa.array(k) for k in keys],
                     _lists(owner[first], h[first], n_docs),
                     pa.array([counts[i:i + BUCKETS] for i in range(0, len(counts), BUCKETS)], pa.binary())],
                    names=["__rid", "__id", "n", "k1", "k2", "zone", "counts"])
    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text", BATCH_BYTES):
                owner, h = shingles(part.column("__text"), width)
                yield pa.RecordBatch.from_arrays([part.column("__rid"), _lists(owner, h, part.num_rows)], names=["rid", "tokens"])
    return run


def signatures(n: int, rare: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of a set of ``n`` tokens; both arrays sorted."""
    need = may_lack(n, percent) + 1
    out = [rare[:need]]
    if len(rare) < need:
        band = int(np.floor(np.log(n) / np.log(BAND)))
        for b in (band, band + 1):
            classes = max(1, int(SUBCLASS_SHARE * BAND**b))
            of = (mixed(frequent, np.full(len(frequent), b, np.uint64)) % np.uint64(classes)).astype(np.int64)
            # tokens cover one each, but for the first of a subclass
            seen = pd.Series(of).groupby(of).cumcount().to_numpy()
            cover = len(rare) + np.cumsum(seen > 0)
            upto = int(np.searchsorted(cover, need)) + 1
            order = np.argsort(of[:upto], kind="stable")
            token, group = frequent[:upto][order], of[:upto][order]
            size = np.bincount(group)
            # pairs of a subclass: each token with all that follow it there
            rest = np.repeat(np.cumsum(size), size) - np.arange(len(token)) - 1
            left = np.repeat(np.arange(len(rest)), rest)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(rest) - rest, rest)
            out.append(mixed(mixed(token[left], token[right]), np.full(len(left), b, np.uint64)))
    return np.concatenate(out)


def _sign(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, n = (batch.column(c).to_numpy() for c in ("rid", "n"))
            for i in range(batch.num_rows):
                rare, frequent = (np.sort(batch.column(c)[i].values.to_numpy(zero_copy_only=False).view(np.uint64))
                                  for c in ("rare", "frequent"))
                sig = signatures(int(n[i]), rare, frequent, percent)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig.view(np.int64)), *[pa.array(np.full(len(sig), x)) for x in (rid[i], n[i], np.int32(len(rare)))],
                     pa.array(np.arange(len(sig)) < len(rare))], names=["sig", "rid", "n", "r", "single"])
    return run


def _differ(percent: int):
    """Keep the pairs whose bucketed counts do not differ by more than linked sets can."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.int16)
                    for c in ("ca", "cb"))
            total = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            fits = np.abs(a - b).sum(axis=1) * (100 + percent) <= total * (100 - percent)
            yield batch.select(["a", "b"]).filter(pa.array(fits))
    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("ta"), batch.column("tb")
            linked = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a, b = x[i].values.to_numpy(), y[i].values.to_numpy()
                same = len(np.intersect1d(a, b, assume_unique=True))
                linked[i] = 100 * same >= percent * (len(a) + len(b) - same)
            yield batch.select(["a", "b"]).filter(pa.array(linked))
    return run


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, from_table: bool = False) -> DataFrame:
    """``__rid, __id`` (the document's id), ``n`` (set size), ``group`` and ``component`` of every row.

    ``component`` is the smallest id that links lead to, the row's own included;
    ``group`` tells the components apart also where ids are null.

    Sets: distinct ``width``-word shingles of the whole text (A-Z lower-cased);
    a shorter text is one shingle.  Texts that are null or without words have
    no set and link with nothing.  Rows with equal sets are one node of the
    join.  A null id counts as no id: a component of null ids only has a null
    component.  Texts are whole, however long; an empty table gives an empty result; other columns play no part.  ``from_table``: the rows come straight from a table or files; any other frame is stored first.
    """
    if not 80 <= percent < 100:
        raise ValueError("percent must be from 80 to 99")
    least = least_size(percent)
    text_batches(docs.sparkSession)
    rows = row_ids(settled(docs, from_table)).select("__rid", column_or_null(docs, "doc_id", "long").alias("__id"),
                                column_or_null(docs, "text", "string").alias("__text"))
    described = stored(rows.mapInArrow(
        _describe(width, percent), "__rid long, __id long, n long, k1 long, k2 long, zone array<long>, counts binary"), "described")
    key = ["n", "k1", "k2"]
    sets = stored(described.filter("n > 0").groupBy(*key).agg(
        F.min("__rid").alias("rid"), F.min("__id").alias("id"), F.count(F.lit(1)).alias("rows")), "sets")
    # one row for each distinct set
    first = sets.filter("rows > 1").select(*key, F.col("rid").alias("keep"))
    copies = described.filter(F.col("n") >= least).select("__rid", *key).join(first, key).filter("__rid <> keep").select("__rid")
    nodes = described.filter(F.col("n") >= least).join(small(stored(copies, "copies")), "__rid", "left_anti").select(
        F.col("__rid").alias("rid"), "n", "zone", "counts")

    # Classes: frequent tokens, and the sets of mostly frequent tokens ("deep"), of which all tokens count.
    # What the deep sets hold often is frequent too, which can make further sets deep.
    token = nodes.select("rid", F.posexplode("zone").alias("pos", "token"))
    often = lambda tokens: tokens.groupBy("token").count().filter(F.col("count") > FREQUENT).select("token")
    frequent = stored(often(token), "frequent")
    need = (F.col("n") - F.floor((F.lit(percent) * F.col("n") + 99) / 100) + 1).cast("int")
    deep = of_deep = None
    while True:
        hits = token.join(small(frequent), "token", "left_semi").groupBy("rid").agg(F.collect_list("pos").alias("hit"))
        plain = nodes.join(small(stored(hits, "hits")), "rid", "left").select(
            "rid", "n", need.alias("need"), F.when(F.col("hit").isNull(), F.col("zone")).otherwise(
                F.filter("zone", lambda x, i: ~F.array_contains("hit", i))).alias("rare"))
        enough = F.size("rare") >= F.col("need")
        now = stored(plain.filter(~enough).select("rid", "n"), "deep")
        new = now if deep is None else now.join(small(deep), "rid", "left_anti")
        if new.isEmpty():
            break
        tokens = stored(rows.withColumnRenamed("__rid", "rid").join(small(new.select("rid")), "rid", "left_semi").select(
            F.col("rid").alias("__rid"), "__text").mapInArrow(_sets(width), "rid long, tokens array<long>"), "tokens")
        deep, of_deep = now, tokens if of_deep is None else of_deep.union(tokens)
        frequent = stored(frequent.union(often(of_deep.select(F.explode("tokens").alias("token")))).distinct(), "frequent")
    signed = plain.filter(enough).select(
        F.explode(F.slice("rare", F.lit(1), F.col("need"))).alias("sig"), "rid", "n", F.col("need").alias("r"), F.lit(True).alias("single"))
    if deep is not None:
        each = of_deep.select("rid", F.explode("tokens").alias("token")).join(
            small(frequent).withColumn("often", F.lit(True)), "token", "left")
        classed = each.groupBy("rid").agg(
            F.collect_list(F.when(F.col("often").isNull(), F.col("token"))).alias("rare"),
            F.collect_list(F.when(F.col("often"), F.col("token"))).alias("frequent"))
        signed = signed.union(classed.join(small(deep), "rid").select("rid", "n", "rare", "frequent").mapInArrow(
            _sign(percent), "sig long, rid long, n long, r int, single boolean"))

    # lists of more than one set; the centre is the set with the fewest rare tokens, as an original has among its copies
    lists = signed.groupBy("sig").agg(F.min(F.struct("r", "n", "rid")).alias("center"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    member = stored(signed.join(lists.select("sig", "center"), "sig"), "members")

    def may_link(a: str, b: str):
        """Sizes fit; and if two sets meet by frequent tokens only (else a single brings them together as well), they
        differ by all their rare tokens and by the difference of their numbers of frequent ones at least."""
        n, m, r, s = (F.col(x) for x in (f"{a}n", f"{b}n", f"{a}r", f"{b}r"))
        apart = r + s + F.abs((n - r) - (m - s))
        return (percent * F.greatest(n, m) <= 100 * F.least(n, m)) & (
            F.col("single") | (apart * (100 + percent) <= (n + m) * (100 - percent)))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
        side = nodes.select("rid", "n", "counts")
        near = stored(pairs.join(side.toDF("a", "na", "ca"), "a").join(side.toDF("b", "nb", "cb"), "b").mapInArrow(
            _differ(percent), "a long, b long"), "near")
        used = small(stored(near.select(F.col("a").alias("rid")).union(near.select("b")).distinct(), "used"))
        tokens = stored(rows.withColumnRenamed("__rid", "rid").join(used, "rid", "left_semi").select(
            F.col("rid").alias("__rid"), "__text").mapInArrow(_sets(width), "rid long, tokens array<long>"), "tokens")
        return stored(near.join(tokens.toDF("a", "ta"), "a").join(tokens.toDF("b", "tb"), "b").mapInArrow(
            _verify(percent), "a long, b long"), "links")

    c = member.select("sig", "single", "rid", F.col("n").alias("a_n"), F.col("r").alias("a_r"), F.col("center.rid").alias("b"),
                      F.col("center.n").alias("b_n"), F.col("center.r").alias("b_r"))
    links = verified(c.filter(F.col("rid") != F.col("b")).filter(may_link("a_", "b_")).select(F.col("rid").alias("a"), "b"))

    # What the centres have not brought together: sets outside a list's largest component against all others of the list
    part = components(links).toDF("rid", "part")
    placed = member.select("sig", "single", "rid", "n", "r", F.col("center.rid").alias("center")).join(
        part, "rid", "left").withColumn("part", F.coalesce("part", "rid"))
    sizes = placed.groupBy("sig", "part").agg(F.count(F.lit(1)).alias("size"))
    split = sizes.groupBy("sig").agg(F.max_by("part", F.struct("size", "part")).alias("most"), F.count(F.lit(1)).alias("parts"),
                                     F.sum("size").alias("size")).filter("parts > 1")
    apart = placed.join(split.select("sig", "most", (F.col("size") > LONG_LIST).alias("long")), "sig")
    # frequent tokens bring the same pairs together in many long lists: there a pair is looked at in the first that both are in
    mine = apart.filter("long and not single").groupBy("rid").agg(F.collect_list("sig").alias("sigs"))
    apart = stored(apart.filter("long and not single").join(mine, "rid").unionByName(
        apart.filter("not long or single").withColumn("sigs", F.lit(None).cast("array<long>"))), "apart")
    held = ("rid", "n", "r", "part", "sigs")
    a = apart.filter("part <> most").select("sig", "single", "center", "most", *[F.col(x).alias(f"a_{x}") for x in held])
    b = apart.select("sig", *[F.col(x).alias(f"b_{x}") for x in held])
    first = F.col("a_sigs").isNull() | (F.array_min(F.array_intersect("a_sigs", "b_sigs")) == F.col("sig"))
    rest = a.join(b, "sig").filter(
        (F.col("a_part") != F.col("b_part")) & ((F.col("b_part") == F.col("most")) | (F.col("a_rid") < F.col("b_rid")))
        & (F.col("a_rid") != F.col("center")) & (F.col("b_rid") != F.col("center")) & may_link("a_", "b_") & first)
    links = links.union(verified(rest.select(F.col("a_rid").alias("a"), F.col("b_rid").alias("b"))))

    part = components(links).toDF("rid", "part")
    joined = sets.join(part, "rid", "left").withColumn("part", F.coalesce("part", "rid"))
    smallest = joined.groupBy("part").agg(F.min("id").alias("component"))
    of_set = joined.join(smallest, "part").select(*key, F.col("part").alias("group"), "component")
    alone = described.filter("n = 0").select("__rid", "__id", "n", F.col("__rid").alias("group"), F.col("__id").alias("component"))
    return described.filter("n > 0").select("__rid", "__id", *key).join(of_set, key).select(
        "__rid", "__id", "n", "group", "component").union(alone)


def op5(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs, width=4, percent=85, from_table=True).select(
        F.col("__id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each_group(docs: DataFrame, width: int = 5, percent: int = 80, from_table: bool = False) -> DataFrame:
    """``docs`` without the rows that are linked (by a chain of links) to a row with a smaller id.

    A null id counts as the largest; of rows with the same smallest id the first
    stays; rows that link with nothing all stay."""
    docs = settled(docs, from_table)
    rows = row_ids(docs)
    mine = F.struct(F.col("__id").isNull(), F.col("__id"), F.col("__rid"))
    found = jaccard_components(docs, width, percent, from_table=True).select("__rid", "group", mine.alias("mine"))
    best = found.groupBy("group").agg(F.min("mine").alias("best"))
    gone = found.join(best, "group").filter(F.col("mine") != F.col("best")).select("__rid")
    return rows.join(small(stored(gone, "gone")), "__rid", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
