"""Near-duplicate embeddings: the exact graph of links between vectors of one label.

Equal vectors are one node.  The nodes of a label are split into cells by a
tree of centres (a cell of more than ``SHARD_ROWS`` nodes is dealt to the
nearest of up to ``FAN_OUT`` centres drawn from it, level by level); a cell
that stays larger is cut at random into shards.  A shard knows its centre and
its radius (the largest angle of a member).  Two shards meet if the angle of
their centres is at most their radii plus the angle of the threshold: by the
triangle inequality no other shards hold a link.  Each such pair of shards is
held against each other once, every shard also against itself: cosines in
single precision, and in double precision where single could be wrong.

A pair of shards hands on a count and one tie per linked node, never its
links, so dense groups stay linear in rows.  How many shards meet depends on
the data: few if vectors lie in groups, all shards of a label if its vectors
point everywhere; one shard is moved for each pair, ``n / SHARD_ROWS / 2``
times the input of a label at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labeldist.llm.common import column_or_null, row_ids, small, stored, text_batches
from labeldist.llm.components import components

SHARD_ROWS = 8192     # nodes of a shard at most, on average over the shards of a cell
FAN_OUT = 16          # centres that the nodes of a cell are dealt to
SHARD_VALUES = 2**19  # numbers in the vectors of a shard at most: fewer nodes if vectors are long
CHUNK = 256           # shards whose centres are held against each other in one task
QUERY_BLOCK = 512
ANGLE_SLACK = 1e-6    # far above the rounding of an angle
AUDIT_ROWS = 200


def usable(rows: DataFrame) -> DataFrame:
    """``__rid, __id, __label, __x`` and ``__ok``: whether the row takes part (label and vector given, finite, not zero)."""
    raw = column_or_null(rows, "embedding", "array<double>").cast("array<double>")
    finite = F.forall(raw, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    some = F.exists(raw, lambda v: v != 0)
    label = column_or_null(rows, "label", "int")
    ok = F.coalesce(label.isNotNull() & finite & some, F.lit(False))
    return row_ids(rows).select("__rid", column_or_null(rows, "vec_id", "long").alias("__id"), label.alias("__label"),
                                raw.alias("__x"), ok.alias("__ok"))


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)   # so that squares neither overflow nor vanish
    x = x / top
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def _deal(rows: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
    """The child cell of each row of a slice of a cell: its nearest centre."""
    if not len(rows):
        return pd.DataFrame({"node": [], "cell": []})
    if not len(centres):   # none was drawn
        return pd.DataFrame({"node": rows["node"], "cell": rows["__cell"]})
    c = centres.sort_values("k")
    near = (_unit(np.stack(rows["__x"])) @ _unit(np.stack(c["__x"])).T).argmax(axis=1)
    return pd.DataFrame({"node": rows["node"], "cell": rows["__cell"] * FAN_OUT + near})


def _shard_rows() -> Column:
    return F.least(F.lit(SHARD_ROWS), F.greatest(F.floor(F.lit(SHARD_VALUES) / F.col("__dim")), F.lit(1)))


def cells(nodes: DataFrame) -> DataFrame:
    """``nodes`` with a column ``__cell`` (unique within label and length), split while cells are too large and splits help.

    The id of a cell is that of its parent times ``FAN_OUT`` plus its number; the first is 1, so ids of all levels differ."""
    cell = ["__label", "__dim", "__cell"]
    nodes = nodes.withColumn("__cell", F.lit(1).cast("long"))
    largest = None
    while True:
        sizes = stored(nodes.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > _shard_rows()), "cells")
        top, bits = sizes.agg(F.max("n"), F.max("__cell")).first()
        if top is None or (largest is not None and top > 0.9 * largest) or bits > (1 << 62) // FAN_OUT:
            return nodes
        largest = top
        level = nodes.join(small(sizes), cell, "left")
        large = level.filter("n IS NOT NULL")
        wanted = F.least(F.ceil(F.col("n") / _shard_rows()), F.lit(FAN_OUT))
        draw = F.pmod(F.xxhash64("node", "__cell"), F.lit(1 << 40)) / F.lit(float(1 << 40))
        drawn = large.withColumn("u", draw).filter(F.col("u") < (1.5 * wanted + 8) / F.col("n"))
        centres = stored(drawn.withColumn("k", F.row_number().over(Window.partitionBy(*cell).orderBy("u", "node"))).filter(
            F.col("k") <= wanted), "centres")
        n_slices = F.ceil(F.col("n") / _shard_rows())
        sliced = large.withColumn("slice", F.pmod(F.xxhash64("node"), n_slices))
        shown = centres.select(*cell, "__x", "k", F.explode(F.sequence(F.lit(0).cast("long"), n_slices - 1)).alias("slice"))
        dealt = sliced.groupBy(*cell, "slice").cogroup(shown.groupBy(*cell, "slice")).applyInPandas(
            _deal, "node long, cell long")
        nodes = stored(level.join(dealt, "node", "left").withColumn("__cell", F.coalesce("cell", "__cell")).drop(
            "n", "cell"), "dealt")


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    """A shard as one row: its nodes, copies and unit vectors, its centre and its radius."""
    rows = rows.sort_values("node")
    x = _unit(np.stack(rows["__x"]))
    mean = x.mean(axis=0)
    centre = _unit(mean[None])[0] if np.abs(mean).max() > 1e-9 else x[0]
    return pd.DataFrame({
        "label": rows["__label"].iloc[:1], "dim": rows["__dim"].iloc[:1], "shard": rows["node"].iloc[:1],
        "centre": [centre.tobytes()], "radius": [float(_angle(x @ centre).max())], "x": [np.ascontiguousarray(x).tobytes()],
        "nodes": [rows["node"].to_numpy().tobytes()], "copies": [rows["copies"].to_numpy().tobytes()]})


def _meetings(shards: pd.DataFrame, reach: float) -> pd.DataFrame:
    """Pairs of shards of two chunks (or of one) that can hold a link."""
    lo, hi = (shards[shards["chunk"] == k] for k in (shards["lo"].iloc[0], shards["hi"].iloc[0]))
    if not len(lo) or not len(hi):
        return pd.DataFrame({"one": [], "two": []})
    centres = [np.stack([np.frombuffer(c) for c in s["centre"]]) for s in (lo, hi)]
    radii = [s["radius"].to_numpy() for s in (lo, hi)]
    one, two = (s["shard"].to_numpy() for s in (lo, hi))
    meet = _angle(centres[0] @ centres[1].T) <= radii[0][:, None] + radii[1] + reach
    if lo["chunk"].iloc[0] == hi["chunk"].iloc[0]:
        meet &= one[:, None] <= two
        meet |= one[:, None] == two
    i, j = np.nonzero(meet)
    return pd.DataFrame({"one": one[i], "two": two[j]})


class _Shard:
    def __init__(self, row, side: str):
        self.nodes, self.copies = (np.frombuffer(getattr(row, f"{c}_{side}"), np.int64) for c in ("nodes", "copies"))
        self.x = np.frombuffer(getattr(row, f"x_{side}")).reshape(len(self.nodes), -1)
        self.centre, self.radius = np.frombuffer(getattr(row, f"centre_{side}")), getattr(row, f"radius_{side}")

    def near(self, other: _Shard, reach: float) -> np.ndarray:
        """Which members can have a link in the other shard."""
        return np.flatnonzero(_angle(self.x @ other.centre) <= other.radius + reach)


def _links(one: _Shard, two: _Shard, same: bool, threshold: float) -> pd.DataFrame:
    """Per linked node of two shards (or of one) the copies of its partners, and a tie to a node that links lead to."""
    reach = np.arccos(min(threshold, 1.0)) + ANGLE_SLACK
    p, q = one.near(two, reach), two.near(one, reach)
    x, y = one.x[p], two.x[q]
    x32, y32 = x.astype(np.float32), y.astype(np.float32)
    unsure = 1e-6 + 2.4e-7 * x.shape[1]      # more than single precision can be wrong by
    copies = (one.copies[p].astype(float), two.copies[q].astype(float))   # sums below 2 ** 53 are exact
    count = (np.zeros(len(p)), np.zeros(len(q)))
    right = np.arange(len(q)) + (0 if same else len(p))   # place of the members of ``two`` among all
    group = np.arange(len(q) if same else len(p) + len(q))
    for a in range(0, len(p), QUERY_BLOCK):
        cos = x32[a:a + QUERY_BLOCK] @ y32.T
        link = cos >= threshold + unsure
        i, j = np.nonzero((cos >= threshold - unsure) & ~link)
        for k in range(0, len(i), 100_000):
            u, v = i[k:k + 100_000], j[k:k + 100_000]
            link[u, v] = np.einsum("ij,ij->i", x[a + u], y[v]) >= threshold
        if same:
            rows = np.arange(len(link))
            link[rows, a + rows] = False
        some = np.flatnonzero(link.any(axis=1))
        if not len(some):
            continue
        weight = link[some].astype(float)
        count[0][a + some] += weight @ copies[1]
        if not same:
            count[1][:] += copies[0][a + some] @ weight
        for i in some:
            met, own = group[right[link[i]]], group[a + i]
            if (met != own).any():
                met = np.unique(np.append(met, own))
                group[np.isin(group, met)] = met[0]
    nodes = one.nodes[p] if same else np.concatenate([one.nodes[p], two.nodes[q]])
    links = np.rint(count[0] if same else np.concatenate(count)).astype(np.int64)
    linked = links > 0
    return pd.DataFrame({"node": nodes[linked], "links": links[linked], "tie": nodes[group][linked]})


def _search(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            yield _links(_Shard(row, "one"), _Shard(row, "two"), row.one == row.two, threshold)


def links_of(nodes: DataFrame, threshold: float) -> DataFrame:
    """``node, links, tie``: of each pair of shards that holds links of the node, their number and a node that they lead to."""
    text_batches(nodes.sparkSession)   # a row holds two shards
    reach = math.acos(min(threshold, 1.0)) + ANGLE_SLACK
    split = cells(nodes)
    cell = ["__label", "__dim", "__cell"]
    sizes = split.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    pieces = split.join(small(sizes), cell).withColumn("piece", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / _shard_rows())))
    shards = stored(pieces.groupBy(*cell, "piece").applyInPandas(
        _pack, "label int, dim int, shard long, centre binary, radius double, x binary, nodes binary, copies binary"), "shards")
    centres = shards.select("label", "dim", "shard", "centre", "radius")
    chunks = centres.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    other = centres.join(small(chunks), ["label", "dim"]).withColumn(
        "chunk", F.pmod(F.xxhash64("shard"), F.col("chunks"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    meetings = other.withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other")).groupBy(
        "label", "dim", "lo", "hi").applyInPandas(lambda f: _meetings(f, reach), "one long, two long")
    side = lambda s: shards.select(F.col("shard").alias(s), *[
        F.col(c).alias(f"{c}_{s}") for c in ("centre", "radius", "x", "nodes", "copies")])
    return meetings.join(side("one"), "one").join(side("two"), "two").mapInPandas(
        lambda b: _search(b, threshold), "node long, links long, tie long")


def near_duplicates(rows: DataFrame, threshold: float = 0.98) -> DataFrame:
    """``__rid, __id, n_links, group`` and ``component`` of every row.

    Rows compare only within their label.  Rows without a label, and vectors
    that are null, zero or hold null or non-finite components link with
    nothing; vectors of different lengths never link.  ``component`` is the
    smallest id reached by links (null for null ids only), ``group`` tells
    components apart also then.  Repeated rows link with each other; an empty table gives an empty result; other columns
    play no part.
    """
    all_rows = stored(usable(rows), "vectors")
    ok = all_rows.filter("__ok").withColumn("__dim", F.size("__x"))
    key = ["__label", "__dim", "__x"]
    nodes = stored(ok.groupBy(*key).agg(F.min("__rid").alias("node"), F.count(F.lit(1)).alias("copies")), "nodes")
    found = stored(links_of(nodes, threshold), "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    part = components(found.filter("node <> tie").select(F.col("node").alias("a"), F.col("tie").alias("b")))
    of_node = nodes.select(*key, "node", "copies").join(links, "node", "left").join(part, "node", "left").select(
        *key, "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("group"))
    linked = ok.join(of_node, key).select("__rid", "__id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "group")
    least = linked.groupBy("group").agg(F.min("__id").alias("component"))
    alone = all_rows.filter("NOT __ok").select("__rid", "__id", F.lit(0).cast("long").alias("n_links"),
                                               F.col("__rid").alias("group"), F.col("__id").alias("component"))
    return linked.join(least, "group").select("__rid", "__id", "n_links", "group", "component").union(alone)


def audit_recall(rows: DataFrame, found: DataFrame, threshold: float = 0.98, sample: int = AUDIT_ROWS) -> float:
    """Links found as a share of all links of about ``sample`` rows, which are held against every row of their label."""
    ok = usable(rows).filter("__ok")
    total = ok.count()
    chosen = ok.filter(F.pmod(F.xxhash64("__rid"), F.lit(max(total // sample, 1))) == 0)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    norm = lambda a: F.sqrt(dot(a, a))
    q = chosen.select(F.col("__rid").alias("q"), "__label", F.col("__x").alias("y"))
    pairs = ok.join(F.broadcast(q.limit(10 * sample)), "__label").filter((F.col("__rid") != F.col("q")) & (F.size("__x") == F.size("y")))
    cosine = dot(F.col("__x"), F.col("y")) / (norm(F.col("__x")) * norm(F.col("y")))
    true = pairs.filter(cosine >= threshold).groupBy("q").count()
    r = found.join(true, F.col("__rid") == F.col("q")).agg(F.sum("n_links").alias("got"), F.sum("count").alias("all")).first()
    return 1.0 if not r["all"] else r["got"] / r["all"]


def op4(embeddings: DataFrame) -> DataFrame:
    return near_duplicates(embeddings).select(
        F.col("__id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
        F.col("__id").eqNullSafe(F.col("component")).alias("kept"))
