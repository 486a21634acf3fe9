"""Embedding near-duplicates through a pivot-permutation index.

Every vector is described by its nearest of a set of reference vectors (pivots), by more of them the more there are. Inverted lists hold the
vectors under each pair of described pivots, so vectors that share at least two pivots meet; the cosine in double
precision decides. Pivots come from a bounded sample; every vector is indexed.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.base import materialize, sized
from dossier.llm.components import components

MIN_COSINE = 0.9
#: Nearest pivots that describe a vector when there are MIN_PIVOTS.
PREFIX = 6
#: One pivot for so many vectors, within these bounds (a sample of MAX_PIVOTS vectors at most goes to the driver).
PER_PIVOT, MIN_PIVOTS, MAX_PIVOTS = 128, 64, 4096
#: Vectors of one inverted list that are compared in one task; longer lists are cut into pairs of chunks.
CHUNK = 512


def usable(v: Column) -> Column:
    """Neither null nor zero, and all components finite numbers."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def _matrix(column) -> np.ndarray:
    """Rows of a list column as doubles of length 1 (scaled first, so that no square overflows or vanishes)."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = values.reshape(len(column), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def prefix_length(n_pivots: int) -> int:
    """How many nearest pivots describe a vector: 2 more per 8 times as many pivots, which holds the recall near the cosine limit."""
    return min(n_pivots, PREFIX + math.ceil(2 / 3 * math.log2(max(1.0, n_pivots / MIN_PIVOTS))))


def postings(classes: DataFrame, pivots: np.ndarray, prefix: int | None = None) -> DataFrame:
    """(c, pivots) per class: numbers of its nearest pivots, ascending. Ties take the smaller number."""
    prefix = prefix or prefix_length(len(pivots))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            near = np.argsort(-(_matrix(b.column(1)) @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.int32)
            near.sort(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near.tolist(), pa.list_(pa.int32()))], names=["c", "pivots"])

    return classes.select("c", "v").mapInArrow(run, "c long, pivots array<int>")


def _linked(a: dict, b: dict, key: int, same: bool, min_cosine: float):
    """Links between two chunks whose first two shared pivots are this list's: row numbers (i, j)."""
    i, j = np.nonzero(a["m"] @ b["m"].T >= min_cosine)
    if same:
        i, j = i[i < j], j[i < j]
    if len(i):
        shared = (a["p"][i][:, :, None] == b["p"][j][:, None, :]).any(axis=2)
        first = shared & (np.cumsum(shared, axis=1) <= 2)
        two = np.where(first, a["p"][i], 0)
        # Two numbers in ascending order, packed as the key is.
        low = np.where(first, a["p"][i], 1 << 30).min(axis=1)
        mine = low.astype(np.int64) * MAX_PIVOTS + two.max(axis=1) == key
        i, j = i[mine], j[mine]
    return i, j


def compared(rows: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """Counts and links of the inverted lists. rows: (key, x, y, side, c, w, v, pivots), sorted by list and chunk pair.

    Gives (a, null, n) for n vectors that class a links with there, and (a, b, 0) for links that connect what is
    connected there (a spanning forest, not all links).
    """

    def finish(held):
        t = pa.Table.from_batches(held).combine_chunks()
        key, x, y = (t.column(k)[0].as_py() for k in ("key", "x", "y"))
        side = t.column("side").to_numpy()
        make = lambda s: {"m": _matrix(s.column("v").combine_chunks()), "p": np.array(s.column("pivots").to_pylist()), "c": s.column("c").to_numpy(), "w": s.column("w").to_numpy()}
        left = t.filter(pa.array(side == 0))
        right = left if x == y else t.filter(pa.array(side == 1))
        if not left.num_rows or not right.num_rows or (x == y and left.num_rows < 2):
            return None
        a = make(left)
        b = a if x == y else make(right)
        i, j = _linked(a, b, key, x == y, min_cosine)
        if not len(i):
            return None
        count = {}
        for own, k, other in ((a, i, b["w"][j]), (b, j, a["w"][i])):
            n = np.bincount(k, weights=other, minlength=len(own["c"])).astype(np.int64)
            for c, v in zip(own["c"][n > 0].tolist(), n[n > 0].tolist()):
                count[c] = count.get(c, 0) + v
        parent: dict[int, int] = {}

        def root(z):
            while parent.setdefault(z, z) != z:
                parent[z] = parent[parent[z]]
                z = parent[z]
            return z

        edges = []
        for p, q in zip(a["c"][i].tolist(), b["c"][j].tolist()):
            r, s = root(p), root(q)
            if r != s:
                parent[max(r, s)] = min(r, s)
                edges.append((p, q))
        first = list(count) + [e[0] for e in edges]
        second = [None] * len(count) + [e[1] for e in edges]
        return pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(list(count.values()) + [0] * len(edges), pa.int64())], names=["a", "b", "n"])

    def run(batches):
        held, now = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
            for s, e in zip(cuts, cuts[1:]):
                if now is not None and tuple(ids[s]) != now:
                    if (out := finish(held)) is not None:
                        yield out
                    held = []
                now = tuple(ids[s])
                held.append(batch.slice(s, e - s))
        if held and (out := finish(held)) is not None:
            yield out

    return rows.mapInArrow(run, "a long, b long, n long")


def near_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", min_cosine: float = MIN_COSINE, chunk: int = CHUNK) -> DataFrame:
    """(key, n_links, component_id, kept) per row of table.

    n_links counts the other rows found with at least min_cosine; component_id is the smallest key reachable.
    Equal vectors are one node with a weight, so copies never make pairs. Vectors that are null, zero, or have
    null or non-finite components link with nothing, and so do vectors of another length. Null and repeated
    keys and repeated rows count as rows of their own; a null key names no component, and its row is not kept.
    An empty table gives no rows; other columns are not read.
    """
    v = F.col(f"`{vector}`")
    rows = table.select(F.col(f"`{key}`").alias("id"), F.when(usable(v), v).alias("v"))
    hashes = [F.xxhash64("v").alias("h1"), F.hash("v", F.size("v")).alias("h2")]
    rows = materialize(rows.select("id", "v", *hashes), "vectors")
    good = rows.filter("v is not null")
    classes = good.groupBy("h1", "h2").agg(F.count("*").alias("w"), F.min("id").alias("least"), F.first("v").alias("v"))
    classes = materialize(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    edges = table.sparkSession.createDataFrame([], "a long, b long, n long")
    lengths = classes.groupBy(F.size("v").alias("d")).count().collect()  # a table normally has one length
    for r in lengths:
        edges = edges.unionByName(_links(classes.filter(F.size("v") == r.d), r["count"], min_cosine, chunk))
    edges = materialize(edges, "links")
    found = edges.filter("b is null").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("links"))
    roots = materialize(components(edges.filter("b is not null").select("a", "b"), "a", "b").withColumnRenamed("node", "c"), "roots")
    least = roots.join(classes.select("c", "least"), "c").groupBy("root").agg(F.min("least").alias("component"))
    named = classes.select("h1", "h2", "c", "w", "least").join(found, "c", "left").join(roots.join(least, "root").select("c", "component"), "c", "left")
    named = named.select("h1", "h2", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "least").alias("component_id"))
    linked = good.select("id", "h1", "h2").join(named, ["h1", "h2"]).select("id", "n_links", "component_id")
    alone = rows.filter("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _links(classes: DataFrame, n: int, min_cosine: float, chunk: int) -> DataFrame:
    wanted = min(MAX_PIVOTS, max(MIN_PIVOTS, n // PER_PIVOT))
    sample = classes.select("v").orderBy(F.xxhash64(F.lit(7), "v"), "v").limit(wanted).toArrow().column("v").combine_chunks()
    pivots = _matrix(sample)
    prefix = prefix_length(len(pivots))
    if prefix < 2:
        return classes.sparkSession.createDataFrame([], "a long, b long, n long")
    posted = materialize(postings(classes, pivots, prefix), "postings")
    pairs = [F.col("pivots")[i].cast("long") * MAX_PIVOTS + F.col("pivots")[j] for i, j in itertools.combinations(range(prefix), 2)]
    sizes = posted.select(F.explode(F.array(*pairs)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    lists = materialize(sizes.filter("n > 1"), "lists")
    long_lists = lists.filter(F.col("n") > chunk)
    rows = posted.join(classes.select("c", "w", "v"), "c").select("c", "w", "v", "pivots", F.explode(F.array(*pairs)).alias("key"))
    rows = rows.join(sized(long_lists), "key", "left")
    parts = F.coalesce(F.ceil(F.col("n") / chunk), F.lit(1)).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("c"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    rows = rows.select("key", low.alias("x"), high.alias("y"), (F.col("own") != low).cast("int").alias("side"), "c", "w", "v", "pivots")
    return compared(rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y"), min_cosine)
