"""Packing by optimal length buckets.

A dynamic program over the exact histogram of all lengths picks the bucket boundaries with the least padding. Inside a
bucket every sequence is padded to the boundary, and a batch takes as many as the token budget holds.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.llm.base import materialize, word_count

BUCKETS = 16
TOKEN_BUDGET = 16_384
SHARD_ROWS = 100_000
SEED = 29


def best_boundaries(sizes: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Boundaries among `sizes` (ascending) for at most `buckets` buckets with the least total padded length.

    best[j] is the least padded length of sizes[:j] in k buckets; sequences of a bucket count as its largest size.
    The first place of the best cut never moves back as j grows, so each layer is filled by halves, in
    n log n steps. Ties take fewer buckets, then longer last buckets.
    """
    n = len(sizes)
    if not n:
        return []
    sizes = np.asarray(sizes, dtype=np.int64)
    upto = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    never = np.int64(1) << np.int64(62)
    best = np.full(n + 1, never)
    best[0] = 0
    cuts = []
    k_best, least = 0, never
    for k in range(min(buckets, n)):
        step, cut = np.full(n + 1, never), np.zeros(n + 1, dtype=np.int64)
        # (first j, last j, first cut, last cut); sizes[:i] may be empty only in the first layer.
        work = [(k + 1, n, k, n - 1)]
        while work:
            low, high, a, b = work.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            total = best[i] + (upto[j] - upto[i]) * sizes[j - 1]
            at = int(total.argmin())
            cut[j], step[j] = i[at], total[at]
            work += [(low, j - 1, a, cut[j]), (j + 1, high, cut[j], b)]
        best = step
        cuts.append(cut)
        if best[n] < least:
            k_best, least = k, best[n]
    out, j = [], n
    for k in range(k_best, -1, -1):
        out.append(int(sizes[j - 1]))
        j = cuts[k][j]
    return out[::-1]


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, length: Column | None = None) -> DataFrame:
    """(key, n_tokens, bucket, batch, slot, padding) per row of docs.

    n_tokens is `length`, by default the number of words. bucket is the length that sequences of the bucket are
    padded to; batch counts from 0 in its bucket and holds max(1, budget / bucket) sequences, all but a bucket's
    last batch exactly. A sequence longer than the budget has a batch of its own. Rows without tokens (null and
    empty texts) take no place: bucket, batch, slot and padding are null. Null keys and repeated rows are packed
    like others; an empty table gives no rows; other columns are not read. Sequences of a bucket come in an order
    by hash, so batches mix sources.
    """
    n = word_count(F.col(text).cast("string")) if length is None else length.cast("long")
    rows = materialize(docs.select(F.col(key).alias("doc"), n.alias("n_tokens"), F.xxhash64(F.lit(SEED), F.col(key), F.col(text)).alias("h")), "lengths")
    # One row per distinct length: their sum is at most the tokens of the corpus, so they are few (some 10,000 for texts up to that length).
    hist = sorted((r.n_tokens, r["count"]) for r in rows.filter("n_tokens > 0").groupBy("n_tokens").count().collect())
    edges = best_boundaries(np.array([e for e, _ in hist], dtype=np.int64), np.array([c for _, c in hist], dtype=np.int64), buckets)
    bucket = F.lit(None).cast("long")
    for e in reversed(edges):
        bucket = F.when(F.col("n_tokens") <= e, F.lit(e).cast("long")).otherwise(bucket)
    rows = rows.withColumn("bucket", F.when(F.col("n_tokens") > 0, bucket))
    sizes = {e: 0 for e in edges}
    for e, c in hist:
        sizes[edges[bisect.bisect_left(edges, e)]] += c
    # A bucket is cut into shards by ranges of the hash; the counts of the earlier shards give a row its place.
    shards = F.lit(1)
    for e, c in sizes.items():
        shards = F.when(F.col("bucket") == e, -(-c // SHARD_ROWS)).otherwise(shards)
    place = F.floor((F.col("h").cast("double") / float(1 << 64) + 0.5) * shards)
    cut = rows.filter("bucket is not null").withColumn("shard", F.least(place, shards - 1).cast("int"))
    here = W.partitionBy("bucket", "shard").orderBy("h", "doc")
    before = F.sum("c").over(W.partitionBy("bucket").orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    offsets = cut.groupBy("bucket", "shard").agg(F.count("*").alias("c")).select("bucket", "shard", F.coalesce(before, F.lit(0)).alias("off"))
    at = cut.withColumn("rn", F.row_number().over(here) - 1).join(offsets, ["bucket", "shard"]).withColumn("at", F.col("rn") + F.col("off"))
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket"))).cast("long")
    full = at.select("doc", "n_tokens", "bucket", F.floor(F.col("at") / room).cast("long").alias("batch"), F.pmod(F.col("at"), room).cast("long").alias("slot"), (F.col("bucket") - F.col("n_tokens")).alias("padding"))
    none = rows.filter("bucket is null").select("doc", "n_tokens", *[F.lit(None).cast("long").alias(c) for c in ("bucket", "batch", "slot", "padding")])
    return full.unionByName(none).withColumnRenamed("doc", key)
