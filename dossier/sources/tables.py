"""Chunk and vector table maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_updates(updates: DataFrame, key: str, seq: str) -> DataFrame:
    """One row per key, the one with the highest sequence number (combined map-side)."""
    cols = [c for c in updates.columns if c not in (key, seq)]
    return (
        updates.groupBy(key)
        .agg(F.max_by(F.struct(*cols), F.col(seq)).alias("v"))
        .select(key, *[F.col(f"v.{c}").alias(c) for c in cols])
    )


def upsert(base: DataFrame, updates: DataFrame, key: str, seq: str, keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Insert or replace by key.

    The last update of a key wins inside the batch, `keep` columns of a known row stay as they were. Where base itself
    has the column `seq`, an update older than the row it meets changes nothing. One full outer join on the key, so
    both sides are shuffled once and no key can collect more than one row per side.
    """
    versioned = seq in base.columns
    new = last_updates(updates.withColumn("_seq", F.col(seq)), key, seq)
    b = base.withColumn("_b", F.lit(True)).alias("b")
    u = new.withColumn("_u", F.lit(True)).alias("u")
    wins = F.col("u._u") & (F.coalesce(F.col("u._seq") >= F.col(f"b.{seq}"), F.lit(True)) if versioned else F.lit(True))
    out = [F.coalesce(F.col(f"b.{key}"), F.col(f"u.{key}")).alias(key)]
    for c in base.columns:
        if c == key:
            continue
        old = F.col(f"b.{c}")
        if versioned and c == seq:
            out.append(F.greatest(old, F.col("u._seq")).alias(c))
        elif c not in new.columns:
            out.append(old.alias(c))
        elif c in keep:
            out.append(F.when(F.col("b._b"), old).otherwise(F.col(f"u.{c}")).alias(c))
        else:
            out.append(F.when(wins, F.col(f"u.{c}")).otherwise(old).alias(c))
    return b.join(u, F.col(f"b.{key}") == F.col(f"u.{key}"), "full_outer").select(*out)


def drop_orphans(vectors: DataFrame, chunks: DataFrame, vector_key: str, chunk_key: str) -> DataFrame:
    """Vectors whose chunk still exists."""
    keys = chunks.select(F.col(chunk_key).alias(vector_key))
    return vectors.join(keys, vector_key, "left_semi")


def pair_check(chunks: DataFrame, vectors: DataFrame, chunk_key: str, vector_key: str) -> DataFrame:
    """Counts of paired and unpaired rows; a batch is valid when nothing is unpaired."""
    c = chunks.groupBy(F.col(chunk_key).alias("k")).agg(F.count("*").alias("nc"))
    v = vectors.groupBy(F.col(vector_key).alias("k")).agg(F.count("*").alias("nv"))
    return (
        c.join(v, "k", "full_outer")
        .agg(
            F.coalesce(F.sum("nc"), F.lit(0)).alias("chunk_count"),
            F.coalesce(F.sum("nv"), F.lit(0)).alias("vector_count"),
            F.count_if(F.col("nv").isNull()).alias("chunks_without_vector"),
            F.count_if(F.col("nc").isNull()).alias("vectors_without_chunk"),
        )
        .withColumn("valid", (F.col("chunks_without_vector") == 0) & (F.col("vectors_without_chunk") == 0)
                    & (F.col("chunk_count") == F.col("vector_count")))
    )


def append_json(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines with sorted keys; empty fields are written as null."""
    df.select(*sorted(df.columns)).write.mode("append").option("ignoreNullFields", "false").json(path)
