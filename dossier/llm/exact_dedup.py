"""Exact duplicates by sorting content. Column expressions only.

Sampled splitters cut the order of normalised texts into ranges, each range is sorted with spilling to disk, and equal
texts, now neighbours, are found by comparing whole texts. The order is: first characters, a hash, piece, whole text,
identifier. Splitters so stay short however long the texts are, texts with a common beginning still spread, and
texts that are equal still lie together. Texts with very many copies are cut into pieces, which may lie in different
ranges; one row per piece is compared in full in the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.llm.base import materialize, sized

#: Characters of a text that take part in the splitters.
HEAD_CHARS = 32
#: A hash is cut into pieces when it has more than this share of all rows or bytes, so at most twice as many hashes are.
HOT_SHARE = 4096
MIN_HOT_ROWS = 256
MIN_HOT_BYTES = 16 << 20
RANGE_BYTES = 128 << 20


def normalised(text: Column) -> Column:
    """The text with each run of spaces as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def hot_hashes(norm: DataFrame) -> tuple[DataFrame, int]:
    """(h, pieces) of hashes with very many rows or bytes, at most 2 * HOT_SHARE rows, and the bytes of all texts.

    norm: one column `norm`. Hashes are counted where the texts are read; only hashes and counts are shuffled.
    """
    counts = norm.select(F.xxhash64("norm").alias("h"), F.octet_length("norm").alias("b")).groupBy("h").agg(F.count("*").alias("n"), F.sum("b").alias("b"))
    counts = materialize(counts, "hashes")
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    rows, size = max(MIN_HOT_ROWS, whole.n // HOT_SHARE), max(MIN_HOT_BYTES, whole.b // HOT_SHARE)
    pieces = F.greatest(F.ceil(F.col("n") / rows), F.ceil(F.col("b") / size)).cast("long")
    return counts.filter((F.col("n") > rows) | (F.col("b") > size)).select("h", pieces.alias("pieces")), whole.b


def sorted_ranges(rows: DataFrame, size: int, *keys: str) -> DataFrame:
    """rows (norm, h and others) with head, in ranges of head and keys, of about RANGE_BYTES each when the session's number of partitions is too few."""
    rows = rows.withColumn("head", F.substring("norm", 1, HEAD_CHARS))
    n = -(-size // RANGE_BYTES)
    if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return rows.repartitionByRange(n, "head", *keys)
    return rows.repartitionByRange("head", *keys)


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) per row of docs, and `row`, a struct of the columns named in carry.

    Of texts that are equal after `normalised` the row with the smallest key is kept; null is an empty text. Null
    keys are larger than all: keep_id is null only if all keys of the group are. Of rows that repeat a key and its
    text one is kept. Long texts are sorted and compared whole, and spill to disk. Columns that are not named are not
    read, and may have any name. An empty table gives no rows.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.struct(F.lit(None).cast("int").alias("none"))
    own = docs.select(F.col(f"`{key}`").alias("id"), normalised(F.col(f"`{text}`")).alias("norm"), row.alias("row"))
    hot, size = hot_hashes(own.select("norm"))
    some_hot = not hot.isEmpty()
    rows = own.withColumn("h", F.xxhash64("norm"))
    if some_hot:
        rows = rows.join(F.broadcast(hot), "h", "left").withColumn("hot", F.col("pieces").isNotNull())
        rows = rows.withColumn("piece", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), "pieces")).otherwise(F.lit(0).cast("long")))
    else:
        rows = rows.withColumn("hot", F.lit(False))
    # The window's groups lie within the ranges, so it needs no exchange; it tells neighbours apart by their whole texts.
    keys = ("h", "piece") if some_hot else ("h",)
    same = W.partitionBy("head", *keys, "norm").orderBy(F.col("id").asc_nulls_last())
    every = same.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    found = sorted_ranges(rows, size, *keys).select("id", "row", "h", "hot", "norm", F.row_number().over(same).alias("place"), F.min("id").over(every).alias("low"), F.count("*").over(every).alias("n"))
    found = found.select("id", "row", "h", "hot", "place", "low", "n", F.sha2("norm", 256).alias("text_sha256"), F.when(F.col("hot") & (F.col("place") == 1), F.col("norm")).alias("norm"))
    if not some_hot:
        return _settled(found.drop("hot", "h", "norm"), carry)
    found = materialize(found, "sorted")
    # One row per piece: pieces of one text are put together by their whole texts.
    texts = found.filter("hot and place = 1").groupBy("norm").agg(F.min("low").alias("low"), F.sum("n").alias("n"))
    texts = materialize(texts.select(F.sha2("norm", 256).alias("text_sha256"), "low", "n"), "pieces")
    parts = found.filter("hot").drop("low", "n", "norm").join(sized(texts), "text_sha256")
    return _settled(found.filter("not hot").drop("norm").unionByName(parts).drop("hot", "h"), carry)


def _settled(found: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    kept = (F.col("place") == 1) & F.col("id").eqNullSafe(F.col("low"))
    return found.select("id", F.col("low").alias("keep_id"), F.col("n").cast("long").alias("group_size"), kept.alias("kept"), "text_sha256", *(["row"] if carry else []))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs per distinct text (see `exact_groups`), with its own columns; all cases are as there."""
    return exact_groups(docs, key, text, tuple(docs.columns)).filter("kept").select("row.*")
