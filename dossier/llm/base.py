"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.session import fits, materialize

SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Keys that may be broadcast: about 10 MB of one or two long columns.
BROADCAST_KEYS = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_array(text: Column) -> Column:
    """Words of a text (null: none)."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def some(df: DataFrame) -> bool:
    return not df.isEmpty()


def sized(keys: DataFrame) -> DataFrame:
    """Marks a narrow table for broadcast only when it has few rows; larger ones are joined by shuffle."""
    return F.broadcast(keys) if fits(keys, BROADCAST_KEYS) else keys


def without(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of df whose key is not in keys; rows with a null key stay."""
    return df.join(sized(keys), on, "left_anti")


__all__ = ["SPACES", "WORD", "fits", "materialize", "sized", "some", "table", "without", "word_array", "word_count"]
