"""Row numbers and carried values inside large groups without sorting a group in one task.

Rows are cut into ranges of (key, order, tie) by sampled limits, so a far value or a constant order column does not put a
group into few ranges. The ranges are written once; all later steps read that table, so they see the same ranges.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.functions.session import materialize

TIE = "_tie"


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys where null equals null."""
    right = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_same_{k}"]) for k in keys])
    return left.join(right, on).drop(*[f"_same_{k}" for k in keys])


def ranged(df: DataFrame, keys: list[str], order: str, ranges: int | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """df in a written table with _r, the range of the row inside its group (ranges ascend with the order column), and a tie column.

    A null key is a group like others, a null order comes first. Rows of equal key and order go by a hash of all
    columns, so repeated numbers do not depend on how the rows were dealt out. `ranges` is the number of ranges over
    all groups (None: the session's number of partitions). `prepare` adds columns after the rows were dealt out, so
    that they are computed once; the input is read twice, once for the sample.
    """
    by = [F.col(c).asc_nulls_first() for c in (*keys, order, TIE)]
    d = df.withColumn(TIE, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    d = d.repartitionByRange(ranges, *by) if ranges else d.repartitionByRange(*by)
    d = d.withColumn("_r", F.spark_partition_id())
    return materialize(prepare(d) if prepare else d, "ranges")


def number_within(df: DataFrame, key: str | list[str], order: str, name: str, ranges: int | None = None) -> DataFrame:
    """Adds `name` = 1, 2, 3 ... per key in ascending `order`.

    Rows are numbered inside a range; the counts of the earlier ranges, a table
    of one row per group and range, give the offset.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rows = ranged(df, keys, order, ranges)
    before = F.sum("_c").over(W.partitionBy(*keys).orderBy("_r").rowsBetween(W.unboundedPreceding, -1))
    offsets = rows.groupBy(*keys, "_r").agg(F.count("*").alias("_c")).select(*keys, "_r", F.coalesce(before, F.lit(0)).alias("_off"))
    rn = F.row_number().over(W.partitionBy(*keys, "_r").orderBy(F.col(order).asc_nulls_first(), TIE))
    return (
        _same(rows.withColumn("_rn", rn), offsets, [*keys, "_r"])
        .withColumn(name, F.col("_rn") + F.col("_off"))
        .drop("_r", "_rn", "_off", TIE)
    )


def carry_forward(
    df: DataFrame, key: str | list[str], order: str, values: dict[str, str], ranges: int | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """For each name -> column adds the last non-null value of an earlier row of the same key.

    Inside a range a window looks back; where it finds nothing, the last value
    of the earlier ranges is taken from a table of one row per group and range.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rows = ranged(df, keys, order, ranges, prepare)
    here = W.partitionBy(*keys, "_r").orderBy(F.col(order).asc_nulls_first(), TIE).rowsBetween(W.unboundedPreceding, -1)
    past = W.partitionBy(*keys).orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    at = F.struct(F.col(order), F.col(TIE))
    tails = rows.groupBy(*keys, "_r").agg(
        *[F.max_by(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"))), F.when(F.col(c).isNotNull(), at)).alias(n) for n, c in values.items()]
    )
    tails = tails.select(*keys, "_r", *[F.last(F.col(n), ignorenulls=True).over(past).alias(f"_t_{n}") for n in values])
    out = _same(rows.select("*", *[F.last(F.col(c), ignorenulls=True).over(here).alias(f"_h_{n}") for n, c in values.items()]), tails, [*keys, "_r"])
    for n in values:
        out = out.withColumn(n, F.coalesce(F.col(f"_h_{n}"), F.col(f"_t_{n}.v"))).drop(f"_h_{n}", f"_t_{n}")
    return out.drop("_r", TIE)
