"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.text import let


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: Column, digits: int = 8) -> Column:
    """L2-normalized and rounded; a zero vector stays as it is."""
    doubles = F.transform(v, lambda x: x.cast("double"))
    return let(doubles, lambda d: let(norm(d), lambda n: F.when(n == 0, d).otherwise(F.transform(d, lambda x: F.round(x / n, digits)))))
