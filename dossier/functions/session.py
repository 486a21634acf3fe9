"""Session-level helpers: shared folders and size checks."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives the executors a zip of this package, once per application, so that its functions load there."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(home):  # a package that runs from a zip has been shipped already
        path = os.path.join(tempfile.mkdtemp(prefix="spark-ship-"), f"{os.path.basename(home)}.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(home):
                for n in names:
                    if n.endswith(".py"):
                        z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(home)))
        spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    A session of several machines that names none is an error. On a single
    machine (tests) a temporary folder of this application is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="spark-dossier-")
        root = _LOCAL[app]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def by_shuffle(df: DataFrame) -> DataFrame:
    """Marks a table for a sort-merge join.

    The size of exploded rows and of rows made in Python is estimated from the file they come from, which is far too
    low: such a table would be collected in the driver and broadcast.
    """
    return df.hint("merge")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by key to four tasks a core, a number that the adaptive planner keeps; a join on the key needs no other shuffle."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def filled_lists(df: DataFrame, *names: str) -> DataFrame:
    """Empty arrays for null ones, for rows on their way to Python.

    The Arrow writer looks at the size of its batch after every row, and each look goes over all null lists since the
    last one that is not null: a column of null lists costs the square of the rows of a batch.
    """
    return df.withColumns({n: F.coalesce(n, F.array().cast(df.schema[n].dataType)) for n in names})


#: Rows whose Python objects a task holds at a time.
SLICE_ROWS = 128


def slices(batches, rows: int = SLICE_ROWS):
    """Arrow batches in pieces of a few rows, so that the Python objects made of them do not grow with the batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        batch = None  # else it is held while the next one is read


def map_slices(df: DataFrame, make, schema: T.StructType) -> DataFrame:
    """mapInArrow of make(batch) -> batch over small pieces of the rows."""
    return df.mapInArrow(lambda batches: map(make, slices(batches)), schema)


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when the table has at most `max_rows` rows. Stops reading right after the bound."""
    return df.limit(max_rows + 1).count() <= max_rows


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes an intermediate table to the shared folder and reads it back.

    Used where several branches read one costly table: it is computed once, and
    a lost executor costs a re-read, not a recomputation.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
