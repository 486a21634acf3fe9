"""Structured Streaming forms of the three stateful jobs."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from dossier.operators.evaluation import feedback_records
from dossier.sources.tables import upsert


def feedback_log(stream: DataFrame, path: str, rejects: str, checkpoint: str, available_now: bool = True):
    """Validates a feedback stream and appends it as JSON; rejected records go to their own folder."""
    def write(batch: DataFrame, epoch: int) -> None:
        records = feedback_records(batch).persist()
        valid = records.filter("reject_reason is null").drop("reject_reason")
        # One folder per batch: a batch that is run again after a failure replaces its own output.
        valid.select(*sorted(valid.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/batch={epoch}")
        records.filter("reject_reason is not null").write.mode("overwrite").json(f"{rejects}/batch={epoch}")
        records.unpersist()

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


STATE_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep keyed state in RocksDB; the caller's settings stay as they are."""
    own = spark.newSession()
    own.conf.set(*STATE_PROVIDER)
    return own


CONTEXT_STATE = T.StructType([T.StructField("topic", T.StringType()), T.StructField("section", T.StringType()), T.StructField("next_turn", T.LongType())])
TURN_STATE = T.StructType(
    [T.StructField("turn", T.LongType()), T.StructField("own_leave", T.BooleanType()), T.StructField("own_section", T.StringType()), T.StructField("asks_year", T.BooleanType()),
     T.StructField("is_unclear", T.BooleanType())]
)
CONTEXT_OUT = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("is_follow_up", T.BooleanType()),
     T.StructField("next_topic", T.StringType()), T.StructField("next_section", T.StringType())]
)


class ConversationContext(StatefulProcessor):
    """Carries the topic of a conversation from turn to turn, in the order of the turns, which count from 0.

    A turn that comes before its predecessor waits in the state. With a patience, a timer lets the conversation go on
    when a turn stays away. A turn that comes when later ones have gone on is answered from the topic as it is and changes nothing; a
    repeated turn gives its row again.
    """

    def __init__(self, patience_ms: int | None = None):
        self._patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", CONTEXT_STATE)
        self._waiting = handle.getListState("waiting", TURN_STATE)

    @staticmethod
    def _step(topic, section, turn):
        _, own_leave, own, asks_year, unclear = turn
        follow = bool(topic == "leave" and asks_year)
        if own_leave or follow:
            return follow, "leave", None
        if own or (unclear and topic == "section"):
            return follow, "section", own or section
        return follow, None, None

    def _go_on(self, key, turns: list, skip: bool) -> Iterator[pd.DataFrame]:
        topic, section, expected = self._last.get() if self._last.exists() else (None, None, 0)
        out, waiting = [], []
        for t in sorted(turns, key=lambda t: t[0]):
            if t[0] > expected and not skip:
                waiting.append(t)
                continue
            follow, to, at = self._step(topic, section, t)
            out.append((key[0], t[0], follow, to, at))
            if t[0] >= expected:
                topic, section, expected = to, at, t[0] + 1
        self._last.update((topic, section, expected))
        if waiting:
            self._waiting.put(waiting)
        else:
            self._waiting.clear()
        if self._patience is not None:
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
            if waiting:
                self._handle.registerTimer(int(time.time() * 1000) + self._patience)
        yield pd.DataFrame(out, columns=[f.name for f in CONTEXT_OUT])

    def _held(self) -> list:
        return [tuple(t) for t in self._waiting.get()] if self._waiting.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [f.name for f in TURN_STATE]
        new = [(int(t), bool(lv), s if isinstance(s, str) else None, bool(y), bool(un)) for frame in rows for t, lv, s, y, un in frame[names].itertuples(index=False, name=None)]
        yield from self._go_on(key, self._held() + new, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._go_on(key, self._held(), True)

    def close(self) -> None:
        pass


def conversation_context(turns: DataFrame, patience_ms: int | None = None) -> DataFrame:
    """Context per turn with keyed state. `turns` has conv_id, turn, own_leave, own_section, asks_year, is_unclear; its session is a `stateful_session`.

    A missing turn is waited for, with patience_ms only so long. Such timers go by the clock, so a stream with them runs
    until it is stopped; without them it may also run over what is there (availableNow).
    """
    if turns.sparkSession.conf.get(STATE_PROVIDER[0], "") != STATE_PROVIDER[1]:
        raise ValueError("read the turns with stateful_session(spark)")
    return turns.groupBy("conv_id").transformWithStateInPandas(ConversationContext(patience_ms), CONTEXT_OUT, "Append", "None" if patience_ms is None else "ProcessingTime")


# A table that a stream keeps up to date. Its rows lie in buckets of the key. The log has one entry per version that
# says which version wrote each bucket; a version writes only the buckets its batch touches.
BUCKETS = 64


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _log(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("bucket int, written int").parquet(f"{path}/log/version={version}")


def _write_version(rows: DataFrame, entries: DataFrame | None, path: str, version: int, key: str, buckets: int) -> None:
    """Writes the rows' buckets, then the log entry; both replace what an interrupted run of the same version left."""
    rows.withColumn("bucket", _bucket(key, buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={version}")
    spark = rows.sparkSession
    own = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{path}/data/version={version}").select("bucket", F.lit(version).alias("written")).distinct()
    log = own if entries is None else own.unionByName(entries)
    log.coalesce(1).write.mode("overwrite").parquet(f"{path}/log/version={version}")


def create_table(base: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Version 0 of a kept table."""
    base.limit(0).write.mode("overwrite").parquet(f"{path}/schema")
    _write_version(base, None, path, 0, key, buckets)


def newest_version(spark: SparkSession, path: str) -> int:
    return spark.read.schema("bucket int, written int, version int").parquet(f"{path}/log").agg(F.max("version")).first()[0] or 0


def read_table(spark: SparkSession, path: str, version: int | None = None, touched: list[int] | None = None) -> DataFrame:
    """The rows of a version (the newest by default), or of some of its buckets."""
    version = newest_version(spark, path) if version is None else version
    log = _log(spark, path, version)
    log = log if touched is None else log.filter(F.col("bucket").isin(touched))
    # One entry per bucket.
    paths = [f"{path}/data/version={r.written}/bucket={r.bucket}" for r in log.collect()]
    schema = spark.read.parquet(f"{path}/schema").schema
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def apply_epoch(batch: DataFrame, epoch: int, path: str, key: str, seq: str, buckets: int = BUCKETS) -> None:
    """Makes version epoch + 1 from version epoch and a batch of updates. A run that is repeated gives the same version."""
    spark = batch.sparkSession
    touched = [r.b for r in batch.select(_bucket(key, buckets).alias("b")).distinct().collect()]  # at most `buckets` numbers
    rows = upsert(read_table(spark, path, epoch, touched), batch, key, seq)
    _write_version(rows, _log(spark, path, epoch).filter(~F.col("bucket").isin(touched)), path, epoch + 1, key, buckets)


def continuous_upsert(stream: DataFrame, path: str, key: str, seq: str, checkpoint: str, buckets: int = BUCKETS):
    """Upserts every micro-batch of a stream into the table at `path` (see create_table).

    The base of an epoch is the version before it, found in the log, so a stream that is stopped and started again
    goes on where it was, and an epoch that is run twice gives the same version.
    """
    def apply(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        apply_epoch(batch, epoch, path, key, seq, buckets)
        batch.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
