"""Streaming jobs run over the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.functions.session import shared_dir
from dossier.operators import understanding as u
from dossier.plans.evaluation_queries import FEEDBACK_SQL, feedback
from dossier.plans.registry import query, table
from dossier.plans.sources_queries import UPSERT_SQL, labelled_updates
from dossier.plans.understanding_queries import FOLLOW_UP_SQL, questions
from dossier.streaming import jobs


@query(
    "l1_feedback_stream",
    f"WITH f AS ({FEEDBACK_SQL}) SELECT event_id, query, known AS feedback_type, answer, comment FROM f WHERE query <> '' AND event_type <> 'error'",
)
def l1_feedback_stream(spark, sf_dir):
    root = shared_dir(spark, "feedback-stream")
    feedback(spark, sf_dir).repartition(4).write.parquet(f"{root}/in")
    schema = spark.read.parquet(f"{root}/in").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    jobs.feedback_log(stream, f"{root}/out", f"{root}/rejects", f"{root}/state").awaitTermination()
    return spark.read.schema("event_id bigint, query string, feedback_type string, answer string, comment string").json(f"{root}/out/*")


@query(
    "l2_context_stream",
    f"SELECT conv_id, CAST(turn AS BIGINT) AS turn, is_follow_up, next_topic, next_section FROM ({FOLLOW_UP_SQL})",
)
def l2_context_stream(spark, sf_dir):
    """Turns arrive in shuffled order over several micro-batches."""
    root = shared_dir(spark, "context-stream")
    d = u.with_context(questions(spark, sf_dir)).select("conv_id", F.col("turn").cast("bigint").alias("turn"), "own_leave", "own_section", "asks_year", "is_unclear")
    d.repartition(6, F.xxhash64("conv_id", "turn")).write.parquet(f"{root}/in")
    stream = jobs.stateful_session(spark).readStream.schema(d.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    w = jobs.conversation_context(stream).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
    w.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(jobs.CONTEXT_OUT).parquet(f"{root}/out")


@query("l3_upsert_stream", UPSERT_SQL)
def l3_upsert_stream(spark, sf_dir):
    root = shared_dir(spark, "upsert-stream")
    base = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.lit(1).alias("created_at"), F.lit(0).alias("seq"))
    jobs.create_table(base, f"{root}/table", "doc_id")
    updates = labelled_updates(spark, sf_dir)
    updates.repartition(4, F.xxhash64("doc_id", "seq")).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(updates.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    jobs.continuous_upsert(stream, f"{root}/table", "doc_id", "seq", f"{root}/state").awaitTermination()
    return jobs.read_table(spark, f"{root}/table").select("doc_id", "lang", F.md5("text").alias("text_md5"), "created_at")
