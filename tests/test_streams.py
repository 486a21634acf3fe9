"""Streams that are stopped, restarted and fed out of order give the result of the batch job."""

import random
import time

import pytest
from pyspark.sql import functions as F

from dossier.streaming import jobs

TURNS = "conv_id long, turn long, own_leave boolean, own_section string, asks_year boolean, is_unclear boolean"


def conversations(n, seed=1):
    r = random.Random(seed)
    return [(c, t, r.random() < 0.2, f"s{r.randrange(3)}" if r.random() < 0.3 else None, r.random() < 0.5, r.random() < 0.3) for c in range(n) for t in range(r.randrange(1, 8))]


def in_order(rows):
    out = {}
    for c in {r[0] for r in rows}:
        topic = section = None
        for _, t, leave, own, year, unclear in sorted(r for r in rows if r[0] == c):
            follow = topic == "leave" and year
            if leave or follow:
                topic, section = "leave", None
            elif own or (unclear and topic == "section"):
                topic, section = "section", own or section
            else:
                topic = section = None
            out[c, t] = (follow, topic, section)
    return out


def context_writer(spark, root, patience=None):
    stream = jobs.stateful_session(spark).readStream.schema(TURNS).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    return jobs.conversation_context(stream, patience).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")


def run_context(spark, root):
    w = context_writer(spark, root).trigger(availableNow=True).start()
    assert w.awaitTermination(120)


def test_shuffled_turns_and_a_restart_give_the_batch_result(spark, tmp_path):
    rows = conversations(12)
    random.Random(2).shuffle(rows)
    half = len(rows) // 2
    before = spark.conf.get(jobs.STATE_PROVIDER[0], None)
    for part in (rows[:half], rows[half:]):
        spark.createDataFrame(part, TURNS).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        run_context(spark, tmp_path)
    got = {(r.conv_id, r.turn): (r.is_follow_up, r.next_topic, r.next_section) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == in_order(rows) and spark.conf.get(jobs.STATE_PROVIDER[0], None) == before


def test_a_missing_turn_is_waited_for_only_so_long(spark, tmp_path):
    rows = [(1, 0, True, None, False, False), (1, 2, False, None, True, False)]
    spark.createDataFrame(rows, TURNS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = lambda: {(r.conv_id, r.turn): r.next_topic for r in spark.read.schema(jobs.CONTEXT_OUT).parquet(f"{tmp_path}/out").collect()}
    w = context_writer(spark, tmp_path, patience=500).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(60):
            time.sleep(1)
            if w.lastProgress is not None and (1, 2) in seen():
                break
    finally:
        w.stop()
    assert seen() == {(1, 0): "leave", (1, 2): "leave"}


def test_the_session_must_keep_state_in_rocksdb(spark, tmp_path):
    spark.createDataFrame([], TURNS).write.parquet(f"{tmp_path}/in")
    with pytest.raises(ValueError, match="stateful_session"):
        jobs.conversation_context(spark.readStream.schema(TURNS).parquet(f"{tmp_path}/in"))


ROWS = "k long, v string, created_at int, seq int"


def updates(n, seed):
    r = random.Random(seed)
    return [(r.randrange(60), f"v{i}", 100 + i, i) for i in range(n)]


def expected(base, changes):
    out = {k: (v, c, s) for k, v, c, s in base}
    for k, v, c, s in sorted(changes, key=lambda x: x[3]):
        if k not in out or s >= out[k][2]:
            out[k] = (v, out[k][1] if k in out else min((x for x in changes if x[0] == k), key=lambda x: 0)[2], s)
    return out


def rows_of(df):
    return {r.k: (r.v, r.seq) for r in df.collect()}


def test_upserts_survive_a_stop_a_restart_and_a_repeated_epoch(spark, tmp_path, monkeypatch):
    base, changes = [(k, f"b{k}", 1, -1) for k in range(40)], updates(90, 3)
    random.Random(4).shuffle(changes)  # older updates also come after newer ones
    path = f"{tmp_path}/table"
    jobs.create_table(spark.createDataFrame(base, ROWS), path, "k", 8)
    run = lambda: jobs.continuous_upsert(spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), path, "k", "seq", f"{tmp_path}/state", 8).awaitTermination()
    spark.createDataFrame(changes[:30], ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    spark.createDataFrame(changes[30:60], ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    # The second epoch writes its version, then the stream dies before Spark notes the epoch as done.
    apply = jobs.apply_epoch

    def dies(*args):
        apply(*args)
        raise RuntimeError("stopped")

    monkeypatch.setattr(jobs, "apply_epoch", dies)
    with pytest.raises(Exception, match="stopped"):
        run()
    half_way = rows_of(jobs.read_table(spark, path))
    monkeypatch.setattr(jobs, "apply_epoch", apply)
    run()  # the epoch is run again
    assert rows_of(jobs.read_table(spark, path)) == half_way and jobs.newest_version(spark, path) == 2
    spark.createDataFrame(changes[60:], ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    want = {k: (v, s) for k, (v, _, s) in expected(base, changes).items()}
    assert rows_of(jobs.read_table(spark, path)) == want
    assert rows_of(jobs.read_table(spark, path, 0)) == {k: (v, s) for k, v, _, s in base}
    assert all(r.created_at == 1 for r in jobs.read_table(spark, path).filter("k < 40").collect())


def test_an_epoch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    path = f"{tmp_path}/table"
    jobs.create_table(spark.createDataFrame([(k, "b", 1, 0) for k in range(200)], ROWS), path, "k", 16)
    jobs.apply_epoch(spark.createDataFrame([(5, "new", 2, 1), (5, "newer", 2, 2)], ROWS), 0, path, "k", "seq", 16)
    assert spark.read.parquet(f"{path}/data/version=1").select("bucket").distinct().count() == 1
    assert rows_of(jobs.read_table(spark, path).filter("k = 5")) == {5: ("newer", 2)} and jobs.read_table(spark, path).count() == 200
    empty = spark.createDataFrame([], ROWS)
    jobs.apply_epoch(empty, 1, path, "k", "seq", 16)
    assert jobs.read_table(spark, path, 2).count() == 200


def test_a_table_may_begin_empty(spark, tmp_path):
    path = f"{tmp_path}/table"
    jobs.create_table(spark.createDataFrame([], ROWS), path, "k", 4)
    assert jobs.read_table(spark, path).count() == 0
    jobs.apply_epoch(spark.createDataFrame([(1, "x", 5, 1)], ROWS), 0, path, "k", "seq", 4)
    assert [tuple(r) for r in jobs.read_table(spark, path).collect()] == [(1, "x", 5, 1)]


def test_each_embedding_call_is_a_batch_of_the_plan(spark):
    import hashlib

    from dossier.operators import features, ingest

    d = spark.range(103).select((F.col("id") % 7).alias("doc_id"), F.col("id").alias("chunk_no"), F.concat(F.lit("员工 旷工 chunk "), F.col("id").cast("string")).alias("text"))
    batched = ingest.numbered_batches(d.repartition(5), ["doc_id", "chunk_no"], 16)

    def embed(texts):
        """One vector per text as `features.embed` makes it, behind the size of the call and a digest of its texts."""
        assert 0 < len(texts) <= 16
        digest = float(int(hashlib.sha256("|".join(texts).encode()).hexdigest()[:8], 16))
        out = []
        for x in texts:
            t = "".join(x.split()).lower()
            v = [float(sum(t.count(w) * len(w) for w in terms)) for _, terms in features.TERM_FEATURES] + [0.0] * 8
            for ch in t:
                v[8 + int.from_bytes(hashlib.blake2b(ch.encode(), digest_size=2).digest(), "big") % 8] += 0.15
            n = sum(y * y for y in v) ** 0.5
            out.append([float(len(texts)), digest, *[y / n for y in v]])
        return out

    got = ingest.embed_in_batches(batched, "text", embed)
    rows = got.orderBy("position").collect()
    assert [(r.doc_id, r.chunk_no) for r in rows] == sorted((i % 7, i) for i in range(103))
    plan = {r.batch_no: (r.batch_chunks, r.first_position, r.last_position) for r in ingest.batch_plan(batched).collect()}
    assert plan == {b: (min(16, 103 - 16 * b), 16 * b + 1, min(103, 16 * b + 16)) for b in range(7)}
    assert all(r.embedding[0] == plan[r.batch_no][0] for r in rows) and len({r.embedding[1] for r in rows}) == 7
    again = {r.position: r.embedding[1] for r in ingest.embed_in_batches(batched.repartition(3), "text", embed).collect()}
    assert again == {r.position: r.embedding[1] for r in rows}
    want = {r.text: r.v for r in features.embed(d.select("text"), "text", "v").collect()}
    assert all(abs(a - b) < 1e-7 for r in rows for a, b in zip(r.embedding[2:], want[r.text]))
