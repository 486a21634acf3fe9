"""Turns after overrides, score forms, keys without a block, answers without a year."""

from pyspark.sql import functions as F

from dossier.operators import answers, evidence, retrieval
from dossier.operators import understanding as u


def turns(spark, *texts):
    d = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "conv_id long, turn int, query string")
    d = u.follow_up(u.resolve_ambiguity(u.with_context(d)))
    d = u.next_context(u.resolved(u.understand(u.lookup_spec(d, context_clause="context_clause"))))
    return d.orderBy("turn").collect()


def test_year_inherits_the_leave_topic_and_hands_it_on(spark):
    first, second, third = turns(spark, "员工年假规则是什么？", "那工作第三年呢", "那第六年及以后呢")
    assert first.resolved.inherited_because is None and first.next_context.target_object == "年休假"
    for r, year in ((second, 3), (third, 6)):
        assert (r.resolved.category, r.resolved.audience, r.resolved.answer_aspect) == ("leave", "employee", "annual_leave_days")
        assert (r.resolved.schema.target_object, r.resolved.schema.work_year, r.resolved.schema.confidence) == ("年休假", year, 0.9)
        assert list(r.resolved.schema.evidence_types) == ["table_evidence"] and "missing_audience" not in r.resolved.flags
        assert r.next_context.category == "leave"


def test_year_without_leave_topic_inherits_nothing(spark):
    _, r = turns(spark, "二类违规是什么", "那工作第三年呢")
    assert r.resolved.inherited_because is None and r.resolved.schema.work_year is None and r.next_context is None


def test_self_judgement_loses_its_targets(spark):
    (r,) = turns(spark, "我没有违规。")
    s = r.resolved
    assert (s.intent, s.retrieval_intent, s.answer_aspect) == ("unsupported_policy_assertion", "unsupported_policy_assertion", None)
    assert list(s.target_terms) == [] and s.flags[-1] == "needs_specific_behavior"
    assert list(s.schema.missing_conditions) == ["具体行为", "发生时间", "对象/影响范围"]


def test_context_makes_an_unclear_clause_exact(spark):
    first, second = turns(spark, "二类违规是什么", "破坏学校管理秩序行为包括什么内容")
    assert first.resolved.intent == "policy_definition_lookup"
    assert second.resolved.intent == "policy_clause_detail_lookup" and second.next_context.target_section == "二类违规行为"


def scored(spark, fn, given, schema):
    cands = spark.createDataFrame([(q, r, float(r)) for q in range(1, 5) for r in (1, 2)], "query_id long, rank_before int, deterministic_score double")
    rows = fn(cands, spark.createDataFrame(given, schema), "x").collect()
    assert len(rows) == 8
    return {(r.query_id, r.rank_before): (r.reranker_source, r.reranker_score, r.rerank_score) for r in rows}, {r.query_id: r.reranker_error for r in rows}


def test_listed_scores(spark):
    got, err = scored(spark, retrieval.listed_scores, [(1, [0.5, 0.25]), (2, [0.5]), (3, None)], "query_id long, scores array<double>")
    assert got[1, 1] == ("x", 0.5, 1.5) and got[1, 2] == ("x", 0.25, 2.25)
    assert got[2, 1] == ("x_invalid_fallback", None, 1.0) and err[2] == "expected 2 scores, got 1"
    assert got[3, 2] == ("x_failed_fallback", None, 2.0) and got[4, 1] == ("deterministic_fallback", None, 1.0)


def test_response_scores(spark):
    bodies = [
        (1, '{"results": [{"index": 1, "score": 9}, {"index": 0, "score": 0.5}, {"index": 1, "score": 0.25}]}'), (2, '{"scores": [1], "results": [{"index": 0, "score": 1}]}'),
        (3, '{"results": [{"index": 0, "score": 1}, {"index": 5, "score": 1}]}'), (4, None),
    ]
    got, err = scored(spark, retrieval.response_scores, bodies, "query_id long, body string")
    assert got[1, 1] == ("x", 0.5, 1.5) and got[1, 2] == ("x", 0.25, 2.25) and err[1] is None
    assert err[2] == "expected 2 rerank scores, got 1" and err[3] == "rerank result index out of range: 5" and err[4] == "rerank response must contain scores or results"
    assert {got[q, 1][0] for q in (2, 3, 4)} == {"x_failed_fallback"}


def test_listing_keys_fall_back_to_the_heading_path(spark):
    rows = [(1, None, ["制度", "一"]), (2, "", ["制度", "一"]), (3, None, ["制度", "二"]), (4, None, []), (5, None, []), (6, "b", ["制度", "一"])]
    d = spark.createDataFrame(rows, "chunk_id long, block_id string, heading array<string>").withColumn("doc_id", F.lit("d")).withColumn("query", F.lit("二类违规有哪些"))
    null = F.lit(None).cast("string")
    d = d.withColumn("text", F.lit("见附表。")).withColumn("section_title", null).withColumn("clause_title", null).withColumn("chunk_type", null).withColumn("section_path", F.array().cast("array<string>"))
    d = u.understand(u.lookup_spec(d)).withColumn("query_id", F.lit(1)).withColumn("rank", F.col("chunk_id"))
    got = {r.chunk_id: r.is_duplicate for r in evidence.dedupe(d).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: False, 6: False}


def test_no_asked_year_gives_no_days(spark):
    d = spark.createDataFrame([(3,), (9,), (None,)], "y int").withColumn("t", F.create_map(*[F.lit(x) for i in range(1, 7) for x in (i, 10 * i)]))
    assert [r[0] for r in d.select(answers.tier_days(F.col("t"), F.col("y"))).collect()] == [30, 60, None]
