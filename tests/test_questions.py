import pytest
from pyspark.sql import functions as F

from dossier.operators import chain, features
from dossier.operators import understanding as u
from dossier.plans.evidence_queries import FRAGMENTS


def spec(spark, text):
    return u.lookup_spec(spark.createDataFrame([(1, text)], "query_id long, query string")).first().spec


def test_two_day_rule(spark):
    s = spec(spark, "我旷工两天会受到什么处罚")
    assert (s.rule_id, s.comparison, s.user_fact) == ("absence_under_3_workdays", "2 < 3", "旷工 2 天")
    assert list(s.expected_evidence) == ["扣除旷工期间工资", "记过处分"]


def test_occurrences_come_before_days(spark):
    assert spec(spark, "一年内旷工两次，共三天怎么处理").rule_id == "absence_twice_or_more_in_one_year"


def test_student_questions_get_no_employee_rule(spark):
    assert spec(spark, "学生迟到怎么处理").target_behavior is None


def test_false_reimbursement_and_ambiguity(spark):
    s = spec(spark, "虚假报销属于什么违规")
    assert (s.target_section, s.target_clause, s.target_subclause, s.target_clause_no) == ("二类违规行为", "4. 弄虚作假行为", "4.3", "4")
    a = spec(spark, "破坏学校管理秩序行为是什么")
    assert a.retrieval_intent == "ambiguous_policy_lookup" and len(a.ambiguity_options) == 3


def test_condition_note_follows_missing_terms(spark):
    d = spark.createDataFrame([("骂人有什么处罚",), ("骂客户被投诉有什么处罚",), ("骂人被客户投诉有什么处罚",)], "query string")
    got = [list(r.intent.missing_conditions) for r in u.understand(d).collect()]
    assert got == [["对象为客户或来访者", "并引起投诉"], [], []]


@pytest.fixture(scope="module")
def golden_chunks(spark):
    rows = [
        (i, f"doc-{i}", f"b-{i}", t, list(h), sec, cl, [x for x in (sec, cl) if x], ct, list(it), co, h[0] + ".md", " ".join(x for x in (h[0] + ".md", sec, cl, ct) if x))
        for i, (t, h, sec, cl, ct, it, co) in enumerate(FRAGMENTS)
    ]
    schema = ("chunk_id long, doc_id string, block_id string, text string, heading array<string>, section_title string, clause_title string, section_path array<string>, "
              "chunk_type string, items array<string>, continuity string, source string, meta_text string")
    return features.embed(spark.createDataFrame(rows, schema), "text")


@pytest.fixture(scope="module")
def golden(spark, golden_chunks):
    asked = ["工作五年有几天年假", "二类违规是什么", "二类违规有哪些", "我旷工两天会受到什么处罚", "旷工三天会怎样", "早退两次怎么处理", "学生迟到怎么处理", "骂人有什么处罚", "打听工资属于什么违规",
             "虚假报销怎么处罚", "破坏学校管理秩序行为是什么", "我没有违规"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    return {r.query: r for r in chain.answer_questions(q, golden_chunks, 5).collect()}


@pytest.mark.parametrize(
    "question, branch, words",
    [
        ("工作五年有几天年假", "tier", ["18天", "第六年及以后 20天"]),
        ("二类违规是什么", "definition", ["二类违规行为：指严重损害学校声誉的行为。"]),
        ("二类违规有哪些", "listing", ["二类违规主要包括", "1. 师德师风相关的违规行为", "编号不连续"]),
        ("我旷工两天会受到什么处罚", "absence", ["事实：旷工 2 天", "连续旷工3个工作日以下", "扣除旷工期间工资", "给予记过处分", "5.2旷工少于三天"]),
        ("旷工三天会怎样", "absence", ["连续旷工3个工作日及以上", "给予辞退处分", "一类违规行为"]),
        ("早退两次怎么处理", "behavior", ["事实：早退", "一学年中出现两次", "三类违规行为", "书面或口头警告"]),
        ("学生迟到怎么处理", "nothing", ["没有在当前制度样本中检索到足够相关的内容"]),
        ("骂人有什么处罚", "behavior", ["如果满足条款条件", "对象为客户或来访者", "并引起投诉", "书面或口头警告"]),
        ("打听工资属于什么违规", "behavior", ["二类违规行为中的违反保密义务行为", "2.3打听工资"]),
        ("虚假报销怎么处罚", "behavior", ["弄虚作假行为", "4.3虚假报销", "记过处分"]),
        ("破坏学校管理秩序行为是什么", "ambiguity", ["1. 二类违规行为", "3. 三类违规行为"]),
        ("我没有违规", "clarify", ["请描述具体行为"]),
    ],
)
def test_golden_questions(golden, question, branch, words):
    r = golden[question]
    assert r.branch == branch, (r.branch, r.answer)
    assert [w for w in words if w not in r.answer] == [], r.answer


def test_report_has_plan_citations_checks_and_own_limits(spark, golden_chunks):
    asked = [(0, "二类违规有哪些", 5), (1, "我旷工两天会受到什么处罚", 5), (2, "学生迟到怎么处理", 5), (3, "我没有违规", 5), (4, "差旅报销流程怎么申请", 1), (5, "差旅报销流程怎么申请", 3)]
    rows = {r.query_id: r for r in chain.answer_report(spark.createDataFrame(asked, "query_id long, query string, top_k int"), golden_chunks, 5).collect()}
    assert len(rows) == 6
    assert rows[1].answer_type == "disciplinary_action" and rows[1].required_citations and rows[1].lacking is None
    assert "freshness_conflict" in rows[1].warnings and "context_assembly" not in rows[1].warnings
    assert rows[2].branch == "nothing" and "context_assembly" in rows[2].warnings and rows[2].answer_type == "insufficient_evidence"
    assert rows[3].branch == "clarify" and rows[3].answer_type is None and rows[3].warnings is None
    # Two fragments are about reimbursement.
    assert rows[4].source_chunk_ids == [11] and rows[5].source_chunk_ids == [11, 9]


def test_equal_questions_are_searched_once(spark, golden_chunks, monkeypatch):
    class Searched(Exception):
        pass

    def search(asked, *rest):
        raise Searched(asked.count())

    monkeypatch.setattr(chain.retrieval, "hybrid_top_k", search)
    asked = spark.createDataFrame([(i, ("二类违规有哪些", "我旷工两天会受到什么处罚")[i % 2]) for i in range(40)], "query_id long, query string")
    for answer in (chain.answer_questions, chain.answer_report):
        with pytest.raises(Searched) as stopped:
            answer(asked, golden_chunks, 3)
        assert stopped.value.args == (2,)


def test_every_question_gets_the_row_of_its_words(spark):
    rows = [(1, "a", None), (2, "a", None), (3, "a", 2), (4, None, 1), (5, None, 1), (6, "b", 2)]
    seen = []

    def answered(distinct):
        seen.append(sorted(r.query_id for r in distinct.collect()))
        return distinct.select("query_id", F.concat_ws("-", "query", "top_k").alias("answer"))

    got = chain._each_once(spark.createDataFrame(rows, "query_id long, query string, top_k int"), answered).collect()
    assert sorted((r.query_id, r.answer) for r in got) == [(1, "a"), (2, "a"), (3, "a-2"), (4, "1"), (5, "1"), (6, "b-2")]
    assert seen == [[1, 3, 4, 6]]
