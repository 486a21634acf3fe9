"""Queries over retrieved evidence.

Candidates are derived from the documents: eight neighbours form the candidate
list of one question, each text starts with a policy fragment and goes on with
the document's own text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier import rules
from dossier.functions.session import materialize
from dossier.operators import evidence as ev
from dossier.operators import retrieval
from dossier.operators import understanding as u
from dossier.plans.registry import query, table, texts
from dossier.plans.understanding_queries import (
    _CLAUSE, _EXPANDED, _INTENT, _SECTION, _TERMS_SQL, INTENT_ASPECT, OBJECT, QUESTIONS, ZH, _list, any_sql, by_question, case_sql, q, _BEHAVIOR,
)

P3, P2 = "三类违规行为", "二类违规行为"
# text, heading, section title, clause title, chunk type, items, continuity
FRAGMENTS = (
    ("带薪年假天数如下：第一年 第二年 第三年 第四年 第五年 第六年及以后 10天 12天 14天 16天 18天 20天。", ("员工休假管理办法", "第三条 年休假"), None, None, "clause", (), None),
    ("员工迟到、早退按考勤制度处理。", ("考勤管理制度", "第五条"), None, None, "clause", (), None),
    ("（三）旷工 连续旷工3个工作日以下的，扣除旷工期间工资，并给予记过处分；连续旷工3个工作日及以上的，扣除旷工期间工资，并给予辞退处分。考勤结果另行公布。", ("工作时间及假期管理制度", "旷工处理"), None, None, "clause", (), None),
    ("（二）二类违规行为 二类违规行为：指严重损害学校声誉的行为。 5. 破坏学校管理秩序行为 5.1渎职造成损失。 5.2旷工少于三天。", ("员工纪律制度", P2, "5. 破坏学校管理秩序行为"), P2, "5. 破坏学校管理秩序行为", "clause_group", (), None),
    ("二类违规行为 1. 师德师风相关的违规行为 2. 违反保密义务行为 4. 弄虚作假行为", ("员工纪律制度", P2), P2, None, "section_children", ("1. 师德师风相关的违规行为", "2. 违反保密义务行为", "4. 弄虚作假行为"), "incomplete"),
    ("（一）一类违规行为 一类违规行为：指性质恶劣的行为。 连续旷工3个工作日及以上属于一类违规行为。", ("员工纪律制度", "一类违规行为"), "一类违规行为", None, "clause", (), None),
    ("（三）三类违规行为 三类违规行为：指一般的行为。 5. 破坏学校管理秩序行为 5.1一学年中出现两次及两次以上迟到、早退。", ("员工纪律制度", P3, "5. 破坏学校管理秩序行为"), P3, "5. 破坏学校管理秩序行为", "clause_group", (), None),
    ("4. 侵犯学校权益行为 4.2对客户、来访者怠慢或语言不得体，并引起投诉，属于三类违规行为。", ("员工纪律制度", P3, "4. 侵犯学校权益行为"), P3, "4. 侵犯学校权益行为", "clause_group", (), None),
    ("2. 违反保密义务行为 2.3打听、讨论员工工资，属于二类违规行为。 3. 侵犯学校权益行为 3.1其他。", ("员工纪律制度", P2, "2. 违反保密义务行为"), P2, "2. 违反保密义务行为", "clause_group", (), None),
    ("4. 弄虚作假行为 4.3虚假报销，例如报销未发生的费用，属于二类违规行为。 5. 破坏学校管理秩序行为 5.1其他。", ("员工纪律制度", P2, "4. 弄虚作假行为"), P2, "4. 弄虚作假行为", "clause_group", (), None),
    ("五、违规行为相应处理 1.1一类违规行为：解除劳动合同。1.2二类违规行为：予以记过处分，取消年终奖。1.3三类违规行为：予以书面或口头警告。", ("员工纪律制度", "违规行为相应处理"), None, None, "clause", (), None),
    ("差旅报销流程：提交申请，经审批后办理；二类违规行为详见《员工纪律制度》。", ("费用报销制度", "第八条"), None, None, "clause", (), None),
)
N = len(FRAGMENTS)


def _fragment_literal():
    s = lambda v: F.lit(v).cast("string")
    arr = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>") if xs else F.array().cast("array<string>")
    return F.array(*[
        F.struct(F.lit(t).alias("text"), arr(h).alias("heading"), s(sec).alias("section_title"), s(cl).alias("clause_title"), s(ct).alias("chunk_type"), arr(it).alias("items"), s(co).alias("continuity"))
        for t, h, sec, cl, ct, it, co in FRAGMENTS
    ])


def question_rows(keys):
    """Adds query, spec, intent and hints to a table of query_ids."""
    t, n = (F.col("query_id") % len(QUESTIONS)).cast("int"), (F.col("query_id") % 5 + 1).cast("int")
    text = F.get(F.array(*[F.lit(x) for x in QUESTIONS]), t)
    text = F.replace(F.replace(text, F.lit("{n}"), n.cast("string")), F.lit("{zh}"), F.get(F.array(*[F.lit(x) for x in ZH]), n - 1))
    d = u.understand(u.lookup_spec(keys.withColumn("query", text)))
    return d.withColumn("hints", u.hints(F.col("query")))


def specs(spark, sf_dir):
    """The specs of all questions: a table of their own, written once per query and read by its stages."""
    ids = texts(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 8).alias("query_id")).distinct()
    return materialize(question_rows(ids), "specs")


def fragment_rows(spark, sf_dir):
    """One candidate per document, without the question it belongs to."""
    k = F.col("doc_id")
    docs = texts(spark, sf_dir, "documents").select("doc_id", "text", F.floor(k / 8).alias("query_id"), (k % 8 + 1).cast("int").alias("rank"))
    f = F.get(_fragment_literal(), ((F.col("query_id") + F.col("rank") * 5) % N).cast("int"))
    d = docs.withColumn("f", f).withColumn("f_no", (F.col("query_id") + F.col("rank") * 5) % N)
    d = d.select(
        "query_id", "rank", k.alias("chunk_id"), F.concat(F.lit("doc-"), F.col("f_no") % 3).alias("doc_id"), F.concat(F.lit("block-"), "f_no").alias("block_id"),
        F.concat("f.text", F.lit(" "), "text").alias("text"), "f.heading", "f.section_title", "f.clause_title", "f.chunk_type", "f.items", "f.continuity",
        F.array_compact(F.array("f.section_title", "f.clause_title")).alias("section_path"), F.when(F.col("f_no") != 1, F.concat("f.chunk_type", F.lit(".md"))).alias("source"),
        ((k % 100) / 100.0).alias("distance"), F.lit(False).alias("scope_applied"),
    )
    return d.withColumn("meta_text", F.concat_ws(" ", "source", "section_title", "clause_title", "chunk_type"))


def candidates(spark, sf_dir):
    return fragment_rows(spark, sf_dir).join(specs(spark, sf_dir), "query_id")


def _nullable(xs):
    return "[" + ", ".join("NULL" if x is None else "'" + x + "'" for x in xs) + "]"


def _lists(xs):
    return "[" + ", ".join(_list(x) + "::VARCHAR[]" if not x else _list(x) for x in xs) + "]"


_SUB = "CASE t WHEN 10 THEN '5.1' WHEN 12 THEN '4.2' WHEN 13 THEN '2.3' WHEN 14 THEN '4.3' WHEN 16 THEN '5.' || n WHEN 19 THEN '1.1' END"
_E = "[]::VARCHAR[]"
ASKED = f"""
    ids AS (SELECT DISTINCT doc_id // 8 AS query_id FROM documents),
    nq AS (SELECT query_id, CAST(query_id % {len(QUESTIONS)} AS INT) AS t, CAST(query_id % 5 + 1 AS INT) AS n FROM ids),
    tq AS (SELECT *, replace(replace({_list(QUESTIONS)}[t + 1], '{{n}}', CAST(n AS VARCHAR)), '{{zh}}', {_list(ZH)}[n]) AS q FROM nq),
    spec AS (SELECT *, {_INTENT} AS ri, {_SECTION} AS sec, {_CLAUSE} AS cl, {_SUB} AS sub, {_TERMS_SQL} AS terms,
       {by_question('beh', [(t, q(b)) for t, b, _ in _BEHAVIOR if t != 11])}, {by_question('label', [(t, q(x)) for t, _, x in _BEHAVIOR if t != 11])},
       CASE WHEN t IN (4, 17) THEN 'clause_detail' WHEN t IN (6, 7, 8, 9, 10, 11, 12, 14, 19) THEN 'disciplinary_action' END AS asked,
       CASE WHEN t IN (4, 17) THEN 'clause_detail' ELSE {case_sql('q', rules.RESOLVER_ASPECTS)} END AS ans,
       CASE WHEN t IN (3, 5, 6, 13, 14, 17, 19) THEN ['一类违规行为', '三类违规行为'] WHEN t IN (10, 12) THEN ['一类违规行为', '二类违规行为'] ELSE {_E} END AS exs,
       CASE WHEN t = 14 THEN ['3. 侵犯学校权益行为', '5. 破坏学校管理秩序行为'] ELSE {_E} END AS exc,
       CASE WHEN t IN (7, 8, 9) THEN {_list(rules.ABSENCE_TITLES)} WHEN t IN (10, 12, 13, 14, 17, 19) THEN {_list(rules.CONDUCT_TITLES)} ELSE {_E} END AS titles,
       CASE WHEN t IN (7, 8) AND n < 3 THEN 'continuous_absence_under_3_workdays' WHEN t IN (7, 8) THEN 'continuous_absence_3_or_more_workdays' WHEN t = 9 AND n >= 2 THEN 'absence_twice_or_more_in_one_year' END AS thr,
       CASE WHEN t IN (7, 8) AND n < 3 THEN {_list(rules.RULES[0]['classes'])} WHEN t IN (7, 8) THEN {_list(rules.RULES[1]['classes'])} WHEN t = 9 AND n >= 2 THEN {_list(rules.RULES[2]['classes'])} ELSE {_E} END AS classes,
       {INTENT_ASPECT} AS iasp, {OBJECT} AS obj, {_EXPANDED} AS exraw,
       coalesce({case_sql('q', rules.CATEGORY_HINTS)}, 'general') AS cat, t = 11 AS student,
       list_filter({_list(rules.EXTRACTED_TERMS)}, lambda x: contains(q, x)) AS hterms,
       CASE WHEN t = 12 THEN ['对象为客户或来访者', '并引起投诉'] ELSE {_E} END AS missing FROM tq)
"""


def any_of(field, lst):
    return f"len(list_filter({lst}, lambda x: contains({field}, x))) > 0"


_SHARED = "CASE sec " + " ".join(f"WHEN '{s}' THEN {_list(v)}" for s, v in rules.SHARED_MARKERS) + f" ELSE {_E} END"
_VARIANTS = "['（一）' || sec, '（二）' || sec, '（三）' || sec, sec || '：', sec || ':']"
CAND = ASKED + f""",
    base AS (SELECT d.doc_id AS chunk_id, s.*, CAST(d.doc_id % 8 + 1 AS INT) AS rank, (s.query_id + (d.doc_id % 8 + 1) * 5) % {N} AS f, d.text AS own FROM documents d JOIN spec s ON d.doc_id // 8 = s.query_id),
    cand0 AS (SELECT *, {_list([x[0] for x in FRAGMENTS])}[f + 1] || ' ' || own AS text, {_lists([x[1] for x in FRAGMENTS])}[f + 1] AS heading,
       {_nullable([x[2] for x in FRAGMENTS])}[f + 1] AS section_title, {_nullable([x[3] for x in FRAGMENTS])}[f + 1] AS clause_title, {_list([x[4] for x in FRAGMENTS])}[f + 1] AS chunk_type,
       'doc-' || (f % 3) AS doc, 'block-' || f AS block_id, (chunk_id % 100) / CAST(100.0 AS DOUBLE) AS distance,
       list_concat(list_concat(list_filter([sec, regexp_replace(sec, '行为$', ''), cl, sub, label], lambda x: x IS NOT NULL), {_SHARED}), CASE WHEN beh = 'absenteeism' THEN {_list(rules.ABSENCE_TERMS)} ELSE {_E} END) AS markers FROM base),
    cand1 AS (SELECT *, CASE WHEN f <> 1 THEN chunk_type || '.md' END AS source, array_to_string(heading, ' ') AS head FROM cand0),
    cand2 AS (SELECT *, text || ' ' || head || ' ' || concat_ws(' ', source, section_title, clause_title, chunk_type) AS h,
       coalesce(ans = 'section_listing', false) OR coalesce(asked = 'section_listing', false) OR coalesce(iasp = 'section_listing', false) AS listing,
       coalesce(ans = 'clause_detail', false) OR coalesce(asked = 'clause_detail', false) AS detail, coalesce(asked = 'disciplinary_action', false) AS act,
       ri = 'exact_policy_lookup' AS exact FROM cand1),
    cand3 AS (SELECT *, {any_of('text', 'markers')} AS marker, act AND {any_sql('text', rules.ACTION_RETRIEVAL)} AS aspect, {any_sql('text', rules.CLASS_SIGNALS)} AS signal,
       sec IS NOT NULL AND ({any_of('text', _VARIANTS)} OR regexp_matches(text, coalesce(sec, '~') || '\\s*[：:,，]?\\s*指')) AS defined,
       coalesce(contains(text, cl), false) AS in_cl, coalesce(contains(text, sub), false) AS in_sub, coalesce(contains(text, sec), false) AS in_sec, coalesce(contains(text, label), false) AS in_label FROM cand2),
    cand4 AS (SELECT *, exact AND (in_cl OR in_sub OR in_sec OR {any_of('text', 'terms')}) AND NOT (defined OR in_cl) AND {any_sql('text', rules.REFERENCE_TERMS)} AS ref,
       coalesce(clause_title = cl OR section_title = sec, false) AS meta,
       coalesce(CASE WHEN list_position(heading, sec) > 0 THEN heading[list_position(heading, sec) + 1] END, CASE WHEN clause_title IS NOT NULL AND (sec IS NULL OR clause_title <> sec) THEN clause_title END,
         nullif(trim(regexp_extract(' ' || regexp_replace(text, '\\s+', ' ', 'g'), '[^0-9][0-9]{{1,2}}\\.\\s*([^。；;：:]{{2,40}}?行为)', 1)), '')) AS ltitle,
       listing AND chunk_type = 'section_children' AND (sec IS NULL OR coalesce(section_title = sec, false) OR coalesce(contains(head, sec), false)) AS kids FROM cand3),
    cand AS (SELECT *, CASE WHEN NOT exact THEN true WHEN ref THEN false
         WHEN detail THEN chunk_type <> 'section_children' AND (sec IS NULL OR contains(h, sec)) AND coalesce(contains(h, cl), false)
         WHEN beh = 'absenteeism' THEN marker AND (aspect OR signal) WHEN beh IS NOT NULL AND act THEN marker AND (aspect OR signal OR in_cl OR in_sub)
         WHEN beh IS NOT NULL THEN marker OR signal OR in_cl OR in_sub WHEN act THEN marker AND aspect ELSE in_cl OR in_sub OR defined OR meta END AS direct,
       listing AND CASE WHEN kids THEN true ELSE coalesce(contains(h, sec), false) AND NOT contains(h, '违规行为相应处理') AND ltitle IS NOT NULL END AS lists FROM cand4),
    classed AS (SELECT *, CASE WHEN NOT exact THEN 'semantic_candidate' WHEN listing THEN CASE WHEN lists THEN 'listing_evidence' ELSE 'irrelevant_or_insufficient_evidence' END
         WHEN ref THEN 'cross_reference_evidence' WHEN beh IS NOT NULL AND direct THEN 'direct_behavior_evidence' WHEN direct THEN 'direct_section_evidence' ELSE 'irrelevant_or_insufficient_evidence' END AS class FROM cand)
"""
_TOPICS = "CASE cat " + " ".join(f"WHEN '{n}' THEN {_list(v)}" for n, v in rules.TOPIC_TERMS) + f" ELSE {_E} END"
FILTERED = CAND + f""",
    topic0 AS (SELECT *, list_concat(list_filter(hterms, lambda x: x <> '员工'), {_TOPICS}) AS topics FROM classed WHERE exact OR NOT student OR ({any_sql("concat_ws(' ', head, source)", rules.STUDENT_SCOPE)} AND NOT contains(concat_ws(' ', head, source), '员工'))),
    topic AS (SELECT *, {any_of('h', 'topics')} AS on_topic, max({any_of('h', 'topics')}) OVER (PARTITION BY query_id) AS any_topic FROM topic0),
    kept AS (SELECT * FROM topic WHERE CASE WHEN exact THEN class NOT IN ('cross_reference_evidence', 'irrelevant_or_insufficient_evidence') ELSE len(topics) = 0 OR on_topic OR NOT any_topic END)
"""


@query("h7_metadata_text", f"WITH {CAND} SELECT chunk_id, concat_ws(' ', source, section_title, clause_title, chunk_type) || ' ' || head AS metadata_text FROM cand1")
def h7_metadata_text(spark, sf_dir):
    one = lambda x: F.array_compact(F.array(x))
    values = F.array(one("source"), one("section_title"), one("clause_title"), one("chunk_type"), F.col("heading"))
    return candidates(spark, sf_dir).select("chunk_id", retrieval.metadata_text(values).alias("metadata_text"))


_SCORE = f"""
    terms1 AS (SELECT *, array_to_string(heading, '') AS hj, act AND {any_sql('h', rules.ACTION_RETRIEVAL)} AS h_aspect, {any_of('h', 'markers')} AS h_marker,
       len(list_filter(terms, lambda x: contains(h, x))) AS n_terms, len(list_filter(list_concat(exs, exc), lambda x: contains(h, x))) AS n_leaks,
       len(list_intersect(list_distinct(list_concat(regexp_extract_all(q, '[\\x{{4E00}}-\\x{{9FFF}}]'), list_filter(string_split_regex(lower(translate(q, '？?', '  ')), '\\s+'), lambda x: x <> ''))),
                          list_distinct(list_concat(regexp_extract_all(h, '[\\x{{4E00}}-\\x{{9FFF}}]'), list_filter(string_split_regex(lower(translate(h, '？?', '  ')), '\\s+'), lambda x: x <> ''))))) AS overlap FROM cand),
    scored AS (SELECT *, round(CAST(0.2 * overlap + CASE WHEN {any_sql('hj', ('年假', '年休假', '休假'))} THEN 0.3 ELSE 0 END + n_terms
       + CASE WHEN sec IS NOT NULL AND (coalesce(section_title = sec, false) OR contains(hj, sec)) THEN 3 ELSE 0 END + CASE WHEN defined THEN 4 ELSE 0 END + CASE WHEN kids THEN 10 ELSE 0 END
       + CASE WHEN cl IS NOT NULL AND (coalesce(clause_title = cl, false) OR in_cl) THEN 4 ELSE 0 END + CASE WHEN asked IS NOT NULL AND h_marker THEN 2 ELSE 0 END
       + CASE WHEN beh IS NOT NULL AND h_marker THEN 4 ELSE 0 END + CASE WHEN {any_of('h', 'titles')} THEN 4 ELSE 0 END + CASE WHEN asked IS NOT NULL AND h_aspect THEN 5 ELSE 0 END
       - CASE WHEN exact AND sec IS NOT NULL AND NOT direct THEN 3 ELSE 0 END - CASE WHEN sec IS NOT NULL AND ref THEN 6 ELSE 0 END - CASE WHEN beh IS NOT NULL AND NOT h_marker THEN 6 ELSE 0 END
       - CASE WHEN asked IS NOT NULL AND NOT h_aspect THEN 5 ELSE 0 END - 0.8 * n_leaks + greatest(0, 1 - distance) AS DOUBLE), 4) AS score FROM terms1)
"""


@query("h8_rule_score", f"WITH {CAND}, {_SCORE} SELECT query_id, chunk_id, score AS deterministic_score FROM scored")
def h8_rule_score(spark, sf_dir):
    return ev.rule_score(candidates(spark, sf_dir)).select("query_id", "chunk_id", "deterministic_score")


@query(
    "h9_rerank_order",
    f"WITH {CAND}, {_SCORE} SELECT query_id, chunk_id, CAST(rank AS BIGINT) AS rank_before, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank_after FROM scored",
)
def h9_rerank_order(spark, sf_dir):
    d = ev.rule_score(candidates(spark, sf_dir)).withColumnRenamed("rank", "rank_before").withColumnRenamed("deterministic_score", "rerank_score")
    return retrieval.reorder(d).select("query_id", "chunk_id", F.col("rank_before").cast("bigint").alias("rank_before"), F.col("rank_after").cast("bigint").alias("rank_after"))


@query(
    "h10_external_scores",
    f"""WITH {CAND}, {_SCORE}, n AS (SELECT query_id, count(*) AS c FROM base GROUP BY query_id)
        SELECT s.query_id, chunk_id, CASE s.query_id % 4 WHEN 0 THEN 'deterministic_fallback' WHEN 1 THEN 'cross' ELSE 'cross_failed_fallback' END AS reranker_source,
          CASE s.query_id % 4 WHEN 2 THEN 'expected ' || c || ' rerank results, got ' || (c - 1) WHEN 3 THEN 'rerank result index out of range: 99' END AS reranker_error,
          CASE WHEN s.query_id % 4 = 1 THEN rank / 10.0::DOUBLE END AS reranker_score, round(score + CASE WHEN s.query_id % 4 = 1 THEN rank / 10.0::DOUBLE ELSE 0 END, 4) AS rerank_score
        FROM scored s JOIN n ON s.query_id = n.query_id""",
)
def h10_external_scores(spark, sf_dir):
    d = ev.rule_score(candidates(spark, sf_dir)).withColumnRenamed("rank", "rank_before")
    k = F.col("query_id") % 4
    base = texts(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 8).alias("query_id"), (F.col("doc_id") % 8).cast("int").alias("index"))
    scores = base.filter((k != 0) & ~((k == 2) & (F.col("index") == 0))).withColumn("score", (F.col("index") + 1) / 10.0)
    off = base.filter((k == 3) & (F.col("index") == 0)).select("query_id", F.lit(99).alias("index"), F.lit(1.0).alias("score"))
    return retrieval.external_scores(d, scores.unionByName(off), "cross").select("query_id", "chunk_id", "reranker_source", "reranker_error", "reranker_score", "rerank_score")


@query(
    "h10_list_scores",
    f"""WITH {CAND}, {_SCORE}, n AS (SELECT query_id, count(*) AS c FROM base GROUP BY query_id),
        x AS (SELECT s.query_id, chunk_id, rank, score, c, CAST(s.query_id % 4 AS INT) AS k FROM scored s JOIN n ON s.query_id = n.query_id)
        SELECT query_id, chunk_id, CASE k WHEN 0 THEN 'deterministic_fallback' WHEN 1 THEN 'cross' WHEN 2 THEN 'cross_invalid_fallback' ELSE 'cross_failed_fallback' END AS reranker_source,
          CASE k WHEN 2 THEN 'expected ' || c || ' scores, got ' || (c + 1) WHEN 3 THEN 'no scores' END AS reranker_error, CASE WHEN k = 1 THEN rank / 10.0::DOUBLE END AS reranker_score,
          round(score + CASE WHEN k = 1 THEN rank / 10.0::DOUBLE ELSE 0 END, 4) AS rerank_score FROM x""",
)
def h10_list_scores(spark, sf_dir):
    d = ev.rule_score(candidates(spark, sf_dir)).withColumnRenamed("rank", "rank_before")
    k, n = F.col("query_id") % 4, F.count("*")
    lists = texts(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 8).alias("query_id")).agg(n.cast("int").alias("n")).filter(k != 0)
    scores = F.transform(F.sequence(F.lit(1), F.col("n") + F.when(k == 2, 1).otherwise(0)), lambda i: i / 10.0)
    return retrieval.listed_scores(d, lists.select("query_id", F.when(k != 3, scores).alias("scores")), "cross").select(
        "query_id", "chunk_id", "reranker_source", "reranker_error", "reranker_score", "rerank_score"
    )


@query(
    "h10_response_scores",
    f"""WITH {CAND}, {_SCORE}, n AS (SELECT query_id, count(*) AS c FROM base GROUP BY query_id),
        x AS (SELECT s.query_id, chunk_id, rank, score, c, CAST(s.query_id % 8 AS INT) AS k FROM scored s JOIN n ON s.query_id = n.query_id),
        y AS (SELECT *, CASE WHEN k = 1 THEN rank / 10.0::DOUBLE WHEN k = 4 AND rank = 1 THEN 0.75::DOUBLE WHEN k = 4 THEN rank / 20.0::DOUBLE END AS ext FROM x)
        SELECT query_id, chunk_id, CASE k WHEN 0 THEN 'deterministic_fallback' WHEN 1 THEN 'cross' WHEN 4 THEN 'cross' ELSE 'cross_failed_fallback' END AS reranker_source,
          CASE k WHEN 2 THEN 'expected ' || c || ' rerank scores, got ' || (c + 1) WHEN 3 THEN 'rerank result index out of range: -1' WHEN 5 THEN 'expected ' || c || ' rerank results, got ' || (c - 1)
            WHEN 6 THEN 'rerank response must contain scores or results' WHEN 7 THEN 'rerank response must contain scores or results' END AS reranker_error,
          ext AS reranker_score, round(score + coalesce(ext, 0), 4) AS rerank_score FROM y""",
)
def h10_response_scores(spark, sf_dir):
    d = ev.rule_score(candidates(spark, sf_dir)).withColumnRenamed("rank", "rank_before")
    k = F.col("query_id") % 8
    n = texts(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 8).alias("query_id")).agg(F.count("*").cast("int").alias("n")).filter(k != 0)
    # Bodies as a reranker gives them: lists, rows with a repeated first index, rows out of range, too few, none, no JSON.
    plain = F.transform(F.sequence(F.lit(1), F.col("n") + F.when(k == 2, 1).otherwise(0)), lambda i: i / 10.0)
    row = lambda i, v: F.struct(i.alias("index"), v.alias("score"))
    rows = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: row(i, (i + 1) / 20.0))
    again = F.concat(rows, F.array(row(F.lit(0), F.lit(0.75))))
    off = F.concat(rows, F.array(row(F.lit(-1), F.lit(0.5)), row(F.lit(99), F.lit(0.5))))
    body = (
        F.when(k.isin(1, 2), F.to_json(F.struct(plain.alias("scores")))).when(k == 3, F.to_json(F.struct(off.alias("results")))).when(k == 4, F.to_json(F.struct(again.alias("results"))))
        .when(k == 5, F.to_json(F.struct(F.slice(rows, 2, 1000).alias("results")))).when(k == 6, F.lit('{"model": "none"}')).otherwise("<html>")
    )
    return retrieval.response_scores(d, n.select("query_id", body.alias("body")), "cross").select(
        "query_id", "chunk_id", "reranker_source", "reranker_error", "reranker_score", "rerank_score"
    )


def _scope_sql(starts, ends):
    """Scope between the leftmost start marker and the leftmost end marker behind it, as nested selects over `src`."""
    left = lambda txt, lst: f"list_min(list_filter([strpos({txt}, x) FOR x IN {lst}], lambda p: p > 0))"
    return f"""
    s1 AS (SELECT *, {starts} AS starts, {ends} AS ends FROM src),
    s2 AS (SELECT *, {left('text', 'starts')} AS a FROM s1),
    s3 AS (SELECT *, list_filter(starts, lambda x: strpos(text, x) = a)[1] AS m FROM s2),
    s4 AS (SELECT *, a + length(m) AS behind, substr(text, a + length(m)) AS tail FROM s3),
    s5 AS (SELECT *, {left('tail', 'ends')} AS e FROM s4),
    s6 AS (SELECT *, CASE WHEN e IS NULL THEN length(text) ELSE behind + e - 2 END AS stop FROM s5),
    s7 AS (SELECT *, CASE WHEN e IS NULL THEN '' ELSE substr(text, greatest(stop - 16, 0) + 1, least(stop, 16)) END AS pre FROM s6),
    s8 AS (SELECT *, CASE WHEN regexp_extract(pre, '(?:^|\\s)([0-9]{{1,2}}(?:\\.[0-9]+)*\\s*)$', 1) <> '' THEN length(regexp_extract(pre, '(?:^|\\s)([0-9]{{1,2}}(?:\\.[0-9]+)*\\s*)$', 1))
             ELSE length(regexp_extract(pre, '([（(][一二三四五六七八九十]+[）)]\\s*)$', 1)) END AS cut FROM s7),
    scoped AS (SELECT *, CASE WHEN a IS NOT NULL THEN nullif(trim(substr(text, a, stop - cut - a + 1)), '') END AS part FROM s8)
    """


_EXS = "flatten([['（一）' || x, '（二）' || x, '（三）' || x, x] FOR x IN exs])"
_CLNO = "CASE t WHEN 10 THEN 5 WHEN 12 THEN 4 WHEN 13 THEN 2 WHEN 14 THEN 4 WHEN 17 THEN 5 WHEN 19 THEN 1 END"
_LISTED = "(thr = 'continuous_absence_under_3_workdays' AND contains(text, '旷工少于三天') AND signal)"
_STARTS = f"""CASE WHEN cl IS NOT NULL THEN [cl, replace(cl, '. ', '.'), regexp_replace(cl, '\\.', '. ')] WHEN sec IS NOT NULL THEN ['（二）' || sec, '（一）' || sec, '（三）' || sec, sec || '：', sec]
    WHEN beh = 'absenteeism' THEN CASE WHEN {_LISTED} THEN ['（二）二类违规行为', '(二)二类违规行为', '二类违规行为：', '二类违规行为'] WHEN thr = 'continuous_absence_under_3_workdays' THEN ['连续旷工3个工作日以下', '旷工3个工作日以下']
      WHEN thr = 'continuous_absence_3_or_more_workdays' THEN ['连续旷工3个工作日及以上', '一年内累计两次及以上旷工'] ELSE ['（三） 旷工', '（三）旷工', '旷工 凡符合', '连续旷工'] END ELSE {_E} END"""
_ENDS = f"""CASE WHEN cl IS NOT NULL THEN list_concat(list_concat(exc, {_EXS}), [({_CLNO} + 1) || '.', ' ' || ({_CLNO} + 1) || '.']) WHEN sec IS NOT NULL THEN {_EXS}
    WHEN {_LISTED} THEN ['（三）三类违规行为', '(三)三类违规行为', '三类违规行为'] WHEN thr = 'continuous_absence_under_3_workdays' THEN ['连续旷工3个工作日及以上', '考勤结果', '五、假期标准'] ELSE ['考勤结果', '五、假期标准'] END"""


@query(
    "i1_scope_text",
    f"WITH {CAND}, src AS (SELECT * FROM cand), {_scope_sql(_STARTS, _ENDS)} SELECT query_id, chunk_id, CASE WHEN exact THEN md5(part) END AS scoped_md5 FROM scoped",
)
def i1_scope_text(spark, sf_dir):
    return candidates(spark, sf_dir).select("query_id", "chunk_id", F.when(ev.exact(), F.md5(ev.general_scope())).alias("scoped_md5"))


_ASTART = "CASE sec " + " ".join(f"WHEN '{s}' THEN {_list(a)}" for s, a, _ in rules.ACTION_SCOPE) + f" ELSE {_E} END"
_AEND = "CASE sec " + " ".join(f"WHEN '{s}' THEN {_list(b)}" for s, _, b in rules.ACTION_SCOPE) + f" ELSE {_E} END"


@query(
    "i2_action_scope",
    f"""WITH {CAND}, src AS (SELECT * FROM cand), {_scope_sql(_ASTART, _AEND)}
        SELECT query_id, chunk_id, CASE WHEN act AND sec IS NOT NULL AND {any_sql('text', rules.ACTION_SCOPE_SIGNALS)} THEN part END AS scoped FROM scoped""",
)
def i2_action_scope(spark, sf_dir):
    return candidates(spark, sf_dir).select("query_id", "chunk_id", ev.action_scope().alias("scoped"))


@query("i3_reference_only", f"WITH {CAND} SELECT query_id, chunk_id, ref AS reference_only FROM cand")
def i3_reference_only(spark, sf_dir):
    return candidates(spark, sf_dir).select("query_id", "chunk_id", ev.reference_only().alias("reference_only"))


@query("i4_direct_evidence", f"WITH {CAND} SELECT query_id, chunk_id, direct FROM cand")
def i4_direct_evidence(spark, sf_dir):
    return candidates(spark, sf_dir).select("query_id", "chunk_id", ev.direct_evidence().alias("direct"))


@query("i5_evidence_class", f"WITH {CAND} SELECT query_id, chunk_id, class AS evidence_class, class NOT IN ('cross_reference_evidence', 'irrelevant_or_insufficient_evidence') AS usable FROM classed")
def i5_evidence_class(spark, sf_dir):
    d = candidates(spark, sf_dir).withColumn("evidence_class", ev.evidence_class())
    return d.select("query_id", "chunk_id", "evidence_class", ev.usable(F.col("evidence_class")).alias("usable"))


@query(
    "i6_target_filter",
    f"""WITH {FILTERED} SELECT c.query_id, count(*) AS input_count, count(k.chunk_id) AS output_count, CAST(count(*) FILTER (c.class = 'cross_reference_evidence') AS BIGINT) AS cross_references
        FROM classed c LEFT JOIN kept k ON c.chunk_id = k.chunk_id WHERE c.exact GROUP BY c.query_id""",
)
def i6_target_filter(spark, sf_dir):
    d = candidates(spark, sf_dir).filter(ev.exact()).withColumn("evidence_class", ev.evidence_class())
    return d.groupBy("query_id").agg(
        F.count("*").alias("input_count"), F.count_if(ev.usable(F.col("evidence_class"))).alias("output_count"),
        F.count_if(F.col("evidence_class") == "cross_reference_evidence").alias("cross_references"),
    )


@query("i7_topic_filter", f"WITH {FILTERED} SELECT query_id, chunk_id FROM kept WHERE NOT exact")
def i7_topic_filter(spark, sf_dir):
    return ev.filter_evidence(candidates(spark, sf_dir)).filter(~ev.exact()).select("query_id", "chunk_id")


@query("i8_audience_filter", f"WITH {CAND} SELECT query_id, chunk_id, student AS asks_for_student, {any_sql('head', rules.STUDENT_SCOPE)} AND NOT contains(head || coalesce(source, ''), '员工') AS student_scope FROM cand")
def i8_audience_filter(spark, sf_dir):
    asks = F.col("hints.audience") == "student_or_stage_specific"
    return candidates(spark, sf_dir).select("query_id", "chunk_id", asks.alias("asks_for_student"), ev.student_scope().alias("student_scope"))


_KEY = f"""concat_ws('|', doc, CASE WHEN beh = 'absenteeism' THEN CASE WHEN {any_sql('text', ('扣除旷工期间工资', '连续旷工', '一年内累计两次及以上旷工'))} THEN 'p' WHEN signal THEN 'c' ELSE 's' END
    WHEN beh IS NOT NULL THEN CASE WHEN aspect AND in_sec THEN 'level' WHEN in_label OR in_cl OR in_sub THEN 'class' ELSE 'own' || block_id END
    WHEN cl IS NOT NULL THEN coalesce(section_title, sec) || '>' || coalesce(clause_title, cl) WHEN listing AND sec IS NOT NULL THEN coalesce(section_title, sec) || '>' || coalesce(ltitle, block_id)
    WHEN sec IS NOT NULL THEN coalesce(section_title, sec) WHEN section_title IS NOT NULL THEN concat_ws('>', section_title, clause_title) ELSE block_id END)"""
DEDUPED = FILTERED + f", keyed AS (SELECT *, {_KEY} AS key FROM kept), dd AS (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY rank) > 1 AS dup FROM keyed)"


@query("i9_evidence_dedupe", f"WITH {DEDUPED} SELECT query_id, chunk_id, dup AS is_duplicate FROM dd")
def i9_evidence_dedupe(spark, sf_dir):
    return ev.dedupe(ev.filter_evidence(candidates(spark, sf_dir))).select("query_id", "chunk_id", "is_duplicate")


_CAT = f"list_filter({_list(rules.SECTIONS)}, lambda x: list_contains(classes, x))[1]"
_PICKED = f"""
    pc AS (SELECT *, beh IS NOT NULL AND CASE WHEN beh = 'absenteeism' THEN contains(text, '旷工') AND {any_sql('text', ('扣除旷工期间工资', '记过处分', '辞退处分'))} ELSE act AND in_sec AND aspect END AS pen,
       beh IS NOT NULL AND CASE WHEN beh = 'absenteeism' THEN CASE WHEN {_CAT} IS NOT NULL THEN contains(text, {_CAT}) AND signal AND ({any_of('text', f"list_filter(classes, lambda y: y <> '破坏学校管理秩序行为' AND NOT list_contains({_list(rules.SECTIONS)}, y))")} OR contains(text, '旷工'))
          ELSE contains(text, '旷工少于三天') AND signal END ELSE (sec IS NULL OR contains(h, sec)) AND {any_sql('h', rules.CLASS_SIGNALS)} AND (in_sub OR in_label OR (in_cl AND NOT aspect)) END AS cls FROM dd WHERE NOT dup),
    pr AS (SELECT *, min(CASE WHEN pen THEN rank END) OVER (PARTITION BY query_id) AS p1, min(CASE WHEN cls THEN rank END) OVER (PARTITION BY query_id) AS c1 FROM pc),
    final AS (SELECT *, coalesce(rank = p1, false) AS is_p, coalesce(rank = c1, false) AS is_c FROM pr WHERE (p1 IS NULL AND c1 IS NULL) OR rank = p1 OR rank = c1)
"""


def final_evidence(spark, sf_dir):
    return ev.select_complementary(ev.dedupe(ev.filter_evidence(candidates(spark, sf_dir))).filter(~F.col("is_duplicate")))


@query("i10_complementary", f"WITH {DEDUPED}, {_PICKED} SELECT query_id, chunk_id, CASE WHEN is_p AND is_c THEN 'both' WHEN is_p THEN 'penalty' WHEN is_c THEN 'classification' END AS role FROM final")
def i10_complementary(spark, sf_dir):
    return final_evidence(spark, sf_dir).select("query_id", "chunk_id", "role")


_TSCORE = f"len(list_filter({_list(rules.TABLE_TERMS)}, lambda x: contains(h, x))) + len(regexp_extract_all(h, '[0-9]+\\s*天'))"
ASSESSED = f"""
    as0 AS (SELECT *, list_filter(list_filter(list_concat([obj], exraw), lambda x: x IS NOT NULL), lambda x, i: list_position(list_concat([obj], exraw), x) IS NOT NULL) AS tl FROM {{src}}),
    as1 AS (SELECT *, list_distinct(tl) AS tt, {any_sql('h', rules.STRONG_ACTION_TERMS)} AS strong, {any_sql('h', rules.CLASSIFICATION_TERMS)} AS clsd, {any_sql('h', rules.DEFINITION_SIGNALS)} AS dsig FROM as0),
    as2 AS (SELECT *, len(list_filter(tt, lambda x: contains(h, x))) AS n_match FROM as1),
    assessed AS (SELECT *, CASE WHEN {any_sql('h', rules.REFERENCE_TERMS)} AND NOT strong THEN 'cross_reference_evidence'
      WHEN iasp = 'disciplinary_action' THEN CASE WHEN dsig AND NOT strong THEN 'insufficient_evidence' WHEN {any_sql('h', rules.ACTION_TERMS)} AND (n_match > 0 OR clsd) THEN 'action_evidence' WHEN n_match > 0 AND clsd THEN 'classification_evidence' ELSE 'insufficient_evidence' END
      WHEN iasp = 'classification' THEN CASE WHEN n_match > 0 AND clsd THEN 'classification_evidence' ELSE 'insufficient_evidence' END
      WHEN iasp = 'section_listing' THEN CASE WHEN NOT {any_sql('h', rules.LISTING_EXCLUDE)} AND n_match > 0 AND clsd THEN 'listing_evidence' ELSE 'insufficient_evidence' END
      WHEN iasp = 'table_lookup' THEN CASE WHEN n_match > 0 AND {_TSCORE} >= 3 THEN 'table_evidence' ELSE 'insufficient_evidence' END
      WHEN iasp = 'definition' THEN CASE WHEN n_match > 0 AND dsig THEN 'definition_evidence' ELSE 'insufficient_evidence' END
      WHEN iasp = 'process' THEN CASE WHEN n_match > 0 AND {any_sql('h', rules.PROCESS_TERMS)} THEN 'process_evidence' ELSE 'insufficient_evidence' END ELSE 'semantic_candidate' END AS etype FROM as2)
"""


def assessed_rows(d):
    a = ev.assess(ev.haystack(), F.col("intent.asked_aspect"), ev.intent_terms())
    return d.withColumn("a", a).select(
        "query_id", "rank", "chunk_id", "a.evidence_type", F.col("a.usable_as_final").alias("usable"), "a.matched_terms", "a.missing_terms",
    )


@query("i11_assess_evidence", f"WITH {CAND}, {ASSESSED.format(src='cand')} SELECT query_id, chunk_id, etype AS evidence_type, CAST(n_match AS BIGINT) AS matched, CAST(len(tt) - n_match AS BIGINT) AS missing FROM assessed")
def i11_assess_evidence(spark, sf_dir):
    return assessed_rows(candidates(spark, sf_dir)).select(
        "query_id", "chunk_id", "evidence_type", F.size("matched_terms").cast("bigint").alias("matched"), F.size("missing_terms").cast("bigint").alias("missing")
    )


_PLAN = """
    found AS (SELECT query_id, list(DISTINCT etype) AS types, string_agg(CASE WHEN etype NOT IN ('insufficient_evidence', 'cross_reference_evidence') THEN CAST(chunk_id AS VARCHAR) END, ',' ORDER BY rank) AS cited FROM assessed GROUP BY query_id),
    plan AS (SELECT s.query_id, iasp, missing, thr IS NOT NULL AS ruled, coalesce(types, []::VARCHAR[]) AS types, cited,
             CASE iasp WHEN 'disciplinary_action' THEN 'action_evidence' WHEN 'classification' THEN 'classification_evidence' WHEN 'section_listing' THEN 'listing_evidence' WHEN 'table_lookup' THEN 'table_evidence'
             WHEN 'definition' THEN 'definition_evidence' WHEN 'process' THEN 'process_evidence' END AS need FROM spec s LEFT JOIN found f ON f.query_id = s.query_id)
"""
_PLAN_TYPE = """CASE WHEN need IS NULL THEN 'grounded_summary' WHEN NOT list_contains(types, need) THEN 'insufficient_evidence'
    WHEN iasp = 'disciplinary_action' THEN CASE WHEN len(missing) > 0 THEN 'conditional_disciplinary_action' ELSE 'disciplinary_action' END ELSE iasp END"""


@query(
    "i12_plan_answer",
    f"""WITH {DEDUPED}, {_PICKED}, {ASSESSED.format(src='final')}, {_PLAN} SELECT query_id, {_PLAN_TYPE} AS answer_type, coalesce(cited, '') AS required_citations, CASE WHEN need IS NOT NULL AND NOT list_contains(types, need) THEN need END AS lacking,
        CASE WHEN need IS NULL THEN 'summary,citations,uncertainty' WHEN NOT list_contains(types, need) THEN 'cannot_answer,citations'
          WHEN iasp = 'disciplinary_action' THEN 'fact' || CASE WHEN len(missing) > 0 THEN ',conditions' ELSE '' END || CASE WHEN ruled THEN ',rule_match' ELSE '' END ||
            CASE WHEN ruled OR list_contains(types, 'classification_evidence') THEN ',classification' ELSE '' END || ',action,citations,uncertainty'
          WHEN iasp = 'classification' THEN 'fact,classification,citations,uncertainty' WHEN iasp = 'section_listing' THEN 'overview,items,citations,uncertainty' WHEN iasp = 'table_lookup' THEN 'result,table,citations,uncertainty'
          WHEN iasp = 'definition' THEN 'definition,scope,citations' ELSE 'steps,owner,materials,citations,uncertainty' END AS sections FROM plan""",
)
def i12_plan_answer(spark, sf_dir):
    asked = specs(spark, sf_dir).select("query_id", F.col("intent.asked_aspect").alias("aspect"), F.col("intent.missing_conditions").alias("missing"), F.col("spec.rule_id").isNotNull().alias("has_rule"))
    p = ev.plan_answers(asked, assessed_rows(final_evidence(spark, sf_dir)))
    return p.select("query_id", "answer_type", F.array_join(F.col("required_citations").cast("array<string>"), ",").alias("required_citations"), "lacking", F.array_join("sections", ",").alias("sections"))


_LEAK = "len(list_filter(list_concat(exs, exc), lambda x: contains(text, x))) > 0"


@query(
    "i13_quality_checks",
    f"""WITH {DEDUPED}, {_PICKED}, {_SCORE},
        g AS (SELECT f.query_id, max(s.score) AS top, bool_and(f.source IS NOT NULL) AS sourced, bool_or(f.chunk_id % 5 = 0) AS dated, bool_or({_LEAK.replace('exs', 'f.exs').replace('exc', 'f.exc').replace('(text', '(f.text')}) AS leaks
              FROM final f JOIN scored s ON s.query_id = f.query_id AND s.chunk_id = f.chunk_id GROUP BY f.query_id)
        SELECT i.query_id, v.name, CASE v.name WHEN 'relevance_threshold' THEN CASE WHEN top >= 0.5 THEN 'ok' ELSE 'warn' END WHEN 'source_metadata' THEN CASE WHEN top IS NULL OR sourced THEN 'ok' ELSE 'warn' END
          WHEN 'freshness_conflict' THEN CASE WHEN top IS NULL OR dated THEN 'ok' ELSE 'warn' END WHEN 'scope_guard' THEN CASE WHEN leaks THEN 'warn' ELSE 'ok' END
          WHEN 'context_assembly' THEN CASE WHEN top IS NULL THEN 'warn' ELSE 'ok' END ELSE 'ok' END AS status
        FROM ids i LEFT JOIN g ON g.query_id = i.query_id, (VALUES ('relevance_threshold'), ('source_metadata'), ('freshness_conflict'), ('context_assembly'), ('scope_guard'), ('citation_merge')) v(name)""",
)
def i13_quality_checks(spark, sf_dir):
    d = ev.rule_score(final_evidence(spark, sf_dir)).withColumn("effective_date", F.when(F.col("chunk_id") % 5 == 0, F.lit("2024-01-01")))
    return ev.quality_checks(specs(spark, sf_dir), d.withColumnRenamed("deterministic_score", "rerank_score"))


@query(
    "i14_scope_guard",
    f"""WITH {DEDUPED}, {_PICKED}, m AS (SELECT query_id, unnest(list_filter(list_concat(exs, exc), lambda x: contains(text, x))) AS m FROM final), g AS (SELECT query_id, string_agg(DISTINCT m, ',' ORDER BY m) AS leaked FROM m GROUP BY query_id)
        SELECT i.query_id, coalesce(leaked, '') AS leaked, CASE WHEN leaked IS NULL THEN 'ok' ELSE 'warn' END AS status FROM ids i LEFT JOIN g ON i.query_id = g.query_id""",
)
def i14_scope_guard(spark, sf_dir):
    return ev.scope_guard(specs(spark, sf_dir), final_evidence(spark, sf_dir)).select("query_id", F.array_join("leaked", ",").alias("leaked"), "status")


@query(
    "i15_citations",
    """SELECT page_id, '[' || (page_id % 9 + 1) || ']' AS citation_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'cn ' || page_id ELSE 'Base > Page ' || page_id END AS title,
         CASE WHEN page_id % 2 = 0 THEN url WHEN page_id % 4 = 1 THEN 'https://example.com/policyDetail/' || page_id END AS url,
         '[' || (page_id % 9 + 1) || ']《' || CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'cn ' || page_id ELSE 'Base > Page ' || page_id END || '》' || CASE WHEN page_id % 3 = 0 THEN '（web / 2024-05-01）' WHEN page_id % 3 = 1 THEN '（web）' ELSE '' END || ' ' ||
         CASE WHEN page_id % 2 = 0 THEN '链接：' || url WHEN page_id % 4 = 1 THEN '链接：https://example.com/policyDetail/' || page_id ELSE '位置：page-' || page_id END AS line FROM pages""",
)
def i15_citations(spark, sf_dir):
    k = F.col("page_id")
    none = F.lit(None).cast("string")
    name = k.cast("string")
    cite = ev.citation(
        k % 9 + 1, F.when(k % 3 == 0, F.col("url")).otherwise(""), F.when(k % 3 == 1, F.concat(F.lit("cn "), name)), none, F.array(F.lit("Base"), F.concat(F.lit("Page "), name)),
        F.concat(F.lit("page-"), name), F.when(k % 2 == 0, F.col("url")), F.when(k % 4 == 1, F.lit("company_policy_system")), name,
    )
    d = texts(spark, sf_dir, "pages").select("page_id", cite.alias("c"), F.when(k % 3 < 2, "web").alias("cat"), F.when(k % 3 == 0, "2024-05-01").alias("date"))
    return d.select("page_id", "c.citation_id", "c.title", "c.url", ev.source_line(F.col("c"), F.col("cat"), F.col("date")).alias("line"))


@query("i16_context_blocks", f"WITH {DEDUPED}, b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS block_no FROM dd WHERE NOT dup) SELECT query_id, block_no, chunk_id, head AS title, coalesce(source, '') AS source FROM b WHERE block_no <= 3")
def i16_context_blocks(spark, sf_dir):
    d = ev.dedupe(ev.filter_evidence(candidates(spark, sf_dir))).filter(~F.col("is_duplicate"))
    return ev.context_blocks(d, 3).select("query_id", F.col("block_no").cast("bigint").alias("block_no"), "chunk_id", F.array_join("heading", " ").alias("title"), F.coalesce("source", F.lit("")).alias("source"))


@query(
    "i17_children_selection",
    f"""WITH {CAND}, k AS (SELECT query_id, arg_min(chunk_id, rank) AS chunk_id, arg_min(section_title, rank) AS section_title FROM cand WHERE kids GROUP BY query_id)
        SELECT query_id, chunk_id, section_title, '1. 师德师风相关的违规行为|2. 违反保密义务行为|4. 弄虚作假行为' AS items, 3 AS child_count, 'incomplete' AS continuity FROM k""",
)
def i17_children_selection(spark, sf_dir):
    return ev.children_selection(candidates(spark, sf_dir)).select("query_id", "chunk_id", "section_title", F.array_join("items", "|").alias("items"), "child_count", "continuity")
