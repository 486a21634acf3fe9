"""Queries that assemble answers from the final evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier import rules
from dossier.functions.session import materialize
from dossier.operators import answers as an
from dossier.operators import chain, features
from dossier.plans.evidence_queries import _PICKED, CAND, DEDUPED, candidates, final_evidence, fragment_rows, specs
from dossier.plans.registry import query, table
from dossier.plans.understanding_queries import _list, any_sql, q

T = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(
    "j1_definition_text",
    f"""WITH {CAND}, d AS (SELECT *, nullif(regexp_extract({T}, coalesce(sec, '~') || '\\s*[：:]\\s*指[^。]*。'), '') AS said,
            list_min(list_filter([strpos({T}, x) FOR x IN ['（一）' || sec, '（二）' || sec, '（三）' || sec, sec || '：', sec || ':']], lambda p: p > 0)) AS first_at FROM cand)
        SELECT query_id, chunk_id, md5(coalesce(said, CASE WHEN first_at IS NOT NULL THEN trim(regexp_replace(substr({T}, first_at), '(?s)\\s[0-9]{{1,2}}\\.\\s*[^0-9\\s].*$', '')) END)) AS definition_md5 FROM d""",
)
def j1_definition_text(spark, sf_dir):
    return candidates(spark, sf_dir).select("query_id", "chunk_id", F.md5(an.definition_text(F.col("text"), F.col("spec.target_section"))).alias("definition_md5"))


@query(
    "j2_section_listing",
    f"""WITH {CAND}, l AS (SELECT *, coalesce(try_cast(nullif(regexp_extract(' ' || {T}, '[^0-9]([0-9]{{1,2}})\\.\\s*' || coalesce(regexp_escape(ltitle), '~~'), 1), '') AS INT), 999) AS ord FROM cand WHERE lists),
        k AS (SELECT query_id, bool_or(kids) AS structured, any_value(sec) AS section FROM l GROUP BY query_id),
        u AS (SELECT query_id, ltitle, arg_min(ord, rank) AS ord, min(rank) AS rank FROM l WHERE NOT kids GROUP BY query_id, ltitle),
        o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord, rank) AS i FROM u)
        SELECT k.query_id, section, structured, structured AS gap_warning, CASE WHEN structured THEN '1. 师德师风相关的违规行为|2. 违反保密义务行为|4. 弄虚作假行为' ELSE (SELECT string_agg(CASE WHEN ord = 999 THEN i ELSE ord END || '. ' || ltitle, '|' ORDER BY ord, rank) FROM o WHERE o.query_id = k.query_id) END AS items FROM k""",
)
def j2_section_listing(spark, sf_dir):
    return an.section_listing(candidates(spark, sf_dir)).select("query_id", "section", "structured", "gap_warning", F.array_join("items", "|").alias("items"))


# Titles of one chunk each; what follows the title up to 140 characters; numbers stored for every third chunk.
_DETAIL_TEXT = f"""trim(regexp_replace(trim(regexp_replace(CASE WHEN strpos({T}, ltitle) > 0 THEN substr({T}, strpos({T}, ltitle) + length(ltitle)) ELSE {T} END, '^[：:，。；;\\s]+', '')),
    '（[一二三四五六七八九十]+）[^。]*?：指[^。]*。?', '', 'g'))"""
def _listed(src, stored):
    return f"""
    li0 AS (SELECT *, try_cast(nullif(regexp_extract(' ' || {T}, '[^0-9]([0-9]{{1,2}})\\.\\s*' || coalesce(regexp_escape(ltitle), '~~'), 1), '') AS INT) AS own_no,
              nullif(regexp_extract(' ' || {T}, '[^0-9]([0-9]{{1,2}})\\.\\s*[^。；;：:]{{2,60}}?行为', 1), '') AS any_no, {_DETAIL_TEXT} AS det FROM {src} WHERE lists),
    li1 AS (SELECT *, CASE WHEN {stored} THEN CASE WHEN chunk_id % 2 = 0 THEN 'no ' || chunk_id || '.' ELSE CAST(chunk_id AS VARCHAR) || '.' END ELSE coalesce(CAST(own_no AS VARCHAR), any_no) || '.' END AS shown,
              CASE WHEN length(det) > 140 THEN rtrim(substr(det, 1, 140), '，。；; ') || '...' ELSE det END AS short FROM li0),
    li2 AS (SELECT query_id, ltitle, arg_min(coalesce(own_no, 999), rank) AS ord, min(rank) AS rank, arg_min(coalesce(shown, ''), rank) AS shown, arg_min(short, rank) AS short FROM li1 WHERE NOT kids AND ltitle IS NOT NULL GROUP BY query_id, ltitle),
    li3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord, rank) AS i FROM li2),
    li4 AS (SELECT query_id, string_agg(CASE WHEN shown = '' THEN i || '.' ELSE shown END || ' ' || ltitle || CASE WHEN short <> '' THEN '：' || short ELSE '' END, chr(10) ORDER BY i) AS lines FROM li3 GROUP BY query_id),
    listed AS (SELECT k.query_id, structured, CASE WHEN structured THEN '1. 师德师风相关的违规行为' || chr(10) || '2. 违反保密义务行为' || chr(10) || '4. 弄虚作假行为' ELSE coalesce(lines, '') END AS lines
      FROM (SELECT query_id, bool_or(kids) AS structured FROM li1 GROUP BY query_id) k LEFT JOIN li4 ON li4.query_id = k.query_id)
"""


@query("j2_listing_details", f"WITH {CAND}, {_listed('cand', 'chunk_id % 3 = 0')} SELECT query_id, structured, md5(lines) AS details_md5 FROM listed")
def j2_listing_details(spark, sf_dir):
    k = F.col("chunk_id")
    stored = F.when(k % 3 == 0, F.when(k % 2 == 0, F.concat(F.lit("no "), k.cast("string"), F.lit("."))).otherwise(F.lit("")))
    d = candidates(spark, sf_dir).withColumn("ordinal_label", stored).withColumn("clause_no", F.when(k % 3 == 0, k))
    return an.section_listing(d).select("query_id", "structured", F.md5(F.array_join("details", "\n")).alias("details_md5"))


@query(
    "j3_clause_items",
    f"""WITH {CAND}, x AS (SELECT query_id, chunk_id, regexp_extract_all({T}, '5\\.[0-9]+\\s*[^。]*。') AS r FROM cand)
        SELECT query_id, chunk_id, md5(array_to_string(list_filter(r, lambda v, i: list_position(r, v) = i), '|')) AS items_md5 FROM x""",
)
def j3_clause_items(spark, sf_dir):
    return candidates(spark, sf_dir).select("query_id", "chunk_id", F.md5(F.array_join(an.clause_items(F.col("text"), F.lit("5")), "|")).alias("items_md5"))


@query(
    "j4_tier_table",
    """SELECT c_custkey, CAST(CASE WHEN c_custkey % 2 = 0 THEN 8 + least(c_custkey % 9 + 1, 6) * 2 + c_custkey % 3 WHEN c_custkey % 9 + 1 IN (1, 3) THEN 5 + c_custkey % 9 + 1 + c_custkey % 3 END AS BIGINT) AS days,
         CAST(CASE WHEN c_custkey % 2 = 0 THEN 6 ELSE 2 END AS BIGINT) AS tiers FROM customer""",
)
def j4_tier_table(spark, sf_dir):
    k = F.col("c_custkey")
    n = lambda i, base, step: F.concat((F.lit(base + step * i) + k % 3).cast("string"), F.lit("天"))
    whole = F.concat_ws(" ", F.col("c_name"), *[F.lit(x) for x in rules.YEAR_LABELS], *[n(i, 8, 2) for i in range(1, 7)])
    pairs = F.concat_ws("，", F.col("c_name"), F.concat(F.lit("第一年 "), n(1, 5, 1)), F.concat(F.lit("第三年"), n(3, 5, 1)))
    d = table(spark, sf_dir, "customer").select("c_custkey", an.tier_table(F.when(k % 2 == 0, whole).otherwise(pairs)).alias("t"))
    return d.select("c_custkey", an.tier_days(F.col("t"), (k % 9 + 1).cast("int")).cast("bigint").alias("days"), F.size("t").cast("bigint").alias("tiers"))


@query(
    "j5_action_items",
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '扣除工资|给予记过处分' ELSE '扣除' || c_mktsegment || '工资|给予警告处分|予以通报' END AS items FROM customer""",
)
def j5_action_items(spark, sf_dir):
    even = F.col("c_custkey") % 2 == 0
    expected = F.when(even, F.array(F.lit("扣除工资"), F.lit("记过处分"))).otherwise(F.array().cast("array<string>"))
    text = F.concat(F.lit("连续旷工的，扣除"), "c_mktsegment", F.lit("工资，并警告处分；予以通报。"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(an.action_items(expected, text), "|").alias("items"))


@query(
    "j6_classification_label",
    f"""WITH {CAND}, x AS (SELECT *, coalesce(list_filter(classes, lambda v: regexp_matches(v, '^[0-9]+\\.[0-9]+'))[1], nullif(replace(regexp_extract(text, '([0-9]+\\.\\s*[0-9]+\\s*旷工少于三天)', 1), '. ', '.'), '')) AS k,
          list_filter({_list(rules.SECTIONS)}, lambda v: list_contains(classes, v))[1] AS c0 FROM cand),
        y AS (SELECT *, coalesce(c0, nullif(regexp_extract(CASE WHEN strpos(text, k) > 0 THEN substr(text, 1, strpos(text, k) - 1) ELSE text END, '(?s)^.*([一二三]类违规行为)', 1), ''), nullif(regexp_extract(text, '([一二三]类违规行为)', 1), '')) AS c1 FROM x)
        SELECT query_id, chunk_id, '属于' || c1 || CASE WHEN contains(text, '破坏学校管理秩序行为') OR list_contains(classes, '破坏学校管理秩序行为') THEN '中的破坏学校管理秩序行为' ELSE '' END || CASE WHEN k IS NOT NULL THEN '（' || k || '）' ELSE '' END AS absence,
          CASE WHEN t IN (10, 12, 13, 14, 19) THEN '属于' || sec || '中的' || trim(regexp_replace(cl, '^[0-9]+\\.\\s*', '')) || '（' || sub || label || '）' END AS behavior FROM y""",
)
def j6_classification_label(spark, sf_dir):
    named = ~F.col("spec.target_behavior").isin("absenteeism")
    return candidates(spark, sf_dir).select(
        "query_id", "chunk_id", an.absence_label(F.col("text"), F.col("spec.classification_terms")).alias("absence"), F.when(named, an.behavior_label()).alias("behavior")
    )


@query(
    "j7_condition_sentence",
    f"""WITH {CAND}, s AS (SELECT query_id, chunk_id, label, list_filter(string_split_regex(regexp_replace(text, '[\\s\\x{{A0}}\\x{{3000}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}]+', '', 'g'), '[。；;]'), lambda p: contains(p, label) AND {any_sql('p', rules.CONDITION_SIGNALS)})[1] AS p FROM cand)
        SELECT query_id, chunk_id, md5(trim(coalesce(nullif(regexp_extract(p, '([0-9]+\\.[0-9]+.*)', 1), ''), p), '，。；; ')) AS condition_md5 FROM s""",
)
def j7_condition_sentence(spark, sf_dir):
    return candidates(spark, sf_dir).select("query_id", "chunk_id", F.md5(an.condition_sentence(F.col("text"), F.col("spec.target_behavior_label"))).alias("condition_md5"))


@query(
    "j8_ambiguity_options",
    f"WITH {CAND} SELECT query_id, '破坏学校管理秩序行为' AS title, '1. 二类违规行为 > 破坏学校管理秩序行为|2. 一类违规行为 > 破坏学校管理秩序行为|3. 三类违规行为 > 破坏学校管理秩序行为' AS options FROM spec WHERE t = 4",
)
def j8_ambiguity_options(spark, sf_dir):
    return an.ambiguity_options(specs(spark, sf_dir)).select("query_id", "title", F.array_join("options", "|").alias("options"))


# Detail evidence of a clause question, as in the target filter.
_DETAIL = "detail AND coalesce(chunk_type, '') <> 'section_children' AND (sec IS NULL OR contains(h, sec)) AND coalesce(contains(h, cl), false)"
_BRANCH = f"""
    per AS (SELECT query_id, count(*) AS n, bool_or(is_p) AS has_p, bool_or(is_c) AS has_c,
        bool_or(exact AND sec IS NOT NULL AND cl IS NULL AND ans = 'definition' AND (regexp_matches(text, coalesce(sec, '~') || '\\s*[：:]\\s*指[^。]*。') OR contains(text, '（一）' || sec) OR contains(text, '（二）' || sec) OR contains(text, '（三）' || sec) OR contains(text, sec || '：') OR contains(text, sec || ':'))) AS has_def,
        bool_or(lists) AS has_list, bool_or({any_sql('text', ('带薪年假', '带薪年休假', '年休假天数'))} AND regexp_matches(text, '第一年 第二年 第三年')) AS has_tier,
        arg_min(chunk_id, rank) FILTER (WHERE exact AND sec IS NOT NULL AND cl IS NULL AND ans = 'definition' AND (regexp_matches(text, coalesce(sec, '~') || '\\s*[：:]\\s*指[^。]*。') OR contains(text, '（一）' || sec) OR contains(text, '（二）' || sec) OR contains(text, '（三）' || sec) OR contains(text, sec || '：') OR contains(text, sec || ':'))) AS def_id,
        arg_min(chunk_id, rank) FILTER (WHERE {any_sql('text', ('带薪年假', '带薪年休假', '年休假天数'))} AND regexp_matches(text, '第一年 第二年 第三年')) AS tier_id,
        coalesce(arg_min(chunk_id, rank) FILTER (WHERE {_DETAIL}), arg_min(chunk_id, rank)) AS clause_id,
        string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY rank) AS ids FROM final GROUP BY query_id),
    ans AS (SELECT s.query_id, CASE WHEN t = 4 THEN 'ambiguity' WHEN per.n IS NULL THEN 'nothing' WHEN has_def THEN 'definition' WHEN has_list THEN 'listing' WHEN s.ans = 'clause_detail' THEN 'clause'
        WHEN beh = 'absenteeism' AND has_p THEN 'absence' WHEN beh <> 'absenteeism' AND has_c THEN 'behavior' WHEN (cat = 'leave' OR {any_sql('q', ('年假', '年休假'))}) AND has_tier THEN 'tier' ELSE 'best_chunk' END AS branch, ids, def_id, tier_id, clause_id
      FROM spec s LEFT JOIN per ON s.query_id = per.query_id)
"""


def answers(spark, sf_dir):
    return an.answer_rows(specs(spark, sf_dir), materialize(final_evidence(spark, sf_dir), "evidence"))


@query("j9_answer_branch", f"WITH {DEDUPED}, {_PICKED}, {_BRANCH} SELECT query_id, branch FROM ans")
def j9_answer_branch(spark, sf_dir):
    return answers(spark, sf_dir).select("query_id", "branch")


@query(
    "j10_answer_sources",
    f"""WITH {DEDUPED}, {_PICKED}, {_BRANCH} SELECT query_id, branch, CASE branch WHEN 'ambiguity' THEN '' WHEN 'nothing' THEN '' WHEN 'definition' THEN CAST(def_id AS VARCHAR) WHEN 'clause' THEN CAST(clause_id AS VARCHAR)
          WHEN 'tier' THEN CAST(tier_id AS VARCHAR) ELSE ids END AS sources FROM ans""",
)
def j10_answer_sources(spark, sf_dir):
    return answers(spark, sf_dir).select("query_id", "branch", F.array_join(F.col("source_chunk_ids").cast("array<string>"), ",").alias("sources"))


_SAID = f"nullif(regexp_extract({T}, coalesce(sec, '~') || '\\s*[：:]\\s*指[^。]*。'), '')"
_FROM = f"list_min(list_filter([strpos({T}, x) FOR x IN ['（一）' || sec, '（二）' || sec, '（三）' || sec, sec || '：', sec || ':']], lambda p: p > 0))"
_BARE = "regexp_replace(text, '[\\s\\x{A0}\\x{3000}\\x{2000}-\\x{200A}\\x{202F}]+', '', 'g')"
_RULE = "CASE WHEN t IN (7, 8) AND n < 3 THEN {0} WHEN t IN (7, 8) THEN {1} WHEN t = 9 AND n >= 2 THEN {2} END"
_ACT = lambda v: f"CASE WHEN ends_with({v}, '处分') AND NOT starts_with({v}, '给予') AND NOT starts_with({v}, '予以') THEN '给予' || {v} ELSE {v} END"
_NUMBERED = lambda xs: f"array_to_string([i || '. ' || {xs}[i] FOR i IN range(1, len({xs}) + 1)], chr(10))"
_DAYS = (10, 12, 14, 16, 18, 20)
_TIERS = "、".join(f"{label} {days}天" for label, days in zip(rules.YEAR_LABELS, _DAYS))
# The words of every branch; `final` has the evidence, `ans` the branch and the chunks of a question.
_ANSWER = f"""
    tx AS (SELECT f.query_id, chunk_id, text, heading, rank, is_p, is_c, {T} AS flat, {_BARE} AS bare, coalesce({_SAID}, CASE WHEN {_FROM} IS NOT NULL THEN trim(regexp_replace(substr({T}, {_FROM}), '(?s)\\s[0-9]{{1,2}}\\.\\s*[^0-9\\s].*$', '')) END) AS said FROM final f),
    pq AS (SELECT query_id, arg_min(text, rank) FILTER (WHERE is_p) AS pen, arg_min(bare, rank) FILTER (WHERE is_p) AS pen_bare, arg_min(text, rank) FILTER (WHERE is_c) AS cls, arg_min(bare, rank) FILTER (WHERE is_c) AS cls_bare,
        arg_min(text, rank) AS top, array_to_string(arg_min(heading, rank), ' > ') AS title FROM tx GROUP BY query_id),
    j0 AS (SELECT s.*, a.branch, d.said, cx.flat AS clause_flat, p.pen, p.pen_bare, p.cls, p.cls_bare, p.top, p.title, l.lines, l.structured,
        {_RULE.format(*[_list(r['actions']) for r in rules.RULES])} AS acts, {_RULE.format(*[q(r['condition']) for r in rules.RULES])} AS cond,
        coalesce(list_filter(classes, lambda v: regexp_matches(v, '^[0-9]+\\.[0-9]+'))[1], nullif(replace(regexp_extract(p.cls, '([0-9]+\\.\\s*[0-9]+\\s*旷工少于三天)', 1), '. ', '.'), '')) AS k
      FROM spec s JOIN ans a ON a.query_id = s.query_id LEFT JOIN pq p ON p.query_id = s.query_id LEFT JOIN listed l ON l.query_id = s.query_id
      LEFT JOIN tx d ON d.query_id = s.query_id AND d.chunk_id = a.def_id LEFT JOIN tx cx ON cx.query_id = s.query_id AND cx.chunk_id = a.clause_id),
    j1 AS (SELECT *, coalesce(list_filter({_list(rules.SECTIONS)}, lambda v: list_contains(classes, v))[1], nullif(regexp_extract(CASE WHEN strpos(cls, k) > 0 THEN substr(cls, 1, strpos(cls, k) - 1) ELSE cls END, '(?s)^.*([一二三]类违规行为)', 1), ''), nullif(regexp_extract(cls, '([一二三]类违规行为)', 1), '')) AS category,
        regexp_extract_all(clause_flat, '5\\.[0-9]+\\s*[^。]*。') AS its, list_filter(string_split_regex(cls_bare, '[。；;]'), lambda x: contains(x, label) AND {any_sql('x', rules.CONDITION_SIGNALS)})[1] AS sentence,
        trim(pen, '；;。 ') AS pen_trim, regexp_replace(pen_bare, '^[0-9]+\\.[0-9]+[一二三]类违规行为[:：]', '') AS pen_cut FROM j0),
    j2 AS (SELECT *, list_filter(its, lambda v, i: list_position(its, v) = i) AS items,
        CASE WHEN acts IS NOT NULL THEN acts ELSE list_filter(string_split_regex(CASE WHEN contains(pen_trim, '，') THEN regexp_replace(pen_trim, '^[^，]*，', '') ELSE pen_trim END, '，并|并|；|;'), lambda x: trim(x, '，。；; ') <> '') END AS parts0,
        list_filter(string_split_regex(CASE WHEN contains(pen_cut, '：') AND contains(string_split(pen_cut, '：')[1], '违规行为') THEN substr(pen_cut, strpos(pen_cut, '：') + 1) ELSE pen_cut END, '[，。；;]'), lambda x: x <> '') AS parts1 FROM j1),
    j3 AS (SELECT *, [{_ACT("trim(x, '，。；; ')")} FOR x IN parts0] AS done FROM j2)
    SELECT query_id, branch, md5(CASE branch
      WHEN 'ambiguity' THEN '这个条款名在多个违规等级下都存在：破坏学校管理秩序行为。' || chr(10) || '可选范围：' || chr(10) || array_to_string(['1. 二类违规行为 > 破坏学校管理秩序行为', '2. 一类违规行为 > 破坏学校管理秩序行为', '3. 三类违规行为 > 破坏学校管理秩序行为'], chr(10))
      WHEN 'nothing' THEN '{an.NOTHING_FOUND}' WHEN 'definition' THEN said
      WHEN 'listing' THEN regexp_replace(coalesce(sec, '目标章节'), '行为$', '') || '主要包括：' || chr(10) || lines || CASE WHEN structured THEN chr(10) || '结构质量提醒：该章节编号不连续。' ELSE '' END
      WHEN 'clause' THEN CASE WHEN len(items) > 0 THEN '包含以下情形：' || chr(10) || array_to_string(items, chr(10)) ELSE '条款内容：' || clause_flat END
      WHEN 'absence' THEN concat_ws(chr(10), '事实：' || CASE WHEN cond IS NULL THEN '旷工' WHEN t = 9 THEN '旷工 ' || n || ' 次' ELSE '旷工 ' || n || ' 天' END || '。', '规则匹配：' || CASE WHEN t = 9 THEN n || ' >= 2' WHEN n < 3 THEN n || ' < 3' ELSE n || ' >= 3' END || '，命中“' || cond || '”。',
        '违规类型：' || ('属于' || category || CASE WHEN contains(cls, '破坏学校管理秩序行为') OR list_contains(classes, '破坏学校管理秩序行为') THEN '中的破坏学校管理秩序行为' ELSE '' END || CASE WHEN k IS NOT NULL THEN '（' || k || '）' ELSE '' END) || '。',
        '处理结果：' || chr(10) || {_NUMBERED('done')})
      WHEN 'behavior' THEN concat_ws(chr(10), '事实：' || label || '。', CASE WHEN len(missing) > 0 THEN '如果满足条款条件，' ELSE '' END || '属于' || sec || '中的' || trim(regexp_replace(cl, '^[0-9]+\\.\\s*', '')) || '（' || sub || label || '）' || '。',
        CASE WHEN len(missing) > 0 THEN '需要确认：' || array_to_string(missing, '、') || '。' ELSE '条款条件：' || trim(coalesce(nullif(regexp_extract(sentence, '([0-9]+\\.[0-9]+.*)', 1), ''), sentence), '，。；; ') || '。' END,
        '处理结果：' || chr(10) || {_NUMBERED('parts1')})
      WHEN 'tier' THEN CASE WHEN t = 2 THEN '结论：带薪年假为 ' || {list(_DAYS)}[n] || '天。年假表：' ELSE '结论：' END || '{_TIERS}'
      ELSE '优先依据《' || title || '》：' || top END) AS answer_md5 FROM j3
"""


@query("j9_answer_text", f"WITH {DEDUPED}, {_PICKED}, {_BRANCH}, {_listed('final', 'false')}, {_ANSWER}")
def j9_answer_text(spark, sf_dir):
    return answers(spark, sf_dir).select("query_id", "branch", F.md5("answer").alias("answer_md5"))


@query("j9_question_chain")
def j9_question_chain(spark, sf_dir):
    """All questions against all policy-shaped documents, from the question text to the answer; no SQL, as vectors decide what is found."""
    doc = fragment_rows(spark, sf_dir).filter("query_id is not null").select("chunk_id", "doc_id", "block_id", "text", "heading", "section_title", "clause_title", "section_path", "chunk_type", "items", "continuity", "source", "meta_text")
    chunks = materialize(features.embed(doc, "text", "embedding"), "chunks")
    asked = specs(spark, sf_dir).select("query_id", "query", (F.col("query_id") % 4 + 1).cast("int").alias("top_k"))
    d = chain.answer_report(asked, chunks, 4)
    join = lambda name: F.array_join(F.col(name).cast("array<string>"), ",").alias(name)
    return d.select("query_id", "branch", F.md5("answer").alias("answer_md5"), "answer_type", join("source_chunk_ids"), join("required_citations"), join("sections"), join("warnings"), join("leaked"), "lacking")
