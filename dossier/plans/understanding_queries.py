"""Queries over question understanding.

The questions are derived from the conversations: every turn asks one of twenty
questions, the next turn the next one, with a number taken from the conversation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier import rules
from dossier.functions.text import BLANKS, cn_number
from dossier.operators import understanding as u
from dossier.plans.registry import query, table

QUESTIONS = (
    "员工年假规则是什么？", "那工作第{zh}年呢", "工作{n}年有几天年假", "二类违规是什么", "破坏学校管理秩序行为包括什么内容", "二类违规有哪些",
    "二类违规的处罚是什么", "我旷工{n}天会受到什么处罚", "旷工{zh}天会怎样", "一年内旷工{n}次怎么处理", "早退两次怎么处理", "学生迟到怎么处理",
    "骂人有什么处罚", "打听工资属于什么违规", "虚假报销怎么处罚", "我没有违规。", "5.{n} 是什么", "第5项 破坏学校管理秩序行为 的内容", "今年报销流程怎么申请", "没有师德会有什么处罚",
)
ZH = "一二三四五"


def questions(spark, sf_dir):
    """conv_id, turn, t (which question), n (its number), query."""
    d = table(spark, sf_dir, "conversations").withColumn("t", ((F.col("conv_id") * 3 + F.col("turn")) % len(QUESTIONS)).cast("int"))
    d = d.withColumn("n", (F.col("conv_id") % 5 + 1).cast("int"))
    text = F.get(F.array(*[F.lit(x) for x in QUESTIONS]), F.col("t"))
    text = F.replace(F.replace(text, F.lit("{n}"), F.col("n").cast("string")), F.lit("{zh}"), F.get(F.array(*[F.lit(c) for c in ZH]), F.col("n") - 1))
    return d.withColumn("query", text)


def _list(xs):
    return "[" + ", ".join("'" + str(x) + "'" for x in xs) + "]"


ASKED = f"""
    asked AS (SELECT *, replace(replace({_list(QUESTIONS)}[t + 1], '{{n}}', CAST(n AS VARCHAR)), '{{zh}}', {_list(ZH)}[n]) AS q
              FROM (SELECT *, CAST((conv_id * 3 + turn) % {len(QUESTIONS)} AS INT) AS t, CAST(conv_id % 5 + 1 AS INT) AS n FROM conversations))
"""


def any_sql(field, terms):
    return "(" + " OR ".join(f"contains({field}, '{t}')" for t in terms) + ")" if terms else "false"


def hits_sql(field, terms):
    return f"array_to_string(list_filter({_list(terms)}, lambda x: contains({field}, x)), ',')"


def case_sql(field, pack):
    return "CASE " + " ".join(f"WHEN {any_sql(field, terms)} THEN '{v}'" for v, terms in pack) + " END"


def by_question(alias, pairs, default="NULL"):
    """CASE over the question number t."""
    return "CASE t " + " ".join(f"WHEN {t} THEN {v}" for t, v in pairs) + f" ELSE {default} END AS {alias}"


def q(value):
    return "'" + value + "'"


INTENT_ASPECT = f"""CASE WHEN {any_sql('q', rules.INTENT_ACTION)} THEN 'disciplinary_action' WHEN {any_sql('q', rules.INTENT_LISTING)} THEN 'section_listing'
    WHEN contains(q, '属于') AND {any_sql('q', rules.CLASS_WORDS)} THEN 'classification' WHEN {any_sql('q', rules.LEAVE_WORDS)} AND contains(q, '规则') THEN 'table_lookup'
    WHEN {any_sql('q', rules.INTENT_PROCESS)} THEN 'process' WHEN {any_sql('q', rules.INTENT_EXCEPTION)} THEN 'exception' WHEN {any_sql('q', rules.INTENT_TABLE)} THEN 'table_lookup'
    WHEN {any_sql('q', rules.INTENT_DEFINITION)} THEN 'definition' END"""
OBJECT = case_sql("q", [(e[0], e[1]) for e in rules.GLOSSARY])
KEY = "conv_id, turn"
WS = f"[{BLANKS}]"


@query(
    "g1_normalize",
    f"""WITH c AS (SELECT conv_id, turn, '  ' || text || chr(10) || '  x ' AS text FROM conversations)
        SELECT {KEY}, md5(trim(regexp_replace(text, '{WS}+', ' ', 'g'))) AS query_md5, 2 + 0 * turn AS leading_blanks, 1 + 0 * turn AS trailing_blanks,
        CAST(len(list_filter(string_split(text, ' '), lambda p: p = '')) AS BIGINT) AS blank_runs, CASE WHEN turn + 5 > 10 THEN 'top_k must be between 1 and 10' END AS reject_reason FROM c""",
)
def g1_normalize(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").withColumn("text", F.concat(F.lit("  "), "text", F.lit("\n  x "))).withColumn("k", F.col("turn") + 5)
    return u.normalize(d, "text", "k").select(
        "conv_id", "turn", F.md5("query").alias("query_md5"), F.col("leading_blanks").cast("bigint").alias("leading_blanks"),
        F.col("trailing_blanks").cast("bigint").alias("trailing_blanks"), F.col("blank_runs").cast("bigint").alias("blank_runs"), "reject_reason",
    )


@query(
    "g2_guardrails",
    f"""WITH {ASKED} SELECT {KEY}, {hits_sql("q || text", rules.SENSITIVE_TERMS)} AS sensitive_flags, {hits_sql("q || text", rules.DOMAIN_TERMS)} AS domain_terms,
        CASE WHEN {any_sql("q || text", rules.DOMAIN_TERMS)} THEN 'policy_question' ELSE 'needs_more_context' END AS domain_status,
        CASE WHEN {any_sql("q || text", rules.SENSITIVE_TERMS)} THEN 'warn' ELSE 'ok' END AS status FROM asked""",
)
def g2_guardrails(spark, sf_dir):
    d = questions(spark, sf_dir).select("conv_id", "turn", u.guardrails(F.concat("query", "text")).alias("g"))
    return d.select("conv_id", "turn", F.array_join("g.sensitive_flags", ",").alias("sensitive_flags"), F.array_join("g.domain_terms", ",").alias("domain_terms"), "g.domain_status", "g.status")


_MATCHED = "list_filter([" + ", ".join(f"CASE WHEN {any_sql('q', e[1])} THEN '{e[0]}' END" for e in rules.GLOSSARY) + "], lambda x: x IS NOT NULL)"
_EXPANDED = "list_concat(" * (len(rules.GLOSSARY) - 1) + f"CASE WHEN {any_sql('q', rules.GLOSSARY[0][1])} THEN {_list(rules.GLOSSARY[0][2])} ELSE [] END" + "".join(
    f", CASE WHEN {any_sql('q', e[1])} THEN {_list(e[2])} ELSE [] END)" for e in rules.GLOSSARY[1:]
)


@query(
    "g3_glossary",
    f"""WITH {ASKED}, x AS (SELECT conv_id, turn, q, {_MATCHED} AS m, {_EXPANDED} AS e FROM asked)
        SELECT {KEY}, m[1] AS target_object, array_to_string(m, ',') AS matched_entries, array_to_string(list_filter(e, lambda v, i: list_position(e, v) = i), ',') AS expansions FROM x""",
)
def g3_glossary(spark, sf_dir):
    d = questions(spark, sf_dir).select("conv_id", "turn", u.glossary(F.col("query")).alias("g"))
    return d.select("conv_id", "turn", "g.target_object", F.array_join("g.matched_entries", ",").alias("matched_entries"), F.array_join("g.expansions", ",").alias("expansions"))


@query("g4_aspects", f"WITH {ASKED} SELECT {KEY}, {INTENT_ASPECT} AS intent_aspect, {case_sql('q', rules.RESOLVER_ASPECTS)} AS resolver_aspect FROM asked")
def g4_aspects(spark, sf_dir):
    c = F.col("query")
    return questions(spark, sf_dir).select("conv_id", "turn", u.intent_aspect(c).alias("intent_aspect"), u.resolver_aspect(c).alias("resolver_aspect"))


@query(
    "g5_quantities",
    f"""WITH {ASKED} SELECT {KEY}, {by_question('duration', [(7, 'n'), (8, 'n')])}, {by_question('duration_unit', [(7, q('day')), (8, q('day'))])},
        {by_question('occurrences', [(9, 'n'), (10, 2)])}, {by_question('time_window', [(9, q('一年内'))])}, {by_question('day_count', [(7, 'n'), (8, 'n')])}, {by_question('times', [(9, 'n'), (10, 2)])} FROM asked""",
)
def g5_quantities(spark, sf_dir):
    c = F.col("query")
    d = questions(spark, sf_dir).select("conv_id", "turn", u.intent_quantities(c).alias("q"), u.day_count(c).alias("day_count"), u.occurrence_count(c).alias("times"))
    return d.select("conv_id", "turn", "q.duration", "q.duration_unit", "q.occurrences", "q.time_window", "day_count", "times")


@query("g6_work_year", f"WITH {ASKED} SELECT {KEY}, {by_question('work_year', [(1, 'n'), (2, 'n'), (9, 1)])} FROM asked")
def g6_work_year(spark, sf_dir):
    return questions(spark, sf_dir).select("conv_id", "turn", u.work_year(F.col("query")).alias("work_year"))


@query("g7_numerals", "SELECT conv_id, turn, CAST(conv_id % 100 AS INT) AS number FROM conversations")
def g7_numerals(spark, sf_dir):
    k = F.col("conv_id") % 100
    digit = lambda i: F.get(F.array(*[F.lit(c) for c in "零一二三四五六七八九"]), i.cast("int"))
    tens = F.when(k < 10, F.lit("")).when(k < 20, F.lit("十")).otherwise(F.concat(digit(F.floor(k / 10)), F.lit("十")))
    numeral = F.when(k == 0, digit(k)).when(F.col("turn") % 2 == 0, F.concat(tens, F.when(k % 10 == 0, F.lit("")).otherwise(digit(k % 10)))).otherwise(k.cast("string"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", cn_number(numeral).alias("number"))


@query(
    "g8_missing_conditions",
    f"""WITH {ASKED} SELECT {KEY}, CASE WHEN t = 12 THEN array_to_string(list_filter([CASE WHEN conv_id % 2 = 0 THEN NULL ELSE '对象为客户或来访者' END, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE '并引起投诉' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS missing FROM asked""",
)
def g8_missing_conditions(spark, sf_dir):
    k = F.col("conv_id")
    d = questions(spark, sf_dir).withColumn("query", F.concat("query", F.when(k % 2 == 0, "客户").otherwise(""), F.when(k % 3 == 0, "投诉").otherwise("")))
    return d.select("conv_id", "turn", F.array_join(u.glossary(F.col("query"))["missing_conditions"], ",").alias("missing"))


_TYPES = "CASE a " + " ".join(f"WHEN '{a}' THEN '{','.join(t)}'" for a, t in rules.ASPECT_EVIDENCE) + " ELSE '' END"


@query("g9_evidence_types", f"WITH {ASKED}, x AS (SELECT conv_id, turn, t, {INTENT_ASPECT} AS a FROM asked) SELECT {KEY}, {_TYPES} || CASE WHEN t = 12 THEN ',condition_evidence' ELSE '' END AS evidence_types FROM x")
def g9_evidence_types(spark, sf_dir):
    return u.understand(questions(spark, sf_dir)).select("conv_id", "turn", F.array_join("intent.evidence_types", ",").alias("evidence_types"))


_WHO = f"CASE WHEN {any_sql('q', ('学生', '孩子'))} THEN 'student' WHEN contains(q, '家长') THEN 'guardian' WHEN coalesce(o IN ({', '.join(q(x) for x in rules.EMPLOYEE_OBJECTS)}), false) OR {any_sql('q', rules.EMPLOYEE_WORDS)} THEN 'employee' ELSE 'unknown' END"


@query("g10_audience", f"WITH {ASKED}, x AS (SELECT *, {OBJECT} AS o FROM asked) SELECT {KEY}, {_WHO} AS audience FROM x")
def g10_audience(spark, sf_dir):
    return u.understand(questions(spark, sf_dir)).select("conv_id", "turn", "intent.audience")


@query(
    "g11_confidence",
    f"""WITH {ASKED}, x AS (SELECT *, {OBJECT} AS o, {INTENT_ASPECT} AS a FROM asked)
        SELECT {KEY}, round(CAST(0.25 + CASE WHEN o IS NOT NULL THEN 0.35 ELSE 0 END + CASE WHEN a IS NOT NULL THEN 0.25 ELSE 0 END + CASE WHEN t IN (2, 7, 8, 9, 10) THEN 0.1 ELSE 0 END - CASE WHEN t = 12 THEN 0.15 ELSE 0 END AS DOUBLE), 2) AS confidence FROM x""",
)
def g11_confidence(spark, sf_dir):
    return u.understand(questions(spark, sf_dir)).select("conv_id", "turn", "intent.confidence")


@query("g12_section_lookup", f"WITH {ASKED} SELECT {KEY}, CASE WHEN t IN (3, 5, 6) THEN '二类违规行为' END AS section, CASE WHEN t IN (3, 5, 6) THEN '一类违规行为,三类违规行为' ELSE '' END AS excluded, CASE WHEN t IN (3, 5, 6) THEN '二类违规,二类违规行为' ELSE '' END AS terms FROM asked")
def g12_section_lookup(spark, sf_dir):
    d = questions(spark, sf_dir).select("conv_id", "turn", u.section_lookup(F.col("query")).alias("s"))
    return d.select("conv_id", "turn", "s.section", F.array_join("s.exclude_sections", ",").alias("excluded"), F.array_join("s.terms", ",").alias("terms"))


@query(
    "g13_clause_lookup",
    f"""WITH {ASKED} SELECT {KEY}, CASE WHEN t = 17 THEN '二类违规行为' END AS section, CASE WHEN t = 17 THEN '5. 破坏学校管理秩序行为' END AS clause, t = 4 AS ambiguous,
        CASE WHEN t = 4 THEN '二类违规行为,一类违规行为,三类违规行为' ELSE '' END AS options FROM asked""",
)
def g13_clause_lookup(spark, sf_dir):
    d = questions(spark, sf_dir).select("conv_id", "turn", u.clause_lookup(F.col("query")).alias("c"))
    options = F.array_join(F.transform("c.options", lambda o: o["section"]), ",")
    return d.select("conv_id", "turn", "c.selected.section", "c.selected.clause", F.coalesce("c.ambiguous", F.lit(False)).alias("ambiguous"), F.coalesce(options, F.lit("")).alias("options"))


_OWN = [(3, q("二类违规行为")), (5, q("二类违规行为")), (6, q("二类违规行为")), (10, q("三类违规行为")), (12, q("三类违规行为")), (13, q("二类违规行为")), (14, q("二类违规行为")), (17, q("二类违规行为")), (19, q("二类违规行为"))]
_CONTEXT = f"""
    ctx AS (SELECT *, CASE WHEN turn = 0 THEN NULL WHEN (t + 19) % 20 = 4 THEN CASE WHEN turn >= 2 THEN '二类违规行为' END
              ELSE CASE (t + 19) % 20 {' '.join(f'WHEN {a} THEN {b}' for a, b in _OWN)} END END AS context_section,
              CASE WHEN turn = 0 THEN false WHEN t = 1 THEN true WHEN t = 2 THEN turn >= 2 WHEN t = 3 THEN true ELSE false END AS context_leave FROM asked)
"""


@query(
    "g14_context_clause",
    f"WITH {ASKED}, {_CONTEXT} SELECT {KEY}, context_section, CASE WHEN t = 4 AND context_section IS NOT NULL THEN context_section || ' > 5. 破坏学校管理秩序行为' END AS context_clause FROM ctx",
)
def g14_context_clause(spark, sf_dir):
    d = u.resolve_ambiguity(u.with_context(questions(spark, sf_dir)))
    path = F.concat("context_clause.section", F.lit(" > "), "context_clause.clause")
    return d.select("conv_id", "turn", "context_section", path.alias("context_clause"))


USER_RULES = (
    {"rule_id": "quiet", "fact": "errors", "operator": "<", "threshold": 2}, {"rule_id": "exactly_five", "fact": "errors", "operator": "==", "threshold": 5},
    {"rule_id": "noisy", "fact": "errors", "operator": ">=", "threshold": 4},
)


@query(
    "g15_threshold_rules",
    """WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id)
       SELECT user_id, errors, CASE WHEN errors < 2 THEN 'quiet' WHEN errors = 5 THEN 'exactly_five' WHEN errors >= 4 THEN 'noisy' END AS rule_id,
              CASE WHEN errors < 2 THEN errors || ' < 2' WHEN errors = 5 THEN '5 == 5' WHEN errors >= 4 THEN errors || ' >= 4' END AS comparison FROM c""",
)
def g15_threshold_rules(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"))
    d = c.select("user_id", "errors", u.match_rules({"errors": F.col("errors")}, USER_RULES).alias("r"))
    return d.select("user_id", "errors", "r.rule_id", "r.comparison")


@query(
    "g15_absence_rules",
    f"""WITH {ASKED} SELECT {KEY}, CASE WHEN t IN (7, 8) AND n < 3 THEN 'absence_under_3_workdays' WHEN t IN (7, 8) THEN 'absence_3_or_more_workdays' WHEN t = 9 AND n >= 2 THEN 'absence_twice_or_more_in_one_year' END AS rule_id,
        CASE WHEN t IN (7, 8) AND n < 3 THEN n || ' < 3' WHEN t IN (7, 8) THEN n || ' >= 3' WHEN t = 9 AND n >= 2 THEN n || ' >= 2' END AS comparison FROM asked""",
)
def g15_absence_rules(spark, sf_dir):
    d = questions(spark, sf_dir).select("conv_id", "turn", u.absence_rule(F.col("query")).alias("r"))
    return d.select("conv_id", "turn", "r.rule_id", "r.comparison")


_BEHAVIOR = [(7, "absenteeism", "旷工"), (8, "absenteeism", "旷工"), (9, "absenteeism", "旷工"), (10, "lateness", "早退"), (11, "lateness", "迟到"), (12, "abusive_language", "语言不得体"),
             (13, "salary_inquiry", "打听工资"), (14, "false_reimbursement", "虚假报销"), (19, "teacher_ethics", "师德师风失范")]


@query(
    "g16_behavior",
    f"WITH {ASKED} SELECT {KEY}, {by_question('behavior', [(t, q(b)) for t, b, _ in _BEHAVIOR])}, {by_question('label', [(t, q(x)) for t, _, x in _BEHAVIOR])} FROM asked",
)
def g16_behavior(spark, sf_dir):
    d = questions(spark, sf_dir).select("conv_id", "turn", u.behavior(F.col("query")).alias("b"))
    return d.select("conv_id", "turn", "b.behavior", "b.label")


@query(
    "g17_subclause",
    f"WITH {ASKED} SELECT {KEY}, nullif(regexp_extract(' ' || q || text || ' ', '[^0-9]([0-9]{{1,2}}\\.[0-9]+)', 1), '') AS subclause FROM asked",
)
def g17_subclause(spark, sf_dir):
    return questions(spark, sf_dir).select("conv_id", "turn", u.subclause_mention(F.concat("query", "text")).alias("subclause"))


@query(
    "g18_hints",
    f"""WITH {ASKED} SELECT {KEY}, coalesce({case_sql('q', rules.CATEGORY_HINTS)}, 'general') AS category,
        CASE WHEN {any_sql('q', rules.AUDIENCE_STUDENT)} THEN 'student_or_stage_specific' WHEN {any_sql('q', rules.AUDIENCE_EMPLOYEE)} THEN 'employee' ELSE 'unknown' END AS audience,
        coalesce({case_sql('q', rules.INTENT_HINTS)}, 'rule_lookup') AS intent, {hits_sql('q', rules.TIME_HINTS)} AS times, {hits_sql('q', rules.EXTRACTED_TERMS)} AS terms,
        array_to_string(list_filter([CASE WHEN NOT {any_sql('q', rules.AUDIENCE_STUDENT + rules.AUDIENCE_EMPLOYEE)} THEN 'missing_audience' END,
          CASE WHEN {any_sql('q', rules.RELATIVE_TIME)} AND NOT regexp_matches(q, '[0-9]') THEN 'relative_time_without_year' END], lambda x: x IS NOT NULL), ',') AS flags FROM asked""",
)
def g18_hints(spark, sf_dir):
    d = questions(spark, sf_dir).select("conv_id", "turn", u.hints(F.col("query")).alias("h"))
    join = lambda c: F.array_join(f"h.{c}", ",").alias(c)
    return d.select("conv_id", "turn", "h.category", "h.audience", "h.intent", join("times"), join("terms"), join("flags"))


@query("g19_bare_assertion", f"WITH {ASKED} SELECT {KEY}, t = 15 AS is_assertion FROM asked")
def g19_bare_assertion(spark, sf_dir):
    return questions(spark, sf_dir).select("conv_id", "turn", u.is_bare_assertion(F.col("query")).alias("is_assertion"))


FOLLOW_UP_SQL = f"""WITH {ASKED}, {_CONTEXT}
        SELECT {KEY}, t IN (1, 2) AND context_leave AS is_follow_up, CASE WHEN t = 2 OR (t = 1 AND context_leave) THEN n END AS requested_year,
               CASE WHEN t IN (0, 2) OR (t = 1 AND context_leave) THEN 'leave' WHEN t IN (3, 5, 6, 10, 12, 13, 14, 17, 19) OR (t = 4 AND context_section IS NOT NULL) THEN 'section' END AS next_topic,
               CASE WHEN t = 4 THEN context_section ELSE CASE t {' '.join(f'WHEN {a} THEN {b}' for a, b in _OWN)} END END AS next_section FROM ctx"""


def follow_ups(spark, sf_dir):
    return u.follow_up(u.resolve_ambiguity(u.with_context(questions(spark, sf_dir))))


@query("g20_follow_up", FOLLOW_UP_SQL)
def g20_follow_up(spark, sf_dir):
    return follow_ups(spark, sf_dir).select("conv_id", "turn", "is_follow_up", "requested_year", "next_topic", "next_section")


def _unique(*groups):
    return list(dict.fromkeys(x for g in groups for x in g))


def _behavior_terms(name):
    b = next(x for x in rules.BEHAVIORS if x["behavior"] == name)
    return _unique(b["triggers"], b["search"], b["classes"], b["titles"])


def _rule_terms(i):
    r = rules.RULES[i]
    return _unique(rules.ABSENCE_TERMS, rules.ABSENCE_TITLES, r["search"], r["classes"])


SECTION_TERMS = ["二类违规", "二类违规行为"]
CLAUSE_TERMS = ["二类违规行为", "5. 破坏学校管理秩序行为", "破坏学校管理秩序行为", "破坏学校管理秩序"]
# Expected target terms by question number; absence questions depend on their number.
TERMS = {
    3: SECTION_TERMS, 5: SECTION_TERMS, 6: _unique(SECTION_TERMS, rules.ACTION_RETRIEVAL), 10: _unique(_behavior_terms("lateness"), rules.ACTION_RETRIEVAL),
    12: _unique(_behavior_terms("abusive_language"), rules.ACTION_RETRIEVAL), 13: _behavior_terms("salary_inquiry"),
    14: _unique(_behavior_terms("false_reimbursement"), rules.ACTION_RETRIEVAL), 17: CLAUSE_TERMS, 19: _unique(_behavior_terms("teacher_ethics"), rules.ACTION_RETRIEVAL),
    4: ["破坏学校管理秩序行为"],
}
UNDER, OVER, TWICE = (_unique(_rule_terms(i), rules.ACTION_RETRIEVAL) for i in range(3))
NO_RULE = _unique(_behavior_terms("absenteeism"), rules.ACTION_RETRIEVAL)
_TERMS_SQL = (
    "CASE " + " ".join(f"WHEN t = {t} THEN {_list(v)}" for t, v in TERMS.items())
    + f" WHEN t IN (7, 8) AND n < 3 THEN {_list(UNDER)} WHEN t IN (7, 8) THEN {_list(OVER)} WHEN t = 9 AND n >= 2 THEN {_list(TWICE)} WHEN t = 9 THEN {_list(NO_RULE)}"
    + " WHEN t = 16 THEN ['5.' || n] ELSE []::VARCHAR[] END"
)
_SECTION = "CASE t " + " ".join(f"WHEN {a} THEN {b}" for a, b in _OWN) + " END"
_CLAUSE = "CASE t " + " ".join(f"WHEN {t} THEN '{next(b['clause'] for b in rules.BEHAVIORS if b['behavior'] == name)}'" for t, name, _ in _BEHAVIOR if name != "absenteeism" and t != 11) + " WHEN 17 THEN '5. 破坏学校管理秩序行为' END"
_INTENT = "CASE WHEN t = 4 THEN 'ambiguous_policy_lookup' WHEN t IN (3, 5, 6, 7, 8, 9, 10, 12, 13, 14, 16, 17, 19) THEN 'exact_policy_lookup' ELSE 'semantic_policy_lookup' END"


# Specs with the clause that the context gives: question 4 becomes exact where its context has a section.
_RESOLVED = f"""{ASKED}, {_CONTEXT},
    rs AS (SELECT *, t IN (1, 2) AND context_leave AS follow, t = 15 AS bare, t = 4 AND context_section IS NOT NULL AS cleared,
             CASE WHEN t IN (4, 17) THEN 'clause_detail' ELSE {case_sql('q', rules.RESOLVER_ASPECTS)} END AS ans,
             CASE WHEN t IN (4, 17) THEN 'clause_detail' WHEN t IN (6, 7, 8, 9, 10, 11, 12, 14, 19) THEN 'disciplinary_action' END AS asked,
             CASE WHEN {any_sql('q', rules.AUDIENCE_STUDENT)} THEN 'student_or_stage_specific' WHEN {any_sql('q', rules.AUDIENCE_EMPLOYEE)} THEN 'employee' ELSE 'unknown' END AS who FROM ctx),
    rv AS (SELECT *, CASE WHEN bare THEN 'unsupported_policy_assertion' WHEN cleared THEN 'exact_policy_lookup' ELSE {_INTENT} END AS ri FROM rs)
"""


def resolved_turns(spark, sf_dir):
    """Every turn with its spec (clauses from the context included), intent and resolved meaning."""
    d = u.lookup_spec(follow_ups(spark, sf_dir), context_clause="context_clause")
    return u.next_context(u.resolved(u.understand(d)))


@query(
    "g18_resolved_intent",
    f"""WITH {_RESOLVED} SELECT {KEY}, ri AS retrieval_intent,
        CASE WHEN bare THEN 'unsupported_policy_assertion' WHEN ri = 'ambiguous_policy_lookup' THEN 'policy_ambiguity_resolution'
          WHEN ri = 'exact_policy_lookup' THEN CASE ans WHEN 'disciplinary_action' THEN 'policy_disciplinary_action_lookup' WHEN 'section_listing' THEN 'policy_section_listing_lookup'
            WHEN 'clause_detail' THEN 'policy_clause_detail_lookup' ELSE 'policy_definition_lookup' END
          ELSE coalesce({case_sql('q', rules.INTENT_HINTS)}, 'rule_lookup') END AS intent,
        CASE WHEN follow THEN 'leave' ELSE coalesce({case_sql('q', rules.CATEGORY_HINTS)}, 'general') END AS category, CASE WHEN follow THEN 'employee' ELSE who END AS audience,
        concat_ws(',', CASE WHEN who = 'unknown' AND NOT follow THEN 'missing_audience' END,
          CASE WHEN {any_sql('q', rules.RELATIVE_TIME)} AND NOT regexp_matches(q, '[0-9]') THEN 'relative_time_without_year' END, CASE WHEN bare THEN 'needs_specific_behavior' END) AS flags,
        array_to_string(list_concat(list_filter({_list(rules.EXTRACTED_TERMS)}, lambda x: contains(q, x)), CASE WHEN follow THEN ['{rules.ANNUAL_LEAVE}'] ELSE [] END), ',') AS terms,
        CASE WHEN follow THEN 'annual_leave_days' WHEN NOT bare THEN ans END AS answer_aspect, CASE WHEN follow THEN 'annual_leave_days' WHEN NOT bare THEN asked END AS asked_aspect FROM rv""",
)
def g18_resolved_intent(spark, sf_dir):
    d = resolved_turns(spark, sf_dir)
    r = lambda *names: [f"resolved.{n}" for n in names]
    return d.select(
        "conv_id", "turn", *r("retrieval_intent", "intent", "category", "audience", "answer_aspect", "asked_aspect"),
        F.array_join("resolved.flags", ",").alias("flags"), F.array_join("resolved.terms", ",").alias("terms"),
    )


@query(
    "g19_assertion_override",
    f"""WITH {_RESOLVED} SELECT {KEY}, bare AS is_assertion, CASE WHEN bare THEN '' WHEN cleared THEN '{",".join(CLAUSE_TERMS)}' ELSE array_to_string({_TERMS_SQL}, ',') END AS target_terms,
        CASE WHEN bare THEN 'unsupported_assertion' WHEN follow THEN 'benefit_rule' ELSE {case_sql('q', [(e[3], e[1]) for e in rules.GLOSSARY])} END AS target_object_type,
        CASE WHEN bare THEN '{",".join(rules.ASSERTION_CONDITIONS)}' WHEN t = 12 THEN '对象为客户或来访者,并引起投诉' ELSE '' END AS missing_conditions,
        CASE WHEN bare THEN '{rules.ASSERTION_NOTE}' WHEN follow THEN '{rules.INHERITED_NOTE}' END AS note,
        CASE WHEN t IN (7, 8) AND n < 3 THEN '{",".join(rules.RULES[0]["actions"])}' WHEN t IN (7, 8) THEN '{",".join(rules.RULES[1]["actions"])}' WHEN t = 9 AND n >= 2 THEN '{",".join(rules.RULES[2]["actions"])}' ELSE '' END AS expected_evidence FROM rv""",
)
def g19_assertion_override(spark, sf_dir):
    join = lambda c: F.array_join(f"resolved.{c}", ",").alias(c.split(".")[-1])
    return resolved_turns(spark, sf_dir).select(
        "conv_id", "turn", (F.col("resolved.retrieval_intent") == "unsupported_policy_assertion").alias("is_assertion"), join("target_terms"), "resolved.schema.target_object_type",
        join("schema.missing_conditions"), "resolved.schema.note", join("expected_evidence"),
    )


@query(
    "g20_inherited_schema",
    f"""WITH {_RESOLVED}, s AS (SELECT *, CASE WHEN follow THEN '{rules.ANNUAL_LEAVE}' WHEN NOT bare THEN {OBJECT} END AS target_object FROM rv)
        SELECT {KEY}, target_object, CASE WHEN follow THEN 'annual_leave_days' WHEN NOT bare THEN {INTENT_ASPECT} END AS asked_aspect,
        CASE WHEN t = 2 OR follow THEN n END AS work_year, CASE WHEN follow THEN '{rules.INHERITED_REASON}' END AS inherited_because,
        CASE WHEN follow THEN '{",".join(rules.INHERITED_EXPANSIONS)}' WHEN bare THEN '' ELSE array_to_string(list_filter({_EXPANDED}, lambda v, i: list_position({_EXPANDED}, v) = i), ',') END AS expansions,
        CASE WHEN follow THEN 'table_evidence' END AS inherited_evidence, CASE WHEN follow OR bare THEN 0.9::DOUBLE END AS set_confidence,
        CASE WHEN t IN (0, 2) OR follow THEN 'leave' WHEN t IN (3, 5, 6, 10, 12, 13, 14, 17, 19) OR cleared THEN 'section' END AS next_topic,
        CASE WHEN t IN (0, 2) OR follow THEN NULL WHEN cleared THEN context_section ELSE {_SECTION} END AS next_section,
        CASE WHEN t IN (0, 2) OR follow THEN NULL WHEN cleared THEN '5. 破坏学校管理秩序行为' ELSE {_CLAUSE} END AS next_clause,
        CASE WHEN t IN (0, 2) OR follow THEN 'annual_leave_days' WHEN t IN (3, 5, 6, 10, 12, 13, 14, 17, 19) OR cleared THEN coalesce(ans, asked) END AS next_aspect,
        CASE WHEN t IN (0, 2) OR follow OR t IN (3, 5, 6, 10, 12, 13, 14, 17, 19) OR cleared THEN ri END AS next_intent FROM s""",
)
def g20_inherited_schema(spark, sf_dir):
    follow, s, x = F.col("resolved.inherited_because").isNotNull(), "resolved.schema", F.col("next_context")
    judged = F.col("resolved.retrieval_intent") == "unsupported_policy_assertion"
    return resolved_turns(spark, sf_dir).select(
        "conv_id", "turn", f"{s}.target_object", f"{s}.asked_aspect", f"{s}.work_year", "resolved.inherited_because", F.array_join(f"{s}.expansions", ",").alias("expansions"),
        F.when(follow, F.array_join(f"{s}.evidence_types", ",")).alias("inherited_evidence"), F.when(follow | judged, F.col(f"{s}.confidence")).alias("set_confidence"),
        F.when(x["category"] == "leave", "leave").when(x["target_section"].isNotNull(), "section").alias("next_topic"), x["target_section"].alias("next_section"),
        x["target_clause"].alias("next_clause"), x["answer_aspect"].alias("next_aspect"), x["retrieval_intent"].alias("next_intent"),
    )


@query(
    "g21_rewrite",
    f"""WITH {ASKED}, x AS (SELECT conv_id, turn, t, q, list_concat({_TERMS_SQL}, list_filter([{_SECTION}, {_CLAUSE}], lambda v: v IS NOT NULL)) AS terms FROM asked),
        s AS (SELECT *, CASE WHEN t = 2 THEN q || ' 规则' WHEN t = 15 THEN '员工 ' || q WHEN t = 11 THEN q ELSE q END AS standalone,
                CASE WHEN t IN (0, 2) THEN ['年休假', '带薪年休假', '休假管理办法'] WHEN t IN (1, 4, 11, 15, 18) THEN []::VARCHAR[] ELSE terms END AS raw FROM x),
        a AS (SELECT *, list_filter(raw, lambda v, i: list_position(raw, v) = i AND NOT contains(standalone, v)) AS added FROM s)
        SELECT conv_id, turn, standalone, array_to_string(list_concat([standalone], added), ' ') AS expanded FROM a""",
)
def g21_rewrite(spark, sf_dir):
    d = u.lookup_spec(questions(spark, sf_dir)).withColumn("h", u.hints(F.col("query")))
    terms = F.concat("spec.target_terms", F.array_compact(F.array("spec.target_section", "spec.target_clause")))
    r = u.rewrite(F.col("query"), F.col("spec.retrieval_intent"), F.col("h.category"), F.col("h.audience"), terms)
    return d.withColumn("r", r).select("conv_id", "turn", "r.standalone", "r.expanded")


@query(
    "g22_lookup_spec",
    f"""WITH {ASKED} SELECT {KEY}, {_INTENT} AS retrieval_intent, array_to_string({_TERMS_SQL}, ',') AS target_terms, {_SECTION} AS target_section, {_CLAUSE} AS target_clause,
        CASE t WHEN 10 THEN '5.1' WHEN 12 THEN '4.2' WHEN 13 THEN '2.3' WHEN 14 THEN '4.3' WHEN 16 THEN '5.' || n WHEN 19 THEN '1.1' END AS target_subclause,
        {by_question('target_behavior', [(t, q(b)) for t, b, _ in _BEHAVIOR if t != 11])},
        CASE WHEN t IN (4, 17) THEN 'clause_detail' WHEN t IN (6, 7, 8, 9, 10, 12, 14, 19, 11) THEN 'disciplinary_action' END AS asked_aspect,
        CASE WHEN t IN (4, 17) THEN 'clause_detail' ELSE {case_sql('q', rules.RESOLVER_ASPECTS)} END AS answer_aspect,
        CASE WHEN t IN (3, 5, 6, 13, 14, 17, 19) THEN '一类违规行为,三类违规行为' WHEN t IN (10, 12) THEN '一类违规行为,二类违规行为' ELSE '' END AS exclude_sections,
        CASE WHEN t = 12 THEN '对象为客户或来访者,并引起投诉' ELSE '' END AS missing_conditions FROM asked""",
)
def g22_lookup_spec(spark, sf_dir):
    d = u.lookup_spec(questions(spark, sf_dir))
    join = lambda c: F.array_join(f"spec.{c}", ",").alias(c)
    return d.select(
        "conv_id", "turn", "spec.retrieval_intent", join("target_terms"), "spec.target_section", "spec.target_clause", "spec.target_subclause", "spec.target_behavior",
        "spec.asked_aspect", "spec.answer_aspect", join("exclude_sections"), join("missing_conditions"),
    )


@query(
    "g23_retrieval_plan",
    f"""WITH {ASKED} SELECT {KEY}, CAST(greatest(turn + 1, least(24, (turn + 1) * 4)) AS BIGINT) AS candidate_limit,
        CASE WHEN t = 5 THEN 'policy_structure,' ELSE '' END || CASE WHEN {_INTENT} = 'exact_policy_lookup' THEN 'exact_match,sparse_keyword,' ELSE '' END || 'dense_vector' AS channels FROM asked""",
)
def g23_retrieval_plan(spark, sf_dir):
    d = u.lookup_spec(questions(spark, sf_dir))
    p = u.retrieval_plan(F.col("turn") + 1, F.col("spec.retrieval_intent"), F.col("spec.answer_aspect"))
    return d.select("conv_id", "turn", p["candidate_limit"].cast("bigint").alias("candidate_limit"), F.array_join(p["channels"], ",").alias("channels"))


@query(
    "h3_term_groups",
    f"""WITH {ASKED}, x AS (SELECT conv_id, turn, q, list_concat(list_concat({_TERMS_SQL}, list_filter([{_CLAUSE}, CASE t WHEN 10 THEN '5.1' WHEN 12 THEN '4.2' WHEN 13 THEN '2.3' WHEN 14 THEN '4.3' WHEN 16 THEN '5.' || n WHEN 19 THEN '1.1' END], lambda v: v IS NOT NULL)),
            CASE WHEN t IN (7, 8) AND n < 3 THEN {_list(rules.UNDER_THREE_TERMS)} WHEN t IN (7, 8) OR (t = 9 AND n >= 2) THEN {_list(rules.THREE_OR_MORE_TERMS)} WHEN t IN (9, 10, 12, 13, 14, 19) THEN []::VARCHAR[] ELSE []::VARCHAR[] END) AS p,
            {_SECTION} AS s FROM asked)
        SELECT {KEY}, array_to_string(list_filter(p, lambda v, i: list_position(p, v) = i), ',') AS primary_terms, coalesce(s, '') AS secondary_terms,
               array_to_string(list_filter(string_split(trim(translate(q, '？?', '  ')), ' '), lambda v: length(v) >= 2), ',') AS query_terms FROM x""",
)
def h3_term_groups(spark, sf_dir):
    from dossier.operators.retrieval import term_groups

    d = u.lookup_spec(questions(spark, sf_dir)).select("conv_id", "turn", "query", "spec.target_terms", "spec.target_clause", "spec.target_subclause", "spec.rule_search_terms", "spec.target_section")
    return term_groups(d, "query").select(
        "conv_id", "turn", F.array_join("primary_terms", ",").alias("primary_terms"), F.array_join("secondary_terms", ",").alias("secondary_terms"), F.array_join("query_terms", ",").alias("query_terms")
    )
