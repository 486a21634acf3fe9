"""Judging retrieved evidence: scores, scope, filters, duplicates and citations.

A candidate row holds query_id, rank, chunk columns (chunk_id, doc_id, block_id,
text, heading, meta_text, section_title, clause_title, chunk_type, items,
source, distance) and the question's `spec`, `intent` and `hints` structs.
Candidate lists are short (24 rows at most per request), so per-request windows
and groups are small whatever the number of requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier import rules
from dossier.functions.text import any_of, contains_any, find, hits, let, ordered_distinct, strings
from dossier.operators.retrieval import lexical_overlap

# Weights of the rule rerank score.
OVERLAP, HEADING = 0.2, 0.3
BONUS = {"term": 1.0, "section": 3.0, "definition": 4.0, "children": 10.0, "clause": 4.0, "object": 2.0, "behavior": 4.0, "title": 4.0, "aspect": 5.0}
PENALTY = {"indirect": 3.0, "reference": 6.0, "behavior": 6.0, "aspect": 5.0, "leak": 0.8}

c = F.col


def _text(x) -> Column:
    return F.coalesce(x, F.lit(""))


def exact() -> Column:
    return c("spec.retrieval_intent") == "exact_policy_lookup"


def haystack() -> Column:
    return F.concat_ws(" ", "text", F.array_join("heading", " "), "meta_text")


def is_listing() -> Column:
    hit = F.lit("section_listing")
    return F.coalesce(c("spec.answer_aspect") == hit, F.lit(False)) | F.coalesce(c("spec.asked_aspect") == hit, F.lit(False)) | F.coalesce(c("intent.asked_aspect") == hit, F.lit(False))


def is_detail() -> Column:
    hit = F.lit("clause_detail")
    return F.coalesce(c("spec.answer_aspect") == hit, F.lit(False)) | F.coalesce(c("spec.asked_aspect") == hit, F.lit(False))


def is_action() -> Column:
    return F.coalesce(c("spec.asked_aspect") == "disciplinary_action", F.lit(False))


def has(text: Column, needle: Column) -> Column:
    """The needle is given and occurs in the text."""
    return F.coalesce(F.contains(text, needle), F.lit(False)) & needle.isNotNull()


def section_variants(section: Column) -> Column:
    return F.array(*[F.concat(F.lit(m), section) for m in ("（一）", "（二）", "（三）")], F.concat(section, F.lit("：")), F.concat(section, F.lit(":")))


def has_definition(text: Column, section: Column) -> Column:
    marked = any_of(text, section_variants(section))
    said = F.coalesce(F.regexp_like(text, F.concat(section, F.lit(r"\s*[：:,，]?\s*指"))), F.lit(False))
    return section.isNotNull() & (marked | said)


def target_markers() -> Column:
    """Names under which the target may appear in a text."""
    s = c("spec.target_section")
    shared = strings(())
    for name, terms in rules.SHARED_MARKERS:
        shared = F.when(s == name, strings(terms)).otherwise(shared)
    absence = F.when(c("spec.target_behavior") == "absenteeism", strings(rules.ABSENCE_TERMS))
    return ordered_distinct(
        F.array(s, F.when(s.endswith("行为"), F.regexp_replace(s, "行为$", "")), c("spec.target_clause"), c("spec.target_subclause"), c("spec.target_behavior_label")), shared, absence
    )


def has_marker(text: Column) -> Column:
    return any_of(text, target_markers())


def has_aspect(text: Column) -> Column:
    return is_action() & contains_any(text, rules.ACTION_RETRIEVAL)


def class_signal(text: Column) -> Column:
    return contains_any(text, rules.CLASS_SIGNALS)


def reference_only() -> Column:
    """The text names the target and points elsewhere, without defining it."""
    t = c("text")
    named = has(t, c("spec.target_clause")) | has(t, c("spec.target_subclause")) | has(t, c("spec.target_section")) | any_of(t, c("spec.target_terms"))
    defined = has_definition(t, c("spec.target_section")) | has(t, c("spec.target_clause"))
    return exact() & (t != "") & named & ~defined & contains_any(t, rules.REFERENCE_TERMS)


def clause_title() -> Column:
    return F.coalesce("spec.clause_title", F.trim(F.regexp_replace("spec.target_clause", r"^\d{1,2}\.\s*", "")))


def detail_evidence() -> Column:
    h, s, k, title = haystack(), c("spec.target_section"), c("spec.target_clause"), clause_title()
    named = F.coalesce("clause_title", "section_title", F.lit(""))
    in_clause = has(h, k) | has(h, F.nullif(title, F.lit(""))) | F.coalesce(named == k, F.lit(False)) | F.coalesce(named == title, F.lit(False))
    return is_detail() & (F.coalesce(c("chunk_type"), F.lit("")) != "section_children") & (s.isNull() | has(h, s)) & in_clause


def metadata_scope() -> Column:
    k, s = c("spec.target_clause"), c("spec.target_section")
    return F.coalesce((c("clause_title") == k) | F.array_contains("section_path", k), F.lit(False)) | F.coalesce(
        (c("section_title") == s) | F.array_contains("section_path", s), F.lit(False)
    )


def direct_evidence() -> Column:
    """The candidate itself carries what the question asks for; the test depends on the kind of question."""
    t, k, sub = c("text"), c("spec.target_clause"), c("spec.target_subclause")
    behavior = c("spec.target_behavior")
    plain = has(t, k) | has(t, sub) | has_definition(t, c("spec.target_section")) | metadata_scope() | F.coalesce(c("scope_applied"), F.lit(False))
    signs = F.struct(has_marker(t).alias("marker"), has_aspect(t).alias("aspect"), class_signal(t).alias("signal"), (has(t, k) | has(t, sub)).alias("named"))

    def by_signs(v: Column) -> Column:
        classed = v["signal"] | v["named"]
        return (
            F.when(behavior == "absenteeism", v["marker"] & (v["aspect"] | v["signal"]))
            .when(behavior.isNotNull() & is_action(), v["marker"] & (v["aspect"] | classed)).when(behavior.isNotNull(), v["marker"] | classed)
            .when(is_action(), v["marker"] & v["aspect"]).otherwise(plain)
        )

    return F.when(~exact(), True).when(reference_only(), False).when(is_detail(), detail_evidence()).otherwise(let(signs, by_signs))


def structured_children() -> Column:
    s = c("spec.target_section")
    here = s.isNull() | F.coalesce(c("section_title") == s, F.lit(False)) | has(F.array_join("heading", " "), s)
    return is_listing() & F.coalesce(c("chunk_type") == "section_children", F.lit(False)) & here


def listing_title() -> Column:
    """Title a listing would show for the chunk: the heading below the section, the clause, or the first numbered title."""
    s = c("spec.target_section")
    at = F.array_position("heading", s)
    below = F.when(at > 0, F.get("heading", at.cast("int")))
    clause = F.when(c("clause_title").isNotNull() & (s.isNull() | (c("clause_title") != s)), c("clause_title"))
    found = F.nullif(F.trim(F.regexp_extract(F.regexp_replace("text", r"\s+", " "), r"(?<!\d)\d{1,2}\.\s*([^。；;：:]{2,40}?行为)", 1)), F.lit(""))
    return F.coalesce(below, clause, found)


def listing_evidence() -> Column:
    h = haystack()
    loose = has(h, c("spec.target_section")) & ~F.contains(h, F.lit("违规行为相应处理")) & listing_title().isNotNull()
    return is_listing() & F.when(structured_children(), F.size("items") > 0).otherwise(loose)


def evidence_class() -> Column:
    """Class of a candidate for its question."""
    return (
        F.when(~exact(), "semantic_candidate")
        .when(is_listing(), F.when(listing_evidence(), "listing_evidence").otherwise("irrelevant_or_insufficient_evidence"))
        .when(reference_only(), "cross_reference_evidence")
        .when(direct_evidence(), F.when(c("spec.target_behavior").isNotNull(), "direct_behavior_evidence").otherwise("direct_section_evidence"))
        .otherwise("irrelevant_or_insufficient_evidence")
    )


def usable(kind: Column) -> Column:
    return ~kind.isin("cross_reference_evidence", "irrelevant_or_insufficient_evidence")


def rule_score(df: DataFrame, query: str = "query") -> DataFrame:
    """Adds the deterministic rerank score and its reasons."""
    d = df.withColumn("_h", haystack())
    h, t = c("_h"), c("text")
    s, k, b = c("spec.target_section"), c("spec.target_clause"), c("spec.target_behavior")
    head = F.array_join("heading", "")
    asked = c("spec.asked_aspect").isNotNull()
    one = lambda cond, w: F.when(F.coalesce(cond, F.lit(False)), w).otherwise(0.0)
    term_hits = F.size(hits(h, c("spec.target_terms")))
    in_section = F.coalesce(c("section_title") == s, F.lit(False)) | F.coalesce(F.array_contains("section_path", s), F.lit(False)) | has(head, s)
    in_clause = F.coalesce(c("clause_title") == k, F.lit(False)) | F.coalesce(F.array_contains("section_path", k), F.lit(False)) | has(t, k)
    marker, aspect = has_marker(h), has_aspect(h)
    titled = any_of(h, c("spec.preferred_titles"))
    leaks = F.size(hits(h, F.concat("spec.exclude_sections", "spec.exclude_clauses")))
    flags = {
        "命中精确制度词": term_hits > 0, "命中目标章节": s.isNotNull() & in_section, "命中章节定义正文": has_definition(t, s), "命中结构化章节子项": structured_children(),
        "命中目标条款组": k.isNotNull() & in_clause, "命中目标对象": asked & marker, "命中行为对象": b.isNotNull() & marker, "命中优先制度": titled, "命中问题面": asked & aspect,
        "缺少目标章节/条款/行为本体，已降权": exact() & s.isNotNull() & ~direct_evidence(), "仅为参见型片段，不能作为最终证据": s.isNotNull() & reference_only(),
        "缺少行为对象，已降权": b.isNotNull() & ~marker, "缺少问题面证据，已降权": asked & ~aspect, "包含竞争章节，已降权": leaks > 0,
    }
    weights = dict(zip(flags, (None, *[BONUS[x] for x in ("section", "definition", "children", "clause", "object", "behavior", "title", "aspect")],
                               *[-PENALTY[x] for x in ("indirect", "reference", "behavior", "aspect")], None)))
    score = term_hits * BONUS["term"] - leaks * PENALTY["leak"]
    for name, w in weights.items():
        if w is not None:
            score = score + one(flags[name], w)
    overlap = lexical_overlap(h, c(query))
    leave = contains_any(head, ("年假", "年休假", "休假"))
    total = overlap * OVERLAP + one(leave, HEADING) + score + F.greatest(F.lit(0.0), 1.0 - c("distance"))
    reasons = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in flags.items()]))
    fallback = F.when((overlap > 0) | leave, F.lit("命中查询词和标题信号")).otherwise(F.lit("主要依赖向量距离，词项证据较弱"))
    return d.withColumn("deterministic_score", F.round(total, 4)).withColumn(
        "reason", F.when(F.size(reasons) > 0, F.array_join(reasons, "；")).otherwise(fallback)
    ).drop("_h")


# --- scope ----------------------------------------------------------------


def first_marker(text: Column, markers: Column, start: Column) -> Column:
    """Leftmost marker at or after `start` as struct<pos, order, marker>, null when none occurs."""
    found = F.transform(markers, lambda m, i: F.struct(F.when(m != "", find(text, m, start)).otherwise(-1).alias("pos"), i.alias("order"), m.alias("marker")))
    return F.array_min(F.filter(found, lambda f: f["pos"] >= 0))


def trimmed_end(text: Column, end: Column) -> Column:
    """Moves an end before the numbering that leads up to it."""
    before = F.substring(text, F.greatest(end - 16, F.lit(0)) + 1, F.least(end, F.lit(16)))
    number = F.regexp_extract(before, r"(?:^|\s)(\d{1,2}(?:\.\d+)*\s*)$", 1)
    bracket = F.regexp_extract(before, r"([（(][一二三四五六七八九十]+[）)]\s*)$", 1)
    return end - F.when(number != "", F.length(number)).otherwise(F.length(bracket))


def cut_scope(text: Column, starts: Column, ends: Column) -> Column:
    """Text from the first start marker to the first end marker behind it; null without a start."""
    def upto(s: Column) -> Column:
        after = s["pos"] + F.length(s["marker"])
        return let(
            first_marker(text, ends, after),
            lambda e: let(
                F.when(e.isNull(), F.length(text)).otherwise(trimmed_end(text, e["pos"])),
                lambda stop: F.nullif(F.trim(F.substring(text, s["pos"] + 1, F.greatest(stop - s["pos"], F.lit(0)))), F.lit("")),
            ),
        )

    return let(first_marker(text, starts, F.lit(0)), lambda s: F.when(s.isNotNull(), upto(s)))


def _excluded_ends() -> Column:
    sections = F.flatten(F.transform("spec.exclude_sections", lambda s: F.array(F.concat(F.lit("（一）"), s), F.concat(F.lit("（二）"), s), F.concat(F.lit("（三）"), s), s)))
    return F.coalesce(sections, strings(()))


def action_scope() -> Column:
    """Handling text of the asked level only; null when the text holds none."""
    s, t = c("spec.target_section"), c("text")
    starts = ends = strings(())
    for name, a, b in rules.ACTION_SCOPE:
        starts, ends = F.when(s == name, strings(a)).otherwise(starts), F.when(s == name, strings(b)).otherwise(ends)
    return F.when(is_action() & s.isNotNull() & contains_any(t, rules.ACTION_SCOPE_SIGNALS), cut_scope(t, starts, ends))


def general_scope() -> Column:
    """Text of the target clause, else of the target section, else of the absence rule."""
    t, s, k = c("text"), c("spec.target_section"), c("spec.target_clause")
    dotted = F.when(F.contains(k, F.lit(".")), F.regexp_replace(k, r"^([^.]*)\.", "$1. ")).otherwise(k)
    clause_starts = F.array_distinct(F.array(k, F.replace(k, F.lit(". "), F.lit(".")), dotted))
    following = (c("spec.target_clause_no").try_cast("int") + 1).cast("string")
    clause_ends = F.concat(F.coalesce("spec.exclude_clauses", strings(())), _excluded_ends(), F.array_compact(F.array(F.concat(following, F.lit(".")), F.concat(F.lit(" "), following, F.lit(".")))))
    section_starts = F.array(*[F.concat(F.lit(m), s) for m in ("（二）", "（一）", "（三）")], F.concat(s, F.lit("：")), s)
    key = c("spec.behavior_threshold")
    listed = (key == "continuous_absence_under_3_workdays") & F.contains(t, F.lit("旷工少于三天")) & class_signal(t)
    absence_starts = (
        F.when(listed, strings(("（二）二类违规行为", "(二)二类违规行为", "二类违规行为：", "二类违规行为")))
        .when(key == "continuous_absence_under_3_workdays", strings(("连续旷工3个工作日以下", "连续旷工 3 个工作日以下", "旷工3个工作日以下")))
        .when(key == "continuous_absence_3_or_more_workdays", strings(("连续旷工3个工作日及以上", "连续旷工 3 个工作日及以上", "一年内累计两次及以上旷工")))
        .otherwise(strings(("（三） 旷工", "（三）旷工", "旷工 凡符合", "连续旷工")))
    )
    absence_ends = (
        F.when(listed, strings(("（三）三类违规行为", "(三)三类违规行为", "三类违规行为")))
        .when(key == "continuous_absence_under_3_workdays", strings(("连续旷工3个工作日及以上", "连续旷工 3 个工作日及以上", "考勤结果", "五、假期标准")))
        .otherwise(strings(("考勤结果", "五、假期标准")))
    )
    return (
        F.when(k.isNotNull(), cut_scope(t, clause_starts, clause_ends)).when(s.isNotNull(), cut_scope(t, section_starts, _excluded_ends()))
        .when(c("spec.target_behavior") == "absenteeism", cut_scope(t, absence_starts, absence_ends))
    )


def apply_scope(df: DataFrame) -> DataFrame:
    """Replaces the text by its scoped part and marks the row; texts without a scope stay whole."""
    k = c("spec.target_clause")
    d = df.withColumn("_a", F.when(k.isNull() | ~has(c("text"), k), action_scope())).withColumn("_g", general_scope())
    scoped = F.when(exact() & (c("text") != ""), F.coalesce("_a", "_g"))
    return d.withColumn("_s", scoped).withColumn("scope_applied", c("_s").isNotNull()).withColumn("text", F.coalesce("_s", "text")).drop("_a", "_g", "_s")


# --- filters --------------------------------------------------------------

def per_query():
    return W.partitionBy("query_id")


def topic_terms() -> Column:
    category = strings(())
    for name, terms in rules.TOPIC_TERMS:
        category = F.when(c("hints.category") == name, strings(terms)).otherwise(category)
    return ordered_distinct(F.filter("hints.terms", lambda t: t != "员工"), category)


def student_scope() -> Column:
    scope = F.concat_ws(" ", F.array_join("heading", " "), "source")
    return contains_any(scope, rules.STUDENT_SCOPE) & ~F.contains(scope, F.lit("员工"))


def filter_evidence(df: DataFrame) -> DataFrame:
    """Keeps the evidence a question may use.

    Exact questions keep usable classes only. Other questions keep chunks on
    their topic, all of them when none is; questions about students keep
    student chunks only.
    """
    student = F.coalesce(c("hints.audience") == "student_or_stage_specific", F.lit(False)) | F.coalesce(c("intent.audience") == "student", F.lit(False)) & (c("hints.audience") == "unknown")
    d = df.withColumn("evidence_class", evidence_class()).withColumn("_student", student)
    d = d.filter(exact() | ~c("_student") | student_scope()).withColumn("_terms", topic_terms())
    on_topic = any_of(haystack(), c("_terms"))
    d = d.withColumn("_on", on_topic).withColumn("_any", F.max("_on").over(per_query()))
    keep = F.when(exact(), usable(c("evidence_class"))).otherwise((F.size("_terms") == 0) | c("_on") | ~c("_any"))
    return d.filter(keep).drop("_student", "_terms", "_on", "_any")


def evidence_key() -> Column:
    """What two candidates of a question must share to say the same thing."""
    t, b = c("text"), c("spec.target_behavior")
    doc = c("doc_id").cast("string")
    block, chunk = F.nullif(c("block_id"), F.lit("")), c("chunk_id").cast("string")
    own = F.coalesce(block, chunk)
    place = F.coalesce(block, F.when(F.size("heading") > 0, F.array_join("heading", "\u0002")), chunk)
    named = has(t, c("spec.target_behavior_label")) | has(t, c("spec.target_clause")) | has(t, c("spec.target_subclause"))
    section = F.coalesce("section_title", "spec.target_section", F.lit(""))
    join = lambda *xs: F.concat_ws("\u0001", doc, *xs)
    absence = F.when(contains_any(t, ("扣除旷工期间工资", "连续旷工", "一年内累计两次及以上旷工")), "behavior_penalty").when(class_signal(t), "behavior_classification").otherwise("behavior_support")
    return (
        F.when(b == "absenteeism", join(absence))
        .when(b.isNotNull() & has_aspect(t) & has(t, c("spec.target_section")), join(b, F.lit("violation_level_penalty")))
        .when(b.isNotNull() & named, join(b, F.lit("behavior_classification"))).when(b.isNotNull(), join(b, F.lit("behavior_support"), own))
        .when(c("spec.target_clause").isNotNull(), join(section, F.coalesce("clause_title", "spec.target_clause")))
        .when(is_listing() & c("spec.target_section").isNotNull(), join(section, F.coalesce(listing_title(), place)))
        .when(c("spec.target_section").isNotNull(), join(section))
        .when(F.size("section_path") > 0, join(F.array_join("section_path", "\u0002"))).otherwise(join(own))
    )


def dedupe(df: DataFrame, rank: str = "rank") -> DataFrame:
    """Marks every candidate after the first of its evidence key as a duplicate."""
    first = F.row_number().over(W.partitionBy("query_id", "_key").orderBy(rank))
    return df.withColumn("_key", evidence_key()).withColumn("is_duplicate", first > 1).drop("_key")


def select_complementary(df: DataFrame, rank: str = "rank") -> DataFrame:
    """Behavior questions keep the first penalty and the first classification chunk, else everything.

    Adds `role`: penalty, classification, both or null.
    """
    t, h, s = c("text"), haystack(), c("spec.target_section")
    b = c("spec.target_behavior")
    absence = b == "absenteeism"
    classes = c("spec.classification_terms")
    category = F.get(F.filter(strings(rules.SECTIONS), lambda x: F.array_contains(classes, x)), F.lit(0))
    specific = F.filter(classes, lambda x: (x != category) & (x != "破坏学校管理秩序行为"))
    by_rule = has(t, category) & class_signal(t) & (any_of(t, specific) | F.contains(t, F.lit("旷工")))
    no_rule = F.contains(t, F.lit("旷工少于三天")) & class_signal(t)
    scoped = s.isNull() | has(h, s)
    by_name = class_signal(h) & (has(t, c("spec.target_subclause")) | has(t, c("spec.target_behavior_label")) | (has(t, c("spec.target_clause")) & ~has_aspect(t)))
    classification = F.when(absence, F.when(category.isNotNull(), by_rule).otherwise(no_rule)).otherwise(scoped & by_name)
    penalty = F.when(absence, F.contains(t, F.lit("旷工")) & contains_any(t, ("扣除旷工期间工资", "记过处分", "辞退处分"))).otherwise(is_action() & has(t, s) & has_aspect(t))
    first = lambda cond: F.min(F.when(b.isNotNull() & F.coalesce(cond, F.lit(False)), c(rank))).over(per_query())
    d = df.withColumn("_p", first(penalty)).withColumn("_c", first(classification))
    is_p, is_c = F.coalesce(c(rank) == c("_p"), F.lit(False)), F.coalesce(c(rank) == c("_c"), F.lit(False))
    keep = (c("_p").isNull() & c("_c").isNull()) | is_p | is_c
    role = F.when(is_p & is_c, "both").when(is_p, "penalty").when(is_c, "classification")
    return d.withColumn("role", role).filter(keep).drop("_p", "_c")


# --- assessment -----------------------------------------------------------


def assess(text: Column, aspect: Column, terms: Column) -> Column:
    """Evidence type of a text for a question aspect, with matched and missing terms."""
    matched = hits(text, terms)
    any_hit = F.size(matched) > 0
    strong, classed = contains_any(text, rules.STRONG_ACTION_TERMS), contains_any(text, rules.CLASSIFICATION_TERMS)
    table_score = F.size(hits(text, rules.TABLE_TERMS)) + F.size(F.regexp_extract_all(text, F.lit(r"\d+\s*天"), F.lit(0)))
    poor = "insufficient_evidence"
    action = (
        F.when(contains_any(text, rules.DEFINITION_SIGNALS) & ~strong, poor).when(contains_any(text, rules.ACTION_TERMS) & (any_hit | classed), "action_evidence")
        .when(any_hit & classed, "classification_evidence").otherwise(poor)
    )
    pick = lambda cond, name: F.when(cond, name).otherwise(poor)
    kind = (
        F.when(contains_any(text, rules.REFERENCE_TERMS) & ~strong, "cross_reference_evidence").when(aspect == "disciplinary_action", action)
        .when(aspect == "classification", pick(any_hit & classed, "classification_evidence"))
        .when(aspect == "section_listing", pick(~contains_any(text, rules.LISTING_EXCLUDE) & any_hit & classed, "listing_evidence"))
        .when(aspect == "table_lookup", pick(any_hit & (table_score >= 3), "table_evidence"))
        .when(aspect == "definition", pick(any_hit & contains_any(text, rules.DEFINITION_SIGNALS), "definition_evidence"))
        .when(aspect == "process", pick(any_hit & contains_any(text, rules.PROCESS_TERMS), "process_evidence")).otherwise("semantic_candidate")
    )
    return F.struct(
        kind.alias("evidence_type"), (~kind.isin("insufficient_evidence", "cross_reference_evidence")).alias("usable_as_final"),
        matched.alias("matched_terms"), F.array_except(terms, matched).alias("missing_terms"),
    )


def intent_terms() -> Column:
    return ordered_distinct(F.array("intent.target_object"), c("intent.expansions"))


# What an aspect needs, which answer it gives and which sections that has.
PLANS = {
    "classification": ("classification_evidence", "classification", ("fact", "classification", "citations", "uncertainty")),
    "section_listing": ("listing_evidence", "section_listing", ("overview", "items", "citations", "uncertainty")),
    "table_lookup": ("table_evidence", "table_lookup", ("result", "table", "citations", "uncertainty")),
    "definition": ("definition_evidence", "definition", ("definition", "scope", "citations")),
    "process": ("process_evidence", "process", ("steps", "owner", "materials", "citations", "uncertainty")),
}


def plan_answers(questions: DataFrame, assessed: DataFrame) -> DataFrame:
    """One answer plan per question, also for questions without evidence.

    questions: query_id, aspect, missing (array), has_rule. assessed: query_id, rank, chunk_id, evidence_type, usable.
    """
    found = assessed.groupBy("query_id").agg(
        F.collect_set("evidence_type").alias("types"), F.array_sort(F.collect_list(F.when(c("usable"), F.struct("rank", "chunk_id")))).alias("cited"),
    )
    none = lambda name: F.coalesce(name, F.array().cast(found.schema[name].dataType))
    q = questions.select("query_id", "aspect", F.coalesce("missing", F.array().cast("array<string>")).alias("missing"), F.coalesce("has_rule", F.lit(False)).alias("has_rule"))
    q = q.join(found, "query_id", "left").withColumns({"types": none("types"), "cited": none("cited")})
    got = lambda t: F.array_contains("types", t)
    refuse = strings(("cannot_answer", "citations"))
    conditional = F.size("missing") > 0
    kind = F.when(c("aspect") == "disciplinary_action", F.when(~got("action_evidence"), "insufficient_evidence").when(conditional, "conditional_disciplinary_action").otherwise("disciplinary_action"))
    parts = F.array_compact(F.array(
        F.lit("fact"), F.when(conditional, F.lit("conditions")), F.when(c("has_rule"), F.lit("rule_match")),
        F.when(got("classification_evidence") | c("has_rule"), F.lit("classification")), F.lit("action"), F.lit("citations"), F.lit("uncertainty")))
    sections = F.when(c("aspect") == "disciplinary_action", F.when(got("action_evidence"), parts).otherwise(refuse))
    lacking = F.when((c("aspect") == "disciplinary_action") & ~got("action_evidence"), "action_evidence")
    for name, (need, answer, shape) in PLANS.items():
        here = c("aspect") == name
        kind = kind.when(here, F.when(got(need), answer).otherwise("insufficient_evidence"))
        sections = sections.when(here, F.when(got(need), strings(shape)).otherwise(refuse))
        lacking = lacking.when(here & ~got(need), need)
    return q.select(
        "query_id", kind.otherwise("grounded_summary").alias("answer_type"), sections.otherwise(strings(("summary", "citations", "uncertainty"))).alias("sections"),
        F.array_distinct(F.transform("cited", lambda x: x["chunk_id"])).alias("required_citations"), lacking.alias("lacking"),
        F.when(conditional & (c("aspect") == "disciplinary_action"), F.concat(F.lit("需要确认："), F.array_join("missing", "、"), F.lit("。"))).alias("note"),
    )


def leaked_markers(text: Column) -> Column:
    return hits(text, F.concat("spec.exclude_sections", "spec.exclude_clauses"))


def scope_guard(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Excluded markers that still show in the evidence of a question; one row per question. questions: query_id."""
    each = evidence.select("query_id", F.explode(leaked_markers(c("text"))).alias("m"))
    found = questions.select("query_id").join(each.groupBy("query_id").agg(F.array_sort(F.collect_set("m")).alias("leaked")), "query_id", "left")
    found = found.withColumn("leaked", F.coalesce("leaked", F.array().cast("array<string>")))
    return found.withColumn("status", F.when(F.size("leaked") == 0, "ok").otherwise("warn"))


def quality_checks(questions: DataFrame, evidence: DataFrame, score: str = "rerank_score") -> DataFrame:
    """Six named checks per question, one row each. questions: query_id.

    A question without evidence has no relevant score and no context to assemble; there is nothing to check of sources,
    dates and scope then.
    """
    q = evidence.groupBy("query_id").agg(
        F.max(score).alias("top"), F.bool_and(F.coalesce(c("source") != "", F.lit(False))).alias("sourced"), F.bool_or(c("effective_date").isNotNull()).alias("dated"),
        F.count("*").alias("n"), F.bool_or(F.size(leaked_markers(c("text"))) > 0).alias("leaks"),
    )
    q = questions.select("query_id").join(q, "query_id", "left")
    some = c("n").isNotNull()
    ok = lambda cond: F.when(cond, "ok").otherwise("warn")
    rows = F.array(*[
        F.struct(F.lit(n).alias("name"), v.alias("status"))
        for n, v in (("relevance_threshold", ok(c("top") >= 0.5)), ("source_metadata", ok(~some | c("sourced"))), ("freshness_conflict", ok(~some | c("dated"))),
                     ("context_assembly", ok(some)), ("scope_guard", ok(~some | ~c("leaks"))), ("citation_merge", F.lit("ok")))
    ])
    return q.select("query_id", F.explode(rows).alias("r")).select("query_id", "r.name", "r.status")


def citation(index: Column, title: Column, cn_title: Column, en_title: Column, heading: Column, doc_id: Column, url: Column, source: Column, import_id: Column) -> Column:
    """Numbered citation with title and address by order of preference."""
    given = lambda x: F.nullif(x, F.lit(""))
    name = F.coalesce(given(title), given(cn_title), given(en_title), given(F.array_join(heading, " > ")), doc_id)
    built = F.when(source == "company_policy_system", F.concat(F.lit("https://example.com/policyDetail/"), F.url_encode(import_id)))
    return F.struct(F.format_string("[%d]", index.cast("int")).alias("citation_id"), name.alias("title"), F.coalesce(given(url), built).alias("url"), F.coalesce(source, doc_id).alias("source"))


def source_line(cite: Column, category: Column, publish_date: Column) -> Column:
    meta = F.concat_ws(" / ", F.nullif(category, F.lit("")), F.nullif(publish_date, F.lit("")))
    where = F.coalesce(cite["url"], cite["source"])
    label = F.when(cite["url"].isNotNull(), "链接").otherwise("位置")
    return F.concat(cite["citation_id"], F.lit("《"), cite["title"], F.lit("》"), F.when(meta != "", F.concat(F.lit("（"), meta, F.lit("）"))).otherwise(""), F.lit(" "), label, F.lit("："), where)


def context_blocks(df: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    """The first k pieces of evidence per question, renumbered."""
    rn = F.row_number().over(W.partitionBy("query_id").orderBy(rank))
    return df.withColumn("block_no", rn).filter(c("block_no") <= k)


def children_selection(df: DataFrame, rank: str = "rank") -> DataFrame:
    """For listing questions the first structured children chunk: its items and whether their numbers run through."""
    d = df.filter(structured_children())
    return d.groupBy("query_id").agg(F.min_by(F.struct("chunk_id", "section_title", "items", "continuity"), rank).alias("s")).select(
        "query_id", "s.chunk_id", "s.section_title", "s.items", F.size("s.items").alias("child_count"), F.coalesce("s.continuity", F.lit("unknown")).alias("continuity")
    )
