"""Question understanding as column expressions over a table of questions.

Every rule is compiled from a rule pack into an expression of the question
text, so a batch of questions is one narrow pass. Only the conversation
context looks at other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import rules
from dossier.functions.text import (
    WS, any_of, cn_number, contains_any, first_rule, hits, let, ordered_distinct, squash, strings,
)
from dossier.operators.numbering import carry_forward

NO_TERMS = ()


def _when_any(q: Column, terms, values) -> Column:
    """The literal array `values` when any term occurs, else an empty array."""
    return F.when(contains_any(q, terms), strings(values)).otherwise(strings(()))


def normalize(df: DataFrame, text: str = "text", top_k: str | None = None) -> DataFrame:
    """Adds `query`, blank counts and a reject reason (null when the request is fine)."""
    t = F.coalesce(F.col(text), F.lit(""))
    reason = F.when(squash(t) == "", "query must contain text")
    if top_k is not None:
        reason = F.coalesce(reason, F.when(~F.col(top_k).between(1, 10), "top_k must be between 1 and 10"))
    return (
        df.withColumn("query", squash(t))
        .withColumn("leading_blanks", F.length(t) - F.length(F.regexp_replace(t, "^" + WS + "+", "")))
        .withColumn("trailing_blanks", F.length(t) - F.length(F.regexp_replace(t, WS + r"+\z", "")))
        .withColumn("blank_runs", F.size(F.filter(F.split(t, " ", -1), lambda p: p == "")))
        .withColumn("reject_reason", reason)
    )


def guardrails(q: Column) -> Column:
    sensitive, domain = hits(q, rules.SENSITIVE_TERMS), hits(q, rules.DOMAIN_TERMS)
    return F.struct(
        sensitive.alias("sensitive_flags"), domain.alias("domain_terms"),
        F.when(F.size(domain) > 0, "policy_question").otherwise("needs_more_context").alias("domain_status"),
        F.when(F.size(sensitive) > 0, "warn").otherwise("ok").alias("status"),
    )


def glossary(q: Column, entries=rules.GLOSSARY) -> Column:
    """Matched entries in order, the first as primary, expansions and the conditions that come with them."""
    matched = F.array_compact(F.array(*[F.when(contains_any(q, e[1]), F.lit(e[0])) for e in entries]))
    aliases = F.flatten(F.array(*[hits(q, e[1]) for e in entries]))
    expanded = ordered_distinct(*[_when_any(q, e[1], e[2]) for e in entries])
    conditions = ordered_distinct(*[_when_any(q, e[1], [n for n, _ in e[4]]) for e in entries])
    kind = F.lit(None).cast("string")
    for e in reversed(entries):
        kind = F.when(contains_any(q, e[1]), F.lit(e[3])).otherwise(kind)
    missing = F.array_compact(
        F.array(*[F.when(contains_any(q, e[1]) & ~contains_any(q, terms), F.lit(n)) for e in entries for n, terms in e[4]])
    )
    return F.struct(
        F.get(matched, F.lit(0)).alias("target_object"), kind.alias("target_object_type"), matched.alias("matched_entries"),
        F.array_distinct(aliases).alias("matched_aliases"), expanded.alias("expansions"), conditions.alias("required_conditions"),
        missing.alias("missing_conditions"),
    )


def intent_aspect(q: Column) -> Column:
    """Aspect by the intent reader's lists."""
    return (
        F.when(contains_any(q, rules.INTENT_ACTION), "disciplinary_action")
        .when(contains_any(q, rules.INTENT_LISTING), "section_listing")
        .when(F.contains(q, F.lit("属于")) & contains_any(q, rules.CLASS_WORDS), "classification")
        .when(contains_any(q, rules.LEAVE_WORDS) & F.contains(q, F.lit("规则")), "table_lookup")
        .when(contains_any(q, rules.INTENT_PROCESS), "process")
        .when(contains_any(q, rules.INTENT_EXCEPTION), "exception")
        .when(contains_any(q, rules.INTENT_TABLE), "table_lookup")
        .when(contains_any(q, rules.INTENT_DEFINITION), "definition")
    )


def resolver_aspect(q: Column) -> Column:
    """Aspect by the rule resolver's lists."""
    return first_rule(q, rules.RESOLVER_ASPECTS)


NUMBER = "([0-9]{1,2}|[一二两三四五六七八九十]{1,3})"


def intent_quantities(q: Column) -> Column:
    """First duration (with unit) and first occurrence count of a question."""
    day = rf"{NUMBER}\s*(?:个)?\s*(工作日|天|日)"
    times = rf"{NUMBER}\s*次"
    unit = F.regexp_extract(q, day, 2)
    return F.struct(
        cn_number(F.regexp_extract(q, day, 1)).alias("duration"),
        F.when(unit == "工作日", "workday").when(unit != "", "day").alias("duration_unit"),
        cn_number(F.regexp_extract(q, times, 1)).alias("occurrences"),
        F.when(q.rlike(times) & contains_any(q, ("一年", "一学年", "年内")), "一年内").alias("time_window"),
    )


def _quantity(q: Column, units: str) -> Column:
    """Resolver's reading: digits first, Chinese numerals only when there are none."""
    digits = F.regexp_extract(q, rf"([0-9]{{1,2}})\s*(?:个)?(?:{units})", 1)
    zh = F.regexp_extract(q, rf"([一二两三四五六七八九十]{{1,3}})\s*(?:个)?(?:{units})", 1)
    return F.when(digits != "", digits.try_cast("int")).otherwise(cn_number(zh))


def day_count(q: Column) -> Column:
    return _quantity(q, "工作日|天|日")


def occurrence_count(q: Column) -> Column:
    return _quantity(q, "次")


def work_year(q: Column, upper: int = 50) -> Column:
    """Asked year of service: 6 for the open-ended phrases, else the first number before 年 within range."""
    numbers = F.regexp_extract_all(q, F.lit(rf"{NUMBER}\s*年"), F.lit(1))
    values = F.filter(F.transform(numbers, lambda n: cn_number(n)), lambda v: v.isNotNull() & v.between(1, upper))
    return F.when(contains_any(q, rules.SIX_OR_MORE), 6).otherwise(F.get(values, F.lit(0)))


def evidence_types(aspect: Column, conditions: Column) -> Column:
    """Evidence types an aspect needs, plus condition evidence where the object has conditions."""
    base = strings(())
    for name, types in rules.ASPECT_EVIDENCE:
        base = F.when(aspect == name, strings(types)).otherwise(base)
    return F.when(F.size(conditions) > 0, F.array_union(base, strings(("condition_evidence",)))).otherwise(base)


def audience(q: Column, target_object: Column) -> Column:
    student = contains_any(q, ("学生", "孩子"))
    return (
        F.when(student, "student").when(F.contains(q, F.lit("家长")), "guardian")
        .when(F.coalesce(target_object.isin(*rules.EMPLOYEE_OBJECTS), F.lit(False)) | contains_any(q, rules.EMPLOYEE_WORDS), "employee")
        .otherwise("unknown")
    )


def confidence(has_object: Column, has_aspect: Column, has_conditions: Column, has_missing: Column) -> Column:
    one = lambda c, w: F.when(c, w).otherwise(0.0)
    score = 0.25 + one(has_object, 0.35) + one(has_aspect, 0.25) + one(has_conditions, 0.1) - one(has_missing, 0.15)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 2)))


def understand(df: DataFrame, query: str = "query") -> DataFrame:
    """Adds the `intent` struct of every question."""
    q = F.col(query)
    d = df.withColumn("_g", glossary(q)).withColumn("_a", intent_aspect(q)).withColumn("_n", intent_quantities(q))
    leave = F.coalesce(F.col("_g.target_object") == "年休假", F.lit(False)) | contains_any(q, ("年假", "年休假"))
    year = F.when(leave, work_year(q))
    given = F.col("_n.duration").isNotNull() | F.col("_n.occurrences").isNotNull() | year.isNotNull()
    return d.withColumn(
        "intent",
        F.struct(
            F.col("_g.target_object").alias("target_object"), F.col("_g.target_object_type").alias("target_object_type"), F.col("_a").alias("asked_aspect"),
            F.col("_n.duration").alias("duration"), F.col("_n.duration_unit").alias("duration_unit"), F.col("_n.occurrences").alias("occurrences"),
            F.col("_n.time_window").alias("time_window"), year.alias("work_year"), audience(q, F.col("_g.target_object")).alias("audience"),
            F.col("_g.expansions").alias("expansions"), evidence_types(F.col("_a"), F.col("_g.required_conditions")).alias("evidence_types"),
            F.col("_g.missing_conditions").alias("missing_conditions"),
            confidence(F.col("_g.target_object").isNotNull(), F.col("_a").isNotNull(), given, F.size("_g.missing_conditions") > 0).alias("confidence"),
        ),
    ).drop("_g", "_a", "_n")


# --- lookup targets -------------------------------------------------------

FALSIFICATION = "弄虚作假"


def _others(section: str) -> tuple:
    return tuple(s for s in rules.SECTIONS if s != section)


def section_lookup(q: Column) -> Column:
    """Section named in the question; a later section rule overrides an earlier one."""
    section, skip = F.lit(None).cast("string"), strings(())
    terms = []
    for s in rules.SECTIONS:
        short = s.removesuffix("行为")
        hit = F.contains(q, F.lit(short))
        section = F.when(hit, F.lit(s)).otherwise(section)
        skip = F.when(hit, strings(_others(s))).otherwise(skip)
        terms.append(F.when(hit, strings((short, s))).otherwise(strings(())))
    false = F.contains(q, F.lit(FALSIFICATION))
    terms.append(F.when(false, strings((FALSIFICATION, "弄虚作假行为", "4. 弄虚作假行为"))).otherwise(strings(())))
    return F.struct(
        F.when(false, "二类违规行为").otherwise(section).alias("section"),
        F.when(false, "4. 弄虚作假行为").alias("clause"), F.when(false, "4").alias("clause_no"),
        F.when(false, strings(("一类违规行为", "三类违规行为"))).otherwise(skip).alias("exclude_sections"),
        F.when(false, strings(("3. 侵犯学校权益行为", "5. 破坏学校管理秩序行为"))).otherwise(strings(())).alias("exclude_clauses"),
        ordered_distinct(*terms).alias("terms"),
    )


def _mentions_section(q: Column, section: str) -> Column:
    return F.contains(q, F.lit(section.removesuffix("行为")))


def _mentions_number(q: Column, no: str) -> Column:
    return q.rlike(rf"(^|[^0-9]){no}\s*[\.、．]") | F.contains(q, F.lit(f"第{no}项"))


CLAUSE_TYPE = "struct<section:string,clause:string,clause_no:string,title:string,terms:array<string>,explicit:boolean,numbered:boolean>"


def clause_matches(q: Column, clauses=rules.CLAUSES) -> Column:
    """Clauses asked for by title, term or number, inside the named section when one is named."""
    no_section = ~contains_any(q, [s.removesuffix("行为") for s in dict.fromkeys(c[0] for c in clauses)])
    out = []
    for section, no, title, terms in clauses:
        by_title = contains_any(q, (title, *terms))
        numbered = _mentions_number(q, no) & F.contains(q, F.lit(title))
        named = _mentions_section(q, section)
        match = (numbered | by_title) & (named | numbered | no_section)
        out.append(
            F.when(
                match,
                F.struct(
                    F.lit(section).alias("section"), F.lit(f"{no}. {title}").alias("clause"), F.lit(no).alias("clause_no"), F.lit(title).alias("title"),
                    strings(terms).alias("terms"), named.alias("explicit"), _mentions_number(q, no).alias("numbered"),
                ).cast(CLAUSE_TYPE),
            )
        )
    return F.array_compact(F.array(*out))


def clause_lookup(q: Column) -> Column:
    """The one clause a question names, or the options when several fit."""
    def decide(ms: Column) -> Column:
        explicit = F.get(F.filter(ms, lambda m: m["explicit"]), F.lit(0))
        numbered = F.get(F.filter(ms, lambda m: m["numbered"]), F.lit(0))
        paths = F.array_distinct(F.transform(ms, lambda m: F.struct(m["section"].alias("section"), m["clause"].alias("clause"), m["title"].alias("title"))))
        picked = F.coalesce(explicit, numbered, F.when(F.size(paths) == 1, F.get(ms, F.lit(0))))
        unclear = picked.isNull() & (F.size(paths) > 1)
        return F.struct(picked.alias("selected"), unclear.alias("ambiguous"), F.when(unclear, paths).alias("options"))

    return let(clause_matches(q), decide)


def clause_in_section(section: Column, title: Column) -> Column:
    """The clause of a given title under a given section, null when there is none."""
    out = F.lit(None).cast(CLAUSE_TYPE)
    for s, no, t, terms in reversed(rules.CLAUSES):
        row = F.struct(F.lit(s).alias("section"), F.lit(f"{no}. {t}").alias("clause"), F.lit(no).alias("clause_no"), F.lit(t).alias("title"),
                       strings(terms).alias("terms"), F.lit(True).alias("explicit"), F.lit(False).alias("numbered")).cast(CLAUSE_TYPE)
        out = F.when((section == s) & (title == t), row).otherwise(out)
    return out


def _compare(value: Column, rule: dict) -> Column:
    return {"<": value < rule["threshold"], ">=": value >= rule["threshold"], "==": value == rule["threshold"]}[rule["operator"]]


def match_rules(facts: dict[str, Column], pack=rules.RULES) -> Column:
    """First rule in pack order whose fact passes its threshold, as a struct; null when none does."""
    out = F.lit(None).cast("struct<rule_id:string,key:string,condition:string,comparison:string,user_fact:string,actions:array<string>,search:array<string>,classes:array<string>>")
    for r in reversed(pack):
        value = facts[r["fact"]]
        row = F.struct(
            F.lit(r["rule_id"]).alias("rule_id"), F.lit(r.get("key", r["rule_id"])).alias("key"), F.lit(r.get("condition", "")).alias("condition"),
            F.concat(value.cast("string"), F.lit(f" {r['operator']} {r['threshold']}")).alias("comparison"),
            F.concat(F.lit("旷工 "), value.cast("string"), F.lit(" 次" if r["fact"] == "occurrence" else " 天")).alias("user_fact"),
            strings(r.get("actions", ())).alias("actions"), strings(r.get("search", ())).alias("search"), strings(r.get("classes", ())).alias("classes"),
        )
        out = F.when(F.coalesce(_compare(value, r), F.lit(False)), row).otherwise(out)
    return out


def absence_rule(q: Column) -> Column:
    """Threshold rule of an absence question: the count of occurrences is looked at before the duration."""
    by_count = [r for r in rules.RULES if r["fact"] == "occurrence"]
    by_days = [r for r in rules.RULES if r["fact"] == "duration"]
    named = F.when(F.contains(q, F.lit("旷工")), occurrence_count(q))
    found = F.coalesce(match_rules({"occurrence": named}, by_count), match_rules({"duration": day_count(q)}, by_days))
    return F.when(contains_any(q, rules.ABSENCE_TERMS), found)


def behavior(q: Column, pack=rules.BEHAVIORS) -> Column:
    """First behavior with a trigger in the question; lateness is labelled by the longest trigger found."""
    out = F.lit(None).cast(
        "struct<behavior:string,label:string,section:string,clause:string,subclause:string,classes:array<string>,search:array<string>,titles:array<string>,"
        "triggers:array<string>,exclude_sections:array<string>,exclude_clauses:array<string>,required:array<string>,missing:array<string>>"
    )
    for b in reversed(pack):
        label = F.lit(b["label"])
        if b["behavior"] == "lateness":
            # max_by length, the first of equally long triggers
            label = F.coalesce(*[F.when(F.contains(q, F.lit(t)), F.lit(t)) for t in sorted(b["triggers"], key=lambda t: (-len(t), b["triggers"].index(t)))])
        text = lambda v: F.lit(v).cast("string")
        row = F.struct(
            F.lit(b["behavior"]).alias("behavior"), label.alias("label"), text(b["section"]).alias("section"), text(b["clause"]).alias("clause"),
            text(b["subclause"]).alias("subclause"), strings(b["classes"]).alias("classes"), strings(b["search"]).alias("search"), strings(b["titles"]).alias("titles"),
            strings(b["triggers"]).alias("triggers"), strings(b["not_sections"]).alias("exclude_sections"), strings(b["not_clauses"]).alias("exclude_clauses"),
            strings([n for n, _ in b["conditions"]]).alias("required"),
            F.array_compact(F.array(*[F.when(~contains_any(q, t), F.lit(n)) for n, t in b["conditions"]])).alias("missing") if b["conditions"] else strings(()).alias("missing"),
        )
        out = F.when(contains_any(q, b["triggers"]), row).otherwise(out)
    return out


def subclause_mention(q: Column) -> Column:
    """A number n.m that is not part of a longer one, null when absent."""
    return F.nullif(F.regexp_extract(q, r"(?<![0-9])([0-9]{1,2}\.[0-9]+)(?![0-9])", 1), F.lit(""))


def hints(q: Column) -> Column:
    """Category, audience, intent and time hints, ambiguity flags and known terms of a question."""
    who = F.when(contains_any(q, rules.AUDIENCE_STUDENT), "student_or_stage_specific").when(contains_any(q, rules.AUDIENCE_EMPLOYEE), "employee").otherwise("unknown")
    relative = contains_any(q, rules.RELATIVE_TIME) & ~q.rlike("[0-9]")
    return F.struct(
        F.coalesce(first_rule(q, rules.CATEGORY_HINTS), F.lit("general")).alias("category"), who.alias("audience"),
        F.coalesce(first_rule(q, rules.INTENT_HINTS), F.lit("rule_lookup")).alias("intent"), hits(q, rules.TIME_HINTS).alias("times"),
        F.array_compact(F.array(F.when(who == "unknown", F.lit("missing_audience")), F.when(relative, F.lit("relative_time_without_year")))).alias("flags"),
        hits(q, rules.EXTRACTED_TERMS).alias("terms"),
    )


def is_bare_assertion(q: Column) -> Column:
    """A self-judgement such as 我没有违规, which is no question about a policy."""
    compact = F.regexp_replace(q, r"[\s。.!！?？]", "")
    return ~contains_any(q, rules.QUESTION_MARKERS) & compact.isin(*rules.BARE_ASSERTIONS)


def with_context(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", query: str = "query") -> DataFrame:
    """Adds the context each turn starts from: previous section, previous leave topic.

    A turn that sets a topic replaces the context, a follow-up that only makes
    sense with the context keeps it, any other turn clears it. So the context
    is what the last turn that was no such follow-up has set.
    """

    def prepare(df: DataFrame) -> DataFrame:
        q = F.col(query)
        d = df.withColumn("_look", section_lookup(q)).withColumn("_clause", _asked_clause(q)).withColumn("_beh", behavior(q)).withColumn("_who", audience(q, glossary(q)["target_object"]))
        allowed = F.col("_who").isin("employee", "unknown") & F.col("_clause.selected").isNull() & ~F.coalesce(F.col("_clause.ambiguous"), F.lit(False))
        own = F.coalesce(F.col("_clause.selected.section"), F.when(allowed, F.col("_beh.section")), F.col("_look.section"))
        leave = contains_any(q, rules.LEAVE_WORDS + ("休假管理办法",)) & (glossary(q)["target_object"] == "年休假") & contains_any(q, ("年假", "年休假"))
        asks_year = work_year(q, 20).isNotNull() & ~contains_any(q, rules.FOLLOW_UP_BLOCKERS)
        unclear = F.coalesce(F.col("_clause.ambiguous"), F.lit(False))
        d = d.withColumn("_own", own).withColumn("_leave", F.coalesce(leave, F.lit(False)))
        keeps_leave = asks_year & ~F.col("_leave")
        keeps_section = unclear & F.col("_own").isNull() & ~F.col("_leave")
        return (
            d.withColumn("_set_leave", F.when(~keeps_leave, F.col("_leave")))
            .withColumn("_set_section", F.when(~keeps_section, F.struct(F.when(~F.col("_leave"), F.col("_own")).alias("s"))))
            .withColumn("own_section", F.col("_own")).withColumn("own_leave", F.col("_leave"))
            .withColumn("asks_year", asks_year).withColumn("is_unclear", unclear)
            .withColumn("option_title", F.get("_clause.options", F.lit(0))["title"])
        )

    d = carry_forward(df, conversation, turn, {"_prev_leave": "_set_leave", "_prev_section": "_set_section"}, prepare=prepare)
    return (
        d.withColumn("context_leave", F.coalesce("_prev_leave", F.lit(False)))
        .withColumn("context_section", F.col("_prev_section.s"))
        .drop("_look", "_clause", "_beh", "_who", "_own", "_leave", "_set_leave", "_set_section", "_prev_leave", "_prev_section")
    )


def _asked_clause(q: Column) -> Column:
    """Clause lookup, skipped for questions about handling or listings."""
    skip = F.coalesce(resolver_aspect(q).isin("disciplinary_action", "section_listing"), F.lit(False))
    return F.when(~skip, clause_lookup(q))


def resolve_ambiguity(df: DataFrame) -> DataFrame:
    """Adds the clause an ambiguous turn gets from its context, null when the context does not help."""
    picked = clause_in_section(F.col("context_section"), F.col("option_title"))
    return df.withColumn("context_clause", F.when(F.col("is_unclear"), picked))


def follow_up(df: DataFrame, query: str = "query") -> DataFrame:
    """Adds whether a turn inherits the leave topic, the asked year, and the context it leaves behind."""
    inherits = F.col("context_leave") & F.col("asks_year")
    section = F.coalesce("own_section", F.when(F.col("is_unclear"), F.col("context_clause.section")))
    leave = F.col("own_leave") | inherits
    return (
        df.withColumn("is_follow_up", inherits)
        .withColumn("requested_year", F.when(leave, work_year(F.col(query), 20)))
        .withColumn("next_topic", F.when(leave, "leave").when(section.isNotNull(), "section"))
        .withColumn("next_section", F.when(~leave, section))
    )


def lookup_spec(df: DataFrame, query: str = "query", context_clause: str | None = None) -> DataFrame:
    """Adds the `spec` struct: what to look for, what to leave out, which rule or behavior applies."""
    q = F.col(query)
    aspect = resolver_aspect(q)
    d = (
        df.withColumn("_asp", aspect).withColumn("_s", section_lookup(q)).withColumn("_c", _asked_clause(q)).withColumn("_b", behavior(q))
        .withColumn("_r", absence_rule(q)).withColumn("_g", glossary(q)).withColumn("_sub", subclause_mention(q))
    )
    is_action = F.coalesce(F.col("_asp") == "disciplinary_action", F.lit(False))
    given = F.col(context_clause) if context_clause else F.lit(None).cast(CLAUSE_TYPE)
    clause = F.coalesce("_c.selected", F.when(F.col("_c.ambiguous"), given))
    d = d.withColumn("_cl", clause)
    unclear = F.coalesce(F.col("_c.ambiguous"), F.lit(False)) & F.col("_cl").isNull()
    detail = F.col("_cl").isNotNull() | unclear
    who = audience(q, F.col("_g.target_object"))
    allowed = who.isin("employee", "unknown")
    use = allowed & ~detail
    ruled = use & F.col("_r").isNotNull()
    pat = use & F.col("_r").isNull() & F.col("_b").isNotNull()
    false = next(b for b in rules.BEHAVIORS if b["behavior"] == "false_reimbursement")
    also_false = use & contains_any(q, false["triggers"]) & (ruled | (F.col("_b.behavior") != "false_reimbursement"))
    false_terms = F.when(also_false, strings((*false["triggers"], *false["search"], *false["classes"], *false["titles"])))
    clause_terms = F.when(
        F.col("_cl").isNotNull(), F.concat(F.array("_cl.section", "_cl.clause", "_cl.title"), F.col("_cl.terms"))
    ).when(unclear, F.transform("_c.options", lambda o: o["title"]))
    rule_terms = F.when(ruled, F.concat(strings(rules.ABSENCE_TERMS + rules.ABSENCE_TITLES), F.col("_r.search"), F.col("_r.classes")))
    pat_terms = F.when(pat, F.concat(F.col("_b.triggers"), F.col("_b.search"), F.col("_b.classes"), F.col("_b.titles")))
    action_terms = F.when(is_action & allowed, strings(rules.ACTION_RETRIEVAL))
    sub_terms = F.when(F.col("_sub").isNotNull(), F.array("_sub"))
    terms = ordered_distinct(F.col("_s.terms"), clause_terms, false_terms, rule_terms, pat_terms, action_terms, sub_terms)
    exact = (F.size(F.col("_s.terms")) > 0) | F.col("_cl").isNotNull() | ruled | pat | (is_action & allowed) | F.col("_sub").isNotNull()
    intent = F.when(unclear & F.col("_sub").isNull(), "ambiguous_policy_lookup").when(exact, "exact_policy_lookup").otherwise("semantic_policy_lookup")
    asked = (
        F.when(detail, "clause_detail").when(ruled, F.coalesce("_asp", F.lit("disciplinary_action")))
        .when(pat, F.when(F.col("_asp").isin("disciplinary_action", "section_listing"), F.col("_asp"))).when(is_action, F.col("_asp"))
    )
    answer = F.when(detail, "clause_detail").when(ruled, F.coalesce("_asp", F.lit("disciplinary_action"))).otherwise(F.col("_asp"))
    b = lambda f: F.when(pat, F.col(f"_b.{f}"))
    section = F.when(F.col("_cl").isNotNull(), F.col("_cl.section")).when(pat, F.col("_b.section")).otherwise(F.col("_s.section"))
    target_clause = F.when(F.col("_cl").isNotNull(), F.col("_cl.clause")).when(pat, F.col("_b.clause")).otherwise(F.col("_s.clause"))
    clause_no = F.coalesce(
        F.substring_index("_sub", ".", 1),
        F.when(F.col("_cl").isNotNull(), F.col("_cl.clause_no")).when(pat, F.substring_index("_b.clause", ".", 1)).otherwise(F.col("_s.clause_no")),
    )
    clause_skip = F.filter(strings(rules.SECTIONS), lambda s: s != F.col("_cl.section"))
    skip = F.when(F.col("_cl").isNotNull(), clause_skip).otherwise(ordered_distinct(F.col("_s.exclude_sections"), b("exclude_sections"), F.when(also_false, strings(false["not_sections"]))))
    skip_clauses = ordered_distinct(F.col("_s.exclude_clauses"), b("exclude_clauses"), F.when(also_false, strings(false["not_clauses"])))
    titles = F.when(F.col("_cl").isNotNull(), strings(rules.CONDUCT_TITLES)).when(ruled, strings(rules.ABSENCE_TITLES)).when(pat, F.col("_b.titles")).otherwise(strings(()))
    none = strings(())
    spec = F.struct(
        intent.alias("retrieval_intent"), terms.alias("target_terms"), section.alias("target_section"), target_clause.alias("target_clause"),
        clause_no.alias("target_clause_no"), F.coalesce("_sub", b("subclause")).alias("target_subclause"),
        F.when(ruled, "absenteeism").otherwise(b("behavior")).alias("target_behavior"), F.when(ruled, "旷工").otherwise(b("label")).alias("target_behavior_label"),
        F.when(ruled, F.col("_r.key")).alias("behavior_threshold"), F.when(ruled, F.col("_r.rule_id")).alias("rule_id"), F.when(ruled, F.col("_r.condition")).alias("matched_rule"),
        F.when(ruled, F.col("_r.comparison")).alias("comparison"), F.when(ruled, F.col("_r.user_fact")).alias("user_fact"),
        F.coalesce(F.when(ruled, F.col("_r.actions")), none).alias("expected_evidence"),
        F.array_distinct(F.coalesce(F.when(ruled, F.col("_r.search")), b("search"), none)).alias("rule_search_terms"),
        F.coalesce(F.when(ruled, F.col("_r.classes")), none).alias("classification_terms"), titles.alias("preferred_titles"),
        asked.alias("asked_aspect"), answer.alias("answer_aspect"), skip.alias("exclude_sections"), skip_clauses.alias("exclude_clauses"),
        F.coalesce(b("required"), none).alias("required_conditions"), F.coalesce(b("missing"), none).alias("missing_conditions"),
        F.when(unclear, F.col("_c.options")).alias("ambiguity_options"), F.when(F.col("_cl").isNotNull(), F.col("_cl.title")).alias("clause_title"),
    )
    return d.withColumn("spec", spec).drop("_asp", "_s", "_c", "_b", "_r", "_g", "_sub", "_cl")


def resolved(df: DataFrame, query: str = "query") -> DataFrame:
    """Adds `resolved`: what a turn asks after its lookup, the topic it inherits and self-judgements are weighed.

    Needs `spec`, `intent` and `is_follow_up` (lookup_spec, understand, follow_up). The lookup names the intent, an
    inherited leave topic sets aspect, audience and schema, and a self-judgement takes all targets away.
    """
    q = F.col(query)
    df = df.withColumn("_h", hints(q)).withColumn("_bare", is_bare_assertion(q)).withColumn("_leave", F.coalesce("is_follow_up", F.lit(False)))
    bare, leave, none = F.col("_bare"), F.col("_leave"), strings(())
    pick = lambda judged, inherited, own: F.when(bare, judged).when(leave, inherited).otherwise(own)
    null = F.lit(None).cast("string")
    exact = F.lit("policy_definition_lookup")
    for aspect, name in rules.ASPECT_INTENTS:
        exact = F.when(F.col("spec.answer_aspect") == aspect, name).otherwise(exact)
    looked = F.when(F.col("spec.retrieval_intent") == "ambiguous_policy_lookup", "policy_ambiguity_resolution").when(F.col("spec.retrieval_intent") == "exact_policy_lookup", exact)
    who = F.when(leave, "employee").otherwise(F.col("_h.audience"))
    known = F.col("_h.audience") != "unknown"
    flags = F.filter(F.col("_h.flags"), lambda f: (f != "missing_audience") | ~(leave | known))
    aspect = pick(null, F.lit("annual_leave_days"), F.col("spec.answer_aspect"))
    schema = F.struct(
        pick(null, F.lit(rules.ANNUAL_LEAVE), F.col("intent.target_object")).alias("target_object"),
        pick(F.lit("unsupported_assertion"), F.lit("benefit_rule"), F.col("intent.target_object_type")).alias("target_object_type"),
        pick(null, F.lit("annual_leave_days"), F.col("intent.asked_aspect")).alias("asked_aspect"),
        pick(F.lit(None).cast("int"), work_year(q, 20), F.col("intent.work_year")).alias("work_year"),
        pick(F.col("_h.audience"), F.lit("employee"), F.col("intent.audience")).alias("audience"),
        pick(none, strings(rules.INHERITED_EXPANSIONS), F.col("intent.expansions")).alias("expansions"),
        pick(none, strings(("table_evidence",)), F.col("intent.evidence_types")).alias("evidence_types"),
        pick(strings(rules.ASSERTION_CONDITIONS), none, F.col("intent.missing_conditions")).alias("missing_conditions"),
        F.when(bare | leave, 0.9).otherwise(F.col("intent.confidence")).alias("confidence"),
        pick(F.lit(rules.ASSERTION_NOTE), F.lit(rules.INHERITED_NOTE), null).alias("note"),
    )
    out = F.struct(
        F.when(bare, "unsupported_policy_assertion").otherwise(F.coalesce(looked, F.col("_h.intent"))).alias("intent"),
        F.when(leave, "leave").otherwise(F.col("_h.category")).alias("category"), who.alias("audience"), F.col("_h.times").alias("times"),
        F.when(bare, F.concat(flags, strings(("needs_specific_behavior",)))).otherwise(flags).alias("flags"),
        F.when(leave, F.concat(F.col("_h.terms"), strings((rules.ANNUAL_LEAVE,)))).otherwise(F.col("_h.terms")).alias("terms"),
        F.when(bare, "unsupported_policy_assertion").otherwise(F.col("spec.retrieval_intent")).alias("retrieval_intent"),
        aspect.alias("answer_aspect"), pick(null, F.lit("annual_leave_days"), F.col("spec.asked_aspect")).alias("asked_aspect"),
        F.when(bare, none).otherwise(F.col("spec.target_terms")).alias("target_terms"),
        F.when(bare, none).otherwise(F.col("spec.expected_evidence")).alias("expected_evidence"),
        F.when(leave, rules.INHERITED_REASON).alias("inherited_because"), schema.alias("schema"),
    )
    return df.withColumn("resolved", out).drop("_h", "_bare", "_leave")


def next_context(df: DataFrame) -> DataFrame:
    """Adds `next_context`, what a resolved turn leaves to the next one; null when it leaves nothing."""
    r = F.col("resolved")
    leave = (r["category"] == "leave") & F.coalesce(r["schema"]["target_object"] == rules.ANNUAL_LEAVE, F.lit(False))
    null = F.lit(None).cast("string")
    row = lambda category, target, section, clause, aspect: F.struct(
        category.alias("category"), target.alias("target_object"), section.alias("target_section"), clause.alias("target_clause"), aspect.alias("answer_aspect"),
        r["retrieval_intent"].alias("retrieval_intent"),
    )
    topic = row(F.lit("leave"), F.lit(rules.ANNUAL_LEAVE), null, null, F.lit("annual_leave_days"))
    place = row(null, null, F.col("spec.target_section"), F.col("spec.target_clause"), F.coalesce(r["answer_aspect"], r["asked_aspect"]))
    return df.withColumn("next_context", F.when(leave, topic).when(F.col("spec.target_section").isNotNull(), place))


def rewrite(q: Column, retrieval_intent: Column, category: Column, who: Column, spec_terms: Column) -> Column:
    """Stand-alone and expanded question: scope words in front where absent, then new expansions in order."""
    exact = retrieval_intent == "exact_policy_lookup"
    leave = category == "leave"
    s1 = F.when(~exact & (who == "employee") & ~F.contains(q, F.lit("员工")), F.concat(F.lit("员工 "), q)).otherwise(q)

    def step2(s: Column) -> Column:
        s2 = F.when(~exact & leave & ~contains_any(s, ("年假", "年休假")), F.concat(F.lit("年休假 "), s)).otherwise(s)
        return F.when(~exact & leave & ~F.contains(s, F.lit("规则")), F.concat(s2, F.lit(" 规则"))).otherwise(s2)

    def expand(s: Column) -> Column:
        general = F.concat(
            F.when(F.contains(s, F.lit("年假")) & ~F.contains(s, F.lit("年休假")), strings(("年休假",))).otherwise(strings(())),
            F.when(F.contains(s, F.lit("年休假")) & ~F.contains(s, F.lit("年假")), strings(("年假",))).otherwise(strings(())),
            F.when(leave, strings(rules.LEAVE_EXPANSIONS)).otherwise(strings(())),
        )
        added = F.filter(ordered_distinct(F.when(exact, spec_terms).otherwise(general)), lambda t: ~F.contains(s, t))
        return let(added, lambda a: F.struct(s.alias("standalone"), a.alias("added_terms"), F.trim(F.array_join(F.concat(F.array(s), a), " ")).alias("expanded")))

    return let(let(s1, step2), expand)


def retrieval_plan(k: Column, retrieval_intent: Column, answer_aspect: Column) -> Column:
    """Candidate limit and channels of a request."""
    exact = retrieval_intent == "exact_policy_lookup"
    base = F.when(exact, strings(("exact_match", "sparse_keyword", "dense_vector"))).otherwise(strings(("dense_vector",)))
    listing = F.coalesce(answer_aspect == "section_listing", F.lit(False))
    return F.struct(
        F.greatest(k, F.least(F.lit(24), k * 4)).alias("candidate_limit"), k.alias("final_top_k"),
        F.when(listing, F.concat(strings(("policy_structure",)), base)).otherwise(base).alias("channels"),
    )
