"""Answer assembly: one row per question from its final evidence.

Extraction works on one evidence row; the assembly is one aggregation per
question over at most a candidate list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import rules
from dossier.functions.text import contains_any, drop_blanks, let, squash, strings
from dossier.operators import evidence as ev

c = F.col
NOTHING_FOUND = "没有在当前制度样本中检索到足够相关的内容。"


def definition_text(text: Column, section: Column) -> Column:
    """Definition of a section: its 指-sentence, else from its marker to the first numbered child."""
    t = squash(text)
    said = F.regexp_substr(t, F.concat(section, F.lit(r"\s*[：:]\s*指.*?。")))
    start = ev.first_marker(t, ev.section_variants(section), F.lit(0))

    def upto(s: Column) -> Column:
        rest = F.substring(t, s["pos"] + 1, F.length(t))
        child = F.get(F.split(rest, r"\s\d{1,2}\.\s*[^\d\s]", 2), F.lit(0))
        return F.nullif(F.trim(child), F.lit(""))

    return F.coalesce(said, let(start, lambda s: F.when(s.isNotNull(), upto(s))))


def listing_ordinal(text: Column, title: Column) -> Column:
    """Number in front of a title in the text, null when there is none."""
    found = F.regexp_extract_all(squash(text), F.concat(F.lit(r"(?<!\d)(\d{1,2})\.\s*\Q"), title, F.lit(r"\E")), F.lit(1))
    return F.get(found, F.lit(0)).try_cast("int")


def listing_detail(text: Column, title: Column, limit: int = 140) -> Column:
    """What follows the title, cut at `limit` characters."""
    t = squash(text)
    at = F.instr(t, title) if isinstance(title, str) else F.call_function("instr", t, title)
    rest = F.when(at > 0, F.substring(t, at + F.length(title), F.length(t))).otherwise(t)
    rest = F.trim(F.regexp_replace(rest, r"^[：:，。；;\s]+", ""))
    rest = F.trim(F.regexp_replace(rest, r"（[一二三四五六七八九十]+）[^。]*?：指[^。]*。?", ""))
    short = F.concat(F.rtrim(F.substring(rest, 1, limit), F.lit("，。；; ")), F.lit("..."))
    return F.when(F.length(rest) > limit, short).otherwise(rest)


def listing_label(df: DataFrame, text: Column, title: Column) -> Column:
    """Number a listing item is shown with: the stored one, else that of its title, else of any numbered 行为 title; null without."""
    stored = [F.nullif(F.trim(c(n).cast("string")), F.lit("")) for n in ("ordinal_label", "clause_no") if n in df.columns]
    loose = F.get(F.regexp_extract_all(squash(text), F.lit(r"(?<!\d)(\d{1,2})\.\s*[^。；;：:]{2,60}?行为"), F.lit(1)), F.lit(0))
    label = F.coalesce(*stored, listing_ordinal(text, title).cast("string"), loose)
    return F.when(label.endswith("."), label).otherwise(F.concat(label, F.lit(".")))


def section_listing(df: DataFrame, rank: str = "rank") -> DataFrame:
    """Items of a listing question in source order.

    Structured children win; else the distinct titles of the listing evidence,
    each from its first chunk, by their number in the text (999 when unknown).
    `details` has the same items with the number stored for them (columns
    ordinal_label, clause_no, when df has them) and what follows the title.
    """
    d = df.filter(ev.listing_evidence()).withColumn("_kids", ev.structured_children()).withColumn("_title", ev.listing_title())
    ordinal = F.coalesce(listing_ordinal(c("text"), c("_title")), F.lit(999))
    item = F.struct(
        c("_title").alias("title"), c(rank).alias("rank"), ordinal.alias("ordinal"), listing_label(d, c("text"), c("_title")).alias("label"), listing_detail(c("text"), c("_title")).alias("detail"),
    )
    q = d.groupBy("query_id").agg(
        F.min_by(F.when(c("_kids"), F.struct("items", "continuity")), F.when(c("_kids"), c(rank))).alias("kids"),
        F.array_sort(F.collect_list(F.when(~c("_kids") & c("_title").isNotNull(), item))).alias("found"),
        F.first("spec.target_section").alias("section"),
    )
    # In title order the first of equal titles has the lowest rank.
    firsts = F.filter("found", lambda f, i: (i == 0) | (f["title"] != F.get("found", i - 1)["title"]))
    ordered = F.array_sort(F.transform(firsts, lambda f: F.struct(f["ordinal"].alias("ordinal"), f["rank"].alias("rank"), f["title"].alias("title"), f["label"].alias("label"), f["detail"].alias("detail"))))
    lines = F.transform(ordered, lambda f, i: F.concat(F.when(f["ordinal"] == 999, i + 1).otherwise(f["ordinal"]).cast("string"), F.lit(". "), f["title"]))
    full = F.transform(ordered, lambda f, i: F.concat(
        F.coalesce(f["label"], F.concat((i + 1).cast("string"), F.lit("."))), F.lit(" "), f["title"], F.when(f["detail"] != "", F.concat(F.lit("："), f["detail"])).otherwise("")))
    structured = c("kids").isNotNull()
    return q.select(
        "query_id", "section", F.when(structured, c("kids.items")).otherwise(lines).alias("items"), structured.alias("structured"),
        (structured & (F.coalesce("kids.continuity", F.lit("unknown")) != "complete")).alias("gap_warning"),
        F.when(structured, c("kids.items")).otherwise(full).alias("details"),
    )


def clause_items(text: Column, clause_no: Column) -> Column:
    """Distinct n.m sentences of one clause, in order."""
    return F.array_distinct(F.regexp_extract_all(squash(text), F.concat(F.lit(r"("), clause_no, F.lit(r"\.\d+\s*.*?。)")), F.lit(1)))


def tier_table(text: Column) -> Column:
    """Days per year of service as map<int,int>: from the six-column table, else from label and number pairs."""
    t = squash(text)
    head = r"\s*".join(rules.YEAR_LABELS) + r"\s*"
    row = r"\s*".join([r"(\d+)天"] * 6)
    whole = F.array(*[F.regexp_extract(t, head + row, i).try_cast("int") for i in range(1, 7)])
    pairs = F.array(*[F.regexp_extract(t, label + r"\s*(\d+)天", 1).try_cast("int") for label in rules.YEAR_LABELS])
    days = F.when(F.get(whole, F.lit(0)).isNotNull(), whole).otherwise(pairs)
    years = F.array(*[F.lit(i) for i in range(1, 7)])
    return F.map_filter(F.map_from_arrays(years, days), lambda y, n: n.isNotNull())


def tier_days(table: Column, year: Column) -> Column:
    """Days of the asked year, from the sixth on the last tier; null when no year is asked."""
    return F.when(year.isNotNull(), F.try_element_at(table, F.least(year, F.lit(6))))


def tier_text(table: Column) -> Column:
    cells = [F.when(F.try_element_at(table, F.lit(i)).isNotNull(), F.concat(F.lit(label + " "), F.try_element_at(table, F.lit(i)).cast("string"), F.lit("天"))) for i, label in enumerate(rules.YEAR_LABELS, 1)]
    return F.array_join(F.array_compact(F.array(*cells)), "、")


def _action_name(item: Column) -> Column:
    bare = F.btrim(item, F.lit("，。；; "))
    return F.when(bare.endswith("处分") & ~bare.startswith("给予") & ~bare.startswith("予以"), F.concat(F.lit("给予"), bare)).otherwise(bare)


def action_items(expected: Column, text: Column) -> Column:
    """Actions of the matched rule, else the parts of the text behind its first comma."""
    t = F.btrim(text, F.lit("；;。 "))
    tail = F.when(F.contains(t, F.lit("，")), F.regexp_replace(t, "^[^，]*，", "")).otherwise(t)
    parts = F.filter(F.split(tail, "，并|并|；|;"), lambda p: F.btrim(p, F.lit("，。；; ")) != "")
    return F.transform(F.when(F.size(expected) > 0, expected).otherwise(parts), _action_name)


def violation_actions(text: Column) -> Column:
    """Parts of a handling clause without its numbered title."""
    t = F.regexp_replace(drop_blanks(text), r"^\d+\.\d+[一二三]类违规行为[:：]", "")
    head = F.substring_index(t, "：", 1)
    t = F.when(F.contains(t, F.lit("：")) & F.contains(head, F.lit("违规行为")), F.substring(t, F.length(head) + 2, F.length(t))).otherwise(t)
    return F.filter(F.split(t, "[，。；;]"), lambda p: p != "")


def absence_label(text: Column, classes: Column) -> Column:
    """Class of an absence: from the rule's terms, else the nearest level named ahead of the clause."""
    clause = F.get(F.filter(classes, lambda t: t.rlike(r"^\d+\.\d+")), F.lit(0))
    clause = F.coalesce(clause, F.nullif(F.replace(F.regexp_extract(text, r"(\d+\.\s*\d+\s*旷工少于三天)", 1), F.lit(". "), F.lit(".")), F.lit("")))
    by_rule = F.get(F.filter(strings(rules.SECTIONS), lambda s: F.array_contains(classes, s)), F.lit(0))
    at = F.call_function("instr", text, clause)
    before = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    nearest = F.nullif(F.regexp_extract(before, "(?s)^.*([一二三]类违规行为)", 1), F.lit(""))
    anywhere = F.nullif(F.regexp_extract(text, "([一二三]类违规行为)", 1), F.lit(""))
    category = F.coalesce(by_rule, nearest, anywhere)
    order = F.contains(text, F.lit("破坏学校管理秩序行为")) | F.array_contains(classes, "破坏学校管理秩序行为")
    return F.concat(F.lit("属于"), category, F.when(order, "中的破坏学校管理秩序行为").otherwise(""), F.when(clause.isNotNull(), F.concat(F.lit("（"), clause, F.lit("）"))).otherwise(""))


def behavior_label() -> Column:
    """Class of a behavior question from its spec."""
    terms = F.array_union(F.col("spec.target_terms"), F.array_compact(F.array("spec.target_section")))
    category = F.get(F.filter(strings(rules.SECTIONS), lambda s: F.array_contains(terms, s)), F.lit(0))
    name = F.trim(F.regexp_replace("spec.target_clause", r"^\d+(?:\.\d+)?\.?\s*", ""))
    sub = F.concat(F.lit("（"), "spec.target_subclause", F.coalesce("spec.target_behavior_label", F.lit("该行为")), F.lit("）"))
    return F.concat(F.lit("属于"), category, F.when(name.isNotNull(), F.concat(F.lit("中的"), name, F.coalesce(sub, F.lit("")))).otherwise(""))


def condition_sentence(text: Column, label: Column) -> Column:
    """First sentence that names the behavior together with a condition, from its number on."""
    parts = F.split(drop_blanks(text), "[。；;]")
    first = F.get(F.filter(parts, lambda p: F.contains(p, label) & contains_any(p, rules.CONDITION_SIGNALS)), F.lit(0))
    numbered = F.nullif(F.regexp_extract(first, r"(\d+\.\d+.*)", 1), F.lit(""))
    return F.btrim(F.coalesce(numbered, first), F.lit("，。；; "))


def ambiguity_options(df: DataFrame) -> DataFrame:
    """Numbered options of questions that fit several clauses."""
    d = df.filter("spec.retrieval_intent = 'ambiguous_policy_lookup'")
    options = F.transform("spec.ambiguity_options", lambda o, i: F.concat((i + 1).cast("string"), F.lit(". "), o["section"], F.lit(" > "), o["title"]))
    return d.select("query_id", F.get("spec.ambiguity_options", F.lit(0))["title"].alias("title"), options.alias("options"))


def answer_rows(questions: DataFrame, final: DataFrame, rank: str = "rank") -> DataFrame:
    """The answer of every question: which branch it takes, its text, and the chunks it stands on.

    Branch order: ambiguity, nothing found, definition, listing, clause,
    absence, behavior, tier table, best chunk.
    """
    t, s = c("text"), c("spec.target_section")
    wants_definition = ev.exact() & s.isNotNull() & c("spec.target_clause").isNull() & ((c("spec.answer_aspect") == "definition") | F.coalesce(c("spec.asked_aspect") == "definition", F.lit(False)))
    best = lambda value, cond: F.min_by(F.when(cond, value), F.when(cond, c(rank)))
    d = final.withColumn("_def", F.when(wants_definition, definition_text(t, s))).withColumn("_tier", tier_table(t))
    is_pen, is_cls = c("role").isin("penalty", "both"), c("role").isin("classification", "both")
    tier = contains_any(t, ("带薪年假", "带薪年休假", "年休假天数")) & (F.size("_tier") > 0)
    cited = F.struct("chunk_id", t.alias("text"), F.array_join("heading", " > ").alias("title"))
    q = d.groupBy("query_id").agg(
        F.count("*").alias("n"), best(F.struct("_def", "chunk_id"), c("_def").isNotNull()).alias("definition"), best(cited, ev.detail_evidence()).alias("clause"),
        best(cited, is_pen).alias("penalty"), best(cited, is_cls).alias("classification"), best(F.struct("_tier", "chunk_id"), tier).alias("tier"), best(cited, F.lit(True)).alias("top"),
        F.transform(F.array_sort(F.collect_list(F.struct(rank, "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"),
    )
    listing = section_listing(final, rank).select("query_id", c("details").alias("list_items"), "section", "structured", "gap_warning")
    a = questions.join(q, "query_id", "left").join(listing, "query_id", "left").join(ambiguity_options(questions), "query_id", "left")
    behavior = c("spec.target_behavior")
    detail = (c("spec.answer_aspect") == "clause_detail") & c("top").isNotNull()
    leave = (c("hints.category") == "leave") | contains_any(c("query"), ("年假", "年休假"))
    branch = (
        F.when(c("options").isNotNull(), "ambiguity").when(c("n").isNull(), "nothing").when(c("definition").isNotNull(), "definition").when(F.size("list_items") > 0, "listing")
        .when(detail, "clause").when((behavior == "absenteeism") & c("penalty").isNotNull(), "absence")
        .when((behavior != "absenteeism") & c("classification").isNotNull(), "behavior").when(leave & c("tier").isNotNull(), "tier").otherwise("best_chunk")
    )
    a = a.withColumn("branch", branch).withColumn("clause", F.coalesce("clause", "top"))
    lines = lambda items: F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    items = clause_items(c("clause.text"), c("spec.target_clause_no"))
    year = c("intent.work_year")
    text = (
        F.when(c("branch") == "ambiguity", F.concat(F.lit("这个条款名在多个违规等级下都存在："), "title", F.lit("。\n可选范围：\n"), F.array_join("options", "\n")))
        .when(c("branch") == "nothing", NOTHING_FOUND).when(c("branch") == "definition", c("definition._def"))
        .when(c("branch") == "listing", F.concat(F.regexp_replace(F.coalesce("section", F.lit("目标章节")), "行为$", ""), F.lit("主要包括：\n"), F.array_join("list_items", "\n"),
                                                 F.when(c("gap_warning"), "\n结构质量提醒：该章节编号不连续。").otherwise("")))
        .when(c("branch") == "clause", F.when(F.size(items) > 0, F.concat(F.lit("包含以下情形：\n"), F.array_join(items, "\n"))).otherwise(F.concat(F.lit("条款内容："), squash("clause.text"))))
        .when(c("branch") == "absence", F.concat_ws("\n", F.concat(F.lit("事实："), F.coalesce("spec.user_fact", F.lit("旷工")), F.lit("。")), F.concat(F.lit("规则匹配："), "spec.comparison", F.lit("，命中“"), "spec.matched_rule", F.lit("”。")),
              F.concat(F.lit("违规类型："), absence_label(c("classification.text"), c("spec.classification_terms")), F.lit("。")), F.concat(F.lit("处理结果：\n"), lines(action_items(c("spec.expected_evidence"), c("penalty.text"))))))
        .when(c("branch") == "behavior", F.concat_ws("\n", F.concat(F.lit("事实："), "spec.target_behavior_label", F.lit("。")), F.concat(F.when(F.size("spec.missing_conditions") > 0, "如果满足条款条件，").otherwise(""), behavior_label(), F.lit("。")),
              F.when(F.size("spec.missing_conditions") > 0, F.concat(F.lit("需要确认："), F.array_join("spec.missing_conditions", "、"), F.lit("。"))).otherwise(
                  F.concat(F.lit("条款条件："), condition_sentence(c("classification.text"), c("spec.target_behavior_label")), F.lit("。"))),
              F.when(c("penalty").isNotNull(), F.concat(F.lit("处理结果：\n"), lines(violation_actions(c("penalty.text")))))))
        .when(c("branch") == "tier", F.coalesce(F.concat(F.lit("结论：带薪年假为 "), tier_days(c("tier._tier"), year).cast("string"), F.lit("天。年假表："), tier_text(c("tier._tier"))), F.concat(F.lit("结论："), tier_text(c("tier._tier")))))
        .otherwise(F.concat(F.lit("优先依据《"), "top.title", F.lit("》："), "top.text"))
    )
    ids = (
        F.when(c("branch").isin("ambiguity", "nothing"), F.array().cast("array<bigint>")).when(c("branch") == "definition", F.array("definition.chunk_id"))
        .when(c("branch") == "clause", F.array("clause.chunk_id")).when(c("branch") == "tier", F.array("tier.chunk_id")).otherwise(c("chunk_ids"))
    )
    return a.select("query_id", "query", "branch", text.alias("answer"), ids.alias("source_chunk_ids"))
