"""Regression checks, feedback records and trace tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import rules
from dossier.functions.text import let

c = F.col


def observed(df: DataFrame) -> DataFrame:
    """What a response shows: document ids, urls, answer type and evidence types, distinct and in order.

    The step's answer type counts only where there is no plan; a plan without a type gives null.

    Expects `results` (array of struct doc_id, chunk.doc_id, citation.url, url), `answer_plan.answer_type`,
    `steps` (array of struct key, answer_type, evidence_types) and `evidence_types`.
    """
    distinct = lambda a: F.array_distinct(F.filter(a, lambda x: x.isNotNull() & (x != "")))
    given = lambda x: F.nullif(x, F.lit(""))
    docs = F.transform("results", lambda r: F.coalesce(given(r["doc_id"]), r["chunk"]["doc_id"]))
    urls = F.transform("results", lambda r: F.coalesce(given(r["citation"]["url"]), r["url"]))
    step = lambda key, field: F.get(F.transform(F.filter("steps", lambda s: s["key"] == key), lambda s: s[field]), F.lit(0))
    none = F.array().cast("array<string>")
    types = F.concat(F.coalesce("evidence_types", none), F.coalesce(step("answer_and_observe", "evidence_types"), none), F.coalesce(step("evidence_quality", "evidence_types"), none))
    return (
        df.withColumn("observed_doc_ids", distinct(docs)).withColumn("observed_urls", distinct(urls))
        .withColumn("observed_answer_type", F.when(c("answer_plan").isNull(), given(step("answer_and_observe", "answer_type"))).otherwise(given(c("answer_plan.answer_type"))))
        .withColumn("observed_evidence_types", distinct(types))
    )


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _is_object(v: Column) -> Column:
    return _kind(v).startswith("OBJECT")


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _items(v: Column, path: str) -> Column:
    """Objects of a list; anything else in it, or in its place, is left out."""
    return F.filter(F.coalesce(_at(v, path, "array<variant>"), F.array().cast("array<variant>")), _is_object)


def _given(v: Column) -> Column:
    """A value as text; null where it is missing, empty, zero or false."""
    kind, text = _kind(v), F.try_variant_get(v, "$", "string")
    number = F.try_variant_get(v, "$", "double")
    return (
        F.when(kind.startswith("STRING"), F.nullif(text, F.lit(""))).when(kind == "BOOLEAN", F.when(text == "true", "True"))
        .when(kind.isin("VOID", "OBJECT<>", "ARRAY<>"), None).when(number.isNotNull(), F.when(number != 0, text)).otherwise(text)
    )


def _first_object(a: Column, b: Column) -> Column:
    return F.when(_is_object(a), a).otherwise(b)


def observed_json(df: DataFrame, response: str = "response") -> DataFrame:
    """The columns of `observed` and `answer`, from the response as raw JSON text.

    Results without a document id fall back to their chunk's, without a citation address to their own. The answer type
    comes from the plan, or from the plan in the details of the step `answer_and_observe` where the response has none;
    evidence types come from the response, that step, and the classifications of the step `evidence_quality`. Text that
    is no JSON object shows nothing; fields of another type than expected are taken as missing.
    """
    v = F.try_parse_json(F.coalesce(F.col(response), F.lit("{}")))
    d = df.withColumn("_v", F.when(_is_object(v), v).otherwise(F.parse_json(F.lit("{}"))))
    root = c("_v")

    def details(key: str) -> Column:
        mine = F.filter(_items(root, "steps"), lambda s: (_at(s, "key", "string") == key) & _is_object(_at(s, "details")))
        return _at(F.get(mine, F.lit(0)), "details")

    d = d.withColumns({"_said": details("answer_and_observe"), "_seen": details("evidence_quality")})
    results = _items(root, "results")
    docs = F.transform(results, lambda r: F.coalesce(_given(_at(r, "doc_id")), _given(_at(r, "chunk.doc_id"))))
    urls = F.transform(results, lambda r: F.coalesce(_given(_at(r, "citation.url")), _given(_at(r, "url"))))
    judged = F.transform(_items(_at(c("_seen"), "target_evidence_filter"), "evidence_classifications"), lambda i: _first_object(_at(i, "general_evidence_assessment"), i))
    assessed = F.concat(_items(root, "answer_evidence_assessments"), _items(c("_said"), "answer_evidence_assessments"), judged)
    types = F.transform(assessed, lambda a: _given(_at(a, "evidence_type")))
    plan = _first_object(_at(root, "answer_plan"), _at(c("_said"), "answer_plan"))
    distinct = lambda a: F.array_distinct(F.array_compact(a))
    return d.withColumns(
        {"observed_doc_ids": distinct(docs), "observed_urls": distinct(urls), "observed_answer_type": F.when(_is_object(plan), _given(_at(plan, "answer_type"))), "observed_evidence_types": distinct(types),
         "answer": F.coalesce(_given(_at(root, "answer")), F.lit(""))}
    ).drop("_v", "_said", "_seen")


def check_cases(df: DataFrame) -> DataFrame:
    """Missing and forbidden items of every case, one verdict per check, and whether all six hold.

    Expects expected_* / forbidden_keywords arrays, expected_answer_type, answer and the observed_* columns. Items come
    in the order of the case, repeated ones as often as it names them.
    """
    answer = F.coalesce("answer", F.lit(""))
    unseen = lambda kind: F.filter(f"expected_{kind}", lambda x: ~F.array_contains(f"observed_{kind}", x))
    d = df.withColumns(
        {
            "missing_doc_ids": unseen("doc_ids"), "missing_keywords": F.filter("expected_keywords", lambda k: ~F.contains(answer, k)),
            "forbidden_hits": F.filter("forbidden_keywords", lambda k: F.contains(answer, k)), "missing_urls": unseen("urls"), "missing_evidence_types": unseen("evidence_types"),
            "answer_type_pass": c("expected_answer_type").isNull() | F.coalesce(c("observed_answer_type") == c("expected_answer_type"), F.lit(False)),
        }
    )
    lists = {"doc_ids_pass": "missing_doc_ids", "keywords_pass": "missing_keywords", "forbidden_pass": "forbidden_hits", "urls_pass": "missing_urls", "evidence_types_pass": "missing_evidence_types"}
    d = d.withColumns({name: F.size(x) == 0 for name, x in lists.items()})
    passed = c("answer_type_pass")
    for name in lists:
        passed = passed & c(name)
    return d.withColumn("passed", passed)


def summary(results: DataFrame, category: str | None = None) -> DataFrame:
    """Totals and pass rate, one row overall and, with a category, one per category in the same pass."""
    aggs = [F.count("*").alias("total"), F.count_if(c("passed")).alias("passed"), F.count_if(~c("passed")).alias("failed")]
    out = results.agg(*aggs) if category is None else results.rollup(category).agg(*aggs, (F.grouping(category) == 1).alias("is_total"))
    return out.withColumn("pass_rate", F.when(c("total") > 0, F.round(c("passed") / c("total"), 4)).otherwise(0.0))


def by_tag(cases: DataFrame, tag: str) -> DataFrame:
    return cases.filter(F.array_contains("tags", tag))


def feedback_records(df: DataFrame) -> DataFrame:
    """Feedback with its reject reason (null when valid); citations keep six fields, body text is never kept."""
    text = F.trim(F.coalesce("query", F.lit("")))
    kind = F.trim(F.coalesce("feedback_type", F.lit("")))
    reason = F.when(text == "", "query is required").when(~kind.isin(*rules.FEEDBACK_TYPES), F.concat(F.lit("unsupported feedback_type: "), kind))
    cite = lambda r: F.struct(
        r["chunk_id"].alias("chunk_id"), r["doc_id"].alias("doc_id"), r["citation"]["title"].alias("title"), r["citation"]["url"].alias("url"),
        r["citation"]["category"].alias("category"), r["citation"]["publish_date"].alias("publish_date"),
    )
    keep = [x for x in df.columns if x not in ("query", "feedback_type", "answer", "trace_id", "comment", "results")]
    return df.select(
        *keep, text.alias("query"), kind.alias("feedback_type"), F.coalesce("answer", F.lit("")).alias("answer"), F.nullif("trace_id", F.lit("")).alias("trace_id"),
        F.nullif("comment", F.lit("")).alias("comment"), F.transform("results", cite).alias("citations"), F.lit(False).alias("raw_trace_stored"), reason.alias("reject_reason"),
    )


def trace_id(query: Column, top_k: Column) -> Column:
    """trace_ and the first 16 hex digits of sha256 over the question, a zero byte and k."""
    return F.concat(F.lit("trace_"), F.substring(F.sha2(F.concat(query, F.char(F.lit(0)), top_k.cast("string")), 256), 1, 16))


def seeded_id(seed: Column) -> Column:
    """A 32-digit hex seed as it is, any other seed hashed to 32 hex digits."""
    s = F.lower(F.trim(seed))
    return F.when(s.rlike(r"^[0-9a-f]{32}$"), s).when(s == "", F.replace(F.uuid(), F.lit("-"), F.lit(""))).otherwise(F.substring(F.sha2(s, 256), 1, 32))


# Detail keys a sanitized step may keep, and text limits.
SAFE_DETAILS = ("tool", "intent", "retrieval_intent", "policy_category_hint", "candidate_limit", "enabled_channels", "semantic_drift_check", "post_answer_faithfulness_check",
                "scope_guard", "reranker_provider", "result_count", "status")
TEXT_LIMIT, SUMMARY_LIMIT = 600, 240


def short_text(text: Column, limit: int = TEXT_LIMIT) -> Column:
    """Trimmed and cut at the limit with three dots; null when blank."""
    return let(F.trim(text), lambda t: F.when(t == "", None).when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit), F.lit("..."))))


def sanitize_steps(df: DataFrame) -> DataFrame:
    """Steps without free text: short summary, child count and the allowed details. Expects details as map."""
    safe = F.map_filter("details", lambda k, v: k.isin(*SAFE_DETAILS))
    return df.withColumn("summary", short_text(c("summary"), SUMMARY_LIMIT)).withColumn("child_count", F.size("children")).withColumn("details", safe).drop("children")


def sanitize_results(df: DataFrame, results: str = "results") -> DataFrame:
    """Results without body text: ids, distance, path and five fields of the citation; anything else goes."""
    names = ("chunk_id", "doc_id", "block_id", "distance", "heading_path")
    cite = ("title", "source", "url", "category", "publish_date")
    safe = lambda r: F.struct(*[r[n].alias(n) for n in names], F.struct(*[r["citation"][n].alias(n) for n in cite]).alias("citation"))
    return df.withColumn(results, F.transform(results, safe))


def local_trace_id(df: DataFrame, name: str = "local_trace_id") -> DataFrame:
    """The trace's own id: trace_id or request_id of the payload, else of the first step that has one in its details, else the question."""
    given = lambda x: F.nullif(x, F.lit(""))
    of_step = F.transform("steps", lambda s: F.coalesce(given(F.try_element_at(s["details"], F.lit("trace_id"))), given(F.try_element_at(s["details"], F.lit("request_id")))))
    return df.withColumn(name, F.coalesce(given(c("trace_id")), given(c("request_id")), F.get(F.array_compact(of_step), F.lit(0)), given(c("query"))))


def step_rows(df: DataFrame, trace: str = "trace_id") -> DataFrame:
    """Two-level step trees to rows: path, key, status, duration, child count."""
    d = df.select(trace, F.posexplode("steps").alias("i", "s"))
    top = F.struct(
        (c("i") + 1).cast("string").alias("path"), c("s.key").alias("key"), c("s.status").alias("status"), c("s.duration_ms").alias("duration_ms"), F.size("s.children").alias("child_count")
    )
    kids = F.transform("s.children", lambda k, j: F.struct(
        F.concat((c("i") + 1).cast("string"), F.lit("."), (j + 1).cast("string")).alias("path"), k["key"].alias("key"), k["status"].alias("status"), k["duration_ms"].alias("duration_ms"), F.lit(0).alias("child_count")))
    return d.select(trace, F.inline(F.concat(F.array(top), kids)))


def trace_rollup(steps: DataFrame, trace: str = "trace_id") -> DataFrame:
    """Per trace: steps, total duration of the top level, warn when any step warns."""
    top = ~F.contains("path", F.lit("."))
    return steps.groupBy(trace).agg(
        F.count("*").alias("step_count"), F.sum(F.when(top, c("duration_ms"))).alias("duration_ms"), F.when(F.bool_or(c("status") == "warn"), "warn").otherwise("ok").alias("status")
    )


# Detail keys that count as a step's input and as its output.
FLOW_INPUT = ("input", "input_text", "payload", "query_type", "query_length", "top_k", "max_top_k", "pair_count", "input_candidate_count", "metadata_filters")
FLOW_OUTPUT = (
    "trace_id", "request_id", "status", "normalized_query", "intent", "policy_category_hint", "audience_hint", "time_hints", "ambiguity_flags", "extracted_terms", "retrieval_intent",
    "target_terms", "target_section", "target_clause", "target_clause_no", "target_subclause", "target_behavior", "target_behavior_label", "behavior_duration", "behavior_threshold",
    "condition_parameters", "answer_aspect", "query_schema", "intent_schema", "context_resolution", "rule_resolution", "rule_search_terms", "expected_evidence", "preferred_policy_titles",
    "asked_aspect", "aspect_terms", "exclude_sections", "exclude_clauses", "standalone_query", "expanded_query", "expanded_query_for_future_hybrid", "added_terms", "semantic_drift_check",
    "tokenizer", "token_count", "tokens_preview", "token_ids_preview", "max_input_tokens", "truncated_by_model", "truncated_for_trace", "dimension", "vector_preview", "enabled_channels",
    "candidate_limit", "final_top_k", "result_count", "results_preview", "output_candidate_count", "rerank_comparison", "quality_checks", "context_blocks", "scope_guard", "citation_merge",
    "target_evidence_filter", "answer", "post_answer_faithfulness_check", "langfuse_observations",
)


def data_flow(key: Column, details: Column) -> Column:
    """Input and output side of a step's details; a side without known keys lists the first twelve keys instead."""
    def side(names, extra: str, as_name: str) -> Column:
        kept = F.map_filter(details, lambda k, v: k.isin(*names))
        first = F.try_element_at(details, F.lit(extra))
        return F.when(first.isNotNull(), F.map_concat(F.create_map(F.lit(as_name), first), F.map_filter(kept, lambda k, v: k != as_name))).otherwise(kept)

    visible = F.slice(F.array_sort(F.filter(F.map_keys(details), lambda k: k != "data_flow")), 1, 12)
    fallback = F.create_map(F.lit("node_key"), key, F.lit("detail_keys"), F.array_join(visible, ","))
    inputs, outputs = side(FLOW_INPUT, "raw_query", "raw_message"), side(FLOW_OUTPUT, "output", "output")
    future = F.try_element_at(outputs, F.lit("expanded_query_for_future_hybrid"))
    outputs = F.when(future.isNotNull() & ~F.map_contains_key(outputs, "expanded_query"), F.map_concat(outputs, F.create_map(F.lit("expanded_query"), future))).otherwise(outputs)
    return F.struct(F.when(F.size(inputs) > 0, inputs).otherwise(fallback).alias("input"), F.when(F.size(outputs) > 0, outputs).otherwise(fallback).alias("output"))
