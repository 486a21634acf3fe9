"""Queries over regression cases, feedback and traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier import rules
from dossier.operators import evaluation as e
from dossier.plans.registry import query, table

def _nothing():
    return F.lit(None).cast("string")


def responses(spark, sf_dir):
    """A response per conversation turn with two results and two steps."""
    k, t = F.col("conv_id").cast("string"), F.col("turn")
    doc = F.concat(F.lit("doc-"), k)
    result = lambda d, ch, u1, u2: F.struct(d.alias("doc_id"), F.struct(ch.alias("doc_id")).alias("chunk"), F.struct(u1.alias("url")).alias("citation"), u2.alias("url"))
    results = F.array(
        result(F.when(t % 2 == 0, doc).otherwise(""), doc, F.when(t % 3 == 0, F.concat(F.lit("u/"), k)), F.lit("u/second")),
        result(_nothing(), F.concat(F.lit("chunk-"), t.cast("string")), F.lit(""), F.lit("u/second")),
    )
    none = F.array().cast("array<string>")
    step = lambda key, kind, types: F.struct(F.lit(key).alias("key"), kind.alias("answer_type"), types.alias("evidence_types"))
    steps = F.array(step("evidence_quality", _nothing(), F.array(F.lit("table_evidence"))), step("answer_and_observe", F.lit("definition"), F.array(F.lit("action_evidence"), F.lit("table_evidence"))))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.col("text").alias("answer"), results.alias("results"), F.when(t % 4 != 1, F.struct(F.when(t % 4 == 0, F.lit("table_lookup")).alias("answer_type"))).alias("answer_plan"), steps.alias("steps"),
        F.when(t % 5 == 0, F.array(F.lit("listing_evidence"))).otherwise(none).alias("evidence_types"),
    )


@query(
    "k1_observed_sets",
    """SELECT conv_id, turn, 'doc-' || conv_id || ',chunk-' || turn AS doc_ids, CASE WHEN turn % 3 = 0 THEN 'u/' || conv_id || ',' ELSE '' END || 'u/second' AS urls,
         CASE turn % 4 WHEN 0 THEN 'table_lookup' WHEN 1 THEN 'definition' END AS answer_type, CASE WHEN turn % 5 = 0 THEN 'listing_evidence,' ELSE '' END || 'action_evidence,table_evidence' AS evidence_types FROM conversations""",
)
def k1_observed_sets(spark, sf_dir):
    d = e.observed(responses(spark, sf_dir))
    j = lambda x, n: F.array_join(x, ",").alias(n)
    return d.select("conv_id", "turn", j("observed_doc_ids", "doc_ids"), j("observed_urls", "urls"), F.col("observed_answer_type").alias("answer_type"), j("observed_evidence_types", "evidence_types"))


def raw_responses(spark, sf_dir):
    """A response per conversation turn as JSON text; some plans, steps, results and assessments are missing, broken or of another type."""
    k, t = F.col("conv_id").cast("string"), F.col("turn")
    join = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    doc = F.when(t % 2 == 0, join('"doc_id":"doc-', k, '",')).otherwise('"doc_id":"",')
    url = F.when(t % 3 == 0, join('{"url":"u/', k, '"}')).otherwise('"no object"')
    results = join('[{', doc, '"chunk":{"doc_id":"doc-', k, '"},"citation":', url, ',"url":"u/second"},7,{"doc_id":', t.cast("string"), ',"url":"u/second"}]')
    plan = F.when(t % 4 == 0, '{"answer_type":"table_lookup"}').when(t % 4 == 1, "null").when(t % 4 == 2, '{"answer_type":""}').otherwise('"none"')
    said = '{"key":"answer_and_observe","details":{"answer_plan":{"answer_type":"definition"},"answer_evidence_assessments":[{"evidence_type":"action_evidence"},"x",{"evidence_type":null}]}}'
    seen = '{"key":"evidence_quality","details":{"target_evidence_filter":{"evidence_classifications":[{"evidence_type":"outer","general_evidence_assessment":{"evidence_type":"table_evidence"}},{"evidence_type":"action_evidence"}]}}}'
    steps = F.when(t % 5 == 4, '"broken"').otherwise(join('["x",{"key":"answer_and_observe","details":[]},', said, ",", seen, "]"))
    direct = F.when(t % 5 == 0, '[{"evidence_type":"listing_evidence"}]').otherwise("{}")
    whole = join('{"answer":', F.to_json(F.array("text")), ',"results":', results, ',"answer_plan":', plan, ',"steps":', steps, ',"answer_evidence_assessments":', direct, "}")
    whole = F.regexp_replace(whole, r'^\{"answer":\[(?s)(.*?)\],"results"', '{"answer":$1,"results"')
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(t == 7, F.lit("no json")).otherwise(whole).alias("response"))


_OBSERVED = """
    o AS (SELECT conv_id, turn, text, turn <> 7 AS ok, turn <> 7 AND turn % 5 <> 4 AS stepped FROM conversations),
    obs AS (SELECT conv_id, turn, CASE WHEN ok THEN text ELSE '' END AS answer,
      CASE WHEN ok THEN CASE WHEN turn = 0 THEN ['doc-' || conv_id] ELSE ['doc-' || conv_id, CAST(turn AS VARCHAR)] END ELSE []::VARCHAR[] END AS docs,
      CASE WHEN ok THEN CASE WHEN turn % 3 = 0 THEN ['u/' || conv_id, 'u/second'] ELSE ['u/second'] END ELSE []::VARCHAR[] END AS urls,
      CASE WHEN ok AND turn % 4 = 0 THEN 'table_lookup' WHEN turn % 4 IN (1, 3) AND stepped THEN 'definition' END AS answer_type,
      CASE WHEN ok THEN list_concat(CASE WHEN turn % 5 = 0 THEN ['listing_evidence'] ELSE []::VARCHAR[] END, CASE WHEN stepped THEN ['action_evidence', 'table_evidence'] ELSE []::VARCHAR[] END) ELSE []::VARCHAR[] END AS types FROM o)
"""


@query(
    "k1_observed_json",
    f"WITH {_OBSERVED} SELECT conv_id, turn, md5(answer) AS answer_md5, array_to_string(docs, ',') AS doc_ids, array_to_string(urls, ',') AS urls, answer_type, array_to_string(types, ',') AS evidence_types FROM obs",
)
def k1_observed_json(spark, sf_dir):
    d = e.observed_json(raw_responses(spark, sf_dir))
    j = lambda x, n: F.array_join(x, ",").alias(n)
    return d.select("conv_id", "turn", F.md5("answer").alias("answer_md5"), j("observed_doc_ids", "doc_ids"), j("observed_urls", "urls"), F.col("observed_answer_type").alias("answer_type"), j("observed_evidence_types", "evidence_types"))


@query(
    "k2_failing_checks",
    f"""WITH {_OBSERVED}, x AS (SELECT *, ['doc-' || conv_id, '3', '3'] AS e_docs, CASE WHEN turn % 2 = 0 THEN ['u/' || conv_id] ELSE ['u/second'] END AS e_urls, ['action_evidence', 'listing_evidence'] AS e_types FROM obs),
        m AS (SELECT *, list_filter(e_docs, lambda v: NOT list_contains(docs, v)) AS m_docs, list_filter(e_urls, lambda v: NOT list_contains(urls, v)) AS m_urls, list_filter(e_types, lambda v: NOT list_contains(types, v)) AS m_types,
               list_filter(['a', 'q'], lambda w: NOT contains(answer, w)) AS m_words, list_filter(['wh'], lambda w: contains(answer, w)) AS hits, coalesce(answer_type = 'table_lookup', false) OR turn = 2 AS type_ok FROM x)
        SELECT conv_id, turn, array_to_string(m_docs, ',') AS missing_doc_ids, array_to_string(m_urls, ',') AS missing_urls, array_to_string(m_types, ',') AS missing_evidence_types,
               len(m_docs) = 0 AS doc_ids_pass, len(m_words) = 0 AS keywords_pass, len(hits) = 0 AS forbidden_pass, len(m_urls) = 0 AS urls_pass, len(m_types) = 0 AS evidence_types_pass, type_ok AS answer_type_pass,
               len(m_docs) + len(m_words) + len(hits) + len(m_urls) + len(m_types) = 0 AND type_ok AS passed FROM m""",
)
def k2_failing_checks(spark, sf_dir):
    """Cases that fail by each of the six checks; an item that a case names twice is missing twice."""
    k, lit = F.col("conv_id").cast("string"), lambda *xs: F.array(*[F.lit(x) for x in xs])
    d = e.observed_json(raw_responses(spark, sf_dir)).withColumns(
        {"expected_doc_ids": F.array(F.concat(F.lit("doc-"), k), F.lit("3"), F.lit("3")), "expected_urls": F.when(F.col("turn") % 2 == 0, F.array(F.concat(F.lit("u/"), k))).otherwise(lit("u/second")),
         "expected_evidence_types": lit("action_evidence", "listing_evidence"), "expected_keywords": lit("a", "q"), "forbidden_keywords": lit("wh"),
         "expected_answer_type": F.when(F.col("turn") != 2, "table_lookup")}
    )
    j = lambda x: F.array_join(x, ",").alias(x)
    passes = [f"{c}_pass" for c in ("doc_ids", "keywords", "forbidden", "urls", "evidence_types", "answer_type")]
    return e.check_cases(d).select("conv_id", "turn", j("missing_doc_ids"), j("missing_urls"), j("missing_evidence_types"), *passes, "passed")


def checked(spark, sf_dir):
    k = F.col("conv_id").cast("string")
    lit = lambda *xs: F.array(*[F.lit(x) for x in xs])
    d = e.observed(responses(spark, sf_dir)).withColumn("expected_doc_ids", F.array(F.concat(F.lit("doc-"), k), F.lit("chunk-3"))).withColumn("expected_keywords", lit("the", "la"))
    d = d.withColumn("forbidden_keywords", lit("wh", "ç")).withColumn("expected_urls", lit("u/second")).withColumn("expected_evidence_types", lit("table_evidence"))
    return e.check_cases(d.withColumn("expected_answer_type", F.when(F.col("turn") % 2 == 0, "table_lookup")).withColumn("expected_doc_ids", F.when(F.col("turn") == 3, F.col("expected_doc_ids")).otherwise(F.slice("expected_doc_ids", 1, 1))))


_CHECK = """
    x AS (SELECT conv_id, turn, role, array_to_string(list_filter(['the', 'la'], lambda w: NOT contains(text, w)), ',') AS missing_keywords, array_to_string(list_filter(['wh', 'ç'], lambda w: contains(text, w)), ',') AS forbidden_hits,
            turn % 2 <> 0 OR turn % 4 = 0 AS answer_type_pass FROM conversations),
    checked AS (SELECT *, missing_keywords = '' AND forbidden_hits = '' AND answer_type_pass AS passed FROM x)
"""


@query("k2_case_checks", f"WITH {_CHECK} SELECT conv_id, turn, missing_keywords, forbidden_hits, answer_type_pass, '' AS missing_doc_ids, passed FROM checked")
def k2_case_checks(spark, sf_dir):
    j = lambda x: F.array_join(x, ",").alias(x)
    return checked(spark, sf_dir).select("conv_id", "turn", j("missing_keywords"), j("forbidden_hits"), "answer_type_pass", j("missing_doc_ids"), "passed")


def labelled(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("lang", (F.col("quality") == 1).alias("passed"))


_LABELS = "l AS (SELECT lang, quality = 1 AS passed FROM labels JOIN documents USING (doc_id))"


@query("k3_summary", f"WITH {_LABELS} SELECT count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, round(count(*) FILTER (passed) / count(*), 4) AS pass_rate FROM l")
def k3_summary(spark, sf_dir):
    return e.summary(labelled(spark, sf_dir))


@query("k4_category_summary", f"WITH {_LABELS} SELECT lang, count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, lang IS NULL AS is_total, round(count(*) FILTER (passed) / count(*), 4) AS pass_rate FROM l GROUP BY ROLLUP (lang)")
def k4_category_summary(spark, sf_dir):
    return e.summary(labelled(spark, sf_dir), "lang")


@query("k5_cases_by_tag", "SELECT conv_id, turn FROM conversations WHERE role = 'assistant' OR turn % 3 = 1")
def k5_cases_by_tag(spark, sf_dir):
    tags = F.array_compact(F.array(F.lit("all"), F.when((F.col("role") == "assistant") | (F.col("turn") % 3 == 1), F.lit("wanted"))))
    return e.by_tag(table(spark, sf_dir, "conversations").withColumn("tags", tags), "wanted").select("conv_id", "turn")


def feedback(spark, sf_dir, events=None):
    """Feedback derived from the events; some types are unknown, some questions blank."""
    ev = table(spark, sf_dir, "events") if events is None else events
    k = F.col("event_id")
    kind = F.when(F.col("event_type") == "error", "made_up").otherwise(F.get(F.array(*[F.lit(x) for x in rules.FEEDBACK_TYPES]), (k % 7).cast("int")))
    cite = F.struct(F.col("event_type").alias("title"), F.concat(F.lit("u/"), k).alias("url"), F.lit("c").alias("category"), F.lit("d").alias("publish_date"), F.lit("body").alias("body"))
    result = F.struct(F.concat(F.lit("c"), k).alias("chunk_id"), F.concat(F.lit("d"), "user_id").alias("doc_id"), F.lit("secret text").alias("text"), cite.alias("citation"))
    return ev.select(
        "event_id", F.when(k % 10 == 0, "  ").otherwise(F.concat(F.lit(" q "), "user_id")).alias("query"), kind.alias("feedback_type"), F.col("props").alias("answer"), F.lit("").alias("trace_id"),
        F.when(k % 2 == 0, "note").otherwise("").alias("comment"), F.array(result).alias("results"),
    )


FEEDBACK_SQL = f"""SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '' ELSE 'q ' || user_id END AS query, ['{"', '".join(rules.FEEDBACK_TYPES)}'][event_id % 7 + 1] AS known,
    event_type, props AS answer, CASE WHEN event_id % 2 = 0 THEN 'note' END AS comment, 'c' || event_id || '|d' || user_id || '|' || event_type || '|u/' || event_id || '|c|d' AS citations FROM events"""


@query(
    "k6_feedback_records",
    f"""WITH f AS ({FEEDBACK_SQL}) SELECT event_id, query, CASE WHEN event_type = 'error' THEN 'made_up' ELSE known END AS feedback_type, comment, citations,
        CASE WHEN query = '' THEN 'query is required' WHEN event_type = 'error' THEN 'unsupported feedback_type: made_up' END AS reject_reason FROM f""",
)
def k6_feedback_records(spark, sf_dir):
    r = e.feedback_records(feedback(spark, sf_dir))
    one = F.get("citations", F.lit(0))
    flat = F.concat_ws("|", *[one[x] for x in ("chunk_id", "doc_id", "title", "url", "category", "publish_date")])
    return r.select("event_id", "query", "feedback_type", "comment", flat.alias("citations"), "reject_reason")


@query(
    "k7_trace_ids",
    "SELECT conv_id, turn, 'trace_' || substr(sha256(text || chr(0) || (turn + 1)), 1, 16) AS trace_id, CASE WHEN turn % 2 = 0 THEN md5(text) ELSE substr(sha256(lower(trim(role || ' ' || conv_id))), 1, 32) END AS observation_id FROM conversations",
)
def k7_trace_ids(spark, sf_dir):
    seed = F.when(F.col("turn") % 2 == 0, F.upper(F.md5("text"))).otherwise(F.concat("role", F.lit(" "), "conv_id"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", e.trace_id(F.col("text"), F.col("turn") + 1).alias("trace_id"), e.seeded_id(seed).alias("observation_id"))


@query(
    "k8_sanitized_steps",
    """SELECT conv_id, turn, CASE WHEN length(trim(text)) > 240 THEN substr(trim(text), 1, 240) || '...' ELSE nullif(trim(text), '') END AS summary, CAST(turn % 3 AS BIGINT) AS child_count, 'status=' || role || ',tool=t' AS details,
         md5(CASE WHEN length(trim(text)) > 600 THEN substr(trim(text), 1, 600) || '...' ELSE trim(text) END) AS long_md5 FROM conversations""",
)
def k8_sanitized_steps(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("text").alias("summary"), "text", F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1, F.col("turn") % 3).alias("children"),
        F.create_map(F.lit("tool"), F.lit("t"), F.lit("status"), F.col("role"), F.lit("raw_query"), F.col("text")).alias("details"),
    )
    s = e.sanitize_steps(d)
    flat = F.array_join(F.array_sort(F.transform(F.map_entries("details"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ",")
    return s.select("conv_id", "turn", "summary", F.col("child_count").cast("bigint").alias("child_count"), flat.alias("details"), F.md5(e.short_text(F.col("text"))).alias("long_md5"))


@query(
    "k8_sanitized_results",
    """SELECT conv_id, turn, '[{"chunk_id":"c' || turn || '","doc_id":"d' || conv_id || '","distance":0.5,"heading_path":["' || role || '"],"citation":{"title":"' || role || '","url":"u"}}]' AS results,
         CASE turn % 4 WHEN 0 THEN 't' || conv_id WHEN 1 THEN 'r' || conv_id WHEN 2 THEN 's' || conv_id ELSE nullif(text, '') END AS local_trace_id FROM conversations""",
)
def k8_sanitized_results(spark, sf_dir):
    k, t = F.col("conv_id").cast("string"), F.col("turn")
    none = F.lit(None).cast("string")
    cite = F.struct(F.col("role").alias("title"), none.alias("source"), F.lit("u").alias("url"), none.alias("category"), none.alias("publish_date"), F.lit("secret").alias("note"))
    result = F.struct(F.concat(F.lit("c"), t).alias("chunk_id"), F.concat(F.lit("d"), k).alias("doc_id"), none.alias("block_id"), F.lit(0.5).alias("distance"), F.array("role").alias("heading_path"), cite.alias("citation"), F.col("text").alias("text"))
    step = lambda m: F.struct(m.alias("details"))
    steps = F.array(step(F.create_map(F.lit("x"), F.lit("y"))), step(F.when(t % 4 == 2, F.create_map(F.lit("trace_id"), F.lit(""), F.lit("request_id"), F.concat(F.lit("s"), k))).otherwise(F.create_map(F.lit("x"), F.lit("y")))))
    d = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array(result).alias("results"), F.when(t % 4 == 0, F.concat(F.lit("t"), k)).otherwise("").alias("trace_id"), F.when(t % 4 == 1, F.concat(F.lit("r"), k)).alias("request_id"), steps.alias("steps"), F.col("text").alias("query"),
    )
    return e.local_trace_id(e.sanitize_results(d)).select("conv_id", "turn", F.to_json("results").alias("results"), "local_trace_id")


def traces(spark, sf_dir):
    """A trace per event: two steps, the second with up to two children."""
    v, k = F.col("value"), F.col("event_id")
    child = lambda i: F.struct(F.concat(F.lit("child"), i.cast("string")).alias("key"), F.when((k + i) % 4 == 0, "warn").otherwise("ok").alias("status"), (v / 4).alias("duration_ms"))
    kids = F.transform(F.slice(F.array(F.lit(1), F.lit(2)), 1, (k % 3).cast("int")), child)
    none = F.filter(kids, lambda x: F.lit(False))
    step = lambda key, status, ms, ch: F.struct(F.lit(key).alias("key"), status.alias("status"), ms.alias("duration_ms"), ch.alias("children"))
    return table(spark, sf_dir, "events").select(
        k.alias("trace_id"), F.array(step("first", F.when(F.col("event_type") == "error", "warn").otherwise("ok"), v, none), step("second", F.lit("ok"), v * 2, kids)).alias("steps")
    )


_STEPS = """
    st AS (SELECT event_id AS trace_id, '1' AS path, 'first' AS key, CASE WHEN event_type = 'error' THEN 'warn' ELSE 'ok' END AS status, value AS duration_ms, 0 AS child_count FROM events
           UNION ALL SELECT event_id, '2', 'second', 'ok', value * 2, event_id % 3 FROM events
           UNION ALL SELECT event_id, '2.' || i, 'child' || i, CASE WHEN (event_id + i) % 4 = 0 THEN 'warn' ELSE 'ok' END, value / 4, 0 FROM events, (VALUES (1), (2)) v(i) WHERE i <= event_id % 3)
"""


@query("k9_step_rows", f"WITH {_STEPS} SELECT trace_id, path, key, status, round(duration_ms, 4) AS duration_ms, CAST(child_count AS BIGINT) AS child_count FROM st")
def k9_step_rows(spark, sf_dir):
    return e.step_rows(traces(spark, sf_dir)).withColumn("duration_ms", F.round("duration_ms", 4)).withColumn("child_count", F.col("child_count").cast("bigint"))


@query("k9_trace_rollup", f"WITH {_STEPS} SELECT trace_id, count(*) AS step_count, round(sum(CASE WHEN NOT contains(path, '.') THEN duration_ms END), 4) AS duration_ms, CASE WHEN bool_or(status = 'warn') THEN 'warn' ELSE 'ok' END AS status FROM st GROUP BY trace_id")
def k9_trace_rollup(spark, sf_dir):
    return e.trace_rollup(e.step_rows(traces(spark, sf_dir))).withColumn("duration_ms", F.round("duration_ms", 4))


@query(
    "k10_data_flow",
    """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'raw_message=' || role || ',top_k=' || turn ELSE 'detail_keys=intent,other,node_key=' || role END AS inputs,
         CASE WHEN turn % 2 = 0 THEN 'detail_keys=other,raw_query,top_k,node_key=' || role ELSE 'intent=' || role END AS outputs FROM conversations""",
)
def k10_data_flow(spark, sf_dir):
    even = F.col("turn") % 2 == 0
    details = F.when(even, F.create_map(F.lit("raw_query"), F.col("role"), F.lit("top_k"), F.col("turn").cast("string"), F.lit("other"), F.lit("x"))).otherwise(
        F.create_map(F.lit("intent"), F.col("role"), F.lit("other"), F.lit("x"), F.lit("data_flow"), F.lit("y")))
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", e.data_flow(F.col("role"), details).alias("f"))
    flat = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ",")
    return d.select("conv_id", "turn", flat("f.input").alias("inputs"), flat("f.output").alias("outputs"))
