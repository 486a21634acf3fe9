"""From a table of questions and a table of chunks to a table of answers."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.functions.session import materialize
from dossier.operators import answers, evidence, features, retrieval
from dossier.operators import understanding as u


def prepared_questions(questions: DataFrame, context_clause: str | None = None) -> DataFrame:
    """Spec, intent, hints, rewritten text, terms and vector of every question (query_id, query)."""
    d = u.understand(u.lookup_spec(questions, context_clause=context_clause)).withColumn("hints", u.hints(F.col("query")))
    d = materialize(d.withColumn("bare", u.is_bare_assertion(F.col("query"))), "questions")
    terms = F.concat("spec.target_terms", F.array_compact(F.array("spec.target_section", "spec.target_clause")))
    r = u.rewrite(F.col("query"), F.col("spec.retrieval_intent"), F.col("hints.category"), F.col("hints.audience"), terms)
    d = d.withColumn("expanded", r["expanded"])
    d = features.embed(d, "expanded", "query_vec")
    flat = d.select("*", *[F.col(f"spec.{c}").alias(c) for c in ("target_terms", "target_clause", "target_subclause", "rule_search_terms", "target_section")])
    flat = retrieval.term_groups(flat, "expanded")
    return flat.drop("target_terms", "target_clause", "target_subclause", "rule_search_terms", "target_section")


def ranked_candidates(asked: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Hybrid candidates of every question, reordered by rule score; `rank` is the new order."""
    limit = max(k, min(24, 4 * k))
    joined = chunks.withColumn("heading_text", F.array_join("heading", " "))
    found = retrieval.hybrid_top_k(asked, joined, chunks, limit, "chunk_id", "text", "heading_text", "meta_text", "chunk_id", "embedding")
    rows = found.join(chunks.drop("embedding"), "chunk_id").join(asked.select("query_id", "query", "expanded", "spec", "intent", "hints", *[n for n in ("top_k",) if n in asked.columns]), "query_id")
    rows = rows.withColumn("scope_applied", F.lit(False))
    scored = evidence.rule_score(rows, "expanded").withColumnRenamed("rank", "rank_before")
    out = retrieval.reorder(scored, "deterministic_score").withColumnRenamed("rank_after", "rank")
    return materialize(out, "candidates")


def final_evidence(candidates: DataFrame, k: int) -> DataFrame:
    """Scoped, filtered, distinct and complementary evidence, k pieces per question at most, or its own `top_k` where the table has one."""
    d = evidence.filter_evidence(evidence.apply_scope(candidates))
    d = evidence.select_complementary(evidence.dedupe(d).filter(~F.col("is_duplicate")))
    rn = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    most = F.least(F.col("top_k"), F.lit(k)) if "top_k" in d.columns else F.lit(k)
    return materialize(d.withColumn("_rn", rn).filter(F.col("_rn") <= most).drop("_rn"), "evidence")


def _answered(asked: DataFrame, final: DataFrame) -> DataFrame:
    real = asked.filter("not bare")
    given = answers.answer_rows(real.select("query_id", "query", "spec", "intent", "hints"), final)
    clarify = asked.filter("bare").select(
        "query_id", "query", F.lit("clarify").alias("branch"), F.lit("请描述具体行为、发生时间、对象和影响范围，才能匹配对应制度。").alias("answer"),
        F.array().cast(given.schema["source_chunk_ids"].dataType).alias("source_chunk_ids"),
    )
    return given.unionByName(clarify)


def _each_once(questions: DataFrame, answered) -> DataFrame:
    """answered(questions) for every question, where questions that differ in their id only share one row of the work.

    What a question finds hangs on its words and limits, so the search meets the corpus with distinct questions, and
    its shuffle does not grow with the product of both tables.
    """
    same = [c for c in questions.columns if c != "query_id"]
    once = questions.groupBy(*same).agg(F.min("query_id").alias("query_id"))
    out = answered(once)
    first = once.select(F.col("query_id").alias("_first"), *[F.col(c).alias(f"_{c}") for c in same])
    every = questions.join(first, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same])).select("query_id", "_first")
    return every.join(out.withColumnRenamed("query_id", "_first"), "_first").select(*out.columns)


def answer_questions(questions: DataFrame, chunks: DataFrame, k: int = 3, context_clause: str | None = None) -> DataFrame:
    """query_id, branch, answer and source chunks; self-judgements are sent back without a search.

    `chunks` has chunk_id, doc_id, block_id, text, heading, section_title, clause_title,
    section_path, chunk_type, items, continuity, source, meta_text, embedding.
    """

    def answered(distinct: DataFrame) -> DataFrame:
        asked = prepared_questions(distinct, context_clause)
        return _answered(asked, final_evidence(ranked_candidates(asked.filter("not bare"), chunks, k), k))

    return _each_once(questions, answered)


def answer_report(questions: DataFrame, chunks: DataFrame, k: int = 3, context_clause: str | None = None) -> DataFrame:
    """What answer_questions gives, with the plan of the answer, its citations and the checks that warn.

    One row per question. questions may have `top_k`, the pieces of evidence of a question, k at most. Self-judgements have no
    plan and no checks. chunks may have `effective_date`; without it no evidence is dated.
    """
    return _each_once(questions, lambda distinct: _report(distinct, chunks, k, context_clause))


def _report(questions: DataFrame, chunks: DataFrame, k: int, context_clause: str | None) -> DataFrame:
    asked = prepared_questions(questions, context_clause)
    real = asked.filter("not bare")
    final = final_evidence(ranked_candidates(real, chunks, k), k)
    kind = evidence.assess(evidence.haystack(), F.col("intent.asked_aspect"), evidence.intent_terms())
    assessed = final.withColumn("_a", kind).select("query_id", "rank", "chunk_id", F.col("_a.evidence_type").alias("evidence_type"), F.col("_a.usable_as_final").alias("usable"))
    wanted = real.select("query_id", F.col("intent.asked_aspect").alias("aspect"), F.col("intent.missing_conditions").alias("missing"), F.col("spec.rule_id").isNotNull().alias("has_rule"))
    plan = evidence.plan_answers(wanted, assessed)
    dated = final if "effective_date" in final.columns else final.withColumn("effective_date", F.lit(None).cast("string"))
    checks = evidence.quality_checks(real, dated, "deterministic_score").filter("status = 'warn'").groupBy("query_id").agg(F.array_sort(F.collect_list("name")).alias("warnings"))
    guard = evidence.scope_guard(real, final).select("query_id", "leaked")
    out = _answered(asked, final)
    for part in (plan, checks, guard):
        out = out.join(part, "query_id", "left")
    return out.withColumn("warnings", F.when(F.col("branch") != "clarify", F.coalesce("warnings", F.array().cast("array<string>"))))
