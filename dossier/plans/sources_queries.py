"""Queries over raw inputs and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.functions.session import shared_dir
from dossier.plans.registry import query, table
from dossier.sources import raw, tables


@query(
    "a1_raw_detail",
    """
    SELECT event_id,
           CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS import_id,
           CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'company-policy-' || event_id END AS doc_id,
           CASE WHEN event_type IN ('click', 'view') THEN event_type
                WHEN event_type = 'error' THEN 'user ' || user_id
                WHEN event_id % 7 = 0 THEN 'policy-unknown'
                ELSE 'policy-' || event_id END AS title,
           CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0
                THEN 'k' || CAST(json_extract(props, '$.k') AS BIGINT) ELSE event_type END AS category_name,
           event_id % 7 = 0 AS rejected
    FROM events
    """,
)
def a1_raw_detail(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    known = F.col("event_id") % 7 != 0
    payload = F.to_json(
        F.struct(
            F.when(known & (F.col("event_id") % 2 == 0), F.col("event_id")).alias("importInformationId"),
            F.when(known & (F.col("event_id") % 2 == 1), F.col("event_id")).alias("id"),
            F.when(F.col("event_type") == "click", F.lit(" click ")).otherwise(F.lit("  ")).alias("cnTitle"),
            F.when(F.col("event_type") == "view", F.col("event_type")).alias("title"),
            F.when(F.col("event_type") == "error", F.concat(F.lit("user "), "user_id")).alias("enTitle"),
            F.when(k % 2 == 0, F.concat(F.lit("k"), k)).alias("policyCategoryTypeName"),
            F.col("event_type").alias("categoryName"),
        )
    )
    df = table(spark, sf_dir, "events").select("event_id", payload.alias("payload"))
    return raw.detail_rows(df).select("event_id", "import_id", "doc_id", "title", "category_name", "rejected")


@query(
    "a2_category_dim",
    """
    WITH items AS (
      SELECT c_custkey AS o, 0 AS pos, CAST(c_nationkey AS BIGINT) AS id, 'nation ' || c_name AS name, c_mktsegment AS ename FROM customer
      UNION ALL
      SELECT c_custkey, 2, c_custkey, NULL, NULL FROM customer
    )
    SELECT id AS category_id, coalesce(arg_min(coalesce(name, '~'), o * 4 + pos), '') AS n0,
           CASE WHEN arg_min(coalesce(name, '~'), o * 4 + pos) = '~' THEN 'category-' || id
                ELSE arg_min(coalesce(name, '~'), o * 4 + pos) END AS name,
           nullif(arg_min(coalesce(ename, '~'), o * 4 + pos), '~') AS ename
    FROM items GROUP BY id
    """.replace("coalesce(arg_min(coalesce(name, '~'), o * 4 + pos), '') AS n0,", ""),
)
def a2_category_dim(spark, sf_dir):
    item = lambda i, name, ename: F.struct(
        i.cast("string").alias("categoryTypeId"), name.alias("categoryName"), ename.alias("categoryEname")
    )
    none = F.lit(None).cast("string")
    payload = F.to_json(
        F.struct(
            F.array(
                item(F.col("c_nationkey"), F.concat(F.lit("nation "), "c_name"), F.col("c_mktsegment")),
                item(F.lit("not a number"), F.col("c_name"), none),
                item(F.col("c_custkey"), none, none),
            ).alias("categoryList")
        )
    )
    df = table(spark, sf_dir, "customer").select("c_custkey", payload.alias("payload"))
    return raw.category_dim(df, "c_custkey")


_PAGED = """
    SELECT source, doc_id, CAST(position AS BIGINT) AS position, CAST(ceil(position / 7.0) AS BIGINT) AS page_num,
           CAST(greatest(1, ceil(total / 7.0)) AS BIGINT) AS total_pages
    FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position,
                 count(*) OVER (PARTITION BY source) AS total FROM documents)
"""


@query("a3_paged_listing", _PAGED)
def a3_paged_listing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    return raw.paged_listing(docs, "source", "doc_id", 7).select("source", "doc_id", "position", "page_num", "total_pages")


@query("a3_paged_listing_capped", _PAGED + " WHERE position <= 25 AND ceil(position / 7.0) <= 5")
def a3_paged_listing_capped(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    return raw.paged_listing(docs, "source", "doc_id", 7, max_pages=5, max_docs=25).select(
        "source", "doc_id", "position", "page_num", "total_pages"
    )


def labelled_updates(spark, sf_dir):
    """Updates for every labelled document, two versions where the quality is 1, plus new documents."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents")
    hit = docs.join(labels.groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id")
    cols = ["doc_id", "text", "lang", "created_at", "seq"]
    first = hit.withColumn("text", F.concat(F.lit("v1 "), "text")).withColumn("created_at", F.lit(2)).withColumn("seq", F.lit(1))
    second = (
        hit.filter("quality = 1").withColumn("text", F.concat(F.lit("v2 "), "text")).withColumn("created_at", F.lit(3)).withColumn("seq", F.lit(2))
    )
    new = table(spark, sf_dir, "benchmark").select(
        (F.col("item_id") + 1_000_000_000_000).alias("doc_id"), "text", F.lit("en").alias("lang"),
        F.lit(2).alias("created_at"), F.lit(1).alias("seq"),
    )
    return first.select(cols).unionByName(second.select(cols)).unionByName(new)


UPSERT_SQL = """
    WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id)
    SELECT d.doc_id, d.lang,
           md5(CASE WHEN q.quality IS NULL THEN d.text WHEN q.quality = 1 THEN 'v2 ' || d.text ELSE 'v1 ' || d.text END) AS text_md5,
           1 AS created_at
    FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id
    UNION ALL
    SELECT item_id + 1000000000000, 'en', md5(text), 2 FROM benchmark
"""


@query("a4_upsert_chunks", UPSERT_SQL)
def a4_upsert_chunks(spark, sf_dir):
    base = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.lit(1).alias("created_at"))
    out = tables.upsert(base, labelled_updates(spark, sf_dir), "doc_id", "seq")
    return out.select("doc_id", "lang", F.md5("text").alias("text_md5"), "created_at")


@query(
    "a5_referential_cleanup",
    "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)",
)
def a5_referential_cleanup(spark, sf_dir):
    kept = tables.drop_orphans(table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "labels"), "vec_id", "doc_id")
    return kept.select("vec_id", "label")


@query(
    "a6_append_feedback",
    """
    SELECT event_id, event_type AS feedback_type, 'user ' || user_id AS query,
           CASE WHEN value >= 50 THEN 'high' END AS comment FROM events
    """,
)
def a6_append_feedback(spark, sf_dir):
    path = shared_dir(spark, "feedback")
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("feedback_type"), F.concat(F.lit("user "), "user_id").alias("query"),
        F.when(F.col("value") >= 50, F.lit("high")).alias("comment"),
    )
    tables.append_json(rows, path)
    return spark.read.schema("event_id bigint, feedback_type string, query string, comment string").json(path)


@query(
    "a7_source_text",
    "SELECT page_id, CAST(length(html) AS BIGINT) AS n_chars, md5(html) AS text_md5 FROM pages",
)
def a7_source_text(spark, sf_dir):
    as_text = F.col("page_id") % 2 == 0
    df = table(spark, sf_dir, "pages").select(
        "page_id", F.when(as_text, F.col("html")).alias("text"), F.when(~as_text, F.encode("html", "UTF-8")).alias("content")
    )
    return raw.with_text(df).select("page_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


@query(
    "a8_paired_batch_check",
    """
    SELECT (SELECT count(*) FROM documents) AS chunk_count, (SELECT count(*) FROM embeddings) AS vector_count,
           (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS chunks_without_vector,
           (SELECT count(DISTINCT vec_id) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS vectors_without_chunk,
           (SELECT count(*) FROM documents) = (SELECT count(*) FROM embeddings)
             AND NOT EXISTS (SELECT 1 FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS valid
    """,
)
def a8_paired_batch_check(spark, sf_dir):
    return tables.pair_check(table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings"), "doc_id", "vec_id")
