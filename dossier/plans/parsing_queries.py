"""Queries that parse pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.functions.text import BLANKS
from dossier.operators import parsing
from dossier.plans.registry import query, table, texts

WSQ = f"[{BLANKS}]"


def squash_sql(e: str) -> str:
    return f"trim(regexp_replace({e}, '{WSQ}+', ' ', 'g'))"


# Pages to elements in SQL: hide scripts, styles and comments, split at block
# starts, cut each piece at its own end tag. A piece without one that is also
# the last of the page is an unfinished block and goes.
ELEMENTS_CTE = rf"""
    shown AS (
      SELECT page_id, url, regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->', '', 'g') AS h FROM pages),
    split_pages AS (
      SELECT page_id, url, string_split(regexp_replace(h, '(?i)<(h[1-6]|p|li|blockquote)([\s/>])', chr(1) || '<\1\2', 'g'), chr(1)) AS parts FROM shown),
    pieces AS (
      SELECT page_id, url, len(parts) AS n, unnest(generate_series(2, len(parts))) AS i,
             unnest(parts[2:]) AS piece FROM split_pages),
    ended AS (
      SELECT *, lower(regexp_extract(piece, '^<([a-zA-Z0-9]+)', 1)) AS tag,
             regexp_replace(piece, '^<[^>]*>', '') AS body FROM pieces),
    closed AS (
      SELECT *, CASE tag WHEN 'p' THEN regexp_matches(body, '(?is)</p\s*>') WHEN 'li' THEN regexp_matches(body, '(?is)</li\s*>')
                     WHEN 'h1' THEN regexp_matches(body, '(?is)</h1\s*>') ELSE regexp_matches(body, '(?is)</(h[2-6]|blockquote)\s*>') END AS has_end,
             CASE tag WHEN 'p' THEN regexp_replace(body, '(?is)</p\s*>.*', '') WHEN 'li' THEN regexp_replace(body, '(?is)</li\s*>.*', '')
                     WHEN 'h1' THEN regexp_replace(body, '(?is)</h1\s*>.*', '') ELSE regexp_replace(body, '(?is)</(h[2-6]|blockquote)\s*>.*', '') END AS inner_html
      FROM ended),
    texts AS (
      SELECT page_id, url, i, tag,
             {squash_sql("replace(replace(replace(replace(regexp_replace(regexp_replace(inner_html, '(?i)<br[^>]*>', ' ', 'g'), '<[a-zA-Z/!?][^>]*>', '', 'g'), '&quot;', chr(34)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')")} AS text
      FROM closed WHERE has_end OR i < n),
    elements AS (
      SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY i) AS pos,
             CASE WHEN tag LIKE 'h_' THEN 'title' ELSE 'paragraph' END AS kind,
             CASE WHEN tag LIKE 'h_' THEN CAST(tag[2] AS INT) END AS level, text
      FROM texts WHERE text <> '')
"""


def page_elements(spark, sf_dir):
    return parsing.html_elements(texts(spark, sf_dir, "pages"))


@query(
    "b1_detect_kind",
    r"""
    SELECT page_id, CASE
        WHEN page_id % 9 IN (0, 1) THEN 'html'
        WHEN page_id % 9 = 2 THEN 'text' WHEN page_id % 9 = 3 THEN 'pdf' WHEN page_id % 9 = 4 THEN 'docx'
        WHEN page_id % 9 = 5 THEN 'image' WHEN page_id % 9 = 6 THEN 'pdf' WHEN page_id % 9 = 7 THEN 'text'
        ELSE 'unsupported' END AS kind FROM pages
    """,
)
def b1_detect_kind(spark, sf_dir):
    k = F.col("page_id") % 9
    name = F.element_at(
        F.array(*[F.concat(F.lit("f"), F.col("page_id"), F.lit(x)) for x in
                  (".HTM", ".bin", ".markdown", ".PDF", ".doc", ".jpeg", "", "", ".zip")]), (k + 1).cast("int"))
    mime = F.element_at(
        F.array(*[F.lit(x) for x in ("", "Text/HTML; charset=utf-8", "", "application/octet-stream", "", "", "", "text/csv", "application/zip")]),
        (k + 1).cast("int"))
    content = F.encode(F.when(k == 6, F.concat(F.lit("%PDF-1.7"), "html")).otherwise(F.col("html")), "UTF-8")
    return texts(spark, sf_dir, "pages").select("page_id", parsing.detect_kind(name, mime, content).alias("kind"))


@query(
    "b2_html_elements",
    f"WITH {ELEMENTS_CTE} SELECT page_id, printf('element-%04d', pos) AS element_id, kind, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n_chars FROM elements",
)
def b2_html_elements(spark, sf_dir):
    return parsing.explode_elements(page_elements(spark, sf_dir), ["page_id"]).select(
        "page_id", "element_id", "kind", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n_chars")
    )


@query(
    "b3_heading_path",
    f"""
    WITH {ELEMENTS_CTE},
    marked AS (SELECT *, last_value(CASE WHEN level = 1 THEN text END IGNORE NULLS) OVER w AS h1 FROM elements
               WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
    SELECT page_id, pos, coalesce(h1, '') AS heading_path FROM marked
    """,
)
def b3_heading_path(spark, sf_dir):
    return parsing.explode_elements(page_elements(spark, sf_dir), ["page_id"]).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), F.array_join("heading_path", " > ").alias("heading_path")
    )


def _order_html():
    """A small page per order: nested headings and a table with an empty row."""
    n = (F.col("o_orderkey") % 3 + 1).cast("int")
    rows = F.array_join(
        F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(
            F.lit("<tr><td>"), F.col("o_orderpriority"), F.lit("</td>\n<td> row&nbsp;"), i.cast("string"), F.lit("&lt;</td></tr>"))), "<tr><td> </td></tr>")
    return F.concat(
        F.lit("<h1>Order "), F.col("o_orderkey"), F.lit("</h1><h2>Status</h2><p>is "), F.col("o_orderstatus"),
        F.lit(" <b>now</b></p><h3>Deep</h3><h2 title='a>b'>Lines</h2><p>before<table border=1><tr><th>Priority</th><th>Row</th></tr>"),
        rows, F.lit("</table> after</p><h1>End</h1><li>last</li><p>cut off"),
    )


@query(
    "b3_heading_reset",
    """
    SELECT o_orderkey, unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) AS pos,
           unnest(['Order ' || o_orderkey, 'Order ' || o_orderkey || ' > Status', 'Order ' || o_orderkey || ' > Status',
                   'Order ' || o_orderkey || ' > Status > Deep', 'Order ' || o_orderkey || ' > Lines', 'Order ' || o_orderkey || ' > Lines',
                   'Order ' || o_orderkey || ' > Lines', 'End', 'End']) AS heading_path,
           unnest(['title', 'title', 'paragraph', 'title', 'title', 'table', 'paragraph', 'title', 'paragraph']) AS kind,
           unnest(['Order ' || o_orderkey, 'Status', 'is ' || o_orderstatus || ' now', 'Deep', 'Lines',
                   'Priority | Row ' || array_to_string(list_transform(generate_series(1, o_orderkey % 3 + 1), lambda i: o_orderpriority || ' | row ' || i || '<'), ' '),
                   'before after', 'End', 'last']) AS text
    FROM orders
    """.replace("unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) AS pos", "unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]::BIGINT[]) AS pos"),
)
def b3_heading_reset(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", _order_html().alias("html"))
    return parsing.explode_elements(parsing.html_elements(df), ["o_orderkey"]).select(
        "o_orderkey", F.col("pos").cast("bigint").alias("pos"), F.array_join("heading_path", " > ").alias("heading_path"), "kind", "text"
    )


@query(
    "b4_table_flattening",
    """
    SELECT o_orderkey, CAST(o_orderkey % 3 + 2 AS BIGINT) AS row_count,
           'Priority | Row ' || array_to_string(list_transform(generate_series(1, o_orderkey % 3 + 1), lambda i: o_orderpriority || ' | row ' || i || '<'), ' ') AS text
    FROM orders
    """,
)
def b4_table_flattening(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", _order_html().alias("html"))
    e = parsing.explode_elements(parsing.html_elements(df), ["o_orderkey"])
    return e.filter("kind = 'table'").select("o_orderkey", F.col("row_count").cast("bigint").alias("row_count"), "text")


_PLAIN_CTE = rf"""
    parts AS (SELECT doc_id, unnest(string_split_regex(text || chr(10) || chr(10) || 'Second part. ' || text, '(\r?\n){{2,}}')) AS p,
                     generate_subscripts(string_split_regex(text || chr(10) || chr(10) || 'Second part. ' || text, '(\r?\n){{2,}}'), 1) AS i FROM documents),
    clean AS (SELECT doc_id, i, {squash_sql("replace(replace(replace(regexp_replace(p, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')")} AS t FROM parts)
"""


@query(
    "b5_plain_paragraphs",
    f"""
    WITH {_PLAIN_CTE}
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos, md5(t) AS text_md5 FROM clean WHERE t <> ''
    """,
)
def b5_plain_paragraphs(spark, sf_dir):
    doubled = F.concat("text", F.lit("\n\nSecond part. "), "text")
    df = texts(spark, sf_dir, "documents").select("doc_id", doubled.alias("html"))
    return parsing.explode_elements(parsing.html_elements(df), ["doc_id"]).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), F.md5("text").alias("text_md5")
    )


@query(
    "b6_text_documents",
    f"""
    SELECT doc_id, CASE WHEN {squash_sql('text')} <> '' THEN 'success' ELSE 'failed' END AS status,
           md5({squash_sql('text')}) AS text_md5 FROM documents
    """,
)
def b6_text_documents(spark, sf_dir):
    d = parsing.text_elements(texts(spark, sf_dir, "documents"))
    return d.select(
        "doc_id", F.when(F.size("elements") > 0, "success").otherwise("failed").alias("status"),
        F.md5(parsing.document_text(F.col("elements"))).alias("text_md5"),
    )


@query(
    "b7_unsupported_kinds",
    """
    SELECT page_id, k.parser_name, 'failed' AS status, 0 AS element_count, k.warnings
    FROM pages JOIN (VALUES
      (0, 'unsupported_pdf', 'PDF parser is not configured. Enable Docling/PyMuPDF in the document parsing layer.'),
      (1, 'unsupported_docx', 'DOCX parser is not configured. Enable Docling/python-docx in the document parsing layer.'),
      (2, 'unsupported_image', 'Image OCR parser is not configured. Enable PaddleOCR or an OCR service in the document parsing layer.'),
      (3, 'unsupported_unsupported', 'Unsupported document type. Add a parser or convert the file before ingestion.')) k(r, parser_name, warnings)
    ON page_id % 4 = k.r
    """.replace("0 AS element_count", "CAST(0 AS BIGINT) AS element_count"),
)
def b7_unsupported_kinds(spark, sf_dir):
    suffix = F.element_at(F.array(*[F.lit(s) for s in (".pdf", ".docx", ".tif", ".exe")]), (F.col("page_id") % 4 + 1).cast("int"))
    df = texts(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("f"), suffix).alias("file_name"), F.lit("").alias("mime"), "html")
    d = parsing.parse_sources(df, "file_name", "mime", "html")
    return parsing.parse_quality(d, ["page_id"], F.col("kind")).select("page_id", "parser_name", "status", "element_count", "warnings")


@query(
    "b8_parse_quality",
    f"""
    WITH {ELEMENTS_CTE}
    SELECT p.page_id, CASE WHEN count(e.pos) > 0 THEN 'success' ELSE 'failed' END AS status, count(e.pos) AS element_count,
           count(*) FILTER (e.kind = 'table') AS table_count, CAST(CASE WHEN count(e.pos) > 0 THEN 0 ELSE 1 END AS BIGINT) AS warning_count
    FROM pages p LEFT JOIN elements e ON p.page_id = e.page_id GROUP BY p.page_id
    """,
)
def b8_parse_quality(spark, sf_dir):
    return parsing.parse_quality(page_elements(spark, sf_dir), ["page_id"]).select(
        "page_id", "status", "element_count", "table_count", "warning_count"
    )


@query(
    "b9_document_text",
    f"WITH {ELEMENTS_CTE} SELECT page_id, md5(string_agg(text, ' ' ORDER BY pos)) AS text_md5, CAST(length(string_agg(text, ' ' ORDER BY pos)) AS BIGINT) AS n_chars FROM elements GROUP BY page_id",
)
def b9_document_text(spark, sf_dir):
    t = parsing.document_text(F.col("elements"))
    return page_elements(spark, sf_dir).select("page_id", F.md5(t).alias("text_md5"), F.length(t).cast("bigint").alias("n_chars"))
