"""Queries over the ingest job."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.functions.session import by_shuffle
from dossier.operators import chunking, ingest
from dossier.plans.chunking_queries import WINDOWS
from dossier.plans.derived import LINES_CTE, policy_lines
from dossier.plans.parsing_queries import ELEMENTS_CTE
from dossier.plans.registry import query, table, texts
from dossier.sources.raw import FILE_TYPE
from pyspark.sql import types as T


def files_of(spark, sf_dir):
    """Up to three files per customer; every third is a PDF, every fifth cannot be fetched."""
    k = F.col("c_custkey")
    names = F.transform(F.sequence(F.lit(1).cast("bigint"), F.lit(3).cast("bigint")), lambda i: F.struct(i.alias("i"), F.when((k + i) % 3 == 0, "pdf").otherwise("txt").alias("x")))
    item = lambda s: F.create_map(
        F.lit("fileName"), F.concat(F.lit("f"), s["i"].cast("string"), F.lit("."), s["x"]),
        F.lit("downloadUrl"), F.concat(F.lit("u/"), k.cast("string"), F.lit("/"), s["i"].cast("string")),
    )
    files = F.transform(F.filter(names, lambda s: s["i"] <= k % 4), item)
    return texts(spark, sf_dir, "customer").select(k.alias("doc_id"), F.coalesce(files, F.array().cast(T.ArrayType(FILE_TYPE))).alias("files"))


def contents_of(spark, sf_dir):
    k = F.col("c_custkey")
    d = texts(spark, sf_dir, "customer").select(k, "c_name", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(3).cast("bigint"))).alias("i")).filter("(c_custkey + i) % 5 <> 0")
    return d.select(F.concat(F.lit("u/"), "c_custkey", F.lit("/"), "i").alias("url"), F.repeat(F.concat("c_name", F.lit(". ")), F.lit(100)).alias("text"))


_FILES = """
    f AS (SELECT c_custkey AS k, c_name, i, (c_custkey + i) % 3 = 0 AS pdf, (c_custkey + i) % 5 = 0 AS gone FROM customer, (VALUES (1), (2), (3)) v(i) WHERE i <= c_custkey % 4)
"""


FRONT_LINES = ("员工手册# @ Employee Disciplinary Rules 2024-01-02 03:04:05 [摘要] 说明@", "We are a group of people at @.", "使命、培养目标和愿景", "使命内容#", "@员工纪律制度 引言", "引言正文")


def details(spark, sf_dir):
    """Detail records: one policy document per customer, as HTML paragraphs; every third has front matter, every fourth an English tail, some have files."""
    k = F.col("c_custkey")
    front = F.array(*[F.replace(F.replace(F.lit(x), F.lit("@"), F.col("c_mktsegment")), F.lit("#"), k.cast("string")) for x in FRONT_LINES])
    none = F.array().cast("array<string>")
    lines = F.concat(F.when(k % 3 == 0, front).otherwise(none), F.when(k % 4 == 0, policy_lines(True)).otherwise(policy_lines(False)))
    body = F.concat(F.lit("<p>"), F.array_join(lines, "</p><p>"), F.lit("</p>"))
    d = texts(spark, sf_dir, "customer").select(
        F.concat(F.lit("company-policy-"), k).alias("doc_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("category_name"), body.alias("body"),
        F.create_map(F.lit("create_user_name"), F.col("c_name")).alias("metadata"), k.alias("_k"),
    )
    return d.join(by_shuffle(files_of(spark, sf_dir).withColumnRenamed("doc_id", "_k")), "_k").drop("_k")


# Every chunk of a detail record in order: part 0 front, 1 body, 2 English tail, 3 tree. `p` is the path below the base.
_DETAIL_CHUNKS = f"""
    fm AS (SELECT k, 0 AS part, v.o AS a, 0 AS b, 0 AS c, v.ct AS chunk_type, replace(replace(v.t, '@', seg), '#', CAST(k AS VARCHAR)) AS text, v.p FROM docs, (VALUES
        (1, 'document_intro', '员工手册#', ''), (2, 'document_intro', '@ Employee Disciplinary Rules', ''), (3, 'document_metadata', '2024-01-02 03:04:05', '文档时间'), (4, 'summary', '[摘要] 说明@', '摘要'),
        (5, 'summary', 'We are a group of people at @.', '摘要'), (6, 'mission_section', '使命、培养目标和愿景 使命内容#', '使命、培养目标和愿景'), (7, 'policy_intro', '@员工纪律制度 引言 引言正文', '引言')) v(o, ct, t, p) WHERE k % 3 = 0),
    sections AS (SELECT k, 1 AS part, v.o AS a, 0 AS b, 0 AS c, v.ct, replace(v.t, '@', seg) AS text, v.p FROM docs, (VALUES
        (1, 'policy_section', '一、总则 本制度适用于@部门。', '一、总则'), (3, 'policy_section', '五、违规行为相应处理 1. 处理方式', '五、违规行为相应处理'),
        (4, 'action_clause', '1.1一类违规行为：解除劳动合同。', '五、违规行为相应处理 > 1.1 一类违规行为'), (5, 'action_clause', '1.2二类违规行为：予以记过处分。', '五、违规行为相应处理 > 1.2 二类违规行为'),
        (6, 'action_clause', '1.3三类违规行为：予以警告。', '五、违规行为相应处理 > 1.3 三类违规行为'), (7, 'disciplinary_rule', '1.4其他情形另行处理。', '五、违规行为相应处理 > 1.4'),
        (8, 'appendix', '九、附件 附件内容。', '九、附件')) v(o, ct, t, p)),
    overviews AS (SELECT k, 1, 2, c, 0, 'violation_category_overview', CASE WHEN c = 1 THEN '四、违规行为 ' ELSE '' END || '（' || n || '）' || n || '类违规行为 ' || n || '类违规行为：指性质严重的行为。 ' ||
        string_agg(g || '. ' || seg || '条款' || letter || '行为', ' ' ORDER BY i), n || '类违规行为' FROM ords GROUP BY k, c, n),
    groups AS (SELECT k, 1, 2, c, i, 'clause_group', g || '. ' || seg || '条款' || letter || '行为 ' || (g + shift) || '.1 情形一。 ' || (g + shift) || '.2 情形二。', n || '类违规行为 > ' || g || '. ' || seg || '条款' || letter || '行为' FROM ords),
    english AS (SELECT k, 2, v.o, 0, 0, v.ct, replace(v.t, '@', seg), v.p FROM docs, (VALUES
        (1, 'english_section', 'Employee Disciplinary Rules', 'English'), (2, 'english_section', 'I. Purpose To keep order in @.', 'I. Purpose'),
        (3, 'english_category_overview', 'IV. Violations (I) Category 1 Violation Serious matters. 1. Ethics conduct', 'Category 1 Violation'),
        (4, 'english_clause_group', '1. Ethics conduct: 1.1 First item. 1.2 Second item.', 'Category 1 Violation > 1. Ethics conduct'),
        (5, 'english_category_overview', '(II) Category 2 Violation Other matters. 1. Order conduct', 'Category 2 Violation'),
        (6, 'english_clause_group', '1. Order conduct: 1.1 Third item.', 'Category 2 Violation > 1. Order conduct'),
        (7, 'english_action_clause', 'V. Applicable Disciplinary Actions against Violations 1.1 Category 1 Violation: dismissal.', 'V. Applicable Disciplinary Actions against Violations > 1.1 Category 1 Violation'),
        (8, 'english_action_clause', '1.2 Other cases: warning.', 'V. Applicable Disciplinary Actions against Violations > 1.2')) v(o, ct, t, p) WHERE k % 4 = 0),
    definitions AS (SELECT k, 3, 1, c * 100, v.o, v.ct, CASE v.o WHEN 1 THEN '（' || n || '）' || n || '类违规行为 ' || n || '类违规行为：指性质严重的行为。'
        ELSE n || '类违规行为 ' || string_agg(g || '. ' || seg || '条款' || letter || '行为', ' ' ORDER BY i) END, n || '类违规行为'
        FROM ords, (VALUES (1, 'section_definition'), (2, 'section_children')) v(o, ct) GROUP BY k, c, n, v.o, v.ct),
    leaves AS (SELECT k, 3, 1, c * 100 + i, s.j, 'leaf_clause', (g + shift) || '.' || s.j || ' ' || s.t, n || '类违规行为 > ' || g || '. ' || seg || '条款' || letter || '行为 > ' || (g + shift) || '.' || s.j || ' ' || s.t
        FROM ords, (VALUES (1, '情形一。'), (2, '情形二。')) s(j, t)),
    mappings AS (SELECT k, 3, 2, v.o, 0, 'action_mapping', v.t, '五、违规行为相应处理 > 1. 处理方式 > ' || v.p FROM docs, (VALUES
        (1, '1.1一类违规行为：解除劳动合同。', '1.1 一类违规行为'), (2, '1.2二类违规行为：予以记过处分。', '1.2 二类违规行为'), (3, '1.3三类违规行为：予以警告。', '1.3 三类违规行为')) v(o, t, p)),
    every AS (SELECT * FROM fm UNION ALL SELECT * FROM sections UNION ALL SELECT * FROM overviews UNION ALL SELECT * FROM groups UNION ALL SELECT * FROM english
        UNION ALL SELECT * FROM definitions UNION ALL SELECT * FROM leaves UNION ALL SELECT * FROM mappings),
    numbered AS (SELECT e.*, row_number() OVER (PARTITION BY e.k ORDER BY part, a, b, c) AS no, d.seg, d.name FROM every e JOIN docs d ON d.k = e.k)
"""


def _all_detail_chunks(spark, sf_dir):
    urls = contents_of(spark, sf_dir)
    return ingest.detail_chunks(details(spark, sf_dir), contents=urls, parse_attachments=True)


@query(
    "e1_detail_chunks",
    f"""WITH {LINES_CTE}, {_FILES}, {_DETAIL_CHUNKS}
        SELECT 'company-policy-' || k AS doc_id, CASE WHEN part = 3 THEN 0 ELSE 1 END AS branch, 'company-policy-' || k || printf('-chunk-%04d', no) AS chunk_id, chunk_type || printf('-%04d', no) AS block_id,
               md5(text) AS text_md5, seg || ' > ' || name || CASE WHEN p = '' THEN '' ELSE ' > ' || p END AS heading_path FROM numbered
        UNION ALL
        SELECT 'company-policy-' || k || '-attachment-' || i, 2, 'company-policy-' || k || '-attachment-' || i || printf('-chunk-%04d', w.n), 'attachment-' || i || printf('-chunk-%04d', w.n), md5(w.t), c_mktsegment || ' > ' || c_name || ' > f' || i || '.txt'
        FROM (SELECT f.*, c_mktsegment, trim(repeat(f.c_name || '. ', 100)) AS t FROM f JOIN customer ON c_custkey = k WHERE NOT pdf AND NOT gone) x,
             LATERAL (SELECT 1 AS n, trim(substr(x.t, 1, 1200 - (1200 % (length(x.c_name) + 2)) - 1)) AS t UNION ALL
                      SELECT 2, trim(substr(x.t, 1200 - (1200 % (length(x.c_name) + 2)) - 150))) w""",
)
def e1_detail_chunks(spark, sf_dir):
    c = _all_detail_chunks(spark, sf_dir)
    return c.select("doc_id", "branch", "chunk_id", "block_id", F.md5("text").alias("text_md5"), F.array_join("heading_path", " > ").alias("heading_path"))


@query(
    "e1_chunk_metadata",
    f"""WITH {LINES_CTE}, {_FILES}, {_DETAIL_CHUNKS},
        a AS (SELECT k, count(*) AS n, count(*) FILTER (NOT pdf AND NOT gone) AS ok, count(*) FILTER (pdf OR gone) AS warn FROM f GROUP BY k),
        sizes AS (SELECT k, count(*) AS lines FROM lines GROUP BY k), gr AS (SELECT k, count(*) AS n FROM ords GROUP BY k)
        SELECT 'company-policy-' || m.k || printf('-chunk-%04d', no) AS chunk_id, m.name AS create_user_name, m.seg AS category, chunk_type, CASE WHEN a.n IS NULL THEN 'none' WHEN ok = a.n THEN 'success' WHEN ok > 0 THEN 'partial' ELSE 'failed' END AS attachments,
               CAST(coalesce(a.n, 0) AS VARCHAR) AS file_count, 'policy_clause_group' AS strategy, CAST(sizes.lines + CASE WHEN m.k % 3 = 0 THEN 6 ELSE 0 END + CASE WHEN m.k % 4 = 0 THEN 13 ELSE 0 END AS VARCHAR) AS element_count,
               CAST(4 + 3 + 4 + gr.n * 3 AS VARCHAR) AS node_count,
               CASE WHEN m.k % 5 = 0 OR m.k % 7 = 0 OR m.k % 11 = 0 THEN 'partial' ELSE 'success' END AS structure_status,
               CAST(CASE WHEN m.k % 5 = 0 OR m.k % 7 = 0 THEN 3 ELSE 0 END + CASE WHEN m.k % 11 = 0 THEN 2 * gr.n ELSE 0 END AS VARCHAR) AS structure_issue_count
        FROM numbered m LEFT JOIN a ON a.k = m.k JOIN sizes ON sizes.k = m.k JOIN gr ON gr.k = m.k""",
)
def e1_chunk_metadata(spark, sf_dir):
    m = lambda key, name: F.col("metadata")[key].alias(name)
    c = _all_detail_chunks(spark, sf_dir).filter("branch < 2")
    return c.select(
        "chunk_id", m("create_user_name", "create_user_name"), m("policy_category_type_name", "category"), m("chunk_type", "chunk_type"), m("attachment_parse_status", "attachments"), m("file_count", "file_count"),
        m("chunking_strategy", "strategy"), m("parse_element_count", "element_count"), m("structure_node_count", "node_count"), m("structure_status", "structure_status"), m("structure_issue_count", "structure_issue_count"),
    )


@query(
    "e1_chunk_provenance",
    f"""WITH RECURSIVE {ELEMENTS_CTE}, sp AS (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS st FROM elements),
        tx AS (SELECT page_id AS doc_id, string_agg(text, ' ' ORDER BY pos) AS text FROM elements GROUP BY page_id),
        {WINDOWS.replace('FROM documents', 'FROM tx')}
        SELECT 'company-policy-' || c.doc_id || printf('-chunk-%04d', c.i) AS chunk_id, c.st AS span_start, c.en AS span_end, min(pos) AS range_start, max(pos) AS range_end, string_agg(printf('element-%04d', pos), ',' ORDER BY pos) AS element_ids
        FROM cut c JOIN sp ON sp.page_id = c.doc_id AND sp.st < c.en AND sp.st + length(sp.text) > c.st GROUP BY c.doc_id, c.i, c.st, c.en""",
)
def e1_chunk_provenance(spark, sf_dir):
    c = ingest.detail_chunks(_page_details(spark, sf_dir))
    number = lambda n: F.col(n).cast("bigint").alias(n)
    return c.select("chunk_id", F.col("start").cast("bigint").alias("span_start"), F.col("end").cast("bigint").alias("span_end"), number("range_start"), number("range_end"), F.array_join("element_ids", ",").alias("element_ids"))


def _page_details(spark, sf_dir):
    return texts(spark, sf_dir, "pages").select(F.concat(F.lit("company-policy-"), "page_id").alias("doc_id"), F.col("url").alias("title"), F.lit("web").alias("category_name"), F.col("html").alias("body"))


@query(
    "e1_page_chunks",
    f"""WITH RECURSIVE {ELEMENTS_CTE}, tx AS (SELECT page_id AS doc_id, string_agg(text, ' ' ORDER BY pos) AS text FROM elements GROUP BY page_id),
        {WINDOWS.replace('FROM documents', 'FROM tx')}
        SELECT 'company-policy-' || doc_id AS doc_id, 'company-policy-' || doc_id || printf('-chunk-%04d', i) AS chunk_id, md5(piece) AS text_md5 FROM cut""",
)
def e1_page_chunks(spark, sf_dir):
    return ingest.detail_chunks(_page_details(spark, sf_dir)).select("doc_id", "chunk_id", F.md5("text").alias("text_md5"))


@query(
    "e2_heading_merge",
    """SELECT c_custkey AS doc_id, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment || ' > ' || c_name || ' > x' WHEN 1 THEN c_mktsegment || ' > ' || c_name || ' > x'
              WHEN 2 THEN c_mktsegment || ' > ' || c_name || ' > other > x' ELSE c_name END AS heading_path FROM customer""",
)
def e2_heading_merge(spark, sf_dir):
    r = F.col("c_custkey") % 4
    none = F.array().cast("array<string>")
    base = F.when(r == 3, none).otherwise(F.array("c_mktsegment", "c_name"))
    path = F.when(r == 0, F.array(F.col("c_mktsegment"), F.col("c_name"), F.lit("x"))).when(r == 1, F.array(F.col("c_name"), F.lit("x"))).when(r == 2, F.array(F.lit("other"), F.lit("x"))).otherwise(none)
    return texts(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.array_join(ingest.merged_path(base, F.col("c_name"), path), " > ").alias("heading_path"))


@query(
    "e3_attachment_status",
    f"""WITH {_FILES}, a AS (SELECT k, count(*) AS n, count(*) FILTER (NOT pdf AND NOT gone) AS ok, count(*) FILTER (pdf OR gone) AS warn FROM f GROUP BY k)
        SELECT c_custkey AS doc_id, coalesce(n, 0) AS file_count, coalesce(ok, 0) AS parsed_count, coalesce(warn, 0) AS warning_count,
               CASE WHEN n IS NULL THEN 'none' WHEN ok = n THEN 'success' WHEN ok > 0 THEN 'partial' ELSE 'failed' END AS status FROM customer LEFT JOIN a ON k = c_custkey""",
)
def e3_attachment_status(spark, sf_dir):
    d = files_of(spark, sf_dir)
    return ingest.attachment_status(d, ingest.parsed_attachments(d, contents_of(spark, sf_dir)))


@query(
    "e3_attachment_chunks",
    f"""WITH {_FILES} SELECT k || '-attachment-' || i AS doc_id, k || '-attachment-' || i || printf('-chunk-%04d', n) AS chunk_id FROM f, (VALUES (1), (2)) v(n) WHERE NOT pdf AND NOT gone""",
)
def e3_attachment_chunks(spark, sf_dir):
    d = files_of(spark, sf_dir)
    return ingest.attachment_chunks(ingest.parsed_attachments(d, contents_of(spark, sf_dir))).select("doc_id", "chunk_id")


@query(
    "e4_metadata_merge",
    "SELECT c_custkey AS doc_id, 'name=' || c_name || ',segment=chunk' || CASE WHEN c_custkey % 2 = 0 THEN ',type=clause' ELSE '' END AS metadata FROM customer",
)
def e4_metadata_merge(spark, sf_dir):
    left = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"), F.lit("empty"), F.lit(None).cast("string"))
    right = F.create_map(F.lit("segment"), F.lit("chunk"), F.lit("type"), F.when(F.col("c_custkey") % 2 == 0, "clause"))
    m = F.array_sort(F.transform(F.map_entries(ingest.merged_metadata(left, right)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return texts(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.array_join(m, ",").alias("metadata"))


@query(
    "e5_category_enrichment",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE n_name END AS category_name, n_regionkey AS category_type
       FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def e5_category_enrichment(spark, sf_dir):
    d = texts(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("category_name"), F.lit(None).cast("int").alias("category_type")
    )
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "k")
    return ingest.enrich_category(d, n, "k", {"category_name": "n_name", "category_type": "n_regionkey"}).drop("k")


def page_outcomes(spark, sf_dir):
    p = texts(spark, sf_dir, "pages")
    k = F.col("page_id")
    body = F.when(k % 6 == 1, F.lit("<p> </p>")).otherwise(F.col("html"))
    listing = p.select(
        F.when(k % 6 != 0, k).alias("import_id"), F.col("url").alias("title"), k.alias("row_id"),
        F.when(k % 6 == 2, F.concat(F.lit("ValueError: bad record "), k)).alias("error"),
    )
    d = p.filter((k % 6 != 0) & (k % 6 != 2)).select(k.cast("string").alias("doc_id"), F.col("url").alias("title"), F.lit("web").alias("category_name"), body.alias("body"))
    counts = ingest.chunk_counts(ingest.detail_chunks(d)).select(F.col("doc_id").cast("bigint").alias("import_id"), "chunk_count")
    return ingest.outcomes(listing, counts)


@query(
    "e6_outcomes",
    f"""WITH RECURSIVE {ELEMENTS_CTE}, tx AS (SELECT page_id AS doc_id, string_agg(text, ' ' ORDER BY pos) AS text FROM elements WHERE page_id % 6 NOT IN (0, 1, 2) GROUP BY page_id),
        {WINDOWS.replace('FROM documents', 'FROM tx')}, n AS (SELECT doc_id, count(*) AS n FROM cut GROUP BY doc_id)
        SELECT page_id AS row_id, CASE WHEN page_id % 6 <> 0 THEN page_id END AS import_id, coalesce(n, 0) AS chunk_count,
          CASE WHEN page_id % 6 IN (0, 1) THEN 'skipped' WHEN page_id % 6 = 2 THEN 'error' WHEN n > 0 THEN 'imported' ELSE 'skipped' END AS status,
          CASE WHEN page_id % 6 = 0 THEN 'missing importInformationId' WHEN page_id % 6 = 2 THEN 'ValueError: bad record ' || page_id WHEN n IS NULL THEN 'empty cleaned body' END AS reason
        FROM pages LEFT JOIN n ON doc_id = page_id""",
)
def e6_outcomes(spark, sf_dir):
    return page_outcomes(spark, sf_dir).select("row_id", "import_id", "chunk_count", "status", "reason")


@query(
    "e6_branch_outcomes",
    f"""WITH {LINES_CTE}, {_FILES}, {_DETAIL_CHUNKS}, c AS (SELECT k, count(*) FILTER (part < 3) AS body_chunks, count(*) FILTER (part = 3) AS tree_chunks FROM numbered GROUP BY k),
        x AS (SELECT k, 2 * count(*) AS attachment_chunks FROM f WHERE NOT pdf AND NOT gone GROUP BY k)
        SELECT 'company-policy-' || c.k AS import_id, c.body_chunks + c.tree_chunks + coalesce(attachment_chunks, 0) AS chunk_count, 'imported' AS status FROM c LEFT JOIN x ON x.k = c.k""",
)
def e6_branch_outcomes(spark, sf_dir):
    """Outcomes with the chunks of bodies, trees and attachments counted together."""
    d = details(spark, sf_dir)
    counts = ingest.chunk_counts(_all_detail_chunks(spark, sf_dir)).withColumnRenamed("doc_id", "import_id")
    listing = d.select(F.col("doc_id").alias("import_id"), "title", F.lit(None).cast("string").alias("error"))
    return ingest.outcomes(listing, counts).select("import_id", "chunk_count", "status")


def document_outcomes(spark, sf_dir):
    d = texts(spark, sf_dir, "documents").select(F.col("doc_id").alias("import_id"), F.col("doc_id").cast("string").alias("title"), "source", "text")
    counts = chunking.window_chunks(d, ["import_id"]).groupBy("import_id").agg(F.count("*").alias("chunk_count"))
    return ingest.outcomes(d.select("import_id", "title", "source", F.lit(None).cast("string").alias("error")), counts)


_STATS = f"""
    {WINDOWS}, n AS (SELECT doc_id, count(*) AS n FROM cut GROUP BY doc_id),
    per AS (SELECT d.source, count(*) AS documents_seen, count(n.n) AS documents_imported, count(*) - count(n.n) AS documents_skipped, CAST(coalesce(sum(n.n), 0) AS BIGINT) AS chunks_stored,
              CAST(greatest(1, ceil(count(*) / 7.0)) AS BIGINT) AS pages_read FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id GROUP BY d.source)
"""


@query("e7_import_stats", f"WITH RECURSIVE {_STATS} SELECT * FROM per")
def e7_import_stats(spark, sf_dir):
    return ingest.import_stats(document_outcomes(spark, sf_dir), "source", 7)


@query(
    "e8_import_summary",
    f"""WITH RECURSIVE {_STATS} SELECT source, count(*) AS category_count, CAST(sum(documents_seen) AS BIGINT) AS documents_seen, CAST(sum(documents_imported) AS BIGINT) AS documents_imported,
        CAST(sum(documents_skipped) AS BIGINT) AS documents_skipped, CAST(sum(chunks_stored) AS BIGINT) AS chunks_stored, CAST(sum(pages_read) AS BIGINT) AS pages_read, source IS NULL AS is_total
        FROM per GROUP BY ROLLUP (source)""",
)
def e8_import_summary(spark, sf_dir):
    s = ingest.import_stats(document_outcomes(spark, sf_dir), "source", 7, total=True)
    return s.withColumn("is_total", F.col("is_total") == 1)


_NUMBERED = f"{WINDOWS}, numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id, i) AS position FROM cut)"


def _batched(spark, sf_dir):
    c = chunking.window_chunks(texts(spark, sf_dir, "documents"), ["doc_id"])
    return ingest.numbered_batches(c.select("doc_id", "chunk_no", "chunk_id", "text"), ["doc_id", "chunk_no"])


@query("e9_embedding_batches", f"WITH RECURSIVE {_NUMBERED} SELECT CAST(floor((position - 1) / 16) AS BIGINT) AS batch_no, count(*) AS batch_chunks, min(position) AS first_position, max(position) AS last_position FROM numbered GROUP BY 1")
def e9_embedding_batches(spark, sf_dir):
    return ingest.batch_plan(_batched(spark, sf_dir))


@query(
    "e9_embedded_chunks",
    f"""WITH RECURSIVE {_NUMBERED} SELECT doc_id, printf('chunk-%04d', i) AS chunk_id, CAST(length(piece) AS DOUBLE) AS first_value,
        CAST(count(*) OVER (PARTITION BY floor((position - 1) / 16)) AS DOUBLE) AS call_size, CAST((position - 1) % 16 AS DOUBLE) AS place_in_call FROM numbered""",
)
def e9_embedded_chunks(spark, sf_dir):
    """Each vector says how long its text is, how many texts its call had and where it stood in the call."""
    e = ingest.embed_in_batches(_batched(spark, sf_dir), "text", lambda texts: [[float(len(t)), float(len(texts)), float(i)] for i, t in enumerate(texts)])
    value = lambda i, name: F.get("embedding", F.lit(i)).alias(name)
    return e.select("doc_id", "chunk_id", value(0, "first_value"), value(1, "call_size"), value(2, "place_in_call"))


@query("e10_dry_run", f"WITH RECURSIVE {_STATS} SELECT CAST(sum(documents_imported) AS BIGINT) AS documents_imported, CAST(sum(chunks_stored) AS BIGINT) AS chunks_stored FROM per")
def e10_dry_run(spark, sf_dir):
    """The ingest counts without embedding or writing anything."""
    d = document_outcomes(spark, sf_dir)
    return d.agg(F.count_if(F.col("status") == "imported").alias("documents_imported"), F.sum("chunk_count").alias("chunks_stored"))
