"""Queries that cut texts into chunks and report coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.functions.text import language_of, squash
from dossier.operators import chunking, parsing
from dossier.plans.derived import LINES_CTE, policy_documents
from dossier.plans.parsing_queries import ELEMENTS_CTE, page_elements, squash_sql
from dossier.plans.registry import query, table, texts


def _docs(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def _cut_sql(size, overlap, stops, next_start):
    """Windows of every document by a recursive walk over its squashed text."""
    def ends(st):
        win = f"substr(t, {st} + 1, {size})"
        stop = f"length(regexp_extract({win}, '(?s)^.*[{stops}]'))"
        return f"CASE WHEN {st} + {size} < n AND {stop} - 1 > {size // 2} THEN {st} + {stop} ELSE least(n, {st} + {size}) END"
    return f"""
    d AS (SELECT doc_id, t, length(t) AS n FROM (SELECT doc_id, {squash_sql('text')} AS t FROM documents) WHERE t <> ''),
    w AS (SELECT doc_id, t, n, 1 AS i, 0 AS st, {ends('0')} AS en FROM d
          UNION ALL
          SELECT doc_id, t, n, i, st, {ends('st')} AS en
          FROM (SELECT doc_id, t, n, i + 1 AS i, {next_start} AS st FROM w WHERE en < n)),
    cut AS (SELECT doc_id, i, n, st + length(raw) - length(ltrim(raw)) AS st, st + length(raw) - length(ltrim(raw)) + length(trim(raw)) AS en, trim(raw) AS piece
            FROM (SELECT doc_id, i, n, st, substr(t, st + 1, en - st) AS raw FROM w) WHERE trim(raw) <> '')
    """


WINDOWS = _cut_sql(1200, 150, "。；;.\n", "en - 150")
PARTS = _cut_sql(1200, 0, "。；;. ", "CASE WHEN substr(t, en + 1, 1) = ' ' THEN en + 1 ELSE en END")


@query(
    "c1_fixed_window",
    f"WITH RECURSIVE {WINDOWS} SELECT doc_id, CAST(i AS BIGINT) AS chunk_no, md5(piece) AS text_md5, CAST(length(piece) AS BIGINT) AS n_chars FROM cut",
)
def c1_fixed_window(spark, sf_dir):
    return chunking.window_chunks(_docs(spark, sf_dir), ["doc_id"]).select(
        "doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n_chars")
    )


@query(
    "c2_fallback_spans",
    f"WITH RECURSIVE {WINDOWS} SELECT doc_id, printf('chunk-%04d', i) AS chunk_id, CAST(st AS BIGINT) AS span_start, CAST(en AS BIGINT) AS span_end FROM cut",
)
def c2_fallback_spans(spark, sf_dir):
    return chunking.window_chunks(_docs(spark, sf_dir), ["doc_id"]).select(
        "doc_id", "chunk_id", F.col("start").cast("bigint").alias("span_start"), F.col("end").cast("bigint").alias("span_end")
    )


@query(
    "c3_split_without_overlap",
    f"""WITH RECURSIVE {PARTS} SELECT doc_id, CAST(CASE WHEN n > 1200 THEN i END AS BIGINT) AS split_index,
        CASE WHEN n > 1200 THEN 'exceeds_max_chars' END AS split_reason, CAST(st AS BIGINT) AS span_start, CAST(en AS BIGINT) AS span_end, md5(piece) AS text_md5 FROM cut""",
)
def c3_split_without_overlap(spark, sf_dir):
    return chunking.bounded_parts(_docs(spark, sf_dir), ["doc_id"]).select(
        "doc_id", F.col("split_index").cast("bigint").alias("split_index"), "split_reason",
        F.col("start").cast("bigint").alias("span_start"), F.col("end").cast("bigint").alias("span_end"), F.md5("text").alias("text_md5"),
    )


SLICES = """
    s AS (SELECT doc_id, length(text) AS n, trim(substr(text, g * 1200 + 1, 1200)) AS piece, g
          FROM documents, LATERAL (SELECT unnest(generate_series(0, greatest(CAST(ceil(length(text) / 1200.0) AS BIGINT) - 1, 0))) AS g))
"""


@query(
    "c4_hard_slice",
    f"""WITH {SLICES} SELECT doc_id, CASE WHEN n > 1200 THEN row_number() OVER (PARTITION BY doc_id ORDER BY g) END AS split_index, md5(piece) AS text_md5
        FROM s WHERE piece <> ''""",
)
def c4_hard_slice(spark, sf_dir):
    return chunking.hard_slices(_docs(spark, sf_dir), ["doc_id"]).select(
        "doc_id", F.col("split_index").cast("bigint").alias("split_index"), F.md5("text").alias("text_md5")
    )


_HEADS = "(1, '一、总则'), (2, '四、违规行为'), (3, '五、违规行为相应处理'), (4, '九、附件')"


@query(
    "c5_sections_zh",
    f"""WITH {LINES_CTE}, t AS (SELECT k, sec, string_agg(line, ' ' ORDER BY c, i, j) AS text FROM lines GROUP BY k, sec)
        SELECT k AS doc_id, CAST(sec AS BIGINT) AS section_no, h.heading, text,
               CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY k ORDER BY sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS span_start
        FROM t JOIN (VALUES {_HEADS}) h(s, heading) ON sec = s""",
)
def c5_sections_zh(spark, sf_dir):
    d = policy_documents(spark, sf_dir, with_english=False)
    return chunking.policy_sections(d, ["doc_id"], "text", chunking.ZH).select(
        "doc_id", F.col("section_no").cast("bigint").alias("section_no"), "heading", F.trim("text").alias("text"),
        F.col("start").cast("bigint").alias("span_start"),
    )


@query(
    "c6_sections_en",
    """SELECT c_custkey AS doc_id, CAST(v.n AS BIGINT) AS section_no, v.heading, replace(v.text, '@', c_mktsegment) AS text
       FROM customer, (VALUES (0, NULL, 'Employee Disciplinary Rules'), (1, 'I. Purpose', 'I. Purpose To keep order in @.'),
         (2, 'IV. Violations', 'IV. Violations (I) Category 1 Violation Serious matters. 1. Ethics conduct: 1.1 First item. 1.2 Second item. (II) Category 2 Violation Other matters. 1. Order conduct: 1.1 Third item.'),
         (3, 'V. Applicable Disciplinary Actions against Violations', 'V. Applicable Disciplinary Actions against Violations 1.1 Category 1 Violation: dismissal. 1.2 Other cases: warning.')) v(n, heading, text)""",
)
def c6_sections_en(spark, sf_dir):
    d = policy_documents(spark, sf_dir).withColumn("tail", chunking.english_tail_start(F.col("text")))
    d = d.withColumn("en", F.substring(F.col("text"), F.col("tail") + 1, F.length("text")))
    return chunking.policy_sections(d, ["doc_id"], "en", chunking.EN).select(
        "doc_id", F.col("section_no").cast("bigint").alias("section_no"), "heading", F.trim("text").alias("text")
    )


def _chunks(spark, sf_dir):
    return chunking.policy_chunks(policy_documents(spark, sf_dir), ["doc_id"])


@query(
    "c7_category_overview",
    f"""WITH {LINES_CTE}
        SELECT k AS doc_id, n || '类违规行为' AS section_title, name || ' > ' || n || '类违规行为' AS heading_path,
               CASE WHEN c = 1 THEN '四、违规行为 ' ELSE '' END || '（' || n || '）' || n || '类违规行为 ' || n || '类违规行为：指性质严重的行为。 ' ||
               string_agg(g || '. ' || seg || '条款' || letter || '行为', ' ' ORDER BY i) AS text, 'category_' || c AS violation_level
        FROM ords GROUP BY k, name, c, n
        UNION ALL
        SELECT k, v.t, name || ' > ' || v.t, v.text, v.lv FROM docs, (VALUES
          ('Category 1 Violation', 'IV. Violations (I) Category 1 Violation Serious matters. 1. Ethics conduct', 'category_1'),
          ('Category 2 Violation', '(II) Category 2 Violation Other matters. 1. Order conduct', 'category_2')) v(t, text, lv)""",
)
def c7_category_overview(spark, sf_dir):
    c = _chunks(spark, sf_dir).filter(F.col("chunk_type").isin("violation_category_overview", "english_category_overview"))
    return c.select("doc_id", "section_title", F.array_join("heading_path", " > ").alias("heading_path"), "text", "violation_level")


@query(
    "c8_clause_groups",
    f"""WITH {LINES_CTE}
        SELECT o.k AS doc_id, o.n || '类违规行为' AS section_title, o.g || '. ' || o.seg || '条款' || o.letter || '行为' AS group_title,
               CAST(o.g AS VARCHAR) AS clause_no, 'category_' || o.c AS violation_level,
               o.g || '. ' || o.seg || '条款' || o.letter || '行为 ' || (o.g + shift) || '.1 情形一。 ' || (o.g + shift) || '.2 情形二。' AS text
        FROM ords o
        UNION ALL
        SELECT k, v.t, v.g, '1', v.lv, v.text FROM docs, (VALUES
          ('Category 1 Violation', '1. Ethics conduct', 'category_1', '1. Ethics conduct: 1.1 First item. 1.2 Second item.'),
          ('Category 2 Violation', '1. Order conduct', 'category_2', '1. Order conduct: 1.1 Third item.')) v(t, g, lv, text)""",
)
def c8_clause_groups(spark, sf_dir):
    c = _chunks(spark, sf_dir).filter(F.col("chunk_type").isin("clause_group", "english_clause_group"))
    return c.select("doc_id", "section_title", "group_title", "clause_no", "violation_level", "text")


@query(
    "c9_action_clauses",
    f"""WITH {LINES_CTE}
        SELECT k AS doc_id, v.no AS clause_no, v.ct AS chunk_type, v.lv AS violation_level, v.text, name || ' > ' || v.p AS heading_path FROM docs, (VALUES
          ('1.1', 'action_clause', 'category_1', '1.1一类违规行为：解除劳动合同。', '五、违规行为相应处理 > 1.1 一类违规行为'),
          ('1.2', 'action_clause', 'category_2', '1.2二类违规行为：予以记过处分。', '五、违规行为相应处理 > 1.2 二类违规行为'),
          ('1.3', 'action_clause', 'category_3', '1.3三类违规行为：予以警告。', '五、违规行为相应处理 > 1.3 三类违规行为'),
          ('1.4', 'disciplinary_rule', NULL, '1.4其他情形另行处理。', '五、违规行为相应处理 > 1.4'),
          ('1.1', 'english_action_clause', 'category_1', 'V. Applicable Disciplinary Actions against Violations 1.1 Category 1 Violation: dismissal.', 'V. Applicable Disciplinary Actions against Violations > 1.1 Category 1 Violation'),
          ('1.2', 'english_action_clause', NULL, '1.2 Other cases: warning.', 'V. Applicable Disciplinary Actions against Violations > 1.2')) v(no, ct, lv, text, p)""",
)
def c9_action_clauses(spark, sf_dir):
    c = _chunks(spark, sf_dir).filter(F.col("chunk_type").isin("action_clause", "disciplinary_rule", "english_action_clause"))
    return c.select("doc_id", "clause_no", "chunk_type", "violation_level", "text", F.array_join("heading_path", " > ").alias("heading_path"))


@query(
    "c10_generic_clauses",
    """SELECT c_custkey AS doc_id, v.ct AS chunk_type, v.no AS clause_no, replace(v.t, '@', c_mktsegment) AS text, v.role AS chunk_role
       FROM customer, (VALUES ('policy_section', NULL, '二、职责 前言@。', 'coverage'), ('policy_clause_group', '1', '1. 主管职责 1.1 审批。', 'retrieval'),
         ('policy_clause_group', '2', '2. @职责：负责执行。', 'retrieval'), ('policy_section', NULL, '三、其他 没有条款。', 'coverage')) v(ct, no, t, role)""",
)
def c10_generic_clauses(spark, sf_dir):
    d = texts(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("source_name"),
        F.concat(F.lit("二、职责 前言"), "c_mktsegment", F.lit("。 1. 主管职责 1.1 审批。 2. "), "c_mktsegment", F.lit("职责：负责执行。 三、其他 没有条款。")).alias("text"),
    )
    return chunking.policy_chunks(d, ["doc_id"]).select("doc_id", "chunk_type", "clause_no", "text", "chunk_role")


@query(
    "c11_clause_range",
    f"""WITH {LINES_CTE}
        SELECT k AS doc_id, CAST(c AS BIGINT) AS level_no, CAST(g AS VARCHAR) AS clause_no, count(*) AS n, CASE WHEN shift = 0 THEN g || '.1-' || g || '.2' END AS clause_range
        FROM ords GROUP BY k, c, g, shift""",
)
def c11_clause_range(spark, sf_dir):
    c = _chunks(spark, sf_dir).filter("chunk_type = 'clause_group'")
    return c.groupBy("doc_id", F.substring("violation_level", -1, 1).cast("bigint").alias("level_no"), "clause_no", "clause_range").agg(F.count("*").alias("n"))


@query(
    "c12_front_matter",
    """SELECT c_custkey AS doc_id, CAST(v.run AS BIGINT) AS run, v.kind, replace(replace(v.t, '@', c_mktsegment), '#', CAST(c_custkey AS VARCHAR)) AS text
       FROM customer, (VALUES (1, 'title_zh', '员工手册# '), (1, 'title_en', '@ Employee Disciplinary Rules '), (1, 'document_metadata', '2024-01-02 03:04:05'), (1, 'summary', '[摘要] 说明@'),
         (2, 'summary', 'We are a group of people at @.'), (3, 'mission_zh', '使命、培养目标和愿景 使命内容# [摘要] 不分开'),
         (4, 'mission_en', 'Mission, Educational Goal and Vision mission text'), (5, 'policy_intro', '@员工纪律制度 引言 引言正文'), (6, 'mission_en', 'Mission, Educational Goal and Vision again')) v(run, kind, t)""",
)
def c12_front_matter(spark, sf_dir):
    seg, k = F.col("c_mktsegment"), F.col("c_custkey").cast("string")
    lines = F.array(
        F.concat(F.lit("员工手册"), k, F.lit(" "), seg, F.lit(" Employee Disciplinary Rules 2024-01-02 03:04:05 [摘要] 说明"), seg),
        F.concat(F.lit("We are a group of people at "), seg, F.lit(".")),
        F.lit("使命、培养目标和愿景"), F.concat(F.lit("使命内容"), k, F.lit(" [摘要] 不分开")),
        F.lit("Mission, Educational Goal and Vision"), F.lit("mission text"),
        F.concat(seg, F.lit("员工纪律制度 引言")), F.lit("引言正文"), F.lit("Mission, Educational Goal and Vision again"), F.lit("一、总则"), F.lit("正文"),
    )
    d = texts(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.array_join(lines, "\n").alias("text"))
    return chunking.front_matter(parsing.line_elements(d, out=None, derive=chunking.FRONT), ["doc_id"]).select("doc_id", F.col("run").cast("bigint").alias("run"), "kind", "text")


@query(
    "c13_role_defaults",
    f"""WITH {LINES_CTE}, z AS (SELECT k, count(*) AS n FROM ords GROUP BY k)
        SELECT v.ct AS chunk_type, v.role AS chunk_role, CASE WHEN v.role = 'retrieval' THEN 'high' ELSE 'low' END AS retrieval_priority,
               CASE WHEN v.role = 'retrieval' THEN 'main' ELSE 'coverage' END AS index_scope,
               CAST(CASE v.ct WHEN 'clause_group' THEN (SELECT sum(n) FROM z) ELSE v.m * (SELECT count(*) FROM docs) END AS BIGINT) AS n
        FROM (VALUES ('policy_section', 'coverage', 2), ('violation_category_overview', 'retrieval', 3), ('clause_group', 'retrieval', 0), ('action_clause', 'retrieval', 3),
          ('disciplinary_rule', 'retrieval', 1), ('appendix', 'coverage', 1), ('english_section', 'coverage', 2), ('english_category_overview', 'retrieval', 2),
          ('english_clause_group', 'retrieval', 2), ('english_action_clause', 'retrieval', 2)) v(ct, role, m)""",
)
def c13_role_defaults(spark, sf_dir):
    return _chunks(spark, sf_dir).groupBy("chunk_type", "chunk_role", "retrieval_priority", "index_scope").agg(F.count("*").alias("n"))


_SPANS = "sp AS (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS st, CAST(length(text) AS BIGINT) AS len FROM elements)"


@query(
    "c14_element_spans",
    f"WITH {ELEMENTS_CTE}, {_SPANS} SELECT page_id, pos, st AS span_start, st + len AS span_end FROM sp",
)
def c14_element_spans(spark, sf_dir):
    return parsing.explode_elements(page_elements(spark, sf_dir), ["page_id"]).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), F.col("start").cast("bigint").alias("span_start"), F.col("end").cast("bigint").alias("span_end")
    )


def _page_chunks(spark, sf_dir, size=400, overlap=50):
    d = page_elements(spark, sf_dir).select("page_id", parsing.document_text(F.col("elements")).alias("text"))
    return chunking.window_chunks(d, ["page_id"], size=size, overlap=overlap)


_PAGE_SLICES = """
    tx AS (SELECT page_id, string_agg(text, ' ' ORDER BY pos) AS t FROM elements GROUP BY page_id),
    ch AS (SELECT page_id, g AS n, g * 400 AS cs, least(length(t), g * 400 + 400) AS ce FROM tx, LATERAL (SELECT unnest(generate_series(0, CAST(ceil(length(t) / 400.0) AS BIGINT) - 1)) AS g))
"""


def _page_slices(spark, sf_dir):
    """Pages with their elements and slices of 400 characters of their text."""
    n = F.length(parsing.document_text(F.col("elements")))
    slices = F.transform(F.sequence(F.lit(0), F.ceil(n / 400).cast("int") - 1), lambda i: F.struct(i.alias("chunk_no"), (i * 400).alias("start"), F.least(n, i * 400 + 400).alias("end")))
    return page_elements(spark, sf_dir).filter(F.size("elements") > 0).select("page_id", "elements", slices.alias("slices"))


@query(
    "c15_element_provenance",
    f"""WITH {ELEMENTS_CTE}, {_SPANS}, {_PAGE_SLICES}
        SELECT ch.page_id, CAST(ch.n AS BIGINT) AS chunk_no, string_agg(printf('element-%04d', pos), ',' ORDER BY pos) AS element_ids, min(pos) AS range_start, max(pos) AS range_end
        FROM ch JOIN sp ON ch.page_id = sp.page_id AND sp.st < ch.ce AND sp.st + sp.len > ch.cs GROUP BY ch.page_id, ch.n""",
)
def c15_element_provenance(spark, sf_dir):
    p = chunking.provenance(_page_slices(spark, sf_dir), ["page_id"], "slices").filter(F.size("element_ids") > 0)
    return p.select(
        "page_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.array_join("element_ids", ",").alias("element_ids"),
        F.col("range_start").cast("bigint").alias("range_start"), F.col("range_end").cast("bigint").alias("range_end"),
    )


def _holes(spark, sf_dir):
    """Documents with slices of 90 characters out of every 100."""
    n = F.length("text")
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / 100).cast("int") - 1, F.lit(0))),
                       lambda i: F.struct((i * 100).alias("start"), F.least(n, i * 100 + 90).alias("end")))
    return _docs(spark, sf_dir).withColumn("spans", cuts)


_CHARS = """
    chars AS (SELECT doc_id, p, regexp_matches(substr(text, p, 1), '[^\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]') AS solid, (p - 1) % 100 < 90 AS inside
              FROM (SELECT doc_id, text, unnest(generate_series(1, length(text))) AS p FROM documents))
"""


@query(
    "c16_char_coverage",
    f"""WITH {_CHARS} SELECT doc_id, CASE WHEN count(*) FILTER (solid AND NOT inside) = 0 THEN 'complete' ELSE 'partial' END AS coverage_status,
        count(*) FILTER (solid) AS source_char_count, count(*) FILTER (solid AND inside) AS covered_char_count, count(*) FILTER (solid AND NOT inside) AS uncovered_char_count,
        round(CASE WHEN count(*) FILTER (solid) > 0 THEN count(*) FILTER (solid AND inside) / count(*) FILTER (solid) ELSE 1.0 END, 6) AS coverage_ratio
        FROM chars GROUP BY doc_id""",
)
def c16_char_coverage(spark, sf_dir):
    return chunking.char_coverage(_holes(spark, sf_dir), ["doc_id"], "text", "spans").select(
        "doc_id", "coverage_status", "source_char_count", "covered_char_count", "uncovered_char_count", F.round("coverage_ratio", 6).alias("coverage_ratio")
    )


@query(
    "c17_uncovered_ranges",
    f"""WITH {_CHARS}, o AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS island FROM chars WHERE solid AND NOT inside),
        r AS (SELECT doc_id, min(p) - 1 AS a, max(p) AS b FROM o GROUP BY doc_id, island),
        f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS n FROM r)
        SELECT f.doc_id, n AS range_no, a AS range_start, b AS range_end, substr(substr(text, a + 1, b - a), 1, 120) AS preview FROM f JOIN documents d ON f.doc_id = d.doc_id WHERE n <= 20""",
)
def c17_uncovered_ranges(spark, sf_dir):
    c = chunking.char_coverage(_holes(spark, sf_dir), ["doc_id"], "text", "spans")
    return c.select("doc_id", F.posexplode("uncovered_ranges").alias("i", "r")).select(
        "doc_id", (F.col("i") + 1).cast("bigint").alias("range_no"), F.col("r.start").cast("bigint").alias("range_start"),
        F.col("r.end").cast("bigint").alias("range_end"), F.col("r.text").alias("preview"),
    )


@query(
    "c18_element_coverage",
    f"""WITH {ELEMENTS_CTE}, {_SPANS}, {_PAGE_SLICES},
        seen AS (SELECT DISTINCT sp.page_id, sp.pos FROM ch JOIN sp ON ch.page_id = sp.page_id AND sp.st < ch.ce AND sp.st + sp.len > ch.cs WHERE ch.n % 2 = 0)
        SELECT e.page_id, CASE WHEN count(*) = count(s.pos) THEN 'complete' ELSE 'partial' END AS element_coverage_status, count(*) AS source_element_count, count(s.pos) AS covered_element_count,
               count(*) - count(s.pos) AS uncovered_element_count, round(count(s.pos) / count(*), 6) AS element_coverage_ratio,
               coalesce(array_to_string((list(e.pos || ':' || md5(substr(e.text, 1, 120)) ORDER BY e.pos) FILTER (s.pos IS NULL))[1:20], ','), '') AS uncovered_elements
        FROM elements e LEFT JOIN seen s ON e.page_id = s.page_id AND e.pos = s.pos GROUP BY e.page_id""",
)
def c18_element_coverage(spark, sf_dir):
    # Every second slice was dropped from the index.
    kept = _page_slices(spark, sf_dir).withColumn("slices", F.filter("slices", lambda c: c["chunk_no"] % 2 == 0))
    d = chunking.element_coverage(kept, ["page_id"], "slices")
    shown = F.array_join(F.transform("uncovered_elements", lambda x: F.concat_ws(":", x["index"].cast("string"), F.md5(x["preview"]))), ",")
    return d.withColumn("element_coverage_ratio", F.round("element_coverage_ratio", 6)).withColumn("uncovered_elements", shown)


@query(
    "c19_structure_report",
    f"""WITH {LINES_CTE} SELECT k AS doc_id, 13 + count(*) AS retrieval_chunk_count, 5 + 0 * count(*) AS coverage_chunk_count, 6 + 0 * count(*) AS english_retrieval_chunk_count,
        0 * count(*) AS orphan_title_count, 4 + count(*) AS mixed_language_chunk_count, 18 + count(*) AS provenance_missing_count, 13 + count(*) AS retrieval_provenance_missing_count
        FROM ords GROUP BY k""",
)
def c19_structure_report(spark, sf_dir):
    c = _chunks(spark, sf_dir).withColumn("element_count", F.lit(0))
    return chunking.structure_report(c, ["doc_id"])


@query(
    "c20_orphan_titles",
    """SELECT c_custkey AS doc_id, c_custkey % 4 = 0 OR c_custkey % 4 = 1 AS orphan FROM customer""",
)
def c20_orphan_titles(spark, sf_dir):
    r = F.col("c_custkey") % 4
    text = F.when(r == 2, F.concat("c_name", F.lit(" more"))).otherwise(F.concat("c_name", F.lit(" ：")))
    role = F.when(r == 3, "retrieval").otherwise("coverage")
    none = F.lit(None).cast("string")
    return texts(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("doc_id"),
        chunking.orphan_title(text, F.array(F.lit("base"), F.col("c_name")), role, F.lit("policy_section"), none).alias("orphan"),
    )


@query(
    "c21_language",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'zh' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'neutral' END AS language,
              CASE WHEN doc_id % 3 = 0 THEN regexp_matches(text, '[A-Za-z]{3,}') ELSE false END AS mixed FROM documents""",
)
def c21_language(spark, sf_dir):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("制度"))).otherwise(F.col("text"))
    d = _docs(spark, sf_dir).select("doc_id", text.alias("text"))
    return d.select("doc_id", language_of("text").alias("language"), chunking.mixed_language(F.col("text"), language_of("text"), F.lit("")).alias("mixed"))


@query(
    "c22_strategy",
    f"""SELECT doc_id, CASE WHEN {squash_sql('text')} = '' THEN 'failed' ELSE 'success' END AS status,
        CASE WHEN lang IN ('fr', 'de') THEN 'policy_clause_group' ELSE 'fixed_window_fallback' END AS strategy,
        CASE WHEN lang IN ('fr', 'de') THEN NULL ELSE 'no_policy_structure_detected' END AS fallback_reason,
        CASE WHEN lang IN ('fr', 'de') THEN 'high' ELSE 'low' END AS boundary_confidence FROM documents""",
)
def c22_strategy(spark, sf_dir):
    marked = F.when(F.col("lang") == "fr", F.concat("text", F.lit(" 二、范围 全体"))).when(
        F.col("lang") == "de", F.concat("text", F.lit(" the Employee Disciplinary Rules"))).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", chunking.strategy(marked).alias("s")).select("doc_id", "s.*")


@query(
    "c23_preview_rollups",
    f"""WITH {LINES_CTE}, z AS (SELECT count(*) AS n FROM ords), d AS (SELECT count(*) AS n FROM docs)
        SELECT v.dim AS dimension, v.val AS value, CAST(v.m * d.n + v.g * z.n AS BIGINT) AS n FROM z, d, (VALUES
          ('chunk_type', 'policy_section', 2, 0), ('chunk_type', 'violation_category_overview', 3, 0), ('chunk_type', 'clause_group', 0, 1), ('chunk_type', 'action_clause', 3, 0),
          ('chunk_type', 'disciplinary_rule', 1, 0), ('chunk_type', 'appendix', 1, 0), ('chunk_type', 'english_section', 2, 0), ('chunk_type', 'english_category_overview', 2, 0),
          ('chunk_type', 'english_clause_group', 2, 0), ('chunk_type', 'english_action_clause', 2, 0), ('language', 'zh', 10, 1), ('language', 'en', 8, 0),
          ('chunk_role', 'retrieval', 13, 1), ('chunk_role', 'coverage', 5, 0)) v(dim, val, m, g)""",
)
def c23_preview_rollups(spark, sf_dir):
    return chunking.rollups(_chunks(spark, sf_dir))


@query(
    "c24_numbering",
    f"""WITH RECURSIVE {WINDOWS} SELECT doc_id, 'company-policy-' || doc_id || printf('-chunk-%04d', i) AS chunk_id, printf('fixed_window-%04d', i) AS block_id FROM cut""",
)
def c24_numbering(spark, sf_dir):
    c = chunking.window_chunks(_docs(spark, sf_dir), ["doc_id"])
    return c.select(
        "doc_id", F.concat(F.lit("company-policy-"), "doc_id", F.format_string("-chunk-%04d", "chunk_no")).alias("chunk_id"),
        F.format_string("fixed_window-%04d", "chunk_no").alias("block_id"),
    )
