"""Queries over the section tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.operators import parsing, tree
from dossier.plans.derived import LINES_CTE, policy_documents
from dossier.plans.registry import query, table, texts


def _parsed(spark, sf_dir, derive):
    """Policy documents, one element per line, with what `derive` names."""
    return parsing.line_elements(policy_documents(spark, sf_dir, with_english=False, sep="\n"), out=None, derive=derive)


def lines_of(spark, sf_dir):
    return tree.typed_lines(_parsed(spark, sf_dir, tree.TYPED_LINES))


def nodes_of(spark, sf_dir):
    return tree.tree_nodes(_parsed(spark, sf_dir, tree.TREE), base=F.array(F.lit("制度")))


# Node lines of the derived documents with position, type and parents.
NODES_CTE = LINES_CTE + """,
    pos AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY sec, c, i, j) AS pos,
              CASE WHEN c = 0 AND j = 0 THEN 'major_section' WHEN sec = 2 AND i = 0 AND j = 0 THEN 'violation_level' WHEN sec = 2 AND i > 0 AND j = 0 THEN 'violation_group'
                   WHEN sec = 2 AND i > 0 THEN 'leaf_clause' WHEN sec = 3 AND j = 1 THEN 'action_group' WHEN sec = 3 AND j BETWEEN 2 AND 4 THEN 'action_mapping' END AS node_type FROM lines),
    num AS (SELECT *, count(node_type) OVER (PARTITION BY k ORDER BY pos) AS node_no FROM pos),
    nodes AS (
      SELECT a.k, a.pos, a.line, a.node_type, a.node_no, a.sec, a.c, a.i, a.j, a.g,
             CASE a.node_type WHEN 'violation_level' THEN (SELECT p.node_no FROM num p WHERE p.k = a.k AND p.sec = a.sec AND p.c = 0 AND p.j = 0)
                WHEN 'violation_group' THEN (SELECT p.node_no FROM num p WHERE p.k = a.k AND p.sec = 2 AND p.c = a.c AND p.i = 0 AND p.j = 0)
                WHEN 'leaf_clause' THEN (SELECT p.node_no FROM num p WHERE p.k = a.k AND p.sec = 2 AND p.c = a.c AND p.i = a.i AND p.j = 0)
                WHEN 'action_group' THEN (SELECT p.node_no FROM num p WHERE p.k = a.k AND p.sec = 3 AND p.j = 0)
                WHEN 'action_mapping' THEN (SELECT p.node_no FROM num p WHERE p.k = a.k AND p.sec = 3 AND p.j = 1) END AS parent_no
      FROM num a WHERE a.node_type IS NOT NULL)
"""
NODE_ID = "k || ':node-' || printf('%04d', {})"


@query("d1_line_types", f"WITH {NODES_CTE} SELECT k AS doc_id, pos, coalesce(node_type, 'text') AS node_type FROM pos")
def d1_line_types(spark, sf_dir):
    return lines_of(spark, sf_dir).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), F.coalesce("node_type", F.lit("text")).alias("node_type")
    )


@query(
    "d2_open_sections",
    f"""WITH {NODES_CTE} SELECT k AS doc_id, pos,
        last_value(CASE WHEN node_type = 'major_section' THEN pos END IGNORE NULLS) OVER w AS major_pos,
        CASE WHEN sec = 2 AND c > 0 THEN last_value(CASE WHEN node_type = 'violation_level' THEN pos END IGNORE NULLS) OVER w END AS level_pos,
        CASE WHEN sec = 2 AND i > 0 THEN last_value(CASE WHEN node_type = 'violation_group' THEN pos END IGNORE NULLS) OVER w END AS group_pos,
        CASE WHEN sec = 3 AND j > 0 THEN last_value(CASE WHEN node_type = 'action_group' THEN pos END IGNORE NULLS) OVER w END AS action_group_pos
        FROM pos WINDOW w AS (PARTITION BY k ORDER BY pos ROWS UNBOUNDED PRECEDING)""",
)
def d2_open_sections(spark, sf_dir):
    at = lambda s, n: F.col(f"{s}.pos").cast("bigint").alias(n)
    return lines_of(spark, sf_dir).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), at("major", "major_pos"), at("lvl", "level_pos"), at("grp", "group_pos"), at("agrp", "action_group_pos")
    )


@query(
    "d3_node_text",
    f"""WITH {NODES_CTE},
        own AS (SELECT k, pos, line, CASE WHEN sec <> 2 AND sec <> 3 THEN (SELECT min(p.pos) FROM pos p WHERE p.k = a.k AND p.sec = a.sec)
                  WHEN sec = 3 AND j = 0 THEN pos WHEN sec = 3 AND j IN (2, 3, 4) THEN pos WHEN sec = 3 THEN (SELECT p.pos FROM pos p WHERE p.k = a.k AND p.sec = 3 AND p.j = 1)
                  WHEN node_type IS NOT NULL THEN pos WHEN i = 0 THEN (SELECT p.pos FROM pos p WHERE p.k = a.k AND p.sec = 2 AND p.c = a.c AND p.i = 0 AND p.j = 0) END AS owner FROM pos a
                UNION ALL SELECT k, pos, line, (SELECT p.pos FROM pos p WHERE p.k = a.k AND p.sec = 2 AND p.c = a.c AND p.i = a.i AND p.j = 0) FROM pos a WHERE node_type = 'leaf_clause'
                UNION ALL SELECT k, pos, line, (SELECT p.pos FROM pos p WHERE p.k = a.k AND p.sec = 3 AND p.j = 1) FROM pos a WHERE node_type = 'action_mapping')
        SELECT k AS doc_id, owner AS sort_order, string_agg(line, ' ' ORDER BY pos) AS text, count(*) AS element_count FROM own GROUP BY k, owner""",
)
def d3_node_text(spark, sf_dir):
    return nodes_of(spark, sf_dir).select(
        "doc_id", F.col("sort_order").cast("bigint").alias("sort_order"), "text", F.size("element_ids").cast("bigint").alias("element_count")
    )


@query(
    "d4_node_identity",
    f"""WITH {NODES_CTE} SELECT k AS doc_id, {NODE_ID.format('node_no')} AS node_id, CASE WHEN parent_no IS NOT NULL THEN {NODE_ID.format('parent_no')} END AS parent_id,
        CAST(CASE node_type WHEN 'major_section' THEN 1 WHEN 'violation_level' THEN 2 WHEN 'action_group' THEN 2 WHEN 'leaf_clause' THEN 4 ELSE 3 END AS BIGINT) AS level,
        CASE node_type WHEN 'major_section' THEN '制度 > ' || line
          WHEN 'violation_level' THEN '制度 > ' || substr(line, 4)
          WHEN 'violation_group' THEN '制度 > ' || (SELECT substr(p.line, 4) FROM pos p WHERE p.k = n.k AND p.sec = 2 AND p.c = n.c AND p.i = 0 AND p.j = 0) || ' > ' || line
          WHEN 'leaf_clause' THEN '制度 > ' || (SELECT substr(p.line, 4) FROM pos p WHERE p.k = n.k AND p.sec = 2 AND p.c = n.c AND p.i = 0 AND p.j = 0) || ' > ' ||
               (SELECT p.line FROM pos p WHERE p.k = n.k AND p.sec = 2 AND p.c = n.c AND p.i = n.i AND p.j = 0) || ' > ' || line
          WHEN 'action_group' THEN '制度 > 五、违规行为相应处理 > ' || line
          ELSE '制度 > 五、违规行为相应处理 > 1. 处理方式 > ' || substr(line, 1, 3) || ' ' || substr(line, 4, 6) END AS heading_path
        FROM nodes n""",
)
def d4_node_identity(spark, sf_dir):
    return nodes_of(spark, sf_dir).select(
        "doc_id", "node_id", "parent_id", F.col("level").cast("bigint").alias("level"), F.array_join("heading_path", " > ").alias("heading_path")
    )


@query("d5_action_sections", f"WITH {NODES_CTE} SELECT k AS doc_id, line AS title, sec = 3 AS is_action FROM nodes WHERE node_type = 'major_section'")
def d5_action_sections(spark, sf_dir):
    n = nodes_of(spark, sf_dir).filter("node_type = 'major_section'")
    return n.select("doc_id", F.concat("ordinal_label", "title").alias("title"), tree.is_action_section(F.col("title")).alias("is_action"))


@query(
    "d6_children",
    f"""WITH {NODES_CTE} SELECT k AS doc_id, {NODE_ID.format('parent_no')} AS node_id, string_agg(line, ' | ' ORDER BY pos) AS children
        FROM nodes WHERE node_type = 'violation_group' GROUP BY k, parent_no""",
)
def d6_children(spark, sf_dir):
    kids = tree.children_of(nodes_of(spark, sf_dir), "violation_group")
    return kids.select("doc_id", "node_id", F.array_join(F.transform("kids", lambda c: F.concat_ws(" ", c["ordinal_label"], c["title"])), " | ").alias("children"))


@query("d6_find_first", f"WITH {NODES_CTE} SELECT k AS doc_id, {NODE_ID.format('node_no')} AS node_id FROM nodes WHERE node_type = 'violation_level' AND c = 2")
def d6_find_first(spark, sf_dir):
    return tree.find_first(nodes_of(spark, sf_dir), "violation_level", " 二类违规行为：").select("doc_id", "node_id")


_ORD = """
    c AS (SELECT l_orderkey AS parent, l_linenumber AS ordinal, count(*) AS n FROM lineitem GROUP BY ALL),
    p AS (SELECT parent, CAST(sum(n) AS BIGINT) AS child_count, count(*) AS distinct_count, CAST(min(ordinal) AS BIGINT) AS lo, CAST(max(ordinal) AS BIGINT) AS hi, count(*) FILTER (n > 1) AS duplicate_count FROM c GROUP BY parent),
    q AS (SELECT *, CASE WHEN distinct_count >= 2 THEN hi - lo + 1 - distinct_count ELSE 0 END AS missing_count FROM p),
    gone AS (SELECT parent, ordinal FROM (SELECT parent, unnest(generate_series(lo, hi)) AS ordinal FROM q WHERE distinct_count >= 2) s
             WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.parent = s.parent AND c.ordinal = s.ordinal))
"""


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")


@query(
    "d7_ordinal_continuity",
    f"""WITH {_ORD} SELECT parent, child_count, distinct_count, duplicate_count, missing_count,
        CASE WHEN missing_count = 0 AND duplicate_count = 0 THEN 'complete' ELSE 'incomplete' END AS status FROM q""",
)
def d7_ordinal_continuity(spark, sf_dir):
    return tree.ordinal_continuity(_lines(spark, sf_dir), "l_orderkey", "l_linenumber").drop("first_ordinal", "last_ordinal")


@query("d7_missing_ordinals", f"WITH {_ORD} SELECT parent, ordinal FROM gone")
def d7_missing_ordinals(spark, sf_dir):
    return tree.missing_ordinals(_lines(spark, sf_dir), "l_orderkey", "l_linenumber")


@query(
    "d8_ordinal_issues",
    f"""WITH {_ORD} SELECT parent, 'duplicate_ordinal' AS code, 'error' AS severity, CAST(ordinal AS BIGINT) AS ordinal FROM c WHERE n > 1
        UNION ALL SELECT parent, 'missing_ordinal', 'warning', ordinal FROM gone""",
)
def d8_ordinal_issues(spark, sf_dir):
    return tree.ordinal_issues(_lines(spark, sf_dir), "l_orderkey", "l_linenumber")


@query(
    "d9_prefix_mismatch",
    f"""WITH {NODES_CTE} SELECT k AS doc_id, {NODE_ID.format('node_no')} AS node_id, (g + 1) || '.' || j AS ordinal_label, g || '.' AS parent_ordinal
        FROM nodes WHERE node_type = 'leaf_clause' AND k % 11 = 0""",
)
def d9_prefix_mismatch(spark, sf_dir):
    return tree.prefix_mismatches(nodes_of(spark, sf_dir)).select("doc_id", "node_id", "ordinal_label", "parent_ordinal")


@query(
    "d10_structure_status",
    f"""WITH {_ORD}, n AS (SELECT parent, sum(n) AS nodes FROM c GROUP BY parent),
        i AS (SELECT parent, sum(x) AS issues, sum(w) AS warnings FROM (SELECT parent, 1 AS x, 0 AS w FROM c WHERE n > 1 UNION ALL SELECT parent, 1, 1 FROM gone) GROUP BY parent)
        SELECT o_orderkey AS parent, CAST(coalesce(nodes, 0) AS BIGINT) AS node_count, CAST(coalesce(issues, 0) AS BIGINT) AS issue_count, CAST(coalesce(warnings, 0) AS BIGINT) AS warning_count,
               CASE WHEN nodes IS NULL THEN 'failed' WHEN issues IS NULL THEN 'success' ELSE 'partial' END AS status
        FROM orders LEFT JOIN n ON n.parent = o_orderkey LEFT JOIN i ON i.parent = o_orderkey""",
)
def d10_structure_status(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("parent"))
    nodes = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("parent"))
    return tree.structure_status(orders, nodes, tree.ordinal_issues(_lines(spark, sf_dir), "l_orderkey", "l_linenumber"), "parent")


@query(
    "d11_section_definition",
    f"""WITH {LINES_CTE} SELECT k AS doc_id, n || '类违规行为' AS section_title, '（' || n || '）' || n || '类违规行为 ' || n || '类违规行为：指性质严重的行为。' AS text, 'category_' || c AS violation_level
        FROM docs, lev""",
)
def d11_section_definition(spark, sf_dir):
    c = tree.tree_chunks(_parsed(spark, sf_dir, tree.chunks_of()), base=F.array(F.lit("制度"))).filter("chunk_type = 'section_definition'")
    return c.select("doc_id", "section_title", "text", "violation_level")


@query(
    "d12_section_children",
    f"""WITH {LINES_CTE} SELECT k AS doc_id, n || '类违规行为' AS section_title,
        n || '类违规行为 ' || string_agg(g || '. ' || seg || '条款' || letter || '行为', ' ' ORDER BY i) AS text, count(*) AS child_count,
        string_agg(g || '.', ',' ORDER BY i) AS ordinal_sequence, CASE WHEN k % 5 = 0 THEN '2' ELSE '' END AS missing_ordinals,
        CASE WHEN k % 5 <> 0 AND k % 7 = 0 THEN '1' ELSE '' END AS duplicate_ordinals, CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN 'incomplete' ELSE 'complete' END AS continuity
        FROM ords GROUP BY k, c, n""",
)
def d12_section_children(spark, sf_dir):
    c = tree.section_children(nodes_of(spark, sf_dir))
    return c.select(
        "doc_id", "section_title", "text", F.col("child_count").cast("bigint").alias("child_count"), F.array_join("ordinal_sequence", ",").alias("ordinal_sequence"),
        F.array_join(F.col("missing_ordinals").cast("array<string>"), ",").alias("missing_ordinals"),
        F.array_join(F.col("duplicate_ordinals").cast("array<string>"), ",").alias("duplicate_ordinals"), F.col("ordinal_continuity_status").alias("continuity"),
    )


@query(
    "d13_leaf_and_mapping",
    f"""WITH {LINES_CTE} SELECT k AS doc_id, 'leaf_clause' AS chunk_type, (g + shift) || '.' || s.j || ' ' || s.t AS text, 'violation_group' AS parent_node_type, seg || '条款' || letter || '行为' AS parent_title, 'category_' || c AS violation_level
        FROM ords, (VALUES (1, '情形一。'), (2, '情形二。')) s(j, t)
        UNION ALL SELECT k, 'action_mapping', v.t, 'action_group', '处理方式', v.lv FROM docs, (VALUES ('1.1一类违规行为：解除劳动合同。', 'category_1'), ('1.2二类违规行为：予以记过处分。', 'category_2'), ('1.3三类违规行为：予以警告。', 'category_3')) v(t, lv)""",
)
def d13_leaf_and_mapping(spark, sf_dir):
    c = tree.tree_chunks(_parsed(spark, sf_dir, tree.chunks_of()), base=F.array(F.lit("制度"))).filter(F.col("chunk_type").isin("leaf_clause", "action_mapping"))
    return c.select("doc_id", "chunk_type", "text", "parent_node_type", "parent_title", "violation_level")


@query("d14_ordinals", "SELECT c_custkey AS doc_id, CAST(c_custkey % 99 + 1 AS BIGINT) AS ordinal_value, CAST(c_custkey % 7 + 1 AS BIGINT) AS last_part FROM customer")
def d14_ordinals(spark, sf_dir):
    n = F.col("c_custkey") % 99 + 1
    digit = lambda i: F.element_at(F.array(*[F.lit(c) for c in "一二三四五六七八九"]), i.cast("int"))
    tens = F.when(n < 10, F.lit("")).when(n < 20, F.lit("十")).otherwise(F.concat(digit(F.floor(F.greatest(n, F.lit(10)) / 10)), F.lit("十")))
    ones = F.when(n % 10 == 0, F.lit("")).otherwise(digit(F.greatest(n % 10, F.lit(1))))
    label = F.concat(F.lit("（"), tens, ones, F.lit("）"))
    return texts(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("doc_id"), tree.ordinal_value(label).cast("bigint").alias("ordinal_value"),
        tree.ordinal_value(F.concat(F.lit("3."), (F.col("c_custkey") % 7 + 1).cast("string"))).cast("bigint").alias("last_part"),
    )
