"""Policy-shaped texts that Spark derives from the given tables, with the same rule in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.plans.registry import texts

LEVELS = (("一", "甲"), ("二", "乙"), ("三", "丙"))


def _ordinals(k, c):
    """Group numbers of level c: with a gap, with a duplicate, or 1..n."""
    return (
        F.when(k % 5 == 0, F.array(F.lit(1), F.lit(3)).cast("array<bigint>"))
        .when(k % 7 == 0, F.array(F.lit(1), F.lit(1)).cast("array<bigint>"))
        .otherwise(F.sequence(F.lit(1).cast("bigint"), 2 + (k + c) % 2))
    )


def _group_lines(ordinals, title, shift):
    return F.flatten(
        F.transform(
            ordinals,
            lambda g: F.array(
                F.concat(g.cast("string"), F.lit(". "), title),
                F.concat((g + shift).cast("string"), F.lit(".1 情形一。")),
                F.concat((g + shift).cast("string"), F.lit(".2 情形二。")),
            ),
        )
    )


def policy_lines(with_english: bool = True):
    """Lines of one policy document per customer row."""
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    shift = F.when(k % 11 == 0, 1).otherwise(0)
    lit = lambda *xs: F.array(*[F.lit(x) for x in xs])
    parts = [lit("一、总则"), F.array(F.concat(F.lit("本制度适用于"), seg, F.lit("部门。"))), lit("四、违规行为")]
    for c, (n, letter) in enumerate(LEVELS, start=1):
        parts.append(lit(f"（{n}）{n}类违规行为", f"{n}类违规行为：指性质严重的行为。"))
        parts.append(_group_lines(_ordinals(k, c), F.concat(seg, F.lit(f"条款{letter}行为")), shift))
    parts.append(
        lit("五、违规行为相应处理", "1. 处理方式", "1.1一类违规行为：解除劳动合同。", "1.2二类违规行为：予以记过处分。",
            "1.3三类违规行为：予以警告。", "1.4其他情形另行处理。", "九、附件", "附件内容。")
    )
    if with_english:
        parts.append(
            F.array(
                F.lit("Employee Disciplinary Rules"), F.lit("I. Purpose"), F.concat(F.lit("To keep order in "), seg, F.lit(".")),
                F.lit("IV. Violations"), F.lit("(I) Category 1 Violation"), F.lit("Serious matters."),
                F.lit("1. Ethics conduct: 1.1 First item. 1.2 Second item."), F.lit("(II) Category 2 Violation"),
                F.lit("Other matters."), F.lit("1. Order conduct: 1.1 Third item."),
                F.lit("V. Applicable Disciplinary Actions against Violations"), F.lit("1.1 Category 1 Violation: dismissal."),
                F.lit("1.2 Other cases: warning."),
            )
        )
    return F.concat(*parts)


def policy_documents(spark, sf_dir, with_english: bool = True, sep: str = " "):
    """doc_id, source_name, text: one policy document per customer."""
    return texts(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("source_name"),
        F.array_join(policy_lines(with_english), sep).alias("text"),
    )


# The same lines as rows: sec, c (level), i (group position), j (line in group).
LINES_CTE = """
    docs AS (SELECT c_custkey AS k, c_mktsegment AS seg, c_name AS name, CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS shift FROM customer),
    lev AS (SELECT * FROM (VALUES (1, '一', '甲'), (2, '二', '乙'), (3, '三', '丙')) v(c, n, letter)),
    ords AS (SELECT k, seg, name, shift, c, n, letter,
                    unnest(CASE WHEN k % 5 = 0 THEN [1, 3] WHEN k % 7 = 0 THEN [1, 1] ELSE generate_series(1, 2 + (k + c) % 2) END) AS g,
                    generate_subscripts(CASE WHEN k % 5 = 0 THEN [1, 3] WHEN k % 7 = 0 THEN [1, 1] ELSE generate_series(1, 2 + (k + c) % 2) END, 1) AS i
             FROM docs, lev),
    lines AS (
      SELECT k, name, 1 AS sec, 0 AS c, 0 AS i, 0 AS j, NULL::BIGINT AS g, '一、总则' AS line FROM docs
      UNION ALL SELECT k, name, 1, 0, 0, 1, NULL, '本制度适用于' || seg || '部门。' FROM docs
      UNION ALL SELECT k, name, 2, 0, 0, 0, NULL, '四、违规行为' FROM docs
      UNION ALL SELECT k, name, 2, c, 0, 0, NULL, '（' || n || '）' || n || '类违规行为' FROM docs, lev
      UNION ALL SELECT k, name, 2, c, 0, 1, NULL, n || '类违规行为：指性质严重的行为。' FROM docs, lev
      UNION ALL SELECT k, name, 2, c, i, 0, g, g || '. ' || seg || '条款' || letter || '行为' FROM ords
      UNION ALL SELECT k, name, 2, c, i, 1, g, (g + shift) || '.1 情形一。' FROM ords
      UNION ALL SELECT k, name, 2, c, i, 2, g, (g + shift) || '.2 情形二。' FROM ords
      UNION ALL SELECT k, name, 3, 0, 0, a.j, NULL, a.line FROM docs, (VALUES (0, '五、违规行为相应处理'), (1, '1. 处理方式'),
          (2, '1.1一类违规行为：解除劳动合同。'), (3, '1.2二类违规行为：予以记过处分。'), (4, '1.3三类违规行为：予以警告。'), (5, '1.4其他情形另行处理。')) a(j, line)
      UNION ALL SELECT k, name, 4, 0, 0, a.j, NULL, a.line FROM docs, (VALUES (0, '九、附件'), (1, '附件内容。')) a(j, line))
"""
