"""Queries over text features and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.functions.text import BLANKS
from dossier.functions.vectors import unit
from dossier.operators import features
from dossier.plans.registry import query, table, texts

FEATURES = (("articles", ("the", "of", "and")), ("romance", ("le", "la", "que")), ("endings", ("tion", "ment", "ing")))
_COMPACT = f"lower(regexp_replace(text, '[{BLANKS}]+', '', 'g'))"
_F = {n: " + ".join(f"(length(t) - length(replace(t, '{x}', '')))" for x in xs) for n, xs in FEATURES}


@query(
    "f1_term_features",
    f"WITH d AS (SELECT doc_id, {_COMPACT} AS t FROM documents) SELECT doc_id, " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in _F.items()) + " FROM d",
)
def f1_term_features(spark, sf_dir):
    v = features.term_features(features.compact(F.col("text")), FEATURES)
    return texts(spark, sf_dir, "documents").select("doc_id", *[v[i].alias(n) for i, (n, _) in enumerate(FEATURES)])


_BUCKETS = f"""
    d AS (SELECT doc_id, {_COMPACT} AS t FROM documents),
    ch AS (SELECT doc_id, unnest(string_split(t, '')) AS c FROM d),
    b AS (SELECT doc_id, unicode(c) % 8 AS b, count(*) AS n FROM ch WHERE c <> '' GROUP BY ALL)
"""


@query("f2_char_buckets", f"WITH {_BUCKETS} SELECT doc_id, CAST(b AS BIGINT) AS bucket, n, round(n * CAST(0.15 AS DOUBLE), 6) AS weight FROM b")
def f2_char_buckets(spark, sf_dir):
    n = features.bucket_counts(features.compact(F.col("text")), "code_point")
    d = texts(spark, sf_dir, "documents").select("doc_id", F.posexplode(n).alias("bucket", "n")).filter("n > 0")
    return d.select("doc_id", F.col("bucket").cast("bigint").alias("bucket"), "n", F.round(F.col("n") * 0.15, 6).alias("weight"))


# Bucket of every letter, sign and space below U+0600, by the rule of the operator, as rows; the tables have no other characters.
_BLAKE = ", ".join(f"({code}, {features._blake_bucket(code)})" for code in range(0x20, 0x600))
_TERMS = ", ".join(f"(SELECT {' + '.join(f'length(t) - length(replace(t, {chr(39)}{w.lower()}{chr(39)}, {chr(39)}{chr(39)}))' for w in terms)})" for _, terms in features.TERM_FEATURES)


@query(
    "f2_blake_embedding",
    f"""WITH blake(code, b) AS (VALUES {_BLAKE}), d AS (SELECT doc_id, {_COMPACT} AS t FROM documents), ch AS (SELECT doc_id, unicode(unnest(string_split(t, ''))) AS code FROM d WHERE t <> ''),
        n AS (SELECT doc_id, b, count(*) AS n FROM ch JOIN blake USING (code) GROUP BY ALL),
        v AS (SELECT d.doc_id, list_concat(any_value([CAST(x AS DOUBLE) FOR x IN [{_TERMS}]]), [{', '.join(f'coalesce(max(n) FILTER (b = {i}), 0) * CAST(0.15 AS DOUBLE)' for i in range(features.BUCKETS))}]) AS v FROM d LEFT JOIN n USING (doc_id) GROUP BY d.doc_id),
        z AS (SELECT doc_id, v, sqrt(list_sum([x * x FOR x IN v])) AS z FROM v)
        SELECT doc_id, array_to_string([printf('%.6f', CASE WHEN z = 0 THEN x ELSE round(x / z, 8) END) FOR x IN v], ',') AS embedding FROM z""",
)
def f2_blake_embedding(spark, sf_dir):
    d = features.embed(texts(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return d.select("doc_id", F.array_join(F.transform("embedding", lambda x: F.format_number(x, 6)), ",").alias("embedding"))


@query(
    "f3_unit_vectors",
    """WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) * (vec_id % 3) FOR x IN embedding] AS e FROM embeddings),
       n AS (SELECT vec_id, e, sqrt(list_sum([x * x FOR x IN e])) AS n FROM v)
       SELECT vec_id, round(CASE WHEN n = 0 THEN 0 ELSE list_sum([round(x / n, 8) * round(x / n, 8) FOR x IN e]) END, 5) AS squared_norm,
              round(CASE WHEN n = 0 THEN e[1] ELSE round(e[1] / n, 8) END, 6) AS first_value FROM n""",
)
def f3_unit_vectors(spark, sf_dir):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 3))
    d = table(spark, sf_dir, "embeddings").select("vec_id", unit(scaled).alias("u"))
    sq = F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x)
    return d.select("vec_id", F.round(sq, 5).alias("squared_norm"), F.round(F.get("u", F.lit(0)), 6).alias("first_value"))


@query("f4_input_type", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'query' ELSE 'document' END AS input_type FROM conversations")
def f4_input_type(spark, sf_dir):
    kind = F.when(F.col("role") == "user", "query").otherwise("document")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", features.checked_input_type(kind).alias("input_type"))


@query(
    "f5_token_table",
    """SELECT doc_id, CAST(length(text) AS BIGINT) AS token_count, CAST(i - 1 AS BIGINT) AS token_index, substr(text, i, 1) AS token, CAST(unicode(substr(text, i, 1)) AS BIGINT) AS token_id
       FROM documents, LATERAL (SELECT unnest(generate_series(1, least(128, length(text)))) AS i)""",
)
def f5_token_table(spark, sf_dir):
    t = features.token_table(texts(spark, sf_dir, "documents"), ["doc_id"], "text")
    return t.select("doc_id", F.col("token_count").cast("bigint").alias("token_count"), F.col("token_index").cast("bigint").alias("token_index"), "token",
                    F.col("token_id").cast("bigint").alias("token_id"))
