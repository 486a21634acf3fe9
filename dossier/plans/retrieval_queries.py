"""Queries over candidate search."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.operators import retrieval
from dossier.plans.registry import query, table, texts


def centroids(spark, sf_dir):
    """One request per label: the mean of its vectors."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("query_vec")).withColumnRenamed("label", "query_id")


_CENTROIDS = """
    parts AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    mean AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM parts GROUP BY ALL),
    req AS (SELECT label AS query_id, list(m ORDER BY i) AS qv FROM mean GROUP BY label),
    vecs AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings)
"""


@query(
    "h1_dense_top_k",
    f"""WITH {_CENTROIDS}, d AS (SELECT query_id, vec_id, list_cosine_distance(v, qv) AS distance FROM req, vecs)
        SELECT query_id, vec_id AS chunk_id, round(distance, 6) AS distance, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), vec_id) AS rank FROM d) WHERE rank <= 5""",
)
def h1_dense_top_k(spark, sf_dir):
    out = retrieval.dense_top_k(centroids(spark, sf_dir), table(spark, sf_dir, "embeddings"), 5, "vec_id", "embedding")
    return out.select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


@query(
    "h2_zero_vectors",
    f"""WITH {_CENTROIDS}, z AS (SELECT e.vec_id, CASE WHEN e.label = 0 THEN [0.0 FOR x IN v] ELSE v END AS v FROM embeddings e JOIN vecs USING (vec_id)),
        rz AS (SELECT query_id, CASE WHEN query_id = 0 THEN [0.0 FOR x IN qv] ELSE qv END AS qv FROM req),
        d AS (SELECT query_id, vec_id, CASE WHEN list_sum([x * x FOR x IN v]) = 0 OR list_sum([x * x FOR x IN qv]) = 0 THEN 1.0 ELSE list_cosine_distance(v, qv) END AS distance FROM rz, z)
        SELECT query_id, vec_id AS chunk_id, round(distance, 6) AS distance, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), vec_id) AS rank FROM d) WHERE rank <= 5""",
)
def h2_zero_vectors(spark, sf_dir):
    zero = lambda v: F.transform(v, lambda x: x.cast("double") * 0.0)
    q = centroids(spark, sf_dir)
    q = q.withColumn("query_vec", F.when(F.col("query_id") == 0, zero("query_vec")).otherwise(F.col("query_vec")))
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("label") == 0, zero("embedding")).otherwise(doubles).alias("embedding"))
    out = retrieval.dense_top_k(q, e, 5, "vec_id", "embedding")
    return out.select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


# Requests of the keyword queries: parameters, one per label id.
REQUESTS = (
    (0, ("tion", "Ing_s"), ("en",), "which tion holds"), (1, ("ment", "que"), ("fr",), "que ment"), (2, (), ("src3",), "the src3"),
    (3, ("UNG", "sch"), (), "sch ung"), (4, ("ción",), ("es", "src1"), "ción"), (5, (), (), "a b"), (6, ("of the",), (), "is of"),
    (7, ("e%z",), (), "zz"), (8, ("License", "copyright"), ("src7",), "license?"), (9, ("@",), ("de",), "mail"),
)


def requests(spark, sf_dir):
    arr = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>") if xs else F.array().cast("array<string>")
    terms = F.array(*[F.struct(F.lit(i).alias("id"), arr(p).alias("p"), arr(s).alias("s"), F.lit(t).alias("t")) for i, p, s, t in REQUESTS])
    d = centroids(spark, sf_dir).withColumn("r", F.get(F.filter(terms, lambda r: r["id"] == F.col("query_id")), F.lit(0)))
    return d.select("query_id", "query_vec", F.col("r.p").alias("primary_terms"), F.col("r.s").alias("secondary_terms"), retrieval.query_tokens(F.col("r.t")).alias("query_terms"))


def _sql_list(xs):
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"


_REQ_VALUES = ", ".join(
    f"({i}, {_sql_list(p)}, {_sql_list(s)}, {_sql_list([t for t in dict.fromkeys(x.replace('?', ' ').split()) if len(t) >= 2])})" for i, p, s, x in REQUESTS
)
_ANY = lambda field, arr: f"len(list_filter({arr}, lambda t: {field} ILIKE '%' || t || '%')) > 0"
_KEYWORD = f"""
    asked AS (SELECT * FROM (VALUES {_REQ_VALUES}) v(query_id, p, s, q)),
    hit AS (SELECT a.query_id, d.doc_id,
              CASE WHEN {_ANY('d.text', 'p')} THEN 8.0 ELSE 0 END + CASE WHEN {_ANY('d.source', 'p')} THEN 5.0 ELSE 0 END + CASE WHEN {_ANY('d.lang', 'p')} THEN 3.0 ELSE 0 END
              + CASE WHEN {_ANY('d.text', 's')} THEN 2.0 ELSE 0 END + CASE WHEN {_ANY('d.source', 's')} THEN 2.0 ELSE 0 END + CASE WHEN {_ANY('d.lang', 's')} THEN 1.5 ELSE 0 END
              + CASE WHEN {_ANY('d.text', 'q')} THEN 1.0 ELSE 0 END AS score,
              {' OR '.join(_ANY(f, g) for f in ('d.text', 'd.source', 'd.lang') for g in 'psq')} AS touched
            FROM asked a, documents d),
    kw AS (SELECT query_id, doc_id, CAST(score AS DOUBLE) AS keyword_score FROM hit WHERE touched)
"""


def _docs(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")


@query("h4_keyword_score", f"WITH {_KEYWORD} SELECT CAST(query_id AS INT) AS query_id, doc_id AS chunk_id, keyword_score FROM kw")
def h4_keyword_score(spark, sf_dir):
    return retrieval.keyword_hits(requests(spark, sf_dir), _docs(spark, sf_dir), "doc_id", "text", "source", "lang")


@query(
    "h4_keyword_top_k",
    f"""WITH {_KEYWORD} SELECT CAST(query_id AS INT) AS query_id, doc_id AS chunk_id, keyword_score, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY keyword_score DESC, doc_id) AS rank FROM kw) WHERE rank <= 20""",
)
def h4_keyword_top_k(spark, sf_dir):
    out = retrieval.keyword_hits(requests(spark, sf_dir), _docs(spark, sf_dir), "doc_id", "text", "source", "lang", best=20)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "h5_hybrid_top_k",
    f"""WITH {_CENTROIDS}, {_KEYWORD},
        live AS (SELECT v.* FROM vecs v WHERE vec_id IN (SELECT doc_id FROM documents)),
        dist AS (SELECT query_id, vec_id, round(list_cosine_distance(v, qv), 12) AS distance FROM req, live),
        dense AS (SELECT query_id, vec_id, 0.0::DOUBLE AS keyword_score, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rn FROM dist) WHERE rn <= 10),
        keyword AS (SELECT query_id, vec_id, keyword_score, distance FROM (
            SELECT d.query_id, d.vec_id, k.keyword_score, d.distance, row_number() OVER (PARTITION BY d.query_id ORDER BY k.keyword_score DESC, d.distance, d.vec_id) AS rn
            FROM dist d JOIN kw k ON d.query_id = k.query_id AND d.vec_id = k.doc_id) WHERE rn <= 20),
        merged AS (SELECT query_id, vec_id, max(keyword_score) AS keyword_score, min(distance) AS distance FROM (SELECT * FROM dense UNION ALL SELECT * FROM keyword) GROUP BY ALL)
        SELECT query_id, chunk_id, keyword_score, distance, rank FROM (
          SELECT query_id, vec_id AS chunk_id, keyword_score, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY keyword_score DESC, distance, vec_id) AS rank FROM merged) WHERE rank <= 5""",
)
def h5_hybrid_top_k(spark, sf_dir):
    out = retrieval.hybrid_top_k(
        requests(spark, sf_dir), _docs(spark, sf_dir), table(spark, sf_dir, "embeddings"), 5, "doc_id", "text", "source", "lang", "vec_id", "embedding"
    )
    return out.select("query_id", "chunk_id", "keyword_score", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


@query(
    "h6_lexical_overlap",
    r"""WITH p AS (SELECT d.doc_id, lower(translate(d.text, '？?', '  ')) AS a, lower(translate(b.text, '？?', '  ')) AS b FROM documents d JOIN benchmark b ON d.doc_id % 40 = b.item_id),
        t AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(a, '\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split_regex(b, '\s+'), lambda x: x <> '')) AS b FROM p)
        SELECT doc_id, CAST(len(list_intersect(a, b)) AS BIGINT) AS overlap FROM t""",
)
def h6_lexical_overlap(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    d = texts(spark, sf_dir, "documents").withColumn("item_id", F.col("doc_id") % 40).join(b, "item_id")
    return d.select("doc_id", retrieval.lexical_overlap(F.col("text"), F.col("question")).cast("bigint").alias("overlap"))
