import numpy as np
from pyspark.sql import functions as F

from dossier.operators import features, retrieval


def vectors(spark, n, dim, seed):
    m = np.random.default_rng(seed).normal(size=(n, dim))
    m[1] = 0
    return m, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<double>")


def test_dense_top_k_equals_brute_force_and_block_path(spark, monkeypatch):
    c, corpus = vectors(spark, 200, 8, 1)
    q, asked = vectors(spark, 30, 8, 2)
    asked = asked.select(F.col("id").alias("query_id"), F.col("v").alias("query_vec"))
    n = np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1))
    d = np.where(n == 0, 1.0, 1 - (q @ c.T) / np.where(n == 0, 1, n)).round(12)
    want = {(i, int(j)) for i in range(30) for j in np.lexsort((np.arange(200), d[i]))[:4]}
    for block in (2000, 10):
        monkeypatch.setattr(retrieval, "BLOCK_REQUESTS", block)
        monkeypatch.setattr(retrieval, "BLOCK_VECTORS", 3 * block)
        got = {(r.query_id, r.chunk_id) for r in retrieval.dense_top_k(asked, corpus.repartition(5), 4, "id", "v").collect()}
        assert got == want


def brute_hybrid(q, c, terms, texts, k):
    """Candidates by plain loops: 2k by distance, 4k by score, then distance, then id."""
    n = np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1))
    d = np.where(n == 0, 1.0, 1 - (q @ c.T) / np.where(n == 0, 1, n)).round(12)
    out = set()
    for i, (first, second, third) in enumerate(terms):
        near = sorted(range(len(c)), key=lambda j: (d[i, j], j))[: 2 * k]
        scores = {}
        for j, fields in enumerate(texts):
            s, touched = 0.0, False
            for f, value in enumerate(fields):
                hit = [any(t.lower() in (value or "").lower() for t in ts) for ts in (first, second, third)]
                s += retrieval.PRIMARY[f] * hit[0] + retrieval.SECONDARY[f] * hit[1] + (retrieval.QUERY_ON_TEXT * hit[2] if f == 0 else 0)
                touched |= any(hit)
            if touched:
                scores[j] = s
        named = sorted(scores, key=lambda j: (-scores[j], d[i, j], j))[: 4 * k]
        merged = {j: 0.0 for j in near} | {j: scores[j] for j in named}
        best = sorted(merged, key=lambda j: (-merged[j], d[i, j], j))[:k]
        out |= {(i, j, merged[j], r) for r, j in enumerate(best, 1)}
    return out


def hybrid_input(spark, n_requests=25, n_chunks=150):
    r = np.random.default_rng(5)
    q, c = r.normal(size=(n_requests, 6)).round(1), r.normal(size=(n_chunks, 6)).round(1)
    c[3], q[2] = 0, 0
    words = "apple pear plum fig date lime".split()
    pick = lambda n: [str(x) for x in r.choice(words, n)]
    terms = [(pick(i % 3), pick(i % 2), pick(1)) if i % 5 else ([], [], []) for i in range(n_requests)]
    texts = [(" ".join(pick(3)) if j % 7 else None, pick(1)[0], pick(1)[0].upper()) for j in range(n_chunks)]
    asked = spark.createDataFrame([(i, [float(x) for x in q[i]], *terms[i]) for i in range(n_requests)], "query_id long, query_vec array<double>, primary_terms array<string>, secondary_terms array<string>, query_terms array<string>")
    chunks = spark.createDataFrame([(j, *t) for j, t in enumerate(texts)] + [(9000, "apple", "fig", "date")], "chunk_id long, text string, heading string, meta string")
    vectors = spark.createDataFrame([(j, [float(x) for x in v]) for j, v in enumerate(c)] + [(9001, [1.0] * 6), (9002, None)], "vec_id long, vec array<double>")
    return q, c, terms, texts, asked, chunks, vectors


def test_hybrid_equals_brute_force_in_any_blocks(spark, monkeypatch):
    q, c, terms, texts, asked, chunks, vectors = hybrid_input(spark)
    want = brute_hybrid(q, c, terms, texts, 3)
    for requests, rows, cells in ((2000, 8192, 4_000_000), (7, 20, 50)):
        monkeypatch.setattr(retrieval, "BLOCK_REQUESTS", requests)
        monkeypatch.setattr(retrieval, "BLOCK_TEXTS", rows)
        monkeypatch.setattr(retrieval, "CELLS", cells)
        found = retrieval.hybrid_top_k(asked, chunks, vectors, 3, "chunk_id", "text", "heading", "meta", "vec_id", "vec")
        assert {(x.query_id, x.chunk_id, x.keyword_score, x.rank) for x in found.collect()} == want


def test_best_keyword_rows_are_the_best_of_all_hits(spark, monkeypatch):
    asked, chunks = hybrid_input(spark)[4:6]
    monkeypatch.setattr(retrieval, "BLOCK_TEXTS", 20)
    hits = {}
    for x in retrieval.keyword_hits(asked, chunks, "chunk_id", "text", "heading", "meta").collect():
        hits.setdefault(x.query_id, []).append((-x.keyword_score, x.chunk_id))
    want = {(i, c, -s, r) for i, rows in hits.items() for r, (s, c) in enumerate(sorted(rows)[:4], 1)}
    best = retrieval.keyword_hits(asked, chunks, "chunk_id", "text", "heading", "meta", best=4)
    assert {(x.query_id, x.chunk_id, x.keyword_score, x["rank"]) for x in best.collect()} == want


def test_searches_without_requests_or_rows_give_nothing(spark):
    _, _, _, _, asked, chunks, vectors = hybrid_input(spark, 5, 10)
    for a, c, v in ((asked.limit(0), chunks, vectors), (asked, chunks.limit(0), vectors), (asked, chunks, vectors.limit(0))):
        assert retrieval.hybrid_top_k(a, c, v, 3, "chunk_id", "text", "heading", "meta", "vec_id", "vec").count() == 0
    assert retrieval.dense_top_k(asked.limit(0), vectors, 3, "vec_id", "vec").count() == 0
    assert retrieval.keyword_hits(asked.limit(0), chunks, "chunk_id", "text", "heading", "meta").count() == 0


def test_like_terms_keep_their_wildcards(spark):
    m = retrieval._Matcher(["a_c", "x%z", "PLAIN", "100%"], escape=False)
    assert m.found("ABC xyyz") == [0, 1]
    assert m.found("plain 100 times") == [2, 3]
    assert retrieval._Matcher(["100%"], escape=True).found("100 times") == []


def test_many_terms_use_the_same_answer(spark):
    terms = [f"t{i}x" for i in range(400)] + ["needle"]
    assert retrieval._Matcher(terms, False).found("a Needle and T17X") == [17, 400]


def test_external_scores_need_one_per_candidate(spark):
    c = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (2, 1, 1.0), (3, 1, 1.0)], "query_id long, rank_before int, deterministic_score double")
    s = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.25), (2, 5, 1.0)], "query_id long, index int, score double")
    got = {(r.query_id, r.rank_before): (r.rerank_score, r.reranker_source) for r in retrieval.external_scores(c, s, "x").collect()}
    assert got == {(1, 1): (1.5, "x"), (1, 2): (2.25, "x"), (2, 1): (1.0, "x_failed_fallback"), (3, 1): (1.0, "deterministic_fallback")}


def test_embedding_equals_direct_computation(spark):
    import hashlib

    text = "员工 旷工两天会怎样 ABC"
    t = "".join(text.split()).lower()
    v = [float(sum(t.count(x) * len(x) for x in terms)) for _, terms in features.TERM_FEATURES] + [0.0] * 8
    for ch in t:
        v[8 + int.from_bytes(hashlib.blake2b(ch.encode(), digest_size=2).digest(), "big") % 8] += 0.15
    want = np.array(v) / np.linalg.norm(v)
    got = features.embed(spark.createDataFrame([(text,)], "t string"), "t").first().embedding
    assert np.allclose(got, want, atol=1e-8)
