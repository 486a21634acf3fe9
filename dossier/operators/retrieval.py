"""Candidate search: dense, keyword and hybrid, for a table of requests over a corpus.

Requests and corpus are both cut into blocks, and each pair of blocks meets in one grouped Arrow task. A task scores
its corpus block against its requests and gives only its own best rows per request, so no table of pairs is built or
shuffled: at most k rows per request and corpus block go on, and are limited once more where they are made. The plan
is the same for ten requests and for millions; no request passes through the driver.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.functions.session import SLICE_ROWS
from dossier.functions.text import ordered_distinct

BLOCK_REQUESTS = 2_000
#: Corpus rows of a block: many vectors, fewer texts.
BLOCK_VECTORS = 32_768
BLOCK_TEXTS = 8_192
#: Distances that a task holds at a time.
CELLS = 4_000_000
MANY_TERMS = 300  # from here on one automaton pass beats one search per term

# Keyword weights for text, heading and metadata hits.
PRIMARY = (8.0, 5.0, 3.0)
SECONDARY = (2.0, 2.0, 1.5)
QUERY_ON_TEXT = 1.0


def _met(requests: DataFrame, corpus: DataFrame, rows: int, block_rows: int, corpus_id: str, fn, schema: str) -> DataFrame:
    """fn(requests, corpus) for each pair of a request block and a corpus block (Arrow tables).

    The number of blocks follows the number of requests and of corpus rows, so a block has a bounded number of rows.
    Small corpora still give every core a block.
    """
    across = max(1, -(-requests.count() // BLOCK_REQUESTS))
    down = max(-(-rows // block_rows), corpus.sparkSession.sparkContext.defaultParallelism)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = requests.withColumn("_rb", F.pmod(F.xxhash64("query_id"), F.lit(across)).cast("int")).withColumn("_cb", every(down))
    given = corpus.withColumn("_cb", F.pmod(F.xxhash64(corpus_id), F.lit(down)).cast("int")).withColumn("_rb", every(across))
    return asked.groupBy("_rb", "_cb").cogroup(given.groupBy("_rb", "_cb")).applyInArrow(fn, schema)


def _with_vectors(asked: pa.Table) -> pa.Table:
    return asked.filter(pc.is_valid(asked["query_vec"]))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of equal length as rows; none may be null."""
    flat = pc.list_flatten(column).to_numpy().astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _request_chunks(q: np.ndarray, n: int):
    """Ranges of requests whose distances to n rows are held together."""
    step = max(1, CELLS // max(n, 1))
    return [(a, min(a + step, len(q))) for a in range(0, len(q), step)]


def _distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosine distance of each request and row, rounded to 12 digits; 1 where either vector is zero."""
    n = np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n == 0, 1.0, 1.0 - (q @ c.T) / n).round(12)


def _first(request: np.ndarray, k: int, *order: np.ndarray) -> np.ndarray:
    """Places of the first k entries of each request in the given order."""
    by = np.lexsort((*reversed(order), request))
    r = request[by]
    heads = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.zeros(0, np.int64)
    rank = np.arange(len(r)) - np.repeat(heads, np.diff(np.append(heads, len(r))))
    return by[rank < k]


def _nearest(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(request, row) of the k smallest distances per request, ties by row."""
    limit = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if d.shape[1] > k else np.inf
    r, j = np.nonzero(d <= limit)
    at = _first(r, k, d[r, j], j)
    return r[at], j[at]


def dense_top_k(
    requests: DataFrame, corpus: DataFrame, k: int, corpus_id: str, corpus_vec: str, query_id: str = "query_id", query_vec: str = "query_vec"
) -> DataFrame:
    """Exact k nearest corpus rows per request by cosine distance, ties by id; zero vectors are at distance 1, null ones at none."""
    asked = requests.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("query_vec"))
    rows = corpus.select(F.col(corpus_id).alias("chunk_id"), F.col(corpus_vec).alias("vec")).filter("vec is not null")
    types = [df.schema[c].dataType.simpleString() for df, c in ((asked, "query_id"), (rows, "chunk_id"))]

    def search(asked: pa.Table, rows: pa.Table) -> pa.Table:
        asked, rows = _with_vectors(asked), rows.sort_by("chunk_id")
        q, c = _matrix(asked["query_vec"]), _matrix(rows["vec"])
        found = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)]
        for a, b in _request_chunks(q, len(c)) if len(c) else ():
            d = _distances(q[a:b], c)
            r, j = _nearest(d, k)
            found.append((r + a, j, d[r, j]))
        r, j, d = map(np.concatenate, zip(*found))
        return pa.table({"query_id": asked["query_id"].take(pa.array(r)), "chunk_id": rows["chunk_id"].take(pa.array(j)), "distance": d})

    every = _met(asked, rows, rows.count(), BLOCK_VECTORS, "chunk_id", search, f"query_id {types[0]}, chunk_id {types[1]}, distance double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "chunk_id"))
    return every.withColumn("rank", rank).filter(F.col("rank") <= k)


def query_tokens(text: Column) -> Column:
    """Tokens of a question: split at blanks and question marks, two characters or longer."""
    return F.array_distinct(F.filter(F.split(F.translate(text, "？?", "  "), r"(?U)\s+"), lambda t: F.length(t) >= 2))


def term_groups(df: DataFrame, text: str = "text") -> DataFrame:
    """Primary, secondary and query terms of a request, each distinct and in order."""
    one = lambda c: F.array(F.col(c).cast("string"))
    trimmed = lambda a: F.transform(a, lambda t: F.trim(t))
    return (
        df.withColumn("primary_terms", ordered_distinct(trimmed(F.coalesce("target_terms", F.array().cast("array<string>"))), one("target_clause"), one("target_subclause"),
                                                        trimmed(F.coalesce("rule_search_terms", F.array().cast("array<string>")))))
        .withColumn("secondary_terms", ordered_distinct(one("target_section")))
        .withColumn("query_terms", query_tokens(F.col(text)))
    )


class _Matcher:
    """Finds which of many LIKE terms occur in a text, ignoring case.

    Terms keep their LIKE meaning (% and _ are wildcards) unless escaped.
    Plain terms are looked up in one pass per text where the automaton library
    is present, else one by one.
    """

    def __init__(self, terms: list[str], escape: bool):
        self.plain = [(i, t.lower()) for i, t in enumerate(terms) if escape or not re.search("[%_]", t)]
        # A pattern is its pieces between %, which must follow each other; _ is any one character.
        self.patterns = [
            (i, [re.compile("".join("." if c == "_" else re.escape(c) for c in piece), re.S | re.I) for piece in t.split("%") if piece])
            for i, t in enumerate(terms) if not escape and re.search("[%_]", t)
        ]
        self.automaton = None
        if len(self.plain) > MANY_TERMS:
            try:
                import ahocorasick

                self.automaton = ahocorasick.Automaton()
                by_text: dict[str, list[int]] = {}
                for i, t in self.plain:
                    by_text.setdefault(t, []).append(i)
                for t, ids in by_text.items():
                    self.automaton.add_word(t, ids)
                self.automaton.make_automaton()
            except ImportError:
                self.automaton = None

    def found(self, text: str) -> list[int]:
        """Numbers of the terms in a text, ascending."""
        low = text.lower()
        if self.automaton is not None:
            out = [i for ids in {id(v): v for _, v in self.automaton.iter(low)}.values() for i in ids]
        else:
            out = [i for i, t in self.plain if t in low]
        for i, pieces in self.patterns:
            at = 0
            for piece in pieces:
                m = piece.search(text, at)
                if m is None:
                    break
                at = m.end()
            else:
                out.append(i)
        return sorted(out)


def _strings(column: pa.ChunkedArray):
    """Values of a text column, a few of them as Python objects at a time."""
    for at in range(0, len(column), SLICE_ROWS):
        yield from column.slice(at, SLICE_ROWS).to_pylist()


class _TermIndex:
    """Sparse index from terms to the requests that ask for them, by kind of term."""

    def __init__(self, asked: pa.Table, escape: bool):
        kinds = [asked[c].to_pylist() for c in ("primary_terms", "secondary_terms", "query_terms")]
        self.n_requests = asked.num_rows
        self.terms = list(dict.fromkeys(t for lists in kinds for ts in lists for t in ts or () if t is not None))
        number = {t: i for i, t in enumerate(self.terms)}
        self.asking = []
        for lists in kinds:
            pairs = sorted({(number[t], j) for j, ts in enumerate(lists) for t in ts or () if t is not None})
            term, request = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
            self.asking.append((np.searchsorted(term, np.arange(len(self.terms) + 1)), request))
        self.matcher = _Matcher(self.terms, escape)

    def _pairs(self, kind: int, row: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Distinct row * n_requests + request of hits (row, term) of one kind."""
        begin, request = self.asking[kind]
        size = begin[term + 1] - begin[term]
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.unique(np.repeat(row, size) * self.n_requests + request[np.repeat(begin[term], size) + within])

    def scores(self, fields: list[pa.ChunkedArray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(request, row, score) of every row that has any term of a request. fields: texts, headings, metadata."""
        parts = []
        for f, values in enumerate(fields):
            hits = [self.matcher.found(v) if v else [] for v in _strings(values)] if self.terms else []
            row = np.repeat(np.arange(len(hits)), [len(h) for h in hits]).astype(np.int64)
            term = np.array([i for h in hits for i in h], np.int64)
            for kind, weight in enumerate((PRIMARY[f], SECONDARY[f], QUERY_ON_TEXT if f == 0 else 0.0)):
                pairs = self._pairs(kind, row, term)
                parts.append((pairs, np.full(len(pairs), weight)))
        pairs, weights = (np.concatenate(x) for x in zip(*parts))
        keys, at = np.unique(pairs, return_inverse=True)
        n = max(self.n_requests, 1)
        return keys % n, keys // n, np.bincount(at, weights, len(keys)) if len(keys) else np.zeros(0)


TERMS = ("primary_terms", "secondary_terms", "query_terms")


def keyword_hits(
    requests: DataFrame, corpus: DataFrame, chunk_id: str, text: str, heading: str, metadata: str, best: int | None = None, escape: bool = False
) -> DataFrame:
    """Keyword score of every corpus row that has any term of a request, (query_id, chunk_id, keyword_score).

    With `best` only the best rows of each request come, by score and then by id, with their rank; then no more
    than `best` rows per request and corpus block are shuffled.
    """
    asked = requests.select("query_id", *TERMS)
    rows = corpus.select(F.col(chunk_id).alias("chunk_id"), *[F.col(c).alias(n) for c, n in ((text, "text"), (heading, "heading"), (metadata, "metadata"))])
    types = [df.schema[c].dataType.simpleString() for df, c in ((asked, "query_id"), (rows, "chunk_id"))]

    def score(asked: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk_id")
        r, j, s = _TermIndex(asked, escape).scores([rows[c] for c in ("text", "heading", "metadata")])
        if best is not None:
            at = _first(r, best, -s, j)
            r, j, s = r[at], j[at], s[at]
        return pa.table({"query_id": asked["query_id"].take(pa.array(r)), "chunk_id": rows["chunk_id"].take(pa.array(j)), "keyword_score": s})

    hits = _met(asked, rows, corpus.count(), BLOCK_TEXTS, "chunk_id", score, f"query_id {types[0]}, chunk_id {types[1]}, keyword_score double")
    if best is None:
        return hits
    order = W.partitionBy("query_id").orderBy(F.col("keyword_score").desc(), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)


def _paired(rows: pa.Table) -> pa.Table:
    """Chunk rows and vector rows of one block, put together by id, in order of id; what has no partner goes."""
    n = pa.array(np.arange(rows.num_rows))
    side = rows.select(["chunk_id"]).append_column("at", n)
    is_vector = rows["is_vector"]
    both = side.filter(pc.invert(is_vector)).join(side.filter(is_vector).rename_columns(["chunk_id", "vector_at"]), "chunk_id", join_type="inner").sort_by("chunk_id")
    return rows.drop_columns(["vec"]).take(both["at"]).append_column("vec", rows["vec"].take(both["vector_at"]))


def hybrid_top_k(
    requests: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int, chunk_id: str, text: str, heading: str, metadata: str, vec_id: str, vec: str, escape: bool = False
) -> DataFrame:
    """Best k chunks per request from 2k dense and 4k keyword candidates.

    A chunk found both ways counts once with its keyword score. Order: keyword score down, distance up, id. A request
    without terms has dense candidates only; one without a vector has none. Chunks without a vector, and vectors
    without a chunk, are left out. Texts and vectors are read and shuffled once, in one exchange; keyword scores and
    distances are computed together, so a task knows its own best candidates of both kinds.
    """
    asked = requests.select("query_id", "query_vec", *TERMS)
    names = ((text, "text"), (heading, "heading"), (metadata, "metadata"))
    vec_type = vectors.schema[vec].dataType
    texts = chunks.select(F.col(chunk_id).alias("chunk_id"), *[F.col(c).alias(n) for c, n in names], F.array().cast(vec_type).alias("vec"), F.lit(False).alias("is_vector"))
    found = vectors.filter(F.col(vec).isNotNull()).select(F.col(vec_id).alias("chunk_id"), *[F.lit(None).cast(chunks.schema[c].dataType).alias(n) for c, n in names], F.col(vec).alias("vec"), F.lit(True).alias("is_vector"))
    rows = texts.unionByName(found)
    types = [df.schema[c].dataType.simpleString() for df, c in ((asked, "query_id"), (rows, "chunk_id"))]

    def search(asked: pa.Table, rows: pa.Table) -> pa.Table:
        asked, rows = _with_vectors(asked), _paired(rows)
        q, c = _matrix(asked["query_vec"]), _matrix(rows["vec"])
        kr, kj, ks = _TermIndex(asked, escape).scores([rows[n] for n in ("text", "heading", "metadata")])
        by = np.argsort(kr, kind="stable")
        kr, kj, ks = kr[by], kj[by], ks[by]
        out = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2 + (np.zeros(0, bool),)]
        for a, b in _request_chunks(q, len(c)) if len(c) else ():
            d = _distances(q[a:b], c)
            r, j = _nearest(d, 2 * k)
            out.append((r + a, j, np.zeros(len(r)), d[r, j], np.zeros(len(r), bool)))
            lo, hi = np.searchsorted(kr, [a, b])
            r, j, s = kr[lo:hi] - a, kj[lo:hi], ks[lo:hi]
            at = _first(r, 4 * k, -s, d[r, j], j)
            r, j, s = r[at], j[at], s[at]
            out.append((r + a, j, s, d[r, j], np.ones(len(r), bool)))
        r, j, s, d, by_term = map(np.concatenate, zip(*out))
        return pa.table({"query_id": asked["query_id"].take(pa.array(r)), "chunk_id": rows["chunk_id"].take(pa.array(j)), "keyword_score": s, "distance": d, "by_term": by_term})

    schema = f"query_id {types[0]}, chunk_id {types[1]}, keyword_score double, distance double, by_term boolean"
    every = _met(asked, rows, chunks.count(), BLOCK_TEXTS, "chunk_id", search, schema)
    order = (F.col("keyword_score").desc(), F.col("distance"), F.col("chunk_id"))
    place = F.row_number().over(W.partitionBy("query_id", "by_term").orderBy(*order))
    few = every.withColumn("rn", place).filter(F.col("rn") <= 4 * k).filter(F.col("by_term") | (F.col("rn") <= 2 * k))
    merged = few.groupBy("query_id", "chunk_id").agg(F.max("keyword_score").alias("keyword_score"), F.min("distance").alias("distance"))
    return merged.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)


def metadata_text(values: Column) -> Column:
    """All metadata values joined by a space; list values item by item. `values` is array<array<string>>."""
    return F.array_join(F.flatten(values), " ")


def lexical_terms(text: Column) -> Column:
    """Distinct CJK characters and lower-case blank-separated tokens of a text."""
    chars = F.regexp_extract_all(text, F.lit(r"[\x{4E00}-\x{9FFF}]"), F.lit(0))
    tokens = F.filter(F.split(F.translate(text, "？?", "  "), r"(?U)\s+"), lambda t: t != "")
    return F.array_union(chars, F.transform(tokens, lambda t: F.lower(t)))


def lexical_overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(lexical_terms(a), lexical_terms(b)))


def external_scores(candidates: DataFrame, scores: DataFrame, provider: str, position: str | None = None) -> DataFrame:
    """Joins reranker scores by (query_id, index), index from 0 in rank_before order.

    Scores of a request count only when there is exactly one for every
    candidate and none out of range; else the request falls back to rule
    scores and says why. Of a repeated index the last by `position` counts
    (without that column the highest).
    """
    n = candidates.groupBy("query_id").agg(F.count("*").alias("expected"))
    seen = scores.join(n, "query_id").groupBy("query_id", "expected").agg(
        F.count_distinct(F.when((F.col("index") >= 0) & (F.col("index") < F.col("expected")), F.col("index"))).alias("good"),
        F.min(F.when((F.col("index") < 0) | (F.col("index") >= F.col("expected")), F.col("index"))).alias("off"),
    )
    error = F.when(F.col("off").isNotNull(), F.concat(F.lit("rerank result index out of range: "), "off")).when(
        F.col("good") != F.col("expected"), F.concat(F.lit("expected "), "expected", F.lit(" rerank results, got "), "good")
    )
    verdict = seen.select("query_id", error.alias("reranker_error"), F.lit(True).alias("_asked"))
    kept = F.max_by("score", position) if position else F.max("score")
    last = scores.groupBy("query_id", "index").agg(kept.alias("reranker_score"))
    d = candidates.join(verdict, "query_id", "left").join(
        last.withColumn("rank_before", F.col("index") + 1).drop("index"), ["query_id", "rank_before"], "left"
    )
    ok = F.coalesce(F.col("_asked"), F.lit(False)) & F.col("reranker_error").isNull()
    return (
        d.withColumn("reranker_source", F.when(F.col("_asked").isNull(), "deterministic_fallback").when(ok, provider).otherwise(f"{provider}_failed_fallback"))
        .withColumn("reranker_score", F.when(ok, F.col("reranker_score")))
        .withColumn("rerank_score", F.round(F.col("deterministic_score") + F.coalesce("reranker_score", F.lit(0.0)), 4))
        .drop("_asked")
    )


def _with_scores(d: DataFrame, error, score, source) -> DataFrame:
    """Adds source, error, external and combined score; columns of the request go by the names given here."""
    return (
        d.withColumn("reranker_source", source).withColumn("reranker_error", error).withColumn("reranker_score", score)
        .withColumn("rerank_score", F.round(F.col("deterministic_score") + F.coalesce("reranker_score", F.lit(0.0)), 4))
    )


def listed_scores(candidates: DataFrame, lists: DataFrame, provider: str) -> DataFrame:
    """Joins plain score lists (query_id, scores), one row per request, in rank_before order.

    A list counts only with one score for every candidate; any other length (null: a request that failed) leaves
    the rule scores and is recorded. A request without a row was not sent out.
    """
    n = candidates.groupBy("query_id").agg(F.count("*").alias("_n"))
    own = lists.select("query_id", F.col("scores").cast("array<double>").alias("_scores"), F.lit(True).alias("_asked"))
    d = candidates.join(n.join(own, "query_id", "left"), "query_id")
    asked, got = F.col("_asked").isNotNull(), F.size("_scores")
    failed, invalid = asked & F.col("_scores").isNull(), asked & (got != F.col("_n"))
    source = F.when(~asked, "deterministic_fallback").when(failed, f"{provider}_failed_fallback").when(invalid, f"{provider}_invalid_fallback").otherwise(provider)
    error = F.when(failed, "no scores").when(invalid, F.concat(F.lit("expected "), "_n", F.lit(" scores, got "), got))
    score = F.when(asked & error.isNull(), F.get("_scores", F.col("rank_before") - 1))
    return _with_scores(d, error, score, source).drop("_n", "_scores", "_asked")


RESPONSE = "struct<scores:array<double>,results:array<struct<index:int,score:double>>>"


def response_scores(candidates: DataFrame, responses: DataFrame, provider: str) -> DataFrame:
    """Joins raw response bodies (query_id, body), one row per request; body is JSON.

    A `scores` list goes before `results` rows of index and score, index from 0 in rank_before order; of a repeated
    index the last row counts. An index out of range, an index or a score too few, or neither field leaves the rule
    scores and is recorded. All checks stay inside the row of the request.
    """
    n = candidates.groupBy("query_id").agg(F.count("*").cast("int").alias("_n"))
    body = responses.select("query_id", F.from_json("body", RESPONSE).alias("_body"))
    d = n.join(body.withColumn("_asked", F.lit(True)), "query_id", "left")
    listed, rows, expected = F.col("_body.scores"), F.col("_body.results"), F.col("_n")
    off = F.get(F.filter(rows, lambda x: (x["index"] < 0) | (x["index"] >= expected)), F.lit(0))["index"]
    seen = F.size(F.array_distinct(F.transform(rows, lambda x: x["index"])))
    few = lambda what, got: F.concat(F.lit("expected "), expected, F.lit(f" rerank {what}, got "), got)
    by_list = F.when(F.size(listed) != expected, few("scores", F.size(listed)))
    by_rows = F.when(off.isNotNull(), F.concat(F.lit("rerank result index out of range: "), off)).when(seen != expected, few("results", seen))
    error = F.when(listed.isNotNull(), by_list).when(rows.isNotNull(), by_rows).otherwise("rerank response must contain scores or results")
    last = lambda i: F.try_element_at(F.filter(rows, lambda x: x["index"] == i), F.lit(-1))["score"]
    d = d.withColumn("_error", F.when(F.col("_asked"), error))
    good = F.col("_asked") & F.col("_error").isNull()
    d = d.withColumn("_scores", F.when(good, F.coalesce(listed, F.transform(F.sequence(F.lit(0), expected - 1), last))))
    d = candidates.join(d.select("query_id", "_asked", "_error", "_scores"), "query_id")
    source = F.when(F.col("_asked").isNull(), "deterministic_fallback").when(F.col("_error").isNull(), provider).otherwise(f"{provider}_failed_fallback")
    return _with_scores(d, F.col("_error"), F.get("_scores", F.col("rank_before") - 1), source).drop("_asked", "_error", "_scores")


def reorder(df: DataFrame, score: str = "rerank_score") -> DataFrame:
    """rank_after per request: score down, earlier rank first."""
    return df.withColumn("rank_after", F.row_number().over(W.partitionBy("query_id").orderBy(F.col(score).desc(), "rank_before")))
