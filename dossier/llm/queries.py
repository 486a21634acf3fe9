"""One query per operator, with its production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.session import shared_dir
from dossier.llm import exact_dedup, line_dedup, merkle_manifest, mixing, packing, phrases, pii, quality_rules, secret_scan, simhash_dedup, token_counts, vector_dedup, warc_archive
from dossier.llm.base import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mixed(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def _counts(spans: str, kinds) -> list:
    of = lambda kind: F.size(F.filter(spans, lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    return [of(k) for k in kinds]


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = secret_scan.secrets(table(spark, sf_dir, "documents"))
    both = secret_scan.in_order(F.array_distinct(F.concat("base", "further")))
    digest = F.sha2(secret_scan.span_text(F.col("base")), 256)
    return d.select("doc_id", *_counts("base", secret_scan.KINDS), digest.alias("base_sha256"), secret_scan.span_text(both).alias("spans"), "n_layers", "n_closed")


def op3_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    warc_archive.write_archive(table(spark, sf_dir, "pages"), path)
    p = warc_archive.parsed(warc_archive.read_archive(spark, path))
    return p.select(F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_pii_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pii.personal_data(table(spark, sf_dir, "documents"))
    slim = F.transform("base", lambda x: F.struct(x.kind.alias("kind"), x.start.alias("start"), x.end.alias("end")))
    both = secret_scan.in_order(F.concat(slim, "further"), pii.ALL_KINDS)
    digest = F.sha2(secret_scan.span_text(F.col("base")), 256)
    return d.select("doc_id", *_counts("base", pii.KINDS), digest.alias("base_sha256"), secret_scan.span_text(both).alias("spans"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), token_counts.load_pieces())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    gone = line_dedup.dropped_lines(docs).withColumnRenamed("doc_id", "_k")
    lines = docs.select("doc_id", (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    d = lines.join(gone, F.col("doc_id").eqNullSafe(F.col("_k")), "left")
    dropped = F.array_join(F.transform("dropped", lambda x: x.cast("string")), ",")
    return d.select("doc_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(dropped, F.lit("")).alias("dropped"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = merkle_manifest.manifest(merkle_manifest.document_leaves(table(spark, sf_dir, "documents")))
    return m.withColumnRenamed("id", "doc_id")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


# Archive: the whole result follows from payload lengths, digests and the smallest page of each digest.
OP4_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

# Tree: nodes of every level per language, then over the subroots; a leaf's way up as one list per row, folded.
_FIELD = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE octet_length(encode(CAST({x} AS VARCHAR))) || ':' || {x} END"
_LEAF = lambda n: "sha256(" + " || ".join(_FIELD(x) for x in ("doc_id", "source", "lang", n, "text")) + ")"
# CRC-32 bit by bit: -1 stands for one shift.
_CRC = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda c: list_prepend(CAST(ascii(c) AS BIGINT), [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384::BIGINT * (a & 1)) END))"""
_SIDE = "CASE WHEN s.h IS NULL THEN 'N' WHEN v.pos % 2 = 1 THEN 'L' || s.h ELSE 'R' || s.h END"
OP11_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_LEAF('n_chars')} AS leaf, CASE WHEN {_CRC} % 7 = 0 AND n_chars IS NOT NULL THEN {_LEAF('(n_chars + 1)')} END AS changed FROM documents),
p AS (SELECT *, row_number() OVER g - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d WINDOW g AS (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf)),
node AS (
  SELECT lang, 0 AS lvl, pos, leaf AS h, n FROM p
  UNION ALL SELECT lang, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM node WHERE n > 1 GROUP BY lang, lvl, pos // 2, n
),
subs AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1),
top AS (
  SELECT 0 AS lvl, pos, subroot AS h, n FROM subs
  UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY lvl, pos // 2, n
),
way AS (
  SELECT p.lang, p.pos, list({_SIDE} ORDER BY v.lvl) AS steps FROM p JOIN node v ON v.lang IS NOT DISTINCT FROM p.lang AND v.n > 1 AND v.pos = p.pos >> v.lvl
  LEFT JOIN node s ON s.lang IS NOT DISTINCT FROM v.lang AND s.lvl = v.lvl AND s.pos = xor(v.pos, 1) GROUP BY p.lang, p.pos
),
top_way AS (
  SELECT p.pos, list({_SIDE} ORDER BY v.lvl) AS steps FROM subs p JOIN top v ON v.n > 1 AND v.pos = p.pos >> v.lvl LEFT JOIN top s ON s.lvl = v.lvl AND s.pos = xor(v.pos, 1) GROUP BY p.pos
),
full_way AS (
  SELECT p.*, u.subroot, list_concat(coalesce(way.steps, []::VARCHAR[]), coalesce(top_way.steps, []::VARCHAR[])) AS steps FROM p JOIN subs u ON u.lang IS NOT DISTINCT FROM p.lang
  LEFT JOIN way ON way.lang IS NOT DISTINCT FROM p.lang AND way.pos = p.pos LEFT JOIN top_way ON top_way.pos = u.pos
),
folded AS (
  SELECT *, list_reduce(list_prepend(coalesce(changed, leaf), steps), lambda a, x: CASE x[1] WHEN 'L' THEN sha256(substr(x, 2) || a) WHEN 'R' THEN sha256(a || substr(x, 2)) ELSE sha256(a) END) AS folded_root FROM full_way
)
SELECT doc_id, leaf, subroot, h AS root, sha256(array_to_string([substr(x, 2) FOR x IN steps], '')) AS proof_sha256, folded_root, folded_root = h AS verified
FROM folded, (SELECT h FROM top WHERE n = 1)
"""

OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
grams AS (SELECT lang, w[i : i + m - 1] AS g FROM starts, range(1, 5) AS t(m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, g, count(*) AS n FROM grams GROUP BY lang, g HAVING count(*) >= 30),
cuts AS (SELECT lang, g, n AS a, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1),
cut_scores AS (
  SELECT c.lang, c.g, c.a, c.k, x.n AS l, y.n AS r, (2000000::HUGEINT * c.a) // (x.n::HUGEINT + y.n) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.g[1 : c.k] JOIN f y ON y.lang = c.lang AND y.g = c.g[c.k + 1 :]
),
best AS (SELECT * FROM cut_scores QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, n, g[i : i + m - 1] AS g FROM (SELECT lang, n, g, m, unnest(range(1, len(g) - m + 2)) AS i FROM f, range(2, 4) AS t(m) WHERE len(g) > m)
),
longest AS (SELECT lang, g, max(n) AS longer FROM inner_ GROUP BY lang, g),
kept AS (
  SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM best b LEFT JOIN longest o ON o.lang = b.lang AND o.g = b.g
  WHERE o.longer IS NULL OR 100 * o.longer::HUGEINT < 80 * b.a::HUGEINT
)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n, score::BIGINT AS score
FROM kept k JOIN totals t ON t.lang = k.lang
QUALIFY rank <= 2000
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ 	-
]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_secret_scan, op3_length_packing, op4_warc_archive, op5_vector_dedup, op6_simhash_dedup,
        op7_pii_sanitise, op8_token_counts, op9_quality_rules, op10_line_dedup, op11_merkle_manifest, op12_phrase_collocations,
        op13_exact_dedup,
    )
}
ORACLES: dict[str, str] = {"op4_warc_archive": OP4_SQL, "op11_merkle_manifest": OP11_SQL, "op12_phrase_collocations": OP12_SQL, "op13_exact_dedup": OP13_SQL}
