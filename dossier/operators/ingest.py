"""Detail records to stored chunks: body, section tree and attachments, outcomes and statistics."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from dossier.functions import spans
from dossier.functions.session import by_shuffle, filled_lists, map_slices, materialize, spread
from dossier.functions.text import first_present, let
from dossier.operators import chunking, parsing, tree
from dossier.operators.numbering import number_within
from dossier.sources.raw import FILE_NAME_KEYS, FILE_TYPE, FILE_TYPE_KEYS, FILE_URL_KEYS


def merged_path(base: Column, title: Column, path: Column) -> Column:
    """A path that already starts with the base stays; else a leading title goes and the base comes in front."""
    starts = (F.size(base) > 0) & (F.slice(path, 1, F.greatest(F.size(base), F.lit(1))) == base)
    rest = F.when(F.get(path, F.lit(0)) == title, F.slice(path, 2, F.greatest(F.size(path), F.lit(1)))).otherwise(path)
    joined = F.concat(base, rest)
    return F.when(starts, path).when(F.size(joined) > 0, joined).otherwise(F.array(title))


def merged_metadata(left: Column, right: Column) -> Column:
    """Map union in which the right side wins; entries without a value are dropped."""

    def merged(r: Column) -> Column:  # the right map is made once and not for every entry of the left one
        mine = F.map_filter(left, lambda k, v: ~F.array_contains(F.map_keys(r), k))
        return F.map_filter(F.map_concat(mine, r), lambda k, v: v.isNotNull())

    return let(right, merged)


def enrich_category(details: DataFrame, categories: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """Fills missing category fields from the category table; own values stay. `fields`: detail column -> category column."""
    c = categories.select(F.col(key), *[F.col(src).alias(f"_c_{dst}") for dst, src in fields.items()])
    d = details.join(c, key, "left")
    for dst in fields:
        d = d.withColumn(dst, F.coalesce(dst, f"_c_{dst}")).drop(f"_c_{dst}")
    return d


_FACTS = "element_count int, node_count int, issue_count int, structure_warnings int, strategy string"


def _chunked(parsed: DataFrame, size: int, overlap: int) -> DataFrame:
    """parsed (see `parsing.html_texts`) with _chunks and everything else that the ingest needs of a body instead of its text.

    A document is one row, and its chunks are one array, which is exploded when its metadata is complete.
    """
    spans.check_sizes(size, overlap)
    keys = [c for c in parsed.columns if c not in ("text", "starts", "ends")]
    facts = T.StructType.fromDDL(_FACTS)
    chunks = T.StructField("_chunks", T.ArrayType(T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in chunking.CHUNK_FIELDS))))
    schema = T.StructType([*(parsed.schema[c] for c in keys), *facts.fields, chunks])
    types, kind = [to_arrow_type(f.dataType) for f in facts], to_arrow_type(chunks.dataType)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        told, made = [], []
        for text, starts, ends in zip(*(batch[c].to_pylist() for c in ("text", "starts", "ends"))):
            elements = [{"pos": n, "text": text[a:b], "start": a, "end": b} for n, (a, b) in enumerate(zip(starts, ends), 1)]
            nodes = tree.section_nodes(elements)
            issues = tree.node_issues(nodes)
            own, marked = chunking.document_chunks(text, starts, ends, elements, tree.node_chunks(nodes, size), size, overlap)
            made.append(own)
            strategy = "none" if not text else "policy_clause_group" if marked else "fixed_window_fallback"
            told.append((len(elements), len(nodes), len(issues), sum(severity == "warning" for _, severity in issues), strategy))
        columns = [pa.array(v, t) for v, t in zip(zip(*told), types)]
        return pa.RecordBatch.from_arrays([*(batch[c] for c in keys), *columns, chunking.chunk_array(made, kind)], names=schema.names)

    return map_slices(filled_lists(parsed, "starts", "ends"), run, schema)


def _strings(values: dict[str, Column]) -> Column:
    """A map of the values that are not null, as strings."""
    every = F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*[v.cast("string") for v in values.values()]))
    return F.map_filter(every, lambda k, v: v.isNotNull())


def _quality() -> Column:
    """Parse, chunking and structure quality of a body (columns of `_chunked`)."""
    d = F.col
    text = d("strategy") != "none"
    marked = d("strategy") == "policy_clause_group"
    found = d("element_count") > 0
    structure = F.when(d("node_count") == 0, "failed").when(d("issue_count") > 0, "partial").otherwise("success")
    return _strings(
        {
            "parser_name": F.lit("html_builtin"), "parse_status": F.when(found, "success").otherwise("failed"), "parse_element_count": d("element_count"),
            "parse_table_count": d("table_count"), "parse_warning_count": F.when(found, 0).otherwise(1), "parse_warnings": F.when(~found, parsing.EMPTY_HTML),
            "chunking_status": F.when(text, "success"), "chunking_strategy": F.when(text, d("strategy")), "chunking_fallback_reason": F.when(text & ~marked, "no_policy_structure_detected"),
            "chunking_boundary_confidence": F.when(text, F.when(marked, "high").otherwise("low")), "structure_status": F.when(text, structure),
            "structure_node_count": F.when(text, d("node_count")), "structure_issue_count": F.when(text, d("issue_count")), "structure_warning_count": F.when(text, d("structure_warnings")),
        }
    )


TREE, BODY, ATTACHMENT = 0, 1, 2
#: Metadata that a chunk of a body has of its own.
CHUNK_ENTRIES = ("chunk_type", "chunk_role", "language", "section_title", "group_title", "clause_no", "clause_range", "violation_level", "retrieval_priority", "index_scope", "semantic_type", "split_index")


def detail_chunks(details: DataFrame, size: int = 1200, overlap: int = 150, contents: DataFrame | None = None, parse_attachments: bool = False) -> DataFrame:
    """All chunks of detail records with their ids, paths, provenance and metadata.

    `details` has doc_id, title, category_name, body (HTML), and where present `metadata` (map of strings) and `files`.
    A body is parsed once, and its front matter, sections or windows, then the chunks of its section tree, are made and
    numbered where it was parsed. branch: 0 tree, 1 body, 2 attachment. With `parse_attachments`, files are looked up
    in `contents` (url, text) and cut into windows under ids of their own; each chunk carries the state of the files.
    A record whose body has no text gives no body chunks.
    """
    own = lambda c, default: F.col(c) if c in details.columns else default
    file_type = T.ArrayType(FILE_TYPE)
    d = details.select(
        "doc_id", "title", "category_name", "body", F.coalesce(own("metadata", F.create_map().cast("map<string,string>")), F.create_map().cast("map<string,string>")).alias("metadata"),
        F.coalesce(own("files", F.array().cast(file_type)), F.array().cast(file_type)).alias("files"),
    )
    fetched = parsed_attachments(d, contents) if parse_attachments and contents is not None else None
    if fetched is not None:
        # Two branches read the fetched files.
        fetched = materialize(fetched, "attachments")
    state = attachment_states(d, fetched, parse_attachments)
    path = F.array_compact(F.array("category_name", "title"))
    named = {"title": F.col("title"), "policy_category_type_name": F.col("category_name"), "file_count": F.size("files")}
    base = merged_metadata(merged_metadata(F.col("metadata"), _strings(named)), _strings({"attachment_parse_status": F.col("_s.status"), "attachment_parsed_count": F.col("_s.parsed_count"), "attachment_parse_warning_count": F.col("_s.warning_count")}))
    d = state.select("doc_id", "title", F.when(F.size(path) > 0, path).otherwise(F.array("title")).alias("base"), base.alias("base_metadata"), "body")
    parsed = _chunked(parsing.html_texts(d, "body"), size, overlap)
    own_path = F.array_compact(F.array("title")).alias("own_path")
    parsed = parsed.select("doc_id", "title", "base", own_path, merged_metadata(F.col("base_metadata"), _quality()).alias("base_metadata"), "_chunks")
    # What a chunk's own entries may replace is taken out of the document's map once, so that a chunk only puts two maps together.
    kept = F.map_filter("base_metadata", lambda k, v: ~k.isin(*CHUNK_ENTRIES))
    parsed = parsed.select("doc_id", "title", "base", "own_path", kept.alias("kept"), *[F.col("base_metadata")[k].alias(f"_m_{k}") for k in CHUNK_ENTRIES], F.posexplode("_chunks").alias("_i", "c"))
    c = parsed.select(*[x for x in parsed.columns if x != "c"], "c.*").withColumn("chunk_no", F.col("_i") + 1)
    retrieval = F.col("chunk_role") == "retrieval"
    c = c.withColumns({"retrieval_priority": F.when(retrieval, "high").otherwise("low"), "index_scope": F.when(retrieval, "main").otherwise("coverage")})
    metadata = F.map_concat("kept", _strings({k: F.coalesce(F.col(k).cast("string"), F.col(f"_m_{k}")) for k in CHUNK_ENTRIES}))
    number = F.format_string("-%04d", "chunk_no")
    rows = c.select(
        "doc_id", F.lit(None).cast("string").alias("parent_doc_id"), F.when(F.col("tree"), TREE).otherwise(BODY).alias("branch"), "chunk_no",
        F.concat("doc_id", F.lit("-chunk"), number).alias("chunk_id"), F.concat("chunk_type", number).alias("block_id"), "chunk_type", "text",
        F.when(F.col("tree"), F.concat("base", "tail")).otherwise(merged_path(F.col("base"), F.col("title"), F.concat("own_path", "tail"))).alias("heading_path"), "start", "end",
        F.when(F.col("first_element").isNotNull(), chunking._element_ids(F.col("first_element"), F.col("last_element"))).otherwise(F.array().cast("array<string>")).alias("element_ids"),
        F.col("first_element").alias("range_start"), F.col("last_element").alias("range_end"), metadata.alias("metadata"),
    )
    if fetched is None:
        return rows
    files = attachment_chunks(fetched, size, overlap)
    parents = state.select(F.col("doc_id").alias("parent_doc_id"), "title", F.when(F.size(path) > 0, path).otherwise(F.array("title")).alias("base"), base.alias("base_metadata"))
    named = {"source": F.lit("company_policy_attachment"), "source_url": F.col("url"), "parent_doc_id": F.col("parent_doc_id"), "attachment_index": F.col("attachment_index"), "attachment_name": F.col("name"), "title": F.col("title"), "chunk_type": F.lit("attachment_fixed_window")}
    none = lambda t: F.lit(None).cast(t)
    files = files.join(by_shuffle(parents), "parent_doc_id").select(
        "doc_id", "parent_doc_id", F.lit(ATTACHMENT).alias("branch"), F.col("chunk_no").cast("int").alias("chunk_no"), "chunk_id", "block_id",
        F.lit("attachment_fixed_window").alias("chunk_type"), "text", F.concat("base", F.array("name")).alias("heading_path"), "start", "end",
        F.array().cast("array<string>").alias("element_ids"), none("int").alias("range_start"), none("int").alias("range_end"), merged_metadata(F.col("base_metadata"), _strings(named)).alias("metadata"),
    )
    return rows.unionByName(files)


def attachment_rows(details: DataFrame) -> DataFrame:
    """One row per listed file with its name, address and type. `details` has doc_id, files."""
    d = details.select("doc_id", F.posexplode("files").alias("i", "f"))
    pick = lambda keys: first_present(*[F.try_element_at("f", F.lit(k)) for k in keys])
    n = (F.col("i") + 1).cast("string")
    return d.select(
        "doc_id", (F.col("i") + 1).alias("attachment_index"), F.coalesce(pick(FILE_NAME_KEYS), F.concat(F.lit("attachment-"), n)).alias("name"),
        pick(FILE_URL_KEYS).alias("url"), pick(FILE_TYPE_KEYS).alias("content_type"),
    )


def parsed_attachments(details: DataFrame, contents: DataFrame) -> DataFrame:
    """Files with their fetched text and parse report; `contents` is (url, text), a missing url is a failed fetch."""
    files = attachment_rows(details).join(by_shuffle(contents.withColumnRenamed("text", "_text")), "url", "left")
    files = files.withColumn("fetched", F.col("_text").isNotNull())
    parsed = parsing.parse_sources(files, "name", "content_type", "_text")
    warned = (F.size("elements") == 0).cast("int")
    return parsed.withColumn("text", parsing.document_text(F.col("elements"))).withColumn(
        "warnings", F.when(F.col("fetched"), warned).otherwise(1)
    ).drop("elements")


def attachment_states(details: DataFrame, parsed: DataFrame | None, parse: bool = True) -> DataFrame:
    """details with a struct _s (file_count, parsed_count, warning_count, status) of their files.

    `parsed` is None when no contents can be fetched; `parse` is False when attachments are not wanted.
    """
    n = F.size("files").cast("long")
    state = lambda done, warned, status: F.struct(n.alias("file_count"), done.cast("long").alias("parsed_count"), warned.cast("long").alias("warning_count"), status.alias("status"))
    if not parse or parsed is None:
        off = "not_fetched" if not parse else "fetcher_not_configured"
        return details.withColumn("_s", state(F.lit(0), F.when((n > 0) & F.lit(parse), n).otherwise(0), F.when(n > 0, off).otherwise("none")))
    # Bodies cost far more than their bytes tell: left alone, so few tasks are made of them that some cores have none.
    files = spread(parsed.select("doc_id", (F.col("text") != "").alias("_ok"), "warnings"), "doc_id")
    done = files.groupBy("doc_id").agg(F.count_if("_ok").alias("_done"), F.sum("warnings").alias("_warned"))
    d = spread(details, "doc_id").join(by_shuffle(done), "doc_id", "left")
    ok, warned = F.coalesce("_done", F.lit(0)), F.coalesce("_warned", F.lit(0))
    status = F.when(n == 0, "none").when(ok == n, "success").when(ok > 0, "partial").otherwise("failed")
    return d.withColumn("_s", state(ok, warned, status)).drop("_done", "_warned")


def attachment_status(details: DataFrame, parsed: DataFrame | None, parse: bool = True) -> DataFrame:
    """Per document: how many files, how many parsed, warnings, and the overall status (see `attachment_states`)."""
    return attachment_states(details.select("doc_id", "files"), parsed, parse).select("doc_id", "_s.*")


def attachment_chunks(parsed: DataFrame, size: int = 1200, overlap: int = 150) -> DataFrame:
    """Fixed windows of every parsed file, with ids that name the parent document and the file."""
    w = chunking.window_chunks(parsed.filter("text <> ''"), ["doc_id", "attachment_index", "name", "url"], "text", size, overlap)
    own = F.concat("doc_id", F.lit("-attachment-"), "attachment_index")
    number = F.format_string("-chunk-%04d", "chunk_no")
    return w.select(
        own.alias("doc_id"), F.col("doc_id").alias("parent_doc_id"), "attachment_index", F.concat(own, number).alias("chunk_id"),
        F.concat(F.lit("attachment-"), "attachment_index", number).alias("block_id"), "name", "url", "text", "chunk_no", "start", "end",
    )


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_count) over all branches; attachment chunks count for their parent."""
    return chunks.groupBy(F.coalesce("parent_doc_id", "doc_id").alias("doc_id")).agg(F.count("*").alias("chunk_count"))


def outcomes(listing: DataFrame, counts: DataFrame, strict: bool = False) -> DataFrame:
    """One row per listed document: imported, skipped with its reason, or error.

    `listing` has import_id, title, error (null when the record is readable);
    `counts` has import_id, chunk_count. Strict stops at the first error.
    """
    d = listing.join(by_shuffle(counts), "import_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    if strict:
        d = d.filter(F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.lit(True)))
    status = (
        F.when(F.col("import_id").isNull(), "skipped").when(F.col("error").isNotNull(), "error").when(F.col("chunk_count") > 0, "imported").otherwise("skipped")
    )
    reason = (
        F.when(F.col("import_id").isNull(), "missing importInformationId").when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("chunk_count") == 0, "empty cleaned body")
    )
    return d.withColumn("status", status).withColumn("reason", reason)


def import_stats(docs: DataFrame, category: str, page_size: int, total: bool = False) -> DataFrame:
    """Seen, imported, skipped, chunks and pages per category; with `total` also one row for all.

    Pages are counted per category, so the total adds the categories up. The
    sums combine map-side.
    """
    per = docs.groupBy(category).agg(
        F.count("*").alias("documents_seen"), F.count_if(F.col("status") == "imported").alias("documents_imported"),
        F.count_if(F.col("status") != "imported").alias("documents_skipped"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks_stored"),
    ).withColumn("pages_read", F.greatest(F.lit(1), F.ceil(F.col("documents_seen") / page_size)))
    if not total:
        return per
    names = ("documents_seen", "documents_imported", "documents_skipped", "chunks_stored", "pages_read")
    return per.rollup(category).agg(F.count("*").alias("category_count"), *[F.sum(n).alias(n) for n in names], F.grouping(category).alias("is_total"))


def numbered_batches(chunks: DataFrame, order: list[str], batch_size: int = 16) -> DataFrame:
    """Adds position (from 1, over all chunks in the given order) and batch_no (from 0); a batch has batch_size chunks, the last one the rest."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    d = chunks.withColumn("_all", F.lit(0)).withColumn("_order", F.struct(*order))
    d = number_within(d, "_all", "_order", "position")
    return d.withColumn("batch_no", F.floor((F.col("position") - 1) / batch_size)).drop("_all", "_order")


def embed_in_batches(batched: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]], out: str = "embedding") -> DataFrame:
    """Calls an embedding function once per batch of `numbered_batches`, in the order of the positions, inside the tasks.

    Ranges of batches are dealt to the tasks, so a batch is never split; a task that is run again makes the same calls.
    """
    schema = T.StructType([*batched.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def embedded(parts: list[pd.DataFrame]) -> pd.DataFrame:
        frame = pd.concat(parts, ignore_index=True)
        got = embed(frame[text].tolist())
        if len(got) != len(frame):
            raise ValueError("chunks and embeddings must have the same length")
        return frame.assign(**{out: pd.Series(list(got), dtype=object)})

    def run(frames):
        held: list[pd.DataFrame] = []
        for frame in frames:
            for number, part in frame.groupby("batch_no", sort=False):
                if held and held[0]["batch_no"].iat[0] != number:
                    yield embedded(held)
                    held = []
                held.append(part)
        if held:
            yield embedded(held)

    return batched.repartitionByRange("batch_no").sortWithinPartitions("position").mapInPandas(run, schema)


def batch_plan(batched: DataFrame) -> DataFrame:
    """Per batch the number of its chunks and its first and last position."""
    return batched.groupBy("batch_no").agg(F.count("*").alias("batch_chunks"), F.min("position").alias("first_position"), F.max("position").alias("last_position"))
