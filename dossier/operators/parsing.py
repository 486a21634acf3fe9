"""Raw HTML or text to ordered elements, kept inside the document's row.

Every step is a column expression over one row, so a parse never shuffles.
An element is a struct<pos, kind, level, rows, text, start, end, path>; start
and end are offsets into the document text, which joins all element texts by
one space.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from dossier.functions.session import map_slices
from dossier.functions.text import BLANKS, WS, let, squash

# MIME types, suffixes and warnings of the source kinds.
HTML_TYPES = ("text/html", "application/xhtml+xml")
HTML_SUFFIXES = (".html", ".htm")
TEXT_SUFFIXES = (".txt", ".md", ".markdown")
WORD_TYPES = ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/msword")
WORD_SUFFIXES = (".docx", ".doc")
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tif", ".tiff")
KIND_WARNINGS = {
    "pdf": "PDF parser is not configured. Enable Docling/PyMuPDF in the document parsing layer.",
    "docx": "DOCX parser is not configured. Enable Docling/python-docx in the document parsing layer.",
    "image": "Image OCR parser is not configured. Enable PaddleOCR or an OCR service in the document parsing layer.",
    "unsupported": "Unsupported document type. Add a parser or convert the file before ingestion.",
}
EMPTY_HTML = "HTML body produced no parseable text elements."
EMPTY_TEXT = "Plain text source produced no parseable text elements."

# Markup. ATTRS steps over quoted attribute values, which may hold a '>'.
ATTRS = r"""(?:[^>"']|"[^"]*"|'[^']*')*+"""
BLOCK = r"(?:h[1-6]|p|li|blockquote)(?=[\s/>])"
HIDDEN = r"(?is)<script\b" + ATTRS + r">.*?(?:</script\s*>|\z)|<style\b" + ATTRS + r">.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)"
TABLE = r"(?is)<table\b" + ATTRS + r">.*?</table\s*>"
# A finished table is carried through the block scan as MARK rows SEP text MARK.
MARK, SEP = "\u0001", "\u0002"
# A block runs to its own end tag or to the next block start. One that meets
# neither before the end of the page does not match and is dropped.
SCAN = (
    r"(?is)\x01[^\x01]*\x01|<(h[1-6]|p|li|blockquote)(?=[\s/>])" + ATTRS + r">.*?(?:</\1\s*>|(?=<" + BLOCK + r"))"
)
TAG = r"(?s)<[a-zA-Z/!?]" + ATTRS + r">"
PLAIN_BREAK = r"(?:\r?\n){2,}|(?<=。)" + WS + "+"

ELEMENT = T.StructType(
    [
        T.StructField("pos", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("rows", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("path", T.ArrayType(T.StringType())),
    ]
)


def detect_kind(file_name: Column, content_type: Column, content: Column | None = None) -> Column:
    """Kind of a source by MIME type, then suffix, then leading bytes; the first rule that holds wins."""
    mime = F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    base = F.regexp_extract(F.coalesce(file_name, F.lit("")), r"([^/]*)/*$", 1)
    suffix = F.lower(F.regexp_extract(base, r"[^.](\.[^.]+)$", 1))
    pdf_bytes = F.coalesce(F.hex(F.substring(content, 1, 4)) == "25504446", F.lit(False)) if content is not None else F.lit(False)
    return (
        F.when(mime.isin(*HTML_TYPES) | suffix.isin(*HTML_SUFFIXES), "html")
        .when(mime.startswith("text/") | suffix.isin(*TEXT_SUFFIXES), "text")
        .when((mime == "application/pdf") | (suffix == ".pdf") | pdf_bytes, "pdf")
        .when(mime.isin(*WORD_TYPES) | suffix.isin(*WORD_SUFFIXES), "docx")
        .when(mime.startswith("image/") | suffix.isin(*IMAGE_SUFFIXES), "image")
        .otherwise("unsupported")
    )


def _visible(c: Column) -> Column:
    """Text of a fragment: line breaks become a space, tags go, hard spaces become spaces."""
    c = F.regexp_replace(c, r"(?i)<br(?=[\s/>])" + ATTRS + ">", " ")
    c = F.regexp_replace(c, TAG, "")
    return F.regexp_replace(c, r"(?i)&(?:nbsp|#160|#xa0);", " ")


def table_mark(t: Column) -> Column:
    """A <table> fragment to its mark; block tags of the table are kept because they close open blocks."""
    rows = F.transform(
        F.regexp_extract_all(t, F.lit(r"(?is)<tr\b" + ATTRS + r">.*?</tr\s*>"), F.lit(0)),
        lambda r: F.transform(
            F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b" + ATTRS + r">(.*?)</t[dh]\s*>"), F.lit(1)),
            lambda c: squash(_visible(c)),
        ),
    )
    tags = F.array_join(F.regexp_extract_all(t, F.lit(r"(?is)</?" + BLOCK + ATTRS + ">"), F.lit(0)), "")

    def mark(kept: Column) -> Column:
        text = F.array_join(F.transform(kept, lambda r: F.array_join(r, " | ")), " ")
        return F.concat(tags, F.lit(MARK), F.size(kept).cast("string"), F.lit(SEP), text, F.lit(MARK))

    return let(F.filter(rows, lambda r: F.exists(r, lambda c: c != "")), mark)


def _with_table_marks(page: Column) -> Column:
    marked = let(
        F.regexp_extract_all(page, F.lit(TABLE), F.lit(0)),
        lambda ts: F.concat_ws(
            "", F.transform(F.split(page, TABLE), lambda a, i: F.concat(a, F.coalesce(table_mark(F.get(ts, i)), F.lit(""))))
        ),
    )
    return F.when(F.contains(F.lower(page), F.lit("<table")), marked).otherwise(page)


def _candidate(kind, level, rows, text) -> Column:
    """A candidate element as one string: kind, level, table rows and raw text between separators."""
    return F.concat_ws(SEP, kind, level, rows, text)


def _blocks(page: Column) -> Column:
    """Candidates of a page, tables ahead of the block that surrounds them."""
    empty = F.lit("")

    def parts(m: Column) -> Column:
        marks = F.transform(
            F.regexp_extract_all(m, F.lit(r"\x01([^\x01]*)\x01"), F.lit(1)), lambda s: F.concat(F.lit("table" + SEP + SEP), s)
        )
        level = F.regexp_extract(m, r"^<[hH]([1-6])", 1)
        block = lambda raw: F.array(_candidate(F.when(level == "", F.lit("paragraph")).otherwise(F.lit("title")), level, empty, _visible(raw)))
        with_marks = F.when(m.startswith("<"), F.concat(marks, block(F.regexp_replace(m, r"\x01[^\x01]*\x01", "")))).otherwise(marks)
        return F.when(F.contains(m, F.lit(MARK)), with_marks).otherwise(block(m))

    return F.flatten(F.transform(F.regexp_extract_all(page, F.lit(SCAN), F.lit(0)), parts))


def _plain(raw: Column) -> Column:
    """Paragraphs of a page without blocks: blank lines and sentence ends split, tags become spaces."""
    texts = F.transform(F.split(raw, PLAIN_BREAK), lambda p: F.regexp_replace(p, r"<[^>]+>", " "))
    return F.transform(texts, lambda t: _candidate(F.lit("plain"), F.lit(""), F.lit(""), t))


def _decoded(page: list[str]):
    """Kind, level, rows and text of the candidates that hold text, with entities decoded and blanks collapsed."""
    for item in page:
        kind, level, rows, text = item.split(SEP, 3)
        if "&" in text:
            text = _html.unescape(text)
            if kind in ("title", "paragraph"):  # block text is decoded by the page reader and once more
                text = _html.unescape(text)
        text = " ".join(text.split())
        if text:
            yield kind, level, rows, text


def _finish(candidates: list[list[str]]) -> list:
    """Decode entities, collapse blanks, drop empty elements, then number, place and title the rest.

    A heading at level L ends the open headings at level L or deeper.
    """
    out = []
    for page in candidates:
        done, at, open_heads = [], 0, {}
        for kind, level, rows, text in _decoded(page):
            if kind == "title":
                open_heads = {k: v for k, v in open_heads.items() if k < level} | {level: text}
            done.append(
                {
                    "pos": len(done) + 1,
                    "kind": "paragraph" if kind == "plain" else kind,
                    "level": int(level) if level else None,
                    "rows": int(rows) if rows else None,
                    "text": text,
                    "start": at,
                    "end": at + len(text),
                    "path": list(open_heads.values()),
                }
            )
            at += len(text) + 1
        out.append(done)
    return out


def _with_elements(df: DataFrame, source: str, candidates: Column, out: str | None, derive: dict | None = None, cut=None) -> DataFrame:
    """Replaces the source column by the finished element array, in Arrow batches.

    derive: further columns that functions make from the elements of a row in the same pass, name -> (type as DDL, function).
    Without `out` only these are kept. cut: what makes the candidates of a row in that pass, if the column sent is not yet an array of them.
    """
    keys = [c for c in df.columns if c != source]
    derive = derive or {}
    own = [T.StructField(out, T.ArrayType(ELEMENT))] if out else []
    made = [T.StructType.fromDDL(f"`{n}` {t}")[0] for n, (t, _) in derive.items()]
    schema = T.StructType([df.schema[c] for c in keys] + own + made)

    types = [to_arrow_type(f.dataType) for f in own + made]

    def finished(batch: pa.RecordBatch) -> pa.RecordBatch:
        sent = batch["_candidates"].to_pylist()
        elements = _finish([cut(x) for x in sent] if cut else sent)
        values = [elements] if out else []
        values += [[make(e) for e in elements] for _, make in derive.values()]
        kept = [batch[c] for c in keys]
        return pa.RecordBatch.from_arrays(kept + [pa.array(v, t) for v, t in zip(values, types)], names=schema.names)

    return map_slices(df.select(*keys, candidates.alias("_candidates")), finished, schema)


def _html_candidates(html: Column) -> Column:
    raw = F.coalesce(html, F.lit(""))
    shown = let(F.regexp_replace(raw, HIDDEN, ""), _with_table_marks)
    blank = SEP + r"[" + BLANKS + r"]*$"
    return let(_blocks(shown), lambda b: F.when(F.exists(b, lambda e: ~e.rlike(blank)), b).otherwise(_plain(raw)))


def _one(text: Column) -> Column:
    return F.array(_candidate(F.lit("plain"), F.lit(""), F.lit(""), F.coalesce(text, F.lit(""))))


def html_elements(df: DataFrame, html: str = "html", out: str | None = "elements", derive: dict | None = None) -> DataFrame:
    """Replaces an HTML column by its element array; plain paragraphs when the page has no blocks."""
    return _with_elements(df, html, _html_candidates(F.col(html)), out, derive)


def html_texts(df: DataFrame, html: str = "html") -> DataFrame:
    """Replaces an HTML column by its document text, the spans of its elements in it (starts, ends) and its number of tables."""
    keys = [c for c in df.columns if c != html]
    more = T.StructType.fromDDL("text string, starts array<int>, ends array<int>, table_count int")
    schema = T.StructType([df.schema[c] for c in keys] + more.fields)

    def joined(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, starts, ends, tables, offsets = [], [], [], [], [0]
        for page in batch["_candidates"].to_pylist():
            kept, at, n = [], 0, 0
            for kind, _, _, text in _decoded(page):
                kept.append(text)
                starts.append(at)
                at += len(text)
                ends.append(at)
                at += 1
                n += kind == "table"
            texts.append(" ".join(kept))
            tables.append(n)
            offsets.append(len(starts))
        at = pa.array(offsets, pa.int32())
        places = [pa.ListArray.from_arrays(at, pa.array(v, pa.int32())) for v in (starts, ends)]
        made = [pa.array(texts, pa.string()), *places, pa.array(tables, pa.int32())]
        return pa.RecordBatch.from_arrays([batch[c] for c in keys] + made, names=schema.names)

    return map_slices(df.select(*keys, _html_candidates(F.col(html)).alias("_candidates")), joined, schema)


def plain_elements(df: DataFrame, text: str = "text", out: str = "elements") -> DataFrame:
    """Replaces text without markup by one paragraph per blank-line or sentence break."""
    return _with_elements(df, text, _plain(F.coalesce(F.col(text), F.lit(""))), out)


def text_elements(df: DataFrame, text: str = "text", out: str = "elements") -> DataFrame:
    """A text document is one paragraph, or nothing when it is blank."""
    t = squash(F.coalesce(F.col(text), F.lit("")))
    one = F.array(
        F.struct(
            F.lit(1).alias("pos"), F.lit("paragraph").alias("kind"), F.lit(None).cast("int").alias("level"),
            F.lit(None).cast("int").alias("rows"), t.alias("text"), F.lit(0).alias("start"), F.length(t).alias("end"),
            F.array().cast("array<string>").alias("path"),
        )
    )
    return df.withColumn(out, F.filter(one, lambda e: e["text"] != "")).drop(text)


def _line_candidates(text: str) -> list[str]:
    """The lines of a text. They are cut here, as a text takes less room in an Arrow batch than an array of its candidates."""
    return [SEP.join(("plain", "", "", line)) for line in re.split(r"\r?\n", text)]


def line_elements(df: DataFrame, text: str = "text", out: str | None = "elements", derive: dict | None = None) -> DataFrame:
    """Replaces text by one paragraph element per non-blank line."""
    return _with_elements(df, text, F.coalesce(F.col(text), F.lit("")), out, derive, cut=_line_candidates)


def explode_elements(df: DataFrame, keys: list[str], elements: str = "elements") -> DataFrame:
    return df.select(*keys, F.inline(elements)).select(
        *keys,
        F.format_string("element-%04d", F.col("pos")).alias("element_id"),
        "pos", "kind", "level", F.col("rows").alias("row_count"), "text", F.col("path").alias("heading_path"), "start", "end",
    )


def document_text(elements: Column) -> Column:
    return F.array_join(F.transform(elements, lambda e: e["text"]), " ")


def parse_quality(df: DataFrame, keys: list[str], kind: Column | None = None, elements: str = "elements") -> DataFrame:
    """One report row per document, read off its element array (no aggregation, empty documents included)."""
    k = F.lit("html") if kind is None else kind
    n = F.size(elements)
    warning = F.lit(None).cast("string")
    for name, text in {"html": EMPTY_HTML, "text": EMPTY_TEXT}.items():
        warning = F.when((k == name) & (n == 0), F.lit(text)).otherwise(warning)
    for name, text in KIND_WARNINGS.items():
        warning = F.when(k == name, F.lit(text)).otherwise(warning)
    parser = F.when(k == "html", "html_builtin").when(k == "text", "text_builtin").otherwise(F.concat(F.lit("unsupported_"), k))
    return df.select(
        *keys,
        parser.alias("parser_name"),
        F.when(n > 0, "success").otherwise("failed").alias("status"),
        n.cast("bigint").alias("element_count"),
        F.size(F.filter(elements, lambda e: e["kind"] == "table")).cast("bigint").alias("table_count"),
        F.when(warning.isNotNull(), 1).otherwise(0).cast("bigint").alias("warning_count"),
        F.coalesce(warning, F.lit("")).alias("warnings"),
    )


def parse_sources(df: DataFrame, file_name: str, content_type: str, text: str, out: str = "elements") -> DataFrame:
    """Routes every source by kind: html, text, or a failed row with no elements."""
    d = df.withColumn("kind", detect_kind(F.col(file_name), F.col(content_type)))
    candidates = (
        F.when(F.col("kind") == "html", _html_candidates(F.col(text)))
        .when(F.col("kind") == "text", _one(F.col(text)))
        .otherwise(F.array().cast("array<string>"))
    )
    return _with_elements(d, text, candidates, out)
