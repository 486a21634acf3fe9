"""Texts to chunks: fixed windows, bounded parts, policy sections and coverage reports.

Chunks of a document come from one row and stay in its order: rows are only ever exploded, and the pass that cuts
long units counts along. So numbering needs no shuffle.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from dossier.functions import spans
from dossier.functions.session import filled_lists, slices
from dossier.functions.text import CJK, explode_once, language_of, let, squash, strip_heading

# Headings, levels and chunk types of the policy layout.
# Patterns look at the first character before they look behind it: a look-behind at every place of a text costs most of a search.
NUMERALS = "一二三四五六七八九十"
ZH_MAJOR = rf"(?=[一-四])(?=[{NUMERALS}])(?<![（(])[{NUMERALS}]{{1,3}}、\s*[^\s，。；;：:]{{1,40}}"
ZH_CATEGORY = rf"（[{NUMERALS}]{{1,3}}）\s*[一二三]类违规行为"
ZH_GROUP = r"(?=\d)(?<![\d.])\d{1,2}\.\s*(?!\d)[^。；;\d]{2,80}?(?=[:：]|\s+\d+\.\d)"
SUBCLAUSE = r"(?=\d)(?<!\d)\d{1,2}\.\d{1,2}"
EN_TITLE_CORE = r"(?i)(?=E)\bEmployee\s+Disciplinary\s+Rules\b"
EN_MAJOR = (
    r"(?i)(?=[IVXⅠ-Ⅹ])(?<![A-Za-z0-9])(?:[IVX]+|[Ⅰ-Ⅹ]+)\.?\s+(?:Purpose|Scope of Application"
    r"|Code of Professional Conduct for Teachers|Violations|Applicable Disciplinary Actions against Violations"
    r"|Management Responsibility|Determination of Violations and Disciplinary Process|Others|Appendix)"
)
EN_CATEGORY = r"(?i)\([IVX]+\)\s+Category\s+[123]\s+Violation"
EN_GROUP = r"(?=\d)(?<![\d.])\d{1,2}\.\s+(?!\d)[A-Z][^:：。；;\d]{2,160}?(?=[:：.]|\s+\d{1,2}\.\d{1,2})"
DATETIME = r"\b\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\b"
LEVELS = {"一类违规行为": "category_1", "二类违规行为": "category_2", "三类违规行为": "category_3"}
RETRIEVAL_TYPES = (
    "section_overview", "violation_category_overview", "clause_group", "action_clause", "disciplinary_rule",
    "policy_clause_group", "english_category_overview", "english_clause_group", "english_action_clause",
)

GROUP_TYPES = ("clause_group", "policy_clause_group", "english_clause_group")

# What becomes a chunk, or several if it is long. path, semantic, language, split and end are null where they follow from the rest.
_UNIT_FIELDS = (
    ("chunk_type", "string"), ("start", "int"), ("text", "string"), ("section", "string"), ("title", "string"), ("clause_no", "string"), ("level", "string"),
    ("role", "string"), ("path", "array<string>"), ("semantic", "string"), ("language", "string"), ("split", "int"), ("end", "int"),
)
UNIT = f"array<struct<{','.join(f'{n}:{t}' for n, t in _UNIT_FIELDS)}>>"
#: Fields of a unit that its chunks keep, by their names there.
_UNIT_COLUMNS = {"chunk_type": "chunk_type", "section_title": "section", "group_title": "title", "clause_no": "clause_no", "violation_level": "level", "chunk_role": "role"}
# A stretch of one document that is chunked in one way: `head` has the whole text and the element spans and gives no
# chunk; `zh` and `en` are cut by sections, `window` by size; `front` and `tree` bring their units.
PART = f"array<struct<kind:string,off:int,body:string,units:{UNIT},starts:array<int>,ends:array<int>>>"


def window_chunks(df: DataFrame, keys: list[str], text: str = "text", size: int = 1200, overlap: int = 150) -> DataFrame:
    """Fixed windows of the squashed text; one row per window with its span and its number."""
    cut = spans.cutter(size, overlap, spans.WINDOW_STOPS)
    d = df.select(*keys, squash(text).alias("_t")).select(*keys, F.posexplode(cut("_t")).alias("i", "w"))
    return d.select(
        *keys,
        F.format_string("chunk-%04d", F.col("i") + 1).alias("chunk_id"), (F.col("i") + 1).alias("chunk_no"),
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col("w.text").alias("text"),
    )


def bounded_parts(df: DataFrame, keys: list[str], text: str = "text", size: int = 1200) -> DataFrame:
    """Parts without overlap; a text that fits stays whole and carries no split number."""
    cut = spans.cutter(size, None, spans.PART_STOPS)
    d = df.withColumn("_t", squash(text)).withColumn("_over", F.length("_t") > size)
    d = d.select(*keys, "_over", F.posexplode(cut("_t")).alias("i", "w"))
    return d.select(
        *keys,
        F.when(F.col("_over"), F.col("i") + 1).alias("split_index"),
        F.when(F.col("_over"), "exceeds_max_chars").alias("split_reason"),
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col("w.text").alias("text"),
    )


def hard_slices(df: DataFrame, keys: list[str], text: str = "text", size: int = 1200) -> DataFrame:
    """Slices of exactly `size` characters; blank slices are dropped and not counted."""
    n = F.length(text)
    cuts = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(n / size).cast("int") - 1, F.lit(0))),
        lambda i: F.trim(F.substring(F.col(text), i * size + 1, F.lit(size))),
    )
    parts = F.filter(cuts, lambda p: p != "")
    over = n > size
    d = df.select(*keys, over.alias("_over"), F.posexplode(parts).alias("i", "text"))
    return d.select(*keys, F.when(F.col("_over"), F.col("i") + 1).alias("split_index"), "text")


def clause_range(text: Column, clause_no: Column) -> Column:
    """First and last sub-number of a clause, e.g. 4.1-4.3."""
    subs = F.regexp_extract_all(text, F.concat(F.lit(r"(?<!\d)"), clause_no, F.lit(r"\.(\d+)")), F.lit(1))
    return let(
        subs,
        lambda s: F.when(F.size(s) == 1, F.concat(clause_no, F.lit("."), F.get(s, F.lit(0)))).when(
            F.size(s) > 1,
            F.concat(clause_no, F.lit("."), F.get(s, F.lit(0)), F.lit("-"), clause_no, F.lit("."), F.get(s, F.size(s) - 1)),
        ),
    )


def role_columns(df: DataFrame) -> DataFrame:
    """Default role, priority and index scope from the chunk type, where a role is not set already."""
    role = F.coalesce("chunk_role", F.when(F.col("chunk_type").isin(*RETRIEVAL_TYPES), "retrieval").otherwise("coverage"))
    d = df.withColumn("chunk_role", role)
    kept = F.col("chunk_role") == "retrieval"
    return d.withColumn("retrieval_priority", F.when(kept, "high").otherwise("low")).withColumn(
        "index_scope", F.when(kept, "main").otherwise("coverage")
    )


ZH = {
    "major": ZH_MAJOR, "category": ZH_CATEGORY, "category_title": "[一二三]类违规行为", "group": ZH_GROUP,
    "overview_type": "violation_category_overview", "group_type": "clause_group", "section_type": "policy_section", "joins_bare_intro": False,
}
EN = {
    "major": EN_MAJOR, "category": EN_CATEGORY, "category_title": r"(?i)Category\s+[123]\s+Violation", "group": EN_GROUP,
    "overview_type": "english_category_overview", "group_type": "english_clause_group", "section_type": "english_section", "joins_bare_intro": True,
}


def policy_sections(df: DataFrame, keys: list[str], text: str, pack: dict, offset: Column | None = None) -> DataFrame:
    """One row per major section; section 0 is the preface before the first heading."""
    at = (F.lit(0) if offset is None else offset).alias("_o")
    d = explode_once(df, [*keys, at], spans.segments(F.col(text), pack["major"]), "section_no", "s")
    heading = strip_heading(F.regexp_extract("s.text", "^" + pack["major"], 0))
    return d.select(
        *keys, "section_no", (F.col("s.start") + F.col("_o")).alias("start"), F.col("s.text").alias("text"),
        F.when(F.col("section_no") > 0, heading).alias("heading"),
    ).filter("section_no > 0 or trim(text) <> ''")


def _part(kind: str, off: Column, body: Column) -> Column:
    none = lambda t: F.lit(None).cast(t)
    return F.struct(F.lit(kind).alias("kind"), off.cast("int").alias("off"), body.alias("body"), none(UNIT).alias("units"), none("array<int>").alias("starts"), none("array<int>").alias("ends"))


def text_parts(t: Column) -> Column:
    """Chinese body and English tail of a text that begins with its body."""
    both = lambda at: F.array(_part("zh", F.lit(0), F.substring(t, F.lit(1), at)), _part("en", at, F.substring(t, at + 1, F.length(t))))
    return let(english_tail_start(t), lambda at: F.when(at < 0, F.array(_part("zh", F.lit(0), t))).otherwise(both(at)))


# Up to nine words in front of the fixed ones, read backwards from them.
EN_TITLE_LEAD = r"^((?:\s+[A-Za-z&'.-]*[A-Za-z]\b){0,9})"


def _before(text: Column, pattern: str) -> Column:
    """What precedes the first match. `split` would compile the pattern for every row; a replacement keeps it."""
    return F.regexp_replace(text, f"(?s)(?:{pattern}).*", "")


def _title_start(text: Column) -> Column:
    """Start of the first English title: the fixed words and up to nine words in front of them.

    The fixed words are found first; the words in front of them are matched on
    the reversed text, which stops after nine words whatever their length.
    """
    return let(_before(text, EN_TITLE_CORE), lambda b: F.length(b) - F.length(F.regexp_extract(F.reverse(b), EN_TITLE_LEAD, 1)))


def english_tail_start(text: Column) -> Column:
    """0-based start of the first English marker after the Chinese body, -1 when there is none."""
    first = F.least(_title_start(text), F.length(_before(text, f"{EN_MAJOR}|{EN_CATEGORY}")))
    return let(first, lambda at: F.when(at < F.length(text), at).otherwise(F.lit(-1)))


def policy_chunks(df: DataFrame, keys: list[str], text: str = "text", name: str = "source_name", size: int = 1200) -> DataFrame:
    """Structured chunks of policy documents: Chinese body, English tail, numbered per row of df.

    `df` holds whole document texts from the body start on. Long units are cut into parts.
    """
    return part_chunks(df.select(*keys, name, text_parts(F.col(text)).alias("_parts")), keys, "_parts", name, size).drop("kind", "first_element", "last_element", "semantic_type")


def part_chunks(df: DataFrame, keys: list[str], parts: str, name: str, size: int = 1200, overlap: int = 150) -> DataFrame:
    """Chunks of documents given as parts (see PART), numbered from 1 in the order of the parts.

    If neither `zh` nor `en` gives a chunk, the text of `head` is cut into windows instead. first_element and
    last_element number the elements under each chunk (null: no head, or none there).
    """
    d = df.withColumn("_row", F.monotonically_increasing_id())
    k = [*dict.fromkeys([*keys, name]), "_row"]
    d = explode_once(d, k, F.col(parts), "_i", "p").select(*k, F.col("p.kind").alias("kind"), F.col("p.off").alias("_o"), F.col("p.body").alias("body"), "p.units", "p.starts", "p.ends")
    k += ["kind"]
    # The units of zh and en texts are made where they are cut and counted; all others come as rows.
    sections = F.col("kind").isin("zh", "en")
    text = F.struct(*[F.col("_o").alias(n) if n == "start" else F.col("body").alias(n) if n == "text" else F.lit(None).cast(t).alias(n) for n, t in _UNIT_FIELDS])
    window = text.withField("chunk_type", F.lit("fixed_window"))
    cells = F.when(sections, F.array(text)).when(F.col("kind").isin("head", "window"), F.array(window)).otherwise(F.col("units"))
    d = explode_once(d.filter("trim(body) <> ''"), [*k, "starts", "ends"], cells, "unit_no", "u")
    raw = F.col("u.text")
    units = d.select(
        *k, "starts", "ends", F.col("u.start").alias("start"), F.col("u.end").alias("end"),
        *[F.col(f"u.{n}").alias(c) for c, n in _UNIT_COLUMNS.items()], F.col("u.path").alias("_path"), F.col("u.path").isNotNull().alias("_named"),
        F.col("u.semantic").alias("semantic_type"), F.coalesce(F.col("u.language"), F.when(sections, F.col("kind"))).alias("language"), F.col("u.split").alias("_split"),
        # Blank units give no piece when they are cut; a filter here would squash every text twice.
        F.when(sections, raw).otherwise(F.coalesce(squash("u.text"), F.lit(""))).alias("_t"), F.coalesce(F.length(raw), F.lit(0)).alias("_raw_size"),
    )
    rows = role_columns(_cut_and_numbered(filled_lists(units, "_path", "starts", "ends"), size, overlap))
    title = F.when(F.col("chunk_type").isin("action_clause", "english_action_clause"), _action_title()).otherwise(F.col("group_title"))
    own = F.array_compact(F.array(F.col("section_title"), title))
    path = F.when(F.col("kind").isin("head", "window"), F.array(F.col(name))).otherwise(F.concat(F.array_compact(F.array(F.col(name))), F.when(F.col("_named"), F.col("_path")).otherwise(own)))
    grouped = F.col("chunk_type").isin(*GROUP_TYPES)
    return rows.select(
        *keys, F.col("chunk_no").cast("int").alias("chunk_no"), F.format_string("chunk-%04d", F.col("chunk_no")).alias("chunk_id"),
        F.col("piece").alias("text"), path.alias("heading_path"), "chunk_type", "language", "section_title", "group_title", "clause_no",
        F.when(grouped, clause_range(F.col("_t"), F.col("clause_no"))).alias("clause_range"), "violation_level", "chunk_role", "retrieval_priority", "index_scope",
        F.coalesce(F.col("_split"), F.col("part_no")).alias("split_index"), "start", "end", "kind", "semantic_type", "first_element", "last_element",
    )


class _Document:
    """What the numbering pass knows about the document whose rows go by."""

    def __init__(self, row: int):
        self.row, self.number, self.structured = row, 0, False
        self.head: pa.RecordBatch | None = None
        self.starts = self.ends = None

    def elements(self, start: int, end: int) -> tuple[int | None, int | None]:
        if self.starts is None:
            return None, None
        first, last = int(np.searchsorted(self.ends, start, side="right")) + 1, int(np.searchsorted(self.starts, end, side="left"))
        return (first, last) if first <= last else (None, None)


#: What only the cutter needs.
_CUT_ONLY = ["_row", "starts", "ends", "_raw_size"]
#: What the cutter makes for every piece. _t is the text of the unit, kept where its sub-numbers are looked up.
_CUT_COLUMNS = (
    ("start", pa.int32()), ("end", pa.int32()), ("piece", pa.string()), ("part_no", pa.int32()), ("chunk_no", pa.int64()), ("first_element", pa.int32()),
    ("last_element", pa.int32()), *((c, pa.string()) for c in _UNIT_COLUMNS), ("_t", pa.string()),
)


def _cut_and_numbered(units: DataFrame, size: int, overlap: int) -> DataFrame:
    """Cuts the units of each document and counts its pieces; the rows of a document (_row) follow each other.

    A row of kind zh or en is a whole text, whose units are made here, so that a document stays in one row until it is cut.
    """
    spans.check_sizes(size, overlap)
    made = [n for n, _ in _CUT_COLUMNS]
    kept = [c for c in units.columns if c not in (*_CUT_ONLY, *made)]
    schema = T.StructType([*(units.schema[c] for c in kept), *(T.StructField(n, from_arrow_type(t)) for n, t in _CUT_COLUMNS)])

    def run(batches):
        doc = None

        def finished(source: pa.RecordBatch, taken: list) -> pa.RecordBatch:
            at, *more = zip(*taken)
            out = source.select(kept).take(pa.array(at, pa.int64()))
            return pa.RecordBatch.from_arrays([*out.columns, *(pa.array(v, t) for v, (_, t) in zip(more, _CUT_COLUMNS))], names=schema.names)

        def taken_from(doc: _Document, i: int, kind: str, text: str, start: int, end: int | None, raw_size: int, unit: tuple):
            window = kind in ("window", "head")
            pieces = spans.cut_text(text, size, overlap, spans.WINDOW_STOPS) if window else spans.cut_text(text, size, None, spans.PART_STOPS)
            over = len(text) > size
            unit = (*unit, text if unit[0] in GROUP_TYPES else None)
            for n, p in enumerate(pieces, 1):
                whole = not over and not window
                a, b = (start, start + raw_size if end is None else end) if whole else (start + p["start"], start + p["end"])
                doc.number += 1
                yield (i, a, b, p["text"], n if over and not window else None, doc.number, *doc.elements(a, b), *unit)

        def fallback(doc: _Document):
            """The windows of a document whose sections gave nothing."""
            if doc is not None and doc.head is not None and not doc.structured:
                doc.structured = True
                unit = tuple(doc.head[c][0].as_py() for c in _UNIT_COLUMNS)
                one = list(taken_from(doc, 0, "head", doc.head["_t"][0].as_py(), 0, None, 0, unit))
                if one:
                    yield finished(doc.head, one)

        for batch in slices(batches):
            taken: list = []
            columns = [batch[c].to_pylist() for c in ("_row", "kind", "_t", "start", "end", "_raw_size", *_UNIT_COLUMNS)]
            for i, (row, kind, text, start, end, raw_size, *unit) in enumerate(zip(*columns)):
                if doc is None or row != doc.row or (kind == "tree" and not doc.structured):
                    waiting = list(fallback(doc))
                    if waiting:
                        if taken:
                            yield finished(batch, taken)
                            taken = []
                        yield from waiting
                    if doc is None or row != doc.row:
                        doc = _Document(row)
                if kind == "head":
                    doc.head = batch.slice(i, 1)
                    doc.starts, doc.ends = (np.asarray(batch[c][i].as_py(), np.int64) for c in ("starts", "ends"))
                    continue
                before = doc.number
                if kind in ("zh", "en"):
                    for a, raw, *unit in policy_units(kind, text, start):
                        t = " ".join(raw.split())
                        if len(t) > size:
                            taken.extend(taken_from(doc, i, kind, t, a, None, len(raw), unit))
                        elif t:
                            doc.number += 1
                            taken.append((i, a, a + len(raw), t, None, doc.number, *doc.elements(a, a + len(raw)), *unit, t if unit[0] in GROUP_TYPES else None))
                else:
                    taken.extend(taken_from(doc, i, kind, text, start, end, raw_size, unit))
                doc.structured |= doc.number > before
            if taken:
                yield finished(batch, taken)
        yield from fallback(doc)

    return units.mapInArrow(run, schema)


def _action_title() -> Column:
    zh_name = F.lit(None).cast("string")
    for title, code in LEVELS.items():
        zh_name = F.when(F.col("violation_level") == code, F.lit(title)).otherwise(zh_name)
    en_name = F.concat(F.lit("Category "), F.substring("violation_level", -1, 1), F.lit(" Violation"))
    named = F.when(F.col("language") == "zh", zh_name).otherwise(en_name)
    return F.when(F.col("violation_level").isNull(), F.col("clause_no")).otherwise(F.concat_ws(" ", "clause_no", named))


_ZH_BODY = re.compile(f"{ZH_MAJOR}|{ZH_CATEGORY}", re.ASCII)
_TITLE, _EN_MAJOR, _EN_CATEGORY, _DATETIME, _LEAD = (re.compile(p, re.ASCII) for p in (EN_TITLE_CORE, EN_MAJOR, EN_CATEGORY, DATETIME, EN_TITLE_LEAD))
_HAN = re.compile("[\u4e00-\u9fff]")
# Headings of the front matter and the path each kind goes under.
MISSION_EN = "Mission, Educational Goal and Vision"
FRONT_PATHS = {"summary": ["摘要"], "mission_zh": ["使命、培养目标和愿景"], "mission_en": [MISSION_EN], "policy_intro": ["引言"], "document_intro": ["文档背景"], "document_metadata": ["文档时间"]}


@functools.cache
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.ASCII)


def _bare(t: str) -> str:
    """As `strip_heading`, on a plain string."""
    return " ".join(t.split()).strip(" ：:")


def _pieces(text: str, pattern: str) -> list[tuple[int, str, str]]:
    """As `spans.segments`, on a plain string: start, text and the marker that the text begins with."""
    marks = [(m.start(), m[0]) for m in _compiled(pattern).finditer(text)]
    ends = [at for at, _ in marks] + [len(text)]
    return [(0, text[: ends[0]], ""), *((at, text[at:end], mark) for (at, mark), end in zip(marks, ends[1:]))]


def _found(pattern: str, text: str, group: int = 0) -> str:
    m = _compiled(pattern).search(text)
    return m[group] if m else ""


def _group_unit(start: int, text: str, mark: str, kind: str, section: str, level: str | None) -> tuple:
    no, _, title = mark.partition(".")
    return start, text.strip(" "), kind, section, f"{no}. {_bare(title)}", no, level, None


def _zh_level(text: str) -> str | None:
    return next((code for title, code in LEVELS.items() if title in text), None)


def _en_level(text: str) -> str | None:
    return "category_" + m[1] if (m := _compiled(r"(?i)Category\s+([123])\s+Violation").search(text)) else None


# A unit is a tuple: start, text, chunk type, section, group title, clause number, level, role.
def _category_units(text: str, start: int, heading: str, pack: dict) -> list[tuple]:
    """Overview and clause groups of every category; a group never crosses its category."""
    out = []
    for i, (at, body, mark) in enumerate(_pieces(text, pack["category"])[1:]):
        title = _bare(_found(pack["category_title"], mark))
        level = _zh_level(title) if pack is ZH else "category_" + _found(r"(\d)", title)
        (_, intro, _), *groups = _pieces(body, pack["group"])
        units = [_group_unit(start + at + a, g, m, pack["group_type"], title, level) for a, g, m in groups]
        names = [*([heading] if i == 0 else []), intro, *(u[4] for u in units)]
        out += [(start if i == 0 else start + at, " ".join(" ".join(names).split()), pack["overview_type"], title, None, None, level, None), *units]
    return out


def _action_units(text: str, start: int, heading: str, pack: dict) -> list[tuple]:
    """The intro of the section and one unit per numbered action."""
    (_, lead, _), *actions = _pieces(text, SUBCLAUSE)
    intro, out = lead.strip(" "), []
    # An English intro that only repeats the heading goes to the first action.
    joined = pack["joins_bare_intro"] and _bare(intro) == heading
    if actions and intro and not joined:
        out.append((start, intro, pack["section_type"], heading, None, None, None, None))
    for i, (at, p, no) in enumerate(actions):
        first = joined and i == 0
        level = (_zh_level if pack is ZH else _en_level)(p)
        kind = "english_action_clause" if pack is EN else "action_clause" if level else "disciplinary_rule"
        out.append((start if first else start + at, (lead + p if first else p).strip(" "), kind, heading, no, no, level, None))
    return out


def _generic_units(text: str, start: int, heading: str, pack: dict) -> list[tuple]:
    """Clause groups of any section; without groups the section is one unit."""
    (_, lead, _), *groups = _pieces(text, pack["group"])
    if not groups:
        return [(start, text.strip(" "), pack["section_type"], heading, None, None, None, None)]
    out = [(start, lead.strip(" "), pack["section_type"], heading, None, None, None, "coverage")] if lead.strip(" ") else []
    return out + [_group_unit(start + at, g, mark, "policy_clause_group", heading, None) for at, g, mark in groups]


def _zh_section(text: str, start: int, h: str, body: str) -> list[tuple]:
    if h.startswith("四、") and "违规行为" in h:
        return _category_units(text, start, h, ZH)
    if h.startswith("五、") and "违规行为相应处理" in h:
        return _action_units(text, start, h, ZH)
    if h.startswith("九、") or "附件" in h:
        return [(start, text.strip(" "), "appendix", h, None, None, None, None)]
    return _generic_units(text, start, h, ZH) if body else []


def _en_section(text: str, start: int, h: str, body: str) -> list[tuple]:
    low, plain = h.lower(), [(start, text.strip(" "), "english_section", h, None, None, None, None)]
    if "disciplinary actions" in low:
        return _action_units(text, start, h, EN)
    if low.endswith("violations"):
        return _category_units(text, start, h, EN) or plain
    return plain if body else []


def policy_units(kind: str, text: str, off: int) -> list[tuple]:
    """Units of a Chinese (zh) or English (en) policy text that begins at offset `off`, section by section."""
    pack, section = (ZH, _zh_section) if kind == "zh" else (EN, _en_section)
    (_, preface, _), *majors = _pieces(text, pack["major"])
    out, shown = [], preface.strip(" ")
    if shown and kind == "en":
        out.append((off, shown, "english_section", "English", None, None, None, None))
    elif _HAN.search(shown):
        out.append((off, shown, "document_intro", "文档背景", None, None, None, None))
    for at, t, mark in majors:
        out += section(t, off + at, _bare(mark), t[len(mark) :].strip(" "))
    return out


def _is_mission_zh(t: str) -> bool:
    return bool(_HAN.search(t)) and "使命" in t and "愿景" in t and "摘要" not in t


def _is_mission_en(t: str) -> bool:
    return MISSION_EN in t


def _is_intro(t: str) -> bool:
    return bool(_HAN.search(t)) and "员工纪律制度" in t and ("引 言" in t or "引言" in t)


def title_start(text: str) -> int | None:
    """Start of the first English title: the fixed words and up to nine words in front of them."""
    m = _TITLE.search(text)
    return m.start() - len(_LEAD.match(text[: m.start()][::-1])[1]) if m else None


def marker_start(text: str) -> int | None:
    """Start of the first English marker of a text."""
    found = [m.start() for m in (_EN_MAJOR.search(text), _EN_CATEGORY.search(text)) if m]
    title = title_start(text)
    return min(found + [title] if title is not None else found, default=None)


def policy_bounds(elements: list[dict]) -> tuple[int | None, int | None]:
    """Offsets of the Chinese body and of the English tail in the document text; None where there is none."""
    body = next((i for i, e in enumerate(elements) if _ZH_BODY.search(e["text"])), None)
    for e in elements[0 if body is None else body + 1 :]:
        at = marker_start(e["text"])
        if at is not None:
            return None if body is None else elements[body]["start"], e["start"] + at
    return None if body is None else elements[body]["start"], None


def front_runs(elements: list[dict]) -> list[dict]:
    """Runs ahead of the policy body as kind, run, piece and span: a mission or intro heading opens a run that only its stop markers end."""
    kinds = (("mission_zh", _is_mission_zh, (_is_mission_en, _is_intro)), ("mission_en", _is_mission_en, (_is_intro,)), ("policy_intro", _is_intro, (_is_mission_zh, _is_mission_en)))
    out, run, stops = [], 0, ()
    for e in elements:
        t = e["text"]
        if stops and not any(stop(t) for stop in stops):
            out[-1]["end"] = e["end"]
            continue
        run, stops = run + 1, ()
        if "[摘要]" in t or _TITLE.search(t):
            out += [{"run": run, "piece_no": n, "kind": k, "start": e["start"] + a, "end": e["start"] + b} for n, (k, a, b) in enumerate(_top_pieces(t)) if t[a:b].strip()]
            continue
        if not _HAN.search(t) and t.startswith("We are a group of people"):
            kind = "summary"
        else:
            kind, stops = next(((k, ends) for k, holds, ends in kinds if holds(t)), ("document_intro", ()))
        out.append({"run": run, "piece_no": 0, "kind": kind, "start": e["start"], "end": e["end"]})
    return out


def _top_pieces(t: str) -> list[tuple[str, int, int]]:
    """A title element to title, time stamp and summary pieces."""
    summary = t.find("[摘要]") if "[摘要]" in t else len(t)
    date = _DATETIME.search(t[:summary])
    title_end = date.start() if date else summary
    english = title_start(t[:title_end])
    titles = [("title", 0, title_end)] if english is None else [("title_zh", 0, english), ("title_en", english, title_end)]
    return titles + ([("document_metadata", date.start(), date.end())] if date else []) + ([("summary", summary, len(t))] if summary < len(t) else [])


def _language(t: str) -> str:
    """As `language_of`, on a plain string."""
    return "zh" if _HAN.search(t) else "en" if re.search("[A-Za-z]", t) else "neutral"


def front_units(elements: list[dict], text: str, stop: int) -> list[dict]:
    """Units of the front matter that ends at offset `stop` of the document text."""
    out = []
    for r in front_runs([e for e in elements if e["start"] < stop and e["end"] <= stop]):
        body = text[r["start"] : r["end"]]
        kind = r["kind"].split("_")[0] if r["kind"].startswith(("title", "mission")) else r["kind"]
        language = r["kind"][-2:] if r["kind"] in ("title_zh", "title_en", "mission_zh", "mission_en") else {"policy_intro": "zh", "document_metadata": "neutral"}.get(r["kind"]) or _language(body)
        chunk_type = {"title": "document_intro", "mission": "mission_section"}.get(kind, kind)
        if r["kind"] == "summary":
            language = "zh" if body.startswith("[摘要]") else "en"
        out.append(
            {"chunk_type": chunk_type, "start": r["start"], "end": r["end"], "text": body, "role": "coverage", "language": language,
             "path": FRONT_PATHS.get(r["kind"], []), "semantic": "document_title" if kind == "title" else None}
        )
    return out


def front_matter(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Typed runs ahead of the policy body, one row per run and piece. parsed: rows with `front` (see FRONT)."""
    return parsed.select(*keys, F.inline("front"))


def _front(elements: list[dict]) -> list[dict]:
    """Runs of the front matter with their texts."""
    text = " ".join(e["text"] for e in elements)
    body, tail = policy_bounds(elements)
    # Without a Chinese body the front ends with the element before the one that opens the English tail.
    stop = body if body is not None else next((e["start"] for e in elements if tail is not None and e["start"] <= tail < e["end"]), len(text) + 1 if tail is None else tail)
    front = [e for e in elements if e["end"] <= stop]
    return [r | {"text": text[r["start"] : r["end"]]} for r in front_runs(front)]


#: For the parsers of `parsing`: derived from the elements of a row in the same pass.
FRONT = {"front": ("array<struct<run:int,piece_no:int,kind:string,start:int,end:int,text:string>>", _front)}


#: A chunk as `document_chunks` gives it. tail is the path below the document, tree tells the chunks of the section tree.
CHUNK_FIELDS = (
    ("tree", "boolean"), ("start", "int"), ("end", "int"), ("text", "string"), ("split_index", "int"), ("first_element", "int"), ("last_element", "int"), ("chunk_type", "string"),
    ("section_title", "string"), ("group_title", "string"), ("clause_no", "string"), ("violation_level", "string"), ("chunk_role", "string"), ("language", "string"),
    ("semantic_type", "string"), ("clause_range", "string"), ("tail", "array<string>"),
)


def _range_of(text: str, clause_no: str) -> str | None:
    """As `clause_range`, on plain strings."""
    subs = _compiled(rf"(?<!\d){clause_no}\.(\d+)").findall(text)
    return None if not subs else f"{clause_no}.{subs[0]}" if len(subs) == 1 else f"{clause_no}.{subs[0]}-{clause_no}.{subs[-1]}"


def _action_name(kind: str, clause_no: str | None, level: str | None) -> str | None:
    """As `_action_title`, on plain strings."""
    if level is None:
        return clause_no
    name = _LEVEL_NAMES.get(level) if kind == "zh" else f"Category {level[-1]} Violation"
    return " ".join(x for x in (clause_no, name) if x is not None)


_LEVEL_NAMES = {code: title for title, code in LEVELS.items()}
_RETRIEVAL = frozenset(RETRIEVAL_TYPES)


def document_chunks(text: str, starts: list[int], ends: list[int], elements: list[dict], tree_units: list[dict], size: int, overlap: int) -> tuple[list[tuple], bool]:
    """All chunks of a parsed document as tuples of CHUNK_FIELDS, and whether it has marks of a policy.

    Front matter, Chinese body and English tail come first; if they give nothing, or there are no marks, windows of the
    text. The units of the section tree follow. The elements of a document do not overlap.
    """
    out: list[tuple] = []

    def add(t: str, start: int, end: int, unit: tuple, tail: list[str], tree=False, language=None, semantic=None, split=None, window=False):
        chunk_type, section, title, clause_no, level, role = unit
        role = role or ("retrieval" if chunk_type in _RETRIEVAL else "coverage")
        clauses = _range_of(t, clause_no) if clause_no is not None and chunk_type in GROUP_TYPES else None
        if len(t) <= size and not window:
            pieces = ((start, end, t, split),) if t else ()
        else:
            cut = spans.cut_text(t, size, overlap, spans.WINDOW_STOPS) if window else spans.cut_text(t, size, None, spans.PART_STOPS)
            pieces = [(start + p["start"], start + p["end"], p["text"], split if window or split is not None else n) for n, p in enumerate(cut, 1)]
        for a, b, piece, no in pieces:
            first, last = bisect_right(ends, a) + 1, bisect_left(starts, b)
            if first > last:
                first = last = None
            out.append((tree, a, b, piece, no, first, last, chunk_type, section, title, clause_no, level, role, language, semantic, clauses, tail))

    if not text:
        return out, False
    body, tail = policy_bounds(elements)
    marked = body is not None or tail is not None
    if marked:
        stop = body if body is not None else next(e["start"] for e in elements if e["start"] <= tail < e["end"])
        for u in front_units(elements, text, stop) if stop else []:
            add(" ".join(u["text"].split()), u["start"], u["end"], (u["chunk_type"], None, None, None, None, u["role"]), u["path"], language=u["language"], semantic=u["semantic"])
        for kind, a, b in (("zh", body, tail), ("en", tail, None)):
            raw = text[a:b] if a is not None else ""
            bare = raw.strip()
            for at, t, chunk_type, section, title, clause_no, level, role in policy_units(kind, bare, a + len(raw) - len(raw.lstrip())) if bare else []:
                name = _action_name(kind, clause_no, level) if chunk_type in ("action_clause", "english_action_clause") else title
                path = [section, name] if name is not None and section is not None else [x for x in (section, name) if x is not None]
                add(" ".join(t.split()), at, at + len(t), (chunk_type, section, title, clause_no, level, role), path, language=kind)
    if not out:
        add(text, 0, 0, ("fixed_window", None, None, None, None, None), [], window=True)
    for u in tree_units:
        add(" ".join(u["text"].split()), u["start"], u["end"], (u["chunk_type"], u["section_title"], None, None, u["violation_level"], None), u["tail"], tree=True, split=u["split_index"])
    return out, marked


def chunk_array(documents: list[list[tuple]], kind: pa.ListType) -> pa.Array:
    """Chunks of several documents as one array column (kind: of structs of CHUNK_FIELDS); every field is made as one flat column."""
    columns = list(zip(*(c for d in documents for c in d))) or [()] * len(CHUNK_FIELDS)
    ends = np.concatenate(([0], np.cumsum([len(d) for d in documents]))).astype(np.int32)
    fields = list(kind.value_type)
    flat = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(columns, fields)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(ends), flat, type=kind)


def _element_ids(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.transform(F.sequence(first, last), lambda i: F.format_string("element-%04d", i))).otherwise(F.array().cast("array<string>"))


def provenance(df: DataFrame, keys: list[str], chunks: str, elements: str = "elements") -> DataFrame:
    """One row per chunk with its fields, its ordered element_ids and the range of their numbers (null: none).

    `chunks` is an array of structs with start and end, `elements` the element array of the same row, so a chunk
    meets its elements where the document was parsed.
    """
    e, c = F.col(elements), F.col(chunks)
    under = spans.elements_under(e["start"], e["end"], c["start"], c["end"])
    d = df.select(*keys, c.alias("_c"), under.alias("_r")).select(*keys, F.inline(F.arrays_zip("_c", "_r")))
    some = F.col("_r.first") <= F.col("_r.last")
    return d.select(*keys, "_c.*", _element_ids(F.col("_r.first"), F.col("_r.last")).alias("element_ids"), F.when(some, F.col("_r.first")).alias("range_start"), F.when(some, F.col("_r.last")).alias("range_end"))


def provenance_of_rows(chunks: DataFrame, elements: DataFrame, keys: list[str], chunk_key: str, width: int = 4096) -> DataFrame:
    """`provenance` for chunks and elements that come as rows, as of texts that do not fit a row; chunks without elements go."""
    e = elements.select(*keys, "element_id", "pos", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    pairs = spans.overlap_join(chunks.select(*keys, chunk_key, "start", "end"), e, keys, width)
    return pairs.groupBy(*keys, chunk_key).agg(
        F.transform(F.array_sort(F.collect_set(F.struct("pos", "element_id"))), lambda x: x["element_id"]).alias("element_ids"),
        F.min("pos").alias("range_start"), F.max("pos").alias("range_end"),
    )


def char_coverage(df: DataFrame, keys: list[str], text: str, chunk_spans: str) -> DataFrame:
    """Coverage report per document from its text and its array of chunk spans."""
    d = spans.covered_rows(df, keys, text, chunk_spans, "c")
    return d.select(
        *keys,
        F.when(F.col("c.uncovered") == 0, "complete").otherwise("partial").alias("coverage_status"),
        F.col("c.source").alias("source_char_count"), F.col("c.covered").alias("covered_char_count"),
        F.col("c.uncovered").alias("uncovered_char_count"),
        F.when(F.col("c.source") > 0, F.col("c.covered") / F.col("c.source")).otherwise(1.0).alias("coverage_ratio"),
        F.col("c.first_ranges").alias("uncovered_ranges"),
    )


def element_coverage(df: DataFrame, keys: list[str], chunks: str, elements: str = "elements") -> DataFrame:
    """Covered and uncovered elements of each row, and the first 20 uncovered ones. Columns as in `provenance`.

    A row without elements counts as complete.
    """
    e, c = F.col(elements), F.col(chunks)
    under = F.filter(spans.elements_under(e["start"], e["end"], c["start"], c["end"]), lambda r: r["first"] <= r["last"])
    # Ranges in order; each adds what reaches beyond the ones before it.
    open_ = F.array().cast("array<struct<first:int,last:int>>")
    step = lambda a, r: F.struct(
        F.greatest(a["to"], r["last"]).alias("to"),
        F.when(r["first"] > a["to"] + 1, F.concat(a["gaps"], F.array(F.struct((a["to"] + 1).alias("first"), (r["first"] - 1).alias("last"))))).otherwise(a["gaps"]).alias("gaps"),
    )
    start = F.struct(F.lit(0).alias("to"), open_.alias("gaps"))
    n = F.size(elements)
    end = lambda a: F.when(a["to"] < n, F.concat(a["gaps"], F.array(F.struct((a["to"] + 1).alias("first"), n.alias("last"))))).otherwise(a["gaps"])
    d = df.select(*keys, e.alias("_e"), F.aggregate(F.array_sort(under), start, step, end).alias("_gaps"))
    bare = F.aggregate("_gaps", F.lit(0), lambda a, g: a + g["last"] - g["first"] + 1).cast("long")
    d = d.select(*keys, "_e", "_gaps", F.size("_e").cast("long").alias("n"), bare.alias("u"))
    first = F.slice(F.flatten(F.transform("_gaps", lambda g: F.sequence(g["first"], F.least(g["last"], g["first"] + 19)))), 1, 20)
    shown = F.transform(first, lambda i: F.struct(F.format_string("element-%04d", i).alias("element_id"), i.alias("index"), F.substring(F.get("_e", i - 1)["text"], 1, 120).alias("preview")))
    return d.select(
        *keys, F.when(F.col("u") == 0, "complete").otherwise("partial").alias("element_coverage_status"), F.col("n").alias("source_element_count"),
        (F.col("n") - F.col("u")).alias("covered_element_count"), F.col("u").alias("uncovered_element_count"),
        F.when(F.col("n") > 0, (F.col("n") - F.col("u")) / F.col("n")).otherwise(1.0).alias("element_coverage_ratio"), shown.alias("uncovered_elements"),
    )


def orphan_title(text: Column, path: Column, role: Column, chunk_type: Column, semantic: Column) -> Column:
    """A non-retrieval chunk that only repeats its last heading."""
    t = strip_heading(text)
    skip = (F.coalesce(semantic, F.lit("")) == "document_title") | (F.coalesce(chunk_type, F.lit("")) == "document_metadata")
    same = t == strip_heading(F.get(path, F.size(path) - 1))
    return F.coalesce(~skip & (F.coalesce(role, F.lit("")) != "retrieval") & (t != "") & same, F.lit(False))


def mixed_language(text: Column, language: Column, semantic: Column) -> Column:
    zh = (language == "zh") & text.rlike(CJK) & text.rlike("[A-Za-z]{3,}") & (F.coalesce(semantic, F.lit("")) != "document_title")
    return F.coalesce(zh | ((language == "en") & text.rlike(CJK)), F.lit(False))


def structure_report(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Role, language and provenance counts per document. Expects chunk rows with `element_count`."""
    kept = F.col("chunk_role") == "retrieval"
    bare = F.col("element_count") == 0
    none = F.lit(None).cast("string")
    return chunks.groupBy(*keys).agg(
        F.count_if(kept).alias("retrieval_chunk_count"),
        F.count_if(F.col("chunk_role") == "coverage").alias("coverage_chunk_count"),
        F.count_if(kept & (F.col("language") == "en")).alias("english_retrieval_chunk_count"),
        F.count_if(orphan_title(F.col("text"), F.col("heading_path"), F.col("chunk_role"), F.col("chunk_type"), none)).alias("orphan_title_count"),
        F.count_if(mixed_language(F.col("text"), F.col("language"), none)).alias("mixed_language_chunk_count"),
        F.count_if(bare).alias("provenance_missing_count"),
        F.count_if(kept & bare).alias("retrieval_provenance_missing_count"),
    )


def has_policy_structure(text: Column) -> Column:
    return text.rlike("|".join([ZH_MAJOR, ZH_CATEGORY])) | text.rlike(EN_TITLE_CORE) | text.rlike(EN_MAJOR) | text.rlike(EN_CATEGORY)


def strategy(text: Column) -> Column:
    """Which chunker a document takes, with the reason for the fallback."""
    t = squash(text)
    marked = has_policy_structure(t)
    return F.struct(
        F.when(t == "", "failed").otherwise("success").alias("status"),
        F.when(t == "", "none").when(marked, "policy_clause_group").otherwise("fixed_window_fallback").alias("strategy"),
        F.when(t == "", "empty_parsed_text").when(marked, None).otherwise("no_policy_structure_detected").alias("fallback_reason"),
        F.when(t == "", None).when(marked, "high").otherwise("low").alias("boundary_confidence"),
    )


def rollups(chunks: DataFrame) -> DataFrame:
    """Chunk counts by type, language and role in one pass."""
    d = chunks.select("chunk_type", "language", "chunk_role")
    return (
        d.groupingSets([["chunk_type"], ["language"], ["chunk_role"]], "chunk_type", "language", "chunk_role")
        .agg(F.count("*").alias("n"), F.grouping("chunk_type").alias("g1"), F.grouping("language").alias("g2"))
        .select(
            F.when(F.col("g1") == 0, "chunk_type").when(F.col("g2") == 0, "language").otherwise("chunk_role").alias("dimension"),
            F.coalesce("chunk_type", "language", "chunk_role").alias("value"), "n",
        )
    )
