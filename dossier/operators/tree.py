"""Section tree of policy documents.

A document stays in its row: one fold over its element array, in the Arrow pass that parses the text, keeps the open
section of every kind and gives typed lines or finished nodes. Nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.session import by_shuffle
from dossier.functions.text import cn_number, contains_any, squash, strip_heading

# Line shapes, levels and the words that mark a handling section.
NUMERALS = "一二三四五六七八九十"
MAJOR = rf"^([{NUMERALS}]{{1,3}}、)\s*(.+)$"
LEVEL = rf"^(（([{NUMERALS}]{{1,3}})）)\s*([一二三]类违规行为)\s*$"
GROUP = r"^(\d{1,2})\.\s*(?!\d)(.+)$"
LEAF = r"^(\d{1,2}\.\d{1,2})\s*(.+)$"
MAPPING = r"^(\d{1,2}\.\d{1,2})\s*([一二三]类违规行为)\s*[:：]\s*(.+)$"
LEVEL_CODES = {"一类违规行为": "category_1", "二类违规行为": "category_2", "三类违规行为": "category_3"}
ACTION_WORDS = ("处理", "处分", "处罚")


def is_action_section(title: Column) -> Column:
    return contains_any(title, ACTION_WORDS)


def ordinal_value(label: Column) -> Column:
    """Number of a label: Chinese numerals 1-99, or the last numeric part of n.m."""
    bare = F.btrim(label, F.lit("（）()、 "))
    return F.coalesce(cn_number(bare), F.regexp_extract(label, r"(\d+)\.?$", 1).try_cast("int"))


_PATTERNS = {name: re.compile(p, re.ASCII) for name, p in (("major", MAJOR), ("level", LEVEL), ("group", GROUP), ("leaf", LEAF), ("mapping", MAPPING))}
_OPENERS = frozenset(NUMERALS + "（0123456789")
_SECTION = "struct<pos:int,label:string,no:int,title:string,acts:boolean>"
LINE = f"array<struct<pos:int,text:string,element_id:string,node_type:string,major:{_SECTION},lvl:{_SECTION},grp:{_SECTION},agrp:{_SECTION}>>"
NODE = (
    "array<struct<sort_order:int,node_no:int,node_type:string,parent_order:int,parent_no:int,level:int,ordinal_label:string,title:string,tail:array<string>,"
    "violation_level:string,parent_node_type:string,parent_label:string,parent_title:string,text:string,start:int,end:int,element_ids:array<string>>>"
)


def _bare(title: str) -> str:
    """As `strip_heading`, on a plain string."""
    return " ".join(title.split()).strip(" ：:")


class _Open:
    """The open section of every kind while the lines of one document go by. A section closes the deeper ones."""

    def __init__(self):
        self.major = self.lvl = self.grp = self.agrp = None

    def take(self, pos: int, text: str) -> tuple[str | None, re.Match | None]:
        """Type of the line (None for running text) with its match, after opening what it opens."""
        section = lambda m, label, no, title: {"pos": pos, "label": label, "no": no, "title": _bare(m[title]), "acts": None}
        first = text[:1]
        if first not in _OPENERS:  # every pattern begins with one of them
            return None, None
        if m := _PATTERNS["major"].match(text):
            self.major = section(m, m[1], None, 2)
            self.major["acts"] = any(w in self.major["title"] for w in ACTION_WORDS)
            self.lvl = self.grp = self.agrp = None
            return "major_section", m
        acts = self.acts
        if acts and (m := _PATTERNS["mapping"].match(text)):
            return "action_mapping", m
        if not acts and (m := _PATTERNS["level"].match(text)):
            self.lvl, self.grp, self.agrp = section(m, m[1], None, 3), None, None
            return "violation_level", m
        if m := _PATTERNS["group"].match(text):
            opened = section(m, None, int(m[1]), 2)
            if acts:
                self.agrp = opened
                return "action_group", m
            if self.lvl:
                self.grp = opened
                return "violation_group", m
        if not acts and self.grp and (m := _PATTERNS["leaf"].match(text)):
            return "leaf_clause", m
        return None, None

    @property
    def acts(self) -> bool:
        return bool(self.major and self.major["acts"])


def _element_id(e: dict) -> str:
    return f"element-{e['pos']:04d}"


def line_sections(elements: list[dict]) -> list[dict]:
    """Every element of a document with its type and the open section of every kind."""
    now, out = _Open(), []
    for e in elements:
        kind, _ = now.take(e["pos"], e["text"])
        out.append({"pos": e["pos"], "text": e["text"], "element_id": _element_id(e), "node_type": kind, "major": now.major, "lvl": now.lvl, "grp": now.grp, "agrp": now.agrp})
    return out


def section_nodes(elements: list[dict]) -> list[dict]:
    """The nodes of a document in order, with the text and elements that belong to them. Elements come in the order of the text.

    Running text belongs to the nearest open node; leaves and mappings also extend their parent.
    """
    now, nodes, lines = _Open(), {}, {}
    for e in elements:
        pos = e["pos"]
        kind, m = now.take(pos, e["text"])
        if kind is None:
            owner = (None if now.acts else now.grp or now.lvl) or now.agrp or now.major
            if owner:
                lines[owner["pos"]].append(e)
            continue
        node = _node(kind, m, now)
        parent = node["parent_order"]
        node["sort_order"], node["node_no"], node["parent_no"] = pos, len(nodes) + 1, nodes[parent]["node_no"] if parent else None
        nodes[pos], lines[pos] = node, [e]
        if kind in ("leaf_clause", "action_mapping") and parent:
            lines[parent].append(e)
    for pos, node in nodes.items():
        own = lines[pos]
        node["text"] = " ".join((own[0]["text"] if len(own) == 1 else " ".join([x["text"] for x in own])).split())
        node["start"], node["end"] = own[0]["start"], own[-1]["end"]
        node["element_ids"] = [_element_id(x) for x in own]
    return list(nodes.values())


def _named(s: dict | None) -> str | None:
    return f"{s['no']}. {s['title']}" if s else None


def _node(kind: str, m: re.Match, now: _Open) -> dict:
    """Label, title, level, parent and path of a node that was just met."""
    major, lvl, grp, agrp = now.major, now.lvl, now.grp, now.agrp
    major_name = major["label"] + major["title"] if major else None
    if kind == "major_section":
        parent, level, label, title, tail, code = None, 1, major["label"], major["title"], [major_name], None
    elif kind == "violation_level":
        parent, level, label, title, tail = major, 2, lvl["label"], lvl["title"], [lvl["title"]]
    elif kind == "violation_group":
        parent, level, label, title, tail = lvl, 3, f"{grp['no']}.", grp["title"], [lvl["title"], _named(grp)]
    elif kind == "action_group":
        parent, level, label, title, tail, code = major, 2, f"{agrp['no']}.", agrp["title"], [major_name, _named(agrp)], None
    elif kind == "leaf_clause":
        parent, level, label, title = grp, 4, m[1], _bare(m[2])
        tail = [lvl["title"], _named(grp), f"{label} {title}"]
    else:
        parent, level, label, title = agrp or major, 3 if agrp else 2, m[1], _bare(m[2])
        tail, code = [major_name, _named(agrp), f"{label} {title}"], LEVEL_CODES.get(title)
    if kind in ("violation_level", "violation_group", "leaf_clause"):
        code = LEVEL_CODES.get(lvl["title"])
    parent_kind = {"violation_group": "violation_level", "leaf_clause": "violation_group"}.get(kind, "action_group" if kind == "action_mapping" and agrp else "major_section")
    return {
        "node_type": kind, "parent_order": parent["pos"] if parent else None, "level": level, "ordinal_label": label, "title": title, "tail": [t for t in tail if t is not None],
        "violation_level": code, "parent_node_type": parent_kind if parent else None,
        "parent_label": (parent["label"] or f"{parent['no']}.") if parent else None, "parent_title": parent["title"] if parent else None,
    }


#: What the parsers of `parsing` can derive from the elements of a row in the same pass.
TYPED_LINES = {"lines": (LINE, line_sections)}
TREE = {"nodes": (NODE, section_nodes)}


def typed_lines(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per line with node_type (null for running text) and the open section of every kind. parsed: rows with `lines` (see TYPED_LINES)."""
    return parsed.select(key, F.inline("lines"))


def tree_nodes(parsed: DataFrame, key: str = "doc_id", base: Column | None = None) -> DataFrame:
    """One row per section node with parent, level, path, text, span and elements. parsed: rows with `nodes` (see TREE)."""
    base_path = F.array().cast("array<string>") if base is None else base
    n = parsed.select(key, base_path.alias("_base"), F.inline("nodes"))
    node_id = lambda c: F.concat(F.col(key).cast("string"), F.lit(":node-"), F.format_string("%04d", c))
    return n.select(
        key, "sort_order", "node_no", "node_type", "parent_order", "level", "ordinal_label", "title", F.concat("_base", "tail").alias("heading_path"), "violation_level",
        "parent_node_type", "parent_label", "parent_title", "start", "end", "text", "element_ids", node_id(F.col("node_no")).alias("node_id"),
        F.when(F.col("parent_no").isNotNull(), node_id(F.col("parent_no"))).alias("parent_id"), ordinal_value(F.col("ordinal_label")).alias("ordinal_value"),
    )


def children_of(nodes: DataFrame, node_type: str, key: str = "doc_id") -> DataFrame:
    """Ordered children of a type per parent node: ids, labels and titles as arrays."""
    item = F.struct("sort_order", "node_id", "ordinal_label", "ordinal_value", "title")
    kids = (
        nodes.filter((F.col("node_type") == node_type) & F.col("parent_id").isNotNull())
        .groupBy(key, "parent_id").agg(F.array_sort(F.collect_list(item)).alias("kids"))
    )
    return kids.withColumnRenamed("parent_id", "node_id")


def find_first(nodes: DataFrame, node_type: str, title: str | None = None, key: str = "doc_id") -> DataFrame:
    """First node of a type, and of a title when given, per document."""
    d = nodes.filter(F.col("node_type") == node_type)
    if title is not None:
        d = d.filter(strip_heading(F.col("title")) == strip_heading(F.lit(title)))
    return d.groupBy(key).agg(F.min_by(F.struct("node_id", "title", "ordinal_label"), "sort_order").alias("n")).select(key, "n.*")


def _ordinal_counts(df: DataFrame, parent: str, ordinal: str) -> DataFrame:
    return df.filter(F.col(ordinal).isNotNull()).groupBy(F.col(parent).alias("parent"), F.col(ordinal).alias("ordinal")).agg(F.count("*").alias("n"))


def ordinal_continuity(df: DataFrame, parent: str, ordinal: str) -> DataFrame:
    """Per parent: children, distinct ordinals, how many are missing between first and last, duplicates, status.

    Two aggregations, the first per (parent, ordinal): a parent that owns a
    third of all rows is spread by ordinal before its one summary row is made.
    """
    c = _ordinal_counts(df, parent, ordinal)
    agg = c.groupBy("parent").agg(
        F.sum("n").alias("child_count"), F.count("*").alias("distinct_count"), F.min("ordinal").alias("first_ordinal"),
        F.max("ordinal").alias("last_ordinal"), F.count_if(F.col("n") > 1).alias("duplicate_count"),
    )
    gap = F.col("last_ordinal") - F.col("first_ordinal") + 1 - F.col("distinct_count")
    return agg.withColumn("missing_count", F.when(F.col("distinct_count") >= 2, gap).otherwise(0).cast("bigint")).withColumn(
        "status", F.when((F.col("missing_count") == 0) & (F.col("duplicate_count") == 0), "complete").otherwise("incomplete")
    )


def missing_ordinals(df: DataFrame, parent: str, ordinal: str, block: int = 10_000) -> DataFrame:
    """(parent, ordinal) for every number missing between the first and last ordinal of a parent.

    Wide ranges are listed block by block and looked up with an anti join on
    (parent, ordinal), so no parent's list is held in one place.
    """
    c = _ordinal_counts(df, parent, ordinal)
    lo, hi = F.col("lo"), F.col("hi")
    open_ = (
        c.groupBy("parent").agg(F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), F.count("*").alias("n"))
        .filter((F.col("n") >= 2) & (hi - lo + 1 > F.col("n")))
    )
    blocks = open_.select("parent", "lo", "hi", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((hi - lo) / block))).alias("b"))
    first = lo + F.col("b") * block
    every = blocks.select("parent", F.explode(F.sequence(first, F.least(hi.cast("bigint"), first + block - 1))).alias("ordinal"))
    return every.join(c.select("parent", F.col("ordinal").cast("bigint").alias("ordinal")), ["parent", "ordinal"], "left_anti")


def ordinal_issues(df: DataFrame, parent: str, ordinal: str) -> DataFrame:
    """duplicate_ordinal (error) per repeated value and missing_ordinal (warning) per missing value."""
    dup = _ordinal_counts(df, parent, ordinal).filter("n > 1").select(
        "parent", F.lit("duplicate_ordinal").alias("code"), F.lit("error").alias("severity"), F.col("ordinal").cast("bigint").alias("ordinal")
    )
    gone = missing_ordinals(df, parent, ordinal).select(
        "parent", F.lit("missing_ordinal").alias("code"), F.lit("warning").alias("severity"), "ordinal"
    )
    return dup.unionByName(gone)


def prefix_mismatches(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Leaves whose number does not start with their group's number. A node names its parent, so nothing is joined."""
    leaf = nodes.filter("node_type = 'leaf_clause' and instr(ordinal_label, '.') > 0 and parent_id is not null")
    own = leaf.select(key, "parent_id", "node_id", "ordinal_label", ordinal_value(F.col("parent_label")).alias("parent_value"), F.col("parent_label").alias("parent_ordinal"))
    return own.filter(F.col("parent_value").isNotNull() & (F.substring_index("ordinal_label", ".", 1) != F.col("parent_value").cast("string")))


def structure_status(documents: DataFrame, nodes: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """failed without nodes, partial with issues, else success, for every document of the list."""
    n = nodes.groupBy(key).agg(F.count("*").alias("node_count"))
    i = issues.groupBy(key).agg(F.count("*").alias("issue_count"), F.count_if(F.col("severity") == "warning").alias("warning_count"))
    d = documents.select(key).join(n, key, "left").join(i, key, "left").na.fill(0, ["node_count", "issue_count", "warning_count"])
    return d.withColumn("status", F.when(F.col("node_count") == 0, "failed").when(F.col("issue_count") > 0, "partial").otherwise("success"))


def _continuity_columns(kids: Column) -> list[Column]:
    values = F.array_sort(F.array_distinct(F.filter(F.transform(kids, lambda c: c["ordinal_value"]), lambda v: v.isNotNull())))
    all_values = F.filter(F.transform(kids, lambda c: c["ordinal_value"]), lambda v: v.isNotNull())
    missing = F.when(
        F.size(values) >= 2, F.array_except(F.sequence(F.array_min(values), F.array_max(values)), values)
    ).otherwise(F.array().cast("array<int>"))
    repeats = F.filter(values, lambda v: F.size(F.filter(all_values, lambda x: x == v)) > 1)
    return [
        F.transform(kids, lambda c: c["ordinal_label"]).alias("ordinal_sequence"),
        missing.alias("missing_ordinals"), repeats.alias("duplicate_ordinals"),
        F.when((F.size(missing) == 0) & (F.size(repeats) == 0), "complete").otherwise("incomplete").alias("ordinal_continuity_status"),
    ]


def section_children(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Listing chunk of every violation level: its title, then its ordered children."""
    heads = nodes.filter("node_type = 'violation_level'").select(key, "node_id", "title", "heading_path", "sort_order", "violation_level")
    d = heads.join(by_shuffle(children_of(nodes, "violation_group", key)), [key, "node_id"])
    lines = F.transform("kids", lambda c: F.trim(F.concat_ws(" ", c["ordinal_label"], c["title"])))
    return d.select(
        key, "node_id", F.col("title").alias("section_title"), "heading_path", "violation_level", "sort_order", lines.alias("items"),
        F.transform("kids", lambda c: c["node_id"]).alias("child_node_ids"), F.size("kids").alias("child_count"),
        squash(F.array_join(F.concat(F.array("title"), lines), " ")).alias("text"), *_continuity_columns(F.col("kids")),
    )


CHUNK_KINDS = {"violation_level": "section_definition", "leaf_clause": "leaf_clause", "action_mapping": "action_mapping"}
CHUNK = (
    "array<struct<node_no:int,chunk_type:string,text:string,tail:array<string>,section_title:string,violation_level:string,parent_node_type:string,parent_title:string,"
    "split_index:int,start:int,end:int>>"
)


def node_chunks(nodes: list[dict], size: int = 1200) -> list[dict]:
    """Chunks of the tree in reading order: definitions, listings, leaves and mappings, over-long ones sliced."""
    groups: dict[int, list[dict]] = {}
    for n in nodes:
        if n["node_type"] == "violation_group":
            groups.setdefault(n["parent_order"], []).append(n)
    out = []
    for n in nodes:
        kind = CHUNK_KINDS.get(n["node_type"])
        if kind is None:
            continue
        texts = [(kind, n["text"])]
        kids = groups.get(n["sort_order"]) if kind == "section_definition" else None
        if kids:
            texts.append(("section_children", " ".join(" ".join([n["title"], *[f"{k['ordinal_label']} {k['title']}".strip() for k in kids]]).split())))
        for kind, text in texts:
            over = len(text) > size
            slices = [p for p in (text[i : i + size].strip(" ") for i in range(0, len(text), size)) if p] if over else [p] if (p := text.strip(" ")) else []
            for i, p in enumerate(slices, 1):
                out.append({
                    "node_no": n["node_no"], "chunk_type": kind, "text": p, "tail": n["tail"], "section_title": n["title"], "violation_level": n["violation_level"],
                    "parent_node_type": n["parent_node_type"], "parent_title": n["parent_title"], "split_index": i if over else None, "start": n["start"], "end": n["end"],
                })
    return out


def node_issues(nodes: list[dict]) -> list[tuple[str, str]]:
    """(code, severity) per repeated group number, per level with missing ones, and per leaf under a group of another number."""
    by_place = {n["sort_order"]: n for n in nodes}
    number = lambda n: int(n["ordinal_label"].rstrip("."))
    siblings: dict[int, list[int]] = {}
    for n in nodes:
        if n["node_type"] == "violation_group":
            siblings.setdefault(n["parent_order"], []).append(number(n))
    out = []
    for values in siblings.values():
        out += [("duplicate_ordinal", "error")] * sum(values.count(v) > 1 for v in set(values))
        if max(values) - min(values) + 1 > len(set(values)):
            out.append(("missing_ordinal", "warning"))
    leaves = [n for n in nodes if n["node_type"] == "leaf_clause"]
    out += [("subclause_parent_prefix_mismatch", "warning") for n in leaves if n["ordinal_label"].split(".")[0] != str(number(by_place[n["parent_order"]]))]
    return out


def chunks_of(size: int = 1200) -> dict:
    """For the parsers of `parsing`: the chunks of the tree as `tree_chunks`."""
    return {"tree_chunks": (CHUNK, lambda elements: node_chunks(section_nodes(elements), size))}


def tree_chunks(parsed: DataFrame, key: str = "doc_id", base: Column | None = None) -> DataFrame:
    """Numbered chunks of the tree, one per row. parsed: rows with `tree_chunks` (see chunks_of)."""
    base_path = F.array().cast("array<string>") if base is None else base
    c = parsed.select(key, base_path.alias("_base"), F.posexplode("tree_chunks").alias("_i", "c"))
    no = F.col("_i") + 1
    return c.select(
        key, F.concat(F.col(key).cast("string"), F.lit(":node-"), F.format_string("%04d", "c.node_no")).alias("node_id"), "c.chunk_type", "c.text",
        F.concat("_base", "c.tail").alias("heading_path"), "c.section_title", "c.violation_level", "c.parent_node_type", "c.parent_title", "c.split_index",
        no.alias("chunk_no"), F.format_string("structure-chunk-%04d", no).alias("chunk_id"),
    )
