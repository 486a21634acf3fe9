"""Nothing grows in the driver or in a Python worker with the rows of a table."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dossier.functions.session import SLICE_ROWS, map_slices
from dossier.operators import chunking, ingest, parsing, tree
from dossier.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["d9_prefix_mismatch", "d12_section_children", "e3_attachment_status", "e3_attachment_chunks", "e1_chunk_metadata", "e1_detail_chunks", "e6_branch_outcomes", "e6_outcomes"])
def test_derived_rows_are_not_broadcast(spark, name):
    assert "Broadcast" not in plan_of(QUERIES[name](spark, SF))


def test_prefix_mismatches_join_nothing(spark):
    lines = "\n".join(["四、违规行为", "（一）一类违规行为", "1. 甲", "1.1 对", "2.2 错", "2. 乙", "2.1 对"])
    d = spark.createDataFrame([(7, lines)], "doc_id long, text string")
    nodes = tree.tree_nodes(parsing.line_elements(d, out=None, derive=tree.TREE))
    found = tree.prefix_mismatches(nodes)
    assert "Join" not in plan_of(found)
    assert [(r.doc_id, r.ordinal_label, r.parent_ordinal) for r in found.collect()] == [(7, "2.2", "1.")]


def test_parsed_rows_come_in_small_pieces(spark):
    d = spark.range(5 * SLICE_ROWS + 1, numPartitions=1).select("id", F.lit("<h1>a</h1><p>b</p>").alias("html"))

    def sizes(batch):
        return pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    assert sorted(r.n for r in map_slices(d, sizes, "n long").collect()) == [1] + [SLICE_ROWS] * 5
    parsed = parsing.html_elements(d)
    assert "MapInPandas" not in plan_of(parsed)
    assert parsed.filter("size(elements) = 2").count() == 5 * SLICE_ROWS + 1


def test_coverage_comes_in_small_pieces(spark):
    d = spark.range(3).selectExpr("id", "'ab cd' as text", "array(named_struct('start', 0, 'end', 2)) as spans")
    found = chunking.char_coverage(d, ["id"], "text", "spans")
    assert "ArrowEvalPython" not in plan_of(found)
    assert {(r.source_char_count, r.covered_char_count, r.uncovered_ranges[0].text) for r in found.collect()} == {(4, 2, "cd")}


def test_a_cut_off_entity_is_decoded(spark):
    """As html.parser and html.unescape do: an entity of old HTML needs no semicolon."""
    d = spark.createDataFrame([(1, "<h1>a &amp b&amp;&amp</h1>")], "id long, html string")
    assert [e.text for r in parsing.html_elements(d).collect() for e in r.elements] == ["a & b&&"]


@pytest.mark.parametrize("name", ["c8_clause_groups", "c19_structure_report", "e1_chunk_metadata"])
def test_no_null_lists_go_to_python(spark, monkeypatch, name):
    """The Arrow writer goes over all of them after every row."""
    frame, seen = type(spark.range(1)), []
    send = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **k: (seen.append(self), send(self, *a, **k))[1])
    QUERIES[name](spark, SF)
    for rows in seen:
        lists = [f.name for f in rows.schema if f.dataType.typeName() == "array"]
        assert not lists or rows.filter(" or ".join(f"`{n}` is null" for n in lists)).count() == 0
    assert any("starts" in rows.columns for rows in seen)


def test_an_empty_path_stays_empty(spark):
    """A unit may name an empty path, which is not the same as none."""
    unit = "named_struct('chunk_type', 'a', 'start', 0, 'text', 'x', 'section', 's', 'title', null, 'clause_no', null, 'level', null, 'role', 'coverage', 'path', {}, 'semantic', null, 'language', 'zh', 'split', null, 'end', 1)"
    units = f"cast(array({unit.format('array()')}, {unit.format('null')}, {unit.format(chr(97) + 'rray(' + repr('p') + ')')}) as {chunking.UNIT})"
    part = f"named_struct('kind', 'front', 'off', 0, 'body', '-', 'units', {units}, 'starts', null, 'ends', null)"
    d = spark.range(1).selectExpr("id", "'n' as name", f"cast(array({part}) as {chunking.PART}) as parts")
    assert [r.heading_path for r in chunking.part_chunks(d, ["id"], "parts", "name").orderBy("chunk_no").collect()] == [["n"], ["n", "s"], ["n", "p"]]


def test_blank_units_give_no_chunk_and_are_squashed_once(spark):
    unit = "named_struct('chunk_type', 'a', 'start', 0, 'text', {}, 'section', 's', 'title', null, 'clause_no', null, 'level', null, 'role', 'coverage', 'path', null, 'semantic', null, 'language', 'zh', 'split', null, 'end', null)"
    units = f"cast(array({', '.join(unit.format(x) for x in (chr(39) + ' a  b ' + chr(39), 'null', chr(39) * 2, chr(39) + '  ' + chr(39), chr(39) + 'c' + chr(39)))}) as {chunking.UNIT})"
    part = f"named_struct('kind', 'front', 'off', 5, 'body', '-', 'units', {units}, 'starts', null, 'ends', null)"
    d = spark.range(1).selectExpr("id", "'n' as name", f"cast(array({part}) as {chunking.PART}) as parts")
    chunks = chunking.part_chunks(d, ["id"], "parts", "name")
    assert [(r.chunk_no, r.text, r.start, r.end) for r in chunks.orderBy("chunk_no").collect()] == [(1, "a b", 0, 6), (2, "c", 0, 1)]
    plan = QUERIES["c9_action_clauses"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Filter" in x and "regexp_replace" in x]


def test_markers_check_a_character_before_they_look_behind():
    for p in (chunking.ZH_MAJOR, chunking.ZH_GROUP, chunking.SUBCLAUSE, chunking.EN_MAJOR, chunking.EN_GROUP):
        assert p.removeprefix("(?i)").startswith("(?=")
    for numeral in "ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ":
        assert chunking.marker_start(f"x {numeral}. Purpose") == 2 and chunking.marker_start(f"x{numeral}. Purpose") is None
    assert chunking.marker_start("axi. purpose of EMPLOYEE") is None and chunking.marker_start("- xi. purpose") == 2
    for numeral in chunking.NUMERALS:
        assert re.search(chunking.ZH_MAJOR, f"x {numeral}、总则").start() == 2 and not re.search(chunking.ZH_MAJOR, f"（{numeral}、总则")


@pytest.mark.parametrize("name", ["c7_category_overview", "c8_clause_groups", "c13_role_defaults"])
def test_a_policy_text_stays_in_one_row_until_it_is_cut(spark, monkeypatch, name):
    """Sections and units are not exploded on the way to the cutter: two rows a document, its Chinese and its English text."""
    frame, seen = type(spark.range(1)), []
    send = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **k: (seen.append(self), send(self, *a, **k))[1])
    QUERIES[name](spark, SF)
    assert [rows.count() for rows in seen] == [2 * spark.read.parquet(f"{SF}/customer.parquet").count()]


def test_units_of_odd_policy_texts():
    units = lambda kind, text: [(u[0], u[1], u[2], u[4], u[5], u[6]) for u in chunking.policy_units(kind, text, 10)]
    assert units("zh", "  ") == [] and units("zh", "no Chinese") == [] and units("zh", "五、违规行为相应处理") == []
    assert units("zh", "前言 四、违规行为 （一）一类违规行为 说明 1. 甲  乙： 1.1 情形。 2.丙丁 2.1 x") == [
        (10, "前言", "document_intro", None, None, None), (13, "四、违规行为 （一）一类违规行为 说明 1. 甲 乙 2. 丙丁", "violation_category_overview", None, None, "category_1"),
        (33, "1. 甲  乙： 1.1 情形。", "clause_group", "1. 甲 乙", "1", "category_1"), (50, "2.丙丁 2.1 x", "clause_group", "2. 丙丁", "2", "category_1"),
    ]
    assert units("en", "IV. Violations none") == [(10, "IV. Violations none", "english_section", None, None, None)]


@pytest.mark.parametrize("name", ["d1_line_types", "d2_open_sections", "d3_node_text", "d4_node_identity", "d5_action_sections", "d12_section_children", "d13_leaf_and_mapping"])
def test_texts_go_to_the_tree_as_they_are(spark, monkeypatch, name):
    """Not as an array with a mark in front of every line, which fills an Arrow batch and with it a Python worker."""
    frame, seen = type(spark.range(1)), []
    send = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **k: (seen.append(self), send(self, *a, **k))[1])
    QUERIES[name](spark, SF)
    assert seen and all(rows.schema["_candidates"].dataType.typeName() == "string" for rows in seen)


def test_lines_of_odd_texts(spark):
    d = spark.createDataFrame([(1, "a\r\n\n b &amp;\x02c\r\nd\re\n"), (2, None), (3, "\n")], "id long, text string")
    assert {r.id: [(e.pos, e.text, e.start) for e in r.elements] for r in parsing.line_elements(d).collect()} == {1: [(1, "a", 0), (2, "b &\x02c", 2), (3, "d e", 8)], 2: [], 3: []}


def test_a_batch_is_let_go_before_the_next_one_is_read():
    import weakref

    from dossier.functions.session import slices

    held = []

    def batches():
        for i in range(3):
            assert not [r for r in held if r()]
            batch = pa.RecordBatch.from_arrays([pa.array([i] * 3)], names=["n"])
            held.append(weakref.ref(batch))
            yield batch
            del batch

    assert [b.num_rows for b in slices(batches(), 2)] == [2, 1] * 3


@pytest.mark.parametrize("name", ["e1_detail_chunks", "e1_chunk_metadata", "e6_branch_outcomes"])
def test_a_body_stays_in_one_row_until_its_chunks_are_numbered(spark, monkeypatch, name):
    """One row a document goes to the pass that cuts it, not one a unit with the metadata of the document."""
    frame, seen = type(spark.range(1)), []
    send = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **k: (seen.append(self), send(self, *a, **k))[1])
    QUERIES[name](spark, SF)
    assert [rows.count() for rows in seen if "starts" in rows.columns] == [spark.read.parquet(f"{SF}/customer.parquet").count()]


def test_the_right_metadata_is_made_once(spark):
    m = ingest.merged_metadata(F.create_map(F.lit("a"), F.col("id").cast("string"), F.lit("b"), F.lit(None).cast("string")), F.create_map(F.lit("c"), F.concat(F.lit("right"), "id")))
    d = spark.range(2).select("id", m.alias("m"))
    assert d._jdf.queryExecution().optimizedPlan().toString().count("right") == 1
    assert {r.id: r.m for r in d.collect()} == {0: {"a": "0", "c": "right0"}, 1: {"a": "1", "c": "right1"}}


def test_chunks_of_odd_bodies():
    """A mark without chunks gives windows; a long clause is cut and keeps its range; the tree follows."""
    def made(lines, size=1200):
        page = [parsing.SEP.join(("paragraph", "", "", x)) for x in lines]
        elements = parsing._finish([page])[0]
        text, units = " ".join(e["text"] for e in elements), tree.node_chunks(tree.section_nodes(elements), size)
        return chunking.document_chunks(text, [e["start"] for e in elements], [e["end"] for e in elements], elements, units, size, 5)

    names = [n for n, _ in chunking.CHUNK_FIELDS]
    assert made([]) == ([], False) and made([" "]) == ([], False)
    assert [c[1:5] for c in made(["四、违规行为"])[0]] == [(0, 6, "四、违规行为", None)]
    assert [c[1:5] for c in made(["x" * 12], 10)[0]] == [(0, 10, "x" * 10, None), (5, 12, "x" * 7, None)]
    long = [dict(zip(names, c)) for c in made(["四、违规行为", "（一）一类违规行为", "1. 甲", "1.1 情形一。", "1.2 情形二。"], 12)[0]]
    groups = [c for c in long if c["chunk_type"] == "clause_group"]
    assert [c["split_index"] for c in groups] == [1, 2, 3] and {c["clause_range"] for c in groups} == {"1.1-1.2"} and groups[0]["first_element"] == 3
    assert [c["chunk_type"] for c in long if c["tree"]] == ["section_definition", "section_children", "leaf_clause", "leaf_clause"]
