"""Chunks of whole detail records: numbers, fallback, provenance, attachments; a document never leaves its row."""

import pytest
from pyspark.sql import functions as F

from dossier.functions import spans
from dossier.operators import chunking, ingest, parsing, tree

POLICY = ["一、总则", "本制度适用于全体员工。", "四、违规行为", "（一）一类违规行为", "一类违规行为：指性质恶劣的行为。", "1. 师德行为", "1.1 情形一。", "2.1 情形二。", "3. 保密行为", "五、违规行为相应处理", "1.1一类违规行为：解除劳动合同。"]
FILE = "array<map<string,string>>"


def page(lines):
    return "".join(f"<p>{x}</p>" for x in lines)


def details(spark, rows):
    return spark.createDataFrame(rows, f"doc_id string, title string, category_name string, body string, files {FILE}, metadata map<string,string>")


def chunks(spark, rows, **more):
    d = ingest.detail_chunks(details(spark, [(*r, None, None) if len(r) == 4 else r for r in rows]), **more)
    return sorted(d.collect(), key=lambda r: (r.doc_id, r.chunk_no))


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_body_then_tree_in_one_sequence(spark):
    got = chunks(spark, [("d1", "纪律", "人事", page(POLICY))])
    assert [r.chunk_no for r in got] == list(range(1, len(got) + 1))
    kinds = [(r.branch, r.chunk_type) for r in got]
    assert kinds[:2] == [(1, "policy_section"), (1, "violation_category_overview")] and kinds[-1] == (0, "action_mapping")
    assert [k for b, k in kinds if b == 0] == ["section_definition", "section_children", "leaf_clause", "leaf_clause", "action_mapping"]
    assert got[0].heading_path == ["人事", "纪律", "一、总则"] and got[0].element_ids == ["element-0001", "element-0002"]
    m = got[0].metadata
    # Group numbers 1 and 3, and one leaf numbered for another group: two issues.
    assert (m["structure_status"], m["structure_issue_count"], m["chunking_strategy"], m["parse_element_count"]) == ("partial", "2", "policy_clause_group", "11")
    assert got[0].block_id == "policy_section-0001" and got[-1].chunk_id == f"d1-chunk-{len(got):04d}"


def test_marks_without_chunks_fall_back_to_windows(spark):
    got = chunks(spark, [("d1", "t", None, page(["四、违规行为"])), ("d2", "t", None, page(["x" * 50])), ("d3", "t", None, "<p> </p>"), ("d4", None, None, None)])
    assert [(r.doc_id, r.chunk_no, r.chunk_type, r.text) for r in got] == [("d1", 1, "fixed_window", "四、违规行为"), ("d2", 1, "fixed_window", "x" * 50)]
    assert got[0].element_ids == ["element-0001"] and (got[0].start, got[0].end) == (0, 6)


def test_numbers_go_on_over_arrow_batches_and_repeated_ids(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [("d1", "t", "c", page(POLICY)), ("d1", "t", "c", page(POLICY)), ("d2", "t", "c", page(["a" * 3000]))]
        got = ingest.detail_chunks(details(spark, [(*r, None, None) for r in rows]).coalesce(1)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    numbers = [r.chunk_no for r in got if r.doc_id == "d1"]
    half = len(numbers) // 2
    assert numbers[:half] == numbers[half:] == list(range(1, half + 1))
    assert [(r.chunk_no, len(r.text)) for r in got if r.doc_id == "d2"] == [(1, 1200), (2, 1200), (3, 900)]


def test_front_matter_comes_first(spark):
    front = ["员工手册 Staff Employee Disciplinary Rules 2024-01-02 03:04:05 [摘要] 说明", "使命、培养目标和愿景", "使命内容"]
    got = chunks(spark, [("d1", "t", None, page(front + POLICY))])
    assert [(r.chunk_type, r.metadata["language"], r.heading_path) for r in got[:5]] == [
        ("document_intro", "zh", ["t"]), ("document_intro", "en", ["t"]), ("document_metadata", "neutral", ["t", "文档时间"]), ("summary", "zh", ["t", "摘要"]),
        ("mission_section", "zh", ["t", "使命、培养目标和愿景"]),
    ]
    assert got[4].text == "使命、培养目标和愿景 使命内容" and got[4].element_ids == ["element-0002", "element-0003"] and got[0].metadata["semantic_type"] == "document_title"


def test_attachments_have_ids_of_their_own_and_their_state_is_told(spark):
    files = [{"fileName": "a.txt", "downloadUrl": "u/1"}, {"fileName": "b.txt", "downloadUrl": "u/2"}]
    rows = [("d1", "t", "c", page(["body"]), files, {"k": "v"}), ("d2", "t", "c", page(["body"]), None, None)]
    contents = spark.createDataFrame([("u/1", "attached text")], "url string, text string")
    got = chunks(spark, rows, contents=contents, parse_attachments=True)
    assert [(r.doc_id, r.parent_doc_id, r.branch, r.text) for r in got] == [("d1", None, 1, "body"), ("d1-attachment-1", "d1", 2, "attached text"), ("d2", None, 1, "body")]
    assert [r.metadata["attachment_parse_status"] for r in got] == ["partial", "partial", "none"]
    assert got[1].heading_path == ["c", "t", "a.txt"] and got[1].metadata["k"] == "v" and got[1].metadata["source"] == "company_policy_attachment"
    assert [r.metadata["attachment_parse_status"] for r in chunks(spark, rows)] == ["not_fetched", "none"]
    counts = ingest.chunk_counts(ingest.detail_chunks(details(spark, rows), contents=contents, parse_attachments=True))
    assert {r.doc_id: r.chunk_count for r in counts.collect()} == {"d1": 2, "d2": 1}


def test_nothing_is_shuffled_between_page_and_chunks(spark):
    d = details(spark, [("d1", "t", "c", page(POLICY), None, None)])
    assert exchanges(ingest.detail_chunks(d)) == 0
    assert exchanges(chunking.policy_chunks(spark.createDataFrame([(1, "n", "一、总则 x。")], "doc_id int, source_name string, text string"), ["doc_id"])) == 0
    p = d.select("doc_id", "body")
    assert exchanges(tree.typed_lines(parsing.html_elements(p, "body", out=None, derive=tree.TYPED_LINES))) == 0
    assert exchanges(tree.tree_nodes(parsing.html_elements(p, "body", out=None, derive=tree.TREE))) == 0
    e = parsing.html_elements(p, "body").withColumn("c", F.expr("array(named_struct('start', 0, 'end', 5))"))
    assert exchanges(chunking.provenance(e, ["doc_id"], "c")) == exchanges(chunking.element_coverage(e, ["doc_id"], "c")) == 0


@pytest.mark.parametrize("seed", range(4))
def test_elements_under_spans_equal_brute_force(spark, seed):
    import random

    r = random.Random(seed)
    elements, at = [], 0
    for n in range(1, r.randrange(2, 12)):
        size = r.randrange(1, 9)
        elements.append({"pos": n, "text": "x" * size, "start": at, "end": at + size})
        at += size + 1
    cuts = [(r.randrange(at + 3), r.randrange(at + 3)) for _ in range(8)]
    d = spark.createDataFrame([(1, elements, [{"no": i, "start": a, "end": b} for i, (a, b) in enumerate(cuts)])], "k int, elements array<struct<pos:int,text:string,start:int,end:int>>, cuts array<struct<no:int,start:int,end:int>>")
    got = {x.no: x.element_ids for x in chunking.provenance(d, ["k"], "cuts").collect()}
    under = lambda a, b: [e["pos"] for e in elements if e["start"] < max(a, b) and e["end"] > min(a, b)]
    assert got == {i: [f"element-{n:04d}" for n in under(a, b)] for i, (a, b) in enumerate(cuts)}
    c = chunking.element_coverage(d.withColumn("cuts", F.slice("cuts", 1, 3)), ["k"], "cuts").first()
    seen = {n for a, b in cuts[:3] for n in under(a, b)}
    assert (c.covered_element_count, [u["index"] for u in c.uncovered_elements]) == (len(seen), [e["pos"] for e in elements if e["pos"] not in seen])
    assert spans.RANGES is not None
