"""A sample of registered queries per section against DuckDB at the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = (
    "a1_raw_detail", "a3_paged_listing", "a4_upsert_chunks", "b2_html_elements", "c1_fixed_window", "c3_split_without_overlap", "c8_clause_groups", "c15_element_provenance",
    "c17_uncovered_ranges", "d4_node_identity", "d8_ordinal_issues", "e6_outcomes", "e8_import_summary", "f2_char_buckets", "g14_context_clause", "g20_inherited_schema", "g22_lookup_spec", "h1_dense_top_k",
    "h5_hybrid_top_k", "h8_rule_score", "i10_complementary", "i12_plan_answer", "h10_response_scores", "j9_answer_text", "k4_category_summary", "l1_feedback_stream", "l3_upsert_stream",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    return str(v)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
