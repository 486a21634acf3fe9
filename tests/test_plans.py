"""Plans keep their shape: pruned scans, group limits, no nested-loop joins; results do not depend on partitions."""

import pytest

from dossier.operators import chunking, retrieval
from dossier.plans import catalog
from dossier.plans.registry import table
from dossier.plans.retrieval_queries import requests

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["g22_lookup_spec", "h4_keyword_score", "h5_hybrid_top_k", "i7_topic_filter", "c15_element_provenance", "e5_category_enrichment"])
def test_no_nested_loop_join(spark, name):
    p = plan(catalog.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", ["a3_paged_listing_capped", "h1_dense_top_k", "h5_hybrid_top_k"])
def test_top_k_is_limited_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(catalog.QUERIES[name](spark, SF))


def shape(df):
    """A plan without numbers and without where it came from."""
    import re

    return re.sub(r"\d+", "", re.sub(r"@[0-9a-f]+|\[plan_id=\d+\]|Location.*?\]|Scan ExistingRDD", "", plan(df)))


def test_hybrid_search_reads_vectors_once_and_shuffles_no_pairs(spark):
    p = plan(catalog.QUERIES["h5_hybrid_top_k"](spark, SF))
    below = p[p.index("FlatMapCoGroupsInArrow"):]
    corpus = below[below.index("Union"):]
    assert corpus.count("embedding") and corpus.count("FileScan") == 2  # texts once, vectors once
    # Above the search, rows are limited before each exchange but the one that merges the limited rows.
    above = p[: p.index("FlatMapCoGroupsInArrow")]
    assert above.count("WindowGroupLimit") >= 3 and "Join" not in above


def test_search_plan_does_not_depend_on_the_number_of_requests(spark):
    vectors = table(spark, SF, "embeddings")
    ask = lambda n: spark.range(n).selectExpr("id AS query_id", "array_repeat(1.0D, 64) AS query_vec")
    few, many = (retrieval.dense_top_k(ask(n), vectors, 5, "vec_id", "embedding") for n in (10, 10_000))
    assert shape(few) == shape(many)


def test_windows_need_no_shuffle_and_read_two_columns(spark):
    p = plan(chunking.window_chunks(table(spark, SF, "documents"), ["doc_id"]))
    assert "Exchange" not in p and "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_scores_do_not_depend_on_partitions(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "source", "lang")
    asked = requests(spark, SF)
    score = lambda n: sorted(map(tuple, retrieval.keyword_hits(asked, docs.repartition(n), "doc_id", "text", "source", "lang").collect()))
    assert score(1) == score(8)
