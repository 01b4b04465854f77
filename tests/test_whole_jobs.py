"""Queries do the whole job: every row that the task asks for takes part."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import search
from factloom.plans import catalog

SEARCHES = ("topk_cosine", "topk_cosine_threshold", "two_stage_rerank", "fused_search", "fused_name_boost", "temporal_search", "hybrid_union", "agent_retrieve")


@pytest.mark.parametrize("name", SEARCHES)
def test_searches_answer_every_hundredth_id(spark, sf, name):
    ids = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 100 = 0").collect()}
    assert {r.qid for r in catalog.QUERIES[name](spark, sf).select("qid").collect()} == ids


def test_scores_of_more_queries_than_a_block(spark, sf, monkeypatch):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    blocks, given = search.query_blocks, []
    monkeypatch.setattr(search, "query_blocks", lambda queries: given.append(1) or blocks(queries, 2))
    assert search.score_all(e, q).select("qid", "vec_id").distinct().count() == q.count() * e.count() and given


@pytest.mark.parametrize("name", ["session_hr_mrr", "embed_recall_at_k"])
def test_evaluation_takes_every_hundredth_id(spark, sf, name):
    ids = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 100 = 0").collect()}
    assert {r.qid for r in catalog.QUERIES[name](spark, sf).select("qid").collect()} == ids


def test_evaluation_searches_all_rows_but_the_query(spark, sf):
    from factloom.plans import evaluation

    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    rows = evaluation.ranked(spark, sf)
    assert rows.where("qid = vec_id").isEmpty() and {r["count"] for r in rows.groupBy("qid").count().collect()} == {n - 1}
    total = [r.n for r in catalog.QUERIES["query_evaluation"](spark, sf).where("grouping = 'overall'").collect()]
    assert total == [rows.select("qid").distinct().count()]


def test_timelines_and_entities_lose_no_row(spark, sf):
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    seen = catalog.QUERIES["relevant_events"](spark, sf)
    assert seen.select("id").distinct().count() == read("orders").count()
    assert seen.select("session_id").distinct().count() == read("orders").select(F.to_date("o_orderdate")).distinct().count()
    assert catalog.QUERIES["valid_continuation"](spark, sf).count() == read("events").where("event_id > 20").count()
    sold = read("lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct().join(read("part"), "p_partkey").select("p_name").distinct().count()
    assert catalog.QUERIES["entity_facts"](spark, sf).select("name").distinct().count() == sold
    by_source = catalog.QUERIES["entity_facts_fallback"](spark, sf).groupBy("source").agg(F.count_distinct("name").alias("n")).collect()
    assert {r.source: r.n for r in by_source} == {"entity_expand": sold, "entity_names": read("orders").where("o_orderkey % 5 = 0").select("o_orderpriority").distinct().count()}
