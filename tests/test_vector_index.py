"""The pivot index gives what a scan of all rows gives, and skips rows where vectors lie in groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import search, vector_index


@pytest.fixture(scope="module")
def grouped(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.05 * rng.normal(size=16)).tolist()) for i in range(3000)]
    rows += [(5000 + i, rows[0][1]) for i in range(500)]  # a third of a pivot's rows are equal
    rows += [(9000, None), (9001, [0.0] * 16), (9002, [1.0, 2.0]), (9003, [2.0, 1.0]), (9004, [3.0]), (9005, [])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6).cache()


def hits(df):
    return sorted((r.qid, r["rank"], r.vec_id) for r in df.collect())


@pytest.mark.parametrize("settings", [{"ring_rows": 50}, {"ring_rows": 50, "pivots": 3, "sample": 40}, {"ring_rows": 500, "pivots": 1, "sample": 5}])
def test_equals_a_scan(grouped, settings):
    asked = grouped.where("vec_id % 37 = 0 OR vec_id >= 9000").select(F.col("vec_id").alias("qid"), "embedding")
    index = vector_index.build(grouped, "vec_id", **settings)
    assert index.rings.agg(F.sum("n")).first()[0] == 3503 == index.rows.count()
    want = hits(search.top_k_blocks(grouped, asked, 10, "vec_id"))
    for probes, cell in ((4, 64), (1, 10_000)):
        found, cost = vector_index.search_index(index, asked, 10, probes, cell)
        assert hits(found) == want
        assert all(r.visited <= r.rows for r in cost.collect())
    if settings == {"ring_rows": 50}:
        share = cost.agg(F.sum("visited") / F.sum("rows")).first()[0]
        assert share < 0.35, share


def test_stored_and_read_again(spark, grouped, tmp_path):
    asked = grouped.where("vec_id % 500 = 3").select(F.col("vec_id").alias("qid"), "embedding")
    vector_index.store(vector_index.build(grouped, "vec_id", ring_rows=100), str(tmp_path))
    found = vector_index.search_index(vector_index.load(spark, str(tmp_path), "vec_id"), asked, 5)[0]
    assert hits(found) == hits(search.top_k_blocks(grouped, asked, 5, "vec_id"))


def test_empty(spark, grouped):
    index = vector_index.build(grouped.limit(0), "vec_id")
    asked = grouped.limit(3).select(F.col("vec_id").alias("qid"), "embedding")
    assert vector_index.search_index(index, asked, 5)[0].isEmpty()
    assert vector_index.search_index(vector_index.build(grouped, "vec_id"), asked.limit(0), 5)[0].isEmpty()
