"""Searches and ranks by blocks and slices equal all pairs, however they are cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators import products, reports, search


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).round(1).tolist(), i % 5) for i in range(400)]
    # copies, so that scores tie, and vectors without a score
    rows += [(1000 + i, rows[i % 7][1], i % 5) for i in range(60)] + [(2000, [0.0] * 6, 0), (2001, None, 1), (2002, [1.0], 2), (2003, [], 3)]
    return spark.createDataFrame(rows, "fact_id long, embedding array<float>, label int").repartition(5).cache()


@pytest.fixture(scope="module")
def asked(vectors):
    return vectors.where("fact_id % 3 = 0 OR fact_id >= 2000").select(F.col("fact_id").alias("qid"), "embedding", F.col("label").alias("wanted"))


def scores(vectors, asked):
    """All pairs by plain code: {qid: [(score, key)]}."""
    units = {r.fact_id: np.array(r.embedding, dtype=float) / np.linalg.norm(r.embedding) for r in vectors.collect() if r.embedding and np.linalg.norm(r.embedding)}
    out = {}
    for r in asked.collect():
        if r.qid in units:
            out[r.qid] = [(round(float(units[r.qid] @ v), 9), k) for k, v in units.items() if len(v) == len(units[r.qid])]
    return out


WAYS = [{}, {"few": 0, "cell": 8}, {"few": 0, "cell": 10_000}, {"few": 5, "cell": 60}]


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("later,others", [(False, False), (True, True)])
def test_top_k_in_cells(vectors, asked, way, later, others):
    assert asked.count() // 8 >= 19
    got = {}
    for r in search.top_k_blocks(vectors, asked, 7, "fact_id", later_first=later, others=others, **way).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.fact_id))
    want = {}
    for q, pairs in scores(vectors, asked).items():
        rows = sorted((-s, -k if later else k, k) for s, k in pairs if not (others and k == q))[:7]
        if rows:
            want[q] = [(i, k) for i, (_, _, k) in enumerate(rows, 1)]
    assert {q: sorted(v) for q, v in got.items()} == want


@pytest.mark.parametrize("way", WAYS)
def test_ranks_are_counted(vectors, asked, way):
    pairs = scores(vectors, asked)
    marks = search.score_pairs(asked.select("qid", "wanted").join(vectors.where("fact_id % 4 = 1").select("fact_id", F.col("label").alias("wanted")), "wanted"), vectors, asked, "fact_id").where("score IS NOT NULL")
    got = {(r.qid, r.fact_id): r["rank"] for r in search.rank_counts(vectors, asked, marks, "fact_id", later_first=True, others=True, **way).collect()}
    want = {}
    for r in marks.collect():
        order = [k for _, k in sorted(((-s, -k) for s, k in pairs[r.qid] if k != r.qid))]
        want[r.qid, r.fact_id] = order.index(-r.fact_id) + 1 if -r.fact_id in order else None
    assert {k: v for k, v in got.items() if k[0] != k[1]} == {k: v for k, v in want.items() if v} and len(want) > 1000


@pytest.mark.parametrize("way", WAYS)
def test_embedding_ranking(vectors, asked, way):
    relevant = asked.select("qid", F.col("wanted").alias("label")).join(vectors, "label").where("fact_id <> qid AND label > 1").select("qid", "fact_id")
    good = {}
    for r in relevant.collect():
        good.setdefault(r.qid, set()).add(r.fact_id)
    pairs, want = scores(vectors, asked), {}
    for q, keys in good.items():
        order = [-k for _, k in sorted((-s, -k) for s, k in pairs.get(q, []) if k != q)]
        ranks = [i for i, k in enumerate(order, 1) if k in keys]
        want[q] = tuple(round(x, 9) for x in (1 / min(ranks) if ranks else 0.0, *(sum(i <= c for i in ranks) / len(keys) for c in (5, 10))))
    got = {r.qid: tuple(round(x, 9) for x in (r.mrr, r.recall_at_5, r.recall_at_10)) for r in reports.embedding_ranking(vectors, asked, relevant, "fact_id", **way).collect()}
    assert got == want


def test_many_queries_are_one_plan(vectors, asked):
    plan = search.top_k_blocks(vectors, asked, 7, "fact_id", few=0, cell=8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and "Union" not in plan and "NestedLoop" not in plan


def test_empty_sides(spark, vectors, asked):
    for way in WAYS:
        assert search.top_k_blocks(vectors.limit(0), asked, 3, "fact_id", **way).isEmpty()
        assert search.top_k_blocks(vectors, asked.limit(0), 3, "fact_id", **way).isEmpty()
    assert products.unit_rows(asked.where("qid >= 2000 AND qid <> 2002").toArrow()["embedding"]) == {}


def test_a_cell_holds_few_scores_at_once():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    asked, facts = (pa.table({c: np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(rng.normal(size=n * 8)), 8).cast(pa.list_(pa.float64()))}) for c, n in (("qid", 3000), ("fact_id", 9000)))
    tracemalloc.start()
    made = products.Best(asked, "fact_id", "embedding", products.SCORES, False, k=5)
    made.feed(facts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20
    q, f = (np.stack(t["embedding"].to_numpy()) for t in (asked.slice(0, 50), facts))
    want = np.argsort(-np.round((q / np.linalg.norm(q, axis=1)[:, None]) @ (f / np.linalg.norm(f, axis=1)[:, None]).T, 12), axis=1, kind="stable")[:, :5]
    assert np.array_equal(made.result()["fact_id"].to_numpy()[:250].reshape(50, 5), want)


@pytest.mark.parametrize("way", WAYS)
def test_a_kernel_takes_few_queries(vectors, asked, way, monkeypatch):
    import pyarrow as pa

    class Taken(products.Kernel):
        def feed(self, facts):
            pass

        def result(self):
            return pa.table({"qid": self.qids, "n": [len(self.asked)] * len(self.asked)})

    rows = lambda: sorted(map(tuple, search.top_k_blocks(vectors, asked, 7, "fact_id", **way).collect()))
    want = rows()
    monkeypatch.setattr(products, "ASKED", 5, raising=False)
    kinds = products.fields(("qid", T.LongType()), ("n", T.LongType()))
    taken = products.product(vectors, asked.select("qid", "embedding"), "fact_id", "embedding", lambda some: Taken(some, "fact_id", "embedding", 100, False), kinds, **way).collect()
    assert max(r.n for r in taken) <= 5 and {r.qid for r in taken} == {r.qid for r in asked.collect()}
    assert rows() == want


@pytest.mark.parametrize("cell", [3, 4096])
def test_top_k_of_linked_facts(spark, vectors, asked, cell):
    edges = vectors.select(F.col("fact_id").alias("in_id"), F.explode(F.array(F.col("label"), F.col("fact_id").cast("int") % 3, F.lit(None).cast("int"))).alias("out_id"))
    links = asked.select("qid", F.explode(F.array(F.col("wanted"), F.lit(1), F.lit(99), F.lit(None).cast("int"))).alias("out_id"))
    links = links.unionByName(links)
    groups, mine = {}, {}
    for r in edges.collect():
        groups.setdefault(r.in_id, set()).add(r.out_id)
    for r in links.collect():
        mine.setdefault(r.qid, set()).add(r.out_id)
    want = {}
    for q, pairs in scores(vectors, asked).items():
        rows = sorted((-s, k) for s, k in pairs if (groups[k] & mine[q]) - {None})[:7]
        if rows:
            want[q] = [(i, k) for i, (_, k) in enumerate(rows, 1)]
    found = search.top_k_linked(vectors, edges, links, asked, 7, "fact_id", cell=cell)
    got = {}
    for r in found.collect():
        got.setdefault(r.qid, []).append((r["rank"], r.fact_id))
    assert {q: sorted(v) for q, v in got.items()} == want


def test_linked_pairs_are_no_rows(spark, sf):
    from factloom.plans import retrieval

    for name in ("fused_search", "hybrid_union"):
        plan = retrieval.add.queries[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan
