"""Texts looked up by automaton, agreement of long orders, reranking by calls, facts by a table function."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom import hooks
from factloom.functions import metrics
from factloom.operators import agreement, needles, reranking, search


@pytest.mark.parametrize("settings", [{}, {"few": 0}, {"few": 0, "block": 3, "cut": 2}])
def test_needles_equal_contains(spark, settings):
    texts = ["Budi likes tea", "Ani likes coffee, Budi likes tea", "tea", "éa té", None, "", "likes", "x\x00y", "aaaa"]
    stored = spark.createDataFrame([(t, f"ep session_{9 - i}" if i != 4 else None) for i, t in enumerate(texts)] + [("tea", None)], "fact_text string, episode_name string")
    wanted = ["tea", "likes", "likes tea", "Budi", "é", "aa", "none", "", None, "tea", "x\x00", "s t", "Ani likes coffee, Budi likes tea"]
    got = {r.needle: r.episode_name for r in needles.least_holding(stored, spark.createDataFrame([(w,) for w in wanted], "needle string"), "fact_text", "episode_name", **settings).collect()}
    want = {w: min(f"ep session_{9 - i}" for i, t in enumerate(texts) if t and w in t and i != 4) for w in wanted if w and any(t and w in t for t in texts)}
    assert got == want and len(want) == 9


def test_sessions_of_texts_in_cells(spark):
    f = spark.createDataFrame([(1, 1, "Budi likes tea"), (1, 2, "Ani likes coffee"), (2, 1, "Budi \"likes\" tea"), (2, 16, "Ani likes coffee")], "qid long, rank int, fact_text string")
    stored = spark.createDataFrame([("so Budi likes tea a lot", "session_7"), ("Ani likes coffee", "session_3"), ("Ani likes coffee", "other")], "fact_text string, episode_name string")
    for settings in ({}, {"few": 0, "block": 1, "cut": 1}):
        got = sorted((r.qid, r.session_id, r.ord) for r in search.session_of_texts(f, stored.where("episode_name <> 'other'"), **settings).collect())
        assert got == [(1, 3, 2), (1, 7, 1), (2, 7, 1)]


def test_inversions():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 7, 64, 100):
        a = np.array([rng.randrange(max(1, n // 2)) for _ in range(n)])
        assert agreement.inversions(a) == sum(a[i] > a[j] for i in range(n) for j in range(i + 1, n))


def test_inversions_of_many_lists():
    rng = random.Random(2)
    sizes = [rng.choice([1, 2, 5, 17]) for _ in range(60)]
    lists, values = np.repeat(np.arange(60), sizes), np.array([rng.randrange(9) for _ in range(sum(sizes))])
    want = [sum(a[i] > a[j] for i in range(len(a)) for j in range(i + 1, len(a))) for a in (values[lists == k] for k in range(60))]
    assert agreement.inversions_by_list(lists, values).tolist() == want


def test_short_lists_share_batches(spark):
    """Lists that end anywhere in a batch or go on over several, and no call for each list."""
    rows = spark.range(3000).select(F.concat(F.lit("q"), F.floor(F.sqrt("id"))).alias("qid"), F.col("id").alias("item"), F.col("id").alias("place"), F.pmod(F.xxhash64("id"), F.lit(1000003)).alias("other"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = agreement.rank_agreement(rows, rows.select("qid", "item", F.col("other").alias("place")), "qid", "item", "place")
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {r.qid: round(r.agreement, 9) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    lists = {}
    for r in rows.orderBy("id").collect():
        lists.setdefault(r.qid, []).append(r.other)
    wrong = {q: sum(a[i] > a[j] for i in range(len(a)) for j in range(i + 1, len(a))) for q, a in lists.items()}
    assert got == {q: round(1 - wrong[q] / (len(a) * (len(a) - 1) / 2), 9) if len(a) > 1 else 1.0 for q, a in lists.items()}
    assert plan.count("MapInArrow") == 2 and plan.count("FlatMapGroupsInArrow") == 1


@pytest.mark.parametrize("settings", [{}, {"bin_items": 8}, {"bin_items": 1, "bins": 6}])
def test_agreement_equals_the_expression_on_lists(spark, settings):
    rng = random.Random(3)
    lists = [(0, ["a"], ["a", "b"]), (1, ["a", "b"], ["c", "d"]), (2, ["a", "b", "a"], ["b", "a"]), (3, [], ["x", "y"]), (4, ["a", "b"], ["a", "c"])]
    for i in range(5, 12):
        items = [f"i{k}" for k in range(rng.choice([2, 30, 90]))]
        p, a = items[:], [x for x in items if rng.random() < 0.9] + [f"n{k}" for k in range(5)]
        rng.shuffle(p)
        if i % 2:
            rng.shuffle(a)
        lists.append((i, p, a))
    rows = spark.createDataFrame(lists, "qid long, predicted array<string>, actual array<string>")
    want = {r.qid: round(r.x, 9) for r in rows.select("qid", metrics.rank_agreement(F.col("predicted"), F.col("actual")).alias("x")).collect()}
    side = lambda c: rows.select("qid", F.posexplode(c).alias("place", "item"))
    got = {r.qid: round(r.agreement, 9) for r in agreement.rank_agreement(side("predicted"), side("actual"), "qid", "item", "place", **settings).collect()}
    assert got == want


def test_agreement_of_a_million_items(spark):
    n = 1_000_000
    items = spark.range(n).select(F.lit(1).alias("qid"), F.col("id").alias("item"), F.col("id").alias("place"))
    turned = items.withColumn("place", F.when(F.col("item") < n // 2, n // 2 - 1 - F.col("item")).otherwise(F.col("item")))
    got = agreement.rank_agreement(items, turned, "qid", "item", "place").first().agreement
    half = n // 2
    assert got == pytest.approx(1 - half * (half - 1) / (n * (n - 1)), abs=1e-12)


def test_rerank_calls_again_and_falls_back(spark, tmp_path):
    rows = [(q, i, f"passage {i} {'tea' if (q + i) % 3 == 0 else 'x'}") for q, n in ((1, 25), (2, 1), (3, 4)) for i in range(n)]
    candidates = spark.createDataFrame(rows, "qid long, position int, text string")
    queries = spark.createDataFrame([(1, "tea"), (2, "tea"), (3, "broken")], "qid long, query string")
    log = str(tmp_path)

    def model():
        plain = hooks.overlap_model()

        def call(prompts):
            import os
            import uuid

            for p in prompts:
                with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
                    f.write(p.split("\n", 1)[0])
            if any("broken" in p for p in prompts):
                raise RuntimeError("limit")
            return plain(prompts)

        return call

    got = reranking.rerank(candidates.repartition(1), queries, model, 3, retries=2).orderBy("qid", "rank").collect()
    assert [(r.qid, r.position, r.rerank_score) for r in got] == [(1, 2, 1.0), (1, 5, 1.0), (1, 8, 1.0), (2, 0, 1.0), (3, 0, 0.5), (3, 1, 0.5), (3, 2, 0.5)]
    said = sorted(open(f).read() for f in tmp_path.iterdir() if not f.name.startswith("."))
    # three calls of the first query, none for a single candidate, the third asked three times in all
    assert said.count("Query: broken") == 3 and said.count("Query: tea") >= 3


def test_overlap_model_reads_prompts():
    reply = hooks.overlap_model()(["Query: hot tea\n[0] Tea\n[1] cold\nHOT tea"])[0]
    assert [(r["passage_id"], r["score"]) for r in json.loads(reply)] == [(0, 0.5), (1, 1.0)]


def test_table_function_equals_the_array_form(spark):
    texts = ["Ani came. She left!  \tThen? ok", "One\n\nTwo Words", "", None, "   ", "no stop", "«Quote» Émile, (Budi)! x.Y z", "A. B. Cde...", "tail. "]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    want = rows.select("id", F.explode(hooks.sentence_extractor(F.col("body"))).alias("f")).select("id", "f.fact", "f.entities")
    got = hooks.facts_laterally(rows, "body")
    key = lambda df: sorted((r.id, r.fact, tuple(r.entities)) for r in df.collect())
    assert key(got.select("id", "fact", "entities")) == key(want) and got.count() > 8
