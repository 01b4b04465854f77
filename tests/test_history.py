"""Searches over what came before equal plain code, in any number of chunks."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.functions.text import tokens
from factloom.operators import history


@pytest.fixture(scope="module")
def turns(spark):
    rng = random.Random(2)
    words = "tea coffee river mill rain snow The the of".split()
    rows = [(s, i * 2 + 1, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 8])))) for s in (1, 2, 3) for i in range({1: 300, 2: 40, 3: 1}[s])]
    rows += [(None, i, "tea") for i in range(5)] + [(4, 0, None)]
    return spark.createDataFrame(rows, "session_id long, turn long, text string").withColumn("words", tokens(F.col("text"))).cache()


@pytest.mark.parametrize("settings", [{}, {"chunk": 30}, {"chunk": 1, "chunks": 5}])
def test_history_search(turns, settings):
    asked = turns.where("turn % 3 <> 0 OR session_id = 2").select("session_id", F.col("turn").alias("asked"), "words")
    rows = [(r.session_id, r.turn, set(r.words or [])) for r in turns.collect()]
    want = set()
    for s, at, words in ((r.session_id, r.asked, set(r.words or [])) for r in asked.collect()):
        found = sorted(((len(w & words) / len(words) if words else 0.0, t) for x, t, w in rows if x == s and t < at), reverse=True)[:3]
        want |= {(s, at, t, round(score, 9), i) for i, (score, t) in enumerate(found, 1)}
    got = {(r.session_id, r.asked, r.turn, round(r.score, 9), r["rank"]) for r in history.history_search(turns, asked, 3, **settings).collect()}
    assert got == want and len(want) > 500


@pytest.mark.parametrize("chunk", [4096, 50, 7])
def test_running_top(turns, chunk):
    rows = turns.withColumn("size", F.coalesce(F.length("text"), F.lit(0)))
    plain = [(r.session_id, r.turn, r["size"]) for r in rows.collect()]
    want = set()
    for s, at, _ in plain:
        for i, (_, t) in enumerate(sorted((-z, t) for x, t, z in plain if x == s and t <= at)[:3], 1):
            want.add((s, at, t, i))
    assert {(r.session_id, r.asked, r.turn, r["rank"]) for r in history.running_top(rows, "session_id", "turn", "size", 3, chunk).collect()} == want


def test_no_pair_is_a_row(turns):
    asked = turns.select("session_id", F.col("turn").alias("asked"), "words")
    plan = history.history_search(turns, asked, 3)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "FlatMapCoGroupsInArrow" in plan
    assert history.history_search(turns.limit(0), asked, 3).isEmpty() and history.history_search(turns, asked.limit(0), 3).isEmpty()
