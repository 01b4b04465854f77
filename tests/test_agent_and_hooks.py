"""The agent loop with expansion, a model's replies and turns; hooks; reranking; stored rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from factloom import config, hooks
from factloom.operators import agent, evaluation, generation, search
from factloom.sources import sinks


@pytest.fixture(scope="module")
def graph(spark):
    rows = [(f"f{i}", f"fact {i}", ["Budi" if i % 2 else "Ani"], datetime.datetime(2024, 1, 1 + i)) for i in range(12)] + [("x", "of nobody", [], datetime.datetime(2024, 2, 1))]
    facts = spark.createDataFrame(rows, "fact_id string, fact_text string, entity_names array<string>, created_at timestamp")
    entities = spark.createDataFrame([("e1", "Budi"), ("e2", "Ani")], "entity_id string, name string")
    edges = facts.select(F.col("fact_id").alias("in_id"), F.explode("entity_names").alias("name")).join(entities, "name").select("in_id", F.col("entity_id").alias("out_id"))
    return facts, edges, entities


def hits_of(spark, rows):
    return spark.createDataFrame(rows, "qid long, fact_id string, score double, rank int")


def test_expansion_follows_named_entities_then_those_of_facts(spark, graph):
    facts, edges, entities = graph
    q = agent.plan_queries(spark.createDataFrame([(1, "Kenapa Budi pindah"), (2, "apa itu"), (3, "mengapa begitu")], "qid long, text string"))
    found = hits_of(spark, [(1, "f0", 0.9, 1), (2, "f0", 0.9, 1), (3, "f0", 0.9, 1)])
    expand = agent.entity_expansion(facts, edges, entities, q)
    got, report = agent.retrieve(q, lambda o: found.join(o.select("qid"), "qid", "left_semi"), expand, max_facts=9)
    order = {k: [r.fact_id for r in got.where(F.col("qid") == k).orderBy("ord").collect()] for k in (1, 2, 3)}
    # the first query names Budi, whose newest facts come first; the third needs two hops and has Ani's fact
    assert order[1] == ["f0", "f11", "f9", "f7", "f5", "f3", "f1", "f10", "f8"] and order[2] == ["f0"] and order[3] == ["f0", "f10", "f8", "f6", "f4", "f2"]
    one = agent.entity_expansion(facts, edges, entities, q, most=2)  # Kenapa, Budi
    first = agent.retrieve(q, lambda o: found.join(o.select("qid"), "qid", "left_semi"), one)[0].where("qid = 1")
    assert {r.fact_id for r in first.collect()} == {"f0", "f1", "f3", "f5", "f7", "f9", "f11"}
    assert {r.qid: r.n_facts for r in report.collect()} == {1: 9, 2: 1, 3: 6}


def test_a_models_replies_end_or_refine_the_search(spark, graph):
    facts, *_ = graph
    q = spark.createDataFrame([(1, "satu"), (2, "dua"), (3, "tiga")], "qid long, text string")

    def look(asked):
        """Six facts for a query; a text about tea finds one more."""
        base = spark.createDataFrame([(f"f{i}", 0.6, i + 1) for i in range(6)], "fact_id string, score double, rank int")
        return asked.crossJoin(base).select("qid", F.when(F.col("text") == "tea", "f11").otherwise(F.col("fact_id")).alias("fact_id"), "score", "rank").where("qid <> 3 OR rank < 3")

    seen = []

    def say(prompt):
        seen.append(prompt)
        return F.when(F.contains(prompt, F.lit("satu")), "CUKUP: YA").when(F.contains(prompt, F.lit("fact 11")), "CUKUP:YA").otherwise("CUKUP: TIDAK\nINFO_KURANG: tea")

    found, report = agent.retrieve(q, look, sufficiency=hooks.sufficiency_hook(q, facts, say))
    got = {r.qid: (r.n_facts, r.iterations, r.confidence) for r in report.collect()}
    assert got == {1: (6, 1, 0.9), 2: (7, 2, 0.9), 3: (2, 5, 0.8)} and seen
    assert found.where("qid = 2 AND fact_id = 'f11'").count() == 1


def test_closed_queries_are_left_alone(spark):
    """A reply of enough ends a query: it is not searched, asked or extended again, whatever a later reply says."""
    q = spark.createDataFrame([(i, f"text {i}") for i in range(1, 4)], "qid long, text string")
    searched, asked = [], []

    def look(open_):
        searched.append(sorted({r.qid for r in open_.collect()}))
        base = spark.createDataFrame([(f"f{len(searched)}-{i}", 0.6, i + 1) for i in range(3)], "fact_id string, score double, rank int")
        return open_.select("qid").distinct().crossJoin(base)

    def say(state):
        ids = sorted({r.qid for r in state.collect()})
        asked.append(ids)
        replies = [(i, "CUKUP: YA" if i == len(asked) else "CUKUP: TIDAK\nINFO_KURANG: more") for i in ids]
        return spark.createDataFrame(replies, "qid long, reply string")

    found, report = agent.retrieve(q, look, min_facts=3, max_facts=100, sufficiency=say, max_iterations=3)
    assert asked == [[1, 2, 3], [2, 3], [3]]
    assert [ids for ids in searched if 1 in ids] == [[1, 2, 3]] and all(1 not in ids for ids in searched[1:])
    assert {r.qid: (r.n_facts, r.iterations, r.confidence) for r in report.collect()} == {1: (3, 1, 0.9), 2: (9, 2, 0.9), 3: (15, 3, 0.9)}
    assert {r.qid: r["count"] for r in found.groupBy("qid").count().collect()} == {1: 3, 2: 9, 3: 15}


def test_turns_carry_their_place(spark):
    turns = spark.createDataFrame([(1, 0, "user", "2024-01-01", "kapan Budi datang"), (1, 1, "bot", "2024-01-01", "besok")], "session_id long, turn int, speaker string, date string, text string")
    look = lambda asked: asked.select("qid", F.lit("f").alias("fact_id"), F.lit(0.9).alias("score"), F.lit(1).alias("rank"))
    found, report = agent.retrieve_for_turns(turns, look)
    assert sorted((r.session_id, r.turn, r.speaker, r.date, r.fact_id) for r in found.collect()) == [(1, 0, "user", "2024-01-01", "f"), (1, 1, "bot", "2024-01-01", "f")]
    assert {(r.turn, r.query_type) for r in report.collect()} == {(0, "temporal"), (1, "temporal")}


def test_prompts_are_cut_and_numbered_by_batch(spark):
    rows = spark.createDataFrame([(1, i, "x" * (600 if i == 11 else 3)) for i in range(12)], "qid long, position int, text string")
    got = {r.batch: r.passages for r in search.rerank_prompt(rows).collect()}
    assert got[0] == "\n".join(f"[{i}] xxx" for i in range(10)) and got[1] == "[0] xxx\n[1] " + "x" * 500 + "..."


def test_generator_repeats_and_gives_up(spark):
    def call(prompts):
        if "bad" in prompts:
            raise RuntimeError("limit")
        return [p.upper() for p in prompts]

    run = lambda rows: [r.o for r in spark.createDataFrame([(p,) for p in rows], "p string").coalesce(1).select(hooks.generator(call, 2, 0.0)("p").alias("o")).collect()]
    assert run(["a", "b"]) == ["A", "B"] and run(["bad"]) == [None]


def test_prefixes_reach_the_embedder(spark):
    embed = hooks.hashing_embedder()
    r = spark.createDataFrame([("tea",), (None,)], "t string").select("t", hooks.prefixed(embed, "query: ")(F.col("t")).alias("a"), embed(F.concat(F.lit("query: "), F.coalesce("t", F.lit("")))).alias("b")).collect()
    assert all(x.a == x.b for x in r) and len(r[0].a) == hooks.DIM


def test_purge_and_missing_passages(spark):
    rows = sinks.passages(spark.createDataFrame([("c", "1", "a"), (None, "2", "b")], "collection string, doc_id string, text string"))
    left = sinks.purge(passages=rows)["passages"]
    assert left.count() == 0 and left.schema == rows.schema
    assert sinks.clear_collection(rows, "c").count() == 1 and sinks.passage(rows, "c", "1").count() == 1 and sinks.passage(rows, "c", "2").count() == 0


def test_turn_evaluation_without_history(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a b"), (1, 1, "bot", "c d"), (1, 2, "user", "c"), (1, 3, "bot", "c d e"), (2, 0, "user", "alone")], "session_id long, turn int, speaker string, text string")
    got = {(r.session_id, r.asked): r for r in evaluation.turn_evaluation(turns).collect()}
    assert set(got) == {(1, 0), (1, 2)} and got[1, 0].retrieved == [] and got[1, 2].retrieved == ["c d", "a b"]
    assert got[1, 0].context_recall == 0.0 and got[1, 2].context_recall == 1.0 and got[1, 2].hit_rate == 1.0 and got[1, 2].mrr == 1.0


def test_ground_truth_of_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "Ani came on 2024-01-05. She left on 7 May 2024."), (1, 1, "bot", "When?"), (1, 2, "bot", "")], "session_id long, turn int, speaker string, text string")
    rows = generation.ground_truth(turns).orderBy("turn_id").collect()
    assert [f.fact for f in rows[0].factual] == ["Ani came on 2024-01-05.", "She left on 7 May 2024."] and rows[0].temporal_references == ["2024-01-05", "7 May 2024"]
    assert [r.retrieval_required for r in rows] == [False, True, True] and "Ani" in rows[0].entities_mentioned


def test_setups_have_models():
    assert all(s.models["embedding"] and s.models["main"] for s in config.SETUPS.values())
    assert len(config.setups_by_stack("gemma")) == len(config.setups_by_type("hybrid")) + 1 == 3
