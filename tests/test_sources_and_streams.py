"""Readers, sinks, plans and streams."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from factloom import hooks, schemas
from factloom.operators import agent, evaluation, events, generation, search, windows
from factloom.plans import retrieval
from factloom.sources import documents, sessions, sinks
from factloom.streaming import windows as streams


@pytest.fixture
def dataset(tmp_path):
    path = tmp_path / "dataset.json"
    turns = [{"speaker": "user", "text": "Halo Budi."}, {"speaker": "BOT", "text": "Halo."}, {"speaker": "user", "text": "Apa?", "timestamp": "2024-02-02T10:00:00Z"}]
    truth = [{"turn_id": 0, "session_id": 1, "factual": [{"fact": "old"}]}, {"turn_id": 0, "session_id": 1, "factual": [{"fact": "new"}], "retrieval_required": [{"info_type": "x"}]}]
    body = {"summary": "s", "sessions": [{"session_id": 1, "datetime": "05 January 2024, 09:30", "turns": turns, "ground_truths": truth}, {"session_id": 2, "date": "2024-01-09", "turns": turns[:1]}, {"session_id": 3, "datetime": "soon", "turns": []}, "junk"]}
    path.write_text(json.dumps(body))
    return str(path)


def test_sessions_to_turns(spark, dataset):
    s = documents.read_sessions(spark, dataset)
    turns = sessions.turns_of_sessions(s)
    got = {(r.session_id, r.turn): str(r.ts) for r in turns.collect()}
    assert got == {(1, 0): "2024-01-05 09:30:00", (1, 1): "2024-01-05 09:32:00", (1, 2): "2024-02-02 10:00:00", (2, 0): "2024-01-09 00:00:00"}
    truth = {(r.session_id, r.turn): r for r in sessions.with_ground_truth(turns, s).withColumn("need", sessions.needs_retrieval(F.col("ground_truth"))).collect()}
    assert truth[1, 0].ground_truth.factual[0].fact == "new" and truth[1, 0].need and not truth[1, 1].need
    body = sessions.session_texts(turns).where("session_id = 1").first().body
    assert body == "[User]: Halo Budi.\n[Bot]: Halo.\n[User]: Apa?"
    assert spark.range(1).select(sessions.session_header(F.lit(4), F.lit("2024-01-01")).alias("h")).first().h == "[Session 4 - 2024-01-01]"


def test_ingest_is_idempotent(spark, dataset):
    turns = sessions.turns_of_sessions(documents.read_sessions(spark, dataset))
    made = F.lit("2024-03-01").cast("timestamp")
    name = F.concat(F.lit("session_"), F.col("session_id").cast("string"))
    eps = sessions.episodes(turns, "g", made, name, F.col("text"), F.col("ts"))
    facts = sinks.facts_of_episodes(eps, hooks.sentence_extractor, hooks.hashing_embedder(8))
    again = sinks.upsert(facts, sinks.facts_of_episodes(eps, hooks.sentence_extractor, hooks.hashing_embedder(8)), "fact_id")
    assert again.count() == facts.count() == 4
    assert facts.select(*schemas.fields(schemas.FACT)).count() == 4
    names = sorted(r.name for r in sinks.entities_of_facts(facts).collect())
    assert names == ["Apa", "Budi", "Halo"]
    has, involves = sinks.edges_of_facts(facts)
    assert has.count() == 4 and involves.count() == 6


def test_passages_and_clearing(spark, dataset, tmp_path):
    turns = sessions.turns_of_sessions(documents.read_sessions(spark, dataset))
    rows = sinks.passages(sessions.turn_passages(turns, "c", "g"), hooks.hashing_embedder(8))
    r = rows.where("doc_id = 'session_1_turn_0'").first()
    assert r.text == "[user]: Halo Budi." and r.metadata["char_count"] == "18" and r.passage_id == "c/session_1_turn_0"
    sinks.write_partitioned(rows, str(tmp_path / "p"), "collection")
    assert spark.read.parquet(str(tmp_path / "p")).where("collection = 'c'").count() == 4
    sinks.write_report(rows.groupBy().count(), str(tmp_path / "r"))
    sinks.append_log(rows.select("doc_id"), str(tmp_path / "l"))
    sinks.append_log(rows.select("doc_id"), str(tmp_path / "l"))
    assert documents.read_results(spark, str(tmp_path / "l")).count() == 8


def test_queries_both_shapes(spark, tmp_path):
    q = [{"id": "q001", "query": "Siapa nama kucingnya?", "type": "multi_hop", "difficulty": "easy", "relevant_sessions": [1, 2]}]
    (tmp_path / "a.json").write_text(json.dumps(q))
    (tmp_path / "b.json").write_text(json.dumps({"queries": q}))
    for name in "ab":
        r = documents.read_queries(spark, str(tmp_path / f"{name}.json")).first()
        assert r.id == "q001" and r.is_cross_session and r.relevant_sessions == [1, 2]


def test_event_rules(spark):
    rows = [("E1", "2024-01-01", []), ("E2", "2024-01-01", ["E1"]), ("E3", "2024-01-09", ["E1", "E9", "E2"]), ("E4", "never", ["E1"]), ("E5", "2024-01-20", [])]
    frame = spark.createDataFrame([(i, d, i, c) for i, d, c in rows], "id string, date string, description string, caused_by array<string>")
    assert {r.id: r.caused_by for r in events.valid_events(frame).collect()} == {"E1": [], "E2": [], "E3": ["E1", "E2"], "E5": []}
    assert sorted(r.id for r in events.connected_events(frame).collect()) == ["E1", "E2", "E3", "E4"]
    dated = frame.where("id <> 'E4'").select("id", F.col("date").cast("date").alias("date"), "caused_by")
    days = spark.createDataFrame([(1, "2024-01-02"), (2, "2024-01-10"), (3, "2024-01-15"), (4, "2024-03-01")], "session_id int, d string").select("session_id", F.col("d").cast("date").alias("date"))
    got = sorted((r.session_id, r.id) for r in events.relevant_events(days, dated).collect())
    assert got == [(1, "E1"), (1, "E2"), (2, "E3"), (3, "E3"), (4, "E5")]
    d = events.density(dated, days).first()
    assert (d.n_events, d.n_sessions, d.span_days) == (4, 4, 20)
    assert events.density(dated.limit(0), days).first().events_per_day == 0.0
    assert events.event_target(100, 20) == 80


def test_window_cells_equal_one_window(spark):
    base = datetime.datetime(2024, 1, 1)
    rows = [(i % 2, base + datetime.timedelta(seconds=37 * i)) for i in range(300)]
    out = windows.rolling(spark.createDataFrame(rows, "k int, ts timestamp"), "k", "ts", 60).collect()
    for r in out:
        assert r.rolling == sum(k == r.k and 0 <= (r.ts - t).total_seconds() <= 60 for k, t in rows)


def test_plans(spark, sf):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert "NestedLoop" not in plan(retrieval.topk_cosine(spark, sf)) and "WindowGroupLimit" in plan(retrieval.topk_cosine(spark, sf))
    assert "LeftSemi" in plan(retrieval.semi_facts(spark, sf)) and "LeftAnti" in plan(retrieval.anti_facts(spark, sf))
    pushed = plan(retrieval.anti_facts(spark, sf))
    assert "EqualTo(o_orderstatus,P)" in pushed and "o_totalprice" not in pushed


@pytest.mark.parametrize("scores", [1, 30, 1 << 22])
def test_blocks_equal_expressions(spark, monkeypatch, scores):
    monkeypatch.setattr(search, "SCORES", scores)
    rows = [(i, [float((i * 7) % 5), float(i % 3), 1.0]) for i in range(40)] + [(40, [0.0, 0.0, 0.0]), (41, None), (42, [1.0]), (43, [2.0]), (44, [])]
    f = spark.createDataFrame(rows, "fact_id long, embedding array<float>")
    q = spark.createDataFrame([(i, [1.0, float(i), 0.5]) for i in range(6)] + [(6, None), (7, [0.0, 0.0, 0.0]), (8, [-3.0]), (9, [])], "qid long, embedding array<float>")
    take = lambda df: sorted((r.qid, r.fact_id, round(r.score, 9), r["rank"]) for r in df.select("qid", "fact_id", "score", "rank").collect())
    want = take(search.best(search.score_all(f, q).where("score IS NOT NULL"), 7, F.desc("score"), F.col("fact_id")))
    assert take(search.top_k(f, q, 7, "fact_id")) == take(search.top_k_blocks(f, q, 7, "fact_id")) == want
    assert {r[0] for r in want} == {0, 1, 2, 3, 4, 5, 8}
    pairs = f.select("fact_id").crossJoin(q.select("qid"))
    scored = search.score_pairs(pairs, f, q, "fact_id").where("score IS NOT NULL")
    assert take(search.best(scored, 7, F.desc("score"), F.col("fact_id"))) == want


def test_entities_by_grams_equal_substrings(spark):
    names = ["Budi", "budi", "a", "Al", "Bu", "", "Budi Santoso", "toko buku", "ko", "Ée", "x%_", None, "bukubuku", "Ani", "Budi"]
    texts = ["Kapan Budi Santoso ke TOKO BUKU?", "ani dan al", "bu", "", None, "x%_y", "bukubukubuku", "éE", "b"]
    entities = spark.createDataFrame([(f"e{i}", n) for i, n in enumerate(names)], "entity_id string, name string")
    queries = spark.createDataFrame(list(enumerate(texts)), "qid long, text string")
    want = sorted((i, f"e{k}", n) for i, t in enumerate(texts) for k, n in enumerate(names) if n and len(n) >= 2 and n.lower() in (t or "").lower())
    assert sorted((r.qid, r.entity_id, r.name) for r in search.resolve_entities(queries, entities).collect()) == want
    two = search.resolve_entities(queries, entities, limit=2)
    assert sorted((r.qid, r.name) for r in two.collect() if r.qid == 0) == [(0, "Bu"), (0, "Budi")]
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_names_that_begin_alike_have_keys_of_their_own(spark):
    """No key of the join holds more than a few of the names, although all share most of their grams."""
    entities = spark.range(3000).select(F.col("id").cast("string").alias("entity_id"), F.concat(F.lit("Customer#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("name"))
    queries = spark.range(300).select(F.col("id").alias("qid"), F.concat(F.lit("ask customer#"), F.lpad(F.col("id").cast("string"), 9, "0"), F.lit(" now")).alias("text"))
    assert {(r.qid, r.entity_id) for r in search.resolve_entities(queries, entities).collect()} == {(i, str(i)) for i in range(300)}


def test_equal_texts_and_names_are_met_once(spark, monkeypatch):
    seen, save = {}, search.saved
    monkeypatch.setattr(search, "saved", lambda df, label: seen.setdefault(label, save(df, label)))
    entities = spark.range(200).select(F.format_string("e%03d", "id").alias("entity_id"), F.lit("Budi").alias("name")).unionByName(spark.createDataFrame([("x", "Ani")], "entity_id string, name string"))
    queries = spark.range(400).select(F.col("id").alias("qid"), F.lit("ani dan budi").alias("text"))
    # the same id asks twice, with two texts
    queries = queries.unionByName(spark.createDataFrame([(7, "ani dan budi"), (9, "Budi?"), (500, "Budi?"), (501, None)], "qid long, text string"))
    got = {}
    for r in search.resolve_entities(queries, entities, limit=3).collect():
        got.setdefault(r.qid, []).append((r.name, r.entity_id))
    both = [("Ani", "x"), ("Budi", "e000"), ("Budi", "e001")]
    want = {i: both for i in range(400)} | {7: [both[0], both[0], both[1]], 9: [both[0], both[1], both[1]], 500: [*both[1:], ("Budi", "e002")]}
    assert {q: sorted(v) for q, v in got.items()} == want
    assert seen["names"].count() == 3 and seen["lists"].count() == 2


def test_cumulative_text_of_the_last(spark):
    rows = spark.createDataFrame([(1, i, str(i)) for i in range(5)], "k int, n int, t string")
    got = [r.cumulative for r in windows.cumulative_text(rows, "k", "n", "t", ",", last=2).orderBy("n").collect()]
    assert got == ["0", "0,1", "1,2", "2,3", "3,4"]


@pytest.mark.parametrize("share", [0, 1 << 40])
def test_ancestry_moves_numbers_and_only_what_goes_on(spark, monkeypatch, share):
    """With ids as numbers, whether or not the ids of the last pairs are broadcast; no table holds strings."""
    monkeypatch.setattr(events, "FEW_OF", share)
    seen, save = [], events.saved
    monkeypatch.setattr(events, "saved", lambda df, label: seen.append(df) or save(df, label))
    rows = [(i, [i - 1] if i % 40 else []) for i in range(120)] + [(1000, [1001, 39]), (1001, [1000])]
    got = {(r.id, r.ancestor): r.depth for r in events.ancestry(spark.createDataFrame(rows, "id long, caused_by array<long>")).collect()}
    want, causes = {}, dict(rows)
    for i in causes:
        level, depth = {i}, 0
        while level:
            level, depth = {c for x in level for c in causes[x] if (str(i), str(c)) not in want}, depth + 1
            want |= {(str(i), str(c)): depth for c in level}
    assert got == want and all(dict(df.dtypes)["id"] == "bigint" for df in seen)


def test_ancestry_of_long_chains_and_cycles(spark):
    chain = [(f"c{i}", [f"c{i - 1}"] if i else []) for i in range(1000)]
    loops = [("x", ["y"]), ("y", ["x"]), ("z", ["z", "x"]), ("d", ["b", "e"]), ("b", ["a", "a"]), ("e", ["b"]), ("n", None), ("m", [None, "missing"])]
    rows = {(r.id, r.ancestor): r.depth for r in events.ancestry(spark.createDataFrame(chain + loops, "id string, caused_by array<string>")).collect()}
    assert {k: d for k, d in rows.items() if k[0][0] != "c"} == {
        ("x", "y"): 1, ("x", "x"): 2, ("y", "x"): 1, ("y", "y"): 2, ("z", "z"): 1, ("z", "x"): 1, ("z", "y"): 2, ("d", "b"): 1, ("d", "e"): 1, ("d", "a"): 2, ("b", "a"): 1, ("e", "b"): 1, ("e", "a"): 2, ("m", "missing"): 1
    }
    assert all(rows[f"c{i}", f"c{k}"] == i - k for i in (1, 64, 65, 999) for k in range(i)) and sum(k[0][0] == "c" for k in rows) == 999 * 500
    assert events.ancestry(spark.createDataFrame([], "id string, caused_by array<string>")).count() == 0


def test_session_windows_of_one_day(spark):
    s = spark.createDataFrame([(1, datetime.date(2024, 1, 5)), (2, datetime.date(2024, 1, 5)), (3, datetime.date(2024, 1, 20))], "session_id long, date date")
    e = spark.createDataFrame([(10, datetime.date(2023, 12, 1)), (11, datetime.date(2024, 1, 5)), (12, datetime.date(2024, 1, 12)), (13, datetime.date(2024, 2, 1))], "id long, date date")
    # the second session of a day has no new day, so it sees the last week
    assert sorted((r.session_id, r.id) for r in events.relevant_events(s, e).collect()) == [(1, 10), (1, 11), (2, 11), (3, 12)]


def test_query_blocks_cover_all(spark):
    q = spark.range(100).withColumnRenamed("id", "qid")
    assert sorted(r.qid for part in search.query_blocks(q, 30) for r in part.collect()) == list(range(100))


def test_agent_stops(spark):
    q = spark.createDataFrame([(1, "Kenapa Budi pindah"), (2, "x")], "qid long, text string")
    hits = spark.createDataFrame([(1, f"f{i}", 0.9 - i / 100, i + 1) for i in range(20)] + [(2, "g", 0.8, 1)], "qid long, fact_id string, score double, rank int")
    planned = agent.plan_queries(q).collect()
    assert [(r.query_type, r.multi_hop) for r in planned] == [("causal", True), ("factual", False)] and "Budi" in planned[0].entities
    found, report = agent.retrieve(q, lambda o: hits.join(o.select("qid"), "qid", "left_semi"))
    assert found.where("qid = 1").count() == 15
    got = {r.qid: (r.n_facts, r.iterations, r.confidence) for r in report.collect()}
    assert got == {1: (15, 1, 1.0), 2: (1, 5, 0.8)}


def test_session_mapping(spark):
    f = spark.createDataFrame([(1, 1, "ep session_7", "Budi likes tea"), (1, 2, "ep session_3", "Ani likes coffee"), (1, 3, "ep session_7", "Budi moved")], "qid long, rank int, episode_name string, fact_text string")
    eps = f.select(F.col("episode_name").alias("name")).distinct()
    want = [(7, 1), (3, 2)]
    assert [(r.session_id, r.ord) for r in search.session_of_facts(f, eps).orderBy("ord").collect()] == want
    stored = f.select("episode_name", "fact_text")
    assert [(r.session_id, r.ord) for r in search.session_of_texts(f.drop("episode_name"), stored).orderBy("ord").collect()] == want


def test_stream_resumes(spark, tmp_path):
    rows = spark.createDataFrame([(i, datetime.datetime(2024, 1, 1, i % 24, 0)) for i in range(48)], "id long, ts timestamp")
    rows.where("id < 24").write.parquet(str(tmp_path / "in/a"))
    source = lambda: streams.read_stream(spark, str(tmp_path / "in/*"), rows.schema)
    seen = []
    for expected in (24, 48):
        streams.ingest(source(), lambda b, n: seen.extend(r.id for r in b.collect()), str(tmp_path / "state"))
        assert sorted(seen) == list(range(expected))
        rows.where("id >= 24").write.mode("overwrite").parquet(str(tmp_path / "in/b"))


def test_generation_parts(spark):
    days = generation.session_dates(spark, "2024-01-01", "2024-01-31", 10).collect()
    assert [r.session_id for r in days] == list(range(1, 11)) and len({r.date for r in days}) == 10
    assert days == sorted(days, key=lambda r: r.date) and all(8 <= r.ts.hour <= 21 and r.ts.date() == r.date for r in days)
    assert days == generation.session_dates(spark, "2024-01-01", "2024-01-31", 10).collect()
    p = spark.sql("select named_struct('name','A','age',3,'occupation','','location','x','traits',array('a'),'hobbies',array(),'interests',array('b'),'conversation_topics',array('c'),'backstory',null) as user")
    assert generation.persona_problems(p).first().problems == ["occupation"]


def test_results_without_sessions(spark):
    q = spark.createDataFrame([(1, [4]), (2, [5])], "qid long, relevant_sessions array<int>")
    got = evaluation.session_results(q, spark.createDataFrame([(1, 9, 1), (1, 4, 2)], "qid long, session_id int, ord int")).collect()
    assert {r.qid: (r.hit_rate, r.mrr, r.retrieved_sessions) for r in got} == {1: (1.0, 0.5, [9, 4]), 2: (0.0, 0.0, [])}
    assert evaluation.of_session(q, 5).count() == 1 and evaluation.cross_session(q).count() == 0
