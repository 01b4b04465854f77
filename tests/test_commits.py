"""Batches of several tables are whole or not there, and a resumed ingest equals one over everything."""

import pytest
from pyspark.sql import functions as F

from factloom import hooks
from factloom.sources import sinks
from factloom.streaming import commits

TURNS = "session_id long, turn long, speaker string, text string"
ROWS = [(s, i, ("user", "bot")[i % 2], f"Ani met Budi {s}. They had tea {i}.") for s in range(3) for i in range(4)]


def graph(turns):
    return commits.graph_tables(turns, "g", hooks.sentence_extractor)


def plain(tables):
    keys = {"passage": ["passage_id", "text"], "episode": ["name", "body"], "fact": ["fact_id", "fact_text"], "entity": ["entity_id", "name"], "has_fact": ["in_id", "out_id"], "fact_involves": ["in_id", "out_id"]}
    return {n: sorted(tuple(r) for r in tables[n].select(*c).collect()) for n, c in keys.items()}


def test_killed_between_two_tables_and_resumed(spark, tmp_path, monkeypatch):
    for k in range(3):
        spark.createDataFrame(ROWS[k * 4 : k * 4 + 4], TURNS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = lambda: spark.readStream.schema(TURNS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    tables = commits.BatchTables(spark, f"{tmp_path}/tables")
    tries = []

    def make(batch):
        made = graph(batch)
        tries.append(1)
        if len(tries) == 2:
            # the second batch dies after its first tables are written
            made["entity"] = made["entity"].withColumn("name", F.raise_error(F.lit("lost")).cast("string"))
        return made

    with pytest.raises(Exception, match="lost"):
        commits.ingest_sessions(stream(), tables, f"{tmp_path}/state", make)
    assert tables.committed() == [0] and (tmp_path / "tables/fact/batch=1").exists()
    assert tables.read("fact").count() == 8 and tables.read("passage").count() == 4
    commits.ingest_sessions(stream(), tables, f"{tmp_path}/state", make)
    assert tables.committed() == [0, 1, 2] and len(tries) == 4
    assert plain(commits.whole_graph(tables)) == plain(graph(spark.createDataFrame(ROWS, TURNS)))


def test_batches_given_again_change_nothing(spark, tmp_path):
    tables = commits.BatchTables(spark, str(tmp_path / "t"))
    assert tables.committed() == []
    with pytest.raises(ValueError):
        tables.read("fact")
    some = spark.createDataFrame(ROWS[:6], TURNS)
    assert tables.commit(4, graph(some)) and not tables.commit(4, graph(some))
    # the same turns in a later batch are the same rows
    assert tables.commit(5, graph(spark.createDataFrame(ROWS[3:], TURNS)))
    assert plain(commits.whole_graph(tables)) == plain(graph(spark.createDataFrame(ROWS, TURNS)))


def test_edges_that_repeat_inside_a_fact_stay(spark, tmp_path):
    facts = spark.createDataFrame([("f", "g", "e", "Ani Ani", ["Ani", "Ani"])], "fact_id string, group_id string, episode_name string, fact_text string, entity_names array<string>")
    assert sinks.edges_of_facts(facts)[1].count() == 2
