"""Streams with keyed state equal their batch forms, however the input is split, late rows and restarts included."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import evaluation, windows
from factloom.streaming import state
from factloom.streaming import windows as streams

START = datetime.datetime(2024, 1, 1)


def written(spark, folder, batches, schema):
    """Each batch as files of its own; more can be added between runs of a stream."""
    for name, rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def run(spark, folder, schema, make):
    source = streams.read_stream(spark, f"{folder}/in/*", schema, files=1)
    with state.state_store(spark):
        streams.run_available(make(source), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out")


CALLS = "id long, model string, ts timestamp_ntz, tokens long"


def test_budget_equals_batch_with_late_rows_and_a_restart(spark, tmp_path):
    rng = random.Random(6)
    rows, second = [], 0.0
    for i in range(900):
        second += rng.choice([0, 1, 3, 20])
        rows.append((i, rng.choice("ab"), START + datetime.timedelta(seconds=second), rng.randint(1, 50)))
    # rows come up to two minutes out of order
    rows.sort(key=lambda r: r[2] + datetime.timedelta(seconds=rng.uniform(0, 110)))
    end = (-1, "z", START + datetime.timedelta(days=1), 1)
    make = lambda s: state.budget_stream(s, "model", "ts", "id", "tokens", 5, 120, "2 minutes")
    written(spark, tmp_path / "in", [(f"{k:02}", rows[k * 150 : (k + 1) * 150]) for k in range(3)], CALLS)
    early = run(spark, tmp_path, spark.createDataFrame([], CALLS).schema, make).count()
    written(spark, tmp_path / "in", [(f"{k:02}", rows[k * 150 : (k + 1) * 150]) for k in range(3, 6)] + [("99", [end])], CALLS)
    got = {r.id: r for r in run(spark, tmp_path, spark.createDataFrame([], CALLS).schema, make).collect()}
    assert 0 < early < 450 and set(got) == {r[0] for r in rows}
    log = spark.createDataFrame(rows, CALLS)
    for r in windows.within_budget(log, "model", "ts", 5, 120, "tokens").collect():
        g = got[r.id]
        assert (g.requests_60s, g.tokens_60s, g.allowed) == (r.requests_60s, r.tokens_60s, r.allowed) and (g.wait_seconds == 0 if g.allowed else 0 <= g.wait_seconds <= 60)


def test_waits():
    at = np.array([0, 10, 10, 30, 70, 130]) * 1_000_000
    requests, used, wait = state.waits(at, np.array([5, 5, 5, 100, 1, 1]), 2, 50)
    assert requests.tolist() == [1, 3, 3, 4, 4, 2] and used.tolist() == [5, 15, 15, 115, 111, 2]
    # at 10 s the call of 0 s has to leave, at 30 s the call itself is too large, at 70 s that one has to leave
    assert wait.tolist() == [0, 50, 50, 60, 20, 0]


TURNS = "session_id long, turn long, speaker string, text string, ts timestamp_ntz"


@pytest.mark.parametrize("seed", [1, 2])
def test_interleaved_equals_batch_for_any_split(spark, tmp_path, seed):
    rng = random.Random(seed)
    words = "tea coffee river mill rain snow".split()
    rows = [(s, i, ("user", "bot")[i % 2], " ".join(rng.choices(words, k=4)) + f" {i}", START + datetime.timedelta(minutes=2 * i)) for s in range(6) for i in range(rng.choice([1, 2, 9, 14]))]
    rng.shuffle(rows)
    make = lambda s: state.interleaved_stream(s, "ts", "1 day")
    schema = spark.createDataFrame([], TURNS).schema
    third = -(-len(rows) // 5)
    written(spark, tmp_path / "in", [(f"{k}", rows[k * third : (k + 1) * third]) for k in range(3)], TURNS)
    run(spark, tmp_path, schema, make)
    # a restart takes up the rest; a file given twice changes nothing
    written(spark, tmp_path / "in", [(f"{k}", rows[k * third : (k + 1) * third]) for k in range(3, 5)] + [("9", rows[:third])], TURNS)
    found = run(spark, tmp_path, schema, make)
    batch = evaluation.turn_evaluation(spark.createDataFrame(rows, TURNS))
    key = lambda df: sorted((r.session_id, r.asked, r.query, r.expected, tuple(r.retrieved)) for r in df.collect())
    assert key(found) == key(batch) and found.count() > 5


def test_missing_turns_are_waited_for_until_the_watermark(spark, tmp_path):
    at = lambda m: START + datetime.timedelta(minutes=m)
    schema = spark.createDataFrame([], TURNS).schema
    make = lambda s: state.interleaved_stream(s, "ts", "10 minutes")
    written(spark, tmp_path / "in", [("0", [(1, 0, "user", "tea", at(0)), (1, 2, "user", "tea rain", at(4)), (1, 3, "bot", "rain", at(6))])], TURNS)
    assert run(spark, tmp_path, schema, make).isEmpty()
    written(spark, tmp_path / "in", [("1", [(2, 0, "bot", "x", at(60))])], TURNS)
    got = run(spark, tmp_path, schema, make).orderBy("asked").collect()
    assert [(r.asked, r.expected, r.retrieved) for r in got] == [(0, "tea rain", []), (2, "rain", ["tea"])]
