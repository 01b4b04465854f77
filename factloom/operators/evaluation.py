"""Composite evaluation: retrieval results against relevant sessions and expected answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom import config
from factloom.config import JUDGED_FACTS, STORED_SESSIONS
from factloom.functions import metrics
from factloom.functions.text import tokens
from factloom.operators import agent
from factloom.operators.history import history_search


def metric_bundle(retrieved: Column, required: Column, relevant: Column, expected: Column, context: Column) -> dict[str, Column]:
    """All text metrics of one row by name."""
    return {
        "context_recall": metrics.context_recall(retrieved, required),
        "context_precision": metrics.context_precision(retrieved, relevant),
        "fact_coverage": metrics.fact_coverage(context, required),
        "hit_rate": metrics.hit_rate(retrieved, expected),
        "mrr": metrics.reciprocal_rank(retrieved, expected),
        "sufficiency": metrics.sufficiency(context, expected),
    }


def session_results(queries: DataFrame, sessions: DataFrame, distinct: bool = True, kept: int = STORED_SESSIONS) -> DataFrame:
    """Adds retrieved_sessions, hit_rate and mrr to queries (qid, relevant_sessions, ...).

    ``sessions``: qid, session_id, ord. A query without any gets an empty list and zeros.
    """
    lists = sessions.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "session_id"))), lambda r: r["session_id"]).alias("__got"))
    rows = queries.join(lists, "qid", "left")
    got = F.coalesce("__got", F.slice("relevant_sessions", 1, 0))
    return rows.withColumns(
        {
            "hit_rate": F.coalesce(metrics.session_hit(got, F.col("relevant_sessions")), F.lit(0.0)),
            "mrr": metrics.session_reciprocal_rank(got, F.col("relevant_sessions"), distinct),
            "retrieved_sessions": F.slice(got, 1, kept),
        }
    ).drop("__got")


def context_lengths(hits: DataFrame, text: str = "fact_text", judged: int = JUDGED_FACTS) -> DataFrame:
    """(qid, context_length, context): the length counts all facts, the context holds the first."""
    rows = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= judged, F.struct("rank", text)))), lambda r: r[text])
    return hits.groupBy("qid").agg(F.sum(F.length(text)).alias("context_length"), F.array_join(rows, "\n").alias("context"))


def judge_results(results: DataFrame, judge: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """Stored results (query, context, expected_answer) with the judge's score and sub-scores."""
    return results.withColumn("judgement", judge(F.col("query"), F.col("context"), F.col("expected_answer"))).withColumn("score", F.col("judgement.score"))


def turn_metrics(turns: DataFrame) -> DataFrame:
    """Metrics of turns (retrieved, required); a turn without a need keeps its row, with zeros."""
    found = {"recall": metrics.context_recall(F.col("retrieved"), F.col("required")), "precision": metrics.context_precision(F.col("retrieved"), F.col("required"))}
    return turns.withColumns({k: F.when(F.col("needed"), v).otherwise(0.0) for k, v in found.items()})


def of_session(queries: DataFrame, session: int) -> DataFrame:
    return queries.where(F.array_contains("relevant_sessions", session))


def cross_session(queries: DataFrame) -> DataFrame:
    return queries.where(F.size("relevant_sessions") > 1)


def of_kind(queries: DataFrame, type: str | None = None, difficulty: str | None = None) -> DataFrame:
    """Queries of a type, of a difficulty, or of both."""
    for column, value in (("type", type), ("difficulty", difficulty)):
        if value is not None:
            queries = queries.where(F.col(column) == value)
    return queries


def turn_evaluation(turns: DataFrame, asking: str = "user", results: int = 3, sufficiency: Callable[[DataFrame], DataFrame] | None = None, max_iterations: int = config.MAX_ITERATIONS) -> DataFrame:
    """Every asking turn as a query of the agent loop over the turns stored before it in its session, scored
    by all text metrics against the turn that answers it.

    ``turns``: session_id, turn, speaker, text. Visibility is as of the turn; the earlier turns are
    ranked by the share of the query's words they hold, the newest first among equals, and the loop keeps
    the first ``results`` that its rounds find. One row for each asking turn that has an answer."""
    order = Window.partitionBy("session_id").orderBy("turn")
    asked = turns.withColumn("expected", F.lead("text").over(order)).where((F.col("speaker") == asking) & F.col("expected").isNotNull())
    qid = F.concat_ws("/", F.coalesce(F.col("session_id").cast("string"), F.lit("")), "turn")
    asked = asked.select(qid.alias("qid"), "session_id", F.col("turn").alias("asked"), F.col("text").alias("query"), "expected")
    stored = turns.select("session_id", "turn", tokens(F.col("text")).alias("words"))

    def search(open_: DataFrame) -> DataFrame:
        hits = history_search(stored, open_.select("session_id", "asked", tokens(F.col("text")).alias("words")), results)
        return hits.join(open_.select("session_id", "asked", "qid"), ["session_id", "asked"]).select("qid", F.col("turn").alias("fact_id"), "score", "rank")

    queries = asked.select("qid", "session_id", "asked", F.col("query").alias("text"))
    found, _ = agent.retrieve(queries, search, threshold=0.0, min_facts=1, max_facts=results, max_iterations=max_iterations, sufficiency=sufficiency)
    hits = found.join(asked.select("qid", "session_id", "asked"), "qid").join(turns.select("session_id", F.col("turn").alias("fact_id"), "text"), ["session_id", "fact_id"])
    lists = hits.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda r: r["text"]).alias("retrieved"))
    rows = asked.join(lists, "qid", "left").drop("qid").withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<string>")))
    required = F.array("expected")
    return rows.withColumns(metric_bundle(F.col("retrieved"), required, required, F.col("expected"), F.array_join("retrieved", "\n")))
