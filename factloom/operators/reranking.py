"""Reranking by a text model, as one operator: prompts, calls, scores and the best.

Candidates of a query are cut into calls of ``batch``; a task makes its model once and hands it the prompts
of an Arrow batch. Replies are a written table, so a call is paid once; calls without a reply are made
again from that table, and what still fails scores as the contract of :func:`rerank_scores` says.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.search import best, rerank_prompt, rerank_scores
from factloom.shared import forget, saved

Model = Callable[[list[str]], list[str | None]]


def _answered(calls: DataFrame, make: Callable[[], Model], together: int) -> DataFrame:
    """Calls (qid, batch, prompt) with reply; null where the model failed."""

    def run(batches):
        model = make()
        for batch in batches:
            for at in range(0, batch.num_rows, together):
                part = batch.slice(at, together)
                try:
                    replies = model(part.column("prompt").to_pylist())
                except Exception:
                    replies = [None] * part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(replies, pa.string())], names=["qid", "batch", "prompt", "reply"])

    calls = calls.select("qid", "batch", "prompt")
    return calls.mapInArrow(run, f"qid {calls.schema['qid'].dataType.simpleString()}, batch long, prompt string, reply string")


def rerank(candidates: DataFrame, queries: DataFrame, model: Callable[[], Model], results: int, batch: int = 10, longest: int = 500, retries: int = 2, together: int = 16) -> DataFrame:
    """The best ``results`` candidates of each query: the candidates' columns, rerank_score and rank; of equal
    scores the earlier position first.

    ``candidates``: qid, position from 0, text; ``queries``: qid, query. ``model()`` gives a callable of
    prompts to replies, each a JSON list of passage_id and score. A query with one candidate makes no call."""
    several = candidates.groupBy("qid").agg(F.count("*").alias("__n")).where("__n > 1").select("qid")
    prompts = rerank_prompt(candidates.join(several, "qid", "left_semi"), "text", batch, longest).join(queries.select("qid", "query"), "qid")
    calls = prompts.select("qid", F.col("batch").cast("long").alias("batch"), F.concat(F.lit("Query: "), "query", F.lit("\n"), "passages").alias("prompt"))
    done = saved(_answered(calls, model, together), "replies")
    for _ in range(retries):
        missing = done.where("reply IS NULL")
        if missing.isEmpty():
            break
        again = saved(_answered(missing, model, 1), "replies")
        both = saved(done.where("reply IS NOT NULL").unionByName(again), "replies")
        forget(done, again)
        done = both
    replies = done.select("qid", "batch", "reply", F.col("reply").isNull().alias("failed"))
    scored = rerank_scores(candidates, replies, batch)
    return best(scored, results, F.desc("rerank_score"), F.col("position"))
