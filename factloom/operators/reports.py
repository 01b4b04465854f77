"""Reports: evaluation summaries, query-set statistics, costs, latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.usage import cost_usd
from factloom.operators import search

QUERY_TYPES = ("factual_recall", "inference", "multi_hop", "temporal_reasoning", "counterfactual")
DIFFICULTIES = ("easy", "medium", "hard")
SOURCES = ("original_dataset", "auto_generated", "manual")


def eval_summary(results: DataFrame) -> DataFrame:
    """Means of hit_rate, mrr and seconds: overall, by type, and by difficulty, from one pass.

    ``results``: type, difficulty, hit_rate, mrr, seconds. Rows: grouping, value, n and the means.
    """
    level = F.when(F.grouping("type") == 0, "type").when(F.grouping("difficulty") == 0, "difficulty").otherwise("overall")
    out = results.groupingSets([[], [F.col("type")], [F.col("difficulty")]], F.col("type"), F.col("difficulty")).agg(
        level.alias("grouping"), F.count("*").alias("n"), F.avg("hit_rate").alias("hit_rate"), F.avg("mrr").alias("mrr"), F.avg("seconds").alias("seconds")
    )
    value = F.when(F.col("grouping") == "type", F.col("type")).when(F.col("grouping") == "difficulty", F.col("difficulty"))
    return out.select("grouping", value.alias("value"), "n", "hit_rate", "mrr", "seconds")


def sufficiency_means(results: DataFrame, score: str = "score", *by: str) -> DataFrame:
    """mean_all over judged rows; mean_positive over scores above 0; mean_positive_or_0 of a re-judged set."""
    positive = F.avg(F.when(F.col(score) > 0, F.col(score)))
    return results.groupBy(*by).agg(F.avg(score).alias("mean_all"), positive.alias("mean_positive"), F.coalesce(positive, F.lit(0.0)).alias("mean_positive_or_0"))


def session_averages(turns: DataFrame, *metrics: str) -> DataFrame:
    """Means for each session."""
    return turns.groupBy("session_id").agg(F.count("*").alias("n_turns"), *[F.avg(m).alias(f"mean_{m}") for m in metrics])


def overall_averages(turns: DataFrame, *metrics: str) -> DataFrame:
    """Means over all turns, not over sessions."""
    return turns.agg(F.count_distinct("session_id").alias("n_sessions"), F.count("*").alias("n_turns"), *[F.avg(m).alias(f"mean_{m}") for m in metrics])


def queryset_stats(queries: DataFrame) -> DataFrame:
    """Rows (stat, value, n): counts by type, difficulty and session, and n of cross-session queries."""
    by = [queries.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("stat"), "value", "n") for c in ("type", "difficulty")]
    sessions = queries.select(F.explode("relevant_sessions").alias("s")).groupBy("s").agg(F.count("*").alias("n")).select(F.lit("session").alias("stat"), F.col("s").cast("string").alias("value"), "n")
    cross = queries.groupBy().agg(F.count_if(F.size("relevant_sessions") > 1).alias("n")).select(F.lit("cross_session").alias("stat"), F.lit(None).cast("string").alias("value"), "n")
    return by[0].unionByName(by[1]).unionByName(sessions).unionByName(cross)


def query_problems() -> dict[str, Column]:
    """Tests that a query of an evaluation set fails, by name."""
    text = lambda c, low, high: ~F.coalesce(F.length(c).between(low, high), F.lit(False))
    return {
        "id": ~F.coalesce(F.rlike("id", F.lit(r"^q[0-9]{3}$")), F.lit(False)),
        "query": text("query", 10, 500),
        "expected_answer": text("expected_answer", 10, 1000),
        "required_context": text("required_context", 10, 1000),
        "reasoning_steps": text("reasoning_steps", 10, 1000),
        "type": ~F.coalesce(F.col("type").isin(*QUERY_TYPES), F.lit(False)),
        "difficulty": ~F.coalesce(F.col("difficulty").isin(*DIFFICULTIES), F.lit(False)),
        "source": ~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False)),
        "relevant_sessions": ~F.coalesce((F.size("relevant_sessions") > 0) & F.forall("relevant_sessions", lambda s: s.between(1, 100)), F.lit(False)),
    }


def validate_queries(queries: DataFrame) -> DataFrame:
    """Adds problems, the names of failed tests; a query is valid if there are none."""
    tests = F.array(*[F.when(test, name) for name, test in query_problems().items()])
    return queries.withColumn("problems", F.array_compact(tests))


def cost_rollup(usage: DataFrame) -> DataFrame:
    """Tokens, cost and calls for each model and in total (model is null)."""
    priced = usage.withColumn("cost", cost_usd(F.col("model"), F.col("input_tokens"), F.col("output_tokens")))
    return priced.rollup("model").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost_usd"), F.count("*").alias("calls")
    )


def latency_stats(log: DataFrame, seconds: str, *by: str) -> DataFrame:
    return log.groupBy(*by).agg(F.count("*").alias("n"), F.avg(seconds).alias("mean"), F.min(seconds).alias("least"), F.max(seconds).alias("most"), F.try_divide(F.count("*").cast("double"), F.sum(seconds)).alias("per_second"))


def hook_metrics(log: DataFrame) -> DataFrame:
    """Requests, texts, errors and mean latency of a hook, from its log."""
    return log.groupBy("hook").agg(F.count("*").alias("requests"), F.sum("texts").alias("texts"), F.count_if("failed").alias("errors"), F.avg("seconds").alias("mean_seconds"))


def embedding_ranking(facts: DataFrame, queries: DataFrame, relevant: DataFrame, key: str, vector: str = "embedding", cuts: tuple[int, ...] = (5, 10), **settings) -> DataFrame:
    """mrr and recall at each cut for each query that has relevant rows, over all facts but the query's own.

    ``relevant``: qid, ``key``. Of equal scores the higher key comes first. The best relevant row's rank is
    counted and recalls come from the top; no list of all facts is sorted."""
    top = search.top_k_blocks(facts, queries, max(cuts), key, vector, later_first=True, others=True, **settings)
    scored = search.score_pairs(relevant, facts, queries, key, vector).where("score IS NOT NULL")
    # scores of expressions and of products meet after rounding
    first = scored.withColumn("score", F.round("score", 12)).groupBy("qid").agg(F.max(F.struct("score", key)).alias("best")).select("qid", F.col(f"best.{key}").alias(key), "best.score")
    ranks = search.rank_counts(facts, queries, first, key, vector, later_first=True, others=True, **settings).select("qid", F.col("rank").alias("first"))
    hits = top.join(relevant, ["qid", key], "left_semi").groupBy("qid").agg(*[F.count_if(F.col("rank") <= k).alias(f"in_{k}") for k in cuts])
    n = relevant.groupBy("qid").agg(F.count("*").alias("n"))
    out = n.join(ranks, "qid", "left").join(hits, "qid", "left")
    return out.select("qid", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), *[(F.coalesce(F.col(f"in_{k}"), F.lit(0)).cast("double") / F.col("n")).alias(f"recall_at_{k}") for k in cuts])
