"""Iterative retrieval for a batch of queries.

Each round searches, drops hits below the threshold, keeps each fact once in order up to the cap,
and expands the first entities of queries that need more than one hop or name an entity. Facts found
by expansion pass without the threshold. A sufficiency hook (a model's reply for each query) may end a
query's search or name what is missing, which the next round looks for as well. A round is one plan
over all open queries; state is a written table between rounds. A query that is closed stays closed: its
facts and its report are those of that round, and no later round searches or asks for it. Without a hook
nothing changes once a round adds no fact, so the loop stops there and reports the rounds it would have
made.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom import config
from factloom.functions.metrics import heuristic_sufficiency
from factloom.functions.text import MULTI_HOP, classify_query, entity_candidates, first_entity, is_sufficient, missing_hint
from factloom.operators.search import entity_facts
from factloom.shared import saved


def plan_queries(queries: DataFrame, text: str = "text") -> DataFrame:
    """Adds query_type, entities and multi_hop."""
    kind = classify_query(F.col(text))
    return queries.withColumns({"query_type": kind, "entities": entity_candidates(F.col(text)), "multi_hop": kind.isin(*MULTI_HOP)})


def _merge(state: DataFrame, new: DataFrame, cap: int) -> DataFrame:
    """State and new hits: each fact once a query, in order of round and rank, up to the cap."""
    rows = state.unionByName(new)
    first = rows.groupBy("qid", "fact_id").agg(F.min(F.struct("round", "leg", "rank", "score")).alias("s")).select("qid", "fact_id", "s.*")
    order = Window.partitionBy("qid").orderBy("round", "leg", "rank", "fact_id")
    return first.withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= cap).drop("ord")


def entity_expansion(facts: DataFrame, edges: DataFrame, entities: DataFrame, plan: DataFrame, most: int = config.EXPANDED_ENTITIES) -> Callable[[DataFrame], DataFrame]:
    """An ``expand`` for :func:`retrieve`: the newest facts of each query's first ``most`` entities, those
    its text names before those of its facts. ``plan``: qid, entities, multi_hop."""
    wanted = plan.where(F.col("multi_hop") | (F.size("entities") > 0))

    def expand(state: DataFrame) -> DataFrame:
        named = wanted.select("qid", F.posexplode("entities").alias("place", "name")).withColumn("from_fact", F.lit(0))
        found = state.join(facts.select("fact_id", first_entity(F.col("entity_names")).alias("name")), "fact_id").join(wanted.select("qid"), "qid", "left_semi").where("name IS NOT NULL AND name <> ''")
        found = found.select("qid", (F.col("round") * 1_000_000 + F.col("leg") * 100_000 + F.col("rank")).cast("int").alias("place"), "name", F.lit(1).alias("from_fact"))
        order = F.struct("from_fact", "place", "name")
        names = named.unionByName(found).groupBy("qid", "name").agg(F.min(order).alias("first"))
        names = names.withColumn("turn", F.row_number().over(Window.partitionBy("qid").orderBy("first"))).where(F.col("turn") <= most)
        hits = entity_facts(facts, edges, entities, names.select("name").distinct(), fallback="entity_names").select("name", "fact_id", F.col("rank").alias("newest"))
        rows = names.join(hits, "name").groupBy("qid", "fact_id").agg(F.min(F.struct("turn", "newest")).alias("first"))
        return rows.select("qid", "fact_id", F.lit(1.0).alias("score"), F.row_number().over(Window.partitionBy("qid").orderBy("first", "fact_id")).alias("rank"))

    return expand


def retrieve(
    queries: DataFrame,
    search: Callable[[DataFrame], DataFrame],
    expand: Callable[[DataFrame], DataFrame] | None = None,
    threshold: float = 0.5,
    min_facts: int = config.MIN_FACTS,
    max_facts: int = config.MAX_FACTS,
    max_iterations: int = config.MAX_ITERATIONS,
    save: Callable[[DataFrame], DataFrame] = partial(saved, label="agent"),
    sufficiency: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``search(queries)`` gives (qid, fact_id, score, rank); ``expand(state)`` gives the same shape
    for entities of the state's facts; ``sufficiency(state)`` gives (qid, reply), a model's reply that
    ``is_sufficient`` and ``missing_hint`` read. What is missing is searched as the query's ``text``.
    Returns facts (qid, fact_id, score, ord) and one row for each query: n_facts, iterations,
    sufficient, confidence."""
    columns = ("qid", "fact_id", "score", "rank", "round", "leg")
    state: DataFrame | None = None
    open_, before = queries, None
    hints: DataFrame | None = None
    closed_states: list[DataFrame] = []
    reports: list[DataFrame] = []

    def leg(hits: DataFrame, i: int, number: int) -> DataFrame:
        return hits.select("qid", "fact_id", "score", F.col("rank").cast("long").alias("rank"), F.lit(i).alias("round"), F.lit(number).alias("leg"))

    def found(asked: DataFrame) -> DataFrame:
        hits = search(asked)
        return hits.where(F.col("score") >= threshold) if threshold > 0 else hits

    for i in range(1, max_iterations + 1):
        hits = leg(found(open_), i, 0)
        if hints is not None:
            refined = open_.drop("text").join(hints, "qid")
            hits = hits.unionByName(leg(found(refined), i, 1))
        merged = _merge(state if state is not None else hits.limit(0), hits, max_facts)
        if expand is not None:
            # read twice below
            merged = save(merged.select(*columns))
            more = leg(expand(merged), i, 2)
            merged = _merge(merged.select(*columns), more.join(open_.select("qid"), "qid", "left_semi"), max_facts)
        state = save(merged.select(*columns))
        n = state.groupBy("qid").agg(F.count("*").alias("n"), F.count_if(F.col("score") > 0.7).alias("high"), F.avg("score").alias("mean"))
        enough, confidence = heuristic_sufficiency(F.col("n"), F.col("high"), F.col("mean"))
        n = open_.select("qid").join(n, "qid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        if sufficiency is not None:
            asked = state.join(n.where((F.col("n") >= min_facts) & (F.col("n") < max_facts)).select("qid"), "qid", "left_semi")
            replies = save(sufficiency(asked).select("qid", "reply"))
            n = n.join(replies, "qid", "left")
            enough = F.coalesce(is_sufficient(F.col("reply")), F.lit(False))
            confidence = F.when(F.col("n") < min_facts, 0.0).when(enough, 0.9).otherwise(0.5)
            hints = replies.select("qid", missing_hint(F.col("reply")).alias("text")).where("text <> ''")
        done = F.when(F.col("n") >= max_facts, True).when(F.col("n") < min_facts, False).otherwise(enough)
        n = save(n.select("qid", "n", F.coalesce(done, F.lit(False)).alias("done"), F.when(F.col("n") >= max_facts, 1.0).otherwise(F.coalesce(confidence, F.lit(0.0))).alias("confidence"), F.lit(i).alias("at")))
        closed = n.where("done")
        # what is closed stays as it is: it is neither searched nor asked again
        reports.append(closed.select("qid", F.col("n").alias("n_facts"), F.col("at").alias("iterations"), "confidence"))
        closed_states.append(state.join(closed.select("qid"), "qid", "left_semi"))
        left = n.where("NOT done").select("qid")
        state, open_ = state.join(left, "qid", "left_semi"), open_.join(left, "qid", "left_semi")
        if hints is not None:
            hints = hints.join(left, "qid", "left_semi")
        total = n.agg(F.count_if("done"), F.count("*"), F.coalesce(F.sum(F.when(~F.col("done"), F.col("n"))), F.lit(0))).first()
        if total[0] == total[1] or (total[0] == 0 and before == tuple(total) and (hints is None or hints.isEmpty())):
            break
        # of the next round, nothing closes and nothing is added: then all further rounds are the same
        before = (0, total[1] - total[0], total[2])
    still = n.where("NOT done").select("qid", F.col("n").alias("n_facts"), F.lit(max_iterations).alias("iterations"), F.lit(0.8).alias("confidence"))
    report = reduce(DataFrame.unionByName, reports, still).select("qid", "n_facts", "iterations", F.lit(True).alias("sufficient"), "confidence")
    order = Window.partitionBy("qid").orderBy("round", "leg", "rank", "fact_id")
    facts = reduce(DataFrame.unionByName, closed_states, state)
    return facts.select("qid", "fact_id", "score", F.row_number().over(order).alias("ord")), report


def retrieve_for_turns(turns: DataFrame, search: Callable[[DataFrame], DataFrame], **settings) -> tuple[DataFrame, DataFrame]:
    """Turns (session_id, turn, speaker, date, text, ...) as queries; both results carry the first four."""
    queries = plan_queries(turns.withColumn("qid", F.concat_ws("/", "session_id", "turn")))
    about = turns.select(F.concat_ws("/", "session_id", "turn").alias("qid"), "session_id", "turn", "speaker", "date")
    hits, report = retrieve(queries, search, **settings)
    return hits.join(about, "qid"), report.join(queries.select("qid", "query_type", "multi_hop"), "qid").join(about, "qid")


def visible(hits: DataFrame, asked_at: Column, stored_at: Column) -> DataFrame:
    """As-of visibility: a query sees what was stored up to its own place in the sequence."""
    return hits.where(stored_at <= asked_at)
