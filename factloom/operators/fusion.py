"""Score fusion of vector and graph hits, and hybrid results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.config import GRAPH_BOOST, HYBRID_PASSAGES, JUDGED_FACTS, NAME_BOOST
from factloom.operators.search import best


def fuse(vector: DataFrame, graph: DataFrame, names: DataFrame, limit: int) -> DataFrame:
    """One row for each (qid, fact_text): fused score, source and rank.

    ``vector`` and ``graph``: qid, fact_text, score, entity_names; ``names``: qid, name, the resolved
    entities. With nv and k rows of the two kinds, v the lowest vector and g the best graph score:
    both kinds: greatest(v, g) + 0.07 k; vector only: v, or v + 0.02 if the lowest-scored row
    shares a resolved name; graph only: g + 0.07 (k - 1); never above 1. Ties by fact_text.
    """
    columns = ("qid", "fact_text", "score", "entity_names")
    rows = vector.select(*columns, F.lit(True).alias("v")).unionByName(graph.select(*columns, F.lit(False).alias("v")))
    low = lambda names_: F.transform(names_, lambda x: F.lower(x))
    grouped = rows.groupBy("qid", "fact_text").agg(
        F.count_if("v").alias("nv"),
        F.count_if(~F.col("v")).alias("k"),
        F.min(F.when(F.col("v"), F.col("score"))).alias("low"),
        F.max(F.when(~F.col("v"), F.col("score"))).alias("high"),
        # of rows with the lowest score, the first names in order
        F.min(F.when(F.col("v"), F.struct("score", low(F.col("entity_names")).alias("names"))))["names"].alias("names"),
    )
    known = names.where(F.length("name") >= 2).groupBy("qid").agg(F.collect_set(F.lower("name")).alias("resolved"))
    shared = F.coalesce(F.arrays_overlap("names", "resolved"), F.lit(False))
    fused = (
        F.when((F.col("nv") > 0) & (F.col("k") > 0), F.greatest("low", "high") + GRAPH_BOOST * F.col("k"))
        .when(F.col("nv") > 0, F.col("low") + F.when(shared, NAME_BOOST).otherwise(0.0))
        .otherwise(F.col("high") + GRAPH_BOOST * (F.col("k") - 1))
    )
    source = F.when((F.col("nv") > 0) & (F.col("k") == 0), "vector").when((F.col("nv") == 0) & (F.col("k") == 1), "entity_graph").otherwise("vector+graph")
    out = grouped.join(known, "qid", "left").select("qid", "fact_text", F.least(F.lit(1.0), fused).alias("score"), source.alias("source"))
    return best(out, limit, F.desc("score"), F.col("fact_text"))


def vector_fetch(limit: int) -> int:
    return max(3 * limit, limit + 10)


def graph_fetch(limit: int) -> int:
    return max(2 * limit, 20)


def hybrid(graph: DataFrame, passages: DataFrame, limit: int | None = None, supplement: int = HYBRID_PASSAGES) -> DataFrame:
    """Ranked facts, then the first passages, not merged: qid, source_type, content, score, ord.

    Both sides: qid, text, score, rank.
    """
    facts = graph.select("qid", F.lit("graph").alias("source_type"), F.concat(F.lit("[FACT] "), "text").alias("content"), "score", F.col("rank").cast("long").alias("ord"))
    n = graph.groupBy("qid").agg(F.count("*").alias("n"))
    extra = passages.where(F.col("rank") <= supplement).join(n, "qid", "left")
    extra = extra.select("qid", F.lit("passage").alias("source_type"), F.concat(F.lit("[DETAIL] "), "text").alias("content"), "score", (F.coalesce("n", F.lit(0)) + F.col("rank")).alias("ord"))
    out = facts.unionByName(extra)
    return out if limit is None else out.where(F.col("ord") <= limit)


def cached_hybrid(cache: DataFrame, passages: DataFrame, facts: int = JUDGED_FACTS, supplement: int = HYBRID_PASSAGES) -> DataFrame:
    """Hybrid results from the facts of an earlier run: ``cache``: qid, facts (texts in order), scores."""
    rows = cache.select("qid", F.posexplode(F.arrays_zip("facts", "scores")).alias("place", "fact")).where(F.col("place") < facts)
    return hybrid(rows.select("qid", F.col("fact.facts").alias("text"), F.col("fact.scores").alias("score"), (F.col("place") + 1).alias("rank")), passages, supplement=supplement)


def context(hits: DataFrame, text: str = "content", order: str = "ord", separator: str = "\n") -> DataFrame:
    """(qid, context): the texts of each query in order. A query has a bounded number of results."""
    rows = F.array_sort(F.collect_list(F.struct(order, text)))
    return hits.groupBy("qid").agg(F.array_join(F.transform(rows, lambda r: r[text]), separator).alias("context"))


def ordered_distinct(rows: DataFrame, by: str, item: str, position: Column | str) -> DataFrame:
    """Each item of a group once, at its first position: (by, item, ord) with ord from 1."""
    from pyspark.sql.window import Window

    first = rows.groupBy(by, item).agg(F.min(position).alias("__first"))
    return first.withColumn("ord", F.row_number().over(Window.partitionBy(by).orderBy("__first", item))).drop("__first")


def from_cache(queries: DataFrame, cache: DataFrame, fresh: Callable[[DataFrame], DataFrame], on: str = "qid") -> DataFrame:
    """Results (``on``, ...) of queries: those of an earlier run where there are any, and fresh ones for the
    rest, which alone are asked; adds origin. The two have the same columns."""
    kept = cache.join(queries.select(on), on, "left_semi").withColumn("origin", F.lit("cached"))
    asked = queries.join(cache.select(on).distinct(), on, "left_anti")
    return kept.unionByName(fresh(asked).withColumn("origin", F.lit("fresh")))
