"""Vector, entity and two-stage search over facts and passages.

Queries are batched: every operator takes a table of queries. Vectors are scored by matrix products, a
slice of facts with a block of queries, and each slice keeps its best rows for each query, so what is
moved is a few rows for each query and slice, not the scores of all facts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from factloom.functions.vectors import cosine, norm
from factloom.operators.products import CELL, FEW, LINKED_CELL, SCORES, Above, Best, fields, linked_product, product
from factloom.shared import saved

#: Queries that go to the tasks whole.
QUERY_BLOCK = FEW


def query_blocks(queries: DataFrame, block: int = QUERY_BLOCK) -> Iterator[DataFrame]:
    """The queries, in parts of at most about ``block`` rows."""
    n = queries.count()
    parts = -(-n // block)
    if parts <= 1:
        yield queries
        return
    for i in range(parts):
        yield queries.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i)


def best(hits: DataFrame, k: int, *order: Column, by: str = "qid", rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each query in ``order``, with their rank from 1."""
    return hits.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(rank) <= k)


def score_all(facts: DataFrame, queries: DataFrame, vector: str = "embedding") -> DataFrame:
    """Every query against every fact as rows: the fact's columns, qid and score. A table of this size is
    for checks on small data only; searches take :func:`top_k`, evaluations :func:`rank_counts`.

    ``facts`` may carry a ``norm`` column made at ingest; else it is computed once a fact.
    """
    out = None
    if "norm" not in facts.columns:
        facts = facts.withColumn("norm", norm(F.col(vector)))
    for part in query_blocks(queries):
        asked = part.select("qid", F.col(vector).alias("__q"), norm(F.col(vector)).alias("__qn"))
        pairs = facts.crossJoin(F.broadcast(asked)).withColumn("score", cosine(F.col("__q"), F.col(vector), F.col("__qn"), F.col("norm"))).drop("__q", "__qn", "norm")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def score_pairs(pairs: DataFrame, facts: DataFrame, queries: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """``pairs`` (qid, ``key``) with their score, null where a vector is missing, zero or of another size."""
    asked = queries.select("qid", F.col(vector).alias("__q"), norm(F.col(vector)).alias("__qn"))
    known = facts.select(key, F.col(vector).alias("__f"), norm(F.col(vector)).alias("__fn"))
    rows = pairs.join(known, key).join(asked, "qid")
    return rows.withColumn("score", cosine(F.col("__q"), F.col("__f"), F.col("__qn"), F.col("__fn"))).drop("__q", "__qn", "__f", "__fn")


def top_k(facts: DataFrame, queries: DataFrame, k: int, key: str, vector: str = "embedding") -> DataFrame:
    """Exact cosine top-k for each query: the facts' columns but the vector, qid, score and rank; ties
    by ``key``, which is unique. Vectors that are null, zero or of another size have no score."""
    hits = top_k_blocks(facts, queries, k, key, vector)
    further = [c for c in facts.columns if c not in (key, vector)]
    return hits.join(facts.select(key, *further), key) if further else hits


def top_k_blocks(facts: DataFrame, queries: DataFrame, k: int, key: str, vector: str = "embedding", later_first: bool = False, others: bool = False, few: int = QUERY_BLOCK, cell: int = CELL) -> DataFrame:
    """qid, ``key``, score and rank of the exact top-k. Queries up to ``few`` (counted) go to the facts'
    tasks; more meet the facts in cells (see :mod:`factloom.operators.products`). A task or cell keeps its
    best ``k`` for each query, then a window, which runs partly before the shuffle, keeps the best of all.

    Ties by ``key``, with ``later_first`` the highest first; with ``others`` a query never meets the row
    of its own id."""
    settings = (key, vector, SCORES, others)
    kinds = fields(("qid", queries.schema["qid"].dataType), (key, facts.schema[key].dataType), ("score", T.DoubleType()))
    hits = product(facts, queries.select("qid", vector), key, vector, lambda asked: Best(asked, *settings, k=k, later_first=later_first), kinds, few, cell)
    return best(hits, k, F.desc("score"), F.desc(key) if later_first else F.col(key))


def top_k_linked(facts: DataFrame, edges: DataFrame, asked: DataFrame, queries: DataFrame, k: int, key: str, vector: str = "embedding", cell: int = LINKED_CELL) -> DataFrame:
    """qid, ``key``, score and rank of the exact top-k among the facts that share a group with the query.

    ``edges``: in_id (a fact's key), out_id (its group); ``asked``: qid, out_id; rows given twice count once.
    Facts and queries meet in cells of their groups (:func:`factloom.operators.products.linked_product`), each
    of which keeps its best ``k`` for each query, so what moves grows with the edges and links, not with
    the pairs they make. Ties by ``key``."""
    asked = asked.select("qid", "out_id").distinct()
    edges = edges.select(F.col("in_id").alias(key), "out_id").distinct()
    kinds = fields(("qid", queries.schema["qid"].dataType), (key, facts.schema[key].dataType), ("score", T.DoubleType()))
    known = edges.join(facts.select(key, vector), key)
    wanted = asked.join(queries.select("qid", vector), "qid")
    hits = linked_product(known, wanted, key, vector, "out_id", lambda rows: Best(rows, key, vector, SCORES, False, k=k), kinds, cell)
    # a fact may be met in several groups of a query
    return best(hits.groupBy("qid", key).agg(F.max("score").alias("score")), k, F.desc("score"), F.col(key))


def rank_counts(facts: DataFrame, queries: DataFrame, marks: DataFrame, key: str, vector: str = "embedding", later_first: bool = False, others: bool = False, few: int = QUERY_BLOCK, cell: int = CELL) -> DataFrame:
    """The rank among all facts of marked rows: qid, ``key``, rank. ``marks``: qid, ``key``, score.

    Ranks are counted, not sorted: each task or cell says how many of its facts lie above each mark, and
    the sums are the ranks. The work is marks times facts; what moves is a number for each mark and task."""
    named = marks.select("qid", F.col(key).alias("mark_key"), F.col("score").alias("mark_score"))
    asked = queries.select("qid", vector).join(named, "qid")
    kinds = fields(("qid", queries.schema["qid"].dataType), ("mark_key", marks.schema[key].dataType), ("above", T.LongType()))
    settings = (key, vector, SCORES, others)
    counts = product(facts, asked, key, vector, lambda rows: Above(rows, *settings, later_first=later_first), kinds, few, cell)
    return counts.groupBy("qid", F.col("mark_key").alias(key)).agg((F.sum("above") + 1).alias("rank"))


def above(hits: DataFrame, threshold: float) -> DataFrame:
    """Hits at or above a threshold; a threshold of 0 or less keeps all. Apply after the top-k."""
    return hits.where(F.col("score") >= threshold) if threshold > 0 else hits


def two_stage(facts: DataFrame, queries: DataFrame, key: str, candidates: int, threshold: float, results: int, rerank: Column | None = None, vector: str = "embedding") -> DataFrame:
    """Candidates by vector, then the threshold, then the best by ``rerank`` (default: the score), which
    may use further columns of ``queries``."""
    found = above(top_k(facts, queries, candidates, key, vector).withColumnRenamed("rank", "original_rank"), threshold)
    further = [c for c in queries.columns if c not in ("qid", vector)]
    if further:
        found = found.join(queries.select("qid", *further), "qid")
    found = found.withColumn("rerank_score", F.col("score") if rerank is None else rerank)
    return best(found, results, F.desc("rerank_score"), F.col("original_rank"))


def rerank_prompt(candidates: DataFrame, text: str = "text", batch: int = 10, longest: int = 500) -> DataFrame:
    """(qid, batch, passages): numbered passages of each call to a reranker, from 0 in each batch of
    ``batch``, long ones cut. ``candidates``: qid, position from 0, text."""
    shown = F.when(F.length(text) > longest, F.concat(F.left(text, F.lit(longest)), F.lit("..."))).otherwise(F.col(text))
    place = F.col("position") % batch
    rows = candidates.select("qid", F.floor(F.col("position") / batch).alias("batch"), F.struct(place.alias("place"), F.concat(F.lit("["), place.cast("string"), F.lit("] "), shown).alias("line")).alias("row"))
    return rows.groupBy("qid", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["line"]), "\n").alias("passages"))


def rerank_scores(candidates: DataFrame, replies: DataFrame, batch: int = 10) -> DataFrame:
    """Scores of candidates (qid, position from 0) from a reranker's JSON replies.

    ``replies``: qid and reply, with ``batch`` (positions count from 0 in each batch of ``batch``) and
    ``failed`` where there are such. A candidate that the reply leaves out scores 0.5; an unreadable
    reply gives 1 - 0.05 * place; a call that failed otherwise 0.5; a single candidate 1.
    """
    from factloom.functions.text import strip_fence
    from factloom.schemas import RERANK_JSON

    calls = replies if "batch" in replies.columns else replies.withColumn("batch", F.lit(0).cast("long"))
    calls = calls if "failed" in calls.columns else calls.withColumn("failed", F.lit(False))
    parsed = calls.select("qid", "batch", "failed", F.from_json(strip_fence(F.col("reply")), RERANK_JSON).alias("scores"))
    whole = F.lit(batch) if "batch" in replies.columns else F.lit(1 << 30)
    rows = candidates.withColumns({"batch": F.floor(F.col("position") / whole), "__place": F.col("position") % whole})
    alone = candidates.groupBy("qid").agg((F.count("*") == 1).alias("__alone"))
    given = F.filter("scores", lambda s: s["passage_id"] == F.col("__place"))
    found = rows.join(parsed, ["qid", "batch"], "left").join(alone, "qid")
    score = (
        F.when(F.col("__alone"), 1.0).when(F.col("failed"), 0.5).when(F.col("scores").isNull(), 1.0 - F.col("__place") * 0.05)
        .otherwise(F.coalesce(F.try_element_at(given, F.lit(1))["score"], F.lit(0.5)))
    )
    return found.withColumn("rerank_score", score).drop("scores", "failed", "batch", "__place", "__alone")


#: Sizes of the grams that names are joined by.
GRAMS = (12, 6, 3, 2)


def _grams(text: Column, size: int) -> Column:
    """Distinct character n-grams of a text; shorter texts have none."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


def resolve_entities(queries: DataFrame, entities: DataFrame, text: str = "text", limit: int = 25) -> DataFrame:
    """Entities whose name, of two characters or more, is part of the query: (qid, entity_id, name).

    Equal texts are looked up once. Joined by a key: each name goes under the rarest of its grams that the
    texts hold, of the longest size in ``GRAMS`` that fits it, so that names which begin alike still differ
    in their key; a name with a gram that no text holds cannot match, and the name is then looked for in the
    texts under its gram. At most ``limit`` names of a query stay, in order of name; so of the entities with
    one name no more are needed, however many bear it.
    """
    asked = queries.select("qid", F.lower(text).alias("__low")).where("__low IS NOT NULL")
    # written, so that the numbers of the texts stay
    texts = saved(asked.select("__low").distinct().withColumn("__text", F.monotonically_increasing_id()), "texts")
    named = entities.where(F.length("name") >= 2).select("entity_id", "name", F.lower("name").alias("__name"))
    grams = texts.select("__text", F.explode(F.concat(*[_grams(F.col("__low"), n) for n in GRAMS])).alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("n"))
    own = reduce(lambda rest, n: F.when(F.length("__name") >= n, _grams(F.col("__name"), n)).otherwise(rest), sorted(GRAMS), F.array("__name"))
    names = named.select("__name").distinct().select("__name", F.size(own).alias("size"), F.explode(own).alias("gram"))
    keyed = names.join(often, "gram").groupBy("__name").agg(F.first("size").alias("size"), F.count("*").alias("found"), F.min(F.struct("n", "gram")).alias("rarest"))
    keyed = keyed.where("found = size").select("__name", F.col("rarest.gram").alias("gram"))
    pairs = grams.join(keyed, "gram").join(texts, "__text").where(F.contains("__low", F.col("__name"))).select("__text", "__name")
    pairs = saved(pairs, "names")
    first = best(named.join(pairs.select("__name").distinct(), "__name", "left_semi"), limit, F.col("name"), F.col("entity_id"), by="__name").drop("rank")
    found = best(pairs.join(first, "__name").select("__text", "entity_id", "name"), limit, F.col("name"), F.col("entity_id"), by="__text")
    lists = saved(found.groupBy("__text").agg(F.collect_list(F.struct("entity_id", "name")).alias("__names")), "lists")
    # a query with several texts has its first names among those of each
    owners = asked.join(texts, "__low").groupBy("qid").agg(F.collect_list("__text").alias("__texts"))
    rows = owners.select("qid", (F.size("__texts") == 1).alias("__one"), F.explode("__texts").alias("__text")).join(lists, "__text").select("qid", "__one", F.inline("__names"))
    several = best(rows.where("NOT __one").drop("__one"), limit, F.col("name"), F.col("entity_id")).drop("rank")
    return rows.where("__one").drop("__one").unionByName(several)


def facts_of_entities(facts: DataFrame, edges: DataFrame, matched: DataFrame, key: str = "fact_id") -> DataFrame:
    """Facts with an edge to a matched entity: a semi-join, so an edge given twice counts once."""
    linked = edges.join(matched.select(F.col("entity_id").alias("out_id")), "out_id", "left_semi")
    return facts.join(linked, facts[key] == linked["in_id"], "left_semi")


def entity_facts(facts: DataFrame, edges: DataFrame, entities: DataFrame, names: DataFrame, limit: int = 20, key: str = "fact_id", created: str = "created_at", fallback: str | None = None) -> DataFrame:
    """Newest facts of each name in ``names`` (name): by edges, names compared without case.

    ``fallback`` names an array column of the facts that is searched, with case, for names without
    any fact by edges. The score is 1; columns name, source and rank are added.
    """
    asked = names.select("name", F.lower("name").alias("__low")).distinct()
    found = entities.select("entity_id", F.lower("name").alias("__low")).join(asked, "__low")
    rows = found.join(edges, found["entity_id"] == edges["out_id"]).select("name", F.col("in_id").alias(key)).distinct()
    hits = facts.join(rows, key).withColumn("source", F.lit("entity_expand"))
    if fallback:
        without = asked.join(rows, "name", "left_anti")
        extra = facts.withColumn("name", F.explode(F.array_distinct(fallback))).join(without.select("name"), "name", "left_semi")
        hits = hits.unionByName(extra.withColumn("source", F.lit("entity_names")).select(*hits.columns))
    return best(hits.withColumn("score", F.lit(1.0)), limit, F.desc(created), F.col(key), by="name")


def graph_search(facts: DataFrame, edges: DataFrame, entities: DataFrame, queries: DataFrame, limit: int, key: str = "fact_id", vector: str = "embedding") -> DataFrame:
    """Vector leg, entity leg and their fusion: qid, fact_text, score, source and rank.

    The entity leg scores only the facts that are linked to an entity of the query, by entity.
    """
    from factloom.operators import fusion

    matched = saved(resolve_entities(queries, entities), "matched")
    near = top_k(facts, queries, fusion.vector_fetch(limit), key, vector)
    graph = top_k_linked(facts, edges, matched.select("qid", F.col("entity_id").alias("out_id")), queries, fusion.graph_fetch(limit), key, vector)
    graph = graph.join(facts.select(key, "fact_text", "entity_names"), key)
    return fusion.fuse(near, graph, matched.select("qid", "name"), limit)


def temporal(hits: DataFrame, n: int, before: Column | None, after: Column | None, valid_at: str = "valid_at") -> DataFrame:
    """The first ``n`` of ranked hits within inclusive bounds; hits without a time pass.

    ``hits`` are the best 2 * n: the bounds are applied after that cut, never below it.
    """
    rows = hits.where(F.col("rank") <= 2 * n)
    for bound, bad in ((before, lambda c: F.col(valid_at) > c), (after, lambda c: F.col(valid_at) < c)):
        if bound is not None:
            rows = rows.where(F.col(valid_at).isNull() | ~bad(bound))
    return best(rows.withColumnRenamed("rank", "__rank"), n, F.col("__rank")).drop("__rank")


def session_of_facts(facts: DataFrame, episodes: DataFrame, limit: int = 15) -> DataFrame:
    """(qid, session_id, ord): sessions of each query's first ``limit`` facts, in order, each once.

    ``facts``: qid, rank and episode_name, carried through the search, so this is a key join.
    """
    from factloom.functions.text import session_number

    named = facts.where(F.col("rank") <= limit).join(episodes.select(F.col("name").alias("episode_name")).distinct(), "episode_name")
    return named.withColumn("session_id", session_number(F.col("episode_name"))).where("session_id IS NOT NULL").groupBy("qid", "session_id").agg(F.min("rank").alias("ord"))


def session_of_texts(facts: DataFrame, stored: DataFrame, limit: int = 15, **settings) -> DataFrame:
    """The same for facts without an episode name, by looking their text up in stored facts: one pass of the
    stored texts for all needles (see :mod:`factloom.operators.needles`)."""
    from factloom.functions.text import needle, session_number
    from factloom.operators.needles import least_holding

    asked = facts.where(F.col("rank") <= limit).select("qid", "rank", needle(F.col("fact_text")).alias("needle"))
    hits = asked.join(least_holding(stored, asked, "fact_text", "episode_name", **settings), "needle")
    return hits.withColumn("session_id", session_number(F.col("episode_name"))).where("session_id IS NOT NULL").groupBy("qid", "session_id").agg(F.min("rank").alias("ord"))
