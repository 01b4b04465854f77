"""Search queries: ``embeddings`` as facts (label as entity), ``orders`` and ``lineitem`` as a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.config import DIRECT, FAIR, NO_RERANK
from factloom.functions.text import classify_query, entity_candidates, first_entity, is_sufficient, missing_hint, tokens
from factloom.operators import agent, fusion, history, search, vector_index
from factloom.operators.windows import utc
from factloom.plans.registry import Registry, table

add = Registry()

LIMIT = 10
#: Rows that ask: all ids divisible by 100, against all rows.
ASKING = "vec_id % 100 = 0"

SCORED = """
WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 100 = 0),
f AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
s AS (SELECT q.qid, q.label AS qlabel, f.vec_id, f.label, list_cosine_similarity(q.v, f.v) AS score FROM q, f)"""


def facts(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("fact_id"), F.concat(F.lit("fact "), F.col("vec_id").cast("string")).alias("fact_text"), "embedding", F.array(F.concat(F.lit("Entity "), F.col("label").cast("string"))).alias("entity_names"), "label")


def asked(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").where(ASKING).select(F.col("vec_id").alias("qid"), "embedding", "label")


def by_label(facts: DataFrame) -> DataFrame:
    """Labels as groups of facts."""
    return facts.select(F.col("fact_id").alias("in_id"), F.col("label").alias("out_id"))


def _scores(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("qid", *columns, F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@add("topk_cosine", SCORED + """
SELECT qid, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def topk_cosine(spark, sf):
    return _scores(search.top_k(facts(spark, sf), asked(spark, sf), LIMIT, "fact_id").withColumnRenamed("fact_id", "vec_id"), "vec_id")


@add("topk_cosine_blocks", """
WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 10 = 0),
s AS (SELECT q.qid, f.vec_id, list_cosine_similarity(q.v, f.embedding::DOUBLE[]) AS score FROM q, embeddings f)
SELECT qid, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def topk_cosine_blocks(spark, sf):
    e = table(spark, sf, "embeddings")
    queries = e.where(F.col("vec_id") % 10 == 0).select(F.col("vec_id").alias("qid"), "embedding")
    return _scores(search.top_k_blocks(e, queries, LIMIT, "vec_id"), "vec_id")


@add("topk_index", add.sql["topk_cosine"])
def topk_index(spark, sf):
    """The same search by the pivot index, which skips rings that cannot hold a better row."""
    index = vector_index.build(table(spark, sf, "embeddings"), "vec_id", ring_rows=128)
    return _scores(vector_index.search_index(index, asked(spark, sf), LIMIT)[0], "vec_id")


@add("topk_cosine_threshold", SCORED + """
SELECT qid, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 50 AND score >= 0.2""")
def topk_cosine_threshold(spark, sf):
    hits = search.top_k(facts(spark, sf), asked(spark, sf), FAIR.embedding_top_k, "fact_id").withColumnRenamed("fact_id", "vec_id")
    return _scores(search.above(hits, 0.2), "vec_id")


@add("two_stage_rerank", SCORED + """
, c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS original_rank FROM s),
r AS (SELECT *, (CASE WHEN label = qlabel THEN 1.0 ELSE 0.0 END) AS rerank_score FROM c WHERE original_rank <= 50 AND score >= 0.1)
SELECT qid, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, original_rank) AS rank FROM r) WHERE rank <= 10""")
def two_stage_rerank(spark, sf):
    q = asked(spark, sf).withColumnRenamed("label", "wanted")
    out = search.two_stage(facts(spark, sf), q, "fact_id", FAIR.embedding_top_k, 0.1, FAIR.rerank_top_k, F.when(F.col("wanted") == F.col("label"), 1.0).otherwise(0.0))
    return _scores(out.withColumnRenamed("fact_id", "vec_id"), "vec_id")


FUSED = SCORED + """
, t AS (SELECT *, {text} AS fact_text FROM s),
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS r FROM t) WHERE r <= 30),
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS r FROM t WHERE label = qlabel) WHERE r <= 20),
a AS (SELECT qid, fact_text, score, label = qlabel AS shared, true AS vec FROM v UNION ALL SELECT qid, fact_text, score, true, false FROM g),
m AS (SELECT qid, fact_text, count(*) FILTER (vec) AS nv, count(*) FILTER (NOT vec) AS k, min(score) FILTER (vec) AS low, max(score) FILTER (NOT vec) AS high,
  arg_min(shared, score) FILTER (vec) AS shared FROM a GROUP BY 1, 2),
x AS (SELECT qid, fact_text, least(1.0, CASE WHEN nv > 0 AND k > 0 THEN greatest(low, high) + 0.07 * k WHEN nv > 0 THEN low + CASE WHEN shared THEN 0.02 ELSE 0.0 END ELSE high + 0.07 * (k - 1) END) AS score,
  CASE WHEN nv > 0 AND k = 0 THEN 'vector' WHEN nv = 0 AND k = 1 THEN 'entity_graph' ELSE 'vector+graph' END AS source FROM m)
SELECT qid, fact_text, round(score, 6) AS score, source, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, fact_text) AS rank FROM x) WHERE rank <= 10"""


def graph_parts(spark, sf, text=None):
    """Facts, edges, entities and queries with a text that names their entity."""
    f = facts(spark, sf)
    f = f if text is None else f.withColumn("fact_text", text)
    edges = f.select(F.col("fact_id").alias("in_id"), F.concat(F.lit("e"), F.col("label").cast("string")).alias("out_id"))
    entities = f.select(F.concat(F.lit("e"), F.col("label").cast("string")).alias("entity_id"), F.col("entity_names")[0].alias("name")).distinct()
    q = asked(spark, sf).withColumn("text", F.concat(F.lit("What about ENTITY "), F.col("label").cast("string"), F.lit("?")))
    return f, edges, entities, q


@add("fused_search", FUSED.replace("{text}", "'fact ' || vec_id"))
def fused_search(spark, sf):
    return _scores(search.graph_search(*graph_parts(spark, sf), LIMIT), "fact_text", "source")


@add("fused_name_boost", FUSED.replace("{text}", "'fact ' || vec_id % 97"))
def fused_name_boost(spark, sf):
    """Several facts share a text, so that rows of both legs meet."""
    return _scores(search.graph_search(*graph_parts(spark, sf, F.concat(F.lit("fact "), (F.col("fact_id") % 97).cast("string"))), LIMIT), "fact_text", "source")


@add("temporal_search", FUSED.replace("{text}", "'fact ' || vec_id").replace("r <= 30", "r <= 60").replace("r <= 20", "r <= 40").split("SELECT qid, fact_text, round")[0] + """
, y AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, fact_text) AS r, CAST(replace(fact_text, 'fact ', '') AS BIGINT) AS id FROM x),
z AS (SELECT *, CASE WHEN id % 11 <> 0 THEN DATE '2024-01-01' + CAST(id % 30 AS INTEGER) END AS valid_at FROM y WHERE r <= 20)
SELECT qid, fact_text, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY r) AS rank FROM z WHERE valid_at IS NULL OR valid_at BETWEEN DATE '2024-01-05' AND DATE '2024-01-25') WHERE rank <= 10""")
def temporal_search(spark, sf):
    """Graph search for twice the results, then the bounds."""
    hits = search.graph_search(*graph_parts(spark, sf), 2 * LIMIT)
    number = F.replace("fact_text", F.lit("fact "), F.lit("")).cast("long")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (number % 30).cast("int"))
    hits = hits.withColumn("valid_at", F.when(number % 11 != 0, day))
    return _scores(search.temporal(hits, LIMIT, F.lit("2024-01-25").cast("date"), F.lit("2024-01-05").cast("date")), "fact_text")


@add("entity_resolve", """
WITH p AS (SELECT doc_id AS qid, c_name, c_custkey FROM (SELECT doc_id, lower('ask ' || 'customer#' || lpad(CAST(doc_id % 40 AS VARCHAR), 9, '0') || ' of nation_1' || doc_id % 7) AS low FROM documents) d, customer WHERE contains(low, lower(c_name)) AND length(c_name) >= 2),
n AS (SELECT qid, c_name AS name FROM p UNION ALL
  SELECT doc_id, n_name FROM (SELECT doc_id, lower('ask ' || 'customer#' || lpad(CAST(doc_id % 40 AS VARCHAR), 9, '0') || ' of nation_1' || doc_id % 7) AS low FROM documents) d, nation WHERE contains(low, lower(n_name)))
SELECT qid, name FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY name) AS r FROM n) WHERE r <= 25""")
def entity_resolve(spark, sf):
    low = F.concat(F.lit("ask customer#"), F.lpad((F.col("doc_id") % 40).cast("string"), 9, "0"), F.lit(" of nation_1"), (F.col("doc_id") % 7).cast("string"))
    q = table(spark, sf, "documents").select(F.col("doc_id").alias("qid"), low.alias("text"))
    entities = table(spark, sf, "customer").select(F.col("c_name").alias("name")).unionByName(table(spark, sf, "nation").select(F.col("n_name").alias("name")))
    return search.resolve_entities(q, entities.withColumn("entity_id", F.col("name"))).select("qid", "name")


def order_graph(spark, sf):
    """Orders as facts, parts as entities, lineitems as edges."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("fact_id"), F.col("o_orderdate").alias("created_at"))
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("in_id"), F.col("l_partkey").alias("out_id"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"))
    return o, e, p


@add("entity_facts", """
WITH n AS (SELECT DISTINCT p_name AS name, lower(p_name) AS low FROM part),
x AS (SELECT DISTINCT n.name, l_orderkey AS k FROM n JOIN part p ON lower(p.p_name) = n.low JOIN lineitem ON l_partkey = p.p_partkey)
SELECT name, k AS fact_id, rank FROM (SELECT name, k, row_number() OVER (PARTITION BY name ORDER BY o_orderdate DESC, k) AS rank FROM x JOIN orders ON o_orderkey = k) WHERE rank <= 20""")
def entity_facts(spark, sf):
    o, e, p = order_graph(spark, sf)
    names = table(spark, sf, "part").select(F.col("p_name").alias("name"))
    return search.entity_facts(o, e, p, names).select("name", "fact_id", F.col("rank").cast("long").alias("rank"))


@add("entity_facts_fallback", """
WITH f AS (SELECT o_orderkey AS k, o_orderdate AS d, CASE WHEN o_orderkey % 5 = 0 THEN [o_orderpriority, o_orderstatus] ELSE [o_orderstatus] END AS names FROM orders),
e AS (SELECT p_partkey, p_name FROM part),
a AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT o_orderpriority FROM orders),
x AS (SELECT DISTINCT a.name, l_orderkey AS k FROM a JOIN e ON lower(e.p_name) = lower(a.name) JOIN lineitem ON l_partkey = e.p_partkey),
h AS (SELECT x.name, x.k, f.d, 'entity_expand' AS source FROM x JOIN f ON f.k = x.k
  UNION ALL SELECT a.name, f.k, f.d, 'entity_names' FROM a JOIN f ON list_contains(f.names, a.name) WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.name = a.name))
SELECT name, k AS fact_id, source, rank FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY d DESC, k) AS rank FROM h) WHERE rank <= 20""")
def entity_facts_fallback(spark, sf):
    """All parts are asked for; order priorities are the names without an entity."""
    _, e, p = order_graph(spark, sf)
    o = table(spark, sf, "orders")
    f = o.select(F.col("o_orderkey").alias("fact_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderkey") % 5 == 0, F.array("o_orderpriority", "o_orderstatus")).otherwise(F.array("o_orderstatus")).alias("entity_names"))
    names = p.select("name").unionByName(o.select(F.col("o_orderpriority").alias("name"))).distinct()
    out = search.entity_facts(f, e, p, names, fallback="entity_names")
    return out.select("name", "fact_id", "source", F.col("rank").cast("long").alias("rank"))


@add("semi_facts", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red')))")
def semi_facts(spark, sf):
    _, e, p = order_graph(spark, sf)
    f = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return search.facts_of_entities(f, e, p.where(F.contains(F.lower("name"), F.lit("red"))), "o_orderkey")


@add("anti_facts", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_facts(spark, sf):
    pending = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", "c_name").join(pending, "c_custkey", "left_anti")


@add("temporal_filter", """
WITH t AS (SELECT event_type AS qid, event_id, value, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS valid_at FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY value DESC, event_id) AS r FROM t)
SELECT qid, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY r) AS rank FROM r
  WHERE r <= 40 AND (valid_at IS NULL OR (valid_at <= TIMESTAMP '2024-01-20' AND valid_at >= TIMESTAMP '2024-01-05'))) WHERE rank <= 20""")
def temporal_filter(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("qid"), "event_id", "value", F.when(F.col("event_id") % 11 != 0, utc("ts")).alias("valid_at"))
    hits = search.best(e, 40, F.desc("value"), F.col("event_id"))
    out = search.temporal(hits, 20, F.lit("2024-01-20").cast("timestamp"), F.lit("2024-01-05").cast("timestamp"))
    return out.select("qid", "event_id", F.col("rank").cast("long").alias("rank"))


@add("hybrid_union", SCORED + """
, g AS (SELECT qid, 'fact ' || vec_id AS text, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS r FROM s WHERE label = qlabel),
p AS (SELECT qid, 'passage ' || vec_id AS text, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS r FROM s),
n AS (SELECT qid, least(count(*), 15) AS n FROM g GROUP BY qid)
SELECT qid, 'graph' AS source_type, '[FACT] ' || text AS content, round(score, 6) AS score, r AS ord FROM g WHERE r <= 15
UNION ALL SELECT p.qid, 'passage', '[DETAIL] ' || text, round(score, 6), coalesce(n, 0) + r FROM p LEFT JOIN n USING (qid) WHERE r <= 5""")
def hybrid_union(spark, sf):
    f, q = facts(spark, sf), asked(spark, sf)
    graph = search.top_k_linked(f, by_label(f), q.select("qid", F.col("label").alias("out_id")), q, 15, "fact_id").join(f.select("fact_id", F.col("fact_text").alias("text")), "fact_id")
    passages = search.top_k(f.select("fact_id", "embedding"), q, DIRECT.rerank_top_k, "fact_id").withColumn("text", F.concat(F.lit("passage "), F.col("fact_id").cast("string")))
    return fusion.hybrid(graph, passages).withColumn("score", F.round("score", 6))


@add("hybrid_cached", """
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'fresh' ELSE 'cached' END AS origin, CAST(coalesce(l.quality, d.n_chars % 2) AS BIGINT) AS score FROM documents d LEFT JOIN labels l USING (doc_id)""")
def hybrid_cached(spark, sf):
    """Results of an earlier run where there are any, else fresh ones."""
    cache = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("score"))
    d = table(spark, sf, "documents")
    fresh = lambda asked: asked.join(d.select("doc_id", (F.col("n_chars") % 2).alias("score")), "doc_id")
    return fusion.from_cache(d.select("doc_id"), cache, fresh, "doc_id").select("doc_id", "origin", "score")


@add("topk_no_rerank", SCORED + """
SELECT qid, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def topk_no_rerank(spark, sf):
    """The preset without a second stage: no threshold, as many results as candidates."""
    out = search.two_stage(facts(spark, sf), asked(spark, sf), "fact_id", NO_RERANK.embedding_top_k, NO_RERANK.similarity_threshold, NO_RERANK.num_results)
    return _scores(out.withColumnRenamed("fact_id", "vec_id"), "vec_id")


@add("first_entity", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS entity_name FROM orders")
def first_entity_of_facts(spark, sf):
    """Orders as facts with two names, or with none."""
    o = table(spark, sf, "orders")
    names = F.when(F.col("o_orderkey") % 3 > 0, F.array("o_orderpriority", "o_orderstatus")).otherwise(F.array().cast("array<string>"))
    return o.select("o_orderkey", first_entity(names).alias("entity_name"))


@add("embed_dimension", """
WITH e AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT vec_id, CAST(len(v) AS INTEGER) AS dim, round(v[1] / sqrt(list_dot_product(v, v)), 5) AS first FROM e""")
def embed_dimension(spark, sf):
    """Stored vectors cut to eight numbers by the step that embedders with an output dimension take."""
    from factloom.hooks import shortened

    cut = shortened(lambda v: v, 8)(F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.size(cut).alias("dim"), F.round(cut[0].cast("double"), 5).alias("first"))


@add("ordered_distinct", """
WITH f AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2)
SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY first) AS ord FROM f""")
def ordered_distinct(spark, sf):
    return fusion.ordered_distinct(table(spark, sf, "events"), "user_id", "event_type", "event_id").withColumn("ord", F.col("ord").cast("long"))


@add("asof_visibility", """
WITH q AS (SELECT conv_id, turn AS asked FROM conversations WHERE role = 'user'),
v AS (SELECT q.conv_id, q.asked, c.turn, row_number() OVER (PARTITION BY q.conv_id, q.asked ORDER BY length(c.text) DESC, c.turn) AS rank FROM q JOIN conversations c ON c.conv_id = q.conv_id AND c.turn <= q.asked)
SELECT conv_id, asked, turn, rank FROM v WHERE rank <= 3""")
def asof_visibility(spark, sf):
    """The longest three turns that each user turn can see, itself included."""
    c = table(spark, sf, "conversations").withColumn("size", F.length("text"))
    seen = history.running_top(c, "conv_id", "turn", "size", 3)
    asking = c.where("role = 'user'").select("conv_id", F.col("turn").alias("asked"))
    return seen.join(asking, ["conv_id", "asked"], "left_semi").select("conv_id", "asked", "turn", "rank")


@add("agent_retrieve", SCORED + """
, c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS r FROM s),
h AS (SELECT qid, vec_id, label, qlabel, score, 0 AS leg, r FROM c WHERE r <= 10 AND score >= 0.1),
l AS (SELECT DISTINCT qid, label FROM h WHERE r <= 3),
x AS (SELECT c.qid, c.vec_id, c.score, 1 AS leg, row_number() OVER (PARTITION BY c.qid ORDER BY c.score DESC, c.vec_id) AS r FROM c JOIN l ON l.qid = c.qid AND l.label = c.label),
a AS (SELECT qid, vec_id, score, leg, r FROM h UNION ALL SELECT qid, vec_id, score, leg, r FROM x WHERE r <= 20),
d AS (SELECT *, row_number() OVER (PARTITION BY qid, vec_id ORDER BY leg, r) AS once FROM a)
SELECT qid, vec_id, round(score, 6) AS score, ord FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY leg, r, vec_id) AS ord FROM d WHERE once = 1) WHERE ord <= 15""")
def agent_retrieve(spark, sf):
    return looped(spark, sf)[0].select("qid", F.col("fact_id").alias("vec_id"), F.round("score", 6).alias("score"), F.col("ord").cast("long").alias("ord"))


def looped(spark, sf):
    """Two legs a round: vector hits above the threshold, then the entities of the first hits."""
    f, q = facts(spark, sf), asked(spark, sf)

    def look(open_):
        return search.top_k(f.select("fact_id", "embedding"), q.join(open_.select("qid"), "qid", "left_semi"), 10, "fact_id")

    def expand(state):
        labels = state.where("leg = 0 AND rank <= 3").join(f.select("fact_id", "label"), "fact_id").select("qid", "label").distinct()
        return search.top_k_linked(f, by_label(f), labels.withColumnRenamed("label", "out_id"), q, 20, "fact_id")

    return agent.retrieve(q, look, expand, threshold=0.1)


@add("agent_report", add.sql["agent_retrieve"].split("SELECT qid, vec_id, round")[0] + """
, o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY leg, r, vec_id) AS ord FROM d WHERE once = 1),
n AS (SELECT qid, count(*) AS n, count(*) FILTER (score > 0.7) AS high, avg(score) AS mean FROM o WHERE ord <= 15 GROUP BY qid),
k AS (SELECT *, n >= 15 OR (n >= 5 AND (high >= 5 OR (n >= 10 AND mean > 0.6))) AS done FROM n)
SELECT qid, n AS n_facts, CASE WHEN done THEN 1 ELSE 5 END AS iterations, round(CASE WHEN n >= 15 THEN 1.0 WHEN done THEN least(1.0, high / 5.0 * mean) ELSE 0.8 END, 6) AS confidence FROM k""")
def agent_report(spark, sf):
    return looped(spark, sf)[1].select("qid", "n_facts", "iterations", F.round("confidence", 6).alias("confidence"))


@add("agent_expansion", """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label, 'Entity' || label AS name FROM embeddings),
s AS (SELECT q.vec_id AS qid, q.name AS own, f.vec_id, f.name, list_cosine_similarity(q.v, f.v) AS score FROM e q, e f WHERE q.vec_id % 100 = 0),
c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS r FROM s),
h AS (SELECT * FROM c WHERE r <= 10 AND score >= 0.1),
w AS (SELECT DISTINCT qid, own FROM s),
n0 AS (SELECT qid, 'Kenapa' AS name, 0 AS place FROM w UNION ALL SELECT qid, own, 1 FROM w UNION ALL SELECT qid, name, 10 + min(r) FROM h GROUP BY qid, name),
n1 AS (SELECT qid, name, row_number() OVER (PARTITION BY qid ORDER BY min(place), name) AS turn FROM n0 GROUP BY qid, name),
f AS (SELECT name, vec_id, row_number() OVER (PARTITION BY name ORDER BY vec_id % 50 DESC, vec_id) AS newest FROM e),
x AS (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY min((turn, newest)), vec_id) AS r FROM n1 JOIN f USING (name) WHERE turn <= 5 AND newest <= 20 GROUP BY qid, vec_id),
a AS (SELECT qid, vec_id, score, 0 AS leg, r FROM h UNION ALL SELECT qid, vec_id, 1.0, 1, r FROM x),
d AS (SELECT *, row_number() OVER (PARTITION BY qid, vec_id ORDER BY leg, r) AS once FROM a)
SELECT qid, vec_id, round(score, 6) AS score, ord FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY leg, r, vec_id) AS ord FROM d WHERE once = 1) WHERE ord <= 15""")
def agent_expansion(spark, sf):
    """The loop with its plan: names in the texts and in the facts found are expanded, five at most."""
    name = F.concat(F.lit("Entity"), F.col("label").cast("string"))
    f = table(spark, sf, "embeddings").select(F.col("vec_id").alias("fact_id"), "embedding", F.array(name).alias("entity_names"), F.timestamp_seconds(F.col("vec_id") % 50).alias("created_at"), "label")
    edges = f.select(F.col("fact_id").alias("in_id"), F.col("label").alias("out_id"))
    entities = f.select(F.col("label").alias("entity_id"), name.alias("name")).distinct()
    q = agent.plan_queries(asked(spark, sf).withColumn("text", F.concat(F.lit("Kenapa "), name, F.lit(" pindah"))))
    expand = agent.entity_expansion(f, edges, entities, q)
    found, _ = agent.retrieve(q, lambda open_: search.top_k(f.select("fact_id", "embedding"), open_, 10, "fact_id"), expand, threshold=0.1)
    return found.select("qid", F.col("fact_id").alias("vec_id"), F.round("score", 6).alias("score"), F.col("ord").cast("long").alias("ord"))


@add("cached_hybrid", SCORED + """
, r AS (SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS r FROM s)
SELECT qid, 'graph' AS source_type, '[FACT] fact ' || vec_id AS content, round(score, 6) AS score, r AS ord FROM r WHERE r <= 15
UNION ALL SELECT qid, 'passage', '[DETAIL] passage ' || vec_id, round(score, 6), 15 + r FROM r WHERE r <= 5""")
def cached_hybrid(spark, sf):
    """Facts of an earlier run, kept as lists, and fresh passages."""
    hits = search.top_k(facts(spark, sf).select("fact_id", "embedding"), asked(spark, sf), 20, "fact_id")
    named = lambda kind: F.concat(F.lit(f"{kind} "), F.col("fact_id").cast("string"))
    rows = F.array_sort(F.collect_list(F.struct("rank", named("fact").alias("text"), "score")))
    cache = hits.groupBy("qid").agg(F.transform(rows, lambda r: r["text"]).alias("facts"), F.transform(rows, lambda r: r["score"]).alias("scores"))
    return fusion.cached_hybrid(cache, hits.withColumn("text", named("passage"))).withColumn("score", F.round("score", 6))


@add("vector_functions", """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, CASE WHEN vec_id % 50 = 7 THEN list_transform(embedding, lambda x: 0.0::DOUBLE) ELSE embedding::DOUBLE[] END AS w, vec_id % 3 = 0 AS odd FROM embeddings),
n AS (SELECT *, list_dot_product(v, w) AS d, sqrt(list_dot_product(v, v)) AS a, sqrt(list_dot_product(w, w)) AS b FROM e)
SELECT vec_id, round(d, 4) AS dot, round(a, 4) AS norm, round(CASE WHEN b > 0 THEN d / (a * b) END, 4) AS cosine, round(d / (a * b + 1e-9), 4) AS cosine_safe, round(CASE WHEN b > 0 THEN w[1] / b ELSE 0.0 END, 4) AS unit_first,
  round(CASE WHEN odd THEN (v[1] + w[1]) / 2 ELSE v[1] END, 4) AS mean_first FROM n""")
def vector_functions(spark, sf):
    """Each vector against itself, some against a zero vector; the mean of both, or of the first alone."""
    from factloom.functions import vectors

    e, i = table(spark, sf, "embeddings"), F.col("vec_id")
    rows = e.select("vec_id", F.col("embedding").alias("v"), F.transform("embedding", lambda x: F.when(i % 50 == 7, F.lit(0.0)).otherwise(x.cast("double"))).alias("w"))
    v, w = F.col("v"), F.col("w")
    both = F.array(F.transform(v, lambda x: x.cast("double")), w)
    mean = vectors.masked_mean(both, F.array(F.lit(1.0), F.when(i % 3 == 0, 1.0).otherwise(0.0)), 64)
    found = {"dot": vectors.dot(v, w), "norm": vectors.norm(v), "cosine": vectors.cosine(v, w), "cosine_safe": vectors.cosine_safe(v, w), "unit_first": vectors.unit(w)[0], "mean_first": mean[0]}
    return rows.select("vec_id", *[F.round(c, 4).alias(n) for n, c in found.items()])


def _classify_sql() -> str:
    from factloom.functions.text import QUERY_CLASSES

    cases = " ".join("WHEN " + " OR ".join(f"contains(low, '{w}')" for w in words) + f" THEN '{name}'" for name, words in QUERY_CLASSES.items())
    texts = "['kapan ', 'kenapa ', 'berapa kali ', 'lebih ', 'siapa ', 'BERSAMA ', '']"
    return f"WITH t AS (SELECT conv_id, turn, lower(({texts})[1 + (conv_id * 3 + turn) % 7] || text) AS low FROM conversations) SELECT conv_id, turn, CASE {cases} ELSE 'factual' END AS query_type FROM t"


@add("classify_query", _classify_sql())
def classify(spark, sf):
    """Conversation turns behind an opening word of each class."""
    heads = F.array(*[F.lit(w) for w in ("kapan ", "kenapa ", "berapa kali ", "lebih ", "siapa ", "BERSAMA ", "")])
    c = table(spark, sf, "conversations")
    text = F.concat(F.element_at(heads, ((F.col("conv_id") * 3 + F.col("turn")) % 7 + 1).cast("int")), F.col("text"))
    return c.select("conv_id", "turn", classify_query(text).alias("query_type"))


@add("entity_candidates", r"""
SELECT conv_id, turn, array_to_string(list_filter(string_split_regex(text, '\s+'), lambda w: regexp_matches(w, '^\p{Lu}') AND length(w) > 2), ' ') AS entities FROM conversations""")
def candidates(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(entity_candidates(F.col("text")), " ").alias("entities"))


CLASSED = add.sql["classify_query"].split("SELECT conv_id, turn, CASE")[1].split(" AS query_type")[0]


@add("query_plan", f"""
WITH t AS (SELECT doc_id, ['Kapan ', 'Kenapa ', 'Berapa kali ', 'Beda ', 'Siapa '][1 + doc_id % 5] || coalesce(lang, '') || ' Budi_' || doc_id || ' di Bandung' AS text FROM documents), l AS (SELECT *, lower(text) AS low FROM t),
k AS (SELECT doc_id, text, CASE{CLASSED} AS query_type FROM l)
SELECT doc_id, query_type, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: regexp_matches(w, '^\\p{{Lu}}') AND length(w) > 2), ' ') AS entities, query_type IN ('causal', 'comparison') AS multi_hop FROM k""")
def query_plan(spark, sf):
    """Class, entities and hops of a question about each document."""
    heads = F.array(*[F.lit(w) for w in ("Kapan ", "Kenapa ", "Berapa kali ", "Beda ", "Siapa ")])
    head = F.element_at(heads, (F.col("doc_id") % 5 + 1).cast("int"))
    text = F.concat(head, F.coalesce("lang", F.lit("")), F.lit(" Budi_"), F.col("doc_id").cast("string"), F.lit(" di Bandung"))
    plan = agent.plan_queries(table(spark, sf, "documents").select("doc_id", text.alias("text")))
    return plan.select("doc_id", "query_type", F.array_join("entities", " ").alias("entities"), "multi_hop")


@add("sufficiency_reply", """
WITH r AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'CUKUP: YA' WHEN 1 THEN 'cukup: tidak' || chr(10) || 'INFO_KURANG: topic ' || conv_id || chr(10) || 'more' ELSE role END AS reply FROM conversations)
SELECT conv_id, turn, turn % 3 = 0 AS enough, CASE WHEN turn % 3 = 1 THEN 'topic ' || conv_id ELSE '' END AS missing FROM r""")
def sufficiency_reply(spark, sf):
    """What a model says about the facts found: enough, or what is missing."""
    kind = F.col("turn") % 3
    lacking = F.concat(F.lit("cukup: tidak\nINFO_KURANG: topic "), F.col("conv_id").cast("string"), F.lit("\nmore"))
    reply = F.when(kind == 0, "CUKUP: YA").when(kind == 1, lacking).otherwise(F.col("role"))
    return table(spark, sf, "conversations").select("conv_id", "turn", is_sufficient(reply).alias("enough"), F.coalesce(missing_hint(reply), F.lit("")).alias("missing"))


@add("turn_retrieval", """
WITH q AS (SELECT conv_id, turn, role, text, {words} AS w FROM conversations),
k AS (SELECT a.conv_id, a.turn, a.role, b.turn AS seen, coalesce(len(list_intersect(b.w, a.w))::DOUBLE / nullif(len(a.w), 0), 0.0) AS score FROM q a JOIN q b ON a.conv_id = b.conv_id AND b.turn < a.turn)
SELECT conv_id AS session_id, turn, role AS speaker, seen, round(score, 6) AS score, ord FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, seen DESC) AS ord FROM k) WHERE ord <= 4""".replace("{words}", "list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> ''))"))
def turn_retrieval(spark, sf):
    """Each turn as a query of the loop over the turns before it, with its place in both results."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), "turn", F.col("role").alias("speaker"), F.lit("2024-01-01").alias("date"), "text")
    stored = c.select("session_id", "turn", tokens(F.col("text")).alias("words"))

    def look(open_):
        hits = history.history_search(stored, open_.select("session_id", F.col("turn").alias("asked"), tokens(F.col("text")).alias("words")), 4)
        return hits.select(F.concat_ws("/", "session_id", "asked").alias("qid"), F.col("turn").alias("fact_id"), "score", "rank")

    found, _ = agent.retrieve_for_turns(c, look, threshold=0.0, min_facts=1, max_facts=4)
    return found.select("session_id", "turn", "speaker", F.col("fact_id").alias("seen"), F.round("score", 6).alias("score"), F.col("ord").cast("long").alias("ord"))
