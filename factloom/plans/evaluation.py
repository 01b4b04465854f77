"""Metric and report queries: ``documents`` as retrieved texts, ``benchmark`` as expected answers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions import metrics
from factloom.operators import agreement, evaluation, reports
from factloom.operators.search import best, score_all, session_of_texts, top_k
from factloom.plans.registry import Registry, table

add = Registry()

#: SQL of the parts that metric queries share. Each document is judged against one benchmark item.
TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> ''))"
LINES = """
WITH b AS (SELECT item_id, text AS answer FROM benchmark),
n AS (SELECT count(*) AS n FROM b),
d AS (SELECT doc_id, text, answer, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS lines, list_filter(string_split(answer, chr(10)), lambda x: x <> '') AS wanted
  FROM documents, n JOIN b ON b.item_id = documents.doc_id % n.n)"""


def pairs(spark, sf):
    """(doc_id, text, answer, lines, wanted): lines are the retrieved facts, wanted the required ones."""
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("answer"))
    n = b.groupBy().agg(F.count("*").alias("n"))
    d = table(spark, sf, "documents").crossJoin(F.broadcast(n)).withColumn("item_id", F.col("doc_id") % F.col("n")).join(b, "item_id")
    lines = lambda c: F.filter(F.split(c, "\n"), lambda x: x != "")
    return d.select("doc_id", "text", "answer", lines("text").alias("lines"), lines("answer").alias("wanted"))


def _tok(x: str) -> str:
    return TOKENS.format(x)


SQL_OF: dict[str, str] = {}


def _metric(name: str, sql: str, value):
    SQL_OF[name] = sql

    @add(name, f"{LINES} SELECT doc_id, round({sql}, 6) AS {name} FROM d")
    def query(spark, sf):
        return pairs(spark, sf).select("doc_id", F.round(value(), 6).alias(name))


_POOL = "list_distinct(flatten(list_transform({0}, lambda t: " + TOKENS.format("t") + ")))"
_OVER = "len(list_intersect({words}, {want})) / len({want})"

_metric(
    "context_recall",
    f"CASE WHEN len(wanted) = 0 THEN 1.0 WHEN len(lines) = 0 THEN 0.0 ELSE len(list_filter(wanted, lambda f: coalesce(len(list_intersect({_POOL.format('lines')}, {_tok('f')})) / nullif(len({_tok('f')}), 0)::DOUBLE > 0.5, false)))::DOUBLE / len(wanted) END",
    lambda: metrics.context_recall(F.col("lines"), F.col("wanted")),
)
_metric(
    "context_precision",
    f"CASE WHEN len(wanted) = 0 OR len(lines) = 0 THEN 0.0 ELSE len(list_filter(lines, lambda f: coalesce(len(list_intersect({_POOL.format('wanted')}, {_tok('f')})) / nullif(len({_tok('f')}), 0)::DOUBLE > 0.3, false)))::DOUBLE / len(lines) END",
    lambda: metrics.context_precision(F.col("lines"), F.col("wanted")),
)
_metric(
    "fact_coverage",
    f"CASE WHEN len(wanted) = 0 THEN 1.0 WHEN text = '' THEN 0.0 ELSE len(list_filter(wanted, lambda f: coalesce(len(list_intersect({_tok('text')}, {_tok('f')})) / nullif(len({_tok('f')}), 0)::DOUBLE > 0.5, false)))::DOUBLE / len(wanted) END",
    lambda: metrics.fact_coverage(F.col("text"), F.col("wanted")),
)
_MATCH = f"(len({_tok('answer')}) = 0 OR len(list_intersect({_tok('f')}, {_tok('answer')}))::DOUBLE / len({_tok('answer')}) >= 0.5)"
_metric("hit_rate", f"CASE WHEN answer = '' OR len(lines) = 0 THEN 0.0 WHEN len(list_filter(lines, lambda f: {_MATCH})) > 0 THEN 1.0 ELSE 0.0 END", lambda: metrics.hit_rate(F.col("lines"), F.col("answer")))
_metric(
    "mrr",
    f"CASE WHEN answer = '' THEN 0.0 ELSE coalesce(1.0 / list_min(list_filter(list_transform(lines, lambda f, i: CASE WHEN {_MATCH} THEN i END), lambda i: i IS NOT NULL)), 0.0) END",
    lambda: metrics.reciprocal_rank(F.col("lines"), F.col("answer")),
)
_metric(
    "temporal_recall",
    "CASE WHEN len(wanted) = 0 THEN 1.0 WHEN len(lines) = 0 THEN 0.0 ELSE len(list_filter(wanted, lambda r: len(list_filter(lines, lambda t: contains(lower(t), lower(r)))) > 0))::DOUBLE / len(wanted) END",
    lambda: metrics.temporal_recall(F.col("lines"), F.col("wanted")),
)
_metric("sufficiency_simple", f"CASE WHEN len({_tok('answer')}) = 0 THEN 0.0 ELSE len(list_intersect({_tok('text')}, {_tok('answer')}))::DOUBLE / len({_tok('answer')}) END", lambda: metrics.sufficiency(F.col("text"), F.col("answer")))
_metric(
    "answer_f1",
    f"CASE WHEN text = '' THEN 0.0 WHEN answer = '' THEN 0.5 ELSE coalesce(2.0 * len(list_intersect({_tok('text')}, {_tok('answer')})) / nullif(len({_tok('text')}) + len({_tok('answer')}), 0), 0.0) END",
    lambda: metrics.answer_f1(F.col("text"), F.col("answer")),
)


@add("kendall_tau", """
WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS p FROM orders),
n AS (SELECT c, count(*) AS n FROM o GROUP BY c),
t AS (SELECT x.c, sum(CASE WHEN (y.a > x.a) = (y.p > x.p) THEN 1 ELSE -1 END) AS s FROM o x JOIN o y ON x.c = y.c AND x.k < y.k GROUP BY x.c)
SELECT n.c AS o_custkey, round(CASE WHEN n < 2 THEN 1.0 ELSE (s / (n * (n - 1) / 2.0) + 1) / 2 END, 6) AS agreement FROM n LEFT JOIN t USING (c)""")
def kendall_tau(spark, sf):
    """Order of a customer's orders by price against their order by date."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    places = lambda c: o.withColumn("place", F.row_number().over(Window.partitionBy("o_custkey").orderBy(c, "o_orderkey"))).select("o_custkey", "o_orderkey", "place")
    return agreement.rank_agreement(places("o_totalprice"), places("o_orderdate"), "o_custkey", "o_orderkey", "place").select("o_custkey", F.round("agreement", 6).alias("agreement"))


RANKED = """
WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q.qid, q.label AS wanted, f.vec_id, f.label, list_cosine_similarity(q.v, f.embedding::DOUBLE[]) AS score FROM q, embeddings f WHERE f.vec_id <> q.qid)"""


def asking(spark, sf):
    """Every row whose id is divisible by 100."""
    return table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding", F.col("label").alias("wanted"))


def nearest(spark, sf, k=10):
    """The first ``k`` rows of each query, itself left out."""
    q = asking(spark, sf)
    hits = top_k(table(spark, sf, "embeddings"), q.drop("wanted"), k + 1, "vec_id").where("vec_id <> qid").drop("rank")
    return best(hits, k, F.desc("score"), F.col("vec_id")).join(q.select("qid", "wanted"), "qid")


def ranked(spark, sf):
    """Scores of each query with all rows but itself."""
    q = asking(spark, sf)
    return score_all(table(spark, sf, "embeddings"), q.drop("wanted")).drop("embedding").where("vec_id <> qid").join(q.select("qid", "wanted"), "qid")


@add("session_hr_mrr", RANKED + """
, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS r FROM s),
t AS (SELECT qid, wanted, label, min(r) AS first FROM r WHERE r <= 10 GROUP BY 1, 2, 3),
u AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first) AS place FROM t),
h AS (SELECT qid, min(r) FILTER (label = wanted) AS raw FROM r WHERE r <= 10 GROUP BY qid)
SELECT u.qid, max(CASE WHEN label = wanted THEN 1.0 ELSE 0.0 END) AS hit, round(coalesce(1.0 / min(place) FILTER (label = wanted), 0.0), 6) AS rr_distinct, round(coalesce(1.0 / any_value(raw), 0.0), 6) AS rr_raw
FROM u JOIN h USING (qid) GROUP BY u.qid""")
def session_hr_mrr(spark, sf):
    """Labels as sessions: is the query's own label among the first ten hits, and where?"""
    top = nearest(spark, sf)
    lists = top.groupBy("qid", "wanted").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda r: r["label"]).alias("sessions"))
    relevant = F.array("wanted")
    return lists.select(
        "qid",
        metrics.session_hit(F.col("sessions"), relevant).alias("hit"),
        F.round(metrics.session_reciprocal_rank(F.col("sessions"), relevant), 6).alias("rr_distinct"),
        F.round(metrics.session_reciprocal_rank(F.col("sessions"), relevant, distinct=False), 6).alias("rr_raw"),
    )


@add("embed_recall_at_k", RANKED + """
, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id DESC) AS r FROM s)
SELECT qid, round(coalesce(1.0 / min(r) FILTER (label = wanted), 0.0), 6) AS mrr, round(count(*) FILTER (label = wanted AND r <= 5)::DOUBLE / count(*) FILTER (label = wanted), 6) AS recall_at_5,
  round(count(*) FILTER (label = wanted AND r <= 10)::DOUBLE / count(*) FILTER (label = wanted), 6) AS recall_at_10 FROM r GROUP BY qid HAVING count(*) FILTER (label = wanted) > 0""")
def embed_recall_at_k(spark, sf):
    """Rows of the query's label are relevant, itself left out."""
    e, q = table(spark, sf, "embeddings"), asking(spark, sf)
    relevant = q.select("qid", F.col("wanted").alias("label")).join(e.select("vec_id", "label"), "label").where("vec_id <> qid").select("qid", "vec_id")
    out = reports.embedding_ranking(e, q, relevant, "vec_id")
    return out.select("qid", *[F.round(c, 6).alias(c) for c in ("mrr", "recall_at_5", "recall_at_10")])


RESULTS = """
WITH r AS (SELECT lang AS type, CASE doc_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty, quality::DOUBLE AS hit_rate, 1.0 / (1 + n_chars % 10) AS mrr, n_chars / 1000.0 AS seconds, toxic,
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE (n_chars % 4) / 4.0 END AS score FROM documents JOIN labels USING (doc_id))"""


def results(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.select(
        F.col("lang").alias("type"),
        F.when(F.col("doc_id") % 3 == 0, "easy").when(F.col("doc_id") % 3 == 1, "medium").otherwise("hard").alias("difficulty"),
        F.col("quality").cast("double").alias("hit_rate"),
        (1.0 / (1 + F.col("n_chars") % 10)).alias("mrr"),
        (F.col("n_chars") / 1000.0).alias("seconds"),
        F.when(F.col("doc_id") % 7 != 0, F.col("n_chars") % 4 / 4.0).alias("score"),
    )


@add("eval_summary", RESULTS + """
SELECT CASE WHEN grouping(type) = 0 THEN 'type' WHEN grouping(difficulty) = 0 THEN 'difficulty' ELSE 'overall' END AS grouping, coalesce(type, difficulty) AS value, count(*) AS n,
  round(avg(hit_rate), 6) AS hit_rate, round(avg(mrr), 6) AS mrr, round(avg(seconds), 6) AS seconds FROM r GROUP BY GROUPING SETS ((), (type), (difficulty))""")
def eval_summary(spark, sf):
    out = reports.eval_summary(results(spark, sf))
    return out.select("grouping", "value", "n", *[F.round(c, 6).alias(c) for c in ("hit_rate", "mrr", "seconds")])


@add("sufficiency_means", RESULTS + """
SELECT type, round(avg(score), 6) AS mean_all, round(avg(score) FILTER (score > 0), 6) AS mean_positive, round(coalesce(avg(score) FILTER (score > 0), 0.0), 6) AS mean_positive_or_0 FROM r GROUP BY type""")
def sufficiency_means(spark, sf):
    out = reports.sufficiency_means(results(spark, sf), "score", "type")
    return out.select("type", *[F.round(c, 6).alias(c) for c in ("mean_all", "mean_positive", "mean_positive_or_0")])


@add("session_averages", """
WITH t AS (SELECT conv_id, length(text)::DOUBLE AS size, CASE WHEN role = 'user' THEN 1.0 ELSE 0.0 END AS user_share FROM conversations),
s AS (SELECT conv_id AS session_id, count(*) AS n_turns, avg(size) AS mean_size, avg(user_share) AS mean_user_share FROM t GROUP BY 1)
SELECT session_id, n_turns, round(mean_size, 6) AS mean_size, round(mean_user_share, 6) AS mean_user_share FROM s
UNION ALL SELECT NULL, count(*), round(avg(size), 6), round(avg(user_share), 6) FROM t""")
def session_averages(spark, sf):
    """Means of each session, and over all turns in the row without a session."""
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.length("text").cast("double").alias("size"), (F.col("role") == "user").cast("double").alias("user_share"))
    names = ("mean_size", "mean_user_share")
    each = reports.session_averages(t, "size", "user_share")
    every = reports.overall_averages(t, "size", "user_share").select(F.lit(None).cast("long").alias("session_id"), "n_turns", *names)
    return each.unionByName(every).select("session_id", "n_turns", *[F.round(n, 6).alias(n) for n in names])


QUERYSET = """
WITH q AS (SELECT 'q' || lpad(CAST(doc_id % 1200 AS VARCHAR), 3, '0') AS id, substr(text, 1, CAST(n_chars % 700 AS INTEGER)) AS query, (['factual_recall', 'inference', 'multi_hop', 'other'])[1 + doc_id % 4] AS type,
  (['easy', 'medium', 'hard'])[1 + doc_id % 3] AS difficulty, [CAST(doc_id % 101 AS INTEGER), CAST(n_chars % 103 AS INTEGER)][1:CAST(1 + doc_id % 2 AS INTEGER)] AS sessions, text FROM documents)"""


def queryset(spark, sf):
    pick = lambda words, i: F.element_at(F.array(*map(F.lit, words)), (i + 1).cast("int"))
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(
        F.concat(F.lit("q"), F.lpad((d % 1200).cast("string"), 3, "0")).alias("id"),
        F.substring("text", F.lit(1), (F.col("n_chars") % 700).cast("int")).alias("query"),
        pick(("factual_recall", "inference", "multi_hop", "other"), d % 4).alias("type"),
        pick(("easy", "medium", "hard"), d % 3).alias("difficulty"),
        F.slice(F.array((d % 101).cast("int"), (F.col("n_chars") % 103).cast("int")), F.lit(1), (1 + d % 2).cast("int")).alias("relevant_sessions"),
        F.col("text").alias("expected_answer"), F.col("text").alias("required_context"), F.col("text").alias("reasoning_steps"), F.lit("manual").alias("source"),
    )


@add("queryset_stats", QUERYSET + """
SELECT 'type' AS stat, type AS value, count(*) AS n FROM q GROUP BY type UNION ALL SELECT 'difficulty', difficulty, count(*) FROM q GROUP BY 2
UNION ALL SELECT 'session', CAST(s AS VARCHAR), count(*) FROM (SELECT unnest(sessions) AS s FROM q) GROUP BY 2 UNION ALL SELECT 'cross_session', NULL, count(*) FILTER (len(sessions) > 1) FROM q""")
def queryset_stats(spark, sf):
    return reports.queryset_stats(queryset(spark, sf))


@add("queryset_validate", QUERYSET + """
SELECT id, array_to_string(list_filter([CASE WHEN NOT regexp_matches(id, '^q[0-9]{3}$') THEN 'id' END, CASE WHEN length(query) NOT BETWEEN 10 AND 500 THEN 'query' END,
  CASE WHEN length(text) NOT BETWEEN 10 AND 1000 THEN 'expected_answer' END, CASE WHEN length(text) NOT BETWEEN 10 AND 1000 THEN 'required_context' END, CASE WHEN length(text) NOT BETWEEN 10 AND 1000 THEN 'reasoning_steps' END,
  CASE WHEN type = 'other' THEN 'type' END, CASE WHEN len(list_filter(sessions, lambda s: s < 1 OR s > 100)) > 0 THEN 'relevant_sessions' END], lambda x: x IS NOT NULL), ',') AS problems FROM q""")
def queryset_validate(spark, sf):
    return reports.validate_queries(queryset(spark, sf)).select("id", F.array_join("problems", ",").alias("problems"))


@add("judge_offline", LINES + f"""
SELECT doc_id, round(CASE WHEN text = '' THEN 0.0 WHEN answer = '' THEN 0.5 ELSE len(list_intersect({_tok('text')}, {_tok('answer')}))::DOUBLE / len({_tok('answer')}) END, 6) AS score FROM d""")
def judge_offline(spark, sf):
    from factloom.hooks import overlap_judge

    return pairs(spark, sf).select("doc_id", F.round(overlap_judge(F.col("answer"), F.col("text"), F.col("answer"))["score"], 6).alias("score"))


@add("query_evaluation", RANKED + """
, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS r FROM s),
t AS (SELECT qid, wanted, label, min(r) AS first FROM r WHERE r <= 10 GROUP BY 1, 2, 3),
u AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first) AS place FROM t),
m AS (SELECT qid, wanted, max(CASE WHEN label = wanted THEN 1.0 ELSE 0.0 END) AS hit_rate, coalesce(1.0 / min(place) FILTER (label = wanted), 0.0) AS mrr FROM u GROUP BY 1, 2),
w AS (SELECT CASE WHEN qid % 2 = 0 THEN 'multi_hop' ELSE 'inference' END AS type, CASE WHEN qid % 3 = 0 THEN 'easy' ELSE 'hard' END AS difficulty, hit_rate, mrr FROM m)
SELECT CASE WHEN grouping(type) = 0 THEN 'type' WHEN grouping(difficulty) = 0 THEN 'difficulty' ELSE 'overall' END AS grouping, coalesce(type, difficulty) AS value, count(*) AS n,
  round(avg(hit_rate), 6) AS hit_rate, round(avg(mrr), 6) AS mrr FROM w GROUP BY GROUPING SETS ((), (type), (difficulty))""")
def query_evaluation(spark, sf):
    """Search, sessions in order, hit rate and rank of each query, summary by type and difficulty."""
    top = nearest(spark, sf)
    sessions = top.groupBy("qid", F.col("label").alias("session_id")).agg(F.min("rank").alias("ord"))
    queries = top.select("qid", F.array("wanted").alias("relevant_sessions")).distinct()
    rows = evaluation.session_results(queries, sessions)
    rows = rows.withColumns({"type": F.when(F.col("qid") % 2 == 0, "multi_hop").otherwise("inference"), "difficulty": F.when(F.col("qid") % 3 == 0, "easy").otherwise("hard"), "seconds": F.lit(0.0)})
    return reports.eval_summary(rows).select("grouping", "value", "n", F.round("hit_rate", 6).alias("hit_rate"), F.round("mrr", 6).alias("mrr"))


@add("context_lengths", """
WITH r AS (SELECT user_id, event_type || event_id AS fact, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events)
SELECT user_id, CAST(sum(length(fact)) AS BIGINT) AS context_length, string_agg(fact, chr(10) ORDER BY rank) FILTER (rank <= 15) AS context FROM r GROUP BY user_id""")
def context_lengths(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("qid"), F.concat("event_type", F.col("event_id").cast("string")).alias("fact_text"), "event_id")
    rows = e.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("event_id")))
    return evaluation.context_lengths(rows).withColumnRenamed("qid", "user_id")


@add("turn_metrics", f"""
WITH t AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
m AS (SELECT conv_id, CASE WHEN before IS NULL THEN 0.0 ELSE CASE WHEN len({_tok('text')}) > 0 AND len(list_intersect({_tok('before')}, {_tok('text')}))::DOUBLE / len({_tok('text')}) > 0.5 THEN 1.0 ELSE 0.0 END END AS recall FROM t)
SELECT conv_id AS session_id, count(*) AS n_turns, round(avg(recall), 6) AS mean_recall FROM m GROUP BY 1""")
def turn_metrics(spark, sf):
    """Each turn against the turn before it; a first turn needs nothing and counts as zero."""
    c = table(spark, sf, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = c.select(F.col("conv_id").alias("session_id"), F.array_compact(F.array(before)).alias("retrieved"), F.array("text").alias("required"), before.isNotNull().alias("needed"))
    out = reports.session_averages(evaluation.turn_metrics(rows), "recall")
    return out.withColumn("mean_recall", F.round("mean_recall", 6))


@add("rejudge", LINES + f"""
, j AS (SELECT doc_id % 5 AS setup, CASE WHEN doc_id % 9 = 0 THEN 0.0 ELSE len(list_intersect({_tok('text')}, {_tok('answer')}))::DOUBLE / len({_tok('answer')}) END AS score FROM d)
SELECT setup, round(avg(score), 6) AS mean_all, round(coalesce(avg(score) FILTER (score > 0), 0.0), 6) AS mean_positive_or_0 FROM j GROUP BY setup""")
def rejudge(spark, sf):
    """Stored contexts judged again; an empty context scores 0."""
    from factloom.hooks import overlap_judge

    rows = pairs(spark, sf).select((F.col("doc_id") % 5).alias("setup"), F.col("answer").alias("query"), F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("context"), F.col("answer").alias("expected_answer"))
    out = reports.sufficiency_means(evaluation.judge_results(rows, overlap_judge), "score", "setup")
    return out.select("setup", F.round("mean_all", 6).alias("mean_all"), F.round("mean_positive_or_0", 6).alias("mean_positive_or_0"))


BUNDLE = {"context_recall": "context_recall", "context_precision": "context_precision", "fact_coverage": "fact_coverage", "hit_rate": "hit_rate", "mrr": "mrr", "sufficiency": "sufficiency_simple"}


@add("turn_evaluation", f"""
WITH c AS (SELECT conv_id AS session_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations),
q AS (SELECT session_id, turn AS asked, text AS query, answer FROM c WHERE role = 'user' AND answer IS NOT NULL),
k AS (SELECT q.session_id, asked, c.turn, c.text, coalesce(len(list_intersect({_tok('c.text')}, {_tok('query')}))::DOUBLE / nullif(len({_tok('query')}), 0), 0.0) AS score FROM q JOIN c ON c.session_id = q.session_id AND c.turn < asked),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, asked ORDER BY score DESC, turn DESC) AS rank FROM k),
g AS (SELECT session_id, asked, list(text ORDER BY rank) AS lines FROM r WHERE rank <= 3 GROUP BY 1, 2),
d AS (SELECT q.session_id, asked, coalesce(lines, CAST([] AS VARCHAR[])) AS lines, [answer] AS wanted, answer, coalesce(array_to_string(lines, chr(10)), '') AS text FROM q LEFT JOIN g USING (session_id, asked)),
m AS (SELECT session_id, {', '.join(f"{SQL_OF[sql]} AS {name}" for name, sql in BUNDLE.items())} FROM d)
SELECT session_id, count(*) AS n_turns, {', '.join(f'round(avg({name}), 6) AS mean_{name}' for name in BUNDLE)} FROM m GROUP BY ROLLUP (session_id)""")
def turn_evaluation(spark, sf):
    """User turns as queries over what was said before, scored against the turn that follows; means of
    each session, and over all in the row without a session."""
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), "turn", F.col("role").alias("speaker"), "text")
    rows = evaluation.turn_evaluation(turns)
    each = reports.session_averages(rows, *BUNDLE)
    every = reports.overall_averages(rows, *BUNDLE).withColumn("session_id", F.lit(None).cast("long"))
    out = each.unionByName(every, allowMissingColumns=True)
    return out.select("session_id", "n_turns", *[F.round(f"mean_{n}", 6).alias(f"mean_{n}") for n in BUNDLE])


@add("judge_reply", LINES + f"""
SELECT doc_id, round(CASE WHEN doc_id % 11 = 0 THEN 0.0 WHEN doc_id % 13 = 0 THEN 0.5 WHEN doc_id % 4 < 2 THEN (doc_id % 10) / 10.0 WHEN doc_id % 4 = 2 THEN 0.0
    ELSE CASE WHEN len({_tok('answer')}) = 0 THEN 0.0 ELSE len(list_intersect({_tok('text')}, {_tok('answer')}))::DOUBLE / len({_tok('answer')}) END END, 6) AS score,
  CASE WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 4 = 3 THEN 'simple' ELSE 'llm_judge' END AS method,
  CASE WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 4 = 3 THEN NULL WHEN doc_id % 4 = 2 THEN 0.25 ELSE 0.0 END AS completeness FROM d""")
def judge_reply(spark, sf):
    """Replies in JSON, fenced, without a score, or unreadable; some without a context or an answer."""
    from factloom.hooks import judged_reply

    i, score = F.col("doc_id"), F.concat(F.lit('{"score": '), (F.col("doc_id") % 10 / 10.0).cast("string"), F.lit("}"))
    reply = F.when(i % 4 == 0, score).when(i % 4 == 1, F.concat(F.lit("```json\n"), score, F.lit("\n```"))).when(i % 4 == 2, '{"completeness": 0.25, "reasoning": "x"}').otherwise("no json")
    rows = pairs(spark, sf).withColumn("j", judged_reply(reply, F.when(i % 11 != 0, F.col("text")), F.when(i % 13 != 0, F.col("answer"))))
    return rows.select("doc_id", F.round("j.score", 6).alias("score"), "j.method", "j.completeness")


@add("queries_of_kind", QUERYSET + " SELECT type, difficulty, count(*) AS n FROM q WHERE type = 'multi_hop' OR difficulty = 'easy' GROUP BY ALL")
def queries_of_kind(spark, sf):
    """Queries of a type, and easy ones of the other types."""
    q = queryset(spark, sf)
    hops, easy = evaluation.of_kind(q, type="multi_hop"), evaluation.of_kind(q, difficulty="easy").where("type <> 'multi_hop'")
    return hops.unionByName(easy).groupBy("type", "difficulty").agg(F.count("*").alias("n"))


@add("fact_sessions", """
WITH n AS (SELECT item_id AS qid, left(replace(text, '"', ''), 120) AS needle FROM benchmark),
h AS (SELECT qid, min('session_' || doc_id % 37) AS episode FROM n JOIN documents ON contains(text, needle) AND needle <> '' GROUP BY qid)
SELECT qid, CAST(regexp_extract(episode, '[0-9]+') AS BIGINT) AS session_id, 1 AS ord FROM h""")
def fact_sessions(spark, sf):
    """Benchmark passages as facts of unknown origin, looked up in all documents by their text."""
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.lit(1).alias("rank"), F.col("text").alias("fact_text"))
    stored = table(spark, sf, "documents").select(F.col("text").alias("fact_text"), F.concat(F.lit("session_"), (F.col("doc_id") % 37).cast("string")).alias("episode_name"))
    return session_of_texts(asked, stored).select("qid", F.col("session_id").cast("long").alias("session_id"), "ord")
