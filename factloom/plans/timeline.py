"""Timeline queries over ``events``, where the parent of an event is its user's event before it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.operators import events as ev
from factloom.operators.windows import utc
from factloom.plans.registry import Registry, table

add = Registry()

DERIVED = """
WITH p AS (SELECT event_id, user_id, event_type, ts, CAST(ts AS DATE) AS day, lag(event_id) OVER o AS a, lag(event_id, 2) OVER o AS b FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
e AS (SELECT event_id, event_type, day, CASE WHEN event_id % 3 = 0 OR a IS NULL THEN CAST([] AS BIGINT[]) WHEN event_id % 5 = 1 AND b IS NOT NULL THEN [a, b, -1] ELSE [a] END AS causes FROM p)"""


def timeline(spark, sf):
    """(id, description, date, caused_by): some events without a cause, some with two and a missing one."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf, "events").select("event_id", "event_type", F.to_date("ts").alias("date"), F.lag("event_id").over(order).alias("a"), F.lag("event_id", 2).over(order).alias("b"))
    none = F.array().cast("array<bigint>")
    two = (F.col("event_id") % 5 == 1) & F.col("b").isNotNull()
    caused = F.when((F.col("event_id") % 3 == 0) | F.col("a").isNull(), none).when(two, F.array("a", "b", F.lit(-1).cast("long"))).otherwise(F.array("a"))
    return rows.select(F.col("event_id").alias("id"), F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("description"), "date", caused.alias("caused_by"))


@add("causal_context", DERIVED + """
, c AS (SELECT event_id, unnest(causes) AS cause, unnest(range(len(causes))) AS i FROM e)
SELECT c.event_id AS id, string_agg(x.event_type || ' ' || x.event_id, ', ' ORDER BY i) AS causal_context FROM c JOIN e x ON x.event_id = c.cause GROUP BY 1""")
def causal_context(spark, sf):
    return ev.causal_context(timeline(spark, sf))


@add("standalone_events", DERIVED + """
SELECT event_id AS id FROM e WHERE len(causes) > 0 OR EXISTS (SELECT 1 FROM (SELECT unnest(causes) AS c FROM e) WHERE c = e.event_id)""")
def standalone_events(spark, sf):
    """Events that stay when standalone ones go."""
    return ev.connected_events(timeline(spark, sf)).select("id")


@add("causal_ancestry", DERIVED.replace("WITH", "WITH RECURSIVE", 1) + """
, c AS (SELECT event_id, unnest(causes) AS cause FROM e WHERE event_id % 3 <> 0), g AS (SELECT DISTINCT * FROM c),
u AS (SELECT event_id AS id, cause AS ancestor, 1 AS depth FROM g UNION ALL SELECT u.id, g.cause, u.depth + 1 FROM u JOIN g ON u.ancestor = g.event_id)
SELECT CAST(id AS VARCHAR) AS id, CAST(ancestor AS VARCHAR) AS ancestor, min(depth) AS depth FROM u GROUP BY ALL""")
def causal_ancestry(spark, sf):
    return ev.ancestry(timeline(spark, sf))


@add("relevant_events", """
WITH s AS (SELECT CAST(o_orderdate AS DATE) AS date, min(o_orderkey) AS session_id FROM orders GROUP BY 1),
w AS (SELECT *, lag(date) OVER (ORDER BY date, session_id) AS previous FROM s),
e AS (SELECT o_orderkey AS id, CAST(date_trunc('week', o_orderdate) AS DATE) AS day FROM orders),
d AS (SELECT session_id, id FROM w JOIN e ON day <= date AND (previous IS NULL OR day > previous)),
f AS (SELECT session_id, id FROM w JOIN e ON day <= date AND day >= date - 7 WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.session_id = w.session_id))
SELECT * FROM d UNION ALL SELECT * FROM f""")
def relevant_events(spark, sf):
    """Every order is a session's and an event. Events are dated to their Monday, so that sessions later in the week have none of their own."""
    o = table(spark, sf, "orders")
    sessions = o.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.min("o_orderkey").alias("session_id"))
    events = o.select(F.col("o_orderkey").alias("id"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("date"))
    return ev.relevant_events(sessions, events).select("session_id", "id")


@add("event_density", DERIVED + """
, x AS (SELECT count(*) AS n, date_diff('day', min(day), max(day)) + 1 AS span, sum(len(causes)) AS c FROM e), y AS (SELECT count(DISTINCT conv_id) AS s FROM conversations)
SELECT n AS n_events, s AS n_sessions, span AS span_days, round(n / span::DOUBLE, 6) AS events_per_day, round(s / span::DOUBLE, 6) AS sessions_per_day, round(n / s::DOUBLE, 6) AS events_per_session, round(c / n::DOUBLE, 6) AS mean_causes FROM x, y""")
def event_density(spark, sf):
    out = ev.density(timeline(spark, sf), table(spark, sf, "conversations").select("conv_id").distinct())
    return out.select("n_events", "n_sessions", "span_days", *[F.round(c, 6).alias(c) for c in ("events_per_day", "sessions_per_day", "events_per_session", "mean_causes")])


@add("valid_events", DERIVED + """
, c AS (SELECT event_id, unnest(causes) AS cause, unnest(range(len(causes))) AS i FROM e WHERE event_id % 17 <> 0),
g AS (SELECT c.event_id, string_agg(CAST(c.cause AS VARCHAR), ',' ORDER BY i) AS causes FROM c JOIN e a ON a.event_id = c.event_id JOIN e x ON x.event_id = c.cause AND x.event_id % 17 <> 0 WHERE a.day > x.day GROUP BY 1)
SELECT CAST(e.event_id AS VARCHAR) AS id, coalesce(g.causes, '') AS causes FROM e LEFT JOIN g USING (event_id) WHERE e.event_id % 17 <> 0""")
def valid_events(spark, sf):
    """Some dates are unreadable; causes on the same day do not hold."""
    day = F.when(F.col("id") % 17 == 0, "soon").otherwise(F.date_format("date", "yyyy-MM-dd"))
    rows = timeline(spark, sf).select(F.col("id").cast("string").alias("id"), "description", day.alias("date"), F.col("caused_by").cast("array<string>").alias("caused_by"))
    return ev.valid_events(rows).select("id", F.array_join("caused_by", ",").alias("causes"))


@add("valid_continuation", """
WITH r AS (SELECT event_id AS seq, 'E' || (event_id + 100) AS id, CAST(ts AS DATE) AS day, [CASE WHEN event_id % 5 = 0 THEN 'X' ELSE 'E' END || (event_id + 99), 'E' || (event_id + 101), 'E50'] AS causes FROM events),
v AS (SELECT * FROM r WHERE seq > 20),
c AS (SELECT seq, id, unnest(causes) AS cause, unnest(range(3)) AS i FROM v),
k AS (SELECT id AS cause, min(s) AS s FROM (SELECT id, seq AS s FROM v UNION ALL SELECT 'E50', -1) GROUP BY 1),
g AS (SELECT c.id, string_agg(c.cause, ',' ORDER BY i) AS causes FROM c JOIN k USING (cause) WHERE k.s < c.seq GROUP BY 1)
SELECT v.id, coalesce(g.causes, '') AS causes, strftime(least(greatest(day, DATE '2024-01-05'), DATE '2024-01-20'), '%Y-%m-%d') AS date FROM v LEFT JOIN g USING (id)""")
def valid_continuation(spark, sf):
    """All events; every fifth names a cause that does not exist."""
    e = F.col("event_id")
    name = lambda k, head="E": F.concat(F.lit(head), (e + k).cast("string"))
    before = F.when(e % 5 == 0, name(99, "X")).otherwise(name(99))
    new = table(spark, sf, "events").select(e.alias("seq"), name(100).alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.array(before, name(101), F.lit("E50")).alias("caused_by"))
    known = spark.range(1).select(F.lit("E50").alias("id"))
    out = ev.valid_continuation(new, known, 120, F.lit("2024-01-05").cast("date"), F.lit("2024-01-20").cast("date"))
    return out.select("id", F.array_join("caused_by", ",").alias("causes"), "date")


@add("last5_events", "SELECT user_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 5")
def last5_events(spark, sf):
    from factloom.operators.search import best

    out = best(table(spark, sf, "events").withColumn("at", utc("ts")), 5, F.desc("at"), F.desc("event_id"), by="user_id")
    return out.select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


@add("append_events", """
WITH e AS (SELECT 'E' || event_id AS id, event_type AS description FROM events WHERE event_id % 4 > 0), n AS (SELECT 'E' || event_id AS id, 'new ' || event_type AS description FROM events WHERE event_id % 4 < 2)
SELECT * FROM e UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM e)""")
def append_events(spark, sf):
    """A timeline of three quarters of the events and a continuation of half of them: ids that are there stay."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("description"))
    more = e.where("seq % 4 < 2").withColumn("description", F.concat(F.lit("new "), "description"))
    return ev.append_events(e.where("seq % 4 > 0").drop("seq"), more)
