"""Usage queries: ``events`` as a log of model calls, in batch and as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import reports, windows
from factloom.plans.registry import Registry, table
from factloom.shared import scratch_dir
from factloom.streaming import state
from factloom.streaming import windows as streams

add = Registry()


@add("rolling_rpm", """
SELECT event_id, CAST(count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS BIGINT) AS requests FROM events""")
def rolling_rpm(spark, sf):
    return windows.rolling(table(spark, sf, "events"), "event_type", "ts", 3600, name="requests").select("event_id", "requests")


@add("rolling_tokens", """
SELECT event_id, CAST(sum(CAST(floor(value * 100) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS BIGINT) AS tokens FROM events""")
def rolling_tokens(spark, sf):
    return windows.rolling(table(spark, sf, "events"), "event_type", "ts", 3600, F.floor(F.col("value") * 100), "tokens").select("event_id", "tokens")


@add("within_budget", """
WITH w AS (SELECT event_id, count(*) OVER o AS requests_60s, CAST(sum(CAST(floor(value) AS BIGINT)) OVER o AS BIGINT) AS tokens_60s FROM events WINDOW o AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW))
SELECT event_id, requests_60s, tokens_60s, requests_60s <= 1 AND tokens_60s <= 20 AS allowed FROM w""")
def within_budget(spark, sf):
    log = table(spark, sf, "events").withColumn("tokens", F.floor("value"))
    return windows.within_budget(log, "event_type", "ts", 1, 20, "tokens").select("event_id", F.col("requests_60s").cast("long").alias("requests_60s"), "tokens_60s", "allowed")


@add("tumbling_budget", """
SELECT epoch_us(time_bucket(INTERVAL 1 hour, ts, TIMESTAMP '1970-01-01')) // 1000000 AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling_budget(spark, sf):
    out = windows.tumbling(table(spark, sf, "events"), "ts", "1 hour", "event_type", amount="value")
    return out.select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@add("sliding_budget", """
WITH s AS (SELECT event_type, value, epoch_us(time_bucket(INTERVAL 30 minutes, ts, TIMESTAMP '1970-01-01')) // 1000000 AS w FROM events),
x AS (SELECT event_type, value, w FROM s UNION ALL SELECT event_type, value, w - 1800 FROM s)
SELECT w AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM x GROUP BY 1, 2""")
def sliding_budget(spark, sf):
    out = windows.sliding(table(spark, sf, "events"), "ts", "1 hour", "30 minutes", "event_type", amount="value")
    return out.select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@add("session_windows", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER o + INTERVAL 4 hours THEN 0 ELSE 1 END AS new FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 14400000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf):
    out = windows.sessions(table(spark, sf, "events"), "ts", "4 hours", "user_id")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@add("daily_quota", "SELECT event_type, epoch_us(time_bucket(INTERVAL 1 day, ts, TIMESTAMP '1970-01-01')) // 1000000 AS start, count(*) AS n, count(*) <= 60 AS allowed FROM events GROUP BY 1, 2")
def daily_quota(spark, sf):
    out = windows.tumbling(table(spark, sf, "events"), "ts", "1 day", "event_type")
    return out.select("event_type", F.unix_seconds("start").alias("start"), "n", (F.col("n") <= 60).alias("allowed"))


MODELS = ("models/embedding-1", "gemma-27b", "flash-lite-2", "flash-2", "pro-2", "other")


@add("cost_rollup", f"""
WITH u AS (SELECT replace(({list(MODELS)})[1 + event_id % 6], 'models/', '') AS model, CAST(floor(value * 10) AS BIGINT) AS i, event_id % 97 AS o FROM events),
c AS (SELECT *, CASE WHEN contains(model, 'embedding') THEN i * 0.15 WHEN contains(model, 'gemma') THEN i * 0.0952 + o * 0.16 WHEN contains(model, 'flash-lite') THEN i * 0.1 + o * 0.4
  WHEN contains(model, 'flash') THEN i * 0.3 + o * 2.5 WHEN contains(model, 'pro') THEN i * 1.25 + o * 10.0 ELSE 0 END / 1000000 AS cost FROM u)
SELECT model, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, round(sum(cost)::DOUBLE, 6) AS cost_usd, count(*) AS calls FROM c GROUP BY ROLLUP (model)""")
def cost_rollup(spark, sf):
    from factloom.functions.text import model_name

    model = F.element_at(F.array(*map(F.lit, MODELS)), (F.col("event_id") % 6 + 1).cast("int"))
    usage = table(spark, sf, "events").select(model_name(model).alias("model"), F.floor(F.col("value") * 10).alias("input_tokens"), (F.col("event_id") % 97).alias("output_tokens"))
    return reports.cost_rollup(usage).withColumn("cost_usd", F.round("cost_usd", 6))


@add("latency_stats", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(count(*) / sum(value), 6) AS per_second FROM events GROUP BY 1")
def latency_stats(spark, sf):
    out = reports.latency_stats(table(spark, sf, "events"), "value", "event_type")
    return out.withColumns({"mean": F.round("mean", 6), "per_second": F.round("per_second", 6)})


@add("hook_metrics", "SELECT event_type AS hook, count(*) AS requests, CAST(sum(user_id) AS BIGINT) AS texts, count(*) FILTER (value > 40) AS errors, round(avg(value), 6) AS mean_seconds FROM events GROUP BY 1")
def hook_metrics(spark, sf):
    log = table(spark, sf, "events").select(F.col("event_type").alias("hook"), F.col("user_id").alias("texts"), (F.col("value") > 40).alias("failed"), F.col("value").alias("seconds"))
    return reports.hook_metrics(log).withColumn("mean_seconds", F.round("mean_seconds", 6))


#: A pattern, because a stream's plain path has to be a folder; it fits a file and a folder alike.
EVENTS = "{}/events.parque[t]"


def streamed(spark: SparkSession, sf: str, make, mode: str = "append") -> DataFrame:
    """Run a stream over ``events`` to its end and return what it wrote."""
    folder = f"{scratch_dir(spark)}/factloom/stream-{uuid.uuid4().hex}"
    source = streams.read_stream(spark, EVENTS.format(sf), table(spark, sf, "events").schema)
    streams.run_available(make(source), f"{folder}/out", f"{folder}/state", mode)
    return spark.read.parquet(f"{folder}/out")


WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> ''))"
CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 1 hour"


@add("stream_tumbling", f"""
WITH w AS (SELECT time_bucket(INTERVAL 1 hour, ts, TIMESTAMP '1970-01-01') AS s, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT epoch_us(s) // 1000000 AS start, event_type, n FROM w WHERE s + INTERVAL 1 hour <= {CLOSED}""")
def stream_tumbling(spark, sf):
    """Windows that the watermark has closed."""
    out = streamed(spark, sf, lambda s: streams.tumbling_stream(s, "ts", "1 hour", "1 hour", "event_type"))
    return out.select(F.unix_seconds("start").alias("start"), "event_type", "n")


@add("stream_sliding", f"""
WITH s AS (SELECT time_bucket(INTERVAL 30 minutes, ts, TIMESTAMP '1970-01-01') AS a FROM events), x AS (SELECT a FROM s UNION ALL SELECT a - INTERVAL 30 minutes FROM s),
w AS (SELECT a, count(*) AS n FROM x GROUP BY 1)
SELECT epoch_us(a) // 1000000 AS start, n FROM w WHERE a + INTERVAL 1 hour <= {CLOSED}""")
def stream_sliding(spark, sf):
    out = streamed(spark, sf, lambda s: streams.sliding_stream(s, "ts", "1 hour", "30 minutes", "1 hour"))
    return out.select(F.unix_seconds("start").alias("start"), "n")


@add("stream_sessions", f"""
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER o + INTERVAL 4 hours THEN 0 ELSE 1 END AS new FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
w AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 4 hours AS b, count(*) AS n FROM s GROUP BY user_id, k)
SELECT user_id, epoch_us(a) AS start_us, n FROM w WHERE b <= {CLOSED}""")
def stream_sessions(spark, sf):
    out = streamed(spark, sf, lambda s: streams.session_stream(s, "ts", "4 hours", "1 hour", "user_id"))
    return out.select("user_id", F.unix_micros("start").alias("start_us"), "n")


@add("stream_budget", f"""
WITH c AS (SELECT event_id, event_type AS k, epoch_us(ts) AS t, CAST(floor(value) AS BIGINT) AS tokens, ts FROM events),
w AS (SELECT *, count(*) OVER o AS requests_60s, CAST(sum(tokens) OVER o AS BIGINT) AS tokens_60s, count(*) OVER u AS place, CAST(sum(tokens) OVER u AS BIGINT) AS upto FROM c
  WINDOW o AS (PARTITION BY k ORDER BY t RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW), u AS (PARTITION BY k ORDER BY t RANGE UNBOUNDED PRECEDING)),
r AS (SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY t) AS n FROM c),
x AS (SELECT w.event_id, b.t AS leaving FROM w ASOF JOIN (SELECT k, upto, min(t) AS t FROM w GROUP BY k, upto) b ON w.k = b.k AND w.upto - 20 <= b.upto WHERE tokens_60s > 20),
y AS (SELECT w.event_id, r.t AS leaving FROM w JOIN r ON r.k = w.k AND r.n = place - 1 WHERE requests_60s > 1)
SELECT event_id, requests_60s, tokens_60s, requests_60s <= 1 AND tokens_60s <= 20 AS allowed, coalesce(greatest(x.leaving, y.leaving) + 60000000 - t, 0) / 1e6 AS wait_seconds
FROM w LEFT JOIN x USING (event_id) LEFT JOIN y USING (event_id) WHERE time_bucket(INTERVAL 1 minute, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 minute <= {CLOSED}""")
def stream_budget(spark, sf):
    """Calls whose minute the watermark has closed, with the seconds each would have to wait."""
    with state.state_store(spark):
        return streamed(spark, sf, lambda s: state.budget_stream(s.withColumn("tokens", F.floor("value")), "event_type", "ts", "event_id", "tokens", 1, 20, "1 hour"))


@add("stream_turns", """
WITH c AS (SELECT conv_id AS session_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS expected FROM conversations),
q AS (SELECT session_id, turn AS asked, text AS query, expected FROM c WHERE role = 'user' AND expected IS NOT NULL),
k AS (SELECT q.session_id, asked, c.turn, c.text, coalesce(len(list_intersect({c}, {q}))::DOUBLE / nullif(len({q}), 0), 0.0) AS score FROM q JOIN c ON c.session_id = q.session_id AND c.turn < asked),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, asked ORDER BY score DESC, turn DESC) AS rank FROM k),
g AS (SELECT session_id, asked, string_agg(text, chr(10) ORDER BY rank) AS lines FROM r WHERE rank <= 3 GROUP BY 1, 2)
SELECT session_id, asked, query, expected, coalesce(lines, '') AS retrieved FROM q LEFT JOIN g USING (session_id, asked)""".replace("{c}", WORDS.format("c.text")).replace("{q}", WORDS.format("query")))
def stream_turns(spark, sf):
    """Each user turn is asked as soon as its answer comes, over what its session stored before it. Turns are
    two minutes apart."""
    folder = f"{scratch_dir(spark)}/factloom/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf, "conversations").schema
    turns = spark.readStream.schema(schema).parquet(f"{sf}/conversations.parque[t]")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + 120 * F.col("turn"))
    turns = turns.select(F.col("conv_id").alias("session_id"), "turn", F.col("role").alias("speaker"), "text", at.alias("ts"))
    with state.state_store(spark):
        streams.run_available(state.interleaved_stream(turns, "ts", "1 day"), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").withColumn("retrieved", F.array_join("retrieved", "\n"))


@add("stream_ingest", "SELECT user_id, count(*) AS n_events, max(event_id) AS last_event FROM events GROUP BY 1")
def stream_ingest(spark, sf):
    """Micro-batches appended under their number, so a batch given again replaces itself."""
    folder = f"{scratch_dir(spark)}/factloom/stream-{uuid.uuid4().hex}"
    source = streams.read_stream(spark, EVENTS.format(sf), table(spark, sf, "events").schema)
    streams.ingest(source, lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}"), f"{folder}/state")
    rows = spark.read.parquet(f"{folder}/out")
    return rows.groupBy("user_id").agg(F.count("*").alias("n_events"), F.max("event_id").alias("last_event"))


@add("client_costs", """
WITH u AS (SELECT event_id, (['gemini-2.5-flash', 'gemini-2.5-flash-lite', 'gemini-2.5-pro', 'google/gemma-3-27b-it', 'other'])[1 + event_id % 5] AS model FROM events)
SELECT model, count(*) AS n, round(sum(CASE model WHEN 'gemini-2.5-flash' THEN event_id * 0.075 + 100 * 0.3 WHEN 'gemini-2.5-flash-lite' THEN event_id * 0.05 + 100 * 0.2 WHEN 'gemini-2.5-pro' THEN event_id * 1.25 + 100 * 10.0
  WHEN 'google/gemma-3-27b-it' THEN event_id * 0.0952 + 100 * 0.16 ELSE 0 END / 1000000), 6) AS cost FROM u GROUP BY model""")
def client_costs(spark, sf):
    from factloom.functions.usage import CLIENT_PRICES, client_cost_usd

    models = F.array(*map(F.lit, (*CLIENT_PRICES, "other")))
    u = table(spark, sf, "events").withColumn("model", F.element_at(models, (F.col("event_id") % 5 + 1).cast("int")))
    return u.groupBy("model").agg(F.count("*").alias("n"), F.round(F.sum(client_cost_usd(F.col("model"), F.col("event_id"), F.lit(100))), 6).alias("cost"))
