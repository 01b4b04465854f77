"""Causal event timelines: validation, context, relevance windows, ancestry, density.

Events: id, date, description, caused_by (array of ids).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from factloom.shared import saved


#: Pairs of the largest depth whose ids are broadcast in :func:`ancestry`, if all pairs are at least so many times more.
FEW, FEW_OF = 1 << 21, 32


def causes(events: DataFrame, id_col: str = "id", caused_by: str = "caused_by") -> DataFrame:
    """Edge rows (id, position, cause), in the order of the list."""
    return events.select(id_col, F.posexplode(caused_by).alias("position", "cause"))


def valid_events(events: DataFrame) -> DataFrame:
    """Events with id, description, an ISO date and a list of causes; causes must exist and be earlier.

    Causes that do not hold are removed from the list.
    """
    day = F.try_to_date("date", "yyyy-MM-dd")
    rows = events.where(F.col("id").isNotNull() & F.col("description").isNotNull() & day.isNotNull() & F.col("caused_by").isNotNull())
    rows = rows.withColumn("day", day)
    dated = rows.select(F.col("id").alias("cause"), F.col("day").alias("cause_day"))
    good = causes(rows.select("id", "caused_by")).join(dated, "cause").join(rows.select("id", "day"), "id").where("day > cause_day")
    kept = good.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("position", "cause"))).alias("c"))
    return rows.join(kept, "id", "left").withColumn("caused_by", F.coalesce(F.transform("c", lambda x: x["cause"]), F.array().cast("array<string>"))).drop("c", "day")


def valid_continuation(new: DataFrame, known_ids: DataFrame, last_number: int, start: Column, end: Column) -> DataFrame:
    """New events (with their place ``seq``): id E<n> beyond the last one, causes known or earlier in
    the batch, dates moved into [start, end]; events without a date go."""
    number = F.try_to_number(F.nullif(F.regexp_extract("id", r"^E(\d+)$", 1), F.lit("")), F.lit("999999999")).cast("long")
    day = F.try_to_date("date", "yyyy-MM-dd")
    rows = new.withColumns({"number": number, "day": day}).where(F.col("number") > last_number).where("day IS NOT NULL")
    sources = known_ids.select(F.col("id").alias("cause"), F.lit(-1).cast("long").alias("cause_seq")).unionByName(rows.select(F.col("id").alias("cause"), F.col("seq").cast("long").alias("cause_seq")))
    sources = sources.groupBy("cause").agg(F.min("cause_seq").alias("cause_seq"))
    good = rows.select("id", "seq", F.posexplode("caused_by").alias("position", "cause")).join(sources, "cause").where("cause_seq < seq")
    kept = good.groupBy("id", "seq").agg(F.array_sort(F.collect_set(F.struct("position", "cause"))).alias("c"))
    out = rows.join(kept, ["id", "seq"], "left")
    moved = F.date_format(F.least(F.greatest("day", start), end), "yyyy-MM-dd")
    return out.withColumns({"date": moved, "caused_by": F.coalesce(F.transform("c", lambda x: x["cause"]), F.array().cast("array<string>"))}).drop("c", "number", "day")


def causal_context(events: DataFrame, id_col: str = "id", text: str = "description") -> DataFrame:
    """(id, causal_context): the texts of existing causes, in order, joined by commas."""
    texts = events.select(F.col(id_col).alias("cause"), F.col(text).alias("__text"))
    rows = causes(events.select(id_col, "caused_by"), id_col).join(texts, "cause")
    return rows.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "__text"))), lambda r: r["__text"]), ", ").alias("causal_context"))


def connected_events(events: DataFrame, id_col: str = "id") -> DataFrame:
    """Events that have a cause or are one; standalone events go."""
    named = causes(events.select(id_col, "caused_by"), id_col).select(F.col("cause").alias(id_col)).distinct()
    parents = events.where(F.size("caused_by") > 0)
    return parents.unionByName(events.where(F.size("caused_by") == 0).join(named, id_col, "left_semi"))


def relevant_events(sessions: DataFrame, events: DataFrame, days: int = 7) -> DataFrame:
    """(session_id, id): the events of each session's window.

    The first session sees events up to its date, others those since the session before; a session
    without any sees those of the last ``days``. ``sessions``: session_id, date; ``events``: id, date.
    Windows are cut into months, so that the interval join is an equi-join. Only the calendar is
    ordered as a whole: its days are bounded, whatever the number of sessions.
    """
    calendar = sessions.select("date").distinct().withColumn("earlier", F.lag("date").over(Window.orderBy("date")))
    again = F.row_number().over(Window.partitionBy("date").orderBy("session_id")) > 1
    ordered = sessions.select("session_id", "date").withColumn("again", again).join(calendar, "date")
    spans = ordered.select("session_id", "date", F.when(F.col("again"), F.col("date")).otherwise(F.col("earlier")).alias("previous"))
    bounds = events.agg(F.min("date").alias("a"))
    low = F.when(F.col("previous").isNull(), F.least(F.col("a"), F.col("date"))).otherwise(F.col("previous"))
    spans = spans.crossJoin(F.broadcast(bounds)).withColumn("low", low).drop("a")
    month = lambda d: F.trunc(d, "month")
    cells = spans.withColumn("month", F.explode(F.sequence(month(F.least("low", F.date_sub("date", days))), month("date"), F.expr("interval 1 month"))))
    pairs = cells.join(events.select("id", F.col("date").alias("day"), month("date").alias("month")), "month")
    direct = F.col("previous").isNull() | (F.col("day") > F.col("previous"))
    near = F.col("day") >= F.date_sub("date", days)
    pairs = pairs.where((F.col("day") <= F.col("date")) & (direct | near)).withColumn("direct", direct)
    hit = pairs.where("direct").select("session_id").distinct().withColumn("hit", F.lit(True))
    rows = pairs.join(hit, "session_id", "left")
    return rows.where(F.col("direct") | F.col("hit").isNull()).select("session_id", "id", "day")


def ancestry(events: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, ancestor, depth): all causes of causes, at the least depth; chains of any length, and cycles.

    Each round doubles the depth: a pair of a depth between m and 2 m is a pair of depth m exactly
    followed by one of depth m at most. Pairs seen before are removed, so no path is walked twice, and
    a round without pairs of its largest depth ends the search. Rounds are written tables.
    """
    edges = causes(events.select(id_col, "caused_by"), id_col).where("cause IS NOT NULL")
    # numbers stay numbers until the end: half of the bytes that strings take
    kinds = {edges.schema[c].dataType for c in (id_col, "cause")}
    as_is = len(kinds) == 1 and isinstance(next(iter(kinds)), T.IntegralType)
    key = lambda c: F.col(c) if as_is else F.col(c).cast("string")
    known = saved(edges.select(key(id_col).alias("id"), key("cause").alias("ancestor"), F.lit(1).alias("depth")).distinct(), "ancestry")
    reach, last = 1, known
    while n := last.count():
        first = last.select("id", F.col("ancestor").alias("middle"))
        then, there = known.select(F.col("id").alias("middle"), "ancestor", "depth"), known.select("id", "ancestor")
        if n <= FEW and n * FEW_OF <= known.count():
            # only a small part goes on: what cannot meet it is not moved
            then = then.join(F.broadcast(first.select("middle")), "middle", "left_semi")
            there = there.join(F.broadcast(first.select("id")), "id", "left_semi")
        new = first.join(then, "middle").groupBy("id", "ancestor").agg((F.min("depth") + reach).alias("depth"))
        new = saved(new.join(there, ["id", "ancestor"], "left_anti"), "ancestry")
        known = known.unionByName(new)
        reach *= 2
        # pairs of the largest depth are among the new ones only
        last = new.where(F.col("depth") == reach)
    return known.select(F.col("id").cast("string").alias("id"), F.col("ancestor").cast("string").alias("ancestor"), "depth")


def density(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row: n_events, span_days, events_per_day, sessions_per_day, events_per_session, mean causes.

    Without events all figures are 0. Both sides are aggregated to a row before they meet.
    """
    e = events.agg(F.count("*").alias("n_events"), F.datediff(F.max("date"), F.min("date")).alias("days"), F.coalesce(F.sum(F.size("caused_by")), F.lit(0)).alias("causes"))
    s = sessions.agg(F.count("*").alias("n_sessions"))
    span = F.when(F.col("n_events") > 0, F.col("days") + 1).otherwise(0)
    rate = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return e.crossJoin(s).withColumn("span_days", span.cast("long")).select(
        "n_events", "n_sessions", "span_days",
        rate(F.col("n_events"), F.col("span_days")).alias("events_per_day"),
        F.when(F.col("n_events") > 0, rate(F.col("n_sessions"), F.col("span_days"))).otherwise(0.0).alias("sessions_per_day"),
        rate(F.col("n_events"), F.col("n_sessions")).alias("events_per_session"),
        rate(F.col("causes"), F.col("n_events")).alias("mean_causes"),
    )


def event_target(n_sessions: int, n_events: int, share: float = 0.8) -> int:
    """Events wanted for a number of sessions."""
    return max(int(share * n_sessions), n_events)


def redistribute(resolved: DataFrame, turns: DataFrame) -> DataFrame:
    """Resolved facts back to turns by place: each turn takes as many as it had.

    ``resolved``: session_id, position (from 0), fact; ``turns``: session_id, turn, n_facts. The ranges
    of turns meet a fact by key and interval, one session at a time.
    """
    upto = F.sum("n_facts").over(Window.partitionBy("session_id").orderBy("turn"))
    ranges = turns.select("session_id", "turn", (upto - F.col("n_facts")).alias("low"), upto.alias("high"))
    return resolved.join(ranges, "session_id").where("position >= low AND position < high").drop("low", "high")


def latest_facts(facts: DataFrame, *key: str, order: str = "created_at") -> DataFrame:
    """Conflict resolution without a model: the newest fact of each key wins."""
    return facts.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order), F.desc("fact_id")))).where("__n = 1").drop("__n")


def append_events(events: DataFrame, continuation: DataFrame) -> DataFrame:
    """A timeline with the (validated) events of a continuation; an id that is there keeps its event. Of
    repeated ids in the continuation the first by ``seq`` comes in."""
    columns = [c for c in events.columns if c in continuation.columns]
    first = continuation.groupBy("id").agg(F.min_by(F.struct(*[c for c in columns if c != "id"]), "seq").alias("__e")).select("id", "__e.*")
    fresh = first.join(events.select("id"), "id", "left_anti")
    return events.unionByName(fresh, allowMissingColumns=True)
