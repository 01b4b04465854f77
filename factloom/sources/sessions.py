"""Sessions as turns, texts, passages and episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import capitalised

MINUTES_PER_TURN = 2


def session_time(datetime: Column, date: Column) -> Column:
    """From ``dd MMMM yyyy, HH:mm``, else from a date, else null."""
    return F.coalesce(F.try_to_timestamp(datetime, F.lit("d MMMM yyyy, HH:mm")), F.try_to_timestamp(date, F.lit("yyyy-MM-dd")))


def turns_of_sessions(sessions: DataFrame) -> DataFrame:
    """(session_id, turn, speaker, text, ts): turn i is 2 * i minutes after the session's time, unless
    it has a time of its own."""
    base = sessions.select("session_id", session_time(F.col("datetime"), F.col("date")).alias("base"), F.posexplode("turns").alias("turn", "t"))
    own = F.try_to_timestamp("t.timestamp")
    return base.select("session_id", "turn", "t.speaker", "t.text", F.coalesce(own, turn_time(F.col("base"), F.col("turn"))).alias("ts"))


def turn_time(base: Column, turn: Column) -> Column:
    return base + F.make_interval(mins=turn * MINUTES_PER_TURN)


def with_ground_truth(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """Turns with their ground truth; of several for one turn the last counts."""
    truth = sessions.select("session_id", F.posexplode("ground_truths").alias("place", "g"))
    truth = truth.groupBy("session_id", F.col("g.turn_id").alias("turn")).agg(F.max_by("g", "place").alias("ground_truth"))
    return turns.join(truth, ["session_id", "turn"], "left")


def needs_retrieval(ground_truth: Column) -> Column:
    return F.coalesce(F.size(ground_truth["retrieval_required"]) > 0, F.lit(False))


def turn_line(speaker: Column, text: Column) -> Column:
    return F.concat(F.lit("["), capitalised(speaker), F.lit("]: "), text)


def session_texts(turns: DataFrame, session: str = "session_id", turn: str = "turn", speaker: str = "speaker", text: str = "text") -> DataFrame:
    """(session, body): the lines of a session's turns in order."""
    rows = turns.groupBy(session).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("n"), turn_line(F.col(speaker), F.col(text)).alias("line")))).alias("rows"))
    return rows.select(session, F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("body"))


def session_header(session: Column, date: Column) -> Column:
    return F.concat(F.lit("[Session "), session.cast("string"), F.lit(" - "), F.coalesce(date, F.lit("")), F.lit("]"))


def turn_passages(turns: DataFrame, collection: str, group: str, pipeline: str = "vanilla", session: str = "session_id", turn: str = "turn", speaker: str = "speaker") -> DataFrame:
    """Passages at turn grain with their metadata."""
    text = F.concat(F.lit("["), F.col(speaker), F.lit("]: "), F.col("text"))
    doc = F.concat(F.lit("session_"), F.col(session).cast("string"), F.lit("_turn_"), F.col(turn).cast("string"))
    meta = F.create_map(
        F.lit("session_id"), F.col(session).cast("string"), F.lit("turn_index"), F.col(turn).cast("string"), F.lit("speaker"), F.col(speaker),
        F.lit("char_count"), F.length(text).cast("string"), F.lit("group_id"), F.lit(group), F.lit("pipeline"), F.lit(pipeline),
    )
    return turns.select(F.lit(collection).alias("collection"), doc.alias("doc_id"), text.alias("text"), meta.alias("metadata"))


def episodes(sessions: DataFrame, group: str, created_at: Column, name: Column, body: Column, reference_time: Column) -> DataFrame:
    """Episode rows; the key is a hash of the content, so ingesting again changes nothing."""
    return sessions.select(
        F.sha2(F.concat_ws("\x1f", F.lit(group), name, body), 256).alias("episode_id"),
        F.lit(group).alias("group_id"),
        name.alias("name"),
        body.alias("body"),
        F.lit("conversation").alias("source_description"),
        reference_time.alias("reference_time"),
        created_at.alias("created_at"),
    )
