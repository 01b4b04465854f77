"""Relational parts of dataset generation; texts come from hooks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.hooks import sentence_extractor

#: Fields that a persona has to have; hobbies and backstory may be missing.
PERSONA_FIELDS = ("name", "age", "occupation", "location", "traits", "interests", "conversation_topics")


def session_dates(spark: SparkSession, start: str, end: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` distinct days of a range, drawn by a hash of day and seed, with a time from 08:00 to 21:59."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    drawn = days.withColumn("__draw", F.xxhash64("date", F.lit(seed))).orderBy("__draw", "date").limit(n)
    minutes = 8 * 60 + F.pmod(F.xxhash64("date", F.lit(seed + 1)), F.lit(14 * 60))
    at = F.col("date").cast("timestamp") + F.make_interval(mins=minutes.cast("int"))
    return drawn.select("date", at.alias("ts"), F.row_number().over(_by_date()).alias("session_id"))


def _by_date():
    from pyspark.sql.window import Window

    # over the n drawn days only
    return Window.orderBy("date")


def persona_problems(personas: DataFrame) -> DataFrame:
    """Adds problems: required fields of the user that are missing or empty."""
    empty = lambda c: F.col(f"user.{c}").isNull() | (F.col(f"user.{c}").cast("string").isin("", "[]"))
    return personas.withColumn("problems", F.array_compact(F.array(*[F.when(empty(c), c) for c in PERSONA_FIELDS])))


def enough_turns(dialogues: DataFrame, least: int, turns: str = "turns") -> DataFrame:
    """Dialogues with at least ``least`` parsed turns."""
    return dialogues.where(F.size(turns) >= least)


def opening(turns: DataFrame, n: int = 10) -> DataFrame:
    """The first turns of each session, for a summary hook."""
    return turns.where(F.col("turn") < n)


#: Dates that a turn names: ISO days, and days with the month in words.
DATES = r"\d{4}-\d{2}-\d{2}|\d{1,2} [A-Z][a-z]+ \d{4}"


def ground_truth(turns: DataFrame, extract: Callable[[Column], Column] = sentence_extractor, confidence: float = 1.0) -> DataFrame:
    """Truth of each turn (session_id, turn, speaker, text) by an extractor hook: facts, entities, dates
    that the text names, and whether earlier turns are needed (it asks, or it names nothing itself)."""
    facts = extract(F.col("text"))
    rows = turns.select("session_id", F.col("turn").alias("turn_id"), "speaker", "text", facts.alias("found"))
    return rows.select(
        "session_id", "turn_id", "speaker",
        F.transform("found", lambda f: F.struct(f["fact"].alias("fact"), F.lit(confidence).alias("confidence"), F.when(F.col("speaker") == "user", "user").otherwise("other").alias("category"))).alias("factual"),
        F.array_distinct(F.flatten(F.transform("found", lambda f: f["entities"]))).alias("entities_mentioned"),
        F.regexp_extract_all("text", F.lit(DATES), 0).alias("temporal_references"),
        (F.contains("text", F.lit("?")) | (F.size("found") == 0)).alias("retrieval_required"),
    )
