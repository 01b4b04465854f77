"""Readers of the JSON documents: datasets, events, personas, queries, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import schemas


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """One row for each session of a dataset document; entries that are no sessions are dropped."""
    # entries are read as text first, so that one bad entry does not spoil the list
    data = spark.read.schema("sessions array<string>").option("multiLine", True).json(path)
    return data.select(F.explode("sessions").alias("s")).select(F.from_json("s", schemas.SESSION).alias("s")).where("s.session_id IS NOT NULL").select("s.*")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EVENTS).option("multiLine", True).json(path)


def read_persona(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PERSONA).option("multiLine", True).json(path)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation queries, from a bare list or an object with ``queries``; the cross-session flag is
    derived from the sessions."""
    fields = "id string, query_id string, query string, type string, difficulty string, expected_answer string, required_context string, reasoning_steps string, relevant_sessions array<int>, source string"
    struct = fields.replace(" string", ":string").replace(" array<int>", ":array<int>").replace(", ", ",")
    raw = spark.read.schema(f"{fields}, queries array<struct<{struct}>>").option("multiLine", True).json(path)
    names = [f.split(" ")[0] for f in fields.split(", ")]
    bare = raw.where("queries IS NULL").select(*names)
    nested = raw.where("queries IS NOT NULL").select(F.explode("queries").alias("q")).select("q.*")
    rows = bare.unionByName(nested)
    return rows.withColumns({"id": F.coalesce("id", "query_id"), "is_cross_session": F.size("relevant_sessions") > 1}).drop("query_id")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored results of an earlier run: one JSON object a line."""
    return spark.read.json(path)


def read_cost_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.COST).json(path).withColumn("ts", F.timestamp_seconds("timestamp"))


def sample_texts(turns: DataFrame, n: int = 100, length: int = 500) -> DataFrame:
    """The first ``n`` turns' texts for a benchmark, cut to ``length``."""
    return turns.orderBy("session_id", "turn").limit(n).select(F.left("text", F.lit(length)).alias("text"))
