"""Several tables written together, a micro-batch at a time, so that readers see whole batches only.

A batch's rows of each table go to a folder of its number; the last step is a manifest of that number,
moved into place in one step. A batch that failed between two tables has no manifest: nobody reads what it
left, and when the stream gives it again its folders are written over. A batch that has its manifest is
not written again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources import sessions, sinks


class BatchTables:
    """Tables in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self) -> list[int]:
        """Numbers of the whole batches."""
        folder = self._path(f"{self.path}/_manifest")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit())

    def commit(self, number: int, tables: dict[str, DataFrame]) -> bool:
        """Writes a batch unless it is there; says whether it wrote."""
        if number in self.committed():
            return False
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")
        hidden, seen = self._path(f"{self.path}/_manifest/_{number}"), self._path(f"{self.path}/_manifest/{number}")
        self._fs.create(hidden, True).close()
        if not self._fs.rename(hidden, seen):
            raise OSError(f"no manifest for batch {number}")
        return True

    def read(self, name: str) -> DataFrame:
        """The rows of all whole batches, with their batch number."""
        folders = [f"{self.path}/{name}/batch={n}" for n in self.committed()]
        if not folders:
            raise ValueError(f"no batch of {name} yet")
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*folders)


def graph_tables(turns: DataFrame, group: str, extract: Callable[[Column], Column], embed: Callable[[Column], Column] | None = None, created: Column | None = None) -> dict[str, DataFrame]:
    """All tables of turns (session_id, turn, speaker, text): passages, episodes, facts, entities, has_fact and
    fact_involves. Keys are content hashes, so a turn that comes twice gives equal rows."""
    name = F.concat(F.lit("Session "), F.col("session_id").cast("string"), F.lit(" Turn "), F.col("turn").cast("string"))
    none = F.lit(None).cast("timestamp")
    episodes = sessions.episodes(turns, group, F.lit("2024-01-01").cast("timestamp") if created is None else created, name, F.col("text"), none)
    facts = sinks.facts_of_episodes(episodes, extract, embed)
    has, involves = sinks.edges_of_facts(facts)
    return {
        "passage": sinks.passages(sessions.turn_passages(turns, group, group), embed),
        "episode": episodes, "fact": facts, "entity": sinks.entities_of_facts(facts), "has_fact": has, "fact_involves": involves,
    }


def ingest_sessions(stream: DataFrame, tables: BatchTables, checkpoint: str, make: Callable[[DataFrame], dict[str, DataFrame]]) -> None:
    """Takes up what is there of a stream of turns; ``make`` gives the tables of a batch (as
    :func:`graph_tables` does). A later call with the same checkpoint resumes."""

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            tables.commit(number, make(held))
        finally:
            held.unpersist()

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def whole_graph(tables: BatchTables) -> dict[str, DataFrame]:
    """The tables as a batch ingest of all turns would give them: rows of equal key once, of an entity the last
    writer, edges of facts that came twice once."""
    read = lambda name: tables.read(name).drop("batch")
    out = {name: read(name).dropDuplicates([key]) for name, key in (("passage", "passage_id"), ("fact", "fact_id"))}
    out["episode"] = read("episode").dropDuplicates(["name", "group_id"])
    out["entity"] = sinks.last_writer(read("entity"), "entity_id", "created_at", "name").select("entity_id", "group_id", "name", "created_at")
    facts = tables.read("fact").groupBy("fact_id").agg(F.min("batch").alias("batch"))
    for name, fact in (("has_fact", "out_id"), ("fact_involves", "in_id")):
        # the edges of the batch that a fact came in first; repeated ones of that batch stay
        first = facts.select(F.col("fact_id").alias(fact), "batch")
        out[name] = tables.read(name).join(first, [fact, "batch"], "left_semi").drop("batch")
    return out
