"""Writes: episodes with their facts, entities and edges; passages; deletes; reports and logs.

Tables are partitioned by group or collection, so scans and deletes of one touch its files only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.text import entity_id, passage_id


def facts_of_episodes(episodes: DataFrame, extract: Callable[[Column], Column], embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Fact rows of episodes by an extractor hook; blank facts are dropped; keys are content hashes."""
    rows = episodes.select("group_id", F.col("name").alias("episode_name"), "source_description", F.col("reference_time").alias("valid_at"), "created_at", F.explode(extract(F.col("body"))).alias("f"))
    rows = rows.where(F.trim("f.fact") != "")
    key = F.sha2(F.concat_ws("\x1f", "group_id", "episode_name", "f.fact"), 256)
    vector = embed(F.col("f.fact")) if embed else F.lit(None).cast("array<float>")
    return rows.select(key.alias("fact_id"), "group_id", "episode_name", F.col("f.fact").alias("fact_text"), vector.alias("embedding"), F.col("f.entities").alias("entity_names"), "valid_at", "created_at", "source_description").dropDuplicates(["fact_id"])


def entities_of_facts(facts: DataFrame) -> DataFrame:
    """Entity rows: the last writer of a key wins."""
    rows = facts.select("group_id", F.explode("entity_names").alias("name"), "created_at", "fact_id").where(F.trim("name") != "")
    return last_writer(rows.withColumn("entity_id", entity_id(F.col("group_id"), F.col("name"))), "entity_id", "created_at", "fact_id", "name").select("entity_id", "group_id", "name", "created_at")


def last_writer(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key: the greatest in ``order``. One partial and one final aggregate, no sort of a key's rows."""
    others = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r"))
    return best.select(key, "r.*").select(*rows.columns)


def edges_of_facts(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(has_fact, fact_involves), with repeated edges kept."""
    has = facts.select(F.col("episode_name").alias("in_id"), F.col("fact_id").alias("out_id"))
    names = facts.select("fact_id", "group_id", F.explode("entity_names").alias("name"))
    return has, names.select(F.col("fact_id").alias("in_id"), entity_id(F.col("group_id"), F.col("name")).alias("out_id"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones with the same key; the result is to be written as a new version."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def passages(rows: DataFrame, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Passage rows with key and vector; an existing vector stays."""
    if "embedding" not in rows.columns:
        rows = rows.withColumn("embedding", embed(F.col("text")) if embed else F.lit(None).cast("array<float>"))
    return rows.withColumn("passage_id", passage_id(F.col("collection"), F.col("doc_id")))


def clear_group(episodes: DataFrame, facts: DataFrame, entities: DataFrame, has_fact: DataFrame, involves: DataFrame, group: str) -> tuple[DataFrame, ...]:
    """What stays of each table when a group is deleted; edges go with the facts at either end."""
    gone = facts.where(F.col("group_id") == group).select("fact_id").distinct()
    keep = lambda df: df.where(F.col("group_id") != group)
    return (
        keep(episodes), keep(facts), keep(entities),
        has_fact.join(gone, has_fact["out_id"] == gone["fact_id"], "left_anti"),
        involves.join(gone, involves["in_id"] == gone["fact_id"], "left_anti"),
    )


def group_counts(**tables: DataFrame) -> DataFrame:
    """(name, n) of each table."""
    parts = [df.groupBy().agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_partitioned(df: DataFrame, path: str, by: str, mode: str = "append") -> None:
    df.write.mode(mode).partitionBy(by).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def resume_after(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been done yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def first_turns(turns: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` turns of a dataset in order: a top-k, not a window over one partition."""
    return turns.orderBy("session_id", "turn").limit(limit)


def newest(rows: DataFrame, n: int, order: str, by: str) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("__n") <= n).drop("__n")


def clear_collection(passages: DataFrame, collection: str) -> DataFrame:
    """What stays of the passages when a collection is deleted."""
    return passages.where(~F.col("collection").eqNullSafe(collection))


def passage(passages: DataFrame, collection: str, doc_id: str) -> DataFrame:
    """The passage of a collection by the id of its document."""
    return passages.where(F.col("passage_id") == passage_id(F.lit(collection), F.lit(doc_id)))


def collection_counts(passages: DataFrame) -> DataFrame:
    return passages.groupBy("collection").agg(F.count("*").alias("n"))


def purge(**tables: DataFrame) -> dict[str, DataFrame]:
    """Empty versions of tables, to be written in place of them."""
    return {name: df.where(F.lit(False)) for name, df in tables.items()}


def merged_metadata(old: Column, new: Column) -> Column:
    """Metadata maps, the new one's entries before the old one's."""
    none = F.create_map().cast("map<string,string>")
    kept = F.map_filter(F.coalesce(old, none), lambda k, _: ~F.map_contains_key(F.coalesce(new, none), k))
    return F.map_concat(kept, F.coalesce(new, none))
