"""Sharding by longest-processing-time scheduling.

Rows with equal text are a group and stay together. Units, sorted by bytes from the largest, go one
by one to the least-loaded shard, found through a heap. A unit is a group of at least a
1/``UNITS`` of all bytes, or a cell of smaller groups that share a hash; so there are at most
2 * ``UNITS`` units whatever the input, and only their sums reach the driver. The law is ``bytes``:
shards have nearly equal bytes, as far as the largest groups allow.

Slots are numbered within a shard without gaps: the driver gives each unit a base, and rows are
numbered within their unit; a large group is numbered in parts of about a 1/``UNITS`` of the bytes, by
the hash of the id, or of the row where rows of one id (or of none) are that many themselves. So no task
gets a hot group whole, and only rows that are equal anyway depend on where they were read.

Cases: a null text counts as empty; a null id is a valid id; equal rows are numbered in any order,
which gives the same rows; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.common import saved, text_of

SHARDS, UNITS = 8, 4096


def schedule(units: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Longest first: (unit, bytes) to shard. Ties: the smaller unit first, then the lower shard."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for unit, size in sorted(units, key=lambda u: (-u[1], u[0])):
        load, shard = heapq.heappop(heap)
        placed[unit] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def in_parts(rows: DataFrame, named: DataFrame, group: list[str], least: int, units: int) -> DataFrame:
    """Rows (__id, ``group``, row) with their unit and part. ``named``: the large groups, with unit and parts."""
    # at most `units` ids have `least` bytes in one group
    heavy = rows.join(F.broadcast(named.where("parts > 1")), group).groupBy(*group, "__id").agg(F.sum("size").alias("bytes")).where(F.col("bytes") >= least)
    heavy = heavy.select(*[F.col(c).alias(f"h_{c}") for c in group], F.col("__id").alias("h_id"))
    same = F.col("__id").eqNullSafe(F.col("h_id"))
    for c in group:
        same = same & (F.col(c) == F.col(f"h_{c}"))
    rows = rows.join(F.broadcast(named), group, "left").join(F.broadcast(heavy), same, "left")
    spread = F.when(F.col("h_hash").isNotNull(), F.xxhash64("row")).otherwise(F.xxhash64("__id"))
    return rows.select(
        "__id", *group,
        F.coalesce("unit", F.pmod("hash", F.lit(units)).cast("int")).alias("unit"),
        F.when(F.col("parts") > 1, F.pmod(spread, "parts").cast("int")).otherwise(0).alias("part"),
    )


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shards: int = SHARDS, units: int = UNITS) -> DataFrame:
    """One row for each document: id, size (bytes of the text plus 1), text_crc32, law, shard, slot
    and grown_shard (null under this law)."""
    spark = docs.sparkSession
    body = text_of(docs, text)
    rows = saved(
        docs.select(docs[id_col].alias("__id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.xxhash64(body).alias("hash")).withColumn("row", F.monotonically_increasing_id()),
        "shard-rows",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    unit = max(1, math.ceil(total / units))
    group = ["hash", "text_crc32", "size"]
    # at most `units` groups are this large
    large = rows.groupBy(*group).agg(F.sum("size").alias("bytes")).where(F.col("bytes") >= unit).orderBy(F.desc("bytes"), *group).collect()
    large = [(r["hash"], r["text_crc32"], r["size"], units + i, math.ceil(r["bytes"] / unit)) for i, r in enumerate(large)]
    named = spark.createDataFrame(large, "hash long, text_crc32 long, size long, unit int, parts int")
    rows = in_parts(rows, named, group, unit, units)
    # at most 2 * units units and 4 * units parts
    sums = rows.groupBy("unit", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    load: dict[int, int] = {}
    for r in sums:
        load[r["unit"]] = load.get(r["unit"], 0) + r["bytes"]
    placed, used, bases = schedule(list(load.items()), shards), [0] * shards, []
    for r in sorted(sums, key=lambda r: (r["unit"], r["part"])):
        shard = placed[r["unit"]]
        bases.append((r["unit"], r["part"], shard, used[shard]))
        used[shard] += r["n"]
    bases = spark.createDataFrame(bases, "unit int, part int, shard int, base long")
    number = F.row_number().over(Window.partitionBy("unit", "part").orderBy(*group, "__id"))
    return rows.withColumn("number", number).join(F.broadcast(bases), ["unit", "part"]).select(
        F.col("__id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("number") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
