"""A vector index of pivots and rings, searched exactly.

Pivots are spread over a bounded sample of the vectors, each as far from the others as can be. Every
vector with a direction belongs to its nearest pivot; the vectors of a pivot, by their angle to it, form
rings of about equal size. By the triangle inequality of angles, a query at angle a from a pivot is at
least ``max(low - a, a - high)`` from every vector of a ring [low, high]. A search visits the rings
nearest to each query, takes the k-th best angle found as its bar, and then visits only the rings whose
bound is within that bar: all others hold nothing better, so the result is that of a scan of all rows.

Rings, not pivots, are the unit of work: a pivot that has a third of all rows has a third of the rings,
and a ring larger than ``CELL`` rows is met in slices. The tables of pivots and rings are bounded by
``PIVOTS`` and ``RINGS`` whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from factloom.operators.products import CELL, SCORES, Best, fields, unit_rows, whole
from factloom.operators.search import best
from factloom.shared import saved

#: Bounds of the index: pivots (3 MB of 768 floats), vectors that pivots are chosen from, rings.
PIVOTS, SAMPLE, RINGS = 1024, 20_000, 65_536
#: Rows of a ring (about), as long as there are at most ``RINGS``.
RING_ROWS = 4096
#: Rings a query visits first.
PROBES = 4
#: Angles are right to this much.
SLACK = 1e-6
#: Steps of the histogram that rings are cut from.
STEPS = 4096


@dataclass
class VectorIndex:
    """``rows``: key, vector, ring; ``rings``: ring, pivot, low, high, n; ``pivots``: unit vectors by dimension
    with the number of the first."""

    rows: DataFrame
    rings: DataFrame
    pivots: dict[int, tuple[int, np.ndarray]]
    key: str
    vector: str


def spread(vectors: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` of the unit vectors, each the farthest from those before it."""
    chosen = [0]
    near = vectors @ vectors[0]
    while len(chosen) < min(n, len(vectors)):
        far = int(near.argmin())
        if near[far] > 1 - 1e-9:
            break
        chosen.append(far)
        near = np.maximum(near, vectors @ vectors[far])
    return vectors[chosen]


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def build(facts: DataFrame, key: str, vector: str = "embedding", pivots: int = PIVOTS, sample: int = SAMPLE, ring_rows: int = RING_ROWS, rings: int = RINGS) -> VectorIndex:
    """The index of all rows of ``facts`` that have a direction; ``key`` is unique.

    Two passes: angles to the nearest pivot, then rings from a histogram of them. The written table is
    sorted by ring, so a search reads only the parts of the files that hold its rings."""
    spark, n = facts.sparkSession, facts.count()
    # the first of a random order by hash: bounded, and the same in every run
    some = facts.select(vector).where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), F.col(key)).limit(sample).toArrow()
    made, first = {}, 0
    for size, (_, unit) in unit_rows(some[vector]).items():
        if first < pivots:
            made[size] = (first, spread(unit, min(pivots - first, -(-n // ring_rows))))
            first += len(made[size][1])
    held = spark.sparkContext.broadcast(made)

    def nearest(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for size, (places, unit) in unit_rows(table[vector]).items():
                base, points = held.value.get(size, (-size, np.zeros((0, size))))
                if len(points):
                    angle = _angles(unit, points)
                    at = angle.argmin(axis=1)
                    pivot, angle = at + base, angle[np.arange(len(at)), at]
                else:
                    # a dimension that the sample missed is one ring of its own
                    pivot, angle = np.full(len(places), -size), np.zeros(len(places))
                rows = table.take(pa.array(places))
                yield pa.record_batch([whole(rows[key]), whole(rows[vector]), pa.array(pivot, pa.int64()), pa.array(angle)], names=[key, vector, "pivot", "angle"])

    kinds = T.StructType([facts.schema[key], facts.schema[vector], *fields(("pivot", T.LongType()), ("angle", T.DoubleType()))])
    placed = saved(facts.select(key, vector).mapInArrow(nearest, kinds), "index-angles")
    step = F.least(F.floor(F.col("angle") / np.pi * STEPS), F.lit(STEPS - 1)).cast("int")
    bins = placed.groupBy("pivot", step.alias("step")).agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    size = max(ring_rows, -(-2 * n // rings))
    upto = F.sum("n").over(Window.partitionBy("pivot").orderBy("step"))
    cut = bins.withColumn("part", F.floor((upto - F.col("n")) / size))
    # bins of the histogram: at most PIVOTS * STEPS rows, whatever the number of facts
    cut = saved(cut.select("pivot", "step", "n", "low", "high", (F.col("pivot") * (1 << 32) + F.col("part")).alias("ring")), "index-bins")
    whole_rings = cut.groupBy("ring").agg(F.first("pivot").alias("pivot"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    rows = placed.withColumn("step", step).join(cut.select("pivot", "step", "ring"), ["pivot", "step"]).select(key, vector, "ring")
    return VectorIndex(saved(rows.repartitionByRange("ring", key).sortWithinPartitions("ring"), "index-rows"), saved(whole_rings, "index-rings"), made, key, vector)


def _visits(index: VectorIndex, queries: DataFrame, probes: int, first: bool) -> DataFrame:
    """(qid, ring): the ``probes`` nearest rings of each query, or the others whose bound is within its bar (a
    null bar keeps all). Narrow; the tables of pivots and rings go to the tasks, both bounded."""
    rings = index.rings.toArrow()
    held = queries.sparkSession.sparkContext.broadcast((index.pivots, *(rings[c].to_numpy() for c in ("ring", "pivot", "low", "high"))))
    vector = index.vector

    def run(batches):
        pivots, ring, pivot, low, high = held.value
        for batch in batches:
            table = pa.Table.from_batches([batch])
            bars = None if first else table["bar"].to_numpy()
            for size, (places, unit) in unit_rows(table[vector]).items():
                base, points = pivots.get(size, (0, np.zeros((1, size))))
                mine = np.flatnonzero((pivot == -size) | ((pivot >= base) & (pivot < base + len(points)) & (size in pivots)))
                at = np.where(pivot[mine] < 0, 0, pivot[mine] - base)
                # some rows at a time: a row has a bound for each ring
                for i in range(0, len(places), 64):
                    some, angle = places[i : i + 64], _angles(unit[i : i + 64], points)[:, at]
                    bound = np.maximum(0.0, np.maximum(low[mine] - angle, angle - high[mine]))
                    bound[:, pivot[mine] < 0] = 0.0
                    order = np.argsort(bound, axis=1, kind="stable")
                    if first:
                        q, r = np.nonzero(np.ones_like(order[:, :probes]))
                        r = order[q, r]
                    else:
                        bound = np.take_along_axis(bound, order, axis=1)
                        q, r = np.nonzero(~(bound > bars[some][:, None]))
                        q, r = q[r >= probes], r[r >= probes]
                        r = order[q, r]
                    yield pa.record_batch([whole(table["qid"].take(pa.array(some[q]))), pa.array(ring[mine][r], pa.int64())], names=["qid", "ring"])

    return queries.mapInArrow(run, T.StructType([queries.schema["qid"], *fields(("ring", T.LongType()))]))


def _visit(index: VectorIndex, queries: DataFrame, visits: DataFrame, k: int, cell: int) -> DataFrame:
    """The best ``k`` of each query in the rings it visits. A ring is met in slices of its rows and blocks of
    the queries that visit it."""
    key, vector = index.key, index.vector
    parts = lambda n: F.ceil(F.col(n) / cell).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    wanted = visits.groupBy("ring").agg(F.count("*").alias("asking")).join(index.rings, "ring")
    wanted = saved(wanted.select("ring", parts("n").alias("slices"), parts("asking").alias("blocks")), "index-wanted")
    asked = visits.join(wanted, "ring").join(queries.select("qid", vector), "qid").select("qid", vector, "ring", every("slices").alias("slice"), F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int").alias("block"))
    rows = index.rows.join(wanted, "ring").select(key, vector, "ring", F.pmod(F.xxhash64(key), F.col("slices")).cast("int").alias("slice"), every("blocks").alias("block"))
    kinds = fields(("qid", queries.schema["qid"].dataType), (key, index.rows.schema[key].dataType), ("score", T.DoubleType()))

    def run(facts: pa.Table, some: pa.Table) -> pa.Table:
        kernel = Best(some, key, vector, SCORES, False, k=k)
        kernel.feed(facts)
        return kernel.result().cast(pa.schema([("qid", some.schema.field("qid").type), (key, facts.schema.field(key).type), ("score", pa.float64())]))

    by = ("ring", "slice", "block")
    return rows.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(run, kinds)


def search_index(index: VectorIndex, queries: DataFrame, k: int, probes: int = PROBES, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """The exact top-k as :func:`factloom.operators.search.top_k_blocks` gives it (qid, key, score, rank), and
    what it cost: a row for each query with the rows visited and the rows of the index."""
    queries = saved(queries.select("qid", index.vector), "index-queries")
    first = saved(_visits(index, queries, probes, True), "index-visits")
    early = saved(best(_visit(index, queries, first, k, cell), k, F.desc("score"), F.col(index.key)), "index-early")
    bars = early.where(F.col("rank") == k).select("qid", (F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "score"))) + SLACK).alias("bar"))
    rest = saved(_visits(index, queries.join(bars, "qid", "left"), probes, False), "index-visits")
    late = _visit(index, queries, rest, k, cell)
    hits = best(early.drop("rank").unionByName(late), k, F.desc("score"), F.col(index.key))
    total = index.rings.agg(F.sum("n")).first()[0] or 0
    visited = first.unionByName(rest).join(index.rings.select("ring", "n"), "ring").groupBy("qid").agg(F.sum("n").alias("visited"))
    return hits, visited.withColumn("rows", F.lit(total).cast("long"))


def load(spark: SparkSession, path: str, key: str, vector: str = "embedding") -> VectorIndex:
    """An index written by :func:`store`."""
    pivots: dict[int, tuple[int, np.ndarray]] = {}
    by_size: dict[int, list] = {}
    for r in sorted(spark.read.parquet(f"{path}/pivots").collect(), key=lambda r: r.pivot):
        by_size.setdefault(len(r.vector), []).append((r.pivot, r.vector))
    for size, rows in by_size.items():
        pivots[size] = (rows[0][0], np.array([v for _, v in rows]))
    return VectorIndex(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/rings"), pivots, key, vector)


def store(index: VectorIndex, path: str) -> None:
    """Writes an index to a folder: rows sorted by ring, rings, pivots."""
    spark = index.rows.sparkSession
    index.rows.write.mode("overwrite").parquet(f"{path}/rows")
    index.rings.write.mode("overwrite").parquet(f"{path}/rings")
    rows = [(base + i, v.tolist()) for base, points in index.pivots.values() for i, v in enumerate(points)]
    spark.createDataFrame(rows, "pivot long, vector array<double>").write.mode("overwrite").parquet(f"{path}/pivots")
