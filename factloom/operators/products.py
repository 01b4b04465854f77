"""Every query against every fact, as a product of blocks.

A kernel takes queries once and facts in parts. Where queries are few (counted), they go to the tasks
whole and the facts stay where they are read. Where they are many, both sides are dealt to cells, blocks
of queries by slices of facts, and each cell is one cogroup; neither side is collected, each is read
once, and what moves is facts times blocks and queries times slices. Scores are matrix products of unit
vectors, rounded to 12 digits so that equal vectors tie wherever they are scored. Null, empty and zero
vectors and those of another size have no score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from factloom.shared import saved

#: Queries that go to the tasks whole: 4096 vectors of 768 floats are 12 MB.
FEW = 4096
#: Rows of a block and of a slice: 100 MB each with 768 doubles.
CELL = 16384
#: The same where queries meet only the facts of their own groups.
LINKED_CELL = 4096
#: Scores held at once by a task: 4 MB, and as much again to find the best.
SCORES = 1 << 19
#: Facts whose vectors are held as doubles at once: 12 MB with 768 of them.
PART = 2048
#: Queries that a kernel takes: its rows for each query are sorted for so many queries at once.
ASKED = 2048

#: What counts as equal among scores that were rounded apart, and what rounding may move two scores by.
EQUAL, MOVED = 1e-11, 1e-12

Units = dict[int, tuple[np.ndarray, np.ndarray]]


def whole(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.Array):
        return column
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def unit_rows(column: pa.Array | pa.ChunkedArray) -> Units:
    """Places and unit vectors of a column of lists, by dimension, without null and zero vectors."""
    rows = whole(column)
    sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
    values = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    out = {}
    for size in np.unique(sizes[sizes > 0]).tolist():
        places = np.flatnonzero(sizes == size)
        block = values.reshape(-1, size) if len(places) * size == len(values) else values[starts[places][:, None] + np.arange(size)]
        lengths = np.linalg.norm(block, axis=1)
        good = lengths > 0
        if not good.all():
            places, block, lengths = places[good], block[good], lengths[good]
        if len(places):
            block /= lengths[:, None]
            out[size] = places, block
    return out


class Kernel:
    """Queries (qid, ``vector``, ...) of a block; facts come in parts."""

    def __init__(self, asked: pa.Table, key: str, vector: str, scores: int, others: bool) -> None:
        self.asked, self.key, self.vector, self.most, self.others = asked, key, vector, scores, others
        self.units = unit_rows(asked[vector])
        self.qids = whole(asked["qid"])

    def scored(self, facts: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of queries, places of facts and their scores, not yet rounded, a part at a time; with
        ``others`` a query has no score with the fact of its own id."""
        parts = ((at, rows) for at in range(0, facts.num_rows, PART) for rows in unit_rows(facts[self.vector].slice(at, PART)).items())
        for start, (size, (places, block)) in parts:
            if size not in self.units:
                continue
            asking, unit = self.units[size]
            step = max(1, self.most // len(asking))
            for i in range(0, len(block), step):
                scores, at = unit @ block[i : i + step].T, start + places[i : i + step]
                if self.others:
                    own = whole(pc.index_in(self.qids.take(pa.array(asking)), value_set=whole(facts[self.key]).take(pa.array(at)))).to_numpy(zero_copy_only=False)
                    q = np.flatnonzero(~np.isnan(own.astype(float)))
                    scores[q, own[q].astype(int)] = -np.inf
                yield asking, at, scores

    def feed(self, facts: pa.Table) -> None:
        raise NotImplementedError

    def result(self) -> pa.Table:
        raise NotImplementedError


class Best(Kernel):
    """The best ``k`` facts of each query: qid, key, score."""

    def __init__(self, *args, k: int, later_first: bool = False) -> None:
        super().__init__(*args)
        self.k, self.order = k, [("q", "ascending"), ("score", "descending"), ("key", "descending" if later_first else "ascending")]
        self.held: list[pa.Table] = []
        self.n = 0
        #: Of each query, a score that k facts are known to reach.
        self.bar = np.full(len(self.asked), -np.inf)

    def feed(self, facts: pa.Table) -> None:
        keys = whole(facts[self.key])
        for asking, at, scores in self.scored(facts):
            n = scores.shape[1]
            bar = self.bar[asking]
            many = np.flatnonzero((scores >= bar[:, None] - MOVED).sum(axis=1) > self.k)
            if len(many):
                bar[many] = np.maximum(bar[many], np.partition(scores[many], n - self.k, axis=1)[:, n - self.k])
                self.bar[asking] = bar
            # all rows that tie with the k-th once rounded stay, ties are settled by key
            q, f = np.nonzero((scores >= bar[:, None] - MOVED) & (scores > -np.inf))
            self.held.append(pa.table({"q": asking[q], "key": keys.take(pa.array(at[f])), "score": np.round(scores[q, f], 12)}))
            self.n += len(q)
            if self.n > 4 * self.k * len(self.asked) + 1000:
                self._cut()

    def _cut(self) -> None:
        rows = pa.concat_tables(self.held).sort_by(self.order)
        q = rows["q"].to_numpy()
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.k - 1
        self.bar[q[last]] = rows["score"].to_numpy()[last]
        self.held = [rows.filter(pa.array(rank < self.k))]
        self.n = len(self.held[0])

    def result(self) -> pa.Table:
        if not self.held:
            return pa.table({"qid": self.qids.slice(0, 0), self.key: pa.nulls(0), "score": pa.array([], pa.float64())})
        self._cut()
        rows = self.held[0]
        return pa.table({"qid": self.qids.take(whole(rows["q"])), self.key: rows["key"], "score": rows["score"]})


class Above(Kernel):
    """How many facts lie above marks: asked rows have mark_key and mark_score; of equal scores the one with
    the lower key is above, or with ``later_first`` the one with the higher key. Gives qid, mark_key, above."""

    def __init__(self, *args, later_first: bool = False) -> None:
        super().__init__(*args)
        self.later_first = later_first
        self.marks, self.mark_keys = self.asked["mark_score"].to_numpy(), whole(self.asked["mark_key"])
        self.above = np.zeros(len(self.marks), np.int64)

    def feed(self, facts: pa.Table) -> None:
        keys = whole(facts[self.key])
        for asking, at, scores in self.scored(facts):
            scores = np.round(scores, 12)
            marks = self.marks[asking][:, None]
            self.above[asking] += (scores > marks + EQUAL).sum(axis=1)
            q, f = np.nonzero(np.abs(scores - marks) <= EQUAL)
            if len(q):
                mine, theirs = self.mark_keys.take(pa.array(asking[q])), keys.take(pa.array(at[f]))
                over = (pc.greater if self.later_first else pc.less)(theirs, mine)
                np.add.at(self.above, asking[q[over.to_numpy(zero_copy_only=False)]], 1)

    def result(self) -> pa.Table:
        return pa.table({"qid": self.qids, "mark_key": self.mark_keys, "above": self.above})


def product(
    facts: DataFrame,
    queries: DataFrame,
    key: str,
    vector: str,
    kernel: Callable[[pa.Table], Kernel],
    schema: T.StructType,
    few: int = FEW,
    cell: int = CELL,
) -> DataFrame:
    """Results of a kernel over all queries and facts, to be merged by the caller. ``queries`` has qid,
    ``vector`` and what the kernel needs; qid and ``key`` deal the rows to cells."""
    rows = facts.select(key, vector)
    n = queries.count()

    def finish(made: Kernel) -> pa.Table:
        out = made.result()
        return pa.table([out[f.name].cast(to_arrow_type(f.dataType)) for f in schema], names=schema.names)

    def kernels(asked: pa.Table) -> Iterator[Kernel]:
        return (kernel(asked.slice(at, ASKED)) for at in range(0, max(1, asked.num_rows), ASKED))

    if n <= few:
        held = facts.sparkSession.sparkContext.broadcast(queries.toArrow())

        def run(batches):
            made = list(kernels(held.value))
            for batch in batches:
                for one in made:
                    one.feed(pa.Table.from_batches([batch]))
            for one in made:
                yield from finish(one).to_batches()

        return rows.mapInArrow(run, schema)

    blocks, slices = -(-n // cell), max(1, -(-rows.count() // cell))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    # both sides may come from one table: columns of their own
    rows, queries = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (rows, queries))
    left = rows.withColumns({"__slice": F.pmod(F.xxhash64(key), F.lit(slices)).cast("int"), "__block": every(blocks)})
    right = queries.withColumns({"__slice": every(slices), "__block": F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")})

    def run_cell(some_facts: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        for one in kernels(asked):
            one.feed(some_facts)
            found.append(finish(one))
        return pa.concat_tables(found)

    return left.groupBy("__slice", "__block").cogroup(right.groupBy("__slice", "__block")).applyInArrow(run_cell, schema)


def linked_product(
    facts: DataFrame,
    queries: DataFrame,
    key: str,
    vector: str,
    group: str,
    kernel: Callable[[pa.Table], Kernel],
    schema: T.StructType,
    cell: int,
) -> DataFrame:
    """Results of a kernel over the queries and facts of each group. ``facts`` (``group``, ``key``, ``vector``)
    and ``queries`` (``group``, qid, ``vector``) have a row for each group they are in. Small groups share a
    cell, a large one is cut into blocks by slices; no pair is a row. ``group`` of null is no group."""
    rows, queries = (df.select(*[F.col(c).alias(c) for c in df.columns]).where(F.col(group).isNotNull()) for df in (facts.select(group, key, vector), queries.select(group, "qid", vector)))
    counted = [df.groupBy(group).agg(F.count("*").alias(n)) for df, n in ((rows, "__nf"), (queries, "__nq"))]
    sizes = saved(counted[0].join(counted[1], group), "groups")
    total = sizes.agg(F.sum("__nf"), F.sum("__nq")).first()
    buckets = max(1, *(-(-2 * (n or 0) // cell) for n in total))
    parts = lambda n: F.ceil(F.coalesce(F.col(n), F.lit(1)) / cell).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), parts(n) - 1))
    # of these there are at most rows / cell
    large = F.broadcast(sizes.where((F.col("__nf") > cell) | (F.col("__nq") > cell)))
    bucket = F.pmod(F.xxhash64(group), F.lit(buckets)).cast("int").alias("__bucket")
    of = lambda c, n: F.pmod(F.xxhash64(c), parts(n)).cast("int")
    left = rows.join(sizes.select(group), group, "left_semi").join(large, group, "left").select(group, key, vector, bucket, of(key, "__nf").alias("__slice"), every("__nq").alias("__block"))
    right = queries.join(large, group, "left").select(group, "qid", vector, bucket, every("__nf").alias("__slice"), of("qid", "__nq").alias("__block"))

    def run_cell(some_facts: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        for value in pc.unique(asked[group]):
            one, those = (t.filter(pc.equal(t[group], value)) for t in (asked, some_facts))
            if len(those):
                made = kernel(one)
                made.feed(those)
                found.append(made.result())
        columns = [[out[f.name].cast(to_arrow_type(f.dataType)) for out in found] for f in schema]
        return pa.table([pa.chunked_array([c for part in cs for c in part.chunks], to_arrow_type(f.dataType)) for f, cs in zip(schema, columns, strict=True)], names=schema.names)

    by = ("__bucket", "__slice", "__block")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run_cell, schema)


def fields(*named: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in named])
