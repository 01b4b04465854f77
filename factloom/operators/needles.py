"""Which stored texts hold which needles: one pass of the texts with an Aho-Corasick automaton.

Needles up to ``FEW`` (counted) go to the tasks of the stored texts, each of which builds the automaton
once; more are dealt to blocks that meet slices of the texts in cells, by a cogroup. Either way the cost
is the length of the texts and the number of matches, and a task keeps one value for each needle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Needles that go to the tasks whole (of 120 characters: 12 MB); needles of a block; texts of a slice.
FEW, BLOCK, SLICE = 100_000, 100_000, 100_000


def _automaton(needles: list[str]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for i, n in enumerate(needles):
        made.add_word(n, i)
    if needles:
        made.make_automaton()
    return made


class _Least:
    """The least value of the texts that hold each needle."""

    def __init__(self, needles: list[str]) -> None:
        self.needles, self.automaton, self.found = needles, _automaton(needles), {}

    def feed(self, texts: list[str | None], values: list) -> None:
        if not self.needles:
            return
        for text, value in zip(texts, values, strict=True):
            if text and value is not None:
                for i in {i for _, i in self.automaton.iter(text)}:
                    if i not in self.found or value < self.found[i]:
                        self.found[i] = value


def least_holding(stored: DataFrame, needles: DataFrame, text: str, value: str, needle: str = "needle", few: int = FEW, block: int = BLOCK, cut: int = SLICE) -> DataFrame:
    """(needle, value): for each needle that a stored text holds, the least value of such texts. Null and empty
    needles, null texts and null values match nothing."""
    wanted = needles.where(F.col(needle) != "").select(needle).distinct()
    rows = stored.select(F.col(text).alias("__text"), F.col(value).alias(value))
    kind = to_arrow_type(stored.schema[value].dataType)
    schema = T.StructType([T.StructField(needle, T.StringType()), T.StructField(value, stored.schema[value].dataType)])

    def table(least: _Least) -> pa.Table:
        keys = list(least.found)
        return pa.table([pa.array([least.needles[i] for i in keys], pa.string()), pa.array([least.found[i] for i in keys], kind)], names=[needle, value])

    n = wanted.count()
    if n <= few:
        held = stored.sparkSession.sparkContext.broadcast([r[0] for r in wanted.collect()])

        def run(batches):
            least = _Least(held.value)
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    least.feed(part.column(0).to_pylist(), part.column(1).to_pylist())
            yield from table(least).to_batches()

        hits = rows.mapInArrow(run, schema)
    else:
        blocks, slices = -(-n // block), max(1, -(-rows.count() // cut))
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        left = rows.withColumns({"__slice": F.pmod(F.xxhash64("__text", value), F.lit(slices)).cast("int"), "__block": every(blocks)})
        right = wanted.select(F.col(needle).alias(needle), every(slices).alias("__slice"), F.pmod(F.xxhash64(needle), F.lit(blocks)).cast("int").alias("__block"))

        def run_cell(some: pa.Table, asked: pa.Table) -> pa.Table:
            least = _Least(asked[needle].to_pylist())
            least.feed(some["__text"].to_pylist(), some[value].to_pylist())
            return table(least)

        hits = left.groupBy("__slice", "__block").cogroup(right.groupBy("__slice", "__block")).applyInArrow(run_cell, schema)
    return hits.groupBy(needle).agg(F.min(value).alias(value))
