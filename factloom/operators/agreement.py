"""Agreement of two orders (Kendall) for lists of any length, as relations.

A pair is discordant when one order has it the other way round. Places are cut into bins in either order,
about ``BIN`` items each. Pairs in one bin of the predicted order are counted there, pairs in one bin of
the actual order but two of the predicted one are counted in that bin, and pairs apart in both follow from
the counts of items by both bins. So no task sees a whole long list, and a list of n items costs about
n log n. Short lists are counted many at a time, in the batches of a sorted stream.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Items of a bin (about), and bins of a list at most: their counts by both bins are one group.
BIN, BINS = 4096, 1024


def inversions_by_list(lists: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Pairs of each list in which an earlier value is greater, by a merge sort from the bottom up. ``lists``:
    numbers from 0, ascending."""
    n = len(values)
    if not n:
        return np.zeros(0, np.int64)
    # ranks with equal values in order, so that they are no inversion, and a list's ranks after those of the
    # lists before it, so that no two lists have any; the padding is above all of them
    size = 1 << (n - 1).bit_length()
    rank = np.arange(size, dtype=np.int64)
    rank[np.lexsort((values, lists))] = np.arange(n)
    counts, width = np.zeros(lists[-1] + 1, np.int64), 1
    while width < size:
        rows = rank.reshape(-1, 2, width)
        shift = np.arange(len(rows), dtype=np.int64)[:, None] * size
        left, right = (rows[:, 0] + shift).ravel(), (rows[:, 1] + shift).ravel()
        # of each right value, the left ones above it
        above = width - (np.searchsorted(left, right) - np.repeat(np.arange(len(rows)) * width, width))
        at = np.flatnonzero(above)
        np.add.at(counts, lists[rows[:, 1].ravel()[at]], above[at])
        width *= 2
        rank = np.sort(rank.reshape(-1, width), axis=1).ravel()
    return counts


def inversions(values: np.ndarray) -> int:
    """Pairs in which an earlier value is greater."""
    return int(inversions_by_list(np.zeros(len(values), np.int64), values).sum())


def _starts(rows: pa.Table, *columns: str) -> np.ndarray:
    """Whether a row differs from the one before it in any of the columns; the first does."""
    fresh = np.ones(rows.num_rows, bool)
    fresh[1:] = False
    for c in columns:
        codes = rows[c].combine_chunks().dictionary_encode(null_encoding="encode")
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
        fresh[1:] |= codes[1:] != codes[:-1]
    return fresh


def _same(one: pa.Table, other: pa.Table, *columns: str) -> bool:
    """Whether the last row of one and the first row of the other agree in the columns."""
    return all(one[c][-1].as_py() == other[c][0].as_py() for c in columns)


def _apart(cells: np.ndarray) -> int:
    """Discordant pairs that lie in two rows and two columns of a table of counts."""
    # of each cell, what lies in later rows and earlier columns
    later = np.zeros((cells.shape[0] + 1, cells.shape[1] + 1), dtype=object if cells.sum() > 3_000_000_000 else np.int64)
    later[:-1, 1:] = np.cumsum(np.cumsum(cells[::-1], axis=0)[::-1], axis=1)
    return int((cells * later[1:, :-1]).sum())


def rank_agreement(predicted: DataFrame, actual: DataFrame, by: str, item: str, place: str, bin_items: int = BIN, bins: int = BINS) -> DataFrame:
    """(``by``, agreement): (tau + 1) / 2 over the items that both orders of a list hold; an item's last place
    counts. Fewer than two items in an order: 1; fewer than two common ones: 0.5. Places are numbers, one
    item each; lists that only one side has count as empty on the other."""
    last = lambda rows, name: rows.groupBy(by, item).agg(F.max(place).cast("double").alias(name))
    sizes = predicted.groupBy(by).agg(F.count("*").alias("np")).join(actual.groupBy(by).agg(F.count("*").alias("na")), by, "full")
    both = last(predicted, "p").join(last(actual, "a"), [by, item])
    ends = both.groupBy(by).agg(F.count("*").alias("n"), *[f(c).alias(f"{c}_{m}") for c in "pa" for m, f in (("low", F.min), ("high", F.max))])
    ends = ends.withColumn("bins", F.least(F.lit(bins), F.ceil(F.col("n") / bin_items)).cast("int"))
    bin_of = lambda c: F.least(F.floor((F.col(c) - F.col(f"{c}_low")) * F.col("bins") / (F.col(f"{c}_high") - F.col(f"{c}_low") + 1)), F.col("bins") - 1).cast("int")
    rows = both.join(ends, by).select(by, "p", "a", "bins", bin_of("p").alias("pb"), bin_of("a").alias("ab"))
    counted = T.StructType([rows.schema[by], T.StructField("discordant", T.LongType())])
    plain = to_arrow_schema(counted)

    def within(bin_: str, *order: str) -> DataFrame:
        """Pairs of each list and bin of it, with the rows in ``order``: many lists at a time."""

        def run(batches):
            rest: list[pa.Table] = []
            for batch in (*batches, None):
                if batch is not None and not batch.num_rows:
                    continue
                if batch is None:
                    some, cut = (pa.concat_tables(rest), None) if rest else (None, None)
                else:
                    new = pa.Table.from_batches([batch])
                    fresh = _starts(new, by, bin_)
                    # the list that ends the batch may go on, and the first may go on from the rest
                    cut = int(np.flatnonzero(fresh)[-1])
                    if not cut and rest and _same(rest[-1], new, by, bin_):
                        rest.append(new)
                        continue
                    some, rest = pa.concat_tables([*rest, new.slice(0, cut)]), [new.slice(cut)]
                if some is not None and some.num_rows:
                    fresh = _starts(some, by, bin_)
                    n = inversions_by_list(np.cumsum(fresh) - 1, some["a"].to_numpy())
                    yield from pa.table([some[by].take(pa.array(np.flatnonzero(fresh))).cast(plain.field(by).type), pa.array(n, pa.int64())], schema=plain).to_batches()

        some = rows if bin_ == "pb" else rows.where("bins > 1")
        return some.repartition(by, bin_).sortWithinPartitions(by, bin_, *order).select(by, bin_, "a").mapInArrow(run, counted)

    def apart(some: pa.Table) -> pa.Table:
        cells = np.zeros((some["bins"][0].as_py(),) * 2, np.int64)
        cells[some["pb"].to_numpy(), some["ab"].to_numpy()] = some["n"].to_numpy()
        return pa.table({by: some[by].slice(0, 1), "discordant": pa.array([_apart(cells)], pa.int64())})

    long = rows.where("bins > 1")
    # within a bin of the actual order, rows of one bin of the predicted one ascend and count nothing
    counts = within("pb", "p").unionByName(within("ab", "pb", "a"))
    counts = counts.unionByName(long.groupBy(by, "bins", "pb", "ab").agg(F.count("*").alias("n")).groupBy(by).applyInArrow(apart, counted))
    discordant = counts.groupBy(by).agg(F.sum("discordant").alias("discordant"))
    out = sizes.join(ends.select(by, "n"), by, "left").join(discordant, by, "left")
    pairs = F.col("n") * (F.col("n") - 1) / 2.0
    few = (F.coalesce("np", F.lit(0)) < 2) | (F.coalesce("na", F.lit(0)) < 2)
    return out.select(by, F.when(few, 1.0).when(F.coalesce("n", F.lit(0)) < 2, 0.5).otherwise(1 - F.col("discordant") / pairs).alias("agreement"))
